"""Live scoring: a table of models, one row a symbol, refitted when enough bars have come; each symbol's latest bar scored by the model of its regime.

All state is in tables, so a restarted loop goes on where it was: how many bars a model is behind is counted, not remembered.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marketloom.functions.scalars import sigmoid
from marketloom.operators import features as X
from marketloom.operators.signals import latest

MODEL = "struct<intercept: double, mean: array<double>, scale: array<double>, coef: array<double>>"
MODELS = f"symbol string, trained_at timestamp, models map<string, {MODEL}>"
METADATA = "trained_at timestamp, symbol string, regime string, n_train_rows long, accuracy double, base_rate double, params string, importances string"
#: A signal's least confidence; new bars until a refit, bars of a fit; rows that a regime needs.
LEAST_CONFIDENCE, REFIT_AFTER, FIT_ON, LEAST_ROWS = 0.6, 50, 500, 60
#: Ridge of the standardised coefficients and Newton steps.
RIDGE, STEPS = 10.0, 25


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """(intercept, mean, scale, coefficients) of a ridge logistic regression of standardised columns, by Newton's steps."""
    mean, scale = x.mean(0), x.std(0)
    scale[scale < 1e-12] = 1.0
    a = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    w, penalty = np.zeros(a.shape[1]), ridge * np.eye(a.shape[1])
    penalty[0, 0] = 1e-9
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + penalty, a.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-10:
            break
    return float(w[0]), mean, scale, w[1:]


def with_regime(rows: DataFrame) -> DataFrame:
    return rows.withColumn("regime", X.regime(F.col("adx_norm") * 100))


def due_symbols(models: DataFrame, rows: DataFrame, every: int = REFIT_AFTER) -> DataFrame:
    """(symbol) of those without models, or whose rows have `every` bars or more after the last that the models know."""
    known = models.select("symbol", "trained_at", (F.size("models") > 0).alias("__has"))
    behind = rows.select("symbol", "open_time").join(known, "symbol", "left").groupBy("symbol").agg(
        F.count_if(F.col("trained_at").isNull() | (F.col("open_time").cast("timestamp") > F.col("trained_at"))).alias("n"), F.coalesce(F.max("__has"), F.lit(False)).alias("has")
    )
    return behind.filter(~F.col("has") | (F.col("n") >= every)).select("symbol")


def refit(models: DataFrame, rows: DataFrame, every: int = REFIT_AFTER, window: int = FIT_ON, least: int = LEAST_ROWS) -> tuple[DataFrame, DataFrame]:
    """(MODELS of the symbols that were fitted again, METADATA of each of their models).

    rows: features with `valid` and the label y_true (NULL where it isn't known yet, then left out). A symbol that is due learns from its last
    `window` bars, a model for each regime with `least` rows and both classes; one that gets no model keeps what it has.
    A task holds at most `window` rows of a symbol. No row is due twice: the last bar's time is what the next count begins from.
    """
    names = list(X.FEATURE_NAMES)
    newest = Window.partitionBy("symbol").orderBy(F.desc("open_time"))
    recent = rows.join(due_symbols(models, rows, every), "symbol", "left_semi").withColumn("__k", F.row_number().over(newest)).filter(F.col("__k") <= window)
    recent = recent.withColumn("__last", F.max(F.col("open_time").cast("timestamp")).over(Window.partitionBy("symbol")))
    usable = with_regime(recent.filter(F.col("valid") & F.col("y_true").isNotNull())).select("symbol", "regime", "__last", F.col("y_true").cast("double").alias("y"), *names)

    def one(t: pd.DataFrame) -> pd.DataFrame:
        columns = ["symbol", "regime", "trained_at", "n", "accuracy", "base_rate", "intercept", "mean", "scale", "coef"]
        y = t["y"].to_numpy()
        if len(t) < least or y.min() == y.max():
            return pd.DataFrame([], columns=columns)
        x = t[names].to_numpy(float)
        b, mean, scale, coef = fit_logistic(x, y)
        right = ((b + (x - mean) / scale @ coef >= 0) == (y == 1)).mean()
        return pd.DataFrame([(t["symbol"].iloc[0], t["regime"].iloc[0], t["__last"].iloc[0], len(t), right, max(y.mean(), 1 - y.mean()), b, mean, scale, coef)], columns=columns)

    fitted = usable.groupBy("symbol", "regime").applyInPandas(one, "symbol string, regime string, trained_at timestamp, n long, accuracy double, base_rate double, intercept double, mean array<double>, scale array<double>, coef array<double>")
    model = F.struct("intercept", "mean", "scale", "coef")
    table = fitted.groupBy("symbol", "trained_at").agg(F.map_from_entries(F.collect_list(F.struct("regime", model.alias("m")))).alias("models"))  # two regimes at most
    weights = F.map_from_arrays(F.array(*map(F.lit, names)), F.transform("coef", lambda c: F.round(F.abs(c), 9)))
    meta = fitted.select("trained_at", "symbol", "regime", F.col("n").alias("n_train_rows"), "accuracy", "base_rate", F.to_json(F.struct(F.lit(RIDGE).alias("ridge"), F.lit(window).alias("window"))).alias("params"), F.to_json(weights).alias("importances"))
    return table, meta


def score_latest(features: DataFrame, models: DataFrame, least_confidence: float = LEAST_CONFIDENCE) -> DataFrame:
    """(symbol, open_time, close, regime, p_up, direction, confidence, emitted) of each symbol's last bar, by the model of its regime.

    A last bar that lacks a feature, a symbol without models and a regime without one have no row. The
    direction is 1 from one half; the confidence is twice the distance to one half; a signal goes out from least_confidence on.
    """
    last = with_regime(latest(features).filter("valid")).join(models.select("symbol", "models"), "symbol").withColumn("__m", F.try_element_at("models", F.col("regime"))).filter("__m IS NOT NULL")
    m, x = F.col("__m"), F.array(*(F.col(c) for c in X.FEATURE_NAMES))
    terms = F.zip_with(F.zip_with(F.zip_with(x, m["mean"], lambda a, b: a - b), m["scale"], lambda a, s: a / s), m["coef"], lambda a, c: a * c)
    scored = last.withColumn("p_up", sigmoid(m["intercept"] + F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t)))
    confidence = F.abs(F.col("p_up") - 0.5) * 2
    return scored.select("symbol", "open_time", "close", "regime", "p_up", (F.col("p_up") >= 0.5).cast("int").alias("direction"), confidence.alias("confidence"), (confidence >= least_confidence).alias("emitted"))
