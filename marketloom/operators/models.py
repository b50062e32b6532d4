"""Models on features and labels with MLlib: purged evaluation, calibration, meta-labels, regimes, search, export.

Folds are few and fixed, so the driver loops over them, some at a time in threads; every fit and score is a Spark job.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array

from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marketloom.functions import windows as W
from marketloom.functions.scalars import sigmoid
from marketloom.operators import features as X
from marketloom.operators import search as S
from marketloom.operators import signals as G
from marketloom.operators import validation as V
from marketloom.operators.ranks import mutual_information, ranked, settled
from marketloom.operators.recursive import fit_garch, held_out_qlike

CLIP = 1e-6
#: Inverse strength of the penalty on standardised coefficients, of direction models and of meta-models; boosted rounds at most,
#: their depth, step and least rows of a leaf; the share of a train range's end that decides when to stop.
C_DIRECTION, C_META = 0.1, 0.2
ROUNDS, DEPTH, STEP, LEAST_LEAF, HELD = 150, 3, 0.05, 40, 0.15
#: Rows between a train range's fitted part and the part that decides when to stop: horizon and embargo.
GAP = 18
#: Fits at a time, in driver threads.
TOGETHER = 4


def dataset(bars: DataFrame, vertical: int = 24) -> DataFrame:
    """Valid, labelled, directional rows with features (a vector), y_true, weight, realised_return and row_idx in time order.

    row_idx numbers what is left after filtering, over all symbols by time, for the folds.
    """
    labelled = settled(X.triple_barrier(X.build_features(bars), vertical=vertical))  # read by the weights and by the rows
    spans = labelled.filter("labelable").select("symbol", "idx", "touch_idx", "realised_return")
    weights = X.sample_weights(labelled, spans).select("symbol", "idx", "weight")
    rows = labelled.filter("valid AND labelable AND label <> 0").join(weights, ["symbol", "idx"])
    rows = VectorAssembler(inputCols=X.FEATURE_NAMES, outputCol="features").transform(rows)
    return numbered(rows).withColumn("y_true", (F.col("label") > 0).cast("int"))


def numbered(rows: DataFrame, time: str = "open_time", tie: str = "symbol") -> DataFrame:
    """rows with row_idx, their position by (time, tie) from 0: ranked inside each day, after the counts of the days before, so no task has them all."""
    rows = rows.withColumn("__day", F.to_date(time))
    days = rows.groupBy("__day").agg(F.count("*").alias("__n"))
    before = days.select("__day", F.coalesce(F.sum("__n").over(Window.orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__day").orderBy(time, tie)) - 1
    return rows.join(F.broadcast(before), "__day").withColumn("row_idx", F.col("__before") + inside).drop("__day", "__before")


# --- fits ---------------------------------------------------------------------------------------------------------------


def _balanced(train: DataFrame) -> DataFrame:
    """w: the weight times n / (2 * rows of the class)."""
    n = train.groupBy("y_true").agg(F.count("*").alias("__k"))  # two rows
    n = n.withColumn("__n", F.sum("__k").over(Window.partitionBy(F.lit(0))))
    return train.join(F.broadcast(n), "y_true").withColumn("w", F.col("weight") * F.col("__n") / (2 * F.col("__k"))).drop("__k", "__n")


def _logistic(train: DataFrame, c: float = C_DIRECTION, elastic: float = 0.0, steps: int = 100, total: float | None = None):
    """The sum of weighted losses, times c, beside half the squared coefficients of standardised features: MLlib divides both by the weights' sum, total, which is summed here if it isn't given."""
    total = total or train.agg(F.sum("w")).first()[0] or 1.0
    return LogisticRegression(labelCol="y_true", weightCol="w", regParam=1 / (c * total), elasticNetParam=elastic, maxIter=steps, tol=1e-6).fit(train)


def _boosted(train: DataFrame, params: dict | None = None):
    """Boosted trees that stop once the loss on the last HELD of the train rows, GAP rows on, gets no better; all rows are fitted where there are too few."""
    at = {"maxDepth": DEPTH, "maxIter": ROUNDS, "stepSize": STEP, "minInstancesPerNode": LEAST_LEAF} | (params or {})
    trees = GBTClassifier(labelCol="y_true", weightCol="w", seed=1, **at)
    cut = train.agg(F.percentile("row_idx", 1 - HELD)).first()[0]
    marked = train.withColumn("held", F.col("row_idx") >= cut).filter((F.col("row_idx") < cut - GAP) | F.col("held"))
    sizes = {r["held"]: r["count"] for r in marked.groupBy("held").count().collect()}
    if min(sizes.get(True, 0), sizes.get(False, 0)) < 2 * LEAST_LEAF:
        return trees.fit(train)
    return trees.setValidationIndicatorCol("held").fit(marked)


def _fit(train: DataFrame, kind: str, c: float = C_DIRECTION, params: dict | None = None):
    return _boosted(train, params) if kind == "gbm" else _logistic(train, c, **(params or {}))


def score(model, rows: DataFrame) -> DataFrame:
    return model.transform(rows).withColumn("y_prob", vector_to_array("probability")[1]).withColumn("y_pred", F.col("prediction").cast("int"))


def _each(jobs: list[Callable]) -> list:
    """What the jobs return, in order, some of them run at a time; None is left out."""
    with ThreadPoolExecutor(TOGETHER) as pool:
        return [x for x in pool.map(lambda job: job(), jobs) if x is not None]


def _both_classes(train: DataFrame) -> bool:
    return train.select("y_true").distinct().count() == 2


def between(rows: DataFrame, lo: int, hi: int, idx: str = "row_idx") -> DataFrame:
    return rows.filter((F.col(idx) >= lo) & (F.col(idx) < hi))


def _scored(train: DataFrame, test: DataFrame, kind: str, c: float = C_DIRECTION, params: dict | None = None) -> DataFrame | None:
    """test with the scores of a model of train; None if train has one class."""
    train = _balanced(train).persist()
    try:
        return score(_fit(train, kind, c, params), test) if _both_classes(train) else None
    finally:
        train.unpersist()


def fold_scores(rows: DataFrame, folds: list[tuple], kind: str = "logreg", c: float = C_DIRECTION, params: dict | None = None) -> DataFrame:
    """Out-of-sample scores of every fold whose train rows have both classes: fold, model, row_idx, y_true, y_pred, y_prob, fwd_ret."""

    def one(k, a, b, lo, hi):
        found = _scored(between(rows, a, b), between(rows, lo, hi), kind, c, params)
        return found and found.select(F.lit(k).alias("fold"), F.lit(kind).alias("model"), "row_idx", "y_true", "y_pred", "y_prob", F.col("realised_return").alias("fwd_ret"))

    return reduce(DataFrame.unionByName, _each([lambda f=f: one(*f) for f in folds]))


def baseline_scores(rows: DataFrame, folds: list[tuple]) -> DataFrame:
    """Scores of always calling up, of the train rows' majority, and of a coin as uneven as they are (a digest of the row's number, so the same on every run)."""
    ranges = rows.sparkSession.createDataFrame(folds, "fold int, a long, b long, lo long, hi long")  # a row a fold
    idx, coin = F.col("row_idx"), F.pmod(F.xxhash64("row_idx", F.lit(3)), F.lit(1_000_003)) / 1_000_003
    share = rows.join(F.broadcast(ranges), (idx >= F.col("a")) & (idx < F.col("b"))).groupBy("fold").agg(F.avg(F.col("y_true").cast("double")).alias("up"))
    test = rows.join(F.broadcast(ranges), (idx >= F.col("lo")) & (idx < F.col("hi"))).join(F.broadcast(share), "fold")
    calls = F.array(*(F.struct(F.lit(n).alias("model"), c.cast("int").alias("y_pred")) for n, c in (("always_up", F.lit(1)), ("majority", F.bround("up", 0)), ("random", coin < F.col("up")))))
    return test.select("fold", F.inline(calls), "row_idx", "y_true", F.col("realised_return").alias("fwd_ret")).withColumn("y_prob", F.col("y_pred").cast("double"))


def heuristic_scores(rows: DataFrame, folds: list[tuple]) -> DataFrame:
    """Scores of the rules on the test rows where they have an opinion."""
    call = G.heuristic(F.col("log_p_sma50"), F.col("rsi_14_c"), F.col("bb_bandwidth"))
    ranges = V.fold_ranges(rows.sparkSession, folds).filter("role = 'test'").drop("role")
    rules = rows.withColumn("y_pred", call).filter("y_pred >= 0").join(F.broadcast(ranges), (F.col("row_idx") >= F.col("lo")) & (F.col("row_idx") < F.col("hi")))
    return rules.select("fold", F.lit("heuristic").alias("model"), "row_idx", "y_true", "y_pred", F.col("y_pred").cast("double").alias("y_prob"), F.col("realised_return").alias("fwd_ret"))


#: The rules are scored in folds where they have so many opinions at least.
LEAST_OPINIONS = 20


def evaluate(rows: DataFrame, n_splits: int = 5, min_train: int = 500, kinds: tuple[str, ...] = ("logreg",), cost_bps: float = 5.0) -> DataFrame:
    """Metrics by model and fold: the models, the rules (where they have opinions enough) and the baselines; coverage: the share of the fold's test rows that are scored."""
    rows = settled(rows)
    folds = V.walk_forward(rows.count(), n_splits=n_splits, min_train=min_train)
    scores = [fold_scores(rows, folds, k) for k in kinds] + [heuristic_scores(rows, folds), baseline_scores(rows, folds)]
    metrics = V.class_metrics(reduce(DataFrame.unionByName, scores), by=("model", "fold"), cost_bps=cost_bps)
    sizes = rows.sparkSession.createDataFrame([(k, hi - lo) for k, _, _, lo, hi in folds], "fold int, __test long")  # a row a fold
    metrics = metrics.join(F.broadcast(sizes), "fold").withColumn("coverage", F.col("n") / F.col("__test")).drop("__test")
    return metrics.filter((F.col("model") != "heuristic") | (F.col("n") >= LEAST_OPINIONS))


def evaluate_pooled(rows: DataFrame, n_splits: int = 5, min_train: int = 500, kind: str = "logreg", cost_bps: float = 5.0, siblings: str = "before") -> DataFrame:
    """Metrics by symbol and fold of models that learn from a symbol's own purged rows and those of all others; n_train too.

    Folds are of each symbol's own rows. siblings "before": others' rows up to the end of the own train rows, so that
    none lies in or after the test; "all": all of them. Symbols with too few rows for n_splits folds have no row.
    """
    rows = settled(ranked(rows, ["symbol"], ["open_time", "idx"], "own").withColumn("own", F.col("own") - 1))
    sizes = {r["symbol"]: r["count"] for r in rows.groupBy("symbol").count().collect()}  # a row a symbol
    jobs = []
    for symbol, n in sorted(sizes.items()):
        try:
            folds = V.walk_forward(n, n_splits=n_splits, min_train=min_train)
        except ValueError:
            continue
        jobs += [(symbol, *f) for f in folds]

    def one(symbol, k, a, b, lo, hi):
        mine, others = rows.filter(F.col("symbol") == symbol), rows.filter(F.col("symbol") != symbol)
        own = between(mine, a, b, "own")
        if siblings == "before":
            others = others.filter(F.col("open_time") <= F.lit(own.agg(F.max("open_time")).first()[0]))
        train = own.unionByName(others)
        found = _scored(train, between(mine, lo, hi, "own"), kind)
        return found and found.select(F.lit(symbol).alias("symbol"), F.lit(k).alias("fold"), "row_idx", "y_true", "y_pred", "y_prob", F.col("realised_return").alias("fwd_ret"), F.lit(train.count()).alias("n_train"))

    scores = reduce(DataFrame.unionByName, _each([lambda j=j: one(*j) for j in jobs]))
    trained = scores.groupBy("symbol", "fold").agg(F.max("n_train").alias("n_train"))
    return V.class_metrics(scores, by=("symbol", "fold"), cost_bps=cost_bps).join(trained, ["symbol", "fold"])


def evaluate_combinatorial(rows: DataFrame, n_groups: int = 6, n_test: int = 2, kind: str = "logreg", cost_bps: float = 0.0) -> DataFrame:
    """Metrics by split of the combinatorial purged splits; splits whose train rows have one class, or of under 20 test rows, are left out."""
    rows = settled(rows)
    pieces: dict[int, dict[str, list]] = {}
    for fold, role, lo, hi in V.combinatorial(rows.count(), n_groups, n_test):
        pieces.setdefault(fold, {}).setdefault(role, []).append((F.col("row_idx") >= lo) & (F.col("row_idx") < hi))

    def one(fold, parts):
        train, test = (rows.filter(reduce(Column.__or__, parts[role])) for role in ("train", "test"))
        found = _scored(train, test, kind) if test.count() >= 20 else None
        return found and found.select(F.lit(fold).alias("fold"), "row_idx", "y_true", "y_pred", "y_prob", F.col("realised_return").alias("fwd_ret"))

    return V.class_metrics(reduce(DataFrame.unionByName, _each([lambda f=f, p=p: one(f, p) for f, p in pieces.items() if len(p) == 2])), cost_bps=cost_bps)


# --- calibration ----------------------------------------------------------------------------------------------------------


def _logit(p: Column) -> Column:
    q = F.greatest(F.lit(CLIP), F.least(F.lit(1 - CLIP), p))
    return F.ln(q / (1 - q))


def platt(train: DataFrame, rows: DataFrame) -> DataFrame:
    """rows with calibrated: a logistic curve of the logit."""
    assemble = VectorAssembler(inputCols=["__l"], outputCol="__x")
    model = LogisticRegression(featuresCol="__x", labelCol="y_true", regParam=0.0).fit(assemble.transform(train.withColumn("__l", _logit(F.col("y_prob")))))
    return rows.withColumn("calibrated", sigmoid(model.coefficients[0] * _logit(F.col("y_prob")) + model.intercept))


def isotonic(train: DataFrame, rows: DataFrame) -> DataFrame:
    """rows with calibrated: a monotone step function of the probability."""
    model = IsotonicRegression(featuresCol="y_prob", labelCol="y_true").fit(train.select("y_prob", F.col("y_true").cast("double")))
    return model.transform(rows).withColumnRenamed("prediction", "calibrated")


def compare_calibration(rows: DataFrame, train: Column) -> DataFrame:
    """(method, brier, ece) on the rows that are not in train; the first row is the choice."""
    a, b = rows.filter(train), rows.filter(~train)
    out = []
    for name, made in (("none", b.withColumn("calibrated", F.col("y_prob"))), ("platt", platt(a, b)), ("isotonic", isotonic(a, b))):
        made = made.drop("y_prob").withColumnRenamed("calibrated", "y_prob").withColumn("method", F.lit(name))
        square = (F.col("y_prob") - F.col("y_true")) * (F.col("y_prob") - F.col("y_true"))
        out.append(made.groupBy("method").agg(F.avg(square).alias("brier")).join(V.calibration_errors(made, ("method",)), "method"))
    return reduce(DataFrame.unionByName, out).orderBy("brier")


def calibrated_report(rows: DataFrame, gap: int = GAP + 12, least_train: int = 300) -> DataFrame:
    """(method, part, brier, ece, mce): calibrators of a model of the first rows, fitted on a purged stretch behind them and tried on the last, which neither has seen.

    The last 15 % of the rows (50 at least) are the test, as many before them, gap rows apart, calibrate; ValueError if
    under least_train are left to train on. part is calib or test; the choice is the method of the least ece on calib.
    """
    rows = settled(rows)
    n = rows.count()
    size = max(int(n * 0.15), 50)
    test, calib = n - size, n - size - gap - size
    if calib - gap < least_train:
        raise ValueError(f"{n} rows are too few to train on {least_train}, calibrate and test")
    scores = _scored(between(rows, 0, calib - gap), between(rows, calib, n).filter((F.col("row_idx") < calib + size) | (F.col("row_idx") >= test)), "logreg")
    scores = settled(scores.select("row_idx", "y_true", "y_prob"))
    a = scores.filter(F.col("row_idx") < test)
    made = [f(a, scores).select("row_idx", "y_true", F.col("calibrated").alias("y_prob"), F.lit(name).alias("method")) for name, f in (("platt", platt), ("isotonic", isotonic))]
    every = reduce(DataFrame.unionByName, [scores.withColumn("method", F.lit("none")), *made]).withColumn("part", F.when(F.col("row_idx") < test, "calib").otherwise("test"))
    square = (F.col("y_prob") - F.col("y_true")) * (F.col("y_prob") - F.col("y_true"))
    return every.groupBy("method", "part").agg(F.avg(square).alias("brier")).join(V.calibration_errors(every, ("method", "part")), ["method", "part"])


# --- meta-labels, regimes ---------------------------------------------------------------------------------------------------


def with_primary(rows: DataFrame) -> DataFrame:
    """Rows where the rules have an opinion, with it as primary; y_true: whether it was right."""
    primary = G.heuristic(F.col("log_p_sma50"), F.col("rsi_14_c"), F.col("bb_bandwidth"))
    return rows.withColumn("primary", primary).filter("primary >= 0").withColumn("y_true", X.meta_target(F.col("primary"), F.col("realised_return")))


def meta_labelling(rows: DataFrame, threshold: float = 0.55, cost_bps: float = 5.0, n_splits: int = 5, min_train: int = 500) -> DataFrame:
    """A row for each purged fold: precision, recall and f1 of a second model that judges the rules' calls, net return and number of all calls and of those it passes, and their share.

    Folds are of all rows; those with under 50 opinions to train on, under 20 to test, or one class are left out.
    """
    rows = settled(rows)
    folds, calls = V.walk_forward(rows.count(), n_splits=n_splits, min_train=min_train), settled(with_primary(rows))

    def one(k, a, b, lo, hi):
        train, test = between(calls, a, b), between(calls, lo, hi)
        if train.count() < 50 or test.count() < 20:
            return None
        found = _scored(train, test, "logreg", C_META)
        return found and found.select(F.lit(k).alias("fold"), "y_true", "y_pred", "y_prob", "primary", "realised_return")

    found = _each([lambda f=f: one(*f) for f in folds])
    if not found:
        return rows.sparkSession.createDataFrame([], "fold int, precision double, recall double, f1 double, unfiltered_bps double, unfiltered_n long, filtered_bps double, filtered_n long, coverage double")
    scores = settled(reduce(DataFrame.unionByName, found))
    every = V.strategy_bps(scores, cost_bps).select("fold", F.col("net_bps").alias("unfiltered_bps"), F.col("trades").alias("unfiltered_n"))
    passed = V.strategy_bps(scores, cost_bps, F.col("y_prob") >= threshold).select("fold", F.col("net_bps").alias("filtered_bps"), F.col("trades").alias("filtered_n"))
    out = V.precision_recall_f1(scores).select("fold", "precision", "recall", "f1").join(every, "fold").join(passed, "fold")
    return out.withColumn("coverage", F.col("filtered_n") / F.col("unfiltered_n"))


def regime_models(rows: DataFrame, least: int = 60, n_splits: int = 5, min_train: int = 500, params: dict | None = None) -> DataFrame:
    """(regime, fold, n_train, n_test, accuracy) of boosted trees of each regime over purged folds, where a regime has rows enough of both classes."""
    rows = settled(rows.withColumn("regime", X.regime(F.col("adx_norm") * 100)))
    folds = V.walk_forward(rows.count(), n_splits=n_splits, min_train=min_train)

    def one(name, k, a, b, lo, hi):
        own = rows.filter(F.col("regime") == name)
        train, test = between(own, a, b), between(own, lo, hi)
        n = train.count()
        if n < least or test.isEmpty():
            return None
        found = _scored(train, test, "gbm", params=params)
        return found and found.select(F.lit(name).alias("regime"), F.lit(k).alias("fold"), F.lit(n).cast("long").alias("n_train"), (F.col("y_pred") == F.col("y_true")).cast("double").alias("right"))

    found = _each([lambda f=f, r=r: one(r, *f) for f in folds for r in ("trending", "ranging")])
    if not found:
        return rows.sparkSession.createDataFrame([], "regime string, fold int, n_train long, n_test long, accuracy double")
    return reduce(DataFrame.unionByName, found).groupBy("regime", "fold", "n_train").agg(F.count("*").alias("n_test"), F.avg("right").alias("accuracy"))


# --- selection and search ---------------------------------------------------------------------------------------------------


def top_features(rows: DataFrame, k: int = 20, neighbours: int = 3) -> DataFrame:
    """(feature, mi): the k features with the most mutual information with the label, from nearest neighbours."""
    pairs = ", ".join(f"'{n}', {n}" for n in X.FEATURE_NAMES)
    long = rows.select(F.col("y_true").alias("label"), F.expr(f"stack({len(X.FEATURE_NAMES)}, {pairs}) AS (feature, value)"))
    return mutual_information(long, neighbours).orderBy(F.desc("mi"), "feature").limit(k)


#: The searched parameters of a boosted model, and those of a logistic one.
BOOSTED_SPACE = {"maxDepth": S.Choice((3, 4, 5, 6)), "maxIter": S.Choice((100, 200, 300)), "stepSize": S.Uniform(0.01, 0.2, log=True), "subsamplingRate": S.Uniform(0.6, 1.0)}
LOGISTIC_SPACE = {"c": S.Uniform(0.001, 10.0, log=True), "elastic": S.Uniform(0.0, 1.0)}


#: Steps of a fit inside the search; rows of a partition of what it fits and scores, so that a step is a handful of tasks.
SEARCH_STEPS, FOLD_PART = 25, 100_000


def tune(rows: DataFrame, space: dict | None = None, kind: str = "logreg", evaluations: int = 50, n_splits: int = 5, min_train: int = 500, seed: int = 0, together: int = 2 * TOGETHER) -> DataFrame:
    """The trial log of a sequential search, best first: the loss is the negative of the mean accuracy over purged folds; folds of one class don't count.

    The folds' rows and the sums of their weights are kept, not made once a trial; they are written first, so a lost part is read again. Without any fold that counts the loss is 1.
    """
    space = space or (BOOSTED_SPACE if kind == "gbm" else LOGISTIC_SPACE)
    rows = settled(rows.select("row_idx", "y_true", "weight", "features"))
    folds = V.walk_forward(rows.count(), n_splits=n_splits, min_train=min_train)
    kept = lambda part, n: settled(part.coalesce(max(1, -(-n // FOLD_PART)))).persist()  # written, so that a trial's plans are short
    pairs = [(kept(_balanced(between(rows, a, b)), b - a), kept(between(rows, lo, hi), hi - lo)) for _, a, b, lo, hi in folds]
    counted = [(train, test, {} if kind == "gbm" else {"steps": SEARCH_STEPS, "total": train.agg(F.sum("w")).first()[0]}) for train, test in pairs if _both_classes(train)]

    def loss(params: dict) -> float:
        own, c = dict(params), params.get("c", C_DIRECTION)
        own.pop("c", None)
        right = [_fit(train, kind, c, own | fixed).transform(test).agg(F.avg((F.col("prediction") == F.col("y_true")).cast("double"))).first()[0] for train, test, fixed in counted]
        return -float(np.mean(right)) if right else 1.0

    try:
        trials = S.minimise(loss, space, evaluations, seed, together)
    finally:
        for kept_rows in [df for pair in pairs for df in pair]:
            kept_rows.unpersist()
    return S.trial_log(rows.sparkSession, trials, space)


def leakage_demo(rows: DataFrame, n_splits: int = 5, min_train: int = 500) -> DataFrame:
    """(scheme, accuracy, base_rate, edge, auc) of one model by four ways to split: folds shuffled over time and a random fifth, which leak overlapping labels; the last fifth without a purge; purged walk-forward folds."""
    rows = settled(rows)
    n = rows.count()
    part = lambda k, salt: F.pmod(F.xxhash64("symbol", "idx", F.lit(salt)), F.lit(k))
    cut = int(n * 0.8)
    pairs = [("shuffled", part(n_splits, 1) != k, part(n_splits, 1) == k) for k in range(n_splits)]
    pairs += [("random split", part(5, 2) != 0, part(5, 2) == 0), ("chronological", F.col("row_idx") < cut, F.col("row_idx") >= cut)]
    pairs += [("purged", (F.col("row_idx") >= a) & (F.col("row_idx") < b), (F.col("row_idx") >= lo) & (F.col("row_idx") < hi)) for _, a, b, lo, hi in V.walk_forward(n, n_splits=n_splits, horizon=24, min_train=min_train)]

    def one(scheme, train, test):
        found = _scored(rows.filter(train).withColumn("weight", F.lit(1.0)), rows.filter(test), "logreg")
        return found and found.select(F.lit(scheme).alias("scheme"), "row_idx", "y_true", "y_pred", "y_prob", F.col("realised_return").alias("fwd_ret"))

    scores = reduce(DataFrame.unionByName, _each([lambda p=p: one(*p) for p in pairs]))
    return V.class_metrics(scores, by=("scheme",)).select("scheme", "accuracy", "base_rate", "edge", "auc")


# --- volatility ---------------------------------------------------------------------------------------------------------------


def fit_har(design: DataFrame, holdout: float = 0.2) -> DataFrame:
    """(symbol, intercept, short, medium, long, qlike): ordinary least squares on each symbol's first rows, all but the last int(n * holdout).

    The normal equations of all symbols are summed in one aggregate; a 4 x 4 system is left for each.
    """
    names, x = ["intercept", "short", "medium", "long"], [F.lit(1.0), F.col("rv_short"), F.col("rv_medium"), F.col("rv_long")]
    rows = ranked(design.dropna(subset=["rv_short", "rv_medium", "rv_long", "rv_target"]), ["symbol"], ["open_time"], "__at")
    sizes = rows.groupBy("symbol").agg(F.max("__at").alias("__n"))
    rows = rows.join(sizes, "symbol").withColumn("__fit", F.col("__at") <= F.col("__n") - F.floor(F.col("__n") * holdout))
    sums = [F.sum(a * b) for a in x for b in x] + [F.sum(a * F.col("rv_target")) for a in x]
    equations = rows.filter("__fit").groupBy("symbol").agg(F.array(*sums).alias("s"))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [np.linalg.lstsq(np.reshape(s[:16], (4, 4)), s[16:], rcond=None)[0] for s in batch["s"]]
            yield pd.DataFrame(np.reshape(found, (-1, 4)), columns=names).assign(symbol=batch["symbol"].to_numpy())

    fitted = equations.mapInPandas(solve, "symbol string, intercept double, short double, medium double, long double")
    test = rows.filter("NOT __fit").join(fitted, "symbol")
    forecast = sum((F.col(n) * v for n, v in zip(names, x)), F.lit(0.0))
    return test.groupBy("symbol", *names).agg(V.qlike(F.col("rv_target"), F.greatest(forecast, F.lit(1e-12))).alias("qlike"))


def garch_volatility(bars: DataFrame, holdout: float = 0.2) -> DataFrame:
    """(symbol, open_time, garch_vol, qlike): conditional volatility of a GARCH(1,1) of each symbol's returns, fitted before the hold-out, and its loss there.

    A symbol's returns, one number a bar, are one group: its likelihood is that of the whole path.
    """
    returns = bars.withColumn("r", W.log_return(F.col("close"))).filter("r IS NOT NULL").select("symbol", "open_time", "r")

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("open_time")
        if len(group) <= 50:
            return group.assign(garch_vol=float("nan"), qlike=float("nan"))[["symbol", "open_time", "garch_vol", "qlike"]]
        r = group["r"].to_numpy(float)
        _, vol = fit_garch(r, holdout)
        return group.assign(garch_vol=vol, qlike=held_out_qlike(r, vol, holdout))[["symbol", "open_time", "garch_vol", "qlike"]]

    return returns.groupBy("symbol").applyInPandas(one, f"symbol string, open_time {bars.schema['open_time'].dataType.simpleString()}, garch_vol double, qlike double")


# --- export -------------------------------------------------------------------------------------------------------------------


def top_coefficients(model, k: int = 12) -> list[tuple[str, float]]:
    """The k features of the greatest absolute weight in a fitted logistic model."""
    return sorted(zip(X.FEATURE_NAMES, map(float, model.coefficients)), key=lambda p: -abs(p[1]))[:k]


#: Verdicts that allow an export.
EXPORTABLE = ("PROMISING", "WEAK", "EDGE_NO_PROFIT")


def train_moments(train: DataFrame) -> tuple[list[float], list[float]]:
    """Means and population deviations of FEATURE_NAMES over the rows that a model is fitted on; a deviation under 1e-12 counts as 1."""
    row = train.agg(*(F.avg(n).alias(f"m_{n}") for n in X.FEATURE_NAMES), *(F.stddev_pop(n).alias(f"s_{n}") for n in X.FEATURE_NAMES)).first()
    return [float(row[f"m_{n}"]) for n in X.FEATURE_NAMES], [float(row[f"s_{n}"]) if row[f"s_{n}"] >= 1e-12 else 1.0 for n in X.FEATURE_NAMES]


def export_logistic(model, path: str, verdict: str, meta: dict | None = None, moments: tuple[list[float], list[float]] | None = None) -> dict:
    """Write a logistic model over FEATURE_NAMES as JSON; refused unless the verdict allows it.

    moments: train_moments() of its rows; the coefficients are then those of standardised features, of the same probabilities.
    """
    if verdict not in EXPORTABLE:
        raise ValueError(f"a model with verdict {verdict} is not exported")
    mean, scale = moments or ([0.0] * len(X.FEATURE_NAMES), [1.0] * len(X.FEATURE_NAMES))
    coef = [float(c) for c in model.coefficients]
    intercept = float(model.intercept) + sum(c * m for c, m in zip(coef, mean))
    artifact = {"schema_version": 1, "kind": "logistic", "feature_names": list(X.FEATURE_NAMES), "n_features": len(X.FEATURE_NAMES), "mean": list(mean), "scale": list(scale), "coef": [c * s for c, s in zip(coef, scale)], "intercept": intercept, "meta": {**(meta or {}), "verdict": verdict}}
    with open(path, "w") as f:
        json.dump(artifact, f)
    return artifact


def export_meta_model(rows: DataFrame, path: str, meta: dict | None = None, threshold: float = 0.55) -> dict:
    """Fit the model that judges the rules' calls on all rows where they have an opinion, and write it as JSON, marked as a meta-label model with its threshold."""
    calls = _balanced(with_primary(rows))
    artifact = export_logistic(_logistic(calls, C_META), path, EXPORTABLE[0], {**(meta or {}), "mode": "meta_label", "meta_label_threshold": threshold}, train_moments(calls))
    artifact["schema_version"] = 2
    artifact["meta"].pop("verdict")
    with open(path, "w") as f:
        json.dump(artifact, f)
    return artifact


def load_logistic(artifact: dict) -> dict:
    """A checked artifact: kind, names in order, lengths."""
    if artifact.get("kind") == "absent":
        return artifact
    n = len(X.FEATURE_NAMES)
    if artifact.get("feature_names") != list(X.FEATURE_NAMES) or any(len(artifact.get(k, ())) != n for k in ("mean", "scale", "coef")):
        raise ValueError("the model does not fit the features")
    return artifact


def predict_proba(artifact: dict) -> Column:
    """The probability by an artifact as one column expression; NULL if a feature is."""
    z = F.lit(artifact["intercept"])
    for n, m, s, c in zip(artifact["feature_names"], artifact["mean"], artifact["scale"], artifact["coef"]):
        z = z + (F.col(n) - m) / s * c
    return sigmoid(z)


def opinion(p: Column, mode: str = "direction", primary: Column | None = None, threshold: float = 0.55) -> Column:
    """struct(signal, confidence) of a probability: of going up, or of the primary call being right."""
    if mode == "meta_label":
        sure = (p >= threshold) & primary.isNotNull()
        return F.struct(F.when(sure, primary).otherwise("NEUTRAL").alias("signal"), F.round(p * 100).cast("int").alias("confidence"))
    return F.struct(F.when(p >= 0.5, "UP").otherwise("DOWN").alias("signal"), F.round(F.abs(p - 0.5) * 200).cast("int").alias("confidence"))
