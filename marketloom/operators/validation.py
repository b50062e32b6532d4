"""Validation: purged splits as ranges, metrics by fold, calibration, Sharpe corrections, overfitting, volatility."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marketloom.functions import windows as W
from marketloom.functions.scalars import norm_cdf, norm_ppf
from marketloom.operators.ranks import ranked
from marketloom.sources.bars import by_symbol

# --- splits: a table of ranges, joined by predicate; folds are few, so it is broadcast -----------------------------------


def walk_forward(n: int, n_splits: int = 5, horizon: int = 12, embargo: int = 6, min_train: int = 500, expanding: bool = True, least_test: int = 20) -> list[tuple[int, int, int, int, int]]:
    """(fold, train_lo, train_hi, test_lo, test_hi), ends exclusive.

    With g = horizon + embargo, what min_train and g leave of the n rows is dealt into n_splits tests of equal length
    t. Fold k tests rows from min_train + g + k * t; it trains on the rows up to g before them, or only the last
    min_train of those. Raises ValueError where t would be under least_test or under 1.
    """
    purged = horizon + embargo
    t = (n - min_train - purged) // n_splits
    if t < max(1, least_test):
        raise ValueError(f"{n_splits} tests of {least_test} rows, after {min_train} to train on and {purged} purged, need more than {n} rows")
    ends = range(min_train, min_train + n_splits * t, t)
    return [(fold, 0 if expanding else end - min_train, end, end + purged, end + purged + t) for fold, end in enumerate(ends)]


def combinatorial(n: int, n_groups: int = 6, n_test: int = 2, horizon: int = 12, embargo: int = 6) -> list[tuple[int, str, int, int]]:
    """(fold, role, lo, hi): every choice of n_test of n_groups blocks; train ranges keep horizon + embargo rows from every test block."""
    if n_test >= n_groups:
        raise ValueError("n_test must be less than n_groups")
    gap, out = horizon + embargo, []
    bounds = [n * i // n_groups for i in range(n_groups + 1)]
    for fold, chosen in enumerate(combinations(range(n_groups), n_test)):
        out += [(fold, "test", bounds[g], bounds[g + 1]) for g in chosen]
        for g in sorted(set(range(n_groups)) - set(chosen)):
            pieces = [(bounds[g], bounds[g + 1])]
            for t in chosen:
                lo, hi = bounds[t] - gap, bounds[t + 1] + gap
                pieces = [p for a, b in pieces for p in ((a, min(b, lo)), (max(a, hi), b)) if p[0] < p[1]]
            out += [(fold, "train", a, b) for a, b in pieces]
    return out


def fold_ranges(spark: SparkSession, folds: list[tuple[int, int, int, int, int]]) -> DataFrame:
    rows = [(k, role, lo, hi) for k, a, b, c, d in folds for role, lo, hi in (("train", a, b), ("test", c, d))]
    return spark.createDataFrame(rows, "fold int, role string, lo long, hi long")


def assign(rows: DataFrame, ranges: DataFrame, idx: str = "row_idx") -> DataFrame:
    """rows once for each fold and role that has them."""
    return rows.join(F.broadcast(ranges), (F.col(idx) >= F.col("lo")) & (F.col(idx) < F.col("hi"))).drop("lo", "hi")


def pooled_train(rows: DataFrame, symbol: str, train_end: int, sibling_cutoff: int | None = None) -> DataFrame:
    """A symbol's rows before train_end with all rows of the others (before sibling_cutoff if given)."""
    others = F.col("symbol") != symbol
    if sibling_cutoff is not None:
        others = others & (F.col("idx") < sibling_cutoff)
    return rows.filter(((F.col("symbol") == symbol) & (F.col("idx") < train_end)) | others)


def standardise(rows: DataFrame, names: list[str], train: Column, by: str = "fold") -> DataFrame:
    """names scaled by the mean and population deviation of the train rows of each fold; a deviation under 1e-12 counts as 1."""
    fit = rows.filter(train).groupBy(by).agg(*(f(n).alias(f"__{k}_{n}") for n in names for k, f in (("m", F.avg), ("s", F.stddev_pop))))
    out = rows.join(F.broadcast(fit), by)
    for n in names:
        s = F.when(F.col(f"__s_{n}") < 1e-12, 1.0).otherwise(F.col(f"__s_{n}"))
        out = out.withColumn(n, (F.col(n) - F.col(f"__m_{n}")) / s)
    return out.drop(*(c for n in names for c in (f"__m_{n}", f"__s_{n}")))


# --- metrics of scored(fold, y_true, y_pred, y_prob, fwd_ret, key) ------------------------------------------------------


def auc(rows: DataFrame, by=("fold",), key: str = "row_idx") -> DataFrame:
    """Rank-sum AUC; equal probabilities rank by key. Ranks are found by ranges: no task has all rows of a group."""
    placed = ranked(rows.select(*by, "y_true", "y_prob", key), list(by), ["y_prob", key], "__r")
    pos, neg = F.count_if(F.col("y_true") == 1), F.count_if(F.col("y_true") == 0)
    s = F.sum(F.when(F.col("y_true") == 1, F.col("__r")))
    return placed.groupBy(*by).agg(F.when((pos > 0) & (neg > 0), (s - pos * (pos + 1) / 2) / F.when((pos > 0) & (neg > 0), pos * neg)).alias("auc"))


def class_metrics(rows: DataFrame, by=("fold",), cost_bps: float = 0.0, key: str = "row_idx") -> DataFrame:
    """All classification and money metrics of each group, one row each."""
    correct = (F.col("y_pred") == F.col("y_true")).cast("double")
    gross = F.when(F.col("y_pred") == 1, 1.0).otherwise(-1.0) * F.col("fwd_ret")
    net = gross - cost_bps / 10000
    base = rows.withColumn("__c", correct).withColumn("__g", gross).withColumn("__n", net).withColumn("__sure", -F.abs(F.col("y_prob") - 0.5))
    base = ranked(base, list(by), ["__sure", key], "__k").join(rows.groupBy(*by).agg(F.count("*").alias("__all")), list(by))
    top = F.when((F.col("__all") >= 20) & (F.col("__k") <= F.greatest(F.lit(1), F.floor(F.col("__all") / 10))), F.col("__c"))
    sd = F.stddev_pop("__n")
    out = base.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg("__c").alias("accuracy"), F.avg(F.col("y_true").cast("double")).alias("up_rate"),
        F.avg(F.when(F.col("y_true") == 1, F.col("__c"))).alias("recall_up"), F.avg(F.when(F.col("y_true") == 0, F.col("__c"))).alias("recall_down"),
        F.avg((F.col("y_pred") == 1).cast("double")).alias("pred_up_rate"), F.avg((F.col("y_prob") - F.col("y_true")) * (F.col("y_prob") - F.col("y_true"))).alias("brier"),
        F.avg(top).alias("top_decile_acc"), (F.avg("__g") * 10000).alias("gross_bps"), (F.avg("__n") * 10000).alias("net_bps"),
        F.avg((F.col("__n") > 0).cast("double")).alias("hit_rate_money"), F.when(sd > 0, F.avg("__n") / F.when(sd > 0, sd)).alias("sharpe_per_trade"),
    )
    out = out.withColumn("base_rate", F.greatest("up_rate", 1 - F.col("up_rate"))).withColumn("edge", F.col("accuracy") - F.col("base_rate"))
    return out.join(auc(rows, by, key), list(by))


def aggregate_folds(metrics: DataFrame, names: list[str], by: str = "model") -> DataFrame:
    """(by, metric, mean, std) over the folds that have a finite value."""
    pairs = ", ".join(f"'{n}', {n}" for n in names)
    long = metrics.select(by, F.expr(f"stack({len(names)}, {pairs}) AS (metric, value)"))
    return long.filter(F.col("value").isNotNull() & ~F.isnan("value")).groupBy(by, "metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def verdict(edge: Column, edge_std: Column, positive: Column, net: Column, n_folds: Column) -> Column:
    consistent = positive >= F.greatest(F.lit(2), F.ceil(n_folds * 0.8))
    return (
        F.when(edge.isNull(), "UNKNOWN").when(edge <= 0, "NO_EDGE").when(~consistent, "NOISE")
        .when(~F.coalesce((edge_std > 0) & (edge > 2 * edge_std), F.lit(False)), "WEAK").when(~F.coalesce(net > 0, F.lit(False)), "EDGE_NO_PROFIT").otherwise("PROMISING")
    )


# --- calibration: bins are (lo, hi], the first closed -------------------------------------------------------------------


def probability_bin(p: Column, n: int = 10) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), F.ceil(p * n).cast("int") - 1))


def reliability(rows: DataFrame, by=(), n: int = 10) -> DataFrame:
    """Each bin that has rows: bin, lo, hi, n, mean_predicted, observed_freq."""
    binned = rows.withColumn("bin", probability_bin(F.col("y_prob"), n))
    out = binned.groupBy(*by, "bin").agg(F.count("*").alias("n"), F.avg("y_prob").alias("mean_predicted"), F.avg(F.col("y_true").cast("double")).alias("observed_freq"))
    return out.withColumn("lo", F.col("bin") / n).withColumn("hi", (F.col("bin") + 1) / n)


def calibration_errors(rows: DataFrame, by=("fold",), n: int = 10) -> DataFrame:
    """ece and mce of each group."""
    gap = F.abs(F.col("mean_predicted") - F.col("observed_freq"))
    return reliability(rows, by, n).groupBy(*by).agg((F.sum(F.col("n") * gap) / F.sum("n")).alias("ece"), F.max(gap).alias("mce"))


def brier_decomposition(rows: DataFrame, by=("fold",), n: int = 10) -> DataFrame:
    """reliability, resolution, uncertainty of each group."""
    t = reliability(rows, by, n).withColumn("obar", F.sum(F.col("n") * F.col("observed_freq")).over(Window.partitionBy(*by)) / F.sum("n").over(Window.partitionBy(*by)))
    square = lambda x: x * x
    return t.groupBy(*by).agg(
        (F.sum(F.col("n") * square(F.col("mean_predicted") - F.col("observed_freq"))) / F.sum("n")).alias("reliability"),
        (F.sum(F.col("n") * square(F.col("observed_freq") - F.col("obar"))) / F.sum("n")).alias("resolution"),
        F.max(F.col("obar") * (1 - F.col("obar"))).alias("uncertainty"),
    )


def precision_recall_f1(rows: DataFrame, by=("fold",)) -> DataFrame:
    t, p = F.col("y_true") == 1, F.col("y_pred") == 1
    out = rows.groupBy(*by).agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"))
    out = out.withColumn("precision", F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp"))).withColumn("recall", F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn")))
    return out.withColumn("f1", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def strategy_bps(rows: DataFrame, cost_bps: float, mask: Column | None = None, by=("fold",)) -> DataFrame:
    """Mean net return and number of trades of following primary where it has an opinion (and mask)."""
    trade = F.col("primary") >= 0
    trade = trade if mask is None else trade & mask
    net = F.when(F.col("primary") == 1, 1.0).otherwise(-1.0) * F.col("realised_return") - cost_bps / 10000
    return rows.groupBy(*by).agg((F.avg(F.when(trade, net)) * 10000).alias("net_bps"), F.count_if(trade).alias("trades"))


# --- Sharpe ratios and overfitting --------------------------------------------------------------------------------------


def moments(x: Column) -> tuple[Column, Column]:
    """Population skewness and non-excess kurtosis; (0, 3) of fewer than 3 values or a constant."""
    ok = (F.count(x) >= 3) & (F.stddev_pop(x) > 0)
    return F.when(ok, F.skewness(x)).otherwise(0.0), F.when(ok, F.kurtosis(x) + 3).otherwise(3.0)


def sharpe(x: Column) -> Column:
    sd = F.stddev_pop(x)
    return F.when((F.count(x) >= 2) & (sd > 0), F.avg(x) / F.when(sd > 0, sd)).otherwise(0.0)


def expected_max_sharpe(n_trials: Column, sharpe_std: Column) -> Column:
    """Of trials without skill, from their number and the sample deviation of their Sharpe ratios."""
    euler = 0.5772156649015329
    t = n_trials.cast("double")
    best = (1 - euler) * norm_ppf(1 - 1 / t) + euler * norm_ppf(1 - 1 / (t * math.e))
    return F.when((n_trials > 1) & (sharpe_std > 0), sharpe_std * best).otherwise(0.0)


def sharpe_z(observed: Column, n_obs: Column, benchmark: Column, skew: Column, kurt: Column) -> Column:
    """The z whose normal probability is the deflated Sharpe ratio."""
    spread = 1 - skew * observed + (kurt - 1) / 4 * observed * observed
    ok = (spread > 0) & (n_obs > 1)
    return F.when(ok, (observed - benchmark) / F.sqrt(F.when(ok, spread / (n_obs - 1))))


def deflated_sharpe(observed: Column, n_obs: Column, benchmark: Column, skew: Column, kurt: Column) -> Column:
    return norm_cdf(sharpe_z(observed, n_obs, benchmark, skew, kurt))


def overfitting_splits(perf: DataFrame, periods: list[int]) -> DataFrame:
    """perf(config, period, value): for each half of the periods, the best config there, its rank on the other half and the logit.

    An odd number of periods drops the oldest. Configs and periods are few; the halves are a broadcast table.
    Raises ValueError for fewer than 4 periods.
    """
    if len(periods) < 4:
        raise ValueError("fewer than 4 periods have no halves to compare")
    periods = sorted(periods)[len(periods) % 2 :]
    halves = [(s, p, p in chosen) for s, chosen in enumerate(combinations(periods, len(periods) // 2)) for p in periods]
    table = perf.sparkSession.createDataFrame(halves, "split int, period int, inside boolean")
    means = perf.join(F.broadcast(table), "period").groupBy("split", "config").agg(F.avg(F.when(F.col("inside"), F.col("value"))).alias("is_mean"), F.avg(F.when(~F.col("inside"), F.col("value"))).alias("oos_mean"))
    best = Window.partitionBy("split").orderBy(F.desc("is_mean"), "config")
    ranked = means.withColumn("b", F.row_number().over(best)).withColumn("r", F.row_number().over(Window.partitionBy("split").orderBy("oos_mean", "config"))).withColumn("n", F.count("*").over(Window.partitionBy("split")))
    share = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("r") / (F.col("n") + 1)))
    return ranked.filter("b = 1").select("split", "config", F.col("r").alias("oos_rank"), F.ln(share / (1 - share)).alias("logit"))


def overfitting_probability(splits: DataFrame) -> DataFrame:
    return splits.agg(F.avg((F.col("logit") <= 0).cast("double")).alias("pbo"), F.count("*").alias("n_splits"))


# --- volatility ---------------------------------------------------------------------------------------------------------


def har_design(bars: DataFrame, short: int = 48, medium: int = 288, long: int = 1440) -> DataFrame:
    """bars with rv_short, rv_medium, rv_long up to each bar and rv_target over the next short bars."""
    r = F.coalesce(W.log_return(F.col("close")), F.lit(0.0))
    rows = bars.withColumn("__r2", r * r).withColumn("rv_short", W.total(F.col("__r2"), short))
    rv = F.col("rv_short")
    return rows.withColumns({"rv_medium": W.mean(rv, max(2, medium // short)), "rv_long": W.mean(rv, max(2, long // short)), "rv_target": F.lead(rv, short).over(by_symbol())}).drop("__r2")


def qlike(actual: Column, forecast: Column) -> Column:
    ok = (actual > 0) & (forecast > 0)
    ratio = F.when(ok, actual / F.when(ok, forecast))
    return F.avg(ratio - F.ln(ratio) - 1)


def volatility_expansion(rows: DataFrame, sigma: str, lookback: int = 48, percent: float = 0.3, k: int = 6) -> DataFrame:
    """rows(symbol, open_time, idx, sigma) with expanding: at or under the trailing percentile and rising."""
    s, order = F.col(sigma), by_symbol()
    before = order.rowsBetween(-lookback, -1)
    low = s <= F.percentile(s, percent).over(before)
    recent, prior = order.rowsBetween(-k + 1, 0), order.rowsBetween(-2 * k + 1, -k)
    whole = (F.count(s).over(recent) == k) & (F.count(s).over(prior) == k) & (F.count(s).over(before) >= lookback // 2)
    return rows.withColumn("expanding", F.coalesce((F.col("idx") >= max(lookback, 2 * k)) & s.isNotNull() & whole & low & (F.avg(s).over(recent) > F.avg(s).over(prior)), F.lit(False)))
