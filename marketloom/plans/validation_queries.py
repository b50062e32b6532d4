"""Queries of splits, metrics, calibration, Sharpe corrections, sizes and volatility."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from marketloom.functions import scalars as S
from marketloom.functions import windows as WN
from marketloom.operators import joins as J
from marketloom.operators import models as M
from marketloom.operators import validation as V
from marketloom.plans.demo import BARS, SCORED, W, bars, full, r6, rr, scored
from marketloom.plans.registry import query

BIN = "CAST(greatest(0, least(9, ceil(y_prob * 10) - 1)) AS INTEGER)"
REL = f"{SCORED}, rel AS (SELECT fold, {BIN} AS bin, count(*) AS n, avg(y_prob) AS mp, avg(y_true::DOUBLE) AS ob FROM s GROUP BY ALL)"


@query("probability_reliability", f"WITH {SCORED} SELECT {BIN} AS bin, count(*) AS n, {rr('avg(y_prob)', 'mean_predicted')}, {rr('avg(y_true::DOUBLE)', 'observed_freq')} FROM s GROUP BY 1")
def probability_reliability(spark, d):
    return V.reliability(scored(spark, d)).select("bin", "n", r6("mean_predicted"), r6("observed_freq"))


@query("ece_mce", f"WITH {REL} SELECT fold, {rr('sum(n * abs(mp - ob)) / sum(n)', 'ece')}, {rr('max(abs(mp - ob))', 'mce')} FROM rel GROUP BY fold")
def ece_mce(spark, d):
    return V.calibration_errors(scored(spark, d)).select("fold", r6("ece"), r6("mce"))


@query("brier_bins", f"WITH {REL}, o AS (SELECT *, sum(n * ob) OVER f / sum(n) OVER f AS obar FROM rel WINDOW f AS (PARTITION BY fold)) SELECT fold, {rr('sum(n * (mp - ob) * (mp - ob)) / sum(n)', 'reliability')}, {rr('sum(n * (ob - obar) * (ob - obar)) / sum(n)', 'resolution')}, {rr('max(obar * (1 - obar))', 'uncertainty')} FROM o GROUP BY fold")
def brier_bins(spark, d):
    return V.brier_decomposition(scored(spark, d)).select("fold", r6("reliability"), r6("resolution"), r6("uncertainty"))


_AUC = "a0 AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY y_prob, row_idx) AS rk FROM s), au AS (SELECT fold, CASE WHEN count(*) FILTER (y_true = 1) > 0 AND count(*) FILTER (y_true = 0) > 0 THEN (sum(rk) FILTER (y_true = 1) - count(*) FILTER (y_true = 1) * (count(*) FILTER (y_true = 1) + 1) / 2) / (count(*) FILTER (y_true = 1) * count(*) FILTER (y_true = 0)) END AS auc FROM a0 GROUP BY fold)"


@query("auc_rank", f"WITH {SCORED}, {_AUC} SELECT fold, {rr('auc', 'auc')} FROM au")
def auc_rank(spark, d):
    return V.auc(scored(spark, d)).select("fold", r6("auc"))


_METRICS = """m0 AS (SELECT *, (y_pred = y_true)::INT::DOUBLE AS c, CASE WHEN y_pred = 1 THEN 1.0::DOUBLE ELSE -1.0 END * fwd_ret AS g, row_number() OVER (PARTITION BY fold ORDER BY abs(y_prob - 0.5) DESC, row_idx) AS k, count(*) OVER (PARTITION BY fold) AS nn FROM s),
m AS (SELECT fold, count(*) AS n, avg(c) AS accuracy, avg(y_true::DOUBLE) AS up_rate, avg(c) FILTER (y_true = 1) AS recall_up, avg(c) FILTER (y_true = 0) AS recall_down, avg((y_pred = 1)::INT::DOUBLE) AS pred_up_rate, avg((y_prob - y_true) * (y_prob - y_true)) AS brier,
  avg(c) FILTER (nn >= 20 AND k <= greatest(1, nn // 10)) AS top_decile_acc, avg(g) * 10000 AS gross_bps, avg(g - 0.0005) * 10000 AS net_bps, avg((g - 0.0005 > 0)::INT::DOUBLE) AS hit_rate_money, avg(g - 0.0005) / nullif(stddev_pop(g - 0.0005), 0) AS sharpe_per_trade FROM m0 GROUP BY fold)"""
_NAMES = "accuracy up_rate recall_up recall_down pred_up_rate brier top_decile_acc gross_bps net_bps hit_rate_money sharpe_per_trade".split()


@query("class_metrics", f"WITH {SCORED}, {_METRICS}, {_AUC} SELECT fold, n, {', '.join(rr(c, c) for c in _NAMES)}, {rr('greatest(up_rate, 1 - up_rate)', 'base_rate')}, {rr('accuracy - greatest(up_rate, 1 - up_rate)', 'edge')}, {rr('auc', 'auc')} FROM m JOIN au USING (fold)")
def class_metrics(spark, d):
    return V.class_metrics(scored(spark, d), cost_bps=5.0).select("fold", "n", *(r6(c) for c in [*_NAMES, "base_rate", "edge", "auc"]))


_AGG = f"{SCORED}, {_METRICS}, l AS (UNPIVOT (SELECT fold, accuracy, brier, net_bps, accuracy - greatest(up_rate, 1 - up_rate) AS edge FROM m) ON accuracy, brier, net_bps, edge INTO NAME metric VALUE value)"


@query("fold_aggregate", f"WITH {_AGG} SELECT 'model' AS model, metric, {rr('avg(value)', 'mean')}, {rr('stddev_pop(value)', 'std')} FROM l GROUP BY metric")
def fold_aggregate(spark, d):
    metrics = V.class_metrics(scored(spark, d), cost_bps=5.0).withColumn("model", F.lit("model"))
    return V.aggregate_folds(metrics, ["accuracy", "brier", "net_bps", "edge"]).select("model", "metric", r6("mean"), r6("std"))


_VERDICT = "CASE WHEN e IS NULL THEN 'UNKNOWN' WHEN e <= 0 THEN 'NO_EDGE' WHEN NOT pos >= greatest(2, ceil(n * 0.8)) THEN 'NOISE' WHEN NOT coalesce(sd > 0 AND e > 2 * sd, false) THEN 'WEAK' WHEN NOT coalesce(net > 0, false) THEN 'EDGE_NO_PROFIT' ELSE 'PROMISING' END"


@query("verdict", f"WITH v AS (SELECT o_orderkey AS id, (o_orderkey % 41 - 10)::DOUBLE / 100 AS e, (o_custkey % 10)::DOUBLE / 100 AS sd, o_orderkey % 6 AS pos, (o_custkey % 21 - 10)::DOUBLE AS net, 5 AS n FROM orders) SELECT id, {_VERDICT} AS verdict FROM v")
def verdict(spark, d):
    from marketloom.plans.demo import table

    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, d, "orders").select(k.alias("id"), V.verdict((k % 41 - 10) / 100, (c % 10) / 100, k % 6, (c % 21 - 10).cast("double"), F.lit(5)).alias("verdict"))


@query("precision_recall", f"WITH {SCORED}, c AS (SELECT fold, count(*) FILTER (y_true = 1 AND y_pred = 1) AS tp, count(*) FILTER (y_true = 0 AND y_pred = 1) AS fp, count(*) FILTER (y_true = 1 AND y_pred = 0) AS fn FROM s GROUP BY fold), q AS (SELECT *, tp::DOUBLE / nullif(tp + fp, 0) AS p, tp::DOUBLE / nullif(tp + fn, 0) AS r FROM c) SELECT fold, tp, fp, fn, {rr('p', 'precision')}, {rr('r', 'recall')}, {rr('2 * p * r / nullif(p + r, 0)', 'f1')} FROM q")
def precision_recall(spark, d):
    return V.precision_recall_f1(scored(spark, d)).select("fold", "tp", "fp", "fn", r6("precision"), r6("recall"), r6("f1"))


@query("strategy_bps", f"WITH {SCORED} SELECT fold, {rr('avg(CASE WHEN \"primary\" = 1 THEN 1 ELSE -1 END * fwd_ret - 0.0005::DOUBLE) FILTER (\"primary\" >= 0 AND y_prob >= 0.55) * 10000', 'net_bps')}, count(*) FILTER (\"primary\" >= 0 AND y_prob >= 0.55) AS trades FROM s GROUP BY fold")
def strategy_bps(spark, d):
    rows = scored(spark, d).withColumnRenamed("fwd_ret", "realised_return")
    return V.strategy_bps(rows, 5.0, F.col("y_prob") >= 0.55).select("fold", r6("net_bps"), "trades")


@query("skew_kurt_sharpe", f"WITH {BARS}, r AS (SELECT symbol, ln(close) - lag(ln(close)) OVER ({W}) AS r FROM b), m AS (SELECT symbol, avg(r) AS mu, stddev_pop(r) AS sd FROM r GROUP BY 1) SELECT symbol, {rr('avg(power((r - mu) / sd, 3))', 'skew')}, {rr('avg(power((r - mu) / sd, 4))', 'kurtosis')}, {rr('max(mu / sd)', 'sharpe')} FROM r JOIN m USING (symbol) GROUP BY symbol")
def skew_kurt_sharpe(spark, d):
    rows = bars(spark, d).withColumn("r", WN.log_return(F.col("close")))
    skew, kurt = V.moments(F.col("r"))
    return rows.groupBy("symbol").agg(r6(skew, "skew"), r6(kurt, "kurtosis"), r6(V.sharpe(F.col("r")), "sharpe"))


def _ppf_sql(p: str) -> str:
    def horner(c, x, last=None):
        out = f"({c[0]!r}::DOUBLE)"
        for v in [*c[1:], *([] if last is None else [last])]:
            out = f"({out} * {x} + ({v!r}::DOUBLE))"
        return out

    q = f"sqrt(-2 * ln(CASE WHEN {p} < 0.5 THEN {p} ELSE 1 - {p} END))"
    far, near = f"{horner(S.PPF_C, q)} / {horner(S.PPF_D, q, 1.0)}", f"{horner(S.PPF_A, f'(({p} - 0.5) * ({p} - 0.5))')} * ({p} - 0.5) / {horner(S.PPF_B, f'(({p} - 0.5) * ({p} - 0.5))', 1.0)}"
    return f"CASE WHEN {p} < 0.02425 THEN {far} WHEN {p} > 1 - 0.02425 THEN -({far}) ELSE {near} END"


@query("norm_ppf", f"WITH v AS (SELECT o_orderkey AS id, ((o_orderkey * 7919) % 9999 + 0.5)::DOUBLE / 10000 AS p FROM orders) SELECT id, {rr(_ppf_sql('p'), 'z')} FROM v")
def norm_ppf(spark, d):
    from marketloom.plans.demo import table

    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(k.alias("id"), r6(S.norm_ppf(((k * 7919) % 9999 + 0.5) / 10000), "z"))


@query("expected_max_sharpe", f"WITH {SCORED}, f AS (SELECT fold, avg(fwd_ret) / stddev_pop(fwd_ret) AS sr FROM s GROUP BY fold), g AS (SELECT count(*)::DOUBLE AS n, stddev_samp(sr) AS sd, max(sr) AS best FROM f) SELECT {rr(f'sd * ((1 - 0.5772156649015329) * ({_ppf_sql("(1 - 1 / n)")}) + 0.5772156649015329 * ({_ppf_sql("(1 - 1 / (n * exp(1)))")}))', 'sr0')}, {rr('best', 'best')} FROM g")
def expected_max_sharpe(spark, d):
    by_fold = scored(spark, d).groupBy("fold").agg(V.sharpe(F.col("fwd_ret")).alias("sr"))
    g = by_fold.agg(F.count("*").alias("n"), F.stddev_samp("sr").alias("sd"), F.max("sr").alias("best"))
    return g.select(r6(V.expected_max_sharpe(F.col("n"), F.col("sd")), "sr0"), r6("best"))


def _cdf_sql(x: str) -> str:
    """norm_cdf() of a column of SQL."""
    p, q = ("".join(["("] * (len(c) - 1)) + f"{c[0]!r}::DOUBLE" + "".join(f" * abs({x}) + {v!r}::DOUBLE)" for v in c[1:]) for c in (S.CDF_P, S.CDF_Q))
    fraction = f"abs({x}) + 0.65::DOUBLE"
    for k in (4, 3, 2, 1):
        fraction = f"abs({x}) + {k} / ({fraction})"
    tail = f"exp(-{x} * {x} / 2) * CASE WHEN abs({x}) < {S.CDF_FAR!r} THEN {p} / {q} ELSE 1 / (({fraction}) * sqrt(2 * pi())) END"
    return f"CASE WHEN {x} > 0 THEN 1 - {tail} ELSE {tail} END"


@query("norm_cdf", f"WITH v AS (SELECT o_orderkey AS id, ((o_orderkey * 7919) % 2001 - 1000)::DOUBLE / 100 AS z FROM orders) SELECT id, {rr(_cdf_sql('z'), 'p', 12)} FROM v")
def norm_cdf(spark, d):
    from marketloom.plans.demo import table

    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(k.alias("id"), r6(S.norm_cdf(((k * 7919) % 2001 - 1000) / 100), "p", 12))


_Z = _cdf_sql("z")
_DEFLATED = f"""{SCORED}, f AS (SELECT fold, avg(fwd_ret) AS mu, stddev_pop(fwd_ret) AS sd, count(*) AS n_obs FROM s GROUP BY fold),
h AS (SELECT fold, max(mu / sd) AS sr, max(n_obs) AS n_obs, avg(power((fwd_ret - mu) / sd, 3)) AS skew, avg(power((fwd_ret - mu) / sd, 4)) AS kurt FROM s JOIN f USING (fold) GROUP BY fold),
g AS (SELECT count(*)::DOUBLE AS n, stddev_samp(sr) AS sd FROM h), g0 AS (SELECT sd * ((1 - 0.5772156649015329) * ({_ppf_sql("(1 - 1 / n)")}) + 0.5772156649015329 * ({_ppf_sql("(1 - 1 / (n * exp(1)))")})) AS sr0 FROM g),
z AS (SELECT fold, (sr - sr0) / sqrt((1 - skew * sr + (kurt - 1) / 4 * sr * sr) / (n_obs - 1)) AS z FROM h, g0)"""


@query("deflated_sharpe", f"WITH {_DEFLATED} SELECT fold, {rr(_cdf_sql('z'), 'dsr')} FROM z")
def deflated_sharpe(spark, d):
    rows = scored(spark, d)
    skew, kurt = V.moments(F.col("fwd_ret"))
    by_fold = rows.groupBy("fold").agg(V.sharpe(F.col("fwd_ret")).alias("sr"), F.count("*").alias("n_obs"), skew.alias("skew"), kurt.alias("kurt"))
    g = by_fold.agg(F.count("*").alias("n"), F.stddev_samp("sr").alias("sd"))
    out = by_fold.join(F.broadcast(g))
    sr0 = V.expected_max_sharpe(F.col("n"), F.col("sd"))
    return out.select("fold", r6(V.deflated_sharpe(F.col("sr"), F.col("n_obs"), sr0, F.col("skew"), F.col("kurt")), "dsr"))


def _perf(spark, d):
    return scored(spark, d).withColumn("period", (F.col("row_idx") % 6).cast("int")).groupBy(F.col("fold").alias("config"), "period").agg(F.avg("fwd_ret").alias("value"))


_HALVES = ", ".join(f"({s}, {p}, {str(p in c).lower()})" for s, c in enumerate(combinations(range(6), 3)) for p in range(6))
_PBO = f"""{SCORED}, pf AS (SELECT fold AS config, CAST(row_idx % 6 AS INTEGER) AS period, avg(fwd_ret) AS value FROM s GROUP BY ALL), hv(split, period, inside) AS (VALUES {_HALVES}),
mm AS (SELECT split, config, avg(value) FILTER (inside) AS a, avg(value) FILTER (NOT inside) AS o FROM pf JOIN hv USING (period) GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY a DESC, config) AS bb, row_number() OVER (PARTITION BY split ORDER BY o, config) AS r, count(*) OVER (PARTITION BY split) AS n FROM mm)"""


@query("overfitting_splits", f"WITH {_PBO} SELECT CAST(split AS INTEGER) AS split, config, r AS oos_rank, {rr('ln((r / (n + 1)) / (1 - r / (n + 1)))', 'logit')} FROM rk WHERE bb = 1")
def overfitting_splits(spark, d):
    return V.overfitting_splits(_perf(spark, d), list(range(6))).select("split", "config", F.col("oos_rank").cast("long").alias("oos_rank"), r6("logit"))


@query("overfitting_probability", f"WITH {_PBO} SELECT {rr('avg((ln((r / (n + 1)) / (1 - r / (n + 1))) <= 0)::INT::DOUBLE)', 'pbo')}, count(*) AS n_splits FROM rk WHERE bb = 1")
def overfitting_probability(spark, d):
    return V.overfitting_probability(V.overfitting_splits(_perf(spark, d), list(range(6)))).select(r6("pbo"), "n_splits")


# --- splits -----------------------------------------------------------------------------------------------------------------


#: Folds over all bars of the longest symbol; the same ranges in SQL from the counted rows.
_N = "n AS (SELECT max(idx) + 1 AS n FROM b)"
_WF = f"""{_N}, z AS (SELECT (n - 118) // 4 AS t FROM n), fr AS (SELECT k AS fold, 'train' AS role, 0 AS lo, 100 + k * t AS hi FROM z, range(4) r(k) UNION ALL SELECT k, 'test', 118 + k * t, 118 + (k + 1) * t FROM z, range(4) r(k))"""


def _longest(rows) -> int:
    return rows.agg(F.max("idx")).first()[0] + 1


@query("walk_forward_folds", f"WITH {BARS}, {_WF} SELECT CAST(fold AS INTEGER) AS fold, role, symbol, count(*) AS n, min(idx) AS first_idx, max(idx) AS last_idx FROM b JOIN fr ON idx >= lo AND idx < hi GROUP BY ALL")
def walk_forward_folds(spark, d):
    rows = bars(spark, d)
    rows = V.assign(rows, V.fold_ranges(spark, V.walk_forward(_longest(rows), n_splits=4, min_train=100, least_test=5)), "idx")
    return rows.groupBy("fold", "role", "symbol").agg(F.count("*").alias("n"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"))


@query("combinatorial_folds", f"""WITH {BARS}, {_N}, blk AS (SELECT i AS g, n * i // 6 AS lo, n * (i + 1) // 6 AS hi FROM n, range(6) t(i)), ch AS (SELECT row_number() OVER (ORDER BY x.g, y.g) - 1 AS fold, x.lo AS l1, x.hi AS h1, y.lo AS l2, y.hi AS h2 FROM blk x JOIN blk y ON x.g < y.g),
    a AS (SELECT fold, symbol, idx, (idx >= l1 AND idx < h1) OR (idx >= l2 AND idx < h2) AS t, (idx >= l1 - 18 AND idx < h1 + 18) OR (idx >= l2 - 18 AND idx < h2 + 18) AS near FROM b, ch)
    SELECT CAST(fold AS INTEGER) AS fold, CASE WHEN t THEN 'test' ELSE 'train' END AS role, symbol, count(*) AS n FROM a WHERE t OR NOT near GROUP BY ALL""")
def combinatorial_folds(spark, d):
    rows = bars(spark, d)
    ranges = spark.createDataFrame(V.combinatorial(_longest(rows)), "fold int, role string, lo long, hi long")
    return V.assign(rows, ranges, "idx").groupBy("fold", "role", "symbol").agg(F.count("*").alias("n"))


@query("pooled_train", f"WITH {BARS}, h AS (SELECT count(*) // 2 AS cut FROM b WHERE symbol = 'view') SELECT symbol, count(*) AS n FROM b, h WHERE symbol <> 'view' OR idx < cut GROUP BY symbol")
def pooled_train(spark, d):
    """The first half of one symbol's bars, and all of its siblings'."""
    rows = bars(spark, d)
    return V.pooled_train(rows, "view", rows.filter("symbol = 'view'").count() // 2).groupBy("symbol").agg(F.count("*").alias("n"))


@query("fold_standardise", f"WITH {SCORED}, f AS (SELECT fold, avg(y_prob) FILTER (row_idx % 3 <> 0) AS m, stddev_pop(y_prob) FILTER (row_idx % 3 <> 0) AS sd FROM s GROUP BY fold) SELECT row_idx, fold, {rr('(y_prob - m) / CASE WHEN sd < 1e-12 THEN 1 ELSE sd END', 'z')} FROM s JOIN f USING (fold)")
def fold_standardise(spark, d):
    return V.standardise(scored(spark, d), ["y_prob"], F.col("row_idx") % 3 != 0).select("row_idx", "fold", r6("y_prob", "z"))


@query("baselines", f"WITH {SCORED} SELECT fold, {rr('avg(y_true::DOUBLE) FILTER (row_idx % 2 = 1)', 'always_up')}, {rr('avg((y_true = (SELECT CAST(round_even(avg(y_true::DOUBLE), 0) AS INTEGER) FROM s z WHERE z.row_idx % 2 = 0))::INT::DOUBLE) FILTER (row_idx % 2 = 1)', 'majority')} FROM s GROUP BY fold")
def baselines(spark, d):
    """Accuracy on odd rows of predicting 1 and of the majority of even rows."""
    rows = scored(spark, d)
    majority = rows.filter("row_idx % 2 = 0").agg(F.bround(F.avg(F.col("y_true").cast("double")), 0).cast("int").alias("maj"))
    test = rows.join(F.broadcast(majority))
    odd = F.col("row_idx") % 2 == 1
    return test.groupBy("fold").agg(r6(F.avg(F.when(odd, F.col("y_true").cast("double"))), "always_up"), r6(F.avg(F.when(odd, (F.col("y_true") == F.col("maj")).cast("double"))), "majority"))


@query("edge_band", f"WITH {SCORED}, {_METRICS} SELECT {rr('quantile_cont(accuracy - greatest(up_rate, 1 - up_rate), 0.05)', 'low')}, {rr('quantile_cont(accuracy - greatest(up_rate, 1 - up_rate), 0.95)', 'high')} FROM m")
def edge_band(spark, d):
    return V.class_metrics(scored(spark, d)).agg(F.percentile("edge", F.array(F.lit(0.05), F.lit(0.95))).alias("p")).select(r6(F.col("p")[0], "low"), r6(F.col("p")[1], "high"))


@query("backtest_summary", f"WITH {SCORED} SELECT fold, {rr('avg((y_pred = y_true)::INT::DOUBLE)', 'accuracy')}, {rr('avg((y_pred = y_true)::INT::DOUBLE) FILTER (abs(y_prob - 0.5) >= 0.1)', 'confident_accuracy')}, {rr('avg((abs(y_prob - 0.5) >= 0.1)::INT::DOUBLE)', 'coverage')} FROM s GROUP BY fold")
def backtest_summary(spark, d):
    right, sure = (F.col("y_pred") == F.col("y_true")).cast("double"), F.abs(F.col("y_prob") - 0.5) >= 0.1
    return scored(spark, d).groupBy("fold").agg(r6(F.avg(right), "accuracy"), r6(F.avg(F.when(sure, right)), "confident_accuracy"), r6(F.avg(sure.cast("double")), "coverage"))


@query("reliability_lookup", f"WITH {REL}, tb AS (SELECT bin / 10 AS lo, (bin + 1) / 10 AS hi, sum(n * ob) / sum(n) AS ob FROM rel GROUP BY bin) SELECT row_idx, {rr('tb.ob', 'observed')} FROM s LEFT JOIN tb ON y_prob >= lo AND (y_prob < hi OR (hi = 1 AND y_prob = 1))")
def reliability_lookup(spark, d):
    rows = scored(spark, d)
    t = V.reliability(rows).select("lo", "hi", "observed_freq")
    return J.lookup_range(rows, t, F.col("y_prob")).select("row_idx", r6("observed_freq", "observed"))


# --- sizes and volatility ---------------------------------------------------------------------------------------------------


@query("position_sizes", f"WITH {SCORED}, v AS (SELECT *, abs(fwd_ret) + 0.001 AS f, 0.375 * greatest(0, y_prob - (1 - y_prob) / 2) AS k FROM s), w AS (SELECT *, least(3.0, 0.01 / f) AS v FROM v) SELECT row_idx, {rr('k', 'kelly')}, {rr('w.v', 'vol_size')}, {rr('least(k, w.v)', 'size')}, {rr('12 + 3 * sqrt(least(k, w.v))', 'cost_bps')}, {rr('fwd_ret - (12 + 3 * sqrt(least(k, w.v))) / 10000', 'net')} FROM w")
def position_sizes(spark, d):
    rows = scored(spark, d).withColumn("f", F.abs("fwd_ret") + 0.001)
    size = S.combined_size(F.col("y_prob"), F.col("f"), 0.01)
    return rows.select("row_idx", r6(S.fractional_kelly(F.col("y_prob")), "kelly"), r6(S.vol_target_size(F.col("f"), 0.01), "vol_size"), r6(size, "size"), r6(S.round_trip_cost_bps(size), "cost_bps"), r6(S.net_return(F.col("fwd_ret"), size), "net"))


@query("bet_sizes", f"WITH {SCORED}, q AS (SELECT row_idx, greatest(1e-6, least(1 - 1e-6, y_prob)) AS q FROM s), z AS (SELECT row_idx, q, abs((q - 0.5) / sqrt(q * (1 - q))) AS z FROM q) SELECT row_idx, {rr(f'sign(q - 0.5) * (2 * ({_Z}) - 1)', 'size')} FROM z")
def bet_sizes(spark, d):
    return scored(spark, d).select("row_idx", r6(S.bet_size(F.col("y_prob")), "size"))


_R2 = f"{BARS}, r AS (SELECT *, power(coalesce(ln(close) - lag(ln(close)) OVER ({W}), 0), 2) AS r2 FROM b), h AS (SELECT *, {full('sum(r2)', 'r2', 24)} AS rv FROM r), hd AS (SELECT *, {full('avg(rv)', 'rv', 4)} AS rm, {full('avg(rv)', 'rv', 7)} AS rl, lead(rv, 24) OVER ({W}) AS y FROM h)"


@query("har_design", f"WITH {_R2} SELECT symbol, open_time, {rr('rv', 'rv_short')}, {rr('rm', 'rv_medium')}, {rr('rl', 'rv_long')}, {rr('y', 'rv_target')} FROM hd")
def har_design(spark, d):
    return V.har_design(bars(spark, d), 24, 96, 168).select("symbol", "open_time", r6("rv_short"), r6("rv_medium"), r6("rv_long"), r6("rv_target"))


@query("qlike", f"WITH {_R2} SELECT symbol, {rr('avg(y / rv - ln(y / rv) - 1) FILTER (y > 0 AND rv > 0)', 'qlike')} FROM hd GROUP BY symbol")
def qlike(spark, d):
    return V.har_design(bars(spark, d), 24, 96, 168).groupBy("symbol").agg(r6(V.qlike(F.col("rv_target"), F.col("rv_short")), "qlike"))


#: Least squares by the covariances of each symbol's train rows and Cramer's rule.
_DET = "({0} * ({4} * {8} - {5} * {7}) - {1} * ({3} * {8} - {5} * {6}) + {2} * ({3} * {7} - {4} * {6}))"
_COV = [[f"c{a}{b}" for b in "sml"] for a in "sml"]


def _cramer(k: int) -> str:
    swapped = [f"c{a}y" if j == k else _COV[i][j] for i, a in enumerate("sml") for j in range(3)]
    return f"{_DET.format(*swapped)} / {_DET.format(*sum(_COV, []))}"


_HAR_FIT = f"""{_R2}, o AS (SELECT symbol, rv AS s, rm AS m, rl AS l, y, row_number() OVER ({W}) AS k, count(*) OVER (PARTITION BY symbol) AS n FROM hd WHERE rv IS NOT NULL AND rm IS NOT NULL AND rl IS NOT NULL AND y IS NOT NULL),
tr AS (SELECT * FROM o WHERE k <= n - floor(n * 0.2)), te AS (SELECT * FROM o WHERE k > n - floor(n * 0.2)),
mo AS (SELECT symbol, avg(s) AS us, avg(m) AS um, avg(l) AS ul, avg(y) AS uy, {', '.join(f'covar_pop({a}, {b}) AS c{a}{b}' for a in 'sml' for b in 'smly')} FROM tr GROUP BY symbol),
be AS (SELECT *, {', '.join(f'{_cramer(k)} AS b{a}' for k, a in enumerate('sml'))} FROM mo), co AS (SELECT symbol, uy - bs * us - bm * um - bl * ul AS b0, bs, bm, bl FROM be),
fo AS (SELECT co.*, y, greatest(1e-12, b0 + bs * s + bm * m + bl * l) AS f FROM te JOIN co USING (symbol))"""


@query("har_fit", f"WITH {_HAR_FIT} SELECT symbol, {rr('b0', 'intercept')}, {rr('bs', 'short')}, {rr('bm', 'medium')}, {rr('bl', 'long')}, {rr('avg(y / f - ln(y / f) - 1) FILTER (y > 0)', 'qlike')} FROM fo GROUP BY symbol, b0, bs, bm, bl")
def har_fit(spark, d):
    return M.fit_har(V.har_design(bars(spark, d), 24, 96, 168)).select("symbol", *(r6(c) for c in ("intercept", "short", "medium", "long", "qlike")))


@query(
    "vol_expansion",
    f"""WITH {BARS}, r AS (SELECT *, coalesce(ln(close) - lag(ln(close)) OVER ({W}), 0) AS r0 FROM b), s AS (SELECT *, {full('stddev_pop(r0)', 'r0', 20)} AS sg FROM r),
    q AS (SELECT *, quantile_cont(sg, 0.3) OVER ({W} ROWS BETWEEN 48 PRECEDING AND 1 PRECEDING) AS lo, count(sg) OVER ({W} ROWS BETWEEN 48 PRECEDING AND 1 PRECEDING) AS nb, avg(sg) OVER ({W} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS a, count(sg) OVER ({W} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS na,
      avg(sg) OVER ({W} ROWS BETWEEN 11 PRECEDING AND 6 PRECEDING) AS p, count(sg) OVER ({W} ROWS BETWEEN 11 PRECEDING AND 6 PRECEDING) AS np FROM s)
    SELECT symbol, open_time, coalesce(idx >= 48 AND sg IS NOT NULL AND na = 6 AND np = 6 AND nb >= 24 AND sg <= lo AND a > p, false) AS expanding FROM q""",
)
def vol_expansion(spark, d):
    rows = bars(spark, d).withColumn("r0", F.coalesce(WN.log_return(F.col("close")), F.lit(0.0)))
    rows = rows.withColumn("sigma", WN.std(F.col("r0"), 20))
    return V.volatility_expansion(rows, "sigma").select("symbol", "open_time", "expanding")


# --- models (no SQL) --------------------------------------------------------------------------------------------------------


@query("model_walk_forward")
def model_walk_forward(spark, d):
    """Metrics by fold of the logistic model, the rules and the baselines on triple-barrier labels."""
    return M.evaluate(M.dataset(bars(spark, d)), n_splits=3, min_train=800).select("model", "fold", "n", "coverage", r6("accuracy"), r6("edge"), r6("auc"), r6("brier"))


@query("boosted_walk_forward")
def boosted_walk_forward(spark, d):
    """Metrics by fold of boosted trees of up to 150 rounds that a purged tail of the train rows stops."""
    rows = M.settled(M.dataset(bars(spark, d)))
    folds = V.walk_forward(rows.count(), n_splits=2, min_train=800)
    return V.class_metrics(M.fold_scores(rows, folds, "gbm"), by=("model", "fold"), cost_bps=5.0).select("model", "fold", "n", r6("accuracy"), r6("edge"), r6("auc"), r6("brier"))


@query("pooled_evaluation")
def pooled_evaluation(spark, d):
    """Metrics by symbol and fold of models that learn from all symbols."""
    return M.evaluate_pooled(M.dataset(bars(spark, d)), n_splits=2, min_train=150).select("symbol", "fold", "n", "n_train", r6("accuracy"), r6("edge"), r6("auc"))


@query("combinatorial_evaluation")
def combinatorial_evaluation(spark, d):
    """The edge over the combinatorial splits: mean and 90 % range."""
    found = M.evaluate_combinatorial(M.dataset(bars(spark, d)), n_groups=5)
    return found.agg(F.count("*").alias("n_splits"), F.avg("edge").alias("edge"), F.percentile("edge", F.array(F.lit(0.05), F.lit(0.95))).alias("p")).select("n_splits", r6("edge"), r6(F.col("p")[0], "low"), r6(F.col("p")[1], "high"))


@query("calibration_choice")
def calibration_choice(spark, d):
    return M.compare_calibration(scored(spark, d), F.col("fold") < 3)


@query("calibrated_report")
def calibrated_report(spark, d):
    """Calibrators fitted on a purged stretch behind the train rows, tried on the last rows."""
    return M.calibrated_report(M.dataset(bars(spark, d))).select("method", "part", r6("brier"), r6("ece"), r6("mce"))


@query("regime_models")
def regime_models(spark, d):
    return M.regime_models(M.dataset(bars(spark, d)), n_splits=2, min_train=800)


@query("meta_labelling")
def meta_labelling(spark, d):
    return M.meta_labelling(M.dataset(bars(spark, d)), n_splits=3, min_train=800)


@query("top_features")
def top_features(spark, d):
    return M.top_features(M.dataset(bars(spark, d)), 20)


@query("tuned_parameters")
def tuned_parameters(spark, d):
    """The log of 50 trials of a sequential search over purged folds."""
    return M.tune(M.dataset(bars(spark, d)), n_splits=2, min_train=800)


@query("garch_volatility")
def garch_volatility(spark, d):
    return M.garch_volatility(bars(spark, d)).select("symbol", "open_time", r6("garch_vol"))


@query("leakage_demo")
def leakage_demo(spark, d):
    return M.leakage_demo(M.dataset(bars(spark, d)), min_train=800)


@query("row_numbering", f"WITH {BARS} SELECT symbol, open_time, row_number() OVER (ORDER BY open_time, symbol) - 1 AS row_idx FROM b")
def row_numbering(spark, d):
    return M.numbered(bars(spark, d)).select("symbol", "open_time", "row_idx")
