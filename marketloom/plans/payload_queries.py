"""Queries of the latest state: snapshots, analyses, overlays, model opinions, context series, clean rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketloom.functions import windows as W
from marketloom.operators import payload as P
from marketloom.operators import validation as V
from marketloom.plans.demo import BARS, POINTS, SCORED, bars, frame, points, r6, rr, scored, table
from marketloom.plans.demo import W as WSYM
from marketloom.plans.indicator_queries import _SIG, AS_OF_SQL, LN, as_of
from marketloom.plans.registry import query
from marketloom.plans.validation_queries import _METRICS, REL

_LAST = f"""{BARS}, {_SIG}, lr AS (SELECT symbol, open_time, {LN} AS r FROM b), vo AS (SELECT symbol, open_time, CASE WHEN count(r) OVER {frame(95)} >= 2 THEN stddev_samp(r) OVER {frame(95)} * 100 END AS vola FROM lr),
la AS (SELECT cf.*, vo.vola, sum(volume) OVER {frame(288)} > 0 AS weighted, coalesce(lag(close) OVER ({WSYM}), close) AS prev, coalesce(lag(close, 287) OVER ({WSYM}), first_value(close) OVER {frame(288)}) AS base,
  call <> 'NEUTRAL' AND confidence < 62 AS weak FROM cf JOIN vo USING (symbol, open_time))"""
_REASONS = """concat_ws('; ', 'rule ' || rule0, CASE WHEN sma IS NOT NULL AND rsi IS NOT NULL THEN CASE WHEN close > sma THEN 'price above its mean' ELSE 'price at or under its mean' END END, 'breakout ' || lower(bo),
  CASE WHEN call <> 'NEUTRAL' AND vw IS NOT NULL THEN CASE WHEN (call = 'UP' AND close > vw) OR (call = 'DOWN' AND close < vw) THEN 'volume-weighted price agrees' ELSE 'volume-weighted price disagrees' END END,
  CASE WHEN call <> 'NEUTRAL' AND bw >= 0.06 THEN 'extreme volatility' END, CASE WHEN weak THEN 'confidence under the profile''s least' END)"""
_CALL = "CASE WHEN weak THEN 'NEUTRAL' ELSE call END AS signal, confidence, CASE WHEN weak THEN rule0 || '-below-threshold' ELSE rule0 END AS rule"
_LATEST = "QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY open_time DESC) = 1"


@query(
    "snapshot_rows",
    f"""WITH RECURSIVE {_LAST}, l AS (SELECT * FROM la {_LATEST}) SELECT symbol, 'crypto' AS asset_class, close AS price, {rr('rsi', 'rsi')}, {rr('sma', 'sma_50')}, {rr('m + 2 * sd', 'bb_upper')}, {rr('m - 2 * sd', 'bb_lower')}, {rr('bw', 'bb_bandwidth')}, bo AS bb_breakout,
    {rr('vw', 'vwap')}, weighted AS vwap_is_volume_weighted, {rr('vola', 'volatility')}, volume, {_CALL}, {_REASONS} AS reasons, TIMESTAMP '2024-02-01 00:00:00' AS bucket_at FROM l WHERE idx >= 59""",
)
def snapshot_rows(spark, d):
    rows = P.snapshots(bars(spark, d), F.lit("2024-02-01 00:03:20").cast("timestamp_ntz"))
    rounded = {c: r6(c) for c in ("rsi", "sma_50", "bb_upper", "bb_lower", "bb_bandwidth", "vwap", "volatility")}
    return rows.withColumns({**rounded, "reasons": F.array_join("reasons", "; "), "bucket_at": F.col("bucket_at").cast("timestamp_ntz")})


@query(
    "analysis_payload",
    f"""WITH RECURSIVE {_LAST}, l AS (SELECT * FROM la {_LATEST}), ei AS (SELECT *, avg(volume) OVER (PARTITION BY symbol) AS mv FROM cf WHERE open_time BETWEEN {AS_OF_SQL} - INTERVAL 12 HOUR AND {AS_OF_SQL} AND rsi IS NOT NULL AND symbol IN (SELECT symbol FROM cf WHERE open_time <= {AS_OF_SQL} GROUP BY symbol HAVING count(*) >= 19)),
    ej AS (SELECT symbol, open_time AS entry_time, 0.65 * (100 - rsi) / 100 + 0.35 * least(CASE WHEN mv > 0 THEN volume / mv ELSE 1 END, 3) / 3 AS es FROM ei), en AS (SELECT * FROM ej QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY round(es, 12) DESC, entry_time) = 1)
    SELECT symbol, close AS price, prev AS prev_close, {rr('CASE WHEN base <> 0 THEN (close - base) / base * 100 ELSE 0 END', 'change_24h')}, {rr('rsi', 'rsi')}, 50 AS sma_period, {rr('vola', 'volatility')}, {rr('m', 'middle')}, {rr('CASE WHEN sd > 0 THEN (close - m + 2 * sd) / (4 * sd) WHEN sd = 0 THEN 0.5 END', 'percent_b')},
    {_CALL}, open_time AS last_tick, entry_time, {rr('es', 'entry_score')} FROM l LEFT JOIN en USING (symbol)""",
)
def analysis_payload(spark, d):
    rows = P.analyses(bars(spark, d), as_of())
    return rows.select(
        "symbol", "price", "prev_close", r6("change_24h"), r6("rsi"), "sma_period", r6("volatility"), r6("bollinger.middle", "middle"), r6("bollinger.percent_b", "percent_b"), "signal", "confidence", "rule", "last_tick",
        F.col("entry_window.open_time").alias("entry_time"), r6("entry_window.score", "entry_score"),
    )


@query("overlay_series", f"WITH RECURSIVE {BARS}, {_SIG} SELECT symbol, open_time, close, high, low, volume, {rr('rsi', 'rsi')}, {rr('sma', 'sma')} FROM cf QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY open_time DESC) <= 288")
def overlay_series(spark, d):
    return P.overlay(bars(spark, d)).withColumns({"rsi": r6("rsi"), "sma": r6("sma")})


@query(
    "model_opinions",
    f"""WITH {REL}, tb AS (SELECT bin / 10 AS lo, (bin + 1) / 10 AS hi, sum(n * ob) / sum(n) AS ob FROM rel GROUP BY bin)
    SELECT row_idx, true AS available, CASE WHEN y_prob >= 0.5 THEN 'UP' ELSE 'DOWN' END AS signal, CAST(floor(abs(y_prob - 0.5) * 200 + 0.5) AS INTEGER) AS confidence, true AS confidence_is_meaningful, true AS is_validated, {rr('tb.ob', 'observed')}
    FROM s LEFT JOIN tb ON y_prob >= lo AND (y_prob < hi OR (hi = 1 AND y_prob = 1))""",
)
def model_opinions(spark, d):
    rows = scored(spark, d)
    meta = {"verdict": "WEAK", "edge": 0.01, "accuracy": 0.52, "top_decile_acc": 0.56}
    return P.model_opinions(rows, F.col("y_prob"), meta, table=V.reliability(rows)).select("row_idx", "opinion.*", r6("observed"))


@query(
    "meta_opinions",
    f"""WITH {SCORED}, o AS (SELECT row_idx, y_prob AS p, CASE "primary" WHEN 1 THEN 'UP' WHEN 0 THEN 'DOWN' ELSE 'NEUTRAL' END AS pc FROM s)
    SELECT row_idx, pc <> 'NEUTRAL' AS available, CASE WHEN pc <> 'NEUTRAL' THEN CASE WHEN p >= 0.6 THEN pc ELSE 'NEUTRAL' END END AS signal, CASE WHEN pc <> 'NEUTRAL' THEN CAST(floor(p * 100 + 0.5) AS INTEGER) END AS confidence FROM o""",
)
def meta_opinions(spark, d):
    primary = F.when(F.col("primary") == 1, "UP").when(F.col("primary") == 0, "DOWN").otherwise("NEUTRAL")
    return P.model_opinions(scored(spark, d), F.col("y_prob"), {"mode": "meta_label", "threshold": 0.6}, primary).select("row_idx", "opinion.available", "opinion.signal", "opinion.confidence")


@query("model_info", "SELECT n_nationkey AS id, n_nationkey % 3 <> 0 AS loaded, CASE WHEN n_nationkey % 3 = 1 THEN 'meta_label' WHEN n_nationkey % 3 = 2 THEN 'direction' END AS mode, CASE WHEN n_nationkey % 3 = 1 THEN 'WEAK' WHEN n_nationkey % 3 = 2 THEN 'UNKNOWN' END AS verdict, CASE WHEN n_nationkey % 3 = 1 THEN n_nationkey / 100 END AS edge FROM nation")
def model_info(spark, d):
    k = F.col("n_nationkey")
    wf = F.struct((k / 100).alias("edge_mean"))
    full = F.struct(F.lit("logistic").alias("kind"), F.struct(F.lit("meta_label").alias("mode"), F.lit("WEAK").alias("verdict"), wf.alias("walk_forward")).alias("meta"))
    body = F.when(k % 3 == 1, F.to_json(full)).when(k % 3 == 2, '{"kind": "logistic"}').otherwise('{"kind": "absent"}')
    return P.model_info(table(spark, d, "nation").select(k.alias("id"), body.alias("body"))).select("id", "loaded", "mode", "verdict", F.col("walk_forward.edge_mean").alias("edge"))


@query("derivative_context", f"WITH {BARS}, {POINTS} SELECT b.symbol, b.open_time, {rr('pts.funding', 'open_interest')}, CAST(NULL AS DOUBLE) AS top_trader_ratio FROM b ASOF LEFT JOIN pts ON b.symbol = pts.symbol AND b.open_time >= pts.event_time")
def derivative_context(spark, d):
    """Points landed as one JSON page a symbol and day, read back and aligned to the bars beside a series that could not be had."""
    ms = (F.unix_micros(F.col("event_time").cast("timestamp")).cast("decimal(20,0)") * F.lit("0.001").cast("decimal(4,3)")).cast("decimal(20,3)")  # with the microseconds as decimals
    record = F.struct(ms.alias("timestamp"), F.col("funding").cast("string").alias("sumOpenInterest"))
    pages = points(spark, d).groupBy("symbol", F.to_date("event_time").alias("day")).agg(F.to_json(F.collect_list(record)).alias("body"))
    series = P.stats_series(pages, "sumOpenInterest", "open_interest").withColumn("event_time", F.col("event_time").cast("timestamp_ntz"))
    return P.with_context(bars(spark, d), {"open_interest": series, "top_trader_ratio": None}).select("symbol", "open_time", r6("open_interest"), "top_trader_ratio")


@query("daily_metric", "SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, count(*)::DOUBLE AS active FROM orders GROUP BY 1")
def daily_metric(spark, d):
    """Orders a day, landed as one JSON page a month and read back."""
    days = table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").cast("double").alias("v"))
    record = F.struct((F.unix_date("day").cast("long") * 86_400).alias("t"), "v")
    return P.daily_metric(days.groupBy(F.trunc("day", "month").alias("month")).agg(F.to_json(F.collect_list(record)).alias("body")), "active").withColumn("day", F.col("day").cast("string"))


@query("complete_rows", f"WITH {BARS}, c AS (SELECT symbol, open_time, {LN} AS ret, CASE WHEN volume > 1 THEN close / volume END AS per, lead(close, 3) OVER ({WSYM}) / close - 1 AS target FROM b) SELECT symbol, open_time, {rr('ret', 'ret')}, {rr('per', 'per')}, {rr('target', 'target')} FROM c WHERE ret IS NOT NULL AND per IS NOT NULL AND target IS NOT NULL")
def complete_rows(spark, d):
    """Features with infinite values, a column that is never known, one that is excluded and a hidden one."""
    rows = bars(spark, d).select("symbol", "open_time", W.log_return(F.col("close")).alias("ret"), F.when(F.col("volume") > 1, F.col("close") / F.when(F.col("volume") > 1, F.col("volume"))).otherwise(float("inf")).alias("per"), F.lit(None).cast("double").alias("never"), F.when(F.col("idx") % 2 == 0, 1.0).alias("left_out"), F.lit(None).cast("double").alias("__regime"), (F.lead("close", 3).over(W.by_symbol()) / F.col("close") - 1).alias("target"))
    clean, names = P.complete_rows(rows, "target", exclude=("left_out",))
    return clean.select("symbol", "open_time", *(r6(c) for c in names), r6("target"))


@query("failure_split", "SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'forex' ELSE 'crypto' END AS asset_class, CASE WHEN o_orderstatus = 'P' THEN 'closed' ELSE 'down' END AS state, count(*) AS n FROM orders GROUP BY ALL")
def failure_split(spark, d):
    symbol = F.when(F.col("o_orderkey") % 2 == 0, "EUR/USD").otherwise("BTC/USDT")
    return P.split_failures(table(spark, d, "orders").select(symbol.alias("symbol"), (F.col("o_orderstatus") == "P").alias("market_closed")))


@query("display_times", "SELECT event_id, coalesce(strftime(ts, '%H:%M'), '—') AS shown_time, coalesce(strftime(ts, '%b %d, %H:%M'), '—') AS shown FROM events")
def display_times(spark, d):
    return table(spark, d, "events").select("event_id", P.format_time(F.col("ts")).alias("shown_time"), P.format_date_time(F.col("ts")).alias("shown"))


@query("fold_counts", f"WITH {SCORED}, {_METRICS} SELECT 'model' AS model, count(*) AS folds, count(*) FILTER (accuracy - greatest(up_rate, 1 - up_rate) > 0) AS folds_positive_edge FROM m")
def fold_counts(spark, d):
    return P.fold_counts(V.class_metrics(scored(spark, d)).withColumn("model", F.lit("model")))


@query("best_model", f"WITH {SCORED}, {_METRICS} SELECT fold, {rr('accuracy - greatest(up_rate, 1 - up_rate)', 'edge')} FROM m ORDER BY round(accuracy - greatest(up_rate, 1 - up_rate), 9) DESC, fold LIMIT 1")
def best_model(spark, d):
    return P.best_model(V.class_metrics(scored(spark, d)), "fold").select("fold", r6("edge"))


@query("backtest_by_regime", f"WITH {SCORED} SELECT fold, CASE WHEN \"primary\" = 1 THEN 'trending' ELSE 'ranging' END AS regime, count(*) AS n, {rr('avg((y_pred = y_true)::INT::DOUBLE)', 'accuracy')}, {rr('greatest(avg(y_true::DOUBLE), 1 - avg(y_true::DOUBLE))', 'base_rate')} FROM s GROUP BY ALL")
def backtest_by_regime(spark, d):
    up = F.avg(F.col("y_true").cast("double"))
    rows = scored(spark, d).withColumn("regime", F.when(F.col("primary") == 1, "trending").otherwise("ranging"))
    return rows.groupBy("fold", "regime").agg(F.count("*").alias("n"), r6(F.avg((F.col("y_pred") == F.col("y_true")).cast("double")), "accuracy"), r6(F.greatest(up, 1 - up), "base_rate"))


_COIN = "CASE WHEN ('0x' || substr(md5(CAST(row_idx AS VARCHAR)), 1, 8))::BIGINT / 4294967296.0::DOUBLE < up THEN 1 ELSE 0 END"


@query("random_baseline", f"WITH {SCORED}, u AS (SELECT avg(y_true::DOUBLE) AS up FROM s WHERE row_idx % 2 = 0) SELECT fold, {rr(f'avg((y_true = {_COIN})::INT::DOUBLE)', 'accuracy')} FROM s, u WHERE row_idx % 2 = 1 GROUP BY fold")
def random_baseline(spark, d):
    """Accuracy on odd rows of a coin with the balance of the even ones."""
    rows = scored(spark, d)
    balance = rows.filter("row_idx % 2 = 0").agg(F.avg(F.col("y_true").cast("double")).alias("up"))
    test = rows.filter("row_idx % 2 = 1").join(F.broadcast(balance))
    return test.groupBy("fold").agg(r6(F.avg((F.col("y_true") == P.class_matched(F.col("row_idx"), F.col("up"))).cast("double")), "accuracy"))


@query("toggle_watchlist", "WITH w AS (SELECT c_custkey AS id, c_nationkey AS symbol FROM customer), k AS (SELECT c_custkey AS id, CAST(c_custkey % 25 AS INTEGER) AS symbol FROM customer) (SELECT * FROM w EXCEPT SELECT * FROM k) UNION ALL (SELECT * FROM k EXCEPT SELECT * FROM w)")
def toggle_watchlist(spark, d):
    """Every customer's nation as watched, toggled by another one for each of them."""
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("symbol"))
    return P.toggle(rows, rows.select("id", (F.col("id") % 25).cast("int").alias("symbol")))
