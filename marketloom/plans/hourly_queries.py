"""Queries of the hourly model: parabolic stops, its matrix, rows with two-level headers, and the cache of contexts."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketloom.operators.hourly import SEASONS, hourly_matrix
from marketloom.operators.joins import asof
from marketloom.operators.stops import NAMES, parabolic_stops
from marketloom.plans.demo import BARS, POINTS, frame, full, plain_bars, points, r6, rr, table
from marketloom.plans.demo import W as WSYM
from marketloom.plans.indicator_queries import _TP, KEY, _min5
from marketloom.plans.registry import query
from marketloom.plans.stream_queries import scratch
from marketloom.sources.bars import flat_headers
from marketloom.sources.cache import Cache, grid_keys

_ALONG, _AGAINST = "CASE WHEN side = 1 THEN high ELSE low END", "CASE WHEN side = 1 THEN low ELSE high END"
_PSAR = f"""n AS (SELECT symbol, open_time, idx, high, low, lag(high) OVER ({WSYM}) AS h1, lag(low) OVER ({WSYM}) AS l1, lag(high, 2) OVER ({WSYM}) AS h2, lag(low, 2) OVER ({WSYM}) AS l2 FROM b),
ps AS (SELECT symbol, idx::BIGINT AS idx, 1 AS side, low AS stop, high AS extreme, 0.02::DOUBLE AS pace, 0 AS turned FROM n WHERE idx = 0
  UNION ALL SELECT symbol, idx, CASE WHEN flip THEN -side ELSE side END, CASE WHEN flip THEN extreme ELSE aim END, CASE WHEN flip THEN against WHEN side * along > side * extreme THEN along ELSE extreme END,
    CASE WHEN flip THEN 0.02::DOUBLE WHEN side * along > side * extreme THEN least(pace + 0.02::DOUBLE, 0.2::DOUBLE) ELSE pace END, CASE WHEN flip THEN 1 ELSE 0 END
  FROM (SELECT *, side * against < side * aim AS flip FROM (SELECT n.symbol, n.idx, side, extreme, pace, {_ALONG} AS along, {_AGAINST} AS against,
    CASE WHEN side = 1 THEN least(stop + pace * (extreme - stop), l1, coalesce(l2, l1)) ELSE greatest(stop + pace * (extreme - stop), h1, coalesce(h2, h1)) END AS aim FROM ps JOIN n ON n.symbol = ps.symbol AND n.idx = ps.idx + 1))),
st AS (SELECT symbol, idx, CASE WHEN side = 1 AND idx > 0 THEN stop END AS psar_up, CASE WHEN side = -1 AND idx > 0 THEN stop END AS psar_down, CAST(turned * (side = 1)::INTEGER AS INTEGER) AS psar_up_indicator, CAST(turned * (side = -1)::INTEGER AS INTEGER) AS psar_down_indicator FROM ps)"""
_STOPS = f"{rr('psar_up', 'psar_up')}, {rr('psar_down', 'psar_down')}, psar_up_indicator, psar_down_indicator"


@query("parabolic_stops", f"WITH RECURSIVE {BARS}, {_PSAR} SELECT symbol, open_time, {_STOPS} FROM b JOIN st USING (symbol, idx)")
def stops(spark, d):
    return parabolic_stops(plain_bars(spark, d)).select(*KEY, *(r6(c) for c in NAMES[:2]), *NAMES[2:])


_SEASON = ", ".join(rr(f"{f}(2 * pi() * {x} / {p})", f"{n}_{f}") for n, x, p in (("hour", "(hour(open_time) + minute(open_time) / 60)", 24), ("dow", "(isodow(open_time) - 1)", 7)) for f in ("sin", "cos"))
_FOREX = "symbol IN ('view', 'signup')"


@query(
    "hourly_matrix",
    f"""WITH RECURSIVE {BARS}, {_PSAR}, {POINTS}, m AS (SELECT avg(c_acctbal) AS macro FROM customer),
    f AS (SELECT *, {_TP} * volume AS mf, sign({_TP} - lag({_TP}) OVER ({WSYM})) AS rise, sign(coalesce(close - lag(close) OVER ({WSYM}), 0)) * volume AS sv, min(low) OVER {frame(14)} AS lo, max(high) OVER {frame(14)} AS hi, {_min5(f'sum({_TP} * volume)', 'volume')} AS pv, {_min5('sum(volume)', 'volume')} AS v, {_min5('avg(volume)', 'volume')} AS vm, {_min5('stddev_samp(volume)', 'volume')} AS vsd FROM b),
    g AS (SELECT *, CASE WHEN v > 0 THEN pv / v END AS w0, {_min5('avg(sv)', 'sv')} AS fm, {_min5('stddev_samp(sv)', 'sv')} AS fsd, {full('sum(CASE WHEN rise > 0 THEN mf ELSE 0 END)', 'close', 14)} AS up, {full('sum(CASE WHEN rise < 0 THEN mf ELSE 0 END)', 'close', 14)} AS dn FROM f),
    h AS (SELECT *, coalesce(w0, first_value(w0 IGNORE NULLS) OVER ({WSYM} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), last_value(w0 IGNORE NULLS) OVER ({WSYM} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS w,
      CASE WHEN count(*) OVER {frame(14)} = 14 THEN CASE WHEN hi > lo THEN (close - lo) / (hi - lo) * 100 ELSE 50 END END AS k, sum(sv) OVER ({WSYM} ROWS UNBOUNDED PRECEDING) AS o, {full('avg(close)', 'close', 20)} AS sma FROM g)
    SELECT h.symbol, h.open_time, {_STOPS}, {_SEASON.replace('open_time', 'h.open_time')}, {rr('greatest(-5, least(5, coalesce(CASE WHEN fsd > 0 THEN (sv - fm) / fsd END, 0)))', 'order_flow_imbalance')},
      {rr('CASE WHEN h.' + _FOREX + ' THEN coalesce((close - w) / nullif(w, 0), 0) END', 'vwap_deviation')}, {rr('CASE WHEN h.' + _FOREX + ' THEN coalesce(CASE WHEN vsd > 0 THEN (volume - vm) / vsd END, 0) END', 'volume_zscore')},
      {rr('k', 'stoch_k')}, {rr('o', 'obv')}, {rr('CASE WHEN dn > 0 THEN 100 - 100 / (1 + up / dn) WHEN dn = 0 THEN 100 END', 'mfi')}, {rr('sma', 'sma20')}, {rr('coalesce(pts.funding, 0)', 'funding')}, {rr('macro', 'macro')}
    FROM h JOIN st ON st.symbol = h.symbol AND st.idx = h.idx ASOF LEFT JOIN pts ON h.symbol = pts.symbol AND h.open_time >= pts.event_time, m""",
)
def matrix(spark, d):
    macro = table(spark, d, "customer").agg(F.avg("c_acctbal").cast("double").alias("macro"))
    rows = hourly_matrix(plain_bars(spark, d), {"funding": points(spark, d)}, macro, F.col("symbol").isin("view", "signup"))
    return rows.select(*KEY, *(r6(c) for c in NAMES[:2]), *NAMES[2:], *(r6(c) for c in (*SEASONS, "order_flow_imbalance", "vwap_deviation", "volume_zscore", "stoch_k", "obv", "mfi", "sma20", "funding", "macro")))


@query("two_level_headers", f"WITH {BARS} SELECT symbol, open_time, open, high, low, close, volume FROM b WHERE volume <> 1")
def two_level_headers(spark, d):
    """Bars with headers like Open|pair, as a download of several pairs has them; those of one tick have no close."""
    named = {"Datetime": F.col("open_time"), **{c.title(): F.col(c) for c in ("open", "high", "low", "volume")}, "Close": F.when(F.col("volume") != 1, F.col("close"))}
    landed = plain_bars(spark, d).select("symbol", *(c.alias(f"{n}|PAIR=X") for n, c in named.items()))
    return flat_headers(landed, F.col("symbol")).withColumn("open_time", F.col("open_time").cast("timestamp_ntz"))


#: Requests of the cache: hours after the store, and whether the grid ends at as_of instead.
REQUESTS = {"same": (1, False), "other_grid": (1, True), "stale": (6, False)}


@query(
    "context_cache",
    f"""WITH {BARS}, r(request, cut) AS (VALUES ('same', false), ('other_grid', true), ('stale', false)), g AS (SELECT request, symbol, count(*) AS n, epoch_ms(min(open_time)) AS a, epoch_ms(max(open_time)) AS z FROM b, r WHERE NOT cut OR open_time <= TIMESTAMP '2024-01-20 12:00:00' GROUP BY ALL)
    SELECT request, symbol, symbol || '_' || n || '_' || a || '_' || z AS cache_key, request = 'same' AND symbol <> 'signup' AS hit, CASE WHEN request = 'same' AND symbol <> 'signup' THEN n ELSE 0 END AS n_rows FROM g""",
)
def context_cache(spark, d):
    """Each symbol's context by its grid, asked for again: the same grid, one that ends sooner, and too late. The symbol signup has no open interest, so that its context isn't whole and never kept."""
    rows, at = plain_bars(spark, d), F.lit("2024-06-01 00:00:00").cast("timestamp")
    context = asof(rows, points(spark, d), "funding").select("symbol", F.col("open_time").cast("timestamp").alias("open_time"), "funding", F.when(F.col("symbol") != "signup", F.col("volume")).alias("open_interest"))
    cache = Cache(spark, scratch(spark), "symbol string, open_time timestamp, funding double, open_interest double", whole=("funding", "open_interest"))
    cache.store(context, grid_keys(rows), at)
    out = None
    for name, (hours, cut) in REQUESTS.items():
        keys, later = grid_keys(rows.filter(F.col("open_time") <= F.lit("2024-01-20 12:00:00").cast("timestamp_ntz")) if cut else rows), at + F.expr(f"INTERVAL {hours} HOURS")
        counts = cache.read(keys, later).groupBy("symbol").agg(F.count(F.lit(1)).alias("n_rows"))
        asked = cache.ages(keys, later).join(counts, "symbol", "left").select(F.lit(name).alias("request"), "symbol", "cache_key", "hit", F.coalesce("n_rows", F.lit(0)).alias("n_rows"))
        out = asked if out is None else out.unionByName(asked)
    return out
