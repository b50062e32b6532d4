"""Queries over bars: windows, recursions, signals, joins of series, features, labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketloom.functions import scalars as S
from marketloom.functions import windows as W
from marketloom.operators import features as X
from marketloom.operators import joins as J
from marketloom.operators import recursive as R
from marketloom.operators import signals as G
from marketloom.plans.demo import BARS, POINTS, bars, frame, full, plain_bars, points, r6, rr, table
from marketloom.plans.demo import W as WSYM
from marketloom.plans.registry import query
from marketloom.sources.bars import by_symbol
from marketloom.streaming.scoring import score_latest

KEY = ("symbol", "open_time")
LN = "ln(close) - lag(ln(close)) OVER (" + WSYM + ")"
RET0 = BARS + f", r AS (SELECT *, coalesce({LN}, 0.0::DOUBLE) AS r0 FROM b)"
AS_OF_SQL = "TIMESTAMP '2024-01-20 12:00:00'"


def as_of():
    return F.lit("2024-01-20 12:00:00").cast("timestamp_ntz")


@query("tick_to_bar", f"WITH {BARS} SELECT symbol, open_time, open, high, low, close, volume, idx FROM b")
def tick_to_bar(spark, d):
    return bars(spark, d).select(*KEY, "open", "high", "low", "close", "volume", "idx")


@query("sma_series", f"WITH {BARS} SELECT symbol, open_time, {rr(full('avg(close)', 'close', 20), 'sma20')}, {rr(full('avg(close)', 'close', 50), 'sma50')} FROM b")
def sma_series(spark, d):
    c = F.col("close")
    return bars(spark, d).select(*KEY, r6(W.mean(c, 20), "sma20"), r6(W.mean(c, 50), "sma50"))


_BB = f"bb AS (SELECT *, {full('avg(close)', 'close', 20)} AS m, {full('stddev_pop(close)', 'close', 20)} AS sd FROM b)"


@query(
    "bollinger",
    f"""WITH {BARS}, {_BB} SELECT symbol, open_time, {rr('m', 'middle')}, {rr('m + 2 * sd', 'upper')}, {rr('m - 2 * sd', 'lower')}, {rr('CASE WHEN m <> 0 THEN 4 * sd / m WHEN m = 0 THEN 0 END', 'bandwidth')},
    {rr('CASE WHEN sd > 0 THEN (close - (m - 2 * sd)) / (4 * sd) WHEN m IS NOT NULL THEN 0.5 END', 'percent_b')}, CASE WHEN close > m + 2 * sd THEN 'UPPER' WHEN close < m - 2 * sd THEN 'LOWER' END AS breakout FROM bb""",
)
def bollinger(spark, d):
    bb = G.bollinger(F.col("close"), 20)
    return bars(spark, d).select(*KEY, *(r6(bb[c], c) for c in ("middle", "upper", "lower", "bandwidth", "percent_b")), bb["breakout"].alias("breakout"))


_TP = "(high + low + close) / 3"
_VWAP48 = f"CASE WHEN count(close) OVER {frame(48)} = 48 THEN CASE WHEN sum(volume) OVER {frame(48)} > 0 THEN sum({_TP} * volume) OVER {frame(48)} / sum(volume) OVER {frame(48)} ELSE avg({_TP}) OVER {frame(48)} END END"


#: The signal's: up to 288 bars, as many as there are.
_VWAP_DAY = f"CASE WHEN sum(volume) OVER {frame(288)} > 0 THEN sum({_TP} * volume) OVER {frame(288)} / sum(volume) OVER {frame(288)} ELSE avg({_TP}) OVER {frame(288)} END"


@query("rolling_vwap", f"WITH {BARS} SELECT symbol, open_time, {rr(_VWAP48, 'vwap', 9)} FROM b")
def rolling_vwap(spark, d):
    return bars(spark, d).select(*KEY, r6(W.vwap(48), "vwap", 9))


@query(
    "vwap_fallback",
    f"""WITH {BARS}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY open_time DESC) AS k FROM b)
    SELECT symbol, {rr(f'CASE WHEN sum(volume) > 0 THEN sum({_TP} * volume) / sum(volume) ELSE avg({_TP}) END', 'vwap')}, sum(volume) > 0 AS weighted FROM n WHERE k <= 288 GROUP BY symbol""",
)
def vwap_fallback(spark, d):
    last = bars(spark, d).withColumn("k", F.row_number().over(by_symbol().orderBy(F.desc("open_time")))).filter("k <= 288")
    v = F.sum("volume")
    return last.groupBy("symbol").agg(r6(F.when(v > 0, F.sum(W.typical() * F.col("volume")) / F.when(v > 0, v)).otherwise(F.avg(W.typical())), "vwap"), (v > 0).alias("weighted"))


@query(
    "realised_vol",
    f"""WITH {BARS}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY open_time DESC) AS k FROM b WHERE close > 0), l AS (SELECT symbol, {LN} AS r FROM n WHERE k <= 96)
    SELECT symbol, {rr('CASE WHEN count(r) >= 2 THEN stddev_samp(r) * 100 END', 'volatility')} FROM l GROUP BY symbol""",
)
def realised_vol(spark, d):
    last = bars(spark, d).withColumn("k", F.row_number().over(by_symbol().orderBy(F.desc("open_time")))).filter("k <= 96")
    r = last.withColumn("r", W.log_return(F.col("close")))
    return r.groupBy("symbol").agg(r6(F.when(F.count("r") >= 2, F.stddev_samp("r") * 100), "volatility"))


@query("lagged_returns", f"WITH {BARS} SELECT symbol, open_time, " + ", ".join(rr(f"ln(close) - lag(ln(close), {k}) OVER ({WSYM})", f"ret_{k}") for k in (1, 3, 6, 12)) + " FROM b")
def lagged_returns(spark, d):
    return bars(spark, d).select(*KEY, *(r6(W.log_return(F.col("close"), k), f"ret_{k}") for k in (1, 3, 6, 12)))


def _z(x: str, w: int) -> str:
    sd, m = full(f"stddev_pop({x})", x, w), full(f"avg({x})", x, w)
    return f"greatest(-5.0::DOUBLE, least(5.0::DOUBLE, coalesce(CASE WHEN ({sd}) > 0 THEN ({x} - ({m})) / ({sd}) END, 0.0::DOUBLE)))"


@query("volume_z", f"WITH {BARS} SELECT symbol, open_time, {rr(_z('volume', 48), 'volume_z')} FROM b")
def volume_z(spark, d):
    return bars(spark, d).select(*KEY, r6(W.zscore(F.col("volume"), 48), "volume_z"))


_DEN = f"stddev_pop(close) OVER {frame(60)} * stddev_pop(volume) OVER {frame(60)}"


@query("rolling_corr", f"WITH {BARS} SELECT symbol, open_time, {rr(f'CASE WHEN count(*) OVER {frame(60)} = 60 THEN CASE WHEN {_DEN} > 0 THEN covar_pop(close, volume) OVER {frame(60)} / ({_DEN}) ELSE 0 END END', 'corr')} FROM b")
def rolling_corr(spark, d):
    return bars(spark, d).select(*KEY, r6(W.correlation(F.col("close"), F.col("volume"), 60), "corr"))


@query(
    "vol_ratio",
    f"WITH {RET0}, v AS (SELECT *, {full('stddev_pop(r0)', 'r0', 12)} AS v12, {full('stddev_pop(r0)', 'r0', 48)} AS v48 FROM r) SELECT symbol, open_time, {rr('v12', 'vol_12')}, {rr('CASE WHEN v48 > 0 THEN v12 / v48 ELSE 1 END', 'vol_ratio')} FROM v",
)
def vol_ratio(spark, d):
    rows = bars(spark, d).withColumn("r0", F.coalesce(W.log_return(F.col("close")), F.lit(0.0)))
    v12, v48 = W.std(F.col("r0"), 12), W.std(F.col("r0"), 48)
    return rows.select(*KEY, r6(v12, "vol_12"), r6(F.when(v48 > 0, v12 / F.when(v48 > 0, v48)).otherwise(1.0), "vol_ratio"))


_H = "(hour(open_time) + minute(open_time) / 60.0 + second(open_time) / 3600.0)"


@query(
    "hour_cyclic",
    f"""WITH {BARS} SELECT symbol, open_time, {rr(f'sin({_H} * 2 * pi() / 24)', 'hour_sin')}, {rr(f'cos({_H} * 2 * pi() / 24)', 'hour_cos')},
    {rr('sin((isodow(open_time) - 1) * 2 * pi() / 7)', 'dow_sin')}, {rr('cos((isodow(open_time) - 1) * 2 * pi() / 7)', 'dow_cos')} FROM b""",
)
def hour_cyclic(spark, d):
    (hs, hc), (ds, dc) = S.cyclic(S.day_fraction(F.col("open_time")), 24), S.cyclic(F.weekday("open_time"), 7)
    return bars(spark, d).select(*KEY, r6(hs, "hour_sin"), r6(hc, "hour_cos"), r6(ds, "dow_sin"), r6(dc, "dow_cos"))


_OPEN = "NOT (dayofweek(open_time) = 6 OR (dayofweek(open_time) = 0 AND hour(open_time) < 22) OR (dayofweek(open_time) = 5 AND hour(open_time) >= 22))"


@query("market_open", f"WITH {BARS} SELECT symbol, open_time, {_OPEN} AS is_open, CASE WHEN NOT ({_OPEN}) THEN CAST(open_time::DATE + CAST((7 - dayofweek(open_time)) % 7 AS INTEGER) AS TIMESTAMP) + INTERVAL 22 HOUR END AS next_open FROM b")
def market_open(spark, d):
    t = F.col("open_time")
    return bars(spark, d).select(*KEY, S.forex_open(t).alias("is_open"), S.next_forex_open(t).alias("next_open"))


@query("asof_funding", f"WITH {BARS}, {POINTS} SELECT b.symbol, b.open_time, {rr('pts.funding', 'funding')} FROM b ASOF LEFT JOIN pts ON b.symbol = pts.symbol AND b.open_time >= pts.event_time")
def asof_funding(spark, d):
    return J.asof(bars(spark, d), points(spark, d), "funding").select(*KEY, r6("funding"))


@query("asof_ffill_zero", f"WITH {BARS}, {POINTS} SELECT b.symbol, b.open_time, {rr('coalesce(pts.funding, 0)', 'funding')} FROM b ASOF LEFT JOIN pts ON b.symbol = pts.symbol AND b.open_time >= pts.event_time")
def asof_ffill_zero(spark, d):
    return J.asof_filled(bars(spark, d), points(spark, d), "funding").select(*KEY, r6("funding"))


_ALIGNED = "a AS (SELECT * FROM b WHERE open_time IN (SELECT open_time FROM b GROUP BY 1 HAVING count(DISTINCT symbol) = (SELECT count(DISTINCT symbol) FROM b)))"


@query("align_common", f"WITH {BARS}, {_ALIGNED} SELECT symbol, open_time, close FROM a")
def align_common(spark, d):
    return J.align(bars(spark, d)).select(*KEY, "close")


_CROSS = f"c0 AS (SELECT *, coalesce(ln(close) - lag(ln(close)) OVER ({WSYM}), 0) AS ret FROM a), c AS (SELECT *, CASE WHEN count(*) OVER t > 1 THEN (sum(ret) OVER t - ret) / (count(*) OVER t - 1) END AS basket_ret, CASE WHEN symbol <> 'click' THEN max(CASE WHEN symbol = 'click' THEN ret END) OVER t END AS btc_ret FROM c0 WINDOW t AS (PARTITION BY open_time))"


@query("basket_rel_strength", f"WITH {BARS}, {_ALIGNED}, {_CROSS} SELECT symbol, open_time, {rr('basket_ret', 'basket_ret')}, {rr('btc_ret', 'btc_ret')}, {rr('ret - coalesce(basket_ret, 0)', 'rel_strength')} FROM c")
def basket_rel_strength(spark, d):
    rows = J.cross_section(J.align(bars(spark, d)), benchmark="click")
    return rows.select(*KEY, r6("basket_ret"), r6("btc_ret"), r6(F.col("ret") - F.coalesce("basket_ret", F.lit(0.0)), "rel_strength"))


_BDEN = f"stddev_pop(ret) OVER {frame(60)} * stddev_pop(coalesce(btc_ret, 0)) OVER {frame(60)}"


@query("btc_corr", f"WITH {BARS}, {_ALIGNED}, {_CROSS} SELECT symbol, open_time, {rr(f'coalesce(CASE WHEN count(*) OVER {frame(60)} = 60 AND {_BDEN} > 1e-12 THEN covar_pop(ret, coalesce(btc_ret, 0)) OVER {frame(60)} / ({_BDEN}) END, 0)', 'corr')} FROM c")
def btc_corr(spark, d):
    rows = J.cross_section(J.align(bars(spark, d)), benchmark="click").withColumn("b", F.coalesce("btc_ret", F.lit(0.0)))
    return rows.select(*KEY, r6(F.coalesce(W.correlation(F.col("ret"), F.col("b"), 60), F.lit(0.0)), "corr"))


@query("change_24h", f"WITH {BARS}, n AS (SELECT symbol, close, row_number() OVER (PARTITION BY symbol ORDER BY open_time DESC) AS k FROM b), m AS (SELECT symbol, max(k) AS mk FROM n WHERE k <= 288 GROUP BY 1) SELECT x.symbol, {rr('(x.close - y.close) / y.close * 100', 'change')} FROM n x JOIN m ON x.symbol = m.symbol JOIN n y ON y.symbol = m.symbol AND y.k = m.mk WHERE x.k = 1")
def change_24h(spark, d):
    return G.change_over(bars(spark, d)).select("symbol", r6("change"))


@query("forward_target", f"WITH {BARS}, f AS (SELECT *, lead(close, 3) OVER ({WSYM}) / close - 1 AS fr FROM b) SELECT symbol, open_time, {rr('fr', 'fwd_ret')}, CASE WHEN fr > 0.005 THEN 1 WHEN fr < -0.005 THEN 0 END AS target FROM f")
def forward_target(spark, d):
    return X.forward_target(bars(spark, d)).select(*KEY, r6("fwd_ret"), "target")


def _min5(expr: str, x: str) -> str:
    return f"CASE WHEN count({x}) OVER {frame(20)} >= 5 THEN {expr} OVER {frame(20)} END"


@query(
    "flow_proxy",
    f"""WITH {BARS}, f AS (SELECT *, sign(coalesce(close - lag(close) OVER ({WSYM}), 0)) * volume AS sv FROM b), g AS (SELECT *, {_min5('avg(sv)', 'sv')} AS m, {_min5('stddev_samp(sv)', 'sv')} AS sd FROM f)
    SELECT symbol, open_time, {rr('greatest(-5, least(5, coalesce(CASE WHEN sd > 0 THEN (sv - m) / sd END, 0)))', 'flow')} FROM g""",
)
def flow_proxy(spark, d):
    return X.flow_proxy(bars(spark, d)).select(*KEY, r6("flow"))


@query(
    "fx_vwap_deviation",
    f"""WITH {BARS}, f AS (SELECT *, {_min5(f'sum({_TP} * volume)', 'volume')} AS pv, {_min5('sum(volume)', 'volume')} AS v, {_min5('avg(volume)', 'volume')} AS m, {_min5('stddev_samp(volume)', 'volume')} AS sd FROM b),
    g AS (SELECT *, CASE WHEN v > 0 THEN pv / v END AS w0 FROM f), h AS (SELECT *, coalesce(w0, first_value(w0 IGNORE NULLS) OVER ({WSYM} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), last_value(w0 IGNORE NULLS) OVER ({WSYM} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS w FROM g)
    SELECT symbol, open_time, {rr('coalesce((close - w) / nullif(w, 0), 0)', 'vwap_deviation')}, {rr('coalesce(CASE WHEN sd > 0 THEN (volume - m) / sd END, 0)', 'volume_zscore')} FROM h""",
)
def fx_vwap_deviation(spark, d):
    return X.vwap_deviation(bars(spark, d), look_ahead=True).select(*KEY, r6("vwap_deviation"), r6("volume_zscore"))


# --- recursions: DuckDB by a recursive CTE over idx -----------------------------------------------------------------------

_STEP = f"""x AS (SELECT symbol, idx, open_time, close, high, low, coalesce(close - lag(close) OVER ({WSYM}), 0) AS d, coalesce(high - lag(high) OVER ({WSYM}), 0) AS u, coalesce(lag(low) OVER ({WSYM}) - low, 0) AS v,
  greatest(high - low, abs(high - coalesce(lag(close) OVER ({WSYM}), close)), abs(low - coalesce(lag(close) OVER ({WSYM}), close))) AS tr, coalesce({LN}, 0.0::DOUBLE) AS r0 FROM b)"""


def _wilder(name: str, exprs: dict[str, str], p: int, src: str = "x", first: int = 1) -> str:
    """A recursive CTE of Wilder means of several expressions of src."""
    at = first + p - 1
    seed = ", ".join(f"avg({e})::DOUBLE AS {k}" for k, e in exprs.items())
    step = ", ".join(f"({name}.{k} * {p - 1} + ({e})) / {p}" for k, e in exprs.items())
    return f"{name} AS (SELECT symbol, {at}::BIGINT AS idx, {seed} FROM {src} WHERE idx BETWEEN {first} AND {at} GROUP BY symbol HAVING count(*) = {p} UNION ALL SELECT {name}.symbol, {name}.idx + 1, {step} FROM {name} JOIN {src} ON {src}.symbol = {name}.symbol AND {src}.idx = {name}.idx + 1)"


def _rsi_sql(g: str, l: str) -> str:
    return f"CASE WHEN {l} = 0 THEN 100 WHEN {g} = 0 THEN 0 ELSE 100 - 100 / (1 + {g} / {l}) END"


@query("rsi", f"WITH RECURSIVE {BARS}, {_STEP}, {_wilder('w', {'g': 'greatest(d, 0)', 'l': 'greatest(-d, 0)'}, 14)} SELECT x.symbol, x.open_time, {rr(_rsi_sql('g', 'l'), 'rsi14')} FROM x LEFT JOIN w USING (symbol, idx)")
def rsi(spark, d):
    return R.with_recursive(plain_bars(spark, d), ("rsi14",)).select(*KEY, r6("rsi14"))


@query("atr", f"WITH RECURSIVE {BARS}, {_STEP}, {_wilder('w', {'a': 'tr'}, 14)} SELECT x.symbol, x.open_time, {rr('a', 'atr14')} FROM x LEFT JOIN w USING (symbol, idx)")
def atr(spark, d):
    return R.with_recursive(plain_bars(spark, d), ("atr14",)).select(*KEY, r6("atr14"))


_DX = "100 * abs(p - m) / (p + m)"


@query(
    "adx",
    f"""WITH RECURSIVE {BARS}, {_STEP}, {_wilder('w', {'t': 'tr', 'p': 'CASE WHEN u > v AND u > 0 THEN u ELSE 0 END', 'm': 'CASE WHEN v > u AND v > 0 THEN v ELSE 0 END'}, 14)},
    dx AS (SELECT symbol, idx, CASE WHEN t > 0 AND p + m > 0 THEN {_DX} ELSE 0.0 END AS dx FROM w), {_wilder('a', {'adx': 'dx.dx'}, 14, 'dx', 14)}
    SELECT x.symbol, x.open_time, {rr('adx', 'adx14')} FROM x LEFT JOIN a USING (symbol, idx)""",
)
def adx(spark, d):
    return R.with_recursive(plain_bars(spark, d), ("adx14",)).select(*KEY, r6("adx14"))


def _k(span: int) -> str:
    return f"({2 / (span + 1)!r}::DOUBLE)"


_MACD = f"""e AS (SELECT symbol, idx::BIGINT AS idx, close AS e12, close AS e26, 0.0::DOUBLE AS sig FROM b WHERE idx = 0
    UNION ALL SELECT e.symbol, e.idx + 1, {_k(12)} * b.close + (1 - {_k(12)}) * e12, {_k(26)} * b.close + (1 - {_k(26)}) * e26,
      {_k(9)} * (({_k(12)} * b.close + (1 - {_k(12)}) * e12) - ({_k(26)} * b.close + (1 - {_k(26)}) * e26)) + (1 - {_k(9)}) * sig FROM e JOIN b ON b.symbol = e.symbol AND b.idx = e.idx + 1)"""


@query("macd", f"WITH RECURSIVE {BARS}, {_MACD} SELECT b.symbol, b.open_time, {rr('e12', 'ema12')}, {rr('e26', 'ema26')}, {rr('(e12 - e26 - sig) / close', 'macd_hist_norm')} FROM b JOIN e USING (symbol, idx)")
def macd(spark, d):
    rows = R.with_recursive(plain_bars(spark, d), ("ema12", "ema26", "macd", "macd_signal"))
    return rows.select(*KEY, r6("ema12"), r6("ema26"), r6((F.col("macd") - F.col("macd_signal")) / F.col("close"), "macd_hist_norm"))


_EWMA = f"v AS (SELECT symbol, idx::BIGINT AS idx, r0 * r0 AS v FROM x WHERE idx = 0 UNION ALL SELECT v.symbol, v.idx + 1, {_k(20)} * x.r0 * x.r0 + (1 - {_k(20)}) * v.v FROM v JOIN x ON x.symbol = v.symbol AND x.idx = v.idx + 1)"


@query("ewma_vol", f"WITH RECURSIVE {BARS}, {_STEP}, {_EWMA} SELECT x.symbol, x.open_time, {rr('sqrt(v.v)', 'ewma_vol')} FROM x JOIN v USING (symbol, idx)")
def ewma_vol(spark, d):
    return R.with_recursive(plain_bars(spark, d), ("ewma_vol",)).select(*KEY, r6("ewma_vol"))


# --- signals --------------------------------------------------------------------------------------------------------------

_SIG = f"""{_STEP}, {_wilder('w', {'g': 'greatest(d, 0)', 'l': 'greatest(-d, 0)'}, 14)},
y AS (SELECT b.*, {full('avg(close)', 'close', 50)} AS sma, {full('avg(close)', 'close', 20)} AS m, {full('stddev_pop(close)', 'close', 20)} AS sd, {_VWAP_DAY} AS vw FROM b),
z AS (SELECT y.*, CASE WHEN g IS NOT NULL THEN {_rsi_sql('g', 'l')} END AS rsi, 4 * sd / m AS bw, CASE WHEN close > m + 2 * sd THEN 'UPPER' WHEN close < m - 2 * sd THEN 'LOWER' END AS bo FROM y LEFT JOIN w USING (symbol, idx)),
q AS (SELECT *, CASE WHEN sma IS NULL OR rsi IS NULL THEN 'insufficient-data' WHEN bw < 0.004 AND bo IS NULL THEN 'sideways-range' WHEN close > sma AND rsi BETWEEN 40 AND 60 THEN 'spec-up' WHEN close <= sma AND rsi > 65 THEN 'spec-down'
  WHEN close > sma AND rsi > 70 AND bo = 'UPPER' THEN 'reversal-down' WHEN close <= sma AND rsi < 40 THEN 'trend-down' WHEN rsi < 30 AND bo = 'LOWER' THEN 'bounce-up' ELSE 'no-rule-matched' END AS rule0 FROM z),
k AS (SELECT *, CASE WHEN rule0 IN ('spec-up', 'bounce-up') THEN 'UP' WHEN rule0 IN ('spec-down', 'reversal-down', 'trend-down') THEN 'DOWN' ELSE 'NEUTRAL' END AS call FROM q),
sc AS (SELECT *, 40 + least(abs(close - sma) / sma * 400, 20) + CASE WHEN call = 'UP' AND rsi BETWEEN 45 AND 60 THEN 12 ELSE 0 END + CASE WHEN call = 'DOWN' AND rsi >= 65 THEN 12 ELSE 0 END + CASE WHEN call = 'DOWN' AND rsi < 40 THEN 8 ELSE 0 END
  + CASE WHEN vw IS NULL THEN 0 WHEN (call = 'UP' AND close > vw) OR (call = 'DOWN' AND close < vw) THEN 12 ELSE -8 END + CASE WHEN bw > 0.008 AND bw < 0.06 THEN 10 WHEN bw >= 0.06 THEN -10 ELSE 0 END
  + CASE WHEN (call = 'UP' AND bo = 'UPPER') OR (call = 'DOWN' AND bo = 'LOWER') THEN 6 ELSE 0 END AS score FROM k),
cf AS (SELECT *, CAST(CASE WHEN rule0 = 'insufficient-data' THEN 0 WHEN call = 'NEUTRAL' THEN 30 ELSE greatest(0, least(95, floor(score + 0.5))) END AS INTEGER) AS confidence FROM sc),
sg AS (SELECT symbol, open_time, close, rsi, confidence, CASE WHEN call <> 'NEUTRAL' AND confidence < 62 THEN 'NEUTRAL' ELSE call END AS signal, CASE WHEN call <> 'NEUTRAL' AND confidence < 62 THEN rule0 || '-below-threshold' ELSE rule0 END AS rule FROM cf)"""


@query("signal_cascade", f"WITH RECURSIVE {BARS}, {_SIG} SELECT symbol, open_time, signal, confidence, rule FROM sg")
def signal_cascade(spark, d):
    return G.with_signals(bars(spark, d)).select(*KEY, "signal", "confidence", "rule")


@query("signal_dashboard", f"WITH RECURSIVE {BARS}, {_SIG} SELECT symbol, open_time, close, {rr('rsi', 'rsi')}, signal, confidence, rule FROM sg QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY open_time DESC) = 1")
def signal_dashboard(spark, d):
    return G.latest(G.with_signals(bars(spark, d))).select(*KEY, "close", r6("rsi"), "signal", "confidence", "rule")


@query("signal_counts", f"WITH RECURSIVE {BARS}, {_SIG} SELECT symbol, count(*) FILTER (signal = 'UP') AS up, count(*) FILTER (signal = 'DOWN') AS down, count(*) FILTER (signal = 'NEUTRAL') AS neutral FROM sg GROUP BY symbol")
def signal_counts(spark, d):
    s = F.col("signal")
    return G.with_signals(bars(spark, d)).groupBy("symbol").agg(F.count_if(s == "UP").alias("up"), F.count_if(s == "DOWN").alias("down"), F.count_if(s == "NEUTRAL").alias("neutral"))


@query(
    "entry_window",
    f"""WITH RECURSIVE {BARS}, {_STEP}, {_wilder('w', {'g': 'greatest(d, 0)', 'l': 'greatest(-d, 0)'}, 14)}, i AS (SELECT b.*, {_rsi_sql('g', 'l')} AS rsi FROM b JOIN w USING (symbol, idx) WHERE open_time BETWEEN {AS_OF_SQL} - INTERVAL 12 HOUR AND {AS_OF_SQL} AND symbol IN (SELECT symbol FROM b WHERE open_time <= {AS_OF_SQL} GROUP BY symbol HAVING count(*) >= 19)),
    j AS (SELECT *, avg(volume) OVER (PARTITION BY symbol) AS mv, min(rsi) OVER (PARTITION BY symbol) AS lowest_rsi FROM i), k AS (SELECT *, CASE WHEN mv > 0 THEN volume / mv ELSE 1 END AS vr FROM j),
    s AS (SELECT *, 0.65 * (100 - rsi) / 100 + 0.35 * least(vr, 3) / 3 AS score FROM k)
    SELECT symbol, open_time, close, {rr('rsi', 'rsi14')}, {rr('vr', 'volume_ratio')}, {rr('close * 0.97', 'stop_loss')}, {rr('lowest_rsi', 'lowest_rsi')}, CASE WHEN score >= 0.6 THEN 'strong' WHEN score >= 0.45 THEN 'moderate' ELSE 'weak' END AS quality
    FROM s QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY round(score, 12) DESC, open_time) = 1""",
)
def entry_window(spark, d):
    found = G.entry_windows(R.with_recursive(plain_bars(spark, d), ("rsi14",)), as_of(), p=G.PROFILES["conservative"])
    return found.select(*KEY, "close", r6("entry_rsi", "rsi14"), r6("volume_ratio"), r6("stop_loss"), r6("lowest_rsi"), "quality")


@query(
    "combine_signals",
    """WITH o AS (SELECT o_orderkey AS id, ['UP', 'DOWN', 'NEUTRAL'][o_orderkey % 3 + 1] AS hs, CAST(30 + o_orderkey % 66 AS INTEGER) AS hc, ['UP', 'DOWN'][o_custkey % 2 + 1] AS ms, CAST(40 + o_custkey % 60 AS INTEGER) AS mc, o_orderstatus <> 'P' AS av, o_custkey % 7 <> 0 AS va FROM orders)
    SELECT id, CASE WHEN NOT av OR NOT va THEN hs WHEN hs = 'NEUTRAL' THEN ms WHEN hs = ms THEN hs ELSE 'NEUTRAL' END AS signal,
    CAST(CASE WHEN NOT av OR NOT va THEN hc WHEN hs = 'NEUTRAL' THEN least(mc, 70) WHEN hs = ms THEN least(95, hc + 8) ELSE 35 END AS INTEGER) AS confidence,
    CASE WHEN NOT av OR NOT va THEN 'heuristic' WHEN hs = 'NEUTRAL' THEN 'ml' WHEN hs = ms THEN 'both' ELSE 'conflict' END AS source FROM o""",
)
def combine_signals(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    hs = F.when(k % 3 == 0, "UP").when(k % 3 == 1, "DOWN").otherwise("NEUTRAL")
    both = G.combine(hs, (30 + k % 66).cast("int"), F.when(c % 2 == 0, "UP").otherwise("DOWN"), (40 + c % 60).cast("int"), F.col("o_orderstatus") != "P", c % 7 != 0)
    return table(spark, d, "orders").select(k.alias("id"), both.alias("s")).select("id", "s.*")


# --- features and labels ----------------------------------------------------------------------------------------------------


_CONTEXT = f"""{_CROSS.replace('FROM a)', 'FROM b)')}, src AS (SELECT c.*, pts.funding AS funding_rate, high * (volume + 1) AS open_interest, high / low AS top_trader_ratio
  FROM c ASOF LEFT JOIN pts ON c.symbol = pts.symbol AND c.open_time >= pts.event_time)"""
_NO_CONTEXT = "src AS (SELECT b.*, NULL::DOUBLE AS basket_ret, NULL::DOUBLE AS btc_ret, NULL::DOUBLE AS funding_rate, NULL::DOUBLE AS open_interest, NULL::DOUBLE AS top_trader_ratio FROM b)"
_FDEN = f"stddev_pop(r0) OVER {frame(60)} * stddev_pop(btc) OVER {frame(60)}"


def _has(c: str) -> str:
    return f"count({c}) OVER (PARTITION BY symbol) > 0"


#: FEATURE_NAMES in SQL, over f2 of _FEATURES.
_FEATURE_SQL = {
    "rsi_14_c": "rsi14 / 100 - 0.5", "rsi_9_c": "rsi9 / 100 - 0.5", "rsi_slope": f"(rsi14 - lag(rsi14, 3) OVER ({WSYM})) / 100", "log_p_sma20": "ln(close / m20)", "log_p_sma50": "ln(close / m50)",
    "bb_pctb_c": "CASE WHEN sd > 0 THEN (close - m20 + 2 * sd) / (4 * sd) ELSE 0.5 END - 0.5", "bb_bandwidth": "coalesce(4 * sd / m20, 0)", "log_p_vwap": "ln(close / vw)",
    **{f"ret_{k}": f"ln(close) - lag(ln(close), {k}) OVER ({WSYM})" for k in (1, 3, 6, 12)},
    "vol_12": "v12", "vol_ratio": "CASE WHEN v48 > 0 THEN v12 / v48 ELSE 1 END", "atr_norm": "atr / close", "volume_z": _z("volume", 48), "macd_hist_norm": "hist / close",
    "hour_sin": f"sin({_H} * 2 * pi() / 24)", "hour_cos": f"cos({_H} * 2 * pi() / 24)", "adx_norm": "adx / 100",
    "rel_strength_basket": f"CASE WHEN {_has('basket_ret')} THEN r0 - coalesce(basket_ret, 0) ELSE 0 END",
    "corr_to_btc": f"CASE WHEN {_has('btc_ret')} THEN coalesce(CASE WHEN count(*) OVER {frame(60)} = 60 AND {_FDEN} > 1e-12 THEN covar_pop(r0, btc) OVER {frame(60)} / ({_FDEN}) END, 0) ELSE 0 END",
    "funding_z": _z("funding_rate", 288), "oi_roc_z": f"CASE WHEN {_has('open_interest')} THEN {_z('oi_roc', 48)} ELSE 0 END", "top_trader_z": _z("top_trader_ratio", 48),
}
_MOVES = {"t": "tr", "p": "CASE WHEN u > v AND u > 0 THEN u ELSE 0 END", "m": "CASE WHEN v > u AND v > 0 THEN v ELSE 0 END"}
_FEATURES = f"""{_STEP}, {_wilder('w14', {'g': 'greatest(d, 0)', 'l': 'greatest(-d, 0)', 'atr': 'tr'}, 14)}, {_wilder('w9', {'g9': 'greatest(d, 0)', 'l9': 'greatest(-d, 0)'}, 9)}, {_wilder('w', _MOVES, 14)},
dx AS (SELECT symbol, idx, CASE WHEN t > 0 AND p + m > 0 THEN {_DX} ELSE 0.0 END AS dx FROM w), {_wilder('a14', {'adx': 'dx.dx'}, 14, 'dx', 14)}, {_MACD},
f0 AS (SELECT src.*, coalesce({LN}, 0.0::DOUBLE) AS r0, coalesce(btc_ret, 0.0::DOUBLE) AS btc, coalesce(ln(open_interest / CASE WHEN lag(open_interest, 12) OVER ({WSYM}) > 0 THEN lag(open_interest, 12) OVER ({WSYM}) END), 0.0::DOUBLE) AS oi_roc,
  {full('avg(close)', 'close', 20)} AS m20, {full('avg(close)', 'close', 50)} AS m50, {full('stddev_pop(close)', 'close', 20)} AS sd, {_VWAP48} AS vw FROM src),
f1 AS (SELECT *, {full('stddev_pop(r0)', 'r0', 12)} AS v12, {full('stddev_pop(r0)', 'r0', 48)} AS v48 FROM f0),
f2 AS (SELECT f1.*, {_rsi_sql('g', 'l')} AS rsi14, {_rsi_sql('g9', 'l9')} AS rsi9, atr, adx, e12 - e26 - sig AS hist
  FROM f1 LEFT JOIN w14 USING (symbol, idx) LEFT JOIN w9 USING (symbol, idx) LEFT JOIN a14 USING (symbol, idx) LEFT JOIN e USING (symbol, idx)),
f3 AS (SELECT symbol, open_time, count(*) OVER (PARTITION BY symbol) AS n_bars, {', '.join(rr(v, k) for k, v in _FEATURE_SQL.items())} FROM f2),
ft AS (SELECT *, {' AND '.join(f'{k} IS NOT NULL' for k in _FEATURE_SQL)} AS valid FROM f3)"""


@query("feature_matrix", f"WITH RECURSIVE {BARS}, {POINTS}, {_CONTEXT}, {_FEATURES} SELECT * EXCLUDE (n_bars) FROM ft")
def feature_matrix(spark, d):
    """All 25 features; open interest and the traders' ratio are stand-ins of the bar's volume and range."""
    rows = J.cross_section(bars(spark, d), benchmark="click")
    rows = J.asof(rows, points(spark, d), "funding").withColumnRenamed("funding", "funding_rate")
    rows = rows.withColumn("open_interest", F.col("high") * (F.col("volume") + 1)).withColumn("top_trader_ratio", F.col("high") / F.col("low"))
    return X.build_features(rows).select(*KEY, *(r6(c) for c in X.FEATURE_NAMES), "valid")


@query(
    "feature_window_columns",
    f"""WITH {RET0}, v AS (SELECT *, {full('avg(close)', 'close', 20)} AS m20, {full('avg(close)', 'close', 50)} AS m50, {full('stddev_pop(close)', 'close', 20)} AS sd, {_VWAP48} AS vw FROM r)
    SELECT symbol, open_time, {rr('ln(close / m20)', 'log_p_sma20')}, {rr('ln(close / m50)', 'log_p_sma50')}, {rr('coalesce(CASE WHEN sd > 0 THEN (close - (m20 - 2 * sd)) / (4 * sd) END, 0.5) - 0.5', 'bb_pctb_c')},
    {rr('coalesce(4 * sd / m20, 0)', 'bb_bandwidth')}, {rr('ln(close / vw)', 'log_p_vwap')} FROM v""",
)
def feature_window_columns(spark, d):
    return X.build_features(bars(spark, d)).select(*KEY, *(r6(c) for c in ("log_p_sma20", "log_p_sma50", "bb_pctb_c", "bb_bandwidth", "log_p_vwap")))


@query("latest_feature_vector", f"WITH RECURSIVE {BARS}, {_NO_CONTEXT}, {_FEATURES} SELECT * EXCLUDE (n_bars) FROM ft WHERE n_bars >= 60 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY open_time DESC) = 1")
def latest_feature_vector(spark, d):
    return X.latest_vector(X.build_features(bars(spark, d))).select(*KEY, *(r6(c) for c in X.FEATURE_NAMES), "valid")


_STOCHASTIC = f"""{BARS}, f AS (SELECT *, min(low) OVER {frame(14)} AS lo, max(high) OVER {frame(14)} AS hi, sign(coalesce(close - lag(close) OVER ({WSYM}), 0)) * volume AS o, {_TP} * volume AS mf, sign({_TP} - lag({_TP}) OVER ({WSYM})) AS rise FROM b),
    g AS (SELECT *, {full('sum(CASE WHEN rise > 0 THEN mf ELSE 0 END)', 'close', 14)} AS up, {full('sum(CASE WHEN rise < 0 THEN mf ELSE 0 END)', 'close', 14)} AS dn FROM f)"""
_STOCH_K = f"CASE WHEN count(*) OVER {frame(14)} = 14 THEN CASE WHEN hi > lo THEN (close - lo) / (hi - lo) * 100 ELSE 50 END END"
_OBV_MFI = f"{rr(f'sum(o) OVER ({WSYM} ROWS UNBOUNDED PRECEDING)', 'obv')}, {rr('CASE WHEN dn > 0 THEN 100 - 100 / (1 + up / dn) WHEN dn = 0 THEN 100 END', 'mfi')}"


@query("technical_columns", f"WITH {_STOCHASTIC}, h AS (SELECT *, {_STOCH_K} AS k FROM g) SELECT symbol, open_time, {rr('k', 'stoch_k')}, {rr(full('avg(k)', 'k', 3), 'stoch_d')}, {_OBV_MFI} FROM h")
def technical_columns(spark, d):
    return X.technical_columns(bars(spark, d)).select(*KEY, r6("stoch_k"), r6("stoch_d"), r6("obv"), r6("mfi"))


@query("stochastic_obv_mfi", f"WITH {_STOCHASTIC} SELECT symbol, open_time, {rr(_STOCH_K, 'stoch_k')}, {_OBV_MFI} FROM g")
def stochastic_obv_mfi(spark, d):
    return X.technical_columns(bars(spark, d)).select(*KEY, r6("stoch_k"), r6("obv"), r6("mfi"))


def _sigma_rows(spark, d):
    """Bars with a 20-bar deviation of returns as sigma, which SQL can share."""
    rows = bars(spark, d).withColumn("r0", F.coalesce(W.log_return(F.col("close")), F.lit(0.0)))
    return rows.withColumn("sigma", W.std(F.col("r0"), 20))


_LABEL = f"""{RET0}, sg AS (SELECT symbol, open_time, idx, ln(close) AS lp, {full('stddev_pop(r0)', 'r0', 20)} AS sigma FROM r),
h AS (SELECT i.symbol, i.idx, i.lp, i.sigma, min(j.idx) FILTER (j.lp >= i.lp + 2 * i.sigma OR j.lp <= i.lp - i.sigma) AS hit, count(j.idx) AS n FROM sg i LEFT JOIN sg j ON j.symbol = i.symbol AND j.idx BETWEEN i.idx + 1 AND i.idx + 24 WHERE i.sigma > 0 GROUP BY ALL),
lb AS (SELECT sg.symbol, sg.open_time, sg.idx, coalesce(CASE WHEN k.lp >= h.lp + 2 * h.sigma THEN 1 WHEN k.lp IS NOT NULL THEN -1 END, 0) AS label, CASE WHEN h.hit IS NOT NULL THEN h.hit WHEN h.n = 24 THEN sg.idx + 24 ELSE sg.idx END AS touch_idx,
  coalesce(k.lp, CASE WHEN h.n = 24 THEN e.lp END) - sg.lp AS ret, h.hit IS NOT NULL OR coalesce(h.n = 24, false) AS labelable
  FROM sg LEFT JOIN h USING (symbol, idx) LEFT JOIN sg k ON k.symbol = sg.symbol AND k.idx = h.hit LEFT JOIN sg e ON e.symbol = sg.symbol AND e.idx = sg.idx + 24)"""


@query("triple_barrier", f"WITH {_LABEL} SELECT symbol, open_time, label, touch_idx, {rr('ret', 'realised_return')}, labelable FROM lb")
def triple_barrier(spark, d):
    return X.triple_barrier(_sigma_rows(spark, d), "sigma").select(*KEY, "label", "touch_idx", r6("realised_return"), "labelable")


def _spans(spark, d):
    rows = X.triple_barrier(_sigma_rows(spark, d), "sigma")
    return rows, rows.filter("labelable").select("symbol", "idx", "touch_idx", "realised_return")


_OPEN_SPANS = f"{_LABEL}, sp AS (SELECT * FROM lb WHERE labelable), cc AS (SELECT b.symbol, b.idx, b.open_time, count(sp.idx) AS open_spans FROM b LEFT JOIN sp ON sp.symbol = b.symbol AND b.idx BETWEEN sp.idx AND sp.touch_idx GROUP BY ALL)"


@query("concurrency", f"WITH {_OPEN_SPANS} SELECT symbol, open_time, open_spans FROM cc")
def concurrency(spark, d):
    rows, spans = _spans(spark, d)
    return J.concurrency(rows, spans.withColumnsRenamed({"idx": "start", "touch_idx": "end"})).select(*KEY, F.col("open_spans").cast("long").alias("open_spans"))


_UNIQ = f"{_OPEN_SPANS}, uq AS (SELECT sp.symbol, sp.idx, sp.ret, avg(1.0::DOUBLE / greatest(cc.open_spans, 1)) AS u FROM sp JOIN cc ON cc.symbol = sp.symbol AND cc.idx BETWEEN sp.idx AND sp.touch_idx GROUP BY ALL)"


@query("uniqueness", f"WITH {_UNIQ} SELECT symbol, idx, {rr('u', 'uniqueness')} FROM uq")
def uniqueness(spark, d):
    rows, spans = _spans(spark, d)
    return J.uniqueness(rows, spans.withColumnsRenamed({"idx": "start", "touch_idx": "end"})).select("symbol", F.col("start").alias("idx"), r6("uniqueness"))


@query(
    "sample_weights",
    f"""WITH {_UNIQ}, w AS (SELECT *, u * abs(ret) * (0.5 + 0.5 * (row_number() OVER (PARTITION BY symbol ORDER BY idx) - 1) / nullif(count(*) OVER (PARTITION BY symbol) - 1, 0)) AS w0 FROM uq)
    SELECT symbol, idx, {rr('w0 / avg(w0) OVER (PARTITION BY symbol)', 'weight')} FROM w""",
)
def sample_weights(spark, d):
    rows, spans = _spans(spark, d)
    return X.sample_weights(rows, spans).select("symbol", "idx", r6("weight"))


@query("time_decay", f"WITH {BARS} SELECT symbol, open_time, {rr('0.5 + 0.5 * idx / (count(*) OVER (PARTITION BY symbol) - 1)', 'weight')} FROM b")
def time_decay(spark, d):
    return bars(spark, d).select(*KEY, r6(X.time_decay(), "weight"))


@query("average_uniqueness", f"WITH {_UNIQ} SELECT symbol, {rr('avg(u)', 'average_uniqueness')} FROM uq GROUP BY symbol")
def average_uniqueness(spark, d):
    rows, spans = _spans(spark, d)
    return J.uniqueness(rows, spans.withColumnsRenamed({"idx": "start", "touch_idx": "end"})).groupBy("symbol").agg(r6(F.avg("uniqueness"), "average_uniqueness"))


_RSI_CTE = _wilder("w", {"g": "greatest(d, 0)", "l": "greatest(-d, 0)"}, 14)


@query(
    "heuristic",
    f"""WITH RECURSIVE {BARS}, {_STEP}, {_RSI_CTE}, {_BB}, y AS (SELECT bb.*, {full('avg(close)', 'close', 50)} AS s FROM bb), z AS (SELECT y.*, {_rsi_sql('g', 'l')} AS rsi, 4 * sd / m AS bw FROM y JOIN w USING (symbol, idx) WHERE s IS NOT NULL)
    SELECT symbol, open_time, CAST(CASE WHEN bw < 0.004 THEN -1 WHEN ln(close / s) > 0 AND rsi BETWEEN 40 AND 60 THEN 1 WHEN NOT ln(close / s) > 0 AND (rsi > 65 OR rsi < 40) THEN 0 ELSE -1 END AS INTEGER) AS heuristic FROM z""",
)
def heuristic(spark, d):
    rows = X.build_features(bars(spark, d)).filter(F.col("log_p_sma50").isNotNull())
    return rows.select(*KEY, G.heuristic(F.col("log_p_sma50"), F.col("rsi_14_c"), F.col("bb_bandwidth")).cast("int").alias("heuristic"))


@query("regime_counts", f"""WITH RECURSIVE {BARS}, {_STEP}, {_wilder('w', {'t': 'tr', 'p': 'CASE WHEN u > v AND u > 0 THEN u ELSE 0 END', 'm': 'CASE WHEN v > u AND v > 0 THEN v ELSE 0 END'}, 14)},
    dx AS (SELECT symbol, idx, CASE WHEN t > 0 AND p + m > 0 THEN {_DX} ELSE 0.0 END AS dx FROM w), {_wilder('a', {'adx': 'dx.dx'}, 14, 'dx', 14)}
    SELECT symbol, CASE WHEN adx > 25 THEN 'trending' ELSE 'ranging' END AS regime, count(*) AS n FROM x LEFT JOIN a USING (symbol, idx) GROUP BY ALL""")
def regime_counts(spark, d):
    return R.with_recursive(plain_bars(spark, d), ("adx14",)).groupBy("symbol", X.regime(F.col("adx14")).alias("regime")).agg(F.count("*").alias("n"))


@query("meta_target", f"WITH {_LABEL} SELECT symbol, idx, CASE WHEN idx % 3 > 0 THEN CASE WHEN (idx % 3 = 2 AND ret > 0) OR (idx % 3 = 1 AND ret < 0) THEN 1 ELSE 0 END END AS meta FROM lb WHERE labelable")
def meta_target(spark, d):
    _, spans = _spans(spark, d)
    return spans.select("symbol", "idx", X.meta_target((F.col("idx") % 3 - 1).cast("int"), F.col("realised_return")).alias("meta"))


@query("dataset_views", f"WITH {_LABEL} SELECT symbol, count(*) AS full_rows, count(*) FILTER (label <> 0) AS binary_rows, count(*) FILTER (label = 1) AS up_rows FROM lb WHERE labelable GROUP BY symbol")
def dataset_views(spark, d):
    rows = X.triple_barrier(_sigma_rows(spark, d), "sigma").filter("labelable")
    return rows.groupBy("symbol").agg(F.count("*").alias("full_rows"), F.count_if(F.col("label") != 0).alias("binary_rows"), F.count_if(F.col("label") == 1).alias("up_rows"))


@query("chart_range", f"WITH {BARS}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY open_time DESC) AS k FROM b), m AS (SELECT symbol, min(close) AS lo, max(close) AS hi, arg_min(close, open_time) AS a, arg_max(close, open_time) AS z FROM n WHERE k <= 288 GROUP BY 1), p AS (SELECT *, CASE WHEN hi > lo THEN (hi - lo) * 0.08 ELSE hi * 0.01 END AS pad FROM m) SELECT symbol, {rr('lo - pad', 'y_min')}, {rr('hi + pad', 'y_max')}, z >= a AS rising FROM p")
def chart_range(spark, d):
    last = bars(spark, d).withColumn("k", F.row_number().over(by_symbol().orderBy(F.desc("open_time")))).filter("k <= 288")
    m = last.groupBy("symbol").agg(F.min("close").alias("lo"), F.max("close").alias("hi"), F.min_by("close", "open_time").alias("a"), F.max_by("close", "open_time").alias("z"))
    pad = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) * 0.08).otherwise(F.col("hi") * 0.01)
    return m.select("symbol", r6(F.col("lo") - pad, "y_min"), r6(F.col("hi") + pad, "y_max"), (F.col("z") >= F.col("a")).alias("rising"))


@query("candle_cache", f"WITH {BARS} SELECT symbol, open_time, open, high, low, close, volume FROM b")
def candle_cache(spark, d):
    """Bars into one array for each symbol, and back."""
    from marketloom.sources.bars import cache_of_bars, candles_of_cache

    rows = candles_of_cache(cache_of_bars(bars(spark, d)))
    return rows.withColumn("open_time", F.col("open_time").cast("timestamp_ntz")).select(*KEY, "open", "high", "low", "close", "volume")


# --- live scores: models by rule, so that SQL can share them ----------------------------------------------------------------

#: Coefficients of the two regimes' models, in the features' order.
_COEF = {"trending": [((7 * i) % 11 - 5) / 10 for i in range(25)], "ranging": [((5 * i) % 13 - 6) / 8 for i in range(25)]}
_LOGIT = {r: " + ".join(["0.1"] + [f"{c!r}::DOUBLE * ({n} - 0.01) / 0.5" for n, c in zip(X.FEATURE_NAMES, cs)]) for r, cs in _COEF.items()}


@query(
    "live_scores",
    f"""WITH RECURSIVE {BARS}, {POINTS}, {_CONTEXT}, {_FEATURES}, la AS (SELECT * FROM ft QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY open_time DESC) = 1),
    re AS (SELECT *, CASE WHEN adx_norm * 100 > 25 THEN 'trending' ELSE 'ranging' END AS regime FROM la WHERE valid AND symbol <> 'error'),
    pr AS (SELECT symbol, open_time, regime, 1 / (1 + exp(-(CASE WHEN regime = 'trending' THEN {_LOGIT['trending']} ELSE {_LOGIT['ranging']} END))) AS p FROM re WHERE NOT (symbol = 'view' AND regime = 'trending'))
    SELECT symbol, open_time, b.close, regime, {rr('p', 'p_up', 4)}, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS direction, {rr('abs(p - 0.5) * 2', 'confidence', 4)}, abs(p - 0.5) * 2 >= 0.6 AS emitted FROM pr JOIN b USING (symbol, open_time)""",
)
def live_scores(spark, d):
    """Each symbol's last bar by its regime's model; one symbol has no models, one has none for trends."""
    rows = J.asof(J.cross_section(bars(spark, d), benchmark="click"), points(spark, d), "funding").withColumnRenamed("funding", "funding_rate")
    rows = rows.withColumn("open_interest", F.col("high") * (F.col("volume") + 1)).withColumn("top_trader_ratio", F.col("high") / F.col("low"))
    same = lambda v: F.array(*[F.lit(v)] * 25)
    model = {r: F.struct(F.lit(0.1).alias("intercept"), same(0.01).alias("mean"), same(0.5).alias("scale"), F.array(*map(F.lit, c)).alias("coef")) for r, c in _COEF.items()}
    both, one = F.create_map(F.lit("trending"), model["trending"], F.lit("ranging"), model["ranging"]), F.create_map(F.lit("ranging"), model["ranging"])
    models = rows.filter("symbol <> 'error'").select("symbol").distinct().withColumn("models", F.when(F.col("symbol") == "view", one).otherwise(both))
    found = score_latest(X.build_features(rows), models)
    return found.select(*KEY, "close", "regime", r6("p_up", digits=4), "direction", r6("confidence", digits=4), "emitted")
