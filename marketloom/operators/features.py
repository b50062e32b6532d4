"""The 25 features of a bar, triple-barrier labels, sample weights, targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marketloom.functions import windows as W
from marketloom.functions.scalars import cyclic, day_fraction
from marketloom.operators.joins import uniqueness
from marketloom.operators.recursive import with_recursive
from marketloom.operators.signals import bollinger
from marketloom.sources.bars import by_symbol, with_index

#: Fixed order: a model's coefficients follow it.
FEATURE_NAMES = (
    "rsi_14_c rsi_9_c rsi_slope log_p_sma20 log_p_sma50 bb_pctb_c bb_bandwidth log_p_vwap ret_1 ret_3 ret_6 ret_12 vol_12 vol_ratio atr_norm volume_z macd_hist_norm hour_sin hour_cos adx_norm rel_strength_basket corr_to_btc funding_z oi_roc_z top_trader_z"
).split()
CONTEXT = ("basket_ret", "btc_ret", "funding_rate", "open_interest", "top_trader_ratio")


def build_features(bars: DataFrame) -> DataFrame:
    """bars with FEATURE_NAMES and valid behind. Context columns (CONTEXT) may be missing or NULL: their features are then 0."""
    rows = with_recursive(with_index(bars), ("rsi14", "rsi9", "macd", "macd_signal", "atr14", "adx14", "ewma_vol"))
    for c in CONTEXT:
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast("double"))
    w, close = by_symbol(), F.col("close")
    rows = rows.withColumn("r0", F.coalesce(W.log_return(close), F.lit(0.0)))
    r0, oi = F.col("r0"), F.col("open_interest")
    rows = rows.withColumn("oi_roc", F.coalesce(F.ln(oi / F.when(F.lag(oi, 12).over(w) > 0, F.lag(oi, 12).over(w))), F.lit(0.0)))
    bb, v12, v48 = bollinger(close, 20), W.std(r0, 12), W.std(r0, 48)
    hour_sin, hour_cos = cyclic(day_fraction(F.col("open_time")), 24)
    has = {c: F.max(F.col(c).isNotNull().cast("int")).over(Window.partitionBy("symbol")) == 1 for c in CONTEXT}
    columns = {
        "rsi_14_c": F.col("rsi14") / 100 - 0.5, "rsi_9_c": F.col("rsi9") / 100 - 0.5, "rsi_slope": (F.col("rsi14") - F.lag("rsi14", 3).over(w)) / 100,
        "log_p_sma20": F.ln(close / W.mean(close, 20)), "log_p_sma50": F.ln(close / W.mean(close, 50)),
        "bb_pctb_c": F.coalesce(bb["percent_b"], F.lit(0.5)) - 0.5, "bb_bandwidth": F.coalesce(bb["bandwidth"], F.lit(0.0)), "log_p_vwap": F.ln(close / W.vwap(48)),
        **{f"ret_{k}": W.log_return(close, k) for k in (1, 3, 6, 12)},
        "vol_12": v12, "vol_ratio": F.when(v48 > 0, v12 / F.when(v48 > 0, v48)).otherwise(1.0), "atr_norm": F.col("atr14") / close,
        "volume_z": W.zscore(F.col("volume"), 48), "macd_hist_norm": (F.col("macd") - F.col("macd_signal")) / close,
        "hour_sin": hour_sin, "hour_cos": hour_cos, "adx_norm": F.col("adx14") / 100,
        "rel_strength_basket": F.when(has["basket_ret"], r0 - F.coalesce("basket_ret", F.lit(0.0))).otherwise(0.0),
        "corr_to_btc": F.when(has["btc_ret"], F.coalesce(W.correlation(r0, F.coalesce("btc_ret", F.lit(0.0)), 60), F.lit(0.0))).otherwise(0.0),
        "funding_z": W.zscore(F.col("funding_rate"), 288), "oi_roc_z": F.when(has["open_interest"], W.zscore(F.col("oi_roc"), 48)).otherwise(0.0), "top_trader_z": W.zscore(F.col("top_trader_ratio"), 48),
    }
    out = rows.withColumns(columns)
    valid = F.lit(True)
    for c in FEATURE_NAMES:
        valid = valid & F.col(c).isNotNull() & ~F.isnan(c)
    kept = [c for c in bars.columns if c not in columns]
    return out.withColumn("valid", valid).select(*kept, *(["idx"] if "idx" not in kept else []), "ewma_vol", *FEATURE_NAMES, "valid")


def latest_vector(features: DataFrame, least_bars: int = 60) -> DataFrame:
    """The last bar's features of each symbol with at least least_bars bars."""
    from marketloom.operators.signals import latest

    counted = features.withColumn("n_bars", F.count("*").over(Window.partitionBy("symbol")))
    return latest(counted.filter(F.col("n_bars") >= least_bars)).drop("n_bars")


def triple_barrier(rows: DataFrame, sigma: str = "ewma_vol", up: float = 2.0, down: float = 1.0, vertical: int = 24) -> DataFrame:
    """rows(symbol, open_time, idx, close, sigma) with label, touch_idx, realised_return, labelable.

    The first of the next `vertical` closes at or over up sigmas (1), or at or under down sigmas (-1);
    0 at the last if none is touched and all exist. The window of following closes is an array in the
    frame, so nothing is joined.
    """
    ahead = by_symbol().rowsBetween(1, vertical)
    logp, s = F.ln("close"), F.col(sigma)
    ok = (s > 0) & s.isNotNull()
    rows = rows.withColumn("__next", F.collect_list(logp).over(ahead))
    first = F.filter(
        F.transform("__next", lambda x, i: F.struct((i + 1).alias("step"), F.when(x >= logp + up * s, 1).when(x <= logp - down * s, -1).alias("hit"), (x - logp).alias("ret"))), lambda x: x["hit"].isNotNull()
    )
    rows = rows.withColumn("__hit", F.when(ok, F.get(first, F.lit(0))))
    complete = ok & F.col("__hit").isNull() & (F.size("__next") == vertical)
    return rows.withColumns(
        {
            "label": F.coalesce(F.col("__hit.hit"), F.lit(0)),
            "touch_idx": F.when(F.col("__hit").isNotNull(), F.col("idx") + F.col("__hit.step")).when(complete, F.col("idx") + vertical).otherwise(F.col("idx")),
            "realised_return": F.when(F.col("__hit").isNotNull(), F.col("__hit.ret")).when(complete, F.element_at(F.col("__next"), vertical) - logp),
            "labelable": F.col("__hit").isNotNull() | F.coalesce(complete, F.lit(False)),
        }
    ).drop("__next", "__hit")


def time_decay(least: float = 0.5, partition="symbol", order="idx") -> Column:
    """Linear from least (oldest) to 1 (newest), by position."""
    n = F.count("*").over(Window.partitionBy(partition))
    at = F.row_number().over(Window.partitionBy(partition).orderBy(order)) - 1
    return F.when(n > 1, least + (1 - least) * at / F.when(n > 1, n - 1)).otherwise(1.0)


def sample_weights(bars: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """labels(symbol, idx, touch_idx, realised_return) with weight: uniqueness x |return| x decay, mean 1 in each symbol."""
    spans = labels.withColumn("start", F.col("idx")).withColumn("end", F.col("touch_idx"))
    rows = uniqueness(bars, spans).withColumn("decay", time_decay(least))
    all_of = Window.partitionBy("symbol")
    size = F.coalesce(F.abs("realised_return"), F.lit(0.0))
    rows = rows.withColumn("__a", F.when(F.sum(size).over(all_of) > 0, size).otherwise(1.0)).withColumn("__w", F.col("uniqueness") * F.col("__a") * F.col("decay"))
    m = F.avg("__w").over(all_of)
    return rows.withColumn("weight", F.when(m > 0, F.col("__w") / F.when(m > 0, m)).otherwise(1.0)).drop("__a", "__w", "start", "end")


def forward_target(bars: DataFrame, horizon: int = 3, dead_band: Column | float = 0.005) -> DataFrame:
    """bars with fwd_ret over horizon bars and target: 1 up, 0 down, NULL inside the dead band or at the end."""
    ahead = F.lead("close", horizon).over(by_symbol())
    rows = bars.withColumn("fwd_ret", ahead / F.col("close") - 1)
    return rows.withColumn("target", F.when(F.col("fwd_ret") > dead_band, 1).when(F.col("fwd_ret") < -dead_band, 0))


def flow_proxy(bars: DataFrame, w: int = 20) -> DataFrame:
    """bars with flow: signed volume, z-scored over w bars (at least 5), sample deviation, clipped to 5."""
    step = F.col("close") - F.lag("close").over(by_symbol())
    rows = bars.withColumn("__s", F.signum(F.coalesce(step, F.lit(0.0))) * F.coalesce("volume", F.lit(0.0)))
    s = F.col("__s")
    sd = W.at_least(F.stddev_samp(s).over(W.roll(w)), s, w)
    z = (s - W.at_least(F.avg(s).over(W.roll(w)), s, w)) / F.when(sd > 0, sd)
    return rows.withColumn("flow", W.clip(F.coalesce(z, F.lit(0.0)), -5, 5)).drop("__s")


def vwap_deviation(bars: DataFrame, w: int = 20, look_ahead: bool = False) -> DataFrame:
    """bars with vwap_deviation and volume_zscore over w bars (at least 5). Gaps carry forward; back from later bars only if look_ahead."""
    v = F.coalesce("volume", F.lit(0.0))
    volume = W.at_least(F.sum(v).over(W.roll(w)), v, w)
    rows = bars.withColumn("__v", W.at_least(F.sum(W.typical() * v).over(W.roll(w)), v, w) / F.when(volume > 0, volume))
    order = by_symbol()
    price = F.last("__v", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    if look_ahead:
        price = F.coalesce("__v", F.first("__v", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing)), price)
    rows = rows.withColumn("__p", price)
    sd = W.at_least(F.stddev_samp(v).over(W.roll(w)), v, w)
    z = (v - W.at_least(F.avg(v).over(W.roll(w)), v, w)) / F.when(sd > 0, sd)
    deviation = (F.col("close") - F.col("__p")) / F.when(F.col("__p") != 0, F.col("__p"))
    return rows.withColumn("vwap_deviation", F.coalesce(deviation, F.lit(0.0))).withColumn("volume_zscore", F.coalesce(z, F.lit(0.0))).drop("__v", "__p")


def technical_columns(bars: DataFrame) -> DataFrame:
    """Publicly defined indicators that need no recursion beside those of with_recursive: stochastic, on-balance volume, money flow index."""
    order, w14 = by_symbol(), W.roll(14)
    low, high = F.min("low").over(w14), F.max("high").over(w14)
    step = F.signum(F.col("close") - F.lag("close").over(order))
    flow = W.typical() * F.col("volume")
    rise = F.signum(W.typical() - F.lag(W.typical()).over(order))
    rows = with_recursive(bars).withColumn("stoch_k", W.full(F.when(high > low, (F.col("close") - low) / F.when(high > low, high - low) * 100).otherwise(50.0), F.col("close"), 14))
    rows = rows.withColumn("__o", F.coalesce(step, F.lit(0.0)) * F.col("volume")).withColumn("__up", F.when(rise > 0, flow).otherwise(0.0)).withColumn("__down", F.when(rise < 0, flow).otherwise(0.0))
    up, down = W.total(F.col("__up"), 14), W.total(F.col("__down"), 14)
    return rows.withColumns(
        {"stoch_d": W.mean(F.col("stoch_k"), 3), "obv": F.sum("__o").over(order.rowsBetween(Window.unboundedPreceding, 0)), "mfi": F.when(down > 0, 100 - 100 / (1 + up / F.when(down > 0, down))).when(down == 0, 100.0)}
    ).drop("__o", "__up", "__down")


def regime(adx: Column) -> Column:
    return F.when(adx > 25, "trending").otherwise("ranging")


def meta_target(primary: Column, realised: Column) -> Column:
    """1 where the primary's direction had the sign of the return, else 0; NULL without an opinion."""
    return F.when(primary >= 0, F.when(((primary == 1) & (realised > 0)) | ((primary == 0) & (realised < 0)), 1).otherwise(0))
