"""Rule signals: the cascade of rules with its confidence score, and how it combines with a model's opinion."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.functions import windows as W
from marketloom.functions.scalars import half_up, is_forex
from marketloom.operators.recursive import with_recursive
from marketloom.sources.bars import by_symbol, with_index


@dataclass(frozen=True)
class Profile:
    """Fixed values of a strategy: window lengths, least confidence, neutral bandwidth, stop loss in percent by class."""

    name: str
    sma: int
    rsi: int
    bollinger: int
    min_confidence: int
    neutral_bandwidth: float
    stop_loss: dict = field(default_factory=dict)


PROFILES = {
    "aggressive": Profile("aggressive", 20, 9, 14, 45, 0.008, {"crypto": 2.0, "forex": 0.5}),
    "conservative": Profile("conservative", 50, 14, 20, 62, 0.004, {"crypto": 3.0, "forex": 0.75}),
}


def profile(name: str | None) -> Profile:
    return PROFILES.get(name or "", PROFILES["conservative"])


def stop_loss_percent(p: Profile, symbol: Column) -> Column:
    """The stop of the symbol's class; the crypto stop where the profile has none for it, 2 where it has none at all."""
    crypto = p.stop_loss.get("crypto", 2.0)
    return F.when(is_forex(symbol), p.stop_loss.get("forex", crypto)).otherwise(crypto)


def bollinger(close: Column, w: int, k: float = 2.0) -> dict[str, Column]:
    """middle, upper, lower, bandwidth (0 around 0), percent_b (one half in a flat window), breakout UPPER, LOWER or NULL."""
    middle, sd = W.mean(close, w), W.std(close, w)
    upper, lower = middle + k * sd, middle - k * sd
    return {
        "middle": middle, "upper": upper, "lower": lower,
        "bandwidth": F.when(middle != 0, (upper - lower) / middle).when(middle == 0, 0.0),
        "percent_b": F.when(upper > lower, (close - lower) / (upper - lower)).when(upper.isNotNull(), 0.5),
        "breakout": F.when(close > upper, "UPPER").when(close < lower, "LOWER"),
    }


#: How many bars the signal's volume-weighted price looks back; fewer where there are no more.
VWAP_BARS = 288


def signal(p: Profile, price: Column, sma: Column, rsi: Column, bandwidth: Column, breakout: Column, vwap: Column) -> Column:
    """struct(signal, confidence, rule, reasons). The first rule that fits decides; a directional call under the least confidence turns neutral."""
    missing = price.isNull() | sma.isNull() | rsi.isNull()
    above = price > sma
    rules = (
        (missing, "NEUTRAL", "insufficient-data"),
        ((bandwidth < p.neutral_bandwidth) & breakout.isNull(), "NEUTRAL", "sideways-range"),
        (above & rsi.between(40, 60), "UP", "spec-up"),
        (~above & (rsi > 65), "DOWN", "spec-down"),
        (above & (rsi > 70) & (breakout == "UPPER"), "DOWN", "reversal-down"),
        (~above & (rsi < 40), "DOWN", "trend-down"),
        ((rsi < 30) & (breakout == "LOWER"), "UP", "bounce-up"),
    )
    rule, call = F.lit("no-rule-matched"), F.lit("NEUTRAL")
    for when, what, name in reversed(rules):
        rule, call = F.when(when, name).otherwise(rule), F.when(when, what).otherwise(call)
    up, down = call == "UP", call == "DOWN"
    distance = F.abs(price - sma) / F.when(sma != 0, sma) * 100
    score = (
        F.lit(40.0)
        + F.least(distance * 4, F.lit(20.0))
        + F.when(up & rsi.between(45, 60), 12.0).otherwise(0.0)
        + F.when(down & (rsi >= 65), 12.0).otherwise(0.0)
        + F.when(down & (rsi < 40), 8.0).otherwise(0.0)
        + F.when(vwap.isNull(), 0.0).when((up & (price > vwap)) | (down & (price < vwap)), 12.0).otherwise(-8.0)
        + F.when((bandwidth > 2 * p.neutral_bandwidth) & (bandwidth < 0.06), 10.0).when(bandwidth >= 0.06, -10.0).otherwise(0.0)
        + F.when((up & (breakout == "UPPER")) | (down & (breakout == "LOWER")), 6.0).otherwise(0.0)
    )
    directed = F.greatest(F.lit(0), F.least(F.lit(95), half_up(score).cast("int")))
    confidence = F.when(missing, 0).when(call == "NEUTRAL", 30).otherwise(directed)
    weak = (up | down) & (confidence < p.min_confidence)
    reasons = F.filter(
        F.array(
            F.concat(F.lit("rule "), rule),
            F.when(~missing, F.when(above, "price above its mean").otherwise("price at or under its mean")),
            F.when(breakout.isNotNull(), F.concat(F.lit("breakout "), F.lower(breakout))),
            F.when((up & (price > vwap)) | (down & (price < vwap)), "volume-weighted price agrees").when((up | down) & vwap.isNotNull(), "volume-weighted price disagrees"),
            F.when((up | down) & (bandwidth >= 0.06), "extreme volatility"),
            F.when(weak, "confidence under the profile's least"),
        ),
        lambda x: x.isNotNull(),
    )
    return F.struct(F.when(weak, "NEUTRAL").otherwise(call).alias("signal"), confidence.cast("int").alias("confidence"), F.when(weak, F.concat(rule, F.lit("-below-threshold"))).otherwise(rule).alias("rule"), reasons.alias("reasons"))


def with_signals(bars: DataFrame, p: Profile = PROFILES["conservative"], vwap_window: int = VWAP_BARS) -> DataFrame:
    """bars with their indicators and signal: recursions run by block, windows share one shuffle on symbol."""
    rows = with_recursive(with_index(bars), (f"rsi{p.rsi}",))
    for name, column in bollinger(F.col("close"), p.bollinger).items():
        rows = rows.withColumn(f"bb_{name}", column)
    rows = rows.withColumn("sma", W.mean(F.col("close"), p.sma)).withColumn("vwap", W.vwap_so_far(vwap_window)).withColumn("vwap_is_volume_weighted", W.has_volume(vwap_window)).withColumn("rsi", F.col(f"rsi{p.rsi}"))
    return rows.withColumn("s", signal(p, F.col("close"), F.col("sma"), F.col("rsi"), F.col("bb_bandwidth"), F.col("bb_breakout"), F.col("vwap"))).select("*", "s.*").drop("s")


def latest(rows: DataFrame, key="symbol", time="open_time") -> DataFrame:
    """The last row of each key, by a maximum that is aggregated before the shuffle."""
    return rows.groupBy(F.col(key).alias("__key")).agg(F.max_by(F.struct(*rows.columns), F.col(time)).alias("r")).select("r.*")


def heuristic(log_p_sma50: Column, rsi_14_c: Column, bandwidth: Column, neutral: float = 0.004) -> Column:
    """1 up, 0 down, -1 no opinion, from features; a narrow band overrides all."""
    rsi, above = (rsi_14_c + 0.5) * 100, log_p_sma50 > 0
    return F.when(bandwidth < neutral, -1).when(above & rsi.between(40, 60), 1).when(~above & ((rsi > 65) | (rsi < 40)), 0).otherwise(-1)


def combine(h_signal: Column, h_conf: Column, m_signal: Column, m_conf: Column, available: Column, validated: Column) -> Column:
    """struct(signal, confidence, source) of the rules' and the model's opinions."""
    def out(s, c, source):
        return F.struct(s.alias("signal"), c.cast("int").alias("confidence"), F.lit(source).alias("source"))

    return (
        F.when(~available | ~validated, out(h_signal, h_conf, "heuristic"))
        .when(h_signal == "NEUTRAL", out(m_signal, F.least(m_conf, F.lit(70)), "ml"))
        .when(h_signal == m_signal, out(h_signal, F.least(F.lit(95), half_up(h_conf + 8)), "both"))
        .otherwise(out(F.lit("NEUTRAL"), F.lit(35), "conflict"))
    )


def entry_windows(rows: DataFrame, as_of: Column, hours: int = 12, stop_percent: float = 2.0, p: Profile | None = None) -> DataFrame:
    """The best entry of each symbol in the look-back before as_of: oversold and high volume score, ties to the earliest.

    rows need symbol, open_time, close, volume, rsi14. With a profile, its RSI counts instead, and the
    stop is that of the profile and the symbol's class. Bars after as_of don't count. Symbols have no row without a bar
    with an RSI in the window, or with fewer bars up to as_of than the RSI's window and 5.
    """
    length = p.rsi if p else 14
    rsi = F.col(f"rsi{length}")
    known = rows.filter(F.col("open_time") <= as_of)
    enough = known.groupBy("symbol").agg(F.count(F.lit(1)).alias("__bars")).filter(F.col("__bars") >= length + 5).select("symbol")
    inside = known.filter((F.col("open_time") >= as_of - F.expr(f"INTERVAL {hours} HOURS")) & rsi.isNotNull()).join(enough, "symbol", "left_semi").withColumn("entry_rsi", rsi)
    means = inside.groupBy("symbol").agg(F.avg(F.coalesce("volume", F.lit(0.0))).alias("mean_volume"), F.min_by("open_time", F.struct("entry_rsi", "open_time")).alias("lowest_rsi_time"), F.min("entry_rsi").alias("lowest_rsi"))
    ratio = F.when(F.col("mean_volume") > 0, F.coalesce("volume", F.lit(0.0)) / F.col("mean_volume")).otherwise(1.0)
    scored = inside.join(means, "symbol").withColumn("volume_ratio", ratio)
    scored = scored.withColumn("score", 0.65 * (100 - F.col("entry_rsi")) / 100 + 0.35 * F.least(F.col("volume_ratio"), F.lit(3.0)) / 3)
    best = scored.groupBy("symbol").agg(F.max_by(F.struct("open_time", "close", "entry_rsi", "volume_ratio", "score", "lowest_rsi", "lowest_rsi_time"), F.struct(F.col("score"), -F.unix_micros(F.col("open_time").cast("timestamp")))).alias("b")).select("symbol", "b.*")
    quality = F.when(F.col("score") >= 0.6, "strong").when(F.col("score") >= 0.45, "moderate").otherwise("weak")
    stop = stop_loss_percent(p, F.col("symbol")) if p else F.lit(stop_percent)
    return best.withColumn("stop_loss_percent", stop).withColumn("stop_loss", F.col("close") * (1 - stop / 100)).withColumn("lookback_hours", F.lit(hours)).withColumn("quality", quality)


def change_over(bars: DataFrame, n: int = 288) -> DataFrame:
    """Percent change of each symbol's last close against n - 1 bars before, or its first bar; 0 if that is 0."""
    w = by_symbol()
    base = F.coalesce(F.lag("close", n - 1).over(w), F.first("close").over(w.rowsBetween(-(n - 1), 0)))
    return latest(bars.withColumn("change", F.when(base != 0, (F.col("close") - base) / F.when(base != 0, base) * 100).otherwise(0.0))).select("symbol", "change")
