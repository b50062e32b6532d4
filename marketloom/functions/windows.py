"""Rolling measures over the bars of a symbol; NULL until a window is full."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marketloom.sources.bars import by_symbol


def roll(w: int, end: int = 0):
    return by_symbol().rowsBetween(end - w + 1, end)


def full(value: Column, x: Column, w: int) -> Column:
    """value where the last w rows all have x."""
    return F.when(F.count(x).over(roll(w)) == w, value)


def mean(x: Column, w: int) -> Column:
    return full(F.avg(x).over(roll(w)), x, w)


def total(x: Column, w: int) -> Column:
    return full(F.sum(x).over(roll(w)), x, w)


def std(x: Column, w: int) -> Column:
    """Population standard deviation."""
    return full(F.stddev_pop(x).over(roll(w)), x, w)


def zscore(x: Column, w: int, clip: float = 5.0) -> Column:
    """0 where undefined."""
    sd = std(x, w)
    z = F.when(sd > 0, (x - mean(x, w)) / sd).otherwise(0.0)
    return F.greatest(F.lit(-clip), F.least(F.lit(clip), F.coalesce(z, F.lit(0.0))))


def correlation(x: Column, y: Column, w: int) -> Column:
    """Pearson correlation, 0 where either side is constant."""
    both = F.when(x.isNotNull() & y.isNotNull(), F.lit(1))
    den = F.stddev_pop(x).over(roll(w)) * F.stddev_pop(y).over(roll(w))
    return F.when(F.count(both).over(roll(w)) == w, F.when(den > 0, F.covar_pop(x, y).over(roll(w)) / den).otherwise(0.0))


def log_return(close: Column, k: int = 1) -> Column:
    return F.ln(close) - F.lag(F.ln(close), k).over(by_symbol())


def typical() -> Column:
    return (F.col("high") + F.col("low") + F.col("close")) / 3


def vwap(w: int) -> Column:
    """Volume-weighted mean price, unweighted where no bar of the window has volume."""
    v = F.sum("volume").over(roll(w))
    weighted = F.sum(typical() * F.col("volume")).over(roll(w)) / F.when(v > 0, v)
    return full(F.coalesce(weighted, F.avg(typical()).over(roll(w))), F.col("close"), w)


def vwap_so_far(w: int) -> Column:
    """Volume-weighted mean price of up to w bars, as many as there are; unweighted where none of them has volume."""
    v = F.coalesce("volume", F.lit(0.0))
    volume = F.sum(v).over(roll(w))
    return F.coalesce(F.sum(typical() * v).over(roll(w)) / F.when(volume > 0, volume), F.avg(typical()).over(roll(w)))


def has_volume(w: int) -> Column:
    return F.sum(F.coalesce("volume", F.lit(0.0))).over(roll(w)) > 0


def at_least(value: Column, x: Column, w: int, least: int = 5) -> Column:
    return F.when(F.count(x).over(roll(w)) >= least, value)


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))
