"""Indicators that need the value before, y[i] = keep * y[i-1] + gain * x[i], which neither frames nor joins express.

A bar's weight in them fades under 1e-17 within about 1,100 bars (the average directional index, two
such recursions in a row, is the slowest). So a symbol's bars are computed in blocks, each begun HALO bars
early: a task holds one block, however long the history, and the recursion itself is a matrix product. Blocks are
dealt by symbol and block, so those of one symbol run on all cores at once.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from marketloom.sources.bars import index_by_parts

COLUMNS = ("rsi14", "rsi9", "ema12", "ema26", "macd", "macd_signal", "atr14", "adx14", "ewma_vol")
#: Bars of a block, and how many bars early its recursions begin.
BLOCK, HALO = 65_536, 2048
_SPAN = 256


def linear(x: np.ndarray, keep: float, gain: float, before: float) -> np.ndarray:
    """y[i] = keep * y[i-1] + gain * x[i] with y[-1] = before: spans of x by one matrix product, then what each span hands on."""
    n = len(x)
    spans = np.pad(np.asarray(x, float), (0, -n % _SPAN)).reshape(-1, _SPAN)
    lag = np.subtract.outer(np.arange(_SPAN), np.arange(_SPAN))
    out = spans @ np.where(lag >= 0, gain * keep ** np.maximum(lag, 0), 0.0).T
    fade = keep ** np.arange(1, _SPAN + 1)
    for row in out:
        row += fade * before
        before = row[-1]
    return out.ravel()[:n]


def wilder(x: np.ndarray, period: int, first: int = 1) -> np.ndarray:
    """Wilder's mean: the mean of `period` values from `first`, then (before * (period - 1) + x) / period; NaN before."""
    out = np.full(len(x), np.nan)
    at = first + period - 1
    if len(x) > at:
        out[at] = x[first : at + 1].mean()
        out[at + 1 :] = linear(x[at + 1 :], (period - 1) / period, 1 / period, out[at])
    return out


def rsi(close: np.ndarray, period: int = 14) -> np.ndarray:
    """100 where there was no loss, 0 where there was no gain."""
    step = np.diff(close, prepend=close[:1])
    gain, loss = wilder(np.maximum(step, 0), period), wilder(np.maximum(-step, 0), period)
    with np.errstate(divide="ignore", invalid="ignore"):
        out = 100 - 100 / (1 + gain / loss)
    return np.where(np.isnan(gain), np.nan, np.where(loss == 0, 100.0, np.where(gain == 0, 0.0, out)))


def ema(x: np.ndarray, span: int) -> np.ndarray:
    k = 2 / (span + 1)
    return linear(x, 1 - k, k, float(x[0])) if len(x) else np.zeros(0)


def true_range(high, low, close) -> np.ndarray:
    before = np.concatenate([close[:1], close[:-1]])
    return np.maximum(high - low, np.maximum(np.abs(high - before), np.abs(low - before)))


def atr(high, low, close, period: int = 14) -> np.ndarray:
    return wilder(true_range(high, low, close), period)


def adx(high, low, close, period: int = 14) -> np.ndarray:
    """Trend strength; needs 2 * period + 1 bars."""
    n = len(close)
    if n < 2 * period + 1:
        return np.full(n, np.nan)
    up, down = np.diff(high, prepend=high[:1]), -np.diff(low, prepend=low[:1])
    plus = wilder(np.where((up > down) & (up > 0), up, 0.0), period)
    minus = wilder(np.where((down > up) & (down > 0), down, 0.0), period)
    span = atr(high, low, close, period)
    with np.errstate(divide="ignore", invalid="ignore"):
        a, b = 100 * plus / span, 100 * minus / span
        dx = np.where(span > 0, np.where(a + b > 0, 100 * np.abs(a - b) / (a + b), 0.0), np.nan)
    if not np.isfinite(dx[period : 2 * period]).all():
        return np.full(n, np.nan)
    dx[2 * period :] = np.nan_to_num(dx[2 * period :], nan=0.0)
    return wilder(dx, period, first=period)


def ewma_vol(close: np.ndarray, span: int = 20) -> np.ndarray:
    r = np.diff(np.log(close), prepend=np.log(close[:1]))
    return np.sqrt(ema(r * r, span))


def measures(close, high, low, names: Iterable[str] = COLUMNS) -> dict[str, np.ndarray]:
    """The named ones of COLUMNS; no others are computed."""
    by_name = {
        "rsi14": lambda: rsi(close, 14), "rsi9": lambda: rsi(close, 9), "ema12": lambda: ema(close, 12), "ema26": lambda: ema(close, 26),
        "macd": lambda: ema(close, 12) - ema(close, 26), "macd_signal": lambda: ema(ema(close, 12) - ema(close, 26), 9),
        "atr14": lambda: atr(high, low, close), "adx14": lambda: adx(high, low, close), "ewma_vol": lambda: ewma_vol(close),
    }
    return {name: by_name[name]() for name in names}


def in_blocks(bars: DataFrame, block: int = BLOCK, halo: int = HALO) -> DataFrame:
    """bars with __block, the block of their idx (numbered here if bars have none); a block's last `halo` bars come again in the next one."""
    rows = bars if "idx" in bars.columns else index_by_parts(bars)
    own = F.floor(F.col("idx") / block)
    late = F.when(F.col("idx") % block >= block - halo, own + 1)
    return rows.withColumn("__block", F.explode(F.array_compact(F.array(own, late)))).repartition("symbol", "__block")


def with_recursive(bars: DataFrame, names: Iterable[str] = COLUMNS, block: int = BLOCK, halo: int = HALO) -> DataFrame:
    """bars with the named ones of COLUMNS behind; NULL while an indicator warms up. An empty table gives no rows."""
    names, kept = tuple(names), bars.columns
    schema = StructType([*bars.schema.fields, *(StructField(c, DoubleType()) for c in names)])

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by("idx")
        found = measures(*(table.column(c).cast(pa.float64()).to_numpy() for c in ("close", "high", "low")), names)
        own = table.column("idx").to_numpy() // block == table.column("__block")[0].as_py()
        out = table.select(kept).filter(pa.array(own))
        for name, values in found.items():
            out = out.append_column(name, pa.array(values[own], pa.float64(), mask=~np.isfinite(values[own])))
        return out

    return in_blocks(bars, block, halo).groupBy("symbol", "__block").applyInArrow(one, schema)


def garch_path(r: np.ndarray, base: float, alpha: float, beta: float) -> np.ndarray:
    """Conditional variances of demeaned returns r for long-run variance base."""
    shocks = base * (1 - alpha - beta) + alpha * r[:-1] ** 2
    return np.concatenate([[base], linear(shocks, beta, 1.0, base)])[: len(r)]


def fit_garch(returns: np.ndarray, holdout: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """((omega, alpha, beta), conditional volatility of all returns) of a GARCH(1,1).

    Mean, long-run variance and parameters come from the returns before the last share `holdout` alone, by
    a coarse-to-fine search of the Gaussian likelihood.
    """
    n = len(returns) - int(len(returns) * holdout)
    fit = returns[:n] - returns[:n].mean()
    base, best, width, centre = max(fit.var(), 1e-18), None, 0.45, (0.5, 0.5)
    for _ in range(4):
        for a in np.clip(centre[0] + width * np.linspace(-1, 1, 7), 0.001, 0.98):
            for b in np.clip(centre[1] + width * np.linspace(-1, 1, 7), 0.001, 0.98):
                if a + b < 0.999:
                    s = garch_path(fit, base, a, b)
                    loss = float((np.log(s) + fit * fit / s).sum())
                    if best is None or loss < best[0]:
                        best = loss, a, b
        centre, width = best[1:], width / 3
    _, a, b = best
    return np.array([base * (1 - a - b), a, b]), np.sqrt(garch_path(returns - returns[:n].mean(), base, a, b))


def held_out_qlike(returns: np.ndarray, sigma: np.ndarray, holdout: float) -> float:
    """Mean of x - ln(x) - 1, x a squared return over its forecast variance, on the last share of the returns; zero returns have none."""
    n = len(returns) - int(len(returns) * holdout)
    actual, forecast = (returns[n:] - returns[:n].mean()) ** 2, sigma[n:] ** 2
    x = actual[actual > 0] / forecast[actual > 0]
    return float((x - np.log(x) - 1).mean()) if len(x) else float("nan")
