"""The hourly matrix: indicators, seasons, flow, series from outside and macro values beside each bar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.functions import windows as W
from marketloom.functions.scalars import cyclic, day_fraction, is_forex
from marketloom.operators.features import flow_proxy, technical_columns, vwap_deviation
from marketloom.operators.joins import asof_filled
from marketloom.operators.signals import bollinger
from marketloom.operators.stops import parabolic_stops

SEASONS = ("hour_sin", "hour_cos", "dow_sin", "dow_cos")


def seasons(bars: DataFrame) -> DataFrame:
    """bars with the time of the day and the day of the week (from Monday) on circles."""
    hour = cyclic(day_fraction(F.date_trunc("minute", "open_time")), 24)
    day = cyclic(F.weekday("open_time"), 7)
    return bars.withColumns(dict(zip(SEASONS, (*hour, *day))))


def hourly_matrix(bars: DataFrame, outside: dict[str, DataFrame] | None = None, macro: DataFrame | None = None, forex: Column | None = None) -> DataFrame:
    """bars(symbol, open_time, open, high, low, close, volume) with every feature of the hourly model behind.

    outside names series (symbol, event_time, name), which are carried forward to the bars, 0 before their first point; macro
    is one row of current values, NULL ones left out, beside every bar. vwap_deviation and volume_zscore are of forex
    symbols (`forex`, else told by the symbol) and NULL for others. Indicators are NULL while they warm up: complete_rows()
    drops such rows, nothing is filled in. An empty table gives no rows.
    """
    forex = is_forex(F.col("symbol")) if forex is None else forex
    rows = technical_columns(parabolic_stops(bars))
    rows = rows.withColumns({f"bb_{name}": column for name, column in bollinger(F.col("close"), 20).items()}).withColumn("sma20", W.mean(F.col("close"), 20))
    rows = seasons(flow_proxy(rows).withColumnRenamed("flow", "order_flow_imbalance"))
    rows = vwap_deviation(rows, look_ahead=True)
    rows = rows.withColumns({c: F.when(forex, F.col(c)) for c in ("vwap_deviation", "volume_zscore")})
    for name, points in (outside or {}).items():
        rows = asof_filled(rows, points, name)
    if macro is not None:
        one = macro.limit(1).first()  # a row of a handful of current values
        for name, value in (one.asDict() if one else {}).items():
            rows = rows if value is None else rows.withColumn(name, F.lit(value))
    return rows
