"""Joins of time series: as-of, alignment on common times, cross-section, intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType, TimestampType
from pyspark.sql.window import Window

from marketloom.sources.bars import PART


def asof(bars: DataFrame, points: DataFrame, value: str, key="symbol", time="open_time", point_time="event_time") -> DataFrame:
    """bars with the last value of points(key, point_time, value) at or before each bar; NULL before the first.

    Points and bars meet in parts of time (PART), so no task sorts all of a symbol: a running last value inside
    each part, and before it the last of the parts before, carried over one row a part. Of several points at
    one time the greatest value counts.
    """
    t = bars.schema[time].dataType
    part = (lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / PART)) if isinstance(t, (TimestampType, TimestampNTZType)) else (lambda c: F.floor(F.col(c) / PART))
    left = bars.select("*", F.col(time).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(points.schema[value].dataType).alias("__v"), part(time).alias("__part"))
    known = points.filter(F.col(value).isNotNull()).select(F.col(key).alias(key), F.col(point_time).alias("__t"), F.lit(0).alias("__side"), F.col(value).alias("__v"), part(point_time).alias("__part"))
    inside = Window.partitionBy(key, "__part").orderBy("__t", "__side", "__v").rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionByName(known, allowMissingColumns=True).withColumn("__in", F.last("__v", ignorenulls=True).over(inside)).filter("__side = 1")
    before = Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    lasts = known.groupBy(key, "__part").agg(F.max_by("__v", F.struct("__t", "__v")).alias("__l"))
    parts = bars.select(key, part(time).alias("__part"), F.lit(None).cast(points.schema[value].dataType).alias("__l")).distinct()
    carried = lasts.unionByName(parts).groupBy(key, "__part").agg(F.max("__l").alias("__l")).select(key, "__part", F.last("__l", ignorenulls=True).over(before).alias("__carried"))
    return both.join(carried, [key, "__part"], "left").withColumn(value, F.coalesce("__in", "__carried")).select(*[c for c in bars.columns if c != value], value)


def asof_filled(bars: DataFrame, points: DataFrame | None, value: str, **names) -> DataFrame:
    """asof(), carried forward, 0 where there is nothing before; without points all 0."""
    if points is None:
        return bars.withColumn(value, F.lit(0.0))
    return asof(bars, points, value, **names).withColumn(value, F.coalesce(value, F.lit(0.0)))


def align(bars: DataFrame) -> DataFrame:
    """The bars of times that every symbol has: counted, not joined symbol by symbol."""
    n = bars.select("symbol").distinct().agg(F.count("*").alias("n_symbols"))
    common = bars.groupBy("open_time").agg(F.count_distinct("symbol").alias("n")).join(F.broadcast(n), F.col("n") == F.col("n_symbols")).select("open_time")
    return bars.join(common, "open_time", "left_semi")


def cross_section(bars: DataFrame, benchmark: str = "BTC/") -> DataFrame:
    """bars with ret (first bar 0), basket_ret (mean of the other symbols' at that time) and btc_ret (of the benchmark; NULL for itself)."""
    order, at = Window.partitionBy("symbol").orderBy("open_time"), Window.partitionBy("open_time")
    rows = bars.withColumn("ret", F.coalesce(F.ln("close") - F.lag(F.ln("close")).over(order), F.lit(0.0)))
    n, is_benchmark = F.count("ret").over(at), F.upper("symbol").startswith(benchmark.upper())
    lead = F.max(F.when(is_benchmark, F.col("ret"))).over(at)
    return rows.withColumn("basket_ret", F.when(n > 1, (F.sum("ret").over(at) - F.col("ret")) / F.when(n > 1, n - 1))).withColumn("btc_ret", F.when(~is_benchmark, lead))


def concurrency(bars: DataFrame, spans: DataFrame) -> DataFrame:
    """bars(symbol, idx) with the number of spans(symbol, start, end) open at each, by a running sum of +1 and -1."""
    changes = spans.filter("end >= start").select("symbol", F.inline(F.array(F.struct(F.col("start").alias("idx"), F.lit(1).alias("d")), F.struct((F.col("end") + 1).alias("idx"), F.lit(-1).alias("d")))))
    at = changes.groupBy("symbol", "idx").agg(F.sum("d").alias("d"))
    w = Window.partitionBy("symbol").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    return bars.join(at, ["symbol", "idx"], "left").withColumn("open_spans", F.sum(F.coalesce("d", F.lit(0))).over(w)).drop("d")


def uniqueness(bars: DataFrame, spans: DataFrame) -> DataFrame:
    """spans with the mean of 1 / concurrency over each: from prefix sums at both ends, two equi-joins, no range join."""
    w = Window.partitionBy("symbol").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    prefix = concurrency(bars.select("symbol", "idx"), spans).select("symbol", "idx", F.sum(1.0 / F.greatest("open_spans", F.lit(1))).over(w).alias("p"))
    ends = prefix.select("symbol", F.col("idx").alias("end"), F.col("p").alias("p_end"))
    starts = prefix.select("symbol", (F.col("idx") + 1).alias("start"), F.col("p").alias("p_start"))
    joined = spans.join(ends, ["symbol", "end"]).join(starts, ["symbol", "start"], "left")
    return joined.withColumn("uniqueness", (F.col("p_end") - F.coalesce("p_start", F.lit(0.0))) / (F.col("end") - F.col("start") + 1)).drop("p_end", "p_start")


def lookup_range(rows: DataFrame, table: DataFrame, value: Column, last_hi: float = 1.0) -> DataFrame:
    """rows with the row of table(lo, hi, ...) for which lo <= value < hi, the last one closed. The table is a handful of buckets, so it is broadcast."""
    inside = (value >= F.col("lo")) & ((value < F.col("hi")) | ((F.col("hi") == last_hi) & (value == last_hi)))
    return rows.join(F.broadcast(table), inside, "left")
