"""Caches of what is slow to get: a folder for each key, used while young and whole, got again otherwise.

The layout is path/key=K/*.parquet. A key is the symbol, and for what belongs to a grid of bars also the grid's
length, first and last time, so that rows got for other bars are never taken for these.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.operators.ranks import settled


def grid_keys(bars: DataFrame) -> DataFrame:
    """(symbol, cache_key) of each symbol's grid: symbol, number of bars, first and last time in milliseconds; bars without a time don't count."""
    ms = F.unix_millis(F.col("open_time").cast("timestamp"))
    grids = bars.filter(F.col("symbol").isNotNull()).groupBy("symbol").agg(F.count("open_time").alias("n"), F.min(ms).alias("first"), F.max(ms).alias("last"))
    return grids.select("symbol", F.when(F.col("n") > 0, F.concat_ws("_", "symbol", "n", "first", "last")).otherwise(F.concat_ws("_", "symbol", F.lit("empty"))).alias("cache_key"))


def symbol_keys(bars: DataFrame) -> DataFrame:
    """(symbol, cache_key) of what belongs to a symbol alone."""
    return bars.filter(F.col("symbol").isNotNull()).select("symbol", F.col("symbol").alias("cache_key")).distinct()


class Cache:
    """Rows by key in a Parquet folder. `columns` is the rows' schema, with symbol; `whole` are the columns that a key's rows must have a value of, each at least once, to be kept."""

    def __init__(self, spark: SparkSession, path: str, columns: str, whole: tuple[str, ...] = (), max_age_hours: float = 6):
        self.spark, self.path, self.columns, self.whole, self.max_age_hours = spark, path.rstrip("/"), columns, whole, max_age_hours
        folder = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)

    def _stored(self) -> DataFrame:
        return self.spark.read.schema(f"{self.columns}, cached_at timestamp, cache_key string").parquet(self.path)

    def store(self, rows: DataFrame, keys: DataFrame, at: Column) -> None:
        """Put the rows of keys(symbol, cache_key) in place of what those keys had. A key some column of which is missing from end to end isn't kept: it is got again next time."""
        keyed = rows.join(keys, "symbol")
        complete = keyed.groupBy("cache_key").agg(*(F.count(c).alias(f"__{i}") for i, c in enumerate(self.whole)), F.count(F.lit(1)).alias("__n"))
        for i in range(len(self.whole)):
            complete = complete.filter(F.col(f"__{i}") > 0)
        kept = keyed.join(complete.select("cache_key"), "cache_key", "left_semi").withColumn("cached_at", at.cast("timestamp"))
        kept.select(*self._stored().columns).hint("rebalance", F.col("cache_key")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("cache_key").parquet(self.path)

    def ages(self, keys: DataFrame, at: Column) -> DataFrame:
        """keys(symbol, cache_key) with hit: whether the cache has rows under the key that are younger than max_age_hours."""
        young = self._stored().groupBy("cache_key").agg((F.unix_micros(at.cast("timestamp")) - F.unix_micros(F.max("cached_at")) < self.max_age_hours * 3_600_000_000).alias("hit"))
        return keys.join(young, "cache_key", "left").withColumn("hit", F.coalesce("hit", F.lit(False))).select("symbol", "cache_key", "hit")

    def _of(self, keys: DataFrame) -> DataFrame:
        return self._stored().join(keys.select("cache_key"), "cache_key", "left_semi").drop("cache_key", "cached_at")

    def read(self, keys: DataFrame, at: Column) -> DataFrame:
        """The rows of the keys that hit."""
        return self._of(self.ages(keys, at).filter("hit"))

    def through(self, keys: DataFrame, load: Callable[[DataFrame], DataFrame], at: Column) -> DataFrame:
        """The rows of all keys: cached ones, and for the rest those of load(keys that missed), which are stored where they are whole."""
        ages = settled(self.ages(keys, at))
        missed = ages.filter("NOT hit").drop("hit")
        if missed.isEmpty():
            return self._of(ages)
        loaded = settled(load(missed))
        self.store(loaded, missed, at)
        old = self._of(ages.filter("hit"))  # its files are listed behind the store, which put others in place
        return old.unionByName(loaded.select(*old.columns))
