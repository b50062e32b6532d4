"""Tables in day partitions: an upsert rewrites the days it touches and no others, retention drops whole days."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.operators import store as T


class DayTable:
    """Rows by key in a Parquet folder, a partition for each day of `time`. A key's time never moves to another day.

    An upsert that comes twice leaves the same rows, so a repeated batch of a stream is harmless. Spark writes the
    touched days to a staging folder and puts them in place when all tasks have ended: a failed job leaves the table as it was.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], time: str):
        self.spark, self.path, self.schema, self.keys, self.time = spark, path.rstrip("/"), schema, keys, time
        self._folder = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self._files = self._folder.getFileSystem(spark._jsc.hadoopConfiguration())
        self._files.mkdirs(self._folder)

    def _stored(self) -> DataFrame:
        return self.spark.read.schema(f"{self.schema}, day date").parquet(self.path)

    def read(self, upto: int | None = None) -> DataFrame:
        """All rows as they are now; a filter on `day` chooses partitions. (upto, a batch, is ignored: the table keeps no history.)"""
        return self._stored().drop("day")

    def turn(self, batch: int, query: str) -> int:
        """Batches have no numbers here."""
        return batch

    def days(self) -> list[datetime.date]:
        """The days that have a partition."""
        names = [s.getPath().getName() for s in self._files.listStatus(self._folder)]
        return sorted(datetime.date.fromisoformat(n[4:]) for n in names if n.startswith("day=") and n[4:5].isdigit())

    def write(self, rows: DataFrame, batch: int | None = None, order: str | None = None) -> list[datetime.date]:
        """Upsert rows by key (the greatest `order` of repeated ones counts); the days that were rewritten. Rows without a time are left out."""
        new = rows.filter(F.col(self.time).isNotNull()).withColumn("day", F.to_date(self.time))
        touched = sorted(r[0] for r in new.select("day").distinct().collect())  # a row a day of this batch
        if touched:
            old = self._stored().filter(F.col("day").isin(touched))
            merged = T.upsert(old, new.select(*old.columns), self.keys, order=order)
            merged.repartition("day", *self.keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(self.path)
        return touched

    def retain(self, as_of: datetime.date, keep_days: int = 30) -> list[datetime.date]:
        """Delete the days before as_of less keep_days, as whole folders; no file of another day is read or written."""
        gone = [d for d in self.days() if d < as_of - datetime.timedelta(days=keep_days)]
        for d in gone:
            self._files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/day={d.isoformat()}"), True)
        return gone
