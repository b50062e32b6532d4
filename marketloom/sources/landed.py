"""Landed pages of exchange JSON: a folder for each symbol and page, read by Spark's own file source in batch and in streams.

The layout is path/symbol=S/page=N/*.txt, a file a body. Symbol and page are partition columns, so a filter on them
chooses folders; a stream's file log is its cursor: a restarted query reads no page twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.sources.bars import KLINES, valid_bars

PAGES = "value string, symbol string, page long"


def land_pages(pages: DataFrame, path: str) -> None:
    """Append pages(symbol, page, body) to the folder; null symbols, pages and bodies are left out."""
    rows = pages.dropna(subset=["symbol", "page", "body"])
    rows.select(F.col("symbol"), F.col("page").cast("long"), F.col("body").alias("value")).write.mode("append").partitionBy("symbol", "page").text(path)


def _named(rows: DataFrame) -> DataFrame:
    return rows.select("symbol", "page", F.col("value").alias("body"))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(symbol, page, body): every line of a page's files is a body, as land_pages() writes them."""
    return _named(spark.read.schema(PAGES).text(path))


def stream_pages(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """read_pages() as a stream, some files a batch."""
    return _named(spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_per_batch).text(path))


def page_candles(pages: DataFrame) -> DataFrame:
    """(symbol, page, seq, open_time, open, high, low, close, volume) of pages of positional klines; a body that is no array of them gives nothing."""
    rows = pages.select("symbol", "page", F.posexplode(F.from_json("body", KLINES)).alias("seq", "k"))
    numbers = [F.try_element_at("k", F.lit(i + 1)).try_cast("double").alias(n) for i, n in enumerate(("ms", "open", "high", "low", "close", "volume"))]
    rows = rows.select("symbol", "page", "seq", *numbers).filter("ms IS NOT NULL")
    return rows.withColumn("open_time", F.timestamp_millis(F.col("ms").cast("long"))).drop("ms")


def pages_to_bars(pages: DataFrame) -> DataFrame:
    """Bars of landed pages: of an open time that several pages have, the candle of the greatest page counts, and there the last. One aggregate, combined before its shuffle."""
    candle = F.struct("open", "high", "low", "close", "volume")
    last = page_candles(pages).groupBy("symbol", "open_time").agg(F.max_by(candle, F.struct("page", "seq")).alias("c"))
    return valid_bars(last.select("symbol", "open_time", "c.*"))
