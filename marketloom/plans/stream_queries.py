"""Streaming queries run to the end of what has landed, so that their results can be read as tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.operators.daily import DayTable
from marketloom.plans.demo import BARS, bars, rr
from marketloom.plans.registry import query
from marketloom.sources import landed
from marketloom.streaming import live, ordered


def scratch(spark: SparkSession) -> str:
    """A new folder under the shared one; a local one only where the session names none, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.gettempdir()}"
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def _drain(stream: DataFrame, mode: str) -> DataFrame:
    """What the stream has written once all that has landed is read: appended files, or in complete mode the last batch's table. Nothing goes through the driver."""
    spark, folder = stream.sparkSession, scratch(stream.sparkSession)
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    if mode == "complete":
        writer = writer.foreachBatch(lambda rows, batch: rows.write.mode("overwrite").parquet(f"{folder}/out"))
    else:
        writer = writer.format("parquet").option("path", f"{folder}/out")
    writer.start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def _events(spark, d) -> DataFrame:
    return live.tick_stream(spark, d, only="events.parquet").filter("value > 0")


def _keyed(spark, d, key: str) -> DataFrame:
    return _events(spark, d).select(F.col(key).cast("string").alias("key"), F.col("event_id").alias("seq"), F.col("ts").alias("time"), "value", "event_type")


@query("stream_bars", f"WITH {BARS} SELECT symbol, open_time, open, high, low, close, CASE WHEN symbol = 'signup' THEN (SELECT count(*) FROM events e WHERE e.event_type = 'signup' AND e.value > 0 AND time_bucket(INTERVAL '1 hour', e.ts) = b.open_time)::DOUBLE ELSE volume END AS volume FROM b")
def stream_bars(spark, d):
    rows = _drain(live.bar_stream(live.tick_stream(spark, d, only="events.parquet")), "complete")
    return rows.withColumn("open_time", F.col("open_time").cast("timestamp_ntz"))


@query("stream_indicators")
def stream_indicators(spark, d):
    return _drain(live.stateful_indicators(live.tick_stream(spark, d, only="events.parquet")), "append")


#: The watermark at the end: the last event's time, in milliseconds, less two hours.
_MARK = "mark AS (SELECT (epoch_ms(max(ts)) - 7200000) * 1000 AS us FROM events WHERE value > 0)"


@query("stream_asof", f"""WITH {_MARK}, e AS (SELECT CAST(user_id AS VARCHAR) AS key, event_id AS seq, ts, value, event_type FROM events WHERE value > 0),
p AS (SELECT key, ts, arg_max(value, seq) AS last FROM e WHERE event_type = 'purchase' GROUP BY ALL)
SELECT e.key, e.seq, e.value, p.last FROM e ASOF LEFT JOIN p ON e.key = p.key AND e.ts >= p.ts, mark WHERE epoch_us(e.ts) <= mark.us""")
def stream_asof(spark, d):
    """Each event with its user's last purchase, from streams in event-time order."""
    rows = _keyed(spark, d, "user_id")
    return _drain(ordered.asof_stream(rows, rows.filter("event_type = 'purchase'")), "append").select("key", "seq", "value", "last")


_CALL = "CASE event_id % 3 WHEN 0 THEN 'UP' WHEN 1 THEN 'DOWN' ELSE 'NEUTRAL' END"


@query("stream_grades", f"""WITH {_MARK}, e AS (SELECT event_id AS id, event_type AS symbol, {_CALL} AS predicted_direction, value AS price_at_prediction, ts FROM events WHERE value > 0),
m AS (SELECT e.*, arg_min(p.value, (p.ts, p.event_id)) AS price_at_resolution FROM e JOIN events p ON p.value > 0 AND p.event_type = e.symbol AND p.ts >= e.ts + INTERVAL 60 MINUTE AND p.ts < e.ts + INTERVAL 120 MINUTE GROUP BY ALL),
g AS (SELECT *, (price_at_resolution - price_at_prediction) / price_at_prediction * 100 AS move FROM m, mark WHERE epoch_us(time_bucket(INTERVAL '1 hour', ts) + INTERVAL 3 HOUR) <= mark.us)
SELECT id, symbol, predicted_direction, {rr('price_at_prediction', 'price_at_prediction')}, {rr('price_at_resolution', 'price_at_resolution')}, {rr('move', 'move_pct')},
CASE WHEN (CASE WHEN abs(move) < 0.15 THEN predicted_direction = 'NEUTRAL' WHEN move > 0 THEN predicted_direction = 'UP' ELSE predicted_direction = 'DOWN' END) THEN 'CORRECT' ELSE 'INCORRECT' END AS actual_result FROM g""")
def stream_grades(spark, d):
    """Every event as a call, graded against the first price of its symbol one to two hours on, in a forward as-of join of two streams."""
    k, rows = F.col("event_id"), _events(spark, d)
    calls = rows.select(k.alias("id"), F.col("event_type").alias("symbol"), F.when(k % 3 == 0, "UP").when(k % 3 == 1, "DOWN").otherwise("NEUTRAL").alias("predicted_direction"), F.col("value").alias("price_at_prediction"), F.col("ts").alias("created_at"))
    prices = _events(spark, d).select(F.col("event_type").alias("symbol"), F.col("ts").alias("time"), F.col("event_id").alias("seq"), F.col("value").alias("price"))
    out = _drain(live.graded_stream(calls, prices), "append")
    return out.select("id", "symbol", "predicted_direction", *((F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("price_at_prediction", "price_at_resolution", "move_pct")), "actual_result")


def _pages(spark, d) -> DataFrame:
    """The bars as landed pages: a page a day, each with a stale copy of the next day's first bar at its end."""
    ms, day = F.unix_millis(F.col("open_time").cast("timestamp")), F.datediff("open_time", F.lit("2024-01-01"))
    numbers = [F.col(c).cast("string") for c in ("open", "high", "low", "close", "volume")]
    rows = bars(spark, d).select("symbol", day.cast("long").alias("page"), ms.alias("ms"), F.array(ms.cast("string"), *numbers).alias("k"))
    stale = rows.groupBy("symbol", "page").agg(F.min_by("k", "ms").alias("k"), F.min("ms").alias("ms")).select("symbol", (F.col("page") - 1).alias("page"), "ms", F.transform("k", lambda x, i: F.when(i == 4, F.lit("1.0")).otherwise(x)).alias("k"))
    body = F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("ms", "k"))), lambda x: x["k"]))  # a day's bars of a symbol
    return rows.unionByName(stale).groupBy("symbol", "page").agg(body.alias("body"))


_BARS = f"WITH {BARS} SELECT symbol, open_time, open, high, low, close, volume FROM b"


@query("landed_pages", _BARS)
def landed_pages(spark, d):
    """Bars read back from landed pages that overlap: the greatest page's candle counts."""
    path = scratch(spark)
    landed.land_pages(_pages(spark, d), path)
    return landed.pages_to_bars(landed.read_pages(spark, path)).withColumn("open_time", F.col("open_time").cast("timestamp_ntz"))


@query("landed_page_stream", _BARS)
def landed_page_stream(spark, d):
    """The same from a stream over the pages, upserted into day partitions as they come; a later page wins."""
    path, folder = scratch(spark), scratch(spark)
    landed.land_pages(_pages(spark, d), path)
    table = DayTable(spark, f"{folder}/bars", f"{live.SNAPSHOTS}, page long", ["symbol", "open_time"], "open_time")

    def upsert(rows: DataFrame, batch: int) -> None:
        new = landed.page_candles(rows).select("symbol", "open_time", "open", "high", "low", "close", "volume", "page").persist()
        held = table.read().select("symbol", "open_time", F.col("page").alias("__old"))
        table.write(new.join(held, ["symbol", "open_time"], "left").filter("__old IS NULL OR page >= __old").drop("__old"), batch, order="page")
        new.unpersist()

    landed.stream_pages(spark, path, 40).writeStream.foreachBatch(upsert).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return table.read().drop("page").withColumn("open_time", F.col("open_time").cast("timestamp_ntz"))
