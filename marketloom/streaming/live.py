"""The continuous loop: ticks to bars, snapshot upserts, prediction log and grading, indicators kept by state."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from marketloom.operators import store as T
from marketloom.operators.payload import append_json
from marketloom.operators.ranks import settled
from marketloom.operators.signals import latest
from marketloom.sources.bars import valid_bars
from marketloom.streaming import ordered

TICKS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
INDICATORS = "symbol string, time timestamp, close double, rsi14 double, ema12 double, ewma_vol double"
#: Rows of a symbol that are put out at a time.
CHUNK = 20_000
STATE = "n long, last double, gain double, loss double, ema double, variance double"


def tick_stream(spark: SparkSession, folder: str, files_per_batch: int = 1, only: str = "*.parquet") -> DataFrame:
    """Ticks from Parquet files as they land, with an event time that can be watermarked."""
    rows = spark.readStream.schema(TICKS).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", only).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def bar_stream(ticks: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Tumbling bars of a tick stream; ticks later than `late` are dropped with their bar's state. Ticks of one time come by event_id."""
    at = F.struct("ts", "event_id")
    grouped = ticks.filter("value > 0").withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), F.col("event_type").alias("symbol"))
    rows = grouped.agg(F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.count("*").cast("double").alias("volume"))
    return valid_bars(rows.select("symbol", F.col("w.start").alias("open_time"), "open", "high", "low", "close", "volume"))


def stateful_indicators(ticks: DataFrame, rsi: int = 14, ema: int = 12, vol: int = 20) -> DataFrame:
    """RSI, EMA and EWMA volatility of each symbol's values, carried from batch to batch: the batch recursions, one step at a time.

    Ticks of a micro-batch are ordered by time; those of an earlier time that come in a later batch follow
    in order of arrival. Half a dozen numbers are kept for each symbol, however long it runs. Of a micro-batch a task
    holds two numbers a tick of one symbol and their order; rows come out CHUNK at a time.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, last, gain, loss, mean, var = state.get if state.exists else (0, 0.0, 0.0, 0.0, 0.0, 0.0)
        parts = [(f["ts"].to_numpy("datetime64[ns]"), f["value"].to_numpy(float)) for f in frames]
        times, values = (np.concatenate(x) for x in zip(*parts))
        del parts
        order = np.argsort(times, kind="stable")
        for lo in range(0, len(order), CHUNK):
            at = order[lo : lo + CHUNK]
            out = []
            for c in values[at].tolist():
                move, r = (c - last, float(np.log(c / last))) if n else (0.0, 0.0)
                up, down = max(move, 0.0), max(-move, 0.0)
                if n <= rsi:  # sums until the seed is complete
                    gain, loss = gain + up / rsi, loss + down / rsi
                else:
                    gain, loss = (gain * (rsi - 1) + up) / rsi, (loss * (rsi - 1) + down) / rsi
                k, kv = 2 / (ema + 1), 2 / (vol + 1)
                mean, var = (k * c + (1 - k) * mean, kv * r * r + (1 - kv) * var) if n else (c, 0.0)
                value = None if n < rsi else 100.0 if loss == 0 else 0.0 if gain == 0 else 100 - 100 / (1 + gain / loss)
                out.append((c, value, mean, float(np.sqrt(var))))
                n, last = n + 1, c
            made = pd.DataFrame(out, columns=["close", "rsi14", "ema12", "ewma_vol"])
            made.insert(0, "time", times[at])
            made.insert(0, "symbol", key[0])
            yield made
        state.update((n, last, gain, loss, mean, var))

    keyed = ticks.filter("value > 0").select(F.col("event_type").alias("symbol"), "ts", "value").groupBy("symbol")
    return keyed.applyInPandasWithState(step, INDICATORS, STATE, "append", GroupStateTimeout.NoTimeout)


class BatchLog:
    """Rows by key as a log of batches in one Parquet folder: a batch appends what it changes, the latest batch's row of a key counts.

    Nothing is held in memory: a restarted query finds what was written, a batch that comes twice overwrites its own part.
    A query with a new checkpoint counts its batches from 0 again; turn() places them behind all that the log has.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str]):
        self.spark, self.path, self.schema, self.keys = spark, path, schema, keys
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{path}/batch=-1")

    def turn(self, batch: int, query: str) -> int:
        """The log's number of a query's batch. Where the query's batches begin is written before the first of them, so a repeated batch has the same number."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        folder, begun = hadoop.Path(self.path), hadoop.Path(f"{self.path}/_queries/{query}")
        files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(hadoop.Path(begun, "_SUCCESS")):
            names = [s.getPath().getName() for s in files.listStatus(folder)]
            first = 1 + max(int(n[6:]) for n in names if n.startswith("batch="))
            self.spark.range(first, first + 1).coalesce(1).write.mode("overwrite").parquet(begun.toString())
        return batch + self.spark.read.parquet(begun.toString()).first()[0]

    def read(self, upto: int | None = None) -> DataFrame:
        """The rows after batch upto (all by default), by a maximum that is aggregated before the shuffle."""
        log = self.spark.read.schema(f"{self.schema}, batch long").option("basePath", self.path).parquet(self.path)
        if upto is not None:
            log = log.filter(F.col("batch") <= upto)
        row = F.struct(*(c for c in log.columns if c != "batch"))
        return log.groupBy(*(F.col(k).alias(f"__{k}") for k in self.keys)).agg(F.max_by(row, "batch").alias("r")).select("r.*")

    def write(self, rows: DataFrame, batch: int) -> None:
        """rows, one for each key, as what batch changes."""
        rows.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")


#: A line of the steps' log.
STEPS = "batch long, step string, ok boolean, n long, error string"
SNAPSHOTS = "symbol string, open_time timestamp, open double, high double, low double, close double, volume double"
PREDICTIONS = "id string, symbol string, predicted_direction string, confidence int, price_at_prediction double, actual_result string, created_at timestamp, move_pct double, price_at_resolution double"


def _apart(batch: int, log: str | None, spark: SparkSession, steps: dict[str, Callable[[], DataFrame]]) -> dict[str, DataFrame]:
    """The rows of each step, computed; with a log, a step that fails is left out and its error is a line of it."""
    done, lines = {}, []
    for name, step in steps.items():
        try:
            done[name] = settled(step())
            lines.append((batch, name, True, done[name].count(), None))
        except Exception as e:
            if log is None:
                raise
            lines.append((batch, name, False, 0, f"{type(e).__name__}: {str(e).strip()[:500]}"))
    if log:
        append_json(spark.createDataFrame(lines, STEPS).coalesce(1), log)
    return done


def tick_loop(snapshots: BatchLog, predictions: BatchLog, predict: Callable[[DataFrame], DataFrame], log: str | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function over bars: upsert snapshots, log new calls, grade what is due at the newest time. Set-based steps.

    predict(latest rows) -> (symbol, predicted_direction, confidence). A batch that comes twice changes nothing,
    as it starts from the state after the batch before; of bars of one key in a batch any one counts. A query with a
    new checkpoint goes on behind what the tables have. Called outside of a stream, the numbers are the caller's.

    With `log`, a folder of JSON lines (STEPS), calls and grades fail apart: one's error is logged and the other's rows are
    written; what wasn't graded is still due in the next batch. Bars that cannot be written always fail the batch, so that it comes again.
    """

    def run(bars: DataFrame, batch: int) -> None:
        fresh = bars.persist()
        try:
            if fresh.isEmpty():
                return
            spark = bars.sparkSession
            query = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
            at, batch = (snapshots.turn(batch, query), predictions.turn(batch, query)) if query else (batch, batch)
            snapshots.write(fresh.select(*snapshots.read().columns).dropDuplicates(snapshots.keys), at)
            now = latest(snapshots.read(at))
            as_of = F.lit(now.agg(F.max("open_time")).first()[0])
            old = predictions.read(batch - 1)

            def new_calls() -> DataFrame:
                calls = predict(now).join(now.select("symbol", "open_time", "close"), "symbol")
                new = T.predictions_to_log(calls).select(
                    F.concat_ws("@", "symbol", F.col("open_time").cast("string")).alias("id"), "symbol", "predicted_direction", "confidence", F.col("close").alias("price_at_prediction"),
                    F.lit("PENDING").alias("actual_result"), F.col("open_time").alias("created_at"), F.lit(None).cast("double").alias("move_pct"), F.lit(None).cast("double").alias("price_at_resolution"),
                )
                return new.dropDuplicates(["id"]).join(old.select("id"), "id", "left_anti").select(*old.columns)

            def grades() -> DataFrame:
                pending = T.due(old, as_of, limit=None)
                return T.grade(pending.drop("move_pct", "price_at_resolution"), now.select("symbol", F.col("close").alias("price"))).select(*old.columns)

            done = _apart(batch, log, spark, {"calls": new_calls, "grades": grades})
            if done:
                predictions.write(reduce(DataFrame.unionByName, done.values()), batch)
        finally:
            fresh.unpersist()

    return run


def graded_stream(calls: DataFrame, prices: DataFrame, due: str = "60 minutes", until: str = "120 minutes", late: str = "2 hours") -> DataFrame:
    """calls(id, symbol, predicted_direction, price_at_prediction, created_at) graded against the first of prices(symbol, time, seq, price) from `due` to `until` after each.

    An as-of join forward in time of two watermarked streams: what it costs grows with the rows, not with the prices that
    each call could take. The earliest match of a call is known, and the call comes out, when the watermark has passed every price that could be
    one: the result is that of a batch, whatever the order of arrival within `late`. Calls of price 0 and those without a price in time have no row.
    """
    keys = {"id": "id", "symbol": "key", "predicted_direction": "direction", "price_at_prediction": "value"}
    kinds = {name: "double" if held == "value" else "string" for name, held in keys.items()}
    c = calls.filter("price_at_prediction <> 0").select(F.col("created_at").alias("time"), *(F.col(name).cast(kinds[name]).alias(held) for name, held in keys.items()))
    p = prices.select("time", F.col("symbol").cast("string").alias("key"), F.col("seq").cast("long").alias("seq"), F.col("price").cast("double").alias("value"))
    first = ordered.first_price_stream(c, p, due, until, late)
    first = first.select(*(F.col(held).cast(calls.schema[name].dataType).alias(name) for name, held in keys.items()), F.col("first").alias("price_at_resolution"))
    move = (F.col("price_at_resolution") - F.col("price_at_prediction")) / F.col("price_at_prediction") * 100
    graded = first.select("*", move.alias("move_pct"))
    return graded.withColumn("actual_result", T.result_of(F.col("predicted_direction"), F.col("move_pct")))


def retrain_every(n: int, fit: Callable[[DataFrame], object], keep: int = 500) -> tuple[Callable[[DataFrame, int], None], list]:
    """A foreachBatch function that refits on the last rows after every n new ones, and the list of models, newest last."""
    models: list = []
    seen = {"since": 0, "rows": None}

    def run(rows: DataFrame, batch: int) -> None:
        recent = rows if seen["rows"] is None else seen["rows"].unionByName(rows)
        recent = recent.orderBy(F.desc("open_time")).limit(keep).toPandas()  # a bounded number of bars
        seen["rows"] = rows.sparkSession.createDataFrame(recent, rows.schema)
        seen["since"] += rows.count()
        if seen["since"] >= n:
            models.append(fit(seen["rows"]))
            seen["since"] = 0

    return run, models
