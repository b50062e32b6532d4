"""Keyed state in event-time order: rows that come out of order are held back until the watermark has passed them.

State is Spark's, in RocksDB: a restarted query goes on where it was. Keys are dealt over BUCKETS groups. A group has a
list of held rows, many to an element, and one state with a line a key; a timer on event time wakes it when the watermark
reaches its earliest held row. So what a micro-batch costs beside its rows is that of the groups, not of the keys. Calls that
wait for a price need no state of a key, so they are dealt by key and span of time.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Groups that keys are dealt over; a checkpoint is good for one number of them.
BUCKETS = 1024
#: Rows of an element of the held list, and of a frame that is put out.
CHUNK = 10_000
#: What is held of rows: keys, microseconds, points (0) before ticks (1) of one time, the order of equal ones, values.
HELD = "key array<string>, us array<long>, side array<int>, seq array<long>, value array<double>"
TYPES = {"key": object, "us": "int64", "side": "int64", "seq": "int64", "value": "float64"}
#: Windows of a call's wait whose rows of a key are dealt together; the prices of the first are wanted by the group before, too.
SPAN = 4
ASOF = "key string, seq long, us long, value double, last double"
FIRST = "key string, id string, direction string, value double, first double"
INDICATORS = "key string, seq long, us long, close double, rsi14 double, ema12 double, ewma_vol double"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

Columns = dict[str, np.ndarray]

#: The Python process in which Spark sets such a stream up doesn't get the package that the workers do, so processors are sent by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _take(rows: Columns, at) -> Columns:
    return {c: x[at] for c, x in rows.items()}


def _joined(parts: list, types: dict = TYPES) -> Columns:
    """Rows of elements of the held list, as a column each."""
    return {c: np.concatenate([np.array(p[i], dtype=t) for p in parts]) if parts else np.empty(0, t) for i, (c, t) in enumerate(types.items())}


def _ordered(rows: Columns) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows by (key, time, side, seq), and each one's key as a number, in that order."""
    codes, _ = pd.factorize(rows["key"], use_na_sentinel=False)
    order = np.lexsort((rows["value"], rows["seq"], rows["side"], rows["us"], codes))
    return order, codes[order]


class Holding(StatefulProcessor):
    """Holds rows back until the watermark has reached the time at which they are due; a subclass says what becomes of them."""

    held_as, types = HELD, TYPES

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", self.held_as)

    def due(self, rows: Columns) -> np.ndarray:
        """The microsecond at which each row is due."""
        return rows["us"]

    def give(self, held: Columns, due: np.ndarray) -> Columns:
        """What comes out for the rows of held that are due; only the others are kept."""
        raise NotImplementedError

    def _hold(self, rows: Columns) -> list[tuple]:
        """rows as elements of the held list; a timer for the first that falls due, which is fired once the watermark is over it."""
        self.handle.registerTimer(-(-int(self.due(rows).min()) // 1000) - 1)
        return [tuple(x[lo : lo + CHUNK].tolist() for x in rows.values()) for lo in range(0, len(rows["us"]), CHUNK)]

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = _joined([[frame[c].to_numpy() for c in self.types] for frame in rows], self.types)
        if len(new["us"]):
            self.held.appendList(self._hold(new))
        return iter(())  # everything waits for the watermark

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = _joined(list(self.held.get()), self.types)
        due = self.due(held) <= timerValues.getCurrentWatermarkInMs() * 1000
        if not due.any():
            return
        if due.all():
            self.held.clear()
        else:
            self.held.put(self._hold(_take(held, ~due)))
        out = self.give(held, due)
        for lo in range(0, len(out["key"]), CHUNK):
            yield pd.DataFrame(_take(out, slice(lo, lo + CHUNK)))

    def close(self) -> None:
        pass


class InOrder(Holding):
    """Hands rows on by key, in order of (time, side, seq), with a state of each key."""

    state = "value array<double>"

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.own = handle.getValueState("own", f"key array<string>, {self.state}")

    def step(self, rows: Columns, starts: np.ndarray, own: dict) -> Columns:
        """What rows give, those of a key together and in order, each key's from one of starts on; own, the keys' states, is brought up to date."""
        raise NotImplementedError

    def give(self, held, due):
        rows = _take(held, due)
        order, codes = _ordered(rows)
        own = {k: state for k, *state in zip(*self.own.get())} if self.own.exists() else {}
        out = self.step(_take(rows, order), np.flatnonzero(np.diff(codes, prepend=-1)), own)
        if own:
            self.own.update((list(own), *map(list, zip(*own.values()))))
        return out


class LastPoint(InOrder):
    """Each tick with the last point at or before it."""

    def step(self, rows, starts, own):
        n, tick = len(rows["us"]), rows["side"] == 1
        sizes = np.diff(starts, append=n)
        keys = rows["key"][starts]
        begin = np.repeat([own[k][0] if k in own else np.nan for k in keys], sizes)
        point = np.maximum.accumulate(np.where(tick, -1, np.arange(n)))  # the last point's place, of this key or one before
        last = np.where(point >= np.repeat(starts, sizes), rows["value"][point], begin)
        ends = starts + sizes - 1
        own.update((k, [v]) for k, v, known in zip(keys, last[ends].tolist(), (point[ends] >= starts).tolist()) if known)
        return _take({"key": rows["key"], "seq": rows["seq"], "us": rows["us"], "value": rows["value"], "last": last}, tick)


class Indicators(InOrder):
    """RSI, EMA and EWMA volatility of each tick: the batch recursions, one step at a time."""

    state = "n array<long>, close array<double>, gain array<double>, loss array<double>, ema array<double>, variance array<double>"
    periods = (14, 12, 20)

    def step(self, rows, starts, own):
        rsi, ema, vol = self.periods
        out = []
        for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(rows["us"])]):
            key = rows["key"][lo]
            n, before, gain, loss, mean, var = own.get(key, (0, 0.0, 0.0, 0.0, 0.0, 0.0))
            for c in rows["value"][lo:hi].tolist():
                move, r = (c - before, float(np.log(c / before))) if n else (0.0, 0.0)
                share = 1 / rsi
                keep = 1.0 if n <= rsi else 1 - share  # sums until the seed is complete
                gain, loss = keep * gain + share * max(move, 0.0), keep * loss + share * max(-move, 0.0)
                mean = c if not n else mean + 2 / (ema + 1) * (c - mean)
                var = 0.0 if not n else var + 2 / (vol + 1) * (r * r - var)
                value = np.nan if n < rsi else 100.0 if loss == 0 else 0.0 if gain == 0 else 100 - 100 / (1 + gain / loss)
                out.append((value, mean, float(np.sqrt(max(var, 0.0)))))
                n, before = n + 1, c
            own[key] = (n, before, gain, loss, mean, var)
        made = np.array(out)
        return {"key": rows["key"], "seq": rows["seq"], "us": rows["us"], "close": rows["value"], "rsi14": made[:, 0], "ema12": made[:, 1], "ewma_vol": made[:, 2]}


class FirstPrice(Holding):
    """Each call (side 0, at the first time that counts) with the first price (side 1) of its key from then on and less than `width` microseconds later.

    Time is cut into windows of `width`; the price of a call lies in the call's own window or in the next one. So calls and
    prices are due, and go, two windows from the begin of theirs on: then no price can come that a call wants, and no call that wants a price.
    """

    held_as = f"{HELD}, id array<string>, direction array<string>"
    types = TYPES | {"id": object, "direction": object}

    def __init__(self, width: int):
        self.width = width

    def due(self, rows):
        return (rows["us"] // self.width + 2) * self.width

    def give(self, held, due):
        order, codes = _ordered(held)  # a price at the call's own time comes behind it
        rows, due, n = _take(held, order), due[order], len(order)
        price = rows["side"] == 1
        following = np.minimum.accumulate(np.where(price, np.arange(n), n)[::-1])[::-1]
        call = np.flatnonzero(due & ~price & (following < n))
        at = following[call]
        good = (codes[at] == codes[call]) & (rows["us"][at] < rows["us"][call] + self.width)
        call, at = call[good], at[good]
        out = {c: rows[c][call] for c in ("key", "id", "direction", "value")} | {"first": rows["value"][at]}
        again = pd.DataFrame(out | {"key": codes[call], "first": rows["us"][call] // self.width}).duplicated()  # the earliest stays
        return _take(out, ~again.to_numpy())


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state of this kind needs RocksDB as the session's state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def _keyed(rows: DataFrame, processor: StatefulProcessor, schema: str, late: str) -> DataFrame:
    """What the processor makes of rows(key, seq, time, value, side); rows without a time have no place in an order."""
    use_rocksdb(rows.sparkSession)
    rows = rows.filter("time IS NOT NULL").withWatermark("time", late)
    dealt = rows.select("*", F.unix_micros("time").alias("us"), F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).alias("bucket"))
    made = dealt.groupBy("bucket").transformWithStateInPandas(processor, schema, "Append", "EventTime")
    return made.select(*(F.timestamp_micros("us").alias("time") if c == "us" else c for c in made.columns))


def asof_stream(ticks: DataFrame, points: DataFrame, late: str = "2 hours") -> DataFrame:
    """ticks(key, seq, time, value) with `last`, the value of the key's last point (key, seq, time, value) at or before each; NULL before the first.

    A tick comes out once the watermark has passed it, so what comes later than `late` is dropped, and the result
    doesn't depend on the order of arrival. Of points of one time the greatest seq counts.
    """
    names = ["key", "seq", "time", "value"]
    both = points.select(*names, F.lit(0).alias("side")).unionByName(ticks.select(*names, F.lit(1).alias("side")))
    return _keyed(both, LastPoint(), ASOF, late)


def indicator_stream(ticks: DataFrame, late: str = "2 hours") -> DataFrame:
    """RSI, EMA and EWMA volatility of ticks(key, seq, time, value) in event-time order, whatever the order of arrival."""
    return _keyed(ticks.select("key", "seq", "time", "value", F.lit(1).alias("side")), Indicators(), INDICATORS, late)


def first_price_stream(calls: DataFrame, prices: DataFrame, due: str, until: str, late: str = "2 hours") -> DataFrame:
    """calls(key, id, direction, value, time) with `first`, the value of the first of prices(key, seq, time, value) from `due` to less than `until` after each; those without one have no row.

    Neither side is joined with the other: both are dealt by key and span of time, sorted, and passed over once. A call comes out once the watermark has
    passed every price that its window of calls could want. The same call twice in a window counts once, with the earlier price. NULL is no price.
    """
    use_rocksdb(calls.sparkSession)
    wait, width = (int(pd.Timedelta(x) // pd.Timedelta(microseconds=1)) for x in (due, until))
    width -= wait
    us = F.unix_micros("time")
    begin = lambda at: at - F.pmod(at, F.lit(SPAN * width))
    names = ["time", "us", "key", "side", "seq", "value", "id", "direction", "span"]
    c = calls.filter("key IS NOT NULL AND time IS NOT NULL AND value IS NOT NULL").withWatermark("time", late).withColumn("us", us + F.lit(wait))
    c = c.withColumns({"side": F.lit(0), "seq": F.lit(0).cast("long"), "span": begin(F.col("us"))})
    p = prices.filter("key IS NOT NULL AND time IS NOT NULL AND value IS NOT NULL").withWatermark("time", late).withColumn("us", us)
    p = p.withColumns({"side": F.lit(1), "seq": F.coalesce("seq", F.lit(-(2**63))), "id": F.lit(None).cast("string"), "direction": F.lit(None).cast("string")})
    p = p.withColumn("span", F.explode(F.array_distinct(F.array(begin(F.col("us")), begin(F.col("us") - F.lit(width))))))
    dealt = c.select(*names).unionByName(p.select(*names)).withColumn("bucket", F.pmod(F.xxhash64("key", "span"), F.lit(BUCKETS))).drop("span")
    made = dealt.groupBy("bucket").transformWithStateInPandas(FirstPrice(width), FIRST, "Append", "EventTime")
    return made.withColumns({x: F.coalesce(x, F.lit(float("nan"))) for x in ("value", "first")})  # a frame's NaN, which comes back as NULL
