"""Parabolic stops (Wilder 1978): a recursion that changes sides, so that no affine map carries it from block to block.

Blocks run apart, each from a guess: the state that its halo leads to. Stops forget their past at a turn that they share, so
nearly all guesses are right to the last bit. Where the state that the block before hands on is another, the block
runs again from that one, until none differs: the result is that of one pass over all bars.
"""

from __future__ import annotations

import itertools
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from marketloom.operators.ranks import settled
from marketloom.operators.recursive import BLOCK, HALO, in_blocks
from marketloom.sources.bars import index_by_parts

#: The pace towards the extreme: its first value, what each new extreme adds, and its bound.
STEP, MOST = 0.02, 0.2
NAMES = ("psar_up", "psar_down", "psar_up_indicator", "psar_down_indicator")
_STATE = "rising: boolean, stop: double, extreme: double, pace: double"
KEYS = ("symbol", "__block")


class Stop(NamedTuple):
    """Where the stop stands behind a bar, the farthest price since the last turn, and the pace towards it."""

    rising: bool
    stop: float
    extreme: float
    pace: float

    def after(self, high: float, low: float, near: list[tuple[float, float]]) -> Stop:
        """Behind the next bar; near are (high, low) of up to two bars before it, past which the stop doesn't go."""
        aim = self.stop + self.pace * (self.extreme - self.stop)
        if self.rising:
            aim = min(aim, *(lo for _, lo in near))
            if low < aim:
                return Stop(False, self.extreme, low, STEP)
            fresh = high > self.extreme
        else:
            aim = max(aim, *(hi for hi, _ in near))
            if high > aim:
                return Stop(True, self.extreme, high, STEP)
            fresh = low < self.extreme
        if not fresh:
            return Stop(self.rising, aim, self.extreme, self.pace)
        return Stop(self.rising, aim, high if self.rising else low, min(self.pace + STEP, MOST))


def walk(bars: list[tuple[float, float]], at: int, state: Stop | None = None) -> list[Stop]:
    """The states behind bars[at:], from the one behind bars[at - 1]; without one the bar at `at` begins a rise at its low."""
    out = []
    for i in range(at, len(bars)):
        state = state.after(*bars[i], bars[max(i - 2, 0) : i]) if state else Stop(True, bars[i][1], bars[i][0], STEP)
        out.append(state)
    return out


def _read(table: pa.Table, block: int) -> tuple[pa.Table, list[tuple[float, float]], int]:
    """A block's rows in order, their (high, low), and how many of them are its halo."""
    table = table.sort_by("idx")
    bars = list(zip(*(table.column(c).cast(pa.float64()).to_pylist() for c in ("high", "low"))))
    return table, bars, int((table.column("idx").to_numpy() // block < table.column("__block")[0].as_py()).sum())


def _handed(start: pa.Table) -> Stop | None:
    return Stop(*(start.column(c)[0].as_py() for c in Stop._fields)) if start.num_rows and start.column("stop")[0].is_valid else None


def _of(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """The rows of some blocks."""
    some = blocks.select(F.col("symbol").alias("__s"), F.col("__block").alias("__b"))
    return rows.join(some, F.col("symbol").eqNullSafe(F.col("__s")) & (F.col("__block") == F.col("__b")), "left_semi")


def _states(parts: DataFrame, block: int) -> tuple[DataFrame, int]:
    """The state that each block begins with, (symbol, __block, state), and how often blocks ran again for it."""
    kinds = (pa.bool_(), pa.float64(), pa.float64(), pa.float64())
    schema = StructType([parts.schema["symbol"], *StructType.fromDDL(f"__block long, began struct<{_STATE}>, ended struct<{_STATE}>")])

    def run(table: pa.Table, start: pa.Table) -> pa.Table:
        key = table.slice(0, 1).select(["symbol", "__block"])
        table, rows, at = _read(table, block)
        began = _handed(start) if start.num_rows else (walk(rows[:at], 0)[-1] if at else None)
        ended = walk(rows, at, began)[-1] if at < len(rows) else None
        state = pa.struct(list(zip(Stop._fields, kinds)))
        for name, value in (("began", began), ("ended", ended)):
            key = key.append_column(name, pa.array([value and value._asdict()], state))
        return key.slice(0, 1 if ended else 0)  # a block of a halo alone has no bars

    def ran(rows: DataFrame, starts: DataFrame) -> DataFrame:
        return settled(rows.groupBy(*KEYS).cogroup(starts.groupBy(*KEYS)).applyInArrow(run, schema))

    found = ran(parts, parts.select(*KEYS, *(F.lit(None).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(_STATE))).limit(0))
    before = Window.partitionBy("symbol").orderBy("__block")  # a row for each block
    for again in itertools.count():
        handed = found.withColumn("handed", F.lag("ended").over(before))
        wrong = settled(handed.filter(~F.col("began").eqNullSafe(F.col("handed"))).select(*KEYS, "handed.*"))
        if wrong.isEmpty():
            return handed.select(*KEYS, "handed.*"), again
        some = wrong.select(F.col("symbol").alias("__s"), F.col("__block").alias("__b"))
        right = found.join(some, F.col("symbol").eqNullSafe(F.col("__s")) & (F.col("__block") == F.col("__b")), "left_anti")
        found = settled(right.unionByName(ran(_of(parts, wrong), wrong)))


def parabolic_stops(bars: DataFrame, block: int = BLOCK, halo: int = HALO) -> DataFrame:
    """bars(symbol, open_time, high, low, ...) with NAMES behind.

    psar_up is the stop under a rise, psar_down the one over a fall; one of them is NULL, both are at a symbol's first
    bar, which begins a rise. The indicators are 1 at the bar that turned into a rise or a fall, else 0. Bars without a high
    or a low have NULL stops and indicators of 0, and the others are as if those weren't there. An empty table gives no rows.
    """
    block, halo, kept = max(block, 2), max(halo, 2), [c for c in bars.columns if c not in NAMES]
    rows = bars.select(*kept)
    known = F.coalesce(~F.isnan("high") & ~F.isnan("low") & F.col("high").isNotNull() & F.col("low").isNotNull(), F.lit(False))
    parts = settled(in_blocks(index_by_parts(rows.filter(known).withColumnRenamed("idx", "__idx")), block, halo))
    starts, _ = _states(parts, block)
    schema = StructType([*rows.schema, *StructType.fromDDL("psar_up double, psar_down double, psar_up_indicator int, psar_down_indicator int")])

    def shown(table: pa.Table, start: pa.Table) -> pa.Table:
        table, prices, at = _read(table, block)
        before = _handed(start)
        states = walk(prices, at, before)
        out = table.slice(at).drop_columns(["idx"])
        out = out.rename_columns(["idx" if c == "__idx" else c for c in out.column_names]).select(kept)
        past = [before, *states]
        for side, name in ((True, "psar_up"), (False, "psar_down")):
            out = out.append_column(name, pa.array([s.stop if p and s.rising is side else None for p, s in zip(past, states)], pa.float64()))
        for side, name in ((True, "psar_up_indicator"), (False, "psar_down_indicator")):
            out = out.append_column(name, pa.array([int(bool(p) and p.rising is not s.rising and s.rising is side) for p, s in zip(past, states)], pa.int32()))
        return out

    done = parts.groupBy(*KEYS).cogroup(starts.groupBy(*KEYS)).applyInArrow(shown, schema)
    return done.unionByName(rows.filter(~known).select("*", *(F.lit(None).cast("double").alias(c) for c in NAMES[:2]), *(F.lit(0).alias(c) for c in NAMES[2:])))
