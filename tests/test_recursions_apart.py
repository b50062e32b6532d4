"""Recursions whose blocks run apart: numbering by parts, dealing by symbol and block, parabolic stops against a loop."""

import datetime
import math

import numpy as np
from pyspark.sql import functions as F

from marketloom.operators import recursive as R
from marketloom.operators import stops as P
from marketloom.sources import bars as B

BAR = "symbol string, open_time timestamp, high double, low double, close double"
T0 = datetime.datetime(2024, 1, 1)


def rows_of(n, seed=0, symbol="A"):
    rng = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
    high, low = close * (1 + rng.random(n) / 100), close * (1 - rng.random(n) / 100)
    return [(symbol, T0 + datetime.timedelta(minutes=30 * i), *map(float, x)) for i, x in enumerate(zip(high, low, close))]


def loop(rows):
    """(stop, rises) of each bar, written out for one pass."""
    out, side, extreme, pace, stop = [(None, True)], 1, rows[0][2], 0.02, rows[0][3]
    for i in range(1, len(rows)):
        along, against = (rows[i][2], rows[i][3]) if side == 1 else (rows[i][3], rows[i][2])
        stop += pace * (extreme - stop)
        for j in range(max(0, i - 2), i):
            limit = rows[j][3] if side == 1 else rows[j][2]
            stop = min(stop, limit) if side == 1 else max(stop, limit)
        if side * against < side * stop:
            side, stop, extreme, pace = -side, extreme, against, 0.02
        elif side * along > side * extreme:
            extreme, pace = along, min(pace + 0.02, 0.2)
        out.append((stop, side == 1))
    return out


def test_index_by_parts_is_the_row_number(spark):
    rows = spark.createDataFrame([*rows_of(300), *rows_of(7, symbol="B"), *rows_of(60, symbol=None)], BAR)
    key = lambda df: sorted(map(str, df.select("symbol", "open_time", "idx").collect()))
    assert key(B.index_by_parts(rows)) == key(B.with_index(rows))
    assert B.index_by_parts(rows.limit(0)).count() == 0


def test_blocks_are_dealt_by_symbol_and_block(spark):
    """No exchange of the recursions is by symbol alone but that of the day counts, and one symbol's blocks lie in several partitions."""
    rows = spark.createDataFrame(rows_of(4000), BAR)
    parts = R.in_blocks(rows, block=100, halo=20)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert parts.select(F.spark_partition_id()).distinct().count() > 3
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    whole, apart = R.with_recursive(rows, ("rsi14", "ema12", "adx14")), R.with_recursive(rows, ("rsi14", "ema12", "adx14"), block=2100, halo=2048)
    a, b = ([r[2:] for r in df.select("symbol", "open_time", "rsi14", "ema12", "adx14").orderBy("open_time").collect()] for df in (whole, apart))
    assert len(a) == len(b) == 4000 and all((x is None) == (y is None) and (x is None or math.isclose(x, y, rel_tol=1e-9)) for p, q in zip(a, b) for x, y in zip(p, q))


def test_parabolic_stops_equal_a_loop_whatever_the_blocks(spark):
    data = {"A": rows_of(900, 1), "B": rows_of(130, 2, "B"), "C": rows_of(1, 3, "C")}
    rows = spark.createDataFrame([r for part in data.values() for r in part], BAR).withColumn("idx", F.lit(7)).withColumn("psar_up", F.lit("clash"))
    want = {(s, r[1]): w for s, part in data.items() for r, w in zip(part, loop(part))}
    for block, halo in ((10_000, 100), (130, 60), (16, 2)):
        got = P.parabolic_stops(rows, block, halo)
        assert got.columns == [*(c for c in rows.columns if c != "psar_up"), *P.NAMES]
        found = {(r["symbol"], r["open_time"]): r for r in got.collect()}
        assert found.keys() == want.keys() and {r["idx"] for r in found.values()} == {7}
        for k, (stop, rises) in want.items():
            r = found[k]
            assert (r["psar_up"], r["psar_down"]) == ((stop, None) if rises else (None, stop)), (block, k)
        for s, part in data.items():
            sides = [rises for _, rises in loop(part)]
            turned = [(int(y and not x), int(x and not y)) for x, y in zip([True, *sides], sides)]
            assert [(found[s, r[1]]["psar_up_indicator"], found[s, r[1]]["psar_down_indicator"]) for r in part] == turned


def test_wrong_guesses_run_again(spark):
    """A long climb never turns, so what a short halo leads to is wrong, and blocks run again until all are right."""
    climb = [("A", T0 + datetime.timedelta(hours=i), 100.0 + i, 99.0 + i, 99.5 + i) for i in range(100)]
    rows = spark.createDataFrame(climb, BAR)
    parts = P.settled(R.in_blocks(rows, 16, 2)).cache()
    assert P._states(parts, 16)[1] > 0
    got = [r[0] for r in P.parabolic_stops(rows, 16, 2).orderBy("open_time").select("psar_up").collect()]
    assert got == [stop for stop, _ in loop(climb)]


def test_parabolic_stops_of_missing_prices(spark):
    data = rows_of(60, 4)
    holes = [(s, t, None if i in (0, 20) else h, float("nan") if i == 21 else lo, c) for i, (s, t, h, lo, c) in enumerate(data)]
    got = P.parabolic_stops(spark.createDataFrame(holes, BAR), 16, 4).orderBy("open_time").collect()
    want = iter(loop([r for i, r in enumerate(data) if i not in (0, 20, 21)]))
    for i, r in enumerate(got):
        expected = (None, None, 0, 0) if i in (0, 20, 21) else None
        if expected:
            assert tuple(r[n] for n in P.NAMES) == expected
        else:
            stop, rises = next(want)
            assert (r["psar_up"], r["psar_down"]) == ((stop, None) if rises else (None, stop))
    assert P.parabolic_stops(spark.createDataFrame([], BAR)).count() == 0
