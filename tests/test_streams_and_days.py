"""Streams equal batches whatever the order of arrival and after a restart; day partitions; landed pages."""

import datetime
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketloom.operators import recursive as R
from marketloom.operators.daily import DayTable
from marketloom.sources import landed
from marketloom.streaming import live, ordered

T0 = datetime.datetime(2024, 1, 1)
KEYED = "key string, seq long, time timestamp, value double, point boolean"


def files(spark, folder, parts, schema):
    """Each part as one file, read in this order."""
    os.makedirs(folder, exist_ok=True)
    for i, rows in enumerate(parts):
        made = f"{folder}-part{i}"
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(made)
        name = next(f for f in os.listdir(made) if f.endswith(".parquet"))
        os.rename(f"{made}/{name}", f"{folder}/{i}.parquet")
        os.utime(f"{folder}/{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))


def drained(stream, out, state):
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out).collect()


def ticks(n=120):
    rng = np.random.default_rng(4)
    return [(f"k{i % 2}", i, T0 + datetime.timedelta(minutes=int(5 * i)), float(rng.uniform(50, 60)), bool(i % 3 == 0)) for i in range(n)]


def shuffled(rows, late=10):
    """Four parts; inside and across them rows come up to `late` places out of order."""
    order = sorted(range(len(rows)), key=lambda i: i + np.random.default_rng(i).integers(0, late))
    cut = len(rows) // 4
    return [[rows[i] for i in order[k * cut : (k + 1) * cut if k < 3 else None]] for k in range(4)]


def test_asof_stream_equals_batch_after_shuffling_and_a_restart(spark, tmp_path):
    rows = ticks()
    parts = shuffled(rows)
    files(spark, str(tmp_path / "in"), parts[:2], KEYED)

    def stream():
        read = spark.readStream.schema(KEYED).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        return ordered.asof_stream(read, read.filter("point"), "1 hour")

    first = drained(stream(), str(tmp_path / "out"), str(tmp_path / "state"))
    for i, p in enumerate(parts[2:], 2):  # what lands while the query is down
        files(spark, str(tmp_path / f"more{i}"), [p], KEYED)
        os.rename(tmp_path / f"more{i}" / "0.parquet", tmp_path / "in" / f"{i}.parquet")
    got = drained(stream(), str(tmp_path / "out"), str(tmp_path / "state"))
    mark = max(r[2] for r in rows) - datetime.timedelta(hours=1)
    want = set()
    for key, seq, t, value, _ in rows:
        before = [r for r in rows if r[0] == key and r[4] and r[2] <= t]
        if t <= mark:
            want.add((key, seq, value, max(before, key=lambda r: r[2])[3] if before else None))
    assert 0 < len(first) < len(got) and {(r["key"], r["seq"], r["value"], r["last"]) for r in got} == want and len(got) == len(want)


def test_indicator_stream_equals_batch_recursions(spark, tmp_path):
    rows = ticks(160)
    files(spark, str(tmp_path / "in"), shuffled(rows), KEYED)
    read = spark.readStream.schema(KEYED).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = drained(ordered.indicator_stream(read, "1 hour"), str(tmp_path / "out"), str(tmp_path / "state"))
    for key in ("k0", "k1"):
        own = sorted((r for r in got if r["key"] == key), key=lambda r: r["time"])
        c = np.array([r[3] for r in rows if r[0] == key])[: len(own)]
        assert [r["close"] for r in own] == c.tolist()
        np.testing.assert_allclose([r["ema12"] for r in own], R.ema(c, 12), rtol=1e-9)
        np.testing.assert_allclose([r["rsi14"] for r in own][14:], R.rsi(c)[14:], rtol=1e-7)
        np.testing.assert_allclose([r["ewma_vol"] for r in own], R.ewma_vol(c), rtol=1e-7, atol=1e-12)
        assert all(r["rsi14"] is None for r in own[:14])


def test_graded_stream_equals_batch_with_late_rows(spark, tmp_path):
    rng = np.random.default_rng(2)
    prices = [("A", T0 + datetime.timedelta(minutes=7 * i), i, float(rng.uniform(99, 101))) for i in range(120)]
    calls = [(i, "A", ("UP", "DOWN", "NEUTRAL")[i % 3], 0.0 if i == 5 else 100.0, T0 + datetime.timedelta(minutes=11 * i)) for i in range(70)]
    ps, cs = "symbol string, time timestamp, seq long, price double", "id long, symbol string, predicted_direction string, price_at_prediction double, created_at timestamp"
    files(spark, str(tmp_path / "p"), shuffled(prices, 6), ps)
    files(spark, str(tmp_path / "c"), shuffled(calls, 6), cs)
    read = lambda name, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
    got = {r["id"]: r for r in drained(live.graded_stream(read("c", cs), read("p", ps)), str(tmp_path / "out"), str(tmp_path / "state"))}
    hour, mark = datetime.timedelta(hours=1), min(max(r[1] for r in prices), max(r[4] for r in calls)) - datetime.timedelta(hours=2)
    want = {}
    for i, _, direction, at, t in calls:
        later = [p for p in prices if t + hour <= p[1] < t + 2 * hour]
        if at and later and t.replace(minute=0) + 3 * hour <= mark:
            now = min(later, key=lambda p: p[1])[3]
            move = (now - at) / at * 100
            want[i] = (now, "CORRECT" if direction == ("NEUTRAL" if abs(move) < 0.15 else "UP" if move > 0 else "DOWN") else "INCORRECT")
    assert len(want) > 20 and {i: (r["price_at_resolution"], r["actual_result"]) for i, r in got.items()} == want


def day_files(table):
    return {f: sorted(os.listdir(f"{table.path}/{f}")) for f in os.listdir(table.path) if f.startswith("day=")}


def test_day_table_rewrites_only_touched_days(spark, tmp_path):
    table = DayTable(spark, str(tmp_path / "t"), live.SNAPSHOTS, ["symbol", "open_time"], "open_time")
    bar = lambda day, hour, c: ("A", T0 + datetime.timedelta(days=day, hours=hour), c, c, c, c, 1.0)
    make = lambda rows: spark.createDataFrame(rows, live.SNAPSHOTS)
    assert table.read().count() == 0 and table.write(make([])) == []
    table.write(make([bar(d, 1, float(d)) for d in range(5)] + [("A", None, 1.0, 1.0, 1.0, 1.0, 1.0)]))
    before = day_files(table)
    new = make([bar(2, 1, 20.0), bar(2, 3, 21.0)])
    assert table.write(new) == [datetime.date(2024, 1, 3)]
    after = day_files(table)
    assert {d for d in after if after[d] != before[d]} == {"day=2024-01-03"}
    table.write(new)  # a batch that comes twice
    assert sorted(r["close"] for r in table.read().collect()) == [0.0, 1.0, 3.0, 4.0, 20.0, 21.0]
    kept = day_files(table)
    assert table.retain(datetime.date(2024, 1, 5), 2) == [datetime.date(2024, 1, 1), datetime.date(2024, 1, 2)]
    assert day_files(table) == {d: f for d, f in kept.items() if d >= "day=2024-01-03"} and table.read().count() == 4
    assert DayTable(spark, str(tmp_path / "t"), live.SNAPSHOTS, ["symbol", "open_time"], "open_time").days() == table.days()


def test_loop_over_day_tables(spark, tmp_path):
    tables = DayTable(spark, str(tmp_path / "s"), live.SNAPSHOTS, ["symbol", "open_time"], "open_time"), DayTable(spark, str(tmp_path / "p"), live.PREDICTIONS, ["id"], "created_at")
    loop = live.tick_loop(*tables, lambda now: now.select("symbol", F.lit("UP").alias("predicted_direction"), F.lit(50).alias("confidence")))
    bar = lambda h, c: spark.createDataFrame([("A", T0 + datetime.timedelta(hours=h), c, c, c, c, 1.0)], live.SNAPSHOTS)
    loop(bar(0, 100.0), 0)
    loop(bar(26, 110.0), 1)
    before = sorted(map(tuple, tables[1].read().collect()))
    loop(bar(26, 110.0), 1)
    assert sorted(map(tuple, tables[1].read().collect())) == before and sorted(r[5] for r in before) == ["CORRECT", "PENDING"]


PAGE = '[["{0}","1","2","0.5","{1}","9"]]'


def test_landed_pages(spark, tmp_path):
    rows = [("BTC/USDT", 1, PAGE.format(1000, "5")), ("BTC/USDT", 10, PAGE.format(1000, "6")), ("BTC/USDT", 2, PAGE.format(1000, "7")), ("ETH", 1, PAGE.format(2000, "8")), ("ETH", 2, "not json"), ("ETH", 3, "[]"), ("ETH", 4, '[["x"],[null,"1"]]'), (None, 1, "[]"), ("ETH", 5, None)]
    landed.land_pages(spark.createDataFrame(rows, "symbol string, page long, body string"), str(tmp_path / "in"))
    pages = landed.read_pages(spark, str(tmp_path / "in"))
    assert {(r["symbol"], r["close"]) for r in landed.pages_to_bars(pages).collect()} == {("BTC/USDT", 6.0), ("ETH", 8.0)}
    plan = pages.filter("symbol = 'ETH' AND page = 1")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull" in plan and pages.filter("symbol = 'ETH' AND page = 1").count() == 1
    stream = landed.stream_pages(spark, str(tmp_path / "in"), 2)
    assert len(drained(stream, str(tmp_path / "out"), str(tmp_path / "state"))) == 7
    landed.land_pages(spark.createDataFrame([("ETH", 6, "[]")], "symbol string, page long, body string"), str(tmp_path / "in"))
    assert len(drained(landed.stream_pages(spark, str(tmp_path / "in"), 2), str(tmp_path / "out"), str(tmp_path / "state"))) == 8  # the new page alone was read


@pytest.mark.parametrize("move, direction, want", [(0.1, "NEUTRAL", "CORRECT"), (0.2, "UP", "CORRECT"), (-0.2, "UP", "INCORRECT"), (-0.2, "DOWN", "CORRECT")])
def test_result_of_a_move(spark, move, direction, want):
    from marketloom.operators.store import result_of

    assert spark.range(1).select(result_of(F.lit(direction), F.lit(move))).first()[0] == want


def test_indicators_of_a_batch_come_out_in_chunks(spark, monkeypatch):
    """A symbol's micro-batch is never one frame, and its chunks are the rows of one pass."""
    ticks_ = spark.createDataFrame([], live.TICKS)
    monkeypatch.setattr(type(ticks_.groupBy()), "applyInPandasWithState", lambda self, step, *rest: step)
    step = live.stateful_indicators(ticks_)
    times, values = pd.date_range(T0, periods=45_000, freq="s"), np.random.default_rng(5).uniform(50, 60, 45_000)
    order = np.random.default_rng(6).permutation(45_000)
    frames = [pd.DataFrame({"ts": times[order[a : a + 10_000]], "value": values[order[a : a + 10_000]]}) for a in range(0, 45_000, 10_000)]

    class State:
        exists, get, kept = False, None, None

        def update(self, new):
            self.kept = new

    state = State()
    out = list(step(("A",), iter(frames), state))
    assert max(map(len, out)) <= 20_000 and sum(map(len, out)) == 45_000 and state.kept[0] == 45_000
    rows = pd.concat(out)
    assert (rows["time"].to_numpy() == times.to_numpy()).all() and (rows["close"].to_numpy() == values).all() and rows["rsi14"].isna().sum() == 14
    up, down = np.maximum(np.diff(values), 0), np.maximum(-np.diff(values), 0)
    gain, loss = up[:14].mean(), down[:14].mean()
    for u, d in zip(up[14:], down[14:]):
        gain, loss = (gain * 13 + u) / 14, (loss * 13 + d) / 14
    assert abs(rows["rsi14"].iloc[-1] - (100 - 100 / (1 + gain / loss))) < 1e-9


class Handle:
    """A processor's handle without a stream: its state, the elements that were written, the timers."""

    def __init__(self):
        self.written, self.timers = [], []

    def registerTimer(self, ms):
        self.timers.append(ms)

    def getListState(self, name, schema):
        outer, rows = self, []

        class Held:
            def get(self):
                return iter(list(rows))

            def appendList(self, new):
                outer.written += new
                rows.extend(new)

            def put(self, new):
                rows.clear()
                self.appendList(new)

            clear = lambda self: rows.clear()

        return Held()

    def getValueState(self, name, schema):
        class Own:
            kept = None
            exists = lambda self: self.kept is not None
            get = lambda self: self.kept

            def update(self, new):
                self.kept = new

        return Own()


class Mark:
    def __init__(self, ms):
        self.getCurrentWatermarkInMs = lambda: ms


def test_many_keys_of_a_group_are_held_in_few_elements():
    """What a micro-batch holds is written many rows at a time, whatever the number of keys; points of a batch before count in the next."""
    rng = np.random.default_rng(8)
    n = 24_000
    rows = pd.DataFrame({"key": [f"k{i}" for i in rng.integers(0, 600, n)], "seq": rng.permutation(n), "us": rng.integers(0, 4_000_000, n) * 1000, "side": rng.integers(0, 4, n).clip(0, 1), "value": rng.uniform(1, 9, n)})
    rows.loc[rows.index[::50], "key"] = None
    handle, processor = Handle(), ordered.LastPoint()
    processor.init(handle)
    got, elements = [], []
    for part, mark in ((rows[rows["us"] < 2_000_000_000], 1_500_000), (rows[rows["us"] >= 2_000_000_000], 3_000_000)):
        assert list(processor.handleInputRows((7,), iter(np.array_split(part.sample(frac=1, random_state=1), 5)), None)) == []
        elements.append(len(handle.written))
        assert handle.timers[-1] < part["us"].min() / 1000 <= handle.timers[-1] + 1
        got += list(processor.handleExpiredTimer((7,), Mark(mark), None))
        assert list(processor.handleExpiredTimer((7,), Mark(mark), None)) == []  # a second timer of the group
    assert elements[0] == 2 and len(handle.written) <= 8 and max(map(len, got)) <= ordered.CHUNK
    want, last = {}, {}
    for r in rows.sort_values(["us", "side", "seq"]).itertuples():
        if r.side == 0:
            last[r.key] = r.value
        elif r.us <= 3_000_000_000:
            want[r.seq] = (r.key, r.us, r.value, last.get(r.key))
    made = {r.seq: (r.key, r.us, r.value, None if np.isnan(r.last) else r.last) for r in pd.concat(got).itertuples()}
    clean = lambda rows_: {s: (None if k != k else k, *rest) for s, (k, *rest) in rows_.items()}
    assert clean(made) == clean(want) and sum(map(len, got)) == len(want) and any(v[3] is None for v in want.values())


def test_a_row_at_the_watermark_itself_comes_out_and_zones_do_not_matter(spark, tmp_path):
    rows = [("a", 0, T0, 1.0, True), ("b", 1, T0 + datetime.timedelta(minutes=30), 2.0, False), ("c", 2, T0 + datetime.timedelta(minutes=90), 3.0, False), (None, 3, None, 4.0, False)]
    files(spark, str(tmp_path / "in"), [rows], KEYED)
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        read = spark.readStream.schema(KEYED).parquet(str(tmp_path / "in"))
        stream = ordered.asof_stream(read, read.filter("point"), "1 hour").withColumn("s", F.unix_seconds("time"))
        got = drained(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    start = int(T0.replace(tzinfo=datetime.timezone.utc).timestamp())
    assert {(r["key"], r["seq"], r["s"] - start, r["last"]) for r in got} == {("a", 0, 0, 1.0), ("b", 1, 1800, None)}


CALLS = "id long, symbol string, predicted_direction string, price_at_prediction double, created_at timestamp"
PRICES = "symbol string, time timestamp, seq long, price double"


def graded(spark, folder, calls, prices):
    """What graded_stream gives for these parts, and the progress of its micro-batches."""
    files(spark, f"{folder}/c", calls, CALLS)
    files(spark, f"{folder}/p", prices, PRICES)
    read = lambda name, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/{name}")
    stream = live.graded_stream(read("c", CALLS), read("p", PRICES))
    run = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out").collect(), run.recentProgress


def test_grading_costs_rows_not_pairs(spark, tmp_path):
    """A call of a dense symbol could take a thousand prices; what the state is written with are elements of many rows, neither rows nor pairs."""
    rng = np.random.default_rng(12)
    n, hours = 6_000, 7
    at, when = np.sort(rng.integers(0, hours * 3600, n)), np.sort(rng.integers(0, hours * 3600, n))
    price = rng.uniform(99, 101, n)
    time = lambda s: T0 + datetime.timedelta(seconds=int(s))
    calls = [(i, "A", "UP", 100.0, time(s)) for i, s in enumerate(at)]
    prices = [("A", time(s), i, float(price[i])) for i, s in enumerate(when)]
    got, progress = graded(spark, str(tmp_path), [calls[: n // 2], calls[n // 2 :]], [prices[: n // 2], prices[n // 2 :]])
    mark, first = min(at[-1], when[-1]) - 7200, np.searchsorted(when, at + 3600)
    want = {i: float(price[first[i]]) for i in range(n) if (at[i] // 3600 + 3) * 3600 <= mark and first[i] < n and when[first[i]] < at[i] + 7200}
    assert len(want) > 1_000 and {r["id"]: r["price_at_resolution"] for r in got} == want and len(got) == len(want)
    assert sum(s.numRowsUpdated for p in progress for s in p.stateOperators) < n / 50


def test_grades_of_odd_calls_and_prices(spark, tmp_path):
    """Ends of the wait, equal times, the same call twice, what is NULL; a window's prices come with the next batch."""
    m = lambda x: T0 + datetime.timedelta(minutes=x)
    nan = float("nan")
    calls = [
        (1, "A", "UP", 10.0, m(10)), (1, "A", "UP", 10.0, m(10)), (1, "A", "UP", 10.0, m(12)),  # the same call
        (2, "A", "DOWN", 10.0, m(20)), (3, "A", "UP", 10.0, m(239)), (None, "A", "UP", 10.0, m(30)), (4, "A", None, 10.0, m(30)), (5, "A", "UP", nan, m(31)),
        (6, None, "UP", 10.0, m(10)), (7, "A", "UP", 10.0, None), (8, "A", "UP", None, m(10)), (9, "A", "UP", 0.0, m(10)), (10, "B", "UP", 10.0, m(10)), (11, "C", "UP", 10.0, m(0)), (12, "C", "UP", 10.0, m(1)), (-13, "D", "UP", 4.0, m(-30)),
    ]
    prices = [
        ("A", m(70), 5, 11.0), ("A", m(70), 4, 12.0), ("A", m(69.99), 1, 99.0), ("A", m(75), None, None), ("A", m(80), 8, 13.0), ("A", m(80), None, 14.0), ("A", m(90), 1, nan), ("A", m(91), 1, 15.0), ("A", m(305), 1, 16.0),
        (None, m(75), 1, 17.0), ("A", None, 1, 18.0), ("C", m(120), 1, 19.0), ("D", m(30), 1, 5.0), ("B", m(130), 1, 20.0), ("Z", m(900), 1, 1.0),
    ]
    end = [(99, "Z", "UP", 1.0, m(900))]
    got, _ = graded(spark, str(tmp_path), [calls[:9], calls[9:], end], [prices[:4], prices[4:9], prices[9:]])
    made = sorted((-99 if r["id"] is None else r["id"], r["symbol"], r["price_at_resolution"]) for r in got)
    assert [r for r in made if r[2] == r[2]] == sorted([(1, "A", 12.0), (2, "A", 14.0), (3, "A", 16.0), (5, "A", 15.0), (12, "C", 19.0), (-13, "D", 5.0)])
    assert [(i, s) for i, s, x in made if x != x] == [(-99, "A"), (4, "A")]  # NaN is a price, as it was
    moves = {r["id"]: r["move_pct"] for r in got}
    assert moves[-13] == 25.0 and np.isnan(moves[5]) and next(r for r in got if r["id"] == 4)["predicted_direction"] is None


def test_calls_wait_in_few_elements_and_windows_go_one_by_one():
    """A timer takes the windows that are due and keeps the next one's rows, with the prices that the calls before want from it."""
    rng = np.random.default_rng(13)
    n, width = 30_000, 1_000_000
    rows = pd.DataFrame({"key": [f"k{i}" for i in rng.integers(0, 5, n)], "us": rng.integers(-2, 4000, n) * 1000, "side": rng.integers(0, 2, n), "seq": rng.permutation(n), "value": rng.uniform(1, 9, n)})
    rows["id"], rows["direction"] = [str(i) if s == 0 else None for i, s in enumerate(rows["side"])], None
    handle, processor = Handle(), ordered.FirstPrice(width)
    processor.init(handle)
    assert list(processor.handleInputRows((7,), iter(np.array_split(rows.sample(frac=1, random_state=1), 4)), None)) == []
    assert len(handle.written) == 3 and handle.timers == [999]
    got = {}
    for mark, due in ((999, -9), (1_000, 0), (2_999, 1_000), (4_000, 3_000), (5_999, 4_000)):
        frames = list(processor.handleExpiredTimer((7,), Mark(mark), None))
        assert max(map(len, frames), default=0) <= ordered.CHUNK
        fresh = {r.id: (r.key, r.value, r.first) for f in frames for r in f.itertuples()}
        assert not fresh.keys() & got.keys() and sum(map(len, frames)) == len(fresh)
        got |= fresh
        want = {}
        for key, own in rows.groupby("key"):
            p = own[own["side"] == 1].sort_values(["us", "seq"])
            c = own[(own["side"] == 0) & (own["us"] < due * 1000)]
            at = np.searchsorted(p["us"].to_numpy(), c["us"].to_numpy())
            want |= {r.id: (key, r.value, p["value"].iloc[k]) for r, k in zip(c.itertuples(), at) if k < len(p) and p["us"].iloc[k] < r.us + width}
        assert got == want and (len(got) > 100 or due <= 0)


def test_grading_goes_on_after_a_restart(spark, tmp_path):
    """Calls that wait when the query stops are graded by prices that land while it is down."""
    m = lambda x: T0 + datetime.timedelta(minutes=x)
    calls, prices = [(i, "A", "UP", 10.0, m(20 * i)) for i in range(60)], [("A", m(7 * i), i, 10.0 + i) for i in range(172)]
    parts = [([calls[:30]], [prices[:86]]), ([calls[30:]], [prices[86:]])]
    got = []
    for k, (c, p) in enumerate(parts):
        files(spark, str(tmp_path / f"c{k}"), c, CALLS)
        files(spark, str(tmp_path / f"p{k}"), p, PRICES)
        for x in "cp":
            os.makedirs(tmp_path / x, exist_ok=True)
            os.rename(tmp_path / f"{x}{k}" / "0.parquet", tmp_path / x / f"{k}.parquet")
        read = lambda name, schema: spark.readStream.schema(schema).parquet(str(tmp_path / name))
        got.append(drained(live.graded_stream(read("c", CALLS), read("p", PRICES)), str(tmp_path / "out"), str(tmp_path / "state")))
    want = {i: 10.0 + -(-(20 * i + 60) // 7) for i in range(60) if (20 * i // 60 + 3) * 60 <= 20 * 59 - 120}
    assert 0 < len(got[0]) < len(got[1]) == len(want) and {r["id"]: r["price_at_resolution"] for r in got[1]} == want
