"""Equal times have a defined order; a query with a new checkpoint goes on behind what the loop's tables have; the normal distribution."""

import datetime
import math

from pyspark.sql import functions as F

from marketloom.functions import scalars as S
from marketloom.functions.scalars import norm_cdf
from marketloom.operators.joins import asof
from marketloom.sources.bars import ticks_to_bars
from marketloom.streaming import live

T0 = datetime.datetime(2024, 1, 1)


def test_normal_distribution(spark):
    points = [k / 16 for k in range(-640, 641)] + [7.0710678, 7.0710679, -1e6, 1e6, float("inf"), float("-inf"), float("nan"), None]
    rows = spark.createDataFrame([(x,) for x in points], "x double").select("x", norm_cdf(F.col("x")).alias("p")).collect()
    for x, p in rows:
        if x is None or x != x:
            assert p is None
        else:
            want = 0.5 * math.erfc(-x / math.sqrt(2))
            assert math.isclose(p, want, rel_tol=1e-7, abs_tol=1e-300) and abs(p - want) < 1e-14


def test_points_of_one_time(spark):
    bars = spark.createDataFrame([("A", T0 + datetime.timedelta(hours=h)) for h in (1, 30)], "symbol string, open_time timestamp")
    points = [("A", T0, v) for v in (2.0, 7.0, 5.0)] + [("A", T0 + datetime.timedelta(hours=1), v) for v in (3.0, 4.0, 1.0)]
    for rows in (points, points[::-1]):
        got = asof(bars, spark.createDataFrame(rows, "symbol string, event_time timestamp, v double").repartition(3), "v").orderBy("open_time").collect()
        assert [r["v"] for r in got] == [4.0, 4.0]


def test_ticks_of_one_time(spark):
    ticks = [(i, T0, "A", v) for i, v in ((3, 5.0), (1, 9.0), (2, 1.0))]
    for rows in (ticks, ticks[::-1]):
        df = spark.createDataFrame(rows, "id long, ts timestamp, event_type string, value double").repartition(3)
        by_id, by_price = ticks_to_bars(df, order="id").first(), ticks_to_bars(df).first()
        assert (by_id["open"], by_id["close"]) == (9.0, 5.0) and (by_price["open"], by_price["close"]) == (1.0, 9.0)


def test_new_checkpoint_goes_on_behind_old_tables(spark, tmp_path):
    def run(hours, checkpoint):
        tables = live.BatchLog(spark, str(tmp_path / "s"), live.SNAPSHOTS, ["symbol", "open_time"]), live.BatchLog(spark, str(tmp_path / "p"), live.PREDICTIONS, ["id"])
        loop = live.tick_loop(*tables, lambda now: now.select("symbol", F.lit("UP").alias("predicted_direction"), F.lit(50).alias("confidence")))
        for h in hours:
            bar = spark.createDataFrame([("A", T0 + datetime.timedelta(hours=h), *[100.0 + h] * 4, 1.0)], live.SNAPSHOTS)
            bar.coalesce(1).write.mode("append").parquet(str(tmp_path / f"in_{checkpoint}"))
            stream = spark.readStream.schema(live.SNAPSHOTS).parquet(str(tmp_path / f"in_{checkpoint}"))
            stream.writeStream.foreachBatch(loop).option("checkpointLocation", str(tmp_path / checkpoint)).trigger(availableNow=True).start().awaitTermination()
        return [sorted(map(tuple, t.read().collect())) for t in tables]

    first = run((0, 2), "one")
    assert [r[5] for r in first[1]] == ["CORRECT", "PENDING"]
    more = run((4,), "two")
    assert len(more[0]) == 3 and [r[5] for r in more[1]] == ["CORRECT", "CORRECT", "PENDING"]
    assert {p.name for p in (tmp_path / "s").glob("batch=*")} == {"batch=-1", "batch=0", "batch=1", "batch=2"}
    again = run((6,), "two")
    assert len(again[0]) == 4 and [r[5] for r in again[1]] == ["CORRECT"] * 3 + ["PENDING"]


def test_text_of_numbers(spark):
    def shown(f, *values):
        return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double").orderBy("i").select(f(F.col("x"))).collect()]

    nan = float("nan")
    assert shown(S.fixed, 1.005, 0.125, -0.125, 0.375, 411.645, 2.5) == ["1.00", "0.13", "-0.13", "0.38", "411.64", "2.50"]
    assert shown(S.format_percent, 1.5, -1.5, 0.0, 0.125, None, nan) == ["+1.50%", "\u22121.50%", "0.00%", "+0.13%", "—", "—"]
    assert shown(S.compact_volume, 0.0, 940_000.0, 1.2e6, 3.25e9, 12.0, None, nan) == ["n/a", "940.0K", "1.20M", "3.25B", "12.00", "—", "—"]
    assert shown(S.rsi_zone, 70.0, 60.0, 40.5, 40.0, 30.0, None) == ["overbought", "strong", "neutral", "weak", "oversold", "no data"]
    btc = lambda x: S.format_price(x, F.lit("BTC/USDT"))
    assert shown(btc, 1000.0, 1234.5, 1234.567, 1100.0, 12.345, 0.5, nan) == ["1,000", "1,234.5", "1,234.57", "1,100", "12.35" if f"{12.345:.2f}" == "12.35" else "12.34", "0.500000", "—"]


def test_text_of_times(spark):
    now = datetime.datetime(2024, 1, 5, 23)  # a Friday
    ages = [-5, 9, 10, 59, 60, 3599, 3600, 86_399, 86_400, 9 * 86_400]
    rows = spark.createDataFrame([(i, now - datetime.timedelta(seconds=a)) for i, a in enumerate(ages)] + [(99, None)], "i int, t timestamp_ntz").orderBy("i")
    at = F.lit(str(now)).cast("timestamp_ntz")
    got = [r[0] for r in rows.select(S.time_ago(F.col("t"), at)).collect()]
    assert got == ["now", "now", "10s ago", "59s ago", "1m ago", "59m ago", "1h ago", "23h ago", "1d ago", "9d ago", "—"]
    assert spark.range(1).select(S.reopen_label(S.next_forex_open(at)), S.reopen_label(F.lit(None).cast("timestamp_ntz"))).first()[:] == ("Sun 22:00 UTC", None)
