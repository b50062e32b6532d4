"""Caches by key, age and completeness; the hourly matrix's edges; two-level headers; kept parameters."""

import datetime
import math

import pytest
from pyspark.sql import functions as F

from marketloom.operators import search as H
from marketloom.operators.hourly import hourly_matrix
from marketloom.sources import bars as B
from marketloom.sources.cache import Cache, grid_keys, symbol_keys

T0 = datetime.datetime(2024, 1, 1)
BAR = "symbol string, open_time timestamp, open double, high double, low double, close double, volume double"
CONTEXT = "symbol string, open_time timestamp, funding double, open_interest double"


def grid(spark, n, symbols=("BTC/USDT", "EUR/USD")):
    return spark.createDataFrame([(s, T0 + datetime.timedelta(hours=i), 1.0, 2.0, 0.5, 1.0 + i % 3, 5.0) for s in symbols for i in range(n)], BAR)


def at(hours):
    return F.lit(T0 + datetime.timedelta(hours=hours))


def test_only_young_whole_contexts_of_the_same_grid_hit(spark, tmp_path):
    cache = Cache(spark, str(tmp_path / "c"), CONTEXT, whole=("funding", "open_interest"))
    bars, asked = grid(spark, 5), []

    def load(missed):
        asked.append(sorted(r["symbol"] for r in missed.collect()))
        whole = F.when(F.col("symbol") == "BTC/USDT", 2.0)
        return bars.join(missed, "symbol", "left_semi").select("symbol", "open_time", F.lit(1.0).alias("funding"), whole.alias("open_interest"))

    keys = grid_keys(bars)
    assert cache.through(keys, load, at(100)).count() == 10
    assert cache.through(keys, load, at(105)).count() == 10  # the context without open interest was not kept
    assert cache.through(grid_keys(grid(spark, 4)), load, at(105)).count() == 10
    assert cache.through(keys, load, at(106)).count() == 10  # six hours are too old
    assert asked == [["BTC/USDT", "EUR/USD"], ["EUR/USD"], ["BTC/USDT", "EUR/USD"], ["BTC/USDT", "EUR/USD"]]
    assert {(r["symbol"], r["hit"]) for r in cache.ages(keys, at(107)).collect()} == {("BTC/USDT", True), ("EUR/USD", False)}
    assert cache.read(keys, at(107)).count() == 5


def test_grid_keys(spark):
    rows = grid(spark, 3, ("A",)).unionByName(grid(spark, 1, (None,)))
    ms = int(T0.replace(tzinfo=datetime.timezone.utc).timestamp() * 1000)
    assert [tuple(r) for r in grid_keys(rows).collect()] == [("A", f"A_3_{ms}_{ms + 7_200_000}")]
    assert [r["cache_key"] for r in grid_keys(rows.filter("symbol = 'A'").withColumn("open_time", F.lit(None).cast("timestamp"))).collect()] == ["A_empty"]
    assert grid_keys(rows.limit(0)).count() == 0


def test_candles_are_cached_by_symbol(spark, tmp_path):
    bars = grid(spark, 4, ("A", "B"))
    cache = Cache(spark, str(tmp_path / "c"), BAR)
    got = cache.through(symbol_keys(bars), lambda missed: bars.join(missed, "symbol", "left_semi"), at(0))
    again = cache.through(symbol_keys(bars), lambda missed: pytest.fail("nothing is missed"), at(5))
    assert sorted(map(str, got.collect())) == sorted(map(str, again.select(*got.columns).collect())) and got.count() == 8


def test_hourly_matrix_edges(spark):
    bars = grid(spark, 40)
    rows = hourly_matrix(bars, {"active": spark.createDataFrame([], "symbol string, event_time timestamp, active double")}, spark.createDataFrame([(3.0, None)], "rate double, none double"))
    got = rows.collect()
    assert len(got) == 80 and "none" not in rows.columns and {(r["active"], r["rate"]) for r in got} == {(0.0, 3.0)}
    assert all((r["vwap_deviation"] is None) == (r["symbol"] == "BTC/USDT") for r in got)
    monday = next(r for r in got if r["open_time"] == T0 + datetime.timedelta(hours=6))
    assert math.isclose(monday["hour_sin"], 1.0) and math.isclose(monday["dow_cos"], 1.0)
    assert hourly_matrix(bars.limit(0)).count() == 0


def test_two_level_headers(spark):
    landed = spark.createDataFrame([("2024-01-01 05:00:00", 1.0, 2.0, 0.5, 1.5, 9.0), ("2024-01-01 06:00:00", 1.0, 2.0, 0.5, None, 9.0), (None, 1.0, 2.0, 0.5, float("nan"), 9.0)], "`Date|` string, `Open|E=X` double, `High|E=X` double, `Low|E=X` double, `Close|E=X` double, `Close|F=X` double")
    got = B.flat_headers(landed, F.lit("EUR/USD")).collect()
    assert [(r["symbol"], r["open_time"], r["close"], r["volume"]) for r in got] == [("EUR/USD", T0 + datetime.timedelta(hours=5), 1.5, 0.0)]
    with pytest.raises(ValueError, match="close, datetime"):
        B.flat_headers(landed.select("`Open|E=X`", "`High|E=X`", "`Low|E=X`"), F.lit("X"))


def test_kept_parameters(spark, tmp_path):
    path = str(tmp_path / "parameters")
    assert H.load_parameters(spark, path, "BTC/USDT") == {}
    H.save_parameters(spark.createDataFrame([("BTC/USDT", 5, 0.1), ("EUR/USD", 7, 0.2)], "pair string, depth int, rate double"), path)
    H.save_parameters(spark.createDataFrame([("BTC/USDT", 6, 0.3)], "pair string, depth int, rate double"), path)
    assert H.load_parameters(spark, path, "BTC/USDT") == {"depth": 6, "rate": 0.3} and H.load_parameters(spark, path, "EUR/USD") == {"depth": 7, "rate": 0.2}
    (tmp_path / "parameters" / "pair=odd").mkdir()
    (tmp_path / "parameters" / "pair=odd" / "part.txt").write_text("{not json")
    assert H.load_parameters(spark, path, "odd") == {} and H.load_parameters(spark, path, "unknown") == {}
