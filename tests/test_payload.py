"""Payloads, opinions and clean rows at their edges: too few bars, nulls, ties, repeats, empty tables."""

import pytest
from pyspark.sql import functions as F

from marketloom.operators import payload as P

BAR = "symbol string, open_time timestamp, open double, high double, low double, close double, volume double"


def bars_of(spark, n, symbol="A", volume=0.0):
    rows = spark.range(n).select(F.lit(symbol).alias("symbol"), F.timestamp_seconds(F.col("id") * 300).alias("open_time"), (100.0 + F.col("id") % 7).alias("close"))
    return rows.select("symbol", "open_time", F.col("close").alias("open"), (F.col("close") + 1).alias("high"), (F.col("close") - 1).alias("low"), "close", F.lit(volume).alias("volume"))


def test_snapshots_need_sixty_bars(spark):
    at = F.lit("1970-01-02 00:04:59").cast("timestamp")
    both = P.snapshots(bars_of(spark, 59).unionByName(bars_of(spark, 60, "EUR/USD")), at).collect()
    assert [(r.symbol, r.asset_class, r.price, r.vwap_is_volume_weighted) for r in both] == [("EUR/USD", "forex", 103.0, False)]
    assert len(both[0].asDict()) == 18 and str(both[0].bucket_at) == "1970-01-02 00:00:00"
    assert P.snapshots(spark.createDataFrame([], BAR), at).count() == 0


def test_analysis_of_one_bar(spark):
    row = P.analyses(bars_of(spark, 1), F.lit("1970-01-01 01:00:00").cast("timestamp")).first()
    assert (row.prev_close, row.change_24h, row.bollinger, row.entry_window, row.volatility, row.rule) == (100.0, 0.0, None, None, None, "insufficient-data")
    assert P.overlay(bars_of(spark, 300), n=288).agg(F.count("sma"), F.min("open_time").cast("long")).first() == (288 - 37, 12 * 300)


def test_opinions(spark):
    rows = spark.createDataFrame([(1, 0.55, "UP"), (2, 0.45, "NEUTRAL"), (3, None, "DOWN"), (4, float("nan"), None), (5, 0.7, "DOWN"), (6, 0.7, None)], "id int, p double, call string")

    def said(meta, primary=None):
        return {r.id: (r.opinion.available, r.opinion.signal, r.opinion.confidence) for r in P.model_opinions(rows, F.col("p"), meta, primary).collect()}

    missing = (False, None, None)
    assert said({}) == {1: (True, "UP", 10), 2: (True, "DOWN", 10), 3: missing, 4: missing, 5: (True, "UP", 40), 6: (True, "UP", 40)}
    assert said({"mode": "meta_label", "threshold": 0.6}, F.col("call")) == {1: (True, "NEUTRAL", 55), 2: missing, 3: missing, 4: missing, 5: (True, "DOWN", 70), 6: missing}
    assert set(said({"mode": "meta_label"}).values()) == {missing}


@pytest.mark.parametrize("verdict, edge, top, want", [("WEAK", 0.01, 0.56, (True, True)), ("NOISE", 0.01, 0.53, (False, False)), ("WEAK", 0.0, None, (False, False)), ("WEAK", None, 0.6, (False, True))])
def test_what_is_validated(spark, verdict, edge, top, want):
    row = P.model_opinions(spark.createDataFrame([(0.5,)], "p double"), F.col("p"), {"verdict": verdict, "edge": edge, "accuracy": 0.52, "top_decile_acc": top}).first()
    assert (row.opinion.is_validated, row.opinion.confidence_is_meaningful) == want


def test_model_info_of_bad_bodies(spark):
    rows = P.model_info(spark.createDataFrame([(1, None), (2, "no json"), (3, '{"kind": "logistic", "meta": {"symbol": "X", "calibration": {"ece": 0.1}}}')], "id int, body string"))
    assert [(r.id, r.loaded, r.mode, r.verdict) for r in rows.orderBy("id").collect()] == [(1, False, None, None), (2, False, None, None), (3, True, "direction", "UNKNOWN")]


def test_complete_rows(spark):
    rows = spark.createDataFrame([(1.0, None, 1, 1), (float("inf"), None, 2, 1), (float("nan"), None, 3, 0), (2.0, None, 4, None), (None, None, 5, 1)], "a double, b double, c int, y int")
    clean, names = P.complete_rows(rows, "y", exclude=("c",))
    assert names == ["a"] and [(r.a, r.c, r.y) for r in clean.collect()] == [(1.0, 1, 1)]
    assert P.complete_rows(rows.limit(0), "y")[1] == []


def test_best_of_ties_and_toggles(spark):
    edges = spark.createDataFrame([("b", 0.1), ("a", 0.1), ("c", None), ("d", float("nan"))], "model string, edge double")
    assert P.best_model(edges).first()[0] == "a" and P.fold_counts(edges.withColumn("model", F.lit("m"))).first()[1:] == (4, 2)
    old, keys = (spark.createDataFrame([(i,) for i in ids], "id int") for ids in ([1, 1, 2], [2, 3, 3]))
    assert sorted(r.id for r in P.toggle(old, keys).collect()) == [1, 3]


def test_logs_are_appended(spark, tmp_path):
    for k in (1, 2):
        P.append_json(spark.createDataFrame([(k, "v")], "trial int, kind string"), f"{tmp_path}/log")
    assert sorted(r.trial for r in spark.read.json(f"{tmp_path}/log").collect()) == [1, 2]


def test_class_matched_coin(spark):
    got = spark.range(20_000).agg(F.avg(P.class_matched(F.col("id"), F.lit(0.3)))).first()[0]
    assert abs(got - 0.3) < 0.02


def test_series_of_pages_keep_microseconds(spark):
    pages = spark.createDataFrame([("A", '[{"timestamp": 3600000.4, "v": "1"}, {"timestamp": 3599999.002, "v": "3"}, {"timestamp": 3599999.001, "v": "5"}, {"timestamp": 1.0E3, "v": "7"}]')], "symbol string, body string")
    series = P.stats_series(pages, "v", "v")
    assert sorted((us, v) for us, v in series.select(F.unix_micros("event_time"), "v").collect()) == [(1_000_000, 7.0), (3_599_999_001, 5.0), (3_599_999_002, 3.0), (3_600_000_400, 1.0)]
    bar = spark.createDataFrame([("A", 3600)], "symbol string, s long").select("symbol", F.timestamp_seconds("s").alias("open_time"))
    assert P.with_context(bar, {"v": series}).first().v == 3.0


def test_derivative_context_of_crowded_points(spark, tmp_path):
    """Points of one millisecond, and one inside the millisecond that a bar begins with."""
    duckdb = pytest.importorskip("duckdb")
    from marketloom.plans import all_oracles, all_queries

    at = ["09:30:00", "09:59:59.999001", "09:59:59.999002", "10:00:00.0004", "10:30:00"]
    rows = [(i, f"2024-01-01 {t}", "view", v) for i, (t, v) in enumerate(zip(at, (5.0, 9.0, 3.0, 8.0, 4.0)))]
    made = spark.createDataFrame(rows, "event_id long, t string, event_type string, value double").withColumn("ts", F.col("t").cast("timestamp_ntz"))
    made.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = all_queries()["derivative_context"](spark, str(tmp_path)).orderBy("open_time").collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert [tuple(r) for r in got] == con.execute(all_oracles()["derivative_context"] + " ORDER BY 2").fetchall()
    assert [r.open_interest for r in got] == [None, 0.003]
