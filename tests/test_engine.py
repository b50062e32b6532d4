"""Validation, store, streaming and every query against its SQL."""

import datetime
import json
import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketloom import plans
from marketloom.operators import models as M
from marketloom.operators import recursive as R
from marketloom.operators import store as T
from marketloom.operators import validation as V
from marketloom.sources import bars as B
from marketloom.streaming import live

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cells(frame: pd.DataFrame) -> list:
    def one(v):
        if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
            return None
        return int(v) if isinstance(v, (float, np.floating)) and v == int(v) and abs(v) < 1e15 else v

    return sorted(tuple(map(str, map(one, row))) for row in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(plans.all_oracles()))
def test_query_equals_sql(spark, tiny_dir, name):
    with duckdb.connect() as con:
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tiny_dir}/{t}.parquet'")
        want = con.execute(plans.all_oracles()[name]).df()
    got = plans.all_queries()[name](spark, tiny_dir).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert cells(got) == cells(want)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 5
    assert set(e.oracle_sql()) <= set(e.queries())


def test_walk_forward():
    folds = V.walk_forward(1000, n_splits=5, min_train=500)
    assert all(lo - end == 18 for _, _, end, lo, _ in folds) and folds[0][:3] == (0, 0, 500)
    assert all(b - a == 500 for _, a, b, _, _ in V.walk_forward(1000, expanding=False))
    with pytest.raises(ValueError):
        V.walk_forward(505)


def test_combinatorial_purge():
    rows = V.combinatorial(600)
    assert len({f for f, *_ in rows}) == 15
    for fold in range(15):
        test = {i for f, role, a, b in rows if f == fold and role == "test" for i in range(a, b)}
        train = {i for f, role, a, b in rows if f == fold and role == "train" for i in range(a, b)}
        assert len(test) == 200 and not {i + d for i in train for d in range(-18, 19)} & test


def test_deflated_sharpe_falls_with_trials(spark):
    from marketloom.functions.scalars import bet_size, norm_cdf

    rows = spark.createDataFrame([(n,) for n in (2, 10, 100)], "n long")
    got = [r["d"] for r in rows.select(V.deflated_sharpe(F.lit(0.1), F.lit(500), V.expected_max_sharpe(F.col("n"), F.lit(0.05)), F.lit(0.0), F.lit(3.0)).alias("d")).collect()]
    assert got == sorted(got, reverse=True) and all(0 < x < 1 for x in got)
    s = spark.createDataFrame([(0.5,), (0.9,), (0.1,)], "p double").select(bet_size(F.col("p")).alias("s"), norm_cdf(F.col("p")).alias("c")).collect()
    assert s[0]["s"] == 0 and s[1]["s"] > 0.5 and math.isclose(s[1]["s"], -s[2]["s"])


def test_harness_finds_planted_signal_and_none_in_noise(spark):
    def edges(bars):
        m = M.evaluate(M.dataset(bars), n_splits=3, min_train=500).filter("model = 'logreg'")
        return [r["auc"] for r in m.collect()]

    assert np.mean(edges(B.planted_reversion(spark, 2500, strength=0.6))) > 0.53
    assert abs(np.mean(edges(B.random_walk(spark, 2500, seed=5))) - 0.5) < 0.08


def test_model_export_round_trip(spark, tmp_path):
    class Fitted:
        coefficients, intercept = [0.1] * 25, -0.2

    path = str(tmp_path / "model.json")
    M.export_logistic(Fitted, path, "WEAK")
    artifact = M.load_logistic(json.load(open(path)))
    row = spark.createDataFrame([tuple(float(i) / 10 for i in range(25))], ", ".join(f"{n} double" for n in artifact["feature_names"]))
    z = -0.2 + sum(0.1 * i / 10 for i in range(25))
    got = row.select(M.predict_proba(artifact).alias("p"), M.opinion(M.predict_proba(artifact)).alias("o")).first()
    assert math.isclose(got["p"], 1 / (1 + math.exp(-z)), rel_tol=1e-12) and got["o"]["signal"] == "UP"
    with pytest.raises(ValueError):
        M.export_logistic(Fitted, path, "NO_EDGE")
    with pytest.raises(ValueError):
        M.load_logistic({"kind": "logistic", "feature_names": []})


def test_upsert_policies(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 3), ("c", 4), ("c", 4)], "k string, v int")
    assert sorted(map(tuple, T.upsert(old, new, ["k"]).collect())) == [("a", 1), ("b", 3), ("c", 4)]
    assert sorted(map(tuple, T.upsert(old, new, ["k"], "ignore").collect())) == [("a", 1), ("b", 2), ("c", 4)]


def test_upsert_keeps_the_last_write(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 7, 2), ("b", 8, 3), ("b", 9, None), ("c", 5, None), (None, 6, 1), (None, 4, 2)], "k string, v int, at int")
    last = lambda policy: sorted(map(tuple, T.upsert(old, new, ["k"], policy, "at").collect()), key=str)
    assert last("replace") == [("a", 1), ("b", 8), ("c", 5), (None, 4)]
    assert last("ignore") == [("a", 1), ("b", 2), ("c", 5), (None, 4)]
    assert T.upsert(old, new.limit(0), ["k"], order="at").count() == 2


@pytest.mark.parametrize("direction, price, result", [("UP", 101.0, "CORRECT"), ("DOWN", 101.0, "INCORRECT"), ("NEUTRAL", 100.1, "CORRECT"), ("UP", 100.1, "INCORRECT"), ("DOWN", 99.0, "CORRECT")])
def test_grading(spark, direction, price, result):
    pending = spark.createDataFrame([("A", direction, 100.0, "PENDING")], "symbol string, predicted_direction string, price_at_prediction double, actual_result string")
    assert T.grade(pending, spark.createDataFrame([("A", price)], "symbol string, price double")).first()["actual_result"] == result


def test_stateful_indicators_equal_batch(spark, tiny_dir, tmp_path):
    events = spark.read.parquet(f"{tiny_dir}/events.parquet").orderBy("ts")
    parts = [p.reset_index(drop=True) for p in np.array_split(events.toPandas(), 4)]
    for i, p in enumerate(parts):
        spark.createDataFrame(p, live.TICKS).coalesce(1).write.parquet(str(tmp_path / f"t{i}"))
        for f in os.listdir(tmp_path / f"t{i}"):
            if f.endswith(".parquet"):
                os.makedirs(tmp_path / "in", exist_ok=True)
                os.rename(tmp_path / f"t{i}" / f, tmp_path / "in" / f"{i}.parquet")
                os.utime(tmp_path / "in" / f"{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    stream = live.stateful_indicators(live.tick_stream(spark, str(tmp_path / "in")))
    stream.writeStream.format("memory").queryName("ind").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = spark.table("ind").toPandas()
    for symbol, own in got.groupby("symbol"):
        own = own.sort_values("time")
        c = own["close"].to_numpy()
        np.testing.assert_allclose(own["ema12"], R.ema(c, 12), rtol=1e-9)
        np.testing.assert_allclose(own["rsi14"].to_numpy(float)[14:], R.rsi(c)[14:], rtol=1e-7)
        np.testing.assert_allclose(own["ewma_vol"], R.ewma_vol(c), rtol=1e-7, atol=1e-12)


def test_tick_loop_upserts_grades_and_repeats_safely(spark, tmp_path):
    snapshots, predictions = live.BatchLog(spark, str(tmp_path / "s"), live.SNAPSHOTS, ["symbol", "open_time"]), live.BatchLog(spark, str(tmp_path / "p"), live.PREDICTIONS, ["id"])
    loop = live.tick_loop(snapshots, predictions, lambda now: now.select("symbol", F.lit("UP").alias("predicted_direction"), F.lit(50).alias("confidence")))
    t0 = datetime.datetime(2024, 1, 1)
    bar = lambda h, c: spark.createDataFrame([("A", t0 + datetime.timedelta(hours=h), c, c, c, c, 1.0)], live.SNAPSHOTS)
    loop(bar(0, 100.0), 0)
    loop(bar(0, 100.0), 0)
    assert predictions.read().count() == 1 and snapshots.read().count() == 1
    loop(bar(2, 110.0), 1)
    got = {r["id"]: r["actual_result"] for r in predictions.read().collect()}
    assert sorted(got.values()) == ["CORRECT", "PENDING"] and snapshots.read().count() == 2
    again = live.BatchLog(spark, str(tmp_path / "s"), live.SNAPSHOTS, ["symbol", "open_time"]), live.BatchLog(spark, str(tmp_path / "p"), live.PREDICTIONS, ["id"])
    loop = live.tick_loop(*again, lambda now: now.select("symbol", F.lit("UP").alias("predicted_direction"), F.lit(50).alias("confidence")))
    before = sorted(again[1].read().collect())
    assert {r["id"]: r["actual_result"] for r in before} == got
    loop(bar(2, 110.0), 1)
    assert sorted(again[1].read().collect()) == before and again[0].read().count() == 2
    loop(bar(0, 90.0), 2)
    assert {r["close"] for r in again[0].read().collect()} == {90.0, 110.0} and again[1].read().count() == 2


def test_retraining(spark):
    t0 = datetime.datetime(2024, 1, 1)
    run, models = live.retrain_every(3, lambda rows: rows.count(), keep=4)
    for i in range(8):
        run(spark.createDataFrame([("A", t0 + datetime.timedelta(hours=i), 1.0, 1.0, 1.0, 1.0, 1.0)], live.SNAPSHOTS), i)
    assert models == [3, 4]


def test_trials_skip_malformed_lines(spark, tmp_path):
    path = tmp_path / "trials.jsonl"
    path.write_text('{"symbol": "A", "kind": "logreg", "sharpe": 0.1, "n_obs": 5, "ts": "x"}\nnot json\n')
    assert [r["sharpe"] for r in B.read_trials(spark, str(path)).collect()] == [0.1]


def test_profiles_and_plans(spark):
    users = spark.createDataFrame([(1, "ann@x.org", '{"user_name": "annie"}'), (2, "bob@x.org", "{}"), (3, "c@x.org", "{}")], "id long, email string, meta string")
    old = spark.createDataFrame([(3, "c", "pro")], "id long, username string, plan string")
    assert sorted((r["id"], r["username"]) for r in T.profiles_of_signups(users, old).collect()) == [(1, "annie"), (2, "bob")]
    asked = spark.createDataFrame([(3, "free"), (4, "pro")], "id long, plan string")
    assert {r["id"]: r["plan"] for r in T.keep_plan(old, asked, service=False).collect()} == {3: "pro", 4: "free"}
    assert T.keep_plan(old, asked, service=True) is asked
