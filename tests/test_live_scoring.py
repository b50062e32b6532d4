"""The table of models: refits when due, from tables alone; scores by regime; steps of the loop that fail apart."""

import datetime
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.operators.features import FEATURE_NAMES
from marketloom.streaming import live
from marketloom.streaming import scoring as C

T0 = datetime.datetime(2024, 1, 1)


def rows_of(spark, n, symbols=("A",), seed=0, flat=()):
    """Features of n bars a symbol whose label follows ret_1 with its sign by regime; symbols of `flat` have one class."""
    rng, out = np.random.default_rng(seed), []
    for s in symbols:
        for i in range(n):
            x = rng.normal(size=25)
            x[FEATURE_NAMES.index("adx_norm")] = 0.4 if i % 2 else 0.1
            up = x[FEATURE_NAMES.index("ret_1")] * (1 if i % 2 else -1) > 0
            out.append((s, T0 + datetime.timedelta(hours=i), 100.0, *map(float, x), True, 1 if s in flat else int(up)))
    return spark.createDataFrame(out, f"symbol string, open_time timestamp, close double, {', '.join(f'{c} double' for c in FEATURE_NAMES)}, valid boolean, y_true int")


def test_refit_when_due_and_score(spark, tmp_path):
    models = live.BatchLog(spark, str(tmp_path / "m"), C.MODELS, ["symbol"])
    rows = rows_of(spark, 400, ("A", "B", "C"), flat=("C",))
    found, meta = C.refit(models.read(), rows)
    models.write(found, 0)
    assert {r["symbol"]: set(r["models"]) for r in models.read().collect()} == {s: {"trending", "ranging"} for s in "AB"}
    for r in meta.collect():
        assert r["n_train_rows"] == 200 and r["accuracy"] > 0.9 and set(json.loads(r["importances"])) == set(FEATURE_NAMES)
        assert max(json.loads(r["importances"]).items(), key=lambda p: p[1])[0] == "ret_1"
    again = live.BatchLog(spark, str(tmp_path / "m"), C.MODELS, ["symbol"])  # as after a restart
    assert {r[0] for r in C.due_symbols(again.read(), rows).collect()} == {"C"}
    assert C.due_symbols(again.read(), rows_of(spark, 449, ("A",))).isEmpty()
    assert {r[0] for r in C.due_symbols(again.read(), rows_of(spark, 450, ("A",))).collect()} == {"A"}
    later, _ = C.refit(again.read(), rows_of(spark, 450, ("A", "B"), seed=1, flat=("B",)))
    again.write(later, 1)  # B gets no model and keeps its own
    assert {r["symbol"]: r["trained_at"] for r in again.read().collect()} == {"A": T0 + datetime.timedelta(hours=449), "B": T0 + datetime.timedelta(hours=399)}

    got = {r["symbol"]: r for r in C.score_latest(rows, again.read()).collect()}
    assert set(got) == {"A", "B"}
    table = {r["symbol"]: r["models"] for r in again.read().collect()}
    for s, r in got.items():
        last = rows.filter(F.col("symbol") == s).orderBy(F.desc("open_time")).first()
        m = table[s]["trending"]
        z = m["intercept"] + sum((last[n] - a) / b * c for n, a, b, c in zip(FEATURE_NAMES, m["mean"], m["scale"], m["coef"]))
        assert abs(r["p_up"] - 1 / (1 + np.exp(-z))) < 1e-12 and r["regime"] == "trending" and r["direction"] == int(z >= 0)
        assert r["emitted"] == (abs(r["p_up"] - 0.5) * 2 >= 0.6)


def test_scores_of_what_is_missing(spark):
    rows = rows_of(spark, 120)
    none = spark.createDataFrame([], C.MODELS)
    assert C.score_latest(rows, none).isEmpty() and C.refit(none, rows.limit(0))[0].isEmpty()
    found, _ = C.refit(none, rows)
    assert C.score_latest(rows.withColumn("valid", F.col("open_time") < str(T0 + datetime.timedelta(hours=119))), found).isEmpty()
    assert C.score_latest(rows, found.withColumn("models", F.map_filter("models", lambda k, _: k == "ranging"))).isEmpty()
    assert C.refit(none, rows.withColumn("y_true", F.lit(None).cast("int")))[0].isEmpty()


def test_logistic_is_at_its_optimum():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 4)) * [1, 10, 0.1, 1] + 5
    x[:, 3] = 2.0
    y = (x[:, 0] + rng.normal(size=300) > 5).astype(float)
    b, mean, scale, w = C.fit_logistic(x, y, 2.0)
    a = (x - mean) / scale
    p = 1 / (1 + np.exp(-(b + a @ w)))
    assert np.abs(a.T @ (y - p) - 2.0 * w).max() < 1e-7 and abs((y - p).sum()) < 1e-7 and scale[3] == 1


@pytest.mark.parametrize("failing", ["calls", "grades"])
def test_steps_fail_apart(spark, tmp_path, monkeypatch, failing):
    tables = live.BatchLog(spark, str(tmp_path / "s"), live.SNAPSHOTS, ["symbol", "open_time"]), live.BatchLog(spark, str(tmp_path / "p"), live.PREDICTIONS, ["id"])
    broken = []

    def predict(now):
        if "calls" in broken:
            raise RuntimeError("no model")
        return now.select("symbol", F.lit("UP").alias("predicted_direction"), F.lit(50).alias("confidence"))

    def grade(*args, real=live.T.grade):
        return real(*args) if "grades" not in broken else real(*args).withColumn("actual_result", F.raise_error(F.lit("no prices")).cast("string"))

    monkeypatch.setattr(live.T, "grade", grade)
    log = str(tmp_path / "steps")
    loop = live.tick_loop(*tables, predict, log=log)
    bar = lambda h: spark.createDataFrame([("A", T0 + datetime.timedelta(hours=h), *[100.0 + h] * 4, 1.0)], live.SNAPSHOTS)
    loop(bar(0), 0)
    broken.append(failing)
    loop(bar(2), 1)
    state = sorted(r["actual_result"] for r in tables[1].read().collect())
    assert state == (["CORRECT"] if failing == "calls" else ["PENDING", "PENDING"])
    broken.clear()
    loop(bar(4), 2)
    assert sorted(r["actual_result"] for r in tables[1].read().collect()) == (["CORRECT", "PENDING"] if failing == "calls" else ["CORRECT", "CORRECT", "PENDING"])
    lines = {(r["batch"], r["step"]): r for r in spark.read.schema(live.STEPS).json(log).collect()}
    assert len(lines) == 6 and [k for k, r in lines.items() if not r["ok"]] == [(1, failing)] and lines[1, failing]["error"]
    broken.append(failing)
    with pytest.raises(Exception):
        live.tick_loop(*tables, predict)(bar(6), 3)
