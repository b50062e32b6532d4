"""Ranks, neighbours and the search against plain versions; entry windows; exports; pooled folds."""

import datetime
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.operators import features as X
from marketloom.operators import models as M
from marketloom.operators import ranks as K
from marketloom.operators import search as S
from marketloom.operators import signals as G
from marketloom.operators import validation as V
from marketloom.plans.demo import bars


def test_ranks_equal_sorting(spark):
    rows = [(None if i % 7 == 0 else f"g{i % 3}", float(i * 37 % 11), i) for i in range(500)]
    got = K.ranked(spark.createDataFrame(rows, "g string, x double, id long").repartition(5), ["g"], ["x", "id"]).collect()
    for g in (None, "g0", "g1", "g2"):
        own = sorted((r["x"], r["id"], r["rank"]) for r in got if r["g"] == g)
        assert [r[2] for r in own] == list(range(1, len(own) + 1)) and len(own) == sum(r[0] == g for r in rows)
    assert K.ranked(spark.createDataFrame([], "g string, x double"), ["g"], ["x"]).count() == 0


def test_no_window_has_a_whole_fold(spark):
    rows = spark.createDataFrame([(i % 2, i % 2, i / 100, i) for i in range(100)], "fold int, y_true int, y_prob double, row_idx long")
    plan = V.auc(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan


def harmonic(n):
    return sum(1 / i for i in range(1, n))


def plain_information(x, y, k=3):
    terms = []
    for i in range(len(x)):
        own = np.sort(np.abs(x[y == y[i]] - x[i]))
        if len(own) < 2:
            continue
        near = min(k, len(own) - 1)
        radius, apart = own[near], np.abs(x - x[i])
        m = int((apart < radius).sum()) if radius > 0 else int((apart == 0).sum())
        terms.append(harmonic(near) - harmonic(len(own)) - harmonic(m))
    return max(0.0, harmonic(len(terms)) + float(np.mean(terms)))


def test_mutual_information_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    n = 2000
    y = rng.integers(0, 2, n)
    columns = {"near": rng.normal(size=n) + y, "none": rng.normal(size=n), "tied": np.round(rng.normal(size=n) + y, 1), "skewed": rng.exponential(size=n) * (1 + y), "flat": np.zeros(n)}
    rows = [(f, int(l), float(v)) for f, x in columns.items() for l, v in zip(y, x)] + [("near", 1, None), ("near", 0, float("nan")), ("one", 0, 1.0), ("one", 1, 2.0)]
    got = {r["feature"]: r["mi"] for r in K.mutual_information(spark.createDataFrame(rows, "feature string, label int, value double").repartition(7)).collect()}
    assert set(got) == set(columns)  # classes of one point have no neighbour
    for name, x in columns.items():
        assert abs(got[name] - plain_information(x, y)) < 1e-9, name
    assert got["near"] > got["none"]


def test_digamma(spark):
    got = [r[0] for r in spark.range(1, 60).select(K.digamma(F.col("id"))).collect()]
    np.testing.assert_allclose(got, [harmonic(n) - 0.5772156649015329 for n in range(1, 60)], rtol=0, atol=1e-12)


SPACE = {"x": S.Uniform(-5, 5), "rate": S.Uniform(1e-3, 1, log=True), "d": S.Choice((1, 2, 3, 4))}


def surface(p):
    return (p["x"] - 1.3) ** 2 + (math.log10(p["rate"]) + 1) ** 2 + (p["d"] != 3)


def test_search_is_seeded_and_better_than_chance(spark):
    found, chance = [], []
    for seed in range(8):
        trials = S.minimise(surface, SPACE, 50, seed)
        assert trials == S.minimise(surface, SPACE, 50, seed) and len(trials) == 50
        assert all(-5 <= p["x"] <= 5 and 1e-3 <= p["rate"] <= 1 and p["d"] in (1, 2, 3, 4) for p, _ in trials)
        found.append(min(loss for _, loss in trials))
        rng = np.random.default_rng(seed + 100)
        chance.append(min(surface({n: a.draw(rng) for n, a in SPACE.items()}) for _ in range(50)))
    assert np.median(found) < np.median(chance)
    log = S.trial_log(spark, trials, SPACE).collect()
    assert log[0]["best"] and sum(r["best"] for r in log) == 1 and log[0]["loss"] == min(loss for _, loss in trials)


def test_search_survives_losses_that_are_no_numbers():
    assert len(S.minimise(lambda p: float("nan") if p["x"] < 0 else p["x"], {"x": S.Uniform(-1, 1)}, 30, 1, together=4)) == 30


def test_entry_windows_end_at_as_of(spark):
    t0 = datetime.datetime(2024, 1, 1)
    rows = [("A", t0 + datetime.timedelta(minutes=30 * i), 100.0 + i % 5, 10.0, None if i < 14 else 50.0 - i % 9) for i in range(60)]
    rows += [("A", t0 + datetime.timedelta(minutes=30 * i), 90.0, 1000.0, 1.0) for i in range(60, 90)]  # far better, but later
    rows += [("B", t0 + datetime.timedelta(minutes=30 * i), 1.0, 1.0, 20.0) for i in range(18)]  # one bar too few
    frame = spark.createDataFrame(rows, "symbol string, open_time timestamp, close double, volume double, rsi14 double")
    as_of = F.lit(t0 + datetime.timedelta(minutes=30 * 59)).cast("timestamp")
    got = G.entry_windows(frame, as_of).collect()
    assert [r["symbol"] for r in got] == ["A"] and t0 + datetime.timedelta(minutes=30 * 35) <= got[0]["open_time"] <= t0 + datetime.timedelta(minutes=30 * 59)


@pytest.fixture(scope="module")
def labelled(spark, small_dir):
    return M.settled(M.dataset(bars(spark, small_dir)))


def test_pooled_folds_learn_nothing_from_the_test_on(spark, labelled):
    """A feature that knows the label only from the middle on helps a model of all siblings, not one of those before."""
    got = M.evaluate_pooled(labelled, n_splits=2, min_train=150)
    sizes = {r["symbol"]: r["count"] for r in labelled.groupBy("symbol").count().collect()}
    rows = {(r["symbol"], r["fold"]): r for r in got.collect()}
    assert set(rows) == {(s, k) for s in sizes for k in (0, 1)}
    every = {(r["symbol"], r["fold"]): r for r in M.evaluate_pooled(labelled, n_splits=2, min_train=150, siblings="all").collect()}
    placed = K.ranked(labelled, ["symbol"], ["open_time", "idx"], "own").select("symbol", "open_time", (F.col("own") - 1).alias("own")).collect()
    for (symbol, k), r in rows.items():
        _, a, b, lo, hi = V.walk_forward(sizes[symbol], n_splits=2, min_train=150)[k]
        upto = max(p["open_time"] for p in placed if p["symbol"] == symbol and a <= p["own"] < b)
        starts = min(p["open_time"] for p in placed if p["symbol"] == symbol and p["own"] >= lo)
        assert upto < starts and r["n_train"] == b - a + sum(p["symbol"] != symbol and p["open_time"] <= upto for p in placed)
        assert every[symbol, k]["n_train"] == b - a + sum(n for s, n in sizes.items() if s != symbol) and r["n"] == hi - lo


def test_baselines_and_coverage(labelled):
    got = M.evaluate(labelled, n_splits=2, min_train=800).collect()
    by = {(r["model"], r["fold"]): r for r in got}
    assert {m for m, _ in by} >= {"logreg", "always_up", "majority", "random"}
    for k in (0, 1):
        assert by["always_up", k]["accuracy"] == pytest.approx(by["always_up", k]["up_rate"]) and by["logreg", k]["coverage"] == 1.0
        assert all(0 < by[m, k]["coverage"] < 1 for m in ("heuristic",) if (m, k) in by)


def test_exports_have_the_moments_of_their_rows(spark, labelled, tmp_path):
    train = M._balanced(labelled)
    model, moments = M._logistic(train), M.train_moments(train)
    artifact = M.load_logistic(M.export_logistic(model, str(tmp_path / "m.json"), "WEAK", moments=moments))
    rows = labelled.limit(200)
    both = M.score(model, rows).select("y_prob", M.predict_proba(artifact).alias("p")).collect()
    np.testing.assert_allclose([r["p"] for r in both], [r["y_prob"] for r in both], atol=1e-9)
    assert artifact["mean"] != [0.0] * 25 and min(artifact["scale"]) > 0
    meta = M.export_meta_model(labelled, str(tmp_path / "meta.json"), {"symbol": "all"}, 0.6)
    read = json.load(open(tmp_path / "meta.json"))
    assert read == meta and read["meta"]["mode"] == "meta_label" and read["meta"]["meta_label_threshold"] == 0.6 and read["n_features"] == len(X.FEATURE_NAMES)


def test_boosted_trees_stop_early(labelled):
    train = M._balanced(labelled)
    model = M._boosted(train)
    assert 1 <= model.getNumTrees < M.ROUNDS and len(M._boosted(train.limit(60), {"maxIter": 3}).trees) == 3


def test_unseen_calibration_and_combinations(labelled):
    got = {(r["method"], r["part"]): r for r in M.calibrated_report(labelled).collect()}
    assert set(got) == {(m, p) for m in ("none", "platt", "isotonic") for p in ("calib", "test")}
    assert got["isotonic", "calib"]["ece"] <= got["none", "calib"]["ece"]
    with pytest.raises(ValueError):
        M.calibrated_report(labelled.limit(200))
    assert M.evaluate_combinatorial(labelled, n_groups=4).count() == 6


def test_the_search_fits_folds_of_few_partitions_and_sums_their_weights_once(spark, labelled, monkeypatch):
    """Rows in many partitions: a step of a fit is a task or two all the same, and a trial's loss is that of plain fits of its folds."""
    seen, fit = [], M._fit

    def watched(train, kind, c, params):
        seen.append((train.rdd.getNumPartitions(), params.get("total"), train.agg(F.sum("w")).first()[0]))
        return fit(train, kind, c, params)

    monkeypatch.setattr(M, "_fit", watched)
    log = M.tune(labelled.repartition(12, "row_idx"), evaluations=3, n_splits=2, min_train=300, together=1).collect()
    assert len(log) == 3 and len(seen) == 6
    assert all(parts == 1 and total == pytest.approx(summed) for parts, total, summed in seen)
    right = []
    for _, a, b, lo, hi in V.walk_forward(labelled.count(), n_splits=2, min_train=300):
        model = M._logistic(M._balanced(M.between(labelled, a, b)), log[0]["c"], log[0]["elastic"], M.SEARCH_STEPS)
        right.append(M.score(model, M.between(labelled, lo, hi)).agg(F.avg((F.col("y_pred") == F.col("y_true")).cast("double"))).first()[0])
    assert log[0]["loss"] == pytest.approx(-np.mean(right), abs=5e-3)
