"""The model report on hand-made scores and on none; metrics that land as JSON."""

import math

import pytest
from pyspark.sql import functions as F

from marketloom.operators import reports as P
from marketloom.sources import bars as B

SCORES = "model string, fold int, row_idx long, y_true int, y_pred int, y_prob double, fwd_ret double"


def test_report_of_hand_made_scores(spark):
    # right is right in 3 of 4 rows of both folds, wrong says the contrary; every fold has as many ups as downs
    truth, calls, ret = [1, 1, 0, 0], [1, 1, 0, 1], [0.02, 0.01, -0.01, -0.03]
    rows = [(m, k, 4 * k + i, y, c if m == "right" else 1 - c, 0.8 if (c == 1) == (m == "right") else 0.2, r) for m in ("right", "wrong") for k in (0, 1) for i, (y, c, r) in enumerate(zip(truth, calls, ret))]
    frame = spark.createDataFrame(rows, SCORES)
    got = {r["model"]: r for r in P.model_report(frame, cost_bps=10.0).collect()}
    assert (got["right"]["folds"], got["right"]["folds_positive_edge"], got["right"]["accuracy"], got["right"]["edge"], got["right"]["edge_std"]) == (2, 2, 0.75, 0.25, 0.0)
    assert got["right"]["net_bps"] == pytest.approx((0.02 + 0.01 + 0.01 - 0.03) / 4 * 1e4 - 10) and got["right"]["verdict"] == "WEAK" and got["wrong"]["verdict"] == "NO_EDGE"
    assert got["right"]["best"] and not got["wrong"]["best"] and got["right"]["dsr"] > got["wrong"]["dsr"]
    assert got["right"]["ece"] == pytest.approx((6 * abs(0.8 - 2 / 3) + 2 * 0.2) / 8) and got["right"]["mce"] == pytest.approx(0.2)
    assert got["right"]["dsr"] == pytest.approx((1 + math.erf(got["right"]["dsr_z"] / math.sqrt(2))) / 2, abs=1e-6)
    tied = P.model_report(frame.filter("model = 'right'").unionByName(frame.filter("model = 'right'").withColumn("model", F.lit("also")))).collect()
    assert [r["model"] for r in tied if r["best"]] == ["also"]
    assert P.model_report(frame.limit(0)).count() == 0


def test_metrics_of_json(spark):
    bodies = [("A", '[{"t": 60, "v": 1}, {"t": 60, "v": 0.5}, {"t": 120, "v": null}, {"v": 3}, {"t": 180, "v": 2, "more": 1}]'), ("B", "[]"), ("C", None)]
    got = B.metric_of_json(spark.createDataFrame(bodies, "symbol string, body string")).select("symbol", F.unix_seconds("time"), "value").collect()
    assert sorted(map(tuple, got)) == [("A", 60, 0.5), ("A", 180, 2.0)]
