"""Reports over the out-of-sample scores of fitted models: what their folds, calibration and corrected Sharpe ratios say together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.operators import validation as V


def model_report(scores: DataFrame, cost_bps: float = 5.0, by: str = "model", key: str = "row_idx") -> DataFrame:
    """One row for each model of scores(by, fold, key, y_true, y_pred, y_prob, fwd_ret), as fold_scores() gives them.

    folds and those of positive edge; means over the folds (edge_std their population deviation); the verdict of
    these; ece and mce of all scores; sharpe of the net returns, dsr_z and dsr deflated for as many trials as there are models;
    best, the model of the greatest edge (of equal ones the first by name). An empty table gives no rows. Rows of
    a model and fold are ranked together, nothing else is.
    """
    metrics = V.class_metrics(scores, by=(by, "fold"), cost_bps=cost_bps, key=key)
    folds = metrics.groupBy(by).agg(
        F.count("*").alias("folds"), F.count_if(F.col("edge") > 0).alias("folds_positive_edge"), F.avg("accuracy").alias("accuracy"), F.avg("edge").alias("edge"),
        F.stddev_pop("edge").alias("edge_std"), F.avg("net_bps").alias("net_bps"), F.avg("brier").alias("brier"), F.avg("auc").alias("auc"),
    )
    folds = folds.withColumn("verdict", V.verdict(F.col("edge"), F.col("edge_std"), F.col("folds_positive_edge"), F.col("net_bps"), F.col("folds")))
    net = F.when(F.col("y_pred") == 1, 1.0).otherwise(-1.0) * F.col("fwd_ret") - cost_bps / 10000
    rows = scores.select(by, net.alias("__net"))
    skew, kurt = V.moments(F.col("__net"))
    ratios = rows.groupBy(by).agg(V.sharpe(F.col("__net")).alias("sharpe"), F.count("__net").alias("__n"), skew.alias("__skew"), kurt.alias("__kurt"))
    # one row, of as many trials as there are models, and the best model's name
    trials = ratios.agg(F.count("*").alias("__trials"), F.coalesce(F.stddev_samp("sharpe"), F.lit(0.0)).alias("__sd"))
    first = folds.agg(F.min_by(by, F.struct(-F.col("edge"), F.col(by))).alias("__best"))
    out = folds.join(V.calibration_errors(scores, (by,)), by).join(ratios, by).join(F.broadcast(trials)).join(F.broadcast(first))
    z = V.sharpe_z(F.col("sharpe"), F.col("__n"), V.expected_max_sharpe(F.col("__trials"), F.col("__sd")), F.col("__skew"), F.col("__kurt"))
    out = out.withColumn("dsr_z", z).withColumn("dsr", V.norm_cdf(F.col("dsr_z"))).withColumn("best", F.col(by) == F.col("__best"))
    return out.drop("__n", "__skew", "__kurt", "__trials", "__sd", "__best")
