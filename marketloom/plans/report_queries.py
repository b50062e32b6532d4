"""Queries of reports over model scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketloom.operators import reports as P
from marketloom.plans.demo import SCORED, r6, rr, scored
from marketloom.plans.registry import query
from marketloom.plans.validation_queries import _METRICS, _VERDICT, BIN, _ppf_sql

#: Two models over the scored set: its probabilities and their complements (in SQL, ten more for a fold of the second).
_TWO = SCORED.replace("\ns AS", "\nsx AS") + """, s AS (SELECT row_idx, fold, y_true, y_prob, fwd_ret, y_pred FROM sx UNION ALL SELECT row_idx, fold + 10, y_true, 1 - y_prob, fwd_ret, CASE WHEN 1 - y_prob >= 0.5 THEN 1 ELSE 0 END FROM sx)"""
_MODEL = "CASE WHEN fold < 10 THEN 'plain' ELSE 'inverted' END AS model"


@query("model_report", f"""WITH {_TWO}, {_METRICS}, e AS (SELECT *, {_MODEL}, accuracy - greatest(up_rate, 1 - up_rate) AS edge FROM m),
v AS (SELECT model, count(*) AS n, count(*) FILTER (edge > 0) AS pos, avg(accuracy) AS acc, avg(edge) AS e, stddev_pop(edge) AS sd, avg(net_bps) AS net, avg(brier) AS br FROM e GROUP BY model),
rel AS (SELECT {_MODEL}, {BIN} AS bin, count(*) AS n, avg(y_prob) AS mp, avg(y_true::DOUBLE) AS ob FROM s GROUP BY ALL), cal AS (SELECT model, sum(n * abs(mp - ob)) / sum(n) AS ece, max(abs(mp - ob)) AS mce FROM rel GROUP BY model),
x AS (SELECT {_MODEL}, g - 0.0005 AS r FROM m0), mo AS (SELECT model, avg(r) AS mu, stddev_pop(r) AS dev, count(*) AS n_obs FROM x GROUP BY model),
sh AS (SELECT model, max(mu / dev) AS sr, max(n_obs) AS n_obs, avg(power((r - mu) / dev, 3)) AS skew, avg(power((r - mu) / dev, 4)) AS kurt FROM x JOIN mo USING (model) GROUP BY model),
t AS (SELECT count(*)::DOUBLE AS trials, stddev_samp(sr) AS spread FROM sh), b0 AS (SELECT spread * ((1 - 0.5772156649015329) * ({_ppf_sql("(1 - 1 / trials)")}) + 0.5772156649015329 * ({_ppf_sql("(1 - 1 / (trials * exp(1)))")})) AS sr0 FROM t)
SELECT model, n AS folds, pos AS folds_positive_edge, {rr('acc', 'accuracy')}, {rr('e', 'edge')}, {rr('sd', 'edge_std')}, {rr('net', 'net_bps')}, {rr('br', 'brier')}, {_VERDICT} AS verdict, {rr('ece', 'ece')}, {rr('mce', 'mce')},
{rr('sr', 'sharpe')}, {rr('(sr - sr0) / sqrt((1 - skew * sr + (kurt - 1) / 4 * sr * sr) / (n_obs - 1))', 'dsr_z')}, row_number() OVER (ORDER BY e DESC, model) = 1 AS best
FROM v JOIN cal USING (model) JOIN sh USING (model), b0""")  # fmt: skip
def model_report(spark, d):
    rows = scored(spark, d)
    other = rows.withColumn("y_prob", 1 - F.col("y_prob")).withColumn("y_pred", (F.col("y_prob") >= 0.5).cast("int"))
    both = rows.withColumn("model", F.lit("plain")).unionByName(other.withColumn("model", F.lit("inverted")))
    numbers = "accuracy edge edge_std net_bps brier ece mce sharpe dsr_z".split()
    return P.model_report(both).select("model", "folds", "folds_positive_edge", *(r6(c) for c in numbers), "verdict", "best")
