"""The supplied tables as the engine's: events are ticks, orders a prediction log, labels a scored set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.sources.bars import ticks_to_bars, valid_bars, with_index


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plain_bars(spark: SparkSession, sf_dir: str, width: str = "1 hour") -> DataFrame:
    """Bars of events; the symbol signup has no volume, as spot forex has none."""
    rows = valid_bars(ticks_to_bars(table(spark, sf_dir, "events"), width))
    return rows.withColumn("volume", F.when(F.col("symbol") == "signup", 0.0).otherwise(F.col("volume")))


def bars(spark: SparkSession, sf_dir: str, width: str = "1 hour") -> DataFrame:
    """plain_bars() with idx."""
    return with_index(plain_bars(spark, sf_dir, width))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as an irregular series, one point a time, the greatest of those at one time: (symbol, event_time, funding)."""
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), F.col("ts").alias("event_time"), (F.col("value") / 1000).alias("funding"))
    return rows.groupBy("symbol", "event_time").agg(F.max("funding").alias("funding"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        k.alias("id"), F.when(F.col("o_custkey") % 4 != 0, F.col("o_custkey")).alias("user_id"), F.col("o_orderpriority").alias("symbol"),
        F.when(k % 3 == 0, "UP").when(k % 3 == 1, "DOWN").otherwise("NEUTRAL").alias("predicted_direction"), (30 + k % 60).cast("int").alias("confidence"),
        F.col("o_totalprice").alias("price_at_prediction"), F.when(F.col("o_orderstatus") == "F", "CORRECT").when(F.col("o_orderstatus") == "O", "INCORRECT").otherwise("PENDING").alias("actual_result"), F.col("o_orderdate").alias("created_at"),
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    rows = table(spark, sf_dir, "labels").select(
        i.alias("row_idx"), (i % 5).cast("int").alias("fold"), F.col("quality").alias("y_true"), ((i * 37) % 101 / 100).alias("y_prob"), (((i * 53) % 201 - 100) / 10000).alias("fwd_ret"), ((i % 3) - 1).cast("int").alias("primary")
    )
    return rows.withColumn("y_pred", (F.col("y_prob") >= 0.5).cast("int"))


def r6(c: Column | str, name: str | None = None, digits: int = 6) -> Column:
    """Rounded, so that the order of a sum doesn't show; without the sign of zero."""
    out = F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)
    return out.alias(name or c)


#: The same tables in DuckDB.
BARS = """t AS (SELECT event_type AS symbol, time_bucket(INTERVAL '1 hour', ts) AS open_time, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low,
  arg_max(value, ts) AS close, CASE WHEN event_type = 'signup' THEN 0.0::DOUBLE ELSE count(*)::DOUBLE END AS volume FROM events WHERE value > 0 GROUP BY event_type, time_bucket(INTERVAL '1 hour', ts)),
b AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY open_time) - 1 AS idx FROM t)"""
POINTS = "pts AS (SELECT event_type AS symbol, ts AS event_time, max(value / 1000) AS funding FROM events GROUP BY ALL)"
PREDICTIONS = """p AS (SELECT o_orderkey AS id, CASE WHEN o_custkey % 4 <> 0 THEN o_custkey END AS user_id, o_orderpriority AS symbol,
  CASE o_orderkey % 3 WHEN 0 THEN 'UP' WHEN 1 THEN 'DOWN' ELSE 'NEUTRAL' END AS predicted_direction, CAST(30 + o_orderkey % 60 AS INTEGER) AS confidence, o_totalprice AS price_at_prediction,
  CASE o_orderstatus WHEN 'F' THEN 'CORRECT' WHEN 'O' THEN 'INCORRECT' ELSE 'PENDING' END AS actual_result, o_orderdate AS created_at FROM orders)"""
SCORED = """s0 AS (SELECT doc_id AS row_idx, CAST(doc_id % 5 AS INTEGER) AS fold, quality AS y_true, ((doc_id * 37) % 101)::DOUBLE / 100 AS y_prob,
  ((doc_id * 53) % 201 - 100)::DOUBLE / 10000 AS fwd_ret, CAST(doc_id % 3 - 1 AS INTEGER) AS "primary" FROM labels),
s AS (SELECT *, CASE WHEN y_prob >= 0.5 THEN 1 ELSE 0 END AS y_pred FROM s0)"""
W = "PARTITION BY symbol ORDER BY open_time"


def frame(w: int) -> str:
    return f"({W} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"


def full(expr: str, x: str, w: int) -> str:
    """An aggregate over the last w rows in SQL, NULL until all have x."""
    return f"CASE WHEN count({x}) OVER {frame(w)} = {w} THEN {expr} OVER {frame(w)} END"


def rr(expr: str, name: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0.0::DOUBLE AS {name}"
