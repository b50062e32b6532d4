"""The snapshot and prediction store: keyed upserts, roll-ups, grading, retention, access rules. All set-based."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marketloom.functions.scalars import half_up

#: Symbols of each plan (NULL: all) and days of history.
FREE = ("BTC/USDT", "ETH/USDT", "SOL/USDT", "EUR/USD", "USD/JPY", "GBP/USD")
BASIC = (*FREE[:3], "XRP/USDT", "ADA/USDT", "DOGE/USDT", "AVAX/USDT", "LINK/USDT", *FREE[3:], "GBP/JPY", "AUD/USD", "USD/CAD", "USD/CHF", "EUR/JPY")
PLANS = {"free": (FREE, 1), "basic": (BASIC, 7), "pro": (None, 30)}
DEAD_BAND, DUE_MINUTES, MIN_LOGGED = 0.15, 60, 40


def _last_of_each(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of the greatest order of each key, by a maximum that is aggregated before the shuffle."""
    at = F.struct(F.col(order).isNotNull(), F.col(order))
    return rows.groupBy(*(F.col(k).alias(f"__{k}") for k in keys)).agg(F.max_by(F.struct(*rows.columns), at).alias("r")).select("r.*")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], policy: str = "replace", order: str | None = None) -> DataFrame:
    """old and new by key: policy replace keeps the new row, ignore the old one.

    Of repeated new rows the last write, that of the greatest order, wins; without order any one of them stays.
    A null order comes before all others; rows with a null in a key match no old row, and one stays for each such key.
    """
    fresh = new.dropDuplicates(keys) if order is None else _last_of_each(new, keys, order)
    if policy == "ignore":
        return old.unionByName(fresh.join(old.select(*keys), keys, "left_anti").select(*old.columns))
    return old.join(fresh.select(*keys), keys, "left_anti").select(*old.columns).unionByName(fresh.select(*old.columns))


def prune(rows: DataFrame, as_of: Column, keep_days: int = 30, time: str = "created_at") -> DataFrame:
    return rows.filter(F.col(time) >= as_of - F.expr(f"INTERVAL {keep_days} DAYS"))


def system_rows() -> Column:
    return F.col("user_id").isNull()


def visible(user_id: int | str | None) -> Column:
    """Row access: the system's rows and the user's own."""
    return F.col("user_id").isNull() | (F.col("user_id") == user_id) if user_id is not None else F.col("user_id").isNull()


def accuracy_rollup(predictions: DataFrame) -> DataFrame:
    """Counts and accuracy, in percent to one decimal, of the system's predictions by symbol and direction."""
    correct, wrong = F.count_if(F.col("actual_result") == "CORRECT"), F.count_if(F.col("actual_result") == "INCORRECT")
    graded = correct + wrong
    percent = F.round(F.lit(100).cast("decimal(20,0)") * correct / F.when(graded > 0, graded), 1)
    return predictions.filter(system_rows()).groupBy("symbol", "predicted_direction").agg(F.count("*").alias("total"), correct.alias("correct"), wrong.alias("incorrect"), F.count_if(F.col("actual_result") == "PENDING").alias("pending"), percent.alias("accuracy_pct"))


def recent_log(predictions: DataFrame, n: int = 50) -> DataFrame:
    return predictions.orderBy(F.desc("created_at"), F.desc("id")).limit(n)


def log_accuracy(log: DataFrame, least: int = 5) -> DataFrame:
    graded, correct = F.count_if(F.col("actual_result").isin("CORRECT", "INCORRECT")), F.count_if(F.col("actual_result") == "CORRECT")
    return log.agg(graded.alias("graded"), correct.alias("correct"), F.when(graded >= least, half_up(100.0 * correct / F.when(graded >= least, graded))).cast("long").alias("accuracy"))


def predictions_to_log(latest: DataFrame) -> DataFrame:
    return latest.filter(F.col("confidence") >= MIN_LOGGED)


def due(predictions: DataFrame, as_of: Column, limit: int | None = 200) -> DataFrame:
    """Pending predictions older than an hour, oldest first."""
    rows = predictions.filter((F.col("actual_result") == "PENDING") & (F.col("created_at") < as_of - F.expr(f"INTERVAL {DUE_MINUTES} MINUTES")))
    return rows if limit is None else rows.orderBy("created_at", "id").limit(limit)


def result_of(direction: Column, move: Column) -> Column:
    """CORRECT or INCORRECT for a move in percent: inside the dead band neutral was right."""
    right = F.when(F.abs(move) < DEAD_BAND, direction == "NEUTRAL").when(move > 0, direction == "UP").otherwise(direction == "DOWN")
    return F.when(right, "CORRECT").otherwise("INCORRECT")


def grade(pending: DataFrame, prices: DataFrame) -> DataFrame:
    """pending with move_pct and its result against prices(symbol, price): inside the dead band neutral was right."""
    joined = pending.join(prices, "symbol").filter(F.col("price").isNotNull() & (F.col("price_at_prediction") != 0))
    move = (F.col("price") - F.col("price_at_prediction")) / F.col("price_at_prediction") * 100
    return joined.withColumn("move_pct", move).withColumn("actual_result", result_of(F.col("predicted_direction"), move)).withColumn("price_at_resolution", F.col("price")).drop("price")


def missing_symbols(registry: DataFrame, present: DataFrame) -> DataFrame:
    return registry.join(present.select("symbol").distinct(), "symbol", "left_anti")


def users_with_profiles(users: DataFrame, profiles: DataFrame) -> DataFrame:
    """Every user with the plan of their profile, free where there is none."""
    return users.join(profiles, "id", "left").withColumn("plan", F.coalesce("plan", F.lit("free")))


def staleness(rows: DataFrame, as_of: Column, time: str = "open_time") -> DataFrame:
    """Minutes since each symbol's last row."""
    gap = F.unix_seconds(as_of.cast("timestamp")) - F.unix_seconds(F.max(time).cast("timestamp"))
    return rows.groupBy("symbol").agg(half_up(gap / 60).cast("long").alias("stale_minutes"))


def plan_gate(rows: DataFrame, plan: str, as_of: Column | None = None, time: str = "open_time") -> DataFrame:
    """Rows of the symbols, and inside the history, that a plan allows."""
    symbols, days = PLANS.get(plan, PLANS["free"])
    if symbols is not None:
        rows = rows.filter(F.col("symbol").isin(*symbols))
    return rows if as_of is None else rows.filter(F.col(time) >= as_of - F.expr(f"INTERVAL {days} DAYS"))


def keep_plan(old: DataFrame, new: DataFrame, service: bool) -> DataFrame:
    """New profiles; unless the service writes them, each keeps the plan it had."""
    if service:
        return new
    return new.join(old.select("id", F.col("plan").alias("__plan")), "id", "left").withColumn("plan", F.coalesce("__plan", F.lit("free"))).drop("__plan")


def profiles_of_signups(users: DataFrame, profiles: DataFrame) -> DataFrame:
    """Profiles of users(id, email, meta JSON) that have none: the name of the metadata, else of the address."""
    name = F.coalesce(F.get_json_object("meta", "$.user_name"), F.get_json_object("meta", "$.full_name"), F.split_part("email", F.lit("@"), F.lit(1)))
    return users.join(profiles.select("id"), "id", "left_anti").select("id", name.alias("username"), F.lit("free").alias("plan"))


def chunk(rows: DataFrame, order: str, size: int, by: str | None = None) -> DataFrame:
    """rows with group: their position by order, in groups of size. Of a small dimension table."""
    w = (Window.partitionBy(by) if by else Window.partitionBy(F.lit(0))).orderBy(order)
    return rows.withColumn("group", F.floor((F.row_number().over(w) - 1) / size).cast("int"))
