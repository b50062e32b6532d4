"""Queries of the snapshot and prediction store, scalar functions and landed sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketloom.functions import scalars as S
from marketloom.functions import windows as W
from marketloom.operators import store as T
from marketloom.plans.demo import BARS, PREDICTIONS, bars, predictions, r6, rr, table
from marketloom.plans.registry import query
from marketloom.sources import bars as B

AS_OF_SQL = "TIMESTAMP '1996-06-01 00:00:00'"


def as_of():
    return F.lit("1996-06-01 00:00:00").cast("timestamp_ntz")
PCT = "round(CAST(100 AS DECIMAL(20,0)) * count(*) FILTER (actual_result = 'CORRECT') / nullif(count(*) FILTER (actual_result <> 'PENDING'), 0), 1)"


@query(
    "accuracy_rollup",
    f"""WITH {PREDICTIONS} SELECT symbol, predicted_direction, count(*) AS total, count(*) FILTER (actual_result = 'CORRECT') AS correct, count(*) FILTER (actual_result = 'INCORRECT') AS incorrect, count(*) FILTER (actual_result = 'PENDING') AS pending,
    CAST({PCT} AS DOUBLE) AS accuracy_pct FROM p WHERE user_id IS NULL GROUP BY ALL""",
)
def accuracy_rollup(spark, d):
    return T.accuracy_rollup(predictions(spark, d)).withColumn("accuracy_pct", F.col("accuracy_pct").cast("double"))


@query(
    "prediction_log_top50",
    f"WITH {PREDICTIONS}, l AS (SELECT * FROM p ORDER BY created_at DESC, id DESC LIMIT 50) SELECT count(*) FILTER (actual_result <> 'PENDING') AS graded, count(*) FILTER (actual_result = 'CORRECT') AS correct, CASE WHEN count(*) FILTER (actual_result <> 'PENDING') >= 5 THEN CAST(floor(100.0::DOUBLE * count(*) FILTER (actual_result = 'CORRECT') / count(*) FILTER (actual_result <> 'PENDING') + 0.5) AS BIGINT) END AS accuracy FROM l",
)
def prediction_log_top50(spark, d):
    return T.log_accuracy(T.recent_log(predictions(spark, d)))


@query("recent_log", f"WITH {PREDICTIONS} SELECT id, symbol, predicted_direction, confidence, actual_result FROM p ORDER BY created_at DESC, id DESC LIMIT 50")
def recent_log(spark, d):
    return T.recent_log(predictions(spark, d)).select("id", "symbol", "predicted_direction", "confidence", "actual_result")


_PRICE = "px AS (SELECT symbol, avg(price_at_prediction) AS price FROM p GROUP BY 1)"
_DUE = f"du AS (SELECT * FROM p WHERE actual_result = 'PENDING' AND created_at < {AS_OF_SQL} - INTERVAL 60 MINUTE)"


@query(
    "grade_predictions",
    f"""WITH {PREDICTIONS}, {_PRICE}, {_DUE}, g AS (SELECT du.*, px.price, (px.price - price_at_prediction) / price_at_prediction * 100 AS mv FROM du JOIN px USING (symbol) WHERE price_at_prediction <> 0)
    SELECT id, symbol, {rr('mv', 'move_pct')}, CASE WHEN CASE WHEN abs(mv) < 0.15 THEN predicted_direction = 'NEUTRAL' WHEN mv > 0 THEN predicted_direction = 'UP' ELSE predicted_direction = 'DOWN' END THEN 'CORRECT' ELSE 'INCORRECT' END AS actual_result FROM g""",
)
def grade_predictions(spark, d):
    p = predictions(spark, d)
    prices = p.groupBy("symbol").agg(F.avg("price_at_prediction").alias("price"))
    return T.grade(T.due(p, as_of(), limit=None), prices).select("id", "symbol", r6("move_pct"), "actual_result")


@query("due_predictions", f"WITH {PREDICTIONS}, {_DUE} SELECT id, symbol, confidence FROM du ORDER BY created_at, id LIMIT 200")
def due_predictions(spark, d):
    return T.due(predictions(spark, d), as_of()).select("id", "symbol", "confidence")


@query("log_gate", f"WITH {PREDICTIONS} SELECT symbol, count(*) AS n, min(confidence) AS lowest FROM p WHERE confidence >= 40 GROUP BY symbol")
def log_gate(spark, d):
    return T.predictions_to_log(predictions(spark, d)).groupBy("symbol").agg(F.count("*").alias("n"), F.min("confidence").alias("lowest"))


@query("latest_snapshot", f"WITH {BARS} SELECT symbol, open_time, close, volume FROM b QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY open_time DESC) = 1")
def latest_snapshot(spark, d):
    from marketloom.operators.signals import latest

    return latest(bars(spark, d)).select("symbol", "open_time", "close", "volume")


#: All bars as the old table, and all bars half a day later as the new rows: most keys are in both.
_OLD_NEW = f"WITH {BARS}, o AS (SELECT symbol, open_time, close FROM b), n AS (SELECT symbol, open_time + INTERVAL 12 HOUR AS open_time, -close AS close FROM b)"


def _old_new(spark, d):
    rows = bars(spark, d)
    return rows.select("symbol", "open_time", "close"), rows.select("symbol", (F.col("open_time") + F.expr("INTERVAL 12 HOURS")).alias("open_time"), (-F.col("close")).alias("close"))


@query("upsert_snapshots", f"{_OLD_NEW} SELECT * FROM n UNION ALL SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.symbol = o.symbol AND n.open_time = o.open_time)")
def upsert_snapshots(spark, d):
    return T.upsert(*_old_new(spark, d), ["symbol", "open_time"])


@query("insert_or_ignore", f"{_OLD_NEW} SELECT * FROM o UNION ALL SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE n.symbol = o.symbol AND n.open_time = o.open_time)")
def insert_or_ignore(spark, d):
    return T.upsert(*_old_new(spark, d), ["symbol", "open_time"], policy="ignore")


@query("prune_old", f"WITH {PREDICTIONS} SELECT count(*) AS kept, (SELECT count(*) FROM p) - count(*) AS deleted FROM p WHERE created_at >= {AS_OF_SQL} - INTERVAL 30 DAY")
def prune_old(spark, d):
    p = predictions(spark, d)
    kept = F.count_if(F.col("created_at") >= as_of() - F.expr("INTERVAL 30 DAYS"))
    return p.agg(kept.alias("kept"), (F.count("*") - kept).alias("deleted"))


@query("missing_symbols", "SELECT p_partkey AS symbol FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)")
def missing_symbols(spark, d):
    registry = table(spark, d, "part").select(F.col("p_partkey").alias("symbol"))
    return T.missing_symbols(registry, table(spark, d, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("symbol")))


_PROFILES = "pr AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'pro' ELSE 'basic' END AS plan FROM customer WHERE c_custkey % 3 <> 0)"


def _profiles(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").filter("c_custkey % 3 <> 0").select(k.alias("id"), F.when(k % 2 == 0, "pro").otherwise("basic").alias("plan"))


@query("users_profiles_left", f"WITH {_PROFILES} SELECT c_custkey AS id, c_name AS name, coalesce(plan, 'free') AS plan FROM customer LEFT JOIN pr ON pr.id = c_custkey")
def users_profiles_left(spark, d):
    return T.users_with_profiles(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), _profiles(spark, d))


@query("plan_counts", f"WITH {_PROFILES} SELECT plan, count(*) AS n FROM pr GROUP BY plan")
def plan_counts(spark, d):
    return _profiles(spark, d).groupBy("plan").agg(F.count("*").alias("n"))


@query("outer_merge", f"WITH {BARS}, x AS (SELECT open_time, close AS a FROM b WHERE symbol = 'click'), y AS (SELECT open_time, close AS c FROM b WHERE symbol = 'view') SELECT open_time, a, c FROM x FULL JOIN y USING (open_time)")
def outer_merge(spark, d):
    rows = bars(spark, d)
    return rows.filter("symbol = 'click'").select("open_time", F.col("close").alias("a")).join(rows.filter("symbol = 'view'").select("open_time", F.col("close").alias("c")), "open_time", "outer")


@query("macro_broadcast", f"WITH {BARS}, m AS (SELECT avg(c_acctbal) AS macro FROM customer) SELECT symbol, open_time, {rr('close / macro', 'ratio')} FROM b, m")
def macro_broadcast(spark, d):
    """One row of macro values beside every bar."""
    macro = table(spark, d, "customer").agg(F.avg("c_acctbal").alias("macro"))
    return bars(spark, d).join(F.broadcast(macro)).select("symbol", "open_time", r6(F.col("close") / F.col("macro"), "ratio"))


@query("watchlist_semi", f"WITH {PREDICTIONS} SELECT id, symbol FROM p WHERE symbol IN (SELECT o_orderpriority FROM orders WHERE o_totalprice > 400000)")
def watchlist_semi(spark, d):
    wanted = table(spark, d, "orders").filter("o_totalprice > 400000").select(F.col("o_orderpriority").alias("symbol")).distinct()
    return predictions(spark, d).join(wanted, "symbol", "left_semi").select("id", "symbol")


@query("row_access", f"WITH {PREDICTIONS} SELECT count(*) AS visible FROM p WHERE user_id IS NULL OR user_id = 7")
def row_access(spark, d):
    return predictions(spark, d).filter(T.visible(7)).agg(F.count("*").alias("visible"))


@query("staleness", f"WITH {BARS} SELECT symbol, CAST(floor(epoch(TIMESTAMP '2024-02-01' - max(open_time)) / 60 + 0.5) AS BIGINT) AS stale_minutes FROM b GROUP BY symbol")
def staleness(spark, d):
    return T.staleness(bars(spark, d), F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"))


@query("distinct_symbols", "SELECT DISTINCT event_type AS symbol FROM events")
def distinct_symbols(spark, d):
    return table(spark, d, "events").select(F.col("event_type").alias("symbol")).distinct()


@query("symbols_except", "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 0 EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def symbols_except(spark, d):
    left = table(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_nationkey").alias("k"))
    return left.subtract(table(spark, d, "supplier").filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("k")))


_REG = "reg AS (SELECT n_nationkey AS position, CASE WHEN n_nationkey < 10 THEN 'crypto' ELSE 'forex' END AS kind FROM nation)"


@query("registry_slice", f"WITH {_REG}, g AS (SELECT position, CAST(floor((row_number() OVER (ORDER BY position) - 1) / 5) AS INTEGER) AS \"group\" FROM reg WHERE kind = 'forex') SELECT * FROM g WHERE \"group\" = 1")
def registry_slice(spark, d):
    reg = table(spark, d, "nation").select(F.col("n_nationkey").alias("position"), F.when(F.col("n_nationkey") < 10, "crypto").otherwise("forex").alias("kind"))
    return T.chunk(reg.filter("kind = 'forex'").select("position"), "position", 5).filter("group = 1")


@query("tick_group", "SELECT event_id, CASE WHEN (hour(ts) * 60 + minute(ts)) % 10 = 0 THEN CAST((hour(ts) * 60 + minute(ts)) // 10 % 2 AS INTEGER) END AS \"group\" FROM events")
def tick_group(spark, d):
    return table(spark, d, "events").select("event_id", S.tick_group(F.col("ts"), 2).cast("int").alias("group"))


@query("plan_gate", f"WITH v AS (SELECT o_orderkey AS id, ['BTC/USDT', 'XRP/USDT', 'EUR/USD', 'NZD/USD'][o_orderkey % 4 + 1] AS symbol, o_orderdate AS open_time FROM orders) SELECT id, symbol FROM v WHERE symbol IN ('BTC/USDT', 'XRP/USDT', 'EUR/USD') AND open_time >= {AS_OF_SQL} - INTERVAL 7 DAY")
def plan_gate(spark, d):
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(k.alias("id"), F.when(k % 4 == 0, "BTC/USDT").when(k % 4 == 1, "XRP/USDT").when(k % 4 == 2, "EUR/USD").otherwise("NZD/USD").alias("symbol"), F.col("o_orderdate").alias("open_time"))
    return T.plan_gate(rows, "basic", as_of()).select("id", "symbol")


_FX = "['BTC/USDT', 'EUR/USD', 'GBP/JPY', 'SOL/USDT', 'eur/zar'][o_orderkey % 5 + 1]"


@query("forex_pairs", f"""WITH v AS (SELECT o_orderkey AS id, {_FX} AS symbol, o_totalprice AS price FROM orders)
    SELECT id, symbol, upper(symbol) IN ('EUR/USD', 'GBP/JPY', 'EUR/ZAR') AS forex, CASE WHEN upper(symbol) IN ('EUR/USD', 'GBP/JPY', 'EUR/ZAR') THEN replace(symbol, '/', '') || '=X' ELSE replace(symbol, '/', '') END AS data_symbol, CASE WHEN upper(symbol) IN ('EUR/USD', 'GBP/JPY', 'EUR/ZAR') THEN 'forex' ELSE 'crypto' END AS asset_class FROM v""")
def forex_pairs(spark, d):
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(k.alias("id"), F.when(k % 5 == 0, "BTC/USDT").when(k % 5 == 1, "EUR/USD").when(k % 5 == 2, "GBP/JPY").when(k % 5 == 3, "SOL/USDT").otherwise("eur/zar").alias("symbol"))
    return rows.select("id", "symbol", S.is_forex(F.col("symbol")).alias("forex"), S.data_symbol(F.col("symbol")).alias("data_symbol"), S.asset_class(F.col("symbol")).alias("asset_class"))


@query("labels_of_values", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 100 >= 70 THEN 'overbought' WHEN o_orderkey % 100 >= 60 THEN 'strong' WHEN o_orderkey % 100 > 40 THEN 'neutral' WHEN o_orderkey % 100 > 30 THEN 'weak' ELSE 'oversold' END AS zone, CAST(floor((30 + o_orderkey % 60) / 10.0 + 0.5) AS INTEGER) AS blocks FROM orders")
def labels_of_values(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(k.alias("id"), S.rsi_zone(k % 100).alias("zone"), S.confidence_blocks(30 + k % 60).alias("blocks"))


@query("json_path", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_path(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("signup_profiles", "SELECT c_custkey AS id, coalesce(CASE WHEN c_custkey % 2 = 0 THEN 'user' || c_custkey END, split_part(c_name || '@x.org', '@', 1)) AS username, 'free' AS plan FROM customer WHERE c_custkey % 3 = 0")
def signup_profiles(spark, d):
    k = F.col("c_custkey")
    users = table(spark, d, "customer").select(k.alias("id"), F.concat("c_name", F.lit("@x.org")).alias("email"), F.when(k % 2 == 0, F.to_json(F.struct(F.concat(F.lit("user"), k).alias("user_name")))).otherwise("{}").alias("meta"))
    return T.profiles_of_signups(users, _profiles(spark, d))


@query("plan_guard", "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'free' WHEN c_custkey % 2 = 0 THEN 'pro' ELSE 'basic' END AS plan FROM customer")
def plan_guard(spark, d):
    """Clients that ask for pro keep the plan they had."""
    new = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("pro").alias("plan"))
    return T.keep_plan(_profiles(spark, d), new, service=False)


@query("latest_bars", f"WITH {BARS} SELECT open_time, close FROM b WHERE symbol = 'view' ORDER BY open_time DESC LIMIT 100")
def latest_bars(spark, d):
    return B.latest_bars(bars(spark, d), "view", 100).select("open_time", "close")


@query("book_imbalance", "SELECT l_orderkey AS id, CASE WHEN sum(l_quantity) > 0 THEN (coalesce(sum(l_quantity) FILTER (l_linenumber % 2 = 1), 0) - coalesce(sum(l_quantity) FILTER (l_linenumber % 2 = 0), 0)) / sum(l_quantity) ELSE 0 END AS imbalance FROM lineitem GROUP BY 1".replace("CASE", "round(CASE").replace("END AS", "END, 6) + 0.0::DOUBLE AS"))
def book_imbalance(spark, d):
    level = F.array(F.col("l_extendedprice").cast("double"), F.col("l_quantity").cast("double"))
    sides = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(F.when(F.col("l_linenumber") % 2 == 1, level)).alias("bids"), F.collect_list(F.when(F.col("l_linenumber") % 2 == 0, level)).alias("asks"))
    return sides.select("id", r6(B.book_imbalance(F.col("bids"), F.col("asks")), "imbalance"))


@query("klines_landed", f"WITH {BARS} SELECT symbol, open_time, close, volume FROM b")
def klines_landed(spark, d):
    """Bars written as positional JSON klines, twice over, and read back."""
    rows = bars(spark, d)
    ms = F.unix_millis(F.col("open_time").cast("timestamp"))
    line = F.array(ms.cast("string"), *(F.col(c).cast("string") for c in ("open", "high", "low", "close", "volume")))
    landed = rows.groupBy("symbol").agg(F.collect_list(line).alias("k")).select("symbol", F.to_json(F.concat("k", "k")).alias("body"))
    return B.klines_to_bars(landed).select("symbol", F.col("open_time").cast("timestamp_ntz").alias("open_time"), "close", "volume")


@query("series_landed", f"WITH {BARS} SELECT symbol, open_time, close, 0.0::DOUBLE AS volume FROM b WHERE symbol <> 'error'")
def series_landed(spark, d):
    """Bars written as one JSON object of series, with a failed symbol and no volume, and read back."""
    value = F.struct(F.date_format("open_time", "yyyy-MM-dd HH:mm:ss").alias("datetime"), *(F.col(c).cast("string").alias(c) for c in ("open", "high", "low", "close")))
    series = bars(spark, d).groupBy("symbol").agg(F.collect_list(value).alias("values"))
    status = F.when(F.col("symbol") == "error", "error").otherwise("ok")
    landed = series.select(F.to_json(F.create_map("symbol", F.struct(status.alias("status"), "values"))).alias("body"))
    return B.series_to_bars(landed)[0].select("symbol", F.col("open_time").cast("timestamp_ntz").alias("open_time"), "close", "volume")


@query("metric_landed", "SELECT event_type AS symbol, date_trunc('day', ts) AS time, count(*)::DOUBLE AS value FROM events GROUP BY ALL")
def metric_landed(spark, d):
    """Daily counts written as JSON points with epoch seconds, a body for each symbol and month, and read back."""
    day = F.date_trunc("day", F.col("ts").cast("timestamp"))
    daily = table(spark, d, "events").groupBy(F.col("event_type").alias("symbol"), day.alias("day")).agg(F.count("*").cast("double").alias("v"))
    point = F.struct(F.unix_seconds("day").alias("t"), "v")
    landed = daily.groupBy("symbol", F.date_trunc("month", "day").alias("month")).agg(F.to_json(F.collect_list(point)).alias("body"))
    return B.metric_of_json(landed).select("symbol", F.col("time").cast("timestamp_ntz").alias("time"), "value")


_LISTED = ", ".join(f"({i}, '{s}', '{k}', '{c}')" for i, (s, k, c) in enumerate([(f"{c}/USDT", "crypto", f"{c}USDT") for c, _ in B.CRYPTO] + [(s, "forex", s) for s in B.FOREX]))
_N_LISTED = len(B.CRYPTO) + len(B.FOREX)


@query("instrument_registry", f"""WITH r(position, symbol, kind, source_symbol) AS (VALUES {_LISTED}), o AS (SELECT o_custkey % {_N_LISTED + 1} AS position, count(*) AS n, max(o_orderdate) AS last FROM orders GROUP BY 1)
SELECT r.*, coalesce(n, 0) AS n, last FROM r LEFT JOIN o USING (position)""")
def instrument_registry(spark, d):
    """The registry with the number of orders of each instrument and their last date; orders of a position that isn't listed count nowhere."""
    dealt = table(spark, d, "orders").groupBy((F.col("o_custkey") % (_N_LISTED + 1)).cast("int").alias("position")).agg(F.count("*").alias("n"), F.max("o_orderdate").alias("last"))
    return B.instruments(spark).join(dealt, "position", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def _fixed(x: str, digits: int) -> str:
    """fixed() of scalars: exact binary value, halves away from zero."""
    return f"printf('%.{digits}f', {x} + CASE WHEN abs({x}) * {2 ** (digits + 1)} % 2 = 1 THEN sign({x}) * {10.0 ** -(digits + 1)!r} ELSE 0 END)"


_PRICE = f"""CASE WHEN o_orderkey % 2 = 0 THEN {_fixed('p', 5)} WHEN p >= 1000 THEN regexp_replace(format('{{:,.2f}}', p), '\\.?0+$', '') WHEN p >= 1 THEN {_fixed('p', 2)} ELSE {_fixed('p', 6)} END"""
_VOLUME = f"""CASE WHEN v = 0 THEN 'n/a' WHEN v >= 1e9 THEN {_fixed('(v / 1e9)', 2)} || 'B' WHEN v >= 1e6 THEN {_fixed('(v / 1e6)', 2)} || 'M' WHEN v >= 1e3 THEN {_fixed('(v / 1e3)', 1)} || 'K' ELSE {_fixed('v', 2)} END"""
_PERCENT = f"""CASE WHEN c > 0 THEN '+' WHEN c < 0 THEN '\u2212' ELSE '' END || {_fixed('abs(c)', 2)} || '%'"""


@query("price_format", f"""WITH v AS (SELECT o_orderkey, o_totalprice::DOUBLE AS p, o_totalprice::DOUBLE * (o_orderkey % 5) * 10 AS v, (o_orderkey % 4001 - 2000)::DOUBLE / 800 AS c FROM orders)
SELECT o_orderkey, {_PRICE} AS shown, {_VOLUME} AS volume, {_PERCENT} AS percent FROM v""")
def price_format(spark, d):
    """Prices, volumes and changes as text; the changes hold exact halves of the last place."""
    k, p = F.col("o_orderkey"), F.col("o_totalprice").cast("double")
    symbol = F.when(k % 2 == 0, "EUR/USD").otherwise("BTC/USDT")
    return table(spark, d, "orders").select(k, S.format_price(p, symbol).alias("shown"), S.compact_volume(p * (k % 5) * 10).alias("volume"), S.format_percent((k % 4001 - 2000) / 800).alias("percent"))


_AGE = "floor(epoch_us(TIMESTAMP '2024-02-01' - ts) / 1e6)::BIGINT"


@query("time_labels", f"""WITH a AS (SELECT event_id, ts, event_type, {_AGE} AS s, NOT (dayofweek(ts) = 6 OR (dayofweek(ts) = 0 AND hour(ts) < 22) OR (dayofweek(ts) = 5 AND hour(ts) >= 22)) AS is_open FROM events)
SELECT event_id, CASE WHEN s < 10 THEN 'now' WHEN s < 60 THEN s || 's ago' WHEN s < 3600 THEN s // 60 || 'm ago' WHEN s < 86400 THEN s // 3600 || 'h ago' ELSE s // 86400 || 'd ago' END AS age, CASE WHEN NOT is_open THEN 'Sun 22:00 UTC' END AS reopens,
strftime(ts, '%a %H:%M') || ' UTC' AS at, CASE WHEN event_type = 'click' THEN '▲' WHEN event_type = 'view' THEN '▼' ELSE '■' END AS glyph FROM a""")
def time_labels(spark, d):
    """Age, reopening of the forex market and direction of every event as a dashboard shows them."""
    t, kind = F.col("ts"), F.col("event_type")
    signal = F.when(kind == "click", "UP").when(kind == "view", "DOWN").otherwise("NEUTRAL")
    now = F.lit("2024-02-01").cast("timestamp_ntz")
    return table(spark, d, "events").select("event_id", S.time_ago(t, now).alias("age"), S.reopen_label(S.next_forex_open(t)).alias("reopens"), S.reopen_label(t).alias("at"), S.signal_glyph(signal).alias("glyph"))


@query("synthetic_walk")
def synthetic_walk(spark, d):
    """A random walk as long as all bars together, with their mean price and the spread of their returns."""
    rows = bars(spark, d).withColumn("r", W.log_return(F.col("close")))
    n, start, vol = rows.agg(F.count("*"), F.avg("close"), F.stddev_pop("r")).first()
    return B.random_walk(spark, n, start=start, vol=vol / 10).select("symbol", "open_time", r6("close"))
