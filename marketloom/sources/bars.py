"""Bars: the engine's main table, from ticks, landed exchange JSON or generated series.

Columns: symbol, open_time, open, high, low, close, volume, and, by with_index(), idx: the bar's
position in its symbol from 0. Every reader drops bars whose close is missing or not positive.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BAR_COLUMNS = ("symbol", "open_time", "open", "high", "low", "close", "volume")
KLINES = "array<array<string>>"
CANDLES = "array<struct<openTime:bigint,open:double,high:double,low:double,close:double,volume:double>>"
SERIES = "struct<status:string,values:array<struct<datetime:string,open:string,high:string,low:string,close:string,volume:string>>>"


def by_symbol() -> Window:
    return Window.partitionBy("symbol").orderBy("open_time")


def valid_bars(bars: DataFrame) -> DataFrame:
    return bars.filter((F.col("close") > 0) & ~F.isnan("close") & (F.col("close") < float("inf")))


def with_index(bars: DataFrame) -> DataFrame:
    return bars.withColumn("idx", (F.row_number().over(by_symbol()) - 1).cast("long"))


#: Seconds (or units of a numeric time) of a part of time.
PART = 86_400


def index_by_parts(bars: DataFrame) -> DataFrame:
    """with_index() without a task that holds a symbol: the place inside each day of a symbol after the counts of the days before, a row a day."""
    rows = bars.withColumn("__part", F.floor(F.unix_seconds(F.col("open_time").cast("timestamp")) / PART))
    before = Window.partitionBy("symbol").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("symbol", "__part").agg(F.count(F.lit(1)).alias("__n"))
    shifts = counts.select(F.col("symbol").alias("__s"), F.col("__part").alias("__p"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift"))
    inside = F.row_number().over(Window.partitionBy("symbol", "__part").orderBy("open_time")) - 1
    placed = rows.withColumn("__in", inside).join(shifts, F.col("symbol").eqNullSafe(F.col("__s")) & F.col("__part").eqNullSafe(F.col("__p")))
    return placed.select(*[c for c in bars.columns if c != "idx"], (F.col("__in") + F.col("__shift")).cast("long").alias("idx"))


def ticks_to_bars(ticks: DataFrame, width: str = "1 hour", symbol="event_type", time="ts", price="value", order: str | None = None) -> DataFrame:
    """Tumbling bars of ticks; volume counts ticks. One shuffle on (symbol, bucket), aggregated before it.

    Ticks of one time come in the order of the column `order`, then of their price.
    """
    at = F.struct(time, *([order] if order else []), price)
    bucket = F.window(F.col(time), width)["start"]
    grouped = ticks.filter(F.col(price) > 0).groupBy(F.col(symbol).alias("symbol"), bucket.alias("open_time"))
    return grouped.agg(
        F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"), F.count("*").cast("double").alias("volume")
    )


def klines_to_bars(landed: DataFrame, symbol="symbol", body="body") -> DataFrame:
    """Positional kline arrays [open time ms, open, high, low, close, volume, ...] as JSON text; of repeated open times the last read stays."""
    rows = landed.select(F.col(symbol).alias("symbol"), F.posexplode(F.from_json(F.col(body), KLINES)).alias("seq", "k"))
    number = [F.element_at("k", i + 1).cast("double").alias(n) for i, n in enumerate(("time", "open", "high", "low", "close", "volume"))]
    rows = rows.select("symbol", "seq", *number).withColumn("open_time", F.timestamp_millis(F.col("time").cast("long")))
    latest = rows.groupBy("symbol", "open_time").agg(F.max_by(F.struct("open", "high", "low", "close", "volume"), "seq").alias("c"))
    return valid_bars(latest.select("symbol", "open_time", "c.*"))


def series_to_bars(landed: DataFrame, body="body") -> tuple[DataFrame, DataFrame]:
    """(bars, failures) of a JSON object of series by symbol; times are UTC, a missing volume is 0, a symbol with status error fails alone."""
    rows = landed.select(F.explode(F.from_json(F.col(body), f"map<string,{SERIES}>")).alias("symbol", "s"))
    failed = rows.filter((F.col("s.status") == "error") | F.col("s.values").isNull()).select("symbol", F.lit("no series").alias("reason"))
    values = rows.filter(F.coalesce(F.col("s.status"), F.lit("ok")) != "error").select("symbol", F.inline("s.values"))
    bars = values.select(
        "symbol", F.to_timestamp("datetime").alias("open_time"), *(F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close")), F.coalesce(F.col("volume").cast("double"), F.lit(0.0)).alias("volume")
    )
    return valid_bars(bars), failed


def flat_headers(landed: DataFrame, symbol: Column, separator: str = "|") -> DataFrame:
    """Bars of a table whose headers have two levels, as Open|EURUSD=X: the first level counts, whatever its case.

    The time is Datetime, else Date, text being UTC; a missing Volume column is 0; rows without a close are left out. Of
    headers that are equal after the second level is gone the first counts; a header that is missing raises ValueError.
    """
    first: dict[str, Column] = {}
    for name in landed.columns:
        first.setdefault(name.split(separator)[0].strip().lower(), F.col(f"`{name}`"))
    time = next((first[c] for c in ("datetime", "date") if c in first), None)
    lacking = [c for c in ("open", "high", "low", "close") if c not in first] + (["datetime"] if time is None else [])
    if lacking:
        raise ValueError(f"no column {', '.join(lacking)}")
    prices = [first[c].cast("double").alias(c) for c in ("open", "high", "low", "close")]
    volume = first["volume"].cast("double") if "volume" in first else F.lit(0.0)
    rows = landed.select(symbol.alias("symbol"), time.cast("timestamp").alias("open_time"), *prices, volume.alias("volume"))
    return rows.filter(F.col("close").isNotNull() & ~F.isnan("close"))


def metric_of_json(landed: DataFrame, symbol="symbol", body="body") -> DataFrame:
    """(symbol, time, value) of JSON arrays of {t: epoch seconds, v: number}; points without a time or number go, of repeated times the last in a body stays.

    A null or empty body has no points; times that come again in another body of a symbol keep the greatest value.
    """
    rows = landed.select(F.col(symbol).alias("symbol"), F.posexplode(F.from_json(F.col(body), "array<struct<t: long, v: double>>")).alias("seq", "p"))
    rows = rows.filter("p.t IS NOT NULL AND p.v IS NOT NULL AND NOT isnan(p.v)")
    return rows.groupBy("symbol", F.timestamp_seconds("p.t").alias("time")).agg(F.max_by("p.v", F.struct("seq", "p.v")).alias("value"))


def candles_of_cache(cache: DataFrame) -> DataFrame:
    """Bars of cached candle arrays (symbol, candles)."""
    rows = cache.select("symbol", F.inline("candles"))
    return valid_bars(rows.select("symbol", F.timestamp_millis("openTime").alias("open_time"), "open", "high", "low", "close", "volume"))


def cache_of_bars(bars: DataFrame) -> DataFrame:
    """One array of candles for each symbol, oldest first: the cache's cell."""
    ms = F.unix_millis(F.col("open_time").cast("timestamp"))
    candle = F.struct(ms.alias("openTime"), "open", "high", "low", "close", "volume")
    return bars.groupBy("symbol").agg(F.array_sort(F.collect_list(candle)).alias("candles"))


def latest_bars(bars: DataFrame, symbol: str, n: int) -> DataFrame:
    """The last n bars of one symbol, oldest first."""
    return bars.filter(F.col("symbol") == symbol).orderBy(F.desc("open_time")).limit(n).orderBy("open_time")


def book_imbalance(bids: Column, asks: Column) -> Column:
    """(bid size - ask size) / (bid size + ask size) of arrays of [price, size]; 0 for an empty book."""
    b, a = (F.aggregate(side, F.lit(0.0), lambda acc, x: acc + F.element_at(x, 2)) for side in (bids, asks))
    return F.when(a + b > 0, (b - a) / (a + b)).otherwise(0.0)


def read_trials(spark: SparkSession, path: str) -> DataFrame:
    """The append-only log of trials; malformed lines are skipped."""
    return spark.read.schema("symbol string, kind string, sharpe double, n_obs long, ts string").option("mode", "DROPMALFORMED").json(path)


#: The instrument registry, (symbol, name); crypto trades against USDT, forex legs are fiat.
CRYPTO = (("BTC", "Bitcoin"), ("ETH", "Ethereum"), ("SOL", "Solana"), ("XRP", "XRP"), ("ADA", "Cardano"), ("DOGE", "Dogecoin"), ("AVAX", "Avalanche"), ("LINK", "Chainlink"), ("DOT", "Polkadot"), ("LTC", "Litecoin"))
FOREX = ("EUR/USD", "USD/JPY", "GBP/USD", "GBP/JPY", "AUD/USD", "USD/CAD", "USD/CHF", "EUR/JPY", "NZD/USD", "EUR/GBP")


def instruments(spark: SparkSession) -> DataFrame:
    """(position, symbol, kind, source_symbol): the static registry, small enough to broadcast."""
    rows = [(f"{c}/USDT", "crypto", f"{c}USDT") for c, _ in CRYPTO] + [(s, "forex", s) for s in FOREX]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "position int, symbol string, kind string, source_symbol string")


def random_walk(spark: SparkSession, n: int, symbol: str = "WALK", start: float = 100.0, vol: float = 0.002, drift: float = 0.0, seed: int = 1) -> DataFrame:
    """A geometric random walk of n 5-minute bars with noise around it; made in Spark, so of any length."""
    order = Window.partitionBy("symbol").orderBy("id")
    steps = spark.range(n).select(F.lit(symbol).alias("symbol"), "id", (F.randn(seed) * vol + drift).alias("r"), F.abs(F.randn(seed + 1)).alias("u"), F.abs(F.randn(seed + 2)).alias("d"), F.exp(F.randn(seed + 3) * 0.4 + 6).alias("volume"))
    closes = steps.withColumn("close", F.exp(F.sum("r").over(order)) * start).withColumn("open", F.coalesce(F.lag("close").over(order), F.col("close")))
    top, bottom = F.greatest("open", "close"), F.least("open", "close")
    return closes.select("symbol", F.timestamp_seconds(F.col("id") * 300).alias("open_time"), "open", (top * (1 + F.col("u") * vol / 2)).alias("high"), (bottom * (1 - F.col("d") * vol / 2)).alias("low"), "close", "volume")


def planted_reversion(spark: SparkSession, n: int, symbol: str = "PLANTED", strength: float = 0.35, vol: float = 0.002, seed: int = 7) -> DataFrame:
    """A walk that leans against the sign of its last 12 returns: each step needs the one before, so it is made on the driver (for tests)."""
    rng = np.random.default_rng(seed)
    r = np.zeros(n)
    for i in range(n):
        r[i] = rng.normal(0, vol) - strength * vol * np.sign(r[max(0, i - 12) : i].sum())
    close = 100 * np.exp(np.cumsum(r))
    rows = [(symbol, i * 300, float(c), float(v)) for i, (c, v) in enumerate(zip(close, np.exp(rng.normal(6, 0.4, n))))]
    base = spark.createDataFrame(rows, "symbol string, s long, close double, volume double")
    opened = base.withColumn("open", F.coalesce(F.lag("close").over(Window.partitionBy("symbol").orderBy("s")), F.col("close")))
    return opened.select("symbol", F.timestamp_seconds("s").alias("open_time"), "open", (F.greatest("open", "close") * (1 + vol / 4)).alias("high"), (F.least("open", "close") * (1 - vol / 4)).alias("low"), "close", "volume")
