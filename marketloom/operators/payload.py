"""What a reader of the latest state gets: snapshots, analyses with overlays, model opinions; and the context and clean-up behind them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marketloom.functions import windows as W
from marketloom.functions.scalars import asset_class, half_up
from marketloom.operators import signals as G
from marketloom.operators.joins import asof, lookup_range
from marketloom.operators.models import EXPORTABLE
from marketloom.sources.bars import by_symbol

#: Bars a symbol needs before it has a snapshot, closes of its volatility, bars of its overlay, seconds of a snapshot's bucket.
LEAST_BARS, VOLATILITY_CLOSES, OVERLAY_BARS, BUCKET = 60, 96, 288, 300


def _measured(bars: DataFrame, p: G.Profile) -> DataFrame:
    """bars with signals, and volatility: the sample deviation in percent of the last VOLATILITY_CLOSES closes' returns, of two at least."""
    rows = G.with_signals(bars, p).withColumn("__r", W.log_return(F.col("close")))
    frame = W.roll(VOLATILITY_CLOSES - 1)
    return rows.withColumn("volatility", F.when(F.count("__r").over(frame) >= 2, F.stddev_samp("__r").over(frame) * 100)).drop("__r")


def snapshots(bars: DataFrame, as_of: Column, p: G.Profile = G.PROFILES["conservative"], least_bars: int = LEAST_BARS) -> DataFrame:
    """The stored row of each symbol with at least least_bars bars: its last bar's measures and signal, under as_of's bucket, so that a second run in one bucket writes the same key."""
    last = G.latest(_measured(bars, p)).filter(F.col("idx") >= least_bars - 1)
    bucket = F.timestamp_seconds(F.floor(F.unix_seconds(as_of.cast("timestamp")) / BUCKET) * BUCKET)
    return last.select(
        "symbol", asset_class(F.col("symbol")).alias("asset_class"), F.col("close").alias("price"), "rsi", F.col("sma").alias(f"sma_{p.sma}"), "bb_upper", "bb_lower", "bb_bandwidth", "bb_breakout",
        "vwap", "vwap_is_volume_weighted", "volatility", "volume", "signal", "confidence", "rule", "reasons", bucket.alias("bucket_at"),
    )


def overlay(bars: DataFrame, p: G.Profile = G.PROFILES["conservative"], n: int = OVERLAY_BARS) -> DataFrame:
    """The last n bars of each symbol with their own rsi and sma, which see all bars before."""
    rows = G.with_signals(bars, p).withColumn("__last", F.max("idx").over(Window.partitionBy("symbol")))
    return rows.filter(F.col("idx") > F.col("__last") - n).select("symbol", "open_time", "close", "high", "low", "volume", "rsi", "sma")


def analyses(bars: DataFrame, as_of: Column, p: G.Profile = G.PROFILES["conservative"], day: int = 288) -> DataFrame:
    """One row a symbol: the last bar's measures, the close before it (its own where there is none), the change over day bars, nested bollinger (NULL until full) and entry_window (NULL without one)."""
    w = by_symbol()
    base = F.coalesce(F.lag("close", day - 1).over(w), F.first("close").over(w.rowsBetween(-(day - 1), 0)))
    rows = _measured(bars, p).withColumns({"prev_close": F.coalesce(F.lag("close").over(w), F.col("close")), "change_24h": F.when(base != 0, (F.col("close") - base) / F.when(base != 0, base) * 100).otherwise(0.0)})
    bands = F.struct(*(F.col(f"bb_{c}").alias(c) for c in ("upper", "middle", "lower", "bandwidth", "percent_b", "breakout")))
    last = G.latest(rows).select(
        "symbol", asset_class(F.col("symbol")).alias("asset_class"), F.col("close").alias("price"), "prev_close", "change_24h", "rsi", "sma", F.lit(p.sma).alias("sma_period"), "vwap", "vwap_is_volume_weighted", "volatility",
        F.when(F.col("bb_middle").isNotNull(), bands).alias("bollinger"), "signal", "confidence", "rule", "reasons", F.col("open_time").alias("last_tick"),
    )
    entries = G.entry_windows(rows, as_of, p=p)
    return last.join(entries.select("symbol", F.struct(*(c for c in entries.columns if c != "symbol")).alias("entry_window")), "symbol", "left")


def model_opinions(rows: DataFrame, p: Column, meta: dict, primary: Column | None = None, table: DataFrame | None = None) -> DataFrame:
    """rows with opinion: a struct of available, signal, confidence, confidence_is_meaningful, is_validated; and observed, from a reliability table (lo, hi, observed_freq).

    Not available: a NULL or NaN probability; and, where the model judges the primary call, one that is NULL or NEUTRAL.
    meta: mode, threshold, verdict, edge, accuracy, top_decile_acc; what is missing counts as not measured.
    """
    gate = meta.get("mode") == "meta_label"
    known = p.isNotNull() & ~F.isnan(p)
    edge, accuracy, top = meta.get("edge"), meta.get("accuracy"), meta.get("top_decile_acc")
    if gate:
        call = F.lit(None).cast("string") if primary is None else primary
        available = known & F.coalesce(call != "NEUTRAL", F.lit(False))
        signal, confidence, meaningful = F.when(p >= meta.get("threshold", 0.55), call).otherwise("NEUTRAL"), half_up(p * 100), True
    else:
        available = known
        signal, confidence = F.when(p >= 0.5, "UP").otherwise("DOWN"), half_up(F.abs(p - 0.5) * 200)
        meaningful = top is not None and accuracy is not None and top > accuracy + 0.02
    validated = edge is not None and edge > 0 and meta.get("verdict") in EXPORTABLE
    struct = F.struct(
        available.alias("available"), F.when(available, signal).alias("signal"), F.when(available, confidence.cast("int")).alias("confidence"), F.lit(meaningful).alias("confidence_is_meaningful"), F.lit(validated).alias("is_validated")
    )
    out = rows.withColumn("opinion", struct)
    if table is None:
        return out.withColumn("observed", F.lit(None).cast("double"))
    return lookup_range(out, table.select("lo", "hi", F.col("observed_freq").alias("observed")), p)


#: What a model's artifact says of itself; the rest of its JSON is not read.
ARTIFACT = "kind string, meta struct<mode: string, symbol: string, horizon_bars: int, cost_bps: double, verdict: string, trained_rows: long, meta_label_threshold: double, walk_forward: struct<accuracy_mean: double, base_rate_mean: double, edge_mean: double, edge_std: double, folds_positive_edge: int, folds: int, net_bps_mean: double, auc_mean: double>, calibration: struct<method: string, ece: double, mce: double>>"


def model_info(artifacts: DataFrame) -> DataFrame:
    """artifacts(body) with loaded, mode, verdict, the walk-forward and the calibration figures; an absent or unreadable body is not loaded."""
    rows = artifacts.withColumn("__a", F.from_json("body", ARTIFACT))
    m = lambda c: F.col(f"__a.meta.{c}")
    loaded = F.coalesce(F.col("__a.kind") != "absent", F.lit(False))
    info = {
        "loaded": loaded, "mode": F.when(loaded, F.when(m("mode") == "meta_label", "meta_label").otherwise("direction")), "trained_on": m("symbol"), "horizon_bars": m("horizon_bars"), "cost_bps": m("cost_bps"),
        "verdict": F.when(loaded, F.coalesce(m("verdict"), F.lit("UNKNOWN"))), "trained_rows": m("trained_rows"), "meta_label_threshold": m("meta_label_threshold"), "walk_forward": m("walk_forward"), "calibration": m("calibration"),
    }
    return rows.select(*artifacts.columns, *(c.alias(n) for n, c in info.items()))


def stats_series(landed: DataFrame, value_key: str, name: str) -> DataFrame:
    """(symbol, event_time, name) of landed pages (symbol, body): JSON arrays of records with a timestamp in milliseconds and value_key; decimals of a timestamp are microseconds."""
    records = landed.select("symbol", F.explode(F.from_json("body", "array<map<string,string>>")).alias("r"))
    return records.select("symbol", F.timestamp_micros((F.col("r")["timestamp"].cast("decimal(20,3)") * 1000).cast("long")).alias("event_time"), F.col("r")[value_key].cast("double").alias(name)).filter(F.col(name).isNotNull())


def with_context(bars: DataFrame, series: dict[str, DataFrame | None]) -> DataFrame:
    """bars with each series' last value at or before a bar; a series that could not be had (None) is NULL, and the rest still count."""
    for name, points in series.items():
        bars = bars.withColumn(name, F.lit(None).cast("double")) if points is None else asof(bars, points, name)
    return bars


def daily_metric(landed: DataFrame, name: str) -> DataFrame:
    """(day, name) of landed pages (body): JSON arrays of {t: seconds, v: value}; days of UTC whatever the session's zone."""
    records = landed.select(F.explode(F.from_json("body", "array<struct<t: long, v: double>>")).alias("r")).select("r.*")
    return records.select(F.date_from_unix_date(F.floor(F.col("t") / 86_400).cast("int")).alias("day"), F.col("v").alias(name))


def complete_rows(rows: DataFrame, target: str, exclude: tuple[str, ...] = (), hidden: str = "__") -> tuple[DataFrame, list[str]]:
    """(rows without gaps, their feature columns): infinite and NaN values are NULL, columns that are never known go, then rows with a gap or without a target.

    Features are the numeric columns but target, exclude and those that begin with hidden. One aggregate finds the columns that are never known.
    """
    numeric = [c for c, t in rows.dtypes if t in ("double", "float", "int", "bigint", "smallint", "tinyint") and c != target and c not in exclude and not c.startswith(hidden)]
    real = {c for c, t in rows.dtypes if t in ("double", "float")}
    finite = {c: F.when(~F.isnan(c) & (F.abs(F.col(c)) != float("inf")), F.col(c)) for c in numeric if c in real}
    clean = rows.withColumns(finite) if finite else rows
    counts = clean.agg(*(F.count(c).alias(c) for c in numeric)).first() if numeric else {}
    kept = [c for c in numeric if counts[c]]
    return clean.drop(*(set(numeric) - set(kept))).dropna(subset=[*kept, target]), kept


def split_failures(failures: DataFrame) -> DataFrame:
    """(asset_class, state, n) of failures(symbol, market_closed): a closed market is not a feed that is down."""
    state = F.when(F.coalesce("market_closed", F.lit(False)), "closed").otherwise("down")
    return failures.groupBy(asset_class(F.col("symbol")).alias("asset_class"), state.alias("state")).agg(F.count("*").alias("n"))


def format_time(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "HH:mm"), F.lit("—"))


def format_date_time(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "MMM dd, HH:mm"), F.lit("—"))


def fold_counts(metrics: DataFrame, by: str = "model") -> DataFrame:
    """(by, folds, folds_positive_edge) of metrics with edge, one row a fold."""
    return metrics.groupBy(by).agg(F.count("*").alias("folds"), F.count_if((F.col("edge") > 0) & ~F.isnan("edge")).alias("folds_positive_edge"))


def best_model(metrics: DataFrame, key: str = "model") -> DataFrame:
    """The key of the greatest edge; of ties (to nine digits) the least key."""
    known = metrics.filter(F.col("edge").isNotNull() & ~F.isnan("edge")).withColumn("edge", F.round("edge", 9))
    return known.groupBy("edge").agg(F.min(key).alias(key)).agg(F.max_by(key, "edge").alias(key), F.max("edge").alias("edge"))


def class_matched(key: Column, up_rate: Column) -> Column:
    """A coin that falls on 1 as often as up_rate says: by a digest of key, so that a row that is computed again has the same call."""
    draw = F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("double") / 2**32
    return (draw < up_rate).cast("int")


def toggle(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """rows of keys alone: those in both go, those of keys that rows lack come; repeats of either count once."""
    rows, keys = rows.dropDuplicates(), keys.dropDuplicates()
    return rows.join(keys, rows.columns, "left_anti").unionByName(keys.join(rows, rows.columns, "left_anti"))


def append_json(rows: DataFrame, path: str) -> None:
    """One JSON line a row, behind those that path has: the logs of trials and of models' metadata."""
    rows.write.mode("append").json(path)
