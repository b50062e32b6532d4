"""Golden vectors and independent re-derivations of indicators, signals, features and labels."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.functions import scalars as S
from marketloom.functions import windows as W
from marketloom.operators import features as X
from marketloom.operators import joins as J
from marketloom.operators import recursive as R
from marketloom.operators import signals as G
from marketloom.sources import bars as B

CLOSES = [44.34, 44.09, 44.15, 43.61, 44.33, 44.83, 45.10, 45.42, 45.84, 46.08, 45.89, 46.03, 45.61, 46.28, 46.28, 46.00, 46.03, 46.41, 46.22, 45.64]
BAR = "symbol string, open_time timestamp, open double, high double, low double, close double, volume double"


def frame(spark, closes, volume=100.0, symbol="A", spread=1.0):
    import datetime

    t0 = datetime.datetime(2024, 1, 1)
    return spark.createDataFrame([(symbol, t0 + datetime.timedelta(minutes=5 * i), float(c), float(c) + spread, float(c) - spread, float(c), float(volume)) for i, c in enumerate(closes)], BAR)


def column(df, name):
    return [r[name] for r in df.orderBy("symbol", "open_time").collect()]


def test_rsi_golden():
    series = R.rsi(np.array(CLOSES))
    assert abs(R.rsi(np.array(CLOSES[:15]))[-1] - 70.46) < 0.5
    assert np.isnan(series[13]) and not np.isnan(series[14]) and ((series[14:] > 0) & (series[14:] < 100)).all()
    assert R.rsi(np.arange(1.0, 31))[-1] == 100 and R.rsi(np.arange(30.0, 0, -1))[-1] == 0 and np.isnan(R.rsi(np.array([1.0, 2, 3]))).all()


def test_recursive_columns_against_loops(spark):
    rng = np.random.default_rng(1)
    closes = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, 80)))
    rows = R.with_recursive(frame(spark, closes))
    ema, k = closes[0], 2 / 13
    for c in closes[1:]:
        ema = k * c + (1 - k) * ema
    assert math.isclose(column(rows, "ema12")[-1], ema, rel_tol=1e-12)
    assert column(rows, "atr14")[13] is None and column(rows, "atr14")[14] is not None
    assert column(rows, "adx14")[26] is None and column(rows, "adx14")[27] is not None
    assert column(rows, "ewma_vol")[0] == 0.0


def test_windows(spark):
    assert column(frame(spark, range(1, 11)).withColumn("m", W.mean(F.col("close"), 10)), "m")[-1] == 5.5
    assert column(frame(spark, [1, 2]).withColumn("m", W.mean(F.col("close"), 5)), "m") == [None, None]
    bb = G.bollinger(F.col("close"), 20)
    flat = frame(spark, [100] * 30).select("symbol", "open_time", *(c.alias(n) for n, c in bb.items())).orderBy("open_time").collect()[-1]
    assert (flat["upper"], flat["lower"], flat["breakout"], flat["percent_b"]) == (100, 100, None, 0.5)
    spike = frame(spark, [100] * 19 + [130]).select("open_time", *(c.alias(n) for n, c in bb.items())).orderBy("open_time").collect()[-1]
    assert spike["breakout"] == "UPPER" and spike["bandwidth"] > 0


@pytest.mark.parametrize("volumes, want", [((100, 300), 17.5), ((0, 0), 15.0)])
def test_vwap(spark, volumes, want):
    import datetime

    t = datetime.datetime(2024, 1, 1)
    rows = [("A", t, 10.0, 12.0, 8.0, 10.0, float(volumes[0])), ("A", t + datetime.timedelta(1), 20.0, 22.0, 18.0, 20.0, float(volumes[1]))]
    assert column(spark.createDataFrame(rows, BAR).withColumn("v", W.vwap(2)), "v")[-1] == want


@pytest.mark.parametrize("price, sma, rsi, bw, bo, vwap, profile, signal, rule", [
    (110.0, 100.0, 50.0, 0.03, None, 105.0, "conservative", "UP", "spec-up"),
    (90.0, 100.0, 70.0, 0.03, None, 95.0, "conservative", "DOWN", "spec-down"),
    (100.1, 100.0, 50.0, 0.001, None, 100.0, "conservative", "NEUTRAL", "sideways-range"),
    (100.0, None, None, None, None, None, "conservative", "NEUTRAL", "insufficient-data"),
    (100.6, 100.0, 50.0, 0.01, None, 101.0, "conservative", "NEUTRAL", "spec-up-below-threshold"),
    (100.6, 100.0, 50.0, 0.01, None, 101.0, "aggressive", "UP", "spec-up"),
])
def test_signal_cases(spark, price, sma, rsi, bw, bo, vwap, profile, signal, rule):
    row = spark.createDataFrame([(price, sma, rsi, bw, bo, vwap)], "p double, s double, r double, b double, o string, v double")
    got = row.select(G.signal(G.profile(profile), *(F.col(c) for c in "psrbov")).alias("x")).first()["x"]
    assert (got["signal"], got["rule"]) == (signal, rule) and got["reasons"][0] == f"rule {rule.removesuffix('-below-threshold')}"


#: Confidences added up by hand from the specification: 40, +4 for each percent from the mean up to 20, +12 for a fitting RSI (+8 under 40),
#: +12 or -8 by the volume-weighted price, +10 for a middling and -10 for an extreme bandwidth, +6 for a breakout in the call's direction.
@pytest.mark.parametrize("price, sma, rsi, bw, bo, vwap, signal, rule, confidence", [
    (102.0, 100.0, 50.0, 0.03, "UPPER", 101.0, "UP", "spec-up", 40 + 8 + 12 + 12 + 10 + 6),
    (102.0, 100.0, 50.0, 0.03, "LOWER", 101.0, "UP", "spec-up", 40 + 8 + 12 + 12 + 10),
    (98.0, 100.0, 66.0, 0.03, "LOWER", 99.0, "DOWN", "spec-down", 40 + 8 + 12 + 12 + 10 + 6),
    (98.0, 100.0, 66.0, 0.03, "UPPER", 99.0, "DOWN", "spec-down", 40 + 8 + 12 + 12 + 10),
    (98.0, 100.0, 30.0, 0.03, "LOWER", 99.0, "DOWN", "trend-down", 40 + 8 + 8 + 12 + 10 + 6),
    (105.0, 100.0, 75.0, 0.03, "UPPER", 110.0, "DOWN", "reversal-down", 40 + 20 + 12 + 12 + 10),
    (105.0, 100.0, 25.0, 0.03, "LOWER", 104.0, "UP", "bounce-up", 40 + 20 + 12 + 10),
    (103.0, 100.0, 50.0, 0.03, None, None, "UP", "spec-up", 40 + 12 + 12 + 10),
    (103.0, 100.0, 50.0, 0.06, "UPPER", 102.0, "UP", "spec-up", 40 + 12 + 12 + 12 - 10 + 6),
    (101.0, 100.0, 50.0, 0.07, None, 102.0, "NEUTRAL", "spec-up-below-threshold", 40 + 4 + 12 - 8 - 10),
    (101.0, 100.0, 65.0, 0.03, None, 100.0, "NEUTRAL", "no-rule-matched", 30),
])
def test_confidence_by_hand(spark, price, sma, rsi, bw, bo, vwap, signal, rule, confidence):
    row = spark.createDataFrame([(price, sma, rsi, bw, bo, vwap)], "p double, s double, r double, b double, o string, v double")
    got = row.select(G.signal(G.PROFILES["conservative"], *(F.col(c) for c in "psrbov")).alias("x")).first()["x"]
    assert (got["signal"], got["rule"], got["confidence"]) == (signal, rule, confidence)


def test_signal_price_of_few_bars(spark):
    """The signal's volume-weighted price takes the last 288 bars or as many as there are."""
    closes = [100.0 + i % 7 for i in range(300)]
    got = column(G.with_signals(frame(spark, closes)), "vwap")
    assert got[0] == closes[0] and math.isclose(got[9], sum(closes[:10]) / 10) and math.isclose(got[299], sum(closes[12:]) / 288)
    assert set(column(G.with_signals(frame(spark, closes, volume=0.0)), "vwap_is_volume_weighted")) == {False}


def test_recursions_by_blocks(spark):
    """Blocks that begin early give what one pass over the whole history gives."""
    rng = np.random.default_rng(3)
    rows = B.with_index(frame(spark, 100 * np.exp(np.cumsum(rng.normal(0, 0.01, 5000)))))
    whole, parts = R.with_recursive(rows), R.with_recursive(rows, block=2500, halo=2048)
    for c in R.COLUMNS:
        a, b = column(whole, c), column(parts, c)
        assert len(a) == len(b) == 5000 and all((x is None) == (y is None) and (x is None or math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-12)) for x, y in zip(a, b)), c
    x = rng.normal(0, 1, 1000)
    y, before = [], 2.0
    for v in x:
        before = 0.9 * before + 0.3 * v
        y.append(before)
    assert np.allclose(R.linear(x, 0.9, 0.3, 2.0), y, rtol=1e-12)


def test_entry_window(spark):
    closes = [100 + 5 * math.sin(i / 5) for i in range(100)]
    rows = R.with_recursive(frame(spark, closes).withColumn("volume", F.when(F.col("close") == closes[60], 1000.0).otherwise(100.0)))
    as_of = F.lit("2024-01-01 08:20:00").cast("timestamp")
    got = G.entry_windows(rows, as_of).first()
    assert math.isclose(got["stop_loss"], got["close"] * 0.98) and got["quality"] in ("strong", "moderate", "weak")
    assert G.entry_windows(R.with_recursive(frame(spark, [1.0])), as_of).count() == 0
    fx = G.entry_windows(R.with_recursive(frame(spark, closes, symbol="EUR/USD")), as_of, p=G.PROFILES["aggressive"]).first()
    assert fx["stop_loss_percent"] == 0.5 and math.isclose(fx["stop_loss"], fx["close"] * 0.995)


def test_symbols_and_formats(spark):
    rows = spark.createDataFrame([("BTC/USDT", 61501.29249), ("SOL/USDT", None), ("EUR/USD", 1.0826912), ("GBP/JPY", 193.45678), ("X", 0.5)], "symbol string, price double")
    got = rows.select(S.is_forex(F.col("symbol")).alias("fx"), S.format_price(F.col("price"), F.col("symbol")).alias("p")).collect()
    assert [r["fx"] for r in got] == [False, False, True, True, False]
    assert [r["p"] for r in got] == ["61,501.29", "—", "1.08269", "193.457", "0.500000"]
    stops = rows.select(G.stop_loss_percent(G.PROFILES["conservative"], F.col("symbol")).alias("s")).collect()
    assert stops[0]["s"] > stops[2]["s"] and G.profile("unknown").name == "conservative"


def test_look_ahead_free_features(spark):
    """Features of the first bars don't change when later bars are taken away."""
    rows = J.cross_section(frame(spark, 100 * np.exp(np.cumsum(np.random.default_rng(2).normal(0, 0.01, 160)))))
    whole = {r["idx"]: r for r in X.build_features(rows).collect()}
    times = sorted(r["open_time"] for r in rows.select("open_time").collect())
    for n in (121, 140):
        part = {r["idx"]: r for r in X.build_features(rows.filter(F.col("open_time") <= times[n - 1])).collect()}
        assert len(part) == n
        for i, r in part.items():
            for c in X.FEATURE_NAMES:
                a, b = r[c], whole[i][c]
                assert (a is None) == (b is None) and (a is None or abs(a - b) < 1e-9), (n, i, c)
    assert min(i for i, r in whole.items() if r["valid"]) == 49


def test_zero_volume_series(spark):
    last = X.build_features(frame(spark, np.linspace(1.08, 1.09, 80), volume=0.0, spread=0.001)).orderBy("idx").collect()[-1]
    assert last["volume_z"] == 0.0 and last["log_p_vwap"] is not None and last["valid"]


def test_triple_barrier_against_loops(spark):
    rng = np.random.default_rng(4)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, 120)))
    rows = B.with_index(frame(spark, close)).withColumn("sigma", F.lit(0.01))
    got = {r["idx"]: r for r in X.triple_barrier(rows, "sigma", vertical=10).collect()}
    lp = np.log(close)
    for i in range(120):
        label, touch, able = 0, i, False
        for j in range(i + 1, min(i + 10, 119) + 1):
            if lp[j] >= lp[i] + 0.02 or lp[j] <= lp[i] - 0.01:
                label, touch, able = (1 if lp[j] >= lp[i] + 0.02 else -1), j, True
                break
        if not able and i + 10 <= 119:
            touch, able = i + 10, True
        assert (got[i]["label"], got[i]["touch_idx"], got[i]["labelable"]) == (label, touch, able)


def test_asof_ties_and_gaps(spark):
    bars = spark.createDataFrame([("A", 1), ("A", 5), ("B", 5)], "symbol string, open_time int")
    points = spark.createDataFrame([("A", 5, 2.0), ("A", 3, 1.0), ("B", 6, 9.0)], "symbol string, event_time int, v double")
    assert {(r["symbol"], r["open_time"]): r["v"] for r in J.asof(bars, points, "v").collect()} == {("A", 1): None, ("A", 5): 2.0, ("B", 5): None}
    assert {r["v"] for r in J.asof_filled(bars, None, "v").collect()} == {0.0}


def test_garch_recovers_persistence():
    rng = np.random.default_rng(0)
    r, s = np.zeros(1500), 1e-4
    for i in range(1500):
        r[i] = rng.normal(0, math.sqrt(s))
        s = 1e-4 * 0.1 + 0.15 * r[i] ** 2 + 0.75 * s
    (omega, alpha, beta), sigma = R.fit_garch(r)
    assert 0.03 < alpha < 0.4 and 0.4 < beta < 0.95 and (sigma > 0).all()


def test_sources(spark):
    body = '[[1000, "1", "2", "0.5", "1.5", "10"], [1000, "1", "2", "0.5", "1.7", "11"], [2000, "1", "2", "0.5", "0", "1"]]'
    got = B.klines_to_bars(spark.createDataFrame([("A", body)], "symbol string, body string")).collect()
    assert [(r["close"], r["volume"]) for r in got] == [(1.7, 11.0)]
    bars, failed = B.series_to_bars(spark.createDataFrame([('{"EUR/USD": {"values": [{"datetime": "2024-01-01 00:00:00", "open": "1", "high": "1", "low": "1", "close": "1.1"}]}, "X": {"status": "error"}}',)], "body string"))
    assert bars.first()["volume"] == 0.0 and [r["symbol"] for r in failed.collect()] == ["X"]
    assert B.instruments(spark).count() == 20
    book = spark.createDataFrame([([[1.0, 3.0]], [[2.0, 1.0]]), ([], [])], "b array<array<double>>, a array<array<double>>")
    assert [r["i"] for r in book.select(B.book_imbalance(F.col("b"), F.col("a")).alias("i")).collect()] == [0.5, 0.0]
    walk = B.random_walk(spark, 500)
    assert walk.filter("high < low OR close <= 0").count() == 0 and B.planted_reversion(spark, 300).count() == 300
