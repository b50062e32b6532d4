"""Scalar functions: text, dates, probabilities, sizes."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Currency codes of forex legs.
FIAT = "USD EUR GBP JPY CHF AUD NZD CAD SEK NOK DKK PLN CZK HUF TRY ZAR MXN SGD HKD CNH CNY INR BRL".split()


def half_up(x: Column) -> Column:
    """Round to a whole number, halves upwards."""
    return F.floor(x + 0.5)


def is_forex(symbol: Column) -> Column:
    legs = F.split(F.upper(symbol), "/")
    return (F.size(legs) == 2) & F.get(legs, F.lit(0)).isin(FIAT) & F.get(legs, F.lit(1)).isin(FIAT)


def asset_class(symbol: Column) -> Column:
    return F.when(is_forex(symbol), "forex").otherwise("crypto")


def fixed(x: Column, digits: int = 2) -> Column:
    """x with so many decimals, rounded by its exact binary value, halves away from zero; format_string would round the shortest decimal that stands for x."""
    doubled = F.abs(x) * 2.0 ** (digits + 1)
    half = (doubled < 2.0**52) & (doubled % 2 == 1)
    exact = F.when(half, x + F.signum(x) * 10.0 ** -(digits + 1)).otherwise(x)
    return F.call_function("format_number", exact, F.lit("0." + "0" * digits))


def format_price(price: Column, symbol: Column) -> Column:
    """Forex 5 decimals (yen 3), from 1000 grouped with at most 2, from 1 with 2, below with 6; a dash where there is none."""
    grouped = F.format_number(F.round(price.cast("decimal(38,12)"), 2), 2)
    return (
        F.when(price.isNull() | F.isnan(price), "—")
        .when(is_forex(symbol) & F.upper(symbol).contains("JPY"), fixed(price, 3))
        .when(is_forex(symbol), fixed(price, 5))
        .when(price >= 1000, F.regexp_replace(grouped, r"\.?0+$", ""))
        .when(price >= 1, fixed(price))
        .otherwise(fixed(price, 6))
    )


def format_percent(x: Column, digits: int = 2) -> Column:
    """A plus or a true minus sign before any but 0; a dash where there is none."""
    sign = F.when(x > 0, "+").when(x < 0, "\u2212").otherwise("")
    return F.when(x.isNull() | F.isnan(x), "—").otherwise(F.concat(sign, fixed(F.abs(x), digits), F.lit("%")))


def compact_volume(v: Column) -> Column:
    """Billions and millions with 2 decimals, thousands with 1, less with 2; n/a for 0, as of instruments without volume."""
    return (
        F.when(v.isNull() | F.isnan(v), "—")
        .when(v == 0, "n/a")
        .when(v >= 1e9, F.concat(fixed(v / 1e9), F.lit("B")))
        .when(v >= 1e6, F.concat(fixed(v / 1e6), F.lit("M")))
        .when(v >= 1e3, F.concat(fixed(v / 1e3, 1), F.lit("K")))
        .otherwise(fixed(v))
    )


def rsi_zone(rsi: Column) -> Column:
    return (
        F.when(rsi.isNull() | F.isnan(rsi.cast("double")), "no data")
        .when(rsi >= 70, "overbought").when(rsi >= 60, "strong").when(rsi > 40, "neutral").when(rsi > 30, "weak").otherwise("oversold")
    )


def time_ago(ts: Column, now: Column) -> Column:
    """now (under 10 seconds, or in the future), 59s ago, 59m ago, 23h ago, 8d ago; a dash where there is no time."""
    s = F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))) / 1_000_000)
    text = lambda per, unit: F.concat(F.floor(s / per).cast("string"), F.lit(f"{unit} ago"))
    return F.when(ts.isNull(), "—").when(s < 10, "now").when(s < 60, text(1, "s")).when(s < 3600, text(60, "m")).when(s < 86_400, text(3600, "h")).otherwise(text(86_400, "d"))


def reopen_label(ts: Column) -> Column:
    """Sun 22:00 UTC, of a time in UTC; NULL where there is none."""
    return F.concat(F.date_format(ts, "EEE HH:mm"), F.lit(" UTC"))


def signal_glyph(signal: Column) -> Column:
    """A triangle up or down, else a square."""
    return F.when(signal == "UP", "▲").when(signal == "DOWN", "▼").otherwise("■")


def confidence_blocks(confidence: Column) -> Column:
    return half_up(confidence / 10).cast("int")


def data_symbol(symbol: Column) -> Column:
    """EUR/USD -> EURUSD=X for forex, else without the slash."""
    bare = F.replace(symbol, F.lit("/"), F.lit(""))
    return F.when(is_forex(symbol), F.concat(bare, F.lit("=X"))).otherwise(bare)


# --- dates; Sunday is 1 for dayofweek -----------------------------------------------------------------------------------


def forex_open(ts: Column) -> Column:
    """Open from Sunday 22:00 to Friday 22:00 UTC."""
    day, hour = F.dayofweek(ts), F.hour(ts)
    return ~((day == 7) | ((day == 1) & (hour < 22)) | ((day == 6) & (hour >= 22)))


def next_forex_open(ts: Column) -> Column:
    """The Sunday 22:00 UTC that ends the closure, NULL while open."""
    days = (8 - F.dayofweek(ts)) % 7
    start = F.date_add(ts.cast("date"), days.cast("int")).cast("timestamp_ntz")
    return F.when(~forex_open(ts), start + F.expr("INTERVAL 22 HOURS"))


def day_fraction(ts: Column) -> Column:
    """Hours since midnight."""
    return F.hour(ts) + F.minute(ts) / 60 + F.second(ts) / 3600


def cyclic(x: Column, period: float) -> tuple[Column, Column]:
    return F.sin(x * (2 * math.pi / period)), F.cos(x * (2 * math.pi / period))


def tick_group(ts: Column, groups: int) -> Column:
    """The group of instruments whose turn the minute is: every tenth minute of the day, in rotation; else NULL."""
    minute = F.hour(ts) * 60 + F.minute(ts)
    return F.when(minute % 10 == 0, (minute / 10).cast("int") % groups)


# --- probabilities ------------------------------------------------------------------------------------------------------

#: Acklam's coefficients of the inverse normal distribution, centre and tail, numerators and denominators.
PPF_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
PPF_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
PPF_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
PPF_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
PPF_TAIL = 0.02425


def _horner(coefficients, x: Column, last: float | None = None) -> Column:
    """A polynomial as a fold over its coefficients, so that x stands in the plan once."""
    all_of = F.array(*(F.lit(c) for c in [*coefficients, *([] if last is None else [last])]))
    return F.aggregate(all_of, F.lit(0.0), lambda acc, c: acc * x + c)


def norm_ppf(p: Column) -> Column:
    """The inverse of the normal distribution, infinite at 0 and 1."""
    inner = F.when((p > 0) & (p < 1), p)
    tail = F.when(inner < PPF_TAIL, inner).when(inner > 1 - PPF_TAIL, 1 - inner)
    q = F.sqrt(-2 * F.ln(tail))
    far = _horner(PPF_C, q) / _horner(PPF_D, q, 1.0)
    d = inner - 0.5
    near = _horner(PPF_A, d * d) * d / _horner(PPF_B, d * d, 1.0)
    return F.when(p <= 0, F.lit(float("-inf"))).when(p >= 1, F.lit(float("inf"))).when(inner < PPF_TAIL, far).when(inner > 1 - PPF_TAIL, -far).otherwise(near)


#: Hart's coefficients of the normal distribution's tail, numerator and denominator, highest power first; his continued fraction beyond CDF_FAR.
CDF_P = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
CDF_Q = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
CDF_FAR, CDF_LAST = 7.07106781186547, 0.65


def norm_cdf(x: Column) -> Column:
    """The normal distribution to 1e-14, 0 and 1 far out; NULL for NULL and NaN. Spark SQL has no error function."""
    z = F.when(~F.isnan(x), F.abs(x))
    near = _horner(CDF_P, z) / _horner(CDF_Q, z)
    fraction = F.aggregate(F.array(*(F.lit(float(k)) for k in (4, 3, 2, 1))), z + CDF_LAST, lambda acc, k: z + k / acc)
    tail = F.exp(-z * z / 2) * F.when(z < CDF_FAR, near).otherwise(1 / (fraction * math.sqrt(2 * math.pi)))
    return F.when(x > 0, 1 - tail).otherwise(tail)


def sigmoid(z: Column) -> Column:
    e = F.exp(-F.abs(z))
    return F.when(z >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


# --- sizes --------------------------------------------------------------------------------------------------------------


def bet_size(p: Column) -> Column:
    """Signed size by the z of a calibrated probability; 0 at one half."""
    q = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.signum(q - 0.5) * (2 * norm_cdf(F.abs((q - 0.5) / F.sqrt(q * (1 - q)))) - 1)


def fractional_kelly(p: Column, payoff: float = 2.0, fraction: float = 0.375) -> Column:
    q = F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))
    return fraction * F.greatest(F.lit(0.0), q - (1 - q) / payoff)


def vol_target_size(forecast: Column, target: float, most: float = 3.0) -> Column:
    return F.when(forecast > 0, F.least(F.lit(most), F.lit(target) / F.when(forecast > 0, forecast))).otherwise(0.0)


def round_trip_cost_bps(size: Column, fee: float = 5.0, half_spread: float = 1.0, impact: float = 3.0) -> Column:
    return F.lit(2 * fee + 2 * half_spread) + impact * F.sqrt(F.greatest(F.lit(0.0), size))


def combined_size(p: Column, forecast: Column, target: float) -> Column:
    return F.least(fractional_kelly(p), vol_target_size(forecast, target))


def net_return(gross: Column, size: Column) -> Column:
    return gross - round_trip_cost_bps(size) / 10000
