"""Numeric column functions: rounding, levels, robust scores, probabilities, vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(x: Column, digits: int = 0) -> Column:
    """Nearest multiple of 10**-digits, halves toward plus infinity."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / scale


def clamp(x: Column, low, high) -> Column:
    return F.least(F.lit(high) if not isinstance(high, Column) else high, F.greatest(F.lit(low) if not isinstance(low, Column) else low, x))


def safe_ratio(a: Column, b: Column) -> Column:
    return F.when(b <= 0, F.lit(0.0)).otherwise(a / b)


def to_db(amplitude: Column) -> Column:
    """Level in dB, not below -100."""
    return F.greatest(F.lit(-100.0), 20 * F.log10(F.greatest(F.lit(0.00001), amplitude)))


def robust_score(x: Column, center: Column, mad: Column, floor: float) -> Column:
    """Distance from the center in scaled MADs, within -3..8."""
    return clamp((x - center) / F.greatest(F.lit(floor), 1.4826 * mad), -3.0, 8.0)


def lift_ratio(x: Column, base: Column, floor: float) -> Column:
    return (x + floor) / (base + floor)


def let(value: Column, use) -> Column:
    """use(value) with value computed once: a lambda's argument is not copied into the places where it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def array_median(values: Column) -> Column:
    """Median of an array without nulls; 0 for an empty one."""
    middle = lambda s, k: F.get(s, k.cast("int")).cast("double")
    return let(F.sort_array(values), lambda s: F.coalesce((middle(s, F.floor((F.size(s) - 1) / 2)) + middle(s, F.floor(F.size(s) / 2))) / 2, F.lit(0.0)))


def array_mad(values: Column, center: Column) -> Column:
    return array_median(F.transform(values, lambda v: F.abs(v - center)))


def squashed_percentile(x: Column, center: Column, mad: Column) -> Column:
    """0.5 for flat data, else 0.5 + tanh(z / 3) / 2 with z within -6..6."""
    return F.when(mad <= 2.220446049250313e-16, F.lit(0.5)).otherwise(0.5 + F.tanh(clamp((x - center) / (1.4826 * mad), -6.0, 6.0) / 3) / 2)


def noisy_or(a: Column, b: Column) -> Column:
    return 1 - (1 - a) * (1 - b)


def erf(x: Column) -> Column:
    """Polynomial approximation of the error function (Abramowitz and Stegun 7.1.26)."""
    # fixed values: p, then a1..a5
    p, a = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    t = 1 / (1 + p * F.abs(x))
    series = ((((a[4] * t + a[3]) * t + a[2]) * t + a[1]) * t + a[0]) * t
    return F.signum(x) * (1 - series * F.exp(-x * x))


def poisson_tail(k: Column, rate: Column) -> Column:
    """P(X >= k) for a Poisson count; the normal approximation above a rate of 700."""
    one = F.lit(1.0)
    start = F.exp(-rate)
    terms = F.aggregate(
        F.when(k > 1, F.sequence(F.lit(1), (k - 1).cast("int"))).otherwise(F.array().cast("array<int>")),
        F.struct(start.alias("p"), start.alias("total")),
        lambda s, i: F.struct((s["p"] * rate / i).alias("p"), (s["total"] + s["p"] * rate / i).alias("total")),
        lambda s: s["total"],
    )
    normal = 1 - 0.5 * (1 + erf((k - 0.5 - rate) / F.sqrt(rate) / F.sqrt(F.lit(2.0))))
    tail = F.when(rate > 700, normal).otherwise(1 - terms)
    return F.when(rate == 0, F.when(k == 0, one).otherwise(0.0)).when(k <= 0, one).otherwise(clamp(tail, 0.0, 1.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine within 0..1; null for a zero vector."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(dot(a, b), norm(a) * norm(b))))


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    total = F.aggregate(F.transform(logits, lambda x: F.exp(x - top)), F.lit(0.0), lambda s, x: s + x)
    return F.transform(logits, lambda x: F.exp(x - top) / total)


def hamming64(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def luma(r: Column, g: Column, b: Column) -> Column:
    return 0.2126 * r + 0.7152 * g + 0.0722 * b


def duration_close(a: Column, b: Column) -> Column:
    """Whether two durations differ by at most 0.1 % of the first, within 2 to 10 seconds."""
    return F.abs(a - b) <= clamp(a * 0.001, 2000.0, 10000.0)
