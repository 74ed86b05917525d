"""Row-level expressions: cleaning, clipping, means with a stated null rule, labels and bands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phase limits and labels, gauge limits, score-band edges.
FEAR_EXTREME, FEAR, GREED, GREED_EXTREME = -60.0, -20.0, 20.0, 60.0
GAUGE_LIMIT = 60.0
BAND_EDGES = (-50.0, -40.0, -20.0, 0.0, 20.0, 40.0, 50.0)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: Column | str) -> Column:
    """NaN and infinities become NULL."""
    x = col(c).cast("double")
    return F.when(F.abs(x) < float("inf"), x)


def nonzero(c: Column | str) -> Column:
    return F.nullif(col(c), F.lit(0.0))


def clip(c: Column | str, low: float, high: float) -> Column:
    """NULL stays NULL (least/greatest alone would skip it)."""
    x = col(c)
    return F.when(x.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x)))


def mean_skip(columns: Sequence[Column | str]) -> Column:
    """Mean of the non-null values, NULL when there is none."""
    xs = [col(c) for c in columns]
    total = sum((F.coalesce(x, F.lit(0.0)) for x in xs[1:]), F.coalesce(xs[0], F.lit(0.0)))
    present = sum((x.isNotNull().cast("int") for x in xs[1:]), xs[0].isNotNull().cast("int"))
    return F.when(present > 0, total / present)


def mean_strict(columns: Sequence[Column | str]) -> Column:
    """Mean that is NULL as soon as one value is."""
    xs = [col(c) for c in columns]
    return sum(xs[1:], xs[0]) / len(xs)


def to_score(percentile: Column | str) -> Column:
    """Share 0..1 to score -100..100."""
    return clip(col(percentile) * 200 - 100, -100, 100)


def tanh_score(value: Column | str, scale: Column | str | float) -> Column:
    divisor = F.lit(scale) if isinstance(scale, (int, float)) else col(scale)
    return F.tanh(col(value) / nonzero(divisor)) * 100


def phase(score: Column | str) -> Column:
    s = col(score)
    return (
        F.when(s.isNull() | F.isnan(s), "unavailable")
        .when(s <= FEAR_EXTREME, "extreme_fear")
        .when(s <= FEAR, "fear")
        .when(s < GREED, "neutral")
        .when(s < GREED_EXTREME, "greed")
        .otherwise("extreme_greed")
    )


def band(score: Column | str) -> Column:
    """Index of the score band: lower edge inside, the last band closed, -1 outside or missing."""
    s = finite(score)
    expr = F.when(s.isNull() | (s < BAND_EDGES[0]) | (s > BAND_EDGES[-1]), F.lit(-1))
    for index, upper in enumerate(BAND_EDGES[1:-1]):
        expr = expr.when(s < upper, F.lit(index))
    return expr.otherwise(F.lit(len(BAND_EDGES) - 2))


def gauge(score: Column | str) -> Column:
    """Struct of marker position 0..100 and tone."""
    s = col(score)
    tone = F.when(s <= -GAUGE_LIMIT, "fear").when(s >= GAUGE_LIMIT, "greed").otherwise("neutral")
    return F.struct(clip((s + 100) / 2, 0, 100).alias("marker"), tone.alias("tone"))


def nearest_threshold(score: Column | str, levels: Column | str) -> Column:
    """Struct of the closest level and its distance; the earliest level wins ties."""
    s = col(score)
    ranked = F.transform(col(levels), lambda level, i: F.struct(F.abs(level - s).alias("distance"), i.alias("i"), level.alias("level")))
    best = F.array_min(ranked)
    return F.struct(best["level"].alias("next_threshold"), best["distance"].alias("distance_to_threshold"))


def attainable_range(bias: Column | str, weights: Column | str) -> Column:
    """Bounds the smoothed two-input model cannot leave: bias +/- sum |w| joined with 0, squashed."""
    b = col(bias)
    amplitude = F.aggregate(col(weights), F.lit(0.0), lambda acc, w: acc + F.abs(w))
    low = clip(100 * F.tanh(F.least(F.lit(0.0), b - amplitude)), -99, 99)
    high = clip(100 * F.tanh(F.greatest(F.lit(0.0), b + amplitude)), -99, 99)
    return F.struct(low.alias("attainable_min"), high.alias("attainable_max"))


def age_days(day: Column | str, today: Column | str, limit: int = 5) -> Column:
    """Struct of the age in calendar days and whether it exceeds ``limit``."""
    age = F.datediff(col(today), col(day))
    return F.struct(age.alias("age_days"), (age > limit).alias("stale"))
