"""Gap filling, centred medians and resampling of a series at given positions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoteflow.functions.series import centred_median
from quoteflow.operators.timeline import CHUNK_ROWS, Series, as_list, positions, running_on


def interpolate(df: DataFrame, column: str, out: str, limit: int = 12, key="symbol", ts: str = "date",
                size: int = CHUNK_ROWS) -> DataFrame:
    """Linear in the row number between known values; rows within ``limit`` of one on either side are filled.

    Beyond the first and last known value the nearest one is repeated, again for at most ``limit`` rows.
    """
    s = running_on(Series.cut(df, 0, key, ts, size), _pos=("count", F.lit(1)))
    known = F.when(F.col(column).isNotNull(), F.struct(F.col("_pos").alias("p"), F.col(column).alias("x")))
    s = running_on(running_on(s, _before=("last", known)), reverse=True, _after=("last", known))
    b, a, p = F.col("_before"), F.col("_after"), F.col("_pos")
    near_b, near_a = (p - b["p"]) <= limit, (a["p"] - p) <= limit
    line = b["x"] + (a["x"] - b["x"]) * (p - b["p"]) / (a["p"] - b["p"])
    value = (
        F.when(F.col(column).isNotNull(), F.col(column))
        .when(b.isNotNull() & a.isNotNull() & (near_b | near_a), line)
        .when(a.isNull() & near_b, b["x"])
        .when(b.isNull() & near_a, a["x"])
    )
    return s.add(**{out: value}).done("_pos", "_before", "_after")


def smooth(df: DataFrame, column: str, out: str, radius: int = 1, key="symbol", ts: str = "date",
           size: int = CHUNK_ROWS) -> DataFrame:
    """Centred median of 2*radius+1 rows; missing rows at the ends are left out."""
    s = Series.cut(df, radius, key, ts, size, ahead=radius)
    return s.add(**{out: centred_median(s, column, radius)}).done()


def resample_linear(df: DataFrame, column: str, wanted: DataFrame, at: str, out: str, key="symbol", ts: str = "date") -> DataFrame:
    """Value of the series at fractional 0-based row positions, by linear interpolation (ends are held)."""
    keys = as_list(key)
    points = positions(df, keys, ts, pos="_pos", total="_n").select(
        *keys, (F.col("_pos") - 1).alias("_i"), F.col(column).alias("_x"), (F.col("_n") - 1).alias("_end")
    )
    ends = points.groupBy(*keys).agg(F.max("_end").alias("_end"))
    asked = wanted.join(ends, keys)
    asked = asked.withColumn("_at", F.least(F.greatest(F.col(at).cast("double"), F.lit(0.0)), F.col("_end").cast("double")))
    asked = asked.withColumn("_i", F.floor("_at"))
    lower = points.select(*keys, "_i", "_x")
    upper = points.select(*keys, (F.col("_i") - 1).alias("_i"), F.col("_x").alias("_x1"))
    joined = asked.join(lower, [*keys, "_i"]).join(upper, [*keys, "_i"], "left")
    value = F.col("_x") + (F.coalesce("_x1", "_x") - F.col("_x")) * (F.col("_at") - F.col("_i"))
    return joined.withColumn(out, value).drop("_i", "_x", "_x1", "_at", "_end")
