"""Rolling rank of a value among its own recent values.

A frame of collected values compared by a lambda costs about a microsecond per element in the JVM. Here all ranks of a stage share one Arrow pass per
chunk (a chunk is bounded, see :mod:`timeline`), and each column of it is laid out once as an order-statistics structure that answers "how many of the
rows from a to b are at most v" in steps of the logarithm of the distinct values, whatever the frame's length. Columns that are not ranked pass
through as Arrow buffers and are never turned into pandas.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quoteflow.functions.scalars import mean_skip
from quoteflow.operators.timeline import Series


@dataclass(frozen=True)
class Rank:
    """``mode``: ``last`` = share of the k-row frame at most its last non-null value (0..1);
    ``current`` = the same for the current value, -100..100; ``prior`` = percent of the k rows before at most the current one."""

    out: str
    column: str
    k: int
    minimum: int
    mode: str = "last"


def rolling_percentile(out: str, column: str, k: int, minimum: int | None = None) -> Rank:
    return Rank(out, column, k, minimum or max(20, k // 2), "last")


def rolling_rank(out: str, column: str, k: int, minimum: int | None = None) -> Rank:
    return Rank(out, column, k, minimum or max(20, k // 2), "current")


def prior_rank(out: str, column: str, k: int = 504, minimum: int = 504) -> Rank:
    return Rank(out, column, k, minimum, "prior")


class OrderCounts:
    """Counts of values by place and size: values are coded by rank, and level by level, from the highest bit of the codes, the places are dealt stably to
    zeros and ones. A range of places stays a range on every level, so a count walks down one bit a level, for all queries at once."""

    def __init__(self, x: np.ndarray):
        known = np.isfinite(x)
        self.values = np.unique(x[known])
        codes = np.where(known, np.searchsorted(self.values, x), len(self.values))  # missing ones are above all limits
        self.levels = []
        for level in reversed(range(len(self.values).bit_length())):
            zero = codes >> level & 1 == 0
            self.levels.append((level, np.concatenate([[0], np.cumsum(zero)])))
            codes = np.concatenate([codes[zero], codes[~zero]])

    def at_most(self, start: np.ndarray, stop: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """How many of the places from start to before stop hold a value at most the limit."""
        goal, found = np.searchsorted(self.values, limit, side="right"), np.zeros(len(start), dtype=np.int64)
        for level, zeros in self.levels:
            low, high = zeros[start], zeros[stop]
            ones = goal >> level & 1 == 1
            found += np.where(ones, high - low, 0)
            start, stop = np.where(ones, zeros[-1] + start - low, low), np.where(ones, zeros[-1] + stop - high, high)
        return found


def rank_values(x: np.ndarray, k: int, minimum: int, mode: str, counts: OrderCounts | None = None) -> np.ndarray:
    """Ranks of one ordered chunk; NaN is missing."""
    reference = pd.Series(x).ffill().to_numpy() if mode == "last" else x
    # prior frames end one row before the current one
    stop = np.arange(len(x)) + (mode != "prior")
    start = np.maximum(stop - k, 0)
    known = np.concatenate([[0], np.cumsum(np.isfinite(x))])
    seen = known[stop] - known[start]
    below = (counts or OrderCounts(x)).at_most(start, stop, reference)
    with np.errstate(invalid="ignore", divide="ignore"):
        share = below / seen
        value = {"last": share, "current": share * 200 - 100, "prior": 100 * share}[mode]
    return np.where((seen >= minimum) & ~np.isnan(reference), value, np.nan)


def with_ranks(s: Series, *ranks: Rank) -> Series:
    """Append ranks to a cut series (its halo must cover the longest frame)."""
    order = [(c, "ascending") for c in s.order]

    def run(table: pa.Table) -> pa.Table:
        place = pc.sort_indices(table, sort_keys=order).to_numpy()
        columns = {c: np.asarray(table.column(c).cast(pa.float64()).to_numpy(), dtype=float)[place] for c in {item.column for item in ranks}}
        counts = {c: OrderCounts(x) for c, x in columns.items()}
        for item in ranks:
            ranked = np.empty(len(place))
            ranked[place] = rank_values(columns[item.column], item.k, item.minimum, item.mode, counts[item.column])
            table = table.append_column(item.out, pa.array(ranked, mask=np.isnan(ranked)))
        return table

    schema = T.StructType([*s.frame.schema.fields, *[T.StructField(item.out, T.DoubleType()) for item in ranks]])
    return s.using(s.frame.groupBy(*s.parts).applyInArrow(run, schema))


def percentile_set(prefix: str, column: str, ks: Sequence[int] = (63, 126, 252)) -> list[Rank]:
    return [rolling_percentile(f"{prefix}{k}", column, k) for k in ks]


def avg_percentiles(df: DataFrame, prefix: str, out: str, ks: Sequence[int] = (63, 126, 252)) -> DataFrame:
    """Null-skipping mean of the percentiles of :func:`percentile_set`."""
    return df.withColumn(out, mean_skip([F.col(f"{prefix}{k}") for k in ks])).drop(*[f"{prefix}{k}" for k in ks])
