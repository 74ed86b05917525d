"""Recursions whose value depends on their own previous output.

No window frame expresses them, and a fold over a whole key is one task. Each recursion here is instead an
associative scan: every chunk is reduced to a short step vector, the steps of a key are folded into a seed per
chunk, and the chunks are replayed in parallel from their seeds. Keys with a single chunk skip the first pass.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quoteflow.operators.timeline import CHUNK, CHUNK_ROWS, OWN, PLACEMENT, PRED, SUCC, Series, whole_placement

SEED = "_seed"
STEP = "_step"


def _fields(df: DataFrame, names: Sequence[str]) -> list[T.StructField]:
    return [df.schema[n] for n in names]


def chunk_scan(
    s: Series,
    step: Callable[[pd.DataFrame], np.ndarray],
    combine: Callable[[np.ndarray | None, np.ndarray], np.ndarray],
    replay: Callable[[pd.DataFrame, np.ndarray | None], dict[str, np.ndarray]],
    outputs: Sequence[T.StructField],
    inputs: Sequence[str],
) -> DataFrame:
    """Append ``outputs`` computed by an associative scan over each key; halo copies are dropped."""
    keys, sort = s.keys, s.order
    cut = s.frame.where(OWN).drop(OWN)
    kept = [f for f in cut.schema.fields if s.placed or f.name not in PLACEMENT]
    names = [f.name for f in kept]
    result = T.StructType([*kept, *outputs])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(sort, kind="stable")
        first = pdf[SEED].iloc[0] if SEED in pdf.columns else None
        seed = None if first is None else np.asarray(first, dtype=float)
        return whole_placement(pdf[names].assign(**replay(pdf, seed)))

    used = list(dict.fromkeys([*keys, CHUNK, *sort, *inputs]))

    def summarise(pdf: pd.DataFrame) -> pd.DataFrame:
        head = pdf.iloc[[0]][[*keys, CHUNK]].copy()
        head[STEP] = [np.asarray(step(pdf.sort_values(sort, kind="stable")), dtype=float).tolist()]
        return head

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # the seed of a chunk is the state after the chunks before it; steps come sorted, so one batch and one state are held
        known, seed = None, None
        for pdf in batches:
            seeds = []
            for name, vector in zip(pdf[keys].itertuples(index=False, name=None), pdf[STEP], strict=True):
                if name != known:
                    known, seed = name, None
                seeds.append(None if seed is None else seed.tolist())
                seed = np.asarray(combine(seed, np.asarray(vector, dtype=float)), dtype=float)
            yield pdf[[*keys, CHUNK]].assign(**{SEED: seeds})

    head_fields = [*_fields(cut, keys), T.StructField(CHUNK, T.LongType())]
    vector = T.ArrayType(T.DoubleType())
    steps = (
        cut.where(F.col(SUCC).isNotNull() | F.col(PRED).isNotNull()).select(*used).groupBy(*keys, CHUNK)
        .applyInPandas(summarise, T.StructType([*head_fields, T.StructField(STEP, vector)]))
    )
    ordered = steps.repartition(*keys).sortWithinPartitions(*keys, CHUNK)
    seeds = ordered.mapInPandas(fold, T.StructType([*head_fields, T.StructField(SEED, vector)]))
    seeded = cut.join(seeds, [*keys, CHUNK], "left")
    return seeded.groupBy(*keys, CHUNK).applyInPandas(run, result)


@dataclass(frozen=True)
class Mean:
    """An exponential mean: ``alpha`` weight of the newest value; starts at the first value, or at 0."""

    out: str
    column: str
    alpha: float
    minimum: int = 0
    from_zero: bool = False


def span(out: str, column: str, n: int, minimum: int = 0) -> Mean:
    return Mean(out, column, 2.0 / (n + 1), minimum)


def wilder(out: str, column: str, n: int) -> Mean:
    return Mean(out, column, 1.0 / n, n)


def _ewm(values: np.ndarray, alpha: float, start: float) -> np.ndarray:
    """Recursion value per row from ``start`` (NaN = not started); nulls keep the value."""
    if np.isnan(start):
        return pd.Series(values).ewm(alpha=alpha, adjust=False, ignore_na=True).mean().to_numpy()
    padded = np.concatenate([[start], values])
    return pd.Series(padded).ewm(alpha=alpha, adjust=False, ignore_na=True).mean().to_numpy()[1:]


def means_on(s: Series, means: Sequence[Mean]) -> DataFrame:
    """All exponential means of a cut series in one Arrow pass."""
    means = list(means)

    def step(pdf: pd.DataFrame) -> np.ndarray:
        rows = []
        for m in means:
            x = pdf[m.column].to_numpy(dtype=float)
            seen = int(np.isfinite(x).sum())
            fresh, zero = _ewm(x, m.alpha, np.nan), _ewm(x, m.alpha, 0.0)
            rows.append([(1 - m.alpha) ** seen, zero[-1], fresh[-1], seen])
        return np.array(rows).ravel()

    def combine(seed, vector):
        steps = vector.reshape(-1, 4)
        state = np.array([[0.0 if m.from_zero else np.nan, 0.0] for m in means]) if seed is None else seed.reshape(-1, 2)
        started = ~np.isnan(state[:, 0])
        value = np.where(started, steps[:, 0] * state[:, 0] + steps[:, 1], steps[:, 2])
        return np.column_stack([value, state[:, 1] + steps[:, 3]]).ravel()

    def replay(pdf, seed):
        state = np.array([[0.0 if m.from_zero else np.nan, 0.0] for m in means]) if seed is None else seed.reshape(-1, 2)
        result = {}
        for m, (start, seen) in zip(means, state, strict=True):
            x = pdf[m.column].to_numpy(dtype=float)
            value = _ewm(x, m.alpha, start)
            count = seen + np.cumsum(np.isfinite(x))
            result[m.out] = np.where(count >= max(m.minimum, 1), value, np.nan)
        return result

    outputs = [T.StructField(m.out, T.DoubleType()) for m in means]
    return chunk_scan(s, step, combine, replay, outputs, [m.column for m in means])


def recursive_means(df: DataFrame, means: Sequence[Mean], key="symbol", ts: str = "date",
                    size: int = CHUNK_ROWS, width: int | None = None) -> DataFrame:
    return means_on(Series.cut(df, 0, key, ts, size, width), means)


def ar1(df: DataFrame, column: str, memory: float, out: str, key="symbol", ts: str = "date",
        size: int = CHUNK_ROWS, width: int | None = None) -> DataFrame:
    """``L = (1-memory) * x + memory * L_before`` from ``L = 0``, over the rows where ``x`` exists."""
    smoothed = recursive_means(df, [Mean(out, column, 1 - memory, from_zero=True)], key, ts, size, width)
    return smoothed.withColumn(out, F.when(F.col(column).isNotNull(), F.col(out)))


def warmup_values(weight: float) -> int:
    """Values after which filters with different starts agree to the last digit: (1 - weight)^n < 1e-31."""
    return math.ceil(-31 * math.log(10) / math.log(1 - weight))


def _filter(values: np.ndarray, falling: float, rising: float, previous: float | None, needed: int) -> np.ndarray:
    """Filtered values. Stretches of at least ``needed`` values run side by side as columns, each after a warm-up of ``needed``
    values before it, which leaves nothing of its start."""
    n = len(values)
    width = max(needed, math.isqrt(n))
    lead = np.full(width, values[0] if n and previous is None else previous or 0.0)  # equal values keep the filter where it starts
    padded = np.concatenate([lead, values, np.zeros(-n % width)])
    columns = padded.reshape(-1, width).T
    state, result = columns[0, :-1].copy(), np.empty((width, columns.shape[1] - 1))
    for row in columns[:, :-1]:
        state += np.where(row < state, falling, rising) * (row - state)
    for k, row in enumerate(columns[:, 1:]):
        state += np.where(row < state, falling, rising) * (row - state)
        result[k] = state
    return result.T.ravel()[:n]


def asymmetric(df: DataFrame, column: str, out: str, falling: float = 0.55, rising: float = 0.25,
               key="symbol", ts: str = "date", size: int = CHUNK_ROWS, width: int | None = None) -> DataFrame:
    """Filter that follows falls faster than rises; starts at the first value, nulls give null and change nothing.

    Every value shrinks the influence of the start, so a chunk's step is just its last few hundred values.
    """
    needed = warmup_values(min(falling, rising))

    def known(pdf):
        x = pdf[column].to_numpy(dtype=float)
        return x, np.isfinite(x)

    def step(pdf):
        x, ok = known(pdf)
        return x[ok][-needed:]

    def combine(seed, vector):
        start = None if seed is None or not len(seed) else float(seed[0])
        values = _filter(vector, falling, rising, start, needed)
        return values[-1:] if len(values) else np.array([] if start is None else [start])

    def replay(pdf, seed):
        x, ok = known(pdf)
        result = np.full(len(x), np.nan)
        start = None if seed is None or not len(seed) else float(seed[0])
        result[ok] = _filter(x[ok], falling, rising, start, needed)
        return {out: result}

    s = Series.cut(df, 0, key, ts, size, width)
    return chunk_scan(s, step, combine, replay, [T.StructField(out, T.DoubleType())], [column])
