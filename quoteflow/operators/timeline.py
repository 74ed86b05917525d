"""Cutting a keyed series into overlapping chunks.

A window partitioned by key alone puts the whole history of a key into one task. When one key holds
a large share of the rows that task never ends, so every ordered operator here works on *chunks*: a
key's rows are cut at time-bucket edges into runs of about ``size`` rows, and each chunk also receives
copies of the last ``halo`` rows before it. A frame that looks back at most ``halo`` rows is then exact
inside its chunk. Running aggregates add one small table with a row per chunk.

The cut depends only on the data (time bucket and row counts), never on task order, so a lost executor
recomputes the same chunks. There is one path for every size: a short key is a key with one chunk, and no job runs before the
action.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK = "_chunk"  # chunk a row is computed in
OWN = "_own"  # false for copies lent to a neighbouring chunk
SUCC = "_succ"  # the key's next non-empty chunk, null in the last
PRED = "_pred"  # the key's previous non-empty chunk, null in the first
FROM, TO = "_from", "_to"  # range of chunks that need the row
BUCKET = "_bucket"
PLACEMENT = (CHUNK, SUCC, PRED, FROM, TO)

CHUNK_ROWS = 16384
DATE_WIDTH = 128  # days per bucket of a DATE series
TIME_WIDTH = 3600  # seconds per bucket of a TIMESTAMP series


def as_list(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def time_bucket(df: DataFrame, ts: str, width: int | None) -> Column:
    """Fixed-width time bucket of ``ts``: days for dates, seconds for timestamps, units for integers."""
    kind = df.schema[ts].dataType
    if isinstance(kind, T.DateType):
        return F.floor(F.unix_date(F.col(ts)) / (width or DATE_WIDTH))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / (width or TIME_WIDTH))
    return F.floor(F.col(ts) / (width or CHUNK_ROWS))


def bucket_layout(df: DataFrame, key, ts: str, halo: int = 0, ahead: int = 0, size: int = CHUNK_ROWS,
                  width: int | None = None) -> DataFrame:
    """One row per (key, bucket): first position, key total, chunk and the chunks that need the bucket's rows.

    Windows by key are safe on this table: it holds a row per time bucket, not per input row.
    """
    keys = as_list(key)
    counts = df.groupBy(*keys, time_bucket(df, ts, width).alias(BUCKET)).agg(F.count(F.lit(1)).alias("_n"))
    by_key = Window.partitionBy(*keys).orderBy(BUCKET)
    table = counts.withColumn("_end", F.sum("_n").over(by_key.rowsBetween(Window.unboundedPreceding, 0)))
    table = table.withColumn("_start", F.col("_end") - F.col("_n"))
    table = table.withColumn(CHUNK, F.floor(F.col("_start") / size))
    table = table.withColumns({
        "_next": F.lead(CHUNK).over(by_key),
        "_prev": F.lag(CHUNK).over(by_key),
        "_total": F.sum("_n").over(Window.partitionBy(*keys)),
    })
    in_chunk = Window.partitionBy(*keys, CHUNK)
    table = table.withColumns({
        SUCC: F.min(F.when(F.col("_next") > F.col(CHUNK), F.col("_next"))).over(in_chunk),
        PRED: F.max(F.when(F.col("_prev") < F.col(CHUNK), F.col("_prev"))).over(in_chunk),
    })
    first, last = F.col(CHUNK), F.col(CHUNK)
    if halo > 0:  # later chunks that start fewer than halo rows after this bucket ends
        reach = Window.partitionBy(*keys).orderBy("_end").rangeBetween(0, halo - 1)
        last = F.coalesce(F.max("_next").over(reach), last)
    if ahead > 0:  # earlier chunks that end fewer than ahead rows before this bucket starts
        reach = Window.partitionBy(*keys).orderBy("_start").rangeBetween(-(ahead - 1), 0)
        first = F.coalesce(F.min("_prev").over(reach), first)
    table = table.withColumns({TO: last, FROM: first})
    return table.select(*keys, BUCKET, CHUNK, SUCC, PRED, FROM, TO, "_start", "_total")


def place(df: DataFrame, halo: int = 0, ahead: int = 0, key="symbol", ts: str = "date", size: int = CHUNK_ROWS,
          width: int | None = None) -> DataFrame:
    """Add the placement columns, so that the operators called on the result need not count the rows again.

    ``halo``/``ahead`` must cover the longest look-back/look-ahead of any of them. Columns may be added in between;
    scans and running aggregates also accept a subset of the rows, windows need them all. :func:`unplace` ends the
    sequence. Keys and ``ts`` must be non-null.
    """
    keys = as_list(key)
    size = max(size, halo, ahead, 1)
    layout = bucket_layout(df, keys, ts, halo, ahead, size, width).drop("_start", "_total")
    return df.withColumn(BUCKET, time_bucket(df, ts, width)).join(layout, [*keys, BUCKET]).drop(BUCKET)


def placement_of(df: DataFrame) -> list[str]:
    return [c for c in PLACEMENT if c in df.columns]


def unplace(df: DataFrame) -> DataFrame:
    return df.drop(*PLACEMENT)


def whole_placement(pdf: pd.DataFrame) -> pd.DataFrame:
    """Placement ids are whole numbers or missing; pandas would read the latter as floats."""
    return pdf.astype({c: "Int64" for c in (SUCC, PRED) if c in pdf.columns})


class Series:
    """Rows cut into chunks, with window specs that stay inside a chunk."""

    def __init__(self, frame: DataFrame, keys: list[str], order: list[str], placed: bool = False):
        self.frame, self.keys, self.order, self.placed = frame, keys, order, placed
        self._pending: dict[str, tuple[str, Column]] = {}

    @classmethod
    def cut(cls, df: DataFrame, halo: int = 0, key="symbol", ts: str = "date", size: int = CHUNK_ROWS,
            width: int | None = None, order: Sequence[str] = (), ahead: int = 0) -> Series:
        """Cut ``df`` (reusing its placement if it has one); ``order`` breaks ties of ``ts``."""
        keys = as_list(key)
        placed = CHUNK in df.columns
        rows = df if placed else place(df, halo, ahead, keys, ts, size, width)
        if halo or ahead:
            rows = rows.withColumn("_at", F.explode(F.sequence(FROM, TO)))
            rows = rows.withColumn(OWN, F.col("_at") == F.col(CHUNK)).withColumn(CHUNK, F.col("_at")).drop("_at")
        else:
            rows = rows.withColumn(OWN, F.lit(True))
        return cls(rows, keys, [ts, *order], placed)

    @property
    def parts(self) -> list[str]:
        """Columns that identify a chunk."""
        return [*self.keys, CHUNK]

    def window(self, reverse: bool = False) -> WindowSpec:
        order = [F.col(c).desc() for c in self.order] if reverse else self.order
        return Window.partitionBy(*self.parts).orderBy(*order)

    def rows(self, start: int, end: int = 0) -> WindowSpec:
        return self.window().rowsBetween(start, end)

    def last(self, k: int) -> WindowSpec:
        """The current row and the k-1 rows before it."""
        return self.rows(-(k - 1), 0)

    def using(self, frame: DataFrame) -> Series:
        return Series(frame, self.keys, self.order, self.placed)

    def let(self, windowed: Column) -> Column:
        """Name a window expression: each distinct one is evaluated once, by the next :meth:`add`.

        The optimizer does not merge equal window expressions, and formulas use the same one several times.
        """
        name = self._pending.setdefault(str(windowed), (f"_w{len(self._pending)}", windowed))[0]
        return F.col(name)

    def add(self, **columns: Column) -> Series:
        named = dict(self._pending.values())
        self._pending = {}
        frame = self.frame.withColumns(named) if named else self.frame
        return self.using(frame.withColumns(columns).drop(*named))

    def done(self, *drop: str) -> DataFrame:
        """Own rows only; the placement stays if the input came with one."""
        rows = self.frame.where(OWN).drop(OWN, *drop)
        return rows if self.placed else unplace(rows)


def positions(df: DataFrame, key="symbol", ts: str = "date", width: int | None = None,
              order: Sequence[str] = (), pos: str = "pos", total: str | None = "n") -> DataFrame:
    """1-based row position within each key (and the key's row count) without a whole-key window."""
    keys = as_list(key)
    layout = bucket_layout(df, keys, ts, width=width)
    placed = df.withColumn(BUCKET, time_bucket(df, ts, width)).join(
        layout.select(*keys, BUCKET, "_start", "_total"), [*keys, BUCKET]
    )
    inside = Window.partitionBy(*keys, BUCKET).orderBy(ts, *order)
    placed = placed.withColumn(pos, F.row_number().over(inside) + F.col("_start"))
    if total:
        placed = placed.withColumn(total, F.col("_total"))
    return placed.drop(BUCKET, "_start", "_total")


def last_rows(df: DataFrame, n: int, key="symbol", ts: str = "date", width: int | None = None,
              order: Sequence[str] = ()) -> DataFrame:
    """Last ``n`` rows per key (0 = all); buckets that end before them are dropped before any sort."""
    if n == 0:
        return df
    keys = as_list(key)
    layout = bucket_layout(df, keys, ts, width=width)
    by_key = Window.partitionBy(*keys).orderBy(BUCKET)
    ends = layout.withColumn("_stop", F.coalesce(F.lead("_start").over(by_key), F.col("_total")))
    wanted = ends.where(F.col("_stop") > F.col("_total") - n)
    placed = df.withColumn(BUCKET, time_bucket(df, ts, width)).join(
        wanted.select(*keys, BUCKET, "_start", "_total"), [*keys, BUCKET]
    )
    inside = Window.partitionBy(*keys, BUCKET).orderBy(ts, *order)
    placed = placed.withColumn("_pos", F.row_number().over(inside) + F.col("_start"))
    return placed.where(F.col("_pos") > F.col("_total") - n).drop(BUCKET, "_start", "_total", "_pos")


def _combine(kind: str, carry: Column, own: Column) -> Column:
    if kind in ("sum", "count"):
        return F.when(carry.isNull(), own).when(own.isNull(), carry).otherwise(carry + own)
    if kind == "product":
        return F.coalesce(carry, F.lit(1.0)) * F.coalesce(own, F.lit(1.0))
    if kind == "max":
        return F.greatest(carry, own)
    if kind == "min":
        return F.least(carry, own)
    if kind == "last":
        return F.coalesce(own, carry)
    if kind == "first":
        return F.coalesce(carry, own)
    raise ValueError(f"unknown running aggregate {kind}")


def _aggregate(kind: str, column: Column) -> Column:
    return {
        "sum": F.sum, "count": F.count, "product": F.product, "max": F.max, "min": F.min,
        "last": lambda c: F.last(c, ignorenulls=True), "first": lambda c: F.first(c, ignorenulls=True),
    }[kind](column)


def running_on(s: Series, reverse: bool = False, exclusive: bool = False, **specs: tuple[str, Column]) -> Series:
    """Running aggregates (row included) from the start of each key over an already cut series.

    ``specs`` maps an output name to (kind, column), kind in sum, count, product, max, min, last, first;
    the last two skip nulls. ``reverse`` runs from the end of each key, ``exclusive`` leaves the row itself out. Chunk totals are combined on a table
    with one row per chunk.
    """
    frame = s.frame.withColumns({f"_x_{name}": column for name, (_, column) in specs.items()})
    inside = s.window(reverse).rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    own = {n: _aggregate(k, F.when(F.col(OWN), F.col(f"_x_{n}"))).over(inside) for n, (k, _) in specs.items()}
    scratch = [f"_x_{n}" for n in specs]
    totals = []
    for name, (kind, _) in specs.items():
        value = F.col(f"_x_{name}")
        if kind in ("last", "first"):
            pick = F.max_by if (kind == "last") != reverse else F.min_by
            totals.append(pick(value, F.when(value.isNotNull(), F.struct(*s.order))).alias(f"_c_{name}"))
        else:
            totals.append(_aggregate(kind, value).alias(f"_c_{name}"))
    cut_keys = frame.where(F.col(OWN) & (F.col(SUCC).isNotNull() | F.col(PRED).isNotNull()))
    chunks = cut_keys.groupBy(*s.keys, CHUNK).agg(*totals)
    direction = F.col(CHUNK).desc() if reverse else F.col(CHUNK)
    before = Window.partitionBy(*s.keys).orderBy(direction).rowsBetween(Window.unboundedPreceding, -1)
    carries = chunks.select(
        *s.keys, CHUNK,
        *[_aggregate("sum" if kind == "count" else kind, F.col(f"_c_{name}")).over(before).alias(f"_k_{name}")
          for name, (kind, _) in specs.items()],
    )
    joined = frame.join(carries, [*s.keys, CHUNK], "left").withColumns(own)
    outputs = {n: _combine(kind, F.col(f"_k_{n}"), F.col(n)) for n, (kind, _) in specs.items()}
    return s.using(joined.withColumns(outputs).drop(*scratch, *[f"_k_{n}" for n in specs]))


def running(df: DataFrame, key="symbol", ts: str = "date", size: int = CHUNK_ROWS, width: int | None = None,
            order: Sequence[str] = (), **specs: tuple[str, Column]) -> DataFrame:
    """:func:`running_on` for a plain DataFrame."""
    return running_on(Series.cut(df, 0, key, ts, size, width, order), **specs).done()
