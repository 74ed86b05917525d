"""Top-k with budgets, grid argmax, pages, retention, and set operations on series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quoteflow.operators.timeline import as_list, positions


def page(df: DataFrame, n: int, k: int, *order) -> DataFrame:
    """Page ``n`` (from 1) of ``k`` rows."""
    return df.orderBy(*order).offset((n - 1) * k).limit(k)


def budgeted_topk(cands: DataFrame, accounts: DataFrame, key: str = "date", slots: str = "slots") -> DataFrame:
    """Accept candidates in (priority, symbol) order while cash and slots last, one decision per ``key``.

    ``cands``: key, symbol, priority, is_new. ``accounts``: key, cash, reserve, budget, slots (free slots). A rejected
    name uses neither, so dropping new names beyond the free slots first and then cutting at the affordable count is
    the same as the one-by-one walk. Ranks come from chunked positions, so one decision may have any number of names.
    """
    ordered = positions(_sequence(cands.where("is_new")), key, "_p", width=1, order=["_order"], pos="_new", total=None).drop("_p", "_order")
    olds = cands.where(~F.col("is_new")).withColumn("_new", F.lit(0).cast("bigint"))
    joined = ordered.select(*olds.columns).unionByName(olds).join(accounts, key)
    fits = joined.where(F.col("_new") <= F.col(slots)).drop("_new")
    ranked = positions(_sequence(fits), key, "_p", width=1, order=["_order"], pos="_rank", total=None).drop("_p", "_order")
    affordable = F.floor((F.col("cash") - F.col("reserve") + 1e-9) / F.col("budget"))
    return ranked.where(F.col("_rank") <= affordable).withColumnRenamed("_rank", "accepted_rank")


def _sequence(df: DataFrame) -> DataFrame:
    """Coarse step of the priority to bucket by, and the full order inside a step."""
    return df.withColumns({"_p": F.floor(F.col("priority") * 16), "_order": F.struct("priority", "symbol")})


def argmax_first(df: DataFrame, value: str, ties: Sequence, key="symbol") -> DataFrame:
    """Best row per key; ``ties`` (smallest wins) stand for the order the grid is walked in."""
    keys = as_list(key)
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct((-F.col(value)).alias("v"), *ties)).alias("_row")
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(best).select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def retain(files: DataFrame, newest: int = 7, weeks: int = 3, stamp: str = "date") -> DataFrame:
    """Backups to keep: the newest ones, and the newest of each of the latest ISO weeks."""
    days = files.select(stamp).distinct()  # one row per backup day
    w = Window.orderBy(F.col(stamp).desc())
    ranked = days.withColumns({"_n": F.row_number().over(w), "_week": F.date_trunc("week", stamp)})
    weekly = ranked.groupBy("_week").agg(F.max(stamp).alias(stamp)).withColumn(
        "_w", F.row_number().over(Window.orderBy(F.col("_week").desc()))
    )
    return ranked.where(F.col("_n") <= newest).select(stamp).union(weekly.where(F.col("_w") <= weeks).select(stamp)).distinct()


def union_newer(base: DataFrame, fresh: DataFrame, key="symbol", ts: str = "date") -> DataFrame:
    """Base rows plus strictly newer rows of each key (all rows of a key the base does not have)."""
    keys = as_list(key)
    ends = base.groupBy(*keys).agg(F.max(ts).alias("_end"))
    newer = fresh.join(ends, keys, "left").where(F.col("_end").isNull() | (F.col(ts) > F.col("_end"))).drop("_end")
    return base.unionByName(newer)


def intersect_dates(frames: Sequence[DataFrame], ts: str = "date") -> DataFrame:
    """Dates present in every frame: one aggregation over tagged dates instead of a chain of joins."""
    tagged = [f.select(ts).distinct().withColumn("_tag", F.lit(i)) for i, f in enumerate(frames)]
    rows = tagged[0]
    for other in tagged[1:]:
        rows = rows.unionByName(other)
    return rows.groupBy(ts).agg(F.count_distinct("_tag").alias("_n")).where(F.col("_n") == len(frames)).select(ts)


def difference(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    """Keys of ``a`` that ``b`` does not have."""
    return a.select(*on).distinct().join(b.select(*on), list(on), "left_anti")


def ordered_union(lists: Sequence[DataFrame], column: str = "symbol", position: str = "position") -> DataFrame:
    """Distinct union that keeps each value's first place (list number, position)."""
    rows = None
    for i, part in enumerate(lists):
        tagged = part.select(column, F.struct(F.lit(i).alias("list_no"), F.col(position).cast("bigint").alias("position")).alias("_place"))
        rows = tagged if rows is None else rows.unionByName(tagged)
    return rows.groupBy(column).agg(F.min("_place").alias("_p")).select(column, "_p.list_no", "_p.position")
