"""How filters interact: what each removes at each place of every order, and its Shapley share of all removals.

One pass gives every document five bits, bit i for failing filter i. Per part, the documents are counted by their bits, so a coalition S of filters
removes v(S) = the documents with any of its bits. All 32 coalitions are tabulated; a filter's step is a difference of two of them, and the Shapley
shares are the exact solution of the kernel-weighted least squares fit of an additive game under sum(shares) = v(all), in rationals."""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from itertools import permutations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FILTERS = "ABCDE"
_BLANKS = "[ \\t-\\r]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def text_failures(text: Column) -> list[Column]:
    """Filters A to D of one text (null: empty): few words, repeated words, capitals, symbols."""
    body = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(body, _BLANKS), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(body) - F.length(F.translate(body, _UPPER, ""))
    return [n < 100, 100 * distinct.cast("long") < 80 * n.cast("long"), 100 * capitals.cast("long") > 10 * F.length(body).cast("long"), body.rlike("[#$%&*|]")]


def failures(docs: DataFrame, labels: DataFrame, part: str = "lang", id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """part, mask, n, good, toxic: how many documents of a part fail exactly the filters of a mask, and how many of them are good and toxic.

    The texts leave the first stage as digests. A copy is told by its text's digest: of the rows of one text, those of the smallest id pass E. Rows are
    added up by text, part, bits and labels before they are dealt, so a text, part or id that holds a third of the rows is a few rows to any task."""
    bits = sum(F.when(f, 1 << i).otherwise(0) for i, f in enumerate(text_failures(F.col(text))))
    slim = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(part), F.lit("")).alias("part"), F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).alias("digest"), bits.alias("bits"))
    slim = slim.groupBy("id", "part", "digest", "bits").agg(F.count("*").alias("n"))
    marks = labels.groupBy(F.col("doc_id").alias("_id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    known = slim.join(marks, F.col("id") == F.col("_id"), "left")
    known = known.select("id", "part", "digest", "bits", "n", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    # a row an id and kind is left, so the smallest (id, n) carries the rows at the smallest id
    kinds = known.groupBy("digest", "part", "bits", "good", "toxic").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("unnamed"), F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("least")
    )
    first = kinds.groupBy("digest").agg(F.min("least.id").alias("first"))
    kinds = kinds.join(first, "digest")
    passing = F.col("unnamed") + F.when(F.col("least.id") == F.col("first"), F.col("least.n")).otherwise(0)
    split = kinds.select("part", "good", "toxic", F.explode(F.array(F.struct(F.col("bits").alias("mask"), passing.alias("n")), F.struct((F.col("bits") + 16).alias("mask"), (F.col("n") - passing).alias("n")))).alias("c"))
    held = lambda flag: F.sum(F.when(F.col(flag), F.col("c.n")).otherwise(0)).alias(flag)
    return split.groupBy("part", F.col("c.mask").alias("mask")).agg(F.sum("c.n").alias("n"), held("good"), held("toxic"))


def coalitions(counts: list[int], players: int) -> list[int]:
    """counts[mask] of documents with exactly these bits -> v[S], the documents with any bit of S, for every S."""
    outside = list(counts)  # becomes: documents all of whose bits lie in S
    for i in range(players):
        for s in range(1 << players):
            if s >> i & 1:
                outside[s] += outside[s ^ (1 << i)]
    everything = outside[-1]
    return [everything - outside[((1 << players) - 1) ^ s] for s in range(1 << players)]


def kernel_shares(v: list[int], players: int) -> list[Fraction]:
    """Shapley shares of the game v (v[0] = 0): minimise sum over proper coalitions of weight * (v(S) - sum of shares in S)^2 under sum(shares) = v(all).

    The weights (players - 1) / (C(players, s) * s * (players - s)) are those for which the minimiser is the Shapley value. The normal equations with
    one multiplier for the constraint are solved by elimination in rationals, so the result is exact."""
    if players == 1:
        return [Fraction(v[1])]
    size = players + 1
    rows = [[Fraction(0)] * (size + 1) for _ in range(size)]
    for s in range(1, (1 << players) - 1):
        inside = [i for i in range(players) if s >> i & 1]
        weight = Fraction(players - 1, math.comb(players, len(inside)) * len(inside) * (players - len(inside)))
        for i in inside:
            rows[i][size] += weight * v[s]
            for j in inside:
                rows[i][j] += weight
    for i in range(players):
        rows[i][players] = rows[players][i] = Fraction(1)
    rows[players][size] = Fraction(v[-1])
    for c in range(size):
        pivot = next(r for r in range(c, size) if rows[r][c])
        rows[c], rows[pivot] = rows[pivot], rows[c]
        rows[c] = [x / rows[c][c] for x in rows[c]]
        for r in range(size):
            if r != c and rows[r][c]:
                rows[r] = [x - rows[r][c] * y for x, y in zip(rows[r], rows[c])]
    return [rows[i][size] for i in range(players)]


def steps(all_docs: list[int], good: list[int], toxic: list[int], names: str = FILTERS) -> Iterator[tuple]:
    """(order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for all orders; the inputs are counts by mask."""
    players = len(names)
    total, everyone = sum(all_docs), (1 << players) - 1
    v, v_good, v_toxic = (coalitions(c, players) for c in (all_docs, good, toxic))
    share = [int(x * math.factorial(players)) for x in kernel_shares(v, players)]
    for order in permutations(range(players)):
        before = 0
        for step, i in enumerate(order, 1):
            after = before | 1 << i
            removed = v[after] - v[before]
            yield (
                "".join(names[k] for k in order), step, total - v[after], removed, v[1 << i] - removed, v[everyone] - v[everyone ^ 1 << i],
                v_good[after] - v_good[before], v_toxic[after] - v_toxic[before], share[i],
            )
            before = after


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang", id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: 600 rows per part.

    Null and empty texts are the same text without words; a null part is the empty string; a row without an id has no smaller ids and is no smaller id
    of another; of repeated ids all rows of the smallest id of a text pass E; of repeated labels any 1 counts, null and missing labels are 0; an empty
    table gives no rows; other columns are not read. Every part is a group of at most 32 rows when its games are solved."""
    by_mask = failures(docs, labels, part, id_column, text)
    tables = by_mask.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("rows"))
    fields = [T.StructField("filter_order", T.StringType()), T.StructField("step", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in _COUNTS]]

    @F.pandas_udf(T.ArrayType(T.StructType(fields)))
    def played(parts: pd.Series) -> pd.Series:
        out = []
        for rows in parts:
            counts = [[0] * 32 for _ in range(3)]
            for r in rows:
                for table, name in zip(counts, ("n", "good", "toxic")):
                    table[r["mask"]] += int(r[name])
            out.append([dict(zip(("filter_order", "step", *_COUNTS), s)) for s in steps(*counts)])
        return pd.Series(out)

    return tables.select("part", F.explode(played("rows")).alias("s")).select("part", "s.*")
