"""Shards by longest-processing-time scheduling: documents with equal texts stay together, and groups go by falling size to the
least loaded shard, which a heap names.

Groups of equal size are interchangeable, so the heap is fed with (size, how many) instead of single groups. Sizes count to DIGITS binary digits: those
below 65,536 are exact, larger ones share a level, at the mean of its groups, when they differ by less than 1 in 32,768. So the driver's schedule has at
most 65,536 rows and 32,768 for every doubling of the largest group beyond, whatever the number of documents. Ranks and slots are numbered by buckets of a hash, with
bucket counts summed up first, so that neither a size nor a shard is ever numbered in one task."""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quoteflow.llm.common import settle

#: bytes that a stored row takes beside its text
ROW_BYTES = 8
#: leading binary digits of a size that tell it from others
DIGITS = 16


def schedule(sizes: list[tuple[int, int]], shards: int) -> list[tuple[int, list[int]]]:
    """(size, count) pairs -> (size, groups that each shard gets), the same totals as handing out single groups, largest first."""
    heap = [(0, k) for k in range(shards)]
    plan = []
    for size, count in sorted(sizes, reverse=True):
        given = [0] * shards
        while count:
            if count >= shards and max(heap)[0] - heap[0][0] <= size:
                rounds = count // shards  # from here on each round serves every shard once
                heap = [(load + rounds * size, k) for load, k in heap]
                given = [g + rounds for g in given]
                count -= rounds * shards
                continue
            load, k = heapq.heappop(heap)
            until = heap[0][0] if heap else load + count * size
            take = min(count, max(1, -((load - until) // size)))
            given[k] += take
            count -= take
            heapq.heappush(heap, (load + take * size, k))
        plan.append((size, given))
    return plan


def _numbered(rows: DataFrame, within: str, bucket: Column, order: list[str], name: str) -> DataFrame:
    """Adds a gapless number from 0 within each value of a column."""
    rows = rows.withColumn("_bucket", bucket)
    before = W.partitionBy(within).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    counts = rows.groupBy(within, "_bucket").agg(F.count("*").alias("_n"))
    starts = counts.select(within, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = F.row_number().over(W.partitionBy(within, "_bucket").orderBy(*order)) - 1
    numbered = rows.withColumn("_own", own).join(starts, [within, "_bucket"])
    return numbered.withColumn(name, (F.col("_start") + F.col("_own")).cast("long")).drop("_bucket", "_own", "_start")


def assign(docs: DataFrame, shards: int = 24, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null under this law).

    Null text counts as the empty text (no bytes, checksum 0) and shares its group; repeated rows are rows of one group; null ids are
    ordinary; equal loads go to the lower shard; an empty table gives no rows; other columns are not read."""
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    slim = docs.select(F.col(id_column).alias("doc_id"), (F.octet_length(body) + ROW_BYTES).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.unhex(F.sha2(body, 256)).alias("key"))
    slim = settle(slim)
    grouped = settle(slim.groupBy("key").agg(F.sum("size").alias("weight"), F.count("*").alias("n")))
    shift = F.greatest(F.length(F.bin("weight")) - DIGITS, F.lit(0))
    grouped = grouped.withColumn("level", F.expr("shiftright(weight, greatest(length(bin(weight)) - DIGITS, 0))".replace("DIGITS", str(DIGITS))) * F.pow(F.lit(2.0), shift).cast("long"))
    histogram = grouped.groupBy("level").agg(F.count("*").alias("groups"), F.sum("weight").alias("bytes"), F.sum("n").alias("rows")).toArrow().to_pylist()
    histogram.sort(key=lambda h: -h["level"])
    rows = sum(h["rows"] for h in histogram)
    buckets = max(1, min(4096, rows // 2000))
    # a level's mean lies among its sizes, so the levels keep their order
    plan = schedule([(h["bytes"] // h["groups"], h["groups"]) for h in histogram], shards)
    ends = pa.table({"level": pa.array([h["level"] for h in histogram], pa.int64()), "given": pa.array([g for _, g in plan], pa.list_(pa.int64()))})
    plan_rows = spark.createDataFrame(ends) if plan else spark.createDataFrame([], "level long, given array<long>")
    ranked = _numbered(grouped.select("key", "level"), "level", F.pmod(F.xxhash64("key"), F.lit(buckets)), ["key"], "rank")
    state = F.struct(F.lit(0).alias("shard"), F.col("rank").alias("left"), F.lit(False).alias("found"))
    walk = F.aggregate(
        "given", state,
        lambda s, g: F.when(s["found"] | (s["left"] < g), F.struct(s["shard"].alias("shard"), s["left"].alias("left"), F.lit(True).alias("found")))
        .otherwise(F.struct((s["shard"] + 1).alias("shard"), (s["left"] - g).alias("left"), F.lit(False).alias("found"))),
    )
    placed = ranked.join(plan_rows, "level").select("key", walk["shard"].cast("int").alias("shard"))
    sharded = settle(slim.join(placed, "key"))
    slots = _numbered(sharded, "shard", F.pmod(F.xxhash64("key", "doc_id"), F.lit(buckets)), ["key", "doc_id"], "slot")
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
