"""Embedding near-duplicates: tiles of vectors, quantised to 8 bits, are multiplied; a rigorous bound on each vector's quantisation error
tells which pairs may reach the threshold, and only those are computed again in double precision.

Equal vectors are one row with a count. The distinct ones are dealt into G blocks by hash, and each pair of blocks is one cell, so every pair of vectors meets
in exactly one cell. A cell multiplies tile by tile and returns one row a member, never its pairs. G grows with the number of vectors, so that a
cell stays bounded; the work is that of all pairs, which an exact answer for arbitrary vectors needs."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoteflow.llm.common import Forest, settle
from quoteflow.llm.graph import components

#: vectors of a block at most, on average; blocks of small inputs; rows of a tile; pairs recomputed at once
BLOCK, LEAST_BLOCKS, TILE, PAIRS = 16_384, 6, 1024, 1 << 16


def _pack(column: pa.Array) -> pa.Array:
    """Each vector's components as little-endian doubles; null for vectors that cannot link: null, empty, zero, or with a null or non-finite component."""
    out = []
    for row in column:
        values = row.values
        if values is None or not len(values) or values.null_count:
            out.append(None)
            continue
        x = values.to_numpy(zero_copy_only=False).astype("<f8") + 0.0
        out.append(x.tobytes() if np.isfinite(x).all() and x.any() else None)
    return pa.array(out, pa.binary())


class _Side:
    """Vectors of one block: units in double precision, whole numbers -127..127 (exact in single precision products), scales and error bounds."""

    def __init__(self, packed: list[bytes]):
        x = np.frombuffer(b"".join(packed), "<f8").reshape(len(packed), -1)
        x = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square over- or underflows
        self.unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
        self.scale = np.abs(self.unit).max(axis=1) / 127
        self.whole = np.rint(self.unit / self.scale[:, None]).astype(np.float32)
        kept = self.whole * self.scale[:, None]
        self.error = np.sqrt(((self.unit - kept) ** 2).sum(axis=1)) + 1e-12
        self.length = np.sqrt((kept**2).sum(axis=1)) + 1e-12


def tile_pairs(a: _Side, b: _Side, threshold: float, same: bool):
    """(left, right) arrays of the pairs with cosine >= threshold, tile by tile; same: both sides are one block, and left < right.

    |x.y - s_x s_y <q_x, q_y>| <= |s_x q_x| e_y + e_x, where e is the distance of a unit vector to its quantised form. Dimensions up to 1024 keep the
    products of whole numbers below 2^24, where single precision is exact; above, slack is added for rounding."""
    slack = 1e-9 + (0 if a.whole.shape[1] <= 1024 else a.whole.shape[1] * 2.0**-23)
    for i in range(0, len(a.unit), TILE):
        rows = slice(i, i + TILE)
        for j in range(i if same else 0, len(b.unit), TILE):
            columns = slice(j, j + TILE)
            product = a.whole[rows] @ b.whole[columns].T
            floor = (threshold - slack - a.error[rows] - a.length[rows] * b.error[columns].max()) / a.scale[rows]
            left, right = np.nonzero(product * b.scale[columns].astype(np.float32)[None, :] >= (floor * (1 - 1e-6) - 1e-6).astype(np.float32)[:, None])
            estimate = product[left, right].astype(np.float64) * a.scale[rows][left] * b.scale[columns][right]
            left, right = left + i, right + j
            if same:
                upper = left < right
                left, right, estimate = left[upper], right[upper], estimate[upper]
            bound = a.length[left] * b.error[right] + a.error[left] + slack
            sure = estimate - bound >= threshold
            linked = [(left[sure], right[sure])]
            open_ = np.flatnonzero(~sure & (estimate + bound >= threshold))
            for k in range(0, len(open_), PAIRS):
                at = open_[k : k + PAIRS]
                exact = np.einsum("ij,ij->i", a.unit[left[at]], b.unit[right[at]])
                linked.append((left[at][exact >= threshold], right[at][exact >= threshold]))
            yield tuple(np.concatenate(x) for x in zip(*linked))


def _cell(threshold: float):
    schema = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def run(key: tuple, members: pa.Table) -> pa.Table:
        first, second = key[1].as_py(), key[2].as_py()
        own = members.column("own").to_numpy()
        nodes, copies = members.column("node").to_numpy(), members.column("copies").to_numpy()
        packed = members.column("packed").to_pylist()
        at_a, at_b = np.flatnonzero(own == first), np.flatnonzero(own == second)
        if not len(at_a) or not len(at_b):
            return schema.empty_table()
        a = _Side([packed[k] for k in at_a])
        b = a if first == second else _Side([packed[k] for k in at_b])
        links, forest = np.zeros(len(nodes), dtype=np.int64), Forest(len(nodes))
        for left, right in tile_pairs(a, b, threshold, first == second):
            if len(left):
                left, right = at_a[left], at_b[right]
                np.add.at(links, left, copies[right])
                np.add.at(links, right, copies[left])
                forest.link(left, right)
        hit = np.flatnonzero(links)
        return pa.table([nodes[hit], links[hit], nodes[forest.label[hit]]], schema=schema)

    return run, "node long, links long, root long"


def near_duplicates(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", threshold: float = 0.9, block: int = BLOCK) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do vectors of different length. Repeated rows are
    vectors of their own and link with each other. A null id never names a component unless all its ids are null, and is not kept. An empty table
    gives no rows; other columns are not read. threshold must be above 0."""
    kind = vectors.schema[id_column].dataType.simpleString()

    def pack(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _pack(batch.column(1))], names=["id", "packed"])

    rows = settle(vectors.select(F.col(id_column), F.col(vector)).mapInArrow(pack, f"id {kind}, packed binary"))
    valid = rows.where("packed IS NOT NULL")
    reps = valid.groupBy("packed").agg(F.count("*").alias("copies"), F.min("id").alias("low"))
    reps = settle(reps.withColumn("node", F.monotonically_increasing_id()))
    blocks = max(LEAST_BLOCKS, math.ceil(reps.count() / block))
    dealt = reps.select("node", "packed", "copies", F.octet_length("packed").alias("size"), F.pmod(F.xxhash64("packed"), F.lit(blocks)).cast("int").alias("own"))
    cells = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    cells = cells.select("node", "packed", "copies", "own", "size", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    work, schema = _cell(threshold)
    found = settle(cells.groupBy("size", "i", "j").applyInArrow(work, schema))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("src"), F.col("root").alias("dst")))
    placed = reps.join(links, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed = settle(placed.select("packed", "low", "root", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")))
    smallest = placed.groupBy("root").agg(F.min("low").alias("component"))
    answer = placed.join(smallest, "root").select("packed", "links", "component")
    joined = rows.join(answer, "packed", "left").select(F.col("id").alias("vec_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("packed").isNull(), F.col("id")).otherwise(F.col("component")).alias("component_id"))
    return joined.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
