"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint has 64 bits over hashed word shingles. Bit position i carries a vector phi(i) of r + 1 bits, and every non-zero
vector v of r + 1 bits makes one table whose mask holds the positions with odd <v, phi(i)>. Two fingerprints that differ in at
most r positions span at most r dimensions, so some v is orthogonal to all of them: that table's masked values are equal. With
r = 3 these 15 tables find every pair, whatever the data; nothing is capped.

Three of 64 bits are less than what most near copies differ in, and tables for more would hold few bits each. So removal (`one_of_each`) links texts of a
likeness of 0.8 or more by five-word shingles besides: rows of permuted minima name candidates, each is compared with one text of its bucket, and only
pairs whose exact likeness suffices are links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoteflow.llm.common import Forest, packed, settle, shared_path, small_batches, unpacked
from quoteflow.llm.graph import components

BITS, SEED, SHINGLE = 64, 42, 3
#: bits counted at once, so that a very long text needs bounded memory
_ROWS = 1 << 16
#: members of a cell; larger buckets are dealt out as pairs of chunks of this size
CELL = 2048
#: words of a shingle and least likeness by which removal links texts; minima that make a bucket, and buckets of a text
WORDS, LIKENESS = 5, 0.8
PER_BUCKET, BUCKETS = 5, 14
#: fingerprints that are broadcast at most
ASKED = 500_000
#: odd factors and summands of the permutations
_MIX = np.random.default_rng(SEED).integers(1, 1 << 63, size=(2, PER_BUCKET * BUCKETS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def fingerprint(text: bytes, words: int = SHINGLE) -> int:
    """Majority bits of the shingle hashes, as unsigned 64 bits; no words give 0, fewer than a shingle hash as they are."""
    found = text.lower().split()  # on bytes: A-Z only, and exactly the six blanks of the contract
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= words:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = [0, *ends[: len(found) - words].tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist())], dtype="<u8")
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), _ROWS):
        part = hashes[at : at + _ROWS].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, text: str = "text", name: str = "simhash") -> DataFrame:
    """All rows and columns of docs and a long column that holds the fingerprint's 64 bits. Null text counts as empty."""

    @F.pandas_udf("long")
    def of(values):
        return values.map(lambda t: np.uint64(fingerprint(t.encode() if isinstance(t, str) else b"")).astype(np.int64)).astype("int64")

    return small_batches(docs).withColumn(name, of(F.col(text)))


def masks(radius: int = 3, bits: int = BITS) -> list[int]:
    """The covering masks: 2^(radius+1) - 1 of them."""
    vectors = range(1, 2 ** (radius + 1))
    return [sum(1 << i for i in range(bits) if ((v & (1 + i % len(vectors))).bit_count() & 1)) for v in vectors]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _reach(values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(member, seed) positions of a cell's components: searched outward from a seed in blocks, each member compared once."""
    left, members, seeds = np.arange(len(values)), [], []
    while len(left) > 1:
        seed, front, left = left[0], left[:1], left[1:]
        while len(front) and len(left):
            block, front = front[:256], front[256:]
            near = (np.bitwise_count(values[block][:, None] ^ values[left][None, :]) <= radius).any(axis=0)
            members.append(left[near])
            seeds.append(np.full(int(near.sum()), seed))
            front, left = np.concatenate([front, left[near]]), left[~near]
    none = np.empty(0, dtype=np.int64)
    return np.concatenate(members or [none]), np.concatenate(seeds or [none])


def _links(cells: np.ndarray, values: np.ndarray, radius: int, small: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Links that join up the members of each cell; cells: run numbers of equal cells, ascending. One link a member at most."""
    n = len(values)
    starts = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])
    sizes = np.diff(np.r_[starts, n])
    ends = np.repeat(starts + sizes, sizes)
    forest = Forest(n)
    at = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= small), sizes))
    for lag in range(1, small):
        at = at[at + lag < ends[at]]
        if not len(at):
            break
        near = np.bitwise_count(values[at] ^ values[at + lag]) <= radius
        forest.link(at[near], at[near] + lag)
    for group in np.flatnonzero(sizes > small):
        a = starts[group]
        member, seed = _reach(values[a : a + sizes[group]], radius)
        forest.link(member + a, seed + a)
    moved = np.flatnonzero(forest.label != np.arange(n))
    return values[moved], values[forest.label[moved]]


def _cell_links(radius: int):
    """Reads rows sorted by cell as a stream; holds one batch and the cell that runs over its end."""
    keys = ("t", "key", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            part = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in (*keys, "fp")}
            kept = part if kept is None else {k: np.concatenate([kept[k], part[k]]) for k in part}
            change = np.zeros(len(kept["fp"]), dtype=bool)
            for k in keys:
                change[1:] |= kept[k][1:] != kept[k][:-1]
            edge = np.flatnonzero(change)
            if not len(edge):
                continue
            cut = edge[-1]
            a, b = _links(np.cumsum(change[:cut]), kept["fp"][:cut].view(np.uint64), radius)
            kept = {k: v[cut:] for k, v in kept.items()}
            yield pa.record_batch({"src": a.view(np.int64), "dst": b.view(np.int64)})
        if kept is not None and len(kept["fp"]):
            a, b = _links(np.zeros(len(kept["fp"]), dtype=np.int64), kept["fp"].view(np.uint64), radius)
            yield pa.record_batch({"src": a.view(np.int64), "dst": b.view(np.int64)})

    return run


def near_links(fingerprints: DataFrame, radius: int = 3, cell: int = CELL) -> DataFrame:
    """Distinct fp -> (src, dst) links with the same components as all pairs within the radius; no bucket emits its pairs.

    Rows of a table and key meet in one cell; a bucket over `cell` members is cut into chunks by hash, and each pair of chunks is a cell
    of its own, so that no task gets a bucket whole."""
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(_signed(m)).alias("m")) for t, m in enumerate(masks(radius))])
    keyed = fingerprints.select("fp", F.explode(tables).alias("c")).select("fp", F.col("c.t").alias("t"), F.col("fp").bitwiseAND(F.col("c.m")).alias("key"))
    large = keyed.groupBy("t", "key").count().where(F.col("count") > cell)
    large = large.select("t", "key", F.ceil(F.col("count") / cell).cast("int").alias("chunks"))
    chunk = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("chunks") - 1, F.lit(0)))).alias("o")
    cells = keyed.join(large, ["t", "key"], "left").select("t", "key", "fp", F.coalesce(chunk, F.lit(0)).alias("c"), other)
    cells = cells.select("t", "key", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "fp")
    together = cells.repartition("t", "key", "i", "j").sortWithinPartitions("t", "key", "i", "j")
    return together.mapInArrow(_cell_links(radius), "src long, dst long")


def shingle_hashes(text: bytes, words: int = WORDS) -> np.ndarray:
    """Distinct 64-bit hashes of the text's word shingles, ascending; of fewer words, one of the whole sequence; none without words."""
    found = text.lower().split()
    if not found:
        return np.empty(0, dtype=np.uint64)
    known: dict[bytes, int] = {}
    place = np.fromiter((known.setdefault(w, len(known)) for w in found), np.int64, len(found))
    codes = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in known), np.uint64, len(known))[place]
    width = min(words, len(found))
    mixed = np.zeros(len(found) - width + 1, dtype=np.uint64)
    for k in range(width):
        mixed = (mixed ^ codes[k : k + len(mixed)]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def bucket_keys(hashes: np.ndarray) -> list[int]:
    """A key for every bucket: a hash of PER_BUCKET permuted minima. Two texts share a key with the chance likeness ^ PER_BUCKET."""
    if not len(hashes):
        return []
    least = np.full(PER_BUCKET * BUCKETS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), 4096):
        turned = hashes[at : at + 4096, None] * _MIX[0] + _MIX[1]
        turned ^= turned >> np.uint64(32)
        least = np.minimum(least, (turned * np.uint64(0xD6E8FEB86659FD93)).min(axis=0))
    return [xxhash.xxh64_intdigest(row.tobytes(), SEED) - (1 << 63) for row in least.reshape(BUCKETS, PER_BUCKET)]


def with_sketch(rows: DataFrame, text: str = "text") -> DataFrame:
    """Adds fp, keys (of the buckets), n_shingles and shingles (32 bits of their hashes, as bytes: two of 500 shingles share them once in 30,000 texts)."""

    @F.pandas_udf("fp long, keys array<long>, n_shingles int, shingles binary")
    def of(values: pd.Series) -> pd.DataFrame:
        made = []
        for value in values:
            raw = value.encode() if isinstance(value, str) else b""
            hashes = shingle_hashes(raw)
            short = np.unique(hashes >> np.uint64(32)).astype("<u4")
            made.append((int(np.uint64(fingerprint(raw)).astype(np.int64)), bucket_keys(hashes), len(hashes), short.tobytes()))
        return pd.DataFrame(made, columns=["fp", "keys", "n_shingles", "shingles"])

    return small_batches(rows).withColumn("_sketch", of(F.col(text))).select(*[c for c in rows.columns if c != text], "_sketch.*")


def likeness_links(sketches: DataFrame, least: float = LIKENESS) -> DataFrame:
    """(fp, body, keys, n_shingles, shingles) -> (src, dst) links between fingerprints of texts that are alike.

    Of the texts of a fingerprint that of the smallest hash counts. In each bucket all meet one of its texts, another one in every bucket, so that a bucket
    costs as many comparisons as it has texts."""
    nodes = settle(sketches.groupBy("fp").agg(F.min_by(F.struct("keys", "n_shingles"), "body").alias("s")).select("fp", "s.*"))
    keyed = nodes.select("fp", "n_shingles", F.posexplode("keys").alias("bucket", "key"))
    heads = keyed.groupBy("bucket", "key").agg(F.min(F.struct(F.xxhash64("bucket", "fp").alias("h"), "fp", "n_shingles")).alias("head"), F.count("*").alias("n")).where("n > 1")
    met = keyed.join(heads, ["bucket", "key"]).select("fp", "n_shingles", F.col("head.fp").alias("head"), F.col("head.n_shingles").alias("head_n"))
    sizes = F.least("n_shingles", "head_n") >= F.lit(least) * F.greatest("n_shingles", "head_n")
    pairs = settle(met.where((F.col("fp") != F.col("head")) & sizes).select("fp", "head").distinct())
    asked = settle(pairs.select("fp").unionByName(pairs.select(F.col("head").alias("fp"))).distinct())
    # a few megabytes of fingerprints at most go to the sets; beyond that both are dealt by fingerprint
    asked = F.broadcast(asked) if asked.count() <= ASKED else asked
    sets = settle(sketches.join(asked, "fp", "left_semi").groupBy("fp").agg(F.min_by("shingles", "body").alias("shingles")))
    both = pairs.join(sets.withColumnRenamed("shingles", "a"), "fp").join(sets.select(F.col("fp").alias("head"), F.col("shingles").alias("b")), "head")

    @F.pandas_udf("boolean")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(x: bytes, y: bytes) -> bool:
            x, y = np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")
            shared = len(np.intersect1d(x, y, assume_unique=True))
            return shared >= least * (len(x) + len(y) - shared)

        return pd.Series([one(x, y) for x, y in zip(a, b)], dtype=bool)

    return both.where(alike("a", "b")).select(F.col("fp").alias("src"), F.col("head").alias("dst"))


def groups(fingerprints: DataFrame, radius: int = 3, cell: int = CELL, more: DataFrame | None = None) -> DataFrame:
    """(fp, id) rows -> one row per distinct fp: fp, root (a fingerprint that names the linked group), component (smallest id that links
    reach; null ids count only if there is no other). more: (src, dst) links beside those within the radius."""
    nodes = settle(fingerprints.groupBy("fp").agg(F.min("id").alias("low")))
    links = near_links(nodes.select("fp"), radius, cell)
    found = components(links if more is None else links.unionByName(more)).withColumnRenamed("node", "fp")
    placed = settle(nodes.join(found, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    smallest = placed.groupBy("root").agg(F.min("low").alias("component"))
    return placed.join(smallest, "root").select("fp", "root", "component")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text", radius: int = 3, cell: int = CELL) -> DataFrame:
    """One row per document: doc_id, fingerprint, component_id.

    Null and empty texts have fingerprint zero and link like any other; repeated rows each get a row; a null id takes part but
    never names a component unless all are null; an empty table gives no rows; other columns are not read."""
    rows = with_fingerprint(docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"))).select("id", F.col("simhash").alias("fp"))
    rows = settle(rows)
    named = rows.join(groups(rows, radius, cell), "fp")
    return named.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text: str = "text", radius: int = 3) -> DataFrame:
    """The rows of docs, one of each linked group of near-duplicates: the one with the smallest id (a null one only if there is no other),
    then the smallest text hash, and one of its rows if they repeat. Texts are linked by fingerprints within the radius and by likeness (see
    `likeness_links`). Unlinked texts stay apart under one id and without ids."""
    path = shared_path(docs.sparkSession, "sketches")
    marked = docs.select(F.col(id_column).alias("id"), F.xxhash64(text).alias("body"), F.col(text).alias("text"))
    with_sketch(marked).write.parquet(path)
    sketches = docs.sparkSession.read.parquet(path)
    slim = sketches.select("fp", "id", "body")
    found = groups(slim.select("fp", "id"), radius, more=likeness_links(sketches)).select("fp", "root")
    best = slim.join(found, "fp").groupBy("root", "id", "body").agg(F.count("*").alias("n"))
    best = best.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "body", "n")).alias("best"))
    keep = settle(best.select(F.col("best.id").alias("_id"), F.col("best.body").alias("_body"), F.col("best.n").alias("_n")))

    rows = packed(docs, _own=F.col(id_column), _hash=F.xxhash64(F.col(text)))

    def matching(which: DataFrame) -> DataFrame:
        return rows.join(which, F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_body")))

    once = matching(keep.where("_n = 1")).select("_doc")
    repeated = matching(keep.where("_n > 1")).groupBy("_id", "_body").agg(F.first("_doc").alias("_doc")).select("_doc")
    return unpacked(once.unionByName(repeated), docs)
