"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Every source is a permuted stream of words, cut into blocks of (nearly) equal length. A source's target gives it an exact quota of blocks. The
quotas are dealt to output shards by a binary tree: the left half of the shards gets a multivariate-hypergeometric draw of the node's quotas
and the right half the rest, so that every shard is filled, quotas stay exact, and each shard's composition is that of a random draw.
A shard then takes its run of the source's permuted blocks, and its rows are shuffled within the shard. All draws come from hashes of
a seed, so that reruns agree. Nothing is sorted or numbered over a whole source in one task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quoteflow.llm.common import packed, settle, unpacked

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
#: hash buckets in which a source's stream is laid out; blocks of a small source; words of a block of a large one
BUCKETS, LEAST_BLOCKS, BLOCK_WORDS = 1024, 128, 1 << 16
#: standard deviations around the mean in which a draw is looked up; what lies outside has a chance below 1e-30
SPREAD = 12
#: primes above any number of blocks: steps that go through all blocks of a source
STEPS = (2_147_483_647, 3_221_225_473, 1_610_612_741, 1_000_000_007, 1_000_000_009, 998_244_353, 805_306_457, 469_762_049)
#: sources up to which their laws (some 500 bytes each) are broadcast; parts of a shard that are written by tasks of their own
FEW, PARTS = 10_000, 16
KEY = ("doc_id", "source", "body", "copy")


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _uniform(*parts: Column) -> Column:
    """A number in (0, 1) that depends on the parts only."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11) + F.lit(0.5)) / F.lit(float(1 << 53))


def targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size) -> with target: share x all sizes dealt by weight, a source stopping at `most` times its size.

    Resharing the excess until none is above ends at min(most x size, level x weight) for one level: sources are met in the order in which a rising
    level stops them. One row a source; sources rank by code point, null last, and take the weights in turn."""
    everywhere = W.orderBy(F.col("source").asc_nulls_last())
    pick = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("place", F.row_number().over(everywhere))
    ranked = ranked.withColumn("weight", F.element_at(pick, ((F.col("place") - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("top", F.lit(most) * F.col("source_size"))
    order = W.orderBy((F.col("top") / F.col("weight")).asc(), "place")
    stopped = order.rowsBetween(W.unboundedPreceding, -1)
    rest = order.rowsBetween(0, W.unboundedFollowing)
    whole = W.partitionBy()
    level = (F.lit(share) * F.sum("source_size").over(whole) - F.coalesce(F.sum("top").over(stopped), F.lit(0.0))) / F.sum("weight").over(rest)
    # the first source that the level leaves below its top; all before it are stopped
    level = ranked.withColumn("level", level).withColumn("free", F.col("level") <= F.col("top") / F.col("weight"))
    final = F.min(F.when(F.col("free"), F.struct(F.col("top") / F.col("weight"), "place", "level"))).over(whole)["level"]
    return level.withColumn("target", F.coalesce(F.least("top", final * F.col("weight")), F.col("top"))).select("source", "source_size", "place", "target")


def _hypergeometric(uniform: Column, total: Column, marked: Column, drawn: Column) -> Column:
    """How many of `drawn` items out of `total` are marked: inverse distribution function, by ratios of neighbouring chances."""
    low, high = F.greatest(F.lit(0).cast("long"), drawn + marked - total), F.least(marked, drawn)
    mean = drawn * marked / F.greatest(total, F.lit(1))
    width = F.lit(float(SPREAD)) * F.sqrt(mean * (1 - marked / F.greatest(total, F.lit(1)))) + 2 * SPREAD
    first, last = F.greatest(low, F.floor(mean - width)), F.least(high, F.ceil(mean + width))

    def ratio(x: Column) -> Column:  # chance of x + 1 over chance of x
        return ((marked - x) * (drawn - x)).cast("double") / ((x + 1) * (total - marked - drawn + x + 1))

    def log_sum(a: Column, b: Column) -> Column:
        return F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))

    steps = F.when(last > first, F.sequence(first, last - 1)).otherwise(F.array().cast("array<bigint>"))
    zero = F.struct(F.lit(0.0).alias("p"), F.lit(0.0).alias("sum"))
    weighed = F.aggregate(steps, zero, lambda s, x: F.struct((s["p"] + F.log(ratio(x))).alias("p"), log_sum(s["sum"], s["p"] + F.log(ratio(x))).alias("sum")))
    start = F.struct(F.lit(0.0).alias("p"), F.lit(0.0).alias("sum"), first.cast("long").alias("at"))

    def search(goal: Column) -> Column:
        def step(s: Column, x: Column) -> Column:
            p = s["p"] + F.log(ratio(x))
            return F.when(s["sum"] >= goal, s).otherwise(F.struct(p.alias("p"), log_sum(s["sum"], p).alias("sum"), (x + 1).cast("long").alias("at")))

        return F.aggregate(steps, start, step)["at"]

    return F.transform(F.array(F.log(uniform) + weighed["sum"]), search)[0]


def _draw(seed: int, level: int):
    """The fold over a node's sources: each gets its part of the room that is left, given what the sources after it hold."""

    def draw(s: Column, b: Column) -> Column:
        got = _hypergeometric(_uniform(F.lit(seed), F.lit(level), F.col("node"), b["place"]), s["total"], b["q"], s["room"])

        def take(g: Column) -> Column:
            own = F.struct(b["place"].alias("place"), g.alias("q"))
            return F.struct((s["total"] - b["q"]).alias("total"), (s["room"] - g).alias("room"), F.concat(s["bag"], F.array(own)).alias("bag"))

        return F.transform(F.array(got), take)[0]

    return draw


def split_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(place, quota) -> (place, shard, begin, end): the run of each source's block draws that a shard gets. shards: a power of two.

    The tree's nodes hold one number for each source. Shards of a level hold the same number of blocks, or one more to the left."""
    nodes = quotas.agg(F.sort_array(F.collect_list(F.struct("place", F.col("quota").alias("q")))).alias("bag")).select(F.lit(0).alias("node"), "bag")
    for level in range(int(math.log2(shards))):
        total = F.aggregate("bag", F.lit(0).cast("long"), lambda s, b: s + b["q"])
        begin = F.struct(F.col("total").alias("total"), F.ceil(F.col("total") / 2).cast("long").alias("room"), F.array().cast("array<struct<place:int,q:bigint>>").alias("bag"))

        left = F.aggregate("bag", begin, _draw(seed, level))["bag"]
        halves = nodes.withColumn("total", total).select("node", "bag", left.alias("left"))
        right = F.zip_with("bag", "left", lambda b, a: F.struct(b["place"].alias("place"), (b["q"] - a["q"]).alias("q")))
        both = F.array(F.struct((2 * F.col("node")).alias("node"), F.col("left").alias("bag")), F.struct((2 * F.col("node") + 1).alias("node"), right.alias("bag")))
        nodes = halves.select(F.explode(both).alias("n")).select("n.node", "n.bag")
    leaves = nodes.select(F.col("node").alias("shard"), F.explode("bag").alias("b")).select("shard", "b.place", "b.q")
    upto = F.sum("q").over(W.partitionBy("place").orderBy("shard"))
    return leaves.select("place", "shard", (upto - F.col("q")).alias("begin"), upto.alias("end")).where("end > begin")


def mix(docs: DataFrame, shards: int = 16, seed: int = 2024, id_column: str = "doc_id", text: str = "text", source: str = "source", share: float = 1.5, most: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """(documents, pieces). documents: doc_id, source, body, copy, size, source_size, target. pieces: doc_id, source, body, copy, shard, pass, from_word,
    to_word, shuffle.

    A piece is a stretch of a document's words that a shard takes; sorting a shard by `shuffle` gives its order. `body` is a hash of all columns of
    the row, and `copy` numbers rows that repeat wholly, each of which is a document of its own. A block is drawn once a pass, and a pass starts only after all
    blocks were drawn, so no document exceeds ceil(most) times its size. Null and empty texts have size 0 and are never taken; null sources
    form the last source; an empty table, or one without words, gives no pieces."""
    body = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    slim = docs.select(F.col(id_column).alias("doc_id"), F.col(source).alias("source"), body.alias("body"), words_in(F.col(text)).alias("size"))
    slim = slim.groupBy("doc_id", "source", "body", "size").agg(F.count("*").alias("n"))
    sized = slim.select("doc_id", "source", "body", "size", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("copy"))
    sized = settle(sized.withColumn("mixed", F.xxhash64(F.lit(seed), "doc_id", "body", "copy")))
    totals = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), share, most)
    blocks = F.greatest(F.lit(LEAST_BLOCKS), F.ceil(F.col("source_size") / BLOCK_WORDS)).cast("long")
    quota = F.when(F.col("source_size") > 0, F.round(F.col("target") / F.col("source_size") * F.col("blocks"))).otherwise(0).cast("long")
    totals = settle(totals.withColumn("blocks", blocks).withColumn("quota", quota).withColumn("place", F.col("place").cast("int")))
    named = totals.withColumnRenamed("source", "own")
    known = sized.join(named, F.col("source").eqNullSafe(F.col("own"))).drop("own")

    # where a document begins in its source's stream: words of earlier buckets, then of earlier documents in its own
    bucketed = known.where("size > 0").withColumn("bucket", F.pmod(F.col("mixed"), F.lit(BUCKETS)))
    filled = bucketed.groupBy("place", "bucket").agg(F.sum("size").alias("words"))
    before = W.partitionBy("place").orderBy("bucket")
    starts = filled.select("place", "bucket", (F.sum("words").over(before) - F.col("words")).alias("start"))
    own = W.partitionBy("place", "bucket").orderBy("mixed", "doc_id", "body", "copy")
    laid = bucketed.withColumn("own", F.sum("size").over(own.rowsBetween(W.unboundedPreceding, 0)) - F.col("size"))
    laid = laid.join(starts, ["place", "bucket"]).withColumn("at", F.col("start") + F.col("own"))

    # block b holds the words from floor(b * source_size / blocks) on, by quotient and rest so that no product leaves a long
    per, rest = F.floor(F.col("source_size") / F.col("blocks")), F.col("source_size") % F.col("blocks")
    edge = lambda b: (b * per + F.floor(b * rest / F.col("blocks"))).cast("long")
    guess = lambda w: F.floor(w.cast("double") / F.col("source_size") * F.col("blocks")).cast("long")
    first, last = F.greatest(F.lit(0), guess(F.col("at")) - 1), F.least(F.col("blocks") - 1, guess(F.col("at") + F.col("size") - 1) + 1)
    cut = laid.select(*KEY, "place", "size", "source_size", "blocks", "at", F.explode(F.sequence(first, last)).alias("block"))
    low, high = F.greatest(F.col("at"), edge(F.col("block"))), F.least(F.col("at") + F.col("size"), edge(F.col("block") + 1))
    cut = cut.select(*KEY, "place", "block", (low - F.col("at")).alias("from_word"), (high - F.col("at")).alias("to_word")).where("to_word > from_word")

    # which draws of the source's permuted sequence take a block, and the shard that each draw belongs to: arithmetic on the cut rows
    runs = split_quotas(totals.select("place", "quota"), shards, seed)
    per_place = runs.groupBy("place").agg(F.sort_array(F.collect_list(F.struct("begin", "end", "shard"))).alias("runs"))
    # a step that is prime to the number of blocks goes through all of them; the one nearest the golden section scatters neighbours
    step = F.array_min(F.array(*[F.struct(F.abs(F.pmod(F.lit(p), F.col("blocks")) / F.col("blocks") - 0.381966).alias("off"), F.pmod(F.lit(p), F.col("blocks")).alias("step")) for p in STEPS]))["step"]
    law = settle(totals.join(per_place, "place").select("place", "blocks", "quota", "runs", step.alias("step")))
    law = F.broadcast(law) if law.count() <= FEW else law
    passes = F.explode(F.sequence(F.lit(0), F.lit(math.ceil(most) - 1))).alias("pass")
    turned = F.pmod(F.col("block") * F.col("step") + F.pmod(F.xxhash64(F.lit(seed), "place", "pass"), F.col("blocks")), F.col("blocks"))
    drawn = cut.join(law, "place").select("*", passes).withColumn("draw", F.col("pass") * F.col("blocks") + turned).where("draw < quota")
    holds = F.filter("runs", lambda r: (r["begin"] <= F.col("draw")) & (F.col("draw") < r["end"]))
    pieces = drawn.select(*KEY, "pass", "from_word", "to_word", holds[0]["shard"].alias("shard"))
    shuffle = F.xxhash64(F.lit(seed), "shard", "pass", *KEY, "from_word")
    return known.select(*KEY, "size", "source_size", "target"), pieces.select(*KEY, "shard", "pass", "from_word", "to_word", shuffle.alias("shuffle"))


def taken(documents: DataFrame, pieces: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words that the mix takes, repeats counted)."""
    mark = F.xxhash64(*KEY)  # with all of the key joined on, for null ids and sources
    words = pieces.groupBy(*KEY).agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken")).select(mark.alias("mark"), *[F.col(k).alias(f"_{k}") for k in KEY], "taken")
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in KEY]
    joined = documents.withColumn("own", mark).join(words, [F.col("own") == F.col("mark"), *same], "left")
    return joined.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source", **settings) -> DataFrame:
    """The mix as documents with the columns of docs: one row for each document and pass that takes words of it; its text is whole, or the taken words
    with the blanks that follow them. A shard's rows lie in up to PARTS parts by hash, shuffled within each."""
    _, pieces = mix(docs, id_column=id_column, text=text, source=source, **settings)
    span = F.struct("from_word", "to_word")
    spans = pieces.groupBy(*KEY, "pass").agg(F.sort_array(F.collect_list(span)).alias("_spans"), F.min("shard").alias("_shard"), F.min("shuffle").alias("_order"))
    spans = spans.select(F.col("doc_id").alias("_id"), F.col("body").alias("_body"), "_spans", "_shard", "_order")
    rows = packed(docs, _own=F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]), _mine=F.col(id_column), _text=F.col(text))
    once = rows.dropDuplicates(["_own", "_mine"])  # each of the copies has spans of its own
    joined = once.join(spans, (F.col("_own") == F.col("_body")) & F.col("_mine").eqNullSafe(F.col("_id")))
    words = F.regexp_extract_all("_text", F.lit(rf"{WORD}[\x20\x09-\x0D]*"), F.lit(0))

    def picked(all_words: Column) -> Column:
        return F.array_join(F.flatten(F.transform("_spans", lambda s: F.slice(all_words, (s["from_word"] + 1).cast("int"), (s["to_word"] - s["from_word"]).cast("int")))), "")

    whole = F.aggregate("_spans", F.lit(0).cast("long"), lambda n, s: n + s["to_word"] - s["from_word"]) == words_in(F.col("_text"))
    cut = F.when(whole, F.col("_text")).otherwise(F.transform(F.array(words), picked)[0])
    made = joined.select("_shard", "_order", F.struct(*[cut.alias(c) if c == text else F.col(f"_doc.`{c}`").alias(c) for c in docs.columns]).alias("_doc"))
    made = made.withColumn("_part", F.pmod("_order", F.lit(PARTS)))
    return unpacked(made.repartition("_shard", "_part").sortWithinPartitions("_shard", "_part", "_order"), docs)
