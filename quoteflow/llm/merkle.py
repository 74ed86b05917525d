"""Document fingerprints: a Merkle tree over the pieces and sections of a text.

A piece is a paragraph or, where a paragraph holds several, a sentence with what ends it (long ones are cut at PIECE characters); pieces joined give the
text back. A piece whose digest begins with 0 closes a section, so edits move section bounds only near themselves. A section's node is the digest of
its pieces' digests, the root that of its sections'. Equal texts have equal roots; sections that two texts share are taken as they are, and only
branches that differ are opened, to tell likeness or to locate edits. Everything is DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quoteflow.llm.common import settle

PIECE = 400
_PIECE = f"(?s).{{0,{PIECE - 2}}}?(?:\\n|[.!?] )|.{{1,{PIECE}}}"
#: hexadecimal digits kept of a piece's digest; a piece is written as digest:length
_DIGITS = 32
#: ids that share all but their last NEAR bits meet in one group when texts look for their neighbours
NEAR = 6
#: rows of one id beyond which they are set apart, and how many such ids are broadcast
HOT, FEW = 1024, 100_000


def with_sections(rows: DataFrame, text: str, name: str) -> DataFrame:
    """Adds the sections of a text: strings of its pieces, each digest:length, divided by blanks. An empty text has none."""
    pieces = F.regexp_extract_all(F.col(text), F.lit(_PIECE), F.lit(0))
    known = F.transform(pieces, lambda p: F.struct(F.sha2(p, 256).alias("d"), F.length(p).alias("n")))
    written = F.transform(known, lambda p: F.concat(F.substring(p["d"], 1, _DIGITS), F.lit(":"), p["n"].cast("string"), F.when(p["d"].startswith("0"), "\n").otherwise(" ")))
    sections = F.transform(F.split(F.array_join(written, ""), "\n"), lambda s: F.rtrim(s))
    return rows.withColumn(name, F.filter(sections, lambda s: s != ""))


def root(sections: Column) -> Column:
    """The fingerprint: the digest over the sections' digests."""
    return F.sha2(F.array_join(F.transform(sections, lambda s: F.sha2(s, 256)), " "), 256)


def _pieces_of(sections: Column) -> Column:
    return F.filter(F.split(F.array_join(sections, " "), " "), lambda p: p != "")


def _length(piece: Column) -> Column:
    return F.substring(piece, _DIGITS + 2, 20).cast("long")


def _weight(pieces: Column) -> Column:
    return F.aggregate(pieces, F.lit(0).cast("long"), lambda total, p: total + _length(p))


def likeness(a: Column, b: Column) -> Column:
    """Share of the characters of two trees' distinct pieces that both have, from 0 to 1; 1 for equal trees only."""
    shared = _pieces_of(F.array_intersect(a, b))
    opened = F.array_intersect(_pieces_of(F.array_except(a, b)), _pieces_of(F.array_except(b, a)))
    both = 2.0 * _weight(F.array_union(shared, opened)) / (_weight(F.array_distinct(_pieces_of(a))) + _weight(F.array_distinct(_pieces_of(b))))
    return F.when(a == b, 1.0).otherwise(F.least(both, F.lit(0.999999)))


def edits(pairs: DataFrame, key: str, before: str, after: str) -> DataFrame:
    """Where texts were edited: key, offset, length of the pieces of `after` that `before` does not have; only differing sections are opened.

    key must tell the pairs apart. Null texts count as empty; equal texts give no rows; an empty table gives none."""
    rows = pairs.select(F.col(key).alias("key"), *[F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((before, "a"), (after, "b"))])
    rows = with_sections(with_sections(rows, "a", "sa"), "b", "sb").select("key", "sa", "sb", F.array_except("sb", "sa").alias("new"), F.array_except("sa", "sb").alias("old"))
    sections = rows.select("key", F.posexplode("sb").alias("at", "section")).withColumn("size", _weight(_pieces_of(F.array("section"))))
    ordered = Window.partitionBy("key").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    sections = sections.withColumn("start", F.coalesce(F.sum("size").over(ordered), F.lit(0)))
    changed = sections.join(rows.select("key", F.explode("new").alias("section")), ["key", "section"], "left_semi")
    pieces = changed.select("key", "at", "start", F.posexplode(F.split("section", " ")).alias("k", "piece")).withColumn("size", _length(F.col("piece")))
    inside = Window.partitionBy("key", "at").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("offset", F.col("start") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    known = rows.select("key", F.explode(F.array_distinct(_pieces_of(F.col("old")))).alias("piece"))
    return pieces.join(known, ["key", "piece"], "left_anti").select("key", "offset", F.col("size").alias("length"))


def _previous(keys: DataFrame) -> DataFrame:
    """key -> key, previous: the next smaller key, and the largest for the smallest; keys are distinct and not null."""
    dealt = settle(keys.repartitionByRange("key").withColumn("part", F.spark_partition_id()))
    tops = dealt.groupBy("part").agg(F.max("key").alias("top"))  # one row a partition
    tops = tops.select("part", F.coalesce(F.lag("top").over(Window.orderBy("part")), F.max("top").over(Window.partitionBy())).alias("below"))
    lower = dealt.withColumn("lower", F.lag("key").over(Window.partitionBy("part").orderBy("key")))
    return lower.join(F.broadcast(tops), "part").select("key", F.coalesce("lower", "below").alias("previous"))


def with_next(docs: DataFrame) -> DataFrame:
    """id, text -> id, text, next: the text of the next smaller id, for the smallest id that of the largest.

    Neighbours meet by their ids' high bits, so every text is dealt once; a group's last text alone goes on to the group above. Of repeated ids the
    smallest text stands for the id, and all its rows have the same next. Rows of an id with over HOT rows are left out of the groups and take their
    next from one row that stands for them. A row without an id is nobody's next; its own is the text of the largest id, or itself where none is."""
    named = docs.where("id IS NOT NULL")
    often = settle(named.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("id"))
    n_often = often.count()
    grouped = named
    if n_often:
        often = F.broadcast(often) if n_often <= FEW else often
        crowd = named.join(often, "id", "left_semi")
        grouped = named.join(often, "id", "left_anti").unionByName(crowd.groupBy("id").agg(F.min("text").alias("text")))
    rows = grouped.withColumn("group", F.shiftright("id", NEAR))
    order = Window.partitionBy("group").orderBy(F.col("id"), F.col("text").desc())
    rows = rows.withColumns({"lower_id": F.lag("id").over(order), "lower": F.lag("text").over(order), "top": F.lead("id").over(order).isNull()})
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("inner", F.last(F.when(F.col("lower_id") < F.col("id"), F.col("lower")), ignorenulls=True).over(so_far))
    chain = _previous(grouped.select(F.shiftright("id", NEAR).alias("key")).distinct())
    tops = rows.where("top").select(F.col("group").alias("previous"), F.col("text").alias("outer"))
    outer = chain.join(tops, "previous").select(F.col("key").alias("group"), "outer")
    met = rows.join(outer, "group").select("id", "text", F.coalesce("inner", "outer").alias("next"))
    if n_often:
        crowd_next = met.join(often, "id", "left_semi").select("id", "next")
        met = met.join(often, "id", "left_anti").unionByName(crowd.join(crowd_next, "id"))
    largest = docs.agg(F.max("id")).first()[0]
    first = docs.where(F.col("id") == F.lit(largest).cast("long")).agg(F.min("text").alias("next"))  # one row
    unnamed = docs.where("id IS NULL").join(F.broadcast(first)).withColumn("next", F.coalesce("next", "text"))
    return met.unionByName(unnamed)


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_pieces, n_sections of each row of docs.

    The edited text is the text with its last half (rounded down) replaced by as many first characters of the next text (see with_next) as there are.
    Null and empty texts are the empty text, whose tree has no sections; repeated rows give repeated rows; an empty table gives none; other columns are
    not read."""
    slim = docs.select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = with_next(slim).withColumn("n", F.length("text"))
    half = F.floor(F.col("n") / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.col("text").substr(F.lit(1), F.col("n") - half), F.col("next").substr(F.lit(1), half)))
    for source, name in (("text", "own"), ("edited", "changed"), ("next", "following")):
        rows = with_sections(rows, source, name)
    return rows.select(
        F.col("id").alias("doc_id"), F.col("n").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), root(F.col("own")).alias("fingerprint"),
        root(F.col("changed")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("following")).alias("near_next"), F.size(_pieces_of(F.col("own"))).cast("long").alias("n_pieces"), F.size("own").cast("long").alias("n_sections"),
    )
