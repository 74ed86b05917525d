import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quoteflow.llm import mixing
from tests.llm.cases import documents, nothing


def plain_targets(sizes):
    """By the words of the rule: share by weight, stop at the top, share the excess among the rest, until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    left, target, free = 1.5 * sum(sizes.values()), dict.fromkeys(order, 0.0), set(order)
    while free and left > 1e-9:
        total = sum(weight[s] for s in free)
        for s in free:
            target[s] += left * weight[s] / total
        left = 0.0
        for s in list(free):
            if target[s] > 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                free.discard(s)
    return target


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, "c": 10}, {"a": 1, "b": 1000, "c": 5, None: 30, "é": 0, "Z": 7}, {"x": 0}, {"only": 9}, {"a": 3, "b": 0, "c": 100000}])
def test_targets(spark, sizes):
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(frame).collect()}
    assert got == pytest.approx(plain_targets(sizes))


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    documents_, pieces = mixing.mix(docs)
    rows = mixing.taken(documents_, pieces).collect()
    assert len(rows) == docs.count()
    source = {r.doc_id: r.source for r in docs.collect()}
    words = {r.doc_id: len(r.text.encode().split()) for r in docs.collect()}
    sizes, taken = Counter(), Counter()
    for r in rows:
        assert r.size == words[r.doc_id] and 0 <= r.taken <= 2 * r.size
        sizes[source[r.doc_id]] += r.size
        taken[source[r.doc_id]] += r.taken
    expected = plain_targets(sizes)
    for r in rows:
        assert r.source_size == sizes[source[r.doc_id]] and r.target == pytest.approx(expected[source[r.doc_id]])
    assert all(abs(taken[s] - expected[s]) <= 0.01 * sizes[s] for s in sizes)
    again = mixing.taken(*mixing.mix(docs.repartition(7))).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))
    # pieces of a pass do not overlap, and shards hold nearly the same number of words
    spans, loads = defaultdict(list), Counter()
    for p in pieces.collect():
        spans[p.doc_id, p["pass"]].append((p.from_word, p.to_word))
        loads[p.shard] += p.to_word - p.from_word
    for s in spans.values():
        s.sort()
        assert all(a[1] <= b[0] for a, b in zip(s, s[1:]))
    assert len(loads) == 16 and max(loads.values()) < 1.5 * min(loads.values())


def test_draws_are_hypergeometric(spark):
    total, marked, drawn, n = 30, 12, 10, 20_000
    frame = spark.range(n).select(mixing._hypergeometric(mixing._uniform(F.lit(1), F.col("id")), F.lit(total).cast("long"), F.lit(marked).cast("long"), F.lit(drawn).cast("long")).alias("x"))
    got = {r.x: r["count"] for r in frame.groupBy("x").count().collect()}
    for x in range(11):
        expected = n * math.comb(marked, x) * math.comb(total - marked, drawn - x) / math.comb(total, drawn)
        assert abs(got.get(x, 0) - expected) < 5 * math.sqrt(expected + 1)
    edge = [(5, 0, 3, 0), (5, 5, 3, 3), (5, 2, 5, 2), (5, 2, 0, 0), (0, 0, 0, 0), (4, 3, 3, None)]
    rows = spark.createDataFrame([e[:3] for e in edge], "t long, m long, d long").select("*", mixing._hypergeometric(mixing._uniform(F.lit(2), F.col("t")), F.col("t"), F.col("m"), F.col("d")).alias("x")).collect()
    for (t, m, d, x), r in zip(edge, rows):
        assert r.x == x or (x is None and max(0, d + m - t) <= r.x <= min(m, d))


def test_quotas_are_exact_and_shards_full(spark):
    quotas = {1: 100, 2: 0, 3: 7, 4: 1000}
    frame = spark.createDataFrame(list(quotas.items()), "place int, quota long")
    rows = mixing.split_quotas(frame, 8, 5).collect()
    for place, quota in quotas.items():
        runs = sorted((r.begin, r.end) for r in rows if r.place == place)
        assert sum(e - b for b, e in runs) == quota and all(a[1] == b[0] for a, b in zip(runs, runs[1:]))
    filled = Counter()
    for r in rows:
        filled[r.shard] += r.end - r.begin
    assert max(filled.values()) - min(filled.values()) <= 3 and sum(filled.values()) == 1107


def test_odd_rows(spark):
    docs = documents(spark)
    got = mixing.taken(*mixing.mix(docs)).collect()
    assert len(got) == docs.count() and all(r.taken <= 2 * r.size and r.size >= 0 for r in got)
    assert sum(r.size for r in got) > 20000 and all(r.taken == 0 for r in got if r.doc_id in (3, 4, 5))
    assert mixing.taken(*mixing.mix(nothing(spark))).collect() == []
    for frame in (nothing(spark), docs):
        mixed = mixing.mixed_documents(frame)
        assert mixed.columns == docs.columns
    words = lambda t: len((t or "").encode().split())
    assert sum(words(r.text) for r in mixing.mixed_documents(docs).collect()) == sum(r.taken for r in got)
    assert mixing.mixed_documents(nothing(spark)).count() == 0


def test_sources_of_many_words(spark, monkeypatch):
    """Products of block numbers and words would leave a long here."""
    monkeypatch.setattr(mixing, "words_in", lambda text: (F.length(text) * F.lit(10**15)).cast("long"))
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 1 << 46)
    docs = spark.createDataFrame([(k, "x" * (1 + k % 7), "ab"[k % 2]) for k in range(200)], "doc_id long, text string, source string")
    rows = mixing.taken(*mixing.mix(docs)).collect()
    for source in range(2):
        mine = [r for r in rows if r.doc_id % 2 == source]
        assert sum(r.taken for r in mine) == pytest.approx(mine[0].target, rel=0.01) and all(r.taken <= 2 * r.size for r in mine)


def test_laws_of_many_sources_are_joined(spark, monkeypatch):
    docs = spark.createDataFrame([(k, "some words here " * (k % 5), f"s{k % 11}") for k in range(300)], "doc_id long, text string, source string")
    plain = sorted(map(tuple, mixing.taken(*mixing.mix(docs)).collect()))
    monkeypatch.setattr(mixing, "FEW", 3)
    assert sorted(map(tuple, mixing.taken(*mixing.mix(docs)).collect())) == plain
