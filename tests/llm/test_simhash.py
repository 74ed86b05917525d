import itertools
import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from quoteflow.llm import simhash
from quoteflow.llm.graph import components
from tests.llm.cases import documents, nothing


def plain_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    parts = [" ".join(words)] if len(words) < 3 else [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    hashes = [xxhash.xxh64(p.encode(), seed=42).intdigest() for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(values, near):
    """values: id -> value."""
    ids, seen, out = list(values), set(), {}
    for start in ids:
        if start in seen:
            continue
        group, queue = [], [start]
        seen.add(start)
        while queue:
            at = queue.pop()
            group.append(at)
            for other in ids:
                if other not in seen and near(values[at], values[other]):
                    seen.add(other)
                    queue.append(other)
        out |= dict.fromkeys(group, min(group))
    return out


def close(a, b):
    return (a ^ b).bit_count() <= 3


def plain_shingles(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    width = min(5, len(words))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if words else set()


def alike(a, b):
    return len(a & b) >= 0.8 * len(a | b) if a and b else False


def test_likeness_links_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sketches = simhash.with_sketch(docs.selectExpr("doc_id AS id", "xxhash64(text) AS body", "text"))
    rows = {r.body: r.fp for r in sketches.select("body", "fp").collect()}
    texts = {}
    for r in docs.selectExpr("text", "xxhash64(text) AS body").collect():
        fp = rows[r.body]
        texts[fp] = min(texts.get(fp, (r.body, r.text)), (r.body, r.text))
    shingles = {fp: plain_shingles(t) for fp, (_, t) in texts.items()}
    order = sorted(shingles, key=lambda f: len(shingles[f]))
    pairs = {(a, b) for i, a in enumerate(order) for b in order[i + 1 :] if len(shingles[a]) >= 0.8 * len(shingles[b]) and alike(shingles[a], shingles[b])}
    links = simhash.likeness_links(sketches).collect()
    assert all(alike(shingles[r.src], shingles[r.dst]) for r in links)
    assert len(pairs) > 3
    root = {f: f for f in shingles}

    def top(f):
        while root[f] != f:
            f = root[f]
        return f

    for r in links:
        root[top(r.src)] = top(r.dst)
    assert sum(top(a) == top(b) for a, b in pairs) >= 0.9 * len(pairs)


def test_one_of_each_links_near_copies_beyond_three_bits(spark):
    words = [f"word{k * k % 1009}" for k in range(400)]
    near = [f"changed{k}" if k % 57 == 50 else w for k, w in enumerate(words)]
    far = [*words[:150], *[f"other{k}" for k in range(250)]]
    assert not close(plain_fingerprint(" ".join(words)), plain_fingerprint(" ".join(near)))
    many = [(10 + k, " ".join([*words[: 7 * k], f"x{k}", *words[7 * k + 1 :]])) for k in range(50)]
    docs = spark.createDataFrame([(5, " ".join(words)), (3, " ".join(near)), (4, " ".join(far)), *many, (None, None), (7, "")], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.one_of_each(docs).collect()) == [3, 4, 7]


def test_documents_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    prints = {r.doc_id: plain_fingerprint(r.text) for r in docs.collect()}
    expected = plain_components(prints, close)
    got = simhash.near_duplicates(docs).collect()
    assert {r.doc_id: int(r.fingerprint, 16) for r in got} == prints
    assert {r.doc_id: r.component_id for r in got} == expected and len(got) == len(prints)
    assert len(set(expected.values())) < len(expected)


def test_odd_rows(spark):
    docs = documents(spark)
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()]
    expected = [f"{plain_fingerprint(r.text):016x}" for r in docs.collect()]
    assert sorted(g[1] for g in got) == sorted(expected)
    zero = {g[0]: g[2] for g in got if g[1] == "0" * 16}
    assert zero == {3: 3, 4: 3, 5: 3}
    assert all(g[2] == 1 for g in got if g[1] == f"{plain_fingerprint('one two three four five six seven'):016x}")
    assert simhash.near_duplicates(nothing(spark)).collect() == []
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i not in (1, None)) == [3, 7, 8, 9] and ids.count(1) >= 1 and None in ids
    assert simhash.one_of_each(nothing(spark)).count() == 0


def test_every_near_pair_shares_a_table():
    rnd, tables = random.Random(3), simhash.masks(3)
    assert len(tables) == 15
    for _ in range(3000):
        flips = sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 3)))
        assert any(flips & m == 0 for m in tables)


def test_cells_keep_all_links(spark):
    """Dense families of fingerprints, cut into chunks of 16 and walked as a stream of small batches."""
    rnd = random.Random(5)
    values = set()
    for _ in range(6):
        at = rnd.getrandbits(64)
        for _ in range(60):
            at ^= sum(1 << b for b in rnd.sample(range(64), rnd.randint(1, 4)))
            values.add(at)
    values |= {rnd.getrandbits(64) for _ in range(100)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    frame = spark.createDataFrame([(v,) for v in signed], "fp long")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        links = simhash.near_links(frame, cell=16)
        roots = {r.node: r.root for r in components(links).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    expected = plain_components({v: v & (1 << 64) - 1 for v in signed}, close)
    groups = {}
    for v in signed:
        groups.setdefault(roots.get(v, v), set()).add(expected[v])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(expected.values()))


def test_components_of_awkward_graphs(spark):
    path = [(i, i + 1) for i in range(0, 200)]
    star = [(1000, i) for i in range(1001, 1100)]
    other = [(-5, -5), (None, 3), (7000, 7001), (7001, 7000), (7001, 7002)]
    got = components(spark.createDataFrame(path + star + other, "src long, dst long")).collect()
    by = {}
    for r in got:
        by.setdefault(r.root, set()).add(r.node)
    assert sorted(map(min, by.values())) == [0, 1000, 7000] and sum(map(len, by.values())) == 201 + 100 + 3
    assert components(spark.createDataFrame([], "src long, dst long")).collect() == []


def test_reach_finds_chains():
    values = np.array([0b0, 0b111, 0b111111, 0b111111111, 0b1111 << 40], dtype=np.uint64)
    member, seed = simhash._reach(values, 3)
    assert set(member.tolist()) == {1, 2, 3} and set(seed.tolist()) == {0}


def test_no_pair_rows(spark):
    """A large bucket yields at most one link a member and cell."""
    base = 0x0123456789ABCDEF
    near = [base ^ sum(1 << b for b in c) for n in (0, 1, 2) for c in itertools.combinations(range(20, 44), n)]
    frame = spark.createDataFrame([(v,) for v in near], "fp long")
    assert simhash.near_links(frame, cell=64).count() <= 15 * len(near) * (1 + len(near) // 64 + 1)
    assert simhash.near_links(frame).agg(F.count("*")).first()[0] <= 15 * len(near)


def test_unlinked_groups_stay_apart(spark):
    """Groups whose smallest id is equal, null or not, each keep a text; linked and repeated rows of one group leave one."""
    same = "a copy without an id that is here three times"
    texts = [f"{w} stands alone number {k} with nothing else like {w}{k}" for k, w in enumerate(("river", "engine", "violin", "carpet"))]
    docs = documents(spark, [*[(None, t, "en", "a", 1) for t in [*texts, same, same]], (20, same, "en", "a", 1), (1, texts[0] + " today again", "en", "a", 1)])
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    groups = plain_components({k: plain_fingerprint(t) for k, (_, t) in enumerate(rows)}, close)
    kept = [(r.doc_id, r.text) for r in simhash.one_of_each(docs).collect()]
    where = [groups[rows.index(r)] for r in kept]
    assert sorted(where) == sorted(set(groups.values()))
    for (i, _), g in zip(kept, where):
        ids = [rows[k][0] for k in groups if groups[k] == g and rows[k][0] is not None]
        assert i == min(ids, default=None)
    assert sorted(t for i, t in kept if i is None) == sorted([*texts, "no id at all"])
    assert (1, "another text under a known id") in kept and sum((t or "").lower().startswith("one two") for _, t in kept) == 1
