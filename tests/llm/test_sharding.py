import heapq
import random
import zlib
from collections import Counter, defaultdict

from quoteflow.llm import sharding
from tests.llm.cases import documents, nothing


def one_by_one(sizes, shards):
    heap = [(0, k) for k in range(shards)]
    for size, count in sorted(sizes, reverse=True):
        for _ in range(count):
            load, k = heapq.heappop(heap)
            heapq.heappush(heap, (load + size, k))
    return sorted(load for load, _ in heap)


def test_schedule_equals_single_steps():
    rnd = random.Random(1)
    for _ in range(300):
        shards = rnd.randint(1, 7)
        sizes = [(s, rnd.randint(1, 40)) for s in rnd.sample(range(1, 60), rnd.randint(0, 9))]
        plan = sharding.schedule(sizes, shards)
        assert {s: sum(g) for s, g in plan} == dict(sizes)
        loads = sorted(sum(s * g[k] for s, g in plan) for k in range(shards))
        assert loads == one_by_one(sizes, shards)


def check(docs, got, shards):
    rows = [(r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in docs.collect()]
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter(rows)
    by = defaultdict(set)
    for r in got:
        by[r.text_crc32, r.size].add(r.shard)
    assert all(len(s) == 1 for s in by.values())
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    loads = Counter()
    for r in got:
        loads[r.shard] += r.size
    return [loads[k] for k in range(shards)]


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = sharding.assign(docs, 24).collect()
    loads = check(docs, got, 24)
    groups = Counter()
    for r in got:
        groups[r.text_crc32, r.size] += r.size
    assert sorted(loads) == one_by_one([(w, 1) for w in groups.values()], 24)
    assert [(r.doc_id, r.shard, r.slot) for r in sharding.assign(docs, 24).sort("doc_id").collect()] == [(r.doc_id, r.shard, r.slot) for r in sorted(got, key=lambda r: r.doc_id)]


def test_odd_rows(spark):
    check(documents(spark), sharding.assign(documents(spark), 3).collect(), 3)
    assert sharding.assign(nothing(spark)).collect() == []


def test_buckets_number_without_gaps(spark):
    docs = spark.range(9000).selectExpr("id AS doc_id", "concat('t', id % 7000) AS text")
    check(docs, sharding.assign(docs, 5).collect(), 5)
