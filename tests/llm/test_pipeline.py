from collections import Counter, defaultdict

import corpus_pipeline
from quoteflow.llm import quality, simhash, toxicity
from quoteflow.llm.common import shared_path, shared_paths
from tests.llm.cases import documents, nothing
from tests.llm.test_mixing import plain_targets
from tests.llm.test_simhash import alike, close, plain_components, plain_fingerprint, plain_shingles

BASE = "/root/testdata/sf0.001"


def test_each_stage_against_its_own_input(spark):
    docs = spark.read.parquet(f"{BASE}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "toxicity", "simhash_near_dedup", "mixing", "sentencepiece"]
    inputs, outputs = [], []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, BASE)
        if name != "sentencepiece":
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        path = shared_path(spark, "pipeline-test")
        out.write.parquet(path)
        inputs.append(docs)
        docs = spark.read.parquet(path)
        outputs.append(docs)
    rows = lambda f: Counter(tuple(r) for r in f.collect())
    kept = {r.doc_id for r in quality.judge(inputs[0]).where("kept").collect()}
    assert rows(outputs[0]) == Counter(tuple(r) for r in inputs[0].collect() if r.doc_id in kept)
    labels = spark.read.parquet(f"{BASE}/labels.parquet")
    toxic = {r.doc_id for r in toxicity.judge(inputs[1], labels).where("predicted = 1").collect()}
    assert rows(outputs[1]) == Counter(tuple(r) for r in inputs[1].collect() if r.doc_id not in toxic)
    marks = {r.doc_id: (plain_fingerprint(r.text), plain_shingles(r.text)) for r in inputs[2].collect()}
    component = plain_components(marks, lambda a, b: close(a[0], b[0]) or alike(a[1], b[1]))
    assert rows(outputs[2]) == Counter(tuple(r) for r in inputs[2].collect() if component[r.doc_id] == r.doc_id)
    before, sizes, taken = {r.doc_id: r for r in inputs[3].collect()}, Counter(), Counter()
    texts = defaultdict(list)
    for r in inputs[3].collect():
        sizes[r.source] += len(r.text.encode().split())
    for r in outputs[3].collect():
        taken[r.source] += len(r.text.encode().split())
        texts[r.doc_id].append(r.text)
        assert (r.lang, r.source) == (before[r.doc_id].lang, before[r.doc_id].source)
    target = plain_targets(sizes)
    assert all(abs(taken[s] - target[s]) <= 0.01 * sizes[s] + 1 for s in sizes)
    for i, found in texts.items():
        whole = before[i].text.encode().split()
        assert len(found) <= 2 and all(Counter(t.encode().split()) <= Counter(whole) for t in found)
    assert Counter(r.decoded for r in outputs[4].collect()) == Counter(r.text for r in inputs[4].collect())


def test_run(spark):
    out = corpus_pipeline.run(spark, BASE)
    assert out.count() > 50 and "ids_sha256" in out.columns
    # its last stage is all that it leaves, and another run leaves that alone
    made = [p for p in shared_paths() if "pipeline-" in p and "pipeline-test" not in p]
    assert len(made) == 1 and "sentencepiece" in made[0]
    assert corpus_pipeline.run(spark, BASE).count() == out.count()


def test_repeated_rows_leave_one(spark):
    docs = spark.createDataFrame([(1, "a b c d e", "x"), (1, "a b c d e", "x"), (2, "a b c d e", "y"), (1, "a b c d e f g h", "z")], "doc_id long, text string, source string")
    kept = simhash.one_of_each(docs).collect()
    assert sum(r.text == "a b c d e" for r in kept) == 1


def test_odd_rows_and_an_empty_table_go_through_all_stages(spark):
    """Nulls, empty and long texts, repeats and clashing names in, whole rows of the same columns out; nothing in, nothing out."""
    prose = [(r.doc_id + 1000, r.text, r.lang, r.source, r.n_chars) for r in spark.read.parquet(f"{BASE}/documents.parquet").limit(40).collect()]
    for docs in (documents(spark, [*prose, *prose[:3], (None, prose[5][1] + " more words", None, None, None)]), nothing(spark)):
        columns, empty = docs.columns, docs.isEmpty()
        known = {(r.doc_id, r.text) for r in docs.collect()}
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, BASE)
            path = shared_path(spark, "pipeline-test")
            out.write.parquet(path)
            docs = spark.read.parquet(path)
            if name in ("quality_rules", "toxicity", "simhash_near_dedup"):
                assert docs.columns == columns and {(r.doc_id, r.text) for r in docs.collect()} <= known
            assert docs.isEmpty() == empty
