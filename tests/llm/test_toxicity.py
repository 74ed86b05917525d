import zlib

import numpy as np
import pytest

from quoteflow.llm import toxicity
from tests.llm.cases import documents, nothing


def small():
    bags = [["you", "idiot", "fine", "day", "here"], ["a", "fine", "day"], ["idiot!", "again", "and", "more"] * 21, ["day"] * 30] * 4
    return bags, [1, 0, 1, 0] * 4


def test_gradients_match_differences():
    network = toxicity.Network(["idiot", "fine", "day"])
    network.w = {k: v.astype(np.float64) for k, v in network.w.items()}
    tokens, ids, mask, _ = toxicity._bag_arrays(small()[0][:3])
    back = np.random.default_rng(1).standard_normal((len(ids), toxicity.STEP)) * toxicity.open_windows(mask)

    def loss():
        return float((network.forward(network.inputs(tokens)[0].astype(np.float64), ids, mask) * back).sum())

    x, source = network.inputs(tokens)
    _, cache = network.forward(x.astype(np.float64), ids, mask, keep=True)
    found = network.gradients(x.astype(np.float64), source, ids, mask, cache, back)
    rng = np.random.default_rng(2)
    for name, w in network.w.items():
        used = np.argwhere(np.abs(found[name]) > 1e-4)
        for at in map(tuple, rng.permutation(used)[:4]):
            step, kept = 1e-3, w[at]
            w[at] = kept + step
            up = loss()
            w[at] = kept - step
            down = loss()
            w[at] = kept
            assert abs((up - down) / (2 * step) - found[name][at]) < 0.02 * max(0.05, abs(found[name][at])), name


def test_learns_a_word_inside_a_bag():
    rng = np.random.default_rng(1)
    bags, labels = [], []
    for k in range(200):
        windows = [list(rng.choice(["fine", "day", "here", "again", "and", "more"], size=24)) for _ in range(rng.integers(1, 6))]
        if k % 2:
            windows[rng.integers(len(windows))][rng.integers(24)] = "idiot"
        bags.append([w for window in windows for w in window[: 24 if k % 2 else rng.integers(18, 25)]])
        labels.append(k % 2)
    network = toxicity.train(bags, labels, 0.5, steps=200)
    texts = ["fine day " * 6, "fine day here " * 70 + "idiot " + "day and more " * 70, "fine day again " * 200, "", " \n\t", "more and Idiot. " + "day here " * 6]
    scores = toxicity.score_texts(network, texts)
    assert scores[1] > 0.8 and scores[5] > 0.8 and scores[0] < 0.2 and scores[2] < 0.2 and scores[3] == scores[4] == 0


def test_every_run_of_words_is_a_window_of_one_block():
    for n in (1, 23, 24, 25, 40, 41, 63, 64, 65, 105, 106, 1000):
        starts = toxicity.block_starts(n)
        mask = np.array([[s + k < n for k in range(toxicity.SPAN)] for s in starts])
        windows = [s + int(k) for s, row in zip(starts, toxicity.open_windows(mask)) for k in np.flatnonzero(row)]
        assert windows == list(range(max(1, n - toxicity.LENGTH + 1)))
        assert {k for s, row in zip(starts, mask) for k in s + np.flatnonzero(row)} == set(range(n))


def plain_score(network, text):
    """Every window of every block in plain loops over words."""
    w, words, logits = {k: v.astype(float) for k, v in network.w.items()}, text.lower().split(), []
    squash = lambda v: 1 / (1 + np.exp(-v))
    if not words:
        return 0.0
    for start in range(0, max(1, len(words) - 23), 41):
        block = words[start : start + 64]
        x = [network.inputs([t])[0][1].astype(float) for t in block]
        states = {}
        for d in "fb":
            h, found = np.zeros(toxicity.STATE), []
            for v in x if d == "f" else x[::-1]:
                given, own = v @ w[f"in_{d}"] + w[f"bias_{d}"], h @ w[f"own_{d}"]
                z, r = squash(given[:8] + own[:8]), squash(given[8:16] + own[8:16])
                h = (1 - z) * np.tanh(given[16:] + r * own[16:]) + z * h
                found.append(h)
            states[d] = found if d == "f" else found[::-1]
        both = [np.concatenate(p) for p in zip(states["f"], states["b"])]
        for k in range(max(1, min(41, len(block) - 23))):
            run = both[k : k + 24]
            odds = np.exp([np.tanh(s @ w["attend"] + w["attend_bias"]) @ w["query"] for s in run])
            logits.append(sum(o * s for o, s in zip(odds, run)) / odds.sum() @ w["out"] + w["out_bias"][0])
    return float(squash(max(logits) + network.shift))


def test_scores_equal_plain_loops():
    network = toxicity.train(*small(), 0.5, steps=40)
    rng = np.random.default_rng(5)
    vocabulary = ["fine", "day", "Idiot", "again", "more,", "new", "ünïcode", "#"]
    texts = [" ".join(rng.choice(vocabulary, size=n)) for n in (1, 5, 23, 24, 25, 64, 65, 70, 104, 105, 250)]
    assert np.allclose(toxicity.score_texts(network, texts), [plain_score(network, t) for t in texts], atol=1e-4)


def test_trigrams_stay_inside_words():
    together, starts = toxicity.trigrams(["ab", "", "xyz"])
    alone = [toxicity.trigrams([w])[0].tolist() for w in ("ab", "", "xyz")]
    assert [p.tolist() for p in np.split(together, starts[1:])] == alone and len(alone[0]) == 2


def test_chunks_do_not_change_scores(monkeypatch):
    network = toxicity.train(*small(), 0.5, steps=20)
    texts = [f"word{i} idiot day " * (i % 9) for i in range(40)]
    whole = toxicity.score_texts(network, texts)
    monkeypatch.setattr(toxicity, "CHUNK", 50)
    monkeypatch.setattr(toxicity, "TOGETHER", 3)
    assert np.allclose(whole, toxicity.score_texts(network, texts), atol=1e-5)


def test_held_out_accuracy(spark):
    base = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    got = {r.doc_id: r for r in toxicity.judge(docs, labels).collect()}
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for i, r in got.items())
    tested = [(r.toxic, got[r.doc_id].predicted) for r in labels.collect() if got[r.doc_id].held_out]
    caught = [p for t, p in tested if t == 1]
    wrong = [p for t, p in tested if t == 0]
    assert sum(caught) / len(caught) > 0.8 and sum(wrong) / len(wrong) < 0.03


def test_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1), (4, None), (7, 0), (8, 1), (9, 0), (3, 1)], "doc_id long, toxic int")
    docs = documents(spark)
    got = toxicity.judge(docs, labels).collect()
    assert len(got) == docs.count() and all(r.score == 0 for r in got if r.doc_id in (3, 4, 5))
    none = toxicity.judge(docs, labels.where("false")).collect()
    assert {r.score for r in none} == {0.0} and {r.predicted for r in none} == {0}
    assert toxicity.judge(nothing(spark), labels).collect() == []
    with pytest.warns(UserWarning, match="none is removed"):
        kept = toxicity.clean(docs, labels.where("false"))
    assert kept.columns == docs.columns and kept.count() == docs.count()


def captured(monkeypatch):
    """What fit hands to train."""
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda bags, labels, share: seen.append(([b for b in bags], labels)))
    return seen


def test_training_reads_every_word(spark, monkeypatch):
    seen = captured(monkeypatch)
    ids = [i for i in range(1, 9) if zlib.crc32(str(i).encode()) % 4 != 2]
    texts = {i: " ".join(f"w{i}x{k}" for k in range(3000 if i == ids[0] else 30)) for i in ids}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    toxicity.fit(docs, spark.createDataFrame([(i, int(i == ids[0])) for i in ids], "doc_id long, toxic int"))
    bags, labels = seen[0]
    assert sorted(" ".join(b) for b in bags) == sorted(texts.values()) and sum(labels) == 1


def test_blocks_in_parts_give_the_same_network(monkeypatch):
    whole = toxicity.train(*small(), 0.5, steps=3)
    monkeypatch.setattr(toxicity, "TOGETHER", 3)
    parts = toxicity.train(*small(), 0.5, steps=3)
    assert all(np.allclose(whole.w[k], parts.w[k], atol=1e-3) for k in whole.w)


def test_sample_is_of_documents_at_hand_and_one_row_an_id(spark, monkeypatch):
    seen = captured(monkeypatch)
    monkeypatch.setattr(toxicity, "PER_CLASS", (3, 2))
    trained = [i for i in range(1, 400) if zlib.crc32(str(i).encode()) % 4 != 2]
    present = trained[-4:]
    labels = spark.createDataFrame([(i, i % 2 if i not in present else int(i in present[:2])) for i in trained], "doc_id long, toxic int")
    rows = [(i, f"text of {i}") for i in present] + [(present[0], f"other text {k}") for k in range(300)] + [(present[1], None), (present[2], " \u00a0\x1c\u2003")]
    toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    bags, found = seen[0]
    assert sorted(found) == [0, 0, 1, 1] and len(bags) == 4
    assert {f"text of {i}" for i in present[1:]} <= {" ".join(b) for b in bags}
