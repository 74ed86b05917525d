import hashlib
import re

import pytest

from quoteflow.llm import merkle
from quoteflow.llm.merkle import edits, fingerprints
from tests.llm.cases import documents, nothing


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def pieces(text):
    found = re.findall(r"(?s).{0,398}?(?:\n|[.!?] )|.{1,400}", text)
    assert "".join(found) == text
    return found


def tree(text):
    """(root, pieces as digest and length)."""
    sections, run = [], []
    leaves = [(sha(p)[:32], len(p)) for p in pieces(text)]
    for digest, n in leaves:
        run.append(f"{digest}:{n}")
        if digest[0] == "0":
            sections.append(run)
            run = []
    sections += [run] if run else []
    return sha(" ".join(sha(" ".join(s)) for s in sections)), leaves, len(sections)


def near(a, b):
    (ra, la, _), (rb, lb, _) = tree(a), tree(b)
    if ra == rb:
        return 1.0
    weight = lambda leaves: sum(n for _, n in leaves)
    return min(0.999999, 2.0 * weight(set(la) & set(lb)) / (weight(set(la)) + weight(set(lb))))


def brute(rows):
    """rows (id, text) -> the same columns; ids in descending order, the smallest text of an id stands for it."""
    rows = [(i, t or "") for i, t in rows]
    stands = {}
    for i, t in rows:
        if i is not None:
            stands[i] = min(stands.get(i, t), t, key=lambda x: x.encode())
    ids = sorted(stands, reverse=True)
    following = {i: stands[ids[(k + 1) % len(ids)]] for k, i in enumerate(ids)}
    out = []
    for i, t in rows:
        nxt = following[i] if i is not None else stands[ids[0]] if ids else t
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        out.append((i, len(t), sha(edited), tree(t)[0], tree(edited)[0], near(t, edited), near(t, nxt), len(tree(t)[1]), tree(t)[2]))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


PROSE = " ".join(f"Sentence {i} says {i * i} things, e.g. this! " + ("\n" if i % 5 == 0 else "") for i in range(300))


def test_equals_brute_force(spark):
    more = [(70, PROSE, "en", "a", 1), (5000, PROSE[:4000] + "A new line. " + PROSE[4000:], "en", "a", 1), (-3, "x" * 1001, "en", "a", 1), (-900, "a\n\n\nb", "en", "a", 1), (5001, "\n" * 7 + "😀" * 900, "en", "a", 1)]
    docs = documents(spark, more)
    assert got(fingerprints(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_ids_that_repeat_often_take_their_next_alike(spark, monkeypatch):
    monkeypatch.setattr(merkle, "HOT", 3)
    rows = [(i, f"Text {i}. More of {i}.") for i in range(0, 400, 7)] + [(70, f"Copy {k}. ") for k in range(20)] + [(77, None)] * 5 + [(0, "Low. ")] * 6
    for few in (merkle.FEW, 0):
        monkeypatch.setattr(merkle, "FEW", few)
        assert got(fingerprints(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


@pytest.mark.parametrize("rows", [[(4, "Only one here. And more.")], [(None, "No id. At all."), (None, None)], [(2, "b"), (None, "a. b. c")]])
def test_few_rows(spark, rows):
    assert got(fingerprints(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_empty(spark):
    assert fingerprints(nothing(spark)).count() == 0


def test_an_edit_is_located_and_leaves_the_rest_alike(spark):
    changed = PROSE[:6000] + "XX" + PROSE[6000:]
    found = edits(spark.createDataFrame([(1, PROSE, changed), (2, PROSE, PROSE), (3, None, "new"), (4, "gone", None)], "k int, a string, b string"), "k", "a", "b").collect()
    spots = {r.key: (r.offset, r.length) for r in found}
    assert len(found) == 2 and spots[3] == (0, 3)
    offset, length = spots[1]
    assert offset <= 6000 < offset + length and "XX" in changed[offset : offset + length]
    assert near(PROSE, changed) > 0.98
