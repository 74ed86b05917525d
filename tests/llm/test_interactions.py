from fractions import Fraction
from itertools import permutations

import pytest

from quoteflow.llm.interactions import FILTERS, audit, coalitions, kernel_shares
from tests.llm.cases import documents, nothing

BLANKS = " \t\n\x0b\x0c\r"


def fails(text):
    words = text.encode().split()
    return [
        len(words) < 100,
        100 * len(set(words)) < 80 * len(words),
        100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text),
        any(c in "#$%&*|" for c in text),
    ]


def brute(rows, labels):
    """rows (id, part, text), labels {id: (quality, toxic)}: every document walks every order."""
    docs = []
    for i, part, text in rows:
        text = text or ""
        copy = any(i is not None and j is not None and j < i and (t or "") == text for j, _, t in rows)
        docs.append((part or "", [*fails(text), copy], *[x == 1 for x in labels.get(i, (0, 0))]))
    out = {}
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        shares = dict.fromkeys(range(5), 0)
        table = {}
        for order in permutations(range(5)):
            for step, k in enumerate(order, 1):
                gone = lambda d: any(d[1][j] for j in order[: step - 1])  # noqa: B023, E731
                hit = [d for d in mine if d[1][k]]
                new = [d for d in hit if not gone(d)]
                shares[k] += len(new)
                kept = sum(not gone(d) and not d[1][k] for d in mine)
                table["".join(FILTERS[j] for j in order), step] = (kept, len(new), len(hit) - len(new), sum(sum(d[1]) == 1 for d in hit), sum(d[2] for d in new), sum(d[3] for d in new))
        for (order, step), values in table.items():
            out[part, order, step] = (*values, shares[FILTERS.index(order[step - 1])])
    return out


def got(df):
    rows = df.collect()
    found = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}
    assert len(found) == len(rows)
    return found


@pytest.mark.parametrize("players", [1, 2, 3, 5])
def test_kernel_shares_are_shapley(players):
    counts = [(7 * m * m + 3 * m) % 11 for m in range(1 << players)]
    v = coalitions(counts, players)
    assert v == [sum(n for m, n in enumerate(counts) if m & s) for s in range(1 << players)]
    orders = list(permutations(range(players)))
    expected = [Fraction(0)] * players
    for order in orders:
        s = 0
        for i in order:
            expected[i] += Fraction(v[s | 1 << i] - v[s], len(orders))
            s |= 1 << i
    assert kernel_shares(v, players) == expected


def test_audit_equals_walking_every_order(spark):
    words = " ".join(f"w{i}" for i in range(120))
    more = [(20, words, None, "a", 1), (21, words, "en", "a", 1), (22, words, "en", "b", 1), (23, words + " #", "", "a", 1), (24, "A" * 50 + words, "en", "a", 1), (25, "x " * 300, "en", "a", 1)]
    docs = documents(spark, more)
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (21, 1, 0), (22, 1, 1), (25, None, 1), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    marks = {1: (1, 1), 21: (1, 0), 22: (1, 1), 25: (0, 1)}
    expected = brute([(r.doc_id, r.lang, r.text) for r in docs.collect()], marks)
    assert got(audit(docs, labels)) == expected


def test_one_text_under_one_id_many_times(spark):
    docs = spark.createDataFrame([(5, "a", "en")] * 40 + [(6, "a", "en")] * 3 + [(None, "a", "en")] * 2, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert got(audit(docs, labels)) == brute([tuple(r[i] for i in (0, 2, 1)) for r in docs.collect()], {})


def test_empty(spark):
    assert audit(nothing(spark), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0
