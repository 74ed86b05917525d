import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from quoteflow.llm import alignment
from quoteflow.llm.alignment import align, byte_alphabet, lockstep
from quoteflow.llm.common import vocabulary
from tests.llm.cases import documents, nothing

A, B = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")


def tokens(text):
    """Whole texts through both libraries: (id, bytes) of either side."""
    tok = Tokenizer.from_str(A.decode())
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_proto=B)
    alphabet = byte_alphabet()
    a = [(i, bytes(alphabet[c] for c in tok.id_to_token(i))) for i in tok.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in sp.encode(text):
        piece = sp.id_to_piece(i)
        b.append((i, bytes([int(piece[3:-1], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) or sp.is_unknown(i) else piece.replace("▁", " ").encode()))
    return a, b


def spans(side):
    ends = np.cumsum([len(x) for _, x in side]).tolist()
    return [(i, end - len(x), end) for (i, x), end in zip(side, ends)]


def brute(rows):
    docs, counts = [], Counter()
    for doc_id, text in rows:
        a, b = tokens(text) if text else ([], [])
        raw = (" " + text).encode() if text else b""
        if b"".join(x for _, x in a) != raw or b"".join(x for _, x in b) != raw:
            a, b = [], []
        sa, sb = spans(a), spans(b)
        links = [(i, j) for i, x, y in sa for j, u, v in sb if x < v and u < y] if len(sa) < 3000 else _swept(sa, sb)
        cuts = sorted({y for _, _, y in sa} & {y for _, _, y in sb})
        groups = []
        for low, high in zip([0, *cuts], cuts):
            groups.append(",".join(str(i) for i, _, y in sa if low < y <= high) + "|" + ",".join(str(i) for i, _, y in sb if low < y <= high)) if len(sa) < 3000 else None
        if len(sa) >= 3000:
            groups = _grouped(sa, sb, cuts)
        counts.update(links)
        docs.append((doc_id, len(a), len(b), len(cuts), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    top = defaultdict(int)
    for (_, j), n in counts.items():
        top[j] = max(top[j], n)
    return sorted([(d, na, nb, ng, len(links), sum(counts[x] == top[x[1]] for x in links), sum(counts[x] for x in links), sha) for d, na, nb, ng, links, sha in docs], key=repr)


def _swept(sa, sb):
    out, k = [], 0
    for i, x, y in sa:
        while sb[k][2] <= x:
            k += 1
        m = k
        while m < len(sb) and sb[m][1] < y:
            out.append((i, sb[m][0]))
            m += 1
    return out


def _grouped(sa, sb, cuts):
    at = {c: k for k, c in enumerate(cuts)}
    out, k = [[[], []] for _ in cuts], 0
    for side, rows in enumerate((sa, sb)):
        k = 0
        for i, _, y in rows:
            out[k][side].append(str(i))
            k += y in at
    return [",".join(a) + "|" + ",".join(b) for a, b in out]


def got(df):
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


ODD = [
    "<|endoftext|> <s> </s> <unk> <0x41> are plain",
    "two  blanks   three \t tab \n\n lines \r\n end ",
    " leading", "trailing ", " ", "  ", "\n", "a ", "it's we'll don't 'tis",
    "ﬁ ①  x x x​ y﻿ z\x1c w᠎ v\x85 u",
    "漢字かな交じり文。 한국어 텍스트 😀👩‍👩‍👧 x\x00y", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa bbb",
    "1234567890 3.14 !!!??? ---- $%&", "with ▁ inside", "▁",
]


def test_equals_whole_texts_through_the_libraries(spark):
    docs = documents(spark, [(100 + k, t, "en", "a", 1) for k, t in enumerate(ODD)])
    assert got(align(docs, A, B)) == brute([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("block, run", [(50, 3), (400, 1)])
def test_small_blocks_and_runs_change_nothing(spark, monkeypatch, block, run):
    monkeypatch.setattr(alignment, "BLOCK", block)
    monkeypatch.setattr(alignment, "RUN", run)
    rows = [(1, " ".join(f"word{k} und énième" for k in range(60))), (2, "short"), (2, "short"), (3, None), (None, "no id. " * 30), (4, "x ▁ y " * 40), (5, "q" * 300 + " " + "z" * 300), (6, "tail  \n")]
    expected = brute(rows)
    parts = []

    class Task:  # the function that tasks run, here over one partition
        @staticmethod
        def get():
            return type("T", (), {"partitionId": staticmethod(lambda: 0)})

    monkeypatch.setattr(alignment, "TaskContext", Task)
    voc = alignment.Vocabularies(A, B)
    for doc_id, text in rows:
        whole = " " + text if text and "▁" not in text else ""
        doc = alignment._Doc(len(parts), doc_id)
        pieces = [voc.ids(alignment._CUT.split(s)) for s in alignment.segments(whole)]
        assert "".join(alignment.segments(whole)) == whole
        n = np.zeros(4, dtype=int)
        digest = ""
        for k, found in enumerate(pieces or [[]]):
            made = alignment.align_block(voc, [(doc, found, k == max(len(pieces), 1) - 1)])
            n += [made[c][0] for c in ("n_a", "n_b", "n_groups", "n_links")]
            digest = made["digest"][0]
        parts.append((doc_id, *n.tolist(), digest))
    assert sorted(parts, key=repr) == sorted([(*e[:5], e[7]) for e in expected], key=repr)


def test_long_text_goes_through_several_blocks(spark):
    long = " ".join(f"palabra{k % 977} número{k % 53}" for k in range(120_000))
    assert len(long) > alignment.BLOCK
    rows = [(1, long), (2, "palabra1 x"), (3, long + " ▁")]
    assert got(align(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), A, B)) == brute(rows)


def test_lockstep_of_one_run():
    a, b, cut = lockstep(np.array([2, 5, 6]), np.array([1, 5, 6]), np.array([0]), np.array([0]), np.array([3]), np.array([3]))
    assert list(zip(a, b)) == [(0, 0), (0, 1), (1, 1), (2, 2)] and cut.tolist() == [False, False, True, True]


def test_empty(spark):
    assert align(nothing(spark), A, B).count() == 0


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        alignment.Vocabularies(vocabulary("word_bpe_49k.json"), B)
