import hashlib
import random

import numpy as np
import public_tokenizers
import pytest

from quoteflow.llm import pieces
from quoteflow.llm.common import vocabulary
from tests.llm.cases import documents, nothing

MODEL = vocabulary("piece_bpe_32k.model", public_tokenizers.path("piece_bpe_32k.model"))
SIGNS = [" ", "  ", "a", "b", "the", "▁", "\n", "é", "①", "\x00", "\t", "\r", "ing", "한", "😀", "ﬁ", "   ", "<0x0A>", "<s>", "1", "22", ".", "…", " "]


def library():
    return pieces.loaded(MODEL)[0].library


def test_random_texts_equal_the_library():
    rnd, lib = random.Random(1), library()
    texts = ["".join(rnd.choice(SIGNS) for _ in range(rnd.randint(0, 14))) for _ in range(2000)]
    for text, packed in zip(texts, pieces.encode_batch(texts, MODEL)):
        ids = np.frombuffer(packed, "<u4").tolist()
        assert ids == lib.encode(text, add_bos=True, add_eos=True), text
        assert pieces.loaded(MODEL)[0].decode(ids) == lib.decode(ids)


def test_any_ids_decode_like_the_library():
    rnd, lib = random.Random(2), library()
    for _ in range(2000):
        ids = [rnd.choice([rnd.randrange(32000), rnd.randrange(259), rnd.randrange(100, 259)]) for _ in range(rnd.randint(0, 8))]
        assert pieces.loaded(MODEL)[0].decode(ids) == lib.decode(ids)


def test_heap_and_steps_agree():
    rnd = random.Random(3)
    vocabulary = pieces.loaded(MODEL)[0]
    words = ["▁" + "".join(rnd.choice("abcdeé①thing") for _ in range(rnd.randint(0, 60))) for _ in range(500)]
    assert [np.frombuffer(x, "<u4").tolist() for x in vocabulary.agendas(words)] == [vocabulary.agenda(w) for w in words]


def test_memory_is_bounded_and_forgetting_changes_nothing(monkeypatch):
    texts = [f"w{i} v{i % 7} x" for i in range(300)]
    before = list(pieces.encode_batch(texts, MODEL))
    monkeypatch.setattr(pieces, "REMEMBER", 50)
    monkeypatch.setattr(pieces, "CHECK_BYTES", 100)
    assert list(pieces.encode_batch(texts, MODEL)) == before
    assert len(pieces.loaded(MODEL)[1]) <= 150


def test_whole_table_equals_the_library(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts, lib = {r.doc_id: r.text for r in docs.collect()}, library()
    got = pieces.encode(docs, MODEL).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = lib.encode(texts[r.doc_id], add_bos=True, add_eos=True)
        assert r.ids == ids and r.n_tokens == len(ids) and r.decoded == lib.decode(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()


def test_odd_rows(spark):
    got = pieces.encode(documents(spark), MODEL).collect()
    assert len(got) == documents(spark).count()
    assert {tuple(r.ids) for r in got if r.doc_id in (3, 4)} == {(1, 2)} and {r.decoded for r in got if r.doc_id in (3, 4)} == {""}
    lib = library()
    text = documents(spark).where("doc_id = 8").first().text
    assert [r.ids for r in got if r.doc_id == 8] == [lib.encode(text, add_bos=True, add_eos=True)]
    assert pieces.encode(nothing(spark), MODEL, with_ids=False).collect() == []


def test_wrong_encodings_raise(monkeypatch):
    monkeypatch.setattr(pieces.Pieces, "agendas", lambda self, texts: [b"\x05\x00\x00\x00"] * len(texts))
    with pytest.raises(ValueError, match="differs"):
        list(pieces.encode_batch(["entirelynewword zzqq"], MODEL))


def test_texts_without_blanks_are_not_remembered(monkeypatch):
    rnd = random.Random(9)
    texts = ["".join(rnd.choice("漢字かなABCabc=+/") for _ in range(400)) for _ in range(60)] + ["short words come again and again"] * 5
    monkeypatch.setattr(pieces, "REMEMBER", 20_000)
    own, young, old = pieces.loaded(MODEL)
    young.clear(), old.clear()
    got = list(pieces.encode_batch(texts, MODEL)) + list(pieces.encode_batch(texts, MODEL))
    expected = [np.array([own.begin, *ids, own.end], "<u4").tobytes() for ids in library().encode(texts)]
    assert got == expected * 2
    assert all(len(s) <= pieces.SHORT for kept in (young, old) for s in kept)
