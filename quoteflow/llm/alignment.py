"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes of a text.

Each text is tokenised with a byte-level vocabulary (A) and a merge-type vocabulary with byte fallback (B). Runs of documents of a batch are walked in
lockstep: one state vector holds every run's place in A and B; a step links both tokens, records a cut where both end together, advances the sides that
end first and drops finished runs. Links are kept per block of documents as short codes into the block's own list of id pairs, so only that list meets
the corpus-wide counts, and not every link.

Neither vocabulary joins anything over a blank that follows a visible character, or over a line end between two (checked when they are loaded), so texts
fall into chunks there; chunks are tokenised by the libraries once, compared with their bytes, and remembered."""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoteflow.llm.common import shared_path, small_batches, texts_of

BLANK = "▁"
_CUT = re.compile("(?<=[^\\s\u180e\u200b\ufeff])(?= |\\n[^\\s\u180e\u200b\ufeff])")
#: chunks of letters and signs that all versions of Unicode class alike
_PLAIN = re.compile("[ \\n][!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+")
#: characters of texts that are aligned together, and whose links share one list of pairs
BLOCK = 1 << 21
#: chunks in a run, and bytes of chunks that a worker remembers
RUN, REMEMBER = 256, 128 << 20
#: chunks longer than this are not remembered
LONG = 64

_NAMES = ("uid", "doc_id", "n_a", "n_b", "n_groups", "n_links")
_BLOCK = "block long, " + ", ".join(f"{n} array<long>" for n in _NAMES) + ", digest array<string>, bounds array<long>, codes binary, pairs array<long>, totals array<long>"


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones stand for themselves, the others for codes from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class Vocabularies:
    """Both tokenizers, the bytes of their tokens, and the chunks seen so far in two generations."""

    def __init__(self, a_json: bytes, b_model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        spec = json.loads(a_json)
        pre = spec["pre_tokenizer"] or {}
        if spec["normalizer"] or pre.get("type") != "ByteLevel" or not pre.get("use_regex") or pre.get("add_prefix_space"):
            raise ValueError("A must be a byte-level vocabulary without normalisation or prefix")
        self.a = Tokenizer.from_str(a_json.decode())
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        alphabet = byte_alphabet()
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, i in spec["model"]["vocab"].items():
            self.a_bytes[i] = bytes(alphabet[c] for c in token)
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            if self.b.is_byte(i):
                self.b_bytes.append(bytes([int(piece[3:-1], 16)]))
            elif self.b.is_control(i) or self.b.is_unknown(i):
                self.b_bytes.append(b"")
            elif BLANK in piece.lstrip(BLANK) or "\n" in piece:
                raise ValueError("a piece of B reaches over a line end or the start of a blank run")
            else:
                self.b_bytes.append(piece.replace(BLANK, " ").encode())
        self.a_size, self.b_size = (np.array([len(x) for x in side], dtype=np.int64) for side in (self.a_bytes, self.b_bytes))
        word = self.b.encode("a")
        self.lone = self.b.encode("a ")[len(word) :]
        self.lead = len(self.b.encode("\n")) - 1  # tokens that stand for the blank which it puts before a line end
        self.quick = self._by_rank(spec["model"]["vocab"], spec["model"]["merges"])
        self.young: dict[str, tuple[bytes, bytes] | bool] = {}
        self.old: dict[str, tuple[bytes, bytes] | bool] = {}
        self.weight = 0

    def _by_rank(self, vocab: dict[str, int], merges: list):
        """The same merges for a faster library, which takes them by their tokens' ids; None where ids do not follow the merges' order."""
        import tiktoken
        from public_tokenizers import PATTERN

        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        if [vocab[a + b] for a, b in pairs] != list(range(256, 256 + len(pairs))):
            return None
        ranks = {self.a_bytes[i]: i for i in vocab.values() if i < 256 + len(pairs)}
        return tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _a(self, chunks: list[str]) -> list[bytes]:
        """Ids of A: plain chunks in one text, cut again where their bytes end, the others one by one."""
        out: list[bytes] = [b""] * len(chunks)
        plain = [k for k, c in enumerate(chunks) if self.quick and _PLAIN.fullmatch(c)]
        if plain:
            ids = np.array(self.quick.encode_ordinary("".join([chunks[k] for k in plain])), dtype="<u4")
            ends = np.cumsum(self.a_size[ids])
            wanted = np.cumsum([len(chunks[k].encode()) for k in plain])
            at = np.searchsorted(ends, wanted) + 1
            if not (ends[at - 1] == wanted).all():
                raise ValueError("a token of A reaches over the end of a chunk")
            raw, cuts = ids.tobytes(), (4 * at).tolist()
            for k, x, y in zip(plain, [0, *cuts], cuts):
                out[k] = raw[x:y]
        others = sorted(set(range(len(chunks))) - set(plain))
        for k, found in zip(others, self.a.encode_batch([chunks[k] for k in others], add_special_tokens=False)):
            out[k] = array("I", found.ids).tobytes()
        return out

    def learn(self, chunks: list[str], into: dict) -> None:
        """The ids of chunks, each starting with a blank or a line end; False where the tokens' bytes are not the chunk's."""
        if not chunks:
            return
        # B puts a blank in front itself, but not before nothing
        given = self.b.encode([c[1:] if c[0] == " " else c for c in chunks], num_threads=1)
        given = [self.lone if c == " " else b[self.lead :] if c[0] == "\n" else b for c, b in zip(chunks, given)]
        raw, ours = [c.encode() for c in chunks], self._a(chunks)
        sides: list[list] = []
        for side, names, sizes in ((ours, self.a_bytes, self.a_size), ([array("I", b).tobytes() for b in given], self.b_bytes, self.b_size)):
            joined = b"".join(side)
            lengths = np.concatenate([[0], np.cumsum(sizes[np.frombuffer(joined, "<u4")])])
            ends = lengths[np.cumsum([len(x) >> 2 for x in side])]
            whole = (ends == np.cumsum([len(r) for r in raw])).all() and b"".join(map(names.__getitem__, memoryview(joined).cast("I"))) == b"".join(raw)
            sides.append(side if whole else [x if b"".join([names[i] for i in memoryview(x).cast("I")]) == r else None for x, r in zip(side, raw)])
        into.update(zip(chunks, [False if a is None or b is None else (a, b) for a, b in zip(*sides)]))

    def ids(self, chunks: list[str]) -> list[tuple[bytes, bytes] | bool]:
        young = self.young
        found = list(map(young.get, chunks))
        missing = [k for k, f in enumerate(found) if f is None]
        if missing:
            new = dict.fromkeys([chunks[k] for k in missing])
            again = {c: self.old[c] for c in new if c in self.old}
            fresh: dict = {}
            self.learn([c for c in new if c not in again], fresh)
            keep = again | {c: v for c, v in fresh.items() if len(c) <= LONG}
            young.update(keep)
            self.weight += sum(300 + 10 * len(c) for c in keep)
            fresh.update(again)
            for k in missing:
                found[k] = fresh[chunks[k]]
            if self.weight > REMEMBER // 2:
                self.young, self.old, self.weight = {}, young, 0
        return found


def lockstep(end_a: np.ndarray, end_b: np.ndarray, start_a: np.ndarray, start_b: np.ndarray, stop_a: np.ndarray, stop_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token places linked (A, B) and whether both end there, in text order, for runs [start, stop) of both sides that cover the same bytes.

    A run of n and m tokens takes at most n + m - 1 steps, so each writes to a stretch of its own; unused places go at the end."""
    room = stop_a - start_a + stop_b - start_b
    at = np.cumsum(room) - room
    link_a, link_b, cut = np.full(room.sum(), -1), np.empty(room.sum(), dtype=np.int64), np.zeros(room.sum(), dtype=bool)
    some = room > 0
    i, j, at, stop = start_a[some], start_b[some], at[some], stop_a[some]
    while len(i):
        here_a, here_b = end_a[i], end_b[j]
        both = here_a == here_b
        link_a[at], link_b[at], cut[at] = i, j, both
        i, j, at = i + (here_a <= here_b), j + (here_b <= here_a), at + 1
        done = both & (i == stop)
        if done.any():
            left = ~done
            i, j, at, stop = i[left], j[left], at[left], stop[left]
    used = link_a >= 0
    return link_a[used], link_b[used], cut[used]


_DIGITS: list = []


def _digits(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per id: its decimal digits, room for a sign behind them, which of these places it uses, and where the sign stands."""
    if not _DIGITS or len(_DIGITS[0]) < size:
        written = [str(i).encode() for i in range(max(size, 1 << 16))]
        width = len(written[-1]) + 1
        length = np.array([len(w) for w in written])
        _DIGITS[:] = [np.frombuffer(b"".join(w.ljust(width) for w in written), np.uint8).reshape(-1, width), np.arange(width) <= length[:, None], length]
    return tuple(_DIGITS)


def written_groups(a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All groups as bytes a1,a2|b1;a3|b2, each with what divides it from the next, and the place where each token's own digits begin. last: the
    places of the tokens that end a group."""
    ends_a, ends_b = np.zeros(len(a), dtype=bool), np.zeros(len(b), dtype=bool)
    ends_a[last_a] = ends_b[last_b] = True
    group_a, group_b = np.cumsum(ends_a) - ends_a, np.cumsum(ends_b) - ends_b
    # behind the tokens of A before it and those of B in earlier groups; of B likewise, but for A's in its own group too
    place_a = np.arange(len(a)) + np.concatenate([[0], last_b + 1])[group_a]
    place_b = np.arange(len(b)) + (last_a + 1)[group_b] if len(b) else group_b
    token, sign = np.empty(len(a) + len(b), dtype=np.int64), np.empty(len(a) + len(b), dtype=np.uint8)
    token[place_a], token[place_b] = a, b
    sign[place_a], sign[place_b] = np.where(ends_a, ord("|"), ord(",")), np.where(ends_b, ord(";"), ord(","))
    digits, used, length = _digits(int(token.max(initial=0)) + 1)
    size = length[token]
    rows = digits[token]
    rows[np.arange(len(rows)), size] = sign
    return rows[used[token]], np.cumsum(size + 1) - (size + 1)


class _Doc:
    """A document on its way through blocks: its key, and the running digest of its groups."""

    def __init__(self, uid: int, doc_id: int | None):
        self.uid, self.doc_id, self.sha, self.begun = uid, doc_id, hashlib.sha256(), False


def align_block(vocabularies: Vocabularies, parts: list[tuple[_Doc, list, bool]]) -> dict:
    """The columns of a block of (document, ids of its chunks, whether the document ends here); documents without tokens have no chunks."""
    ids = [pair for _, pairs, _ in parts for pair in pairs]
    a, b = (np.frombuffer(b"".join([p[k] for p in ids]), "<u4").astype(np.int64) for k in (0, 1))
    per_a, per_b = (np.fromiter((len(p[k]) >> 2 for p in ids), np.int64, len(ids)) for k in (0, 1))
    chunk_a, chunk_b = np.concatenate([[0], np.cumsum(per_a)]), np.concatenate([[0], np.cumsum(per_b)])
    end_a, end_b = np.cumsum(vocabularies.a_size[a]), np.cumsum(vocabularies.b_size[b])
    first = np.concatenate([[0], np.cumsum([len(pairs) for _, pairs, _ in parts])])  # first chunk of each part
    runs = np.unique(np.concatenate([np.arange(x, y, RUN) for x, y in zip(first, first[1:])] + [first]))
    link_a, link_b, cut = lockstep(end_a, end_b, chunk_a[runs[:-1]], chunk_b[runs[:-1]], chunk_a[runs[1:]], chunk_b[runs[1:]])
    text, begin = written_groups(a, b, link_a[cut], link_b[cut])
    part_a, part_b = chunk_a[first], chunk_b[first]
    begin = np.concatenate([begin, [len(text)]])[part_a + part_b]
    text = text.tobytes()
    bounds = np.searchsorted(link_a, part_a)
    cuts = np.concatenate([[0], np.cumsum(cut)])[bounds]
    digests = []
    for k, (doc, pairs, ends) in enumerate(parts):
        if pairs:
            doc.sha.update((b";" if doc.begun else b"") + text[begin[k] : begin[k + 1] - 1])
            doc.begun = True
        digests.append(None if not ends else doc.sha.hexdigest() if doc.begun else "")
    code, pairs = pd.factorize(a[link_a] << 32 | b[link_b])
    return {
        "uid": [d.uid for d, _, _ in parts], "doc_id": [d.doc_id for d, _, _ in parts], "n_a": np.diff(part_a), "n_b": np.diff(part_b),
        "n_groups": np.diff(cuts), "n_links": np.diff(bounds), "digest": digests, "bounds": bounds, "codes": code.astype("<u2" if len(pairs) <= 1 << 16 else "<u4").tobytes(),
        "pairs": pairs, "totals": np.bincount(code, minlength=len(pairs)),
    }


def segments(text: str) -> Iterator[str]:
    """A text in stretches of about BLOCK characters that end where a chunk ends."""
    at = 0
    while at < len(text):
        found = _CUT.search(text, at + BLOCK) if at + BLOCK < len(text) else None
        end = found.start() if found else len(text)
        yield text[at:end]
        at = end


_LOADED: dict[str, Vocabularies] = {}  # of one pair of vocabularies at a time


def loaded(a_json: bytes, b_model: bytes) -> Vocabularies:
    key = hashlib.sha256(a_json + b_model).hexdigest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Vocabularies(a_json, b_model)
    return _LOADED[key]


def blocks(docs: DataFrame, a_json: bytes, b_model: bytes) -> DataFrame:
    """doc_id, text -> blocks of aligned documents, each with its documents' figures, the codes of their links and the pairs behind the codes.

    A text of which a chunk's tokens do not give back its bytes has no tokens; whether it does is known before any of it enters a block."""
    fields = [("block", pa.int64()), *[(n, pa.list_(pa.int64())) for n in _NAMES], ("digest", pa.list_(pa.string())), ("bounds", pa.list_(pa.int64())), ("codes", pa.binary()), ("pairs", pa.list_(pa.int64())), ("totals", pa.list_(pa.int64()))]
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabularies = loaded(a_json, b_model)
        own = TaskContext.get().partitionId() << 36
        n_blocks = n_docs = size = 0
        parts: list[tuple[_Doc, list, bool]] = []

        def block() -> pa.RecordBatch:
            columns = align_block(vocabularies, parts) | {"block": own + n_blocks}
            return pa.RecordBatch.from_arrays([pa.array([columns[n]], t) for n, t in fields], schema=schema)

        for batch in batches:
            for doc_id, raw in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))):
                doc, text = _Doc(own + n_docs, doc_id), raw.decode()
                n_docs += 1
                whole = " " + text if text and BLANK not in text else ""
                if len(whole) > BLOCK and any(False in vocabularies.ids(_CUT.split(s)) for s in segments(whole)):
                    whole = ""
                open_end = bool(whole)
                for segment in segments(whole):
                    found = vocabularies.ids(_CUT.split(segment))
                    if False in found:
                        break
                    size += len(segment)
                    if size >= BLOCK:
                        # the last part of a text ends it in its block, the others leave it open
                        parts.append((doc, found, False))
                        yield block()
                        n_blocks, size = n_blocks + 1, 0
                        parts.clear()
                    else:
                        parts.append((doc, found, True))
                        open_end = False
                if open_end or not whole:
                    parts.append((doc, [], True))
        if parts:
            yield block()

    return small_batches(docs).mapInArrow(run, _BLOCK)


def align(docs: DataFrame, a_json: bytes, b_model: bytes, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row of docs.

    Null and empty texts, and texts whose tokens' bytes differ from blank + text on either side, have zeros and an empty digest column; repeated rows
    count and are returned each; an empty table gives no rows; other columns are not read. Only lists of pairs by block are dealt by pair; the table
    that is broadcast has a row for each id of B."""
    path = shared_path(docs.sparkSession, "alignment")
    blocks(docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text")), a_json, b_model).write.option("compression", "zstd").parquet(path)
    made = docs.sparkSession.read.parquet(path)
    pairs = made.select("block", F.posexplode(F.arrays_zip("pairs", "totals")).alias("at", "p")).select("block", "at", F.col("p.pairs").alias("pair"), F.col("p.totals").alias("n"))
    counts = pairs.groupBy("pair").agg(F.sum("n").alias("count")).withColumn("b", F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)))
    best = counts.groupBy("b").agg(F.max("count").alias("most"))
    # the count, below zero where another pair of the same B id has more
    known = counts.join(F.broadcast(best), "b").select("pair", F.when(F.col("count") == F.col("most"), F.col("count")).otherwise(-F.col("count")).alias("count"))
    told = pairs.select("block", "at", "pair").join(known, "pair").groupBy("block").agg(F.collect_list(F.struct("at", "count")).alias("told"))
    rows = made.join(told, "block", "left").select(*_NAMES, "digest", "bounds", "codes", F.size("pairs").alias("n_pairs"), "told")
    totals = ("n_best", "count_sum")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                values = {n: row.column(n).flatten().to_numpy(zero_copy_only=False) for n in (*_NAMES[2:], "bounds")}
                n_pairs = row.column("n_pairs")[0].as_py()
                told = row.column("told").flatten()
                count = np.zeros(n_pairs, dtype=np.int64)
                if n_pairs:
                    count[told.field("at").to_numpy()] = told.field("count").to_numpy()
                codes = np.frombuffer(row.column("codes")[0].as_py(), "<u2" if n_pairs <= 1 << 16 else "<u4")
                of_link = count[codes]
                for name, x in zip(totals, (of_link > 0, np.abs(of_link))):
                    values[name] = np.diff(np.concatenate([[0], np.cumsum(x)])[values["bounds"]])
                columns = [row.column("uid").flatten(), row.column("doc_id").flatten(), *[pa.array(values[n], pa.int64()) for n in (*_NAMES[2:], *totals)], row.column("digest").flatten()]
                yield pa.RecordBatch.from_arrays(columns, names=[*_NAMES, *totals, "digest"])

    parts = small_batches(rows).mapInArrow(run, ", ".join(f"{n} long" for n in (*_NAMES, *totals)) + ", digest string")
    sums = [F.sum(n).alias(n) for n in (*_NAMES[2:], *totals)]
    return parts.groupBy("uid").agg(F.max("doc_id").alias("doc_id"), *sums, F.max("digest").alias("groups_sha256")).drop("uid")
