"""SentencePiece encoding and decoding for merge-type vocabularies.

A text becomes symbols (characters); an agenda holds every adjacent pair whose joint string is a piece, best score first and leftmost
among equals; the best pair is merged and its new neighbours are put on the agenda, until none is left. Symbols that are no piece fall back
to their UTF-8 bytes. Long stretches use a heap; short ones, of which a batch has many, step together with their agendas in one array. No piece of such a vocabulary reaches over the start of a run of blanks or over a newline (checked when it is loaded), so
a text falls into stretches that are encoded on their own and remembered. Every new stretch of an Arrow batch is compared with the
sentencepiece library before it is used."""

from __future__ import annotations

import codecs
import hashlib
import heapq
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoteflow.llm.common import small_batches, texts_of

BLANK = "▁"
#: bytes of stretches of at most SHORT characters that a worker remembers; when full, the older half goes
REMEMBER = 96 << 20
#: characters of texts that are cut, encoded and checked together
CHECK_BYTES = 1 << 20

#: codes of characters that are no piece start here; the rank of a pair that is no piece
_LOOSE, _NONE = 1 << 22, 1 << 30
#: stretches of at most this many characters step together
SHORT = 64

codecs.register_error("each_byte", lambda e: ("�" * (e.end - e.start), e.end))


class Pieces:
    """A loaded vocabulary with the library's processor beside it, used for checks only."""

    def __init__(self, model: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        spec, trainer = proto.normalizer_spec, proto.trainer_spec
        if trainer.model_type != 2 or not trainer.byte_fallback or spec.name != "identity" or spec.precompiled_charsmap:
            raise ValueError("needs a merge-type vocabulary with byte fallback and without normalisation")
        if not (spec.add_dummy_prefix and spec.escape_whitespaces) or spec.remove_extra_whitespaces or trainer.treat_whitespace_as_suffix:
            raise ValueError("needs a dummy prefix, escaped blanks and kept blanks")
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.held = 0  # estimated bytes of the younger remembered stretches
        self.ids: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.bytes: list[int] = [0] * 256
        self.surface: list[bytes] = []
        for i, p in enumerate(proto.pieces):
            if p.type in (4, 5):
                raise ValueError("user-defined and unused pieces are not supported")
            if p.type == 6:
                self.bytes[int(p.piece[3:-1], 16)] = i
                self.surface.append(bytes([int(p.piece[3:-1], 16)]))
            elif p.type == 1:
                self.ids[p.piece], self.score[p.piece] = i, p.score
                self.surface.append(p.piece.replace(BLANK, " ").encode())
            else:
                self.surface.append(trainer.unk_surface.encode() if p.type == 2 else b"")
        if any("\n" in p or BLANK in p.lstrip(BLANK) for p in self.ids):
            raise ValueError("a piece reaches over a newline or the start of a blank run")
        code = {p: i for p, i in self.ids.items()}
        order = {v: k for k, v in enumerate(sorted(set(self.score.values()), reverse=True))}
        pairs = {}
        for p, i in self.ids.items():
            for k in range(1, len(p)):
                left, right = (code.get(x, _LOOSE + ord(x) if len(x) == 1 else None) for x in (p[:k], p[k:]))
                if left is not None and right is not None:
                    pairs[left << 23 | right] = (order[self.score[p]], i)
        keys = sorted(pairs)
        self.pair_key = np.array([*keys, np.iinfo(np.int64).max])
        self.pair_rank = np.array([*(pairs[k][0] for k in keys), _NONE], dtype=np.int64)
        self.pair_piece = np.array([*(pairs[k][1] for k in keys), 0], dtype=np.int64)
        self.char_code = np.arange(_LOOSE, _LOOSE + 0x110000, dtype=np.int64)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.char_code[ord(p)] = i
        self.begin, self.end = self.library.bos_id(), self.library.eos_id()
        self.control = {i for i, p in enumerate(proto.pieces) if p.type == 3}
        self.prefixed = {i for p, i in self.ids.items() if p.startswith(BLANK)}

    def agenda(self, text: str) -> list[int]:
        """Ids of one stretch, blanks already escaped."""
        symbols = list(text)
        score, n = self.score, len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = []
        for i in range(n - 1):
            joint = symbols[i] + symbols[i + 1]
            if joint in score:
                queue.append((-score[joint], i, i + 1, joint))
        heapq.heapify(queue)
        while queue:
            _, left, right, joint = heapq.heappop(queue)
            if symbols[left] is None or symbols[right] is None or after[left] != right or len(symbols[left]) + len(symbols[right]) != len(joint):
                continue  # one side has been merged away or has grown
            symbols[left], symbols[right] = joint, None
            after[left] = after[right]
            if after[right] >= 0:
                before[after[right]] = left
            for a, b in ((before[left], left), (left, after[left])):
                if a >= 0 and b >= 0:
                    joint = symbols[a] + symbols[b]
                    if joint in score:
                        heapq.heappush(queue, (-score[joint], a, b, joint))
        out: list[int] = []
        for s in symbols:
            if s is not None:
                found = self.ids.get(s)
                out.extend([found] if found is not None else [self.bytes[b] for b in s.encode()])
        return out

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        wanted = left << 23 | right
        at = np.searchsorted(self.pair_key, wanted)
        hit = self.pair_key[at] == wanted
        return np.where(hit, self.pair_rank[at], _NONE), self.pair_piece[at]

    def agendas(self, texts: list[str]) -> list[bytes]:
        """Little-endian ids of many stretches; in each step every stretch merges the best pair of its own agenda."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        symbol = self.char_code[np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4")]
        owner = np.repeat(np.arange(len(texts)), sizes)
        done_owner, done_symbol = [], []
        rank = np.full(len(symbol), _NONE, dtype=np.int64)
        piece = np.zeros(len(symbol), dtype=np.int64)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        rank[inner], piece[inner] = self._ranks(symbol[inner], symbol[inner + 1])
        while len(symbol):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            runs = np.diff(np.r_[starts, len(symbol)])
            best = np.minimum.reduceat(rank << 32 | np.arange(len(symbol)), starts)
            over = best >> 32 == _NONE
            at = best[~over] & 0xFFFFFFFF
            symbol[at] = piece[at]
            keep = np.ones(len(symbol), dtype=bool)
            keep[at + 1] = False
            if over.any():
                out = np.repeat(over, runs)
                done_owner.append(owner[out])
                done_symbol.append(symbol[out])
                keep &= ~out
            place = np.cumsum(keep) - 1
            symbol, owner, rank, piece, at = symbol[keep], owner[keep], rank[keep], piece[keep], place[at]
            rank[at] = _NONE
            right = at[at + 1 < len(symbol)]
            right = right[owner[right] == owner[right + 1]]
            rank[right], piece[right] = self._ranks(symbol[right], symbol[right + 1])
            left = at[at > 0] - 1
            left = left[owner[left] == owner[left + 1]]
            rank[left], piece[left] = self._ranks(symbol[left], symbol[left + 1])
        if not texts:
            return []
        owner, symbol = np.concatenate(done_owner), np.concatenate(done_symbol)
        order = np.argsort(owner, kind="stable")
        owner, symbol = owner[order], symbol[order]
        ends = np.cumsum(np.bincount(owner, minlength=len(texts)))
        loose = set(owner[symbol >= _LOOSE].tolist())
        flat, cuts = symbol.astype("<u4").tobytes(), (4 * ends).tolist()
        found = [flat[a:b] for a, b in zip([0, *cuts], cuts)]
        for k in loose:
            mine = np.frombuffer(found[k], "<u4").tolist()
            ids = [i for s in mine for i in ([s] if s < _LOOSE else [self.bytes[b] for b in chr(s - _LOOSE).encode()])]
            found[k] = np.array(ids, "<u4").tobytes()
        return found

    def decode(self, ids: np.ndarray | list[int]) -> str:
        """The text of any ids: control ids vanish, one leading blank of the first piece goes, broken bytes become replacement signs."""
        surface = self.surface
        joined = b"".join([surface[i] for i in ids])
        first = next((i for i in ids if i not in self.control), None)
        if first in self.prefixed:
            joined = joined[1:]
        return joined.decode("utf-8", "each_byte")


_STRETCH = re.compile(r" +[^ \n]*|[^ \n]+|\n")
_LOADED: dict[str, tuple[Pieces, dict, dict]] = {}  # of one vocabulary at a time


def stretches(text: str) -> list[str]:
    """The text with its dummy prefix, cut where no piece can reach over; empty for an empty text."""
    return _STRETCH.findall(" " + text.replace(BLANK, " ")) if text else []


def loaded(model: bytes) -> tuple[Pieces, dict, dict]:
    """The vocabulary, once for each worker, and two generations of remembered stretches, which a task leaves empty."""
    key = hashlib.sha256(model).hexdigest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = (Pieces(model), {}, {})
    return _LOADED[key]


def learn(pieces: Pieces, new: list[str], young: dict[str, bytes]) -> None:
    """Encode the stretches that are not remembered, and compare all of them with the library.

    A stretch that begins with a blank is given to the library without it: the library puts one in front itself. Others cannot be given on
    their own, so they go behind a word that ends before them and cannot merge with them: nothing merges over a newline."""
    lead = pieces.library.encode("\n")
    short = [s for s in new if len(s) <= SHORT]
    long = [s for s in new if len(s) > SHORT]
    ours = pieces.agendas([s.replace(" ", BLANK) for s in short])
    ours += [np.array(pieces.agenda(s.replace(" ", BLANK)), "<u4").tobytes() for s in long]
    names = short + long
    expected = pieces.library.encode([s[1:] if s[0] == " " else "\n" + s for s in names])
    prefix = np.array(lead, "<u4").tobytes()
    for s, mine, ids in zip(names, ours, expected):
        theirs = struct.pack(f"<{len(ids)}I", *ids)
        # the library gives nothing for an empty text, so a lone blank, which is a piece of its own, has no counterpart
        if s != " " and theirs != (mine if s[0] == " " else prefix + mine):
            raise ValueError(f"encoding differs from the library's for {s!r}")
        young[s] = mine


def encode_batch(texts: list[bytes | str], model: bytes) -> Iterator[bytes]:
    """Little-endian 32-bit ids of each whole text, with begin and end ids; texts are taken up together by about CHECK_BYTES."""
    pieces, young, old = loaded(model)
    begin, end = np.array([pieces.begin], "<u4").tobytes(), np.array([pieces.end], "<u4").tobytes()
    at = 0
    while at < len(texts):
        cut, parts, size = [], [], 0
        while at < len(texts) and size < CHECK_BYTES:
            text = texts[at] if isinstance(texts[at], str) else texts[at].decode()
            found = stretches(text)
            size += len(text)
            parts += found
            cut.append(len(parts))
            at += 1
        new = [p for p in set(parts) if p not in young]
        young.update({p: old[p] for p in new if p in old})
        learn(pieces, [p for p in new if p not in old], young)
        known = [young[p] for p in parts]
        pieces.held += sum(250 + 8 * len(p) for p in new)
        for p in new:
            if len(p) > SHORT:
                del young[p]
        for a, b in zip([0, *cut], cut):
            yield b"".join([begin, *known[a:b], end])
        if pieces.held > REMEMBER // 2:
            pieces.held = 0
            old.clear()
            old.update(young)
            young.clear()


def encode(docs: DataFrame, model: bytes, id_column: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per document: its id, ids (array of int, begin and end ids included), n_tokens, ids_sha256, decoded, decoded_sha256.

    Null and empty texts give the begin and end ids and decode to the empty text; repeated rows give repeated rows; an empty table gives none;
    other columns are not read. with_ids=False leaves out ids and decoded and returns the digests only."""
    kind = docs.schema[id_column].dataType.simpleString()
    fields = [f"{id_column} {kind}", "n_tokens long", "ids_sha256 string", "decoded_sha256 string"]
    fields += ["ids array<int>", "decoded string"] if with_ids else []

    names = [f.split(" ")[0] for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(model)[0]
        for batch in batches:
            keys, at, size = batch.column(0), 0, 0
            rows: list[list] = [[] for _ in names[1:]]

            def made(end: int) -> pa.RecordBatch:
                types = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()]
                columns = [pa.array(c, t) for c, t in zip(rows, types)]
                return pa.RecordBatch.from_arrays([keys.slice(at, end - at), *columns], names=names)

            for k, packed in enumerate(encode_batch(list(texts_of(batch.column(1))), model), 1):
                ids = np.frombuffer(packed, dtype="<u4")
                back = pieces.decode(ids.tolist())
                values = [len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), ids.astype(np.int32), back]
                for column, value in zip(rows, values):
                    column.append(value)
                size += len(packed) + len(back) if with_ids else 64
                if size > CHECK_BYTES:
                    yield made(k)
                    rows, at, size = [[] for _ in names[1:]], k, 0
            if at < len(keys):
                yield made(len(keys))
        pieces.held = 0
        for remembered in loaded(model)[1:]:  # the worker goes on to other tasks, maybe of other kinds
            remembered.clear()

    return small_batches(docs).select(F.col(id_column), F.col(text)).mapInArrow(run, ", ".join(fields))
