"""Toxicity: a bidirectional gated recurrent network with attention pooling over word and character inputs, trained in numpy, that scores all
overlapping windows of a text.

A word enters as its own vector, if it was frequent enough in the training sample, beside the mean vector of its hashed character trigrams. A text is read in
blocks of SPAN words; attention pools every run of LENGTH words in a block, and blocks overlap so that every run of the text lies in just one. So the windows,
one from each word on, share their block's states, and all of them cost as much as a few. Training sees documents as bags of windows: the bag's logit is
the log-sum-exp of its windows', so that one toxic stretch makes a document toxic and the others are left alone. A document's score is that of its worst window, with the logit moved back to the corpus's share of toxic labels. The network is fitted on the driver
on a sample of bounded size (PER_CLASS documents, TEXT characters; documents are left out whole, their texts are not cut); training and scoring read every
word of a document."""

from __future__ import annotations

import warnings
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoteflow.llm.common import packed, settle, small_batches, unpacked

#: words of a window, of a block, and between starts of blocks
LENGTH, SPAN = 24, 64
STEP = SPAN - LENGTH + 1
#: the training sample: documents of label 0 and 1 at most, and characters of all documents of a label, on the driver
PER_CLASS, TEXT = (4000, 2000), 1 << 26
#: sizes: word vectors, character vectors, state of each direction, attention; buckets of trigrams
WORD, CHAR, STATE, ATTEND, BUCKETS = 12, 8, 8, 8, 4096
#: score from which a document counts as toxic; a word's own vector needs this many documents of the sample, and one in so many
THRESHOLD, LEAST_DOCS, ONE_IN = 0.3, 3, 300
STEPS, BATCH, RATE, DECAY, SEED = 300, 48, 0.01, 0.3, 7
#: characters of texts that are scored together, blocks that step together
CHUNK, TOGETHER = 1 << 20, 1536

#: a character of a word, as str.split() tells them
_WORD = r"[^\s\x1c-\x1f\x85\p{Z}]"
_EDGE = ".,;:!?%*&$#|\"'()[]{}<>-_/\\~`^+=“”«»„…"


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all trigrams of ^word$, and where each word's begin."""
    codes = np.frombuffer("".join(f"^{w or ' '}$" for w in words).encode("utf-32-le"), "<u4").astype(np.uint64)
    sizes = np.fromiter((len(w or " ") for w in words), np.int64, len(words))
    starts = np.cumsum(sizes + 2) - sizes - 2
    keep = np.ones(len(codes), dtype=bool)
    keep[starts + sizes] = keep[starts + sizes + 1] = False
    at = np.flatnonzero(keep)
    mixed = (codes[at] * np.uint64(1_000_003) + codes[at + 1]) * np.uint64(1_000_003) + codes[at + 2]
    mixed = (mixed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
    return (mixed % np.uint64(BUCKETS)).astype(np.int64), np.cumsum(sizes) - sizes


def _squash(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _window_sums(v: np.ndarray) -> np.ndarray:
    """Sums over every LENGTH neighbours along the second axis, put together from sums over powers of two."""
    out, at, count = 0, 0, v.shape[1] - LENGTH + 1
    for bit in range(LENGTH.bit_length()):
        if LENGTH >> bit & 1:
            out, at = out + v[:, at : at + count], at + (1 << bit)
        v = v[:, : -(1 << bit)] + v[:, 1 << bit :]
    return out


def _window_spread(v: np.ndarray) -> np.ndarray:
    """What each place gets of its windows: the transpose of `_window_sums`."""
    pad = [(0, 0), (LENGTH - 1, LENGTH - 1)] + [(0, 0)] * (v.ndim - 2)
    return _window_sums(np.pad(v, pad))


def open_windows(mask: np.ndarray) -> np.ndarray:
    """Which windows of a block there are: those whole within its words, and the one of a block with fewer words than a window."""
    starts = np.arange(STEP)
    return (starts + LENGTH <= mask.sum(axis=1)[:, None]) | (starts == 0)


class Network:
    def __init__(self, words: list[str], seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.vocabulary = {w: i + 1 for i, w in enumerate(words)}
        size, inner = WORD + CHAR, 2 * STATE

        def normal(*shape, scale):
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        self.w = {"word": normal(len(words) + 1, WORD, scale=0.1), "char": normal(BUCKETS, CHAR, scale=0.1)}
        for d in "fb":
            self.w |= {f"in_{d}": normal(size, 3 * STATE, scale=0.3), f"own_{d}": normal(STATE, 3 * STATE, scale=0.3), f"bias_{d}": np.zeros(3 * STATE, np.float32)}
        self.w |= {"attend": normal(inner, ATTEND, scale=0.3), "attend_bias": np.zeros(ATTEND, np.float32), "query": normal(ATTEND, scale=0.3)}
        self.w |= {"out": normal(inner, scale=0.3), "out_bias": np.full(1, -3.0, np.float32)}
        self.shift = 0.0

    def inputs(self, tokens: list[str]) -> tuple[np.ndarray, tuple]:
        """A row for each distinct token, after a row of zeros for padding."""
        bare = [t.strip(_EDGE) or t for t in tokens]
        rows = np.fromiter((self.vocabulary.get(t, 0) for t in bare), np.int64, len(bare))
        grams, starts = trigrams(bare)
        counts = np.diff(np.r_[starts, len(grams)])[:, None].astype(np.float32)
        x = np.zeros((len(tokens) + 1, WORD + CHAR), np.float32)
        if tokens:
            x[1:, :WORD] = self.w["word"][rows] * (rows > 0)[:, None]
            x[1:, WORD:] = np.add.reduceat(self.w["char"][grams], starts, axis=0) / counts
        return x, (rows, grams, starts, counts)

    def _run(self, d: str, x: np.ndarray, ids: np.ndarray, mask: np.ndarray, kept: list | None) -> np.ndarray:
        given = x @ self.w[f"in_{d}"] + self.w[f"bias_{d}"]
        own, h = self.w[f"own_{d}"], np.zeros((len(ids), STATE), np.float32)
        states = np.empty((*ids.shape, STATE), np.float32)
        full = bool(mask.all())
        for t in range(ids.shape[1]) if d == "f" else reversed(range(ids.shape[1])):
            g, u = given[ids[:, t]], h @ own
            gates = _squash(g[:, : 2 * STATE] + u[:, : 2 * STATE])
            z, r = gates[:, :STATE], gates[:, STATE:]
            n = np.tanh(g[:, 2 * STATE :] + r * u[:, 2 * STATE :])
            new = n + z * (h - n)
            if not full:
                new = np.where(mask[:, t, None], new, h)
            if kept is not None:
                kept.append((t, h, z, r, n, u[:, 2 * STATE :]))
            states[:, t], h = new, new
        return states

    def forward(self, x: np.ndarray, ids: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logit of each window of each block; `open_windows` tells which there are."""
        kept = {"f": [], "b": []} if keep else {"f": None, "b": None}
        states = np.concatenate([self._run(d, x, ids, mask, kept[d]) for d in "fb"], axis=2)
        act = np.tanh(states @ self.w["attend"] + self.w["attend_bias"])
        score = np.where(mask, act @ self.w["query"], -1e9)
        odds = np.exp(score - score.max(axis=1, keepdims=True)) * mask
        total = np.maximum(_window_sums(odds), 1e-30)
        pooled = _window_sums(odds[:, :, None] * states) / total[:, :, None]
        logits = pooled @ self.w["out"] + self.w["out_bias"][0]
        return (logits, (states, act, odds, total, pooled, kept)) if keep else logits

    def gradients(self, x, source, ids, mask, cache, back: np.ndarray) -> dict[str, np.ndarray]:
        """Of the loss, given its derivative by each window's logit."""
        states, act, odds, total, pooled, kept = cache
        g = {"out": np.tensordot(back, pooled, ([0, 1], [0, 1])), "out_bias": np.array([back.sum()], np.float32)}
        d_sums = back[:, :, None] * self.w["out"] / total[:, :, None]
        d_weighted = _window_spread(d_sums)
        d_score = odds * (_window_spread(-(d_sums * pooled).sum(axis=2)) + (d_weighted * states).sum(axis=2))
        g["query"] = np.einsum("bta,bt->a", act, d_score)
        d_act = d_score[:, :, None] * self.w["query"] * (1 - act * act)
        g["attend"], g["attend_bias"] = np.tensordot(states, d_act, ([0, 1], [0, 1])), d_act.sum(axis=(0, 1))
        d_states = odds[:, :, None] * d_weighted + d_act @ self.w["attend"].T
        d_x = np.zeros_like(x)
        for k, d in enumerate("fb"):
            own, after = self.w[f"own_{d}"], np.zeros((len(ids), STATE), np.float32)
            g_own, d_given = np.zeros_like(own), np.zeros((len(x), 3 * STATE), np.float32)
            for t, h, z, r, n, u in reversed(kept[d]):
                total = d_states[:, t, k * STATE : (k + 1) * STATE] + after
                live = mask[:, t, None]
                d_n = total * (1 - z) * (1 - n * n) * live
                d_z = total * (h - n) * z * (1 - z) * live
                d_r = d_n * u * r * (1 - r)
                d_u = np.concatenate([d_z, d_r, d_n * r], axis=1)
                g_own += h.T @ d_u
                np.add.at(d_given, ids[:, t], np.concatenate([d_z, d_r, d_n], axis=1))
                after = np.where(live, total * z, total) + d_u @ own.T
            g[f"own_{d}"], g[f"bias_{d}"], g[f"in_{d}"] = g_own, d_given.sum(axis=0), x.T @ d_given
            d_x += d_given @ self.w[f"in_{d}"].T
        rows, grams, starts, counts = source
        g["word"], g["char"] = np.zeros_like(self.w["word"]), np.zeros_like(self.w["char"])
        np.add.at(g["word"], rows, d_x[1:, :WORD])
        g["word"][0] = 0
        np.add.at(g["char"], grams, np.repeat(d_x[1:, WORD:] / counts, counts[:, 0].astype(int), axis=0))
        return g


def block_starts(n: int) -> range:
    """Starts of the blocks of n words: every window lies in the block of the last start that is not behind its own."""
    return range(0, max(1, n - LENGTH + 1), STEP)


def _bag_arrays(bags: list[list[str]]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Distinct tokens, ids of the blocks' words (0 pads), mask, bag of each block."""
    known: dict[str, int] = {}
    blocks = [(k, words[s : s + SPAN]) for k, words in enumerate(bags) for s in block_starts(len(words))]
    ids = np.zeros((len(blocks), SPAN), dtype=np.int64)
    for row, (_, words) in zip(ids, blocks):
        row[: len(words)] = [known.setdefault(t, len(known)) + 1 for t in words]
    return list(known), ids, ids > 0, np.array([k for k, _ in blocks])


class Bags:
    """The words of each text, made when they are asked for."""

    def __init__(self, texts: list[str]):
        self.texts = texts

    def __len__(self) -> int:
        return len(self.texts)

    def __getitem__(self, k: int) -> list[str]:
        return self.texts[k].lower().split()


def train(bags: Bags | list[list[str]], labels: list[int], share: float, steps: int = STEPS, seed: int = SEED) -> Network:
    """Fit on documents' words. share: of label 1 in the corpus, to which the scores are moved back."""
    use = Counter(w for bag in bags for w in {t.strip(_EDGE) or t for t in bag})
    network, rng = Network(sorted(w for w, n in use.items() if n >= max(LEAST_DOCS, len(bags) // ONE_IN)), seed), np.random.default_rng(seed)
    y = np.array(labels, dtype=np.float32)
    first, second = ({k: np.zeros_like(v) for k, v in network.w.items()} for _ in range(2))
    order: list[int] = []
    for step in range(1, steps + 1):
        if len(order) < BATCH:
            order = rng.permutation(len(bags)).tolist() + order
        chosen, order = order[-BATCH:], order[:-BATCH]
        tokens, ids, mask, bag = _bag_arrays([bags[k] for k in chosen])
        x, source = network.inputs(tokens)
        drop = rng.random(len(x)) < 0.1  # now and then a word must be known by its characters
        x[drop, :WORD] = 0
        # a step takes any number of blocks: logits of all first, then the gradient of TOGETHER blocks at a time
        parts = [slice(k, k + TOGETHER) for k in range(0, len(ids), TOGETHER)]
        logits, cache = network.forward(x, ids, mask, keep=True) if len(parts) == 1 else (np.concatenate([network.forward(x, ids[p], mask[p]) for p in parts]), None)
        there = open_windows(mask)
        found, bag = logits[there], np.repeat(bag, there.sum(axis=1))
        starts = np.flatnonzero(np.r_[True, bag[1:] != bag[:-1]])
        top = np.maximum.reduceat(found, starts)[bag]
        odds = np.exp(found - top)
        total = np.add.reduceat(odds, starts)[bag]
        loss_back = np.zeros(there.shape, dtype=np.float32)
        # a word lies in LENGTH windows: taken off, so that a bag's logit is near that of its worst window, which scores it
        alike = np.log(np.minimum(LENGTH, np.bincount(bag, minlength=len(chosen))))[bag]
        loss_back[there] = (_squash(top + np.log(total) - alike) - y[chosen][bag]) * odds / total / len(chosen)
        grads: dict[str, np.ndarray] = {}
        for p in parts:
            found = network.gradients(x, source, ids[p], mask[p], cache or network.forward(x, ids[p], mask[p], keep=True)[1], loss_back[p])
            grads = {k: grads[k] + g for k, g in found.items()} if grads else found
        rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
        for name, g in grads.items():
            first[name] = 0.9 * first[name] + 0.1 * g
            second[name] = 0.999 * second[name] + 0.001 * g * g
            if name in ("word", "char"):
                network.w[name] *= 1 - rate * DECAY
            network.w[name] -= (rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    seen = min(max(float(y.mean()), 1e-6), 1 - 1e-6)
    network.shift = float(np.log(share / (1 - share)) - np.log(seen / (1 - seen)))
    return network


def score_texts(network: Network | None, texts: list[str]) -> np.ndarray:
    """Scores from 0 to 1: the worst window's. Texts without words score 0, and so does everything without a network."""
    out, at = np.zeros(len(texts)), 0
    while network is not None and at < len(texts):
        known: dict[str, int] = {}
        ids, starts, ends, owner, size = [], [], [], [], 0
        while at < len(texts) and size < CHUNK:
            words = texts[at].lower().split()
            if words:
                mine = block_starts(len(words))
                starts += [len(ids) + s for s in mine]
                ends += [len(ids) + len(words)] * len(mine)
                owner += [at] * len(mine)
                ids += [known.setdefault(w, len(known)) + 1 for w in words]
            size += len(texts[at])
            at += 1
        if not ids:
            continue
        x, _ = network.inputs(list(known))
        flat = np.array(ids + [0] * SPAN)
        for k in range(0, len(starts), TOGETHER):
            place = np.array(starts[k : k + TOGETHER])[:, None] + np.arange(SPAN)
            mask = place < np.array(ends[k : k + TOGETHER])[:, None]
            logits = network.forward(x, np.where(mask, flat[place], 0), mask)
            worst = np.where(open_windows(mask), logits, -np.inf).max(axis=1)
            np.maximum.at(out, owner[k : k + TOGETHER], 1 / (1 + np.exp(-(worst.astype(np.float64) + network.shift))))
    return out


def held_out(id_column: str):
    return F.pmod(F.crc32(F.col(id_column).cast("string")), F.lit(4)) == 2


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "toxic") -> Network | None:
    """Train on labelled documents that are not held out. None if either label is missing among them.

    Of several labels for one id the largest counts; null ids and labels are left out. The sample takes ids that docs has with a word, by a
    hash, up to PER_CLASS and TEXT of each label; one text of each, that of smallest hash if an id repeats, whole."""
    known = labels.where(F.col(id_column).isNotNull() & F.col(label).isNotNull()).where(~held_out(id_column))
    known = known.groupBy(F.col(id_column).alias("_id")).agg(F.max((F.col(label) > 0).cast("int")).alias("_toxic"))
    share = known.agg(F.avg("_toxic").alias("share")).first()["share"]
    rows = docs.select(F.col(id_column).alias("_id"), F.col(text).alias("text")).where(F.col("text").rlike(_WORD))
    known = settle(known.join(rows.select("_id").distinct(), "_id", "left_semi"))
    hashed = F.xxhash64(F.lit(SEED), "_id")
    sample = None
    for value, most in enumerate(PER_CLASS):
        part = known.where(F.col("_toxic") == value).orderBy(hashed, "_id").limit(most)
        sample = part if sample is None else sample.unionByName(part)

    chosen = rows.join(F.broadcast(sample), "_id")  # at most sum(PER_CLASS) ids
    chosen = chosen.groupBy("_id").agg(F.max("_toxic").alias("toxic"), F.min_by("text", F.xxhash64("text")).alias("text"))
    chosen = settle(chosen.select("toxic", "text", hashed.alias("place")))
    sizes = chosen.select("toxic", "place", F.length("text").alias("size")).toPandas().sort_values("place", ignore_index=True)
    within = sizes[sizes.groupby("toxic")["size"].cumsum() - sizes["size"] < TEXT].groupby("toxic")["place"].max()
    if share is None or len(within) < 2:
        return None
    rows = chosen.where(F.col("place") <= F.when(F.col("toxic") == 1, F.lit(int(within[1]))).otherwise(F.lit(int(within[0])))).toPandas()
    rows = rows.sort_values(["place", "text"])
    return train(Bags(rows["text"].tolist()), rows["toxic"].tolist(), min(max(share, 1e-6), 1 - 1e-6))


def scored(docs: DataFrame, network: Network | None, text: str = "text", name: str = "score") -> DataFrame:
    """All rows and columns of docs and their score; null text counts as empty."""

    @F.pandas_udf("double")
    def of(values: pd.Series) -> pd.Series:
        return pd.Series(score_texts(network, [t if isinstance(t, str) else "" for t in values]))

    return small_batches(docs).withColumn(name, of(F.col(text)))


def judge(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Null and empty texts score 0; repeated rows are scored each; a null id is not held out; without labels of both kinds every score is 0; an
    empty table gives no rows; other columns are not read."""
    network = fit(docs, labels, id_column, text)
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"))
    marked = scored(rows, network).select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score")
    return marked.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def clean(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows and columns of docs that are not predicted toxic. Without labels of both kinds all rows stay, with a warning."""
    network = fit(docs, labels, id_column, text)
    if network is None:
        warnings.warn("labels of both kinds are missing among the documents: none is removed", stacklevel=2)
    kept = scored(packed(docs, _text=F.col(text)), network, "_text", "_score").where(F.col("_score") < THRESHOLD)
    return unpacked(kept, docs)
