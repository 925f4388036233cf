"""Toxicity: averaged subword-bag embeddings under a linear softmax, trained jointly in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import by_bytes, small_batches, utf8_buffer

#: Toxic rows that training takes at most, and three times as many others: the bound of what reaches the driver.
TRAIN_ROWS = 600
GRAMS = (3, 4, 5)
WINDOW_WORDS = 32
SPACE = 32
#: Byte classes: ASCII letters in lower case, digits and bytes of other alphabets stay, the rest separates words.
FOLD = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else SPACE for b in range(256)], dtype=np.uint8)


@dataclass
class Bag:
    """Subwords of a run of texts, at the byte where each begins.

    For each length in GRAMS: hashed ids of the windows of that length that lie within one
    word and its two borders, and where they are valid. bounds: the first byte of each
    window of words; text_of: the text of each window.
    """

    ids: list[np.ndarray]
    valid: list[np.ndarray]
    bounds: np.ndarray
    text_of: np.ndarray
    length: int


def subwords(raw: np.ndarray, offsets: np.ndarray, bits: int, window_words: int = WINDOW_WORDS) -> Bag:
    """Cut texts (concatenated bytes and n + 1 offsets) into windows of words and hash their subwords."""
    n = len(offsets) - 1
    lengths = np.diff(offsets)
    text = np.full(len(raw) + n + 1 + max(GRAMS), SPACE, np.uint8)
    begin = offsets[:-1] + np.arange(n) + 1
    text[np.arange(len(raw)) + np.repeat(np.arange(n) + 1, lengths)] = FOLD[raw]
    gap = text == SPACE
    starts = np.flatnonzero(gap[:-1] & ~gap[1:])
    owner = np.searchsorted(begin, starts + 1, side="right") - 1
    first = np.searchsorted(owner, np.arange(n))
    turn = (np.arange(len(starts)) - first[owner]) % window_words == 0 if len(starts) else np.zeros(0, bool)
    size = len(text) - max(GRAMS)
    gaps = np.concatenate([[0], np.cumsum(gap, dtype=np.int32)])
    ids, valid = [], []
    t = text.astype(np.uint32)
    for g in GRAMS:
        h = np.full(size, g, np.uint32)
        for k in range(g):
            h *= np.uint32(0x01000193)
            h ^= t[k : k + size]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h ^= h >> np.uint32(13)
        ids.append(h & np.uint32((1 << bits) - 1))
        valid.append(gaps[g - 1 : g - 1 + size] == gaps[1 : 1 + size])
    return Bag(ids, valid, starts[turn], owner[turn], size)


@dataclass
class SubwordSoftmax:
    """Label probabilities from the mean embedding of a window's subwords; a text takes its worst window.

    Word windows keep one insult in a long text from being averaged away. Only the
    difference of the two softmax rows matters, so at scoring time every subword is one number.
    """

    bits: int = 17
    dim: int = 8
    rounds: int = 120
    refresh: int = 4
    rate: float = 0.6
    shrink: float = 0.002
    seed: int = 5
    embeddings: np.ndarray | None = None
    weights: np.ndarray | None = None
    bias: np.ndarray | None = None
    prior: float = 0.0

    def fit(self, texts: list[bytes], labels: np.ndarray) -> SubwordSoftmax:
        """Gradient steps on one window of each text, picked again every few rounds.

        The pick is the window with the highest logit plus noise that fades, so early rounds
        see all of a text and late ones what looks worst in it. Steps are scaled by the
        largest gradient, not per bucket, so subwords of a few texts hardly move.
        """
        rng = np.random.default_rng(self.seed)
        self.embeddings = rng.normal(0, 0.01, (1 << self.bits, self.dim)).astype(np.float32)
        self.weights = np.stack([-np.ones(self.dim), np.ones(self.dim)], axis=1).astype(np.float32) / np.sqrt(self.dim, dtype=np.float32)
        p = float(np.clip(labels.mean() if len(labels) else 0.0, 0.01, 0.99))
        self.bias = np.array([np.log(1 - p) / 2, np.log(p) / 2], dtype=np.float32)
        self.prior = p
        if not len(labels) or labels.min() == labels.max():
            self.weights[:] = 0
            return self
        ids, bounds, text_of = self._training_windows(texts)
        there = np.unique(text_of)
        y = labels[there]
        n = len(there)
        speed = np.zeros_like(self.embeddings)
        for step in range(self.rounds if n else 0):
            if step % self.refresh == 0:
                noise = rng.gumbel(size=len(text_of)) * max(0.0, 2.0 * (1 - 1.5 * step / self.rounds))
                best = np.lexsort((-(self._window_logits(ids, bounds) + noise), text_of))
                best = best[np.r_[True, text_of[best][1:] != text_of[best][:-1]]]
                size = bounds[best + 1] - bounds[best]
                u = np.repeat(np.arange(n), size)
                i = ids[np.repeat(bounds[best] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(len(u))]
                count = np.maximum(size, 1).astype(np.float32)[:, None]
            hidden = np.stack([np.bincount(u, self.embeddings[i, d], n) for d in range(self.dim)], axis=1) / count
            scores = hidden @ self.weights + self.bias
            scores -= scores.max(1, keepdims=True)
            delta = np.exp(scores)
            delta /= delta.sum(1, keepdims=True)
            delta[np.arange(n), y] -= 1
            back = delta @ self.weights.T / count
            grad = np.stack([np.bincount(i, back[u, d], 1 << self.bits) for d in range(self.dim)], axis=1)
            speed = (0.8 * speed + grad / max(float(np.abs(grad).max()), 1e-12)).astype(np.float32)
            self.embeddings = (self.embeddings * (1 - self.shrink) - self.rate * speed).astype(np.float32)
            self.weights -= (0.05 * hidden.T @ delta / n).astype(np.float32)
            self.bias -= (0.5 * delta.mean(0)).astype(np.float32)
        return self

    def _training_windows(self, texts: list[bytes], most: int = 512 << 10) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Subword ids of all windows, where each window begins among them, and its text; hashed about ``most`` bytes at a time."""
        ids, counts, owners = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        at = 0
        while at < len(texts):
            end, size = at + 1, len(texts[at])
            while end < len(texts) and size + len(texts[end]) <= most:
                size += len(texts[end])
                end += 1
            sizes = np.array([len(x) for x in texts[at:end]])
            bag = subwords(np.frombuffer(b"".join(texts[at:end]), np.uint8), np.r_[0, np.cumsum(sizes)].astype(np.int64), self.bits)
            if len(bag.bounds):
                ids.append(np.stack(bag.ids, axis=1)[np.stack(bag.valid, axis=1)])
                counts.append(sum(np.add.reduceat(v.astype(np.int64), bag.bounds) for v in bag.valid))
                owners.append(bag.text_of + at)
            at = end
        return np.concatenate(ids), np.r_[0, np.cumsum(np.concatenate(counts))], np.concatenate(owners)

    def _per_subword(self) -> np.ndarray:
        return (self.embeddings @ (self.weights[:, 1] - self.weights[:, 0])).astype(np.float32)

    def _window_logits(self, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        n = np.diff(bounds)
        if not len(ids):
            return np.full(len(n), float(self.bias[1] - self.bias[0]))
        total = np.add.reduceat(self._per_subword()[ids], np.minimum(bounds[:-1], len(ids) - 1))
        return np.where(n > 0, total / np.maximum(n, 1), 0.0) + float(self.bias[1] - self.bias[0])

    def scorer(self) -> WindowScorer:
        return WindowScorer(self.bits, self._per_subword(), float(self.bias[1] - self.bias[0]), self.prior)


@dataclass
class WindowScorer:
    """What scoring needs of a trained model: one number per subword bucket (2**bits floats)."""

    bits: int
    per_subword: np.ndarray
    bias: float
    prior: float

    def __call__(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        bag = subwords(raw, offsets, self.bits)
        worst = np.full(len(offsets) - 1, -np.inf)
        if len(bag.bounds):
            value, count = np.zeros(bag.length, np.float32), np.zeros(bag.length, np.int32)
            for ids, valid in zip(bag.ids, bag.valid, strict=True):
                value += np.where(valid, self.per_subword[ids], np.float32(0))
                count += valid
            n = np.add.reduceat(count, bag.bounds)
            logit = np.add.reduceat(value.astype(np.float64), bag.bounds) / np.maximum(n, 1) + self.bias
            np.maximum.at(worst, bag.text_of, logit)
        none = np.isinf(worst)
        score = 1 / (1 + np.exp(-np.where(none, 0, worst)))
        return np.where(none, min(self.prior, 0.49), score)


def score_toxicity(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every whole text for toxicity.

    Rows whose crc32 of the id modulo 5 is 0 are held out; from the others, at most
    ``train_rows`` toxic and three times as many other labelled texts, in the order of a hash
    of the id, train the model on the driver. Scores use the text alone.

    Defined cases: null and empty texts, and texts without words, score the training share
    of toxic rows (below one half); an id with several labels counts as toxic if one says so;
    null ids and null labels train nothing; without both labels every text scores the prior;
    an empty table gives no rows.
    """
    remainder = lambda c: F.pmod(F.crc32(F.col(c).cast("string").cast("binary")), F.lit(5))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "toxic")
    known = known.where(remainder("doc_id") != 0).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.withColumn("_o", F.xxhash64("doc_id"))
    seen = known.where("toxic = 1").orderBy("_o", "doc_id").limit(train_rows).unionByName(known.where("toxic <> 1").orderBy("_o", "doc_id").limit(3 * train_rows))
    seen = rows.join(F.broadcast(seen), "doc_id").orderBy("_o", "doc_id", "text").select("text", "toxic").limit(8 * train_rows).collect()
    model = SubwordSoftmax().fit([(r["text"] or "").encode() for r in seen], np.array([int(r["toxic"] == 1) for r in seen], dtype=np.int64))
    scorer = model.scorer()

    def run(batches):
        for batch in by_bytes(batches, "text", 2 << 20):
            score = scorer(*utf8_buffer(batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    held = rows.select("doc_id", F.coalesce(remainder("doc_id") == 0, F.lit(False)).alias("held_out"), "text")
    return small_batches(held).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
