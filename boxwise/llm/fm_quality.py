"""Operator 5: quality classifier, a second-order factorisation machine.

Inputs of a score are the text alone: hashed words, hashed word shapes, structure statistics, and what the text says of itself
(lengths in bytes, words and lines). score = sigmoid(w0 + x.w + 1/2 sum_f ((x.V_f)^2 - x^2.V_f^2)), the sum-of-squares identity, so it is
linear in the number of inputs. Labels are learnt from at most TRAIN_ROWS labelled rows, those with the least md5 of their id.

Edge cases: a null text is an empty text and is scored; an id that repeats in the labels has its least label, one that repeats in the
documents is learnt from its least text; rows without an id are scored, never learnt from; without any label all scores are 0.5; further columns are ignored."""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxwise.llm.common import cut, mapped, or_empty, text_blocks, text_key, without

#: Bound on the labelled rows that are learnt from.
TRAIN_ROWS = 6000
WORD_BUCKETS, SHAPE_BUCKETS, STATS = 512, 128, 24
WIDTH = WORD_BUCKETS + SHAPE_BUCKETS + STATS
RANK, EPOCHS, BATCH, RATE = 6, 24, 256, 0.02
KEEP = 0.7
_LETTER = re.compile(r"[^\W\d_]")


def _shape(word: str) -> int:
    """A bucket for the case, the kind of characters and the last character of a word."""
    last = word[-1]
    kinds = word.isupper() + 2 * word.islower() + 4 * word.istitle() + 8 * word.isalpha() + 16 * word.isdigit()
    return (kinds + 32 * (0 if last.isalnum() else 1 + ord(last) % 61)) * 2654435761 % (1 << 32) * SHAPE_BUCKETS >> 32


class Places(dict):
    """A word's kind, shape bucket and word bucket, 16 bits each; remembered up to a bound."""

    LIMIT = 100_000

    def __missing__(self, word: str) -> int:
        if len(self) > self.LIMIT:
            self.clear()
        low = word.lower().strip(".,;:!?")
        kind = (word.isupper() and len(word) > 1) + 2 * (not word[-1:].isalnum() and word[-1:] not in ".,;:?") + 4 * (_LETTER.search(word) is None) + 8 * (word != low)
        found = self[word] = kind << 32 | _shape(word) << 16 | crc32(low.encode("utf-8", "surrogatepass")) % WORD_BUCKETS
        return found


def features(texts: list[str], places: Places) -> np.ndarray:
    x = np.zeros((len(texts), WIDTH), np.float32)
    for k, text in enumerate(texts):
        own = text.split()
        n = len(own)
        lines = text.split("\n")
        stats = x[k, WORD_BUCKETS + SHAPE_BUCKETS :]
        stats[0] = np.log1p(n) / 10
        stats[1] = np.log1p(len(text)) / 12
        stats[2] = np.log1p(len(lines)) / 6
        stats[3] = n == 0
        if not n:
            continue
        packed = np.fromiter(map(places.__getitem__, own), np.int64, n)
        word, shape, kind = packed & 0xFFFF, packed >> 16 & 0xFFFF, packed >> 32
        x[k, :WORD_BUCKETS] = np.sqrt(np.bincount(word, minlength=WORD_BUCKETS) / n)
        x[k, WORD_BUCKETS : WORD_BUCKETS + SHAPE_BUCKETS] = np.sqrt(np.bincount(shape, minlength=SHAPE_BUCKETS) / n)
        stats[4] = (kind & 1).mean()
        stats[5] = (kind & 2).mean() / 2
        stats[6] = (kind & 4).mean() / 4
        stats[7] = (kind & 8).mean() / 8
        distinct = len(set(own))
        stats[8] = distinct / n
        stats[9] = len(set(lines)) / len(lines)
        length = len(text)
        stats[10] = 10 * text.count("|") / length
        stats[11] = 10 * text.count("!") / length
        stats[12] = sum(text.count(c) for c in "#%&$*") * 4 / length
        stats[13] = sum(map(len, own)) / n / 12
        stats[14] = 10 * text.count(".") / length
        stats[15] = sum(1 < len(s) < 30 for s in lines) / len(lines)
        stats[16] = sum(s[-1:] in (".", "!", "?") for s in lines) / len(lines)
        pairs = len(set(zip(own, own[1:], strict=False)))
        stats[17] = pairs / max(1, n - 1)
        stats[18] = n < 20
        stats[19] = (kind & 1).max() + (kind & 2).max() / 2
        longest = max(map(len, own))
        stats[20] = np.log1p(longest) / 6
        stats[21] = np.sqrt(stats[4])
        stats[22] = np.sqrt(stats[5])
        stats[23] = 1 - stats[8] if n >= 50 else 0
    return x


class Model:
    """w0, w and V of a factorisation machine, with the scale of its inputs."""

    def __init__(self, w0: float = 0.0, w: np.ndarray | None = None, v: np.ndarray | None = None, mean=None, scale=None):
        self.w0 = w0
        self.w = np.zeros(WIDTH, np.float32) if w is None else w
        self.v = np.zeros((WIDTH, RANK), np.float32) if v is None else v
        self.mean = np.zeros(WIDTH, np.float32) if mean is None else mean
        self.scale = np.ones(WIDTH, np.float32) if scale is None else scale

    def margins(self, x: np.ndarray) -> np.ndarray:
        x = (x - self.mean) * self.scale
        return self.w0 + x @ self.w + 0.5 * (((x @ self.v) ** 2) - (x**2) @ (self.v**2)).sum(axis=1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(x).astype(np.float64), -30, 30)))


def train(x: np.ndarray, y: np.ndarray, seed: int = 11, decay: float = 1e-3) -> Model:
    """Adam on the logistic loss; inputs are centred and scaled."""
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(axis=0), 1 / np.maximum(x.std(axis=0), 0.02)
    z = ((x - mean) * scale).astype(np.float32)
    params = [np.zeros(1, np.float32), np.zeros(WIDTH, np.float32), rng.normal(0, 0.01, (WIDTH, RANK)).astype(np.float32)]
    one, two = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(y))
        rate = RATE * 0.5 * (1 + np.cos(np.pi * epoch / EPOCHS)) * 0.25
        for lo in range(0, len(order), BATCH):
            b = z[order[lo : lo + BATCH]]
            w0, w, v = params
            xv = b @ v
            margin = w0 + b @ w + 0.5 * (xv**2 - (b**2) @ (v**2)).sum(axis=1)
            g = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[order[lo : lo + BATCH]]) / len(b)
            grads = [np.array([g.sum()]), b.T @ g + decay * w, b.T @ (g[:, None] * xv) - ((b**2).T @ g)[:, None] * v + decay * v]
            step += 1
            for p, d, m, s in zip(params, grads, one, two, strict=True):
                m += 0.1 * (d - m)
                s += 0.001 * (d * d - s)
                p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return Model(float(params[0][0]), params[1], params[2], mean.astype(np.float32), scale.astype(np.float32))


def held_out(c: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(c).cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """A model of labels.quality from at most so many labelled rows that aren't held out."""
    known = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int")).where("doc_id is not null and quality in (0, 1)").where(~held_out())
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(rows)
    chosen = cut(known, "labels")

    def run(batches) -> Iterator[pa.RecordBatch]:
        places = Places()
        for ids, texts, quality in text_blocks(batches):
            x = features(texts, places).astype(np.float16)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(quality, pa.int32()), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "quality", "x"])

    got = docs.select(F.col("doc_id").cast("long"), or_empty(F.col("text").cast("string")).alias("text")).join(F.broadcast(chosen), "doc_id")
    got = got.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("quality").alias("quality")).select("doc_id", "text", "quality")
    got = mapped(got, run, "doc_id long, quality int, x binary")
    got = sorted({(r.doc_id, r.quality, bytes(r.x)) for r in got.toLocalIterator()})
    if len({q for _, q, _ in got}) < 2:
        return Model()
    x = np.array([np.frombuffer(b, np.float16) for _, _, b in got]).astype(np.float32)
    return train(x, np.array([q for _, q, _ in got], np.float32))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of docs and score; nothing but the text is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches) -> Iterator[pa.RecordBatch]:
        model, places = shared.value, Places()
        for ids, texts in text_blocks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(model.scores(features(texts, places)))], names=["doc_id", "score"])

    return mapped(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, score double")


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    out = score(docs, fit(docs, labels))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= KEEP).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the model does not reject; each row is judged by its text, whatever its id."""
    scored = score(docs.withColumn("doc_id", text_key()), fit(docs, labels))
    return without(docs, cut(scored.where(F.col("score") < KEEP).select("doc_id").distinct(), "rejected"), text_key())
