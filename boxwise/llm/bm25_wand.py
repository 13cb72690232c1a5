"""Operator 4: benchmark decontamination by a BM25 inverted index with block-max WAND.

Weights are BM25 contributions under the statistics of all items (number, mean length, document frequencies), divided by the item's
score for itself, so that 1 is a full match. Items are indexed by length class (half as many words again, up to a power of two). A class has postings by
term in order of items, the maximum of each list, and the maxima of its blocks of items. Documents are cut into overlapping passages, such that any span
of up to a class's length lies in one of them, and each passage is a query.

All passages of a batch are searched at once. The terms of a passage stand in the order of their maxima; the pivot is where these, added up, reach a
share of the threshold. Terms before the pivot cannot make a match by themselves, so only the lists from the pivot on are opened. Their block
maxima and what the closed lists can add at most bound each block of items they touch; blocks under the threshold are skipped, the items of
the others scored exactly. The threshold of an item is THRESHOLD or less: a text that holds the share CONTAINMENT of its
shingles may miss as many words as shingles, so what its heaviest such words weigh is taken off. No such text within a passage is lost.
Each item found is then verified: five-word shingles of the item found in the document (0.8 or more), and words of its question and
of its answer found near them.

An index holds at most INDEX_POSTINGS postings and is broadcast; a benchmark of more is dealt to several indexes by the hash of its
items, each with one scan of the documents. Statistics and weights are made by Spark jobs, so the driver holds one index at a time.

Edge cases: null or empty texts and items match nothing; items under five words count as one shingle of all their words; a repeated item counts
once, an item without an id is one with a null id; repeated documents give repeated results; an empty table on either side gives an empty result;
further columns are ignored."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxwise.llm.common import cut, drop, mapped, small, text_blocks, text_key, without
from boxwise.llm.shingles import WORDS, WORD, words

THRESHOLD, CONTAINMENT, QUESTION, ANSWER = 0.6, 0.8, 0.7, 0.5
K1, B = 1.2, 0.75
#: Postings in one broadcast index (about 20 bytes each, besides the items' texts), and items in a block of them.
INDEX_POSTINGS, BLOCK_ITEMS = 1_000_000, 4
LEAST_STRIDE = 64
#: Share of the threshold that the terms before the pivot may add up to: less opens more lists and leaves fewer blocks to score.
CLOSED = 0.25


def _grams(tokens: list[str]) -> set[tuple]:
    return {tuple(tokens[k : k + WORDS]) for k in range(max(1, len(tokens) - WORDS + 1))}


def weighted(benchmark: DataFrame) -> DataFrame:
    """item_id, text, n (words), terms and weights of each distinct item with words; statistics are those of all items."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_blocks(batches):
            counted = [Counter(words(t)) for t in texts]
            columns = [pa.array(ids, pa.int64()), pa.array(texts), pa.array([c.total() for c in counted], pa.int64()), pa.array([list(c) for c in counted], pa.list_(pa.string())), pa.array([list(c.values()) for c in counted], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["item_id", "text", "n", "terms", "tfs"])

    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null").distinct()
    items = cut(mapped(rows, run, "item_id long, text string, n long, terms array<string>, tfs array<long>").where("n > 0"), "items")
    found = items.agg(F.count("*").alias("items"), F.coalesce(F.avg("n"), F.lit(1.0)).alias("mean")).first()
    each = items.select("item_id", "text", "n", F.inline(F.arrays_zip("terms", "tfs")).alias("term", "tf"))
    df = each.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (found["items"] - F.col("df") + 0.5) / (F.col("df") + 0.5))
    w = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n") / F.lit(found["mean"])))
    made = each.join(small(df), "term").groupBy("item_id", "text", "n").agg(F.array_sort(F.collect_list(F.struct("term", w.alias("w")))).alias("held"))
    total = F.aggregate("held", F.lit(0.0), lambda a, h: a + h["w"])
    out = cut(made.select("item_id", "text", "n", F.transform("held", lambda h: h["term"]).alias("terms"), F.transform("held", lambda h: h["w"] / total).alias("weights")), "weighted")
    drop(items)
    return out


def least_score(text: str, weights: np.ndarray) -> float:
    """What a passage that holds the share CONTAINMENT of an item's shingles scores at least, THRESHOLD at most.

    While one shingle is left, each missing word has a missing shingle of its own that begins or ends with it. Where shingles repeat, one
    may stand for two words."""
    own = words(text)
    grams = len(_grams(own))
    missing = grams - int(np.ceil(CONTAINMENT * grams - 1e-9))
    if grams < len(own) - WORDS + 1:
        missing *= 2
    return min(THRESHOLD, 1 - float(np.sort(weights)[::-1][:missing].sum())) - 1e-4


def stride_of(n: int) -> int:
    """Words that a passage of an item of n words may span: half as many again, up to a power of two."""
    return max(LEAST_STRIDE, 1 << (n + n // 2 - 1).bit_length())


class Postings:
    """Items of one length class: lists by term, their maxima, the maxima of their blocks, and terms by item."""

    def __init__(self, stride: int, numbers: list[int], terms: list[np.ndarray], weights: list[np.ndarray], least: list[float], n_terms: int):
        order = sorted(range(len(numbers)), key=lambda k: (least[k], numbers[k]))  # like thresholds share blocks
        self.stride, self.numbers = stride, np.array([numbers[k] for k in order])
        self.terms = [np.sort(terms[k]) for k in order]
        self.weights = [weights[k][np.argsort(terms[k])].astype(np.float32) for k in order]
        self.least = np.array([least[k] for k in order])
        self.lowest = float(self.least.min())
        starts = np.arange(0, len(order), BLOCK_ITEMS)
        self.block_least = np.minimum.reduceat(self.least, starts)
        term, item, w = np.concatenate(self.terms), np.repeat(np.arange(len(order)), [len(t) for t in self.terms]), np.concatenate(self.weights)
        self.most = np.zeros(n_terms, np.float32)
        np.maximum.at(self.most, term, w)
        key = term.astype(np.int64) * len(starts) + item // BLOCK_ITEMS
        by = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.r_[True, key[by][1:] != key[by][:-1]])
        self.block = (key[by][first] % len(starts)).astype(np.int32)
        self.block_most = np.maximum.reduceat(w[by], first)
        self.ends = np.searchsorted(key[by][first], (np.arange(n_terms, dtype=np.int64) + 1) * len(starts))

    def search(self, window: np.ndarray, term: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """Pairs (window, term), sorted and distinct -> (window, place of the item, score) where the item's threshold is reached."""
        most = self.most[term]
        window, term, most = window[most > 0], term[most > 0], most[most > 0]
        if not len(window):
            return
        begin = np.flatnonzero(np.r_[True, window[1:] != window[:-1]])
        counts = np.diff(np.r_[begin, len(window)])
        able = np.repeat(np.add.reduceat(most, begin) >= self.lowest, counts)
        window, term, most = window[able], term[able], most[able]
        if not len(window):
            return
        by = np.lexsort((most, window))  # the pivot: maxima in rising order, added up
        w, m = window[by], most[by].astype(np.float64)
        begin = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
        counts = np.diff(np.r_[begin, len(w)])
        sums = np.cumsum(m)
        sums -= np.repeat(sums[begin] - m[begin], counts)
        opened = sums >= CLOSED * self.lowest
        closed = np.zeros(len(begin))
        np.maximum.at(closed, np.repeat(np.arange(len(begin)), counts)[~opened], sums[~opened])
        owner, t = np.repeat(np.arange(len(begin)), counts)[opened], term[by][opened]
        lo = np.where(t > 0, self.ends[t - 1], 0)
        n = self.ends[t] - lo
        n_blocks = len(self.block_least)
        ends = np.cumsum(n)
        at = 0
        found: list[tuple[np.ndarray, np.ndarray]] = []
        while at < len(t):  # so many opened postings at once, whole windows each time
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 2_000_000, side="right")))
            while to < len(t) and owner[to] == owner[to - 1]:
                to += 1
            part = n[at:to]
            place = np.repeat(lo[at:to] - (np.cumsum(part) - part), part) + np.arange(part.sum())
            key = np.repeat(owner[at:to], part).astype(np.int64) * n_blocks + self.block[place]
            key, inverse = np.unique(key, return_inverse=True)
            bound = np.bincount(inverse, self.block_most[place], len(key)) + closed[key // n_blocks]
            good = key[bound >= self.block_least[key % n_blocks]]
            found.append((good // n_blocks, good % n_blocks))
            at = to
        names = w[begin]
        first, last = np.searchsorted(window, names), np.searchsorted(window, names, side="right")
        for o, b in zip(*(np.concatenate(x).tolist() for x in zip(*found, strict=True)), strict=True):
            own = term[first[o] : last[o]]
            for i in range(b * BLOCK_ITEMS, min((b + 1) * BLOCK_ITEMS, len(self.terms))):
                at_own = np.minimum(np.searchsorted(own, self.terms[i]), len(own) - 1)
                score = float(self.weights[i][own[at_own] == self.terms[i]].sum())
                if score >= self.least[i]:
                    yield int(names[o]), i, round(score, 6)


class Index:
    """Postings of all length classes of some items (item_id, text, n, terms, weights)."""

    def __init__(self, items: list[tuple]):
        self.ids, self.texts = [r[0] for r in items], [r[1] for r in items]
        self.terms: dict[str, int] = {}
        classes: dict[int, list] = {}
        for k, (_, text, n, terms, weights) in enumerate(items):
            own = np.array([self.terms.setdefault(t, len(self.terms)) for t in terms], np.int64)
            weights = np.array(weights)
            classes.setdefault(stride_of(n), []).append((k, own, weights, least_score(text, weights)))
        self.classes = [Postings(stride, *map(list, zip(*own, strict=True)), len(self.terms)) for stride, own in sorted(classes.items())]
        self._parts: dict[int, tuple] = {}

    def search(self, texts: list[str]) -> Iterator[tuple[int, int, float, list[str]]]:
        """(number of the text, number of the item, best score, words of the text) of all pairs that reach the item's threshold."""
        tokens = [words(t) for t in texts]
        counts = np.array([len(t) for t in tokens], np.int64)
        term = np.fromiter((x for own in tokens for x in map(self.terms.get, own, repeat(-1))), np.int64, counts.sum())
        hit = np.flatnonzero(term >= 0)
        if not len(hit):
            return
        doc = np.repeat(np.arange(len(texts)), counts)[hit]
        at = hit - (np.cumsum(counts) - counts)[doc]
        v = len(self.terms)
        best: dict[tuple[int, int], float] = {}
        for p in self.classes:
            first = np.cumsum(counts // p.stride + 2) - (counts // p.stride + 2)
            window = first[doc] + at // p.stride
            second = at // p.stride > 0  # the window before reaches here too
            pairs = np.unique(np.r_[window * v + term[hit], (window[second] - 1) * v + term[hit][second]])
            for w, place, score in p.search(pairs // v, pairs % v):
                key = (int(np.searchsorted(first, w, side="right")) - 1, int(p.numbers[place]))
                best[key] = max(best.get(key, 0), score)
        for (d, i), score in sorted(best.items()):
            yield d, i, score, tokens[d]

    def verify(self, i: int, tokens: list[str]) -> tuple[float, float, float]:
        """Shares of the item's shingles, question words and answer words that the text holds, near the shingles found."""
        if i not in self._parts:
            if len(self._parts) > 10_000:
                self._parts.clear()
            own = words(self.texts[i])
            self._parts[i] = min(len(own), WORDS), _grams(own), *_question_answer(self.texts[i])
        n, wanted, question, answer = self._parts[i]
        places = [k for k in range(len(tokens) - n + 1) if tuple(tokens[k : k + n]) in wanted]
        if not places:
            return 0.0, 0.0, 0.0
        found = {tuple(tokens[k : k + n]) for k in places}
        near: set[str] = set()
        for k in places:
            near.update(tokens[max(0, k - WORDS) : k + 2 * WORDS])
        share = lambda part: sum(t in near for t in part) / max(1, len(part))
        return len(found) / len(wanted), share(question), share(answer)


def _question_answer(text: str) -> tuple[list[str], list[str]]:
    """Words of all sentences but the last, and of the last; a single sentence counts as two thirds and a third."""
    own = words(text)
    sentences = [s for s in text.replace("?", ".").replace("!", ".").replace("\n", " ").split(".") if WORD.search(s)]
    tail = len(words(sentences[-1])) if len(sentences) > 1 else -(-len(own) // 3)
    return own[: len(own) - tail] or own, own[len(own) - tail :]


def indexes(benchmark: DataFrame, postings: int = INDEX_POSTINGS) -> Iterator[Index]:
    """Indexes of all items, of about so many postings each."""
    items = weighted(benchmark)
    parts = -(-(items.agg(F.sum(F.size("terms"))).first()[0] or 0) // postings)
    for part in range(parts):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).toArrow()
        if rows.num_rows:
            yield Index(sorted(zip(*(rows.column(k).to_pylist() for k in range(5)), strict=True), key=lambda r: (r[0] is None, r[0] or 0, r[1])))
    drop(items)


def leaks(docs: DataFrame, benchmark: DataFrame, postings: int = INDEX_POSTINGS) -> DataFrame:
    """doc_id, item_id, score, containment, question, answer of each verified pair."""
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, score double, containment double, question double, answer double"
    whole = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out = None
    for index in indexes(benchmark, postings):
        shared = spark.sparkContext.broadcast(index)

        def run(batches, shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for ids, texts in text_blocks(batches):
                rows = []
                for d, i, score, tokens in index.search(texts):
                    contained, question, answer = index.verify(i, tokens)
                    if contained >= CONTAINMENT and question >= QUESTION and answer >= ANSWER:
                        rows.append((ids[d], index.ids[i], score, contained, question, answer))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k < 2 else pa.float64()) for k, c in enumerate(zip(*rows, strict=True))], names=["doc_id", "item_id", "score", "containment", "question", "answer"])

        found = mapped(whole, run, schema)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item; each row is judged by its text, whatever its id."""
    return without(docs, cut(leaks(docs.withColumn("doc_id", text_key()), benchmark).select("doc_id").distinct(), "leaks"), text_key())
