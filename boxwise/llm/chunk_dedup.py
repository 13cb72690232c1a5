"""Operator 7: substring deduplication by content-defined chunking with a gear rolling hash.

A repeated passage is a run of PASSAGE_WORDS words, byte for byte, that stands in more than one document; longer ones are
several of these. The first document (least id) keeps them. Words are what stands between spaces, tabs and line ends.

Anchors find the candidates: the gear hash over the last 32 bytes is read at the ends of words, and each run of PASSAGE_WORDS words is
cut at the word end where it is least (the last one of equals), its first ANCHOR_WORDS - 1 ends left out. So many words hold 32 bytes or more:
the cut follows from the run's own text, whatever stands around it, and equal runs have equal anchors (the hash of the
ANCHOR_WORDS words up to the cut). Neighbouring runs with one cut are a stretch. Stretches whose anchor occurs in more than one document are
read again; of equal ones one is compared, run by run, by the hash of each run's whole text beside that of the anchor (128 bits
together). So what is reported is exact, and no shared run is missed.

chunks() and dedup_chunks() cut texts where the hash's top bits are zero, within a least and a largest size.

Edge cases: a null text is an empty text and has no chunk; a text short of words has no passage; repetition within one document
only is no repetition across documents; rows that repeat an id count as one document; rows without an id count as one document
with a null id; further columns are ignored; an empty table gives an empty result."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxwise.llm.common import cut, drop, text_blocks

LEAST, LARGEST, MASK_BITS = 16, 64, 5
PASSAGE_WORDS = 51
WINDOW = 32
#: Words of one byte and a space each that fill the window, and the word at the cut.
ANCHOR_WORDS = WINDOW // 2 + 1
#: The gear table is drawn from a seed.
GEAR = np.random.default_rng(2024).integers(1, 2**32, 256, dtype=np.uint32)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """For each byte, sum over the last 32 bytes of GEAR[b] << age, modulo 2^32, by doubling the window."""
    h = GEAR[data]
    age = 1
    while age < WINDOW:
        older = np.zeros_like(h)
        older[age:] = h[:-age] << np.uint32(age)
        h = h + older
        age *= 2
    return h


def boundaries(text: bytes) -> list[int]:
    """Ends of the chunks of a text; a cut never splits a UTF-8 character."""
    if not text:
        return []
    data = np.frombuffer(text, np.uint8)
    wanted = np.flatnonzero((gear_hashes(data) >> np.uint32(32 - MASK_BITS)) == 0) + 1
    whole = np.ones(len(data) + 1, bool)
    whole[:-1] = (data & 0xC0) != 0x80
    ends, start, k, wanted = [], 0, 0, wanted.tolist() + [len(data)]
    while start < len(data):
        while wanted[k] < start + LEAST and wanted[k] < len(data):
            k += 1
        end = min(wanted[k], start + LARGEST, len(data))
        while not whole[end]:
            end += 1
        ends.append(end)
        start = end
    return ends


def _digest(data: bytes) -> bytes:
    return blake2b(data, digest_size=16).digest()


def word_places(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends, in bytes, of the words of a text."""
    gap = np.isin(np.frombuffer(text, np.uint8), np.frombuffer(b" \n\t\r", np.uint8))
    edge = np.flatnonzero(np.diff(np.r_[True, gap, True].astype(np.int8)))
    return edge[::2], edge[1::2]


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each width neighbours, by doubling."""
    held = 1
    while held < width:
        step = min(held, width - held)
        x = np.minimum(x[:-step], x[step:])
        held += step
    return x


def _key(data: bytes) -> int:
    return int.from_bytes(blake2b(data, digest_size=8).digest(), "little", signed=True)


def anchors(text: bytes) -> Iterator[tuple[int, int, int]]:
    """(key, first, last) of each anchor of a text: the runs that start at the words first to last are cut there."""
    starts, ends = word_places(text)
    if len(starts) < PASSAGE_WORDS:
        return
    hashes = gear_hashes(np.frombuffer(text, np.uint8))[ends - 1].astype(np.uint64)
    from_last = np.arange(len(ends), 0, -1).astype(np.uint64)
    least = sliding_least((hashes << np.uint64(32) | from_last)[ANCHOR_WORDS - 1 :], PASSAGE_WORDS - ANCHOR_WORDS + 1)
    at = len(ends) - (least & np.uint64(2**32 - 1)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    at = at[first]
    for a, b, lo, hi in zip(starts[at - ANCHOR_WORDS + 1].tolist(), ends[at].tolist(), first.tolist(), [*(first[1:] - 1).tolist(), len(least) - 1], strict=True):
        yield _key(text[a:b]), lo, hi


def stretches(text: bytes, ranges: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int, list[int], list[int], list[int]]]:
    """(anchor, key, start) of the stretches of a text, and key, start and end of each run, in bytes from the stretch's start."""
    starts, ends = (x.tolist() for x in word_places(text))
    for anchor, first, last in ranges:
        at = starts[first]
        begin, end = starts[first : last + 1], ends[first + PASSAGE_WORDS - 1 : last + PASSAGE_WORDS]
        yield anchor, _key(text[at : end[-1]]), at, [_key(text[a:b]) for a, b in zip(begin, end, strict=True)], [a - at for a in begin], [b - at for b in end]


def chunks(docs: DataFrame) -> DataFrame:
    """doc_id, start, end (bytes), digest of every chunk of every document."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_blocks(batches):
            rows = []
            for i, text in zip(ids, texts, strict=True):
                data, start = text.encode("utf-8", "surrogatepass"), 0
                for end in boundaries(data):
                    rows.append((i, start, end, _digest(data[start:end])))
                    start = end
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["doc_id", "start", "end", "digest"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, start int, end int, digest binary")


def dedup_chunks(docs: DataFrame) -> DataFrame:
    """One row per distinct chunk: its digest, how often and where first it occurs."""
    return chunks(docs).groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "start", "end")).alias("first"))


def _record(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def _anchor_rows(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, anchor, first, last of the anchors of docs(doc_id, text, text_key)."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("anchor", pa.int64()), ("first", pa.int32()), ("last", pa.int32())])

    def run(batches) -> Iterator[pa.RecordBatch]:
        for ids, texts, keys in text_blocks(batches):
            rows = [(i, key, *found) for i, text, key in zip(ids, texts, keys, strict=True) for found in anchors(text.encode("utf-8", "surrogatepass"))]
            if rows:
                yield _record(rows, schema)

    return docs.mapInArrow(run, "doc_id long, text_key long, anchor long, first int, last int")


def _stretch_rows(docs: DataFrame) -> DataFrame:
    """doc_id, anchor, stretch, at and runs of the ranges that docs(doc_id, text, ranges) name."""
    long, int_ = pa.int64(), pa.int32()
    schema = pa.schema([("doc_id", long), ("anchor", long), ("stretch", long), ("at", int_), ("keys", pa.list_(long)), ("starts", pa.list_(int_)), ("ends", pa.list_(int_))])
    rows_held = 5_000

    def run(batches) -> Iterator[pa.RecordBatch]:
        rows = []
        for ids, texts, ranges in text_blocks(batches):
            for i, text, own in zip(ids, texts, ranges, strict=True):
                for found in stretches(text.encode("utf-8", "surrogatepass"), [(r["anchor"], r["first"], r["last"]) for r in own]):
                    rows.append((i, *found))
                    if len(rows) >= rows_held:
                        yield _record(rows, schema)
                        rows = []
        if rows:
            yield _record(rows, schema)

    return docs.mapInArrow(run, "doc_id long, anchor long, stretch long, at int, keys array<long>, starts array<int>, ends array<int>")


SEVERAL = "least < most or (nameless and least is not null)"


def _holders(rows: DataFrame, *keys: str, **more: Column) -> DataFrame:
    """The least and the greatest id, and whether there is a row without, of each key."""
    return rows.groupBy(*keys).agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.max(F.col("doc_id").isNull()).alias("nameless"), *(c.alias(n) for n, c in more.items()))


def repeated_passages(docs: DataFrame) -> DataFrame:
    """doc_id, first_doc_ids, n_passages (runs of PASSAGE_WORDS words), dup_bytes, spans (merged, in bytes of the UTF-8 text), kept
    (whether it is the first of all its passages) of each document that shares a passage with another."""
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    texts = texts.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    anchored = cut(_anchor_rows(texts), "anchors")
    met = anchored.join(_holders(anchored, "anchor").where(SEVERAL).select("anchor"), "anchor")
    met = met.groupBy(F.col("doc_id").alias("id"), F.col("text_key").alias("key")).agg(F.collect_set(F.struct("anchor", "first", "last")).alias("ranges"))
    again = texts.join(met, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("key"))).select("doc_id", "text", "ranges")
    rows = cut(_stretch_rows(again), "stretches")
    drop(anchored)
    distinct = _holders(rows, "anchor", "stretch", runs=F.first(F.struct("keys", "starts", "ends")))
    runs = cut(distinct.select("anchor", "stretch", "least", "most", "nameless", F.inline(F.arrays_zip("runs.keys", "runs.starts", "runs.ends")).alias("run", "start", "end")), "runs")
    shared = runs.groupBy("anchor", "run").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.max("nameless").alias("nameless")).where(SEVERAL)
    of_run = runs.select("anchor", "stretch", "run", "start", "end").join(shared.select("anchor", "run", F.col("least").alias("first")), ["anchor", "run"])
    of_stretch = of_run.groupBy("anchor", "stretch").agg(F.count("*").alias("n"), F.collect_set("first").alias("firsts"), _joined(F.array_sort(F.collect_list(F.struct("start", "end")))).alias("held"))
    shifted = F.transform("held", lambda s: F.struct((s["start"] + F.col("at")).alias("start"), (s["end"] + F.col("at")).alias("end")))
    found = rows.select("doc_id", "anchor", "stretch", "at").join(of_stretch, ["anchor", "stretch"]).select("doc_id", "n", "firsts", shifted.alias("held"))
    whole = found.groupBy("doc_id").agg(F.sum("n").alias("n_passages"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("firsts")))).alias("first_doc_ids"), F.array_sort(F.flatten(F.collect_list("held"))).alias("held"))
    out = whole.select("doc_id", "first_doc_ids", "n_passages", _joined(F.col("held")).alias("spans"))
    size = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return out.select("doc_id", "first_doc_ids", "n_passages", size.alias("dup_bytes"), "spans", (F.col("first_doc_ids") == F.array("doc_id")).alias("kept"))


def _joined(spans: Column) -> Column:
    return F.aggregate(spans, F.expr("cast(array() as array<struct<start: int, end: int>>)"), _join_on)


def _join_on(done, s):
    last = F.element_at(done, -1)
    grown = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))
    return F.when((F.size(done) > 0) & (s["start"] <= F.try_element_at(done, F.lit(-1))["end"]), grown).otherwise(F.concat(done, F.array(s)))
