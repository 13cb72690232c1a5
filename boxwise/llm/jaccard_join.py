"""Operator 6: n-gram Jaccard self-join by MinHash banding.

Equal texts are one text first. Texts meet where a band of their MinHash signature is equal; band and row counts follow
from the target recall at the threshold. Texts that meet, directly or through others, form a cell. Every pair within a
cell is verified on the full sets of five-word shingles, cells being cut into blocks of bounded size, one task for two blocks;
a task returns the number of links of each text and a spanning forest of the links, never the pairs themselves.

Edge cases: a null text is an empty text; texts without words are alike only if equal; fewer than five words make one
padded shingle; an id may repeat, with the same or another text; a class whose texts have no id of their own is named by a
number of 2^62 or more; an empty table gives an empty result; other columns are ignored, whatever their names."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from boxwise.llm.common import cut, drop, fresh, mapped, row_key, small, text_blocks, unnamed, without
from boxwise.llm.components import connected_components
from boxwise.llm.shingles import WordHashes, bands_for, intersections, minhash_bands, shingles

THRESHOLD_TENTHS, RECALL, ROWS = 8, 0.999, 6
#: Shingles (plus 512 a text) in a block of a cell.
BLOCK = 1 << 18


def signatures(docs: DataFrame, rows: int = ROWS, recall: float = RECALL) -> DataFrame:
    """doc_id, digest of the text, number of shingles, and band keys."""
    bands = bands_for(THRESHOLD_TENTHS / 10, recall, rows)

    def run(batches) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for ids, texts in text_blocks(batches):
            flat, counts = shingles(texts, hashes)
            keys = minhash_bands(flat, counts, bands, rows).view(np.int64)
            lists = pa.ListArray.from_arrays(np.r_[0, np.cumsum((counts > 0) * bands)].astype(np.int32), pa.array(keys[counts > 0].ravel(), pa.int64()))
            digests = [blake2b(x.encode("utf-8", "surrogatepass"), digest_size=16).digest() for x in texts]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests, pa.binary()), pa.array(counts), lists], names=["doc_id", "digest", "n_shingles", "bands"])

    return mapped(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, digest binary, n_shingles long, bands array<long>")


def _sets(docs: DataFrame) -> DataFrame:
    """(node, text, digest, ...) -> the same with the sorted distinct shingle hashes as bytes instead of the text.

    Rows whose text isn't the one of the digest go: an id may stand before several texts."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for part in text_blocks(batches):
            rows = [r for r in zip(*part, strict=True) if blake2b(r[1].encode("utf-8", "surrogatepass"), digest_size=16).digest() == r[2]]
            if not rows:
                continue
            nodes, texts, _, cells, blocks, n = zip(*rows, strict=True)
            flat, counts = shingles(texts, hashes)
            ends = np.cumsum(counts)
            sets = [np.unique(flat[e - c : e]).tobytes() for e, c in zip(ends, counts, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary()), pa.array(cells, pa.int64()), pa.array(blocks, pa.int32()), pa.array(n, pa.int32())], names=["node", "shingles", "cell", "block", "n_blocks"])

    return mapped(docs, run, "node long, shingles binary, cell long, block int, n_blocks int")


def links_of(members: list[tuple[int, int, np.ndarray]], across: bool) -> tuple[np.ndarray, np.ndarray]:
    """(rep, block, set) of one task -> links of each member, and the member each one is tied to in the forest.

    With across, only pairs between the two blocks count."""
    size = np.array([len(s) for _, _, s in members])
    inter = intersections([s for _, _, s in members])
    alike = 10 * inter >= THRESHOLD_TENTHS * (size[:, None] + size[None, :] - inter)
    alike &= (inter > 0) & ~np.eye(len(members), dtype=bool)
    if across:
        block = np.array([b for _, b, _ in members])
        alike &= block[:, None] != block[None, :]
    label = np.arange(len(members))
    while True:
        new = np.minimum(label, np.where(alike, label[None, :], len(members)).min(axis=1))
        if (new == label).all():
            return alike.sum(axis=1), label
        label = new


def _verify(sets: DataFrame) -> DataFrame:
    """Sets dealt by (cell, two blocks) and sorted -> links(node, n) and forest edges(node, other)."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        def done(key, members):
            n, label = links_of(members, key[1] != key[2])
            reps = np.array([r for r, _, _ in members], np.int64)
            keep = np.flatnonzero(n)
            return pa.RecordBatch.from_arrays([pa.array(reps[keep]), pa.array(n[keep].astype(np.int64)), pa.array(reps[label[keep]])], names=["node", "n", "other"])

        key, members = None, []
        for batch in batches:
            for rep, data, cell, block, low, high in zip(*(batch.column(k) for k in range(6)), strict=True):
                own = (cell.as_py(), low.as_py(), high.as_py())
                if own != key:
                    if len(members) > 1:
                        yield done(key, members)
                    key, members = own, []
                if members and members[-1][0] == rep.as_py():  # a repeated row
                    continue
                members.append((rep.as_py(), block.as_py(), np.frombuffer(data.as_py(), np.uint64)))
        if len(members) > 1:
            yield done(key, members)

    return mapped(sets, run, "node long, n long, other long")


def jaccard_classes(docs: DataFrame, rows: int = ROWS, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, class_id (least id reached by links of similarity 0.8 or more, or by equal text),
    n_links (different texts linked to its text), n_copies (documents with this very text)."""
    signed = cut(signatures(docs, rows, recall), "signatures")
    texts = signed.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_copies"), F.max("n_shingles").alias("n_shingles"), F.max(F.struct("bands")).alias("b"))
    taken = F.row_number().over(W.partitionBy("rep").orderBy("digest")) > 1
    named = F.when(F.col("rep").isNull() | taken, unnamed(F.xxhash64("digest"))).otherwise(F.col("rep"))
    nodes = cut(texts.select("digest", "rep", named.alias("node"), "n_copies", "n_shingles", "b.bands"), "texts")
    met = nodes.select("node", F.explode("bands").alias("band"))
    hubs = met.groupBy("band").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1").select("band", "hub")
    cells = connected_components(met.join(hubs, "band").where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct())
    sized = cells.join(nodes.select("node", "rep", "digest", "n_shingles"), "node")
    blocks = cells.join(nodes.select("node", "n_shingles"), "node").groupBy("component").agg(F.sum(F.col("n_shingles") + 512).alias("held"))
    blocks = blocks.select("component", F.ceil(F.col("held") / block).cast("int").alias("n_blocks"))
    dealt = cut(sized.join(blocks, "component").select("node", "rep", "digest", F.col("component").alias("cell"), "n_blocks", F.expr("cast(pmod(xxhash64(node), n_blocks) as int)").alias("block")), "dealt")
    whole = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    text = whole.join(small(dealt), F.col("id").eqNullSafe(F.col("rep"))).select("node", "text", "digest", "cell", "block", "n_blocks")
    pairs = _sets(text).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    pairs = pairs.select("node", "shingles", "cell", "block", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"))
    found = cut(_verify(pairs.repartition("cell", "low", "high").sortWithinPartitions("cell", "low", "high", "node")), "links")
    links = found.groupBy("node").agg(F.sum("n").alias("n_links"))
    classes = connected_components(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
    known = nodes.select("digest", "node", "n_copies").join(links, "node", "left").join(classes, "node", "left")
    known = known.select("digest", F.coalesce("component", "node").alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), "n_copies")
    out = cut(signed.select("doc_id", "digest").join(known, "digest").select("doc_id", "class_id", "n_links", "n_copies"), "classes")
    for done in (signed, nodes, cells, dealt, found, classes):
        drop(done)
    return out


def _one_row_a_key(docs: DataFrame) -> DataFrame:
    """Of rows that repeat a row_key(), the one with the least text; only these rows are shuffled."""
    row, rank = fresh(docs, "row"), fresh(docs, "rank")
    keyed = docs.withColumn(row, row_key())
    again = keyed.groupBy(row).agg(F.count("*").alias(rank)).where(F.col(rank) > 1).select(row)
    if not again.limit(1).count():
        return docs
    columns = [f"`{c}`" for c in docs.columns]
    least = keyed.join(again, row, "left_semi").select("*", F.row_number().over(W.partitionBy(row).orderBy("text")).alias(rank))
    return keyed.join(small(again), row, "left_anti").select(columns).unionByName(least.where(F.col(rank) == 1).select(columns))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each class, that of the least id; the columns stay as they are.

    An id names one document: of rows that repeat it, the one with the least text is taken. Rows without an id are documents
    of their own, of which only classes without any id keep one."""
    docs = _one_row_a_key(docs)
    return without(docs, jaccard_classes(docs.withColumn("doc_id", row_key())).where("doc_id <> class_id").select("doc_id"), row_key())
