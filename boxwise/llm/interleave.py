"""Operator 10: sharding by proportional stratified interleaving.

Rows are shuffled within their source by a seeded hash, ranked, and ordered over all sources by fractional rank (rank - 1/2) / rows of the source;
this order is cut into equal runs, so shards differ by at most one row and each holds the sources in proportion. Law: rows.

No source and no order is brought to one task: a rank is the count of the hash ranges below plus the place within its range, and the
place in the whole order likewise, by ranges of the fraction. Rows that are repeated are numbered first, by the partitions that they are read
in, and hashed with their number: a row may be a third of the table. Texts are read once; only sizes, checksums and hashes are shuffled.
The table of ranges, one row for RANGE_ROWS rows, is added up in one task.

Edge cases: a null text has size 1 and checksum 0; a null source is a source of its own; rows may repeat and each gets its own slot;
with fewer rows than shards some shards are empty; an empty table gives an empty result; further columns are ignored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from boxwise.llm.common import cut, or_empty, small

SHARDS, SEED = 8, 20240601
#: Rows that one range of hashes or fractions should hold.
RANGE_ROWS = 5000


def _placed(rows: DataFrame, keys: list[str], bucket: str, order: list[str], name: str) -> DataFrame:
    """rows with the place (from 1) of each in the order within its keys, the bucket rising with the order."""
    sizes = rows.groupBy(*keys, bucket).agg(F.count("*").alias("_n"))
    below = W.partitionBy(*keys).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    offsets = cut(sizes.select(*keys, bucket, F.coalesce(F.sum("_n").over(below), F.lit(0)).alias("_below"), F.sum("_n").over(W.partitionBy(*keys)).alias("_of")), "offsets")
    place = F.row_number().over(W.partitionBy(*keys, bucket).orderBy(*order))
    return rows.join(small(offsets), [*keys, bucket]).withColumn(name, F.col("_below") + place).drop("_below")


def _numbered(rows: DataFrame) -> DataFrame:
    """rows (with part, where each was read) with copy: 0 for a row that is there once, else its number among its equals."""
    same = ["doc_id", "size", "text_crc32", "stratum"]
    repeated = rows.groupBy(*same).agg(F.count("*").alias("copies")).where("copies > 1").drop("copies")
    once = rows.select(*same, "part", F.lit(0).cast("long").alias("copy"))
    if not repeated.limit(1).count():
        return once.drop("part")
    here, there = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in same], small(repeated).alias("b")
    again = rows.alias("a").join(there, here, "left_semi").withColumn("doc_id", F.col("doc_id"))
    keyed = again.withColumn("key", F.xxhash64(*same, F.col("doc_id").isNull()))
    copies = _placed(keyed, ["key"], "part", ["key"], "copy").select(*same, F.col("copy").cast("long"))
    return once.drop("part").alias("a").join(there, here, "left_anti").unionByName(copies)


def interleaved(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    text = or_empty(F.col("text").cast("string"))
    rows = docs.select(F.col("doc_id").cast("long"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("stratum"))
    rows = cut(rows.withColumn("part", F.spark_partition_id()), "rows")
    n = rows.count()
    rows = _numbered(rows).withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "size", "text_crc32", "copy"))
    bits = max(2, (n // RANGE_ROWS).bit_length())
    order = ["h", "doc_id", "size", "text_crc32", "stratum", "copy"]
    ranked = _placed(rows.withColumn("range", F.shiftright("h", 64 - bits)), ["stratum"], "range", order, "rank")
    ranked = ranked.withColumn("fraction", (F.col("rank") - 0.5) / F.col("_of")).drop("_of", "range", "rank")
    ranges = max(4, n // RANGE_ROWS)
    ranked = cut(ranked.withColumn("range", F.floor(F.col("fraction") * ranges)).withColumn("all", F.lit(0)), "ranked")
    placed = _placed(ranked, ["all"], "range", ["fraction", *order], "place")
    place = F.col("place") - 1
    shard = F.expr(f"(place - 1) * {shards} div {max(n, 1)}")
    start = F.expr(f"(shard * {n} + {shards - 1}) div {shards}")
    out = placed.withColumn("shard", shard).withColumn("slot", place - start)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int"), F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"))
