"""Readers: the driver's tables, positioned boxes from plain text, and saved recognition payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

BOX = "struct<text: string, confidence: double, left: double, top: double, width: double, height: double, source: string, retry_kind: string, raw_text: string, grid_column: array<double>, grid_center_x: double>"
PAYLOAD = f"language string, pages array<struct<page: int, render_dpi: int, width: double, height: double, canonical_width: int, canonical_height: int, words: array<{BOX}>>>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def running_places(words: str) -> Column:
    """Where each word of an array column starts if they stand one space apart, without a shuffle.

    Arrays can only grow by copying, so sums run within stretches of about sqrt(n) words and then over the stretches:
    a line of n words costs n * sqrt(n) copied numbers, not n * n."""
    step = F.greatest(F.lit(16), F.ceil(F.sqrt(F.size(words))).cast("int"))
    after = lambda sums, width: F.concat(sums, F.array(F.element_at(sums, -1) + width))
    zero = F.array(F.lit(0))
    stretches = F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0)), step), lambda i: F.aggregate(F.slice(words, i + 1, step), zero, lambda a, t: after(a, F.length(t) + 1)))
    offsets = lambda held: F.aggregate(held, zero, lambda a, s: after(a, F.element_at(s, -1)))
    shifted = lambda both: F.flatten(F.transform(both["held"], lambda s, k: F.transform(F.slice(s, 1, F.size(s) - 1), lambda x: x + F.get(both["offsets"], k))))
    once = F.transform(F.array(stretches), lambda held: F.struct(held.alias("held"), offsets(held).alias("offsets")))
    return F.get(F.transform(once, shifted), F.lit(0))


def text_boxes(docs: DataFrame) -> DataFrame:
    """One box per word of a text: line and word give top and left, forty lines a page, confidence by a rule."""
    line = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("ln", "line"))
    held = line.select("doc_id", "ln", F.filter(F.split("line", " "), lambda t: t != "").alias("words"))
    token = held.select("doc_id", "ln", F.posexplode(F.arrays_zip(F.col("words").alias("t"), running_places("words").alias("x"))).alias("pos", "w"))
    ln, pos = F.col("ln"), F.col("pos")
    return token.select(
        "doc_id",
        (F.floor(ln / 40) + 1).cast("int").alias("page"),
        "ln",
        "pos",
        F.col("w.t").alias("text"),
        (F.col("w.x") * 8).alias("left"),
        (ln * 20).alias("top"),
        (F.length("w.t") * 8).alias("width"),
        F.lit(20).alias("height"),
        (50 + (31 * F.col("doc_id") + 17 * pos + 7 * ln) % 50).cast("int").alias("confidence"),
    )


def payload_boxes(spark: SparkSession, path: str) -> DataFrame:
    """Boxes of saved payloads (one JSON document a file, at any depth): doc_id is the file, an absent source is plain recognition."""
    files = spark.read.schema(PAYLOAD).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.[jJ][sS][oO][nN]").json(path)
    page = files.select(F.input_file_name().alias("doc_id"), F.posexplode_outer("pages").alias("at", "p"))
    box = page.select("doc_id", F.coalesce("p.page", F.col("at") + 1).alias("page"), F.posexplode("p.words").alias("seq", "b"))
    return box.select("doc_id", "page", "seq", "b.*").withColumn("source", F.coalesce("source", F.lit("ocr")))


def numbered(boxes: DataFrame) -> DataFrame:
    """Reading order within a document, from 1."""
    return boxes.withColumn("seq", F.row_number().over(W.partitionBy("doc_id").orderBy("page", "ln", "pos")))


def upright(polygon: str) -> list[Column]:
    """left, top, width and height of a polygon column (array of [x, y]); nulls for none or an empty one."""
    x, y = F.transform(polygon, lambda p: F.get(p, F.lit(0))), F.transform(polygon, lambda p: F.get(p, F.lit(1)))
    return [F.array_min(x).alias("left"), F.array_min(y).alias("top"), (F.array_max(x) - F.array_min(x)).alias("width"), (F.array_max(y) - F.array_min(y)).alias("height")]


def unwrapped(raw: Column, schema: str) -> Column:
    """The record in a result's JSON text, as it is or under res; null for anything else."""
    whole = F.from_json(raw, f"struct<res: struct<{schema}>>")
    own = F.from_json(raw, f"struct<{schema}>")
    return F.coalesce(whole["res"], F.when(F.ltrim(raw).startswith("{"), own))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines; a line that is none gives a row of nulls."""
    return spark.read.schema(schema).json(path)
