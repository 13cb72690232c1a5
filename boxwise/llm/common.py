"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of (id, small value) that may be broadcast after they were counted: about 25 MB.
BROADCAST_ROWS = 500_000
#: UTF-8 bytes of text that one Python step holds at a time (a longer single text is held alone).
BLOCK_BYTES = 2 << 20
#: Texts that one Python step holds at a time.
BLOCK_TEXTS = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one in local mode only."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir")
    if not found:
        if not conf.get("spark.master", "").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.gettempdir()}/boxwise-checkpoints"
    return found.rstrip("/")


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write df to the shared folder and read it back, which ends its lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/boxwise/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._boxwise_path = path
    return back


def drop(df: DataFrame) -> None:
    """Delete what cut() wrote for df, if it did."""
    path = getattr(df, "_boxwise_path", None)
    if path:
        jvm, jsc = df.sparkSession._jvm, df.sparkSession.sparkContext._jsc
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(jsc.hadoopConfiguration()).delete(where, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if a count shows that it has at most so many narrow rows; else df as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def text_blocks(batches: Iterable, text: int = 1, limit: int = BLOCK_BYTES, most: int = BLOCK_TEXTS) -> Iterator[list[list]]:
    """Columns of Arrow batches as Python lists, cut so that each block holds a bounded amount of text and number of texts.

    Nulls in the text column become empty texts."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy().astype(np.int64))
        at = 0
        while at < batch.num_rows:
            held = int(ends[at - 1]) if at else 0
            end = min(max(at + 1, int(np.searchsorted(ends, held + limit, side="right"))), at + most, batch.num_rows)
            part = [batch.column(k).slice(at, end - at).to_pylist() for k in range(batch.num_columns)]
            part[text] = ["" if x is None else x for x in part[text]]
            yield part
            at = end


def release() -> None:
    """Give memory that is no longer used back to the system; Python workers live on through later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def mapped(df: DataFrame, run: Callable, schema: str, forget: Callable[[], None] | None = None) -> DataFrame:
    """mapInArrow, after which a partition's step leaves nothing behind; forget empties what outlives run."""

    def whole(batches) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            if forget is not None:
                forget()
            release()

    return df.mapInArrow(whole, schema)


def unnamed(hashed: Column) -> Column:
    """A number for what has no id of its own, from a hash, above all ids below 2^62."""
    return F.lit(1 << 62) + hashed.bitwiseAND((1 << 62) - 1)


def row_key() -> Column:
    """The id of a document; for one without, a number that follows from its text, so equal texts share it."""
    return F.coalesce(F.col("doc_id").cast("long"), unnamed(F.xxhash64(or_empty(F.col("text").cast("string")))))


def text_key() -> Column:
    """A number that follows from the text alone, so that what is judged by its text is judged row by row."""
    return F.xxhash64(or_empty(F.col("text").cast("string")))


def without(docs: DataFrame, lost: DataFrame, key: Column) -> DataFrame:
    """docs without the rows whose key is among the doc_id of lost; the columns stay as they are."""
    row = fresh(docs, "row")
    gone = lost.select(F.col("doc_id").alias(row))
    return docs.withColumn(row, key).join(small(gone), row, "left_anti").select([f"`{c}`" for c in docs.columns])


def fresh(df: DataFrame, name: str) -> str:
    """A column name like name that df doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def or_empty(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
