"""Sinks: JSON lines by split, and one response a document."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def finite(c: Column, kind: T.DataType) -> Column:
    """The column with every number that is infinite or no number, at any depth, as null."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(F.abs(c) < float("inf"), c)
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: finite(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda _, x: finite(x, kind.valueType))
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*(finite(c[f.name], f.dataType).alias(f.name) for f in kind)))
    return c


def write_jsonl(rows: DataFrame, path: str, split: str | None = None) -> None:
    """JSON lines under path, a folder for each value of the split column; nulls are written.

    They are written beside the path and renamed when whole, so what stands there is never half a result."""
    plain = rows.select(*(finite(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in rows.schema))
    fresh = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    writer = plain.write.option("ignoreNullFields", "false")
    (writer.partitionBy(split) if split else writer).json(fresh)
    session = rows.sparkSession
    place = session._jvm.org.apache.hadoop.fs.Path
    files = place(fresh).getFileSystem(session.sparkContext._jsc.hadoopConfiguration())
    files.delete(place(path), True)
    if not files.rename(place(fresh), place(path)):
        raise OSError(f"{fresh} could not be renamed")


def response(valid: Column, code: Column, **fields: Column) -> Column:
    """A document's response as JSON text: its fields if it is valid, else an error of the same shape with every field null."""
    kind = {n: F.coalesce(c, F.lit(None)) for n, c in fields.items()}
    body = lambda ok: F.struct(F.lit(ok).alias("success"), (F.lit(None).cast("string") if ok else code).alias("error"), *((c if ok else F.when(F.lit(False), c)).alias(n) for n, c in kind.items()))
    options = {"ignoreNullFields": "false"}
    return F.when(F.coalesce(valid, F.lit(False)), F.to_json(body(True), options)).otherwise(F.to_json(body(False), options))
