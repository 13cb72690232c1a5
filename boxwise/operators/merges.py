"""Guarded joins and merges of drafts: a value is filled only from a unique partner, never invented."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W


def unique_by(rows: DataFrame, keys: list[str], **values: str) -> DataFrame:
    """One row for each key that occurs once, with the values under new names."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *(F.max(c).alias(n) for n, c in values.items())).where("_n = 1").drop("_n")


def anchored(left: DataFrame, right: DataFrame, keys: list[str], both: bool = True, **values: str) -> DataFrame:
    """left joined to right where a key is unique on the right and, with both, on the left."""
    found = unique_by(right, keys, **values)
    own = left.join(left.groupBy(*keys).count().where("count = 1").drop("count"), keys) if both else left
    return own.join(found, keys)


def outcome(own: Column, other: Column) -> Column:
    """How two drafts of a value agree."""
    return F.when(own.isNull() & other.isNull(), "missing").when(own.isNull(), "filled").when(other.isNull(), "kept").when(own == other, "agreed").otherwise("conflict")


def uncovered(boxes: DataFrame, evidence: DataFrame, keys: list[str]) -> DataFrame:
    """Boxes that no evidence names."""
    return boxes.join(evidence.select(*keys).distinct(), keys, "left_anti")


def canonical(source: DataFrame, **aliases: list[str]) -> DataFrame:
    """Columns under canonical names: the first alias that is there and not null."""
    return source.select(*((F.coalesce(*(F.col(c) for c in names if c in source.columns)) if any(c in source.columns for c in names) else F.lit(None).cast("string")).alias(n) for n, names in aliases.items()))


def eav(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Long form of rows: keys, path, value; nulls stay."""
    return rows.select(*keys, *(F.col(v).cast("string").alias(v) for v in values)).unpivot(keys, values, "path", "value")


def out_of_order(found: DataFrame, keys: list[str]) -> DataFrame:
    """Items found once (n, code, page, y, h) with back: the next item stands on the same page, more than half a height above."""
    w = W.partitionBy(*keys).orderBy("n", "code")
    after = {c: F.lead(c).over(w) for c in ("n", "page", "y", "h")}
    back = (after["n"] == F.col("n") + 1) & (after["page"] == F.col("page")) & (F.col("y") > after["y"] + F.greatest("h", after["h"]) * 0.5)
    return found.withColumn("back", F.coalesce(back, F.lit(False)))


def present(c: Column) -> Column:
    """Whether a text value is there: empty ones aren't, zero is."""
    return F.coalesce(c != "", F.lit(False))


def nested_rows(paths: DataFrame, keys: list[str], root: str, fields: list[str]) -> DataFrame:
    """(keys, path like root[3].field, value) -> keys and root, the list of records in the order of their numbers."""
    number = F.regexp_extract("path", rf"^{root}\[(\d+)\]\.", 1).cast("long")
    field = F.regexp_extract("path", r"\.([^.\[\]]+)$", 1)
    rows = paths.select(*keys, number.alias("_n"), field.alias("_f"), "value").groupBy(*keys, "_n").agg(*(F.max(F.when(F.col("_f") == f, F.col("value"))).alias(f) for f in fields))
    held = F.array_sort(F.collect_list(F.struct("_n", *fields)))
    return rows.groupBy(*keys).agg(F.transform(held, lambda r: F.struct(*(r[f].alias(f) for f in fields))).alias(root))


def lookup(df: DataFrame, path: str) -> Column:
    """The value at a dotted path with list indexes; null where the list is too short or the field unknown."""
    at, kind = None, df.schema
    for name, index in re.findall(r"([^.\[\]]+)(?:\[(\d+)\])?", path):
        if not isinstance(kind, T.StructType) or name not in kind.names:
            return F.lit(None)
        kind = kind[name].dataType
        at = F.col(name) if at is None else at[name]
        if index:
            at, kind = F.get(at, F.lit(int(index))), kind.elementType
    return at
