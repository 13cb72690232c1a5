"""Reports over a corpus: splits, quotas, deltas, signatures, schema checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def hash_split(groups: DataFrame, key: str, salt: str = "invoice-v1:", share: float = 0.15) -> DataFrame:
    """Groups dealt to test, validation and train by the order of a salted digest; the first two get the share each, rounded half to
    even, one at least. Fewer than three groups are an error.

    The groups are few (layouts, brands), so one window over all of them is the feature."""
    n = F.count(F.lit(1)).over(W.partitionBy())
    size = F.greatest(F.lit(1), F.bround(n * F.lit(share)).cast("long"))
    rank = F.row_number().over(W.partitionBy().orderBy(F.sha2(F.concat(F.lit(salt), F.col(key)), 256)))
    split = F.when(n < 3, F.raise_error(F.lit("three groups are needed for three splits")).cast("string")).when(rank <= size, "test").when(rank <= 2 * size, "validation").otherwise("train")
    return groups.withColumn("split", split)


def quota(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def unfinished(sources: DataFrame, done: DataFrame, signature: list[str]) -> DataFrame:
    """Sources without a complete, final record of the same signature."""
    return sources.join(done.where("complete and not retryable").select(*signature).distinct(), signature, "left_anti")


def schema_faults(df: DataFrame, wanted: list[tuple[str, str]]) -> list[str]:
    """What keeps a frame from having exactly these columns, in this order."""
    have = df.dtypes
    faults = [f"missing {n}" for n, _ in wanted if n not in dict(have)] + [f"extra {n}" for n, _ in have if n not in dict(wanted)]
    faults += [f"{n} is {dict(have)[n]}, not {t}" for n, t in wanted if n in dict(have) and dict(have)[n] != t]
    return faults + (["order"] if not faults and [n for n, _ in have] != [n for n, _ in wanted] else [])
