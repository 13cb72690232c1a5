"""Arbitration and audit: votes, drafts that compete, numbers that lost digits, crossed parties, reviews from several sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxwise.functions.scalars import lost_digits, squashed


def dominant(rows: DataFrame, keys: list[str], value: str, weight: Column, per_cent: int) -> DataFrame:
    """keys, total, top and the value of greatest weight, if it has at least so many per cent of all weight."""
    votes = rows.groupBy(*keys, value).agg(F.sum(weight).alias("_w"))
    best = votes.groupBy(*keys).agg(F.sum("_w").alias("total"), F.max("_w").alias("top"), F.max_by(value, F.struct("_w", value)).alias("_v"))
    return best.select(*keys, "total", "top", F.when(F.col("top") * 100 >= F.col("total") * per_cent, F.col("_v")).alias("dominant"))


def draft_score(review: Column, checks: list[Column], valid_rows: Column, gaps: Column, issues: Column) -> Column:
    """Orders drafts: free of review first, then by checks that are true, by valid rows, by fewer gaps and by fewer evidence issues."""
    true = sum((F.coalesce(c, F.lit(False)).cast("long") for c in checks), F.lit(0).cast("long"))
    return F.struct((~review).cast("int").alias("clean"), true.alias("checks"), valid_rows.alias("valid"), (-gaps).alias("gaps"), (-issues).alias("issues"))


def repaired(own: Column, candidate: Column, confidence: Column, least: int = 95) -> Column:
    """A candidate takes the place of a number that is the candidate with digits left out, or of none."""
    sure = confidence >= least
    return F.when(sure & (own.isNull() | lost_digits(own, candidate)), candidate).otherwise(own)


def uncrossed(own: Column, other: Column, grid: Column) -> tuple[Column, Column]:
    """value and note: an empty name is filled from the grid; one that is the other party's is replaced, or cleared without a grid value."""
    crossed = squashed(own) == squashed(other)
    value = F.when(own.isNull() | crossed, grid).otherwise(own)
    note = F.when(own.isNull() & grid.isNull(), "missing").when(own.isNull(), "filled").when(crossed & grid.isNotNull(), "replaced").when(crossed, "cleared").when(own != grid, "noted").otherwise("kept")
    return value, note


def reviews(rows: DataFrame, keys: list[str], **reasons: Column) -> DataFrame:
    """keys, n and the distinct reasons that hold for some row of the key, sorted and comma-joined; keys without any are left out.

    All sources are read in one pass: a reason is a flag that is kept by max, so no list of rows is held."""
    flags = rows.groupBy(*keys).agg(*(F.max(F.coalesce(c, F.lit(False)).cast("int")).alias(n) for n, c in reasons.items()))
    held = F.array_compact(F.array(*(F.when(F.col(n) == 1, F.lit(n)) for n in sorted(reasons))))
    return flags.select(*keys, F.size(held).alias("n"), F.array_join(held, ",").alias("reasons")).where("n > 0")


def lost_rows(before: DataFrame, after: DataFrame, keys: list[str], place: str, tolerance: int) -> DataFrame:
    """Rows of before without a row of after under the same keys and at most the tolerance away.

    Places are cut into bands as wide as the tolerance, so the band is a key of the join too."""
    wide = max(1, tolerance)
    band = F.floor(F.col(place) / wide)
    right = after.select(*keys, F.col(place).alias("_p"), F.explode(F.array(band - 1, band, band + 1)).alias("_band"))
    left = before.withColumn("_band", band)
    on = [left[k] == right[k] for k in [*keys, "_band"]] + [F.abs(left[place] - right["_p"]) <= tolerance]
    return left.join(right, on, "left_anti").drop("_band")


def printed_near(target: Column, printed: Column, tolerance: int = 1) -> Column:
    """The printed amount (array of page, amount) within the tolerance of the target, from the last page; null if none is printed."""
    fits = F.filter(printed, lambda p: F.coalesce(F.abs(p["amount"] - target) <= tolerance, F.lit(False)))
    return F.try_element_at(F.array_sort(fits), F.lit(-1))["amount"]
