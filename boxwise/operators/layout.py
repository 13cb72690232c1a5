"""Table layout: cells under column headings, bands around unique anchors, runs of places, candidates behind gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from boxwise.operators.geometry import in_interval, islands, midpoints
from boxwise.operators.merges import unique_by


def column_of(cells: DataFrame, heads: DataFrame, keys: list[str], x: str, least: int, per_cent: int) -> DataFrame:
    """cells with the head_x and the columns of the one heading that is strictly closest and near enough.

    Near enough is the greater of least and a share of the heading's distance to its closest neighbour; a cell half-way
    between two headings has none. Strictly closest means inside the midpoints, so one ordered pass does."""
    w = W.partitionBy(*keys).orderBy("head_x")
    gap = F.least(F.col("head_x") - F.lag("head_x").over(w), F.lead("head_x").over(w) - F.col("head_x"))
    near = F.greatest(F.lit(least), F.floor(F.coalesce(gap, F.lit(100_000)) * per_cent / 100))
    bounds = midpoints(heads.withColumn("_near", near), keys, "head_x")
    met = in_interval(cells, bounds, keys, x).where(F.abs(F.col(x) - F.col("head_x")) <= F.col("_near"))
    return met.where(F.col("lo").isNull() | (F.col(x) > F.col("lo"))).drop("lo", "hi", "_near")


def anchor_bands(anchors: DataFrame, keys: list[str], text: str, line: str) -> DataFrame:
    """keys, line, code, lo and hi: a code that occurs once on its page and is the only such code of its line owns the
    lines up to half-way to the next one."""
    once = unique_by(anchors, [*keys, text], **{line: line})
    alone = once.groupBy(*keys, line).agg(F.count(F.lit(1)).alias("_n"), F.max(text).alias("code")).where("_n = 1").drop("_n")
    return midpoints(alone, keys, line)


def with_peer(rows: DataFrame, keys: list[str], x: str, reach: int) -> DataFrame:
    """Rows with another row of the same keys at most reach away. Only neighbours in order are looked at, so no pair is made."""
    w = W.partitionBy(*keys).orderBy(x)
    step = F.least(F.col(x) - F.lag(x).over(w), F.lead(x).over(w) - F.col(x))
    return rows.withColumn("_step", step).where(F.col("_step") <= reach).drop("_step")


def runs(places: DataFrame, keys: list[str], x: str, gap: int) -> DataFrame:
    """keys, run, n, first and last of each run of distinct places whose steps don't exceed the gap."""
    grouped = islands(places.select(*keys, x).distinct(), keys, F.col(x), [x], gap)
    return grouped.groupBy(*keys, F.col("grp").alias("run")).agg(F.count(F.lit(1)).alias("n"), F.min(x).alias("first"), F.max(x).alias("last"))


def promoted(candidates: DataFrame, keys: list[str], kind: str, confidence: str, gates: dict[str, int], order: str) -> DataFrame:
    """For each key and kind the surest candidate that passes the gate of its kind, the earliest of equals; other kinds have no gate to pass."""
    gate = F.element_at(F.create_map(*(F.lit(v) for pair in gates.items() for v in pair)), F.col(kind))
    passed = candidates.where(F.col(confidence) >= gate)
    best = F.max(F.struct(F.col(confidence).alias("c"), (-F.col(order)).alias("o"))).alias("_b")
    return passed.groupBy(*keys, kind).agg(F.count(F.lit(1)).alias("n_passed"), best).select(*keys, kind, "n_passed", (-F.col("_b.o")).alias(order), F.col("_b.c").alias(confidence))


def last_wins(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Union of maps whose later entries replace earlier ones: one value a key."""
    return rows.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value), F.count(F.lit(1)).alias("n_written"))


def matched_or_largest(value: Column, target: Column, tolerance: int) -> tuple[Column, Column]:
    """value and whether it needs review, over a group: the value that meets the target, else the largest one, for review."""
    fits = F.coalesce(F.abs(value - target) <= tolerance, F.lit(False))
    best = F.max(F.when(value.isNotNull(), F.struct(fits.cast("int").alias("f"), value.alias("v"))))
    return best["v"], best["f"] == 0


def label_match(text: Column, aliases: list[str]) -> tuple[Column, Column]:
    """alias and remainder: the longest alias that begins or ends a text, and what is left of it."""
    alias, rest = F.lit(None).cast("string"), F.lit(None).cast("string")
    for a in sorted(aliases, key=lambda s: (len(s), s)):
        begins, ends = F.startswith(text, F.lit(a)), F.endswith(text, F.lit(a))
        alias = F.when(begins | ends, a).otherwise(alias)
        rest = F.when(begins, F.substr(text, F.lit(len(a) + 1))).when(ends, F.substr(text, F.lit(1), F.length(text) - len(a))).otherwise(rest)
    return alias, rest


def eligible_pages(boxes: DataFrame, keys: list[str], extent: int, words: int = 4, letters: int = 40) -> DataFrame:
    """keys, n, alnum and eligible: a page counts as text if it has enough words and letters, and no word leaves the page or is unreadable."""
    alnum = F.sum(F.length(F.regexp_replace("text", "[^0-9A-Za-z]", ""))).alias("alnum")
    faulty = F.count_if((F.col("left") + F.col("width") > extent) | F.contains(F.col("text"), F.lit("�"))).alias("_bad")
    pages = boxes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), alnum, faulty)
    return pages.withColumn("eligible", (F.col("n") >= words) & (F.col("alnum") >= letters) & (F.col("_bad") == 0)).drop("_bad")


def best_template(text: Column, templates: dict[str, list[str]], per_cent: int = 45) -> Column:
    """Name of the template with the greatest share of its labels inside the text, the first of equals; null under the least share."""
    name, best = F.lit(None).cast("string"), F.lit(per_cent - 1)
    for own, labels in templates.items():
        share = F.floor(sum((F.contains(text, F.lit(s)).cast("int") for s in labels), F.lit(0)) * 100 / len(labels)).cast("int")
        name, best = F.when(share > best, own).otherwise(name), F.when(share > best, share).otherwise(best)
    return name


def composed(parts: list[Column], least: int = 2) -> Column:
    """The parts that are there, in order, comma-joined; null if they are too few."""
    held = F.filter(F.array(*parts), lambda p: p.isNotNull() & (p != ""))
    return F.when(F.size(held) >= least, F.array_join(held, ", "))


def orientation(predicted: Column, per_cent: Column, least: int = 90) -> tuple[Column, Column]:
    """The turn to apply, and why: only a quarter turn that is sure enough applies."""
    known = F.coalesce(predicted.isin(0, 90, 180, 270), F.lit(False))
    sure = F.coalesce(per_cent >= least, F.lit(False))
    why = F.when(~known, "unknown").when(~sure, "unsure").when(predicted == 0, "upright").otherwise("turned")
    return F.when(known & sure, predicted).otherwise(0), why


def labelled(text: Column, follower: Column) -> tuple[Column, Column]:
    """label and value of a word that holds a colon: what follows it in the word, else the next word."""
    label = F.regexp_extract(text, "^([A-Za-z]+):", 1)
    tail = F.regexp_extract(text, "^[A-Za-z]+:(.*)$", 1)
    return label, F.when(tail != "", tail).otherwise(follower)
