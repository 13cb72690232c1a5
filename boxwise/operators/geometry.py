"""Joins and folds on positioned boxes. Every join has (doc_id, page) among its keys, so none is a nested loop."""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType
from pyspark.sql.window import Window as W

from boxwise.functions.scalars import has_arabic


def nearest(labels: DataFrame, values: DataFrame, keys: list[str], reach: int, down: int) -> DataFrame:
    """For each label box the value box with the least 3 |dy| + |dx| between centres, if that is within reach and |dy| within down; of
    equal ones the earliest. A label is never its own value. Columns l_ and v.

    Centres are cut into bands of these sizes, so the bands are keys of the join too."""
    place = lambda df, p: df.select(*keys, *(F.col(c).alias(f"{p}{c}") for c in df.columns if c not in keys), (F.col("left") + F.col("width") / 2).alias(f"{p}x"), (F.col("top") + F.col("height") / 2).alias(f"{p}y"))
    near = lambda c, size: F.explode(F.sequence(F.floor(F.col(c) / size) - 1, F.floor(F.col(c) / size) + 1))
    left = place(labels, "l_").withColumn("_across", near("l_x", reach)).withColumn("_down", near("l_y", down))
    right = place(values, "v_").withColumn("_across", F.floor(F.col("v_x") / reach)).withColumn("_down", F.floor(F.col("v_y") / down))
    dy = F.abs(F.col("v_y") - F.col("l_y"))
    score = 3 * dy + F.abs(F.col("v_x") - F.col("l_x"))
    itself = (F.col("l_ln") == F.col("v_ln")) & (F.col("l_pos") == F.col("v_pos"))
    met = left.join(right, [*keys, "_across", "_down"]).where((dy <= down) & (score <= reach) & ~itself)
    best = F.min(F.struct(score.alias("score"), F.col("v_ln").alias("ln"), F.col("v_pos").alias("pos"), F.col("v_text").alias("text"))).alias("v")
    return met.groupBy(*keys, "l_ln", "l_pos", "l_text").agg(best)


def midpoints(boxes: DataFrame, keys: list[str], x: str) -> DataFrame:
    """lo and hi of each column: half-way to its neighbours, open at both ends."""
    w = W.partitionBy(*keys).orderBy(x)
    return boxes.withColumn("lo", (F.lag(x).over(w) + F.col(x)) / 2).withColumn("hi", (F.lead(x).over(w) + F.col(x)) / 2)


def between(x: Column, lo: Column, hi: Column) -> Column:
    return (lo.isNull() | (x >= lo)) & (hi.isNull() | (x < hi))


def in_interval(cells: DataFrame, bounds: DataFrame, keys: list[str], x: str) -> DataFrame:
    """cells with the columns of the one interval of midpoints() that holds x; cells without any go.

    Cells and lower bounds are put in one order and each cell takes the last bound up to it, so no pair is made."""
    inner = lambda df: F.struct(*(c for c in df.columns if c not in keys))
    low = bounds.select(*keys, F.col("lo").cast("double").alias("_at"), F.lit(0).alias("_cell"), inner(bounds).alias("_held"))
    own = cells.where(F.col(x).isNotNull()).select(*keys, F.col(x).cast("double").alias("_at"), F.lit(1).alias("_cell"), inner(cells).alias("_own"))
    w = W.partitionBy(*keys).orderBy(F.col("_at").asc_nulls_first(), "_cell").rowsBetween(W.unboundedPreceding, 0)
    both = low.unionByName(own, allowMissingColumns=True).withColumn("_held", F.last("_held", ignorenulls=True).over(w))
    return both.where("_cell = 1 and _held is not null").select(*keys, "_own.*", "_held.*")


def islands(rows: DataFrame, keys: list[str], at: Column, order: list[str], gap: int) -> DataFrame:
    """rows with grp: a new group begins where the step from the row before exceeds the gap."""
    w = W.partitionBy(*keys).orderBy(*order)
    began = F.coalesce((at - F.lag(at).over(w) > gap).cast("int"), F.lit(0))
    return rows.withColumn("_b", began).withColumn("grp", F.sum("_b").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_b")


def kept_apart(sorted_places: Column, gap: int) -> Column:
    """Greedy: a place stays if it is further than the gap from the last that stayed. struct<n, last>, nothing else is carried."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("last"))

    def on(s, x):
        stays = s["last"].isNull() | (x - s["last"] > gap)
        return F.struct((s["n"] + stays.cast("long")).alias("n"), F.when(stays, x).otherwise(s["last"]).alias("last"))

    return F.aggregate(sorted_places, start, on)


def overlap(a: str, b: str) -> Column:
    """Whether two rectangles, given by prefixes, share an area."""
    right, low = (lambda p: F.col(f"{p}left") + F.col(f"{p}width")), (lambda p: F.col(f"{p}top") + F.col(f"{p}height"))
    return (F.col(f"{a}left") < right(b)) & (F.col(f"{b}left") < right(a)) & (F.col(f"{a}top") < low(b)) & (F.col(f"{b}top") < low(a))


def row_clusters(boxes: DataFrame, tolerance: float = 18.0) -> DataFrame:
    """Exact greedy rows of a page: by top, each box joins the closest row with a member centre within the tolerance, else opens one.

    The order of boxes matters, so a page is one group of a Pandas function. The closest member is looked up in the sorted centres: n log n
    comparisons for n boxes, also where a page is one long line."""

    def cluster(page):
        page = page.sort_values(["top", "left", "ln", "pos"])
        centres: list[float] = []
        row_of: dict[float, int] = {}
        out, n = [], 0
        for y in (page["top"] + page["height"] / 2).tolist():
            row = row_of.get(y)
            if row is None:
                at = bisect_left(centres, y)
                near = [(abs(y - c), row_of[c]) for c in centres[max(0, at - 1) : at + 1]]
                apart, row = min(near, default=(tolerance + 1, n))
                if apart > tolerance:
                    row, n = n, n + 1
                centres.insert(at, y)
                row_of[y] = row
            out.append(row)
        return page.assign(row=out)[["doc_id", "page", "ln", "pos", "text", "row"]]

    return boxes.groupBy("doc_id", "page").applyInPandas(cluster, "doc_id long, page int, ln int, pos int, text string, row int")


def same_ink(boxes: DataFrame, height: float, share: float = 0.6, text: bool = True) -> DataFrame:
    """Greedy, rereads first, then by confidence (none: 0) and length: a box stays unless one that stayed is of the same script, less than
    0.7 of the height away, and shares more than the share (below 1) of the narrower one's width.

    boxes has source besides the usual columns; text=False leaves the texts out of the result. A window deals and ranks the boxes, a Python
    step takes whole pages, many at a time, and decides them in n log n steps (`outshone`)."""
    rank = [F.coalesce(F.col("source") == "targeted_ocr", F.lit(False)).desc(), F.coalesce("confidence", F.lit(0)).desc(), F.coalesce("n", F.lit(-1)).desc(), "ln", "pos", "left", "y", "width"]
    number = lambda c: c.cast("double")
    shapes = [F.length("text").alias("n"), F.coalesce(has_arabic(F.col("text")), F.lit(False)).alias("arabic"), number(F.col("top") + F.col("height") / 2).alias("y"), number(F.col("left")).alias("left"), number(F.col("width")).alias("width")]
    own = ["doc_id", "page", "ln", "pos", *(["text"] if text else [])]
    placed = boxes.select(*own, "source", "confidence", *shapes)
    ranked = placed.select(*own, "arabic", "y", "left", "width", F.row_number().over(W.partitionBy("doc_id", "page").orderBy(*rank)).alias("rank"))

    def pick(batches):
        for rows in whole_groups(batches, ["doc_id", "page"]):
            page, arabic, y, left, width, order = (rows[c].to_numpy() for c in ("group", "arabic", "y", "left", "width", "rank"))
            gone = np.zeros(len(page), bool)
            at = np.flatnonzero((width > 0) & ~np.isnan(y) & ~np.isnan(left))
            gone[at] = outshone(2 * page[at] + arabic[at], y[at], left[at], width[at], order[at], height, share)
            yield from rows.select(own).append_column("kept", pa.array(~gone)).combine_chunks().to_batches()

    return ranked.mapInArrow(pick, StructType([*(ranked.schema[c] for c in own), StructField("kept", BooleanType())]))


def whole_groups(batches, keys: list[str], rows: int = 100_000):
    """Arrow tables of about so many rows from batches in which rows of equal keys follow each other; no group is cut, and group numbers them."""
    held: list = []
    least = rows

    def numbered(table):
        began = np.zeros(len(table), bool)
        for k in keys:
            began[pc.run_end_encode(table[k].combine_chunks()).run_ends.to_numpy()[:-1]] = True
        return np.cumsum(began)

    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) < least:
            continue
        table = pa.Table.from_batches(held)
        group = numbered(table)
        cut = int(np.searchsorted(group, group[-1]))
        if cut:
            yield table.slice(0, cut).append_column("group", pa.array(group[:cut]))
            held = table.slice(cut).combine_chunks().to_batches()
        least = max(rows, 2 * sum(map(len, held)))
    if sum(map(len, held)):
        table = pa.Table.from_batches(held)
        yield table.append_column("group", pa.array(numbered(table)))


def outshone(key, y, left, width, rank, height: float, share: float, few: int = 8):
    """Which boxes go under the rule of same_ink, as a mask; boxes meet under equal keys alone, widths are positive.

    Lanes end where the next centre is too far away, islands within a lane where the next box begins behind all before it. Boxes alone on
    their island stay. Islands of few boxes are decided together, pair by pair; on others a box looks up what is near it."""
    apart, size = 0.7 * height, len(y)
    gone = np.zeros(size, bool)
    if not size:
        return gone
    right = left + width
    order = np.lexsort((y, key))
    lane = np.empty(size, np.int64)
    lane[order] = np.cumsum(np.r_[False, (np.diff(key[order]) != 0) | (np.diff(y[order]) >= apart)])
    order = np.lexsort((left, lane))
    places = np.empty(size, np.int64)
    by_right = np.argsort(right)
    places[by_right] = np.arange(size)
    furthest = right[by_right][np.maximum.accumulate(lane[order] * size + places[order]) % size]
    island = np.cumsum(np.r_[False, (np.diff(lane[order]) != 0) | (left[order][1:] >= furthest[:-1])])
    boxes_on = np.bincount(island)[island]

    def same(i, j):
        shared = np.minimum(right[i], right[j]) - np.maximum(left[i], left[j])
        return (np.abs(y[i] - y[j]) < apart) & (shared > 0) & (shared > share * np.minimum(width[i], width[j]))

    higher, lower = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    at = np.flatnonzero((boxes_on > 1) & (boxes_on <= few))
    for step in range(1, few):
        at = at[at + step < size]
        at = at[island[at] == island[at + step]]
        i, j = order[at], order[at + step]
        met = same(i, j)
        i, j = i[met], j[met]
        first = rank[i] < rank[j]
        higher.append(np.where(first, i, j))
        lower.append(np.where(first, j, i))
    high, low = np.concatenate(higher), np.concatenate(lower)
    while len(high):
        contested = np.zeros(size, bool)
        contested[low] = True
        gone[low[~contested[high]]] = True
        left_over = ~(gone[high] | gone[low])
        high, low = high[left_over], low[left_over]

    many = np.flatnonzero(boxes_on > few)
    for own in np.split(order[many], np.flatnonzero(np.diff(island[many])) + 1) if len(many) else []:
        own = own[np.argsort(rank[own])]
        gone[own] = _outshone_one_by_one(y[own].tolist(), left[own].tolist(), width[own].tolist(), height, share)
    return gone


def _outshone_one_by_one(ys: list[float], lefts: list[float], widths: list[float], height: float, share: float) -> list[bool]:
    """Boxes in their order. Those that stayed are held by bands of half the height: in one band none lies within another, so their left
    and right ends have one order, and of those that a box meets all but the outer ones lie within it, the first of which decides."""
    bands: dict[int, tuple[list[float], list[float], list[float], list[float]]] = {}
    gone = []
    for y, left, width in zip(ys, lefts, widths, strict=True):
        right, band, met = left + width, int(2 * y // height), False
        for near in range(band - 2, band + 3):
            if near not in bands:
                continue
            begins, ends, breadths, centres = bands[near]
            for k in range(bisect_right(ends, left), bisect_left(begins, right)):
                shared = min(right, ends[k]) - max(left, begins[k])
                if abs(centres[k] - y) < 0.7 * height and 0 < shared > share * min(width, breadths[k]):
                    met = True
                    break
            if met:
                break
        gone.append(met)
        if not met:
            own = bands.setdefault(band, ([], [], [], []))
            k = bisect_left(own[0], left)
            for held, value in zip(own, (left, right, width, y), strict=True):
                held.insert(k, value)
    return gone


def stacked(upper: DataFrame, lower: DataFrame, keys: list[str], down: int, aside: int) -> DataFrame:
    """Boxes of upper with one of lower under them: less than down below, less than aside to either side.

    Tops are cut into bands of that height, so the band is a key of the join too."""
    band = F.floor(F.col("top") / down)
    right = lower.select(*keys, F.col("top").alias("_t"), F.col("left").alias("_l"), F.explode(F.array(band, band - 1)).alias("_band"))
    left = upper.withColumn("_band", band)
    dy = right["_t"] - left["top"]
    on = [left[k] == right[k] for k in [*keys, "_band"]] + [(dy > 0) & (dy < down) & (F.abs(right["_l"] - left["left"]) < aside)]
    return left.join(right, on, "left_semi").drop("_band")


def first_label(labels: DataFrame, values: DataFrame, keys: list[str], reach: int) -> DataFrame:
    """For each field its first label with any value in reach (4 |dy| + |dx|), and there the value on the same line, else the closest."""
    left = labels.select(*keys, F.col("text").alias("field"), *(F.col(c).alias(f"l_{c}") for c in ("ln", "pos", "left", "top")))
    right = values.select(*keys, *(F.col(c).alias(f"v_{c}") for c in ("text", "ln", "pos", "left", "top")))
    apart = 4 * F.abs(F.col("v_top") - F.col("l_top")) + F.abs(F.col("v_left") - F.col("l_left"))
    order = F.struct("l_ln", "l_pos", (F.col("v_ln") != F.col("l_ln")).cast("int").alias("off"), apart.alias("apart"), "v_ln", "v_pos", F.col("v_text").alias("value"))
    return left.join(right, keys).where(apart <= reach).groupBy(*keys, "field").agg(F.min(order).alias("v"))


def rotated(left: Column, top: Column, width: Column, height: Column, page_width: Column, page_height: Column, turn: Column) -> dict[str, Column]:
    """A box after its page was turned clockwise by 0, 90, 180 or 270 degrees."""
    by = lambda none, quarter, half, back: F.when(turn == 90, quarter).when(turn == 180, half).when(turn == 270, back).otherwise(none)
    right, low = page_width - left - width, page_height - top - height
    return {"left": by(left, low, right, top), "top": by(top, left, low, right), "width": by(width, height, width, height), "height": by(height, width, height, width)}


def clamped(c: Column, extent: Column) -> Column:
    return F.greatest(F.lit(0), F.least(c, extent))


def bidirectional(rtl: Column, left: Column, text: Column) -> Column:
    """Texts of a group joined in reading order: left-to-right ones by their left edge, then right-to-left ones from the right."""
    held = F.array_sort(F.collect_list(F.struct(rtl.alias("r"), F.when(rtl, -left).otherwise(left).alias("k"), text.alias("t"))))
    return F.array_join(F.transform(held, lambda h: h["t"]), " ")


def chains(boxes: DataFrame, height: float) -> DataFrame:
    """Headings of several lines: by top, a box joins the first group whose last box is less than 1.2 heights aside and less than 1.8 above it.

    Which group a box joins depends on those before, so a page is one group of a Pandas function; headings are those that the caller chose."""

    def chain(page):
        page = page.sort_values(["top", "left", "ln", "pos"])
        last: list[tuple[float, float]] = []
        groups = []
        for x, y in zip((page["left"] + page["width"] / 2).tolist(), (page["top"] + page["height"] / 2).tolist(), strict=True):
            group = next((k for k, (a, b) in enumerate(last) if abs(x - a) < 1.2 * height and 0 < y - b < 1.8 * height), len(last))
            last[group : group + 1] = [(x, y)]
            groups.append(group)
        return page.assign(chain=groups)[["doc_id", "page", "ln", "pos", "text", "chain"]]

    return boxes.groupBy("doc_id", "page").applyInPandas(chain, "doc_id long, page int, ln int, pos int, text string, chain int")


def straightened(boxes: DataFrame, keys: list[str], far: float = 0.15) -> DataFrame:
    """boxes (with slope, null where not measured) and height and flat: the page's median height (20 without any), and the place down the page
    without its median slope. Slopes of far or more don't count."""
    page = boxes.groupBy(*keys).agg(F.coalesce(F.median(F.when(F.col("height") > 0, F.col("height"))), F.lit(20.0)).alias("_h"), F.coalesce(F.median(F.when(F.abs("slope") < far, F.col("slope"))), F.lit(0.0)).alias("_s"))
    flat = F.col("top") + F.col("height") / 2 - F.col("_s") * (F.col("left") + F.col("width") / 2)
    return boxes.join(page, keys).withColumn("flat", flat).withColumnRenamed("_h", "usual").withColumnRenamed("_s", "skew")


def nearest_match(labels: Column, left: Column, width: Column, text: Column, pattern: str) -> Column:
    """The match of the pattern in a box's text that stands closest to a place: a match lies at the share of the box's width that its middle has in the
    text. struct<apart, at, m>, null without a match."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    placed = F.transform(found, lambda m, k: F.struct((F.length(F.array_join(F.slice(gaps, 1, k + 1), "")) + F.length(F.array_join(F.slice(found, 1, k), ""))).alias("at"), m.alias("m")))
    middle = lambda p: left + width * (2 * p["at"] + F.length(p["m"])) / 2 / F.greatest(F.length(text), F.lit(1))
    return F.array_min(F.transform(placed, lambda p: F.struct(F.abs(middle(p) - labels).alias("apart"), p["at"].alias("at"), p["m"].alias("m"))))
