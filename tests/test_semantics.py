"""Greedy and rounding rules against plain loops, on data where simpler rules differ."""

import random
import time

import pytest
from pyspark.sql import functions as F

from boxwise.functions import scalars as S
from boxwise.operators.corpus import hash_split
from boxwise.operators.geometry import chains, kept_apart, nearest, nearest_match, row_clusters, same_ink

BOX = "doc_id long, page int, ln int, pos int, text string, left int, top int, width int, height int, confidence int, source string"


def jumbled(n, seed):
    r = random.Random(seed)
    words = ["ab", "abcdef", "كلمة", "x" * 12]
    return [(1, 1, k // 10, k % 10, f"{r.choice(words)}{k}", r.randrange(300), r.randrange(200), r.randrange(10, 90), r.choice([10, 20, 40]), r.randrange(100), r.choice(["ocr", "targeted_ocr"])) for k in range(n)]


def test_rows_join_the_closest(spark):
    rows = jumbled(120, 5)
    got = {(r["ln"], r["pos"]): r["row"] for r in row_clusters(spark.createDataFrame(rows, BOX), 6.0).collect()}
    held: list[list[float]] = []
    for r in sorted(rows, key=lambda r: (r[6], r[5], r[2], r[3])):
        y = r[6] + r[8] / 2
        near = [(min(abs(y - m) for m in own), k) for k, own in enumerate(held)]
        best = min((x for x in near if x[0] <= 6), default=None)
        if best is None:
            held.append([])
            best = (0, len(held) - 1)
        held[best[1]].append(y)
        assert got[r[2], r[3]] == best[1]


def test_same_ink_is_greedy(spark):
    rows = jumbled(200, 9)
    got = {(r["ln"], r["pos"]): r["kept"] for r in same_ink(spark.createDataFrame(rows, BOX), 20).collect()}
    arabic = lambda r: any("؀" <= c <= "ۿ" for c in r[4])
    kept: list[tuple] = []
    for r in sorted(rows, key=lambda r: (r[10] != "targeted_ocr", -r[9], -len(r[4]), r[2], r[3])):
        y = lambda b: b[6] + b[8] / 2
        same = any(arabic(r) == arabic(k) and abs(y(r) - y(k)) < 14 and max(0, min(r[5] + r[7], k[5] + k[7]) - max(r[5], k[5])) > 0.6 * min(r[7], k[7]) for k in kept)
        assert got[r[2], r[3]] is not same
        if not same:
            kept.append(r)
    assert 20 < len(kept) < 180


def stayed_by_loops(rows, height, share):
    arabic = lambda r: any("؀" <= c <= "ۿ" for c in r[4] or "")
    y = lambda b: b[6] + b[8] / 2
    kept: list[tuple] = []
    for r in sorted(rows, key=lambda r: (r[10] != "targeted_ocr", -(r[9] or 0), -(-1 if r[4] is None else len(r[4])), r[2], r[3])):
        if r[6] is None or not any(r[:2] == k[:2] and arabic(r) == arabic(k) and abs(y(r) - y(k)) < 0.7 * height and max(0, min(r[5] + r[7], k[5] + k[7]) - max(r[5], k[5])) > share * min(r[7], k[7]) for k in kept if k[6] is not None):
            kept.append(r)
    return {r[:4] for r in kept}


@pytest.mark.parametrize("n,height,share,spread", [(300, 20, 0.6, 300), (300, 7, 0.6, 2000), (300, 20, 0.9, 60), (300, 20, 0.0, 4000), (400, 13, 0.3, 900)])
def test_same_ink_on_pages_of_any_density(spark, n, height, share, spread):
    r = random.Random(n + spread)
    rows = []
    for k in range(n):
        text = r.choice(["ab", "abcdef", "كلمة", "x" * 12, "", None])
        shape = (r.choice([r.randrange(spread), r.randrange(spread) + 0.25]) * 1.0, r.choice([r.randrange(200) * 0.7, float(r.randrange(200)), None]) if k % 50 == 0 else r.randrange(200) * 0.7, r.choice([0.0, 3.0, r.randrange(10, 90) * 1.0, spread / 2]), r.choice([10.0, 20.0, 41.0]))
        rows.append((r.choice(["a", "b"]), r.choice([1, 1, 2]), k // 10, k % 10, text, *shape, r.choice([None, 0, 10, 55, 90]), r.choice(["ocr", "targeted_ocr", None])))
    df = spark.createDataFrame(rows, BOX.replace("doc_id long", "doc_id string").replace("left int, top int, width int, height int", "left double, top double, width double, height double"))
    out = same_ink(df, height, share).collect()
    assert len(out) == n
    assert {(b["doc_id"], b["page"], b["ln"], b["pos"]) for b in out if b["kept"]} == stayed_by_loops(rows, height, share)
    assert {(b["doc_id"], b["ln"], b["pos"], b["text"]) for b in out} == {(b[0], *b[2:5]) for b in rows}


def test_same_ink_on_one_long_line(spark):
    """40,000 boxes that overlap in one chain, in another document copies of one box: neither takes a comparison of all pairs."""
    word = spark.range(20_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit(1).alias("page"), F.lit(0).alias("ln"), F.col("id").cast("int").alias("pos"), F.lit("abcdef").alias("text"), (F.col("id") * 56).cast("int").alias("left"), F.lit(0).alias("top"), F.lit(48).alias("width"), F.lit(20).alias("height"), F.lit(90).alias("confidence"), F.lit("ocr").alias("source"))
    again = word.withColumns({"left": F.expr("left + if(pos % 3 = 0, 24, 16)"), "pos": F.expr("pos + 1000000"), "confidence": F.lit(10)})
    copies = word.withColumns({"doc_id": F.lit(2).cast("long"), "left": F.lit(5)})
    began = time.monotonic()
    got = same_ink(word.unionByName(again).unionByName(copies), 20).groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if("kept").alias("kept"), F.count_if(F.expr("kept and pos >= 1000000")).alias("again")).collect()
    assert {tuple(r) for r in got} == {(1, 40_000, 20_000 + 6_667, 6_667), (2, 20_000, 1, 0)}
    assert time.monotonic() - began < 30


def test_nearest_bounds_the_score(spark):
    rows = jumbled(150, 3)
    df = spark.createDataFrame(rows, BOX).drop("source", "confidence", "height").withColumn("height", F.lit(20))
    got = {(r["l_ln"], r["l_pos"]): (r["v"]["score"], r["v"]["ln"], r["v"]["pos"]) for r in nearest(df.where("ln < 5"), df, ["doc_id", "page"], 120, 30).collect()}
    wanted = {}
    for a in (r for r in rows if r[2] < 5):
        near = [(3 * abs(b[6] - a[6]) + abs(b[5] + b[7] / 2 - a[5] - a[7] / 2), b[2], b[3]) for b in rows if b is not a and abs(b[6] - a[6]) <= 30]
        best = min((x for x in near if x[0] <= 120), default=None)
        if best:
            wanted[a[2], a[3]] = best
    assert got == wanted


@pytest.mark.parametrize("n,size", [(3, 1), (10, 2), (25, 4), (30, 4)])
def test_splits_round_half_to_even(spark, n, size):
    got = [r["split"] for r in hash_split(spark.range(n).select(F.col("id").cast("string").alias("g")), "g").collect()]
    assert [got.count(s) for s in ("test", "validation", "train")] == [size, size, n - 2 * size]


def test_two_groups_are_too_few(spark):
    with pytest.raises(Exception, match="three groups"):
        hash_split(spark.range(2).select(F.col("id").cast("string").alias("g")), "g").collect()


def test_kept_apart(spark):
    got = spark.range(1).select(kept_apart(F.array(*(F.lit(x).cast("long") for x in (0, 5, 11, 12, 30))), 10).alias("s")).first()["s"]
    assert (got["n"], got["last"]) == (3, 30)


def test_chains_of_headings(spark):
    rows = jumbled(80, 11)
    got = {(r["ln"], r["pos"]): r["chain"] for r in chains(spark.createDataFrame(rows, BOX), 20.0).collect()}
    groups: list[list[tuple[float, float]]] = []
    for r in sorted(rows, key=lambda r: (r[6], r[5], r[2], r[3])):
        x, y = r[5] + r[7] / 2, r[6] + r[8] / 2
        own = next((g for g in groups if abs(x - g[-1][0]) < 24 and 0 < y - g[-1][1] < 36), None)
        if own is None:
            own = []
            groups.append(own)
        own.append((x, y))
        assert got[r[2], r[3]] == next(k for k, g in enumerate(groups) if g is own)
    assert 10 < len(groups) < 80


def test_nearest_match(spark):
    text = "1/2/2024 or 3-Mar-2025 or 2023.4.5"
    rows = spark.createDataFrame([(x, text) for x in (0, 160, 400)] + [(0, "no date"), (0, "")], "x int, t string")
    found = nearest_match(F.col("x"), F.lit(0), F.lit(400), F.col("t"), S.PRINTED_DATE)
    assert [r["m"] and r["m"]["m"] for r in rows.select(found.alias("m")).collect()] == ["1/2/2024", "3-Mar-2025", "2023.4.5", None, None]
