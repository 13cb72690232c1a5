import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from boxwise.functions import scalars as S
from boxwise.functions.scalars import draft_json
from boxwise.functions.words import arabic_amount, english_amount
from boxwise.operators.audits import dominant, lost_rows, reviews
from boxwise.operators.checks import complete_sum, plausible, row_mode, upper_median
from boxwise.operators.corpus import schema_faults, unfinished
from boxwise.operators.geometry import rotated, row_clusters, stacked
from boxwise.sources.sinks import response, write_jsonl
from boxwise.sources.tables import payload_boxes, running_places, upright
from boxwise.streaming.files import payload_stream, write_once


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "t string").select(expr(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text,numeric,money,number",
    [("1,234.50", 1234.5, None, None), ("٣٤,٥", 34.5, 34.5, 34.5), ("15 %", None, None, None), ("15%", None, None, 15), ("12.50.", 12.5, None, 12.5), ("SAR 90", None, 90, None), ("3 PCS", 3, 3, None), ("", None, None, None), (None, None, None, None), ("-2,5", None, None, -2.5)],
)
def test_numbers(spark, text, numeric, money, number):
    got = [one(spark, f, text) for f in (S.numeric, S.money, S.number)]
    assert [None if g is None else float(g) for g in got] == [numeric, money, number]


def test_text(spark):
    assert one(spark, S.date_key, "5/3/2024") == one(spark, S.date_key, "2024-03-05") == "2024-03-05"
    assert one(spark, S.date_key, "soon") == "soon"
    assert one(spark, lambda c: S.phrase_in(c, "unit price"), "The Unit-Price:") is True
    assert one(spark, lambda c: S.phrase_in(c, "vat"), "private") is False
    assert one(spark, lambda c: S.typed(c, "vat"), "312345678901233") == "312345678901233"
    assert one(spark, lambda c: S.typed(c, "code"), "ABC") is None
    assert one(spark, lambda c: S.digits_of_length(c, [10]), "12 1234567890 99") == "1234567890"
    assert one(spark, lambda c: S.lost_digits(c, F.lit("1819")), "819") is True
    assert one(spark, lambda c: S.lost_digits(c, F.lit("1819")), "991") is False
    assert one(spark, S.compatible, "ﬁ①") == "fi1"
    assert one(spark, S.squashed, "أحـمد 12") == "احمد12" and one(spark, S.squashed, "مدرسة ىٱ پ") == "مدرسةىاپ"
    assert one(spark, S.date_key, "Date: 2020.1.2") == "Date: 2020.1.2" and one(spark, S.date_key, "31/2/2020") == "31-2-2020"


@pytest.mark.parametrize(
    "text,hundredths",
    [
        ("ThreeThousands Two Hundred and five Riyals and ten halalas only", 320510),
        ("Five riyals and 25 halalas", 525),
        ("one million two hundred thousand and seven", 120000700),
        ("Twenty-one, SAR and thirty h.", 2130),
        ("hundred riyals two", 10000),
        ("ten halalas", None),
        ("nothing here", None),
        ("", None),
        (None, None),
    ],
)
def test_english_words(spark, text, hundredths):
    assert one(spark, english_amount, text) == hundredths


@pytest.mark.parametrize(
    "text,hundredths",
    [
        ("فقط الف ومائتان وخمسون ريال سعودي لا غير", 125000),
        ("ثلاثمائة وخمسة عشر ألفا", None),
        ("المبلغ ثلاثمائة ريال و خمسون هللة", 30050),
        ("خمسة الاف واربعمئة وتسعون ريالا", 549000),
        ("الفان ريال وكلمة خمس هللات", None),
        ("كلمة خمسة غريبة ريال", None),
        ("بلا عملة", None),
        (None, None),
    ],
)
def test_arabic_words(spark, text, hundredths):
    assert one(spark, arabic_amount, text) == hundredths


def test_sums(spark):
    df = spark.createDataFrame([(1, 2), (1, None), (2, 3), (2, 4)], "k int, v int")
    got = {r["k"]: (r["s"], r["m"]) for r in df.groupBy("k").agg(complete_sum(F.col("v")).alias("s"), upper_median(F.col("v")).alias("m")).collect()}
    assert got == {1: (None, 2), 2: (7, 4)}


def test_every_operand_missing(spark):
    """A row is called impossible only if all five numbers are known."""
    full = (3, 500, 9000, 100, 20000)
    cases = [tuple(None if k in gone else v for k, v in enumerate(full)) for n in range(6) for gone in itertools.combinations(range(5), n)]
    df = spark.createDataFrame(cases, "q int, p int, a int, v int, g int")
    got = df.select("*", plausible(*(F.col(c) for c in "qpavg")).alias("ok")).collect()
    assert all(r["ok"] == any(r[c] is None for c in "qpavg") for r in got)


def test_row_modes(spark):
    df = spark.createDataFrame([(2, 100, 200, 30, 230, None), (2, 1479, 1479, 222, 3402, 0), (2, None, 200, 30, 230, 0), (2, 100, 900, 30, 230, 0)], "q int, p int, a int, v int, g int, d int")
    assert [r[0] for r in df.select(row_mode(*(F.col(c) for c in "qpavgd"))).collect()] == ["direct", "per_unit", "unresolved", "mismatch"]


def test_row_clusters(spark):
    df = spark.createDataFrame([(1, 1, k, 0, t, 0, y, 80, 20) for k, (t, y) in enumerate([("A", 100), ("B", 116), ("C", 160)])], "doc_id long, page int, ln int, pos int, text string, left int, top int, width int, height int")
    assert {r["text"]: r["row"] for r in row_clusters(df).collect()} == {"A": 0, "B": 0, "C": 1}


def test_payloads_and_stream(spark, tmp_path):
    box = {"text": "Total", "confidence": 91.5, "left": 1.0, "top": 2.0, "width": 3.0, "height": 4.0}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps({"pages": [{"page": 2, "words": [box, box | {"source": "native_text", "confidence": None}]}]}))
    got = payload_boxes(spark, str(tmp_path / "in")).collect()
    assert [(r["page"], r["source"]) for r in got] == [(2, "ocr"), (2, "native_text")]
    kept = [r["x"] for r in payload_boxes(spark, str(tmp_path / "in")).select(S.trusted(F.col("confidence"), F.col("source"), 95.0).alias("x")).collect()]
    assert kept == [False, True]
    seen = []
    write_once(payload_stream(spark, str(tmp_path / "in")), str(tmp_path / "cp"), lambda df, k: seen.append(df.count())).awaitTermination()
    assert sum(seen) == 2


def test_resume_and_schema(spark):
    s = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, sha string")
    done = spark.createDataFrame([("a", True, False), ("b", True, True)], "sha string, complete boolean, retryable boolean")
    assert sorted(r["id"] for r in unfinished(s, done, ["sha"]).collect()) == [2, 3]
    assert schema_faults(s, [("id", "int"), ("sha", "string")]) == []
    assert schema_faults(s, [("sha", "string"), ("id", "int")]) == ["order"]
    assert schema_faults(s, [("id", "bigint"), ("x", "int")]) == ["missing x", "extra sha", "id is int, not bigint"]


def test_draft_json(spark):
    texts = ['{"a": 1}', '```json\n{"a": 1}\n```', '```\n{"a": 1}\n```', '{"a": 1} {"a": 2}', '{"a": 1}, {"a": 2}', '{"a": 1} done {}', "[1]", "", None, '{"a": ', '  {"a": 1}  ']
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = {r["k"]: r["d"] for r in df.select("k", draft_json(F.col("t"), "struct<a: int>").alias("d")).collect()}
    assert {k for k, d in got.items() if d is not None and d["a"] == 1} == {0, 1, 2, 10}
    assert all(d is None or d["a"] is not None for d in got.values())


def test_lost_rows_and_stacked_against_brute_force(spark):
    rng = random.Random(4)
    before, after = ([(rng.randrange(4), rng.randrange(-30, 30)) for _ in range(60)] for _ in range(2))
    a, b = (spark.createDataFrame(x, "k long, p long") for x in (before, after))
    for tolerance in (0, 1, 3):
        wanted = sorted(x for x in before if not any(x[0] == y[0] and abs(x[1] - y[1]) <= tolerance for y in after))
        assert sorted(map(tuple, lost_rows(a, b, ["k"], "p", tolerance).collect())) == wanted
    boxes = [(rng.randrange(2), rng.randrange(100), rng.randrange(100)) for _ in range(80)]
    df = spark.createDataFrame(boxes, "doc_id long, top long, left long")
    wanted = sorted(x for x in boxes if any(x[0] == y[0] and 0 < y[1] - x[1] < 12 and abs(x[2] - y[2]) < 9 for y in boxes))
    assert sorted(map(tuple, stacked(df, df, ["doc_id"], 12, 9).collect())) == wanted


def test_turning_back(spark):
    """A quarter turn and three more give the box back."""
    df = spark.createDataFrame([(10, 20, 30, 5)], "left long, top long, width long, height long")
    w, h = 200, 100
    for _ in range(4):
        df = df.select(*(c.alias(n) for n, c in rotated(*(F.col(c) for c in ("left", "top", "width", "height")), F.lit(w), F.lit(h), F.lit(90)).items()))
        w, h = h, w
    assert tuple(df.first()) == (10, 20, 30, 5)


def test_sinks_and_polygons(spark, tmp_path):
    rows = spark.createDataFrame([("train", "a", 1.5), ("test", None, float("nan"))], "split string, name string, total double")
    write_jsonl(rows, f"file://{tmp_path}/out", "split")
    back = spark.read.schema("split string, name string, total double").json(f"file://{tmp_path}/out")
    assert sorted(map(tuple, back.select("split", "name", "total").collect()), key=str) == sorted([("train", "a", 1.5), ("test", None, None)], key=str)
    text = [r[0] for r in rows.select(response(F.col("name").isNotNull(), F.lit("NO_NAME"), name=F.col("name"))).collect()]
    assert [json.loads(t) for t in text] == [{"success": True, "error": None, "name": "a"}, {"success": False, "error": "NO_NAME", "name": None}]
    shapes = spark.createDataFrame([([[3.0, 1.0], [7.0, 2.0], [5.0, 9.0]],), ([],), (None,)], "polygon array<array<double>>")
    assert [tuple(r) for r in shapes.select(*upright("polygon")).collect()] == [(3, 1, 4, 8), (None,) * 4, (None,) * 4]


def test_vote_and_reviews(spark):
    rows = spark.createDataFrame([(1, "a", 8), (1, "b", 2), (2, "a", 5), (2, "b", 5), (3, None, 1)], "k long, v string, w long")
    assert {r["k"]: r["dominant"] for r in dominant(rows, ["k"], "v", F.col("w"), 80).collect()} == {1: "a", 2: None, 3: None}
    got = {r["k"]: (r["n"], r["reasons"]) for r in reviews(rows, ["k"], low=F.col("w") < 3, none=F.col("v").isNull()).collect()}
    assert got == {1: (1, "low"), 3: (2, "low,none")}
    assert reviews(rows.limit(0), ["k"], low=F.col("w") < 3).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 15, 16, 17, 33, 300, 2001])
def test_running_places_of_short_and_long_lines(spark, n):
    words = [("é" if k % 3 else "word") * (1 + k % 4) for k in range(n)]
    want = [sum(len(w) + 1 for w in words[:k]) for k in range(n)]
    df = spark.createDataFrame([(words,)], "words array<string>")
    assert df.select(running_places("words").alias("x")).first()["x"] == want
