"""Layout operators on small grids with ties, nulls and empty sides."""

from pyspark.sql import functions as F

from boxwise.operators.layout import anchor_bands, best_template, column_of, composed, eligible_pages, label_match, labelled, last_wins, matched_or_largest, orientation, promoted, runs, with_peer


def test_column_of_leaves_out_ties_and_far_cells(spark):
    heads = spark.createDataFrame([(1, "a", 0), (1, "b", 100)], "p int, col string, head_x int")
    cells = spark.createDataFrame([(1, x) for x in (-70, -40, 10, 50, 51, 90, 158, 159)] + [(2, 0)], "p int, x int")
    got = column_of(cells, heads, ["p"], "x", 15, 58).select("x", "col").collect()
    assert sorted(map(tuple, got)) == [(-40, "a"), (10, "a"), (51, "b"), (90, "b"), (158, "b")]


def test_anchor_bands_take_only_unique_codes(spark):
    rows = spark.createDataFrame([(1, "x", 0), (1, "y", 4), (1, "z", 6), (1, "z", 8), (1, "u", 9), (1, "v", 9)], "p int, text string, ln long")
    got = anchor_bands(rows, ["p"], "text", "ln").select("code", "lo", "hi").collect()
    assert sorted(map(tuple, got)) == [("x", None, 2.0), ("y", 2.0, None)]
    assert not anchor_bands(rows.limit(0), ["p"], "text", "ln").count()


def test_with_peer_needs_a_neighbour(spark):
    rows = spark.createDataFrame([(1, 0), (1, 10), (1, 50), (2, 5)], "p int, x int")
    assert sorted(r["x"] for r in with_peer(rows, ["p"], "x", 20).collect()) == [0, 10]


def test_runs_split_after_wide_steps(spark):
    rows = spark.createDataFrame([(1, x) for x in (0, 3, 3, 20, 22)], "p int, x int")
    assert sorted(map(tuple, runs(rows, ["p"], "x", 4).select("n", "first", "last").collect())) == [(2, 0, 3), (2, 20, 22)]


def test_promoted_passes_gates_and_breaks_ties_by_order(spark):
    rows = spark.createDataFrame([(1, "a", 80, 7), (1, "a", 80, 3), (1, "a", 69, 1), (1, "b", 99, 4), (1, None, 99, 5), (1, "a", None, 6)], "k int, kind string, conf int, at int")
    got = promoted(rows, ["k"], "kind", "conf", {"a": 70}, "at").collect()
    assert [tuple(r) for r in got] == [(1, "a", 2, 3, 80)]


def test_last_wins_and_matched_or_largest(spark):
    rows = spark.createDataFrame([(1, 1, 5), (1, 2, 9), (1, 3, 7)], "k int, at int, v int")
    assert last_wins(rows, ["k"], ["at"], "v").first()["v"] == 7
    value, review = matched_or_largest(F.col("v"), F.lit(6), 1)
    assert tuple(rows.agg(value.alias("v"), review.alias("r")).first()) == (7, False)
    value, review = matched_or_largest(F.col("v"), F.lit(None).cast("int"), 1)
    assert tuple(rows.agg(value.alias("v"), review.alias("r")).first()) == (9, True)
    assert tuple(rows.limit(0).agg(value.alias("v"), review.alias("r")).first()) == (None, None)


def test_label_match_prefers_the_longest_alias(spark):
    rows = spark.createDataFrame([("total vat",), ("vat no 5",), ("5 vat",), ("none",), (None,)], "t string")
    alias, rest = label_match(F.col("t"), ["vat", "vat no", "total"])
    assert [tuple(r) for r in rows.select(alias, rest).collect()] == [("total", " vat"), ("vat no", " 5"), ("vat", "5 "), (None, None), (None, None)]


def test_eligible_pages_templates_addresses_and_turns(spark):
    text = "a" * 12
    rows = [(1, text, 0, 10)] * 4 + [(2, text, 0, 10)] * 3 + [(3, text, 0, 10)] * 3 + [(3, text + "�", 0, 10)] + [(4, text, 95, 10)] * 4
    got = eligible_pages(spark.createDataFrame(rows, "p int, text string, left int, width int"), ["p"], 100).collect()
    assert {r["p"]: r["eligible"] for r in got} == {1: True, 2: False, 3: False, 4: False}
    one = {"x": ["a", "b"], "y": ["b", "c"]}
    texts = spark.createDataFrame([("a b",), ("b",), ("b c",), ("",), (None,)], "t string")
    assert [r[0] for r in texts.select(best_template(F.col("t"), one)).collect()] == ["x", "x", "y", None, None]
    parts = spark.createDataFrame([("a", None, "c"), ("a", "", None), (None, None, None)], "a string, b string, c string")
    assert [r[0] for r in parts.select(composed([F.col(c) for c in "abc"])).collect()] == ["a, c", None, None]
    turns = spark.createDataFrame([(90, 90), (90, 89), (0, 99), (45, 99), (None, 99), (180, None)], "t int, c int")
    assert [tuple(r) for r in turns.select(*orientation(F.col("t"), F.col("c"))).collect()] == [(90, "turned"), (0, "unsure"), (0, "upright"), (0, "unknown"), (0, "unknown"), (0, "unsure")]


def test_labelled_takes_the_tail_or_the_follower(spark):
    rows = spark.createDataFrame([("No:7", "x"), ("No:", "x"), ("No:", None), ("none", "x")], "t string, f string")
    assert [tuple(r) for r in rows.select(*labelled(F.col("t"), F.col("f"))).collect()] == [("No", "7"), ("No", "x"), ("No", None), ("", "x")]
