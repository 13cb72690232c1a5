"""Geometry over boxes made from the words of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from boxwise.functions.scalars import digits_of_length, phrase_in, typed
from boxwise.operators.checks import upper_median
from boxwise.operators.geometry import in_interval, islands, kept_apart, midpoints, nearest, overlap, row_clusters, same_ink
from boxwise.operators.merges import uncovered
from boxwise.plans.registry import query
from boxwise.sources.tables import table, text_boxes


def boxes(spark: SparkSession, sf_dir: str, keyed: bool = True) -> DataFrame:
    """Boxes of all documents. Keyed ones are made after the texts were dealt by document: groups and windows over a
    document or its parts then shuffle no boxes (which take several times the room of the text), and the sides of a
    self-join share one scan."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return text_boxes(docs.repartition("doc_id") if keyed else docs)


BOXES = """WITH lines AS (SELECT doc_id, unnest(range(len(s))) AS ln, unnest(s) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)),
toks AS (SELECT doc_id, ln, unnest(range(len(t))) AS pos, unnest(t) AS text FROM (SELECT doc_id, ln, list_filter(string_split(line, ' '), lambda x: x <> '') AS t FROM lines)),
offs AS (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id, ln ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nx FROM (SELECT * FROM toks)),
boxes AS (SELECT doc_id, CAST(ln // 40 + 1 AS INT) AS page, CAST(ln AS BIGINT) AS ln, CAST(pos AS BIGINT) AS pos, text, CAST(nx * 8 AS BIGINT) AS x, CAST(ln * 20 AS BIGINT) AS y, CAST(length(text) * 8 AS BIGINT) AS w,
 CAST(50 + (31 * doc_id + 17 * pos + 7 * ln) % 50 AS BIGINT) AS conf FROM offs)
"""
KEY = ["doc_id", "page"]
LABEL = "(length(text) = 3 AND text LIKE 't%')"
VALUE = "(length(text) >= 12)"


def _typed(df: DataFrame) -> DataFrame:
    """Counters as long and short names, for output."""
    return df.select("doc_id", "page", F.col("ln").cast("long").alias("ln"), F.col("pos").cast("long").alias("pos"), "text", F.col("left").cast("long").alias("x"), F.col("top").cast("long").alias("y"), F.col("width").cast("long").alias("w"), F.col("confidence").cast("long").alias("conf"))


@query(BOXES + "SELECT * FROM boxes")
def doc_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _typed(boxes(spark, sf_dir, keyed=False))


@query(BOXES + """SELECT doc_id, page, count(*) AS n, median(w) AS mid, list_sort(list(w))[CAST(floor(count(*) / 2) AS INT) + 1] AS upper, CAST(min(conf) AS BIGINT) AS least, CAST(sum(conf) AS BIGINT) AS total, count_if(conf >= 80) AS sure FROM boxes GROUP BY 1, 2""")
def page_text_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _typed(boxes(spark, sf_dir))
    return b.groupBy(*KEY).agg(F.count("*").alias("n"), F.median("w").alias("mid"), upper_median(F.col("w")).alias("upper"), F.min("conf").alias("least"), F.sum("conf").alias("total"), F.count_if(F.col("conf") >= 80).alias("sure"))


@query(BOXES + "SELECT doc_id, ln, string_agg(text, ' ' ORDER BY pos) AS text, min(x) AS x0, max(x + w) AS x1 FROM boxes GROUP BY 1, 2")
def reading_order_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.array_sort(F.collect_list(F.struct("pos", "text")))
    return _typed(boxes(spark, sf_dir)).groupBy("doc_id", "ln").agg(F.array_join(F.transform(held, lambda h: h["text"]), " ").alias("text"), F.min("x").alias("x0"), F.max(F.col("x") + F.col("w")).alias("x1"))


@query("""WITH s AS (SELECT event_id, user_id, ts, CASE WHEN datediff('microsecond', lag(ts) OVER w, ts) > 3600000000 THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS grp FROM s) SELECT user_id, CAST(grp AS BIGINT) AS grp, count(*) AS n, min(event_id) AS first_event FROM g GROUP BY 1, 2""")
def row_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    g = islands(table(spark, sf_dir, "events"), ["user_id"], at, ["ts", "event_id"], 3_600_000_000)
    return g.groupBy("user_id", "grp").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


@query("""WITH RECURSIVE e AS (SELECT user_id, datediff('second', TIMESTAMP '2000-01-01', ts) AS s, row_number() OVER (PARTITION BY user_id ORDER BY datediff('second', TIMESTAMP '2000-01-01', ts)) AS k FROM events),
f AS (SELECT user_id, s AS kept, s, k, 1 AS n FROM e WHERE k = 1 UNION ALL SELECT e.user_id, CASE WHEN e.s - f.kept > 86400 THEN e.s ELSE f.kept END, e.s, e.k, f.n + CASE WHEN e.s - f.kept > 86400 THEN 1 ELSE 0 END FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1)
SELECT user_id, CAST(max(n) AS BIGINT) AS n, max(kept) AS last FROM f GROUP BY user_id""")
def greedy_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.floor(F.unix_micros(F.date_trunc("second", F.col("ts").cast("timestamp"))) / 1_000_000).cast("long") - 946684800
    kept = kept_apart(F.array_sort(F.collect_list(s)), 86400)
    return table(spark, sf_dir, "events").groupBy("user_id").agg(kept.alias("a")).select("user_id", "a.n", "a.last")


@query(BOXES + "SELECT doc_id, ln, pos, (lag(x) OVER w1 + x) / 2 AS lo, (lead(x) OVER w1 + x) / 2 AS hi FROM boxes WINDOW w1 AS (PARTITION BY doc_id, ln ORDER BY x)")
def column_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _typed(boxes(spark, sf_dir))
    return midpoints(b, ["doc_id", "ln"], "x").select("doc_id", "ln", "pos", "lo", "hi")


@query(BOXES + """, heads AS (SELECT doc_id, page, pos AS col, coalesce((lag(x) OVER w1 + x) / 2, -1) AS lo FROM boxes WHERE ln % 40 = 0 WINDOW w1 AS (PARTITION BY doc_id, page ORDER BY x)),
body AS (SELECT * FROM boxes WHERE ln % 40 > 0)
SELECT b.doc_id, b.ln, b.pos, h.col FROM body b ASOF JOIN heads h ON b.doc_id = h.doc_id AND b.page = h.page AND b.x >= h.lo""")
def column_bucket_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _typed(boxes(spark, sf_dir))
    heads = midpoints(b.where("ln % 40 = 0"), KEY, "x").select(*KEY, F.col("pos").alias("col"), "lo")
    return in_interval(b.where("ln % 40 > 0").select(*KEY, "ln", "pos", "x"), heads, KEY, "x").select("doc_id", "ln", "pos", "col")


@query(BOXES + f""", m AS (SELECT l.doc_id, l.page, l.ln, l.pos, l.text, 3 * abs(v.y - l.y) + abs(v.x + v.w / 2 - l.x - l.w / 2) AS score, v.ln AS vl, v.pos AS vp, v.text AS value FROM boxes l JOIN boxes v ON l.doc_id = v.doc_id AND l.page = v.page
 WHERE (length(l.text) = 3 AND l.text LIKE 't%') AND length(v.text) >= 12 AND abs(v.y - l.y) <= 100 AND 3 * abs(v.y - l.y) + abs(v.x + v.w / 2 - l.x - l.w / 2) <= 450)
SELECT doc_id, page, ln, pos, text AS label, arg_min(value, (score, vl, vp)) AS value, min(score) AS score FROM m GROUP BY 1, 2, 3, 4, 5""")
def nearest_label_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(spark, sf_dir)
    got = nearest(b.where(LABEL), b.where(VALUE), KEY, 450, 100)
    return got.select(*KEY, F.col("l_ln").cast("long").alias("ln"), F.col("l_pos").cast("long").alias("pos"), F.col("l_text").alias("label"), F.col("v.text").alias("value"), F.col("v.score").alias("score"))


@query(BOXES + """, m AS (SELECT l.doc_id, l.page, l.ln, l.pos, v.text AS value, v.x - l.x - l.w AS gap, v.conf, v.pos AS vp FROM boxes l JOIN boxes v ON l.doc_id = v.doc_id AND l.page = v.page
 WHERE (length(l.text) = 3 AND l.text LIKE 't%') AND length(v.text) >= 8 AND abs(v.y - l.y) <= 10 AND v.x >= l.x + l.w - 5 AND v.x - l.x - l.w <= 240),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page, value ORDER BY gap, -conf, ln, pos, vp) AS k FROM m) SELECT doc_id, page, value, ln, pos, gap, conf FROM r WHERE k = 1""")
def directional_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values to the right of a label on its line; per page and value the best candidate."""
    b = _typed(boxes(spark, sf_dir))
    v = b.where("length(text) >= 8").select(*KEY, F.col("text").alias("value"), F.col("x").alias("vx"), F.col("y").alias("vy"), F.col("pos").alias("vp"), F.col("conf").alias("vc"))
    m = b.where(LABEL).join(v, KEY).where("abs(vy - y) <= 10 and vx >= x + w - 5 and vx - x - w <= 240").withColumn("gap", F.expr("vx - x - w"))
    k = F.row_number().over(W.partitionBy(*KEY, "value").orderBy("gap", -F.col("vc"), "ln", "pos", "vp"))
    return m.withColumn("k", k).where("k = 1").select(*KEY, "value", "ln", "pos", "gap", F.col("vc").alias("conf"))


@query(BOXES + """, m AS (SELECT l.doc_id, l.ln, l.pos, v.pos AS vp, v.text AS value, length(v.text) >= 8 AS good, (length(v.text) = 3 AND v.text LIKE 't%') AS stop FROM boxes l JOIN boxes v ON l.doc_id = v.doc_id AND l.page = v.page AND l.ln = v.ln AND v.pos > l.pos WHERE (length(l.text) = 3 AND l.text LIKE 't%')),
b AS (SELECT doc_id, ln, pos, min(CASE WHEN stop THEN vp END) AS barrier FROM m GROUP BY 1, 2, 3)
SELECT m.doc_id, m.ln, m.pos, arg_min(value, vp) AS value, min(vp) AS at FROM m JOIN b ON m.doc_id = b.doc_id AND m.ln = b.ln AND m.pos = b.pos WHERE good AND (barrier IS NULL OR vp < barrier) GROUP BY 1, 2, 3""")
def barrier_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first value after a label that comes before the next label of the line.

    Seen from the value: the last label before it on its line owns it, so two windows over a line do and no pair is made."""
    b = _typed(boxes(spark, sf_dir))
    is_label = F.expr(LABEL)
    before = W.partitionBy("doc_id", "ln").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    owner = F.last(F.when(is_label, F.col("pos")), ignorenulls=True).over(before)
    owned = b.withColumn("owner", owner).where((F.length("text") >= 8) & F.col("owner").isNotNull())
    return owned.groupBy("doc_id", "ln", F.col("owner").alias("pos")).agg(F.min_by("text", F.col("pos")).alias("value"), F.min("pos").alias("at")).select("doc_id", "ln", "pos", "value", "at")


@query(BOXES + """, a AS (SELECT doc_id, page, ln AS a, row_number() OVER (PARTITION BY doc_id, page ORDER BY ln) AS k, lead(ln) OVER (PARTITION BY doc_id, page ORDER BY ln) AS z FROM (SELECT DISTINCT doc_id, page, ln FROM boxes WHERE pos = 0 AND length(text) <= 4))
SELECT b.doc_id, b.page, a.k AS section, count(*) AS n, min(b.ln) AS first_line FROM boxes b JOIN a ON b.doc_id = a.doc_id AND b.page = a.page AND b.ln >= a.a AND (a.z IS NULL OR b.ln < a.z) GROUP BY 1, 2, 3""")
def section_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes by the section that holds their line; a running count of headings names it, without a join."""
    b = _typed(boxes(spark, sf_dir)).withColumn("head", ((F.col("pos") == 0) & (F.length("text") <= 4)).cast("long"))
    section = F.sum("head").over(W.partitionBy(*KEY).orderBy("ln").rangeBetween(W.unboundedPreceding, 0))
    return b.withColumn("section", section).where("section > 0").groupBy(*KEY, "section").agg(F.count("*").alias("n"), F.min("ln").alias("first_line"))


@query(BOXES + """SELECT doc_id, arg_max(text, (length(text), y, pos)) AS label, CAST(max(length(text)) AS BIGINT) AS specificity FROM boxes WHERE text LIKE 't%' GROUP BY doc_id""")
def label_specificity(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _typed(boxes(spark, sf_dir)).where("text like 't%'")
    return b.groupBy("doc_id").agg(F.max_by("text", F.struct(F.length("text"), "y", "pos")).alias("label"), F.max(F.length("text").cast("long")).alias("specificity"))


@query("""WITH t AS (SELECT doc_id, ' ' || trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) || ' ' AS s FROM documents) SELECT doc_id, contains(s, ' of the ') OR contains(s, ' ofthe ') AS of_the, contains(s, ' and that ') OR contains(s, ' andthat ') AS and_that FROM t""")
def phrase_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", phrase_in(F.col("text"), "of the").alias("of_the"), phrase_in(F.col("text"), "and that").alias("and_that"))


@query("""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+')) AS token FROM documents) SELECT doc_id, token, count(*) AS n FROM t WHERE length(token) IN (2, 3, 4, 10, 16) GROUP BY 1, 2""")
def identifier_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0))).alias("token"))
    return t.where(F.length("token").isin(2, 3, 4, 10, 16)).groupBy("doc_id", "token").agg(F.count("*").alias("n"))


@query("""WITH t AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[ \\n]+')) AS s FROM documents), f AS (SELECT doc_id, CASE WHEN regexp_full_match(s, '[0-9]{4}') THEN 'building' WHEN regexp_full_match(s, '[0-9]{5}') THEN 'post' WHEN regexp_full_match(s, '3[0-9]{13}3') THEN 'vat' WHEN regexp_full_match(s, '[0-9]{10}') THEN 'cr' WHEN regexp_full_match(s, '[A-Za-z]{4}[0-9]{4}') THEN 'short' WHEN regexp_full_match(s, '[A-Za-z0-9-]{2,20}') AND regexp_matches(s, '[0-9]') THEN 'code' END AS kind FROM t)
SELECT doc_id, kind, count(*) AS n FROM f WHERE kind IS NOT NULL GROUP BY 1, 2""")
def typed_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "[ \n]+")).alias("s"))
    kind = F.coalesce(*(F.when(typed(F.col("s"), k).isNotNull(), F.lit(k)) for k in ("building", "post", "vat", "cr", "short", "code")))
    return t.select("doc_id", kind.alias("kind")).where("kind is not null").groupBy("doc_id", "kind").agg(F.count("*").alias("n"))


@query("""WITH t AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[0-9]+')) AS r FROM documents) SELECT doc_id, min(r) AS first_id FROM t WHERE length(r) = 16 GROUP BY 1 HAVING count(*) = 1""")
def number_string_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 16-digit number of a document that has exactly one."""
    d = table(spark, sf_dir, "documents")
    runs = F.array_distinct(F.filter(F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0)), lambda r: F.length(r) == 16))
    return d.where(F.size(runs) == 1).select("doc_id", digits_of_length(F.col("text"), [16]).alias("first_id"))


@query(BOXES + """, r AS (SELECT doc_id, page, min(x) - 20 AS x0, max(x + w) + 20 AS x1, min(y) - 20 AS y0, max(y) + 40 AS y1 FROM boxes WHERE text IN ('the', 'of', 'and', 'la', 'der') AND y % 800 < 320 GROUP BY 1, 2 HAVING count(*) >= 2 AND max(x + w) - min(x) < 2000)
SELECT b.doc_id, b.page, count(*) AS n, count_if(r.doc_id IS NOT NULL AND b.x + b.w / 2 BETWEEN x0 AND x1 AND b.y + 10 BETWEEN y0 AND y1) AS dropped FROM boxes b LEFT JOIN r ON b.doc_id = r.doc_id AND b.page = r.page GROUP BY 1, 2""")
def receipt_region_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes whose centre lies in the padded union of the page's anchors, unless that is too wide."""
    b = _typed(boxes(spark, sf_dir))
    r = b.where(F.col("text").isin("the", "of", "and", "la", "der") & (F.col("y") % 800 < 320)).groupBy(*KEY).agg((F.min("x") - 20).alias("x0"), (F.max(F.expr("x + w")) + 20).alias("x1"), (F.min("y") - 20).alias("y0"), (F.max("y") + 40).alias("y1"), F.count("*").alias("c"))
    r = r.where("c >= 2 and x1 - x0 - 40 < 2000")
    inside = F.coalesce(F.expr("x + w / 2 between x0 and x1 and y + 10 between y0 and y1"), F.lit(False))
    return b.join(r, KEY, "left").groupBy(*KEY).agg(F.count("*").alias("n"), F.count_if(inside).alias("dropped"))


@query(BOXES + "SELECT doc_id, max(page) AS page, CAST(arg_max(ln, (page, ln, pos)) AS BIGINT) AS ln FROM boxes WHERE length(text) >= 14 GROUP BY doc_id")
def last_footer_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _typed(boxes(spark, sf_dir)).where("length(text) >= 14")
    return b.groupBy("doc_id").agg(F.max("page").alias("page"), F.max_by("ln", F.struct("page", "ln", "pos")).alias("ln"))


@query(BOXES + """, e AS (SELECT DISTINCT doc_id, page, ln, pos FROM boxes WHERE conf >= 80 AND length(text) >= 4) SELECT b.doc_id, b.page, count(*) AS n, count_if(e.doc_id IS NULL) AS unassigned, count_if(e.doc_id IS NULL AND b.conf < 60) AS faint FROM boxes b LEFT JOIN e ON b.doc_id = e.doc_id AND b.page = e.page AND b.ln = e.ln AND b.pos = e.pos GROUP BY 1, 2""")
def coverage_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _typed(boxes(spark, sf_dir))
    left = uncovered(b, b.where("conf >= 80 and length(text) >= 4"), [*KEY, "ln", "pos"])
    gone = left.groupBy(*KEY).agg(F.count("*").alias("unassigned"), F.count_if(F.col("conf") < 60).alias("faint"))
    zero = F.lit(0).cast("long")
    return b.groupBy(*KEY).agg(F.count("*").alias("n")).join(gone, KEY, "left").select(*KEY, "n", F.coalesce("unassigned", zero).alias("unassigned"), F.coalesce("faint", zero).alias("faint"))


@query(BOXES + """, need AS (SELECT doc_id, unnest([(doc_id % 7)::INT + 2, (doc_id % 5)::INT + 9]) AS len FROM documents) SELECT n.doc_id, count(DISTINCT n.len) AS wanted, count(DISTINCT CASE WHEN b.doc_id IS NOT NULL THEN n.len END) AS found FROM need n LEFT JOIN (SELECT DISTINCT doc_id, length(text) AS len FROM boxes) b ON n.doc_id = b.doc_id AND n.len = b.len GROUP BY 1""")
def address_division(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the tokens that a document needs stand anywhere in it; its texts hold no anchors that would bound an interval."""
    docs = table(spark, sf_dir, "documents")
    need = docs.select("doc_id", F.explode(F.array_distinct(F.array((F.col("doc_id") % 7 + 2).cast("int"), (F.col("doc_id") % 5 + 9).cast("int")))).alias("len"))
    have = boxes(spark, sf_dir).select("doc_id", F.length("text").alias("len")).distinct().withColumn("here", F.lit(1))
    return need.join(have, ["doc_id", "len"], "left").groupBy("doc_id").agg(F.count("*").alias("wanted"), F.count("here").alias("found"))


@query(BOXES + """SELECT b.doc_id, b.page, b.ln, b.pos FROM boxes b WHERE b.conf < 70 AND NOT EXISTS (SELECT 1 FROM boxes o WHERE o.doc_id = b.doc_id AND o.page = b.page AND o.text = b.text AND o.conf >= 70 AND abs(o.x - b.x) <= 400 AND abs(o.y - b.y) <= 60)""")
def spatial_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faint boxes without a sure box of the same text close by."""
    b = _typed(boxes(spark, sf_dir))
    sure = b.where("conf >= 70").select(*KEY, "text", F.col("x").alias("ox"), F.col("y").alias("oy"))
    weak = b.where("conf < 70").alias("b")
    on = (F.col("b.doc_id") == F.col("o.doc_id")) & (F.col("b.page") == F.col("o.page")) & (F.col("b.text") == F.col("o.text")) & F.expr("abs(ox - x) <= 400 and abs(oy - y) <= 60")
    return weak.join(sure.alias("o"), on, "left_anti").select("doc_id", "page", "ln", "pos")


@query(BOXES + """, r AS (SELECT doc_id, page, x - 40 AS x0, x + w + 40 AS x1, y - 20 AS y0, y + 40 AS y1, ln AS rl, pos AS rp FROM boxes WHERE length(text) >= 16)
SELECT r.doc_id, r.page, rl, rp, count(*) AS n, CAST(sum(length(b.text)) AS BIGINT) AS chars FROM r JOIN boxes b ON r.doc_id = b.doc_id AND r.page = b.page AND b.x < x1 AND x0 < b.x + b.w AND b.y < y1 AND y0 < b.y + 20 GROUP BY 1, 2, 3, 4""")
def region_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(spark, sf_dir)
    e = lambda p, c: F.expr(c).alias(p + c.split()[0])
    r = b.where("length(text) >= 16").select(*KEY, F.col("ln").cast("long").alias("rl"), F.col("pos").cast("long").alias("rp"), F.expr("left - 40").alias("r_left"), F.expr("top - 20").alias("r_top"), F.expr("width + 80").alias("r_width"), F.lit(60).alias("r_height"))
    o = b.select(*KEY, e("o_", "left"), e("o_", "top"), e("o_", "width"), e("o_", "height"), F.length("text").alias("chars"))
    return r.join(o, KEY).where(overlap("r_", "o_")).groupBy(*KEY, "rl", "rp").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))


@query(BOXES + """, j AS (SELECT doc_id, page, y + (pos * 7 + ln * 5) % 13 AS y FROM boxes), c AS (SELECT doc_id, page, y, count(*) AS n FROM j GROUP BY 1, 2, 3),
g AS (SELECT *, coalesce(y - lag(y) OVER (PARTITION BY doc_id, page ORDER BY y) > 9, true) AS opens FROM c)
SELECT doc_id, page, CAST(sum(n) AS BIGINT) AS n, count_if(opens) AS n_rows FROM g GROUP BY 1, 2""")
def exact_row_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy rows of each page, whose words stand up to 12 off their line: with equal heights a row ends at a gap over the tolerance."""
    b = boxes(spark, sf_dir)
    off = b.withColumn("top", (F.col("top") + (F.col("pos") * 7 + F.col("ln") * 5) % 13).cast("int"))
    return row_clusters(off, 9.0).groupBy(*KEY).agg(F.count("*").alias("n"), F.count_distinct("row").alias("n_rows"))


@query(BOXES + """, faint AS (SELECT doc_id, page, ln, pos, x + ln % 4 * 8 AS x, w, pos % 6 = 1 AS arabic FROM boxes WHERE pos % 3 = 1),
gone AS (SELECT DISTINCT f.doc_id, f.page, f.ln, f.pos FROM faint f JOIN boxes o ON o.doc_id = f.doc_id AND o.ln = f.ln AND o.pos BETWEEN f.pos AND f.pos + 4
 WHERE NOT f.arabic AND least(f.x + f.w, o.x + o.w) - greatest(f.x, o.x) > 0.6 * least(f.w, o.w))
SELECT b.doc_id, b.page, b.n, b.n - coalesce(g.n, 0) AS n_kept FROM (SELECT doc_id, page, count(*) + count_if(pos % 3 = 1) AS n FROM boxes GROUP BY 1, 2) b LEFT JOIN (SELECT doc_id, page, count(*) AS n FROM gone GROUP BY 1, 2) g USING (doc_id, page)""")
def same_ink_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third word is read twice, the faint reading 0 to 24 to the right: it goes where it covers a word enough, if of the same script."""
    once, twice = F.array(F.lit(False)), F.array(F.lit(False), F.lit(True))
    read = boxes(spark, sf_dir).withColumns({"source": F.lit("ocr"), "faint": F.explode(F.when(F.col("pos") % 3 == 1, twice).otherwise(once))})
    faint = lambda c, value: F.when(F.col("faint"), value).otherwise(F.col(c))
    text = faint("text", F.when(F.col("pos") % 6 == 1, "كلمة").otherwise(F.col("text")))
    both = read.withColumns({"left": faint("left", (F.col("left") + F.col("ln") % 4 * 8).cast("int")), "confidence": faint("confidence", 10), "text": text, "pos": faint("pos", F.col("pos") + 1_000_000)})
    out = same_ink(both, 20, text=False)
    return out.groupBy(*KEY).agg(F.count("*").alias("n"), F.count_if(F.col("kept")).alias("n_kept"))
