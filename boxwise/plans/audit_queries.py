"""Arbitration and audit queries over boxes, orders and their rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxwise.functions.scalars import close_number, date_key, draft_json, has_arabic, squashed
from boxwise.operators.audits import dominant, draft_score, lost_rows, printed_near, repaired, reviews, uncrossed
from boxwise.operators.geometry import bidirectional, clamped, first_label, rotated, stacked
from boxwise.operators.merges import unique_by
from boxwise.plans.box_queries import BOXES, KEY, LABEL, VALUE, boxes
from boxwise.plans.check_queries import ITEMS, PRINTED, items, printed
from boxwise.plans.merge_queries import DRAFTS, drafts
from boxwise.plans.registry import query
from boxwise.sources.tables import table


@query("""WITH v AS (SELECT user_id, event_type, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS w FROM events GROUP BY 1, 2)
SELECT user_id, CAST(sum(w) AS BIGINT) AS total, max(w) AS top, CASE WHEN max(w) * 100 >= sum(w) * 80 THEN arg_max(event_type, (w, event_type)) END AS dominant FROM v GROUP BY 1""")
def weighted_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kind of event with at least 80 per cent of a user's value."""
    return dominant(table(spark, sf_dir, "events"), ["user_id"], "event_type", F.round(F.col("value") * 100).cast("long"), 80)


@query(BOXES + """, r AS (SELECT *, length(text) = 7 OR regexp_matches(text, '[\\x{0600}-\\x{06FF}]') AS rtl FROM boxes)
SELECT doc_id, ln, string_agg(text, ' ' ORDER BY rtl, CASE WHEN rtl THEN -x ELSE x END) AS text, bool_or(rtl) AS has_rtl FROM r GROUP BY 1, 2""")
def bidirectional_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reading order with two directions; words of seven letters play the right-to-left ones."""
    b = boxes(spark, sf_dir)
    rtl = (F.length("text") == 7) | has_arabic(F.col("text"))
    return b.groupBy("doc_id", F.col("ln").cast("long").alias("ln")).agg(bidirectional(rtl, F.col("left"), F.col("text")).alias("text"), F.bool_or(rtl).alias("has_rtl"))


@query(BOXES + """, m AS (SELECT l.doc_id, l.page, l.text AS field, (l.ln, l.pos, (v.ln <> l.ln)::INT, 4 * abs(v.y - l.y) + abs(v.x - l.x), v.ln, v.pos) AS o, l.ln AS ll, l.pos AS lp, v.text AS value FROM boxes l JOIN boxes v ON l.doc_id = v.doc_id AND l.page = v.page
 WHERE (length(l.text) = 3 AND l.text LIKE 't%') AND length(v.text) >= 12 AND 4 * abs(v.y - l.y) + abs(v.x - l.x) <= 750)
SELECT doc_id, page, field, arg_min(ll, o) AS ln, arg_min(lp, o) AS pos, arg_min(value, o) AS value FROM m GROUP BY 1, 2, 3""")
def first_label_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(spark, sf_dir)
    got = first_label(b.where(LABEL), b.where(VALUE), KEY, 750)
    return got.select(*KEY, "field", F.col("v.l_ln").cast("long").alias("ln"), F.col("v.l_pos").cast("long").alias("pos"), F.col("v.value").alias("value"))


@query(BOXES + """, c AS (SELECT doc_id, page, ln, x // 400 AS col, count(*) AS c, max(text) AS text FROM boxes WHERE length(text) >= 10 GROUP BY 1, 2, 3, 4),
n AS (SELECT doc_id, page, count(DISTINCT col) AS n_columns FROM c GROUP BY 1, 2),
r AS (SELECT doc_id, page, ln, list(text ORDER BY col) AS held FROM c JOIN n USING (doc_id, page) GROUP BY 1, 2, 3, n_columns HAVING max(c) = 1 AND count(*) = n_columns)
SELECT doc_id, page, max(ln) AS ln, max(held[1]) AS one, max(held[2]) AS two, max(array_to_string(held[3:], ',')) AS rest FROM r GROUP BY 1, 2 HAVING count(*) = 1""")
def unique_full_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one row of a page with exactly one value in every column that has any on the page; nothing if there are several or none.

    A column is 400 wide. one and two are the values of the first two columns, rest those of the others, comma-joined."""
    b = boxes(spark, sf_dir).where("length(text) >= 10").withColumn("col", F.expr("left div 400"))
    cells = b.groupBy(*KEY, "ln", "col").agg(F.count("*").alias("c"), F.max("text").alias("text"))
    columns = cells.select(*KEY, "col").distinct().groupBy(*KEY).agg(F.count("*").alias("n_columns"))
    held = F.array_sort(F.collect_list(F.struct("col", "text")))
    rows = cells.groupBy(*KEY, F.col("ln").cast("long").alias("ln")).agg(F.count("*").alias("n"), F.max("c").alias("most"), F.transform(held, lambda h: h["text"]).alias("held"))
    full = rows.join(columns, KEY).where("most = 1 and n = n_columns")
    full = full.select(*KEY, "ln", F.get("held", F.lit(0)).alias("one"), F.get("held", F.lit(1)).alias("two"), F.array_join(F.slice("held", 3, F.greatest(F.size("held") - 2, F.lit(0))), ",").alias("rest"))
    return unique_by(full, KEY, ln="ln", one="one", two="two", rest="rest")


@query(BOXES + """SELECT b.doc_id, b.page, b.ln, b.pos FROM boxes b WHERE length(b.text) >= 9 AND EXISTS (SELECT 1 FROM boxes o WHERE o.doc_id = b.doc_id AND o.page = b.page AND o.y - b.y > 0 AND o.y - b.y < 30 AND abs(o.x - b.x) < 30 AND length(o.text) >= 9)""")
def stacked_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long words with another one right below."""
    b = boxes(spark, sf_dir).where("length(text) >= 9")
    return stacked(b, b, KEY, 30, 30).select(*KEY, F.col("ln").cast("long").alias("ln"), F.col("pos").cast("long").alias("pos"))


@query(BOXES + """, r AS (SELECT doc_id, page, ln, pos, (doc_id % 4) * 90 AS turn, x, y % 800 AS y, w, 20 AS h FROM boxes)
SELECT doc_id, ln, pos, CAST(greatest(0, least(CASE turn WHEN 90 THEN 800 - y - h WHEN 180 THEN 20000 - x - w WHEN 270 THEN y ELSE x END, 20000)) AS BIGINT) AS x0,
 CAST(greatest(0, least(CASE turn WHEN 90 THEN x WHEN 180 THEN 800 - y - h WHEN 270 THEN 20000 - x - w ELSE y END, 20000)) AS BIGINT) AS y0,
 CAST(CASE WHEN turn IN (90, 270) THEN h ELSE w END AS BIGINT) AS w, CAST(CASE WHEN turn IN (90, 270) THEN w ELSE h END AS BIGINT) AS h FROM r""")
def turned_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of pages that were read turned, in the upright page's terms and inside its bounds."""
    extent = F.lit(20_000)
    to = rotated(F.col("left"), F.col("top") % 800, F.col("width"), F.lit(20), extent, F.lit(800), (F.col("doc_id") % 4) * 90)
    at = lambda c: clamped(to[c], extent).cast("long")
    return boxes(spark, sf_dir, keyed=False).select("doc_id", F.col("ln").cast("long").alias("ln"), F.col("pos").cast("long").alias("pos"), at("left").alias("x0"), at("top").alias("y0"), to["width"].cast("long").alias("w"), to["height"].cast("long").alias("h"))


@query("""WITH f AS (SELECT o_orderkey AS k, (o_orderkey * 1009 + 100000)::VARCHAR AS whole, 90 + o_orderkey % 10 AS conf FROM orders),
o AS (SELECT *, CASE k % 4 WHEN 0 THEN substr(whole, 1, 1) || substr(whole, 3) WHEN 1 THEN whole WHEN 2 THEN reverse(whole) END AS own FROM f),
r AS (SELECT *, CASE WHEN conf >= 95 AND (own IS NULL OR (length(own) < length(whole) AND whole LIKE '%' || array_to_string(string_split(own, ''), '%') || '%')) THEN whole ELSE own END AS number FROM o)
SELECT k AS o_orderkey, number, number IS DISTINCT FROM own AS changed FROM r""")
def lost_digit_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sure candidate takes the place of a number that is the candidate without some digits."""
    k = F.col("o_orderkey")
    whole = (k * 1009 + 100_000).cast("string")
    own = F.when(k % 4 == 0, F.concat(F.substring(whole, 1, 1), F.substr(whole, F.lit(3)))).when(k % 4 == 1, whole).when(k % 4 == 2, F.reverse(whole))
    rows = table(spark, sf_dir, "orders").select(k, whole.alias("whole"), own.alias("own"), (90 + k % 10).alias("conf"))
    rows = rows.withColumn("number", repaired(F.col("own"), F.col("whole"), F.col("conf")))
    return rows.select("o_orderkey", "number", (~F.col("number").eqNullSafe(F.col("own"))).alias("changed"))


@query("""WITH f AS (SELECT c_custkey, n_name AS seller, CASE WHEN c_custkey % 4 = 0 THEN lower(n_name) || ' .' WHEN c_custkey % 4 = 1 THEN NULL ELSE c_name END AS buyer, CASE WHEN c_custkey % 5 <> 0 THEN CASE WHEN c_custkey % 7 = 0 THEN c_name || ' Ltd' ELSE c_name END END AS grid FROM customer JOIN nation ON n_nationkey = c_nationkey),
s AS (SELECT *, regexp_replace(lower(buyer), '[^a-z0-9]', '', 'g') = regexp_replace(lower(seller), '[^a-z0-9]', '', 'g') AS crossed FROM f)
SELECT c_custkey, CASE WHEN buyer IS NULL OR crossed THEN grid ELSE buyer END AS buyer, CASE WHEN buyer IS NULL AND grid IS NULL THEN 'missing' WHEN buyer IS NULL THEN 'filled' WHEN crossed AND grid IS NOT NULL THEN 'replaced' WHEN crossed THEN 'cleared' WHEN buyer <> grid THEN 'noted' ELSE 'kept' END AS note FROM s""")
def crossed_parties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A buyer's name that is the seller's was read from the wrong block."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("seller"))
    k, name = F.col("c_custkey"), F.col("c_name")
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey").join(nation, "c_nationkey")
    own = F.when(k % 4 == 0, F.concat(F.lower("seller"), F.lit(" ."))).when(k % 4 == 1, None).otherwise(name)
    grid = F.when(k % 5 != 0, F.when(k % 7 == 0, F.concat(name, F.lit(" Ltd"))).otherwise(name))
    value, note = uncrossed(F.col("own"), F.col("seller"), F.col("grid"))
    return rows.select("c_custkey", "seller", own.alias("own"), grid.alias("grid")).select("c_custkey", value.alias("buyer"), note.alias("note"))


@query(BOXES + """SELECT doc_id, count(*) AS n, count_if(conf >= CASE WHEN length(text) >= 10 THEN 90 ELSE 60 END) AS readable, count_if(conf < 60) AS faint FROM boxes WHERE regexp_matches(text, '[0-9]') GROUP BY 1""")
def unreadable_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers that pass the confidence their kind asks for: 90 for identifiers, 60 for the rest."""
    b = boxes(spark, sf_dir).where(F.col("text").rlike("[0-9]"))
    least = F.when(F.length("text") >= 10, 90).otherwise(60)
    return b.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(F.col("confidence") >= least).alias("readable"), F.count_if(F.col("confidence") < 60).alias("faint"))


@query(ITEMS + """, r AS (SELECT l_orderkey, 'quantity' AS reason FROM items WHERE q IS NULL UNION SELECT l_orderkey, 'amount' FROM items WHERE a IS NULL UNION SELECT l_orderkey, 'price' FROM items WHERE p IS NULL UNION SELECT l_orderkey, 'gross' FROM items WHERE n = 7)
SELECT l_orderkey, CAST(count(*) AS INT) AS n, string_agg(reason, ',' ORDER BY reason) AS reasons FROM r GROUP BY 1""")
def review_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews(items(spark, sf_dir), ["l_orderkey"], quantity=F.col("q").isNull(), amount=F.col("a").isNull(), price=F.col("p").isNull(), gross=F.col("n") == 7)


@query(DRAFTS + """, lost AS (SELECT l_orderkey, count(*) AS lost FROM ua WHERE NOT EXISTS (SELECT 1 FROM ub WHERE ub.l_orderkey = ua.l_orderkey AND abs(ub.n - ua.n) <= 1) GROUP BY 1)
SELECT l_orderkey, count(*) AS rows_before, coalesce(max(lost), 0) AS lost, max(lost) IS NOT NULL AS roll_back FROM ua LEFT JOIN lost USING (l_orderkey) GROUP BY 1""")
def row_loss_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A merge that loses a row of the first draft is rolled back."""
    a, b = (unique_by(d, ["l_orderkey", "n"], part="part") for d in drafts(spark, sf_dir))
    lost = lost_rows(a, b, ["l_orderkey"], "n", 1).groupBy("l_orderkey").agg(F.count("*").alias("lost"))
    rows = a.groupBy("l_orderkey").agg(F.count("*").alias("rows_before")).join(lost, "l_orderkey", "left")
    return rows.select("l_orderkey", "rows_before", F.coalesce("lost", F.lit(0).cast("long")).alias("lost"), F.col("lost").isNotNull().alias("roll_back"))


@query("""SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds, count(DISTINCT event_type) > 1 AS review FROM events WHERE value > 80 GROUP BY 1""")
def identifier_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """More than one distinct value for what should have one asks for a review."""
    kinds = table(spark, sf_dir, "events").where("value > 80").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("k"))
    return kinds.select("user_id", F.array_join("k", ",").alias("kinds"), (F.size("k") > 1).alias("review"))


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 1 THEN 'Date: ' || strftime(o_orderdate, '%Y.%-m.%-d') WHEN 3 THEN strftime(o_orderdate, '%b %Y') WHEN 4 THEN strftime(o_orderdate, '%d-%m-%Y') || ' 9:30' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS key FROM orders""")
def date_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One date printed five ways and read back; a text that is not all a date stays, but for its strokes."""
    k, d = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    form = lambda p: F.date_format(d, p)
    shown = F.when(k % 5 == 0, form("dd/MM/yyyy")).when(k % 5 == 1, F.concat(F.lit("Date: "), form("yyyy.M.d"))).when(k % 5 == 2, form("yyyy-M-d")).when(k % 5 == 3, form("MMM yyyy")).otherwise(F.concat(form("dd/MM/yyyy"), F.lit(" 9:30")))
    return table(spark, sf_dir, "orders").select("o_orderkey", date_key(shown).alias("key"))


@query("""SELECT c_custkey, 'مدرسةىٱپ'[:6] || 'اپ' || regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g') AS label FROM customer""")
def squashed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels without vowel signs, tatweel, alef forms and punctuation; all other Arabic letters stay as they are."""
    return table(spark, sf_dir, "customer").select("c_custkey", squashed(F.concat(F.lit("مَدرسـة ى ٱ پ: "), F.col("c_name"))).alias("label"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 IN (0, 1) THEN 'N' || o_orderkey END AS number, CASE WHEN o_orderkey % 5 IN (0, 1) THEN o_orderkey % 100 END AS total FROM orders""")
def json_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts as a model writes them: bare, fenced, with text after, doubled, and as a list; only the first two count."""
    k = F.col("o_orderkey")
    one = F.to_json(F.struct(F.concat(F.lit("N"), k).alias("number"), (k % 100).alias("total")))
    text = F.when(k % 5 == 0, one).when(k % 5 == 1, F.concat(F.lit("```json\n"), one, F.lit("\n```"))).when(k % 5 == 2, F.concat(one, F.lit(" as asked"))).when(k % 5 == 3, F.concat(one, F.lit(","), one)).otherwise(F.concat(F.lit("["), one, F.lit("]")))
    got = table(spark, sf_dir, "orders").select("o_orderkey", draft_json(text, "struct<number: string, total: bigint>").alias("d"))
    return got.select("o_orderkey", "d.number", "d.total")


@query(PRINTED.replace(", sums AS", "WITH sums AS", 1) + """SELECT o_orderkey, coalesce(abs(printed - s) <= 1, false) AS same, coalesce(abs(printed - s) * 200 <= greatest(400, abs(s)), false) AS near
FROM printed LEFT JOIN sums ON l_orderkey = o_orderkey""")
def close_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed and summed totals, equal to the cent and equal to half a per cent."""
    sums = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("s"))
    p, s = F.col("printed"), F.col("s")
    return printed(spark, sf_dir).join(sums, "o_orderkey", "left").select("o_orderkey", F.coalesce(F.abs(p - s) <= 1, F.lit(False)).alias("same"), close_number(p, s).alias("near"))


SIDE = """count_if({w}) AS n{i}, count_if({w} AND gap) AS g{i}, count_if({w} AND valid) AS v{i}, count_if({w} AND partkey % 5 = 0) AS i{i}, (CASE WHEN count(a) FILTER (WHERE {w}) = count_if({w}) AND abs(sum(a) FILTER (WHERE {w}) - sum(e) FILTER (WHERE {w})) <= 2 THEN 1 ELSE 0 END + CASE WHEN coalesce(sum(v) FILTER (WHERE {w}) > 500000, false) THEN 1 ELSE 0 END + CASE WHEN coalesce(abs(sum(a + v - g) FILTER (WHERE {w})) <= 2, false) THEN 1 ELSE 0 END) AS c{i}"""


@query(ITEMS + """, f AS (SELECT *, q IS NULL OR a IS NULL AS gap, coalesce(abs(a + v - g) <= 2, false) AS valid FROM items),
s AS (SELECT l_orderkey, """ + SIDE.format(w="n <= 4", i=1) + ", " + SIDE.format(w="n > 2", i=2) + """ FROM f GROUP BY 1)
SELECT l_orderkey, n1, n2, CASE WHEN n2 >= n1 AND ((g2 = 0)::INT, c2, v2, -g2, -i2) >= ((g1 = 0)::INT, c1, v1, -g1, -i1) THEN 'second' ELSE 'first' END AS winner FROM s""")
def draft_arbitration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second draft wins only with as many rows and a score as good; both are scored in one pass."""
    c = F.col
    gap, valid = c("q").isNull() | c("a").isNull(), F.coalesce(F.abs(c("a") + c("v") - c("g")) <= 2, F.lit(False))

    def score(own):
        total = lambda x: F.sum(F.when(own, x))
        n, gaps = F.count_if(own), F.count_if(own & gap)
        checks = [(F.count(F.when(own, c("a"))) == n) & (F.abs(total(c("a")) - total(c("e"))) <= 2), total(c("v")) > 500_000, F.abs(total(c("a") + c("v") - c("g"))) <= 2]
        return draft_score(gaps > 0, checks, F.count_if(own & valid), gaps, F.count_if(own & (c("partkey") % 5 == 0)))

    one, two = c("n") <= 4, c("n") > 2
    s = items(spark, sf_dir).groupBy("l_orderkey").agg(F.count_if(one).alias("n1"), F.count_if(two).alias("n2"), score(one).alias("s1"), score(two).alias("s2"))
    return s.select("l_orderkey", "n1", "n2", F.when((c("n2") >= c("n1")) & (c("s2") >= c("s1")), "second").otherwise("first").alias("winner"))


@query(ITEMS + """, t AS (SELECT l_orderkey AS k, CAST(sum(e) AS BIGINT) AS s, CAST(sum(v) AS BIGINT) AS v FROM items GROUP BY 1), u AS (SELECT *, CASE WHEN k % 4 <> 0 THEN s + v END AS net, CASE WHEN k % 4 <> 1 THEN v END AS vat FROM t),
w AS (SELECT *, CASE WHEN net IS NULL THEN s + vat WHEN vat IS NULL THEN net - s END AS target FROM u)
SELECT k AS l_orderkey, CASE WHEN target IS NULL THEN NULL WHEN k % 3 <> 0 AND abs(s + v - target) <= 1 THEN s + v WHEN k % 2 = 0 AND abs(v + 1 - target) <= 1 THEN v + 1 WHEN k % 5 = 0 AND abs(v - target) <= 1 THEN v WHEN abs(s - target) <= 1 THEN s END AS filled, CASE WHEN net IS NULL THEN 'net' WHEN vat IS NULL THEN 'vat' END AS field FROM w""")
def totals_gap_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One unknown of subtotal + tax = net is filled by an amount that is printed, never by the computed one."""
    k = F.col("l_orderkey")
    t = items(spark, sf_dir).groupBy("l_orderkey").agg(F.sum("e").alias("s"), F.sum("v").alias("v"))
    t = t.select(k, "s", "v", F.when(k % 4 != 0, F.col("s") + F.col("v")).alias("net"), F.when(k % 4 != 1, F.col("v")).alias("vat"))
    shown = lambda page, amount, there: F.when(there, F.struct(F.lit(page).alias("page"), amount.alias("amount")))
    print_of = F.array_compact(F.array(shown(1, F.col("s"), F.lit(True)), shown(2, F.col("v"), k % 5 == 0), shown(3, F.col("v") + 1, k % 2 == 0), shown(4, F.col("s") + F.col("v"), k % 3 != 0)))
    target = F.when(F.col("net").isNull(), F.col("s") + F.col("vat")).when(F.col("vat").isNull(), F.col("net") - F.col("s"))
    field = F.when(F.col("net").isNull(), "net").when(F.col("vat").isNull(), "vat")
    return t.select(k, printed_near(target, print_of).alias("filled"), field.alias("field"))
