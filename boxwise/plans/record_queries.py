"""Records that were read twice: where a wrong field comes from, which reading stays, what an audit finds, and the projections of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boxwise.functions.scalars import date_key, squashed
from boxwise.functions.words import english_amount
from boxwise.operators.checks import complete_sum, row_mode
from boxwise.operators.merges import lookup, nested_rows, present, unique_by
from boxwise.operators.validation import attribution, precedence
from boxwise.plans.box_queries import BOXES, boxes
from boxwise.plans.check_queries import ITEMS, _spelt, items
from boxwise.plans.merge_queries import DRAFTS, drafts
from boxwise.plans.registry import query
from boxwise.sources.tables import table, unwrapped

FIELDS = ["q", "a", "v", "g"]
LONG = """, u AS (SELECT l_orderkey, n FROM items GROUP BY 1, 2 HAVING count(*) = 1), one AS (SELECT i.* FROM items i JOIN u USING (l_orderkey, n)),
truth AS (SELECT l_orderkey, n, field, value FROM one UNPIVOT (value FOR field IN (q, a, v, g))),
pred AS (SELECT *, CASE WHEN (l_orderkey + n) % 5 = 0 AND field = 'a' THEN value + 700 WHEN (l_orderkey + n) % 7 = 0 AND field = 'g' THEN NULL WHEN (l_orderkey * 3 + n) % 11 = 0 AND field = 'v' THEN value + 9 WHEN (l_orderkey + n) % 13 = 0 AND field = 'q' THEN value + 1 ELSE value END AS seen FROM truth),
ev AS (SELECT l_orderkey, field, seen AS value, CASE WHEN count(*) = 1 THEN min(n) END AS n FROM pred WHERE seen IS NOT NULL AND field <> 'q' GROUP BY 1, 2, 3),
box AS (SELECT l_orderkey, n, field, count(*) AS words, bool_or(token = value) AS hit FROM (SELECT l_orderkey, n, field, value, unnest(CASE WHEN (l_orderkey + n) % 3 = 0 THEN [value] WHEN (l_orderkey + n) % 3 = 1 THEN [value - 1, value + 2] ELSE CAST([] AS BIGINT[]) END) AS token FROM truth) GROUP BY 1, 2, 3),
bad AS (SELECT l_orderkey, n, abs(a - q * p) > greatest(2, abs(q * p) // 200) AS off FROM one)
"""


def _long(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows that are there once; what their fields are, and what a reading made of them."""
    c, k = F.col, F.col("l_orderkey") + F.col("n")
    one = unique_by(items(spark, sf_dir), ["l_orderkey", "n"], **{x: x for x in ("q", "p", "a", "v", "g")})
    truth = one.unpivot(["l_orderkey", "n"], FIELDS, "field", "value").where("value is not null")
    seen = (
        F.when((k % 5 == 0) & (c("field") == "a"), c("value") + 700)
        .when((k % 7 == 0) & (c("field") == "g"), None)
        .when(((c("l_orderkey") * 3 + c("n")) % 11 == 0) & (c("field") == "v"), c("value") + 9)
        .when((k % 13 == 0) & (c("field") == "q"), c("value") + 1)
        .otherwise(c("value"))
    )
    return one, truth, truth.withColumn("seen", seen)


@query(ITEMS + LONG + """SELECT p.l_orderkey, p.n, p.field, p.value AS expected, p.seen AS actual, CASE WHEN (p.l_orderkey + p.n) % 10 = 0 THEN 'VISION_OVERRIDE' WHEN coalesce(b.hit, false) AND ev.n <> p.n THEN 'PARSER_ROW' WHEN coalesce(b.hit, false) THEN 'PARSER_COLUMN'
 WHEN p.field <> 'v' AND b.words > 0 THEN 'OCR_CHAR_ERROR' WHEN p.field <> 'v' THEN 'OCR_MISSING' WHEN ev.n <> p.n THEN 'PARSER_ROW' WHEN coalesce(off, false) THEN 'ARITHMETIC_INCONSISTENT' ELSE 'UNRESOLVED' END AS bucket
FROM pred p LEFT JOIN box b ON b.l_orderkey = p.l_orderkey AND b.n = p.n AND b.field = p.field LEFT JOIN ev ON ev.l_orderkey = p.l_orderkey AND ev.field = p.field AND ev.value = p.value LEFT JOIN bad ON bad.l_orderkey = p.l_orderkey AND bad.n = p.n WHERE p.seen IS DISTINCT FROM p.value""")
def error_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth and reading joined by path; each wrong field gets the first cause that its region, the evidence and the arithmetic allow."""
    c, k = F.col, F.col("l_orderkey") + F.col("n")
    one, truth, pred = _long(spark, sf_dir)
    wrong = pred.where(~c("seen").eqNullSafe(c("value")))
    token = F.when(k % 3 == 0, F.array("value")).when(k % 3 == 1, F.array(c("value") - 1, c("value") + 2))
    region = truth.withColumn("token", F.explode(token)).groupBy("l_orderkey", "n", "field").agg(F.count("*").alias("words"), F.bool_or(c("token") == c("value")).alias("hit"))
    evidence = pred.where("seen is not null and field <> 'q'").groupBy("l_orderkey", "field", c("seen").alias("value")).agg(F.when(F.count("*") == 1, F.min("n")).alias("at"))
    off = one.select("l_orderkey", "n", (F.abs(c("a") - c("q") * c("p")) > F.greatest(F.lit(2), F.expr("abs(q * p) div 200"))).alias("off"))
    got = wrong.join(region, ["l_orderkey", "n", "field"], "left").join(evidence, ["l_orderkey", "field", "value"], "left").join(off, ["l_orderkey", "n"], "left")
    bucket = attribution(k % 10 == 0, c("hit"), c("field") != "v", c("words") > 0, c("at") != c("n"), c("off"))
    return got.select("l_orderkey", "n", "field", c("value").alias("expected"), c("seen").alias("actual"), bucket.alias("bucket"))


@query(ITEMS + LONG + "SELECT field, count(*) AS expected, count_if(coalesce(seen = value, false)) AS correct, count_if(coalesce(seen = value, false)) / count(*) AS accuracy FROM pred GROUP BY 1")
def field_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact matches over asserted values, by field."""
    right = F.count_if(F.col("seen") == F.col("value"))
    return _long(spark, sf_dir)[2].groupBy("field").agg(F.count("*").alias("expected"), right.alias("correct"), (right / F.count("*")).alias("accuracy"))


@query(DRAFTS + """SELECT l_orderkey, to_json({'items': list({'q': q, 'e': e} ORDER BY n)})::VARCHAR AS doc FROM ua GROUP BY 1""")
def nested_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths like items[3].q and their values, put together again as nested records."""
    a = unique_by(drafts(spark, sf_dir)[0], ["l_orderkey", "n"], q="q", e="e")
    paths = a.unpivot(["l_orderkey", "n"], ["q", "e"], "key", "value").select("l_orderkey", F.format_string("items[%d].%s", "n", "key").alias("path"), "value")
    return nested_rows(paths, ["l_orderkey"], "items", ["q", "e"]).select("l_orderkey", F.to_json(F.struct("items"), {"ignoreNullFields": "false"}).alias("doc"))


@query(DRAFTS + """SELECT l_orderkey, p.path, CASE p.path WHEN 'items[0].q' THEN l[1].q WHEN 'items[1].e' THEN l[2].e WHEN 'items[9].q' THEN l[10].q ELSE count END AS value FROM (SELECT l_orderkey, list({'q': q, 'e': e} ORDER BY n) AS l, count(*) AS count FROM ua GROUP BY 1), (VALUES ('items[0].q'), ('items[1].e'), ('items[9].q'), ('totals.rows')) p(path)""")
def path_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values by dotted path with list index; a path that leads nowhere gives null."""
    a = unique_by(drafts(spark, sf_dir)[0], ["l_orderkey", "n"], q="q", e="e")
    docs = a.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "q", "e"))), lambda x: F.struct(x["q"].alias("q"), x["e"].alias("e"))).alias("items"), F.struct(F.count("*").alias("rows")).alias("totals"))
    wanted = ["items[0].q", "items[1].e", "items[9].q", "totals.rows"]
    return docs.select("l_orderkey", F.inline(F.array(*(F.struct(F.lit(p).alias("path"), lookup(docs, p).cast("long").alias("value")) for p in wanted))))


HEADER = """WITH h AS (SELECT o_orderkey AS k, 'date' AS field, strftime(o_orderdate, '%Y-%m-%d') AS seen, CASE WHEN o_orderkey % 4 = 0 THEN strftime(o_orderdate, '%-d/%-m/%Y') WHEN o_orderkey % 4 = 1 THEN '2001-01-01' END AS placed, o_orderkey % 8 = 1 AS proof FROM orders
UNION ALL SELECT o_orderkey, 'vat_number', CASE WHEN o_orderkey % 3 <> 0 THEN lpad(o_custkey::VARCHAR, 15, '3') END, CASE WHEN o_orderkey % 5 <> 0 THEN lpad((o_custkey + o_orderkey % 2)::VARCHAR, 15, '3') END, true FROM orders
UNION ALL SELECT o_orderkey, 'status', NULLIF(o_orderstatus, 'F'), CASE WHEN o_orderkey % 2 = 0 THEN 'O' END, true FROM orders)
"""


def header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, field, seen (from the image), placed (from boxes), proof (whether the placed one has a box of its own)."""
    k, c = F.col("o_orderkey"), F.col
    day = c("o_orderdate").cast("date")
    number = lambda x: F.lpad(x.cast("string"), 15, "3")
    one = lambda name, seen, placed, proof: F.struct(F.lit(name).alias("field"), seen.alias("seen"), placed.alias("placed"), proof.alias("proof"))
    fields = F.array(
        one("date", F.date_format(day, "yyyy-MM-dd"), F.when(k % 4 == 0, F.date_format(day, "d/M/yyyy")).when(k % 4 == 1, "2001-01-01"), k % 8 == 1),
        one("vat_number", F.when(k % 3 != 0, number(c("o_custkey"))), F.when(k % 5 != 0, number(c("o_custkey") + k % 2)), F.lit(True)),
        one("status", F.nullif(c("o_orderstatus"), F.lit("F")), F.when(k % 2 == 0, "O"), F.lit(True)),
    )
    return table(spark, sf_dir, "orders").select(k.alias("k"), F.inline(fields))


@query(HEADER + """, d AS (SELECT *, placed IS NOT NULL AND seen <> placed AND NOT (field = 'date' AND k % 4 = 0) AS differs, field = 'vat_number' OR (field = 'date' AND proof) AS wins FROM h)
SELECT k AS o_orderkey, field, CASE WHEN seen IS NULL THEN placed WHEN differs AND wins THEN placed ELSE seen END AS value, CASE WHEN seen IS NULL AND placed IS NOT NULL THEN 'filled' WHEN differs AND wins THEN 'replaced' WHEN differs THEN 'disagree' ELSE 'kept' END AS note FROM d""")
def placed_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The image's reading stays; empty fields are filled from boxes, VAT numbers and proven dates from boxes win, equal dates are no conflict."""
    c = F.col
    date = c("field") == "date"
    wins = (c("field") == "vat_number") | (date & c("proof"))
    value, note = precedence(c("seen"), c("placed"), wins, date & (date_key(c("seen")) == date_key(c("placed"))))
    return header(spark, sf_dir).select(c("k").alias("o_orderkey"), "field", value.alias("value"), note.alias("note"))


@query(HEADER + "SELECT k AS o_orderkey, max(CASE WHEN field = 'vat_number' THEN coalesce(placed, seen) END) AS vat_number, max(CASE WHEN field = 'status' THEN coalesce(placed, seen) END) AS status, count_if(placed IS NULL AND seen IS NOT NULL) AS added FROM h GROUP BY 1")
def header_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps of the placed reading filled from the image, and how many there were."""
    c = F.col
    of = lambda name: F.max(F.when(c("field") == name, F.coalesce("placed", "seen"))).alias(name)
    return header(spark, sf_dir).groupBy(c("k").alias("o_orderkey")).agg(of("vat_number"), of("status"), F.count_if(c("placed").isNull() & c("seen").isNotNull()).alias("added"))


ROWS_TWICE = """, m AS (SELECT *, CASE WHEN q IS NULL OR p IS NULL OR a IS NULL THEN false WHEN abs(q * p - a) <= 2 AND coalesce(abs(a + v - g) <= 2, true) THEN true ELSE abs(p - a) <= 2 AND abs(q * (a + v) - g) <= 2 END AS ok FROM items),
vis AS (SELECT l_orderkey, partkey, max(q) AS q, max(CASE WHEN n % 4 = 0 THEN 0 ELSE v END) AS v, max(a) AS a, bool_and(ok) AND max(n) % 2 = 0 AS ok FROM m GROUP BY 1, 2 HAVING count(*) = 1),
spa AS (SELECT l_orderkey, partkey, max(coalesce(q, 1)) AS q, max(CASE WHEN n % 4 <> 0 THEN v END) AS v, max(e) AS a, bool_and(ok) AS ok FROM m WHERE l_orderkey % 3 <> 1 GROUP BY 1, 2 HAVING count(*) = 1)
"""


@query(ITEMS + ROWS_TWICE + """SELECT x.l_orderkey, x.partkey, CASE WHEN s.partkey IS NULL THEN x.q WHEN NOT x.ok AND s.ok THEN s.q ELSE coalesce(x.q, s.q) END AS q, CASE WHEN s.partkey IS NULL THEN x.v WHEN NOT x.ok AND s.ok THEN coalesce(s.v, CASE WHEN x.v = 0 THEN NULL ELSE x.v END) WHEN x.v = 0 AND s.v IS NULL THEN NULL ELSE coalesce(x.v, s.v) END AS v,
 CASE WHEN s.partkey IS NULL THEN 'kept' WHEN NOT x.ok AND s.ok THEN 'row replaced' WHEN x.v = 0 AND s.v IS NULL THEN 'zero cleared' ELSE 'kept' END AS note FROM vis x LEFT JOIN spa s ON s.l_orderkey = x.l_orderkey AND s.partkey = x.partkey""")
def row_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of two readings met by a code unique in both: a row that does not add up gives way to one that does, a zero nothing supports goes."""
    c = F.col
    mode = row_mode(c("q"), c("p"), c("a"), c("v"), c("g"), F.lit(None).cast("long"))
    rows = items(spark, sf_dir).withColumn("ok", mode.isin("direct", "per_unit"))
    zeroed = F.when(c("n") % 4 == 0, 0).otherwise(c("v"))
    seen = unique_by(rows.withColumns({"v": zeroed, "ok": c("ok") & (c("n") % 2 == 0)}), ["l_orderkey", "partkey"], q="q", v="v", ok="ok")
    other = rows.where("l_orderkey % 3 <> 1").withColumns({"q": F.coalesce("q", F.lit(1).cast("long")), "v": F.when(c("n") % 4 != 0, c("v"))})
    placed = unique_by(other, ["l_orderkey", "partkey"], sq="q", sv="v", sok="ok").withColumn("met", F.lit(True))
    got = seen.join(placed, ["l_orderkey", "partkey"], "left")
    met, bare = c("met").isNotNull(), (c("v") == 0) & c("sv").isNull()
    swap = met & ~c("ok") & c("sok")
    v = F.when(met & bare, None).otherwise(c("v"))
    return got.select(
        "l_orderkey", "partkey", F.when(swap, c("sq")).otherwise(F.coalesce("q", "sq")).alias("q"), F.when(swap, F.coalesce(c("sv"), F.nullif(c("v"), F.lit(0)))).when(met & bare, None).when(met, F.coalesce(v, c("sv"))).otherwise(c("v")).alias("v"),
        F.when(swap, "row replaced").when(met & bare, "zero cleared").otherwise("kept").alias("note"),
    )


@query(ITEMS + """, f AS (SELECT *, coalesce(abs(q * p - a) <= 2, false) AS ok FROM items),
s AS (SELECT l_orderkey, count_if(n <= 4) AS n1, count_if(n > 1) AS n2, coalesce(bool_and(ok) FILTER (WHERE n <= 4), false) AS ok1, coalesce(bool_and(ok) FILTER (WHERE n > 1), false) AS ok2, max(n) % 5 = 0 AS shuffled FROM f GROUP BY 1)
SELECT l_orderkey, n1, n2, CASE WHEN shuffled THEN 'row order' WHEN n1 < n2 THEN 'fewer rows' WHEN NOT ok1 AND ok2 THEN 'arithmetic' ELSE 'accepted' END AS verdict FROM s""")
def image_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An image's reading is rejected if its rows are out of order, fewer than the placed ones, or add up worse."""
    c, one, two = F.col, F.col("n") <= 4, F.col("n") > 1
    ok = F.coalesce(F.abs(c("q") * c("p") - c("a")) <= 2, F.lit(False))
    every = lambda rows: F.coalesce(F.every(F.when(rows, ok)), F.lit(False))
    s = items(spark, sf_dir).groupBy("l_orderkey").agg(F.count_if(one).alias("n1"), F.count_if(two).alias("n2"), every(one).alias("ok1"), every(two).alias("ok2"), (F.max("n") % 5 == 0).alias("shuffled"))
    verdict = F.when(c("shuffled"), "row order").when(c("n1") < c("n2"), "fewer rows").when(~c("ok1") & c("ok2"), "arithmetic").otherwise("accepted")
    return s.select("l_orderkey", "n1", "n2", verdict.alias("verdict"))


@query(DRAFTS + """SELECT l_orderkey, n, key, CASE WHEN x IS NULL OR x = '' THEN y ELSE x END AS value, CASE WHEN (x IS NULL OR x = '') AND y <> '' THEN 'filled' WHEN x <> y AND y <> '' THEN 'disagree' ELSE 'kept' END AS note FROM (SELECT coalesce(a.l_orderkey, b.l_orderkey) AS l_orderkey, coalesce(a.n, b.n) AS n, coalesce(a.key, b.key) AS key, a.value AS x, b.value AS y
 FROM (SELECT l_orderkey, n, unnest(['q', 'e']) AS key, unnest([(q % 10)::VARCHAR, CASE WHEN n % 2 = 0 THEN '' ELSE e::VARCHAR END]) AS value FROM ua) a FULL JOIN (SELECT l_orderkey, n, unnest(['q', 'e']) AS key, unnest([q::VARCHAR, e::VARCHAR]) AS value FROM ub) b ON a.l_orderkey = b.l_orderkey AND a.n = b.n AND a.key = b.key)""")
def recursive_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two nested readings, path by path: what is absent is filled, zero is present, what disagrees is noted and the first stays."""
    a, b = (unique_by(d, ["l_orderkey", "n"], q="q", e="e") for d in drafts(spark, sf_dir))
    texts = lambda d, q, e, name: d.select("l_orderkey", "n", q.cast("string").alias("q"), e.cast("string").alias("e")).unpivot(["l_orderkey", "n"], ["q", "e"], "key", name)
    x = texts(a, F.col("q") % 10, F.when(F.col("n") % 2 == 0, "").otherwise(F.col("e").cast("string")), "x")
    m = x.join(texts(b, F.col("q"), F.col("e"), "y"), ["l_orderkey", "n", "key"], "full")
    own, other = present(F.col("x")), present(F.col("y"))
    note = F.when(~own & other, "filled").when(own & other & (F.col("x") != F.col("y")), "disagree").otherwise("kept")
    return m.select("l_orderkey", "n", "key", F.when(own, F.col("x")).otherwise(F.col("y")).alias("value"), note.alias("note"))


@query("""WITH w AS (SELECT o_orderkey, o_custkey % 40 AS c, (o_orderkey % 90 + 1) AS t, o_orderkey % 2 = 0 AS shown, ((o_orderkey % 90 + 1) * 1000 + (o_orderkey % 9 + 1) * 100 + o_orderkey % 99 + 1) * 100 + o_orderkey % 60 + 1 AS h FROM orders)
SELECT c AS page, h AS hundredths, min(o_orderkey) AS first_order, count(*) AS n FROM w WHERE shown GROUP BY 1, 2""")
def amount_word_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with a currency and number words, each once by its squashed text, with the amount they spell."""
    lines = _spelt(spark, sf_dir).join(table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 40).alias("page")), "o_orderkey")
    shown = lines.withColumn("text", F.when(F.col("o_orderkey") % 2 == 0, F.col("text")).otherwise(F.regexp_replace("text", "(?i)riyals|halalas", "pieces")))
    spelt = shown.where(F.col("text").rlike(r"(?i)\b(?:riyals?|halalas?|sar)\b") & F.col("text").rlike(r"(?i)hundred|thousand"))
    once = spelt.groupBy("page", squashed(F.col("text")).alias("key")).agg(F.min("o_orderkey").alias("first_order"), F.count("*").alias("n"), F.min("text").alias("text"))
    return once.select("page", english_amount("text").alias("hundredths"), "first_order", "n")


@query(BOXES + "SELECT doc_id, page, ln, pos, to_json({'page': page, 'text': text, 'confidence': conf, 'source': CASE WHEN conf > 95 THEN 'native_text' ELSE 'ocr' END, 'bbox': [x, y, w, 20]})::VARCHAR AS proof FROM boxes WHERE length(text) >= 14")
def box_proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evidence record of a box."""
    b = boxes(spark, sf_dir, keyed=False).where("length(text) >= 14")
    source = F.when(F.col("confidence") > 95, "native_text").otherwise("ocr")
    proof = F.struct("page", "text", "confidence", source.alias("source"), F.array("left", "top", "width", "height").alias("bbox"))
    return b.select("doc_id", "page", F.col("ln").cast("long").alias("ln"), F.col("pos").cast("long").alias("pos"), F.to_json(proof).alias("proof"))


@query(BOXES + """, e AS (SELECT doc_id, page, x, y, w FROM boxes WHERE length(text) >= 14 UNION ALL SELECT doc_id, page, x + 1, y, w FROM boxes WHERE length(text) >= 14)
SELECT e.doc_id, e.page, e.x, e.y, b.text FROM e LEFT JOIN boxes b ON b.doc_id = e.doc_id AND b.page = e.page AND b.x = e.x AND b.y = e.y AND b.w = e.w""")
def box_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The word that a piece of evidence came from, by its exact place; a place without a box gives none."""
    b = boxes(spark, sf_dir).select("doc_id", "page", F.col("left").cast("long").alias("x"), F.col("top").cast("long").alias("y"), F.col("width").cast("long").alias("w"), "text")
    found = b.where("length(text) >= 14").drop("text")
    asked = found.unionByName(found.withColumn("x", F.col("x") + 1))
    return asked.join(b, ["doc_id", "page", "x", "y", "w"], "left").select("doc_id", "page", "x", "y", "text")


@query(BOXES + """, p AS (SELECT doc_id, page, count(*) AS boxes FROM boxes GROUP BY 1, 2), d AS (SELECT doc_id, unnest([1, 3]) AS page FROM documents) SELECT doc_id, d.page, boxes FROM d LEFT JOIN p USING (doc_id, page)""")
def draft_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts of pages 1 and 3 with the boxes of the page of that number."""
    pages = boxes(spark, sf_dir).groupBy("doc_id", "page").agg(F.count("*").alias("boxes"))
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(F.lit(1), F.lit(3))).alias("page")).join(pages, ["doc_id", "page"], "left")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE 'N' || o_orderkey END AS number, CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE o_orderkey % 7 END AS pages FROM orders""")
def unwrapped_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results as they come: a record, a record under res, or text that is neither."""
    k = F.col("o_orderkey")
    own = F.to_json(F.struct(F.concat(F.lit("N"), k).alias("number"), (k % 7).alias("pages")))
    raw = F.when(k % 3 == 0, own).when(k % 3 == 1, F.concat(F.lit('{"res": '), own, F.lit("}"))).otherwise(F.lit("no result"))
    got = table(spark, sf_dir, "orders").select("o_orderkey", unwrapped(raw, "number string, pages bigint").alias("p"))
    return got.select("o_orderkey", "p.number", "p.pages")


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS date, CASE WHEN o_orderkey % 3 = 0 THEN '10:30' END AS time, CASE WHEN o_orderkey % 2 = 0 THEN 'customer ' || o_custkey ELSE 'alias ' || o_custkey END AS buyer, 3 AS items, CASE WHEN o_orderkey % 4 = 0 THEN 'from b' ELSE 'plain' END AS first_text, 3 AS last_line FROM orders""")
def normalized_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's draft made regular: a date with a time is split, the name falls back, blank texts are null, rows are numbered anew."""
    k, c = F.col("o_orderkey"), F.col
    day = F.date_format(c("o_orderdate").cast("date"), "yyyy-MM-dd")
    rows = F.array(F.struct(F.lit(9).alias("line_no"), F.when(k % 4 == 0, " ").otherwise("plain").alias("description"), F.lit("from b").alias("description_en")), *(F.struct(F.lit(0).alias("line_no"), F.lit("x").alias("description"), F.lit("").alias("description_en")),) * 2)
    raw = F.struct(F.when(k % 3 == 0, F.concat(day, F.lit("T10:30"))).otherwise(day).alias("date"), F.when(k % 2 == 0, F.concat(F.lit("customer "), c("o_custkey"))).otherwise("").alias("name"), F.concat(F.lit("alias "), c("o_custkey")).alias("name_en"), rows.alias("items"))
    schema = "date string, name string, name_en string, items array<struct<line_no: int, description: string, description_en: string>>"
    d = table(spark, sf_dir, "orders").select(k, F.from_json(F.to_json(raw), schema).alias("d"))
    text = lambda x: F.nullif(F.trim(x), F.lit(""))
    numbered = F.transform("d.items", lambda x, i: F.struct((i + 1).alias("line_no"), F.coalesce(text(x["description"]), text(x["description_en"])).alias("description")))
    timed = F.col("d.date").rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(?::\d{2})?$")
    got = d.select(k, F.when(timed, F.substring("d.date", 1, 10)).otherwise(c("d.date")).alias("date"), F.when(timed, F.substring("d.date", 12, 8)).alias("time"), F.coalesce(text(c("d.name")), text(c("d.name_en"))).alias("buyer"), numbered.alias("items"))
    return got.select("o_orderkey", "date", "time", "buyer", F.size("items").alias("items"), F.get("items", F.lit(0))["description"].alias("first_text"), F.element_at("items", -1)["line_no"].alias("last_line"))


@query(ITEMS + """, s AS (SELECT l_orderkey, n, list_distinct([x for x in [CASE WHEN q IS NULL THEN 'quantity' END, CASE WHEN a IS NULL THEN 'amount' END, CASE WHEN p IS NULL THEN 'unit_price' END] if x IS NOT NULL]) AS gone FROM items)
SELECT l_orderkey, CASE WHEN count_if(len(gone) > 0) = 0 AND l_orderkey % 9 <> 0 THEN 'extracted' ELSE 'needs_review' END AS status, left(concat_ws('; ', 'Missing or unreadable: ' || string_agg(DISTINCT CASE WHEN len(gone) > 0 THEN array_to_string(list_sort(gone), '+') END, ', ' ORDER BY CASE WHEN len(gone) > 0 THEN array_to_string(list_sort(gone), '+') END), CASE WHEN l_orderkey % 9 = 0 THEN 'Optional printed fields not included: customer.address' END), 60) AS notes FROM s GROUP BY 1""")
def compact_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line a document: status, and notes on distinct gaps in order, cut to 60 characters."""
    c = F.col
    gone = F.array_compact(F.array(F.when(c("a").isNull(), F.lit("amount")), F.when(c("q").isNull(), F.lit("quantity")), F.when(c("p").isNull(), F.lit("unit_price"))))
    rows = items(spark, sf_dir).select("l_orderkey", F.nullif(F.array_join(gone, "+"), F.lit("")).alias("gap"))
    got = rows.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("gap")).alias("gaps"))
    optional = c("l_orderkey") % 9 == 0
    notes = F.concat_ws("; ", F.when(F.size("gaps") > 0, F.concat(F.lit("Missing or unreadable: "), F.array_join("gaps", ", "))), F.when(optional, "Optional printed fields not included: customer.address"))
    return got.select("l_orderkey", F.when((F.size("gaps") > 0) | optional, "needs_review").otherwise("extracted").alias("status"), F.substring(notes, 1, 60).alias("notes"))


@query("""SELECT conv_id, string_agg(role, ',' ORDER BY first) AS roles FROM (SELECT conv_id, role, min(turn) AS first FROM conversations WHERE role IS NOT NULL GROUP BY 1, 2) GROUP BY 1""")
def ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct values in the order of their first place, reduced before they are brought together."""
    first = table(spark, sf_dir, "conversations").where("role is not null").groupBy("conv_id", "role").agg(F.min("turn").alias("first"))
    return first.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "role"))), lambda x: x["role"]), ",").alias("roles"))


@query("""SELECT doc_id, CASE WHEN text IS NULL OR text = '' THEN 'empty' WHEN l.quality IS NULL THEN 'unlabelled' WHEN d.source IS NULL THEN 'no group' WHEN dup > 1 THEN 'repeated' ELSE 'eligible' END AS state FROM (SELECT *, count(*) OVER (PARTITION BY sha256(text)) AS dup FROM documents) d LEFT JOIN labels l USING (doc_id)""")
def label_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that may be learnt from: with text, label and group, and content that no other record has; else the first reason against."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "text", F.sha2("text", 256).alias("h"))
    n = d.groupBy("h").agg(F.count("*").alias("dup")).where("dup > 1")
    got = d.select("doc_id", "source", "h", (F.length("text") > 0).alias("full")).join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left").join(n, "h", "left")
    state = F.when(~F.coalesce("full", F.lit(False)), "empty").when(F.col("quality").isNull(), "unlabelled").when(F.col("source").isNull(), "no group").when(F.col("dup") > 1, "repeated").otherwise("eligible")
    return got.select("doc_id", state.alias("state"))


@query("""SELECT c_custkey, 'Read ' || CASE WHEN c_custkey % 2 = 0 THEN 'the header' ELSE 'the items' END || ' of page ' || (c_custkey % 3 + 1) || ' of 3.' || CASE WHEN c_custkey % 3 = 0 THEN ' Totals stand on a later page.' ELSE '' END || ' Unreadable fields are null.' AS prompt FROM customer""")
def record_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The instruction of a training record, by scope and page."""
    k: Column = F.col("c_custkey")
    text = F.concat(F.lit("Read "), F.when(k % 2 == 0, "the header").otherwise("the items"), F.lit(" of page "), (k % 3 + 1).cast("string"), F.lit(" of 3."), F.when(k % 3 == 0, " Totals stand on a later page.").otherwise(""), F.lit(" Unreadable fields are null."))
    return table(spark, sf_dir, "customer").select("c_custkey", text.alias("prompt"))


@query(ITEMS + """, code AS (SELECT l_orderkey, partkey, count(*) AS times, max(n) AS n FROM items GROUP BY 1, 2),
i AS (SELECT l_orderkey, 'items.item_code' AS field, 'not found' AS reason FROM code WHERE partkey % 19 = 0
UNION ALL SELECT l_orderkey, 'items.item_code', 'confidence' FROM code WHERE partkey % 19 <> 0 AND partkey % 5 = 0 AND 50 + partkey % 50 < 80
UNION ALL SELECT l_orderkey, 'items.quantity', 'no cell' FROM items WHERE q IS NOT NULL AND (l_orderkey + partkey) % 23 = 0
UNION ALL SELECT l_orderkey, 'totals.subtotal', CASE WHEN hit THEN 'role unverified' ELSE 'not found' END FROM (SELECT l_orderkey, bool_or(e = s) AS hit FROM (SELECT l_orderkey, e, sum(e) OVER (PARTITION BY l_orderkey) AS s FROM items) GROUP BY 1))
SELECT l_orderkey, count(*) AS issues, string_agg(DISTINCT field || ': ' || reason, '; ' ORDER BY field || ': ' || reason) AS found FROM i GROUP BY 1""")
def evidence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All checks of a document's values against its boxes in one list: codes that aren't found or read with under 80 per cent, numbers without
    a cell of their row, totals that occur without a label or not at all."""
    c = F.col
    rows = items(spark, sf_dir)
    said = lambda field, reason: F.struct(F.lit(field).alias("field"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"))
    codes = rows.groupBy("l_orderkey", "partkey").agg(F.count("*").alias("times"))
    code = F.when(c("partkey") % 19 == 0, "not found").when((c("partkey") % 5 == 0) & (50 + c("partkey") % 50 < 80), "confidence")
    one = codes.select("l_orderkey", code.alias("r")).where("r is not null").select("l_orderkey", said("items.item_code", c("r")).alias("i"))
    two = rows.where(c("q").isNotNull() & ((c("l_orderkey") + c("partkey")) % 23 == 0)).select("l_orderkey", said("items.quantity", "no cell").alias("i"))
    sums = rows.groupBy("l_orderkey").agg(complete_sum(c("e")).alias("s"), F.collect_set("e").alias("es"))
    three = sums.select("l_orderkey", said("totals.subtotal", F.when(F.array_contains("es", c("s")), "role unverified").otherwise("not found")).alias("i"))
    found = one.unionByName(two).unionByName(three).groupBy("l_orderkey", F.concat_ws(": ", "i.field", "i.reason").alias("f")).agg(F.count("*").alias("n"))
    return found.groupBy("l_orderkey").agg(F.sum("n").alias("issues"), F.array_join(F.array_sort(F.collect_list("f")), "; ").alias("found"))

