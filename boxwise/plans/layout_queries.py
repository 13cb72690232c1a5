"""Layout queries: cells, bands, runs, gates, labels, and the checks of drafts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from boxwise.operators.geometry import between
from boxwise.operators.layout import anchor_bands, best_template, column_of, composed, eligible_pages, label_match, labelled, last_wins, matched_or_largest, orientation, promoted, runs, with_peer
from boxwise.operators.merges import uncovered
from boxwise.plans.box_queries import BOXES, KEY, LABEL, boxes
from boxwise.plans.check_queries import ITEMS, PRINTED, items, printed
from boxwise.plans.registry import query
from boxwise.sources.tables import table

GATES = {"view": 70, "click": 75, "purchase": 80, "error": 85}
ALIASES = ["t", "th", "the", "er"]
TEMPLATES = {"english": [" the ", " of ", " and ", " that "], "german": [" der ", " die ", " und ", " das "], "spanish": [" el ", " la ", " de ", " que "]}


def _placed(df: DataFrame) -> DataFrame:
    return df.select(*KEY, F.col("ln").cast("long").alias("ln"), F.col("pos").cast("long").alias("pos"), "text", F.col("left").cast("long").alias("x"), F.col("top").cast("long").alias("y"), F.col("confidence").alias("conf"))


@query(BOXES + """, h AS (SELECT doc_id, page, pos AS col, x AS hx FROM boxes WHERE ln % 40 = 0),
g AS (SELECT *, least(coalesce(hx - lag(hx) OVER w1, 100000), coalesce(lead(hx) OVER w1 - hx, 100000)) AS gap FROM h WINDOW w1 AS (PARTITION BY doc_id, page ORDER BY hx)),
body AS (SELECT doc_id, page, ln, pos, x FROM boxes WHERE ln % 40 > 0),
l AS (SELECT b.*, g.col, gap, b.x - hx AS d FROM body b ASOF JOIN g ON b.doc_id = g.doc_id AND b.page = g.page AND b.x >= g.hx),
r AS (SELECT b.*, g.col, gap, hx - b.x AS d FROM body b ASOF JOIN g ON b.doc_id = g.doc_id AND b.page = g.page AND b.x < g.hx),
m AS (SELECT * FROM l UNION ALL SELECT * FROM r), t AS (SELECT *, min(d) OVER (PARTITION BY doc_id, ln, pos) AS near FROM m)
SELECT doc_id, ln, pos, max(col) AS col, max(d) AS d FROM t WHERE d = near GROUP BY 1, 2, 3 HAVING count(*) = 1 AND max(d) <= greatest(15, max(gap) * 58 // 100)""")
def column_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words below the first line of a page under the heading word that is strictly closest and near enough."""
    b = _placed(boxes(spark, sf_dir))
    heads = b.where("ln % 40 = 0").select(*KEY, F.col("pos").alias("col"), F.col("x").alias("head_x"))
    got = column_of(b.where("ln % 40 > 0").drop("col"), heads, KEY, "x", 15, 58)
    return got.select("doc_id", "ln", "pos", "col", F.abs(F.col("x") - F.col("head_x")).alias("d"))


@query(BOXES + """, u AS (SELECT doc_id, page, text, min(ln) AS ln FROM boxes WHERE length(text) >= 12 GROUP BY 1, 2, 3 HAVING count(*) = 1),
a AS (SELECT doc_id, page, ln, max(text) AS code FROM u GROUP BY 1, 2, 3 HAVING count(*) = 1),
z AS (SELECT *, (lag(ln) OVER w1 + ln) / 2 AS lo, (lead(ln) OVER w1 + ln) / 2 AS hi FROM a WINDOW w1 AS (PARTITION BY doc_id, page ORDER BY ln))
SELECT z.doc_id, z.page, z.ln, code, count(*) AS n, min(b.ln) AS first_line, max(b.ln) AS last_line FROM z JOIN boxes b ON z.doc_id = b.doc_id AND z.page = b.page AND (lo IS NULL OR b.ln >= lo) AND (hi IS NULL OR b.ln < hi) AND abs(b.ln - z.ln) <= 2 GROUP BY 1, 2, 3, 4""")
def row_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words in the band of each unique code of a page. Lines are counted before they meet the bands."""
    b = _placed(boxes(spark, sf_dir))
    bands = anchor_bands(b.where("length(text) >= 12"), KEY, "text", "ln")
    lines = b.groupBy(*KEY, F.col("ln").alias("at")).agg(F.count("*").alias("words"))
    met = bands.join(lines, KEY).where(between(F.col("at"), F.col("lo"), F.col("hi")) & (F.abs(F.col("at") - F.col("ln")) <= 2))
    return met.groupBy(*KEY, "ln", "code").agg(F.sum("words").alias("n"), F.min("at").alias("first_line"), F.max("at").alias("last_line"))


@query(BOXES + """, l AS (SELECT * FROM boxes WHERE length(text) = 3 AND text LIKE 't%'),
p AS (SELECT * FROM l WHERE EXISTS (SELECT 1 FROM l AS o WHERE o.doc_id = l.doc_id AND o.ln = l.ln AND o.pos <> l.pos AND abs(o.x - l.x) <= 300))
SELECT doc_id, page, arg_min(ln, (y, x)) AS ln, arg_min(pos, (y, x)) AS pos, arg_min(text, (y, x)) AS text, count(*) AS n FROM p GROUP BY 1, 2""")
def header_peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first label of a page that has another label near it on its line."""
    peers = with_peer(_placed(boxes(spark, sf_dir).where(LABEL)), [*KEY, "ln"], "x", 300)
    best = F.min(F.struct("y", "x", "ln", "pos", "text")).alias("b")
    return peers.groupBy(*KEY).agg(best, F.count("*").alias("n")).select(*KEY, "b.ln", "b.pos", "b.text", "n")


@query(BOXES + """, d AS (SELECT DISTINCT doc_id, page, x FROM boxes), s AS (SELECT *, CASE WHEN x - lag(x) OVER w1 > 24 THEN 1 ELSE 0 END AS b FROM d WINDOW w1 AS (PARTITION BY doc_id, page ORDER BY x)),
g AS (SELECT *, CAST(sum(b) OVER (PARTITION BY doc_id, page ORDER BY x) AS BIGINT) AS run FROM s) SELECT doc_id, page, run, count(*) AS n, min(x) AS first, max(x) AS last FROM g GROUP BY 1, 2, 3""")
def edge_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of left edges on a page, a new one after a step of more than 24."""
    return runs(_placed(boxes(spark, sf_dir)), KEY, "x", 24)


@query(BOXES + """, c AS (SELECT DISTINCT doc_id, page, x // 40 AS cx, y // 40 AS cy FROM boxes WHERE conf >= 85) SELECT b.doc_id, b.page, b.ln, b.pos FROM boxes b LEFT JOIN c ON b.doc_id = c.doc_id AND b.page = c.page AND b.x // 40 = c.cx AND b.y // 40 = c.cy WHERE c.doc_id IS NULL AND length(b.text) >= 8""")
def footer_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long words at no rounded place that a sure word holds."""
    b = _placed(boxes(spark, sf_dir)).withColumns({"cx": F.expr("x div 40"), "cy": F.expr("y div 40")})
    return uncovered(b.where("length(text) >= 8"), b.where("conf >= 85"), [*KEY, "cx", "cy"]).select(*KEY, "ln", "pos")


@query("""WITH e AS (SELECT user_id, event_type, event_id, CAST(50 + (7 * event_id) % 50 AS BIGINT) AS conf FROM events), p AS (SELECT e.* FROM e JOIN (VALUES ('view', 70), ('click', 75), ('purchase', 80), ('error', 85)) AS g(kind, gate) ON event_type = kind AND conf >= gate)
SELECT user_id, event_type, count(*) AS n_passed, arg_max(event_id, (conf, -event_id)) AS event_id, max(conf) AS conf FROM p GROUP BY 1, 2""")
def gated_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second readings behind a gate of their kind, one winner a kind; kinds without a gate have none."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", (50 + (7 * F.col("event_id")) % 50).cast("long").alias("conf"))
    return promoted(e, ["user_id"], "event_type", "conf", GATES, "event_id")


@query("""SELECT user_id, event_type, count(*) AS n_written, arg_max(CAST(round(value * 100) AS BIGINT), (ts, event_id)) AS value FROM events GROUP BY 1, 2""")
def last_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("value", F.round(F.col("value") * 100).cast("long"))
    return last_wins(e, ["user_id", "event_type"], ["ts", "event_id"], "value")


@query("""WITH u AS (SELECT event_type AS label, user_id AS value, event_id FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_type, user_id + 1, event_id FROM events WHERE event_id % 2 = 1) SELECT label, value, min(event_id) AS first_id FROM u GROUP BY 1, 2""")
def extras_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed extras of two sources, each (label, value) once, from where it stands first."""
    e = table(spark, sf_dir, "events")
    part = lambda odd, add: e.where(F.col("event_id") % 2 == odd).select(F.col("event_type").alias("label"), (F.col("user_id") + add).alias("value"), "event_id")
    return part(0, 0).unionByName(part(1, 1)).groupBy("label", "value").agg(F.min("event_id").alias("first_id"))


@query(ITEMS + PRINTED + """, b AS (SELECT o_orderkey, printed, max(e) AS largest, max(CASE WHEN abs(e - printed) <= 5 THEN e END) AS fit FROM printed JOIN items ON l_orderkey = o_orderkey GROUP BY 1, 2)
SELECT o_orderkey, coalesce(fit, largest) AS value, fit IS NULL AS review FROM b""")
def words_or_largest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row amount that meets the printed total, else the largest one, for review."""
    met = printed(spark, sf_dir).join(items(spark, sf_dir).select(F.col("l_orderkey").alias("o_orderkey"), "e"), "o_orderkey")
    value, review = matched_or_largest(F.col("e"), F.col("printed"), 5)
    return met.groupBy("o_orderkey").agg(value.alias("value"), review.alias("review"))


@query(ITEMS + """, r AS (SELECT o_orderkey, count(n) AS n_items, count(*) FILTER (WHERE d = 0 AND abs(q * p - a) > 2) AS off FROM orders LEFT JOIN items ON l_orderkey = o_orderkey GROUP BY 1)
SELECT o_orderkey, n_items, off, concat_ws(',', CASE WHEN n_items = 0 THEN 'empty' END, CASE WHEN off > 0 THEN 'amount' END) AS warnings FROM r WHERE n_items = 0 OR off > 0""")
def draft_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders without rows, and orders with undiscounted rows whose amount isn't quantity times price."""
    off = F.count_if((F.col("d") == 0) & (F.abs(F.col("q") * F.col("p") - F.col("a")) > 2)).alias("off")
    r = items(spark, sf_dir).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n_items"), off)
    zero = F.lit(0).cast("long")
    all_ = table(spark, sf_dir, "orders").select("o_orderkey").join(r, "o_orderkey", "left").select("o_orderkey", F.coalesce("n_items", zero).alias("n_items"), F.coalesce("off", zero).alias("off"))
    return all_.withColumn("warnings", F.concat_ws(",", F.when(F.col("n_items") == 0, "empty"), F.when(F.col("off") > 0, "amount"))).where("warnings <> ''")


@query("""WITH t AS (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(text, '[^A-Za-z0-9_/-]+')) AS token FROM documents), k AS (SELECT CAST(o_orderkey AS VARCHAR) AS token FROM orders) SELECT token, count(*) AS n_docs, min(doc_id) AS first_doc FROM t JOIN k USING (token) GROUP BY 1""")
def bounded_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order numbers that stand in texts with no letter, digit, slash or hyphen beside them: tokens joined by value, not a search of texts."""
    t = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(F.filter(F.split("text", "[^A-Za-z0-9_/-]+"), lambda s: s.rlike("^[0-9]+$")))).alias("token"))
    seen = t.groupBy("token").agg(F.count_distinct("doc_id").alias("n_docs"), F.min("doc_id").alias("first_doc"))
    return seen.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("token")), "token")


@query("""WITH t AS (SELECT p_partkey, lower(p_name) AS s FROM part), m AS (SELECT p_partkey, s, a FROM t LEFT JOIN (VALUES ('t'), ('th'), ('the'), ('er')) AS x(a) ON starts_with(s, a) OR ends_with(s, a)),
b AS (SELECT p_partkey, s, arg_max(a, (length(a), a)) AS alias FROM m GROUP BY 1, 2) SELECT p_partkey, alias, CASE WHEN starts_with(s, alias) THEN substr(s, length(alias) + 1) WHEN alias IS NOT NULL THEN substr(s, 1, length(s) - length(alias)) END AS remainder FROM b""")
def label_remainders(spark: SparkSession, sf_dir: str) -> DataFrame:
    alias, rest = label_match(F.lower("p_name"), ALIASES)
    return table(spark, sf_dir, "part").select("p_partkey", alias.alias("alias"), rest.alias("remainder"))


@query("""WITH m AS (SELECT event_type AS run, count_if(CAST(round(value * 100) AS BIGINT) % 100 <> 0) AS decimals, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total, count(*) AS n FROM events GROUP BY 1) SELECT *, row_number() OVER (ORDER BY decimals DESC, total DESC, n DESC, run) AS rank FROM m""")
def sweep_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of a sweep from best to worst; there are as many rows as runs, so one window ranks them."""
    cents = F.round(F.col("value") * 100).cast("long")
    m = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("run")).agg(F.count_if(cents % 100 != 0).alias("decimals"), F.sum(cents).alias("total"), F.count("*").alias("n"))
    return m.withColumn("rank", F.row_number().over(W.partitionBy().orderBy(F.desc("decimals"), F.desc("total"), F.desc("n"), "run")).cast("long"))


@query(BOXES + """SELECT doc_id, page, count(*) AS n, CAST(sum(length(regexp_replace(text, '[^0-9A-Za-z]', '', 'g'))) AS BIGINT) AS alnum, count(*) >= 4 AND sum(length(regexp_replace(text, '[^0-9A-Za-z]', '', 'g'))) >= 40 AND count(*) FILTER (WHERE x + w > 4000 OR contains(text, chr(65533))) = 0 AS eligible FROM boxes GROUP BY 1, 2""")
def page_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eligible_pages(boxes(spark, sf_dir), KEY, 4000)


@query("""WITH m AS (SELECT doc_id, contains(s, ' the ')::INT + contains(s, ' of ')::INT + contains(s, ' and ')::INT + contains(s, ' that ')::INT AS e, contains(s, ' der ')::INT + contains(s, ' die ')::INT + contains(s, ' und ')::INT + contains(s, ' das ')::INT AS g,
 contains(s, ' el ')::INT + contains(s, ' la ')::INT + contains(s, ' de ')::INT + contains(s, ' que ')::INT AS p FROM (SELECT doc_id, lower(text) AS s FROM documents))
SELECT doc_id, CASE WHEN greatest(e, g, p) < 2 THEN NULL WHEN e >= g AND e >= p THEN 'english' WHEN g >= p THEN 'german' ELSE 'spanish' END AS template FROM m""")
def template_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", best_template(F.lower("text"), TEMPLATES).alias("template"))


@query("""WITH p AS (SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS a, CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment WHEN c_custkey % 8 = 0 THEN '' END AS b, CASE WHEN c_custkey % 5 <> 0 THEN n_name END AS c FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT c_custkey, CASE WHEN (a IS NOT NULL)::INT + (coalesce(b, '') <> '')::INT + (c IS NOT NULL)::INT >= 2 THEN concat_ws(', ', a, nullif(b, ''), c) END AS address FROM p""")
def composed_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    parts = [F.when(k % 3 != 0, F.col("c_name")), F.when(k % 4 != 0, F.col("c_mktsegment")).when(k % 8 == 0, ""), F.when(k % 5 != 0, F.col("n_name"))]
    met = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return met.select("c_custkey", composed(parts).alias("address"))


@query("""WITH o AS (SELECT event_id, CASE WHEN event_id % 9 <> 0 THEN 90 * (event_id % 5) END AS t, (7 * event_id) % 100 AS c FROM events)
SELECT event_id, CASE WHEN t IN (0, 90, 180, 270) AND c >= 90 THEN t ELSE 0 END AS turn, CASE WHEN t IS NULL OR t NOT IN (0, 90, 180, 270) THEN 'unknown' WHEN c < 90 THEN 'unsure' WHEN t = 0 THEN 'upright' ELSE 'turned' END AS why FROM o""")
def orientation_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    turn, why = orientation(F.when(k % 9 != 0, 90 * (k % 5)), (7 * k) % 100)
    return table(spark, sf_dir, "events").select("event_id", turn.alias("turn"), why.alias("why"))


@query(BOXES + """, c AS (SELECT doc_id, ln, pos, CASE WHEN length(text) = 3 THEN text || ':' WHEN length(text) >= 12 THEN substr(text, 1, 4) || ':' || substr(text, 5) ELSE text END AS text FROM boxes),
n AS (SELECT *, lead(text) OVER (PARTITION BY doc_id, ln ORDER BY pos) AS follower FROM c)
SELECT doc_id, ln, pos, regexp_extract(text, '^([A-Za-z]+):', 1) AS label, coalesce(nullif(regexp_extract(text, '^[A-Za-z]+:(.*)$', 1), ''), follower) AS value FROM n WHERE regexp_matches(text, '^[A-Za-z]+:')""")
def label_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that stand behind a colon, in the same word or the next. The texts hold no colons, so a rule puts them in."""
    colon = F.expr("case when length(text) = 3 then text || ':' when length(text) >= 12 then substr(text, 1, 4) || ':' || substr(text, 5) else text end")
    b = _placed(boxes(spark, sf_dir)).withColumn("text", colon).withColumn("follower", F.lead("text").over(W.partitionBy("doc_id", "ln").orderBy("pos")))
    label, value = labelled(F.col("text"), F.col("follower"))
    return b.where(F.col("text").rlike("^[A-Za-z]+:")).select("doc_id", "ln", "pos", label.alias("label"), value.alias("value"))


@query(BOXES + """, h AS (SELECT doc_id, page, x AS hx, text AS heading FROM boxes WHERE ln % 40 = 0 AND length(text) >= 8), f AS (SELECT doc_id, ln FROM boxes WHERE pos = 0 AND length(text) <= 4 AND ln % 40 > 0),
m AS (SELECT b.doc_id, b.page, b.ln, b.pos, b.text, h.heading, h.hx, abs(b.x - h.hx) AS d FROM boxes b JOIN f ON b.doc_id = f.doc_id AND b.ln = f.ln JOIN h ON b.doc_id = h.doc_id AND b.page = h.page WHERE b.pos > 0),
t AS (SELECT *, min(d) OVER (PARTITION BY doc_id, ln, pos) AS near FROM m), c AS (SELECT doc_id, ln, pos, max(text) AS text, max(heading) AS heading, max(hx) AS hx, max(d) AS d FROM t WHERE d = near GROUP BY 1, 2, 3 HAVING count(*) = 1 AND max(d) <= 60)
SELECT doc_id, ln, hx, max(heading) AS heading, max(text) AS value FROM c GROUP BY 1, 2, 3 HAVING count(*) = 1""")
def total_row_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one value that a total's row holds under each heading of its page; nothing where two stand there."""
    b = _placed(boxes(spark, sf_dir))
    first = F.first("text").over(W.partitionBy("doc_id", "ln").orderBy("pos"))
    cells = b.withColumn("_first", first).where((F.length("_first") <= 4) & F.expr("ln % 40 > 0 and pos > 0"))
    heads = b.where("ln % 40 = 0 and length(text) >= 8").select(*KEY, F.col("text").alias("heading"), F.col("x").alias("head_x"))
    met = column_of(cells, heads, KEY, "x", 60, 0)
    return met.groupBy("doc_id", "ln", F.col("head_x").alias("hx")).agg(F.count("*").alias("c"), F.max("heading").alias("heading"), F.max("text").alias("value")).where("c = 1").drop("c")


@query(ITEMS + """SELECT l_orderkey, count(*) AS n_items, string_agg(n || ':' || partkey || 'x' || coalesce(CAST(q AS VARCHAR), '?'), ';' ORDER BY n, partkey, q NULLS FIRST) AS lines FROM items GROUP BY 1""")
def nested_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of an order as one list by line, then part, then quantity, unknown ones first."""
    held = F.array_sort(F.collect_list(F.struct("n", "partkey", "q")))
    shown = F.transform(held, lambda r: F.concat(r["n"].cast("string"), F.lit(":"), r["partkey"].cast("string"), F.lit("x"), F.coalesce(r["q"].cast("string"), F.lit("?"))))
    return items(spark, sf_dir).groupBy("l_orderkey").agg(F.count("*").alias("n_items"), F.array_join(shown, ";").alias("lines"))
