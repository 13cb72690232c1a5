"""Two drafts of the same rows, joined and merged under uniqueness guards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from boxwise.operators.merges import anchored, canonical, eav, out_of_order, outcome, unique_by
from boxwise.plans.registry import query
from boxwise.sources.tables import table


def drafts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Rows returned ('A') are one draft, the others a second one: l_orderkey, n, part, q, e (null now and then)."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("n"), F.col("l_partkey").alias("part"), F.col("l_quantity").cast("long").alias("q"), F.when(F.col("l_orderkey") % 5 != 0, cents).alias("e"), "l_returnflag")
    return rows.where("l_returnflag = 'A'").drop("l_returnflag"), rows.where("l_returnflag <> 'A'").drop("l_returnflag")


DRAFTS = """WITH base AS (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS n, l_partkey AS part, CAST(l_quantity AS BIGINT) AS q, CASE WHEN l_orderkey % 5 <> 0 THEN CAST(round(l_extendedprice * 100) AS BIGINT) END AS e, l_returnflag FROM lineitem),
a AS (SELECT * FROM base WHERE l_returnflag = 'A'), b AS (SELECT * FROM base WHERE l_returnflag <> 'A'),
ua AS (SELECT l_orderkey, n, max(part) AS part, max(q) AS q, max(e) AS e FROM a GROUP BY 1, 2 HAVING count(*) = 1), ub AS (SELECT l_orderkey, n, max(part) AS part, max(q) AS q, max(e) AS e FROM b GROUP BY 1, 2 HAVING count(*) = 1)
"""


@query(DRAFTS + "SELECT l_orderkey, n, ua.q, ub.q AS other_q, coalesce(ua.e, ub.e) AS e, ua.part = ub.part AS same_part FROM ua JOIN ub USING (l_orderkey, n)")
def unique_anchor_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = drafts(spark, sf_dir)
    got = anchored(a, b, ["l_orderkey", "n"], other_q="q", other_e="e", other_part="part")
    return got.select("l_orderkey", "n", "q", "other_q", F.coalesce("e", "other_e").alias("e"), (F.col("part") == F.col("other_part")).alias("same_part"))


@query(DRAFTS + """, la AS (SELECT l_orderkey, string_agg(n::VARCHAR, ',' ORDER BY n) AS ids, count(*) = count(DISTINCT n) AS once FROM a GROUP BY 1), lb AS (SELECT l_orderkey, string_agg(n::VARCHAR, ',' ORDER BY n) AS ids, count(*) = count(DISTINCT n) AS once FROM b GROUP BY 1)
SELECT l_orderkey, la.ids AS ids, lb.ids AS other_ids, la.ids = lb.ids AND la.once AND lb.once AS aligned FROM la JOIN lb USING (l_orderkey)""")
def ordered_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts line up only if their lists of numbers are equal and free of repeats."""
    one, two = (d.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("n")).alias(c)) for d, c in zip(drafts(spark, sf_dir), ("x", "y"), strict=True))
    once = lambda c: F.size(c) == F.size(F.array_distinct(c))
    return one.join(two, "l_orderkey").select("l_orderkey", F.array_join("x", ",").alias("ids"), F.array_join("y", ",").alias("other_ids"), ((F.col("x") == F.col("y")) & once("x") & once("y")).alias("aligned"))


@query(DRAFTS + """, m AS (SELECT ua.l_orderkey, ua.n, ub.part, lag(ub.part) OVER (PARTITION BY ua.l_orderkey ORDER BY ua.n) AS prev, ub.n AS there FROM ua LEFT JOIN ub USING (l_orderkey, n))
SELECT l_orderkey, count(*) AS anchors, count(there) AS found, bool_and(there IS NOT NULL AND (prev IS NULL OR part > prev)) AS in_order FROM m GROUP BY 1""")
def subsequence_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reread replaces a draft only if it has every anchor, in the draft's order."""
    a, b = drafts(spark, sf_dir)
    m = unique_by(a, ["l_orderkey", "n"], q="q").join(unique_by(b, ["l_orderkey", "n"], part="part"), ["l_orderkey", "n"], "left")
    m = m.withColumn("prev", F.lag("part").over(W.partitionBy("l_orderkey").orderBy("n")))
    good = F.col("part").isNotNull() & (F.col("prev").isNull() | (F.col("part") > F.col("prev")))
    return m.groupBy("l_orderkey").agg(F.count("*").alias("anchors"), F.count("part").alias("found"), F.every(F.coalesce(good, F.lit(False))).alias("in_order"))


@query(DRAFTS + """, va AS (SELECT l_orderkey, n, path, value FROM (SELECT l_orderkey, n, q::VARCHAR AS q, e::VARCHAR AS e FROM ua) UNPIVOT INCLUDE NULLS (value FOR path IN (q, e))), vb AS (SELECT l_orderkey, n, path, value FROM (SELECT l_orderkey, n, q::VARCHAR AS q, e::VARCHAR AS e FROM ub) UNPIVOT INCLUDE NULLS (value FOR path IN (q, e)))
SELECT l_orderkey, n, path, coalesce(va.value, vb.value) AS value, CASE WHEN va.value IS NULL AND vb.value IS NULL THEN 'missing' WHEN va.value IS NULL THEN 'filled' WHEN vb.value IS NULL THEN 'kept' WHEN va.value = vb.value THEN 'agreed' ELSE 'conflict' END AS outcome FROM va FULL JOIN vb USING (l_orderkey, n, path)""")
def draft_merge_eav(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long forms of two drafts, full outer on their paths: the first wins, the second fills, conflicts are named."""
    one, two = (eav(unique_by(d, ["l_orderkey", "n"], q="q", e="e"), ["l_orderkey", "n"], ["q", "e"]) for d in drafts(spark, sf_dir))
    m = one.withColumnRenamed("value", "x").join(two.withColumnRenamed("value", "y"), ["l_orderkey", "n", "path"], "full")
    return m.select("l_orderkey", "n", "path", F.coalesce("x", "y").alias("value"), outcome(F.col("x"), F.col("y")).alias("outcome"))


@query("""WITH p AS (SELECT conv_id, turn, CASE WHEN turn % 3 <> 0 THEN role END AS role, CASE WHEN turn % 2 = 1 THEN length(text) END AS n FROM conversations),
f AS (SELECT *, first_value(role IGNORE NULLS) OVER w AS role1, first_value(n IGNORE NULLS) OVER w AS n1 FROM p WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT conv_id, max(role1) AS role, CAST(max(n1) AS BIGINT) AS n, count_if(role <> role1) AS role_conflicts, count_if(n <> n1) AS n_conflicts FROM f GROUP BY conv_id""")
def first_non_null_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page that has a value gives it; later pages that differ are counted."""
    p = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 3 != 0, F.col("role")).alias("role"), F.when(F.col("turn") % 2 == 1, F.length("text").cast("long")).alias("n"))
    w = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    f = p.withColumns({"role1": F.first("role", ignorenulls=True).over(w), "n1": F.first("n", ignorenulls=True).over(w)})
    return f.groupBy("conv_id").agg(F.max("role1").alias("role"), F.max("n1").alias("n"), F.count_if(F.col("role") != F.col("role1")).alias("role_conflicts"), F.count_if(F.col("n") != F.col("n1")).alias("n_conflicts"))


@query("""WITH p AS (SELECT l_orderkey, l_linenumber AS n, l_partkey AS code, CASE WHEN l_linenumber > 4 THEN 2 ELSE 1 END AS page, 20 * l_linenumber - CASE WHEN l_suppkey % 5 = 0 THEN 45 ELSE 0 END AS y, 16 + l_partkey % 3 * 8 AS h FROM lineitem),
u AS (SELECT l_orderkey, code, max(n) AS n, max(page) AS page, max(y) AS y, max(h) AS h FROM p GROUP BY 1, 2 HAVING count(*) = 1),
s AS (SELECT l_orderkey, coalesce(lead(n) OVER w = n + 1 AND lead(page) OVER w = page AND y > lead(y) OVER w + greatest(h, lead(h) OVER w) * 0.5, false) AS back FROM u WINDOW w AS (PARTITION BY l_orderkey ORDER BY n, code))
SELECT l_orderkey, count(*) AS n, count_if(back) AS violations FROM s GROUP BY 1""")
def row_order_violation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring items, each with a code printed once, whose codes stand on one page more than half a height out of order."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("code"), F.when(F.col("l_linenumber") > 4, 2).otherwise(1).alias("page"), (20 * F.col("l_linenumber") - F.when(F.col("l_suppkey") % 5 == 0, 45).otherwise(0)).alias("y"), (16 + F.col("l_partkey") % 3 * 8).alias("h"))
    return out_of_order(unique_by(rows, ["l_orderkey", "code"], n="n", page="page", y="y", h="h"), ["l_orderkey"]).groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if("back").alias("violations"))


@query("SELECT o_orderkey::VARCHAR AS invoice_number, c_name AS buyer, n_name AS country, CAST(round(o_totalprice * 100) AS BIGINT) AS net_cents, NULLIF(o_orderstatus, '') AS state FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey")
def canonical_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    c = table(spark, sf_dir, "customer").join(nation, F.col("n_nationkey") == F.col("c_nationkey"))
    rows = table(spark, sf_dir, "orders").join(c, F.col("c_custkey") == F.col("o_custkey"))
    got = rows.select("*", F.col("o_orderkey").cast("string").alias("number"), F.round(F.col("o_totalprice") * 100).cast("long").alias("net"), F.nullif("o_orderstatus", F.lit("")).alias("status"))
    return canonical(got, invoice_number=["invoice_no", "number"], buyer=["customer_name", "c_name"], country=["n_name"], net_cents=["net"], state=["state", "status"])
