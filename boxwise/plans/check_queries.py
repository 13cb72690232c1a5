"""Validation and reconciliation over orders (documents with a printed total) and lineitem (their rows), in whole cents.

The tables hold no nulls and no printed totals, so both are derived by fixed rules, the same in both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxwise.functions.words import arabic_amount, english_amount
from boxwise.operators.checks import all_true, complete_sum, missing, only_value, plausible, reconciled, row_mode, status
from boxwise.plans.registry import query
from boxwise.sources.tables import table


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """l_orderkey, n, partkey, q, a (amount), t (tax per cent), d (discount per cent), v (tax), p (price), g (gross); some values are missing."""
    k, n = F.col("l_orderkey"), F.col("l_linenumber").cast("long")
    base = table(spark, sf_dir, "lineitem").select(k, n.alias("n"), F.col("l_partkey").alias("partkey"), F.col("l_quantity").cast("long").alias("q"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("e"), F.round(F.col("l_tax") * 100).cast("long").alias("t"), F.round(F.col("l_discount") * 100).cast("long").alias("d"))
    vat = base.withColumn("v", F.expr("(e * t + 50) div 100"))
    return vat.select(
        "l_orderkey", "n", "partkey", "t", "d", "e", "v",
        F.when((k + F.col("n")) % 11 != 0, F.col("q")).alias("q"),
        F.when((k * 7 + F.col("n")) % 23 != 0, F.col("e")).alias("a"),
        F.when(k % 3 == 0, F.col("e")).when(k % 3 == 1, F.expr("e div q")).alias("p"),
        (F.when(k % 3 == 0, F.col("q") * (F.col("e") + F.col("v"))).otherwise(F.col("e") + F.col("v")) + F.when(F.col("n") == 7, 500).otherwise(0)).alias("g"),
    )


ITEMS = """WITH base AS (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS n, l_partkey AS partkey, CAST(l_quantity AS BIGINT) AS q0,
 CAST(round(l_extendedprice * 100) AS BIGINT) AS e, CAST(round(l_tax * 100) AS BIGINT) AS t, CAST(round(l_discount * 100) AS BIGINT) AS d FROM lineitem),
vat AS (SELECT *, (e * t + 50) // 100 AS v FROM base),
items AS (SELECT l_orderkey, n, partkey, t, d, e, v, CASE WHEN (l_orderkey + n) % 11 <> 0 THEN q0 END AS q,
 CASE WHEN (l_orderkey * 7 + n) % 23 <> 0 THEN e END AS a,
 CASE WHEN l_orderkey % 3 = 0 THEN e WHEN l_orderkey % 3 = 1 THEN e // q0 END AS p,
 CASE WHEN l_orderkey % 3 = 0 THEN q0 * (e + v) ELSE e + v END + CASE WHEN n = 7 THEN 500 ELSE 0 END AS g FROM vat)
"""


def printed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o_orderkey and its printed total: the true sum, a wrong one, or none."""
    k = F.col("o_orderkey")
    sums = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("s"))
    out = table(spark, sf_dir, "orders").select("o_orderkey").join(sums, "o_orderkey", "left")
    return out.select(k, F.when(k % 29 != 0, F.col("s") + F.when(k % 7 == 0, 100).otherwise(k % 4)).alias("printed"))


PRINTED = """, sums AS (SELECT l_orderkey, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS s FROM lineitem GROUP BY 1),
printed AS (SELECT o_orderkey, CASE WHEN o_orderkey % 29 <> 0 THEN CAST(s + CASE WHEN o_orderkey % 7 = 0 THEN 100 ELSE o_orderkey % 4 END AS BIGINT) END AS printed
 FROM orders LEFT JOIN sums ON l_orderkey = o_orderkey)
"""
STATUS = "CASE WHEN {a} IS NULL OR {b} IS NULL THEN 'unresolved' WHEN abs({a} - {b}) <= {k} THEN 'ok' ELSE 'mismatch' END"


@query(ITEMS + PRINTED + """SELECT o_orderkey, coalesce(c, 0) AS n_items, CAST(s2 AS BIGINT) AS summed, printed,
 CASE WHEN s2 IS NULL OR printed IS NULL THEN 'unresolved' WHEN abs(s2 - printed) <= 5 THEN 'ok' ELSE 'mismatch' END AS status
FROM printed LEFT JOIN (SELECT l_orderkey, count(*) AS c, CASE WHEN count(*) = count(a) THEN sum(a) END AS s2 FROM items GROUP BY 1) ON l_orderkey = o_orderkey""")
def total_reconcile_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items(spark, sf_dir).withColumnRenamed("l_orderkey", "o_orderkey")
    return reconciled(printed(spark, sf_dir), rows, "o_orderkey", "a", "printed").select("o_orderkey", "n_items", "summed", "printed", "status")


MODE = """CASE WHEN q IS NULL OR p IS NULL OR a IS NULL THEN 'unresolved'
 WHEN abs(q * p - a) <= 2 AND coalesce(abs(a + v - g) <= 2, true) THEN 'direct'
 WHEN abs(p - a) <= 2 AND abs(q * (a + v) - g) <= 2 THEN 'per_unit' ELSE 'mismatch' END"""


@query(ITEMS + f", m AS (SELECT *, {MODE} AS mode FROM items) SELECT l_orderkey, n, partkey, mode, CASE WHEN mode = 'per_unit' THEN q * a ELSE a END AS effective, CASE WHEN mode = 'per_unit' THEN q * v ELSE v END AS effective_vat FROM m")
def item_check_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    rows = items(spark, sf_dir).withColumn("mode", row_mode(c("q"), c("p"), c("a"), c("v"), c("g"), F.lit(None).cast("long")))
    unit = c("mode") == "per_unit"
    return rows.select("l_orderkey", "n", "partkey", "mode", F.when(unit, c("q") * c("a")).otherwise(c("a")).alias("effective"), F.when(unit, c("q") * c("v")).otherwise(c("v")).alias("effective_vat"))


@query(ITEMS + """SELECT l_orderkey, n, partkey, NOT coalesce(q IS NOT NULL AND p IS NOT NULL AND a IS NOT NULL AND g IS NOT NULL
 AND NOT (abs(a - p) <= 5 OR abs(q * p - a) <= 5 OR abs(a + v - g) <= 5) AND abs(q * p - g) > 100 AND abs(a - p) > 100, false) AS plausible FROM items""")
def row_plausibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return items(spark, sf_dir).select("l_orderkey", "n", "partkey", plausible(c("q"), c("p"), c("a"), c("v"), c("g")).alias("plausible"))


@query(ITEMS + """SELECT l_orderkey, n, partkey, concat_ws(',', CASE WHEN q IS NULL THEN 'quantity' END, CASE WHEN p IS NULL THEN 'unit_price' END, CASE WHEN a IS NULL THEN 'amount' END) AS missing,
 CASE WHEN q IS NULL OR p IS NULL OR a IS NULL THEN 'unresolved' WHEN abs(q * p - a) <= 5 OR abs(a - p) <= 5 THEN 'ok' ELSE 'mismatch' END AS status FROM items""")
def unresolved_operands(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    gone = missing(quantity=c("q"), unit_price=c("p"), amount=c("a"))
    near = (F.abs(c("q") * c("p") - c("a")) <= 5) | (F.abs(c("a") - c("p")) <= 5)
    return items(spark, sf_dir).select("l_orderkey", "n", "partkey", gone.alias("missing"), F.when(gone != "", "unresolved").when(near, "ok").otherwise("mismatch").alias("status"))


TOTALS = """, totals AS (SELECT l_orderkey, CASE WHEN count(*) = count(a) THEN CAST(sum(a) AS BIGINT) END AS taxable, CAST(sum(v) AS BIGINT) AS vat,
 CASE WHEN l_orderkey % 5 = 0 THEN NULL WHEN l_orderkey % 5 = 1 THEN 0 ELSE 700 END AS other, l_orderkey % 5 <> 1 AS has_other,
 CAST(sum(e) + sum(v) AS BIGINT) + CASE WHEN l_orderkey % 5 IN (0, 1) THEN 0 ELSE 700 END + CASE WHEN l_orderkey % 13 = 0 THEN 90 ELSE 0 END AS net,
 CASE WHEN min(t) = max(t) THEN max(t) END AS rate FROM items GROUP BY l_orderkey)
"""


def order_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_orderkey")
    got = items(spark, sf_dir).groupBy("l_orderkey").agg(complete_sum(F.col("a")).alias("taxable"), F.sum("v").alias("vat"), F.sum("e").alias("e"), F.min("t").alias("t0"), F.max("t").alias("t1"))
    other = F.when(k % 5 == 0, None).when(k % 5 == 1, 0).otherwise(700)
    return got.select("l_orderkey", "taxable", "vat", other.alias("other"), (k % 5 != 1).alias("has_other"), (F.col("e") + F.col("vat") + F.when((k % 5).isin(0, 1), 0).otherwise(700) + F.when(k % 13 == 0, 90).otherwise(0)).alias("net"), F.when(F.col("t0") == F.col("t1"), F.col("t1")).alias("rate"))


@query(ITEMS + TOTALS + """SELECT l_orderkey, CASE WHEN taxable IS NULL OR (has_other AND other IS NULL) THEN 'unresolved' WHEN abs(taxable + vat + CASE WHEN has_other THEN other ELSE 0 END - net) <= 5 THEN 'ok' ELSE 'mismatch' END AS grand,
 CASE WHEN taxable IS NULL OR rate IS NULL THEN 'unresolved' WHEN taxable = 0 THEN 'skipped' WHEN abs(vat * 100 - rate * taxable) <= 500 THEN 'ok' ELSE 'mismatch' END AS overall_rate,
 concat_ws(',', CASE WHEN taxable IS NULL THEN 'taxable' END, CASE WHEN has_other AND other IS NULL THEN 'other_charges' END) AS missing FROM totals""")
def grand_total_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An absent charge is zero, a null one leaves the total undecided."""
    c = F.col
    charge = F.when(c("has_other"), c("other")).otherwise(0)
    rate = F.when(c("taxable").isNull() | c("rate").isNull(), "unresolved").when(c("taxable") == 0, "skipped").when(F.abs(c("vat") * 100 - c("rate") * c("taxable")) <= 500, "ok").otherwise("mismatch")
    return order_totals(spark, sf_dir).select("l_orderkey", status(c("taxable") + c("vat") + charge, c("net"), 5).alias("grand"), rate.alias("overall_rate"), missing(taxable=c("taxable"), other_charges=charge).alias("missing"))


@query(ITEMS + """SELECT field, count(*) AS n FROM (SELECT unnest([CASE WHEN q IS NULL THEN 'quantity' END, CASE WHEN p IS NULL THEN 'unit_price' END, CASE WHEN a IS NULL THEN 'amount' END]) AS field FROM items) WHERE field IS NOT NULL GROUP BY field""")
def missing_field_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    gone = F.array_compact(F.array(F.when(c("q").isNull(), F.lit("quantity")), F.when(c("p").isNull(), F.lit("unit_price")), F.when(c("a").isNull(), F.lit("amount"))))
    return items(spark, sf_dir).select(F.explode(gone).alias("field")).groupBy("field").agg(F.count("*").alias("n"))


CHECKS = f""", per AS (SELECT l_orderkey, CASE WHEN count(*) = count(a) AND count(*) = count(p) AND count(*) = count(q) THEN bool_and({MODE} IN ('direct', 'per_unit')) END AS rows_ok,
 bool_and(coalesce(abs(a + v - g) <= 2, false)) AS gross_ok, bool_and(v >= 0) AS vat_ok, count(*) AS n FROM items GROUP BY l_orderkey)
"""


@query(ITEMS + CHECKS + "SELECT l_orderkey, n, rows_ok, gross_ok, coalesce(rows_ok, false) AND gross_ok AND vat_ok AS clean FROM per")
def clean_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether all three checks are true; an undecided check is not true."""
    return _per_order(spark, sf_dir).select("l_orderkey", "n", "rows_ok", "gross_ok", (F.coalesce("rows_ok", F.lit(False)) & F.col("gross_ok") & F.col("vat_ok")).alias("clean"))


def _per_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    mode = row_mode(c("q"), c("p"), c("a"), c("v"), c("g"), F.lit(None).cast("long"))
    known = c("q").isNotNull() & c("p").isNotNull() & c("a").isNotNull()
    return items(spark, sf_dir).groupBy("l_orderkey").agg(F.when(F.every(known), F.every(mode.isin("direct", "per_unit"))).alias("rows_ok"), all_true(F.abs(c("a") + c("v") - c("g")) <= 2).alias("gross_ok"), all_true(c("v") >= 0).alias("vat_ok"), F.count("*").alias("n"))


@query(ITEMS + CHECKS + "SELECT count(*) AS documents, count_if(coalesce(rows_ok, false)) AS rows_true, count_if(rows_ok IS NULL) AS rows_unknown, count_if(gross_ok) AS gross_true, count_if(coalesce(rows_ok, false) AND gross_ok AND vat_ok) AS clean, CAST(sum(n) AS BIGINT) AS items FROM per")
def check_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    true = F.coalesce(c("rows_ok"), F.lit(False))
    return _per_order(spark, sf_dir).agg(F.count("*").alias("documents"), F.count_if(true).alias("rows_true"), F.count_if(c("rows_ok").isNull()).alias("rows_unknown"), F.count_if(c("gross_ok")).alias("gross_true"), F.count_if(true & c("gross_ok") & c("vat_ok")).alias("clean"), F.sum("n").alias("items"))


@query(ITEMS + "SELECT l_orderkey, CASE WHEN count(DISTINCT t) = 1 THEN max(t) END AS rate FROM items GROUP BY l_orderkey")
def singleton_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).groupBy("l_orderkey").agg(only_value(F.col("t")).alias("rate"))


@query(ITEMS + """, k AS (SELECT l_orderkey, CASE WHEN l_orderkey % 2 = 0 THEN CAST(sum(e) AS BIGINT) END AS printed, CAST(sum(e) AS BIGINT) AS wanted, CASE WHEN count(*) = count(a) THEN CAST(sum(a) AS BIGINT) END AS s FROM items GROUP BY 1),
found AS (SELECT l_orderkey, min(n * 1000000000000 + e) AS key FROM items JOIN k USING (l_orderkey) WHERE abs(e - wanted) <= 1 GROUP BY 1)
SELECT k.l_orderkey, coalesce(k.printed, f.key % 1000000000000) AS subtotal, CASE WHEN k.printed IS NOT NULL THEN 'printed' WHEN f.key IS NOT NULL THEN 'filled' ELSE 'missing' END AS origin FROM k LEFT JOIN found f ON f.l_orderkey = k.l_orderkey""")
def band_value_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A missing total is filled only from an amount that is printed and equals what the rows need, the first such in order."""
    rows = items(spark, sf_dir)
    need = rows.groupBy("l_orderkey").agg(F.sum("e").alias("wanted"))
    found = rows.join(need, "l_orderkey").where("abs(e - wanted) <= 1").groupBy("l_orderkey").agg(F.min(F.struct("n", "e")).alias("f"))
    out = need.withColumn("printed", F.when(F.col("l_orderkey") % 2 == 0, F.col("wanted"))).join(found, "l_orderkey", "left")
    return out.select("l_orderkey", F.coalesce("printed", "f.e").alias("subtotal"), F.when(F.col("printed").isNotNull(), "printed").when(F.col("f").isNotNull(), "filled").otherwise("missing").alias("origin"))


@query(ITEMS + PRINTED + """SELECT o_orderkey, n, partkey, e FROM printed JOIN items ON l_orderkey = o_orderkey AND e = printed
UNION ALL SELECT o_orderkey, n, partkey, e FROM printed JOIN items ON l_orderkey = o_orderkey AND e + 1 = printed""")
def value_evidence_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals that occur among the amounts of their document, by an equi-join on document and value."""
    total = printed(spark, sf_dir).select("o_orderkey", F.explode(F.array(F.col("printed"), F.col("printed") - 1)).alias("e"))
    return total.join(items(spark, sf_dir).withColumnRenamed("l_orderkey", "o_orderkey"), ["o_orderkey", "e"]).select("o_orderkey", "n", "partkey", "e")


SMALL = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen"
TENS = "zero ten twenty thirty forty fifty sixty seventy eighty ninety"


def _spelt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order keys spelt out: hundreds and ones, in thousands."""
    small, tens = F.array(*map(F.lit, SMALL.split())), F.array(*map(F.lit, TENS.split()))
    k = F.col("o_orderkey")
    name = lambda n: F.when(n < 20, F.get(small, n.cast("int"))).otherwise(F.concat_ws(" ", F.get(tens, F.floor(n / 10).cast("int")), F.when(n % 10 > 0, F.get(small, (n % 10).cast("int")))))
    return table(spark, sf_dir, "orders").select(k, F.concat(name(k % 90 + 1), F.lit(" Thousand "), name(k % 9 + 1), F.lit(" hundred and "), name(k % 99 + 1), F.lit(" Riyals and "), name(k % 60 + 1), F.lit(" Halalas only")).alias("text"))


@query("SELECT o_orderkey, ((o_orderkey % 90 + 1) * 1000 + (o_orderkey % 9 + 1) * 100 + o_orderkey % 99 + 1) * 100 + o_orderkey % 60 + 1 AS hundredths FROM orders")
def amount_in_words_en(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spelt(spark, sf_dir).select("o_orderkey", english_amount("text").alias("hundredths"))


@query("SELECT o_orderkey, (CASE o_orderkey % 4 WHEN 0 THEN 1250 WHEN 1 THEN 500 WHEN 2 THEN 2015 ELSE NULL END * 100 + CASE WHEN o_orderkey % 2 = 0 THEN 50 ELSE 0 END)::BIGINT AS hundredths FROM orders")
def amount_in_words_ar(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    whole = F.when(k % 4 == 0, "الف ومائتان وخمسون").when(k % 4 == 1, "خمسمائة").when(k % 4 == 2, "الفان وخمسة عشر").otherwise("كلمة مجهولة خمسة كلمة")
    return table(spark, sf_dir, "orders").select(k, arabic_amount(F.concat(whole, F.lit(" ريال سعودي"), F.when(k % 2 == 0, " و خمسون هللة").otherwise(" فقط لا غير"))).alias("hundredths"))
