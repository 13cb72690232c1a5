"""Whole-document validation, totals repair, audits and error attribution over orders and their rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boxwise.operators.checks import complete_sum, missing
from boxwise.operators.validation import fill_totals, item_checks, near, total_checks, total_status
from boxwise.plans.check_queries import ITEMS, items
from boxwise.plans.registry import query

HALF_UP = "sign({x}) * ((abs({x}) * 2 + 100) // 200)"
ROW = f""", r AS (SELECT *, CASE WHEN q IS NULL OR p IS NULL OR a IS NULL THEN 'unresolved' WHEN abs(q * p - a) <= 2 AND coalesce(abs(a + v - g) <= 2, true) THEN 'direct' WHEN abs(p - a) <= 2 AND abs(q * (a + v) - g) <= 2 THEN 'per_unit' ELSE 'mismatch' END AS mode,
 abs({HALF_UP.format(x="(a * t)")} - v) <= 2 AS rate_valid FROM items),
rows_ AS (SELECT *, mode IN ('direct', 'per_unit') AND coalesce(rate_valid, true) AS valid, CASE WHEN mode = 'per_unit' THEN q * a ELSE a END AS ea, CASE WHEN mode = 'per_unit' THEN q * v ELSE v END AS ev FROM r),
tot AS (SELECT l_orderkey AS k, count(*) AS n, count(ea) AS na, CAST(sum(ea) AS BIGINT) AS sa, count(ev) AS nt, CAST(sum(ev) AS BIGINT) AS st, count_if(valid) AS nv, count_if(coalesce(rate_valid, false)) AS nr, CASE WHEN min(t) = max(t) THEN max(t) END AS t1,
 CAST(sum(e) AS BIGINT) AS se, CAST(sum(v) AS BIGINT) AS sv, count_if(q IS NULL) AS gq, count_if(p IS NULL) AS gp, count_if(a IS NULL) AS ga FROM rows_ GROUP BY 1),
doc AS (SELECT *, CASE WHEN k % 6 <> 0 THEN se + CASE WHEN k % 4 = 1 THEN 30 ELSE 0 END END AS subtotal, CASE WHEN k % 8 = 1 THEN 30 END AS discount, CASE k % 3 WHEN 1 THEN se WHEN 2 THEN se + CASE WHEN k % 5 = 0 THEN 50 ELSE 0 END END AS taxable,
 CASE WHEN k % 2 = 0 THEN t1 END AS rate, CASE WHEN k % 7 <> 0 THEN sv + CASE WHEN k % 9 = 1 THEN 1 ELSE 0 END END AS vat, CASE WHEN k % 10 = 3 THEN 100 END AS other, CASE WHEN k % 11 <> 0 THEN se + sv + CASE WHEN k % 10 = 3 THEN 100 ELSE 0 END END AS net FROM tot)
"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an order: sums over its rows and totals as printed by rule."""
    c, k = F.col, F.col("k")
    rows = items(spark, sf_dir).withColumnRenamed("l_orderkey", "k")
    rows = rows.withColumns(item_checks(c("q"), c("p"), c("a"), c("v"), c("g"), F.lit(None).cast("long"), c("t")))
    got = rows.groupBy("k").agg(
        F.count("*").alias("n"), F.count("effective").alias("n_amounts"), F.sum("effective").alias("amount_sum"), F.count("effective_vat").alias("n_taxes"), F.sum("effective_vat").alias("tax_sum"),
        F.count_if("valid").alias("n_valid"), F.count_if("rate_valid").alias("n_rates_valid"), F.min("t").alias("t0"), F.max("t").alias("t1"), F.sum("e").alias("se"), F.sum("v").alias("sv"),
        F.count_if(c("q").isNull()).alias("no_quantity"), F.count_if(c("p").isNull()).alias("no_price"), F.count_if(c("a").isNull()).alias("no_amount"),
    )
    add = lambda when, n: F.when(when, n).otherwise(0)
    return got.withColumns(
        {
            "subtotal": F.when(k % 6 != 0, c("se") + add(k % 4 == 1, 30)),
            "discount": F.when(k % 8 == 1, F.lit(30).cast("long")),
            "taxable": F.when(k % 3 == 1, c("se")).when(k % 3 == 2, c("se") + add(k % 5 == 0, 50)),
            "rate": F.when((k % 2 == 0) & (c("t0") == c("t1")), c("t1")),
            "vat": F.when(k % 7 != 0, c("sv") + add(k % 9 == 1, 1)),
            "other": F.when(k % 10 == 3, F.lit(100).cast("long")),
            "net": F.when(k % 11 != 0, c("se") + c("sv") + add(k % 10 == 3, 100)),
        }
    )


def _columns(names: str) -> dict[str, Column]:
    return {n: F.col(n) for n in names.split()}


@query(ITEMS + ROW + f""", f AS (SELECT *, subtotal - coalesce(discount, 0) AS want, coalesce(taxable, subtotal - coalesce(discount, 0)) AS base FROM doc),
w AS (SELECT *, CASE WHEN rate IS NULL AND nt = n AND nr = n THEN st ELSE CAST({HALF_UP.format(x="(base * rate)")} AS BIGINT) END AS vat_expected, base + vat + coalesce(other, 0) AS net_expected FROM f),
z AS (SELECT k, n, nv = n AS items_valid, coalesce(na = n AND abs(sa - subtotal) <= 2, false) AS subtotal_valid, abs(taxable - want) <= 2 AS taxable_valid, vat_expected, coalesce(abs(vat_expected - vat) <= 2, false) AS vat_valid, net_expected,
 coalesce(abs(net_expected - net) <= 2, false) AS net_valid, CASE WHEN nt = n THEN st = vat END AS line_vat_matches,
 concat_ws(',', CASE WHEN subtotal IS NULL THEN 'totals.subtotal' END, CASE WHEN vat IS NULL THEN 'totals.vat_amount' END, CASE WHEN net IS NULL THEN 'totals.net_amount' END) AS missing, CAST(gq + gp + ga AS BIGINT) AS item_gaps FROM w)
SELECT k AS l_orderkey, n, items_valid, subtotal_valid, taxable_valid, vat_expected, vat_valid, net_expected, net_valid, line_vat_matches, missing, item_gaps,
 NOT (items_valid AND subtotal_valid AND vat_valid AND net_valid AND coalesce(line_vat_matches, true) AND coalesce(taxable_valid, true) AND missing = '' AND item_gaps = 0) AS needs_review FROM z""")
def invoice_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All checks of a document: rows with their rate, subtotal, tax base, tax (by rows where rates are mixed), net, tax to the cent, gaps."""
    got = documents(spark, sf_dir)
    checks = total_checks(_columns("subtotal discount taxable rate vat other net n n_amounts amount_sum n_taxes tax_sum n_valid n_rates_valid"))
    gone = missing(**{f"totals.{n}": F.col(c) for n, c in (("subtotal", "subtotal"), ("vat_amount", "vat"), ("net_amount", "net"))})
    gaps = F.col("no_quantity") + F.col("no_price") + F.col("no_amount")
    rows = got.select("*", *(c.alias(f"is_{n}") for n, c in checks.items()), gone.alias("missing"), gaps.alias("item_gaps"))
    shown = ["items_valid", "subtotal_valid", "taxable_valid", "vat_expected", "vat_valid", "net_expected", "net_valid", "line_vat_matches"]
    review = ~(F.col("is_checks_hold") & (F.col("missing") == "") & (F.col("item_gaps") == 0))
    return rows.select(F.col("k").alias("l_orderkey"), "n", *(F.col(f"is_{c}").alias(c) for c in shown), "missing", "item_gaps", review.alias("needs_review"))


CENTS = """CASE WHEN NOT coalesce({whole} AND {actual} IS NOT NULL, false) THEN 'unresolved' WHEN {fits} THEN 'ok' WHEN {last} IS NULL THEN 'unresolved' ELSE 'mismatch' END"""


def _fits(actual: str, *sums: str) -> str:
    return " OR ".join(f"coalesce(abs({actual} - {s}) <= 5, false)" for s in sums)


@query(ITEMS + """, i AS (SELECT *, CASE WHEN n % 3 = 0 THEN 100 WHEN n % 3 = 1 AND l_orderkey % 17 <> 0 THEN 0 END AS disc FROM items),
x AS (SELECT l_orderkey AS k, count(*) AS n, count_if(coalesce(abs(a - CASE WHEN abs(a - (q * p - disc)) > 5 AND abs(a - p) <= 5 THEN a ELSE q * p - disc END) > 5, false)) AS taxable_wrong, count_if(coalesce(abs(v * 100 - a * t) > 500, false)) AS tax_wrong,
 count_if(NOT (abs(g - a - v) <= 5 OR coalesce(abs(g - q * a - v) <= 5, false) OR coalesce(abs(g - q * (a + v)) <= 5, false)) AND q IS NOT NULL AND a IS NOT NULL) AS gross_wrong, count_if(coalesce(abs(g - a - v) > 5 AND q IS NULL, false)) AS gross_open,
 count(a) = count(*) AS ca, count(disc) = count(*) AS cd, count(q) = count(*) AND count(p) = count(*) AS cp, CAST(sum(a) AS BIGINT) AS sa, CAST(sum(v) AS BIGINT) AS sv, CAST(sum(g) AS BIGINT) AS sg, CAST(sum(disc) AS BIGINT) AS sd, CAST(sum(q * p) AS BIGINT) AS sqp,
 CASE WHEN count(q * a) = count(*) THEN CAST(sum(q * a) AS BIGINT) END AS sqa, CASE WHEN count(q) = count(*) THEN CAST(sum(q * v) AS BIGINT) END AS sqv, CASE WHEN count(q * a) = count(*) THEN CAST(sum(q * a + v) AS BIGINT) END AS sqg, CAST(sum(e) AS BIGINT) AS se FROM i GROUP BY 1),
d AS (SELECT *, CASE WHEN k % 6 <> 0 THEN CASE WHEN k % 4 = 0 THEN sqa ELSE se END END AS taxable, CASE WHEN k % 4 = 1 THEN sqv ELSE sv + CASE WHEN k % 12 = 2 THEN 80 ELSE 0 END END AS vat, CASE WHEN k % 5 = 0 THEN sqg ELSE sg END AS gross, sqp + CASE WHEN k % 9 = 0 THEN 60 ELSE 0 END AS excl, CASE WHEN k % 2 = 0 THEN coalesce(sd, 0) ELSE 10 END AS disc FROM x)
SELECT k AS l_orderkey, n, taxable_wrong, tax_wrong, gross_wrong, gross_open, """
+ CENTS.format(whole="ca", actual="taxable", fits=_fits("taxable", "sa", "sqa"), last="sqa") + " AS taxable, " + CENTS.format(whole="true", actual="vat", fits=_fits("vat", "sv", "sqv"), last="sqv") + " AS vat, "
+ CENTS.format(whole="true", actual="gross", fits=_fits("gross", "sg", "sqg"), last="sqg") + " AS gross, " + "CASE WHEN k % 3 = 0 THEN 'absent' ELSE " + CENTS.format(whole="cp", actual="excl", fits=_fits("excl", "sqp"), last="sqp") + " END AS excluding, "
+ CENTS.format(whole="cd", actual="disc", fits=_fits("disc", "sd"), last="sd") + " AS discount FROM d")
def document_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and totals in both printed conventions (per unit and extended); a total whose key is absent isn't checked, a null operand leaves
    it undecided."""
    c, k = F.col, F.col("k")
    n = c("n")
    i = items(spark, sf_dir).withColumnRenamed("l_orderkey", "k").withColumn("disc", F.when(n % 3 == 0, 100).when((n % 3 == 1) & (k % 17 != 0), 0).cast("long"))
    base = c("q") * c("p") - c("disc")
    wanted = F.when((F.abs(c("a") - base) > 5) & near(c("a"), c("p"), 5), c("a")).otherwise(base)
    flat = near(c("g"), c("a") + c("v"), 5)
    by_unit = F.coalesce(near(c("g"), c("q") * c("a") + c("v"), 5), F.lit(False)) | F.coalesce(near(c("g"), c("q") * (c("a") + c("v")), 5), F.lit(False))
    full = lambda x: F.when(F.count(x) == F.count("*"), F.sum(x))
    x = i.groupBy("k").agg(
        F.count("*").alias("n"), F.count_if(F.abs(c("a") - wanted) > 5).alias("taxable_wrong"), F.count_if(F.abs(c("v") * 100 - c("a") * c("t")) > 500).alias("tax_wrong"),
        F.count_if(~(flat | by_unit) & c("q").isNotNull() & c("a").isNotNull()).alias("gross_wrong"), F.count_if(~flat & c("q").isNull()).alias("gross_open"),
        (F.count("a") == F.count("*")).alias("ca"), (F.count("disc") == F.count("*")).alias("cd"), ((F.count("q") == F.count("*")) & (F.count("p") == F.count("*"))).alias("cp"),
        F.sum("a").alias("sa"), F.sum("v").alias("sv"), F.sum("g").alias("sg"), F.sum("disc").alias("sd"), F.sum(c("q") * c("p")).alias("sqp"),
        full(c("q") * c("a")).alias("sqa"), full(c("q") * c("v")).alias("sqv"), full(c("q") * c("a") + c("v")).alias("sqg"), F.sum("e").alias("se"),
    )
    yes = F.lit(True)
    taxable = F.when(k % 6 != 0, F.when(k % 4 == 0, c("sqa")).otherwise(c("se")))
    vat = F.when(k % 4 == 1, c("sqv")).otherwise(c("sv") + F.when(k % 12 == 2, 80).otherwise(0))
    gross = F.when(k % 5 == 0, c("sqg")).otherwise(c("sg"))
    excl = c("sqp") + F.when(k % 9 == 0, 60).otherwise(0)
    discount = F.when(k % 2 == 0, F.coalesce(c("sd"), F.lit(0).cast("long"))).otherwise(10)
    return x.select(
        k.alias("l_orderkey"), "n", "taxable_wrong", "tax_wrong", "gross_wrong", "gross_open",
        total_status(taxable, c("ca"), [c("sa"), c("sqa")]).alias("taxable"),
        total_status(vat, yes, [c("sv"), c("sqv")]).alias("vat"),
        total_status(gross, yes, [c("sg"), c("sqg")]).alias("gross"),
        F.when(k % 3 == 0, "absent").otherwise(total_status(excl, c("cp"), [c("sqp")])).alias("excluding"),
        total_status(discount, c("cd"), [c("sd")]).alias("discount"),
    )


@query(ITEMS + ROW + """, g AS (SELECT k, CASE WHEN na = n THEN sa END AS asum, CASE WHEN nt = n THEN st END AS tsum, coalesce(discount, 0) AS d, coalesce(other, 0) AS o, CASE WHEN min_t = t1 THEN t1 END AS rate, se, sv,
 CASE k % 8 WHEN 0 THEN NULL WHEN 3 THEN NULL WHEN 4 THEN NULL WHEN 5 THEN NULL ELSE se END AS s, CASE k % 8 WHEN 1 THEN NULL WHEN 3 THEN NULL WHEN 5 THEN NULL ELSE sv END AS v, CASE k % 8 WHEN 2 THEN NULL WHEN 3 THEN NULL WHEN 4 THEN NULL WHEN 5 THEN NULL WHEN 6 THEN NULL ELSE se - coalesce(discount, 0) + sv + coalesce(other, 0) END AS n
 FROM (SELECT *, t1 AS min_t FROM doc)),
amounts AS (SELECT *, list_filter([{'k': 1, 'a': CASE WHEN k % 3 <> 0 THEN se END}, {'k': 2, 'a': CASE WHEN k % 5 <> 0 THEN sv END}, {'k': 3, 'a': se - d + sv + o + k % 2}, {'k': 4, 'a': CASE WHEN k % 9 = 4 THEN sa_ END}], lambda x: x.a IS NOT NULL) AS pr,
 list_filter([{'k': 1, 'a': asum}, {'k': 2, 'a': tsum}, {'k': 3, 'a': CASE WHEN k % 13 <> 3 THEN asum + tsum END}], lambda x: x.a IS NOT NULL) AS ft FROM (SELECT *, asum + 1 AS sa_ FROM g)),
c AS (SELECT *, list_filter(pr, lambda x: abs(x.a - (n - v - o + d)) <= 1)[1].a AS f_s, list_filter(pr, lambda x: abs(x.a - (s - d + v + o)) <= 1)[1].a AS f_n, list_filter(pr, lambda x: abs(x.a - (n - s + d - o)) <= 1)[1].a AS f_v,
 list_filter(ft, lambda x: abs(x.a - asum) <= 1)[1] AS u1, list_filter(pr, lambda x: abs(x.a - asum) <= 1)[1] AS b1 FROM amounts),
c2 AS (SELECT *, list_filter(ft, lambda x: abs(x.a - tsum) <= 1 AND x.k IS DISTINCT FROM u1.k)[1] AS u2, list_filter(pr, lambda x: abs(x.a - (asum - d + v + o)) <= 1 AND x.k IS DISTINCT FROM b1.k)[1] AS b2,
 list_filter(list_transform(pr, lambda x: {'s': x, 'n': list_filter(pr, lambda y: abs(y.a - (x.a - d + v + o)) <= 1 AND y.k <> x.k)[1]}), lambda z: z.s.a <> 0 AND abs((z.s.a - d) * rate - v * 100) <= 100 AND z.n IS NOT NULL)[1] AS br FROM c),
c3 AS (SELECT *, list_filter(ft, lambda x: abs(x.a - (asum + tsum)) <= 1 AND x.k IS DISTINCT FROM u1.k AND x.k IS DISTINCT FROM u2.k)[1] AS u3 FROM c2)
SELECT k AS l_orderkey, CASE WHEN s IS NULL AND v IS NOT NULL AND n IS NOT NULL THEN 'subtotal' WHEN n IS NULL AND s IS NOT NULL AND v IS NOT NULL THEN 'net' WHEN v IS NULL AND s IS NOT NULL AND n IS NOT NULL THEN 'vat' WHEN s IS NULL AND v IS NULL AND n IS NULL THEN 'all' WHEN s IS NULL AND n IS NULL THEN 'two' ELSE 'none' END AS gap,
 CASE WHEN s IS NULL AND v IS NOT NULL AND n IS NOT NULL THEN f_s WHEN s IS NULL AND v IS NULL AND n IS NULL THEN CASE WHEN u1 IS NOT NULL AND u2 IS NOT NULL AND u3 IS NOT NULL AND tsum > 0 THEN u1.a END WHEN v IS NOT NULL AND s IS NULL AND n IS NULL THEN CASE WHEN b1 IS NOT NULL AND b2 IS NOT NULL THEN b1.a WHEN br IS NOT NULL AND rate <> 0 THEN br.s.a END END AS subtotal,
 CASE WHEN v IS NULL AND s IS NOT NULL AND n IS NOT NULL THEN f_v WHEN s IS NULL AND v IS NULL AND n IS NULL AND u1 IS NOT NULL AND u2 IS NOT NULL AND u3 IS NOT NULL AND tsum > 0 THEN u2.a END AS vat,
 CASE WHEN n IS NULL AND s IS NOT NULL AND v IS NOT NULL THEN f_n WHEN s IS NULL AND v IS NULL AND n IS NULL THEN CASE WHEN u1 IS NOT NULL AND u2 IS NOT NULL AND u3 IS NOT NULL AND tsum > 0 THEN u3.a END WHEN v IS NOT NULL AND s IS NULL AND n IS NULL THEN CASE WHEN b1 IS NOT NULL AND b2 IS NOT NULL THEN b2.a WHEN br IS NOT NULL AND rate <> 0 THEN br.n.a END END AS net FROM c3""")
def totals_from_print(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each pattern of missing totals, filled from printed amounts alone: one gap, all three without labels, or all but the tax."""
    c, k = F.col, F.col("k")
    zero = lambda x: F.coalesce(c(x), F.lit(0).cast("long"))
    whole_sum = lambda x, n: F.when(c(n) == c("n"), c(x))
    got = documents(spark, sf_dir).select(k, whole_sum("amount_sum", "n_amounts").alias("amount_sum"), whole_sum("tax_sum", "n_taxes").alias("tax_sum"), zero("discount").alias("discount"), zero("other").alias("other"), F.when(c("t0") == c("t1"), c("t1")).alias("rate"), "se", "sv")
    full = c("se") - c("discount") + c("sv") + c("other")
    got = got.withColumns({"subtotal": F.when(~(k % 8).isin(0, 3, 4, 5), c("se")), "vat": F.when(~(k % 8).isin(1, 3, 5), c("sv")), "net": F.when(~(k % 8).isin(2, 3, 4, 5, 6), full)})
    listed = lambda *amounts: F.filter(F.array(*(F.struct(F.lit(n).alias("k"), a.alias("amount")) for n, a in enumerate(amounts, 1))), lambda x: x["amount"].isNotNull())
    printed = listed(F.when(k % 3 != 0, c("se")), F.when(k % 5 != 0, c("sv")), full + k % 2, F.when(k % 9 == 4, c("amount_sum") + 1))
    footer = listed(c("amount_sum"), c("tax_sum"), F.when(k % 13 != 3, c("amount_sum") + c("tax_sum")))
    rows = got.withColumns({"printed": printed, "footer": footer})
    rows = rows.withColumn("f", fill_totals(_columns("subtotal vat net discount other rate amount_sum tax_sum"), c("printed"), c("footer")))
    s, v, n = c("subtotal").isNull(), c("vat").isNull(), c("net").isNull()
    gap = F.when(s & ~v & ~n, "subtotal").when(n & ~s & ~v, "net").when(v & ~s & ~n, "vat").when(s & v & n, "all").when(s & n, "two").otherwise("none")
    return rows.select(k.alias("l_orderkey"), gap.alias("gap"), "f.subtotal", "f.vat", "f.net")


@query(ITEMS + ROW + """, e AS (SELECT l_orderkey AS k, CASE WHEN count(ea) = count(*) THEN CAST(sum(ea) AS BIGINT) END AS s, CASE WHEN count(ev) = count(*) THEN CAST(sum(ev) AS BIGINT) END AS v, CASE WHEN count(g) = count(*) THEN CAST(sum(g) AS BIGINT) END AS g,
 CAST(sum(e) AS BIGINT) AS se, CAST(sum(v) AS BIGINT) AS sv FROM rows_ WHERE l_orderkey % 4 <> 0 OR n <> 2 GROUP BY 1), d AS (SELECT l_orderkey AS k, CAST(sum(e) AS BIGINT) AS ps, CAST(sum(v) AS BIGINT) AS pv, CAST(sum(g) AS BIGINT) AS pg FROM items GROUP BY 1)
SELECT k AS l_orderkey, concat_ws(',', CASE WHEN ps > s + 3 THEN 'subtotal' END, CASE WHEN pv > v + 3 THEN 'VAT' END, CASE WHEN pg > g + 3 THEN 'net total' END) AS reasons FROM e JOIN d USING (k)""")
def missing_row_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed totals that exceed what the recovered rows give, each row by its own convention: rows were lost."""
    c = F.col
    rows = items(spark, sf_dir).withColumns(item_checks(c("q"), c("p"), c("a"), c("v"), c("g"), F.lit(None).cast("long"), c("t")))
    kept = (c("l_orderkey") % 4 != 0) | (c("n") != 2)
    got = rows.where(kept).groupBy("l_orderkey").agg(complete_sum(c("effective")).alias("s"), complete_sum(c("effective_vat")).alias("v"), complete_sum(c("g")).alias("g"))
    printed = rows.groupBy("l_orderkey").agg(F.sum("e").alias("ps"), F.sum("v").alias("pv"), F.sum("g").alias("pg"))
    over = lambda p, r, name: F.when(c(p) > c(r) + 3, F.lit(name))
    return got.join(printed, "l_orderkey").select("l_orderkey", F.concat_ws(",", over("ps", "s", "subtotal"), over("pv", "v", "VAT"), over("pg", "g", "net total")).alias("reasons"))
