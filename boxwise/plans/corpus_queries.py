"""Corpus reports: quotas, attempts, deltas, splits, integrity, resumption."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from boxwise.functions.scalars import money, number, numeric
from boxwise.operators.corpus import hash_split, quota, unfinished
from boxwise.plans.registry import query
from boxwise.sources.tables import table


@query("""SELECT event_type, event_id, rank FROM (SELECT event_type, event_id, CAST(row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS INT) AS rank FROM events) WHERE rank <= 14""")
def topk_with_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quota(table(spark, sf_dir, "events"), ["event_type"], [F.desc("value"), F.asc("event_id")], 14).select("event_type", "event_id", "rank")


@query("""SELECT user_id, count(*) AS attempts, count_if(event_type = 'purchase') AS accepted, count_if(value > 50) AS retries, CAST(sum(CASE WHEN event_type = 'click' THEN CAST(round(value * 100) AS BIGINT) ELSE 0 END) AS BIGINT) AS click_cents, max(event_id) AS last_event FROM events GROUP BY user_id""")
def attempt_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = F.round(F.col("value") * 100).cast("long")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("attempts"), F.count_if(F.col("event_type") == "purchase").alias("accepted"), F.count_if(F.col("value") > 50).alias("retries"), F.sum(F.when(F.col("event_type") == "click", cents).otherwise(0)).alias("click_cents"), F.max("event_id").alias("last_event"))


@query("""WITH r AS (SELECT event_type, user_id % 10 AS setting, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY 1, 2)
SELECT event_type, setting, n, cents, n - first_value(n) OVER w AS n_delta, cents - first_value(cents) OVER w AS cents_delta, CAST(row_number() OVER (PARTITION BY event_type ORDER BY n DESC, cents DESC, setting) AS INT) AS rank FROM r WINDOW w AS (PARTITION BY event_type ORDER BY setting)""")
def baseline_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each setting against the lowest of its group, and its rank."""
    r = table(spark, sf_dir, "events").groupBy("event_type", (F.col("user_id") % 10).alias("setting")).agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))
    w = W.partitionBy("event_type").orderBy("setting")
    rank = F.row_number().over(W.partitionBy("event_type").orderBy(F.desc("n"), F.desc("cents"), "setting"))
    return r.select("event_type", "setting", "n", "cents", (F.col("n") - F.first("n").over(w)).alias("n_delta"), (F.col("cents") - F.first("cents").over(w)).alias("cents_delta"), rank.alias("rank"))


@query("""SELECT CASE WHEN quality = 0 AND doc_id % 3 > 0 THEN 'fixed' WHEN quality = 1 AND doc_id % 5 = 0 THEN 'regressed' ELSE 'same' END AS outcome, count(*) AS n, min(doc_id) AS first_id FROM labels GROUP BY 1""")
def outcome_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes before and after, joined on their test."""
    labels = table(spark, sf_dir, "labels")
    before = labels.select("doc_id", (F.col("quality") == 1).alias("before"))
    k = F.col("doc_id")
    after = labels.select("doc_id", F.when(F.col("quality") == 0, k % 3 > 0).otherwise(k % 5 != 0).alias("after"))
    m = before.join(after, "doc_id").select("doc_id", F.when(~F.col("before") & F.col("after"), "fixed").when(F.col("before") & ~F.col("after"), "regressed").otherwise("same").alias("outcome"))
    return m.groupBy("outcome").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


BUCKETS = ["PARSER_ROW", "PARSER_COLUMN", "OCR_CHAR_ERROR", "OCR_MISSING", "ARITHMETIC_INCONSISTENT", "VISION_OVERRIDE", "UNRESOLVED"]


@query("""WITH dom AS (SELECT unnest(['PARSER_ROW', 'PARSER_COLUMN', 'OCR_CHAR_ERROR', 'OCR_MISSING', 'ARITHMETIC_INCONSISTENT', 'VISION_OVERRIDE', 'UNRESOLVED']) AS bucket),
t AS (SELECT CASE WHEN toxic = 1 AND quality = 0 THEN 'PARSER_ROW' WHEN toxic = 1 THEN 'PARSER_COLUMN' WHEN quality = 0 AND doc_id % 2 = 0 THEN 'OCR_CHAR_ERROR' WHEN quality = 0 THEN 'ARITHMETIC_INCONSISTENT' ELSE 'UNRESOLVED' END AS bucket FROM labels)
SELECT dom.bucket, count(t.bucket) AS n FROM dom LEFT JOIN t ON t.bucket = dom.bucket GROUP BY 1""")
def error_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts over a fixed domain; buckets without a case keep their zero. Rows are counted before they meet the domain."""
    bad = F.col("quality") == 0
    toxic = F.col("toxic") == 1
    bucket = F.when(toxic & bad, "PARSER_ROW").when(toxic, "PARSER_COLUMN").when(bad & (F.col("doc_id") % 2 == 0), "OCR_CHAR_ERROR").when(bad, "ARITHMETIC_INCONSISTENT").otherwise("UNRESOLVED")
    got = table(spark, sf_dir, "labels").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("c"))
    domain = spark.range(1).select(F.explode(F.array(*map(F.lit, BUCKETS))).alias("bucket"))
    return domain.join(got, "bucket", "left").select("bucket", F.coalesce("c", F.lit(0).cast("long")).alias("n"))


@query("""WITH g AS (SELECT DISTINCT p_brand FROM part), r AS (SELECT p_brand, row_number() OVER (ORDER BY sha256('invoice-v1:' || p_brand)) AS k, count(*) OVER () AS n FROM g)
SELECT p_brand, CASE WHEN k <= greatest(1, round_even(n * 0.15, 0)) THEN 'test' WHEN k <= 2 * greatest(1, round_even(n * 0.15, 0)) THEN 'validation' ELSE 'train' END AS split FROM r""")
def hash_split_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_split(table(spark, sf_dir, "part").select("p_brand").distinct(), "p_brand")


@query("""SELECT count(*) AS documents, count(DISTINCT sha256(text)) AS hashes, count_if(length(text) > 0) AS with_text, count(DISTINCT source) AS sources, count(*) = count(DISTINCT doc_id) AS unique_ids, (SELECT count(*) FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id)) AS orphans FROM documents""")
def integrity_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    orphans = table(spark, sf_dir, "labels").join(d.select("doc_id"), "doc_id", "left_anti").agg(F.count("*").alias("orphans"))
    # each distinct count by its own grouping, whose partial step meets repeats first
    hashes = d.select(F.sha2("text", 256).alias("h")).distinct().agg(F.count("*").alias("hashes"))
    sources = d.select("source").distinct().agg(F.count("*").alias("sources"))
    ids = d.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(F.length("text") > 0).alias("t")).agg(F.sum("n").alias("documents"), F.count("*").alias("ids"), F.sum("t").alias("with_text"))
    one = ids.withColumn("k", F.lit(1))
    for other in (hashes, sources, orphans):
        one = one.join(other.withColumn("k", F.lit(1)), "k")
    return one.select("documents", "hashes", "with_text", "sources", (F.col("documents") == F.col("ids")).alias("unique_ids"), "orphans")


@query("""WITH s AS (SELECT doc_id, sha256(text) AS sha, lang FROM documents), done AS (SELECT sha256(text) AS sha, lang FROM documents WHERE doc_id % 3 = 0 AND NOT doc_id % 12 = 0) SELECT doc_id, sha, lang FROM s WHERE NOT EXISTS (SELECT 1 FROM done WHERE done.sha = s.sha AND done.lang = s.lang)""")
def signature_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources still to do: no complete record of the same content and language, or one to be tried again."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha"), "lang")
    k = F.col("doc_id")
    done = d.where(k % 3 == 0).select("sha", "lang", F.lit(True).alias("complete"), (k % 12 == 0).alias("retryable"))
    return unfinished(d, done, ["sha", "lang"]).select("doc_id", "sha", "lang")


@query("""WITH o AS (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS c FROM orders), s AS (SELECT o_orderkey, (c // 100) || '.' || lpad((c % 100)::VARCHAR, 2, '0') AS plain FROM o)
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 2 THEN NULL ELSE plain END AS numeric_text, CASE WHEN o_orderkey % 4 IN (1, 2) THEN NULL ELSE plain END AS money_text, CASE o_orderkey % 4 WHEN 3 THEN NULL WHEN 1 THEN NULL ELSE plain END AS number_text FROM s""")
def number_normalizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One amount printed four ways (plain, thousands commas, per cent, currency after) and read by three rules."""
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    o = table(spark, sf_dir, "orders").select("o_orderkey", cents.alias("c"))
    plain = F.concat(F.expr("c div 100").cast("string"), F.lit("."), F.lpad((F.col("c") % 100).cast("string"), 2, "0"))
    comma = F.concat(F.format_number(F.expr("c div 100"), 0), F.lit("."), F.lpad((F.col("c") % 100).cast("string"), 2, "0"))
    k = F.col("o_orderkey") % 4
    shown = F.when(k == 0, plain).when(k == 1, comma).when(k == 2, F.concat(plain, F.lit("%"))).otherwise(F.concat(plain, F.lit(" SAR")))
    text = lambda c: F.format_string("%s", c.cast("decimal(18,2)").cast("string"))
    rows = o.withColumn("shown", shown).select("o_orderkey", numeric(F.col("shown")).alias("a"), money(F.col("shown")).alias("b"), number(F.col("shown")).alias("d"))
    return rows.select("o_orderkey", *(F.when(F.col(c).isNotNull(), text(F.col(c))).alias(n) for c, n in (("a", "numeric_text"), ("b", "money_text"), ("d", "number_text"))))
