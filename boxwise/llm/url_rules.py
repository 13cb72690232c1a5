"""Operator 8: URL filters by hashed host-suffix and path-prefix expressions.

Each URL is expanded into the expressions host suffix + path prefix that a rule could have: suffixes of as many labels, and prefixes of as
many characters, as some rule has. Expressions meet the rules in an equi-join on a short prefix of their SHA-256; full digests and
the expressions themselves confirm, and the longest rule wins. Only one row per URL is shuffled: the expressions of a row are made, joined and
reduced before they leave their task.

Edge cases: a null URL, or one without '://', has an empty host and path and no rule; repeated rows each get their row; equal
long rules can't both fit one URL unless they repeat, then block wins; without any rule every URL gets the default verdict; further
columns are ignored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boxwise.llm.common import small

#: (host, path, verdict)
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
DEFAULT = "allow"
SHORT = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    each = [F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in rules]
    return spark.range(1).select(F.inline(F.array(*each))) if rules else spark.range(0).select(*(F.lit("").alias(c) for c in ("host", "path", "verdict")))


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def verdicts(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, rule, verdict, one row for each row of pages."""
    shapes = rules.agg(F.array_sort(F.collect_set(F.size(F.split("host", r"\.")))).alias("labels"), F.array_sort(F.collect_set(F.length("path"))).alias("lengths")).first()
    host, path = host_and_path(F.col("url").cast("string"))
    rows = pages.select(F.col("page_id").cast("long"), host.alias("host"), path.alias("path")).withColumn("row", F.monotonically_increasing_id())
    if not shapes["labels"]:
        return rows.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    labels = F.split("host", r"\.", -1)
    suffixes = F.array(*(F.when(F.size(labels) >= k, F.array_join(F.slice(labels, -k, k), ".")) for k in shapes["labels"]))
    prefixes = F.array(*(F.when(F.length("path") >= k, F.substring("path", 1, k)) for k in shapes["lengths"]))
    pairs = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.struct(s.alias("s"), p.alias("p")))))
    pairs = F.filter(pairs, lambda x: x["s"].isNotNull() & x["p"].isNotNull())
    made = rows.withColumn("e", F.explode_outer(pairs)).select("row", "page_id", "host", "path", F.concat("e.s", "e.p").alias("expression"))
    made = made.withColumn("digest", F.sha2("expression", 256)).withColumn("short", F.substring("digest", 1, SHORT))
    known = rules.select(F.concat("host", "path").alias("rule"), F.col("verdict").alias("rule_verdict"))
    known = known.withColumn("rule_digest", F.sha2("rule", 256)).withColumn("short", F.substring("rule_digest", 1, SHORT))
    met = made.join(small(known), "short", "left")
    fits = (F.col("digest") == F.col("rule_digest")) & (F.col("expression") == F.col("rule"))
    best = F.max(F.when(fits, F.struct(F.length("rule").alias("n"), F.col("rule_verdict").alias("verdict"), F.col("rule").alias("rule")))).alias("best")
    out = met.groupBy("row", "page_id", "host", "path").agg(best)
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
