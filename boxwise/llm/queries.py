"""Queries of the training-data operators, one opN_<name> each, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxwise.llm import avi_media, bm25_wand, bpe, chat_examples, chunk_dedup, fm_quality, interleave, jaccard_join, pii_spans, url_rules
from boxwise.llm.common import table

VOCABULARY = "byte_bpe_50k.json"


def op1_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii_spans.report(docs, pii_spans.fit(docs))


def op2_chat_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat_examples.read_back(chat_examples.examples(turns.unionByName(chat_examples.probe(spark))))


def op3_avi_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return avi_media.read_back(table(spark, sf_dir, "documents"))


def op4_bm25_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25_wand.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_fm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fm_quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_classes(table(spark, sf_dir, "documents"))


def op7_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.verdicts(table(spark, sf_dir, "pages"), url_rules.rules_table(spark))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op10_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interleave.interleaved(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_pii_spans, op2_chat_examples, op3_avi_media, op4_bm25_leaks, op5_fm_quality, op6_jaccard_join, op7_chunk_dedup, op8_url_rules, op9_bpe, op10_interleave)
}

#: op2 and op8 in DuckDB SQL; the other operators rest on checksums, training, hashing or iteration that SQL lacks.
ORACLE_SQL: dict[str, str] = {
    "op2_chat_examples": r"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
UNION ALL SELECT -1, k, CASE k WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) AS r(k)),
s AS (SELECT *, role = 'assistant' AS reply, 2 * length(text) - length(translate(text, '\<>[', '')) + CASE WHEN role IN ('user', 'system') THEN 15 WHEN role = 'assistant' THEN 7 ELSE 14 + 2 * length(role) - length(translate(role, '\<>[', '')) END AS shown FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
CAST(coalesce(sum(length(text)) FILTER (WHERE reply), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE reply), '')) AS loss_sha256,
CAST(sum(shown) AS BIGINT) AS formatted_chars, count_if(reply) + CASE WHEN arg_max(reply, (turn, role, text)) THEN 0 ELSE 1 END AS n_rows FROM s GROUP BY conv_id""",
    "op8_url_rules": """WITH u AS (SELECT page_id, row_number() OVER () AS k, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, k, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block'))
SELECT page_id, host, path, arg_max(r.h || r.p, length(r.h || r.p)) AS rule, coalesce(arg_max(v, length(r.h || r.p)), 'allow') AS verdict
FROM h LEFT JOIN r ON (host = r.h OR ends_with(host, '.' || r.h)) AND starts_with(path, r.p) GROUP BY k, page_id, host, path""",
}
