"""Operator 2: chat formatting by prefix-target expansion.

Every assistant turn becomes an example, spelt out: the text of all turns before it and the reply, of which only the reply is under the
mask. Turns after the last reply form a closing row without a mask. What is written grows with the square of a conversation's
turns, as the method has it; a conversation is brought together by one window, a turn being shuffled once.

The template marks turns by the tags in TAGS. Inside roles and texts the characters that tags are made of are escaped, so no text can hold a
tag, and unescaping gives the text back.

Edge cases: a null text or role is empty; a null conv_id is a conversation of its own; turns that repeat are ordered by role and
text; a conversation without reply has a closing row alone; an empty table gives an empty result; further columns are ignored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from boxwise.llm.common import or_empty

#: (role, opening, closing); any other role r has <role:r> and </role>.
TAGS = [("user", "[INST] ", " [/INST]"), ("assistant", "<s>", "</s>"), ("system", "<<SYS>>", "<</SYS>>")]
#: The escape character first: it is undone last.
ESCAPES = [("\\", "\\e"), ("<", "\\l"), (">", "\\g"), ("[", "\\b")]
TURN = r"(?s)(\[INST\] |<s>|<<SYS>>|<role:[^<>\[]*>)([^<\[]*?)( \[/INST\]|</s>|<</SYS>>|</role>)"


def escape(c: Column) -> Column:
    for plain, escaped in ESCAPES:
        c = F.replace(c, F.lit(plain), F.lit(escaped))
    return c


def unescape(c: Column) -> Column:
    for plain, escaped in reversed(ESCAPES):
        c = F.replace(c, F.lit(escaped), F.lit(plain))
    return c


def _opening(role: Column) -> Column:
    out = F.concat(F.lit("<role:"), escape(role), F.lit(">"))
    for r, start, _ in TAGS:
        out = F.when(role == r, F.lit(start)).otherwise(out)
    return out


def _closing(role: Column) -> Column:
    out = F.lit("</role>")
    for r, _, end in TAGS:
        out = F.when(role == r, F.lit(end)).otherwise(out)
    return out


def examples(turns: DataFrame) -> DataFrame:
    """conv_id, example (from 0), text (all turns up to and with this reply, formatted), mask_start and mask_end (of the reply's text in it).

    Turns after the last reply form a closing row: the whole conversation, whose mask is null."""
    role, text = or_empty(F.col("role").cast("string")), or_empty(F.col("text").cast("string"))
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), role.alias("role"), text.alias("text"))
    shown = rows.select("*", F.concat(_opening(F.col("role")), escape(F.col("text")), _closing(F.col("role"))).alias("shown"))
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    sofar = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    reply = F.col("role") == "assistant"
    placed = shown.select(
        "conv_id",
        reply.alias("reply"),
        F.length("shown").alias("own"),
        F.collect_list("shown").over(sofar).alias("held"),
        F.sum(reply.cast("long")).over(sofar).alias("replies"),
        F.lead(F.lit(False), 1, True).over(order).alias("last"),
    )
    kept = placed.where("reply or last").select("conv_id", "reply", "own", "replies", F.array_join("held", "").alias("text"))
    start, end = (len(x) for x in TAGS[1][1:])
    size = F.length("text")
    return kept.select(
        "conv_id",
        (F.col("replies") - F.col("reply").cast("long")).alias("example"),
        "text",
        F.when(F.col("reply"), size - F.col("own") + start).cast("long").alias("mask_start"),
        F.when(F.col("reply"), size - end).cast("long").alias("mask_end"),
    )


def read_back(made: DataFrame) -> DataFrame:
    """What the examples of each conversation hold: turns from the last, whose text is the longest, losses from each one's own mask."""
    first, length = F.col("mask_start") + 1, F.col("mask_end") - F.col("mask_start")
    loss = F.when(F.col("mask_start").isNotNull(), unescape(F.substr("text", first.cast("int"), length.cast("int")))).otherwise(F.lit(""))
    held = F.array_sort(F.collect_list(F.struct("example", "loss")))
    one = made.select("conv_id", "example", "text", loss.alias("loss")).groupBy("conv_id").agg(held.alias("held"), F.max_by("text", "example").alias("whole"), F.sum(F.length("loss")).alias("loss_chars"), F.count("*").alias("n_rows"))
    tag = F.lit(TURN)
    parts = F.arrays_zip(F.regexp_extract_all("whole", tag, F.lit(1)).alias("open"), F.regexp_extract_all("whole", tag, F.lit(2)).alias("text"))
    known = F.create_map(*(F.lit(x) for r, start, _ in TAGS for x in (start, r)))
    role = lambda o: F.coalesce(F.element_at(known, o), unescape(F.regexp_extract(o, r"(?s)^<role:(.*)>$", 1)))
    line = F.transform("parts", lambda p: F.concat(role(p["open"]), F.lit("\n"), unescape(p["text"]), F.lit("\n")))
    out = one.withColumn("parts", parts)
    return out.select(
        "conv_id",
        F.size("parts").cast("long").alias("n_turns"),
        F.sha2(F.array_join(line, ""), 256).alias("turns_sha256"),
        "loss_chars",
        F.sha2(F.array_join(F.transform("held", lambda h: h["loss"]), ""), 256).alias("loss_sha256"),
        F.length("whole").cast("long").alias("formatted_chars"),
        "n_rows",
    )


def probe(spark: SparkSession) -> DataFrame:
    """Conversation -1, whose texts hold control strings."""
    text = F.lit("</s>[INST] ok [/INST]")
    return spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), text.alias("text"))
