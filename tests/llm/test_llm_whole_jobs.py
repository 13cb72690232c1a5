"""The training-data operators do their whole job: counts and placements that an earlier cut would miss."""

import hashlib
import re
from collections import defaultdict

import numpy as np

from pyspark.sql import functions as F

from boxwise.llm import bm25_wand, chat_examples, chunk_dedup, fm_quality, jaccard_join
from boxwise.llm.common import table

DOC = "doc_id long, text string"


# 7
def runs(text: str, n: int = 51) -> list[tuple[bytes, int, int]]:
    data = text.encode()
    at = [(m.start(), m.end()) for m in re.finditer(rb"[^ \n\t\r]+", data)]
    return [(data[a:b], a, b) for (a, _), (_, b) in zip(at, at[n - 1 :])]


def test_every_repeat_of_over_50_words_is_found(spark):
    """Passages of 49 to 70 words at random places, of short and long words and odd gaps, against all runs of 51 words."""
    rng = np.random.default_rng(4)
    letters = list("abcdefghij") + ["é", "ß", "語", "😀"]

    def prose(n, longest):
        words = ("".join(rng.choice(letters, rng.integers(1, longest + 1))) for _ in range(n))
        return "".join(w + g for w, g in zip(words, rng.choice([" ", " ", " ", "\n", "  "], n)))

    rows = []
    for k in range(1500):
        longest = int(rng.choice([1, 3, 9, 14]))
        passage = prose(int(rng.choice([49, 50, 51, 51, 52, 55, 60, 70])), longest)
        rows += [(2 * k + j, prose(rng.integers(0, 60), longest) + passage + prose(rng.integers(0, 60), longest)) for j in (0, 1)]
    rows += [(4000, "a " * 200), (4001, "b " + "a " * 60), (4002, "c " * 50), (4003, "c " * 50)]
    owners = defaultdict(set)
    for i, text in rows:
        for run, _, _ in runs(text):
            owners[run].add(i)
    wanted = {}
    for i, text in rows:
        own = [(min(owners[r]), a, b) for r, a, b in runs(text) if len(owners[r]) > 1]
        if own:
            held = np.zeros(len(text.encode()), bool)
            for _, a, b in own:
                held[a:b] = True
            wanted[i] = (sorted({f for f, _, _ in own}), len(own), int(held.sum()))
    got = {r["doc_id"]: (r["first_doc_ids"], r["n_passages"], r["dup_bytes"]) for r in chunk_dedup.repeated_passages(spark.createDataFrame(rows, DOC)).collect()}
    assert len(wanted) > 2000
    assert got == wanted


# pipeline
def test_one_of_each_class_stays_with_or_without_ids(spark):
    base = [f"w{k}" for k in range(120)]
    near = lambda k: " ".join(["x" * (k + 1), *base])
    other = lambda k: " ".join(["y" * (k + 1), *reversed(base)])
    third = lambda k: " ".join(["z" * (k + 1), *base[::2], *base[1::2]])
    rows = [(k, near(k)) for k in range(10, 50)] + [(None, near(50)), (None, near(51))]
    rows += [(None, other(k)) for k in (0, 1, 1, 2)] + [(-7, third(0)), (-3, third(1)), (5, third(2)), (None, third(0))]
    df = spark.createDataFrame(rows, DOC)
    kept = jaccard_join.keep_one(df).collect()
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == [-7, 10]
    assert [r["text"] in {other(0), other(1), other(2)} for r in kept if r["doc_id"] is None] == [True]
    named = {r["class_id"] for r in jaccard_join.jaccard_classes(df.where("text like 'x%'")).collect()}
    assert named == {10}


def test_rows_without_an_id_are_filtered_like_the_rest(spark, sf_dir):
    docs, labels, benchmark = (table(spark, sf_dir, n) for n in ("documents", "labels", "benchmark"))
    nameless = docs.withColumn("doc_id", F.lit(None).cast(docs.schema["doc_id"].dataType))
    for stage, more in ((fm_quality.keep_good, labels), (bm25_wand.decontaminate, benchmark)):
        wanted = sorted(r["text"] or "" for r in stage(docs, more).select("text").collect())
        both = stage(docs.unionByName(nameless), more)
        assert both.columns == docs.columns
        got = both.select("doc_id", "text").collect()
        assert sorted(r["text"] or "" for r in got if r["doc_id"] is not None) == wanted
        assert sorted(r["text"] or "" for r in got if r["doc_id"] is None) == wanted and len(wanted) < docs.count(), stage


# 2
def test_every_example_holds_its_whole_context(spark):
    turns = [(1, k, ("user", "assistant")[k % 2], f"turn {k} <s>") for k in range(9)]
    made = chat_examples.examples(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    own = sorted(made.collect(), key=lambda r: r["example"])
    shown = [f"[INST] turn {k} \\ls\\g [/INST]" if k % 2 == 0 else f"<s>turn {k} \\ls\\g</s>" for k in range(9)]
    assert [r["text"] for r in own] == ["".join(shown[: 2 * k + 2]) for k in range(4)] + ["".join(shown)]
    assert [r["text"][r["mask_start"] : r["mask_end"]] for r in own[:-1]] == [f"turn {k} \\ls\\g" for k in (1, 3, 5, 7)]
    assert own[-1]["mask_start"] is None
    later = chat_examples.read_back(made.where("example > 0")).first()
    assert later["loss_sha256"] == hashlib.sha256("".join(t for _, k, _, t in turns if k % 2 and k > 1).encode()).hexdigest()
    assert later["n_turns"] == 9
