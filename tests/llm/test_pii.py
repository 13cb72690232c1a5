"""Operator 1: what the labelers learn and what they add."""

import numpy as np
from pyspark.sql import functions as F

from boxwise.llm import jaccard_join, pii_spans

VOTES = "kind int, v array<int>, x array<int>, n double"


def test_em_recovers_reliabilities(spark):
    """Votes drawn with known reliabilities: the estimates come near them."""
    rng = np.random.default_rng(3)
    true, false, share = [0.97, 0.8, 0.9, 0.7, 0.85, 0.75], [0.02, 0.3, 0.15, 0.4, 0.5, 0.35], 0.4
    rows = []
    for _ in range(6000):
        rates = true if rng.random() < share else false
        rows.append(tuple(int(rng.random() < r) if rng.random() < 0.8 else -1 for r in rates))
    patterns = sorted(set(rows))
    votes = spark.createDataFrame([(2, list(v), [0, 0, 0, 0], float(rows.count(v))) for v in patterns], VOTES)
    found = pii_spans.reliabilities(votes).first()["m"]
    assert abs(found["p"] - share) < 0.06
    assert np.abs(np.array(found["s"]) - true).max() < 0.08 and np.abs(np.array(found["f"]) - false).max() < 0.08


def planted():
    """Clean texts, decoys, and texts whose personal data no base pattern matches; (id, text, kind of what is to be added)."""
    rows, word = [], lambda k: f"plain words{' and more' * (k % 5)} stand here"
    for k in range(60):
        card = f"4{k:014d}"
        odd = [sum(divmod(2 * int(c), 10)) if j % 2 == 0 else int(c) for j, c in enumerate(reversed(card))]
        card += str(-sum(odd) % 10)
        wrong = card[:-1] + str((int(card[-1]) + 3) % 10)
        token = f"{(k + 7) * 0x9E3779B97F4A7C15F39CC0605CEDC8341082276BF3A27251 % 16**40:040x}"
        rows += [
            (10 * k, word(k), None),
            (10 * k + 1, f"{word(k)} {card} {word(k + 1)}", None),
            (10 * k + 2, f"{word(k)} {wrong} {word(k + 1)}", None),
            (10 * k + 3, f'{word(k)} token = "{token}" {word(k + 2)}', "secret"),
            (10 * k + 4, f"{word(k)} mail user{k}@mail.example.com {word(k)}", None),
            (10 * k + 5, f"{word(k)} email joe{k} (at) example (dot) com {word(k)}", "email"),
            (10 * k + 6, f"{word(k)} call +1 (212) 555-{1000 + k} {word(k)}", None),
            (10 * k + 7, f"{word(k)} phone 030 1234{100 + k} {word(k)}", "phone"),
            (10 * k + 8, f"{word(k)} server 10.{k}.20.30 {word(k)}", None),
            (10 * k + 9, f"{word(k)} server 2001:db8:{k + 1:x}::7 {word(k)}", "ip"),
        ]
    return rows


def test_added_spans(spark):
    rows = planted()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model = pii_spans.fit(docs)
    got = {r["doc_id"]: r for r in pii_spans.report(docs, model).collect()}
    caught = [k for i, _, k in rows if k and got[i]["n_added"] == 1 and got[i]["spans"].startswith(k)]
    wanted = [k for _, _, k in rows if k]
    wrong = [i for i, _, k in rows if not k and got[i]["n_added"]]
    assert len(caught) >= 0.9 * len(wanted) and set(caught) == set(wanted)
    assert not wrong  # numbers that fail the check stay out


def test_names_of_columns_may_clash(spark):
    """Tables with columns of every name that the stages use inside keep them as they are."""
    names = ["found", "found_", "every", "base", "made", "whole", "row", "row_", "rank", "_row", "_rank", "_all", "_base", "_made", "_text", "component", "node", "score"]
    docs = spark.createDataFrame([(k // 2, "write to a@b.org " + " ".join(f"w{j}" for j in range(30)) + "!" * k) for k in range(6)], "doc_id long, text string")
    docs = docs.select("doc_id", "text", *(F.lit(f"own {n}").alias(n) for n in names))
    clean = pii_spans.redact(docs, pii_spans.fit(docs))
    kept = jaccard_join.keep_one(clean)
    for out, n in ((clean, 6), (kept, 1)):
        assert out.columns == docs.columns
        rows = out.collect()
        assert len(rows) == n
        assert all(r[m] == f"own {m}" for r in rows for m in names)
        assert all(r["text"].startswith("write to [EMAIL] w0") for r in rows)
