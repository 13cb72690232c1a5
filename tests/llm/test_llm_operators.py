"""The ten operators against brute force, round trips and odd rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from boxwise.llm import avi_media, bm25_wand, bpe, chat_examples, chunk_dedup, fm_quality, interleave, jaccard_join, pii_spans, shingles, url_rules
from boxwise.llm import queries as Q
from boxwise.llm.common import table
from boxwise.llm.components import connected_components

DOC = "doc_id long, text string, lang string, source string, n_chars long, DOC_ID2 string, digest string, score double"
LONG = " ".join(f"word{k % 977}x{k}" for k in range(30_000))
ODD = [(1, None), (2, ""), (3, "one"), (4, "the same text twice over and over"), (5, "the same text twice over and over"), (6, LONG), (7, "é😀 <|endoftext|> \u2028x"), (7, "é😀 <|endoftext|> \u2028x"), (None, "no id at all here now"), (9, "!!! ... ###")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, "s" if (i or 0) % 2 else None, None, "x", "y", 1.0) for i, t in rows], DOC)


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


# 1
BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(d))) % 10 == 0


def base_spans(text):
    ok = {"email": lambda m: True, "ip": lambda m: all(int(p) <= 255 for p in m.split(".")), "card": lambda m: 13 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m)), "phone": lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15}
    return [f"{k}:{m.start()}:{m.end()}" for k, p in BASE for m in re.finditer(p, text or "") if ok[k](m[0])]


def test_pii(spark):
    rows = ODD + [(20, "a@b.c_x@y.z d@e.f-g@h.i"), (21, "1.2.3.4.5.6.7.8.9 300.1.1.1 007.08.9.1"), (22, "4111 1111 1111 1111 4111-1111-1111-1112, +1 (212) 555-7713 +49301234567890123456"), (23, "😀 +12+3333333333 a@b"), (24, "mail joe (at) x (dot) com, call 212-555-1234"), (25, "9" * 3000 + "@a.b")]
    df = frame(spark, rows)
    model = pii_spans.fit(df)
    got = pii_spans.report(df, model).collect()
    assert len(got) == len(rows)
    by_id = {i: t for i, t in rows}
    for r in got:
        wanted = base_spans(by_id[r["doc_id"]])
        assert r["base_sha256"] == sha(",".join(wanted)), r
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(w.startswith(k + ":") for w in wanted) for k, _ in BASE]
        assert set(wanted) <= set(r["spans"].split(",")) | {""}
    clean = {r["doc_id"]: r["text"] for r in pii_spans.redact(df, model).collect()}
    assert clean[20] == "[EMAIL][EMAIL] [EMAIL]@h.i" and clean[1] is None and clean[6] == LONG
    assert pii_spans.redact(df, model).columns == df.columns
    empty = df.limit(0)
    assert pii_spans.fit(empty) == [] and pii_spans.report(empty, []).count() == 0
    plan = pii_spans.report(df, model)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_pii_em_learns(spark):
    """Labelers that agree end above the prior; a vote pattern of noes ends below."""
    rows = [(k, f"reach me at user{k}@mail.example.com today") for k in range(60)] + [(100 + k, f"order {4000000000000000 + 7 * k} shipped") for k in range(60)]
    weights = dict(pii_spans.fit(frame(spark, rows)))
    assert sum(weights[0]) > 2 and set(weights) <= {0, 1, 2, 3}


# 2
def test_chat(spark):
    rows = [(1, 0, "system", "be <kind>"), (1, 1, "user", "hi [INST] \\l"), (1, 2, "assistant", "</s> yes"), (1, 3, "user", ""), (1, 4, "assistant", None), (1, 5, "user", "tail"), (2, 0, "user", "only"), (3, 0, "tool>x", " [/INST] "), (3, 1, "assistant", "a\nb"), (None, 0, None, "x"), (4, 0, "assistant", LONG), (4, 0, "assistant", LONG)]
    turns = spark.createDataFrame([(*r, "c") for r in rows], "conv_id long, turn long, role string, text string, example string")
    made = chat_examples.examples(turns.unionByName(chat_examples.probe(spark), allowMissingColumns=True))
    got = {r["conv_id"]: r for r in chat_examples.read_back(made).collect()}
    by: dict = defaultdict(list)
    for c, t, r, x in sorted(rows, key=lambda r: (r[0] or 0, r[1])):
        by[c].append((r or "", x or ""))
    by[-1] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    assert set(got) == set(by)
    for c, own in by.items():
        loss = "".join(x for r, x in own if r == "assistant")
        assert got[c]["n_turns"] == len(own)
        assert got[c]["turns_sha256"] == sha("".join(f"{r}\n{x}\n" for r, x in own))
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), sha(loss))
    spelt = {(r["conv_id"], r["example"]): r for r in made.collect()}
    assert spelt[1, 2]["mask_start"] is None and spelt[1, 2]["text"].startswith(spelt[1, 1]["text"]) and spelt[2, 0]["mask_end"] is None
    r = spelt[1, 1]
    assert r["text"].startswith(spelt[1, 0]["text"]) and r["mask_start"] == r["mask_end"]
    assert spelt[1, 0]["text"][spelt[1, 0]["mask_start"] : spelt[1, 0]["mask_end"]] == "\\l/s\\g yes"
    assert chat_examples.read_back(chat_examples.examples(turns.limit(0))).count() == 0


# 3
@pytest.mark.parametrize("data", [b"", b"\xff" * 64, bytes(range(256)) * 70, b"a" * 4097, LONG.encode()])
def test_avi_round_trip(data):
    payload = avi_media.pad(data)
    assert payload.startswith(data) and len(payload) % 64 == 0 and 0 < len(payload) < len(data) + 65
    back, clips = avi_media.analyse(avi_media.write_avi(payload))
    assert back == payload and clips[0][0] == 0
    with pytest.raises(ValueError):
        avi_media.analyse(avi_media.write_avi(payload)[:-40])


def test_avi_shots_and_rows(spark):
    calm, loud = np.zeros(64 * 64 * 12, np.uint8) + 128, np.tile(np.arange(256, dtype=np.uint8), 16 * 12)
    noise = np.random.default_rng(0).integers(0, 3, len(calm)).astype(np.uint8)
    _, clips = avi_media.analyse(avi_media.write_avi(bytes(calm + noise) + bytes(loud)))
    assert any(c[0] == 12 / 25 for c in clips)
    got = {r["doc_id"]: r for r in avi_media.read_back(frame(spark, ODD)).collect()}
    assert got[1]["payload_sha256"] == got[2]["payload_sha256"] == hashlib.sha256(bytes(64)).hexdigest()
    assert got[4]["media_sha256"] == got[5]["media_sha256"] and got[6]["n_bytes"] == len(LONG)
    assert got[3]["tail_crc32"] == zlib.crc32(b"one" + bytes(61))
    assert avi_media.clips(avi_media.encoded(frame(spark, ODD))).select("doc_id").distinct().count() == 9


# 4
def test_leaks(spark, sf_dir, docs, texts):
    items = {r["item_id"]: r["text"] for r in table(spark, sf_dir, "benchmark").collect()}
    grams = {i: bm25_wand._grams(shingles.words(t)) for i, t in items.items()}
    wanted = set()
    for d, t in texts.items():
        own = bm25_wand._grams(shingles.words(t))
        wanted |= {(d, i) for i, g in grams.items() if len(g & own) >= 0.8 * len(g)}
    got = {(r["doc_id"], r["item_id"]) for r in bm25_wand.leaks(docs, table(spark, sf_dir, "benchmark")).collect()}
    assert got == wanted and wanted
    item = items[min(items)].split()
    edited = " ".join(item[:12] + ["changed"] + item[13:])
    odd = frame(spark, [*ODD, (50, LONG + " " + " ".join(item) + " " + LONG), (51, " ".join(item[:8])), (52, edited.upper())])
    found = {r["doc_id"] for r in bm25_wand.leaks(odd, table(spark, sf_dir, "benchmark")).collect()}
    assert 50 in found and 51 not in found and not found & {1, 2, 3, 4, 5, 6, 7, None, 9}
    assert bm25_wand.leaks(odd, table(spark, sf_dir, "benchmark").limit(0)).count() == 0
    assert bm25_wand.decontaminate(odd, table(spark, sf_dir, "benchmark")).count() == odd.count() - len(found)


def plain_bm25(texts):
    """Weights of each text's words as a share of its score for itself, by the formula."""
    own = [Counter(shingles.words(t)) for t in texts]
    df = Counter(w for c in own for w in c)
    mean = sum(c.total() for c in own) / len(own)
    idf = {w: np.log(1 + (len(own) - n + 0.5) / (n + 0.5)) for w, n in df.items()}
    raw = [{w: idf[w] * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * c.total() / mean)) for w, tf in c.items()} for c in own]
    return [{w: x / sum(r.values()) for w, x in r.items()} for r in raw]


def mixed_items(seed, n, longest):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{k}" for k in range(80)]
    return rng, vocabulary, [" ".join(rng.choice(vocabulary, rng.integers(1, longest), p=np.arange(80, 0, -1) / 3240)) for _ in range(n)]


def test_block_max_is_exact():
    """The search finds the pairs that plain BM25 finds, over items of mixed lengths."""
    rng, vocabulary, items = mixed_items(5, 60, 90)
    items = sorted(set(items))
    weights = plain_bm25(items)
    index = bm25_wand.Index([(k, t, len(t.split()), sorted(w), [w[x] for x in sorted(w)]) for k, (t, w) in enumerate(zip(items, weights, strict=True))])
    texts = [" ".join(rng.choice(vocabulary, 200)) for _ in range(30)] + [f"{items[k]} and {items[k + 1]}" for k in range(20)] + ["", "none of it"]
    got = {(d, i): s for d, i, s, _ in index.search(texts)}
    wanted = {}
    for d, t in enumerate(texts):
        own = t.split()
        for i, w in enumerate(weights):
            n = len(items[i].split())
            stride = bm25_wand.stride_of(n)
            least = bm25_wand.least_score(items[i], np.array(list(w.values())))
            assert least <= bm25_wand.THRESHOLD
            score = max((sum(w.get(x, 0) for x in set(own[a : a + 2 * stride])) for a in range(0, len(own), stride)), default=0)
            if score >= least:
                wanted[d, i] = score
    assert got.keys() == wanted.keys() and len(wanted) > 60
    assert all(abs(got[k] - wanted[k]) < 1e-4 for k in wanted)


def test_weights_are_those_of_all_items(spark):
    """Statistics are global: several indexes give what one gives, repeated items count once, an item may have no id."""
    _, _, items = mixed_items(6, 40, 50)
    items = sorted({t for t in items if len(t.split()) > 12})
    benchmark = spark.createDataFrame([(k if k else None, t, "x") for k, t in enumerate(items)] * 2 + [(99, None, "x"), (98, " ", "x")], "item_id long, text string, term string")
    weights = {t: w for t, w in zip(items, plain_bm25(items), strict=True)}
    for r in bm25_wand.weighted(benchmark).collect():
        assert r["terms"] == sorted(weights[r["text"]]) and np.allclose(r["weights"], [weights[r["text"]][t] for t in r["terms"]])
    docs = spark.createDataFrame([(k, f"before {t} after", 0) for k, t in enumerate(items)] + [(None, items[1], 0)], "doc_id long, text string, df int")
    one = sorted(map(str, bm25_wand.leaks(docs, benchmark).collect()))
    assert sorted(map(str, bm25_wand.leaks(docs, benchmark, 100).collect())) == one
    found = {(r["doc_id"], r["item_id"]) for r in bm25_wand.leaks(docs, benchmark).collect()}
    assert {(k, k if k else None) for k in range(len(items))} | {(None, 1)} <= found


def test_items_of_one_template(spark):
    """60 items that share 40 words and differ in 9: texts that hold 0.8 of an item's shingles are found although its rare words are gone."""
    rng = np.random.default_rng(8)
    shared = [f"common{k}" for k in range(40)]
    items = [" ".join([*shared, *(f"rare{i}x{k}" for k in range(9))]) for i in range(60)]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = [(i, " ".join([f"p{k}" for k in rng.integers(0, 999, 30)] + items[i].split()[: 41 + i % 9] + [f"q{k}" for k in rng.integers(0, 999, 30)])) for i in range(60)]
    got = {(r["doc_id"], r["item_id"]) for r in bm25_wand.leaks(spark.createDataFrame(docs, "doc_id long, text string"), benchmark).collect()}
    wanted = set()
    for d, t in docs:
        own = bm25_wand._grams(shingles.words(t))
        for i, item in enumerate(items):
            wanted_grams = bm25_wand._grams(shingles.words(item))
            question, answer = bm25_wand._question_answer(item)
            near = set(shingles.words(t))
            if len(own & wanted_grams) >= 0.8 * len(wanted_grams) and sum(x in near for x in question) >= 0.7 * len(question) and sum(x in near for x in answer) >= 0.5 * len(answer):
                wanted.add((d, i))
    assert got == wanted and len(wanted) > 40


# 5
def test_quality(spark, docs, sf_dir):
    labels = table(spark, sf_dir, "labels")
    got = {r["doc_id"]: r for r in fm_quality.judged(docs, labels).collect()}
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    known = [(r["quality"], got[r["doc_id"]]["score"]) for r in labels.collect() if r["doc_id"] in got]
    good, bad = [s for q, s in known if q == 1], [s for q, s in known if q == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.9
    odd = fm_quality.score(frame(spark, ODD), fm_quality.Model()).collect()
    assert len(odd) == len(ODD) and all(r["score"] == 0.5 for r in odd)


def test_quality_of_held_out_rows(spark):
    """On rows that were never learnt from, good documents score above bad ones; the larger table has enough of them."""
    where = "/root/testdata/sf0.1"
    docs, labels = table(spark, where, "documents"), table(spark, where, "labels")
    got = fm_quality.judged(docs, labels).where("held_out").join(labels.select("doc_id", "quality"), "doc_id").collect()
    good, bad = [r["score"] for r in got if r["quality"] == 1], [r["score"] for r in got if r["quality"] == 0]
    assert len(good) > 100 and len(bad) > 100
    assert np.mean([g > b for g in good for b in bad]) > 0.9


def test_sum_of_squares():
    rng = np.random.default_rng(1)
    m = fm_quality.Model(0.3, rng.normal(size=fm_quality.WIDTH), rng.normal(size=(fm_quality.WIDTH, fm_quality.RANK)))
    x = np.zeros((1, fm_quality.WIDTH))
    x[0, [3, 50, 600]] = [0.5, 2, -1]
    pairs = sum(x[0, i] * x[0, j] * (m.v[i] @ m.v[j]) for i, j in [(3, 50), (3, 600), (50, 600)])
    assert np.isclose(m.margins(x)[0], 0.3 + x[0] @ m.w + pairs)


def test_quality_without_or_with_odd_labels(spark, docs):
    """No label or one class: all scores 0.5; an id that repeats, in labels or documents, counts once; further columns don't matter."""
    some = docs.limit(60)
    labels = some.select("doc_id", F.lit(1).alias("quality"), F.lit("x").alias("score"))
    for known in (labels.limit(0), labels):
        assert {r["score"] for r in fm_quality.judged(some, known).collect()} == {0.5}
    two = labels.withColumn("quality", (F.col("doc_id") % 2).cast("int"))
    again = some.unionByName(some.withColumn("text", F.concat("text", F.lit("~ later text of the same id"))))
    one, other = fm_quality.fit(some, two), fm_quality.fit(again, two.unionByName(two))
    assert np.array_equal(one.w, other.w) and one.w.any()
    assert fm_quality.judged(some.limit(0), two).count() == 0


def test_held_out_labels_are_not_learnt(spark, docs, sf_dir):
    labels = table(spark, sf_dir, "labels")
    turned = labels.withColumn("quality", F.when(fm_quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (fm_quality.fit(docs, x) for x in (labels, turned))
    assert np.array_equal(a.w, b.w) and np.array_equal(a.v, b.v)


# 6
def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0


def sets(texts):
    hashes = shingles.WordHashes()
    return {i: set(shingles.shingles([t or ""], hashes)[0].tolist()) for i, t in texts.items()}


def check_classes(got, texts):
    rep = {}
    for i, t in texts.items():
        rep.setdefault(t or "", i)
    own = sets({i: t for t, i in rep.items()})
    links, parent = Counter(), {i: i for i in own}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = list(own)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if own[i] and own[j] and jaccard(own[i], own[j]) >= 0.8:
                links[i] += 1
                links[j] += 1
                parent[max(root(i), root(j))] = min(root(i), root(j))
    for r in got:
        i = rep[texts[r["doc_id"]] or ""]
        assert (r["class_id"], r["n_links"]) == (root(i), links[i]), r


def test_jaccard_join(spark, docs, texts):
    ordered = dict(sorted(texts.items()))
    check_classes(jaccard_join.jaccard_classes(docs).collect(), ordered)


def test_jaccard_join_near_copies(spark):
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in range(120)]
    rows = {}
    for k in range(150):
        own = list(base)
        for _ in range(rng.integers(0, 7)):
            own[rng.integers(0, len(own))] = f"n{rng.integers(0, 1000)}"
        rows[k] = " ".join(own)
    df = frame(spark, list(rows.items()))
    check_classes(jaccard_join.jaccard_classes(df).collect(), rows)
    check_classes(jaccard_join.jaccard_classes(df, block=20_000).collect(), rows)


def test_jaccard_join_odd_rows(spark):
    got = jaccard_join.jaccard_classes(frame(spark, ODD + [(7, "another text of the same id")])).collect()
    assert len(got) == len(ODD) + 1
    by = {r["doc_id"]: r for r in got}
    assert by[1]["class_id"] == by[2]["class_id"] == 1 and by[5]["class_id"] == 4 and by[5]["n_copies"] == 2 and by[9]["n_links"] == 0
    kept = sorted(r["doc_id"] or 0 for r in jaccard_join.keep_one(frame(spark, ODD)).collect())
    assert kept == [0, 1, 3, 4, 6, 7, 9]
    assert jaccard_join.jaccard_classes(frame(spark, ODD).limit(0)).count() == 0


def test_recall_and_components(spark):
    assert 1 - (1 - 0.8**6) ** shingles.bands_for(0.8, 0.999, 6) >= 0.999
    chain = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(chain).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100}


def test_components_of_a_hub(spark):
    """A node of more edges than are joined in one task, in the middle of its neighbours, and a chain that hangs on one of them."""
    edges = [(5000, k) for k in range(3000)] + [(5000, k) for k in range(6000, 9000)] + [(9000 + k, 8999 + k) for k in range(10)] + [(20000, 20001)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == dict.fromkeys({x for e in edges[:-1] for x in e}, 0) | {20000: 20000, 20001: 20000}


# 7
def test_chunks_resist_shifts():
    text = LONG[:20_000].encode()
    cut = lambda t: [t[a:b] for a, b in zip([0, *chunk_dedup.boundaries(t)[:-1]], chunk_dedup.boundaries(t), strict=True)]
    assert b"".join(cut(text)) == text
    moved = cut(text[:5000] + b"inserted here" + text[5000:])
    assert len(set(cut(text)) & set(moved)) > 0.95 * len(set(cut(text)))
    assert all(len(c) <= chunk_dedup.LARGEST for c in moved)
    hashes = chunk_dedup.gear_hashes(np.frombuffer(text, np.uint8))
    k = 400
    assert int(hashes[k]) == sum(int(chunk_dedup.GEAR[text[k - age]]) << age for age in range(32)) % 2**32


def test_repeated_passages(spark):
    rng = np.random.default_rng(9)
    prose = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(2, 9))) for _ in range(n))
    passage, short = prose(53), prose(9)
    rows = [(k, f"{prose(80)} {passage} {prose(60)}") for k in range(5)] + [(10 + k, f"{prose(70)}\n{short}\n{prose(70)}") for k in range(5)] + [(30, passage + " " + passage)]
    got = {r["doc_id"]: r for r in chunk_dedup.repeated_passages(frame(spark, rows + ODD)).collect()}
    assert {0, 1, 2, 3, 4, 30} <= set(got) and not set(got) & set(range(10, 15))
    assert got[0]["kept"] and not got[4]["kept"] and 0 in got[4]["first_doc_ids"]
    text = dict(rows)[3].encode()
    held = b"".join(text[s["start"] : s["end"]] for s in got[3]["spans"])
    assert held in passage.encode() or passage.encode()[20:-20] in held
    assert chunk_dedup.dedup_chunks(frame(spark, ODD)).agg(F.sum("n")).first()[0] == chunk_dedup.chunks(frame(spark, ODD)).count()
    assert chunk_dedup.repeated_passages(frame(spark, ODD).limit(0)).count() == 0


# 8
def judge(url):
    rest = (url or "").partition("://")[2] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(len(h + p), h + p, v) for h, p, v in url_rules.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else url_rules.DEFAULT)


def test_urls(spark, sf_dir):
    odd = [None, "", "no scheme", "http://", "HTTP://WWW.Example.ORG/es/x?y#z", "http://example.org", "http://example.org/en/12", "http://xorg/", "http://a.b.c.org/", "http://é.COM/fr/", "x://com/de/", "http://example.org/es", "http://org//", "http://ÀB.org/?q", "http://a.org#/es/", "http://" + "a." * 5000 + "org/"]
    pages = spark.createDataFrame([(k, u, "h", "r") for k, u in enumerate(odd + odd)], "page_id long, url string, html string, rule string")
    for df in (pages, table(spark, sf_dir, "pages")):
        urls = {r["page_id"]: r["url"] for r in df.select("page_id", "url").collect()}
        got = url_rules.verdicts(df, url_rules.rules_table(spark)).collect()
        assert len(got) == df.count()
        for r in got:
            assert (r["host"], r["path"], r["rule"], r["verdict"]) == judge(urls[r["page_id"]])
    assert {r["verdict"] for r in url_rules.verdicts(pages, url_rules.rules_table(spark, [])).collect()} == {"allow"}
    assert url_rules.verdicts(pages.limit(0), url_rules.rules_table(spark)).count() == 0


# 9
def test_bpe(spark, docs):
    path = public_tokenizers.path(Q.VOCABULARY)
    whole = Tokenizer.from_file(path)
    rng = np.random.default_rng(2)
    odd = ["a" * 3000, "ab" * 2000, " " * 700, "it's   <|endoftext|>\n\n x", "日本語😀 naïve", "".join(chr(c) for c in rng.integers(32, 0x3000, 3000))]
    df = docs.select("doc_id", "text").unionByName(frame(spark, ODD + [(100 + k, t) for k, t in enumerate(odd)]).select("doc_id", "text"))
    rows = df.collect()
    wanted: Counter = Counter()
    for r in rows:
        ids = whole.encode(r["text"] or "", add_special_tokens=False).ids
        wanted[r["doc_id"], len(ids), sha(",".join(map(str, ids))), sha(whole.decode(ids, skip_special_tokens=False))] += 1
    assert Counter(tuple(r) for r in bpe.encoded(df, path).collect()) == wanted
    own = bpe.tokenizer(path)
    assert own.decode(own.ids("it's <|endoftext|> ü")) == "it's <|endoftext|> ü"


# 3, against a decoder of its own
def slow_frame(jpeg):
    """Coefficients of a JPEG frame by walking its segments and bits one at a time: tables from DHT, differences of the first ones, restarts."""
    at, tables, rows, cols, bits = 2, {}, 0, 0, ""
    while True:
        marker, n = jpeg[at + 1], int.from_bytes(jpeg[at + 2 : at + 4], "big")
        body = jpeg[at + 4 : at + 2 + n]
        if marker == 0xC0:
            rows, cols = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
        if marker == 0xC4:
            code, k, table = 0, 17, {}
            for length in range(1, 17):
                for _ in range(body[length]):
                    table[f"{code:0{length}b}"] = body[k]
                    code, k = code + 1, k + 1
                code *= 2
            tables[body[0]] = table
        at += 2 + n
        if marker == 0xDA:
            break
    data, blocks = jpeg[at:-2], []
    parts, k, held = [], 0, b""
    while k < len(data):
        if data[k] == 0xFF and data[k + 1] == 0:
            held, k = held + b"\xff", k + 2
        elif data[k] == 0xFF:
            parts, held, k = [*parts, held], b"", k + 2
        else:
            held, k = held + data[k : k + 1], k + 1
    for part in [*parts, held]:
        bits, place, dc = "".join(f"{b:08b}" for b in part), 0, 0

        def symbol(table):
            nonlocal place
            end = place + 1
            while bits[place:end] not in table:
                end += 1
            found, place = table[bits[place:end]], end
            return found

        def number(size):
            nonlocal place
            raw = bits[place : place + size]
            place += size
            return 0 if not size else int(raw, 2) if raw[0] == "1" else int(raw, 2) - (1 << size) + 1

        while len(bits) - place >= 8 and len(blocks) < (rows // 8) * (cols // 8):
            dc += number(symbol(tables[0x00]))
            block = [dc]
            while len(block) < 64:
                s = symbol(tables[0x10])
                if s == 0:
                    break
                block += [0] * (s >> 4) + [number(s & 15)]
            blocks.append(block + [0] * (64 - len(block)))
    return rows, cols, blocks


def test_frames_against_a_slow_decoder():
    """Every frame's coefficients, read bit by bit, give the payload; pixels agree with the cosine sums."""
    payload = avi_media.pad(bytes(range(256)) * 5 + "déjà vu".encode())
    frames, length = avi_media.read_frames(avi_media.write_avi(payload))
    got = b""
    for f in frames:
        rows, cols, blocks = slow_frame(f)
        height, width, coded = avi_media.decode_frame(f)
        assert (height, width) == (rows, cols)
        raw = bytes(c & 0xFF if c >= 0 else (c + 255) & 0xFF for b in blocks for c in b)
        assert len(raw) >= len(coded) and all(128 <= abs(c) <= 255 for b in blocks for c in b[:1])
        got += coded
    assert got[:length] == payload


# 10
def test_interleave(spark, docs):
    for df, n in ((docs, docs.count()), (frame(spark, ODD), len(ODD)), (frame(spark, ODD).limit(0), 0)):
        got = interleave.interleaved(df).collect()
        assert len(got) == n
        counts = Counter(r["shard"] for r in got)
        assert all(0 <= s < 8 for s in counts) and (n < 8 or max(counts.values()) - min(counts.values()) <= 1)
        for s, c in counts.items():
            assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(c))
    source = {r["doc_id"]: (r["source"], r["text"]) for r in docs.collect()}
    mix = Counter((source[r["doc_id"]][0], r["shard"]) for r in interleave.interleaved(docs).collect())
    for s, n in Counter(v[0] for v in source.values()).items():
        assert all(abs(mix[s, k] - n / 8) <= 2 for k in range(8))
    for r in interleave.interleaved(docs).collect():
        data = source[r["doc_id"]][1].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(data) + 1, zlib.crc32(data), "rows")
    assert sorted(map(tuple, interleave.interleaved(docs).collect())) == sorted(map(tuple, interleave.interleaved(docs.repartition(5)).collect()))


def test_a_third_of_the_rows_are_one_row(spark):
    """Equal rows are spread over the shards like others, whatever partitions they are read in, and fall into many ranges."""
    rows = [(7, "again and again")] * 3000 + [(None, "no id")] * 50 + [(k, f"text {k}") for k in range(100, 6100)]
    df = spark.createDataFrame([(i, t, "a" if i == 7 else "b") for i, t in rows], "doc_id long, text string, source string")
    one, two = interleave.interleaved(df.repartition(7)).collect(), interleave.interleaved(df.repartition(3)).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"], r["shard"], r["slot"])
    assert sorted(one, key=key) == sorted(two, key=key) and len(one) == len(rows)
    counts = Counter(r["shard"] for r in one)
    assert set(counts.values()) <= {len(rows) // 8, len(rows) // 8 + 1}
    assert all(sorted(r["slot"] for r in one if r["shard"] == s) == list(range(c)) for s, c in counts.items())
    assert all(abs(sum(r["doc_id"] == 7 and r["shard"] == s for r in one) - 375) <= 2 for s in range(8))
    read = df.repartition(7).select("doc_id", F.lit(5).alias("size"), F.lit(1).cast("long").alias("text_crc32"), F.lit("s").alias("stratum"), F.spark_partition_id().alias("part")).where("doc_id = 7")
    assert sorted(r["copy"] for r in interleave._numbered(read).collect()) == list(range(1, 3001))


@pytest.mark.parametrize("name", list(Q.ORACLE_SQL))
@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_same_as_sql(spark, name, size):
    con = duckdb.connect()
    for t in ("conversations", "pages"):
        con.execute(f"create view {t} as select * from '/root/testdata/{size}/{t}.parquet'")
    got, wanted = Q.QUERIES[name](spark, f"/root/testdata/{size}"), con.execute(Q.ORACLE_SQL[name])
    names = sorted(got.columns)
    assert names == sorted(c[0] for c in wanted.description)
    order = [[c[0] for c in wanted.description].index(n) for n in names]
    assert Counter(tuple(r[n] for n in names) for r in got.collect()) == Counter(tuple(r[k] for k in order) for r in wanted.fetchall())


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = table(spark, sf_dir, "documents")
    at, columns = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        new = stage(spark, at, sf_dir)
        assert new.columns == columns
        new = new.cache()
        assert 0 < new.count() <= at.count(), name
        at = new
    last = corpus_pipeline.STAGES[-1][1](spark, at, sf_dir)
    assert last.count() == at.count()
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(tuple, last.collect()))
