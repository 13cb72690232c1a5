"""The pipeline against plain loops over the same documents, stage by stage."""

import hashlib

import corpus_pipeline
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from boxwise.llm import bm25_wand, fm_quality, pii_spans, shingles
from boxwise.llm.common import table

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def plain_near_duplicates(rows):
    """(key, row) -> rows kept: one of each id, then one of each class of similar or equal texts, that of the least id; ids before none."""
    by_id = {}
    for r in rows:
        key = (0, r[0]) if r[0] is not None else (1, r[1] or "")
        if key not in by_id or (r[1] is not None, r[1] or "") < (by_id[key][1] is not None, by_id[key][1] or ""):
            by_id[key] = r
    own = sorted(by_id.items())
    sets = []
    for _, r in own:
        w = shingles.words(r[1] or "")
        sets.append({tuple((w + [""] * 5)[:5])} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)})
    group = list(range(len(own)))

    def find(k):
        while group[k] != k:
            k = group[k]
        return k

    for i in range(len(own)):
        for j in range(i):
            same = (own[i][1][1] or "") == (own[j][1][1] or "")
            shared = len(sets[i] & sets[j])
            if same or (shared and shared >= 0.8 * (len(sets[i]) + len(sets[j]) - shared)):
                a, b = find(i), find(j)
                group[max(a, b)] = min(a, b)
    return [own[k][1] for k in range(len(own)) if find(k) == k]


def plain_leaks(rows, items):
    grams = [bm25_wand._grams(shingles.words(t)) for t in items if shingles.words(t)]
    return [r for r in rows if not any(len(g & bm25_wand._grams(shingles.words(r[1] or ""))) >= 0.8 * len(g) for g in grams)]


@pytest.fixture(scope="module")
def folder(spark, sf_dir, tmp_path_factory):
    """The small tables with odd rows: no id, no text, repeated ids, a near copy without an id, an emptied table beside."""
    path = tmp_path_factory.mktemp("tables")
    rows = [tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in table(spark, sf_dir, "documents").collect()]
    long = max((r for r in rows), key=lambda r: len(r[1]))
    item = table(spark, sf_dir, "benchmark").orderBy("item_id").first()["text"]
    clean = max((r[1] for r in rows if r[0] % 4 == 1), key=len)
    odd = [(None, None), (None, "no id at all"), (None, "write to a.b@c.org " + clean), (None, long[1] + " more"), (90001, None), (90002, ""), (90003, clean + "\n" + item), (90004, "call +1 (212) 555-7713 now. " + clean[::-1]), (rows[3][0], rows[3][1]), (rows[4][0], "another text under an id that is there"), (-5, long[1])]
    odd += [odd[2], odd[9]]
    spark.createDataFrame(rows + [(i, t, None, None, None) for i, t in odd], COLUMNS).write.parquet(f"{path}/documents.parquet")
    for name in ("labels", "benchmark"):
        table(spark, sf_dir, name).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def test_against_plain_loops(spark, folder):
    docs = [tuple(r) for r in table(spark, folder, "documents").collect()]
    model = fm_quality.fit(table(spark, folder, "documents"), table(spark, folder, "labels"))
    score = lambda t: float(model.scores(fm_quality.features([t or ""], fm_quality.Places()))[0])
    good = [r for r in docs if score(r[1]) >= fm_quality.KEEP]
    assert 0 < len(good) < len(docs)
    apart = plain_near_duplicates(good)
    clean = plain_leaks(apart, [r["text"] for r in table(spark, folder, "benchmark").collect()])
    assert len(clean) < len(apart) < len(good)
    library = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    library.no_truncation()
    library.no_padding()
    left = spark.createDataFrame(clean, COLUMNS)
    hidden = {(r["doc_id"], r["lang"], r["n_chars"]): r["text"] for r in pii_spans.redact(left, pii_spans.fit(left)).collect()}
    wanted = []
    for r in clean:
        text = hidden[r[0], r[2], r[4]] if r[0] is not None else None
        if r[0] is not None:
            ids = library.encode(text or "", add_special_tokens=False).ids
            wanted.append((r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()))
    got = corpus_pipeline.run(spark, folder).collect()
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in got if r["doc_id"] is not None) == sorted(wanted)
    assert sum(r["doc_id"] is None for r in got) == sum(r[0] is None for r in clean)


def test_stages_keep_columns_and_take_empty_tables(spark, folder):
    empty = table(spark, folder, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, folder)
        assert out.count() == 0
        assert name == "tokens" or out.columns == empty.columns
