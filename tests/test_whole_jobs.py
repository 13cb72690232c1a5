"""Box queries take every line and word of a page: small texts against plain Python."""

import numpy as np
import pytest

from boxwise.plans.catalogue import QUERIES


def boxes(texts):
    """(doc_id, page, ln, pos, text, x, conf) of every word."""
    out = []
    for d, text in texts.items():
        for ln, line in enumerate(text.split("\n")):
            x = 0
            for pos, word in enumerate(t for t in line.split(" ") if t):
                out.append((d, ln // 40 + 1, ln, pos, word, x, 50 + (31 * d + 17 * pos + 7 * ln) % 50))
                x += 8 * (len(word) + 1)
    return out


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abc"), rng.integers(1, 14)))
    return {d: "\n".join(" ".join(word() for _ in range(rng.integers(0, 14))) for _ in range(90)) for d in range(1, 7)}


@pytest.fixture(scope="module")
def small_dir(spark, texts, tmp_path_factory):
    at = tmp_path_factory.mktemp("small")
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{at}/documents.parquet")
    return str(at)


def got(spark, small_dir, name, *columns):
    return sorted(tuple(r) for r in QUERIES[name](spark, small_dir).select(*columns).collect())


def under_headings(texts, found):
    """found(x, heads) of each word below the first line of its page, by the heading words (x, pos) in order."""
    heads, out = {}, []
    for d, page, ln, pos, _, x, _ in boxes(texts):
        if ln % 40 == 0:
            heads.setdefault((d, page), []).append((x, pos))
        elif (d, page) in heads:
            out += ((d, ln, pos, *cell) for cell in found(x, heads[d, page]))
    return sorted(out)


def test_every_word_has_its_column(spark, small_dir, texts):
    def column(x, heads):
        return [(max(pos for k, (hx, pos) in enumerate(heads) if k == 0 or 2 * x >= hx + heads[k - 1][0]),)]

    wanted = under_headings(texts, column)
    assert max(c for *_, c in wanted) > 8 and len({ln % 40 for _, ln, _, _ in wanted}) == 39
    assert got(spark, small_dir, "column_bucket_assign", "doc_id", "ln", "pos", "col") == wanted


def test_every_word_may_have_a_cell(spark, small_dir, texts):
    def cell(x, heads):
        near = sorted((abs(x - hx), pos) for hx, pos in heads)
        if len(near) > 1 and near[0][0] == near[1][0]:
            return []
        d, col = near[0]
        gap = min([abs(hx - heads[col][0]) for hx, pos in heads if pos != col], default=100_000)
        return [(col, d)] if d <= max(15, gap * 58 // 100) else []

    wanted = under_headings(texts, cell)
    assert max(c for _, _, _, c, _ in wanted) > 8 and len({ln % 40 for _, ln, *_ in wanted}) == 39
    assert got(spark, small_dir, "column_cells", "doc_id", "ln", "pos", "col", "d") == wanted


def test_every_line_has_boundaries(spark, small_dir, texts):
    rows = boxes(texts)
    x = {(d, ln, pos): x for d, _, ln, pos, _, x, _ in rows}
    half = lambda a, b: None if a is None or b is None else (a + b) / 2
    wanted = [(*k, half(x.get((*k[:2], k[2] - 1)), v), half(x.get((*k[:2], k[2] + 1)), v)) for k, v in x.items()]
    found = QUERIES["column_boundaries"](spark, small_dir).select("doc_id", "ln", "pos", "lo", "hi").collect()
    assert {tuple(r) for r in found} == set(wanted) and len(found) == len(wanted)


def test_needed_tokens_count_on_any_line(spark, small_dir, texts):
    lengths = {d: {len(w) for e, *_, w, _, _ in boxes(texts) if e == d} for d in texts}
    early = {d: {len(w) for e, _, ln, _, w, _, _ in boxes(texts) if e == d and ln < 3} for d in texts}
    need = {d: {d % 7 + 2, d % 5 + 9} for d in texts}
    wanted = sorted((d, len(n), len(n & lengths[d])) for d, n in need.items())
    assert any(len(n & lengths[d]) > len(n & early[d]) for d, n in need.items())
    assert got(spark, small_dir, "address_division", "doc_id", "wanted", "found") == wanted


def test_a_full_row_has_one_value_in_every_column_of_its_page(spark, tmp_path):
    long = lambda c: c * 10
    gap = " " + "x " * 22
    three = lambda a, b, c: f"{long(a)}{gap}{long(b)}{gap}{long(c)}"
    texts = {
        1: f"{three('a', 'b', 'c')}\n{long('d')}{gap}{long('e')}\n{long('f')}",  # one row has all three columns
        2: f"{three('a', 'b', 'c')}\n{three('d', 'e', 'f')}",  # two rows have
        3: f"{long('a')}{gap}{long('b')}\n{'x ' * 110}{long('c')}",  # a value further right: no row has all
        4: f"{long('a')} {long('b')}{gap}{long('c')}\n{long('d')}",  # two values in one column
        5: f"short\n{long('a')}",  # one column only
    }
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    wanted = [(1, 0, "a" * 10, "b" * 10, "c" * 10), (5, 1, "a" * 10, None, "")]
    assert got(spark, str(tmp_path), "unique_full_row", "doc_id", "ln", "one", "two", "rest") == wanted


def test_faint_boxes_of_first_lines_count_too(spark, small_dir, texts):
    rows = boxes(texts)
    sure = [r for r in rows if r[-1] >= 70]
    near = lambda r: any(o[:2] == r[:2] and o[4] == r[4] and abs(o[5] - r[5]) <= 400 and abs(o[2] - r[2]) <= 3 for o in sure)
    wanted = sorted(r[:4] for r in rows if r[-1] < 70 and not near(r))
    assert any(ln % 40 == 0 for _, _, ln, _ in wanted)
    assert got(spark, small_dir, "spatial_dedup", "doc_id", "page", "ln", "pos") == wanted
