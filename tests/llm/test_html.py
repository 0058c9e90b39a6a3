import math
import time

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pathloom.llm import html_extract as h
from pathloom.llm.queries import queries

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{x}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/">Home</a></li></ul></nav><!-- <p>no</p> --><div class="Ad big">buy</div>
<article><h1>Head &amp; <i>line</i></h1><p><b>One<br>two<p>three <a href=x>link</a></p><table><tr><td>c1<td>c2</table></article><footer>&copy; x</footer></body></html>"""


def test_blocks():
    got = h.blocks(PAGE)
    assert [b.text for b in got] == ["Home", "buy", "Head & line", "One", "two", "three link", "c1", "c2", "© x"]
    assert [t for t, _ in got[2].path] == ["html", "body", "article", "h1"]
    assert got[1].path[-1] == ("div", ("ad", "big"))
    assert got[0].linked == 4 and got[5].linked == 4 and got[4].linked == 0
    assert [t for t, _ in got[5].path][-2:] == ["article", "p"]


def test_any_markup_is_read():
    for page in ("", "<", "<<<p", "a < b", "</p></p>", "<p", "<!--", "<script>", "<a><b><p>x</a>y", "<p class='x>y", "&amp;&bogus;", "<div>" * 3000 + "x", "text only"):
        h.blocks(page)
    assert [b.text for b in h.blocks("a < b <p>c")] == ["a < b", "c"]
    assert [b.text for b in h.blocks("a <b and c <p>d <p class='x>e<p>f &#1234567890123;")] == ["a <b and c", "d", "e", "f \ufffd"]
    assert [b.text for b in h.blocks("<p title='a > b <i>' class=\"x y\">c</P >d</ e")] == ["c", "d</ e"]
    assert h.blocks("<p title='a > b' CLASS = \"X y\">c")[0].path == (("p", ("x", "y")),)


def test_omitted_end_tags_and_custom_elements_hide_nothing():
    text = lambda page: [b.text for b in h.blocks(page)]
    assert text("<p>a<select><option>A<option>B</select>b<p>c") == ["a", "b", "c"]
    assert text("<p>a<datalist><option>A<option>B<option>C</datalist><p>b") == ["a", "b"]
    assert text("<html><head><meta charset=utf-8><title>T</title><link rel=x><body><p>a<p>b</body></html>") == ["a", "b"]
    assert text("<head><title>T <b>U</b></title><script>x</script><style>y</style><h1>a</h1>b") == ["a", "b"]
    assert text("<head><title>T</title><hr><p>a") == text("<head><title>T</title> a") == ["a"]
    assert text("<html><head> <title>T</title> </head> <body>a</body>") == ["a"]
    assert text("<head><title>T<body><p>a") == ["a"]
    assert text("<p>a <svg width='1' data-x='>'/> b<p>c") == ["a b", "c"]
    assert text("<p>a <svg/> b <svg><title>no</title><path d='M0'/></svg> c") == ["a b c"]
    assert text("<p>a</p><svg-icon name=x>i</svg-icon><template-x>t</template-x><style-y>s</style-y><p>b") == ["a", "i", "t", "s", "b"]
    assert text("<p>a<template>no</template><script\nasync>no</script><textarea>no</textarea>b") == ["ab"]
    assert [b.linked for b in h.blocks("<table><tr><td><a href=x>l<td>a<tr><td>b</table><p>c")][-1] == 0


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    model = h.Model.fresh(4, rng)
    w = [x.astype(np.float64) for x in model.w[:3]]
    x, mask = rng.normal(size=(5, 3, h.SIZE)), np.ones((5, 3))
    mask[3:, 1] = 0
    d = rng.normal(size=(5, 3, 4))
    tape = []
    h._run(x, mask, *w, tape=tape)
    grads = h._back(x, w[0], w[1], tape, d)
    for k in range(3):
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in w[k].shape)
            moved = []
            for step in (1e-3, -1e-3):
                v = [y.copy() for y in w]
                v[k][at] += step
                moved.append((h._run(x, mask, *v).astype(np.float64) * d).sum())
            assert abs((moved[0] - moved[1]) / 2e-3 - grads[k][at]) < 2e-2 * max(1, abs(grads[k][at]))


def brute_labels(model, page):
    """The labels of one page once more: features and both LSTMs by plain loops over plain numbers, tag paths spelt out."""
    found = h.blocks(page)
    hidden = model.w[1].shape[0]
    rows = []
    for at, b in enumerate(found):
        tags, vec = [t for t, _ in b.path], [0.0] * h.PATH
        words = [f"t:{t}" for t in tags] + [f"2:{x}/{y}" for x, y in zip(tags[-3:], tags[-2:])][-2:] + [f"l:{t}" for t in tags[-1:]] + [f"c:{m}" for _, marks in b.path[-6:] for m in marks]
        for w in words:
            code = xxhash.xxh64_intdigest(w)
            vec[code % h.PATH] += 1 if code >> 63 else -1
        norm = max(math.sqrt(sum(v * v for v in vec)), 1e-9)
        size = len(b.text)
        figures = [math.log1p(size) / 5, b.linked / size, b.text.count(" ") / size * 5, sum(map(b.text.count, ".!?")) / size * 20, b.text.count(",") / size * 20, math.log1p(len(tags)) / 2, (at + 0.5) / len(found), 1.0]
        rows.append([v / norm for v in vec] + h._hashed([b.text.lower()], h.WORD)[0].tolist() + figures)
    sigmoid = lambda z: 1 / (1 + math.exp(-z))
    total = [float(model.w[7][0])] * len(rows)
    for side in (0, 1):
        w, u, bias = (np.asarray(model.w[3 * side + k], float) for k in range(3))
        state, cell = [0.0] * hidden, [0.0] * hidden
        for t in range(len(rows) - 1, -1, -1) if side else range(len(rows)):
            z = np.array(rows[t]) @ w + np.array(state) @ u + bias
            for k in range(hidden):
                cell[k] = sigmoid(z[hidden + k]) * cell[k] + sigmoid(z[k]) * math.tanh(z[3 * hidden + k])
                state[k] = sigmoid(z[2 * hidden + k]) * math.tanh(cell[k])
            total[t] += float(np.array(state) @ model.w[6][side * hidden : (side + 1) * hidden])
    return found, [sigmoid(z) for z in total]


def test_query_against_brute_force(spark, sf):
    table = spark.read.parquet(f"{sf}/pages.parquet")
    model = h.train(table)
    got = {r["page_id"]: r for r in queries()["op8_html_extract"](spark, sf).collect()}
    for p in table.collect():
        found, chance = brute_labels(model, p["html"])
        assert all(abs(c - 0.5) > 1e-4 for c in chance)
        kept = [b.text for b, c in zip(found, chance) if c >= 0.5]
        assert (got[p["page_id"]]["text"], got[p["page_id"]]["n_blocks"], got[p["page_id"]]["n_content"]) == ("\n".join(kept), len(found), len(kept))


N = 5_000_000
HOSTILE = {
    "spaces": " " * N, "letter": "x" * N, "unclosed name": "<" + "a" * N, "scripts": "<script " * (N // 8), "deep": "<div>x" * 160_000, "quotes and signs": '<a " ="' * (N // 7) + '" <p>x', "declarations": "<!" * (N // 2),
    "stray ends": "<div>" * (N // 10) + "</x>" * (N // 8), "inline": "<b>" * (N // 6) + "<p></p>" * (N // 14), "svg": '<svg "' * (N // 6), "class": '<p class="' * (N // 10), "number": "&#" + "1" * N, "ampersands": "&" * N, "signs": "<" * (N // 4), "comments": "<!--" * (N // 4), "attributes": "<p " + "class " * (N // 6), "mains": "<main>" * (N // 12) + "x",
}


@pytest.mark.parametrize("name", HOSTILE)
def test_hostile_pages_take_seconds(name):
    """5 MB of one thing; work and memory are in proportion to the page."""
    model = h.Model.fresh(16, np.random.default_rng(0))
    began = time.time()
    h.extract_pages(model, [HOSTILE[name]])
    assert time.time() - began < 45


def test_held_out_accuracy(spark):
    """Pages that training has not seen, with the marks of their main part hidden."""
    shared = h.Paths()
    pages = [h.blocks(r["html"], shared) for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").orderBy("page_id").limit(900).collect()]
    cut = 400
    model = h.fit(pages[:cut])
    test = pages[cut:]
    truth = np.array([b.main for p in test for b in p])
    assert truth.tolist() == [any(t in h.MAIN for t, _ in b.path) for p in test for b in p]
    parts = np.split(h.vectors(test, hide=True), np.cumsum([len(p) for p in test])[:-1])
    guess = np.concatenate(h.probabilities(model, parts)) >= 0.5
    assert (guess == truth).mean() > 0.99


def test_a_page_fares_alike_in_any_batch(spark, sf):
    pages = [r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").limit(30).collect()]
    shared = h.Paths()
    model = h.fit([h.blocks(p, shared) for p in pages])
    together = h.extract_pages(model, pages)
    for i in range(0, 30, 7):
        assert [x[0] for x in h.extract_pages(model, [pages[i]])] == [x[i] for x in together]


def test_query(spark, sf):
    rows = {r["page_id"]: r for r in queries()["op8_html_extract"](spark, sf).collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(rows) == len(pages)
    right = 0
    for p in pages:
        want = "\n".join(b.text for b in h.blocks(p["html"]) if any(t in h.MAIN for t, _ in b.path))
        right += rows[p["page_id"]]["text"] == want
    assert right >= 0.95 * len(pages)


def test_odd_rows(spark):
    rows = [(1, PAGE), (1, PAGE), (2, None), (3, ""), (None, "<p>x"), (4, "<div>" * 5000), (5, "<p>word " * 20_000)]
    df = spark.createDataFrame(rows, "page_id int, html string").withColumns({n: F.lit(1) for n in ("id", "text", "n_blocks", "c.d")})
    got = h.extract_html(df).collect()
    assert len(got) == 7
    by = {r["page_id"]: r for r in got}
    assert tuple(by[2])[1:] == (None, None, None) and tuple(by[3])[1:] == ("", 0, 0) and by[4]["n_blocks"] == 0
    assert by[5]["n_blocks"] == 20_000
    assert len({tuple(r) for r in got if r["page_id"] == 1}) == 1
    none = h.extract_html(df.where("page_id = 3 or page_id is null"))
    assert sorted(r["text"] for r in none.collect()) == ["", "x"]
    assert h.extract_html(df.limit(0)).count() == 0
