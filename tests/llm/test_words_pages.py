"""Whitening, spelling variants and main texts against brute force and labelled pages."""

import collections
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from scrivana.llm import html, spelling, whiten
from scrivana.llm.labelled_pages import labelled_pages

# whitening


def whole(rows):
    return [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]


def check_white(got, rows, dim):
    rows = [r for r in whole(rows) if len(r[1]) == dim]
    fit = np.array(sorted({tuple(x) for _, x in rows}), dtype=np.int64)
    n, s = len(fit), fit.sum(axis=0)
    centred = fit - s / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    k = min(16, dim)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    found = collections.defaultdict(dict)
    for r in got:
        assert r.n == n and r.identity_error < 1e-9
        found[r.vec_id, r.deviation][r.component] = (r.whitened, r.explained)
    signs = None
    assert len(got) == k * len(rows)
    for i, x in rows:
        own = found[i, sum((n * a - int(b)) ** 2 for a, b in zip(x, s))]
        mine, want = np.array([own[c + 1][0] for c in range(k)]), (np.array(x) - s / n) @ vectors / np.sqrt(values)
        if signs is None and (np.abs(want) > 1e-3).all():
            signs = np.sign(mine * want)
        assert np.allclose(np.abs(mine), np.abs(want), atol=1e-6)
        assert signs is None or np.allclose(mine, want * signs, atol=1e-6)
        assert np.allclose([own[c + 1][1] for c in range(k)], values / np.trace(centred.T @ centred / n), rtol=1e-6)


@pytest.mark.parametrize("dim", [1, 5, 16, 27])
def test_whitening(spark, clashing, dim):
    rng = np.random.default_rng(dim)
    spread = rng.normal(size=(dim, dim)) + 3 * np.eye(dim)
    rows = [(i, (rng.normal(size=dim) @ spread).tolist()) for i in range(200)]
    rows += [(900, rows[3][1])] * 60 + [(None, rows[4][1])]  # one vector on many rows, a row without an id
    rows += [(901, None), (902, []), (903, [float("nan")] * dim), (904, [None] * dim), (905, [float("inf")] * dim), (906, [1.0] * (dim + 1)), (907, [1e300] * dim)]
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).withColumn("x", F.lit(1)).withColumn("id", F.lit(2)).repartition(3)
    check_white(whiten.whiten(spark, df).collect(), [r for r in rows if r[0] != 907], dim)


def test_whitening_of_flat_and_far_vectors(spark):
    def white(rows):
        return whiten.whiten(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()

    assert white([]) == [] and white([(1, None)]) == [] and white([(1, [1.0, 2.0])] * 5) == []
    flat = white([(i, [float(i), 7.0, -float(i)]) for i in range(50)])
    assert {r.component for r in flat} == {1} and abs(flat[0].explained - 1) < 1e-12
    for apart, found in ((3e4, {1, 2, 3}), (3e9, {1})):  # beside 3e9, squares of the others are near rounding
        far = [(i, [4e9 + i, (-1.0) ** i * apart, float(i * i)]) for i in range(40)]
        got = white(far)
        assert {r.component for r in got} == found and all(r.identity_error < 1e-4 for r in got)
        x = dict(whole(far))
        s = [sum(v[k] for v in x.values()) for k in range(3)]
        assert all(r.deviation == min(whiten.LONG, sum((40 * a - b) ** 2 for a, b in zip(x[r.vec_id], s))) for r in got)


# spelling variants


def brute_variants(rows, spoil):
    counts = collections.Counter()
    for own, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if own is None else own}:{w}".encode())
            counts[w[: h % len(w)] + w[h % len(w) + 1 :] if spoil and h % spoil == 0 else w] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}

    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    around = {w: [u for u in words if near(u, w)] for w in words}
    best = {w: min(us, key=lambda u: (-words[u], u), default=None) for w, us in around.items()}
    form = {w: b if b is not None and words[b] >= 2 * words[w] else None for w, b in best.items()}

    def root(w):
        return root(form[w]) if form[w] else w

    return {(w, form[w], root(w), n, len(around[w]), words[form[w]] if form[w] else None) for w, n in words.items()}


@pytest.mark.parametrize("shard", [50_000, 3])
def test_spelling_variants(spark, docs, clashing, monkeypatch, shard):
    monkeypatch.setattr(spelling, "SHARD", shard)
    monkeypatch.setattr(spelling, "COMPARED", 7)
    monkeypatch.setattr(spelling, "HELD_WORDS", 50)
    rng = random.Random(shard)
    stems = ["".join(rng.choice("abÀéÿ×") for _ in range(rng.choice((4, 5, 6, 9)))) for _ in range(12)] + ["banana", "banàna", "BANANA", "aaaaa", "aaaaaa", "x" * 300, "x" * 299, "x" * 150 + "y" + "x" * 149]
    texts = {i: " ".join(rng.choice(stems) if rng.random() < 0.8 else rng.choice(stems)[1:] for _ in range(60)) + rng.choice((",", "_9", "Ā")) for i in range(60)}
    texts |= {70: None, 71: "", 72: "1 2 ! a b", 73: " ".join(["colour"] * 400 + ["color"] * 3 + ["colours"] * 7 + ["Colöur"] * 4)}
    df = clashing(docs(texts)).withColumn("id", F.lit("q")).withColumn("n", F.lit(3))
    df = df.union(df.where("doc_id = 3").withColumn("doc_id", F.lit(None).cast("long"))).repartition(5)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    for spoil in (0, 5):
        got = {tuple(r) for r in spelling.spelling_variants(spark, df, spoil).collect()}
        assert got == brute_variants(rows, spoil) and len(got) > 15
    assert spelling.spelling_variants(spark, docs([]), 97).count() == 0
    assert spelling.spelling_variants(spark, docs(["one two", None]), 97).count() == 0


def test_one_edit():
    rng = random.Random(5)
    for m in (0, 1, -1):
        a = ["".join(rng.choice("ab") for _ in range(5)) for _ in range(40)]
        b = ["".join(rng.choice("ab") for _ in range(5 + m)) for _ in range(40)]
        i, j = (x.ravel() for x in np.meshgrid(np.arange(40), np.arange(40)))
        got = spelling.one_edit(spelling.letters(a), spelling.letters(b), i, j)
        for x, y, hit in zip(i, j, got):
            s, t = sorted((a[x], b[y]), key=len)
            want = sum(p != q for p, q in zip(s, t)) == 1 if m == 0 else any(t[:k] + t[k + 1 :] == s for k in range(len(t)))
            assert hit == want


def test_roots_of_long_chains(spark):
    from scrivana.llm.common import Scratch

    chain = [(f"w{i}", f"w{i + 1}") for i in range(37)] + [(f"s{i}", "w5") for i in range(200)]
    got = dict(tuple(r) for r in spelling.roots(spark.createDataFrame(chain, "word string, form string"), Scratch(spark, "t")).collect())
    assert len(got) == 237 and set(got.values()) == {"w37"}


# main texts


@pytest.fixture(scope="module")
def model():
    return html.fit_model(None)


def test_held_out_pages(model):
    right = found = wanted = 0
    for page, main in labelled_pages(200, seed=31):
        got, want = collections.Counter(model.main_blocks(page)), collections.Counter(" ".join(m.split()) for m in main)
        right += sum(len(k.split()) * n for k, n in (got & want).items())
        found, wanted = found + sum(len(k.split()) * n for k, n in got.items()), wanted + sum(len(k.split()) * n for k, n in want.items())
    assert right / found > 0.99 and right / wanted > 0.97


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>x="</p><p>no"</script></head><body class="no-sidebar">
<div id=wrapper><header class="site-header"><a href="/">Site</a><p>The best site there is</p></header>
<nav><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></nav><div class="cookie-notice">We use cookies on this site. Accept all of them now.</div>
<article class=post><h1>A title &amp; more</h1><p>First &lt;b&gt; line\n  of   <b>text</b>, with <a href="x>y">a link</a> in it.<p>Second&nbsp;paragraph, which no tag ends, is long enough to be read.
<div class="advert"><p>Buy this now. It is really very cheap today.</p></div><p>Short.</p><script>var a = "<p>never</p>";</script>
<ul><li>An item of a list in the article<li>Another item of the list</ul><p>Last paragraph of the article, which says good bye to all.</p>
<section id="comments"><h3>2 comments</h3><div class="comment"><p>I liked this article very much, thank you.</p></div><div class=comment><p>So did I, and my aunt as well.</p></div></section></article>
<aside class="sidebar"><h3>Popular</h3><ul><li><a href=3>Three things</a></ul></aside><form><label>Name</label><input><button>Send</button></form>
<footer>&copy; 2024 the site. All rights reserved.</footer><p style="display:none">Hidden words stand here.</p></div></body></html>"""


def test_page_with_everything(model):
    assert model.main_blocks(PAGE) == [
        "A title & more", "First <b> line of text, with a link in it.", "Second paragraph, which no tag ends, is long enough to be read.", "Short.",
        "An item of a list in the article", "Another item of the list", "Last paragraph of the article, which says good bye to all.",
    ]


def table_truth(page):
    """The generated pages name their article; here that name is taken at its word."""
    inner = page[page.index("<article>") : page.index("</article>")]
    parts = (" ".join(html.entities.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split("</?(?:p|h1)>", inner))
    return "\n\n".join(p for p in parts if p)


def test_main_texts_of_the_table(spark, clashing):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = pages.collect()
    odd = spark.createDataFrame([(-1, "u", None), (-2, "u", ""), (-3, None, "plain words without any mark"), (None, "u", PAGE), (5, "again", rows[0].html), (-4, "u", "<div" * 9), (-5, "u", "<nav><ul><li><a href=x>a</a></ul></nav>")], pages.schema)
    got = html.main_texts(spark, clashing(pages.union(odd))).collect()
    assert len(got) == len(rows) + 7 and all(r.n_chars == len(r.text) for r in got)
    own = {(r.page_id, r.url): r.text for r in got}
    assert sum(own[r.page_id, r.url] == table_truth(r.html) for r in rows) >= 0.99 * len(rows)
    assert own[-1, "u"] == own[-2, "u"] == own[-5, "u"] == "" and own[5, "again"] == table_truth(rows[0].html) and "Last paragraph" in own[None, "u"]
    assert html.main_texts(spark, pages.limit(0)).count() == 0


def test_region_and_tags():
    rng = random.Random(1)
    for _ in range(200):
        scores = [rng.choice((-3, -1, 0, 1, 2.5)) for _ in range(rng.randint(0, 12))]
        start, end = html.best_region(scores)
        assert sum(scores[start:end]) == max([0, *(sum(scores[a:b]) for a in range(len(scores)) for b in range(a, len(scores) + 1))])
    parts = list(html.Scan('a<p title="x>y">b<!-- <p> -->c</P>< d<br/>e<script>"<p>"</script >f<p class="open>g</p>h').parts())
    assert parts == [("text", "a", ""), ("open", "p", ' title="x>y"'), ("text", "b", ""), ("text", "c", ""), ("close", "p", ""), ("text", "< d", ""), ("open", "br", "/"), ("text", "e", ""), ("text", "f", ""), ("open", "p", ' class="open'), ("text", "g", ""), ("close", "p", ""), ("text", "h", "")]


@pytest.mark.parametrize("piece", ["<", "<!--", '<a href="', "<div>", "</div>", "<p><b>", "<ul><li>", "&amp", "<script>", "<a =", "x ", "<table><tr><td>", "<svg>", "<span hidden>", "' = \""])
def test_odd_pages_take_linear_time(model, piece):
    began = time.perf_counter()
    model.main_blocks(piece * 20_000)
    assert time.perf_counter() - began < 12
