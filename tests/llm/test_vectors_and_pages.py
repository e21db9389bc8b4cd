import hashlib
import html
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.helpers import edge_docs, empty_docs, random_docs
from weftgraph.llm import html_text, resampling, whitening


def _words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def _features(text, most):
    w = _words(text)
    return [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10_000 for n in range(1, most + 1) for i in range(len(w) - n + 1)]


def _brute_resample(docs, target, most, least=20, percent=10):
    s, t = (Counter(f for text in x for f in _features(text, most)) for x in ([d[1] for d in docs], target))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + 10_000) / ((s[b] + 1) * (t_all + 10_000))))
    out = []
    for doc_id, text in docs:
        own = _features(text, most)
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, own))
        out.append([doc_id, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(_words(text))])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


@pytest.mark.parametrize("most", [1, 2, 3, 5])
def test_resampling_against_brute_force(spark, most):
    docs = random_docs(5, 120)
    target = [t for _, t in random_docs(6, 10)] + [docs[3][1]]
    got = resampling.resample(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(t,) for t in target], "text string"), most=most)
    rows = [(r.id, r.n_features, r.weight, r.score, r["rank"]) for r in got.collect()]
    assert sorted(rows, key=str) == _brute_resample(docs, target, most)


def test_resampling_edge_cases(spark):
    docs, target = edge_docs(spark), ["one two three", None, "", "spam SPAM é"]
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    rows = [tuple(r) for r in resampling.report(docs, bench).collect()]
    plain = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(rows, key=str) == _brute_resample(plain, target, 1)
    none = resampling.report(docs, bench.limit(0)).collect()
    assert sorted(map(tuple, none), key=str) == _brute_resample(plain, [], 1)
    assert resampling.report(empty_docs(spark), bench).collect() == []


def test_ranks_of_equal_scores_in_many_parts(spark, monkeypatch):
    """A third of the rows has one score and one id; parts are many, ranks are whole and in order."""
    monkeypatch.setattr(resampling, "parts_for", lambda spark, rows: 64)
    rows = spark.range(9000).selectExpr("if(id % 3 = 0, 7, id) AS id", "cast(if(id % 3 = 0, 50, id % 100) AS long) AS score", "id AS row")
    got = sorted(resampling.ranked(rows, 9000).collect(), key=lambda r: r["rank"])
    assert [r["rank"] for r in got] == list(range(1, 9001))
    assert [(-r.score, r.id, r.row) for r in got] == sorted((-r.score, r.id, r.row) for r in got)


def test_suffix_order_shows_every_repeat():
    rng = np.random.default_rng(1)
    for n, most in [(0, 1), (1, 3), (400, 1), (400, 2), (400, 3), (400, 7)]:
        ids = rng.integers(0, 4, n)
        order, common = resampling.suffix_order(ids, most)
        keys = [tuple(ids[p : p + most]) + (-1,) * (most - len(ids[p : p + most])) for p in order]
        assert sorted(order) == list(range(n)) and [k for k in keys] == sorted(keys, key=lambda k: [max(x, 0) for x in k]) or n == 0
        for i in range(1, n):
            k = 0
            while k < most and keys[i][k] == keys[i - 1][k] > 0:
                k += 1
            assert common[i] == k


def _article(page):
    body = re.search(r"<article>(.*)</article>", page, re.S)[1]
    parts = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", body)]
    return " ".join(x for x in parts if x)


def test_html_text_of_the_whole_table(spark, sf_dir):
    """Against the articles, cut out by their tags; these pages have no other main text."""
    pages = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/pages.parquet")
    want = {r.page_id: (r.url, _article(r.html)) for r in pages.collect()}
    got = html_text.report(pages).collect()
    assert len(got) == len(want) and all((r.url, r.text) == want[r.page_id] and r.n_chars == len(r.text) for r in got)


PROSE = ["The quick brown fox jumps over the lazy dog, and goes on to run through the whole wood.", "Short one.", "Another paragraph of the story, which is long enough to count &amp; then some more."]
STORY = " ".join(html.unescape(p) for p in PROSE)
PARAGRAPHS = "".join(f"<p>{p}</p>" for p in PROSE)
MENU = '<ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li><li><a href="/c">About</a></li></ul>'
BESIDE = (
    '<div class="cookie-notice"><p>We use cookies to make this site better, please accept all of them now.</p></div>'
    '<div id="sidebar"><p>Most read today: a long list of things that nobody needs to read at all.</p></div>'
    '<div class="ad-slot">Buy now</div><form action="/s"><label>Search the whole site</label><input name="q"></form>'
    '<section class="comments"><p>I do not agree with this story at all, says a reader at great length.</p></section>'
)


@pytest.mark.parametrize(
    "page",
    [
        f"<body><header><h1>Site</h1></header><nav>{MENU}</nav><article><h1>Title</h1>{PARAGRAPHS}</article>{BESIDE}<footer>Imprint</footer>",
        f"<html><body class='has-sidebar'><div id=top class=header>Site</div>{MENU}<main><article><header><h1>Title</h1></header>{PARAGRAPHS}</article>{BESIDE}</main></body></html>",
        f"<body><div class='wrap'><div class='navbar'>{MENU}</div><div class='page'><h1>Title</h1><div class='text'>{PARAGRAPHS}</div></div></div>{BESIDE}<div class=footer>Imprint</div></body>",
        f"<table><tr><td>{MENU}<td><h2>Title</h2>{PARAGRAPHS.replace('</p>', '')}</table>{BESIDE}",
        f"<script>if (a<b) document.write('<p>no</p>')</script><style>p{{}}</style>{MENU}<h1>Title</h1>{PARAGRAPHS}<div>{MENU}</div>",
        f"<form id=aspnet><nav>{MENU}</nav><div><h1>Title</h1>{PARAGRAPHS}</div></form>",
        f"<article><h1>Ti<b>tl</b>e</h1><!-- <p>no</p> --><p>{'<p>'.join(PROSE)}<aside>Aside</aside><div hidden>Hidden</div><button>Press</button></article><p>Beside <a href='x",
        f"<article><h1>Title</h1>{PARAGRAPHS}<p><span class=ad>Advert<p></article><![odd[ x ]]><?php 1 ?><!-- no end <p>no</p>",
    ],
)
def test_html_text_of_other_pages(page):
    assert html_text.main_text(page) == f"Title {STORY}"


@pytest.mark.parametrize("page", ["", " \n", "<nav>Menu</nav>", "<article></article><div>Beside</div>", "<form>Search <input></form>", "<script>var a = '", "<", "</", "<!--", "&", "<a href='"])
def test_html_text_without_main_text(page):
    assert html_text.main_text(page) in ("", page.strip() if page in ("<", "&") else "")


def test_html_text_edge_cases(spark):
    deep = "<div>" * 20_000 + "deep" + "</span></div>" * 20_000
    odd = "<ul>" + "<li>" * 30_000 + "<!--" * 30_000
    long = "<p>" + "word &lt; " * 300_000
    rows = [(1, "u", None), (1, "u", None), (None, None, "<p>x  y\n z</p>"), (2, "u", deep), (3, "u", odd), (4, None, long), (5, "u", "plain text"), (6, "u", "&#x26;&nbsp;&eacute;&am &#xD800;")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "url AS text", "1 AS n_chars", "url AS tag")
    out = html_text.extract(pages)
    assert out.columns == ["page_id", "url", "tag", "text", "n_chars"]
    got = [(r.page_id, r.text) for r in out.collect()]
    assert got == [(1, ""), (1, ""), (None, "x y z"), (2, "deep"), (3, ""), (4, "word < " * 299_999 + "word <"), (5, "plain text"), (6, "& é&am �")]
    assert html_text.report(pages.limit(0)).collect() == []


def _brute_whiten(vectors, components=4):
    x = np.floor(256 * vectors.astype(np.float64)) + 0
    fit = np.unique(x, axis=0)
    values, vecs = np.linalg.eigh(np.cov(fit.T, bias=True))
    values, vecs = values[::-1], vecs[:, ::-1]
    dev = [sum((len(fit) * int(c) - int(s)) ** 2 for c, s in zip(row, fit.sum(0))) for row in x]
    return len(fit), dev, (x - fit.mean(0)) @ vecs[:, :components] / np.sqrt(values[:components]), values[:components] / values.sum()


def _whitened(out):
    rows = out.collect()
    return sorted({(r.vec_id, r.deviation) for r in rows}), {(r.vec_id, r.component): r.whitened for r in rows}, rows


def test_whitening_against_eigh(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/embeddings.parquet").select("vec_id", "embedding")
    table = table.unionByName(table.selectExpr("vec_id + 1000000 AS vec_id", "embedding").limit(150))  # copies weigh nothing
    local = sorted(table.collect(), key=lambda r: r.vec_id)
    n, dev, white, share = _brute_whiten(np.array([r.embedding for r in local], np.float32))
    deviations, got, rows = _whitened(whitening.report(table))
    assert len(rows) == 4 * len(local) and {r.n for r in rows} == {n}
    assert deviations == [(r.vec_id, d) for r, d in zip(local, dev)]
    for c in range(4):
        own = np.array([got[r.vec_id, c + 1] for r in local])
        assert np.allclose(np.abs(own), np.abs(white[:, c]), atol=1e-8) and abs(abs(own @ white[:, c]) - white[:, c] @ white[:, c]) < 1e-6
        assert np.allclose([r.explained for r in rows if r.component == c + 1], share[c], rtol=1e-10)
    assert len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-9


def test_jacobi_keeps_small_eigenvalues():
    """A graded matrix, whose smallest eigenvalues are 16 orders under the largest: relative accuracy, where eigh loses all digits."""
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 8, 33):
        scale = np.logspace(8, -8, n) if n > 1 else np.ones(1)
        core = np.eye(n) + 0.1 * np.ones((n, n))
        values, vectors = whitening.jacobi(core * np.outer(scale, scale))
        inverse, _ = whitening.jacobi(np.linalg.inv(core) / np.outer(scale, scale))
        assert np.allclose(values * inverse[::-1], 1, rtol=1e-9)  # the inverse has the reciprocals
        assert np.allclose(vectors.T @ vectors, np.eye(n), atol=1e-12)
        a = rng.normal(size=(n, n))
        a = a @ a.T
        values, vectors = whitening.jacobi(a)
        assert np.allclose(vectors * values @ vectors.T, a) and np.allclose(values, np.linalg.eigvalsh(a)[::-1])


def test_whitening_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [float(i % 3), float(i % 5) / 7, -0.0], "x") for i in range(40)]
    rows += [(100, None, "x"), (101, [1.0, None, 2.0], "x"), (102, [nan, 1.0, 1.0], "x"), (103, [1.0, inf, 1.0], "x"), (104, [], "x"), (105, [1.0, 2.0], "x"), (None, [0.0, 0.0, 0.0], None), (1, [1.0, 1.0 / 7, 0.0], "x")]
    schema = "vec_id long, embedding array<float>, id string"
    table = spark.createDataFrame(rows, schema).selectExpr("*", "id AS x", "id AS n", "1 AS component")
    out = whitening.report(table).collect()
    assert len(out) == 42 * 3 and {r.n for r in out} == {15} and {r.component for r in out} == {1, 2, 3}
    assert all((r.whitened is None) == (r.component == 3) for r in out)  # the third dimension never varies
    assert out[0].identity_error < 1e-9 and abs(sum({r.component: r.explained for r in out}.values()) - 1) < 1e-9
    one = whitening.report(spark.createDataFrame(rows[:1] * 3, schema)).collect()
    assert len(one) == 9 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one} == {(1, 0, None, 0.0, None)}
    huge = whitening.report(spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e12, 5.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<double>")).collect()
    assert len(huge) == 6 and any(r.deviation is None for r in huge)
    assert whitening.report(table.limit(0)).collect() == []
