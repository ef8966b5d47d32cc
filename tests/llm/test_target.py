"""HTML extraction, importance resampling and fill-in-middle: against brute force and SQL."""

import hashlib
import html
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest

from sparkgauge.llm import html_extract, infill, queries, resampling

from ..conftest import SMALL, rows

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


@pytest.mark.parametrize("name", ["op12_ngram_resampling", "op13_fill_in_middle"])
def test_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, SMALL).toPandas()
    want = duck.execute(queries.ORACLE_SQL[name]).df()
    assert len(got) and rows(got) == rows(want)


# Fill-in-middle


def infilled(doc_id, text):
    text = text or ""
    units = re.findall(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+", text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(units[x:y]) for x, y in ((0, a), (a, b), (b, n)))
    if not text or any(x in text for x in infill.MARKS) or h[2] % 100 >= 50:
        form, out, sizes = "plain", text, (None, None)
    elif h[3] % 100 < 80:
        form, out, sizes = "spm", f"<S>{s}<P>{p}<M>{m}", (len(p), len(m))
    else:
        form, out, sizes = "psm", f"<P>{p}<S>{s}<M>{m}", (len(p), len(m))
    return (doc_id, n, form, *sizes, hashlib.sha256(out.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_infill_is_brute_force(spark, docs, empty):
    rnd = random.Random(3)
    odd = ["", "  ", "a", " a", "a ", "a  b", "\x0b\x0c x\r\ny ", "é ñ 😀😀 \U0001f600a", "x<S y<P>", "a < S>b <", "<<M><", "<", "P> <S", "  b\u0085c d", "M> a <M", "z" * 50_000, "w " * 20_000]
    odd += ["".join(rnd.choice("ab <>PSM\t\n😀é") for _ in range(rnd.randrange(30))) for _ in range(300)]
    table = spark.createDataFrame([(10_000 + i, t, 1) for i, t in enumerate(odd)], "doc_id long, text string, units int")
    got = infill.digests(table.unionByName(docs.select("doc_id", "text", docs.n_chars.cast("int").alias("units"))))
    want = [infilled(10_000 + i, t) for i, t in enumerate(odd)] + [infilled(r.doc_id, r.text) for r in docs.collect()]
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert {r[2] for r in want} == {"plain", "psm", "spm"}
    assert infill.digests(empty).count() == 0


def test_infill_keeps_columns_and_units(spark):
    table = spark.createDataFrame([(1, "One two.  Three! Four\nfive", "u", "h")], "doc_id long, text string, units string, infill string")
    for unit, n in (("word", 5), ("line", 2), ("sentence", 3), ("character", 26)):
        row = infill.transform(table, unit=unit, rate=100, into="made").first()
        assert (row.units, row.infill, row.made.n) == ("u", "h", n)
        assert row.made.prefix + row.made.middle + row.made.suffix == row.text
    assert infill.transform(table, rate=100).first().infill.form != "plain"


def test_infill_is_native(spark):
    plan = queries.op13_fill_in_middle(spark, SMALL)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


# Resampling


def grams(text, n):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]


def test_suffix_array_runs_are_all_ngrams():
    rnd = random.Random(5)
    for n in (1, 2, 3, 4, 5):
        texts = [" ".join(rnd.choice("abcde") for _ in range(rnd.randrange(40))) for _ in range(30)] + ["", "é Ω x9 é Ω x9", "a"]
        for size in (1 << 20, 24, 5):
            got = []
            for ids, left, owner, words, starts in resampling.word_runs([t.encode() for t in texts], n - 1, size):
                order, lcp = resampling.suffix_array(ids, left, n)
                tails = [tuple(ids[i : i + min(n, left[i])]) for i in order]
                assert tails == sorted(tails)
                for a, b, length in zip(tails, tails[1:], lcp[1:]):
                    assert length == next((k for k, (x, y) in enumerate(itertools.zip_longest(a, b)) if x != y), len(a))
                for at, bucket in resampling.gram_buckets(ids, left, words, n, 997):
                    got += [(int(owner[i]), int(x)) for i, x in zip(at, bucket) if starts[i]]
            want = [(i, zlib.crc32(g.encode()) % 997) for i, t in enumerate(texts) for g in grams(t, n)[1]]
            assert sorted(got) == sorted(want)


def resampled(docs, target, share=25):
    n, buckets = 2, 10_000
    source, aim = np.zeros(buckets, int), np.zeros(buckets, int)
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    for _, t in docs:
        np.add.at(source, [bucket(g) for g in grams(t, n)[1]], 1)
    for t in target:
        np.add.at(aim, [bucket(g) for g in grams(t, n)[1]], 1)
    s, t = float(source.sum() + buckets), float(aim.sum() + buckets)
    gain = [math.floor(1000 * math.log((float(aim[i]) + 1) * s / ((float(source[i]) + 1) * t))) for i in range(buckets)]
    out = []
    for key, text in docs:
        words, runs = grams(text, n)
        weight = sum(gain[bucket(g)] for g in runs) // len(runs) if runs else 0
        h = int(hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append([key, len(runs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)])
    fit = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], -1 if r[0] is None else r[0]))
    rank = {id(r): i + 1 for i, r in enumerate(fit[: share * len(fit) // 100])}
    return sorted((tuple(r[:4]) + (rank.get(id(r)),) for r in out), key=str)


def test_resampling_is_brute_force(spark, docs, empty, monkeypatch):
    target = spark.createDataFrame([("green birds sing near old stone walls",), (None,), ("",), ("The Lazy dog",)], "text string")
    words = [r.text for r in target.collect()]
    some = [(r.doc_id, r.text) for r in docs.collect()]
    many = spark.createDataFrame([(7, some[0][1])] * 400, "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    for size in (4_000_000, 300):
        monkeypatch.setattr(resampling, "SLICE_CHARS", size)
        monkeypatch.setattr(resampling.word_runs, "__defaults__", (size,))
        got = resampling.resample(docs, target)
        assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
        assert sorted(map(tuple, got.collect()), key=str) == resampled(some, words)
    got = resampling.resample(many, target, share=60)
    assert sorted(map(tuple, got.collect()), key=str) == resampled([(7, some[0][1])] * 400 + some, words, 60)
    assert resampling.resample(empty, target).count() == 0
    assert sorted(map(tuple, resampling.resample(docs, target.limit(0)).collect()), key=str) == resampled(some, [])


# HTML extraction


def brute_cut(gain, edges):
    best = None
    for bits in itertools.product((0, 1), repeat=len(gain)):
        cost = sum(abs(g) for g, b in zip(gain, bits) if (g > 0) != bool(b) and g) + sum(c for i, j, c in edges if bits[i] != bits[j])
        best = cost if best is None else min(best, cost)
    return best


def test_minimum_cut_is_brute_force():
    rnd = random.Random(1)
    for _ in range(300):
        n = rnd.randrange(1, 11)
        gain = np.array([rnd.randrange(-6, 7) for _ in range(n)])
        edges = [(i, j, rnd.randrange(1, 5)) for i in range(n) for j in range(i + 1, n) if rnd.random() < 0.4]
        got = html_extract.minimum_cut(gain, edges)
        cost = sum(abs(int(g)) for g, b in zip(gain, got) if g and (g > 0) != b) + sum(c for i, j, c in edges if got[i] != got[j])
        assert cost == brute_cut(gain.tolist(), edges)


PAGES = {
    # page -> main text, as a reader would copy it
    '<html><body><div id="header"><h2>Site</h2></div><div class="sidebar"><p>Side text, long enough to matter. It has sentences.</p></div><div class="layout with-sidebar">'
    '<div class="post-body"><h1>Title</h1><p>First paragraph, with text.</p><div class="ad-box">Buy now</div><p>Second <a href=x>link</a> para<b>graph</b>.<br>End.</p></div>'
    '<div id="comments"><article class="comment"><div class="comment-content"><p>Nice post, I liked it.</p></div></article></div></div><div class="cookie-notice">We use cookies.</div></body></html>':
    "Title First paragraph, with text. Second link paragraph. End.",
    "<main><h1>T</h1><aside><article>Related thing</article></aside><p>Body text here.</p><form><label>Email</label><input><button>Go</button></form><p>x &lt; y &amp;amp; z&nbsp; w</p>"
    "<section class='reader-comments'><h2>Comments</h2><p>I agree with that.</p></section></main><footer>f</footer>": "T Body text here. x < y &amp; z w",
    "<title>t</title><nav><ul><li><a href=a>Home</a><li><a href=b>About</a></ul></nav><p>Plain paragraph with words, as in an article.</p><p>A second one; it is prose as well, of course.</p><footer>&copy; 2020 Foo</footer>":
    "Plain paragraph with words, as in an article. A second one; it is prose as well, of course.",
    "<article><header><h1>Head</h1></header><p>One<p>Two<ul><li>a<li>b</ul><table><tr><td>c<td>d</table><script>var x='</p>';</script><style>p{}</style><!-- no --><p>Three</article><div>after</div>": "Head One Two a b c d Three",
    "<body><div role=navigation>Menu here</div><div role='main'><p>Words of the page.</p></div><div role=contentinfo>Imprint</div>": "Words of the page.",
    "<form id=f><nav>n</nav><main><p>Inside a form that holds the page.</p></main></form>": "Inside a form that holds the page.",
    "": "", "  <p> </p>\n": "", "<!-- open <p>text": "", "<script>if (a<b) {": "", "<nav><a href=x>Menu</a></nav>": "",
}


def test_main_text_of_hand_made_pages(spark):
    for source, want in PAGES.items():
        assert html_extract.main_text(source) == want
    table = spark.createDataFrame([(i, s, "u", 5) for i, s in enumerate(PAGES)] + [(None, None, "u", 5), (0, list(PAGES)[0], "u", 5)], "page_id long, html string, url string, n_chars int")
    weights = html_extract.fit(spark.read.parquet(f"{SMALL}/pages.parquet"))
    got = html_extract.extract(table, weights)
    assert got.columns == ["page_id", "html", "url", "text", "n_chars"]
    want = [(i, t, len(t)) for i, t in enumerate(PAGES.values())] + [(None, "", 0), (0, PAGES[list(PAGES)[0]], len(PAGES[list(PAGES)[0]]))]
    assert sorted(map(tuple, got.select("page_id", "text", "n_chars").collect()), key=str) == sorted(want, key=str)
    assert (html_extract.fit(table.limit(0)) == html_extract.PRIOR).all() and html_extract.extract(table.limit(0), weights).count() == 0
    shown = html_extract.blocks(table, weights).where("page_id = 1 and content").orderBy("place").collect()
    assert " ".join(r.text for r in shown) == PAGES[list(PAGES)[1]]


def test_query_is_the_articles(spark):
    """In the given pages the article's tags are known, so its text is what remains of it."""
    want = []
    for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect():
        inner = r.html[r.html.index("<article>") :].split("</article>")[0]
        parts = [html.unescape(x.replace("<b>", "").replace("<br>", " ")).split() for x in re.split(r"</?(?:p|h1|article)>", inner)]
        text = " ".join(" ".join(x) for x in parts if x)
        want.append((r.page_id, r.url, text, len(text)))
    assert sorted(map(tuple, queries.op11_html_extract(spark, SMALL).collect())) == sorted(want)


def test_long_and_broken_pages_take_linear_time():
    assert html_extract.main_text("<p>word</p><div>other <a>link</a></div>" * 20_000) is not None
    for source in ("<a " * 200_000, "<div>" * 100_000 + "x" + "</span></b></p>" * 50_000, "<!-- " * 200_000, '<a b="' * 100_000, "a & b < " * 100_000):
        html_extract.main_text(source)
