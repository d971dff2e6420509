import itertools
import math
import random
import time

import duckdb
import numpy as np
import pytest

from tideline.llm import html as H
from tideline.llm.html_pages import labelled_pages


N = 100_000


def test_marginals_by_brute_force():
    rng = random.Random(1)
    for _ in range(40):
        n = rng.randrange(1, 8)
        parents = [-1] + [rng.randrange(k) for k in range(1, n)]
        x = np.array([[rng.uniform(-2, 2)] for _ in range(n)])
        pair = tuple(tuple(rng.uniform(-3, 1) for _ in range(2)) for _ in range(2))
        model = H.Model(np.ones(1), np.zeros(1), np.ones(1), pair, (0.5, 0.5))
        weight = {s: math.exp(sum(x[k, 0] * s[k] for k in range(n)) + sum(pair[s[parents[k]]][s[k]] for k in range(1, n))) for s in itertools.product((0, 1), repeat=n)}
        total = sum(weight.values())
        want = [sum(w for s, w in weight.items() if s[k]) / total for k in range(n)]
        assert model.marginals(x, parents) == pytest.approx(want)


def test_held_out_pages():
    right = total = 0
    for source in labelled_pages(150, seed=99):
        page = H.parse(source, labelled=True)
        nodes, parents, x = H.features(page)
        y = []
        for r, k in enumerate(nodes):
            y.append(page.label[k] if page.label[k] is not None else y[parents[r]] if r else 1)
        right += sum((c >= 0.5) == bool(v) for c, v in zip(H.default_model().marginals(x, parents), y, strict=True))
        total += len(y)
    assert right >= 0.99 * total


PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style></head><body class=x><script>var a="</p>";</script>
<nav><ul><li><a href=/a>Home</a><li><a href=/b>About</a></ul></nav><div class="cookie-notice"><p>We use cookies on this site.</p></div>
<article><h1>Title &amp; more</h1><p><b>First  block,\n with a <a href=x>link</a>.<br><p>Second&nbsp;block &#233; &lt;b&gt; 1 < 2 &amp x</p>
<div class="ad">Buy now, cheap.</div><!-- <p>gone</p> --><ul><li>One item of a list<li>Another item of it</ul><aside><p>Related things to read</p></aside>loose text of the article</article>
<form><label>Your name</label><input><button>Send</button></form><section id="comments"><div class="comment"><p>I like this very much, thanks.</p></div></section>
<footer>&copy; 2024</footer></body></html>"""


def test_page():
    assert H.main_text(PAGE).split("\n") == ["Title & more", "First block, with a link.", "Second block é <b> 1 < 2 & x", "One item of a list", "Another item of it", "loose text of the article"]


def test_broken_pages():
    assert H.main_text("<article><p>Some words stand here</p><p>and the rest is cut<p cla") == "Some words stand here\nand the rest is cut"
    assert H.main_text("<article><p>Quote \"x <a title='>'>y</a> z' in text</p></article>") == "Quote \"x y z' in text"
    for odd in ("<", "<>", "</p></b>", "<p a=\"b>", "<!--", "<script>", "&", "<a" * 50, "<div>" * 3000 + "x", "plain words only", "\x00"):
        assert isinstance(H.main_text(odd), str)


def test_attributes_of_untrusted_pages():
    words = "<p>Some words of the article stand here.</p>"
    want = H.main_text(f"<article><h1>Title</h1>{words}</article>")
    for attr in ('data-y="a"', 'data-y=""', 'data-y="0"', "data-y", 'data-id="comments" data-class=footer', "title='class=\"ad\" id=sidebar'", 'x="a>b" =y'):
        assert H.main_text(f"<article {attr}><h1 {attr}>Title</h1>{words}</article>") == want
    assert H.parse('<div title="class=ad" CLASS="a b" id=c role>x</div>').words[1] == ["a", "b", "c"]
    assert H.parse('<div data-y="1">x</div>').label == [None, None]


@pytest.mark.parametrize("source", ["<b>" * N + "</i>" * N, "<i><table>" + "<b>" * N + "</i>" * N, "<b>" * N + "<div></div>" * N, "<ul>" + "<b>" * N + "<li>" * N, "<head>" * N, "<div>" * N + "</div>" * N, "<i>" * N + "<p>x" + "</i>" * N])
def test_time_is_in_proportion_to_the_page(source):
    began = time.time()
    assert isinstance(H.main_text(source), str)
    assert time.time() - began < 20


def test_frames(spark):
    rows = [(1, "u", PAGE, 5), (1, "u", PAGE, 5), (2, None, None, 6), (None, "v", "", 7), (3, "w", "<article><p>" + "long text here. " * 100_000 + "</p></article>", 8)]
    got = H.extract(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")).collect()
    assert sorted(str(r.page_id) for r in got) == ["1", "1", "2", "3", "None"]
    assert all(r.n_chars == len(r.text) for r in got) and [r.text for r in got if r.page_id in (2, None)] == ["", ""]
    assert next(len(r.text) for r in got if r.page_id == 3) == 16 * 100_000 - 1
    assert H.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_sql_agrees(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{sf}/pages.parquet'")
    assert sorted(map(tuple, H.op6_main_text(spark, sf).collect())) == sorted(con.execute(H.OP6_SQL).fetchall())
