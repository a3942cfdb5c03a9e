"""Exact top-k against all pairs; HTML extraction on pages of many shapes."""

import random
from collections import defaultdict

import numpy as np
import pytest
from conftest import same_rows
from pyspark.sql import functions as F

from tidewind.llm import html, topk
from tidewind.llm import queries as q
from tidewind.llm.oracle import oracle_sql


def test_top_k_matches_sql(spark, sf_dir):
    assert same_rows(q.op1_top_k(spark, sf_dir), oracle_sql()["op1_top_k"], sf_dir) > 0


def brute(rows, k):
    good = [(i, v) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    ints = [(i, [int(np.floor(64.0 * x)) for x in v]) for i, v in good]
    out = []
    for at, (i, a) in enumerate(ints):
        if i is not None and i % 20 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), j is None, j or 0) for other, (j, b) in enumerate(ints) if other != at)
            out += [(i, n, None if none else j, -s) for n, (s, none, j) in enumerate(scored[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize(("query_rows", "candidate_rows", "bits"), [(2048, 8192, 8), (2, 17, 2)])
def test_top_k_by_brute_force(spark, query_rows, candidate_rows, bits):
    rng = random.Random(7)
    rows = [(i, [float(np.float32(rng.choice([rng.gauss(0, 1), 0.5, -3.0, 0.0]))) for _ in range(6)]) for i in range(150)]
    rows += [(300 + i, [0.25] * 6) for i in range(30)]
    rows += [(151, None), (152, []), (153, [1.0, None]), (154, [float("nan")] * 6), (155, [float("inf")] * 6), (None, [1.0] * 6), (160, [1.0, 2.0]), (7, rows[7][1]), (160, [1.0, 2.0]), (40, [9.0] * 6), (40, [9.0] * 6), (40, [9.0] * 6), (60, [8.0] * 6), (180, [])]
    rows += [(None, [50.0] * 6)] * 2 + [(300, [7.0] * 6)] * 9
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"q": F.lit(1), "score": F.lit(2), "rank": F.lit(3)})
    got = topk.top_k(df, F.col("vec_id") % 20 == 0, k=5, query_rows=query_rows, candidate_rows=candidate_rows, bits=bits)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, 5)


def test_top_k_of_huge_components_and_no_rows(spark):
    df = spark.createDataFrame([(0, [1e15, 1.0]), (1, [1e-3, 1.0]), (2, [1e15, 1e15])], "vec_id long, embedding array<double>")
    got = topk.top_k(df, F.col("vec_id") == 0).collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(2, (1 << 63) - 1), (1, 64 * 64)]
    assert topk.top_k(df.limit(0), F.col("vec_id") == 0).count() == 0
    assert topk.top_k(df, F.col("vec_id") == 9).count() == 0


def test_approximations_read_few_vectors():
    """The bounds are tight enough that far fewer exact vectors are read than there are."""
    rng = np.random.default_rng(1)
    x, read = np.floor(64 * rng.normal(size=(5000, 32))), []
    plain = topk._exact
    topk._exact = lambda a, b: (read.append(len(b)), plain(a, b))[1]
    try:
        topk.va_search(x[:20], np.arange(20), x, np.arange(5000), np.arange(5000), 20, 8)
    finally:
        topk._exact = plain
    assert sum(read) < 0.2 * 20 * 5000


def text_of(page):
    return " ".join(t for t, chrome, main in html.blocks(page) if main and not chrome)


CASES = [
    ("<article><h1>T &amp; U</h1><p>a\n  b<br>c</p></article>", "T & U a b c"),
    ("<nav>menu</nav><article>x<div class='ad'>buy <div>now</div></div>y</article><footer>f</footer>", "x y"),
    ('<article>a<script>var t="</p></article>";</script>b<style>p{}</style></article>', "a b"),
    ("<article><p>one<p>two<section class=comments><p>me too</p></section></article>", "one two"),
    ("<article><p>un<b>bro</b>ken <a href='/x>y'>li</a>nk</p></article>", "unbroken link"),
    ("<main><header><a>home</a></header><p>body</p><form><input>name</form><aside>s</aside></main>", "body"),
    ("<nav>never closed<article>kept</article>", "kept"),
    ("<article>cut &am", "cut &am"),
    ("<article>cut <p cla", "cut"),
    ("<article>3 < 4 &lt;b&gt; &#233;&#x41;&nbsp;z</article>", "3 < 4 <b> éA z"),
    ("<article><!-- <p>no</p> -->yes<!-- open", "yes"),
    ("<article><div id=cookie-notice>c</div><div hidden>h</div><span class='share-buttons'>s</span><div class='has-sidebar'>ok</div></article>", "ok"),
    ("<article><div class='article-header'><h1>T</h1></div><p class='social-history'>old</p><div class='card-comment-free'>x</div></article>", "T old x"),
    ("<article><div class='site-header'>s</div><div class='post-comments-list'>c</div><i id=ad-300x250>a</i><div class='related-posts'>r</div>y</article>", "y"),
    ("", ""),
    (None, ""),
]


@pytest.mark.parametrize(("page", "text"), CASES)
def test_article_text(page, text):
    assert text_of(page) == text


def test_repeated_tokens_by_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(60):
        n, length = int(rng.integers(1, 80)), int(rng.choice([2, 4, 8]))
        tokens, page = rng.integers(0, 3, n), np.sort(rng.integers(0, 4, n))
        at = defaultdict(set)
        windows = [i for i in range(n - length + 1) if page[i] == page[i + length - 1]]
        for i in windows:
            at[tuple(tokens[i : i + length])].add(page[i])
        want = np.zeros(n, dtype=bool)
        for i in windows:
            if len(at[tuple(tokens[i : i + length])]) > 1:
                want[i : i + length] = True
        assert (html.repeated_tokens(tokens, page, length) == want).all()


def test_host_boilerplate_goes_where_there_is_no_article(spark):
    boiler = " ".join(f"boiler{i}" for i in range(12))
    rows = [(i, f"http://h.example/{i}", f"<div>{boiler}</div><div>{' '.join(f'own{i}x{k}' for k in range(12))}</div><div>{boiler}!</div>") for i in range(6)]
    rows += [(9, "http://other.example/", f"<p>{boiler}</p>"), (10, None, None), (11, "", ""), (None, "http://h.example/x", "<p>only</p>")]
    rows += [(12, "http://h.example/a", f"<article>{boiler}</article>")] * 2
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit(1), "host": F.lit(2), "part": F.lit(3), "size": F.lit(4)})
    got = {r["page_id"]: r for r in html.extract(df).collect()}
    assert all(got[i]["text"] == " ".join(f"own{i}x{k}" for k in range(12)) and got[i]["n_boilerplate"] >= 12 for i in range(6))
    assert got[9]["text"] == boiler and got[12]["text"] == boiler and got[10]["text"] == got[11]["text"] == "" and got[None]["text"] == "only"
    assert html.extract(df).count() == len(rows) and html.extract(df.limit(0)).count() == 0
    dealt = {r["page_id"]: r["text"] for r in html.extract(df, group_bytes=1500).collect()}
    assert sorted(map(str, dealt)) == sorted(map(str, got))


def test_the_size_of_a_host_changes_no_result(spark):
    words = lambda name, n: " ".join(f"{name}{k}" for k in range(n))
    rows = [(i, f"http://big.example/{i}", f"<div>{words(f'own{i}x', 20)}</div>") for i in range(300)]
    rows[7] = (7, "http://big.example/7", f"<div>{words('foot', 9)}</div><p>{words('own7x', 20)}</p>")
    rows[250] = (250, "http://big.example/250", f"<p>{words('own250x', 20)}</p><div>{words('foot', 9)}</div>")
    rows[260] = (260, "http://big.example/260", f"<p>{words('menu', 8)} a</p><p>{words('own260x', 20)}</p>")
    rows += [(300, "http://big.example/300", f"<article>x</article><p>{words('menu', 8)}</p>"), (301, "http://other.example/", f"<p>{words('own5x', 20)}</p>")]
    rows += [(302 + i, f"http://big.example/copy{i}", f"<p>{words('copy', 30)}</p>") for i in range(40)] + [rows[9]]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    whole, dealt = (sorted((r["page_id"], r["url"], r["text"], r["n_boilerplate"] or 0) for r in html.extract(df, group_bytes=size).collect()) for size in (2 << 20, 700))
    assert dealt == whole and len(whole) == len(rows)
    got = {r[0]: r[2] for r in dealt}
    assert got[7] == words("own7x", 20) and got[250] == words("own250x", 20) and got[260] == words("own260x", 20)
    assert got[9] == words("own9x", 20) and got[301] == words("own5x", 20) and all(got[302 + i] == words("copy", 30) for i in range(40))


def test_html_query_gives_the_articles(spark, sf_dir):
    import html as entities
    import re

    pages = {r["page_id"]: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = q.op2_html(spark, sf_dir).collect()
    assert len(got) == len(pages)
    for r in got:
        found = re.search(r"<article>(.*?)(</article>|\Z)", pages[r["page_id"]]["html"], re.DOTALL)
        want = entities.unescape(re.sub(r"<[^>]*(>|\Z)", " ", found[1])) if found else ""
        assert r["text"] == " ".join(want.split()) and r["n_chars"] == len(r["text"])
