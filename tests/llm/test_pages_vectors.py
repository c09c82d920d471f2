import html
import re

import numpy as np
import pytest

from tidewell.llm import pages, vectors


def page(article, extra="", host="a.example.org", k=0):
    return f"https://{host}/p{k}?x#y", (
        f'<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">x</a></li></ul></nav>'
        f'<!-- c --><div class="ad">buy {k}</div>{extra}{article}<footer>&copy; 2024</footer></body></html>'
    )


def extract(spark, rows):
    table = spark.createDataFrame([(k, u, h, "kept", 1) for k, (u, h) in enumerate(rows)], "page_id long, url string, html string, host string, n_chars int")
    out = pages.extract_pages(table)
    assert set(out.columns) == {"page_id", "url", "host", "text", "n_chars"}
    return {r.page_id: r.text for r in out.collect()}


def test_articles_are_read_whole_and_alone(spark):
    rows = [page(f"<article><h1>Head &amp; {k}</h1><p><b>Same words<br><p>One  two\n{k}<p>a <i>b</i>c &lt;d&gt;</article>", k=k) for k in range(6)]
    rows += [page("<article><p>x</p><div class=comments><p>no</p></div><aside>no</aside><form>no</form><p hidden>no</p><p>y</article>")]
    rows += [("", None), (None, ""), ("u", "no markup"), ("http://b/", "<p>open <b>end"), ("http://b/", "<article><p>cut off <scr")]
    got = extract(spark, rows)
    for k in range(6):
        assert got[k] == f"Head & {k}\n\nSame words\n\nOne two {k}\n\na bc <d>"
    assert got[6] == "x\n\ny"
    assert [got[k] for k in range(7, 12)] == ["", "", "no markup", "open end", "cut off"]


@pytest.mark.parametrize("rows", [20_000, 0])
def test_fixed_texts_of_a_host_are_left_out_without_an_article(spark, monkeypatch, rows):
    monkeypatch.setattr(pages, "TEMPLATE_ROWS", rows)
    rows = [page(f"<div id=main><p>own words {k}</p></div>", extra="<div class=x1><p>On every page</p></div>", k=k) for k in range(5)]
    rows += [page("<div><p>On every page</p></div>", host="other.example.org")]
    got = extract(spark, rows)
    assert [got[k] for k in range(5)] == [f"own words {k}" for k in range(5)]
    assert got[5] == "On every page"
    assert pages.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_a_text_is_fixed_only_with_an_element_of_its_class_and_one_place(spark):
    body = lambda *parts: "<html><body>" + "".join(parts) + "</body></html>"
    rows = [("http://c/", body("<h2>Menu</h2>", f"<p>own {k}</p>", "<p>shared</p>" if k < 4 else "", "<p>moves</p>" * (k == 0), f"<p>b {k}</p>" * k, "<p>moves</p>" * (k > 0), f"<p>c {k}</p>" * (3 - k % 3), "<div class=w/2><p>box</p></div>" if k > 3 else "", "<h2>Menu</h2>")) for k in range(8)]
    got = extract(spark, rows)
    for k in range(8):
        words = got[k].split("\n\n")
        assert "Menu" not in words and "box" not in words
        assert "moves" in words and ("shared" in words) == (k < 4)


def test_copies_count_once_and_rare_parts_are_found_without_an_article(spark):
    body = lambda k, text, ad="": f"<html><body><h2>Menu</h2><div class=ad>{ad}</div><div id=post-{k}><p>{text}</p><p>end of {text}</p></div></body></html>"
    mirrored = [("http://c/", body(7, "mirrored", ad)) for ad in ("", "", "x", "y", "z")]
    notice = [("http://c/", body(k, f"own {k}").replace("<h2>", "<section class=x1>Closed today</section><h2>")) for k in range(10, 13)]
    rows = mirrored + notice + [("http://c/", body(k, f"own {k}")) for k in range(13, 60)]
    rows += [("http://d/", body(k, "alone", ad)) for k, ad in enumerate("xyz")]
    got = extract(spark, rows)
    assert {got[k] for k in range(5)} == {"mirrored\n\nend of mirrored"}
    for k in range(10, 60):
        assert got[k - 5] == f"own {k}\n\nend of own {k}"
    assert {got[k] for k in range(55, 58)} == {"Menu\n\nalone\n\nend of alone"}


@pytest.mark.parametrize(
    "html, text",
    [
        ('<div class="content no-sidebar"><p>Real text</div>', "Real text"),
        ('<main><div class="x header-offset"><p>All the text</div></main>', "All the text"),
        ('<article><h1 class="article-header">Title</h1><section id="discussion"><p>D</p></section><p class="related-work">R</p></article>', "Title\n\nD\n\nR"),
        ("<p>a</p><svg/><p>b</p><script src=x /><p>c", "a\n\nb\n\nc"),
        ("<p>if x<y then z</p><p>q", "if x<y then z\n\nq"),
        ("<form><article><p>in form</p></article><p>no</form>", "in form"),
        ("<aside><article>teaser</article></aside><article><p>one</article>", "one"),
        ('<div class="site-footer">f</div><div class=comment-list><p>c</div><div>t', "t"),
        ("<article></article><div class=ad>a</div>", ""),
    ],
)
def test_single_pages(html, text):
    assert pages.main_text(html, set(), {}) == text


def test_driver_pages_equal_a_plain_reading(spark):
    """The whole query; its pages hold one article of headings and paragraphs each."""
    where = "/root/testdata/sf0.01"
    got = {r.page_id: (r.text, r.n_chars) for r in pages.op3_pages(spark, where).collect()}
    for r in spark.read.parquet(f"{where}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)</article>", r.html or "", re.DOTALL)
        parts = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", inner[1].replace("<br>", " "))) if inner else []
        text = "\n\n".join(filter(None, (" ".join(html.unescape(p).split()) for p in parts)))
        assert got[r.page_id] == (text, len(text))


def renamed(page):
    """The page without any name that tells an article, a menu, an advert or a footer."""
    for name, other in (("article", "qa"), ("nav", "qb"), ("footer", "qc")):
        page = page.replace(f"<{name}>", f'<div class="{other}">').replace(f"</{name}>", "</div>")
    return page.replace('class="ad"', 'class="qd"')


def test_deduction_finds_the_article_where_no_name_tells(spark):
    """Driver pages whose elements are renamed: with the template each gives the article's text, without it none does."""
    table = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url", "html").where("page_id % 3 > 0")
    want = {r.page_id: r.text for r in pages.extract_pages(table).collect()}
    rows = [(r.page_id, r.url, renamed(r.html)) for r in table.collect()]
    assert not any("<article" in h or "<nav" in h for _, _, h in rows)
    bare = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in pages.extract_pages(bare).collect()}
    off = {r.page_id: r.text for r in pages.extract_pages(bare, deduce=False).collect()}
    assert sum(got[k] == want[k] for k in want) == len(want) > 1600
    assert not any(off[k] == want[k] for k in want)
    plain = {r.page_id: r.text for r in pages.extract_pages(table, deduce=False).collect()}
    assert plain == want


def test_occurrence_vectors_equal_brute_force(spark, small):
    table = spark.read.parquet(f"{small}/pages.parquet").select(pages.F.lit("http://one/").alias("url"), "html")
    found = pages.occurrence_vectors(pages.read_tokens(table)).select("token", "pages", "v1", "v2").collect()
    contents, tokens = pages._tokens([r.html for r in table.collect()])
    vectors = {}
    for content, page in dict(zip(contents, tokens, strict=True)).items():
        for t in page:
            vectors.setdefault(t["token"], {})[content] = t["n"]
    want = {t: tuple(sorted(v.items())) for t, v in vectors.items() if len(v) >= pages.MIN_PAGES}
    assert {r.token for r in found} == set(want)
    classes = lambda key: sorted(sorted(g) for g in {frozenset(t for t in want if key[t] == v) for v in set(key.values())})
    assert classes({r.token: (r.pages, r.v1, r.v2) for r in found}) == classes(want) and len(want) > 5


def brute(rows, threshold):
    ok = [(i, np.array(v, float)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {i: set() for i, _ in rows}
    for a in range(len(ok)):
        for b in range(a):
            (i, x), (j, y) = ok[a], ok[b]
            if len(x) == len(y) and x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= threshold:
                links[i].add(j)
                links[j].add(i)
    root = {}
    for i in sorted(links):
        if i not in root:
            todo = [i]
            while todo:
                x = todo.pop()
                if x not in root:
                    root[x] = i
                    todo += links[x]
    return {i: (len(links[i]), root[i]) for i in links}


@pytest.mark.parametrize("tile, block", [(4096, 8), (7, 2), (3, 1)])
def test_vectors_equal_brute_force(spark, monkeypatch, tile, block):
    monkeypatch.setattr(vectors, "TILE", tile)
    monkeypatch.setattr(vectors, "BLOCK", block)
    monkeypatch.setattr(vectors, "SMALL_TILE", 2 * tile)
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(12):
        c = rng.normal(size=24)
        rows += [c, c, 3 * c, *(c + rng.normal(size=24) * s for s in (0.05, 0.2, 0.3, 0.35, 1))]
    rows = [(k, [float(np.float32(x)) for x in v]) for k, v in enumerate(rows)]
    rows += [(200, None), (201, []), (202, [0.0] * 24), (203, [float("nan")] * 24), (204, [None] + [1.0] * 23), (205, [1.0, 2.0]), (206, [2.0, 4.0]), (207, [float("inf")] * 24)]
    table = spark.createDataFrame([(i, v, 9) for i, v in rows], "vec_id long, embedding array<float>, label int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 123)
    got = {r.id: (r.n_links, r.component) for r in vectors.near_vectors(table).collect()}
    assert got == brute(rows, vectors.THRESHOLD)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "123"
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_no_vectors(spark):
    assert vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    one = vectors.near_vectors(spark.createDataFrame([(4, None)], "vec_id long, embedding array<float>")).collect()
    assert [(r.id, r.n_links, r.component) for r in one] == [(4, 0, 4)]
