"""Page and vector operators against brute force and edge cases."""

import re

import duckdb
import numpy as np
import pytest
import pandas as pd

from flowloom.llm import article, common, descent, hosts, topk


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (5, 5), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in common.components(edges, "a", "b").collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_url_verdicts_equal_the_sql(spark):
    urls = [None, "", "nothing", "http://", "HTTP://WWW.Example.COM/en/x?y#z", "http://example.com/en/", "http://a.net/es/1", "http://a.net",
            "http://bad.org/x", "http://u:p@bad.org:80/x", "http://x.co.uk/1", "a://b.net/fr/#q"] + ["http://bad.org/%d" % i for i in range(40)]
    pages = pd.DataFrame({"page_id": range(len(urls)), "url": urls, "html": ["x"] * len(urls), "host": ["clash"] * len(urls)})
    labels = pd.DataFrame({"doc_id": list(range(len(urls))), "quality": [0 if "bad.org" in (u or "") else 1 for u in urls], "toxic": [0] * len(urls)})
    got = sorted(map(tuple, hosts.judge_urls(spark.createDataFrame(pages), spark.createDataFrame(labels)).collect()))
    con = duckdb.connect()
    con.register("pages", pages)
    con.register("labels", labels)
    assert got == sorted(con.sql(hosts.SQL).fetchall())
    by_id = {r[0]: r for r in got}
    assert by_id[4] == (4, "www.example.com", "/en/x", "www.example.com/en/", "allow") and by_id[5][4] == "block"
    assert by_id[7][1:4] == ("a.net", "", None) and by_id[12][4] == "block"
    none = spark.createDataFrame(labels).limit(0)
    assert {r.verdict for r in hosts.judge_urls(spark.createDataFrame(pages), none).where("rule IS NULL").collect()} == {"allow"}
    assert hosts.judge_urls(spark.createDataFrame(pages).limit(0), none).count() == 0


PAGE = ("<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><ul><li>menu</ul></nav>"
        "<!-- x --><div class=\"ad\">buy</div><header>Site</header><div class='cookie notice'>ok?</div>%s<aside>more</aside>"
        "<form><p>mail</p></form><footer>&copy; foot</footer></body></html>")


def test_article_text(spark):
    rows = [(1, "http://a/1", PAGE % "<article><h1>Head &amp; more</h1><p><b>one\n two<br><p>three</p><div class=comments>hi</div></article>"),
            (2, "http://a/2", PAGE % "<article><h1>Other</h1><p>x &lt; y</p></article>"), (3, None, None), (4, "http://a/3", ""),
            (5, "http://b/1", PAGE % "<div class=body><p>long text of page one</p><p>second</p></div>"),
            (6, "http://b/2", PAGE % "<div class=body><p>quite another text</p></div>"), (7, "http://c", "plain"), (8, "http://c", "<p>cut <b"),
            (2, "http://a/2", PAGE % "<article><h1>Other</h1><p>x &lt; y</p></article>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in article.main_text(pages).collect()}
    assert got[1].text == "Head & more\none two\nthree" and got[1].n_chars == len(got[1].text)
    assert got[2].text == "Other\nx < y"
    assert got[3].text == "" and got[4].text == ""
    assert got[5].text == "long text of page one\nsecond" and got[6].text == "quite another text"
    assert got[7].text == "plain" and got[8].text.startswith("cut")
    assert article.main_text(pages).count() == 9 and article.main_text(pages.limit(0)).count() == 0


LONG = "<h1>Head</h1><p>a long article text</p><p>with two paragraphs</p>"
LONG_TEXT = "Head\na long article text\nwith two paragraphs"


@pytest.mark.parametrize("source,want", [
    ("<div class='layout has-sidebar'><article>%s</article></div>" % LONG, LONG_TEXT),
    ("<div class='post share-enabled'><article>%s</article></div>" % LONG, LONG_TEXT),
    ("<div class='sidebar'><article>%s</article></div>" % LONG, LONG_TEXT),  # it holds the article, whatever its name
    ("<article>%s<section id='comments-policy'><p>policy</p></section></article>" % LONG, LONG_TEXT + "\npolicy"),
    ("<article>%s<section class='comments'><p>reader</p></section></article>" % LONG, LONG_TEXT),
    ("<article>%s</article><div class=reader-comments><article><p>me</p></article></div>" % LONG, LONG_TEXT),
    ("<article>%s</article><article class=comment><p>me too, at some length</p></article>" % LONG, LONG_TEXT),
    ("<article><p>teaser</p></article><article>%s</article>" % LONG, LONG_TEXT),
    ("<article><p>one of two posts</p></article><article><p>two of two posts</p></article>", "one of two posts\ntwo of two posts"),
    ("<p title=it's>before</p><article><p data-x=don't>%s</article>" % LONG, LONG_TEXT),
    ("<article><p title=\"a > b\">x > y</p><p title='<p>'>z</p></article>", "x > y\nz"),
    ("<main>%s<label>Name</label><div class='ad-box'>buy</div></main>" % LONG, LONG_TEXT),
    ("<form id=page>%s<div class=ad>buy</div></form>" % LONG, LONG_TEXT),
    ("<nav><p>menu</p></nav><div class='cookie-notice'>ok?</div>%s<aside><p>more</p></aside>" % LONG, LONG_TEXT),
])
def test_articles_are_not_lost(source, want):
    _, blocks = article.read_page("<html><body>" + source + "</body></html>")
    assert article.fill(blocks, set(), set()) == want


def test_copies_on_a_host_keep_their_article(spark):
    body = "<html><body><nav><p>menu</p></nav><div class=body>%s</div></body></html>"
    rows = [(i, "http://two/%d" % i, body % LONG) for i in range(2)] + [(10 + i, "http://many/%d" % i, body % LONG) for i in range(6)]
    rows += [(30, "http://many/x", body % "<p>quite different</p>"), (40, "http://near/1", body % (LONG + "<p>1</p>")), (41, "http://near/2", body % LONG)]
    got = {r.page_id: r.text for r in article.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == LONG_TEXT for i in (0, 1, 10, 15, 41)) and got[30] == "quite different" and got[40]


def vectors(spark, seed=1):
    g = np.random.default_rng(seed)
    x = g.standard_normal((400, 16))
    for k in range(0, 60, 3):
        x[k + 1] = x[k] + 0.05 * g.standard_normal(16)
    x[200:260] = x[199] + 0.04 * g.standard_normal((60, 16))
    x[300:310] = x[299]
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)]
    rows += [(1000, None, 0), (1001, [0.0] * 16, 0), (1002, [float("nan")] * 16, 0), (1003, [1.0, None], 0), (1004, [], 0), (1100, [1.0, 2.0], 0)]
    return x, spark.createDataFrame(rows, "vec_id long, embedding array<double>, links int").repartition(4)


def test_top_k_by_brute_force(spark):
    x, df = vectors(spark)
    z = np.floor(1024 * x)
    got = {}
    for r in topk.top_k(df.where("vec_id % 20 = 0"), df, 10, data_rows=150).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert set(got) == {*range(0, 400, 20), 1100} - {1100}
    for q in range(0, 400, 20):
        s = z @ z[q]
        order = [i for i in np.lexsort((np.arange(400), -s)) if i != q][:10]
        assert [got[q][k + 1] for k in range(10)] == [(i, int(s[i])) for i in order]
    assert topk.top_k(df.limit(0), df).count() == 0


def test_huge_components_stay_exact():
    q, x = np.array([[1 << 40, 3]]), np.array([[1 << 20, 5], [1 << 20, 4], [-(1 << 40), 0]])
    assert topk.top_in_block(q, np.array([7]), x, np.array([1, 2, 3]), 2) == [(7, 1, (1 << 60) + 15), (7, 2, (1 << 60) + 12)]
    assert topk.top_in_block(q, np.array([7]), x[2:], np.array([3]), 2) == [(7, 3, -(1 << 63))]


def test_near_vectors_by_brute_force(spark):
    x, df = vectors(spark)
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    close = y @ y.T >= 0.95
    np.fill_diagonal(close, False)
    got = {r.vec_id: r for r in descent.near_vectors(df).collect()}
    root = np.arange(400)
    for _ in range(20):
        root = np.array([min(root[i], *root[close[i]]) if close[i].any() else root[i] for i in range(400)])
    for i in range(400):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (close[i].sum(), root[i], root[i] == i)
    for i in (1000, 1001, 1002, 1003, 1004, 1100):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert descent.near_vectors(df.limit(0)).count() == 0


def test_recall_on_the_given_embeddings(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    got = {r.vec_id: r.n_links for r in descent.near_vectors(rows).collect()}
    e = rows.toPandas()
    x = np.stack(e["embedding"].to_list()).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    close = x @ x.T >= 0.95
    np.fill_diagonal(close, False)
    true = close.sum(axis=1)
    assert all(got[i] <= t for i, t in zip(e["vec_id"], true))
    assert sum(got.values()) >= 0.9 * true.sum()


def test_rare_isolated_pairs_are_found(spark):
    g = np.random.default_rng(9)
    x = g.standard_normal((20_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(400):
        side = g.standard_normal(64)
        side -= side @ x[i] * x[i]
        x[10_000 + i] = 0.953 * x[i] + np.sqrt(1 - 0.953 ** 2) * side / np.linalg.norm(side)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    got = {r.vec_id: (r.n_links, r.component_id) for r in descent.near_vectors(df).collect()}
    assert all(got[i] == (0, i) for i in range(400, 10_000))
    assert sum(got[10_000 + i] == (1, i) for i in range(400)) >= 0.97 * 400


def test_components_end_with_the_stars(spark, monkeypatch):
    """No round more than it takes, and no broadcast join of all edges to see that."""
    written = []
    made = common.cut_lineage
    monkeypatch.setattr(common, "cut_lineage", lambda df: written.append(1) or made(df))
    rng = np.random.default_rng(7)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1040)]
    least = {x: x for p in pairs for x in p}
    while True:
        now = dict(least)
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
        if now == least:
            break
    got = {r.node: r.component for r in common.components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()}
    alone = {a for a, b in pairs if a == b}
    assert got == {n: c for n, c in least.items() if n in got} and set(least) - set(got) <= alone
    written.clear()
    common.components(spark.createDataFrame([(1, 2), (1, 3)], "a long, b long"), "a", "b")
    assert len(written) == 2
    written.clear()
    common.components(spark.createDataFrame([(1, 2), (2, 3)], "a long, b long"), "a", "b")
    assert len(written) == 2  # the first round makes the star


def valid_classes(pages, support=0.5, least_pages=2, least_size=2):
    """Valid classes of one host's pages (lists of tokens), with whole vectors and by comparing all orders."""
    seen = {}
    for t in {t for p in pages for t in p}:
        seen.setdefault(tuple(p.count(t) for p in pages), set()).add(t)
    classes = []
    for vector, members in seen.items():
        on = [k for k, n in enumerate(vector) if n]
        if len(on) < max(least_pages, support * len(pages)):
            continue
        order = [t for t in dict.fromkeys(pages[on[0]]) if t in members]
        moved = {t for k in on for t in article.moved_tokens([x for x in pages[k] if x in members], order)}
        classes += [(len(on), [t for t in order if t not in moved])] + [(len(on), [t]) for t in moved]
    size = lambda c: sum(1 if k == "e" else len(x.split()) for k, x in c)
    classes = sorted(((n, size(c), c) for n, c in classes if size(c) >= least_size), key=lambda c: c[:2], reverse=True)

    def cross(a, b):
        for p in pages:
            tuples = []
            for c in (a, b):
                at = [k for k, t in enumerate(p) if t in c]
                tuples.append([at[k:k + len(c)] for k in range(0, len(at), len(c))])
            for x in tuples[0]:
                for y in tuples[1]:
                    row = "".join(w for _, w in sorted([(k, "x") for k in x] + [(k, "y") for k in y]))
                    if "xyxy" in re.sub(r"(.)\1+", r"\1", row) or "yxyx" in re.sub(r"(.)\1+", r"\1", row):
                        return True
        return False

    stay = []
    for _, _, c in classes:
        if not any(cross(c, x) for x in stay):
            stay.append(c)
    return {t for c in stay for t in c}


def test_classes_of_the_template_are_ordered_and_nested(spark):
    def page(k):
        ad = "<div class=x><p>see all of our offers</p></div>"
        body = "<section><h2>part</h2><p>own text %d</p></section>" % k * (1 + k % 3)
        # The offers move; "yes" is one word with a vector of its own; a notice holds the ends of two classes on some pages.
        notice = "<i1>n</i1><dl>a b</dl><ol>c d</ol>" if k % 4 else ""
        rest = "<ul>e f</ul>" if k % 4 else ""
        first, last = (ad, "") if k % 2 else ("", ad)
        return "<body>" + first + notice + body + rest + "<h3>own %d</h3>" % k + "<h3>yes</h3>" * (k % 5 + 1) + last + "<h4>the very end</h4></body>"

    def crossed(k):  # two classes of their own vectors, one inside the other on some pages, crossing on one
        a, b = ["<b1>a a</b1>", "<b2>a b</b2>"], ["<c1>c c</c1>", "<c2>c d</c2>"]
        inner = b if k % 5 else []
        return "".join((a + inner) if k == 1 else a[:1] + inner + a[1:] if k != 3 else [a[0], b[0], a[1], b[1]]) if k != 4 else ""

    import xxhash
    for make in (page, crossed):
        html = [make(k) for k in range(12)]
        pages = spark.createDataFrame([(k, "h", h) for k, h in enumerate(html)] + [(50 + k, None, h) for k, h in enumerate(html)], "_page long, host string, html string")
        got = {r.host: set(r.tokens) | set(r.texts) for r in article.template(pages).collect()}
        want = {x if k == "e" else str(xxhash.xxh64_intdigest(x)) for k, x in valid_classes([article.read_tokens(h)[0] for h in html])}
        share = {t for t in {t for h in html for t in article.read_tokens(h)[0]} if sum(t in article.read_tokens(h)[0] for h in html) >= 6}
        assert got == {"h": want, None: want} and want and len(want) < len(share)


def test_moved_tokens_and_crossings():
    assert article.moved_tokens(list("abab"), list("ab")) == [] and article.moved_tokens(list("aabb"), list("ab")) == ["a", "b"]
    assert article.moved_tokens(list("bcda"), list("abcd")) == ["a"]
    sizes = {"a": 2, "b": 2, "c": 1}
    assert article.crossings("abba", sizes) == set() == article.crossings("abcbaaca", sizes) == article.crossings("aabb", sizes)
    assert article.crossings("abab", sizes) == {("a", "b")} == article.crossings("aaabba" + "abab", sizes)
