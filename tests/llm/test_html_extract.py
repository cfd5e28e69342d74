import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthledger.llm import html_extract as H

SCHEMA = "page_id long, url string, html string, text string"
PAGE = "<html><head><title>T</title></head><body><nav><a>Menu</a></nav><div class='ad'>Buy</div><article><h1>A &amp; B</h1><p>one <b>two</b>\n three<p>four&eacute;</article><section id=comments><p>me too</p></section><footer>end</footer>"


def rows(spark, data, **more):
    df = spark.createDataFrame([(i, u, h, "clash") for i, u, h in data], SCHEMA)
    return {r.page_id: r for r in H.extracted(df, **more).collect()}


def test_article_and_its_blocks():
    assert H.Page(PAGE).kept() == ["A & B", "one two three", "fouré"]


def test_raw_text_and_broken_markup():
    assert H.Page("<script>var x='</p>';</script><p>a<br>b<p>c <i>d</p>e").kept() == ["a b", "c d", "e"]
    assert H.Page("5 < 6 and 7 > 2").kept() == ["5 < 6 and 7 > 2"]
    assert H.Page("<form><input></form><form><main><p>x</main></form>").kept() == ["x"]
    assert H.Page("<p>a</p><!-- <p>no</p> --><div hidden>no</div><div style='display: none'>no</div>").kept() == ["a"]
    assert H.Page("").kept() == []


def test_names_of_what_is_not_main_text():
    noise = ["reader-comments", "commentlist", "adBox", "ADS", "site-header", "cookieBar", "x newsletter-box"]
    assert [n for n in noise if H.Page(f"<div class='{n}'>no</div><p>yes</p>").kept() != ["yes"]] == []
    plain = ["page-with-sidebar", "has-sidebar", "layout-sidebar-left", "commentary", "reads", "article-header"]
    assert [n for n in plain if H.Page(f"<div class='{n}'>yes</div>").kept() != ["yes"]] == []
    assert H.page_of("<div class=widget><article>yes</article></div>").kept() == ["yes"]
    assert H.page_of("<div class=ad>no</div><article></article>").kept() == []


def test_names_do_not_hide_most_of_a_page():
    body = " ".join(f"word{i}" for i in range(80))
    for around in ("div class='two-column right-sidebar'", "aside", "form", "div id=widget"):
        page = H.page_of(f"<{around}><div class=nav>Home About</div><div class=text><p>{body}</p></div></{around.split()[0]}>")
        assert page.kept() == [body]
    assert H.Page("<p>wo<span class=share>no</span>rd, <button>no</button>end</p>").kept() == ["word, end"]
    teasers = "".join(f"<article>teaser {i}</article>" for i in range(5))
    assert body in H.page_of(f"<div class=text><p>{body}</p></div><div>{teasers}</div>").kept()
    assert H.page_of(f"<article><p>{body}</p></article><div>other words</div>").kept() == [body]


def test_tree_weighs_marked_nodes_by_entropy(spark):
    bodies = [" ".join(f"w{i}x{j}" for j in range(40)) for i in range(6)]
    same = " ".join(f"same{j}" for j in range(60))
    data = [(i, f"http://a.example/{i}", f"<div class=sidebar><div>{same}</div></div><div>{b}</div>") for i, b in enumerate(bodies)]
    data += [(10 + i, f"http://b.example/{i}", f"<div class=right-sidebar><div>{b}</div></div>") for i, b in enumerate(bodies)]
    got = rows(spark, data)
    assert [got[i].text for i in range(6)] == bodies and [got[10 + i].text for i in range(6)] == bodies


@pytest.mark.parametrize("sent", [H.SENT, -1])
def test_tree_removes_what_a_site_repeats(spark, sent):
    bodies = [f"<div class=top>Welcome to our lovely site today</div><div class=text>{' '.join(f'w{i}x{j}' for j in range(30))}</div>" for i in range(6)]
    data = [(i, "http://a.example/%d" % i, b) for i, b in enumerate(bodies)]
    data += [(10 + i, "http://a.example/0", bodies[0]) for i in range(5)]  # copies
    data += [(20, "http://alone.example/", bodies[0]), (21, None, bodies[0]), (22, "http://a.example/n", None), (23, "odd", "")]
    got = rows(spark, data, sent=sent)
    for i, b in enumerate(bodies):
        assert got[i].text == " ".join(f"w{i}x{j}" for j in range(30))
    assert got[12].text == got[0].text
    assert got[20].text.startswith("Welcome") and got[21].text.startswith("Welcome")
    assert got[22].text == "" and got[23].text == "" and got[23].n_chars == 0


def test_copies_of_one_page_do_not_remove_each_other(spark):
    got = rows(spark, [(i, "http://b.example/", "<div>the same words</div>") for i in range(20)])
    assert {r.text for r in got.values()} == {"the same words"}


def test_importance_is_entropy_computed_plainly(spark):
    rng = np.random.default_rng(3)
    word = lambda: f"w{rng.integers(40)}"
    data = []
    for i in range(24):
        menu = "".join(f"<li>{x}</li>" for x in ("home", "news", word()))
        body = "".join(f"<p>{' '.join(word() for _ in range(rng.integers(2, 50)))}. And {word()} too.</p>" for _ in range(rng.integers(1, 4)))
        data.append((i, f"http://{'ab'[i % 2]}.example/{i}", f"<div class=x><ul>{menu}</ul></div><div class=y>{body}</div><div>all rights kept here</div>"))
    data += [(100, data[0][1], data[0][2])] * 3  # copies count once
    pages, nodes = {}, {}
    for url, source in {(u, s) for _, u, s in data}:
        for node, ways, features, counts in H.page_of(source, url[7:16]).features():
            nodes[node] = ways
            for f, n in zip(features, counts, strict=True):
                pages.setdefault(node, collections.defaultdict(list))[f].append(n)
    m = {v: sum(len(x) for f, x in at.items() if f % 2 == 0) for v, at in pages.items()}
    entropy = lambda ns: -sum(n / sum(ns) * math.log(n / sum(ns)) for n in ns)
    said = {v: 1 - sum(entropy(x) for x in fs) / (len(fs) * math.log(m[v])) if m[v] > 1 else 1 for v, at in pages.items() if (fs := [x for f, x in at.items() if f % 2])}
    size = {v: sum(sum(x) for f, x in at.items() if f % 2) for v, at in pages.items()}
    want = {}
    for v, at in pages.items():
        styles = [len(x) for f, x in at.items() if f % 2 == 0]
        inside = [u for u, ways in nodes.items() if v in ways and size[u]]
        content = sum(size[u] * said[u] for u in inside) / sum(size[u] for u in inside) if inside else 0
        w = 1 - H.GAMMA ** len(styles)
        want[v] = (m[v], w * entropy(styles) / math.log(m[v]) + (1 - w) * content if m[v] > 1 else 1)
    df = spark.createDataFrame([(u, s) for _, u, s in data], "url string, html string").withColumn("digest", F.xxhash64("html")).withColumn("site", H._site(F.col("url"), F.col("digest")))
    got = {r.node: (r.pages, r.importance) for r in H.importance(df.select("site", "digest", "html").mapInArrow(H._features, H.FEATURES)).collect()}
    assert got.keys() == want.keys() and len(got) > 10
    assert all(got[v][0] == want[v][0] and abs(got[v][1] - want[v][1]) < 1e-9 for v in want)


def test_tree_alone_removes_menus_and_a_teaser_hides_no_body(spark):
    """No element or name of these pages tells what is a menu; without the tree all of it would stay."""
    menu = "<div class=c1><div>Start</div><div>World news</div><div>Contact us</div></div><div class=c2>Terms and so on of this site. Imprint.</div>"
    bodies = [" ".join(f"w{i}x{j}" for j in range(50)) for i in range(8)]
    html = [f"{menu}<div class=c3><article>Teaser {i}</article><p>{b}</p></div>" for i, b in enumerate(bodies)]
    got = rows(spark, [(i, f"http://t.example/{i}", h) for i, h in enumerate(html)])
    for i, b in enumerate(bodies):
        assert b in got[i].text and "World news" not in got[i].text and "Imprint" not in got[i].text
        assert "World news" in " ".join(H.page_of(html[i]).kept())


def test_raw_elements_do_not_close_themselves():
    assert H.Page("<script src=x/>var a=1;</script><style/>p{}</style><p>yes</p><svg/><p>too</p>").kept() == ["yes", "too"]


def test_repeated_ids_and_long_pages(spark):
    long = "<p>" + "word " * 200_000 + "</p>"
    df = spark.createDataFrame([(1, "http://a.example/", "<p>one</p>"), (1, "http://a.example/", "<p>two</p>"), (1, None, long), (None, None, None)], "page_id long, url string, html string")
    assert sorted(r.n_chars for r in H.extracted(df).collect()) == [0, 3, 3, 999_999]


def test_empty_table(spark):
    assert rows(spark, []) == {}
