import random
import time
from collections import defaultdict
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from quillframe.llm import site_templates as T

NAV = '<nav class="top"><ul><li>Home page of the site</ul></nav>'
FOOT = "<footer>All rights reserved by us &amp; others"


def page(body):
    return f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{NAV}<article>{body}</article>{FOOT}</body></html>"


def test_elements_and_open_tags():
    s = "<div><p>one<p>two <b>bold<br>x</div><ul><li>a<li>b</ul>"
    got = [(n, s[a:b]) for n, a, b in T.parse(s)[0]]
    assert got == [
        ("div", "<div><p>one<p>two <b>bold<br>x</div>"), ("p", "<p>one"), ("p", "<p>two <b>bold<br>x"), ("b", "<b>bold<br>x"), ("br", "<br>"),
        ("ul", "<ul><li>a<li>b</ul>"), ("li", "<li>a"), ("li", "<li>b"),
    ]


@pytest.mark.parametrize("s", ["", "<", "<p", "a < b > c", "</p></div>", "<!-- open", "<script>never closed <p>", "<a href='x>y'>t</a>", "<p/>x", "<![CDATA[x]]>", "<p>" * 3000])
def test_broken_sources_dont_crash(s):
    for _, a, b in T.parse(s)[0]:
        assert 0 <= a <= b <= len(s)
    T.extract(s, set())


class Plain(HTMLParser):
    """Text by the standard library's parser."""

    def __init__(self):
        super().__init__()
        self.out, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("head", "script", "style")
        self.out += ["\n"] if tag in T._BLOCK else []

    def handle_endtag(self, tag):
        self.hidden -= tag in ("head", "script", "style")
        self.out += ["\n"] if tag in T._BLOCK else []

    def handle_data(self, data):
        self.out += [] if self.hidden else [" ".join(("." + data + ".").split())[1:-1] if data.strip() else " "]


def test_text_equals_another_parser_where_nothing_is_removed(spark):
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        p = Plain()
        p.feed(r.html)
        p.close()
        want = [" ".join(x.split()) for x in "".join(p.out).split("\n")]
        assert T.extract(r.html, set())[0].split("\n") == [x for x in want if x]


def frame(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("host", F.lit("x"))


def test_templates_go_and_articles_stay(spark):
    rng = random.Random(1)
    rows = [(k, f"https://a.example/{k}", page(f"<p>own words {k} {rng.random()}")) for k in range(8)]
    rows += [(100 + k, f"http://u@B.example:80/{k}", page(f"<p>few pages {k}")) for k in range(3)]
    got = {r.page_id: r for r in T.extract_text(frame(spark, rows)).collect()}
    assert all(got[k].n_removed == 2 and got[k].text.startswith("own words") and "\n" not in got[k].text for k in range(8))
    assert all(got[100 + k].n_removed == 0 and got[100 + k].host == "b.example" and "rights reserved by us & others" in got[100 + k].text for k in range(3))


def test_counts_equal_brute_force(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    base = pages.select(F.col("page_id").alias("page_key"), T.host_of(F.col("url")).alias("host"), "html")
    got = {(r.host, r.hash): r.n_pages for r in T.templates(base)[1].collect()}
    seen = defaultdict(set)
    for r in base.collect():
        for *_, h in T.subtree_hashes(r.html):
            seen[r.host, h].add(r.page_key)
    assert got == {k: len(v) for k, v in seen.items() if len(v) >= T.MIN_PAGES} and got
    want = {r.page_key: T.extract(r.html, {h for (host, h) in got if host == r.host}) for r in base.collect()}
    assert {r.page_id: (r.text, r.n_removed) for r in T.extract_text(pages).collect()} == want


def test_odd_rows(spark):
    rows = [(1, "https://a.example/", None), (2, "https://a.example/", ""), (3, None, page("x")), (4, "no host", page("y")), (None, "https://a.example/", page("z")), (None, "https://a.example/", page("w"))]
    rows += [(5, "https://a.example/5", page("same"))] * 6 + [(6, "https://a.example/6", "<p>" + "long text " * 100_000)]
    got = T.extract_text(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    assert [(r.text, r.n_removed) for r in got if r.page_id == 1] == [(None, None)] and [r.text for r in got if r.page_id == 2] == [""]
    assert all(r.n_removed == 0 for r in got if r.page_id == 5)  # six copies of one page are one page
    assert T.extract_text(frame(spark, [])).count() == 0


LONG = {
    "open quotes": "<a href=\"x' '" * 70_000, "quotes in turn": "<a \"'<b '\" " * 90_000, "no tag ends": "<a " * 330_000, "names without end": "<a" * 500_000,
    "nested": "<div>" * 50_000 + "x" + "</div>" * 50_000, "ends of nothing": "<div>" * 50_000 + "</span>" * 50_000, "cells in no table": "<span>" * 50_000 + "<td></td>" * 50_000,
}


@pytest.mark.parametrize("name", LONG)
def test_time_is_linear(name):
    seconds = []
    for share in (4, 1):
        s = LONG[name][: len(LONG[name]) // share] if name not in ("nested", "ends of nothing", "cells in no table") else LONG[name].replace("<div>" * 50_000, "<div>" * (50_000 // share)).replace("<span>" * 50_000, "<span>" * (50_000 // share))
        began = time.process_time()
        T.subtree_hashes(s)
        seconds.append(time.process_time() - began)
    assert seconds[1] < 10 and seconds[1] < 12 * seconds[0] + 1  # quadratic time would be minutes


def test_subtrees_have_one_hash_if_they_have_one_source():
    rng = random.Random(3)
    bits = ["<p>", "<div>", "</div>", "</p>", "<b>", "</b>", "text ", "<li>", "<ul>", "</ul>", "<td>", "<br>", "<script>", "</script>", "<!-- c -->", "<a href='y>z'>", "</a>", "<", '"', "&amp;"]
    of_hash, of_source = {}, {}
    for _ in range(4000):
        s = "".join(rng.choice(bits) for _ in range(rng.randrange(60)))
        for a, b, h in T.subtree_hashes(s, 0):
            part = T.collapse(s)[a:b]
            assert of_hash.setdefault(h, part) == part and of_source.setdefault(part, h) == h
    assert len(of_hash) > 5000


def test_short_subtrees_and_shares_are_parameters(spark):
    rows = [(k, f"https://a.example/{k}", f"<ul><li>Home</li><li>own {k}</li></ul><p>{'a paragraph that few pages repeat' if k < 6 else f'other words of page {k} alone'}</p>") for k in range(100)]
    removed = lambda **x: {r.page_id: r.n_removed for r in T.extract_text(frame(spark, rows), **x).collect()}
    assert removed() == {k: int(k < 6) for k in range(100)}
    assert removed(min_share=0.1) == dict.fromkeys(range(100), 0)
    assert removed(min_share=0.1, min_chars=8) == dict.fromkeys(range(100), 1)


def test_pages_dont_move(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    plan = T.extract_text(pages, min_share=0.02)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan and "Join" not in plan


def test_slices_and_the_join_beyond_them_dont_change_the_result(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html")
    odd = frame(spark, [(-k, f"https://large.example/{k}", "".join(f"<p>a paragraph of the large host {j}</p>" for j in range(k % 2, 200))) for k in range(1, 9)]).select("page_id", "url", "html")
    odd = odd.union(odd.where("page_id > -3")).union(frame(spark, [(-9, "no host", page("y")), (None, "https://large.example/", None), (-10, None, "")]).select("page_id", "url", "html"))
    pages = pages.union(odd)
    rows = lambda **x: sorted(map(repr, T.extract_text(pages, min_pages=2, **x).collect()))
    whole = rows()
    assert len(whole) == pages.count() and sum("n_removed=0" not in x for x in whole) > 20
    base = pages.select(F.col("page_id").alias("page_key"), T.host_of(F.col("url")).alias("host"), "html")
    n = {r.host: r["count"] for r in T.templates(base, 2)[1].groupBy("host").count().collect()}
    small = sum(n.values()) - n["large.example"]
    assert n["large.example"] > 150 and small > 60
    size = 16 * max(v for k, v in n.items() if k != "large.example")
    for x in (dict(slice_size=size), dict(slice_size=size // 4), dict(slice_size=16, passes=2), dict(slice_size=16, passes=0)):
        assert rows(**x) == whole
