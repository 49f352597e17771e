"""The reader of markup, the kinds of values, and the walk, by plain Python; whole tables are compared in test_queries."""

import random
import time
from collections import deque

import pytest
from pyspark.sql import functions as F

from webweft.functions import links
from webweft.operators import content, extract
from webweft.plans import registry

FIELDS = "element_id long, site_id long, field_uid string, field_handle string, pos int, kind string, value string"


@pytest.mark.parametrize("piece", ["<a ", '<a href="x', '<a href="x ', "<!--", "<a href=x>", "<", "</", "</a <", "<script>", "</b>", "<a x='", "<b>", "<div></b>", '<a href="" ', '<a href="&', "<!", "<craft-entry data-entry-id=1>", "<a>x</a>"])
def test_reading_is_linear(piece):
    def took(n):
        began = time.perf_counter()
        links.Text(piece * (n // len(piece)))
        return time.perf_counter() - began

    assert took(1 << 20) < 5
    assert links.Text(None).links() == []


def test_markup():
    page = lambda html, **how: links.page_links(html, **how)
    assert page("<a href=1>x<a href=2>y</a>z</a>") == [("a", "1", "x"), ("a", "2", "y")]
    assert page("<div><a href=1>x</div>y") == [("a", "1", "x")]
    assert page("<div><b><a href=1>x</b>y</a>") == [("a", "1", "x")]
    assert page("<a href=1><div>x</b></span>y</div></a>") == [("a", "1", "xy")]
    assert page("<A HREF = '1' href=2 Title>a &lt; b<!-- c --><i>d</i> < e</A>") == [("a", "1", "a < bd < e")]
    assert page('<a href="?a=1&amp;b=2">x</a') == [("a", "?a=1&b=2", "x")]
    assert page("<a href='x>y'>t") == [("a", "x>y", "t")] and page("<a href='x>y") == [] and page("<a href=x") == []
    assert page("<script><a href=1></script x><a href=2/>") == [("a", "2/", "")]
    assert page("<style><a href=1></style><!--><a href=2>b</a>--><a href=3></a>") == [("a", "2", "b"), ("a", "3", "")]
    assert page("<craft-entry><craft-entry></craft-entry><a href=1></a></craft-entry><a href=2></a><craft-entry/><a href=3></a>") == [("a", "2", ""), ("a", "3", "")]
    assert page("<area href=1 alt=x><img src=2><iframe src=3 title=t></iframe><a name=n>", iframes=True) == [("area", "1", "x"), ("img", "2", ""), ("iframe", "3", "t")]
    assert links.nested_ids("<craft-entry data-entry-id=' 12abc'></craft-entry><craft-entry data-entry-id=0><craft-entry data-entry-id=-3><craft-entry data-entry-id=5><craft-entry data-entry-id=12>") == [12, 5]
    assert links.anchor_names("<i id=b><a name=a id=' b '><a name=''><i id='c d'>") == ["b", "c d", "a"]


def rows(found):
    return sorted((r.pos, -1 if r.n is None else r.n, r.what, r.href, r.target_id, r.text, r.problem) for r in found.collect())


def test_values(spark):
    values = [
        ("html", "<a href=/x>t</a><craft-entry data-entry-id=4></craft-entry>"), ("html", ""), ("html", None), ("text", " HTTPS://a.org/b "), ("text", "a https://b.org"),
        ("link", '{"type":"url","value":"/q","label":null}'), ("link", '{"type":"Entry","value":"{entry:7@2:url}","label":"L"}'), ("link", '{"type":"entry","value":"{entry:x:url}"}'), ("link", "[1]"), ("link", "{"),
        ("links", '[{"type":"a\\\\b\\\\Entry","linkValue":["8"]},{"type":"Entry","linkValue":9.7,"linkText":5},{"type":"Entry","linkValue":{}},{"type":"Url","linkValue":"u"},{"type":"Url"},[],"x",null]'), ("links", "{}"),
        ("relation", '[1,"2",3.0,null,{"a":1}]'), ("nested", "[]"), ("nested", "null"), ("table", '[["http://a.b",1,null,{"c":"http://no.org"}],{"k":"https://c.d"},5,[]]'), ("other", "http://x.y"),
    ]
    frame = spark.createDataFrame([(1, 1, f"u{i}", "f", i, *v) for i, v in enumerate(values)], FIELDS)
    got = rows(content.typed(frame))
    assert got == [
        (0, 0, "link", "/x", None, "t", None), (0, 1, "nested", None, 4, None, None), (3, 0, "link", "HTTPS://a.org/b", None, None, None), (5, 0, "link", "/q", None, None, None), (6, 0, "element", "{entry:7@2:url}", 7, "L", None),
        (8, -1, None, None, None, None, "no type"), (9, -1, None, None, None, None, "not JSON"),
        (10, 0, "element", "element:8", 8, None, None), (10, 1, "element", "element:9", 9, "5", None), (10, 2, "link", "u", None, None, None), (11, -1, None, None, None, None, "not a list"),
        (12, 0, "relation", "element:1", 1, None, None), (12, 1, "relation", "element:2", 2, None, None), (12, 2, "relation", "element:3", 3, None, None),
        (14, -1, None, None, None, None, "not a list"), (15, 0, "link", "http://a.b", None, None, None), (15, 1, "link", "https://c.d", None, None, None),
    ]
    less = rows(content.typed(frame, content.Reading(plain=False, relations=False, excluded=("u0",))))
    assert {r[0] for r in less} == {5, 6, 8, 9, 10, 11, 14}
    assert content.typed(frame.limit(0)).count() == 0


def reached_plain(roots, edges, alive, deepest):
    out = set()
    for root, site in roots:
        todo, depth = deque([(root, 0)]), {root: 0}
        while todo:
            x, k = todo.popleft()
            for y in sorted(edges.get((x, site), ())):
                if k < deepest and y not in depth and (y, site) in alive:
                    depth[y] = k + 1
                    todo.append((y, k + 1))
        out |= {(root, site, e, k) for e, k in depth.items()}
    return out


@pytest.mark.parametrize("deepest", [3, 10])
def test_walk(spark, deepest):
    rng = random.Random(deepest)
    elements = [(i, site, rng.random() < 0.9, rng.choice([True, True, True, False, None]), None, "t") for i in range(40) for site in (1, 2)]
    alive = {(i, site) for i, site, on, here, *_ in elements if on and here is not False}
    edges, fields = {}, []
    for i in range(40):
        for site in (1, 2):
            a, b = [rng.randrange(45) for _ in range(2)], [rng.randrange(45) for _ in range(rng.randrange(2))]
            a = [*a, i + 1] if i < 25 else a[:1]
            edges[i, site] = set(a + b) - {0}
            fields += [(i, site, "u", "f", 0, "html", "".join(f"<craft-entry data-entry-id={x}></craft-entry>" for x in a)), (i, site, "v", "g", 1, "nested", str([x for x in b if x])), (i, site, "w", "h", 2, "link", "{"), (i, site, "x", "no", 3, "nested", "[39]")]
    roots = [(0, 1), (0, 2), (7, 1), (44, 1), (0, 1)]
    frame = spark.createDataFrame(roots, "element_id long, site_id long")
    reached, found = content.walked(frame, spark.createDataFrame(fields, FIELDS), spark.createDataFrame(elements, "id long, site_id long, enabled boolean, enabled_for_site boolean, url string, title string"), content.Reading(excluded=("x",), deepest=deepest))
    want = reached_plain(set(roots), edges, alive, deepest)
    assert {tuple(r) for r in reached.collect()} == want and reached.count() == len(want)
    # A value that cannot be read stops nothing, and each is reported once however many roots reach it.
    bad = content.problems(reached, found).collect()
    assert len(bad) == len({(e, s) for _, s, e, _ in want if e < 40}) and {r.problem for r in bad} == {"not JSON"}


def test_targets(spark):
    elements = spark.createDataFrame([(1, 1, "https://a.org/dir/page", "One"), (2, 1, "/two", " T  wo "), (2, 2, "https://b.org/zwei?utm_source=x", "Zwei"), (3, 1, None, "Three")], "id long, site_id long, url string, title string")
    sites = spark.createDataFrame([(1, "en", "https://a.org/base/"), (2, "de", "https://b.org/")], "site_id long, handle string, base_url string")
    reached = spark.createDataFrame([(1, 1, 5, 1), (3, 1, 5, 1)], "root long, site_id long, element_id long, depth int")
    html = ["next", "{entry:2:url}", "{entry:2@2:url}", "{ENTRY:2@DE:url}", "{entry:2@nowhere}", "{entry:3:url}", "{entry:9@1}", "{user:2:url||/fall}", "{user:2}", "#x", "http://["]
    fields = spark.createDataFrame([(5, 1, "u", "f", 0, "html", "".join(f'<a href="{h}">t</a>' for h in html)), (5, 1, "u", "r", 1, "relation", "[2,3,9]"), (5, 1, "u", "l", 2, "link", '{"type":"entry","value":"{entry:9:url}"}')], FIELDS)
    out = content.links(reached, content.typed(fields), elements, sites).collect()
    got = {(r.root, r.field_handle, r.n): (r.kind, r.site_id, r.url, r.link_text) for r in out}
    assert {k[2]: v for k, v in got.items() if k[:2] == (1, "f")} == {
        0: ("internal", 1, "https://a.org/dir/next", "t"), 1: ("element", 1, "https://a.org/two", "t"), 2: ("element", 2, "https://b.org/zwei", "t"), 3: ("element", 2, "https://b.org/zwei", "t"), 4: ("element", 1, "https://a.org/two", "t"),
        5: ("element", 1, "element:3", "t"), 6: ("element", 1, "element:9", "t"), 7: ("internal", 1, "https://a.org/fall", "t"),
    }
    assert got[3, "f", 0][2] == "https://a.org/base/next"
    assert {k[2]: v for k, v in got.items() if k[:2] == (1, "r")} == {0: ("relation", 1, "https://a.org/two", "T wo"), 1: ("relation", 1, "relation:3", "Three")}
    assert got[1, "l", 0] == ("element", 1, "element:9", None) and len(out) == len(got)
    assert extract.DEEPEST == content.Reading().deepest


@pytest.mark.parametrize("name", ["body_anchors", "reference_tag_parts", "nested_entries", "typed_values"])
def test_work_is_dealt(spark, small, name):
    # The table is one small file, which is one task; the values made of its rows are read in all of them.
    assert registry.queries()[name](spark, small).rdd.getNumPartitions() >= 8


def test_fields_are_read_once(spark, monkeypatch):
    # Everything is a root, so that no level reaches what has not been read.
    written, stored = [], content.stored
    monkeypatch.setattr(content, "stored", lambda df, name: written.append(name) or stored(df, name))
    elements = spark.createDataFrame([(i, 1, True, True) for i in range(1, 5)], "id long, site_id long, enabled boolean, enabled_for_site boolean")
    fields = spark.createDataFrame([(i, 1, "u", "f", 0, "nested", f"[{i % 4 + 1}]") for i in range(1, 5)], FIELDS)
    reached, _ = content.walked(elements.select(F.col("id").alias("element_id"), "site_id"), fields, elements)
    assert {(r.root, r.element_id, r.depth) for r in reached.collect()} == {(r, (r - 1 + k) % 4 + 1, k) for r in range(1, 5) for k in range(4)} and reached.count() == 16
    assert written.count("content") == 1


def test_roots_are_counted_before_the_join(spark):
    reached = spark.createDataFrame([(1, 1, 5, 1), (2, 1, 5, 1)], "root long, site_id long, element_id long, depth int")
    found = spark.createDataFrame([(5, 1, "f", 0, "not JSON")] * 2 + [(6, 1, "f", 0, "not JSON")], "element_id long, site_id long, field_handle string, pos int, problem string")
    out = content.problems(reached, found)
    assert [tuple(r) for r in out.collect()] == [(5, 1, "f", 0, "not JSON", 2)]
    assert not out._jdf.queryExecution().optimizedPlan().toString().startswith("Aggregate")


def test_what_an_address_leans_on(spark):
    hrefs = {"/x": (True, True), "//b.org": (True, True), "&#47;x": (True, True), "x": (True, False), "?q": (True, False), "https://a.org/": (False, False), "#x": (False, False), "": (False, False), "foo:bar": (False, False), "{entry:2:url||/fall}": (False, True), "{user:2:url||/fall}": (True, True), None: (False, False)}
    got = spark.createDataFrame([(h,) for h in hrefs], "href string").select("href", extract.leans(F.col("href")), extract.rooted(F.col("href"))).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == hrefs


def test_bodies_hold_no_text(spark):
    texts = spark.createDataFrame([(1, "<a href=1>x</a><a href=2>y</a><craft-entry data-entry-id=7>"), (2, None), (3, "<img src=3 alt=z>")], "id int, value string")
    assert links.bodies(texts).columns == ["id", "links", "entries"] and links.bodies(texts, links=False).columns == ["id", "entries"]
    got = {r.id: ([tuple(x) for x in r.links], r.entries) for r in links.bodies(texts).collect()}
    assert got == {1: ([("a", "1", "x"), ("a", "2", "y")], [7]), 2: ([], []), 3: ([("img", "3", "z")], [])}
    assert {r.id: r.entries for r in links.bodies(texts, links=False).collect()} == {1: [7], 2: [], 3: []}
