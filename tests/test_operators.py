"""Operators of the audit against literal vectors and plain Python."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from webweft.functions import labels as L
from webweft.functions import links, net
from webweft.functions import url as U
from webweft.functions import verdicts as V
from webweft.operators import export, extract, fold, hosts, lifecycle, reports, resolve, rules, sources, state

from .test_addresses import is_private

BASE = "https://ex.org/b/c?x=1"


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.o for r in df.select("i", expr(F.col("v")).alias("o")).orderBy("i").collect()]


def test_normalised(spark):
    cases = {
        "HTTP://Ex.ORG:80/%7euser/%2fb/./a/../c?utm_source=x&b=%2f&gclid=1&a=1#f": "http://ex.org/~user/%2Fb/c?b=%2F&a=1",
        "../up": "https://ex.org/up",
        "?q=2": "https://ex.org/b/c?q=2",
        "//other.org": "https://other.org/",
        "java\nscript:alert(1)": None,
        "&#106;avascript:1": None,
        "https://e.org/?a=1&amp;ttclid=2&amp;gclsrc=3": "https://e.org/?a=1&gclsrc=3",
        "https://e.org/?%75tm_source=1&a%2Bb=2": "https://e.org/?a%2Bb=2",
        "https://e.org/?section=1&sect=2": "https://e.org/?section=1&sect=2",
        "https://bücher.example/": "https://xn--bcher-kva.example/",
        "https://a_b.org:8443": "https://a_b.org:8443/",
        "https://u:p@e.org/a b": "https://e.org/a%20b",
        "mailto:a@b": None,
        "foo:bar": None,
        "#top": None,
        "": None,
    }
    df = spark.createDataFrame(list(enumerate(cases)), "i int, v string")
    got = [r.o for r in U.with_normalised(df, "o", F.col("v"), F.lit(BASE)).orderBy("i").collect()]
    assert got == list(cases.values())
    assert column(spark, list(cases), lambda c: U.normalised(c, F.lit(BASE))) == list(cases.values())
    assert column(spark, ["https://e.org/?utm_x=1&&b"], lambda c: U.normalised(c, strip=False)) == ["https://e.org/?utm_x=1&b"]


def test_entities(spark):
    cases = {"a&hellip;b": "a…b", "&copy=1": "&copy=1", "&#x1F600;": "😀", "&bogus;": "&bogus;", "&amp;amp;": "&amp;", "&#0;&#xD800;": "&#0;&#xD800;", "x": "x", "&notin;&not;": "∉¬"}
    assert column(spark, list(cases), U.entities_decoded) == list(cases.values())


def test_scheme_kinds(spark):
    cases = {"": "skippable", "#a": "skippable", "a/b": "checkable", "HTTPS://x": "checkable", "tel:1": "skippable", " data:x ": "skippable", "ftp://x": "unknown", "java\tscript:x": "skippable"}
    assert column(spark, list(cases), U.scheme_kind) == list(cases.values())


def test_private_addresses(spark):
    private = "::ffff:127.0.0.1 ::ffff:7f00:1 ::ffff:a9fe:a9fe 64:ff9b::7f00:1 64:ff9b::a9fe:a9fe 64:ff9b::a00:1 2002:7f00:1:: 2002:a9fe:a9fe:: 224.0.0.1 239.255.255.250 ff02::1 192.88.99.1 198.51.100.1 203.0.113.1 240.0.0.1 255.255.255.255 not-an-ip".split()
    public = "64:ff9b::101:101 ::ffff:1.1.1.1 8.8.8.8 2606:4700::1111".split()
    assert column(spark, private, net.private) == [True] * len(private) and column(spark, public, net.private) == [False] * len(public)
    rng = random.Random(3)
    some = [".".join(str(rng.choice([0, 10, 100, 127, 169, 172, 192, 198, 203, 224, rng.randrange(256)]) if k == 0 else rng.randrange(256)) for k in range(4)) for _ in range(3000)]
    assert column(spark, some, net.private_v4) == [is_private(x) for x in some]


def test_labels(spark):
    assert column(spark, ["cURL error 6: Could not resolve host: x (see https://curl.haxx.se/x.html) for https://x", "cURL error 7:", "", "plain"], L.plain_message) == ["Could not resolve host: x", "cURL error 7:", None, "plain"]
    assert column(spark, [200, 204, 302, 418, 599, 999, 700, None], L.http_status_label, "int") == ["Answered normally", "Answered normally", L.ANSWER[302], L.ANSWER_CLASS[4], L.ANSWER_CLASS[5], L.ANSWER[999], L.ANSWER_ELSE, None]
    assert column(spark, ["dns", "", None, "new-code"], L.reason_label) == ["Could not find that domain", None, None, "new-code"]
    df = spark.createDataFrame([(9, 5, 5, " body ", "blk"), (9, 5, 3, "body", None), (9, 5, None, None, None)], "id long, e long, o long, h string, b string")
    args = lambda p: (F.lit("u"), F.col("id"), F.col("e"), F.col("o"), F.col("h"), F.col("b"), p)
    assert [tuple(r) for r in df.select(L.edit_url(*args(False)), L.edit_url(*args(True))).collect()] == [("u#la-field-body", "u#la-ref-9"), ("u#la-block-5", "u#la-ref-9"), ("u", "u#la-ref-9")]


def test_extraction(spark):
    html = """<p id=" top "><a href="/one" name=n>On<b>e</b></a><a name="n">x</a><i id=top></i><craft-entry data-entry-id="7"><a href=/in>i</a></craft-entry><craft-entry data-entry-id=x></craft-entry><i id="2024"></i>"""
    assert links.anchor_names(html) == ["top", "2024", "n"] and links.nested_ids(html) == [7]
    pages = spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")
    assert {r.page_id: r.anchors for r in links.anchors(pages).collect()} == {1: ["top", "2024", "n"], 2: []}
    assert [tuple(r) for r in links.nested(pages).collect()] == [(1, 0, 7)]
    hrefs = ["/a#team", "{entry:12:url}", "{entry:news/x||https://out.org/z}", "{user:3:url}", "mailto:x@y", "ftp://u:p@h/x", "http://", "https://EX.org:443/q", " ", "{asset:5@2:url||x}"]
    found = spark.createDataFrame([(i, h, " Link  text ", "https://ex.org/p/") for i, h in enumerate(hrefs)], "i int, href string, text string, base string")
    own = spark.createDataFrame([("https://ex.org/",)], "base_url string")
    got = {r.i: (r.kind, r.url, r.target_id) for r in extract.records(found, own, fragments=True).collect()}
    assert got == {0: ("internal", "https://ex.org/a#team", None), 1: ("element", "element:12", 12), 2: ("external", "https://out.org/z", None), 5: ("ignored", "ftp://h/x", None), 7: ("internal", "https://ex.org/q", None), 9: ("element", "element:5", 5)}
    rendered = {r.i: (r.kind, r.url) for r in extract.records(found, own, rendered=True).collect()}
    assert 5 not in rendered and rendered[0] == ("internal", "https://ex.org/a")


def test_walk(spark):
    edges = [(2, 1), (3, 2), (1, 3), (4, 3), (9, 8), *[(100 + i, 99 + i) for i in range(1, 20)]]
    nesting = spark.createDataFrame(edges, "element_id long, owner_id long")
    got = {tuple(r) for r in extract.walk(spark.createDataFrame([(1,), (8,), (100,)], "element_id long"), nesting).collect()}
    want = set()
    for root in (1, 8, 100):
        depth, todo = {root: 0}, [root]
        while todo:
            x = todo.pop(0)
            for child, owner in edges:
                if owner == x and child not in depth and depth[x] < extract.DEEPEST:
                    depth[child] = depth[x] + 1
                    todo.append(child)
        want |= {(root, e, d) for e, d in depth.items()}
    assert got == want


def test_rules(spark):
    assert rules.route_pattern("/blog/<slug:[a-z]+>/x.y/") == r"^blog/(?:[a-z]+)/x\.y$" and rules.route_pattern("a/<id>") == "^a/(?:[^/]+)$" and rules.route_pattern("/") is None
    assert not rules.valid(spark, "(") and rules.valid(spark, "a+")
    hosts_ = [{"enabled": False, "host": "x.org"}, {"host": " Ex.org "}]
    df = spark.createDataFrame([("https://a.ex.org/", "a.ex.org"), ("https://bex.org/", "bex.org"), ("https://q/P1", "q"), ("element:1", "")], "u string, h string")
    assert [r.o for r in df.select(rules.rule_for(spark, F.col("u"), F.col("h"), hosts_, [{"pattern": "("}, {"pattern": "/p[0-9]"}]).alias("o")).collect()] == ["Ex.org", None, "/p[0-9]", None]
    assert column(spark, [["A.org", " https://B.org/x ", "", "a.org"]], V.host_list, "array<string>") == [["a.org", "b.org"]]


def test_host_fold(spark):
    """The state of hosts by a plain loop, the learned delay included."""
    rng, rows = random.Random(4), []
    start = dt.datetime(2024, 1, 1)
    for seq in range(900):
        status = rng.choice(["ok", "blocked", "broken", "unreachable", "unreachable", "pending", "ignored"])
        rows.append((f"h{rng.randrange(12)}", start + dt.timedelta(seconds=rng.randrange(90000)), seq, status, 429 if status == "pending" else 500, rng.choice([None, 1, 5, 20, 700, 5000])))
    got = {r.host: r for r in hosts.folded(spark.createDataFrame(rows, "host string, seen_at timestamp_ntz, seq long, status string, http_status int, wait long")).collect()}
    for host in {r[0] for r in rows}:
        fails, delay, until, hostile = 0, None, None, False
        for _, at, _, status, _, wait in sorted((r for r in rows if r[0] == host), key=lambda r: (r[1], r[2])):
            if status in ("ok", "broken", "blocked"):
                fails, until, hostile = 0, None, hostile or status == "blocked"
                delay = delay // 2 if delay is not None and delay // 2 > 250 else None
            elif status == "unreachable":
                fails += 1
                if fails >= 3:
                    until = at + dt.timedelta(seconds=min(900, 60 * 2 ** (fails - 3)))
            elif status == "pending":
                s = min(900, max(1, 60 if wait is None else wait))
                delay, until = max(delay or 0, min(30000, s * 1000)), at + dt.timedelta(seconds=s)
        r = got[host]
        assert (r.consecutive_failures, r.min_delay_ms, r.blocked_until, r.bot_hostile) == (fails, delay, until, hostile), host


def test_verdict_fold_vectors(spark):
    at = dt.datetime(2024, 1, 1)
    log = lambda *steps: spark.createDataFrame([(i, 1, at + dt.timedelta(hours=i), s, r) for i, (s, r) in enumerate(steps)], "check_id long, url_id long, checked_at timestamp_ntz, status string, reason string")
    down, dns = ("unreachable", "timeout"), ("unreachable", "dns")
    assert [(r.status, r.fail_count) for r in fold.fold(log(down, down, ("broken", "http"), ("ok", None))).collect()] == [("ok", 0)]
    assert [(r.status, r.fail_count) for r in fold.fold(log(down, down, down)).collect()] == [("broken", 3)]
    assert [(r.status, r.fail_count) for r in fold.fold(log(dns, dns)).collect()] == [("broken", 2)]
    frozen = spark.createDataFrame([(1, "ignored", "ignored", 0)], "url_id long, status string, reason string, fail_count long")
    assert not fold.fold(log(down), frozen).collect()
    held = spark.createDataFrame([(1, "unreachable", "timeout", 2)], "url_id long, status string, reason string, fail_count long")
    assert [(r.status, r.fail_count) for r in fold.fold(log(down), held).collect()] == [("broken", 3)]


def test_streaming_fold(spark, small, tmp_path):
    """The stream's last states are the batch fold's, whatever the batches."""
    from webweft.sources import bridge
    from webweft.streaming import verdicts

    log = bridge.view(spark, small, "check_log").where("url_id < 40").orderBy("checked_at", "check_id")
    for k, part in enumerate(range(3)):
        log.where(f"check_id div 3400 = {part}").coalesce(1).write.parquet(f"{tmp_path}/in/part{k}")
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    seen = {}

    def keep(batch, _):
        for r in batch.collect():
            seen[r.url_id] = r

    query = verdicts.folded(stream).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    want = {r.url_id: r for r in fold.fold(log).collect()}
    assert seen.keys() == want.keys()
    for k, r in want.items():
        assert all(seen[k][c] == r[c] for c in ("status", "fail_count", "last_checked", "last_ok", "last_broken", "next_check")), (k, seen[k], r)


def test_export_file(spark, small, tmp_path):
    from webweft.sources import bridge

    urls, refs, sites = (bridge.view(spark, small, v) for v in ("urls", "refs", "sites"))
    pages = spark.createDataFrame([], "id long, title string, edit_url string, page_url string")
    lines = export.rows(urls, refs, pages, sites, "broken", [1], element_type="Entry", source="nav")
    export.write(lines, "broken", f"{tmp_path}/out")
    text = "".join(open(f, newline="", encoding="utf-8").read() for f in sorted(str(p) for p in (tmp_path / "out").glob("part-*")))
    import csv
    import io

    assert text.startswith(export.BOM + 'Page,"Edit URL","Page URL"') and text.count(export.EOL) == lines.count() + 1
    rows = list(csv.reader(io.StringIO(text.removeprefix(export.BOM), newline="")))
    assert {len(r) for r in rows} == {16} and rows[0] == export.header("broken")
    assert {r[6] for r in rows[1:]} <= {"'=SUM(A1)", 'say "hi", you', "", "'-5", "'\tx", "Link"}
    assert export.count(urls, refs, "broken", []).first().n == 0


def test_notification(spark):
    found = spark.createDataFrame([(i, f"u{i}", f"h{i}", 404 if i % 2 else None, None if i % 3 else "dns", dt.datetime(2024, 1, 1 + i)) for i in range(3)], "id long, url string, url_hash string, http_status int, reason string, date_last_broken timestamp_ntz")
    body = export.digest(found, "S", "R", most=2).first().body.split("\n")
    assert body[0].endswith("3 broken links came out of it.") and body[2:6] == ["- u2", "  R/url?hash=h2", "- u1 (404)", "  R/url?hash=h1"] and "And 1 more." in body
    assert not export.digest(found, "S", "R", threshold=4).collect()
    assert "one broken link came" in export.digest(found.limit(1), "S", "R").first().body
    assert column(spark, ["a@x, b@x\r\n\n ,c@x "], export.recipients) == [["a@x", "b@x", "c@x"]]
    assert column(spark, ["a<b>&c"], export.slack_text) == ["a&lt;b&gt;&amp;c"]


def test_sources(spark):
    replies = spark.createDataFrame([(200, None, "é" * 3), (200, "text/HTML; x", "a"), (200, "image/png", "b"), (404, "text/html", "c")], "http_status int, content_type string, body string")
    assert [bytes(r.body).decode() for r in sources.readable_pages(replies).collect()] == ["ééé", "a"]
    assert sources.scannable_types([("B", "Zed"), ("Asset", "A"), ("C", "Alpha")]) == ["C", "B"] and sources.scannable_types([("B", "Z")], ["X", "B"]) == ["B"]
    fields = spark.createDataFrame([("b", "Link"), ("A", "Link"), ("c", "Text")], "name string, class string")
    assert [r.name for r in sources.link_fields(fields, ["Link"]).collect()] == ["A", "b"]
    assert sources.settings_errors({"concurrency": 51, "minHostDelayMs": 0, "patterns": [{"pattern": "("}, {"pattern": "(", "enabled": False}]}) == ["concurrency", "("]
    assert sources.list_request({"page": "0", "per_page": "999", "sort": "x", "dir": "asc", "host": "h"}) == {"page": 1, "per_page": 200, "sort": "lastChecked", "descending": False, "filters": {"host": "h"}}
    rows = spark.createDataFrame([(i * 7,) for i in range(200)], "id long")
    assert {r.id: r.chunk for r in sources.chunks(rows, 25, stretch=50).collect()} == {i * 7: i // 25 for i in range(200)}


def test_state(spark):
    urls = spark.createDataFrame([(1, "h1", "ok", None, None), (2, "h2", "ignored", "ignored", None)], "id long, url_hash string, status string, reason string, next_check_after timestamp_ntz")
    ignores = spark.createDataFrame([(5, "url", "h2", "v", None, 1)], "id long, scope string, url_hash string, value string, date_created timestamp_ntz, user_id long")
    chosen = spark.createDataFrame([("h1", "x" * 600, 3, None)], "url_hash string, value string, user_id long, date_created timestamp_ntz")
    new, kept = state.ignored(urls, ignores, chosen)
    assert {r.id: (r.status, r.reason) for r in new.collect()} == {1: ("ignored", "ignored"), 2: ("ignored", "ignored")} and sorted((r.url_hash, len(r.value)) for r in kept.collect()) == [("h1", 500), ("h2", 1)]
    new, kept = state.restored(new, kept, chosen)
    assert {r.id: (r.status, r.reason) for r in new.collect()} == {1: ("pending", "ignored"), 2: ("ignored", "ignored")} and [r.url_hash for r in kept.collect()] == ["h2"]
    assert [t.count() for t in state.reset(urls, ignores)] == [0, 0] and state.due_again(urls, "2024-01-01", True).where("next_check_after is not null").count() == 1


def test_lifecycle(spark):
    scans = lambda *rows: spark.createDataFrame(list(rows), "id long, mode string, status string, date_started timestamp_ntz, date_created timestamp_ntz, date_updated timestamp_ntz")
    at = dt.datetime(2024, 1, 1, 12)
    ago = lambda h: at - dt.timedelta(hours=h)
    due = lambda s, **how: lifecycle.due(s, str(at), **how).first().due
    assert due(scans((1, "full", "complete", ago(30), ago(30), ago(29)))) and not due(scans((1, "full", "complete", None, ago(3), ago(3))))
    assert not due(scans((1, "single", "checking", ago(1), ago(1), ago(0.5)))) and due(scans((1, "single", "checking", ago(9), ago(9), ago(2)))) and not due(scans(), enabled=False)
    busy = scans((1, "full", "checking", ago(1), ago(1), ago(0.5)))
    assert not lifecycle.may_start(busy, "incremental", str(at)).first().allowed and lifecycle.may_start(busy, "single", str(at)).first().allowed


def test_resolving(spark):
    df = spark.createDataFrame([("a%20b", ["a b"]), ("top", []), ("x", ["y"]), (None, ["y"]), ("x", None)], "f string, a array<string>")
    assert [r.o for r in df.select(resolve.fragment_verdict(F.col("f"), F.col("a")).alias("o")).collect()] == ["ok", "ok", "broken", "ok", "ok"]
    addresses = spark.createDataFrame([(1, "https://ex.org/de/x", 1), (2, "https://other.org/de", 1)], "id long, url string, k int")
    bases = spark.createDataFrame([(1, "https://ex.org/"), (2, "https://EX.org/de/"), (3, "https://ex.org/de")], "site_id long, base_url string")
    assert {r.id: r.site_id for r in resolve.site_for(addresses, bases, 9).collect()} == {1: 2, 2: 9}
    off = resolve.urls(addresses.withColumn("site_id", F.lit(1).cast("long")), bases, spark.createDataFrame([], "site_id long, uri string"), [], [], checking=False)
    assert {(r.status, r.reason) for r in off.collect()} == {("ignored", "setting")}


@pytest.mark.parametrize("n", [0, 3])
def test_verdict_counts_zero_filled(spark, n):
    urls = spark.createDataFrame([(i, "ok") for i in range(n)], "id long, status string")
    refs = spark.createDataFrame([(i, 1) for i in range(n)], "url_id long, site_id long")
    got = {r.status: r.n for r in reports.verdict_counts(urls, refs, [1]).collect()}
    assert got == {s: n if s == "ok" else 0 for s in reports.STATUSES}
