"""The queries with the reference's full rules, against plain Python over the same views."""

import re
from urllib.parse import urlsplit

from webweft.functions import links
from webweft.plans import registry
from webweft.sources import bridge


def read(spark, d, view):
    return bridge.view(spark, d, view).collect()


def run(spark, d, name):
    return registry.queries()[name](spark, d).collect()


def addresses(spark, d):
    base = {s.site_id: s.base_url for s in read(spark, d, "sites")}
    own = {("element", e.element_id): base[e.site_id] + e.uri.replace("__home__", "") for e in read(spark, d, "elements_sites") if e.uri is not None}
    pages = {("page", p.page_id): p.url for p in spark.read.parquet(f"{d}/pages.parquet").select("page_id", "url").collect()}
    bases = [*base.items(), *registry.SUBSITES]
    return {("url", u.id): u.url for u in read(spark, d, "urls")} | own | pages, bases


def test_panel_label(spark, tiny):
    found, bases = addresses(spark, tiny)
    own = {urlsplit(b).hostname for _, b in bases}
    want = {}
    for key, url in found.items():
        parts = urlsplit(url)
        label = (parts.path or "/") + ("?" + parts.query if parts.query else "") if parts.hostname in own else url
        want[key] = label if len(label) <= 44 else label[:26] + "…" + label[-17:]
    got = {(r.source, r.id): r.label for r in run(spark, tiny, "panel_label")}
    assert got == want and any("…" in v for v in got.values()) and any(v.startswith("/") for v in got.values())


def test_site_for_url(spark, tiny):
    found, bases = addresses(spark, tiny)
    want = {}
    for key, url in found.items():
        parts, best, size = urlsplit(url), registry.FALLBACK_SITE, -1
        for site, base in bases:
            b = urlsplit(base)
            path = b.path.rstrip("/")
            if b.hostname == parts.hostname and (path == "" or parts.path == path or parts.path.startswith(path + "/")) and len(path) > size:
                best, size = site, len(path)
        want[key] = best
    got = {(r.source, r.id): r.site_id for r in run(spark, tiny, "site_for_url")}
    assert got == want and {1, 3, 11, 13} <= set(got.values()) and 14 not in got.values()


def test_ignore_verdict(spark, tiny):
    by_hash = {i.url_hash for i in read(spark, tiny, "ignores")}
    hosts, patterns = ([t.strip() for _, on, t in rows if on and t.strip()] for rows in (registry.IGNORE_HOSTS, registry.IGNORE_PATTERNS))
    want = {}
    for u in read(spark, tiny, "urls"):
        rule = next((h for h in hosts if u.host and (u.host == h.lower() or u.host.endswith("." + h.lower()))), None)
        rule = rule or next((p for p in patterns if re.search(p, u.url, re.I)), None)
        want[u.id] = ("ignored", None) if u.url_hash in by_hash else ("ignore-rule", rule) if rule else (None, None)
    got = {r.id: (r.reason, r.rule) for r in run(spark, tiny, "ignore_verdict")}
    assert got == want and len({v for v in got.values()}) >= 4


def test_extract_links(spark, tmp_path):
    html = """<!-- <a href="/no">x</a> --><script>'<a href="/no">'</script><img alt='i' src=/i.png><IFRAME title=f src="/f"></iframe>
<map><area alt="m" href='/m?a=1&amp;b=2'></map><a class=x href='/one'>On<b>e</b></a><a name=n>none</a><a href=/two>Two &amp; <a href="/three">3</a><craft-entry><a href="/nested">n</a></craft-entry><img>"""
    spark.createDataFrame([(1, html), (2, None), (3, "plain")], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(tuple(r) for r in run(spark, str(tmp_path), "extract_links"))
    rest = [("a", "/one", "One"), ("a", "/two", "Two & "), ("a", "/three", "3"), ("area", "/m?a=1&b=2", "m"), ("img", "/i.png", "i")]
    assert got == [(1, k, *r) for k, r in enumerate(rest)]
    assert ("iframe", "/f", "f") in links.page_links(html, iframes=True) and not any(t == "img" for t, _, _ in links.page_links(html, images=False))
