"""The filter against rules tried one by one."""

import duckdb
import pytest

from webweft.llm import queries, sql, url_filter
from webweft.llm.common import table

URLS = [None, "", "no scheme", "http://", "https://ORG", "https://org/", "https://a.b.Example.ORG/es/x?y#z", "https://example.org/es", "https://example.org/en/1", "https://example.org/en/12?a=/es/", "http://x.example.org?q=/es/",
        "http://notexample.org/es/", "http://example.com/fr/", "http://example.com/de/1", "http://com/de/", "http://de.com.evil.net/de/", "http://u@example.com:80/de/", "a://b://c.org/", "http://x.org/" + "p" * 5000, "http://" + "a." * 300 + "com/de/", "http://example.org/\u00e9s/", "http://.org/", "http://org./", "//x.org/"]


def plain(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("#")[0].split("?")[0]
    fit = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h) or not h) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


@pytest.mark.parametrize("size", [url_filter.BROADCAST_BYTES, 0])
def test_small(spark, size):
    urls = spark.createDataFrame([(i % 7, u, "h", "r", 1) for i, u in enumerate(URLS + URLS[:3])], "page_id long, url string, host string, __row string, `a.b` int")
    rules = spark.createDataFrame(list(url_filter.RULES) + [("ORG", "/", "allow"), ("x.org", "/ppp", "block"), ("x.org", "/ppp", "allow"), ("none", None, None), (None, "/never/here", "block"), ("a.com", "", "block")], "host string, path string, verdict string")
    listed = [*url_filter.RULES, ("x.org", "/ppp", "block"), ("", "/never/here", "block"), ("a.com", "", "block")]
    got = url_filter.judged(urls, rules, broadcast_bytes=size)
    assert got.columns == ["page_id", "url", "__row", "a.b", "host", "path", "rule", "verdict"]
    want = [(r.page_id, r.url, "r", 1, *plain(r.url, listed)) for r in urls.collect()]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert url_filter.accepted(urls, rules).count() == sum(w[-1] == "allow" for w in want)


def test_no_rules_and_no_rows(spark):
    urls = spark.createDataFrame([(1, "http://a.org/x"), (1, "http://a.org/x"), (None, None)], "page_id long, url string")
    none = url_filter.fixed_rules(spark).limit(0)
    assert [tuple(r)[2:] for r in url_filter.judged(urls, none).orderBy("page_id").collect()] == [("", "", None, "allow")] + [("a.org", "/x", None, "allow")] * 2
    assert url_filter.digest(urls.limit(0)).count() == 0


def test_no_rows_multiply(spark):
    """One host with all rows, and rules that share it: one row a page comes out."""
    urls = spark.range(3000).selectExpr("id AS page_id", "concat('http://hot.example.org/en/', id) AS url")
    rules = spark.range(500).selectExpr("'example.org' AS host", "concat('/en/', id) AS path", "IF(id % 2 = 0, 'allow', 'block') AS verdict")
    for size in (url_filter.BROADCAST_BYTES, 0):
        got = url_filter.judged(urls, rules, broadcast_bytes=size)
        assert got.count() == 3000
        assert {r.rule for r in got.where("page_id = 2999").collect()} == {"example.org/en/299"}


def test_whole_table(spark, small):
    pages = table(spark, small, "pages")
    got = [tuple(r) for r in url_filter.digest(pages).collect()]
    assert sorted(map(str, got)) == sorted(str((r.page_id, *plain(r.url, url_filter.RULES))) for r in pages.select("page_id", "url").collect())
    assert {r[3] for r in got} >= {"org/", "example.org/es/", "com/fr/", "com/de/"}


@pytest.mark.parametrize("name", sorted(sql.oracle_sql()))
def test_statements(spark, small, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    want = con.sql(sql.oracle_sql()[name])
    got = queries.queries()[name](spark, small)
    assert got.columns == want.columns
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want.fetchall()))
