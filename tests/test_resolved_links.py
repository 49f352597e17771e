"""Resolution of every anchor: hard cases, stated plainly, against both engines."""

import duckdb

from webweft.plans import registry

BASE = "HTTPS://Ex.org/b/c/?x=1#f"
LINKS = [
    ("/Word", "https://ex.org/Word"),
    ("/aé", "https://ex.org/aé"),
    ("/Ea.", "https://ex.org/Ea."),
    ("/cióngañ,", "https://ex.org/cióngañ,"),
    ("/a/./b/../../../c/", "https://ex.org/c/"),
    ("../up", "https://ex.org/b/up"),
    ("x//y", "https://ex.org/b/c/x//y"),
    ("?q=2&amp;utm_source=a&gclid=1&r=%2f%7e", "https://ex.org/b/c/?q=2&r=%2F~"),
    ("/p?utm_x=1#top", "https://ex.org/p"),
    ("//Other.org:443/%41%zz%e9 b", "https://other.org/A%zz%E9%20b"),
    ("http://u:p@a_b.org:8080", "http://a_b.org:8080/"),
    ("http://[::1]:80/..", "http://[::1]/"),
    ("https://bad host/", None),
    ("ftp://e.org/", None),
    ("mailto:a@b", None),
    ("#top", None),
    ("", None),
]


def test_every_link(spark, tmp_path):
    html = "<p>" + "".join(f'<A class=x href = "{h}">t</A>' for h, _ in LINKS)
    spark.createDataFrame([(1, BASE, html), (2, BASE, "<p>none")], "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    want = [(1, i, u) for i, (_, u) in enumerate(LINKS)]
    got = registry.queries()["resolved_links"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == want
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert sorted(con.sql(registry.oracle_sql()["resolved_links"]).fetchall(), key=lambda r: r[1]) == want


def test_all_rows(spark, small):
    got = registry.queries()["resolved_links"](spark, small)
    assert got.count() == registry._links(spark, small).count() and not got.where("link is null").count()


def test_every_scheme(spark, tmp_path):
    kinds = [("/a", "checkable"), ("HTTP://e.org", "checkable"), (" mailto:a@b", "skippable"), ("#top", "skippable"), ("", "skippable"), ("foo:bar", "unknown")]
    html = "".join(f'<a href="{h}">t</a>' for h, _ in kinds)
    spark.createDataFrame([(1, BASE, html)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = registry.queries()["scheme_kind"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [(1, i, k) for i, (_, k) in enumerate(kinds)]
