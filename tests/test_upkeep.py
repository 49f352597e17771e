"""Stored tables, counts, scans, routing and hooks against plain Python; whole tables are compared in test_queries."""

import random
from collections import Counter

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from webweft.functions import verdicts as V
from webweft.operators import counts, export, lifecycle, reports, routing, sources, state
from webweft.sources import store

from .test_operators import column

REF = "id long, url_id long, element_type string, site_id long, source string, link_text string"


def ref_rows():
    return [(i, i % 7 + 1, "Entry", i % 4 + 1, "nav" if i % 3 else "field", None if i % 5 else "t") for i in range(60)]


def stored_rows(spark, path):
    return sorted(map(str, store.read(spark, path).select(*[c.split()[0] for c in REF.split(", ")]).collect()))


def test_replaced(spark, tmp_path):
    path, before = str(tmp_path / "refs"), spark.createDataFrame(ref_rows(), REF)
    store.create(before, path)
    with pytest.raises(PySparkException):
        store.create(before, path)
    new = spark.createDataFrame([(100, 5, "Entry", 2, "nav", "x" * 300), (101, 6, "Asset", 2, "nav", None)], REF)
    want = [r for r in ref_rows() if not (r[3] == 2 and r[4] == "nav")] + [(100, 5, "Entry", 2, "nav", "x" * 255), (101, 6, "Asset", 2, "nav", None)]
    want = sorted(map(str, spark.createDataFrame(want, REF).collect()))
    other = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "refs" / "site_id=3").iterdir()}
    for _ in range(2):  # made again, the same call gives the same table
        store.replaced(spark, path, F.col("source") == "nav", [2], new)
        assert stored_rows(spark, path) == want
    assert other == {p.name: p.stat().st_mtime_ns for p in (tmp_path / "refs" / "site_id=3").iterdir()}
    store.replaced(spark, path, F.lit(True), [3])
    assert stored_rows(spark, path) == [r for r in want if "site_id=3" not in r]


@pytest.mark.parametrize("bad", [(9, None, "Entry", 2, "nav", None), (9, 1, "", 2, "nav", None), (9, 0, "Entry", 2, "nav", None), (9, 1, "Entry", 3, "nav", None), (9, 1, "Entry", 2, "field", None), (9, 1, "Entry", 2, None, None)])
def test_a_failed_replacement_leaves_the_table(spark, tmp_path, bad):
    path = str(tmp_path / "refs")
    store.create(spark.createDataFrame(ref_rows(), REF), path)
    before = stored_rows(spark, path)
    rows = spark.createDataFrame([(8, 1, "Entry", 2, "nav", None), bad], REF)
    with pytest.raises(PySparkException):
        store.replaced(spark, path, F.col("source") == "nav", [2], rows)
    assert stored_rows(spark, path) == before


def test_a_killed_replacement_leaves_the_table(spark, tmp_path):
    """The job ends while tasks write: nothing of it is seen."""
    path = str(tmp_path / "refs")
    store.create(spark.createDataFrame(ref_rows(), REF), path)
    before = stored_rows(spark, path)

    @F.udf("string")
    def dies(i):
        raise RuntimeError("lost")

    rows = spark.range(1000).selectExpr("id", "1L AS url_id", "'Entry' AS element_type", "2L AS site_id", "'nav' AS source").withColumn("link_text", F.when(F.col("id") == 999, dies("id")))
    with pytest.raises(PySparkException):
        store.replaced(spark, path, F.col("source") == "nav", [2], rows)
    assert stored_rows(spark, path) == before
    store.replaced(spark, path, F.col("source") == "nav", [2], rows.withColumn("link_text", F.lit("t")))
    assert store.read(spark, path).where("site_id = 2 and source = 'nav'").count() == 1000


def test_counts_follow_random_changes(spark):
    rng = random.Random(8)
    refs = Counter({(rng.randrange(3), rng.randrange(30)): rng.randrange(1, 4) for _ in range(40)})
    status = {u: rng.choice(["ok", "broken", "pending"]) for u in range(28)}
    frame = lambda: spark.createDataFrame([(k, v) for k, v in status.items()], "id long, status string")
    pairs = spark.createDataFrame([(s, u, n) for (s, u), n in refs.items()], "site_id long, url_id long, refs long")
    held, waiting = counts.counted(pairs, frame()), []
    for turn in range(4):
        changes = []
        for _ in range(25):
            key = (rng.randrange(3), rng.randrange(30))
            n = 1 if refs[key] == 0 or rng.random() < 0.4 else -1
            refs[key] += n
            changes.append((*key, n))
        turned = {u: (status.get(u), rng.choice(["ok", "broken", None])) for u in rng.sample(range(30), 8)}
        pairs, step = counts.moved(pairs, spark.createDataFrame(changes, "site_id long, url_id long, n int"), spark.createDataFrame([(u, *v) for u, v in turned.items()], "url_id long, before string, after string"), frame())
        pairs = spark.createDataFrame(pairs.collect(), pairs.schema)
        waiting.append(spark.createDataFrame(step.collect(), step.schema))
        for u, (_, now) in turned.items():
            status.pop(u, None)
            if now:
                status[u] = now
        if turn % 2:  # two batches are held back and applied together
            held, waiting = counts.applied(held, *waiting), []
            held = spark.createDataFrame(held.collect(), held.schema)
            want = Counter((s, status[u]) for (s, u), n in refs.items() if n > 0 and u in status)
            assert {(r.site_id, r.status): r.n for r in held.collect()} == dict(want)
            assert {(r.site_id, r.url_id): r.refs for r in pairs.collect()} == {k: n for k, n in refs.items() if n > 0}


def test_scans(spark):
    rng, events = random.Random(2), []
    kinds = ["queued", "extracting", "checking", "complete", "failed", "cancelled"]
    for seq in range(600):
        events.append((rng.randrange(12), seq // 3, seq, rng.choice(kinds)))
    rng.shuffle(events)
    frame = spark.createDataFrame(events, "scan_id long, happened int, seq long, event string").withColumn("happened", F.timestamp_seconds("happened"))
    state_, want, started, ended, refused = {}, {}, {}, {}, Counter()
    for scan, at, seq, event in sorted(events, key=lambda e: e[2]):
        before = state_.get(scan)
        if event in ("failed", "cancelled") and before not in ("queued", "extracting", "checking"):
            refused[scan] += 1
            want[seq] = (before, True)
            continue
        state_[scan], want[seq] = event, (event, False)
        if event in ("extracting", "checking"):
            started.setdefault(scan, at)
        if event not in ("queued", "extracting", "checking"):
            ended[scan] = at
    assert {r.seq: (r.status, r.refused) for r in lifecycle.transitions(frame).collect()} == want
    got = lifecycle.histories(frame).select("scan_id", "status", F.unix_timestamp("date_started").alias("a"), F.unix_timestamp("date_finished").alias("b"), "refused").collect()
    assert {tuple(r) for r in got} == {(s, state_.get(s), started.get(s), ended.get(s), refused[s]) for s in {e[0] for e in events}}


def test_routing_counts_in_one_reading(spark, tmp_path):
    rows = [(i, i % 2 == 0, "rule" if i % 7 == 0 else None, [None, "ok", "broken"][i % 3], None, ["broken", None, "ok"][i % 3 - 1], None, 60 if i % 11 == 0 else None) for i in range(500)]
    schema = "id long, is_internal boolean, ignored string, own_status string, own_reason string, answer_status string, answer_reason string, wait long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/in")
    out, seen = routing.routed(spark.read.parquet(f"{tmp_path}/in"))
    assert out._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    out.write.parquet(f"{tmp_path}/out")
    back = spark.read.parquet(f"{tmp_path}/out")
    assert seen.get == {"checked": back.where("status is not null").count(), "broken": back.where("status = 'broken' and way <> 'ignored'").count()}
    assert 0 < seen.get["broken"] < seen.get["checked"] < 500
    by = {r.id: r for r in back.collect()}
    for i, internal, ignored, own, _, answer, _, wait in rows:
        way = "ignored" if ignored else "own" if internal and own else "request"
        status = {"ignored": "ignored", "own": own, "request": None if wait else answer}[way]
        assert (by[i].way, by[i].status, by[i].seconds) == (way, status, wait if way == "request" else None)


def test_hooks(spark):
    found = spark.createDataFrame([(1, "u", "ok", None), (2, "v", "broken", "http"), (3, "w", "ok", None)], "id long, url string, status string, reason string")
    said = lambda rows: lambda t: t.sparkSession.createDataFrame(rows, "id long, status string, reason string")
    out = routing.overridden(found, [said([(2, "ok", None), (9, "ok", None)]), lambda t: t.where("status = 'ok' and id > 1").select("id", F.lit("blocked").alias("status"), F.lit("mine").alias("reason"))])
    assert sorted(map(tuple, out.collect())) == [(1, "u", "ok", None), (2, "v", "blocked", "mine"), (3, "w", "blocked", "mine")]
    assert routing.overridden(found, []) is found
    for rows in ([(1, "ok", None), (1, "ok", None)], [(1, "fine", None)], [(1, None, None)]):
        with pytest.raises(PySparkException):
            routing.overridden(found, [said(rows)]).collect()
    with pytest.raises(ValueError):
        routing.overridden(found, [lambda t: t.select("id", "status")])
    with pytest.raises(TypeError):
        routing.overridden(found, [lambda t: t.withColumn("id", F.col("id").cast("string"))])


def test_answers(spark):
    now = F.lit("2024-03-01 00:00:00").cast("timestamp")
    dates = {" 120 ": 120, "Fri, 01 Mar 2024 00:02:00 GMT": 120, "Friday, 01-Mar-24 00:02:00 GMT": 120, "Fri Mar  1 00:02:00 2024": 120, "Fri, 01 Mar 2024 01:02:00 +0100": 120, "2024-03-01T00:02:00Z": 120, "2024-02-29T19:02:00-05:00": 120, "1 Mar 2024 00:02:00": 120, "Thu, 29 Feb 2024 00:00:00 GMT": 0, "Sunday, 06-Nov-94 08:49:37 GMT": 0, "9999999999": 86400, "soon": None, "": None, "-5": None, "Fri, 99 Mar 2024 00:02:00 GMT": None, None: None}
    assert column(spark, list(dates), lambda c: V.retry_after(c, now)) == list(dates.values())
    bodies = ["AÉ" * 2000, "x" * 2047 + "é", "Ab", "", None]
    got = column(spark, bodies, lambda c: V.body_snippet(c, F.lit(403), F.lit("GET")))
    assert got == ["aÉ" * 682 + "a\ufffd", "x" * 2047 + "\ufffd", "ab", None, None]
    hops = spark.createDataFrame([([301, 302], ["a", "b"]), ([302], ["a", "b", "c"]), ([], ["a"]), ([], []), (None, None)], "chain array<int>, targets array<string>")
    assert [tuple(r.r) for r in hops.select(V.redirect_info(F.col("chain"), F.col("targets")).alias("r")).collect()] == [(2, "b", True, 301), (3, "c", False, 302), (1, "a", False, None), (0, None, None, None), (0, None, None, None)]


def test_panel_of_an_owner(spark):
    urls = spark.createDataFrame([(i, f"u{9 - i}", f"h{i}", "broken" if i < 5 else "pending", 404, None) for i in range(7)], "id long, url string, url_hash string, status string, http_status int, date_last_checked timestamp")
    refs = spark.createDataFrame([(1, 0, 10, None, "f", 1), (2, 0, 11, 10, "g", 1), (3, 1, 11, 10, "g", 1), (4, 2, 12, 10, None, 1), (5, 5, 12, 10, "f", 1), (6, 3, 10, None, "f", 2), (7, 4, 10, 10, "f", 1)], "id long, url_id long, element_id long, owner_element_id long, field_handle string, site_id long")
    (panel,) = reports.element_panel(urls, refs, 1, most=2, element_id=10).collect()
    assert (panel.page_id, panel.total, panel.checked, panel.broken, panel.pending, panel.ok) == (10, 5, 4, 4, 1, 0)
    assert [(b.url, b.ref_id, b.block_id, b.field_handle) for b in panel.broken_urls] == [("u5", 7, None, "f"), ("u7", 4, 12, None)]
    assert {r.page_id: r.total for r in reports.element_panel(urls, refs, 1).collect()} == {10: 5, 11: 2, 12: 2}


def test_message(spark):
    found = spark.createDataFrame([(1, "https://a.org/?a&b", "h", 404, None, None)], "id long, url string, url_hash string, http_status int, reason string, date_last_broken timestamp_ntz")
    (m,) = export.messages(found, "S <1>", "R").collect()
    assert m.subject == "One broken link on S <1>" and m.slack.startswith('{"username":"Link Audit","text":"*One broken link on S &lt;1&gt;*\\nThe link scan on S &lt;1&gt; has')
    assert "a&amp;b" in m.slack and export.messages(found.union(found), "S", "R").first().subject == "2 broken links on S" and not export.messages(found.limit(0), "S", "R").collect()


def test_settings():
    good = {"concurrency": "50", "timeout": 300, "maxRedirects": 0, "okTtlDays": 3650, "notifyBrokenThreshold": 10**9, "checkImages": "1", "verifySsl": False, "proxy": "", "excludedFieldUids": ["a"], "scannedElementTypes": "", "ignorePatterns": [{"pattern": "a+"}], "userAgent": None}
    assert sources.settings_errors(good) == []
    bad = {"concurrency": 0, "timeout": "1.5", "maxRedirects": True, "okTtlDays": 3651, "notifyBrokenThreshold": 0, "checkImages": "yes", "proxy": 5, "excludedFieldUids": [1], "ignorePatterns": [{"pattern": "("}], "internalUrlAllowPatterns": [{"pattern": "[", "enabled": False}], "unreachableRecheckHours": -1}
    assert sorted(sources.settings_errors(bad)) == sorted(["(" if k == "ignorePatterns" else k for k in bad if k != "internalUrlAllowPatterns"])


def test_addresses_of_an_element(spark):
    es = spark.createDataFrame([(5, 1, "__home__"), (5, 2, "a/b"), (5, 3, None), (5, 4, "x"), (6, 1, "y")], "element_id long, site_id long, uri string")
    sites = spark.createDataFrame([(1, "https://a.org/"), (2, "https://B.org/base"), (3, "https://c.org/"), (4, None)], "site_id long, base_url string")
    got = state.addresses_of(es, sites, spark.createDataFrame([(5,), (5,)], "element_id long"))
    want = spark.createDataFrame([("element:5",), ("relation:5",), ("https://a.org/",), ("https://b.org/base/a/b",)], "u string").select(F.sha1("u")).collect()
    assert sorted(r.url_hash for r in got.collect()) == sorted(r[0] for r in want)


def test_addresses_are_dealt(spark):
    # Joined to few tasks by their packed bytes, millions of narrow rows would be sorted and hashed in one.
    urls = spark.range(0, 40, 1, 1).select("id", F.sha1(F.col("id").cast("string")).alias("url_hash"), F.lit("ok").alias("status"), F.lit(None).cast("timestamp_ntz").alias("next_check_after"))
    hashes = urls.where("id % 2 = 0").select("url_hash")
    out = state.brought_forward(urls, hashes.union(hashes), "2024-03-01 00:00:00")
    assert out.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sorted(r.id for r in out.where("next_check_after is not null").collect()) == list(range(0, 40, 2)) and out.count() == 40
