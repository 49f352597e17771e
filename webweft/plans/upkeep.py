"""Registered queries over stored state: replacement, counts kept up to date, scans, routing, panels, messages."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import url as U
from ..functions import verdicts as V
from ..operators import counts, export, extract, hosts, lifecycle, reports, routing, sources, state
from ..sources import bridge, store
from ..sources.staging import shared_dir, stored
from .audit import _DIGEST_SQL, _SIGNATURE_SQL, _STATUS_SQL, NOW, T, _signed
from .registry import AS_OF


def _sql(s, d, sql):
    return bridge.run(s, d, bridge.with_views(sql))


def _replaced(s, d):
    """Two sites' references are replaced in a table of all of them, one site loses all."""
    refs = T(s, d, "refs")
    path = f"{shared_dir(s)}/webweft/{uuid.uuid4().hex}/refs"
    store.create(refs, path)
    new = refs.where("site_id = 5 and source = 'nav'").withColumn("site_id", F.lit(2).cast("long")).withColumn("link_text", F.repeat(F.coalesce("link_text", F.lit("x")), F.lit(100)))
    store.replaced(s, path, F.col("source") == "nav", [2], new)
    store.replaced(s, path, F.col("site_id") == 3, [3])
    return store.read(s, path, refs.schema).select("id", "site_id", "source", "link_text")


_REPLACED_SQL = """SELECT id, site_id, source, link_text FROM refs WHERE site_id NOT IN (2, 3) OR (site_id=2 AND source<>'nav')
 UNION ALL SELECT id, 2, source, substr(repeat(coalesce(link_text, 'x'), 100), 1, 255) FROM refs WHERE site_id=5 AND source='nav'"""

#: References that went, came and came again, and verdicts that changed.
_CHANGES = "SELECT site_id, url_id, -1 AS n FROM refs WHERE element_id%4=0 UNION ALL SELECT site_id%5+1, url_id, 1 FROM refs WHERE element_id%6=1 UNION ALL SELECT site_id%5+1, url_id, 1 FROM refs WHERE element_id%12=1"
_TURNS = "SELECT id AS url_id, status AS before, CASE WHEN id%35=0 THEN NULL WHEN status='ok' THEN 'broken' ELSE 'ok' END AS after FROM urls WHERE id%5=0"


def _kept(s, d):
    urls, refs = T(s, d, "urls", "refs")
    pairs = stored(counts.pairs_of(refs), "pairs")
    held = counts.counted(pairs, urls)
    pairs, first = counts.moved(pairs, _sql(s, d, _CHANGES), _sql(s, d, f"{_TURNS} AND id<0"), urls)
    pairs, first = stored(pairs, "pairs"), stored(first, "differences")
    _, second = counts.moved(pairs, _sql(s, d, "SELECT site_id, url_id, 1 AS n FROM refs WHERE id<0"), _sql(s, d, _TURNS), urls)
    return counts.applied(held, first, second)


_KEPT_SQL = f"""WITH p AS (SELECT site_id, url_id, sum(n) AS n FROM (SELECT site_id, url_id, 1 AS n FROM refs UNION ALL {_CHANGES}) a GROUP BY site_id, url_id HAVING sum(n) > 0),
 u AS (SELECT id, CASE WHEN id%5<>0 THEN status WHEN id%35=0 THEN NULL WHEN status='ok' THEN 'broken' ELSE 'ok' END AS status FROM urls)
 SELECT site_id, status, count(*) AS n FROM p JOIN u ON u.id=url_id WHERE status IS NOT NULL GROUP BY site_id, status"""

_EVENTS = "SELECT user_id%997 AS scan_id, ts AS happened, event_id AS seq, CASE event_id%9 WHEN 0 THEN 'failed' WHEN 1 THEN 'cancelled' WHEN 2 THEN 'complete' WHEN 3 THEN 'queued' WHEN 4 THEN 'extracting' WHEN 5 THEN 'failed' WHEN 6 THEN 'cancelled' ELSE 'checking' END AS event FROM events"
#: Whether a scan runs after each event, by the numbers of its last beginning and its last end.
_FOLDED = f"""WITH e AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY happened, seq) AS k FROM ({_EVENTS}) v),
 b AS (SELECT *, coalesce(max(CASE WHEN event IN ('queued','extracting','checking') THEN k END) OVER p, 0) AS began, coalesce(max(CASE WHEN event NOT IN ('queued','extracting','checking') THEN k END) OVER p, 0) AS ended FROM e WINDOW p AS (PARTITION BY scan_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 g AS (SELECT *, event IN ('failed','cancelled') AND NOT began > ended AS refused FROM b),
 t AS (SELECT *, max(CASE WHEN NOT refused THEN k END) OVER (PARTITION BY scan_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS last FROM g)"""

_ROUTES = "SELECT id, is_internal, CASE WHEN id%7=0 THEN CASE WHEN id%14=0 THEN 'ignored' ELSE 'ignore-rule' END END AS ignored, CASE WHEN id%3>0 THEN CASE id%4 WHEN 0 THEN 'broken' ELSE 'ok' END END AS own_status, CASE WHEN id%4=0 THEN 'no-element' END AS own_reason, CASE id%6 WHEN 0 THEN 'broken' WHEN 1 THEN 'unreachable' WHEN 2 THEN NULL ELSE 'ok' END AS answer_status, CASE WHEN id%6<2 THEN 'http' END AS answer_reason, CASE WHEN id%11=0 THEN CAST(300 AS BIGINT) END AS wait FROM urls"


def _overridden(s, d):
    """A wall is taken for an answer, and what a private host says is not believed."""
    r = _signed(s, d).where("http_status is not null")
    found = r.select("id", "host", "http_status", V.response_verdict(F.col("http_status"), F.size("chain"), F.col("signature")).alias("v")).select("id", "host", "http_status", "v.status", "v.reason")
    none = F.lit(None).cast("string").alias("reason")
    walls = lambda t: t.where("http_status = 999").select("id", F.lit("ok").alias("status"), none)
    social = lambda t: t.where("host = 'x.com' and status = 'ok'").select("id", F.lit("blocked").alias("status"), F.lit("http").alias("reason"))
    return routing.overridden(found, [walls, social]).select("id", "status", "reason")


def _panel(s, d):
    out = reports.element_panel(*T(s, d, "urls", "refs"), 1)
    return out.withColumn("broken_urls", F.array_join(F.transform("broken_urls", lambda x: F.concat_ws(" ", x["url"], F.coalesce(x["http_status"].cast("string"), F.lit("-")), x["ref_id"].cast("string"), F.coalesce(x["block_id"].cast("string"), F.lit("-")), F.coalesce(x["field_handle"], F.lit("-")))), "; "))


_PANEL_SQL = """WITH h AS (SELECT element_id AS page_id, * FROM refs WHERE site_id=1 UNION ALL SELECT owner_element_id, * FROM refs WHERE site_id=1 AND owner_element_id<>element_id),
 o AS (SELECT h.*, u.url, u.status, u.http_status, u.date_last_checked, row_number() OVER (PARTITION BY page_id, url_id ORDER BY h.id) AS k FROM h JOIN urls u ON u.id=h.url_id),
 b AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY url, url_id) AS n FROM o WHERE k=1 AND status='broken'),
 l AS (SELECT page_id, string_agg(concat_ws(' ', url, coalesce(CAST(http_status AS VARCHAR), '-'), CAST(id AS VARCHAR), coalesce(CAST(CASE WHEN owner_element_id<>element_id THEN element_id END AS VARCHAR), '-'), coalesce(field_handle, '-')), '; ' ORDER BY n) AS broken_urls FROM b WHERE n<=10 GROUP BY page_id)
 SELECT o.page_id, count(*) AS total, count(*) FILTER (status<>'pending') AS checked, count(*) FILTER (status='pending') AS pending, count(*) FILTER (status='ok') AS ok, count(*) FILTER (status='broken') AS broken, count(*) FILTER (status='redirect') AS redirect, count(*) FILTER (status='unreachable') AS unreachable, count(*) FILTER (status='blocked') AS blocked, count(*) FILTER (status='ignored') AS ignored, count(*) FILTER (status='unsafe') AS unsafe, max(date_last_checked) AS last_checked, any_value(l.broken_urls) AS broken_urls FROM o LEFT JOIN l ON l.page_id=o.page_id WHERE k=1 GROUP BY o.page_id"""

_MET = "SELECT 'https://gone.example.org/'||CAST(p_partkey AS VARCHAR(20)) AS url, p_partkey%2=0 AS is_internal, CAST(p_partkey%5+1 AS BIGINT) AS site_id, CAST(p_partkey AS BIGINT) AS pos FROM part UNION ALL SELECT 'https://gone.example.org/'||CAST(p_partkey AS VARCHAR(20)), p_partkey%2=0, CAST(9 AS BIGINT), CAST(99999999 AS BIGINT) FROM part WHERE p_partkey%3=0 UNION ALL SELECT 'relation:'||CAST(p_partkey AS VARCHAR(20)), true, CAST(1 AS BIGINT), CAST(1 AS BIGINT) FROM part UNION ALL SELECT 'ftp://'||repeat('h', 300)||CAST(p_partkey AS VARCHAR(20))||'/x', false, CAST(1 AS BIGINT), CAST(1 AS BIGINT) FROM part WHERE p_partkey%100=0 UNION ALL SELECT 'https://host'||CAST(p_partkey%37 AS VARCHAR(20))||'.example.org/p/'||CAST(p_partkey AS VARCHAR(20)), false, CAST(1 AS BIGINT), CAST(2 AS BIGINT) FROM part"


def _message(s, d):
    return export.messages(export.broken(*T(s, d, "urls", "refs"), since="2024-02-01 00:00:00", site=1), "Example & Co <x>", "https://cp.example/audit")


def _page(s, d):
    urls, refs = T(s, d, "urls", "refs")
    page = reports.url_table(urls, refs, "broken", 1, page=2, per_page=30, sort="url", descending=False).select("id", "url", "ref_count")
    return reports.with_total(page, reports.filtered(urls, refs, "broken", [1]))


def _forward(s, d):
    urls, sites = T(s, d, "urls", "sites")
    by = {"orders": "o_custkey", "customer": "c_custkey"}
    es = bridge.run(s, d, bridge.with_views("SELECT * FROM elements_sites"), by)
    pages = _sql(s, d, "SELECT o_orderkey*10 AS element_id FROM orders WHERE o_orderkey%2=0")
    # The table holds stand-ins of parts; pages of elements are added under their own addresses.
    held = urls.unionByName(bridge.run(s, d, bridge.with_views(_PAGES), by).select(*(F.col(c) if c in ("id", "url_hash", "status") else F.lit(None).cast(urls.schema[c].dataType).alias(c) for c in urls.columns)))
    hashes = state.addresses_of(es, sites, pages)
    return state.brought_forward(held, hashes, NOW).select("id", "status", "next_check_after")


_PAGES = "SELECT es.element_id*10+es.site_id AS id, sha1(CASE WHEN es.uri='__home__' THEN s.base_url ELSE concat(s.base_url, es.uri) END) AS url_hash, CASE WHEN es.element_id%30=0 THEN 'ignored' ELSE 'ok' END AS status FROM elements_sites es JOIN sites s ON s.site_id=es.site_id WHERE es.uri IS NOT NULL"
_FORWARD_SQL = f"""WITH p AS ({_PAGES}), w AS (SELECT o_orderkey*10 AS e FROM orders WHERE o_orderkey%2=0),
 h AS (SELECT sha1('element:'||CAST(e AS VARCHAR)) AS url_hash FROM w UNION SELECT sha1('relation:'||CAST(e AS VARCHAR)) FROM w UNION SELECT sha1(CASE WHEN uri='__home__' THEN base_url ELSE base_url||uri END) FROM elements_sites JOIN sites USING (site_id) JOIN w ON w.e=element_id WHERE uri IS NOT NULL)
 SELECT id, status, CASE WHEN url_hash IN (SELECT url_hash FROM h) AND status<>'ignored' THEN {AS_OF} - INTERVAL '1' MINUTE ELSE next_check_after END AS next_check_after FROM (SELECT id, url_hash, status, next_check_after FROM urls UNION ALL SELECT id, url_hash, status, NULL FROM p) u"""

_NODES = "SELECT node_id, site_id, title, CASE node_id%5 WHEN 3 THEN 'site' WHEN 4 THEN 'passive' ELSE kind END AS kind, target_id, raw_url, suffix, CASE WHEN node_id%15<>3 THEN ' https://Own.example.org:443/n/'||CAST(node_id AS VARCHAR(20)) END AS own_url FROM nodes"
_EDITS = "SELECT id, element_id, owner_element_id, field_handle, 'https://cp.example/e/'||CAST(coalesce(owner_element_id, element_id) AS VARCHAR(20)) AS page, CASE WHEN id%3=0 THEN 'gallery' END AS block FROM refs"


def _edits(s, d):
    args = (F.col("page"), F.col("id"), F.col("element_id"), F.col("owner_element_id"), F.col("field_handle"), F.col("block"))
    return _sql(s, d, _EDITS).select("id", L.edit_url(*args).alias("edit"), L.edit_url(*args, True).alias("precise"))


_NAMES = f"""CASE status {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in L.STATUS.items())} END"""

_FETCHED = "SELECT page_id, CASE page_id%5 WHEN 0 THEN 404 WHEN 1 THEN 299 WHEN 2 THEN NULL ELSE 200 END AS http_status, CASE page_id%4 WHEN 0 THEN 'text/HTML; charset=utf-8' WHEN 1 THEN NULL WHEN 2 THEN 'application/xhtml+xml' ELSE 'image/png' END AS content_type, CASE WHEN page_id%50=1 THEN repeat(html, 700) ELSE html END AS body FROM pages"
_LISTED = "SELECT c_custkey AS id, ' '||c_name||'@x.org,'||chr(9)||'b'||CAST(c_custkey AS VARCHAR(20))||'@x.org'||chr(13)||chr(10)||chr(10)||CASE WHEN c_custkey%3=0 THEN ' ,' ELSE 'c@x.org ' END AS setting FROM customer"

PAIRED = {
    "readable_bodies": (lambda s, d: sources.readable_pages(_sql(s, d, _FETCHED)).select("page_id", F.length("body").cast("long").alias("bytes")), f"SELECT page_id, least(2097152, strlen(body)) AS bytes FROM ({_FETCHED}) t WHERE http_status BETWEEN 200 AND 299 AND (content_type IS NULL OR content_type ILIKE '%html%')"),
    "mail_recipients": (lambda s, d: _sql(s, d, _LISTED).select("id", F.array_join(export.recipients(F.col("setting")), ";").alias("sent")), f"SELECT id, array_to_string(list_filter(list_transform(regexp_split_to_array(setting, '[,\\r\\n]+'), lambda x: trim(x, concat(' ', chr(9)))), lambda x: x<>''), ';') AS sent FROM ({_LISTED}) t"),
    "linkable_fields": (lambda s, d: sources.link_fields(_sql(s, d, "SELECT p_partkey AS id, p_name AS name, p_brand AS class FROM part"), ["Brand#2", "Brand#17", "Brand#25"]).select("id", "name"), "SELECT p_partkey AS id, p_name AS name FROM part WHERE p_brand IN ('Brand#2', 'Brand#17', 'Brand#25')"),
    "edit_links": (_edits, f"SELECT id, page||CASE WHEN owner_element_id<>element_id THEN '#la-block-'||CAST(element_id AS VARCHAR)||CASE WHEN block IS NULL THEN '' ELSE '--'||block END WHEN trim(coalesce(field_handle, ''))='' THEN '' ELSE '#la-field-'||trim(field_handle) END AS edit, page||'#la-ref-'||CAST(id AS VARCHAR) AS precise FROM ({_EDITS}) t"),
    "export_files": (lambda s, d: export.files(*T(s, d, "urls", "refs"), [1, 2], "2024-03-01"), f"SELECT status, count(*) AS rows, 'link-audit-'||trim(regexp_replace(lower({_NAMES}), '[^a-z0-9]+', '-', 'g'), '-')||'-2024-03-01.csv' AS filename, 'Page,Edit URL,Page URL,Page Type,Site,Field,Link Text,URL,Verdict,Reason,Response Code,'||CASE WHEN status='redirect' THEN 'Redirect Code,Goes To,' ELSE '' END||'Host,Found Via,Places Total,First Seen,Last Checked' AS header FROM refs r JOIN urls u ON u.id=r.url_id WHERE site_id IN (1, 2) GROUP BY status"),
    "navigation_records": (lambda s, d: extract.navigation(_sql(s, d, _NODES)).select("node_id", "target_id", U.normalised(F.col("href"), F.lit("https://host2.example.org/")).alias("url")), f"SELECT node_id, CASE WHEN kind='element' THEN target_id END AS target_id, CASE WHEN kind='site' THEN lower(replace(trim(own_url), ':443', '')) WHEN kind='custom' THEN CASE node_id%9 WHEN 5 THEN 'https://host2.example.org/about' WHEN 6 THEN 'https://host1.example.org/b' WHEN 7 THEN 'https://host1.example.org/b' WHEN 8 THEN 'https://host1.example.org/b' END||CASE WHEN node_id%2=0 THEN '?x=1' ELSE '' END END AS url FROM ({_NODES}) t WHERE kind<>'passive' AND ((kind='element' AND target_id IS NOT NULL) OR (kind='site' AND own_url IS NOT NULL) OR (kind='custom' AND node_id%9 IN (4, 5, 6, 7, 8)))"),
    "replace_stored_refs": (_replaced, _REPLACED_SQL),
    "kept_counts": (_kept, _KEPT_SQL),
    "scan_transitions": (lambda s, d: lifecycle.transitions(_sql(s, d, _EVENTS)).select("seq", "status", "refused"), f"{_FOLDED} SELECT t.seq, l.event AS status, t.refused FROM t LEFT JOIN t l ON l.scan_id=t.scan_id AND l.k=t.last"),
    "scan_histories": (lambda s, d: lifecycle.histories(_sql(s, d, _EVENTS)), f"{_FOLDED} SELECT t.scan_id, arg_max(l.event, t.k) AS status, min(CASE WHEN t.event IN ('extracting','checking') THEN t.happened END) AS date_started, max(CASE WHEN NOT t.refused AND t.event NOT IN ('queued','extracting','checking') THEN t.happened END) AS date_finished, count(*) FILTER (t.refused) AS refused FROM t LEFT JOIN t l ON l.scan_id=t.scan_id AND l.k=t.last GROUP BY t.scan_id"),
    "scan_by_id": (lambda s, d: lifecycle.by_id(T(s, d, "scans"), 7).select("id", "mode", "status", "date_started"), "SELECT id, mode, status, date_started FROM scans WHERE id=7"),
    "routed_checks": (lambda s, d: routing.routed(_sql(s, d, _ROUTES))[0], f"SELECT id, way, CASE way WHEN 'ignored' THEN 'ignored' WHEN 'own' THEN own_status ELSE CASE WHEN wait IS NULL THEN answer_status END END AS status, CASE way WHEN 'ignored' THEN ignored WHEN 'own' THEN own_reason ELSE CASE WHEN wait IS NULL THEN answer_reason END END AS reason, CASE WHEN way='request' THEN wait END AS seconds FROM (SELECT *, CASE WHEN ignored IS NOT NULL THEN 'ignored' WHEN is_internal AND own_status IS NOT NULL THEN 'own' ELSE 'request' END AS way FROM ({_ROUTES}) r) t"),
    "element_panel": (_panel, _PANEL_SQL),
    "reference_location": (lambda s, d: reports.reference_location(T(s, d, "refs"), _sql(s, d, "SELECT id, date_deleted FROM elements"), [r["id"] for r in T(s, d, "refs").select("id").orderBy("id").limit(50).collect()]), "SELECT r.id, coalesce(r.owner_element_id, r.element_id) AS page_id, r.site_id, CASE WHEN r.owner_element_id<>r.element_id THEN r.element_id END AS block_id, r.field_handle, r.link_text FROM (SELECT * FROM refs ORDER BY id LIMIT 50) r JOIN elements e ON e.id=coalesce(r.owner_element_id, r.element_id) WHERE e.date_deleted IS NULL"),
    "new_url_rows": (lambda s, d: state.new_urls(_sql(s, d, _MET), *T(s, d, "urls", "ignores"), NOW), f"""SELECT sha1(m.url) AS url_hash, m.url, CASE WHEN starts_with(m.url, 'relation:') THEN '' ELSE substr(regexp_extract(m.url, '//([^/]*)', 1), 1, 255) END AS host, regexp_extract(m.url, '^([a-z]+):', 1) AS scheme, CASE WHEN is_internal THEN site_id END AS site_id, is_internal, CASE WHEN EXISTS (SELECT 1 FROM ignores i WHERE i.url_hash=sha1(m.url)) THEN 'ignored' ELSE 'pending' END AS status, {AS_OF} AS date_first_seen
 FROM (SELECT url, arg_min(is_internal, pos) AS is_internal, arg_min(site_id, pos) AS site_id FROM ({_MET}) a GROUP BY url) m WHERE sha1(m.url) NOT IN (SELECT url_hash FROM urls)"""),
    "message": (_message, f"SELECT CASE WHEN total=1 THEN 'One broken link' ELSE CAST(total AS VARCHAR)||' broken links' END||' on Example & Co <x>' AS subject, replace(body, 'on Example has', 'on Example & Co <x> has') AS body, '{{\"username\":\"Link Audit\",\"text\":'||CAST(to_json('*'||CASE WHEN total=1 THEN 'One broken link' ELSE CAST(total AS VARCHAR)||' broken links' END||' on Example &amp; Co &lt;x&gt;*'||chr(10)||replace(replace(replace(replace(body, 'on Example has', 'on Example & Co <x> has'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS VARCHAR)||'}}' AS slack FROM ({_DIGEST_SQL}) t"),
    "url_page_with_total": (_page, "SELECT u.id, u.url, c.n AS ref_count, count(*) OVER () AS total FROM urls u JOIN (SELECT url_id, count(*) AS n FROM refs WHERE site_id=1 GROUP BY url_id) c ON c.url_id=u.id WHERE u.status='broken' ORDER BY u.url NULLS FIRST, u.id LIMIT 30 OFFSET 30"),
    "element_forward": (_forward, _FORWARD_SQL),
    # The delay step by step: a limit raises it, a success halves it or ends it.
    "host_delays": (lambda s, d: hosts.folded(T(s, d, "host_log")).select("host", "min_delay_ms", "date_last_request"), """WITH RECURSIVE k AS (SELECT host, seen_at, wait, CASE WHEN status IN ('ok','redirect','broken','blocked') THEN 's' WHEN status='pending' AND http_status=429 THEN 'l' WHEN status='unreachable' THEN 'f' END AS kind, row_number() OVER (PARTITION BY host ORDER BY seen_at, seq) AS k FROM host_log WHERE status<>'pending' OR http_status=429),
 r(host, k, delay) AS (SELECT DISTINCT host, CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM k UNION ALL SELECT k.host, k.k, CASE kind WHEN 'l' THEN greatest(delay, least(30000, 1000*least(900, greatest(1, coalesce(wait, 60))))) WHEN 's' THEN CASE WHEN delay//2 > 250 THEN delay//2 ELSE 0 END ELSE delay END FROM r JOIN k ON k.host=r.host AND k.k=r.k+1)
 SELECT r.host, nullif(arg_max(delay, r.k), 0) AS min_delay_ms, max(seen_at) AS date_last_request FROM r JOIN k ON k.host=r.host AND k.k=r.k GROUP BY r.host"""),
    "verdict_override": (_overridden, f"SELECT id, CASE WHEN http_status=999 AND host='x.com' THEN 'blocked' WHEN http_status=999 THEN 'ok' WHEN host='x.com' AND v='ok' THEN 'blocked' ELSE v END AS status, CASE WHEN http_status=999 THEN CASE WHEN host='x.com' THEN 'http' END WHEN host='x.com' AND v='ok' THEN 'http' ELSE r END AS reason FROM (SELECT id, host, http_status, CASE WHEN st='pending' OR sig IS NULL THEN st ELSE 'blocked' END AS v, CASE WHEN st='pending' THEN 'rate-limited' WHEN sig IS NOT NULL THEN 'http' WHEN http_status BETWEEN 200 AND 299 THEN NULL ELSE 'http' END AS r FROM (SELECT id, host, http_status, {_STATUS_SQL} AS st, {_SIGNATURE_SQL} AS sig FROM replies WHERE http_status IS NOT NULL) t) u"),
}
