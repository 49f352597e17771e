"""Registered audit queries as DataFrame operators, each with a DuckDB statement written apart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import links, net
from ..functions import url as U
from ..functions import verdicts as V
from ..operators import export, extract, fold, hosts, lifecycle, reports, resolve, rules, sources, state
from ..sources import bridge
from .registry import _ADDRESSES, _BASES, _CLEAN_SQL, _RESOLVED_ALL, AS_OF, FALLBACK_SITE, IGNORE_HOSTS, IGNORE_PATTERNS, ON_SITE, SHARED, SUBSITES, _links

NOW = "2024-03-01 00:00:00"
SITES = [1, 2, 3]
Query = tuple[Callable[[SparkSession, str], DataFrame], str]


def T(s: SparkSession, d: str, *names: str):
    found = [bridge.view(s, d, n) for n in names]
    return found[0] if len(found) == 1 else found


def _pages(s, d):
    return s.read.parquet(f"{d}/pages.parquet").select("page_id", "url", "html")


def _lib(s: SparkSession, d: str, fn, *names: str, **how):
    return fn(*[bridge.view(s, d, n) for n in names], **how)


_LATE = "TIMESTAMP '1996-01-01 00:00:00'"
_TYPES = ["Entry", "Category"]


def _scannable(s, d, **how):
    return sources.scannable(*T(s, d, "elements_sites", "elements", "elements_owners"), _TYPES, **how)


_SCANNABLE_SQL = "SELECT es.site_id, es.element_id, es.uri, e.type FROM elements_sites es JOIN elements e ON e.id=es.element_id WHERE es.enabled AND e.enabled AND NOT e.archived AND e.draft_id IS NULL AND e.revision_id IS NULL AND e.date_deleted IS NULL AND e.type IN ('Entry','Category') AND e.id NOT IN (SELECT element_id FROM elements_owners)"

#: Statements of SHARED, now answered by operators: name to operator.
OPERATORS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "permanent_redirects": lambda s, d: reports.counted(reports.filtered(*T(s, d, "urls", "refs"), "redirect", [1], permanent=True)),
    "dismissed_count": lambda s, d: reports.counted(reports.ignored(*T(s, d, "ignores", "urls", "refs"))),
    "verdict_counts_multi_site": lambda s, d: reports.scoped(*T(s, d, "urls", "refs"), [1, 3]).groupBy("status").agg(F.count("*").alias("n")),
    "top_hosts": lambda s, d: reports.top_hosts(*T(s, d, "urls", "refs"), 1),
    "host_options": lambda s, d: reports.host_options(*T(s, d, "urls", "refs"), 1),
    "element_type_options": lambda s, d: reports.element_types(*T(s, d, "urls", "refs"), 1),
    "url_count": lambda s, d: reports.counted(reports.scoped(*T(s, d, "urls", "refs"), [1])),
    "reference_count": lambda s, d: reports.counted(T(s, d, "refs").where(F.col("site_id").isin(1, 2))),
    "internal_broken": lambda s, d: reports.counted(reports.filtered(*T(s, d, "urls", "refs"), "broken", [1], internal=True)),
    "recently_broken": lambda s, d: reports.counted(reports.filtered(T(s, d, "urls").where("date_last_ok >= timestamp_ntz'2024-02-01'"), T(s, d, "refs"), "broken", [1])),
    "first_seen_broken": lambda s, d: reports.counted(reports.filtered(T(s, d, "urls").where("date_first_seen >= timestamp_ntz'2024-01-15'"), T(s, d, "refs"), "broken", [1])),
    "element_summary": lambda s, d: reports.element_summary(*T(s, d, "urls", "refs"), 1),
    "element_broken_locations": lambda s, d: reports.broken_locations(*T(s, d, "urls", "refs"), 1),
    "console_hosts": lambda s, d: reports.console_hosts(T(s, d, "urls")),
    "scan_totals": lambda s, d: T(s, d, "refs").where("scan_id is not null").groupBy("scan_id").agg(F.count_distinct("url_id").alias("n")),
    "referenced_broken": lambda s, d: reports.counted(export.broken(*T(s, d, "urls", "refs"))),
    "place_counts": lambda s, d: T(s, d, "refs").where("site_id = 1 and source = 'field'").groupBy("url_id").agg(F.count("*").alias("places")),
    "attributed_urls": lambda s, d: T(s, d, "refs").where("source <> 'rendered'").select("url_id").distinct(),
    "incremental_cutoff": lambda s, d: reports.incremental_cutoff(T(s, d, "scans"), SITES),
    "url_table_p2": lambda s, d: reports.url_table(*T(s, d, "urls", "refs"), "broken", 1, page=2, per_page=50).select("id", "url", "status", "ref_count"),
    "url_table_by_refs": lambda s, d: reports.url_table(*T(s, d, "urls", "refs"), "ok", 1, sort="refCount", element_type="Entry", source="field").select("id", "url", "ref_count"),
    "url_search": lambda s, d: reports.scoped(reports.search(T(s, d, "urls"), "HOST7."), T(s, d, "refs"), [1]).select("id", "url"),
    "url_references": lambda s, d: reports.references(T(s, d, "refs"), 7, SITES),
    "running_scan": lambda s, d: lifecycle.active(T(s, d, "scans"), "2024-01-23 02:00:00").select("id", "mode"),
    "recent_scans": lambda s, d: T(s, d, "scans").orderBy(F.desc("id")).limit(5).select("id", "mode", "status"),
    "ignored_list": lambda s, d: reports.ignored(*T(s, d, "ignores", "urls", "refs")).orderBy(F.desc("date_created"), F.desc("id")).limit(200).select("id", "value", "user_id", "status"),
    "due_urls": lambda s, d: sources.due(T(s, d, "urls"), NOW).select("id"),
    "check_chunks": lambda s, d: sources.chunks(T(s, d, "urls").where("next_check_after <= timestamp_ntz'2024-03-01' and status not in ('ignored', 'unsafe')")),
    "blocked_hosts": lambda s, d: T(s, d, "hosts").select("host", "consecutive_failures", hosts.backoff_seconds(F.col("consecutive_failures")).alias("block_seconds")),
    "effective_delay": lambda s, d: T(s, d, "hosts").select("host", hosts.effective_delay(F.col("min_delay_ms")).alias("delay_ms")),
    "orphan_urls": lambda s, d: lifecycle.orphans(*T(s, d, "urls", "refs"), "2024-02-01 01:00:00").select("id"),
    "stale_refs": lambda s, d: T(s, d, "refs").select("id").join(lifecycle.stale_refs(T(s, d, "refs"), 4, "1996-01-01 00:00:00").select("id"), "id", "left_anti"),
    "hosts_unused": lambda s, d: T(s, d, "hosts").join(T(s, d, "urls").where("host <> ''").select("host"), "host", "left_anti").select("host"),
    "upsert_urls": lambda s, d: state.upsert(bridge.run(s, d, bridge.with_views("SELECT sha1('https://gone.example.org/'||CAST(p_partkey AS VARCHAR(20))) AS url_hash FROM part UNION ALL SELECT sha1('https://host'||CAST(p_partkey%37 AS VARCHAR(20))||'.example.org/p/'||CAST(p_partkey AS VARCHAR(20))) FROM part")), *T(s, d, "urls", "ignores")),
    "rendered_minus_attributed": lambda s, d: _rendered_minus(T(s, d, "refs")),
    "release_ignores": lambda s, d: state.settings_released(T(s, d, "urls")).select("id", "status", "reason"),
    "prune_history": lambda s, d: T(s, d, "scans").where("status in ('complete', 'cancelled', 'failed') and date_started < timestamp_ntz'2024-01-10'").select("id"),
    "verdict_from_response": lambda s, d: T(s, d, "responses").select("id", V.response_status(F.col("http_status"), F.col("hops")).alias("status"), V.response_reason(F.col("http_status")).alias("reason")),
    "ignore_verdict": lambda s, d: rules.ignore_verdict(*T(s, d, "urls", "ignores"), [{"enabled": on, "host": t} for _, on, t in IGNORE_HOSTS], [{"enabled": on, "pattern": t} for _, on, t in IGNORE_PATTERNS]),
    "panel_label": lambda s, d: _addresses(s, d).select("source", "id", L.panel_label(F.col("url"), L.own_host(F.col("url"), _base_urls(s, d))).alias("label")),
    "site_for_url": lambda s, d: resolve.site_for(_addresses(s, d), _all_bases(s, d), FALLBACK_SITE).select("source", "id", "site_id"),
    "scannable_elements": lambda s, d: _scannable(s, d, sections=(3, 5)).select("site_id", "element_id", "uri"),
}


def _rendered_minus(refs: DataFrame) -> DataFrame:
    page = F.coalesce("owner_element_id", "element_id").alias("page")
    own = refs.where("source <> 'rendered'").select(page, "site_id", "url_id")
    return refs.where("source = 'rendered'").select("id", page, "site_id", "url_id").join(own, ["page", "site_id", "url_id"], "left_anti").select("id")


def _addresses(s, d):
    return bridge.run(s, d, bridge.with_views(_ADDRESSES)).select("source", "id", "url")


def _all_bases(s, d):
    return T(s, d, "sites").select("site_id", "base_url").unionByName(s.createDataFrame(list(SUBSITES), "site_id long, base_url string"))


def _base_urls(s, d) -> list[str]:
    return [r["base_url"] for r in _all_bases(s, d).collect()]  # a handful of sites


_HEADERS = {"server": "h_server", "via": "h_via", "x-cache": "h_x_cache", "x-amzn-waf-action": "h_waf", "cf-mitigated": "h_cf_mitigated", "set-cookie": "h_set_cookie", "x-datadome": "h_x_datadome", "x-px-block": "h_x_px", "x-iinfo": "h_x_iinfo"}


def _signed(s, d):
    r = T(s, d, "replies")
    headers = F.map_filter(F.create_map(*[x for k, c in _HEADERS.items() for x in (F.lit(k), F.col(c))]), lambda _, v: v.isNotNull())
    hostile = F.array(*[F.lit(h) for h in ("host7.example.org", " HOST17.example.org ", "", "example.net")])
    chain = F.when(F.col("hops") == "", F.array().cast("array<int>")).otherwise(F.split("hops", ",").cast("array<int>"))
    return r.withColumn("chain", chain).withColumn("signature", V.bot_signature(F.col("url"), F.col("http_status"), headers, F.col("final_url"), F.col("body"), hostile))


_SIGNATURE_SQL = """CASE WHEN http_status IS NULL THEN NULL
 WHEN (host IN ('x.com') OR host LIKE '%.facebook.com') AND regexp_matches(lower(regexp_extract(final_url, '^[^:]+://[^/?#]*([^?#]*)', 1)), '/accounts/login|/checkpoint|/i/flow/login|/login|/signin|/uas/login') THEN 'social-login-wall'
 WHEN http_status BETWEEN 200 AND 299 THEN NULL WHEN http_status=999 THEN 'linkedin-999' WHEN lower(h_cf_mitigated) LIKE '%challenge%' THEN 'cloudflare-challenge'
 WHEN regexp_matches(lower(body), 'error code: 1020|error 1020') THEN 'cloudflare-1020' WHEN lower(h_server) LIKE '%cloudflare%' AND regexp_matches(lower(body), '__cf_chl|cf-browser-verification|cf_chl_opt|challenge-platform|just a moment') THEN 'cloudflare-challenge'
 WHEN h_x_datadome IS NOT NULL OR h_set_cookie LIKE '%datadome=%' THEN 'datadome' WHEN h_x_px IS NOT NULL OR regexp_matches(lower(body), '_pxhd|px-captcha') THEN 'perimeterx' WHEN h_x_iinfo IS NOT NULL OR h_set_cookie LIKE '%visid_incap%' THEN 'imperva'
 WHEN lower(h_server) LIKE '%akamaighost%' AND http_status=403 THEN 'akamai' WHEN http_status=403 AND (lower(h_x_cache) LIKE '%cloudfront%' OR lower(h_via) LIKE '%cloudfront%' OR h_waf IS NOT NULL) THEN 'aws-waf'
 WHEN http_status=503 AND regexp_matches(lower(body), 'captcha|automated access') THEN 'captcha-503' WHEN host IN ('host7.example.org','host17.example.org') THEN 'host-list' END"""
_STATUS_SQL = "CASE WHEN http_status BETWEEN 200 AND 299 THEN CASE WHEN hops<>'' THEN 'redirect' ELSE 'ok' END WHEN http_status=429 THEN 'pending' WHEN http_status>=500 THEN 'unreachable' WHEN http_status IN (401,407) THEN 'blocked' ELSE 'broken' END"
_ERROR_SQL = "CASE WHEN regexp_matches(lower(message), 'ssl|certificate|tls') THEN 'ssl' WHEN regexp_matches(lower(message), 'resolve host|resolve name') THEN 'dns' WHEN regexp_matches(lower(message), 'timed out|timeout') THEN 'timeout' ELSE 'connect' END"


def _case(column: str, names: dict, other: str = "NULL") -> str:
    spell = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return f"CASE {column} " + " ".join(f"WHEN {spell(k)} THEN {spell(v)}" for k, v in names.items()) + f" ELSE {other} END"


_CELL = lambda c: f"CASE WHEN left(coalesce({c},''),1) IN ('=','+','-','@',chr(9),chr(13)) THEN concat('''', {c}) ELSE coalesce({c},'') END"
_QUOTED = lambda c: f"CASE WHEN regexp_matches({_CELL(c)}, '[\",\\n\\r\\t ]') THEN concat('\"', replace({_CELL(c)}, '\"', '\"\"'), '\"') ELSE {_CELL(c)} END"


def _export(s, d):
    pages = T(s, d, "elements").where("date_deleted is null").select("id", F.concat(F.lit("Element "), F.col("id").cast("string")).alias("title"), F.concat(F.lit("https://cp.example/e/"), F.col("id").cast("string")).alias("edit_url"), F.lit(None).cast("string").alias("page_url"))
    return export.rows(*T(s, d, "urls", "refs"), pages, T(s, d, "sites"), "redirect", [1, 2])


_EXPORT_SQL = "SELECT id, concat_ws(',', " + ", ".join(
    _QUOTED(c) for c in ("title", "edit", "page_url", "element_type", "handle", "field_handle", "link_text", "url", "'Redirect'", "CAST(NULL AS VARCHAR)", "CAST(http_status AS VARCHAR)", "CAST(redirect_status AS VARCHAR)", "final_url", "host", "via", "CAST(places AS VARCHAR)", "strftime(date_first_seen, '%Y-%m-%dT%H:%M:%S+00:00')", "strftime(date_last_checked, '%Y-%m-%dT%H:%M:%S+00:00')")
) + f""") AS line FROM (SELECT r.id, concat('Element ', CAST(e.id AS VARCHAR)) AS title, CAST(NULL AS VARCHAR) AS page_url, CASE WHEN e.id IS NULL THEN NULL ELSE concat('https://cp.example/e/', CAST(e.id AS VARCHAR), CASE WHEN r.owner_element_id<>r.element_id THEN concat('#la-block-', CAST(r.element_id AS VARCHAR)) WHEN r.field_handle IS NULL THEN '' ELSE concat('#la-field-', r.field_handle) END) END AS edit,
 r.element_type, s.handle, r.field_handle, r.link_text, u.url, u.http_status, u.redirect_status, u.final_url, u.host, {_case("r.source", L.SOURCE)} AS via, count(*) OVER (PARTITION BY r.url_id) AS places, u.date_first_seen, u.date_last_checked
 FROM refs r JOIN urls u ON u.id=r.url_id LEFT JOIN (SELECT id FROM elements WHERE date_deleted IS NULL) e ON e.id=coalesce(r.owner_element_id, r.element_id) LEFT JOIN sites s ON s.site_id=r.site_id WHERE u.status='redirect' AND r.site_id IN (1,2)) t"""
_EXPORT_SQL = _EXPORT_SQL.replace("concat('Element ', CAST(e.id AS VARCHAR))", "CASE WHEN e.id IS NOT NULL THEN concat('Element ', CAST(e.id AS VARCHAR)) END")


def _digest(s, d):
    return export.digest(export.broken(*T(s, d, "urls", "refs"), since="2024-02-01 00:00:00", site=1), "Example", "https://cp.example/audit")


_DIGEST_SQL = f"""WITH f AS (SELECT u.*, row_number() OVER (ORDER BY date_last_broken DESC NULLS LAST, id) AS k, count(*) OVER () AS total FROM urls u WHERE status='broken' AND date_last_broken >= TIMESTAMP '2024-02-01 00:00:00' AND {ON_SITE})
 SELECT max(total) AS total, concat('The link scan on Example has finished, and ', CASE WHEN max(total)=1 THEN 'one broken link came' ELSE concat(CAST(max(total) AS VARCHAR), ' broken links came') END, ' out of it.', chr(10), chr(10),
 string_agg(concat('- ', url, CASE WHEN http_status IS NOT NULL THEN concat(' (', CAST(http_status AS VARCHAR), ')') ELSE '' END, chr(10), '  https://cp.example/audit/url?hash=', url_hash), chr(10) ORDER BY k),
 CASE WHEN max(total) > count(*) THEN concat(chr(10), chr(10), 'And ', CAST(max(total)-count(*) AS VARCHAR), ' more.') ELSE '' END, chr(10), chr(10),
 'The note after each link is what the website said when it was asked. The full list, and the pages carrying each one, is here: https://cp.example/audit') AS body FROM f WHERE k<=20 HAVING max(total)>=1"""

_EXCLUDED = [{"enabled": True, "siteUid": "", "uriPattern": "^o/1[0-9]*7$"}, {"enabled": False, "uriPattern": "."}, {"enabled": True, "siteUid": "u2", "uriPattern": "O/2"}, {"enabled": True, "siteUid": "u2", "uriPattern": "o/2"}, {"enabled": True, "siteId": "3", "uriPattern": ""}, {"enabled": True, "siteUid": "lost", "uriPattern": "o"}, {"enabled": True, "uriPattern": "o/(3"}]
_ROUTES = [("o/<id:1[0-9]>", None), ("/o/<year:\\d{3}>/", 2), ("news/<slug>", None)]
_ALLOW = ["o/77", "(", " o/9[0-9]$ "]


def _resolve_internal(s, d):
    sites, es, e = T(s, d, "sites", "elements_sites", "elements")
    found = bridge.run(s, d, bridge.with_views(_OWN_SQL))
    return resolve.urls(found, sites, resolve.live(es, e, "1997-01-01 00:00:00"), _ROUTES, _ALLOW).select("id", "status", "reason")


_OWN_SQL = "SELECT es.element_id AS id, concat('https://x.example.com/', CASE WHEN es.uri IS NULL OR es.uri='__home__' THEN '' ELSE concat('/', replace(es.uri, '/', '%2F'), '/') END) AS url, CASE WHEN es.element_id%130=0 THEN CAST(99 AS BIGINT) ELSE es.site_id END AS site_id FROM elements_sites es"
_RESOLVE_SQL = """WITH a AS (SELECT es.element_id AS id, coalesce(es.uri, '__home__') AS uri, CASE WHEN es.element_id%130=0 THEN 99 ELSE es.site_id END AS site_id FROM elements_sites es),
 l AS (SELECT DISTINCT es.site_id, es.uri FROM elements_sites es JOIN elements e ON e.id=es.element_id WHERE es.uri IS NOT NULL AND es.enabled AND e.enabled AND NOT e.archived AND e.draft_id IS NULL AND e.date_deleted IS NULL AND (e.section_id IS NULL OR (e.post_date <= TIMESTAMP '1997-01-01 00:00:00' AND (e.expiry_date IS NULL OR e.expiry_date > TIMESTAMP '1997-01-01 00:00:00')))),
 t AS (SELECT a.id, a.site_id=99 AS lost, l.uri IS NOT NULL OR (a.uri<>'__home__' AND (regexp_full_match(a.uri, 'o/1[0-9]') OR (a.site_id=2 AND regexp_full_match(a.uri, 'o/[0-9]{3}')))) AS there, a.uri LIKE '%o/77%' OR regexp_matches(a.uri, 'o/9[0-9]$') AS allowed FROM a LEFT JOIN l ON l.site_id=a.site_id AND l.uri=a.uri)
 SELECT id, CASE WHEN lost THEN 'broken' WHEN there THEN 'ok' WHEN allowed THEN 'ignored' END AS status, CASE WHEN lost THEN 'no-element' WHEN there THEN NULL WHEN allowed THEN 'setting' END AS reason FROM t"""


def _resolve_element(s, d):
    links_ = T(s, d, "refs").select("id", F.when(F.col("id") % 50 == 0, F.lit(0)).otherwise(F.coalesce("owner_element_id", "element_id") - F.when(F.col("id") % 3 == 0, F.col("element_id") % 10).otherwise(0)).alias("target_id"), "site_id", (F.col("id") % 2 == 0).alias("is_relation"))
    return resolve.elements(links_, T(s, d, "elements"), T(s, d, "elements_sites"), "1996-06-01 00:00:00", [3, 5], [1]).select("id", "status", "reason")


_RESOLVE_ELEMENT_SQL = """WITH l AS (SELECT id, CASE WHEN id%50=0 THEN 0 ELSE coalesce(owner_element_id, element_id) - CASE WHEN id%3=0 THEN element_id%10 ELSE 0 END END AS target_id, site_id, id%2=0 AS rel FROM refs),
 t AS (SELECT l.id, l.rel, l.target_id<=0 OR e.id IS NULL AS missing, coalesce(e.section_id IN (3,5), false) OR coalesce(e.group_id IN (1), false) AS excluded, coalesce(e.type='Entry' AND (e.post_date > TIMESTAMP '1996-06-01 00:00:00' OR e.expiry_date <= TIMESTAMP '1996-06-01 00:00:00'), false) OR NOT e.enabled OR NOT coalesce(s.enabled, true) AS off, s.uri IS NOT NULL AS addressed
 FROM l LEFT JOIN elements e ON e.id=l.target_id AND e.date_deleted IS NULL LEFT JOIN elements_sites s ON s.element_id=l.target_id AND s.site_id=l.site_id)
 SELECT id, CASE WHEN missing THEN 'broken' WHEN excluded THEN 'ignored' WHEN off THEN CASE WHEN rel OR NOT addressed THEN 'broken' END WHEN NOT rel AND NOT addressed THEN 'broken' ELSE 'ok' END AS status,
 CASE WHEN missing THEN 'no-element' WHEN excluded THEN 'ignore-rule' WHEN off THEN CASE WHEN rel OR NOT addressed THEN 'no-element' END WHEN NOT rel AND NOT addressed THEN 'no-element' END AS reason FROM t"""


def _records(s, d):
    found = _links(s, d).select("page_id", "pos", "href", F.lit(None).cast("string").alias("text"), F.col("url").alias("base"))
    own = s.createDataFrame([("https://m.therou.example.com/x",)], "base_url string")
    return extract.records(found, own, rendered=True).select("page_id", "pos", "kind", "url")


_P, _E = "regexp_extract", "regexp_replace"
PAIRED: dict[str, Query] = {
    # Sources
    "changed_since": (lambda s, d: _scannable(s, d, since="1997-01-01 00:00:00").select("site_id", "element_id"), f"SELECT site_id, element_id FROM ({_SCANNABLE_SQL.replace('e.type FROM', 'e.type, es.date_updated AS a, e.date_updated AS b FROM')}) t WHERE a > TIMESTAMP '1997-01-01 00:00:00' OR b > TIMESTAMP '1997-01-01 00:00:00'"),
    "rendered_pages": (lambda s, d: sources.rendered(_scannable(s, d), 500).select("site_id", "element_id", "uri"), f"SELECT site_id, element_id, uri FROM ({_SCANNABLE_SQL}) t WHERE uri IS NOT NULL ORDER BY site_id, element_id LIMIT 500"),
    "pages_beyond_cap": (lambda s, d: sources.beyond_cap(_scannable(s, d), 100), f"SELECT greatest(0, count(*) - 100) AS n FROM ({_SCANNABLE_SQL}) t WHERE uri IS NOT NULL"),
    "elements_after": (lambda s, d: sources.after(_scannable(s, d), 2, 3000, 100).select("site_id", "element_id"), f"SELECT site_id, element_id FROM ({_SCANNABLE_SQL}) t WHERE (site_id, element_id) > (2, 3000) ORDER BY site_id, element_id LIMIT 100"),
    "url_by_hash": (lambda s, d: T(s, d, "urls").where(F.col("url_hash") == F.sha1(F.lit("https://host7.example.org/p/7"))).select("id", "url").limit(1), "SELECT id, url FROM urls WHERE url_hash=sha1('https://host7.example.org/p/7') LIMIT 1"),
    "navigation_links": (lambda s, d: extract.navigation(T(s, d, "nodes")).select("node_id", "target_id", U.normalised(F.col("href"), F.lit("https://host2.example.org/")).alias("url")), "SELECT node_id, CASE WHEN kind='element' THEN target_id END AS target_id, CASE WHEN kind='element' THEN NULL WHEN raw_url='/about' THEN concat('https://host2.example.org/about', CASE WHEN suffix IS NOT NULL THEN '?x=1' ELSE '' END) WHEN raw_url LIKE 'https:%' THEN concat('https://host1.example.org/b', CASE WHEN suffix IS NOT NULL THEN '?x=1' ELSE '' END) END AS url FROM nodes WHERE (kind='element' AND target_id IS NOT NULL) OR (kind='custom' AND trim(raw_url)<>'' AND raw_url NOT LIKE '%{%' AND raw_url NOT LIKE '%$%' AND raw_url NOT LIKE '@%')"),
    # Sinks
    "csv_export": (_export, _EXPORT_SQL),
    "csv_cells": (lambda s, d: T(s, d, "refs").select("id", export.quoted(export.cell(F.col("link_text"))).alias("cell")), f"SELECT id, {_QUOTED('link_text')} AS cell FROM refs"),
    "csv_header": (lambda s, d: s.createDataFrame([(st, ",".join(export.header(st)), export.filename(st, "2024-03-01")) for st in reports.STATUSES], "status string, header string, filename string"), "SELECT status, concat('Page,Edit URL,Page URL,Page Type,Site,Field,Link Text,URL,Verdict,Reason,Response Code,', CASE WHEN status='redirect' THEN 'Redirect Code,Goes To,' ELSE '' END, 'Host,Found Via,Places Total,First Seen,Last Checked') AS header, concat('link-audit-', name, '-2024-03-01.csv') AS filename FROM (VALUES ('pending','not-checked-yet'),('ok','working'),('broken','broken'),('redirect','redirect'),('unreachable','no-answer'),('blocked','unverifiable'),('ignored','ignored'),('unsafe','not-safe-to-request')) v(status, name)"),
    "export_count": (lambda s, d: export.count(*T(s, d, "urls", "refs"), "broken", SITES), "SELECT count(*) AS n FROM refs r JOIN urls u ON u.id=r.url_id WHERE u.status='broken' AND r.site_id IN (1,2,3)"),
    "notification": (_digest, _DIGEST_SQL),
    "notify_list": (lambda s, d: export.broken(*T(s, d, "urls", "refs"), since="2024-01-26 00:00:00").orderBy(F.desc_nulls_last("date_last_broken"), "id").limit(20).select("id", "url"), "SELECT u.id, u.url FROM urls u WHERE status='broken' AND date_last_broken >= TIMESTAMP '2024-01-26 00:00:00' AND id IN (SELECT url_id FROM refs) ORDER BY date_last_broken DESC NULLS LAST, id LIMIT 20"),
    "console_totals": (lambda s, d: reports.console_totals(*T(s, d, "urls", "refs"), sources.due(T(s, d, "urls"), NOW)), SHARED["console_totals"] + f" UNION ALL SELECT 'due', count(*) FROM urls WHERE status NOT IN ('ignored','unsafe') AND ((status='pending' AND next_check_after IS NULL) OR next_check_after <= {AS_OF})"),
    # Reports
    "permanent_filter": (lambda s, d: reports.filtered(*T(s, d, "urls", "refs"), "redirect", [1], permanent=False, internal=False, term="p/1", element_type="Entry").select("id"), "SELECT id FROM urls u WHERE status='redirect' AND NOT redirect_permanent AND NOT is_internal AND contains(lower(url), 'p/1') AND EXISTS (SELECT 1 FROM refs r WHERE r.url_id=u.id AND r.site_id=1 AND r.element_type='Entry')"),
    "url_table_by_host": (lambda s, d: reports.url_table(*T(s, d, "urls", "refs"), "unreachable", 2, page=3, per_page=20, sort="httpStatus", descending=False).select("id", "host", "http_status", "ref_count"), "SELECT u.id, u.host, u.http_status, c.n AS ref_count FROM urls u JOIN (SELECT url_id, count(*) AS n FROM refs WHERE site_id=2 GROUP BY url_id) c ON c.url_id=u.id WHERE u.status='unreachable' ORDER BY u.http_status ASC NULLS FIRST, u.id LIMIT 20 OFFSET 40"),
    "latest_scan": (lambda s, d: reports.latest_scan(T(s, d, "scans")), "SELECT id, mode, status, CAST(greatest(0, epoch(date_finished) - epoch(date_started)) AS BIGINT) AS seconds FROM scans WHERE status IN ('complete','cancelled') AND mode IN ('full','incremental') ORDER BY date_finished DESC NULLS LAST, id DESC LIMIT 1"),
    "last_scan_start": (lambda s, d: lifecycle.last_start(T(s, d, "scans").where("id < 15")), "SELECT coalesce(date_started, date_created) AS date_started FROM scans WHERE mode IN ('full','incremental') AND id<15 ORDER BY id DESC LIMIT 1"),
    "places_sum": (lambda s, d: reports.places_sum(reports.top_broken_by_places(*T(s, d, "urls", "refs"), 1)), "SELECT CAST(sum(n) AS BIGINT) AS places FROM (SELECT count(*) AS n FROM refs r JOIN urls u ON u.id=r.url_id WHERE u.status='broken' AND r.site_id=1 GROUP BY u.id ORDER BY n DESC, u.id LIMIT 5) t"),
    "masked_references": (lambda s, d: reports.references(T(s, d, "refs"), 11, SITES, can_view=F.col("site_id") != 2), "SELECT id, CASE WHEN site_id<>2 THEN element_id END AS element_id, site_id, source FROM refs WHERE url_id=11 AND site_id IN (1,2,3) ORDER BY site_id, id LIMIT 100"),
    "ignored_by": (lambda s, d: reports.ignored(*T(s, d, "ignores", "urls", "refs"), bridge.run(s, d, "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name FROM nation")).select("id", "name", "status"), "SELECT i.id, n.n_name AS name, u.status FROM ignores i LEFT JOIN urls u ON u.url_hash=i.url_hash LEFT JOIN nation n ON n.n_nationkey=i.user_id WHERE u.id IS NULL OR u.id IN (SELECT url_id FROM refs)"),
    "readable_urls": (lambda s, d: reports.readable(*T(s, d, "urls", "refs"), [4]).select("id"), "SELECT id FROM urls WHERE id IN (SELECT url_id FROM refs WHERE site_id=4)"),
    "status_labels": (lambda s, d: T(s, d, "urls").groupBy("status").agg(F.count("*").alias("n")).select("status", L.status_label(F.col("status")).alias("label"), L.status_colour(F.col("status")).alias("colour"), "n"), "SELECT status, l.label, l.colour, count(*) AS n FROM urls JOIN (VALUES ('ok','Working','green'),('redirect','Redirect','blue'),('broken','Broken','red'),('unsafe','Not safe to request','red'),('unreachable','No Answer','orange'),('blocked','Unverifiable','yellow'),('ignored','Ignored','grey'),('pending','Not checked yet','light')) l(st, label, colour) ON l.st=status GROUP BY status, l.label, l.colour"),
    "scan_labels": (lambda s, d: T(s, d, "scans").select("id", L.labels(F.col("mode"), L.MODE).alias("mode"), L.labels(F.col("status"), L.SCAN).alias("status")), "SELECT id, m.t AS mode, l.t AS status FROM scans JOIN (VALUES ('full','Everything'),('incremental','Only what changed'),('single','One item'),('check-only','URLs only')) m(k,t) ON m.k=mode JOIN (VALUES ('queued','Waiting to start'),('extracting','Reading the content'),('checking','Checking the URLs'),('complete','Finished'),('failed','Failed'),('cancelled','Cancelled')) l(k,t) ON l.k=status"),
    "answer_labels": (lambda s, d: T(s, d, "replies").select("id", L.http_status_label(F.col("http_status")).alias("label")), "SELECT id, CASE WHEN http_status IS NULL THEN NULL ELSE coalesce(l.t, CASE CAST(floor(http_status/100) AS INT) WHEN 2 THEN 'Answered normally' WHEN 3 THEN 'A redirect' WHEN 4 THEN 'The server refused it or could not find it' WHEN 5 THEN 'The server had a problem' ELSE 'A code outside the usual run of things' END) END AS label FROM replies LEFT JOIN (VALUES (200,'Answered normally'),(401,'Needs a login to see'),(403,'The server refused the request'),(404,'Not found: nothing lives at that address'),(410,'Gone: taken down on purpose'),(429,'The server asked to be asked less often'),(500,'The server hit an error of its own'),(503,'The server could not take the request just then'),(999,'A made-up code some sites use to refuse robots')) l(k,t) ON l.k=http_status"),
    "reason_labels": (lambda s, d: T(s, d, "urls").select("id", L.reason_label(F.coalesce("reason", F.col("host"))).alias("label")), "SELECT id, CASE WHEN reason='dns' THEN 'Could not find that domain' WHEN reason='timeout' THEN 'Timed out' WHEN reason='http' THEN 'The server answered with an error' WHEN reason='ignored' THEN 'Ignored by a person' WHEN reason='ignore-rule' THEN 'Ignored by a rule in the settings' WHEN reason='setting' THEN 'Not checked, per the settings' WHEN reason IS NOT NULL THEN reason WHEN host<>'' THEN host END AS label FROM urls"),
    "plain_messages": (lambda s, d: T(s, d, "replies").select("id", L.plain_message(F.col("message")).alias("message")), "SELECT id, CASE WHEN message='' THEN NULL WHEN message LIKE 'cURL error 60%' THEN 'SSL certificate problem' WHEN message LIKE 'cURL error 6:%' THEN 'Could not resolve host: x.example' ELSE message END AS message FROM replies"),
    "url_labels": (lambda s, d: T(s, d, "urls").join(T(s, d, "elements").where("date_deleted is null").select(F.concat(F.lit("element:"), F.col("id").cast("string")).alias("url"), F.concat(F.lit("Element "), F.col("id").cast("string")).alias("title")), "url", "left").select("id", L.url_label(F.col("url"), F.col("title")).alias("label")), "SELECT u.id, CASE WHEN u.url LIKE 'element:%' AND e.id IS NOT NULL THEN concat('Element ', CAST(e.id AS VARCHAR)) ELSE u.url END AS label FROM urls u LEFT JOIN (SELECT id FROM elements WHERE date_deleted IS NULL) e ON u.url=concat('element:', CAST(e.id AS VARCHAR))"),
    "field_names": (lambda s, d: T(s, d, "refs").select("id", L.field_name(F.col("field_handle"), F.when(F.col("element_id") % 3 == 0, "Label").when(F.col("element_id") % 3 == 1, "__blank__"), F.coalesce(F.col("owner_element_id") != F.col("element_id"), F.lit(False)), F.lit("Block"), F.when(F.col("element_id") % 2 == 0, "Global")).alias("name")), "SELECT id, CASE WHEN field_handle IS NULL THEN NULL WHEN element_id%3=0 THEN 'Label' WHEN element_id%3=1 AND owner_element_id<>element_id THEN 'Block' WHEN element_id%2=0 THEN 'Global' ELSE field_handle END AS name FROM refs"),
    "element_type_labels": (lambda s, d: T(s, d, "elements").select("id", L.element_type_label(F.col("type"), {"Entry": "Entry page", "Category": "Category page"}).alias("label")), "SELECT id, CASE type WHEN 'Entry' THEN 'Entry page' WHEN 'Category' THEN 'Category page' ELSE type END AS label FROM elements"),
    # Addresses
    "strip_tracking": (lambda s, d: _pages(s, d).select("page_id", U.normalised_query(U.part(F.col("url"), 4)).alias("query")), r"""SELECT page_id, nullif(array_to_string(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(lower(p), '^(utm_[^=]*|_hsenc|_hsmi|dclid|fbclid|gbraid|gclid|igshid|mc_cid|mc_eid|msclkid|ttclid|wbraid|yclid)(=|$)')), '&'), '') AS query FROM pages"""),
    "percent_norm": (lambda s, d: _links(s, d).select("page_id", "pos", U.percent_normalised(F.concat(F.lit("/%7e%2fb%2541%zz"), F.col("href"))).alias("norm")), f"SELECT page_id, pos, concat('/~%2Fb%2541%zz', href) AS norm FROM ({_CLEAN_SQL}) t"),
    "dot_segments": (lambda s, d: _links(s, d).select("page_id", "pos", U.dots_removed(F.concat(F.lit("/a/./b/.."), F.col("href"), F.lit("/../../c/."))).alias("path")), f"SELECT page_id, pos, CASE WHEN flat='' THEN '/' ELSE flat END AS path FROM (SELECT page_id, pos, list_reduce(string_split(concat('/a/./b/..', href, '/../../c/.'), '/'), lambda done, seg: CASE seg WHEN '.' THEN done WHEN '..' THEN regexp_replace(done, '/[^/]*$', '') ELSE concat(done, '/', seg) END) AS flat FROM ({_CLEAN_SQL}) t) u"),
    "fragments": (lambda s, d: _pages(s, d).select("page_id", U.fragment_of(F.col("url")).alias("fragment"), U.without_fragment(F.col("url")).alias("plain"), U.with_fragment(F.lit("https://e.org/a#old"), F.col("url")).alias("kept")), "SELECT page_id, nullif(regexp_extract(url, '#(.*)$', 1), '') AS fragment, regexp_replace(url, '#.*$', '') AS plain, CASE WHEN regexp_extract(url, '#(.*)$', 1)<>'' THEN concat('https://e.org/a#', regexp_extract(url, '#(.*)$', 1)) ELSE 'https://e.org/a#old' END AS kept FROM pages"),
    "stand_ins": (lambda s, d: T(s, d, "urls").select("id", U.stand_in_scheme(F.col("url")).alias("stand_in"), U.stand_in(F.col("id"), True).alias("relation"), U.scheme_of(F.col("url")).alias("scheme")), "SELECT id, CASE WHEN url LIKE 'element:%' THEN 'element' END AS stand_in, concat('relation:', CAST(id AS VARCHAR)) AS relation, scheme FROM urls"),
    "tidy_texts": (lambda s, d: T(s, d, "refs").select("id", U.tidy_text(F.concat(F.coalesce("link_text", F.lit(" ")), F.lit(" \t x  "), F.repeat(F.lit("y"), F.lit(300)))).alias("text")), "SELECT id, left(concat(trim(replace(coalesce(link_text, ''), chr(9), ' ')), CASE WHEN coalesce(link_text, '')='' THEN '' ELSE ' ' END, 'x ', repeat('y', 300)), 255) AS text FROM refs"),
    "credentials": (lambda s, d: T(s, d, "values_").select("id", U.without_credentials(F.col("value")).alias("value")), "SELECT id, replace(value, 'ftp://u:p@', 'ftp://') AS value FROM values_"),
    "plain_text_urls": (lambda s, d: T(s, d, "values_").select("id", extract.plain_text(F.col("value")).alias("href")).where("href is not null"), "SELECT id, trim(value) AS href FROM values_ WHERE regexp_matches(trim(value), '(?i)^https?://[^ ]+$')"),
    "table_cells": (lambda s, d: extract.cells(T(s, d, "values_").select("id", F.array(F.array(F.col("value"), F.lit("x")), F.array(F.lit("http://c.example/"))).alias("rows"))).select("id", "href"), "SELECT id, trim(value) AS href FROM values_ WHERE regexp_matches(trim(value), '(?i)^https?://[^ ]+$') UNION ALL SELECT id, 'http://c.example/' FROM values_"),
    "value_targets": (lambda s, d: T(s, d, "values_").select("id", extract.value_target(F.concat(F.lit("{Entry:"), F.col("id").cast("string"), F.when(F.col("id") % 3 == 0, "@2").otherwise(""), F.when(F.col("id") % 5 == 0, ":title}").otherwise(":url}"))).alias("target_id")), "SELECT id, CASE WHEN id%5<>0 THEN id END AS target_id FROM values_"),
    "own_vs_external": (lambda s, d: resolve.internal(_addresses(s, d), _all_bases(s, d)).select("source", "id", "is_internal"), f"SELECT a.source, a.id, a.host IN (SELECT host FROM ({_BASES}) b) AS is_internal FROM ({_ADDRESSES}) a"),
    "uri_for": (lambda s, d: resolve.site_for(_addresses(s, d).where("source = 'element'"), T(s, d, "sites"), 1).join(T(s, d, "sites").select("site_id", "base_url"), "site_id").select("id", U.uri_for(F.col("url"), F.col("base_url")).alias("uri")), "SELECT es.element_id AS id, es.uri FROM elements_sites es WHERE es.uri IS NOT NULL"),
    "numeric_hosts": (lambda s, d: T(s, d, "urls").select("id", U.numeric_host(F.when(F.col("id") % 3 == 0, F.col("id").cast("string")).when(F.col("id") % 3 == 1, F.concat(F.lit("0X"), F.hex("id"))).otherwise(F.col("host"))).alias("refused")), "SELECT id, id%3<>2 AS refused FROM urls"),
    "private_addresses": (lambda s, d: T(s, d, "urls").select("id", net.private_v4(F.concat_ws(".", (F.col("id") % 256).cast("string"), (F.floor(F.col("id") / 7) % 256).cast("string"), F.lit("2"), F.lit("1"))).alias("private")), "SELECT id, a IN (0,10,127) OR a>=224 OR (a=100 AND b BETWEEN 64 AND 127) OR (a=169 AND b=254) OR (a=172 AND b BETWEEN 16 AND 31) OR (a=192 AND b=168) OR (a=192 AND b=0) OR (a=198 AND b IN (18,19)) AS private FROM (SELECT id, id%256 AS a, CAST(floor(id/7) AS BIGINT)%256 AS b FROM urls) t"),
    "safety": (lambda s, d: T(s, d, "replies").select("id", V.safety(F.when(F.col("id") % 11 == 0, F.lit("ftp://x.example/")).when(F.col("id") % 11 == 1, F.lit("/rel")).when(F.col("id") % 11 == 2, F.lit("http://2130706433/")).otherwise(F.col("url")), F.when(F.col("id") % 7 == 0, F.array().cast("array<string>")).when(F.col("id") % 7 == 1, F.array(F.lit("8.8.8.8"), F.lit("10.0.0.1"))).otherwise(F.array(F.lit("8.8.8.8"))), F.col("host") == "x.com", net.private_v4).alias("refusal")), "SELECT id, CASE WHEN id%11=0 THEN 'scheme' WHEN id%11=1 THEN 'malformed' WHEN host='x.com' THEN NULL WHEN id%11=2 THEN 'private-ip' WHEN id%7=0 THEN 'dns' WHEN id%7=1 THEN 'private-ip' END AS refusal FROM replies"),
    # Rules and verdicts
    "uri_excluded": (lambda s, d: T(s, d, "elements_sites").select("element_id", rules.uri_excluded(s, F.col("uri"), F.col("site_id"), _EXCLUDED, {"u2": 2}).alias("excluded")), "SELECT element_id, regexp_matches(uri0, '^o/1[0-9]*7$') OR (site_id=2 AND uri0 LIKE '%o/2%') OR (site_id=3 AND uri0='') AS excluded FROM (SELECT element_id, site_id, CASE WHEN uri IS NULL OR uri='__home__' THEN '' ELSE uri END AS uri0 FROM elements_sites) t"),
    "container_excluded": (lambda s, d: T(s, d, "elements").select("id", rules.container_excluded(F.col("section_id"), F.col("group_id"), [3, 5], [1]).alias("excluded")), "SELECT id, coalesce(section_id IN (3,5), false) OR coalesce(group_id=1, false) AS excluded FROM elements"),
    "host_list": (lambda s, d: T(s, d, "urls").select("id", F.array_join(V.host_list(F.array(F.concat(F.lit(" "), F.upper("host")), F.lit(""), F.col("url"), F.lit("Z.example"))), ",").alias("hosts")), "SELECT id, CASE WHEN host='' THEN concat(url, ',z.example') ELSE concat(host, ',z.example') END AS hosts FROM urls"),
    "error_reason": (lambda s, d: T(s, d, "replies").select("id", V.error_reason(F.col("message")).alias("reason")), f"SELECT id, {_ERROR_SQL} AS reason FROM replies"),
    "error_verdict": (lambda s, d: T(s, d, "replies").select("id", V.error_verdict(F.col("error_kind"), F.col("message")).alias("v")).select("id", "v.status", "v.reason"), f"SELECT id, CASE error_kind WHEN 'unsafe-dns' THEN 'unreachable' WHEN 'unsafe' THEN 'unsafe' ELSE CASE WHEN lower(message) LIKE '%status code must be%' THEN 'blocked' WHEN error_kind='redirects' THEN 'broken' ELSE 'unreachable' END END AS status, CASE error_kind WHEN 'unsafe-dns' THEN 'dns' WHEN 'unsafe' THEN 'private-ip' ELSE CASE WHEN lower(message) LIKE '%status code must be%' OR error_kind='redirects' THEN 'http' ELSE {_ERROR_SQL} END END AS reason FROM replies"),
    "guard_verdict": (lambda s, d: T(s, d, "replies").select("id", V.guard_verdict(F.col("refusal")).alias("v")).select("id", "v.status", "v.reason"), "SELECT id, CASE WHEN refusal IS NULL THEN NULL WHEN refusal='dns' THEN 'unreachable' ELSE 'unsafe' END AS status, CASE WHEN refusal='scheme' THEN 'unsafe-scheme' ELSE refusal END AS reason FROM replies"),
    "redirect_info": (lambda s, d: _signed(s, d).select("id", V.redirect_info(F.col("chain"), F.transform("chain", lambda _: F.col("final_url"))).alias("r")).select("id", F.col("r.count").alias("hops"), "r.permanent", "r.status", "r.final_url"), "SELECT id, len(h) AS hops, CASE WHEN len(h)>0 THEN list_contains(h, '301') OR list_contains(h, '308') END AS permanent, CAST(h[1] AS INT) AS status, CASE WHEN len(h)>0 THEN final_url END AS final_url FROM (SELECT id, final_url, list_filter(string_split(hops, ','), lambda x: x<>'') AS h FROM replies) t"),
    "bot_signature": (lambda s, d: _signed(s, d).select("id", "signature"), f"SELECT id, {_SIGNATURE_SQL} AS signature FROM replies"),
    "body_snippet": (lambda s, d: T(s, d, "replies").select("id", V.body_snippet(F.col("body"), F.col("http_status"), F.col("method")).alias("snippet")), "SELECT id, CASE WHEN method='GET' AND NOT (http_status BETWEEN 200 AND 299) THEN lower(body) END AS snippet FROM replies"),
    "get_fallback": (lambda s, d: _signed(s, d).select("id", F.coalesce(V.worth_one_get(F.col("method"), F.col("http_status"), F.col("signature")), F.lit(False)).alias("again")), f"SELECT id, method='HEAD' AND coalesce(http_status IN (405,501) OR (http_status IN (400,403,404,410,503) AND {_SIGNATURE_SQL} IS NULL), false) AS again FROM replies"),
    "response_verdict": (lambda s, d: _signed(s, d).where("http_status is not null").select("id", V.response_verdict(F.col("http_status"), F.size("chain"), F.col("signature")).alias("v")).select("id", "v.status", "v.reason"), f"SELECT id, CASE WHEN st='pending' OR sig IS NULL THEN st ELSE 'blocked' END AS status, CASE WHEN st='pending' THEN 'rate-limited' WHEN sig IS NOT NULL THEN 'http' WHEN http_status BETWEEN 200 AND 299 THEN NULL ELSE 'http' END AS reason FROM (SELECT id, http_status, {_STATUS_SQL} AS st, {_SIGNATURE_SQL} AS sig FROM replies WHERE http_status IS NOT NULL) t"),
    "retry_after": (lambda s, d: T(s, d, "replies").select("id", V.retry_after(F.col("h_retry_after"), F.lit(NOW).cast("timestamp")).alias("seconds")), "SELECT id, CAST(CASE h_retry_after WHEN '120' THEN 120 WHEN '999999999999' THEN 86400 WHEN 'Fri, 01 Mar 2024 00:02:00 GMT' THEN 120 WHEN 'Sat, 02 Mar 2024 12:00:00 GMT' THEN 86400 WHEN 'Thu, 29 Feb 2024 00:00:00 GMT' THEN 0 END AS BIGINT) AS seconds FROM replies"),
    "defer_until": (lambda s, d: T(s, d, "host_log").select("seq", V.deferral_seconds(F.col("wait")).alias("seconds"), V.retry_delay((F.col("seq") % 9 + 1)).alias("delay")), "SELECT seq, CAST(least(86400, greatest(300, coalesce(wait, 0))) AS BIGINT) AS seconds, least(30.0, 0.5 * power(2.0, CAST(seq%9 AS DOUBLE))) AS delay FROM host_log"),
    "retryable": (lambda s, d: T(s, d, "check_log").select("check_id", V.retryable(F.col("status"), F.col("reason")).alias("again")), "SELECT check_id, status='unreachable' AND reason='timeout' AS again FROM check_log"),
    "resolve_internal": (_resolve_internal, _RESOLVE_SQL),
    "resolve_element": (_resolve_element, _RESOLVE_ELEMENT_SQL),
    "element_exists": (lambda s, d: resolve.live(*T(s, d, "elements_sites", "elements"), "1998-01-01 00:00:00").select("site_id", "element_id"), "SELECT es.site_id, es.element_id FROM elements_sites es JOIN elements e ON e.id=es.element_id WHERE es.uri IS NOT NULL AND es.enabled AND e.enabled AND NOT e.archived AND e.draft_id IS NULL AND e.revision_id IS NULL AND e.date_deleted IS NULL AND (e.section_id IS NULL OR (e.post_date <= TIMESTAMP '1998-01-01 00:00:00' AND (e.expiry_date IS NULL OR e.expiry_date > TIMESTAMP '1998-01-01 00:00:00')))"),
    "fragment_verdict": (lambda s, d: _pages(s, d).select("page_id", resolve.fragment_verdict(U.fragment_of(F.col("url")), F.when(F.col("page_id") % 3 > 0, F.array(F.lit("intro"), F.when(F.col("page_id") % 3 == 1, "section").otherwise("x")))).alias("status")), "SELECT page_id, CASE WHEN frag='' OR page_id%3=0 OR frag IN ('top', 'intro') OR (page_id%3=1 AND frag='section') OR (page_id%3=2 AND frag='x') THEN 'ok' ELSE 'broken' END AS status FROM (SELECT page_id, regexp_extract(url, '#(.*)$', 1) AS frag FROM pages) t"),
    "link_dispatch": (lambda s, d: resolve.dispatch(_addresses(s, d).withColumn("kind", F.when(F.col("id") % 4 == 0, "relation").when(F.col("id") % 4 == 1, "internal").when(F.col("id") % 4 == 2, "external").otherwise("ignored"))).select("source", "id", "way"), f"SELECT source, id, CASE id%4 WHEN 0 THEN 'element' WHEN 2 THEN 'http' WHEN 3 THEN 'ignored' ELSE CASE WHEN regexp_matches(url, '#.') THEN 'http' ELSE 'url' END END AS way FROM ({_ADDRESSES}) a"),
    # Extraction
    "extract_links": (lambda s, d: links.extracted(s.read.parquet(f"{d}/pages.parquet")), ""),
    "link_records": (_records, "SELECT page_id, pos, CASE WHEN lower(regexp_extract(link, '^[a-z]+://([^/:?#]*)', 1))='m.therou.example.com' THEN 'internal' ELSE 'external' END AS kind, link AS url FROM (" + _RESOLVED_ALL + ") r WHERE link IS NOT NULL"),
    "dedupe_links": (lambda s, d: extract.last_of_each(_links(s, d), url="href").select("page_id", "href", "pos"), f"SELECT page_id, href, max(pos) AS pos FROM ({_CLEAN_SQL}) t GROUP BY page_id, href"),
    "nested_walk": (lambda s, d: extract.walk(s.createDataFrame([(1,), (2,), (7,)], "element_id long"), T(s, d, "nesting")), "WITH RECURSIVE w(root, element_id, depth) AS (SELECT v, v, 0 FROM (VALUES (CAST(1 AS BIGINT)), (2), (7)) r(v) UNION SELECT w.root, n.element_id, w.depth + 1 FROM w JOIN nesting n ON n.owner_id=w.element_id WHERE w.depth < 10) SELECT root, element_id, CAST(min(depth) AS INT) AS depth FROM w GROUP BY root, element_id"),
    "element_links": (lambda s, d: extract.element_links(T(s, d, "refs").select("id", F.col("url_id").alias("target_id")), T(s, d, "urls").where("id % 3 = 0 and host <> ''").select("id", "url"), True).select("id", "kind", "url"), "SELECT r.id, 'relation' AS kind, coalesce(u.url, concat('relation:', CAST(r.url_id AS VARCHAR))) AS url FROM refs r LEFT JOIN urls u ON u.id=r.url_id AND u.id%3=0 AND u.host<>''"),
    # State
    "verdict_fold_seeded": (lambda s, d: fold.fold(T(s, d, "check_log"), T(s, d, "urls").withColumnRenamed("id", "url_id")).select("url_id", "status", "fail_count", "last_broken"), """SELECT url_id, arg_max(now, (checked_at, check_id)) AS status, CAST(arg_max(fails, (checked_at, check_id)) AS BIGINT) AS fail_count, max(CASE WHEN now='broken' AND before<>'broken' THEN checked_at END) AS last_broken
 FROM (SELECT *, lag(now, 1, status0) OVER (PARTITION BY url_id ORDER BY checked_at, check_id) AS before FROM (SELECT *, CASE WHEN status='unreachable' AND fails >= CASE WHEN reason='dns' THEN 2 ELSE 3 END THEN 'broken' ELSE status END AS now
 FROM (SELECT *, CASE WHEN g=0 THEN fails0 ELSE 0 END + sum(CASE WHEN status='unreachable' THEN 1 ELSE 0 END) OVER (PARTITION BY url_id, g ORDER BY checked_at, check_id) AS fails FROM (SELECT c.*, coalesce(u.status, 'pending') AS status0, coalesce(u.fail_count, 0) AS fails0, sum(CASE WHEN c.status IN ('ok','redirect') THEN 1 ELSE 0 END) OVER (PARTITION BY c.url_id ORDER BY c.checked_at, c.check_id) AS g FROM check_log c LEFT JOIN urls u ON u.id=c.url_id WHERE c.status<>'pending' AND NOT coalesce(u.status='ignored' AND u.reason='ignored', false)) a) b) c) e GROUP BY url_id"""),
    "host_fold": (lambda s, d: hosts.folded(T(s, d, "host_log")).select("host", "consecutive_failures", "last_status", "bot_hostile", "blocked_until"), """WITH k AS (SELECT *, CASE WHEN status IN ('ok','redirect','broken','blocked') THEN 's' WHEN status='unreachable' THEN 'f' ELSE 'l' END AS kind FROM host_log),
 g AS (SELECT *, sum(CASE WHEN kind='s' THEN 1 ELSE 0 END) OVER (PARTITION BY host ORDER BY seen_at, seq) AS g FROM k), f AS (SELECT *, sum(CASE WHEN kind='f' THEN 1 ELSE 0 END) OVER (PARTITION BY host, g ORDER BY seen_at, seq) AS fails, max(g) OVER (PARTITION BY host) AS last_g FROM g),
 b AS (SELECT *, CASE WHEN kind='l' THEN seen_at + to_seconds(least(900, greatest(1, coalesce(wait, 60)))) WHEN kind='f' AND fails>=3 THEN seen_at + to_seconds(CAST(least(900, 60*power(2, fails-3)) AS BIGINT)) END AS until FROM f)
 SELECT host, CAST(arg_max(fails, (seen_at, seq)) AS BIGINT) AS consecutive_failures, arg_max(http_status, (seen_at, seq)) AS last_status, bool_or(status='blocked') AS bot_hostile, arg_max(until, (seen_at, seq)) FILTER (WHERE g=last_g AND until IS NOT NULL) AS blocked_until FROM b GROUP BY host"""),
    "learned_delays": (lambda s, d: T(s, d, "host_log").select("seq", hosts.learned_delay(F.col("wait")).alias("learned"), hosts.decayed(F.col("wait") * 10).alias("decayed")), "SELECT seq, CAST(least(30000, least(900, greatest(1, coalesce(wait, 60)))*1000) AS BIGINT) AS learned, CASE WHEN floor(wait*10/2) > 250 THEN CAST(floor(wait*10/2) AS BIGINT) END AS decayed FROM host_log"),
    "fetch_plan": (lambda s, d: hosts.plan(*T(s, d, "urls", "hosts"), NOW, budget=9.0), f"""SELECT id, host, sweep, blocked OR over_budget AS deferred, CASE WHEN blocked OR over_budget THEN 'host-backoff' END AS reason, CASE WHEN blocked THEN CAST(least(86400, greatest(300, left_s)) AS BIGINT) WHEN over_budget THEN 300 END AS seconds FROM (SELECT u.id, u.host, row_number() OVER (PARTITION BY u.host ORDER BY u.id) AS sweep, coalesce(h.blocked_until > {AS_OF}, false) AS blocked, epoch(h.blocked_until) - epoch({AS_OF}) AS left_s, row_number() OVER (PARTITION BY u.host ORDER BY u.id) > 1 + floor(9000.0 / greatest(250, coalesce(h.min_delay_ms, 0))) AS over_budget FROM urls u LEFT JOIN hosts h ON h.host=u.host WHERE u.host<>'') t"""),
    "stale_prune_result": (lambda s, d: lifecycle.stale_refs(T(s, d, "refs"), 4, "1996-01-01 00:00:00", 2).select("id", "site_id", "source"), f"SELECT id, site_id, source FROM refs WHERE NOT coalesce((scan_id IS NULL OR scan_id < 4) AND source<>'rendered' AND date_created < {_LATE} AND site_id=2, false)"),
    "rendered_dropped": (lambda s, d: state.replace(T(s, d, "refs"), F.col("source") == "rendered").select("id"), "SELECT id FROM refs WHERE source<>'rendered'"),
    "replace_owned_refs": (lambda s, d: state.replace(T(s, d, "refs"), state.of_element([10, 20, 30, 40, 50, 60, 70], 2, ("field",)), T(s, d, "refs").where("site_id = 5 and url_id < 9").withColumn("scan_id", F.lit(99).cast("long"))).select("id", "url_id", "scan_id"), "SELECT id, url_id, scan_id FROM refs WHERE NOT (site_id=2 AND source='field' AND (element_id IN (10,20,30,40,50,60,70) OR coalesce(owner_element_id IN (10,20,30,40,50,60,70), false))) UNION ALL SELECT id, url_id, 99 FROM refs WHERE site_id=5 AND url_id<9"),
    "replace_site_refs": (lambda s, d: state.replace(T(s, d, "refs"), state.of_site(3, ("nav",))).select("id"), "SELECT id FROM refs WHERE NOT (site_id=3 AND source='nav')"),
    "deleted_element_orphans": (lambda s, d: T(s, d, "urls").select("id").join(state.element_deleted(*T(s, d, "urls", "refs"), 10)[0].select("id"), "id", "left_anti"), "SELECT DISTINCT url_id AS id FROM refs r JOIN urls u ON u.id=r.url_id WHERE (element_id=10 OR owner_element_id=10) AND NOT EXISTS (SELECT 1 FROM refs k WHERE k.url_id=r.url_id AND k.element_id<>10 AND coalesce(k.owner_element_id, 0)<>10)"),
    "bring_forward": (lambda s, d: state.brought_forward(T(s, d, "urls"), T(s, d, "urls").where("id % 4 = 0").select("url_hash"), NOW).select("id", "status", "next_check_after"), f"SELECT id, status, CASE WHEN id%4=0 AND status<>'ignored' THEN {AS_OF} - INTERVAL '1' MINUTE ELSE next_check_after END AS next_check_after FROM urls"),
    "ignore_urls": (lambda s, d: state.ignored(*T(s, d, "urls", "ignores"), T(s, d, "urls").where("id % 10 = 1").select("url_hash", F.col("url").alias("value"), F.lit(5).cast("long").alias("user_id"), F.lit(NOW).cast("timestamp_ntz").alias("date_created")))[0].select("id", "status", "reason", "next_check_after"), "SELECT id, CASE WHEN id%10=1 THEN 'ignored' ELSE status END AS status, CASE WHEN id%10=1 THEN 'ignored' ELSE reason END AS reason, CASE WHEN id%10<>1 THEN next_check_after END AS next_check_after FROM urls"),
    "ignore_restore": (lambda s, d: state.restored(*T(s, d, "urls", "ignores"), T(s, d, "urls").where("id % 2 = 0 and status = 'ignored'").select("url_hash"))[0].select("id", "status", "reason"), "SELECT id, CASE WHEN status='ignored' AND id%2=0 THEN 'pending' ELSE status END AS status, reason FROM urls"),
    "recheck_broken": (lambda s, d: state.due_again(T(s, d, "urls"), NOW).select("id", "next_check_after"), f"SELECT id, CASE WHEN status IN ('broken','unreachable') THEN {AS_OF} - INTERVAL '1' MINUTE ELSE next_check_after END AS next_check_after FROM urls"),
    "element_due": (lambda s, d: state.element_due(*T(s, d, "urls", "refs"), 10, 1, NOW).select("id", "next_check_after"), f"SELECT id, CASE WHEN status<>'ignored' AND id IN (SELECT url_id FROM refs WHERE site_id=1 AND (element_id=10 OR owner_element_id=10)) THEN {AS_OF} - INTERVAL '1' MINUTE ELSE next_check_after END AS next_check_after FROM urls"),
    "finalised_scan": (lambda s, d: lifecycle.finalised({"id": 4, "mode": "full", "date_started": "1996-01-01 00:00:00"}, *T(s, d, "urls", "refs"), NOW, crawling=False)[2], f"WITH kept AS (SELECT * FROM refs WHERE source<>'rendered' AND NOT ((scan_id IS NULL OR scan_id < 4) AND date_created < {_LATE})) SELECT CAST(4 AS BIGINT) AS id, 'complete' AS status, (SELECT count(DISTINCT url_id) FROM kept WHERE scan_id=4) AS urls_total, (SELECT count(*) FROM urls WHERE status='broken' AND id IN (SELECT url_id FROM kept)) AS urls_broken"),
    "scan_counters": (lambda s, d: lifecycle.counted(T(s, d, "scans").select("id"), bridge.run(s, d, "SELECT CAST(s_nationkey+1 AS BIGINT) AS scan_id, CASE s_suppkey%4 WHEN 0 THEN 'urls_checked' WHEN 1 THEN 'urls_broken' WHEN 2 THEN 'elements_scanned' ELSE 'pages_crawled' END AS counter, s_suppkey%7 AS n FROM supplier")), "SELECT c.id, CAST(coalesce(sum(CASE WHEN s_suppkey%4=0 THEN s_suppkey%7 END), 0) AS BIGINT) AS urls_checked, CAST(coalesce(sum(CASE WHEN s_suppkey%4=1 THEN s_suppkey%7 END), 0) AS BIGINT) AS urls_broken, CAST(coalesce(sum(CASE WHEN s_suppkey%4=2 THEN s_suppkey%7 END), 0) AS BIGINT) AS elements_scanned, CAST(coalesce(sum(CASE WHEN s_suppkey%4=3 THEN s_suppkey%7 END), 0) AS BIGINT) AS pages_crawled FROM scans c LEFT JOIN supplier ON s_nationkey+1=c.id GROUP BY c.id"),
    "scan_may_start": (lambda s, d: lifecycle.may_start(T(s, d, "scans"), "full", "2024-01-24 02:00:00").unionByName(lifecycle.may_start(T(s, d, "scans"), "single", NOW)), "SELECT NOT EXISTS (SELECT 1 FROM scans WHERE mode IN ('full','incremental') AND status IN ('queued','extracting','checking') AND date_updated > TIMESTAMP '2024-01-24 01:00:00') AS allowed UNION ALL SELECT true"),
    "scan_due": (lambda s, d: lifecycle.due(T(s, d, "scans"), "2024-01-25 12:00:00", hours=6).unionByName(lifecycle.due(T(s, d, "scans"), "2024-01-25 12:00:00", hours=600)), "SELECT l.t <= TIMESTAMP '2024-01-25 12:00:00' - h.h * INTERVAL '1' HOUR AND NOT EXISTS (SELECT 1 FROM scans WHERE status IN ('queued','extracting','checking') AND date_updated > TIMESTAMP '2024-01-25 11:00:00') AS due FROM (SELECT coalesce(date_started, date_created) AS t FROM scans WHERE mode IN ('full','incremental') ORDER BY id DESC LIMIT 1) l, (VALUES (6),(600)) h(h)"),
}
