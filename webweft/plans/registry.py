"""The registered audit queries.  SHARED statements are plain SQL that both engines read the same way; PAIRED
queries are DataFrame operators with an independent SQL text for comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import links, reftag
from ..functions import url as U
from ..operators import fold, reports
from ..sources import bridge

AS_OF = "TIMESTAMP '2024-03-01 00:00:00'"
ON_SITE = "EXISTS (SELECT 1 FROM refs r WHERE r.url_id = u.id AND r.site_id = 1)"

SHARED: dict[str, str] = {
    # Counts and option lists
    "permanent_redirects": f"SELECT count(*) AS n FROM urls u WHERE status='redirect' AND redirect_permanent AND {ON_SITE}",
    "dismissed_count": "SELECT count(*) AS n FROM ignores i LEFT JOIN urls u ON u.url_hash=i.url_hash LEFT JOIN (SELECT DISTINCT url_id FROM refs) r ON r.url_id=u.id WHERE u.id IS NULL OR r.url_id IS NOT NULL",
    "verdict_counts_multi_site": "SELECT status, count(*) AS n FROM urls u WHERE EXISTS (SELECT 1 FROM refs r WHERE r.url_id=u.id AND r.site_id IN (1,3)) GROUP BY status",
    "top_hosts": f"SELECT host, count(*) AS n FROM urls u WHERE status='broken' AND host<>'' AND {ON_SITE} GROUP BY host ORDER BY n DESC, host LIMIT 5",
    "host_options": f"SELECT host, concat(host, ' (', CAST(count(*) AS VARCHAR(20)), ')') AS label FROM urls u WHERE status='broken' AND host<>'' AND {ON_SITE} GROUP BY host",
    "element_type_options": "SELECT DISTINCT r.element_type FROM refs r JOIN urls u ON u.id=r.url_id WHERE u.status='broken' AND r.site_id=1",
    "url_count": f"SELECT count(*) AS n FROM urls u WHERE {ON_SITE}",
    "reference_count": "SELECT count(*) AS n FROM refs WHERE site_id IN (1,2)",
    "internal_broken": f"SELECT count(*) AS n FROM urls u WHERE status='broken' AND is_internal AND {ON_SITE}",
    "recently_broken": f"SELECT count(*) AS n FROM urls u WHERE status='broken' AND date_last_ok >= TIMESTAMP '2024-02-01 00:00:00' AND {ON_SITE}",
    "first_seen_broken": f"SELECT count(*) AS n FROM urls u WHERE status='broken' AND date_first_seen >= TIMESTAMP '2024-01-15 00:00:00' AND {ON_SITE}",
    "element_summary": "SELECT r.element_id, count(DISTINCT r.url_id) AS total, count(DISTINCT CASE WHEN u.status<>'pending' THEN r.url_id END) AS checked, count(DISTINCT CASE WHEN u.status='broken' THEN r.url_id END) AS broken, max(u.date_last_checked) AS last_checked FROM refs r JOIN urls u ON u.id=r.url_id WHERE r.site_id=1 GROUP BY r.element_id",
    "element_broken_locations": "SELECT element_id, url, ref_id FROM (SELECT r.element_id, u.url, r.id AS ref_id, row_number() OVER (PARTITION BY r.element_id, u.id ORDER BY r.id) AS k FROM refs r JOIN urls u ON u.id=r.url_id WHERE u.status='broken' AND r.site_id=1) t WHERE k=1",
    "console_totals": "SELECT status AS name, count(*) AS n FROM urls GROUP BY status UNION ALL SELECT 'references', count(*) FROM refs UNION ALL SELECT CASE WHEN is_internal THEN 'internal' ELSE 'external' END, count(*) FROM urls GROUP BY is_internal",
    "console_hosts": "SELECT host, count(*) AS n FROM urls WHERE status IN ('broken','unreachable') GROUP BY host ORDER BY n DESC, host LIMIT 10",
    "scan_totals": "SELECT scan_id, count(DISTINCT url_id) AS n FROM refs WHERE scan_id IS NOT NULL GROUP BY scan_id",
    "referenced_broken": "SELECT count(*) AS n FROM urls WHERE status='broken' AND id IN (SELECT url_id FROM refs)",
    "place_counts": "SELECT url_id, count(*) AS places FROM refs WHERE site_id=1 AND source='field' GROUP BY url_id",
    "attributed_urls": "SELECT DISTINCT url_id FROM refs WHERE source<>'rendered'",
    "incremental_cutoff": "SELECT CASE WHEN count(*) > count(latest) THEN NULL ELSE min(latest) END AS since FROM (SELECT s.site_id, max(c.date_started) AS latest FROM sites s LEFT JOIN scans c ON c.status='complete' AND c.mode IN ('full','incremental') AND (c.site_id IS NULL OR c.site_id=s.site_id) WHERE s.site_id IN (1,2,3) GROUP BY s.site_id) t",
    # Lists
    "url_table_p2": f"SELECT u.id, u.url, u.status, c.n AS ref_count FROM urls u JOIN (SELECT url_id, count(*) AS n FROM refs WHERE site_id=1 GROUP BY url_id) c ON c.url_id=u.id WHERE u.status='broken' ORDER BY u.date_last_checked DESC NULLS LAST, u.id LIMIT 50 OFFSET 50",
    "url_table_by_refs": "SELECT u.id, u.url, c.n AS ref_count FROM urls u JOIN (SELECT url_id, count(*) AS n FROM refs WHERE site_id=1 AND element_type='Entry' AND source='field' GROUP BY url_id) c ON c.url_id=u.id WHERE u.status='ok' ORDER BY c.n DESC, u.id LIMIT 100",
    "url_search": f"SELECT id, url FROM urls u WHERE contains(lower(url), lower('HOST7.')) AND {ON_SITE}",
    "url_references": "SELECT id, element_id, site_id, source FROM refs WHERE url_id=7 AND site_id IN (1,2,3) ORDER BY site_id, id LIMIT 100",
    "running_scan": "SELECT id, mode FROM scans WHERE status IN ('queued','extracting','checking') AND date_updated > TIMESTAMP '2024-01-23 01:00:00' ORDER BY id DESC LIMIT 1",
    "recent_scans": "SELECT id, mode, status FROM scans ORDER BY id DESC LIMIT 5",
    "ignored_list": "SELECT i.id, i.value, i.user_id, u.status FROM ignores i LEFT JOIN urls u ON u.url_hash=i.url_hash LEFT JOIN (SELECT DISTINCT url_id FROM refs) r ON r.url_id=u.id WHERE u.id IS NULL OR r.url_id IS NOT NULL ORDER BY i.date_created DESC, i.id DESC LIMIT 200",
    # Sources and scheduling
    "due_urls": f"SELECT id FROM urls WHERE status NOT IN ('ignored','unsafe') AND ((status='pending' AND next_check_after IS NULL) OR next_check_after <= {AS_OF})",
    "scannable_elements": "SELECT es.site_id, es.element_id, es.uri FROM elements_sites es JOIN elements e ON e.id=es.element_id LEFT JOIN elements_owners o ON o.element_id=e.id WHERE o.element_id IS NULL AND es.enabled AND e.enabled AND NOT e.archived AND e.draft_id IS NULL AND e.revision_id IS NULL AND e.date_deleted IS NULL AND e.type IN ('Entry','Category') AND (e.section_id IS NULL OR e.section_id NOT IN (3,5))",
    "check_chunks": f"SELECT id, CAST(floor((row_number() OVER (ORDER BY id) - 1) / 25) AS BIGINT) AS chunk FROM urls WHERE next_check_after <= {AS_OF} AND status NOT IN ('ignored','unsafe')",
    "blocked_hosts": "SELECT host, consecutive_failures, CASE WHEN consecutive_failures >= 3 THEN CAST(least(900.0, 60.0 * power(2.0, CAST(consecutive_failures - 3 AS DOUBLE))) AS BIGINT) END AS block_seconds FROM hosts",
    "effective_delay": "SELECT host, CAST(greatest(250, coalesce(min_delay_ms, 0)) AS BIGINT) AS delay_ms FROM hosts",
    # Pruning and mutation
    "orphan_urls": "SELECT u.id FROM urls u LEFT JOIN refs r ON r.url_id=u.id WHERE r.url_id IS NULL AND u.date_first_seen < TIMESTAMP '2024-02-01 00:00:00'",
    "stale_refs": "SELECT id FROM refs WHERE (scan_id IS NULL OR scan_id < 4) AND source<>'rendered' AND date_created < TIMESTAMP '1996-01-01 00:00:00'",
    "hosts_unused": "SELECT h.host FROM hosts h WHERE h.host NOT IN (SELECT DISTINCT host FROM urls WHERE host<>'')",
    "upsert_urls": "SELECT n.url_hash, coalesce(u.id, -1) AS id, coalesce(u.status, CASE WHEN i.url_hash IS NOT NULL THEN 'ignored' ELSE 'pending' END) AS status FROM (SELECT DISTINCT sha1('https://gone.example.org/'||CAST(p_partkey AS VARCHAR(20))) AS url_hash FROM part UNION SELECT sha1('https://host'||CAST(p_partkey%37 AS VARCHAR(20))||'.example.org/p/'||CAST(p_partkey AS VARCHAR(20))) FROM part) n LEFT JOIN urls u ON u.url_hash=n.url_hash LEFT JOIN ignores i ON i.url_hash=n.url_hash",
    "rendered_minus_attributed": "SELECT r.id FROM refs r WHERE r.source='rendered' AND NOT EXISTS (SELECT 1 FROM refs a WHERE a.source<>'rendered' AND a.url_id=r.url_id AND a.site_id=r.site_id AND coalesce(a.owner_element_id, a.element_id)=coalesce(r.owner_element_id, r.element_id))",
    "release_ignores": "SELECT id, CASE WHEN status='ignored' AND reason IN ('setting','ignore-rule') THEN 'pending' ELSE status END AS status, CASE WHEN status='ignored' AND reason IN ('setting','ignore-rule') THEN NULL ELSE reason END AS reason FROM urls",
    "prune_history": "SELECT id FROM scans WHERE status IN ('complete','cancelled','failed') AND date_started < TIMESTAMP '2024-01-10 00:00:00'",
    # Verdicts
    "verdict_from_response": "SELECT id, CASE WHEN http_status BETWEEN 200 AND 299 THEN CASE WHEN hops>0 THEN 'redirect' ELSE 'ok' END WHEN http_status=429 THEN 'pending' WHEN http_status>=500 THEN 'unreachable' WHEN http_status IN (401,407) THEN 'blocked' ELSE 'broken' END AS status, CASE WHEN http_status BETWEEN 200 AND 299 THEN NULL WHEN http_status=429 THEN 'rate-limited' ELSE 'http' END AS reason FROM responses",
}

# The reference's full rules, beside the shorter statements above.  Addresses: the audit's, the sites' own and pages.
_OWN = "SELECT 'element' AS source, es.element_id AS id, CASE WHEN es.uri='__home__' THEN s.base_url ELSE concat(s.base_url, es.uri) END AS url FROM elements_sites es JOIN sites s ON s.site_id=es.site_id WHERE es.uri IS NOT NULL"
_ADDRESSES = f"SELECT source, id, url, lower(regexp_extract(url, '^[^:/?#]+://(?:[^/?#]*@)?([^/?#:]*)', 1)) AS host, regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '^[^?#]*([?][^#]*)', 1) AS query FROM (SELECT 'url' AS source, id, url FROM urls UNION ALL {_OWN} UNION ALL SELECT 'page', page_id, url FROM pages) raw"
# Settings: sites below a path of another one, the fallback site, ignore rules (order, enabled, text).
SUBSITES = ((11, "https://europe.example.com/o"), (12, "https://europe.example.com/o/1/"), (13, "https://asia.example.com/o/"), (14, "https://ASIA.example.com/o"))
FALLBACK_SITE = 1
IGNORE_HOSTS = ((1, False, "host4.example.org"), (2, True, " Host3.example.org "), (3, True, "ost5.example.org"), (4, True, " "), (5, True, "example.net"))
IGNORE_PATTERNS = ((1, False, "/p/2"), (2, True, " /P/1[0-9]*7$ "), (3, True, "^https://host1[12][.]"))


def _values(rows: tuple, columns: str) -> str:
    spell = lambda v: "'" + v + "'" if isinstance(v, str) else str(v)
    return f"(VALUES {', '.join('(' + ', '.join(map(spell, r)) + ')' for r in rows)}) v({columns})"


_BASES = f"SELECT site_id, lower(regexp_extract(base_url, '^[^:/?#]+://([^/?#:]*)', 1)) AS host, regexp_replace(regexp_extract(base_url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1), '/+$', '') AS base_path FROM (SELECT site_id, base_url FROM sites UNION ALL SELECT * FROM {_values(SUBSITES, 'site_id, base_url')}) all_sites"
SHARED |= {
    "panel_label": f"SELECT source, id, CASE WHEN length(label) > 44 THEN concat(substring(label, 1, 26), '…', right(label, 17)) ELSE label END AS label FROM (SELECT a.source, a.id, CASE WHEN o.host IS NULL THEN a.url ELSE concat(CASE WHEN a.path='' THEN '/' ELSE a.path END, a.query) END AS label FROM ({_ADDRESSES}) a LEFT JOIN (SELECT DISTINCT host FROM ({_BASES}) b) o ON o.host=a.host) t",
    "ignore_verdict": f"SELECT id, CASE WHEN by_hash THEN 'ignored' WHEN rule IS NOT NULL THEN 'ignore-rule' END AS reason, CASE WHEN NOT by_hash THEN rule END AS rule FROM (SELECT u.id, i.url_hash IS NOT NULL AS by_hash, m.rule, row_number() OVER (PARTITION BY u.id ORDER BY m.kind NULLS LAST, m.ord) AS k FROM urls u LEFT JOIN (SELECT DISTINCT url_hash FROM ignores) i ON i.url_hash=u.url_hash LEFT JOIN (SELECT 1 AS kind, ord, trim(rule) AS rule FROM {_values(IGNORE_HOSTS, 'ord, enabled, rule')} WHERE enabled AND trim(rule)<>'' UNION ALL SELECT 2, ord, trim(rule) FROM {_values(IGNORE_PATTERNS, 'ord, enabled, rule')} WHERE enabled AND trim(rule)<>'') m ON CASE WHEN m.kind=1 THEN u.host<>'' AND (lower(u.host)=lower(m.rule) OR right(lower(u.host), length(m.rule)+1)=concat('.', lower(m.rule))) ELSE regexp_extract(u.url, concat('(?i)^.*?(?:', m.rule, ').*$'), 0)<>'' END) t WHERE k=1",
    "site_for_url": f"SELECT source, id, site_id FROM (SELECT a.source, a.id, coalesce(b.site_id, {FALLBACK_SITE}) AS site_id, row_number() OVER (PARTITION BY a.source, a.id ORDER BY length(b.base_path) DESC NULLS LAST, b.site_id) AS k FROM ({_ADDRESSES}) a LEFT JOIN ({_BASES}) b ON b.host=a.host AND (b.base_path='' OR a.path=b.base_path OR left(a.path, length(b.base_path)+1)=concat(b.base_path, '/'))) t WHERE k=1",
}

Q = "https://ex.org/b/c?x=1"


def _url_frame(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/pages.parquet").select("page_id", "url")


_EXAMPLES = ("HTTP://Ex.ORG:80/%7euser/%2fb/./a/../c?utm_source=x&b=%2f&gclid=1&a=1#f", "../up", "?q=2", "/root//x/", "//other.org", "mailto:a@b", "#top", "tel:1", "foo:bar", "https://a_b.org:8443", "  https://e.org/a b ", "x/./y/../../../z", "javascript:void(0)", "https://e.org/?fbclid=1", "https://u:p@e.org/")


_TAGS = ("{entry:12:url}", "{asset:7@2:url||https://ex.org/a}", " {category:news/x@fr} ", "%7Bentry:5:url%7d#top", "https://ex.org/{entry:1}", "{entry}")


def _examples(s: SparkSession) -> DataFrame:
    return s.createDataFrame([(i, x) for i, x in enumerate(_EXAMPLES)], "id int, href string")


def _links(s: SparkSession, d: str) -> DataFrame:
    read = links.bodies(s.read.parquet(f"{d}/pages.parquet").select("page_id", "url", "html"), "html", images=False)
    found = F.transform(F.filter("links", lambda x: x["tag"] == "a"), lambda x: x["href"])
    return read.select("page_id", "url", F.posexplode(found).alias("pos", "href"))


#: Every anchor of the pages, in page order; the statements find it by a pattern.
_CLEAN_SQL = r"""SELECT page_id, url, CAST(generate_subscripts(hrefs, 1) - 1 AS INT) AS pos, unnest(hrefs) AS href FROM (SELECT page_id, url, regexp_extract_all(html, '(?is)<a\b[^>]*?\bhref\s*=\s*"([^"]*)"', 1) AS hrefs FROM pages) a"""
_RESOLVED_ALL = r"""WITH a AS (SELECT page_id, url, regexp_extract_all(html, '(?is)<a\b[^>]*?\bhref\s*=\s*"([^"]*)"', 1) AS found FROM pages),
 b AS (SELECT page_id, url, unnest(found) AS href, CAST(generate_subscripts(found, 1) - 1 AS INT) AS pos, concat(' ', chr(9), chr(10), chr(13), chr(0), chr(11)) AS blank FROM a),
 c AS (SELECT page_id, pos, trim(href, blank) AS raw, regexp_extract(url, '^([^:/?#]+)://', 1) AS bscheme, regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1) AS bauth, coalesce(nullif(regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1), ''), '/') AS bpath,
  trim(replace(replace(replace(replace(replace(replace(replace(trim(replace(replace(replace(href, chr(9), ''), chr(10), ''), chr(13), ''), blank), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&#039;', chr(39)), '&apos;', chr(39)), '&amp;', '&'), blank) AS ref FROM b),
 d AS (SELECT page_id, pos, raw <> '' AND NOT starts_with(raw, '#') AND lower(regexp_extract(raw, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) IN ('', 'http', 'https') AS checkable,
  CASE WHEN regexp_matches(ref, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN ref WHEN bauth = '' THEN NULL WHEN starts_with(ref, '//') THEN concat(bscheme, ':', ref) WHEN starts_with(ref, '/') THEN concat(bscheme, '://', bauth, ref) WHEN starts_with(ref, '?') THEN concat(bscheme, '://', bauth, bpath, ref) ELSE concat(bscheme, '://', bauth, regexp_replace(bpath, '[^/]*$', ''), ref) END AS whole FROM c),
 e AS (SELECT page_id, pos, checkable, lower(regexp_extract(whole, '^([^:/?#]+):', 1)) AS scheme, regexp_replace(regexp_extract(whole, '^[^:/?#]+://([^/?#]*)', 1), '^.*@', '') AS auth, replace(regexp_extract(whole, '(?s)^[^:/?#]+:(?://[^/?#]*)?([^?#]*)', 1), ' ', '%20') AS path, regexp_extract(whole, '(?s)^[^?#]*\?([^#]*)', 1) AS query FROM d),
 f AS (SELECT page_id, pos, checkable, scheme, lower(regexp_replace(auth, ':[0-9]*$', '')) AS host, regexp_extract(auth, ':([0-9]+)$', 1) AS port, path,
  replace(array_to_string(list_filter(string_split(query, '&'), lambda p: p <> '' AND NOT regexp_matches(lower(p), '^(utm_[^=]*|_hsenc|_hsmi|dclid|fbclid|gbraid|gclid|igshid|mc_cid|mc_eid|msclkid|ttclid|wbraid|yclid)(=|$)')), '&'), ' ', '%20') AS query FROM e),
 g AS (SELECT page_id, pos, checkable, scheme, host, port,
  array_to_string(list_transform(string_split(path, '%'), lambda p, i: CASE WHEN i = 1 THEN p WHEN NOT regexp_matches(p, '^[0-9A-Fa-f]{2}') THEN concat('%', p) WHEN regexp_matches(p, '^(2[DdEe]|3[0-9]|[46][1-9A-Fa-f]|[57][0-9Aa]|5[Ff]|7[Ee])') THEN concat(chr(CAST(concat('0x', p[1:2]) AS INT)), p[3:]) ELSE concat('%', upper(p[1:2]), p[3:]) END), '') AS path,
  array_to_string(list_transform(string_split(query, '%'), lambda p, i: CASE WHEN i = 1 THEN p WHEN NOT regexp_matches(p, '^[0-9A-Fa-f]{2}') THEN concat('%', p) WHEN regexp_matches(p, '^(2[DdEe]|3[0-9]|[46][1-9A-Fa-f]|[57][0-9Aa]|5[Ff]|7[Ee])') THEN concat(chr(CAST(concat('0x', p[1:2]) AS INT)), p[3:]) ELSE concat('%', upper(p[1:2]), p[3:]) END), '') AS query FROM f),
 h AS (SELECT *, list_reduce(string_split(path, '/'), lambda done, seg: CASE seg WHEN '.' THEN done WHEN '..' THEN regexp_replace(done, '/[^/]*$', '') ELSE concat(done, '/', seg) END) AS flat FROM g)
 SELECT page_id, pos, CASE WHEN checkable AND scheme IN ('http', 'https') AND length(host) <= 253 AND (regexp_matches(host, '^[a-z0-9_]([a-z0-9_-]*[a-z0-9_])?(\.[a-z0-9_]([a-z0-9_-]*[a-z0-9_])?)*\.?$') OR regexp_matches(host, '^\[[0-9a-f:.]+\]$'))
  THEN concat(scheme, '://', host, CASE WHEN port = '' OR (scheme = 'http' AND port = '80') OR (scheme = 'https' AND port = '443') THEN '' ELSE concat(':', port) END, CASE WHEN flat = '' THEN '/' ELSE flat END, CASE WHEN query <> '' THEN concat('?', query) ELSE '' END) END AS link FROM h"""


PAIRED: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "verdict_counts": (
        lambda s, d: reports.verdict_counts(bridge.view(s, d, "urls"), bridge.view(s, d, "refs"), [1]),
        "SELECT v.status, count(u.id) AS n FROM (VALUES ('pending'),('ok'),('broken'),('redirect'),('unreachable'),('blocked'),('ignored'),('unsafe')) v(status) LEFT JOIN (SELECT id, status FROM urls WHERE id IN (SELECT url_id FROM refs WHERE site_id=1)) u ON u.status=v.status GROUP BY v.status",
    ),
    "top_broken_by_places": (
        lambda s, d: reports.top_broken_by_places(bridge.view(s, d, "urls"), bridge.view(s, d, "refs"), 1),
        "SELECT u.id, u.url, u.http_status, count(*) AS places FROM urls u JOIN refs r ON r.url_id=u.id WHERE u.status='broken' AND r.site_id=1 GROUP BY u.id, u.url, u.http_status ORDER BY places DESC, u.id LIMIT 5",
    ),
    "top_pages": (
        lambda s, d: reports.top_pages(bridge.view(s, d, "urls"), bridge.view(s, d, "refs"), 1),
        "SELECT coalesce(owner_element_id, element_id) AS element_id, count(DISTINCT url_id) AS n FROM refs JOIN urls u ON u.id=url_id WHERE u.status='broken' AND refs.site_id=1 GROUP BY 1 ORDER BY n DESC, 1 LIMIT 5",
    ),
    "verdict_fold": (
        lambda s, d: fold.fold(bridge.view(s, d, "check_log")),
        """SELECT url_id, arg_max(now, (checked_at, check_id)) AS status, CAST(arg_max(fails, (checked_at, check_id)) AS BIGINT) AS fail_count, max(checked_at) AS last_checked,
 max(CASE WHEN now IN ('ok','redirect') THEN checked_at END) AS last_ok, max(CASE WHEN now='broken' AND before<>'broken' THEN checked_at END) AS last_broken,
 max(checked_at) + CASE arg_max(now, (checked_at, check_id)) WHEN 'ok' THEN INTERVAL 720 HOUR WHEN 'redirect' THEN INTERVAL 720 HOUR WHEN 'broken' THEN INTERVAL 24 HOUR WHEN 'unreachable' THEN INTERVAL 6 HOUR END AS next_check
 FROM (SELECT *, lag(now, 1, 'pending') OVER (PARTITION BY url_id ORDER BY checked_at, check_id) AS before FROM (SELECT *, CASE WHEN status='unreachable' AND fails >= CASE WHEN reason='dns' THEN 2 ELSE 3 END THEN 'broken' ELSE status END AS now
 FROM (SELECT *, sum(CASE WHEN status='unreachable' THEN 1 ELSE 0 END) OVER (PARTITION BY url_id, g ORDER BY checked_at, check_id) AS fails FROM (SELECT *, sum(CASE WHEN status IN ('ok','redirect') THEN 1 ELSE 0 END) OVER (PARTITION BY url_id ORDER BY checked_at, check_id) AS g FROM check_log WHERE status<>'pending') a) b) c) e GROUP BY url_id""",
    ),
    "normalise_urls": (
        lambda s, d: _url_frame(s, d).select("page_id", U.normalised(F.col("url")).alias("norm")),
        r"""SELECT page_id, concat(lower(regexp_extract(url, '^([a-z]+)://', 1)), '://', lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), ''), '/'),
 CASE WHEN len(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT starts_with(lower(p), 'utm_'))) > 0 THEN concat('?', array_to_string(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT starts_with(lower(p), 'utm_')), '&')) ELSE '' END) AS norm FROM pages""",
    ),
    "url_hash": (lambda s, d: _url_frame(s, d).select("page_id", U.fingerprint(F.col("url")).alias("hash")), "SELECT page_id, sha1(url) AS hash FROM pages"),
    "host_of": (lambda s, d: _url_frame(s, d).select("page_id", U.host_of(F.col("url")).alias("host")), "SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS host FROM pages"),
    "scheme_kind": (
        lambda s, d: _links(s, d).select("page_id", "pos", U.scheme_kind(F.col("href")).alias("kind")),
        r"""SELECT page_id, pos, CASE WHEN raw='' OR starts_with(raw, '#') OR scheme IN ('data', 'javascript', 'mailto', 'sms', 'tel') THEN 'skippable' WHEN scheme IN ('', 'http', 'https') THEN 'checkable' ELSE 'unknown' END AS kind FROM (SELECT page_id, pos, raw, lower(regexp_extract(raw, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme FROM (SELECT page_id, CAST(pos - 1 AS INT) AS pos, trim(href, concat(' ', chr(9), chr(10), chr(13), chr(0), chr(11))) AS raw FROM (SELECT page_id, unnest(hrefs) AS href, generate_subscripts(hrefs, 1) AS pos FROM (SELECT page_id, regexp_extract_all(html, '(?is)<a\b[^>]*?\bhref\s*=\s*"([^"]*)"', 1) AS hrefs FROM pages) a) b) c) t""",
    ),
    "reference_tags": (
        lambda s, d: s.createDataFrame(list(enumerate(_TAGS)), "id int, href string").select("id", *(c.alias(n) for n, c in reftag.parts(F.col("href")).items())),
        "SELECT * FROM (VALUES (0, 'entry', '12', NULL, 'url', NULL), (1, 'asset', '7', '2', 'url', 'https://ex.org/a'), (2, 'category', 'news/x', 'fr', NULL, NULL), (3, 'entry', '5', NULL, 'url', NULL), (4, NULL, NULL, NULL, NULL, NULL), (5, NULL, NULL, NULL, NULL, NULL)) v(id, type, ref, site, attribute, fallback)",
    ),
    "resolve_relative": (
        lambda s, d: _examples(s).select("id", U.normalised(F.col("href"), F.lit(Q)).alias("url")),
        "SELECT * FROM (VALUES "
        + ", ".join(
            f"({i}, {u!r})" if u else f"({i}, NULL)"
            for i, u in enumerate(["http://ex.org/~user/%2Fb/c?b=%2F&a=1", "https://ex.org/up", "https://ex.org/b/c?q=2", "https://ex.org/root//x/", "https://other.org/", None, None, None, None, "https://a_b.org:8443/", "https://e.org/a%20b", "https://ex.org/z", None, "https://e.org/", "https://e.org/"])
        )
        + ") v(id, url)",
    ),
    "extract_links": (
        lambda s, d: links.extracted(s.read.parquet(f"{d}/pages.parquet").select("page_id", "html")),
        r"""SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY tag, k) - 1 AS INT) AS pos, tag, href, text FROM (
 SELECT page_id, 'a' AS tag, generate_subscripts(found, 1) AS k, unnest(regexp_extract_all(html, '(?is)<a\b[^>]*?\bhref\s*=\s*"([^"]*)"', 1)) AS href, regexp_replace(unnest(found), '<[^>]*>', '', 'g') AS text FROM (SELECT page_id, html, regexp_extract_all(html, '(?is)<a\b[^>]*?\bhref\s*=\s*"[^"]*"[^>]*>(.*?)</a>', 1) AS found FROM pages) t
 UNION ALL SELECT page_id, tag, k, regexp_extract(piece, '(?is)\b(?:href|src)\s*=\s*"([^"]*)"', 1), regexp_extract(piece, '(?is)\balt\s*=\s*"([^"]*)"', 1) FROM (SELECT page_id, lower(regexp_extract(unnest(found), '(?i)^<([a-z]+)', 1)) AS tag, unnest(found) AS piece, generate_subscripts(found, 1) AS k FROM (SELECT page_id, regexp_extract_all(html, '(?is)<(?:area\b[^>]*?\bhref|img\b[^>]*?\bsrc)\s*=\s*"[^>]*>', 0) AS found FROM pages) t) u) v""",
    ),
    "resolved_links": (lambda s, d: _links(s, d).select("page_id", "pos", U.normalised(F.col("href"), F.col("url")).alias("link")), _RESOLVED_ALL),
}


def _shared(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: bridge.run(spark, sf_dir, bridge.with_views(sql))


def _all() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]]:
    from . import audit, content, upkeep

    out = {n: (audit.OPERATORS.get(n) or _shared(q), q) for n, q in SHARED.items()} | PAIRED
    for name, (run, sql) in (audit.PAIRED | content.PAIRED | upkeep.PAIRED).items():
        out[name] = (run, sql or out.get(name, (None, ""))[1])
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: f for n, (f, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {n: bridge.with_views(q) for n, (_, q) in _all().items() if q}
