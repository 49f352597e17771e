"""Registered queries over structured content; the statements find links, nested entries and anchors by patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import links, net, reftag
from ..functions import url as U
from ..operators import content
from ..sources import bridge

#: The field that the registered queries leave out.
HOW = content.Reading(excluded=("u7",))


def _walked(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every element on every site is a root."""
    elements = bridge.view(s, d, "content_elements")
    reached, found = content.walked(elements.select(F.col("id").alias("element_id"), "site_id"), bridge.view(s, d, "field_values"), elements, HOW)
    return reached, found, elements


def _walk(s, d):
    return _walked(s, d)[0]


def _links(s, d):
    reached, found, elements = _walked(s, d)
    return content.links(reached, found, elements, bridge.view(s, d, "sites")).select("root", "site_id", "element_id", "field_handle", "n", "kind", "url", "raw_href", "target_id", "link_text")


def _problems(s, d):
    reached, found, _ = _walked(s, d)
    return content.problems(reached, found).drop("pos")


def _values(s, d):
    rows = bridge.view(s, d, "field_values").where("kind <> 'html'")
    return content.typed(rows).select("element_id", "site_id", "field_handle", "n", "what", "href", "target_id", "text", "problem")


def _bodies_of(s, d):
    return bridge.view(s, d, "field_values").where("kind = 'html'").select("element_id", "site_id", "value")


def _tags(s, d):
    hrefs = links.bodies(_bodies_of(s, d)).select("element_id", "site_id", F.posexplode("links").alias("pos", "link"))
    tag = reftag.parts(F.col("link.href"))
    return hrefs.select("element_id", "site_id", "pos", *(v.alias(k) for k, v in tag.items())).where("type is not null")


def _anchors(s, d):
    pages = _bodies_of(s, d).select((F.col("element_id") * 10 + F.col("site_id")).alias("page_id"), F.col("value").alias("html"))
    return links.anchors(pages).select("page_id", F.posexplode("anchors").alias("pos", "anchor"))


_BARE = "regexp_replace(value, '(?s)<!--.*?-->', '', 'g')"
#: Things that values hold, by kind: one row each, n its place among them.
_ITEMS = rf"""f AS (SELECT * FROM field_values WHERE value IS NOT NULL AND value <> ''),
 b AS (SELECT element_id, site_id, field_handle, pos, regexp_extract_all(regexp_replace({_BARE}, '(?is)<craft-entry[^>]*>.*?</craft-entry>', '', 'g'), '(?is)<a\s[^>]*>.*?</a>') AS found FROM f WHERE kind='html'),
 h AS (SELECT element_id, site_id, field_handle, pos, generate_subscripts(found, 1) - 1 AS n, 'link' AS what, replace(regexp_extract(unnest(found), '(?i)href="([^"]*)"', 1), '&amp;', '&') AS href, NULL::BIGINT AS target_id, replace(regexp_replace(unnest(found), '<[^>]*>', '', 'g'), '&amp;', '&') AS text FROM b),
 j AS (SELECT *, CASE WHEN json_valid(value) THEN CAST(value AS JSON) END AS v FROM f WHERE kind IN ('link','links','relation','nested','table')),
 o AS (SELECT element_id, site_id, field_handle, pos, json_extract_string(v, '$.type') AS type, json_extract_string(v, '$.value') AS value, json_extract_string(v, '$.label') AS label FROM j WHERE kind='link'),
 l AS (SELECT element_id, site_id, field_handle, pos, 0 AS n, CASE WHEN type IN ('entry','asset') THEN 'element' ELSE 'link' END AS what, value AS href, CASE WHEN type IN ('entry','asset') THEN TRY_CAST(regexp_extract(value, '^\{{[a-z]\w*:([0-9]+)(?:@[0-9]+)?:url\}}$', 1) AS BIGINT) END AS target_id, label AS text FROM o WHERE type IS NOT NULL),
 e AS (SELECT element_id, site_id, field_handle, pos, kind, i - 1 AS i, x FROM (SELECT element_id, site_id, field_handle, pos, kind, unnest(CAST(v AS JSON[])) AS x, generate_subscripts(CAST(v AS JSON[]), 1) AS i FROM j WHERE kind IN ('links','relation','nested') AND json_type(v)='ARRAY') t),
 c AS (SELECT *, lower(regexp_extract(json_extract_string(x, '$.type'), '([a-zA-Z]*)$', 1)) AS type, json_extract_string(x, CASE WHEN json_type(x, '$.linkValue')='ARRAY' THEN '$.linkValue[0]' ELSE '$.linkValue' END) AS lv FROM e WHERE kind='links' AND json_type(x)='OBJECT'),
 k AS (SELECT element_id, site_id, field_handle, pos, row_number() OVER (PARTITION BY element_id, site_id, pos ORDER BY i) - 1 AS n, CASE WHEN type='url' THEN 'link' ELSE 'element' END AS what, CASE WHEN type='url' THEN lv ELSE 'element:'||lv END AS href, CASE WHEN type<>'url' THEN TRY_CAST(lv AS BIGINT) END AS target_id, json_extract_string(x, '$.linkText') AS text FROM c WHERE type<>'' AND lv IS NOT NULL AND (type='url' OR TRY_CAST(lv AS BIGINT) IS NOT NULL)),
 r AS (SELECT element_id, site_id, field_handle, pos, row_number() OVER (PARTITION BY element_id, site_id, pos ORDER BY i) - 1 AS n, kind AS what, CASE WHEN kind='relation' THEN 'element:'||CAST(CAST(x AS BIGINT) AS VARCHAR) END AS href, CAST(x AS BIGINT) AS target_id, NULL AS text FROM e WHERE kind IN ('relation','nested') AND json_type(x) IN ('UBIGINT','BIGINT')),
 p AS (SELECT element_id, site_id, field_handle, pos, 0 AS n, 'link' AS what, trim(value) AS href, NULL AS target_id, NULL AS text FROM f WHERE kind='text' AND regexp_matches(trim(value), '(?i)^https?://\S+$')),
 q AS (SELECT element_id, site_id, field_handle, pos, row_number() OVER (PARTITION BY element_id, site_id, pos ORDER BY place) - 1 AS n, 'link' AS what, cell AS href, NULL AS target_id, NULL AS text FROM (SELECT element_id, site_id, field_handle, pos, json_extract_string(j.v, g.path) AS cell, g.place FROM j, (VALUES (1, '$[0][0]'), (2, '$[0][1]'), (3, '$[0][2]'), (4, '$[1].c')) g(place, path) WHERE kind='table') t WHERE regexp_matches(cell, '(?i)^https?://\S+$')),
 items AS (SELECT * FROM h UNION ALL SELECT * FROM l WHERE what='link' OR target_id IS NOT NULL UNION ALL SELECT * FROM k UNION ALL SELECT * FROM r UNION ALL SELECT * FROM p UNION ALL SELECT * FROM q),
 bad AS (SELECT element_id, site_id, field_handle, pos, CASE WHEN v IS NULL THEN 'not JSON' WHEN kind<>'link' THEN 'not a list' ELSE 'no type' END AS problem FROM j WHERE v IS NULL OR (kind<>'link' AND json_type(v)<>'ARRAY') OR (kind='link' AND json_extract_string(v, '$.type') IS NULL))"""
_WALK = rf"""edges AS (SELECT element_id AS src, site_id, CAST(unnest(regexp_extract_all({_BARE}, '(?i)<craft-entry[^>]*data-entry-id="?([0-9]+)', 1)) AS BIGINT) AS dst FROM field_values WHERE kind='html'
  UNION SELECT element_id, site_id, TRY_CAST(unnest(json_extract_string(CASE WHEN json_valid(value) THEN value ELSE '[]' END, '$[*]')) AS BIGINT) FROM field_values WHERE kind='nested'),
 alive AS (SELECT id, site_id FROM content_elements WHERE enabled AND coalesce(enabled_for_site, true)),
 steps AS (SELECT edges.* FROM edges JOIN alive ON alive.id=dst AND alive.site_id=edges.site_id),
 w(root, site_id, element_id, depth) AS (SELECT id, site_id, id, 0 FROM content_elements UNION SELECT w.root, w.site_id, dst, w.depth + 1 FROM w JOIN steps ON src=w.element_id AND steps.site_id=w.site_id WHERE w.depth < 10),
 reached AS (SELECT root, site_id, element_id, CAST(min(depth) AS INT) AS depth FROM w GROUP BY root, site_id, element_id)"""

_LINKS_SQL = rf"""WITH RECURSIVE {_WALK}, {_ITEMS},
 x AS (SELECT w.root, i.*, s.base_url, regexp_extract(href, '@([^:]+):', 1) AS named, starts_with(href, '{{') AND what='link' AS tag FROM reached w JOIN items i ON i.element_id=w.element_id AND i.site_id=w.site_id JOIN sites s ON s.site_id=w.site_id WHERE what<>'nested' AND field_handle<>'hidden'),
 y AS (SELECT x.* REPLACE (CASE WHEN tag THEN CAST(regexp_extract(href, ':([0-9]+)', 1) AS BIGINT) ELSE target_id END AS target_id, CASE WHEN tag AND named<>'' THEN coalesce(TRY_CAST(named AS BIGINT), (SELECT n.site_id FROM sites n WHERE n.handle=lower(named)), x.site_id) ELSE x.site_id END AS site_id), CASE WHEN tag THEN 'element' WHEN what<>'link' THEN what WHEN starts_with(href, '/') THEN 'internal' WHEN starts_with(href, 'http') THEN 'external' WHEN starts_with(href, 'ftp:') THEN 'ignored' END AS kind FROM x)
 SELECT y.root, y.site_id, y.element_id, y.field_handle, CAST(y.n AS INT) AS n, kind, CASE kind WHEN 'internal' THEN rtrim(base_url, '/')||href WHEN 'external' THEN regexp_replace(replace(lower(href), ':443/', '/'), 'utm_source=[^&]*&', '') WHEN 'ignored' THEN regexp_replace(href, '//[^@/]*@', '//') ELSE coalesce(t.url, kind||':'||CAST(y.target_id AS VARCHAR)) END AS url,
  CASE WHEN kind='ignored' THEN regexp_replace(href, '//[^@/]*@', '//') ELSE href END AS raw_href, y.target_id, nullif(trim(regexp_replace(CASE WHEN kind='relation' THEN t.title ELSE y.text END, '\s+', ' ', 'g')), '') AS link_text
 FROM y LEFT JOIN content_elements t ON t.id=y.target_id AND t.site_id=y.site_id AND kind IN ('element','relation') WHERE kind IS NOT NULL AND (kind<>'relation' OR t.id IS NOT NULL)"""

#: Punycode after RFC 3492, label by label: each letter beyond ASCII, in order of code point and place, is a number of steps
#: of the decoder (delta), written in digits whose thresholds follow the bias.
_PUNYCODE = r"""WITH RECURSIVE u AS (SELECT id, nfc_normalize(lower(regexp_extract(url, '://([^/]*)', 1))) AS host FROM idn_addresses),
 l AS (SELECT id, generate_subscripts(string_split(host, '.'), 1) AS lab, unnest(string_split(host, '.')) AS label FROM u),
 c AS (SELECT id, lab, generate_subscripts(string_split(label, ''), 1) AS pos, unnest(string_split(label, '')) AS ch FROM l),
 k AS (SELECT *, unicode(ch)::BIGINT AS cp, unicode(ch) < 128 AS basic FROM c),
 b AS (SELECT id, lab, count(*) FILTER (basic) AS b, coalesce(string_agg(ch, '' ORDER BY pos) FILTER (basic), '') AS plain, count(*) FILTER (NOT basic) AS ext FROM k GROUP BY id, lab),
 e AS (SELECT x.id, x.lab, x.cp, x.pos, b.b, row_number() OVER (PARTITION BY x.id, x.lab ORDER BY x.cp, x.pos) AS k, (SELECT count(*) FROM k y WHERE y.id=x.id AND y.lab=x.lab AND y.pos<x.pos AND (y.basic OR y.cp<=x.cp)) AS i FROM k x JOIN b ON b.id=x.id AND b.lab=x.lab WHERE NOT x.basic),
 d AS (SELECT *, b + k AS points, (cp - coalesce(lag(cp) OVER w, 128)) * (b + k) + i - coalesce(lag(i) OVER w + 1, 0) AS delta FROM e WINDOW w AS (PARTITION BY id, lab ORDER BY k)),
 a AS (SELECT *, CASE WHEN k=1 THEN delta // 700 ELSE delta // 2 END AS half FROM d), s AS (SELECT *, half + half // points AS s0 FROM a),
 f AS (SELECT *, CASE WHEN s0<=455 THEN 36*s0 // (s0+38) WHEN s0//35<=455 THEN 36 + 36*(s0//35) // (s0//35+38) ELSE 72 + 36*(s0//1225) // (s0//1225+38) END AS after FROM s),
 g AS (SELECT id, lab, k, delta, coalesce(lag(after) OVER (PARTITION BY id, lab ORDER BY k), 72) AS bias FROM f),
 r(id, lab, k, q, kk, bias, digits, done) AS (SELECT id, lab, k, delta, 36::BIGINT, bias::BIGINT, '', false FROM g
  UNION ALL SELECT id, lab, k, CASE WHEN q<t THEN 0 ELSE (q-t) // (36-t) END, kk+36, bias, digits||substr('abcdefghijklmnopqrstuvwxyz0123456789', CAST(CASE WHEN q<t THEN q ELSE t + (q-t) % (36-t) END AS INT) + 1, 1), q<t FROM (SELECT *, greatest(1, least(26, kk-bias)) AS t FROM r WHERE NOT done) z),
 p AS (SELECT id, lab, string_agg(digits, '' ORDER BY k) AS tail FROM r WHERE done GROUP BY id, lab),
 o AS (SELECT b.id, b.lab, CASE WHEN ext=0 THEN plain ELSE 'xn--'||CASE WHEN plain<>'' THEN plain||'-' ELSE '' END||tail END AS label FROM b LEFT JOIN p ON p.id=b.id AND p.lab=b.lab)
 SELECT id, 'http://'||string_agg(label, '.' ORDER BY lab)||'/x' AS url FROM o GROUP BY id"""

_IPV4 = r"'^(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(\.(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}$'"
#: 128 bits as 32 hexadecimal digits, compared with networks by their first ones.
_IPS_SQL = rf"""WITH t AS (SELECT id, ip, lower(trim(ip, '[]')) AS s FROM ip_texts),
 v AS (SELECT *, regexp_extract(s, '([0-9.]+)$', 1) AS tail FROM t),
 w AS (SELECT *, CASE WHEN contains(s, ':') AND contains(tail, '.') THEN regexp_replace(s, '[0-9.]+$', '')||format('{{:x}}:{{:x}}', CAST(split_part(tail, '.', 1) AS INT)*256+CAST(split_part(tail, '.', 2) AS INT), CAST(split_part(tail, '.', 3) AS INT)*256+CAST(split_part(tail, '.', 4) AS INT)) ELSE s END AS x FROM v),
 y AS (SELECT *, len(string_split(x, '::')) AS parts, list_filter(string_split(split_part(x, '::', 1), ':'), lambda g: g<>'') AS a, list_filter(string_split(split_part(x, '::', 2), ':'), lambda g: g<>'') AS b FROM w),
 z AS (SELECT *, CASE WHEN contains(x, ':') THEN CASE WHEN (parts=2 AND len(a)+len(b)<8) OR (parts=1 AND len(a)=8) THEN array_to_string(list_transform(a, lambda g: lpad(g, 4, '0')), '')||repeat('0', CAST(32-4*(len(a)+len(b)) AS INT))||array_to_string(list_transform(b, lambda g: lpad(g, 4, '0')), '') END END AS h FROM y),
 i AS (SELECT *, CASE WHEN h IS NULL AND regexp_matches(s, {_IPV4}) THEN format('{{:02x}}{{:02x}}{{:02x}}{{:02x}}', CAST(split_part(s, '.', 1) AS INT), CAST(split_part(s, '.', 2) AS INT), CAST(split_part(s, '.', 3) AS INT), CAST(split_part(s, '.', 4) AS INT)) WHEN starts_with(h, '00000000000000000000ffff') OR starts_with(h, '0064ff9b0000000000000000') THEN h[25:32] WHEN starts_with(h, '2002') THEN h[5:12] END AS four FROM z)
 SELECT id, ip, CASE WHEN four IS NOT NULL THEN regexp_matches(four, '^(00|0a|7f|a9fe|ac1|c0a8|c00000|c00002|c05863|c612|c613|c63364|cb0071|[ef]|64[4-7])') WHEN h IS NULL THEN true
  ELSE (regexp_matches(h, '^(0{{31}}[01]|0064ff9b0001|0100000000000000|200100|2001010|2001011|20010[1]|20010db8|3fff0|f[cdf]|fe[89ab])') OR starts_with(h, '2001010') OR (starts_with(h, '2001') AND h[5:8] < '0200')) AND NOT regexp_matches(h, '^(20010001000000000000000000000[0]{{2}}[12]|20010003|200100040112|2001002|2001003)') END AS private FROM i"""

PAIRED = {
    "international_hosts": (lambda s, d: bridge.view(s, d, "idn_addresses").select("id", U.normalised(F.col("url")).alias("url")), _PUNYCODE),
    "private_ips": (lambda s, d: bridge.view(s, d, "ip_texts").select("id", "ip", net.private(F.col("ip")).alias("private")), _IPS_SQL),
    "content_walk": (_walk, f"WITH RECURSIVE {_WALK} SELECT root, site_id, element_id, depth FROM reached"),
    "content_links": (_links, _LINKS_SQL),
    "content_problems": (_problems, f"WITH RECURSIVE {_WALK}, {_ITEMS} SELECT bad.element_id, bad.site_id, field_handle, problem, count(DISTINCT root) AS roots FROM bad JOIN reached w ON w.element_id=bad.element_id AND w.site_id=bad.site_id GROUP BY ALL"),
    "typed_values": (_values, f"WITH {_ITEMS} SELECT element_id, site_id, field_handle, CAST(n AS INT) AS n, what, href, target_id, text, NULL AS problem FROM items WHERE field_handle<>'body' UNION ALL SELECT element_id, site_id, field_handle, NULL, NULL, NULL, NULL, NULL, problem FROM bad"),
    "nested_entries": (lambda s, d: links.bodies(_bodies_of(s, d), links=False).select("element_id", "site_id", F.posexplode("entries").alias("pos", "entry_id")), f"SELECT element_id, site_id, CAST(generate_subscripts(ids, 1) - 1 AS INT) AS pos, CAST(unnest(ids) AS BIGINT) AS entry_id FROM (SELECT element_id, site_id, regexp_extract_all({_BARE}, '(?i)<craft-entry[^>]*data-entry-id=\"?([0-9]+)', 1) AS ids FROM field_values WHERE kind='html') t"),
    "reference_tag_parts": (_tags, rf"""SELECT element_id, site_id, CAST(k - 1 AS INT) AS pos, split_part(ltrim(href, '{{'), ':', 1) AS type, split_part(split_part(split_part(href, '||', 1), ':', 2), '@', 1) AS ref, nullif(split_part(split_part(href, ':', 2), '@', 2), '') AS site, split_part(split_part(href, '||', 1), ':', 3) AS attribute, rtrim(split_part(href, '||', 2), '}}') AS fallback
 FROM (SELECT element_id, site_id, generate_subscripts(hrefs, 1) AS k, unnest(hrefs) AS href FROM (SELECT element_id, site_id, regexp_extract_all(regexp_replace({_BARE}, '(?is)<craft-entry[^>]*>.*?</craft-entry>', '', 'g'), '(?i)<a\s[^>]*href="([^"]*)"', 1) AS hrefs FROM field_values WHERE kind='html') t) u WHERE starts_with(href, '{{')"""),
    "body_anchors": (_anchors, rf"""SELECT page_id, CAST(generate_subscripts(names, 1) - 1 AS INT) AS pos, unnest(names) AS anchor FROM (SELECT element_id*10+site_id AS page_id, regexp_extract_all({_BARE}, '(?i)<[a-z][^>]*?\sid="([^"]*)"', 1) AS names FROM field_values WHERE kind='html') t"""),
}
