"""From a response, an error or a setting to a verdict: decision tables as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .url import BLANK, host_of, openable, part

# Hosts, markers and limits of the decision tables.
SOCIAL_HOSTS = ("facebook.com", "instagram.com", "linkedin.com", "threads.net", "twitter.com", "x.com")
LOGIN_PATHS = ("/accounts/login", "/checkpoint", "/i/flow/login", "/login", "/signin", "/uas/login")
CLOUDFLARE_BODY = ("__cf_chl", "cf-browser-verification", "cf_chl_opt", "challenge-platform", "just a moment")
CLOUDFLARE_1020 = ("error code: 1020", "error 1020")
PERIMETERX_BODY = ("_pxhd", "px-captcha")
CAPTCHA_BODY = ("captcha", "automated access")
HEAD_REFUSED, HEAD_SUSPECT = (405, 501), (400, 403, 404, 410, 503)
PERMANENT = (301, 308)
SNIPPET_BYTES, LONGEST_WAIT, SHORTEST_DEFERRAL = 2048, 86400, 300


def _any(c: Column, parts: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for p in parts:
        found = found | F.coalesce(c.contains(p), F.lit(False))
    return found


def ok(code: Column) -> Column:
    return code.between(200, 299)


def response_status(code: Column, hops: Column) -> Column:
    return F.when(ok(code), F.when(hops > 0, "redirect").otherwise("ok")).when(code == 429, "pending").when(code >= 500, "unreachable").when(code.isin(401, 407), "blocked").otherwise("broken")


def response_reason(code: Column) -> Column:
    return F.when(ok(code), F.lit(None).cast("string")).when(code == 429, "rate-limited").otherwise("http")


def redirect_info(chain: Column, targets: Column) -> Column:
    """struct(count, final_url, permanent, status) of the hops' codes and addresses: as many hops as addresses (codes may be
    fewer or none), permanent where any code is, the first code; all but the count null without hops."""
    targets = F.coalesce(F.array_compact(targets), F.array().cast("array<string>"))
    chain = F.coalesce(chain, F.array().cast("array<int>"))
    n = F.size(targets)
    return F.struct(
        n.alias("count"),
        F.when(n > 0, F.element_at(targets, -1)).alias("final_url"),
        F.when(n > 0, F.exists(chain, lambda c: c.isin(*PERMANENT))).alias("permanent"),
        F.when(n > 0, F.get(chain, F.lit(0))).alias("status"),
    )


def error_reason(message: Column) -> Column:
    m = F.lower(message)
    return F.when(_any(m, ("ssl", "certificate", "tls")), "ssl").when(_any(m, ("resolve host", "resolve name")), "dns").when(_any(m, ("timed out", "timeout")), "timeout").otherwise("connect")


def nonstandard_status(message: Column) -> Column:
    return F.coalesce(F.lower(message).contains("status code must be"), F.lit(False))


def error_verdict(kind: Column, message: Column) -> Column:
    """struct(status, reason) of a failed request; kind is unsafe-dns, unsafe (both on a redirect), redirects or other."""
    status = F.when(kind == "unsafe-dns", "unreachable").when(kind == "unsafe", "unsafe").when(nonstandard_status(message), "blocked").when(kind == "redirects", "broken").otherwise("unreachable")
    reason = F.when(kind == "unsafe-dns", "dns").when(kind == "unsafe", "private-ip").when(nonstandard_status(message) | (kind == "redirects"), "http").otherwise(error_reason(F.trim(message)))
    return F.struct(status.alias("status"), reason.alias("reason"))


def guard_verdict(refusal: Column) -> Column:
    """struct(status, reason) of a request that was refused before it was made."""
    status = F.when(refusal == "dns", "unreachable").when(refusal.isNotNull(), "unsafe")
    return F.struct(status.alias("status"), F.when(refusal.isin("dns", "private-ip"), refusal).when(refusal.isNotNull(), "unsafe-scheme").alias("reason"))


def safety(url: Column, ips: Column, own: Column, private) -> Column:
    """Why an address must not be requested: malformed, scheme, private-ip or dns; null where it may.  ips are the addresses
    its host resolves to, own exempts a site's own origin, private(ip) is a test of one address."""
    host = F.regexp_replace(host_of(url), r"^\[|\]$", "")
    number = host.rlike("(?i)^([0-9]+|0x[0-9a-f]+)$")
    return (
        F.when((part(url, 1) == "") | (host == ""), "malformed")
        .when(~openable(url), "scheme")
        .when(own, F.lit(None).cast("string"))
        .when(number, "private-ip")
        .when(F.coalesce(F.size(ips), F.lit(0)) <= 0, "dns")
        .when(F.exists(ips, private), "private-ip")
    )


def on_host_list(host: Column, hosts: Column) -> Column:
    """host is one of the list, or below one; blanks and empty entries do not count."""
    tidy = F.filter(F.transform(hosts, lambda h: F.lower(F.btrim(h, F.lit(BLANK)))), lambda h: h != "")
    return (host != "") & F.exists(tidy, lambda h: (F.lower(host) == h) | F.lower(host).endswith(F.concat(F.lit("."), h)))


def host_list(rows: Column) -> Column:
    """Host settings, nested or not yet, as a list: lower case, an address for its host, each once in order."""
    tidy = F.transform(rows, lambda h: F.lower(F.btrim(h, F.lit(BLANK))))
    return F.array_distinct(F.filter(F.transform(tidy, lambda h: F.when(h.contains("://"), host_of(h)).otherwise(h)), lambda h: h != ""))


def body_snippet(body: Column, code: Column, method: Column) -> Column:
    """The first two kilobytes, A-Z in lower case, of what a GET was refused with; null where that is empty.  A letter that the
    limit cuts becomes U+FFFD."""
    head = F.make_valid_utf8(F.substring(F.encode(body, "UTF-8"), 1, SNIPPET_BYTES).cast("string"))
    return F.when((F.lower(method) == "get") & ~ok(code), F.nullif(F.translate(head, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit("")))


def bot_signature(url: Column, code: Column, headers: Column, final_url: Column, body: Column, hostile: Column) -> Column:
    """Which robot wall a response shows, null for none; headers is a map of lower-case names."""
    h = lambda name: F.lower(F.coalesce(F.element_at(headers, name), F.lit("")))
    has = lambda name: F.element_at(headers, name).isNotNull()
    host, path, text = host_of(url), F.lower(part(final_url, 3)), F.lower(F.coalesce(body, F.lit("")))
    wall = on_host_list(host, F.array(*map(F.lit, SOCIAL_HOSTS))) & _any(path, LOGIN_PATHS)
    front = h("x-cache").contains("cloudfront") | h("via").contains("cloudfront") | has("x-amzn-waf-action")
    vendor = (
        F.when(h("cf-mitigated").contains("challenge"), "cloudflare-challenge")
        .when(_any(text, CLOUDFLARE_1020), "cloudflare-1020")
        .when(h("server").contains("cloudflare") & _any(text, CLOUDFLARE_BODY), "cloudflare-challenge")
        .when(has("x-datadome") | h("set-cookie").contains("datadome="), "datadome")
        .when(F.exists(F.map_keys(headers), lambda k: k.startswith("x-px")) | _any(text, PERIMETERX_BODY), "perimeterx")
        .when(has("x-iinfo") | h("set-cookie").contains("visid_incap"), "imperva")
        .when(h("server").contains("akamaighost") & (code == 403), "akamai")
        .when((code == 403) & front, "aws-waf")
        .when((code == 503) & _any(text, CAPTCHA_BODY), "captcha-503")
        .when(on_host_list(host, hostile), "host-list")
    )
    return F.when(code.isNull(), F.lit(None).cast("string")).when(wall, "social-login-wall").when(ok(code), F.lit(None).cast("string")).when(code == 999, "linkedin-999").otherwise(vendor)


def worth_one_get(method: Column, code: Column, signature: Column) -> Column:
    return (F.lower(method) == "head") & (code.isin(*HEAD_REFUSED) | (code.isin(*HEAD_SUSPECT) & signature.isNull()))


def response_verdict(code: Column, hops: Column, signature: Column) -> Column:
    """struct(status, reason): the response's own, blocked where a wall shows and nothing is deferred."""
    status = response_status(code, hops)
    walled = signature.isNotNull() & (status != "pending")
    return F.struct(F.when(walled, "blocked").otherwise(status).alias("status"), F.when(walled, "http").otherwise(response_reason(code)).alias("reason"))


#: Forms of a date: pattern of the text, and its day, month, year, time and offset among the groups.
_DATES = (
    (r"(?i)^(?:[a-z]{3,9},? )?(\d{1,2}) ([a-z]{3}) (\d{4}) (\d{2}:\d{2}:\d{2}) ?(GMT|UTC|Z|[+-]\d{2}:?\d{2})?$", (1, 2, 3, 4, 5)),
    (r"(?i)^[a-z]{6,9}, (\d{2})-([a-z]{3})-(\d{2}) (\d{2}:\d{2}:\d{2}) (GMT|UTC)$", (1, 2, 3, 4, 5)),
    (r"(?i)^[a-z]{3} ([a-z]{3}) {1,2}(\d{1,2}) (\d{2}:\d{2}:\d{2}) (\d{4})()$", (2, 1, 4, 3, 5)),
    (r"(?i)^(\d{4})-(\d{2})-(\d{2})[T ](\d{2}:\d{2}:\d{2})(Z|[+-]\d{2}:?\d{2})?$", (3, 2, 1, 4, 5)),
)


def http_date(text: Column) -> Column:
    """Seconds since 1970 of a date in one of the forms that servers write (RFC 1123, RFC 850, asctime, ISO 8601), in UTC
    unless it has an offset; null for anything else."""
    out = F.lit(None).cast("long")
    for pattern, order in _DATES:
        day, month, year, time, offset = (F.regexp_extract(text, pattern, k) for k in order)
        full = F.when(F.length(year) == 2, F.concat(F.when(year < "70", "20").otherwise("19"), year)).otherwise(year)
        zone = F.when(offset.rlike("^[+-]"), F.regexp_replace(offset, "^(...):?(..)$", "$1:$2")).otherwise("+00:00")
        plain = F.concat_ws(" ", F.lpad(day, 2, "0"), F.initcap(month), full, time, zone)
        parsed = F.try_to_timestamp(plain, F.lit("dd MM yyyy HH:mm:ss xxx" if pattern.startswith(r"(?i)^(\d{4})") else "dd MMM yyyy HH:mm:ss xxx"))
        out = F.coalesce(out, F.when(text.rlike(pattern), F.unix_timestamp(parsed)))
    return out


def retry_after(value: Column, now: Column) -> Column:
    """Seconds a host asks to wait: digits, or a date; at most a day, null for anything else."""
    bare = F.btrim(value, F.lit(" \t\n\r\x00\x0b"))
    digits = F.when(bare.rlike("^[0-9]+$"), F.least(F.lit(LONGEST_WAIT).cast("long"), F.substring(bare, 1, 9).cast("long")))
    wait = http_date(bare) - F.unix_timestamp(now)
    return F.coalesce(digits, F.when(wait.isNotNull(), F.least(F.lit(LONGEST_WAIT).cast("long"), F.greatest(F.lit(0).cast("long"), wait))))


def deferral_seconds(wait: Column) -> Column:
    return F.least(F.lit(LONGEST_WAIT).cast("long"), F.greatest(F.lit(SHORTEST_DEFERRAL).cast("long"), F.coalesce(wait, F.lit(0).cast("long"))))


def retry_delay(attempt: Column) -> Column:
    """Seconds before a retry, without the random part."""
    return F.least(F.lit(30.0), 0.5 * F.pow(F.lit(2.0), attempt - 1))


def retryable(status: Column, reason: Column) -> Column:
    return (status == "unreachable") & F.coalesce(reason.isin("connect", "timeout", "http"), F.lit(False))


def fit_count(gap_ms: Column, budget_seconds: float) -> Column:
    """Requests that fit a budget at a gap; null for any number."""
    return F.when(gap_ms > 0, 1 + F.floor(budget_seconds * 1000 / gap_ms))
