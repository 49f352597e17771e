"""Rules of the settings: exclusion of pages, ignoring of addresses, routes.  Rule tables are a setting's rows, so they
become expressions; a rule whose pattern is no valid regular expression matches nothing."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.url import HOME


def valid(spark: SparkSession, pattern: str) -> bool:
    """Whether Java takes the pattern; asked of the JVM once a rule, on the driver."""
    try:
        spark._jvm.java.util.regex.Pattern.compile(pattern)
    except Exception:  # noqa: BLE001  whatever the gateway makes of a PatternSyntaxException
        return False
    return True


def _on(row: dict) -> bool:
    return bool(row.get("enabled", True))


def uri_excluded(spark: SparkSession, uri: Column, site_id: Column, rules: list[dict], site_ids: dict[str, int]) -> Column:
    """rules: enabled, siteUid (or, from older settings, siteId), uriPattern.  An empty pattern is the home page."""
    subject = F.when(uri.isNull() | (uri == HOME), "").otherwise(F.regexp_replace(uri, "^/+", ""))
    out = F.lit(False)
    for row in filter(_on, rules):
        uid, old = str(row.get("siteUid") or ""), str(row.get("siteId") or "")
        here = F.lit(True)
        if uid or old:
            here = site_id == F.lit(site_ids.get(uid) if uid else int(old))
        pattern = str(row.get("uriPattern") or "").strip()
        if pattern and not valid(spark, pattern):
            continue
        out = out | F.coalesce(here & (subject.rlike(pattern) if pattern else subject == ""), F.lit(False))
    return out


def container_excluded(section_id: Column, group_id: Column, sections: list[int], groups: list[int]) -> Column:
    return F.coalesce(section_id.isin(*sections), F.lit(False)) | F.coalesce(group_id.isin(*groups), F.lit(False))


def rule_for(spark: SparkSession, url: Column, host: Column, hosts: list[dict], patterns: list[dict]) -> Column:
    """The text of the first enabled host rule (the host or one below it), else of the first enabled pattern (anywhere in the
    address, in either case); null where none matches."""
    out = []
    for row in filter(_on, hosts):
        text = str(row.get("host") or "").strip()
        if text:
            out.append(F.when((host != "") & ((F.lower(host) == text.lower()) | F.lower(host).endswith("." + text.lower())), text))
    for row in filter(_on, patterns):
        text = str(row.get("pattern") or "").strip()
        if text and valid(spark, text):
            out.append(F.when(url.rlike("(?i)" + text), text))
    return F.coalesce(*out, F.lit(None).cast("string"))


def ignore_verdict(urls: DataFrame, ignores: DataFrame, hosts: list[dict], patterns: list[dict]) -> DataFrame:
    """(id, reason, rule): ignored by a person (its hash), by a rule, or not at all (null)."""
    by_hash = ignores.where("scope = 'url'").select("url_hash").distinct().withColumn("hit", F.lit(True))
    found = urls.join(by_hash, "url_hash", "left").withColumn("rule", rule_for(urls.sparkSession, F.col("url"), F.col("host"), hosts, patterns))
    hit = F.coalesce("hit", F.lit(False))
    reason = F.when(hit, "ignored").when(F.col("rule").isNotNull(), "ignore-rule")
    return found.select("id", reason.alias("reason"), F.when(~hit, F.col("rule")).alias("rule"))


def allowed(spark: SparkSession, uri: Column, patterns: list[str]) -> Column:
    """Whether a setting says that an address inside the site is served by something else."""
    out = F.lit(False)
    for p in (p.strip() for p in patterns):
        if p and valid(spark, p):
            out = out | uri.rlike(p)
    return out


def route_pattern(route: str, tokens: dict[str, str] | None = None) -> str | None:
    """A route such as blog/<slug:[a-z]+> as an anchored regular expression; null for an empty one."""
    route = route.strip("/")
    if not route:
        return None
    for name, text in (tokens or {}).items():
        route = route.replace(name, text)
    out, at = "", 0
    for m in re.finditer(r"<[\w.-]+(?::([^>]+))?>", route):
        out += re.escape(route[at : m.start()]) + f"(?:{m[1] or '[^/]+'})"
        at = m.end()
    return f"^{out}{re.escape(route[at:])}$"


def route_matches(spark: SparkSession, uri: Column, site_id: Column, routes: list[tuple[str, int | None]]) -> Column:
    """routes: (pattern, site or None for all)."""
    subject, out = F.when(uri == HOME, "").otherwise(uri), F.lit(False)
    for route, site in routes:
        pattern = route_pattern(route)
        if pattern and valid(spark, pattern):
            out = out | (subject.rlike(pattern) & (F.lit(True) if site is None else site_id == site))
    return out
