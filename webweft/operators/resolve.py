"""Verdicts on a site's own links, without a request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import url as U
from . import rules


def live(elements_sites: DataFrame, elements: DataFrame, as_of: str) -> DataFrame:
    """(site_id, uri, element_id) of elements that visitors can see at as_of."""
    at = F.lit(as_of).cast("timestamp_ntz")
    now = F.col("section_id").isNull() | ((F.col("post_date") <= at) & (F.col("expiry_date").isNull() | (F.col("expiry_date") > at)))
    e = elements.where("enabled and not archived and draft_id is null and revision_id is null and date_deleted is null").where(now).select(F.col("id").alias("element_id"))
    return elements_sites.where("uri is not null and enabled").join(e, "element_id", "left_semi").select("site_id", "uri", "element_id")


def site_for(addresses: DataFrame, bases: DataFrame, fallback: int) -> DataFrame:
    """addresses(url, ...) with site_id: the site of the same host whose base path is the longest prefix, the lowest id on a
    tie, else the fallback.  bases(site_id, base_url) is a table of sites."""
    b = bases.select("site_id", U.host_of(F.col("base_url")).alias("__host"), F.regexp_replace(U.part(F.col("base_url"), 3), "/+$", "").alias("__base"))
    # Sites of a host go into one short list, so that an address meets its host's row once and no address is repeated.
    by_host = b.groupBy("__host").agg(F.array_sort(F.collect_list(F.struct((-F.length("__base")).alias("n"), "site_id", F.col("__base").alias("base")))).alias("__sites"))
    path = U.part(F.col("url"), 3)
    fits = F.filter("__sites", lambda s: (s["base"] == "") | (path == s["base"]) | path.startswith(F.concat(s["base"], F.lit("/"))))
    out = addresses.withColumn("__h", U.host_of(F.col("url"))).join(by_host, F.col("__h") == F.col("__host"), "left")
    return out.withColumn("site_id", F.coalesce(F.get(fits, F.lit(0))["site_id"], F.lit(fallback).cast("long"))).drop("__h", "__host", "__sites")


def internal(addresses: DataFrame, bases: DataFrame) -> DataFrame:
    """addresses(url, ...) with is_internal: host and port are those of some site's base."""
    own = bases.select(U.authority_of(F.col("base_url")).alias("__own")).where("__own is not null").distinct().withColumn("__hit", F.lit(True))
    out = addresses.withColumn("__a", U.authority_of(F.col("url"))).join(own, F.col("__a") == F.col("__own"), "left")
    return out.withColumn("is_internal", F.coalesce("__hit", F.lit(False))).drop("__a", "__own", "__hit")


def fragment_verdict(fragment: Column, anchors: Column) -> Column:
    """ok or broken; anchors null: the page could not be read, and the fragment is believed."""
    name = U.percent_decoded(fragment)
    there = fragment.isNull() | anchors.isNull() | (name == "top") | F.array_contains(anchors, name) | F.array_contains(anchors, fragment)
    return F.when(there, "ok").otherwise("broken")


def urls(addresses: DataFrame, sites: DataFrame, alive: DataFrame, routes: list, allow: list[str], checking: bool = True, anchors: DataFrame | None = None) -> DataFrame:
    """addresses(id, url, site_id) with status and reason; null where only a request can answer.  anchors(page_url, anchors)
    turns the checking of fragments on."""
    spark = addresses.sparkSession
    if not checking:
        return addresses.withColumn("status", F.lit("ignored")).withColumn("reason", F.lit("setting"))
    out = addresses.join(sites.select("site_id", "base_url"), "site_id", "left").withColumn("uri", U.uri_for(F.col("url"), F.col("base_url")))
    known = alive.select("site_id", "uri").distinct().withColumn("__live", F.lit(True))
    out = out.join(known, ["site_id", "uri"], "left")
    there = F.coalesce("__live", F.lit(False)) | rules.route_matches(spark, F.col("uri"), F.col("site_id"), routes)
    fragment = F.lit("ok")
    if anchors is not None:
        out = out.withColumn("__page", U.without_fragment(F.col("url"))).join(anchors.select(F.col("page_url").alias("__page"), "anchors"), "__page", "left")
        fragment = fragment_verdict(U.fragment_of(F.col("url")), F.col("anchors"))
    lost = F.col("base_url").isNull()
    allowed = rules.allowed(spark, F.col("uri"), allow)
    status = F.when(lost, "broken").when(there, fragment).when(allowed, "ignored")
    reason = F.when(lost, "no-element").when(there, F.when(fragment == "broken", "fragment")).when(allowed, "setting")
    return out.select(*addresses.columns, status.alias("status"), reason.alias("reason"))


def elements(links: DataFrame, elements_: DataFrame, elements_sites: DataFrame, as_of: str, sections: list[int], groups: list[int], checking: bool = True) -> DataFrame:
    """links(id, target_id, site_id, is_relation) with status and reason; null where the target's address must be asked."""
    if not checking:
        return links.withColumn("status", F.lit("ignored")).withColumn("reason", F.lit("setting"))
    at = F.lit(as_of).cast("timestamp_ntz")
    e = elements_.where("date_deleted is null").select(F.col("id").alias("target_id"), F.lit(True).alias("__there"), F.col("enabled").alias("__on"), "section_id", "group_id", "post_date", "expiry_date", "type")
    es = elements_sites.select(F.col("element_id").alias("target_id"), "site_id", F.col("enabled").alias("__here"), "uri")
    out = links.join(e, "target_id", "left").join(es, ["target_id", "site_id"], "left")
    missing = F.coalesce(F.col("target_id") <= 0, F.lit(True)) | F.col("__there").isNull()
    excluded = rules.container_excluded(F.col("section_id"), F.col("group_id"), sections, groups)
    waiting = F.coalesce((F.col("type") == "Entry") & ((F.col("post_date") > at) | (F.col("expiry_date") <= at)), F.lit(False))
    off = waiting | ~F.col("__on") | ~F.coalesce("__here", F.lit(True))
    addressed = ~F.col("is_relation") & F.col("uri").isNotNull()
    bare = ~F.col("is_relation") & F.col("uri").isNull()
    status = F.when(missing, "broken").when(excluded, "ignored").when(off & addressed, F.lit(None).cast("string")).when(off | bare, "broken").otherwise("ok")
    reason = F.when(missing, "no-element").when(excluded, "ignore-rule").when(off & addressed, F.lit(None).cast("string")).when(off | bare, "no-element")
    return out.select(*links.columns, status.alias("status"), reason.alias("reason"))


def dispatch(links: DataFrame) -> DataFrame:
    """links(kind, url, ...) with way: url and element go to the tables, ignored is settled, http must be asked (an external
    address, or an internal one with a fragment that only its page can answer)."""
    kind = F.col("kind")
    way = F.when(kind == "ignored", "ignored").when(kind.isin("element", "relation"), "element").when((kind == "internal") & U.fragment_of(F.col("url")).isNull(), "url").otherwise("http")
    return links.withColumn("way", way)


def newest(rows: DataFrame, key: str, order: str) -> DataFrame:
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("__n = 1").drop("__n")
