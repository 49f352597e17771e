"""What a scan reads."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: bytes of a page that are read.
PAGE_BYTES = 2 << 20


def scannable(elements_sites: DataFrame, elements: DataFrame, owners: DataFrame, types: list[str], sites: list[int] | None = None, since: str | None = None, ids: list[int] | None = None, sections: tuple[int, ...] = (), groups: tuple[int, ...] = ()) -> DataFrame:
    """(site_id, element_id, uri, type) of content that is on, whole (no drafts, revisions, nested or deleted ones) and not in
    an excluded section or group; since: what changed later."""
    e = elements.where("enabled and not archived and draft_id is null and revision_id is null and date_deleted is null").where(F.col("type").isin(*types))
    e = e.where(F.coalesce(~F.col("section_id").isin(*sections), F.lit(True)) & F.coalesce(~F.col("group_id").isin(*groups), F.lit(True)))
    e = e.join(owners.select(F.col("element_id").alias("id")), "id", "left_anti").select(F.col("id").alias("element_id"), "type", F.col("date_updated").alias("__changed"))
    es = elements_sites.where("enabled")
    if sites is not None:
        es = es.where(F.col("site_id").isin(*sites))
    if ids is not None:
        es = es.where(F.col("element_id").isin(*ids))
    out = es.join(e, "element_id")
    if since is not None:
        at = F.lit(since).cast("timestamp_ntz")
        out = out.where((F.col("__changed") > at) | (F.col("date_updated") > at))
    return out.select("site_id", "element_id", "uri", "type")


def rendered(content: DataFrame, cap: int | None = None) -> DataFrame:
    """Content with a page of its own, the first `cap` by site and element."""
    out = content.where("uri is not null")
    return out if cap is None else out.orderBy("site_id", "element_id").limit(cap)


def beyond_cap(content: DataFrame, cap: int) -> DataFrame:
    """One row (n): pages that the cap leaves out."""
    return rendered(content).agg(F.greatest(F.lit(0).cast("long"), F.count("*") - cap).alias("n"))


def after(content: DataFrame, site_id: int, element_id: int, n: int) -> DataFrame:
    """The next n rows after a cursor, in order of site and element."""
    later = (F.col("site_id") > site_id) | ((F.col("site_id") == site_id) & (F.col("element_id") > element_id))
    return content.where(later).orderBy("site_id", "element_id").limit(n)


def chunks(rows: DataFrame, size: int = 25, stretch: int = 1 << 16) -> DataFrame:
    """(id, chunk): rows numbered by id in chunks of `size`.  Counted inside stretches of the id and over the stretches, so
    that no task sorts all rows."""
    part = rows.select("id", F.floor(F.col("id") / stretch).alias("__s"))
    before = part.groupBy("__s").agg(F.count("*").alias("__n"))
    upto = Window.orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)  # one row a stretch
    before = before.select("__s", F.coalesce(F.sum("__n").over(upto), F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__s").orderBy("id")) - 1
    return part.withColumn("__p", place).join(before, "__s").select("id", F.floor((F.col("__before") + F.col("__p")) / size).alias("chunk"))


def due(urls: DataFrame, as_of: str) -> DataFrame:
    """Addresses to check at as_of."""
    at = F.lit(as_of).cast("timestamp_ntz")
    new = (F.col("status") == "pending") & F.col("next_check_after").isNull()
    return urls.where(~F.col("status").isin("ignored", "unsafe") & F.coalesce(new | (F.col("next_check_after") <= at), F.lit(False)))


def readable_pages(replies: DataFrame) -> DataFrame:
    """Of replies(http_status, content_type, body) those that are HTML, with the first two megabytes of their body."""
    kind = F.lower(F.coalesce("content_type", F.lit("")))
    ok = F.col("http_status").between(200, 299) & ((kind == "") | kind.contains("html"))
    return replies.where(ok).withColumn("body", F.substring(F.encode("body", "UTF-8"), 1, PAGE_BYTES))


def scannable_types(available: list[tuple[str, str]], chosen: list[str] | None = None) -> list[str]:
    """Class names by label, without assets; with a choice, those of it that there are."""
    known = [c for c, _ in sorted(available, key=lambda r: r[1]) if c != "Asset"]
    return known if chosen is None else [c for c in chosen if c in known]


def link_fields(fields: DataFrame, classes: list[str]) -> DataFrame:
    """fields(name, class, ...) that can hold links, by name in any case."""
    return fields.where(F.col("class").isin(*classes)).orderBy(F.lower("name"), "name")


# The ranges of the settings that are whole numbers (no upper limit: None), those that are on or off, texts, lists.
RANGES = {
    "concurrency": (1, 50), "hostConcurrency": (1, 10), "maxConcurrentPerHost": (1, 10), "minHostDelayMs": (0, 60000), "connectTimeout": (1, 120), "timeout": (1, 300), "maxRedirects": (0, 20), "retryCount": (0, 10),
    "brokenAfterDnsFailures": (1, 20), "brokenAfterFailures": (1, 20), "maxPagesToCrawl": (1, 100000), "blockedTtlDays": (0, 3650), "okTtlDays": (0, 3650), "redirectTtlDays": (0, 3650), "retainDays": (0, 3650),
    "brokenRecheckHours": (0, 8760), "unreachableRecheckHours": (0, 8760), "notifyBrokenThreshold": (1, None), "scheduledScanIntervalHours": (1, 8760),
}
SWITCHES = ("checkAnchorFragments", "checkIframes", "checkImages", "checkInternalLinks", "notifyEmailEnabled", "notifyOnNewBroken", "notifySlackEnabled", "pruneOrphanUrls", "renderedCrawlEnabled", "scanNavigationNodes", "scanOnSave", "scanPlainTextUrls", "scanRelationFields", "scheduledScanEnabled", "stripTrackingParams", "verifySsl")
TEXTS = ("notifyEmailRecipients", "notifySlackWebhookUrl", "proxy", "userAgent")
LISTS = ("scannedElementTypes", "excludedCategoryGroupUids", "excludedFieldUids", "excludedSectionUids")
PATTERNS = ("patterns", "excludedUriPatterns", "ignorePatterns", "internalUrlAllowPatterns")


def _whole_number(value) -> int | None:
    if isinstance(value, bool):
        return None
    if isinstance(value, str):
        return int(value) if re.fullmatch(r"\s*[+-]?\d+\s*", value) else None
    return value if isinstance(value, int) else None


def settings_errors(settings: dict, spark=None) -> list[str]:
    """Names of settings that are out of range or of another kind, and patterns that are no regular expression (only those that
    are switched on count).  Numbers may be written as text, switches as 0 and 1; a setting that is not given is right."""
    out = []
    for name, (low, high) in RANGES.items():
        if settings.get(name) is not None:
            n = _whole_number(settings[name])
            if n is None or n < low or (high is not None and n > high):
                out.append(name)
    out += [k for k in SWITCHES if settings.get(k) is not None and settings[k] not in (True, False, 0, 1, "0", "1")]
    out += [k for k in TEXTS if settings.get(k) is not None and not isinstance(settings[k], str)]
    out += [k for k in LISTS if settings.get(k) and not (isinstance(settings[k], list) and all(isinstance(x, str) for x in settings[k]))]
    for name in PATTERNS:
        for row in settings.get(name) or ():
            if row.get("enabled", True):
                try:
                    re.compile(row.get("pattern", ""))
                except re.error:
                    out.append(row["pattern"])
    return out


def list_request(params: dict) -> dict:
    """Page, rows a page, order and filters of a list, from a request's strings; anything odd becomes the default."""
    number = lambda v, d: int(v) if str(v or "").isdecimal() else d
    sorts = ("url", "host", "httpStatus", "refCount", "lastChecked")
    return {
        "page": max(1, number(params.get("page"), 1)),
        "per_page": min(200, max(1, number(params.get("per_page"), 50))),
        "sort": params.get("sort") if params.get("sort") in sorts else "lastChecked",
        "descending": params.get("dir", "desc") != "asc",
        "filters": {k: params[k] for k in ("host", "search", "permanent", "internal", "elementType", "source") if params.get(k) not in (None, "")},
    }
