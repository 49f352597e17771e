"""Scans: when one may start, what it counts, what it prunes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RUNNING, WHOLE = ("queued", "extracting", "checking"), ("full", "incremental")
# Minutes after which a silent run counts as dead, and for which a new address may lack references.
STALE_MINUTES, ORPHAN_MINUTES = 60, 60


def _at(as_of: str):
    return F.lit(as_of).cast("timestamp_ntz")


def active(scans: DataFrame, as_of: str) -> DataFrame:
    """The running scan, if one is alive."""
    return scans.where(F.col("status").isin(*RUNNING) & (F.col("date_updated") > _at(as_of) - F.expr(f"INTERVAL {STALE_MINUTES} MINUTE"))).orderBy(F.desc("id")).limit(1)


def may_start(scans: DataFrame, mode: str, as_of: str) -> DataFrame:
    """One row (allowed): only one whole scan at a time."""
    busy = active(scans.where(F.col("mode").isin(*WHOLE)), as_of).agg(F.count("*").alias("n"))
    return busy.select((F.lit(mode not in WHOLE) | (F.col("n") == 0)).alias("allowed"))


def last_start(scans: DataFrame) -> DataFrame:
    """date_started of the last whole scan, or when it was made where it has not started."""
    return scans.where(F.col("mode").isin(*WHOLE)).orderBy(F.desc("id")).limit(1).select(F.coalesce("date_started", "date_created").alias("date_started"))


def due(scans: DataFrame, as_of: str, enabled: bool = True, hours: int = 24) -> DataFrame:
    """One row (due): scheduled scans are on, none is running, and the last began longer ago than the interval."""
    running = active(scans, as_of).agg(F.count("*").alias("running"))
    last = last_start(scans).agg(F.max("date_started").alias("last"))
    late = F.col("last").isNull() | (F.col("last") <= _at(as_of) - F.expr(f"INTERVAL {max(1, hours)} HOUR"))
    return running.crossJoin(last).select((F.lit(enabled) & (F.col("running") == 0) & late).alias("due"))  # one row by one row


def counted(scans: DataFrame, deltas: DataFrame, counters: tuple[str, ...] = ("urls_checked", "urls_broken", "elements_scanned", "pages_crawled")) -> DataFrame:
    """scans with the sums of deltas(scan_id, counter, n) added."""
    sums = deltas.where("n <> 0").groupBy(F.col("scan_id").alias("id")).agg(*[F.sum(F.when(F.col("counter") == c, F.col("n"))).alias(f"__{c}") for c in counters])
    out = scans.join(sums, "id", "left")
    return out.select(*[c for c in scans.columns if c not in counters], *[(F.coalesce(c if c in scans.columns else F.lit(0), F.lit(0)) + F.coalesce(f"__{c}", F.lit(0))).cast("long").alias(c) for c in counters])


def stale_refs(refs: DataFrame, scan_id: int, started: str | None, site: int | None = None) -> DataFrame:
    """refs without those that a full scan did not meet again (rendered ones are replaced, not pruned)."""
    gone = (F.col("scan_id").isNull() | (F.col("scan_id") < scan_id)) & (F.col("source") != "rendered")
    if started is not None:
        gone &= F.col("date_created") < _at(started)
    if site is not None:
        gone &= F.col("site_id") == site
    return refs.where(~F.coalesce(gone, F.lit(False)))


def orphans(urls: DataFrame, refs: DataFrame, as_of: str) -> DataFrame:
    """Addresses that nothing refers to, but for very new ones."""
    old = urls.where(F.col("date_first_seen") < _at(as_of) - F.expr(f"INTERVAL {ORPHAN_MINUTES} MINUTE"))
    return old.join(refs.select(F.col("url_id").alias("id")), "id", "left_anti")


def finalised(scan: dict, urls: DataFrame, refs: DataFrame, as_of: str, crawling: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(urls, refs, totals) after a scan ends.  A full scan prunes references; any but a single one prunes orphans."""
    if scan["mode"] == "full":
        refs = stale_refs(refs, scan["id"], scan["date_started"], scan.get("site_id"))
        if not crawling:
            refs = refs.where("source <> 'rendered'")
    if scan["mode"] != "single":
        urls = urls.join(orphans(urls, refs, as_of).select("id"), "id", "left_anti")
    held = refs if scan.get("site_id") is None else refs.where(F.col("site_id") == scan["site_id"])
    total = refs.where(F.col("scan_id") == scan["id"]).agg(F.count_distinct("url_id").alias("urls_total"))
    broken = urls.where("status = 'broken'").join(held.select(F.col("url_id").alias("id")), "id", "left_semi").agg(F.count("*").alias("urls_broken"))
    return urls, refs, total.crossJoin(broken).select(F.lit(scan["id"]).cast("long").alias("id"), F.lit("complete").alias("status"), "urls_total", "urls_broken")  # one row by one row


def transitions(events: DataFrame) -> DataFrame:
    """events(scan_id, happened, seq, event) in order, each with the scan's status after it and whether it was refused.

    event is queued, extracting or checking (a phase begins), complete (a scan is finalised), failed or cancelled.  A scan that
    runs may fail or be cancelled; one that does not, or is not known, refuses that and stays as it is.  Phases and the end
    are taken as they come.  Each event leaves a scan either running or not, whatever it was before, so the guard sees the
    event before and no fold over a scan's history is needed."""
    by = Window.partitionBy("scan_id").orderBy("happened", "seq")
    runs = F.col("event").isin(*RUNNING)
    out = events.withColumn("__runs", F.coalesce(F.lag(runs).over(by), F.lit(False)))
    out = out.withColumn("refused", F.col("event").isin("failed", "cancelled") & ~F.col("__runs"))
    now = F.last(F.when(~F.col("refused"), F.col("event")), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn("status", now).drop("__runs")


def histories(events: DataFrame) -> DataFrame:
    """(scan_id, status, date_started, date_finished, refused): each scan after transitions(events).  A scan starts with its
    first phase after queueing, and a later one does not move that; it finished when it last ended."""
    seen = transitions(events)
    key = F.struct("happened", "seq")
    taken = ~F.col("refused")
    ended = taken & ~F.col("event").isin(*RUNNING)
    phase = F.col("event").isin("extracting", "checking")
    return seen.groupBy("scan_id").agg(
        F.max_by("status", key).alias("status"),
        F.min(F.when(phase, F.col("happened"))).alias("date_started"),
        F.max(F.when(ended, F.col("happened"))).alias("date_finished"),
        F.count_if("refused").alias("refused"),
    )


def by_id(scans: DataFrame, scan_id: int) -> DataFrame:
    """The scan's row, or none."""
    return scans.where(F.col("id") == scan_id).limit(1)
