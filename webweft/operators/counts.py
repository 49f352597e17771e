"""Counts of addresses by site and verdict that changes keep up to date.

An address counts on a site while some reference there holds it.  Kept are the counts (site_id, status, n) and the pairs
(site_id, url_id, refs) behind them.  A batch of changes moves what it touches alone: each touched pair is minus one where
and as it counted before, plus one where and as it counts now.  Batches may be held back and applied together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pairs_of(refs: DataFrame) -> DataFrame:
    return refs.groupBy("site_id", "url_id").agg(F.count("*").alias("refs"))


def counted(pairs: DataFrame, urls: DataFrame) -> DataFrame:
    """The counts worked out from nothing: (site_id, status, n), n above zero."""
    status = urls.select(F.col("id").alias("url_id"), "status")
    return pairs.where("refs > 0").join(status, "url_id").groupBy("site_id", "status").agg(F.count("*").alias("n"))


def moved(pairs: DataFrame, ref_changes: DataFrame, url_changes: DataFrame, urls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs after the changes, (site_id, status, n) differences).

    ref_changes(site_id, url_id, n): references that came (1) or went (-1), in any number of rows; url_changes(url_id, before,
    after): verdicts that changed, one row an address, null for an address that is not stored before or after; urls(id, status)
    as stored before.  An address in no row of either is not read from pairs."""
    change = ref_changes.groupBy("site_id", "url_id").agg(F.sum("n").alias("__n"))
    turned = url_changes.select("url_id", F.col("before").alias("__before"), F.col("after").alias("__after"), F.lit(True).alias("__turned"))
    after = pairs.join(change, ["site_id", "url_id"], "full").select("site_id", "url_id", F.coalesce("refs", F.lit(0)).alias("__was"), (F.coalesce("refs", F.lit(0)) + F.coalesce("__n", F.lit(0))).alias("refs"), F.col("__n").isNotNull().alias("__hit"))
    touched = after.join(turned, "url_id", "left").where("__hit or __turned").join(urls.select(F.col("id").alias("url_id"), F.col("status").alias("__status")), "url_id", "left")
    before = F.when(F.col("__turned"), F.col("__before")).otherwise(F.col("__status"))
    now = F.when(F.col("__turned"), F.col("__after")).otherwise(F.col("__status"))
    none = F.struct(F.lit(None).cast("string").alias("status"), F.lit(0).alias("n"))
    steps = F.array(F.when(F.col("__was") > 0, F.struct(before.alias("status"), F.lit(-1).alias("n"))).otherwise(none), F.when(F.col("refs") > 0, F.struct(now.alias("status"), F.lit(1).alias("n"))).otherwise(none))
    delta = touched.select("site_id", F.explode(steps).alias("s")).where("s.n <> 0 and s.status is not null")
    return after.where("refs > 0").select("site_id", "url_id", "refs"), delta.groupBy("site_id", F.col("s.status").alias("status")).agg(F.sum("s.n").alias("n")).where("n <> 0")


def applied(counts: DataFrame, *differences: DataFrame) -> DataFrame:
    """counts after one or more batches of differences; what comes to zero has no row."""
    out = counts.select("site_id", "status", "n")
    for d in differences:
        out = out.unionByName(d.select("site_id", "status", "n"))
    return out.groupBy("site_id", "status").agg(F.sum("n").cast("long").alias("n")).where("n <> 0")
