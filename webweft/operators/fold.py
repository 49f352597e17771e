"""Verdict histories folded into state, in window form.

Only ok and redirect reset the failure count, so the count is a running sum inside the stretch between two
resets; no per-address loop is needed and a hot address sorts and spills like any window partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hours until a verdict is checked again, and failures that make an address broken.
RECHECK_HOURS = {"ok": 720, "redirect": 720, "blocked": 336, "broken": 24, "unreachable": 6}
FAILURES, FAILURES_DNS = 3, 2


def next_check(status: Column, at: Column) -> Column:
    out = F.lit(None).cast("timestamp_ntz")
    for name, hours in RECHECK_HOURS.items():
        out = F.when(status == name, at + F.expr(f"INTERVAL '{hours}' HOUR")).otherwise(out)
    return out


def fold(log: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """log(check_id, url_id, checked_at, status, reason) to one row per url_id.  Pending rows are deferrals and
    change nothing.  A history starts as pending with no failures, or from state(url_id, status, reason, fail_count): an
    address that a person ignored is frozen, its checks change nothing and it has no row."""
    by = Window.partitionBy("url_id").orderBy("checked_at", "check_id")
    seen = log.where("status <> 'pending'")
    if state is None:
        seen = seen.withColumn("status0", F.lit("pending")).withColumn("fails0", F.lit(0).cast("long"))
    else:
        held = state.select("url_id", F.col("status").alias("status0"), F.col("reason").alias("reason0"), F.col("fail_count").cast("long").alias("fails0"))
        seen = seen.join(held, "url_id", "left").where("not coalesce(status0 = 'ignored' and reason0 = 'ignored', false)").drop("reason0").fillna({"status0": "pending", "fails0": 0})
    seen = seen.withColumn("g", F.sum(F.when(F.col("status").isin("ok", "redirect"), 1).otherwise(0)).over(by))
    stretch = Window.partitionBy("url_id", "g").orderBy("checked_at", "check_id")
    failed = F.sum(F.when(F.col("status") == "unreachable", 1).otherwise(0)).over(stretch)
    seen = seen.withColumn("fails", failed + F.when(F.col("g") == 0, F.col("fails0")).otherwise(0))
    limit = F.when(F.col("reason") == "dns", FAILURES_DNS).otherwise(FAILURES)
    seen = seen.withColumn("now", F.when((F.col("status") == "unreachable") & (F.col("fails") >= limit), "broken").otherwise(F.col("status")))
    seen = seen.withColumn("before", F.coalesce(F.lag("now").over(by), F.col("status0")))
    key = F.struct("checked_at", "check_id")
    out = seen.groupBy("url_id").agg(
        F.max_by("now", key).alias("status"),
        F.max_by("fails", key).cast("long").alias("fail_count"),
        F.max("checked_at").alias("last_checked"),
        F.max(F.when(F.col("now").isin("ok", "redirect"), F.col("checked_at"))).alias("last_ok"),
        F.max(F.when((F.col("now") == "broken") & (F.col("before") != "broken"), F.col("checked_at"))).alias("last_broken"),
    )
    return out.withColumn("next_check", next_check(F.col("status"), F.col("last_checked")))
