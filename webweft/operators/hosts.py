"""What is remembered of hosts between requests, and which requests may be made when."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import verdicts as V

# Limits of politeness.
BACKOFF_AFTER, BACKOFF_SECONDS, LONGEST_BLOCK, MOST_DELAY_MS, CONFIGURED_MS = 3, 60, 900, 30000, 250
RUN_SECONDS = 90


def backoff_seconds(failures: Column) -> Column:
    return F.when(failures >= BACKOFF_AFTER, F.least(F.lit(LONGEST_BLOCK).cast("double"), BACKOFF_SECONDS * F.pow(F.lit(2.0), failures - BACKOFF_AFTER)).cast("long"))


def learned_delay(wait: Column) -> Column:
    """Milliseconds between requests that a host's wish to be left alone for `wait` seconds teaches."""
    return F.least(F.lit(MOST_DELAY_MS).cast("long"), rate_limit_seconds(wait) * 1000)


def rate_limit_seconds(wait: Column) -> Column:
    return F.least(F.lit(LONGEST_BLOCK).cast("long"), F.greatest(F.lit(1).cast("long"), F.coalesce(wait, F.lit(60).cast("long"))))


def decayed(delay: Column, configured: int = CONFIGURED_MS) -> Column:
    half = F.floor(delay / 2)
    return F.when(half > configured, half)


def effective_delay(delay: Column, configured: int = CONFIGURED_MS) -> Column:
    return F.greatest(F.lit(configured).cast("long"), F.coalesce(delay.cast("long"), F.lit(0).cast("long")))


def _halved(delay: Column, times: Column, configured: int) -> Column:
    """delay after so many successes; sixteen undo the greatest."""
    n = F.least(times, F.lit(16).cast("long")).cast("int")
    return F.aggregate(F.array_repeat(F.lit(0), n), delay, lambda d, _: F.coalesce(decayed(d, configured), F.lit(0).cast("long")))


def folded(log: DataFrame, configured: int = CONFIGURED_MS, slices: str = "hour") -> DataFrame:
    """log(host, seen_at, seq, status, http_status, wait) in order to one state a host: consecutive failures, last status, learned
    delay, until when it is blocked, whether it refuses robots.

    Running counts are taken inside slices of time and carried over from slice to slice in a table of one row a host and slice,
    so no task sorts a host's whole log.  The failures are those since the last success.  A success halves the delay and a rate
    limit raises it to a least value; as halving keeps the order of values, the delay is the greatest of what each limit taught,
    halved by the successes after it."""
    kind = F.when(F.col("status").isin("ok", "redirect", "broken", "blocked"), "success").when(F.col("status") == "unreachable", "failure").when((F.col("status") == "pending") & (F.col("http_status") == 429), "limit")
    seen = log.withColumn("kind", kind).where("kind is not null").withColumn("slice", F.date_trunc(slices, "seen_at"))
    one = lambda k: F.when(F.col("kind") == k, 1).otherwise(0)
    seen = seen.withColumn("wins", F.sum(one("success")).over(Window.partitionBy("host", "slice").orderBy("seen_at", "seq")))
    seen = seen.withColumn("fails", F.sum(one("failure")).over(Window.partitionBy("host", "slice", "wins").orderBy("seen_at", "seq")))

    key, by = F.struct("seen_at", "seq"), Window.partitionBy("host").orderBy("slice")
    ends = seen.groupBy("host", "slice").agg(F.max("wins").alias("__wins"), F.max_by("fails", key).alias("__fails"))
    ends = ends.withColumn("__stretch", F.sum(F.when(F.col("__wins") > 0, 1).otherwise(0)).over(by))
    ends = ends.withColumn("__open", F.sum("__fails").over(Window.partitionBy("host", "__stretch").orderBy("slice")))
    ends = ends.select("host", "slice", F.coalesce(F.lag("__open").over(by), F.lit(0)).alias("__carried"), F.coalesce(F.sum("__wins").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"), F.sum("__wins").over(Window.partitionBy("host")).alias("__all"))

    seen = seen.join(ends, ["host", "slice"])
    seen = seen.withColumn("fails", F.col("fails") + F.when(F.col("wins") == 0, F.col("__carried")).otherwise(0))
    seconds = F.when(F.col("kind") == "limit", rate_limit_seconds(F.col("wait"))).when(F.col("kind") == "failure", backoff_seconds(F.col("fails")))
    seen = seen.withColumn("until", F.when(seconds.isNotNull(), F.col("seen_at") + F.make_dt_interval(secs=seconds)))
    taught = F.when(F.col("kind") == "limit", _halved(learned_delay(F.col("wait")), F.col("__all") - F.col("__before") - F.col("wins"), configured))
    state = seen.groupBy("host").agg(
        F.max_by("fails", key).cast("long").alias("consecutive_failures"),
        F.max_by("http_status", key).alias("last_status"),
        F.max(taught).alias("delay"),
        F.max(F.when(F.col("kind") == "success", key)).alias("won"),
        F.max(F.when(F.col("until").isNotNull(), F.struct("seen_at", "seq", "until"))).alias("block"),
        F.max(F.col("status") == "blocked").alias("bot_hostile"),
        F.max("seen_at").alias("date_last_request"),
    )
    # The last block holds unless a success came after it.
    later = F.col("won").isNotNull() & (F.col("won") > F.struct("block.seen_at", "block.seq"))
    return state.select(
        "host", "consecutive_failures", F.col("last_status").cast("int").alias("last_status"), F.when(F.col("delay") > 0, F.col("delay")).alias("min_delay_ms"), F.when(~later, F.col("block.until")).alias("blocked_until"), "bot_hostile", "date_last_request"
    )


def numbered(rows: DataFrame, stretch: int = 1 << 16) -> DataFrame:
    """rows(host, id) with `sweep`, their number within the host by id, from 1: counted inside stretches of the id and carried
    over, so that no task sorts a host's rows."""
    part = rows.withColumn("__s", F.floor(F.col("id") / stretch))
    before = part.groupBy("host", "__s").agg(F.count("*").alias("__n"))
    upto = Window.partitionBy("host").orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)  # one row a host and stretch
    before = before.select("host", "__s", F.coalesce(F.sum("__n").over(upto), F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy("host", "__s").orderBy("id"))
    return part.withColumn("__p", place).join(before, ["host", "__s"]).withColumn("sweep", (F.col("__before") + F.col("__p")).cast("long")).drop("__s", "__p", "__before")


def plan(urls: DataFrame, hosts: DataFrame, as_of: str, configured: int = CONFIGURED_MS, budget: float = RUN_SECONDS) -> DataFrame:
    """Round-robin over hosts: (id, host, sweep, deferred, reason, seconds).  An address of a blocked host waits until the
    block ends, one beyond what fits the budget at the host's gap waits as shortly as deferrals go."""
    at = F.lit(as_of).cast("timestamp_ntz")
    state = hosts.select("host", effective_delay(F.col("min_delay_ms"), configured).alias("gap"), "blocked_until")
    out = numbered(urls.where("host <> ''").select("id", "host").distinct()).join(state, "host", "left")
    gap = F.coalesce("gap", F.lit(configured).cast("long"))
    left = (F.unix_timestamp("blocked_until") - F.unix_timestamp(at)).cast("long")
    blocked = F.coalesce(F.col("blocked_until") > at, F.lit(False))
    over = F.coalesce(F.col("sweep") > V.fit_count(gap, budget), F.lit(False))
    seconds = F.when(blocked, V.deferral_seconds(left)).when(over, V.deferral_seconds(F.lit(None).cast("long")))
    return out.select("id", "host", "sweep", (blocked | over).alias("deferred"), F.when(blocked | over, "host-backoff").alias("reason"), seconds.alias("seconds"))
