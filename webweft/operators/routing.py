"""Due addresses on the way to their verdicts, and rules of one's own on verdicts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .reports import STATUSES

VERDICT = ("status", "reason")


def routed(rows: DataFrame) -> tuple[DataFrame, Observation]:
    """(id, way, status, reason, seconds) of rows(id, is_internal, ignored, own_status, own_reason, answer_status, answer_reason,
    wait), and the counters of the pass.

    One reading, three ways: what a person or a rule ignores (`ignored` has the reason) settles as ignored; an own address that
    the database can judge (own_status) takes that verdict; all else needs a request: its answer, or the seconds to wait where
    it was put off, or nothing yet.  The counters (`checked`, `broken`), there once the rows have been written, count settled
    rows, and broken ones among them but for the ignored."""
    way = F.when(F.col("ignored").isNotNull(), "ignored").when(F.col("is_internal") & F.col("own_status").isNotNull(), "own").otherwise("request")
    put_off = (F.col("way") == "request") & F.col("wait").isNotNull()
    status = F.when(F.col("way") == "ignored", "ignored").when(F.col("way") == "own", F.col("own_status")).when(~put_off, F.col("answer_status"))
    reason = F.when(F.col("way") == "ignored", F.col("ignored")).when(F.col("way") == "own", F.col("own_reason")).when(~put_off, F.col("answer_reason"))
    out = rows.withColumn("way", way).select("id", "way", status.alias("status"), reason.alias("reason"), F.when(put_off, F.col("wait")).alias("seconds"))
    seen = Observation("check")
    return out.observe(seen, F.count_if(F.col("status").isNotNull()).alias("checked"), F.count_if((F.col("status") == "broken") & (F.col("way") != "ignored")).alias("broken")), seen


Hook = Callable[[DataFrame], DataFrame]


def overridden(verdicts: DataFrame, hooks: list[Hook], key: str = "id") -> DataFrame:
    """verdicts(key, status, reason, ...) after each hook in turn.

    A hook is given the verdicts as they stand and returns (key, status, reason) of those that it changes; other rows stay.
    A row for a key that is not there changes nothing.  Two rows for a key, a status that does not exist, or other columns are
    errors: the last when the hook is applied, the first two in the job that reads the verdicts."""
    for hook in hooks:
        said = hook(verdicts)
        if missing := {key, *VERDICT} - set(said.columns):
            raise ValueError(f"a verdict hook must return {key}, status and reason; missing: {sorted(missing)}")
        for c in (key, *VERDICT):
            if said.schema[c].dataType != verdicts.schema[c].dataType:
                raise TypeError(f"a verdict hook returned {c} as {said.schema[c].dataType.simpleString()}")
        one = said.groupBy(F.col(key).alias("__key")).agg(F.count("*").alias("__n"), F.first("status").alias("__status"), F.first("reason").alias("__reason"))
        fault = F.when(F.col("__n") > 1, "two verdicts for one address").when(~F.coalesce(F.col("__status").isin(*STATUSES), F.lit(False)), "no such verdict")
        one = one.select("__key", F.when(fault.isNotNull(), F.raise_error(fault).cast("string")).otherwise(F.col("__status")).alias("__status"), "__reason")
        joined = verdicts.join(one, F.col(key) == F.col("__key"), "left")
        hit = F.col("__key").isNotNull()
        verdicts = joined.select(*(F.when(hit, F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in VERDICT else F.col(c) for c in verdicts.columns))
    return verdicts
