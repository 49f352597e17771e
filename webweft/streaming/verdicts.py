"""The verdict fold over a stream of checks: state by address, updated batch by batch.

The state of an address is what fold() says of all its checks so far.  A micro-batch's checks of an address are taken in
order of time; a check that comes in a later batch than a younger one is folded when it comes, as the audit does."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.fold import FAILURES, FAILURES_DNS, RECHECK_HOURS

OUT = "url_id long, status string, fail_count long, last_checked timestamp, last_ok timestamp, last_broken timestamp, next_check timestamp"
STATE = "status string, fail_count long, last_checked timestamp, last_ok timestamp, last_broken timestamp"


def step(state: tuple, at, status: str, reason: str | None) -> tuple:
    """The state after one check."""
    before, fails, _, ok, broken = state
    fails = fails + 1 if status == "unreachable" else 0 if status in ("ok", "redirect") else fails
    now = "broken" if status == "unreachable" and fails >= (FAILURES_DNS if reason == "dns" else FAILURES) else status
    return now, fails, at, at if now in ("ok", "redirect") else ok, at if now == "broken" and before != "broken" else broken


def _fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    now = state.get if state.exists else ("pending", 0, None, None, None)
    rows = pd.concat(list(frames)).sort_values(["checked_at", "check_id"], kind="stable")
    for at, status, reason in zip(rows["checked_at"], rows["status"], rows["reason"], strict=True):
        now = step(now, at.to_pydatetime(), status, reason)
    state.update(now)
    hours = RECHECK_HOURS.get(now[0])
    due = now[2] + pd.Timedelta(hours=hours) if hours else None
    yield pd.DataFrame({c: pd.Series([v], dtype="object" if c == "status" else "int64" if c in ("url_id", "fail_count") else "datetime64[ns]") for c, v in zip(("url_id", "status", "fail_count", "last_checked", "last_ok", "last_broken", "next_check"), (key[0], *now, due), strict=True)})


def folded(log: DataFrame) -> DataFrame:
    """A stream of log(check_id, url_id, checked_at, status, reason) as a stream of changed states (update mode).  A group is
    one address' checks of one micro-batch; limit the batch at the source."""
    seen = log.where("status <> 'pending'").selectExpr("check_id", "url_id", "CAST(checked_at AS TIMESTAMP) AS checked_at", "status", "reason")
    return seen.groupBy("url_id").applyInPandasWithState(_fold, OUT, STATE, "update", GroupStateTimeout.NoTimeout)
