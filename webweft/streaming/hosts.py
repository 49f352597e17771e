"""What is remembered of hosts, over a stream of requests: state by host, with timers that lift a block when it ends."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.hosts import BACKOFF_AFTER, BACKOFF_SECONDS, CONFIGURED_MS, LONGEST_BLOCK, MOST_DELAY_MS

STATE = "consecutive_failures long, last_status int, min_delay_ms long, blocked_until timestamp, bot_hostile boolean, date_last_request timestamp"
OUT = f"host string, {STATE}, lifted boolean"
FRESH = (0, None, None, None, False, None)


def step(state: tuple, at: datetime, status: str, code: int | None, wait: int | None, configured: int = CONFIGURED_MS) -> tuple:
    """The state after one request; one that says nothing of the host changes nothing."""
    fails, last, delay, blocked, hostile, asked = state
    if status in ("ok", "redirect", "broken", "blocked"):
        half = None if delay is None else delay // 2
        return 0, code, half if half is not None and half > configured else None, None, hostile or status == "blocked", at
    if status == "unreachable":
        fails += 1
        if fails >= BACKOFF_AFTER:
            blocked = at + timedelta(seconds=int(min(LONGEST_BLOCK, BACKOFF_SECONDS * 2.0 ** min(fails - BACKOFF_AFTER, 60))))
        return fails, code, delay, blocked, hostile, at
    if status == "pending" and code == 429:
        seconds = min(LONGEST_BLOCK, max(1, 60 if wait is None else wait))
        return fails, code, max(delay or 0, min(MOST_DELAY_MS, seconds * 1000)), at + timedelta(seconds=seconds), hostile, at
    return state


def _plain(value):
    return None if value is None or value != value or value is pd.NaT else value


def _millis(at: datetime) -> int:
    return int((at if at.tzinfo else at.replace(tzinfo=timezone.utc)).timestamp() * 1000)


def _row(host: str, state: tuple, lifted: bool) -> pd.DataFrame:
    names = [f.split()[0] for f in OUT.split(", ")]
    kinds = {"long": "Int64", "int": "Int32", "boolean": "boolean", "string": "object", "timestamp": "datetime64[ns]"}
    return pd.DataFrame({n: pd.Series([v], dtype=kinds[f.split()[1]]) for n, f, v in zip(names, OUT.split(", "), (host, *state, lifted), strict=True)})


class Hosts(StatefulProcessor):
    """Rows of a host of one micro-batch in order of time, then timers.  A timer stands at the end of the host's block; when
    the watermark has passed it the block is gone from the state and a row says so."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("host", STATE)

    def _now(self) -> tuple:
        return tuple(map(_plain, self.state.get())) if self.state.exists() else FRESH

    def _set_timer(self, blocked: datetime | None) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if blocked is not None:
            self.handle.registerTimer(_millis(blocked))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = self._now()
        held = pd.concat(list(rows)).sort_values(["seen_at", "seq"], kind="stable")
        for at, status, code, wait in zip(held["seen_at"], held["status"], held["http_status"], held["wait"], strict=True):
            code, wait = _plain(code), _plain(wait)
            now = step(now, at.to_pydatetime(), status, None if code is None else int(code), None if wait is None else int(wait))
        self.state.update(now)
        self._set_timer(now[3])
        yield _row(key[0], now, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = self._now()
        if now[3] is not None and _millis(now[3]) <= expiredTimerInfo.getExpiryTimeInMs():
            now = (*now[:3], None, *now[4:])
            self.state.update(now)
            yield _row(key[0], now, True)

    def close(self) -> None:
        pass


def folded(log: DataFrame, late: str = "10 minutes") -> DataFrame:
    """A stream of log(host, seen_at, seq, status, http_status, wait) as a stream of changed states; lifted: the row says that a
    block has ended.  Rows later than the watermark are taken when they come.  The state store must be RocksDB's."""
    seen = log.selectExpr("host", "CAST(seen_at AS TIMESTAMP) AS seen_at", "seq", "status", "http_status", "wait").withWatermark("seen_at", late)
    return seen.groupBy("host").transformWithStateInPandas(Hosts(), OUT, "Update", "EventTime")
