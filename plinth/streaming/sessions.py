"""Building sessions as keyed state: opened, filled with placed elements, closed, or expired.

State lives by session in the state store, which is restored from the checkpoint
after a lost executor or a restart.  Events wait there until the watermark has
passed them and are then applied in order of time, so the outcome does not hang
on the order they arrive in; a session that is idle for too long is closed by a
timer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: State that keeps timers and lists needs this provider.
STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ACTIONS = "session_id long, event_id long, ts timestamp, action string, element_id long"
OUTCOME = "session_id long, event_id long, outcome string, element_id long, n_placed long, at_us long"


class SessionWalk(StatefulProcessor):
    """One session's events in order: each gives what became of it.

    opened, ignored (open when already open), placed, refused (no session is
    open), closed, and expired, where ``idle_us`` microseconds pass without an
    event.  ``n_placed``: elements placed since the session was opened.
    """

    def __init__(self, idle_us: int):
        self.idle_us = idle_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", "open boolean, n_placed long, last_us long, event_id long")
        self.placed = handle.getListState("placed", "element_id long")
        self.waiting = handle.getListState("waiting", "at_us long, event_id long, action string, element_id long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            elements = [None if pd.isna(e) else int(e) for e in part["element_id"]]
            arrived = list(zip(part["at_us"].tolist(), part["event_id"].tolist(), part["action"].tolist(), elements))
            if arrived:
                self.waiting.appendList(arrived)
                earliest = min(r[0] for r in arrived)
                first = earliest if first is None else min(first, earliest)
        # applied by a timer, once the watermark is past them; what waits already has its timer and is not read again
        if first is not None:
            watermark = timerValues.getCurrentWatermarkInMs()
            wanted = max(-(-first // 1000), watermark + 1)
            # one that fires now goes by itself, and sets the next for all that waits
            timers = [t for t in self.handle.listTimers() if t > watermark]
            if not timers or wanted < min(timers):
                for timer in timers:
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(wanted)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        waiting = sorted(tuple(r) for r in self.waiting.get())
        due = [r for r in waiting if r[0] <= watermark * 1000]
        later = waiting[len(due) :]
        out = self._apply(key[0], due, watermark * 1000)
        self.waiting.clear()
        if later:
            self.waiting.put(later)
        self._rewind(watermark, later)
        if out:
            yield pd.DataFrame(out, columns=["session_id", "event_id", "outcome", "element_id", "n_placed", "at_us"]).astype({"element_id": "Int64"})

    def _apply(self, key: int, due: list[tuple], until: int) -> list[tuple]:
        opened, count, last, at_event = self.session.get() if self.session.exists() else (False, 0, None, None)
        out, fresh, emptied = [], [], False

        def expire(now: int) -> None:
            nonlocal opened, count, fresh, emptied
            if opened and last is not None and now - last > self.idle_us:
                out.append((key, at_event, "expired", None, count, last + self.idle_us))
                opened, count, fresh, emptied = False, 0, [], True

        for at, event, action, element in due:
            expire(at)
            if action == "open":
                outcome = "ignored" if opened else "opened"
                opened = True
            elif not opened:
                outcome = "refused"
            elif action == "close":
                outcome = "closed"
            else:
                outcome, count = "placed", count + 1
                fresh.append((element,))
            out.append((key, event, outcome, element if outcome == "placed" else None, count, at))
            if outcome == "closed":
                opened, count, fresh, emptied = False, 0, [], True
            last, at_event = at, event
        expire(until)
        if emptied:
            self.placed.clear()
        if opened:
            if fresh:
                self.placed.appendList(fresh)
            self.session.update((opened, count, last, at_event))
        else:
            # nothing of a session that is not open matters to later events
            self.session.clear()
        return out

    def _rewind(self, watermark: int, waiting: list[tuple]) -> None:
        """One timer: for the first event that waits, or the session's idle end."""
        wanted = [-(-r[0] // 1000) for r in waiting]
        if self.session.exists():
            wanted.append((self.session.get()[2] + self.idle_us) // 1000 + 1)
        # one that fires now goes by itself
        for timer in list(self.handle.listTimers()):
            if timer > watermark:
                self.handle.deleteTimer(timer)
        if wanted:
            self.handle.registerTimer(max(min(wanted), watermark + 1))

    def close(self) -> None:
        pass


def walk_sessions(actions: DataFrame, late: str = "10 minutes", idle_minutes: int = 60) -> DataFrame:
    """What became of each action of a stream, and expiries, in append mode.

    ``actions``: session_id, event_id, ts, action (open, place, close) and
    element_id.  Events up to ``late`` behind the newest count in their
    order; older ones are dropped.  The session's state provider must be
    ``STATE_PROVIDER``.
    """
    ready = actions.withWatermark("ts", late).withColumn("at_us", F.unix_micros("ts"))
    walker = SessionWalk(idle_minutes * 60_000_000)
    return ready.groupBy("session_id").transformWithStateInPandas(statefulProcessor=walker, outputStructType=OUTCOME, outputMode="Append", timeMode="EventTime")


def with_state_provider(spark, run: Callable[[], DataFrame]) -> DataFrame:
    """``run()`` under ``STATE_PROVIDER``, and the session's own setting again afterwards."""
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, STATE_PROVIDER)
    try:
        return run()
    finally:
        spark.conf.set(setting, before) if before else spark.conf.unset(setting)
