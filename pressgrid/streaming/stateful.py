"""Stateful streams whose state leaves by event-time timers.

Both jobs write updates: what a key's last update says about open things replaces what its earlier
updates said.  So a drained stream needs no second look at its log.  The state store has to be RocksDB;
rocksdb_state() sets it while a query starts.
"""
from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import constants as K
from ..functions import payload as P

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
QUIET_MS = 350
HISTORY_DAYS = 365
_DAY_MS = 86_400_000
#: Rows of one subject that are merged at once.
MERGE_ROWS = 4096


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB; the session's own setting comes back afterwards."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def _wake_at(handle: StatefulProcessorHandle, when: int | None) -> None:
    """The key's only timer."""
    for timer in list(handle.listTimers()):
        if timer != when:
            handle.deleteTimer(timer)
    if when is not None:
        handle.registerTimer(when)


class _Batches(StatefulProcessor):
    """The shown items of a (session, context) that may still get company; times in microseconds."""

    def __init__(self, quiet_ms: int):
        self.quiet = quiet_ms * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.items = handle.getListState("items", "t long, article_id string, position int")

    def _settle(self, key, items: list[tuple], watermark_ms: int) -> tuple[list[tuple], int | None, list[Row]]:
        """What stays open, when it is to be looked at again, and the update."""
        groups: list[list[tuple]] = []
        for item in sorted(items, key=lambda x: x[0]):
            if groups and item[0] - groups[-1][-1][0] < self.quiet:
                groups[-1].append(item)
            else:
                groups.append([item])
        left, wake, rows = [], None, []
        for g in groups:
            end = g[-1][0] + self.quiet
            still = end > watermark_ms * 1000
            if still:
                left += g
                wake = wake or max(-(-end // 1000), watermark_ms + 1)  # groups are in time order
            shown = sorted({(a, p) for _, a, p in g}, key=lambda x: (x[0] is not None, x[0] or "", x[1] is not None, x[1] or 0))
            rows.append(Row(session_id=key[0], context=key[1], opened_us=g[0][0], closed_us=end,
                            articles=[{"article_id": a, "position": p} for a, p in shown], is_open=still))
        return left, wake, rows

    def handleInputRows(self, key, rows, timerValues):
        before = [tuple(r) for r in self.items.get()]
        items = before + [(r.t, r.article_id, r.position) for r in rows]
        left, wake, out = self._settle(key, items, timerValues.getCurrentWatermarkInMs())
        if left:
            self.items.put(left)
        elif before:
            self.items.clear()
        if before:
            _wake_at(self.handle, wake)
        elif wake is not None:  # a key without state has no timer
            self.handle.registerTimer(wake)
        return iter(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        items = [tuple(r) for r in self.items.get()]
        if not items:
            return iter(())
        left, wake, out = self._settle(key, items, timerValues.getCurrentWatermarkInMs())
        if left:
            self.items.put(left)
            self.handle.registerTimer(wake)
        else:
            self.items.clear()
        return iter(out)  # the timer that fired was the key's only one and is deleted by Spark


def impression_batches(items: DataFrame, quiet_ms: int = QUIET_MS, delay: str = "1 minute") -> DataFrame:
    """Items of one session and context gathered until the context has been quiet for ``quiet_ms``.

    Every update of a key gives its batches as they are: those that the watermark has passed for the last
    time (is_open false), and all open ones.  A timer closes a batch at its quiet time and frees its state.
    Items more than ``delay`` behind the newest of earlier batches, or without a time, are dropped.
    settled() reads the updates.
    """
    rows = items.withWatermark("event_time", delay).where("event_time is not null").select("session_id", "context", "event_time", "article_id", "position", F.unix_micros("event_time").alias("t"))
    return rows.groupBy("session_id", "context").transformWithState(
        _Batches(quiet_ms), "session_id string, context string, opened_us long, closed_us long, articles array<struct<article_id: string, position: int>>, is_open boolean",
        "Update", "eventTime")


def settled(updates: DataFrame) -> DataFrame:
    """(session_id, context, opened_at, closed_at, articles, is_open): closed batches, and the open ones of each key's last update."""
    last = updates.groupBy("session_id", "context").agg(F.max("batch_id").alias("_last")).withColumnsRenamed({"session_id": "_s", "context": "_c"})
    rows = updates.join(last, F.col("session_id").eqNullSafe(F.col("_s")) & F.col("context").eqNullSafe(F.col("_c")))
    return rows.where(~F.col("is_open") | (F.col("batch_id") == F.col("_last"))).select(
        "session_id", "context", F.timestamp_micros("opened_us").alias("opened_at"), F.timestamp_micros("closed_us").alias("closed_at"), "articles", "is_open")


class _History(StatefulProcessor):
    """The latest reads of a subject, newest first, and the time of its newest event."""

    def __init__(self, size: int, keep_ms: int):
        self.size, self.keep = size, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.reads = handle.getListState("reads", "created_at string, article_id string")
        self.newest = handle.getValueState("newest", "ms long")

    def _latest(self, items: list[tuple]) -> list[tuple]:
        return sorted(items, key=lambda x: (x[0] is not None, x[0] or "", x[1]), reverse=True)[:self.size]

    def handleInputRows(self, key, rows, timerValues):
        known = self.newest.get()
        items = [tuple(r) for r in self.reads.get()] if known else []
        newest = known[0] if known else 0
        for r in rows:  # order-free, so a busy subject is merged in parts
            items.append((r.created_at, r.article_id))
            newest = max(newest, r.ms)
            if len(items) >= self.size + MERGE_ROWS:
                items = self._latest(items)
        items = self._latest(items)
        self.reads.put(items)
        self.newest.update((newest,))
        watermark = timerValues.getCurrentWatermarkInMs()
        if not known:  # a subject without state has no timer
            self.handle.registerTimer(max(newest + self.keep, watermark + 1))
        elif newest + self.keep <= watermark:
            _wake_at(self.handle, watermark + 1)
        return iter([Row(subject=key[0], pos=n, article_id=a, created_at=c) for n, (c, a) in enumerate(items, 1)])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        """The timer stays where the subject's first event put it; a subject seen since gets its next one here."""
        known = self.newest.get()
        if known and known[0] + self.keep > timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(known[0] + self.keep)
        elif known:
            self.reads.clear()
            self.newest.clear()
        return iter(())


def history_state(events: DataFrame, size: int = K.HISTORY_SIZE, keep_days: int = HISTORY_DAYS, delay: str = "30 days") -> DataFrame:
    """Latest positives per subject; the state is at most ``size`` rows of the subjects seen of late.

    A subject without an event for ``keep_days`` leaves the state once the watermark has passed that time;
    its last update stays in the table, and when it comes back its list starts again.  Rows more than ``delay``
    behind the newest event of earlier batches are dropped.  A null created_at sorts behind all others.
    """
    rows = events.withWatermark("event_time", delay).where(F.col("event_type").isin(K.POSITIVE_EVENTS) & (F.col("article_id") != "")).select(
        P.subject_key(F.col("user_id"), F.col("session_id")).alias("subject"), "article_id", "created_at", "event_time",
        F.coalesce(F.unix_millis("event_time"), F.lit(0)).alias("ms"))
    return rows.groupBy("subject").transformWithState(
        _History(size, keep_days * _DAY_MS), "subject string, pos int, article_id string, created_at string", "Update", "eventTime")
