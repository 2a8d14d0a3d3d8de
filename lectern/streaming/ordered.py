"""Streams taken in the order of their events: attempts move cards on, and events are counted by windows that begin with the first.

Rows wait in the state of their key until the watermark has passed them, and are then taken by time, in whatever batches they came. A timer a key stands at
the first row that waits. A row that comes after the watermark has passed its time is taken when it comes. The state store must be one that keeps lists and timers (RocksDB).
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_UTC = datetime.timezone.utc


def _ms(at: datetime.datetime) -> int:
    return int(at.astimezone(_UTC).timestamp() * 1000)


class InOrder(StatefulProcessor):
    """Buffers rows (``waiting``: their schema, with ms and tie to order them by) and gives those that the watermark has passed to ``take``."""

    waiting, kept = "ms long, tie long", "n long"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.buffer, self.state = handle.getListState("waiting", self.waiting), handle.getValueState("kept", self.kept)

    def row(self, r: Row) -> tuple:
        raise NotImplementedError

    def take(self, key: tuple, rows: list[tuple], now: int) -> Iterator[Row]:
        raise NotImplementedError

    def _settled(self, key: tuple, rows: list[tuple], now: int) -> Iterator[Row]:
        rows = sorted(rows)
        ready, rest = [r for r in rows if r[0] <= now], [r for r in rows if r[0] > now]
        self.buffer.clear()
        if rest:
            self.buffer.put(rest)
            self.handle.registerTimer(rest[0][0])
        if ready:
            yield from self.take(key, ready, now)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = [tuple(r) for r in self.buffer.get()]
        yield from self._settled(key, held + [self.row(r) for r in rows], max(timerValues.getCurrentWatermarkInMs(), 0))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._settled(key, [tuple(r) for r in self.buffer.get()], max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()))

    def close(self) -> None:
        pass


class _Boxes(InOrder):
    waiting, kept = "ms long, tie long, ok boolean", "reviews long, box long"

    def __init__(self, seed: int, boxes: int):
        self.seed, self.boxes = seed, boxes

    def row(self, r: Row) -> tuple:
        return _ms(r.ts), r.attempt_id, r.ok

    def take(self, key, rows, now) -> Iterator[Row]:
        reviews, box = tuple(self.state.get()) if self.state.exists() else (0, self.seed)
        for _, _, ok in rows:
            reviews, box = reviews + 1, min(box + 1, self.boxes) if ok else 1
        self.state.update((reviews, box))
        yield Row(user_id=key[0], mcq=key[1], reviews=reviews, box=box)


def boxes_in_order(attempts: DataFrame, delay: str = "10 minutes", seed: int = 0, boxes: int = 5) -> DataFrame:
    """A streaming ``attempts`` (user_id, mcq, ts, attempt_id, ok) -> user_id, mcq, reviews, box: what the batch replay makes of all attempts that the watermark has passed. Cards start in box ``seed``."""
    return attempts.withWatermark("ts", delay).groupBy("user_id", "mcq").transformWithState(_Boxes(seed, boxes), "user_id long, mcq long, reviews long, box long", "Update", "EventTime")


class _Windows(InOrder):
    waiting, kept = "ms long, tie long", "first long, n long"

    def __init__(self, seconds: int, most: int):
        self.ms, self.most = seconds * 1000, most

    def row(self, r: Row) -> tuple:
        return _ms(r.ts), r.event_id

    def take(self, key, rows, now) -> Iterator[Row]:
        first, n = tuple(self.state.get()) if self.state.exists() else (None, 0)
        out = {}
        for ms, _ in rows:
            if first is None or ms >= first + self.ms:
                first, n = ms, 0
            n += 1
            out[first] = n
        self.state.update((first, n))
        self.handle.registerTimer(first + self.ms)
        for start, count in out.items():
            yield Row(user_id=key[0], start=datetime.datetime.fromtimestamp(start / 1000, _UTC), n=count, refused=max(0, count - self.most))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from super().handleExpiredTimer(key, timerValues, expiredTimerInfo)
        # A window that is over is forgotten, unless a newer one has taken its place.
        if self.state.exists() and self.state.get()[0] + self.ms <= timerValues.getCurrentWatermarkInMs():
            self.state.clear()


def rate_windows_in_order(events: DataFrame, seconds: int = 3600, most: int = 2, delay: str = "10 minutes") -> DataFrame:
    """A streaming ``events`` (user_id, ts, event_id) -> user_id, start, n, refused of windows that begin with a reader's first event; those beyond ``most`` of a window are refused. Windows that are over leave the state."""
    return events.withWatermark("ts", delay).groupBy("user_id").transformWithState(_Windows(seconds, most), "user_id long, start timestamp, n long, refused long", "Update", "EventTime")
