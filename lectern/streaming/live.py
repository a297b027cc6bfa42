"""Answers that are kept for a time: fresh, cached, stale, gone.

A request of a key asks its source unless the last good answer is younger than
``TTL``. A good answer is ``fresh`` and kept; where the source fails, the last good
answer serves as ``stale`` up to ``MOST_STALE``, and the request ``failed`` beyond.
Two event-time timers follow a good answer: it has ``expired`` after ``TTL``, and is
``gone`` after ``MOST_STALE`` unless a newer one came, which clears the key's state,
so keys that nobody asks for leave the store. A key sets one timer at a time, for
the first of what is pending; when it fires, all that the watermark has passed is
said, so what a key asks of the state store does not grow with its requests.

Timers fire when the watermark passes them, which may be after later requests of
the same batch; requests therefore compare times themselves, and what is said does
not depend on how the stream was cut into batches. Requests of a key are taken in
order of time, then id, within a batch, which one task holds: bound the batch by the
source's own option where a key is hot. Late requests are dropped by the watermark.
Null keys are a key; null times are never in time and left out.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Seconds for which an answer is cached, and for which it may serve as stale.
TTL, MOST_STALE = 3600, 6 * 3600
#: How far the watermark stays behind.
DELAY = "10 minutes"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LiveAnswers(StatefulProcessor):
    """State: when the last good answer came (ms) and what it was, and the times (ms)
    at which answers will have expired and be gone."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._last = handle.getValueState("last", "ms bigint, value double")
        self._expiring = handle.getValueState("expiring", "at array<bigint>")
        self._going = handle.getValueState("going", "at array<bigint>")

    def _pending(self) -> tuple[list[int], list[int]]:
        """Times of answers that will have expired, and that will be gone, ascending."""
        expiring, going = self._expiring.get(), self._going.get()
        return list(expiring[0]) if expiring else [], list(going[0]) if going else []

    def _keep(self, expiring: list[int], going: list[int], before: int | None) -> None:
        """Keep what is pending; ``before`` is the timer that is set."""
        for state, at in ((self._expiring, expiring), (self._going, going)):
            state.update((at,)) if at else state.clear()
        first = min(expiring[:1] + going[:1], default=None)
        if first != before:
            if before is not None:
                self._handle.deleteTimer(before)
            if first is not None:
                self._handle.registerTimer(first)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        last = self._last.get()
        held = before = tuple(last) if last else None
        expiring, going = [], []
        for r in sorted(rows, key=lambda r: (r["ms"], r["event_id"])):
            now, value = r["ms"], None
            age = None if held is None else now - held[0]
            usable = age is not None and age <= MOST_STALE * 1000
            if usable and age < TTL * 1000:
                said, value = "cached", held[1]
            elif r["ok"]:
                if held is before:
                    expiring, going = self._pending()
                    timer = min(expiring[:1] + going[:1], default=None)
                if usable:
                    going.remove(held[0] + MOST_STALE * 1000 + 1)
                said, value, held = "fresh", r["value"], (now, r["value"])
                expiring.append(now + TTL * 1000)
                going.append(now + MOST_STALE * 1000 + 1)
            elif usable:
                said, value = "stale", held[1]
            else:
                said = "failed"
            yield Row(key=key[0], ms=now, event_id=r["event_id"], said=said, value=value)
        if held is not before:
            self._last.update(held)
            self._keep(expiring, going, timer)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed, (expiring, going) = timerValues.getCurrentWatermarkInMs(), self._pending()
        for said, times in (("expired", expiring), ("gone", going)):
            for at in times:
                if at <= passed:
                    yield Row(key=key[0], ms=at, event_id=None, said=said, value=None)
        # Spark itself drops the timer that fired
        self._keep([at for at in expiring if at > passed], left := [at for at in going if at > passed], None)
        last = self._last.get()
        if last and last[0] + MOST_STALE * 1000 + 1 not in left:
            self._last.clear()

    def close(self) -> None:
        pass


def live_answers(events: DataFrame) -> DataFrame:
    """user_id, ms, event_id, said, value for every request of a stream of events (an
    ``error`` is a failure of the source) and for every timer that fired."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    at = F.col("ts").cast("timestamp")
    rows = events.where("ts is not null").select("user_id", "event_id", "value", at.alias("at"), F.unix_millis(at).alias("ms"), (F.col("event_type") != "error").alias("ok"))
    said = rows.withWatermark("at", DELAY).groupBy("user_id").transformWithState(LiveAnswers(), "key bigint, ms bigint, event_id bigint, said string, value double", "append", "eventTime")
    return said.withColumnRenamed("key", "user_id")
