"""Where each document stands, as a stream: pending, extracted, to be tried again, failed. State and a timer per document.

Events are (announcement_id, event, at): "listed", "extracted" or "failed". A first failure waits for ``retry_after`` of event time
and makes the document pending once more; the failure after that is final. An extraction ends all waiting, and what comes
after it, or out of turn, changes nothing; so a repeat of events changes nothing either.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.store import Store

PENDING, EXTRACTED, RETRY, FAILED = "pending", "extracted", "retry", "failed"
EVENTS = "announcement_id string, event string, at timestamp"
CHANGES = "announcement_id string, state string, attempts int, changed_at timestamp"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def after_event(state: str | None, attempts: int, event: str, most: int) -> tuple[str | None, int]:
    """The state machine's step: state and failed attempts after an event."""
    if event == "listed":
        return state or PENDING, attempts
    if state == EXTRACTED or event == "extracted":
        return EXTRACTED, attempts
    if event == "failed" and state in (None, PENDING):
        return (RETRY if attempts + 1 < most else FAILED), attempts + 1
    return state, attempts


class DocumentStates(StatefulProcessor):
    def __init__(self, retry_ms: int, most: int):
        self.retry_ms, self.most = retry_ms, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "state string, attempts int")

    def _now(self) -> tuple[str | None, int]:
        return tuple(self.held.get()) if self.held.exists() else (None, 0)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        for row in sorted(rows, key=lambda r: (r.at, r.event)):
            before = self._now()
            after = after_event(*before, row.event, self.most)
            if after == before:
                continue
            self.held.update(after)
            if before[0] == RETRY:
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)
            if after[0] == RETRY:
                self.handle.registerTimer(int(row.at.timestamp() * 1000) + self.retry_ms)
            yield Row(announcement_id=key[0], state=after[0], attempts=after[1], changed_at=row.at)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:
        state, attempts = self._now()
        if state == RETRY:
            self.held.update((PENDING, attempts))
            due = datetime.fromtimestamp(expiredTimerInfo.getExpiryTimeInMs() / 1000, UTC).replace(tzinfo=None)
            yield Row(announcement_id=key[0], state=PENDING, attempts=attempts, changed_at=due)

    def close(self) -> None:
        pass


def document_states(events: DataFrame, retry_after: str = "1 hour", most: int = 2, delay: str = "0 seconds") -> DataFrame:
    """The changes of state that a stream of events makes."""
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)  # what state with timers needs
    seconds = spark.sql(f"SELECT unix_micros(TIMESTAMP '1970-01-01 00:00:00' + INTERVAL {retry_after}) - unix_micros(TIMESTAMP '1970-01-01 00:00:00')").first()[0] // 1000
    timed = events.select("announcement_id", "event", "at").where("announcement_id IS NOT NULL AND at IS NOT NULL").withWatermark("at", delay)
    return timed.groupBy("announcement_id").transformWithState(DocumentStates(int(seconds), most), CHANGES, "Update", "EventTime")


def follow(spark: SparkSession, folder: str, checkpoint: str, store: Store, retry_after: str = "1 hour", every: str | None = None) -> object:
    """States of event files, kept in the store's ``document_states`` and in the documents' extraction_status; a repeated batch converges."""

    def one(batch: DataFrame, number: int) -> None:
        owner = f"states-{number}"
        try:
            rows = store.stage(batch.withColumn("place", F.struct("changed_at", "attempts", F.col("state") != RETRY)), owner)
            if rows.isEmpty():
                return
            store.upsert("document_states", rows, "place")
            newest = rows.groupBy("announcement_id").agg(F.max_by("state", "place").alias("status"))
            store.mark_statuses(newest.withColumn("status", F.when(F.col("status") == RETRY, FAILED).otherwise(F.col("status"))))
        finally:
            store.unstage(owner)

    trigger = {"processingTime": every} if every else {"availableNow": True}
    changes = document_states(spark.readStream.schema(EVENTS).json(folder), retry_after)
    return changes.writeStream.outputMode("update").foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**trigger).start()
