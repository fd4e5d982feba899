"""Giving up input that a stream has consumed, while it runs.

Spark plans a micro-batch only when its predecessor is committed, and starts it where that one ended. What
lies before the start of a reported batch is therefore in the tables and never read again, not even after a
crash, which repeats that batch from the same start. The floor of each partition only rises; a partition
that is quiet keeps the floor of the last batch that read it.

Landed files are deleted by Spark itself (``raw.raw_source(retain=False)``). For a broker the floor comes from
the progress of the query, and a function deletes the records below it.
"""

from __future__ import annotations

import json
import logging
import time
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQueryListener

log = logging.getLogger(__name__)

Floor = dict[tuple[str, int], int]
# Fixed value: seconds between deletions.
INTERVAL_SECONDS = 300
TIMEOUT_SECONDS = 30


def starts_of(progress) -> Floor:
    """First offset that the reported batch read of each partition; empty for sources without such offsets
    and for a first batch."""
    found: Floor = {}
    for source in progress.sources:
        try:
            start = json.loads(source.startOffset or "null")
        except ValueError:
            continue
        if not isinstance(start, dict):
            continue
        for topic, partitions in start.items():
            if isinstance(partitions, dict):
                found |= {(topic, int(p)): int(offset) for p, offset in partitions.items()}
    return found


class Retention(StreamingQueryListener):
    """Calls ``delete`` with the floor of a query's partitions, at most once in ``interval`` seconds. A failure
    is logged and tried again with the next batch: it never stops the stream."""

    def __init__(self, delete: Callable[[Floor], None], query_id: str | None = None, interval: float = INTERVAL_SECONDS):
        self.delete, self.query_id, self.interval = delete, query_id, interval
        self.floor: Floor = {}
        self._done: Floor = {}
        self._last: float | None = None

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        if self.query_id in (None, str(event.progress.id)):
            self.note(starts_of(event.progress))

    def note(self, starts: Floor) -> None:
        for partition, offset in starts.items():
            self.floor[partition] = max(offset, self.floor.get(partition, 0))
        risen = {p: o for p, o in self.floor.items() if o > self._done.get(p, 0)}
        now = time.monotonic()
        if not risen or (self._last is not None and now - self._last < self.interval):
            return
        try:
            self.delete(risen)
        except Exception:  # noqa: BLE001 - the records stay until the next batch
            log.warning("consumed records not deleted", exc_info=True)
            return
        self._last = now
        self._done |= risen


def kafka_delete(spark: SparkSession, bootstrap: str) -> Callable[[Floor], None]:
    """Deletes records of Kafka topics through the broker's admin client, which comes with the connector."""
    def delete(floor: Floor) -> None:
        jvm = spark.sparkContext._jvm
        settings = jvm.java.util.Properties()
        settings.put("bootstrap.servers", bootstrap)
        kafka = jvm.org.apache.kafka
        wanted = jvm.java.util.HashMap()
        for (topic, partition), offset in floor.items():
            wanted.put(kafka.common.TopicPartition(topic, partition), kafka.clients.admin.RecordsToDelete.beforeOffset(offset))
        client = kafka.clients.admin.AdminClient.create(settings)
        try:
            client.deleteRecords(wanted).all().get(TIMEOUT_SECONDS, jvm.java.util.concurrent.TimeUnit.SECONDS)
        finally:
            client.close()
    return delete


def attach(spark: SparkSession, delete: Callable[[Floor], None], query_id: str | None = None,
           interval: float = INTERVAL_SECONDS) -> Retention:
    """Follow a query (all queries without an id) from now on."""
    listener = Retention(delete, query_id, interval)
    spark.streams.addListener(listener)
    return listener
