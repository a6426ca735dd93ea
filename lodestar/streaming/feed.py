"""What goes on in the streams, as it happens: a feed of events and the lag of their sources, from Spark's own progress reports."""

from __future__ import annotations

import json
import threading
import time
from collections import deque
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from .pipelines import lag_of


class Feed:
    """The last events (dicts), numbered. Readers come back with the number that they have; who is slow misses what has gone, and nobody waits. At most `rate` events a second are kept, others are only counted."""

    def __init__(self, keep: int = 4096, rate: float = 200.0, clock: Callable[[], float] = time.monotonic):
        self._events: deque[tuple[int, dict]] = deque(maxlen=keep)
        self._lock, self._clock = threading.Condition(), clock
        self._rate, self._left, self._last = rate, rate, clock()
        self.number = self.dropped = 0

    def publish(self, event: dict) -> bool:
        with self._lock:
            now = self._clock()
            self._left = min(self._rate, self._left + (now - self._last) * self._rate)
            self._last = now
            if self._left < 1:
                self.dropped += 1
                return False
            self._left -= 1
            self.number += 1
            self._events.append((self.number, event))
            self._lock.notify_all()
            return True

    def since(self, number: int = 0, wait_s: float = 0.0) -> list[tuple[int, dict]]:
        """The events after a number, oldest first; waits for one if there is none yet."""
        with self._lock:
            if wait_s:
                self._lock.wait_for(lambda: self.number > number, wait_s)
            return [x for x in self._events if x[0] > number]


class Reporter(StreamingQueryListener):
    """Publishes each query's starts, batches and ends to a feed, and keeps the lag of its topics; lag: called with (topic, lag) pairs after each batch."""

    def __init__(self, feed: Feed, lag: Callable[[list[tuple[str, int]]], None] | None = None):
        self.feed, self._sink = feed, lag
        self.lag: dict[str, int] = {}

    def onQueryStarted(self, event):
        self.feed.publish({"type": "started", "query": str(event.id), "name": event.name})

    def onQueryProgress(self, event):
        p = event.progress
        self.feed.publish({"type": "batch", "query": str(p.id), "batch": p.batchId, "rows": p.numInputRows})
        self.seen(json.loads(p.json))

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self.feed.publish({"type": "ended", "query": str(event.id), "error": event.exception})

    def seen(self, progress: dict) -> None:
        now: dict[str, int] = {}
        for topic, _, latest, committed in lag_of(progress):
            if latest >= 0 and committed >= 0:
                now[topic] = now.get(topic, 0) + max(0, latest - committed)
        self.lag |= now
        if now and self._sink:
            self._sink(sorted(now.items()))


def sampled(feed: Feed, changed: DataFrame, batch: int, most: int = 5) -> None:
    """Publishes a batch's first changes by id, most of them at the most."""
    for r in changed.select("id", "version", "deleted", F.substring("title", 1, 90).alias("title")).orderBy("id").limit(most).collect():
        feed.publish({"type": "document", "batch": batch} | r.asDict())
