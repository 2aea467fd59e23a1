"""Stateful processors that see each key's rows in event-time order.

Rows of a stream come in any order within the watermark's delay. A processor
that must not depend on it holds each row back in a map state until the
watermark has passed it, then takes the rows one by one, together with what
falls due in between (``due``), and asks for a timer at the next of either. So
the result is that of a fold over the sorted rows, however they were cut into
batches; rows behind the watermark are dropped by Spark before they come here.
A key whose rows are done and for which nothing is due has no state left.
"""

from __future__ import annotations

from abc import abstractmethod
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StatefulProcessor

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def ready(spark: SparkSession) -> None:
    """What processors with timers and map states need of the session."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def micros(t) -> int:
    """Microseconds since 1970 of a timestamp in the session's zone (UTC)."""
    import datetime
    return round((t.replace(tzinfo=datetime.timezone.utc) - datetime.datetime(1970, 1, 1, tzinfo=datetime.timezone.utc)) / datetime.timedelta(microseconds=1))


def moment(us: int):
    import datetime
    return datetime.datetime(1970, 1, 1) + datetime.timedelta(microseconds=us)


class Ordered(StatefulProcessor):
    """State per key: ``held`` (time and tie-breaker to the rest of a row) and
    ``now``, whatever the fold carries along."""

    #: Schemas of a held row (besides its time and tie) and of the fold's state.
    row = ""
    state = ""

    @abstractmethod
    def take(self, key, us: int, row: tuple, now: tuple | None) -> tuple[tuple | None, list[dict]]:
        """The state after a row, and what to put out."""

    def due(self, now: tuple) -> int | None:
        """When something happens to the state by itself, in microseconds."""
        return None

    def lapse(self, key, us: int, now: tuple) -> tuple[tuple | None, list[dict]]:
        return now, []

    def begin(self, key) -> None:
        """Before a key's rows are taken."""

    @abstractmethod
    def read(self, row) -> tuple[int, int, tuple]:
        """(microseconds, tie, rest) of an input row."""

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "us long, tie long", self.row)
        self.now = handle.getValueState("now", self.state)
        self.asked = handle.getValueState("asked", "ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        for r in rows:
            us, tie, rest = self.read(r)
            self.held.updateValue((us, tie), rest)
        yield from self._advance(key, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        if self.asked.exists() and self.asked.get()[0] == expiredTimerInfo.getExpiryTimeInMs():
            self.asked.clear()
        yield from self._advance(key, timerValues)

    def _advance(self, key, timerValues) -> Iterator:
        from pyspark.sql import Row
        limit = timerValues.getCurrentWatermarkInMs() * 1000
        now = tuple(self.now.get()) if self.now.exists() else None
        was, later = now, None
        self.begin(key)
        rows = sorted((tuple(k), tuple(v)) for k, v in self.held.iterator()) if self.held.exists() else []
        for (us, tie), rest in [*rows, ((None, None), None)]:
            while now is not None and (d := self.due(now)) is not None and d <= limit and (us is None or d < us):
                now, out = self.lapse(key, d, now)
                yield from (Row(**o) for o in out)
            if us is None or us > limit:
                later = us
                break
            self.held.removeKey((us, tie))
            self.tie = tie
            now, out = self.take(key, us, rest, now)
            yield from (Row(**o) for o in out)
        if now is None and was is not None:
            self.now.clear()
        elif now is not None and now != was:
            self.now.update(now)
        own = self.due(now) if now is not None else None
        self._ask([-(-x // 1000) for x in (later, own) if x is not None])

    def _ask(self, times: list[int]) -> None:
        """One timer a key: the earliest."""
        asked = self.asked.get()[0] if self.asked.exists() else None
        want = min(times, default=None)
        if asked == want:
            return
        if asked is not None:
            self.handle.deleteTimer(asked)
            self.asked.clear()
        if want is not None:
            self.handle.registerTimer(want)
            self.asked.update((want,))

    def close(self) -> None:
        pass
