"""Asking services as a stream: what is still to be asked, how often a service has refused and whether it is asked at all are state.

Citations arrive under the name of a service, which is the key. They wait in its queue; a timer paces the requests, and each time it goes off the
first ones are asked. A citation that gets no answer goes to the end of the queue until it has been asked often enough; a service that
refuses ``give_up`` times in a row is asked no more, and all that wait are answered ``skipped``. A citation is taken once, however often
it arrives. All that is kept in the state store: after a restart from the checkpoint the stream goes on where its last
batch ended, and what was answered is not asked again.

Needs the state store that keeps several states a key: ``spark.sql.streaming.stateStore.providerClass`` = ``PROVIDER``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ANSWER = "service string, ref_id string, status string, pos int, body string"
_WAITING = "ref_id string, title string, authors array<string>, tries int"
_SERVICE = "first long, next long, refused int, closed boolean, awake boolean"

#: (status, bodies) of a question; the status of an answer is empty.
Fetch = Callable[[str, list[str]], tuple[str, list[str]]]


def _answer(service: str, ref: str, status: str, pos: int = 0, body: str | None = None) -> Row:
    return Row(service=service, ref_id=ref, status=status, pos=pos, body=body)


class Asking(StatefulProcessor):
    """One service's queue, breaker and timer."""

    def __init__(self, fetch: Mapping[str, Fetch], pace_ms: int, at_a_time: int, tries: int, give_up: int) -> None:
        self.fetch, self.pace_ms, self.at_a_time, self.tries, self.give_up = fetch, pace_ms, at_a_time, tries, give_up

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "place long", _WAITING)
        self.taken = handle.getMapState("taken", "ref_id string", "taken boolean")
        self.service = handle.getValueState("service", _SERVICE)

    def _now(self) -> list:
        return list(self.service.get()) if self.service.exists() else [0, 0, 0, False, False]

    def _sleep(self, now: list, timers: Any) -> None:
        if not now[4]:
            self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.pace_ms)
            now[4] = True

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        now = self._now()
        for r in rows:
            if self.taken.containsKey((r["ref_id"],)):
                continue
            self.taken.updateValue((r["ref_id"],), (True,))
            if now[3]:
                yield _answer(key[0], r["ref_id"], "skipped")
                continue
            self.waiting.updateValue((now[1],), (r["ref_id"], r["title"], list(r["authors"] or []), 0))
            now[1] += 1
        if now[0] < now[1]:
            self._sleep(now, timerValues)
        self.service.update(tuple(now))

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        now = self._now()
        now[4] = False
        for _ in range(self.at_a_time):
            if now[0] >= now[1]:
                break
            ref, title, authors, tries = self.waiting.getValue((now[0],))
            self.waiting.removeKey((now[0],))
            now[0] += 1
            try:
                status, bodies = self.fetch[key[0]](title, list(authors))
            except Exception:  # noqa: BLE001 - whatever it is, it is this citation's answer
                status, bodies = "error", []
            now[2] = now[2] + 1 if status == "rate_limited" else 0
            if status in ("rate_limited", "timeout") and tries + 1 < self.tries:
                self.waiting.updateValue((now[1],), (ref, title, list(authors), tries + 1))
                now[1] += 1
            else:
                for pos, body in enumerate(bodies or [None]):
                    yield _answer(key[0], ref, status, pos, body)
            if now[2] >= self.give_up:
                now[3] = True
                for place in range(now[0], now[1]):
                    yield _answer(key[0], self.waiting.getValue((place,))[0], "skipped")
                    self.waiting.removeKey((place,))
                now[0] = now[1]
        if now[0] < now[1]:
            self._sleep(now, timerValues)
        self.service.update(tuple(now))

    def close(self) -> None:
        pass


def ask(pending: DataFrame, fetch: Mapping[str, Fetch], pace_ms: int = 1000, at_a_time: int = 1, tries: int = 3, give_up: int = 25) -> DataFrame:
    """``ANSWER`` rows for a stream of citations (service, ref_id, title, authors): what ``backends.candidates`` reads."""
    asking = Asking(fetch, pace_ms, at_a_time, tries, give_up)
    return pending.groupBy("service").transformWithState(asking, ANSWER, "Append", "ProcessingTime")
