"""Tasks of services that answer later, as state of a stream: what is polled waits in a timer, not in a task.

track() follows tasks whose states arrive as rows, and gives up on one that has not ended in time. poll()
starts a task for each request and asks for its state at intervals; the state is kept by Spark, and with a
ledger each answer also as soon as it is given, so that neither a restart nor a batch that is run again
starts a task twice. Both need the RocksDB state store: see with_state().
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.stores import Ledger

TRACKED = "task string, started_at timestamp, finished_at timestamp, looks long, outcome string"
POLLED = "task string, payload string, error string, looks long"


def available() -> bool:
    """Spark talks to such state by protocol buffers, for which it asks a package."""
    try:
        import google.protobuf  # noqa: F401
    except ImportError:
        return False
    return True


def with_state(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Tracker(StatefulProcessor):
    def __init__(self, final: Mapping[str, str], limit: float):
        self.final, self.limit = dict(final), round(limit * 1e6)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.task = handle, handle.getValueState("task", "started long, looks long, outcome string")

    def ended(self, key, started: int, finished: int, looks: int, outcome: str) -> Row:
        return Row(task=key[0], started=started, finished=finished, looks=looks, outcome=outcome)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        started, looks, outcome = self.task.get() if self.task.exists() else (None, 0, None)
        for r in sorted(rows, key=lambda r: r.us):
            if started is None:
                started = r.us
                self.handle.registerTimer((started + self.limit) // 1000)
            if outcome is None and r.us <= started + self.limit:
                looks += 1
                if r.state in self.final:
                    outcome = self.final[r.state]
                    yield self.ended(key, started, r.us, looks, outcome)
        self.task.update((started, looks, outcome))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        started, looks, outcome = self.task.get()
        self.task.clear()
        if outcome is None:
            yield self.ended(key, started, started + self.limit, looks, "expired")

    def close(self) -> None:
        pass


def track(states: DataFrame, final: Mapping[str, str], limit: float, late: str = "0 seconds") -> DataFrame:
    """TRACKED of streaming states (task, at, state): one row for each task that has ended.

    A task starts with its first row. The first row whose state is in final ends it with that outcome; without one
    within limit seconds a timer ends it as expired once the stream's time has passed. Rows after the end
    are not looked at until then, and start the task anew after it.
    """
    s = states.withWatermark("at", late).select("at", "task", "state", F.unix_micros("at").alias("us"))
    found = s.groupBy("task").transformWithState(Tracker(final, limit), "task string, started long, finished long, looks long, outcome string", "append", "EventTime")
    return found.select("task", F.timestamp_micros("started").alias("started_at"), F.timestamp_micros("finished").alias("finished_at"), "looks", "outcome")


class Poller(StatefulProcessor):
    def __init__(self, start: Callable[[str], dict], refresh: Callable[[dict], dict], every: float, looks: int, ledger: str | None, keep: float):
        self.start, self.refresh, self.every, self.looks, self.keep = start, refresh, round(every * 1000), looks, round(keep * 1000)
        self.ledger = Ledger(ledger) if ledger else None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.task = handle, handle.getValueState("task", "state string, looks long", self.keep)

    def noted(self, key: str, ask: Callable[[], dict]) -> dict:
        known = self.ledger.get(key) if self.ledger else None
        if known is None:
            known = ask()
            if self.ledger:
                self.ledger.put(key, known)
        return known

    def looked(self, key, state: dict, looks: int, now: int) -> Iterator[Row]:
        """After an answer: the end, or a look later."""
        self.task.update((json.dumps(state), looks))
        if state.get("completed"):
            yield Row(task=key[0], payload=json.dumps(state), error=None, looks=looks)
        elif looks >= self.looks:
            yield Row(task=key[0], payload=None, error="not completed", looks=looks)
        else:
            self.handle.registerTimer(now + self.every)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        if not self.task.exists():
            request = min(r.request or "" for r in rows)
            yield from self.looked(key, self.noted(f"{key[0]}\n0", lambda: self.start(request)), 0, timerValues.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.task.exists():
            state, looks = self.task.get()
            yield from self.looked(key, self.noted(f"{key[0]}\n{looks + 1}", lambda: self.refresh(json.loads(state))), looks + 1, timerValues.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        pass


def poll(requests: DataFrame, start: Callable[[str], dict], refresh: Callable[[dict], dict], every: float = 1.0, looks: int = 600, ledger: str | None = None, keep: float = 86_400.0) -> DataFrame:  # noqa: E501
    """POLLED of streaming requests (task, request): the state of each task once it is completed, or an error after so many looks.

    A task that is requested again within keep seconds is not started again.
    """
    return requests.select("task", "request").groupBy("task").transformWithState(Poller(start, refresh, every, looks, ledger, keep), POLLED, "append", "ProcessingTime")


def run_through(found: DataFrame, folder: str) -> DataFrame:
    """All that a stream of what is there by now gives, written to folder."""
    q = found.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return found.sparkSession.read.schema(found.schema).parquet(f"{folder}/rows")
