"""Keyed state with event-time timers: submissions that complete once, held documents that are retried; T2, T6.

Steps (key, at, seq, kind) wait in list state until the watermark has passed them, so their order is that of
the events however they arrive within the lateness; a timer wakes a key for its first waiting step or
its retry time. What is emitted depends on the steps and the final watermark only, not on how the stream is
cut into batches. State is partitioned by key and restored from the checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

STEP = "at long, seq long, kind string"
STATE = "rounds int, done boolean, attempts int, due long, wake long"
OUT = "key long, at long, event string, number int"

#: The state store that keyed state needs.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Lifecycle(StatefulProcessor):
    """Rounds to completion, and retries of what is held.

    `round`: the rounds_max-th one completes the key, once. `fail`: a key that isn't held is held, and retried after each
    `window_us`, `retries` times at most. `settle` ends that. What is due at the time of a step comes before it.
    """

    def __init__(self, rounds_max: int, window_us: int, retries: int):
        self.rounds_max, self.window_us, self.retries = rounds_max, window_us, retries

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", STEP)
        self.state = handle.getValueState("state", STATE)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = [step for part in rows for step in part[["at", "seq", "kind"]].itertuples(index=False, name=None)]
        self.waiting.appendList([(int(at), int(seq), kind) for at, seq, kind in new])
        rounds, done, attempts, due, wake = self._load()
        self._save(rounds, done, attempts, due, wake, min(at for at, _, _ in new))
        yield from ()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000 + 999  # all microseconds of that millisecond
        rounds, done, attempts, due, _ = self._load()
        steps = sorted((int(s[0]), int(s[1]), s[2]) for s in self.waiting.get())
        ready, later = [s for s in steps if s[0] <= now], [s for s in steps if s[0] > now]
        out: list[tuple] = []
        for at, _, kind in [*ready, (now, 0, "")]:
            while due is not None and due <= at:
                attempts += 1
                out.append((key[0], due, "retry", attempts))
                due = due + self.window_us if attempts < self.retries else None
            if kind == "round" and not done:
                rounds += 1
                if rounds == self.rounds_max:
                    done = True
                    out.append((key[0], at, "completed", rounds))
            elif kind == "fail" and due is None:
                attempts, due = 0, at + self.window_us
            elif kind == "settle":
                due = None
        if ready:
            self.waiting.clear()
            if later:
                self.waiting.put(later)
        self._save(rounds, done, attempts, due, None, *(s[0] for s in later[:1]), *([] if due is None else [due]))
        if out:
            yield pd.DataFrame(out, columns=["key", "at", "event", "number"])

    def _load(self) -> tuple:
        s = self.state.get() if self.state.exists() else None
        return (0, False, 0, None, None) if s is None else (s[0], s[1], s[2], *(None if s[k] < 0 else s[k] for k in (3, 4)))

    def _save(self, rounds: int, done: bool, attempts: int, due: int | None, wake: int | None, *times: int) -> None:
        """State, with one timer for the earliest of what is to come; `wake` is the timer that is set."""
        first = min((t // 1000 for t in times), default=None)
        if first is not None and (wake is None or first < wake):
            if wake is not None:
                self.handle.deleteTimer(wake)
            self.handle.registerTimer(first)
            wake = first
        self.state.update((rounds, done, attempts, -1 if due is None else due, -1 if wake is None else wake))

    def close(self) -> None:
        pass


def lifecycle(steps: DataFrame, rounds_max: int = 7, window: str = "30 minutes", retries: int = 3, late: str = "10 minutes") -> DataFrame:
    """Events of a stream of steps (key long, at timestamp, seq long, kind): key, at, event (completed, retry), number.

    Steps that come later than `late` behind the latest are dropped. The session's state store must be the one named PROVIDER.
    """
    us = int(pd.Timedelta(window).total_seconds() * 1_000_000)
    rows = steps.withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", late).select("key", F.col("at").alias("event_time"), F.unix_micros("at").alias("at"), "seq", "kind")
    out = rows.groupBy("key").transformWithStateInPandas(Lifecycle(rounds_max, us, retries), OUT, outputMode="append", timeMode="EventTime")
    return out.select("key", F.timestamp_micros("at").alias("at"), "event", "number")


def run(steps: DataFrame, target: str, checkpoint: str, **options) -> StreamingQuery:
    """Append the events to Parquet; a run goes on where the checkpoint says that the last one stopped."""
    conf, name = steps.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name)
    conf.set(name, PROVIDER)
    try:
        return lifecycle(steps, **options).writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(target)
    finally:
        conf.set(name, before)
