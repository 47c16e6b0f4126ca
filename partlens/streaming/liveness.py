"""X03 live: cameras as they come and go, from keyed state with event-time timers.

State is a camera's spells that are not over yet: first and last event and whether ON was reported; events that no spell
is far from extend it, so however many events come, a camera's state is as large as the spells within the watermark's
delay and one silence. A timer stands at the next moment at which something becomes certain.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from partlens.functions.times import interval_micros

CHANGES = "camera_id long, at timestamp, state string"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def merge_spells(spells: list[tuple[int, int, bool]], times: np.ndarray, silence: int) -> list[tuple[int, int, bool]]:
    """Spells (first, last, reported) with further events; an event ``silence`` after a spell's last one starts another."""
    times = np.unique(times)
    cut = np.flatnonzero(np.diff(times) >= silence) + 1
    fresh = [(int(t[0]), int(t[-1]), False) for t in np.split(times, cut) if len(t)]
    out: list[tuple[int, int, bool]] = []
    for first, last, told in sorted([*spells, *fresh]):
        if out and first < out[-1][1] + silence:
            out[-1] = (out[-1][0], max(out[-1][1], last), out[-1][2] or told)
        else:
            out.append((first, last, told))
    return out


class Liveness(StatefulProcessor):
    """With ``settled`` ON comes out once the watermark has passed the spell's first event, so no late event can move it; else
    with the micro-batch that brings the event."""

    def __init__(self, silence: int, settled: bool):
        self.silence, self.settled = silence, settled

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.spells = handle.getValueState("spells", "first array<long>, last array<long>, told array<boolean>")

    def _held(self) -> list[tuple[int, int, bool]]:
        got = self.spells.get() if self.spells.exists() else None
        return list(zip(*got, strict=True)) if got else []

    def _report(self, key: tuple, spells: list[tuple[int, int, bool]], now: int) -> Iterator[pd.DataFrame]:
        """What is certain at the watermark ``now`` (milliseconds), in order; the rest stays, with a timer for the next."""
        out, kept, due = [], [], []
        reached = lambda micros: -(-micros // 1000) <= now
        for first, last, told in spells:
            if not told and (not self.settled or reached(first)):
                out.append((first, "ON"))
                told = True
            if told and reached(last + self.silence):
                out.append((last + self.silence, "OFF"))
            else:
                kept.append((first, last, told))
                due.append(last + self.silence if told else first)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if kept:
            self.spells.update(tuple(list(c) for c in zip(*kept, strict=True)))
            self.handle.registerTimer(-(-min(due) // 1000))
        elif self.spells.exists():
            self.spells.clear()
        if out:
            yield pd.DataFrame({"camera_id": key[0], "micros": [t for t, _ in out], "state": [s for _, s in out]})

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        spells = self._held()
        for batch in rows:
            spells = merge_spells(spells, batch["micros"].to_numpy(), self.silence)
        yield from self._report(key, spells, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        yield from self._report(key, self._held(), timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def live_changes(events: DataFrame, silence: str = "20 minutes", settled: bool = True) -> DataFrame:
    """camera_id, at, state of a stream with a watermark: ON when a camera's first event after a silence comes, OFF by a timer
    ``silence`` after its last one. Append mode; rows are those of ``camera_liveness`` that the watermark has reached.

    Events without a camera or a time have no part. The session must keep state in RocksDB (``PROVIDER``).
    """
    # moments go as numbers, as times in Python would be those of the session's time zone
    given = events.where("camera_id IS NOT NULL AND ts IS NOT NULL").select("camera_id", "ts", F.unix_micros("ts").alias("micros"))
    out = given.groupBy("camera_id").transformWithStateInPandas(Liveness(interval_micros(silence), settled), "camera_id long, micros long, state string", "Append", "EventTime")
    return out.select("camera_id", F.timestamp_micros("micros").alias("at"), "state")
