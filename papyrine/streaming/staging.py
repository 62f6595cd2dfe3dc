"""Staged uploads: a session is created, files are added, a plan is made and confirmed, as a state machine over a stream of events.

State is kept for each session by Spark and survives a restart from the checkpoint.  Events of a session are applied in the order of their
time within a batch, whose rows of one session are held together (``maxFilesPerTrigger`` bounds them); an event that comes in a later batch although it is older is applied when it comes, if the session's status allows it.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from papyrine.sources.session import ship_package

OUT = "session string, status string, files bigint, bytes bigint, planned bigint, reason string"
COLUMNS = [c.split()[0] for c in OUT.split(", ")]
#: States in which a session takes events, holds files and may expire.
OPEN = ("created", "planned")
STATE = "status string, planned bigint, last bigint"
FILE = "bytes bigint"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Staging(StatefulProcessor):
    """created → planned → confirmed; an add takes a plan back; what does not fit gives a row with its reason."""

    def __init__(self, idle_s: float) -> None:
        self.idle_ms = int(idle_s * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("session", STATE)
        self.files = handle.getMapState("files", "name string", FILE)

    def _files(self) -> dict[str, int]:
        return {k[0]: v[0] for k, v in self.files.iterator()}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # each call to the state is a message to the JVM: a batch reads a session's state once, and writes what it changed
        (session,) = key
        before = self.state.get() if self.state.exists() else ("none", 0, 0)
        status, planned, last = before
        was_open = status in OPEN
        kept = self._files() if was_open else {}
        files, size = dict(kept), sum(kept.values())
        out = []

        def told(status: str, reason: str) -> None:
            out.append((session, status, len(files), size, planned, reason))

        events = dict.fromkeys(e for f in rows for e in zip(f["ts"].astype("datetime64[us]").astype("int64").tolist(), f["action"].tolist(), f["name"].tolist(), f["bytes"].tolist(), strict=True))
        for ts, action, name, n in sorted(events, key=lambda e: e[:3]):
            reason = None
            if action == "create":
                if status in ("none", "expired"):
                    status, planned, size = "created", 0, 0
                    files.clear()
                elif status == "confirmed":
                    reason = "session was confirmed"
            elif status not in OPEN:
                reason = "session was confirmed" if status == "confirmed" else "no such session"
            elif action == "add":
                if files.get(name) != n:
                    size += int(n) - files.get(name, 0)
                    files[name] = int(n)
                    status, planned = "created", 0
            elif action == "plan":
                status, planned, reason = ("planned", len(files), None) if files else (status, planned, "nothing to plan")
            elif action == "confirm":
                if status == "planned":
                    status = "confirmed"
                    told(status, "")
                    files.clear()
                    size = 0
                else:
                    reason = "no plan"
            else:
                reason = f"unknown action {action}"
            if reason:
                told("refused", reason)
            last = max(last, ts // 1000)
        if (status, planned, last) != tuple(before):
            self.state.update((status, planned, last))
        if kept and not files:
            self.files.clear()
        for name, n in files.items():
            if kept.get(name) != n:
                self.files.updateValue((name,), (n,))
        if was_open:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
        if status in OPEN:
            self.handle.registerTimer(last + self.idle_ms)
        if out:
            yield pd.DataFrame(out, columns=COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        (session,) = key
        status, planned, last = self.state.get() if self.state.exists() else ("none", 0, 0)
        if status in OPEN:
            sizes = self._files().values()
            yield pd.DataFrame([(session, "expired", len(sizes), sum(sizes), planned, "no event for too long")], columns=COLUMNS)
            self.state.update(("expired", 0, last))
            self.files.clear()

    def close(self) -> None:
        pass


@contextmanager
def rocks_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB; the session's own choice comes back after."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def staged(events: DataFrame, *, delay: str = "1 hour", idle_s: float = 86_400.0) -> DataFrame:
    """Rows of ``OUT`` from a stream of (session, action, name, bytes, ts): confirmed sessions, refused events and expired sessions.

    A file added again with the same size changes nothing, equal rows of one batch count once; with another size, or with a new file, a plan is taken back.  A session without an
    event for ``idle_s`` seconds behind the watermark expires.  Nothing follows a confirmation but refusals.  To be started within ``rocks_state``.
    """
    ship_package(events.sparkSession)
    given = events.select("session", "action", "name", "bytes", "ts").where("session is not null and action is not null and ts is not null").fillna({"name": "", "bytes": 0})
    return given.withWatermark("ts", delay).groupBy("session").transformWithStateInPandas(statefulProcessor=Staging(idle_s), outputStructType=OUT, outputMode="Append", timeMode="EventTime")
