"""Staged upload sessions over a stream of files, with a restart between batches."""

import pandas as pd

from papyrine.sources.workdir import work_folder
from papyrine.streaming.staging import Staging, rocks_state, staged

SCHEMA = "session string, action string, name string, bytes bigint, ts timestamp"


def test_sessions_over_a_restart(spark):
    source, target, progress = (work_folder(spark, n) for n in ("uploads", "sessions", "progress"))

    def batch(*rows):
        spark.createDataFrame([(s, a, n, b, t) for s, a, n, b, t in rows], "session string, action string, name string, bytes bigint, ts string").selectExpr("session", "action", "name", "bytes", "cast(ts as timestamp) as ts").coalesce(1).write.mode("append").parquet(source)
        stream = staged(spark.readStream.schema(SCHEMA).parquet(source), idle_s=3600)  # a new query each time: state comes from the checkpoint
        with rocks_state(spark):
            stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.session, r.status, r.files, r.bytes, r.planned, r.reason) for r in spark.read.parquet(target).collect())

    t = "2024-01-01 10:00:0{}"
    got = batch(
        ("a", "create", None, None, t.format(0)), ("a", "plan", None, None, t.format(3)), ("a", "add", "x", 5, t.format(1)), ("a", "add", "x", 5, t.format(1)), ("a", "add", "y", 7, t.format(2)),  # out of order, and one twice
        ("b", "add", "x", 1, t.format(0)), ("c", "create", None, None, t.format(0)), ("c", "confirm", None, None, t.format(1)), ("d", "create", None, None, t.format(0)), ("d", "add", "z", 2, t.format(1)),
    )
    assert got == [("b", "refused", 0, 0, 0, "no such session"), ("c", "refused", 0, 0, 0, "no plan")]
    got = batch(("a", "confirm", None, None, t.format(5)), ("c", "plan", None, None, t.format(4)), ("d", "plan", None, None, t.format(2)), ("d", "add", "z", 3, t.format(3)), ("d", "confirm", None, None, t.format(4)))
    assert ("a", "confirmed", 2, 12, 2, "") in got and ("c", "refused", 0, 0, 0, "nothing to plan") in got and ("d", "refused", 1, 3, 0, "no plan") in got
    got = batch(("a", "add", "late", 1, t.format(1)), ("a", "create", None, None, t.format(6)), ("e", "create", None, None, "2024-01-02 10:00:00"))
    assert got.count(("a", "refused", 0, 0, 2, "session was confirmed")) == 2
    got = batch(("e", "add", "x", 1, "2024-01-02 10:10:00"), ("f", "jump", None, None, "2024-01-02 10:10:00"))
    assert {(r[0], r[1]) for r in got} >= {("c", "expired"), ("d", "expired")} and ("e", "expired") not in {(r[0], r[1]) for r in got}


def test_a_batch_reads_the_state_of_a_session_once():
    calls = []

    class State:
        def __init__(self, name):
            self.name = name

        def __getattr__(self, call):
            calls.append((self.name, call))
            return lambda *_: {"exists": False}.get(call, [])

    class Handle:
        getValueState = getMapState = staticmethod(lambda name, *_: State(name))
        listTimers, registerTimer, deleteTimer = staticmethod(list), staticmethod(lambda _: None), staticmethod(lambda _: None)

    machine = Staging(60)
    machine.init(Handle())
    steps = [("create", "", 0), *[("add", f"f{i % 3}", i) for i in range(90)], *[("confirm", "", i) for i in range(60)]]
    rows = pd.DataFrame([("s", a, n, b, pd.Timestamp(2024, 1, 1) + pd.Timedelta(seconds=i)) for i, (a, n, b) in enumerate(steps)], columns=["session", "action", "name", "bytes", "ts"])
    (out,) = machine.handleInputRows(("s",), iter([rows[:50], rows[50:]]), None)
    assert out.columns.tolist() == ["session", "status", "files", "bytes", "planned", "reason"]
    assert out.values.tolist() == [["s", "refused", 3, 87 + 88 + 89, 0, "no plan"]] * 60
    assert len(calls) <= 5  # whether there is a state, the new one, and three files
