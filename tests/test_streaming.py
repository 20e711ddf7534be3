import json
import os

import pytest

from tidemark.operators.sync import SyncResult
from tidemark.plans import config as C
from tidemark.sources.store import MemoryStore, TableSpec
from tidemark.streaming import stream

MESSAGES = "source string, seq long, arrival long"
ROWS = [("a", s, i) for i, s in enumerate([100, 50, 50, 30, 80, 164, 100, 101])] + [("b", s, i) for i, s in enumerate([0, 200, 0, 200, 199])]


def verdicts(rows):
    return {(r["source"], r["arrival"]): r["accepted"] for r in rows}


def test_guard_in_a_stream_agrees_with_the_fold(spark, tmp_path):
    df = spark.createDataFrame(ROWS, MESSAGES)
    for k, part in enumerate((df.filter("arrival < 3"), df.filter("arrival >= 3"))):
        part.coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    source = spark.readStream.schema(MESSAGES).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = stream.replay_guard(source, "source", "seq", "arrival").writeStream.format("memory").queryName("guarded").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = verdicts(spark.table("guarded").collect())
    assert len(got) == len(ROWS) and got == verdicts(stream.replay_fold(df, "source", "seq", "arrival").collect())


def test_guard_state_is_bounded(spark, tmp_path):
    """Ids that are too long are refused in both forms; a stream with a time to live judges as one without."""
    df = spark.createDataFrame([*ROWS, ("x" * 200, 1, 0)], MESSAGES)
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(MESSAGES).parquet(f"{tmp_path}/in")
    # Timers by the clock would ask for empty batches without end, also after the last row.
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    try:
        q = stream.replay_guard(source, "source", "seq", "arrival", ttl_seconds=270).writeStream.format("memory").queryName("bounded").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        done = q.awaitTermination(100)
        q.stop()
    finally:
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    assert done
    got = verdicts(spark.table("bounded").collect())
    assert not got["x" * 200, 0] and got == verdicts(stream.replay_fold(df, "source", "seq", "arrival").collect())


def test_apply_stream(spark, tmp_path):
    schema = "id long, v string, updated_at string"
    store = MemoryStore({"t": spark.createDataFrame([(1, "old", "1")], schema)}, {"t": TableSpec("t", ["id"])})
    spark.createDataFrame([(1, "mid", "2"), (1, "new", "3"), (2, "x", "1")], schema).write.parquet(f"{tmp_path}/in")
    stream.apply_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), store, "t", ["id"], "updated_at", f"{tmp_path}/cp").awaitTermination(120)
    assert {tuple(r) for r in store.table("t").collect()} == {(1, "new", "3"), (2, "x", "1")}
    spark.createDataFrame([(1, "late", "2"), (2, "y", "2")], schema).write.mode("append").parquet(f"{tmp_path}/in")
    stream.apply_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), store, "t", ["id"], "updated_at", f"{tmp_path}/cp").awaitTermination(120)
    assert {tuple(r) for r in store.table("t").collect()} == {(1, "new", "3"), (2, "y", "2")}


def test_events_per_window(spark, tmp_path):
    schema = "id long, ts timestamp"
    spark.sql("select id, timestamp_seconds(id * 40) as ts from range(10)").write.parquet(f"{tmp_path}/in")
    q = stream.events_per_window(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "ts", "10 seconds", "1 minute").writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sum(r["n"] for r in spark.table("windows").collect()) == 10


def test_watch(tmp_path):
    steps = [lambda: [SyncResult("t", 1, 0)], lambda: (_ for _ in ()).throw(C.NetworkError("down", 503)), lambda: []]
    lines, slept = [], []
    it = iter(steps)
    assert stream.watch(lambda: next(it)(), 30, f"{tmp_path}/state.json", lines.append, 3, slept.append) == 3
    assert [x["status"] for x in lines] == ["ok", "error", "ok"] and slept == [30, 30] and "last_sync" in json.load(open(f"{tmp_path}/state.json"))
    slept.clear()
    down = lambda: (_ for _ in ()).throw(C.NetworkError("down", 503))
    assert stream.watch(down, 30, ticks=5, sleep=slept.append, retry=C.Retry(initial_ms=1000, cap_ms=4000)) == 5 and slept == [1, 2, 4, 4]
    with pytest.raises(C.ConfigError):
        stream.watch(lambda: (_ for _ in ()).throw(C.ConfigError("bad")), 1, ticks=2)


def test_lock_and_clock(tmp_path):
    path = f"{tmp_path}/pid"
    with stream.PidLock(path):
        with pytest.raises(C.ConfigError), stream.PidLock(path):
            pass
    with open(path, "w") as f:
        f.write("999999999")
    with stream.PidLock(path):
        assert open(path).read() == str(os.getpid())
    assert stream.iso_now(lambda: 0) == "1970-01-01T00:00:00Z" and stream.date_of_epoch_days(19_782) == "2024-02-29"
