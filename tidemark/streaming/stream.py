"""Continuous forms: replay guard with keyed state, sync per micro-batch, change feed, watch loop."""

from __future__ import annotations

import json
import os
import signal
import time
from collections.abc import Callable, Iterator
from datetime import date, datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators import merge as M
from tidemark.operators.peer import MOST_ID_BYTES, ReplayGuard
from tidemark.operators.sync import SyncResult
from tidemark.plans.config import ConfigError, Retry, is_transient

STATE = T.StructType([T.StructField("highest", T.LongType()), T.StructField("seen", T.StringType())])


class ReplayProcessor(StatefulProcessor):
    """Keeps, per source, the highest number and the window behind it; rows of a batch go by arrival.

    Ids that are too long are refused and leave no state. With a time to live, a source that is silent for so long is forgotten.
    """

    def __init__(self, seq: str, arrival: str, ttl_seconds: int | None = None):
        self.seq, self.arrival, self.ttl_seconds = seq, arrival, ttl_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("window", STATE, *([self.ttl_seconds * 1000] if self.ttl_seconds else []))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        held = pd.concat(list(rows)).sort_values(self.arrival, kind="stable")
        if too_long(key[0]):
            yield held.assign(accepted=False)
            return
        highest, seen = self.state.get() if self.state.exists() else (None, "0")
        guard = ReplayGuard(highest, int(seen))
        held["accepted"] = [guard.accept(int(s)) for s in held[self.seq]]
        self.state.update((guard.highest, str(guard.seen)))
        yield held

    def close(self) -> None:
        pass


def too_long(source) -> bool:
    return source is not None and len(str(source).encode()) > MOST_ID_BYTES


def replay_guard(messages: DataFrame, source: str, seq: str, arrival: str, ttl_seconds: int | None = None) -> DataFrame:
    """A stream of messages with the verdict of the guard of their source.

    State lies in the state store, a row a source, so the number of sources has no bound but that; ``ttl_seconds`` drops silent ones.
    Its clock keeps a query with the ``availableNow`` trigger alive unless ``spark.sql.streaming.noDataMicroBatches.enabled`` is false.
    """
    schema = T.StructType([*messages.schema.fields, T.StructField("accepted", T.BooleanType())])
    return messages.groupBy(source).transformWithStateInPandas(statefulProcessor=ReplayProcessor(seq, arrival, ttl_seconds), outputStructType=schema, outputMode="append", timeMode="ProcessingTime" if ttl_seconds else "None")


def replay_fold(messages: DataFrame, source: str, seq: str, arrival: str) -> DataFrame:
    """The same guard over a batch, a source at a time."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, guard = pdf.sort_values(arrival, kind="stable"), ReplayGuard()
        refused = too_long(pdf[source].iloc[0])
        return pdf.assign(accepted=[not refused and guard.accept(int(s)) for s in pdf[seq]])

    return messages.groupBy(source).applyInPandas(fold, T.StructType([*messages.schema.fields, T.StructField("accepted", T.BooleanType())]))


def apply_stream(changes: DataFrame, store, table: str, pk: list[str], ts_col: str, checkpoint: str, **trigger):
    """Upsert a stream of changed rows into a store's table: the last write of a key holds, within a batch and across batches.

    A row that is older than the one in the table is passed over, so late rows change nothing, nor does a repeated batch.
    """

    def write(batch: DataFrame, _: int) -> None:
        held = M.latest(batch, pk, ts_col).persist()
        try:
            if not held.isEmpty():
                old = store.table(table).join(held.select(*pk), pk, "left_semi").select(*pk, F.col(ts_col).alias("__held"))
                newer = F.col("__held").isNull() | (F.col(ts_col) >= F.col("__held"))
                store.apply(table, held.join(old, pk, "left").filter(newer).select(*held.columns))
        finally:
            held.unpersist()

    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def events_per_window(events: DataFrame, ts: str, late: str, width: str) -> DataFrame:
    """Counts of a change feed per event-time window; state is dropped behind the watermark."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return timed.groupBy(F.window(ts, width)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")


# -- watch loop -----------------------------------------------------------------------------------------------------


def iso_now(clock: Callable[[], float] = time.time) -> str:
    return datetime.fromtimestamp(clock(), timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def date_of_epoch_days(days: int) -> str:
    return (date(1970, 1, 1) + timedelta(days=days)).isoformat()


class PidLock:
    """One instance per lock file; the lock of a process that is gone is taken over."""

    def __init__(self, path: str):
        self.path = path

    def __enter__(self) -> PidLock:
        for _ in range(2):
            try:
                fd = os.open(self.path, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
                os.write(fd, str(os.getpid()).encode())
                os.close(fd)
                return self
            except FileExistsError:
                with open(self.path) as f:
                    held = f.read().strip()
                if held.isdigit() and os.path.exists(f"/proc/{held}"):
                    raise ConfigError(f"process {held} is at work already") from None
                os.unlink(self.path)
        raise ConfigError("the lock cannot be taken")

    def __exit__(self, *_) -> None:
        os.unlink(self.path)


def watch(tick: Callable[[], list[SyncResult]], interval: float, state_path: str | None = None, report: Callable[[dict], None] = lambda line: None, ticks: int | None = None, sleep: Callable[[float], None] = time.sleep, retry: Retry | None = None) -> int:
    """Run ``tick`` now and after every interval until a fatal error, an interrupt or the last tick; the number of ticks done.

    Transient errors are reported and tried again at the next tick, or after the growing delays of ``retry``.
    """
    done, failed, stop = 0, 0, []
    old = signal.signal(signal.SIGINT, lambda *_: stop.append(1)) if ticks is None else None
    try:
        while not stop and (ticks is None or done < ticks):
            if done:
                sleep(retry.delay_ms(failed - 1) / 1000 if retry and failed else interval)
            try:
                results = tick()
                failed = 0
                report({"at": iso_now(), "status": "ok", "tables": [{"name": r.table, "rows_pushed": r.pushed, "rows_pulled": r.pulled} for r in results if r.has_changes]})
                if state_path:
                    with open(state_path, "w") as f:
                        json.dump({"last_sync": iso_now()}, f)
            except Exception as e:
                failed += 1
                report({"at": iso_now(), "status": "error", "error": str(e)})
                if not is_transient(e):
                    raise
            done += 1
    finally:
        if old is not None:
            signal.signal(signal.SIGINT, old)
    return done
