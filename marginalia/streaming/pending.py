"""Changes that wait for a quiet moment, with one timer that each change restarts, flushing and disabling.

Arbitrary state (``transformWithState``): the last event of each path waits in a map, and an event-time timer emits all of them
when nothing has happened for a while. Rows whose kind is a control act on what is pending: ``flush`` emits it at once, ``disable``
drops it and what comes until ``enable``. The session must keep state with RocksDB (``ROCKSDB``).

The timer is one for all paths, yet shards of the paths can keep what is pending: each gets the events of its own paths, and of
all others only the runs, from when to when a task's events have no longer gap. State is read and written once a trigger.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .watch import LATE, expand_renames, notes_only

ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
FLUSH, DISABLE, ENABLE = CONTROLS = ("flush", "disable", "enable")
EMITTED = "shard int, path string, kind string, ts bigint, due bigint"


class Pending(StatefulProcessor):
    """The state of one shard. Times are milliseconds."""

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "path string", "kind string, ts bigint")
        self.state = handle.getValueState("state", "last bigint, enabled boolean")

    def _merged(self, fresh: dict) -> dict:
        """What is pending: the stored events, and those of this trigger that are not older."""
        out = {k[0]: tuple(v) for k, v in self.waiting.iterator()}
        for path, (kind, ts) in fresh.items():
            held = out.get(path)
            if held is None or (ts, kind == "delete") >= (held[1], held[0] == "delete"):
                out[path] = (kind, ts)
        return out

    def _emit(self, shard: int, due: int, fresh: dict, stored: bool) -> Iterator[Row]:
        for path, (kind, ts) in sorted((self._merged(fresh) if stored else fresh).items()):
            yield Row(shard=shard, path=path, kind=kind, ts=ts, due=due)
        if stored:
            self.waiting.clear()
        fresh.clear()

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802
        last, enabled = tuple(self.state.get()) if self.state.exists() else (None, True)
        fresh, stored, reach = {}, self.waiting.exists(), None  # ``reach``: how far the runs that have begun go
        after = lambda at: reach if reach is not None and reach > at else None
        # the rows of one trigger: in the order of their times; of equal times controls and deletions are last
        order = sorted((r["at"], r["kind"] in CONTROLS, r["kind"] == "delete", r["kind"] or "", r["path"] or "", r["until"] or r["at"]) for r in rows)
        for at, control, _, kind, path, until in order:
            if last is not None and at > last + self.gap:  # the timer would have fired between the two
                yield from self._emit(key[0], last + self.gap, fresh, stored)
                last, stored = None, False
            if kind == FLUSH:
                yield from self._emit(key[0], at, fresh, stored)
                last, stored = after(at) if enabled else None, False
            elif kind == DISABLE:
                if stored:
                    self.waiting.clear()
                fresh.clear()
                last, enabled, stored = None, False, False
            elif kind == ENABLE:
                last, enabled = last if enabled else after(at), True
            elif not control:
                reach = max(until, reach or until)
                if enabled:
                    if path:
                        fresh[path] = (kind, at)
                    last = max(until, last or until)
        for path, (kind, at) in fresh.items():
            held = self.waiting.getValue((path,)) if stored and self.waiting.containsKey((path,)) else None
            if held is None or (at, kind == "delete") >= (held[1], held[0] == "delete"):
                self.waiting.updateValue((path,), (kind, at))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if last is not None:
            self.handle.registerTimer(last + self.gap)
        self.state.update((last, enabled))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802
        yield from self._emit(key[0], expiredTimerInfo.getExpiryTimeInMs(), {}, True)
        self.state.update((None, self.state.get()[1] if self.state.exists() else True))

    def close(self) -> None:
        pass


def _with_runs(gap: int):
    """Passes events (path, kind, ts, until) on, and adds the runs of a task's events, as rows without a path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times, schema = [], None
        for batch in batches:
            schema = batch.schema
            times.append(np.unique(np.asarray(batch.column(2).cast(pa.int64()).drop_null())))
            yield batch
        at = np.unique(np.concatenate(times)) if times else np.zeros(0, np.int64)
        if len(at):
            ends = np.flatnonzero(np.diff(at // 1000) > gap)
            first, last = at[np.append(0, ends + 1)], at[np.append(ends, len(at) - 1)]
            none = pa.nulls(len(first), pa.string())
            yield pa.RecordBatch.from_arrays([none, none, pa.array(first).cast(schema.field(2).type), pa.array(last // 1000)], schema=schema)

    return run


def pending_changes(changes: DataFrame, gap: int = 1000, late: str = LATE, shards: int = 1) -> DataFrame:
    """(shard, path, kind, ts, due) of a stream of changes (path, old_path, kind, ts): the last event of each path of a burst, once
    ``gap`` milliseconds have passed without another, or a flush has come; ``due`` is when that was. Renames are two events.

    A timer is shared by all paths. One shard holds the whole state in one task; more spread it by path, give the same rows,
    and controls reach each of them. With more, events that come later than ``late`` may still prolong a burst.
    """
    held = "path string, kind string, ts timestamp, until bigint"
    none = F.lit(None).cast("bigint").alias("until")
    events = expand_renames(notes_only(changes.filter(~F.col("kind").isin(*CONTROLS)))).select("path", "kind", "ts", none)
    events = events.mapInArrow(_with_runs(gap), held) if shards > 1 else events
    controls = changes.filter(F.col("kind").isin(*CONTROLS)).select(F.lit(None).cast("string").alias("path"), "kind", "ts", none)
    every = F.array(*map(F.lit, range(shards)))
    own = F.array(F.pmod(F.xxhash64("path"), F.lit(shards)).cast("int"))
    rows = events.unionByName(controls).withWatermark("ts", late)
    rows = rows.select(F.explode(F.when(F.col("path").isNull(), every).otherwise(own)).alias("shard"), "path", "kind", F.unix_millis("ts").alias("at"), "until", "ts")
    return rows.groupBy("shard").transformWithState(Pending(gap), EMITTED, "append", "eventTime")
