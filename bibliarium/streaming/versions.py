"""Versions of a stream of changes, from keyed state: a record's current snapshot is held, so its log is never read.

Each change of a record is compared with the snapshot of before, wherever the stream is cut into micro-batches and
however often it is started again from its checkpoint; results are those of operators.versions.chain() over all changes.
State is kept by RocksDB, and holds a row for each record, not for each version.
"""

from __future__ import annotations

import datetime
import json
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..schemas import VERSIONS

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Changes that are put together at a time.
PACKED = 1 << 18


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each key of some rows, in ascending order of pos: the other columns as lists."""

    def packed(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts).combine_chunks()
        key = t.column(0).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        order = np.lexsort((pc.fill_null(t.column(1), np.iinfo(np.int64).min).to_numpy(), key))
        first = np.flatnonzero(np.append(True, np.diff(key[order]) != 0))
        t, ends = t.take(pa.array(order)).combine_chunks(), pa.array(np.append(first, len(order)), pa.int32())
        columns = [c.chunk(0) for c in t.columns]
        return pa.record_batch([columns[0].take(pa.array(first)), *(pa.ListArray.from_arrays(ends, c) for c in columns[1:])], t.column_names)

    held, rows = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows >= PACKED:
            yield packed(held)
            held, rows = [], 0
    if held:
        yield packed(held)


class Versions(StatefulProcessor):
    """Rows of a key's changes as lists (pos, deleted, ats, and of each column whether it is given, and its value) to rows of such lists of what comes of them.

    With idle_ms, a record without a change for so long is deleted by a timer.
    """

    def __init__(self, columns: list[str], idle_ms: int | None = None):
        self.columns, self.idle_ms = columns, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "version int, active boolean, snapshot string")

    def _held(self) -> tuple[int, bool, list]:
        got = self.held.get()
        if not got:
            return 0, False, [None] * len(self.columns)
        snapshot = json.loads(got[2])
        return got[0], got[1], [snapshot[c] for c in self.columns]

    def _keep(self, version: int, active: bool, snapshot: list) -> None:
        self.held.update((version, active, json.dumps(dict(zip(self.columns, snapshot)))))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        version, active, snapshot = self._held()
        many = range(len(self.columns))
        changes, latest = [], None
        for r in rows:
            given = zip(*(r[f"g{k}"] for k in many)) if many else repeat(())
            values = zip(*(r[f"v{k}"] for k in many)) if many else repeat(())
            changes += zip(r.pos, r.deleted, r.ats, given, values)
        changes.sort(key=lambda c: c[0])
        versions, actions, actives, snapshots, before = [], [], [], [], snapshot
        for _, deleted, at, given, values in changes:
            latest = at if latest is None or at is not None and at > latest else latest
            action = "unchanged"
            if deleted:
                if active:
                    active, action = False, "deleted"
            else:
                new = [v if g else s for g, v, s in zip(given, values, snapshot)]
                if not active or new != snapshot:
                    action = "inserted" if not version else "reactivated" if not active else "updated"
                    version, active, snapshot = version + 1, True, new
            versions.append(version), actions.append(action), actives.append(active), snapshots.append(snapshot)
        yield self._out(key[0], [c[0] for c in changes], versions, actions, actives, [c[2] for c in changes], [before, *snapshots])
        self._keep(version, active, snapshot)
        if self.idle_ms is not None:
            for due in list(self.handle.listTimers()):
                self.handle.deleteTimer(due)
            if active and latest is not None:
                self.handle.registerTimer(int(latest.timestamp() * 1000) + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        version, active, snapshot = self._held()
        if active:
            self._keep(version, False, snapshot)
            due = datetime.datetime.fromtimestamp(expiredTimerInfo.getExpiryTimeInMs() / 1000)
            yield self._out(key[0], [None], [version], ["deleted"], [False], [due], [snapshot, snapshot])

    def _out(self, key: str, pos: list, versions: list, actions: list, actives: list, ats: list, snapshots: list[list]) -> Row:
        """snapshots: the one of before, and that after each change."""
        return Row(record_key=key, pos=pos, version_number=versions, action=actions, is_active=actives, updated_at=ats, **{f"s{k}": [x[k] for x in snapshots] for k in range(len(self.columns))})

    def close(self) -> None:
        pass


def versioned(changes: DataFrame, columns: list[str], idle: str | None = None, idle_ms: int | None = None) -> DataFrame:
    """A stream of rows (record_key, pos, version_number, action, changed, snapshot, is_active, updated_at) of a stream of changes (record_key, pos, fields; deleted and at if there are such).

    A record's changes come in order of pos over micro-batches. With idle_ms, at is event time with a watermark of `idle`
    (as "10 minutes"), and a record that no change has reached for idle_ms becomes inactive once the watermark says so.
    The session's state store is set to RocksDB, which keyed state asks for.

    State is asked and rows go to Python once for each key and micro-batch, not for each change: a key's changes are put
    together before, and taken apart behind. With idle_ms each change goes alone, as it may be too late by its own time.
    """
    spark = changes.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    columns = list(dict.fromkeys(columns))
    given = changes.selectExpr(
        "cast(record_key as string) as record_key", "cast(pos as bigint) as pos", "cast(fields as map<string,string>) as fields",
        "coalesce(cast(deleted as boolean), false) as deleted" if "deleted" in changes.columns else "false as deleted", "cast(at as timestamp) as at" if "at" in changes.columns else "cast(null as timestamp) as at",
    )
    each = {"pos": F.col("pos"), "deleted": F.col("deleted"), "ats": F.col("at")}
    for k, c in enumerate(columns):
        each |= {f"g{k}": F.coalesce(F.map_contains_key("fields", F.lit(c)), F.lit(False)), f"v{k}": F.try_element_at("fields", F.lit(c))}
    if idle_ms is not None:
        rows = given.withWatermark("at", idle or "0 seconds").select("record_key", "at", *(F.array(x).alias(n) for n, x in each.items()))
    else:
        rows = given.repartition("record_key").select("record_key", *(x.alias(n) for n, x in each.items()))
        rows = rows.mapInArrow(_pack, ", ".join(["record_key string", *(f"{f.name} array<{f.dataType.simpleString()}>" for f in rows.schema.fields[1:])]))
    lists = "record_key string, pos array<bigint>, version_number array<int>, action array<string>, is_active array<boolean>, updated_at array<timestamp>" + "".join(f", s{k} array<string>" for k in range(len(columns)))
    out = rows.groupBy("record_key").transformWithState(Versions(columns, idle_ms), lists, "Append", "EventTime" if idle_ms is not None else "None")
    flat = ["pos", "version_number", "action", "is_active", "updated_at"]
    pairs = [x for k in range(len(columns)) for x in (F.slice(f"s{k}", 1, F.size("pos")).alias(f"o{k}"), F.slice(f"s{k}", 2, F.size("pos")).alias(f"n{k}"))]
    made = out.select("record_key", *flat, *pairs)
    made = made.select("record_key", F.inline(F.arrays_zip(*made.columns[1:])))
    moved = [F.struct(F.lit(c).alias("key"), F.struct(F.col(f"o{k}").alias("old"), F.col(f"n{k}").alias("new")).alias("value")) for k, c in enumerate(columns)]
    moved = F.array(*moved).cast("array<struct<key:string,value:struct<old:string,new:string>>>")
    moved = F.filter(moved, lambda m: (F.col("action") != "inserted") & ~m["value"]["old"].eqNullSafe(m["value"]["new"]))
    snapshot = F.array(*(F.struct(F.lit(c).alias("key"), F.col(f"n{k}").alias("value")) for k, c in enumerate(columns))).cast("array<struct<key:string,value:string>>")
    return made.select("record_key", "pos", "version_number", "action", F.map_from_entries(moved).alias("changed"), F.map_from_entries(snapshot).alias("snapshot"), "is_active", "updated_at")


def to_log(rows: DataFrame) -> DataFrame:
    """VERSIONS rows of versioned() rows: what changed something."""
    return rows.where("action <> 'unchanged'").select(*VERSIONS.names)
