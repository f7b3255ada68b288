"""Stateful streams: idempotent transitions with versions, late results, cadence, offsets.

Late rows are never dropped: they are classified and kept. The state of a key is its version and the ids it has accepted.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

TRANSITIONS = "id long, key long, version long, action string, sha string"
OUT = "id long, key long, version long, action string, outcome string"
#: Actions that are accepted however old their version is.
LATE = frozenset({"receipt", "result"})


def apply_transition(version: int, seen: dict[int, str], row: tuple[int, int, str, str]) -> tuple[int, str]:
    """(version after, outcome) of (id, expected version, action, sha).

    An id that was seen replays if its content is the same and is refused if not. A version that is not current is
    refused, unless the action may come late: then it is kept and changes nothing.
    """
    id_, expected, action, sha = row
    if id_ in seen:
        return version, "replayed" if seen[id_] == sha else "refused: same id, other content"
    seen[id_] = sha
    if expected == version:
        return version + 1, "applied"
    if action in LATE:
        return version, "kept late"
    del seen[id_]
    return version, "refused: stale version"


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Outcomes of rows in order of key, id and version. Equal ids follow each other, so only the last one is remembered."""
    begun, now, version, seen = False, None, 0, {}
    for b in batches:
        outcomes = []
        for id_, key, expected, action, sha in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if not begun or key != now:
                begun, now, version, seen = True, key, 0, {}
            if id_ not in seen:
                seen.clear()
            version, outcome = apply_transition(version, seen, (id_, expected, action, sha))
            outcomes.append(outcome)
        yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(outcomes, pa.string())], names=["id", "key", "version", "action", "outcome"])


def transitions(rows: DataFrame) -> DataFrame:
    """Outcome of every transition of each key, of a stream or a table of ``TRANSITIONS`` rows, by id within a batch.

    A table is sorted and streams past one version and one id. A stream keeps the ids it has accepted, as any may be sent again.
    """
    if not rows.isStreaming:
        kinds = rows.select(*(F.col(c).cast(t).alias(c) for c, t in (x.split() for x in TRANSITIONS.split(", "))))
        return kinds.repartition("key").sortWithinPartitions("key", "id", "version").mapInArrow(_settled, OUT)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        version, ids, shas = state.get if state.exists else (0, [], [])
        seen = dict(zip(ids, shas, strict=True))
        got = pd.concat(list(batches)).sort_values(["id", "version"])
        outcomes = []
        for r in got.itertuples():
            version, outcome = apply_transition(version, seen, (r.id, r.version, r.action, r.sha))
            outcomes.append(outcome)
        state.update((version, list(seen), list(seen.values())))
        yield got.assign(outcome=outcomes)[["id", "key", "version", "action", "outcome"]]

    return rows.groupBy("key").applyInPandasWithState(run, OUT, "version long, ids array<long>, shas array<string>", "append", GroupStateTimeout.NoTimeout)


class _Bounded(StatefulProcessor):
    """Transitions of a key with the ids of the last ``horizon`` that it accepted.

    State: (version, ids accepted so far, ids let go, greatest version that one of those expected), ids with content and place, ids by place.
    """

    def __init__(self, horizon: int):
        self.horizon = horizon

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.at = handle.getValueState("at", "version long, accepted long, gone long, low long")
        self.ids = handle.getMapState("ids", "id long", "sha string, expected long")
        self.places = handle.getMapState("places", "place long", "id long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers: object) -> Iterator[pd.DataFrame]:
        version, accepted, gone, low = self.at.get() if self.at.exists() else (0, 0, 0, -1)
        out = []
        for r in sorted((r for b in rows for r in b.itertuples(index=False)), key=lambda r: (r.id, r.version)):
            known = self.ids.getValue((r.id,)) if self.ids.containsKey((r.id,)) else None
            if known is None and r.version <= low:
                outcome = ASIDE
            else:
                seen = {} if known is None else {r.id: known[0]}
                version, outcome = apply_transition(version, seen, (r.id, r.version, r.action, r.sha))
                if known is None and r.id in seen:
                    self.ids.updateValue((r.id,), (r.sha, r.version))
                    self.places.updateValue((accepted,), (r.id,))
                    accepted += 1
                    while accepted - gone > self.horizon:
                        old = self.places.getValue((gone,))
                        low = max(low, self.ids.getValue(old)[1])
                        self.ids.removeKey(old)
                        self.places.removeKey((gone,))
                        gone += 1
            out.append((r.id, r.key, r.version, r.action, outcome))
        self.at.update((version, accepted, gone, low))
        yield pd.DataFrame(out, columns=["id", "key", "version", "action", "outcome"])

    def close(self) -> None:
        pass


#: What is said of a row that may be one of those let go: it is kept, and changes nothing.
ASIDE = "kept aside: before the horizon"


def bounded_transitions(rows: DataFrame, horizon: int = 1000) -> DataFrame:
    """Outcomes of a stream of ``TRANSITIONS`` rows, with state that does not grow: a key keeps its version and the last ``horizon`` ids that it accepted.

    Within the horizon outcomes are those of ``transitions``. An unknown id that expects a version no greater than that of an id let go may have been
    sent before: it is answered as ``ASIDE``, for a side output of its own. Needs the RocksDB state store, which is set. Rows of a key and batch are put in order in memory.
    """
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return rows.groupBy("key").transformWithStateInPandas(_Bounded(horizon), OUT, "append", "none")


def upsert_ignore(stream: DataFrame, root: str, key: str, changed: str, checkpoint: str):
    """Write a stream so that a known key is not written again; a known key with another ``changed`` value is raised once more instead.

    Both targets, ``rows`` and ``raised`` of ``root``, are one commit an epoch (see ``commits``): a batch that dies between its writes, or is replayed, shows neither
    half of it nor anything twice. Of rows of one key in one batch one is written.
    """

    def sink(batch: DataFrame, epoch: int) -> None:
        from sealmark.sources import commits

        spark = batch.sparkSession
        if commits.done(spark, root, epoch):
            return
        new = batch.dropDuplicates([key]).persist()
        known, told = commits.read(spark, root, "rows"), commits.read(spark, root, "raised")
        if known is None:
            commits.commit(root, epoch, {"rows": new})
        else:
            before = known.select(key, changed) if told is None else known.select(key, changed).unionByName(told.select(key, changed))
            pair = before.select(F.col(key).alias("_key"), F.col(changed).alias("_was")).distinct()
            again = new.join(known.select(key).distinct(), key, "left_semi").join(pair, (F.col(key) == F.col("_key")) & F.col(changed).eqNullSafe(F.col("_was")), "left_anti")
            commits.commit(root, epoch, {"rows": new.join(known.select(key).distinct(), key, "left_anti"), "raised": again})
        new.unpersist()

    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)


def acknowledge(updates: DataFrame, root: str, epoch: int, order: str = "uid") -> bool:
    """Take the updates from the stored offset on: they become rows of ``acks``, and the offset moves past the last one, in one commit of ``root``.

    Updates before the offset have been taken. A batch without new ones leaves the offset where it is; an epoch that was committed does nothing, and gives False.
    """
    from sealmark.sources import commits

    spark = updates.sparkSession
    if commits.done(spark, root, epoch):
        return False
    held = commits.read(spark, root, "offset")
    at = held.agg(F.max("next")).first()[0] if held is not None else None
    new = updates if at is None else updates.filter(F.col(order) >= at)
    last = new.agg((F.max(order) + 1).cast("long").alias("next")).filter("next IS NOT NULL")
    return commits.commit(root, epoch, {"acks": new, "offset": last})


def since(events: DataFrame, last: DataFrame, at: str = "created_at") -> DataFrame:
    """Events strictly after the one time in ``last``; all if it is null or missing."""
    bound = last.agg(F.max(at).alias("_since"))
    return events.crossJoin(F.broadcast(bound)).filter(F.col("_since").isNull() | (F.col(at) > F.col("_since"))).drop("_since")


def windowed(events: DataFrame, delay: str, width: str) -> DataFrame:
    """Counts by kind in windows, for streams whose rows may be late by ``delay``."""
    return events.withWatermark("created_at", delay).groupBy(F.window("created_at", width), "kind").agg(F.count("*").alias("n"))
