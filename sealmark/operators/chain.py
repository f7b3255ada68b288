"""Hash chains over ordered rows: building, verification, anchors, segments.

Verification is parallel. The link of a row is checked by a window where rows have a key that bounds it (segments),
or by a join on consecutive positions where there is one chain over all rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sealmark.functions.hashing import RECORD, UNIT, event_hash
from sealmark.operators.settled import settle

GENESIS = ""


def running(rows: DataFrame, order: list[str], **values: Column) -> DataFrame:
    """``rows`` with a column for each of ``values``: its sum over all rows before, in ``order``, without one task that holds all rows.

    Ranges are sorted and summed, then offset: what reaches the driver is one row a range.
    """
    spark = rows.sparkSession
    ranged = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    # Written once: places among ties must not change when an executor is lost.
    placed = settle(ranged.select("*", *(v.cast("long").alias(f"_v_{n}") for n, v in values.items()), F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_m")))
    totals, offsets = [0] * len(values), []
    for p, *sums in placed.groupBy("_p").agg(*(F.sum(f"_v_{n}") for n in values)).orderBy("_p").collect():
        offsets.append((p, totals))
        totals = [t + s for t, s in zip(totals, sums, strict=True)]
    w = Window.partitionBy("_p").orderBy("_m").rowsBetween(Window.unboundedPreceding, -1)
    for i, n in enumerate(values):
        table = F.create_map(*(F.lit(x) for p, t in offsets for x in (p, t[i]))) if offsets else F.create_map(F.lit(0), F.lit(0))
        placed = placed.withColumn(n, (F.coalesce(F.sum(f"_v_{n}").over(w), F.lit(0)) + F.try_element_at(table, "_p")).cast("long"))
    return placed.drop("_p", "_m", *(f"_v_{n}" for n in values))


def numbered(rows: DataFrame, order: str = "id") -> DataFrame:
    """``rows`` with ``position`` from 0, without one task that holds all rows."""
    return running(rows, [order], position=F.lit(1))


def walk(events: DataFrame, fields: list[str], order: str = "id", chain: str | None = None) -> DataFrame:
    """(id, problem) for every row of a chain that is wrong.

    ``hash``: the row's own hash is not that of its fields. ``unhashed``: a row without a hash after hashed ones.
    ``fork``: the previous hash is not that of the row before, but of an earlier one. ``broken``: it is that of none.
    With ``chain``, rows of each of its values are a chain of their own, of bounded length, in a window; without, one chain
    over all rows is walked by joins on positions.
    """
    own = event_hash(F.col("prev_hash"), F.col("scheme"), *(F.col(f) for f in fields))
    hashed = F.col("row_hash") != ""
    if chain:
        w = Window.partitionBy(chain).orderBy(order)
        rows = events.withColumn("position", F.row_number().over(w))
        checked = rows.withColumns({"_prev": F.lag("row_hash").over(w), "_first": F.min(F.when(hashed, F.col("position"))).over(w)})
    else:
        rows = numbered(events, order)
        before = rows.select((F.col("position") + 1).alias("position"), F.col("row_hash").alias("_prev"))
        first_hashed = rows.filter(hashed).agg(F.min("position").alias("_first"))
        checked = rows.join(before, "position", "left").crossJoin(F.broadcast(first_hashed))  # one row
    keys = [chain] if chain else []
    late = ~hashed & (F.col("position") > F.col("_first"))
    linked = F.col("prev_hash").eqNullSafe(F.coalesce("_prev", F.lit(GENESIS)))
    bad_link = hashed & ~linked
    earlier = rows.filter(hashed).groupBy(*keys, "row_hash").agg(F.min("position").alias("_seen")).withColumnRenamed("row_hash", "prev_hash")
    marked = checked.withColumn("_wrong", F.when(late, "unhashed").when(hashed & (F.col("row_hash") != own), "hash").when(bad_link, "broken")).filter("_wrong IS NOT NULL")
    met = marked.join(earlier, [*keys, "prev_hash"], "left")
    fork = (F.col("_wrong") == "broken") & ((F.col("_seen") < F.col("position")) | (F.col("prev_hash") == GENESIS))
    return met.select(F.col(order).alias("id"), F.when(fork, "fork").otherwise(F.col("_wrong")).alias("problem"))


def build(rows: DataFrame, fields: list[str], scheme: str, order: str = "id", chain: str | None = None, after: tuple[object, str] | None = None) -> DataFrame:
    """``rows`` with ``prev_hash``, ``row_hash`` and ``scheme``: one chain for each value of ``chain``, or one of all rows.

    A hash needs the one before it, so a chain is sequential: its rows stream through one task, in order, and only
    the last hash is held. For many rows take ``build_segments``. ``after`` is (a value of ``chain``, the hash that its rows go on from).
    """
    keys = [chain] if chain else []
    dealt = rows.repartition(chain) if chain else rows.coalesce(1)
    dealt = dealt.sortWithinPartitions(*keys, order).select(*rows.columns, F.array(*(F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields)).alias("_f"))
    at = rows.columns.index(chain) if chain else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prev, now = after[1] if after and after[0] is None else GENESIS, None
        for b in batches:
            keys_ = b.column(at).to_pylist() if at is not None else [None] * b.num_rows
            prevs, hashes = [], []
            for key, values in zip(keys_, b.column(b.num_columns - 1).to_pylist(), strict=True):
                if key != now:
                    prev, now = after[1] if after and key == after[0] else GENESIS, key
                prevs.append(prev)
                prev = hashlib.sha256("\x1f".join([scheme, prev, *values]).encode()).hexdigest()
                hashes.append(prev)
            names = b.schema.names[:-1]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(prevs), pa.array(hashes), pa.array([scheme] * b.num_rows)], names=[*names, "prev_hash", "row_hash", "scheme"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return dealt.mapInArrow(run, f"{kinds}, prev_hash string, row_hash string, scheme string")


#: Rows of a segment, and heads that one head of the next level stands for.
WIDTH = 4096


def build_segments(rows: DataFrame, fields: list[str], scheme: str, width: int = WIDTH, order: str = "id") -> tuple[DataFrame, DataFrame]:
    """(rows, heads): chains of the rows of ``width`` successive values of ``order``, and the heads of the tree over them.

    Segments are hashed in parallel, none longer than its width where ``order`` is a key. See ``heads_of`` for the tree.
    """
    cut = build(rows.withColumn("segment", F.floor(F.col(order) / width)), fields, scheme, order, "segment")
    return cut, heads_of(cut, scheme, width, order)


def _heads(cut: DataFrame, order: str) -> DataFrame:
    return cut.groupBy("segment").agg(F.count("*").alias("n"), F.max_by("row_hash", order).alias("head"), F.max(order).cast("long").alias("last_id"))


def heads_of(cut: DataFrame, scheme: str, width: int = WIDTH, order: str = "id") -> DataFrame:
    """(level, segment, n, head, last_id): a tree over chained segments, level 0 the segments themselves.

    The heads of ``width`` successive segments are chained in their order, in parallel with the others, and the last hash is their head on the
    next level; the root, which commits to all rows in order, is the only one of its level. A level has a ``width``-th of the one below.
    """
    level, now = 0, settle(_heads(cut, order))
    out = now.select(F.lit(0).alias("level"), "segment", "n", "head", "last_id")
    while now.limit(2).count() > 1:
        level += 1
        up = now.withColumnRenamed("segment", "_below").withColumn("segment", F.floor(F.col("_below") / width))
        chained = build(up, ["_below", "n", "head"], scheme, "_below", "segment")
        now = settle(chained.groupBy("segment").agg(F.sum("n").alias("n"), F.max_by("row_hash", "_below").alias("head"), F.max("last_id").alias("last_id")))
        out = out.union(now.select(F.lit(level).alias("level"), "segment", "n", "head", "last_id"))
    return out


def root(heads: DataFrame) -> tuple[int, int | None, str]:
    """(rows, last id, root hash) of a tree; that of no rows is (0, None, "")."""
    top = heads.orderBy(F.desc("level")).select("n", "last_id", "head").first()
    return tuple(top) if top else (0, None, GENESIS)


class StaleTip(ValueError):
    """An append was built on a tip that is no longer the chain's."""


def extend(cut: DataFrame, rows: DataFrame, fields: list[str], scheme: str, seen: tuple[int, int | None, str], width: int = WIDTH, order: str = "id") -> DataFrame:
    """``rows`` chained on to the segments of ``cut``, to be appended: the last segment goes on, the others are new.

    ``seen`` is the ``root`` of the tree that the writer read. Another root, or rows that do not come after its last id, are refused.
    """
    now = root(heads_of(cut, scheme, width, order))
    if now != tuple(seen):
        raise StaleTip(f"the chain stands at {now[0]} rows, not at {seen[0]}" if now[0] != seen[0] else "the chain has another head")
    first = rows.agg(F.min(order)).first()[0]
    if first is not None and now[1] is not None and first <= now[1]:
        raise StaleTip(f"{first} does not come after {now[1]}")
    last = None if now[1] is None else cut.filter(F.col(order) == now[1]).select("segment", "row_hash").first()
    return build(rows.withColumn("segment", F.floor(F.col(order) / width)), fields, scheme, order, "segment", tuple(last) if last else None)


def tree_digests(rows: DataFrame, area: str, path: str = "path", sha: str = "sha") -> DataFrame:
    """(area, digest, n): digest of the snapshot of each area, over its (path, sha) in order of path.

    An area's rows are sorted and stream through one hash, so an area of any size is never held. Pairs with a null are
    counted and hashed as nothing.
    """
    dealt = rows.select(F.col(area).cast("string").alias("area"), path, sha).repartition("area").sortWithinPartitions("area", path, sha)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("area", pa.string()), ("digest", pa.string()), ("n", pa.int64())])
        now, state, n = None, hashlib.sha256(), 0
        for b in batches:
            out = []
            for key, p, s in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if n and key != now:
                    out.append((now, state.hexdigest(), n))
                    state, n = hashlib.sha256(), 0
                now, n = key, n + 1
                if p is not None and s is not None:
                    state.update(f"{p}{UNIT}{s}{RECORD}".encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds.types, strict=True)], schema=kinds)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((now, state.hexdigest(), n), kinds.types, strict=True)], schema=kinds)

    return dealt.mapInArrow(run, "area string, digest string, n long")


def tip(rows: DataFrame, order: str = "id") -> DataFrame:
    """(n, last_id, head) of a chain, from one aggregate, so that all three are of one moment."""
    return rows.agg(F.count("*").alias("n"), F.max(order).alias("last_id"), F.max_by("row_hash", order).alias("head"))


def anchored(rows: DataFrame, n: int, last_id: int, head: str, order: str = "id") -> Column | DataFrame:
    """One row, ``ok``: whether the rows up to ``last_id`` are as many as the anchor says and end in its head."""
    upto = rows.filter(F.col(order) <= last_id)
    return tip(upto, order).select(F.coalesce((F.col("n") == n) & (F.col("last_id") == last_id) & (F.col("head") == head), F.lit(n == 0)).alias("ok"))


def segment_gaps(segments: DataFrame) -> DataFrame:
    """(seq, problem) of exported segments: missing numbers, and starts that do not follow the end of the one before. Numbers are met by a join on the next one."""
    first = segments.agg(F.min("seq").alias("_first"))  # one row
    before = segments.select((F.col("seq") + 1).alias("seq"), F.col("ends_with").alias("_end"), F.lit(True).alias("_there"))
    met = segments.join(before, "seq", "left").crossJoin(first)
    problem = F.when(F.col("_there").isNull() & (F.col("seq") != F.col("_first")), "missing segment before").when(F.col("_there") & ~F.col("starts_after").eqNullSafe(F.col("_end")), "does not continue")
    return met.select("seq", problem.alias("problem")).filter("problem IS NOT NULL")
