"""Exports in sealed segments: JSON lines in the order in which rows were appended, table by table, in files of a bounded size.

``<path>/rows/epoch=E/seq=N`` holds one file a segment. Its first line says how many rows of each table the segments before it hold and which head
the chain has there; the last segment ends in an anchor. ``<path>/manifest/epoch=E`` has one row a segment and is written last: what
it does not name is not part of the export, so an export that dies half-way leaves the one before as it was.

An export that has more than ``FILES`` segments, small ones, puts successive ones into files of about ``PACK_BYTES`` in ``<path>/packs/epoch=E/pack=P``,
whole and in order, as making a file costs more than filling it. The manifest names the pack.

A later export writes the rows after the last sealed segment only: a segment that was still open is written anew, as a file of the
new epoch. Rows that went missing below what is sealed are found by their number and refused.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sealmark.operators.chain import GENESIS, numbered, running
from sealmark.operators.settled import scratch, settle
from sealmark.sources.ledger import exists, to_lines

#: Bytes of all rows before one, over this, tell its segment: a segment is longer by less than a row, and later exports cut at the same places.
SEAL_BYTES = 64 << 20
#: Segments of an export that may have a file each, and bytes of the segments that share a file where there are more.
FILES, PACK_BYTES = 256, 16 << 20
SEGMENT, ANCHOR = "_segment", "_anchor"
_HEAD = f'{{"_table":"{SEGMENT}","seq":'
_MANIFEST = "seq int, start long, bytes long, skip map<string,long>, upto map<string,long>, starts_after string, next_skip map<string,long>, next_upto map<string,long>, ends_with string, pack int"


class LostRows(ValueError):
    """A table has other rows below what is sealed than the sealed segments hold."""


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row a segment, of the newest epoch that has written it."""
    if not exists(spark, f"{path}/manifest"):
        return spark.createDataFrame([], f"{_MANIFEST}, epoch int")
    all_ = spark.read.schema(f"{_MANIFEST}, epoch int").json(f"{path}/manifest")
    newest = all_.groupBy("seq").agg(F.max("epoch").alias("epoch"))
    return all_.join(newest, ["seq", "epoch"])


def _named(spark: SparkSession, path: str, packed: bool) -> DataFrame | None:
    """(seq, epoch) of the segments in packs, or in files of their own; None if there are none. Broadcast behind a count."""
    named = manifest(spark, path).filter(F.col("pack").isNotNull() if packed else F.col("pack").isNull()).select("seq", "epoch")
    n = named.count()
    return None if n == 0 else F.broadcast(named) if n <= 1 << 20 else named


def read(spark: SparkSession, path: str) -> DataFrame:
    """(seq, value): the lines of an export, its segment heads and its anchor among them."""
    alone, packed = _named(spark, path, False), _named(spark, path, True)
    out = None if alone is None else spark.read.text(f"{path}/rows").join(alone, ["seq", "epoch"]).select("seq", "value")
    if packed is not None:
        # A record is a segment: no line holds a line break, so its head is found by the one before it. Only the first segment has no head.
        whole = spark.read.text(f"{path}/packs", lineSep="\n" + _HEAD)
        text = F.when(F.startswith("value", F.lit("{")), F.col("value")).otherwise(F.concat(F.lit(_HEAD), "value"))
        number = F.when(F.startswith("text", F.lit(_HEAD)), F.regexp_extract(F.substring("text", len(_HEAD) + 1, 12), r"^\d+", 0)).otherwise("1").cast("int")
        segments = whole.select("epoch", text.alias("text")).withColumn("seq", number).join(packed, ["seq", "epoch"])
        lines = segments.select("seq", F.explode(F.split("text", "\n")).alias("value")).filter("value != ''")
        out = lines if out is None else out.union(lines)
    return spark.createDataFrame([], "seq int, value string") if out is None else out


def _start(spark: SparkSession, path: str, seal_bytes: int) -> dict[str, Any]:
    """Where the next export goes on: after the last segment, or at its begin if that is not full."""
    last = manifest(spark, path).orderBy(F.desc("seq")).first()
    if last is None:
        return {"epoch": 1, "seq": 1, "bytes": 0, "skip": {}, "upto": {}, "head": GENESIS}
    newest = manifest(spark, path).agg(F.max("epoch")).first()[0]
    if last.start // seal_bytes == (last.start + last.bytes) // seal_bytes:
        return {"epoch": newest + 1, "seq": last.seq, "bytes": last.start, "skip": last.skip or {}, "upto": last.upto or {}, "head": last.starts_after}
    return {"epoch": newest + 1, "seq": last.seq + 1, "bytes": last.start + last.bytes, "skip": last.next_skip or {}, "upto": last.next_upto or {}, "head": last.ends_with}


def _map(pairs: list[tuple[str, Column]], kind: str = "map<string,long>") -> Column:
    return F.map_filter(F.create_map(*(x for k, v in pairs for x in (F.lit(k), v.cast("long")))), lambda _, v: v.isNotNull()) if pairs else F.create_map().cast(kind)


def export(tables: dict[str, DataFrame], path: str, seal_bytes: int = SEAL_BYTES, chained: str = "attempt", free_text: dict[str, tuple[str, ...]] | None = None, orders: dict[str, str] | None = None) -> None:
    """Write what the export at ``path`` lacks of ``tables``. ``chained`` is the table whose head a segment's first line names."""
    spark = next(iter(tables.values())).sparkSession
    with scratch(spark):
        _export(spark, tables, path, seal_bytes, chained, free_text, orders)


def _export(spark: SparkSession, tables: dict[str, DataFrame], path: str, seal_bytes: int, chained: str, free_text: Any, orders: Any) -> None:
    begin = _start(spark, path, seal_bytes)
    upto = F.try_element_at(F.create_map(*(F.lit(x) for kv in begin["upto"].items() for x in kv)).cast("map<string,long>"), F.col("table")) if begin["upto"] else F.lit(None).cast("long")
    every = to_lines(tables, free_text, orders)
    old = every.filter(F.col("at") <= upto)
    held = {r.table: r.n for r in old.groupBy("table").agg(F.count("*").alias("n")).collect()} if begin["upto"] else {}
    for t, n in begin["skip"].items():
        if t in tables and held.get(t, 0) != n:
            raise LostRows(f"{t} has {held.get(t, 0)} rows below what is sealed, the segments hold {n}")
    new = every.filter(upto.isNull() | (F.col("at") > upto) | F.col("at").isNull())
    size = F.octet_length("value") + 1
    placed = settle(running(new, ["ord", "at", "id"], before=size, position=F.lit(1)).withColumn("size", size))
    per = {r.table: r for r in placed.groupBy("table").agg(F.min("position").alias("first"), F.count("*").alias("n"), F.max("at").alias("at"), F.max_by("row_hash", "position").alias("head"), F.count("row_hash").alias("hashed")).collect()}

    # Segments: one row each. Their numbers have no gaps, though one long row may fill several shares.
    share = F.floor((F.col("before") + begin["bytes"]) / seal_bytes)
    cuts = placed.groupBy(share.alias("share")).agg(F.min("position").alias("first"), F.count("*").alias("n"), F.sum("size").alias("bytes"), (F.min("before") + begin["bytes"]).alias("start"))
    cuts = settle(numbered(cuts, "share").select("share", (F.col("position") + begin["seq"]).cast("int").alias("seq"), "first", "n", "start", "bytes"))
    last_before = placed.select((F.col("position") + 1).alias("edge"), F.col("table").alias("_t"), F.col("at").alias("_at"), F.col("row_hash").alias("_hash"))

    def state(edge: str) -> tuple[Column, Column, Column]:
        """(rows, last ``at``, head of the chain) before the row at ``edge``; within a table, those of the row before it."""
        rows, ends = [], []
        head = F.lit(begin["head"])
        for t in tables:
            r = per.get(t)
            gone, until = begin["skip"].get(t, 0), F.lit(begin["upto"].get(t)).cast("long")
            if r is None:
                rows.append((t, F.lit(gone)))
                ends.append((t, until))
                continue
            inside = F.least(F.greatest(F.col(edge) - r.first, F.lit(0)), F.lit(r.n))
            rows.append((t, inside + gone))
            ends.append((t, F.when(inside == 0, until).when(F.col("_t") == t, F.col("_at")).otherwise(F.lit(r.at))))
            if t == chained:
                head = F.when(inside == 0, head).when(F.col("_t") == t, F.coalesce(F.col("_hash"), head)).otherwise(F.lit(r.head if r.hashed else begin["head"]))
        return _map(rows), _map(ends), head

    def with_state(frame: DataFrame, edge: Column, names: tuple[str, str, str]) -> DataFrame:
        met = frame.withColumn("edge", edge).join(last_before, "edge", "left")
        return met.withColumns(dict(zip(names, state("edge"), strict=True))).drop("edge", "_t", "_at", "_hash")

    heads = with_state(cuts, F.col("first"), ("skip", "upto", "starts_after"))
    heads = settle(with_state(heads, F.col("first") + F.col("n"), ("next_skip", "next_upto", "ends_with")))
    first = heads.filter(F.col("seq") > 1).select("seq", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("position"), F.to_json(F.struct(F.lit(SEGMENT).alias("_table"), "seq", "skip", "starts_after")).alias("value"))
    anchor = heads.orderBy(F.desc("seq")).limit(1).select("seq", F.lit(2).alias("kind"), F.lit(0).cast("long").alias("position"), F.to_json(F.struct(F.lit(ANCHOR).alias("_table"), F.col("next_skip").alias("rows"), F.col("ends_with").alias("head_hash"))).alias("value"))
    data = placed.withColumn("share", share).join(cuts.select("share", "seq"), "share").select("seq", F.lit(1).alias("kind"), "position", "value")
    per = PACK_BYTES // seal_bytes
    packed = per > 1 and heads.count() > FILES
    pack = (F.floor((F.col("seq") - begin["seq"]) / per) if packed else F.lit(None)).cast("int")
    to, by = ("packs", "pack") if packed else ("rows", "seq")
    lines = data.union(first).union(anchor).withColumn("pack", pack).repartition(by).sortWithinPartitions(by, "seq", "kind", "position").select(by, "value")
    lines.write.partitionBy(by).mode("overwrite").text(f"{path}/{to}/epoch={begin['epoch']}")
    heads.select("seq", "start", "bytes", "skip", "upto", "starts_after", "next_skip", "next_upto", "ends_with", pack.alias("pack")).coalesce(1).write.mode("overwrite").json(f"{path}/manifest/epoch={begin['epoch']}")


def faults(spark: SparkSession, path: str, chained: str = "attempt") -> DataFrame:
    """(seq, problem): segments that are missing, that do not continue the one before, or whose first line is not what the manifest and the rows before say."""
    m = manifest(spark, path)
    lines = read(spark, path)
    name = F.get_json_object("value", "$._table")
    seen = lines.withColumn("t", name).groupBy("seq").agg(F.count(F.when(~F.col("t").isin(SEGMENT, ANCHOR), 1)).alias("rows"), F.max(F.when(F.col("t") == SEGMENT, F.col("value"))).alias("head"))
    total = lambda c: F.aggregate(F.map_values(c), F.lit(0).cast("long"), lambda a, x: a + x)
    met = m.join(seen, "seq", "left")
    wrong = F.when(F.coalesce("rows", F.lit(0)) != total("next_skip") - total("skip"), "other number of rows").when((F.col("seq") > 1) & ~F.coalesce(F.get_json_object("head", "$.starts_after").eqNullSafe(F.col("starts_after")), F.lit(False)), "other first line")
    from sealmark.operators.chain import segment_gaps

    gaps = segment_gaps(m.select("seq", "starts_after", "ends_with"))
    return met.select("seq", wrong.alias("problem")).filter("problem IS NOT NULL").union(gaps)
