"""Several tables that change together: files of an epoch count once its manifest names them, and the manifest is written last, in one rename.

``<root>/<table>/epoch=E-<run>`` holds rows, ``<root>/_manifest/E.json`` names the folders of epoch E. A run that dies before its manifest leaves folders that
nobody reads; the same epoch run again writes others. An epoch whose manifest is there is done: replaying it changes nothing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _manifests(spark: SparkSession, root: str) -> list[dict]:
    """What the manifests say, by epoch: one small document an epoch, and one for all that was compacted."""
    fs, at = _fs(spark, f"{root}/_manifest")
    if not fs.exists(at):
        return []
    docs = [json.loads(r.value) for r in spark.read.text(f"{root}/_manifest", wholetext=True, pathGlobFilter="*.json").collect()]
    base = max((d["epoch"] for d in docs if d.get("compacted")), default=None)
    kept = [d for d in docs if base is None or d["epoch"] > base or (d["epoch"] == base and d.get("compacted"))]
    return sorted(kept, key=lambda d: d["epoch"])


def done(spark: SparkSession, root: str, epoch: int) -> bool:
    """Whether an epoch has been committed, by itself or in a compaction."""
    docs = _manifests(spark, root)
    return any(d["epoch"] == epoch or (d.get("compacted") and d["epoch"] >= epoch) for d in docs)


def _publish(spark: SparkSession, root: str, name: str, doc: dict) -> None:
    fs, _ = _fs(spark, root)
    path = spark._jvm.org.apache.hadoop.fs.Path
    draft = path(f"{root}/_manifest/.{uuid.uuid4().hex}")
    out = fs.create(draft, True)
    out.write(bytearray(json.dumps(doc).encode()))
    out.close()
    if not fs.rename(draft, path(f"{root}/_manifest/{name}.json")):
        fs.delete(draft, False)
        if not any(d["epoch"] == doc["epoch"] and bool(d.get("compacted")) == bool(doc.get("compacted")) for d in _manifests(spark, root)):
            raise OSError(f"epoch {doc['epoch']} of {root} could not be published")


def commit(root: str, epoch: int, tables: dict[str, DataFrame]) -> bool:
    """Write all ``tables`` of an epoch, then make them visible at once; False if the epoch was committed before."""
    spark = next(iter(tables.values())).sparkSession
    if done(spark, root, epoch):
        return False
    run, folders = uuid.uuid4().hex[:12], {}
    for name, rows in tables.items():
        folders[name] = [f"epoch={epoch}-{run}"]
        rows.write.parquet(f"{root}/{name}/{folders[name][0]}")
    _publish(spark, root, f"{epoch}", {"epoch": epoch, "folders": folders})
    return True


def read(spark: SparkSession, root: str, table: str) -> DataFrame | None:
    """The committed rows of a table; None where no epoch has written it."""
    paths = [f"{root}/{table}/{f}" for d in _manifests(spark, root) for f in d["folders"].get(table, [])]
    return spark.read.parquet(*paths) if paths else None


def compact(spark: SparkSession, root: str, upto: int) -> None:
    """Rewrite what the epochs up to ``upto`` wrote as one folder a table, so that readers list few. Readers of the old manifests still find their files."""
    docs = [d for d in _manifests(spark, root) if d["epoch"] <= upto]
    if not docs:
        return
    run, folders = uuid.uuid4().hex[:12], {}
    for name in sorted({t for d in docs for t in d["folders"]}):
        paths = [f"{root}/{name}/{f}" for d in docs for f in d["folders"].get(name, [])]
        folders[name] = [f"upto={upto}-{run}"]
        spark.read.parquet(*paths).write.parquet(f"{root}/{name}/{folders[name][0]}")
    _publish(spark, root, f"{upto}-compacted-{run}", {"epoch": upto, "compacted": True, "folders": folders})
