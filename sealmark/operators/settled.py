"""Cutting lineage in loops: tables written once to a folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Tables written inside the open ``scratch`` blocks, innermost last.
_WRITTEN: list[list[str]] = []


def folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. A local session without one gets a temporary one; a cluster's machines share no such folder, so it is refused."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and sc.master.startswith("local"):
            named = tempfile.mkdtemp(prefix="spark-")
        if named is None:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """``df``, written once as Parquet and read again, which outlives lost executors. Deleted at the end of the innermost ``scratch`` block, if there is one."""
    spark = df.sparkSession
    path = f"{folder(spark)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _WRITTEN:
        _WRITTEN[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def place(spark: SparkSession) -> str:
    """A path for files that go with the innermost ``scratch`` block."""
    path = f"{folder(spark)}/placed-{uuid.uuid4().hex}"
    if _WRITTEN:
        _WRITTEN[-1].append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables settled inside go at the end, but for those given to ``keep``, which is yielded. What is returned must be kept, or read none of them."""
    kept: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        out = settle(df)
        kept.append(_WRITTEN[-1].pop())
        return out

    _WRITTEN.append([])
    try:
        yield keep
    finally:
        gone = _WRITTEN.pop()
        if _WRITTEN:
            _WRITTEN[-1] += kept
        for path in gone:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
