"""Session helpers and text vectorisation shared by the operators of this subpackage."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])


#: Python workers are reused by later stages; with these, they give back what a stage no longer holds.
WORKER_ENVIRONMENT = {"MALLOC_ARENA_MAX": "1", "MALLOC_TRIM_THRESHOLD_": "33554432", "MALLOC_MMAP_THRESHOLD_": "33554432", "ARROW_DEFAULT_MEMORY_POOL": "system"}


def prepare(spark: SparkSession) -> SparkSession:
    """Make this package importable in the Python workers and take the checkpoint folder that ``spark.checkpoint.dir`` names.

    Everything written between steps goes there, where driver and executors must share it, so a session without one is refused.
    """
    sc = spark.sparkContext
    paths = sc.environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        sc.environment["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
    for name, value in WORKER_ENVIRONMENT.items():
        sc.environment.setdefault(name, value)
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and sc.master.startswith("local"):
            folder = tempfile.mkdtemp(prefix="spark-")  # one machine: its driver is its executors
        if folder is None:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def tmp_name(taken: list[str], base: str) -> str:
    """A column name that clashes with none of ``taken`` (compared as Spark does, without case)."""
    low = {c.lower() for c in taken}
    name = base
    while name.lower() in low:
        name += "_"
    return name


#: Tables written by ``saved`` inside the open ``scratch`` blocks, innermost last.
_WRITTEN: list[list[str]] = []


def saved(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared checkpoint folder and read again: lineage is cut and the size is known to the optimizer, which broadcasts it only under its own threshold."""
    spark = prepare(df.sparkSession)
    path = f"{spark.sparkContext.getCheckpointDir()}/saved-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _WRITTEN:
        _WRITTEN[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables saved inside are deleted at the end, but for those given to ``keep``, which is yielded: it saves a table to stay.

    Nothing that is used later may still be computed from the tables that go.
    """
    kept: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        out = saved(df)
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


#: Rows that go to Python at once where they hold whole texts: both sides then hold megabytes, not tens of them.
BATCH_ROWS = 1000


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """While an action runs inside, so many rows at most go to Python at once: for rows that hold long arrays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: A set of ids is broadcast up to this size; a larger one is met by a shuffled join.
BROADCAST_BYTES = 64 << 20


def if_small(ids: DataFrame, width: int) -> DataFrame:
    """``ids`` marked for broadcast if its rows, of ``width`` bytes, are under the bound; else as it is."""
    return F.broadcast(ids) if ids.count() * width <= BROADCAST_BYTES else ids


#: Rows of one key that one task of a join takes; a hotter key is dealt over several.
HOT_ROWS = 1000


def spread_join(left: DataFrame, right: DataFrame, key: str, hot: DataFrame, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right``, which is of few rows a key, on ``key``; the left rows of a hot key are dealt over its parts.

    ``hot`` has (key, parts) of the keys with more than one part: about one for each ``HOT_ROWS`` rows, so it is small.
    """
    salt, parts = (tmp_name([*left.columns, *right.columns], n) for n in ("salt", "parts"))
    few = if_small(hot.select(key, F.col("parts").cast("int").alias(parts)), 24)
    dealt = F.when(F.col(parts).isNull(), 0).otherwise(F.pmod(F.monotonically_increasing_id(), F.col(parts)).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.coalesce(F.col(parts), F.lit(1)) - 1))
    a = left.join(few, key, "left").withColumn(salt, dealt).drop(parts)
    b = right.join(few, key, "left").withColumn(salt, every).drop(parts)
    return a.join(b, [key, salt], how).drop(salt)


def hot_keys(rows: DataFrame, key: str, limit: int = HOT_ROWS) -> DataFrame:
    """(key, parts) of the keys with more than ``limit`` rows."""
    return rows.groupBy(key).count().filter(F.col("count") > limit).select(key, F.ceil(F.col("count") / limit).alias("parts"))


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


# --- vectorised word hashing -------------------------------------------------------------------

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_PINV = np.uint64(pow(int(_P), -1, 1 << 64))
_POW: dict[str, np.ndarray] = {"p": np.ones(1, np.uint64), "q": np.ones(1, np.uint64)}
_WORD = np.zeros(256, bool)
_WORD[128:] = True
for _r in (range(48, 58), range(65, 91), range(97, 123)):
    _WORD[list(_r)] = True


def _powers(kind: str, n: int) -> np.ndarray:
    have = _POW[kind]
    if len(have) < n:
        out = np.full(n + n // 4, _P if kind == "p" else _PINV, np.uint64)
        out[0] = 1
        have = _POW[kind] = np.multiply.accumulate(out)
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that nearby inputs give unrelated outputs."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, one after another, and the number of words of each text.

    Words are the longest runs of ASCII letters and digits and non-ASCII characters, in lower case.
    Hashes are of the whole word: a prefix sum of byte times power, differenced and scaled back.
    """
    parts = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join(parts) + b" ", np.uint8) if parts else np.zeros(0, np.uint8)
    n = len(data)
    if n <= 1:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    inside = _WORD[data]
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0)))
    start, end = edge[::2], edge[1::2]  # the last byte is a space, so every word ends
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers("p", n)[:n], out=sums[1:])
    hashes = mix((sums[end] - sums[start]) * _powers("q", n)[start] + (end - start).astype(np.uint64))
    stops = np.cumsum(np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts)))
    upto = np.searchsorted(start, stops)
    return hashes, np.diff(upto, prepend=0)


def shingles(words: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``k`` words in each text, and their number per text.

    A text of 1 to k - 1 words gives one shingle of all of its words; a text without words gives none.
    """
    n = len(words)
    ends = np.cumsum(counts)
    starts = ends - counts
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(counts), np.int64)
    doc = np.repeat(np.arange(len(counts)), counts)
    left = ends[doc] - np.arange(n)  # words from here to the end of the text
    h = words.copy()
    alive = np.ones(n, bool)
    for i in range(1, k):
        alive &= left > i
        nxt = np.zeros(n, np.uint64)
        nxt[:-i or None] = words[i:] if i < n else nxt[:0]
        h = np.where(alive, h * np.uint64(0x9FB21C651E98DF25) + nxt, h)
    keep = left >= k
    keep[starts[(counts > 0) & (counts < k)]] = True
    return mix(h[keep]), np.bincount(doc[keep], minlength=len(counts))
