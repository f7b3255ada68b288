"""Near-duplicate detection by improved consistent weighted sampling over TF-IDF shingles.

Shingles are runs of five words. A shingle's weight is (1 + ln tf) times an idf that falls from ``1 + IDF``, for shingles
of at most one document in ``RARE``, to 1 for those of all documents, in step with the logarithm of the document
frequency; weights are on a fine geometric grid. Frequencies above that share are counted exactly: a table of cells of
fixed size tells which shingles may have it, and only these are shuffled and counted. There are at most ``RARE`` times
as many as a document has on the mean, whatever the number of documents (12 bytes each), so they are broadcast.

Each text gives 64 weighted samples, in 16 bands of 4. Texts that share a band meet in a bucket; pairs are verified by
weighted Jaccard similarity of the whole texts; classes are the connected components of the verified links.

No bucket's pairs are listed. In a first round each text is verified against one text: of the least texts of its
buckets, the one with which it shares most bands. That joins most of a group. Two more rounds take only the buckets
that still hold texts of different classes and compare, by samples, those outside the bucket's largest class with the
others, both in blocks of bounded size. The second round verifies each such text against the one with which it agrees
most, which joins what hangs together through a text that is no bucket's least; the third takes many more samples of
what is left, so that few pairs below the threshold pass (none under about 0.75), and verifies all that agree enough. Two texts of one bucket are
thus either in one class already or compared.

Defined results: a null text is the empty text; equal texts are of one class; texts without a word are alike only
if they are equal; texts of fewer than five words have one shingle of all their words. The documents are the distinct
texts, by 63 bits of their SHA-256 (odds of about 2e-4 that any two of 60 million texts share them): ids name classes in
the output and join nothing, so different texts that share an id, or have none, are compared as any others. A class is
named by its least id, null if none of its rows has one; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sealmark.llm._common import BATCH_ROWS, HOT_ROWS, arrow_rows, hot_keys, if_small, mix, prepare, saved, scratch, shingles, spread_join, table, text_or_empty, tmp_name, word_hashes

WORDS, SIMILAR = 5, 0.8
BANDS, ROWS = 16, 4
SAMPLES = BANDS * ROWS
#: Samples taken besides, of the few texts that the third round compares.
MORE = 960
#: Of these, compared first.
FIRST = 320
#: Texts whose samples agree in a share so many standard deviations below ``SIMILAR`` are not verified: odds of about 1e-5.
DEVIATIONS = 4.2
#: How much more a rare shingle weighs than one of all documents, and of how many documents one may hold a rare one.
IDF, RARE = 0.5, 1000
DF_BITS, _CELLS = 20, 4096
#: Weights are on a grid of this ratio (as a logarithm).
STEP, LEVELS = 0.05, 64
#: Members of a bucket in a block, and strays in one: a task holds one block of each at once.
BLOCK = 4096

_HASH_BITS = 52
_CHARS, _DOCS, _SLICE = 600_000, 4000, 1000
_MULTIPLIERS = np.random.Generator(np.random.PCG64(20)).integers(0, 1 << 64, SAMPLES + MORE, np.uint64, endpoint=False) | np.uint64(1)


def _sliced(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in parts of which the texts are few enough to hold as Python strings."""
    for i in range(0, batch.num_rows, _SLICE):
        yield batch.slice(i, _SLICE)


def _features(texts: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first, stop, shingles, tf, number per text) for ranges of texts: each text's distinct shingles, ascending."""
    first = size = 0
    for stop, t in enumerate([*texts, None]):
        if t is None or size + len(t) > _CHARS or stop - first >= _DOCS:
            if stop > first:
                words, n = word_hashes(texts[first:stop])
                h, n = shingles(words, n, WORDS)
                doc = np.repeat(np.arange(stop - first, dtype=np.uint64), n)
                key = np.sort(doc << np.uint64(_HASH_BITS) | h >> np.uint64(64 - _HASH_BITS))
                start = np.flatnonzero(np.diff(key, prepend=~key[:1]))
                tf = np.diff(start, append=len(key))
                key = key[start]
                yield first, stop, key & np.uint64((1 << _HASH_BITS) - 1), tf, np.bincount((key >> np.uint64(_HASH_BITS)).astype(np.int64), minlength=stop - first)
            first, size = stop, 0
        size += len(t or "")


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(_HASH_BITS - DF_BITS)).astype(np.int64)


def _cells(docs: DataFrame) -> np.ndarray:
    """Document frequencies by hash cell: an upper bound of those of each shingle in the cell.

    A table of fixed size: every task adds up its own, and the parts of all tasks are added by part.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << DF_BITS, np.int64)
        for b in (x for whole in batches for x in _sliced(whole)):
            for *_, h, _, _ in _features(b.column(0).to_pylist()):
                total += np.bincount(_bucket(h), minlength=len(total))
        parts = total.reshape(-1, _CELLS)
        some = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([parts[i].tobytes() for i in some], pa.binary())], names=["part", "cells"])

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(_CELLS, np.int64)
        for x in group.column("cells"):
            total += np.frombuffer(x.as_py(), np.int64)
        return pa.table({"part": group.column("part")[:1], "cells": pa.array([total.tobytes()], pa.binary())})

    schema = "part int, cells binary"
    summed = docs.select("text").mapInArrow(count, schema).groupBy("part").applyInArrow(add, schema)
    found = np.zeros(1 << DF_BITS, np.int64)
    for part, cells in summed.collect():  # 256 parts, whatever the input
        found[part * _CELLS : (part + 1) * _CELLS] = np.frombuffer(cells, np.int64)
    return found


@dataclass
class Idf:
    """ln idf by shingle: of frequent shingles by their frequency, of all others that of a rare one."""

    shingles: np.ndarray  # ascending
    values: np.ndarray
    cells: np.ndarray  # where a frequent shingle may be

    def __call__(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), np.log1p(IDF), np.float32)
        maybe = np.flatnonzero(self.cells[_bucket(h)])
        if len(maybe) and len(self.shingles):
            at = np.minimum(np.searchsorted(self.shingles, h[maybe]), len(self.shingles) - 1)
            hit = self.shingles[at] == h[maybe]
            out[maybe[hit]] = self.values[at[hit]]
        return out


def log_idf(df: np.ndarray, n: int, rare: int) -> np.ndarray:
    """ln idf of shingles in ``df`` of ``n`` documents, where up to ``rare`` documents make a rare one."""
    n = max(n, 1)
    share = np.log(n / np.maximum(df, rare)) / max(math.log(n / rare), 1e-9)
    return np.log1p(IDF * np.clip(share, 0, 1)).astype(np.float32)


def document_frequencies(docs: DataFrame) -> Idf:
    """The idf of the shingles of ``docs``, each document counting once for each of its distinct shingles."""
    n, cells = docs.count(), _cells(docs)
    rare = max(1, n // RARE)
    held = docs.sparkSession.sparkContext.broadcast(cells > rare)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []

        def out() -> pa.RecordBatch:
            keys, counts = parts[0] if len(parts) == 1 else _added(parts)
            parts.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], names=["h", "n"])

        for b in (x for whole in batches for x in _sliced(whole)):
            for *_, h, _, _ in _features(b.column(0).to_pylist()):
                keys, counts = np.unique(h[held.value[_bucket(h)]], return_counts=True)
                parts.append((keys, counts.astype(np.int64)))
                if len(parts) >= 16:
                    parts[:] = [_added(parts)]
            if sum(len(k) for k, _ in parts) > 500_000:
                yield out()
        if parts:
            yield out()

    counted = docs.select("text").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    counted = saved(counted.filter(F.col("n") > rare))
    rows = counted.toArrow()  # no more than RARE times the mean number of shingles of a document
    keys, df = (rows.column(c).to_numpy() for c in ("h", "n"))
    order = np.argsort(keys)
    return Idf(keys[order].view(np.uint64), log_idf(df[order], n, rare), cells > rare)


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([c for _, c in parts]), len(keys)).astype(np.int64)


def levels(h: np.ndarray, tf: np.ndarray, idf: Idf) -> np.ndarray:
    """Weights on the grid, as steps."""
    return np.minimum(np.rint((np.log1p(np.log(tf)) + idf(h)) / STEP), LEVELS - 1).astype(np.int64)


_RANKS: list[np.ndarray] = []


def _ranks() -> np.ndarray:
    """ln a, in bits that sort as it does, for each level and each of 65,536 draws of (r, c, beta).

    With t = floor(ln w / r + beta), ln a = ln c - r (t - beta + 1). A draw gives the same value at two levels if its
    t is the same, as consistent sampling asks.
    """
    if not _RANKS:
        g = np.random.Generator(np.random.PCG64(6))
        r, c, beta = g.gamma(2.0, 1.0, 1 << 16), g.gamma(2.0, 1.0, 1 << 16), g.random(1 << 16)
        t = np.floor(np.arange(LEVELS)[:, None] * STEP / r + beta)
        bits = (np.log(c) - r * (t - beta + 1)).astype(np.float32).view(np.uint32)
        rank = np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31))  # unsigned integers in the order of the numbers
        _RANKS.append(rank.astype(np.uint64).ravel() << np.uint64(32))
    return _RANKS[0]


def least_agreement(n: int) -> float:
    """Samples of n in which two texts must agree to be verified."""
    return n * (SIMILAR - DEVIATIONS * (SIMILAR * (1 - SIMILAR) / n) ** 0.5)


def samples(h: np.ndarray, level: np.ndarray, n: np.ndarray, multipliers: np.ndarray = _MULTIPLIERS[:SAMPLES]) -> np.ndarray:
    """Texts by samples: for each the least rank over the text's shingles, with the shingle's hash below it.

    Every text has at least one shingle.
    """
    ranks, start = _ranks(), np.cumsum(n) - n
    base, mixed, low = (level << 16).astype(np.uint64), mix(h), np.uint64(0xFFFFFFFF)
    out = np.empty((len(n), len(multipliers)), np.uint64)
    for i, m in enumerate(multipliers):
        x = mixed * m
        key = ranks[(base + (x >> np.uint64(48))).astype(np.int64)]
        out[:, i] = np.minimum.reduceat(key | (x & low), start)
    return out


def bands_of(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each text; keys of different bands differ."""
    out = np.empty((len(sig), BANDS), np.uint64)
    for b in range(BANDS):
        x = np.full(len(sig), b + 1, np.uint64)
        for s in range(ROWS):
            x = mix(x * np.uint64(0x9E3779B97F4A7C15) + sig[:, b * ROWS + s])
        out[:, b] = x
    return out.view(np.int64)


def _sketch(sig: np.ndarray) -> np.ndarray:
    """16 bits of each sample, for comparing."""
    return (mix(sig) >> np.uint64(48)).astype(np.uint16)


def _signed(docs: DataFrame, idf: Idf) -> DataFrame:
    """(id, sketch, bands) of every row; bands are empty for a text without words."""
    held = docs.sparkSession.sparkContext.broadcast(idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for whole in batches for x in _sliced(whole)):
            texts = b.column(1).to_pylist()
            for first, stop, h, tf, n in _features(texts):
                some = np.flatnonzero(n)
                sig = samples(h, levels(h, tf, held.value), n[some]) if len(some) else np.zeros((0, SAMPLES), np.uint64)
                sketch: list[bytes | None] = [b""] * (stop - first)
                for i, s in zip(some, _sketch(sig), strict=True):
                    sketch[i] = s.tobytes()
                off = np.zeros(stop - first + 1, np.int32)
                off[1:] = np.cumsum((n > 0) * BANDS)
                bands = pa.ListArray.from_arrays(pa.array(off), pa.array(bands_of(sig).ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0)[first:stop], pa.array(sketch, pa.binary()), bands], names=["id", "sketch", "bands"])

    return docs.select("id", "text").mapInArrow(run, "id long, sketch binary, bands array<long>")


def _more_samples(docs: DataFrame, ids: DataFrame, idf: Idf) -> DataFrame:
    """(id, more): further samples of the texts of ``ids``, all of which have words."""
    held = docs.sparkSession.sparkContext.broadcast(idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for whole in batches for x in _sliced(whole)):
            for first, stop, h, tf, n in _features(b.column(1).to_pylist()):
                sketch = _sketch(samples(h, levels(h, tf, held.value), n, _MULTIPLIERS[SAMPLES:]))
                yield pa.RecordBatch.from_arrays([b.column(0)[first:stop], pa.array([x.tobytes() for x in sketch], pa.binary())], names=["id", "more"])

    own = docs.select("id", "text").join(if_small(ids, 16), "id", "left_semi")
    return own.mapInArrow(run, "id long, more binary").dropDuplicates(["id"])


@F.pandas_udf(T.IntegerType())
def _agreement(a, b):
    """Samples in which two sketches agree."""
    import pandas as pd

    if not len(a):
        return pd.Series([], dtype="int32")
    x, y = (np.frombuffer(b"".join(s), np.uint16).reshape(len(s), SAMPLES) for s in (a, b))
    return pd.Series((x == y).sum(axis=1).astype(np.int32))


def _short(h: np.ndarray) -> np.ndarray:
    """The high 32 bits of shingle hashes: enough to tell the shingles of two texts apart, and still ascending."""
    return (h >> np.uint64(_HASH_BITS - 32)).astype(np.uint32).view(np.int32)


def weighted_jaccard(h1: np.ndarray, l1: np.ndarray, h2: np.ndarray, l2: np.ndarray) -> float:
    """Of two sets of ascending hashes with levels."""
    w1, w2 = np.exp(l1 * STEP), np.exp(l2 * STEP)
    _, i, j = np.intersect1d(h1, h2, return_indices=True)
    both = np.minimum(w1[i], w2[j]).sum()
    return float(both / (w1.sum() + w2.sum() - both))


def verify(docs: DataFrame, pairs: DataFrame, idf: Idf) -> DataFrame:
    """The pairs (a, b) whose weighted Jaccard similarity is at least ``SIMILAR``."""
    held = docs.sparkSession.sparkContext.broadcast(idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for whole in batches for x in _sliced(whole)):
            for first, stop, h, tf, n in _features(b.column(1).to_pylist()):
                lev, off = levels(h, tf, held.value).astype(np.int8), pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([b.column(0)[first:stop], pa.ListArray.from_arrays(off, pa.array(_short(h))), pa.ListArray.from_arrays(off, pa.array(lev))], names=["id", "h", "l"])

    ids = saved(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
    hot = saved(hot_keys(pairs, "a"))
    own = docs.select("id", "text").join(if_small(ids, 16), "id", "left_semi").mapInArrow(run, "id long, h array<int>, l array<byte>")
    own = saved(own.dropDuplicates(["id"]))

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c, ha, la, hb, lb = (b.column(i) for i in range(6))
            arrays = lambda x: [v.values.to_numpy() for v in x]
            good = [weighted_jaccard(*x) >= SIMILAR for x in zip(arrays(ha), arrays(la), arrays(hb), arrays(lb), strict=True)]
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(keep), c.filter(keep)], names=["a", "b"])

    left = own.select(F.col("id").alias("a"), F.col("h").alias("ha"), F.col("l").alias("la"))
    right = pairs.join(own.select(F.col("id").alias("b"), F.col("h").alias("hb"), F.col("l").alias("lb")), "b")
    with arrow_rows(docs.sparkSession, 128):
        return saved(spread_join(right, left, "a", hot).select("a", "b", "ha", "la", "hb", "lb").mapInArrow(alike, "a long, b long"))


def components(edges: DataFrame) -> DataFrame:
    """(id, label): the least id of the connected component, for every end of an edge (a, b).

    Each round hooks every node to its least neighbour, jumps twice, and contracts the edges; the edges that are left
    join labels, of which a component has half as many at most after each round.
    """
    e = saved(edges.select("a", "b").union(edges.select("b", "a")).filter("a != b").distinct())
    known = saved(e.groupBy("a").count().select(F.col("a").alias("id"), F.col("a").alias("label")))
    while not e.isEmpty():
        up = e.groupBy("a").agg(F.least("a", F.min("b")).alias("p"))
        for _ in range(2):
            up = saved(up)
            up = up.alias("x").join(up.alias("y"), F.col("x.p") == F.col("y.a")).select("x.a", F.col("y.p"))
        up = saved(up)
        known = saved(known.join(up, known["label"] == up["a"], "left").select("id", F.coalesce("p", "label").alias("label")))
        half = e.join(up, "a").select(F.col("p").alias("a"), "b")
        e = saved(half.join(up.withColumnRenamed("a", "b").withColumnRenamed("p", "q"), "b").select("a", F.col("q").alias("b")).filter("a != b").distinct())
    return known


def _compare(best: bool, n: int):
    def columns(t: pa.Table) -> tuple[np.ndarray, ...]:
        sketch = np.frombuffer(b"".join(t.column(5).to_pylist()), np.uint16).reshape(len(t), n)
        bands = t.column(6).combine_chunks().flatten().to_numpy().reshape(len(t), BANDS)
        return t.column(2).to_numpy(), t.column(3).to_numpy(), t.column(4).to_numpy(zero_copy_only=False), sketch, bands

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """(a, b, same): pairs of different label that agree in enough samples, of the texts outside a bucket's largest
        class with its members; with ``best``, for each such text only the one with which it agrees most.

        A pair that shares several buckets comes from the first of its bands alone, and from one of its ends.
        """
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]]
        if len(left) and len(right):
            bucket = left.column(0)[0].as_py()
            (i1, l1, _, s1, b1), (i2, l2, stray2, s2, b2) = columns(left), columns(right)
            m = min(n, FIRST)  # all samples are compared only where the first ones agree enough
            step = max(1, 4_000_000 // (len(i2) * m))
            for k in range(0, len(i1), step):
                same = (s1[k : k + step, None, :m] == s2[None, :, :m]).sum(axis=2, dtype=np.int32)
                same[l1[k : k + step, None] == l2[None, :]] = -1
                if best:
                    x, y = np.arange(len(same)), same.argmax(axis=1)
                    same = same[x, y]
                    good = same >= least_agreement(n)
                else:
                    x, y = np.nonzero(same >= least_agreement(m))
                    same = np.concatenate([np.zeros(0, np.int32), *((s1[k + x[j : j + 4000]] == s2[y[j : j + 4000]]).sum(axis=1, dtype=np.int32) for j in range(0, len(x), 4000))])
                    x, y, same = (z[same >= least_agreement(n)] for z in (x, y, same))
                    own = b1[k + x]
                    first = own[np.arange(len(x)), (own == b2[y]).argmax(axis=1)]
                    good = (first == bucket) & (~stray2[y] | (i1[k + x] < i2[y]))
                x, y, same = x[good], y[good], same[good]
                for column, values in zip(out, (i1[k + x], i2[y], same), strict=True):
                    column.append(values)
        return pa.table(dict(zip(("a", "b", "same"), map(np.concatenate, out), strict=True)))

    return run


def _labelled(ids: DataFrame, labels: DataFrame) -> DataFrame:
    return ids.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))


def _in_blocks(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The strays and all members of each bucket, each side in blocks of its own: every block of one side meets every block of the other once, by (bucket, stray_block, block)."""
    dealt = lambda c: F.pmod(F.xxhash64("id"), F.col(c))
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    left = own.filter("stray").withColumn("stray_block", dealt("stray_blocks")).withColumn("block", every("blocks"))
    right = own.withColumn("block", dealt("blocks")).withColumn("stray_block", every("stray_blocks"))
    # As _compare reads them. The right side has names of its own: the sides share their source.
    first, columns = ["bucket", "block"], ["id", "label", "stray", "sketch", "bands", "stray_block"]
    return left.select(*first, *columns), right.select(*(F.col(c).alias(f"{c}_") for c in [*first, *columns]))


def _across(docs: DataFrame, members: DataFrame, reps: DataFrame, labels: DataFrame, tried: DataFrame, idf: Idf, best: bool) -> DataFrame:
    """Pairs (a, b) of different classes in one bucket that still have to be verified."""
    own = _labelled(members, labels)
    sizes = own.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    open_ = sizes.groupBy("bucket").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("main"), F.sum("n").alias("n"), F.max("n").alias("most"), F.count("*").alias("classes")).filter("classes > 1")
    blocks = open_.select("bucket", "main", "n", F.ceil(F.col("n") / BLOCK).alias("blocks"), F.ceil((F.col("n") - F.col("most")) / BLOCK).alias("stray_blocks"))
    blocks = saved(blocks.withColumn("parts", F.ceil(F.col("n") / HOT_ROWS)))
    own = saved(spread_join(own, blocks.drop("parts", "n"), "bucket", blocks.filter("parts > 1")).select("bucket", "id", "label", "main", "blocks", "stray_blocks"))
    sketches, n = reps.select("id", "sketch", "bands"), SAMPLES
    if not best:
        more = saved(_more_samples(docs, saved(own.select("id").distinct()), idf))
        sketches, n = sketches.join(more, "id").select("id", F.concat("sketch", "more").alias("sketch"), "bands"), SAMPLES + MORE
    own = saved(own.join(sketches, "id").withColumn("stray", F.col("label") != F.col("main")))
    left, right = _in_blocks(own)
    found = left.groupBy("bucket", "stray_block", "block").cogroup(right.groupBy("bucket_", "stray_block_", "block_")).applyInArrow(_compare(best, n), "a long, b long, same int")
    if best:
        found = found.groupBy("a").agg(F.max_by("b", F.struct("same", -F.col("b"))).alias("b"))
    pairs = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return pairs.join(tried, ["a", "b"], "left_anti")


def node_of(text: str) -> Column:
    """The identity of a text, null as the empty one: 63 bits of its SHA-256."""
    return F.shiftrightunsigned(F.conv(F.substring(F.sha2(text_or_empty(text), 256), 1, 16), 16, -10).cast("long"), 1)


def _labels(docs: DataFrame, id_col: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(node, doc) of every row, and (node, least, label) of every distinct text: the least id of its rows and its class."""
    spark = prepare(docs.sparkSession)
    own = docs.select(node_of(text).alias("id"), F.col(id_col).cast("long").alias("doc"), text_or_empty(text).alias("text"))
    by_row = own.select(F.col("id").alias("node"), "doc")
    with scratch(spark) as keep, arrow_rows(spark, BATCH_ROWS):
        labels = _classed(own)
        by_text = keep(_labelled(by_row.groupBy(F.col("node").alias("id")).agg(F.min("doc").alias("least")), labels).select(F.col("id").alias("node"), "least", "label"))
    return by_row, by_text


def _classed(own: DataFrame) -> DataFrame:
    """(id, label) of the texts of (id, doc, text) rows that are of a class with others."""
    idf = document_frequencies(own)
    signed = _signed(own, idf)
    reps = saved(signed.groupBy("id").agg(F.min(F.struct("sketch", "bands")).alias("r")).select("id", "r.*"))
    # A bucket's head is its text of least id (null last), which is often the one that the others are copies of.
    leasts = own.groupBy("id").agg(F.coalesce(F.min("doc"), F.lit((1 << 63) - 1)).alias("least"))
    rows = saved(reps.join(leasts, "id").select("id", "least", F.explode("bands").alias("bucket")))
    heads = saved(rows.groupBy("bucket").agg(F.min(F.struct("least", "id")).alias("first"), F.count("*").alias("n")).filter("n > 1"))
    hot = heads.filter(F.col("n") > HOT_ROWS).select("bucket", F.ceil(F.col("n") / HOT_ROWS).alias("parts"))
    members = saved(spread_join(rows.drop("least"), heads.drop("n"), "bucket", hot))
    sketches = reps.select("id", "sketch")
    # For each text the head with which it shares most bands: one pair a text, whatever the size of its buckets.
    shared = members.filter("first.id != id").groupBy("id", "first").agg(F.count("*").alias("n"))
    near = saved(shared.groupBy(F.col("id").alias("b")).agg(F.min_by("first.id", F.struct(-F.col("n"), "first")).alias("a")))
    both = near.join(sketches.select(F.col("id").alias("b"), F.col("sketch").alias("sb")), "b")
    both = spread_join(both, sketches.select(F.col("id").alias("a"), F.col("sketch").alias("sa")), "a", saved(hot_keys(near, "a")))
    first = saved(both.select("a", "b", _agreement("sa", "sb").alias("same")).filter(F.col("same") >= least_agreement(SAMPLES)).select("a", "b"))
    edges = verify(own, first, idf)
    labels, tried = components(edges), first
    for best in (True, False):
        pairs = saved(_across(own, members, reps, labels, tried, idf, best))
        if pairs.isEmpty():
            continue
        more = verify(own, pairs, idf)
        tried = tried.union(pairs)
        if not more.isEmpty():
            edges = edges.union(more)
            labels = components(edges)
    return labels


def classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, class_id): the least id of each row's class of near duplicates, one row for each row of ``docs``."""
    by_row, by_text = _labels(docs, id_col, text)
    named = by_text.groupBy("label").agg(F.min("least").alias("class_id"))
    with scratch(docs.sparkSession) as keep:
        of_text, hot = keep(by_text.join(named, "label").select("node", "class_id")), keep(hot_keys(by_row, "node"))
    return spread_join(by_row, of_text, "node", hot).select(F.col("doc").alias("id"), "class_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each class of texts, one of the least id, and all of its columns.

    Any id goes before null; of several texts of a class that have the least id one stays, and of equal rows one.
    """
    node, doc, least = (tmp_name(docs.columns, c) for c in ("node", "doc", "least"))
    keyed = docs.withColumn(node, node_of(text)).withColumn(doc, F.col(id_col).cast("long"))
    by_row, by_text = _labels(docs, id_col, text)
    heads = by_text.groupBy("label").agg(F.min_by(F.struct("node", "least"), F.struct(F.col("least").isNull(), "least", "node")).alias("head"))
    with scratch(docs.sparkSession) as keep:
        head = saved(heads.select("head.*"))
        others = keep(by_text.join(head, "node", "left_anti").select(F.col("node").alias(node)))
        twice = keep(by_row.groupBy("node").count().filter("count > 1").join(head, "node").select(F.col("node").alias(node), F.col("least").alias(least)))
    once = keyed.join(if_small(others.union(twice.select(node)), 8), node, "left_anti")
    again = keyed.join(if_small(twice, 16), node).filter(F.col(doc).eqNullSafe(F.col(least))).dropDuplicates([node])
    return once.select(*docs.columns).union(again.select(*docs.columns))


def op6_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
