"""Approximate nearest neighbours by largest inner product: a forest of random-projection trees.

Trees are fitted on a bounded sample (``SAMPLE`` vectors by hash of their id): each node splits its vectors at the
median of a random direction. Every vector is then put into one leaf of each tree. A query walks all trees through
one priority queue, keyed by the largest distance to a boundary crossed so far, and takes leaves until they hold
its budget of candidates. Candidates are reranked by their exact inner product in double precision.

The budget, a share of all vectors, is the least one of a ladder whose recall, measured on the sample against brute
force, reaches ``TARGET``; at a given share recall grows with the number of vectors, so the sample is the hard case.
The work is dealt by shard: neighbouring leaves of a tree up to ``SHARD`` vectors, or a part of a larger leaf, so that
neither equal vectors nor a dense region end in one task; and the queries of a shard by blocks of about ``BLOCK``, each
of which meets the shard by itself, so that a shard that many queries visit does not either. The best lists of a query
are merged in two steps, within groups of shards and then across.

Defined results: vectors that are null, zero, of another length than most, or hold null or non-finite numbers take
no part, nor do rows of null id; a query gets all candidates if there are fewer than k; ties go to the smaller id;
of rows that repeat id and vector one is returned; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sealmark.llm._common import prepare, saved, scratch, table

TREES, LEAF = 4, 128
#: Vectors that the trees are fitted on, at most.
SAMPLE = 20_000
#: Vectors that meet queries in one task, about.
SHARD = 8192
#: Queries that meet a shard in one task, about.
BLOCK = 16_384
K = 20
TARGET = 0.93
LADDER = (0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)
#: Queries on which the budget is measured.
PROBES = 100
#: No query looks at fewer candidates than this, if there are as many.
LEAST = 1000


@dataclass
class Tree:
    """Node i splits by direction i at cut i; its children are nodes if at least 0, else leaf ``-1 - child``."""

    directions: np.ndarray
    cuts: np.ndarray
    children: np.ndarray
    leaves: int

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64) if len(self.cuts) else np.full(len(x), -1)
        while (open_ := np.flatnonzero(at >= 0)).size:
            node = at[open_]
            right = np.einsum("ij,ij->i", x[open_], self.directions[node]) > self.cuts[node]
            at[open_] = self.children[node, right.astype(np.int64)]
        return -1 - at


def grow(x: np.ndarray, leaf: int, rng: np.random.Generator) -> Tree:
    """A tree over the rows of ``x`` in leaves of at most ``leaf`` of them (more where rows cannot be told apart)."""
    directions, cuts, children = [], [], []
    leaves = 0
    todo: list[tuple[np.ndarray, int, int]] = [(np.arange(len(x)), -1, 0)]
    while todo:
        rows, parent, side = todo.pop()
        made = None
        if len(rows) > leaf:
            v = rng.standard_normal(x.shape[1])
            p = x[rows] @ v
            cut = np.median(p)
            if (right := p > cut).any():
                made = len(cuts)
                directions.append(v)
                cuts.append(cut)
                children.append([0, 0])
                todo += [(rows[right], made, 1), (rows[~right], made, 0)]
        if made is None:
            made = -1 - leaves
            leaves += 1
        if parent >= 0:
            children[parent][side] = made
    return Tree(np.array(directions).reshape(-1, x.shape[1]), np.array(cuts), np.array(children, np.int64).reshape(-1, 2), leaves)


def search(trees: list[Tree], sizes: list[np.ndarray], q: np.ndarray, budget: float) -> list[tuple[int, int]]:
    """(tree, leaf) in the order in which one queue over all trees reaches them, until the leaves taken hold ``budget`` vectors."""
    margins = [t.directions @ q - t.cuts for t in trees]
    norms = [np.linalg.norm(t.directions, axis=1) for t in trees]
    away = [np.abs(m) / n for m, n in zip(margins, norms, strict=True)]
    side = [(m > 0).astype(np.int64) for m in margins]
    queue = [(0.0, t, 0 if len(tree.cuts) else -1) for t, tree in enumerate(trees)]
    taken, held = [], 0
    while queue and held < budget:
        far, t, node = heapq.heappop(queue)
        children = trees[t].children
        while node >= 0:
            near = side[t][node]
            heapq.heappush(queue, (max(far, away[t][node]), t, int(children[node, 1 - near])))
            node = int(children[node, near])
        taken.append((t, -1 - node))
        held += sizes[t][-1 - node]
    return taken


def calibrate(trees: list[Tree], x: np.ndarray, k: int, n: int, rng: np.random.Generator) -> float:
    """Least budget of the ladder, as a share of leaf entries, that reaches the target on the sample."""
    if len(x) <= k + 1:
        return 1.0
    leaf = [t.leaf_of(x) for t in trees]
    sizes = [np.bincount(own, minlength=t.leaves) for own, t in zip(leaf, trees, strict=True)]
    members = [np.split(np.argsort(own, kind="stable"), np.cumsum(s)[:-1]) for own, s in zip(leaf, sizes, strict=True)]
    probes = rng.choice(len(x), min(PROBES, len(x)), replace=False)
    found = np.zeros(len(LADDER))
    for i in probes:
        score = x @ x[i]
        score[i] = -np.inf
        best = set(np.argpartition(-score, k)[:k].tolist())
        order = search(trees, sizes, x[i], np.inf)
        held, hit, step = 0, 0, 0
        seen: set[int] = set()
        for t, own in order:
            while step < len(LADDER) and held >= LADDER[step] * len(trees) * len(x):
                found[step] += hit
                step += 1
            got = members[t][own]
            held += len(got)
            if hit < k:
                seen.update(best.intersection(got.tolist()))
                hit = len(seen)
        found[step:] += hit
    good = np.flatnonzero(found / (len(probes) * k) >= TARGET)
    return LADDER[good[0]] if len(good) else 1.0


def _plan(sizes: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """First shard and number of shards of each leaf of each tree."""
    first, parts, made = [], [], 0
    for own in sizes:
        f, p, room = np.zeros(len(own), np.int64), np.ones(len(own), np.int64), 0
        for i, n in enumerate(own):
            if n > SHARD:
                p[i] = -(-n // SHARD)
                f[i], made, room = made, made + p[i], 0
            else:
                if n > room:
                    made, room = made + 1, SHARD
                f[i], room = made - 1 if made else 0, room - n
        first.append(f)
        parts.append(p)
        made += 1
    return first, parts


def usable(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(id, v) of the rows that take part."""
    v: Column = F.col(vector).cast("array<double>")
    own = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter("id IS NOT NULL AND v IS NOT NULL")
    finite = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    own = own.filter(finite & F.exists("v", lambda x: x != 0.0))
    most = own.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return own.filter(F.size("v") == (most[0] if most else 0))


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return array.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _rerank(k: int, dim: int, groups: int):
    def run(vectors: pa.Table, probes: pa.Table) -> pa.Table:
        """Each query's k best of a shard, as one row."""
        queries, best_ids, best_scores = [], [np.zeros(0, np.int64)], [np.zeros(0)]
        shard = (vectors if len(vectors) else probes).column("shard")[0].as_py()
        if len(vectors) and len(probes):
            ids, v, leaf = vectors.column("id").to_numpy(), _matrix(vectors.column("v"), dim), vectors.column("leaf").to_numpy()
            names, place = np.unique(leaf, return_inverse=True)
            qid, q = probes.column("id").to_numpy(), _matrix(probes.column("v"), dim)
            for a in range(0, len(qid), 256):
                part = q[a : a + 256]
                scores = part @ v.T
                visited = np.zeros((len(part), len(names)), bool)
                for i, own in enumerate(probes.column("leaves")[a : a + 256].to_pylist()):
                    visited[i, np.flatnonzero(np.isin(names, own))] = True
                scores[~visited[:, place]] = -np.inf
                scores[qid[a : a + 256, None] == ids[None, :]] = -np.inf
                for i in range(len(part)):
                    row = scores[i]
                    least = np.partition(row, len(row) - k)[len(row) - k] if len(row) > k else -np.inf
                    at = np.flatnonzero((row >= least - 1e-9 * max(1.0, abs(least)) if np.isfinite(least) else True) & (row > -np.inf))
                    exact = (v[at] * part[i]).sum(axis=1)
                    best = np.lexsort((ids[at], -exact))[:k]
                    if len(best):
                        queries.append(qid[a + i])
                        best_ids.append(ids[at][best])
                        best_scores.append(exact[best])
        off = pa.array(np.cumsum([0, *map(len, best_ids[1:])]), pa.int32())
        lists = [pa.ListArray.from_arrays(off, pa.array(np.concatenate(x))) for x in (best_ids, best_scores)]
        return pa.table({"query_id": pa.array(queries, pa.int64()), "part": pa.array([shard % groups] * len(queries), pa.int32()), "ids": lists[0], "scores": lists[1]})

    return run


def nearest(vectors: DataFrame, queries: Column, k: int = K, id_col: str = "vec_id", vector: str = "embedding", trees: int = TREES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row for which ``queries``, a condition on ``id``, holds."""
    spark = prepare(vectors.sparkSession)
    with scratch(spark) as keep:
        return _nearest(vectors, queries, k, id_col, vector, trees, keep)


def _nearest(vectors: DataFrame, queries: Column, k: int, id_col: str, vector: str, trees: int, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    spark = vectors.sparkSession
    own = saved(usable(vectors, id_col, vector).dropDuplicates(["id", "v"]))
    n = own.count()
    schema = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], schema)
    share = min(1 << 30, int((1 << 30) * SAMPLE / n))
    fitted = own.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share).orderBy("id").limit(2 * SAMPLE).select("v").collect()
    x = np.array([r[0] for r in fitted]) if fitted else np.array([own.first()["v"]])
    rng = np.random.default_rng(7)
    forest = [grow(x, max(2, min(LEAF, LEAF * len(x) // n)), rng) for _ in range(trees)]
    share_of = calibrate(forest, x, k, n, rng)
    budget = max(share_of * n, LEAST) * trees
    dim = x.shape[1]
    held = spark.sparkContext.broadcast(forest)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = _matrix(b.column(1), dim)
            leaf = np.stack([t.leaf_of(v) for t in held.value]).astype(np.int32)
            off = pa.array(np.arange(len(v) + 1, dtype=np.int32) * trees)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(off, pa.array(leaf.T.ravel()))], names=["id", "v", "leaf"])

    settled = keep(own.select("id", "v").mapInArrow(settle, "id long, v array<double>, leaf array<int>"))
    placed = settled.select("id", "v", F.posexplode("leaf").alias("tree", "leaf"))
    sizes = [np.zeros(t.leaves, np.int64) for t in forest]
    for tree, leaf, count in placed.groupBy("tree", "leaf").count().collect():  # a row a leaf: bounded by the sample
        sizes[tree][leaf] = count
    first, parts = _plan(sizes)
    plan = spark.sparkContext.broadcast((sizes, first, parts))
    # The best lists of a query are merged in groups of shards first, as many as a group has shards.
    groups = max(1, math.isqrt(int(max((f + p).max() for f, p in zip(first, parts, strict=True)))))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, first, parts = plan.value
        for b in batches:
            ids, leaf = b.column(0).to_numpy(), b.column(2).flatten().to_numpy().reshape(-1, trees)
            for t in range(trees):
                shard = first[t][leaf[:, t]] + ids % parts[t][leaf[:, t]]
                yield pa.RecordBatch.from_arrays([pa.array(shard), b.column(0), b.column(1), pa.array(leaf[:, t].astype(np.int32))], names=["shard", "id", "v", "leaf"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, first, parts = plan.value
        for b in batches:
            rows: dict[str, list] = {"shard": [], "at": [], "leaves": []}
            for i, q in enumerate(_matrix(b.column(1), dim)):
                wanted: dict[int, list[int]] = {}
                for t, leaf in search(held.value, sizes, q, budget):
                    for s in range(parts[t][leaf]):
                        wanted.setdefault(int(first[t][leaf] + s), []).append(leaf)
                for s, leaves in wanted.items():
                    for name, value in zip(rows, (s, i, leaves), strict=True):
                        rows[name].append(value)
                if len(rows["at"]) > 20_000 or i == b.num_rows - 1:
                    at = pa.array(rows["at"], pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(rows["shard"], pa.int64()), b.column(0).take(at), b.column(1).take(at), pa.array(rows["leaves"], pa.list_(pa.int32()))], names=["shard", "id", "v", "leaves"])
                    rows = {name: [] for name in rows}

    members = settled.mapInArrow(deal, "shard long, id long, v array<double>, leaf int")
    asked = settled.filter(queries).select("id", "v")
    blocks = max(1, round(asked.count() * share_of / BLOCK))
    probes = asked.mapInArrow(probe, "shard long, id long, v array<double>, leaves array<int>").withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    members = members.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = members.groupBy("shard", "block").cogroup(probes.groupBy("shard", "block")).applyInArrow(_rerank(k, dim, groups), "query_id long, part int, ids array<long>, scores array<double>")
    # An entry sorts by falling score and rising id.
    entries = F.zip_with("scores", "ids", lambda s, i: F.struct((-s).alias("s"), i.alias("i")))
    best = lambda lists: F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(lists)))), 1, k).alias("best")
    merged = found.groupBy("query_id", "part").agg(best(entries)).groupBy("query_id").agg(best("best"))
    ranked = merged.select("query_id", F.posexplode("best").alias("at", "b"))
    return ranked.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.i").alias("vec_id"), (-F.col("b.s")).alias("score"))


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)
