import hashlib
import random

import pytest
from pyspark.sql import functions as F

from sealmark.operators import chain, graph


def reach(edges):
    nodes = {x for e in edges for x in e}
    out = {n: {n} for n in nodes}
    moved = True
    while moved:
        moved = False
        for a, b in edges:
            if not out[b] <= out[a]:
                out[a] |= out[b]
                moved = True
    return out


def random_edges(seed):
    r = random.Random(seed)
    return {(r.randrange(40), r.randrange(40)) for _ in range(55)} | {(100 + i, 101 + i) for i in range(6)} | {(7, 7), (200, 201), (201, 200), (300, 300)} | {(400 + i, 400 + (i + 1) % 9) for i in range(9)}


#: All in one task, some rounds first, and rounds only.
LOCAL = [graph.LOCAL_EDGES, 20, 0]


@pytest.mark.parametrize("local", LOCAL)
def test_components_against_reachability(spark, local):
    edges = random_edges(local)
    to = reach(edges)
    want = {n: min(m for m in to if m in to[n] and n in to[m]) for n in to}
    rows = graph.components(spark.createDataFrame(sorted(edges), "src long, dst long"), local_edges=local).collect()
    assert len(rows) == len(want) and {x.node: x.component for x in rows} == want


def test_components_of_dense_graphs_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(graph, "WORTH", 2)  # nothing is taken out
    r = random.Random(4)
    edges = {(r.randrange(25), r.randrange(25)) for _ in range(40)}
    to = reach(edges)
    df = spark.createDataFrame(sorted(edges), "src long, dst long")
    assert {x.node: x.component for x in graph.components(df, local_edges=0).collect()} == {n: min(m for m in to if m in to[n] and n in to[m]) for n in to}
    paths = {(a, c) for a, b in edges for c in to[b]}
    assert {(x.of, x.node) for x in graph.reached(df.select(F.col("src").alias("of")), df, local_edges=0).collect()} == paths


def test_components_without_edges(spark):
    assert graph.components(spark.createDataFrame([], "src long, dst long")).count() == 0
    assert [tuple(x) for x in graph.components(spark.createDataFrame([(3, 3)], "src long, dst long")).collect()] == [(3, 3)]


def test_names_of_nodes_may_be_texts(spark):
    edges = spark.createDataFrame([("b", "a"), ("a", "b"), ("b", "é"), ("é", None)], "src string, dst string")
    got = {tuple(x) for x in graph.components(edges.filter("dst IS NOT NULL")).collect()}
    assert got == {("a", "a"), ("b", "a"), ("é", "é")}
    assert {tuple(x) for x in graph.reached(spark.createDataFrame([("a",), (None,), ("none",)], "of string"), edges).collect()} == {("a", "a"), ("a", "b"), ("a", "é")}


@pytest.mark.parametrize("local", LOCAL)
def test_reached_and_closure(spark, local):
    edges = random_edges(local + 1)
    to, df = reach(edges), spark.createDataFrame(sorted(edges), "src long, dst long")
    paths = {(a, c) for a, b in edges for c in to[b]}
    starts = [0, 3, 7, 100, 200, 300, 404, 999]
    got = [tuple(x) for x in graph.reached(spark.createDataFrame([(s,) for s in starts + [3]], "of long"), df, local_edges=local).collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a, b in paths if a in starts}
    if local:
        got = [tuple(x) for x in graph.closure(df, local_edges=local).collect()]
        assert len(got) == len(set(got)) and set(got) == paths


@pytest.mark.parametrize("local", LOCAL)
def test_ancestors(spark, local):
    edges = spark.createDataFrame([(1, 2), (2, 3), (4, 3), (3, 1)] + [(10 + i, 11 + i) for i in range(30)], "src long, dst long")
    pairs = spark.createDataFrame([(1, 3), (1, 4), (4, 1), (5, 5), (2, 2), (10, 40), (12, 11), (20, 30)], "of long, node long")
    assert sorted(tuple(x) for x in graph.ancestors(pairs, edges, local_edges=local).collect()) == [(1, 3), (2, 2), (4, 1), (5, 5), (10, 40), (20, 30)]


@pytest.mark.parametrize("local, worth, by, to_", [(graph.LOCAL_EDGES, 0.05, 1, 1), (90, 0.05, 1, 2), (0, 2, 2, 1)])
def test_ancestors_of_more_starts_than_a_block(spark, monkeypatch, local, worth, by, to_):
    monkeypatch.setattr(graph, "WORTH", worth)
    monkeypatch.setattr(graph, "STARTS", 128)
    r = random.Random(9)
    edges = {(r.randrange(150), r.randrange(150)) for _ in range(170)} | {(i, i) for i in range(5)}
    to = reach(edges)
    df = spark.createDataFrame(sorted(edges), "src long, dst long")
    asked = [(a, b) for a in range(0, 160, by) for b in range(0, 160, to_) if (a + b) % 3]
    want = [(a, b) for a, b in asked if a == b or b in to.get(a, ())]
    got = graph.ancestors(spark.createDataFrame(asked, "of long, node long"), df, local_edges=local).collect()
    assert sorted(tuple(x) for x in got) == want


def test_ancestors_hold_a_row_a_node_and_not_a_pair(spark, monkeypatch):
    n, rows = 3000, []
    edges = spark.range(1, n).select(F.col("id").alias("src"), F.explode(F.array(F.floor(F.col("id") / 2), F.floor(F.col("id") / 3))).alias("dst")).distinct()
    asked = [(i, i % 50) for i in range(n)]
    settle = graph.settle
    monkeypatch.setattr(graph, "settle", lambda df: rows.append((out := settle(df)).count()) or out)
    got = graph.ancestors(spark.createDataFrame(asked, "of long, node long"), edges, local_edges=500)
    assert 1000 < got.count() < n and max(rows) <= 2 * n


def jobs(spark, name, f):
    spark.sparkContext.setJobGroup(name, name)
    out = f().collect()
    n = len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, n


def test_rings_and_chains_of_any_length_take_few_jobs(spark):
    n = 100_000
    ring = spark.range(n).select(F.col("id").alias("src"), ((F.col("id") + 1) % n).alias("dst"))
    got, k = jobs(spark, "ring", lambda: graph.components(ring))
    assert len(got) == n and {x.component for x in got} == {0} and k <= 40
    chain_ = ring.filter("dst > src")
    pairs = spark.createDataFrame([(0, n - 1), (n - 1, 0), (5, 4), (4, 5)], "of long, node long")
    got, k = jobs(spark, "chain", lambda: graph.ancestors(pairs, chain_))
    assert sorted(tuple(x) for x in got) == [(0, n - 1), (4, 5)] and k <= 40


def test_rounds_grow_with_the_logarithm_of_a_ring(spark):
    def rounds(n):
        ring = spark.range(n).select(F.col("id").alias("src"), ((F.col("id") + 1) % n).alias("dst"))
        return len(graph._smaller(ring, None, 50)[0])

    assert rounds(6400) <= rounds(400) + 12


def test_nodes_that_all_are_asked_for_are_taken_out_too(spark):
    chain_ = spark.range(300).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    rounds, _, left, *_ = graph._smaller(chain_, chain_.select(F.col("src").alias("node")), 100)
    assert left <= 100 and len(rounds) <= 6


def test_no_table_of_a_round_goes_through_the_driver(spark, monkeypatch):
    plans, settle = [], graph.settle

    def kept(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return settle(df)

    monkeypatch.setattr(graph, "settle", kept)
    edges = spark.range(8).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    files = spark.range(9).select(F.col("id").alias("node"), F.col("id").cast("string").alias("path"), F.lit("s").alias("sha"))
    got = graph.digests_of_reached(edges.select(F.col("src").alias("of")), edges, files, local_edges=6).collect()
    assert {x.of: x.n for x in got} == {str(i): 9 - i for i in range(8)}
    assert plans and not any("BroadcastExchange" in p for p in plans)


def test_tables_of_rounds_are_deleted(spark):
    import os

    at = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    before = {x for x in os.listdir(at) if x.startswith("settled-")}
    graph.components(spark.createDataFrame(sorted(random_edges(3)), "src long, dst long"), local_edges=10).collect()
    assert len({x for x in os.listdir(at) if x.startswith("settled-")} - before) == 1


def test_digests_of_what_is_reached(spark):
    edges = {(0, 1), (1, 2), (2, 1), (3, 9)}
    files = {0: ("b.py", "s0"), 1: ("a.py", "s1"), 2: ("c.py", "s2"), 3: ("d.py", "s3")}
    got = {x.of: (x.digest, x.n) for x in graph.digests_of_reached(spark.createDataFrame([(0,), (3,), (2,), (77,)], "of long"), spark.createDataFrame(sorted(edges), "src long, dst long"), spark.createDataFrame([(k, *v) for k, v in files.items()], "node long, path string, sha string")).collect()}
    text = lambda nodes: hashlib.sha256("".join(f"{p}\x1f{s}\x1e" for p, s in sorted(files[n] for n in nodes)).encode()).hexdigest()
    assert got == {"0": (text([0, 1, 2]), 3), "2": (text([1, 2]), 2), "3": (text([3]), 1)}


def test_segments_commit_to_order_and_content(spark):
    rows = spark.range(25).select("id", (F.col("id") * 3).cast("string").alias("v"))
    cut, heads = chain.build_segments(rows, ["id", "v"], "s", width=10)
    assert chain.walk(cut, ["id", "v"], chain="segment").count() == 0
    assert [(x.level, x.segment, x.n, x.last_id) for x in heads.orderBy("level", "segment").collect()] == [(0, 0, 10, 9), (0, 1, 10, 19), (0, 2, 5, 24), (1, 0, 25, 24)]
    assert chain.root(heads)[:2] == (25, 24) and chain.root(heads) == chain.root(chain.heads_of(cut, "s", 10))
    other = chain.root(chain.heads_of(chain.build_segments(rows.withColumn("v", F.when(F.col("id") == 3, "x").otherwise(F.col("v"))), ["id", "v"], "s", width=10)[0], "s", 10))
    assert other[:2] == (25, 24) and other != chain.root(heads)
    lost = cut.filter("id != 12")
    assert [tuple(x) for x in chain.walk(lost, ["id", "v"], chain="segment").collect()] == [(13, "broken")]
    forked = cut.withColumn("prev_hash", F.when(F.col("id") == 5, "").otherwise(F.col("prev_hash")))
    assert sorted(tuple(x) for x in chain.walk(forked, ["id", "v"], chain="segment").collect()) == [(5, "hash")]


def test_streamed_tree_digest_is_the_gathered_one(spark):
    rows = spark.createDataFrame([("a", "x/é", "1"), ("a", "x", "2"), ("a", None, "3"), ("b", "y", None), (None, "z", "4"), ("b", "y", "5"), ("a", "x", "2")], "area string, path string, sha string")
    want, by = {}, {}
    for x in rows.collect():
        by.setdefault(x.area, []).append((x.path, x.sha))
    for area, pairs in by.items():
        text = "".join(f"{p}\x1f{s}\x1e" for p, s in sorted(x for x in pairs if None not in x))
        want[area] = (hashlib.sha256(text.encode()).hexdigest(), len(pairs))
    assert {x.area: (x.digest, x.n) for x in chain.tree_digests(rows, "area").collect()} == want
    assert chain.tree_digests(rows.filter("area = 'none'"), "area").count() == 0


def test_appends_go_on_from_the_tip_that_they_saw(spark):
    rows = spark.range(70).filter("id % 9 != 4").select("id", (F.col("id") * 3).cast("string").alias("v"))
    fields, end = ["id", "v"], lambda cut: chain.root(chain.heads_of(cut, "s", 4))
    whole, _ = chain.build_segments(rows, fields, "s", width=4)
    cut, _ = chain.build_segments(rows.filter("id < 6"), fields, "s", width=4)
    for low, high in ((6, 7), (7, 33), (33, 70)):
        seen = end(cut)
        cut = cut.unionByName(chain.extend(cut, rows.filter(f"id >= {low} AND id < {high}"), fields, "s", seen, width=4))
    assert end(cut) == end(whole) and chain.walk(cut, fields, chain="segment").count() == 0
    assert sorted(tuple(x) for x in cut.select("id", "row_hash").collect()) == sorted(tuple(x) for x in whole.select("id", "row_hash").collect())
    with pytest.raises(chain.StaleTip, match="rows"):
        chain.extend(cut, rows.filter("id = 69"), fields, "s", seen, width=4)
    with pytest.raises(chain.StaleTip, match="come after"):
        chain.extend(cut, rows.filter("id = 69"), fields, "s", end(cut), width=4)
    n, last, _ = end(cut)
    with pytest.raises(chain.StaleTip, match="head"):
        chain.extend(cut, rows.filter("id > 100"), fields, "s", (n, last, "0" * 64), width=4)


def test_appending_to_nothing_is_building(spark):
    rows = spark.range(9).select("id", F.col("id").cast("string").alias("v"))
    none, _ = chain.build_segments(rows.limit(0), ["v"], "s", width=4)
    assert chain.root(chain.heads_of(none, "s", 4)) == (0, None, "")
    got = chain.extend(none, rows, ["v"], "s", (0, None, ""), width=4)
    assert sorted(x.row_hash for x in got.collect()) == sorted(x.row_hash for x in chain.build_segments(rows, ["v"], "s", width=4)[0].collect())


def test_sums_before_each_row(spark):
    r = random.Random(6)
    rows = [(r.randrange(50), i, r.randrange(100)) for i in range(300)]
    got = {x.i: (x.before, x.place) for x in chain.running(spark.createDataFrame(rows, "a long, i long, v long"), ["a", "i"], before=F.col("v"), place=F.lit(1)).collect()}
    total = 0
    for place, (_, i, v) in enumerate(sorted(rows)):
        assert got[i] == (total, place)
        total += v
    assert chain.running(spark.createDataFrame([], "a long, v long"), ["a"], before=F.col("v")).count() == 0
