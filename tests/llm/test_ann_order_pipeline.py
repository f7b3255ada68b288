import hashlib
import math
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sealmark.llm import ann, order_minhash

SF = "/root/testdata/sf0.001"


def brute_nearest(ids, x, queries, k):
    out = {}
    for i in queries:
        q = x[ids.index(i)]
        out[i] = sorted(((-(q * v).sum(), j) for j, v in zip(ids, x, strict=True) if j != i))[:k]
    return out


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((40, 16))
    x = centres[rng.integers(0, 40, 6000)] + 0.3 * rng.standard_normal((6000, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got: dict[int, list] = {}
    for r in ann.nearest(df, F.col("id") % 100 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = brute_nearest(list(range(6000)), x, range(0, 6000, 100), 20)
    hit = 0
    for q, rows in got.items():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, 21))
        assert [(-s, v) for _, v, s in rows] == sorted((-s, v) for _, v, s in rows)
        assert all(s == pytest.approx(float((x[q] * x[v]).sum()), abs=1e-12) for _, v, s in rows)
        hit += len({v for _, v, _ in rows} & {j for _, j in want[q]})
    assert len(got) == 60 and hit / 1200 >= 0.9


def test_odd_vectors_ties_and_repeats(spark):
    nan, inf = math.nan, math.inf
    rows = [(i, [1.0, 0.0] if i % 3 else [0.0, 1.0], None) for i in range(60)]
    rows += [(100, None, "x"), (120, [0.0, 0.0], "x"), (140, [nan, 1.0], "x"), (160, [inf, 1.0], "x"), (180, [1.0, None], "x"), (200, [1.0], "x"), (220, [], "x"), (None, [1.0, 0.0], "x"), (20, [1.0, 0.0], "again")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id string")
    got = ann.nearest(df, F.col("id") % 20 == 0).collect()
    assert {r.query_id for r in got} == {0, 20, 40}
    same = [i for i in range(60) if i % 3 and i != 20]
    assert [r.vec_id for r in sorted((r for r in got if r.query_id == 20), key=lambda r: r["rank"])] == same[:20]
    assert ann.nearest(df.limit(0), F.col("id") % 20 == 0).count() == 0
    few = ann.nearest(df.filter("vec_id < 5"), F.col("id") == 0).collect()
    assert [r.vec_id for r in sorted(few, key=lambda r: r["rank"])] == [3, 1, 2, 4]


def test_blocks_of_queries_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.standard_normal((3000, 8)))], "vec_id long, embedding array<double>")
    rows = lambda: sorted(tuple(r) for r in ann.nearest(df, F.col("id") % 3 == 0).collect())
    whole = rows()
    monkeypatch.setattr(ann, "BLOCK", 100)
    monkeypatch.setattr(ann, "SHARD", 500)
    assert rows() == whole


def test_large_leaves_are_dealt_to_several_shards():
    first, parts = ann._plan([np.array([10, 3 * ann.SHARD + 1, 5, ann.SHARD, 1]), np.array([7])])
    used = [range(a, a + n) for f, p in zip(first, parts, strict=True) for a, n in zip(f.tolist(), p.tolist(), strict=True)]
    assert [len(u) for u in used] == [1, 4, 1, 1, 1, 1]
    assert not set(used[1]) & {i for j, u in enumerate(used) if j != 1 for i in u}
    assert used[5][0] not in {i for u in used[:5] for i in u}


def test_query_recall_on_the_table(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    ids, x = [r.vec_id for r in df], np.array([r.embedding for r in df], float)
    want = brute_nearest(ids, x, [i for i in ids if i % 20 == 0], 20)
    got = Counter((r.query_id, r.vec_id) for r in ann.op2_nearest(spark, SF).collect())
    assert set(got.values()) == {1}
    assert sum((q, j) in got for q, js in want.items() for _, j in js) >= 0.9 * sum(map(len, want.values()))


# --- order MinHash -----------------------------------------------------------------------------


def test_occurrences_are_numbered_in_text_order(spark):
    """Against the definition: the same items, buckets and tuples from plain Python, with hashes asked of Spark."""
    import re

    rng = random.Random(3)
    texts = ["", "a", "a a a a a a a a a", "x y " * 300, *(" ".join(rng.choice("abc") for _ in range(rng.randint(1, 200))) for _ in range(15)), "中" * 150 + "文" * 40]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r.id: r.sig for r in order_minhash.with_signature(df, "text", "sig").collect()}
    k, mask, bits = order_minhash.K, (1 << 36) - 1, order_minhash.BITS
    tokens = {i: list(t) if re.search(r"\S{101}", t) else re.split(r"\s+", t) for i, t in enumerate(texts)}
    grams = sorted({tuple(w[i : i + k]) for w in tokens.values() for i in range(len(w))})
    h = {g: r for g, r in zip(grams, (x[0] & mask for x in spark.createDataFrame([(j, [*g, *[None] * (k - len(g))]) for j, g in enumerate(grams)], "j int, g array<string>").orderBy("j").select(F.expr("xxhash64(g[0], g[1], g[2])")).collect()), strict=True)}
    items = {}
    for i, w in tokens.items():
        count: Counter = Counter()
        own = []
        for pos in range(len(w)):
            g = h[tuple(w[pos : pos + k])]
            own.append((g, count[g], pos))
            count[g] += 1
        items[i] = own
    flat = sorted({x[:2] for own in items.values() for x in own})
    rehash = {x: r[0] & mask for x, r in zip(flat, spark.createDataFrame([(j, *x) for j, x in enumerate(flat)], "j int, h long, o int").orderBy("j").select(F.expr("xxhash64(h, o)")).collect(), strict=True)}
    rows = []
    for i, own in items.items():
        circle = sorted((rehash[g, o], pos) for g, o, pos in own)
        for start in range(1 << bits):
            after = [x for x in circle if x[0] >= start << (36 - bits)] + [x for x in circle if x[0] < start << (36 - bits)]
            rows.append((i, start, [v for v, _ in sorted(after[: order_minhash.TUPLE], key=lambda y: y[1])]))
    hashed = spark.createDataFrame([(j, *r) for j, r in enumerate(rows)], "j int, id long, b long, t array<long>").orderBy("j").select("id", F.expr("xxhash64(t) & 4294967295L")).collect()
    want: dict[int, list] = {i: [] for i in tokens}
    for i, s in hashed:
        want[i].append(s)
    assert got == want


def test_moving_a_passage_changes_more_than_a_set_would(spark):
    rng = random.Random(8)
    w = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    rows = [(0, " ".join(w)), (1, " ".join(w[:200] + w[201:])), (2, " ".join(w[200:] + w[:200])), (3, " ".join(w))]
    df = order_minhash.with_signature(spark.createDataFrame(rows, "id long, text string"), "text", "s")
    sig = {r.id: r.s for r in df.collect()}
    same = lambda a, b: sum(x == y for x, y in zip(sig[a], sig[b], strict=True))
    assert sig[0] == sig[3] and same(0, 1) > 50 and same(0, 2) < 45


def test_order_counts_in_short_texts(spark):
    """Swapped halves have nearly the same k-mers, yet about half of the likeness, from 20 words on."""
    rng = random.Random(18)
    rows, near = [], {}
    for n in (20, 40, 80, 2000):
        for _ in range(12):
            w = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n)]
            rows += [(len(rows), " ".join(w)), (len(rows) + 1, " ".join(w[n // 2 :] + w[: n // 2]))]
    df = order_minhash.with_signature(spark.createDataFrame(rows, "id long, text string"), "text", "s")
    sig = {r.id: r.s for r in df.collect()}
    grams = lambda t: {tuple(t.split()[i : i + order_minhash.K]) for i in range(len(t.split()))}
    for i in range(0, len(rows), 2):
        a, b = grams(rows[i][1]), grams(rows[i + 1][1])
        near.setdefault(len(rows[i][1].split()), []).append((sum(x == y for x, y in zip(sig[i], sig[i + 1], strict=True)) / 64, len(a & b) / len(a | b)))
    for n, pairs in near.items():
        assert np.mean([x for x, _ in pairs]) < 0.62 and np.mean([x for x, _ in pairs]) < np.mean([y for _, y in pairs]) - 0.05, (n, pairs)


def test_a_long_run_is_cut_where_it_stands(spark):
    rng = random.Random(12)
    w = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(2000)]
    added = lambda x: " ".join(w[:900] + [x] + w[900:])
    run = "".join(rng.choice("abcdefgh0123456789") for _ in range(110))
    rows = [(0, " ".join(w)), (1, added(run[:50])), (2, added(run)), (3, added(" ".join(run))), (4, run), (5, run[::-1])]
    df = order_minhash.with_signature(spark.createDataFrame(rows, "id long, text string"), "text", "s")
    sig = {r.id: r.s for r in df.collect()}
    same = lambda a, b: sum(x == y for x, y in zip(sig[a], sig[b], strict=True))
    assert same(0, 1) > 55 and same(0, 2) > 45
    assert sig[2] == sig[3] and sig[4] != sig[5]


@pytest.mark.parametrize("range_bytes", [50, 400, 10_000_000])
def test_neighbours_and_edited_texts(spark, range_bytes):
    rng = random.Random(range_bytes)
    ids = rng.sample(range(-50, 400), 30)
    rows = [(i, rng.choice([None, "", "a", "né " * rng.randint(1, 60), "x" * 3000])) for i in ids] + [(None, "nil"), (7_000_000_000, "big")]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    got = {r.doc_id: r.next_text for r in order_minhash.with_next(df, range_bytes=range_bytes).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    assert got == {r[0]: order[(n + 1) % len(order)][1] or "" for n, r in enumerate(order)}
    assert order_minhash.with_next(df.limit(0)).count() == 0
    alone = order_minhash.with_next(df.filter("doc_id = 7000000000")).collect()
    assert [(r.text, r.next_text) for r in alone] == [("big", "big")]


def test_query_follows_its_contract(spark):
    docs = duckdb.execute(f"SELECT doc_id, coalesce(text, '') FROM '{SF}/documents.parquet' ORDER BY doc_id DESC").fetchall()
    got = {r.doc_id: r for r in order_minhash.op7_order_minhash(spark, SF).collect()}
    assert len(got) == len(docs)
    for n, (i, t) in enumerate(docs):
        nxt, half = docs[(n + 1) % len(docs)][1], len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert (r.fingerprint == r.edited_fingerprint) == (r.near_edited == 1)
    assert sum(r.near_edited > r.near_next for r in got.values()) > 0.9 * len(got)


# --- pipeline ----------------------------------------------------------------------------------


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).persist()
        assert docs.columns == columns, name
        assert 0 < docs.count() <= before
        before = docs.count()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 1024").count() == 0
    whole = corpus_pipeline.run(spark, SF)
    assert whole.select("doc_id").distinct().count() == docs.count()
    assert not docs.filter(F.col("text").rlike("(?i)token = \"[0-9a-f]{20,}")).count()


def test_pipeline_takes_odd_rows(spark, tmp_path):
    """Nulls in any column, repeated rows and ids, empty and very long texts, columns with the names of the stages' own, and no rows at all."""
    import corpus_pipeline

    rng = random.Random(51)
    text = lambda n: " ".join("".join(rng.choice("aeionst") for _ in range(rng.randint(1, 6))) for _ in range(n))
    rows = [(i, text(rng.randint(30, 200)), "a", "s", 5) for i in range(150)]
    near = rows[7][1].replace(" ", " ", 1) + " more"
    odd = [(None, None, None, None, None), (None, "", "a", None, 0), (7, rows[7][1], "a", "s", 5), (7, text(50), "a", "s", 5), (900, near, "a", "s", 5), (901, text(40_000), "a", "s", 5), (902, "token = abcdef1 " + text(60), "a", "s", 5)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    extra = ("block", "id", "key", "node", "blob", "spans", "bad_id", "row", "label", "piece", "salt", "parts")
    docs = spark.createDataFrame(rows + odd, schema)
    for name in extra:
        docs = docs.withColumn(name, F.lit("c"))
    sf = str(tmp_path)
    spark.createDataFrame([(i, 1, 0) for i in range(140)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    docs.write.parquet(f"{sf}/documents.parquet")
    state = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        state = stage(spark, state, sf).persist()
        assert state.columns == docs.columns
        assert stage(spark, docs.limit(0), sf).count() == 0
    left = state.collect()
    assert sum(r.doc_id == 7 and r.text == rows[7][1] for r in left) == 1 and not any(r.doc_id == 900 for r in left)
    assert sum(not r.text for r in left) <= 1 and not any("abcdef1" in (r.text or "") for r in left)
    assert sum(r.doc_id is not None and r.doc_id < 150 for r in left) >= 145
    packed = corpus_pipeline.run(spark, sf)
    assert packed.groupBy("doc_id").count().count() == len({r.doc_id for r in left})
    assert packed.filter("length > 1024").count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), sf).count() == 0
