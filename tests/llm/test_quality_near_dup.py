import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from sealmark.llm import near_dup, quality
from sealmark.llm._common import shingles, word_hashes

SCHEMA = "doc_id long, text string, lang string, key string, bands string, id string, label string, n long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, g, "c", "c", "c", "c", 0) for i, t, g in rows], SCHEMA)


# --- quality -----------------------------------------------------------------------------------


def brute_model(texts, order=quality.ORDER):
    """Interpolated modified Kneser-Ney by its definition, over tuples of symbols."""
    table = quality._symbols()
    seq = [[quality._MASK] * (order - 1) + [int(table[ord(c)]) for c in t] + [quality._MASK] for t in texts]
    c = {order: Counter(tuple(s[i - order + 1 : i + 1]) for s in seq for i in range(order - 1, len(s)))}
    for k in range(order - 1, 0, -1):
        c[k] = Counter(g[1:] for g in c[k + 1])
    d, ctx = {}, {k: defaultdict(list) for k in c}
    for k, counts in c.items():
        n = Counter(counts.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else None
        d[k] = [max(0.1, min(i - 0.1, i - (i + 1) * y * n[i + 1] / n[i] if y is not None and n[i] else 0.5 * i)) for i in (1, 2, 3)]
        for g, v in counts.items():
            ctx[k][g[:-1]].append(v)

    def p(gram):
        k = len(gram)
        if not k:
            return 1 / (1 << quality._B)
        own = ctx[k].get(gram[:-1])
        if own is None:
            return p(gram[1:])
        total = sum(own)
        gamma = sum(d[k][min(v, 3) - 1] for v in own) / total
        v = c[k].get(gram, 0)
        return (max(0.0, v - d[k][min(v, 3) - 1]) / total if v else 0.0) + gamma * p(gram[1:])

    def perplexity(t):
        s = [quality._MASK] * (order - 1) + [int(table[ord(x)]) for x in t] + [quality._MASK]
        logs = [math.log(p(tuple(s[i - order + 1 : i + 1]))) for i in range(order - 1, len(s))]
        return math.exp(-sum(logs) / len(logs))

    return perplexity


def words(rng, n, alphabet):
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(1, 6))) for _ in range(n))


def test_perplexity_equals_the_definition(spark):
    rng = random.Random(1)
    train = {"a": [words(rng, 30, "aeionst") for _ in range(30)], "b": [words(rng, 30, "uxyé中") for _ in range(20)]}
    docs = [(i, t, g) for i, (g, t) in enumerate((g, t) for g, ts in train.items() for t in ts)]
    probe = [(100, "", "a"), (101, None, "a"), (102, "zzz %%% ΩΩ\t9", "a"), (103, "uxy é中", "b"), (104, "x", None), (105, "same", "new"), (106, words(rng, 2000, "aeionst"), "a"), (106, "tie", "a")]
    ids = spark.createDataFrame([(i,) for i, _, _ in docs], "doc_id long")
    known = quality.model(quality.counts(frame(spark, docs), ids))
    got = quality.perplexities(frame(spark, docs + probe), known).collect()
    assert len(got) == len(docs + probe)
    brute = {g: brute_model(ts) for g, ts in train.items()}
    want = defaultdict(list)
    for i, t, g in docs + probe:
        want[i].append(None if g not in brute else brute[g](t or ""))
    for r in got:
        assert any((w is None and r.perplexity is None) or (w is not None and r.perplexity == pytest.approx(w, rel=1e-5)) for w in want[r.id]), (r, want[r.id])


def test_junk_goes_and_clean_stays(spark):
    rng = random.Random(5)
    clean = [(i, words(rng, 60, "aeionst"), "a") for i in range(300)]
    junk = [(1000 + i, words(rng, 60, "%&$#@!") , "a") for i in range(20)]
    other = [(2000, "no labels here", "x"), (2001, None, None), (2002, None, "a")]
    labels = spark.createDataFrame([(i, 1, 0) for i, _, _ in clean[:250]] + [(i, 0, 0) for i, _, _ in junk] + [(None, 1, 0), (0, 1, None)], "doc_id long, quality int, toxic int")
    df = frame(spark, clean + junk + other)
    got = {r.id: r.keep for r in quality.classify(df, labels).collect()}
    assert not any(got[i] for i, _, _ in junk) and all(got[i] for i, _, _ in clean) and got[2000] and got[2001]
    kept = quality.keep_good(df, labels)
    assert kept.columns == df.columns and kept.count() == sum(got.values())
    assert quality.classify(df.limit(0), labels).count() == 0
    assert all(r.keep for r in quality.classify(df, labels.limit(0)).collect())


def test_repetition_and_lists_go_by_length(spark):
    """Long texts of a few words, each likely for itself, fall outside the range of their length; trusted rows that no training or quantile saw stay."""
    rng = random.Random(25)
    common = [w for w in words(rng, 80, "aeionst").split() if len(w) > 2]
    text = lambda n: " ".join(rng.choice(common) for _ in range(n)) + "."
    clean = [(i, text(rng.choice((30, 150, 600))), "a") for i in range(1200)]
    junk = [(5000 + i, " ".join([rng.choice(common)] * 500), "a") for i in range(30)] + [(6000 + i, " | ".join(rng.choice(common) for _ in range(400)), "a") for i in range(30)]
    labels = spark.createDataFrame([(i, 1, 0) for i, _, _ in clean[:900]], "doc_id long, quality int, toxic int")
    got = {r.id: r.keep for r in quality.classify(frame(spark, clean + junk), labels).collect()}
    assert sum(not got[i] for i, _, _ in junk) >= 0.8 * len(junk)
    assert sum(got[i] for i, _, _ in clean[900:]) >= 0.98 * 300


def test_rows_of_null_or_repeated_id_are_judged_each(spark):
    rng = random.Random(15)
    clean = [(i, words(rng, 60, "aeionst"), "a") for i in range(200)]
    odd = [(None, words(rng, 60, "%&$#@!"), "a"), (7, words(rng, 60, "%&$#@!"), "a"), (None, words(rng, 60, "aeionst"), "a"), (None, clean[3][1], "a"), (None, None, None)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20, 200)], "doc_id long, quality int, toxic int")
    kept = quality.keep_good(frame(spark, clean + odd), labels).collect()
    assert Counter((r.doc_id, r.text) for r in kept) == Counter((i, t) for i, t, _ in clean + odd[2:])


# --- near duplicates ---------------------------------------------------------------------------


def test_word_and_shingle_hashes_follow_the_words():
    import re

    rng = random.Random(2)
    texts = ["", " ", "a", "A b. C", "é, 中文 x", *("".join(rng.choice("ab C.é\n-1") for _ in range(rng.randint(0, 60))) for _ in range(200))]
    h, n = word_hashes(texts)
    split = [re.findall(r"[a-z0-9\u0080-\U0010ffff]+", t.lower()) for t in texts]
    assert n.tolist() == [len(w) for w in split]
    by_word = {}
    for w, x in zip((w for s in split for w in s), h.tolist(), strict=True):
        assert by_word.setdefault(w, x) == x
    assert len(set(by_word.values())) == len(by_word)
    s, m = shingles(h, n, 5)
    runs = [[tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else [] for w in split]
    assert m.tolist() == [len(r) for r in runs]
    by_run = {}
    for r, x in zip((r for s in runs for r in s), s.tolist(), strict=True):
        assert by_run.setdefault(r, x) == x
    assert len(set(by_run.values())) == len(by_run)


def test_samples_agree_as_often_as_weights_overlap():
    rng = np.random.default_rng(3)
    for share in (0.3, 0.6, 0.9):
        n = 400
        h = np.sort(rng.integers(0, 1 << 52, 2 * n, np.uint64))
        both = int(n * share)
        a, b = h[:n], np.concatenate([h[:both], h[n : 2 * n - both]])
        la, lb = rng.integers(0, 30, n), rng.integers(0, 30, n)
        lb[:both] = la[:both]
        many = np.random.Generator(np.random.PCG64(9)).integers(0, 1 << 64, 2000, np.uint64, endpoint=False) | np.uint64(1)
        x, y = (near_dup.samples(k, lev, np.array([n]), many) for k, lev in ((a, la), (b, lb)))
        wa, wb = np.exp(la * near_dup.STEP), np.exp(lb * near_dup.STEP)
        shared = wa[:both].sum()
        assert (x == y).mean() == pytest.approx(shared / (wa.sum() + wb.sum() - shared), abs=0.04)


def brute_weights(texts):
    """Weights on the grid by the definition of tf and idf, from counts of all shingles."""
    df, n = Counter(), len(texts)
    for t in texts:
        for *_, h, _, _ in near_dup._features([t]):
            df.update(h.tolist())
    rare = max(1, n // near_dup.RARE)
    idf = lambda x: 1 + near_dup.IDF * min(1.0, math.log(n / max(df[x], rare)) / math.log(n / rare))
    return lambda h, tf: np.array([round((math.log(1 + math.log(k)) + math.log(idf(x))) / near_dup.STEP) for x, k in zip(h.tolist(), tf.tolist(), strict=True)], np.int64)


def brute_classes(rows):
    """Components of all pairs of weighted Jaccard similarity of at least the bound, by the same weights."""
    texts = [t or "" for _, t, _ in rows]
    feats, weight = [], brute_weights(texts)
    for t in texts:
        own = [(h, weight(h, tf)) for *_, h, tf, _ in near_dup._features([t])]
        feats.append(own[0] if own else (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            alike = texts[i] == texts[j] or rows[i][0] == rows[j][0] or (len(feats[i][0]) and len(feats[j][0]) and near_dup.weighted_jaccard(*feats[i], *feats[j]) >= near_dup.SIMILAR)
            if alike:
                a, b = sorted((root(i), root(j)))
                up[b] = a
    least = {}
    for i, (k, _, _) in enumerate(rows):
        least.setdefault(root(i), []).append(k)
    return [min((k for k in least[root(i)] if k is not None), default=None) if rows[i][0] is not None else None for i in range(len(rows))]


def near_rows(seed=4):
    rng = random.Random(seed)
    vocabulary = [words(rng, 1, "abcdefgh") for _ in range(3000)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage, rows = text(60), []
    for g in range(25):
        base = text(rng.choice([6, 40, 150, 400]))
        rows.append(base)
        for _ in range(rng.randint(0, 6)):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, len(base) // 30])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append(copy)
    rows += [text(40) + passage for _ in range(30)]
    rows += [["ha"] * 500, ["ha"] * 500, ["ha"] * 501, [], ["one"], ["ONE"]]
    rng.shuffle(rows)
    out = [(i, " ".join(r), "a") for i, r in enumerate(rows)]
    return [*out, (len(out), None, None), (len(out) + 1, "!!", None), (len(out) + 2, "!!", None), (len(out) + 3, "long " * 30_000, None), (3, out[3][1], "a")]


def test_classes_equal_brute_force(spark):
    rows = near_rows()
    got = defaultdict(set)
    for r in near_dup.classes(frame(spark, rows)).collect():
        got[r.id].add(r.class_id)
    want = brute_classes(rows)
    assert sum(len(v) for v in got.values()) == len({r[0] for r in rows})
    assert {i: {c} for (i, _, _), c in zip(rows, want, strict=True)} == got


def test_frequencies_decide_pairs(spark):
    """Two pairs share the same number of shingles; what one shares nearly all documents have, so the other alone is alike by weight."""
    rng = random.Random(26)
    vocabulary = [words(rng, 1, "abcdefgh") for _ in range(5000)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    known, own = text(89), text(89)
    rows = [known + text(10), known + text(10), own + text(10), own + text(10), *(known + text(400) for _ in range(300))]
    rows = [(i, " ".join(r), "a") for i, r in enumerate(rows)]
    grams = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for _, t, _ in rows[:4]]
    plain = lambda a, b: len(grams[a] & grams[b]) / len(grams[a] | grams[b])
    assert plain(0, 1) == pytest.approx(plain(2, 3), abs=0.01)
    got = {r.id: r.class_id for r in near_dup.classes(frame(spark, rows)).collect()}
    want = dict(zip(range(len(rows)), brute_classes(rows), strict=True))
    assert got == want and (got[0] == got[1]) != (got[2] == got[3])


def test_frequent_shingles_are_counted_exactly(spark, monkeypatch):
    """With cells so few that many shingles share one."""
    rows = near_rows(21)
    monkeypatch.setattr(near_dup, "RARE", 40)
    texts = [t or "" for _, t, _ in rows]
    idf = near_dup.document_frequencies(frame(spark, rows).selectExpr("coalesce(text, '') AS text"))
    weight = brute_weights(texts)
    for t in texts:
        for *_, h, tf, _ in near_dup._features([t]):
            assert near_dup.levels(h, tf, idf).tolist() == weight(h, tf).tolist()
    assert len(idf.shingles) <= 40 * sum(len(h) for t in texts for *_, h, _, _ in near_dup._features([t])) / len(texts)  # the bound of what is broadcast


def test_links_of_a_table_against_an_inverted_index(spark):
    """Every pair of sf0.01 that shares a shingle, compared in full: no link between different texts is missing."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    texts = [r.text or "" for r in docs]
    weight, feats, where = brute_weights(texts), [], defaultdict(list)
    for i, t in enumerate(texts):
        own = next(((h, weight(h, tf)) for *_, h, tf, _ in near_dup._features([t]) if len(h)), (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
        feats.append(own)
        for x in own[0].tolist():
            where[x].append(i)
    pairs = {(i, j) for found in where.values() for n, j in enumerate(found) for i in found[:n]}
    links = [(i, j) for i, j in pairs if min(len(feats[i][0]), len(feats[j][0])) >= 0.4 * max(len(feats[i][0]), len(feats[j][0])) and near_dup.weighted_jaccard(*feats[i], *feats[j]) >= near_dup.SIMILAR]
    got = {r.doc_id: r.class_id for r in near_dup.op6_near_dup(spark, "/root/testdata/sf0.01").collect()}
    kept = sum(got[docs[i].doc_id] == got[docs[j].doc_id] for i, j in links)
    assert len(links) > 50 and kept >= 0.99 * len(links)


def test_chains_and_cliques_of_any_shape(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(50)]
    got = {r.id: r.label for r in near_dup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    assert got == {x: root(x) for x in up if any(x in e and e[0] != e[1] for e in edges)}


def test_deduplicate_keeps_the_least_and_all_columns(spark):
    rows = near_rows(9)
    df = frame(spark, [*rows, rows[0]])
    kept = near_dup.deduplicate(df)
    want = {c for c in brute_classes(rows) if c is not None}
    assert kept.columns == df.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(want)
    assert near_dup.deduplicate(df.limit(0)).count() == 0


def test_texts_of_null_or_repeated_id_are_documents_of_their_own(spark):
    rng = random.Random(16)
    text = lambda: [words(rng, 1, "abcdefgh") for _ in range(200)]
    near = lambda t: [*t[:100], "changed", *t[101:]]
    a, b, c, d, e, f = (text() for _ in range(6))
    rows = [(None, a), (None, b), (None, near(b)), (None, c), (4, near(c)), (5, d), (5, e), (6, near(d)), (7, near(e)), (8, f), (8, f), (9, f), (None, f), (None, a)]
    rows = [(i, " ".join(t), "g") for i, t in rows]
    df = frame(spark, rows)
    assert sorted((-1 if r.id is None else r.id, -1 if r.class_id is None else r.class_id) for r in near_dup.classes(df).collect()) == sorted(
        [(-1, -1)] * 4 + [(-1, 4), (4, 4), (5, 5), (5, 5), (6, 5), (7, 5), (8, 8), (8, 8), (9, 8), (-1, 8)]
    )
    kept = [(r.doc_id, r.text) for r in near_dup.deduplicate(df).collect()]
    assert Counter(i for i, _ in kept) == Counter([None, None, 4, 5, 5, 8])
    assert {t for i, t in kept if i != 4} - {rows[1][1], rows[2][1]} == {rows[0][1], rows[5][1], rows[6][1], rows[9][1]}


def test_both_sides_are_dealt_to_blocks(spark):
    """One bucket of one class of 300 and 500 texts of classes of their own, in blocks of about 50."""
    n, size = 800, 50
    own = spark.range(n).selectExpr("7L AS bucket", "id", "IF(id < 300, 0L, id) AS label", "0L AS main", f"ceil({n} / {size}) AS blocks", f"ceil(500 / {size}) AS stray_blocks", "id >= 300 AS stray", "binary('') AS sketch", "array(7L) AS bands")
    left, right = near_dup._in_blocks(own)
    for side in (left.groupBy("bucket", "stray_block", "block"), right.groupBy("bucket_", "stray_block_", "block_")):
        held = [r["count"] for r in side.count().collect()]
        assert max(held) <= 2 * size and len(held) == 160
    on = (left["block"] == right["block_"]) & (left["stray_block"] == right["stray_block_"])
    met = left.join(right, on).select("id", "id_")
    assert met.count() == met.distinct().count() == 500 * n


def test_small_blocks_give_the_same_classes(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 3)
    rows = near_rows(11)
    got = {r.id: r.class_id for r in near_dup.classes(frame(spark, rows)).collect()}
    assert got == {i: c for (i, _, _), c in zip(rows, brute_classes(rows), strict=True)}
