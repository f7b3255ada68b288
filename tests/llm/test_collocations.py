import random
import re
from collections import Counter

import pytest

from sealmark.llm import collocations

SCHEMA = "doc_id long, text string, lang string, phrase string, words int, n long, shard long"  # columns that clash with the operator's own


def pieces(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [[w for w in re.split("[ \t]+", p) if w] for p in re.split("[.,;:!?\x0a-\x0d]", low)]


def counted(rows, most=3):
    f = {}
    for text, lang in rows:
        c = f.setdefault(lang or "und" if lang is None else lang, Counter())
        for ws in pieces(text):
            for d in range(1, most + 1):
                c.update(tuple(ws[i : i + d]) for i in range(len(ws) - d + 1))
    return f


def expected(rows, least=10, top=2000, most=3):
    out = []
    for lang, f in counted(rows, most).items():
        n = sum(v for k, v in f.items() if len(k) == 1)
        candidates = {k: a for k, a in f.items() if len(k) > 1 and a >= least}
        best = []
        for w, a in candidates.items():
            if any(len(v) > len(w) and 100 * b >= 50 * a and any(v[i : i + len(w)] == w for i in range(len(v))) for v, b in candidates.items()):
                continue
            score, k = min((10**6 * a * a // (f[w[:k]] * f[w[k:]]), k) for k in range(1, len(w)))
            best.append((-score, -a, " ".join(w).encode(), f[w[:k]], f[w[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(best)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "p", 1, 2, 3) for i, (t, lang) in enumerate(rows)], SCHEMA)


def answers(spark, rows, **kw):
    counts = collocations.phrase_counts(frame(spark, rows).repartition(3, "doc_id") if len(rows) > 3 else frame(spark, rows), **kw)
    return sorted(tuple(r) for r in collocations.collocations(counts).collect())


def random_text(rng, n):
    vocabulary = ["a", "B", "b", "cat", "Übel", "übel", "\xa0", "中", "x.y", "dog,", "e\te", "f\n", "g  ", ";", "no-end"]
    return " ".join(rng.choice(vocabulary) for _ in range(n))


def rows_of(seed, n=60):
    rng = random.Random(seed)
    rows = [(random_text(rng, rng.randint(0, 60)), rng.choice(["en", "de", None, "und", ""])) for _ in range(n)]
    rows += [(None, "en"), ("", None), (" \t ", "en"), ("...", "de"), ("same same same", "en")] + [("the very same line. The very", "fr")] * 30
    return rows + [(random_text(rng, 4000), "en"), ("ab " * 5000, "de"), ("w" * 3000 + " " + "v" * 100, None)]


@pytest.mark.parametrize("shard", [collocations.SHARD, 500])
def test_phrases_equal_brute_force(spark, shard):
    rows = rows_of(2)
    want = expected(rows)
    assert len({x[0] for x in want}) >= 4 and len(want) > 50
    assert answers(spark, rows, shard=shard) == want


def test_long_texts_are_counted_over_the_ends_of_their_parts():
    rng = random.Random(4)
    text = random_text(rng, 900).encode()
    whole = collocations.Shard([("en", text, len(text))])
    for size in (1, 7, 100):
        cut = list(collocations.parts(text, size, 3))
        assert len(cut) > 3 and sum(own for _, own in cut) == len(text)
        total = Counter()
        for part, own in cut:
            s = collocations.Shard([("en", part, own)])
            for _, _, phrase, n in s.phrases(s.counts > 0):
                total.update(dict(zip(phrase.to_pylist(), n.tolist(), strict=True)))
        want = Counter()
        for _, _, phrase, n in whole.phrases(whole.counts > 0):
            want.update(dict(zip(phrase.to_pylist(), n.tolist(), strict=True)))
        assert total == want and sum(whole.totals.values()) == sum(len(p) for p in pieces(text.decode()))


def test_phrases_of_other_lengths(spark):
    rows = rows_of(6, 30)
    counts = collocations.phrase_counts(frame(spark, rows), most=5, least=4)
    got = {(r.lang, r.phrase): r.n for r in counts.filter("words > 0").collect()}
    assert got == {(lang, " ".join(k)): n for lang, f in counted(rows, 5).items() for k, n in f.items() if n >= 4}


def test_hashes_that_meet_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(collocations, "mix", lambda x: x & collocations.np.uint64(7))  # in this process: the shards of the driver only
    rows = rows_of(9, 10)
    s = collocations.Shard([(lang or "und", (t or "").encode(), len((t or "").encode())) for t, lang in rows])
    order, block, low = collocations._split(s.hashes, 1)
    assert len(set(low.tolist())) <= 8 and len(order) == len(s.hashes)


def test_products_beyond_64_bits(spark):
    n = 3_000_000_000
    rows = [("en", 0, "", 9 * n), ("en", 1, "a", n), ("en", 1, "b", n), ("en", 2, "a b", n - 1), ("en", 1, "c", n), ("en", 2, "b c", 7), ("en", 3, "a b c", 7)]
    counts = spark.createDataFrame(rows, "lang string, words int, phrase string, n long")
    got = {r.phrase: (r.score, r.l, r.r) for r in collocations.collocations(counts).collect()}
    assert got == {"a b": (10**6 * (n - 1) ** 2 // n**2, n, n), "a b c": (0, n, 7)}  # both cuts floor to 0


def test_no_rows(spark):
    assert answers(spark, []) == [] and answers(spark, [(None, None)]) == []


def test_another_order_of_the_input_fails_loudly():
    run = collocations._counted(3, 1)
    import pyarrow as pa

    answers_ = pa.table({"shard": pa.array([0], pa.int64()), "block": pa.array([0], pa.int64()), "bits": pa.array([b"\x00"], pa.binary()), "n": pa.array([1], pa.int64()), "crc": pa.array([5], pa.int64())})
    texts = pa.table({"shard": pa.array([0], pa.int64()), "lang": ["en"], "text": pa.array([b"a b"], pa.binary()), "own": pa.array([3], pa.int64())})
    with pytest.raises(ValueError, match="same order"):
        run(answers_, texts)
