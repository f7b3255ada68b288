import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from sealmark.operators import reviews, similar


def tokens(text):
    return set(re.findall(r"[a-z_][a-z0-9_]*|[一-鿿]", (text or "").lower()))


def overlap(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def sentences(rng, n):
    words = [f"w{i}" for i in range(25)] + ["the", "of", "字", "句"]
    base = [[rng.choice(words) for _ in range(rng.randint(0, 14))] for _ in range(6)]
    out = []
    for _ in range(n):
        s = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            s.insert(rng.randint(0, len(s)), rng.choice(words))
        out.append((" ".join(s), rng.choice(["a", "b", None])))
    return out


@pytest.mark.parametrize("threshold", [0.8, 0.5, 1.0])
def test_repeats_equal_brute_force(spark, threshold):
    rng = random.Random(3)
    new, history = sentences(rng, 60) + [("The the of.", "a"), (None, "a"), ("", None)], sentences(rng, 60) + [("of THE", "b"), (None, None), ("", "a")] * 3
    want = {(s, c or "") for s, c in new if any((d or "") != (c or "") and overlap(tokens(s), tokens(t)) > threshold for t, d in history)}
    df = lambda rows: spark.createDataFrame(rows, "sentence string, about string")
    got = [tuple(r) for r in similar.repeated(df(new), df(history), threshold).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert want or threshold == 1.0
    assert similar.repeated(df(new), df([]), threshold).count() == 0 and similar.repeated(df([]), df(history), threshold).count() == 0


def test_seven_reasons_in_order(spark):
    rows = [
        ("Why is it so?", "a"), (" ", "a"), ("short", "a"), ("nothing of the matter here", "a"), ("parser has token = abcdefgh12", "a"), ("parser rule is this one", "a"), ("parser splits every long line it meets", "a"),
        ("parser splits every long line it meets", "b"), ("parser splits every long line", "a"), (None, "a"),
    ]
    df = spark.createDataFrame([(i, s, "Why is it so?  ", "src/parser.py of", c) for i, (s, c) in enumerate(rows)], "id int, sentence string, template string, subject string, about string")
    history = spark.createDataFrame([("Parser splits every long line it meets!", "b")], "sentence string, about string")
    got = {r.id: r.refusal for r in reviews.judged_over_history(df, history, F.array(F.lit("rule this")), 8, 0.8).collect()}
    assert [got[i] for i in range(len(rows))] == ["restated", "empty", "short", "off subject", "credential", "recited", "repeated", None, None, "empty"]


def matches(pattern, dotted):
    if pattern.startswith("."):
        return "." in dotted and ("." + dotted).endswith(pattern)
    return dotted == pattern or dotted.endswith("." + pattern)


@pytest.mark.parametrize("block", [similar.BLOCK_BYTES, 12])
def test_vocabulary_equals_brute_force(spark, block):
    rng = random.Random(9)
    names = [".".join(rng.choice(["a", "b", "send", "x1"]) for _ in range(rng.randint(1, 4))) for _ in range(40)]
    lines = ["".join(rng.choice("ab.[ x(1") for _ in range(rng.randint(0, 12))) for _ in range(40)]
    rows = [(i, n, line) for i, (n, line) in enumerate(zip(names, lines, strict=True))] + [(90, None, None), (91, "", "")]
    symbols = {".".join(rng.choice(["", "a", "b", "send"]) for _ in range(rng.randint(1, 3))) for _ in range(25)} - {"", ".", "..", "..."}
    symbols = {s for s in symbols if ".." not in s and not s.endswith(".")}
    expressions = ["a", "ab", "a+b", "ab?", r"\.", r"a\.", "[ab]x", "(a|x)1", "(?i)AB", "^a", "x$", "a.b", "a{2}", "ab{0}x", "", "b(x)1", r"\w1", "x*ab*"]
    facts = [(s, "symbol") for s in symbols] + [(e, "regex") for e in expressions] + [("a", "symbol"), ("a", "regex"), (None, "regex"), ("a", "other"), ("a", None)]
    want = {(i, "symbol", p) for i, n, _ in rows if n is not None for p in symbols | {"a"} if matches(p, n)}
    want |= {(i, "regex", e) for i, _, line in rows if line is not None for e in expressions if re.search(e, line)}
    got = [tuple(r) for r in similar.vocabulary_hits(spark.createDataFrame(rows, "id long, name string, line string"), spark.createDataFrame(facts, "pattern string, match string"), block).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_required_characters_are_in_every_match():
    assert [similar.required(e) for e in ("abc", "ab?c", "a(bc)d", "x{2}yz", r"re\.post\(", "a|b", "[abc]de", r"\d+km", "[]]ab", "")] == ["abc", "a", "a", "yz", "re.post(", "", "de", "km", "ab", ""]
    rng = random.Random(1)
    for _ in range(3000):
        e = "".join(rng.choice(["a", "b", "c", ".", "?", "*", "+", "(", ")", "[ab]", "[^a]", "\\.", "\\d", "{1,2}", "^", "$"]) for _ in range(rng.randint(1, 6)))
        try:
            r = re.compile(e)
        except re.error:
            continue
        for t in map("".join, itertools.product("abc.1", repeat=3)):
            if r.search(t):
                assert similar.required(e) in t, (e, t)


def test_the_plan_does_not_grow_with_the_vocabulary(spark):
    rows = spark.createDataFrame([(1, "a.b", "x")], "id long, name string, line string")
    size = lambda n: len(similar.vocabulary_hits(rows, spark.range(n).select(F.concat(F.lit("p"), F.col("id")).alias("pattern"), F.lit("regex").alias("match")))._jdf.queryExecution().optimizedPlan().toString().splitlines())
    assert size(10) == size(1000)


def test_an_expression_is_sought_by_what_few_others_share():
    block = [f"large_.*{i}$" for i in range(100)] + ["large_", "[a-z]x?"]
    by, always = similar.sought(block)
    assert always == [101] and max(len(w) for w in by.values()) == 1 and by["7"] == [7] and by["large_"] == [100]


def test_an_expression_that_is_none_fails(spark):
    rows = spark.createDataFrame([(1, "a", "b")], "id long, name string, line string")
    with pytest.raises(Exception, match="unterminated|missing"):
        similar.vocabulary_hits(rows, spark.createDataFrame([("zz(", "regex")], "pattern string, match string")).collect()
