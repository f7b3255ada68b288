import hashlib
import random

import pytest
from pyspark.sql import functions as F

from sealmark.functions import globs as G
from sealmark.functions import hashing as H
from sealmark.functions import text as X
from sealmark.functions import when as W
from sealmark.operators import chain


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values()) or (0,)], list(values) or ["_"])
    return row.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("path", "glob", "hit"), [
    ("app", "app/*.py", True), ("src", "src/*/x.py", True), ("./app/x.py", "app/**", True), ("app\\x.py", "app/**", True), ("app/", "app", True), ("app/x.py", "app/", True), (".v4", ".v4/**", True), ("v4/c", ".v4/**", False),
    ("x.py", "**/*.py", True), ("a\nb/x.py", "a*/**", True), ("a/x.py\n", "a/*.py", False), ("brand3", "brand[!12]", True), ("brand1", "brand[!12]", False), ("a]b", "a[]]b", True), ("appx", "app/**", False), ("/", "app", False),
])
def test_what_a_wide_glob_covers(spark, path, glob, hit):
    assert one(spark, G.any_match("p", [glob]), p=path) is hit


@pytest.mark.parametrize(("glob", "path", "hit"), [
    ("src/**", "src/a/b.py", True), ("src/**", "src", True), ("src/**", "source/a", False), ("src", "src/a.py", True), ("**/x.py", "x.py", True), ("**/x.py", "a/b/x.py", True),
    ("a/*.py", "a/b/c.py", True), ("a?c", "abc", True), ("[ab].py", "b.py", True), ("[!ab].py", "b.py", False), ("a.py", "axpy", False),
])
def test_wide_glob(spark, glob, path, hit):
    assert one(spark, G.any_match("p", [glob]), p=path) is hit


@pytest.mark.parametrize(("glob", "path", "hit"), [("a/*.py", "a/b/c.py", False), ("a/*.py", "a/c.py", True), ("a/**/c.py", "a/c.py", True), ("a/**/c.py", "a/x/y/c.py", True), ("**", "a/b", True), ("a", "a/b", False)])
def test_strict_glob(spark, glob, path, hit):
    assert one(spark, G.any_match("p", [glob], strict=True), p=path) is hit


def test_layers_first_match_wins(spark):
    layers = {"core": ["a/**"], "all": ["**"]}
    assert one(spark, G.first_layer("p", layers), p="a/b") == "core"
    assert one(spark, G.first_layer("p", layers), p="z") == "all"
    assert one(spark, G.first_layer("p", {}), p="z") == ""


def test_common_dirs():
    assert G.common_dirs(["a/b/c", "a/b", "a/bc", "x/y", "x/y/z"]) == ["a/b", "a/bc", "x/y"]


def test_overlap_of_empty_text_is_zero(spark):
    t = lambda s: X.tokens(F.lit(s))
    assert one(spark, X.jaccard(t(""), t("a b"))) == 0.0
    assert one(spark, X.jaccard(t("a b c"), t("b c d"))) == 0.5
    assert one(spark, X.containment(t("a b"), t("a b c d"))) == 1.0


def test_coverage_counts_a_character_once(spark):
    rng = random.Random(5)
    for _ in range(10):
        text = "".join(rng.choice("aab ") for _ in range(rng.randint(0, 40)))
        quotes = ["".join(rng.choice("aab ") for _ in range(rng.randint(0, 4))) for _ in range(3)]
        marks = set()
        for q in quotes:
            marks |= {i + j for i in range(len(text)) if q and text.startswith(q, i) for j in range(len(q))}
        assert one(spark, X.covered(F.lit(text), F.array(*map(F.lit, quotes)))) == len(marks)


def test_redaction(spark):
    shown = one(spark, X.redact(F.lit('password = "hunter22" AKIA' + "A" * 16 + " " + "0" * 40)))
    assert shown == "password = [REDACTED] [REDACTED] [REDACTED]"


def test_identity_keeps_null_fields(spark):
    a, b = F.lit("a"), F.lit(None).cast("string")
    assert one(spark, H.short_id(a, b, a)) == hashlib.sha256(b"a\x1f\x1fa").hexdigest()[:16]
    assert one(spark, H.short_id(a, a, b)) != one(spark, H.short_id(a, b, a))


def test_length_prefix_keeps_fields_apart(spark):
    assert one(spark, H.row_hash(F.lit("ab"), F.lit("c"))) != one(spark, H.row_hash(F.lit("a"), F.lit("bc")))


def test_tree_digest_is_order_free(spark):
    rows = [("b", "2"), ("a", "1"), ("c", "3")]
    expect = hashlib.sha256("".join(f"{p}\x1f{s}\x1e" for p, s in sorted(rows)).encode()).hexdigest()
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame([("all", *r) for r in order], "area string, path string, sha string")
        assert chain.tree_digests(df, "area").first().digest == expect


def test_times(spark):
    assert one(spark, W.parsed(F.lit("nonsense"))) is None
    assert one(spark, W.gap_seconds(W.parsed(F.lit("2026-01-01T00:00:02")), W.parsed(F.lit("2026-01-01T00:00:00")))) == -2.0
    assert one(spark, W.exit_name(F.lit(7))) == "7 SUBJECT_MOVED"
    assert one(spark, W.exit_name(F.lit(99))) == "99 UNKNOWN_EXIT"


def test_words(spark):
    assert one(spark, X.word_list(F.lit("parseHTTPBody_now2Go"))) == ["parse", "httpbody", "now2", "go"]
    assert one(spark, X.own_request(F.lit("do it\n[continues t-1]\nmore"))) == "do it"
    assert one(spark, X.own_request(F.lit("[continues t-1]\nmore"))) == "[continues t-1]\nmore"
