import pytest
from pyspark.sql import functions as F

from sealmark.functions import hashing as H
from sealmark.functions import text as X
from sealmark.operators import code
from sealmark.operators import runs as R


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_runs_end_as_their_lenses_do(spark):
    runs = spark.createDataFrame([(1, True, None, True), (2, True, "", True), (3, False, None, True), (4, True, "why", True), (5, True, None, False), (6, True, None, True)], "run long, valid boolean, reason string, cadence boolean")
    expected = spark.createDataFrame([(r, x) for r in (1, 2, 3, 4, 5, 6) for x in "ab"], "run long, lens string")
    done = [(r, x, 1, 0, True) for r in (1, 3, 4, 5, 6) for x in "ab"] + [(2, "a", 1, 0, True), (6, "b", 2, 3, True)]
    results = spark.createDataFrame(done, "run long, lens string, id long, findings long, evaluated boolean")
    observed = spark.createDataFrame([(6, "b", "x"), (6, "b", "x"), (6, "b", "y")], "run long, lens string, claim string")
    none = spark.createDataFrame([], "run long")
    got = {r.run: (r.status, r.missing, r.advances) for r in R.finished(runs, expected, results, observed, none).collect()}
    assert got == {1: ("complete", 0, True), 2: ("partial", 1, False), 3: ("stale", 0, False), 4: ("abandoned", 0, False), 5: ("complete", 0, False), 6: ("partial", 0, False)}
    held = R.finished(runs, expected, results, observed, spark.createDataFrame([(1,)], "run long"))
    assert held.filter("run = 1").first().status == "partial"


def test_registrations_in_order(spark):
    data = [("a", 1, 1, "p"), ("a", 2, 0, "p"), ("a", 3, 1, "q"), ("a", 4, 1, "p"), ("a", 5, 1, "p"), (None, 6, 0, "p"), (None, 7, None, "p")]
    got = rows(R.registrations(spark.createDataFrame(data, "key string, id long, expected long, path string")))
    assert got == [(1, "stale revision", 0), (2, "registered", 1), (3, "other path", 1), (4, "registered", 2), (5, "stale revision", 2), (6, "registered", 1), (7, "stale revision", 1)]
    assert R.registrations(spark.createDataFrame([], "key string, id long, expected long, path string")).count() == 0


def test_notices_and_acknowledgements(spark):
    sent = spark.createDataFrame([("s", 1, 1), ("s", 2, 5), ("t", 1, 2), ("s", 1, 9)], "subject string, revision long, id long")
    changes = spark.createDataFrame([("s", 2, 6, "sent"), ("t", 1, 3, "sent"), ("t", 1, 4, "resolved")], "subject string, revision long, id long, status string")
    now = R.notices(sent, changes)
    assert rows(now) == [("s", 1, "superseded"), ("s", 2, "sent"), ("t", 1, "resolved")]
    asked = spark.createDataFrame([(1, "s", 2), (2, "s", 1), (3, "t", 1), (4, "u", 1)], "id long, subject string, revision long")
    assert [r[1] for r in rows(R.acknowledgements(asked, now))] == ["acknowledged", "no longer current", "no longer current", "absent"]


def test_dispositions(spark):
    d = spark.createDataFrame([(1, True), (2, True), (3, True), (4, True), (5, False), (6, False)], "id long, required boolean")
    named = spark.createDataFrame([(1, "d", "s"), (3, "d", "s"), (3, "d", "s"), (4, "d", "x"), (5, "d", "s")], "id long, design string, section string")
    known = spark.createDataFrame([("d", "s")], "design string, section string")
    assert rows(R.dispositions(d, named, known)) == [(1, None), (2, "names none"), (3, "twice"), (4, "not registered"), (5, "names designs"), (6, None)]


PATCH = "*** Begin Patch\n{}\n*** End Patch"


@pytest.mark.parametrize(
    ("body", "paths"),
    [
        ("*** Update File: a b\n*** Move to: c\n@@\n x\n*** End of File", ["a b", "c"]), ("*** Delete File: a\n*** Add File: a\n+x", ["a"]), ("*** Add File: a", ["a"]),
        ("*** Delete File: a\n+x", None), ("*** Update File: a\n x\n*** Move to: c", None), ("*** Add File: a\n x", None), ("+x", None), ("*** Add File: ", None),
    ],
)
def test_patch_paths(spark, body, paths):
    df = spark.createDataFrame([(PATCH.format(body),)], "t string")
    assert df.select(X.patch_paths(F.col("t"))).first()[0] == paths


def test_texts_that_are_no_patches(spark):
    df = spark.createDataFrame([("",), (None,), ("*** Begin Patch\n*** End Patch",), ("x\n" + PATCH.format("*** Add File: a"),)], "t string")
    assert [r[0] for r in df.select(X.patch_paths(F.col("t"))).collect()] == [None] * 4


def test_claim_fields(spark):
    df = spark.createDataFrame([('kind=a note="x y" kind=b',), ("note=1",), ("",), ("kind=a odd=1",)], "t string").select(X.claim_fields(F.col("t")).alias("f"))
    got = df.select("f", X.claim_fault(F.col("f"))).collect()
    assert [(r[0], r[1]) for r in got] == [({"kind": "b", "note": "x y"}, None), ({"note": "1"}, "no kind"), ({}, "no kind"), ({"kind": "a", "odd": "1"}, "unknown field")]


def test_lengths_keep_fields_apart_from_the_third_scheme_on(spark):
    df = spark.createDataFrame([("a\x1fb", "c"), ("a", "b\x1fc")], "x string, y string")
    own = lambda scheme: df.select(H.attempt_hash(F.lit(scheme), F.lit(""), [F.col("x"), F.col("y")], F.lit("d"), F.lit("w"), F.lit("f"))).distinct().count()
    assert [own(f"chain-{n}") for n in (1, 2, 3, 4)] == [1, 1, 2, 2]


def test_resolved_paths(spark):
    deep = "a/" * 12 + "../" * 12 + "b"
    df = spark.createDataFrame([("a/./b/../c",), ("../x",), ("a/../../x",), (deep,), ("",)], "p string")
    assert [r[0] for r in df.select(code.resolved(F.col("p"))).collect()] == ["a/c", "../x", "../x", "b", ""]


def test_a_quote_may_end_with_what_closes_its_clause(spark):
    df = spark.createDataFrame([("Do this. Do that.", "Do this."), ("Do this. Do that.", "this. Do")], "t string, q string")
    assert [r[0] for r in df.select(X.crosses_clause(F.col("q"), F.col("t"))).collect()] == [False, True]


def test_values_kept_twice_keeps_rows_and_meets_names_once(spark):
    settings = spark.createDataFrame([("hot bolt", 1), ("hot bolt", 1), ("hot ring", 1), ("cold pin", 2), (None, 1)], "setting string, value int")
    literals = spark.createDataFrame([(7, "Hot hot bolt", 1), (7, "Hot hot bolt", 1), (8, "cold pin", 1), (9, "pin", 2), (10, None, 1)], "id long, name string, value int")
    got = sorted(tuple(r) for r in R.values_kept_twice(settings, literals).collect())
    assert got == [(7, "hot bolt", 1)] * 2 + [(7, "hot ring", 1)] * 2 + [(9, "cold pin", 2)]
