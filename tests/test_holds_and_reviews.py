import pytest
from pyspark.sql import functions as F

from sealmark.operators import holds, reviews


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_null_conditions_hold_nothing(spark):
    df = spark.createDataFrame([(1, True, None), (2, True, True), (3, None, False)], "id int, a boolean, b boolean")
    assert rows(holds.holds(df, "id", [("a", F.col("a")), ("b", F.col("b"))])) == [(1, "a"), (2, "a"), (2, "b")]
    assert rows(df.select("id", holds.first_refusal([("b", F.col("b")), ("a", F.col("a"))]))) == [(1, "a"), (2, "b"), (3, None)]


def test_receipts_are_kept_when_they_do_not_apply(spark):
    df = spark.createDataFrame([(1, "running", "done", 1, 1), (2, "done", "running", 1, 1), (3, "running", "done", 2, 1)], "id int, state string, outcome string, worker int, assigned int")
    got = holds.receipts(df, {"running": ["done"]}).select("id", "applied", "kept_as")
    assert rows(got) == [(1, True, "done"), (2, False, "historical_after_done"), (3, False, "conflict")]


def test_every_live_work_needs_one_disposition(spark):
    live, done = (spark.createDataFrame(x, "task int, work int") for x in ([(1, 1), (1, 2), (1, 3)], [(1, 1), (1, 2), (1, 2), (9, 9)]))
    assert rows(holds.undisposed(live, done, ["task", "work"])) == [(1, 2, "twice"), (1, 3, "missing")]


@pytest.mark.parametrize(("reviewed", "inconclusive", "want"), [({"a": 0, "b": 2}, {}, True), ({"a": 0}, {"b": "x"}, True), ({"a": 0}, {}, False), ({"a": -1, "b": 0}, {}, False), ({"a": None, "b": 0}, {}, False), (None, None, False)])
def test_complete_sweep(spark, reviewed, inconclusive, want):
    df = spark.createDataFrame([(["a", "b"], reviewed, inconclusive)], "e array<string>, r map<string,int>, i map<string,string>")
    assert df.select(reviews.complete(F.col("e"), F.col("r"), F.col("i"))).first()[0] is want


@pytest.mark.parametrize(("sentence", "want"), [(None, "empty"), ("  ", "empty"), ("no", "short"), ("something else entirely here", "off subject"), ("the parser has token = abcdefgh12", "credential"), ("the parser rule is this one", "recited"), ("the parser splits long lines", None)])
def test_first_failing_test_wins(spark, sentence, want):
    df = spark.createDataFrame([(sentence,)], "s string")
    assert df.select(reviews.judged(F.col("s"), F.lit("parser"), F.array(F.lit("rule this")), 5)).first()[0] == want


def test_citations(spark):
    cited = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1), ("d", 1)], "pattern string, line int")
    hits = spark.createDataFrame([("a", 1), ("a", 5), ("b", 7), ("c", 7), ("c", 8)], "pattern string, line int")
    assert rows(reviews.restated(cited, hits)) == [("a", "holds", 1), ("b", "moved", 7), ("c", "ambiguous", None), ("d", "gone", None)]
