import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sealmark.operators import payloads

BAD = [None, "", "{broken", "[1]", "7", '"x"', "null", '{"a":1,"a":2}']


def events(spark, texts):
    return spark.createDataFrame([(i, 1 + i % 2, "k", t) for i, t in enumerate(texts)], "id int, task_id int, kind string, payload string")


def test_policies(spark):
    df = events(spark, [*BAD, '{"a": 1}', "{}"])
    assert [r.id for r in payloads.opened(df, payloads.SKIP).collect()] == [8, 9]
    assert [r.id for r in payloads.opened(df, payloads.SKIP, null_is_empty=True).collect()] == [0, 1, 8, 9]
    charged = payloads.opened(df, payloads.CHARGE).select("id", "unreadable", payloads.field("a", "int").alias("a")).collect()
    assert [(r.id, r.unreadable, r.a) for r in charged] == [(i, True, None) for i in range(8)] + [(8, False, 1), (9, False, None)]
    with pytest.raises(PySparkException, match="unreadable payload"):
        payloads.opened(df, payloads.FAIL).select(payloads.field("a")).collect()
    assert payloads.opened(events(spark, ['{"a": "x"}']), payloads.FAIL).select(payloads.field("a")).first()[0] == "x"
    with pytest.raises(ValueError, match="policy"):
        payloads.opened(df, "other")


def test_withdrawals_and_groupings(spark):
    good = ['{"quote": "q", "why": "w"}', '{"quote": 7}', '{"name": "n", "claims": ["a", "b"], "why": "x"}', '{"name": "m", "claims": ["b"]}', '{"claims": "b"}', None]
    df = events(spark, good + ["{"])
    assert [tuple(r) for r in payloads.withdrawals(df).filter("id < 2").collect()] == [(0, 1, "q", "w"), (1, 2, "7", None)]
    groups = payloads.groupings(df.filter("id > 1"))
    assert [(r.id, r.name, r.claims, r.why) for r in groups.collect()] == [(2, "n", ["a", "b"], "x"), (3, "m", ["b"], ""), (4, "", [], ""), (5, "", [], "")]
    assert {r.claim: r.name for r in payloads.group_of(groups).collect()} == {"a": "n", "b": "m"}


def test_forbidden_globs(spark):
    df = events(spark, ['{"globs": ["a", "b"]}', '{"globs": ["c"]}', '{"globs": ["b", "d"]}', "{}"])
    assert sorted(tuple(r) for r in payloads.forbidden(df).collect()) == [(1, "a", 0), (1, "b", 0), (1, "d", 2), (2, "c", 1)]
    with pytest.raises(PySparkException, match="unreadable payload"):
        payloads.forbidden(events(spark, ["{"])).collect()


def test_rounds(spark):
    rows = [(1, "a", "open", '{"label":"1","acceptance_sha":"s"}'), (2, "a", "close", "{"), (3, "b", "open", '{"label":"2","acceptance_sha":"s"}'), (4, "c", "open", '{"label":"3","acceptance_sha":"t"}'), (5, "c", "other", "{"), (6, "e", "close", None), (7, "e", "open", '{"label":"4","acceptance_sha":"s"}')]
    rounds = payloads.current_round(spark.createDataFrame(rows, "id int, task string, kind string, payload string"), "task", "open", "close")
    now = spark.createDataFrame([("a", "s"), ("b", "s"), ("c", "s"), ("d", "s"), ("e", None)], "task string, sha string")
    assert {r.task: (r.label, r.verdict) for r in payloads.rulers(rounds, now, "task").collect()} == {"a": (None, "no round"), "b": ("2", "unmoved"), "c": ("3", "moved"), "d": (None, "no round"), "e": ("4", "moved")}


def test_obligations(spark):
    families = spark.createDataFrame([("A", 3), ("B", 5), ("C", 1)], "family string, ids int")
    mapping = spark.createDataFrame([("A", "x"), ("A", "y"), ("A", "y"), ("B", "z")], "family string, kind string")
    got = {r.family: (r.reusable, r.answered, r.missing) for r in payloads.obligations(families, mapping, spark.createDataFrame([("y",), ("y",)], "kind string")).collect()}
    assert got == {"A": (True, ["y"], ["x"]), "B": (True, [], ["z"]), "C": (False, [], [])}


FILES = {
    "list": ["a", {"id": "b", "note": 1}, "a"], "accepted": {"accepted": ["c"], "findings": ["d"]}, "findings": {"version": 1, "findings": [{"id": "e"}]}, "none": [], "null": None,
    "number": 7, "entry": ["a", 7], "inner": {"accepted": {"a": 1}, "findings": ["z"]}, "nothing": {}, "entry2": [{"note": "no id"}], "idnumber": [{"id": 5}],
}


def test_baselines_of_three_states(spark, tmp_path):
    for name, doc in FILES.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(doc))
    (tmp_path / "broken.json").write_text("{")
    files = payloads.stored_baselines(spark, str(tmp_path), [*FILES, "broken", "gone"])
    states, accepted = payloads.baselines(files)
    got = {r.kind: (r.state, r.reason) for r in states.collect()}
    assert got == {
        "list": ("known", None), "accepted": ("known", None), "findings": ("known", None), "none": ("known", None), "gone": ("absent", None), "broken": ("unreadable", "no JSON"), "null": ("unreadable", "no list"),
        "number": ("unreadable", "no list"), "entry": ("unreadable", "an entry without id"), "inner": ("unreadable", "no list"), "nothing": ("unreadable", "no list"), "entry2": ("unreadable", "an entry without id"), "idnumber": ("unreadable", "an entry without id"),
    }
    assert sorted(tuple(r) for r in accepted.collect()) == [("accepted", "c"), ("findings", "e"), ("list", "a"), ("list", "b")]
    found = spark.createDataFrame([("list", "a"), ("list", "n"), ("gone", "a"), ("broken", "a")], "kind string, id string")
    assert sorted(tuple(r) for r in payloads.forgiven(found, files.filter(F.col("kind").isin("list", "gone", "broken"))).collect()) == [("broken", "a", "unknown"), ("gone", "a", "new"), ("list", "a", "carried"), ("list", "b", "stale"), ("list", "n", "new")]


def test_no_folder_is_no_baseline(spark, tmp_path):
    assert [tuple(r) for r in payloads.baselines(payloads.stored_baselines(spark, str(tmp_path / "none"), ["a"]))[0].collect()] == [("a", "absent", None)]
