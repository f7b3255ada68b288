import json

from pyspark.sql import functions as F

from sealmark.operators import signatures

ROW = {"claim_id": "c", "kind": "k", "who": "w", "why": "y", "was_tty": 1, "signed_by": "h", "scope": "task", "cover_key": '{"b": 1, "a": 2}'}
RECORD = {"claim": "c", "kind": "k", "who": "w", "why": "y", "stdin_was_a_tty": True, "signed_by": "h", "scope": "task", "covers": {"a": 2, "b": 1}}
SCHEMA = "id long, git_record string, claim_id string, kind string, who string, why string, was_tty int, signed_by string, scope string, cover_key string"


def problems(spark, rows, records):
    r = spark.createDataFrame([(i, path, *({**ROW, **change}[c] for c in ("claim_id", "kind", "who", "why", "was_tty", "signed_by", "scope", "cover_key"))) for i, path, change in rows], SCHEMA)
    o = spark.createDataFrame([(path, json.dumps(content) if isinstance(content, dict) else content, *rest) for path, content, *rest in records], "path string, content string, place string, tracked boolean")
    return sorted(((x.path, x.problem) for x in signatures.reconciled(r, o).collect()), key=str)


def test_a_pair_that_agrees_has_no_problem(spark):
    assert problems(spark, [(1, "risks/a.json", {})], [("risks/a.json", RECORD, "disk", True)]) == []
    assert problems(spark, [], []) == []


def test_one_refusal_a_row(spark):
    rows = [(i, p, {}) for i, p in enumerate([None, "", "/risks/a.json", "risks/../a.json", "else/a.json", "risks/a.txt", "risks/.json", "risks/gone.json", "risks/null.json", "risks/bad.json", "risks/twice.json", "risks/list.json"])]
    records = [("risks/null.json", None, "disk", True), ("risks/bad.json", "{", "disk", False), ("risks/twice.json", '{"claim":"c","claim":"c"}', "disk", True), ("risks/list.json", "[1]", "disk", False)]
    assert problems(spark, rows, records) == sorted([(None, "names no record"), ("", "names no record"), ("/risks/a.json", "invalid path"), ("risks/../a.json", "invalid path"), ("else/a.json", "invalid path"), ("risks/a.txt", "invalid path"), ("risks/.json", "invalid path"),
        ("risks/gone.json", "record on no branch"), ("risks/null.json", "does not read"), ("risks/bad.json", "invalid JSON"), ("risks/twice.json", "invalid JSON"), ("risks/list.json", "malformed record")], key=str)


def test_every_field_is_compared(spark):
    at = "risks/a.json"
    without = lambda *names: {k: v for k, v in RECORD.items() if k not in names}
    one = lambda row, record: [p for _, p in problems(spark, [(1, at, row)], [(at, record, "disk", True)])]
    assert one({"why": "z", "kind": "j"}, RECORD) == ["disagree about kind", "disagree about why"]
    assert one({"who": None}, RECORD) == ["carries who, the row none"]
    assert one({"signed_by": ""}, RECORD) == []  # the row is older than the column
    assert one({"signed_by": "g"}, RECORD) == ["disagree about signed_by"] and one({}, without("signed_by")) == ["omits signed_by"]
    assert one({}, without("why", "covers", "who")) == []
    assert one({"was_tty": 0}, RECORD) == ["disagree about stdin_was_a_tty"] and one({"was_tty": 0}, {**RECORD, "stdin_was_a_tty": False}) == []
    assert one({"cover_key": ""}, RECORD) == ["carries covers, the row none"] and one({"cover_key": '{"a":3}'}, RECORD) == ["disagree about covers"]
    assert one({"cover_key": ""}, {**RECORD, "covers": None}) == [] and one({"claim_id": "7"}, {**RECORD, "claim": 7}) == ["disagree about claim"]


def test_superseded_rows_branches_and_lone_records(spark):
    rows = [(1, "risks/a.json", {"why": "older"}), (2, "risks/a.json", {}), (3, "risks/branch.json", {}), (4, "risks/new.json", {})]
    records = [("risks/a.json", RECORD, "disk", True), ("risks/branch.json", RECORD, "c0ffee", False), ("risks/new.json", RECORD, "disk", False), ("risks/lone.json", "{", "disk", True), ("risks/old.json", RECORD, "beef", None)]
    assert problems(spark, rows, records) == [("risks/lone.json", "no row made it"), ("risks/new.json", "not tracked")]


def test_newest_of_a_record(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None), (5, "")], "id int, git_record string")
    assert sorted(r.id for r in signatures.newest_of_record(df).collect()) == [2, 3, 4, 5]
    assert signatures.newest_of_record(df.filter(F.lit(False))).count() == 0
