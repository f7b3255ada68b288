import itertools

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sealmark.functions import statements as S
from sealmark.operators import code, verdicts


def test_red_green_in_three_values(spark):
    cases = list(itertools.product([0, 1, 127], [None, 0, 1, 126], [None, True, False], [None, True, False], [True, False]))
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, green_exit int, red_exit int, executed boolean, red_executed boolean, mutated boolean")
    got = {r.i: r for r in verdicts.red_green(df).collect()}
    for i, (g, r, x, rx, m) in enumerate(cases):
        red = None if r is None else r not in (126, 127) and r != 0 and not (m and rx is False)
        parts = (g == 0, red, x)
        verdict = False if False in parts else None if None in parts else True
        assert (got[i].green, got[i].red, got[i].verdict) == (g == 0, red, verdict), cases[i]
        assert (not got[i].notes) == (verdict is True), cases[i]
    unknown = spark.createDataFrame([(None, 1, True, None, False)], "green_exit int, red_exit int, executed boolean, red_executed boolean, mutated boolean")
    assert verdicts.red_green(unknown).first().green is False


def test_audits_and_the_worst_of_them(spark):
    df = lambda *p: spark.createDataFrame([(x,) for x in p], "problem string")
    got = [tuple(r) for r in verdicts.audit_summary({"a": df(), "b": df("fine", "fine"), "c": df("bad", "fine")}, ("fine",)).collect()]
    assert sorted(got) == [("a", 0, 0, 0), ("all", 4, 1, 1), ("b", 2, 0, 0), ("c", 2, 1, 1)]
    events = spark.createDataFrame([("",), (None,), ("h",)], "row_hash string")
    assert tuple(verdicts.chain_cover(events).first()) == (2, 1)


def test_settings(spark):
    docs = spark.createDataFrame([("a", '{"kinds":{"x":{"gate":"block","n":3,"why":null},"y":7}}'), ("b", "{}")], "source string, content string")
    rows = verdicts.settings(docs, "kinds")
    assert sorted((r.source, r.name, r.field, r.value) for r in rows.collect()) == [("a", "x", "gate", '"block"'), ("a", "x", "n", "3"), ("a", "x", "why", "null"), ("a", "y", "", "7")]
    claims = spark.createDataFrame([("x",), ("z",), (None,)], "kind string")
    assert {r.kind: r.gate for r in verdicts.setting(claims, rows, "kind", "gate", F.lit("none")).collect()} == {"x": "block", "z": "none", None: "none"}
    for bad in ("{", "[1]", None):
        with pytest.raises(PySparkException, match="unreadable configuration"):
            verdicts.settings(spark.createDataFrame([("c", bad)], "source string, content string"), "kinds").collect()


def test_routes(spark):
    text = "@app.get('/a')\ndef a(): pass\n@x.Router.POST(\n  '/b', f=(1, 2))\n@cached\nasync def b(): pass\n@cache.get\ndef c(): pass\n@app.get('/d')\nclass D: pass\n@retry.post_hook\n@app.on_event('x')\ndef e(): pass\n'''\n@app.get('/f')\ndef f(): pass\n'''\n@app.route\ndef g(): pass\n"
    df = spark.createDataFrame([("a.py", text), ("b.txt", text), ("c.py", None), ("d.py", "(")], "path string, text string")
    assert sorted(tuple(r) for r in code.routes(df).collect()) == [("a.py", 1, "app", "get", "a"), ("a.py", 3, "x.Router", "POST", "b"), ("a.py", 18, "app", "route", "g")]
    own = spark.createDataFrame([("Cache",)], "name string")
    assert [tuple(r) for r in code.routes(df, own).collect()] == [("a.py", 7, "cache", "get", "c")]
    assert S.decorated([]) == []
