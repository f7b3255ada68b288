from sealmark.operators import code, graph


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


FILES = [
    ("pkg/__init__.py", "from pkg.a import f\n"),
    ("pkg/a.py", "import os, pkg.b\nfrom pkg.b import g, gone  # why\nX: int = 1\nasync def f():\n    return g()\nclass K: pass\n"),
    ("pkg/b.py", "from pkg import a\nfrom elsewhere import z\ndef g():\n    return a.client.post('u')\n\ndef test_g():\n    pass\n"),
    ("pkg/test_x.py", "from pkg.a import (K, X as Y)\nfrom pkg.a import missing\n"),
    ("doc/r.md", "# 1 One\n\n3 rules apply here:\n- a\n- b\n\n2 things:\n- a\n- b\n# 3 Three\n# 2 Two\n[x](../pkg/a.py) [y](other.md) [z](https://a.b) [s](s.md#t)\n"),
    ("doc/s.md", ""), ("m.go", "func TestA(t *T) {\n}\nfunc Test(t *T) {}\n"), ("n.spec.ts", "it('a', () => {})\n  test('b')\n"), ("gone.py", None),
]


def frame(spark):
    return spark.createDataFrame(FILES, "path string, text string")


def test_dangling_imports(spark):
    assert rows(code.dangling_imports(frame(spark))) == [("pkg/a.py", 2, "pkg.b", "gone"), ("pkg/test_x.py", 2, "pkg.a", "missing")]


def test_import_edges_and_their_cycle(spark):
    e = code.import_edges(frame(spark))
    assert ("pkg.a", "pkg.b", 1) in rows(e) and ("pkg.b", "pkg.a", 1) in rows(e) and ("pkg", "pkg.a", 1) in rows(e)
    found = rows(graph.cycle_edges(e.select("src", "dst")).select("src", "dst"))
    assert found == [("pkg.a", "pkg.b"), ("pkg.b", "pkg.a")]


def test_counts_of_tests(spark):
    assert dict(rows(code.test_counts(frame(spark)))) == {"pkg/__init__.py": 0, "pkg/a.py": 0, "pkg/b.py": 1, "pkg/test_x.py": 0, "doc/r.md": 0, "doc/s.md": 0, "m.go": 2, "n.spec.ts": 2, "gone.py": -1}


def test_documents(spark):
    from sealmark.operators import folds

    f = frame(spark)
    assert rows(code.stated_counts(f)) == [("doc/r.md", 3, 3, 2)]
    assert rows(code.dead_references(f)) == [("doc/r.md", 12, "other.md")]
    assert [r.title for r in folds.drops(code.headings(f), "path", "number", "line").collect()] == ["Two"]


def test_verbs(spark):
    assert rows(code.verb_sites(frame(spark), ["post"])) == [("post", "a.client.post", "pkg/b.py:4")]


def test_pins(spark):
    text = "`<!-- pinned: no.py -->`\n<!-- pinned: a.py::f=3 --> <!--pinned: b.py --> <!-- pinned:  -->\n<!-- pinned: a.py::g -->\n<!-- pinned: a.py::f= -->"
    marks = code.pins(spark.createDataFrame([("d.md", text), ("e.md", None), ("f.md", "")], "path string, text string"))
    assert rows(marks.select("file", "symbol", "value")) == [("", None, None), ("a.py", "f", ""), ("a.py", "f", "3"), ("a.py", "g", None), ("b.py", None, None)]
    own = spark.createDataFrame([("a.py", "f", "3")], "path string, symbol string, value string")
    found = code.pin_faults(marks, own, own.withColumnRenamed("path", "file"))
    assert rows(found.select("file", "problem")) == [("", "empty"), ("a.py", "no symbol"), ("a.py", "other value"), ("b.py", "no file")]


def test_files_are_parsed_once_and_by_many_tasks(spark, monkeypatch):
    parsed, python = [], code._python

    def told(files):
        out = python(files)
        parsed.append(out.rdd.getNumPartitions())
        return out

    monkeypatch.setattr(code, "_python", told)
    left = code.dangling_imports(frame(spark).coalesce(1))
    assert "ArrowEvalPython" not in left._jdf.queryExecution().executedPlan().toString() and len(parsed) == 1 and parsed[0] >= code.PARTS
