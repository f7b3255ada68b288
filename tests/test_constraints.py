import json
import random
import re

import pytest

from sealmark.operators import constraints as C

ROWS = [
    ("$", "object", None, None, None, None, None), ("$.id", "string", True, 1, None, "identifier", None), ("$.version", "integer", True, None, 9, None, None), ("$.action", "string", True, None, None, None, ["input", "stop"]),
    ("$.note", "string", False, 2, 5, None, None), ("$.at", "string", False, None, None, "absolute-path", None), ("$.commit", "string", False, None, None, "commit", None), ("$.works", "array", False, 1, 2, None, None),
    ("$.works[]", "object", None, None, None, None, None), ("$.works[].id", "string", True, 1, None, None, None), ("$.works[].needs", "array", False, None, None, None, None), ("$.works[].needs[]", "integer", None, 3, None, None, None), ("$.level", "integer", False, None, None, None, ["1", "2"]),
]
GOOD = {"id": "a-1", "version": 3, "action": "stop"}
PATTERNS = {"identifier": r"[A-Za-z0-9][A-Za-z0-9_.:-]{0,199}\Z", "commit": r"[0-9a-f]{40}(?:[0-9a-f]{24})?\Z"}


def table(spark, rows=ROWS):
    return spark.createDataFrame(rows, C.SCHEMA)


def plain(value, node, where="$"):
    """The first fault, by hand."""
    kinds = {"object": isinstance(value, dict), "array": isinstance(value, list), "string": isinstance(value, str), "integer": type(value) is int}
    if not kinds[node.type]:
        return f"{where} must be {node.type}"
    if node.type == "object":
        unknown, missing = sorted(set(value) - set(node.below)), sorted({k for k, n in node.below.items() if n.required} - set(value))
        if unknown or missing:
            return f"{where}: unknown fields [{', '.join(unknown)}], missing fields [{', '.join(missing)}]"
        return next((f for k, n in node.below.items() if k in value and (f := plain(value[k], n, f"{where}.{k}"))), None)
    if node.type == "array":
        if len(value) < (node.least or 0):
            return f"{where} needs at least {node.least} items"
        if node.most is not None and len(value) > node.most:
            return f"{where} has more than {node.most} items"
        return next((f for i, x in enumerate(value) if (f := plain(x, node.below["[]"], f"{where}[{i}]"))), None)
    if node.type == "string":
        if not (node.least or 0) <= len(value) <= (100_000 if node.most is None else node.most):
            return f"{where} has invalid length"
        if (value and not value.strip()) or any(ord(c) < 32 and c not in "\n\t\r" for c in value):
            return f"{where} contains empty text or control characters"
        if node.format in PATTERNS and not re.fullmatch(PATTERNS[node.format], value) or node.format == "absolute-path" and (not value.startswith("/") or "\n" in value):
            return f"{where} is no {node.format}"
        return f"{where} must be one of {', '.join(node.enum)}" if node.enum is not None and value not in node.enum else None
    if value < (node.least or 0):
        return f"{where} must be at least {node.least or 0}"
    if node.most is not None and value > node.most:
        return f"{where} must be at most {node.most}"
    return f"{where} must be one of {', '.join(node.enum)}" if node.enum is not None and value not in map(int, node.enum) else None


def faults(spark, docs, rows=ROWS):
    df = spark.createDataFrame(list(enumerate(docs)), "i int, d string")
    return [r[0] for r in df.orderBy("i").select(C.compiled(table(spark, rows), df.d)).collect()]


def test_documents_have_the_fault_that_a_reader_meets_first(spark):
    rng = random.Random(2)
    changes = {
        "id": ["", " ", "x" * 201, "a b", "ok", 7, None, "a\n"], "version": [-1, 10, "3", 2.5, True, 0, None], "action": ["go", "", "input"], "note": ["", "ab", "abcdef", "a\x01b", "\t\t", "\xa0\xa0", "é中"], "at": ["/a/b", "a", "/a\nb", "/"], "commit": ["a" * 40, "a" * 41, "A" * 40, "0" * 64],
        "works": [[], [{}], [{"id": "x"}], [{"id": "x"}, {"id": ""}], [{"id": "x"}] * 3, {"id": "x"}, [{"id": "x", "needs": [3, 2]}], [{"id": "x", "needs": []}, 5], [{"id": "x", "more": 1}], [None]], "level": [1, 3, "1"], "other": [1], "z": [None],
    }
    docs = [GOOD, {}, [], 5, "text", None, {"id": "a"}]
    for _ in range(300):
        d = dict(GOOD)
        for k in rng.sample(sorted(changes), rng.randint(1, 3)):
            d[k] = rng.choice(changes[k])
        for k in rng.sample(sorted(d), rng.choice([0, 0, 0, 1])):
            del d[k]
        docs.append(d)
    node = C.tree(table(spark).collect())
    got, want = faults(spark, [json.dumps(d) for d in docs]), [plain(d, node) for d in docs]
    assert got == want and sum(w is None for w in want) > 10
    assert faults(spark, ["{", None, ""]) == ["$ is no JSON"] * 3


def test_tables_that_are_no_schema_are_refused(spark):
    for rows, said in (([], "no place"), ([("$.a", "string")], "no parent"), ([("$", "object"), ("$.a.b", "string")], "no parent"), ([("$", "object"), ("$[]", "string")], "below a object"), ([("$", "thing")], "unknown type"), ([("$", "array"), ("$.a", "string")], "below a array")):
        with pytest.raises(ValueError, match=said):
            C.tree(table(spark, [(*r, None, None, None, None, None) for r in rows]).collect())


def test_documents_of_several_schemas(spark):
    rows = spark.createDataFrame([("one", "$", "integer", None, None, None, None, None), ("two", "$", "array", None, 1, None, None, None)], "schema string, " + C.SCHEMA)
    docs = spark.createDataFrame([(1, "one", "5"), (2, "one", "-5"), (3, "two", "[]"), (4, "two", "[1]"), (5, "three", "1"), (6, None, "1")], "id int, schema string, document string")
    assert {r.id: r.fault for r in C.checked(docs, rows).collect()} == {1: None, 2: "$ must be at least 0", 3: "$ needs at least 1 items", 4: None, 5: "unknown schema three", 6: "unknown schema null"}
