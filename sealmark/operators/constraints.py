"""Constraints of documents as rows, compiled to one column: the first fault of a document, in the order in which a reader would meet it.

A table of constraints has a row for each place of a schema: (place, type, required, least, most, format, enum). Places are paths of names from ``$``;
``[]`` steps into the items of a list, as in ``$.works[].id``. What no row names is an unknown field. The compiled expression parses nothing itself: it reads a
variant, so a table of documents of any size is checked in its scan.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = "place string, type string, required boolean, least long, most long, format string, enum array<string>"
# Lengths of texts where none is given, and the formats that a text may have.
MOST_CHARS = 100_000
FORMATS = {"identifier": r"^[A-Za-z0-9][A-Za-z0-9_.:-]{0,199}\z", "absolute-path": r"(?s)^/[^\n]*\z", "commit": r"^[0-9a-f]{40}(?:[0-9a-f]{24})?\z"}
_SHAPES = {"object": "OBJECT", "array": "ARRAY", "string": "STRING", "integer": "BIGINT"}


@dataclass
class Node:
    """One place with what stands below it."""

    type: str
    required: bool = True
    least: int | None = None
    most: int | None = None
    format: str | None = None
    enum: list[str] | None = None
    below: dict[str, Node] = field(default_factory=dict)  # fields by name, or the items under ``[]``


def tree(rows: list) -> Node:
    """The places of a table of constraints as a tree; a place whose parent is missing is refused."""
    root: Node | None = None
    for r in sorted(rows, key=lambda r: r.place.count(".") + r.place.count("[]")):
        node = Node(r.type, r.required is not False, r.least, r.most, r.format, list(r.enum) if r.enum is not None else None)
        if r.type not in _SHAPES or (r.format and r.format not in FORMATS):
            raise ValueError(f"{r.place}: unknown type or format")
        steps = r.place.replace("[]", ".[]").split(".")
        if steps[0] != "$" or (root is None and len(steps) > 1):
            raise ValueError(f"{r.place} has no parent")
        if len(steps) == 1:
            root = node
            continue
        at = root
        for s in steps[1:-1]:
            if s not in at.below:
                raise ValueError(f"{r.place} has no parent")
            at = at.below[s]
        if at.type != ("array" if steps[-1] == "[]" else "object"):
            raise ValueError(f"{r.place} is below a {at.type}")
        at.below[steps[-1]] = node
    if root is None:
        raise ValueError("no place $")
    return root


def _first(checks: list[Column]) -> Column:
    return F.coalesce(*checks) if checks else F.lit(None).cast("string")


def _said(where: Column, text: str) -> Column:
    return F.concat(where, F.lit(text))


def _fault(value: Column, node: Node, where: Column) -> Column:
    """First fault of a variant, or null; ``where`` names its place, with the numbers of items."""
    shape = F.schema_of_variant(value)
    wrong = F.when(F.coalesce(shape != _SHAPES[node.type] if node.type in ("string", "integer") else ~F.startswith(shape, F.lit(_SHAPES[node.type])), F.lit(True)), _said(where, f" must be {node.type}"))
    checks = [wrong]
    if node.type == "object":
        keys = F.coalesce(F.json_object_keys(F.to_json(value)), F.array().cast("array<string>"))
        names = lambda some: F.array(*map(F.lit, some)).cast("array<string>")
        shown = lambda a: F.concat(F.lit("["), F.array_join(F.array_sort(a), ", "), F.lit("]"))
        unknown, missing = F.array_except(keys, names(node.below)), F.array_except(names(k for k, n in node.below.items() if n.required), keys)
        checks.append(F.when((F.size(unknown) > 0) | (F.size(missing) > 0), F.concat(where, F.lit(": unknown fields "), shown(unknown), F.lit(", missing fields "), shown(missing))))
        for name, below in node.below.items():  # in the order of the table; documents are not ordered
            inner = _fault(F.try_variant_get(value, f"$.{name}", "variant"), below, _said(where, f".{name}"))
            checks.append(F.when(F.array_contains(keys, name), inner))
    elif node.type == "array":
        items = F.try_variant_get(value, "$", "array<variant>")
        if node.least:
            checks.append(F.when(F.size(items) < node.least, _said(where, f" needs at least {node.least} items")))
        if node.most is not None:
            checks.append(F.when(F.size(items) > node.most, _said(where, f" has more than {node.most} items")))
        if "[]" in node.below:
            faults = F.transform(items, lambda x, i: _fault(x, node.below["[]"], F.concat(where, F.lit("["), i, F.lit("]"))))
            checks.append(F.try_element_at(F.array_compact(faults), F.lit(1)))
    elif node.type == "string":
        text = F.try_variant_get(value, "$", "string")
        checks.append(F.when(~F.length(text).between(node.least or 0, MOST_CHARS if node.most is None else node.most), _said(where, " has invalid length")))
        checks.append(F.when(((text != "") & ~text.rlike(r"[^\s\x1c-\x1f\x85\p{Z}]")) | text.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]"), _said(where, " contains empty text or control characters")))
        if node.format:
            checks.append(F.when(~text.rlike(FORMATS[node.format]), _said(where, f" is no {node.format}")))
        if node.enum is not None:
            checks.append(F.when(~text.isin(node.enum), _said(where, f" must be one of {', '.join(node.enum)}")))
    else:
        number = F.try_variant_get(value, "$", "long")
        checks.append(F.when(number < (node.least or 0), _said(where, f" must be at least {node.least or 0}")))
        if node.most is not None:
            checks.append(F.when(number > node.most, _said(where, f" must be at most {node.most}")))
        if node.enum is not None:
            checks.append(F.when(~number.isin([int(x) for x in node.enum]), _said(where, f" must be one of {', '.join(node.enum)}")))
    return _first(checks)


def compiled(constraints: DataFrame, document: Column) -> Column:
    """The first fault of a JSON text under a table of constraints (a row a place: a schema, not data, is collected); null for a good one."""
    node = tree(constraints.collect())
    doc = F.try_parse_json(document)
    return F.coalesce(F.when(doc.isNull(), "$ is no JSON"), _fault(doc, node, F.lit("$")))


def checked(documents: DataFrame, constraints: DataFrame, schema: str = "schema", document: str = "document") -> DataFrame:
    """``documents`` with ``fault`` under the constraints of their ``schema``; a schema that the table does not know is a fault."""
    known = sorted(r[0] for r in constraints.select(schema).distinct().collect() if r[0] is not None)  # schemas, not documents
    fault = F.concat(F.lit("unknown schema "), F.coalesce(F.col(schema), F.lit("null")))
    for name in known:
        fault = F.when(F.col(schema) == name, compiled(constraints.filter(F.col(schema) == name), F.col(document))).otherwise(fault)
    return documents.withColumn("fault", fault)
