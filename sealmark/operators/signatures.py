"""Signatures against the records that they wrote: every row has a record, every record a row, and they agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAME, TRUTH, JSON = "same", "truth", "json"
#: What an empty column says: the row was written without it, or before there was such a column.
INCOMPLETE, PREDATES = "incomplete", "predates"
# Fixed values: (field of a record, column of a row, how they compare, what an empty column says), in order.
FIELDS = [
    ("claim", "claim_id", SAME, INCOMPLETE), ("kind", "kind", SAME, INCOMPLETE), ("why", "why", SAME, INCOMPLETE), ("scope", "scope", SAME, INCOMPLETE), ("who", "who", SAME, INCOMPLETE),
    ("stdin_was_a_tty", "was_tty", TRUTH, INCOMPLETE), ("signed_by", "signed_by", SAME, PREDATES), ("covers", "cover_key", JSON, INCOMPLETE),
]


def newest_of_record(rows: DataFrame) -> DataFrame:
    """Rows without those whose record a newer row has written since; rows that name none all count."""
    named = rows.filter(F.coalesce("git_record", F.lit("")) != "").groupBy("git_record").agg(F.max("id").alias("id"))
    return rows.filter(F.coalesce("git_record", F.lit("")) == "").unionByName(rows.join(named.select("id"), "id", "left_semi"))


def _bad_path(path: Column, folder: str) -> Column:
    parts = F.split(path, "/")
    return F.contains(path, F.lit("\x00")) | F.startswith(path, F.lit("/")) | F.array_contains(parts, "..") | ~F.startswith(path, F.lit(f"{folder}/")) | ~path.rlike(r"[^/]\.json\z")


def _theirs(field: str, kind: str) -> Column:
    v = F.try_variant_get("_doc", f"$.{field}", "variant")
    shape = F.schema_of_variant(v)
    if kind == TRUTH:
        return F.coalesce(~F.to_json(v).isin("false", "null", "0", '""', "[]", "{}"), F.lit(False))
    if kind == JSON:
        return F.when(shape != "VOID", F.to_json(v))
    plain = F.when(shape == "STRING", F.try_variant_get("_doc", f"$.{field}", "string"))
    return F.coalesce(plain, F.when(shape != "VOID", F.concat(F.lit("\x00"), F.to_json(v))))  # a number is no text


def _ours(column: str, kind: str) -> Column:
    c = F.col(column)
    if kind == TRUTH:
        return F.coalesce(c.cast("int") != 0, F.lit(False))
    if kind == JSON:
        return F.when(c != "", F.coalesce(F.to_json(F.try_parse_json(c)), c))
    return c.cast("string")


def _field_problem(field: str, column: str, kind: str, when_empty: str) -> Column:
    theirs, ours = _theirs(field, kind), _ours(column, kind)
    bare = lambda x: F.lit(False) if kind == TRUTH else x.isNull() | (x == "")
    there = F.array_contains(F.json_object_keys("content"), field)
    omits = F.when(~bare(_ours(column, SAME)), f"omits {field}") if when_empty == PREDATES else F.lit(None).cast("string")
    fuller = F.lit(None).cast("string") if when_empty == PREDATES else F.lit(f"carries {field}, the row none")
    differ = F.when(theirs.eqNullSafe(ours), None).when(bare(ours) & ~bare(theirs), fuller).otherwise(f"disagree about {field}")
    return F.when(~there, omits).otherwise(differ)


def _refusal(folder: str) -> Column:
    """The first of these that holds is the only problem of a row; what comes after asks the record itself."""
    path = F.col("git_record")
    shape = F.schema_of_variant("_doc")
    table = [
        ("names no record", F.coalesce(path, F.lit("")) == ""),
        ("invalid path", _bad_path(path, folder)),
        ("record on no branch", F.col("place").isNull()),
        ("does not read", F.col("content").isNull()),
        ("invalid JSON", F.col("_doc").isNull()),
        ("malformed record", ~F.startswith(shape, F.lit("OBJECT"))),
    ]
    out = F.when(table[0][1], table[0][0])
    for name, holds in table[1:]:
        out = out.when(holds, name)
    return out


def reconciled(rows: DataFrame, records: DataFrame, folder: str = "risks") -> DataFrame:
    """(path, claim_id, problem) of signatures ``rows`` against ``records`` (path, content, place, tracked).

    ``place`` is ``disk``, or the commit in which a record was found that is not on disk: a signature made on another branch is no forgery.
    ``content`` is null where the bytes do not read. Of a row without a refusal all fields are compared, and a record on disk must be tracked.
    Records on disk that no row names, superseded ones included, are decisions that nobody made. One equi join on the path, both ways.
    """
    known = records.select("path", "content", "place", "tracked").withColumn("_doc", F.try_parse_json("content"))
    met = newest_of_record(rows).join(known, F.col("git_record") == F.col("path"), "left")
    asked = met.select("git_record", "claim_id", _refusal(folder).alias("_refusal"), F.array_compact(F.array(*(_field_problem(*f) for f in FIELDS), F.when((F.col("place") == "disk") & ~F.coalesce("tracked", F.lit(False)), "not tracked"))).alias("_found"))
    one = asked.withColumn("problem", F.explode(F.when(F.col("_refusal").isNotNull(), F.array("_refusal")).otherwise(F.col("_found"))))
    named = rows.filter(F.coalesce("git_record", F.lit("")) != "").select(F.col("git_record").alias("path")).distinct()
    lone = records.filter("place = 'disk'").join(named, "path", "left_anti")
    none = F.lit(None).cast(rows.schema["claim_id"].dataType)
    return one.select(F.col("git_record").alias("path"), "claim_id", "problem").union(lone.select("path", none, F.lit("no row made it")))
