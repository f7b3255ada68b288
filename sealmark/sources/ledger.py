"""Reading and writing ledgers: Parquet stores that are only appended to, and their JSON Lines export in sealed segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sealmark.functions.text import redact
from sealmark.schema import ADDED, FREE_TEXT, TABLES


def read(spark: SparkSession, root: str, table: str) -> DataFrame:
    """One table of a store, under its schema. A store that is not there raises; it is never read as empty.

    Columns that an older store lacks are filled with what stands for them.
    """
    schema = TABLES[table]
    have = spark.read.parquet(f"{root}/{table}")
    defaults = ADDED.get(table, {})
    missing = [f for f in schema if f.name not in have.columns]
    if bad := [f.name for f in missing if f.name not in defaults and not f.nullable]:
        raise ValueError(f"{table} lacks {', '.join(bad)}")
    out = have.withColumns({f.name: F.lit(defaults.get(f.name)).cast(f.dataType) for f in missing}) if missing else have
    known = [F.coalesce(F.col(f.name), F.lit(defaults[f.name])).cast(f.dataType).alias(f.name) if f.name in defaults else F.col(f.name).cast(f.dataType) for f in schema]
    return out.select(*known)


def allowed(rows: DataFrame, vocabularies: dict[str, list[str]]) -> tuple[DataFrame, DataFrame]:
    """(rows whose columns hold only known words, the others)."""
    good: Column = F.lit(True)
    for column, words in vocabularies.items():
        good = good & F.coalesce(F.col(column).isin(words), F.lit(False))
    return rows.filter(good), rows.filter(~good)


def append(rows: DataFrame, root: str, table: str, key: str | None = None, vocabularies: dict[str, list[str]] | None = None, free_text: tuple[str, ...] | None = None) -> DataFrame:
    """Append rows to a table and return those that were refused.

    Free text is redacted first: the columns named, or else those that ``FREE_TEXT`` has for the table. With ``key``, rows whose key the table holds already are left out.
    """
    texts = [c for c in FREE_TEXT.get(table, ()) if c in rows.columns] if free_text is None else free_text
    rows = rows.withColumns({c: redact(F.col(c)) for c in texts}) if texts else rows
    good, bad = allowed(rows, vocabularies or {})
    target = f"{root}/{table}"
    if key is not None:
        good = good.dropDuplicates([key])
        if exists(rows.sparkSession, target):
            good = good.join(rows.sparkSession.read.parquet(target).select(key), key, "left_anti")
    good.write.mode("append").parquet(target)
    return bad


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def to_lines(tables: dict[str, DataFrame], free_text: dict[str, tuple[str, ...]] | None = None, orders: dict[str, str] | None = None) -> DataFrame:
    """(ord, table, at, id, row_hash, value): the export of all tables as JSON lines. Rows whose text was redacted say which fields: those of ``free_text`` by table, or else of ``FREE_TEXT``.

    ``at`` is what orders the rows of a table as they were appended: the number in ``id``, or the column that ``orders`` names (times in microseconds).
    """
    out = None
    for n, (name, rows) in enumerate(tables.items()):
        fields = (free_text or {}).get(name, ()) if free_text is not None else tuple(c for c in FREE_TEXT.get(name, ()) if c in rows.columns)
        marked = rows.withColumns({c: redact(F.col(c)) for c in fields})
        if fields:
            changed = F.array_compact(F.array(*(F.when(~F.col(c).eqNullSafe(redact(F.col(c))), F.lit(c)) for c in fields)))
            marked = rows.withColumn("_redacted", changed).withColumns({c: redact(F.col(c)) for c in fields})
        line = F.to_json(F.struct(F.lit(name).alias("_table"), *marked.columns))
        by = (orders or {}).get(name, "id")
        at = F.unix_micros(by) if rows.schema[by].dataType == T.TimestampType() else F.col(by).try_cast("long")
        hash_ = F.col("row_hash") if "row_hash" in rows.columns else F.lit(None).cast("string")
        part = marked.select(F.lit(n).alias("ord"), F.lit(name).alias("table"), at.alias("at"), F.col("id").cast("string").alias("id"), hash_.alias("row_hash"), line.alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


def read_lines(spark: SparkSession, path: str, table: str | None = None, schema: T.StructType | None = None) -> DataFrame:
    """Lines of text files with their file; blank lines are skipped. With a table, its rows under its schema. See ``segments.read`` for sealed exports.

    The table's name is looked for in the raw text before any JSON is parsed.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file")).filter(F.trim("value") != "")
    if table is None:
        return lines
    kept = lines.filter(F.contains(F.col("value"), F.lit(f'"_table":"{table}"')))
    fields = schema or TABLES[table]
    return kept.select(F.from_json("value", fields).alias("row"), "file").select("row.*", "file")


def line_faults(lines: DataFrame, known: list[str]) -> DataFrame:
    """(file, id, problem) of exported lines: not an object, unknown table, a repeated id."""
    j = lines.withColumns({"_t": F.get_json_object("value", "$._table"), "_id": F.get_json_object("value", "$.id")})
    shape = F.when(F.get_json_object("value", "$").isNull() | ~F.startswith(F.trim("value"), F.lit("{")), "not an object").when(F.col("_t").isNull() | ~F.coalesce(F.col("_t").isin(known), F.lit(False)), "unknown table")
    bad = j.select("file", F.col("_id").alias("id"), shape.alias("problem")).filter("problem IS NOT NULL")
    twice = j.filter(shape.isNull()).groupBy("_t", "_id").agg(F.min("file").alias("file"), F.count("*").alias("n")).filter("n > 1")
    return bad.union(twice.select("file", F.col("_id").alias("id"), F.lit("repeated id").alias("problem")))


def facts(spark: SparkSession, path: str) -> DataFrame:
    """(list, pattern, kind, match, seen_path, seen_line, note) of a facts document."""
    entry = "array<struct<pattern:string,seen_at:string,kind:string,match:string,note:string>>"
    doc = spark.read.schema(f"outbound_write {entry}, outbound_read {entry}, auth_decision {entry}").json(path, multiLine=True)
    lists = F.create_map(*(x for n in ("outbound_write", "outbound_read", "auth_decision") for x in (F.lit(n), F.coalesce(n, F.array().cast(entry)))))
    rows = doc.select(F.explode(lists).alias("list", "entries")).select("list", F.explode("entries").alias("e"))
    place = F.split("e.seen_at", ":")
    return rows.select("list", "e.pattern", "e.kind", "e.match", F.element_at(place, 1).alias("seen_path"), F.expr("try_cast(try_element_at(split(e.seen_at, ':'), 2) AS INT)").alias("seen_line"), "e.note")


def facts_faults(rows: DataFrame) -> DataFrame:
    """(list, pattern, problem): missing patterns, places without a line, repeats, patterns that both write and read."""
    shape = F.when(F.coalesce(F.trim("pattern"), F.lit("")) == "", "no pattern").when(F.col("seen_line").isNull(), "no place").when(~F.coalesce(F.col("match").isin("symbol", "regex"), F.lit(False)), "unknown match")
    one = rows.select("list", "pattern", shape.alias("problem")).filter("problem IS NOT NULL")
    twice = rows.groupBy("list", "pattern").count().filter("count > 1").select("list", "pattern", F.lit("repeated").alias("problem"))
    both = rows.filter(F.col("list").isin("outbound_write", "outbound_read")).groupBy("pattern").agg(F.count_distinct("list").alias("n")).filter("n > 1")
    return one.union(twice).union(both.select(F.lit("outbound").alias("list"), "pattern", F.lit("writes and reads").alias("problem")))


def files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, sha, text) of the files under a folder, digested by Spark."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return raw.select("path", F.sha2("content", 256).alias("sha"), F.decode("content", "utf-8").alias("text"))


def hunks(diff: DataFrame) -> DataFrame:
    """(path, line) of every changed line of unified diffs without context, one diff a row in ``value``.

    A hunk header says where the new lines start and how many there are; a hunk that only deletes changes none.
    """
    lines = diff.select(F.xxhash64("value").alias("_d"), F.posexplode(F.split("value", "\n")).alias("n", "line"))
    name = F.regexp_extract("line", r"^\+\+\+ (?:b/)?(.+)$", 1)
    w = Window.partitionBy("_d").orderBy("n")
    named = lines.withColumn("path", F.last(F.when(name != "", name), ignorenulls=True).over(w))
    start, many = F.regexp_extract("line", r"^@@ -\S+ \+(\d+)", 1), F.regexp_extract("line", r"^@@ -\S+ \+\d+,(\d+)", 1)
    heads = named.filter(start != "").select("path", start.cast("int").alias("start"), F.when(many == "", 1).otherwise(F.expr("try_cast(regexp_extract(line, '^@@ -\\\\S+ \\\\+\\\\d+,(\\\\d+)', 1) AS INT)")).alias("many"))
    return heads.filter("many > 0").select("path", F.explode(F.sequence("start", F.col("start") + F.col("many") - 1)).alias("line"))
