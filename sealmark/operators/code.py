"""Findings in source files and documents, by line: imports, definitions, tests, headings, references.

Files are rows of (path, text). Lines come from one explode; everything else is a projection, a join or a window keyed
by path. Imports and names of Python files come from their logical lines, with strings and comments blanked; what other lines say is read by patterns.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sealmark.functions.statements import bound, decorated, imports, statements
from sealmark.operators.joins import longest_prefix
from sealmark.operators.settled import scratch, settle

#: Partitions that files are dealt to before they are parsed: a small table of files is one task of a scan, however long its texts take.
PARTS = 64


def lines(files: DataFrame) -> DataFrame:
    """(path, line, code) with line numbers from 1."""
    parts = files.select("path", F.posexplode(F.split("text", r"\r?\n")).alias("n", "code"))
    return parts.select("path", (F.col("n") + 1).alias("line"), "code")


def module_of(path: Column) -> Column:
    """Dotted module of a Python file; a package is named by its folder."""
    return F.replace(F.regexp_replace(path, r"(/__init__)?\.py$", ""), F.lit("/"), F.lit("."))


def _python(files: DataFrame) -> DataFrame:
    """(path, module, imports, names, dynamic, star) of every Python file that reads; the statements of each are told apart in its own row."""

    @F.pandas_udf("imports array<struct<line:int,dots:int,module:string,name:string,binds:string>>, names array<string>, dynamic boolean")
    def read(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            found = None if t is None else statements(t)
            if found is None:
                rows.append((None, None, None))
            else:
                rows.append(([dict(zip(("line", "dots", "module", "name", "binds"), i, strict=True)) for i in imports(found)], *bound(found)))
        return pd.DataFrame(rows, columns=["imports", "names", "dynamic"])

    py = files.filter(F.endswith("path", F.lit(".py"))).repartition(max(PARTS, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "path").withColumn("r", read("text")).filter("r.names IS NOT NULL")
    return py.select("path", module_of(F.col("path")).alias("module"), "r.*", F.contains("text", F.lit("import *")).alias("star"))


def _absolute(path: Column, dots: Column, module: Column) -> Column:
    """The module that an import names: dots count from the importing file's own folder; null above the top."""
    folder = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    parts = F.when(folder == "", F.array().cast("array<string>")).otherwise(F.split(folder, "/"))
    base = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - dots + 1, F.lit(0)))
    return F.when(dots == 0, module).when(dots - 1 <= F.size(parts), F.array_join(F.filter(F.concat(base, F.array(module)), lambda x: x != ""), "."))


def python_imports(files: DataFrame) -> DataFrame:
    """(path, line, module, name) of imports; ``name`` is null where a whole module is imported. Relative modules are resolved."""
    rows = _python(files).select("path", F.explode("imports").alias("i"))
    return rows.select("path", "i.line", _absolute(F.col("path"), F.col("i.dots"), F.col("i.module")).alias("module"), "i.name").filter("module IS NOT NULL AND module != '' AND NOT name <=> '*'")


def python_names(files: DataFrame) -> DataFrame:
    """(module, name) bound at the top of each Python file: definitions, assignments, and what it imports."""
    return _python(files).select("module", F.explode("names").alias("name")).distinct()


def dangling_imports(files: DataFrame) -> DataFrame:
    """(path, line, module, name) of names that the module they are imported from does not bind, and that are no module below it.

    A module is the longest part of its dotted name that is a file here, or the whole name where that is a folder. Modules that are not here are not
    judged, nor are those that bind names when asked or import everything from another one. Each file is parsed once.
    """
    with scratch(files.sparkSession) as keep:
        return keep(_dangling(files, settle(_python(files))))


def _dangling(files: DataFrame, py: DataFrame) -> DataFrame:
    folders = files.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/")) - 1), lambda i: F.array_join(F.slice(F.split("path", "/"), F.lit(1), i), "."))).alias("module")).filter("module != ''").distinct() 
    # A file before a package of its name.
    targets = py.groupBy("module").agg(F.min_by(F.struct("names", "dynamic", "star", F.endswith("path", F.lit("/__init__.py")).alias("package")), F.endswith("path", F.lit("/__init__.py"))).alias("t")).select("module", "t.*")
    both = targets.select("module").union(folders).distinct()
    children = both.filter(F.contains("module", F.lit("."))).select(F.regexp_replace("module", r"\.[^.]+$", "").alias("target"), F.element_at(F.split("module", r"\."), -1).alias("name"))
    used = py.select("path", F.explode("imports").alias("i")).filter("i.name IS NOT NULL AND i.name != '*'")
    used = used.select("path", "i.line", _absolute(F.col("path"), F.col("i.dots"), F.col("i.module")).alias("module"), "i.name").filter("module IS NOT NULL AND module != ''")
    wanted = used.select("module").distinct()
    exact = wanted.join(targets.select("module"), "module", "left_semi").select("module", F.col("module").alias("target"))
    as_folder = wanted.join(folders, "module", "left_semi").join(exact.select("module"), "module", "left_anti").select("module", F.col("module").alias("target"))
    rest = wanted.join(exact.union(as_folder).select("module"), "module", "left_anti")
    shorter = longest_prefix(rest.withColumnRenamed("module", "name"), targets.select("module")).filter("module IS NOT NULL").select(F.col("name").alias("module"), F.col("module").alias("target"))
    met = used.join(exact.union(as_folder).union(shorter), "module").join(targets.withColumnRenamed("module", "target"), "target", "left")
    is_file = F.col("package").isNotNull()
    open_ = F.coalesce(F.col("dynamic") | F.col("star"), F.lit(False)) | F.coalesce(F.array_contains("names", F.col("name")), F.lit(False))
    asked = met.filter(~open_).withColumn("below", ~is_file | F.col("package"))
    known = children.withColumn("_child", F.lit(True)).distinct()
    return asked.join(known, ["target", "name"], "left").filter("NOT (below AND _child <=> true)").select("path", "line", "module", "name")


# Attributes and receivers of decorators that register routes.
ROUTE_VERBS = ("get", "post", "put", "patch", "delete", "head", "options", "route")
ROUTE_RECEIVERS = ("app", "router", "bp", "blueprint", "api", "route", "v1", "v2")


def routes(files: DataFrame, receivers: DataFrame | None = None) -> DataFrame:
    """(path, line, receiver, verb, function): functions that a decorator registers as routes.

    Its attribute is a verb, and the last name before it a receiver: those of ``receivers`` (name) or the usual ones, whatever their case.
    """

    @F.pandas_udf("array<struct<line:int,name:string,function:string>>")
    def read(texts: pd.Series) -> pd.Series:
        found = [None if t is None else statements(t) for t in texts]
        return pd.Series([[dict(zip(("line", "name", "function"), d, strict=True)) for d in decorated(x)] if x is not None else None for x in found])

    rows = files.filter(F.endswith("path", F.lit(".py"))).select("path", F.explode(read("text")).alias("d")).select("path", "d.*").filter(F.contains("name", F.lit(".")))
    parts = F.split("name", r"\.")
    named = rows.select("path", "line", F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), ".").alias("receiver"), F.element_at(parts, -1).alias("verb"), "function", F.lower(F.element_at(parts, -2)).alias("_last"))
    named = named.filter(F.lower("verb").isin(*ROUTE_VERBS))
    if receivers is None:
        return named.filter(F.col("_last").isin(*ROUTE_RECEIVERS)).drop("_last")
    return named.join(receivers.select(F.lower("name").alias("_last")).distinct(), "_last", "left_semi").drop("_last")


def import_edges(files: DataFrame) -> DataFrame:
    """(src, dst, line): which of these files' modules import which, and the first line that does."""
    used = python_imports(files).select(module_of(F.col("path")).alias("src"), F.when(F.col("name").isNull(), F.col("module")).otherwise(F.concat_ws(".", "module", "name")).alias("name"), "line")
    index = files.filter(F.endswith("path", F.lit(".py"))).select(module_of(F.col("path")).alias("module"))
    met = longest_prefix(used, index).filter("module IS NOT NULL AND module != src")
    return met.groupBy("src", F.col("module").alias("dst")).agg(F.min("line").alias("line"))


def test_counts(files: DataFrame) -> DataFrame:
    """(path, tests): tests of Python, Go and script files by their usual forms; -1 where the text is missing."""
    py, go = r"(?m)^\s*(?:async\s+)?def test\w*\(", r"(?m)^func Test\w*\("
    js = r"(?m)^\s*(?:it|test)(?:\.only)?\("
    n = F.when(F.endswith("path", F.lit(".py")), F.regexp_count("text", F.lit(py))).when(F.endswith("path", F.lit(".go")), F.regexp_count("text", F.lit(go))).when(F.col("path").rlike(r"\.[jt]sx?$"), F.regexp_count("text", F.lit(js))).otherwise(0)
    return files.select("path", F.coalesce(n, F.lit(-1)).alias("tests"))


def headings(files: DataFrame) -> DataFrame:
    """(path, line, number, title) of numbered headings."""
    code = lines(files)
    number = F.regexp_extract("code", r"^#+\s+(\d+)\.?\s+(.*)$", 1)
    return code.filter(number != "").select("path", "line", number.cast("int").alias("number"), F.regexp_extract("code", r"^#+\s+(\d+)\.?\s+(.*)$", 2).alias("title"))


def stated_counts(files: DataFrame) -> DataFrame:
    """(path, line, said, found): lines that announce a number of items and are followed by a list of another length.

    A list is the run of list lines right below; runs are islands of consecutive line numbers.
    """
    code = lines(files)
    w = Window.partitionBy("path").orderBy("line")
    item = F.col("code").rlike(r"^\s*(?:[-*]|\d+\.)\s")
    islands = code.filter(item).withColumn("island", F.col("line") - F.row_number().over(w)).groupBy("path", "island").agg(F.min("line").alias("starts"), F.count("*").alias("found"))
    said = code.select("path", "line", F.regexp_extract("code", r"\b(\d+)\s+\w+[^.]*:\s*$", 1).alias("said")).filter("said != ''").withColumn("said", F.col("said").cast("long"))
    return said.join(islands.select("path", (F.col("starts") - 1).alias("line"), "found"), ["path", "line"]).filter("said != found")


def resolved(path: Column) -> Column:
    """A path without ``.`` and ``..`` parts, however many; steps up from the top stay."""
    def step(done: Column, part: Column) -> Column:
        up = (part == "..") & (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1)) != "..")
        return F.when((part == ".") | (part == ""), done).when(up, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(F.array_append(done, part))

    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def dead_references(files: DataFrame) -> DataFrame:
    """(path, line, target) of relative links in documents to files that are not there."""
    docs = lines(files.filter(F.endswith("path", F.lit(".md"))))
    links = docs.select("path", "line", F.explode(F.regexp_extract_all("code", F.lit(r"\]\((?!\w+:|#)([^)#\s]+)"), 1)).alias("target"))
    full = resolved(F.concat(F.regexp_replace("path", r"[^/]*$", ""), "target"))
    return links.withColumn("full", full).join(files.select(F.col("path").alias("full")).distinct(), "full", "left_anti").select("path", "line", "target")


def verb_sites(files: DataFrame, verbs: list[str]) -> DataFrame:
    """(verb, chain, first): dotted call chains whose last name is one of the verbs, with the first ``path:line`` of each."""
    calls = lines(files).select("path", "line", F.explode(F.regexp_extract_all("code", F.lit(r"([A-Za-z_]\w*(?:\.\w+)+)\s*\("), 1)).alias("chain"))
    verb = F.element_at(F.split("chain", r"\."), -1)
    own = calls.withColumn("verb", verb).filter(F.col("verb").isin(verbs))
    return own.groupBy("verb", "chain").agg(F.min_by(F.concat_ws(":", "path", "line"), F.struct("path", "line")).alias("first"))


# How documents mark what they pin.
PIN, PIN_FILE, PIN_SYMBOL = ("<!--", "pinned:", "-->"), "::", "="


def pins(files: DataFrame) -> DataFrame:
    """(path, file, symbol, value) of ``<!-- pinned: file::symbol=value -->`` marks in documents; symbol and value may be missing.

    What stands in fences or code spans shows a mark and is none. A mark that does not split into a file without spaces and a name pins the file that it spells.
    """
    fenced = F.split("text", "```")
    closed = F.size(fenced) % 2 == 1  # an open fence hides nothing
    prose = F.array_join(F.filter(fenced, lambda _, i: (i % 2 == 0) | (~closed & (i == F.size(fenced) - 1))), "\n")
    comments = F.transform(F.slice(F.split(F.regexp_replace(prose, "`[^`\n]*`", ""), PIN[0]), F.lit(2), F.lit(1 << 30)), lambda c: F.when(F.contains(c, F.lit(PIN[2])), F.trim(F.regexp_replace(F.substring_index(c, PIN[2], 1), r"\s+", " "))))
    marks = files.select("path", F.explode(F.filter(comments, lambda c: F.startswith(c, F.lit(PIN[1])))).alias("c")).select("path", F.trim(F.substr("c", F.lit(len(PIN[1]) + 1))).alias("mark"))
    place, rest = F.substring_index("mark", PIN_FILE, 1), F.substr("mark", F.instr("mark", PIN_FILE) + len(PIN_FILE))
    name = F.substring_index(rest, PIN_SYMBOL, 1)
    whole = F.contains("mark", F.lit(PIN_FILE)) & place.rlike(r"^[^\s:]+$") & name.rlike(r"^[^\W\d]\w*$")
    value = F.when(whole & F.contains(rest, F.lit(PIN_SYMBOL)), F.substr(rest, F.instr(rest, PIN_SYMBOL) + 1))
    return marks.select("path", F.when(whole, place).otherwise(F.col("mark")).alias("file"), F.when(whole, name).alias("symbol"), value.alias("value"))


def pin_faults(marks: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(path, file, symbol, problem) of pins that do not hold, against files (path) and symbols (file, symbol, value)."""
    there = files.select(F.col("path").alias("file")).distinct().withColumn("_file", F.lit(True))
    known = symbols.select("file", "symbol", F.col("value").alias("_value"), F.lit(True).alias("_symbol"))
    met = marks.join(there, "file", "left").join(known, ["file", "symbol"], "left")
    problem = F.when(F.col("file") == "", "empty").when(F.col("_file").isNull(), "no file").when(F.col("symbol").isNotNull() & F.col("_symbol").isNull(), "no symbol")
    return met.select("path", "file", "symbol", problem.when(F.col("value").isNotNull() & ~F.col("value").eqNullSafe(F.col("_value")), "other value").alias("problem")).filter("problem IS NOT NULL")


def prose_counts(files: DataFrame, truth: DataFrame, past: str = "") -> DataFrame:
    """(path, line, noun, said, n): numbers of things in documents that are not what there are, by ``truth`` (noun, n).

    A quoted line and one that matches ``past`` speak of another time and are not judged.
    """
    now = lines(files).filter(~F.col("code").rlike(r"^\s*>"))
    now = now.filter(~F.col("code").rlike(past)) if past else now
    said = now.select("path", "line", F.explode(F.regexp_extract_all("code", F.lit(r"\b(\d+ [a-z]+)\b"), 1)).alias("s"))
    split = said.select("path", "line", F.substring_index("s", " ", 1).cast("long").alias("said"), F.substring_index("s", " ", -1).alias("noun"))
    return split.join(truth, "noun").filter("said != n").select("path", "line", "noun", "said", "n")


def populations(counts: dict[str, DataFrame]) -> DataFrame:
    """(noun, n): how many rows there are of each."""
    out = None
    for noun, rows in counts.items():
        own = rows.agg(F.count("*").alias("n")).select(F.lit(noun).alias("noun"), "n")
        out = own if out is None else out.union(own)
    return out
