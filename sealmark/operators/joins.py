"""Join shapes of the ledger: settled and unsettled claims, conflicts in time, resolution by candidates and prefixes."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sealmark.operators.latest import latest


def ended_tasks(events: DataFrame, kinds: list[str]) -> DataFrame:
    return events.filter(F.col("kind").isin(kinds) & F.col("task_id").isNotNull()).select("task_id").distinct()


def open_tasks(tasks: DataFrame, ended: DataFrame, standing: list | None = None) -> DataFrame:
    """Tasks without an ending, but for the standing ones. An anti join, so a null on either side loses no row."""
    gone = ended.select(F.col("task_id").alias("id"))
    out = tasks.join(gone, "id", "left_anti")
    return out.filter(~F.col("id").isin(standing)) if standing else out


def newest_with_exit(claims: DataFrame, attempts: DataFrame, code: int) -> DataFrame:
    """Claims whose newest attempt ended with this code."""
    last = latest(attempts.select("claim_id", "id", "exit_code"), "claim_id").filter(F.col("exit_code") == code)
    return claims.join(last.select(F.col("claim_id").alias("id")), "id", "left_semi")


def unsettled_failures(claims: DataFrame, attempts: DataFrame, signed: DataFrame, retracted: DataFrame) -> DataFrame:
    """Claims whose newest attempt failed, that nobody signed for and nothing retracted."""
    failed = newest_with_exit(claims, attempts, 1)
    for settled in (signed, retracted):
        failed = failed.join(settled.select(F.col("claim_id").alias("id")), "id", "left_anti")
    return failed


def settled(claims: DataFrame, *proofs: DataFrame) -> DataFrame:
    """Claims that any proof names. One semi join on the union costs less than a join for each proof."""
    keys = proofs[0].select("claim_id")
    for p in proofs[1:]:
        keys = keys.union(p.select("claim_id"))
    return claims.join(keys.distinct().withColumnRenamed("claim_id", "id"), "id", "left_semi")


def never_tried(claims: DataFrame, attempts: DataFrame, checker: str) -> DataFrame:
    """Claims without an attempt whose checker was never tried on any claim; counted by checker."""
    tried = attempts.select(F.col("claim_id").alias("id"))
    used = claims.join(tried, "id", "left_semi").select(checker).distinct()
    return claims.join(tried, "id", "left_anti").join(used, checker, "left_anti").groupBy(checker).agg(F.count("*").alias("n"))


def conflicts(rows: DataFrame, writes: DataFrame, key: str, stamp: str, start: str, end: str) -> DataFrame:
    """Pairs of rows of a key with different stamps and no write between the end of the first and the start of the second.

    Rows are ordered by end and id. Only the next row of a key is paired with each, as a write between two rows is
    between two neighbours; the others follow from these. Writes meet the pairs by key.
    """
    w = Window.partitionBy(key).orderBy(end, "id")
    nxt = lambda c: F.lead(c).over(w)
    pairs = rows.select(key, "id", F.col(stamp).alias("stamp"), F.col(end).alias("ended"), nxt("id").alias("next_id"), nxt(stamp).alias("next_stamp"), nxt(start).alias("next_start")).filter("next_id IS NOT NULL AND NOT stamp <=> next_stamp")
    between = writes.select(F.col(key).alias("_k"), F.col("created_at").alias("_at"))
    return pairs.join(between, (F.col(key) == F.col("_k")) & (F.col("_at") > F.col("ended")) & (F.col("_at") < F.col("next_start")), "left_anti")


def first_existing(wanted: DataFrame, candidates: Column, existing: DataFrame) -> DataFrame:
    """``wanted`` with ``found``: the first of its candidates that exists, null if none does."""
    tries = wanted.select("id", F.posexplode(candidates).alias("rank", "path"))
    hit = tries.join(existing.select("path").distinct(), "path").groupBy("id").agg(F.min_by("path", "rank").alias("found"))
    return wanted.join(hit, "id", "left")


def prefixes(dotted: Column) -> Column:
    """All prefixes of a dotted name, shortest first."""
    parts = F.split(dotted, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))


def longest_prefix(names: DataFrame, index: DataFrame, name: str = "name", known: str = "module") -> DataFrame:
    """``names`` with the longest dotted prefix that the index knows, null if none. An equi join on exploded prefixes."""
    tries = names.select(name, F.explode(prefixes(F.col(name))).alias(known))
    hit = tries.join(index.select(known).distinct(), known).groupBy(name).agg(F.max_by(known, F.length(known)).alias(known))
    return names.join(hit, name, "left")


def defined_used_elsewhere(definitions: DataFrame, uses: DataFrame, least: int = 5) -> DataFrame:
    """Names of a minimal length that only one place defines and other places use: (name, defined_in, used_in)."""
    own = definitions.filter(F.length("name") >= least).groupBy("name").agg(F.min("path").alias("defined_in"), F.count_distinct("path").alias("places")).filter("places = 1").drop("places")
    used = uses.select("name", "path").distinct()
    met = own.join(used, "name").filter("path != defined_in")
    return met.groupBy("name", "defined_in").agg(F.array_sort(F.collect_set("path")).alias("used_in"))


def crossings(edges: DataFrame, layers: DataFrame, allowed: DataFrame) -> DataFrame:
    """Edges between layers that may not import each other."""
    of = lambda end: layers.select(F.col("path").alias(end), F.col("layer").alias(f"{end}_layer"))
    placed = edges.join(of("src"), "src").join(of("dst"), "dst").filter("src_layer != '' AND dst_layer != '' AND src_layer != dst_layer")
    return placed.join(allowed, ["src_layer", "dst_layer"], "left_anti")


#: Lines in a cell of a file, in which lines and spans meet.
CELL = 64


def enclosing(lines: DataFrame, spans: DataFrame) -> DataFrame:
    """(path, line, name): the innermost of the spans (path, name, first, last) around each line (path, line).

    An interval join as an equi join on cells of a file; of spans around one line the one that begins last is innermost,
    then the shorter one, then the lesser name.
    """
    cell = lambda c: F.floor(F.col(c) / CELL)
    cut = spans.withColumn("_cell", F.explode(F.sequence(cell("first"), cell("last"))))
    met = lines.withColumn("_cell", cell("line")).join(cut, ["path", "_cell"]).filter("line BETWEEN first AND last")
    return met.groupBy("path", "line").agg(F.min_by("name", F.struct(-F.col("first"), "last", "name")).alias("name"))
