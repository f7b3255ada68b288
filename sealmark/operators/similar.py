"""Exact set-similarity joins over tokens, and names and lines against a vocabulary that is itself a table."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import ceil

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sealmark.functions import text as X
from sealmark.operators.settled import scratch, settle

#: Bytes of expressions that one task compiles at once; more are taken in blocks.
BLOCK_BYTES = 1 << 20
#: Partitions that lines are dealt to before expressions are searched in them: a small table is one task of a scan.
PARTS = 48


def _prefixes(sets: DataFrame, ranks: DataFrame, threshold: float) -> DataFrame:
    """(set, size, token) of the rarest tokens of each set: sets as alike as ``threshold`` share one of them."""
    cells = sets.select("set", F.size("tokens").alias("size"), F.explode("tokens").alias("token")).join(ranks, "token")
    ordered = cells.groupBy("set", "size").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("x"))  # of one sentence
    keep = F.col("size") - F.ceil(F.lit(threshold) * F.col("size") - 1e-9).cast("int") + 1
    return ordered.select("set", "size", F.explode(F.slice("x", F.lit(1), keep)).alias("y")).select("set", "size", "y.token")


def repeated(new: DataFrame, history: DataFrame, threshold: float, text: str = "sentence", about: str = "about") -> DataFrame:
    """(sentence, about): distinct ones of ``new`` (sentence, about) that are more alike than ``threshold`` to one of ``history`` about something else.

    Likeness is that of ``jaccard`` over tokens. Both sides are first reduced to distinct token sets, of the history with the least and the
    greatest of what they are about, so that a sentence said a million times is one row. Sets meet by their rarest tokens, with sizes that allow the
    likeness, and are then compared exactly. A null ``about`` is the empty one.
    """
    with scratch(new.sparkSession) as keep:
        sets = lambda df: df.select(F.col(text).alias("sentence"), F.coalesce(F.col(about).cast("string"), F.lit("")).alias("about"), F.array_sort(X.tokens(F.coalesce(F.col(text), F.lit("")))).alias("tokens")).filter(F.size("tokens") > 0)
        named = lambda df: df.withColumn("set", F.sha2(F.array_join("tokens", " "), 256))
        asked = settle(named(sets(new).distinct()))
        held = settle(named(sets(history).groupBy("tokens").agg(F.min("about").alias("low"), F.max("about").alias("high"))))
        a = asked.select("set", "tokens").distinct()
        both = a.union(held.select("set", "tokens")).distinct()
        ranks = settle(both.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n")))
        left, right = _prefixes(a, ranks, threshold), _prefixes(held.select("set", "tokens"), ranks, threshold).withColumnsRenamed({"set": "other", "size": "other_size"})
        fits = (F.col("other_size") >= threshold * F.col("size") - 1e-9) & (F.col("size") >= threshold * F.col("other_size") - 1e-9)
        pairs = left.join(right, "token").filter(fits).select("set", "other").distinct()
        near = pairs.join(a, "set").join(held.select(F.col("set").alias("other"), F.col("tokens").alias("told"), "low", "high"), "other")
        near = settle(near.filter(X.jaccard(F.col("tokens"), F.col("told")) > threshold).groupBy("set").agg(F.min("low").alias("low"), F.max("high").alias("high")))
        return keep(asked.join(near, "set").filter((F.col("low") != F.col("about")) | (F.col("high") != F.col("about"))).select("sentence", "about").distinct())


# --- vocabularies ----------------------------------------------------------------------------------


def required_runs(expression: str) -> list[str]:
    """Runs of characters that every match of an expression must have; none where none is certain.

    Read off the plain characters outside groups and alternatives; one that a quantifier follows ends its run, and is not certain itself.
    """
    if "|" in expression or "(?" in expression:
        return []
    runs, run, depth, i = [], "", 0, 0
    while i < len(expression):
        c, width = expression[i], 1
        if c == "\\":
            width = 2
            plain = expression[i + 1 : i + 2]
            plain = plain if plain and not plain.isalnum() else ""
        elif c == "[":
            end = expression.find("]", i + (3 if expression[i + 1 : i + 2] == "^" else 2))
            width, plain = (end - i + 1 if end > 0 else len(expression)), ""
        elif c in "()":
            depth, plain = depth + (1 if c == "(" else -1), ""
        else:
            plain = "" if c in ".^$*+?{}" else c
        follows = expression[i + width : i + width + 1]
        if plain and not depth and follows not in ("*", "?", "{", "+"):
            run += plain
        elif run:
            runs.append(run)
            run = ""
        if c == "{":
            width = max(expression.find("}", i) - i + 1, 1)
        i += width
    return [*runs, run] if run else runs


def required(expression: str) -> str:
    """The longest of the required runs of an expression."""
    return max(required_runs(expression), key=len, default="")


def sought(block: list[str]) -> tuple[dict[str, list[int]], list[int]]:
    """Expressions by the run that stands for each, and those without one: of its required runs, the one that the fewest expressions share, then the longest."""
    runs = [required_runs(p) for p in block]
    shared = Counter(r for own in runs for r in set(own))
    by: dict[str, list[int]] = {}
    for i, own in enumerate(runs):
        if own:
            by.setdefault(min(own, key=lambda r: (shared[r], -len(r))), []).append(i)
    return by, [i for i, own in enumerate(runs) if not own]


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of expressions; one that is none fails here, before any line is searched."""
    for b in batches:
        every = b.column(0).to_pylist()
        for p in every:
            re.compile(p)
        yield pa.RecordBatch.from_arrays([pa.array([len(p.encode()) for p in every], pa.int64())], names=["size"])


def _matched(block: list[str]):
    by, always = sought(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        compiled: dict[int, re.Pattern] = {}
        machine = ahocorasick.Automaton()
        for literal, which in by.items():
            machine.add_word(literal, which)
        if by:
            machine.make_automaton()
        for b in batches:
            rows, found = [], []
            for n, line in enumerate(b.column(1).to_pylist()):
                if line is None:
                    continue
                tries = set(always)
                if by:
                    for _, which in machine.iter(line):
                        tries.update(which)
                for i in sorted(tries):
                    if i not in compiled:
                        compiled[i] = re.compile(block[i])
                    if compiled[i].search(line):
                        rows.append(n)
                        found.append(block[i])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(found, pa.string())], names=["id", "pattern"])

    return run


def vocabulary_hits(rows: DataFrame, facts: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, match, pattern) for every entry of ``facts`` (pattern, match) that a row (id, name, line) has.

    ``symbol``: ``.x`` names the attribute x of any receiver, ``a.b`` that name or one that ends in it: an equi join on the dotted ends of names.
    ``regex``: expressions are searched in lines, found by their required characters in one automaton; as many blocks of them as they have
    ``block_bytes``, so that no task holds a vocabulary that grows. Repeated entries count once, nulls never.
    """
    entries = facts.filter("pattern IS NOT NULL").select("pattern", "match").distinct()
    parts = F.split("name", r"\.", -1)
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts) - i + 1), "."))
    names = rows.filter("name IS NOT NULL").select("id", F.contains("name", F.lit(".")).alias("_inner"), F.explode(ends).alias("_end"))
    symbols = entries.filter("match = 'symbol'").select("pattern", F.startswith("pattern", F.lit(".")).alias("_any"), F.regexp_replace("pattern", r"^\.", "").alias("_end"))
    out = names.join(symbols.hint("merge"), "_end").filter("NOT _any OR _inner").select("id", F.lit("symbol").alias("match"), "pattern").distinct()
    expressions = entries.filter("match = 'regex'").select("pattern")
    size = expressions.repartition(PARTS).mapInArrow(_sizes, "size long").agg(F.sum("size")).first()[0] or 0
    blocks = ceil(size / block_bytes)
    kind = rows.schema["id"].dataType.simpleString()
    dealt = rows.select("id", "line").repartition(PARTS, "id")
    for k in range(blocks):
        block = sorted(r.pattern for r in expressions.filter(F.pmod(F.xxhash64("pattern"), F.lit(blocks)) == k).collect())  # about block_bytes
        out = out.union(dealt.mapInArrow(_matched(block), f"id {kind}, pattern string").select("id", F.lit("regex").alias("match"), "pattern"))
    return out
