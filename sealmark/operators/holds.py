"""What holds a piece of work back: unions of filters, each with a code; ordered refusals; guarded transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def holds(rows: DataFrame, key: str, codes: list[tuple[str, Column]]) -> DataFrame:
    """(key, hold): one row for each code whose condition is true. One pass over the rows; null conditions do not hold."""
    found = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in codes)))
    return rows.select(key, F.explode(found).alias("hold"))


def first_refusal(codes: list[tuple[str, Column]]) -> Column:
    """Name of the first condition that is true; null if none is."""
    return F.coalesce(*(F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in codes))


def dependency_holds(works: DataFrame, needs: DataFrame) -> DataFrame:
    """(id, needs, hold): dependencies that are of an old revision, or not settled. ``works`` has id, revision, settled."""
    of = works.select(F.col("id").alias("needs"), F.col("revision").alias("_now"), "settled")
    hold = F.when(F.col("_now").isNull() | (F.col("_now") != F.col("revision")), "stale").when(~F.coalesce("settled", F.lit(False)), "unsettled")
    return needs.join(of, "needs", "left").select("id", "needs", hold.alias("hold")).filter("hold IS NOT NULL")


def newest_assignment(assignments: DataFrame, task: str, owner: str, at: str) -> DataFrame:
    """(task, owner, conflict): owner of the newest assignment, and whether several own the task."""
    return assignments.groupBy(task).agg(F.max_by(owner, F.struct(at, owner)).alias(owner), (F.count_distinct(owner) > 1).alias("conflict"))


def receipts(rows: DataFrame, allowed: dict[str, list[str]]) -> DataFrame:
    """Receipts with ``applied`` and ``kept_as``: an outcome applies if the dispatch state allows it, and is kept as history otherwise; a receipt of another worker is kept as a conflict."""
    may = F.lit(False)
    for state, outcomes in allowed.items():
        may = may | ((F.col("state") == state) & F.col("outcome").isin(outcomes))
    same = F.col("worker").eqNullSafe(F.col("assigned"))
    kept = F.when(~same, "conflict").when(may, F.col("outcome")).otherwise(F.concat(F.lit("historical_after_"), F.col("state")))
    return rows.withColumns({"applied": same & may, "kept_as": kept})


def settle(results: DataFrame, key: str, order: str) -> DataFrame:
    """(key, status, conflict): the highest status ever reached, and whether a later result differs from the first one."""
    first = F.min_by("result", order)
    ranked = F.max(F.col("rank"))
    return results.groupBy(key).agg(ranked.alias("status"), (F.count_distinct("result") > 1).alias("conflict"), first.alias("first"))


def undisposed(live: DataFrame, disposed: DataFrame, keys: list[str]) -> DataFrame:
    """Live works without a disposition, and works disposed twice: (keys…, problem)."""
    count = disposed.groupBy(*keys).agg(F.count("*").alias("_n"))
    met = live.select(*keys).distinct().join(count, keys, "left")
    problem = F.when(F.col("_n").isNull(), "missing").when(F.col("_n") > 1, "twice")
    return met.select(*keys, problem.alias("problem")).filter("problem IS NOT NULL")
