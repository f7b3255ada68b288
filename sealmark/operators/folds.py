"""Ordered folds over events. Where only the last word on a key counts, the fold is a join or a maximum, not a loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sealmark.operators.latest import latest


def last_word(changes: DataFrame, keys: list[str], added: Column, order: str = "id") -> DataFrame:
    """Keys whose newest change added them. Widening, narrowing and widening again keeps a key, as a fold in order would."""
    marked = changes.withColumn("_add", added)
    return marked.groupBy(*keys).agg(F.max_by("_add", order).alias("_add")).filter("_add").drop("_add")


def current_scope(base: DataFrame, changes: DataFrame) -> DataFrame:
    """(task_id, glob) in scope: the base globs, then accepted widenings and narrowings by id.

    ``base`` is (task_id, glob); ``changes`` is (id, task_id, kind, glob, accepted).
    """
    start = base.select(F.lit(-1).cast("long").alias("id"), "task_id", "glob", F.lit(True).alias("_add"))
    moves = changes.filter((F.col("kind") == "scope_narrow") | F.coalesce("accepted", F.lit(True))).select("id", "task_id", "glob", (F.col("kind") == "scope_widen").alias("_add"))
    return last_word(start.union(moves), ["task_id", "glob"], F.col("_add"))


def standing(entries: DataFrame, withdrawals: DataFrame, keys: list[str], order: str = "id") -> DataFrame:
    """Entries that no later withdrawal of the same key cancels. The newest withdrawal decides, so the join is one to one."""
    last = withdrawals.groupBy(*keys).agg(F.max(order).alias("_w"))
    return entries.join(last, keys, "left").filter(F.col("_w").isNull() | (F.col(order) > F.col("_w"))).drop("_w")


def merged(events: DataFrame, key: str, payload: str = "payload", order: str = "id") -> DataFrame:
    """(key, field, value): of each field of each key the newest value; fields that a later payload lacks stay.

    One row a field, so that a key with any number of events is never gathered.
    """
    fields = events.select(key, F.col(order).alias("_o"), F.explode(F.col(payload)).alias("field", "value"))
    return fields.groupBy(key, "field").agg(F.max_by("value", "_o").alias("value"))


def split_last(events: DataFrame, key: str, good: Column, order: str = "id") -> DataFrame:
    """Newest event of each key, with whether it counts as evaluated."""
    return latest(events, key, order).withColumn("evaluated", F.coalesce(good, F.lit(False)))


def epoch_counts(events: DataFrame, key: str, closes: Column, item: str, limit: int, order: str = "id") -> DataFrame:
    """(key, used, refused): distinct items since the last closing event of each key, and whether they reach the limit."""
    last = events.filter(closes).groupBy(key).agg(F.max(order).alias("_c"))
    open_ = events.filter(~closes).join(last, key, "left").filter(F.col("_c").isNull() | (F.col(order) > F.col("_c")))
    used = open_.groupBy(key).agg(F.count_distinct(item).alias("used"))
    return events.select(key).distinct().join(used, key, "left").select(key, F.coalesce("used", F.lit(0).cast("long")).alias("used")).withColumn("refused", F.col("used") >= limit)


def running_skip(rows: DataFrame, key: str, cost: str, failed: Column, expensive: int) -> DataFrame:
    """Rows of each key, cheapest first, with whether they are skipped: an expensive one after a cheap one failed."""
    w = Window.partitionBy(key).orderBy(cost, "id").rowsBetween(Window.unboundedPreceding, -1)
    cheap_failed = F.coalesce(F.max(failed & (F.col(cost) < expensive)).over(w), F.lit(False))
    return rows.withColumn("skipped", (F.col(cost) >= expensive) & cheap_failed)


def drops(rows: DataFrame, key: str, number: str, order: str) -> DataFrame:
    """Rows whose number is less than that of the row before them in the same key."""
    w = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("before", F.lag(number).over(w)).filter(F.col(number) < F.col("before"))
