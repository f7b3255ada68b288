"""Grouped reports: counts, upper medians, histograms, before and after, roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sealmark.operators.latest import latest


def upper_medians(rows: DataFrame, key: str, value: str, name: str = "median") -> DataFrame:
    """(key, n, median, max); the median is the upper one of two.

    No group is gathered: values are counted, and the median is where their running count passes one half. A group of any size shuffles one row for each distinct value.
    """
    counted = rows.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("_c"))
    upto = Window.partitionBy(key).orderBy(value)
    whole = Window.partitionBy(key)
    placed = counted.withColumns({"_upto": F.sum("_c").over(upto), "_n": F.sum("_c").over(whole)})
    half = F.floor(F.col("_n") / 2)
    here = (F.col("_upto") > half) & (F.col("_upto") - F.col("_c") <= half)
    return placed.groupBy(key).agg(F.max("_n").alias("n"), F.max(F.when(here, F.col(value))).alias(name), F.max(value).alias("max"))


def seeded_counts(rows: DataFrame, seeds: DataFrame, key: str, **counts: Column) -> DataFrame:
    """Counts for every seed, 0 where there is no row; rows of other keys go to the bucket of the empty key. Rows are counted before they meet the seeds."""
    own = rows.groupBy(key).agg(*(F.count_if(c).alias(n) for n, c in counts.items()))
    known = seeds.select(F.col(key).alias("_seed")).distinct()
    placed = own.join(known, own[key] == F.col("_seed"), "left").groupBy(F.coalesce("_seed", F.lit("")).alias(key)).agg(*(F.sum(n).alias(n) for n in counts))
    return seeds.select(key).union(seeds.sparkSession.range(1).select(F.lit(""))).distinct().join(placed, key, "left").na.fill(0)


def histogram(rows: DataFrame, keys: list[str], label: Column, labels: list[str]) -> DataFrame:
    """One count a label for each key."""
    return rows.groupBy(*keys).agg(*(F.count_if(label == x).alias(x) for x in labels))


def lag_to_first(tasks: DataFrame, events: DataFrame, first: Column, counted: Column, watched: Column) -> DataFrame:
    """For each task: when its first event of a kind came, how many other events came before it, and whether it was watched.

    A task without such an event counts all of the others, as if the first were yet to come.
    """
    at = events.groupBy("task_id").agg(F.min(F.when(first, F.col("created_at"))).alias("first_at"), F.max(watched).alias("watched"))
    joined = events.join(at, "task_id")
    before = joined.filter(counted & (F.col("first_at").isNull() | (F.col("created_at") < F.col("first_at")))).groupBy("task_id").agg(F.count("*").alias("before_first"))
    out = tasks.withColumnRenamed("id", "task_id").join(at, "task_id", "left").join(before, "task_id", "left")
    return out.withColumn("before_first", F.coalesce("before_first", F.lit(0).cast("long")))


def around_first(claims: DataFrame, events: DataFrame, first: Column) -> DataFrame:
    """For each task: claims made before and after its first such event; null counts where there was none."""
    at = events.filter(first).groupBy("task_id").agg(F.min("created_at").alias("first_at"))
    own = claims.join(at, "task_id", "left")
    seen = F.col("first_at").isNotNull()
    count = lambda c: F.when(F.max(seen), F.count_if(c))
    return own.groupBy("task_id").agg(count(F.col("created_at") < F.col("first_at")).alias("before"), count(F.col("created_at") >= F.col("first_at")).alias("after"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))


def cost_by_source(costs: DataFrame) -> DataFrame:
    return costs.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.coalesce("tokens", F.lit(0))).alias("tokens"), F.sum(F.coalesce("wall_ms", F.lit(0))).alias("wall_ms"))


def collapse(findings: DataFrame, keys: list[str], line: str = "line") -> DataFrame:
    """One claim for all findings of a key: its least line and all lines in order."""
    return findings.groupBy(*keys).agg(F.min(line).alias(line), F.array_sort(F.collect_set(line)).alias("lines"))


def last_per(events: DataFrame, key: Column, name: str) -> DataFrame:
    """Newest event of each key that is computed from the event."""
    return latest(events.withColumn(name, key), name)


def distinct_states(attempts: DataFrame, settled: list[int]) -> DataFrame:
    """For each claim: failing attempts and the distinct states they were in. A struct keeps tuples that hold a null."""
    failing = attempts.filter(~F.col("exit_code").isin(settled))
    state = F.struct("subject_digest", "checker_sha", "worktree")
    return failing.groupBy("claim_id").agg(F.count("*").alias("fails"), F.count_distinct(state).alias("states"))
