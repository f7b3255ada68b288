"""Snapshots and baselines: what was added, removed, changed, carried over, or is declared but not used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def snapshot_diff(before: DataFrame, after: DataFrame, key: str = "path", digest: str = "sha") -> DataFrame:
    """(key, mark): ``+`` added, ``-`` removed, ``~`` changed. One full outer join; equal rows are dropped."""
    b, a = before.select(key, F.col(digest).alias("_b")), after.select(key, F.col(digest).alias("_a"))
    mark = F.when(F.col("_b").isNull(), "+").when(F.col("_a").isNull(), "-").when(F.col("_a") != F.col("_b"), "~")
    return b.join(a, key, "full_outer").select(key, mark.alias("mark")).filter("mark IS NOT NULL")


def shown(diff: DataFrame, limit: int = 6, key: str = "path") -> DataFrame:
    """(mark, text): the first keys of each mark and how many more there are. Each task sends on at most ``limit`` keys of a mark."""
    w = Window.partitionBy("mark").orderBy(key)
    first = diff.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= limit).groupBy("mark").agg(F.array_sort(F.collect_list(key)).alias("first"))
    all_ = diff.groupBy("mark").agg(F.count("*").alias("n")).join(first, "mark")
    more = F.when(F.col("n") > limit, F.concat(F.lit(", …and "), (F.col("n") - limit).cast("string"), F.lit(" more"))).otherwise("")
    return all_.select("mark", F.concat(F.array_join("first", ", "), more).alias("text"))


def moved_keys(before: Column, after: Column) -> Column:
    """Keys of two maps whose values differ; a missing key differs from a null-free one."""
    return F.array_sort(F.map_keys(F.map_filter(F.map_zip_with(before, after, lambda k, x, y: ~x.eqNullSafe(y)), lambda k, v: v)))


def baseline_split(found: DataFrame, baseline: DataFrame, complete: bool, key: str = "id") -> DataFrame:
    """(key, side): ``new``, ``carried`` or ``stale``. Known findings that were not found again are stale only if the scan was complete."""
    f, b = found.select(key).distinct().withColumn("_f", F.lit(True)), baseline.select(key).distinct().withColumn("_b", F.lit(True))
    side = F.when(F.col("_b").isNull(), "new").when(F.col("_f").isNull(), "stale").otherwise("carried")
    out = f.join(b, key, "full_outer").select(key, side.alias("side"))
    return out if complete else out.filter("side != 'stale'")


def carried_under_any(found: DataFrame, baseline: DataFrame, names: Column, key: str = "id") -> DataFrame:
    """Findings with whether the baseline knows them under any of their names."""
    hit = found.select(key, F.explode(names).alias("_n")).join(baseline.select(F.col(key).alias("_n")).distinct(), "_n", "left_semi").select(key).distinct()
    return found.join(hit.withColumn("carried", F.lit(True)), key, "left").withColumn("carried", F.coalesce("carried", F.lit(False)))


def usage(declared: DataFrame, written: DataFrame, read: DataFrame, key: str = "name") -> DataFrame:
    """(key, use) of every declared name: ``both``, ``written only``, ``read only`` or ``neither``; undeclared names that are used are ``undeclared``."""
    flag = lambda d, n: d.select(key).distinct().withColumn(n, F.lit(True))
    all_ = flag(declared, "_d").join(flag(written, "_w"), key, "full_outer").join(flag(read, "_r"), key, "full_outer")
    use = F.when(F.col("_d").isNull(), "undeclared").when(F.col("_w") & F.col("_r"), "both").when(F.col("_w"), "written only").when(F.col("_r"), "read only").otherwise("neither")
    return all_.select(key, use.alias("use"))


def reconcile(rows: DataFrame, records: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, problem) for keys on one side only and for fields that disagree."""
    r = rows.select(key, *(F.col(f).alias(f"_r_{f}") for f in fields), F.lit(True).alias("_r"))
    o = records.select(key, *(F.col(f).alias(f"_o_{f}") for f in fields), F.lit(True).alias("_o"))
    problem = F.when(F.col("_o").isNull(), "no record").when(F.col("_r").isNull(), "no row")
    for f in fields:
        problem = problem.when(~F.col(f"_r_{f}").eqNullSafe(F.col(f"_o_{f}")), f"{f} differs")
    return r.join(o, key, "full_outer").select(key, problem.alias("problem")).filter("problem IS NOT NULL")


def grew(before: DataFrame, after: DataFrame, key: list[str], value: str) -> DataFrame:
    """Keys of both versions whose value is greater in the second."""
    return before.select(*key, F.col(value).alias("before")).join(after.select(*key, F.col(value).alias("after")), key).filter("after > before")


def weakened(before: DataFrame, after: DataFrame, key: str = "path", tests: str = "tests") -> DataFrame:
    """Files that lost tests: deleted with some, or fewer than before. A negative count is unreadable and skipped."""
    b, a = before.select(key, F.col(tests).alias("before")), after.select(key, F.col(tests).alias("after"))
    out = b.join(a, key, "left").withColumn("deleted", F.col("after").isNull()).withColumn("after", F.coalesce("after", F.lit(0)))
    return out.filter("before >= 0 AND after >= 0 AND after < before")
