"""Snapshots, baselines and reconciliations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sealmark import views as V
from sealmark.operators import diff, joins
from sealmark.plans.registry import query

_AB = "a_v AS (SELECT path, sha FROM path_v WHERE id % 10 <> 3), b_v AS (SELECT path, CASE WHEN id % 7 = 0 THEN 'x' || sha ELSE sha END AS sha FROM path_v WHERE id % 10 <> 4)"
_DIFF = f"WITH {_AB}, d_v AS (SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN '+' WHEN b.path IS NULL THEN '-' WHEN a.sha <> b.sha THEN '~' END AS mark FROM a_v a FULL JOIN b_v b ON a.path = b.path) "


def _snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = V.path(spark, d)
    after = p.filter("id % 10 != 4").withColumn("sha", F.when(F.col("id") % 7 == 0, F.concat(F.lit("x"), "sha")).otherwise(F.col("sha")))
    return p.filter("id % 10 != 3"), after


@query(_DIFF + "SELECT path, mark FROM d_v WHERE mark IS NOT NULL")
def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    return diff.snapshot_diff(*_snapshots(spark, d))


@query(_DIFF + "SELECT mark, list_aggregate(list_sort(list(path))[1:6], 'string_agg', ', ') || ', …and ' || (count(*) - 6) || ' more' AS text FROM d_v WHERE mark IS NOT NULL GROUP BY 1")
def snapshot_diff_shown(spark: SparkSession, d: str) -> DataFrame:
    return diff.shown(diff.snapshot_diff(*_snapshots(spark, d)))


@query("SELECT a.path FROM path_v a WHERE a.id % 10 <> 3 AND NOT EXISTS (SELECT 1 FROM path_v b WHERE b.id % 10 <> 4 AND b.path = a.path)")
def deleted_paths(spark: SparkSession, d: str) -> DataFrame:
    before, after = _snapshots(spark, d)
    return before.join(after.select("path"), "path", "left_anti").select("path")


@query("SELECT task_id, list_aggregate(list_sort(list(DISTINCT kind)), 'string_agg', ',') AS moved FROM (SELECT task_id, kind, sum(k) FILTER (id < 5000) AS a, sum(k) FILTER (id >= 5000) AS b FROM event_v GROUP BY 1, 2) WHERE a IS DISTINCT FROM b GROUP BY 1")
def moved_keys(spark: SparkSession, d: str) -> DataFrame:
    e = V.event(spark, d).groupBy("task_id", "kind").agg(F.sum(F.when(F.col("id") < 5000, F.col("k"))).alias("a"), F.sum(F.when(F.col("id") >= 5000, F.col("k"))).alias("b"))
    maps = e.groupBy("task_id").agg(*(F.map_from_entries(F.collect_list(F.struct("kind", c))).alias(c) for c in "ab"))
    return maps.select("task_id", F.array_join(diff.moved_keys(F.col("a"), F.col("b")), ",").alias("moved")).filter("moved != ''")


@query(f"SELECT coalesce(f.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'new' WHEN f.id IS NULL THEN 'stale' ELSE 'carried' END AS side FROM (SELECT id FROM path_v WHERE path NOT LIKE '%bolt%') f FULL JOIN (SELECT id FROM path_v WHERE size < {V.BASELINE_SIZE}) b ON f.id = b.id")
def baseline_split(spark: SparkSession, d: str) -> DataFrame:
    p = V.path(spark, d)
    return diff.baseline_split(p.filter("path NOT LIKE '%bolt%'"), p.filter(F.col("size") < V.BASELINE_SIZE), complete=True)


@query(f"SELECT id, id IN (SELECT id FROM path_v WHERE size < {V.BASELINE_SIZE}) OR id + 1 IN (SELECT id FROM path_v WHERE size < {V.BASELINE_SIZE}) AS carried FROM path_v")
def baseline_with_renames(spark: SparkSession, d: str) -> DataFrame:
    p = V.path(spark, d).select("id", "size")
    return diff.carried_under_any(p, p.filter(F.col("size") < V.BASELINE_SIZE), F.array("id", F.col("id") + 1)).select("id", "carried")


@query("WITH d_v AS (SELECT id AS name FROM path_v WHERE size > 20), w_v AS (SELECT DISTINCT subject_digest * 100 + checker_sha % 100 AS name FROM attempt_v WHERE exit_code = 0), r_v AS (SELECT DISTINCT subject_digest * 100 + checker_sha % 100 AS name FROM attempt_v WHERE exit_code = 1) SELECT coalesce(d.name, w.name, r.name) AS name, CASE WHEN d.name IS NULL THEN 'undeclared' WHEN w.name IS NOT NULL AND r.name IS NOT NULL THEN 'both' WHEN w.name IS NOT NULL THEN 'written only' WHEN r.name IS NOT NULL THEN 'read only' ELSE 'neither' END AS use FROM d_v d FULL JOIN w_v w ON w.name = d.name FULL JOIN r_v r ON r.name = coalesce(d.name, w.name)")
def declared_and_used(spark: SparkSession, d: str) -> DataFrame:
    a = V.attempt(spark, d).select((F.col("subject_digest") * 100 + F.col("checker_sha") % 100).alias("name"), "exit_code")
    return diff.usage(V.path(spark, d).filter("size > 20").select(F.col("id").alias("name")), a.filter("exit_code = 0"), a.filter("exit_code = 1"))


@query("WITH a_v AS (SELECT claim_id, kind, signed_by FROM risk_v WHERE claim_id % 5 <> 0), b_v AS (SELECT claim_id, CASE WHEN claim_id % 9 = 0 THEN 'x' ELSE kind END AS kind, CASE WHEN claim_id % 4 = 0 THEN 'y' ELSE signed_by END AS signed_by FROM risk_v WHERE claim_id % 6 <> 0) SELECT * FROM (SELECT coalesce(a.claim_id, b.claim_id) AS claim_id, CASE WHEN b.claim_id IS NULL THEN 'no record' WHEN a.claim_id IS NULL THEN 'no row' WHEN a.kind <> b.kind THEN 'kind differs' WHEN a.signed_by <> b.signed_by THEN 'signed_by differs' END AS problem FROM a_v a FULL JOIN b_v b ON a.claim_id = b.claim_id) WHERE problem IS NOT NULL")
def reconciled_records(spark: SparkSession, d: str) -> DataFrame:
    r = V.risk(spark, d)
    files = r.filter("claim_id % 6 != 0").withColumns({"kind": F.when(F.col("claim_id") % 9 == 0, "x").otherwise(F.col("kind")), "signed_by": F.when(F.col("claim_id") % 4 == 0, "y").otherwise(F.col("signed_by"))})
    return diff.reconcile(r.filter("claim_id % 5 != 0"), files, "claim_id", ["kind", "signed_by"])


@query("WITH a_v AS (SELECT task_id, kind, max(k) AS v FROM event_v WHERE id < 5000 GROUP BY 1, 2), b_v AS (SELECT task_id, kind, max(k) AS v FROM event_v WHERE id >= 5000 GROUP BY 1, 2) SELECT task_id, kind, a.v AS before, b.v AS after FROM a_v a JOIN b_v b USING (task_id, kind) WHERE b.v > a.v")
def arity_grew(spark: SparkSession, d: str) -> DataFrame:
    side = lambda c: V.event(spark, d).filter(c).groupBy("task_id", "kind").agg(F.max("k").alias("v"))
    return diff.grew(side("id < 5000"), side("id >= 5000"), ["task_id", "kind"], "v")


@query("WITH a_v AS (SELECT k AS path, count(*) AS tests FROM event_v WHERE id < 5000 GROUP BY 1), b_v AS (SELECT k AS path, count(*) AS tests FROM event_v WHERE id >= 5000 AND k % 9 <> 2 GROUP BY 1) SELECT a.path, a.tests AS before, coalesce(b.tests, 0) AS after, b.path IS NULL AS deleted FROM a_v a LEFT JOIN b_v b ON a.path = b.path WHERE coalesce(b.tests, 0) < a.tests")
def tests_weakened(spark: SparkSession, d: str) -> DataFrame:
    side = lambda c: V.event(spark, d).filter(c).groupBy(F.col("k").alias("path")).agg(F.count("*").alias("tests"))
    return diff.weakened(side("id < 5000"), side("id >= 5000 AND k % 9 != 2")).select("path", "before", "after", "deleted")


@query("WITH n_v AS (SELECT task_id, id, k, kind, created_at, lead(id) OVER w AS next_id, lead(k) OVER w AS next_k, lead(created_at) OVER w AS next_at FROM event_v WHERE kind IN ('view', 'click') WINDOW w AS (PARTITION BY task_id ORDER BY created_at, id)) SELECT n.task_id, n.id, n.next_id FROM n_v n WHERE next_id IS NOT NULL AND n.k <> n.next_k AND NOT EXISTS (SELECT 1 FROM event_v w WHERE w.kind = 'purchase' AND w.task_id = n.task_id AND w.created_at > n.created_at AND w.created_at < n.next_at)")
def stamp_conflicts(spark: SparkSession, d: str) -> DataFrame:
    e = V.event(spark, d)
    rows = e.filter("kind IN ('view', 'click')").select("task_id", "id", "k", "created_at", F.col("created_at").alias("started_at"))
    return joins.conflicts(rows, e.filter("kind = 'purchase'"), "task_id", "k", "started_at", "created_at").select("task_id", "id", "next_id")


@query("WITH v_v AS (SELECT DISTINCT task_id, k FROM event_v WHERE kind = 'view'), c_v AS (SELECT DISTINCT task_id, k FROM event_v WHERE kind = 'click'), t_v AS (SELECT DISTINCT task_id FROM event_v) SELECT t.task_id, (SELECT count(*) FROM v_v v WHERE v.task_id = t.task_id) AS expected, (SELECT count(*) FROM c_v c WHERE c.task_id = t.task_id) AS results, (SELECT count(*) FROM v_v v WHERE v.task_id = t.task_id AND NOT EXISTS (SELECT 1 FROM c_v c WHERE c.task_id = v.task_id AND c.k = v.k)) AS missing FROM t_v t")
def missing_results(spark: SparkSession, d: str) -> DataFrame:
    of = lambda kind: F.collect_set(F.when(F.col("kind") == kind, F.col("k")))
    sets = V.event(spark, d).groupBy("task_id").agg(of("view").alias("e"), of("click").alias("r"))
    return sets.select("task_id", F.size("e").cast("long").alias("expected"), F.size("r").cast("long").alias("results"), F.size(F.array_except("e", "r")).cast("long").alias("missing"))
