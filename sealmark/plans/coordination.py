"""Assignments, dependencies, receipts and refusals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sealmark import views as V
from sealmark.operators import holds as H
from sealmark.plans.registry import query


@query("SELECT id, hold FROM (SELECT id, unnest([CASE WHEN k > 80 THEN 'pending input' END, CASE WHEN kind = 'error' THEN 'obsolete' END, CASE WHEN value > 60 THEN 'stop' END, CASE WHEN k % 7 = 0 AND kind = 'view' THEN 'result conflict' END]) AS hold FROM event_v) WHERE hold IS NOT NULL")
def assignment_holds(spark: SparkSession, d: str) -> DataFrame:
    return H.holds(V.event(spark, d), "id", [("pending input", F.col("k") > 80), ("obsolete", F.col("kind") == "error"), ("stop", F.col("value") > 60), ("result conflict", (F.col("k") % 7 == 0) & (F.col("kind") == "view"))])


@query("SELECT c.id, CASE WHEN origin = 'P' THEN 'policy' WHEN kind = '5-LOW' THEN 'kind' WHEN length(kind) < 6 THEN 'reason length' WHEN a.exit_code IS NULL THEN 'unknown claim' WHEN a.exit_code <> 4 THEN 'exit' END AS refusal FROM claim_v c LEFT JOIN (SELECT claim_id, arg_max(exit_code, id) AS exit_code FROM attempt_v GROUP BY 1) a ON a.claim_id = c.id")
def signature_refusals(spark: SparkSession, d: str) -> DataFrame:
    last = V.attempt(spark, d).groupBy(F.col("claim_id").alias("id")).agg(F.max_by("exit_code", "id").alias("exit_code"))
    rows = V.claim(spark, d).join(last, "id", "left")
    code = F.col("exit_code")
    rules = [("policy", F.col("origin") == "P"), ("kind", F.col("kind") == "5-LOW"), ("reason length", F.length("kind") < 6), ("unknown claim", code.isNull()), ("exit", code != 4)]
    return rows.select("id", H.first_refusal(rules).alias("refusal"))


@query("WITH w_v AS (SELECT id, id % 7 AS revision, origin = 'F' AS settled FROM claim_v), n_v AS (SELECT id, id + 5 AS needs, (id + 5) % 7 + CASE WHEN id % 10 = 0 THEN 1 ELSE 0 END AS revision FROM claim_v) SELECT * FROM (SELECT n.id, n.needs, CASE WHEN w.id IS NULL OR w.revision <> n.revision THEN 'stale' WHEN NOT w.settled THEN 'unsettled' END AS hold FROM n_v n LEFT JOIN w_v w ON w.id = n.needs) WHERE hold IS NOT NULL")
def dependency_holds(spark: SparkSession, d: str) -> DataFrame:
    c = V.claim(spark, d)
    works = c.select("id", (F.col("id") % 7).alias("revision"), (F.col("origin") == "F").alias("settled"))
    needs = c.select("id", (F.col("id") + 5).alias("needs"), ((F.col("id") + 5) % 7 + F.when(F.col("id") % 10 == 0, 1).otherwise(0)).alias("revision"))
    return H.dependency_holds(works, needs)


@query("SELECT k * 1000 + id % 1000 AS task, arg_max(task_id, id) AS owner, count(DISTINCT task_id) > 1 AS conflict FROM event_v WHERE kind = 'signup' GROUP BY 1")
def task_owners(spark: SparkSession, d: str) -> DataFrame:
    own = V.event(spark, d).filter("kind = 'signup'").select((F.col("k") * 1000 + F.col("id") % 1000).alias("task"), F.col("task_id").alias("owner"), "id")
    return H.newest_assignment(own, "task", "owner", "id")


_REC = "SELECT id, CASE k % 3 WHEN 0 THEN 'prepared' WHEN 1 THEN 'dispatching' ELSE 'running' END AS state, CASE WHEN kind = 'error' THEN 'failed' WHEN kind = 'view' THEN 'running' ELSE 'done' END AS outcome, k % 5 AS worker, task_id % 5 AS assigned FROM event_v"


@query(f"WITH r_v AS ({_REC}) SELECT id, worker = assigned AND ((state = 'dispatching' AND outcome IN ('running', 'failed')) OR (state = 'running' AND outcome IN ('done', 'failed'))) AS applied, CASE WHEN worker <> assigned THEN 'conflict' WHEN (state = 'dispatching' AND outcome IN ('running', 'failed')) OR (state = 'running' AND outcome IN ('done', 'failed')) THEN outcome ELSE 'historical_after_' || state END AS kept_as FROM r_v")
def receipts(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("k") % 3
    rows = V.event(spark, d).select(
        "id", F.when(m == 0, "prepared").when(m == 1, "dispatching").otherwise("running").alias("state"),
        F.when(F.col("kind") == "error", "failed").when(F.col("kind") == "view", "running").otherwise("done").alias("outcome"), (F.col("k") % 5).alias("worker"), (F.col("task_id") % 5).alias("assigned"),
    )
    return H.receipts(rows, {"dispatching": ["running", "failed"], "running": ["done", "failed"]}).select("id", "applied", "kept_as")


@query("SELECT task_id, max(k // 25) AS status, count(DISTINCT kind) > 1 AS conflict, arg_min(kind, id) AS first FROM event_v GROUP BY 1")
def settlements(spark: SparkSession, d: str) -> DataFrame:
    rows = V.event(spark, d).select("task_id", "id", F.floor(F.col("k") / 25).alias("rank"), F.col("kind").alias("result"))
    return H.settle(rows, "task_id", "id")


@query("WITH l_v AS (SELECT DISTINCT task_id, k FROM event_v WHERE kind = 'view'), d_v AS (SELECT task_id, k, count(*) AS n FROM event_v WHERE kind = 'click' GROUP BY 1, 2) SELECT * FROM (SELECT l.task_id, l.k, CASE WHEN d.n IS NULL THEN 'missing' WHEN d.n > 1 THEN 'twice' END AS problem FROM l_v l LEFT JOIN d_v d ON d.task_id = l.task_id AND d.k = l.k) WHERE problem IS NOT NULL")
def undisposed_works(spark: SparkSession, d: str) -> DataFrame:
    e = V.event(spark, d)
    return H.undisposed(e.filter("kind = 'view'"), e.filter("kind = 'click'"), ["task_id", "k"])


@query("SELECT task_id, count(*) AS rounds, count(*) >= 12 AS blocked FROM event_v WHERE kind = 'signup' GROUP BY 1")
def merge_rounds(spark: SparkSession, d: str) -> DataFrame:
    return V.event(spark, d).filter("kind = 'signup'").groupBy("task_id").agg(F.count("*").alias("rounds")).withColumn("blocked", F.col("rounds") >= 12)


@query("SELECT task_id, id, n FROM (SELECT task_id, id, count(*) FILTER (kind = 'error') OVER (PARTITION BY task_id ORDER BY id) AS n, kind FROM event_v) WHERE kind = 'purchase' AND n > 0")
def after_a_stop(spark: SparkSession, d: str) -> DataFrame:
    """Work that was recorded after a stop request of its task: the request is never cleared."""
    w = Window.partitionBy("task_id").orderBy("id")
    return V.event(spark, d).withColumn("n", F.count_if(F.col("kind") == "error").over(w)).filter("kind = 'purchase' AND n > 0").select("task_id", "id", "n")
