"""Grouped reports over the whole ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sealmark import views as V
from sealmark.functions.when import gap_seconds
from sealmark.operators import aggregates as A
from sealmark.operators.chain import tree_digests as digests
from sealmark.operators.latest import newest_first
from sealmark.plans.registry import query
from sealmark.streaming.state import since


@query("SELECT task_id, kind, count(*) AS n FROM event_v GROUP BY 1, 2")
def events_by_task(spark: SparkSession, d: str) -> DataFrame:
    return V.event(spark, d).groupBy("task_id", "kind").agg(F.count("*").alias("n"))


@query("SELECT kind, count(*) FILTER (k = 0) AS without, count(*) FILTER (k <> 0) AS with_k FROM event_v GROUP BY 1")
def conditional_counts(spark: SparkSession, d: str) -> DataFrame:
    return V.event(spark, d).groupBy("kind").agg(F.count_if(F.col("k") == 0).alias("without"), F.count_if(F.col("k") != 0).alias("with_k"))


@query("SELECT task_id, CASE WHEN k < 10 THEN '(pre-basis)' ELSE 'b' || (k // 25) END AS basis, count(*) AS marks, count(*) FILTER (value < 5) AS refused FROM event_v GROUP BY 1, 2")
def marks_by_basis(spark: SparkSession, d: str) -> DataFrame:
    basis = F.coalesce(F.when(F.col("k") >= 10, F.concat(F.lit("b"), F.floor(F.col("k") / 25).cast("string"))), F.lit("(pre-basis)"))
    return V.event(spark, d).groupBy("task_id", basis.alias("basis")).agg(F.count("*").alias("marks"), F.count_if(F.col("value") < 5).alias("refused"))


@query("SELECT c.kind, count(*) AS n, list_sort(list(a.duration_ms))[count(*) // 2 + 1] AS median, max(a.duration_ms) AS max FROM attempt_v a JOIN claim_v c ON c.id = a.claim_id GROUP BY 1")
def cost_by_kind(spark: SparkSession, d: str) -> DataFrame:
    a, c = V.attempt(spark, d), V.claim(spark, d)
    return A.upper_medians(a.join(c.select("id", "kind").withColumnRenamed("id", "claim_id"), "claim_id"), "kind", "duration_ms")


@query("WITH seed_v AS (SELECT * FROM (VALUES ('human'), ('agent'), ('policy'), ('')) s(signed_by)) SELECT s.signed_by, count(r.claim_id) AS n, count(*) FILTER (r.was_tty = 1) AS at_terminal FROM seed_v s LEFT JOIN risk_v r ON r.signed_by = s.signed_by GROUP BY 1")
def signatures_by_signer(spark: SparkSession, d: str) -> DataFrame:
    seeds = spark.range(1).select(F.explode(F.array(*map(F.lit, ("human", "agent", "policy")))).alias("signed_by"))
    return A.seeded_counts(V.risk(spark, d), seeds, "signed_by", n=F.lit(True), at_terminal=F.col("was_tty") == 1)


@query("SELECT kind, signed_by, count(*) AS n FROM risk_v GROUP BY GROUPING SETS ((kind, signed_by), (kind), (signed_by))")
def signatures_grouped(spark: SparkSession, d: str) -> DataFrame:
    return V.risk(spark, d).groupingSets([["kind", "signed_by"], ["kind"], ["signed_by"]], "kind", "signed_by").agg(F.count("*").alias("n"))


@query("WITH at_v AS (SELECT task_id, min(created_at) FILTER (kind = 'purchase' AND k > 60) AS first_at, bool_or(kind = 'signup') AS watched FROM event_v GROUP BY 1) SELECT t.id AS task_id, a.watched, epoch_us(a.first_at) - epoch_us(t.created_at) AS gap_us, (SELECT count(*) FROM event_v e WHERE e.task_id = t.id AND e.kind = 'click' AND (a.first_at IS NULL OR e.created_at < a.first_at)) AS before_first FROM task_v t LEFT JOIN at_v a ON a.task_id = t.id")
def lag_to_first(spark: SparkSession, d: str) -> DataFrame:
    e = V.event(spark, d)
    out = A.lag_to_first(V.task(spark, d), e, (F.col("kind") == "purchase") & (F.col("k") > 60), F.col("kind") == "click", F.col("kind") == "signup")
    return out.select("task_id", "watched", F.round(gap_seconds(F.col("created_at"), F.col("first_at")) * 1e6).cast("long").alias("gap_us"), "before_first")


@query("WITH f_v AS (SELECT task_id, min(created_at) AS first_at FROM event_v WHERE kind = 'purchase' AND k > 90 GROUP BY 1) SELECT e.task_id, CASE WHEN max(f.first_at) IS NOT NULL THEN count(*) FILTER (e.created_at < f.first_at) END AS before, CASE WHEN max(f.first_at) IS NOT NULL THEN count(*) FILTER (e.created_at >= f.first_at) END AS after, list_aggregate(list_sort(list(DISTINCT e.kind)), 'string_agg', ',') AS kinds FROM event_v e LEFT JOIN f_v f ON f.task_id = e.task_id GROUP BY 1")
def around_first(spark: SparkSession, d: str) -> DataFrame:
    e = V.event(spark, d)
    return A.around_first(e, e, (F.col("kind") == "purchase") & (F.col("k") > 90))


@query("SELECT kind AS source, count(*) AS n, CAST(sum(CASE WHEN k >= 50 THEN k ELSE 0 END) AS BIGINT) AS tokens, CAST(sum(CASE WHEN k < 90 THEN k * 10 ELSE 0 END) AS BIGINT) AS wall_ms FROM event_v GROUP BY 1")
def cost_by_source(spark: SparkSession, d: str) -> DataFrame:
    e = V.event(spark, d)
    return A.cost_by_source(e.select(F.col("kind").alias("source"), F.when(F.col("k") >= 50, F.col("k")).alias("tokens"), F.when(F.col("k") < 90, F.col("k") * 10).alias("wall_ms")))


@query("SELECT origin, count(*) AS n FROM claim_v GROUP BY 1")
def claims_by_origin(spark: SparkSession, d: str) -> DataFrame:
    return V.claim(spark, d).groupBy("origin").agg(F.count("*").alias("n")).orderBy("origin")


@query("SELECT subject_digest % 100 AS path, worktree AS variant, min(day) AS line, list_aggregate(list_sort(list(DISTINCT day)), 'string_agg', ',') AS lines FROM attempt_v WHERE exit_code = 1 GROUP BY 1, 2")
def findings_collapsed(spark: SparkSession, d: str) -> DataFrame:
    f = V.attempt(spark, d).filter("exit_code = 1").select((F.col("subject_digest") % 100).alias("path"), F.col("worktree").alias("variant"), F.col("day").alias("line"))
    return A.collapse(f, ["path", "variant"]).withColumn("lines", F.array_join(F.transform("lines", lambda x: x.cast("string")), ","))


@query("SELECT split_part(path, '/', 1) AS area, CAST(sum(size) AS BIGINT) AS statements, sum(size) > 8000 AS over FROM path_v GROUP BY 1")
def statements_by_area(spark: SparkSession, d: str) -> DataFrame:
    return V.path(spark, d).groupBy(F.element_at(F.split("path", "/"), 1).alias("area")).agg(F.sum("size").alias("statements"), (F.sum("size") > 8000).alias("over"))


@query("SELECT split_part(path, '/', 1) AS area, sha256(string_agg(path || chr(31) || sha || chr(30), '' ORDER BY path, sha)) AS digest, count(*) AS n FROM path_v GROUP BY 1")
def tree_digests(spark: SparkSession, d: str) -> DataFrame:
    return digests(V.path(spark, d).withColumn("area", F.element_at(F.split("path", "/"), 1)), "area")


@query("SELECT claim_id, count(DISTINCT worktree) AS stamps, count(DISTINCT worktree) > 1 AS moved FROM attempt_v GROUP BY 1")
def stamps_per_claim(spark: SparkSession, d: str) -> DataFrame:
    return V.attempt(spark, d).groupBy("claim_id").agg(F.count_distinct("worktree").alias("stamps")).withColumn("moved", F.col("stamps") > 1)


@query("SELECT detector, id, k AS claims, value > 20 AS could_read FROM (SELECT *, k % 10 AS detector, row_number() OVER (PARTITION BY k % 10, kind ORDER BY id DESC) AS rn FROM event_v) WHERE rn = 1 AND kind = 'view'")
def last_run_per_detector(spark: SparkSession, d: str) -> DataFrame:
    runs = V.event(spark, d).filter("kind = 'view'")
    return A.last_per(runs, F.col("k") % 10, "detector").select("detector", "id", F.col("k").alias("claims"), (F.col("value") > 20).alias("could_read"))


@query("SELECT id, count(*) OVER (PARTITION BY task_id, kind) AS open_same_kind FROM claim_v WHERE origin = 'O'")
def open_of_same_kind(spark: SparkSession, d: str) -> DataFrame:
    return V.claim(spark, d).filter("origin = 'O'").select("id", F.count("*").over(Window.partitionBy("task_id", "kind")).alias("open_same_kind"))


@query("SELECT kind, count(*) AS n FROM event_v WHERE created_at > (SELECT max(created_at) FROM event_v WHERE kind = 'error' AND k = 77) GROUP BY 1")
def events_since_last(spark: SparkSession, d: str) -> DataFrame:
    e = V.event(spark, d)
    return since(e, e.filter("kind = 'error' AND k = 77")).groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT id, epoch_us(created_at) AS created_us FROM task_v WHERE created_at > TIMESTAMP '2024-01-01 06:00:00' AND id <> 3")
def tasks_since(spark: SparkSession, d: str) -> DataFrame:
    t = V.task(spark, d).filter((F.col("created_at") > F.lit("2024-01-01 06:00:00").cast("timestamp_ntz")) & (F.col("id") != 3))
    return t.select("id", V.micros("created_at").alias("created_us")).orderBy("created_us")


@query("SELECT kind, task_id, count(*) AS signed FROM claim_v WHERE id IN (SELECT claim_id FROM risk_v) GROUP BY 1, 2 ORDER BY signed DESC, kind, task_id LIMIT 5")
def most_signed(spark: SparkSession, d: str) -> DataFrame:
    signed = V.claim(spark, d).join(V.risk(spark, d).select(F.col("claim_id").alias("id")), "id", "left_semi")
    return signed.groupBy("kind", "task_id").agg(F.count("*").alias("signed")).orderBy(F.desc("signed"), "kind", "task_id").limit(5)


@query("SELECT id, task_id, k FROM event_v WHERE kind = 'error' ORDER BY id DESC LIMIT 20")
def newest_errors(spark: SparkSession, d: str) -> DataFrame:
    return newest_first(V.event(spark, d).filter("kind = 'error'").select("id", "task_id", "k"), 20)


@query("SELECT task_id, max(at_us) AS last_us FROM (SELECT task_id, epoch_us(created_at) AS at_us FROM event_v UNION ALL SELECT c.task_id, epoch_us(a.ended_at) AS at_us FROM attempt_v a JOIN claim_v c ON c.id = a.claim_id) GROUP BY 1")
def last_activity(spark: SparkSession, d: str) -> DataFrame:
    a, c = V.attempt(spark, d), V.claim(spark, d).select(F.col("id").alias("claim_id"), "task_id")
    both = V.event(spark, d).select("task_id", V.micros("created_at").alias("at_us")).unionByName(a.join(c, "claim_id").select("task_id", V.micros("ended_at").alias("at_us")))
    return both.groupBy("task_id").agg(F.max("at_us").alias("last_us"))


@query("SELECT task_id, list_aggregate(list_sort(list(DISTINCT kind)), 'string_agg', ',') AS observed, count(*) FILTER (value < 1) AS legacy, arg_max(kind, id) AS last FROM event_v GROUP BY 1")
def host_evidence(spark: SparkSession, d: str) -> DataFrame:
    e = V.event(spark, d)
    return e.groupBy("task_id").agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("observed"), F.count_if(F.col("value") < 1).alias("legacy"), F.max_by("kind", "id").alias("last"))


@query("SELECT e.id, e.kind, c.kind AS claim_kind FROM event_v e LEFT JOIN claim_v c ON c.id = e.id * 2 WHERE e.kind = 'view'")
def events_with_claims(spark: SparkSession, d: str) -> DataFrame:
    e, c = V.event(spark, d).filter("kind = 'view'"), V.claim(spark, d).select(F.col("id").alias("cid"), F.col("kind").alias("claim_kind"))
    return e.join(c, F.col("cid") == F.col("id") * 2, "left").select("id", "kind", "claim_kind")


@query("SELECT a.worktree AS head, c.kind, CAST(sum(a.duration_ms) AS BIGINT) AS wasted_ms FROM attempt_v a JOIN claim_v c ON c.id = a.claim_id WHERE a.subject_digest <> a.checker_sha * 7 GROUP BY 1, 2")
def void_time(spark: SparkSession, d: str) -> DataFrame:
    a, c = V.attempt(spark, d), V.claim(spark, d).select(F.col("id").alias("claim_id"), "kind")
    return a.filter("subject_digest != checker_sha * 7").join(c, "claim_id").groupBy(F.col("worktree").alias("head"), "kind").agg(F.sum("duration_ms").alias("wasted_ms"))
