"""What state each claim is in and what follows from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sealmark import views as V
from sealmark.functions.when import exit_name, gate
from sealmark.operators import joins, state
from sealmark.operators.aggregates import distinct_states, histogram
from sealmark.operators.latest import latest
from sealmark.plans.registry import query

_RETRACTED = "SELECT o_orderkey AS claim_id FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '5-LOW'"
_LAST = "last_v AS (SELECT claim_id, arg_max(exit_code, id) AS exit_code, arg_max(subject_digest, id) AS digest, arg_min(subject_digest, id) AS now_digest FROM attempt_v GROUP BY 1)"
_STATE = f"""WITH {_LAST}, ret_v AS ({_RETRACTED}), sig_v AS (SELECT DISTINCT r.claim_id FROM risk_v r JOIN last_v l ON l.claim_id = r.claim_id WHERE signed_by <> '' AND l.digest = l.now_digest), rep_v AS (SELECT DISTINCT claim_id FROM risk_v WHERE signed_by = ''),
 state_v AS (SELECT c.id, c.task_id, c.kind, c.origin, c.created_at, l.exit_code,
 CASE WHEN r.claim_id IS NOT NULL THEN 'RETRACTED' WHEN s.claim_id IS NOT NULL THEN 'RISK_ACCEPTED' WHEN l.exit_code IS NULL OR l.exit_code = 1 THEN 'OPEN'
 WHEN l.exit_code = 4 AND p.claim_id IS NOT NULL THEN 'RISK_ACCEPTED' WHEN l.exit_code = 4 THEN 'UNSUPPORTED' WHEN l.digest <> l.now_digest THEN 'STALE' ELSE 'ANSWERED' END AS state
 FROM claim_v c LEFT JOIN last_v l ON l.claim_id = c.id LEFT JOIN ret_v r ON r.claim_id = c.id LEFT JOIN sig_v s ON s.claim_id = c.id LEFT JOIN rep_v p ON p.claim_id = c.id) """


def retracted(spark: SparkSession, d: str) -> DataFrame:
    return V.read(spark, d, "orders").filter("o_orderstatus = 'P' AND o_orderpriority = '5-LOW'").select(F.col("o_orderkey").alias("claim_id"))


def with_state(spark: SparkSession, d: str) -> DataFrame:
    """Claims with their state. A subject counts as moved if its newest digest is not its first one.

    Each signature was given for the subject of the newest attempt, after an older one for what is current.
    """
    a, r = V.attempt(spark, d), V.risk(spark, d)
    now = a.groupBy("claim_id").agg(F.min_by("subject_digest", "id").alias("digest"))
    given = r.filter("signed_by != ''").join(a.groupBy("claim_id").agg(F.min_by("subject_digest", "id").alias("old"), F.max_by("subject_digest", "id").alias("new")), "claim_id")
    signed = given.select("claim_id", F.explode(F.array(F.struct(F.lit(1).alias("id"), F.col("old").alias("key")), F.struct(F.lit(2).alias("id"), F.col("new").alias("key")))).alias("s")).select("claim_id", "s.id", "s.key")
    return state.states(V.claim(spark, d), a, signed, retracted(spark, d), now, r.filter("signed_by = ''"))


def state_summary(spark: SparkSession, d: str) -> DataFrame:
    return claim_state_summary(spark, d)


@query(_STATE + "SELECT kind, state, count(*) AS n FROM state_v GROUP BY 1, 2")
def claim_state_summary(spark: SparkSession, d: str) -> DataFrame:
    return with_state(spark, d).groupBy("kind", "state").agg(F.count("*").alias("n"))


@query(_STATE + "SELECT id, kind, state FROM state_v")
def claim_states(spark: SparkSession, d: str) -> DataFrame:
    return with_state(spark, d).select("id", "kind", "state")


@query(_STATE + "SELECT id, task_id, state, CASE state WHEN 'OPEN' THEN 'fix' WHEN 'STALE' THEN 'check' WHEN 'UNSUPPORTED' THEN 'sign' ELSE 'rerun' END AS action FROM state_v WHERE state NOT IN ('ANSWERED', 'RISK_ACCEPTED', 'RETRACTED')")
def claims_waiting(spark: SparkSession, d: str) -> DataFrame:
    return state.waiting(with_state(spark, d)).select("id", "task_id", "state", "action")


@query(_STATE + "SELECT task_id, count(*) FILTER (state NOT IN ('ANSWERED', 'RISK_ACCEPTED', 'RETRACTED')) AS blocked, count(*) FILTER (state NOT IN ('ANSWERED', 'RISK_ACCEPTED', 'RETRACTED')) = 0 AS ok FROM state_v GROUP BY 1")
def tasks_that_may_ship(spark: SparkSession, d: str) -> DataFrame:
    return state.may_ship(with_state(spark, d))


@query(_STATE + "SELECT task_id, kind, count(*) FILTER (state = 'ANSWERED') AS green, count(*) FILTER (state = 'RISK_ACCEPTED') AS signed, count(*) FILTER (state = 'OPEN') AS open, count(*) FILTER (state = 'RETRACTED') AS retracted, count(*) FILTER (state IN ('STALE', 'UNSUPPORTED')) AS lapsed FROM state_v GROUP BY 1, 2")
def outcome_histogram(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("state")
    label = F.when(s == "ANSWERED", "green").when(s == "RISK_ACCEPTED", "signed").when(s == "OPEN", "open").when(s == "RETRACTED", "retracted").otherwise("lapsed")
    return histogram(with_state(spark, d), ["task_id", "kind"], label, ["green", "signed", "open", "retracted", "lapsed"])


@query("WITH " + _LAST + f", ret_v AS ({_RETRACTED}) SELECT c.id, c.kind FROM claim_v c JOIN last_v l ON l.claim_id = c.id WHERE l.exit_code = 1 AND c.id NOT IN (SELECT claim_id FROM risk_v) AND c.id NOT IN (SELECT claim_id FROM ret_v)")
def unsettled_failures(spark: SparkSession, d: str) -> DataFrame:
    return joins.unsettled_failures(V.claim(spark, d), V.attempt(spark, d), V.risk(spark, d), retracted(spark, d)).select("id", "kind")


@query("WITH " + _LAST + " SELECT c.kind, count(*) AS n, count(DISTINCT c.task_id) AS tasks FROM claim_v c JOIN last_v l ON l.claim_id = c.id WHERE l.exit_code = 4 AND c.id NOT IN (SELECT claim_id FROM risk_v) GROUP BY 1")
def unsupported_unsigned(spark: SparkSession, d: str) -> DataFrame:
    left = joins.newest_with_exit(V.claim(spark, d), V.attempt(spark, d), 4).join(V.risk(spark, d).select(F.col("claim_id").alias("id")), "id", "left_anti")
    return left.groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("task_id").alias("tasks"))


@query("WITH " + _LAST + ", ended_v AS (SELECT DISTINCT task_id FROM event_v WHERE kind = 'purchase' AND k >= 95) SELECT c.kind, count(*) AS n FROM claim_v c JOIN last_v l ON l.claim_id = c.id WHERE l.exit_code = 1 AND c.task_id NOT IN (SELECT task_id FROM ended_v) GROUP BY 1")
def failing_kinds_of_open_tasks(spark: SparkSession, d: str) -> DataFrame:
    ended = joins.ended_tasks(V.event(spark, d).filter("k >= 95"), ["purchase"])
    return joins.newest_with_exit(V.claim(spark, d), V.attempt(spark, d), 1).join(ended, "task_id", "left_anti").groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT task_id AS checker, count(*) AS n FROM claim_v c WHERE NOT EXISTS (SELECT 1 FROM attempt_v a WHERE a.claim_id = c.id) AND NOT EXISTS (SELECT 1 FROM claim_v o JOIN attempt_v b ON b.claim_id = o.id WHERE o.task_id % 500 = c.task_id % 500 AND o.task_id <> c.task_id AND o.kind = '1-URGENT' AND b.exit_code = 0 AND o.origin = 'F') GROUP BY 1")
def never_tried(spark: SparkSession, d: str) -> DataFrame:
    c, a = V.claim(spark, d), V.attempt(spark, d)
    tried = c.filter("kind = '1-URGENT' AND origin = 'F'").join(a.filter("exit_code = 0"), c["id"] == a["claim_id"], "left_semi")
    # Of each group whether several tasks were tried, or which one: another task than the own one is one of several, or that one.
    of = tried.groupBy((F.col("task_id") % 500).alias("_m")).agg(F.min("task_id").alias("_a"), F.max("task_id").alias("_b"))
    free = c.join(a.select(F.col("claim_id").alias("id")), "id", "left_anti").withColumn("_m", F.col("task_id") % 500).join(of, "_m", "left")
    other = F.coalesce((F.col("_a") != F.col("task_id")) | (F.col("_b") != F.col("task_id")), F.lit(False))
    return free.filter(~other).groupBy(F.col("task_id").alias("checker")).agg(F.count("*").alias("n"))


@query("WITH c_v AS (SELECT id, task_id % 700 AS checker FROM claim_v), t_v AS (SELECT DISTINCT claim_id AS id FROM attempt_v WHERE exit_code = 0 AND day % 3 = 0) SELECT checker, count(*) AS n FROM c_v WHERE id NOT IN (SELECT id FROM t_v) AND checker NOT IN (SELECT c.checker FROM c_v c JOIN t_v t ON t.id = c.id) GROUP BY 1")
def checkers_never_tried(spark: SparkSession, d: str) -> DataFrame:
    """Claims without an attempt, by checkers that were never tried on any claim."""
    claims = V.claim(spark, d).select("id", (F.col("task_id") % 700).alias("checker"))
    return joins.never_tried(claims, V.attempt(spark, d).filter("exit_code = 0 AND day % 3 = 0"), "checker")


@query(f"WITH ret_v AS ({_RETRACTED}) SELECT kind, count(*) AS n FROM claim_v c WHERE EXISTS (SELECT 1 FROM attempt_v a WHERE a.claim_id = c.id AND a.exit_code = 0) OR EXISTS (SELECT 1 FROM risk_v r WHERE r.claim_id = c.id) OR EXISTS (SELECT 1 FROM ret_v t WHERE t.claim_id = c.id) GROUP BY 1")
def settled_claims(spark: SparkSession, d: str) -> DataFrame:
    passed = V.attempt(spark, d).filter("exit_code = 0")
    return joins.settled(V.claim(spark, d), passed, V.risk(spark, d), retracted(spark, d)).groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT t.id FROM task_v t WHERE t.id NOT IN (SELECT task_id FROM event_v WHERE kind = 'purchase' AND k >= 95 AND task_id IS NOT NULL) AND t.id <> 7")
def open_tasks(spark: SparkSession, d: str) -> DataFrame:
    return joins.open_tasks(V.task(spark, d), joins.ended_tasks(V.event(spark, d).filter("k >= 95"), ["purchase"]), [7]).select("id")


@query("SELECT claim_id, count(*) AS fails, count(DISTINCT (subject_digest, checker_sha, worktree)) AS states FROM attempt_v WHERE exit_code NOT IN (0, 4) GROUP BY 1")
def failing_states(spark: SparkSession, d: str) -> DataFrame:
    return distinct_states(V.attempt(spark, d), [0, 4])


_AGE = "date_diff('day', created_at, TIMESTAMP '2000-01-01 00:00:00')"


@query(_STATE + f""", open_v AS (SELECT *, count(*) OVER (PARTITION BY task_id, kind) AS same, {_AGE} AS age FROM state_v WHERE state = 'OPEN'),
 fail_v AS (SELECT claim_id, count(DISTINCT (subject_digest, checker_sha, worktree)) AS states FROM attempt_v WHERE exit_code NOT IN (0, 4) GROUP BY 1),
 why_v AS (SELECT o.id, o.kind, CASE WHEN same > 2 THEN 'open' WHEN age > 900 THEN 'age' WHEN coalesce(f.states, 0) > 3 THEN 'repeat' END AS escalation FROM open_v o LEFT JOIN fail_v f ON f.claim_id = o.id)
 SELECT id, escalation, 'block' AS side FROM why_v WHERE kind IN ('1-URGENT', '2-HIGH') OR escalation IS NOT NULL UNION ALL SELECT id, escalation, 'report' AS side FROM why_v WHERE kind NOT IN ('1-URGENT', '2-HIGH')""")
def blocks_and_reports(spark: SparkSession, d: str) -> DataFrame:
    """Urgent and high claims gate the ship; the others only report, unless they escalate."""
    open_ = with_state(spark, d).filter("state = 'OPEN'").withColumn("same", F.count("*").over(Window.partitionBy("task_id", "kind")))
    fails = distinct_states(V.attempt(spark, d), [0, 4]).select(F.col("claim_id").alias("id"), "states")
    open_ = open_.join(fails, "id", "left")
    age = F.datediff(F.lit("2000-01-01").cast("date"), "created_at")
    why = state.escalates(F.col("same"), age, F.coalesce("states", F.lit(0)), F.lit(2), F.lit(900), F.lit(3))
    own = gate(F.when(~F.col("kind").isin("1-URGENT", "2-HIGH"), "report"))
    return state.blocks_and_reports(open_, own, why).select("id", "escalation", "side")


@query("SELECT exit_code, CASE exit_code WHEN 0 THEN '0 PASS' WHEN 1 THEN '1 FAIL' WHEN 4 THEN '4 UNSUPPORTED' END AS name, count(*) AS n FROM attempt_v GROUP BY 1")
def exits_by_name(spark: SparkSession, d: str) -> DataFrame:
    return V.attempt(spark, d).groupBy("exit_code").agg(F.count("*").alias("n")).withColumn("name", exit_name(F.col("exit_code")))


@query("SELECT claim_id, arg_max(id, id) AS id, arg_max(exit_code, id) AS exit_code, arg_max(duration_ms, id) AS duration_ms, arg_max(worktree, id) AS worktree FROM attempt_v GROUP BY 1")
def latest_attempts(spark: SparkSession, d: str) -> DataFrame:
    return latest(V.attempt(spark, d).select("claim_id", "id", "exit_code", "duration_ms", "worktree"), "claim_id")


@query("WITH seen_v AS (SELECT id FROM claim_v WHERE id % 3 <> 0), healthy_v AS (SELECT kind FROM claim_v GROUP BY 1 HAVING kind <> '5-LOW') SELECT c.id, c.kind FROM claim_v c WHERE c.id NOT IN (SELECT id FROM seen_v) AND c.kind IN (SELECT kind FROM healthy_v)")
def orphaned_claims(spark: SparkSession, d: str) -> DataFrame:
    c = V.claim(spark, d)
    return state.orphans(c, c.filter("id % 3 != 0").select("id"), c.filter("kind != '5-LOW'").select("kind"), "kind").select("id", "kind")
