"""Review runs, notices, designs and assignments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sealmark import views as V
from sealmark.functions.when import due
from sealmark.operators import runs as R
from sealmark.operators.chain import tree_digests
from sealmark.plans.registry import query


@query("""WITH x_v AS (SELECT DISTINCT task_id, k % 2 AS lens FROM event_v WHERE kind IN ('view', 'click')),
 r_v AS (SELECT task_id, k % 2 AS lens, arg_max(value > 1, id) AS evaluated, arg_max(CASE WHEN task_id % 3 = 0 THEN 0 ELSE k END, id) AS findings FROM event_v WHERE kind IN ('click', 'signup') GROUP BY 1, 2),
 o_v AS (SELECT task_id, k % 2 AS lens, count(DISTINCT k) AS n FROM event_v WHERE kind = 'purchase' AND task_id % 3 <> 0 GROUP BY 1, 2),
 s_v AS (SELECT t.id, (SELECT count(*) FROM x_v x WHERE x.task_id = t.id AND NOT EXISTS (SELECT 1 FROM r_v r WHERE r.task_id = x.task_id AND r.lens = x.lens)) AS missing,
 (SELECT count(*) FROM x_v x JOIN r_v r ON r.task_id = x.task_id AND r.lens = x.lens LEFT JOIN o_v o ON o.task_id = x.task_id AND o.lens = x.lens WHERE x.task_id = t.id AND NOT (r.evaluated AND r.findings = coalesce(o.n, 0))) AS bad,
 EXISTS (SELECT 1 FROM r_v r WHERE r.task_id = t.id AND NOT EXISTS (SELECT 1 FROM x_v x WHERE x.task_id = r.task_id AND x.lens = r.lens)) AS extra,
 EXISTS (SELECT 1 FROM event_v e WHERE e.task_id = t.id AND e.kind = 'error' AND e.k >= 60) AS open FROM task_v t),
 d_v AS (SELECT *, CASE WHEN id % 11 = 0 THEN 'abandoned' WHEN id % 5 = 0 THEN 'stale' WHEN missing + bad = 0 AND NOT extra AND NOT open THEN 'complete' ELSE 'partial' END AS status FROM s_v)
 SELECT id AS run, status, missing, status = 'complete' AND id % 2 = 0 AS advances FROM d_v""")
def finished_runs(spark: SparkSession, d: str) -> DataFrame:
    """How review runs end."""
    e = V.event(spark, d).withColumns({"run": F.col("task_id"), "lens": F.col("k") % 2})
    run = F.col("id")
    tasks = V.task(spark, d).select(run.alias("run"), (run % 5 != 0).alias("valid"), F.when(run % 11 == 0, "stopped").alias("reason"), (run % 2 == 0).alias("cadence"))
    results = e.filter("kind IN ('click', 'signup')").withColumns({"findings": F.when(F.col("run") % 3 == 0, 0).otherwise(F.col("k")), "evaluated": F.col("value") > 1})
    observed = e.filter("kind = 'purchase' AND run % 3 != 0").withColumn("claim", F.col("k"))
    return R.finished(tasks, e.filter("kind IN ('view', 'click')"), results, observed, e.filter("kind = 'error' AND k >= 60"))


@query("SELECT id, CASE WHEN k % 5 = 0 OR task_id % 7 = 0 THEN 'not active here' WHEN k % 4 = 0 THEN 'not selected' WHEN k % 6 <> task_id % 6 THEN 'lens changed' WHEN id % 3 = 0 THEN 'source changed' END AS fault FROM event_v")
def run_faults(spark: SparkSession, d: str) -> DataFrame:
    k, t = F.col("k"), F.col("task_id")
    fault = R.run_fault(F.when(k % 5 == 0, "partial").otherwise("running"), t % 7 != 0, F.when(k % 4 != 0, k % 6), t % 6, F.col("id") % 3 != 0)
    return V.event(spark, d).select("id", fault.alias("fault"))


_NOTICE = """n_v AS (SELECT task_id AS subject, k % 10 AS revision, min(id) AS id FROM event_v WHERE kind = 'view' GROUP BY 1, 2),
 c_v AS (SELECT task_id AS subject, k % 10 AS revision, arg_max(['sent', 'acknowledged', 'resolved'][k // 34 + 1], id) AS status FROM event_v WHERE kind = 'click' GROUP BY 1, 2),
 t_v AS (SELECT n.subject, n.revision, CASE WHEN c.status = 'resolved' THEN 'resolved' WHEN EXISTS (SELECT 1 FROM n_v m WHERE m.subject = n.subject AND m.id > n.id) THEN 'superseded' ELSE coalesce(c.status, 'pending') END AS status FROM n_v n LEFT JOIN c_v c ON c.subject = n.subject AND c.revision = n.revision)"""


@query(f"WITH {_NOTICE} SELECT subject, revision, status FROM t_v")
def notice_states(spark: SparkSession, d: str) -> DataFrame:
    e = V.event(spark, d).withColumns({"subject": F.col("task_id"), "revision": F.col("k") % 10})
    status = F.element_at(F.array(*map(F.lit, ("sent", "acknowledged", "resolved"))), (F.floor(F.col("k") / 34) + 1).cast("int"))
    return R.notices(e.filter("kind = 'view'"), e.filter("kind = 'click'").withColumn("status", status))


@query(f"WITH {_NOTICE} SELECT e.id, CASE WHEN t.status IS NULL THEN 'absent' WHEN t.status IN ('superseded', 'resolved') THEN 'no longer current' ELSE 'acknowledged' END AS outcome FROM event_v e LEFT JOIN t_v t ON t.subject = e.task_id AND t.revision = e.k % 10 WHERE e.kind = 'signup'")
def acknowledgements(spark: SparkSession, d: str) -> DataFrame:
    asked = V.event(spark, d).filter("kind = 'signup'").select("id", F.col("task_id").alias("subject"), (F.col("k") % 10).alias("revision"))
    return R.acknowledgements(asked, notice_states(spark, d))


@query("""WITH s_v AS (SELECT k AS key, id, id % 7 AS e, task_id % 3 = 0 AS p FROM event_v),
 a_v(key, n, id, p) AS (SELECT key, 0, min(id), arg_min(p, id) FROM s_v WHERE e = 0 GROUP BY key UNION ALL SELECT a.key, a.n + 1, min(s.id), any_value(a.p) FROM a_v a JOIN s_v s ON s.key = a.key AND s.e = a.n + 1 AND s.id > a.id AND s.p = a.p GROUP BY a.key, a.n),
 c_v AS (SELECT s.id, s.e, s.p, (SELECT count(*) FROM a_v a WHERE a.key = s.key AND a.id < s.id) AS cur, (SELECT any_value(a.p) FROM a_v a WHERE a.key = s.key) AS path FROM s_v s)
 SELECT id, CASE WHEN e <> cur THEN 'stale revision' WHEN cur > 0 AND p <> path THEN 'other path' ELSE 'registered' END AS outcome, cur + CASE WHEN e = cur AND (cur = 0 OR p = path) THEN 1 ELSE 0 END AS revision FROM c_v""", recursive=True)
def design_registrations(spark: SparkSession, d: str) -> DataFrame:
    e = V.event(spark, d)
    return R.registrations(e.select(F.col("k").alias("key"), "id", (F.col("id") % 7).alias("expected"), (F.col("task_id") % 3 == 0).cast("string").alias("path")))


@query("WITH n_v AS (SELECT claim_id, subject_digest % 40 AS d, checker_sha % 3 AS s, count(*) AS c FROM attempt_v WHERE exit_code = 1 GROUP BY 1, 2, 3), k_v AS (SELECT DISTINCT id % 40 AS d, size % 3 AS s FROM path_v WHERE id % 8 <> 3), p_v AS (SELECT n.claim_id, max(n.c) AS most, bool_and(k.d IS NOT NULL) AS known FROM n_v n LEFT JOIN k_v k ON k.d = n.d AND k.s = n.s GROUP BY 1) SELECT c.id, CASE WHEN c.kind = '5-LOW' AND p.most IS NOT NULL THEN 'names designs' WHEN c.kind <> '5-LOW' AND p.most IS NULL THEN 'names none' WHEN p.most > 1 THEN 'twice' WHEN NOT p.known THEN 'not registered' END AS fault FROM claim_v c LEFT JOIN p_v p ON p.claim_id = c.id")
def disposition_faults(spark: SparkSession, d: str) -> DataFrame:
    named = V.attempt(spark, d).filter("exit_code = 1").select(F.col("claim_id").alias("id"), (F.col("subject_digest") % 40).alias("design"), (F.col("checker_sha") % 3).alias("section"))
    known = V.path(spark, d).filter("id % 8 != 3").select((F.col("id") % 40).alias("design"), (F.col("size") % 3).alias("section"))
    return R.dispositions(V.claim(spark, d).select("id", (F.col("kind") != "5-LOW").alias("required")), named, known)


@query("""SELECT a.id, CASE WHEN p.id IS NULL OR a.checker_sha % 3 <> p.size % 3 THEN 'design revision' WHEN p.size % 10 = 0 OR a.day % 5 = 0 THEN 'content' WHEN c.kind = '5-LOW' THEN 'no required disposition' WHEN c.id % 9 = 0 THEN 'stale disposition'
 WHEN a.day % 7 = p.size % 7 THEN 'own document' WHEN c.origin = 'P' THEN 'no worker' WHEN a.day % 7 = c.task_id % 7 THEN 'own work' END AS refusal FROM attempt_v a LEFT JOIN path_v p ON p.id = a.subject_digest JOIN claim_v c ON c.id = a.claim_id""")
def review_refusals(spark: SparkSession, d: str) -> DataFrame:
    a, p, c = V.attempt(spark, d), V.path(spark, d), V.claim(spark, d)
    designs = p.select(F.col("id").alias("design"), (F.col("size") % 3).alias("revision"), F.when(F.col("size") % 10 != 0, F.col("id") % 4).alias("content"), (F.col("size") % 7).alias("author"))
    works = c.select(F.col("id").alias("work"), (F.col("kind") != "5-LOW").alias("required"), (F.col("id") % 9 != 0).alias("bound"), F.when(F.col("origin") != "P", F.col("task_id") % 7).alias("worker"))
    content = F.when(F.col("day") % 5 != 0, F.col("subject_digest") % 4).otherwise(-1)
    reviews = a.select("id", F.col("subject_digest").alias("design"), F.col("claim_id").alias("work"), (F.col("checker_sha") % 3).alias("revision"), content.alias("content"), (F.col("day") % 7).alias("reviewer"))
    return R.review_refusals(reviews, designs, works)


@query("""WITH t_v AS (SELECT id AS task, CASE WHEN origin = 'P' THEN 'worker identity required' WHEN id % 13 = 0 THEN 'worker identity conflict' WHEN kind = '5-LOW' THEN 'disposition required' WHEN id % 17 = 0 THEN 'stale disposition' END AS hold, kind <> '4-NOT SPECIFIED' AS required FROM claim_v),
 r_v AS (SELECT claim_id, subject_digest, arg_max(checker_sha % 4, id) AS c, arg_max(day % 6, id) AS m, arg_max(exit_code, id) AS x FROM attempt_v WHERE duration_ms >= 500 GROUP BY 1, 2),
 d_v AS (SELECT t.task, n.d AS design, CASE WHEN n.d % 19 = 0 THEN 'design missing' WHEN n.d % 23 = 0 THEN 'needs initialization' WHEN n.d % 29 = 0 THEN 'content changed' WHEN r.c IS NULL THEN 'review required' WHEN r.c = 0 THEN 'stale review' WHEN r.m = 0 THEN 'source changed' WHEN r.x <> 0 THEN 'approval required' END AS hold
 FROM t_v t JOIN (SELECT DISTINCT claim_id, subject_digest AS d FROM attempt_v) n ON n.claim_id = t.task LEFT JOIN r_v r ON r.claim_id = t.task AND r.subject_digest = n.d WHERE t.hold IS NULL AND t.required)
 SELECT task, NULL::BIGINT AS design, hold FROM t_v WHERE hold IS NOT NULL UNION ALL SELECT task, design, hold FROM d_v WHERE hold IS NOT NULL""")
def design_holds(spark: SparkSession, d: str) -> DataFrame:
    """What holds a task back for its designs: their documents, dispositions and newest reviews."""
    a, i, x = V.attempt(spark, d), F.col("id"), F.col("subject_digest")
    said = F.when(F.col("kind") == "4-NOT SPECIFIED", "not applicable").when(F.col("kind") != "5-LOW", "required")
    tasks = V.claim(spark, d).select(i.alias("task"), F.when(F.col("origin") != "P", F.col("task_id")).alias("worker"), (i % 13 == 0).alias("conflict"), said.alias("disposition"), (i % 5).alias("binding"), F.when(i % 17 == 0, -1).otherwise(i % 5).alias("bound"), (i % 3).alias("source"))
    designs = V.path(spark, d).filter("id % 19 != 0").select(i.alias("design"), F.when(i % 23 != 0, i % 6).alias("registered"), F.when(i % 29 == 0, -1).otherwise(i % 6).alias("content"), F.lit(1).alias("revision"))
    result = F.when(F.col("exit_code") == 0, "approved").otherwise("rejected")
    reviews = a.filter("duration_ms >= 500").select(F.col("claim_id").alias("task"), x.alias("design"), "id", F.when(F.col("checker_sha") % 4 == 0, 0).otherwise(1).alias("revision"), F.when(x % 29 == 0, -1).otherwise(x % 6).alias("content"), (F.col("claim_id") % 5).alias("binding"), F.when(F.col("day") % 6 == 0, -1).otherwise(F.col("claim_id") % 3).alias("source"), result.alias("result"))
    return R.design_holds(tasks, a.select(F.col("claim_id").alias("task"), x.alias("design")), designs, reviews)


_COMMITS = "p_v AS (SELECT c_custkey AS commit, c_custkey // 2 AS parent FROM customer UNION SELECT c_custkey, c_custkey // 3 FROM customer), r_v(head, below) AS (SELECT DISTINCT task_id, CAST(task_id AS BIGINT) FROM claim_v UNION SELECT r.head, CAST(p.parent AS BIGINT) FROM r_v r JOIN p_v p ON p.commit = r.below)"


@query(f"WITH {_COMMITS} SELECT id, needs, hold FROM (SELECT c.id, w.id AS needs, CASE WHEN w.id % 10 = 0 THEN 'unknown' WHEN r.head IS NULL THEN 'missing' END AS hold FROM claim_v c JOIN claim_v w ON w.id = c.id + 5 LEFT JOIN r_v r ON r.head = c.task_id AND r.below = w.task_id % 50 WHERE w.origin = 'F') WHERE hold IS NOT NULL", recursive=True)
def source_holds(spark: SparkSession, d: str) -> DataFrame:
    """Settled dependencies whose commit the consumer does not descend from."""
    c, k = V.claim(spark, d), F.col("c_custkey").cast("long")
    producers = c.select(F.col("id").alias("work"), (F.col("origin") == "F").alias("settled"), F.when(F.col("id") % 10 != 0, F.col("task_id") % 50).cast("long").alias("commit"))
    parents = V.read(spark, d, "customer").select(k.alias("commit"), F.explode(F.array(F.floor(k / 2), F.floor(k / 3))).alias("parent")).distinct()
    return R.source_holds(c.select("id", (F.col("id") + 5).alias("needs"), F.col("task_id").cast("long").alias("head")), producers, parents)


@query("SELECT id, task_id, row_number() OVER (PARTITION BY task_id ORDER BY id) AS place FROM event_v WHERE kind = 'view' AND k >= 50")
def pending_inputs(spark: SparkSession, d: str) -> DataFrame:
    e = V.event(spark, d)
    return R.pending_inputs(e.filter("kind = 'view'").select("id", "task_id"), e.filter("k < 50"), "task_id").withColumn("place", F.col("place").cast("long"))


@query("""SELECT e.id, CASE WHEN e.k IN (SELECT k FROM event_v WHERE kind = 'error' AND id % 40 = 0) THEN 'pending input' WHEN w.id IS NULL OR CASE WHEN e.id % 6 = 0 THEN 0 ELSE (e.id + 1) % 7 END <> w.id % 7 OR w.origin IN ('F', 'P') THEN 'not current'
 WHEN w.id % 11 = 0 THEN 'integrated' WHEN w.id % 13 = 0 THEN 'conflict' WHEN w.kind = '5-LOW' THEN 'dependencies' WHEN e.task_id IN (SELECT task_id FROM event_v WHERE kind = 'purchase' AND k >= 95) THEN 'owned' END AS refusal FROM event_v e LEFT JOIN claim_v w ON w.id = e.id + 1""")
def assignment_refusals(spark: SparkSession, d: str) -> DataFrame:
    e, i = V.event(spark, d), F.col("id")
    works = V.claim(spark, d).select(i.alias("work"), (i % 7).alias("revision"), F.when(F.col("origin") == "F", "settled").when(F.col("origin") == "P", "cancelled").otherwise("queued").alias("status"), (i % 11 == 0).alias("integrated"), (i % 13 == 0).alias("conflict"), (F.col("kind") == "5-LOW").alias("held"))
    wanted = e.select("id", F.col("k").alias("goal"), (i + 1).alias("work"), F.when(i % 6 == 0, 0).otherwise((i + 1) % 7).alias("revision"), F.col("task_id").alias("task"))
    return R.assignment_refusals(wanted, works, e.filter("kind = 'error' AND id % 40 = 0").select(F.col("k").alias("goal")), e.filter("kind = 'purchase' AND k >= 95").select(F.col("task_id").alias("task")))


@query("SELECT id, hold FROM (SELECT id, unnest([CASE WHEN k > 80 THEN 'pending input' END, CASE WHEN task_id % 6 = 0 THEN 'coordinates changed' END, CASE WHEN id IN (SELECT claim_id FROM risk_v) THEN 'source' END, CASE WHEN id % 4 <> k % 4 THEN 'stale version' END, CASE WHEN kind <> 'view' THEN 'already observed' END]) AS hold FROM event_v) WHERE hold IS NOT NULL")
def dispatch_holds(spark: SparkSession, d: str) -> DataFrame:
    """All that keeps an assignment from being dispatched, not only the first."""
    from sealmark.operators.holds import holds

    held = V.risk(spark, d).select(F.col("claim_id").alias("id"), F.lit(True).alias("held")).distinct()
    rows = V.event(spark, d).join(held, "id", "left")
    return holds(rows, "id", [("pending input", F.col("k") > 80), ("coordinates changed", F.col("task_id") % 6 == 0), ("source", F.col("held")), ("stale version", F.col("id") % 4 != F.col("k") % 4), ("already observed", F.col("kind") != "view")])


@query("SELECT task_id, s.s AS session, count(*) FILTER (k % 3 = s.s AND kind <> 'error') > 0 OR count(*) FILTER (kind <> 'error') = 0 AS worked FROM event_v, (VALUES (0), (1), (2)) s(s) GROUP BY 1, 2")
def sessions_that_worked(spark: SparkSession, d: str) -> DataFrame:
    """Whether a session worked on a task; where no row of a task names its session, any may have."""
    own = F.when(F.col("kind") != "error", (F.col("k") % 3).cast("int"))
    per = V.event(spark, d).groupBy("task_id").agg(F.collect_set(own).alias("s"))
    asked = per.withColumn("session", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    return asked.select("task_id", "session", ((F.size("s") == 0) | F.array_contains("s", F.col("session"))).alias("worked"))


@query("WITH e_v AS (SELECT kind, max(created_at) AS last FROM event_v GROUP BY 1) SELECT kind, last, true AND hour(TIMESTAMP '2024-02-07 10:00:00') >= 9 AND datediff('day', last, TIMESTAMP '2024-02-07 10:00:00') >= 7 AS due FROM e_v")
def due_from_export(spark: SparkSession, d: str) -> DataFrame:
    """Which kinds are due on a Wednesday at ten, from the lines of an export alone."""
    from sealmark.sources.ledger import to_lines

    lines = to_lines({"event": V.event(spark, d).select("id", "kind", F.col("created_at").cast("string").alias("at"))}).filter(F.contains("value", F.lit('"_table":"event"')))
    rows = lines.select(F.from_json("value", "kind string, at string").alias("r")).select("r.kind", F.to_timestamp_ntz("r.at").alias("at"))
    now = F.lit("2024-02-07 10:00:00").cast("timestamp_ntz")
    return rows.groupBy("kind").agg(F.max("at").alias("last")).select("kind", "last", due(F.col("last"), now, 2, 9, 7).alias("due"))


@query("SELECT split_part(path, '/', 1) AS area, sha256(string_agg(path || chr(31) || CASE WHEN size % 9 = 0 THEN 'missing' ELSE sha END || chr(30), '' ORDER BY path)) AS digest, count(*) AS n FROM path_v GROUP BY 1")
def criteria_stamps(spark: SparkSession, d: str) -> DataFrame:
    """One digest of the files that make up a ruler; a file that is not there has its place in it."""
    p = V.path(spark, d).withColumns({"area": F.element_at(F.split("path", "/"), 1), "sha": F.when(F.col("size") % 9 != 0, F.col("sha"))})
    return tree_digests(p.withColumn("sha", F.coalesce("sha", F.lit("missing"))), "area")


@query("SELECT task_id, list_aggregate(list_sort(list_distinct(list_concat(['gate/**', 'g1'], list(DISTINCT 'g' || (k % 12)) FILTER (kind = 'error'), CASE WHEN task_id % 2 = 0 THEN ['hooks/**'] ELSE [] END))), 'string_agg', ',') AS globs FROM event_v GROUP BY 1")
def protected_paths(spark: SparkSession, d: str) -> DataFrame:
    """The globs that are always protected together with a task's own and those of its host; never instead of them."""
    own = F.collect_set(F.when(F.col("kind") == "error", F.concat(F.lit("g"), (F.col("k") % 12).cast("string"))))
    per = V.event(spark, d).groupBy("task_id").agg(own.alias("own"))
    host = F.when(F.col("task_id") % 2 == 0, F.array(F.lit("hooks/**"))).otherwise(F.array().cast("array<string>"))
    return per.select("task_id", F.array_join(F.array_sort(F.array_union(F.array_union(F.array(F.lit("gate/**"), F.lit("g1")), "own"), host)), ",").alias("globs"))


_W = "list_distinct(regexp_extract_all(lower({}), '([a-z_][a-z0-9_]*|[一-鿿])', 1))"


@query(f"WITH s_v AS (SELECT DISTINCT p_name AS name, p_size AS value FROM part WHERE p_partkey % 2 = 0), l_v AS (SELECT p_partkey AS id, p_name AS name, p_size AS value FROM part WHERE p_partkey % 2 = 1) SELECT l.id, s.name AS setting, l.value FROM l_v l JOIN s_v s ON s.value = l.value AND len(list_intersect({_W.format('s.name')}, {_W.format('l.name')})) > 0")
def values_kept_twice(spark: SparkSession, d: str) -> DataFrame:
    """Values that a setting and a literal both hold under names that share a word: different names meet once, by value and word, and literals take what theirs met."""
    p = V.read(spark, d, "part").select("p_partkey", "p_name", F.col("p_size").alias("value"))
    return R.values_kept_twice(p.filter("p_partkey % 2 = 0").select(F.col("p_name").alias("setting"), "value"), p.filter("p_partkey % 2 = 1").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), "value"))
