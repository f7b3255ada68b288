"""Ordered folds over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sealmark import views as V
from sealmark.functions.hashing import event_hash
from sealmark.operators import chain
from sealmark.operators import folds as O
from sealmark.operators import joins
from sealmark.operators.latest import latest, latest_value, newest_if_open, newest_or_stored
from sealmark.operators.settled import scratch, settle
from sealmark.plans.registry import query


@query("""WITH m_v AS (SELECT -1 AS id, t.id AS task_id, 'g' || g.g AS "glob", true AS added FROM task_v t, (VALUES (0), (1), (2)) g(g)
 UNION ALL SELECT id, task_id, 'g' || (k % 8), kind = 'signup' FROM event_v WHERE kind = 'error' OR (kind = 'signup' AND value >= 5))
 SELECT task_id, "glob" FROM m_v GROUP BY 1, 2 HAVING arg_max(added, id)""")
def current_scope(spark: SparkSession, d: str) -> DataFrame:
    """Signups widen a task's scope, unless refused (a low value); errors narrow it."""
    e = V.event(spark, d).filter("kind IN ('signup', 'error')")
    kind = F.when(F.col("kind") == "signup", "scope_widen").otherwise("scope_narrow")
    changes = e.select("id", "task_id", kind.alias("kind"), F.concat(F.lit("g"), (F.col("k") % 8).cast("string")).alias("glob"), (F.col("value") >= 5).alias("accepted"))
    base = V.task(spark, d).select(F.col("id").alias("task_id"), F.explode(F.array(*map(F.lit, ("g0", "g1", "g2")))).alias("glob"))
    return O.current_scope(base, changes).select("task_id", "glob")


@query("SELECT e.id, e.task_id, e.k FROM event_v e WHERE e.kind = 'click' AND NOT EXISTS (SELECT 1 FROM event_v w WHERE w.kind = 'error' AND w.task_id = e.task_id AND w.k = e.k AND w.id > e.id)")
def standing_entries(spark: SparkSession, d: str) -> DataFrame:
    e = V.event(spark, d).select("id", "task_id", "k", "kind")
    return O.standing(e.filter("kind = 'click'"), e.filter("kind = 'error'"), ["task_id", "k"]).select("id", "task_id", "k")


@query("SELECT k, arg_max(kind, id) AS kind, arg_max(task_id, id) AS task_id, max(id) AS id FROM event_v GROUP BY 1")
def latest_group(spark: SparkSession, d: str) -> DataFrame:
    return latest(V.event(spark, d).select("k", "kind", "task_id", "id"), "k")


@query("WITH l_v AS (SELECT k, arg_max(value, id) AS value, max(id) AS id FROM event_v WHERE kind = 'view' AND task_id = 8 GROUP BY 1) SELECT k, id, coalesce(value > 10, false) AS evaluated FROM l_v")
def lens_reports(spark: SparkSession, d: str) -> DataFrame:
    own = V.event(spark, d).filter((F.col("kind") == "view") & F.col("task_id").eqNullSafe(8))
    return O.split_last(own, "k", F.col("value") > 10).select("k", "id", "evaluated")


@query("SELECT task_id, 'f' || (k % 5) AS field, arg_max(CAST(k AS VARCHAR), id) AS value FROM event_v GROUP BY 1, 2")
def merged_fields(spark: SparkSession, d: str) -> DataFrame:
    e = V.event(spark, d)
    payload = F.create_map(F.concat(F.lit("f"), (F.col("k") % 5).cast("string")), F.col("k").cast("string"))
    return O.merged(e.select("id", "task_id", payload.alias("payload")), "task_id")


@query("SELECT c.id, coalesce(n.kind, c.kind) AS kind FROM claim_v c LEFT JOIN (SELECT k * 3 AS id, arg_max(kind, id) AS kind FROM event_v GROUP BY 1) n ON n.id = c.id")
def current_note(spark: SparkSession, d: str) -> DataFrame:
    new = V.event(spark, d).select((F.col("k") * 3).alias("claim_id"), "kind", "id")
    stored = V.claim(spark, d).select(F.col("id").alias("claim_id"), "kind")
    return newest_or_stored(stored, new, "claim_id", "kind").select(F.col("claim_id").alias("id"), "kind")


@query("WITH b_v AS (SELECT k, kind, arg_max(task_id, id) AS task_id FROM event_v GROUP BY 1, 2) SELECT k, kind, task_id FROM b_v WHERE task_id NOT IN (SELECT task_id FROM event_v WHERE kind = 'purchase' AND k >= 95)")
def bindings(spark: SparkSession, d: str) -> DataFrame:
    e = V.event(spark, d)
    ended = joins.ended_tasks(e.filter("k >= 95"), ["purchase"])
    return newest_if_open(e.select("k", "kind", "task_id", "id"), ended, ["k", "kind"]).select("k", "kind", "task_id")


@query("WITH r_v AS (SELECT task_id, arg_max(kind, id) AS kind, arg_max(k, id) AS k FROM event_v WHERE kind IN ('signup', 'error') GROUP BY 1) SELECT task_id, CASE WHEN kind = 'signup' THEN k END AS open_round FROM r_v")
def current_round(spark: SparkSession, d: str) -> DataFrame:
    own = V.event(spark, d).filter("kind IN ('signup', 'error')")
    last = latest_value(own, "task_id", F.struct("kind", "k"))
    return last.select("task_id", F.when(F.col("value.kind") == "signup", F.col("value.k")).alias("open_round"))


@query("SELECT id, arg_min(k, eid) AS continues FROM (SELECT task_id AS id, k, id AS eid FROM event_v WHERE kind = 'view') GROUP BY 1 HAVING arg_min(k, eid) <> id")
def continued_by(spark: SparkSession, d: str) -> DataFrame:
    own = V.event(spark, d).filter("kind = 'view'").groupBy(F.col("task_id").alias("id")).agg(F.min_by("k", "id").alias("continues"))
    return own.filter("continues != id")


@query("WITH l_v AS (SELECT task_id, max(id) AS c FROM event_v WHERE kind = 'purchase' GROUP BY 1), u_v AS (SELECT e.task_id, count(DISTINCT e.k) AS used FROM event_v e LEFT JOIN l_v l ON l.task_id = e.task_id WHERE e.kind <> 'purchase' AND (l.c IS NULL OR e.id > l.c) GROUP BY 1) SELECT t.id AS task_id, coalesce(u.used, 0) AS used, coalesce(u.used, 0) >= 3 AS refused FROM task_v t LEFT JOIN u_v u ON u.task_id = t.id")
def repair_budget(spark: SparkSession, d: str) -> DataFrame:
    return O.epoch_counts(V.event(spark, d), "task_id", F.col("kind") == "purchase", "k", 3)


@query("WITH o_v AS (SELECT claim_id, id, duration_ms >= 3000 AS dear, max(CASE WHEN exit_code = 1 AND duration_ms < 3000 THEN 1 ELSE 0 END) OVER (PARTITION BY claim_id ORDER BY duration_ms, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS failed FROM attempt_v) SELECT claim_id, id, dear AND coalesce(failed, 0) = 1 AS skipped FROM o_v")
def skipped_checks(spark: SparkSession, d: str) -> DataFrame:
    return O.running_skip(V.attempt(spark, d), "claim_id", "duration_ms", F.col("exit_code") == 1, 3000).select("claim_id", "id", "skipped")


@query("SELECT id, k, before FROM (SELECT id, k, lag(k) OVER (PARTITION BY task_id, kind ORDER BY id) AS before FROM event_v) WHERE k < before")
def descending_sections(spark: SparkSession, d: str) -> DataFrame:
    e = V.event(spark, d).withColumn("doc", F.struct("task_id", "kind"))
    return O.drops(e, "doc", "k", "id").select("id", "k", "before")


@query("SELECT id, sha256(concat_ws(chr(31), 's1', coalesce(lag(sha256(kind)) OVER (PARTITION BY task_id ORDER BY id), ''), CAST(id AS VARCHAR), kind, CAST(k AS VARCHAR))) AS hash FROM event_v")
def event_hashes(spark: SparkSession, d: str) -> DataFrame:
    prev = F.lag(F.sha2("kind", 256)).over(Window.partitionBy("task_id").orderBy("id"))
    return V.event(spark, d).withColumn("p", prev).select("id", event_hash(F.col("p"), F.lit("s1"), F.col("id"), F.col("kind"), F.col("k")).alias("hash"))


@query("SELECT count(*) AS n, max(id) AS last_id, arg_max(kind, id) AS head FROM event_v")
def chain_tip(spark: SparkSession, d: str) -> DataFrame:
    return chain.tip(V.event(spark, d).select("id", F.col("kind").alias("row_hash")))


@query("SELECT id, 'hash' AS problem FROM event_v WHERE id % 977 = 5")
def tampered_events(spark: SparkSession, d: str) -> DataFrame:
    """Chained segments of all events, some of which are then changed: the walk finds exactly these."""
    built, _ = chain.build_segments(V.event(spark, d).select("id", "kind", "k"), ["id", "kind", "k"], "s1")
    changed = built.withColumn("k", F.when(F.col("id") % 977 == 5, F.col("k") + 1).otherwise(F.col("k")))
    return chain.walk(changed, ["id", "kind", "k"], chain="segment")


@query("SELECT (SELECT count(*) FROM event_v) AS n, (SELECT max(id) FROM event_v) AS last_id, true AS same, 0 AS faults")
def appended_chain(spark: SparkSession, d: str) -> DataFrame:
    """Events chained in two appends, the second of which goes on from the tip of the first: the tree is the one over all rows at once."""
    rows, fields = V.event(spark, d).select("id", "kind", "k"), ["id", "kind", "k"]
    with scratch(spark) as keep:
        half = F.col("id") <= rows.agg(F.max("id")).first()[0] // 2
        first, _ = chain.build_segments(rows.filter(half), fields, "s1")
        first = settle(first)
        both = first.unionByName(settle(chain.extend(first, rows.filter(~half), fields, "s1", chain.root(chain.heads_of(first, "s1")))))
        _, whole = chain.build_segments(rows, fields, "s1")
        top = lambda heads, *names: heads.orderBy(F.desc("level")).limit(1).select(*names)
        ends = top(chain.heads_of(both, "s1"), "n", "last_id", F.col("head").alias("a")).crossJoin(top(whole, F.col("head").alias("b")))
        faults = chain.walk(both, fields, chain="segment").agg(F.count("*").cast("int").alias("faults"))
        return keep(ends.crossJoin(faults).select("n", "last_id", (F.col("a") == F.col("b")).alias("same"), "faults"))


@query("SELECT id // 4096 AS segment, count(*) AS n FROM event_v WHERE id % 5000 <> 4999 GROUP BY 1 HAVING count(*) <> least(4096, (SELECT max(id) + 1 FROM event_v) - id // 4096 * 4096)")
def lost_from_segments(spark: SparkSession, d: str) -> DataFrame:
    """Segments that have lost rows since their heads were chained."""
    rows = V.event(spark, d).select("id", "kind", "k")
    _, heads = chain.build_segments(rows, ["id", "kind", "k"], "s1")
    now, _ = chain.build_segments(rows.filter("id % 5000 != 4999"), ["id", "kind", "k"], "s1")
    left = now.groupBy("segment").agg(F.count("*").alias("n"), F.max_by("row_hash", "id").alias("now"))
    return heads.filter("level = 0").select("segment", "head").join(left, "segment", "left").filter("NOT head <=> now").select("segment", "n")


@query("WITH s_v AS (SELECT k AS seq, min(id) AS starts_after, CASE WHEN k % 10 = 3 THEN -1 ELSE min(id) END AS shown, lead(min(id)) OVER (ORDER BY k) AS ends_with FROM event_v WHERE k % 17 <> 4 GROUP BY k), l_v AS (SELECT *, lag(seq) OVER (ORDER BY seq) AS p, lag(ends_with) OVER (ORDER BY seq) AS e FROM s_v) SELECT seq, CASE WHEN seq <> p + 1 THEN 'missing segment before' ELSE 'does not continue' END AS problem FROM l_v WHERE p IS NOT NULL AND (seq <> p + 1 OR shown <> e)")
def segment_gaps(spark: SparkSession, d: str) -> DataFrame:
    own = V.event(spark, d).filter("k % 17 != 4").groupBy(F.col("k").alias("seq")).agg(F.min("id").alias("at"))
    own = own.withColumn("ends_with", F.lead("at").over(Window.orderBy("seq")))
    return chain.segment_gaps(own.withColumn("starts_after", F.when(F.col("seq") % 10 == 3, -1).otherwise(F.col("at"))))
