"""Histories in order, newest words, and keys that tell when an answer has gone stale."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sealmark import views as V
from sealmark.functions import predicates as P
from sealmark.functions import text as X
from sealmark.functions.hashing import joined
from sealmark.operators import folds as O
from sealmark.operators.latest import latest, newest_first
from sealmark.plans.registry import query
from sealmark.streaming.state import since


@query("SELECT id, task_id, k FROM event_v WHERE kind = 'purchase' ORDER BY id")
def completion_history(spark: SparkSession, d: str) -> DataFrame:
    return V.event(spark, d).filter("kind = 'purchase'").select("id", "task_id", "k").orderBy("id")


@query("SELECT task_id, 'f' || (k % 5) AS field, arg_max(CAST(k AS VARCHAR), id) AS value FROM event_v WHERE k >= 50 GROUP BY 1, 2")
def handoffs(spark: SparkSession, d: str) -> DataFrame:
    e = V.event(spark, d).filter("k >= 50")
    payload = F.create_map(F.concat(F.lit("f"), (F.col("k") % 5).cast("string")), F.col("k").cast("string"))
    return O.merged(e.select("id", "task_id", payload.alias("payload")), "task_id")


@query("SELECT id, k FROM event_v WHERE kind = 'view' AND value > 20 ORDER BY id DESC LIMIT 10")
def sweep_history(spark: SparkSession, d: str) -> DataFrame:
    return newest_first(V.event(spark, d).filter("kind = 'view' AND value > 20").select("id", "k"), 10)


@query("SELECT max(id) FILTER (value > 20) AS complete, max(id) AS attempted FROM event_v WHERE kind = 'view'")
def last_sweeps(spark: SparkSession, d: str) -> DataFrame:
    return V.event(spark, d).filter("kind = 'view'").agg(F.max(F.when(F.col("value") > 20, F.col("id"))).alias("complete"), F.max("id").alias("attempted"))


@query("WITH s_v AS (SELECT max(created_at) AS at_ts FROM event_v WHERE kind = 'error' AND k = 77), l_v AS (SELECT k, arg_max(value, id) AS value FROM event_v WHERE kind = 'view' AND created_at > (SELECT at_ts FROM s_v) GROUP BY 1) SELECT k, CASE WHEN value > 20 THEN 'reviewed' ELSE 'inconclusive' END AS result FROM l_v")
def reviewed_since(spark: SparkSession, d: str) -> DataFrame:
    e = V.event(spark, d)
    own = latest(since(e, e.filter("kind = 'error' AND k = 77")).filter("kind = 'view'"), "k")
    return own.select("k", F.when(F.col("value") > 20, "reviewed").otherwise("inconclusive").alias("result"))


@query("WITH n_v AS (SELECT claim_id, arg_max(exit_code, id) AS exit_code FROM attempt_v GROUP BY 1) SELECT c.task_id, count(*) FILTER (n.exit_code = 0) AS answered, coalesce(list_aggregate(list_sort(list(DISTINCT c.kind) FILTER (n.exit_code IS NULL OR n.exit_code <> 0)), 'string_agg', ','), '') AS open_kinds FROM claim_v c LEFT JOIN n_v n ON n.claim_id = c.id GROUP BY 1")
def carry_forward(spark: SparkSession, d: str) -> DataFrame:
    last = V.attempt(spark, d).groupBy(F.col("claim_id").alias("id")).agg(F.max_by("exit_code", "id").alias("code"))
    rows = V.claim(spark, d).join(last, "id", "left")
    done = F.coalesce(F.col("code") == 0, F.lit(False))
    return rows.groupBy("task_id").agg(F.count_if(done).alias("answered"), F.array_join(F.array_sort(F.collect_set(F.when(~done, F.col("kind")))), ",").alias("open_kinds"))


@query("SELECT claim_id, kind FROM risk_v WHERE signed_by = '' ORDER BY claim_id DESC")
def repo_risks(spark: SparkSession, d: str) -> DataFrame:
    return V.risk(spark, d).filter("signed_by = ''").select("claim_id", "kind").orderBy(F.desc("claim_id"))


@query("SELECT claim_id, 'signed ' || CASE WHEN signed_by = 'human' THEN CASE WHEN was_tty = 1 THEN 'at a terminal' ELSE 'not at a terminal' END WHEN signed_by = 'agent' THEN 'as an agent' ELSE 'by an unrecorded signer' END || ' by ' || kind AS line FROM risk_v")
def attributions(spark: SparkSession, d: str) -> DataFrame:
    return V.risk(spark, d).select("claim_id", P.attribution(F.col("kind"), F.col("signed_by"), F.col("was_tty")).alias("line"))


@query("SELECT claim_id, id, sha256(concat_ws(chr(31), CAST(subject_digest AS VARCHAR), CAST(checker_sha AS VARCHAR), CASE WHEN exit_code = 4 THEN worktree ELSE '' END)) AS key FROM attempt_v")
def staleness_keys(spark: SparkSession, d: str) -> DataFrame:
    """What an attempt's answer depends on; the worktree only where the claim is of the whole repository."""
    tree = F.when(F.col("exit_code") == 4, F.col("worktree"))
    return V.attempt(spark, d).select("claim_id", "id", F.sha2(joined(F.col("subject_digest"), F.col("checker_sha"), tree), 256).alias("key"))


@query("SELECT r.claim_id FROM (SELECT DISTINCT claim_id FROM risk_v WHERE signed_by = '') r JOIN (SELECT claim_id, arg_max(subject_digest, id) AS a, arg_max(checker_sha, id) AS b, arg_min(subject_digest, id) AS c, arg_min(checker_sha, id) AS e FROM attempt_v GROUP BY 1) k ON k.claim_id = r.claim_id WHERE k.a = k.c AND k.b = k.e")
def covered_by_repo_risk(spark: SparkSession, d: str) -> DataFrame:
    """Claims with a repository signature whose key is the same at their first and newest attempt."""
    key = F.struct("subject_digest", "checker_sha")
    now = V.attempt(spark, d).groupBy("claim_id").agg(F.max_by(key, "id").alias("a"), F.min_by(key, "id").alias("b")).filter(F.col("a").eqNullSafe(F.col("b")))
    return V.risk(spark, d).filter("signed_by = ''").select("claim_id").distinct().join(now.select("claim_id"), "claim_id", "left_semi")


@query("SELECT claim_id, list_aggregate(list_sort(list(DISTINCT 'file:' || worktree || '=' || m)), 'string_agg', ';') AS digests FROM (SELECT claim_id, worktree, max(subject_digest) AS m FROM attempt_v GROUP BY 1, 2) GROUP BY 1")
def subject_digests(spark: SparkSession, d: str) -> DataFrame:
    """Per claim a map from reference to digest, shown as text."""
    per = V.attempt(spark, d).groupBy("claim_id", F.concat(F.lit("file:"), "worktree").alias("ref")).agg(F.max("subject_digest").alias("digest"))
    maps = per.groupBy("claim_id").agg(F.map_from_entries(F.collect_list(F.struct("ref", "digest"))).alias("m"))
    return maps.select("claim_id", F.array_join(F.array_sort(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))), ";").alias("digests"))


@query("SELECT event_id AS id, coalesce(NOT (datediff('second', ts, TIMESTAMP '2024-01-20 00:00:00') BETWEEN 0 AND 864000), true) AS expired FROM events")
def expired_summaries(spark: SparkSession, d: str) -> DataFrame:
    now = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    return V.event(spark, d).select("id", P.expired(F.col("created_at"), now, 864_000).alias("expired"))


@query("WITH c_v AS (SELECT task_id, count(DISTINCT kind) FILTER (k < 30) AS a, count(DISTINCT kind) AS n FROM event_v GROUP BY 1) SELECT task_id, CASE WHEN n = 0 THEN 'unknown' WHEN a > 0 THEN 'core' ELSE 'uncovered' END AS status FROM c_v")
def proof_status(spark: SparkSession, d: str) -> DataFrame:
    """Changed paths of a task are its kinds, those of small numbers under ``core/``."""
    path = F.when(F.col("k") < 30, F.concat(F.lit("core/"), "kind")).otherwise(F.col("kind"))
    sets = V.event(spark, d).groupBy("task_id").agg(F.collect_set(path).alias("changed"))
    return sets.select("task_id", P.proof_status(F.col("changed"), {"core": ["core/**"]}, required=True).alias("status"))


@query("SELECT l_orderkey AS claim_id, count(*) AS crashes FROM lineitem WHERE l_returnflag = 'A' AND l_linestatus = 'F' GROUP BY 1")
def crashes(spark: SparkSession, d: str) -> DataFrame:
    a = V.attempt(spark, d)
    err = F.when(F.col("worktree") == "F", "Traceback (most recent call last):\n  x")
    return a.filter(P.crashed(F.col("exit_code"), F.lit(" "), err)).groupBy("claim_id").agg(F.count("*").alias("crashes"))


@query("SELECT kind, count(*) AS accepted, count(*) FILTER (list_has_any(t, ['qui', 'edest', 'theaat', 'un'])) AS took_up FROM (SELECT role AS kind, list_distinct(regexp_extract_all(lower(text), '([a-z_][a-z0-9_]*|[一-鿿])', 1)) AS t FROM conversations) GROUP BY 1")
def doctrine_uptake(spark: SparkSession, d: str) -> DataFrame:
    """Texts that use a word of a rule that no sibling rule has."""
    rule, siblings = F.array(*map(F.lit, ("the", "qui", "edest", "theaat", "un", "of"))), F.array(F.lit("the"), F.lit("of"))
    own = F.array_except(rule, siblings)
    rows = V.read(spark, d, "conversations").select(F.col("role").alias("kind"), X.tokens(F.col("text")).alias("t"))
    return rows.groupBy("kind").agg(F.count("*").alias("accepted"), F.count_if(F.arrays_overlap("t", own)).alias("took_up"))


_KEYS = ("request_id", "nonce", "idempotencyKey", "Dedupe-Key", "client_request_id", "dedup_x", "oncePerDay")


# Of the names, those at 2 to 5 are keys: a request id is none by itself, and a nonce or a word with "once" in it must not be.
@query("SELECT p_brand, count(*) AS n FROM part WHERE p_partkey % 7 IN (2, 3, 4, 5) GROUP BY 1")
def once_names(spark: SparkSession, d: str) -> DataFrame:
    """Names of keys that tell a repeated request."""
    name = F.element_at(F.array(*map(F.lit, _KEYS)), (F.col("p_partkey") % 7 + 1).cast("int"))
    return V.read(spark, d, "part").filter(P.idempotency_name(name)).groupBy("p_brand").agg(F.count("*").alias("n"))


_WRITES = [("symbol", ".send_media_group", "x.put()"), ("symbol", "transfer_all", "post(x)"), ("regex", r"\bINSERT\s+INTO\b", "replay(x)"), ("regex", r"\w+_all", "cursor.executemany(q)"), ("symbol", "uploadFile", ""), ("regex", "record", "row.add(1)"), ("symbol", r"\bINSERT\s+INTO\b", "")]


# A symbol tells by its own words (0, 4, 6), a regular expression by its line (3, 5).
@query("SELECT p_brand, count(*) AS n FROM part WHERE p_partkey % 7 IN (0, 3, 4, 5, 6) GROUP BY 1")
def replayed_writes(spark: SparkSession, d: str) -> DataFrame:
    """Writes whose repetition leaves a second side effect."""
    of = lambda i: F.element_at(F.array(*(F.lit(w[i]) for w in _WRITES)), (F.col("p_partkey") % 7 + 1).cast("int"))
    return V.read(spark, d, "part").filter(P.replay_sensitive(of(0), of(1), of(2))).groupBy("p_brand").agg(F.count("*").alias("n"))
