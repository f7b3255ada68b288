"""Reviews, registries, exports against sources, and counts that texts state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sealmark import views as V
from sealmark.operators import reviews as R
from sealmark.operators import verdicts
from sealmark.plans.claims import _STATE, with_state
from sealmark.plans.registry import query


@query("WITH s_v AS (SELECT task_id, list(DISTINCT k % 4) FILTER (kind = 'view') AS reviewed, list(DISTINCT k % 4) FILTER (kind = 'error' AND k > 70) AS inconclusive, min(k) FILTER (kind = 'view') AS least FROM event_v GROUP BY 1) SELECT task_id, coalesce(list_has_all(list_concat(coalesce(reviewed, []), coalesce(inconclusive, [])), [0, 1, 2, 3]) AND coalesce(least, 2) >= 2, false) AS complete FROM s_v")
def complete_sweeps(spark: SparkSession, d: str) -> DataFrame:
    """A sweep is a task's events: views review a lens (their number less two is the count), some errors are inconclusive."""
    lens = F.col("k") % 4
    e = V.event(spark, d)
    seen = e.groupBy("task_id", lens.alias("lens")).agg(F.min(F.when(F.col("kind") == "view", F.col("k") - 2)).alias("n"), F.max(F.when((F.col("kind") == "error") & (F.col("k") > 70), 1)).alias("i"))
    maps = lambda c: F.map_from_entries(F.filter(F.collect_list(F.struct("lens", c)), lambda x: x[c].isNotNull()))
    own = seen.groupBy("task_id").agg(maps("n").alias("reviewed"), maps("i").alias("inconclusive"))
    expected = F.array(*(F.lit(i).cast("long") for i in range(4)))
    return own.select("task_id", R.complete(expected, F.col("reviewed"), F.col("inconclusive")).alias("complete"))


@query("SELECT id, k = task_id % 100 OR length(coalesce(CASE WHEN kind = 'view' THEN NULL ELSE kind || kind END, '')) >= 10 AS fine FROM event_v")
def reconciled_counts(spark: SparkSession, d: str) -> DataFrame:
    note = F.when(F.col("kind") != "view", F.concat("kind", "kind"))
    return V.event(spark, d).select("id", R.reconciled(F.col("k"), F.col("task_id") % 100, note, 10).alias("fine"))


@query("WITH c_v AS (SELECT DISTINCT p_size AS risk_class FROM part), k_v AS (SELECT DISTINCT p_size * 3 AS risk_class, p_brand AS kind, p_type LIKE '%3%' OR p_size % 4 = 1 AS judged FROM part) SELECT c.risk_class, CASE WHEN count(*) FILTER (NOT k.judged) > 0 THEN 'OK' WHEN count(k.kind) > 0 THEN 'half' ELSE '--' END AS mark FROM c_v c LEFT JOIN k_v k ON k.risk_class = c.risk_class GROUP BY 1")
def risk_coverage(spark: SparkSession, d: str) -> DataFrame:
    p = V.read(spark, d, "part")
    kinds = p.select((F.col("p_size") * 3).alias("risk_class"), F.col("p_brand").alias("kind"), (F.col("p_type").contains("3") | (F.col("p_size") % 4 == 1)).alias("judged")).distinct()
    return R.coverage(p.select(F.col("p_size").alias("risk_class")).distinct(), kinds)


_T = "list_distinct(regexp_extract_all(lower({}), '([a-z_][a-z0-9_]*|[一-鿿])', 1))"


_SAID = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
_FIVE = f"""CASE WHEN {_SAID.format('text')} = '' THEN 'empty' WHEN length({_SAID.format('text')}) < 60 THEN 'short' WHEN NOT list_has_any({_T.format('text')}, ['the', 'der', 'que', 'les']) THEN 'off subject'
 WHEN len(list_intersect({_T.format('text')}, ['the', 'of', 'and', 'that'])) = 4 THEN 'recited' END"""


@query(f"SELECT conv_id, turn, {_FIVE} AS refusal FROM conversations WHERE role = 'user'")
def judged_sentences(spark: SparkSession, d: str) -> DataFrame:
    rows = V.read(spark, d, "conversations").filter("role = 'user'")
    refusal = R.judged(F.col("text"), F.lit("the/der.que les of"), F.array(F.lit("the of and that")), 60)
    return rows.select("conv_id", "turn", refusal.alias("refusal"))


@query(f"""WITH u_v AS (SELECT conv_id, turn, text, (conv_id + turn) % 3 AS about FROM conversations WHERE role = 'user'), q_v AS (SELECT min(text) AS template FROM u_v),
 n_v AS MATERIALIZED (SELECT *, {_T.format('text')} AS ts FROM u_v), h_v AS MATERIALIZED (SELECT DISTINCT {_T.format("text || ' once more'")} AS ts, conv_id % 3 AS about FROM u_v WHERE conv_id % 4 = 0),
 r_v AS (SELECT DISTINCT n.conv_id, n.turn FROM n_v n JOIN h_v h ON h.about <> n.about AND len(h.ts) * 0.8 <= len(n.ts) AND len(n.ts) * 0.8 <= len(h.ts) WHERE len(n.ts) > 0 AND len(list_intersect(n.ts, h.ts)) / len(list_distinct(list_concat(n.ts, h.ts))) > 0.8)
 SELECT u.conv_id, u.turn, coalesce(CASE WHEN {_SAID.format('u.text')} = {_SAID.format('q.template')} THEN 'restated' END, {_FIVE}, CASE WHEN r.conv_id IS NOT NULL THEN 'repeated' END) AS refusal
 FROM u_v u CROSS JOIN q_v q LEFT JOIN r_v r ON r.conv_id = u.conv_id AND r.turn = u.turn""")
def judged_over_history(spark: SparkSession, d: str) -> DataFrame:
    """All seven reasons to refuse a sentence; those accepted before are every fourth conversation's, with two words more."""
    u = V.read(spark, d, "conversations").filter("role = 'user'")
    rows = u.crossJoin(u.agg(F.min("text").alias("template"))).select("conv_id", "turn", F.col("text").alias("sentence"), "template", F.lit("the/der.que les of").alias("subject"), ((F.col("conv_id") + F.col("turn")) % 3).alias("about"))
    history = u.filter("conv_id % 4 = 0").select(F.concat("text", F.lit(" once more")).alias("sentence"), (F.col("conv_id") % 3).alias("about"))
    return R.judged_over_history(rows, history, F.array(F.lit("the of and that")), 60, 0.8).select("conv_id", "turn", "refusal")


@query("WITH c_v AS (SELECT k AS pattern, min(id) AS line FROM event_v WHERE kind = 'view' GROUP BY 1), h_v AS (SELECT k AS pattern, id AS line FROM event_v WHERE (kind = 'view' AND k % 4 <> 1) OR (kind = 'click' AND k % 4 = 1)), f_v AS (SELECT pattern, count(*) AS n, min(line) AS only FROM h_v GROUP BY 1) SELECT c.pattern, CASE WHEN f.n IS NULL THEN 'gone' WHEN h.line IS NOT NULL THEN 'holds' WHEN f.n = 1 THEN 'moved' ELSE 'ambiguous' END AS verdict, CASE WHEN h.line IS NOT NULL THEN c.line WHEN f.n = 1 THEN f.only END AS line FROM c_v c LEFT JOIN f_v f ON f.pattern = c.pattern LEFT JOIN h_v h ON h.pattern = c.pattern AND h.line = c.line")
def restated_citations(spark: SparkSession, d: str) -> DataFrame:
    e = V.event(spark, d).select("k", "id", "kind")
    cited = e.filter("kind = 'view'").groupBy(F.col("k").alias("pattern")).agg(F.min("id").alias("line"))
    hits = e.filter("(kind = 'view' AND k % 4 != 1) OR (kind = 'click' AND k % 4 = 1)").select(F.col("k").alias("pattern"), F.col("id").alias("line"))
    return R.restated(cited, hits)


@query("SELECT a.id, a.kind AS exported, b.kind AS original FROM (SELECT id, CASE WHEN id % 13 = 0 THEN '[REDACTED]' ELSE kind END AS kind FROM event_v) a JOIN event_v b ON b.id = a.id WHERE a.kind <> b.kind")
def redacted_in_export(spark: SparkSession, d: str) -> DataFrame:
    """Exported rows that differ from their source."""
    e = V.event(spark, d).select("id", "kind")
    out = e.select("id", F.when(F.col("id") % 13 == 0, "[REDACTED]").otherwise(F.col("kind")).alias("exported"))
    return out.join(e.withColumnRenamed("kind", "original"), "id").filter("exported != original")


@query(_STATE + ", f_v AS (SELECT k * 100 AS id, max(id) AS target FROM event_v WHERE kind = 'signup' GROUP BY 1) SELECT s.id, s.state, f.target, f.id IS NOT NULL AND s.state NOT IN ('ANSWERED', 'RISK_ACCEPTED', 'RETRACTED') AS deferred FROM state_v s LEFT JOIN f_v f ON f.id = s.id")
def claims_enriched(spark: SparkSession, d: str) -> DataFrame:
    target = V.event(spark, d).filter("kind = 'signup'").groupBy((F.col("k") * 100).alias("id")).agg(F.max("id").alias("target"))
    out = with_state(spark, d).select("id", "state").join(target, "id", "left")
    return out.withColumn("deferred", F.col("target").isNotNull() & ~F.col("state").isin("ANSWERED", "RISK_ACCEPTED", "RETRACTED"))


@query(_STATE + "SELECT id, substring(sha256(concat_ws(chr(31), CAST(id AS VARCHAR), state, kind)), 1, 16) AS revision FROM state_v WHERE state NOT IN ('ANSWERED', 'RISK_ACCEPTED', 'RETRACTED')")
def attention_revisions(spark: SparkSession, d: str) -> DataFrame:
    """What waits, with a revision that changes when its state does."""
    from sealmark.functions.hashing import short_id
    from sealmark.operators.state import waiting

    return waiting(with_state(spark, d)).select("id", short_id(F.col("id"), F.col("state"), F.col("kind")).alias("revision"))


@query("SELECT l_orderkey AS claim_id, count(DISTINCT l_partkey) AS files, count(DISTINCT l_partkey) FILTER (l_returnflag = 'A') AS reached, count(DISTINCT l_partkey) FILTER (l_returnflag = 'A') * 100.0 / count(DISTINCT l_partkey) > 50 AS over FROM lineitem GROUP BY 1")
def widen_usage(spark: SparkSession, d: str) -> DataFrame:
    part = F.col("l_partkey")
    out = V.read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("claim_id")).agg(F.count_distinct(part).alias("files"), F.count_distinct(F.when(F.col("l_returnflag") == "A", part)).alias("reached"))
    return out.withColumn("over", F.col("reached") * 100.0 / F.col("files") > 50)


@query("SELECT k AS detector, arg_max(value, id) > 20 AS could_read, arg_max(task_id, id) AS claims FROM event_v WHERE kind = 'view' GROUP BY 1 HAVING arg_max(task_id, id) % 3 = 0 AND NOT arg_max(value, id) > 20")
def detectors_that_saw_nothing(spark: SparkSession, d: str) -> DataFrame:
    last = V.event(spark, d).filter("kind = 'view'").groupBy(F.col("k").alias("detector")).agg(F.max_by(F.struct("value", "task_id"), "id").alias("r"))
    return last.select("detector", (F.col("r.value") > 20).alias("could_read"), F.col("r.task_id").alias("claims")).filter("claims % 3 = 0 AND NOT could_read")


@query("""WITH a_v AS (SELECT claim_id, id, CASE WHEN exit_code = 4 THEN 127 ELSE exit_code END AS g, CASE WHEN day % 5 = 0 THEN NULL WHEN day % 5 = 1 THEN 126 ELSE day % 2 END AS r, CASE WHEN day % 7 = 0 THEN NULL ELSE day % 7 <> 1 END AS x, day % 3 = 0 AS m, day % 11 <> 0 AS rx FROM attempt_v),
 v_v AS (SELECT *, g = 0 AS green, CASE WHEN r IS NOT NULL THEN r NOT IN (126, 127) AND r <> 0 AND NOT (m AND NOT rx) END AS red FROM a_v)
 SELECT claim_id, id, green, red, green AND red AND x AS verdict, array_to_string(list_filter([CASE WHEN g = 127 THEN 'could not run' WHEN g <> 0 THEN 'does not pass' END, CASE WHEN x IS NULL THEN 'execution not observed' WHEN NOT x THEN 'target never executed' END,
  CASE WHEN r IS NULL THEN 'no older tree' WHEN r = 126 THEN 'could not run before' WHEN r <> 0 AND m AND NOT rx THEN 'failed before the target was entered' WHEN r = 0 AND m THEN 'does not notice the mutation' WHEN r = 0 THEN 'passed before' END], lambda n: n IS NOT NULL), '; ') AS notes FROM v_v""")
def red_green_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Whether tests pass now, failed before and ran what they are about; what was not observed is unknown."""
    day = F.col("day")
    runs = V.attempt(spark, d).select("claim_id", "id", F.when(F.col("exit_code") == 4, 127).otherwise(F.col("exit_code")).alias("green_exit"), F.when(day % 5 == 1, 126).when(day % 5 != 0, day % 2).alias("red_exit"), F.when(day % 7 != 0, day % 7 != 1).alias("executed"), (day % 11 != 0).alias("red_executed"), (day % 3 == 0).alias("mutated"))
    return verdicts.red_green(runs).select("claim_id", "id", "green", "red", "verdict", F.array_join("notes", "; ").alias("notes"))


@query("SELECT * FROM (SELECT 'chain' AS audit, count(*) FILTER (id % 977 = 5) AS problems, count(*) FILTER (id % 977 = 5) AS fatal, CAST(count(*) FILTER (id % 977 = 5) > 0 AS INT) AS exit FROM event_v UNION ALL SELECT 'waiting', count(*) FILTER (kind = 'error'), count(*) FILTER (kind = 'error' AND k % 2 = 1), CAST(count(*) FILTER (kind = 'error' AND k % 2 = 1) > 0 AS INT) FROM event_v UNION ALL SELECT 'none', 0, 0, 0 UNION ALL SELECT 'all', count(*) FILTER (id % 977 = 5) + count(*) FILTER (kind = 'error'), count(*) FILTER (id % 977 = 5) + count(*) FILTER (kind = 'error' AND k % 2 = 1), CAST(count(*) FILTER (id % 977 = 5) + count(*) FILTER (kind = 'error' AND k % 2 = 1) > 0 AS INT) FROM event_v)")
def audits_with_worst(spark: SparkSession, d: str) -> DataFrame:
    """Several audits in one table with the worst of them: a changed chain, findings of which some are only said, and one without any."""
    from sealmark.operators import chain

    e = V.event(spark, d).select("id", "kind", "k")
    built, _ = chain.build_segments(e, ["id", "kind", "k"], "s1")
    walked = chain.walk(built.withColumn("k", F.when(F.col("id") % 977 == 5, F.col("k") + 1).otherwise(F.col("k"))), ["id", "kind", "k"], chain="segment")
    said = e.filter("kind = 'error'").select(F.when(F.col("k") % 2 == 1, "open").otherwise("concurrent append").alias("problem"))
    return verdicts.audit_summary({"chain": walked, "waiting": said, "none": said.limit(0)}, benign=("concurrent append",))


@query("""SELECT c.id, c.kind, CASE c.kind WHEN '1-URGENT' THEN 'block' WHEN '2-HIGH' THEN 'report' WHEN '3-MEDIUM' THEN 'report' ELSE 'none' END AS gate, CASE WHEN c.kind = '1-URGENT' THEN '900' WHEN c.kind = '3-MEDIUM' THEN '{"days":7}' END AS limit_ FROM claim_v c""")
def claims_with_settings(spark: SparkSession, d: str) -> DataFrame:
    """Claims with what a configuration says of their kind."""
    doc = '{"kinds":{"1-URGENT":{"gate":"block","limit_":900},"2-HIGH":{"gate":"report"},"3-MEDIUM":{"gate":"report","limit_":{"days":7}},"4-NOT SPECIFIED":{}},"checkers":{}}'
    rows = verdicts.settings(spark.createDataFrame([("config", doc)], "source string, content string"), "kinds")
    out = verdicts.setting(V.claim(spark, d).select("id", "kind"), rows, "kind", "gate", F.lit("none"))
    return verdicts.setting(out, rows, "kind", "limit_")
