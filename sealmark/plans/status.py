"""Reports on tasks and claims, exports against sources, owners of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sealmark import views as V
from sealmark.functions.hashing import joined
from sealmark.functions.when import exit_name, gate
from sealmark.operators import export, joins, payloads, signatures, similar, state
from sealmark.operators.aggregates import distinct_states
from sealmark.plans.claims import _AGE, _STATE, with_state
from sealmark.plans.registry import query

_DONE = "('ANSWERED', 'RISK_ACCEPTED', 'RETRACTED')"


@query(_STATE + f""", w_v AS (SELECT *, count(*) FILTER (state NOT IN {_DONE}) OVER (PARTITION BY task_id, kind) AS same, {_AGE} AS age FROM state_v),
 f_v AS (SELECT claim_id, count(DISTINCT (subject_digest, checker_sha, worktree)) AS states FROM attempt_v WHERE exit_code NOT IN (0, 4) GROUP BY 1),
 y_v AS (SELECT w.*, w.state NOT IN {_DONE} AS waits, kind IN ('1-URGENT', '2-HIGH') AS ship, same > 2 OR age > 900 OR coalesce(f.states, 0) > 3 AS why FROM w_v w LEFT JOIN f_v f ON f.claim_id = w.id)
 SELECT task_id, id, state, waits AND (ship OR why) AS blocks, waits AND NOT ship AS reports FROM y_v""")
def task_reports(spark: SparkSession, d: str) -> DataFrame:
    """Every claim of every task with its state, whether it blocks the task and whether it is only reported."""
    rows = with_state(spark, d)
    waits = ~F.col("state").isin("ANSWERED", "RISK_ACCEPTED", "RETRACTED")
    rows = rows.withColumn("same", F.count_if(waits).over(Window.partitionBy("task_id", "kind")))
    rows = rows.join(distinct_states(V.attempt(spark, d), [0, 4]).select(F.col("claim_id").alias("id"), "states"), "id", "left")
    age = F.datediff(F.lit("2000-01-01").cast("date"), "created_at")
    why = state.escalates(F.col("same"), age, F.coalesce("states", F.lit(0)), F.lit(2), F.lit(900), F.lit(3))
    own = gate(F.when(~F.col("kind").isin("1-URGENT", "2-HIGH"), "report"))
    return state.task_report(rows, own, why).select("task_id", "id", "state", "blocks", "reports")


@query(_STATE + "SELECT s.id, s.task_id, s.state, a.attempts, a.last, CASE a.code WHEN 0 THEN '0 PASS' WHEN 1 THEN '1 FAIL' WHEN 4 THEN '4 UNSUPPORTED' END AS exit, a.duration_ms, a.output FROM state_v s LEFT JOIN (SELECT claim_id, count(*) AS attempts, max(id) AS last, arg_max(exit_code, id) AS code, arg_max(duration_ms, id) AS duration_ms, arg_max(worktree, id) FILTER (exit_code <> 0) AS output FROM attempt_v GROUP BY 1) a ON a.claim_id = s.id")
def status_view(spark: SparkSession, d: str) -> DataFrame:
    """The state of every claim with the newest attempt's detail and the newest output of one that did not pass."""
    a = V.attempt(spark, d).groupBy(F.col("claim_id").alias("id")).agg(
        F.count("*").alias("attempts"), F.max_by(F.struct("id", "exit_code", "duration_ms"), "id").alias("n"),
        F.max_by(F.when(F.col("exit_code") != 0, F.col("worktree")), F.when(F.col("exit_code") != 0, F.col("id"))).alias("output"),
    )
    rows = with_state(spark, d).select("id", "task_id", "state").join(a, "id", "left")
    return rows.select("id", "task_id", "state", "attempts", F.col("n.id").alias("last"), exit_name(F.col("n.exit_code")).alias("exit"), "n.duration_ms", "output")


@query(_STATE + ", g_v AS (SELECT DISTINCT id FROM event_v WHERE kind = 'error' AND k < 20) SELECT e.id, CASE WHEN g.id IS NOT NULL THEN 'RETRACTED' ELSE coalesce(s.state, '') END AS state FROM event_v e LEFT JOIN g_v g ON g.id = e.id LEFT JOIN state_v s ON s.id = e.id")
def carried_states(spark: SparkSession, d: str) -> DataFrame:
    """Claims that events name, for a report on history: some are retracted by an event alone, of some nothing is left."""
    e = V.event(spark, d)
    gone = e.filter("kind = 'error' AND k < 20").select("id", F.lit(True).alias("gone")).distinct()
    rows = e.select("id").join(gone, "id", "left").join(with_state(spark, d).select("id", "state"), "id", "left")
    return rows.select("id", state.carried_state(F.coalesce("gone", F.lit(False)), F.col("state")).alias("state"))


@query("WITH f_v AS (SELECT p_brand AS family, count(DISTINCT p_partkey) AS ids FROM part GROUP BY 1), m_v AS (SELECT DISTINCT p_brand AS family, p_type AS kind FROM part WHERE starts_with(p_brand, 'Brand#1')), r_v AS (SELECT DISTINCT p_type AS kind FROM part WHERE p_size > 49 AND p_partkey % 2 = 0), l_v AS (SELECT m.family, list_sort(list(m.kind) FILTER (r.kind IS NOT NULL)) AS answered, list_sort(list(m.kind) FILTER (r.kind IS NULL)) AS missing FROM m_v m LEFT JOIN r_v r ON r.kind = m.kind GROUP BY 1) SELECT f.family, f.ids, l.family IS NOT NULL AS reusable, coalesce(array_to_string(l.answered, ','), '') AS answered, coalesce(array_to_string(l.missing, ','), '') AS missing FROM f_v f LEFT JOIN l_v l ON l.family = f.family")
def family_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Which kinds answer the families of obligations that recur, and which are missing."""
    p = V.read(spark, d, "part")
    families = p.groupBy(F.col("p_brand").alias("family")).agg(F.count_distinct("p_partkey").alias("ids"))
    mapping = p.filter(F.startswith("p_brand", F.lit("Brand#1"))).select(F.col("p_brand").alias("family"), F.col("p_type").alias("kind"))
    out = payloads.obligations(families, mapping, p.filter("p_size > 49 AND p_partkey % 2 = 0").select(F.col("p_type").alias("kind")))
    return out.withColumns({c: F.array_join(c, ",") for c in ("answered", "missing")})


def _written(events: DataFrame, text: str) -> DataFrame:
    """Events with payloads of their own, some of which are broken, lists, or missing. ``text`` is what a good one says, in SQL."""
    odd = "CASE WHEN id % 11 = 3 THEN '{broken' WHEN id % 13 = 4 THEN NULL WHEN id % 17 = 5 THEN '[1]' WHEN id % 19 = 6 THEN '' ELSE "
    return events.withColumn("payload", F.expr(f"{odd}{text} END"))


_ODD = "CASE WHEN id % 11 = 3 THEN '{{broken' WHEN id % 13 = 4 THEN NULL WHEN id % 17 = 5 THEN '[1]' WHEN id % 19 = 6 THEN '' ELSE {} END"
_QUOTE = """concat('{"quote":"q', k % 9, '","why":"', kind, ' ', task_id, '"', CASE WHEN k % 4 = 0 THEN ',"more":[1,{}]' ELSE '' END, '}')"""
_GROUP = """concat('{"name":"g', k % 7, '"', CASE WHEN k % 5 = 0 THEN '' ELSE concat(',"claims":["c', id % 50, '","c', id % 30, '"]') END, ',"why":', CASE WHEN k % 6 = 0 THEN 'null' ELSE '"so"' END, '}')"""
_READ = "CASE WHEN json_valid(p) AND json_type(p) = 'OBJECT' THEN p END"


@query(f"WITH w_v AS (SELECT id, task_id, {_ODD.format(_QUOTE.replace('{}', '{{}}')).replace('{{', '{').replace('}}', '}')} AS p FROM event_v WHERE kind = 'error'), r_v AS (SELECT id, task_id, {_READ} AS p FROM w_v) SELECT id, task_id, p ->> '$.quote' AS quote, p ->> '$.why' AS why FROM r_v WHERE p IS NOT NULL")
def withdrawals(spark: SparkSession, d: str) -> DataFrame:
    """Cancelled entries, read from their payloads; those that cannot be read are left out."""
    return payloads.withdrawals(_written(V.event(spark, d).filter("kind = 'error'"), _QUOTE))


_GROUPS = f"w_v AS (SELECT id, {_ODD.format(_GROUP).replace('{{', '{').replace('}}', '}')} AS q FROM event_v WHERE kind = 'signup'), v_v AS (SELECT id, CASE WHEN coalesce(q, '') = '' THEN '{{}}' ELSE q END AS p FROM w_v), r_v AS (SELECT id, {_READ} AS p FROM v_v), g_v AS (SELECT id, coalesce(p ->> '$.name', '') AS name, coalesce(CAST(p -> '$.claims' AS VARCHAR[]), []) AS claims, coalesce(p ->> '$.why', '') AS why FROM r_v WHERE p IS NOT NULL)"


@query(f"WITH {_GROUPS} SELECT id, name, array_to_string(claims, ',') AS claims, why FROM g_v")
def groupings(spark: SparkSession, d: str) -> DataFrame:
    """Groupings of claims, read from their payloads; a missing payload is a grouping of nothing, a broken one none."""
    return payloads.groupings(_written(V.event(spark, d).filter("kind = 'signup'"), _GROUP)).withColumn("claims", F.array_join("claims", ","))


@query(f"WITH {_GROUPS} SELECT claim, arg_max(name, id) AS name FROM (SELECT id, name, unnest(claims) AS claim FROM g_v) GROUP BY 1")
def groups_of_claims(spark: SparkSession, d: str) -> DataFrame:
    """The latest grouping that each claim is in."""
    return payloads.group_of(payloads.groupings(_written(V.event(spark, d).filter("kind = 'signup'"), _GROUP)))


@query("SELECT c.id, sha256(concat_ws(chr(31), kind, CAST(c.task_id AS VARCHAR), coalesce(r.refs, ''), origin)) AS digest FROM claim_v c LEFT JOIN (SELECT claim_id, list_aggregate(list_sort(list(DISTINCT CAST(subject_digest AS VARCHAR))), 'string_agg', ',') AS refs FROM attempt_v GROUP BY 1) r ON r.claim_id = c.id")
def claim_digests(spark: SparkSession, d: str) -> DataFrame:
    """What a claim asks: kind, checker, subjects and detector as one digest."""
    refs = V.attempt(spark, d).groupBy(F.col("claim_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_set(F.col("subject_digest").cast("string"))), ",").alias("refs"))
    return V.claim(spark, d).join(refs, "id", "left").select("id", F.sha2(joined(F.col("kind"), F.col("task_id"), F.col("refs"), F.col("origin")), 256).alias("digest"))


_SPANS = "s_v AS (SELECT subject_digest AS path, claim_id * 10 + id // 1000000000000 % 10 AS name, day AS a, day + 3 * (1 + checker_sha % 40) AS b FROM attempt_v), l_v AS (SELECT DISTINCT subject_digest AS path, day + 2 AS line FROM attempt_v)"


@query(f"WITH {_SPANS} SELECT path, line, name FROM (SELECT l.path, l.line, s.name, row_number() OVER (PARTITION BY l.path, l.line ORDER BY s.a DESC, s.b, s.name) AS n FROM l_v l JOIN s_v s ON s.path = l.path AND l.line BETWEEN s.a AND s.b) WHERE n = 1")
def owners_of_lines(spark: SparkSession, d: str) -> DataFrame:
    """The innermost span of a file around each line; lines in no span are left out."""
    a = V.attempt(spark, d)
    spans = a.select(F.col("subject_digest").alias("path"), F.expr("claim_id * 10 + id DIV 1000000000000 % 10").alias("name"), F.col("day").alias("first"), (F.col("day") + 3 * (1 + F.col("checker_sha") % 40)).alias("last"))
    lines = a.select(F.col("subject_digest").alias("path"), (F.col("day") + 2).alias("line")).distinct()
    return joins.enclosing(lines, spans)


_ENTRIES = """n_v AS (SELECT id, replace(replace(path, '.py', ''), '/', '.') AS name, split_part(path, '/', 3) AS line FROM path_v),
 f_v AS (SELECT '.' || regexp_extract(name, '[^.]+$') AS pattern, 'symbol' AS match FROM n_v WHERE id % 40 = 0 UNION SELECT regexp_extract(name, '[^.]+[.][^.]+$'), 'symbol' FROM n_v WHERE id % 40 = 1 UNION SELECT regexp_extract(line, '[^_]+$'), 'symbol' FROM n_v WHERE id % 40 = 2
 UNION SELECT '^' || substr(line, 1, 5) || '[a-m]', 'regex' FROM n_v WHERE id % 97 = 0 UNION SELECT regexp_extract(line, '^[^_]+') || '_.*' || id || '$', 'regex' FROM n_v WHERE id % 89 = 0)"""


@query(f"WITH {_ENTRIES} SELECT n.id, f.match, f.pattern FROM n_v n JOIN f_v f ON f.match = 'symbol' AND ((NOT starts_with(f.pattern, '.') AND (n.name = f.pattern OR ends_with(n.name, '.' || f.pattern))) OR (starts_with(f.pattern, '.') AND contains(n.name, '.') AND ends_with('.' || n.name, f.pattern))) UNION ALL SELECT n.id, f.match, f.pattern FROM n_v n JOIN f_v f ON f.match = 'regex' AND regexp_matches(n.line, f.pattern)")
def facts_hits(spark: SparkSession, d: str) -> DataFrame:
    """Names against symbols and lines against expressions of a vocabulary that is a table and grows with it."""
    p = V.path(spark, d)
    rows = p.select("id", F.replace(F.replace(F.col("path"), F.lit(".py"), F.lit("")), F.lit("/"), F.lit(".")).alias("name"), F.split("path", "/")[2].alias("line"))
    of = lambda n, kind, pattern, rest=0: rows.filter(f"id % {n} = {rest}").select(pattern.alias("pattern"), F.lit(kind).alias("match"))
    end = lambda e, c="name": F.regexp_extract(c, e, 0)
    facts = of(40, "symbol", F.concat(F.lit("."), end("[^.]+$"))).union(of(40, "symbol", end("[^.]+[.][^.]+$"), 1)).union(of(40, "symbol", end("[^_]+$", "line"), 2))
    facts = facts.union(of(97, "regex", F.concat(F.lit("^"), F.left("line", F.lit(5)), F.lit("[a-m]")))).union(of(89, "regex", F.concat(end("^[^_]+", "line"), F.lit("_.*"), F.col("id"), F.lit("$"))))
    return similar.vocabulary_hits(rows, facts)


_OUT = "x_v AS (SELECT id, kind, CASE WHEN id % 13 = 0 THEN '[REDACTED]' ELSE kind END AS shown FROM event_v)"


@query(f"WITH {_OUT} SELECT id, 'part' || (id // 1000) AS file, sha256(kind) AS source_hash, sha256(shown) AS projection_hash FROM x_v WHERE shown <> kind")
def export_projection(spark: SparkSession, d: str) -> DataFrame:
    """The sidecar of an export: for each row that shows less than its source, the digests of both."""
    e = V.event(spark, d).select("id", "kind")
    out = e.select("id", F.concat(F.lit("part"), F.floor(F.col("id") / 1000).cast("string")).alias("file"), F.when(F.col("id") % 13 == 0, "[REDACTED]").otherwise(F.col("kind")).alias("shown"))
    return export.projection(out, e.select("id", F.col("kind").alias("source")), "id", "shown", "source")


@query("SELECT id, CASE WHEN k % 5 = 0 THEN 'duplicate field' WHEN k % 7 = 0 THEN 'not a digest' WHEN id // 1000 = 1 THEN 'unknown file' END AS fault FROM event_v WHERE k % 5 = 0 OR k % 7 = 0 OR id // 1000 = 1")
def projection_faults(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a sidecar that a reader refuses: a repeated field, no hex digest, a file that the export does not have."""
    e = V.event(spark, d)
    number = F.floor(F.col("id") / 1000).cast("string")
    digest = F.when(F.col("k") % 7 == 0, "zz").otherwise(F.sha2("kind", 256))
    record = F.concat(F.lit('{"id":'), F.col("id").cast("string"), F.lit(',"file":"part'), number, F.lit('","hash":"'), digest, F.lit('"'), F.when(F.col("k") % 5 == 0, ',"id":1').otherwise(""), F.lit("}"))
    files = e.select(F.concat(F.lit("part"), number).alias("file")).distinct().filter("file != 'part1'")
    return export.faults(e.select("id", record.alias("record")), files, "id")


_RECORD = """CASE WHEN r % 13 = 1 THEN NULL WHEN r % 13 = 2 THEN '{broken' WHEN r % 13 = 3 THEN '[1]' ELSE concat('{"claim":"', claim_id, '","kind":"', kind, '","why":"', CASE WHEN r % 13 = 5 THEN 'other' ELSE why END, '","scope":"task","stdin_was_a_tty":', CASE WHEN was_tty = 1 THEN 'true' ELSE 'false' END, CASE WHEN r % 13 = 4 THEN '' ELSE concat(',"signed_by":"', signed_by, '"') END, ',"covers":', CASE WHEN r % 13 = 6 THEN '{"b":1,"a":[2]}' ELSE 'null' END, '}') END"""


@query("""WITH s_v AS (SELECT claim_id AS id, CAST(claim_id AS VARCHAR) AS claim_id, claim_id // 40 AS r, signed_by FROM risk_v), x_v AS (SELECT *, CASE WHEN id % 23 = 1 THEN '' WHEN id % 23 = 2 THEN '../' || r || '.json' ELSE 'risks/' || r || '.json' END AS p FROM s_v),
 n_v AS (SELECT * FROM x_v WHERE p = '' OR id IN (SELECT max(id) FROM x_v WHERE p <> '' GROUP BY p)), m_v AS (SELECT r, max(id) AS made, arg_max(signed_by, id) AS signer FROM s_v GROUP BY 1)
 SELECT p AS path, claim_id, unnest(CASE WHEN p = '' THEN ['names no record'] WHEN starts_with(p, '../') THEN ['invalid path'] WHEN n.r % 13 = 0 THEN ['record on no branch'] WHEN n.r % 13 = 1 THEN ['does not read'] WHEN n.r % 13 = 2 THEN ['invalid JSON'] WHEN n.r % 13 = 3 THEN ['malformed record']
  ELSE list_filter([CASE WHEN m.made <> n.id THEN 'disagree about claim' END, CASE WHEN n.r % 13 = 5 THEN 'disagree about why' WHEN m.made % 7 <> n.id % 7 THEN 'disagree about why' END, CASE WHEN n.r % 13 = 4 THEN CASE WHEN n.signed_by <> '' THEN 'omits signed_by' END WHEN n.signed_by <> '' AND m.signer <> n.signed_by THEN 'disagree about signed_by' END, CASE WHEN n.r % 13 = 6 THEN 'carries covers, the row none' END, CASE WHEN n.r % 13 = 7 THEN 'not tracked' END], lambda x: x IS NOT NULL) END) AS problem
 FROM n_v n JOIN m_v m ON m.r = n.r
 UNION ALL SELECT 'risks/' || r || '.json', NULL, 'no row made it' FROM m_v WHERE r % 13 NOT IN (0, 8) AND 'risks/' || r || '.json' NOT IN (SELECT p FROM x_v)""")
def reconciled_signatures(spark: SparkSession, d: str) -> DataFrame:
    """Signatures against the records that the newest of each wrote, with every fault that either side may have."""
    i = F.col("claim_id")
    r = F.floor(i / 40)
    rows = V.risk(spark, d).select(i.alias("id"), i.cast("string").alias("claim_id"), r.alias("r"), F.lit("k").alias("kind"), F.concat(F.lit("w"), i % 7).alias("why"), F.lit("task").alias("scope"), F.lit("p").alias("who"), F.lit(1).alias("was_tty"), "signed_by", F.lit("").alias("cover_key"))
    path = F.concat(F.lit("risks/"), F.col("r"), F.lit(".json"))
    made = rows.groupBy("r").agg(F.max_by(F.struct("claim_id", "kind", "why", "was_tty", "signed_by"), "id").alias("n")).select("r", "n.*")
    records = made.filter("r % 13 != 0").select(path.alias("path"), F.expr(_RECORD).alias("content"), F.when(F.col("r") % 13 == 8, "c0ffee").otherwise("disk").alias("place"), (F.col("r") % 13 != 7).alias("tracked"))
    named = rows.withColumn("git_record", F.when(F.col("id") % 23 == 1, "").when(F.col("id") % 23 == 2, F.concat(F.lit("../"), F.col("r"), F.lit(".json"))).otherwise(path))
    return signatures.reconciled(named, records)


_GLOBS = """concat('{"task":', task_id, CASE WHEN k % 10 = 0 THEN '' ELSE concat(',"globs":["g', k % 12, '/**","x', k % 5, '"]') END, '}')"""


@query(f"WITH w_v AS (SELECT id, task_id, {_GLOBS} AS p FROM event_v WHERE kind = 'error') SELECT task_id, \"glob\", min(id) AS since FROM (SELECT task_id, id, unnest(coalesce(CAST(CAST(p AS JSON) -> '$.globs' AS VARCHAR[]), [])) AS \"glob\" FROM w_v) GROUP BY 1, 2")
def forbidden_globs(spark: SparkSession, d: str) -> DataFrame:
    """The globs that events forbid a task, read from their payloads, each with the first event that did."""
    return payloads.forbidden(V.event(spark, d).filter("kind = 'error'").withColumn("payload", F.expr(_GLOBS)))


_ROUND = """concat('{"label":"r', k, '","acceptance_sha":"s', k % 4, '"}')"""


@query(f"""WITH e_v AS (SELECT task_id, arg_max(kind, id) AS kind, arg_max({_ROUND}, id) AS p FROM event_v WHERE kind IN ('view', 'click') GROUP BY 1), r_v AS (SELECT task_id, CAST(p AS JSON) ->> '$.label' AS label, CAST(p AS JSON) ->> '$.acceptance_sha' AS frozen FROM e_v WHERE kind = 'view')
 SELECT t.id AS task_id, r.label, CASE WHEN r.label IS NULL THEN 'no round' WHEN r.frozen = 's' || (t.id % 4) THEN 'unmoved' ELSE 'moved' END AS verdict FROM task_v t LEFT JOIN r_v r ON r.task_id = t.id""")
def moved_rulers(spark: SparkSession, d: str) -> DataFrame:
    """The criteria that the open round of a task froze, against what they are now; a closed round, or none, asks for nothing."""
    rounds = payloads.current_round(V.event(spark, d).withColumn("payload", F.expr(_ROUND)), "task_id", "view", "click")
    now = V.task(spark, d).select(F.col("id").alias("task_id"), F.concat(F.lit("s"), (F.col("id") % 4).cast("string")).alias("sha"))
    return payloads.rulers(rounds, now, "task_id")


_FILE = """CASE WHEN b % 7 = 0 THEN NULL WHEN b % 7 = 1 THEN '{broken' WHEN b % 7 = 2 THEN concat('[', ids, ']') WHEN b % 7 = 3 THEN concat('{"accepted":[', ids, '],"findings":7}') WHEN b % 7 = 4 THEN concat('{"findings":[', objects, ']}') WHEN b % 7 = 5 THEN concat('[', ids, ',7]') ELSE '{"other":[]}' END"""
_BASE = """p_v AS (SELECT p_brand AS kind, CAST(replace(p_brand, 'Brand#', '') AS INT) AS b, p_partkey AS i, p_size AS size FROM part), t_v AS (SELECT kind, b, string_agg('"' || i || '"', ',') AS ids, string_agg('{"id":"' || i || '","note":1}', ',') AS objects FROM p_v WHERE size < 20 GROUP BY 1, 2)"""


@query(f"""WITH {_BASE}, f_v AS (SELECT kind, {_FILE} AS p FROM t_v), u_v AS (SELECT DISTINCT kind FROM p_v WHERE b % 7 IN (1, 5, 6) AND size < 20), b_v AS (SELECT kind, CAST(i AS VARCHAR) AS id FROM p_v WHERE size < 20 AND b % 7 IN (2, 3, 4)), n_v AS (SELECT kind, CAST(i AS VARCHAR) AS id FROM p_v WHERE size > 10)
 SELECT kind, id, CASE WHEN kind IN (SELECT kind FROM u_v) THEN 'unknown' WHEN b IS NULL THEN 'new' WHEN n IS NULL THEN 'stale' ELSE 'carried' END AS side FROM (SELECT coalesce(n.kind, b.kind) AS kind, coalesce(n.id, b.id) AS id, n.id AS n, b.id AS b FROM n_v n FULL JOIN b_v b ON b.kind = n.kind AND b.id = n.id)""")
def forgiven_findings(spark: SparkSession, d: str) -> DataFrame:
    """Findings against the baseline file of their kind, of either shape, where a file that is not there is not one that cannot be read."""
    p = V.read(spark, d, "part").select(F.col("p_brand").alias("kind"), F.replace("p_brand", F.lit("Brand#"), F.lit("")).cast("int").alias("b"), F.col("p_partkey").cast("string").alias("i"), F.col("p_size").alias("size"))
    join = lambda x: F.array_join(F.collect_list(x), ",")
    texts = p.filter("size < 20").groupBy("kind", "b").agg(join(F.concat(F.lit('"'), "i", F.lit('"'))).alias("ids"), join(F.concat(F.lit('{"id":"'), "i", F.lit('","note":1}'))).alias("objects"))
    return payloads.forgiven(p.filter("size > 10").select("kind", F.col("i").alias("id")), texts.select("kind", F.expr(_FILE).alias("content")))
