"""Text measures over documents and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sealmark import views as V
from sealmark.functions import hashing as H
from sealmark.functions import text as X
from sealmark.functions import when as W
from sealmark.operators import constraints
from sealmark.plans.registry import query

_TOK = "list_distinct(regexp_extract_all(lower({}), '([a-z_][a-z0-9_]*|[一-鿿])', 1))"


@query(f"SELECT doc_id, len({_TOK.format('text')}) AS tokens FROM documents")
def token_counts(spark: SparkSession, d: str) -> DataFrame:
    return V.read(spark, d, "documents").select("doc_id", F.size(X.tokens(F.col("text"))).cast("long").alias("tokens"))


_PAIR = f"WITH t_v AS (SELECT conv_id, turn, {_TOK.format('text')} AS a, {_TOK.format('lag(text) OVER (PARTITION BY conv_id ORDER BY turn)')} AS b FROM conversations) SELECT conv_id, turn, "


@query(_PAIR + "CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END AS overlap, CASE WHEN len(a) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) / len(a) END AS recited FROM t_v WHERE b IS NOT NULL")
def turn_overlap(spark: SparkSession, d: str) -> DataFrame:
    """How much a turn repeats the turn before it."""
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = V.read(spark, d, "conversations").withColumn("before", before).filter("before IS NOT NULL")
    rows = rows.select("conv_id", "turn", X.tokens(F.col("text")).alias("a"), X.tokens(F.col("before")).alias("b"))
    return rows.select("conv_id", "turn", X.jaccard(F.col("a"), F.col("b")).alias("overlap"), X.containment(F.col("a"), F.col("b")).alias("recited"))


@query("SELECT conv_id, turn, len([c FOR c IN [trim(p) FOR p IN regexp_split_to_array(text, '[.;!?\\n]+|, and |, then ')] IF c <> '']) AS clauses, length(regexp_replace(text, '[\\s[:punct:]]+', '', 'g')) AS weight FROM conversations WHERE role = 'user'")
def request_clauses(spark: SparkSession, d: str) -> DataFrame:
    rows = V.read(spark, d, "conversations").filter("role = 'user'")
    return rows.select("conv_id", "turn", F.size(X.clauses(F.col("text"))).cast("long").alias("clauses"), X.weight(F.col("text")).cast("long").alias("weight"))


@query("SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(text, '(?i)(password|passwd|secret|token|api_?key)(\\s*[:=]\\s*)[\"'']?[A-Za-z0-9+/_.=-]{6,}[\"'']?', '\\1\\2[REDACTED]', 'g'), 'AKIA[A-Z0-9]{16,}', '[REDACTED]', 'g'), '\\b[0-9a-f]{32,}\\b', '[REDACTED]', 'g')) AS digest FROM documents")
def redacted_documents(spark: SparkSession, d: str) -> DataFrame:
    return V.read(spark, d, "documents").select("doc_id", F.sha2(X.redact(F.col("text")), 256).alias("digest"))


@query("SELECT o_orderkey AS id, substring(sha256(concat_ws(chr(31), CAST(o_custkey AS VARCHAR), o_orderpriority, '', o_orderstatus)), 1, 16) AS claim_id, substring(sha256(CAST(o_custkey AS VARCHAR) || chr(0) || o_orderstatus), 1, 16) AS finding_id, sha256(length(o_orderpriority) || ':' || o_orderpriority || length(o_orderstatus) || ':' || o_orderstatus || '0:') AS prefixed FROM orders")
def identities(spark: SparkSession, d: str) -> DataFrame:
    o = V.read(spark, d, "orders")
    null = F.lit(None).cast("string")
    c, p, s = F.col("o_custkey"), F.col("o_orderpriority"), F.col("o_orderstatus")
    return o.select(F.col("o_orderkey").alias("id"), H.short_id(c, p, null, s).alias("claim_id"), H.finding_id(c, s).alias("finding_id"), H.row_hash(p, s, null).alias("prefixed"))


@query("SELECT event_id AS id, isodow(ts) - 1 = 2 AND hour(ts) >= 9 AND (prev IS NULL OR datediff('day', prev, ts) >= 7) AS due FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS prev FROM events)")
def cadence_due(spark: SparkSession, d: str) -> DataFrame:
    """Wednesdays from nine on, a week after the last time at the earliest."""
    e = V.read(spark, d, "events")
    prev = F.lag("ts").over(Window.partitionBy("user_id", "event_type").orderBy("event_id"))
    return e.withColumn("prev", prev).select(F.col("event_id").alias("id"), W.due(F.col("prev"), F.col("ts"), 2, 9, 7).alias("due"))


@query("SELECT p_partkey AS id, list_aggregate([w FOR w IN string_split(trim(regexp_replace(lower(regexp_replace(p_name || 'Of' || p_brand, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+', ' ', 'g')), ' ') IF w <> ''], 'string_agg', ',') AS words FROM part")
def identifier_words(spark: SparkSession, d: str) -> DataFrame:
    p = V.read(spark, d, "part")
    return p.select(F.col("p_partkey").alias("id"), F.array_join(X.word_list(F.concat("p_name", F.lit("Of"), "p_brand")), ",").alias("words"))


@query("SELECT c_custkey AS id, CASE WHEN length(c_name) <= 8 THEN '…' ELSE left(c_name, 4) || '…' || right(c_name, 4) END AS shown, CASE WHEN trim(c_mktsegment) NOT IN ('', 'TODO', 'MACHINERY') THEN trim(c_mktsegment) END AS declared FROM customer")
def shown_tokens(spark: SparkSession, d: str) -> DataFrame:
    c = V.read(spark, d, "customer")
    segment = F.when(F.col("c_mktsegment") == "MACHINERY", " TODO ").otherwise(F.col("c_mktsegment"))
    return c.select(F.col("c_custkey").alias("id"), X.show_token(F.col("c_name"), 4).alias("shown"), X.declared(segment).alias("declared"))


@query("SELECT conv_id, turn, length(text) AS n, (SELECT count(DISTINCT p.i) FROM (SELECT unnest(range(s.i, s.i + length(q.q))) AS i FROM (VALUES ('tion'), ('on'), ('the'), ('ee')) q(q), (SELECT unnest(range(1, length(c.text) + 1)) AS i) s WHERE substring(c.text, s.i, length(q.q)) = q.q) p) AS covered FROM conversations c WHERE role = 'system'")
def quoted_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Characters of system turns that a fixed set of quotes covers."""
    rows = V.read(spark, d, "conversations").filter("role = 'system'")
    quotes = F.array(*map(F.lit, ("tion", "on", "the", "ee")))
    return rows.select("conv_id", "turn", F.length("text").cast("long").alias("n"), X.covered(F.col("text"), quotes).cast("long").alias("covered"))


_PIECES = "string_split(regexp_replace({0}, '([.;!?\\n]+|, and |, then )', '\\1' || chr(1), 'g'), chr(1))"


@query(f"SELECT conv_id, turn, len([c FOR c IN {_PIECES.format('text')} IF contains(c, substring(text, 3, 12))]) = 0 AS crosses FROM conversations WHERE role = 'user' AND length(text) > 20")
def quotes_across_clauses(spark: SparkSession, d: str) -> DataFrame:
    rows = V.read(spark, d, "conversations").filter("role = 'user' AND length(text) > 20")
    return rows.select("conv_id", "turn", X.crosses_clause(F.substring("text", 3, 12), F.col("text")).alias("crosses"))


@query(f"""SELECT conv_id, turn, CASE WHEN q = '' THEN 'no quote' WHEN NOT contains(text, q) THEN 'not quoted' WHEN len([c FOR c IN {_PIECES.format('text')} IF contains(c, q)]) = 0 THEN 'crosses clauses'
 WHEN conv_id % 2 = 0 AND conv_id % 3 = 0 THEN 'silent' WHEN conv_id % 2 = 1 AND turn % 3 = 0 THEN 'names nothing' WHEN conv_id % 2 = 1 AND conv_id % 7 = 0 THEN 'no acceptance' END AS fault
 FROM (SELECT *, CASE conv_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'zzqq' ELSE trim(substring(text, 1 + conv_id % 9, 25)) END AS q FROM conversations WHERE role = 'user' AND text IS NOT NULL) WHERE q <> '' OR conv_id % 5 = 0""")
def entry_faults(spark: SparkSession, d: str) -> DataFrame:
    """Why an entry accounts for no part of a request."""
    c = F.col("conv_id")
    quote = F.when(c % 5 == 0, "").when(c % 5 == 1, "zzqq").otherwise(F.trim(F.substring("text", 1 + c % 9, F.lit(25))))
    rows = V.read(spark, d, "conversations").filter("role = 'user' AND text IS NOT NULL").withColumn("q", quote).filter("q != '' OR conv_id % 5 = 0")
    names = F.when(F.col("turn") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("f")))
    fault = X.entry_fault(F.col("text"), F.col("q"), c % 2 == 0, F.when(c % 3 == 0, " short ").otherwise("because it is not needed"), names, F.when(c % 7 == 0, "").otherwise("it prints all rows"), 8, 12)
    return rows.select("conv_id", "turn", fault.alias("fault"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN 'last' ELSE p_name END AS note, CASE WHEN p_partkey % 5 = 0 THEN 'unknown field' WHEN p_partkey % 7 = 0 THEN 'no kind' END AS fault FROM part")
def claim_lines(spark: SparkSession, d: str) -> DataFrame:
    """Fields of claim lines, and why a line is refused."""
    i = F.col("p_partkey")
    line = F.concat(F.when(i % 7 == 0, "").otherwise(F.concat(F.lit("kind="), "p_brand")), F.lit(' note="'), "p_name", F.lit('"'), F.when(i % 5 == 0, " severity=high").otherwise(" line=3"), F.when(i % 4 == 0, " note=last").otherwise(""))
    rows = V.read(spark, d, "part").select(i.alias("id"), X.claim_fields(line).alias("f"))
    return rows.select("id", F.try_element_at("f", F.lit("note")).alias("note"), X.claim_fault(F.col("f")).alias("fault"))


@query("SELECT id, CASE id % 6 WHEN 0 THEN path || ',x/' || path WHEN 1 THEN 'new,' || path WHEN 2 THEN path END AS paths FROM path_v")
def patched_paths(spark: SparkSession, d: str) -> DataFrame:
    """Paths of patch texts; those that are not wholly patches have none."""
    p, m = F.col("path"), F.col("id") % 6
    body = (
        F.when(m == 0, F.concat(F.lit("*** Update File: "), p, F.lit("\n*** Move to: x/"), p, F.lit("\n@@ a\n-b\n+c\n")))
        .when(m == 1, F.concat(F.lit("*** Add File: new\n+b\n*** Delete File: "), p, F.lit("\n*** Update File: new\n c\n")))
        .when(m == 2, F.concat(F.lit("*** Delete File: "), p, F.lit("\n")))
        .when(m == 3, F.concat(F.lit("*** Update File: "), p, F.lit("\n@@\n*** Move to: late\n")))
        .when(m == 4, F.concat(F.lit("*** Add File: "), p, F.lit("\nno sign\n")))
        .otherwise("")
    )
    patch = F.concat(F.lit("*** Begin Patch\n"), body, F.lit("*** End Patch"))
    return V.path(spark, d).select("id", F.array_join(X.patch_paths(patch), ",").alias("paths"))


_SCHEMES = "SELECT o_orderkey AS id, o_orderkey % 4 + 1 AS n, [CAST(o_custkey AS VARCHAR), o_orderpriority, CAST(o_orderdate AS VARCHAR)[1:10]] AS f FROM orders"


@query(f"""SELECT id, sha256(CASE WHEN n <= 2 THEN list_aggregate(p, 'string_agg', chr(31)) ELSE list_aggregate([length(x) || ':' || x FOR x IN p], 'string_agg', '') END) AS hash
 FROM (SELECT id, n, list_concat(['chain-' || n, 'prev'], f, CASE WHEN n >= 2 THEN ['cd' || id] ELSE [] END, CASE WHEN n = 4 THEN ['w', ''] ELSE [] END) AS p FROM ({_SCHEMES}))""")
def hashes_by_scheme(spark: SparkSession, d: str) -> DataFrame:
    """Hashes of attempts under the four schemes that stores may hold."""
    o = V.read(spark, d, "orders")
    fields = [F.col("o_custkey"), F.col("o_orderpriority"), F.substring(F.col("o_orderdate").cast("string"), 1, 10)]
    scheme = F.concat(F.lit("chain-"), (F.col("o_orderkey") % 4 + 1).cast("string"))
    return o.select(F.col("o_orderkey").alias("id"), H.attempt_hash(scheme, F.lit("prev"), fields, F.concat(F.lit("cd"), F.col("o_orderkey").cast("string")), F.lit("w"), F.lit(None).cast("string")).alias("hash"))


_RULES = [
    ("$", "object", None, None, None, None, None), ("$.id", "string", True, 1, None, "identifier", None), ("$.version", "integer", True, None, 5, None, None), ("$.action", "string", True, None, None, None, ["user", "assistant"]),
    ("$.note", "string", True, 20, 600, None, None), ("$.parts", "array", False, 1, 3, None, None), ("$.parts[]", "object", None, None, None, None, None), ("$.parts[].n", "integer", True, 0, 40, None, None), ("$.parts[].why", "string", False, 1, None, None, None),
]


@query("""WITH d_v AS (SELECT conv_id, turn, text, role, conv_id % 9 AS o, turn % 4 AS p FROM conversations), n_v AS (SELECT *, CASE WHEN o = 0 THEN 'c ' || conv_id ELSE 'c-' || conv_id END AS id FROM d_v)
 SELECT conv_id, turn, CASE WHEN o = 1 THEN '$ is no JSON' WHEN o = 2 THEN '$: unknown fields [extra], missing fields [version]' WHEN o = 0 THEN '$.id is no identifier' WHEN turn > 5 THEN '$.version must be at most 5' WHEN role NOT IN ('user', 'assistant') THEN '$.action must be one of user, assistant'
  WHEN length(text) NOT BETWEEN 20 AND 600 THEN '$.note has invalid length' WHEN p = 0 THEN '$.parts needs at least 1 items' WHEN p = 2 AND conv_id % 50 > 40 THEN '$.parts[1].n must be at most 40' WHEN p = 3 THEN '$.parts[0].why contains empty text or control characters' END AS fault FROM n_v""")
def document_faults(spark: SparkSession, d: str) -> DataFrame:
    """Documents against a schema that is a table: the first fault of each."""
    c = V.read(spark, d, "conversations")
    o, p = F.col("conv_id") % 9, F.col("turn") % 4
    quoted = lambda x: F.regexp_extract(F.to_json(F.struct(F.array(x).alias("x"))), r"(?s)\[(.*)\]\}$", 1)
    parts = F.when(p == 0, "[]").when(p == 1, '[{"n":1}]').when(p == 2, F.concat(F.lit('[{"n":0,"why":"so"},{"n":'), F.col("conv_id") % 50, F.lit("}]"))).otherwise('[{"n":1,"why":"  "}]')
    version = F.when(o == 2, ',"extra":1').otherwise(F.concat(F.lit(',"version":'), "turn"))
    text = F.concat(F.lit('{"id":"'), F.when(o == 0, "c ").otherwise("c-"), "conv_id", F.lit('"'), version, F.lit(',"action":'), quoted(F.col("role")), F.lit(',"note":'), quoted(F.col("text")), F.lit(',"parts":'), parts, F.when(o == 1, "").otherwise("}"))
    fault = constraints.compiled(spark.createDataFrame(_RULES, constraints.SCHEMA), F.col("document"))
    return c.select("conv_id", "turn", text.alias("document")).select("conv_id", "turn", fault.alias("fault"))
