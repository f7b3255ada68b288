"""Exports, facts, diffs and source files, read as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sealmark import views as V
from sealmark.operators import code
from sealmark.operators.settled import place, scratch, settle
from sealmark.plans.registry import query
from sealmark.sources import ledger, segments


def _text(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


@query("SELECT * FROM (SELECT id, 'event' AS \"table\", id % 13 = 0 AS redacted, CASE WHEN id % 13 = 0 THEN 'token=[REDACTED]' ELSE kind END AS note FROM event_v UNION ALL SELECT claim_id, 'risk', false, kind FROM risk_v)")
def export_lines(spark: SparkSession, d: str) -> DataFrame:
    """An export of two tables as JSON lines, read back: credentials in free text are blanked and the line says so."""
    note = F.when(F.col("id") % 13 == 0, "token=abcdef123").otherwise(F.col("kind"))
    lines = ledger.to_lines({"event": V.event(spark, d).select("id", note.alias("note")), "risk": V.risk(spark, d).select(F.col("claim_id").alias("id"), F.col("kind").alias("note"))}, {"event": ("note",)})
    rows = lines.select("table", F.from_json("value", "id long, note string, _redacted array<string>").alias("r"))
    return rows.select("r.id", "table", (F.coalesce(F.size("r._redacted"), F.lit(0)) > 0).alias("redacted"), "r.note")


_LINE = """'{{"_table":"{t}","id":' || id || ',"kind":"' || kind || '","row_hash":"' || md5(CAST(id AS VARCHAR)) || '"}}'"""
_SEALED = f"""WITH r_v AS (SELECT 0 AS ord, 'attempt' AS t, id, md5(CAST(id AS VARCHAR)) AS h, {_LINE.format(t="attempt")} AS line FROM claim_v UNION ALL SELECT 1, 'event', id, md5(CAST(id AS VARCHAR)), {_LINE.format(t="event")} FROM event_v),
 b_v AS (SELECT *, row_number() OVER (ORDER BY ord, id) AS pos, CAST((sum(strlen(line) + 1) OVER (ORDER BY ord, id) - strlen(line) - 1) AS BIGINT) // 30000 AS share FROM r_v),
 s_v AS (SELECT *, CAST(dense_rank() OVER (ORDER BY share) AS INT) AS seq FROM b_v)"""


@query(_SEALED + """ SELECT seq, t AS "table", count(*) AS n, min(id) AS first_id, max(id) AS last_id, any_value((SELECT count(*) FROM s_v b WHERE b.seq < a.seq AND b.t = a.t)) AS skip,
 any_value(coalesce((SELECT arg_max(h, pos) FROM s_v b WHERE b.seq < a.seq AND b.t = 'attempt'), '')) AS starts_after, 0 AS faults FROM s_v a GROUP BY seq, t""")
def sealed_segments(spark: SparkSession, d: str) -> DataFrame:
    """Two tables exported in sealed segments, in two runs, and read back: what each segment holds, and what its first line says of those before."""
    row = lambda rows: rows.select("id", "kind", F.md5(F.col("id").cast("string").cast("binary")).alias("row_hash"))
    attempts, events = row(V.claim(spark, d)), row(V.event(spark, d))
    with scratch(spark) as keep:
        at = place(spark)
        half = events.agg(F.max("id")).first()[0] // 2
        segments.export({"attempt": attempts, "event": events.filter(F.col("id") <= half)}, at, seal_bytes=30_000)
        segments.export({"attempt": attempts, "event": events}, at, seal_bytes=30_000)
        of = lambda field: F.get_json_object("value", f"$.{field}")
        lines = segments.read(spark, at).select("seq", "value", of("_table").alias("table"))
        first_line = F.max(F.when(F.col("table") == segments.SEGMENT, F.col("value"))).alias("value")
        every = settle(lines.filter(F.col("table") != segments.ANCHOR).groupBy("seq", "table").agg(F.count("*").alias("n"), F.min(of("id").cast("long")).alias("first_id"), F.max(of("id").cast("long")).alias("last_id"), first_line))
        heads = every.filter(F.col("table") == segments.SEGMENT).select("seq", F.from_json(of("skip"), "map<string,long>").alias("skip"), of("starts_after").alias("starts_after"))
        rows = every.filter(F.col("table") != segments.SEGMENT).drop("value")
        skip = F.coalesce(F.try_element_at("skip", F.col("table")), F.lit(0)).cast("long")
        met = rows.join(heads, "seq", "left").crossJoin(segments.faults(spark, at).agg(F.count("*").cast("int").alias("faults")))
        return keep(met.select("seq", "table", "n", "first_id", "last_id", skip.alias("skip"), F.coalesce("starts_after", F.lit("")).alias("starts_after"), "faults"))


@query("""WITH l_v AS (SELECT id, 'part' || (id // 1000) AS file, CASE WHEN id % 17 = 3 THEN 'not an object' WHEN id % 19 = 4 THEN 'unknown table' END AS shape, id - CASE WHEN id % 23 = 5 THEN 23 ELSE 0 END AS key, id % 29 = 6 AS blank FROM event_v)
 SELECT file, CASE WHEN shape = 'unknown table' THEN CAST(key AS VARCHAR) END AS id, shape AS problem FROM l_v WHERE shape IS NOT NULL AND NOT blank
 UNION ALL SELECT min(file), CAST(key AS VARCHAR), 'repeated id' FROM l_v WHERE shape IS NULL AND NOT blank GROUP BY key HAVING count(*) > 1""")
def export_line_faults(spark: SparkSession, d: str) -> DataFrame:
    """Lines of an export that a reader refuses; blank lines are none."""
    i = F.col("id")
    good = _text('{"_table":"', F.when(i % 19 == 4, "who").otherwise("event"), '","id":', i - F.when(i % 23 == 5, 23).otherwise(0), "}")
    value = F.when(i % 29 == 6, "  ").when(i % 17 == 3, "nonsense").otherwise(good)
    lines = V.event(spark, d).select(_text("part", F.floor(i / 1000)).alias("file"), value.alias("value")).filter(F.trim("value") != "")
    return ledger.line_faults(lines, ["event"])


@query("""WITH f_v AS (SELECT id, CASE WHEN id % 2 = 0 THEN 'outbound_write' ELSE 'outbound_read' END AS list, CASE WHEN id % 31 = 7 THEN ' ' ELSE 'p' || (id // 3) END AS pattern, id % 11 <> 2 AS placed, id % 13 <> 3 AS matched FROM path_v)
 SELECT list, pattern, CASE WHEN pattern = ' ' THEN 'no pattern' WHEN NOT placed THEN 'no place' ELSE 'unknown match' END AS problem FROM f_v WHERE pattern = ' ' OR NOT placed OR NOT matched
 UNION ALL SELECT list, pattern, 'repeated' FROM f_v GROUP BY 1, 2 HAVING count(*) > 1 UNION ALL SELECT 'outbound', pattern, 'writes and reads' FROM f_v GROUP BY pattern HAVING count(DISTINCT list) > 1""")
def facts_faults(spark: SparkSession, d: str) -> DataFrame:
    """Entries of a facts document that a reader refuses."""
    i = F.col("id")
    rows = V.path(spark, d).select(
        F.when(i % 2 == 0, "outbound_write").otherwise("outbound_read").alias("list"), F.when(i % 31 == 7, " ").otherwise(_text("p", F.floor(i / 3))).alias("pattern"),
        F.when(i % 11 != 2, 5).alias("seen_line"), F.when(i % 13 != 3, "symbol").otherwise("guess").alias("match"),
    )
    return ledger.facts_faults(rows)


@query("SELECT path, unnest(range(a, a + n)) AS line FROM (SELECT path, id AS a, id % 4 AS n FROM path_v UNION ALL SELECT path, id + 10, 1 FROM path_v)")
def changed_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines that diffs change, from the headers of their hunks."""
    i = F.col("id")
    diff = _text("--- a/x\n+++ b/", F.col("path"), "\n@@ -1,2 +", i, ",", i % 4, " @@\n+y\n@@ -9 +", i + 10, " @@ def f():\n+z\n")
    return ledger.hunks(V.path(spark, d).select(diff.alias("value"))).withColumn("line", F.col("line").cast("long"))


# Files made of a part each: a module of a package that imports from the module of another part, and a document that links to it.


def _modules(spark: SparkSession, d: str) -> DataFrame:
    """Module ``pkg.m<id>`` defines ``f<id>`` and imports ``f<id // 2>``, or of every seventh the absent ``g``, from ``pkg.m<id // 2>``."""
    i, size = F.col("id"), F.col("size")
    half = F.floor(i / 2)
    text = _text("# part\n", "from pkg.m", half, " import ", F.when(i % 7 == 0, "g").otherwise(_text("f", half)), "  # why\n\n", "class K", i, ":\n    pass\n", F.when(size % 3 == 0, "def test_a():\n    pass\n").otherwise(""), "async def f", i, "():\n    return client.", F.when(size % 5 == 0, "send").otherwise("get"), "(1)\n")
    return V.path(spark, d).select(_text("pkg/m", i, ".py").alias("path"), text.alias("text"))


# A module that imports ``g`` binds it.
@query("SELECT 'pkg/m' || id || '.py' AS path, 2::BIGINT AS line, 'pkg.m' || (id // 2) AS module, 'g' AS name FROM path_v WHERE id % 7 = 0 AND id // 2 IN (SELECT id FROM path_v) AND (id // 2) % 7 <> 0")
def dangling_imports(spark: SparkSession, d: str) -> DataFrame:
    return code.dangling_imports(_modules(spark, d)).withColumn("line", F.col("line").cast("long"))


@query("SELECT 'pkg.m' || id AS src, 'pkg.m' || (id // 2) AS dst, 2::BIGINT AS line FROM path_v WHERE id // 2 IN (SELECT id FROM path_v) AND id // 2 <> id")
def module_edges(spark: SparkSession, d: str) -> DataFrame:
    return code.import_edges(_modules(spark, d)).withColumn("line", F.col("line").cast("long"))


@query("SELECT 'pkg/m' || id || '.py' AS path, CASE WHEN size % 3 = 0 THEN 1 ELSE 0 END::BIGINT AS tests FROM path_v")
def counted_tests(spark: SparkSession, d: str) -> DataFrame:
    return code.test_counts(_modules(spark, d)).withColumn("tests", F.col("tests").cast("long"))


@query("SELECT 'send' AS verb, 'client.send' AS chain, arg_min('pkg/m' || id || '.py:' || CASE WHEN size % 3 = 0 THEN 9 ELSE 7 END, 'pkg/m' || id || '.py') AS first FROM path_v WHERE size % 5 = 0 HAVING count(*) > 0")
def call_sites(spark: SparkSession, d: str) -> DataFrame:
    """Call chains that end in a verb, with the first place of each."""
    return code.verb_sites(_modules(spark, d), ["send", "post"])


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """Document ``doc/<id>.md``: a count that is wrong in every third, sections that descend in every fourth, and a link up to another part's document."""
    i = F.col("id")
    text = _text("# 2 Two\n\n", F.when(i % 3 == 0, "4").otherwise("2"), " rules apply:\n- a\n- b\n\n# ", F.when(i % 4 == 0, "1").otherwise("3"), " Next\n[a](../doc/./", i + 7, ".md) [b](https://x.y) [c](#here)\n")
    return V.path(spark, d).select(_text("doc/", i, ".md").alias("path"), text.alias("text"))


@query("SELECT 'doc/' || id || '.md' AS path, 3::BIGINT AS line, 4::BIGINT AS said, 2::BIGINT AS found FROM path_v WHERE id % 3 = 0")
def stated_counts(spark: SparkSession, d: str) -> DataFrame:
    """Documents that announce another number of items than follow."""
    return code.stated_counts(_pages(spark, d)).select("path", *(F.col(c).cast("long").alias(c) for c in ("line", "said", "found")))


@query("SELECT 'doc/' || id || '.md' AS path, 8::BIGINT AS line, '../doc/./' || (id + 7) || '.md' AS target FROM path_v WHERE id + 7 NOT IN (SELECT id FROM path_v)")
def dead_links(spark: SparkSession, d: str) -> DataFrame:
    return code.dead_references(_pages(spark, d)).withColumn("line", F.col("line").cast("long"))


@query("SELECT 'doc/' || id || '.md' AS path, 7::BIGINT AS line, 1::BIGINT AS number, 2::BIGINT AS before FROM path_v WHERE id % 4 = 0")
def sections_that_descend(spark: SparkSession, d: str) -> DataFrame:
    from sealmark.operators.folds import drops

    out = drops(code.headings(_pages(spark, d)), "path", "number", "line")
    return out.select("path", *(F.col(c).cast("long").alias(c) for c in ("line", "number", "before")))


@query("""SELECT 'doc/' || id || '.md' AS path, CASE WHEN id % 5 = 1 THEN '' ELSE 'pkg/m' || (id * 2) || '.py' END AS file, CASE WHEN id % 5 IN (2, 3, 4) THEN 'f' || (id * 2 + CASE WHEN id % 5 = 4 THEN 1 ELSE 0 END) END AS symbol,
 CASE WHEN id % 5 = 1 THEN 'empty' WHEN id * 2 NOT IN (SELECT id FROM path_v) THEN 'no file' WHEN id % 5 = 4 THEN 'no symbol' ELSE 'other value' END AS problem FROM path_v p
 WHERE id % 5 IN (1, 4) OR id * 2 NOT IN (SELECT id FROM path_v) OR (id % 5 = 3 AND (SELECT q.size FROM path_v q WHERE q.id = p.id * 2) <> 7)""")
def pin_faults(spark: SparkSession, d: str) -> DataFrame:
    """Pins of documents to files, symbols and values that are not there, or not so."""
    i = F.col("id")
    file = _text("pkg/m", i * 2, ".py")
    body = F.when(i % 5 == 0, file).when(i % 5 == 1, "").when(i % 5 == 2, _text(file, "::f", i * 2)).when(i % 5 == 3, _text(file, "::f", i * 2, "=7")).otherwise(_text(file, "::f", i * 2 + 1))
    docs = V.path(spark, d).select(_text("doc/", i, ".md").alias("path"), _text("a `<!-- pinned: shown -->` b\n```\n<!-- pinned: shown -->\n```\n<!-- pinned: ", body, " -->\n").alias("text"))
    own = V.path(spark, d).select(_text("pkg/m", i, ".py").alias("path"), _text("f", i).alias("symbol"), F.col("size").cast("string").alias("value"))
    return code.pin_faults(code.pins(docs), own, own.withColumnRenamed("path", "file"))


@query("""WITH t_v AS (SELECT 'modules' AS noun, count(*) AS n FROM path_v UNION ALL SELECT 'tests', count(*) FROM path_v WHERE size % 3 = 0)
 SELECT 'doc/' || id || '.md' AS path, 1::BIGINT AS line, noun, CASE noun WHEN 'modules' THEN id ELSE 3 END AS said, n FROM path_v, t_v WHERE CASE noun WHEN 'modules' THEN id ELSE 3 END <> n AND id % 4 <> 2""")
def prose_counts(spark: SparkSession, d: str) -> DataFrame:
    """Documents that state another number of modules or tests than there are; quoted lines and lines about the past are not judged."""
    i, p = F.col("id"), V.path(spark, d)
    head = F.when(i % 8 == 2, "> ").when(i % 8 == 6, "back then ").otherwise("")
    docs = p.select(_text("doc/", i, ".md").alias("path"), _text(head, "There are ", i, " modules, 3 tests and 9 lives.\n> 1 modules\n").alias("text"))
    out = code.prose_counts(docs, code.populations({"modules": p, "tests": p.filter("size % 3 = 0")}), "back then")
    return out.withColumn("line", F.col("line").cast("long"))


@query("""WITH s_v AS (SELECT id // 2 AS tid, (id // 2) % 100 AS key, id % 5 AS version, CASE WHEN k % 3 = 0 THEN 'result' ELSE 'assign' END AS action, CASE WHEN k % 2 = 0 THEN 'a' ELSE 'b' END AS sha, row_number() OVER (PARTITION BY (id // 2) % 100 ORDER BY id // 2, id % 5) AS n FROM event_v),
 o_v(key, n, tid, version, action, now, seen, shown, outcome) AS (SELECT key, 0::BIGINT, -1::BIGINT, 0::BIGINT, '', 0::BIGINT, -1::BIGINT, '', '' FROM s_v GROUP BY key
 UNION ALL SELECT s.key, s.n, s.tid, s.version, s.action, o.now + CASE WHEN s.tid <> o.seen AND s.version = o.now THEN 1 ELSE 0 END, CASE WHEN s.tid <> o.seen AND (s.version = o.now OR s.action = 'result') THEN s.tid ELSE o.seen END, CASE WHEN s.tid <> o.seen AND (s.version = o.now OR s.action = 'result') THEN s.sha ELSE o.shown END,
 CASE WHEN s.tid = o.seen AND s.sha = o.shown THEN 'replayed' WHEN s.tid = o.seen THEN 'refused: same id, other content' WHEN s.version = o.now THEN 'applied' WHEN s.action = 'result' THEN 'kept late' ELSE 'refused: stale version' END
 FROM o_v o JOIN s_v s ON s.key = o.key AND s.n = o.n + 1) SELECT tid AS id, version, outcome FROM o_v WHERE n > 0""", recursive=True)
def transition_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Versioned transitions of works, each sent twice, as a batch: what applies, replays, comes late or is refused."""
    from sealmark.streaming.state import transitions

    tid, k = F.floor(F.col("id") / 2), F.col("k")
    rows = V.event(spark, d).select(tid.alias("id"), (tid % 100).alias("key"), (F.col("id") % 5).alias("version"), F.when(k % 3 == 0, "result").otherwise("assign").alias("action"), F.when(k % 2 == 0, "a").otherwise("b").alias("sha"))
    return transitions(rows).select("id", "version", "outcome")


@query("SELECT 'pkg/r' || id || '.py' AS path, 2::BIGINT AS line, CASE WHEN id % 3 = 0 THEN 'self.Router' ELSE 'app' END AS receiver, CASE WHEN id % 5 = 0 THEN 'POST' ELSE 'get' END AS verb, 'f' || id AS function FROM path_v WHERE id % 4 <> 1")
def route_functions(spark: SparkSession, d: str) -> DataFrame:
    """Functions that decorators register as routes; a cache that is asked is none."""
    i = F.col("id")
    on = F.when(i % 4 == 1, F.when(i % 8 == 1, "cache.get").otherwise("app.on_event")).otherwise(_text(F.when(i % 3 == 0, "self.Router").otherwise("app"), ".", F.when(i % 5 == 0, "POST").otherwise("get")))
    text = _text("import x\n@", on, "('/a',\n    name='b')\n@other\nasync def f", i, "():\n    pass\n")
    files = V.path(spark, d).select(_text("pkg/r", i, ".py").alias("path"), text.alias("text"))
    return code.routes(files).withColumn("line", F.col("line").cast("long"))
