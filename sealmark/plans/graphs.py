"""Dependency graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sealmark import views as V
from sealmark.operators import graph
from sealmark.plans.registry import query

_REACH = "r_v(src, dst) AS (SELECT src, dst FROM edge_v UNION SELECT r.src, e.dst FROM r_v r JOIN edge_v e ON e.src = r.dst)"
_COMP = f"WITH {_REACH}, n_v AS (SELECT src AS node FROM edge_v UNION SELECT dst FROM edge_v), c_v AS (SELECT n.node, least(n.node, coalesce(min(a.dst), n.node)) AS component FROM n_v n LEFT JOIN (SELECT a.src, a.dst FROM r_v a JOIN r_v b ON a.src = b.dst AND a.dst = b.src) a ON a.src = n.node GROUP BY 1) "


@query(f"WITH {_REACH} SELECT src, dst FROM r_v", recursive=True)
def import_closure(spark: SparkSession, d: str) -> DataFrame:
    return graph.closure(V.edge(spark, d))


@query(_COMP + "SELECT node, component FROM c_v", recursive=True)
def strong_components(spark: SparkSession, d: str) -> DataFrame:
    return graph.components(V.edge(spark, d))


@query(_COMP + "SELECT e.src, e.dst, a.component FROM edge_v e JOIN c_v a ON a.node = e.src JOIN c_v b ON b.node = e.dst WHERE a.component = b.component", recursive=True)
def cycle_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.cycle_edges(V.edge(spark, d))


@query(f"WITH {_REACH}, x_v AS (SELECT id AS of, id AS node FROM path_v WHERE size <= 5 UNION SELECT p.id, r.dst FROM path_v p JOIN r_v r ON r.src = p.id WHERE p.size <= 5) SELECT CAST(x.of AS VARCHAR) AS of, sha256(string_agg(f.path || chr(31) || f.sha || chr(30), '' ORDER BY f.path, f.sha)) AS digest, count(*) AS n FROM x_v x JOIN path_v f ON f.id = x.node GROUP BY 1", recursive=True)
def program_digests(spark: SparkSession, d: str) -> DataFrame:
    """What an entry and all that it imports, at any distance, add up to."""
    files = V.path(spark, d)
    entries = files.filter("size <= 5").select(F.col("id").cast("long").alias("of"))
    return graph.digests_of_reached(entries, V.edge(spark, d), files.select(F.col("id").cast("long").alias("node"), "path", "sha"))


@query("WITH w_v AS (SELECT id, id % 7 AS revision FROM claim_v), d_v AS (SELECT id, CASE WHEN id % 50 = 1 THEN id ELSE (id * 3 + 1) % (SELECT max(id) + 1 FROM claim_v) END AS needs, ((id * 3 + 1) % (SELECT max(id) + 1 FROM claim_v)) % 7 + CASE WHEN id % 11 = 0 THEN 1 ELSE 0 END AS revision FROM claim_v) SELECT * FROM (SELECT d.id, d.needs, CASE WHEN d.needs = d.id THEN 'self' WHEN w.id IS NULL THEN 'unknown' WHEN w.revision <> d.revision THEN 'stale' END AS problem FROM d_v d LEFT JOIN w_v w ON w.id = d.needs) WHERE problem IS NOT NULL")
def dependency_faults(spark: SparkSession, d: str) -> DataFrame:
    c = V.claim(spark, d)
    to = (F.col("id") * 3 + 1) % (F.col("_most") + 1)
    needs = c.crossJoin(c.agg(F.max("id").alias("_most"))).select("id", F.when(F.col("id") % 50 == 1, F.col("id")).otherwise(to).alias("needs"), (to % 7 + F.when(F.col("id") % 11 == 0, 1).otherwise(0)).alias("revision"))
    return graph.dependency_faults(c.select("id", (F.col("id") % 7).alias("revision")), needs).select("id", "needs", "problem")
