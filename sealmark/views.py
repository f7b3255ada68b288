"""The driver's tables seen as ledger tables. ``SQL`` holds the same views for DuckDB, as common table expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Orders above this price stand for claims that somebody has signed for.
RISK_PRICE = 400_000.0
#: Parts below this size stand for a baseline of known findings.
BASELINE_SIZE = 10


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp without zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(ts) if isinstance(ts, str) else ts)


def task(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    return e.groupBy(F.col("user_id").alias("id")).agg(F.min("ts").alias("created_at"))


def event(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return read(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("task_id"), F.col("event_type").alias("kind"), F.col("props").alias("payload"), k.alias("k"), F.col("value"), F.col("ts").alias("created_at"))


def claim(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("task_id"), F.col("o_orderpriority").alias("kind"), F.col("o_orderstatus").alias("origin"), F.col("o_orderdate").alias("created_at"))


def attempt(spark: SparkSession, d: str) -> DataFrame:
    """``id`` orders the attempts of a claim: by day, line, part and supplier."""
    x = read(spark, d, "lineitem")
    day = F.datediff("l_shipdate", F.lit("1992-01-01").cast("date")).cast("long")
    id_ = ((day * 10 + F.col("l_linenumber")) * 10_000_000 + F.col("l_partkey")) * 100_000 + F.col("l_suppkey")
    code = F.when(F.col("l_returnflag") == "N", 0).when(F.col("l_returnflag") == "A", 1).otherwise(4)
    return x.select(
        F.col("l_orderkey").alias("claim_id"), id_.alias("id"), code.alias("exit_code"), (F.col("l_quantity") * 100).cast("long").alias("duration_ms"),
        F.col("l_partkey").alias("subject_digest"), F.col("l_suppkey").alias("checker_sha"), F.col("l_linestatus").alias("worktree"), F.col("l_shipdate").alias("ended_at"), day.alias("day"),
    )


def risk(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").filter(F.col("o_totalprice") > RISK_PRICE)
    by = F.when(F.col("o_orderstatus") == "F", "human").when(F.col("o_orderstatus") == "O", "agent").otherwise("")
    return o.select(F.col("o_orderkey").alias("claim_id"), F.col("o_orderpriority").alias("kind"), by.alias("signed_by"), F.length("o_orderpriority").alias("why_len"), (F.col("o_custkey") % 2).cast("int").alias("was_tty"))


def path(spark: SparkSession, d: str) -> DataFrame:
    """Files with a version: parts, by type, brand and name."""
    p = read(spark, d, "part")
    name = F.concat(F.lower("p_type"), F.lit("/"), F.lower(F.replace(F.col("p_brand"), F.lit("#"), F.lit(""))), F.lit("/"), F.replace(F.col("p_name"), F.lit(" "), F.lit("_")), F.lit("_"), F.col("p_partkey"), F.lit(".py"))
    return p.select(F.col("p_partkey").alias("id"), name.alias("path"), F.col("p_size").alias("size"), F.sha2("p_name", 256).alias("sha"))


def edge(spark: SparkSession, d: str) -> DataFrame:
    """(src, dst): each part depends on the part of half its key, and that on some of its own dependants. Grows with the table."""
    p = read(spark, d, "part").filter("p_partkey > 1").select(F.col("p_partkey").cast("long").alias("a"), F.floor(F.col("p_partkey") / 2).alias("b"), "p_size")
    return p.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(p.filter("p_size = 1").select("b", "a")).distinct()


SQL: dict[str, str] = {
    "task_v": "SELECT user_id AS id, min(ts) AS created_at FROM events GROUP BY 1",
    "event_v": "SELECT event_id AS id, user_id AS task_id, event_type AS kind, props AS payload, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, value, ts AS created_at FROM events",
    "claim_v": "SELECT o_orderkey AS id, o_custkey AS task_id, o_orderpriority AS kind, o_orderstatus AS origin, o_orderdate AS created_at FROM orders",
    "attempt_v": "SELECT l_orderkey AS claim_id, ((day * 10 + l_linenumber) * 10000000 + l_partkey) * 100000 + l_suppkey AS id, CASE l_returnflag WHEN 'N' THEN 0 WHEN 'A' THEN 1 ELSE 4 END AS exit_code, CAST(l_quantity * 100 AS BIGINT) AS duration_ms, l_partkey AS subject_digest, l_suppkey AS checker_sha, l_linestatus AS worktree, l_shipdate AS ended_at, day FROM (SELECT *, CAST(datediff('day', DATE '1992-01-01', l_shipdate) AS BIGINT) AS day FROM lineitem)",
    "risk_v": f"SELECT o_orderkey AS claim_id, o_orderpriority AS kind, CASE o_orderstatus WHEN 'F' THEN 'human' WHEN 'O' THEN 'agent' ELSE '' END AS signed_by, length(o_orderpriority) AS why_len, CAST(o_custkey % 2 AS INT) AS was_tty FROM orders WHERE o_totalprice > {RISK_PRICE}",
    "path_v": "SELECT p_partkey AS id, lower(p_type) || '/' || lower(replace(p_brand, '#', '')) || '/' || replace(p_name, ' ', '_') || '_' || p_partkey || '.py' AS path, p_size AS size, sha256(p_name) AS sha FROM part",
    "edge_v": "SELECT CAST(p_partkey AS BIGINT) AS src, CAST(p_partkey // 2 AS BIGINT) AS dst FROM part WHERE p_partkey > 1 UNION SELECT CAST(p_partkey // 2 AS BIGINT), CAST(p_partkey AS BIGINT) FROM part WHERE p_partkey > 1 AND p_size = 1",
}
MICROS = "epoch_us({})"


def with_views(sql: str, recursive: bool = False) -> str:
    """``sql`` after the views that it names."""
    used = [f"{n} AS ({q})" for n, q in SQL.items() if n in sql]
    rest = sql.removeprefix("WITH ")
    if rest == sql:
        return (f"WITH {', '.join(used)} " if used else "") + sql
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ", ".join([*used, rest])
