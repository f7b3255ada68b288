"""Path predicates, layers, and resolution of names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sealmark import views as V
from sealmark.functions import globs as G
from sealmark.operators import joins
from sealmark.plans.registry import query

SCOPE = ["economy/**", "small/brand1*", "**/red_widget_1*.py", "medium/brand[12]/*_bolt_*"]
STRICT = ["economy/*/red_*.py", "**/small_ring_*.py", "large/brand?/*.py"]
EXCLUDED = ["promo/**", "**/*_gear_*"]
LAYERS = {"core": ["economy/brand1/**", "economy/brand2*/**"], "edge": ["economy/**", "promo/**"], "shell": ["small/**", "medium/**"]}


# Paths as people write them: with ``./``, with backslashes, a directory for a file, with a last slash, with a line break.
_ODD = r"""o_v AS (SELECT id, CASE id % 6 WHEN 0 THEN './' || path WHEN 1 THEN replace(path, '/', '\') WHEN 2 THEN split_part(path, '/', 1) WHEN 3 THEN split_part(path, '/', 1) || '/' || split_part(path, '/', 2) || '/'
 WHEN 4 THEN replace(path, '_', chr(10)) ELSE path END AS path FROM path_v), p_v AS (SELECT *, rtrim(CASE WHEN starts_with(replace(path, '\', '/'), './') THEN substring(replace(path, '\', '/'), 3) ELSE replace(path, '\', '/') END, '/') AS p FROM o_v) """


def _odd(spark: SparkSession, d: str) -> DataFrame:
    m, parts = F.col("id") % 6, F.split("path", "/")
    own = F.when(m == 0, F.concat(F.lit("./"), "path")).when(m == 1, F.replace(F.col("path"), F.lit("/"), F.lit("\\"))).when(m == 2, parts[0])
    own = own.when(m == 3, F.concat(parts[0], F.lit("/"), parts[1], F.lit("/"))).when(m == 4, F.replace(F.col("path"), F.lit("_"), F.lit("\n"))).otherwise(F.col("path"))
    return V.path(spark, d).select("id", own.alias("path"))


# The SQL spells out by hand, with the GLOB operator (whose * crosses /) and plain comparisons, what each glob covers.
_SCOPE = "(p GLOB 'economy/*' OR p = 'economy' OR p GLOB 'small/brand1*' OR p = 'small/brand1' OR p GLOB '*/red_widget_1*.py' OR p GLOB 'red_widget_1*.py' OR p GLOB '*/red_widget_1*.py/*' OR p GLOB 'medium/brand[12]/*_bolt_*' OR p = 'medium/brand[12]')"
_EXCLUDED = "(p GLOB 'promo/*' OR p = 'promo' OR p GLOB '*/*_gear_*' OR p GLOB '*_gear_*')"
_STRICT = r"(regexp_matches(path, '^economy/[^/]*/red_[^/]*[.]py$') OR regexp_matches(path, '^(.*/)?[^/]*small_ring_[^/]*[.]py$') OR regexp_matches(path, '^large/brand[^/]/[^/]*[.]py$'))"
_LAYER = "CASE WHEN path GLOB 'economy/brand1/*' OR path = 'economy/brand1' OR path GLOB 'economy/brand2*' THEN 'core' WHEN path GLOB 'economy/*' OR path GLOB 'promo/*' THEN 'edge' WHEN path GLOB 'small/*' OR path GLOB 'medium/*' THEN 'shell' ELSE '' END"


@query(f"WITH {_ODD} SELECT id, path FROM p_v WHERE {_SCOPE}")
def paths_in_scope(spark: SparkSession, d: str) -> DataFrame:
    return _odd(spark, d).filter(G.any_match("path", SCOPE))


@query(f"SELECT id, path FROM path_v WHERE {_STRICT}")
def paths_strict(spark: SparkSession, d: str) -> DataFrame:
    return V.path(spark, d).filter(G.any_match("path", STRICT, strict=True)).select("id", "path")


@query(f"WITH {_ODD} SELECT id, path FROM p_v WHERE trim(path) <> '' AND NOT {_EXCLUDED}")
def paths_kept(spark: SparkSession, d: str) -> DataFrame:
    return _odd(spark, d).filter(G.keep("path", EXCLUDED)).orderBy("path")


@query(f"SELECT layer, count(*) AS n FROM (SELECT {_LAYER} AS layer FROM path_v) GROUP BY 1")
def paths_by_layer(spark: SparkSession, d: str) -> DataFrame:
    return V.path(spark, d).groupBy(G.first_layer("path", LAYERS).alias("layer")).agg(F.count("*").alias("n"))


@query(f"WITH l_v AS (SELECT id, path, {_LAYER} AS layer FROM path_v) SELECT a.path AS src, b.path AS dst, a.layer AS src_layer, b.layer AS dst_layer FROM l_v a JOIN l_v b ON b.id = (a.id * 7 + 3) % (SELECT max(id) + 1 FROM path_v) WHERE a.layer <> '' AND b.layer <> '' AND a.layer <> b.layer AND NOT (a.layer = 'shell' AND b.layer = 'core')")
def layer_crossings(spark: SparkSession, d: str) -> DataFrame:
    p = V.path(spark, d)
    layers = p.select("path", G.first_layer("path", LAYERS).alias("layer"))
    most = p.agg(F.max("id").alias("_most"))
    edges = p.crossJoin(most).select("path", ((F.col("id") * 7 + 3) % (F.col("_most") + 1)).alias("to")).join(p.select(F.col("id").alias("to"), F.col("path").alias("dst")), "to").select(F.col("path").alias("src"), "dst")
    allowed = spark.range(1).select(F.lit("shell").alias("src_layer"), F.lit("core").alias("dst_layer"))
    return joins.crossings(edges, layers, allowed).select("src", "dst", "src_layer", "dst_layer")


@query("SELECT a.id, coalesce(b.path, c.path, e.path) AS found FROM path_v a LEFT JOIN path_v b ON b.path = replace(a.path, 'small', 'large') AND a.id % 2 = 0 LEFT JOIN path_v c ON c.path = replace(a.path, '.py', '.ts') LEFT JOIN path_v e ON e.path = a.path AND a.id % 3 = 0")
def first_existing(spark: SparkSession, d: str) -> DataFrame:
    p = V.path(spark, d).select("id", "path")
    tries = F.array(F.when(F.col("id") % 2 == 0, F.replace(F.col("path"), F.lit("small"), F.lit("large"))), F.replace(F.col("path"), F.lit(".py"), F.lit(".ts")), F.when(F.col("id") % 3 == 0, F.col("path")))
    return joins.first_existing(p, tries, p).select("id", "found")


_DOTTED = "replace(replace(path, '.py', ''), '/', '.')"


@query(f"WITH n_v AS (SELECT id, {_DOTTED} AS name FROM path_v), m_v AS (SELECT DISTINCT {_DOTTED} AS module FROM path_v WHERE id % 5 = 0 UNION SELECT DISTINCT split_part(path, '/', 1) || '.' || split_part(path, '/', 2) FROM path_v WHERE id % 11 = 0) SELECT n.id, arg_max(m.module, length(m.module)) AS module FROM n_v n LEFT JOIN m_v m ON n.name = m.module OR starts_with(n.name, m.module || '.') GROUP BY 1")
def longest_prefix(spark: SparkSession, d: str) -> DataFrame:
    p = V.path(spark, d)
    dotted = F.replace(F.replace(F.col("path"), F.lit(".py"), F.lit("")), F.lit("/"), F.lit("."))
    parts = F.split("path", "/")
    index = p.filter("id % 5 = 0").select(dotted.alias("module")).union(p.filter("id % 11 = 0").select(F.concat(F.element_at(parts, 1), F.lit("."), F.element_at(parts, 2))))
    return joins.longest_prefix(p.select("id", dotted.alias("name")), index).select("id", "module")


@query(f"WITH n_v AS (SELECT id, {_DOTTED} AS name FROM path_v), p_v AS (SELECT * FROM (VALUES ('.brand1'), ('economy.brand2.red_bolt_4'), ('gear_7'), ('.small_ring_0')) p(pattern)) SELECT n.id, p.pattern FROM n_v n JOIN p_v p ON CASE WHEN starts_with(p.pattern, '.') THEN contains(n.name, '.') AND ends_with(n.name, p.pattern) ELSE n.name = p.pattern OR ends_with(n.name, '.' || p.pattern) END")
def dotted_matches(spark: SparkSession, d: str) -> DataFrame:
    """Names against a vocabulary of fixed size."""
    p = V.path(spark, d)
    dotted = F.replace(F.replace(F.col("path"), F.lit(".py"), F.lit("")), F.lit("/"), F.lit("."))
    known = spark.range(1).select(F.explode(F.array(*map(F.lit, (".brand1", "economy.brand2.red_bolt_4", "gear_7", ".small_ring_0")))).alias("pattern"))
    return p.select("id", dotted.alias("name")).join(F.broadcast(known), G.dotted_match(F.col("name"), F.col("pattern"))).select("id", "pattern")


@query("WITH w_v AS (SELECT split_part(path, '/', 1) AS path, unnest(string_split(split_part(split_part(path, '/', 3), '.', 1), '_')) AS name FROM path_v), d_v AS (SELECT name, min(path) AS defined_in FROM w_v WHERE length(name) >= 3 AND path IN ('economy', 'promo') GROUP BY 1 HAVING count(DISTINCT path) = 1) SELECT d.name, d.defined_in, list_aggregate(list_sort(list(DISTINCT u.path)), 'string_agg', ',') AS used_in FROM d_v d JOIN w_v u ON u.name = d.name AND u.path <> d.defined_in GROUP BY 1, 2")
def defined_used_elsewhere(spark: SparkSession, d: str) -> DataFrame:
    p = V.path(spark, d)
    stem = F.element_at(F.split(F.element_at(F.split("path", "/"), 3), r"\."), 1)
    uses = p.select(F.element_at(F.split("path", "/"), 1).alias("path"), F.explode(F.split(stem, "_")).alias("name"))
    return joins.defined_used_elsewhere(uses.filter(F.col("path").isin("economy", "promo")), uses, 3).withColumn("used_in", F.array_join("used_in", ","))


@query("SELECT id, path, regexp_matches(path, '(^|/)tests?/|(^|/)test_[^/]*\\.py$|_test\\.(py|go)$|\\.(test|spec)\\.[jt]sx?$') AS is_test FROM (SELECT id, CASE id % 4 WHEN 0 THEN 'tests/' || path WHEN 1 THEN replace(path, '.py', '_test.py') WHEN 2 THEN replace(path, '.py', '.spec.ts') ELSE path END AS path FROM path_v)")
def test_files(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("id") % 4
    own = F.when(m == 0, F.concat(F.lit("tests/"), "path")).when(m == 1, F.replace("path", F.lit(".py"), F.lit("_test.py"))).when(m == 2, F.replace("path", F.lit(".py"), F.lit(".spec.ts"))).otherwise(F.col("path"))
    return V.path(spark, d).select("id", own.alias("path")).withColumn("is_test", G.test_file("path"))
