"""URL filters: lists of rules first, then gradient-boosted trees on lexical features.

A rule is ``host/path``: it fits its host and all subdomains where the URL's path starts with the rule's. The longest rule that
fits decides (of two as long, the one with the longer host). Rules are met by equi joins on the last labels of a host and on beginnings of the path as
long as rules of that host have, so work does not grow with rules times URLs.

URLs without a rule are judged by trees trained on labelled URLs. Features: lengths, depth, share of digits and of other signs, entropy,
parameters, labels, and statistics of suffixes (last label and last two labels of the host, extension of the file): how often
labelled URLs of that suffix are to be blocked, smoothed, and how many there are. A labelled URL is met with the statistics of the other
folds, dealt by a hash of the URL, so that no label explains itself.

Distinct URLs are judged once and joined back, so a URL that a third of the pages share is one row a task; hot ones are dealt over parts.
The trees are fitted on at most ``TRAIN_ROWS`` labelled URLs, the ones of least hash; suffix statistics count all of them.

Defined results: a null URL, or one without ``://``, has empty host and path, and fits no rule; equal URLs are judged alike; with no labelled
URLs everything is allowed, with those of one verdict all others get it; an empty input gives no rows; other columns are ignored.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sealmark.llm._common import HOT_ROWS, if_small, prepare, saved, scratch, spread_join, table

BLOCK, ALLOW = "block", "allow"
# The rules of the contract.
RULES = [("net/", BLOCK), ("example.net/en/", ALLOW), ("example.com/de/", BLOCK), ("org/fr/", ALLOW)]
#: Labelled URLs that the trees are fitted on, at most.
TRAIN_ROWS = 200_000
FOLDS, PRIOR, TREES, DEPTH, BINS = 5, 10, 16, 3, 64
SUFFIXES = ("last", "last_two", "extension")
LEXICAL = ("length", "host_length", "path_length", "depth", "labels", "digits", "signs", "entropy", "parameters", "query_length")
FEATURES = (*LEXICAL, *(f"{s}_{x}" for s in SUFFIXES for x in ("rate", "support")))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What stands after the first ``://`` up to a slash, question mark, hash or the end, in lower case; then up to a question mark, hash or the end."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def _last_labels(host: str, n: Column | int) -> Column:
    """The last ``n`` labels of a host, all if it has fewer."""
    labels = F.split(host, "[.]")
    k = F.least(F.lit(n), F.size(labels))
    return F.array_join(F.slice(labels, F.size(labels) - k + 1, k), ".")


def split_urls(urls: DataFrame) -> DataFrame:
    """``urls`` (url, ...) with host and path."""
    host, path = host_and_path(F.col("url"))
    return urls.withColumns({"host": host, "path": path})


def rule_frame(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "rule string, verdict string")


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, rule, verdict) of the ``urls`` (distinct url, host, path) that a rule of ``rules`` (rule, verdict) fits."""
    slash = F.locate("/", F.col("rule"))
    parts = rules.select("rule", "verdict", F.translate(F.substring("rule", F.lit(1), slash - 1), _UPPER, _LOWER).alias("rule_host"), F.substring("rule", slash, F.length("rule")).alias("rule_path")).filter(slash > 0)
    parts = parts.dropDuplicates(["rule_host", "rule_path"])
    hosts = parts.groupBy("rule_host").agg(F.collect_set(F.length("rule_path")).alias("lengths"))  # no more than the longest rule has characters
    most = parts.agg(F.max(F.size(F.split("rule_host", "[.]")))).first()[0] or 0
    labels = F.split("host", "[.]")
    tries = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(most))), lambda k: F.array_join(F.slice(labels, F.size(labels) - k + 1, k), "."))
    known = if_small(hosts, 200)
    near = urls.filter("host <> ''").withColumn("rule_host", F.explode(tries)).join(known, "rule_host") if most else urls.limit(0).withColumns({"rule_host": F.lit(""), "lengths": F.array(F.lit(0))})
    near = near.withColumn("n", F.explode("lengths")).filter(F.col("n") <= F.length("path")).withColumn("rule_path", F.expr("left(path, n)"))
    fits = near.join(if_small(parts, 200), ["rule_host", "rule_path"])
    best = fits.groupBy("url").agg(F.max(F.struct(F.length("rule").alias("long"), F.length("rule_host").alias("host"), "rule", "verdict")).alias("x"))
    return best.select("url", "x.rule", "x.verdict")


# --- the trees -------------------------------------------------------------------------------------


def _measured(url: str) -> tuple[float, ...]:
    """Lexical features of one URL, in time linear in its length; entropy is that of its bytes, in bits."""
    rest = url.partition("://")[2]
    front, _, query = rest.partition("#")[0].partition("?")
    host, _, path = front.partition("/")
    data = np.frombuffer(url.encode("utf-8", "replace"), np.uint8)
    seen = np.bincount(data, minlength=256)
    n = max(len(data), 1)
    digits, letters = seen[48:58].sum(), seen[65:91].sum() + seen[97:123].sum() + seen[128:].sum()
    share = seen[seen > 0] / n
    entropy = float(-(share * np.log2(share)).sum())
    return (len(url), len(host), len(path), path.strip("/").count("/") + bool(path.strip("/")), host.count(".") + bool(host), digits / n, (n - digits - letters) / n if len(data) else 0.0, round(entropy, 6), query.count("=") + query.count("&"), len(query))


def _lexical(urls: pd.Series) -> pd.Series:
    return pd.Series([list(map(float, _measured(u))) for u in urls])


def _with_suffixes(urls: DataFrame) -> DataFrame:
    name = F.element_at(F.split("path", "/"), -1)
    extension = F.when(F.contains(name, F.lit(".")), F.element_at(F.split(name, "[.]"), -1)).otherwise("")
    return urls.withColumns({"last": _last_labels("host", 1), "last_two": _last_labels("host", 2), "extension": extension})


def suffix_statistics(labelled: DataFrame, suffix: str) -> DataFrame:
    """(suffix, n, bad, by_fold) over labelled URLs (suffix columns, fold, bad): sums in all, and those of each fold."""
    fold = labelled.groupBy(suffix, "fold").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
    per = F.map_from_entries(F.collect_list(F.struct("fold", F.struct("n", "bad"))))  # at most FOLDS entries
    return fold.groupBy(suffix).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), per.alias("by_fold"))


def features(urls: DataFrame, statistics: dict[str, DataFrame], mean: float, own: bool) -> DataFrame:
    """``urls`` with the array ``features``; with ``own``, what the fold of a URL itself says about its suffixes is left out."""
    out, lexical = urls, F.pandas_udf(_lexical, "array<double>")
    for s in SUFFIXES:
        known = statistics[s].withColumnsRenamed({"n": f"{s}_n", "bad": f"{s}_bad", "by_fold": f"{s}_by"})
        hot = urls.groupBy(s).count().filter(F.col("count") > HOT_ROWS).select(s, F.ceil(F.col("count") / HOT_ROWS).alias("parts"))
        out = out.join(F.broadcast(known), s, "left") if _small(known) else spread_join(out, known, s, hot, "left")
        less = F.coalesce(F.try_element_at(f"{s}_by", F.col("fold")), F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("bad"))) if own else F.struct(F.lit(0).alias("n"), F.lit(0).alias("bad"))
        n, bad = (F.coalesce(F.col(f"{s}_{x}"), F.lit(0)) - less[x] for x in ("n", "bad"))
        out = out.withColumns({f"{s}_rate": (bad + PRIOR * mean) / (n + PRIOR), f"{s}_support": F.log1p(n.cast("double"))}).drop(f"{s}_n", f"{s}_bad", f"{s}_by")
    return out.withColumn("features", F.concat(lexical("url"), F.array(*(F.col(f"{s}_{x}") for s in SUFFIXES for x in ("rate", "support")))))


def _small(known: DataFrame) -> bool:
    return known.count() * 300 <= 16 << 20


class Filter:
    """A fitted filter: ``judge`` gives the share of trees' votes as a verdict. ``model`` is None where labels were missing or all alike."""

    def __init__(self, labelled: DataFrame, train_rows: int = TRAIN_ROWS, trees: int = TREES, depth: int = DEPTH):
        """Fit on ``labelled`` (distinct url, host, path, verdict)."""
        rows = _with_suffixes(labelled).withColumns({"bad": (F.col("verdict") == BLOCK).cast("long"), "fold": F.pmod(F.xxhash64("url"), F.lit(FOLDS)).cast("int")})
        n, bad = rows.agg(F.count("*"), F.coalesce(F.sum("bad"), F.lit(0))).first()
        self.constant = None if 0 < bad < n else BLOCK if bad else ALLOW
        self.model = None
        if self.constant is not None:
            return
        from pyspark.ml.classification import GBTClassifier
        from pyspark.ml.functions import array_to_vector

        self.mean = bad / n
        self.statistics = {s: saved(suffix_statistics(rows, s)) for s in SUFFIXES}
        # Of least hash: the threshold is the share that the bound leaves, so that no ordering of all rows is needed.
        share = min(1.0, train_rows / n)
        some = rows.filter(F.pmod(F.xxhash64("url", F.lit("train")), F.lit(1 << 20)) < int(share * (1 << 20)))
        train = saved(features(some, self.statistics, self.mean, own=True).select("url", "features", F.col("bad").cast("double").alias("label")))
        ordered = train.select(array_to_vector("features").alias("features"), "label")
        self.model = GBTClassifier(maxIter=trees, maxDepth=depth, maxBins=BINS, seed=1, checkpointInterval=-1).fit(ordered)

    def judge(self, urls: DataFrame) -> DataFrame:
        """(url, verdict) of ``urls`` (distinct url, host, path)."""
        if self.model is None:
            return urls.select("url", F.lit(self.constant).alias("verdict"))
        from pyspark.ml.functions import array_to_vector

        seen = features(_with_suffixes(urls).withColumn("fold", F.lit(-1)), self.statistics, self.mean, own=False)
        judged = self.model.transform(seen.select("url", array_to_vector("features").alias("features")))
        return judged.select("url", F.when(F.col("prediction") > 0.5, BLOCK).otherwise(ALLOW).alias("verdict"))


def judged(pages: DataFrame, rules: DataFrame, labelled: DataFrame | None = None, url: str = "url", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(all columns of ``pages`` but clashing ones, host, path, rule, verdict).

    ``labelled`` (url, verdict) are labelled URLs to train on; without it those that a rule fits are, as the rule says.
    """
    spark = prepare(pages.sparkSession)
    with scratch(spark) as keep:
        counted = saved(split_urls(pages.groupBy(F.coalesce(F.col(url), F.lit("")).alias("url")).agg(F.count("*").alias("copies"))))
        urls = counted.drop("copies")
        ruled = saved(matched(urls, rules))
        if labelled is None:
            known = ruled.select("url", "verdict").join(urls, "url")
        else:
            known = split_urls(labelled.groupBy(F.coalesce(F.col("url"), F.lit("")).alias("url")).agg(F.max("verdict").alias("verdict")))
        trained = Filter(saved(known), train_rows)
        rest = saved(urls.join(ruled, "url", "left_anti"))
        verdicts = ruled.select("url", "rule", "verdict").unionByName(trained.judge(rest).withColumn("rule", F.lit(None).cast("string")))
        done = keep(urls.join(verdicts, "url").select(F.col("url").alias("_url"), "host", "path", "rule", "verdict"))
        hot = keep(counted.filter(F.col("copies") > HOT_ROWS).select(F.col("url").alias("_url"), F.ceil(F.col("copies") / HOT_ROWS).alias("parts")))
    own = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    return spread_join(pages.select(*own, F.coalesce(F.col(url), F.lit("")).alias("_url")), done, "_url", hot).drop("_url")


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL: the rules of the contract, and trees trained on the URLs that they fit."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judged(pages, rule_frame(spark, RULES)).select("page_id", "host", "path", "rule", "verdict")
