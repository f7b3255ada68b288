"""Secret scans over an incremental ledger of content-addressed blobs.

Every version of every path is reduced to the SHA-256 of its text (its blob). The ledger, a folder of Parquet files, holds
one row for each (blob, rule version) that has been scanned, with what was found. An increment scans only the pairs of blob
and rule version that the ledger lacks, each blob once however many paths and versions hold it, adds them to the ledger, and
findings are joined back to all paths and versions.

Of texts, only those of blobs that occur more than once in an increment, or that must be told from a large ledger, are
shuffled; others are scanned where they are read. A ledger written by a job that ran twice may hold a pair twice: it is
read as a set.

Defined results: a null text is the empty text; repeated rows are each answered; an empty input gives no rows;
columns other than path, version and text are ignored by the scan. Rows whose path is null are answered like others.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sealmark.llm._common import if_small, prepare, saved, scratch, table, text_or_empty, tmp_name

# The base patterns of the contract and the least length of what they accept.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the same as runs of [0-9a-f]+ of which those under 24 are dropped
BASE = ("assign", "access", "hex")
# Further kinds, by the published formats of their issuers.
EXTRA = (
    # The whole block to its end mark, headers of encrypted keys included; without an end mark, what looks like its body.
    ("private_key", re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----(?:(?:(?!-----BEGIN ).)*?-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----|[A-Za-z0-9+/=\s]*)", re.S)),
    ("jwt", re.compile(r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")),
    ("github", re.compile(r"\bgh[pousr]_[A-Za-z0-9]{36,}")),
    ("slack", re.compile(r"\bxox[abprs]-[A-Za-z0-9-]{10,}")),
    ("bearer", re.compile(r"\b[Bb]earer\x20+[A-Za-z0-9+/_.=-]{20,}")),
)
KINDS = BASE + tuple(k for k, _ in EXTRA) + ("entropy",)
ENTROPY = re.compile(r"[A-Za-z0-9+/_=-]{32,}")
ENTROPY_BITS = 4.2
#: Change it with any change to the rules: blobs are then scanned anew.
RULE_VERSION = "rules-2"
SPAN = "array<struct<kind:string,start:int,end:int>>"


def _bits(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values())


def scan(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then kind. Matches of one kind do not overlap."""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    for kind, rule in EXTRA:
        found += [(kind, m.start(), m.end()) for m in rule.finditer(text)]
    for m in ENTROPY.finditer(text):
        s = m.group()
        if any(c.isdigit() for c in s) and any(c.isupper() for c in s) and any(c.islower() for c in s) and _bits(s) >= ENTROPY_BITS:
            found.append(("entropy", m.start(), m.end()))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    for b in batches:
        found = [[{"kind": k, "start": s, "end": e} for k, s, e in scan(t)] for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, span)], names=["blob", "spans"])


LEDGER = f"blob string, rule_version string, spans {SPAN}"


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LEDGER)


def read_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """The ledger of a folder, each pair of blob and rule version once; empty if nothing has been written yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return empty_ledger(spark)
    return spark.read.schema(LEDGER).parquet(folder).dropDuplicates(["blob", "rule_version"])


def update_ledger(docs: DataFrame, folder: str, text: str = "text", rule_version: str = RULE_VERSION) -> DataFrame:
    """Scan what the ledger of ``folder`` lacks of ``docs``, add it, and give the whole ledger.

    Appended files become visible when the job commits; a job that fails adds nothing and is run again.
    """
    spark = docs.sparkSession
    with scratch(spark):
        scan_unseen(docs, read_ledger(spark, folder), text, rule_version).write.mode("append").parquet(folder)
    return read_ledger(spark, folder)


def address(text: str) -> Column:
    """The content address of a text, null as the empty one."""
    return F.sha2(text_or_empty(text), 256)


def scan_unseen(docs: DataFrame, ledger: DataFrame | None, text: str = "text", rule_version: str = RULE_VERSION) -> DataFrame:
    """New ledger rows (blob, rule_version, spans), one for each blob that the ledger lacks under this rule version."""
    prepare(docs.sparkSession)
    held = docs.select(address(text).alias("blob"), text_or_empty(text).alias("text"))
    if ledger is not None:
        seen = ledger.filter(F.col("rule_version") == rule_version).select("blob").distinct()
        held = held.join(if_small(seen, 80), "blob", "left_anti")
    # Addresses alone tell which blobs repeat; a blob that many rows hold is counted, and later chosen from, by every task first.
    repeated = saved(held.groupBy("blob").count().filter("count > 1").select("blob"))
    few = if_small(repeated, 80)
    once = held.join(few, "blob", "left_anti")
    several = held.join(few, "blob", "left_semi").groupBy("blob").agg(F.first("text").alias("text"))
    scanned = once.union(several).mapInArrow(_scan_batches, f"blob string, spans {SPAN}")
    return scanned.select("blob", F.lit(rule_version).alias("rule_version"), "spans")


def findings(docs: DataFrame, ledger: DataFrame | None = None, path: str = "doc_id", text: str = "text", rule_version: str = RULE_VERSION, version: str | None = None) -> DataFrame:
    """(path, [version,] blob, spans) for every row of ``docs``; scans what the ledger lacks."""
    known = _known(docs, ledger, text, rule_version)
    keys = [F.col(path).alias("path"), *([F.col(version).alias("version")] if version else [])]
    found = docs.select(*keys, address(text).alias("blob")).join(known, "blob", "left")
    return found.select("path", *(["version"] if version else []), "blob", F.coalesce("spans", F.array().cast(SPAN)).alias("spans"))


def _known(docs: DataFrame, ledger: DataFrame | None, text: str, rule_version: str) -> DataFrame:
    """(blob, spans) of the blobs in which something was found: most hold nothing, and need not be joined."""
    known = scan_unseen(docs, ledger, text, rule_version).select("blob", "spans")
    if ledger is not None:
        known = known.union(ledger.filter(F.col("rule_version") == rule_version).dropDuplicates(["blob"]).select("blob", "spans"))
    return known.filter(F.size("spans") > 0)


def redact(docs: DataFrame, ledger: DataFrame | None = None, text: str = "text", chars: str | None = "n_chars") -> DataFrame:
    """``docs`` with every finding in ``text`` replaced by ``[SECRET]``; overlapping findings give one mark.

    All columns stay; ``chars``, if there is such a column, is counted anew where the text has changed.
    """
    blob, spans, key = (tmp_name(docs.columns, n) for n in ("blob", "spans", "key"))
    with scratch(docs.sparkSession) as keep:
        known = keep(_known(docs, ledger, text, RULE_VERSION).select(F.col("blob").alias(key), F.col("spans").alias(spans)))
    joined = docs.withColumn(blob, address(text)).join(if_small(known, 400), F.col(blob) == F.col(key), "left")

    @F.pandas_udf("string")
    def cut(t, s):
        import pandas as pd

        return pd.Series([_cut(x, y) for x, y in zip(t, s, strict=True)])

    clean = F.when(F.col(spans).isNull(), F.col(text)).otherwise(cut(F.col(text), F.col(spans)))
    out = joined.withColumn(text, clean)
    if chars in docs.columns:
        out = out.withColumn(chars, F.when(F.col(spans).isNull(), F.col(chars)).otherwise(F.length(F.col(text)).cast(docs.schema[chars].dataType)))
    return out.select(*docs.columns)


def _cut(text: str | None, spans) -> str | None:
    if text is None or spans is None:
        return text
    out, at = [], 0
    for s, e in sorted((x["start"], x["end"]) for x in spans):
        if s >= at:
            out += [text[at:s], "[SECRET]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, through a stored ledger that grows in two increments.

    The first increment brings the documents of even digest of their id, the second the others, whose copies of what
    the ledger already holds are not scanned again. All paths are answered from the whole ledger.
    """
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    folder = f"{spark.sparkContext.getCheckpointDir()}/ledger-{uuid.uuid4().hex}"
    later = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1
    update_ledger(docs.filter(~later), folder)
    ledger = update_ledger(docs.filter(later), folder)
    known = ledger.filter((F.col("rule_version") == RULE_VERSION) & (F.size("spans") > 0)).select("blob", "spans")
    found = docs.select(F.col("doc_id").alias("path"), address("text").alias("blob")).join(if_small(known, 400), "blob", "left").withColumn("spans", F.coalesce("spans", F.array().cast(SPAN)))
    text = lambda only: F.array_join(F.transform(F.filter("spans", only), lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        F.col("path").alias("doc_id"),
        *(count(k).alias(f"n_{k}") for k in BASE),
        F.sha2(text(lambda x: x["kind"].isin(*BASE)), 256).alias("base_sha256"),
        text(lambda x: F.lit(True)).alias("spans"),
    )
