"""Document fingerprints by order MinHash, in DataFrame and SQL functions only.

A text is cut at white space into tokens, and a run of over 100 characters without white space into its characters,
whatever else the text holds. Each position gives a k-mer of tokens, the last ones shorter; equal k-mers of a text are numbered in
text order, and each numbered k-mer is hashed onto a circle. The circle has a fixed number of starts; from each start the
few k-mers that come next are taken, put back into text order and hashed together. The signature holds one such tuple
hash for each start, for a text of any length: the tuples of a short text span several starts. As tuples keep text order,
moving passages changes the signature, as edit distance does and set similarity does not.

Numbering uses arrays alone: the k-mer hashes are sorted with their positions in the low bits, and an element that
equals the one before it finds how far back its run goes by doubling steps, so a text of n tokens costs n log n.

Neighbours are found in ranges of rows by (descending id, digest of the text). Ranges hold about equal shares of a bounded
number of bytes each, at two levels of quantiles of a sample, so their number follows the data and no row is compared
with more than the square root of it; inside a range a window finds the next row, and the last row of a range is
followed by the first row of the next one.

Defined results: null is the empty text, whose one token is empty; equal texts have equal fingerprints; in the
neighbour order (descending id) a null id counts as the least, and rows of equal id go by a digest of the text; columns
other than id and text are ignored; the only row of a table is its own next document; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sealmark.llm._common import if_small, prepare, saved, scratch, table, text_or_empty

K = 3
TUPLE = 2
#: Starts on the circle, as a power of two.
BITS = 6
#: Text in a range of rows, and rows of the sample for each quantile.
RANGE_BYTES, SAMPLED = 32 << 20, 40

_POS = 27  # bits of a position; 36 bits of hash are above it
_HASH = (1 << 36) - 1


def with_signature(df: DataFrame, text: str, out: str, k: int = K, size: int = TUPLE, bits: int = BITS) -> DataFrame:
    """``df`` with array<bigint> ``out``: the 32-bit tuple hash of each start.

    Every step is a column of its own, used more than once by the next, so the optimizer keeps them apart and
    evaluates each once.
    """
    w, s, t, f, h = (f"{out}_{x}" for x in "wstfh")
    top, pos = _POS + 36 - bits, (1 << _POS) - 1
    more = "".join(f", get({w}, i + {j})" for j in range(1, k))
    run = f"aggregate(sequence(cast(log2(size({s})) AS int), 0, -1), 0, (d, b) -> IF(coalesce(shiftright(get({s}, i - d - shiftleft(1, b)), {_POS}) = shiftright(x, {_POS}), false), d + shiftleft(1, b), d))"
    occurrence = f"CASE WHEN shiftright(get({s}, i - 1), {_POS}) = shiftright(x, {_POS}) THEN {run} ELSE 0 END"
    # From element i on, around the end of the circle, in text order.
    taken = f"array_sort(transform(sequence(0, least({size}, size({t})) - 1), j -> shiftleft(get({t}, pmod(i + j, size({t}))) & {pos}L, 36) | shiftright(get({t}, pmod(i + j, size({t}))), {_POS})))"
    start = lambda i: f"cast(shiftright(get({t}, {i}), {top}) AS int)"
    steps = [
        # Both branches cut alike; the second is for texts without a long run, where nothing is left to flatten.
        (w, f"CASE WHEN {text} RLIKE '\\\\S{{101}}' THEN flatten(transform(split({text}, '\\\\s+'), v -> CASE WHEN length(v) > 100 THEN split(v, '') ELSE array(v) END)) ELSE split({text}, '\\\\s+') END"),
        (s, f"sort_array(transform({w}, (x, i) -> shiftleft(xxhash64(x{more}) & {_HASH}L, {_POS}) | cast(i AS bigint)))"),
        (t, f"sort_array(transform({s}, (x, i) -> shiftleft(xxhash64(shiftright(x, {_POS}), {occurrence}) & {_HASH}L, {_POS}) | (x & {pos}L)))"),
        # The elements that are the first after some start, and their tuples' hashes.
        (f, f"filter(transform({t}, (y, i) -> IF(coalesce(shiftright(get({t}, i - 1), {top}), -1) != shiftright(y, {top}), i, -1)), i -> i >= 0)"),
        (h, f"transform({f}, i -> xxhash64(transform({taken}, q -> q & {_HASH}L)) & 4294967295L)"),
        # Each hash once for every start that it is the first after; starts after the last element go on to the first.
        (out, f"flatten(array_append(transform({f}, (i, n) -> array_repeat(get({h}, n), {start('i')} - IF(n = 0, -1, {start(f'get({f}, n - 1)')}))), array_repeat(get({h}, 0), {(1 << bits) - 1} - {start(f'size({t}) - 1')})))"),
    ]
    for name, sql in steps:
        df = df.withColumn(name, F.expr(sql))
    return df.drop(w, s, t, f, h)


def fingerprint(signature: str) -> Column:
    """A signature as text: eight hexadecimal digits for each start."""
    return F.array_join(F.transform(signature, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def likeness(a: str, b: str) -> Column:
    """Share of the starts from which both signatures agree, 0 to 1."""
    return (F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda v: v)) / F.size(a)).cast("double")


def signatures(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, signature, fingerprint) of every row."""
    own = docs.select(F.col(id_col).alias("id"), text_or_empty(text).alias("text"))
    return with_signature(own, "text", "signature").select("id", "signature", fingerprint("signature").alias("fingerprint"))


def _place(value: Column, splits: Column) -> Column:
    """The place of ``value`` among the sorted ``splits``, from 1: equal values share it, greater values have no lesser one."""
    return F.array_position(F.sort_array(F.array_append(splits, value)), value)


def _ranged(docs: DataFrame, range_bytes: int, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``docs`` with ``range``, a number that does not fall as ``key`` rises."""
    rows, size = docs.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    wide = max(1, math.ceil(math.sqrt((size or 0) / range_bytes)))  # ranges of each of the two levels
    seen = lambda want: docs.select("key").filter(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < max(1, min(1 << 30, (1 << 30) * want // max(rows, 1))))
    # A sample of about SAMPLED * wide keys, the square root of the data's ranges, comes to the driver.
    first = sorted(r[0] for r in seen(SAMPLED * wide).collect()) if wide > 1 else []
    tops = [first[i * len(first) // wide] for i in range(1, wide)] if first else []
    splits = F.array(*(F.lit(x) for x in tops)).cast("array<string>")
    topped = docs.withColumn("top", _place(F.col("key"), splits))
    if not tops:
        return topped.withColumnRenamed("top", "range")
    listed = seen(SAMPLED * wide * wide).withColumn("top", _place(F.col("key"), splits)).groupBy("top").agg(F.sort_array(F.collect_list("key")).alias("keys"))
    inner = keep(listed.select("top", F.transform(F.sequence(F.lit(1), F.lit(wide - 1)), lambda i: F.get("keys", (i * F.size("keys") / wide).cast("int"))).alias("inner")))
    met = topped.join(if_small(inner, 48 * wide), "top", "left")
    return met.withColumn("range", F.col("top") * (wide + 1) + _place(F.col("key"), F.coalesce("inner", F.array().cast("array<string>")))).drop("top", "inner")


def with_next(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(doc_id, text, sig, next_text, next_sig) of (doc_id, text) rows, with the next document by descending id; after the last, the first."""
    spark = docs.sparkSession
    unsigned = lambda c: F.lpad(F.hex(c), 16, "0")
    # Ascending keys are descending ids, each followed by a digest of the text.
    order = F.bitwise_not(F.coalesce("doc_id", F.lit(-(1 << 63))).cast("long").bitwiseXOR(F.lit(-(1 << 63))))
    with scratch(spark) as keep:
        ranged = _ranged(docs.withColumn("key", F.concat(unsigned(order), unsigned(F.xxhash64("text")))), range_bytes, keep)
        heads = saved(ranged.groupBy("range").agg(F.min("key").alias("head")))  # one row a range
        found = sorted(r[0] for r in heads.select("range").collect())
        at, known = F.col("id").cast("int"), F.lit(found or [0]).cast("array<bigint>")
        after = spark.range(len(found)).select(F.get(known, at).alias("before"), F.get(known, (at + 1) % max(len(found), 1)).alias("range"))
        first = keep(with_signature(docs_of(heads.join(after, "range"), ranged), "head_text", "head_sig"))
    w = Window.partitionBy("range").orderBy("key", "text")
    own = with_signature(ranged, "text", "sig")
    led = own.withColumns({"lead_text": F.lead("text").over(w), "lead_sig": F.lead("sig").over(w)})
    return led.join(if_small(first, 4096), F.col("range") == F.col("before"), "left").select("doc_id", "text", "sig", F.coalesce("lead_text", "head_text").alias("next_text"), F.coalesce("lead_sig", "head_sig").alias("next_sig"))


def docs_of(heads: DataFrame, ranged: DataFrame) -> DataFrame:
    """(before, head_text): the text of the first row of each range, by the number of the range before it."""
    met = ranged.select("key", "text").join(if_small(heads.select("before", "head"), 40), F.col("key") == F.col("head"))
    return met.groupBy("before").agg(F.min("text").alias("head_text"))


def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", text_or_empty("text").alias("text"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_text", F.lit(1), half))
    rows = with_next(docs).withColumn("n_chars", F.length("text").cast("long")).withColumn("edited", edited)
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "edited", "sig", "next_sig")
    both = with_signature(rows, "edited", "edited_sig")
    return both.select("doc_id", "n_chars", "edited_sha256", fingerprint("sig").alias("fingerprint"), fingerprint("edited_sig").alias("edited_fingerprint"), likeness("sig", "edited_sig").alias("near_edited"), likeness("sig", "next_sig").alias("near_next"))
