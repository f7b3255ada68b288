"""Quality classifier: interpolated modified Kneser-Ney perplexity, thresholded by quantiles of each language.

The model is of characters (orders 1 to 4), because invented, misspelt or rare words then still share statistics and
the distinct n-grams of a block of documents are far fewer than its words. It is trained on trusted text: the
documents whose labels all say good and not toxic, but for those held out. Counts, continuation counts, discounts and probabilities are
DataFrames keyed by (language, n-gram); nothing of them passes the driver.

Scoring joins shards. Documents are dealt to blocks; each block asks once for each of its distinct n-grams; the
questions meet the model in a join on (language, n-gram), and the answers meet the block's documents again. So what
is shuffled is a block's distinct n-grams, not its n-gram occurrences. A document is kept if its perplexity lies
between two quantiles of the perplexities of trusted documents that are held out of the training, of its language and
about its length: the mean over many characters hardly varies among trusted documents, so a long text that repeats a
few words, of which each for itself is likely enough, stands out as clearly as one of strange characters.

Defined results: a null text is the empty text (it has one n-gram, its end); a null language is a language of its
own; a language without trusted documents gives a null perplexity, one with under ``FEWEST`` held-out ones null bounds,
and both keep their documents; repeated rows are each scored; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sealmark.llm._common import BATCH_ROWS, arrow_rows, if_small, prepare, saved, scratch, shuffle_parts, table, text_or_empty, tmp_name

ORDER = 4
#: Quantiles of the held-out trusted documents' log perplexity, by language and length, between which a document is kept.
LOW, HIGH = 0.001, 0.999
#: Length classes are powers of this many characters. A class with fewer held-out documents than ``ENOUGH`` borrows those
#: of the next shorter classes, and then of longer ones, until it has as many or there are no more. A mean over more characters
#: scatters less: the deviation of a borrowed document shrinks by the ratio of the lengths to this power (it would be 1/2 for
#: independent characters, by which it grows from a longer class).
CLASS_RATIO, CLASSES, ENOUGH, SHRINK = 4, 16, 100, 1 / 3
#: With fewer held-out documents than this there is no threshold.
FEWEST = 8
#: Share of the trusted documents that the model does not see and the quantiles are taken of.
HELD_OUT = 0.2
#: Raw text in a block of documents.
BLOCK_BYTES = 16 << 20

_B = 15  # bits of a symbol
_MASK = (1 << _B) - 1
_VOCABULARY = 1 << _B
_TAG = 60  # the order of an n-gram stands above its symbols
_CHUNK = 500_000  # characters handled at once
#: Bytes of rows that a task holds while it packs them by block.
_HELD = 16 << 20
_EDGE = "\U0010ffff"


def _symbols() -> np.ndarray:
    """Symbol by code point: itself up to a bound, one of 1,000 shared symbols beyond it; white space and digits are one symbol each."""
    points = np.arange(0x110000, dtype=np.uint32)
    direct = _VOCABULARY - 1024
    out = np.where(points < direct, points, direct + (points * np.uint32(2654435761) >> np.uint32(16)) % np.uint32(1000)).astype(np.int64)
    out[[9, 10, 11, 12, 13, 160]] = 32
    out[48:58] = 48
    out[0x10FFFF] = _MASK
    return out


_TABLE: list[np.ndarray] = []


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of highest order of all texts in turn, and their number per text (its characters and its end)."""
    if not _TABLE:
        _TABLE.append(_symbols())
    pad = _EDGE * (ORDER - 1)
    points = np.frombuffer((pad + pad.join(texts) + _EDGE).encode("utf-32-le", "surrogatepass"), np.uint32)
    s = _TABLE[0][points]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    g = s[ORDER - 1 :].copy()
    for j in range(1, ORDER):
        g |= s[ORDER - 1 - j : len(s) - j] << (_B * j)
    # After a text come its end and the rest of the next text's padding, where no n-gram of either ends.
    skip = ORDER - 2
    if skip:
        ends = np.cumsum(sizes + skip)[:-1]
        keep = np.ones(len(g), bool)
        for j in range(1, skip + 1):
            keep[ends - j] = False
        g = g[keep]
    return g, sizes


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``_CHUNK`` characters; a longer text is a range of its own."""
    first = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > _CHUNK:
            yield first, i
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield first, len(texts)


def _by_language(langs: list[str | None], texts: list[str]) -> dict[str | None, list[int]]:
    found: dict[str | None, list[int]] = {}
    for i, lang in enumerate(langs):
        found.setdefault(lang, []).append(i)
    return found


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([p[0] for p in parts])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], np.concatenate([p[1] for p in parts])[order]
    first = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1)) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str | None, list[tuple[np.ndarray, np.ndarray]]] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            keys, counts = _merged(parts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(counts)], names=["lang", "gram", "c"])
        held.clear()

    for b in batches:
        langs, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
        for lang, rows in _by_language(langs, texts).items():
            own = [texts[i] for i in rows]
            for i, j in _chunks(own):
                keys, counts = np.unique(grams(own[i:j])[0], return_counts=True)
                parts = held.setdefault(lang, [])
                parts.append((keys, counts.astype(np.int64)))
                if len(parts) >= 8:
                    parts[:] = [_merged(parts)]
        if sum(len(p[0]) for parts in held.values() for p in parts) > 1_500_000:
            yield from out()
    yield from out()


def trusted_ids(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Ids whose labels all say good and not toxic."""
    own = labels.filter(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(F.coalesce("quality", F.lit(0))).alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
    return own.filter("q = 1 AND t = 0").select(id_col)


def counts(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, gram, c): how often each n-gram of highest order occurs in the documents of ``ids``."""
    chosen = docs.select(F.col(id_col), F.col(lang).alias("lang"), text_or_empty(text).alias("text")).join(if_small(ids, 16), id_col, "left_semi")
    own = chosen.select("lang", "text").mapInArrow(_count_batches, "lang string, gram long, c long")
    return own.groupBy("lang", "gram").agg(F.sum("c").alias("c"))


def model(top: DataFrame) -> DataFrame:
    """(lang, key, p, gamma) from counts of highest order.

    ``key`` is the order above the packed symbols. ``p`` is the interpolated probability of the n-gram's last symbol
    after the others; ``gamma`` the weight of the next lower order where the n-gram is a context. Below the highest
    order a count is the number of different symbols that stand before the n-gram.
    """
    t = {ORDER: saved(top)}
    for k in range(ORDER - 1, 0, -1):
        t[k] = saved(t[k + 1].groupBy("lang", F.col("gram").bitwiseAND((1 << _B * k) - 1).alias("gram")).agg(F.count("*").alias("c")))
    rows, lower = [], None
    for k in range(1, ORDER + 1):
        many = lambda n: F.sum((F.col("c") == n).cast("double"))
        seen = t[k].groupBy("lang").agg(*(many(i).alias(f"n{i}") for i in (1, 2, 3, 4)))
        y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))
        # Where the counts of counts give no discount in range, a fixed share is taken.
        d = lambda i: F.greatest(F.lit(0.1), F.least(F.lit(i - 0.1), F.coalesce(i - (i + 1) * y * F.try_divide(F.col(f"n{i + 1}"), F.col(f"n{i}")), F.lit(0.5 * i))))
        seen = seen.select("lang", *(d(i).alias(f"d{i}") for i in (1, 2, 3)))
        one = t[k].withColumn("ctx", F.shiftright("gram", _B))
        ctx = one.groupBy("lang", "ctx").agg(F.sum("c").alias("s"), many(1).alias("m1"), many(2).alias("m2"), F.sum((F.col("c") > 2).cast("double")).alias("m3"))
        same = lambda a, b, *on: F.col(f"{a}.lang").eqNullSafe(F.col(f"{b}.lang")) & F.lit(True) if not on else F.col(f"{a}.lang").eqNullSafe(F.col(f"{b}.lang")) & (F.col(f"{a}.{on[0]}") == F.col(f"{b}.{on[1]}"))
        ctx = ctx.alias("x").join(seen.alias("y"), same("x", "y")).select("x.*", "d1", "d2", "d3")
        ctx = saved(ctx.withColumn("gamma", (F.col("d1") * F.col("m1") + F.col("d2") * F.col("m2") + F.col("d3") * F.col("m3")) / F.col("s")).select("lang", "ctx", "s", "d1", "d2", "d3", "gamma"))
        less = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        own = one.alias("x").join(ctx.alias("y"), same("x", "y", "ctx", "ctx")).select("x.lang", "gram", ((F.col("c") - less) / F.col("s")).alias("own"), "gamma")
        if lower is None:
            p = own.select("lang", "gram", (F.col("own") + F.col("gamma") / _VOCABULARY).alias("p"))
        else:
            own = own.withColumn("suffix", F.col("gram").bitwiseAND((1 << _B * (k - 1)) - 1))
            p = own.alias("x").join(lower.alias("y"), same("x", "y", "suffix", "gram")).select("x.lang", "x.gram", (F.col("own") + F.col("gamma") * F.col("p")).alias("p"))
        lower = saved(p)
        tag = lambda c, n: F.col(c).bitwiseOR(F.lit(n << _TAG))
        rows += [lower.select("lang", tag("gram", k).alias("key"), "p", F.lit(None).cast("double").alias("gamma")), ctx.select("lang", tag("ctx", k - 1).alias("key"), F.lit(None).cast("double").alias("p"), "gamma")]
    both = rows[0]
    for r in rows[1:]:
        both = both.unionByName(r)
    return both.groupBy("lang", "key").agg(F.max("p").alias("p"), F.max("gamma").alias("gamma"))


# --- scoring -----------------------------------------------------------------------------------


def _questions(top: np.ndarray) -> np.ndarray:
    """Sorted keys of all orders that the probabilities of the given distinct n-grams may need."""
    out, now = [top | ORDER << _TAG], top
    for k in range(ORDER - 1, -1, -1):
        now = np.unique(np.concatenate([now >> _B, now & ((1 << _B * k) - 1)]))
        out.append(now | k << _TAG)
    return np.concatenate(out[::-1])


def _log_p(top: np.ndarray, keys: np.ndarray, p: np.ndarray, gamma: np.ndarray) -> np.ndarray:
    """Log probabilities of n-grams from the answers, sorted by key. NaN stands for what the model lacks."""

    def find(k: int, gram: np.ndarray, values: np.ndarray) -> np.ndarray:
        want = gram | k << _TAG
        at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
        return np.where(keys[at] == want, values[at], np.nan)

    total = np.full(len(top), 1.0 / _VOCABULARY)
    for k in range(1, ORDER + 1):
        gram = top & ((1 << _B * k) - 1)
        weight = find(k - 1, gram >> _B, gamma)
        seen = find(k, gram, p)
        total = np.where(np.isnan(seen), np.where(np.isnan(weight), 1.0, weight) * total, seen)
    return np.log(total)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one block that a task holds, as one compressed buffer of about 2 MB of text at least, or what it has at its end."""
    options = pa.ipc.IpcWriteOptions(compression="zstd")
    held: dict[int, list[pa.RecordBatch]] = {}
    size: dict[int, int] = {}

    def out(block: int) -> pa.RecordBatch:
        whole = pa.Table.from_batches(held.pop(block)).combine_chunks()
        size.pop(block)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, whole.schema, options=options) as w:
            w.write_table(whole)
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "data"])

    for b in batches:
        blocks = b.column(0).to_numpy()
        rest = b.select(["id", "lang", "text"])
        order = np.argsort(blocks, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(blocks[order])) + 1):
            if len(part):
                own, k = rest.take(pa.array(part)), int(blocks[part[0]])
                held.setdefault(k, []).append(own)
                size[k] = size.get(k, 0) + own.nbytes
        while sum(size.values()) > _HELD:
            yield out(max(size, key=size.get))
    for k in list(held):
        yield out(k)


def _unpack(data: bytes) -> tuple[pa.ChunkedArray, list[str | None], list[str]]:
    t = pa.ipc.open_stream(data).read_all()
    return t.column(0), t.column(1).to_pylist(), t.column(2).to_pylist()


def _ask(group: pa.Table) -> pa.Table:
    held: dict[str | None, list[np.ndarray]] = {}
    for data in group.column("data"):
        _, langs, texts = _unpack(data.as_py())
        for lang, rows in _by_language(langs, texts).items():
            own = [texts[i] for i in rows]
            parts = held.setdefault(lang, [])
            parts += [np.unique(grams(own[i:j])[0]) for i, j in _chunks(own)]
            if len(parts) >= 16:
                parts[:] = [np.unique(np.concatenate(parts))]
    found = {lang: _questions(np.unique(np.concatenate(parts))) for lang, parts in held.items()}
    langs = [pa.array([lang] * len(k), pa.string()) for lang, k in found.items()]
    keys = np.concatenate([*found.values(), np.zeros(0, np.int64)]).astype(np.int64)
    block = np.full(len(keys), group.column("block")[0].as_py(), np.int32)
    return pa.table({"block": block, "lang": pa.concat_arrays(langs or [pa.array([], pa.string())]), "key": keys})


def _answer(docs: pa.Table, answers: pa.Table) -> pa.Table:
    known: dict[str | None, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    if len(answers):
        names = answers.column("lang").combine_chunks().dictionary_encode()
        codes = names.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        key, p, gamma = (answers.column(c).to_numpy() for c in ("key", "p", "gamma"))
        for code in np.unique(codes):
            at = np.flatnonzero(codes == code)
            at = at[np.argsort(key[at])]
            known[names.dictionary[int(code)].as_py() if code >= 0 else None] = key[at], p[at], gamma[at]
    ids, langs_out, sizes_out, logs = [], [], [], []
    for data in docs.column("data"):
        own_ids, langs, texts = _unpack(data.as_py())
        log, size = np.full(len(texts), np.nan), np.zeros(len(texts), np.int64)
        for lang, rows in _by_language(langs, texts).items():
            own, rows = [texts[i] for i in rows], np.array(rows)
            for i, j in _chunks(own):
                g, n = grams(own[i:j])
                size[rows[i:j]] = n
                if lang in known:
                    top, at = np.unique(g, return_inverse=True)
                    log[rows[i:j]] = np.add.reduceat(_log_p(top, *known[lang])[at], np.cumsum(n) - n)
        ids.append(own_ids)
        langs_out += langs
        sizes_out.append(size)
        logs.append(log)
    perplexity = np.exp(-np.concatenate(logs) / np.maximum(np.concatenate(sizes_out), 1))
    return pa.table([pa.chunked_array([c for x in ids for c in x.chunks]), pa.array(langs_out, pa.string()), pa.array(np.concatenate(sizes_out)), pa.array(perplexity, from_pandas=True)], names=["id", "lang", "n_grams", "perplexity"])


def perplexities(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(id, lang, n_grams, perplexity) of every row of ``docs`` under the model ``known``."""
    spark = prepare(docs.sparkSession)
    own = docs.select(F.col(id_col).alias("id"), F.col(lang).alias("lang"), text_or_empty(text).alias("text"))
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(2 * spark.sparkContext.defaultParallelism, -(-size // BLOCK_BYTES))
    # By the place of the row, so that repeated rows and equal ids are dealt as well as others.
    dealt = own.select(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).cast("int").alias("block"), "id", "lang", "text")
    packed = dealt.mapInArrow(_pack, "block int, data binary").repartition(max(shuffle_parts(spark), blocks), "block")
    questions = packed.groupBy("block").applyInArrow(_ask, "block int, lang string, key long")
    q, m = questions.alias("q"), known.alias("m")
    answers = q.join(m, (F.col("q.key") == F.col("m.key")) & F.col("q.lang").eqNullSafe(F.col("m.lang"))).select("q.block", "q.lang", "q.key", F.col("p").cast("float").alias("p"), F.col("gamma").cast("float").alias("gamma"))
    kind = docs.schema[id_col].dataType.simpleString()
    return packed.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_answer, f"id {kind}, lang string, n_grams long, perplexity double")


def length_class(n: str | Column) -> Column:
    """The power of ``CLASS_RATIO`` in a number of characters."""
    return F.least(F.floor(F.log(F.greatest(n, F.lit(1))) / math.log(CLASS_RATIO) + 1e-9), F.lit(CLASSES - 1)).cast("int")


def thresholds(scored: DataFrame, trusted: DataFrame, held_out: DataFrame, low: float = LOW, high: float = HIGH, enough: int = ENOUGH) -> DataFrame:
    """(lang, length_class, least, most): the kept range of perplexities by language and length.

    The upper bound is of the held-out documents, the lower one of all trusted documents: those that the model was
    trained on, and their copies, surprise it less than others do.
    """
    below, above = _quantiles(scored, trusted, low, high, enough), _quantiles(scored, held_out, low, high, enough)
    met = below.alias("b").join(above.alias("a"), F.col("b.lang").eqNullSafe(F.col("a.lang")) & (F.col("b.length_class") == F.col("a.length_class")))
    return met.select("b.lang", "b.length_class", "b.least", "a.most")


def _quantiles(scored: DataFrame, ids: DataFrame, low: float, high: float, enough: int) -> DataFrame:
    """(lang, length_class, least, most) of the documents of ``ids``.

    A quantile that lies beyond a sample of n documents is read from it as if the tail were exponential: the distance
    of the sample's end from the median grows by the ratio of the logarithms of e / share and n (e for the error of the
    sample's own end).
    """
    own = scored.join(ids.withColumnRenamed(ids.columns[0], "id"), "id", "left_semi").filter(F.col("perplexity").isNotNull())
    own = own.select("lang", length_class("n_grams").alias("own_class"), F.log("perplexity").alias("x"))
    middle = own.groupBy("lang").agg(F.percentile_approx("x", 0.5, 10_000).alias("m"))
    own = own.alias("o").join(F.broadcast(middle).alias("r"), F.col("o.lang").eqNullSafe(F.col("r.lang"))).select("o.lang", "own_class", "m", "x", F.explode(F.sequence(F.lit(0), F.lit(CLASSES - 1))).alias("length_class"))
    # Each document counts in its own class, and further ``away`` in every longer one, and last in the shorter ones.
    gap = F.col("length_class") - F.col("own_class")
    own = own.withColumn("away", F.when(gap >= 0, gap).otherwise(CLASSES - gap)).withColumn("x", F.col("m") + (F.col("x") - F.col("m")) * F.pow(F.lit(float(CLASS_RATIO)), -gap * F.when(gap >= 0, SHRINK).otherwise(0.5)))
    each = own.groupBy("lang", "length_class", "away").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("lang", "length_class").orderBy("away")  # CLASSES rows at most
    wanted = each.withColumn("before", F.coalesce(F.sum("n").over(upto.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).filter(F.col("before") < enough)
    reach = wanted.groupBy("lang", "length_class").agg(F.max("away").alias("reach"))
    met = own.alias("o").join(F.broadcast(reach).alias("r"), F.col("o.lang").eqNullSafe(F.col("r.lang")) & (F.col("o.length_class") == F.col("r.length_class")) & (F.col("away") <= F.col("reach")))
    found = met.groupBy("o.lang", "o.length_class").agg(F.percentile_approx("x", [low, 0.5, high], 10_000).alias("q"), F.count("*").alias("n")).filter(F.col("n") >= FEWEST)
    bound = lambda i, share: F.exp(F.col("q")[1] + (F.col("q")[i] - F.col("q")[1]) * F.greatest(F.lit(1.0), F.lit(1 - math.log(share)) / F.log("n")))
    return found.select("lang", "length_class", bound(0, low).alias("least"), bound(2, 1 - high).alias("most"))


def _judged(docs: DataFrame, labels: DataFrame, id_col: str, text: str, lang: str, low: float, high: float, enough: int) -> DataFrame:
    """What ``classify`` gives, and ``key``, the digest of the row's text."""
    spark = prepare(docs.sparkSession)
    row = tmp_name(docs.columns, "row")
    marked = docs.withColumn(row, F.struct(F.col(id_col).alias("id"), _digest(text).alias("key")))
    with scratch(spark) as keep:
        ids = saved(trusted_ids(labels).withColumn("out", F.pmod(F.xxhash64(id_col), F.lit(1000)) < int(1000 * HELD_OUT)))
        held_out, trained, trusted = ids.filter("out").drop("out"), ids.filter("NOT out").drop("out"), ids.drop("out")
        with arrow_rows(spark, BATCH_ROWS):
            known = saved(model(counts(docs, trained, id_col, text, lang)))
            scored = keep(perplexities(marked, known, row, text, lang).select("id.id", "id.key", "lang", "n_grams", "perplexity"))
        bounds = keep(thresholds(scored, trusted, held_out, low, high, enough))
    s, t = scored.alias("s"), F.broadcast(bounds).alias("t")  # CLASSES rows a language
    met = s.join(t, F.col("s.lang").eqNullSafe(F.col("t.lang")) & (length_class("n_grams") == F.col("t.length_class")), "left")
    stays: Column = F.coalesce(F.col("perplexity").between(F.col("least"), F.col("most")), F.lit(True))
    return met.select("s.id", "s.key", "s.lang", "n_grams", "perplexity", "least", "most", stays.alias("keep"))


def _digest(text: str) -> Column:
    return F.unhex(F.substring(F.sha2(text_or_empty(text), 256), 1, 32))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", low: float = LOW, high: float = HIGH, enough: int = ENOUGH) -> DataFrame:
    """(id, lang, n_grams, perplexity, least, most, keep) for every row of ``docs``."""
    return _judged(docs, labels, id_col, text, lang, low, high, enough).drop("key")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``docs`` that are kept, with all of their columns. Each is judged by its own text, whatever its id."""
    key, *own = (tmp_name(docs.columns, c) for c in ("key", "bad_id", "bad_key", "bad_lang"))
    bad = _judged(docs, labels, id_col, text, lang, LOW, HIGH, ENOUGH).filter(~F.col("keep"))
    bad = saved(bad.select(*(F.col(c).alias(o) for c, o in zip(("id", "key", "lang"), own, strict=True))).distinct())
    same = F.col(key) == F.col(own[1])
    for c, o in ((id_col, own[0]), (lang, own[2])):
        same &= F.col(c).eqNullSafe(F.col(o))
    return docs.withColumn(key, _digest(text)).join(if_small(bad, 48), same, "left_anti").select(*docs.columns)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).withColumnRenamed("id", "doc_id")
