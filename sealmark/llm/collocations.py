"""Phrase collocations: phrases whose words come together more often than apart, by language.

Documents are dealt to shards of bounded size, in the order in which they are read. A shard numbers its words, sorts the places of
its words by the two, then four words from there on (prefix doubling over word ids, in numpy) to a suffix array; where the
common prefix of neighbours is shorter than d words, one interval of phrases of d words ends and the next begins, and the length of an
interval is a count. The counts of all shards are merged by phrase.

Most phrases are rare everywhere, so they are not shuffled as text. Every shard first asks whether its phrases are frequent:
it sends four bytes of a hash and one of a count each, in sorted blocks; who holds a block adds the counts of all shards up and answers with one
bit each. Only what may be frequent (hashes may meet, counts are exact) then moves as text. The number of blocks grows with the texts.

Defined results: a null text is empty, a null language is ``und``; repeated rows count as often as they occur; an empty input gives no
rows; other columns are ignored; texts of any length are counted whole, in parts that overlap by the words of a phrase. Rows must come
in the same order whenever the input is read, as those of files do: a shard that finds other phrases than it asked about fails.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sealmark.llm._common import mix, prepare, saved, scratch, table

# What ends a piece, what ends a word, and the language of texts without one.
PIECE_ENDS, WORD_ENDS, NO_LANG = b".,;:!?\n\x0b\x0c\r", b" \t", "und"
MAX_WORDS, LEAST, SHARE, TOP, SCALE = 3, 10, 50, 2000, 1_000_000
#: Bytes of text in a shard, and phrases that a block is made for.
SHARD = 8 << 20
BLOCK = 1 << 21
_MARK = b"."
_PLAIN = bytes(_MARK[0] if i in PIECE_ENDS else 32 if i in WORD_ENDS else i + 32 if 65 <= i <= 90 else i for i in range(256))
_WORD = re.compile(b"[^" + re.escape(PIECE_ENDS + WORD_ENDS) + b"]+")
Part = tuple[str, bytes, int]  # language, text, bytes of it whose words begin phrases


def words(text: bytes) -> list[bytes]:
    """Lower-case words, with one mark for whatever ends a piece."""
    return text.translate(_PLAIN).replace(_MARK, b" . ").split()


def parts(text: bytes, size: int, most: int) -> Iterator[tuple[bytes, int]]:
    """``text`` in parts of about ``size`` bytes that end between words, each with the words that follow and that its phrases may reach."""
    at = 0
    while len(text) - at > size:
        end, reach, n = at + size, 0, 0
        inside = _WORD.match(text, end)
        end = inside.end() if inside else end
        for n, m in enumerate(_WORD.finditer(text, end), 1):
            reach = m.end()
            if n == most - 1:
                break
        if not n:
            break
        yield text[at : max(end, reach)], end - at
        at = end
    yield text[at:], len(text) - at


class Shard:
    """Phrases of up to ``most`` words of some texts and their numbers; ``phrases`` gives them in the order of ``hashes`` and ``counts``."""

    def __init__(self, texts: list[Part], most: int = MAX_WORDS):
        self.most, self.found = most, []  # (language, number of words, places, counts, ids, dictionary)
        hashes, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        by: dict[str, list[tuple[bytes, int]]] = {}
        for lang, text, own in texts:
            by.setdefault(lang, []).append((text, own))
        self.totals: dict[str, int] = {}
        for lang in sorted(by):
            ids, begins, vocabulary = self._numbered(by[lang])
            self.totals[lang] = int(begins.sum())
            seed = xxhash.xxh3_64_intdigest(lang.encode())
            word = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in vocabulary.to_pylist()), np.uint64, len(vocabulary))
            word = np.concatenate([np.zeros(1, np.uint64), word])
            for d, at, n in self._intervals(ids, begins):
                h = np.full(len(at), d, np.uint64)
                for i in range(d):
                    h = mix(h * np.uint64(0x9FB21C651E98DF25) + word[ids[at + i]])
                hashes.append(h)
                counts.append(n)
                self.found.append((lang, d, at, n, ids, vocabulary))
        self.hashes, self.counts = np.concatenate(hashes), np.concatenate(counts)

    def _numbered(self, texts: list[tuple[bytes, int]]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """Word ids from 1, 0 for a mark; which of them begin phrases that count here; the words."""
        whole = b".".join(t for t, own in texts if own == len(t))
        tokens = words(whole)
        spare: list[tuple[int, int]] = []  # words that only follow
        for text, own in texts:
            if own < len(text):
                tokens += [_MARK, *words(text[:own])]
                follow = words(text[own:])
                spare.append((len(tokens), len(tokens) + len(follow)))
                tokens += follow
        tokens += [_MARK] * self.most
        coded = pa.array(tokens, pa.binary()).dictionary_encode()
        del tokens
        vocabulary = coded.dictionary
        mark = pc.index(vocabulary, pa.scalar(_MARK, pa.binary())).as_py()
        ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1
        ids[ids == mark + 1] = 0
        begins = ids > 0
        for a, b in spare:
            begins[a:b] = False
        return ids, begins, vocabulary

    def _suffixes(self, ids: np.ndarray) -> np.ndarray:
        """Places in the order of the ``most`` words from there on, or more: each round doubles what the ranks tell apart."""
        rank, known = ids, 1
        order = np.argsort(rank, kind="stable") if self.most == 1 else None
        while known < self.most:
            after = np.zeros_like(rank)
            after[:-known] = rank[known:]
            key = rank * (int(rank.max()) + 1) + after
            order = np.argsort(key, kind="stable")
            key = key[order]
            rank = np.empty_like(key)
            rank[order] = np.cumsum(np.diff(key, prepend=key[:1]) != 0)
            known *= 2
        return order

    def _intervals(self, ids: np.ndarray, begins: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(number of words, a place of each phrase, its number) for phrases of one word up."""
        order = self._suffixes(ids)
        order = order[begins[order]]
        for d in range(1, self.most + 1):
            order = order[ids[order + d - 1] > 0]  # the phrase goes on within its piece
            if not len(order):
                return
            other = np.zeros(len(order), bool)  # where the common prefix with the neighbour before is under d words
            other[0] = True
            for i in range(d):
                x = ids[order + i]
                other[1:] |= x[1:] != x[:-1]
            first = np.flatnonzero(other)
            yield d, order[first], np.diff(first, append=len(order))

    def phrases(self, wanted: np.ndarray) -> Iterator[tuple[str, int, pa.Array, np.ndarray]]:
        """(language, number of words, phrases, numbers) of the ``wanted`` ones."""
        begin = 0
        for lang, d, at, n, ids, vocabulary in self.found:
            pick = wanted[begin : begin + len(at)]
            begin += len(at)
            at, n = at[pick], n[pick]
            text = [vocabulary.take(pa.array(ids[at + i] - 1)) for i in range(d)]
            yield lang, d, (pc.binary_join_element_wise(*text, b" ") if d > 1 else text[0]).cast(pa.string()), n


def _dealt(batches: Iterator[pa.RecordBatch], size: int, most: int) -> Iterator[tuple[int, list[Part]]]:
    """(shard, its texts): what is read, in order."""
    shard, held, full = TaskContext.get().partitionId() << 32, [], 0
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            for part, own in parts(text.as_py(), size, most):
                held.append((lang, part, own))
                full += len(part) + 1
                if full >= size:
                    yield shard, held
                    shard, held, full = shard + 1, [], 0
    if held:
        yield shard, held


def _split(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by block and hash, block of each in that order, and its four bytes."""
    block = (hashes >> np.uint64(32)) % np.uint64(blocks)
    low = hashes & np.uint64(0xFFFFFFFF)
    order = np.argsort(block << np.uint64(32) | low, kind="stable")
    return order, block[order].astype(np.int64), low[order].astype(np.uint32)


def _runs(block: np.ndarray) -> list[tuple[int, int]]:
    """(begin, end) of the runs of equal blocks."""
    ends = np.append(np.flatnonzero(np.diff(block, prepend=-1)), len(block)).tolist()
    return list(zip(ends, ends[1:], strict=False))


def _asked(size: int, most: int, blocks: int):
    names = ["shard", "block", "hashes", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, texts in _dealt(batches, size, most):
            s = Shard(texts, most)
            order, block, low = _split(s.hashes, blocks)
            few = np.minimum(s.counts[order], 255).astype(np.uint8)
            rows = [(int(block[a]), low[a:e].tobytes(), few[a:e].tobytes()) for a, e in _runs(block)]
            for i in range(0, len(rows), 4096):
                some = rows[i : i + 4096]
                kinds = (pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([shard] * len(some), pa.int64()), *(pa.array(c, k) for c, k in zip(zip(*some, strict=True), kinds, strict=True))], names=names)

    return run


def _answered(least: int):
    def run(group: pa.Table) -> pa.Table:
        shards, blocks, blobs = group.column("shard").to_pylist(), group.column("block"), group.column("hashes").to_pylist()
        low = np.frombuffer(b"".join(blobs), np.uint32)
        counts = np.frombuffer(b"".join(group.column("counts").to_pylist()), np.uint8)
        order = np.argsort(low, kind="stable")
        first = np.flatnonzero(np.diff(low[order].astype(np.int64), prepend=-1))
        total = np.add.reduceat(counts[order].astype(np.int64), first)
        yes = np.empty(len(low), bool)
        yes[order] = np.repeat(total >= least, np.diff(first, append=len(low)))
        ends = np.cumsum([len(b) // 4 for b in blobs])
        bits = [np.packbits(x).tobytes() for x in np.split(yes, ends[:-1])]
        return pa.table({"shard": pa.array(shards, pa.int64()), "block": blocks, "bits": pa.array(bits, pa.binary()), "n": pa.array([len(b) // 4 for b in blobs], pa.int64()), "crc": pa.array([crc32(b) for b in blobs], pa.int64())})

    return run


def _parts_of(size: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, texts in _dealt(batches, size, most):
            lang, text, own = zip(*texts, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([shard] * len(text), pa.int64()), pa.array(lang, pa.string()), pa.array(text, pa.binary()), pa.array(own, pa.int64())], names=["shard", "lang", "text", "own"])

    return run


def _counted(most: int, blocks: int):
    out = pa.schema([("lang", pa.string()), ("words", pa.int32()), ("phrase", pa.string()), ("n", pa.int64())])

    def run(answers: pa.Table, texts: pa.Table) -> pa.Table:
        # The order of texts in a shard changes no count; hashes are sorted, so it does not change theirs either.
        s = Shard(list(zip(texts.column("lang").to_pylist(), texts.column("text").to_pylist(), texts.column("own").to_pylist(), strict=True)), most)
        order, block, low = _split(s.hashes, blocks)
        held = sorted(zip(*(answers.column(c).to_pylist() for c in ("block", "n", "crc", "bits")), strict=True))
        here = [(int(block[a]), e - a, crc32(low[a:e].tobytes())) for a, e in _runs(block)]
        if here != [h[:3] for h in held]:
            raise ValueError("a shard has other phrases than it asked about: its input was not read in the same order twice")
        wanted = np.zeros(len(order), bool)
        if held:
            wanted[order] = np.concatenate([np.unpackbits(np.frombuffer(h[3], np.uint8), count=h[1]) for h in held]).astype(bool)
        got = [pa.table([pa.array([lang], pa.string()), pa.array([0], pa.int32()), pa.array([""], pa.string()), pa.array([n], pa.int64())], schema=out) for lang, n in s.totals.items()]
        for lang, d, phrase, n in s.phrases(wanted):
            got.append(pa.table([pa.array([lang] * len(n), pa.string()), pa.array([d] * len(n), pa.int32()), phrase, pa.array(n, pa.int64())], schema=out))
        return pa.concat_tables([out.empty_table(), *got])

    return run


def phrase_counts(docs: DataFrame, text: str = "text", lang: str = "lang", most: int = MAX_WORDS, least: int = LEAST, shard: int = SHARD) -> DataFrame:
    """(lang, words, phrase, n): every phrase of up to ``most`` words that occurs ``least`` times, and the words of each language as the phrase of none."""
    prepare(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(lang), F.lit(NO_LANG)).alias("lang"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // (2 * BLOCK)))  # a phrase takes over two bytes of a text
    asked = rows.mapInArrow(_asked(shard, most, blocks), "shard long, block long, hashes binary, counts binary")
    answers = asked.groupBy("block").applyInArrow(_answered(min(least, 255)), "shard long, block long, bits binary, n long, crc long")
    texts = rows.mapInArrow(_parts_of(shard, most), "shard long, lang string, text binary, own long")
    counted = answers.groupBy("shard").cogroup(texts.groupBy("shard")).applyInArrow(_counted(most, blocks), "lang string, words int, phrase string, n long")
    merged = counted.groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n"))
    return merged.filter((F.col("n") >= least) | (F.col("words") == 0))


def _part(begin: Column | int, length: Column | int) -> Column:
    return F.array_join(F.slice("parts", begin, length), " ")


def collocations(counts: DataFrame, share: int = SHARE, top: int | None = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the phrases of two words up, best first, from the ``counts`` of all phrases.

    Scores are whole numbers from exact products of up to 38 digits. ``top`` ranks of each language are kept, all if it is None.
    """
    parts = F.split("phrase", " ")
    whole = counts.filter("words >= 2").select("lang", "words", "phrase", F.col("n").alias("a"), parts.alias("parts"))
    cuts = whole.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.withColumns({"left": _part(F.lit(1), F.col("k")), "right": _part(F.col("k") + 1, F.col("words") - F.col("k"))})
    count_of = lambda part, name: counts.select(F.col("lang").alias(f"{name}_lang"), F.col("phrase").alias(f"{name}_phrase"), F.col("n").alias(name)).withColumnRenamed(f"{name}_phrase", part)
    for part, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(count_of(part, name).withColumnRenamed(f"{name}_lang", "lang"), ["lang", part])
    cuts = cuts.withColumn("score", F.expr(f"({SCALE}BD * CAST(a AS DECIMAL(16,0)) * CAST(a AS DECIMAL(16,0))) DIV (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0)))"))
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "words", "a", "l", "r")).alias("x")).select("lang", "phrase", "x.*")
    inner = whole.filter("words > 2").select("lang", "a", "words", "parts", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("d"))
    inner = inner.select("lang", "a", "parts", "d", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("d") + 1)).alias("i"))
    longer = inner.select("lang", _part(F.col("i"), F.col("d")).alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = best.join(longer, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long")
    ranked = kept.withColumn("rank", rank)
    ranked = ranked if top is None else ranked.filter(F.col("rank") <= top)
    totals = counts.filter("words = 0").select("lang", F.col("n").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of two or three words of every language, over all documents."""
    with scratch(prepare(spark)) as keep:
        counts = keep(phrase_counts(table(spark, sf_dir, "documents")))
    return collocations(counts)


OP12_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
f AS (
  SELECT lang, ph, words, count(*) AS n FROM (
    SELECT lang, 1 AS words, unnest(ws) AS ph FROM w
    UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM w WHERE len(ws) > 1
    UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) FROM w WHERE len(ws) > 2
  ) GROUP BY ALL
),
t AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM f WHERE words = 1 GROUP BY 1),
c AS (SELECT lang, ph, words, n AS a, string_split(ph, ' ') AS ws FROM f WHERE words > 1 AND n >= 10),
k AS (
  SELECT lang, ph, words, a, 1 AS k, ws[1] AS x, array_to_string(ws[2:], ' ') AS y FROM c
  UNION ALL SELECT lang, ph, words, a, 2, ws[1] || ' ' || ws[2], ws[3] FROM c WHERE words = 3
),
s AS (
  SELECT k.lang, k.ph, k.words, k.a, k.k, l.n AS l, r.n AS r, CAST((1000000::HUGEINT * k.a * k.a) // (l.n::HUGEINT * r.n) AS BIGINT) AS score
  FROM k JOIN f l ON l.lang = k.lang AND l.ph = k.x JOIN f r ON r.lang = k.lang AND r.ph = k.y
  QUALIFY row_number() OVER (PARTITION BY k.lang, k.ph ORDER BY score, k.k) = 1
),
g AS (SELECT lang, ph, max(a) AS longer FROM (SELECT lang, ws[1] || ' ' || ws[2] AS ph, a FROM c WHERE words = 3 UNION ALL SELECT lang, ws[2] || ' ' || ws[3], a FROM c WHERE words = 3) GROUP BY ALL),
o AS (
  SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.ph) AS rank
  FROM s LEFT JOIN g ON g.lang = s.lang AND g.ph = s.ph WHERE g.longer IS NULL OR 100 * g.longer < 50 * s.a
)
SELECT o.lang, o.rank, o.ph AS phrase, o.a, o.l, o.r, t.n, o.score FROM o JOIN t ON t.lang = o.lang WHERE o.rank <= 2000
"""
