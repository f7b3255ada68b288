"""Byte-level BPE: a priority queue of merge ranks over a doubly linked symbol list.

A text is cut at the vocabulary's added tokens and by the byte-level split pattern; each piece becomes a list of
byte symbols linked both ways. All adjacent pairs with a merge wait in a heap by rank and place; the best pair is
merged, its neighbours' new pairs are pushed, and heap entries whose symbols have changed since are skipped as
stale. Decoding joins the byte strings of the ids and reads them as UTF-8.

Defined results: null is the empty text, which has no ids; equal texts have equal ids; a piece of any length is
merged in n log n steps; columns other than id and text are ignored. Each Python worker keeps a bounded memo of
pieces, which changes only the speed.
"""

from __future__ import annotations

import heapq
import json
from array import array
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sealmark.llm._common import prepare, table, text_or_empty

# Fixed value: the split pattern of byte-level BPE.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Where a space is followed by no other white space, the split cuts before it: what stands between two spaces is
#: then encoded by itself. Texts with such a run take the plain way.
UNSAFE = regex.compile(r" \s| $")
#: Pieces that a worker remembers at most; frequent ones come early, so a full memo stays as it is.
MEMO = 300_000
#: Pieces longer than this many characters are never remembered.
MEMO_CHARS = 64


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte: itself where printable, else the next from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """Encoder and decoder for one vocabulary file of the tokenizers library (byte-level BPE)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        raw = lambda s: bytes(alphabet[c] for c in s)
        vocab = spec["model"]["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings: dict[int, bytes] = {i: raw(s) for s, i in vocab.items() if s not in self.added}
        self.strings |= {i: s.encode() for s, i in self.added.items()}
        ids = {b: i for i, b in self.strings.items()}
        self.byte_ids = [ids[bytes([b])] for b in range(256)]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = map(raw, pair if isinstance(pair, list) else pair.split(" "))
            self.merges[ids[left], ids[right]] = (rank, ids[left + right])
        self.split = regex.compile(SPLIT)
        self.marks = regex.compile("|".join(regex.escape(s) for s in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.table = [self.strings.get(i, b"") for i in range(max(self.strings) + 1)]
        self.memo: dict[str, bytes] = {}
        self.units: dict[str, bytes] = {}

    def piece(self, text: str) -> list[int]:
        """Ids of one piece."""
        symbols = [self.byte_ids[b] for b in text.encode()]
        n, merges = len(symbols), self.merges
        if n < 2:
            return symbols
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(m[0], i, symbols[i], symbols[i + 1], m[1]) for i in range(n - 1) if (m := merges.get((symbols[i], symbols[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, left, right, made = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != left or j < 0 or symbols[j] != right:
                continue  # stale: one of the two has been merged since
            symbols[i], symbols[j] = made, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if m := merges.get((made, symbols[k])):
                    heapq.heappush(heap, (m[0], i, made, symbols[k], m[1]))
            if (h := before[i]) >= 0 and (m := merges.get((symbols[h], made))):
                heapq.heappush(heap, (m[0], h, symbols[h], made, m[1]))
        return [s for s in symbols if s >= 0]

    def _packed(self, piece: str) -> bytes:
        got = array("I", self.piece(piece)).tobytes()
        if len(piece) <= MEMO_CHARS and len(self.memo) < MEMO:
            self.memo[piece] = got
        return got

    def encode_packed(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if self.marks is None or not any(s in text for s in self.added):
            return self._plain(text)
        out, at = [], 0
        for m in self.marks.finditer(text):
            out += [self._plain(text[at : m.start()]), array("I", [self.added[m.group()]]).tobytes()]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def _plain(self, text: str) -> bytes:
        if not text or UNSAFE.search(text):
            return self._pieces(text)
        first, *rest = text.split(" ")
        get, make = self.units.get, self._unit
        return self._pieces(first) + b"".join([get(u) or make(u) for u in rest])

    def _pieces(self, text: str) -> bytes:
        get, make = self.memo.get, self._packed
        return b"".join([get(p) or make(p) for p in self.split.findall(text)])

    def _unit(self, unit: str) -> bytes:
        got = self._pieces(" " + unit)
        if len(unit) <= MEMO_CHARS and len(self.units) < MEMO:
            self.units[unit] = got
        return got

    def encode(self, text: str) -> list[int]:
        return array("I", self.encode_packed(text)).tolist()

    def decode_packed(self, ids: bytes) -> str:
        return b"".join(map(self.table.__getitem__, memoryview(ids).cast("I"))).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    return Bpe(path)


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, ids): the ids of every text, as an array of integers."""
    prepare(docs.sparkSession)
    path = path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([bpe.encode(t) for t in b.column(1).to_pylist()], pa.list_(pa.int32()))], names=["id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), text_or_empty(text).alias("text")).mapInArrow(run, f"id {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(id, text) from the rows of ``encode``."""
    prepare(encoded.sparkSession)
    path = path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in batches:
            texts = [bpe.decode_packed(array("I", x or []).tobytes()) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    kind = encoded.schema["id"].dataType.simpleString()
    return encoded.select("id", "ids").mapInArrow(run, f"id {kind}, text string")


def digests(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): ids and decoded text of each row, digested where they are made."""
    prepare(docs.sparkSession)
    path = path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in batches:
            n, ids, back = [], [], []
            for t in b.column(1):
                packed = bpe.encode_packed(t.as_py())
                n.append(len(packed) // 4)
                ids.append(sha256(packed).hexdigest())
                back.append(sha256(bpe.decode_packed(packed).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids), pa.array(back)], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), text_or_empty(text).alias("text")).mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
