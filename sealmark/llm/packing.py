"""Best-fit packing of token sequences with bounded space.

Each Spark partition is packed as a stream. A fixed number of bins is open at a time; an integer used as a bitset
has bit f set where some open bin has f tokens free, so the best fit for n tokens is the lowest set bit at n or
above. A piece that fits no open bin opens a new one; if all are open already, the fullest closes first. Full bins
close at once. What is open at the end of a partition closes there, so a partition wastes a few bins at most. The
stream is cut into windows of a fixed number of documents, and the longest pieces of a window are placed first: short
ones then fill the gaps that long ones leave.

Documents longer than the capacity are cut; the shorter piece comes first and the others are full sequences.

Defined results: a null text is the empty text and holds only the closing id; repeated rows are packed as often as
they occur; an empty input gives no rows; other columns are ignored. Sequence numbers are unique over all
partitions and the same on each run over the same partitions.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sealmark.llm._common import prepare, table, text_or_empty
from sealmark.llm.bpe import SPLIT, default_vocabulary, load

CAPACITY = 1024
OPEN_BINS = 512
#: Documents whose pieces are placed in order of length.
WINDOW = 1500
END_ID = 2
#: Texts from this length on go to the tokenizers library, whose split does not recurse.
LONG = 1_000_000


class Packer:
    """Bounded-space online best fit. ``place(n)`` gives (sequence, offset) for n tokens, 1 to ``capacity``."""

    def __init__(self, capacity: int = CAPACITY, open_bins: int = OPEN_BINS):
        self.capacity, self.most = capacity, open_bins
        self.bits = 0  # bit f: an open bin has f free
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # open sequences by free space
        self.open = self.made = 0

    def _take(self, free: int) -> int:
        seq = self.bins[free].pop()
        if not self.bins[free]:
            self.bits &= ~(1 << free)
        self.open -= 1
        return seq

    def place(self, n: int) -> tuple[int, int]:
        fits = self.bits >> n
        if fits:
            free = n + (fits & -fits).bit_length() - 1
            seq = self._take(free)
        else:
            free, seq = self.capacity, self.made
            self.made += 1
            if n < free and self.open >= self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
        if left := free - n:
            self.bins[left].append(seq)
            self.bits |= 1 << left
            self.open += 1
        return seq, self.capacity - free


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: all but the first are full."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))] if n else []


class LibraryIds:
    """Ids as the tokenizers library gives them for a byte-level BPE file.

    Texts go through tiktoken, which is several times faster, with ranks and pattern from the same file; texts with an
    added token's string, or that it cannot take, and all texts of a file whose ids are not in merge order, go through
    the tokenizers library itself. Tests hold both against each other.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        bpe = load(path)
        self.added = [*bpe.added]
        ranks = {s: i for i, s in bpe.strings.items() if i not in bpe.added.values()}
        made = [m[1] for m in sorted(bpe.merges.values())]
        self.fast = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}) if made == sorted(made) and max(bpe.byte_ids) < made[0] else None

    def encode_packed(self, text: str) -> bytes:
        if self.fast and not any(s in text for s in self.added) and len(text) < LONG:
            return self.fast.encode_to_numpy(text, disallowed_special=()).tobytes()
        return array("I", self.lib.encode(text, add_special_tokens=False).ids).tobytes()


@lru_cache(maxsize=2)
def library_ids(path: str) -> LibraryIds:
    return LibraryIds(path)


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, id_col: str = "doc_id", text: str = "text", with_ids: bool = True, window: int = WINDOW) -> DataFrame:
    """One row a piece: (doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids])."""
    prepare(docs.sparkSession)
    path = path or default_vocabulary()
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "ids"][: 8 if with_ids else 7]
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib, packer = library_ids(path), Packer(capacity, open_bins)
        base, end = TaskContext.get().partitionId() << 36, array("I", [END_ID]).tobytes()
        for b in (whole.slice(i, window) for whole in batches for i in range(0, whole.num_rows, window)):
            pieces = []  # (row, piece, start, length, ids)
            for i, t in enumerate(b.column(1)):
                ids = lib.encode_packed(t.as_py()) + end
                pieces += [(i, k, start, n, ids[start * 4 : (start + n) * 4]) for k, (start, n) in enumerate(cut(len(ids) // 4, capacity))]
            places: list[tuple[int, int]] = [(0, 0)] * len(pieces)
            for j in sorted(range(len(pieces)), key=lambda j: -pieces[j][3]):
                places[j] = packer.place(pieces[j][3])
            index = [p[0] for p in pieces]
            rows = [[p[1] for p in pieces], [p[2] for p in pieces], [p[3] for p in pieces], [crc32(p[4]) for p in pieces], [base + s for s, _ in places], [o for _, o in places], [p[4] for p in pieces]]
            types = [pa.int32(), *[pa.int64()] * 5]
            columns = [b.column(0).take(pa.array(index, pa.int64())), *(pa.array(x, t) for x, t in zip(rows, types, strict=False))]
            if with_ids:
                ends = np.cumsum([0, *rows[2]], dtype=np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(rows[6]), np.int32))))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text).alias("text")).mapInArrow(run, schema)


def op4_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), with_ids=False)
