"""Sum-of-squares packing of tokenized documents into sequences of bounded length.

A document is its token ids and a closing id 0. Documents over the capacity are cut into full pieces and a rest. The
pieces are dealt over shards by a hash of their places in a saved table (not of what they hold: equal rows spread too; the
number of shards follows that of the pieces, so a shard is a bounded group), and each shard is packed for itself: with N(g) open sequences that have g places left, a piece goes where the sum of N(g)^2 over
all g becomes smallest, the fullest sequence on ties; full sequences don't count. A shard is packed in two orders,
hashed and by falling length, and the packing with fewer sequences is kept.

Null and empty texts are the closing id alone. Repeated rows are packed for themselves. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .clip_words import SpanTable, default_path
from .common import Scratch, prepare, texts
from .token_counts import merger

CAPACITY = 2048
#: Pieces of a shard, about. A shard wastes some part of a few sequences; it takes a second or two.
SHARD = 32_768


class IdTable:
    """Token ids of spans as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str):
        self.merger, self.table = merger(path), SpanTable(self.learn)

    def learn(self, some: list[str]) -> list[bytes]:
        ids, upto = self.merger.encode_spans(some)
        data, ends = ids.astype("<u4").tobytes(), (4 * upto).tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def of(self, batch: list[str] | pa.Array) -> list[bytes]:
        return self.table.of(batch, b"".join)


@lru_cache(maxsize=1)
def id_table(path: str) -> IdTable:
    """One for each worker, so that its tasks share what they remember."""
    return IdTable(path)


def token_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32. Ids are those of the tokenizers library; equal spans are merged once."""
    prepare(docs.sparkSession)
    path = path or default_path()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches):
        table, width = id_table(path), 4 * capacity
        for b in batches:
            rows = []
            for doc, ids in zip(b.column("doc_id").to_pylist(), table.of(b.column("text")), strict=True):
                ids += b"\0\0\0\0"
                if len(ids) <= width:
                    rows.append((doc, 0, 0, len(ids) // 4, zlib.crc32(ids)))
                else:
                    rows += [(doc, k, k * capacity, len(part) // 4, zlib.crc32(part)) for k in range(-(-len(ids) // width)) for part in (ids[k * width : (k + 1) * width],)]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names)

    out = texts(docs).mapInArrow(run, "doc_id long, piece long, start long, length long, ids_crc32 long")
    return out.withColumn("piece", F.col("piece").cast("int"))


def sum_of_squares(sizes: list[int], capacity: int) -> tuple[list[int], list[int], int]:
    """Bin and offset of each size, in the given order, and the number of bins."""
    count = np.zeros(capacity + 1, dtype=np.int64)  # N(g)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, made = [], [], 0
    for s in sizes:
        if s >= capacity:
            bins.append(made)
            offsets.append(0)
            made += 1
            continue
        # the sum's change for gap g is 2 (N(g-s) - N(g)) + 2; N(0) never counts, so a perfect fit changes it by 1 - 2 N(g)
        change = 2 * (count[: capacity + 1 - s] - count[s:]) + 2
        change[0] = 1 - 2 * count[s]
        change[-1] = 2 * count[capacity - s] + 1  # a new bin
        change[:-1][count[s:-1] == 0] = capacity * len(sizes) * 2 + 2
        k = int(change.argmin())
        gap = s + k
        if gap == capacity:
            b = made
            made += 1
        else:
            b = open_bins[gap].pop()
            count[gap] -= 1
        bins.append(b)
        offsets.append(capacity - gap)
        if k:
            count[k] += 1
            open_bins[k].append(b)
    return bins, offsets, made


def pack_shard(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    best = None
    for order in (np.arange(len(sizes)), np.argsort(-sizes, kind="stable")):
        bins, offsets, made = sum_of_squares(sizes[order].tolist(), capacity)
        if best is None or made < best[2]:
            b, o = np.empty(len(sizes), dtype=np.int64), np.empty(len(sizes), dtype=np.int64)
            b[order], o[order] = bins, offsets
            best = b, o, made
    return best


def pack(items: DataFrame, capacity: int = CAPACITY, shard: int = SHARD, total: int | None = None) -> DataFrame:
    """``items`` (doc_id, piece, start, length, ids_crc32) with sequence_id and offset.

    items is saved with each row's place, and then read twice unless ``total``, its number of rows, is given.
    """
    prepare(items.sparkSession)
    placed = items.select("doc_id", "piece", "start", "length", "ids_crc32", F.monotonically_increasing_id().alias("place"))
    saved = Scratch(items.sparkSession, "packing").save(placed, "pieces")
    n = max(1, -(-(saved.count() if total is None else total) // shard))
    keyed = saved.withColumn("shard", F.pmod(F.xxhash64("place"), F.lit(n)).cast("long"))

    def run(t: pa.Table) -> pa.Table:
        t = t.take(np.argsort(_mixed(t.column("place").to_numpy())))
        sizes = t.column("length").to_numpy()
        bins, offsets, _ = pack_shard(sizes, capacity)
        sequence = bins + (t.column("shard")[0].as_py() << 32)
        return t.drop_columns(["shard", "place"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offsets))

    return keyed.groupBy("shard").applyInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def _mixed(place: np.ndarray) -> np.ndarray:
    """A shuffled order without ties."""
    x = place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """Pieces of ``docs`` with their places. Tokens are counted once, into a table of the shared folder."""
    return pack(token_pieces(docs, path, capacity), capacity, shard)
