"""Token counts by rank-synchronous array merging.

All distinct new words of a batch lie behind each other in one symbol array. In each round every word finds the
lowest merge rank among its adjacent pairs and applies that pair at all its places at once (leftmost first where they
overlap); words without a mergeable pair leave the array. The symbols that survive are a word's tokens; the count of a text is the sum
over its spans between white space, whose counts are remembered.

Nulls count as empty texts (0 tokens). Repeated rows give repeated rows. Other columns of the input are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .clip_words import SPECIAL, SpanTable, byte_chars, default_path, load, pieces_of_spans
from .common import prepare, texts

NONE = np.iinfo(np.int64).max

class RankMerger:
    def __init__(self, path: str):
        vocab, merges, special = load(path)
        self.special = np.array([special[x] for x in SPECIAL], dtype=np.int64)
        chars = byte_chars()
        self.inner = np.array([vocab[c] for c in chars], dtype=np.int64)
        self.final = np.array([vocab[c + "</w>"] for c in chars], dtype=np.int64)
        self.size = len(vocab)
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        self.made = made  # by rank
        # pairs by their hash, in the first free slot from it on; a sixteenth to an eighth of the slots is taken
        self.shift = np.uint64(64 - 3 - max(1, len(keys)).bit_length())
        slots = 1 << (64 - int(self.shift))
        self.slots = np.full(slots + 64, -1, dtype=np.int64)
        self.ranks = np.zeros(slots + 64, dtype=np.int64)
        for rank, (key, at) in enumerate(zip(keys.tolist(), self._slot(keys).tolist(), strict=True)):
            while self.slots[at] not in (-1, key):
                at += 1
            if self.slots[at] == -1:  # a pair's first rank counts
                self.slots[at], self.ranks[at] = key, rank

    def _pairs(self, sym: np.ndarray, owner: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Places of the merges of the symbols at ``at`` with their next ones, in rank order; NONE without one."""
        key = sym[at] * self.size + sym[at + 1]
        slot = self._slot(key)
        there = self.slots[slot]
        open_ = np.flatnonzero((there != key) & (there != -1))
        while len(open_):
            slot[open_] += 1
            there[open_] = self.slots[slot[open_]]
            open_ = open_[(there[open_] != key[open_]) & (there[open_] != -1)]
        return np.where((there == key) & (owner[at] == owner[at + 1]), self.ranks[slot], NONE)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def tokens(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Surviving symbols of all words behind each other, and their counts per word; the words must not be empty."""
        data = [w.encode("utf-8") for w in words]
        lens = np.fromiter(map(len, data), dtype=np.int64, count=len(data))
        raw = np.frombuffer(b"".join(data), dtype=np.uint8)
        sym, ends = self.inner[raw], np.cumsum(lens) - 1
        sym[ends] = self.final[raw[ends]]
        owner, place = np.repeat(np.arange(len(data)), lens), np.arange(len(sym))
        out, left = sym.copy(), np.ones(len(sym), dtype=bool)
        rank = np.append(self._pairs(sym, owner, np.arange(len(sym) - 1)), NONE)  # of each symbol's pair with the next
        while True:
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            spans = np.diff(np.r_[starts, len(owner)])
            lowest = np.repeat(np.minimum.reduceat(rank, starts), spans)
            alive = lowest != NONE
            if not alive.any():
                break
            take = np.flatnonzero(alive & (rank == lowest))
            # in a run of overlapping pairs each second one goes
            first = np.r_[True, np.diff(take) != 1]
            begin = np.maximum.accumulate(np.where(first, np.arange(len(take)), 0))
            take = take[(np.arange(len(take)) - begin) % 2 == 0]
            sym[take] = self.made[rank[take]]
            out[place[take]], left[place[take + 1]], alive[take + 1] = sym[take], False, False
            at = (np.cumsum(alive) - 1)[take]
            sym, owner, place, rank = sym[alive], owner[alive], place[alive], rank[alive]
            rank[-1] = NONE
            changed = np.r_[at, at - 1]  # only their pairs are others than before
            changed = changed[(changed >= 0) & (changed < len(sym) - 1)]
            rank[changed] = self._pairs(sym, owner, changed)
        return out[left], np.add.reduceat(left, ends - lens + 1, dtype=np.int64)

    def encode_spans(self, some: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The token ids of all spans behind each other, and how many there are up to each span's end."""
        words, ends = pieces_of_spans(some)
        own = list({*words}.difference(SPECIAL))
        ids, counts = self.tokens(own) if own else (np.empty(0, dtype=np.int64),) * 2
        ids, counts = np.r_[ids, self.special], np.r_[counts, np.ones(len(SPECIAL), dtype=np.int64)]
        index = {w: k for k, w in enumerate((*own, *SPECIAL))}
        which = np.fromiter(map(index.__getitem__, words), dtype=np.int64, count=len(words))
        each, begin = counts[which], (np.cumsum(counts) - counts)[which]
        upto = np.cumsum(each)
        flat = ids[np.repeat(begin - upto + each, each) + np.arange(upto[-1] if len(upto) else 0)]
        return flat, upto[np.array(ends, dtype=np.int64) - 1]


@lru_cache(maxsize=2)
def merger(path: str) -> RankMerger:
    return RankMerger(path)


class Counter:
    def __init__(self, path: str):
        self.merger, self.table = merger(path), SpanTable(self.learn)

    def learn(self, some: list[str]) -> list[int]:
        return np.diff(self.merger.encode_spans(some)[1], prepend=0).tolist()

    def count(self, batch: list[str] | pa.Array) -> list[int]:
        return self.table.of(batch, sum)


@lru_cache(maxsize=1)
def counter(path: str) -> Counter:
    """One for each worker, so that its tasks share what they remember."""
    return Counter(path)


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) for each row of ``docs``."""
    prepare(docs.sparkSession)
    path = path or default_path()

    def run(batches):
        count = counter(path).count
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(count(b.column("text")), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    sized = texts(docs).withColumn("n_bytes", F.octet_length("text").cast("long"))
    out = sized.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
