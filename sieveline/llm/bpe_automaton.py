"""Encoding and decoding by a tokenization automaton.

The automaton reads tokens and accepts exactly the token sequences that the merge list can give. It starts with one
state that allows every base symbol. For each merge (u, v), in rank order, a gadget is inserted: the state reached by u
becomes a copy without the arc v (that pair would have been merged), and the new token uv gets an arc wherever u had
one, to the state that v reached before. So the state after a token depends on the token alone, each gadget makes at most one new
state, and the arc (state, t) exists unless a removed arc x of the state lies on the left edge of t and was removed
before t's part x was merged further. A word has exactly one accepted sequence, and so has each of its prefixes; a
word is therefore encoded from left to right by table-driven transitions, over a trie of the arc labels, with one
possible last token for each prefix. The tables (trie, state after each token, missing arcs of each state as sorted intervals) are
compiled to arrays once, and all new words of a batch step through them together. Decoding emits the labels of the arcs, joined as
the library joins them.

Nulls count as empty texts (no tokens, empty decoded text). Repeated rows give repeated rows. Other columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .clip_words import SPECIAL, SpanTable, byte_chars, default_path, load, pieces, pieces_of_spans
from .common import prepare, texts

LAST = 1 << 30


class TokenAutomaton:
    def __init__(self, path: str):
        vocab, merges, special = load(path)
        self.labels = {i: t for t, i in vocab.items()} | {i: t for t, i in special.items()}
        chars = byte_chars()
        self.inner, self.final = [vocab[c] for c in chars], [vocab[c + "</w>"] for c in chars]
        self.special, self.symbols = special, {*self.inner, *self.final}
        # states: what was removed, of which state it is a copy, and when
        self.after: dict[int, int] = {}  # token -> state it leads to
        self.copy_of, self.removed, self.when = [-1], [-1], [-1]
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.born: dict[int, int] = {}
        rule = {}
        for rank, (a, b) in enumerate(merges):
            u, v, w = vocab[a], vocab[b], vocab[a + b]
            if w in self.born:
                raise ValueError(f"two merges make {a + b!r}: the last token's state would not follow from the token")
            if self._merged_before(rule, u, v):  # no path has u and then v: the gadget is empty
                continue
            rule[u, v] = rank
            self.after[w] = self.after.get(v, 0)  # before u's state changes: right for u = v as well
            self.copy_of.append(self.after.get(u, 0))
            self.removed.append(v)
            self.when.append(rank)
            self.after[u] = len(self.removed) - 1
            self.left[w], self.right[w], self.born[w] = u, v, rank
        self._compile()

    def _merged_before(self, rule: dict[tuple[int, int], int], u: int, v: int) -> bool:
        """Whether the tokens never stand side by side: one of them cannot be made, or an earlier merge bridges them."""
        base = self.symbols
        if not (u in self.born or u in base) or not (v in self.born or v in base):
            return True
        y, until = u, LAST
        while True:
            x, grown = v, LAST
            while True:
                r = rule.get((y, x))
                if r is not None and r < until and r <= grown:
                    return True
                if x not in self.left:
                    break
                grown, x = self.born[x], self.left[x]
            if y not in self.right:
                return False
            until, y = self.born[y], self.right[y]

    def _compile(self) -> None:
        """The transition tables.

        Trie of the arc labels: ``edges`` (node * width + symbol, sorted) lead to ``nodes``; ``token`` is what ends in a node.
        States that follow a token are numbered; ``after_of[token]`` is the token's, 0 the first one. Tokens are numbered
        too, by a walk of their left parts that leaves a token after all that begin with it, earlier merges first. What a removed
        arc v takes away, v and the tokens whose first merge onto v came later, is then one interval of numbers, and a
        state's missing arcs are disjoint intervals: ``starts`` (state << 32 | first number, sorted) and ``stops``.
        """
        spelled = {s: (s,) for s in self.symbols}
        self.width, nxt, token = max(spelled) + 1, {}, [-1]
        for w, u in self.left.items():  # in rank order: parts come first
            spelled[w] = spelled[u] + spelled[self.right[w]]
        for t, symbols in spelled.items():
            node = 0
            for s in symbols:
                node = nxt.setdefault(node * self.width + s, len(token))
                if node == len(token):
                    token.append(-1)
            token[node] = t
        self.edges = np.array(sorted(nxt), dtype=np.int64)
        self.nodes = np.array([nxt[k] for k in self.edges.tolist()], dtype=np.int64)
        self.token = np.array(token, dtype=np.int64)

        longer: dict[int, list[int]] = {}
        for w, u in self.left.items():
            longer.setdefault(u, []).append(w)
        number, first = {}, {}
        for root in sorted(self.symbols):
            walk = [(root, 0)]
            first[root] = len(number)
            while walk:
                t, k = walk.pop()
                if k == len(longer.get(t, ())):
                    number[t] = len(number)
                else:
                    child = longer[t][k]
                    walk += [(t, k + 1), (child, 0)]
                    first[child] = len(number)
        size = max(self.labels) + 1
        self.number, self.after_of = np.full(size, -1, dtype=np.int64), np.zeros(size, dtype=np.int64)
        self.number[list(number)] = list(number.values())
        states = sorted({0, *self.after.values()})
        index = {s: k for k, s in enumerate(states)}
        for t, s in self.after.items():
            self.after_of[t] = index[s]
        interval = [(0, -1)]
        for v, rank in zip(self.removed[1:], self.when[1:], strict=True):
            more = longer.get(v, [])
            k = bisect.bisect_left(more, rank, key=self.born.__getitem__)
            interval.append((first[more[k]] if k < len(more) else number[v], number[v]))
        rows = []
        for k, s in enumerate(states):
            while s > 0:
                rows.append((k, *interval[s]))
                s = self.copy_of[s]
        table = np.array(rows, dtype=np.int64).reshape(-1, 3)
        table = table[np.lexsort((table[:, 1], table[:, 0]))]
        begin, reach = table[:, 0] << 32 | table[:, 1], np.maximum.accumulate(table[:, 0] << 32 | table[:, 2])
        new = np.r_[True, begin[1:] > reach[:-1]][: len(table)]  # intervals that lie in another one go
        self.starts, self.stops = begin[new], np.maximum.reduceat(reach, np.flatnonzero(new)) if len(table) else reach

    def _step(self, node: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The trie's node after a symbol, 0 if there is none."""
        key = node * self.width + symbol
        at = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
        return np.where(self.edges[at] == key, self.nodes[at], 0)

    def arcs(self, state: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Whether each state has an arc for the token beside it."""
        if not len(self.starts):
            return np.ones(len(state), dtype=bool)
        key = state << 32 | self.number[token]
        at = np.searchsorted(self.starts, key, side="right") - 1
        return (at < 0) | (self.stops[at] < key)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words behind each other, and their counts per word; the words must not be empty.

        All words step together: from each place that a prefix ends at, in order, the trie is walked on, and the first token that
        ends at a later place with an arc from the prefix's state is that longer prefix's last one; there is no other.
        """
        data = [w.encode("utf-8") for w in words]
        lens = np.fromiter(map(len, data), dtype=np.int64, count=len(data))
        raw, ends = np.frombuffer(b"".join(data), dtype=np.uint8), np.cumsum(lens)
        symbols = np.array(self.inner, dtype=np.int64)[raw]
        symbols[ends - 1] = np.array(self.final, dtype=np.int64)[raw[ends - 1]]
        begins = ends - lens
        last, start = np.full(len(raw), -1, dtype=np.int64), np.zeros(len(raw), dtype=np.int64)
        order = np.argsort(-lens, kind="stable")
        begins_, ends_, lens_ = begins[order], ends[order], lens[order]
        for j in range(int(lens_[0])):
            n = int(np.searchsorted(-lens_, -j, side="left"))  # words longer than j
            at, stop = begins_[:n] + j, ends_[:n]
            state = self.after_of[last[at - 1]] if j else np.zeros(n, dtype=np.int64)
            origin, node = at, np.zeros(n, dtype=np.int64)
            while len(at):
                node = self._step(node, symbols[at])
                t = self.token[node]
                open_ = np.flatnonzero((node > 0) & (t >= 0) & (last[at] < 0))
                open_ = open_[self.arcs(state[open_], t[open_])]
                last[at[open_]], start[at[open_]] = t[open_], origin[open_]
                go = np.flatnonzero((node > 0) & (at + 1 < stop))
                at, stop, state, origin, node = at[go] + 1, stop[go], state[go], origin[go], node[go]
        on = np.zeros(len(raw), dtype=bool)
        at, begin = ends - 1, begins
        while len(at):  # back along each word's accepted sequence
            on[at] = True
            go = np.flatnonzero(start[at] > begin)
            at, begin = start[at[go]] - 1, begin[go]
        return last[on], np.add.reduceat(on, begins, dtype=np.int64)

    def encode_word(self, word: str) -> list[int]:
        return self.encode_words([word])[0].tolist()

    def encode(self, text: str) -> list[int]:
        return [i for p in pieces(text) for i in ([self.special[p]] if p in self.special else self.encode_word(p))]

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.labels.__getitem__, ids))


@lru_cache(maxsize=2)
def automaton(path: str) -> TokenAutomaton:
    return TokenAutomaton(path)


class Coder:
    """Encodes and decodes batches; a span's ids, as decimal text, and its decoded labels are remembered."""

    def __init__(self, path: str):
        self.auto, self.table = automaton(path), SpanTable(self.learn, 500_000)

    def learn(self, some: list[str]) -> list[tuple[str, str]]:
        words, ends = pieces_of_spans(some)
        own = list({*words}.difference(SPECIAL))
        known = {x: [self.auto.special[x]] for x in SPECIAL}
        if own:
            ids, counts = self.auto.encode_words(own)
            ids, upto = ids.tolist(), np.cumsum(counts).tolist()
            known.update((w, ids[a:b]) for w, a, b in zip(own, [0, *upto], upto, strict=False))
        coded = {w: (" ".join(map(str, x)), self.auto.decode(x)) for w, x in known.items()}
        out = []
        for a, b in zip([0, *ends], ends, strict=False):
            if b - a == 1:
                out.append(coded[words[a]])
            else:
                own = [coded[w] for w in words[a:b]]
                out.append((" ".join([x for x, _ in own]), " ".join([y for _, y in own])))
        return out

    def code(self, batch: list[str] | pa.Array) -> list[tuple[str, str]]:
        """Of each text the decimal ids, and the decoded text, each joined by spaces."""
        return [(" ".join([x for x, _ in v]), " ".join([y for _, y in v])) for v in self.table.of(batch)]


@lru_cache(maxsize=1)
def coder(path: str) -> Coder:
    """One for each worker, so that its tasks share what they remember."""
    return Coder(path)


def code_documents(docs: DataFrame, path: str | None = None, keep: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if ``keep``, token_ids (array) and decoded for each row."""
    prepare(docs.sparkSession)
    path = path or default_path()

    def run(batches):
        code = coder(path).code
        for b in batches:
            rows = code(b.column("text"))
            n = pa.array([x.count(" ") + 1 if x else 0 for x, _ in rows], pa.int64())
            digests = [pa.array([hashlib.sha256(r[k].encode("utf-8")).hexdigest() for r in rows], pa.string()) for k in (0, 1)]
            cols = [b.column("doc_id"), n, *digests]
            if keep:
                cols += [pa.array([list(map(int, x.split())) for x, _ in rows], pa.list_(pa.int32())), pa.array([y for _, y in rows], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names)

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["token_ids", "decoded"] * keep
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>, decoded string" * keep
    return texts(docs).mapInArrow(run, schema)
