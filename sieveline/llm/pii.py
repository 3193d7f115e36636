"""Personal data in texts: exact base patterns, and a semi-Markov conditional random field for disguised forms.

Base patterns (email, ip, card, phone) are leftmost and non-overlapping per kind; a match that fails its test is dropped.
They run in linear time: e-mail addresses are found from their ``@``, and the others start at a digit or plus sign.

The field segments the tokens (runs of letters and digits, single signs) of the stretches around triggers: digits, ``@`` and bracketed
"at" words. A segment is either one outside token or an entity of at most ``LONGEST`` tokens that holds a trigger and
stays within one stretch; its features look at the whole span (form, lengths, checks such as Luhn's, what stands before and
after), and dynamic programming over all segment starts, lengths and kinds finds the best boundaries and kinds jointly.
Weights maximise the conditional likelihood of generated training snippets (forward-backward over segmentations); they are trained
once per process on the driver. Found entities that don't touch a base span are added to it; base spans always stay.
Kinds of the field: those of the base in forms that the base misses, and secret (keys given to a token, key or password).

A null text is empty. Offsets are code points, ends exclusive. Repeated rows stay; other columns are ignored, and
``mask`` keeps them.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, table, texts

KINDS = ("email", "ip", "card", "phone", "secret")
BASE = KINDS[:4]
LONGEST = 16

# base patterns -----------------------------------------------------------------------------------------------------

_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_local = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_ip = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_card = re.compile(r"[0-9](?:[ -]?[0-9])++")
_phone = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_digit = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        m = _domain.match(text, at + 1)
        if m:
            start = at
            while start > free and text[start - 1] in _local:
                start -= 1
            if start < at:
                out.append((start, m.end()))
                free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def _octet(x: str) -> bool:
    x = x.lstrip("0")
    return len(x) < 4 and int(x or "0") < 256


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind as listed."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if _digit.search(text):
        out += [("ip", *m.span()) for m in _ip.finditer(text) if all(map(_octet, m.group().split(".")))]
        for m in _card.finditer(text):
            if 14 <= m.end() - m.start() <= 37:
                d = m.group().replace(" ", "").replace("-", "")
                if 14 <= len(d) <= 19 and luhn(d):
                    out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in _phone.finditer(text) if 10 <= len(_digit.findall(m.group())) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


# segmentation ------------------------------------------------------------------------------------------------------

_token = re.compile(r"[^\W_]+|[^\w\s]|_")
_trigger = re.compile(r"[0-9]+|@|[\[({]\s?(?:[Aa][Tt]|AT)\s?[\])}]")
_secret_word = re.compile(r"(?:token|secret|passw(?:or)?d|api_?key|key|pwd)\W*$", re.I)
_phone_word = re.compile(r"(?:phone|tel|call|mobile|fax|telefon|tél|móvil)\W*$", re.I)
_card_word = re.compile(r"(?:card|visa|karte|carte|tarjeta)\W*(?:no|number|nr)?\W*$", re.I)
_disguised = re.compile(r"[\w.+-]+\s*(?:[\[({]\s?at\s?[\])}]|@)\s*\w+(?:\s*(?:[\[({]\s?dot\s?[\])}]|\.)\s*\w+)+", re.I)
_ip_like = re.compile(r"[0-9]{1,3}(?:\s?(?:\.|[\[(]\.[\])]|[\[(]dot[\])])\s?[0-9]{1,3}){3}", re.I)
_phone_like = re.compile(r"\(?[0-9]{2,4}\)?[ .-][0-9]{3}[ .-][0-9]{4}|00[0-9]{1,3}[ -]\(?[0-9]{2,4}\)?[ -][0-9]{3}[ -][0-9]{4}")
_hex = re.compile(r"[0-9a-fA-F]+")


def stretches(text: str) -> list[tuple[int, int]]:
    """Where entities may lie: all spans of up to LONGEST tokens that hold a trigger, of any length, within one line."""
    out: list[tuple[int, int]] = []
    line, starts, ends = -1, [], []
    for m in _trigger.finditer(text):
        if m.end() > line:  # each line's tokens are made once
            lo, hi = text.rfind("\n", max(0, line), m.start()) + 1, text.find("\n", m.end())
            lo, line = lo or max(0, line), hi if hi >= 0 else len(text)
            found = [t.span() for t in _token.finditer(text, lo, line)]
            starts, ends = [a for a, _ in found], [b for _, b in found]
        k = bisect_right(starts, m.start()) - 1
        a, b = starts[max(0, k - LONGEST + 1)], ends[min(k + LONGEST, len(ends)) - 1]
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _bucket(n: int) -> int:
    return n if n < 5 else 5 if n < 7 else 7 if n < 10 else 10 if n < 13 else 13 if n < 16 else 16 if n < 20 else 20 if n < 32 else 32


def span_features(text: str, a: int, b: int, n_tokens: int) -> list[str]:
    """Names of the features that hold for text[a:b] as one entity."""
    s = text[a:b]
    digits = "".join(_digit.findall(s))
    before, after = text[max(0, a - 20) : a], text[b : b + 1]
    out = [f"d{_bucket(len(digits))}", f"t{_bucket(n_tokens)}", f"share{round(4 * len(digits) / len(s))}", f"len{_bucket(len(s))}"]
    form = re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]+", "9", s))
    out.append("form " + form[:24])
    out.append("first " + ("9" if s[0].isdigit() else "a" if s[0].isalpha() else s[0]) + " last " + ("9" if s[-1].isdigit() else "a" if s[-1].isalpha() else s[-1]))
    tied = before[-1:] != "" and not before[-1:].isspace()
    out.append("before " + (" " if not tied else "a" if before[-1:].isalnum() else before[-1:]))
    out.append("after " + (" " if not after or after.isspace() else "a" if after.isalnum() else after))
    if len(digits) >= 12 and "a" not in form:
        out.append("luhn" if luhn(digits) else "no luhn")
    for name, p in (("disguised", _disguised), ("ip", _ip_like), ("phone", _phone_like), ("hex", _hex)):
        if p.fullmatch(s):
            out.append(f"{name} {_bucket(len(s)) if name == 'hex' else ''}")
    if _ip_like.fullmatch(s) and all(int(x) < 256 for x in re.findall(r"[0-9]+", s)):
        out.append("octets")
    for name, p in (("secret", _secret_word), ("phone", _phone_word), ("card", _card_word)):
        if p.search(before):
            out.append("word " + name)
            if name == "secret":
                out.append(f"word secret and {'hex' if _hex.fullmatch(s) else form[:6]} {_bucket(len(s))}")
    return out


def segments(text: str, lo: int, hi: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Tokens of a stretch as (start, end), and candidate entities as (first token, end token)."""
    tokens = [(lo + m.start(), lo + m.end()) for m in _token.finditer(text[lo:hi])]
    marks = [t for m in _trigger.finditer(text, lo, hi) for t in (m.start(),)]
    trigger = np.zeros(len(tokens) + 1, dtype=np.int64)
    starts = np.array([a for a, _ in tokens], dtype=np.int64)
    for t in marks:
        k = int(np.searchsorted(starts, t, side="right")) - 1
        if k >= 0:
            trigger[k + 1] = 1
    seen = np.cumsum(trigger).tolist()
    out = []
    for i, (a, _) in enumerate(tokens):
        if not (text[a].isalnum() or text[a] in "+("):
            continue
        for j in range(i + 1, min(i + LONGEST, len(tokens)) + 1):
            b = tokens[j - 1][1]
            if seen[j] > seen[i] and text[b - 1].isalnum():
                out.append((i, j))
    return tokens, out


class Field:
    """Weights of features by kind, and of kinds that follow each other (0: outside)."""

    def __init__(self, names: dict[str, int], weights: np.ndarray, follow: np.ndarray):
        self.names, self.weights, self.follow = names, weights, follow

    def scores(self, text: str, tokens: list, spans: list) -> np.ndarray:
        names, out = self.names, np.zeros((len(spans), len(KINDS)))
        for k, (i, j) in enumerate(spans):
            f = [names[x] for x in span_features(text, tokens[i][0], tokens[j - 1][1], j - i) if x in names]
            out[k] = self.weights[f].sum(axis=0)
        return out

    def best(self, text: str, lo: int, hi: int) -> list[tuple[str, int, int]]:
        """The best segmentation's entities."""
        tokens, spans = segments(text, lo, hi)
        if not spans:
            return []
        s = self.scores(text, tokens, spans)
        ends: dict[int, list[int]] = {}
        for k, (_, j) in enumerate(spans):
            ends.setdefault(j, []).append(k)
        n, y = len(tokens), len(KINDS) + 1
        value, back = np.full((n + 1, y), -np.inf), {}
        value[0, 0] = 0.0
        for j in range(1, n + 1):
            came = value[j - 1] + self.follow[:, 0]
            p = int(came.argmax())
            value[j, 0], back[j, 0] = came[p], (j - 1, p)
            for k in ends.get(j, ()):
                i = spans[k][0]
                through = value[i][:, None] + self.follow[:, 1:]
                p = through.argmax(axis=0)
                total = through[p, np.arange(y - 1)] + s[k]
                for c in np.flatnonzero(total > value[j, 1:]).tolist():
                    value[j, c + 1], back[j, c + 1] = total[c], (i, int(p[c]))
        out, at = [], (n, int(value[n].argmax()))
        while at[0]:
            i, p = back[at]
            if at[1]:
                out.append((KINDS[at[1] - 1], tokens[i][0], tokens[at[0] - 1][1]))
            at = (i, p)
        return out[::-1]


# training ----------------------------------------------------------------------------------------------------------


def snippets(n: int, seed: int = 5) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Generated lines with their entities: each kind in plain and disguised forms, and look-alikes that are none."""
    rng = random.Random(seed)
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice(["on", "er", "the", "in", "ou", "la", "en", "que", "sch", "ti", "é", "a"]) for _ in range(rng.randint(1, 3)))
    host = lambda dot: dot.join([rng.choice(["mail", "mail7", "web", word().replace("é", "e")]), rng.choice(["example", "corp", "uni"]), rng.choice(["com", "org", "de"])][rng.randint(0, 1) :])

    def number() -> str:
        d = digits(15)
        return next(d + c for c in "0123456789" if luhn(d + c))

    def entity(kind: str) -> tuple[str, str, str]:
        """What stands before, the entity, what stands after."""
        if kind == "email":
            user = word().replace("é", "e") + rng.choice(["", ".", "_"]) + rng.choice(["", digits(2)]) or "a"
            user = user.rstrip("._") or "a"
            at, dot = rng.choice([("@", "."), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" (at) ", "."), (" @ ", "."), ("[at]", "[dot]"), (" {at} ", " . ")])
            return "", user + at + host(dot), ""
        octet = lambda: str(rng.randint(0, 255))
        if kind == "ip":
            return "", rng.choice([".", ".", "[.]", " . ", "(dot)"]).join(octet() for _ in range(4)), rng.choice(["", ":8080" if rng.random() < 0.2 else ""])
        if kind == "card":
            d = number()
            return rng.choice(["", "", "card ", "Visa: "]), rng.choice([d, " ".join(d[i : i + 4] for i in range(0, 16, 4)), ".".join(d[i : i + 4] for i in range(0, 16, 4)), "/".join(d[i : i + 4] for i in range(0, 16, 4))]), ""
        if kind == "phone":
            a, b, c = digits(3), digits(3), digits(4)
            return rng.choice(["", "", "tel. ", "phone: "]), rng.choice([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"001 {a} {b} {c}", f"{a}.{b}.{c}"]), ""
        key = "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([24, 32, 40, 40, 64])))
        key = key[:-2] + "7a"
        before = rng.choice(['token = "', 'TOKEN = "', "api_key: ", "secret=", 'password = "', "key: "])
        return before, rng.choice([key, key.upper()]), '"' if before.endswith('"') else ""

    def none() -> str:
        return rng.choice([
            lambda: str(rng.randint(1, 9999)), lambda: f"{rng.randint(1900, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", lambda: f"{rng.randint(1, 99)}.{digits(2)} %",
            lambda: f"v{rng.randint(1, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 9)}", lambda: f"{rng.randint(1, 23)}:{rng.randint(10, 59)}", lambda: f"$1,{digits(3)}.{digits(2)}", lambda: "@" + word(),
            lambda: f"{digits(4)}/{digits(4)}", lambda: digits(6), lambda: f"§ {rng.randint(1, 99)}.{rng.randint(1, 9)}.{rng.randint(1, 9)}.{rng.randint(300, 900)}.{rng.randint(1, 9)}", lambda: f"ISBN 978-{digits(1)}-{digits(4)}-{digits(4)}-{digits(1)}",
            lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40)) + "b1", lambda: f"{word()} [at] {word()}", lambda: f"commit {''.join(rng.choice('0123456789abcdef') for _ in range(10))}", lambda: f"{rng.randint(1, 9)} + {rng.randint(1, 9)}",
            lambda: next(d for d in iter(lambda: digits(16), None) if not luhn(d)), lambda: f"key {digits(3)}", lambda: f"token {word()}{digits(1)}",
        ])()

    out = []
    for k in range(n):
        text, spans = "", []
        kind = KINDS[k % len(KINDS)] if k % 8 < 5 else None
        parts = [word() for _ in range(rng.randint(1, 4))] + [kind or ""] + [word() for _ in range(rng.randint(0, 4))]
        for p in parts:
            if p in KINDS or p == "":
                before, s, after = entity(p) if p else ("", none(), "")
                text += before
                if p:
                    spans.append((p, len(text), len(text) + len(s)))
                text += s + after
            else:
                text += p
            text += rng.choice([" ", " ", " ", ", ", ". "])
        out.append((text, spans))
    return out


def train(n: int = 900, rounds: int = 8, rate: float = 0.3, decay: float = 2e-4, seed: int = 5) -> Field:
    """Maximum conditional likelihood by adaptive gradient steps, one for each snippet."""
    names: dict[str, int] = {}
    made = []
    for text, truth in snippets(n, seed):
        for lo, hi in stretches(text):
            tokens, spans = segments(text, lo, hi)
            begin, end = {a: i for i, (a, _) in enumerate(tokens)}, {b: i + 1 for i, (_, b) in enumerate(tokens)}
            gold = {(begin.get(a), end.get(b)): KINDS.index(k) + 1 for k, a, b in truth if lo <= a and b <= hi}
            feats = [[names.setdefault(x, len(names)) for x in span_features(text, tokens[i][0], tokens[j - 1][1], j - i)] for i, j in spans]
            if spans and all(g in spans for g in gold):
                made.append((len(tokens), spans, feats, gold))
    y = len(KINDS) + 1
    w, follow = np.zeros((len(names), y - 1)), np.zeros((y, y))
    seen_w, seen_f = np.full_like(w, 1e-6), np.full_like(follow, 1e-6)
    rng = random.Random(seed)
    for _ in range(rounds):
        rng.shuffle(made)
        for n_tokens, spans, feats, gold in made:
            s = np.array([w[f].sum(axis=0) for f in feats])
            ends: list[list[int]] = [[] for _ in range(n_tokens + 1)]
            starts: list[list[int]] = [[] for _ in range(n_tokens + 1)]
            for k, (i, j) in enumerate(spans):
                ends[j].append(k)
                starts[i].append(k)
            alpha, beta = np.full((n_tokens + 1, y), -np.inf), np.full((n_tokens + 1, y), -np.inf)
            alpha[0, 0], beta[n_tokens] = 0.0, 0.0
            inner = lambda a: np.logaddexp.reduce(alpha[a][:, None] + follow, axis=0)  # noqa: E731, B023
            into = []
            for j in range(n_tokens):
                into.append(inner(j))
                alpha[j + 1, 0] = np.logaddexp(alpha[j + 1, 0], into[j][0])
                for k in starts[j]:
                    e = spans[k][1]
                    alpha[e, 1:] = np.logaddexp(alpha[e, 1:], into[j][1:] + s[k])
            for i in range(n_tokens - 1, -1, -1):
                ahead = np.full(y, -np.inf)
                ahead[0] = beta[i + 1, 0]
                for k in starts[i]:
                    ahead[1:] = np.logaddexp(ahead[1:], s[k] + beta[spans[k][1], 1:])
                beta[i] = np.logaddexp.reduce(follow + ahead[None, :], axis=1)
            z = np.logaddexp.reduce(alpha[n_tokens])
            grad_f = np.zeros_like(follow)
            last, at = 0, 0
            while at < n_tokens:  # the true segmentation
                g = next(((e, c) for (b, e), c in gold.items() if b == at), (at + 1, 0))
                grad_f[last, g[1]] += 1
                at, last = g
            for i in range(n_tokens):
                ahead = np.full(y, -np.inf)
                ahead[0] = beta[i + 1, 0]
                for k in starts[i]:
                    ahead[1:] = np.logaddexp(ahead[1:], s[k] + beta[spans[k][1], 1:])
                grad_f -= np.exp(np.minimum(alpha[i][:, None] + follow + ahead[None, :] - z, 0.0))
            for k, (i, j) in enumerate(spans):
                g = -np.exp(np.minimum(into[i][1:] + s[k] + beta[j, 1:] - z, 0.0))
                c = gold.get((i, j))
                if c:
                    g[c - 1] += 1
                elif g.min() > -1e-4:
                    continue
                f = feats[k]
                seen_w[f] += g * g
                w[f] += rate * (g - decay * w[f]) / np.sqrt(seen_w[f])
            seen_f += grad_f * grad_f
            follow += rate * grad_f / np.sqrt(seen_f)
    return Field(names, w, follow)


@lru_cache(maxsize=1)
def field() -> Field:
    return train()


# operator ----------------------------------------------------------------------------------------------------------


def spans_of(text: str, model: Field) -> tuple[list, list]:
    """Base spans, and all spans, by start and kind."""
    base = base_spans(text)
    found = [e for lo, hi in stretches(text) for e in model.best(text, lo, hi)]
    if not found:
        return base, base
    taken, out, k = sorted((a, b) for _, a, b in base), list(base), 0
    for kind, a, b in sorted(found, key=lambda e: e[1]):
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if not any(x < b and a < y for x, y in taken[max(0, k - 4) : k + 8]):
            out.append((kind, a, b))
    return base, sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def joined(spans: list) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_pii(docs: DataFrame, model: Field | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base), base_sha256, spans, for each row of ``docs``."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model or field())  # a few thousand features
    names = ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"]

    def run(batches):
        m = shared.value
        for b in batches:
            rows = []
            for t in b.column("text").to_pylist():
                base, whole = spans_of(t, m)
                kinds = [k for k, *_ in base]
                rows.append((*(kinds.count(k) for k in BASE), hashlib.sha256(joined(base).encode()).hexdigest(), joined(whole)))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:4]), *(pa.array(c, pa.string()) for c in cols[4:])], names)

    return texts(docs).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def masked(text: str, spans: list) -> str:
    """Each span replaced by its kind; overlapping spans together by the first one's."""
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]]) if out else text


def mask(docs: DataFrame, model: Field | None = None) -> DataFrame:
    """``docs`` with all columns; spans in text are replaced and n_chars, if there, follows. A null text stays null."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model or field())
    at = docs.columns.index("text")

    def run(batches):
        m = shared.value
        for b in batches:
            new = [None if t is None else masked(t, spans_of(t, m)[1]) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if k == at else c for k, c in enumerate(b.columns)], b.schema.names)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))
