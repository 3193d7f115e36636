"""Normalisation and pre-splitting of ``word_bpe_49k.json``: NFC, lower case, words, digits and runs of signs.

``pieces`` yields what the library's pre-tokenizer yields; tests compare it with the library on every code point. ``SpanTable``
looks texts up by their spans between white space, so that frequent ones are normalised and split once.
"""

from __future__ import annotations

import gc
import json
import re
import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
_special = re.compile(r"(<\|startoftext\|>|<\|endoftext\|>)")
_far = re.compile(r"[^\x00-ɏ]")


SPACES = r"\u0009-\u000d\u0020\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def _ranges(test, end: int) -> str:
    """The code points below ``end`` that pass, as the inside of a character class."""
    out, i = [], 0
    while i < end:
        if not test(chr(i)):
            i += 1
            continue
        j = i
        while j + 1 < end and test(chr(j + 1)):
            j += 1
        out.append(f"\\U{i:08x}-\\U{j:08x}")
        i = j + 1
    return "".join(out)


@lru_cache(maxsize=1)
def _near_words():
    """The splitting pattern with its classes written out for code points below U+0250."""
    letters, numbers = (_ranges(lambda c, k=k: unicodedata.category(c)[0] == k, 0x250) for k in "LN")
    return re.compile(f"{CONTRACTIONS}|[{letters}]+|[{numbers}]|[^{SPACES}{letters}{numbers}]+")


#: What the library has beyond this Python's Unicode: letters and numbers of version 16, lower case of version 17.
LATER_L = [(0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0)]
LATER_N = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]
_later = {0xA7CB: 0x264, 0xA7DC: 0x19B} | {c: c + 1 for c in (0x1C89, 0xA7CC, 0xA7CE, 0xA7D2, 0xA7D4, 0xA7DA)} | {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
_later_any = re.compile("[" + "".join(map(chr, _later)) + "]")


@lru_cache(maxsize=1)
def _any_words():
    """The same for all code points."""
    letters, numbers = (
        _ranges(lambda c, k=k, more=more: unicodedata.category(c)[0] == k or any(a <= ord(c) <= b for a, b in more) and unicodedata.category(c) == "Cn", sys.maxunicode + 1) for k, more in (("L", LATER_L), ("N", LATER_N))
    )
    return re.compile(f"{CONTRACTIONS}|[{letters}]+|[{numbers}]|[^{SPACES}{letters}{numbers}]+")


def words(text: str) -> list[str]:
    """Pre-split words of a text without special tokens."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
        if "Σ" in text:  # no final form: each character is lowered for itself
            text = text.replace("Σ", "σ")
        if _later_any.search(text):
            text = text.translate(_later)
    text = text.lower()
    return (_any_words() if _far.search(text) else _near_words()).findall(text)


def pieces(text: str) -> list[str]:
    """Words and special tokens; a special token is its own string, which no word can equal."""
    if "<|" not in text:
        return words(text)
    out: list[str] = []
    for k, part in enumerate(_special.split(text)):
        if k % 2:
            out.append(part)
        elif part:
            out += words(part)
    return out


_white = re.compile(f"[{SPACES}]+")
#: Put between spans that are split at once; a span that holds it is split alone.
MARK = "\x01"


def spans(text: str) -> list[str]:
    """Runs of other characters than white space; no piece reaches over white space, so a text's pieces are those of its spans."""
    if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:  # white space to str.split(), not to the library
        return [x for x in _white.split(text) if x]
    return text.split()


def pieces_of_spans(some: list[str]) -> tuple[list[str], list[int]]:
    """The pieces of all spans behind each other, and where each span's end."""
    if any(MARK in x for x in some):
        out, ends = [], []
        for x in some:
            out += pieces(x)
            ends.append(len(out))
        return out, ends
    out = pieces(f" {MARK} ".join(some))
    at = [i for i, p in enumerate(out) if p == MARK]
    return [p for p in out if p != MARK], [i - k for k, i in enumerate(at)] + [len(out) - len(at)] * bool(some)


class SpanTable:
    """Values of spans. ``learn`` gives the values of a batch's new spans; they are remembered, long ones for the batch only, so that
    the memory is bounded in number and bytes."""

    def __init__(self, learn, most: int = 1_000_000, longest: int = 64):
        self.learn, self.most, self.longest, self.known = learn, most, longest, {}

    def of(self, texts: list[str] | pa.Array, fold=list) -> list:
        """The values of each text's spans, folded. A null text is empty."""
        collected = gc.isenabled()
        gc.disable()  # nothing here has cycles, and a collection walks all that is remembered
        try:
            return self._of(pa.array(texts, pa.string()) if isinstance(texts, list) else texts, fold)
        finally:
            if collected:
                gc.enable()

    def _values(self, some: list[str]) -> list:
        """Values of distinct spans."""
        if len(self.known) > self.most:
            self.known.clear()
        known = self.known
        out = list(map(known.get, some))
        at = [i for i, v in enumerate(out) if v is None]
        new = [some[i] for i in at]
        if new:
            values = self.learn(new)
            known.update((x, v) for x, v in zip(new, values, strict=True) if len(x) <= self.longest)
            for i, v in zip(at, values, strict=True):
                out[i] = v
        return out

    def _of(self, texts: pa.Array, fold) -> list:
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = texts.fill_null("")
        raw = texts.buffers()[2]
        if raw is not None and (np.frombuffer(raw, dtype=np.uint8) - 0x1C < 4).any():  # white space to Arrow, not to the library
            split = pa.array([spans(t) for t in texts.to_pylist()], pa.list_(pa.string()))
        else:
            split = pc.utf8_split_whitespace(texts)
        full = pc.not_equal(split.values, "").to_numpy(zero_copy_only=False)  # white space at an end makes an empty span
        ends = np.r_[0, np.cumsum(full)][split.offsets.to_numpy()].tolist()
        coded = split.values.filter(pa.array(full, pa.bool_())).dictionary_encode()
        values = self._values(coded.dictionary.to_pylist())
        at = coded.indices.to_numpy(zero_copy_only=False)
        return [fold(map(values.__getitem__, at[a:b].tolist())) for a, b in zip(ends, ends[1:], strict=False)]


SPECIAL = ("<|startoftext|>", "<|endoftext|>")


@lru_cache(maxsize=4)
def load(path: str) -> tuple[dict[str, int], list[tuple[str, str]], dict[str, int]]:
    """Vocabulary, merges in rank order and special tokens of a tokenizer file."""
    with open(path, encoding="utf-8") as f:
        d = json.load(f)
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in d["model"]["merges"]]
    return {sys.intern(k): v for k, v in d["model"]["vocab"].items()}, merges, {t["content"]: t["id"] for t in d["added_tokens"]}


@lru_cache(maxsize=1)
def byte_chars() -> list[str]:
    """The printable character that stands for each byte."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return [chr(b) if b in own else chr(256 + rest.index(b)) for b in range(256)]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
