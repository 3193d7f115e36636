import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from sieveline.llm import bpe_automaton, clip_words, packing, token_counts

PATH = clip_words.default_path()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def auto():
    return bpe_automaton.TokenAutomaton(PATH)


def samples() -> list[str]:
    rng = random.Random(7)
    near = "ab'sthe1 <|>é \n\t\x1d²ßİΣÀ̀"
    far = near + "中文字あア한Ω٣ 　😀"
    made = ["".join(rng.choice(a) for _ in range(rng.randint(0, 50))) for a in (near, far) for _ in range(1500)]
    return made + ["", " ", "aaaaaaaa" * 50, "'''s't''re", "a<|endoftext|>b <|startoftext|>", "<|endoftext", "a\x1cb \x1f", "\x01 a\x01b \x01\x01", "ΑΣ ΣΑΣ", "x" * 5000]


def test_every_code_point(library):
    codes = [c for c in range(0x31400) if not (0xD800 <= c < 0xE000 or 0x4E80 <= c < 0xD700 or 0x20100 <= c < 0x2A600)]
    some = [f"a{chr(c)}b" for c in codes]
    coder = bpe_automaton.Coder(PATH)
    for i in range(0, len(some), 100_000):
        part = some[i : i + 100_000]
        for t, (ids, _), e in zip(part, coder.code(part), library.encode_batch(part, add_special_tokens=False), strict=True):
            assert ids == " ".join(map(str, e.ids)), hex(codes[some.index(t)])


def test_rank_merging_and_automaton_equal_the_library(library, auto):
    counter = token_counts.Counter(PATH)
    texts = samples()
    counts = counter.count(texts)
    ids, coded = packing.IdTable(PATH).of(texts), bpe_automaton.Coder(PATH).code(texts)
    for t, n, e in zip(texts, counts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert n == len(e.ids), t
        assert np.frombuffer(ids[texts.index(t)], dtype="<u4").tolist() == e.ids, t
        assert auto.encode(t) == e.ids, t
        assert coded[texts.index(t)] == (" ".join(map(str, e.ids)), library.decode(e.ids, skip_special_tokens=False)), t
        assert auto.decode(e.ids) == library.decode(e.ids, skip_special_tokens=False)


def test_gadget_order_decides(tmp_path):
    """u = v, and a later merge that an earlier one has to leave alone."""
    import json

    chars = clip_words.byte_chars()
    vocab = {c: i for i, c in enumerate(chars + [c + "</w>" for c in chars])}
    merges = [("a", "a"), ("aa", "aa"), ("b", "c"), ("a", "b"), ("ab", "c"), ("c", "a"), ("aa", "a</w>")]
    for a, b in merges:
        vocab[a + b] = len(vocab)
    model = {"type": "BPE", "end_of_word_suffix": "</w>", "vocab": vocab, "merges": merges}
    added = [{"id": len(vocab) + k, "content": s, "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True} for k, s in enumerate(clip_words.SPECIAL)]
    path = str(tmp_path / "t.json")
    whole = json.load(open(PATH)) | {"model": model, "added_tokens": added}
    json.dump(whole, open(path, "w"))
    lib, own, merger = Tokenizer.from_file(path), bpe_automaton.TokenAutomaton(path), token_counts.RankMerger(path)
    rng = random.Random(3)
    for _ in range(3000):
        w = "".join(rng.choice("abc") for _ in range(rng.randint(1, 14)))
        ids = lib.encode(w, add_special_tokens=False).ids
        assert own.encode_word(w) == ids, w
        assert merger.tokens([w])[0].tolist() == ids, w


def test_documents(spark, library):
    rows = [(1, "Hello World's", "x"), (2, None, "x"), (3, "", None), (3, "", None), (None, "word " * 3000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(df).collect()}
    assert got == {(1, 13, 3, False), (2, 0, 0, False), (3, 0, 0, False), (None, 15000, 3000, True)}
    coded = bpe_automaton.code_documents(df).collect()
    assert len(coded) == 5
    for r in coded:
        text = next(t for i, t, _ in rows if i == r.doc_id) or ""
        ids = library.encode(text, add_special_tokens=False).ids
        assert r.token_ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    empty = df.where("false")
    assert token_counts.count_tokens(empty).count() == 0 and bpe_automaton.code_documents(empty).count() == 0
