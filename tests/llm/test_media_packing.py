import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sieveline.llm import clip_words, media_png, packing


def paeth_png(samples: np.ndarray, kinds: list[int]) -> bytes:
    """A writer with any filters, sample by sample."""
    h, w = samples.shape
    lines = bytearray()
    at = lambda r, c: int(samples[r, c]) if r >= 0 and c >= 0 else 0
    for r in range(h):
        k = kinds[r]
        lines.append(k)
        for c in range(w):
            a, b, d = at(r, c - 1), at(r - 1, c), at(r - 1, c - 1)
            p = a + b - d
            near = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - d) else b if abs(p - b) <= abs(p - d) else d
            lines.append((at(r, c) - [0, a, b, (a + b) // 2, near][k]) & 255)
    head = media_png._chunk(b"IHDR", media_png.struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0))
    return media_png.SIGNATURE + head + media_png._chunk(b"tEXt", b"x") + media_png._chunk(b"IDAT", zlib.compress(bytes(lines))) + media_png._chunk(b"IEND", b"")


def test_all_filters_and_broken_files():
    rng = np.random.default_rng(1)
    samples = rng.integers(0, 256, (40, 7), dtype=np.uint8)
    data = paeth_png(samples, [int(k) for k in rng.integers(0, 5, 40)])
    assert (media_png.decode_png(data) == samples).all()
    assert (media_png.decode_png(media_png.encode_png(samples)) == samples).all()
    for i in (3, 20, 50, len(data) - 5):
        broken = bytearray(data)
        broken[i] ^= 1
        with pytest.raises(ValueError):
            media_png.decode_png(bytes(broken))
    with pytest.raises(ValueError):
        media_png.decode_png(data[:-12])


def test_hash_is_stable_under_small_changes():
    rng = np.random.default_rng(4)
    coarse = rng.integers(20, 230, (8, 8))  # all low frequencies take part
    a = np.kron(coarse, np.ones((30, 3))).astype(np.uint8)
    b = a.copy()
    b[::17, ::5] += 2
    ha, hb = (int(media_png.cosine_hash(v), 16) for v in (a, b))
    assert (ha ^ hb).bit_count() <= 6
    assert (ha ^ int(media_png.cosine_hash(a.T[::-1].copy()), 16)).bit_count() > 10


def test_images_of_texts(spark):
    rows = [(1, "abc", 0), (2, None, 0), (3, "", 0), (4, "é" * 100_000, 0), (4, "é" * 100_000, 1), (None, "x" * 576, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, media int")
    images = media_png.text_images(df)
    got = media_png.image_features(images).collect()
    media = {r.doc_id: bytes(r.media) for r in images.collect()}
    assert len(got) == len(rows)
    for r in got:
        data = (next(t for i, t, _ in rows if i == r.doc_id) or "").encode()
        full = data + b"\xff" * (max(576, -(-len(data) // 576) * 576) - len(data))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(data), len(full), hashlib.sha256(full).hexdigest())
        assert r.tail_crc32 == zlib.crc32(full[-32:]) and r.media_sha256 == hashlib.sha256(media[r.doc_id]).hexdigest() and r.media_bytes == len(media[r.doc_id])
        assert media_png.decode_png(media[r.doc_id]).tobytes() == full
    assert media_png.image_features(media_png.text_images(df.where("false"))).count() == 0
    nothing = images.selectExpr("doc_id", "n_bytes", "cast(null as binary) as media", "'x' as feature")
    assert {r.feature for r in media_png.image_features(nothing).collect()} == {None}


def test_sum_of_squares_is_greedy_on_the_stated_sum():
    rng = random.Random(5)
    for _ in range(20):
        cap, sizes = 20, [rng.randint(1, 22) for _ in range(60)]
        sizes = [min(s, cap) for s in sizes]
        bins, offsets, made = packing.sum_of_squares(sizes, cap)
        left: dict[int, int] = {}
        for s, b, o in zip(sizes, bins, offsets, strict=True):
            def total(fill):
                n: dict[int, int] = {}
                for g in fill.values():
                    if 0 < g < cap:
                        n[g] = n.get(g, 0) + 1
                return sum(v * v for v in n.values())

            options = {total(left | {k: g - s}) for k, g in left.items() if g >= s} | {total(left | {-1: cap - s})}
            assert o == cap - left.get(b, cap)
            left[b] = left.get(b, cap) - s
            assert left[b] >= 0 and (s == cap or total(left) == min(options))
        assert made == len(left)


def test_packing_documents(spark):
    words = ["word " * 3000, "a b c " * 2000, None, "", "x", "x", "hello there"] + ["w " * (i * 13 % 700) for i in range(300)]
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(words)] + [(4, "x", 4), (None, "x", 5)], "doc_id long, text string, piece int")
    out = packing.pack_documents(df, shard=100).collect()
    library = Tokenizer.from_file(clip_words.default_path())
    ids = {i: library.encode(t or "", add_special_tokens=False).ids + [0] for i, t in enumerate(words)} | {None: library.encode("x", add_special_tokens=False).ids + [0]}
    for r in out:
        own = ids[r.doc_id][r.piece * 2048 : (r.piece + 1) * 2048]
        assert r.start == r.piece * 2048 and r.length == len(own) and r.ids_crc32 == zlib.crc32(np.array(own, dtype="<u4").tobytes())
    assert len(out) == sum(-(-len(v) // 2048) for v in ids.values()) + 1
    places: dict[int, list] = {}
    for r in out:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for v in places.values():
        end = 0
        for o, n in sorted(v):
            assert o == end
            end += n
        assert end <= 2048
    total = sum(r.length for r in out)
    assert len(places) <= 1.1 * total / 2048 + 5
    assert packing.pack_documents(df.where("false")).count() == 0


def test_equal_rows_spread_over_shards(spark):
    docs = spark.range(100_000).selectExpr("cast(null as long) as doc_id", "'same words' as text")
    out = packing.pack_documents(docs, shard=10_000)
    sizes = [r["count"] for r in out.groupBy(F.shiftright("sequence_id", 32).alias("shard")).count().collect()]
    assert len(sizes) == 10 and max(sizes) < 11_000 and sum(sizes) == 100_000
