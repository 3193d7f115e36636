"""Binary media columns: texts as grey PNG images, their reader, and low-frequency cosine-transform hashes.

``encode_png`` writes 8-bit grey samples with a row filter per line (none, sub or up, by the smallest sum of absolute
differences) and one zlib stream in IDAT chunks. ``decode_png`` tests signature, chunk checksums, lengths and the zlib
checksum, and undoes all five row filters with numpy. The hash averages the image to 32 x 32, takes the two-dimensional
cosine transform and compares its 8 x 8 lowest frequencies with their median.

A null or empty text gives one padded block of 576 bytes 255. Equal texts have equal images. Repeated rows stay; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, texts

SIGNATURE = b"\x89PNG\r\n\x1a\n"
BLOCK, WIDTH = 576, 24
CHUNK = 1 << 16


def payload(text: str) -> bytes:
    data = text.encode("utf-8")
    return data + b"\xff" * (max(BLOCK, -(-len(data) // BLOCK) * BLOCK) - len(data))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(samples: np.ndarray, level: int = 6) -> bytes:
    """samples: rows x columns of bytes."""
    h, w = samples.shape
    left = np.zeros_like(samples)
    left[:, 1:] = samples[:, :-1]
    above = np.zeros_like(samples)
    above[1:] = samples[:-1]
    tried = np.stack([samples, samples - left, samples - above])
    cost = np.abs(tried.view(np.int8).astype(np.int16)).sum(axis=2)
    kind = cost.argmin(axis=0)
    lines = np.empty((h, w + 1), dtype=np.uint8)
    lines[:, 0], lines[:, 1:] = kind, tried[kind, np.arange(h)]
    stream = zlib.compress(lines.tobytes(), level)
    parts = [_chunk(b"IDAT", stream[i : i + CHUNK]) for i in range(0, len(stream), CHUNK)]
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + b"".join(parts) + _chunk(b"IEND", b"")


def chunks(data: bytes):
    """(kind, body) of each chunk up to IEND, with tests of the signature, the lengths and the checksums."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG file")
    at = 8
    while at + 12 <= len(data):
        (n,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        if at + 12 + n > len(data):
            break
        body = data[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + n)[0]:
            raise ValueError(f"checksum of chunk {kind!r}")
        yield kind, body
        at += 12 + n
        if kind == b"IEND":
            return
    raise ValueError("the file ends early")


def _unfilter(lines: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Undoes the row filters of one byte a sample. Runs of rows with one filter that needs no other row go at once."""
    h, w = lines.shape
    out = np.empty_like(lines)
    starts = np.flatnonzero(np.r_[True, kind[1:] != kind[:-1]])
    for a, b in zip(starts, np.r_[starts[1:], h], strict=True):
        k, above = kind[a], out[a - 1] if a else np.zeros(w, dtype=np.uint8)
        if k == 0:
            out[a:b] = lines[a:b]
        elif k == 1:
            out[a:b] = np.cumsum(lines[a:b], axis=1, dtype=np.uint8)
        elif k == 2:
            out[a:b] = np.cumsum(np.vstack([above, lines[a:b]]), axis=0, dtype=np.uint8)[1:]
        elif k in (3, 4):
            # a sample needs those to its left, above and between: all samples of one diagonal go at once
            done = np.zeros((b - a + 1, w + 1), dtype=np.int64)
            done[0, 1:] = above
            for step in range(b - a + w - 1):
                r = np.arange(max(0, step - w + 1), min(b - a, step + 1))
                c = step - r
                left, up, corner = done[r + 1, c], done[r, c + 1], done[r, c]
                if k == 3:
                    guess = (left + up) // 2
                else:
                    to_left, to_up, to_corner = np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)
                    guess = np.where((to_left <= to_up) & (to_left <= to_corner), left, np.where(to_up <= to_corner, up, corner))
                done[r + 1, c + 1] = (lines[a + r, c] + guess) & 255
            out[a:b] = done[1:, 1:]
        else:
            raise ValueError(f"row filter {k}")
    return out


def decode_png(data: bytes) -> np.ndarray:
    """Rows x columns of an 8-bit grey image without interlacing."""
    header, stream = None, []
    for kind, body in chunks(data):
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            stream.append(body)
        elif kind != b"IEND" and not kind[0] & 32:
            raise ValueError(f"critical chunk {kind!r}")
    if header is None or header[2:] != (8, 0, 0, 0, 0):
        raise ValueError("only 8-bit grey images without interlacing")
    w, h = header[:2]
    raw = zlib.decompress(b"".join(stream))
    if len(raw) != h * (w + 1):
        raise ValueError("length of the samples")
    lines = np.frombuffer(raw, dtype=np.uint8).reshape(h, w + 1)
    return _unfilter(lines[:, 1:], lines[:, 0])


@lru_cache(maxsize=1)
def _cosines() -> np.ndarray:
    k, x = np.arange(8)[:, None], np.arange(32)[None]
    return np.cos(np.pi * k * (2 * x + 1) / 64) * np.where(k == 0, np.sqrt(1 / 32), np.sqrt(2 / 32))


def _averaged(a: np.ndarray, n: int) -> np.ndarray:
    """The first axis averaged to n rows; rows are repeated where there are fewer."""
    m = len(a)
    if m < n:
        return a[(np.arange(n) * m) // n]
    edges = (np.arange(n + 1) * m) // n
    return np.add.reduceat(a, edges[:-1], axis=0) / np.diff(edges)[:, None]


def cosine_hash(samples: np.ndarray) -> str:
    """64 bits in hex: which low-frequency coefficients exceed their median."""
    small = _averaged(_averaged(samples.astype(np.float64), 32).T, 32).T
    c = _cosines()
    low = np.round(c @ small @ c.T, 6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes().hex()


def text_images(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the binary column media of each row's text."""
    prepare(docs.sparkSession)

    def run(batches):
        for b in batches:
            t = b.column("text").to_pylist()
            media = [encode_png(np.frombuffer(payload(x), dtype=np.uint8).reshape(-1, WIDTH)) for x in t]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    sized = texts(docs).withColumn("n_bytes", F.octet_length("text").cast("long"))
    return sized.mapInArrow(run, "doc_id long, n_bytes long, media binary")


def image_features(images: DataFrame) -> DataFrame:
    """Sizes and digests of payload and stored form, and the feature, read back from the stored bytes (doc_id, n_bytes, media).

    A null image has null figures.
    """
    prepare(images.sparkSession)
    kinds = {"payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string()}

    def one(media: bytes | None) -> tuple:
        if media is None:
            return (None,) * len(kinds)
        image = decode_png(media)
        back = image.tobytes()
        return len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), cosine_hash(image)

    def run(batches):
        for b in batches:
            cols = list(zip(*map(one, b.column("media").to_pylist()), strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), *(pa.array(c, k) for c, k in zip(cols, kinds.values(), strict=True))], ["doc_id", "n_bytes", *kinds])

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return images.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)
