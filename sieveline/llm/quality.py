"""Quality classifier: naive Bayes support vectors.

A document is a set of hashed n-gram indicators: white-space words, word pairs, the shapes of words (letters, capitals,
digits and signs in place of the characters), shape pairs, and how often a word repeats the one before it, in tenths. The training sample gives each indicator its class
log-count ratio; indicators scaled by it, and each document then brought to length one, are fitted by a linear model with hinge loss through
dual coordinate descent. The weights are drawn towards their mean size (the usual interpolation). A logistic curve
fitted on a part of the sample that the model has not seen turns margins into scores between 0 and 1.

Labels are learned from the ``sample`` labelled rows of the training folds with the smallest hashes, as long as their documents
have at most ``entries`` indicators together; these bounds are parameters, and what reaches the driver is hashed
indicators, four bytes each. Scoring reads every row and whole text.

Null and empty texts have no indicators; their score is that of the bias. Without labels of both classes every score
is 0.5. A label row with a null doc_id or quality is left out; repeated label rows count once, different labels of one document
count each, and of several texts of a doc_id one is learned from. A null doc_id is scored; it is not held out, as its remainder is unknown. Repeated rows are scored for themselves.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, prepare, table, texts, unused

BITS = 18
#: Labelled rows that a model is fitted on, at most.
SAMPLE = 6_000
#: Indicators of these rows' documents, at most.
ENTRIES = 16_000_000
CUT = 0.3
REMEMBERED = 250_000

_digits, _upper, _lower = re.compile(r"[0-9]+"), re.compile(r"[^\W\d_a-zß-ÿ]+"), re.compile(r"[^\W\d_A-Z]+")


def _shape(word: str) -> str:
    """Fewer than 8 signs; runs of letters and digits as one."""
    return _lower.sub("a", _upper.sub("A", _digits.sub("9", word)))[:8]


class Hashes(dict):
    """Hashes of a word and its shape; long words are hashed anew each time, so that the memory is bounded in bytes."""

    def __missing__(self, word: str) -> int:
        found = zlib.crc32(word.encode()) | zlib.crc32(_shape(word).encode(), 7) << 32
        if len(word) <= 64:
            self[word] = found
        return found


class Indicators:
    """Sets of hashed n-gram indicators; word hashes are remembered."""

    def __init__(self, bits: int = BITS):
        self.mask, self.known = np.uint64((1 << bits) - 1), Hashes()

    def of(self, text: str) -> np.ndarray:
        words = text.split()
        if len(self.known) > REMEMBERED:
            self.known.clear()
        if not words:
            return np.empty(0, dtype=np.int64)
        both = np.fromiter(map(self.known.__getitem__, words), dtype=np.uint64, count=len(words))
        word, shape = both & np.uint64(0xFFFFFFFF), both >> np.uint64(32)
        again = np.array([round(10 * float((word[1:] == word[:-1]).mean())) if len(word) > 1 else 11], dtype=np.uint64)
        mixed = [again, word, word[:-1] * np.uint64(31) + word[1:] * np.uint64(1_000_003), shape, shape[:-1] * np.uint64(37) + shape[1:] * np.uint64(1_000_033)]
        keys = (np.concatenate([(m + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15) for k, m in enumerate(mixed)]) >> np.uint64(40)) & self.mask
        if len(keys) > 20_000:  # very long texts
            hit = np.zeros(int(self.mask) + 1, dtype=bool)
            hit[keys.astype(np.int64)] = True
            return np.flatnonzero(hit)
        keys = np.sort(keys.astype(np.int64))
        return keys[np.r_[True, keys[1:] != keys[:-1]]]


@dataclass
class Model:
    weights: np.ndarray  # float32, of scaled indicators before the length is taken out
    scale: np.ndarray  # float32, squared log-count ratios
    bias: float
    slope: float
    shift: float

    def margin(self, x: np.ndarray) -> float:
        return float(self.weights[x].sum(dtype=np.float64) / max(np.sqrt(self.scale[x].sum(dtype=np.float64)), 1e-9)) + self.bias if len(x) else self.bias

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        """Scores of a batch of documents."""
        m = np.fromiter(map(self.margin, rows), dtype=np.float64, count=len(rows))
        return 1 / (1 + np.exp(-np.clip(self.slope * m + self.shift, -30, 30)))

    def score(self, x: np.ndarray) -> float:
        return float(self.scores([x])[0])


def log_count_ratio(rows: list[np.ndarray], y: np.ndarray, size: int) -> np.ndarray:
    count = np.ones((2, size))
    for x, k in zip(rows, y, strict=True):
        count[k, x] += 1
    p = count / count.sum(axis=1, keepdims=True)
    return np.log(p[1] / p[0])


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, size: int, cost: np.ndarray, rounds: int = 20, seed: int = 1) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear model with hinge loss; cost per row. The bias is a feature of value 1.

    Each row's multiplier lies between 0 and its cost, and is moved to the best place there with all others fixed.
    """
    sign = np.where(y == 1, 1.0, -1.0)
    square = np.array([float(v @ v) + 1 for v in values])
    alpha, w, bias = np.zeros(len(rows)), np.zeros(size), 0.0
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        most = 0.0
        for i in rng.permutation(len(rows)):
            x, v = rows[i], values[i]
            g = sign[i] * (float(w[x] @ v) + bias) - 1
            new = min(max(alpha[i] - g / square[i], 0.0), cost[i])
            if new == alpha[i]:
                continue
            most = max(most, abs(g))
            step = (new - alpha[i]) * sign[i]
            w[x] += step * v
            bias += step
            alpha[i] = new
        if most < 0.01:
            break
    return w, bias


def logistic_curve(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton steps with smoothed targets."""
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        g, h = np.array([((p - target) * m).sum() + 1e-3 * a, (p - target).sum()]), p * (1 - p)
        hess = np.array([[(h * m * m).sum() + 1e-3, (h * m).sum()], [(h * m).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hess, g)
        a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return max(float(a), 1e-3), float(b)


def fit(rows: list[np.ndarray], y: np.ndarray, folds: np.ndarray, bits: int = BITS, beta: float = 0.25) -> Model | None:
    """folds: true for rows that only fit the curve. None if a class is missing."""
    size = 1 << bits
    own = np.flatnonzero(~folds)
    if len({*y[own].tolist()}) < 2:
        return None
    some, target = [rows[i] for i in own], y[own]
    r = log_count_ratio(some, target, size)
    values = [(v := r[x]) / max(np.sqrt(v @ v), 1e-9) for x in some]
    share = np.where(target == 1, (target == 1).mean(), (target == 0).mean())
    w, bias = dual_coordinate_descent(some, values, target, size, 1.0 / (2 * share))
    w = (1 - beta) * np.abs(w).mean() + beta * w
    model = Model((w * r).astype(np.float32), (r * r).astype(np.float32), bias, 1.0, 0.0)
    rest = np.flatnonzero(folds)
    check = rest if len({*y[rest].tolist()}) == 2 else own
    model.slope, model.shift = logistic_curve(np.array([model.margin(rows[i]) for i in check]), y[check])
    return model


def remainder(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.encode(doc_id.cast("string"), "utf-8")), F.lit(5))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, bits: int = BITS, entries: int = ENTRIES) -> Model | None:
    """Fits ``labels.quality`` on rows whose crc32(doc_id) mod 5 is not 0."""
    spark = docs.sparkSession
    prepare(spark)
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)").where(remainder(F.col("doc_id")) != 0)
    chosen = usable.distinct().orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id", "quality").limit(sample)
    found = texts(docs).join(F.broadcast(chosen), "doc_id")  # sample rows at most

    def run(batches):
        of = Indicators(bits).of
        for b in batches:
            x = [of(t).astype(np.int32).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality"), pa.array(x, pa.binary())], ["doc_id", "quality", "x"])

    rows = found.select("doc_id", "quality", "text").mapInArrow(run, "doc_id long, quality int, x binary")
    one = rows.groupBy("doc_id", "quality").agg(F.min("x").alias("x"))  # a doc_id may come again
    scratch = Scratch(spark, "quality")
    saved = scratch.save(one.withColumns({"place": F.xxhash64("doc_id", F.lit(11)), "n": F.length("x") / 4}), "rows")
    sizes = saved.select("place", "n").orderBy("place").collect()  # sample rows at most
    total, last = 0.0, None
    for r in sizes:
        total += r.n
        if total > entries:
            break
        last = r.place
    got = [] if last is None else saved.where(F.col("place") <= last).select("doc_id", "quality", "x").collect()
    scratch.drop("rows")
    got.sort(key=lambda r: (r.doc_id, r.quality))
    if not got:
        return None
    folds = np.array([zlib.crc32(str(r.doc_id).encode()) % 5 == 1 for r in got])
    return fit([np.frombuffer(r.x, dtype=np.int32) for r in got], np.array([r.quality for r in got]), folds, bits)


def score(docs: DataFrame, model: Model | None, bits: int = BITS, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id and score for every row; ``keep`` names columns that are carried along."""
    spark = docs.sparkSession
    prepare(spark)
    if model is None:
        return docs.select("doc_id", *keep, F.lit(0.5).alias("score"))
    shared = spark.sparkContext.broadcast(model)  # 2 floats for each of 2 ** bits indicators
    whole = unused(docs, "whole_text")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keep, F.coalesce("text", F.lit("")).alias(whole))
    schema = source.drop(whole).withColumn("score", F.lit(0.5)).schema

    def run(batches):
        of, m = Indicators(bits).of, shared.value
        for b in batches:
            s = pa.array(m.scores([of(t) for t in b.column(whole).to_pylist()]), pa.float64())
            cols = [b.column(c) for c in ("doc_id", *keep)]
            yield pa.RecordBatch.from_arrays([*cols, s], ["doc_id", *keep, "score"])

    return source.mapInArrow(run, schema)


def keep(docs: DataFrame, model: Model | None, cut: float = CUT, bits: int = BITS) -> DataFrame:
    """The rows of ``docs``, with all columns, whose score is at least ``cut``; all rows without a model."""
    if model is None:
        return docs
    spark = docs.sparkSession
    prepare(spark)
    shared, at = spark.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches):
        of, m = Indicators(bits).of, shared.value
        for b in batches:
            yield b.filter(pa.array(m.scores([of(t or "") for t in b.column(at).to_pylist()]) >= cut, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def judge(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``."""
    scored = score(docs, train(docs, labels, sample))
    held = F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
