"""Near-duplicate classes by fast similarity sketching, banding and exact verification.

Words are runs of non-blanks with A-Z lower-cased; a document's set holds its distinct shingles of ``words`` words, or its
whole word sequence if it has fewer; without words the set is empty and linked with nothing. Two documents are linked
when 100 * |intersection| >= percent * |union|, which is tested on the full sets. The class of a document is the smallest
doc_id that links reach from it.

* Sketch: in round i every element is thrown by a fresh hash into one of t bins, and a bin keeps its smallest (round,
  hash) pair; rounds t to 2t - 1 throw all elements into bin i - t. The rounds end when every bin is filled, so every
  coordinate has a value, and coordinates agree with the sets' similarity in expectation, concentrated as if independent.
* Bands of ``rows`` coordinates each are bucket keys. With 48 bands of 8, a pair of similarity 0.85 shares no bucket with
  a probability of 3e-7, the only way in which a link can be lost.
* Documents with one word sequence are one node. Verification compares whole sets, a shingle being named by a 64-bit
  fingerprint (two shingles of a pair of documents with 1,000 each share a name with a probability of 1e-13). A bucket's members are
  compared with one hub, the smallest, and what verification links is joined into classes. Where a hub's members still are in
  several classes, they are compared with one center of the largest of these classes, and meet again where their differences from it
  agree: exact prefix filters over the differences' rarest elements (``difference_keys``), so that members which are linked share a key.
  Keys that hold several classes go on, with 16, 512, 16384, ... hubs taken out of a key per round, until each has been compared with
  all members of other classes. Pairs are left out only if they share a class already or if the sizes of sets or differences,
  the places of the shared element in them or parity bits of their elements forbid a link; none of these can change the result.
* From the full sets on, all steps are joins and aggregates on ids and arrays of fingerprints; a frequent hub's side can be split.

A null doc_id gets its set size, no class, and stays (kept). Rows that repeat a doc_id and text are returned as often;
if the texts differ, they count as copies of one document, since the doc_id names it. Other columns are ignored.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, prepare, table, texts, unused

BANDS, ROWS = 48, 8
PARITY = ("s0", "s1", "s2", "s3")
REMEMBERED = 250_000


def words(text: str) -> list[bytes]:
    return text.encode("utf-8").lower().split()  # bytes: only A-Z and ASCII blanks


def shingles(ws: list[bytes], n: int) -> set:
    """n-word shingles; fewer words are one shingle, no words none."""
    return set(zip(*(ws[i:] for i in range(n)), strict=False)) if len(ws) >= n else {tuple(ws)} if ws else set()


@lru_cache(maxsize=4)
def _salts(t: int) -> np.ndarray:
    return np.random.default_rng(2017).integers(1, 1 << 63, 2 * t, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sketch(elements: np.ndarray, t: int) -> np.ndarray:
    """t coordinates of a non-empty set of 64-bit hashes."""
    n, salts, empty = len(elements), _salts(t), np.uint64(0xFFFFFFFFFFFFFFFF)
    bins = np.full(t, empty)
    i = 0
    expected = math.ceil(t * (math.log(t) + 1) / n)  # rounds until all bins are filled, about
    while i < 2 * t:
        free = i < t
        # rounds in one block; a round after the last needed one can't change a filled bin, its values are larger
        block = min((t if free else 2 * t) - i, max(1, min(expected, 65_536 // n)))
        h = _mix(elements[None, :] + salts[i : i + block, None])
        rounds = np.arange(i, i + block, dtype=np.uint64)[:, None]
        value = (rounds << np.uint64(44)) | (h & np.uint64((1 << 44) - 1))
        if free:
            where = ((h >> np.uint64(44)) * np.uint64(t)) >> np.uint64(20)
            np.minimum.at(bins, where.ravel().astype(np.int64), value.ravel())
        else:
            at = np.arange(i - t, i - t + block)
            bins[at] = np.minimum(bins[at], value.min(axis=1))
        i += block
        if bins.max() != empty:
            break
    return bins


class Names(dict):
    """64-bit names of words; long words are named anew each time, so that the memory is bounded in bytes."""

    def __missing__(self, word: bytes) -> int:
        name = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = name
        return name


class Fingerprints:
    """The distinct 64-bit fingerprints of a text's shingles, in order."""

    def __init__(self, n: int):
        self.n, self.known = n, Names()

    def of(self, ws: list[bytes]) -> np.ndarray:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        if len(ws) < self.n:
            return _mix(np.array([xxhash.xxh3_64_intdigest(b" ".join(ws))] if ws else [], dtype=np.uint64))
        h = np.fromiter(map(self.known.__getitem__, ws), dtype=np.uint64, count=len(ws))
        each = np.full(len(ws) - self.n + 1, np.uint64(0))
        for k in range(self.n):
            each = _mix(each * np.uint64(31) + h[k : len(h) - self.n + 1 + k])
        return np.unique(each)


class Sketcher:
    def __init__(self, n: int, bands: int, rows: int):
        self.bands, self.rows, self.prints = bands, rows, Fingerprints(n)

    def of(self, text: str) -> tuple[int, bytes | None, list[int] | None]:
        """Set size, digest of the word sequence and band keys; the last two are null for an empty set."""
        ws = words(text)
        if not ws:
            return 0, None, None
        elements = self.prints.of(ws)
        bins = sketch(elements, self.bands * self.rows).reshape(self.bands, self.rows)
        key = np.arange(self.bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for k in range(self.rows):
            key = _mix(key * np.uint64(31) + bins[:, k])
        return len(elements), xxhash.xxh3_128_digest(b" ".join(ws)), key.view(np.int64).tolist()


def sketches(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    def run(batches):
        s = Sketcher(n, bands, rows)
        for b in batches:
            cols = list(zip(*map(s.of, b.column("text").to_pylist()), strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.list_(pa.int64()))], ["doc_id", "n", "seq", "bands"])

    return texts(docs).mapInArrow(run, "doc_id long, n long, seq binary, bands array<long>")


def full_sets(docs: DataFrame, n: int) -> DataFrame:
    """seq, n and the whole set of fingerprints of each row of ``docs``."""

    def run(batches):
        prints = Fingerprints(n)
        for b in batches:
            ws = [words(t) for t in b.column("text").to_pylist()]
            sets = [prints.of(w).view(np.int64) for w in ws]
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(b" ".join(w)) for w in ws], pa.binary()), pa.array(map(len, sets), pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["seq", "n", "elements"])

    return texts(docs).mapInArrow(run, "seq binary, n long, elements array<long>")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with the sizes na, nb of their whole sets, ``common`` of their intersection, linked, and both sets sa, sb."""
    side = lambda x: sets.select(F.col("node").alias(x), F.col("n").alias("n" + x), F.col("elements").alias("s" + x))
    both = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("common", F.size(F.array_intersect("sa", "sb")).cast("long"))
    return both.withColumn("linked", (F.col("common") > 0) & (100 * F.col("common") >= percent * (F.col("na") + F.col("nb") - F.col("common"))))


def components(scratch: Scratch, links: DataFrame, name: str) -> DataFrame:
    """(id, c) for every end of a link: the smallest id of its component, by minimum labels and pointer jumps."""
    edges = scratch.save(links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v"))), f"{name}-edges")
    label = scratch.save(edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("m")).select("id", F.least("id", "m").alias("c")), f"{name}-0")
    step = 0
    while True:
        near = edges.join(label.select(F.col("id").alias("v"), "c"), "v").groupBy(F.col("u").alias("id")).agg(F.min("c").alias("m"))
        own = label.join(near, "id").select("id", F.least("c", "m").alias("n"), "c")
        target = label.select(F.col("id").alias("n"), F.col("c").alias("jump"))
        step += 1
        new = scratch.save(own.join(target, "n", "left").select("id", F.least("n", "jump").alias("c"), (F.least("n", "jump") != F.col("c")).alias("changed")), f"{name}-{step}")
        scratch.drop(f"{name}-{step - 1}")
        if new.where("changed").isEmpty():
            scratch.drop(f"{name}-edges")
            return new.select("id", "c")
        label = new.select("id", "c")


def word_sequences(scratch: Scratch, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(seq, rep, node) of each distinct word sequence: its smallest doc_id, and an id that no other sequence has; and the doc_ids with several.

    Of a doc_id with several texts only one sequence takes the doc_id for its node; a sequence without any such doc_id is
    named by its hash.
    """
    h = F.xxhash64("seq")
    several = scratch.save(members.groupBy("doc_id").agg(F.min(h).alias("first"), F.max(h).alias("last")).where("first < last").select("doc_id", "first"), "several")
    own = members.select("doc_id", "seq").join(several, "doc_id", "left")
    named = own.groupBy("seq").agg(F.min("doc_id").alias("rep"), F.min(F.when(F.col("first").isNull() | (F.col("first") == h), F.col("doc_id"))).alias("node"))
    return scratch.save(named.select("seq", "rep", F.coalesce("node", h).alias("node")), "sequences"), several


def differences(scratch: Scratch, compared: DataFrame) -> DataFrame:
    """Orders the difference x, of size d, of members a (n elements) from their centers b (nb) by rarity.

    ``rare`` holds its elements that another member under the center has too, by rising number of members (ties by value); the
    d - size(rare) others come before them in the order. s0 to s3 are 256 parity bits of x: where those of two members differ,
    so do the members, in at least one element each.
    """
    element = compared.select("b", "a", F.explode("x").alias("e"))
    shared = element.groupBy("b", "e").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    lists = element.join(shared, ["b", "e"]).groupBy("b", "a").agg(F.sort_array(F.collect_list(F.struct("f", "e"))).alias("x"))
    ordered = lists.select("b", "a", F.transform("x", lambda y: y["e"]).alias("rare"))
    parity = [F.expr(f"aggregate(x, 0L, (s, e) -> s ^ if(shiftright(e, 6) & 3 = {k}, shiftleft(1L, cast(e & 63 as int)), 0L))").alias(f"s{k}") for k in range(4)]
    return scratch.save(compared.select("a", "b", "n", "nb", "d", *parity).join(ordered, ["b", "a"]), "differences")


def difference_keys(rare: DataFrame, percent: int) -> DataFrame:
    """(b, key, a, n, d, s0 to s3, pos): members under one center that are linked, but not both with the center, share a key.

    With D the symmetric difference of a set and the center's, xy's difference is that of Dx and Dy. x and y are linked exactly if it
    has at most k (|x| + |y|) elements, k = (1 - p) / (1 + p), so if |Dx & Dy| >= t = (|Dx| + |Dy| - k (|x| + |y|)) / 2. (If
    t <= 0, both are linked with the center.) Of two sets in one order with t elements in common, the first |D| - t + 1 elements of
    each share one. t is bounded from below for each level of |Dy|, levels being stretches of sizes, and a key names an
    element and the levels of both members, so that elements that many members share are mostly out of reach.
    """
    up, down = 100 + percent, 100 - percent
    width = F.greatest(F.lit(1), F.floor(down * F.col("nb") / up))
    reach = F.floor(down * F.col("n") / percent)
    own = rare.withColumns({"width": width, "level": F.floor(F.col("d") / width), "before": F.col("d") - F.size("rare")})
    levels = own.withColumn("other", F.explode(F.sequence(F.floor(F.greatest(F.lit(1), F.col("d") - reach) / F.col("width")), F.floor((F.col("d") + reach) / F.col("width")))))
    least, most = F.greatest(F.lit(1), F.col("other") * F.col("width")), F.col("other") * F.col("width") + F.col("width") - 1
    size = F.least(F.floor(100 * F.col("n") / percent), F.col("nb") + most)
    t = F.greatest(F.lit(1), F.ceil((up * (F.col("d") + least) - down * (F.col("n") + size)) / (2 * up)))
    fits = levels.withColumn("t", t).where((F.col("t") <= F.col("d")) & (F.col("t") <= most))
    taken = F.slice("rare", F.lit(1), F.greatest(F.lit(0), F.col("d") - F.col("t") + 1 - F.col("before")).cast("int"))
    each = fits.select("b", "a", "n", "d", *PARITY, "before", "level", "other", F.posexplode(taken).alias("at", "e"))
    return each.select("b", F.xxhash64("e", F.least("level", "other"), F.greatest("level", "other")).alias("key"), "a", "n", "d", *PARITY, (F.col("before") + F.col("at")).alias("pos"))


def near_duplicates(docs: DataFrame, n: int = 3, percent: int = 85, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``."""
    spark = docs.sparkSession
    prepare(spark)
    scratch = Scratch(spark, "near")
    all_ = scratch.save(sketches(docs, n, bands, rows), "sketches")
    members = all_.where("n > 0 and doc_id is not null").select("doc_id", "seq", "n", "bands")
    sequence, several = word_sequences(scratch, members)
    keys = members.withColumnRenamed("doc_id", "rep").join(sequence, ["seq", "rep"]).dropDuplicates(["seq"]).select("seq", "rep", "node", "n", "bands")
    reps = scratch.save(keys, "representatives")
    banded = reps.select("node", F.explode("bands").alias("key"))
    hubs = scratch.save(banded.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub < last").select("key", "hub"), "hubs-0")
    pairs = scratch.save(banded.join(hubs, "key").where("node != hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct(), "pairs-0")

    met = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    met = scratch.save(reps.join(met, "node").select("seq", "rep", "node"), "met")  # a saved table's size is known before a join
    need = texts(docs).join(met.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    sets = full_sets(need, n).join(met.select("seq", "node"), "seq").dropDuplicates(["node"])
    sets = scratch.save(sets.select("node", "n", "elements"), "sets")
    scratch.drop("representatives", "hubs-0", "met")

    # a doc_id with several texts links their sequences
    texts_of_one = members.select("doc_id", "seq").join(several.select("doc_id"), "doc_id").join(sequence, "seq").select("doc_id", "node").distinct()
    links = scratch.save(texts_of_one.groupBy("doc_id").agg(F.min("node").alias("b")).join(texts_of_one, "doc_id").where("node != b").select(F.col("node").alias("a"), "b").distinct(), "links-0")
    links = links.unionByName(scratch.save(verified(pairs, sets, percent).where("linked").select("a", "b"), "found-0"))
    class_of = components(scratch, links, "classes-0")
    classed = lambda df, node: df.join(class_of.select(F.col("id").alias(node), "c"), node, "left").withColumn("c", F.coalesce("c", node))
    # members that a hub left in several classes are put under one center, a hub of the largest of these classes
    weight = class_of.groupBy("c").agg(F.count(F.lit(1)).alias("w"))
    in_bucket = pairs.select("b", F.col("a").alias("node")).unionByName(pairs.select("b", F.col("b").alias("node")).distinct())
    of_hub = scratch.save(classed(in_bucket, "node").join(weight, "c", "left").withColumn("w", F.coalesce("w", F.lit(1))), "classed")
    member = F.when(F.col("node") != F.col("b"), F.col("c"))
    buckets = of_hub.groupBy("b").agg(F.min(member).alias("lo"), F.max(member).alias("hi"), F.max(F.struct("w", (-F.col("c")).alias("less"))).alias("best"), F.count(F.lit(1)).alias("size"))
    hub_class = of_hub.where("node = b").select("b", F.col("c").alias("own"))
    buckets = scratch.save(buckets.join(hub_class, "b").select("b", "own", "size", (-F.col("best.less")).alias("c"), (F.col("lo") < F.col("hi")).alias("open")), "open")
    center = buckets.groupBy(F.col("own").alias("c")).agg(F.min(F.struct(-F.col("size"), "b")).alias("first")).select("c", F.col("first.b").alias("center"))
    other = of_hub.groupBy("c").agg(F.min("node").alias("other"))  # a class without a hub
    placed = buckets.where("open").select("b", "c").join(center, "c", "left").join(other, "c").select("b", F.coalesce("center", "other").alias("center"))
    under = scratch.save(of_hub.join(placed, "b").where("node != center").select(F.col("node").alias("a"), F.col("center").alias("b")).distinct(), "pairs-under")
    difference = F.concat(F.array_except("sa", "sb"), F.array_except("sb", "sa"))
    compared = verified(under, sets, percent).select("a", "b", F.col("na").alias("n"), "nb", "linked", (F.col("na") + F.col("nb") - 2 * F.col("common")).alias("d"), difference.alias("x"))
    compared = scratch.save(compared, "found-under")
    links = links.unionByName(compared.where("linked").select("a", "b"))
    class_of = components(scratch, links, "classes-1")
    rare = differences(scratch, compared)
    live = difference_keys(rare, percent)
    scratch.drop("classed", "open", "pairs-0", "pairs-under", "sets")
    slots, k = 16, 0
    while True:
        k += 1
        state = scratch.save(classed(live, "a"), f"state-{k}")
        open_keys = state.groupBy("b", "key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("b", "key")
        live = scratch.save(state.join(open_keys, ["b", "key"]), f"keys-{k}")
        scratch.drop(f"state-{k}", f"keys-{k - 1}")
        if live.isEmpty():
            break
        # some members of each key are its hubs of this round, and leave it: a bucket that the links close early lists few pairs
        slot = F.pmod(F.xxhash64("a", F.lit(k)), F.lit(slots))
        kept = ["a", "n", "d", *PARITY, "pos", "c"]
        hubs = scratch.save(live.groupBy("b", "key", slot.alias("slot")).agg(F.min(F.struct(*kept)).alias("h")).select("b", "key", *(F.col("h." + x).alias("h" + x) for x in kept)), f"hubs-{k}")
        up, down = 100 + percent, 100 - percent
        most = F.least(F.col("d") - F.col("pos"), F.col("hd") - F.col("hpos"))  # elements in common, from the shared one on
        apart = sum((F.bit_count(F.col(x).bitwiseXOR(F.col("h" + x))) for x in PARITY), F.lit(0))  # elements that only one of them has, at least
        near = (up * apart <= down * (F.col("n") + F.col("hn"))) & (F.col("c") != F.col("hc")) & (100 * F.least("n", "hn") >= percent * F.greatest("n", "hn")) & (2 * up * most >= up * (F.col("d") + F.col("hd")) - down * (F.col("n") + F.col("hn")))
        found = live.join(hubs, ["b", "key"]).where(near).select(F.greatest("a", "ha").alias("a"), F.least("a", "ha").alias("o"), "b").groupBy("a", "o").agg(F.min("b").alias("b"))
        of = lambda x: rare.select(F.col("a").alias(x), "b", F.col("n").alias("n" + x), F.col("d").alias("d" + x), F.col("rare").alias("r" + x))
        both = found.join(of("a"), ["a", "b"]).join(of("o"), ["o", "b"])
        linked = 2 * up * F.size(F.array_intersect("ra", "ro")) >= up * (F.col("da") + F.col("do")) - down * (F.col("na") + F.col("no"))
        new = scratch.save(both.where(linked).select("a", F.col("o").alias("b")), f"found-{k}")
        if not new.isEmpty():
            links = links.unionByName(new)
            class_of = components(scratch, links, f"classes-{k + 1}")
        live = live.join(hubs.select("b", "key", F.col("ha").alias("a")), ["b", "key", "a"], "left_anti").drop("c")
        slots *= 32
    scratch.drop("differences", f"keys-{k}", f"state-{k}", *(f"hubs-{i}" for i in range(1, k)))
    of_sequence = sequence.join(class_of.select(F.col("id").alias("node"), "c"), "node", "left").withColumn("c", F.coalesce("c", "node"))
    lowest = of_sequence.join(class_of.select("c").distinct(), "c", "left_semi").groupBy("c").agg(F.min("rep").alias("lowest"))
    by_sequence = scratch.save(of_sequence.join(lowest, "c", "left").select("seq", F.coalesce("lowest", "rep").alias("component_id")), "classes")
    linked = all_.where("n > 0 and doc_id is not null").join(by_sequence, "seq").select("doc_id", "n", "component_id")
    alone = all_.where("not (n > 0 and doc_id is not null)").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, with all columns, of one document of each class; rows without a doc_id stay."""
    own = unused(docs, "kept_id")
    kept = near_duplicates(docs, **options).where("kept and doc_id is not null").select(F.col("doc_id").alias(own)).distinct()
    return docs.where("doc_id is null").unionByName(docs.join(kept, F.col("doc_id").cast("long") == F.col(own), "left_semi"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP2_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM d),
n AS (SELECT doc_id, len(s) AS n_shingles FROM s),
e AS (SELECT doc_id, hash(unnest(s)) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n_shingles + nb.n_shingles - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1) USING (doc_id)
"""
