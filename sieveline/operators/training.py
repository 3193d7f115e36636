"""From triplets to training groups: filters, leakage-safe splits by query, and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(*parts: Column | str) -> Column:
    """A portable pseudo-random order."""
    return F.md5(F.concat_ws(":", *(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts)).cast("binary"))


def filter_reasons(triplets: DataFrame, blacklist: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Adds reason: the first filter that drops a triplet, or kept."""
    black = blacklist.select("query_id").distinct().withColumn("black", F.lit(True))
    confidence = F.coalesce(F.col("confidence").cast("string").try_cast("double"), F.lit(0.0))
    reason = F.when(F.col("query_id").isNull(), "null_id").when(F.col("black"), "blacklist").when(confidence < threshold, "confidence").otherwise("kept")
    return triplets.join(black, "query_id", "left").withColumn("reason", reason).drop("black")


def clean(triplets: DataFrame) -> DataFrame:
    """Drops blank queries and positives; strips negatives and drops blank ones."""
    negs = F.filter(F.transform("neg_texts", F.trim), lambda x: x != "")
    return triplets.where((F.trim("query") != "") & (F.trim("pos_text") != "")).withColumn("neg_texts", negs)


def group_split(triplets: DataFrame, ratio: float = 0.9, seed: str = "42") -> DataFrame:
    """Adds split; all triplets of a query are in one. The first int(n * ratio) queries in hash order train.

    A query's place is its place among those with the same first three digits of the hash, plus the number of queries before these:
    4,096 windows of distinct query ids, and one over their counts.
    """
    if not 0 < ratio < 1:
        raise ValueError("ratio must lie between 0 and 1")
    ids = triplets.select("query_id").distinct().withColumn("h", hash_order(F.col("query_id"), seed)).withColumn("digits", F.substring("h", 1, 3))
    counts = ids.groupBy("digits").agg(F.count(F.lit(1)).alias("c"))
    before = F.sum("c").over(Window.orderBy("digits")) - F.col("c")
    places = counts.select("digits", before.alias("before"), F.floor(F.sum("c").over(Window.partitionBy()) * F.lit(ratio)).alias("n"))
    place = F.col("before") + F.row_number().over(Window.partitionBy("digits").orderBy("h", "query_id"))
    split = ids.join(places, "digits").withColumn("split", F.when(place <= F.col("n"), "train").otherwise("dev"))
    return triplets.join(split.select("query_id", "split"), "query_id")


def negatives_profile(counts: DataFrame, column: str = "n_neg") -> DataFrame:
    """min, max, mean, median, and the values at floor positions int(p * (n - 1)) for 75 and 95 per cent.

    The values' histogram is sorted, not the values, so what meets in a task are distinct counts.
    """
    h = counts.groupBy(column).agg(F.count(F.lit(1)).alias("c"))
    w = Window.orderBy(column)
    h = h.withColumn("upto", F.sum("c").over(w)).withColumn("total", F.sum("c").over(Window.partitionBy()))
    at = lambda pos: F.min(F.when(F.col("upto") > pos, F.col(column)))
    place = lambda p: F.floor(F.lit(p) * (F.col("total") - 1))
    mid = lambda off: F.floor((F.col("total") - 1 + off) / 2)
    return h.agg(
        F.min(column).alias("min"), F.max(column).alias("max"), F.round(F.sum(F.col(column) * F.col("c")) / F.sum("c"), 6).alias("avg"),
        ((at(mid(0)) + at(mid(1))) / 2).alias("median"), at(place(0.75)).alias("p75"), at(place(0.95)).alias("p95"),
    )


def groups(triplets: DataFrame, max_neg: int) -> DataFrame:
    """query_id, group item position (0 is the positive), doc_id."""
    items = F.concat(F.array("pos_id"), F.slice("neg_ids", 1, max_neg))
    return triplets.select("query_id", "pos_id", F.posexplode(items).alias("position", "doc_id"))
