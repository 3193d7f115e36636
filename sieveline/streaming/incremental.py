"""What the pipeline can resume: vectors that are still valid, outputs that exist. There are no unbounded sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cache_status(current: DataFrame, cached: DataFrame, key: str = "doc_id") -> DataFrame:
    """status of each document: hit, stale (another content hash or number of chunks) or miss."""
    old = cached.select(key, F.col("content_hash").alias("old_hash"), F.col("chunks").alias("old_chunks"))
    both = current.join(old, key, "left")
    status = F.when(F.col("old_hash").isNull(), "miss").when((F.col("old_hash") == F.col("content_hash")) & (F.col("old_chunks") == F.col("chunks")), "hit").otherwise("stale")
    return both.select(key, status.alias("status"))


def unfinished(items: DataFrame, done: DataFrame, key: str, limit: int | None = None) -> DataFrame:
    """Items without an output; a limit counts these only."""
    rest = items.join(done.select(key).distinct(), key, "left_anti")
    return rest.orderBy(key).limit(limit) if limit else rest
