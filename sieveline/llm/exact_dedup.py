"""Exact deduplication by a persistent digest index; DataFrame operations only.

``DigestIndex`` is a Parquet table bucketed and sorted by SHA-256 digest. A batch of rows is first reduced to one row per
digest (map-side, so a digest that holds a third of all rows moves as one row per task), then a sort-merge anti-join
against the index keeps the digests that are new, and these are appended. The index side of that join is read bucket by
bucket without a shuffle; with as many buckets as shuffle partitions the batch is shuffled once, by its grouping. Adding a batch
again changes nothing, so a load that stopped is simply repeated.

``load`` takes a table in batches of falling doc_ids, so that of equal texts the row with the largest doc_id stays; a digest
that an earlier batch brought stays with that batch's row. A null text is an empty text, and empty texts are equal to each other.
Rows that repeat a doc_id with one text all name it as keep_id. A null doc_id never stays unless its text has no other doc_id
(then keep_id is null). Columns other than doc_id and text are left behind.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, texts, unused


def digests(docs: DataFrame) -> DataFrame:
    """doc_id and the binary SHA-256 of each whole text in UTF-8."""
    return texts(docs).select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest"))


class DigestIndex:
    """digest -> keep_id, under a table's own path."""

    def __init__(self, spark: SparkSession, name: str, path: str, buckets: int | None = None):
        self.spark, self.name, self.path = spark, name, path
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        if not spark.catalog.tableExists(name):
            self._append(spark.sql("SELECT CAST(NULL AS BINARY) AS digest, CAST(NULL AS BIGINT) AS keep_id").where("false"))

    def _append(self, rows: DataFrame) -> None:
        (
            rows.repartition(self.buckets, "digest")  # one file for each bucket
            .write.format("parquet").mode("append").bucketBy(self.buckets, "digest").sortBy("digest").option("path", self.path).saveAsTable(self.name)
        )

    def lacking(self, docs: DataFrame) -> DataFrame:
        """digest and keep_id of the digests of ``docs`` that the index lacks."""
        batch = digests(docs).groupBy("digest").agg(F.max("doc_id").alias("keep_id"))
        return batch.join(self.spark.table(self.name).select("digest").hint("merge"), "digest", "left_anti")

    def add(self, docs: DataFrame) -> None:
        self._append(self.lacking(docs))  # the plan reads the files that were there before

    def load(self, docs: DataFrame, batches: int = 2) -> None:
        """Adds ``docs`` in batches of doc_id ranges of one width, the largest first and null ids last."""
        ends = docs.agg(F.min(F.col("doc_id").cast("long")), F.max(F.col("doc_id").cast("long"))).first()
        low, high = (0, 0) if ends[0] is None else ends
        cuts = [low + (high - low) * k // batches for k in range(1, batches)]
        doc, above = F.col("doc_id").cast("long"), None
        for cut in [*cuts[::-1], None]:
            inside = F.lit(True) if cut is None else doc > cut
            if above is not None:
                inside = inside & (doc <= above)
            self.add(docs.where(inside | doc.isNull() if cut is None else inside))
            above = cut

    def entries(self) -> DataFrame:
        """The index's rows by path: free of bucketing, so a join on a very frequent digest can be split at run time."""
        return self.spark.read.schema("digest binary, keep_id long").parquet(self.path)

    def forget(self) -> None:
        """Takes the table out of the catalog; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def remove(self) -> None:
        self.forget()
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)


def _own_index(docs: DataFrame) -> DigestIndex:
    """An index of this run alone, loaded with ``docs``. What is returned reads its files, so they stay in the shared folder."""
    index = DigestIndex(docs.sparkSession, f"sieveline_digests_{uuid.uuid4().hex}", Scratch(docs.sparkSession, "index").path("digests"))
    index.load(docs)
    index.forget()
    return index


def mark_duplicates(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs``, dropped ones too.

    With an index of an earlier load, ``docs`` are added as one batch. group_size counts rows of ``docs``.
    """
    if index is None:
        index = _own_index(docs)
    else:
        index.add(docs)
    sizes = digests(docs).groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"))
    joined = digests(docs).join(sizes.join(index.entries(), "digest"), "digest")
    return joined.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all columns, whose text has no equal with a larger doc_id.

    Repeated rows (same doc_id and text) stay together; rows without a doc_id stay only if no other row has their text.
    """
    d, k, own = (unused(docs, x) for x in ("kept_digest", "kept_id", "own_digest"))
    keep = _own_index(docs).entries().select(F.col("digest").alias(d), F.col("keep_id").alias(k))
    with_digest = docs.withColumn(own, F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)))
    return with_digest.join(keep, (F.col(own) == F.col(d)) & F.col("doc_id").cast("long").eqNullSafe(F.col(k)), "left_semi").drop(own)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP8_SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""
