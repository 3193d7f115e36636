"""Rankings with a total order, so that ties have one result, and functions of ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(hits: DataFrame, key: str | list[str], order: list[Column], name: str = "rank") -> DataFrame:
    return hits.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("int"))


def top_k(hits: DataFrame, key: str | list[str], k: int, by: str = "score", tie: str = "doc_id") -> DataFrame:
    """The k best of each key; Spark cuts each partition to k before the shuffle (WindowGroupLimit)."""
    return ranked(hits, key, [F.desc(by), F.asc(tie)]).where(F.col("rank") <= k)


def last_wins(rows: DataFrame, key: str | list[str], order: str) -> DataFrame:
    cols = [key] if isinstance(key, str) else key
    rest = [c for c in rows.columns if c not in cols]
    best = rows.groupBy(*cols).agg(F.max_by(F.struct(*rest), F.col(order)).alias("r"))
    return best.select(*cols, "r.*")


def fill_rank(rank: Column, position: Column) -> Column:
    return F.coalesce(rank.cast("string").try_cast("int"), position)


def candidate_order(hits: DataFrame, key: str) -> DataFrame:
    """By the reranker's rank if it is there and not 0, else by rank, else last; then by falling score."""
    r = F.coalesce(F.nullif("rerank_rank", F.lit(0)), F.nullif("rank", F.lit(0)), F.lit(10**9))
    return ranked(hits, key, [r, F.desc("score"), F.asc("doc_id")], "position")


def greedy_prefix(rows: DataFrame, order: list[Column], size: str, target: int, cap: int) -> DataFrame:
    """Rows in order while fewer than ``cap`` are taken and the taken sizes stay below ``target``; the crossing row is kept.

    A running sum over a whole table: meant for per-document summaries, not for documents.
    """
    w = Window.orderBy(*order)
    before = F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumns({"position": F.row_number().over(w), "before": before}).where((F.col("position") <= cap) & (F.col("before") < target)).drop("before")
