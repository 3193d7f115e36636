"""Ranking metrics, their comparison between groups, and the loss and acceptance of a reranker's training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import having


def gain(label: Column) -> Column:
    return F.when(label == "evidence", 2).when(label == "related", 1).otherwise(0)


def judged(hits: DataFrame, gold: DataFrame, k: int = 10) -> DataFrame:
    """The top k hits of queries in the gold set with their labels; hits without a label are irrelevant and marked."""
    own = hits.where(F.col("rank") <= k).join(gold.select("query_id").distinct(), "query_id", "left_semi")
    both = own.join(gold.select("query_id", "doc_id", "label"), ["query_id", "doc_id"], "left")
    return both.withColumns({"unjudged": F.col("label").isNull(), "label": F.coalesce("label", F.lit("irrelevant"))})


def query_metrics(hits: DataFrame, gold: DataFrame, k: int = 10, group: str = "route") -> DataFrame:
    """mrr, ndcg, precision, unjudged, n for each group and query. NDCG's ideal orders the retrieved top k only."""
    j = judged(hits, gold, k).withColumn("gain", gain(F.col("label")))
    ideal = F.row_number().over(Window.partitionBy(group, "query_id").orderBy(F.desc("gain"), F.asc("rank")))
    per = j.withColumn("ideal", ideal).groupBy(group, "query_id").agg(
        F.min(F.when(F.col("label") == "evidence", F.col("rank"))).alias("first"), F.sum(F.col("gain") / F.log2(F.col("rank") + 1)).alias("dcg"), F.sum(F.col("gain") / F.log2(F.col("ideal") + 1)).alias("best"),
        F.count_if(F.col("label") == "evidence").alias("e"), F.count_if("unjudged").alias("unjudged"), F.count(F.lit(1)).alias("n"),
    )
    ndcg = F.when(F.col("best") > 0, F.col("dcg") / F.col("best")).otherwise(0.0)
    return per.select(group, "query_id", F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr"), F.round(ndcg, 6).alias("ndcg"), F.round(F.col("e") / k, 6).alias("precision"), "unjudged", "n")


def group_metrics(per_query: DataFrame, group: str = "route") -> DataFrame:
    """Means over queries that have results."""
    return per_query.groupBy(group).agg(
        F.round(F.avg("mrr"), 6).alias("mrr"), F.round(F.avg("ndcg"), 6).alias("ndcg"), F.round(F.avg("precision"), 6).alias("precision"), F.round(F.sum("unjudged") / F.sum("n"), 6).alias("unjudged_rate"), F.count(F.lit(1)).alias("queries"),
    )


def group_deltas(groups: DataFrame, new: str, old: str, group: str = "route") -> DataFrame:
    a, b = (groups.where(F.col(group) == g).select(*(F.col(m).alias(f"{m}_{k}") for m in ("mrr", "ndcg", "precision"))) for k, g in (("a", new), ("b", old)))
    return a.join(b, F.lit(True)).select(*(F.round(F.col(f"{m}_a") - F.col(f"{m}_b"), 6).alias(f"delta_{m}") for m in ("mrr", "ndcg", "precision")))


def degraded(per_query: DataFrame, new: str, old: str, n: int = 10, group: str = "route") -> DataFrame:
    """The n queries whose NDCG falls most; a query without results in a group has 0 there."""
    of = lambda g, name: per_query.where(F.col(group) == g).select("query_id", F.col("ndcg").alias(name))
    both = of(new, "ndcg_new").join(of(old, "ndcg_old"), "query_id", "full").na.fill(0.0, ["ndcg_new", "ndcg_old"])
    return both.withColumn("delta", F.round(F.col("ndcg_new") - F.col("ndcg_old"), 6)).orderBy("delta", "query_id").limit(n)


def compared(ids: DataFrame, per_query: DataFrame, groups: list[str], group: str = "route") -> DataFrame:
    """One row for each gold query with mrr, ndcg and precision of each group; null where a group has no results for it."""
    some = per_query.where(F.col(group).isin(groups)).select("query_id", group, "mrr", "ndcg", "precision")
    wide = some.groupBy("query_id").pivot(group, groups).agg(*(F.first(m).alias(m) for m in ("mrr", "ndcg", "precision")))
    return ids.select("query_id").distinct().join(wide, "query_id", "left")


def top_hit(hits: DataFrame, group: str = "route") -> DataFrame:
    """The first hit of each group and query."""
    return hits.groupBy(group, "query_id").agg(F.min_by("doc_id", F.struct("rank", "doc_id")).alias("top1"))


def candidate_texts(candidates: DataFrame, gold: DataFrame, chunks: DataFrame) -> DataFrame:
    """Candidates (query_id, doc_id, ...) with text: the gold set's, or if that is empty the chunk's, or empty."""
    g = gold.groupBy("query_id", "doc_id").agg(F.max("text").alias("gold_text"))
    c = having(chunks.select("doc_id", F.col("text").alias("chunk_text")), candidates)
    both = candidates.join(g, ["query_id", "doc_id"], "left").join(c, "doc_id", "left")
    return both.withColumn("text", F.coalesce(F.nullif("gold_text", F.lit("")), "chunk_text", F.lit(""))).drop("gold_text", "chunk_text")


def missing_text(candidates: DataFrame) -> DataFrame:
    """missing_text_count, total_candidates, missing_text_rate of candidates with texts."""
    n = candidates.agg(F.count_if(F.coalesce("text", F.lit("")) == "").alias("missing_text_count"), F.count(F.lit(1)).alias("total_candidates"))
    return n.withColumn("missing_text_rate", F.round(F.coalesce(F.try_divide("missing_text_count", "total_candidates"), F.lit(0.0)), 6))


def score_percentiles(scores: DataFrame, percents: tuple[int, ...] = (10, 25, 50, 75, 90, 95, 99)) -> DataFrame:
    """min, max and p* of the column score, exact, by linear interpolation."""
    s = scores.agg(F.min("score").alias("min"), F.max("score").alias("max"), F.percentile("score", [p / 100 for p in percents]).alias("p"))
    return s.select(F.round("min", 6).alias("min"), F.round("max", 6).alias("max"), *(F.round(F.col("p")[i], 6).alias(f"p{p}") for i, p in enumerate(percents)))


def score_histogram(scores: DataFrame) -> DataFrame:
    """bin, n: ten bins from 0 to 1, the last one closed; scores outside are left out."""
    inside = scores.where("score between 0 and 1")
    return inside.groupBy(F.least(F.floor(F.col("score") * 10), F.lit(9)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def rerank(hits: DataFrame, scores: DataFrame) -> DataFrame:
    """Hits by another score (query_id, doc_id, rerank_score); on ties the earlier rank comes first."""
    w = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), F.asc("rank"), F.asc("doc_id"))
    return hits.join(scores, ["query_id", "doc_id"]).withColumn("rerank_rank", F.row_number().over(w).cast("int"))


def listwise_loss(scored: DataFrame, positive: Column) -> DataFrame:
    """groups and mean loss; a group's loss is minus the log-softmax of its positive's score. Groups have one positive."""
    w = Window.partitionBy("query_id")
    top = scored.withColumn("m", F.max("score").over(w))
    per = top.groupBy("query_id").agg(F.first("m").alias("m"), F.sum(F.exp(F.col("score") - F.col("m"))).alias("z"), F.max(F.when(positive, F.col("score"))).alias("s"))
    return per.where("s is not null").agg(F.count(F.lit(1)).alias("groups"), F.round(F.avg(F.log("z") + F.col("m") - F.col("s")), 6).alias("loss"))


def loss_drop(initial: Column, final: Column, least: float = 20.0) -> Column:
    return (initial - final) / initial * 100 >= least


def report(groups: list, deltas: list) -> str:
    """Markdown of collected group rows and deltas, four decimals."""
    head = "| group | MRR@10 | NDCG@10 | P@10 | unjudged |\n|---|---|---|---|---|\n"
    body = "".join(f"| {r[0]} | {r.mrr:.4f} | {r.ndcg:.4f} | {r.precision:.4f} | {r.unjudged_rate:.4f} |\n" for r in groups)
    return head + body + "".join(f"\n{name}: MRR {d.delta_mrr:+.4f}, NDCG {d.delta_ndcg:+.4f}, P {d.delta_precision:+.4f}\n" for name, d in deltas)
