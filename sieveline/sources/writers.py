"""Writers: JSON lines, nested and flat hits, id lists, cached vectors, one-row statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.gold import upserted
from ..operators.retrieval import nested


def jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def nested_hits(queries: DataFrame, hits: DataFrame, path: str) -> None:
    """One line a query; empty hits are kept."""
    jsonl(nested(queries, hits), path)


def flat_hits(queries: DataFrame, hits: DataFrame, path: str, answers: bool = False) -> None:
    """One line a hit; the chunk's pdf is source_pdf, queries without hits are left out."""
    chunk = hits.withColumnRenamed("pdf", "source_pdf") if "pdf" in hits.columns else hits
    jsonl((queries if answers else queries.drop("answers")).join(chunk, "query_id"), path)


def no_hits(queries: DataFrame, hits: DataFrame, path: str) -> None:
    jsonl(queries.join(hits.select("query_id"), "query_id", "left_anti"), path)


def vectors(df: DataFrame, path: str) -> None:
    """Parquet by model_tag, then bucket files by document; later reads prune by model."""
    df.repartition("model_tag", "pdf_stem").sortWithinPartitions("pdf_stem").write.mode("append").partitionBy("model_tag").parquet(path)


def id_list(ids: DataFrame, path: str, source: str) -> None:
    """Sorted distinct ids with count, source and time, as one JSON record."""
    row = ids.select("query_id").distinct().agg(F.sort_array(F.collect_set("query_id")).alias("query_ids"))
    jsonl(row.select("query_ids", F.size("query_ids").alias("count"), F.lit(source).alias("source"), F.current_timestamp().alias("updated_at")).coalesce(1), path)


def stats(row: DataFrame, params: dict[str, str], path: str) -> None:
    """One record of statistics and the parameters that they belong to."""
    given = F.map_from_arrays(F.array(*map(F.lit, params)), F.array(*map(F.lit, params.values()))) if params else F.create_map().cast("map<string,string>")
    jsonl(row.withColumn("params", given).withColumn("at", F.current_timestamp()).coalesce(1), path)


def problem_documents(problems: DataFrame, thresholds: dict[str, float], stage: str, path: str) -> None:
    """One record: stage, thresholds, and the problematic documents (pdf_stem, reasons); a list of documents to leave out."""
    given = F.struct(*(F.lit(float(v)).alias(k) for k, v in thresholds.items()))
    row = problems.agg(F.sort_array(F.collect_list(F.struct("pdf_stem", "reasons"))).alias("problematic"))
    jsonl(row.select(F.lit(stage).alias("stage"), given.alias("thresholds"), "problematic").coalesce(1), path)


def dropped_list(existing: DataFrame, new: DataFrame, path: str) -> None:
    """The dropped ids with new ones; without new ones nothing is written."""
    if not new.isEmpty():
        id_list(upserted(existing, new), path, "gold_eval_no_positive")
