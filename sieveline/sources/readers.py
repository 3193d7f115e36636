"""Readers of the formats that retrieval projects keep, with explicit schemas and checked columns."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normal_id, stem

QA = "status string, master_id bigint, company string, year int, report_paths string, question string"
SUMMARY = "pdf_path string, company_year_key string, qa_count int, qa_count_cumulative int"
MASTER = "master_id bigint, type string, answers array<string>, prompt map<string,string>"
CHUNK = "chunk_id string, parent_id string, child_ids array<string>, content string, text string, page_number int, metadata struct<page_numbers:array<int>,section_path:array<string>,section_level:int,char_count:int,pdf:string,pdf_stem:string>"


def _typed(fields: str) -> str:
    """name type, ... to name:type, ... at the top level."""
    depth, out, start = 0, [], 0
    for i, c in enumerate(fields + ","):
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append(":".join(fields[start:i].strip().split(" ", 1)))
            start = i + 1
    return ",".join(out)


CHUNK_FILE = f"source string, overview struct<counts:struct<page_count:int>>, parents array<struct<{_typed(CHUNK)}>>, children array<struct<{_typed(CHUNK)}>>, chunks array<struct<{_typed(CHUNK)}>>"


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def csv(spark: SparkSession, path: str, schema: str, escape: str = "\\") -> DataFrame:
    """The header decides which columns there are; required ones that it lacks are an error naming them."""
    head = spark.read.csv(path, header=True, escape=escape)
    names = [f.split(" ")[0] for f in schema.split(", ")]
    require(head, [n for n in names if n != "qa_count_cumulative"])
    types = dict(f.split(" ") for f in schema.split(", "))
    return head.select(*(F.col(n).try_cast(types[n]).alias(n) if n in head.columns else F.lit(None).cast(types[n]).alias(n) for n in names))


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One record a line; blank lines are skipped, broken ones raise."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def chunk_files(spark: SparkSession, path: str) -> DataFrame:
    """One row a chunk of all *_chunks.json files: file_stem, kind (parent or child), pos, canonical chunk columns.

    Files without children use their chunks, or give none; texts are content, else text; pages fall back to the page number.
    """
    files = spark.read.schema(CHUNK_FILE).json(path, multiLine=True, pathGlobFilter="*_chunks.json").withColumn("file", F.input_file_name())
    kinds = {"parent": F.col("parents"), "child": F.coalesce("children", "chunks")}
    out = None
    for kind, items in kinds.items():
        rows = files.select(F.regexp_replace(stem(F.col("file")), "_chunks$", "").alias("file_stem"), "source", F.col("overview.counts.page_count").alias("page_count"), F.posexplode(items).alias("pos", "c"))
        rows = rows.select(
            "file_stem", "source", "page_count", F.lit(kind).alias("kind"), "pos", "c.chunk_id", "c.parent_id", F.coalesce(F.nullif("c.content", F.lit("")), "c.text", F.lit("")).alias("text"),
            F.coalesce(F.when(F.size("c.metadata.page_numbers") > 0, F.col("c.metadata.page_numbers")), F.when(F.col("c.page_number").isNotNull(), F.array("c.page_number")), F.array().cast("array<int>")).alias("pages"),
            F.coalesce("c.metadata.section_path", F.array().cast("array<string>")).alias("section_path"),
            F.coalesce(F.nullif("c.metadata.char_count", F.lit(0)), F.length(F.coalesce("c.content", F.lit("")))).alias("length"),
            F.coalesce(F.nullif("c.metadata.pdf_stem", F.lit("")), F.col("file_stem")).alias("pdf_stem"),
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def votes_csv(spark: SparkSession, path: str, template: DataFrame | None = None) -> DataFrame:
    """query_id, chunk_id, label, notes. Digit-only ids of less than eight signs are padded; with a template (query_id, chunk_id), only
    where the query has the padded id there. Rows without a query or chunk are skipped."""
    rows = require(spark.read.csv(path, header=True, multiLine=True), ["query_id", "chunk_id", "label"])
    rows = rows.withColumn("chunk_id", F.trim("chunk_id")).where("coalesce(query_id, '') != '' and coalesce(chunk_id, '') != ''")
    padded = F.when(F.col("chunk_id").rlike(r"^\d{1,7}$"), F.lpad("chunk_id", 8, "0"))
    if template is None:
        return rows.withColumn("chunk_id", F.coalesce(padded, "chunk_id"))
    known = template.select(F.trim(F.col("query_id").cast("string")).alias("q0"), F.col("chunk_id").alias("p")).distinct()
    joined = rows.withColumn("p0", padded).join(known, (F.col("p0") == F.col("p")) & (F.trim(F.col("query_id").cast("string")) == F.col("q0")), "left")
    return joined.withColumn("chunk_id", F.coalesce("p", "chunk_id")).drop("p", "p0", "q0")


def id_list(spark: SparkSession, path: str) -> DataFrame:
    """query_id (normalised string) of a JSON list file with query_ids."""
    raw = spark.read.schema("query_ids array<string>").json(path, multiLine=True)
    return raw.select(F.explode("query_ids").alias("q")).select(normal_id(F.col("q")).alias("query_id")).where("query_id is not null").distinct()


def id_list_meta(spark: SparkSession, path: str) -> DataFrame:
    """count (of the ids if it isn't given), source (unknown if it isn't), updated_at of an id list."""
    raw = spark.read.schema("query_ids array<string>, count bigint, source string, updated_at string").json(path, multiLine=True)
    return raw.select(F.coalesce("count", F.size("query_ids").cast("long")).alias("count"), F.coalesce("source", F.lit("unknown")).alias("source"), "updated_at")


def template_ids(spark: SparkSession, path: str) -> DataFrame:
    """The distinct query ids of a gold template or of retrieval records."""
    return spark.read.schema("query_id string").json(path).select(normal_id(F.col("query_id")).alias("query_id")).where("query_id is not null").distinct()


def vectors(spark: SparkSession, path: str, model_tag: str, stems: DataFrame | None = None) -> DataFrame:
    """The cached vectors of one model: only its partition is read, and only the documents in ``stems``."""
    own = spark.read.parquet(path).where(F.col("model_tag") == model_tag)
    return own.join(stems.select("pdf_stem").distinct(), "pdf_stem", "left_semi") if stems is not None else own


def config(spark: SparkSession, path: str) -> dict:
    """A JSON or YAML configuration file; a missing one is empty. YAML asks for the yaml package."""
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not files.getFileSystem(spark._jsc.hadoopConfiguration()).exists(files):
        return {}
    text = spark.read.text(path, wholetext=True).first().value
    try:
        return json.loads(text) or {}
    except ValueError:
        import yaml

        return yaml.safe_load(text) or {}


def exclude_list(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """pdf_stem of a JSON object's problematic items or of a JSON list, else of the file's lines.

    strict: JSON objects only, anything else is an empty list. Read on the driver: such a list names documents to leave out.
    """
    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    try:
        data = json.loads(text)
    except ValueError:
        data = None
    items = data.get("problematic", []) if isinstance(data, dict) else data if isinstance(data, list) and not strict else []
    stems = [str(x.get("pdf_stem") or "") if isinstance(x, dict) else str(x) for x in items]
    stems = [s for s in stems if s]
    if not stems and not strict:
        stems = [s.strip() for s in text.splitlines() if s.strip()]
    return spark.createDataFrame([(s,) for s in dict.fromkeys(stems)], "pdf_stem string")
