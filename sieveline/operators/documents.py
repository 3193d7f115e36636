"""Documents: selection, quality profiles of their chunks, parents and children, content hashes, catalogs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import stem
from .ranking import greedy_prefix, last_wins


def prepare_queries(rows: DataFrame, least: int = 3) -> DataFrame:
    """query_id (castable ids only), query (stripped, at least ``least`` signs), answers with ids."""
    q = rows.withColumn("query_id", F.col("master_id").cast("string").try_cast("bigint")).withColumn("query", F.trim("question"))
    q = q.where(F.col("query_id").isNotNull() & (F.length("query") >= least))
    return q.withColumn("answers", F.transform(F.coalesce("answers", F.array().cast("array<string>")), lambda x, i: F.struct(F.concat_ws("_", F.col("query_id").cast("string"), i.cast("string")).alias("answer_id"), x.alias("text"))))


def not_blacklisted(path: Column, keys: list[str]) -> Column:
    """A section path (array) that has none of the keys as a part of its joined form."""
    return ~F.exists(F.array(*map(F.lit, keys)), lambda k: F.contains(F.array_join(path, "/"), k)) if keys else F.lit(True)


def page_gaps(pages: DataFrame) -> DataFrame:
    """doc_id, gap_start, gap_end between the distinct pages of a document."""
    p = pages.select("doc_id", "page").where("page is not null").distinct().withColumn("prev", F.lag("page").over(Window.partitionBy("doc_id").orderBy("page")))
    return p.where("page - prev > 1").select("doc_id", (F.col("prev") + 1).alias("gap_start"), (F.col("page") - 1).alias("gap_end"))


def gap_preview(gaps: DataFrame, n: int = 10) -> DataFrame:
    """doc_id and its first n gaps as text; a note with their number follows if there are more."""
    per = gaps.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("gap_start", "gap_end"))).alias("g"))
    shown = F.transform(F.slice("g", 1, n), lambda x: F.concat(F.lit("["), x["gap_start"].cast("string"), F.lit(", "), x["gap_end"].cast("string"), F.lit("]")))
    note = F.when(F.size("g") > n, F.array(F.concat(F.lit("...共"), F.size("g").cast("string"), F.lit("段缺口")))).otherwise(F.array().cast("array<string>"))
    return per.select("doc_id", F.concat(shown, note).alias("preview"))


def exclusive_quantile(values: Column, n: Column, tenths: int) -> Column:
    """The tenths-th decile of a sorted array by the exclusive method; a single value is itself."""
    m = n + 1
    j = F.least(F.greatest(F.floor(m * tenths / 10), F.lit(1)), F.greatest(n - 1, F.lit(1))).cast("int")
    d = m * tenths - j * 10
    return F.when(n < 2, F.get(values, F.lit(0)).cast("double")).otherwise((F.get(values, j - 1) * (10 - d) + F.get(values, j) * d) / 10)


def length_stats(chunks: DataFrame) -> DataFrame:
    """n, min, median, p90 (exclusive), max of chunk lengths for each document, as whole numbers."""
    a = chunks.groupBy("doc_id").agg(F.sort_array(F.collect_list("length")).alias("v")).withColumn("n", F.size("v"))
    median = (F.get("v", F.floor((F.col("n") - 1) / 2).cast("int")) + F.get("v", F.floor(F.col("n") / 2).cast("int"))) / 2
    return a.select("doc_id", "n", F.get("v", F.lit(0)).alias("min"), F.floor(median).alias("median"), F.floor(exclusive_quantile(F.col("v"), F.col("n"), 9)).alias("p90"), F.get("v", F.col("n") - 1).alias("max"))


def chunk_quality(chunks: DataFrame, parents: DataFrame, page_cov: float = 0.98, section: float = 0.75, orphans: int = 0) -> DataFrame:
    """Coverage of pages (three decimals, null without a page count), share of chunks with a section, orphans, and the reasons for which
    a document is a problem.

    chunks: doc_id, chunk_id, parent_id, page, section; parents: doc_id, parent_id, pages (of the document).
    """
    known = parents.select("doc_id", "parent_id").distinct().withColumn("known", F.lit(True))
    total = parents.groupBy("doc_id").agg(F.max("pages").alias("pages"))
    per = chunks.join(known, ["doc_id", "parent_id"], "left").groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("chunks"), F.count_distinct("page").alias("seen"), F.count_if(F.coalesce("section", F.lit("")) != "").alias("with_section"), F.count_if(F.col("known").isNull()).alias("orphans"),
    )
    out = per.join(total, "doc_id", "left").select("doc_id", "chunks", F.round(F.try_divide("seen", "pages"), 3).alias("page_coverage"), (F.col("with_section") / F.col("chunks")).alias("section_ratio"), "orphans")
    said = lambda name, c: F.concat(F.lit(name + " "), F.col(c).cast("string"))
    checks = [F.when(F.col("page_coverage") < page_cov, said("page_cov", "page_coverage")), F.when(F.col("section_ratio") < section, said("section_path_ratio", "section_ratio")), F.when(F.col("orphans") > orphans, said("orphan_children", "orphans"))]
    return out.withColumn("reasons", F.filter(F.array(*checks), lambda x: x.isNotNull()))


def problem_list(quality: DataFrame) -> DataFrame:
    """pdf_stem and reasons of the documents that have any."""
    return quality.where(F.size("reasons") > 0).select(F.regexp_replace(F.col("doc_id").cast("string"), "_chunks$", "").alias("pdf_stem"), "reasons")


def used_documents(docs: DataFrame, queries: DataFrame, key: str = "scope") -> DataFrame:
    """The documents that some query refers to."""
    return docs.join(queries.select(key).distinct(), key, "left_semi")


def without_documents(docs: DataFrame, excluded: DataFrame, key: str = "doc_id") -> DataFrame:
    return docs.join(excluded.select(key).distinct(), key, "left_anti")


def within_documents(rows: DataFrame, stems: DataFrame, path: str = "report_paths") -> DataFrame:
    """The rows whose path's stem is one of pdf_stem."""
    return rows.withColumn("report_stem", stem(F.col(path))).join(stems.select(F.col("pdf_stem").alias("report_stem")).distinct(), "report_stem", "left_semi")


def select_documents(summary: DataFrame, target: int | None, cap: int | None, many_first: bool = True) -> tuple[DataFrame, DataFrame]:
    """The documents of a stage, in order, and their totals (total_pdfs, total_qa).

    summary: pdf_path, qa_count, qa_count_cumulative (null or absent: the place in the order). By falling qa_count, then rising
    cumulative count; or by the cumulative count alone (else by qa_count), rising. Rows are taken while fewer than ``cap`` are
    and the counts stay below ``target``. A running sum over one row per document.
    """
    given = "qa_count_cumulative" in summary.columns
    order = ([F.desc("qa_count")] + [F.asc_nulls_last("qa_count_cumulative")] * given if many_first else [F.asc_nulls_last("qa_count_cumulative" if given else "qa_count")]) + [F.asc("pdf_path")]
    taken = greedy_prefix(summary, order, "qa_count", target if target is not None else 2**62, cap if cap is not None else 2**31 - 1)
    cumulative = F.coalesce("qa_count_cumulative", "position") if given else F.col("position")
    chosen = taken.withColumn("qa_count_cumulative", cumulative.cast("long"))
    return chosen, chosen.agg(F.count(F.lit(1)).alias("total_pdfs"), F.coalesce(F.sum("qa_count"), F.lit(0)).alias("total_qa"))


def children_of(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("doc_id", "parent_id").agg(F.count(F.lit(1)).alias("children"), F.sort_array(F.collect_list("chunk_id")).alias("child_ids"))


def parent_of(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Each child with its parent's columns as parent_*; a chunk without a parent, or whose parent isn't there, keeps nulls."""
    rest = [c for c in chunks.columns if c not in (key, "chunk_id", "parent_id")]
    parents = chunks.select(key, F.col("chunk_id").alias("parent_id"), *(F.col(c).alias("parent_" + c) for c in rest))
    return chunks.join(parents, [key, "parent_id"], "left")


def content_hash(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """SHA-1 over the id::text of a document's chunks in the order of their ids as text, and their number.

    A chunk without an id goes by idx_ and its position. A document's texts meet in one row.
    """
    name = F.coalesce(F.col("chunk_id").cast("string"), F.concat(F.lit("idx_"), F.col("pos").cast("string")) if "pos" in chunks.columns else F.lit(""))
    item = F.struct(name.alias("id"), F.concat(name, F.lit("::"), F.coalesce("text", F.lit(""))).alias("x"))
    lists = chunks.groupBy(key).agg(F.sort_array(F.collect_list(item)).alias("items"), F.count(F.lit(1)).alias("chunks"))
    return lists.select(key, "chunks", F.sha1(F.array_join(F.transform("items", lambda i: i["x"]), "").cast("binary")).alias("content_hash"))


def key_aliases(source: Column, file: Column) -> Column:
    """Names by which a document is found: its source and that's base name, the chunk file's name, and its stem without _chunks."""
    base = lambda p: F.element_at(F.split(p, "/"), -1)
    names = F.array(F.nullif(source, F.lit("")), base(F.nullif(source, F.lit(""))), base(file), F.regexp_replace(stem(file), "_chunks$", ""))
    return F.array_distinct(F.filter(names, lambda x: x.isNotNull() & (x != "")))


def by_alias(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """Documents by any of their names: wanted (name) with the columns of files (source, file, ...); a whole path's base name will do.

    Where two files have a name, the one that comes last wins.
    """
    rest = [c for c in files.columns]
    named = last_wins(files.withColumn("alias", F.explode(key_aliases(F.col("source"), F.col("file")))), "alias", "file").select("alias", *rest)
    tried = wanted.withColumn("alias", F.explode(F.array_distinct(F.array("name", F.element_at(F.split("name", "/"), -1))))).withColumn("whole", F.col("alias") == F.col("name"))
    return last_wins(tried.join(named, "alias").drop("alias"), "name", "whole").drop("whole")


def clean_reasons(rows: DataFrame, placeholders: list[str]) -> Column:
    text = F.trim(F.coalesce("text", F.lit("")))
    return F.when(text == "", "empty").when(F.lower(text).isin(placeholders), "placeholder").otherwise("kept")


def cross_dimension(companies: Column, years: Column) -> Column:
    # fixed values: the class names
    size = lambda x: F.coalesce(F.size(x), F.lit(0))
    both = F.concat_ws("_", F.when(size(companies) == 1, "1co").otherwise("multi_co"), F.when(size(years) == 1, "1yr").otherwise("multi_yr"))
    return F.when((size(companies) < 1) | (size(years) < 1), "generic").otherwise(both)


def shares(rows: DataFrame, key: str) -> DataFrame:
    """key, n and its percentage of all rows, two decimals."""
    n = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return n.join(n.agg(F.sum("n").alias("total")), F.lit(True)).select(key, "n", F.round(100 * F.col("n") / F.col("total"), 2).alias("percent"))


def source_union(sources: dict[str, DataFrame]) -> DataFrame:
    """All sources' rows with their origin; columns that a source lacks are null."""
    out = None
    for name, df in sources.items():
        rows = df.withColumn("origin", F.lit(name))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def deduplicated(rows: DataFrame, keys: list[Column], order: str) -> DataFrame:
    """Marks rows as kept, or duplicate if an earlier one has equal keys. The keys meet as one digest, so long texts don't."""
    digest = F.sha2(F.to_json(F.struct(*(k.alias(f"k{i}") for i, k in enumerate(keys)))), 256)
    first = rows.groupBy(digest.alias("key_digest")).agg(F.min(order).alias("first_of"))
    return rows.withColumn("key_digest", digest).join(first, "key_digest").withColumn("reason", F.when(F.col(order) == F.col("first_of"), "kept").otherwise("duplicate")).drop("key_digest", "first_of")


def subset_index(rows: DataFrame, key: str, id_: str = "doc_id") -> DataFrame:
    """A saved filter's ids: key, n, and digests of its ids that don't depend on their order (sum and xor of their hashes).

    The ids themselves are rows, not one list: a subset may hold most of a corpus.
    """
    h = F.conv(F.substring(F.md5(F.col(id_).cast("string").cast("binary")), 1, 12), 16, 10).cast("long")
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(h.cast("decimal(38,0)")).cast("string").alias("ids_sum"), F.bit_xor(h).alias("ids_xor"))
