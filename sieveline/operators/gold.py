"""Gold sets: samples, templates, votes and their adjudication, alignment, resumed labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import canonical_label, candidate_key
from ..session import having
from .training import hash_order


def sample(ids: DataFrame, n: int, seed: str = "42") -> DataFrame:
    """n ids in hash order, all if there are fewer."""
    return ids.select("query_id").distinct().orderBy(hash_order(F.col("query_id"), seed), "query_id").limit(n)


def resample(all_ids: DataFrame, current: DataFrame, empty: DataFrame, dropped: DataFrame, size: int, seed: str = "42") -> DataFrame:
    """The current ids that aren't in ``empty``, and as many others for those that are; adds origin.

    Replacements are neither current nor dropped. Too few of them, or a set of another size than asked for, is an error; without
    an empty query nothing is replaced, whatever the size.
    """
    now = current.select("query_id").distinct()
    keep, lost = now.join(empty.select("query_id"), "query_id", "left_anti"), now.join(empty.select("query_id").distinct(), "query_id", "left_semi").count()
    free = all_ids.select("query_id").distinct().join(now, "query_id", "left_anti").join(dropped.select("query_id"), "query_id", "left_anti")
    more = sample(free, lost, seed)
    if more.count() < lost:
        raise ValueError(f"{lost} replacements are needed, there are fewer")
    out = keep.withColumn("origin", F.lit("kept")).unionByName(more.withColumn("origin", F.lit("added")))
    if lost and out.count() != size:
        raise ValueError(f"the set would have {out.count()} queries, not {size}")
    return out


def additions(all_ids: DataFrame, excluded: list[DataFrame], n: int, seed: str = "42") -> DataFrame:
    """n ids in none of the excluded sets; fewer of them are an error."""
    free = all_ids.select("query_id").distinct()
    for e in excluded:
        free = free.join(e.select("query_id").distinct(), "query_id", "left_anti")
    out = sample(free, n, seed)
    if out.count() < n:
        raise ValueError(f"{n} additions are needed, there are fewer")
    return out


def change_report(before: DataFrame, after: DataFrame, excluded: DataFrame) -> DataFrame:
    """One row of a resampled or extended set: kept, dropped, sampled and excluded ids, sorted. A gold set's ids are few."""
    b, a = before.select("query_id").distinct(), after.select("query_id").distinct()
    ids = lambda df, name: df.agg(F.sort_array(F.collect_set("query_id")).alias(name))
    parts = [ids(b.intersect(a), "kept_qids"), ids(b.subtract(a), "dropped_qids"), ids(a.subtract(b), "sampled_qids"), ids(excluded, "excluded_qids")]
    out = parts[0]
    for x in parts[1:]:
        out = out.join(x, F.lit(True))
    return out.withColumn("size", F.size("kept_qids") + F.size("sampled_qids"))


def merged_gold(kept: DataFrame, selected: DataFrame, size: int) -> DataFrame:
    """Two disjoint gold sets as one with source; another size than asked for, or a query in both, is an error."""
    out = kept.withColumn("source", F.lit("kept")).unionByName(selected.withColumn("source", F.lit("selected")), allowMissingColumns=True)
    n, distinct = out.agg(F.count(F.lit(1)), F.count_distinct("query_id")).first()
    if n != size or distinct != n:
        raise ValueError(f"{n} records of {distinct} queries, not {size}")
    return out


def merged_ids(old: DataFrame, new: DataFrame, mode: str = "merge") -> DataFrame:
    if mode not in ("merge", "replace"):
        raise ValueError(mode)
    both = old.select("query_id").unionByName(new.select("query_id")) if mode == "merge" else new.select("query_id")
    return both.where("query_id is not null").distinct()


def upserted(existing: DataFrame, new: DataFrame) -> DataFrame:
    """The dropped list with new ids; without any the list stays as it is."""
    return existing.select("query_id") if new.isEmpty() else merged_ids(existing, new)


def template(hits: DataFrame, docs: DataFrame, k: int = 20, strict_missing: bool = False) -> DataFrame:
    """Candidates to be labelled: the first k hits with their texts; blank texts are labelled at once.

    strict_missing: a candidate without a chunk is an error (``missing_chunks`` names them).
    """
    first = hits.where(F.col("rank") <= k)
    rows = first.join(having(docs.select("doc_id", "text"), first).withColumn("there", F.lit(True)), "doc_id", "left")
    if strict_missing and not rows.where("there is null").isEmpty():
        raise ValueError("candidates without a chunk")
    blank = F.trim(F.coalesce("text", F.lit(""))) == ""
    return rows.drop("there").withColumns({"text": F.coalesce("text", F.lit("")), "label": F.when(blank, "irrelevant"), "notes": F.when(blank, "empty_text").otherwise("")})


def missing_chunks(hits: DataFrame, docs: DataFrame, k: int = 20) -> DataFrame:
    return hits.where(F.col("rank") <= k).select("doc_id").distinct().join(docs.select("doc_id"), "doc_id", "left_anti")


def gold_stem(hits: Column, pdf: Column) -> Column:
    """A gold record's document: the first hit's stem or pdf, else the query's pdf."""
    first = F.get(hits, F.lit(0))
    return F.coalesce(F.nullif(first["pdf_stem"], F.lit("")), F.nullif(first["pdf"], F.lit("")), pdf)


def decide(a: Column, b: Column, c: Column, all_different: str = "gemini") -> tuple[Column, Column]:
    """Label and rule of three canonical votes: two alike decide; else the policy, the first vote, or related."""
    # fixed values: the rules' names
    votes = F.array(a, b, c)
    n = lambda x: F.size(F.filter(votes, lambda v: v == x))
    two = [(x, n(x) >= 2) for x in ("evidence", "irrelevant", "related")]
    label, rule = F.when(two[0][1], two[0][0]), F.when(two[0][1], "majority_evidence")
    for x, cond in two[1:]:
        label, rule = label.when(cond, x), rule.when(cond, "majority_" + x)
    if all_different == "related":
        return label.otherwise("related"), rule.otherwise("all_diff_related")
    return label.when(a.isNotNull(), a).otherwise("related"), rule.when(a.isNotNull(), "all_diff_gemini").otherwise("all_diff_fallback")


def adjudicate(votes: DataFrame, annotators: tuple[str, str, str], all_different: str = "gemini", notes: str = "if_match") -> DataFrame:
    """One row a candidate from one column of raw labels an annotator: canonical votes, final_label, rule, core, notes."""
    a, b, c = (canonical_label(F.col(x)) for x in annotators)
    label, rule = decide(F.col("v1"), F.col("v2"), F.col("v3"), all_different)
    given = F.array("v1", "v2", "v3")
    out = votes.withColumns({"v1": a, "v2": b, "v3": c}).withColumns({"final_label": label, "rule": rule})
    core = (F.size(F.filter(given, lambda v: v.isNotNull())) == 3) & (F.size(F.array_distinct(given)) == 1)
    out = out.withColumn("core", core)
    if "notes" in votes.columns:
        keep = {"if_match": F.when(F.col("v1") == F.col("final_label"), F.col("notes")).otherwise(""), "always": F.col("notes"), "empty": F.lit("")}[notes]
        out = out.withColumn("notes", F.coalesce(keep, F.lit("")))
    return out


def vote_table(template_rows: DataFrame, sources: dict[str, DataFrame], keys: tuple[str, str] = ("query_id", "doc_id")) -> DataFrame:
    """The template's candidates with one column of raw labels a source, and the first source's notes.

    A source has the keys, label and maybe notes. Labels of candidates that aren't in the template are left out; of several labels
    of one candidate the greatest counts.
    """
    out, k = template_rows, list(keys)
    for i, (name, rows) in enumerate(sources.items()):
        one = rows.groupBy(*k).agg(F.max("label").alias(name), *([F.max_by("notes", "label").alias("vote_notes")] if not i and "notes" in rows.columns else []))
        out = out.join(one, k, "left")
    return out.drop("notes").withColumnRenamed("vote_notes", "notes") if "vote_notes" in out.columns else out


def gold_records(adjudicated: DataFrame, core: bool = False) -> DataFrame:
    """query_id and its labelled candidates in the order of ranks; the core set keeps unanimous ones only, and queries with none."""
    item = F.struct("rank", "doc_id", F.col("final_label").alias("label"), "notes")
    chosen = F.when(F.col("core"), item) if core else item
    return adjudicated.groupBy("query_id").agg(F.sort_array(F.collect_list(chosen)).alias("candidates"))


def adjudication_rows(adjudicated: DataFrame) -> DataFrame:
    """One record a candidate: query_id, doc_id, rank, final_label, adjudication_rule, raw_votes (canonical)."""
    votes = F.struct(F.col("v1").alias("gemini"), F.col("v2").alias("qwen"), F.col("v3").alias("codex"))
    return adjudicated.select("query_id", "doc_id", "rank", "final_label", F.col("rule").alias("adjudication_rule"), votes.alias("raw_votes"))


def alignment(template_rows: DataFrame, source: DataFrame, key: str = "query_id", item: str = "doc_id") -> DataFrame:
    """For each query the items missing in the source and extra in it, and how many."""
    t, s = (x.select(key, item).distinct().withColumn(n, F.lit(1)) for x, n in ((template_rows, "t"), (source, "s")))
    lists = {n: F.sort_array(F.collect_list(F.when(F.col(c).isNull(), F.col(item)))) for n, c in (("missing_ids", "s"), ("extra_ids", "t"))}
    both = t.join(s, [key, item], "full").groupBy(key).agg(*(v.alias(n) for n, v in lists.items()))
    return both.select(key, F.size("missing_ids").cast("long").alias("missing"), F.size("extra_ids").cast("long").alias("extra"), "missing_ids", "extra_ids")


def stem_mismatches(candidates: DataFrame, n: int = 5) -> DataFrame:
    """Among each query's first n candidates (rank, chunk_stem) those of another document than its pdf_stem."""
    return candidates.where((F.col("rank") <= n) & (F.coalesce("chunk_stem", F.lit("")) != "") & ~F.col("chunk_stem").eqNullSafe(F.col("pdf_stem")))


def _votes(votes: DataFrame, annotators: tuple[str, ...]) -> DataFrame:
    pairs = ", ".join(f"'{x}', {x}" for x in annotators)
    long = votes.select("query_id", "doc_id", F.expr(f"stack({len(annotators)}, {pairs}) as (annotator, raw)"))
    return long.withColumn("label", F.coalesce(canonical_label(F.col("raw")), F.lit("missing")))


def vote_distribution(votes: DataFrame, annotators: tuple[str, ...]) -> DataFrame:
    return _votes(votes, annotators).groupBy("annotator", "label").agg(F.count(F.lit(1)).alias("votes"), F.count_distinct("query_id").alias("queries"))


def missing_votes(votes: DataFrame, annotators: tuple[str, ...]) -> DataFrame:
    """query_id, doc_id, annotator of each vote that isn't there or can't be read."""
    return _votes(votes, annotators).where("label = 'missing'").select("query_id", "doc_id", "annotator")


def any_positive(votes: DataFrame, annotators: tuple[str, ...]) -> DataFrame:
    """query_id and whether any annotator called any of its candidates evidence or related."""
    return _votes(votes, annotators).groupBy("query_id").agg(F.bool_or(F.col("label").isin("evidence", "related")).alias("has_positive"))


def without_positive(labelled: DataFrame) -> DataFrame:
    """Queries with no candidate that is evidence or related."""
    return labelled.groupBy("query_id").agg(F.count_if(F.col("label").isin("evidence", "related")).alias("p")).where("p = 0").select("query_id")


def resume(candidates: DataFrame, earlier: DataFrame) -> DataFrame:
    """Candidates with labels that an earlier run gave; the key is chunk and rank, or rank, or position."""
    key = candidate_key(F.col("chunk"), F.col("rank"), F.col("idx"))
    old = earlier.select("query_id", key.alias("k"), F.col("label").alias("old")).dropDuplicates(["query_id", "k"])
    return candidates.withColumn("k", key).join(old, ["query_id", "k"], "left").withColumn("label", F.coalesce("label", "old")).drop("old")
