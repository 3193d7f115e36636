"""Dense and BM25 retrieval within scopes, and their fusion by reciprocal ranks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..session import having, saved, small
from .ranking import ranked, top_k


# Queries and chunks whose scores a task holds at a time: a million scores.
BLOCK = 1024


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def normalised(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return F.transform(v, lambda x: F.when(norm > 0, x / norm).otherwise(x))


def dense_scores(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id, doc_id, score of the chunks in each query's scope. Both inputs have scope and vector."""
    q = queries.select("query_id", "scope", F.col("vector").alias("qv"))
    both = q.join(chunks.select("doc_id", "scope", F.col("vector").alias("cv")), "scope")
    return both.select("query_id", "doc_id", F.round(dot(F.col("qv"), F.col("cv")), 6).alias("score"))


def kept_best(old_id: np.ndarray, old: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """ids and scores, a row for each query: the k best of the kept and the new ones, by falling score and id, NaN first as in Spark. Once k are
    kept, only those that reach the last of them are sorted."""
    n, held = old.shape
    if held >= k:
        row, column = np.nonzero(~(scores < old[:, -1:]))
        new_row, new_id, new = np.concatenate([np.repeat(np.arange(n), held), row]), np.concatenate([old_id.ravel(), ids[column]]), np.concatenate([old.ravel(), scores[row, column]])
        order = np.lexsort((new_id, -new, ~np.isnan(new), new_row))
        first = np.searchsorted(new_row[order], np.arange(n))
        take = order[first[:, None] + np.arange(k)]
        return new_id[take], new[take]
    both, both_id = np.hstack([old, scores]), np.hstack([old_id, np.broadcast_to(ids, scores.shape)])
    order = np.lexsort((both_id, -both, ~np.isnan(both)), axis=1)[:, :k]
    return np.take_along_axis(both_id, order, 1), np.take_along_axis(both, order, 1)


def best_of(batches, names: np.ndarray, matrix: np.ndarray, k: int) -> pa.RecordBatch:
    """query_id, doc_id, score: the k best chunks of Arrow batches (doc_id, vector) for each row of the matrix."""
    best_id, best = np.zeros((len(names), 0), dtype=np.int64), np.empty((len(names), 0))
    for b in batches:
        for at in range(0, b.num_rows, BLOCK):
            v, i = b.column(1).slice(at, BLOCK), b.column(0).slice(at, BLOCK).to_numpy(zero_copy_only=False)
            lengths = pa.compute.list_value_length(v).fill_null(-1).to_numpy(zero_copy_only=False)
            fits = np.flatnonzero(lengths == matrix.shape[1])
            if not len(fits):
                continue
            c = v.take(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(fits), -1)
            width = max(best.shape[1], min(k, best.shape[1] + len(fits)))
            more_id, more = np.empty((len(names), width), dtype=np.int64), np.empty((len(names), width))
            for row in range(0, len(names), BLOCK):
                some = slice(row, row + BLOCK)
                more_id[some], more[some] = kept_best(best_id[some], best[some], i[fits], np.round(matrix[some] @ c.T, 6), k)
            best_id, best = more_id, more
    n = best.shape[1]
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(names, n)), pa.array(best_id.ravel()), pa.array(best.ravel())], ["query_id", "doc_id", "score"])


def dense_topk(queries: DataFrame, chunks: DataFrame, k: int, block: int = 4096) -> DataFrame:
    """query_id, doc_id, score, rank: the k best of all chunks for each of a stated set of queries.

    The queries go to the tasks in blocks of at most ``block`` vectors, as one matrix each. A task multiplies its batches with the block
    and keeps k chunks a query, so what is shuffled is k rows for each query and task, whatever the corpus. Scores exist for ``BLOCK``
    queries and ``BLOCK`` chunks at a time. Vectors of another length than the block's, and null ones, have no score.
    """
    spark = chunks.sparkSession
    ids = queries.select("query_id").where("vector is not null")
    out = None
    for part in range(max(1, -(-ids.count() // block))):
        rows = queries.where("vector is not null").select("query_id", "vector").orderBy("query_id").offset(part * block).limit(block).collect()
        if not rows:
            break
        shared = spark.sparkContext.broadcast((np.array([r.query_id for r in rows]), np.array([r.vector for r in rows], dtype=np.float64)))

        def run(batches, shared=shared):
            yield best_of(batches, *shared.value, k)

        some = chunks.select(F.col("doc_id").cast("long"), "vector").mapInArrow(run, "query_id long, doc_id long, score double")
        out = some if out is None else out.unionByName(some)
    if out is None:
        out = spark.createDataFrame([], "query_id long, doc_id long, score double")
    return top_k(out, "query_id", k)


def postings(docs: DataFrame) -> DataFrame:
    """scope, doc_id, term, tf of tokenized chunks (scope, doc_id, tokens)."""
    return docs.select("scope", "doc_id", F.explode("tokens").alias("term")).groupBy("scope", "doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def tokenized(docs: DataFrame, tokenizer=tokens) -> DataFrame:
    return docs.select("scope", "doc_id", tokenizer(F.col("text")).alias("tokens"))


def scope_stats(docs: DataFrame) -> DataFrame:
    return docs.groupBy("scope").agg(F.count(F.lit(1)).alias("n"), (F.sum(F.size("tokens")) / F.count(F.lit(1))).alias("avgdl"))


def term_df(docs: DataFrame) -> DataFrame:
    """scope, term, df of tokenized chunks, one row for each doc_id: a chunk's terms are made distinct within its row, so only counts are shuffled."""
    return docs.select("scope", F.explode(F.array_distinct("tokens")).alias("term")).groupBy("scope", "term").agg(F.count(F.lit(1)).alias("df"))


def raw_idf(n: str = "n", df: str = "df") -> Column:
    return F.log(F.col(n) - F.col(df) + 0.5) - F.log(F.col(df) + 0.5)


def mean_idf(df: DataFrame, stats: DataFrame) -> DataFrame:
    """scope, n, mean: each scope's mean idf, from the number of its terms with each df."""
    return mean_of_counts(df_counts(df), stats)


def df_counts(df: DataFrame) -> DataFrame:
    """scope, df, c: how many terms of the scope have the df."""
    return df.groupBy("scope", "df").agg(F.count(F.lit(1)).alias("c"))


def mean_of_counts(counts: DataFrame, stats: DataFrame) -> DataFrame:
    sized = counts.join(stats.select("scope", "n"), "scope")
    return sized.groupBy("scope", "n").agg((F.sum(F.col("c") * raw_idf()) / F.sum("c")).alias("mean"))


def idf_of(df: DataFrame, means: DataFrame, epsilon: float = 0.25) -> DataFrame:
    """scope, term, df, idf. A negative idf becomes epsilon times the scope's mean idf."""
    raw = df.join(means, "scope").withColumn("raw", raw_idf())
    return raw.select("scope", "term", "df", F.when(F.col("raw") < 0, epsilon * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def idf(tf: DataFrame, stats: DataFrame, epsilon: float = 0.25) -> DataFrame:
    """idf_of with the dfs of postings."""
    df = tf.groupBy("scope", "term").agg(F.count(F.lit(1)).alias("df"))
    return idf_of(df, mean_idf(df, stats), epsilon)


def query_terms(queries: DataFrame, tokenizer=tokens) -> DataFrame:
    """query_id, scope, term, qtf."""
    terms = tokenized(queries.withColumnRenamed("query_id", "doc_id"), tokenizer).select("scope", F.col("doc_id").alias("query_id"), F.explode("tokens").alias("term"))
    return terms.groupBy("query_id", "scope", "term").agg(F.count(F.lit(1)).alias("qtf"))


def counted_terms(batches, known: dict | None, every: bool):
    """Arrow batches scope, doc_id, term, n, dl, nd from batches of tokenized chunks (scope, doc_id, tokens).

    Postings have n = tf, of the terms that ``known`` has for the chunk's scope (None: of all terms); a chunk of a known scope also has a row
    without a term. With ``every``, rows without dl say that n chunks of the batch have the term. Terms are numbered within a batch, so that
    counting sorts numbers.
    """
    for b in batches:
        scopes, lists = b.column(0).dictionary_encode(null_encoding="encode"), b.column(2)
        own, names = scopes.indices.to_numpy().astype(np.int64), scopes.dictionary
        coded = lists.flatten().dictionary_encode()
        words, width = coded.dictionary, max(1, len(coded.dictionary))
        length = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
        pair, tf = np.unique(np.repeat(np.arange(b.num_rows) * width, length) + coded.indices.to_numpy(), return_counts=True)
        row, code = np.divmod(pair, width)
        nd, term = np.bincount(row, minlength=b.num_rows), own[row] * width + code

        def rows(scope, doc_id, term, n, dl=None, nd=None):
            sizes = [pa.nulls(len(n), pa.int32()) if x is None else pa.array(x, pa.int32()) for x in (dl, nd)]
            return pa.RecordBatch.from_arrays([names.take(pa.array(scope)), doc_id, term, pa.array(n, pa.int64()), *sizes], ["scope", "doc_id", "term", "n", "dl", "nd"])

        if every:
            key, df = np.unique(term, return_counts=True)
            yield rows(key // width, pa.nulls(len(key), b.column(1).type), words.take(pa.array(key % width)), df)
        hit, chunk = np.arange(len(term)), np.arange(b.num_rows)
        if known is not None:
            at = [i for i, name in enumerate(names.to_pylist()) if name in known]
            lists = [known[names[i].as_py()] for i in at]
            asked = pc.index_in(pa.concat_arrays([words[:0], *lists]), words).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            of = np.repeat(np.array(at, dtype=np.int64), [len(x) for x in lists])
            hit = np.flatnonzero(np.isin(term, of[asked >= 0] * width + asked[asked >= 0]))
            chunk = np.flatnonzero(np.isin(own, at))
        yield rows(own[row[hit]], b.column(1).take(pa.array(row[hit])), words.take(pa.array(code[hit])), tf[hit], length[row[hit]], nd[row[hit]])
        yield rows(own[chunk], b.column(1).take(pa.array(chunk)), pa.nulls(len(chunk), words.type), np.ones(len(chunk), dtype=np.int64), length[chunk], nd[chunk])


def counted(queries: DataFrame, docs: DataFrame, tokenizer=tokens, every: bool = True, most: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """The postings of ``asked_postings``, and scope, df, c: how many terms of a scope have each df (with ``every``, else none). Saved.

    The chunks are read and tokenized once for both; each batch is counted in a Python worker, and what is shuffled are the asked postings and
    one row for each batch, scope and term. Up to ``most`` asked terms go to the workers; if there are more, all postings are joined with them.
    """
    spark = docs.sparkSession
    terms = tokenized(queries.withColumnRenamed("query_id", "doc_id"), tokenizer).select("scope", F.explode_outer(F.concat("tokens", F.array(F.lit(None).cast("string")))).alias("term"))
    asked = saved(terms.where("scope is not null").distinct(), "asked")
    known = None
    if asked.limit(most + 1).count() <= most:
        lists = asked.groupBy("scope").agg(F.collect_list("term").alias("terms")).collect()  # without the nulls
        known = spark.sparkContext.broadcast({r.scope: pa.array(r.terms, pa.string()) for r in lists})

    def run(batches, known=known):
        yield from counted_terms(batches, known and known.value, every)

    kinds = {f.name: f.dataType.simpleString() for f in docs.select("scope", "doc_id").schema}
    made = tokenized(docs, tokenizer).mapInArrow(run, f"scope {kinds['scope']}, doc_id {kinds['doc_id']}, term string, n long, dl int, nd int")
    if known is None:
        pairs = asked.select(F.col("scope").alias("asked_scope"), F.col("term").alias("asked_term"))
        wanted = made.where("dl is not null").join(pairs, (F.col("scope") == F.col("asked_scope")) & F.col("term").eqNullSafe(F.col("asked_term")), "left_semi")
        made = made.where("dl is null").unionByName(wanted) if every else wanted
    sums = made.groupBy("scope", "doc_id", "term", F.col("dl").isNull().alias("total")).agg(F.sum("n").alias("n"), F.max("dl").alias("dl"), F.max("nd").alias("nd"))
    table = saved(sums.select("scope", "doc_id", F.when(~F.col("total"), F.col("term")).alias("term"), "n", "dl", "nd", "total"), "postings", "total")
    postings = table.where("not total").select("scope", "doc_id", "term", F.col("n").alias("tf"), "dl", "nd")
    return postings, df_counts(table.where("total").select("scope", F.col("n").alias("df")))


def asked_postings(queries: DataFrame, docs: DataFrame, tokenizer=tokens) -> DataFrame:
    """scope, doc_id, term, tf, dl, nd: the postings of those terms that a query of the scope has, saved.

    Each chunk of a query's scope also has a row without a term. dl is a chunk's number of tokens, nd that of its distinct ones.
    """
    return counted(queries, docs, tokenizer, False)[0]


def asked_chunks(found: DataFrame) -> DataFrame:
    return found.where("term is null").select("scope", "doc_id")


def bm25_weights(queries: DataFrame, docs: DataFrame, asked: DataFrame, tokenizer=tokens, counts: DataFrame | None = None) -> DataFrame:
    """query_id, scope, term, qtf, idf, avgdl, saved. Without the counts of ``counted``, all terms of a scope are counted if a query's term needs
    the scope's mean idf."""
    stats = asked.where("term is null").groupBy("scope").agg(F.count(F.lit(1)).alias("n"), (F.sum("dl") / F.count(F.lit(1))).alias("avgdl"))
    stats = small(saved(stats, "stats"))
    df = asked.where("term is not null").groupBy("scope", "term").agg(F.count(F.lit(1)).alias("df"))
    if counts is None:
        df = saved(df, "df")
        low = small(saved(df.join(stats, "scope").where(raw_idf() < 0).select("scope").distinct(), "low"))
        every = tokenized(docs.join(low, "scope", "left_semi"), tokenizer)
        mean = stats.select("scope", "n", F.lit(None).cast("double").alias("mean")) if low.isEmpty() else stats.select("scope", "n").join(small(saved(mean_idf(term_df(every), stats), "mean")).drop("n"), "scope", "left")
    else:
        mean = stats.select("scope", "n").join(small(saved(mean_of_counts(counts, stats), "mean")).drop("n"), "scope", "left")
    weight = idf_of(df, mean).join(query_terms(queries, tokenizer), ["scope", "term"]).join(stats.select("scope", "avgdl"), "scope")
    return saved(weight.select("query_id", "scope", "term", "qtf", "idf", "avgdl"), "weights")


def bm25_found(weights: DataFrame, asked: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """query_id, doc_id, score of the chunks that have a query term."""
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    hit = asked.where("term is not null and doc_id is not null").join(small(weights), ["scope", "term"])
    return hit.groupBy("query_id", "doc_id").agg(F.round(F.sum(part), 6).alias("score"))


def cosine_weights(queries: DataFrame, tokenizer=tokens) -> DataFrame:
    """query_id, scope, term, nq (the query's number of distinct terms), saved."""
    q = tokenized(queries.withColumnRenamed("query_id", "doc_id"), tokenizer).select("scope", F.col("doc_id").alias("query_id"), F.array_distinct("tokens").alias("t"))
    return saved(q.select("query_id", "scope", F.size("t").alias("nq"), F.explode("t").alias("term")), "terms")


def term_cosine_found(weights: DataFrame, asked: DataFrame) -> DataFrame:
    """A deterministic stand-in for an encoder: cosine of the sets of distinct terms, for the chunks that share one."""
    hit = asked.where("term is not null and doc_id is not null").join(small(weights), ["scope", "term"])
    cosine = F.count(F.lit(1)) / F.sqrt((F.first("nq") * F.first("nd")).cast("double"))
    return hit.groupBy("query_id", "doc_id").agg(F.round(cosine, 6).alias("score"))


def with_zeros(found: DataFrame, queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """Scores of all chunks of each query's scope; those that weren't found have 0."""
    every = chunks.select("scope", "doc_id").join(queries.select("query_id", "scope"), "scope")
    return every.join(found, ["query_id", "doc_id"], "left").select("query_id", "doc_id", F.coalesce("score", F.lit(0.0)).alias("score"))


def bm25_scores(queries: DataFrame, docs: DataFrame, k1: float = 1.5, b: float = 0.75, tokenizer=tokens) -> DataFrame:
    """query_id, doc_id, score for all chunks of each query's scope."""
    asked, counts = counted(queries, docs, tokenizer)
    return with_zeros(bm25_found(bm25_weights(queries, docs, asked, tokenizer, counts), asked, k1, b), queries, asked_chunks(asked))


def term_cosine_scores(queries: DataFrame, docs: DataFrame, tokenizer=tokens) -> DataFrame:
    asked = asked_postings(queries, docs, tokenizer)
    return with_zeros(term_cosine_found(cosine_weights(queries, tokenizer), asked), queries, asked_chunks(asked))


def term_cosine_of(pairs: DataFrame, queries: DataFrame, asked: DataFrame, tokenizer=tokens) -> DataFrame:
    """query_id, doc_id, score of the given pairs of a query and a chunk of its scope."""
    found = term_cosine_found(cosine_weights(queries, tokenizer), having(asked, pairs))
    return pairs.select("query_id", "doc_id").join(found, ["query_id", "doc_id"], "left").select("query_id", "doc_id", F.coalesce("score", F.lit(0.0)).alias("score"))


def top_found(queries: DataFrame, asked: DataFrame, weights: DataFrame, k: int, found) -> DataFrame:
    """The k best chunks of each query's scope by ``found(weights, asked)``, chunks without a score counting 0.

    Queries with k positive scores are done with the postings; only the others are paired with all chunks of their scope.
    """
    best = saved(top_k(found(weights, asked).where("score > 0"), "query_id", k), "best")
    short = small(saved(queries.select("query_id", "scope").join(best.where(F.col("rank") == k).select("query_id"), "query_id", "left_anti"), "short"))
    if short.isEmpty():
        return best
    ids = short.select("query_id")
    rest = top_k(with_zeros(found(weights.join(ids, "query_id", "left_semi"), asked), short, asked_chunks(asked)), "query_id", k)
    return saved(best.join(ids, "query_id", "left_anti").unionByName(rest), "best")


def rrf(a: DataFrame, b: DataFrame, k: int, rrf_k: int = 60, missing: int = 9999) -> DataFrame:
    """Fused top-k of two ranked routes (query_id, doc_id, rank); a rank of null or 0 counts as missing.

    Ties keep the first route's order, then the second's.
    """
    x = a.select("query_id", "doc_id", F.nullif("rank", F.lit(0)).alias("rank_a"))
    y = b.select("query_id", "doc_id", F.nullif("rank", F.lit(0)).alias("rank_b"))
    both = x.join(y, ["query_id", "doc_id"], "full")
    part = lambda c: F.lit(1.0) / (F.lit(rrf_k) + F.coalesce(c, F.lit(missing)))
    scored = both.withColumn("score", F.round(part("rank_a") + part("rank_b"), 9))
    order = [F.desc("score"), F.col("rank_a").isNull(), F.coalesce("rank_a", "rank_b"), F.asc("doc_id")]
    return ranked(scored, "query_id", order).where(F.col("rank") <= k).select("query_id", "doc_id", "score", "rank")


def three_way(dense: DataFrame, bm25: DataFrame, scopes: tuple[int, ...] = (50, 20)) -> DataFrame:
    """route, cut, query_id, doc_id, score, rank. The hybrid of a smaller cut is fused anew from the cut routes."""
    out = None
    for k in scopes:
        a, b = dense.where(F.col("rank") <= k), bm25.where(F.col("rank") <= k)
        for route, hits in (("embedding", a), ("bm25", b), ("hybrid", rrf(a, b, k))):
            rows = hits.select(F.lit(route).alias("route"), F.lit(k).alias("cut"), "query_id", "doc_id", "score", "rank")
            out = rows if out is None else out.unionByName(rows)
    return out


def nested(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """One row for each query with its hits in order; queries without hits have an empty list."""
    item = F.struct("rank", "doc_id", "score")
    lists = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(item)).alias("hits"))
    return queries.join(lists, "query_id", "left").withColumn("hits", F.coalesce("hits", F.array().cast(lists.schema["hits"].dataType)))


__all__ = ["asked_chunks", "asked_postings", "bm25_found", "bm25_scores", "bm25_weights", "cosine_weights", "counted", "dense_scores", "dense_topk", "dot", "idf", "idf_of", "mean_idf", "nested", "normalised", "postings", "rrf", "scope_stats", "term_cosine_found", "term_cosine_of", "term_cosine_scores", "term_df", "three_way", "tokenized", "top_found", "top_k"]
