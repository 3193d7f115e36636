"""Queries over the test tables, one or more for each operator, and the same in DuckDB SQL.

Stand-ins: a scope is ``documents.source`` with documents as chunks, or a document with its lines as chunks; text queries are
``benchmark`` items with scope ``src<item_id mod 20>``, whose answers are signs and numbers of their own and of a part, and for every
other query a mail address; vectors are ``embeddings`` with ``label`` as scope, those with an id divisible
by 50 being queries; gold labels follow from ``labels``; votes are three annotators derived from labels and lengths.
Every query runs over whole tables.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import documents as D
from ..operators import evaluation as E
from ..operators import gold as G
from ..operators import matching as M
from ..operators import ranking as R
from ..operators import retrieval as V
from ..operators import runs as U
from ..operators import training as T
from ..session import saved, shared_path, ship, small
from ..sources import readers, writers
from ..streaming import incremental as I


class Tables:
    """The canonical tables of one folder, lazily read."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        ship(spark)
        self.spark, self.dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def docs(self) -> DataFrame:
        return self.raw("documents").select("doc_id", F.col("source").alias("scope"), F.coalesce("text", F.lit("")).alias("text"))

    @property
    def queries(self) -> DataFrame:
        scope = F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string"))
        return self.raw("benchmark").select(F.col("item_id").alias("query_id"), scope.alias("scope"), F.coalesce("text", F.lit("")).alias("text"))

    @property
    def vectors(self) -> tuple[DataFrame, DataFrame]:
        v = self.raw("embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").alias("scope"), F.col("embedding").alias("vector"))
        return v.where("doc_id % 50 = 0").withColumnRenamed("doc_id", "query_id"), v

    @cached_property
    def counted(self) -> tuple[DataFrame, DataFrame]:
        return V.counted(self.queries, self.docs)

    @property
    def asked(self) -> DataFrame:
        """The postings of all queries' terms, read off the documents once for both routes."""
        return self.counted[0]

    @cached_property
    def bm25(self) -> DataFrame:
        """Both routes are computed once for a query and saved: 50 rows for each text query."""
        return V.top_found(self.queries, self.asked, V.bm25_weights(self.queries, self.docs, self.asked, counts=self.counted[1]), 50, V.bm25_found)

    @cached_property
    def cosine(self) -> DataFrame:
        return V.top_found(self.queries, self.asked, V.cosine_weights(self.queries), 50, V.term_cosine_found)

    @property
    def lines(self) -> DataFrame:
        """doc_id, pos (from 0), line, parent: five lines each."""
        rows = self.raw("documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))
        return rows.withColumn("parent", F.floor(F.col("pos") / 5).cast("int"))

    @property
    def keys(self) -> DataFrame:
        """Answers of queries: the first 24 signs and the last word of the text, and the price of the part with the next id as a number; a
        mail address before them for one query in four, behind them for another."""
        first = self.queries.select("query_id", F.lit(0).alias("pos"), F.substring("text", 1, 24).alias("value"), F.lit("prom_answer").alias("source"))
        last = self.queries.select("query_id", F.lit(2).alias("pos"), F.element_at(F.split("text", " "), -1).alias("value"), F.lit("last").alias("source"))
        price = self.raw("part").select((F.col("p_partkey") - 1).alias("query_id"), F.lit(1).alias("pos"), F.concat(F.round("p_retailprice", 2).cast("decimal(18,2)").cast("string"), F.lit("元")).alias("value"), F.lit("price").alias("source"))
        k = F.col("query_id") % 4
        mail = self.queries.where("query_id % 2 = 1").select("query_id", F.when(k == 1, -1).otherwise(3).alias("pos"), F.lit("nobody@nowhere.example").alias("value"), F.lit("电子信箱").alias("source"))
        return first.unionByName(last).unionByName(price.join(self.queries.select("query_id"), "query_id", "left_semi")).unionByName(mail)

    @cached_property
    def matched(self) -> DataFrame:
        """Saved, since triplets read it twice and more."""
        return saved(M.match(self.bm25, self.docs, self.keys), "matched")

    @cached_property
    def part_matched(self) -> DataFrame:
        """Without the texts of every ninth document."""
        return saved(M.match(self.bm25, self.docs.where("doc_id % 9 <> 0"), self.keys), "matched")

    @property
    def gold(self) -> DataFrame:
        """Each query's judged documents are the labelled ones of its scope."""
        label = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "evidence").when(F.col("quality") == 1, "related").otherwise("irrelevant")
        known = self.raw("labels").select("doc_id", label.alias("label"))
        labelled = self.docs.select("scope", "doc_id").join(known, "doc_id")
        return labelled.join(small(self.queries.select("query_id", "scope")), "scope").select("query_id", "doc_id", "label")

    @property
    def triplets(self) -> DataFrame:
        return M.mine(M.auto_label(self.matched))

    @property
    def vote_sources(self) -> tuple[DataFrame, dict[str, DataFrame]]:
        """Candidates (query_id = doc_id mod 50), and three annotators' labels of most of them, some missing or misspelled."""
        d = self.raw("labels").join(self.raw("documents").select("doc_id", "n_chars"), "doc_id").withColumn("query_id", F.col("doc_id") % 50)
        a = F.when(F.col("quality") == 1, "Evidence").otherwise(" irrelevant")
        b = F.when(F.col("toxic") == 1, "irrel").when(F.col("n_chars") % 3 == 0, "related").otherwise("evidence ")
        c = F.when(F.col("n_chars") % 5 == 0, "none").when(F.col("n_chars") % 2 == 0, "RELATED").otherwise("evid.")
        of = lambda label, every: d.where(F.col("doc_id") % every != 0).select("query_id", "doc_id", label.alias("label"))
        return d.select("query_id", "doc_id", F.col("doc_id").alias("rank")), {"gemini": of(a, 11).withColumn("notes", F.lit("seen")), "qwen": of(b, 13), "codex": of(c, 17)}

    @property
    def votes(self) -> DataFrame:
        return G.vote_table(*self.vote_sources)

    @property
    def adjudicated(self) -> DataFrame:
        return G.adjudicate(self.votes, ("gemini", "qwen", "codex"))


def _metrics(t: Tables) -> DataFrame:
    a, b = t.cosine, t.bm25
    hits = a.select(F.lit("embedding").alias("route"), "query_id", "doc_id", "rank").unionByName(b.select(F.lit("bm25").alias("route"), "query_id", "doc_id", "rank"))
    hits = hits.unionByName(V.rrf(a, b, 50).select(F.lit("hybrid").alias("route"), "query_id", "doc_id", "rank"))
    return saved(E.query_metrics(hits, t.gold), "metrics")  # comparisons of groups read it twice


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid retrieval with MRR, NDCG and precision for each route."""
    return E.group_metrics(_metrics(Tables(spark, sf_dir)))


# SQL building blocks ------------------------------------------------------------------------------------------------

_TOK = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
_Q = "q AS (SELECT item_id AS query_id, 'src' || (item_id % 20) AS scope, coalesce(text, '') AS text FROM benchmark)"
_D = "d AS (SELECT doc_id, source AS scope, coalesce(text, '') AS text FROM documents)"
_TERMS = f"""{_Q}, {_D}, dt AS (SELECT scope, doc_id, unnest({_TOK}) AS term FROM d), qt AS (SELECT scope, query_id, unnest({_TOK}) AS term FROM q),
tf AS (SELECT scope, doc_id, term, count(*) AS tf FROM dt GROUP BY ALL),
dl AS (SELECT d.scope, d.doc_id, coalesce(c, 0) AS dl FROM d LEFT JOIN (SELECT doc_id, count(*) AS c FROM dt GROUP BY 1) USING (doc_id)),
st AS (SELECT scope, count(*) AS n, sum(dl) / count(*) AS avgdl FROM dl GROUP BY 1),
df AS (SELECT scope, term, count(*) AS df FROM tf GROUP BY ALL),
i0 AS (SELECT scope, term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM df JOIN st USING (scope)),
idf AS (SELECT scope, term, df, CASE WHEN raw < 0 THEN 0.25 * m ELSE raw END AS idf FROM i0 JOIN (SELECT scope, avg(raw) AS m FROM i0 GROUP BY 1) USING (scope))"""
_BM = f"""{_TERMS}, qf AS (SELECT query_id, scope, term, count(*) AS qtf FROM qt GROUP BY ALL),
sc AS (SELECT query_id, tf.doc_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS s
  FROM qf JOIN idf USING (scope, term) JOIN tf USING (scope, term) JOIN dl USING (doc_id) JOIN st ON st.scope = qf.scope GROUP BY ALL),
bs AS (SELECT query_id, doc_id, round(coalesce(s, 0), 6) AS score FROM q JOIN d USING (scope) LEFT JOIN sc USING (query_id, doc_id)),
bm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bs QUALIFY rank <= 50)"""
_COS = """dd AS (SELECT DISTINCT scope, doc_id, term FROM dt), qd AS (SELECT DISTINCT scope, query_id, term FROM qt),
nd AS (SELECT doc_id, count(*) AS nd FROM dd GROUP BY 1), nq AS (SELECT query_id, count(*) AS nq FROM qd GROUP BY 1),
cm AS (SELECT query_id, doc_id, count(*) AS common FROM qd JOIN dd USING (scope, term) GROUP BY ALL),
cs AS (SELECT query_id, doc_id, round(coalesce(common, 0) / sqrt(greatest(coalesce(nq, 0) * coalesce(nd, 0), 1)::DOUBLE), 6) AS score
  FROM q JOIN d USING (scope) LEFT JOIN cm USING (query_id, doc_id) LEFT JOIN nq USING (query_id) LEFT JOIN nd USING (doc_id)),
co AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM cs QUALIFY rank <= 50)"""


def _rrf(name: str, a: str, b: str, k: int) -> str:
    return f"""{name}0 AS (SELECT query_id, doc_id, a.rank AS ra, b.rank AS rb, round(1.0 / (60 + coalesce(a.rank, 9999)) + 1.0 / (60 + coalesce(b.rank, 9999)), 9) AS score
  FROM (SELECT * FROM {a} WHERE rank <= {k}) a FULL JOIN (SELECT * FROM {b} WHERE rank <= {k}) b USING (query_id, doc_id)),
{name} AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ra IS NULL, coalesce(ra, rb), doc_id) AS rank FROM {name}0 QUALIFY rank <= {k})"""


_ROUTES = f"WITH {_BM}, {_COS}, {_rrf('hy', 'co', 'bm', 50)}, {_rrf('h2', 'co', 'bm', 20)}"
_GOLD = "gold AS (SELECT query_id, doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'evidence' WHEN quality = 1 THEN 'related' ELSE 'irrelevant' END AS label FROM q JOIN d USING (scope) JOIN labels USING (doc_id))"
_METRICS = f"""{_ROUTES}, {_GOLD},
hits AS (SELECT 'embedding' AS route, query_id, doc_id, rank FROM co UNION ALL SELECT 'bm25', query_id, doc_id, rank FROM bm UNION ALL SELECT 'hybrid', query_id, doc_id, rank FROM hy),
j AS (SELECT route, query_id, rank, label IS NULL AS unjudged, CASE label WHEN 'evidence' THEN 2 WHEN 'related' THEN 1 ELSE 0 END AS gain
  FROM hits LEFT JOIN gold USING (query_id, doc_id) WHERE rank <= 10 AND query_id IN (SELECT query_id FROM gold)),
ji AS (SELECT *, row_number() OVER (PARTITION BY route, query_id ORDER BY gain DESC, rank) AS ideal FROM j),
pq AS (SELECT route, query_id, round(coalesce(1 / min(rank) FILTER (gain = 2), 0), 6) AS mrr,
  round(CASE WHEN sum(gain) > 0 THEN sum(gain / log2(rank + 1)) / sum(gain / log2(ideal + 1)) ELSE 0 END, 6) AS ndcg,
  round(count(*) FILTER (gain = 2) / 10, 6) AS precision, count(*) FILTER (unjudged) AS unjudged, count(*) AS n FROM ji GROUP BY ALL),
pg AS (SELECT route, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg, round(avg(precision), 6) AS precision, round(sum(unjudged) / sum(n), 6) AS unjudged_rate, count(*) AS queries FROM pq GROUP BY 1)"""
_DENSE = """v AS (SELECT q.vec_id AS query_id, c.vec_id AS doc_id, q.label = c.label AS own, round(list_sum(list_transform(list_zip(q.embedding, c.embedding), lambda p: p[1]::DOUBLE * p[2])), 6) AS score
  FROM embeddings q, embeddings c WHERE q.vec_id % 50 = 0)"""
_LINES = "l0 AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents), l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM l0)"
_NORM = r"regexp_replace(translate(lower({}), ',，', ''), '\s+', '', 'g')"
_G = "CASE WHEN {0} = 0 THEN '0' WHEN abs({0}) >= 1 THEN format('{{:.6g}}', {0}) ELSE format('{{:.8g}}', {0}) END"
_PRICE = "p_retailprice::DECIMAL(18,2)::VARCHAR || '元'"
_EMAIL = r"(?i)[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}"
_KEYS = f"""keys AS (SELECT query_id, 0 AS pos, 'prom_answer' AS source, trim(substr(text, 1, 24)) AS value FROM q UNION ALL SELECT query_id, 2, 'last', trim(split_part(text, ' ', -1)) FROM q
  UNION ALL SELECT p_partkey - 1, 1, 'price', {_PRICE} FROM part WHERE p_partkey - 1 IN (SELECT query_id FROM q)
  UNION ALL SELECT query_id, CASE WHEN query_id % 4 = 1 THEN -1 ELSE 3 END, '电子信箱', 'nobody@nowhere.example' FROM q WHERE query_id % 2 = 1),
kn AS (SELECT *, regexp_replace(lower(value), '\\s+', '', 'g') AS n0, nullif(regexp_extract(translate(regexp_replace(lower(value), '\\s+', '', 'g'), ',，', ''), '[-+]?[0-9]+(?:\\.[0-9]+)?'), '') AS nt FROM keys),
kh AS (SELECT *, CASE WHEN nt IS NULL THEN NULL WHEN contains(value, '%') THEN '%' WHEN contains(value, '亿') THEN '亿' WHEN contains(value, '万') THEN '万' WHEN contains(value, '元') THEN '元' END AS hint FROM kn),
kv AS (SELECT query_id, pos, source, n0, unnest([n0, nt, {_G.format("nt::DOUBLE")}, {_G.format("(nt::DOUBLE / 1e4)")}, {_G.format("(nt::DOUBLE / 1e8)")}]) AS variant, unnest(range(5)) AS v FROM kn),
nd2 AS (SELECT doc_id, text, {_NORM.format('text')} AS norm FROM d),
mk AS (SELECT query_id, doc_id, pos, any_value(source) AS source, arg_min(variant, v) AS variant, CASE WHEN arg_min(variant, v) = any_value(n0) THEN 1.0 ELSE 0.8 END AS conf
  FROM bm JOIN nd2 USING (doc_id) JOIN kv USING (query_id) WHERE variant <> '' AND contains(norm, variant) GROUP BY ALL),
mf AS (SELECT query_id, doc_id, min(pos) AS fp, arg_min(variant, pos) AS fv, max(conf) AS c, list(source ORDER BY pos) AS srcs FROM mk GROUP BY ALL),
ms AS (SELECT query_id, min(pos) FILTER (source IN ('电子信箱', '公司网址') OR contains(value, '@')) AS mp, arg_min(source, pos) FILTER (source IN ('电子信箱', '公司网址') OR contains(value, '@')) AS msrc, arg_min(hint, pos) FILTER (hint IS NOT NULL) AS hint FROM kh GROUP BY 1),
me AS (SELECT bm.*, text, norm, fp, fv, c, coalesce(srcs, []) AS srcs, hint, msrc, regexp_extract(text, '{_EMAIL}') AS mail, norm <> '' AND mp IS NOT NULL AND regexp_matches(text, '{_EMAIL}') AND (fp IS NULL OR mp < fp) AS by_mail
  FROM bm JOIN nd2 USING (doc_id) JOIN ms USING (query_id) LEFT JOIN mf USING (query_id, doc_id)),
mt AS (SELECT query_id, doc_id, score, rank, text, fp IS NOT NULL OR by_mail AS is_match, CASE WHEN fp IS NOT NULL THEN 'exact' WHEN by_mail THEN 'regex' ELSE 'none' END AS match_type,
  CASE WHEN fp IS NOT NULL THEN c WHEN by_mail THEN 0.7 ELSE 0 END::DOUBLE AS confidence FROM me)"""
_MATCH = f"WITH {_BM}, {_KEYS}"
_EVIDENCE = r"""ev AS (SELECT *, CASE WHEN fp IS NOT NULL AND NOT by_mail THEN list_filter(list_transform(string_split(text, ''), lambda x, i: CASE WHEN regexp_matches(x, '^[\s\x1c-\x1f,，]$') THEN NULL ELSE i END), lambda i: i IS NOT NULL) END AS kept FROM me),
es AS (SELECT *, CASE WHEN by_mail THEN strpos(text, mail) WHEN fp IS NOT NULL THEN kept[strpos(norm, fv)] END AS b, CASE WHEN by_mail THEN strpos(text, mail) + length(mail) - 1 WHEN fp IS NOT NULL THEN kept[strpos(norm, fv) + length(fv) - 1] END AS e FROM ev)"""


def _triplets(match: str = "mt") -> str:
    return f"""ps AS (SELECT query_id, count(*) AS np FROM {match} WHERE confidence >= 0.5 AND is_match GROUP BY 1),
ng AS (SELECT query_id, doc_id, text, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS r FROM {match} WHERE NOT is_match AND text <> ''),
nl AS (SELECT query_id, string_agg(doc_id::VARCHAR, ',' ORDER BY r) AS neg_ids, string_agg(substr(text, 1, 500), '|' ORDER BY r) AS neg_texts, count(*) AS n_neg FROM ng JOIN ps USING (query_id) WHERE r <= 3 * np GROUP BY 1),
tr AS (SELECT query_id, doc_id AS pos_id, substr(text, 1, 500) AS pos_text, rank AS pos_rank, score AS pos_score, confidence, coalesce(neg_ids, '') AS neg_ids, coalesce(neg_texts, '') AS neg_texts, coalesce(n_neg, 0) AS n_neg FROM {match} LEFT JOIN nl USING (query_id) WHERE is_match)"""


_TRI = f"{_MATCH}, {_triplets()}"
_STATS = """tq AS (SELECT query_id, count(*) AS n, min(pos_rank) AS best, max(pos_rank) AS worst, sum(pos_rank) AS ranks, min(n_neg) AS neg FROM tr GROUP BY 1),
ts AS (SELECT coalesce(sum(n), 0)::BIGINT AS triplets, count(*) AS with_positive, coalesce(round(avg(best), 2), 0) AS avg_best_rank, coalesce(round(sum(ranks) / sum(n), 2), 0) AS avg_rank, min(best) AS min_rank, max(worst) AS max_rank, coalesce(sum(neg), 0)::BIGINT AS negatives,
  (SELECT count(*) FROM q) AS queries, round(count(*) / (SELECT count(*) FROM q), 4) AS hit_rate FROM tq)"""
_VOTES = """vv AS (SELECT doc_id % 50 AS query_id, doc_id, CASE WHEN doc_id % 11 = 0 THEN NULL WHEN quality = 1 THEN 'evidence' ELSE 'irrelevant' END AS v1,
  CASE WHEN doc_id % 13 = 0 THEN NULL WHEN toxic = 1 THEN 'irrelevant' WHEN n_chars % 3 = 0 THEN 'related' ELSE 'evidence' END AS v2,
  CASE WHEN doc_id % 17 = 0 OR n_chars % 5 = 0 THEN NULL WHEN n_chars % 2 = 0 THEN 'related' ELSE 'evidence' END AS v3 FROM labels JOIN documents USING (doc_id)),
ad AS (SELECT *, len(list_filter([v1, v2, v3], lambda x: x = 'evidence')) AS e, len(list_filter([v1, v2, v3], lambda x: x = 'related')) AS r, len(list_filter([v1, v2, v3], lambda x: x = 'irrelevant')) AS i FROM vv),
af AS (SELECT *, CASE WHEN e >= 2 THEN 'evidence' WHEN i >= 2 THEN 'irrelevant' WHEN r >= 2 THEN 'related' ELSE coalesce(v1, 'related') END AS final_label,
  CASE WHEN e >= 2 THEN 'majority_evidence' WHEN i >= 2 THEN 'majority_irrelevant' WHEN r >= 2 THEN 'majority_related' WHEN v1 IS NOT NULL THEN 'all_diff_gemini' ELSE 'all_diff_fallback' END AS rule, e = 3 OR r = 3 OR i = 3 AS core FROM ad)"""
_ORDER = "md5({} || ':42')"

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of Tables under its name."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"{_METRICS} SELECT * FROM pg")
def metrics_by_group(t):
    return E.group_metrics(_metrics(t))


@query(f"{_METRICS} SELECT * FROM pq")
def mrr_ndcg_precision(t):
    return _metrics(t)


@query(f"{_METRICS} SELECT round(a.mrr - b.mrr, 6) AS delta_mrr, round(a.ndcg - b.ndcg, 6) AS delta_ndcg, round(a.precision - b.precision, 6) AS delta_precision FROM pg a, pg b WHERE a.route = 'hybrid' AND b.route = 'embedding'")
def group_deltas(t):
    return E.group_deltas(E.group_metrics(_metrics(t)), "hybrid", "embedding")


@query(f"{_METRICS} SELECT query_id, coalesce(a.ndcg, 0) AS ndcg_new, coalesce(b.ndcg, 0) AS ndcg_old, round(coalesce(a.ndcg, 0) - coalesce(b.ndcg, 0), 6) AS delta FROM (SELECT * FROM pq WHERE route = 'hybrid') a FULL JOIN (SELECT * FROM pq WHERE route = 'bm25') b USING (query_id) ORDER BY delta, query_id LIMIT 10")
def degraded_cases(t):
    return E.degraded(_metrics(t), "hybrid", "bm25")


@query(f"WITH {_DENSE} SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM v WHERE own QUALIFY rank <= 50")
def dense_topk_scoped(t):
    return R.top_k(V.dense_scores(*t.vectors), "query_id", 50)


@query(f"WITH {_DENSE} SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM v QUALIFY rank <= 50")
def dense_topk_global(t):
    return V.dense_topk(*t.vectors, 50)


@query(f"WITH {_DENSE} SELECT round(min(score), 6) AS min, round(max(score), 6) AS max, " + ", ".join(f"round(quantile_cont(score, {p / 100}), 6) AS p{p}" for p in (10, 25, 50, 75, 90, 95, 99)) + " FROM v WHERE own")
def dense_score_percentiles(t):
    return E.score_percentiles(V.dense_scores(*t.vectors))


@query(f"WITH {_DENSE} SELECT least(floor(score * 10), 9)::INT AS bin, count(*) AS n FROM v WHERE own AND score BETWEEN 0 AND 1 GROUP BY 1")
def dense_score_histogram(t):
    return E.score_histogram(V.dense_scores(*t.vectors))


@query(f"WITH {_TERMS} SELECT scope, term, df, round(idf, 6) AS idf FROM idf")
def bm25_term_stats(t):
    toks = V.tokenized(t.docs)
    df = saved(V.term_df(toks), "df")  # it is read twice
    return V.idf_of(df, small(saved(V.mean_idf(df, V.scope_stats(toks)), "mean"))).withColumn("idf", F.round("idf", 6))


@query(f"WITH {_BM} SELECT query_id, doc_id, score, rank FROM bm")
def bm25_topk_scoped(t):
    return t.bm25


@query(f"{_ROUTES} SELECT * FROM hy")
def rrf_fuse_top50(t):
    return V.rrf(t.cosine, t.bm25, 50)


@query(f"{_ROUTES} SELECT * FROM h2")
def rrf_fuse_top20(t):
    return V.rrf(t.cosine.where("rank <= 20"), t.bm25.where("rank <= 20"), 20)


@query(_ROUTES + " " + " UNION ALL ".join(f"SELECT '{r}' AS route, {k} AS cut, query_id, doc_id, score, rank FROM {x} WHERE rank <= {k}" for r, k, x in (("embedding", 50, "co"), ("embedding", 20, "co"), ("bm25", 50, "bm"), ("bm25", 20, "bm"), ("hybrid", 50, "hy"), ("hybrid", 20, "h2"))))
def three_way_union(t):
    return V.three_way(t.cosine, t.bm25)


@query(f"WITH {_BM} SELECT q.query_id, coalesce(string_agg(rank || ':' || doc_id, ',' ORDER BY rank), '') AS hits, count(rank) AS n FROM q LEFT JOIN bm USING (query_id) GROUP BY 1")
def nested_hits(t):
    n = V.nested(t.queries, t.bm25)
    return n.select("query_id", F.array_join(F.transform("hits", lambda h: F.concat_ws(":", h["rank"].cast("string"), h["doc_id"].cast("string"))), ",").alias("hits"), F.size("hits").cast("long").alias("n"))


@query(f"WITH {_D}, q AS (SELECT item_id AS query_id, 'src' || (item_id % 23) AS scope FROM benchmark) SELECT query_id FROM q WHERE scope NOT IN (SELECT scope FROM d)")
def nohit_queries(t):
    """Three of 23 scopes have no documents."""
    q = t.queries.withColumn("scope", F.concat(F.lit("src"), (F.col("query_id") % 23).cast("string")))
    return q.join(t.docs.select("scope"), "scope", "left_anti").select("query_id")


@query(f"WITH {_Q}, {_D} SELECT scope, count(*) AS docs FROM d WHERE scope IN (SELECT scope FROM q WHERE query_id % 3 = 0) GROUP BY 1")
def used_document_pruning(t):
    return D.used_documents(t.docs, t.queries.where("query_id % 3 = 0")).groupBy("scope").agg(F.count(F.lit(1)).alias("docs"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0 OR toxic = 1)")
def exclude_documents(t):
    return D.without_documents(t.docs, t.raw("labels").where("quality = 0 or toxic = 1")).select("doc_id")


@query("SELECT page_id, url AS report_paths FROM pages WHERE regexp_replace(split_part(url, '/', -1), '(.)[.][^.]+$', '\\1') IN (SELECT page_id::VARCHAR FROM pages WHERE page_id < 40)")
def within_documents(t):
    """Pages whose url's stem is one of some numbers."""
    stems = t.raw("pages").where("page_id < 40").select(F.col("page_id").cast("string").alias("pdf_stem"))
    return D.within_documents(t.raw("pages").select("page_id", F.col("url").alias("report_paths")), stems).select("page_id", "report_paths")


@query("SELECT item_id AS query_id, trim(text) AS query, item_id || '_0' AS first_answer, 2 AS n_answers FROM benchmark WHERE length(trim(text)) >= 3")
def prepare_queries(t):
    rows = t.raw("benchmark").select(F.col("item_id").cast("string").alias("master_id"), F.col("text").alias("question"), F.array(F.substring("text", 1, 5), F.lit("x")).alias("answers"))
    return D.prepare_queries(rows).select("query_id", "query", F.col("answers")[0]["answer_id"].alias("first_answer"), F.size("answers").alias("n_answers"))


@query("SELECT page_id FROM pages WHERE url IS NOT NULL AND NOT (contains(array_to_string(string_split(url, '/'), '/'), 'blog') OR contains(array_to_string(string_split(url, '/'), '/'), '/fr/'))")
def section_blacklist(t):
    return t.raw("pages").where("url is not null").where(D.not_blacklisted(F.split("url", "/"), ["blog", "/fr/"])).select("page_id")


_KV = ["电子信箱", "法定代表人", "注册地址", "证券代码", "股票代码", "股票简称", "公司网址", "联系电话", "办公地址", "邮政编码", "传真"]
_KV_VALUES = ["event_id || '@x.org'", "event_type", "repeat('long words ', 8)", "NULL", "user_id::VARCHAR", "''", "'  '", "event_type", "'no. ' || user_id", "'100'", "event_type || ' ' || event_id"]


@query(f"""WITH e AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN repeat('without digits ', 9) WHEN 2 THEN '' END AS best, [{", ".join(f"{{'s': '{f}', 'v': trim({v})}}" for f, v in zip(_KV, _KV_VALUES))}] AS kv FROM events)
SELECT event_id, CASE WHEN trim(best) <> '' AND (regexp_matches(best, '[0-9]|@') OR length(trim(best)) <= 64) THEN 'prom_answer=' || trim(best) ELSE array_to_string(list_transform(list_filter(kv, lambda x: x.v <> ''), lambda x: x.s || '=' || x.v), '|') END AS kv FROM e""")
def key_value_extract(t):
    """All answer fields in their order, values of more than 64 signs without digits too; a stable first answer alone."""
    e, n = t.raw("events"), F.col("event_id").cast("string")
    kind, user = F.col("event_type"), F.col("user_id").cast("string")
    values = [F.concat(n, F.lit("@x.org")), kind, F.lit("long words " * 8), F.lit(None).cast("string"), user, F.lit(""), F.lit("  "), kind, F.concat(F.lit("no. "), user), F.lit("100"), F.concat_ws(" ", kind, n)]
    best = F.when(F.col("event_id") % 4 == 0, F.col("props").cast("string")).when(F.col("event_id") % 4 == 1, "without digits " * 9).when(F.col("event_id") % 4 == 2, "")
    prompt = F.map_from_arrays(F.array(*map(F.lit, ["prom_answer", *_KV])), F.array(best, *values))
    return e.select("event_id", F.array_join(F.transform(M.key_values(prompt), lambda x: F.concat_ws("=", x["source"], x["value"])), "|").alias("kv"))


_UNIT = "p_partkey::VARCHAR || ',' || lpad((p_size * 7 % 1000)::VARCHAR, 3, '0') || '.5' || CASE p_partkey % 4 WHEN 0 THEN '亿元' WHEN 1 THEN '万' WHEN 2 THEN '%' ELSE ' units' END"


@query(f"""WITH r AS (SELECT p_partkey, {_UNIT} AS raw FROM part), n AS (SELECT *, regexp_extract(replace(raw, ',', ''), '[0-9]+[.][0-9]+') AS text FROM r)
SELECT p_partkey, raw, text AS number_text, (text::DOUBLE * CASE WHEN contains(raw, '亿') THEN 1e8 WHEN contains(raw, '万') THEN 1e4 ELSE 1 END / CASE WHEN contains(raw, '%') THEN 100 ELSE 1 END) AS value,
CASE p_partkey % 4 WHEN 0 THEN '亿' WHEN 1 THEN '万' WHEN 2 THEN '%' END AS unit FROM n""")
def number_unit_parse(t):
    k = F.col("p_partkey") % 4
    raw = F.concat(F.col("p_partkey").cast("string"), F.lit(","), F.lpad((F.col("p_size") * 7 % 1000).cast("string"), 3, "0"), F.lit(".5"), F.when(k == 0, "亿元").when(k == 1, "万").when(k == 2, "%").otherwise(" units"))
    p = t.raw("part").select("p_partkey", raw.alias("raw"))
    return p.select("p_partkey", "raw", X.number_text(F.col("raw")).alias("number_text"), X.number(F.col("raw")).alias("value"), X.unit(F.col("raw")).alias("unit"))


@query(f"""WITH r AS (SELECT p_partkey, {_PRICE} AS raw, p_retailprice::DECIMAL(18,2)::DOUBLE AS v FROM part)
SELECT p_partkey, array_to_string(list_filter([raw, replace(raw, '元', ''), a, b, c], lambda x, i: list_position([raw, replace(raw, '元', ''), a, b, c], x) = i), '|') AS variants
FROM (SELECT *, {_G.format('v')} AS a, {_G.format('(v / 1e4)')} AS b, {_G.format('(v / 1e8)')} AS c FROM r)""")
def value_variants(t):
    raw = F.concat(F.col("p_retailprice").cast("decimal(18,2)").cast("string"), F.lit("元"))
    return t.raw("part").select("p_partkey", raw.alias("raw")).select("p_partkey", F.array_join(X.variants(F.col("raw")), "|").alias("variants"))


@query(f"{_MATCH} SELECT query_id, doc_id, rank, is_match, match_type, confidence FROM mt")
def answer_match(t):
    return t.matched.select("query_id", "doc_id", "rank", "is_match", "match_type", "confidence")


@query(f"""{_MATCH}, {_EVIDENCE} SELECT query_id, doc_id, is_match, match_type, array_to_string(CASE WHEN by_mail THEN list_concat([msrc], srcs) ELSE srcs END, ',') AS matched_keys, CASE WHEN norm <> '' THEN hint END AS unit_inferred,
CASE WHEN norm = '' THEN '' WHEN NOT is_match THEN substr(text, 1, 200) ELSE substr(text, greatest(b - 120, 1), e + 121 - greatest(b - 120, 1)) || coalesce(' [unit_inferred=' || hint || ']', '') END AS evidence
FROM es JOIN (SELECT query_id, doc_id, is_match, match_type FROM mt) USING (query_id, doc_id)""")
def match_evidence(t):
    """Evidence of every hit: spans are mapped back through each sign's place in the source, mail matches have their context."""
    return t.matched.select("query_id", "doc_id", "is_match", "match_type", F.array_join("matched_keys", ",").alias("matched_keys"), "unit_inferred", "evidence")


_LABEL = f"{_MATCH}, al AS (SELECT *, CASE WHEN is_match THEN 'positive_auto' WHEN score >= 0.4 OR rank <= 5 THEN 'candidate' ELSE 'negative_auto' END AS label FROM mt)"


@query(f"{_LABEL} SELECT query_id, doc_id, label, CASE WHEN is_match THEN confidence ELSE score END AS label_confidence FROM al")
def auto_label(t):
    return M.auto_label(t.matched).select("query_id", "doc_id", "label", "label_confidence")


@query(f"""{_LABEL}, pq AS (SELECT query_id, count(*) FILTER (label = 'positive_auto') AS p, count(*) FILTER (label = 'candidate') AS c, count(*) FILTER (label = 'negative_auto') AS n, count(*) FILTER (text = '') AS b FROM al WHERE query_id % 6 <> 0 GROUP BY 1)
SELECT sum(p)::BIGINT AS positive, sum(c)::BIGINT AS candidate, sum(n)::BIGINT AS negative, (SELECT count(*) FROM q WHERE query_id % 6 = 0) AS missing_answer, sum(b)::BIGINT AS missing_chunk,
round(count(*) FILTER (p > 0) / (SELECT count(*) FROM q), 6) AS match_rate, round(sum(p) / (SELECT count(*) FROM q WHERE query_id % 6 <> 0), 6) AS avg_positive FROM pq""")
def auto_label_stats(t):
    """One query in six has no known answer."""
    return M.label_stats(M.auto_label(t.matched), t.queries.select("query_id", (F.col("query_id") % 6 != 0).alias("answered")))


@query("""WITH g AS (SELECT item_id, CASE WHEN quality IS NULL THEN 'no_master' WHEN toxic = 1 THEN 'not_type1' WHEN quality = 0 THEN 'no_key_values' WHEN item_id % 7 = 0 THEN 'no_hits' ELSE 'kept' END AS reason
  FROM benchmark LEFT JOIN labels ON doc_id = item_id) SELECT reason, count(*) AS n FROM g GROUP BY 1""")
def mining_gates(t):
    g = t.raw("benchmark").select(F.col("item_id").alias("doc_id")).join(t.raw("labels"), "doc_id", "left")
    type_ = M.is_type_one(F.when(F.col("toxic") == 1, "1-2"), F.when(F.col("doc_id") % 2 == 0, " 1 ").otherwise("1"))
    gate = M.mining_gate(F.col("quality").isNotNull(), type_, F.when(F.col("quality") != 0, 2), F.when(F.col("doc_id") % 7 != 0, 50))
    return g.groupBy(gate.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(f"{_TRI} SELECT query_id, pos_id, pos_rank, pos_score, confidence, neg_ids, md5(pos_text) AS pos_md5, md5(neg_texts) AS neg_md5 FROM tr")
def mine_triplets(t):
    digest = lambda c: F.md5(c.cast("binary"))
    return t.triplets.select("query_id", "pos_id", "pos_rank", "pos_score", "confidence", F.array_join("neg_ids", ",").alias("neg_ids"), digest(F.col("pos_text")).alias("pos_md5"), digest(F.array_join("neg_texts", "|")).alias("neg_md5"))


@query(f"{_TRI}, {_STATS} SELECT *, hit_rate >= 0.5 AND triplets >= 180 AS accepted FROM ts")
def mining_stats(t):
    return M.acceptance(M.mining_stats(t.triplets, t.queries))


@query(f"""{_MATCH}, mx AS (SELECT query_id, doc_id, rank, score, confidence, CASE WHEN doc_id % 9 = 0 THEN '' ELSE text END AS text, is_match AND doc_id % 9 <> 0 AS is_match FROM mt), {_triplets("mx")}, {_STATS}
SELECT *, (SELECT count(*) FROM mx WHERE text = '') AS missing_text, hit_rate >= 0.5 AND triplets >= 180 AND avg_best_rank > 0 AND avg_best_rank <= 10 AS accepted FROM ts""")
def mining_missing_text(t):
    """Hits without a text are neither positives nor negatives; the strict acceptance."""
    m = t.part_matched
    return M.acceptance(M.mining_stats(M.mine(m), t.queries, m), best_rank=10)


_REASON = f"{_TRI}, fr AS (SELECT *, CASE WHEN query_id % 7 = 0 THEN 'blacklist' WHEN confidence < 0.9 THEN 'confidence' ELSE 'kept' END AS reason FROM tr)"


def _filtered(t):
    return T.filter_reasons(t.triplets, t.queries.where("query_id % 7 = 0"), 0.9)


@query(f"{_REASON} SELECT reason, count(*) AS n, count(DISTINCT query_id) AS queries FROM fr GROUP BY 1")
def train_filter_reasons(t):
    return _filtered(t).groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("query_id").alias("queries"))


@query(f"""{_REASON}, ids AS (SELECT query_id, row_number() OVER (ORDER BY {_ORDER.format('query_id')}, query_id) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT query_id FROM fr WHERE reason = 'kept'))
SELECT query_id, pos_id, CASE WHEN r <= floor(n * 0.9) THEN 'train' ELSE 'dev' END AS split FROM fr JOIN ids USING (query_id) WHERE reason = 'kept'""")
def group_split(t):
    kept = saved(_filtered(t).where("reason = 'kept'").select("query_id", "pos_id"), "kept")  # it is read three times
    return T.group_split(kept).select("query_id", "pos_id", "split")


@query("""WITH c AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1), s AS (SELECT list(n ORDER BY n) AS v, min(n) AS mi, max(n) AS ma, avg(n) AS av, median(n) AS me, count(*) AS k FROM c)
SELECT mi AS min, ma AS max, round(av, 6) AS avg, me::DOUBLE AS median, v[floor(0.75 * (k - 1))::INT + 1] AS p75, v[floor(0.95 * (k - 1))::INT + 1] AS p95 FROM s""")
def neg_count_profile(t):
    return T.negatives_profile(t.raw("conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_neg")))


_SAMPLE = f"{_Q}, s AS (SELECT query_id, row_number() OVER (ORDER BY {_ORDER.format('query_id')}, query_id) AS r FROM q)"


@query(f"WITH {_SAMPLE} SELECT query_id FROM s WHERE r <= 20")
def gold_sample(t):
    return G.sample(t.queries, 20)


@query(f"""WITH {_SAMPLE}, cur AS (SELECT query_id FROM s WHERE r <= 20), k AS (SELECT * FROM cur WHERE query_id % 5 <> 0),
f AS (SELECT query_id, row_number() OVER (ORDER BY r) AS rr FROM s WHERE query_id NOT IN (SELECT * FROM cur) AND query_id % 11 <> 3)
SELECT query_id, 'kept' AS origin FROM k UNION ALL SELECT query_id, 'added' FROM f WHERE rr <= 20 - (SELECT count(*) FROM k)""")
def gold_resample(t):
    return G.resample(t.queries, G.sample(t.queries, 20), t.queries.where("query_id % 5 = 0"), t.queries.where("query_id % 11 = 3"), 20)


@query(f"""WITH {_SAMPLE}, cur AS (SELECT query_id FROM s WHERE r <= 20), k AS (SELECT * FROM cur WHERE query_id % 5 <> 0), f AS (SELECT query_id, row_number() OVER (ORDER BY r) AS rr FROM s WHERE query_id NOT IN (SELECT * FROM cur) AND query_id % 11 <> 3),
a AS (SELECT query_id FROM f WHERE rr <= 20 - (SELECT count(*) FROM k)), j AS (SELECT string_agg(query_id::VARCHAR, ',' ORDER BY query_id) AS kept FROM k)
SELECT kept, (SELECT string_agg(query_id::VARCHAR, ',' ORDER BY query_id) FROM cur WHERE query_id % 5 = 0) AS dropped, (SELECT string_agg(query_id::VARCHAR, ',' ORDER BY query_id) FROM a) AS sampled, (SELECT count(*) FROM q WHERE query_id % 11 = 3) AS excluded, 20 AS size FROM j""")
def gold_change_report(t):
    before, gone = G.sample(t.queries, 20), t.queries.where("query_id % 11 = 3")
    r = G.change_report(before, G.resample(t.queries, before, t.queries.where("query_id % 5 = 0"), gone, 20), gone)
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return r.select(text("kept_qids").alias("kept"), text("dropped_qids").alias("dropped"), text("sampled_qids").alias("sampled"), F.size("excluded_qids").cast("long").alias("excluded"), "size")


@query(f"WITH {_SAMPLE}, f AS (SELECT query_id, row_number() OVER (ORDER BY r) AS rr FROM s WHERE r > 20 AND query_id % 5 <> 0) SELECT query_id FROM f WHERE rr <= 8")
def gold_additions(t):
    return G.additions(t.queries, [G.sample(t.queries, 20), t.queries.where("query_id % 5 = 0")], 8)


@query(f"WITH {_BM} SELECT query_id, doc_id, rank, length(text) AS chars, CASE WHEN trim(text) = '' THEN 'irrelevant' END AS label, CASE WHEN trim(text) = '' THEN 'empty_text' ELSE '' END AS notes FROM bm JOIN d USING (doc_id) WHERE rank <= 20")
def gold_template(t):
    return G.template(t.bm25, t.docs).select("query_id", "doc_id", "rank", F.length("text").alias("chars"), "label", "notes")


@query("SELECT item_id AS query_id FROM benchmark UNION SELECT conv_id FROM conversations WHERE conv_id IS NOT NULL")
def blacklist_merge(t):
    return G.merged_ids(t.queries, t.raw("conversations").select(F.col("conv_id").alias("query_id")))


@query(f"WITH {_VOTES} SELECT doc_id, v1, v2, v3 FROM vv")
def canonical_label(t):
    return t.votes.select("doc_id", *(X.canonical_label(F.col(c)).alias(n) for c, n in (("gemini", "v1"), ("qwen", "v2"), ("codex", "v3"))))


@query(f"WITH {_VOTES} SELECT query_id, doc_id, final_label, rule, core, CASE WHEN v1 = final_label THEN 'seen' ELSE '' END AS notes FROM af")
def adjudicate_votes(t):
    """Three sources' labels joined to the candidates, then decided."""
    return t.adjudicated.select("query_id", "doc_id", "final_label", "rule", "core", "notes")


def _records(t, core: bool) -> DataFrame:
    c = G.gold_records(t.adjudicated, core)
    return c.select("query_id", F.array_join(F.transform("candidates", lambda x: F.concat_ws(":", x["doc_id"].cast("string"), x["label"], x["notes"])), ",").alias("candidates"))


_RECORD = "doc_id || ':' || final_label || ':' || CASE WHEN v1 = final_label THEN 'seen' ELSE '' END"


@query(f"WITH {_VOTES} SELECT query_id, string_agg({_RECORD}, ',' ORDER BY doc_id) AS candidates FROM af GROUP BY 1")
def gold_extended(t):
    return _records(t, False)


@query(f"WITH {_VOTES} SELECT query_id, coalesce(string_agg({_RECORD}, ',' ORDER BY doc_id) FILTER (core), '') AS candidates FROM af GROUP BY 1")
def gold_core(t):
    """Unanimous candidates only; queries without any keep an empty list."""
    return _records(t, True)


@query(f"WITH {_VOTES} SELECT query_id, doc_id, rule AS adjudication_rule, concat_ws('/', coalesce(v1, '-'), coalesce(v2, '-'), coalesce(v3, '-')) AS raw_votes FROM af")
def adjudication_rows(t):
    votes = F.concat_ws("/", *(F.coalesce(F.col(f"raw_votes.{x}"), F.lit("-")) for x in ("gemini", "qwen", "codex")))
    return G.adjudication_rows(t.adjudicated.withColumn("rank", F.col("doc_id"))).select("query_id", "doc_id", "adjudication_rule", votes.alias("raw_votes"))


@query(f"WITH {_VOTES} SELECT final_label, rule, count(*) AS n, count(*) FILTER (core) AS core FROM af GROUP BY ALL")
def core_unanimous(t):
    return t.adjudicated.groupBy("final_label", "rule").agg(F.count(F.lit(1)).alias("n"), F.count_if("core").alias("core"))


@query(f"""{_ROUTES} SELECT query_id, count(*) FILTER (b.doc_id IS NULL) AS missing, count(*) FILTER (a.doc_id IS NULL) AS extra, coalesce(string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) FILTER (b.doc_id IS NULL), '') AS missing_ids,
coalesce(string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) FILTER (a.doc_id IS NULL), '') AS extra_ids FROM bm a FULL JOIN co b USING (query_id, doc_id) GROUP BY 1""")
def alignment_missing_extra(t):
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return G.alignment(t.bm25, t.cosine).select("query_id", "missing", "extra", text("missing_ids"), text("extra_ids"))


@query(f"WITH {_VOTES} SELECT annotator, label, count(*) AS votes, count(DISTINCT query_id) AS queries FROM (SELECT query_id, unnest(['gemini', 'qwen', 'codex']) AS annotator, unnest([coalesce(v1, 'missing'), coalesce(v2, 'missing'), coalesce(v3, 'missing')]) AS label FROM vv) GROUP BY ALL")
def vote_distribution(t):
    return G.vote_distribution(t.votes, ("gemini", "qwen", "codex"))


@query(f"WITH {_VOTES} SELECT query_id, doc_id, annotator FROM (SELECT query_id, doc_id, unnest(['gemini', 'qwen', 'codex']) AS annotator, unnest([v1, v2, v3]) AS label FROM vv) WHERE label IS NULL")
def missing_votes(t):
    return G.missing_votes(t.votes, ("gemini", "qwen", "codex"))


@query(f"WITH {_VOTES} SELECT doc_id AS query_id, coalesce(v1 IN ('evidence', 'related'), false) OR coalesce(v2 IN ('evidence', 'related'), false) OR coalesce(v3 IN ('evidence', 'related'), false) AS has_positive FROM vv")
def any_positive(t):
    """Each labelled document for itself."""
    return G.any_positive(t.votes.withColumn("query_id", F.col("doc_id")), ("gemini", "qwen", "codex"))


@query(f"WITH {_VOTES} SELECT doc_id % 301 AS query_id FROM af GROUP BY 1 HAVING count(*) FILTER (final_label IN ('evidence', 'related')) = 0")
def no_positive_queries(t):
    """Candidates dealt over 301 queries."""
    return G.without_positive(t.adjudicated.select((F.col("doc_id") % 301).alias("query_id"), F.col("final_label").alias("label")))


@query(f"WITH {_BM} SELECT query_id, doc_id, CASE WHEN rank % 3 = 0 THEN rank || 'l' END AS label FROM bm")
def resume_labels(t):
    c = t.bm25.select("query_id", F.col("doc_id").cast("string").alias("chunk"), "rank", F.col("rank").alias("idx"), F.lit(None).cast("string").alias("label"))
    done = c.where("rank % 3 = 0").withColumn("label", F.concat(F.col("rank").cast("string"), F.lit("l")))
    return G.resume(c, done).select("query_id", F.col("chunk").cast("long").alias("doc_id"), "label")


@query("""WITH s AS (SELECT source AS pdf_path, count(*) AS qa_count, CASE WHEN source LIKE '%1' THEN NULL ELSE min(doc_id) END AS c FROM documents GROUP BY 1),
o AS (SELECT *, row_number() OVER w AS position, coalesce(sum(qa_count) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM s WINDOW w AS (ORDER BY qa_count DESC, c NULLS LAST, pdf_path))
SELECT pdf_path, qa_count, position, coalesce(c, position) AS qa_count_cumulative FROM o WHERE position <= 12 AND b < (SELECT count(*) / 2 FROM documents)""")
def select_documents_prefix(t):
    return D.select_documents(_summary(t), -(-t.docs.count() // 2), 12)[0]


@query("""WITH s AS (SELECT source AS pdf_path, count(*) AS qa_count, CASE WHEN source LIKE '%1' THEN NULL ELSE min(doc_id) END AS c FROM documents GROUP BY 1),
o AS (SELECT *, row_number() OVER (ORDER BY c NULLS LAST, pdf_path) AS position FROM s) SELECT count(*) AS total_pdfs, sum(qa_count)::BIGINT AS total_qa FROM o WHERE position <= 7""")
def select_documents_totals(t):
    """By the cumulative count alone, without a target."""
    return D.select_documents(_summary(t), None, 7, many_first=False)[1]


def _summary(t) -> DataFrame:
    per = t.docs.groupBy(F.col("scope").alias("pdf_path")).agg(F.count(F.lit(1)).alias("qa_count"), F.min("doc_id").alias("c"))
    return per.select("pdf_path", "qa_count", F.when(~F.col("pdf_path").endswith("1"), F.col("c")).alias("qa_count_cumulative"))


_GAPS = f"WITH {_LINES}, p AS (SELECT DISTINCT doc_id, pos FROM l WHERE length(line) % 3 <> 0), g0 AS (SELECT doc_id, pos, lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS prev FROM p), g AS (SELECT doc_id, prev + 1 AS gap_start, pos - 1 AS gap_end FROM g0 WHERE pos - prev > 1)"


def _gaps(t) -> DataFrame:
    return D.page_gaps(t.lines.where("length(line) % 3 <> 0").select("doc_id", F.col("pos").alias("page")))


@query(f"{_GAPS} SELECT * FROM g")
def page_gaps(t):
    """Every line whose length is a multiple of three is a page that isn't there."""
    return _gaps(t)


@query(f"{_GAPS}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY gap_start) AS r, count(*) OVER (PARTITION BY doc_id) AS n FROM g) SELECT doc_id, string_agg('[' || gap_start || ', ' || gap_end || ']', ';' ORDER BY r) || CASE WHEN any_value(n) > 10 THEN ';...共' || any_value(n) || '段缺口' ELSE '' END AS preview FROM r WHERE r <= 10 GROUP BY 1")
def page_gap_preview(t):
    return D.gap_preview(_gaps(t)).select("doc_id", F.array_join("preview", ";").alias("preview"))


_QUALITY = f"""WITH {_LINES}, c AS (SELECT doc_id, pos, pos // 5 AS parent, line FROM l), a AS (SELECT doc_id, count(*) AS chunks, count(DISTINCT CASE WHEN line <> '' THEN pos END) AS seen, max(pos) + 1 AS pages, count(*) FILTER (length(line) > 40) AS sec, count(*) FILTER (parent % 9 = 8) AS orphans FROM c GROUP BY 1),
r AS (SELECT doc_id, chunks, CASE WHEN doc_id % 10 <> 0 THEN round(seen / pages, 3) END AS page_coverage, sec / chunks AS section_ratio, orphans FROM a)"""
_REASONS = "concat_ws(',', CASE WHEN page_coverage < 0.98 THEN 'page_cov' END, CASE WHEN section_ratio < 0.75 THEN 'section_path_ratio' END, CASE WHEN orphans > 0 THEN 'orphan_children' END)"


def _quality(t) -> DataFrame:
    """One document in ten has no page count."""
    c = t.lines.select("doc_id", F.col("pos").alias("chunk_id"), F.col("parent").alias("parent_id"), F.when(F.col("line") != "", F.col("pos")).alias("page"), F.when(F.length("line") > 40, "s").otherwise("").alias("section"))
    pages = t.lines.groupBy("doc_id").agg(F.when(F.col("doc_id") % 10 != 0, F.max("pos") + 1).alias("pages"))
    parents = t.lines.where("parent % 9 <> 8").select("doc_id", F.col("parent").alias("parent_id")).distinct().join(pages, "doc_id")
    return D.chunk_quality(c, parents)


_kinds = lambda c: F.array_join(F.transform(c, lambda r: F.substring_index(r, " ", 1)), ",").alias("reasons")


@query(f"{_QUALITY} SELECT doc_id, chunks, page_coverage, round(section_ratio, 6) AS section_ratio, orphans, {_REASONS} AS reasons FROM r")
def chunk_quality(t):
    return _quality(t).select("doc_id", "chunks", "page_coverage", F.round("section_ratio", 6).alias("section_ratio"), "orphans", _kinds("reasons"))


@query(f"{_QUALITY} SELECT doc_id::VARCHAR AS pdf_stem, {_REASONS} AS reasons FROM r WHERE {_REASONS} <> ''")
def problem_documents(t):
    return D.problem_list(_quality(t)).select("pdf_stem", _kinds("reasons"))


@query(f"""WITH {_LINES}, v AS (SELECT doc_id, list(length(line) ORDER BY length(line)) AS v, count(*) AS n FROM l GROUP BY 1), j AS (SELECT *, least(greatest((n + 1) * 9 // 10, 1), greatest(n - 1, 1))::INT AS j FROM v)
SELECT doc_id, n, v[1] AS min, floor((v[(n - 1) // 2 + 1] + v[n // 2 + 1]) / 2)::BIGINT AS median, floor(CASE WHEN n < 2 THEN v[1] ELSE (v[j] * (10 - ((n + 1) * 9 - 10 * j)) + v[j + 1] * ((n + 1) * 9 - 10 * j)) / 10 END)::BIGINT AS p90, v[n] AS max FROM j""")
def chunk_length_stats(t):
    return D.length_stats(t.lines.select("doc_id", F.length("line").alias("length")))


@query(f"WITH {_LINES} SELECT doc_id, pos // 5 AS parent_id, count(*) AS children, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS child_ids FROM l GROUP BY ALL")
def parent_children(t):
    return D.children_of(t.lines.select("doc_id", F.col("parent").alias("parent_id"), F.col("pos").alias("chunk_id"))).withColumn("child_ids", F.array_join(F.transform("child_ids", lambda x: x.cast("string")), ","))


@query(f"WITH {_LINES} SELECT c.doc_id, c.pos AS chunk_id, c.pos // 5 AS parent_id, length(p.line) AS parent_length FROM l c LEFT JOIN l p ON p.doc_id = c.doc_id AND p.pos = c.pos // 5")
def child_parent(t):
    """The line with a fifth of a line's number stands for its parent."""
    c = t.lines.select("doc_id", F.col("pos").alias("chunk_id"), F.col("parent").alias("parent_id"), F.length("line").alias("length"))
    return D.parent_of(c).select("doc_id", "chunk_id", "parent_id", "parent_length")


@query("""SELECT page_id, a AS alias FROM (SELECT page_id, unnest(list_distinct([url, split_part(url, '/', -1), 'f' || page_id || '_chunks.json', 'f' || page_id])) AS a FROM pages) WHERE a <> ''""")
def document_aliases(t):
    p = t.raw("pages").select("page_id", D.key_aliases(F.col("url"), F.concat(F.lit("out/f"), F.col("page_id").cast("string"), F.lit("_chunks.json"))).alias("a"))
    return p.select("page_id", F.explode("a").alias("alias"))


@query("SELECT 'x/f' || page_id AS name, max(page_id) AS page_id FROM pages WHERE page_id % 3 = 0 GROUP BY 1")
def documents_by_alias(t):
    """A whole path's base name is one of a document's names."""
    files = t.raw("pages").select("page_id", F.col("url").alias("source"), F.concat(F.lit("out/f"), F.col("page_id").cast("string"), F.lit("_chunks.json")).alias("file"))
    wanted = files.where("page_id % 3 = 0").select(F.concat(F.lit("x/f"), F.col("page_id").cast("string")).alias("name"))
    return D.by_alias(wanted, files).select("name", "page_id")


_HASH = f"{_LINES}, h AS (SELECT doc_id, count(*) AS chunks, sha1(string_agg(pos || '::' || line, '' ORDER BY pos::VARCHAR)) AS content_hash FROM l GROUP BY 1)"


@query(f"WITH {_HASH} SELECT * FROM h")
def content_hash(t):
    return D.content_hash(t.lines.select("doc_id", F.col("pos").alias("chunk_id"), F.col("line").alias("text")))


@query("SELECT CASE WHEN doc_id % 3 = 0 THEN 'miss' WHEN doc_id % 3 = 1 THEN 'stale' ELSE 'hit' END AS status, count(*) AS n FROM documents GROUP BY 1")
def cache_status(t):
    now = content_hash(t)
    old = now.where("doc_id % 3 <> 0").withColumn("content_hash", F.when(F.col("doc_id") % 3 == 1, F.lit("x")).otherwise(F.col("content_hash")))
    return I.cache_status(now, old).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH r AS (SELECT doc_id, source, lang, text, CASE WHEN trim(coalesce(text, '')) = '' THEN 'empty' WHEN lower(trim(text)) IN ('n/a', 'none') THEN 'placeholder' ELSE 'kept' END AS reason FROM documents),
k AS (SELECT *, row_number() OVER (PARTITION BY text, lang ORDER BY doc_id) AS r FROM r WHERE reason = 'kept') SELECT reason, count(*) AS n FROM (SELECT reason FROM r WHERE reason <> 'kept' UNION ALL SELECT CASE WHEN r = 1 THEN 'kept' ELSE 'duplicate' END FROM k) GROUP BY 1""")
def clean_dedup(t):
    r = t.raw("documents").withColumn("reason", D.clean_reasons(None, ["n/a", "none"]))
    kept = D.deduplicated(r.where("reason = 'kept'").select("doc_id", "text", "lang"), [F.col("text"), F.col("lang")], "doc_id")
    return r.where("reason <> 'kept'").select("reason").unionByName(kept.select("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH c AS (SELECT source, count(DISTINCT lang) AS nl, count(DISTINCT n_chars % 3) AS ny FROM documents GROUP BY 1 UNION ALL SELECT doc_id::VARCHAR, count(DISTINCT lang), count(DISTINCT CASE WHEN n_chars % 7 > 0 THEN n_chars % 3 END) FROM documents GROUP BY 1),
x AS (SELECT CASE WHEN nl < 1 OR ny < 1 THEN 'generic' ELSE CASE WHEN nl = 1 THEN '1co' ELSE 'multi_co' END || '_' || CASE WHEN ny = 1 THEN '1yr' ELSE 'multi_yr' END END AS class FROM c)
SELECT class, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 2) AS percent FROM x GROUP BY 1""")
def cross_dimension(t):
    d = t.raw("documents").select("doc_id", "source", "lang", (F.col("n_chars") % 3).alias("y"), F.when(F.col("n_chars") % 7 > 0, F.col("n_chars") % 3).alias("z"))
    sets = lambda key, y: d.groupBy(key).agg(F.collect_set("lang").alias("a"), F.collect_set(y).alias("b")).select("a", "b")
    return D.shares(sets("source", "y").unionByName(sets("doc_id", "z")).select(D.cross_dimension(F.col("a"), F.col("b")).alias("class")), "class")


@query("SELECT 'documents' AS origin, lang AS type, count(*) AS n FROM documents GROUP BY 2 UNION ALL SELECT 'conversations', role, count(*) FROM conversations GROUP BY 2")
def type_distribution(t):
    both = D.source_union({"documents": t.raw("documents").select("doc_id", F.col("lang").alias("type")), "conversations": t.raw("conversations").select("conv_id", F.col("role").alias("type"))})
    return both.groupBy("origin", "type").agg(F.count(F.lit(1)).alias("n"))


@query("WITH h AS (SELECT lang, ('0x' || substr(md5(doc_id::VARCHAR), 1, 12))::BIGINT AS h FROM documents WHERE n_chars > 1000) SELECT lang, count(*) AS n, sum(h)::VARCHAR AS ids_sum, bit_xor(h) AS ids_xor FROM h GROUP BY 1")
def subset_index(t):
    return D.subset_index(t.raw("documents").where("n_chars > 1000"), "lang")


@query(f"""WITH {_BM}, g AS (SELECT query_id, rank, score, max(score) OVER (PARTITION BY query_id) AS m FROM bm), s AS (SELECT query_id, sum(exp(score - m)) AS z, max(m) AS m, max(score) FILTER (rank = 1) AS p FROM g GROUP BY 1)
SELECT count(*) AS groups, round(avg(ln(z) + m - p), 6) AS loss FROM s""")
def listwise_loss(t):
    return E.listwise_loss(t.bm25, F.col("rank") == 1)


@query(f"""{_ROUTES} SELECT query_id, doc_id, b.rank, row_number() OVER (PARTITION BY query_id ORDER BY a.score DESC, b.rank, doc_id) AS rerank_rank FROM bm b JOIN cs a USING (query_id, doc_id)""")
def rerank_topk(t):
    scores = V.term_cosine_of(t.bm25, t.queries, t.asked).withColumnRenamed("score", "rerank_score")
    return E.rerank(t.bm25, scores).select("query_id", "doc_id", "rank", "rerank_rank")


_REPLY = "'```json' || chr(10) || '{\"items\": [{\"index\": \"' || item_id || '\", \"label\": \"Evid.\", \"notes\": \"n' || item_id || '\"}, {\"index\": ' || item_id % 7 || ', \"label\": \" RELATED \"}, {\"index\": \"x\", \"label\": \"rel\"}, {\"index\": 3, \"label\": \"none\"}]}' || chr(10) || '```'"


@query(f"""WITH r AS (SELECT item_id, regexp_extract({_REPLY}, '(?s)[{{].*[}}]')::JSON AS j FROM benchmark), i AS (SELECT item_id, unnest(json_extract(j, '$.items[*]')) AS x FROM r),
n AS (SELECT item_id, try_cast(x->>'index' AS INT) AS index, lower(trim(x->>'label')) AS l, coalesce(x->>'notes', '') AS notes FROM i)
SELECT item_id, index, CASE WHEN starts_with(l, 'evid') THEN 'evidence' WHEN starts_with(l, 'rel') THEN 'related' WHEN starts_with(l, 'irr') THEN 'irrelevant' END AS label, notes FROM n WHERE index IS NOT NULL AND (starts_with(l, 'evid') OR starts_with(l, 'rel') OR starts_with(l, 'irr'))""")
def llm_json_repair(t):
    n = F.col("item_id").cast("string")
    raw = F.concat(F.lit('```json\n{"items": [{"index": "'), n, F.lit('", "label": "Evid.", "notes": "n'), n, F.lit('"}, {"index": '), (F.col("item_id") % 7).cast("string"), F.lit(', "label": " RELATED "}, {"index": "x", "label": "rel"}, {"index": 3, "label": "none"}]}\n```'))
    return t.raw("benchmark").select("item_id", F.explode(X.label_items(X.repaired_json(raw))).alias("i")).select("item_id", "i.*")


_CJK = "'年度报告2020 ' || coalesce(text, '') || '净利润为' || n_chars || '元，同比' || lang || '增'"


@query(f"""WITH x AS (SELECT doc_id, lower({_CJK}) AS s FROM documents), h AS (SELECT doc_id, len(regexp_extract_all(s, '\\p{{Han}}')) AS han, len(regexp_extract_all(s, '\\p{{Han}}+')) AS runs, len(regexp_extract_all(regexp_replace(s, '\\p{{Han}}', ' ', 'g'), '[\\p{{L}}\\p{{N}}]+')) AS words FROM x)
SELECT doc_id, words + 2 * han - runs AS tokens FROM h""")
def tokenize_cjk(t):
    """Ideographs, their pairs, and runs of other letters and numbers, before, in and behind a text."""
    s = F.concat(F.lit("年度报告2020 "), F.coalesce("text", F.lit("")), F.lit("净利润为"), F.col("n_chars").cast("string"), F.lit("元，同比"), "lang", F.lit("增"))
    return t.raw("documents").select("doc_id", F.size(X.cjk_tokens(s)).alias("tokens"))


@query(r"SELECT doc_id, md5(regexp_replace(lower(coalesce(text, '')), '\s+', '', 'g')) AS m, md5(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))) AS b FROM documents")
def nfkc_normalise(t):
    return t.raw("documents").select("doc_id", F.md5(X.for_match(F.col("text")).cast("binary")).alias("m"), F.md5(X.for_bm25(F.col("text")).cast("binary")).alias("b"))


@query(f"""{_ROUTES}, g0 AS (SELECT query_id, doc_id, CASE WHEN doc_id % 4 = 0 THEN '' WHEN doc_id % 4 = 1 THEN 'gold ' || doc_id END AS g FROM co), x AS (SELECT query_id, doc_id, coalesce(nullif(g, ''), CASE WHEN doc_id % 5 <> 0 THEN text END, '') AS text FROM bm LEFT JOIN g0 USING (query_id, doc_id) JOIN d USING (doc_id))
SELECT query_id, doc_id, md5(text) AS m FROM x""")
def candidate_texts(t):
    """Texts of the gold set, else of the chunks, of which every fifth is missing."""
    return _candidates(t).select("query_id", "doc_id", F.md5(F.col("text").cast("binary")).alias("m"))


@query(f"""{_ROUTES}, g0 AS (SELECT query_id, doc_id, CASE WHEN doc_id % 4 = 0 THEN '' WHEN doc_id % 4 = 1 THEN 'gold ' || doc_id END AS g FROM co), x AS (SELECT coalesce(nullif(g, ''), CASE WHEN doc_id % 5 <> 0 THEN text END, '') AS text FROM bm LEFT JOIN g0 USING (query_id, doc_id) JOIN d USING (doc_id))
SELECT count(*) FILTER (text = '') AS missing_text_count, count(*) AS total_candidates, round(count(*) FILTER (text = '') / count(*), 6) AS missing_text_rate FROM x""")
def missing_text_rate(t):
    return E.missing_text(_candidates(t))


def _candidates(t) -> DataFrame:
    g = t.cosine.select("query_id", "doc_id", F.when(F.col("doc_id") % 4 == 0, "").when(F.col("doc_id") % 4 == 1, F.concat(F.lit("gold "), F.col("doc_id").cast("string"))).alias("text"))
    return E.candidate_texts(t.bm25.select("query_id", "doc_id"), g, t.docs.where("doc_id % 5 <> 0"))


@query(f"""{_METRICS}, p4 AS (SELECT * FROM pq UNION ALL SELECT 'reranked', query_id, mrr, ndcg, precision, unjudged, n FROM pq WHERE route = 'bm25' AND query_id % 3 = 0)
SELECT q.query_id, {", ".join(f"max({m}) FILTER (route = '{r}') AS {r}_{m}" for r in ("embedding", "bm25", "hybrid", "reranked") for m in ("mrr", "ndcg", "precision"))} FROM q LEFT JOIN p4 USING (query_id) GROUP BY 1""")
def per_query_scores(t):
    """Four groups side by side; the fourth has results for a third of the queries."""
    p = _metrics(t)
    fourth = p.where("route = 'bm25' and query_id % 3 = 0").withColumn("route", F.lit("reranked"))
    return E.compared(t.queries, p.unionByName(fourth), ["embedding", "bm25", "hybrid", "reranked"])


@query(f"{_ROUTES} SELECT 'bm25' AS route, query_id, doc_id AS top1 FROM bm WHERE rank = 1 UNION ALL SELECT 'embedding', query_id, doc_id FROM co WHERE rank = 1")
def top_hits(t):
    hits = t.bm25.withColumn("route", F.lit("bm25")).unionByName(t.cosine.withColumn("route", F.lit("embedding")))
    return E.top_hit(hits)


@query(f"""{_TRI}, s AS (SELECT *, CASE WHEN query_id % 5 = 0 THEN 'dev' ELSE 'train' END AS split FROM tr)
SELECT count(*) FILTER (split = 'train') AS train_samples, count(DISTINCT query_id) FILTER (split = 'train') AS train_query_ids, count(*) FILTER (split = 'dev') AS dev_samples, count(DISTINCT query_id) FILTER (split = 'dev') AS dev_query_ids,
(SELECT count(*) FROM q WHERE query_id % 7 = 0) AS blacklist_count, 'test' AS blacklist_source FROM s""")
def training_manifest(t):
    s = saved(t.triplets.select("query_id", "pos_id"), "triplets")
    return U.manifest(s.where("query_id % 5 <> 0"), s.where("query_id % 5 = 0"), t.queries.where("query_id % 7 = 0"), {"blacklist_source": "test"}).drop("created_at")


# sources and sinks: what is written into the shared folder is read back -------------------------------------------------------


@query(f"WITH {_BM} SELECT q.query_id, q.scope, coalesce(string_agg(doc_id::VARCHAR, ',' ORDER BY rank), '') AS ids FROM q LEFT JOIN (SELECT * FROM bm WHERE query_id % 4 <> 0) USING (query_id) GROUP BY ALL")
def nested_round_trip(t):
    """Nested hits as JSON lines; a quarter of the queries has none."""
    path = shared_path(t.spark, "nested")
    writers.nested_hits(t.queries.select("query_id", "scope"), t.bm25.where("query_id % 4 <> 0"), path)
    back = readers.jsonl(t.spark, path, "query_id bigint, scope string, hits array<struct<rank int, doc_id bigint, score double>>")
    return back.select("query_id", "scope", F.array_join(F.transform("hits", lambda h: h["doc_id"].cast("string")), ",").alias("ids"))


@query(f"WITH {_BM} SELECT query_id, doc_id, rank, score, 'p' || doc_id AS source_pdf FROM bm WHERE query_id % 4 <> 0")
def flat_round_trip(t):
    path = shared_path(t.spark, "flat")
    hits = t.bm25.where("query_id % 4 <> 0").withColumn("pdf", F.concat(F.lit("p"), F.col("doc_id").cast("string")))
    writers.flat_hits(t.queries.select("query_id", F.array(F.col("text")).alias("answers")), hits, path)
    return readers.jsonl(t.spark, path, "query_id bigint, doc_id bigint, rank int, score double, source_pdf string")


@query("SELECT item_id AS query_id FROM benchmark WHERE item_id % 4 = 0")
def nohits_round_trip(t):
    path = shared_path(t.spark, "nohits")
    writers.no_hits(t.queries, t.bm25.where("query_id % 4 <> 0"), path)
    return readers.jsonl(t.spark, path, "query_id bigint")


@query("SELECT DISTINCT item_id::VARCHAR AS query_id, (SELECT count(DISTINCT item_id) FROM benchmark) AS count, 'test' AS source FROM benchmark")
def id_list_round_trip(t):
    path = shared_path(t.spark, "ids")
    writers.id_list(t.queries.unionByName(t.queries), path, "test")
    return readers.id_list(t.spark, path).join(readers.id_list_meta(t.spark, path).select("count", "source"), F.lit(True))


@query("SELECT item_id AS query_id FROM benchmark WHERE item_id % 3 = 0 OR item_id % 5 = 0")
def dropped_list_upsert(t):
    """Without new ids nothing is written; with some, the union."""
    path, old = shared_path(t.spark, "dropped"), t.queries.where("query_id % 3 = 0")
    writers.dropped_list(old, old.where("false"), path)
    writers.dropped_list(old, t.queries.where("query_id % 5 = 0"), path)
    return readers.id_list(t.spark, path).select(F.col("query_id").cast("long").alias("query_id"))


@query("SELECT vec_id, label::VARCHAR AS pdf_stem, round(list_sum(embedding)::DOUBLE, 3) AS total FROM embeddings WHERE label % 2 = 0")
def vector_cache_round_trip(t):
    """Vectors of two models; one model's are read, and of it only some documents'."""
    path = shared_path(t.spark, "vectors")
    v = t.raw("embeddings").select("vec_id", F.col("label").cast("string").alias("pdf_stem"), F.col("embedding").alias("vector"))
    for tag in ("a", "b"):
        writers.vectors(v.withColumn("model_tag", F.lit(tag)), path)
    back = readers.vectors(t.spark, path, "a", v.where("cast(pdf_stem as int) % 2 = 0"))
    return back.select("vec_id", "pdf_stem", F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double")), 3).alias("total"))


@query("SELECT page_id AS master_id, 'c' || page_id % 5 AS company, 2000 + page_id % 20 AS year, url AS report_paths, 'who, \"' || page_id || '\"?' AS question FROM pages WHERE url IS NOT NULL AND url <> ''")
def csv_round_trip(t):
    path, n = shared_path(t.spark, "qa"), F.col("page_id").cast("string")
    rows = t.raw("pages").where("url is not null and url <> ''").select(F.lit("ok").alias("status"), n.alias("master_id"), F.concat(F.lit("c"), (F.col("page_id") % 5).cast("string")).alias("company"), (2000 + F.col("page_id") % 20).alias("year"), F.col("url").alias("report_paths"), F.concat(F.lit('who, "'), n, F.lit('"?')).alias("question"))
    rows.write.option("header", True).option("escape", '"').csv(path)
    return readers.csv(t.spark, path, readers.QA, escape='"').drop("status")


@query("SELECT doc_id % 50 AS query_id, CASE WHEN doc_id % 2 = 0 THEN lpad(doc_id::VARCHAR, 8, '0') ELSE doc_id::VARCHAR END AS chunk_id FROM labels")
def votes_round_trip(t):
    """Short ids are padded where the query's template has the padded one: for even ids, though another query has the odd ones."""
    path = shared_path(t.spark, "votes")
    rows = t.raw("labels").select((F.col("doc_id") % 50).alias("query_id"), F.col("doc_id").cast("string").alias("chunk_id"), F.lit("evid").alias("label"))
    rows.write.option("header", True).csv(path)
    template = rows.select(F.when(F.col("chunk_id").cast("long") % 2 == 0, F.col("query_id")).otherwise(F.col("query_id") + 1).alias("query_id"), F.lpad("chunk_id", 8, "0").alias("chunk_id"))
    return readers.votes_csv(t.spark, path, template).select(F.col("query_id").cast("long").alias("query_id"), "chunk_id")


@query(f"{_QUALITY} SELECT doc_id::VARCHAR AS pdf_stem FROM r WHERE {_REASONS} <> ''")
def problem_list_round_trip(t):
    """What the problem list names is what a later run leaves out."""
    path = shared_path(t.spark, "problems")
    writers.problem_documents(D.problem_list(_quality(t)), {"page_cov": 0.98, "section_path_ratio": 0.75, "allow_orphan": 0}, "stage1", path)
    return readers.exclude_list(t.spark, path)


@query("SELECT count(*) AS n, 'x' AS stage FROM documents")
def stats_round_trip(t):
    path = shared_path(t.spark, "stats")
    writers.stats(t.docs.agg(F.count(F.lit(1)).alias("n")), {"stage": "x"}, path)
    return readers.jsonl(t.spark, path, "n bigint, params map<string,string>").select("n", F.col("params")["stage"].alias("stage"))
