"""Retrieval, matching, mining, gold sets and evaluation on small hand-made tables."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sieveline.functions import text as X
from sieveline.operators import documents as D
from sieveline.operators import evaluation as E
from sieveline.operators import gold as G
from sieveline.operators import matching as M
from sieveline.operators import ranking as R
from sieveline.operators import retrieval as V
from sieveline.operators import runs as U
from sieveline.operators import training as T


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_numbers_units_and_spellings(spark):
    raw = ["1,234.5万元", "3亿", "12.5%", "１２元", "-7", "无", "", "0", "867314752.9元", "5％"]
    df = spark.createDataFrame(list(enumerate(raw)), "i int, raw string")
    got = rows(df.select("i", X.number(F.col("raw")), X.unit(F.col("raw")), X.variants(F.col("raw"))), "i")
    assert [r[1] for r in got] == [12345000.0, 3e8, 0.125, 12.0, -7.0, None, None, 0.0, 867314752.9, 0.05]
    assert [r[2] for r in got] == ["万", "亿", "%", "元", None, None, None, None, "元", "%"]
    assert got[5][3] == ["无"] and got[6][3] == [] and got[7][3] == ["0"]
    assert got[8][3] == ["867314752.9元", "867314752.9", "8.67315e+08", "86731.5", "8.67315"]


def test_match_takes_the_first_spelling_then_mail(spark):
    hits = spark.createDataFrame([(1, d, d, 0.1) for d in (1, 2, 3, 4, 5)], "query_id long, doc_id long, rank int, score double")
    texts = [(1, "total: 1,234 units"), (2, "write to a@b.org"), (3, "ACME  Corp wrote"), (4, "nothing"), (5, None)]
    keys = spark.createDataFrame([(1, 0, "1,234", "prom_answer"), (1, 1, "Acme Corp", "name"), (1, 2, "x@y.com", "电子信箱")], "query_id long, pos int, value string, source string")
    got = {r.doc_id: r for r in M.match(hits, spark.createDataFrame(texts, "doc_id long, text string"), keys).collect()}
    assert [(got[d].match_type, got[d].confidence) for d in (1, 2, 3, 4, 5)] == [("exact", 0.8), ("regex", 0.7), ("exact", 1.0), ("none", 0.0), ("none", 0.0)]
    assert got[1].evidence == "total: 1,234 units" and got[2].evidence == "write to a@b.org" and got[5].evidence == ""
    labels = {r.doc_id: r.label for r in M.auto_label(M.match(hits, spark.createDataFrame(texts, "doc_id long, text string"), keys), max_rank=4).collect()}
    assert [labels[d] for d in (1, 4, 5)] == ["positive_auto", "candidate", "negative_auto"]


def test_reciprocal_rank_fusion_with_ties_and_missing_ranks(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 0)], "query_id long, doc_id long, rank int")
    b = spark.createDataFrame([(1, 11, 1), (1, 10, 2), (1, 13, 3)], "query_id long, doc_id long, rank int")
    got = rows(V.rrf(a, b, 10), "rank")
    assert [r[1] for r in got] == [10, 11, 13, 12]  # 10 and 11 tie: the first route's order
    assert got[0][2] == got[1][2] == round(1 / 61 + 1 / 62, 9) and got[2][2] == round(1 / 63 + 1 / (60 + 9999), 9)
    assert [r[1] for r in rows(V.rrf(a, b, 1), "rank")] == [10]


def test_bm25_has_scores_for_all_chunks_of_a_scope(spark):
    docs = spark.createDataFrame([("s", 1, "apple pear"), ("s", 2, "apple apple fig"), ("s", 3, ""), ("t", 4, "fig")], "scope string, doc_id long, text string")
    q = spark.createDataFrame([(1, "s", "fig fig"), (2, "u", "fig")], "query_id long, scope string, text string")
    got = {r.doc_id: r.score for r in V.bm25_scores(q, docs).collect()}
    n, df, avgdl = 3, 1, 5 / 3
    one = (math.log(n - df + 0.5) - math.log(df + 0.5)) * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 3 / avgdl))
    assert got == {1: 0.0, 2: round(2 * one, 6), 3: 0.0}


def test_negative_idf_becomes_a_share_of_the_mean(spark):
    docs = spark.createDataFrame([("s", i, "all" + (" one" if i == 1 else "")) for i in (1, 2, 3)], "scope string, doc_id long, text string")
    toks = V.tokenized(docs)
    got = {r.term: r.idf for r in V.idf(V.postings(toks), V.scope_stats(toks)).collect()}
    common, rare = math.log(0.5) - math.log(3.5), math.log(2.5) - math.log(1.5)
    assert abs(got["one"] - rare) < 1e-12 and abs(got["all"] - 0.25 * (common + rare) / 2) < 1e-12


def test_dense_top_k_in_scope(spark):
    v = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "a", [0.6, 0.8]), (3, "b", [1.0, 0.0]), (4, "a", [1.0, 0.0])], "doc_id long, scope string, vector array<float>")
    q = v.where("doc_id = 1").withColumnRenamed("doc_id", "query_id")
    assert rows(R.top_k(V.dense_scores(q, v), "query_id", 2), "rank") == [(1, 1, 1.0, 1), (1, 4, 1.0, 2)]


def test_metrics_of_ranked_labels(spark):
    gold = spark.createDataFrame([(1, 1, "related"), (1, 3, "evidence"), (2, 9, "irrelevant")], "query_id long, doc_id long, label string")
    hits = spark.createDataFrame([("r", 1, d, d) for d in (1, 2, 3)] + [("r", 2, 9, 1), ("r", 3, 1, 1)], "route string, query_id long, doc_id long, rank int")
    got = {r.query_id: r for r in E.query_metrics(hits, gold).collect()}
    assert set(got) == {1, 2}  # only queries of the gold set
    dcg, best = 1 + 2 / math.log2(4), 2 + 1 / math.log2(3)
    assert (got[1].mrr, got[1].ndcg, got[1].precision, got[1].unjudged) == (round(1 / 3, 6), round(dcg / best, 6), 0.1, 1)
    assert (got[2].mrr, got[2].ndcg) == (0.0, 0.0)
    assert E.group_metrics(E.query_metrics(hits, gold)).first().queries == 2


def test_mining_shares_negatives_between_positives(spark):
    """Hits without a text are neither; texts and evidence are cut."""
    hits = [(1, d, d, 0.5, d in (2, 5), 1.0 if d in (2, 5) else 0.0, "exact", "e" * 400, None if d == 3 else "" if d == 4 else "t" * 600) for d in range(1, 14)] + [(2, 1, 1, 0.5, False, 0.0, "none", "e", "t")]
    m = spark.createDataFrame(hits, "query_id long, doc_id long, rank int, score double, is_match boolean, confidence double, match_type string, evidence string, text string")
    got = M.mine(m).orderBy("pos_id").collect()
    assert [r.pos_id for r in got] == [2, 5] and got[0].neg_ids == got[1].neg_ids == [1, 6, 7, 8, 9, 10]
    assert len(got[0].pos_text) == 500 and len(got[0].evidence) == 300 and {len(x) for x in got[0].neg_texts} == {500}
    stats = M.acceptance(M.mining_stats(M.mine(m), m.select("query_id").distinct(), m)).first()
    assert (stats.triplets, stats.with_positive, stats.queries, stats.hit_rate, stats.min_rank, stats.max_rank, stats.missing_text, stats.accepted) == (2, 1, 2, 0.5, 2, 5, 2, False)
    none = M.acceptance(M.mining_stats(M.mine(m.where("false")), m.where("false").select("query_id")), 0.0, 0, 10).first()
    assert (none.triplets, none.hit_rate, none.avg_best_rank, none.accepted) == (0, 0.0, 0.0, False)


def test_gates_and_answers(spark):
    rows = [(None, True, 1, 1), (True, False, 1, 1), (True, None, 1, 1), (True, True, 0, 1), (True, True, 1, None), (True, True, 1, 1)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a boolean, b boolean, c int, d int")
    got = [r[0] for r in df.orderBy("i").select(M.mining_gate(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).collect()]
    assert got == ["no_master", "not_type1", "not_type1", "no_key_values", "no_hits", "kept"]
    types = spark.createDataFrame([(0, "1", None), (1, None, " 1 "), (2, "", "1"), (3, "1-2", "1"), (4, None, None), (5, "1.0", "1")], "i int, t string, p string")
    assert [r[0] for r in types.orderBy("i").select(M.is_type_one(F.col("t"), F.col("p"))).collect()] == [True, True, False, False, False, False]
    a = spark.createDataFrame([(0, "p", ["a"]), (1, "", ["a" * 300]), (2, None, [])], "i int, p string, a array<string>")
    assert [r[0] for r in a.orderBy("i").select(M.answer_text(F.col("p"), F.col("a"))).collect()] == ["p", "a" * 200, ""]


def test_key_values_in_their_order(spark):
    long = "no digits " * 9
    prompts = [{"prom_answer": "x"}, {"prom_answer": long, "传真": "1", "电子信箱": " a@b.c ", "注册地址": long}, {"prom_answer": "", "股票简称": "  "}, {"prom_answer": long + "1"}]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(prompts)], "i int, p map<string,string>")
    got = [[tuple(x) for x in r[0]] for r in df.orderBy("i").select(M.key_values(F.col("p"))).collect()]
    assert got == [[("x", "prom_answer")], [("a@b.c", "电子信箱"), (long.strip(), "注册地址"), ("1", "传真")], [], [((long + "1").strip(), "prom_answer")]]


def test_label_stats_have_two_denominators(spark):
    rows = [(1, "positive_auto", "t"), (1, "candidate", ""), (2, "positive_auto", "t"), (3, "negative_auto", None)]
    labelled = spark.createDataFrame(rows, "query_id long, label string, text string")
    q = spark.createDataFrame([(1, True), (2, False), (3, True), (4, True), (5, None)], "query_id long, answered boolean")
    r = M.label_stats(labelled, q).first()
    assert (r.positive, r.candidate, r.negative, r.missing_answer, r.missing_chunk, r.match_rate, r.avg_positive) == (1, 1, 1, 2, 2, 0.2, round(1 / 3, 6))


def test_votes_by_majority_and_policy(spark):
    v = [("Evidence", "evid", "rel"), ("irr", "irrelevant ", None), ("rel", "RELATED", "evidence"), ("evidence", "rel", "irr"), (None, "rel", "irr"), ("evidence",) * 3]
    votes = spark.createDataFrame([(i, 1, *x, "n") for i, x in enumerate(v)], "query_id long, doc_id long, a string, b string, c string, notes string")
    got = G.adjudicate(votes, ("a", "b", "c")).orderBy("query_id").collect()
    assert [r.final_label for r in got] == ["evidence", "irrelevant", "related", "evidence", "related", "evidence"]
    assert [r.rule for r in got] == ["majority_evidence", "majority_irrelevant", "majority_related", "all_diff_gemini", "all_diff_fallback", "majority_evidence"]
    assert [r.core for r in got] == [False] * 5 + [True] and [r.notes for r in got] == ["n", "n", "n", "n", "", "n"]
    other = G.adjudicate(votes, ("a", "b", "c"), "related").where("query_id = 3").first()
    assert (other.final_label, other.rule) == ("related", "all_diff_related")


def test_votes_of_three_sources_join_the_template(spark):
    rows = lambda *x: spark.createDataFrame(x, "query_id long, doc_id long, label string")
    template = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 10, 1)], "query_id long, doc_id long, rank int")
    a = rows((1, 10, "evid"), (9, 9, "evid")).withColumn("notes", F.lit("n"))
    votes = G.vote_table(template, {"gemini": a, "qwen": rows((1, 10, "evidence"), (1, 11, "irr")), "codex": rows((1, 10, "Evidence"), (1, 11, "irrelevant"))})
    got = G.adjudicate(votes, ("gemini", "qwen", "codex"))
    assert sorted((r.query_id, r.doc_id, r.final_label, r.rule, r.core, r.notes) for r in got.collect()) == [
        (1, 10, "evidence", "majority_evidence", True, "n"), (1, 11, "irrelevant", "majority_irrelevant", False, ""), (2, 10, "related", "all_diff_fallback", False, "")]
    ids = lambda core: {r.query_id: [c.doc_id for c in r.candidates] for r in G.gold_records(got, core).collect()}
    assert ids(False) == {1: [10, 11], 2: [10]} and ids(True) == {1: [10], 2: []}
    assert {r.query_id: r.has_positive for r in G.any_positive(votes, ("gemini", "qwen", "codex")).collect()} == {1: True, 2: False}
    assert sorted((r.doc_id, r.annotator) for r in G.missing_votes(votes, ("gemini", "qwen", "codex")).where("query_id = 1").collect()) == [(11, "gemini")]


def test_changes_of_a_gold_set(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "query_id long")
    all_, now = ids(*range(10)), ids(0, 1, 2)
    got = {r.query_id: r.origin for r in G.resample(all_, now, ids(1, 7), ids(0, 3, 4), 3).collect()}
    assert {q for q, o in got.items() if o == "kept"} == {0, 2} and len(got) == 3 and not {1, 3, 4} & set(got)
    assert {r.query_id for r in G.resample(all_, now, ids(8), ids(), 99).collect()} == {0, 1, 2}  # nothing to replace
    for args in ((all_, now, ids(1), ids(), 5), (ids(0, 1, 2, 3), now, ids(1, 2), ids(), 3)):
        with pytest.raises(ValueError):
            G.resample(*args)
    with pytest.raises(ValueError):
        G.additions(all_, [now], 8)
    assert G.additions(all_, [now], 7).count() == 7
    assert G.upserted(now, ids()).count() == 3 and G.upserted(now, ids(2, 5)).count() == 4
    report = G.change_report(now, ids(0, 2, 5), ids(3)).first()
    assert (report.kept_qids, report.dropped_qids, report.sampled_qids, report.excluded_qids, report["size"]) == ([0, 2], [1], [5], [3], 3)
    assert G.merged_gold(now, ids(5, 6), 5).count() == 5
    for other, size in ((ids(5), 5), (ids(2), 4)):
        with pytest.raises(ValueError):
            G.merged_gold(now, other, size)
    hits, docs = spark.createDataFrame([(1, 1, 1), (1, 2, 2)], "query_id long, doc_id long, rank int"), spark.createDataFrame([(1, " ")], "doc_id long, text string")
    assert [(r.label, r.notes) for r in G.template(hits, docs).orderBy("rank").collect()] == [("irrelevant", "empty_text")] * 2
    with pytest.raises(ValueError):
        G.template(hits, docs, strict_missing=True)
    assert [r.doc_id for r in G.missing_chunks(hits, docs).collect()] == [2]


def test_texts_of_candidates_and_groups_side_by_side(spark):
    c = spark.createDataFrame([(1, d) for d in (1, 2, 3)], "query_id long, doc_id long")
    gold = spark.createDataFrame([(1, 1, "g"), (1, 2, "")], "query_id long, doc_id long, text string")
    chunks = spark.createDataFrame([(1, "c1"), (2, "c2")], "doc_id long, text string")
    got = E.candidate_texts(c, gold, chunks)
    assert {r.doc_id: r.text for r in got.collect()} == {1: "g", 2: "c2", 3: ""}
    assert tuple(E.missing_text(got).first()) == (1, 3, round(1 / 3, 6)) and E.missing_text(got.where("false")).first().missing_text_rate == 0.0
    per = spark.createDataFrame([("a", 1, 0.5, 0.6, 0.1)], "route string, query_id long, mrr double, ndcg double, precision double")
    wide = {r.query_id: (r.a_ndcg, r.b_ndcg) for r in E.compared(spark.createDataFrame([(1,), (2,)], "query_id long"), per, ["a", "b"]).collect()}
    assert wide == {1: (0.6, None), 2: (None, None)}


def test_documents_of_a_stage(spark):
    s = spark.createDataFrame([("a", 5, 9), ("b", 5, 2), ("c", 3, None), ("d", 9, 30)], "pdf_path string, qa_count int, qa_count_cumulative int")
    rows_ = lambda *a, **k: [(r.pdf_path, r.qa_count_cumulative) for r in D.select_documents(s, *a, **k)[0].orderBy("position").collect()]
    assert rows_(None, None) == [("d", 30), ("b", 2), ("a", 9), ("c", 4)] and rows_(10, None) == [("d", 30), ("b", 2)] and rows_(None, 1) == [("d", 30)]
    assert [x for x, _ in rows_(None, None, many_first=False)] == ["b", "a", "d", "c"]
    bare, totals = D.select_documents(s.drop("qa_count_cumulative"), 15, 9)
    assert [(r.pdf_path, r.qa_count_cumulative) for r in bare.orderBy("position").collect()] == [("d", 1), ("a", 2), ("b", 3)] and tuple(totals.first()) == (3, 19)


def test_names_hashes_and_parents_of_documents(spark):
    import hashlib

    c = spark.createDataFrame([("d", "2", None, "b"), ("d", "10", "2", "a"), ("d", "3", "7", None)], "doc_id string, chunk_id string, parent_id string, text string")
    want = hashlib.sha1(b"10::a2::b3::").hexdigest()
    assert [(r.content_hash, r.chunks) for r in D.content_hash(c).collect()] == [(want, 3)]
    assert {r.chunk_id: r.parent_text for r in D.parent_of(c).collect()} == {"2": None, "10": "b", "3": None}
    files = spark.createDataFrame([("p/x.pdf", "out/x_chunks.json", 1), (None, "out/y.json", 2), ("q/x.pdf", "out/z_chunks.json", 3)], "source string, file string, n int")
    wanted = spark.createDataFrame([("p/x.pdf",), ("any/x_chunks.json",), ("x",), ("y",), ("x.pdf",), ("none",)], "name string")
    assert {r.name: r.n for r in D.by_alias(wanted, files).collect()} == {"p/x.pdf": 1, "any/x_chunks.json": 1, "x": 1, "y": 2, "x.pdf": 3}
    assert [r.preview for r in D.gap_preview(spark.createDataFrame([(1, 2 * k, 2 * k) for k in range(12)], "doc_id long, gap_start long, gap_end long")).collect()][0][9:] == ["[18, 18]", "...共12段缺口"]


def test_runs():
    assert U.run_tag("stage1", 2e-5, 1, 1, 8, 256, None, 42) == "stage1_lr2e-05_e1_bs1_ga8_len256_negall_seed42"
    assert U.run_folder("7", "a", " My Run! ") == "run_7_a_my-run" and U.run_folder("7", "a", "", plain=True) == "run_7"
    assert U.device_tag("cuda", "A 100", 2) == "cuda_2gpu_a-100" and U.device_tag(None) == "unknown"
    assert U.cache_tag("Org/Model @1", True, None, "auto", False) == "org-model--1_normT_mslNone_pmauto_blkF"
    assert [U.max_length(*x) for x in ((0, None, 10**9), (None, 0, 300), (None, 128, 300), (64, 128, 300))] == [512, 300, 128, 64]


def test_manifests_and_times(spark):
    t = spark.createDataFrame([(" 1",), ("1",), ("x",)], "query_id string")
    m = U.manifest(t, t.where("query_id = 'x'"), t.where("false"), {"source": "s"}).first()
    assert (m.train_samples, m.train_query_ids, m.dev_samples, m.dev_query_ids, m.blacklist_count, m.source) == (3, 2, 1, 1, 0, "s")
    at = spark.range(1).select(U.local_time(F.timestamp_seconds(F.lit(0))).alias("t")).first().t
    assert at == "1970-01-01T08:00:00+08:00" and m.created_at.endswith("+08:00")
    files = spark.createDataFrame([(f"f{k}",) for k in range(9)], "file string")
    assert U.first_files(files).count() == 5 and U.first_files(files, None).count() == 9


def test_dense_top_k_of_all_chunks(spark):
    rng = random.Random(2)
    v = [(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(60)] + [(60, None), (61, [1.0])]
    chunks = spark.createDataFrame(v, "doc_id long, vector array<float>")
    q = chunks.where("doc_id < 5 or doc_id = 60").withColumnRenamed("doc_id", "query_id")
    got = {(r.query_id, r["rank"]): r.doc_id for r in V.dense_topk(q, chunks, 3, block=2).collect()}
    exact = {r.doc_id: r.vector for r in chunks.where("doc_id < 60").collect()}
    for i in range(5):
        order = sorted(exact, key=lambda d: (-round(sum(x * y for x, y in zip(exact[i], exact[d])), 6), d))
        assert [got[i, k] for k in (1, 2, 3)] == order[:3]
    assert len(got) == 15 and V.dense_topk(q.where("false"), chunks, 3).count() == 0


def test_logits_and_strict_labels(spark):
    df = spark.createDataFrame([([0.5],), ([0.1, 0.9],), ([1.0, 2.0, 3.0],)], "x array<double>")
    of = lambda labels=None: [round(r[0], 6) for r in df.select(X.logit_score(F.col("x"), labels)).collect()]
    assert of() == [0.5, 0.9, 1.0] and of({0: "Yes", 1: "no"}) == [0.5, -0.8, 1.0] and of({1: "POS", 0: "neg"}) == [0.5, 0.8, 1.0]
    said = spark.createDataFrame([('[{"index": 1, "label": "evid"}, {"index": "x", "label": "rel"}]',)], "s string")
    with pytest.raises(Exception, match="index and label"):
        said.select(X.label_items(X.repaired_json(F.col("s")), strict=True)).collect()


def test_split_keeps_queries_whole(spark):
    t = spark.createDataFrame([(q, p) for q in range(20) for p in range(3)], "query_id long, pos_id long")
    got = T.group_split(t, 0.9)
    assert got.groupBy("query_id").agg(F.count_distinct("split").alias("n")).where("n > 1").isEmpty()
    assert {r.split: r.n for r in got.groupBy("split").agg(F.count_distinct("query_id").alias("n")).collect()} == {"train": 18, "dev": 2}


def test_filters_name_their_first_reason(spark):
    t = spark.createDataFrame([(None, "1"), (1, "1"), (2, "x"), (3, "0.7")], "query_id long, confidence string")
    got = T.filter_reasons(t, spark.createDataFrame([(1,)], "query_id long"))
    assert sorted(r.reason for r in got.collect()) == ["blacklist", "confidence", "kept", "null_id"]


def test_page_gaps_and_exclusive_quantiles(spark):
    pages = spark.createDataFrame([(1, p) for p in (1, 2, 2, 5, 9)] + [(2, 4)], "doc_id long, page int")
    assert rows(D.page_gaps(pages), "gap_start") == [(1, 3, 4), (1, 6, 8)]
    lengths = spark.createDataFrame([(1, 7)] + [(2, x) for x in (1, 2)] + [(3, x) for x in range(1, 11)], "doc_id long, length int")
    got = {r.doc_id: (r.n, r.min, r.median, r.p90, r.max) for r in D.length_stats(lengths).collect()}
    assert got == {1: (1, 7, 7, 7, 7), 2: (2, 1, 1, 2, 2), 3: (10, 1, 5, 9, 10)}


def test_greedy_prefix_keeps_the_crossing_row(spark):
    s = spark.createDataFrame([("a", 5), ("b", 4), ("c", 3), ("d", 1)], "scope string, qa long")
    take = lambda target, cap: [r.scope for r in R.greedy_prefix(s, [F.desc("qa"), F.asc("scope")], "qa", target, cap).orderBy("position").collect()]
    assert take(6, 9) == ["a", "b"] and take(99, 3) == ["a", "b", "c"] and take(0, 9) == []


def test_repaired_json(spark):
    said = ['```json\n[{"index": "0", "label": "Evid"}]\n```', 'Sure: {"results": [{"index": 2, "label": "irr", "notes": "n"}]} done', "broken", None]
    df = spark.createDataFrame(list(enumerate(said)), "i int, s string")
    got = [r[0] for r in df.orderBy("i").select(X.label_items(X.repaired_json(F.col("s")))).collect()]
    assert [[tuple(x) for x in g] if g is not None else None for g in got] == [[(0, "evidence", "")], [(2, "irrelevant", "n")], None, None]


def test_routes_read_only_the_postings_of_asked_terms(spark):
    q = spark.createDataFrame([(1, "a", "x y y"), (2, "a", None), (3, "b", "x"), (4, "c", "x")], "query_id long, scope string, text string")
    docs = spark.createDataFrame([(1, "a", "x z z z"), (2, "a", "y y x w"), (3, "a", None), (4, "a", "w"), (5, "b", "y"), (6, "d", "x")], "doc_id long, scope string, text string")
    asked = V.asked_postings(q, docs)
    got = sorted((r.doc_id, r.term or "", r.tf, r.dl, r.nd) for r in asked.collect())
    assert got == [(1, "", 1, 4, 2), (1, "x", 1, 4, 2), (2, "", 1, 4, 3), (2, "x", 1, 4, 3), (2, "y", 2, 4, 3), (3, "", 1, 0, 0), (4, "", 1, 1, 1), (5, "", 1, 1, 1)]
    toks = V.tokenized(docs)
    want = {(r.scope, r.term): r.idf for r in V.idf(V.postings(toks), V.scope_stats(toks)).collect()}
    weights = V.bm25_weights(q, docs, asked)
    assert {(r.query_id, r.term): r.idf for r in weights.collect()} == {(1, "x"): want["a", "x"], (1, "y"): want["a", "y"]}
    top = V.top_found(q, asked, weights, 2, V.bm25_found)
    assert rows(top.select("query_id", "rank", "doc_id")) == [(1, 1, 2), (1, 2, 1), (2, 1, 1), (2, 2, 2), (3, 1, 5)]
    often = spark.createDataFrame([(i, "a", "x " * i + f"t{i}") for i in range(1, 6)], "doc_id long, scope string, text string")
    w = V.bm25_weights(q, often, V.asked_postings(q, often)).collect()
    toks = V.tokenized(often)
    assert [round(r.idf, 9) for r in w] == [round(r.idf, 9) for r in V.idf(V.postings(toks), V.scope_stats(toks)).where("term = 'x'").collect()]


def test_dense_top_k_holds_a_block_of_scores():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(3)
    c, q = rng.integers(-2, 3, (6000, 4)).astype(np.float32), rng.integers(-2, 3, (1500, 4)).astype(np.float64)
    ids = rng.permutation(6000)
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(list(c), pa.list_(pa.float32()))], ["doc_id", "vector"])
    tracemalloc.start()
    got = V.best_of([batch], np.arange(1500), q, 20)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120e6  # all scores of the batch alone are 72 MB, and sorting them takes several times that
    order = np.argsort(ids)
    scores = q @ c[order].T.astype(np.float64)
    best = np.argsort(-scores, axis=1, kind="stable")[:, :20]
    assert got.column(1).to_pylist() == best.ravel().tolist() and got.column(2).to_pylist() == np.take_along_axis(scores, best, 1).ravel().tolist()


def test_comparisons_triplets_and_reranking_do_not_read_documents_again(spark):
    from sieveline.plans import queries as Q

    for name in ("group_deltas", "mining_stats", "rerank_topk"):
        files = Q.QUERIES[name](spark, "/root/testdata/sf0.001").inputFiles()
        assert files and not [f for f in files if "documents.parquet" in f], name


def test_texts_are_chosen_before_they_are_shuffled(spark):
    chunks = spark.createDataFrame([(i, f"text {i}") for i in range(9)], "doc_id long, text string")
    hits = spark.createDataFrame([(1, 3, 1, 0.5), (1, 20, 2, 0.4)], "query_id long, doc_id long, rank int, score double")
    gold = spark.createDataFrame([], "query_id long, doc_id long, text string")
    keys = spark.createDataFrame([(1, 0, "text3", "last")], "query_id long, pos int, value string, source string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = [E.candidate_texts(hits, gold, chunks), G.template(hits, chunks), M.match(hits, chunks, keys)]
        plans = [x._jdf.queryExecution().executedPlan().toString() for x in made]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert all("LeftSemi, BuildRight" in p for p in plans)
    assert [{r.doc_id: r.text for r in x.collect()} for x in made] == [{3: "text 3", 20: ""}, {3: "text 3", 20: ""}, {3: "text 3", 20: None}]


def test_routes_read_and_tokenize_documents_once(spark, monkeypatch):
    from sieveline.plans import queries as Q

    plain = Q.Tables.docs.fget
    for name in ("alignment_missing_extra", "flat_round_trip", "top_hits"):
        read = spark.sparkContext.accumulator(0)

        @F.udf("string")
        def seen(text, read=read):
            read.add(1)
            return text

        monkeypatch.setattr(Q.Tables, "docs", property(lambda t, seen=seen: plain(t).withColumn("text", seen("text"))))
        assert Q.QUERIES[name](spark, "/root/testdata/sf0.001").count()
        assert read.value == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count(), name


def test_counts_of_terms_in_batches(spark):
    rng = random.Random(5)
    words = ["x", "y", "z", "é", "long" * 9, "1"]
    text = [None if i % 9 == 0 else " ".join(rng.choices(words, k=rng.randint(0, 12))) for i in range(60)]
    docs = spark.createDataFrame([(i, rng.choice(["a", "b", "c", None]), t) for i, t in enumerate(text)], "doc_id long, scope string, text string").repartition(3).cache()
    q = spark.createDataFrame([(1, "a", "x x é none"), (2, "b", ""), (3, None, "y"), (4, "d", "z")], "query_id long, scope string, text string")
    known = {r.scope: set((r.text or "").split()) for r in q.collect() if r.scope}
    have = [(r.scope, r.doc_id, (r.text or "").split()) for r in docs.collect()]
    want = sorted((s, d, t, ts.count(t), len(ts), len(set(ts))) for s, d, ts in have if s in known for t in known[s] & set(ts))
    blank = sorted((s, d, len(ts), len(set(ts))) for s, d, ts in have if s in known)
    df = {}
    for s, _, ts in have:
        for t in set(ts):
            df[s, t] = df.get((s, t), 0) + 1
    sizes = {(s, n): sum(1 for (z, _), m in df.items() if z == s and m == n) for (s, _), n in df.items()}
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for most in (100, 0):  # 0: the asked terms are too many for the workers
            asked, counts = V.counted(q, docs, most=most)
            got = [tuple(r) for r in asked.select("scope", "doc_id", "term", "tf", "dl", "nd").collect()]
            assert sorted(r for r in got if r[2] is not None) == want
            assert sorted((r[0], r[1], r[4], r[5]) for r in got if r[2] is None) == blank
            assert {(r.scope, r.df): r.c for r in counts.collect()} == sizes
            assert V.counted(q, docs, every=False, most=most)[1].count() == 0
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    none = docs.where("false")
    assert [x.count() for x in V.counted(q, none)] == [0, 0]
