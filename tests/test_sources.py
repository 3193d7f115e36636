"""Readers, writers and resuming on small files."""

import json

import pytest

from sieveline.sources import readers, writers
from sieveline.streaming import incremental


def test_csv_names_missing_columns(spark, tmp_path):
    p = tmp_path / "qa.csv"
    p.write_text("status,master_id,company,year,report_paths,question\nok,7,c,2020,a/b.pdf,who\nok,x,c,,p,why\n")
    got = readers.csv(spark, str(p), readers.QA).orderBy("question").collect()
    assert [(r.master_id, r.year) for r in got] == [(7, 2020), (None, None)]
    p.write_text("status,master_id\nok,7\n")
    with pytest.raises(ValueError, match="question"):
        readers.csv(spark, str(p), readers.QA)


def test_chunk_files_fall_back(spark, tmp_path):
    chunk = {"chunk_id": "1", "content": "", "text": "t", "page_number": 3, "metadata": {"page_numbers": [], "section_path": ["a", "b"]}}
    (tmp_path / "x_chunks.json").write_text(json.dumps({"source": "x.pdf", "parents": [], "chunks": [chunk]}))
    (tmp_path / "y_chunks.json").write_text(json.dumps({"source": "y.pdf"}))
    (tmp_path / "other.json").write_text("{}")
    got = readers.chunk_files(spark, str(tmp_path)).collect()
    assert [(r.file_stem, r.kind, r.text, r.pages, r.section_path, r.pdf_stem) for r in got] == [("x", "child", "t", [3], ["a", "b"], "x")]


def test_lists_of_documents_to_leave_out(spark, tmp_path):
    p = tmp_path / "list"
    for text, want in (('{"problematic": [{"pdf_stem": "a"}, {"pdf_stem": "b"}]}', ["a", "b"]), ('["c", {"pdf_stem": "d"}]', ["c", "d"]), ("e\n\nf\n", ["e", "f"])):
        p.write_text(text)
        assert sorted(r.pdf_stem for r in readers.exclude_list(spark, str(p)).collect()) == want
    assert readers.exclude_list(spark, str(p), strict=True).isEmpty()


def test_votes_are_padded_to_the_template(spark, tmp_path):
    p = tmp_path / "votes.csv"
    p.write_text("query_id,chunk_id,label,notes\n1,123,evid,\n1,456,rel,\n,9,rel,\n")
    template = spark.createDataFrame([(1, "00000123"), (2, "00000456")], "query_id long, chunk_id string")  # 456 is another query's
    assert sorted(r.chunk_id for r in readers.votes_csv(spark, str(p), template).collect()) == ["00000123", "456"]
    assert sorted(r.chunk_id for r in readers.votes_csv(spark, str(p)).collect()) == ["00000123", "00000456"]


def test_id_lists_round_trip(spark, tmp_path):
    writers.id_list(spark.createDataFrame([("2",), ("1",), ("2",)], "query_id string"), str(tmp_path / "ids"), "test")
    assert sorted(r.query_id for r in readers.id_list(spark, str(tmp_path / "ids")).collect()) == ["1", "2"]


def test_nested_hits_keep_queries_without_hits(spark, tmp_path):
    q = spark.createDataFrame([(1, "a"), (2, "b")], "query_id long, query string")
    hits = spark.createDataFrame([(1, 5, 0.5, 1)], "query_id long, doc_id long, score double, rank int")
    writers.nested_hits(q, hits, str(tmp_path / "n"))
    assert {r.query_id: len(r.hits) for r in spark.read.json(str(tmp_path / "n")).collect()} == {1: 1, 2: 0}
    writers.no_hits(q, hits, str(tmp_path / "none"))
    assert [r.query_id for r in spark.read.json(str(tmp_path / "none")).collect()] == [2]


def test_cache_status(spark):
    now = spark.createDataFrame([(1, "h", 2), (2, "h", 2), (3, "h", 2)], "doc_id long, content_hash string, chunks long")
    old = spark.createDataFrame([(1, "h", 2), (2, "h", 1)], "doc_id long, content_hash string, chunks long")
    assert {r.doc_id: r.status for r in incremental.cache_status(now, old).collect()} == {1: "hit", 2: "stale", 3: "miss"}
    assert [r.doc_id for r in incremental.unfinished(now, old, "doc_id", 1).collect()] == [3]


def test_vectors_of_one_model_and_configurations(spark, tmp_path):
    v = spark.createDataFrame([("a", "x", [1.0]), ("a", "y", [2.0]), ("b", "x", [3.0])], "model_tag string, pdf_stem string, vector array<float>")
    writers.vectors(v, str(tmp_path / "v"))
    stems = spark.createDataFrame([("x",)], "pdf_stem string")
    got = readers.vectors(spark, str(tmp_path / "v"), "a", stems)
    assert [r.vector for r in got.collect()] == [[1.0]]
    assert "PartitionFilters: [isnotnull(model_tag" in got._jdf.queryExecution().toString()
    assert readers.config(spark, str(tmp_path / "none.yaml")) == {}
    (tmp_path / "c.json").write_text('{"a": 1}')
    assert readers.config(spark, str(tmp_path / "c.json")) == {"a": 1}
    pytest.importorskip("yaml")
    (tmp_path / "c.yaml").write_text("a:\n  b: [1, 2]\n")
    assert readers.config(spark, str(tmp_path / "c.yaml")) == {"a": {"b": [1, 2]}}


def test_lists_that_runs_leave_behind(spark, tmp_path):
    problems = spark.createDataFrame([("b", ["orphan_children 2"]), ("a", ["page_cov 0.5"])], "pdf_stem string, reasons array<string>")
    writers.problem_documents(problems, {"page_cov": 0.98}, "s", str(tmp_path / "p"))
    assert sorted(r.pdf_stem for r in readers.exclude_list(spark, str(tmp_path / "p"), strict=True).collect()) == ["a", "b"]
    ids = spark.createDataFrame([("1",)], "query_id string")
    writers.dropped_list(ids, ids.where("false"), str(tmp_path / "d"))
    assert not (tmp_path / "d").exists()
    writers.dropped_list(ids, spark.createDataFrame([("2",)], "query_id string"), str(tmp_path / "d"))
    assert readers.id_list_meta(spark, str(tmp_path / "d")).first()[:2] == (2, "gold_eval_no_positive")
    (tmp_path / "t.jsonl").write_text('{"query_id": 5, "candidates": []}\n{"query_id": "5"}\n{"query_id": null}\n')
    assert [r.query_id for r in readers.template_ids(spark, str(tmp_path / "t.jsonl")).collect()] == ["5"]
