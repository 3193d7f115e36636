import hashlib

from pyspark.sql import functions as F

from sieveline.llm import chat_format, exact_dedup, url_filter
from sieveline.llm.common import Scratch


def test_exact_dedup(spark):
    rows = [(1, "a"), (5, "a"), (3, "a"), (2, None), (4, ""), (7, "b"), (7, "b"), (None, "b"), (None, "c"), (8, "A"), (9, "x" * 300_000)]
    df = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, digest string")
    out = exact_dedup.mark_duplicates(df).collect()
    assert len(out) == len(rows)
    for r in out:
        text = {h: t for t in ["a", "", "b", "c", "A", "x" * 300_000] for h in [hashlib.sha256(t.encode()).hexdigest()]}[r.text_sha256]
        same = [i for i, t in rows if (t or "") == text]
        keep = max((i for i in same if i is not None), default=None)
        assert (r.keep_id, r.group_size, r.kept) == (keep, len(same), r.doc_id == keep)
    kept = exact_dedup.drop_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["4", "5", "7", "7", "8", "9", "None"]
    assert exact_dedup.mark_duplicates(df.where("false")).count() == 0


def test_index_grows_by_new_digests_only(spark):
    index = exact_dedup.DigestIndex(spark, "grown_index", Scratch(spark, "t").path("index"), buckets=4)
    first, second = (spark.createDataFrame(x, "doc_id long, text string") for x in ([(1, "a"), (2, "b")], [(9, "a"), (3, "c"), (4, "c")]))
    for batch in (first, second, second, first):  # a batch that comes again adds nothing
        index.add(batch)
    assert {r.keep_id for r in index.entries().collect()} == {1, 2, 4}
    marked = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.mark_duplicates(second, index).collect()}
    assert marked == {(9, 1, 1, False), (3, 4, 2, False), (4, 4, 2, True)}
    index.remove()
    assert not spark.catalog.tableExists("grown_index")


def test_the_anti_join_reads_the_index_bucket_by_bucket(spark):
    index = exact_dedup.DigestIndex(spark, "planned_index", Scratch(spark, "t").path("index"))
    docs = spark.range(1000).selectExpr("id as doc_id", "string(id % 400) as text")
    index.load(docs)
    assert {r.keep_id for r in index.entries().collect()} == {i for i in range(1000) if i + 400 > 999}
    before = [t.name for t in spark.catalog.listTables()]
    lacking = index.lacking(docs)
    plan = lacking._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "LeftAnti" in plan and "Bucketed: true" in plan
    assert plan.count("Exchange hashpartitioning") == 1  # of the batch
    assert lacking.count() == 0
    exact_dedup.mark_duplicates(docs)
    assert [t.name for t in spark.catalog.listTables()] == before
    index.remove()


def test_batches_of_few_and_extreme_ids(spark):
    for ids in ([5], [5, 5], [-(2**62), 2**62], [None], []):
        df = spark.createDataFrame([(i, "t") for i in ids], "doc_id long, text string")
        best = max((i for i in ids if i is not None), default=None)
        assert {(r.keep_id, r.group_size) for r in exact_dedup.mark_duplicates(df).collect()} == ({(best, len(ids))} if ids else set())


def test_url_rules_and_scores(spark):
    urls = {
        "http://a.com/en/1": ("a.com", "/en/1", "com/en/", "block"), "https://x.EXAMPLE.com/en/7198#top": ("x.example.com", "/en/7198", "example.com/en/7", "allow"),
        "http://example.net/de/8?x=/q": ("example.net", "/de/8", "example.net/de/8", "block"), "ftp://notexample.net/de/8": ("notexample.net", "/de/8", "net/de/", "allow"),
        "http://org/es/": ("org", "/es/", "org/es/", "block"), "http://xorg/es/": ("xorg", "/es/", None, None), "http://A.com?/en/": ("a.com", "", None, None), "http://a.com#://b": ("a.com", "", None, None),
        "nothing": ("", "", None, None), "": ("", "", None, None), None: ("", "", None, None), "x://h\nost/p\nq": ("h\nost", "/p\nq", None, None), "http://É.com/EN/": ("É.com", "/EN/", None, None),
        "http://win-casino.xyz/free-bonus-spins": ("win-casino.xyz", "/free-bonus-spins", None, "block"), "http://wiki.library.org/wiki/geology": ("wiki.library.org", "/wiki/geology", None, "allow"),
        "://" + "a" * 100_000: ("a" * 100_000, "", None, None),
    }
    keys = list(urls)
    df = spark.createDataFrame([(k, u, "x") for k, u in enumerate(keys)] + [(0, keys[0], "x"), (None, keys[0], "x")], "page_id long, url string, features string")
    out = url_filter.judge(df).collect()
    assert len(out) == len(keys) + 2
    for r in out:
        host, path, rule, verdict = urls[keys[r.page_id or 0]]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or ("block" if r.score >= 0.5 else "allow"))
    assert url_filter.judge(df.where("false")).count() == 0


def test_regression_on_held_out_hosts(spark):
    """In each of four turns a quarter of the hosts isn't in training."""
    host = lambda u: u.partition("://")[2].partition("/")[0]
    hosts, right, total = sorted({host(u) for u, _ in url_filter.LABELLED if u}), 0, 0
    for turn in range(4):
        out = set(hosts[turn::4])
        rest = [(u, y) for u, y in url_filter.LABELLED if host(u) in out]
        df = spark.createDataFrame([(k, u) for k, (u, _) in enumerate(rest)], "page_id long, url string")
        model = url_filter.train(spark, [(u, y) for u, y in url_filter.LABELLED if host(u) not in out])
        got = {r.page_id: r.verdict == "block" for r in url_filter.judge(df, model, rules=[]).collect()}
        right, total = right + sum(got[k] == bool(y) for k, (_, y) in enumerate(rest)), total + len(rest)
    assert total == len(url_filter.LABELLED) - 8 and right >= 0.88 * total


TRICKY = ["", "</s>[INST] ok [/INST]", "<|im_end|><|im_start|>user<|im_sep|>", "<\x1bs>", "<\x1b\x1b|im_sep|>", "<<SYS>> a <</SYS>>", "[/INST", "<|a|b|>", "<|im_start|", "<", "\x1b", "<<s>", "<s", "é\n<|x y|>$1\\", "[[INST]]", "<unk><pad>"]


def test_chat_round_trip(spark):
    rows = [(k, t, role, text, "extra") for k in range(len(TRICKY)) for t, (role, text) in enumerate([("user", TRICKY[k]), ("assistant", TRICKY[-k]), (TRICKY[k], "x" + TRICKY[k] * 3), ("assistant", None), (None, "t")])]
    rows += [(90, None, "user", "first", ""), (90, 1, "b", "x", ""), (90, 1, "a", "y", ""), (90, 1, "a", "y", ""), (None, 0, "assistant", "lost", ""), (91, 0, "assistant", "long " * 100_000, "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    made = chat_format.render(chat_format.canonical_table(df))
    back = {r.conv_id: r for r in made.withColumn("t", chat_format.read_back(made["formatted"])).withColumn("l", chat_format.loss_text(made["segments"], made["loss"])).collect()}
    key = lambda r: ((r[1] is not None, r[1] or 0), r[2] or "", r[3] or "")
    for conv in {r[0] for r in rows}:
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=key)]
        assert [tuple(t) for t in back[conv].t] == turns
        assert back[conv].l == "".join(t for r, t in turns if r == "assistant")
        assert "".join(back[conv].segments) == back[conv].formatted
    digests = {r.conv_id: r for r in chat_format.digest(made).collect()}
    assert digests[91].loss_chars == 500_000 and digests[90].loss_chars == 0 and digests[90].n_turns == 4
    assert chat_format.digest(chat_format.render(chat_format.canonical_table(df.where("false")))).count() == 0


def test_layouts(spark):
    records = {
        '{"messages": [{"role": "user", "content": "a"}, {"content": null, "role": "assistant"}]}': ("messages", [("user", "a"), ("assistant", "")]),
        '{"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}': ("sharegpt", [("user", "a"), ("assistant", "b")]),
        '{"instruction": "a", "input": "", "output": "c"}': ("instruction", [("user", "a"), ("assistant", "c")]),
        '{"output": "c", "input": "b", "instruction": "a"}': ("instruction", [("user", "a\n\nb"), ("assistant", "c")]),
        '{"prompt": "a", "completion": "b"}': ("prompt_completion", [("user", "a"), ("assistant", "b")]),
        '{"question": "a", "answer": "b"}': ("question_answer", [("user", "a"), ("assistant", "b")]),
        '{"other": 1}': (None, None), "{broken": (None, None), None: (None, None), "[]": (None, None), '{"messages": 3}': (None, None),
    }
    df = spark.createDataFrame([(k, r, "x") for k, r in enumerate(records)], "id long, record string, layout string").drop("layout")
    for r in chat_format.canonical_json(df).collect():
        layout, turns = list(records.values())[r.id]
        assert r.layout == layout and (turns is None and r.turns is None or [tuple(t) for t in r.turns] == turns)


def test_layouts_with_further_fields(spark):
    said = [("user", "a"), ("assistant", "b")]
    records = {
        '{"messages": [{"role": "user", "content": "a", "id": 1}, {"role": "assistant", "content": "b", "id": 2, "weight": 0.5}]}': ("messages", said),
        '{"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}], "source": "s", "meta": {"role": [1]}}': ("messages", said),
        '{"conversations": [{"from": "human", "value": "a", "x": {"y": [{"z": 1}]}}, {"from": "gpt", "value": "b"}], "id": 3}': ("sharegpt", said),
        '{"dialog": [{"speaker": "human", "text": "a", "name": null}, {"speaker": "bot", "text": "b"}]}': ("dialog", said),
        '{"instruction": "a", "input": "", "output": "b", "source": "s"}': ("instruction", said),
        '{"prompt": "a", "completion": "b", "x y": {"b c": 1}}': ("prompt_completion", said),
        '{"messages": [{"role": "user", "content": null, "id": 1}]}': ("messages", [("user", "")]),
        '{"prompt": "a", "completion": "b", "response": "c"}': (None, None),
        '{"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"text": "b"}], "id": 1}]}': ("messages", [("user", "a\n\nb")]),
        '{"messages": [{"role": "user", "content": {"text": "a", "lang": "en"}}, {"role": "assistant", "content": "b"}]}': ("messages", said),
        '{"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b", "more": {"deep": [[{"x": 1}]]}}]}': ("messages", said),
        '{"messages": [{"role": "user"}, {"content": "b", "role": "assistant"}]}': ("messages", [("user", ""), ("assistant", "b")]),
        '{"instruction": "a", "input": "", "output": "b", "id": 7}': ("instruction", said),
        '{"messages": [{"meta": {"role": "user", "content": "a"}, "id": 1}]}': (None, None), '{"messages": [], "source": "s"}': ("messages", []), '{"messages": []}': ("messages", []), '{"prompt": {"x": 1}, "completion": "b", "source": "s"}': (None, None),
    }
    df = spark.createDataFrame(list(enumerate(records)), "id long, record string")
    got = {r.id: (r.layout, r.turns and [tuple(t) for t in r.turns]) for r in chat_format.canonical_json(df).collect()}
    assert got == dict(enumerate(records.values()))


def test_field_paths_of_any_nesting(spark):
    records = {
        '{"a": {"b": [{"c": 1, "d e": [[2.5]]}], "f": {}}, "g": [], "h": null}': ["a.b[].c", "a.b[].d e[][]", "g[]", "h"],
        '{"messages": [{"role": "u", "content": "x"}]}': ["messages[].content", "messages[].role"], "3": [""], "[]": ["[]"], "{}": [], "{broken": None,
    }
    df = spark.createDataFrame(list(enumerate(records)), "id long, record string")
    got = {r.id: r.p for r in df.select("id", chat_format.json_paths(F.try_parse_json("record")).alias("p")).collect()}
    assert got == dict(enumerate(records.values()))


def test_records_without_a_layout_stay_as_nulls(spark):
    rows = [(1, '{"other": 1}', "x"), (2, '{"messages": []}', "x"), (3, '{"prompt": "a", "completion": "b"}', "x")]
    made = chat_format.canonical_json(spark.createDataFrame(rows, "conv_id long, record string, layout string"))
    got = {r.conv_id: (r.n_turns, r.formatted_chars, r.loss_chars) for r in chat_format.digest(chat_format.render(made.select("conv_id", "turns"))).collect()}
    assert got[1] == (None, None, None) and got[2] == (0, 7, 0) and got[3][0] == 2
