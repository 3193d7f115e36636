"""Evidence of matches against brute force."""

import re
import unicodedata

from pyspark.sql import functions as F

from sieveline.functions import text as X
from sieveline.operators import matching as M
from sieveline.plans import queries as Q


def indexed(text):
    """The match form, sign by sign, and each of its signs' place in the source."""
    made = [(c, i) for i, sign in enumerate(text) for c in unicodedata.normalize("NFKC", sign).lower() if not c.isspace() and c not in ",，"]
    return {"norm": "".join(c for c, _ in made), "idx": [i for _, i in made]}


def span(text, variants):
    """(begin, end) in the source, both included, of the first spelling that the normalised text holds."""
    n = indexed(text)
    for v in variants:
        at = n["norm"].find(v)
        if v and at >= 0:
            return n["idx"][at], n["idx"][at + len(v) - 1]
    return None


def around(text, begin, end):
    return text[max(0, begin - 120) : end + 121]


def test_query_has_evidence_for_every_hit(spark, tmp_path):
    said = "Alpha Beta Gamma delta X omega"  # query 1; its first 24 signs are the first key, omega the last one
    docs = [
        (1, "src1", "x , " * 60 + "ALPHA  beta,\nga mma DELTA, x " + "y z " * 60),  # the index map moves both ends
        (2, "src1", "omega first"),
        (3, "src1", "\U0001f600 " * 90 + "costs 1,234.50 in all" + " ﬁn" * 90),  # the price, by its number
        (4, "src1", "n o " * 90),
        (5, "src1", ""),
    ]
    put = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    put(docs, "doc_id long, source string, text string", "documents")
    put([(1, said)], "item_id long, text string", "benchmark")
    put([(2, 1234.5)], "p_partkey long, p_retailprice double", "part")
    got = {r.doc_id: r for r in Q.QUERIES["match_evidence"](spark, str(tmp_path)).collect()}
    assert sorted(got) == [d for d, *_ in docs]
    keys = [["alphabetagammadeltax"], ["1234.50元", "1234.50", "1234.5", "0.12345", "1.2345e-05"], ["omega"]]
    for d, _, text in docs:
        at = next((s for k in keys if (s := span(text, k))), None)
        assert got[d].is_match == (at is not None) and got[d].match_type == ("exact" if at else "none")
        want = around(text, *at) + " [unit_inferred=元]" if at else text[:200]
        assert got[d].evidence == want
    assert [got[d].is_match for d in (1, 2, 3, 4, 5)] == [True, True, True, False, False]


def brute(text, keys):
    """match_type, matched keys, unit and evidence, key by key; keys: (source, spellings, unit, wants mail)."""
    if not indexed(text)["norm"] or not keys:
        return "none", [], None, ""
    matched, kind, first = [], "none", None
    for source, variants, _, mail in keys:
        if at := span(text, variants):
            matched, kind, first = [*matched, source], "exact", first or at
        elif not matched and mail and (m := re.search(r"[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}", text, re.I)):
            matched, kind, first = [source], "regex", (m.start(), m.end() - 1)
    unit = next((u for _, _, u, _ in keys if u), None)
    if not first:
        return "none", [], unit, text[:200]
    return kind, matched, unit, around(text, *first) + (f" [unit_inferred={unit}]" if unit else "")


def test_mail_context_units_and_keys(spark):
    mail, name, rate = ("电子信箱", ["x@y.com"], None, True), ("name", ["acme"], None, False), ("rate", ["12.5%", "12.5", "0.125"], "%", False)
    keys = {1: [mail, name, rate], 2: [name, mail], 3: []}
    far = "\U0001f600 filler " * 40
    texts = {1: f"{far}write to a@b.org or a@b.org {far}", 2: f"ACME {far} mail to a@b.org {far}", 3: f"{far} a@b.org {far} acme {far}", 4: far, 5: " , ", 6: None, 7: f"{far}12.5 in {far}"}
    hits = spark.createDataFrame([(q, d, d, 0.1) for q in keys for d in [*texts, 8]], "query_id long, doc_id long, rank int, score double")
    value = {"电子信箱": "x@y.com", "name": "Acme", "rate": "12.5％"}
    rows = [(q, k, value[s], s) for q, ks in keys.items() for k, (s, *_) in enumerate(ks)]
    out = M.match(hits, spark.createDataFrame(list(texts.items()), "doc_id long, text string"), spark.createDataFrame(rows, "query_id long, pos int, value string, source string"))
    got = {(r.query_id, r.doc_id): (r.match_type, r.matched_keys, r.unit_inferred, r.evidence) for r in out.collect()}
    assert got == {(q, d): brute(texts.get(d) or "", keys[q]) for q in keys for d in [*texts, 8]}
    assert got[1, 3][:2] == ("exact", ["电子信箱", "name"]) and got[1, 3][3].endswith("[unit_inferred=%]") and "a@b.org" in got[1, 3][3]
    mined = {r.pos_id: r.evidence for r in M.mine(out).where("query_id = 1").collect()}
    assert mined and all(e == got[1, d][3][:300] for d, e in mined.items())


def test_match_forms_of_all_kinds_of_text(spark):
    texts = ["", None, "Plain, ASCII\ttext\x1c here\n", "ｆｕｌｌ，width １２％", "ﬁne  print", "é ñ", "中 文，字", "A" * 50_000 + "é", "\u200a\u3000x"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(X.match_form(F.col("t"))).collect()]
    assert got == [indexed(t or "")["norm"] for t in texts]
    n = [r[0] for r in df.orderBy("i").select(X.nfkc(F.col("t"))).collect()]
    assert n == [t if t is None else unicodedata.normalize("NFKC", t) for t in texts]
