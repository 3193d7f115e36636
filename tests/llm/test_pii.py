import hashlib
import random
import re

import pytest

from sieveline.llm import pii


@pytest.fixture(scope="module")
def field():
    return pii.field()


def plain(text):
    """The contract's patterns as they are written."""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        if 14 <= len(d) <= 19 and pii.luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_base_spans_equal_the_written_patterns():
    rng = random.Random(2)
    for alphabet in ("a@.-b1 ", "0123456789 -", "+12 (34).-\n", "1.2.34", "a.1@b-+2 é٣"):
        for _ in range(4000):
            t = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))
            assert pii.base_spans(t) == plain(t), t
    card = "4111 1111-1111 1111"
    assert pii.base_spans(f"é {card}") == [("card", 2, 21)] and pii.luhn("4111111111111111")
    assert pii.base_spans("000001.2.3.4") == [("ip", 0, 12)]


def test_very_long_texts_take_linear_time(field):
    for t in ("a" * 400_000, "1" * 400_000, "1.1." * 50_000, "a@" * 100_000, "+1" + "." * 300_000, "@" + "a-" * 200_000):
        pii.base_spans(t)
    pii.spans_of("1 " * 3_000 + "x " * 100_000, field)


def test_secrets_of_any_length(field):
    rng = random.Random(4)
    for n in (90, 128, 200, 600):
        key = "".join(rng.choice("0123456789abcdef") for _ in range(n - 2)) + "7a"
        for before, after in (('token = "', '"'), ("api_key: ", " and more"), ("first line 12\nsecret=", "\n3 lines")):
            text = f"the on {before}{key}{after}"
            at = text.index(key)
            assert ("secret", at, at + n) in pii.spans_of(text, field)[1]


def test_long_spans_are_candidates():
    email = "a" * 90 + " [at] mail [dot] example [dot] com"
    tokens, spans = pii.segments(email, *pii.stretches(email)[0])
    assert (0, len(email)) in [(tokens[i][0], tokens[j - 1][1]) for i, j in spans]


def test_field_on_unseen_snippets(field):
    tp = fp = fn = 0
    for text, gold in pii.snippets(600, seed=991):
        got = {e for lo, hi in pii.stretches(text) for e in field.best(text, lo, hi)}
        tp, fp, fn = tp + len(got & set(gold)), fp + len(got - set(gold)), fn + len(set(gold) - got)
    assert tp / (tp + fp) > 0.95 and tp / (tp + fn) > 0.95


def test_decoding_is_the_best_of_all_segmentations(field):
    import itertools

    for text, _ in pii.snippets(60, seed=17):
        for lo, hi in pii.stretches(text):
            tokens, spans = pii.segments(text, lo, hi)
            if not 0 < len(tokens) <= 9:
                continue
            s = field.scores(text, tokens, spans)

            def best(at, last):
                if at == len(tokens):
                    return 0.0
                found = [field.follow[last, 0] + best(at + 1, 0)]
                for k, (i, j) in enumerate(spans):
                    if i == at:
                        found += [field.follow[last, c + 1] + s[k, c] + best(j, c + 1) for c in range(len(pii.KINDS))]
                return max(found)

            value, at, last = 0.0, 0, 0
            chosen = {tokens_at: (k, e) for k, a, b in field.best(text, lo, hi) for tokens_at, e in [(next(i for i, t in enumerate(tokens) if t[0] == a), next(i + 1 for i, t in enumerate(tokens) if t[1] == b))]}
            while at < len(tokens):
                if at in chosen:
                    kind, e = chosen[at]
                    c = pii.KINDS.index(kind)
                    value += field.follow[last, c + 1] + s[spans.index((at, e)), c]
                    at, last = e, c + 1
                else:
                    value += field.follow[last, 0]
                    at, last = at + 1, 0
            assert abs(value - best(0, 0)) < 1e-9
    assert itertools


def test_documents_and_masks(spark, field):
    mail = "Write to ann.lee@mail.example.com or 10.0.0.1."
    rows = [(1, mail, 1), (2, None, 2), (3, "", 3), (4, mail, 4), (4, mail, 4), (None, 'token = "2abc3ff2ca8fb1e4c565a0eb63815530a948bdde"', 0), (5, "A clean text of 12 words.", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars int").withColumnRenamed("n_chars", "n_chars")
    out = pii.find_pii(df, field).collect()
    assert len(out) == len(rows)
    for r in out:
        text = next(t for i, t, _ in rows if i == r.doc_id) or ""
        assert r.base_sha256 == hashlib.sha256(pii.joined(plain(text)).encode()).hexdigest()
        assert set(pii.joined(plain(text)).split(",")) - {""} <= set(r.spans.split(","))
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == ((1, 1, 0, 0) if text == mail else (0, 0, 0, 0))
    assert {r.doc_id: r.spans for r in out}[None].startswith("secret:9:")
    new = {(r.doc_id, r.text, r.n_chars) for r in pii.mask(df, field).collect()}
    want = "Write to [EMAIL] or [IP]."
    assert new == {(1, want, len(want)), (2, None, None), (3, "", 0), (4, want, len(want)), (None, 'token = "[SECRET]"', 18), (5, "A clean text of 12 words.", 25)}
    assert pii.mask(df, field).columns == df.columns and pii.find_pii(df.where("false"), field).count() == 0
