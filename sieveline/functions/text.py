"""Scalar functions over text and numbers. Built-in expressions, but for NFKC and Python's ``%g``, which Spark lacks."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN_SPLIT = r"[^\p{L}\p{N}]+"


_ASCII = r"^\p{ASCII}*$"


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def nfkc(s: Column) -> Column:
    """NFKC; ASCII text has that form, so only other text goes to Python."""
    ascii_ = s.rlike(_ASCII)
    return F.when(ascii_, s).otherwise(_nfkc(F.when(~ascii_, s)))


@F.pandas_udf(T.StringType())
def format_number(v: pd.Series) -> pd.Series:
    """0 is "0"; from 1 on six significant digits, below it eight, trailing zeros stripped."""
    return v.map(lambda x: None if pd.isna(x) else "0" if x == 0 else f"{x:.6g}" if abs(x) >= 1 else f"{x:.8g}")


class _Signs(dict):
    """Code point -> what it counts as in matching: NFKC of the sign alone, lower case, nothing for blanks and commas."""

    def __missing__(self, code: int) -> str:
        made = self[code] = "".join(c for c in unicodedata.normalize("NFKC", chr(code)).lower() if not c.isspace() and c not in ",，")
        return made


_signs = _Signs()


@F.pandas_udf(T.StringType())
def _match_form(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else x.translate(_signs))


def match_form(s: Column) -> Column:
    """Per-character NFKC, lower case, without blanks and commas: what spellings are looked for in. Null is empty."""
    s = F.coalesce(s, F.lit(""))
    ascii_ = s.rlike(_ASCII)
    return F.when(ascii_, F.lower(F.regexp_replace(s, r"[\s\x1c-\x1f,]+", ""))).otherwise(_match_form(F.when(~ascii_, s)))


@F.pandas_udf(T.StructType([T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType())]))
def source_span(s: pd.Series, at: pd.Series, length: pd.Series) -> pd.DataFrame:
    """First and last place (from 0) in the source of ``length`` signs from place ``at`` (from 1) of its match form; null for null."""
    out = []
    for text, start, n in zip(s, at, length, strict=True):
        if text is None:
            out.append((None, None))
            continue
        upto, begin, last = 0, None, int(start) - 1 + int(n)
        for i, c in enumerate(text):
            upto += len(_signs[ord(c)])
            if begin is None and upto >= start:
                begin = i
            if upto >= last:
                break
        out.append((begin, i))
    return pd.DataFrame(out, columns=["begin", "end"]).astype("Int32")


def for_match(s: Column, unicode_forms: bool = True) -> Column:
    s = F.coalesce(s, F.lit(""))
    return F.regexp_replace(F.lower(nfkc(s) if unicode_forms else s), r"(?U)\s+", "")


def for_bm25(s: Column, unicode_forms: bool = True) -> Column:
    s = F.coalesce(s, F.lit(""))
    return F.trim(F.regexp_replace(nfkc(s) if unicode_forms else s, r"(?U)\s+", " "))


def tokens(s: Column) -> Column:
    """The default tokenizer: lower-cased runs of letters and numbers."""
    return F.array_remove(F.split(F.lower(F.coalesce(s, F.lit(""))), TOKEN_SPLIT), "")


def cjk_tokens(s: Column) -> Column:
    """Runs of other letters and numbers, single ideographs, and pairs of neighbouring ideographs."""
    words = F.regexp_extract_all(F.lower(F.coalesce(s, F.lit(""))), F.lit(r"[\p{IsHan}]|[\p{L}\p{N}&&[^\p{IsHan}]]+"), F.lit(0))
    runs = F.regexp_extract_all(F.coalesce(s, F.lit("")), F.lit(r"\p{IsHan}{2,}"), F.lit(0))
    pairs = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substr(r, i, F.lit(2)))))
    return F.concat(words, pairs)


def without_commas(s: Column) -> Column:
    return F.translate(s, ",，", "")


def number_text(raw: Column, unicode_forms: bool = True) -> Column:
    """The first number in a value, or an empty string."""
    return F.regexp_extract(without_commas(for_match(raw, unicode_forms)), r"[-+]?[0-9]+(?:\.[0-9]+)?", 0)


def number(raw: Column, unicode_forms: bool = True) -> Column:
    """Value of the first number; the raw string's units multiply it, a percent sign of any width divides it by 100. Null without one."""
    v = F.expr("1D") * F.nullif(number_text(raw, unicode_forms), F.lit("")).try_cast("double")
    v = v * F.when(raw.contains("亿"), 1e8).when(raw.contains("万"), 1e4).otherwise(1.0)
    return F.when(for_match(raw, unicode_forms).contains("%"), v / 100).otherwise(v)


def unit(raw: Column, unicode_forms: bool = True) -> Column:
    return F.when(for_match(raw, unicode_forms).contains("%"), "%").when(raw.contains("亿"), "亿").when(raw.contains("万"), "万").when(raw.contains("元"), "元")


def variants(raw: Column, unicode_forms: bool = True) -> Column:
    """Distinct spellings, in order: normalised, first number, and the value in ones, ten thousands, hundred millions."""
    v, text = number(raw, unicode_forms), number_text(raw, unicode_forms)
    spelled = [F.when(v.isNotNull(), format_number(v / d)) for d in (1, 1e4, 1e8)]
    made = F.array(for_match(raw, unicode_forms), F.when(v.isNotNull(), text), *spelled)
    return F.array_distinct(F.filter(made, lambda x: x.isNotNull() & (x != "")))


def is_stable_key(v: Column) -> Column:
    """An address, a URL, anything with a digit, or at most 64 characters."""
    return v.rlike(r"(?i)[\w.+-]+@[\w-]+\.\w+|https?://|www\.|[0-9]") | (F.length(v) <= 64)


def stem(p: Column) -> Column:
    """A path's last part without its last suffix."""
    return F.regexp_replace(F.element_at(F.split(p, "/"), -1), r"(?<=.)\.[^.]+$", "")


def normal_id(x: Column) -> Column:
    """Integers in one spelling, other ids as they are."""
    return F.coalesce(F.trim(x).try_cast("bigint").cast("string"), x)


def canonical_label(x: Column) -> Column:
    s = F.lower(F.trim(x))
    return F.when(s.startswith("evid"), "evidence").when(s.startswith("rel"), "related").when(s.startswith("irr"), "irrelevant")


def candidate_key(chunk: Column, rank: Column, idx: Column) -> Column:
    chunk = F.nullif(chunk, F.lit(""))
    return F.when(chunk.isNotNull() & rank.isNotNull(), F.concat_ws("|", chunk, rank.cast("string"))).when(rank.isNotNull(), F.concat(F.lit("rank:"), rank.cast("string"))).otherwise(F.concat(F.lit("idx:"), idx.cast("string")))


def repaired_json(s: Column) -> Column:
    """A model's answer as a variant: without code fence, whole, or the outermost list or object in it; else null."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(s), r"^```\w*\s*|\s*```$", ""), r"^json\s*", ""))
    return F.coalesce(F.try_parse_json(bare), F.try_parse_json(F.nullif(F.regexp_extract(bare, r"(?s)\[.*\]", 0), F.lit(""))), F.try_parse_json(F.nullif(F.regexp_extract(bare, r"(?s)\{.*\}", 0), F.lit(""))))


def label_items(v: Column, strict: bool = False) -> Column:
    """A list, or the one under items or results, as array of (index, label, notes) with canonical labels.

    Invalid items go; if ``strict``, one of them, or anything else than a list, is an error.
    """
    kind = "array<struct<index string, label string, notes string>>"
    rows = F.coalesce(F.try_variant_get(v, "$", kind), F.try_variant_get(v, "$.items", kind), F.try_variant_get(v, "$.results", kind))
    typed = F.transform(rows, lambda x: F.struct(F.trim(x["index"]).try_cast("int").alias("index"), canonical_label(x["label"]).alias("label"), F.coalesce(x["notes"], F.lit("")).alias("notes")))
    valid = F.filter(typed, lambda x: x["index"].isNotNull() & x["label"].isNotNull())
    if not strict:
        return valid
    broken = v.isNotNull() & (typed.isNull() | (F.size(valid) != F.size(typed)))
    return F.when(broken, F.raise_error(F.lit("not a list of index and label")).cast("array<struct<index:int,label:string,notes:string>>")).otherwise(valid)


def batches(items: Column, size: int) -> Column:
    n = F.ceil(F.size(items) / F.lit(size)).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(items, i * size + 1, F.lit(size)))).otherwise(F.array().cast("array<array<string>>"))


def truncated(s: Column, n: int) -> Column:
    """Marked where it was cut; 0 leaves the text whole."""
    return F.when(F.length(s) > n, F.concat(F.substring(s, 1, n), F.lit(" ...[truncated]"))).otherwise(s) if n else s


def prompt(query: Column, answers: Column, items: Column) -> Column:
    """An annotation request: query, answers, rules, and numbered candidates."""
    listed = F.array_join(F.transform(items, lambda x, i: F.concat(F.lit("["), i.cast("string"), F.lit("] "), x)), "\n")
    rules = "Labels: evidence (answers the query), related (on its subject), irrelevant. Reply with a JSON list of index, label, notes."
    return F.concat_ws("\n", F.concat(F.lit("Query: "), query), F.concat(F.lit("Answers: "), F.array_join(answers, "; ")), F.lit(rules), listed)


def slug(*parts: Column | str) -> Column:
    joined = F.concat_ws("-", *(F.lit(p) if isinstance(p, str) else p for p in parts))
    return F.translate(F.lower(joined), "/ @", "---")


def logit_score(logits: Column, labels: dict[int, str] | None = None) -> Column:
    """One logit as it is; of two the difference yes - no, or pos - neg, where the labels have such names, else the second; of more the
    first."""
    place = {v.lower(): k for k, v in (labels or {}).items()}
    pair = next(((place[a], place[b]) for a, b in (("yes", "no"), ("pos", "neg")) if a in place and b in place), None)
    at = lambda i: F.get(logits, F.lit(i))
    return F.when(F.size(logits) == 2, at(pair[0]) - at(pair[1]) if pair else at(1)).otherwise(at(0))
