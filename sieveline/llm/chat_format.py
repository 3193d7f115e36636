"""Chat formatting; DataFrame and SQL functions only.

Records come in many layouts. A layout's fingerprint is the SHA-256 of its sorted nested field paths; ``LAYOUTS`` maps
fingerprints to declarative mappings that give canonical turns, an array of (role, text); a layout with further fields takes the
mapping whose paths it contains. Tables with typed columns are fingerprinted once by their schema, JSON records row by row by the
schema of their variant value, at any depth. Records that no mapping fits keep null turns, and so null outputs, through the template.

The template writes ``<s>``, then for each turn ``<|im_start|>role<|im_sep|>text<|im_end|>``, then ``</s>``. Roles and texts
are escaped: after the first sign of anything that reads as a control string (of this template or the common ones) one
more escape sign U+001B is put; unescaping takes one away, so texts that hold escape signs themselves survive too.
The loss mask lies on the formatted text's segments: ``segments`` joined are ``formatted``, and ``loss`` says of each
whether a model is trained on it (the assistants' texts).

Null texts and roles count as empty. Turns are ordered by turn, then role, then text, nulls first, so ties and repeated
rows have one defined order. A conversation without an assistant has an empty loss text. Rows with a null conv_id form
one conversation of their own. A conversation is one output row, so it has to fit into a task; no others meet there.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import unused

START, SEP, END, BOS, EOS = "<|im_start|>", "<|im_sep|>", "<|im_end|>", "<s>", "</s>"
ESC = "\x1b"
#: Control strings of this template and of the common ones, after their first sign.
_ANGLE = r"/?s>|\|[^|<>]*\|>|</?SYS>>|(?:unk|pad|bos|eos|start_of_turn|end_of_turn)>"
_SQUARE = r"/?INST\]"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, rf"(<{ESC}*)(?={_ANGLE})|(\[{ESC}*)(?={_SQUARE})", "$1$2" + ESC)


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, rf"(<{ESC}*){ESC}(?={_ANGLE})|(\[{ESC}*){ESC}(?={_SQUARE})", "$1$2")


# layouts -----------------------------------------------------------------------------------------------------------


def paths(kind: T.DataType, at: str = "") -> list[str]:
    """Nested field paths of a type; arrays are marked, leaf types don't count."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return paths(kind.elementType, at + "[]")
    return [at]


def fingerprint(names: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(names)).encode()).hexdigest()


def _turn(role, text) -> Column:
    as_column = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(F.coalesce(as_column(role), F.lit("")).alias("role"), F.coalesce(as_column(text), F.lit("")).alias("text"))


def _listed(field: str, role: str, text: str, names: dict[str, str] | None = None) -> dict:
    return {"paths": [f"{field}[].{role}", f"{field}[].{text}"], "list": (field, role, text, names or {})}


_FROM = {"human": "user", "gpt": "assistant", "bot": "assistant"}
#: Mappings by name: either a list of turns, or fixed (role, fields) pairs whose empty parts are left out.
MAPPINGS: dict[str, dict] = {
    "messages": _listed("messages", "role", "content"),
    "turns": _listed("turns", "role", "text"),
    "sharegpt": _listed("conversations", "from", "value", _FROM),
    "dialog": _listed("dialog", "speaker", "text", _FROM),
    "prompt_completion": {"paths": ["prompt", "completion"], "pairs": [("user", ["prompt"]), ("assistant", ["completion"])]},
    "prompt_response": {"paths": ["prompt", "response"], "pairs": [("user", ["prompt"]), ("assistant", ["response"])]},
    "question_answer": {"paths": ["question", "answer"], "pairs": [("user", ["question"]), ("assistant", ["answer"])]},
    "instruction": {"paths": ["instruction", "input", "output"], "pairs": [("user", ["instruction", "input"]), ("assistant", ["output"])]},
    "instruction_plain": {"paths": ["instruction", "output"], "pairs": [("user", ["instruction"]), ("assistant", ["output"])]},
    "system_instruction": {"paths": ["system", "instruction", "output"], "pairs": [("system", ["system"]), ("user", ["instruction"]), ("assistant", ["output"])]},
}
LAYOUTS = {fingerprint(m["paths"]): name for name, m in MAPPINGS.items()}


def json_paths(value: Column) -> Column:
    """The sorted field paths of a variant, at any depth: its schema string is read token by token, with a stack of open objects and
    arrays. Empty objects have no path; an array's is marked as in ``paths``. Null for a null variant."""
    tokens = F.regexp_extract_all(F.schema_of_variant(value), F.lit(r"`(?:[^`]|``)*`: |[^<>,: ]+: |OBJECT<|ARRAY<|>|[A-Z_]+(?:\([0-9,]+\))?"), F.lit(0))
    texts_ = "array<string>"
    start = F.struct(F.array(F.lit("")).alias("stack"), F.lit("").alias("name"), F.array().cast(texts_).alias("paths"))

    def read(state: Column, token: Column) -> Column:
        top = F.element_at(state["stack"], -1)
        here = F.when(state["name"] == "", top).when(top == "", state["name"]).otherwise(F.concat(top, F.lit("."), state["name"]))
        bare = F.substr(token, F.lit(1), F.length(token) - 2)
        name = F.when(bare.startswith("`"), F.replace(F.substr(bare, F.lit(2), F.length(bare) - 2), F.lit("``"), F.lit("`"))).otherwise(bare)
        named, opens, closes = token.endswith(": "), token.isin("OBJECT<", "ARRAY<"), token == ">"
        inner = F.when(token == "ARRAY<", F.concat(here, F.lit("[]"))).otherwise(here)
        stack = F.when(opens, F.concat(state["stack"], F.array(inner))).when(closes, F.slice(state["stack"], F.lit(1), F.size(state["stack"]) - 1)).otherwise(state["stack"])
        found = F.when(named | opens | closes, state["paths"]).otherwise(F.concat(state["paths"], F.array(here)))
        return F.struct(stack.alias("stack"), F.when(named, name).otherwise("").alias("name"), found.alias("paths"))

    return F.aggregate(tokens, start, read, lambda s: F.array_sort(s["paths"]))


def json_fingerprint(value: Column) -> Column:
    return F.sha2(F.array_join(json_paths(value), "\n"), 256)


def _has(own: Column, path: str) -> Column:
    """Whether a record has a path, or further ones below it (a text may be an object with a text, or a list of such parts)."""
    return F.exists(own, lambda p: (p == path) | (p == path + ".text") | (p == path + "[].text"))


def fits(own: Column, name: str) -> Column:
    """Whether a record's paths hold those of a mapping, whatever others there are. An empty list of turns fits too."""
    m = MAPPINGS[name]
    every = F.lit(True)
    for p in m["paths"]:
        every = every & (_has(own, p) if "list" in m else F.array_contains(own, p))
    return every | F.array_contains(own, f"{m['list'][0]}[]") if "list" in m else every


def widest(own: Column) -> Column:
    """The mapping with the most paths of those whose paths a record has; null if several have equally many."""
    fitting = F.filter(F.array(*[F.when(fits(own, name), F.struct(F.lit(len(m["paths"])).alias("n"), F.lit(name).alias("name"))) for name, m in MAPPINGS.items()]), lambda x: x.isNotNull())
    most = F.filter(fitting, lambda x: x["n"] == F.array_max(fitting)["n"])
    return F.when(F.size(most) == 1, F.get(most, F.lit(0))["name"])


def _text(item: Column, field: str) -> Column:
    """A turn's text: a plain value, an object's text, or the texts of a list of parts, two line ends between them."""
    plain = F.try_variant_get(item, f"$.{field}", "variant")
    parts = F.transform(F.try_variant_get(item, f"$.{field}", "array<variant>"), lambda p: F.coalesce(F.try_variant_get(p, "$.text", "string"), F.lit("")))
    kind = F.schema_of_variant(plain)
    return F.when(kind.startswith("OBJECT<"), F.try_variant_get(item, f"$.{field}.text", "string")).when(kind.startswith("ARRAY<"), F.array_join(parts, "\n\n")).otherwise(F.try_variant_get(item, f"$.{field}", "string"))


def turns_of(value: Column, name: str) -> Column:
    """The canonical turns of a variant record by one mapping."""
    m = MAPPINGS[name]
    if "list" in m:
        field, role, text, names = m["list"]
        rows = F.try_variant_get(value, f"$.{field}", "array<variant>")

        def turn(x: Column) -> Column:
            who = given = F.try_variant_get(x, f"$.{role}", "string")
            for a, b in names.items():
                who = F.when(given == a, b).otherwise(who)
            return _turn(who, _text(x, text))

        return F.transform(rows, turn)
    made = []
    for role, fields in m["pairs"]:
        given = F.filter(F.array(*[F.try_variant_get(value, f"$.{f}", "string") for f in fields]), lambda x: x.isNotNull() & (x != ""))
        made.append(F.when(F.size(given) > 0, _turn(role, F.array_join(given, "\n\n"))))
    return F.filter(F.array(*made), lambda x: x.isNotNull())


def canonical_json(records: DataFrame, column: str = "record") -> DataFrame:
    """``records`` with ``layout`` (null if no mapping fits or the JSON is broken) and ``turns`` (null likewise).

    A record without a known fingerprint takes the mapping with the most paths of those whose paths it has; its further fields, of
    the record or of the turns, don't belong to the layout. If several have equally many, none is taken. A turn that lacks
    a field has it empty. Columns of ``records`` that are called layout or turns are replaced.
    """
    v, p = unused(records, "variant_value"), unused(records, "field_paths")
    known = records.withColumn(v, F.try_parse_json(F.col(column))).withColumn(p, json_paths(F.col(v)))
    by_print = F.create_map(*[F.lit(x) for pair in LAYOUTS.items() for x in pair])
    layout = F.coalesce(F.try_element_at(by_print, F.sha2(F.array_join(F.col(p), "\n"), 256)), widest(F.col(p)))
    with_layout = known.withColumn("layout", layout)
    turns = F.lit(None).cast("array<struct<role:string,text:string>>")
    for name in MAPPINGS:
        turns = F.when(F.col("layout") == name, turns_of(F.col(v), name)).otherwise(turns)
    return with_layout.withColumn("turns", turns).drop(v, p)


#: Typed turn tables: field names of key, order, role and text, by fingerprint.
TABLES = {fingerprint(list(x)): x for x in (("conv_id", "turn", "role", "text"), ("id", "turn", "role", "content"), ("conversation_id", "position", "speaker", "message"))}


def canonical_table(rows: DataFrame) -> DataFrame:
    """conv_id and turns of a turn table whose fingerprint is known; further columns don't belong to a layout's own."""
    own = set(paths(rows.schema))
    print_ = next((f for f, x in TABLES.items() if own == set(x)), None) or next((f for f, x in TABLES.items() if own >= set(x)), None)
    if print_ is None:
        raise ValueError(f"no layout for the fields {sorted(own)}")
    key, order, role, text = TABLES[print_]
    turn = F.struct(F.col(order).alias("turn"), *(F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((role, "role"), (text, "text"))))
    grouped = rows.groupBy(F.col(key).alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return grouped.withColumn("turns", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))


# template ----------------------------------------------------------------------------------------------------------


def render(canonical: DataFrame) -> DataFrame:
    """Adds segments, loss and formatted to rows with turns."""
    escaped = F.transform("turns", lambda t: F.struct(escape(t["role"]).alias("role"), escape(t["text"]).alias("text"), (t["role"] == "assistant").alias("loss")))
    head = lambda t: F.concat(F.lit(START), t["role"], F.lit(SEP))
    e = unused(canonical, "escaped")
    inner = F.flatten(F.transform(e, lambda t: F.array(head(t), t["text"], F.lit(END))))
    masks = F.flatten(F.transform(e, lambda t: F.array(F.lit(False), t["loss"], F.lit(False))))
    return (
        canonical.withColumn(e, escaped)
        .withColumn("segments", F.concat(F.array(F.lit(BOS)), inner, F.array(F.lit(EOS))))
        .withColumn("loss", F.concat(F.array(F.lit(False)), masks, F.array(F.lit(False))))
        .withColumn("formatted", F.array_join("segments", ""))
        .drop(e, "turns")
    )


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation."""
    body = F.substr(formatted, F.lit(len(BOS) + 1), F.length(formatted) - len(BOS) - len(EOS))
    each = F.slice(F.split(body, f"\\Q{START}\\E"), F.lit(2), F.greatest(F.size(F.split(body, f"\\Q{START}\\E")) - 1, F.lit(0)))

    def turn(x: Column) -> Column:
        both = F.split(F.substr(x, F.lit(1), F.length(x) - len(END)), f"\\Q{SEP}\\E")
        return F.struct(unescape(both[0]).alias("role"), unescape(both[1]).alias("text"))

    return F.transform(each, turn)


def loss_text(segments: Column, loss: Column) -> Column:
    """All text under the mask, unescaped."""
    under = F.filter(F.arrays_zip(segments.alias("segment"), loss.alias("loss")), lambda x: x["loss"])
    return F.array_join(F.transform(under, lambda x: unescape(x["segment"])), "")


def digest(formatted: DataFrame) -> DataFrame:
    """conv_id and figures that are read back from the formatted output."""
    back = formatted.select("conv_id", "formatted", read_back(F.col("formatted")).alias("t"), loss_text(F.col("segments"), F.col("loss")).alias("l"))
    lines = F.array_join(F.transform("t", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("t").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.length("l").cast("long").alias("loss_chars"),
        F.sha2("l", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and conversation -7, which comes as a JSON record in another layout."""
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    said = "</s>[INST] ok [/INST]"
    record = f'{{"messages": [{{"role": "user", "content": "{said}"}}, {{"role": "assistant", "content": "{said}"}}]}}'
    more = canonical_json(spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.lit(record).alias("record"))).select("conv_id", "turns")
    return digest(render(canonical_table(table).unionByName(more)))


_MARKS = r"</?s>|\[/?INST\]|<\|[^|<>]*\|>|<</?SYS>>|<(unk|pad|bos|eos|start_of_turn|end_of_turn)>"
OP4_SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, t, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(t, r)),
e AS (SELECT *, len(regexp_extract_all(role, '{_MARKS}')) + len(regexp_extract_all(text, '{_MARKS}')) AS marks FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST({len(BOS + EOS)} + sum({len(START + SEP + END)} + length(role) + length(text) + marks) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
