"""Chat formatting: schema fingerprints select declarative mappings. DataFrame functions only.

A layout is known by the hash of its sorted nested field paths. A table's schema, or each
JSON row with its own fields (those of all elements of a list), has the first layout of
``LAYOUTS`` all of whose paths it holds, so further fields don't matter, whatever their
names: the fingerprint of the paths that the two have in common is the layout's. It selects a
declarative mapping, a SQL expression that turns
prompt, instruction, message or one-row-per-turn layouts into canonical turns
``array<struct<role, text>>``.

Turns are written as ``<|im_start|>role\\ntext<|im_end|>\\n``. Control strings inside
texts (those of this template and of other common ones) are broken up by a backslash
after their first character and backslashes are doubled, which ``parse`` undoes. The
loss mask names the assistant texts as code-point spans within each formatted turn.

Defined results: a null role or text is empty; turns are ordered by turn, then role,
then text (null first), so ties have one order and repeated rows are repeated turns; a
null conversation id is one conversation. Rows of an unknown layout have null turns.
An empty table gives no rows. Very long texts are escaped whole. A conversation is one value, so its turns meet in one row
(the digest over all of its turns needs that); there is no other grouping.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END = "<|im_start|>", "<|im_end|>\n"
#: What must not stand in a text: control strings of this and other public templates.
CONTROL = r"(<(?=\|[A-Za-z0-9_]+\|>|/?s>|</?SYS>>)|\[(?=/?INST\]))"
TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """Field paths, the schema of those fields, and the expression that maps them to turns."""

    name: str
    paths: tuple[str, ...]
    schema: str
    turns: str
    by_row: bool = False  # one row for each turn: the expression sums up a conversation's rows


def _turn(role: str, text: str) -> str:
    return f"named_struct('role', {role}, 'text', cast({text} as string))"


def _optional(role: str, text: str) -> str:
    return f"if(coalesce({text}, '') = '', array(), array({_turn(role, text)}))"


_SHARE_ROLES = "case m.`from` when 'human' then 'user' when 'gpt' then 'assistant' else m.`from` end"
_INSTRUCT = "if(coalesce(input, '') = '', instruction, concat(instruction, '\\n\\n', input))"
#: In the order in which they are tried: the first of which a row has all fields counts.
LAYOUTS = [
    Layout("turn rows", ("role", "text", "turn"), "",
           f"transform(array_sort(collect_list(named_struct('turn', turn, 'role', coalesce(role, ''), 'text', coalesce(text, '')))), "
           f"t -> {_turn('t.role', 't.text')})", by_row=True),
    Layout("messages", ("messages[].content", "messages[].role"), "messages array<struct<role:string,content:string>>",
           f"transform(messages, m -> {_turn('m.role', 'm.content')})"),
    Layout("share", ("conversations[].from", "conversations[].value"),
           "conversations array<struct<`from`:string,value:string>>",
           f"transform(conversations, m -> {_turn(_SHARE_ROLES, 'm.value')})"),
    Layout("system, question and response", ("question", "response", "system_prompt"),
           "system_prompt string, question string, response string",
           f"concat({_optional(repr('system'), 'system_prompt')}, array({_turn(repr('user'), 'question')}, "
           f"{_turn(repr('assistant'), 'response')}))"),
    Layout("instruction with input", ("input", "instruction", "output"), "instruction string, input string, output string",
           f"array({_turn(repr('user'), _INSTRUCT)}, {_turn(repr('assistant'), 'output')})"),
    Layout("instruction", ("instruction", "output"), "instruction string, output string",
           f"array({_turn(repr('user'), 'instruction')}, {_turn(repr('assistant'), 'output')})"),
    Layout("question and answer", ("answer", "question"), "question string, answer string",
           f"array({_turn(repr('user'), 'question')}, {_turn(repr('assistant'), 'answer')})"),
    Layout("prompt and completion", ("completion", "prompt"), "prompt string, completion string",
           f"array({_turn(repr('user'), 'prompt')}, {_turn(repr('assistant'), 'completion')})"),
    Layout("prompt and response", ("prompt", "response"), "prompt string, response string",
           f"array({_turn(repr('user'), 'prompt')}, {_turn(repr('assistant'), 'response')})"),
]
KNOWN_PATHS = sorted({p for layout in LAYOUTS for p in layout.paths})


def fingerprint(paths) -> int:
    """Hash of sorted field paths; the same as Spark's xxhash64 of the joined string."""
    code = xxhash.xxh64_intdigest("|".join(sorted(paths)), 42)
    return code - (1 << 64) if code >> 63 else code


BY_FINGERPRINT = {fingerprint(layout.paths): layout for layout in LAYOUTS}


def schema_paths(kind: T.DataType, prefix: str = "") -> set[str]:
    """Nested field paths of a schema; ``[]`` marks an array's elements."""
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, prefix + "[]")
    if isinstance(kind, T.StructType):
        return set().union(*(schema_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name) for f in kind))
    return {prefix}


def layout_of(schema: T.StructType) -> Layout | None:
    """The first layout whose paths the schema holds: by the fingerprint of what the two have in common."""
    paths = schema_paths(schema)
    return next((x for code, x in BY_FINGERPRINT.items() if fingerprint(paths & set(x.paths)) == code), None)


def canonical_turns(df: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """conv_id, turns: by the mapping that the fingerprint of ``df``'s schema selects."""
    layout = layout_of(df.schema)
    if layout is None:
        raise ValueError(f"no layout has the fields {sorted(schema_paths(df.schema))}")
    if not layout.by_row:
        return df.select(F.col(id_col).alias("conv_id"), F.expr(layout.turns).cast(TURNS).alias("turns"))
    rows = df.select(F.col(id_col).alias("conv_id"), *layout.paths)
    return rows.groupBy("conv_id").agg(F.expr(layout.turns).cast(TURNS).alias("turns"))


def _prefixed(keys: Column, prefix: str) -> Column:
    return F.transform(keys, lambda k: F.concat(F.lit(prefix), k))


def json_paths(json: Column) -> Column:
    """The known ones of a JSON object's own fields, and of those of all elements of its lists, sorted."""
    none = F.array().cast("array<string>")
    paths = [F.coalesce(F.json_object_keys(json), none)]
    for parent in sorted({p.split("[]")[0] for p in KNOWN_PATHS if "[]" in p}):
        elements = F.from_json(F.get_json_object(json, f"$.{parent}"), "array<map<string,string>>")
        keys = F.flatten(F.transform(elements, lambda m: F.coalesce(F.map_keys(m), none)))
        paths.append(_prefixed(F.coalesce(keys, none), f"{parent}[]."))
    return F.array_sort(F.filter(F.array_distinct(F.concat(*paths)), lambda p: p.isin(KNOWN_PATHS)))


def has_layout(paths: Column, layout: Layout) -> Column:
    """Whether sorted paths hold a layout's: by the fingerprint of what the two have in common."""
    common = F.filter(paths, lambda p: p.isin(list(layout.paths)))
    return F.xxhash64(F.array_join(common, "|")) == fingerprint(layout.paths)


def canonical_turns_of_json(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """conv_id, layout, turns: each row by the mapping that its own fingerprint selects."""
    marked = df.select(F.col(id_col).alias("conv_id"), F.col(json_col).alias("json"), json_paths(F.col(json_col)).alias("paths"))
    layouts = [layout for layout in LAYOUTS if not layout.by_row]
    for i, layout in enumerate(layouts):
        marked = marked.withColumn(f"j{i}", F.from_json("json", layout.schema))
    turns, name = F.lit(None).cast(TURNS), F.lit(None).cast("string")
    for i, layout in reversed([*enumerate(layouts)]):  # the first of which a row has all paths counts
        fields = T.StructType.fromDDL(layout.schema).names
        mapped = F.expr(f"transform(array(j{i}), row -> {_within(layout.turns, fields)})[0]").cast(TURNS)
        turns = F.when(has_layout(F.col("paths"), layout), mapped).otherwise(turns)
        name = F.when(has_layout(F.col("paths"), layout), F.lit(layout.name)).otherwise(name)
    return marked.select("conv_id", name.alias("layout"), turns.alias("turns"))


def _within(expression: str, fields: list[str]) -> str:
    """The mapping over fields of ``row``."""
    return re.sub(r"(?<![\w.'`])(" + "|".join(fields) + r")(?![\w'])", r"row.\1", expression)


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def _role_out(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def _role_in(role: Column) -> Column:
    return unescape(F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\n", "$1\n"))


def format_turns(df: DataFrame) -> DataFrame:
    """``df`` (with turns) plus formatted, and loss_mask: array<struct<turn, start, length>>.

    ``start`` and ``length`` count code points in the formatted turn of that number, from 0.
    """
    whole = F.transform("turns", lambda t: F.struct(
        _role_out(F.coalesce(t["role"], F.lit(""))).alias("role"), escape(F.coalesce(t["text"], F.lit(""))).alias("text"),
        F.coalesce(t["role"] == "assistant", F.lit(False)).alias("loss")))
    df = df.withColumn("__x_turns", whole)
    text = F.array_join(F.transform("__x_turns", lambda t: F.concat(
        F.lit(START), t["role"], F.lit("\n"), t["text"], F.lit(END))), "")
    spans = F.transform("__x_turns", lambda t, i: F.struct(
        i.alias("turn"), (F.length(t["role"]) + len(START) + 1).alias("start"), F.length(t["text"]).alias("length"), t["loss"].alias("loss")))
    mask = F.transform(F.filter(spans, lambda s: s["loss"]), lambda s: F.struct(s["turn"], s["start"], s["length"]))
    return df.withColumns({"formatted": text, "loss_mask": mask}).drop("__x_turns")


def segments(formatted: Column) -> Column:
    """The formatted turns, each without its end mark."""
    parts = F.split(formatted, r"<\|im_end\|>\n")
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def parse(formatted: Column) -> Column:
    """Turns read back from the formatted text."""
    def turn(part: Column) -> Column:
        head = F.substring_index(part, "\n", 1)
        return F.struct(_role_in(F.substr(head, F.lit(len(START) + 1))).alias("role"),
                        unescape(F.substr(part, F.length(head) + 2)).alias("text"))

    return F.transform(segments(formatted), turn)


def masked_text(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.flatten(F.transform(F.array(segments(formatted)), lambda parts: F.transform(
        mask, lambda m: unescape(F.substr(F.get(parts, m["turn"]), m["start"] + 1, m["length"]))))), "")


def digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from the output."""
    back = formatted.select("conv_id", "formatted", parse(F.col("formatted")).alias("turns"),
                            masked_text(F.col("formatted"), F.col("loss_mask")).alias("loss"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
                       F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))


ORACLE = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
escaped AS (
  SELECT *, length(regexp_replace(regexp_replace(replace(text, '\', '\\'),
    '(<)(\|[A-Za-z0-9_]+\|>|/?s>|</?SYS>>)', '\1\\\2', 'g'), '(\[)(/?INST\])', '\1\\\2', 'g')) AS n FROM turns)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(12 + length(role) + 1 + n + 11)::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id"""
