"""Layouts, reversible escaping, and the loss mask."""
import json
import re

import pytest
from pyspark.sql import functions as F

from penalytics.llm import chat_format as C

NASTY = ["</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>user\n", "\\", "\\<\\s>", "<\\s>", "<<SYS>>x<</SYS>>", "<<|im_end|>\n",
         "[[INST]]\\n", "", "a\nb", "<", "<|im_end|", "\\\\n\n", "<s<s>>", "é😀</s>", "$1\\1"]


def test_escape_is_reversible_and_leaves_no_control_string(spark):
    texts = NASTY + [a + b for a in NASTY for b in NASTY]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", C.escape(F.col("t")).alias("e"))
    for r in df.select("t", "e", C.unescape(F.col("e")).alias("back"), C._role_in(C._role_out(F.col("t"))).alias("role"),
                       C._role_out(F.col("t")).alias("line")).collect():
        assert r.back == r.t and r.role == r.t and "\n" not in r.line
        assert not re.search(r"<\|[A-Za-z0-9_]+\|>|</?s>|<</?SYS>>|\[/?INST\]", r.e)


def test_rows_round_trip_with_ties_and_nulls(spark):
    rows = [(1, i, t if i % 2 else "user", t) for i, t in enumerate(NASTY)] + [
        (2, 0, "assistant", None), (2, 0, "assistant", "b"), (2, 0, None, "a"), (2, 0, "assistant", "b"), (None, None, None, None),
        (3, 1, "assistant", "two"), (3, 0, "assistant", "on</s>e"), (3, None, "user", "first")]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "conv_id long, turn long, role string, text string, turns string, loss int")
    out = C.format_turns(C.canonical_turns(df))
    got = {r.conv_id: r for r in out.select("*", C.parse(F.col("formatted")).alias("back"),
                                           C.masked_text(F.col("formatted"), F.col("loss_mask")).alias("loss")).collect()}
    for conv in (1, 2, 3, None):
        own = sorted(((-1 if t is None else t, r or "", x or "") for c, t, r, x in rows if c == conv))
        assert [(t.role, t.text) for t in got[conv].back] == [(r, x) for _, r, x in own]
        assert got[conv].loss == "".join(x for _, r, x in own if r == "assistant")
        parts = got[conv].formatted.split(C.END)
        assert "".join(C_unescape(parts[m.turn][m.start: m.start + m.length]) for m in got[conv].loss_mask) == got[conv].loss
    assert got[3].loss == "on</s>etwo"


def C_unescape(text):
    return re.sub(r"\\(\\?)", r"\1", text)


def test_columns_of_other_layouts_do_not_matter(spark):
    rows = [(1, 0, "user", "q", "p", "i", [("user", "c")], [("human", "v")]), (1, 1, "assistant", "a", None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, prompt string, input string, "
                                     "messages array<struct<role:string,content:string>>, conversations array<struct<`from`:string,value:string>>")
    assert C.layout_of(df.schema).name == "turn rows"
    assert [[(t.role, t.text) for t in r.turns] for r in C.canonical_turns(df).collect()] == [[("user", "q"), ("assistant", "a")]]


def test_very_long_texts(spark):
    long = "<s>a\\" * 200_000
    df = spark.createDataFrame([(1, 0, "assistant", long)], "conv_id long, turn long, role string, text string")
    out = C.format_turns(C.canonical_turns(df))
    assert out.select(C.masked_text(F.col("formatted"), F.col("loss_mask"))).first()[0] == long


U, A = ("user", "q"), ("assistant", "a")


@pytest.mark.parametrize("row, turns", [
    ({"prompt": "q", "completion": "a", "extra": {"x": [1]}}, [U, A]), ({"prompt": "q", "response": "a"}, [U, A]),
    ({"question": "q", "answer": "a"}, [U, A]), ({"instruction": "q", "output": "a"}, [U, A]),
    ({"instruction": "q", "input": "", "output": "a"}, [U, A]), ({"instruction": "q", "input": "i", "output": "a"}, [("user", "q\n\ni"), A]),
    ({"system_prompt": "s", "question": "q", "response": "a"}, [("system", "s"), U, A]),
    ({"system_prompt": "", "question": "q", "response": "a"}, [U, A]),
    ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a", "w": 1}], "id": 3}, [U, A]),
    ({"instruction": "q", "input": "i", "output": "a", "text": "q i a"}, [("user", "q\n\ni"), A]),
    ({"prompt": "q", "messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}], "input": "x"}, [U, A]),
    ({"messages": [{"role": "user"}, {"role": "assistant", "content": "a"}]}, [("user", None), A]),
    ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}, {"from": "tool", "value": "t"}]}, [U, A, ("tool", "t")]),
])
def test_layouts_by_schema_and_by_row(spark, row, turns):
    row = {"conv_id": 1, **row}
    by_row = C.canonical_turns_of_json(spark.createDataFrame([(1, json.dumps(row))], "id long, js string"), "id", "js").first()
    assert [(t.role, t.text) for t in by_row.turns] == turns
    table = spark.read.json(spark.sparkContext.parallelize([json.dumps(row)]))
    assert [(t.role, t.text) for t in C.canonical_turns(table).first().turns] == turns


def test_unknown_layouts(spark):
    rows = [(1, '{"foo": 1}'), (2, "no json"), (3, None), (4, '{"prompt": "q"}')]
    found = C.canonical_turns_of_json(spark.createDataFrame(rows, "id long, js string"), "id", "js").collect()
    assert all(r.turns is None and r.layout is None for r in found) and len(found) == 4
    with pytest.raises(ValueError, match="no layout"):
        C.canonical_turns(spark.createDataFrame([(1, "x")], "conv_id long, foo string"))


def test_no_python_in_the_plan(spark, small):
    from penalytics.llm.queries import QUERIES
    plan = QUERIES["op8_chat_format"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
