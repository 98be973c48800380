"""Staging in the shared folder, text keys, and the guard that keeps the subpackage optional."""
import ast
import pathlib

from pyspark.sql import functions as F

from penalytics.llm import common

ROOT = pathlib.Path(__file__).resolve().parents[2]


def test_stage_and_release(spark, docs_of):
    common.release(spark)
    docs = docs_of([(1, "a"), (2, None)])
    kept = common.stage(docs, "t")
    assert kept.schema == docs.schema and sorted(map(str, kept.collect())) == sorted(map(str, docs.collect()))
    path = common._MADE[-1]
    assert pathlib.Path(path.removeprefix("file:")).exists()
    assert common.release(spark) == 1 and common.release(spark) == 0
    assert not pathlib.Path(path.removeprefix("file:")).exists()


def test_text_key(docs_of):
    keys = {r[0]: r[1] for r in docs_of([(1, None), (2, ""), (3, "a"), (4, "A")]).select("doc_id", common.text_key(F.col("text"))).collect()}
    assert keys[1] == keys[2] and len(set(keys.values())) == 3


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "penalytics").rglob("*.py"):
        if "llm" in path.relative_to(ROOT / "penalytics").parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") for n in names), path


def test_no_local_checkpoint_and_no_python_in_native_operators():
    for path in (ROOT / "penalytics" / "llm").glob("*.py"):
        text = path.read_text()
        assert "localCheckpoint(" not in text
        if path.name in ("license_scan.py", "chat_format.py"):
            assert not any(w in text for w in ("pandas_udf", "mapIn", "applyIn", ".rdd", "F.udf"))
