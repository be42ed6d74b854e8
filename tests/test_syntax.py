import pyarrow as pa
import pytest

from inkprint.functions import syntax
from inkprint.functions.syntax import (
    SYNTAX_FEATURES, context_features, node_context, syntax_features, syntax_nodes)
from inkprint.plans.studies import feature_matrix, parse_rate_by_class
from registry.fixtures import code_samples
from registry.sql import GOLDEN_SYNTAX


def features(spark, code, language="python"):
    df = spark.createDataFrame([(code, language)], "code string, language string")
    return syntax_features(df).first()


def test_templates(spark, sf_dir):
    for row in syntax_features(code_samples(spark, sf_dir)).collect():
        golden = GOLDEN_SYNTAX.get(row.doc_id % 12)
        if golden is None:
            assert row.parse_ok in (False, None) and all(row[f] is None for f in SYNTAX_FEATURES)
            continue
        assert row.parse_ok
        for f in SYNTAX_FEATURES:
            assert row[f] == pytest.approx(golden.get(f.removeprefix("ast_"), 0)), (row.doc_id, f)


@pytest.mark.parametrize("code, expected", [
    ("class A:\n    'doc'\n    def m(self):\n        return\n", dict(ast_early_return_count=1, ast_docstring_count=1, ast_max_nesting_depth=2)),
    ("if a:\n    pass\nelif b:\n    pass\nelse:\n    pass\n", dict(ast_max_nesting_depth=2)),
    ("async def f():\n    async with a:\n        async for x in y:\n            pass\n", dict(ast_function_count=1, ast_max_nesting_depth=1)),
    ("def outer():\n    def inner():\n        return x is None\n    return 1\n", dict(ast_guarded_fn_ratio=0.5, ast_none_compare_count=1)),
    ("x is None\ndef f():\n    pass\n", dict(ast_guarded_fn_ratio=0.0, ast_none_compare_count=1)),
    ("a is None is not None\n", dict(ast_none_compare_count=4)),
    ("@d(x is None)\n@e\ndef f(a, b=1, *, c, d=2):\n    pass\n", dict(ast_decorator_count=2, ast_default_arg_count=2, ast_guarded_fn_ratio=1.0)),
    ("try:\n    pass\nexcept* ValueError:\n    pass\n", dict(ast_try_count=0, ast_except_per_try=1.0)),
    ("f'{a:{b}}'\n", dict(ast_fstring_count=2)),
    ("if __name__ != 'x':\n    pass\n", dict(ast_has_main_guard=1)),
    ("'module doc'\n", dict(ast_docstring_count=0)),
    ("def f(*, a: int): pass\ndef g() -> int: pass\n", dict(ast_type_annotation_count=1)),
    ("obj.isinstance(x)\nisinstance(y, int)\n", dict(ast_isinstance_count=1)),
    ("", dict(ast_function_count=0, ast_defensive_line_ratio=0.0)),
])
def test_definitions(spark, code, expected):
    row = features(spark, code)
    assert row.parse_ok
    for name, value in expected.items():
        assert row[name] == pytest.approx(value), name


def test_unparsable_and_other_languages(spark):
    for code in ("def f(:", "a\x00b", "(" * 500, "x = 1\n  y = 2"):
        row = features(spark, code)
        assert row.parse_ok is False and row.ast_function_count is None
    assert features(spark, "def f(): pass", "java").parse_ok is None
    deep = features(spark, "x = " + " + ".join(["1"] * 3000))
    assert deep.parse_ok in (True, False)


def test_node_table(spark):
    df = spark.createDataFrame([("s", "def f(x):\n    if x is None:\n        return\n", "Python")], "sample_id string, code string, language string")
    nodes = {r.kind: r for r in syntax_nodes(df).collect()}
    assert set(nodes) == {"FunctionDef", "If", "Compare", "Return"}
    assert nodes["Return"].depth == 2 and nodes["Return"].fn_id == nodes["FunctionDef"].node_id
    assert nodes["FunctionDef"].guarded and nodes["If"].parent_id == nodes["FunctionDef"].node_id


def test_matrix_is_narrow(spark, sf_dir, plan):
    text = plan(syntax_features(code_samples(spark, sf_dir)))
    assert "Exchange" not in text and text.count("ArrowEvalPython") == 1


def test_blank_rows_leave_and_parse_rate(spark, sf_dir):
    matrix = feature_matrix(code_samples(spark, sf_dir))
    assert matrix.where("doc_id % 12 = 10").count() == 0
    assert {r.label: r.parse_rate for r in parse_rate_by_class(matrix, ["label"]).collect()}[1] == 1.0


NESTED = """class A:
    @d(x is None)
    def f(self, a=lambda: isinstance(a, int)):
        if a:
            def g():
                while True:
                    return
            return isinstance(a, str)
        def h():
            class B:
                def k(self): return None
            return x is not None
        return [y for y in z if y is None]
    async def w():
        try:
            pass
        except Exception:
            return None
isinstance(q, int)
def last(): pass
"""


def test_context_from_intervals_equals_the_walk(spark, sf_dir):
    """Depth, nearest function and guards, found by Spark from numbers alone, are those of a walk over the tree."""
    odd = [(f"odd{i}", code, "Python") for i, code in enumerate([
        NESTED, "", "x = 1", "def f(): pass", "if a:\n  if b:\n    def f():\n      return\n    return_ = 1\nfor i in j: pass\n" * 3,
        "lambda: (yield x is None)", "def a():\n def b():\n  def c(): x is None\n  y is None\n", "def f(:"])]
    df = spark.createDataFrame(odd + [(None, NESTED, "Python")], "sample_id string, code string, language string")
    df = df.unionByName(code_samples(spark, sf_dir).select("sample_id", "code", "language"))
    walked = syntax_nodes(df).drop("language")
    placed = node_context(walked.drop("depth", "fn_id", "guarded"), ["sample_id"]).select(walked.columns)
    assert walked.count() > 300 and walked.exceptAll(placed).count() == 0 and placed.exceptAll(walked).count() == 0
    names = ["ast_function_count", "ast_max_nesting_depth", "ast_early_return_count", "ast_guarded_fn_ratio", "ast_defensive_line_ratio"]
    whole = {r.sample_id: r for r in syntax_features(df).collect()}
    counted = context_features(placed, ["sample_id"]).collect()
    assert {"odd0", "odd6", None} <= {r.sample_id for r in counted}
    for r in counted:
        assert [r[n] for n in names] == pytest.approx([whole[r.sample_id][n] for n in names]), r.sample_id


def test_intervals_hold_one_another_or_lie_apart(spark):
    df = spark.createDataFrame([("s", NESTED, "python")], "sample_id string, code string, language string")
    spans = sorted((r.node_id, r.last_id) for r in syntax_nodes(df).collect())
    for i, (a, b) in enumerate(spans):
        assert a <= b and all(c > b or d <= b for c, d in spans[i + 1:])


def test_texts_are_parsed_in_pieces(monkeypatch):
    """The Python objects of a batch's nodes are never held all at once; the pieces together are the whole."""
    held, listed = [], syntax._listed
    monkeypatch.setattr(syntax, "PIECE", 2)
    monkeypatch.setattr(syntax, "_listed", lambda codes: held.append(len(codes)) or listed(codes))
    codes = pa.array(["def f():\n  return 1", None, "x = (", "import os", "class A: pass"])
    assert syntax.node_array.func(codes).to_pylist() == listed(codes).to_pylist()
    assert max(held) == 2 and sum(held) == 5
    assert len(syntax.node_array.func(codes.slice(0, 0))) == 0
