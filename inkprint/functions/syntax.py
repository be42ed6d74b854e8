"""The 28 syntax features of Python samples, from a table of syntax nodes.

``node_array`` is the only Python boundary: an Arrow UDF that lists the syntax nodes of one sample with the stdlib
``ast``. Everything counted afterwards is counted by Spark on that array, in the same narrow stage, so building a
feature matrix needs neither a shuffle nor a join back to the samples.
"""

import ast
import warnings

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkprint.session import null_safe_join

# Feature names, in matrix order.
SYNTAX_FEATURES = [
    "ast_function_count", "ast_class_count", "ast_import_count", "ast_return_count", "ast_assert_count",
    "ast_raise_count", "ast_try_count", "ast_comprehension_count", "ast_lambda_count", "ast_decorator_count",
    "ast_docstring_count", "ast_has_main_guard", "ast_max_nesting_depth", "ast_avg_function_length",
    "ast_max_function_length", "ast_type_annotation_count", "ast_fstring_count", "ast_walrus_count",
    "ast_global_count", "ast_none_compare_count", "ast_isinstance_count", "ast_early_return_count",
    "ast_broad_except_count", "ast_finally_count", "ast_default_arg_count", "ast_guarded_fn_ratio",
    "ast_except_per_try", "ast_defensive_line_ratio",
]

# Node kinds that are counted, and those of them that open a nesting level.
FUNCTIONS = ["FunctionDef", "AsyncFunctionDef"]
NESTING = ["ClassDef", "If", "For", "While", "With", "Try", *FUNCTIONS]
COMPREHENSIONS = ["ListComp", "SetComp", "DictComp", "GeneratorExp"]
IMPORTS = ["Import", "ImportFrom"]
COUNTED = [
    *NESTING, *COMPREHENSIONS, *IMPORTS, "Return", "Assert", "Raise", "Lambda", "JoinedStr", "NamedExpr", "Global",
    "Compare", "Call", "ExceptHandler",
]

_INT, _BOOL = T.IntegerType(), T.BooleanType()
NODE_FIELDS = [
    ("node_id", _INT), ("last_id", _INT), ("parent_id", _INT), ("fn_id", _INT), ("kind", T.StringType()), ("depth", _INT),
    ("lineno", _INT), ("end_lineno", _INT), ("decorators", _INT), ("defaults", _INT), ("none_tests", _INT),
    ("docstring", _BOOL), ("annotated", _BOOL), ("main_guard", _BOOL), ("returns_none", _BOOL), ("broad", _BOOL),
    ("has_finally", _BOOL), ("guarded", _BOOL),
]
NODES = T.ArrayType(T.StructType([T.StructField(name, kind) for name, kind in NODE_FIELDS]))
PIECE = 200  # texts that are parsed before their nodes are packed
_ARROW = {"integer": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
_COUNTED = frozenset(COUNTED)
_NESTING = frozenset(NESTING)


def _is_none(node) -> bool:
    return isinstance(node, ast.Constant) and node.value is None


def _attributes(node, kind: str) -> dict:
    """What the features ask about one node beyond its kind and position."""
    found = {}
    if kind in FUNCTIONS or kind == "ClassDef":
        first = node.body[0] if node.body else None
        found["docstring"] = (
            isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant)
            and isinstance(first.value.value, str)
        )
    if kind in FUNCTIONS:
        found["decorators"] = len(node.decorator_list)
        found["defaults"] = len(node.args.defaults) + sum(d is not None for d in node.args.kw_defaults)
        found["annotated"] = node.returns is not None or any(a.annotation for a in node.args.args)
        found["guarded"] = False
    elif kind == "If":
        test = node.test
        found["main_guard"] = (
            isinstance(test, ast.Compare) and isinstance(test.left, ast.Name) and test.left.id == "__name__")
    elif kind == "Try":
        found["has_finally"] = bool(node.finalbody)
    elif kind == "Return":
        found["returns_none"] = node.value is None or _is_none(node.value)
    elif kind == "Compare":
        identity = sum(isinstance(op, (ast.Is, ast.IsNot)) for op in node.ops)
        found["none_tests"] = identity * sum(map(_is_none, node.comparators))
    elif kind == "ExceptHandler":
        found["broad"] = node.type is None or (isinstance(node.type, ast.Name) and node.type.id == "Exception")
    return found


def list_nodes(code: str) -> list[dict] | None:
    """Counted nodes of one sample in preorder, or None when it does not parse. ``node_id`` to ``last_id`` is the interval
    of numbers of a node and all that stands in it, counted or not."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(code)
    except Exception:
        return None
    rows: list[dict] = []
    todo = [(tree, None, None, 0)]
    seen = 0
    while todo:
        node, parent, function, depth = todo.pop()
        if isinstance(node, dict):  # what stands in this node is numbered
            node["last_id"] = seen - 1
            continue
        kind = type(node).__name__
        own, seen = seen, seen + 1
        if kind in _NESTING:
            depth += 1
        isinstance_call = kind == "Call" and isinstance(node.func, ast.Name) and node.func.id == "isinstance"
        if kind in _COUNTED and (kind != "Call" or isinstance_call):
            row = {"node_id": own, "parent_id": parent, "fn_id": function and function["node_id"], "kind": kind,
                   "depth": depth, "lineno": node.lineno, "end_lineno": node.end_lineno, **_attributes(node, kind)}
            rows.append(row)
            todo.append((row, None, None, 0))
            if function is not None and (isinstance_call or row.get("none_tests")):
                function["guarded"] = True
            if kind in FUNCTIONS:
                function = row
        todo.extend((child, own, function, depth) for child in reversed(list(ast.iter_child_nodes(node))))
    return rows


def _listed(codes: pa.Array) -> pa.Array:
    offsets, rows = [], []
    for code in codes.to_pylist():
        nodes = None if code is None else list_nodes(code)
        offsets.append(None if nodes is None else len(rows))
        rows.extend(nodes or ())
    offsets.append(len(rows))
    fields = [pa.field(name, _ARROW[kind.typeName()]) for name, kind in NODE_FIELDS]
    columns = [pa.array([row.get(field.name) for row in rows], type=field.type) for field in fields]
    items = pa.StructArray.from_arrays(columns, fields=fields)
    return pa.ListArray.from_arrays(pa.array(offsets, type=pa.int32()), items)


@F.arrow_udf(NODES)
def node_array(codes: pa.Array) -> pa.Array:
    """Nodes of every text. Python objects are held for ``PIECE`` texts at a time, however many rows a batch has."""
    return pa.concat_arrays([_listed(codes.slice(i, PIECE)) for i in range(0, max(len(codes), 1), PIECE)])


def _nodes_of(df: DataFrame, code: str, language: str) -> Column:
    # Other languages reach the UDF as NULL, so only Python text crosses into the worker's parser.
    return node_array(F.when(F.lower(f"`{language}`") == "python", F.col(f"`{code}`")))


def syntax_nodes(df: DataFrame, code: str = "code", language: str = "language") -> DataFrame:
    """One row per counted syntax node of every Python sample that parses; other columns are kept, ``code`` dropped."""
    kept = [F.col(f"`{c}`") for c in df.columns if c != code]
    listed = df.select(*kept, _nodes_of(df, code, language).alias("_nodes"))
    return listed.select(*kept, F.inline("_nodes"))


def node_context(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Append to a node table (keys of the sample, node_id, last_id, kind, none_tests) what depends on where a node stands:
    ``depth`` (nesting nodes around it, itself included), ``fn_id`` (nearest function around it) and, for functions,
    ``guarded`` (an isinstance call or None test has it as nearest function).

    Only intervals are read, which either hold one another or lie apart. The nesting nodes opened up to a node less those
    closed before it are its depth. Among functions that stand in equally many others, the last one opened before a node
    is the one around it. Samples are dealt out; a window holds one sample at most."""
    c = F.col
    sample = [c(k) for k in keys]
    is_function = c("kind").isin(*FUNCTIONS)

    def around(rows: DataFrame, counted: Column, name: str) -> DataFrame:
        """How many counted intervals hold the node, itself included: intervals open at their first number and close after
        their last one."""
        weight = F.when(counted, 1).otherwise(0)
        edges = F.array(F.struct(c("node_id").alias("at"), F.lit(0).alias("after"), weight.alias("step")),
                        F.struct(c("last_id").alias("at"), F.lit(1).alias("after"), (-weight).alias("step")))
        row = F.struct(*[c(f"`{x}`") for x in rows.columns])
        events = rows.select(row.alias("row"), *sample, F.explode(edges).alias("e"))
        so_far = W.partitionBy(*keys).orderBy("e.at", "e.after").rowsBetween(W.unboundedPreceding, W.currentRow)
        return events.withColumn(name, F.sum("e.step").over(so_far)).where("e.after = 0").select(
            "row.*", c(name).cast("int").alias(name))

    placed = around(nodes, c("kind").isin(*NESTING), "depth")
    placed = around(placed, is_function, "_functions").withColumn("_outer", c("_functions") - is_function.cast("int"))
    # a function stands in a line of its own level; other nodes look into the line of the level around them
    lines = F.array_compact(F.array(
        F.struct((c("_outer") - 1).alias("level"), F.lit(None).cast("int").alias("opens")),
        F.when(is_function, F.struct(c("_outer").alias("level"), c("node_id").alias("opens")))))
    row = F.struct(*[c(f"`{x}`") for x in placed.columns])
    asked = placed.select(row.alias("row"), *sample, c("node_id").alias("_at"), F.explode(lines).alias("line"))
    opened = W.partitionBy(*keys, "line.level").orderBy("_at").rowsBetween(W.unboundedPreceding, W.currentRow)
    found = asked.withColumn("fn_id", F.max("line.opens").over(opened)).where(F.isnull("line.opens")).select("row.*", "fn_id")
    found = found.withColumn("fn_id", F.when(c("_outer") > 0, c("fn_id"))).drop("_functions", "_outer")
    tests = (c("kind") == "Call") | (F.coalesce("none_tests", F.lit(0)) > 0)
    own = found.where(c("fn_id").isNotNull()).groupBy(*keys, "fn_id").agg(F.max(tests).alias("_guards")).withColumnRenamed(
        "fn_id", "_fn")
    marked = null_safe_join(found.withColumn("_fn", c("node_id")), own, [*keys, "_fn"], "left").drop("_fn")
    return marked.withColumn("guarded", F.when(is_function, F.coalesce("_guards", F.lit(False)))).drop("_guards")


def context_features(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """The features of a sample that depend on where its nodes stand, counted from the node table; samples without a node
    have no row."""
    c = F.col
    lines = F.when(c("kind").isin(*FUNCTIONS), c("end_lineno") - c("lineno") + 1)
    defensive = F.count_if(c("kind") == "ExceptHandler") + F.sum(F.coalesce("none_tests", F.lit(0))) + F.count_if(c("kind") == "Call")
    functions = F.count(lines)
    return nodes.groupBy(*keys).agg(
        functions.alias("ast_function_count"), F.max("depth").cast("long").alias("ast_max_nesting_depth"),
        F.count_if(c("returns_none") & (c("depth") >= 2)).alias("ast_early_return_count"),
        F.coalesce(F.count_if("guarded") / F.nullif(functions, F.lit(0)), F.lit(0.0)).alias("ast_guarded_fn_ratio"),
        (defensive / F.greatest(F.lit(1), F.coalesce(F.sum(lines), F.lit(0)))).alias("ast_defensive_line_ratio"))


def _total(nodes: Column, weight) -> Column:
    return F.aggregate(nodes, F.lit(0).cast("long"), lambda acc, n: acc + F.coalesce(weight(n), F.lit(0)))


def syntax_features(df: DataFrame, code: str = "code", language: str = "language") -> DataFrame:
    """Append ``parse_ok`` and the 28 syntax features. All are NULL for other languages; the features are also NULL
    where a Python sample does not parse, which is not the same as zero."""
    kept = [F.col(f"`{c}`") for c in df.columns]
    is_python = F.lower(f"`{language}`") == "python"
    nodes = F.col("_nodes")

    def having(test) -> Column:
        return F.size(F.filter(nodes, test)).cast("long")

    def of_kind(*kinds: str) -> Column:
        return having(lambda n: n["kind"].isin(*kinds))

    length = lambda n: n["end_lineno"] - n["lineno"] + 1
    functions = F.filter(nodes, lambda n: n["kind"].isin(*FUNCTIONS))
    lengths = F.col("_lengths")
    listed = df.select(*kept, _nodes_of(df, code, language).alias("_nodes"))
    listed = listed.withColumns({
        "_lengths": F.transform(functions, length),
        "_handlers": of_kind("ExceptHandler"),
    })
    total_length = F.aggregate(lengths, F.lit(0).cast("long"), lambda acc, x: acc + x)
    base = {
        "ast_function_count": F.size(lengths).cast("long"),
        "ast_class_count": of_kind("ClassDef"),
        "ast_import_count": of_kind(*IMPORTS),
        "ast_return_count": of_kind("Return"),
        "ast_assert_count": of_kind("Assert"),
        "ast_raise_count": of_kind("Raise"),
        "ast_try_count": of_kind("Try"),
        "ast_comprehension_count": of_kind(*COMPREHENSIONS),
        "ast_lambda_count": of_kind("Lambda"),
        "ast_decorator_count": _total(nodes, lambda n: n["decorators"]),
        "ast_docstring_count": having(lambda n: n["docstring"]),
        "ast_has_main_guard": F.exists(nodes, lambda n: F.coalesce(n["main_guard"], F.lit(False))).cast("long"),
        "ast_max_nesting_depth": F.coalesce(
            F.array_max(F.transform(nodes, lambda n: n["depth"])), F.lit(0)).cast("long"),
        "ast_max_function_length": F.coalesce(F.array_max(lengths), F.lit(0)).cast("long"),
        "ast_type_annotation_count": having(lambda n: n["annotated"]),
        "ast_fstring_count": of_kind("JoinedStr"),
        "ast_walrus_count": of_kind("NamedExpr"),
        "ast_global_count": of_kind("Global"),
        "ast_none_compare_count": _total(nodes, lambda n: n["none_tests"]),
        "ast_isinstance_count": of_kind("Call"),
        "ast_early_return_count": having(lambda n: n["returns_none"] & (n["depth"] >= 2)),
        "ast_broad_except_count": having(lambda n: n["broad"]),
        "ast_finally_count": having(lambda n: n["has_finally"]),
        "ast_default_arg_count": _total(nodes, lambda n: n["defaults"]),
        "_guarded": having(lambda n: n["guarded"]),
        "_fn_lines": total_length,
    }
    c = F.col
    derived = {
        "ast_avg_function_length": F.when(c("ast_function_count") > 0, c("_fn_lines") / c("ast_function_count"))
        .otherwise(F.lit(0.0)),
        "ast_guarded_fn_ratio": F.when(c("ast_function_count") > 0, c("_guarded") / c("ast_function_count"))
        .otherwise(F.lit(0.0)),
        "ast_except_per_try": c("_handlers") / (c("ast_try_count") + 1),
        "ast_defensive_line_ratio": (c("_handlers") + c("ast_none_compare_count") + c("ast_isinstance_count"))
        / F.greatest(F.lit(1), c("_fn_lines")),
    }
    parsed = nodes.isNotNull()
    counted = listed.select(
        *kept,
        F.when(is_python, parsed).alias("parse_ok"),
        "_handlers",
        *[F.when(parsed, expr).alias(name) for name, expr in base.items()],
    )
    return counted.select(
        *kept, "parse_ok",
        *[(F.when(c("parse_ok"), derived[f]) if f in derived else c(f)).alias(f) for f in SYNTAX_FEATURES],
    )
