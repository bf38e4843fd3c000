"""Compiled predicates against a direct interpreter of the language, value by value."""

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandlake.functions import jsonlogic as jl
from strandlake.functions.builder import tagged

VALUES = [None, True, False, 0, 1, -2.5, 30, "", "0", "1", "30", "abc", "Z", " 7 ", "0x10", "1d", "NaN"]
TARGET = "struct<kind:string,s:string,n:double,b:boolean>"


def to_number(v):
    if v is None:
        return 0.0
    if isinstance(v, bool):
        return float(v)
    if isinstance(v, (int, float)):
        return float(v)
    t = v.strip()
    if t == "":
        return 0.0
    if t.lower().startswith("0x"):
        return float(int(t, 16))
    if not all(c in "0123456789.eE+-" for c in t):
        return math.nan
    try:
        return float(t)
    except ValueError:
        return math.nan


def truth(v):
    if isinstance(v, list):
        return bool(v)
    return v not in (None, False, 0, "") and not (isinstance(v, float) and math.isnan(v))


def interpret(logic, data):
    if isinstance(logic, list):
        return [interpret(x, data) for x in logic]
    if not isinstance(logic, dict):
        return logic
    op, args = next(iter(logic.items()))
    args = args if isinstance(args, list) else [args]
    if op == "var":
        found = data.get(args[0])
        return interpret(args[1], data) if found is None and len(args) > 1 else found
    v = [interpret(x, data) for x in args]
    if op in ("<", "<=", ">", ">="):
        def one(a, b):
            if isinstance(a, str) and isinstance(b, str):
                x, y = a, b
            else:
                x, y = to_number(a), to_number(b)
            return {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
        return one(v[0], v[1]) and (len(v) < 3 or one(v[1], v[2]))
    if op in ("==", "!="):
        a, b = v
        same = (a is None and b is None) if a is None or b is None else a == b if isinstance(a, str) and isinstance(b, str) else to_number(a) == to_number(b)
        return same == (op == "==")
    if op in ("===", "!=="):
        a, b = v
        kind = lambda x: bool if isinstance(x, bool) else float if isinstance(x, (int, float)) else type(x)
        return (kind(a) == kind(b) and a == b) == (op == "===")
    if op == "!":
        return not truth(v[0])
    if op == "!!":
        return truth(v[0])
    if op in ("and", "or"):
        for x in v:
            if truth(x) == (op == "or"):
                return x
        return v[-1]
    if op == "in":
        return any(type(x) is type(v[0]) and x == v[0] for x in v[1]) if isinstance(v[1], list) else isinstance(v[1], str) and str(v[0] if v[0] is not None else "null") in v[1]
    if op == "if":
        for i in range(0, len(v) - 1, 2):
            if truth(v[i]):
                return v[i + 1]
        return v[-1] if len(v) % 2 else None
    raise AssertionError(op)


leaf = st.sampled_from([{"var": "x"}, {"var": "y"}, 0, 1, 30.0, "", "abc", "30", None, True])
logic = st.recursive(
    leaf,
    lambda inner: st.one_of(
        *(st.tuples(inner, inner).map(lambda ab, op=op: {op: list(ab)}) for op in ("<", "<=", ">", ">=", "==", "!=", "===", "!==", "and", "or")),
        inner.map(lambda a: {"!": [a]}), inner.map(lambda a: {"!!": [a]}), st.tuples(inner, inner, inner).map(lambda abc: {"if": list(abc)}),
    ),
    max_leaves=3,
)


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, tagged(a), tagged(b)) for i, (a, b) in enumerate((a, b) for a in VALUES for b in VALUES)]
    return spark.createDataFrame(data, f"i int, x {TARGET}, y {TARGET}").coalesce(1).cache()


def fields():
    return {"x": (F.col("x"), "target"), "y": (F.col("y"), "target")}


def test_random_logic(rows):
    """Many predicates at a time, to save on jobs."""
    import random

    drawn = []

    @settings(max_examples=60, deadline=None, suppress_health_check=list(HealthCheck))
    @given(logic)
    def draw(x):
        drawn.append(x)

    draw()
    random.shuffle(drawn)
    for lo in range(0, len(drawn), 10):
        some = drawn[lo : lo + 10]
        got = rows.select("i", *(jl.compile_predicate(x, fields()).alias(f"p{k}") for k, x in enumerate(some))).orderBy("i").collect()
        for r, (a, b) in zip(got, ((a, b) for a in VALUES for b in VALUES), strict=True):
            for k, x in enumerate(some):
                assert r[f"p{k}"] == truth(interpret(x, {"x": a, "y": b})), (x, a, b)


@pytest.mark.parametrize(
    "what,expected",
    [
        ({"in": ["b", "abc"]}, True), ({"in": [1, [1, 2]]}, True), ({"in": ["1", [1, 2]]}, False), ({"in": [{"var": "n"}, [4, 5]]}, True), ({"<": [1, {"var": "n"}, 9]}, True),
        ({"==": [{"cat": ["a", {"var": "n"}]}, "a5"]}, True), ({">": [{"+": [1, 2, "3"]}, 5]}, True), ({"==": [{"-": [5]}, -5]}, True), ({"==": [{"%": [-7, 3]}, -1]}, True),
        ({">": [{"/": [1, 0]}, 1e300]}, True), ({"==": [{"min": [3, 1, 2]}, 1]}, True), ({"==": [{"max": [3, 1, 2]}, 3]}, True), ({"missing": ["n"]}, False), ({"missing": ["q"]}, True),
        ({"missing_some": [1, ["n", "q"]]}, False), ({"missing_some": [2, ["n", "q"]]}, True), ({"all": [{"var": "xs"}, {">": [{"var": ""}, 0]}]}, True),
        ({"some": [{"var": "xs"}, {">": [{"var": ""}, 2]}]}, True), ({"none": [{"var": "xs"}, {">": [{"var": ""}, 2]}]}, False), ({"all": [[], {">": [{"var": ""}, 0]}]}, False),
        ({"==": [{"reduce": [{"var": "xs"}, {"+": [{"var": "current"}, {"var": "accumulator"}]}, 0]}, 6]}, True), ({"filter": [{"var": "xs"}, {">": [{"var": ""}, 5]}]}, False),
        ({"in": [4, {"map": [{"var": "xs"}, {"*": [{"var": ""}, 2]}]}]}, True), ({"merge": [[1], [2]]}, True), ({"??": [1, 2]}, False), ({"var": ["q", "d"]}, True), ({"log": 1}, True),
        ({"<": [{"var": "q"}, 1]}, True), ({"==": [{"var": "q"}, None]}, True), ({"?:": [False, 1, 0]}, False), ({"*": ["x", 2]}, False),
    ],
)
def test_operators(spark, what, expected):
    fields = {"n": (F.lit(5.0), "number"), "xs": (F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)), "array:number")}
    assert spark.range(1).select(jl.compile_predicate(what, fields)).first()[0] is expected


def test_operators_that_are_not_allowed():
    with pytest.raises(jl.OperatorError, match="Invalid query operator: invalid-operator"):
        jl.compile_predicate({"and": [{"invalid-operator": [1]}]}, {})
    with pytest.raises(jl.OperatorError):
        jl.check_operators({"substr": ["a", 1]})
    jl.compile_predicate({"==": [{"substr": ["abc", -2]}, "bc"]}, {}, allow_only_listed=False)


def test_what_is_not_logic_matches_everything(spark):
    assert spark.range(1).select(jl.compile_predicate({"a": 1, "b": 2}, {}, allow_only_listed=False)).first()[0] is True


def test_no_python_in_the_plan(rows):
    plan = rows.where(jl.compile_predicate({">": [{"var": "x"}, 3]}, fields()))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
