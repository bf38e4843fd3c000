"""JSON-Logic predicates compiled to Columns: no UDF, so filters stay in generated code and can be pushed down.

The language's values are dynamic; here every compiled expression is one of a few static kinds (number, text,
boolean, target, null, array), and conversions follow JavaScript: null counts as 0 in comparisons, '' as 0,
text that isn't a number as NaN, with which every comparison is false.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandlake.functions.targets import js_number_text

# The operators that queries may use.
ALLOWED = (
    "var missing missing_some == === != !== > >= < <= and or ! !! if ?: map reduce filter all some none in cat "
    "+ - * / % min max merge method log ??"
).split()


class OperatorError(ValueError):
    """An operator that queries may not use."""

    def __init__(self, operator: str):
        super().__init__(f"Invalid query operator: {operator}")
        self.operator = operator


def check_operators(logic: Any) -> None:
    """Raises OperatorError for the first operator that isn't allowed."""
    if isinstance(logic, list):
        for part in logic:
            check_operators(part)
    elif isinstance(logic, dict):
        for operator, args in logic.items():
            if operator not in ALLOWED:
                raise OperatorError(operator)
            check_operators(args)


@dataclass
class Value:
    """kind: number, text, boolean, null, target or array; parts: an array literal's values."""

    kind: str
    column: Column | None = None
    parts: list[Value] | None = None
    element: str | None = None


def _as_value(x: Any) -> Value:
    if x is None:
        return Value("null", F.lit(None))
    if isinstance(x, bool):
        return Value("boolean", F.lit(x))
    if isinstance(x, (int, float)):
        return Value("number", F.lit(float(x)))
    return Value("text", F.lit(str(x)))


def _text_number(s: Column) -> Column:
    """Number(text) in JavaScript; null stands for NaN."""
    t = F.trim(s)
    decimal = t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    infinite = t.rlike(r"^[+-]?Infinity$")
    based = F.when(t.rlike("^0[xX][0-9a-fA-F]{1,13}$"), F.conv(F.substr(t, F.lit(3)), 16, 10).cast("double"))
    return F.when(t == "", F.lit(0.0)).when(decimal, t.try_cast("double")).when(infinite, F.regexp_replace(t, r"\+", "").try_cast("double")).otherwise(based)


def to_number(v: Value) -> Column:
    """As a double; null stands for NaN."""
    c = v.column
    if v.kind == "number":
        return F.when(~F.isnan(c), c)
    if v.kind == "boolean":
        return c.cast("int").cast("double")
    if v.kind == "text":
        return _text_number(c)
    if v.kind == "null":
        return F.lit(0.0)
    if v.kind == "target":
        return (
            F.when(c.isNull() | c["kind"].isNull() | (c["kind"] == "null"), F.lit(0.0))
            .when(c["kind"] == "number", F.when(~F.isnan(c["n"]), c["n"]))
            .when(c["kind"] == "boolean", c["b"].cast("int").cast("double"))
            .otherwise(_text_number(c["s"]))
        )
    return F.lit(None).cast("double")


def to_text(v: Value) -> Column:
    c = v.column
    if v.kind == "text":
        return c
    if v.kind == "number":
        return js_number_text(c)
    if v.kind == "boolean":
        return c.cast("string")
    if v.kind == "target":
        said = F.when(c["kind"] == "string", c["s"]).when(c["kind"] == "number", js_number_text(c["n"])).when(c["kind"] == "boolean", c["b"].cast("string"))
        return F.coalesce(said, F.lit("null"))
    return F.lit("null")


def is_text(v: Value) -> Column:
    return F.lit(True) if v.kind == "text" else F.coalesce(v.column["kind"] == "string", F.lit(False)) if v.kind == "target" else F.lit(False)


def is_null(v: Value) -> Column:
    if v.kind == "target":
        return v.column.isNull() | v.column["kind"].isNull() | (v.column["kind"] == "null")
    return F.lit(True) if v.kind == "null" else v.column.isNull() if v.kind in ("text", "boolean") else F.lit(False)


def truth(v: Value) -> Column:
    c = v.column
    if v.kind == "array":
        return F.size(c) > 0 if c is not None else F.lit(bool(v.parts))
    if v.kind == "number":
        return F.coalesce((c != 0) & ~F.isnan(c), F.lit(False))
    if v.kind == "text":
        return F.coalesce(c != "", F.lit(False))
    if v.kind == "boolean":
        return F.coalesce(c, F.lit(False))
    if v.kind == "target":
        number = (c["n"] != 0) & ~F.isnan(c["n"])
        return F.coalesce(F.when(c["kind"] == "string", c["s"] != "").when(c["kind"] == "number", number).when(c["kind"] == "boolean", c["b"]), F.lit(False))
    return F.lit(False)


def compare(a: Value, b: Value, operator: str) -> Column:
    ordered: dict[str, Callable[[Column, Column], Column]] = {
        "<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y,
    }
    test = ordered[operator]
    return F.coalesce(F.when(is_text(a) & is_text(b), test(to_text(a), to_text(b))).otherwise(test(to_number(a), to_number(b))), F.lit(False))


def loosely_equal(a: Value, b: Value) -> Column:
    none = is_null(a) | is_null(b)
    same = F.when(is_text(a) & is_text(b), to_text(a) == to_text(b)).otherwise(to_number(a) == to_number(b))
    return F.coalesce(F.when(none, is_null(a) & is_null(b)).otherwise(same), F.lit(False))


def _kind(v: Value) -> Column:
    return F.coalesce(v.column["kind"], F.lit("null")) if v.kind == "target" else F.lit({"text": "string"}.get(v.kind, v.kind))


def strictly_equal(a: Value, b: Value) -> Column:
    return (_kind(a) == _kind(b)) & loosely_equal(a, b)


class Compiler:
    """fields: columns by dotted name, with their kinds (number, text, boolean, target, or array:<kind>)."""

    def __init__(self, fields: Mapping[str, tuple[Column, str]]):
        self.fields = fields

    def predicate(self, logic: Any) -> Column:
        """Whether the logic holds. What isn't logic (an object without exactly one key) holds always."""
        if isinstance(logic, dict) and len(logic) != 1:
            return F.lit(True)
        return truth(self.value(logic))

    def value(self, logic: Any, item: Value | None = None, extra: Mapping[str, Value] | None = None) -> Value:
        if isinstance(logic, list):
            return self._array([self.value(x, item, extra) for x in logic])
        if not isinstance(logic, dict):
            return _as_value(logic)
        if len(logic) != 1:
            return Value("boolean", F.lit(True))
        operator, args = next(iter(logic.items()))
        args = args if isinstance(args, list) else [args]
        if operator == "var":
            return self._var(args, item, extra)
        if operator in ("map", "filter", "all", "some", "none", "reduce"):
            return self._over_array(operator, args, item, extra)
        if operator in ("missing", "missing_some"):
            return self._missing(operator, args, item, extra)
        if operator in ("??", "method"):
            return Value("boolean", F.lit(False))  # no such operation: nothing matches
        return self._operation(operator, [self.value(x, item, extra) for x in args])

    @staticmethod
    def _array(parts: list[Value]) -> Value:
        kinds = {p.kind for p in parts}
        kind = kinds.pop() if len(kinds) == 1 else None
        column = F.array(*(p.column for p in parts)) if parts and kind in ("number", "text", "boolean", "target") else None
        return Value("array", column, parts, kind)

    def _var(self, args: list[Any], item: Value | None, extra: Mapping[str, Value] | None) -> Value:
        name = args[0] if args else ""
        name = "" if name is None else str(name)
        default = self.value(args[1], item, extra) if len(args) > 1 else Value("null", F.lit(None))
        if extra and name in extra:
            return extra[name]
        if item is not None:
            if name == "":
                return item
            return default
        if name not in self.fields:
            return default
        column, kind = self.fields[name]
        if kind.startswith("array:"):
            return Value("array", column, None, kind[6:])
        if len(args) < 2:
            return Value(kind, column) if kind != "number" else Value("target", _boxed(column, kind))
        found = Value("target", column if kind == "target" else _boxed(column, kind))
        return Value("target", F.when(is_null(found), _boxed(default.column, default.kind)).otherwise(found.column))

    def _missing(self, operator: str, args: list[Any], item, extra) -> Value:
        names = args[1] if operator == "missing_some" else args[0] if args and isinstance(args[0], list) else args
        gone = [F.when(is_null(v) | F.coalesce(is_text(v) & (to_text(v) == ""), F.lit(False)), F.lit(str(n))) for n in names for v in [self._var([n], item, extra)]]
        absent = F.array_compact(F.array(*gone))
        if operator == "missing_some":
            absent = F.when(len(names) - F.size(absent) >= int(args[0]), F.array().cast("array<string>")).otherwise(absent)
        return Value("array", absent, None, "text")

    def _over_array(self, operator: str, args: list[Any], item, extra) -> Value:
        source = self.value(args[0], item, extra)
        if source.kind != "array" or (source.column is None and source.parts != []):
            return Value("array", None, []) if operator in ("map", "filter") else _as_value(operator == "none") if operator != "reduce" else self.value(args[2], item, extra)
        if source.column is None:
            return Value("array", None, []) if operator in ("map", "filter") else _as_value(operator == "none") if operator != "reduce" else self.value(args[2], item, extra)
        column, kind = F.coalesce(source.column, F.array().cast(_array_type(source.element))), source.element or "target"
        test = lambda x: truth(self.value(args[1], Value(kind, x)))
        if operator == "filter":
            return Value("array", F.filter(column, test), None, kind)
        if operator == "map":
            made: list[str] = []

            def each(x: Column) -> Column:
                v = self.value(args[1], Value(kind, x))
                made.append(v.kind)
                return v.column

            mapped = F.transform(column, each)
            return Value("array", mapped, None, made[-1])
        if operator == "reduce":
            start = to_number(self.value(args[2], item, extra))
            step = lambda total, x: to_number(self.value(args[1], None, {"current": Value(kind, x), "accumulator": Value("number", total)}))
            return Value("number", F.aggregate(column, start, step))
        if operator == "all":
            return Value("boolean", (F.size(column) > 0) & F.forall(column, test))
        found = F.exists(column, test)
        return Value("boolean", ~found if operator == "none" else found)

    def _operation(self, operator: str, v: list[Value]) -> Value:
        yes = lambda c: Value("boolean", c)
        if operator in ("==", "!=", "===", "!=="):
            same = (strictly_equal if len(operator) == 3 else loosely_equal)(v[0], v[1])
            return yes(~same if operator[0] == "!" else same)
        if operator in ("<", "<=", ">", ">="):
            found = compare(v[0], v[1], operator)
            return yes(found & compare(v[1], v[2], operator) if len(v) > 2 and operator[0] == "<" else found)
        if operator in ("!", "!!"):
            return yes(~truth(v[0]) if operator == "!" else truth(v[0]))
        if operator in ("and", "or"):
            return self._deciding(operator, v)
        if operator in ("if", "?:"):
            return self._chosen(v)
        if operator == "in":
            return yes(self._contains(v[0], v[1]))
        if operator == "cat":
            return Value("text", F.concat(*(F.when(is_null(x), F.lit("")).otherwise(to_text(x)) for x in v)) if v else F.lit(""))
        if operator == "log":
            return v[0]
        if operator == "merge":
            return self._array([p for x in v for p in (x.parts if x.kind == "array" and x.parts is not None else [x])])
        if operator == "substr":
            return self._part(v)
        return Value("number", self._arithmetic(operator, [to_number(x) for x in v]))

    @staticmethod
    def _deciding(operator: str, v: list[Value]) -> Value:
        """The value that decides, as the language has it; of mixed kinds only its truth is kept."""
        kinds = {x.kind for x in v}
        if len(kinds) == 1 and kinds <= {"boolean", "number", "text", "target"}:
            column = v[-1].column
            for x in reversed(v[:-1]):
                column = F.when(truth(x) if operator == "or" else ~truth(x), x.column).otherwise(column)
            return Value(v[0].kind, column)
        column = truth(v[0])
        for x in v[1:]:
            column = column & truth(x) if operator == "and" else column | truth(x)
        return Value("boolean", column)

    @staticmethod
    def _chosen(v: list[Value]) -> Value:
        if len(v) == 1:
            return v[0]
        last = v[-1] if len(v) % 2 else Value("null", F.lit(None))
        column = _boxed(last.column, last.kind)
        for test, then in reversed(list(zip(v[0 : len(v) - 1 : 2], v[1::2], strict=False))):
            column = F.when(truth(test), _boxed(then.column, then.kind)).otherwise(column)
        return Value("target", column)

    @staticmethod
    def _contains(needle: Value, hay: Value) -> Column:
        if hay.kind == "array":
            if hay.parts is not None:
                tests = [strictly_equal(needle, p) for p in hay.parts]
                found = F.lit(False)
                for t in tests:
                    found = found | t
                return found
            return F.exists(F.coalesce(hay.column, F.array().cast(_array_type(hay.element))), lambda x: strictly_equal(needle, Value(hay.element or "target", x)))
        return F.coalesce(is_text(hay) & F.contains(to_text(hay), to_text(needle)), F.lit(False))

    @staticmethod
    def _part(v: list[Value]) -> Value:
        text, start = to_text(v[0]), to_number(v[1]).cast("int")
        size = F.length(text)
        begin = F.when(start < 0, F.greatest(size + start, F.lit(0))).otherwise(start)
        length = size if len(v) < 3 else to_number(v[2]).cast("int")
        length = F.when(length < 0, F.greatest(size - begin + length, F.lit(0))).otherwise(length) if len(v) > 2 else length
        return Value("text", F.substring(text, begin + 1, length))

    @staticmethod
    def _arithmetic(operator: str, n: list[Column]) -> Column:
        """Null, for NaN, carries through."""
        if operator == "+":
            total = n[0]
            for x in n[1:]:
                total = total + x
            return total
        if operator == "*":
            total = n[0]
            for x in n[1:]:
                total = total * x
            return total
        if operator == "-":
            return -n[0] if len(n) == 1 else n[0] - n[1]
        if operator == "/":
            by_zero = F.when(n[0] > 0, F.lit(float("inf"))).when(n[0] < 0, F.lit(float("-inf")))
            return F.when(n[1] == 0, by_zero).otherwise(F.try_divide(n[0], n[1]))
        if operator == "%":
            return F.when(n[1] != 0, F.try_mod(n[0], n[1]))
        if operator in ("min", "max"):
            known = F.lit(True)
            for x in n:
                known = known & x.isNotNull()
            return F.when(known, n[0] if len(n) == 1 else (F.least if operator == "min" else F.greatest)(*n))
        raise OperatorError(operator)


def _array_type(element: str | None) -> str:
    return {"number": "array<double>", "text": "array<string>", "boolean": "array<boolean>"}.get(element or "", "array<struct<kind:string,s:string,n:double,b:boolean>>")


def _boxed(column: Column, kind: str) -> Column:
    """Any value as a target."""
    if kind == "target":
        return column
    null = lambda t: F.lit(None).cast(t)
    name = {"text": "string"}.get(kind, kind)
    name = name if name in ("string", "number", "boolean") else "null"
    made = F.struct(
        (F.when(column.isNull(), "null").otherwise(name) if name != "null" else F.lit("null")).alias("kind"),
        (column.cast("string") if name == "string" else null("string")).alias("s"),
        (column.cast("double") if name == "number" else null("double")).alias("n"),
        (column.cast("boolean") if name == "boolean" else null("boolean")).alias("b"),
    )
    return made


def compile_predicate(logic: Any, fields: Mapping[str, tuple[Column, str]], allow_only_listed: bool = True) -> Column:
    """A boolean Column, never null. logic: parsed JSON, or JSON text."""
    if isinstance(logic, str) and logic[:1] in "{[":
        logic = json.loads(logic)
    if allow_only_listed:
        check_operators(logic)
    return Compiler(fields).predicate(logic)
