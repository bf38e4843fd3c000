"""Column helpers for targets and pointers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandlake.types import TARGET


def _target(kind: str, s: Column | None = None, n: Column | None = None, b: Column | None = None) -> Column:
    null = F.lit(None)
    return F.struct(
        F.lit(kind).alias("kind"),
        (s if s is not None else null).cast("string").alias("s"),
        (n if n is not None else null).cast("double").alias("n"),
        (b if b is not None else null).cast("boolean").alias("b"),
    )


def _or_null(value: Column, made: Column) -> Column:
    """A null value is the target null, not a missing target."""
    return F.when(value.isNull(), _target("null")).otherwise(made)


def text(value: Column) -> Column:
    return _or_null(value, _target("string", s=value))


def number(value: Column) -> Column:
    return _or_null(value, _target("number", n=value))


def boolean(value: Column) -> Column:
    return _or_null(value, _target("boolean", b=value))


def null_target() -> Column:
    return _target("null")


def pointer(label: Column | str, target: Column, context: Column | str | None = None) -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(
        as_column(label).cast("string").alias("local_context"), target.cast(TARGET).alias("target"), as_column(context).cast("string").alias("target_context")
    )


def reference(label: Column | str, entity: Column, prop: Column | str) -> Column:
    return pointer(label, text(entity), prop)


def is_reference(p: Column) -> Column:
    """Whether the pointer names an entity's property."""
    return (p["target"]["kind"] == "string") & p["target_context"].isNotNull() & (p["target_context"] != "")


def first_target(pointers: Column, test) -> Column:
    """Target of the first pointer that fulfils the test, or null."""
    return F.get(F.filter(pointers, lambda p: F.coalesce(test(p), F.lit(False))), F.lit(0))["target"]


def value_of(pointers: Column, key: Column | str) -> Column:
    """What the delta says in the slot `key`: the target of the first pointer with that label."""
    return first_target(pointers, lambda p: p["local_context"] == (key if isinstance(key, Column) else F.lit(key)))


def js_number_text(n: Column) -> Column:
    """A double as text the way the reference's runtime prints it: integers without a fraction."""
    whole = (n == F.floor(n)) & (F.abs(n) < 1e15)
    return F.when(F.isnan(n), F.lit("NaN")).when(whole, F.floor(n).cast("string")).otherwise(n.cast("string"))


def as_text(target: Column) -> Column:
    """One text for any target; null stays the word null."""
    return (
        F.when(target["kind"] == "string", target["s"])
        .when(target["kind"] == "number", js_number_text(target["n"]))
        .when(target["kind"] == "boolean", target["b"].cast("string"))
        .when(target["kind"] == "null", F.lit("null"))
    )
