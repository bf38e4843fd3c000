"""Resolvers: one value for each property that has many claims.

All take claims (see `compose.claims`) and give the long form (entity_id, property, ...). Built-in ones are
single aggregates, combined map-side before the exchange by (entity_id, property); claims of one entity or
property can be any number. User-defined folds are in `folds`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.functions.targets import as_text

KEY = ("entity_id", "property")


def valued(found: DataFrame) -> DataFrame:
    """Claims that say a value; a claim without one only links."""
    return found.where("value.kind IS NOT NULL")


def _collated(name: str) -> Column:
    """Ties are broken in the order of words (a < B), not of code points."""
    return F.collate(F.col(name), "UNICODE")


#: Orders of equal times. With all equal, what arrived first stays.
TIES: dict[str, Callable[[], list[Column]]] = {
    "delta-id": lambda: [_collated("delta_id")],
    "creator": lambda: [_collated("creator")],
    "host": lambda: [_collated("host")],
    # texts among themselves by the text, above others; others by delta id
    "lexicographic": lambda: [(F.col("value.kind") == "string"), F.collate(F.when(F.col("value.kind") == "string", F.col("value.s")).otherwise(F.col("delta_id")), "UNICODE")],
}


def last_write(found: DataFrame, tie: str = "delta-id") -> DataFrame:
    """The value with the latest time, ties by `tie`: (entity_id, property, value, time_created)."""
    order = F.struct(F.col("time_created"), *(c.alias(f"t{i}") for i, c in enumerate(TIES[tie]())), (-F.col("ingest_seq")).alias("first"))
    chosen = F.max_by(F.struct("value", "time_created"), order)
    return valued(found).groupBy(*KEY).agg(chosen.alias("x")).select(*KEY, "x.value", "x.time_created")


def last_arrival_write(found: DataFrame) -> DataFrame:
    """The value with the latest time; of equal times the one that arrived last."""
    chosen = F.max_by("value", F.struct("time_created", "ingest_seq"))
    return valued(found).groupBy(*KEY).agg(chosen.alias("value"))


# Numeric aggregates

AGGREGATES: dict[str, Callable[[Column], Column]] = {"min": F.min, "max": F.max, "sum": F.sum, "average": F.avg, "count": F.count}


def aggregate(found: DataFrame, kinds: dict[str, str] | str) -> DataFrame:
    """(entity_id, property, value double). kinds: one of AGGREGATES for all properties, or by property.

    Only numbers count; a property that is claimed without any is 0; properties not named don't appear."""
    number = F.col("value.n")
    if isinstance(kinds, str):
        return found.groupBy(*KEY).agg(F.coalesce(AGGREGATES[kinds](number), F.lit(0.0)).cast("double").alias("value"))
    needed = {kind: F.coalesce(AGGREGATES[kind](number), F.lit(0.0)).cast("double") for kind in set(kinds.values())}
    sums = found.where(F.col("property").isin(list(kinds))).groupBy(*KEY).agg(*(c.alias(f"_{kind}") for kind, c in needed.items()))
    value = F.lit(None).cast("double")
    for prop, kind in kinds.items():
        value = F.when(F.col("property") == prop, F.col(f"_{kind}")).otherwise(value)
    return sums.select(*KEY, value.alias("value"))


# Built-in plugins: each gives (entity_id, property, value) with a target as value, or a text or double


def first_write_plugin(found: DataFrame) -> DataFrame:
    """Earliest value; of equal times the first that arrived; null is a value."""
    return valued(found).groupBy(*KEY).agg(F.min_by("value", F.struct("time_created", "ingest_seq")).alias("value"))


def last_write_plugin(found: DataFrame, falsy_as_empty: bool = True) -> DataFrame:
    """Latest value; of equal times the first that arrived.

    falsy_as_empty: 0, false and null become the empty text, an oddity of the reference; without, they stay what they are."""
    chosen = valued(found).groupBy(*KEY).agg(F.max_by("value", F.struct(F.col("time_created"), (-F.col("ingest_seq")).alias("first"))).alias("v"))
    v = F.col("v")
    if not falsy_as_empty:
        return chosen.select(*KEY, v.alias("value"))
    empty = (v["kind"] == "null") | ((v["kind"] == "number") & ((v["n"] == 0) | F.isnan(v["n"]))) | ((v["kind"] == "boolean") & ~v["b"])
    made = F.struct(F.lit("string").alias("kind"), F.lit("").alias("s"), F.lit(None).cast("double").alias("n"), F.lit(None).cast("boolean").alias("b"))
    return chosen.select(*KEY, F.when(empty, made).otherwise(v).alias("value"))


def concatenation_plugin(found: DataFrame, separator: str = " ") -> DataFrame:
    """Texts in order of time, each once, joined. The result is one value: it holds all of an entity's texts."""
    said = found.where("value.kind = 'string'")
    # repeated texts are dropped before they are gathered
    first = said.groupBy(*KEY, F.col("value.s").alias("s")).agg(F.min(F.struct("time_created", "ingest_seq")).alias("at"))
    joined = first.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("at", "s"))).alias("xs"))
    texts = joined.select(*KEY, F.array_join(F.transform("xs", lambda x: x["s"]), separator).alias("value"))
    # a property that is claimed, but never by a text, is the empty text
    return valued(found).select(*KEY).distinct().join(texts, list(KEY), "left").select(*KEY, F.coalesce("value", F.lit("")).alias("value"))


def majority_plugin(found: DataFrame) -> DataFrame:
    """Most frequent value; of equally frequent ones the first that arrived; values of other kinds differ."""
    votes = valued(found).groupBy(*KEY, "value").agg(F.count("*").alias("votes"), F.min("ingest_seq").alias("first"))
    return votes.groupBy(*KEY).agg(F.max_by("value", F.struct(F.col("votes"), (-F.col("first")).alias("f"))).alias("value"))


def extreme_plugin(found: DataFrame, largest: bool) -> DataFrame:
    number = found.where("value.kind = 'number'").groupBy(*KEY)
    return number.agg((F.max if largest else F.min)("value.n").alias("value"))


def running_average_plugin(found: DataFrame) -> DataFrame:
    """Mean in which what isn't a number counts as 0."""
    return valued(found).groupBy(*KEY).agg(F.avg(F.coalesce("value.n", F.lit(0.0))).alias("value"))


def extreme_of_resolved(found: DataFrame, prop: str, largest: bool) -> DataFrame:
    """(entity_id, value): the largest or smallest that the last write of `prop` has ever been, in order of arrival.

    Each change of the resolved value is one of its claims at a new latest time, so a running maximum of the
    order decides, and no claim is compared with more than its predecessors' maximum."""
    from pyspark.sql import Window as W

    so_far = W.partitionBy("entity_id").orderBy("ingest_seq").rowsBetween(W.unboundedPreceding, W.currentRow)
    order = F.struct(F.col("time_created"), (-F.col("ingest_seq")).alias("first"))
    said = valued(found).where(F.col("property") == prop)
    running = said.withColumn("now", F.max_by("value", order).over(so_far))
    numbers = running.where("now.kind = 'number'")
    return numbers.groupBy("entity_id").agg((F.max if largest else F.min)("now.n").alias("value"))


def last_numbers(found: DataFrame, properties: tuple[str, ...]) -> DataFrame:
    """(entity_id, a column for each property): the number that arrived last. Formulas over them are Columns, so
    values that depend on one another need no user-defined fold."""
    columns = [F.max_by(F.when(F.col("property") == p, F.col("value.n")), F.when((F.col("property") == p) & F.col("value.n").isNotNull(), F.col("ingest_seq"))).alias(p) for p in properties]
    return found.where(F.col("property").isin(list(properties))).groupBy("entity_id").agg(*columns)


def resolved_text(frame: DataFrame) -> DataFrame:
    """Long form with targets as text, for comparison and display."""
    return frame.withColumn("value", as_text(F.col("value")))
