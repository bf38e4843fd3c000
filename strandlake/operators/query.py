"""Schema queries: entities that have a schema's required properties, resolved to one row each, and filtered.

Two engines, as the data model has: over composed claims (negations and transactions taken into account), and
over the stored log as it is.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.functions.jsonlogic import compile_predicate
from strandlake.functions.targets import is_reference, value_of
from strandlake.operators.negation import checkpointed
from strandlake.operators.schemas import Property, Schema


def with_required(found: DataFrame, schema: Schema) -> DataFrame:
    """Entities (entity_id) that are claimed under every required property."""
    needed = schema.required_properties
    if not needed:
        return found.select("entity_id").distinct()
    there = found.where(F.col("property").isin(list(needed))).groupBy("entity_id").agg(F.countDistinct("property").alias("n"))
    return there.where(F.col("n") == len(needed)).select("entity_id")


def _resolved(prop: Property, name: str, first_write: bool) -> Column:
    """Aggregate over an entity's claims: the property's value."""
    said = (F.col("property") == name) & F.col("value.kind").isNotNull()
    if prop.kind == "array" or prop.kind == "reference":
        kept = F.collect_list(F.when(said & (F.col("value.kind") != "null"), F.struct("time_created", "ingest_seq", "value")))
        return F.transform(F.array_sort(kept), lambda x: x["value"])
    value = F.when(said, F.col("value"))
    if first_write:
        # oldest value that isn't null; of equally old ones the last that arrived
        return F.min_by(F.when(said & (F.col("value.kind") != "null"), F.col("value")), F.when(said & (F.col("value.kind") != "null"), F.struct(F.col("time_created"), (-F.col("ingest_seq")).alias("s"))))
    return F.max_by(value, F.when(said, F.struct(F.col("time_created"), (-F.col("ingest_seq")).alias("s"))))


def typed(name: str, prop: Property) -> Column:
    """A resolved column in the schema's own type, for output; what has another type is null."""
    c = F.col(name)
    if prop.kind == "primitive" and prop.primitive in ("string", "number", "boolean"):
        return c[{"string": "s", "number": "n", "boolean": "b"}[prop.primitive]]
    return c


def resolve_entities(found: DataFrame, schema: Schema, first_write: bool = False, required: tuple[str, ...] = ()) -> DataFrame:
    """One row per entity: id, _first_seq (its first arrival), and a column for each property as target.

    required: only entities that are claimed under each of these properties, told by the same aggregation."""
    wanted = found.withColumn("value", F.when(F.col("property").isin(list(schema.properties)), F.col("value")))
    there = [F.bool_or(F.col("property") == n).alias(f"_has_{i}") for i, n in enumerate(required)]
    rows = wanted.groupBy(F.col("entity_id").alias("id")).agg(
        F.min("ingest_seq").alias("_first_seq"), *(_resolved(p, n, first_write).alias(n) for n, p in schema.properties.items()), *there
    )
    for i in range(len(required)):
        rows = rows.where(F.col(f"_has_{i}"))
    return rows.drop(*(f"_has_{i}" for i in range(len(required))))


def fields_of(schema: Schema) -> dict[str, tuple[Column, str]]:
    fields = {n: (F.col(n), "target" if p.kind == "primitive" else "array:target") for n, p in schema.properties.items()}
    return {"id": (F.col("id"), "text")} | fields


def query(
    found: DataFrame,
    schema: Schema,
    logic: Any = None,
    raw: DataFrame | None = None,
    max_results: int | None = None,
    first_write: bool = False,
    ordered: bool = False,
) -> DataFrame:
    """Entities with all required properties that fulfil the logic.

    found: visible claims. raw: all claims of the log, where the required properties are looked up; by
    default the visible ones. first_write: the oldest value of a property wins instead of the latest.
    max_results: the first so many by arrival; 0 or None for all. ordered: keep _first_seq, the order of arrival."""
    if raw is None:
        rows = resolve_entities(found, schema, first_write, schema.required_properties)
    else:
        rows = resolve_entities(found.join(with_required(raw, schema), "entity_id", "left_semi"), schema, first_write)
    if logic is not None:
        rows = rows.where(compile_predicate(logic, fields_of(schema)))
    if max_results:
        rows = rows.orderBy("_first_seq", "id").limit(max_results)
    return rows.select("id", *(["_first_seq"] if ordered else []), *(typed(n, p).alias(n) for n, p in schema.properties.items()))


def query_with_total(found: DataFrame, schema: Schema, logic: Any = None, max_results: int | None = None, raw: DataFrame | None = None) -> tuple[DataFrame, int, bool]:
    """(results, total found, whether the limit left any out)."""
    rows = query(found, schema, logic, raw, ordered=True)
    if not max_results:
        rows = checkpointed(rows.drop("_first_seq"))
        return rows, rows.count(), False
    # one run of the query serves the rows and their number
    seen = checkpointed(rows)
    total = seen.count()
    return seen.orderBy("_first_seq", "id").limit(max_results).drop("_first_seq"), total, total > max_results


def query_one(found: DataFrame, schema: Schema, entity_id: str) -> DataFrame:
    """The entity's row if all required properties are visible, else none."""
    return query(found.where(F.col("entity_id") == entity_id), schema)


def statistics(found: DataFrame, schemas: list[Schema]) -> DataFrame:
    """(schema_id, candidates) for each schema; entities altogether under schema_id null."""
    out = found.agg(F.countDistinct("entity_id").alias("candidates")).select(F.lit(None).cast("string").alias("schema_id"), "candidates")
    for s in schemas:
        out = out.unionByName(with_required(found, s).agg(F.count("*").alias("candidates")).select(F.lit(s.id).alias("schema_id"), "candidates"))
    return out


def storage_query(log: DataFrame, schema: Schema, logic: Any = None, use_indexes: bool = True, where: Column | str | None = None, max_results: int | None = None) -> DataFrame:
    """The query over stored deltas: negations and transactions play no part, and every operator is allowed.

    use_indexes: with required properties only deltas that touch one of them are read, so that other properties
    said elsewhere are null, and `where` plays no part."""
    needed = list(schema.required_properties)
    if use_indexes and needed:
        log = log.where(F.exists("pointers", lambda p: is_reference(p) & p["target_context"].isin(needed)))
    elif where is not None:
        log = log.where(where)
    targets = F.array_distinct(F.transform(F.filter("pointers", is_reference), lambda p: p["target"]["s"]))
    each = log.withColumn("entity_id", F.explode(targets))
    # of each delta an entity has the properties under which it is targeted
    at = lambda e: F.array_distinct(F.transform(F.filter("pointers", lambda p: is_reference(p) & (p["target"]["s"] == e)), lambda p: p["target_context"]))
    rows = each.withColumn("property", F.explode(at(F.col("entity_id"))))
    found = rows.select("entity_id", "property", "delta_id", "time_created", "ingest_seq", value_of(F.col("pointers"), F.col("property")).alias("value"))
    out = resolve_entities(found, schema, required=schema.required_properties)
    if logic is not None:
        out = out.where(compile_predicate(logic, fields_of(schema), allow_only_listed=False))
    if max_results:
        out = out.orderBy("_first_seq", "id").limit(max_results)
    return out.select("id", *(typed(n, p).alias(n) for n, p in schema.properties.items()))

