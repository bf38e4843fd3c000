"""Schemas: read-time templates of entities, their registry, and validation of claims against them."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRIMITIVES = ("string", "number", "boolean", "null")


@dataclass(frozen=True)
class Property:
    """kind: primitive, reference or array. An array's item is a primitive or reference property."""

    kind: str
    primitive: str | None = None
    target_schema: str | None = None
    max_depth: int | None = None
    item: Property | None = None
    max_items: int | None = None
    required: bool = False


def primitive(kind: str, required: bool = False) -> Property:
    return Property("primitive", primitive=kind, required=required)


def string(required: bool = False) -> Property:
    return primitive("string", required)


def number(required: bool = False) -> Property:
    return primitive("number", required)


def boolean(required: bool = False) -> Property:
    return primitive("boolean", required)


def reference(target_schema: str, max_depth: int = 3, required: bool = False) -> Property:
    return Property("reference", target_schema=target_schema, max_depth=max_depth, required=required)


def array_of(item: Property, max_items: int | None = None, required: bool = False) -> Property:
    return Property("array", item=item, max_items=max_items, required=required)


@dataclass(frozen=True)
class Schema:
    id: str
    name: str
    properties: dict[str, Property]
    required: tuple[str, ...] = ()
    additional_properties: bool = True
    description: str | None = None

    @property
    def required_properties(self) -> tuple[str, ...]:
        named = [*self.required, *(n for n, p in self.properties.items() if p.required)]
        return tuple(dict.fromkeys(named))


class SchemaBuilder:
    def __init__(self, schema_id: str = ""):
        self._given: dict[str, Any] = {"id": schema_id, "name": "", "description": None, "additional_properties": True}
        self._properties: dict[str, Property] = {}
        self._required: list[str] = []

    def name(self, name: str) -> SchemaBuilder:
        self._given["name"] = name
        return self

    def description(self, text: str) -> SchemaBuilder:
        self._given["description"] = text
        return self

    def property(self, name: str, prop: Property) -> SchemaBuilder:
        self._properties[name] = prop
        return self

    def required(self, *names: str) -> SchemaBuilder:
        self._required += names
        return self

    def additional_properties(self, allowed: bool = True) -> SchemaBuilder:
        self._given["additional_properties"] = allowed
        return self

    def build(self) -> Schema:
        if not self._given["id"] or not self._given["name"]:
            raise ValueError("a schema needs an id and a name")
        return Schema(properties=dict(self._properties), required=tuple(self._required), **self._given)


class Registry:
    def __init__(self, *schemas: Schema):
        self._schemas: dict[str, Schema] = {}
        for s in schemas:
            self.register(s)

    def register(self, schema: Schema) -> None:
        if not schema.id or not schema.name:
            raise ValueError("a schema needs an id and a name")
        for name, prop in schema.properties.items():
            self._check(f"{schema.id}.{name}", prop)
        for name in schema.required:
            if name not in schema.properties:
                raise ValueError(f"{schema.id}: required property {name} is not defined")
        self._schemas[schema.id] = schema

    def _check(self, at: str, prop: Property) -> None:
        if prop.kind == "primitive" and prop.primitive not in PRIMITIVES:
            raise ValueError(f"{at}: unknown primitive {prop.primitive}")
        if prop.kind == "reference":
            if not prop.target_schema:
                raise ValueError(f"{at}: a reference needs a target schema")
            if prop.max_depth is not None and prop.max_depth < 0:
                raise ValueError(f"{at}: the depth can't be negative")
        if prop.kind == "array":
            if prop.item is None:
                raise ValueError(f"{at}: an array needs an item schema")
            if prop.max_items is not None and prop.max_items < 0:
                raise ValueError(f"{at}: the number of items can't be negative")
            self._check(f"{at}[]", prop.item)
        if prop.kind not in ("primitive", "reference", "array"):
            raise ValueError(f"{at}: unknown kind {prop.kind}")

    def get(self, schema_id: str) -> Schema | None:
        return self._schemas.get(schema_id)

    def list(self) -> list[Schema]:
        return [*self._schemas.values()]

    def dependencies(self) -> dict[str, set[str]]:
        """Which schemas each refers to."""
        found: dict[str, set[str]] = {}
        for s in self._schemas.values():
            targets = [(p.item if p.kind == "array" else p).target_schema for p in s.properties.values()]
            found[s.id] = {t for t in targets if t}
        return found

    def has_cycle(self) -> bool:
        """A schema that refers to itself is a cycle too."""
        graph, state = self.dependencies(), {}

        def visit(node: str) -> bool:
            state[node] = 1
            for n in graph.get(node, ()):
                if state.get(n) == 1 or (n not in state and visit(n)):
                    return True
            state[node] = 2
            return False

        return any(visit(n) for n in graph if n not in state)


def _fault(prop: Property, registry: Registry) -> tuple[Column, Column]:
    """(error, warning) texts of one claim on a property, or nulls."""
    none = F.lit(None).cast("string")
    kind = F.coalesce(F.col("value.kind"), F.lit("missing"))
    if prop.kind == "primitive":
        wrong = kind != prop.primitive
        return F.when(wrong, F.concat(F.lit(f"expected {prop.primitive}, found "), kind)).otherwise(none), none
    if prop.kind == "reference":
        unknown = registry.get(prop.target_schema or "") is None
        return F.when(kind != "string", F.concat(F.lit("expected a reference, found "), kind)).otherwise(none), F.lit(f"unknown schema {prop.target_schema}" if unknown else None).cast("string")
    return none, F.lit("array items are not checked")


def faults(found: DataFrame, schema: Schema, registry: Registry) -> DataFrame:
    """(entity_id, property, level, message) of every fault, one per claim or missing property.

    found: claims of the entities that the schema is meant for."""
    none = F.lit(None).cast("string")
    error = warning = none
    for name, prop in schema.properties.items():
        e, w = _fault(prop, registry)
        here = F.col("property") == name
        error, warning = F.when(here, e).otherwise(error), F.when(here, w).otherwise(warning)
    if not schema.additional_properties:
        warning = F.when(~F.col("property").isin(list(schema.properties)), F.lit("property not in the schema")).otherwise(warning)
    checked = found.select(
        "entity_id", "property",
        F.filter(F.array(F.struct(F.lit("error").alias("level"), error.alias("message")), F.struct(F.lit("warning").alias("level"), warning.alias("message"))), lambda x: x["message"].isNotNull()).alias("xs"),
    ).select("entity_id", "property", F.inline("xs"))
    needed = schema.required_properties
    if not needed:
        return checked
    there = found.groupBy("entity_id").agg(*(F.coalesce(F.bool_or(F.col("property") == n), F.lit(False)).alias(f"_{i}") for i, n in enumerate(needed)))
    gone = F.array_compact(F.array(*(F.when(~F.col(f"_{i}"), F.lit(n)) for i, n in enumerate(needed))))
    missing = there.select("entity_id", F.explode(gone).alias("property")).select("entity_id", "property", F.lit("error").alias("level"), F.lit("required property is missing").alias("message"))
    return checked.unionByName(missing)


def validate(found: DataFrame, schema: Schema, registry: Registry) -> DataFrame:
    """(entity_id, valid, n_errors, n_warnings) of every entity with a visible claim."""
    bad = faults(found, schema, registry).groupBy("entity_id").agg(F.count_if(F.col("level") == "error").alias("n_errors"), F.count_if(F.col("level") == "warning").alias("n_warnings"))
    counted = found.select("entity_id").distinct().join(bad, "entity_id", "left")
    errors, warnings = (F.coalesce(c, F.lit(0)) for c in ("n_errors", "n_warnings"))
    return counted.select("entity_id", (errors == 0).alias("valid"), errors.alias("n_errors"), warnings.alias("n_warnings"))


def validation_statistics(found: DataFrame, schema: Schema, registry: Registry) -> DataFrame:
    """One row: entities, valid, invalid, with_warnings."""
    each = validate(found, schema, registry)
    return each.agg(
        F.count("*").alias("entities"), F.count_if("valid").alias("valid"), F.count_if(~F.col("valid")).alias("invalid"), F.count_if(F.col("n_warnings") > 0).alias("with_warnings")
    )


def error_histogram(found: DataFrame, schema: Schema, registry: Registry) -> DataFrame:
    return faults(found, schema, registry).groupBy("level", "property", "message").agg(F.count("*").alias("n"))


def applied(found: DataFrame, schema: Schema, registry: Registry, strict: bool = False, metadata: bool = True) -> DataFrame:
    """Claims on the schema's properties, each with its entity's validation.

    strict: raises if any entity has an error, naming one. metadata: when and how deep the schema was applied."""
    if strict:
        worst = faults(found, schema, registry).where("level = 'error'").orderBy("entity_id", "property").first()
        if worst is not None:
            raise ValueError(f"entity {worst.entity_id}, property {worst.property}: {worst.message}")
    out = apply_schema(found, schema).join(validate(found, schema, registry), "entity_id").withColumn("schema_id", F.lit(schema.id))
    if metadata:
        out = out.withColumn("applied_at", F.current_timestamp()).withColumn("depth", F.lit(1)).withColumn("truncated", F.lit(False))
    return out


def apply_schema(found: DataFrame, schema: Schema) -> DataFrame:
    """Claims on the schema's properties only."""
    return found.where(F.col("property").isin(list(schema.properties)))
