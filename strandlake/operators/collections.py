"""Collections: entities that deltas point at under a collection's name, and changes to them as deltas."""

from __future__ import annotations

import hashlib
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions.builder import DeltaBuilder, tagged
from strandlake.operators.compose import claims
from strandlake.operators.resolvers import last_write
from strandlake.operators.schemas import Registry, Schema, apply_schema, validate, validation_statistics
from strandlake.sources.store import Store
from strandlake.types import DELTA


def ids(found: DataFrame, collection: str) -> DataFrame:
    """Entities that are referenced under the collection's name."""
    return found.where(F.col("local_context") == collection).select("entity_id").distinct()


def resolve(found: DataFrame, entity_id: str) -> DataFrame:
    """An entity's latest values."""
    return last_write(found.where(F.col("entity_id") == entity_id))


def changes(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows (entity_id, property, value) of `wanted` that differ from the latest values; `id` never does."""
    now = last_write(found.join(wanted.select("entity_id").distinct(), "entity_id", "left_semi")).select("entity_id", "property", F.col("value").alias("now"))
    # the join compares values null-safely, field by field
    joined = wanted.where(F.col("property") != "id").join(now, ["entity_id", "property"], "left")
    return joined.where(~F.col("value").eqNullSafe(F.col("now"))).drop("now")


class Collection:
    """Reads and writes one collection over a log. Writes give deltas; appending them is the caller's part."""

    def __init__(self, name: str, found: DataFrame, schema: Schema | None = None, registry: Registry | None = None, strict: bool = False):
        self.name, self.found, self.schema, self.registry, self.strict = name, found, schema, registry or Registry(), strict

    def ids(self) -> DataFrame:
        return ids(self.found, self.name)

    def resolve(self, entity_id: str) -> DataFrame:
        return resolve(self.found, entity_id)

    def members(self) -> DataFrame:
        return self.found.join(self.ids(), "entity_id", "left_semi")

    def valid(self) -> DataFrame:
        return validate(self.members(), self.schema, self.registry).where("valid").select("entity_id")

    def invalid(self) -> DataFrame:
        return validate(self.members(), self.schema, self.registry).where("NOT valid")

    def statistics(self) -> DataFrame:
        return validation_statistics(self.members(), self.schema, self.registry)

    def views(self) -> DataFrame:
        """Members' claims on the schema's properties."""
        return apply_schema(self.members(), self.schema)

    def put(self, entity_id: str, properties: dict[str, Any], creator: str, host: str, time: int, seq: int) -> list[dict]:
        """Deltas for what changes; of more than one, members of a transaction that is declared first."""
        if self.strict and self.schema:
            self._check(properties)
        spark = self.found.sparkSession
        rows = [(entity_id, k, tagged(v)) for k, v in properties.items()]
        wanted = spark.createDataFrame(rows, "entity_id string, property string, value struct<kind:string,s:string,n:double,b:boolean>")
        changed = sorted(r.property for r in changes(self.found, wanted).collect())
        named = lambda what: hashlib.sha256(f"{entity_id}|{what}|{time}|{seq}".encode()).hexdigest()[:32]
        build = lambda what: DeltaBuilder(creator, host).with_id(named(what)).with_timestamp(time)
        out = []
        if len(changed) > 1:
            out.append(build("declare").declare_transaction(named("tx"), len(changed)))
        for k in changed:
            delta = build(k).set_property(entity_id, k, properties[k], self.name)
            out.append(delta.in_transaction(named("tx")) if len(changed) > 1 else delta)
        return [d.build(seq + i) for i, d in enumerate(out)]

    def save(self, store: Store, entity_id: str, properties: dict[str, Any], creator: str, host: str, time: int) -> DataFrame:
        """Appends what put gives to the store, and resolves the entity from the store's log."""
        deltas = self.put(entity_id, properties, creator, host, time, store.next_seq())
        if deltas:
            store.append(self.found.sparkSession.createDataFrame(deltas, DELTA))
        return resolve(claims(store.log(), [entity_id]), entity_id)

    def _check(self, properties: dict[str, Any]) -> None:
        for name in self.schema.required_properties:
            if properties.get(name) is None:
                raise ValueError(f"required property {name} is missing")
        for name, value in properties.items():
            prop = self.schema.properties.get(name)
            if prop is not None and prop.kind == "primitive" and tagged(value)["kind"] != prop.primitive:
                raise ValueError(f"property {name}: expected {prop.primitive}, found {tagged(value)['kind']}")
            if prop is not None and prop.kind == "reference" and not isinstance(value, str):
                raise ValueError(f"property {name}: expected a reference")
