"""Nested resolution: references of a schema followed to a bounded depth.

Levels are unrolled into joins, since the depth is known when the plan is made. The long form, one row per
step, is the working result; `objects` folds one root's rows into nested Python values for display.

A step row: root, parent_id, parent_path, property, depth, delta_id, kind (entity, composite, scalar or
truncated), label, node_id, schema_id, value. A delta under a reference property gives, for its pointers but
those to the parent: one entity step, if one visible entity and nothing else is there; otherwise a composite
with an entity step for each visible entity and a scalar step for everything else.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandlake.functions.builder import untagged
from strandlake.operators.negation import checkpointed
from strandlake.operators.schemas import Property, Registry, Schema
from strandlake.types import TARGET


COLUMNS = ("root", "parent_id", "parent_path", "property", "depth", "delta_id", "kind", "label", "node_id", "node_path", "schema_id", "value")
#: Ids that a condition may list, instead of a join.
FEW = 500


def _references(schema: Schema) -> dict[str, Property]:
    """Properties that nest, with their reference."""
    found = {}
    for name, prop in schema.properties.items():
        inner = prop.item if prop.kind == "array" else prop
        if inner is not None and inner.kind == "reference":
            found[name] = inner
    return found


def steps(found: DataFrame, registry: Registry, schema_id: str, roots: DataFrame | list[str] | None = None, max_depth: int = 3) -> DataFrame:
    """All steps from the roots (a frame with entity_id, a list, or every visible entity)."""
    spark = found.sparkSession
    schemas, level, out = {schema_id}, None, None
    allowed = _allowed(registry, schemas, 0, max_depth) if max_depth > 0 else []
    for depth in range(max_depth):
        if not allowed:
            break
        claimed = found.where(F.col("property").isin(sorted({name for _, name, _ in allowed}))).select(F.col("entity_id").alias("node_id"), "property", "delta_id", "pointers")
        here = _of_roots(claimed, roots, allowed) if level is None else _of_level(claimed, level, allowed)
        made = _expand(here, claimed, found.select("entity_id"), depth, max_depth)
        schemas = {r.target_schema for s in schemas if (known := registry.get(s)) for r in _references(known).values() if r.target_schema}
        allowed = _allowed(registry, schemas, depth + 1, max_depth) if depth + 1 < max_depth else []
        if allowed:
            made = checkpointed(made)  # read twice: as steps, and as the next level's parents
        out = made if out is None else out.unionByName(made)
        level = made.where("kind = 'entity'").select("root", "node_id", "node_path", "schema_id").distinct()
    if out is None:
        return spark.createDataFrame([], "root string, parent_id string, parent_path string, property string, depth int, delta_id string, kind string, label string, node_id string, node_path string, schema_id string, value struct<kind:string,s:string,n:double,b:boolean>")
    return out.select(*COLUMNS)


def _allowed(registry: Registry, schemas: set[str], depth: int, max_depth: int) -> list[tuple[str, str, str]]:
    """(schema, property, target schema) of the references that are followed from this depth."""
    found = []
    for s in sorted(schemas):
        known = registry.get(s)
        for name, ref in (_references(known) if known else {}).items():
            if depth < (ref.max_depth or max_depth) and registry.get(ref.target_schema or "") is not None:
                found.append((s, name, ref.target_schema))
    return found


def _few(ids: DataFrame) -> list[str] | None:
    """The ids, if there are FEW at most."""
    rows = ids.limit(FEW + 1).collect()
    return [r[0] for r in rows] if len(rows) <= FEW else None


def _of_roots(claimed: DataFrame, roots: DataFrame | list[str] | None, allowed: list[tuple[str, str, str]]) -> DataFrame:
    """The roots' own claims. An entity that has a claim is visible.

    Claims that roots of a frame don't have are told by the ids missing from it, if those are few: only ids are
    exchanged then, not claims."""
    if isinstance(roots, DataFrame):
        wanted = roots.select(F.col("entity_id").alias("node_id")).distinct()
        missing = _few(claimed.select("node_id").distinct().join(wanted, "node_id", "left_anti"))
        if missing is None:
            claimed = claimed.join(wanted, "node_id", "left_semi")
        elif missing:
            claimed = claimed.where(~F.col("node_id").isin(missing))
    elif roots is not None:
        claimed = claimed.where(F.col("node_id").isin(list(roots)))
    target = F.create_map(*(F.lit(x) for _, name, to in allowed for x in (name, to)))  # of one schema, so by property alone
    return claimed.select(F.col("node_id").alias("root"), F.col("node_id").alias("parent_id"), F.lit("").alias("parent_path"), "property", target[F.col("property")].alias("target_schema"), "delta_id", "pointers")


def _of_level(claimed: DataFrame, level: DataFrame, allowed: list[tuple[str, str, str]]) -> DataFrame:
    """Claims of the entities that the level before reached."""
    rules = level.sparkSession.createDataFrame(allowed, "schema_id string, property string, target_schema string")
    return (
        level.join(F.broadcast(rules), "schema_id")  # a few rows: the schemas' own properties
        .join(claimed, ["node_id", "property"])
        .select("root", F.col("node_id").alias("parent_id"), F.col("node_path").alias("parent_path"), "property", "target_schema", "delta_id", "pointers")
    )


def _slots(here: DataFrame, claimed: DataFrame, entities: DataFrame) -> DataFrame:
    """A row for each pointer but those to the parent: pos, p, s (a text target), is_entity, and of the delta n_slots and n_entities.

    Most texts in references name visible entities. Those that don't are looked for among the distinct ones;
    where they are few, each delta is judged in place, and otherwise its slots are joined with the entities."""
    is_text = lambda p: F.coalesce(p["target"]["kind"] == "string", F.lit(False))
    other = lambda p, parent: ~F.coalesce((p["target"]["kind"] == "string") & (p["target"]["s"] == F.col(parent)), F.lit(False))
    named = claimed.select(F.explode(F.filter("pointers", lambda p: is_text(p) & other(p, "node_id"))).alias("p")).select(F.col("p.target.s").alias("s")).distinct()
    missing = _few(named.where("s IS NOT NULL").join(entities.select(F.col("entity_id").alias("s")).distinct(), "s", "left_anti"))
    others = here.withColumn("pointers", F.filter("pointers", lambda p: other(p, "parent_id"))).withColumn("n_slots", F.size("pointers"))
    text = F.when(F.col("p.target.kind") == "string", F.col("p.target.s"))
    kept = [c for c in here.columns if c != "pointers"]
    if missing is not None:
        known = lambda s: s.isNotNull() & (~s.isin(missing) if missing else F.lit(True))
        counted = others.withColumn("n_entities", F.size(F.filter("pointers", lambda p: is_text(p) & known(p["target"]["s"]))))
        return counted.select(*kept, "n_slots", "n_entities", F.posexplode("pointers").alias("pos", "p")).withColumn("s", text).withColumn("is_entity", known(F.col("s")))
    visible = entities.distinct().select(F.col("entity_id").alias("s"), F.lit(True).alias("is_entity"))
    each = others.select(*kept, "n_slots", F.posexplode("pointers").alias("pos", "p")).withColumn("s", text).join(visible, "s", "left")
    per_delta = W.partitionBy("root", "parent_path", "property", "delta_id")
    return each.withColumn("n_entities", F.count_if("is_entity").over(per_delta))


def _expand(here: DataFrame, claimed: DataFrame, entities: DataFrame, depth: int, max_depth: int) -> DataFrame:
    """Steps from one level's claims to the next; entities: the visible ones, not distinct."""
    joined = _slots(here, claimed, entities)
    plain = (F.col("n_entities") == 1) & (F.col("n_slots") == 1)
    entity = F.coalesce("is_entity", F.lit(False))
    # the deepest level is a stub: the entity is named, its properties aren't followed
    kind = F.when(entity, "truncated" if depth + 1 >= max_depth else "entity").otherwise("scalar")
    composite = F.when(~plain, F.concat(F.lit("composite-"), F.col("delta_id")))
    slot_name = F.concat(F.coalesce(F.col("p.local_context"), F.lit("")), F.lit(":"), F.col("pos").cast("string"))
    null = F.lit(None).cast("string")
    slot = F.struct(
        kind.alias("kind"), F.col("p.local_context").alias("label"), F.when(entity, F.col("s")).alias("node_id"),
        F.concat_ws("/", "parent_path", "property", F.coalesce(composite, F.lit("")), slot_name, F.col("delta_id")).alias("node_path"),
        F.when(~entity, F.col("p.target")).alias("value"),
    )
    whole = F.struct(
        F.lit("composite").alias("kind"), null.alias("label"), composite.alias("node_id"),
        F.concat_ws("/", "parent_path", "property", composite).alias("node_path"), F.lit(None).cast(TARGET).alias("value"),
    )
    # a composite's own row goes with its first slot
    rows = F.when(~plain & (F.col("pos") == 0), F.array(slot, whole)).otherwise(F.array(slot))
    return joined.select(
        "root", "parent_id", "parent_path", "property", F.lit(depth + 1).alias("depth"), "delta_id", F.explode(rows).alias("x"), F.col("target_schema").alias("schema_id")
    ).select("root", "parent_id", "parent_path", "property", "depth", "delta_id", "x.kind", "x.label", "x.node_id", "x.node_path", "schema_id", "x.value")


def objects(found: DataFrame, registry: Registry, schema_id: str, root: str, max_depth: int = 3) -> dict[str, Any] | None:
    """One root as a nested object: id, schema_id, depth, truncated, properties, nested. For single entities."""
    rows = [r.asDict(recursive=True) for r in steps(found, registry, schema_id, [root], max_depth).collect()]
    claims = found.where(F.col("entity_id").isin([root, *(r["node_id"] for r in rows if r["kind"] in ("entity", "truncated"))]))
    values: dict[str, dict[str, list]] = {}
    for c in claims.orderBy("time_created", "ingest_seq").select("entity_id", "property", "value").collect():
        values.setdefault(c.entity_id, {}).setdefault(c.property, []).append(untagged(c.value.asDict()) if c.value else None)
    if root not in values:
        return None
    below: dict[tuple[str, str], list[dict]] = {}
    for r in rows:
        below.setdefault((r["parent_path"], r["property"]), []).append(r)

    def node(entity: str, schema_name: str, path: str, depth: int, truncated: bool) -> dict[str, Any]:
        schema = registry.get(schema_name)
        made: dict[str, Any] = {"id": entity, "schema_id": schema_name, "depth": depth, "truncated": truncated, "properties": {}, "nested": {}}
        if truncated or schema is None:
            return made
        made["properties"] = {k: v for k, v in values.get(entity, {}).items() if k in schema.properties}
        for name in _references(schema):
            found_here = [r for r in below.get((path, name), [])]
            out = []
            for delta in dict.fromkeys(r["delta_id"] for r in found_here):
                slots = [r for r in found_here if r["delta_id"] == delta]
                whole = next((r for r in slots if r["kind"] == "composite"), None)
                entities = [r for r in slots if r["kind"] in ("entity", "truncated")]
                inner = [(r["label"], node(r["node_id"], r["schema_id"], r["node_path"], depth + 1, r["kind"] == "truncated")) for r in entities]
                if whole is None:
                    out += [n for _, n in inner]
                    continue
                scalars: dict[str, Any] = {}
                for r in slots:
                    if r["kind"] == "scalar":
                        scalars.setdefault(r["label"], []).append(untagged(r["value"]))
                nested: dict[str, list] = {}
                for label, n in inner:
                    nested.setdefault(label, []).append(n)
                out.append({"id": whole["node_id"], "schema_id": whole["schema_id"], "depth": depth + 1, "truncated": False, "properties": {k: v[0] if len(v) == 1 else v for k, v in scalars.items()}, "nested": nested})
            made["nested"][name] = out
        return made

    return node(root, schema_id, "", 0, False)
