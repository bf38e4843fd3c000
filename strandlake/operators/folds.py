"""User-defined resolvers: reducers over an entity's claims, and plugins that depend on one another.

A plugin folds one property's values in order of arrival and then resolves its state, with the resolved
values of the plugins it depends on at hand, at every claim as they stand then. Plugins run in topological order.
An entity's claims arrive grouped and sorted and are streamed to the folds, which hold states alone.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from strandlake.functions.builder import tagged, untagged


@dataclass
class Plugin:
    """initialize() gives the state; update(state, value, claim, resolved) the next; resolve(state, resolved) the value."""

    initialize: Callable[[], Any]
    update: Callable[[Any, Any, dict, dict], Any]
    resolve: Callable[[Any, dict], Any]
    depends_on: tuple[str, ...] = ()
    #: The property whose values are folded, if not the plugin's own name.
    reads: str | None = None
    aliases: tuple[str, ...] = field(default=())
    #: Whether it is updated at every claim of the entity, with None where the claim isn't on its property.
    every: bool = False


class DependencyError(ValueError):
    pass


def in_order(plugins: dict[str, Plugin]) -> list[str]:
    """Names so that each comes after what it depends on; aliases resolve to names."""
    names = {alias: name for name, p in plugins.items() for alias in (name, *p.aliases)}
    done: list[str] = []
    open_: list[str] = []

    def visit(name: str) -> None:
        if name in done:
            return
        if name in open_:
            raise DependencyError(f"circular dependency: {' -> '.join([*open_, name])}")
        open_.append(name)
        for wanted in plugins[name].depends_on:
            if wanted not in names:
                raise DependencyError(f"dependency {wanted} not found for plugin {name}")
            visit(names[wanted])
        open_.pop()
        done.append(name)

    for name in plugins:
        visit(name)
    return done


class EntityFold:
    """The plugins' states for one entity; claims are applied in order of arrival.

    At each claim every plugin sees its dependencies resolved as they stand then: those that come before it in
    the order have taken the claim in already."""

    def __init__(self, plugins: dict[str, Plugin], order: list[str]):
        self.plugins, self.order = plugins, order
        names = {alias: name for name, p in plugins.items() for alias in (name, *p.aliases)}
        self.needs = {name: [(d, names[d]) for d in plugins[name].depends_on] for name in order}
        self.feeds = {d for needs in self.needs.values() for _, d in needs}
        self.states = {name: plugins[name].initialize() for name in order}
        self.seen: set[str] = set()

    def given(self, name: str, now: dict[str, Any]) -> dict[str, Any]:
        out = {}
        for wanted, source in self.needs[name]:
            # a dependency is known by its name, its aliases, and as what it was asked for
            out |= dict.fromkeys((wanted, source, *self.plugins[source].aliases), now[source])
        return out

    def resolve(self, name: str, now: dict[str, Any]) -> Any:
        return self.plugins[name].resolve(self.states[name], self.given(name, now))

    def apply(self, claim: dict) -> None:
        now: dict[str, Any] = {}
        for name in self.order:
            plugin = self.plugins[name]
            mine = claim["property"] == (plugin.reads or name) and claim["value"] is not None
            if mine or plugin.every:
                value = untagged(claim["value"]) if mine else None
                self.states[name] = plugin.update(self.states[name], value, claim, self.given(name, now))
                self.seen |= {name}
            if name in self.feeds:
                now[name] = self.resolve(name, now)

    def result(self) -> dict[str, Any]:
        now: dict[str, Any] = {}
        for name in self.order:
            now[name] = self.resolve(name, now)
        return {name: v for name, v in now.items() if name in self.seen or self.plugins[name].depends_on}


def fold_entity(plugins: dict[str, Plugin], rows: Iterable[dict], order: list[str] | None = None) -> dict[str, Any]:
    """Resolved values of one entity; rows: its claims in order of arrival."""
    fold_ = EntityFold(plugins, order or in_order(plugins))
    for row in rows:
        fold_.apply(row)
    return fold_.result()


_CLAIM = ("entity_id", "property", "value", "delta_id", "time_created", "creator", "host", "ingest_seq")


def _by_entity(found: DataFrame) -> DataFrame:
    return found.select(*_CLAIM).repartition("entity_id").sortWithinPartitions("entity_id", "ingest_seq", "delta_id")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, dict]]:
    """Claims by entity, and whether each begins a new one."""
    entity, any_row = None, False
    for batch in batches:
        for row in batch.to_pylist():
            yield not any_row or row["entity_id"] != entity, row
            entity, any_row = row["entity_id"], True


def _chunks(rows: Iterator[dict], schema: pa.Schema, size: int = 5000) -> Iterator[pa.RecordBatch]:
    while part := list(itertools.islice(rows, size)):
        yield pa.RecordBatch.from_pylist(part, schema=schema)


def fold(found: DataFrame, plugins: dict[str, Plugin]) -> DataFrame:
    """(entity_id, property, value): what the plugins make of each entity, values as targets."""
    order = in_order(plugins)  # faults show before anything runs
    if not any(p.every for p in plugins.values()):
        found = found.where(F.col("property").isin(sorted({p.reads or name for name, p in plugins.items()})))
    kind = pa.struct([("kind", pa.string()), ("s", pa.string()), ("n", pa.float64()), ("b", pa.bool_())])
    schema = pa.schema([("entity_id", pa.string()), ("property", pa.string()), ("value", kind)])

    def resolved(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        entity, state = None, None
        for new, row in _runs(batches):
            if new:
                if state is not None:
                    yield from ({"entity_id": entity, "property": k, "value": tagged(v)} for k, v in state.result().items())
                entity, state = row["entity_id"], EntityFold(plugins, order)
            state.apply(row)
        if state is not None:
            yield from ({"entity_id": entity, "property": k, "value": tagged(v)} for k, v in state.result().items())

    return _by_entity(found).mapInArrow(lambda b: _chunks(resolved(b), schema), "entity_id string, property string, value struct<kind string, s string, n double, b boolean>")


def reduce_entities(found: DataFrame, initial: Callable[[], Any], reducer: Callable[[Any, dict], Any], resolver: Callable[[Any], dict], schema: str) -> DataFrame:
    """A fold of each entity's claims by plain functions; resolver gives a row of `schema`, which holds entity_id."""
    made = to_arrow_schema(found.sparkSession.createDataFrame([], schema).schema)

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        entity, state, any_row = None, None, False
        for new, row in _runs(batches):
            if new:
                if any_row:
                    yield {"entity_id": entity, **resolver(state)}
                entity, state, any_row = row["entity_id"], initial(), True
            state = reducer(state, row | {"value": untagged(row["value"]), "kind": (row["value"] or {}).get("kind")})
        if any_row:
            yield {"entity_id": entity, **resolver(state)}

    return _by_entity(found).mapInArrow(lambda b: _chunks(reduced(b), made), schema)
