"""Building deltas one at a time, in plain Python, and their two wire forms.

A delta is a dict with the fields of the log's rows. `pointers` of the second form are a dict from label to
a scalar or to {entity: property}; the first form lists {local_context, target, target_context}.
"""

from __future__ import annotations

import time
import uuid
from typing import Any

from strandlake.functions.validation import PointerError, validate_image
from strandlake.types import MEMBERS, NEGATED_BY, NEGATES, SIZE, TRANSACTION


def tagged(value: Any) -> dict:
    """A Python scalar as a target."""
    kind = "null" if value is None else "boolean" if isinstance(value, bool) else "number" if isinstance(value, (int, float)) else "string"
    return {
        "kind": kind,
        "s": value if kind == "string" else None,
        "n": float(value) if kind == "number" else None,
        "b": value if kind == "boolean" else None,
    }


def untagged(target: dict | None) -> Any:
    if target is None or target["kind"] == "null":
        return None
    return target[{"string": "s", "number": "n", "boolean": "b"}[target["kind"]]]


class DeltaBuilder:
    """Collects pointers, then builds a row of the log. Labels are unique."""

    def __init__(self, creator: str, host: str):
        self.creator, self.host = creator, host
        self.delta_id = str(uuid.uuid4())
        self.time_created = time.time_ns() // 1000
        self._pointers: dict[str, tuple[Any, str | None]] = {}

    def with_id(self, delta_id: str) -> DeltaBuilder:
        self.delta_id = delta_id
        return self

    def with_timestamp(self, time_created: int) -> DeltaBuilder:
        self.time_created = time_created
        return self

    def add_pointer(self, label: str, target: Any, context: str | None = None) -> DeltaBuilder:
        """A reference where there is a context and the target is a string, else a scalar."""
        given = (target, context if context and isinstance(target, str) else None)
        if self._pointers.setdefault(label, given) != given:
            raise PointerError(f"the label {label!r} already has another target", "pointers")
        return self

    def set_property(self, entity: str, prop: str, value: Any, label: str = "entity") -> DeltaBuilder:
        return self.add_pointer(label, entity, prop).add_pointer(prop, value)

    def relate(self, source: str, target: str, kind: str, properties: dict[str, Any] | None = None, relation_id: str | None = None) -> DeltaBuilder:
        """An entity of its own stands for the relation of two others."""
        relation = relation_id or str(uuid.uuid4())
        self.set_property(relation, "source", source, "_rel_source").set_property(relation, "target", target, "_rel_target")
        self.set_property(relation, "type", kind, "_rel_type")
        for name, value in (properties or {}).items():
            self.set_property(relation, name, value, f"_rel_{name}")
        return self

    def in_transaction(self, transaction_id: str) -> DeltaBuilder:
        return self.add_pointer(TRANSACTION, transaction_id, MEMBERS)

    def declare_transaction(self, transaction_id: str, size: int) -> DeltaBuilder:
        return self.add_pointer(TRANSACTION, transaction_id, SIZE).add_pointer(SIZE, size)

    def negate(self, delta_id: str) -> DeltaBuilder:
        return self.add_pointer(NEGATES, delta_id, NEGATED_BY)

    def build(self, ingest_seq: int | None = None, received_from: str | None = None) -> dict:
        pointers = [{"local_context": label, "target": tagged(t), "target_context": c} for label, (t, c) in self._pointers.items()]
        return {
            "delta_id": self.delta_id,
            "time_created": self.time_created,
            "host": self.host,
            "creator": self.creator,
            "pointers": pointers,
            "received_from": received_from,
            "ingest_seq": ingest_seq,
        }

    def build_v2(self) -> dict:
        return to_v2(self.build())


def to_v2(delta: dict) -> dict:
    """The wire form whose pointers are a dict."""
    pointers = {p["local_context"]: {untagged(p["target"]): p["target_context"]} if p["target_context"] else untagged(p["target"]) for p in delta["pointers"]}
    return {"id": delta["delta_id"], "timeCreated": delta["time_created"], "host": delta["host"], "creator": delta["creator"], "pointers": pointers}


def to_v1(delta: dict) -> dict:
    """The wire form whose pointers are a list; what is local to this store is left out."""
    pointers = []
    for p in delta["pointers"]:
        one = {"localContext": p["local_context"], "target": untagged(p["target"])}
        pointers.append(one | ({"targetContext": p["target_context"]} if p["target_context"] else {}))
    return {"id": delta["delta_id"], "timeCreated": delta["time_created"], "host": delta["host"], "creator": delta["creator"], "pointers": pointers}


def from_image(image: dict, ingest_seq: int | None = None, received_from: str | None = None) -> dict:
    """A row of the log from either wire form, validated."""
    validate_image(image)
    rows = []
    if isinstance(image["pointers"], dict):
        for label, target in image["pointers"].items():
            entity, context = next(iter(target.items())) if isinstance(target, dict) else (target, None)
            rows.append((label, entity, context))
    else:
        rows = [(p["localContext"], p["target"], p.get("targetContext")) for p in image["pointers"]]
    return {
        "delta_id": image["id"],
        "time_created": image["timeCreated"],
        "host": image["host"],
        "creator": image["creator"],
        "pointers": [{"local_context": a, "target": tagged(b), "target_context": c} for a, b, c in rows],
        "received_from": received_from,
        "ingest_seq": ingest_seq,
    }
