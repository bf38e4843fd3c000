"""JSON texts as rows of a syntax tree: path, key, kind, value and depth of every node."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame

MAX_DEPTH = 100
TOO_DEEP = "[Max depth exceeded]"


def kind_of(value: Any) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    return "number" if isinstance(value, (int, float)) else "string" if isinstance(value, str) else "array" if isinstance(value, list) else "object"


def tree(value: Any, max_depth: int = MAX_DEPTH, keep: Callable[[dict], bool] | None = None, include_path: bool = True, key: str | None = None, path: str | None = None, depth: int = 0) -> dict:
    """One node with its children. keep decides on children of objects, once they are built."""
    node: dict[str, Any] = {"type": kind_of(value)}
    if key is not None:
        node["key"] = key
    if include_path and path:
        node["path"] = path
    if depth > max_depth:
        return node | {"type": "string", "value": TOO_DEEP}
    below = lambda v, k, p: tree(v, max_depth, keep, include_path, k, p, depth + 1)
    if isinstance(value, list):
        node["children"] = [below(v, str(i), f"{path or ''}[{i}]") for i, v in enumerate(value)]
    elif isinstance(value, dict):
        children = [below(v, k, f"{path}.{k}" if path else k) for k, v in value.items()]
        node["children"] = [c for c in children if keep is None or keep(c)]
    else:
        node["value"] = value
    return node


def _rows(node: dict, depth: int = 0) -> Iterator[tuple]:
    value = node.get("value")
    text = None if value is None else value if isinstance(value, str) else json.dumps(value)
    yield node.get("path", ""), node.get("key"), node["type"], text, depth
    for child in node.get("children", ()):
        yield from _rows(child, depth + 1)


def explode(texts: DataFrame, id_column: str, json_column: str, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(id, path, key, kind, value, depth) of every node of every text; texts that aren't JSON give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["id", "path", "key", "kind", "value", "depth"]
        for batch in batches:
            out = []
            for i, text in zip(batch["id"], batch["json"], strict=True):
                try:
                    root = tree(json.loads(text), max_depth)
                except (TypeError, ValueError):
                    continue
                out += [(i, *row) for row in _rows(root)]
            yield pd.DataFrame(out, columns=names)

    rows = texts.selectExpr(f"CAST({id_column} AS STRING) AS id", f"{json_column} AS json")
    return rows.mapInPandas(run, "id string, path string, key string, kind string, value string, depth int")
