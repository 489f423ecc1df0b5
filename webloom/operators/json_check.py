"""JSON Schema checks of structured answers: type, enum, required, properties, additionalProperties, items."""

from __future__ import annotations

import json
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame

_TYPES = {
    "object": lambda v: isinstance(v, dict),
    "array": lambda v: isinstance(v, list),
    "string": lambda v: isinstance(v, str),
    "boolean": lambda v: isinstance(v, bool),
    "null": lambda v: v is None,
    "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool),
    "integer": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool) and float(v).is_integer(),
}


def problem(value: Any, schema: Any, at: str = "$") -> str | None:
    """The first thing wrong with a value, or None. Keywords beyond those above are ignored."""
    if not isinstance(schema, dict):
        return None
    kinds = schema.get("type")
    if kinds is not None:
        names = [kinds] if isinstance(kinds, str) else kinds
        if not any(_TYPES.get(n, lambda v: True)(value) for n in names):
            return f"{at}: not of type {'|'.join(names)}"
    if "enum" in schema and not any(value == e and isinstance(value, bool) == isinstance(e, bool) for e in schema["enum"]):
        return f"{at}: not one of the values allowed"
    if isinstance(value, dict):
        for name in schema.get("required", []):
            if name not in value:
                return f"{at}: {name} is missing"
        known = schema.get("properties", {})
        for name, inner in known.items():
            if name in value and (found := problem(value[name], inner, f"{at}.{name}")):
                return found
        if schema.get("additionalProperties") is False and (extra := sorted(set(value) - set(known))):
            return f"{at}: {extra[0]} isn't allowed"
    if isinstance(value, list) and "items" in schema:
        for i, item in enumerate(value):
            if found := problem(item, schema["items"], f"{at}[{i}]"):
                return found
    return None


def check_text(text: str | None, schema: Any) -> str | None:
    try:
        value = json.loads(text or "")
    except ValueError:
        return "not JSON"
    return problem(value, schema)


def checked(rows: DataFrame, value: str, schema: Any) -> DataFrame:
    """``rows`` with ``problem`` (null where the JSON text in ``value`` fits the schema)."""
    out = rows.schema.simpleString()[len("struct<") : -1]
    names = rows.columns

    def run(batches):
        for batch in batches:
            found = pa.array([check_text(t, schema) for t in batch.column(value).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), found], names=[*names, "problem"])

    from pyspark.sql import types as T

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("problem", T.StringType())])) if out else rows
