"""Structured answers from documents: inputs resolved, a pluggable model called per batch, answers parsed and checked."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame

from webloom.operators.json_check import problem

#: A model: texts, schema and prompt to answers. It runs in Python workers and must be picklable.
Model = Callable[[list[str], Any, str], list[str]]
#: Bytes of a document that a model sees.
MOST_BYTES = 100_000


@dataclass(frozen=True)
class ModelSettings:
    """Never changed by a request: a request's own values make a copy."""

    prompt: str = ""
    schema: Any = None


def resolved(settings: ModelSettings, json_schema: Any = None, extract_schema: Any = None, prompt: str | None = None, extract_prompt: str | None = None) -> ModelSettings:
    """A request's schema and prompt win over those of its extract block, and those over the settings."""
    schema = json_schema if json_schema is not None else extract_schema if extract_schema is not None else settings.schema
    return replace(settings, schema=schema, prompt=prompt or extract_prompt or settings.prompt)


def parsed(answer: str) -> Any:
    """JSON of an answer, code fences dropped; ValueError if it isn't."""
    return json.loads(re.sub(r"^```(?:json)?\s*|\s*```$", "", answer.strip()))


def truncated(text: str, n: int = MOST_BYTES) -> str:
    return text.encode("utf-8", "surrogatepass")[:n].decode("utf-8", "ignore")


def echo_model(texts: list[str], schema: Any, prompt: str) -> list[str]:
    """A deterministic stand-in: fills the schema's string properties with the text's first line and its numbers with its length."""
    fields = (schema or {}).get("properties", {}) if isinstance(schema, dict) else {}
    value = lambda t, kind: len(t) if kind in ("integer", "number") else [] if kind == "array" else t.split("\n", 1)[0]
    return [json.dumps({k: value(t, v.get("type")) for k, v in fields.items()}) for t in texts]


def answers(docs: DataFrame, text: str, settings: ModelSettings, model: Model = echo_model, key: str = "page_id", batch: int = 32) -> DataFrame:
    """(key, json, problem): a checked answer for each document; a null document has none."""
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            texts = [truncated(t) if t is not None else None for t in rows.column(text).to_pylist()]
            out, wrong = [None] * len(texts), [None] * len(texts)
            asked = [i for i, t in enumerate(texts) if t is not None]
            for at in range(0, len(asked), batch):
                part = asked[at : at + batch]
                for i, a in zip(part, model([texts[i] for i in part], settings.schema, settings.prompt), strict=True):
                    try:
                        value = parsed(a)
                    except ValueError:
                        wrong[i] = "not JSON"
                        continue
                    out[i], wrong[i] = json.dumps(value, sort_keys=True), problem(value, settings.schema)
            yield pa.RecordBatch.from_arrays([rows.column(key), pa.array(out, pa.string()), pa.array(wrong, pa.string())], names=[key, "json", "problem"])

    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, json string, problem string")
