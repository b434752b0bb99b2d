"""Checks of JSON Schema documents themselves: the vocabulary that layouts interpret."""

from __future__ import annotations

from collections.abc import Iterator

from tessera.plans.layout import ATOMIC, compile_schema

_COUNTS = ("maxItems", "minItems", "maxLength", "minLength", "position")


def schema_problems(schema: object, path: str = "#") -> Iterator[str]:
    """What is wrong with a schema, each with the place where it is."""
    if not isinstance(schema, dict):
        yield f"{path}: a schema must be an object"
        return
    kind = schema.get("type")
    if kind is not None and kind not in ATOMIC | {"array", "object"}:
        yield f"{path}: {kind!r} is no type"
    if not {"type", "oneOf", "$ref", "items", "properties"} & schema.keys():
        yield f"{path}: nothing says what it is"
    for k in _COUNTS:
        v = schema.get(k, 0)
        if not isinstance(v, int) or isinstance(v, bool) or v < 0:
            yield f"{path}/{k}: a count must be a number from 0 up"
    if kind == "array" and "items" not in schema:
        yield f"{path}: an array needs items"
    if not isinstance(schema.get("$ref", "#"), str) or not schema.get("$ref", "#").startswith("#"):
        yield f"{path}/$ref: only local references can be followed"
    if "items" in schema:
        yield from schema_problems(schema["items"], f"{path}/items")
    for i, s in enumerate(schema.get("oneOf", [])):
        yield from schema_problems(s, f"{path}/oneOf/{i}")
    properties = schema.get("properties", {})
    if not isinstance(properties, dict):
        yield f"{path}/properties: must be an object"
        return
    for name, s in properties.items():
        yield from schema_problems(s, f"{path}/properties/{name}")


def check_schema(schema: dict) -> None:
    """A ValueError with all problems, references that lead nowhere included."""
    found = list(schema_problems(schema))
    if not found:
        try:
            compile_schema(schema)
        except (ValueError, TypeError) as e:
            found.append(str(e))
    if found:
        raise ValueError("; ".join(found))
