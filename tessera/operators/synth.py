"""Values to whole records, by the same schemas that read them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.encode import encode, encode_text
from tessera.plans.layout import Layout, Node


@dataclass
class Raw:
    """Bytes that are ready."""

    column: Column


def assemble(layout: Layout, values: dict) -> Column:
    """A record. values: Column by name; dict for a group; list, or Raw, for an array.
    What has no value is blank."""
    return _bytes(layout, layout.root, values)


def _bytes(layout: Layout, node: Node, value) -> Column:
    if isinstance(value, Raw):
        return value.column
    if node.kind == "ref":
        return F.lit(b"")
    if node.kind == "object":
        parts = []
        for k, c in node.children.items():
            if c.kind == "oneOf":  # the alternative that has a value
                name = next((n for n in c.children if value and n in value), next(iter(c.children)))
                parts.append(_bytes(layout, c.children[name], (value or {}).get(name)))
            else:
                parts.append(_bytes(layout, c, (value or {}).get(k)))
        return F.concat(*parts)
    if node.kind == "array":
        n = int(node.schema.get("maxItems", 1))
        item = node.item
        items = list(value) if value else [None] * n
        if not all(isinstance(x, dict | Raw) or x is None for x in items):  # items with one field
            items = [{next(iter(item.children)): x} for x in items]
        return F.concat(*[_bytes(layout, item, x) for x in items])
    f = layout.field_of(node)
    if value is None:
        return encode_text(F.lit(""), layout.atom_size(node), layout.charset or "cp037")
    return encode(value, f, layout.charset or "latin-1", layout.little)
