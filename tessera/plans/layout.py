"""JSON Schema to places of fields in a record, and to the columns that read them.

A schema becomes a tree of nodes once, on the driver. Offsets and sizes are numbers, or
columns where they depend on a counter in the record. Every field is its own column over
the record, so what isn't selected is never decoded, and overlapping definitions read the
same bytes side by side.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import codecs, picture
from tessera.functions.scalars import CONVERTERS, convert

ATOMIC = {"null", "boolean", "integer", "number", "string", "decimal"}
Number = int | Column


@dataclass(eq=False)
class Node:
    """A schema node. kind: atom, array, object, oneOf or ref."""

    kind: str
    schema: dict
    name: str = ""
    children: dict[str, Node] = field(default_factory=dict)
    ref: str = ""

    def json(self) -> dict:
        return self.schema

    def __eq__(self, other: object) -> bool:
        """Equal schemas describe equal records; where a schema stands (its name) counts too."""
        return isinstance(other, Node) and (self.kind, self.name, self.schema, self.ref) == (other.kind, other.name, other.schema, other.ref)

    __hash__ = object.__hash__

    @property
    def item(self) -> Node:
        return self.children["items"]

    def lines(self, indent: int = 0) -> Iterator[str]:
        yield "  " * indent + f"{self.name or '-'}: {self.schema.get('type', self.kind)} {self.schema.get('cobol', '')}".rstrip()
        for c in self.children.values():
            yield from c.lines(indent + 1)


def compile_schema(schema: dict) -> tuple[Node, dict[str, Node]]:
    """The node tree and its anchors. Forward references are resolved; only local ones are legal."""
    anchors: dict[str, Node] = {}
    asked: list[str] = []

    def walk(s: dict, name: str = "") -> Node:
        if not isinstance(s, dict):
            raise TypeError(f"a schema is a dict, not {type(s).__name__}")
        kind = s.get("type")
        if "oneOf" in s:
            node = Node("oneOf", s, name, {})
            for i, x in enumerate(s["oneOf"]):
                node.children[x.get("title", str(i))] = walk(x, x.get("title", str(i)))
        elif "$ref" in s:
            if not s["$ref"].startswith("#"):
                raise ValueError(f"only local references can be followed, not {s['$ref']}")
            asked.append(s["$ref"][1:])
            return Node("ref", s, name, ref=s["$ref"][1:])
        elif kind in ATOMIC:
            node = Node("atom", s, name)
        elif kind == "array" or "items" in s:
            counter = s.get("maxItemsDependsOn", {}).get("$ref", "")[1:]
            if counter and counter not in anchors:
                raise ValueError(f"the counter {counter} must come before what depends on it")
            node = Node("array", s, name, {"items": walk(s["items"], s["items"].get("title", ""))}, ref=counter)
        elif kind == "object" or "properties" in s:
            node = Node("object", s, name, {k: walk(v, k) for k, v in s["properties"].items()})
        else:
            raise ValueError(f"a schema needs a type, items, properties, oneOf or $ref: {sorted(s)}")
        anchors[s.get("$anchor") or s.get("title") or "*UNNAMED*"] = node
        return node

    root = walk(schema)
    for name in asked:
        if name not in anchors:
            raise ValueError(f"nothing has the anchor {name}")
    return root, anchors


def add(a: Number, b: Number) -> Number:
    if isinstance(a, int) and isinstance(b, int):
        return a + b
    if isinstance(b, int) and b == 0:
        return a
    if isinstance(a, int) and a == 0:
        return b
    return _col(a) + _col(b)


def times(a: Number, b: Number) -> Number:
    return a * b if isinstance(a, int) and isinstance(b, int) else _col(a) * _col(b)


def _col(x: Number) -> Column:
    return F.lit(x) if isinstance(x, int) else x


@dataclass
class Place:
    """A node at an offset."""

    node: Node
    at: Number
    size: Number = 0
    parts: dict[str, Place] = field(default_factory=dict)
    count: Number = 1
    item: Callable[[Number], Place] | None = None


class Layout:
    """A schema laid over the record column. text: records are characters, not bytes."""

    def __init__(
        self,
        schema: dict,
        record: str | Column = "record",
        strict: bool = False,
        charset: str | None = "cp037",
        little: bool = False,
        text: bool = False,
        on_error: str = "null",
        convert_text: bool = True,
    ):
        self.root, self.anchors = compile_schema(schema)
        self.record = F.col(record) if isinstance(record, str) else record
        self.strict, self.charset, self.little, self.text = strict, charset, little, text
        self.on_error, self.convert_text = on_error, convert_text
        self.places: dict[int, Place] = {}
        self.top = self._place(self.root, 0)

    def __eq__(self, other: object) -> bool:
        """Whether both lay the same schema over records in the same way."""
        how = lambda x: (x.strict, x.charset, x.little, x.text, x.on_error, x.convert_text)
        return isinstance(other, Layout) and self.root == other.root and how(self) == how(other)

    __hash__ = object.__hash__

    # where things are

    def field_of(self, node: Node) -> picture.Field | None:
        s = node.schema
        if "picture" in s or "usage" in s:
            return picture.Field(s.get("usage", "DISPLAY"), s.get("picture", ""), self.strict)
        return picture.parse(s["cobol"], self.strict) if "cobol" in s else None

    def atom_size(self, node: Node) -> int:
        if self.text and "maxLength" in node.schema:
            return int(node.schema["maxLength"])
        f = self.field_of(node)
        if f is not None:
            return f.size + (1 if node.schema.get("separate") else 0)
        if "maxLength" in node.schema:
            return int(node.schema["maxLength"])
        raise ValueError(f"{node.name}: neither maxLength nor a picture gives a size")

    def _place(self, node: Node, at: Number) -> Place:
        if node.kind == "atom":
            p = Place(node, at, self.atom_size(node))
        elif node.kind == "ref":
            p = Place(node, at, 0)
        elif node.kind == "object":
            p, here = Place(node, at), at
            for k, c in node.children.items():
                p.parts[k] = self._place(c, here)
                here = add(here, p.parts[k].size)
            size: Number = 0
            for x in p.parts.values():
                size = add(size, x.size)
            p.size = size
        elif node.kind == "oneOf":
            p = Place(node, at)
            p.parts = {k: self._place(c, at) for k, c in node.children.items()}
            sizes = [x.size for x in p.parts.values()]
            p.size = max(sizes) if all(isinstance(s, int) for s in sizes) else F.greatest(*map(_col, sizes), F.lit(0))
        else:
            first = self._place(node.item, at)
            if node.ref:
                counter = self.places[id(self.anchors[node.ref])]
                n: Number = F.coalesce(self.value(counter).cast("int"), F.lit(0))
                if self.strict and (most := node.schema.get("maxItems")) is not None:
                    said = F.concat(F.lit(f"{node.name} may have {most} items, not "), n.cast("string"))
                    n = F.when(n > int(most), F.raise_error(said).cast("int")).otherwise(n)
            else:
                n = int(node.schema.get("maxItems", node.schema.get("minItems", 1)))
            p = Place(node, at, times(first.size, n), count=n)
            p.item = lambda i: self._place_quietly(node.item, add(at, times(i, first.size)))
        self.places.setdefault(id(node), p)
        return p

    def _place_quietly(self, node: Node, at: Number) -> Place:
        kept = dict(self.places)
        try:
            return self._place(node, at)
        finally:
            self.places = kept

    @property
    def size(self) -> int:
        """The length of a record, if that doesn't depend on the record."""
        if not isinstance(self.top.size, int):
            raise ValueError("an Occurs Depending On requires an instance: the size isn't fixed")
        return self.top.size

    @property
    def size_column(self) -> Column:
        return _col(self.top.size).cast("int")

    def size_in(self, raw: bytes) -> int:
        """The length of the record that raw starts with."""
        return self.sizer(raw)

    @property
    def sizer(self) -> Sizer:
        return sizer_of(self)

    # what they hold

    def raw(self, p: Place) -> Column:
        return F.substring(self.record, _col(add(p.at, 1)), _col(p.size))

    def value(self, p: Place) -> Column:
        """A column of the place's whole value."""
        node = p.node
        if node.kind == "ref":
            return self.value(self.places[id(self.anchors[node.ref])])
        if node.kind == "oneOf":
            return self.value(next(iter(p.parts.values())))
        if node.kind == "object":
            return F.struct(*[self.value(c).alias(k) for k, c in p.parts.items()])
        if node.kind == "array":
            one = lambda i: self.value(p.item(i))
            if isinstance(p.count, int):
                places = F.array(*[F.lit(i) for i in range(p.count)]) if p.count <= 16 else F.sequence(F.lit(0), F.lit(p.count - 1))
            else:
                places = F.filter(F.sequence(F.lit(0), F.greatest(p.count, F.lit(0))), lambda i: i < p.count)
            return F.transform(places, one)
        s = node.schema
        if self.text:
            cut = self.raw(p)
            name = s.get("conversion", s.get("type"))
            return convert(cut, name) if self.convert_text else cut
        f = self.field_of(node) or picture.Field("DISPLAY", f"X({self.atom_size(node)})")
        if s.get("separate"):
            return self._separate(p, f, s["separate"])
        out = codecs.decode(self.raw(p), f, self.charset, self.little, self.on_error)
        name = s.get("conversion")
        if name and name != "decimal":
            out = convert(out, name, must_exist=True)
        return out

    def _separate(self, p: Place, f: picture.Field, where: str) -> Column:
        text = codecs.decode_text(self.raw(p), self.charset or "latin-1")
        sign = F.substring(text, 1, 1) if where == "LEADING" else F.substring(text, -1, 1)
        digits = F.regexp_replace(text, "[^0-9]", "")
        return codecs._decimal(sign == "-", digits, f.scale, f.precision, self.on_error)

    def find(self, path: str) -> Place:
        """A place by its path: names joined by dots, [i] for items. A name that is only once
        in the whole schema will do alone."""
        at = self.top
        for step in path.replace("[", ".[").split("."):
            if step.startswith("["):
                i = int(step[1:-1])
                if at.item is None:
                    raise TypeError(f"{at.node.name} is no array")
                if isinstance(at.count, int) and not 0 <= i < at.count:
                    raise IndexError(f"{path}: there are {at.count} items")
                at = at.item(i)
                continue
            if at.node.kind == "array":
                raise TypeError(f"{at.node.name} is an array; give an index before {step}")
            if at.node.kind == "ref":
                at = self.places[id(self.anchors[at.node.ref])]
            got = at.parts.get(step)
            if got is None and at is self.top:
                named = [n for n in self._named(self.root, step)]
                if len(named) == 1:
                    got = self.places[id(named[0])]
            if got is None:
                raise KeyError(f"{at.node.name or 'the record'} has no {step}")
            at = got
            if at.node.kind == "ref":
                at = self.places[id(self.anchors[at.node.ref])]
        return at

    def _named(self, node: Node, name: str) -> Iterator[Node]:
        for k, c in node.children.items():
            if k == name and c.kind != "ref":
                yield c
            if node.kind != "array" and c.kind != "array":
                yield from self._named(c, name)

    def col(self, path: str) -> Column:
        return self.value(self.find(path))

    def raw_col(self, path: str) -> Column:
        return self.raw(self.find(path))

    def values(self) -> list[Column]:
        """Top-level fields in order; alternatives side by side."""
        return [self.value(p).alias(k) for k, p in self.top.parts.items() if p.node.kind != "oneOf"]

    def overlay(self, path: str, schema: dict) -> Layout:
        """Another schema over the bytes of a field."""
        return Layout(schema, self.raw_col(path), self.strict, self.charset, self.little, self.text, self.on_error)

    def fields(self, p: Place | None = None, depth: int = 0) -> Iterator[tuple[int, str, Place]]:
        """(depth, name, place) of everything, of arrays the first item."""
        p = p or self.top
        yield depth, p.node.name or p.node.schema.get("title", ""), p
        for c in p.parts.values():
            if c.node.kind != "ref":
                yield from self.fields(c, depth + 1)
        if p.item is not None:
            yield from self.fields(p.item(0), depth + 1)

    def dump(self) -> Column:
        """One row per field and record: an array to explode of depth, field, offset, size, raw, value."""
        rows = []
        for depth, name, p in self.fields():
            atom = p.node.kind == "atom"
            rows.append(
                F.struct(
                    F.lit(depth).alias("depth"),
                    F.lit(name).alias("field"),
                    _col(p.at).cast("int").alias("offset"),
                    _col(p.size).cast("int").alias("size"),
                    (F.when(F.lit(atom), self.raw(p) if self.text else F.hex(self.raw(p)))).alias("raw"),
                    (self.value(p).cast("string") if atom else F.lit(None).cast("string")).alias("value"),
                )
            )
        return F.array(*rows)

    def explain(self) -> str:
        out = []
        for depth, name, p in self.fields():
            at, size = (x if isinstance(x, int) else "varies" for x in (p.at, p.size))
            out.append(f"{'  ' * depth}{name:<30} {at:>6} {size:>6}  {p.node.schema.get('cobol', '')}".rstrip())
        return "\n".join(out)


@dataclass
class Sizer:
    """Lengths of variable records, for framing without record marks: counters are read as
    bytes. It holds no columns, so tasks can take it along."""

    root: Node
    anchors: dict[str, Node]
    fields: dict[int, tuple[int, str]]  # of atoms, by their order: size and kind
    order: dict[str, int]
    little: bool

    def __call__(self, raw: bytes) -> int:
        self.raw, self.at = raw, {}
        return self._size(self.root, 0, "")

    def _size(self, n: Node, at: int, path: str) -> int:
        self.at.setdefault(path, at)
        if n.kind == "atom":
            return self.fields[self.order[path]][0]
        if n.kind == "ref":
            return 0
        parts = {k: (c, f"{path}/{k}") for k, c in n.children.items()}
        if n.kind == "oneOf":
            return max(self._size(c, at, p) for c, p in parts.values())
        if n.kind == "object":
            here = at
            for c, p in parts.values():
                here += self._size(c, here, p)
            return here - at
        item, p = parts["items"]
        count = self._counter(n.ref) if n.ref else int(n.schema.get("maxItems", n.schema.get("minItems", 1)))
        return count * self._size(item, at, p)

    def _counter(self, anchor: str) -> int:
        path = self.paths[anchor]
        size, kind = self.fields[self.order[path]]
        raw = self.raw[self.at[path] : self.at[path] + size]
        if kind == "binary":
            return int.from_bytes(raw, "little" if self.little else "big", signed=True)
        h = raw.hex()
        return int(h[:-1] or 0) if kind == "packed" else int(h[1::2] or 0)


def sizer_of(layout: Layout) -> Sizer:
    fields: dict[int, tuple[int, str]] = {}
    order: dict[str, int] = {}
    paths: dict[str, str] = {}

    def walk(n: Node, path: str) -> None:
        for anchor, found in layout.anchors.items():
            if found is n:
                paths[anchor] = path
        if n.kind == "atom":
            f = layout.field_of(n)
            order[path] = len(fields)
            fields[len(fields)] = (layout.atom_size(n), f.kind if f else "text")
        for k, c in n.children.items():
            walk(c, f"{path}/{k}")

    walk(layout.root, "")
    out = Sizer(layout.root, layout.anchors, fields, order, layout.little)
    out.paths = paths
    return out


def known_converter(name: str) -> bool:
    return name in CONVERTERS
