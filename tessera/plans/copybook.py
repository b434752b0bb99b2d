"""COBOL copybooks: text to trees of data description entries, to JSON Schema.

Two dialects: compatible (the default) keeps known quirks of sizes and places, strict is
what mainframe compilers do.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

from tessera.functions.picture import USAGES, Field
from tessera.functions.scalars import name_cleaner

SKIPPED = re.compile(r"^\s*(EJECT|SKIP[123])\b", re.I)


def reference_format(text: str, replacing: Iterable[tuple[str, str]] = ()) -> list[str]:
    """Code of columns 8 to 72. Comments, debug lines and listing directives go, continued
    lines are joined, COPY is an error, replacements are made one after another."""
    out: list[str] = []
    for line in text.splitlines():
        if not line.strip() or len(line) < 7 or SKIPPED.match(line[6:]):
            continue
        mark, code = line[6], line[7:72].rstrip()
        if mark in "*Dd/":
            continue
        for old, new in replacing:
            code = code.replace(old, new)
        if mark == "-" and out:
            out[-1] += code
        else:
            out.append(code)
    for code in out:
        if re.match(r"\s*COPY\b", code, re.I):
            raise ValueError(f"COPY can't be followed: {code.strip()}")
    return out


def sentences(lines: Iterable[str]) -> Iterator[tuple[str, str]]:
    """(level, clauses) of each entry; an entry ends at a period that white space or the end follows."""
    text = "\n".join(lines) + "\n"
    for m in re.finditer(r"\s*(\d\d?)\s+((?:'[^']*'|\"[^\"]*\"|[^'\"])*?)\.(?=\s)", text, re.S):
        yield m[1].zfill(2), " ".join(m[2].split())


def clauses(text: str) -> dict[str, str]:
    """The clauses of an entry: name, picture, usage, redefines, occurs, depending, ..."""
    words = re.findall(r"'[^']*'|\"[^\"]*\"|[^\s,;]+", text)
    out: dict[str, str] = {}
    i = 0

    def take(*noise: str) -> str:
        nonlocal i
        while i < len(words) and words[i].upper() in noise:
            i += 1
        i += 1
        return words[i - 1] if i <= len(words) else ""

    first = True
    while i < len(words):
        w = words[i].upper()
        i += 1
        if w == "REDEFINES":
            out["redefines"] = take()
        elif w in ("PIC", "PICTURE"):
            out["picture"] = take("IS").rstrip(".")
        elif w == "USAGE":
            out["usage"] = USAGES.get(take("IS").upper(), "DISPLAY")
        elif w in USAGES:
            out["usage"] = USAGES[w]
        elif w == "OCCURS":
            out["occurs"] = take()
            if i < len(words) and words[i].upper() == "TO":
                i += 1
                out["occurs_min"], out["occurs"] = out["occurs"], take()
        elif w == "DEPENDING":
            out["depending"] = take("ON")
        elif w in ("INDEXED", "ASCENDING", "DESCENDING"):
            take("BY", "KEY", "IS")
        elif w == "VALUE" or w == "VALUES":
            out["value"] = take("IS", "ARE")
        elif w == "SIGN" or w in ("LEADING", "TRAILING"):
            if w != "SIGN":
                out["sign"] = w
        elif w == "SEPARATE":
            out["separate"] = "SEPARATE"
        elif w in ("JUST", "JUSTIFIED", "SYNC", "SYNCHRONIZED", "BLANK", "EXTERNAL", "GLOBAL"):
            out[w.lower()] = w
        elif first and (w == "FILLER" or re.fullmatch(r"[A-Z0-9][A-Z0-9_-]*", w)):
            out["name"] = words[i - 1]
        first = False
    return out


@dataclass
class Entry:
    level: str
    source: str
    clauses: dict[str, str]
    name: str = ""
    children: list[Entry] = field(default_factory=list)
    parent: Entry | None = None
    redefined: bool = False

    @property
    def usage(self) -> str:
        return self.clauses.get("usage", "DISPLAY")

    def display(self, indent: int = 0) -> str:
        return "\n".join(["  " * indent + f"{self.level} {self.source}", *(c.display(indent + 1) for c in self.children)])


def structure(entries: Iterable[tuple[str, str]]) -> list[Entry]:
    """Trees, one per 01 level (or other outermost level). Levels 66, 77 and 88 are skipped."""
    roots: list[Entry] = []
    path: list[Entry] = []
    fillers = 0
    for level, source in entries:
        if level in ("66", "77", "88"):
            continue
        e = Entry(level, source, clauses(source))
        if level == "01":
            fillers = 0
        name = e.clauses.get("name", "FILLER")
        if name.upper() == "FILLER":
            fillers += 1
            name = f"FILLER-{fillers}"
        e.name = name
        while path and path[-1].level >= level:
            path.pop()
        if path:
            e.parent = path[-1]
            if (base := e.clauses.get("redefines")) is not None:
                found = [c for c in path[-1].children if c.name.upper() == base.upper()]
                if len(found) != 1:
                    raise ValueError(f"{e.name} redefines {base}, of which there are {len(found)}")
                found[0].redefined = True
            path[-1].children.append(e)
        else:
            roots.append(e)
        path.append(e)
    return roots


def parse_copybook(text: str, free: bool = False, replacing: Iterable[tuple[str, str]] = ()) -> list[Entry]:
    """All record descriptions of a copybook. free: text has no columns to cut."""
    replacing = list(replacing)
    if free:
        for old, new in replacing:
            text = text.replace(old, new)
    lines = text.splitlines() if free else reference_format(text, replacing)
    return structure(sentences(lines))


def _usage(e: Entry, strict: bool) -> str:
    at: Entry | None = e
    while strict and at is not None:  # group usage is inherited
        if "usage" in at.clauses:
            return at.clauses["usage"]
        at = at.parent
    return e.usage


def json_type(e: Entry, strict: bool = False, extended: bool = False) -> dict:
    """The JSON Schema type of an elementary item."""
    usage = _usage(e, strict)
    f = Field(usage, e.clauses.get("picture", ""), strict)
    if usage in ("COMP-1", "COMP-2"):
        return {"type": "number"}
    if usage == "COMP":
        return {"type": "integer", "contentEncoding": "bigendian-int"}
    if usage == "COMP-3":
        return {"type": "decimal"} if extended else {"type": "string", "contentEncoding": "packed-decimal", "conversion": "decimal"}
    if f.zoned:
        return {"type": "decimal"} if extended else {"type": "string", "contentEncoding": "cp037", "conversion": "decimal"}
    return {"type": "string"} if extended else {"type": "string", "contentEncoding": "cp037"}


def json_schema(e: Entry, strict: bool = False, extended: bool = False) -> dict:
    """The JSON Schema of an entry and all below it."""
    head = {"title": e.name, "$anchor": name_cleaner(e.name), "cobol": f"{e.level} {e.source}"}
    if e.children:
        body = head | {"type": "object", "properties": _properties(e, strict, extended)}
    else:
        usage, picture = _usage(e, strict), e.clauses.get("picture", "")
        f = Field(usage, picture, strict)
        body = head | json_type(e, strict, extended) | {"picture": picture, "usage": usage}
        if e.clauses.get("separate") and strict:
            body["separate"] = e.clauses.get("sign", "TRAILING")
        body |= {"minLength": f.size, "maxLength": f.size}
    if "occurs" not in e.clauses:
        return body
    if not e.children:
        body = {"type": "object", "properties": {e.name: {k: v for k, v in body.items() if k != "$anchor"}}}
    array = head | {"type": "array", "items": {k: v for k, v in body.items() if k != "$anchor" or not e.children}}
    array["items"].pop("$anchor", None)
    most = int(e.clauses["occurs"])
    if "depending" in e.clauses:
        return array | {"maxItemsDependsOn": {"$ref": "#" + name_cleaner(e.clauses["depending"])}, "maxItems": most}
    return array | {"minItems": most, "maxItems": most}


def _properties(e: Entry, strict: bool, extended: bool) -> dict:
    out: dict[str, dict] = {}
    unions: dict[str, dict] = {}
    for c in e.children:
        base = c.clauses.get("redefines", c.name if c.redefined else None)
        if base is None:
            out[c.name] = json_schema(c, strict, extended)
            continue
        base = next(x.name for x in e.children if x.name.upper() == base.upper())
        key = f"REDEFINES-{base}"
        if key not in unions:
            unions[key] = {"oneOf": []}
            if strict:
                out[key] = unions[key]
        unions[key]["oneOf"].append(json_schema(c, strict, extended))
        out[c.name] = {"$ref": "#" + name_cleaner(c.name)}
    return out if strict else unions | out
