"""USAGE and PICTURE clauses: what a field's bytes are, how many there are, what they may hold."""

from __future__ import annotations

import re
from dataclasses import dataclass

# Fixed spellings of usages.
USAGES = {
    "DISPLAY": "DISPLAY",
    "COMP": "COMP", "COMP-4": "COMP", "COMPUTATIONAL": "COMP", "COMPUTATIONAL-4": "COMP", "BINARY": "COMP",
    "COMP-1": "COMP-1", "COMPUTATIONAL-1": "COMP-1",
    "COMP-2": "COMP-2", "COMPUTATIONAL-2": "COMP-2",
    "COMP-3": "COMP-3", "COMPUTATIONAL-3": "COMP-3", "PACKED-DECIMAL": "COMP-3",
}
_USAGE = re.compile(r"(?<![\w-])(" + "|".join(sorted(USAGES, key=len, reverse=True)) + r")(?![\w-])", re.I)
_PICTURE = re.compile(r"(?<![\w-])PIC(?:TURE)?(?:\s+IS)?\s+(\S+)", re.I)
_TOKEN = re.compile(r"(DB|CR|[+\-S$,/*BV.AX9Z0])(?:\((\d+)\))?")
_CLASS = {"S": "[ +-]?", "X": ".", "A": r"\w", "9": r"\d", "Z": r"\d", "0": r"\d", "B": r"\s", "V": ""}


def symbols(picture: str) -> list[str]:
    """The picture's symbols one by one, repetitions written out; junk is a ValueError."""
    text, at, out = picture.upper().rstrip("."), 0, []
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"{text[at:]!r} in picture {picture!r} can't be understood")
        out += [m[1]] * int(m[2] or 1)
        at = m.end()
    return out


@dataclass(frozen=True)
class Field:
    """An elementary item's representation."""

    usage: str
    picture: str
    strict: bool = False

    @property
    def symbols(self) -> list[str]:
        return symbols(self.picture) if self.picture else []

    @property
    def text_size(self) -> int:
        return sum(len(s) for s in self.symbols if s != "V")

    @property
    def signed(self) -> bool:
        return "S" in self.symbols

    @property
    def zoned(self) -> bool:
        """Only S, 9 and V: digits with the sign in the last byte."""
        return bool(self.symbols) and set(self.symbols) <= {"S", "9", "V"} and "9" in self.symbols

    @property
    def groups(self) -> tuple[str, str, str, str]:
        """sign, whole digits, separator, fraction digits; * counts as a digit."""
        sign, whole, sep, fraction = "", "", "", ""
        for s in self.symbols:
            s = "9" if s == "*" else s
            if s in ("S", "+", "-", "DB", "CR"):
                sign = s
            elif s in ("V", "."):
                sep = s
            elif s in ("9", "Z", "0"):
                whole, fraction = (whole + s, fraction) if not sep else (whole, fraction + s)
        return sign, whole, sep, fraction

    @property
    def whole_digits(self) -> int:
        return len(self.groups[1])

    @property
    def scale(self) -> int:
        return len(self.groups[3])

    @property
    def precision(self) -> int:
        return self.whole_digits + self.scale

    @property
    def pattern(self) -> str:
        """A regular expression that texts of this picture match from their start."""
        blank = {"Z": "[ 0-9]"} if self.strict else {}
        return "".join(blank.get(s) or _CLASS.get(s, None) if s in _CLASS else re.escape(s) for s in self.symbols)

    @property
    def size(self) -> int:
        """Bytes. Compatible sizes count S as a byte; strict ones are the machine's."""
        if self.usage == "COMP-1":
            return 4
        if self.usage == "COMP-2":
            return 8
        n = self.text_size
        if not n:
            raise ValueError(f"usage {self.usage} needs a picture with a size")
        if self.usage == "DISPLAY":
            return self.precision if self.strict and self.zoned else n
        digits = self.precision if self.strict else n
        if self.usage == "COMP-3":
            return digits // 2 + 1 if self.strict else (n + 1) // 2
        return 2 if digits < 5 else 4 if digits < 10 else 8

    @property
    def kind(self) -> str:
        if self.usage == "DISPLAY":
            return "zoned" if self.zoned else "text"
        return {"COMP": "binary", "COMP-1": "float", "COMP-2": "double", "COMP-3": "packed"}[self.usage]


def parse(source: str, strict: bool = False) -> Field:
    """The field of a text with USAGE and PICTURE clauses; DISPLAY if it names no usage."""
    picture = _PICTURE.search(source)
    rest = source[: picture.start()] + " " + source[picture.end() :] if picture else source
    usage = _USAGE.search(rest)
    field = Field(USAGES[usage[1].upper()] if usage else "DISPLAY", picture[1].rstrip(".") if picture else "", strict)
    field.size  # noqa: B018  a field without a size is an error here, not when it is read
    return field


def calcsize(source: str, strict: bool = False) -> int:
    return parse(source, strict).size
