"""The condition language: tokens, a recursive-descent parser and its tree.

    condition := expression [ "|" aggregate [ "and" name ] ]  |  name "|" "not_seen_before" "(" fields ")" "in" name
    expression := conjunction { "or" conjunction };  conjunction := factor { "and" factor }
    factor := "not" factor | "(" expression ")" | name | ("1" | "all") "of" pattern
    aggregate := ("count" "(" [field ["," "max_each" "=" n]] ")" | "speed_kmh" "(" lat "," lon ["," km] ")") "by" fields comparison n
"""

from __future__ import annotations

import fnmatch
import re
from dataclasses import dataclass


class RuleError(ValueError):
    """A rule that cannot be read or has no meaning."""


@dataclass(frozen=True)
class Block:
    name: str


@dataclass(frozen=True)
class Not:
    part: object


@dataclass(frozen=True)
class All:
    parts: tuple


@dataclass(frozen=True)
class Any:
    parts: tuple


@dataclass(frozen=True)
class Count:
    base: object
    field: str | None
    max_each: int | None
    by: tuple[str, ...]
    compare: str
    number: float
    anchor: object | None


@dataclass(frozen=True)
class NotSeenBefore:
    base: object
    fields: tuple[str, ...]
    history: object


@dataclass(frozen=True)
class Speed:
    base: object
    lat: str
    lon: str
    least_km: float
    by: tuple[str, ...]
    compare: str
    number: float


_TOKEN = re.compile(r"\s*(>=|<=|==|[()|,=<>]|\d+(?:\.\d+)?|[A-Za-z_][\w.\-*]*\*?)")
COMPARISONS = (">=", "<=", "==", "=", ">", "<")


def tokens(text: str) -> list[str]:
    out, at = [], 0
    text = text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise RuleError(f"unexpected {text[at:]!r}")
        out.append(m[1])
        at = m.end()
    return out


class _Parser:
    def __init__(self, text: str, blocks: list[str]):
        self.left, self.blocks = tokens(text), blocks
        if not self.left:
            raise RuleError("an empty condition")

    def peek(self) -> str:
        return self.left[0].lower() if self.left else ""

    def take(self, *wanted: str) -> str:
        if not self.left or (wanted and self.peek() not in wanted):
            raise RuleError(f"{' or '.join(wanted) or 'something'} expected, {self.left[0] if self.left else 'the end'} found")
        return self.left.pop(0)

    def accept(self, word: str) -> bool:
        if self.peek() == word:
            self.left.pop(0)
            return True
        return False

    def condition(self):
        base = self.either()
        if self.accept("|"):
            base = self.aggregate(base)
        if self.left:
            raise RuleError(f"{self.left[0]!r} is left over")
        return base

    def either(self):
        parts = [self.both()]
        while self.accept("or"):
            parts.append(self.both())
        return parts[0] if len(parts) == 1 else Any(tuple(parts))

    def both(self):
        parts = [self.factor()]
        while self.accept("and"):
            parts.append(self.factor())
        return parts[0] if len(parts) == 1 else All(tuple(parts))

    def factor(self):
        if self.accept("not"):
            return Not(self.factor())
        if self.accept("("):
            inner = self.either()
            self.take(")")
            return inner
        if self.peek() in ("1", "all") and len(self.left) > 1 and self.left[1].lower() == "of":
            kind = self.take()
            self.take("of")
            pattern = self.take()
            names = [b for b in self.blocks if pattern == "them" or fnmatch.fnmatchcase(b, pattern)]
            if not names:
                raise RuleError(f"no block matches {pattern!r}")
            parts = tuple(Block(n) for n in names)
            return parts[0] if len(parts) == 1 else All(parts) if kind.lower() == "all" else Any(parts)
        return self.block()

    def block(self) -> Block:
        name = self.take()
        if name not in self.blocks:
            raise RuleError(f"unknown block {name!r}")
        return Block(name)

    def names(self, end: str) -> tuple[str, ...]:
        out = [self.take()]
        while self.accept(","):
            out.append(self.take())
        if end:
            self.take(end)
        return tuple(out)

    def comparison(self) -> tuple[str, float]:
        sign = self.take(*COMPARISONS)
        number = self.take()
        if not re.fullmatch(r"\d+(\.\d+)?", number):
            raise RuleError(f"a number expected, {number!r} found")
        return ("==" if sign == "=" else sign), float(number)

    def aggregate(self, base):
        kind = self.take("count", "not_seen_before", "speed_kmh").lower()
        self.take("(")
        if kind == "not_seen_before":
            fields = self.names(")")
            self.take("in")
            return NotSeenBefore(base, fields, self.factor())
        if kind == "speed_kmh":
            args = self.names(")")
            if len(args) not in (2, 3):
                raise RuleError("speed_kmh takes two fields and a distance")
            self.take("by")
            by = self.names("")
            return Speed(base, args[0], args[1], float(args[2]) if len(args) == 3 else 0.0, by, *self.comparison())
        field = each = None
        if not self.accept(")"):
            field = self.take()
            if self.accept(","):
                self.take("max_each")
                self.take("=")
                each = int(self.take())
            self.take(")")
        self.take("by")
        by = self.names("")
        compare, number = self.comparison()
        anchor = self.factor() if self.accept("and") else None
        return Count(base, field, each, by, compare, number, anchor)


def parse(text: str, blocks: list[str]):
    """The tree of a condition over the named blocks."""
    return _Parser(text, blocks).condition()
