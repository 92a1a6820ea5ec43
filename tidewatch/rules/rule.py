"""Rules from YAML: required keys, modifiers, timeframes and technique tags are checked when a rule is read."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from pathlib import Path

import yaml

from .language import RuleError, parse

#: What may follow a field's name, levels and their base scores, seconds of a unit.
MODIFIERS = ("eq", "contains", "startswith", "endswith", "re", "gt", "gte", "lt", "lte", "all")
LEVELS = {"informational": 0.20, "low": 0.35, "medium": 0.55, "high": 0.75, "critical": 0.90}
UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400}
DEFAULT_TIMEFRAME = 1800


@dataclass(frozen=True)
class Filter:
    field: str
    modifier: str
    values: tuple
    every: bool = False


@dataclass(frozen=True)
class Rule:
    id: str
    title: str
    level: str
    blocks: dict[str, tuple[Filter, ...]]
    condition: object
    timeframe: int
    entity_type: str
    entity_field: str
    techniques: tuple[str, ...] = ()
    applies_to: tuple[str, ...] = field(default=())

    @property
    def detector_key(self) -> str:
        return "rule." + re.sub(r"[^a-z0-9]+", "_", self.id.lower())

    @property
    def base_score(self) -> float:
        return LEVELS.get(self.level, 0.5)


def seconds(text: object) -> int:
    m = re.fullmatch(r"\s*(\d+)\s*([smhd])\s*", str(text))
    if not m:
        raise RuleError(f"timeframe {text!r}")
    return int(m[1]) * UNITS[m[2]]


def _filters(block: object) -> tuple[Filter, ...]:
    if not isinstance(block, dict) or not block:
        raise RuleError("a block is a mapping of fields")
    out = []
    for key, value in block.items():
        name, *mods = str(key).split("|")
        every = "all" in mods
        kinds = [m for m in mods if m != "all"]
        unknown = [m for m in mods if m not in MODIFIERS]
        if unknown or len(kinds) > 1:
            raise RuleError(f"modifiers {mods}")
        values = tuple(value) if isinstance(value, list) else (value,)
        if not values:
            raise RuleError(f"{name} has no value")
        out.append(Filter(name, kinds[0] if kinds else "eq", values, every))
    return tuple(out)


def load(document: dict) -> Rule:
    for key in ("id", "title", "level", "detection", "entity"):
        if key not in document:
            raise RuleError(f"{document.get('id', 'a rule')} lacks {key}")
    detection = dict(document["detection"])
    condition = detection.pop("condition", None)
    timeframe = detection.pop("timeframe", None)
    if not condition or not detection:
        raise RuleError(f"{document['id']} lacks a condition or blocks")
    blocks = {name: _filters(block) for name, block in detection.items()}
    techniques = tuple(m[1].upper() for t in document.get("tags", ()) if (m := re.fullmatch(r"attack\.(t\d{4}(?:\.\d{3})?)", str(t).lower())))
    entity = document["entity"]
    if not isinstance(entity, dict) or "type" not in entity or not entity.get("field", entity.get("by")):
        raise RuleError(f"{document['id']} needs an entity's type and field")
    return Rule(str(document["id"]), str(document["title"]), str(document["level"]).lower(), blocks, parse(str(condition), list(blocks)), seconds(timeframe) if timeframe is not None else DEFAULT_TIMEFRAME, entity["type"], entity.get("field", entity.get("by")), techniques, tuple(document.get("applies_to", ())))


def load_all(text: str) -> list[Rule]:
    """The rules of a text of YAML documents; an id may occur once."""
    rules = [load(d) for d in yaml.safe_load_all(text) if d]
    ids = [r.id for r in rules]
    if len(ids) != len(set(ids)):
        raise RuleError("an id occurs twice")
    return rules


def shipped() -> list[Rule]:
    """The rules that come with the package."""
    return load_all(Path(__file__).with_name("shipped.yml").read_text())


def load_folder(path: str) -> list[Rule]:
    return load_all("\n---\n".join(p.read_text() for p in sorted(Path(path).glob("*.yml"))))
