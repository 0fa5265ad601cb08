"""Configuration of a sheet: a TOML file with a table [sheet]."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from recordloom.errors import ConfigError
from recordloom.operators.normalize import parse_sort_rule
from recordloom.operators.validate import check_schema
from recordloom.plans import template
from recordloom.sources import toml

EXTENSIONS = {"toml": ".toml", "markdown": ".md", "mdx": ".mdx"}


@dataclass(frozen=True)
class SheetConfig:
    name: str
    path: template.Template
    root: str = "."
    schema: dict | None = None
    sort: dict[str, Any] = field(default_factory=dict)
    format: str = "toml"
    body: str | None = None
    title: str | None = None
    implements: tuple[str, ...] = ()
    raw: dict = field(default_factory=dict)

    @property
    def extension(self) -> str:
        return EXTENSIONS[self.format]


def from_table(name: str, table: Mapping[str, Any]) -> SheetConfig:
    """A configuration from the table [sheet]; anything that is off is config_invalid."""
    path = table.get("path")
    if not isinstance(path, str) or not path.strip():
        raise ConfigError(f"sheet {name!r} needs a path template")
    parsed = template.parse(path)
    root = table.get("root", ".")
    if not isinstance(root, str):
        raise ConfigError(f"root of sheet {name!r} must be text")
    schema = table.get("schema")
    if schema is not None:
        check_schema(schema)
    rules = {}
    for f, own in (table.get("fields") or {}).items():
        if isinstance(own, Mapping) and "sort" in own:
            rules[f] = parse_sort_rule(own["sort"])
    kind = table.get("format", "toml")
    body = title = None
    if isinstance(kind, Mapping):
        body, title, kind = kind.get("body"), kind.get("title"), kind.get("type", "toml")
    if kind not in EXTENSIONS:
        raise ConfigError(f"unknown format {kind!r}; one of {', '.join(EXTENSIONS)}")
    if kind != "toml":
        if not body:
            raise ConfigError(f"format {kind} of sheet {name!r} needs a body field")
        if body in parsed.field_names():
            raise ConfigError(f"the body field {body!r} can't be in the path template")
    implements = table.get("implements", ())
    if isinstance(implements, str) or not all(isinstance(x, str) for x in implements):
        raise ConfigError("implements must be a list of contract names")
    return SheetConfig(name, parsed, root, dict(schema) if schema else None, rules, kind, body, title, tuple(implements), dict(table))


def parse(name: str, text: str) -> SheetConfig:
    table = toml.parse(text).get("sheet")
    if not isinstance(table, Mapping):
        raise ConfigError(f"configuration of {name!r} has no table [sheet]")
    return from_table(name, table)


def serialize(table: Mapping[str, Any]) -> str:
    return toml.serialize({"sheet": table})


def scaffold(path: str, **extra: Any) -> dict:
    """The table of a new sheet."""
    out = {"path": path, "root": ".", **extra}
    from_table("new", out)
    return out


def migrate(table: Mapping[str, Any]) -> tuple[dict, list[str]]:
    """Old field settings (type, enum, default) as a schema; sort rules stay. Returns the new table and warnings."""
    out = {k: v for k, v in table.items() if k != "fields"}
    fields, properties, warnings = {}, dict((table.get("schema") or {}).get("properties") or {}), []
    for name, own in (table.get("fields") or {}).items():
        prop = {k: own[k] for k in ("type", "enum", "default") if k in own}
        if prop:
            properties.setdefault(name, {}).update(prop)
        for k in own:
            if k in ("trueValues", "falseValues"):
                warnings.append(f"{name}.{k} has no counterpart in a schema and is dropped")
        if "sort" in own:
            fields[name] = {"sort": own["sort"]}
    if properties:
        out["schema"] = {**(table.get("schema") or {"type": "object"}), "properties": properties}
    if fields:
        out["fields"] = fields
    return out, warnings


def property_summary(schema: Mapping[str, Any] | None) -> dict[str, str]:
    """One line for each property: type (format) [required] enum."""
    out = {}
    needed = set((schema or {}).get("required") or [])
    for name, p in ((schema or {}).get("properties") or {}).items():
        kind = p.get("type", "any") if isinstance(p, Mapping) else "any"
        text = "|".join(kind) if isinstance(kind, list) else str(kind)
        if isinstance(p, Mapping) and "format" in p:
            text += f" ({p['format']})"
        if name in needed:
            text += " [required]"
        if isinstance(p, Mapping) and "enum" in p:
            text += " enum: " + "|".join(map(str, p["enum"]))
        out[name] = text
    return out
