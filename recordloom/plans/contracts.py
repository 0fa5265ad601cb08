"""Contracts: named, immutable schemas that sheets implement."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import TYPE_CHECKING, Any

from recordloom.errors import ConfigError, ContractError
from recordloom.operators import validate as val
from recordloom.plans.config import SheetConfig
from recordloom.sources import toml

if TYPE_CHECKING:
    from recordloom.store import Sheet, Store

_FOLDER = "contracts/"


def check_name(name: str) -> str:
    """A contract's name is a host-qualified path: no empty, dotted or odd segments."""
    parts = name.split("/")
    if len(parts) < 2 or any(not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*", p) for p in parts) or "." not in parts[0]:
        raise ContractError(f"invalid contract name {name!r}")
    return name


def check_document(name: str, document: Mapping[str, Any]) -> dict:
    """Raise unless the document names itself, refers to nothing outside, stays open and has no null branches."""
    check_name(name)
    if not isinstance(document, Mapping):
        raise ContractError(f"contract {name!r} must be a table")
    if document.get("$id") != f"https://{name}":
        raise ContractError(f"$id of contract {name!r} must be https://{name}")

    def visit(k: str, v: Any, at: str) -> None:
        if k == "$ref" and isinstance(v, str) and not v.startswith("#"):
            raise ContractError(f"contract {name!r} refers to {v!r}, outside of itself")
        if k == "additionalProperties" and v is False:
            raise ContractError(f"contract {name!r} closes itself by additionalProperties at {at}")
        nulls = {"type": v == "null" or isinstance(v, list) and "null" in v, "enum": isinstance(v, list) and None in v, "const": v is None, "default": v is None}
        if nulls.get(k):
            raise ContractError(f"contract {name!r}: {k} at {at} allows null, which no record has")

    val.walk(document, visit)
    try:
        val.check_schema(document)
    except ConfigError as e:
        raise ContractError(f"contract {name!r}: {e}") from None
    return dict(document)


def canonical_hash(document: Mapping[str, Any] | str) -> str:
    """SHA-256 of the canonical form of a document, given as a mapping, JSON or TOML."""
    if isinstance(document, str):
        document = json.loads(document) if document.lstrip().startswith("{") else toml.parse(document)
    return hashlib.sha256(toml.serialize(document).encode()).hexdigest()


def load(configs: Mapping[str, str], name: str) -> dict:
    """The vendored document, which must be in canonical form byte by byte."""
    text = configs.get(_FOLDER + name)
    if text is None:
        raise ContractError(f"no contract {name!r} is vendored", "contract_missing")
    document = toml.parse(text)
    if toml.serialize(document) != text:
        raise ContractError(f"contract {name!r} is not in canonical form")
    return check_document(name, toml.to_plain(document))


def compose(store: Store, config: SheetConfig, configs: Mapping[str, str] | None = None) -> dict | None:
    """The schema that holds for a sheet: all of its contracts, then its own."""
    if not config.implements:
        return config.schema
    known = store._configs() if configs is None else configs
    return {"allOf": [*(load(known, n) for n in config.implements), *([config.schema] if config.schema else [])]}


def source_of(schema_path: str, config: SheetConfig) -> str:
    """Which contract an issue of a composed schema comes from, or 'schema'."""
    m = re.match(r"#/allOf/(\d+)", schema_path)
    return config.implements[int(m[1])] if m and int(m[1]) < len(config.implements) else "schema"


@dataclass
class Report:
    rung: str
    conforms: bool
    records_read: int = 0
    issues: list[dict] = field(default_factory=list)


def verify(store: Store, sheet: Sheet, name: str, document: Mapping[str, Any], mode: str = "verify", most: int = 100) -> Report:
    """Whether a sheet conforms to a contract.

    declared: it says so, and the vendored document is the same; no record is
    read.  structural: all records satisfy the document; an empty sheet does.
    verify: the first, else the second.
    """
    if mode not in ("verify", "declared", "structural"):
        raise ConfigError(f"unknown mode {mode!r}")
    if mode != "structural":
        text = store._configs().get(_FOLDER + name)
        declared = name in sheet.config.implements and text is not None and canonical_hash(text) == canonical_hash(document)
        if declared or mode == "declared":
            return Report("declared", declared)
    rows = sheet.visible(sheet.records())
    found = val.issues(rows, document)
    bad = [r.asDict() for r in found.orderBy("_path").limit(most).collect()]
    return Report("structural", not bad, rows.count(), bad)


def adopt(store: Store, name: str, document: Mapping[str, Any], sheets: list[str]) -> None:
    """Vendor a contract and let sheets implement it, if all of their records satisfy it."""
    check_document(name, document)
    for s in sheets:
        report = verify(store, store.sheet(s), name, document, "structural")
        if not report.conforms:
            raise ContractError(f"records of {s!r} break contract {name!r}", "contract_mismatch", issues=report.issues)
    with store.transact(f"Adopt {name}") as tx:
        tx.write_config(_FOLDER + name, document)
        for s in sheets:
            table = dict(store.sheet(s).config.raw)
            table["implements"] = list(dict.fromkeys([*table.get("implements", []), name]))
            tx.write_config(s, table)


def test(sheet: Sheet, document: Mapping[str, Any]) -> Report:
    """Any schema against the records of a sheet."""
    found = val.issues(sheet.visible(sheet.records()), document)
    bad = [r.asDict() for r in found.limit(100).collect()]
    return Report("structural", not bad, issues=bad)


def sync(store: Store, name: str, fetched: Mapping[str, Any] | str) -> str:
    """match or drift of a fetched document against the vendored one; never rewrites."""
    load(store._configs(), name)
    return "match" if canonical_hash(fetched) == canonical_hash(store._configs()[_FOLDER + name]) else "drift"


def export(store: Store, name: str) -> str:
    return json.dumps(load(store._configs(), name), indent=2, sort_keys=True)


def vendored(store: Store) -> list[str]:
    return sorted(k[len(_FOLDER) :] for k in store._configs() if k.startswith(_FOLDER))


def unused(store: Store) -> list[str]:
    """Vendored contracts that no sheet implements."""
    used = {n for s in store.sheets().values() for n in s.config.implements}
    return [n for n in vendored(store) if n not in used]


def prune(store: Store) -> list[str]:
    """Delete the contracts that no sheet implements; returns their names."""
    gone = unused(store)
    if gone:
        with store.transact("Prune contracts") as tx:
            for n in gone:
                tx.delete_config(_FOLDER + n)
    return gone
