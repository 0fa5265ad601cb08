"""Canonical TOML: parser, writer, and their batch forms over columns."""

from __future__ import annotations

import datetime as dt
import json
import math
import re
import tomllib
from collections.abc import Iterator, Mapping
from functools import lru_cache
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from recordloom.errors import ConfigError

_BARE = re.compile(r"[A-Za-z0-9_-]+")
#: A line of a bare key and a scalar without escapes; texts of nothing else need no full parser.
_FLAT = re.compile(r'([A-Za-z0-9_-]+) = (?:"([^"\\\x00-\x1f\x7f]*)"|(-?(?:0|[1-9][0-9]{0,17}))|(-?(?:0|[1-9][0-9]{0,17})\.[0-9]+)|(true|false))\n')
_ESCAPED = re.compile(r'["\\\x00-\x1f\x7f]')
_SHORT = {"\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r", '"': '\\"', "\\": "\\\\"}


def _parse_flat(text: str) -> dict | None:
    """Record of a text of simple lines only, or None."""
    record: dict[str, Any] = {}
    end = n = 0
    step = _FLAT.scanner(text).match
    while m := step():
        key, string, whole, fraction, flag = m.groups()
        record[key] = string if string is not None else int(whole) if whole else float(fraction) if fraction else flag == "true"
        end, n = m.end(), n + 1
    return record if end == len(text) and n == len(record) else None


def parse(text: str) -> dict:
    if (flat := _parse_flat(text)) is not None:
        return flat
    try:
        return tomllib.loads(text.removeprefix("﻿"))
    except tomllib.TOMLDecodeError as e:
        raise ConfigError(f"invalid TOML: {e}") from None


def sort_keys(value: Any) -> Any:
    """The value with the keys of all tables in byte order and null entries dropped; a null list element is an error."""
    if isinstance(value, Mapping):
        return {k: sort_keys(v) for k, v in sorted(value.items(), key=lambda x: str(x[0]).encode()) if v is not None}
    if isinstance(value, (list, tuple)):
        if any(v is None for v in value):
            raise ConfigError("a list can't hold null")
        return [sort_keys(v) for v in value]
    return value


@lru_cache(4096)
def _key(k: str) -> str:
    return k if _BARE.fullmatch(k) else _basic(k)


def _basic(s: str) -> str:
    return '"' + _ESCAPED.sub(lambda m: _SHORT.get(m[0]) or f"\\u{ord(m[0]):04X}", s) + '"'


def _string(s: str) -> str:
    if "\n" not in s:
        return _basic(s)
    body = "".join("\\\\" if c == "\\" else c if c in '\n\t"' else _SHORT.get(c) or (f"\\u{ord(c):04X}" if ord(c) < 32 or ord(c) == 127 else c) for c in s)
    body = re.sub(r'"{3,}', lambda m: '\\"' * len(m.group()), body)
    if len(body) - len(body.rstrip('"')) > 2:
        body = body.rstrip('"') + '\\"' * (len(body) - len(body.rstrip('"')))
    return f'"""\n{body}"""'


def _scalar(v: Any) -> str:
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, int):
        return str(v)
    if isinstance(v, float):
        if math.isnan(v) or math.isinf(v):
            return "nan" if math.isnan(v) else "inf" if v > 0 else "-inf"
        return repr(v) if re.search(r"[.e]", repr(v)) else f"{v!r}.0"
    if isinstance(v, dt.datetime):
        return v.isoformat().replace("+00:00", "Z")
    if isinstance(v, (dt.date, dt.time)):
        return v.isoformat()
    if isinstance(v, str):
        return _string(v)
    if isinstance(v, list):
        return "[" + ", ".join(_inline(x) for x in v) + "]"
    raise ConfigError(f"TOML can't hold a {type(v).__name__}")


def _inline(v: Any) -> str:
    if isinstance(v, Mapping):
        return "{ " + ", ".join(f"{_key(k)} = {_inline(x)}" for k, x in v.items()) + " }" if v else "{}"
    return _basic(v) if isinstance(v, str) else _scalar(v)


def _serialize_flat(record: dict) -> str | None:
    """Text of a record of simple scalars only, or None."""
    out: list[str] = []
    for k, v in sorted(record.items()):
        kind = type(v)
        if kind is str and not _ESCAPED.search(v):
            out.append(f'{_key(k)} = "{v}"\n')
        elif kind is int:
            out.append(f"{_key(k)} = {v}\n")
        elif kind is bool or kind is float:
            out.append(f"{_key(k)} = {_scalar(v)}\n")
        elif v is not None:
            return None
    return "".join(out)


def serialize(record: Mapping[str, Any]) -> str:
    """Canonical text: sorted keys, values before tables, lists of tables as [[name]]; equal records give equal bytes."""
    if type(record) is dict and all(type(k) is str for k in record) and (flat := _serialize_flat(record)) is not None:
        return flat
    out: list[str] = []

    def tables(v: Any) -> bool:
        return isinstance(v, list) and bool(v) and all(isinstance(x, Mapping) for x in v)

    def emit(table: Mapping[str, Any], name: str) -> None:
        for k, v in table.items():
            if not isinstance(v, Mapping) and not tables(v):
                out.append(f"{_key(k)} = {_scalar(v)}\n")
        for k, v in table.items():
            full = f"{name}.{_key(k)}" if name else _key(k)
            for x in [v] if isinstance(v, Mapping) else v if tables(v) else []:
                if isinstance(v, Mapping) and x and all(isinstance(y, Mapping) or tables(y) for y in x.values()):
                    emit(x, full)  # a table of nothing but tables needs no header
                    continue
                out.append(("\n" if out else "") + (f"[{full}]\n" if isinstance(v, Mapping) else f"[[{full}]]\n"))
                emit(x, full)

    emit(sort_keys(record), "")
    return "".join(out)


def to_plain(value: Any) -> Any:
    """The value as JSON can hold it: datetimes as text, numbers that JSON lacks as null."""
    if type(value) in (str, int, bool):
        return value
    if isinstance(value, Mapping):
        return {k: to_plain(v) for k, v in value.items()}
    if isinstance(value, list):
        return [to_plain(v) for v in value]
    if isinstance(value, (dt.date, dt.time)):
        return value.isoformat().replace("+00:00", "Z")
    if isinstance(value, float) and not math.isfinite(value):
        return None
    return value


def parse_column(text: Column) -> Column:
    """TOML texts as JSON texts."""
    encode = json.JSONEncoder(ensure_ascii=False).encode

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for p in parts:
            yield p.map(lambda t: None if t is None else encode(to_plain(parse(t))))

    return run(text)


def serialize_column(document: Column) -> Column:
    """JSON texts of records as canonical TOML texts."""

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for p in parts:
            yield p.map(lambda t: None if t is None else serialize(json.loads(t)))

    return run(document)
