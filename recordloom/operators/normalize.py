"""Normalisation of records: order of keys and of list fields, content hashes, small helpers."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import cmp_to_key
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.errors import ConfigError
from recordloom.functions.values import column_of, type_of


def collation_key(text: str) -> tuple:
    """Sort key that ignores case, accents, punctuation and white space, and reads runs of digits as numbers.

    Exact for Latin text; an approximation of the root collation beyond it.
    """
    bare = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).casefold()
    parts = re.findall(r"\d+|[^\W\d_]+", bare)
    return tuple((0, int(p), "") if p.isdigit() else (1, 0, p) for p in parts)


def text_of(value: Any) -> str:
    """ECMAScript text of a value of a document."""
    if value is None:
        return ""
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float):
        return str(int(value)) if value == int(value) and abs(value) < 1e21 else repr(value)
    if isinstance(value, list):
        return ",".join(text_of(v) for v in value)
    if isinstance(value, Mapping):
        return "[object Object]"
    return str(value)


def parse_sort_rule(rule: Any) -> Any:
    """A rule is True (by collation), False (as is), a list of fields, a mapping of fields to ASC or DESC, or a comparator."""
    if isinstance(rule, bool) or callable(rule):
        return rule
    if isinstance(rule, list) and rule and all(isinstance(x, str) for x in rule):
        return {x: "ASC" for x in rule}
    if isinstance(rule, Mapping) and rule and all(str(v).upper() in ("ASC", "DESC") for v in rule.values()):
        return {k: str(v).upper() for k, v in rule.items()}
    raise ConfigError(f"invalid sort rule {rule!r}")


def sort_list(items: list, rule: Any) -> list:
    """The list in the order of a rule; stable. Elements without a field that a rule names compare as equal by it."""
    rule = parse_sort_rule(rule)
    if rule is False:
        return list(items)
    if rule is True:
        return sorted(items, key=lambda x: collation_key(text_of(x)))
    if callable(rule):
        return sorted(items, key=cmp_to_key(rule))

    def compare(a: Any, b: Any) -> int:
        for field, way in rule.items():
            x, y = (v.get(field) if isinstance(v, Mapping) else None for v in (a, b))
            if x is None or y is None or isinstance(x, str) != isinstance(y, str):
                continue
            if x != y:
                return (-1 if x < y else 1) * (1 if way == "ASC" else -1)
        return 0

    return sorted(items, key=cmp_to_key(compare))


def normalize_record(record: Mapping[str, Any], rules: Mapping[str, Any]) -> dict:
    """The record with sorted keys, without nulls, and with its list fields in the order of their rules; idempotent."""
    from recordloom.sources.toml import sort_keys

    out = sort_keys(record)
    return {k: sort_list(v, rules[k]) if k in rules and isinstance(v, list) else v for k, v in out.items()}


def sorted_list(df: DataFrame, field: str, rule: Any) -> Column:
    """A list column in the order of a rule: field rules as a built-in sort, collation by Arrow batches."""
    kind = type_of(df, field)
    c = column_of(df, field)
    rule = parse_sort_rule(rule)
    if rule is False or not isinstance(kind, T.ArrayType):
        return c
    if isinstance(rule, dict):
        if not isinstance(kind.elementType, T.StructType):
            return c
        names = {f.name for f in kind.elementType.fields}
        own = [(k, 1 if way == "ASC" else -1) for k, way in rule.items() if k in names]

        def compare(a: Column, b: Column) -> Column:
            out = F.lit(0)
            for k, way in reversed(own):
                out = F.when(a[k] < b[k], -way).when(a[k] > b[k], way).otherwise(out)
            return out

        return F.array_sort(c, compare)

    @F.pandas_udf(kind)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for p in parts:
            yield p.map(lambda x: None if x is None else sort_list(list(x), rule))

    return run(c)


def canonical_json(df: DataFrame, exclude: Sequence[str] = ("_path", "_sheet", "_blob")) -> Column:
    """Records as JSON with fields by name and without nulls: equal records give equal texts."""
    fields = sorted(c for c in df.columns if c not in exclude)
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in fields]))


def normalize(df: DataFrame, rules: Mapping[str, Any]) -> DataFrame:
    """Records with their list fields in order and a `_blob` hash of their canonical form."""
    out = df
    for field, rule in rules.items():
        if type_of(out, field) is not None:
            out = out.withColumn(field, sorted_list(out, field, rule))
    return out.withColumn("_blob", F.sha2(canonical_json(out), 256))


def changed_by_normalize(df: DataFrame, rules: Mapping[str, Any]) -> DataFrame:
    """Normalised records that differ from what they were."""
    before = df.withColumn("__before", F.sha2(canonical_json(df), 256))
    after = before
    for field, rule in rules.items():
        if type_of(after, field) is not None:
            after = after.withColumn(field, sorted_list(after, field, rule))
    return after.withColumn("_blob", F.sha2(canonical_json(after, ("_path", "_sheet", "_blob", "__before")), 256)).where("_blob <> __before").drop("__before")


#: Subtypes by extension, for each kind of content; where both are the same, the extension alone.
_MIME = {
    "text": "txt:plain md:markdown csv tsv:tab-separated-values html htm:html css",
    "image": "jpg:jpeg jpeg png gif webp avif bmp ico:vnd.microsoft.icon tiff svg:svg+xml",
    "audio": "mp3:mpeg wav ogg m4a:mp4 flac",
    "video": "mp4 webm mov:quicktime",
    "application": "toml json yaml yml:yaml xml js:javascript ts:typescript pdf zip gz:gzip tar:x-tar 7z:x-7z-compressed",
}
_MIME_TYPES = {x.split(":")[0]: f"{kind}/{x.split(':')[-1]}" for kind, all_of in _MIME.items() for x in all_of.split()}


def mime_type(name: str) -> str:
    """Type of a file by its extension, the same on every host."""
    return _MIME_TYPES.get(name.rpartition(".")[2].lower() if "." in name else "", "application/octet-stream")


def join_path(*parts: str) -> str:
    """Path of the parts without empty ones, dots and extra slashes."""
    return "/".join(p for part in parts for p in part.split("/") if p not in ("", "."))


def label(record: Mapping[str, Any]) -> str:
    """Short name of a record for messages."""
    for key in ("id", "slug", "name", "key", "path"):
        v = record.get(key)
        if isinstance(v, str) and v or isinstance(v, (int, float)) and not isinstance(v, bool):
            return f"{key}={text_of(v)}"
    return "no id field"


def documents(df: DataFrame, exclude: Sequence[str] = ("_path", "_sheet", "_blob")) -> Iterator[dict]:
    """Records as mappings, one at a time; for export of small results."""
    for row in df.select(canonical_json(df, exclude).alias("d")).toLocalIterator():
        yield json.loads(row.d)


Comparator = Callable[[Any, Any], int]
