"""Path templates: the identity of records, and the pruning that follows from it.

A template such as `${{ domain }}/${{ username }}` or
`${{ published: YYYY/MM/DD }}/${{ slug }}` gives every record its path.  Its
components are partition columns of the stored table, and equality filters on
the fields of leading components become equalities on those columns.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.errors import ConfigError, PathError
from recordloom.functions.values import column_of, js_string, type_of

_BUCKETS = {"YYYY": ("year",), "YYYY/MM": ("year", "month"), "YYYY/MM/DD": ("year", "month", "day"), "YYYY/WW": ("isoyear", "week")}
_IDENT = re.compile(r"[A-Za-z_$][\w$]*")
_BUCKET = re.compile(r"([A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*)\s*:\s*(\S.*)")
_SQL_WORDS = {"and", "or", "not", "case", "when", "then", "else", "end", "is", "null", "in", "like", "between", "as", "true", "false", "cast", "string", "int", "bigint", "double", "date", "timestamp", "interval", "from"}
_BAD = r'[<>:"\\|?*\x00-\x1f\x7f]'


@dataclass(frozen=True)
class Part:
    """A literal, field, recursive field, date bucket or SQL expression."""

    kind: str
    text: str
    unit: str | None = None


@dataclass(frozen=True)
class Component:
    parts: tuple[Part, ...]

    @property
    def recursive(self) -> bool:
        return any(p.kind == "recursive" for p in self.parts)


@dataclass(frozen=True)
class Template:
    source: str
    components: tuple[Component, ...]

    def field_names(self) -> list[str]:
        """Fields that the path is made of, in order."""
        out: list[str] = []
        for c in self.components:
            for p in c.parts:
                if p.kind in ("field", "recursive"):
                    out.append(p.text)
                elif p.kind == "bucket":
                    out.append(p.text.split(".")[0])
                elif p.kind == "expression":
                    bare = re.sub(r"'[^']*'", "", p.text)
                    out += [m.group() for m in _IDENT.finditer(bare) if m.group().lower() not in _SQL_WORDS and not bare[m.end() :].lstrip().startswith("(")]
        return list(dict.fromkeys(out))

    # rendering:

    def component_columns(self, df: DataFrame, strict: bool = False) -> list[Column]:
        """A column for each component; null where the record lacks what it needs."""
        return [F.concat(*[_part_column(p, df, strict) for p in c.parts]) if len(c.parts) > 1 else _part_column(c.parts[0], df, strict) for c in self.components]

    def render(self, df: DataFrame, strict: bool = False) -> Column:
        """Path of every record. With strict, a record without a legal path is an error, else its path is null."""
        columns = self.component_columns(df, strict)
        path = F.concat(*[c if k == 0 else F.concat(F.lit("/"), c) for k, c in enumerate(columns)])
        bad = F.lit(False)
        for component, c in zip(self.components, columns, strict=True):
            illegal = c.rlike(_BAD) | (c == "")
            bad = bad | F.coalesce(illegal if component.recursive else illegal | c.contains("/"), F.lit(False))
        if not strict:
            return F.when(~bad, path)
        missing = F.raise_error(F.lit(f"path_render_failed: a record lacks a field of {self.source}"))
        return F.when(bad, F.raise_error(F.lit(f"path_invalid_chars: a component of {self.source} has illegal characters"))).otherwise(F.coalesce(path, missing.cast("string")))

    def render_issues(self, df: DataFrame) -> Column:
        """Code of what is wrong with the path of a record, or null."""
        columns = self.component_columns(df)
        bad, missing = F.lit(False), F.lit(False)
        for component, c in zip(self.components, columns, strict=True):
            illegal = c.rlike(_BAD)
            bad = bad | F.coalesce(illegal if component.recursive else illegal | c.contains("/"), F.lit(False))
            missing = missing | c.isNull() | F.coalesce(c == "", F.lit(False))
        return F.when(missing, F.lit("path_render_failed")).when(bad, F.lit("path_invalid_chars"))

    def render_record(self, record: Mapping[str, Any]) -> str:
        """Path of one record as a mapping; raises where it has none."""
        out = []
        for k, c in enumerate(self.components):
            texts = [_part_text(p, record) for p in c.parts]
            if any(t is None for t in texts):
                raise PathError(f"component {k + 1} of {self.source!r} can't be rendered", "path_render_failed")
            text = "".join(t for t in texts if t is not None)
            if not text:
                raise PathError(f"component {k + 1} of {self.source!r} is empty", "path_render_failed")
            if re.search(_BAD, text) or (not c.recursive and "/" in text):
                raise PathError(f"component {k + 1} of {self.source!r} has illegal characters: {text!r}", "path_invalid_chars")
            out.append(text)
        return "/".join(out)

    # partitions and pruning:

    def partition_names(self, taken: Sequence[str] = ()) -> list[str]:
        """Names of the partition columns: all components but the last, which is the record itself."""
        return [f"_p{k}" for k in range(len(self.components) - 1)]

    def plan(self, criteria: Mapping[str, Any]) -> list[str | None]:
        """Text of each component that equality criteria pin down, None for the others."""
        known = {k: v for k, v in criteria.items() if isinstance(v, (str, int, float, bool, dt.date))}
        out: list[str | None] = []
        for c in self.components:
            texts = [_part_text(p, known, planning=True) for p in c.parts]
            out.append(None if any(t is None for t in texts) else "".join(t for t in texts if t is not None))
        return out

    def pruning(self, criteria: Mapping[str, Any], columns: Sequence[str]) -> Column | None:
        """Condition on the partition columns that follows from equality criteria, or None."""
        parts = [F.col(name) == F.lit(text) for name, text in zip(self.partition_names(), self.plan(criteria), strict=False) if text is not None and name in columns]
        out = None
        for p in parts:
            out = p if out is None else out & p
        return out


def parse(source: str) -> Template:
    """Parse a template; slashes at the ends don't count, and ${{ }} parts may hold slashes of their own."""
    text = source.strip().strip("/")
    if not text:
        raise PathError("a path template can't be empty", "path_render_failed")
    raw: list[list[Part]] = [[]]
    i = 0
    while i < len(text):
        if text.startswith("${{", i):
            end = text.find("}}", i)
            if end < 0:
                raise PathError(f"unclosed expression in {source!r}", "path_render_failed")
            raw[-1].append(_part(text[i + 3 : end].strip(), source))
            i = end + 2
        elif text[i] == "/":
            raw.append([])
            i += 1
        else:
            j = i
            while j < len(text) and text[j] != "/" and not text.startswith("${{", j):
                j += 1
            raw[-1].append(Part("literal", text[i:j]))
            i = j
    components: list[Component] = []
    for k, parts in enumerate(raw):
        if not parts:
            raise PathError(f"empty component in {source!r}", "path_render_failed")
        kinds = [p.kind for p in parts]
        if "recursive" in kinds and (len(parts) > 1 or k < len(raw) - 1):
            raise ConfigError(f"a recursive field must be the whole last component of {source!r}")
        if "bucket" in kinds:
            if len(parts) > 1:
                raise ConfigError(f"a date bucket must stand alone in {source!r}")
            components += [Component((Part("bucket", parts[0].text, unit),)) for unit in _BUCKETS[parts[0].unit or ""]]
        else:
            components.append(Component(tuple(parts)))
    return Template(source, tuple(components))


def _part(expression: str, source: str) -> Part:
    if not expression:
        raise PathError(f"empty expression in {source!r}", "path_render_failed")
    if expression.endswith("/**"):
        name = expression[:-3].strip()
        if not _IDENT.fullmatch(name):
            raise ConfigError(f"a recursive part needs a field name: {expression!r}")
        return Part("recursive", name)
    if _IDENT.fullmatch(expression):
        return Part("field", expression)
    if m := _BUCKET.fullmatch(expression):
        if m[2].strip() not in _BUCKETS:
            raise ConfigError(f"unknown date format {m[2]!r}; one of {', '.join(_BUCKETS)}")
        return Part("bucket", m[1], m[2].strip())
    return Part("expression", expression)


def _dotted(df: DataFrame, name: str) -> tuple[Column, T.DataType] | None:
    head, *rest = name.split(".")
    kind = type_of(df, head)
    if kind is None:
        return None
    c = column_of(df, head)
    for r in rest:
        kinds = {f.name: f.dataType for f in kind.fields} if isinstance(kind, T.StructType) else {}
        if r not in kinds:
            return None
        c, kind = c.getField(r), kinds[r]
    return c, kind


_UNITS: dict[str, Callable[[Column], Column]] = {
    "year": lambda d: F.lpad(F.year(d).cast("string"), 4, "0"),
    "month": lambda d: F.lpad(F.month(d).cast("string"), 2, "0"),
    "day": lambda d: F.lpad(F.day(d).cast("string"), 2, "0"),
    "isoyear": lambda d: F.lpad(F.extract(F.lit("YEAROFWEEK"), d).cast("string"), 4, "0"),
    "week": lambda d: F.lpad(F.weekofyear(d).cast("string"), 2, "0"),
}
_ISO = r"^\d{4}-\d{2}-\d{2}([Tt ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(?:[-+]\d{2}:?\d{2}|[zZ])?)?$"


def _part_column(p: Part, df: DataFrame, strict: bool) -> Column:
    if p.kind == "literal":
        return F.lit(p.text)
    if p.kind == "expression":
        return F.expr(p.text).cast("string")
    found = _dotted(df, p.text) if p.kind == "bucket" else ((column_of(df, p.text), kind) if (kind := type_of(df, p.text)) is not None else None)
    if found is None:
        return F.lit(None).cast("string")
    c, kind = found
    if p.kind != "bucket":
        renders = isinstance(kind, (T.StringType, T.BooleanType, T.NumericType))
        return js_string(c, kind) if renders else F.lit(None).cast("string")
    if isinstance(kind, T.StringType):
        zoned = c.rlike(r"(?:[-+]\d{2}:?\d{2}|[zZ])$") & c.rlike("[Tt ]")
        day = F.when(c.rlike(_ISO), F.when(zoned, F.to_utc_timestamp(F.try_to_timestamp(c), F.current_timezone())).otherwise(F.try_to_timestamp(F.regexp_replace(c, "[Tt]", " ")))).cast("date")
    elif isinstance(kind, T.TimestampType):
        day = F.to_utc_timestamp(c, F.current_timezone()).cast("date")
    elif isinstance(kind, (T.DateType, T.TimestampNTZType)):
        day = c.cast("date")
    else:
        if strict:
            return F.when(c.isNotNull(), F.raise_error(F.lit(f"path_render_failed: {p.text} is no date")).cast("string"))
        return F.lit(None).cast("string")
    return _UNITS[p.unit or ""](day)


def _part_text(p: Part, record: Mapping[str, Any], planning: bool = False) -> str | None:
    """Text of a part for one record, or None. Expressions are left to Spark."""
    if p.kind == "literal":
        return p.text
    if p.kind == "expression":
        return None
    value: Any = record
    for name in p.text.split(".") if p.kind == "bucket" else [p.text]:
        value = value.get(name) if isinstance(value, Mapping) else None
    if value is None:
        return None
    if p.kind == "bucket":
        if isinstance(value, str):
            if not re.match(_ISO, value):
                return None
            value = dt.datetime.fromisoformat(value)
        if isinstance(value, dt.datetime):
            value = (value.astimezone(dt.UTC) if value.tzinfo else value).date()
        if not isinstance(value, dt.date):
            return None
        iso = value.isocalendar()
        return {"year": f"{value.year:04}", "month": f"{value.month:02}", "day": f"{value.day:02}", "isoyear": f"{iso.year:04}", "week": f"{iso.week:02}"}[p.unit or ""]
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, int):
        return str(value)
    if isinstance(value, float):
        return str(int(value)) if value == int(value) and abs(value) < 1e21 else repr(value)
    return value if isinstance(value, str) else None
