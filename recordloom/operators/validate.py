"""JSON Schema (draft 7) over records: as Columns where types allow, and as a Python validator for documents."""

from __future__ import annotations

import datetime as dt
import json
import re
from collections.abc import Callable, Iterator, Mapping
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.errors import ConfigError
from recordloom.functions.values import NUMERIC, column_of
from recordloom.operators.analytics import json_type
from recordloom.operators.patch import split_pointer

_ONE = {"additionalItems", "additionalProperties", "contains", "else", "if", "not", "propertyNames", "then"}
_MANY = {"allOf", "anyOf", "oneOf"}
_MAPS = {"definitions", "$defs", "dependencies", "patternProperties", "properties"}
_PLAIN = {"$comment", "$id", "$ref", "$schema", "const", "contentEncoding", "contentMediaType", "default", "description", "enum", "examples", "exclusiveMaximum", "exclusiveMinimum", "format", "maxItems", "maxLength", "maxProperties", "maximum", "minItems", "minLength", "minProperties", "minimum", "multipleOf", "pattern", "readOnly", "required", "title", "type", "uniqueItems", "writeOnly"}
_FORMATS = {
    "email": r"^[^@\s]+@[^@\s]+$",
    "date": r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])$",
    "time": r"^([01]\d|2[0-3]):[0-5]\d:([0-5]\d|60)(\.\d+)?(?:[-+]\d{2}:\d{2}|[zZ])$",
    "date-time": r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])[Tt ]([01]\d|2[0-3]):[0-5]\d:([0-5]\d|60)(\.\d+)?(?:[-+]\d{2}:\d{2}|[zZ])$",
    "uri": r"^[A-Za-z][A-Za-z0-9+.-]*:\S*$",
    "uuid": r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    "ipv4": r"^((25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(25[0-5]|2[0-4]\d|1?\d?\d)$",
    "ipv6": r"^[0-9a-fA-F:.]*:[0-9a-fA-F:.]*$",
    "hostname": r"^(?=.{1,253}$)[A-Za-z0-9]([A-Za-z0-9-]{0,61}[A-Za-z0-9])?(\.[A-Za-z0-9]([A-Za-z0-9-]{0,61}[A-Za-z0-9])?)*$",
}


def walk(schema: Any, visit: Callable[[str, Any, str], None], at: str = "#") -> None:
    """visit(keyword, value, pointer) of every keyword in a schema position."""
    if isinstance(schema, bool):
        return
    if not isinstance(schema, Mapping):
        raise ConfigError(f"{at} is no schema")
    for k, v in schema.items():
        here = f"{at}/{k}"
        visit(k, v, here)
        if k in _ONE and isinstance(v, (Mapping, bool)):
            walk(v, visit, here)
        elif k == "items":
            for i, x in enumerate(v if isinstance(v, list) else [v]):
                walk(x, visit, f"{here}/{i}" if isinstance(v, list) else here)
        elif k in _MANY:
            for i, x in enumerate(v):
                walk(x, visit, f"{here}/{i}")
        elif k in _MAPS:
            for name, x in v.items():
                if not isinstance(x, list):
                    walk(x, visit, f"{here}/{name}")


def check_schema(schema: Any) -> None:
    """Raise for keywords that draft 7 doesn't have, and for values that its keywords can't have."""

    def visit(k: str, v: Any, at: str) -> None:
        if k not in _ONE | _MANY | _MAPS | _PLAIN | {"items"}:
            raise ConfigError(f"unknown keyword {k!r} at {at}")
        if k == "type":
            for t in v if isinstance(v, list) else [v]:
                if t not in ("string", "integer", "number", "boolean", "array", "object", "null"):
                    raise ConfigError(f"unknown type {t!r} at {at}")
        if k == "pattern":
            try:
                re.compile(v)
            except (re.error, TypeError):
                raise ConfigError(f"invalid pattern at {at}") from None
        if k == "required" and not (isinstance(v, list) and all(isinstance(x, str) for x in v)):
            raise ConfigError(f"required must be a list of names at {at}")
        if k in _MAPS and not isinstance(v, Mapping) or k in _MANY and not isinstance(v, list):
            raise ConfigError(f"invalid value of {k!r} at {at}")

    walk(schema, visit)


# Python validator:


def _is(value: Any, kind: str) -> bool:
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    return {
        "string": isinstance(value, (str, dt.date, dt.time)),
        "integer": number and float(value).is_integer(),
        "number": number,
        "boolean": isinstance(value, bool),
        "array": isinstance(value, list),
        "object": isinstance(value, Mapping),
        "null": value is None,
    }[kind]


def _equal(a: Any, b: Any) -> bool:
    if isinstance(a, bool) != isinstance(b, bool):
        return False
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(_equal(x, y) for x, y in zip(a, b, strict=True))
    if isinstance(a, Mapping) and isinstance(b, Mapping):
        return a.keys() == b.keys() and all(_equal(v, b[k]) for k, v in a.items())
    return a == b


def _issue(path: str, at: str, message: str) -> dict:
    return {"path": path, "schema_path": at, "code": at.rsplit("/", 1)[-1], "message": message}


def document_issues(value: Any, schema: Any, root: Any = None, path: str = "", at: str = "#") -> list[dict]:
    """All violations in one document: path, schema_path, code and message. Unknown formats pass."""
    root = schema if root is None else root
    if schema is True:
        return []
    if schema is False:
        return [_issue(path, at + "/false", "nothing is allowed here")]
    if "$ref" in schema:
        target: Any = root
        for t in split_pointer(schema["$ref"].lstrip("#")):
            target = target[t]
        return document_issues(value, target, root, path, f"{at}/$ref")
    out: list[dict] = []
    add = lambda k, m: out.append(_issue(path, f"{at}/{k}", m))
    sub = lambda v, s, p, k: document_issues(v, s, root, p, f"{at}/{k}")
    text = value.isoformat() if isinstance(value, (dt.date, dt.time)) else value
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    for k, v in schema.items():
        if k == "type" and not any(_is(value, t) for t in (v if isinstance(v, list) else [v])):
            add(k, f"is not of type {v}")
        elif k == "enum" and not any(_equal(text, x) for x in v):
            add(k, "is none of the allowed values")
        elif k == "const" and not _equal(text, v):
            add(k, "is not the allowed value")
        elif number and (k == "minimum" and value < v or k == "maximum" and value > v or k == "exclusiveMinimum" and value <= v or k == "exclusiveMaximum" and value >= v):
            add(k, f"breaks {k} {v}")
        elif number and k == "multipleOf" and abs(value / v - round(value / v)) > 1e-9:
            add(k, f"is no multiple of {v}")
        elif isinstance(text, str):
            if k == "minLength" and len(text) < v or k == "maxLength" and len(text) > v:
                add(k, f"breaks {k} {v}")
            elif k == "pattern" and not re.search(v, text):
                add(k, f"does not match {v}")
            elif k == "format" and v in _FORMATS and not re.search(_FORMATS[v], text):
                add(k, f"is no {v}")
        elif isinstance(value, list):
            if k == "minItems" and len(value) < v or k == "maxItems" and len(value) > v:
                add(k, f"breaks {k} {v}")
            elif k == "uniqueItems" and v and any(_equal(a, b) for i, a in enumerate(value) for b in value[:i]):
                add(k, "has repeated items")
            elif k == "items":
                for i, x in enumerate(value):
                    if isinstance(v, list):
                        s = v[i] if i < len(v) else schema.get("additionalItems", True)
                        out += sub(x, s, f"{path}/{i}", f"items/{i}" if i < len(v) else "additionalItems")
                    else:
                        out += sub(x, v, f"{path}/{i}", "items")
            elif k == "contains" and not any(not sub(x, v, path, k) for x in value):
                add(k, "has no matching item")
        elif isinstance(value, Mapping):
            if k == "required":
                out += [_issue(path, f"{at}/required", f"lacks {n!r}") for n in v if n not in value]
            elif k == "minProperties" and len(value) < v or k == "maxProperties" and len(value) > v:
                add(k, f"breaks {k} {v}")
            elif k == "properties":
                for n, s in v.items():
                    if n in value:
                        out += sub(value[n], s, f"{path}/{n}", f"properties/{n}")
            elif k == "patternProperties":
                for p, s in v.items():
                    for n in value:
                        if re.search(p, n):
                            out += sub(value[n], s, f"{path}/{n}", f"patternProperties/{p}")
            elif k == "additionalProperties":
                extra = [n for n in value if n not in schema.get("properties", {}) and not any(re.search(p, n) for p in schema.get("patternProperties", {}))]
                if v is False and extra:
                    add(k, f"has additional properties {', '.join(sorted(extra))}")
                elif v is not False:
                    for n in extra:
                        out += sub(value[n], v, f"{path}/{n}", k)
            elif k == "propertyNames":
                for n in value:
                    out += sub(n, v, path, k)
            elif k == "dependencies":
                for n, d in v.items():
                    if n in value:
                        out += [_issue(path, f"{at}/dependencies", f"lacks {x!r}") for x in d if x not in value] if isinstance(d, list) else sub(value, d, path, f"dependencies/{n}")
    for i, s in enumerate(schema.get("allOf", [])):
        out += sub(value, s, path, f"allOf/{i}")
    if "anyOf" in schema and not any(not sub(value, s, path, "anyOf") for s in schema["anyOf"]):
        add("anyOf", "matches none of the schemas")
    if "oneOf" in schema and sum(not sub(value, s, path, "oneOf") for s in schema["oneOf"]) != 1:
        add("oneOf", "does not match exactly one of the schemas")
    if "not" in schema and not sub(value, schema["not"], path, "not"):
        add("not", "matches a forbidden schema")
    if "if" in schema:
        branch = "then" if not sub(value, schema["if"], path, "if") else "else"
        if branch in schema:
            out += sub(value, schema[branch], path, branch)
    return out


# Columns:

ISSUE = "struct<path:string,schema_path:string,code:string,message:string>"
_COLUMN_KEYWORDS = {"$schema", "$id", "$comment", "title", "description", "default", "examples", "type", "enum", "const", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf", "minLength", "maxLength", "pattern", "format", "minItems", "maxItems", "uniqueItems", "items", "required", "properties", "additionalProperties", "allOf", "anyOf", "oneOf", "not", "definitions", "$defs"}


class _Unsupported(Exception):
    pass


def _violation(cond: Column, path: str, at: str, message: str) -> Column:
    issue = F.struct(F.lit(path).alias("path"), F.lit(at).alias("schema_path"), F.lit(at.rsplit("/", 1)[-1]).alias("code"), F.lit(message).alias("message"))
    return F.when(F.coalesce(cond, F.lit(False)), issue)


def _compile(c: Column, kind: T.DataType, schema: Any, path: str, at: str) -> list[Column]:
    """Violation columns of a value (null where it is fine or absent)."""
    if schema is True:
        return []
    if not isinstance(schema, Mapping) or set(schema) - _COLUMN_KEYWORDS:
        raise _Unsupported
    out: list[Column] = []
    there = c.isNotNull()
    number, text, items = isinstance(kind, NUMERIC), isinstance(kind, T.StringType), isinstance(kind, T.ArrayType)
    name = json_type(kind)
    for k, v in schema.items():
        here = f"{at}/{k}"
        if k == "type":
            wanted = v if isinstance(v, list) else [v]
            if name in wanted or name == "integer" and "number" in wanted:
                continue
            if name == "number" and "integer" in wanted:
                out.append(_violation(there & (c.cast("double") != F.floor(c.cast("double"))), path, here, f"is not of type {v}"))
            else:
                out.append(_violation(there, path, here, f"is not of type {v}"))
        elif k in ("enum", "const"):
            values = v if k == "enum" else [v]
            if not all(isinstance(x, (str, int, float, bool)) for x in values) or not (number or text or isinstance(kind, T.BooleanType)):
                raise _Unsupported
            if text:
                own = [x for x in values if isinstance(x, str)]
            elif number:
                own = [x for x in values if isinstance(x, (int, float)) and not isinstance(x, bool)]
            else:
                own = [x for x in values if isinstance(x, bool)]
            out.append(_violation(there & ~c.isin(own) if own else there, path, here, "is none of the allowed values" if k == "enum" else "is not the allowed value"))
        elif k in ("minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf"):
            if number:
                test = {"minimum": c < v, "maximum": c > v, "exclusiveMinimum": c <= v, "exclusiveMaximum": c >= v, "multipleOf": F.abs(c / v - F.round(c / v)) > 1e-9}[k]
                out.append(_violation(test, path, here, f"is no multiple of {v}" if k == "multipleOf" else f"breaks {k} {v}"))
        elif k in ("minLength", "maxLength"):
            if text:
                out.append(_violation(F.length(c) < v if k == "minLength" else F.length(c) > v, path, here, f"breaks {k} {v}"))
        elif k == "pattern" or k == "format":
            expression = v if k == "pattern" else _FORMATS.get(v)
            if text and expression:
                out.append(_violation(~c.rlike(expression), path, here, f"does not match {v}" if k == "pattern" else f"is no {v}"))
        elif k in ("minItems", "maxItems"):
            if items:
                out.append(_violation(F.size(c) < v if k == "minItems" else F.size(c) > v, path, here, f"breaks {k} {v}"))
        elif k == "uniqueItems":
            if items and v:
                out.append(_violation(F.size(F.array_distinct(c)) < F.size(c), path, here, "has repeated items"))
        elif k == "items":
            if items:
                if isinstance(v, list):
                    raise _Unsupported
                inner = _compile(F.lit(0), kind.elementType, v, "", "")  # to see that it compiles
                if inner:
                    found = F.filter(F.flatten(F.transform(c, lambda x, i: F.array(*[_indexed(y, path, i) for y in _compile(x, kind.elementType, v, "", here)]))), lambda y: y.isNotNull())
                    out.append(F.when(there, found).cast(f"array<{ISSUE}>"))
        elif k in ("required", "properties", "additionalProperties"):
            if isinstance(kind, T.StructType):
                out += _object(c, {f.name: (c.getField(f.name), f.dataType) for f in kind.fields}, schema, k, path, at, there)
            elif isinstance(kind, T.MapType):
                raise _Unsupported
        elif k == "allOf":
            for i, s in enumerate(v):
                out += _compile(c, kind, s, path, f"{here}/{i}")
        elif k in ("anyOf", "oneOf", "not"):
            if path == "" and at == "#":
                raise _Unsupported
            fine = [_fine(_compile(c, kind, s, path, at)) for s in (v if k != "not" else [v])]
            hits = sum((f.cast("int") for f in fine), F.lit(0))
            if k == "not":
                out.append(_violation(there & (hits == 1), path, here, "matches a forbidden schema"))
            else:
                out.append(_violation(there & (hits == 0 if k == "anyOf" else hits != 1), path, here, "matches none of the schemas" if k == "anyOf" else "does not match exactly one of the schemas"))
    return out


def _indexed(issue: Column, path: str, i: Column) -> Column:
    """issue with the path of item i in front of its own."""
    return F.when(issue.isNotNull(), issue.withField("path", F.concat(F.lit(path + "/"), i.cast("string"), issue["path"])))


def _fine(issues: list[Column]) -> Column:
    out = F.lit(True)
    for x in issues:
        out = out & x.isNull()
    return out


def _object(c: Column | None, fields: dict[str, tuple[Column, T.DataType]], schema: Mapping, k: str, path: str, at: str, there: Column) -> list[Column]:
    out: list[Column] = []
    if k == "required":
        for n in schema[k]:
            absent = fields[n][0].isNull() if n in fields else F.lit(True)
            out.append(_violation(there & absent, path, f"{at}/required", f"lacks {n!r}"))
    elif k == "properties":
        for n, s in schema[k].items():
            if n in fields:
                out += _compile(*fields[n], s, f"{path}/{n}", f"{at}/properties/{n}")
    elif k == "additionalProperties":
        extra = sorted(n for n in fields if n not in schema.get("properties", {}))
        if schema[k] is False:
            if extra:
                names = F.array_join(F.array_compact(F.array(*[F.when(fields[n][0].isNotNull(), F.lit(n)) for n in extra])), ", ")
                issue = F.struct(F.lit(path).alias("path"), F.lit(f"{at}/{k}").alias("schema_path"), F.lit(k).alias("code"), F.concat(F.lit("has additional properties "), names).alias("message"))
                out.append(F.when(there & (names != ""), issue))
        else:
            for n in extra:
                out += _compile(*fields[n], schema[k], f"{path}/{n}", f"{at}/{k}")
    return out


def _violations(df: DataFrame, schema: Mapping, exclude: tuple[str, ...]) -> tuple[list[Column], list[Column]] | None:
    """Columns of single issues and of lists of issues, or None where the schema needs the Python validator."""
    fields = {f.name: (column_of(df, f.name), f.dataType) for f in df.schema.fields if f.name not in exclude}

    def top(s: Mapping, at: str) -> list[Column]:
        if s is True:
            return []
        if not isinstance(s, Mapping) or set(s) - _COLUMN_KEYWORDS or set(s) & {"anyOf", "oneOf", "not", "enum", "const"}:
            raise _Unsupported
        out: list[Column] = []
        for k, v in s.items():
            if k == "type" and "object" not in (v if isinstance(v, list) else [v]):
                out.append(_violation(F.lit(True), "", f"{at}/type", f"is not of type {v}"))
            elif k in ("required", "properties", "additionalProperties"):
                out += _object(None, fields, s, k, "", at, F.lit(True))
            elif k == "allOf":
                for i, x in enumerate(v):
                    out += top(x, f"{at}/allOf/{i}")
        return out

    try:
        parts = top(schema, "#")
    except _Unsupported:
        return None
    if not parts:
        return [], []
    kinds = df.select(*[p.alias(f"p{i}") for i, p in enumerate(parts)]).schema
    single = [p for p, f in zip(parts, kinds.fields, strict=True) if isinstance(f.dataType, T.StructType)]
    return single, [p for p, f in zip(parts, kinds.fields, strict=True) if isinstance(f.dataType, T.ArrayType)]


def compiled(df: DataFrame, schema: Mapping, exclude: tuple[str, ...] = ("_path", "_sheet", "_blob")) -> Column | None:
    """All issues of a record as one array column, or None where the schema needs the Python validator."""
    found = _violations(df, schema, exclude)
    if found is None:
        return None
    none = F.array().cast(f"array<{ISSUE}>")
    single, lists = found
    return F.concat(F.array_compact(F.array(*single)).cast(f"array<{ISSUE}>") if single else none, *[F.coalesce(x, none) for x in lists])


def issues_column(df: DataFrame, schema: Mapping, exclude: tuple[str, ...] = ("_path", "_sheet", "_blob")) -> Column:
    """All issues of a record as an array: by Columns, or by Arrow batches of JSON where a keyword needs Python."""
    check_schema(schema)
    found = compiled(df, schema, exclude)
    if found is not None:
        return found
    own = json.dumps(schema)

    @F.pandas_udf(f"array<{ISSUE}>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        rule = json.loads(own)
        for texts in parts:
            yield pd.Series([document_issues(json.loads(t), rule) for t in texts])

    return run(F.to_json(F.struct(*[column_of(df, f.name) for f in df.schema.fields if f.name not in exclude])))


def issues(df: DataFrame, schema: Mapping, key: str = "_path") -> DataFrame:
    """(key, path, schema_path, code, message), a row for each issue of each record; records without any give none."""
    return df.select(F.col(key), F.explode(issues_column(df, schema)).alias("i")).select(key, "i.*")


def valid(df: DataFrame, schema: Mapping) -> DataFrame:
    """Records without issues."""
    return df.where(F.size(issues_column(df, schema)) == 0)


def issue_counts(df: DataFrame, schema: Mapping, key: str = "_path") -> DataFrame:
    """(code, issues). Where every issue is a single one, in one aggregation without making the issues."""
    check_schema(schema)
    found = _violations(df, schema, ("_path", "_sheet", "_blob"))
    if found is None or found[1] or not found[0]:
        return issues(df, schema, key).groupBy("code").agg(F.count("*").alias("issues"))
    counts = df.agg(*[F.count(x["code"]).alias(f"n{k}") for k, x in enumerate(found[0])], *[F.max(x["code"]).alias(f"c{k}") for k, x in enumerate(found[0])])
    each = counts.select(F.inline(F.array(*[F.struct(F.col(f"c{k}").alias("code"), F.col(f"n{k}").alias("n")) for k in range(len(found[0]))])))
    return each.where("n > 0").groupBy("code").agg(F.sum("n").alias("issues"))
