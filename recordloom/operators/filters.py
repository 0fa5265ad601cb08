"""Filters: the compact language of clauses, and filters as mappings, compiled to Columns.

Everything compiles to plain comparisons, which Catalyst pushes to the scan, and
types are dispatched from the schema, so that no comparison depends on implicit
casts.  In a filter, null is as good as false; where a condition is negated or
shown, predicate() makes it true or false.
"""

from __future__ import annotations

import datetime as dt
import math
import re
from collections.abc import Callable, Iterable, Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.errors import FilterError
from recordloom.functions.values import INTEGRAL, NUMERIC, column_of, js_number, js_string, present, type_of

_FORMS = "field=value, field!=value, field>value, field<value, field>=value, field<=value, field~regex, field in (a,b), field:present, field:empty"
_FIELD = re.compile(r"[\w.-]+")
_STATE = re.compile(r"([\w.-]+):(present|empty)")
_IN = re.compile(r"([\w.-]+)\s+in\s*\((.*)\)", re.IGNORECASE | re.DOTALL)
_OPERATORS = ("!=", ">=", "<=", "~", ">", "<", "=")
_DATES = (T.DateType, T.TimestampType, T.TimestampNTZType)

#: A parsed clause: field, operator, operand.
Clause = tuple[str, str, Any]


def parse(clause: str) -> Clause:
    """Parse one clause.

    The kind of operator is searched in the order != >= <= ~ > < =, not the first
    position: `name=a~b` is a regex clause with the field `name=a`, and so an error.
    """
    text = clause.strip()
    if m := _STATE.fullmatch(text):
        return m[1], m[2], None
    if m := _IN.fullmatch(text):
        return m[1], "in", [x for x in (p.strip() for p in m[2].split(",")) if x]
    for op in _OPERATORS:
        at = text.find(op)
        if at > 0:
            field = text[:at].strip()
            if not _FIELD.fullmatch(field):
                break
            return field, op, text[at + len(op) :].strip()
    raise FilterError(f"malformed filter {clause!r}; forms: {_FORMS}")


def _instant(text: str) -> dt.datetime | None:
    t = text.strip()
    try:
        out = dt.datetime.fromisoformat(t)
    except ValueError:
        return None
    return out.astimezone(dt.UTC).replace(tzinfo=None) if out.tzinfo else out


def _as_utc(c: Column, kind: T.DataType) -> Column:
    """A datetime as timestamp without zone, in UTC and cut to milliseconds."""
    if isinstance(kind, T.TimestampType):
        c = F.to_utc_timestamp(c, F.current_timezone())
    return c.cast("timestamp_ntz")


def _number(c: Column, kind: T.DataType, value: float) -> tuple[Column, Column]:
    """Column and literal of one type, so that scans can still filter by them."""
    if isinstance(kind, INTEGRAL) and value == math.floor(value) and abs(value) < 2**31:
        return c, F.lit(int(value)).cast(kind) if abs(value) < 2**7 or isinstance(kind, (T.IntegerType, T.LongType)) else F.lit(int(value))
    return c.cast("double"), F.lit(value)


def _exact_instant(c: Column, kind: T.DataType, text: str) -> Column:
    """Whether a datetime, cut to milliseconds, has this ISO text; as a range, which scans can filter by."""
    at = _instant(text)
    if at is None or at.strftime("%Y-%m-%dT%H:%M:%S.") + f"{at.microsecond // 1000:03}Z" != text or at.microsecond % 1000:
        return F.lit(False)
    own = _as_utc(c, kind)
    return (own >= F.lit(at).cast("timestamp_ntz")) & (own < F.lit(at + dt.timedelta(milliseconds=1)).cast("timestamp_ntz"))


def same(c: Column, kind: T.DataType, text: str) -> Column:
    """Equality of a value that isn't null with an operand of the language."""
    if isinstance(kind, NUMERIC):
        value = js_number(text)
        if math.isnan(value):
            return F.lit(False)
        a, b = _number(c, kind, value)
        return a == b
    if isinstance(kind, T.BooleanType):
        return c == F.lit(text == "true") if text in ("true", "false") else F.lit(False)
    if isinstance(kind, _DATES):
        return _exact_instant(c, kind, text)
    return js_string(c, kind) == text


def equals(c: Column, kind: T.DataType, text: str) -> Column:
    """Equality with an operand; null equals only the empty one."""
    return c.isNull() | same(c, kind, text) if text == "" else same(c, kind, text)


def differs(c: Column, kind: T.DataType, text: str) -> Column:
    """The opposite of equals(): null differs from all operands but the empty one."""
    return c.isNotNull() & ~same(c, kind, text) if text == "" else c.isNull() | ~same(c, kind, text)


def _member(c: Column, kind: T.DataType, operands: list[str]) -> Column:
    if not operands:
        return F.lit(False)
    if isinstance(kind, INTEGRAL):
        whole = [int(x) for x in operands if re.fullmatch(r"-?(0|[1-9]\d{0,8})", x) and x != "-0"]
        return c.isin(whole) if whole else F.lit(False)
    return js_string(c, kind).isin(operands)


def _ordered(c: Column, kind: T.DataType, op: str, text: str) -> Column:
    if isinstance(kind, NUMERIC):
        value = js_number(text)
        if math.isnan(value):
            return F.lit(False)
        a, b = _number(c, kind, value)
        if isinstance(kind, (T.FloatType, T.DoubleType)) and op in (">", ">="):
            return _COMPARE[op](a, b) & ~F.isnan(a)  # NaN compares with nothing, but sorts above all
        return _COMPARE[op](a, b)
    if isinstance(kind, _DATES):
        at = _instant(text)
        return F.lit(False) if at is None else _COMPARE[op](_as_utc(c, kind), F.lit(at).cast("timestamp_ntz"))
    return _COMPARE[op](js_string(c, kind), F.lit(text))


_COMPARE: dict[str, Callable[[Column, Column], Column]] = {
    ">": lambda a, b: a > b,
    "<": lambda a, b: a < b,
    ">=": lambda a, b: a >= b,
    "<=": lambda a, b: a <= b,
}


def clause_column(df: DataFrame, clause: str | Clause) -> Column:
    """One clause over the columns of df; null counts as false. A field that df lacks is absent in every record."""
    field, op, operand = parse(clause) if isinstance(clause, str) else clause
    kind = type_of(df, field)
    c, kind = (column_of(df, field), kind) if kind is not None else (F.lit(None).cast("string"), T.StringType())
    if op == "present":
        return present(c, kind)
    if op == "empty":
        return ~present(c, kind)
    if op == "in":
        return _member(c, kind, operand)
    if op == "=":
        return equals(c, kind, operand)
    if op == "!=":
        return differs(c, kind, operand)
    if op == "~":
        try:
            re.compile(operand)
        except re.error as e:
            raise FilterError(f"invalid regular expression {operand!r}: {e}") from None
        return js_string(c, kind).rlike(operand)
    return _ordered(c, kind, op, operand)


def predicate(df: DataFrame, clauses: Iterable[str | Clause]) -> Column:
    """All clauses together, never null; without any, true for every record."""
    return reduce(lambda a, b: a & b, (F.coalesce(clause_column(df, c), F.lit(False)) for c in clauses), F.lit(True))


def where(df: DataFrame, clauses: Iterable[str | Clause]) -> DataFrame:
    """Records that satisfy all clauses."""
    parsed = list(clauses)
    return df.where(reduce(lambda a, b: a & b, (clause_column(df, c) for c in parsed))) if parsed else df


def _literal(c: Column, kind: T.DataType, value: Any) -> Column:
    """Strict equality: an integer is no float and no text, and an absent value equals nothing."""
    if value is None:
        return F.lit(False)
    if isinstance(value, bool):
        ok = isinstance(kind, T.BooleanType)
    elif isinstance(value, int):
        ok = isinstance(kind, INTEGRAL)
    elif isinstance(value, float):
        ok = isinstance(kind, (T.FloatType, T.DoubleType))
    elif isinstance(value, str):
        ok = isinstance(kind, T.StringType)
    elif isinstance(value, dt.datetime):
        ok = isinstance(kind, T.TimestampType if value.tzinfo else (T.TimestampNTZType, T.TimestampType))
    elif isinstance(value, dt.date):
        ok = isinstance(kind, T.DateType)
    elif isinstance(value, (list, tuple)):
        if not isinstance(kind, T.ArrayType):
            return F.lit(False)
        alike = reduce(lambda a, b: a & b, (_literal(F.get(c, F.lit(k)), kind.elementType, v) for k, v in enumerate(value)), F.lit(True))
        return (F.size(c) == len(value)) & alike
    else:
        ok = False
    if not ok:
        return F.lit(False)
    lit = F.lit(value).cast("timestamp_ntz") if isinstance(kind, T.TimestampNTZType) else F.lit(value)
    return c == lit


def matching(df: DataFrame, criteria: Mapping[str, Any], body: str | None = None, with_body: bool = True) -> Column:
    """A filter as a mapping of fields to values, nested mappings, Columns or functions of (Column, DataFrame); null counts as false.

    All entries must hold. Nested mappings look into struct columns, and an absent
    struct matches none, not even the empty mapping.
    """
    if body is not None and not with_body and body in criteria:
        raise TypeError(f"a query without bodies can't filter by the body field {body!r}")

    def one(c: Column, kind: T.DataType | None, value: Any) -> Column:
        if isinstance(value, Column):
            return value
        if callable(value):
            return value(c, df)
        if isinstance(value, Mapping):
            if not isinstance(kind, T.StructType):
                return F.lit(False)
            kinds = {f.name: f.dataType for f in kind.fields}
            parts = [one(c.getField(k), kinds[k], v) if k in kinds else one(F.lit(None).cast("string"), T.StringType(), v) for k, v in value.items()]
            return reduce(lambda a, b: a & b, parts, c.isNotNull())
        return F.lit(False) if kind is None else _literal(c, kind, value)

    parts = []
    for field, value in criteria.items():
        kind = type_of(df, field)
        parts.append(one(column_of(df, field) if kind is not None else F.lit(None).cast("string"), kind or T.StringType(), value))
    return reduce(lambda a, b: a & b, parts, F.lit(True))
