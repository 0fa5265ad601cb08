"""Facets, distinct values, counts, order, limits, projection and inference."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.errors import SheetError
from recordloom.functions.values import INTEGRAL, NUMERIC, body_size, column_of, scalar_string, truncated, type_of
from recordloom.operators.filters import Clause, predicate, where


def facets(df: DataFrame, field: str, filters: Iterable[str | Clause] = (), ordered: bool = True) -> DataFrame:
    """(value, count) of a field over all records that satisfy the filters; largest first, then by value.

    Null, absent and empty texts share the value ''. Keys are grouped in their own
    type first, so that text is made once for each distinct value.
    """
    rows = where(df, filters)
    kind = type_of(rows, field)
    if kind is None:
        counts = rows.groupBy().agg(F.count("*").alias("count")).select(F.lit("").alias("value"), "count").where("count > 0")
    elif isinstance(kind, (T.StringType, T.MapType)):
        counts = rows.groupBy(scalar_string(column_of(rows, field), kind).alias("value")).agg(F.count("*").alias("count"))
    else:
        own = rows.groupBy(column_of(rows, field).alias("key")).agg(F.count("*").alias("n"))
        counts = own.groupBy(scalar_string(F.col("key"), kind).alias("value")).agg(F.sum("n").alias("count"))
    return counts.orderBy(F.desc("count"), "value") if ordered else counts


def distinct(df: DataFrame, field: str, filters: Iterable[str | Clause] = ()) -> DataFrame:
    """(value, count) of a field, by value."""
    return facets(df, field, filters, ordered=False).orderBy("value")


def cardinality(df: DataFrame, field: str, filters: Iterable[str | Clause] = ()) -> DataFrame:
    """(distinct, total): number of values of a field and of records."""
    return facets(df, field, filters, ordered=False).agg(F.count("*").alias("distinct"), F.coalesce(F.sum("count"), F.lit(0)).alias("total"))


def count(df: DataFrame, filters: Iterable[str | Clause] = ()) -> DataFrame:
    """(count, of): records that satisfy the filters, of all; in one pass."""
    clauses = list(filters)
    if not clauses:
        return df.agg(F.count("*").alias("count")).withColumn("of", F.col("count"))
    return df.agg(F.count_if(predicate(df, clauses)).alias("count"), F.count("*").alias("of"))


def sort_keys(df: DataFrame, field: str, desc: bool = False, ties: Sequence[str] = ()) -> list[Column]:
    """Sort columns: numbers and datetimes by value, all else by text; nulls last in both directions."""
    kind = type_of(df, field)
    if kind is None:
        return [F.col(t) for t in ties]
    c = column_of(df, field)
    key = c if isinstance(kind, (*NUMERIC, T.DateType, T.TimestampType, T.TimestampNTZType, T.StringType)) else scalar_string(c, kind)
    if not isinstance(kind, (*NUMERIC, T.DateType, T.TimestampType, T.TimestampNTZType, T.StringType)):
        key = F.when(c.isNotNull(), key)
    return [key.desc_nulls_last() if desc else key.asc_nulls_last(), *[F.col(t) for t in ties]]


def clamp_limit(value: object, default: int = 100, most: int = 10_000) -> int:
    """A limit from a request: between 1 and most; anything that is no number, or 0, is the default."""
    try:
        n = int(float(str(value)))
    except (TypeError, ValueError, OverflowError):
        return default
    return max(1, min(n, most)) if n else default


def query(df: DataFrame, filters: Iterable[str | Clause] = (), sort: str | None = None, desc: bool = False, limit: object = None, fields: Sequence[str] | None = None, key: Sequence[str] = ("_path",)) -> DataFrame:
    """Filter, order, limit and project; ties are in the order of key. A sort with a limit is a top-k."""
    rows = where(df, filters)
    ties = [k for k in key if k in rows.columns]
    if sort is not None:
        rows = rows.orderBy(*sort_keys(rows, sort, desc, ties))
    elif ties:
        rows = rows.orderBy(*ties)
    if limit is not None:
        rows = rows.limit(clamp_limit(limit))
    return project(rows, fields) if fields is not None else rows


def first(df: DataFrame, filters: Iterable[str | Clause] = (), key: Sequence[str] = ("_path",)) -> DataFrame:
    """The first match in path order, or nothing."""
    rows = where(df, filters)
    return rows.orderBy(*[k for k in key if k in rows.columns]).limit(1)


def shown_of_total(df: DataFrame, filters: Iterable[str | Clause], limit: object) -> DataFrame:
    """(shown, total) of a limited query."""
    n = clamp_limit(limit)
    return count(df, filters).select(F.least(F.col("count"), F.lit(n).cast("bigint")).alias("shown"), F.col("count").alias("total"))


def project(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """The fields in this order; a field that df lacks is left out."""
    return df.select(*[column_of(df, f) for f in dict.fromkeys(fields) if type_of(df, f) is not None])


def default_fields(template_fields: Sequence[str], schema: dict | None, markdown: bool = False, title: str | None = "title", most: int = 4) -> list[str]:
    """Columns to show where none are asked for: the template's, then scalar properties, up to `most`."""
    if markdown:
        return list(dict.fromkeys([*template_fields, *([title] if title else []), "body_size"]))[:most]
    out = list(dict.fromkeys(template_fields))
    for name, prop in ((schema or {}).get("properties") or {}).items():
        if len(out) >= most:
            break
        if name not in out and isinstance(prop, dict) and prop.get("type") in ("string", "integer", "number", "boolean"):
            out.append(name)
    return out


def with_extras(fields: Sequence[str], extras: Sequence[str]) -> list[str]:
    """fields and then those of extras that are new."""
    return list(dict.fromkeys([*fields, *extras]))


def markdown_columns(df: DataFrame, body: str, title: str = "title") -> DataFrame:
    """df without its body but with its size in bytes, and with the title cut to 60 characters."""
    out = df.withColumn("body_size", body_size(column_of(df, body))).drop(body)
    return out.withColumn(title, truncated(F.col(title), 60)) if title in out.columns else out


def json_type(kind: T.DataType) -> str:
    """JSON Schema type of a column type; datetimes are strings."""
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, INTEGRAL):
        return "integer"
    if isinstance(kind, NUMERIC):
        return "number"
    if isinstance(kind, T.ArrayType):
        return "array"
    if isinstance(kind, (T.StructType, T.MapType)):
        return "object"
    return "string"


def field_statistics(df: DataFrame) -> DataFrame:
    """(field, type, present, records, minimum, maximum, whole) of every field, in one pass over the table.

    minimum and maximum are of numbers only; whole tells whether all values of a
    number are whole.
    """
    aggregates = [F.count("*").alias("records")]
    for k, f in enumerate(df.schema.fields):
        c = column_of(df, f.name)
        aggregates.append(F.count(c).alias(f"present{k}"))
        if isinstance(f.dataType, NUMERIC):
            d = c.cast("double")
            aggregates += [F.min(d).alias(f"min{k}"), F.max(d).alias(f"max{k}"), F.bool_and(d == F.floor(d)).alias(f"whole{k}")]
        if isinstance(f.dataType, NUMERIC) and not isinstance(f.dataType, INTEGRAL):
            aggregates.append(F.bool_or(c == F.floor(c)).alias(f"some{k}"))
    total = df.agg(*aggregates)
    rows = []
    for k, f in enumerate(df.schema.fields):
        number = isinstance(f.dataType, NUMERIC)
        rows.append(
            F.struct(
                F.lit(f.name).alias("field"),
                F.lit(json_type(f.dataType)).alias("type"),
                F.col(f"present{k}").alias("present"),
                F.col("records"),
                (F.col(f"min{k}") if number else F.lit(None).cast("double")).alias("minimum"),
                (F.col(f"max{k}") if number else F.lit(None).cast("double")).alias("maximum"),
                (F.col(f"whole{k}") if number else F.lit(None).cast("boolean")).alias("whole"),
                (F.col(f"some{k}") if number and not isinstance(f.dataType, INTEGRAL) else F.lit(None).cast("boolean")).alias("some_whole"),
            )
        )
    return total.select(F.inline(F.array(*rows)))


def infer(df: DataFrame) -> dict:
    """A JSON Schema of the records: types, item types, ranges of numbers, and as required what all records have."""
    rows = field_statistics(df).collect()
    if not rows or not rows[0].records:
        raise SheetError("no records to infer from", "no_records")
    kinds = {f.name: f.dataType for f in df.schema.fields}
    properties = {}
    for r in rows:
        if not r.present:
            continue
        if r.type == "number":
            kind: str | list[str] = "integer" if r.whole else ["integer", "number"] if r.some_whole else "number"
        else:
            kind = r.type
        prop: dict = {"type": kind}
        if isinstance(kinds[r.field], T.ArrayType):
            prop["items"] = {"type": json_type(kinds[r.field].elementType)}
        if r.minimum is not None:
            whole = r.type == "integer" or r.whole
            prop |= {"minimum": int(r.minimum) if whole else r.minimum, "maximum": int(r.maximum) if whole else r.maximum}
        properties[r.field] = prop
    return {"type": "object", "required": sorted(r.field for r in rows if r.present == r.records), "properties": properties}
