"""String, number and presence rules of record values, as Columns.

Values compare and group by the text that ECMAScript gives them: 3.0 is "3",
1e21 is "1e+21", true is "true", a list joins its elements with commas.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def type_of(df: DataFrame, field: str) -> T.DataType | None:
    """Type of a column of df, or None; a field is a flat name, dots included."""
    for f in df.schema.fields:
        if f.name == field:
            return f.dataType
    return None


def column_of(df: DataFrame, field: str) -> Column:
    """The column with exactly this name."""
    return df["`" + field.replace("`", "``") + "`"]


def double_text(c: Column) -> Column:
    """Text of a double: plain decimals from 1e-6 to 1e21, exponents beyond."""
    java = F.abs(c).cast("string")
    mantissa = F.regexp_replace(F.substring_index(java, "E", 1), r"\.0$", "")
    digits = F.regexp_replace(mantissa, r"\.", "")
    power = F.substring_index(java, "E", -1).cast("int")
    size = F.length(digits)
    spread = (
        F.when((power >= 0) & (power < 21) & (size <= power + 1), F.rpad(digits, power + 1, "0"))
        .when((power >= 0) & (power < 21), F.concat(F.substring(digits, F.lit(1), power + 1), F.lit("."), F.substring(digits, power + 2, size)))
        .when((power < 0) & (power >= -6), F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits))
        .otherwise(F.concat(mantissa, F.when(power > 0, F.lit("e+")).otherwise(F.lit("e-")), F.abs(power).cast("string")))
    )
    plain = F.when(F.instr(java, "E") > 0, spread).otherwise(F.regexp_replace(java, r"\.0$", ""))
    whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
    return (
        F.when(F.isnan(c), F.lit("NaN"))
        .when(F.abs(c) == float("inf"), F.when(c > 0, F.lit("Infinity")).otherwise(F.lit("-Infinity")))
        .when(whole, F.when(whole, c).cast("bigint").cast("string"))
        .otherwise(F.concat(F.when(c < 0, F.lit("-")).otherwise(F.lit("")), plain))
    )


def iso_text(c: Column, kind: T.DataType) -> Column:
    """ISO text of a datetime with milliseconds, in UTC."""
    if isinstance(kind, T.DateType):
        return F.concat(F.date_format(c, "yyyy-MM-dd"), F.lit("T00:00:00.000Z"))
    if isinstance(kind, T.TimestampType):
        c = F.to_utc_timestamp(c, F.current_timezone())
    return F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z"))


def js_string(c: Column, kind: T.DataType) -> Column:
    """Text of a value of this type; null stays null."""
    if isinstance(kind, T.StringType):
        return c
    if isinstance(kind, T.FloatType):
        return double_text(c.cast("double"))
    if isinstance(kind, T.DoubleType):
        return double_text(c)
    if isinstance(kind, T.DecimalType):
        return double_text(c.cast("double"))
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return iso_text(c, kind)
    if isinstance(kind, T.ArrayType):
        return F.array_join(F.transform(c, lambda x: F.coalesce(js_string(x, kind.elementType), F.lit(""))), ",")
    if isinstance(kind, (T.StructType, T.MapType)):
        return F.when(c.isNotNull(), F.lit("[object Object]"))
    return c.cast("string")


def scalar_string(c: Column, kind: T.DataType) -> Column:
    """js_string with the empty text for null: the key of facets and memberships."""
    return F.coalesce(js_string(c, kind), F.lit(""))


def js_number(text: str) -> float:
    """The number that a literal stands for: blank is 0, 0x/0o/0b prefixes count, anything else not a number is NaN."""
    t = text.strip()
    if not t:
        return 0.0
    if re.fullmatch(r"0[xX][0-9a-fA-F]+|0[oO][0-7]+|0[bB][01]+", t):
        return float(int(t, 0))
    if re.fullmatch(r"[+-]?Infinity", t):
        return math.inf if t[0] != "-" else -math.inf
    if re.fullmatch(r"[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?)", t):
        return float(t)
    return math.nan


def present(c: Column, kind: T.DataType) -> Column:
    """Not null, not the empty text, not an empty list. 0, false and an empty table are present."""
    out = c.isNotNull()
    if isinstance(kind, T.StringType):
        return out & (c != "")
    if isinstance(kind, T.ArrayType):
        return out & (F.size(c) > 0)
    return out


def display(c: Column, kind: T.DataType) -> Column:
    """Text for people: null is empty."""
    return scalar_string(c, kind)


def truncated(c: Column, most: int) -> Column:
    """Texts of more than `most` characters end in an ellipsis."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 1), F.lit("…"))).otherwise(c)


def preview(c: Column, most: int) -> Column:
    """The beginning of a text with a note of its whole length."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("… (truncated, "), F.length(c).cast("string"), F.lit(" chars total)"))).otherwise(c)


def body_size(c: Column) -> Column:
    """Bytes of a text in UTF-8."""
    return F.octet_length(F.coalesce(c, F.lit(""))).cast("bigint")


def blob_hash(c: Column) -> Column:
    """Content hash of a text as git computes it for a blob."""
    return F.sha1(F.concat(F.encode(F.concat(F.lit("blob "), F.octet_length(c).cast("string")), "UTF-8"), F.unhex(F.lit("00")), F.encode(c, "UTF-8")))


def first_h1(body: Column) -> Column:
    """Text of the first level-one ATX heading, trimmed; null without one."""
    found = F.regexp_extract(body, r"(?md)^# ([^\n\r]*[^\n\r\t ]|[\t ])[\t ]*+\r?$", 1)
    return F.when(found != "", found)


def rewrite_h1(body: Column, title: Column) -> Column:
    """body with its first level-one heading replaced by title, or with one put in front."""
    line = F.concat(F.lit("# "), title)
    start = F.regexp_instr(body, F.lit(r"(?md)^# [^\r\n]+"))
    length = F.length(F.regexp_extract(body, r"(?md)^# [^\r\n]+", 0))
    changed = F.concat(F.substring(body, F.lit(1), start - 1), line, F.substring(body, start + length, F.length(body)))
    return F.when(start > 0, changed).otherwise(F.concat(line, F.lit("\n\n"), body))
