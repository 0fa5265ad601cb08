"""Secondary indexes over a key expression, unique or not."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.errors import IndexError_
from recordloom.functions.values import column_of, js_string, type_of

#: A field name, a Column, or a function of the records.
Key = str | Column | Callable[[DataFrame], Column]


def key_column(df: DataFrame, key: Key) -> Column:
    """The key as text; null keys are not in the index."""
    if isinstance(key, str):
        kind = type_of(df, key)
        return F.lit(None).cast("string") if kind is None else js_string(column_of(df, key), kind)
    c = key(df) if callable(key) and not isinstance(key, Column) else key
    kind = df.select(c.alias("k")).schema["k"].dataType
    return js_string(c, kind)


@dataclass
class Index:
    """A declared index; entries() of a snapshot are (key, _path and the record)."""

    name: str
    key: Key
    unique: bool = False
    eager: bool = False


def entries(df: DataFrame, index: Index, body: str | None = None) -> DataFrame:
    """Records with their key in `_key`, without those that have none; the key never sees the body."""
    own = df.drop(body) if body else df
    return own.withColumn("_key", key_column(own, index.key)).where("_key is not null")


def conflicts(df: DataFrame, index: Index, path: str = "_path") -> DataFrame:
    """(key, records, paths): keys that more than one record has, with the first and the last of their paths."""
    found = entries(df, index).groupBy(F.col("_key").alias("key"))
    return found.agg(F.count("*").alias("records"), F.array(F.min(path), F.max(path)).alias("paths")).where("records > 1")


def check_unique(df: DataFrame, index: Index, path: str = "_path") -> None:
    """Raise for the first conflict, naming two of its paths. Counts first, and gathers the paths of conflicts only."""
    keyed = entries(df, index).select("_key", path)
    twice = keyed.groupBy("_key").agg(F.count("*").alias("n"), F.min(path).alias("first"), F.max(path).alias("last")).where("n > 1")
    found = twice.orderBy("_key").head()
    if found:
        raise IndexError_(f"index {index.name!r}: key {found['_key']!r} is shared by {found['first']!r} and {found['last']!r}", "index_unique_conflict", key=found["_key"], paths=[found["first"], found["last"]])


def lookup(df: DataFrame, index: Index, key: str, path: str = "_path") -> DataFrame:
    """Records with this key, in path order; the equality is on the key expression, so it reaches the scan for plain text keys."""
    return df.where(F.coalesce(key_column(df, index.key) == F.lit(key), F.lit(False))).orderBy(path)


def lookup_many(df: DataFrame, index: Index, keys: DataFrame, path: str = "_path") -> DataFrame:
    """keys(key) joined with the records that have them; a key without any has one row of nulls."""
    found = entries(df, index)
    return keys.join(found, keys["key"] == found["_key"], "left").drop("_key")


def write_conflicts(existing: DataFrame, batch: DataFrame, index: Index, path: str = "_path") -> DataFrame:
    """(key, path, owner): rows of a batch whose key a record at another path has, in the batch or the table.

    Records that the batch replaces don't count.
    """
    new = entries(batch, index).select("_key", F.col(path).alias("path"))
    old = entries(existing.join(batch.select(path).distinct(), path, "left_anti"), index).select("_key", F.col(path).alias("owner"))
    others = old.union(new.select("_key", F.col("path").alias("owner")))
    return new.join(others, "_key").where("path <> owner").select(F.col("_key").alias("key"), "path", "owner").distinct()


def define(name: str, key: Key, unique: bool = False, eager: bool = False) -> Index:
    return Index(name, key, unique, eager)


def by_name(indexes: Sequence[Index], name: str) -> Index:
    for x in indexes:
        if x.name == name:
            return x
    raise IndexError_(f"no index {name!r} is defined", "index_not_defined")
