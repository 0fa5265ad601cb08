"""Changes between two snapshots of a collection."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.operators.analytics import clamp_limit
from recordloom.operators.patch import json_patch, pointer


def fingerprint(df: DataFrame, exclude: Sequence[str] = ()) -> Column:
    """SHA-256 of a record's fields by name; null fields are absent, so an added empty column changes nothing."""
    fields = sorted(c for c in df.columns if c not in exclude)
    return F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in fields])), 256)


def _sides(old: DataFrame, new: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    skip = (path, "_sheet", "_blob")

    def side(df: DataFrame, other: DataFrame) -> DataFrame:
        blob = F.col("_blob") if "_blob" in df.columns and "_blob" in other.columns else fingerprint(df, skip)
        return df.withColumn("_blob", blob)

    return side(old, new), side(new, old)


def changes(old: DataFrame, new: DataFrame, path: str = "_path", renames: bool = False, similarity: float | None = None) -> DataFrame:
    """(path, old_path, status, old_blob, new_blob) of every difference: added, modified, deleted, and with renames renamed.

    One full outer join on the path over paths and hashes only.  A renamed
    record is an added and a deleted one with the same content; with similarity,
    also pairs whose texts are at least that similar, each record in one pair at
    most, compared within groups of equal length classes.
    """
    a, b = _sides(old, new, path)
    left = a.select(F.col(path).alias("path"), F.col("_blob").alias("old_blob"))
    right = b.select(F.col(path).alias("path"), F.col("_blob").alias("new_blob"))
    joined = left.join(right, "path", "full_outer").where(~F.col("old_blob").eqNullSafe(F.col("new_blob")))
    status = F.when(F.col("old_blob").isNull(), "added").when(F.col("new_blob").isNull(), "deleted").otherwise("modified")
    plain = joined.select("path", F.when(F.col("old_blob").isNotNull(), F.col("path")).alias("old_path"), status.alias("status"), "old_blob", "new_blob")
    if not renames and similarity is None:
        return plain
    pairs = _exact_renames(plain)
    if similarity is not None:
        rest = plain.join(pairs.select(F.col("from").alias("path")), "path", "left_anti").join(pairs.select(F.col("to").alias("path")), "path", "left_anti")
        pairs = pairs.unionByName(_similar_renames(rest, old, new, path, similarity))
    moved = (
        pairs.join(plain.where("status = 'deleted'").select(F.col("path").alias("from"), "old_blob"), "from")
        .join(plain.where("status = 'added'").select(F.col("path").alias("to"), "new_blob"), "to")
        .select(F.col("to").alias("path"), F.col("from").alias("old_path"), F.lit("renamed").alias("status"), "old_blob", "new_blob")
    )
    gone = pairs.select(F.col("from").alias("path"), F.lit("deleted").alias("status")).union(pairs.select("to", F.lit("added")))
    return plain.join(gone, ["path", "status"], "left_anti").unionByName(moved)


def _exact_renames(plain: DataFrame) -> DataFrame:
    """(from, to): deleted and added records of equal content, paired in path order."""
    from pyspark.sql import Window

    gone = plain.where("status = 'deleted'").select(F.col("old_blob").alias("blob"), F.col("path").alias("from"), F.row_number().over(Window.partitionBy("old_blob").orderBy("path")).alias("n"))
    come = plain.where("status = 'added'").select(F.col("new_blob").alias("blob"), F.col("path").alias("to"), F.row_number().over(Window.partitionBy("new_blob").orderBy("path")).alias("n"))
    return gone.join(come, ["blob", "n"]).select("from", "to")


def _similar_renames(rest: DataFrame, old: DataFrame, new: DataFrame, path: str, least: float) -> DataFrame:
    """(from, to): deleted and added records whose texts are similar, best pairs first."""
    fields = sorted(set(old.columns) & set(new.columns) - {path, "_blob", "_sheet"})

    def texts(df: DataFrame, status: str, name: str) -> DataFrame:
        own = rest.where(F.col("status") == status).select(F.col("path").alias(name))
        return own.join(df.select(F.col(path).alias(name), F.to_json(F.struct(*fields)).alias(f"{name}_text")), name)

    # texts of lengths l and k can be at most 2*min/(l+k) similar: only neighbouring classes of lengths are compared
    ratio = (2 - least) / least
    size = lambda c: F.floor(F.log(F.greatest(F.length(c), F.lit(1))) / F.log(F.lit(max(ratio, 1.01)))).cast("int")
    gone = texts(old, "deleted", "from").withColumn("class", size("from_text"))
    come = texts(new, "added", "to").withColumn("class", F.explode(F.array(size("to_text") - 1, size("to_text"), size("to_text") + 1)))

    @F.pandas_udf("double")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, x, y, autojunk=False).ratio() for x, y in zip(a, b, strict=True)])

    scored = gone.join(come, "class").select("from", "to", alike("from_text", "to_text").alias("score")).where(F.col("score") >= least)
    from pyspark.sql import Window

    best = scored.withColumn("a", F.row_number().over(Window.partitionBy("from").orderBy(F.desc("score"), "to"))).withColumn("b", F.row_number().over(Window.partitionBy("to").orderBy(F.desc("score"), "from")))
    return best.where("a = 1 and b = 1").select("from", "to")


def limited(found: DataFrame, limit: object = None) -> DataFrame:
    """The first changes in path order, 1000 unless a limit from 1 to 100000 is given."""
    return found.orderBy("path").limit(clamp_limit(limit, 1000, 100_000))


def totals(found: DataFrame) -> DataFrame:
    """(status, count)."""
    return found.groupBy("status").agg(F.count("*").alias("count"))


def field_changes(old: DataFrame, new: DataFrame, path: str = "_path") -> DataFrame:
    """(path, op, pointer, value) for flat records, without leaving the JVM: a row for each field that differs in a record of both.

    value is the new value as JSON text; null for a removal.
    """
    fields = [c for c in dict.fromkeys([*old.columns, *new.columns]) if c not in (path, "_sheet", "_blob")]
    a = old.select(F.col(path), *[F.col(c).alias(f"a_{c}") for c in fields if c in old.columns])
    b = new.select(F.col(path), *[F.col(c).alias(f"b_{c}") for c in fields if c in new.columns])
    ops = []
    for c in fields:
        x = F.col(f"a_{c}") if c in old.columns else F.lit(None)
        y = F.col(f"b_{c}") if c in new.columns else F.lit(None)
        kind = F.when(x.isNull() & y.isNotNull(), "add").when(x.isNotNull() & y.isNull(), "remove").when(x != y, "replace")
        value = F.get_json_object(F.to_json(F.struct(y.alias("v"))), "$.v")
        ops.append(F.when(kind.isNotNull(), F.struct(kind.alias("op"), F.lit(pointer("", c)).alias("pointer"), value.alias("value"))))
    return a.join(b, path).select(F.col(path).alias("path"), F.inline(F.array_compact(F.array(*ops))))


def with_patches(old: DataFrame, new: DataFrame, path: str = "_path", renames: bool = False, records: bool = False) -> DataFrame:
    """changes() with the RFC 6902 patch of each as JSON text, and with records both sides as JSON text.

    Python sees changed records only.
    """
    found = changes(old, new, path, renames)
    skip = (path, "_sheet", "_blob")

    def texts(df: DataFrame, key: str, name: str) -> DataFrame:
        return df.select(F.col(path).alias(key), F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in skip])).alias(name))

    both = found.join(texts(old, "old_path", "src"), "old_path", "left").join(texts(new, "path", "dst"), "path", "left")
    both = both.withColumn("src", F.when(F.col("status") != "added", F.col("src"))).withColumn("dst", F.when(F.col("status") != "deleted", F.col("dst")))

    @F.pandas_udf(T.StringType())
    def patch(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in parts:
            yield pd.Series([json.dumps(json_patch(json.loads(x) if x else None, json.loads(y) if y else None), separators=(",", ":")) for x, y in zip(a, b, strict=True)])

    out = both.withColumn("patch", patch("src", "dst"))
    kept = ["path", "old_path", "status", "old_blob", "new_blob", "patch"]
    return out.select(*kept, *(["src", "dst"] if records else []))
