"""RFC 7396 merge patches and RFC 6902 patches, of documents and of tables."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.functions.values import column_of


def merge_patch(target: Any, patch: Any) -> Any:
    """RFC 7396: null removes, mappings merge, all else replaces. Neither argument is changed."""
    if not isinstance(patch, Mapping):
        return patch
    out = dict(target) if isinstance(target, Mapping) else {}
    for k, v in patch.items():
        if v is None:
            out.pop(k, None)
        else:
            out[k] = merge_patch(out.get(k), v)
    return out


def merge_columns(df: DataFrame, patch: Mapping[str, Any], condition: Column | None = None) -> DataFrame:
    """A constant merge patch over the rows that satisfy condition, by column expressions; unknown fields are added."""
    hit = F.lit(True) if condition is None else F.coalesce(condition, F.lit(False))
    kinds = {f.name: f.dataType for f in df.schema.fields}
    out = df.withColumn("__hit", hit)
    for k, v in patch.items():
        if k in kinds:
            out = out.withColumn(k, F.when(F.col("__hit"), _merged(column_of(out, k), kinds[k], v)).otherwise(column_of(out, k)))
        elif v is not None:
            out = out.withColumn(k, F.when(F.col("__hit"), _constant(v)))
    return out.drop("__hit")


def _constant(value: Any) -> Column:
    if isinstance(value, Mapping):
        own = {k: v for k, v in value.items() if v is not None}
        return F.struct(*[_constant(v).alias(k) for k, v in own.items()])
    if isinstance(value, (list, tuple)):
        return F.array(*[_constant(v) for v in value])
    return F.lit(value)


def _merged(c: Column, kind: T.DataType, value: Any) -> Column:
    if value is None:
        return F.lit(None).cast(kind)
    if isinstance(value, Mapping) and isinstance(kind, T.StructType):
        kinds = {f.name: f.dataType for f in kind.fields}
        return F.struct(*[(_merged(c.getField(n), t, value[n]) if n in value else c.getField(n)).alias(n) for n, t in kinds.items()])
    return _constant(value).cast(kind)


def merge_rows(rows: DataFrame, patches: DataFrame, key: Sequence[str], deletes: str = "_delete") -> DataFrame:
    """Rows patched by a table of patches that shares their key: values that are not null replace, fields named in the list column `deletes` go.

    One left join; rows without a patch stay as they are.
    """
    fields = [c for c in patches.columns if c not in key and c != deletes]
    has_deletes = deletes in patches.columns
    p = patches.select(*key, *[F.col(f).alias(f"__{f}") for f in fields], *([F.col(deletes).alias("__deletes")] if has_deletes else []), F.lit(True).alias("__patched"))
    joined = rows.join(p, list(key), "left")
    out = []
    for c in rows.columns:
        new = F.coalesce(F.col(f"__{c}"), F.col(c)) if c in fields else F.col(c)
        if has_deletes and c not in key:
            new = F.when(F.array_contains(F.coalesce(F.col("__deletes"), F.array().cast("array<string>")), c), F.lit(None)).otherwise(new)
        out.append(new.alias(c))
    out += [F.col(f"__{f}").alias(f) for f in fields if f not in rows.columns]
    return joined.select(*out)


# RFC 6902:


def pointer(base: str, token: str | int) -> str:
    """base extended by one token of a JSON pointer."""
    return f"{base}/{str(token).translate({126: '~0', 47: '~1'})}"


def split_pointer(text: str) -> list[str]:
    """Tokens of a JSON pointer."""
    plain = {"~0": "~", "~1": "/"}
    return [re.sub("~[01]", lambda m: plain[m.group()], t) for t in text.split("/")[1:]]


def _same(a: Any, b: Any) -> bool:
    """Equality of scalars: numbers by value, booleans are no numbers, datetimes by their text."""
    if a is None or b is None:
        return a is b
    if isinstance(a, bool) or isinstance(b, bool):
        return isinstance(a, bool) and isinstance(b, bool) and a == b
    if isinstance(a, (int, float)) and isinstance(b, (int, float)):
        return float(a) == float(b) if isinstance(a, float) or isinstance(b, float) else a == b
    if isinstance(a, (dt.date, dt.time)) and isinstance(b, (dt.date, dt.time)):
        return type(a) is type(b) and a.isoformat() == b.isoformat()
    return isinstance(a, str) and isinstance(b, str) and a == b


def json_patch(source: Any, target: Any, at: str = "") -> list[dict]:
    """Operations that turn source into target. Where either is no mapping or list, it is replaced as a whole."""
    if isinstance(source, Mapping) and isinstance(target, Mapping):
        ops = [{"op": "remove", "path": pointer(at, k)} for k in source if k not in target]
        ops += [{"op": "add", "path": pointer(at, k), "value": v} for k, v in target.items() if k not in source]
        for k, v in source.items():
            if k in target:
                ops += json_patch(v, target[k], pointer(at, k))
        return ops
    if isinstance(source, (list, tuple)) and isinstance(target, (list, tuple)):
        return _list_patch(list(source), list(target), at)
    return [] if _same(source, target) else [{"op": "replace", "path": at, "value": target}]


def _list_patch(a: list, b: list, at: str) -> list[dict]:
    """Shortest edit of a list; of equally short ones, the last step is a removal, else an addition, else a replacement.

    A table of costs forward, and a walk back along the choices.
    """
    n, m = len(a), len(b)
    equal = [[not json_patch(x, y) for y in b] for x in a]
    cost = [[0] * (m + 1) for _ in range(n + 1)]
    step = [[""] * (m + 1) for _ in range(n + 1)]
    for i in range(n + 1):
        for j in range(m + 1):
            if i == j == 0:
                continue
            if i and j and equal[i - 1][j - 1]:
                cost[i][j], step[i][j] = cost[i - 1][j - 1], "keep"
                continue
            choices = []
            if i:
                choices.append((cost[i - 1][j], "remove"))
            if j:
                choices.append((cost[i][j - 1], "add"))
            if i and j:
                choices.append((cost[i - 1][j - 1], "replace"))
            best = min(choices, key=lambda x: x[0])
            cost[i][j], step[i][j] = best[0] + 1, best[1]
    edits: list[tuple[str, int, int]] = []
    i, j = n, m
    while i or j:
        kind = step[i][j]
        if kind != "keep":
            edits.append((kind, i, j))
        i, j = i - (kind != "add"), j - (kind != "remove")
    ops: list[dict] = []
    shift = 0
    for kind, i, j in reversed(edits):
        if kind == "remove":
            ops.append({"op": "remove", "path": pointer(at, i - 1 + shift)})
            shift -= 1
        elif kind == "add":
            ops.append({"op": "add", "path": pointer(at, i + shift if i + shift < n + shift else "-"), "value": b[j - 1]})
            shift += 1
        else:
            ops += json_patch(a[i - 1], b[j - 1], pointer(at, i - 1 + shift))
    return ops


def apply_patch(document: Any, ops: Sequence[Mapping]) -> Any:
    """The document after the operations add, remove and replace."""
    import copy

    out = copy.deepcopy(document)
    for op in ops:
        path = split_pointer(op["path"])
        if not path:
            out = copy.deepcopy(op.get("value"))
            continue
        parent = reduce(lambda x, t: x[int(t)] if isinstance(x, list) else x[t], path[:-1], out)
        last = path[-1]
        if isinstance(parent, list):
            if op["op"] == "add":
                parent.insert(len(parent) if last == "-" else int(last), copy.deepcopy(op["value"]))
            elif op["op"] == "remove":
                parent.pop(int(last))
            else:
                parent[int(last)] = copy.deepcopy(op["value"])
        elif op["op"] == "remove":
            del parent[last]
        else:
            parent[last] = copy.deepcopy(op["value"])
    return out
