"""Sharding along a Hilbert curve over quantised metadata.

Every dimension is cut at its exact quantiles, found by a distributed running
total over the counts of its values, so only the cut points travel to the tasks.
Cells of the grid are numbered along the Hilbert curve by a state table, and the
curve is cut into runs of equal volume.  A run covers few values of every
dimension, so readers skip most shards whichever of the dimensions they filter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordloom.llm.common import free_name, save

#: Bits of a dimension: 64 steps.
BITS = 6
#: Volume of a shard in characters of text.
SHARD_CHARS = 64 << 20


def running_total(counts: DataFrame, key: str, value: str) -> DataFrame:
    """counts with a column `before`: the sum of value over all smaller keys (null keys first).

    Keys must be distinct.  The table is range-partitioned and written; totals by
    partition are added up (a row for each partition), and running sums stay
    inside partitions.
    """
    spread = save(counts.repartitionByRange(F.col(key).asc_nulls_first()).withColumn("__part", F.spark_partition_id()), "totals")
    parts = spread.groupBy("__part").agg(F.sum(value).alias("__sum"))
    ahead = parts.withColumn("__ahead", F.coalesce(F.sum("__sum").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__sum")
    inside = Window.partitionBy("__part").orderBy(F.col(key).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    return spread.join(ahead, "__part").withColumn("before", F.coalesce(F.sum(value).over(inside), F.lit(0)) + F.col("__ahead")).drop("__part", "__ahead")


def quantile_cuts(df: DataFrame, column: str, bits: int) -> list[tuple[int, object]]:
    """(code, least value) of the codes that occur; a value's code is floor(rows before it * 2^bits / rows). At most 2^bits."""
    counts = df.select(F.col(column).alias("v")).groupBy("v").agg(F.count("*").alias("n"))
    before = running_total(counts, "v", "n")
    total = before.agg(F.sum("n")).first()[0] or 1
    code = F.expr(f"cast(before * {1 << bits} div {total} as int)")
    return [(x.code, x.v) for x in before.where("v is not null").groupBy(code.alias("code")).agg(F.min("v").alias("v")).orderBy("code").collect()]


def quantised(column: F.Column, cuts: list[tuple[int, object]]) -> F.Column:
    """Code of a value by the cut points; null has code 0."""
    if not cuts:
        return F.lit(0)
    values = F.array(*[F.lit(v) for _, v in cuts])
    codes = F.array(*[F.lit(0), *[F.lit(c) for c, _ in cuts]])
    return F.coalesce(F.element_at(codes, F.size(F.filter(values, lambda c: c <= column)) + 1), F.lit(0))


def curve_table(dims: int) -> tuple[list[int], list[int]]:
    """State table of the Hilbert curve: (digit, next state), each at state * 2^dims + corner.

    A state is the entry corner of a cell and the direction in which it is left.
    """
    n, size = dims, 1 << dims

    def rotate(x: int, k: int) -> int:
        k %= n
        return ((x >> k) | (x << (n - k))) & (size - 1)

    def trailing_ones(i: int) -> int:
        return (~i & (i + 1)).bit_length() - 1

    digit, follow = [], []
    for state in range(n * size):
        entry, direction = state % size, state // size
        for corner in range(size):
            gray = rotate(corner ^ entry, direction + 1)
            w = reduce(lambda x, s: x ^ (x >> s), (1, 2, 4, 8), gray)
            first = 0 if w == 0 else ((w - 1) // 2 * 2) ^ (((w - 1) // 2 * 2) >> 1)
            turn = 0 if w == 0 else trailing_ones(w - 1) if w % 2 == 0 else trailing_ones(w)
            digit.append(w)
            follow.append((entry ^ rotate(first, n - (direction + 1) % n)) + size * ((direction + turn % n + 1) % n))
    return digit, follow


def curve_index(codes: list[F.Column], bits: int) -> F.Column:
    """Place along the Hilbert curve of the cell with these codes."""
    n = len(codes)
    digit, follow = curve_table(n)
    digits, follows = F.array(*map(F.lit, digit)), F.array(*map(F.lit, follow))
    point = F.array(*[c.cast("int") for c in codes])

    def step(acc: F.Column, k: F.Column) -> F.Column:
        corner = reduce(lambda a, b: a + b, [F.expr("0"), *[((point[i] / F.pow(F.lit(2), k)).cast("int") % 2) * (1 << i) for i in range(n)]])
        at = (acc["state"] * (1 << n) + corner).cast("int")
        return F.struct(F.get(follows, at).alias("state"), (acc["h"] * (1 << n) + F.get(digits, at)).cast("long").alias("h"))

    start = F.struct(F.lit(0).alias("state"), F.lit(0).cast("long").alias("h"))
    return F.aggregate(F.array(*[F.lit(k) for k in range(bits - 1, -1, -1)]), start, step)["h"]


def shard(
    docs: DataFrame,
    dims: tuple[str, ...] = ("source", "lang", "n_chars"),
    volume: str = "n_chars",
    id_col: str = "doc_id",
    bits: int = BITS,
    shard_volume: int = SHARD_CHARS,
    spread_by: tuple[str, ...] = ("text",),
) -> DataFrame:
    """docs in the order of the curve, one partition (so one file) a shard, with columns `hilbert` and `shard`.

    A shard holds about shard_volume.  A cell that is larger than a shard is cut
    by a digest of the id and of the columns spread_by, so rows of one id or of
    none are spread as well where their texts differ.  The result has one shuffle of whole rows; the
    table of cells that is broadcast has at most 2^(bits * dims) rows whatever
    the size of the data.

    Ids may be of any type.  Null dimensions have code 0, a null volume counts 0,
    and a null id or text is spread like an empty one; a very long text is a row
    like any other.  Rows that repeat in full stay together; rows of one cell are
    ordered by id.  Where docs has columns of the
    names hilbert or shard, the new ones get underscores in front.  An empty
    table gives an empty result.
    """
    hilbert, number = free_name(docs, "hilbert"), free_name(docs, "shard")
    cuts = {d: quantile_cuts(docs, d, bits) for d in dims}
    placed = docs.withColumn(hilbert, curve_index([quantised(docs[d], cuts[d]) for d in dims], bits))
    weight = F.coalesce(F.greatest(F.col(volume).cast("long"), F.lit(0)), F.lit(0)).cast("long")
    cell, size, before = (free_name(docs, x) for x in ("__cell", "__volume", "__before"))
    cells = placed.groupBy(F.col(hilbert).alias(cell)).agg(F.sum(weight).alias(size))
    cells = save(running_total(cells, cell, size).withColumnRenamed("before", before), "cells")
    own = F.concat(*[F.concat(F.coalesce(docs[c].cast("string"), F.lit("")), F.lit("|")) for c in (id_col, *(c for c in spread_by if c in docs.columns))])
    spread = F.conv(F.substring(F.md5(own), 1, 4), 16, 10).cast("long")
    place = F.col(before) + F.shiftright(F.col(size) * spread, 16)
    rows = placed.join(F.broadcast(cells), F.col(hilbert) == F.col(cell)).withColumn(number, F.floor(place / F.lit(shard_volume)).cast("int")).drop(cell, size, before)
    total = cells.agg(F.sum(size)).first()[0] or 0
    return rows.repartitionById(total // shard_volume + 1, number).sortWithinPartitions(number, hilbert, id_col)


def manifest(shards: DataFrame, dims: tuple[str, ...] = ("source", "lang", "n_chars"), number: str = "shard") -> DataFrame:
    """Rows and the least and largest value of every dimension, by shard: what a reader prunes by."""
    ranges = [f(d).alias(f"{name}_{d}") for d in dims for name, f in (("min", F.min), ("max", F.max))]
    return shards.groupBy(number).agg(F.count("*").alias("rows"), *ranges)


def oracle(bits: int = BITS, shard_volume: int = SHARD_CHARS) -> str:
    """The rows of shard() over documents as DuckDB SQL."""
    dims = ("source", "lang", "n_chars")
    digit, follow = curve_table(len(dims))
    codes = ", ".join(
        f"{d}_codes AS (SELECT v, CAST(floor(coalesce(sum(n) OVER (ORDER BY v NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * {1 << bits} / sum(n) OVER ()) AS INT) AS code FROM (SELECT {d} AS v, count(*) AS n FROM documents GROUP BY 1))"
        for d in dims
    )
    steps = f"s0 AS (SELECT d.*, s.code AS x0, l.code AS x1, c.code AS x2, 0 AS state, CAST(0 AS BIGINT) AS h FROM documents d JOIN source_codes s ON d.source IS NOT DISTINCT FROM s.v JOIN lang_codes l ON d.lang IS NOT DISTINCT FROM l.v JOIN n_chars_codes c ON d.n_chars IS NOT DISTINCT FROM c.v)"
    for k, bit in enumerate(range(bits - 1, -1, -1)):
        at = f"(state * 8 + ((x0 >> {bit}) & 1) + ((x1 >> {bit}) & 1) * 2 + ((x2 >> {bit}) & 1) * 4 + 1)"
        steps += f", s{k + 1} AS (SELECT * REPLACE ({follow}[{at}] AS state, h * 8 + {digit}[{at}] AS h) FROM s{k})"
    return f"""
WITH {codes}, {steps},
cells AS (SELECT h, CAST(sum(n_chars) AS BIGINT) AS volume FROM s{bits} GROUP BY h),
totals AS (SELECT h, volume, CAST(coalesce(sum(volume) OVER (ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM cells)
SELECT doc_id, text, lang, source, n_chars, h AS hilbert,
  CAST((before + ((volume * CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '') || '|'), 1, 4) AS BIGINT)) >> 16)) // {shard_volume} AS INT) AS shard
FROM s{bits} JOIN totals USING (h)
"""
