"""Shared storage, lineage cuts and connected components."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a temporary one where it is unset and Spark is local (tests)."""
    conf = spark.sparkContext.getConf()
    at = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="recordloom-")
        spark.conf.set("spark.checkpoint.dir", at)
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def place(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Rows that Python gets at once while a table is written: few, since texts may be long.
_BATCH = ("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def save(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path, before = place(spark, name), spark.conf.get(_BATCH[0], None)
    spark.conf.set(*_BATCH)
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.unset(_BATCH[0]) if before is None else spark.conf.set(_BATCH[0], before)
    return spark.read.schema(df.schema).parquet(path)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The step of mapInArrow, giving memory back to the system at the end of every task.

    Python workers wait for other tasks, and free memory that Arrow and the C
    library hold back counts against the executor meanwhile.
    """

    def tidied(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
            if trim:
                trim(0)

    return tidied


def drop(spark: SparkSession, path: str) -> None:
    """Remove a table that is no longer needed."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def scan_roots(df: DataFrame) -> list[str]:
    """The files and folders that df reads if it is nothing but a scan of Parquet files without options, else none."""
    plan = df._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() != "LogicalRelation":
        return []
    relation = plan.relation()
    if relation.getClass().getSimpleName() != "HadoopFsRelation" or not relation.fileFormat().toString().startswith("Parquet"):
        return []
    names = relation.options().keysIterator()
    while names.hasNext():
        if names.next().lower() not in ("path", "paths"):
            return []
    roots = relation.location().rootPaths()
    return [roots.apply(k).toString() for k in range(roots.size())]


def as_scan(docs: DataFrame) -> DataFrame:
    """docs as a scan of files; written to the shared folder first where it is anything else."""
    return docs if scan_roots(docs) else save(docs, "documents")


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores in front until df has no such column (names compare without case)."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = "_" + name
    return name


#: Bits of a sieve at most: 64 MB.
SIEVE_BITS = 1 << 29
_LIMITS = ("spark.sql.optimizer.runtime.bloomFilter.maxNumBits", "spark.sql.optimizer.runtime.bloomFilter.maxNumItems")


def sieve(keys: DataFrame) -> Callable[[Column], Column]:
    """A test on BIGINT columns that is true for every value of the only column of keys, and false for most others.

    A Bloom filter of ten bits a key and SIEVE_BITS at most, whatever the number
    of keys, so what travels to the tasks is bounded; with more keys it lets more
    through, so it only spares work and never decides.  keys should be a table
    that is read from files.
    """
    n = keys.count()
    if not n:
        return lambda column: F.lit(False)
    spark = keys.sparkSession
    jvm, name = spark.sparkContext._jvm, keys.columns[0]
    bits = min(SIEVE_BITS, max(1 << 10, 10 * n))
    before = {k: spark.conf.get(k, None) for k in _LIMITS}
    try:
        for k in _LIMITS:
            spark.conf.set(k, str(max(bits, n)))
        made = keys.coalesce(32)._jdf.stat().bloomFilter(name, n, bits)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = jvm.java.io.ByteArrayOutputStream()
    made.writeTo(out)
    held = spark.createDataFrame(pa.table({"sieve": pa.array([bytes(out.toByteArray())], pa.binary())}))  # rows of Python objects would start workers of another kind
    expressions = jvm.org.apache.spark.sql.classic.ExpressionUtils

    def test(column: Column) -> Column:
        may = jvm.org.apache.spark.sql.catalyst.expressions.BloomFilterMightContain(expressions.expression(held.scalar()._jc), expressions.expression(column._jc))
        return F.coalesce(Column(expressions.column(may)), F.lit(False))

    return test


def without(rows: DataFrame, gone: DataFrame, on: list[str]) -> DataFrame:
    """rows but for those whose columns `on` are a row of gone; gone is read from files.

    Rows that a sieve rules out stay where they are; only the others are shuffled.
    """
    key = F.xxhash64(*on)
    may = sieve(gone.select(key.alias("key")))(key)
    return rows.where(~may).unionByName(rows.where(may).join(gone.select(*on), on, "left_anti"))


def union_find(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest node of its component) for the undirected edges (u, v)."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        la, lb = label[a], label[b]
        differ = la != lb
        if not differ.any():
            return nodes, nodes[label]
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up


def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace the edges (u, v) of one partition by a star per component; exact, and never more edges than nodes."""
    u, v, held = [], [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        u.append(batch.column(0).to_numpy(zero_copy_only=False))
        v.append(batch.column(1).to_numpy(zero_copy_only=False))
        held += batch.num_rows
        if held > 2_000_000:
            n, r = union_find(np.concatenate(u), np.concatenate(v))
            keep = n != r
            u, v, held = [n[keep]], [r[keep]], 0
    if u:
        n, r = union_find(np.concatenate(u), np.concatenate(v))
        keep = n != r
        yield pa.RecordBatch.from_arrays([pa.array(n[keep]), pa.array(r[keep])], names=["u", "v"])


def connected_components(edges: DataFrame, single_task_edges: int = 4_000_000, stars: bool = False) -> DataFrame:
    """Components of an undirected graph: (node, component), component being its smallest node.

    edges has two BIGINT columns; loops and repeats are allowed, rows with a null
    are ignored, and only nodes that have an edge to another node are returned.
    Partitions first shrink their own edges to stars, unless they are that
    already (stars): edges that come from a Python step would need a second
    Python worker in the same task.  What is left is finished
    in one task where it has at most single_task_edges rows (measured, not
    guessed); beyond that, alternating large-star and small-star rounds run as
    joins, each round written to the shared folder in place of the one before,
    until it is small enough or nothing changes.  Both ways give the same exact result.
    """
    spark = edges.sparkSession
    a, b = edges.columns[:2]
    pairs = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u is not null and v is not null and u <> v")
    pairs = save(pairs if stars else pairs.mapInArrow(tidy(contract), "u long, v long"), "edges")
    before = None
    while True:
        n, digest = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if n <= single_task_edges:
            break
        if before == (n, digest):
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        before = (n, digest)
        both = pairs.union(pairs.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct()
        smaller = save(small.mapInArrow(tidy(contract), "u long, v long"), "edges")
        drop(spark, scan_roots(pairs)[0])
        pairs = smaller

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(x.column(0).to_numpy(zero_copy_only=False), x.column(1).to_numpy(zero_copy_only=False)) for x in batches if x.num_rows]
        if got:
            node, root = union_find(np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got]))
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], names=["node", "component"])

    return pairs.coalesce(1).mapInArrow(tidy(finish), "node long, component long")
