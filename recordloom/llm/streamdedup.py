"""Exact deduplication as a stateful stream.

A Structured Streaming aggregation keyed by the SHA-256 digest of the text keeps
for every digest, in RocksDB and without expiry, the stable identifier of the
first document that had it, the content locator of that document (file and row)
and a count.  The state never holds text.  Digests with a count above one are
hits: the bytes of their rows, and of next to no others, are compared in full,
and rows are duplicates only where those agree.
"""

from __future__ import annotations

import re
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.llm.common import as_scan, free_name, place, save, scan_roots, sieve, without

_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_CONF = {
    "spark.sql.streaming.stateStore.providerClass": _ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "100",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}
_PLACE = "struct<no_id: boolean, id: bigint, file: string, row: bigint>"


def _order(id_col: str, file: str, row: str) -> F.Column:
    """Documents in the order in which they are preferred: by id, a null id last, then by place."""
    return F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.col(file).alias("file"), F.col(row).alias("row"))


def digest(text: F.Column) -> F.Column:
    """The key of the state."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


def update_state(spark: SparkSession, source: list[tuple[str, str | None]], schema: T.StructType, state_dir: str, id_col: str, text_col: str, max_files: int) -> DataFrame:
    """Feed files that the state has not seen yet through the stream; return the digests so far: (digest, n, first)."""
    began = F.lit(datetime.now(timezone.utc))  # one for a call: of equal texts of a call, the smallest id comes first
    before = {k: spark.conf.get(k, None) for k in _CONF}
    for k, v in _CONF.items():
        spark.conf.set(k, v)
    try:
        parts = []
        for at, glob in source:
            reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
            own = (reader.option("pathGlobFilter", glob) if glob else reader).parquet(at)
            parts.append(
                own.select(F.col(id_col).cast("long").alias("id"), digest(F.col(text_col)).alias("digest"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), began.alias("batch"))
                .where("digest is not null")
            )
        seen = F.min(F.struct("batch", _order("id", "file", "row").alias("document")))
        digests = reduce(DataFrame.union, parts).groupBy("digest").agg(F.count("*").alias("n"), seen.alias("first"))
        stream = (
            digests.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{state_dir}/stream")
            .foreachBatch(lambda df, batch: df.write.mode("overwrite").parquet(f"{state_dir}/digests/batch={batch}"))
            .start()
        )
        stream.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    found = f"digest binary, n bigint, first struct<batch: timestamp, document: {_PLACE}>"
    updates = spark.read.schema(found).parquet(f"{state_dir}/digests") if _exists(spark, f"{state_dir}/digests") else spark.createDataFrame([], found)
    return updates.groupBy("digest").agg(F.max("n").alias("n"), F.min("first").alias("first"))


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", state_dir: str | None = None, max_files: int = 10_000) -> DataFrame:
    """Rows whose text another row had before: (doc_id, duplicate_of, file, row).

    docs should be a plain scan of Parquet files; anything else is first written
    to the shared folder.  Of equal texts, in whatever folders, the row of the
    earliest call stays, within a call the one with the smallest id (a null id
    last), then the first by file and row; so rows that repeat in full lose all but one.
    Texts are equal where all their bytes are: should two texts ever share a
    digest, each has its own survivor.  Null texts are never duplicates; empty
    texts are duplicates of one another; a very long text is a text like any
    other.  Other columns are ignored whatever their names.  An empty table gives
    an empty result.

    With a state_dir that was used before, for the same number of folders, only
    files that are new in them go through the stream, and the decisions made
    before stand.
    """
    spark = docs.sparkSession
    docs = as_scan(docs)
    state = state_dir or place(spark, "dedup-state")
    schema = docs.select(id_col, text_col).schema
    found = update_state(spark, _sources(spark, scan_roots(docs)), schema, state, id_col, text_col, max_files)
    hits = save(found.where("n > 1").select("digest", F.col("first.document").alias("first")), "hits")
    may = sieve(hits.select(F.xxhash64("digest").alias("key")))
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(text_col).cast("binary").alias("bytes"),
        digest(F.col(text_col)).alias("digest"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("row"),
    ).where(may(F.xxhash64("digest")))
    # copies meet in their own task first, so one text sends its bytes once a task however often it stands
    texts = rows.select("digest", "bytes").groupBy("digest", "bytes").agg(F.count("*").alias("n"))
    clashes = save(texts.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest"), "clashes")
    own = _order("id", "file", "row")
    out = rows.select("digest", own.alias("own")).join(hits, "digest").where("not own <=> first").select("digest", "own", F.col("first").alias("kept"))
    if clashes.head(1):
        apart = rows.join(hits.join(clashes, "digest"), "digest").select("digest", "bytes", own.alias("own"), "first")
        kept = apart.groupBy("digest", "bytes").agg(F.min(F.struct((F.col("own") != F.col("first")).alias("later"), "own")).alias("kept"))
        apart = apart.join(kept, ["digest", "bytes"]).select("digest", "own", F.col("kept.own").alias("kept")).where("not own <=> kept")
        out = out.join(clashes, "digest", "left_anti").unionByName(apart)
    return out.select(F.col("own.id").alias("doc_id"), F.col("kept.id").alias("duplicate_of"), F.col("own.file").alias("file"), F.col("own.row").alias("row"))


def _sources(spark: SparkSession, roots: list[str]) -> list[tuple[str, str | None]]:
    """What the stream reads: folders, partitioned ones in one, and files by the folder that they are in and a pattern of their names."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folders: list[str] = []
    files: dict[str, list[str]] = {}
    for root in roots:
        at = jvm.org.apache.hadoop.fs.Path(root)
        if at.getFileSystem(conf).getFileStatus(at).isDirectory():
            folders.append(root)
        else:
            head, _, tail = root.rpartition("/")
            files.setdefault(head, []).append(re.sub(r"([\\{}\[\]*?,])", r"\\\1", tail))
    return [(x, None) for x in folders] + [(x, tails[0] if len(tails) == 1 else "{" + ",".join(tails) + "}") for x, tails in files.items()]


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", state_dir: str | None = None) -> DataFrame:
    """docs without the rows that duplicates() returns, which also says what counts as one; all columns as they are."""
    docs = as_scan(docs)
    file, row = free_name(docs, "__at_file"), free_name(docs, "__at_row")
    gone = save(duplicates(docs, id_col, text_col, state_dir).select(F.col("file").alias(file), F.col("row").alias(row)), "duplicates")
    marked = docs.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(row))
    return without(marked, gone, [file, row]).drop(file, row)
