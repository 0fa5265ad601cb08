"""From the documents table to packed training sequences, in five stages.

Each stage is (name, function); the function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the docs of
the next one.  Counted as part of the subpackage llm.

All stages take an empty table, and give one of the same columns; columns other
than doc_id and text pass through unread, whatever their names, so nulls in them
don't matter; texts of any length are read whole.  What each stage does with
null ids and texts, empty texts, ties and repeats is said at the stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from recordloom.llm import decontam, minhash, nbsvm, packing, streamdedup
from recordloom.llm.common import place


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that both heads of the classifier accept.

    Null texts and texts without a token are rejected, null ids and repeated rows
    judged like others; a quality margin of exactly 0 is kept, a toxicity margin
    of exactly 0 rejected.
    """
    return nbsvm.quality_filter(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set of equal texts: the one of the smallest id, a null id last, then the first by file and row.

    Null texts all stay, of empty texts one does, of rows that repeat in full too.
    """
    return streamdedup.deduplicate(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one of the smallest id, then the first by file and row.

    Rows without an id, a text or a word in it all stay; rows that repeat are
    near duplicates like others.
    """
    return minhash.deduplicate(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item or a paraphrase of one.

    Null and wordless texts stay; rows are judged each by itself, whatever their
    id; items without an id or a word find nothing.
    """
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The plan of training sequences (other columns than those of documents).

    Null ids and texts are in none, an empty text is an end mark, rows that
    repeat are packed each for itself, and of pieces of one size those of smaller
    ids come first.
    """
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality),
    ("exact_dedup", exact),
    ("minhash_near_dedup", near),
    ("benchmark_decontamination", decontaminate),
    ("best_fit_packing", pack),
]

#: SQL can express neither the classifier nor the search; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; what each one returns lies in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = place(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
