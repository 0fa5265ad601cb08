"""Token ids of whole columns, and their binary form as ORC."""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm import text as T
from recordloom.llm.common import place, tidy

#: Rank file of a byte-level BPE; a parameter of every operator that tokenises.
VOCABULARY = os.environ.get("RECORDLOOM_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Pre-tokeniser of that vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of a rank file at most; it is sent to every task.
VOCABULARY_BYTES = 64 << 20
_loaded: dict[str, Tokenizer] = {}


class Tokenizer:
    """A byte-level BPE over whole columns. Strings of special tokens in a text are ordinary text."""

    def __init__(self, ranks: bytes):
        import tiktoken

        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})

    def _each(self, column: pa.Array) -> Iterator[np.ndarray]:
        encode = self.encoding.encode_to_numpy
        for text in column:
            yield encode(text.as_py(), disallowed_special=())

    def count(self, column: pa.Array) -> np.ndarray:
        """Number of tokens of every text."""
        return np.fromiter((len(x) for x in self._each(column)), dtype=np.int64, count=len(column))

    def encode(self, column: pa.Array) -> pa.ListArray:
        """Token ids of every text."""
        parts = [np.empty(0, dtype=np.int32), *(x.view(np.int32) for x in self._each(column))]
        at = np.cumsum([len(x) for x in parts])
        return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(np.concatenate(parts)))


def rank_file(spark: SparkSession, path: str) -> bytes:
    """The bytes of a rank file, which only the driver has to reach: a local file of it or a file of any Hadoop file system."""
    if os.path.exists(path):
        with open(path, "rb") as f:
            ranks = f.read()
    else:
        ranks = bytes(spark.read.format("binaryFile").load(path).first().content)
    if len(ranks) > VOCABULARY_BYTES:
        raise ValueError(f"{path} has over {VOCABULARY_BYTES} bytes")
    return ranks


def tokenizer(ranks: bytes) -> Tokenizer:
    """The tokenizer of this process for a rank file."""
    key = hashlib.sha256(ranks).hexdigest()
    if key not in _loaded:
        _loaded[key] = Tokenizer(ranks)
    return _loaded[key]


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, salt: Column | None = None) -> DataFrame:
    """(doc_id, n_tokens) of every row, and the BIGINT salt where one is given.

    A null or empty text has 0 tokens, a null id stays null, repeated rows
    repeat, and a very long text is encoded whole.  Other columns are ignored
    whatever their names.  An empty table gives an empty result.
    """
    held = docs.sparkSession.sparkContext.broadcast(rank_file(docs.sparkSession, vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(held.value)
        for batch in batches:
            n = own.count(T.as_large(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), *batch.columns[2:]], names=["doc_id", "n_tokens", *batch.schema.names[2:]])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *([] if salt is None else [salt.cast("long").alias("salt")]))
    return own.mapInArrow(tidy(run), "doc_id long, n_tokens long" + ("" if salt is None else ", salt long"))


def token_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, token_ids) of every row.

    A null text has null ids and 0 tokens, an empty text no ids; a null id stays
    null; repeated rows repeat; a very long text is encoded whole.  Other columns
    are ignored whatever their names.  An empty table gives an empty result.
    """
    held = docs.sparkSession.sparkContext.broadcast(rank_file(docs.sparkSession, vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(held.value)
        for batch in batches:
            column = T.as_large(batch.column(1))
            for i, j in T.pieces(column, 4 * T.SLICE_BYTES):
                ids = own.encode(column.slice(i, j - i))
                n = pa.array(np.diff(ids.offsets.to_numpy()).astype(np.int64))
                null = batch.column(1).slice(i, j - i).is_null().to_numpy(zero_copy_only=False)
                if null.any():
                    ids = pa.ListArray.from_arrays(ids.offsets, ids.values, mask=pa.array(null))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), n, ids], names=["doc_id", "n_tokens", "token_ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, token_ids array<int>")


def write_orc(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, stripe_bytes: int = 64 << 20, index_rows: int = 1000, false_positives: float = 0.01) -> DataFrame:
    """Write token_ids() as ORC and return the table read from it.

    Integers are run-length encoded (version 2) in stripes of stripe_bytes, which
    readers split on; every index_rows rows have an entry in the row index with
    the least and largest value of each column, and a Bloom filter of the
    document ids.  So a search for some ids reads the footers, skips stripes and
    row groups by their statistics and filters, and decodes the rest.
    The write has no shuffle: each task writes the rows that it reads.

    Nulls, empty and long texts, repeats and other columns are as in token_ids();
    an empty table gives an empty table.
    """
    (
        token_ids(docs, id_col, text_col, vocabulary)
        .write.option("compression", "zstd").option("orc.stripe.size", stripe_bytes).option("orc.row.index.stride", index_rows)
        .option("orc.create.index", "true").option("orc.encoding.strategy", "COMPRESSION")
        .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", false_positives).orc(path)
    )
    return docs.sparkSession.read.schema("doc_id long, n_tokens long, token_ids array<int>").orc(path)


def tokenised(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """write_orc() to a new table in the shared folder, with the same rows whatever the table holds."""
    return write_orc(docs, place(docs.sparkSession, "tokens"), vocabulary=vocabulary)
