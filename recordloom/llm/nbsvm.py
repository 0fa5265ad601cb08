"""Quality and toxicity classifiers: Naive Bayes support vectors.

A text is the set of its hashed word unigrams and bigrams and of the unigrams
and bigrams of its token shapes (letters as a or A, digits as 9, repeats
collapsed).  Every indicator is scaled by the log of the ratio of its smoothed
document frequencies in the two classes, and a linear hinge-loss model is fitted
on the scaled indicators by dual coordinate descent.  The frequencies are
counted over all labelled documents; only the fit uses a bounded sample of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from recordloom.llm import text as T
from recordloom.llm.common import free_name, save, sieve, tidy

#: Buckets of hashed features; the lower half are words, the upper half all others.
BUCKETS = 1 << 18
_CHUNKS = 16

_SHAPE = np.arange(256, dtype=np.uint8)
for _b in range(256):
    _c = chr(_b)
    _SHAPE[_b] = ord("a") if _b >= 0x80 or "a" <= _c <= "z" else ord("A") if "A" <= _c <= "Z" else ord("9") if _c.isdigit() else _b
_SPACE = T._IS_SPACE


@dataclass(frozen=True)
class Params:
    """sample_per_class bounds the labelled rows of each (quality, toxic) class that the fit sees."""

    sample_per_class: int = 2500
    alpha: float = 1.0
    least_z: float = 3.0
    c: float = 1.0
    epochs: int = 30
    mix: float = 0.75


def _shape_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shapes of the tokens between white space."""
    data, offsets = T.buffers(column)
    if not len(data):
        return np.empty(0, dtype=np.uint64), np.zeros(len(column) + 1, dtype=np.int64)
    if len(data) > 2 * T.SLICE_BYTES and len(column) == 1:
        parts = [_shape_hashes(pa.array([data[i:j].tobytes().decode("utf-8", "replace")], pa.large_string()))[0] for i, j in T._cut(data, ~_SPACE)]
        out = np.concatenate(parts)
        return out, np.array([0, len(out)])
    code = _SHAPE[data]
    keep = np.empty(len(code), dtype=bool)
    keep[0] = True
    np.not_equal(code[1:], code[:-1], out=keep[1:])
    first = offsets[:-1][offsets[:-1] < len(code)]
    keep[first] = True
    short = code[keep]
    at = np.concatenate([[0], np.cumsum(keep)])[offsets]
    starts, ends = T._split(~_SPACE[short], at)
    h = T.span_hashes(short, starts, ends)
    return h, np.searchsorted(starts, at)


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature buckets of every text (uint32), and the n+1 offsets."""
    h, at = T.word_hashes(column)
    s, sat = _shape_hashes(column)
    half = np.uint64(BUCKETS // 2)
    parts = [
        (h % half, at),
        *[(x % half + half, xat) for x, xat in (_bigrams(h, at), (T.mix(s + np.uint64(7)), sat), _bigrams(T.mix(s + np.uint64(9)), sat))],
    ]
    n = len(at) - 1
    row = np.concatenate([np.repeat(np.arange(n, dtype=np.uint64), np.diff(a)) for _, a in parts])
    key = (row << np.uint64(20)) | np.concatenate([v for v, _ in parts])
    key.sort()
    key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
    return (key & np.uint64((1 << 20) - 1)).astype(np.uint32), np.searchsorted(key, np.arange(n + 1, dtype=np.uint64) << np.uint64(20))


def _bigrams(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the pairs of neighbours inside one text."""
    if len(h) < 2:
        return h[:0], np.zeros_like(at)
    with np.errstate(over="ignore"):
        pair = T.mix(h[:-1] * np.uint64(3) + h[1:])
    inside = np.ones(len(h), dtype=bool)
    last = at[1:][np.diff(at) > 0] - 1
    inside[last] = False
    return pair[inside[:-1]], np.concatenate([[0], np.cumsum(inside)])[at]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, quality, toxic, sampled) to counts by chunk of buckets, and the features of sampled rows."""
    counts = np.zeros((4, BUCKETS), dtype=np.int32)
    totals = np.zeros(4, dtype=np.int64)
    names = ["chunk", "quality", "toxic", "payload"]
    seen = False
    for batch in batches:
        column = T.as_large(batch.column("text"))
        quality = batch.column("quality").fill_null(-1).to_numpy(zero_copy_only=False)
        toxic = batch.column("toxic").fill_null(-1).to_numpy(zero_copy_only=False)
        sampled = batch.column("sampled").to_numpy(zero_copy_only=False)
        for i, j in T.pieces(column):
            seen = True
            f, at = features(column.slice(i, j - i))
            row = np.repeat(np.arange(i, j), np.diff(at))
            for k, mask in enumerate((quality == 0, quality == 1, toxic == 0, toxic == 1)):
                counts[k] += np.bincount(f[mask[row]], minlength=BUCKETS).astype(np.int32)
                totals[k] += int(mask[i:j].sum())
            own = np.flatnonzero(sampled[i:j])
            if len(own):
                blobs = pa.array([f[at[x] : at[x + 1]].tobytes() for x in own], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), -2, np.int32)), pa.array(quality[i:j][own].astype(np.int32)), pa.array(toxic[i:j][own].astype(np.int32)), blobs], names=names)
    if seen:
        size = BUCKETS // _CHUNKS
        blobs = [counts[:, k * size : (k + 1) * size].tobytes() for k in range(_CHUNKS)] + [totals.astype(np.int32).tobytes()]
        ids = pa.array(np.array([*range(_CHUNKS), -1], dtype=np.int32))
        none = pa.array(np.full(_CHUNKS + 1, -1, np.int32))
        yield pa.RecordBatch.from_arrays([ids, none, none, pa.array(blobs, pa.binary())], names=names)


def _total(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, dtype=np.int32).astype(np.int64) for x in table.column("payload").to_pylist())
    return pa.table({"chunk": table.column("chunk").slice(0, 1), "payload": pa.array([total.tobytes()], pa.binary())})


def log_ratios(with_class: np.ndarray, without: np.ndarray, n_with: int, n_without: int, p: Params) -> np.ndarray:
    """Log-count ratios; 0 where the difference of the two frequencies may be chance (below least_z standard errors)."""
    a, b = with_class + p.alpha, without + p.alpha
    r = np.log(a / (n_with + 2 * p.alpha)) - np.log(b / (n_without + 2 * p.alpha))
    return np.where(np.abs(r) >= p.least_z * np.sqrt(1 / a + 1 / b), r, 0.0)


def fit(rows: list[np.ndarray], y: np.ndarray, r: np.ndarray, p: Params, seed: int = 3) -> tuple[np.ndarray, float]:
    """Weights of the unscaled indicators and the bias of a hinge-loss model fitted by dual coordinate descent.

    As usual for these models, the weights are mixed with their mean magnitude:
    mix is the share of the fitted ones.
    """
    rows = [x[r[x] != 0] for x in rows]
    values = [r[x] for x in rows]
    q = np.array([float(v @ v) + 1.0 for v in values])
    w, bias, alpha = np.zeros(len(r)), 0.0, np.zeros(len(rows))
    rng = np.random.default_rng(seed)
    for _ in range(p.epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            g = y[i] * (w[rows[i]] @ values[i] + bias) - 1.0
            new = min(max(alpha[i] - g / q[i], 0.0), p.c)
            step = (new - alpha[i]) * y[i]
            if step:
                alpha[i] = new
                w[rows[i]] += step * values[i]
                bias += step
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    used = np.count_nonzero(r) or 1
    w = (1 - p.mix) * np.abs(w).sum() / used + p.mix * w
    return w * r, bias


@dataclass(frozen=True)
class Model:
    """Weights and biases of the two heads; a head without both classes among the labels is None."""

    quality: tuple[np.ndarray, float] | None
    toxic: tuple[np.ndarray, float] | None

    def margins(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Quality and toxicity margins of every text, and whether it has any feature."""
        n = len(column)
        out, some = np.zeros((2, n)), np.zeros(n, dtype=bool)
        for i, j in T.pieces(column):
            f, at = features(column.slice(i, j - i))
            some[i:j] = np.diff(at) > 0
            for k, head in enumerate((self.quality, self.toxic)):
                if head is None:
                    out[k, i:j] = 1.0 if k == 0 else -1.0
                else:
                    total = np.concatenate([[0.0], np.cumsum(head[0][f], dtype=np.float64)])
                    out[k, i:j] = total[at[1:]] - total[at[:-1]] + head[1]
        return out[0], out[1], some


def train(docs: DataFrame, labels: DataFrame, params: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit both heads on labels (doc_id, quality, toxic; 1 is good quality, and toxic).

    Labels that are neither 0 nor 1 don't count for their head.  Repeated labels
    of one document count as often as they stand.  The frequencies cover every
    labelled document; the fit uses at most sample_per_class rows of each
    combination of the two labels, those with the smallest hash of their id.
    """
    spark = docs.sparkSession
    own = labels.select(F.col(id_col).cast("long").alias("id"), F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic")).where("id is not null")
    parts = []
    for q in (0, 1):
        for t in (0, 1):
            part = own.where((F.col("quality") == q) & (F.col("toxic") == t)).select("id", F.xxhash64("id").alias("h"))
            parts.append(part.orderBy("h", "id").limit(params.sample_per_class).select("id"))
    sample = parts[0].union(parts[1]).union(parts[2]).union(parts[3]).distinct().withColumn("sampled", F.lit(True))
    own = own.join(sample, "id", "left").fillna({"sampled": False})
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    may = sieve(save(own.select(F.xxhash64("id").alias("key")).distinct(), "labelled"))
    found = save(texts.where(may(F.xxhash64("id"))).hint("merge").join(own, "id").select("text", "quality", "toxic", "sampled").mapInArrow(tidy(_count), "chunk int, quality int, toxic int, payload binary"), "nbsvm")
    sums = {x.chunk: np.frombuffer(bytes(x.payload), dtype=np.int64) for x in found.where("chunk > -2").select("chunk", "payload").groupBy("chunk").applyInArrow(_total, "chunk int, payload binary").collect()}
    if not sums:
        return Model(None, None)
    counts = np.concatenate([sums[k].reshape(4, -1) for k in range(_CHUNKS)], axis=1)
    n = sums[-1]
    ratio = spark.sparkContext.broadcast([log_ratios(counts[2 * k + 1], counts[2 * k], int(n[2 * k + 1]), int(n[2 * k]), params).astype(np.float32) if n[2 * k] and n[2 * k + 1] else None for k in range(2)])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, quality, toxic = [], [], []
        for b in batches:
            rows += [np.frombuffer(x, dtype=np.uint32) for x in b.column("payload").to_pylist()]
            quality += b.column("quality").to_pylist()
            toxic += b.column("toxic").to_pylist()
        # an order of their own, so that the result doesn't depend on the order of arrival
        order = sorted(range(len(rows)), key=lambda i: (len(rows[i]), rows[i].tobytes(), quality[i], toxic[i]))
        for k, label in enumerate((np.array(quality), np.array(toxic))):
            r = ratio.value[k]
            use = [i for i in order if label[i] in (0, 1)]
            if r is None or len({int(label[i]) for i in use}) < 2:
                continue
            w, bias = fit([rows[i] for i in use], np.where(label[use] == 1, 1.0, -1.0), r.astype(np.float64), params)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([w.astype(np.float32).tobytes()], pa.binary()), pa.array([bias])], names=["head", "w", "bias"])

    heads = {x.head: (np.frombuffer(bytes(x.w), dtype=np.float32), x.bias) for x in found.where("chunk = -2").coalesce(1).mapInArrow(tidy(solve), "head int, w binary, bias double").collect()}
    return Model(heads.get(0), heads.get(1))


def score(docs: DataFrame, model: Model, text_col: str = "text") -> tuple[DataFrame, str]:
    """docs with a column (its name is returned) of struct(quality, toxicity, keep); see classify()."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = ST.StructType([ST.StructField("quality", ST.DoubleType()), ST.StructField("toxicity", ST.DoubleType()), ST.StructField("keep", ST.BooleanType())])

    @F.arrow_udf(kind)
    def margins(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return tidy(scored)(texts)

    def scored(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            q, t, some = held.value.margins(T.as_large(column))
            yield pa.StructArray.from_arrays([pa.array(q, mask=~some), pa.array(t, mask=~some), pa.array(some & (q >= 0) & (t < 0))], names=["quality", "toxicity", "keep"])

    name = free_name(docs, "__margins")
    return docs.withColumn(name, margins(F.col(text_col))), name


def quality_filter(docs: DataFrame, labels: DataFrame, params: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that both heads accept, with all their columns.

    Null texts and texts without a single token are rejected; a null id is no
    reason to.  A quality margin of exactly 0 is accepted, a toxicity margin of
    exactly 0 is not.  Repeated rows are scored alike, and a very long text by all
    its features.  Other columns pass through whatever their names.  Without any labels, or with one class of them only, a head
    accepts everything.  An empty table gives an empty result.
    """
    scored, name = score(docs, train(docs, labels, params, id_col, text_col), text_col)
    return scored.where(F.col(f"{name}.keep")).drop(name)


def classify(docs: DataFrame, labels: DataFrame, params: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, quality_margin, toxicity_margin) of the documents that quality_filter() keeps, a row for each of their rows.

    Nulls, ties, repeats, long texts and empty tables are as said there.
    """
    scored, name = score(docs.select(id_col, text_col), train(docs, labels, params, id_col, text_col), text_col)
    return scored.where(F.col(f"{name}.keep")).select(F.col(id_col).alias("doc_id"), F.col(f"{name}.quality").alias("quality_margin"), F.col(f"{name}.toxicity").alias("toxicity_margin"))
