"""Benchmark decontamination by latent semantic retrieval.

Passages of the corpus form a TF-IDF matrix over hashed words.  Its leading
right singular vectors come from a distributed randomised SVD: one pass draws a
random sign for every passage and sums signed counts into a sketch of the row
space, a second pass projects all passages on the orthonormalised sketch and
sums the small Gram matrix, whose eigenvectors give the singular vectors and
values.  Benchmark items and windows of the documents are compared by cosine in
the (whitened) latent space, and candidates are settled by the longest common
subsequence of their words and by whether the item's answer is there as well.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm import text as T
from recordloom.llm.common import as_scan, free_name, save, tidy, without

_BITS = 14
_D = 1 << _BITS
_PASSAGE = 64
_BLOCK = 8


@dataclass(frozen=True)
class Params:
    """rank: dimensions of the latent space; cosine: least similarity of a candidate.

    A window is contaminated by an item if the longest common subsequence has at
    least `certain` of the item's words, or at least `likely` of them with the
    answer found.  An item's answer is its column `answer` where there is one,
    else its last answer_words words.  A pass over the corpus searches items of
    words_per_pass words together (a longer item has its own pass), so that what
    it sends to the tasks is bounded; there are as many passes as items need.
    """

    rank: int = 56
    oversample: int = 8
    cosine: float = 0.4
    certain: float = 0.7
    likely: float = 0.55
    answer_words: int = 6
    answer_found: float = 0.8
    words_per_pass: int = 1_000_000


def _pack(docs_id: pa.Array, hashes: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    words = hashes.astype(np.uint32)
    blobs = pa.array([words[at[k] : at[k + 1]].tobytes() for k in range(len(at) - 1)], pa.binary())
    return pa.RecordBatch.from_arrays([docs_id, pa.nulls(len(docs_id), pa.int32()), blobs], names=["doc_id", "part", "payload"])


#: Two columns of signs are summed as one number: the second one counts in units of this.
_UNIT = float(1 << 26)


def _signs(n: int, seed: int, columns: int) -> np.ndarray:
    """Random signs of n passages, two columns in one number: (columns / 2) by n."""
    bits = np.random.default_rng(seed & (2**63 - 1)).integers(0, 2, size=(columns // 2, 2, n), dtype=np.int8)
    signs = (2 * bits - 1).astype(np.float64)
    return signs[:, 0] + _UNIT * signs[:, 1]


def _unpack(total: np.ndarray) -> np.ndarray:
    """Sums of both columns of each number, exact below 2^25 words."""
    second = np.round(total / _UNIT)
    return np.stack([total - second * _UNIT, second], axis=1).reshape(-1, total.shape[1]).astype(np.int64)


def _hash_and_sketch(columns: int):
    """mapInArrow: (doc_id, text) to the word hashes of every document, and the sums of the partition.

    Sums have a null id and come in parts: 0 is the number of passages that hold
    each bucket, k from 1 the k-th column of the sketch, -1 the number of passages.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, packed = np.zeros((columns + 1, _D), dtype=np.int64), np.zeros((columns // 2, _D))
        passages = held = 0
        for batch in batches:
            column = T.as_large(batch.column("text"))
            for i, j in T.pieces(column):
                h, at = T.word_hashes(column.slice(i, j - i))
                yield _pack(batch.column("doc_id").slice(i, j - i), h, at)
                if not len(h):
                    continue
                bucket, owner, n = _passages(h.astype(np.uint32), at)
                held += len(h)
                if held >= 1 << 25:
                    total[1:] += _unpack(packed)
                    packed[:], held = 0.0, len(h)
                seen = np.unique(owner.astype(np.int64) * _D + bucket)
                total[0] += np.bincount(seen % _D, minlength=_D)
                signs = _signs(n, int(h[0]) ^ int(h[-1]) ^ len(h), columns)
                sizes = np.bincount(owner, minlength=n)
                for k, own in enumerate(signs):
                    packed[k] += np.bincount(bucket, weights=np.repeat(own, sizes), minlength=_D)
                passages += n
        if passages:
            total[1:] += _unpack(packed)
            blobs = [x.astype(np.int32).tobytes() for x in total] + [np.array([passages], dtype=np.int32).tobytes()]
            parts = np.array([*range(len(total)), -1], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(parts), pa.int64()), pa.array(parts), pa.array(blobs, pa.binary())], names=["doc_id", "part", "payload"])

    return run


def _passages(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Bucket and passage of every word; the passages are consecutive runs of words of one document."""
    size = np.diff(at)
    count = -(-size // _PASSAGE)
    first = np.cumsum(count) - count
    owner = np.repeat(first, size) + (np.arange(len(words)) - np.repeat(at[:-1], size)) // _PASSAGE
    return (words & np.uint32(_D - 1)).astype(np.int64), owner, int(count.sum())


def _sum(dtype: str, out: str):
    def run(table: pa.Table) -> pa.Table:
        total: np.ndarray | None = None
        for x in table.column("payload"):
            own = np.frombuffer(x.as_buffer(), dtype=dtype)
            total = own.astype(out) if total is None else total + own
        return pa.table({"part": table.column("part").slice(0, 1), "payload": pa.array([b"" if total is None else total.tobytes()], pa.binary())})

    return run


def tree_sum(rows: DataFrame, dtype: str, out: str) -> dict[int, np.ndarray]:
    """Sums of arrays (part, payload) by part, added up on executors in two levels of about the root of the number of tasks each."""
    lanes = int(rows.rdd.getNumPartitions() ** 0.5) + 1
    lane = F.pmod(F.spark_partition_id(), F.lit(lanes)).alias("lane")
    first = rows.select(lane, "part", "payload").groupBy("part", "lane").applyInArrow(_sum(dtype, out), "part int, payload binary")
    total = first.groupBy("part").applyInArrow(_sum(out, out), "part int, payload binary").collect()
    return {x.part: np.frombuffer(bytes(x.payload), dtype=out) for x in total}


class Embedder:
    """Sums rows of a table of word vectors over blocks of words."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = np.concatenate([vectors, np.zeros((1, vectors.shape[1]))]).astype(np.float32)

    def blocks(self, bucket: np.ndarray, size: int) -> np.ndarray:
        """Vector sums of runs of size words; the number of words must be a multiple of size. Bucket _D is no word."""
        k = self.vectors.shape[1]
        out = np.empty((len(bucket) // size, k), dtype=np.float32)
        step = max(1, 4096 // size)
        for i in range(0, len(out), step):
            part = bucket[i * size : (i + step) * size]
            out[i : i + step] = np.einsum("ijk->ik", self.vectors[part].reshape(-1, size, k))
        return out


def _pad(words: np.ndarray, at: np.ndarray, block: int, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets with every document filled up to a multiple of block plus gap blocks, and the new starts of documents."""
    size = np.diff(at)
    room = (-(-size // block) + gap) * block
    start = np.cumsum(room) - room
    out = np.full(int(room.sum()), _D, dtype=np.uint16)
    out[np.repeat(start - at[:-1], size) + np.arange(len(words))] = words & np.uint32(_D - 1)
    return out, start


def _load(batch: pa.RecordBatch, most: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, words, offsets) of some documents of a batch at a time."""
    ids, blobs = batch.column("doc_id").to_numpy(zero_copy_only=False), batch.column("payload")
    sizes = np.array([len(x.as_buffer()) if x.is_valid else 0 for x in blobs]) // 4
    i = 0
    while i < len(ids):
        j, n = i + 1, sizes[i]
        while j < len(ids) and n + sizes[j] <= most:
            n += sizes[j]
            j += 1
        words = np.concatenate([np.frombuffer(blobs[k].as_buffer(), dtype=np.uint32) for k in range(i, j)])
        yield ids[i:j], words, np.concatenate([[0], np.cumsum(sizes[i:j])]).astype(np.int64)
        i = j


def _gram(vectors):
    """mapInArrow: word hashes to the sum over passages of the outer products of their projections."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embed, total = Embedder(vectors.value), 0.0
        some = False
        for batch in batches:
            for _, words, at in _load(batch):
                padded, _ = _pad(words, at, _PASSAGE, 0)
                p = embed.blocks(padded, _PASSAGE)
                total = total + (p.T @ p).astype(np.float64)
                some = True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([np.asarray(total).tobytes()], pa.binary())], names=["part", "payload"])

    return run


def latent_vectors(spark: SparkSession, hashed: DataFrame, p: Params) -> np.ndarray | None:
    """Word vectors (buckets by rank) of the whitened latent space, or None for a corpus without words."""
    width = p.rank + p.oversample
    sums = tree_sum(hashed.where("part is not null").select("part", "payload"), "int32", "int64")
    if not sums:
        return None
    df, sketch, n = sums[0], np.stack([sums[k + 1] for k in range(width)]), float(sums[-1][0])
    idf = np.where(df > 0, np.log(1.0 + n / np.maximum(df, 1)), 0.0)
    q, _ = np.linalg.qr((sketch * idf).T)
    held = spark.sparkContext.broadcast((q * idf[:, None]).astype(np.float32))
    gram = tree_sum(hashed.where("part is null").mapInArrow(tidy(_gram(held)), "part int, payload binary"), "float64", "float64")[0].reshape(width, width)
    value, vector = np.linalg.eigh(gram / n)
    top = np.argsort(-value)[: p.rank]
    top = top[value[top] > 1e-9 * value[top[0]]]
    return (q * idf[:, None]) @ (vector[:, top] / np.sqrt(value[top]))


class Patterns:
    """Word sequences, ready to be matched with many stretches of text at once.

    Sequences of up to `tabled` words are in blocks, in which each word of the
    block's vocabulary has a bit mask of its places in each sequence, 64 places a
    table; longer ones are matched one by one, without tables, whose size would
    be quadratic.
    """

    def __init__(self, sequences: list[np.ndarray], block: int = 64, block_words: int = 8192, tabled: int = 256):
        self.sequences = sequences
        self.size = np.array([len(x) for x in sequences], dtype=np.int64)
        self.block_of, self.slot = np.full(len(sequences), -1), np.zeros(len(sequences), dtype=np.int64)
        members: list[list[int]] = []
        held = 0
        for k, n in enumerate(self.size.tolist()):
            if n > tabled:
                continue
            if not members or len(members[-1]) == block or held + n > block_words:
                members.append([])
                held = 0
            self.block_of[k], self.slot[k] = len(members) - 1, len(members[-1])
            members[-1].append(k)
            held += n
        self.blocks: list[tuple[np.ndarray, list[np.ndarray]]] = []
        for ids in members:
            own = [sequences[k] for k in ids]
            vocabulary = np.unique(np.concatenate(own))
            tables = [np.zeros((len(own), len(vocabulary) + 1), dtype=np.uint64) for _ in range(-(-max(map(len, own)) // 64))]
            for k, x in enumerate(own):
                at = np.searchsorted(vocabulary, x)
                for t, table in enumerate(tables):
                    here = at[64 * t : 64 * (t + 1)]
                    np.bitwise_or.at(table[k], here, np.uint64(1) << np.arange(len(here), dtype=np.uint64))
            self.blocks.append((vocabulary, tables))

    def lcs(self, owner: np.ndarray, words: np.ndarray, start: np.ndarray, stop: np.ndarray, least: float = 0.0) -> np.ndarray:
        """Lengths of the longest common subsequences of sequence owner[i] and words[start[i]:stop[i]].

        Where the places whose word occurs at all are fewer than the share
        `least` of a sequence, their number is returned, which is no less than
        the length and settles that it is too short.
        """
        out = np.zeros(len(owner), dtype=np.int64)
        for k in np.flatnonzero(self.block_of[owner] < 0):
            own, stretch = self.sequences[owner[k]], words[start[k] : stop[k]]
            out[k] = np.isin(own, stretch).sum()
            if out[k] >= least * len(own) - 1e-9:
                out[k] = _lcs_long(own, stretch)
        for b in np.unique(self.block_of[owner]):
            if b < 0:
                continue
            vocabulary, tables = self.blocks[b]
            mine = np.flatnonzero(self.block_of[owner] == b)
            first = start[mine]
            text = words
            if int((stop[mine] - first).sum()) < len(words) // 2:  # few stretches: look up their words only
                text = np.concatenate([words[x:y] for x, y in zip(first, stop[mine], strict=True)])
                first = np.cumsum(stop[mine] - first) - (stop[mine] - first)
            last = first + (stop[mine] - start[mine])
            order = np.argsort(first - last, kind="stable")  # the longest first, so that rows of one width come together
            mine, first, last = mine[order], first[order], last[order]
            at = np.minimum(np.searchsorted(vocabulary, text), len(vocabulary) - 1)
            ids = np.where(vocabulary[at] == text, at, len(vocabulary)).astype(np.int32)
            i = 0
            while i < len(mine):
                j = slice(i, i + max(1, min(2048, (1 << 19) // max(1, int(last[i] - first[i])))))
                i = j.stop
                out[mine[j]] = self._match(tables, ids, text, owner[mine[j]], first[j], last[j], least)
        return out

    def _match(self, tables: list[np.ndarray], ids: np.ndarray, words: np.ndarray, owner: np.ndarray, start: np.ndarray, stop: np.ndarray, least: float) -> np.ndarray:
        length = stop - start
        width = int(max(length.max(), 1))
        none = tables[0].shape[1] - 1
        own = np.lib.stride_tricks.sliding_window_view(np.append(ids, np.full(width, none, dtype=ids.dtype)), width)[start]
        if length.min() < width:
            own[np.arange(width) >= length[:, None]] = none
        own += (self.slot[owner] * (none + 1)).astype(ids.dtype)[:, None]
        masks = tables[0].take(own)
        out = np.bitwise_count(np.bitwise_or.reduce(masks, axis=1)).astype(np.int64)
        for table in tables[1:]:
            out += np.bitwise_count(np.bitwise_or.reduce(table.take(own), axis=1))
        good = out >= least * self.size[owner] - 1e-9
        short = np.flatnonzero(good & (self.size[owner] <= 64))
        if len(short):
            out[short] = _bit_lcs(masks[short], self.size[owner[short]])
        for k in np.flatnonzero(good & (self.size[owner] > 64)):
            out[k] = _lcs_long(self.sequences[owner[k]], words[start[k] : stop[k]])
        return out


def _bit_lcs(masks: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Longest common subsequences from the masks of the words of each row, bit-parallel over the rows."""
    v = np.full(len(masks), np.uint64(0xFFFFFFFFFFFFFFFF))
    with np.errstate(over="ignore"):
        for m in np.ascontiguousarray(masks.T):
            u = v & m
            v = (v + u) | (v - u)
    inside = np.where(size == 64, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << np.minimum(size, 63).astype(np.uint64)) - np.uint64(1))
    return np.bitwise_count(~v & inside).astype(np.int64)


@dataclass
class Items:
    """Benchmark items ready for the search, all of one window size."""

    ids: np.ndarray
    vectors: np.ndarray  # of pieces of items, normalised
    piece_of: np.ndarray
    before: np.ndarray  # words of the item before each piece
    after: np.ndarray  # and after it
    window: int
    words: Patterns
    answers: Patterns


def _window(n: int) -> int:
    """The window size for an item of n words: the power of two next to it, from 16 to 128."""
    return int(np.clip(2 ** int(round(np.log2(max(n, 1)))), 16, 128))


def prepare_items(rows: list[tuple[int, str, str | None]], vectors: np.ndarray, p: Params) -> list[Items]:
    groups: dict[int, list[tuple[int, np.ndarray, np.ndarray]]] = {}
    for item, body, answer in rows:
        h, _ = T.word_hashes(pa.array([body], pa.large_string()))
        words = h.astype(np.uint32)
        if not len(words):
            continue
        end = T.word_hashes(pa.array([answer], pa.large_string()))[0].astype(np.uint32) if answer else words[-p.answer_words :]
        groups.setdefault(_window(len(words)), []).append((item, words, end))
    out = []
    for window, own in sorted(groups.items()):
        pieces, of, before, after = [], [], [], []
        for k, (_, words, _) in enumerate(own):
            parts = max(1, round(len(words) / window)) if len(words) > 1.5 * window else 1
            at = 0
            for part in np.array_split(words, parts):
                before.append(at)
                at += len(part)
                after.append(len(words) - at)
                v = vectors[part & np.uint32(_D - 1)].sum(axis=0)
                pieces.append(v / (np.linalg.norm(v) or 1.0))
                of.append(k)
        out.append(Items(np.array([x[0] for x in own], dtype=np.int64), np.array(pieces, dtype=np.float32), np.array(of), np.array(before), np.array(after), window, Patterns([x[1] for x in own]), Patterns([x[2] for x in own])))
    return out


def _lcs_long(pattern: np.ndarray, words: np.ndarray) -> int:
    masks: dict[int, int] = {}
    for k, w in enumerate(pattern.tolist()):
        masks[w] = masks.get(w, 0) | 1 << k
    full = (1 << len(pattern)) - 1
    v = full
    for w in words.tolist():
        m = masks.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(pattern) - v.bit_count()


def _search(groups, vectors, p: Params):
    """mapInArrow: word hashes to (doc_id, item_id, cosine, lcs, answer) of contaminated documents."""
    names = ["doc_id", "item_id", "cosine", "lcs", "answer"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embed, own = Embedder(vectors.value), groups.value
        step = max(g.window for g in own) // 2
        for batch in batches:
            for ids, words, at in _load(batch):
                padded, first = _pad(words, at, step, 1)  # a window of every size starts where a document does
                sums = embed.blocks(padded, _BLOCK)
                parts = [x for g in own if (x := _matches(g, sums, ids, words, at, first // _BLOCK, p)) is not None]
                if parts:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], names=names)

    return run


def candidates(g: Items, sums: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first block of a window, piece of an item, cosine) of all pairs above the least cosine."""
    wide, step = g.window // _BLOCK, g.window // _BLOCK // 2
    n = max(1, -(-(len(sums) - wide) // step) + 1)
    need = (n - 1) * step + wide
    if need > len(sums):
        sums = np.concatenate([sums, np.zeros((need - len(sums), sums.shape[1]), dtype=np.float32)])
    half = np.einsum("ijk->ik", sums[: (n + 1) * step].reshape(n + 1, step, -1))
    window = half[:-1] + half[1:]
    window /= np.maximum(np.linalg.norm(window, axis=1, keepdims=True), 1e-9)
    at, piece, value = [], [], []
    for a in range(0, n, 8192):
        for b in range(0, len(g.vectors), 512):
            c = window[a : a + 8192] @ g.vectors[b : b + 512].T
            x, y = np.nonzero(c >= cosine)
            at.append(x + a)
            piece.append(y + b)
            value.append(c[x, y])
    return np.concatenate(at) * step, np.concatenate(piece), np.concatenate(value)


def _matches(g: Items, sums: np.ndarray, ids: np.ndarray, words: np.ndarray, at: np.ndarray, first: np.ndarray, p: Params):
    block, piece, cosine = candidates(g, sums, p.cosine)
    if not len(block):
        return None
    doc = np.searchsorted(first, block, side="right") - 1
    begin = (block - first[doc]) * _BLOCK
    size = at[doc + 1] - at[doc]
    # the stretch covers the whole item of a piece, with half as much again for words put in
    item, before, after = g.piece_of[piece], g.before[piece], g.after[piece]
    start = at[doc] + np.maximum(begin - g.window // 2 - (before + before // 2), 0)
    stop = at[doc] + np.minimum(begin + g.window + g.window // 2 + (after + after // 2), size)
    use = (start < stop) & (begin < size)
    doc, item, cosine, start, stop = doc[use], item[use], cosine[use], start[use], stop[use]
    if not len(doc):
        return None
    # a pair is as good as its best window
    share = g.words.lcs(item, words, start, stop, p.likely) / g.words.size[item]
    close = np.flatnonzero(share >= p.likely)
    answer = np.zeros(len(doc), dtype=bool)
    if len(close):
        found = g.answers.lcs(item[close], words, start[close], stop[close], p.answer_found)
        answer[close] = found >= p.answer_found * g.answers.size[item[close]]
    hit = np.flatnonzero((share >= p.certain) | ((share >= p.likely) & answer))
    if not len(hit):
        return None
    hit = hit[np.lexsort((-cosine[hit], -share[hit], item[hit], doc[hit]))]
    key = doc[hit] * np.int64(len(g.ids)) + item[hit]
    hit = hit[np.concatenate([[True], key[1:] != key[:-1]])]
    return ids[doc[hit]].astype(np.int64), g.ids[item[hit]], cosine[hit].astype(np.float64), share[hit], answer[hit]


def contaminated(docs: DataFrame, benchmark: DataFrame, params: Params = Params(), id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", answer_col: str = "answer") -> DataFrame:
    """(doc_id, item_id, cosine, lcs, answer): documents that hold a benchmark item or a paraphrase of it.

    lcs is the share of the item's words in the longest common subsequence with
    the best window of the document, answer whether its answer is there too.  Of
    equally good windows the one of the largest cosine counts, then the first.

    Null ids and null or wordless texts, of documents and of items, match
    nothing; a text that is shorter than a window is one window, and a very long
    text or item is searched in all its windows.  Rows that
    repeat a document id give rows that repeat.  Other columns are ignored
    whatever their names, but for a column `answer` of the benchmark.  An empty
    table on either side gives an empty result.
    """
    p, spark = params, docs.sparkSession
    kind = "doc_id long, item_id long, cosine double, lcs double, answer boolean"
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null")
    hashed = save(own.mapInArrow(tidy(_hash_and_sketch(p.rank + p.oversample)), "doc_id long, part int, payload binary"), "words")
    vectors = latent_vectors(spark, hashed, p)
    answer = F.col(answer_col).cast("string") if answer_col in benchmark.columns else F.lit(None).cast("string")
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text"), answer.alias("answer")).where("item_id is not null and text is not null")
    if vectors is None:
        return spark.createDataFrame([], kind)
    held = spark.sparkContext.broadcast(vectors.astype(np.float32))
    words = hashed.where("part is null")
    out = None
    for rows in _passes(items.toLocalIterator(), p.words_per_pass):
        groups = prepare_items(rows, vectors, p)
        if groups:
            found = words.mapInArrow(tidy(_search(spark.sparkContext.broadcast(groups), held, p)), kind)
            # what a benchmark of many passes finds is written pass by pass, so that the driver holds one pass
            out = found if out is None else out.unionByName(save(found, "found"))
    return spark.createDataFrame([], kind) if out is None else out


def _passes(items: Iterable, most: int) -> Iterator[list[tuple[int, str, str | None]]]:
    """Items in order, of at most `most` words together; an item that has more is alone."""
    rows: list[tuple[int, str, str | None]] = []
    held = 0
    for x in items:
        n = len(x.text) // 2 + 1  # words have a letter and a separator at least
        if rows and held + n > most:
            yield rows
            rows, held = [], 0
        rows.append((x.item_id, x.text, x.answer))
        held += n
    if rows:
        yield rows


def decontaminate(docs: DataFrame, benchmark: DataFrame, params: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those that contaminated() finds; all columns as they are.

    Rows are judged each by itself, so of rows that share an id the clean ones
    stay; rows of null ids are judged like others.
    """
    docs = as_scan(docs)
    at = free_name(docs, "__at")
    marked = docs.withColumn(at, F.xxhash64("_metadata.file_path", "_metadata.row_index"))
    gone = contaminated(marked.select(F.col(at).alias("doc_id"), F.col(text_col).alias("text")), benchmark, params).select(F.col("doc_id").alias(at)).distinct()
    return without(marked, save(gone, "contaminated"), [at]).drop(at)
