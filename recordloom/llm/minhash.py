"""Near-duplicate groups by MinHash with tensored banding.

A plain index of L tables with keys of 2r minhashes needs 2rL minhashes a text.
Here two collections of m sub-keys of r minhashes each are computed, 2rm in all,
and the key of table (i, j) combines sub-key i of one collection with sub-key j
of the other: m*m tables.  A pair of Jaccard similarity s meets in some table
with probability (1 - (1 - s**r)**m)**2.  With r=3 and m=13, that is 78
minhashes for 169 tables of 6: 0.917 at 0.6, 0.992 at 0.7, 0.9998 at 0.8, and
0.0002 at 0.1.  Only the sub-keys are stored with a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm import text as T
from recordloom.llm.common import as_scan, connected_components, contract, free_name, save, shuffle_partitions, sieve, tidy, union_find, without

_rng = np.random.default_rng(6)
_A = _rng.integers(1, 2**63, size=4096, dtype=np.uint64) | np.uint64(1)
_B = _rng.integers(1, 2**63, size=4096, dtype=np.uint64)


def minhashes(shingles: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """n minhashes of every row (rows must not be empty), as an array of rows by n."""
    out = np.empty((len(offsets) - 1, n), dtype=np.uint64)
    at = offsets[:-1]
    with np.errstate(over="ignore"):
        for k in range(n):
            out[:, k] = np.minimum.reduceat((shingles * _A[k] + _B[k]) >> np.uint64(20), at)
    return out


def sub_keys(sig: np.ndarray, r: int, m: int) -> np.ndarray:
    """The m sub-keys of both collections of every row, from 2*r*m minhashes."""
    with np.errstate(over="ignore"):
        sub = np.zeros((len(sig), 2 * m), dtype=np.uint64)
        for k in range(r):
            sub = T.mix(sub * np.uint64(31) + sig[:, k * 2 * m : (k + 1) * 2 * m] + np.uint64(k + 1))
        return sub


def table_keys(sub: np.ndarray, m: int) -> np.ndarray:
    """Keys of the m*m tables of every row, from its sub-keys."""
    with np.errstate(over="ignore"):
        table = np.arange(m * m, dtype=np.uint64).reshape(1, m, m)
        return T.mix(sub[:, :m, None] + sub[:, None, m:] * np.uint64(0x9E3779B1) + table).reshape(len(sub), m * m)


def set_hashes(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of the set of values of every row (rows must not be empty)."""
    size = np.diff(offsets).astype(np.uint64)
    with np.errstate(over="ignore"):
        return tuple(T.mix(np.add.reduceat(T.mix(values ^ salt), offsets[:-1]) + size) for salt in (np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)))


def _signatures(width: int, r: int, m: int):
    """mapInArrow: (id, file, row, text) to what stands for a text: hashes and size of its set of shingles, and its sub-keys."""
    names = ["id", "file", "row", "node", "twin", "size", "keys"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = T.as_large(batch.column(3))
            for i, j in T.pieces(column):
                h, at = T.word_hashes(column.slice(i, j - i))
                d, at = T.distinct(*T.shingles(h, at, width))
                some = np.flatnonzero(np.diff(at))
                if not len(some):
                    continue
                cut = np.concatenate([at[some], at[-1:]])
                node, twin = set_hashes(d, cut)
                keys = sub_keys(minhashes(d, cut, 2 * r * m), r, m)
                place = [batch.column(c).slice(i, j - i).take(pa.array(some)) for c in range(3)]
                own = [pa.array(node.view(np.int64)), pa.array(twin.view(np.int64)), pa.array(np.diff(cut).astype(np.int64)), pa.array([x.tobytes() for x in keys], pa.binary())]
                yield pa.RecordBatch.from_arrays([*place, *own], names=names)

    return run


def _emit(m: int, cells: int, hold: int = 1_000_000):
    """mapInArrow: (node, keys) to (cell, payload), payload being the (table key, node) pairs of one cell; texts that are alike in one task count once."""

    def pack(nodes: list[np.ndarray], keys: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        own, first = np.unique(np.concatenate(nodes), return_index=True)
        key = table_keys(np.concatenate(keys)[first], m).ravel()
        own = np.repeat(own, m * m)
        cell = (key % np.uint64(cells)).astype(np.int32)
        order = np.argsort(cell, kind="stable")
        pairs = np.stack([key[order], own[order].view(np.uint64)], axis=1)
        cell = cell[order]
        at = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1], [True]]))
        blobs = pa.array([pairs[x:y].tobytes() for x, y in zip(at[:-1], at[1:], strict=True)], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(cell[at[:-1]]), blobs], names=["cell", "payload"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, keys, held = [], [], 0
        for batch in batches:
            for i in range(0, batch.num_rows, hold // (m * m)):
                part = batch.slice(i, hold // (m * m))
                nodes.append(part.column("node").to_numpy(zero_copy_only=False))
                keys.append(np.frombuffer(b"".join(part.column("keys").to_pylist()), dtype=np.uint64).reshape(-1, 2 * m))
                held += part.num_rows * m * m
                if held >= hold:
                    yield from pack(nodes, keys)
                    nodes, keys, held = [], [], 0
        if held:
            yield from pack(nodes, keys)

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that are sorted by cell to a star for every set of nodes that the tables of one cell connect; holds one cell at a time."""
    cell, held = None, []
    for batch in batches:
        for own, payload in zip(batch.column("cell").to_pylist(), batch.column("payload").to_pylist(), strict=True):
            if own != cell and held:
                yield from _stars(held)
                held = []
            cell = own
            held.append(payload)
    if held:
        yield from _stars(held)


def _stars(payloads: list[bytes]) -> Iterator[pa.RecordBatch]:
    pairs = np.frombuffer(b"".join(payloads), dtype=np.uint64).reshape(-1, 2)
    order = np.argsort(pairs[:, 0], kind="stable")
    key, own = pairs[order, 0], pairs[order, 1].view(np.int64)
    same = np.flatnonzero(key[1:] == key[:-1])
    u, v = own[same], own[same + 1]
    differ = u != v
    if differ.any():
        node, root = union_find(u[differ], v[differ])
        keep = node != root
        yield pa.RecordBatch.from_arrays([pa.array(node[keep]), pa.array(root[keep])], names=["u", "v"])


def _sets(width: int):
    """mapInArrow: (node, part, block, text) with the distinct shingle hashes of text, 8 bytes each, in its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = T.as_large(batch.column("text"))
            for i, j in T.pieces(column):
                h, at = T.word_hashes(column.slice(i, j - i))
                d, at = T.distinct(*T.shingles(h, at, width))
                blobs = [d[at[k] : at[k + 1]].tobytes() for k in range(j - i)]
                rest = [batch.column(c).slice(i, j - i) for c in ("node", "part", "block")]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(blobs, pa.binary())], names=["node", "part", "block", "shingles"])

    return run


def similar_groups(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Components of the graph that joins sets of Jaccard similarity >= threshold: for each set, the first of its component.

    Exact: every set is compared, by an inverted index, with all sets that are
    not in a component yet.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets])
    label = np.full(n, -1)
    flat = np.concatenate(sets) if n else np.empty(0, dtype=np.uint64)
    value, term = np.unique(flat, return_inverse=True)
    owner = np.repeat(np.arange(n), size)
    posting = owner[np.argsort(term, kind="stable")]
    start = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(value)))])
    offsets = np.concatenate([[0], np.cumsum(size)])
    left = n
    for root in range(n):
        if label[root] >= 0:
            continue
        label[root] = root
        left -= 1
        queue = [root]
        while queue and left:
            x = queue.pop()
            own = term[offsets[x] : offsets[x + 1]]
            begin, length = start[own], start[own + 1] - start[own]
            total = int(length.sum())
            at = np.repeat(begin - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(total)
            common = np.bincount(posting[at], minlength=n)
            new = np.flatnonzero((label < 0) & (common >= threshold * (size[x] + size - common) - 1e-9) & (common > 0))
            label[new] = root
            left -= len(new)
            queue.extend(new.tolist())
    return label


def _verify(threshold: float):
    """applyInArrow: the texts of one task to star edges between those that are truly similar."""

    def run(table: pa.Table) -> pa.Table:
        own, first = np.unique(table.column("node").to_numpy(), return_index=True)
        blobs = table.column("shingles").take(pa.array(first)).to_pylist()
        label = similar_groups([np.frombuffer(x, dtype=np.uint64) for x in blobs], threshold)
        keep = label != np.arange(len(own))
        return pa.table({"u": pa.array(own[keep]), "v": pa.array(own[label[keep]])})

    return run


def _cross_blocks(sets: DataFrame, placed: DataFrame, edges: DataFrame, block_docs: int, threshold: float) -> DataFrame:
    """Edges between the blocks of the parts that have several.

    What the blocks found so far makes groups; the members of the largest group
    of a part need no comparison with each other.  The other texts of the part
    are compared with all of its blocks, block_docs of them at a time.
    """
    wide = placed.where("blocks > 1").select("node", "part", "block", "blocks")
    group = connected_components(edges)
    own = save(wide.join(group, "node", "left").select("node", "part", "block", "blocks", F.coalesce("component", "node").alias("group")), "blocks")
    largest = own.groupBy("part", "group").agg(F.count("*").alias("n")).groupBy("part").agg(F.max_by("group", F.struct("n", "group")).alias("largest"))
    others = own.join(largest, "part").where("`group` <> largest")
    rounds = F.ceil(F.count("*") / F.lit(block_docs)).cast("int").alias("rounds")
    sized = own.join(others.groupBy("part").agg(rounds), "part")
    all_rounds = sized.select("node", "part", "block", F.explode(F.expr("sequence(0, rounds - 1)")).alias("round"))
    other = others.select("node").join(sized, "node").select("node", "part", F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"), F.pmod(F.xxhash64("node", F.lit(1)), F.col("rounds")).cast("int").alias("round"))
    tasks = all_rounds.union(other).distinct()
    return sets.select("node", "shingles").join(tasks, "node").groupBy("part", "block", "round").applyInArrow(_verify(threshold), "u long, v long")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = 0.6,
    width: int = 3,
    r: int = 3,
    m: int = 13,
    block_docs: int = 20_000,
    block_shingles: int = 4_000_000,
) -> DataFrame:
    """Groups of near duplicates: (doc_id, duplicate_of, file, row), a row for every document but the one of each group that stays.

    docs should be a plain scan of Parquet files; anything else is first written
    to the shared folder.  Two texts are near duplicates where the Jaccard
    similarity of their sets of width-word shingles is at least threshold, and
    groups are the connected components of that relation.  The smallest id of a
    group stays, of rows that share it the first by file and row.

    Texts of one set of shingles are one node from the start, however many they
    are.  Tensored banding proposes candidates among the nodes, connected
    candidates come together in one task, and there every pair that could extend
    a group is verified exactly.  Where they are more than block_docs or
    block_shingles, each block is a task, and afterwards the texts outside of the
    largest group are compared with the other blocks.

    Null or wordless text, and a null id, are never in a group.  A text of fewer
    words than width has one shingle of all its words; a very long text counts
    with all its shingles.  Rows that share an id are documents of their own, as
    are rows that repeat in full.  Other columns are ignored whatever their
    names.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs = as_scan(docs)
    own = docs.select(docs[id_col].cast("long").alias("id"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), docs[text_col].alias("text"))
    own = own.where("id is not null and text is not null")
    signed = save(own.mapInArrow(tidy(_signatures(width, r, m)), "id long, file string, row long, node long, twin long, size long, keys binary"), "signatures")
    buckets = shuffle_partitions(spark)
    cells = max(buckets, -(-signed.count() * m * m // 1_000_000))
    met = signed.select("node", "keys").mapInArrow(tidy(_emit(m, cells)), "cell int, payload binary").repartitionById(buckets, F.pmod("cell", F.lit(buckets)).cast("int")).sortWithinPartitions("cell")
    met = met.mapInArrow(tidy(lambda batches: contract(_meet(batches))), "u long, v long")  # one worker a task for both
    groups = save(connected_components(met, stars=True), "candidates")

    first = F.min(F.struct("id", "file", "row")).alias("first")
    nodes = save(signed.groupBy("node").agg(first, F.min("twin").alias("twin"), F.max("size").alias("size"), F.count("*").alias("n")), "nodes")
    found = groups.join(nodes, "node").select("node", "component", "size", "first")
    volume = found.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / F.lit(block_docs)), F.ceil(F.sum("size") / F.lit(block_shingles))).cast("int").alias("blocks"))
    placed = found.join(volume, "component").select("node", F.col("component").alias("part"), "blocks", F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("block"), "first.file", "first.row")
    placed = save(placed, "placed")
    may = sieve(placed.select(F.xxhash64("file", "row").alias("key")))
    texts = own.select("file", "row", "text").where(may(F.xxhash64("file", "row"))).hint("merge").join(placed, ["file", "row"]).select("node", "part", "block", "text")
    sets = texts.mapInArrow(tidy(_sets(width)), "node long, part long, block int, shingles binary")
    several = placed.where("blocks > 1").head(1)
    if several:
        sets = save(sets, "sets")
    edges = sets.groupBy("part", "block").applyInArrow(_verify(threshold), "u long, v long")
    if several:
        edges = save(edges, "similar")
        edges = edges.unionByName(save(_cross_blocks(sets, placed, edges, block_docs, threshold), "across"))
    final = connected_components(edges, stars=not several)  # a part of one block is a group of its own, so its edges are stars

    grouped = nodes.join(final, "node", "left").select("node", "twin", "first", "n", F.coalesce("component", "node").alias("part"))
    kept = grouped.groupBy("part").agg(F.min("first").alias("kept"), F.sum("n").alias("rows")).where("rows > 1").drop("rows")
    members = grouped.join(kept, "part").select("node", "twin", "kept")
    rows = signed.select("node", "twin", F.struct("id", "file", "row").alias("own")).join(members, ["node", "twin"]).where("own <> kept")
    return rows.select(F.col("own.id").alias("doc_id"), F.col("kept.id").alias("duplicate_of"), F.col("own.file").alias("file"), F.col("own.row").alias("row"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.6) -> DataFrame:
    """docs without the rows that near_duplicates() returns, which also says what counts as one; all columns as they are."""
    docs = as_scan(docs)
    file, row = free_name(docs, "__at_file"), free_name(docs, "__at_row")
    gone = save(near_duplicates(docs, id_col, text_col, threshold).select(F.col("file").alias(file), F.col("row").alias(row)), "near")
    marked = docs.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(row))
    return without(marked, gone, [file, row]).drop(file, row)
