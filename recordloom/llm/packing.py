"""Packing documents into training sequences by bin completion.

Best-fit decreasing gives the first incumbent.  Where it needs more sequences
than the volume bound, a branch-and-bound search takes the largest document that
is left, enumerates the undominated ways to fill up its sequence, and recurses;
a branch ends as soon as its waste exceeds what a better packing could afford.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import as_scan, save
from recordloom.llm.tokens import VOCABULARY, count_tokens


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: bins of indexes into sizes, which must be in descending order."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []
    for i, size in enumerate(sizes):
        at = bisect_left(room, (size, -1))
        if at == len(room):
            bins.append([i])
            left, b = capacity - size, len(bins) - 1
        else:
            left, b = room.pop(at)
            bins[b].append(i)
            left -= size
        if left:
            insort(room, (left, b))
    return bins


def _undominated(filling: list[int], counts: Counter, present: int, slack: int) -> bool:
    """Whether no subset of the filling can be replaced by one larger left-out document that still fits.

    counts: how often each size is left, the filling among them; present: the same as a set of bits.
    """
    sums = 1
    for x in filling:
        sums |= sums << x
    for x, n in Counter(filling).items():
        if counts[x] == n:
            present &= ~(1 << x)
    spread, wide = sums << 1, 1  # what is larger than a sum by 1 to wide
    while wide < slack:
        more = min(wide, slack - wide)
        spread |= spread << more
        wide += more
    return not slack or not spread & present


def fillings(sizes: list[int], room: int, waste: int, most: int | None = None, steps: int = 4000) -> Iterator[list[int]]:
    """Undominated sets of positions in sizes (descending) that fit into room and leave at most waste, fullest first.

    They come one by one as they are asked for, all of them if most is None and
    there are steps enough; the first one comes whatever the steps.  The sums that
    the smaller sizes can reach are known as bits, so no step leads nowhere.
    """
    falling = [-s for s in sizes]  # ascending, for bisect
    counts = Counter(sizes)
    present = sum(1 << s for s in counts)
    fits = (1 << (room + 1)) - 1
    reach = [1] * (len(sizes) + 1)
    for k in range(len(sizes) - 1, bisect_left(falling, -room) - 1, -1):
        reach[k] = reach[k + 1] | (reach[k + 1] << sizes[k] & fits)
    least = bisect_left(falling, -room)
    found = 0
    for slack in range(min(waste, room) + 1):
        if not reach[least] >> (room - slack) & 1:
            continue
        chosen: list[int] = []
        stack: list[tuple[int, int, int, int | None]] = [(least, room - slack, 0, None)]
        while stack:
            at, left, depth, own = stack.pop()
            del chosen[depth:]
            if own is not None:
                chosen.append(own)
            steps -= 1
            if found and (steps < 0 or found == most):
                return
            if not left:
                if _undominated([sizes[i] for i in chosen], counts, present, slack):
                    found += 1
                    yield list(chosen)
                continue
            at = bisect_left(falling, -left, at)
            # leave out all of this size: equal documents are interchangeable
            after = bisect_right(falling, falling[at], at)
            if reach[after] >> left & 1:
                stack.append((after, left, len(chosen), None))
            if reach[at + 1] >> (left - sizes[at]) & 1:
                stack.append((at + 1, left - sizes[at], len(chosen), at))


def complete(sizes: list[int], capacity: int, nodes: int = 2000, most: int | None = None, steps: int = 4000) -> list[list[int]]:
    """Bins of indexes into sizes (descending, each at most capacity): best-fit decreasing, improved by bin completion.

    nodes bounds the search, most (None: no bound) and steps the fillings of each
    node; a packing is optimal where its number of bins equals the larger of the
    volume bound and the number of documents over half of the capacity, or the
    search ended without meeting any of these limits.
    """
    incumbent = best_fit(sizes, capacity)
    total = sum(sizes)
    bound = max(-(-total // capacity), sum(2 * s > capacity for s in sizes))
    if len(incumbent) <= bound:
        return incumbent
    done: list[list[int]] = []
    frames: list[tuple[list[int], int, Iterator[list[int]]]] = []  # the k-th one fills the k-th bin of done
    left, wasted = list(range(len(sizes))), 0
    while True:
        affordable = (len(incumbent) - 1) * capacity - total - wasted
        if not left:
            if len(done) < len(incumbent):
                incumbent = [list(b) for b in done]
            if len(incumbent) == bound:
                return incumbent
        elif affordable >= 0 and len(done) + 1 < len(incumbent):
            nodes -= 1
            if nodes < 0:
                return incumbent
            frames.append((left, wasted, fillings([sizes[i] for i in left[1:]], capacity - sizes[left[0]], affordable, most, steps)))
        while frames:
            left, wasted, options = frames[-1]
            del done[len(frames) - 1 :]
            filling = next(options, None) if (len(incumbent) - 1) * capacity - total - wasted >= 0 else None
            if filling is not None:
                break
            frames.pop()
        else:
            return incumbent
        done.append([left[0], *(left[k + 1] for k in filling)])
        inside = {0, *(k + 1 for k in filling)}
        wasted += capacity - sum(sizes[i] for i in done[-1])
        left = [x for k, x in enumerate(left) if k not in inside]


def pack(
    docs: DataFrame,
    capacity: int = 4096,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str = VOCABULARY,
    shard_pieces: int = 800,
) -> DataFrame:
    """Plan of training sequences: (bin_id, slot, doc_id, start, length, bin_tokens).

    A document is its tokens and an end mark.  Documents of more than capacity
    are cut; the full pieces are sequences of their own and the last piece is
    packed with the other documents, start being its place in the document.
    Pieces are dealt to shards of about shard_pieces by a hash of the document
    and of its row in its file, so an id that many rows share is spread, and each shard is packed by itself; more than that gains next to nothing,
    since a shard wastes less than one sequence beyond its volume bound.

    Null texts and null ids are in no sequence; an empty text is an end mark; a
    very long text fills as many sequences as it needs.
    Rows that repeat an id are packed each for itself.  Of pieces of one size,
    those of smaller ids come first.  An empty table gives an empty result.
    """
    known = as_scan(docs).where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    counted = save(count_tokens(known, id_col, text_col, vocabulary, F.col("_metadata.row_index")), "lengths")
    n = counted.count()
    shards = max(1, -(-n // shard_pieces))
    shard = F.pmod(F.xxhash64("doc_id", "salt"), F.lit(shards)).alias("shard")

    def run(table: pa.Table) -> pa.Table:
        ids, length = table.column("doc_id").to_numpy(), table.column("n_tokens").to_numpy() + 1
        shard = table.column("shard")[0].as_py()
        pieces: list[tuple[int, int, int]] = []  # length, doc, start
        full: list[tuple[int, int, int]] = []
        for d, n in zip(ids.tolist(), length.tolist(), strict=True):
            whole = n // capacity
            full += [(capacity, d, k * capacity) for k in range(whole)]
            if n % capacity:
                pieces.append((n % capacity, d, whole * capacity))
        pieces.sort(key=lambda p: (-p[0], p[1], p[2]))
        full.sort(key=lambda p: (p[1], p[2]))
        bins = [[p] for p in full] + [[pieces[i] for i in b] for b in complete([p[0] for p in pieces], capacity)]
        rows = [((shard << 32) + k, slot, d, start, n, sum(p[0] for p in b)) for k, b in enumerate(bins) for slot, (n, d, start) in enumerate(b)]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["bin_id", "slot", "doc_id", "start", "length", "bin_tokens"])

    return counted.select("doc_id", "n_tokens", shard).groupBy("shard").applyInArrow(run, "bin_id long, slot int, doc_id long, start long, length long, bin_tokens long")
