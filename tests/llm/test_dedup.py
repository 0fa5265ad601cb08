import random

import numpy as np
import pytest
from pyspark.sql.functions import lit

from recordloom.llm import minhash, streamdedup
from recordloom.llm import text as T
from recordloom.llm.common import connected_components
from tests.llm.helpers import SCHEMA, docs, empty, hard, prose, row


def test_connected_components_both_ways(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(300)] + [(None, 1), (5, 5)] + [(1000 + k, 1001 + k) for k in range(60)]
    df = spark.createDataFrame(edges, "a long, b long")
    small = {tuple(r) for r in connected_components(df).collect()}
    large = {tuple(r) for r in connected_components(df, single_task_edges=0).collect()}
    assert small == large
    label = {}
    for a, b in edges:
        if a is not None and a != b:
            label.setdefault(a, a), label.setdefault(b, b)
    for _ in range(400):
        before = dict(label)
        for a, b in edges:
            if a is not None and a != b:
                label[a] = label[b] = min(label[a], label[b])
        if before == label:
            break
    assert small == set(label.items())


def shingle_set(text, width=3):
    w = T.words(text)
    return {" ".join(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()


def brute_groups(rows, threshold=0.6):
    sets = {d: shingle_set(t) for d, t in rows if d is not None and t}
    ids = sorted(d for d, s in sets.items() if s)
    up = {d: d for d in ids}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            common = len(sets[a] & sets[b])
            if common and common >= threshold * (len(sets[a]) + len(sets[b]) - common):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {(d, top(d)) for d in ids if top(d) != d}


def edited(rng, text, share):
    return " ".join("".join(rng.sample("abcdefgh", 5)) if rng.random() < share else w for w in text.split())


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(5)
    texts = []
    for _ in range(25):
        base = prose(rng, rng.randint(40, 300))
        texts += [base] + [edited(rng, base, rng.choice([0.0, 0.01, 0.03, 0.3])) for _ in range(rng.randint(0, 3))]
    base = prose(rng, 200)
    texts += [edited(rng, base, 0.04) for _ in range(60)]  # one large group
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    want = brute_groups(rows)
    got = {tuple(r)[:2] for r in minhash.near_duplicates(docs(spark, texts)).collect()}
    pairs = lambda g: {d for d, _ in g}
    assert len(pairs(got) & pairs(want)) >= 0.9 * len(pairs(want))
    assert got - want == set() or all(d in dict(want) for d, _ in got)
    assert {tuple(r)[:2] for r in minhash.near_duplicates(docs(spark, texts), block_docs=20).collect()} == got
    assert {tuple(r)[:2] for r in minhash.near_duplicates(docs(spark, texts), block_shingles=3000).collect()} == got


def test_blocks_of_one_part_against_brute_force(spark):
    rng = random.Random(15)
    texts, shared = [], prose(rng, 12)
    for _ in range(6):  # families that share a passage, so that all are candidates of one another
        base = prose(rng, 30)
        texts += [f"{shared} {base} {edited(rng, base, 0.1)} {prose(rng, 12)}" for _ in range(12)]
    want = brute_groups(list(enumerate(texts)), 0.35)
    assert len(want) == 66
    for size in (5, 20, 1000):
        got = {tuple(r)[:2] for r in minhash.near_duplicates(docs(spark, texts), threshold=0.35, r=1, block_docs=size).collect()}
        assert got == want


def test_rows_that_share_an_id_are_documents_of_their_own(spark):
    rng = random.Random(4)
    x, y, z = prose(rng, 60), prose(rng, 60), prose(rng, 60)
    rows = [row(1, x), row(2, x + " more"), row(2, y), row(2, z), row(3, z), row(3, y + " end")]
    for order in (rows, rows[::-1], rows[2:] + rows[:2]):
        frame = spark.createDataFrame(order, SCHEMA).coalesce(1)
        assert sorted(tuple(r)[:2] for r in minhash.near_duplicates(frame).collect()) == [(2, 1), (3, 2), (3, 2)]
        assert sorted(r.text for r in minhash.deduplicate(frame).collect()) == sorted([x, y, z])


def test_pairs_just_above_the_threshold_are_found(spark):
    rng = random.Random(9)
    texts, pairs = [], 0
    while pairs < 600:  # isolated pairs of a similarity of 0.60 to 0.62
        words = prose(rng, 120).split()
        other = list(words)
        for at in rng.sample(range(5, 115), 10):
            other[at] = prose(rng, 1)
        a, b = shingle_set(" ".join(words)), shingle_set(" ".join(other))
        if 0.6 <= len(a & b) / len(a | b) <= 0.62:
            texts += [" ".join(words), " ".join(other)]
            pairs += 1
    found = {(r.doc_id, r.duplicate_of) for r in minhash.near_duplicates(docs(spark, texts)).collect()}
    assert found <= {(2 * k + 1, 2 * k) for k in range(pairs)}
    assert len(found) >= 0.9 * pairs


def test_verification_is_exact():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50)).astype(np.uint64)) for _ in range(80)]
    label = minhash.similar_groups(sets, 0.4)
    plain = [set(s.tolist()) for s in sets]
    want = list(range(80))
    for _ in range(80):
        for i in range(80):
            for j in range(80):
                if len(plain[i] & plain[j]) >= 0.4 * len(plain[i] | plain[j]):
                    want[i] = want[j] = min(want[i], want[j])
    assert label.tolist() == want


def test_near_duplicates_of_hard_rows(spark):
    got = sorted(tuple(r)[:2] for r in minhash.near_duplicates(hard(spark)).collect())
    assert got == [(6, 5), (6, 5)]
    kept = minhash.deduplicate(hard(spark))
    assert kept.columns == hard(spark).columns and kept.count() == hard(spark).count() - 2
    assert minhash.near_duplicates(empty(spark)).collect() == []


def test_exact_duplicates_of_hard_rows(spark):
    got = sorted((r.doc_id, r.duplicate_of) for r in streamdedup.duplicates(hard(spark)).collect())
    assert got == [(6, 5), (6, 5), (8, 2)]
    kept = streamdedup.deduplicate(hard(spark))
    assert kept.columns == hard(spark).columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(x for x in ids if x is not None) == [1, 2, 3, 4, 5, 7, 9, 10, 11] and None in ids
    assert streamdedup.duplicates(empty(spark)).count() == 0


def test_state_lives_on_and_first_decisions_stand(spark, tmp_path):
    folder, state = f"{tmp_path}/docs", f"file://{tmp_path}/state"
    spark.createDataFrame([row(10, "x"), row(11, "y")], SCHEMA).coalesce(1).write.parquet(folder)
    assert streamdedup.duplicates(spark.read.parquet(folder), state_dir=state).count() == 0
    spark.createDataFrame([row(1, "x"), row(2, "z"), row(3, "z")], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    got = sorted((r.doc_id, r.duplicate_of) for r in streamdedup.duplicates(spark.read.parquet(folder), state_dir=state).collect())
    assert got == [(1, 10), (3, 2)]


def test_exact_duplicates_across_folders(spark, tmp_path):
    frame = docs(spark, ["a b", "c", "d", "e", "f"], start=10).withColumn("lang", lit("x"))
    again = docs(spark, ["c", "d", "g"], start=1).withColumn("lang", lit("y"))  # smaller ids, in a later folder
    frame.unionByName(again).unionByName(docs(spark, ["d"], start=30).withColumn("lang", lit("z"))).write.partitionBy("lang").parquet(f"{tmp_path}/parts")
    table = spark.read.parquet(f"{tmp_path}/parts")
    assert {(r.doc_id, r.duplicate_of) for r in streamdedup.duplicates(table).collect()} == {(11, 1), (12, 2), (30, 2)}
    assert {r.doc_id for r in streamdedup.deduplicate(table).collect()} == {10, 1, 2, 13, 14, 3}


def test_exact_duplicates_where_digests_clash(spark, monkeypatch):
    monkeypatch.setattr(streamdedup, "digest", lambda text: streamdedup.F.substring(text.cast("binary"), 1, 1))
    texts = ["ab", "ac", "ab", "ac", "ad", "b", "b", "", ""]
    got = {(r.doc_id, r.duplicate_of) for r in streamdedup.duplicates(docs(spark, texts)).collect()}
    assert got == {(2, 0), (3, 1), (6, 5), (8, 7)}


def test_exact_duplicates_in_files_of_any_name(spark, tmp_path):
    (tmp_path / "files").mkdir()
    for k, name in enumerate(("one", "two{3,4}", "three.parquet")):
        docs(spark, ["same", f"other {k}"], start=10 * k).coalesce(1).write.parquet(f"{tmp_path}/{k}")
        next((tmp_path / str(k)).glob("part-*")).rename(tmp_path / "files" / name)
    table = spark.read.parquet(f"{tmp_path}/files")
    assert {(r.doc_id, r.duplicate_of) for r in streamdedup.duplicates(table).collect()} == {(10, 0), (20, 0)}


@pytest.mark.parametrize("n", [1, 3])
def test_exact_duplicates_by_bytes(spark, n):
    texts = ["a", "a ", "A", "a", "é", "é", "a"] * n
    got = {(r.doc_id, r.duplicate_of) for r in streamdedup.duplicates(docs(spark, texts)).collect()}
    first = {}
    want = {(k, first[t]) for k, t in enumerate(texts) if first.setdefault(t, k) != k}
    assert got == want
