import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from recordloom.llm import text as T
from recordloom.llm.common import union_find


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab Z.é\n日-9", max_size=30), max_size=8))
def test_words_of_the_kernel_are_the_words_of_the_plain_rule(texts):
    h, at = T.word_hashes(pa.array(texts, pa.large_string()))
    plain = [T.words(t) for t in texts]
    assert np.diff(at).tolist() == [len(w) for w in plain]
    seen = {}
    for w, x in zip([w for ws in plain for w in ws], h.tolist(), strict=True):
        assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


def test_long_texts_hash_as_short_ones(monkeypatch):
    rng = random.Random(1)
    texts = [" ".join("w" * rng.randint(1, 9) for _ in range(n)) for n in (0, 5, 4000)]
    column = pa.array(texts, pa.large_string())
    whole = T.word_hashes(column)
    monkeypatch.setattr(T, "SLICE_BYTES", 64)
    cut = T.word_hashes(column)
    assert whole[0].tolist() == cut[0].tolist() and whole[1].tolist() == cut[1].tolist()


def test_shingles_and_distinct():
    h, at = T.word_hashes(pa.array(["a b c d", "a b", "", "a b c a b c"], pa.large_string()))
    s, sat = T.shingles(h, at, 3)
    assert np.diff(sat).tolist() == [2, 1, 0, 4]
    assert s[0] == s[3] == s[6]
    d, dat = T.distinct(s, sat)
    assert np.diff(dat).tolist() == [2, 1, 0, 3]
    one, _ = T.distinct(s[3:], np.array([0, 4]))
    assert one.tolist() == d[dat[3] :].tolist()


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 15), st.integers(0, 15)), max_size=25))
def test_union_find(edges):
    if not edges:
        return
    node, root = union_find(*np.array(edges).T)
    label = {int(n): int(n) for n in node}
    for _ in edges:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert {int(n): int(r) for n, r in zip(node, root, strict=True)} == label
