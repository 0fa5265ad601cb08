import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from recordloom.llm import decontam, nbsvm, pii
from recordloom.llm import text as T
from tests.llm.helpers import SCHEMA, docs, empty, hard, prose, row


def labelled(spark, n=400, seed=1):
    rng = random.Random(seed)
    texts, labels = [], []
    for k in range(n):
        words = prose(rng, rng.randint(20, 80)).split()
        bad, toxic = rng.random() < 0.3, rng.random() < 0.3
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["moron", "clown"])
        text = " ".join(w.upper() + "!!" if bad else w for w in words)
        texts.append(text)
        labels.append((k, int(not bad), int(toxic)))
    return docs(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), texts, labels


def test_held_out_accuracy(spark):
    frame, labels, texts, truth = labelled(spark)
    model = nbsvm.train(frame.where("doc_id < 250"), labels)
    q, t, some = model.margins(pa.array(texts[250:], pa.large_string()))
    want = np.array(truth[250:])
    assert some.all()
    assert ((q >= 0) == (want[:, 1] == 1)).mean() > 0.97
    clean = want[:, 2] == 0
    assert ((t >= 0) == ~clean)[want[:, 1] == 1].mean() > 0.9


def test_dual_coordinate_descent_is_optimal():
    rng = np.random.default_rng(2)
    rows = [np.unique(rng.integers(0, 12, 5)).astype(np.uint32) for _ in range(60)]
    y = np.where(np.array([(3 in r) for r in rows]), 1.0, -1.0)
    r = rng.normal(size=12)
    p = nbsvm.Params(mix=1.0, epochs=2000)
    w, b = nbsvm.fit(rows, y, r, p)
    v = np.where(r != 0, w / r, 0)

    def loss(v, b):
        m = np.array([v[x] @ r[x] + b for x in rows])
        return 0.5 * (v @ v + b * b) + np.maximum(0, 1 - y * m).sum()

    best = loss(v, b)
    for _ in range(300):
        assert loss(v + rng.normal(size=12) * 0.02, b + rng.normal() * 0.02) >= best - 1e-2


def test_log_ratios_count_all_labelled_rows(spark):
    frame, labels, texts, truth = labelled(spark, 60)
    small = nbsvm.train(frame, labels, nbsvm.Params(sample_per_class=5))
    assert small.quality is not None
    a = nbsvm.log_ratios(np.array([30.0, 0, 5]), np.array([1.0, 0, 5]), 40, 40, nbsvm.Params())
    assert a[0] > 2 and a[1] == 0 and a[2] == 0


def test_quality_filter_of_hard_rows(spark):
    _, labels, _, _ = labelled(spark)
    frame, _, _, _ = labelled(spark)
    kept = nbsvm.quality_filter(hard(spark), labels)
    assert kept.columns == hard(spark).columns
    assert not {1, 2, 3} & {r.doc_id for r in kept.collect()}
    none = nbsvm.quality_filter(frame, labels.where("false"))
    assert none.count() == frame.count()
    one = nbsvm.quality_filter(frame, labels.where("quality = 1 and toxic = 0"))
    assert one.count() == frame.count()
    assert nbsvm.quality_filter(empty(spark), labels).count() == 0
    odd = spark.createDataFrame([(1, None, 5), (None, 1, 1), (4, 1, 0), (4, 1, 0), (5, 0, 1)], "doc_id long, quality int, toxic int")
    assert nbsvm.classify(hard(spark), odd).columns == ["doc_id", "quality_margin", "toxicity_margin"]
    assert nbsvm.classify(hard(spark), odd).count() <= 13


def lcs(a, b):
    last = [0] * (len(b) + 1)
    for x in a:
        row_ = [0]
        for j, y in enumerate(b):
            row_.append(last[j] + 1 if x == y else max(row_[-1], last[j + 1]))
        last = row_
    return last[-1]


def test_lcs_kernel_against_the_textbook():
    rng = np.random.default_rng(4)
    patterns = [rng.integers(0, 9, n).astype(np.uint32) for n in (1, 5, 30, 64, 90)]
    words = rng.integers(0, 9, 400).astype(np.uint32)
    owner = rng.integers(0, 5, 60)
    start = rng.integers(0, 380, 60)
    stop = start + rng.integers(0, 20, 60)
    want = [lcs(patterns[o].tolist(), words[a : min(b, 400)].tolist()) for o, a, b in zip(owner, start, stop, strict=True)]
    for p in (decontam.Patterns(patterns, block=2), decontam.Patterns(patterns, tabled=40), decontam.Patterns(patterns, block_words=70)):
        assert p.lcs(owner, words, start, np.minimum(stop, 400)).tolist() == want


def planted(seed=7, n=60):
    rng = random.Random(seed)
    items = [prose(rng, rng.randint(15, 90)) for _ in range(12)]
    texts, truth = [], set()
    for k in range(n):
        words = prose(rng, rng.randint(30, 400)).split()
        if k % 3 == 0:
            i = k // 3 % 12
            own = items[i].split()
            if k % 2:
                own = [word if rng.random() > 0.12 else "other" for word in own]
            at = rng.randint(0, len(words))
            words[at:at] = own
            truth.add((k, i))
        texts.append(" ".join(words))
    return items, texts, truth


def test_contamination_against_planted_and_brute_force(spark):
    items, texts, truth = planted()
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs(spark, texts), benchmark).collect()}
    assert got == truth
    kept = decontam.decontaminate(docs(spark, texts), benchmark)
    assert {r.doc_id for r in kept.collect()} == set(range(60)) - {d for d, _ in truth}


def test_decontamination_judges_rows_not_ids(spark):
    rng = random.Random(3)
    item, clean = prose(rng, 40), prose(rng, 90)
    rows = [row(1, clean), row(1, f"{clean} {item}"), row(None, item), row(None, prose(rng, 50)), row(2, prose(rng, 80))]
    frame = spark.createDataFrame(rows, SCHEMA)
    kept = decontam.decontaminate(frame, spark.createDataFrame([(7, item)], "item_id long, text string"))
    assert kept.columns == frame.columns
    assert sorted(r.text for r in kept.collect()) == sorted([clean, rows[3][1], rows[4][1]])


def test_contamination_in_passes_and_with_answers(spark):
    items, texts, truth = planted()
    benchmark = spark.createDataFrame([(k, t, "answer words") for k, t in enumerate(items)], "item_id long, text string, answer string")
    p = decontam.Params(words_per_pass=700)
    got = {(r.doc_id, r.item_id, r.answer) for r in decontam.contaminated(docs(spark, texts), benchmark, p).collect()}
    assert {x[:2] for x in got} == truth and not any(x[2] for x in got)


def searched(texts, items):
    """(document, item) pairs of the search alone, in a space of random word vectors."""
    vectors = np.random.default_rng(5).normal(size=(decontam._D, 56)).astype(np.float32)
    batch = decontam._pack(pa.array(range(len(texts)), pa.int64()), *T.word_hashes(pa.array(texts, pa.large_string())))
    groups = decontam.prepare_items([(k, t, None) for k, t in enumerate(items)], vectors, decontam.Params())
    run = decontam._search(SimpleNamespace(value=groups), SimpleNamespace(value=vectors), decontam.Params())
    return {(d, i) for b in run(iter([batch])) for d, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)}


@pytest.mark.parametrize("size", [150, 200, 260, 400, 1000])
def test_long_items_are_found_wherever_they_lie(size):
    rng = random.Random(size)
    items = [prose(rng, size), prose(rng, 40), prose(rng, 700)]
    edited = [" ".join(w if rng.random() > 0.2 else prose(rng, 1) for w in items[0].split()) for _ in range(4)]
    longer = [" ".join(w if rng.random() > 0.15 else f"{w} {prose(rng, 1)}" for w in items[0].split()) for _ in range(4)]
    copies = [items[0]] * 4 + edited + longer
    texts = [" ".join([prose(rng, a), copy, prose(rng, b)]) for copy, (a, b) in zip(copies, [(0, 0), (0, 500), (500, 0), (333, 333)] * 3, strict=True)]
    others = [prose(rng, 2000) for _ in range(5)] + [" ".join(items[0].split()[: size // 2]) + " " + prose(rng, 600)]
    assert searched(texts + others, items) == {(k, 0) for k in range(len(texts))}


@pytest.mark.parametrize("size", [20, 46, 50, 91])
def test_items_at_the_head_of_a_document_are_found_behind_any_neighbour(size):
    rng = random.Random(size)
    items = [prose(rng, 91), prose(rng, size)]
    texts = []
    for k in range(1, 65):  # every length of the neighbour modulo the step
        texts += [prose(rng, k), f"{items[1]} {prose(rng, 300)}", prose(rng, 64 - k), items[1]]
    assert searched(texts, items) == {(d, 1) for d in range(len(texts)) if d % 2}


def test_every_word_of_a_document_is_in_a_window(monkeypatch):
    rng, sizes = random.Random(2), [*range(1, 130), 50, 50, 300]
    starts = []

    def windows(g, sums, cosine):
        block, piece, value = own(g, sums, -2.0)
        starts.extend((g.window, x * decontam._BLOCK) for x in block.tolist())
        return block, piece, value

    own = decontam.candidates
    monkeypatch.setattr(decontam, "candidates", windows)
    pads = []
    pad = decontam._pad
    monkeypatch.setattr(decontam, "_pad", lambda *x: pads.append(pad(*x)) or pads[-1])
    searched([prose(rng, n) for n in sizes], [prose(rng, n) for n in (20, 30, 60, 91)])
    for wide in (16, 32, 64, 128):
        at = {x for w, x in starts if w == wide}
        assert {int(x) for x in pads[0][1]} <= at


def every_window(texts, items, p=decontam.Params()):
    """Pairs by the textbook: every stretch of a document against every item, without search, window or bound."""
    found = set()
    for i, item in enumerate(items):
        own = T.words(item)
        answer = own[-p.answer_words :]
        for d, text in enumerate(texts):
            words = T.words(text)
            # a stretch of twice the item, starting anywhere
            for at in range(0, max(1, len(words) - len(own) // 2), max(1, len(own) // 10)):
                stretch = words[at : at + 2 * len(own)]
                share = decontam._lcs_long(np.array(own, dtype=object), np.array(stretch, dtype=object)) / len(own)
                if share >= p.certain or (share >= p.likely and lcs(answer, stretch) >= p.answer_found * len(answer)):
                    found.add((d, i))
                    break
    return found


def test_search_against_every_window(spark):
    rng = random.Random(31)
    items = [prose(rng, n) for n in (12, 25, 40, 64, 100, 300, 900, 2500, 5000)]
    texts = []
    for k, item in enumerate(items * 3):
        words = item.split()
        copy = [words, [w if rng.random() > 0.25 else prose(rng, 1) for w in words], [w for w in words if rng.random() > 0.5]][k // len(items)]
        texts.append(" ".join([prose(rng, rng.randint(0, 200)), *copy, prose(rng, rng.randint(0, 200))]))
    texts += [prose(rng, rng.randint(5, 3000)) for _ in range(10)] + items[:3]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs(spark, texts), benchmark).collect()}
    want = every_window(texts, items)
    assert {(k, k) for k in range(9)} <= want
    assert got == want


def test_contamination_of_long_items(spark):
    rng = random.Random(12)
    items = [prose(rng, n) for n in (200, 400, 1000)]
    texts = [f"{prose(rng, 70 * k)} {items[k % 3]} {prose(rng, 150)}" for k in range(9)] + [prose(rng, 500) for _ in range(9)]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs(spark, texts), benchmark).collect()}
    assert got == {(k, k % 3) for k in range(9)}


def test_contamination_of_hard_rows(spark):
    benchmark = spark.createDataFrame([(1, None), (2, ""), (None, "one"), (3, "nothing of that kind at all here")], "item_id long, text string")
    assert decontam.contaminated(hard(spark), benchmark).count() == 0
    assert decontam.contaminated(empty(spark), benchmark).count() == 0
    assert decontam.contaminated(hard(spark), benchmark.where("false")).count() == 0
    assert decontam.decontaminate(hard(spark), benchmark).count() == hard(spark).count()


def test_pii_against_planted(spark):
    rng = random.Random(2)
    card = "4111111111111111"
    texts = ["write to ann.b@mail.example.com now", f"visa {card} and again later {card}", "call +1 (274) 555-9629 today", "server 10.20.30.40 is down", "password=f8cb0ab732d29a210e", prose(rng, 50), "version 1.2.3 of 2019 costs 300", "IBAN none"]
    found = pii.find(docs(spark, texts)).collect()
    got = {(r.doc_id, r.label, texts[r.doc_id][r.start : r.end]) for r in found}
    assert got == {(0, "EMAIL", "ann.b@mail.example.com"), (1, "CARD", card), (2, "PHONE", "+1 (274) 555-9629"), (3, "IP", "10.20.30.40"), (4, "SECRET", "password=f8cb0ab732d29a210e")}
    assert len([r for r in found if r.doc_id == 1]) == 2
    clean = {r.doc_id: r.text for r in pii.redact(docs(spark, texts)).collect()}
    assert clean[0] == "write to [EMAIL] now" and clean[5] == texts[5]


def test_pii_inside_of_runs(spark):
    texts = [
        "ssn 123-45-6789 ok", "token xoxb-abcdefghij-klmnop", "a@b.com;c@d.com", "write a@b.com\u00a0now", "see http://10.0.0.1:8080/x", "call +44 20 7946 0958 today", "联系zhang@example.com谢谢",
        '{"email":"ann@b.org","phone":"555-123-4567"}', "(ann.b@x.com)", "mailto:bob@x.org", "at 10:30 we sold 1,234,567 for 3.14 on 2019-02-03", "see https://example.org/2019/02/03?id=123456789 ok",
    ]
    want = [
        ["123-45-6789"], ["xoxb-abcdefghij-klmnop"], ["a@b.com", "c@d.com"], ["a@b.com"], ["10.0.0.1"], ["+44 20 7946 0958"], ["zhang@example.com"], ["ann@b.org", "555-123-4567"], ["ann.b@x.com"], ["bob@x.org"], [], [],
    ]
    found = sorted((r.doc_id, r.start, r.end) for r in pii.find(docs(spark, texts)).collect())
    assert [[texts[d][a:b] for d, a, b in found if d == k] for k in range(len(texts))] == want
    assert pii.redact(docs(spark, texts[6:7])).first().text == "联系[EMAIL]谢谢"


def brute_marginals(unary, edges, tables):
    """Marginals by the sum over all labellings."""
    n, k = unary.shape
    total = np.zeros((n, k))
    for y in np.ndindex(*[k] * n):
        p = np.exp(sum(unary[i, y[i]] for i in range(n)) + sum(t[y[a], y[b]] for (a, b), t in zip(edges, tables, strict=True)))
        for i in range(n):
            total[i, y[i]] += p
    return total / total.sum(axis=1, keepdims=True)


def test_find_against_all_labellings(spark):
    model, rng = pii.trained(), random.Random(12)
    parts = ["call 555-123-4567", "visa 4111111111111111 and 4111111111111111", "key f8cb0ab732d29a210e", "in 2019", "a1@b.com", "host 10.2.3.4", "+1 (274) 555-9629", "page 12", "covid-19", "ssn 123-45-6789"]
    texts = [" of ".join(rng.sample(parts, 3)) for _ in range(25)]
    want = []
    for d, text in enumerate(texts):
        found = pii.tokens_of(text)
        tokens = [t for _, _, t in found]
        at = [k for k, t in enumerate(tokens) if pii.is_open(t)]
        features, chain, skip = pii.graph(tokens, at)
        p = brute_marginals(np.array([model.unary[f].sum(axis=0) for f in features]), chain + skip, [model.chain] * len(chain) + [model.skip] * len(skip))
        want += [(d, found[a][0] + tokens[a].find(pii.core(tokens[a])), pii.LABELS[p[k].argmax()]) for k, a in enumerate(at) if p[k].argmax()]
    got = [(r.doc_id, r.start, r.label) for r in pii.find(docs(spark, texts)).collect()]
    merged = {x for x in want if x[2] not in ("PHONE", "CARD")}
    assert {x for x in got if x[2] not in ("PHONE", "CARD")} == merged and set(got) <= set(want) and len(got) >= 25


def test_a_cue_reaches_every_repeat():
    model = pii.trained()
    body = ["key", "=", "k9q2"] + [t for _ in range(50) for t in ("and", "k9q2")]
    at = [k for k, t in enumerate(body) if t == "k9q2"]
    features, chain, skip = pii.graph(body, at)
    unary = np.zeros((len(at), len(pii.LABELS)))
    unary[0, 5] = 8.0  # one mention is certain, the others know nothing
    table = np.eye(len(pii.LABELS)) * 4
    p = pii.marginals(unary, np.array(chain + skip), np.array([table] * (len(chain) + len(skip))))
    assert (p.argmax(axis=1) == 5).all() and model.skip[5, 5] > 0


def test_held_out_labels_and_skip_edges():
    model = pii.trained()
    right = total = 0
    for tokens, labels in pii.training_documents(200, seed=77):
        nodes = [k for k, t in enumerate(tokens) if pii.is_open(t)]
        if nodes:
            got, _ = pii.label_nodes(tokens, nodes, model)
            right += sum(int(a == labels[p]) for a, p in zip(got, nodes, strict=True))
            total += len(nodes)
    assert right / total > 0.95
    assert np.diag(model.skip).mean() > model.skip[~np.eye(len(pii.LABELS), dtype=bool)].mean()


def test_message_passing_is_exact_on_trees():
    rng = np.random.default_rng(6)
    unary = rng.normal(size=(4, 3))
    edges = np.array([(0, 1), (1, 2), (1, 3)])
    tables = rng.normal(size=(3, 3, 3))
    total = np.zeros((4, 3))
    for a in range(3):
        for b in range(3):
            for c in range(3):
                for d in range(3):
                    y = (a, b, c, d)
                    p = np.exp(sum(unary[k, y[k]] for k in range(4)) + sum(tables[e][y[i], y[j]] for e, (i, j) in enumerate(edges)))
                    for k in range(4):
                        total[k, y[k]] += p
    assert np.allclose(pii.marginals(unary, edges, tables, rounds=60, damp=0.0), total / total.sum(axis=1, keepdims=True), atol=1e-6)


def test_pii_of_hard_rows(spark):
    assert pii.find(hard(spark)).count() == 0
    assert pii.find(empty(spark)).count() == 0
    two = spark.createDataFrame([row(None, "a@b.com"), row(1, "x a@b.com"), row(1, "x a@b.com")])
    two = two.toDF(*hard(spark).columns)
    assert sorted((r.doc_id or -1, r.start) for r in pii.find(two).collect()) == [(-1, 0), (1, 2), (1, 2)]
    assert pii.redact(hard(spark)).where("text is null").count() == 1


def test_words_in_brute_force_agree():
    assert T.words("It's A-B é 9") == ["it", "s", "a", "b", "é", "9"]


def brute_features(text):
    """Feature buckets of one text by plain loops over its words and token shapes."""
    half = nbsvm.BUCKETS // 2
    h = T.word_hashes(pa.array([text], pa.large_string()))[0]
    words = T.words(text)
    assert len(words) == len(h)
    own = {int(x) % half for x in h}
    with np.errstate(over="ignore"):
        own |= {int(T.mix(np.array([a * np.uint64(3) + b]))[0]) % half + half for a, b in zip(h[:-1], h[1:], strict=True)}
        shapes = []
        for token in text.split():
            code = "".join("a" if c.islower() or ord(c) > 127 else "A" if c.isupper() else "9" if c.isdigit() else c for c in token)
            code = "".join(c for k, c in enumerate(code) if k == 0 or code[k - 1] != c).encode()
            shapes.append(T.span_hashes(np.frombuffer(code, dtype=np.uint8), np.array([0]), np.array([len(code)]))[0])
        one, two = ([T.mix(np.array([s + np.uint64(k)]))[0] for s in shapes] for k in (7, 9))
        own |= {int(x) % half + half for x in one}
        own |= {int(T.mix(np.array([a * np.uint64(3) + b]))[0]) % half + half for a, b in zip(two[:-1], two[1:], strict=True)}
    return own


def test_classify_against_brute_force(spark):
    """Counts, log ratios and scores by plain loops; the fit itself by a slow projected subgradient on the dual."""
    frame, labels, texts, truth = labelled(spark, 120)
    p = nbsvm.Params(epochs=400, mix=1.0)
    rows = [brute_features(t) for t in texts]
    margins = []
    for column in (1, 2):
        y = np.array([1.0 if t[column] else -1.0 for t in truth])
        used = sorted(set().union(*rows))
        at = {f: k for k, f in enumerate(used)}
        x = np.zeros((len(rows), len(used)))
        for k, own in enumerate(rows):
            x[k, [at[f] for f in own]] = 1.0
        a, b = x[y > 0].sum(axis=0) + 1, x[y < 0].sum(axis=0) + 1
        r = np.log(a / ((y > 0).sum() + 2)) - np.log(b / ((y < 0).sum() + 2))
        r[np.abs(r) < p.least_z * np.sqrt(1 / a + 1 / b)] = 0.0
        z = np.hstack([x * r, np.ones((len(rows), 1))]) * y[:, None]
        gram, alpha = z @ z.T, np.zeros(len(rows))
        for _ in range(30_000):
            alpha = np.clip(alpha - (gram @ alpha - 1.0) / np.linalg.norm(gram, 2), 0, p.c)
        margins.append(np.hstack([x * r, np.ones((len(rows), 1))]) @ (z.T @ alpha))
    quality, toxic = margins
    got = {r.doc_id: (r.quality_margin, r.toxicity_margin) for r in nbsvm.classify(frame, labels, p).collect()}
    clear = [k for k in range(120) if abs(quality[k]) > 0.02 and abs(toxic[k]) > 0.02]
    assert len(clear) > 100
    assert {k for k in clear if k in got} == {k for k in clear if quality[k] >= 0 and toxic[k] < 0}
    assert all(abs(got[k][0] - quality[k]) < 0.02 and abs(got[k][1] - toxic[k]) < 0.02 for k in got)
