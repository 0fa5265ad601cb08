"""The pipeline against a brute-force version on a small fixture."""

import random

import pyarrow as pa
import pytest

import corpus_pipeline
from recordloom.llm import common, decontam, minhash, nbsvm, packing, queries, streamdedup
from tests.llm.helpers import empty, hard, prose
from tests.llm.test_dedup import brute_groups

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Good prose, shouted junk, insults, copies, near copies and benchmark items; with what each document is."""
    rng = random.Random(11)
    at = tmp_path_factory.mktemp("sf")
    items = [prose(rng, 40) for _ in range(5)]
    texts, kinds = [], []

    def add(text, kind):
        texts.append(text)
        kinds.append(kind)

    for k in range(240):
        text = prose(rng, rng.randint(40, 120))
        kind = k % 8
        if kind == 0:
            add(" ".join(w.upper() + "!!" for w in text.split()), "junk")
        elif kind == 1:
            words = text.split()
            words[5:5] = ["moron", "clown"]
            add(" ".join(words), "toxic")
        elif kind == 2:
            words = text.split()
            words[10:10] = items[k % 5].split()
            add(" ".join(words), "leak")
        else:
            add(text, "good")
    for k in range(20):
        add(texts[8 * k + 3], "copy")
        words = texts[8 * k + 4].split()
        words[7] = "changed"
        add(" ".join(words), "near")
    add(None, "null")
    add("", "empty")
    order = list(range(len(texts)))
    rows = [(i, texts[i], "en", f"s{i % 3}", len(texts[i] or "")) for i in order]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    labels = [(i, int(kinds[i] != "junk"), int(kinds[i] == "toxic")) for i in order if i % 2 == 0 or kinds[i] in ("toxic", "junk")]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at), texts, kinds


def test_stages_keep_the_columns_and_the_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "exact_dedup", "minhash_near_dedup", "benchmark_decontamination", "best_fit_packing"]


def test_run_against_brute_force(spark, tables):
    at, texts, kinds = tables
    kept = [i for i, k in enumerate(kinds) if k not in ("junk", "toxic", "null", "empty")]
    first: dict = {}
    kept = [i for i in kept if first.setdefault(texts[i], i) == i]
    gone = {d for d, _ in brute_groups([(i, texts[i]) for i in kept])}
    kept = [i for i in kept if i not in gone and kinds[i] != "leak"]
    rows = corpus_pipeline.run(spark, at).collect()
    assert {r.doc_id for r in rows} == set(kept)
    assert len(rows) == len(kept) and all(r.start == 0 and r.bin_tokens <= 4096 for r in rows)


def test_each_stage_on_its_own_input(spark, tables):
    at, texts, kinds = tables
    docs = spark.read.parquet(f"{at}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    drop = {"quality_classifier": {"junk", "toxic", "null", "empty"}, "exact_dedup": {"copy"}, "minhash_near_dedup": {"copy", "near"}, "benchmark_decontamination": {"leak"}}
    for name, kind in drop.items():
        out = stages[name](spark, docs, at)
        assert out.columns == COLUMNS
        assert {r.doc_id for r in out.collect()} == {i for i, k in enumerate(kinds) if k not in kind}, name


def _nodes(plan):
    """(name, Python steps of the task so far) of every node of a physical plan, from the last one up."""
    todo = [(plan, 0)]
    while todo:
        node, steps = todo.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append((node.initialPlan(), steps))
            continue
        steps = 0 if name.endswith("Exchange") else steps + (name.endswith(("InArrow", "EvalPython")))
        yield name, steps
        todo += [(node.children().apply(k), steps) for k in range(node.children().size())]


def test_no_task_needs_two_python_workers(spark, tables, monkeypatch):
    """A second worker stays on its executor through the later stages; so do workers that rows of Python objects start."""
    plans = []

    def noted(df, *rest, kept=common.save):
        plans.append(df._jdf.queryExecution().executedPlan())
        return kept(df, *rest)

    for module in (common, decontam, minhash, nbsvm, packing, streamdedup):
        monkeypatch.setattr(module, "save", noted)
    docs = spark.read.parquet(f"{tables[0]}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        plans.append(stage(spark, docs, tables[0])._jdf.queryExecution().executedPlan())
    minhash.near_duplicates(docs, block_docs=10)
    nodes = [x for plan in plans for x in _nodes(plan)]
    assert max(steps for _, steps in nodes) == 1
    assert not [name for name, _ in nodes if "ExistingRDD" in name]


def test_tidy_changes_no_batch():
    batches = [pa.RecordBatch.from_pydict({"a": [k]}) for k in range(3)]
    step = common.tidy(iter)
    assert list(step(iter(batches))) == batches
    assert next(step(iter(batches))) == batches[0]


def test_queries_are_registered():
    names = list(queries.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert set(queries.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_hard_and_empty_tables(spark, tables, tmp_path, name):
    at, _, _ = tables
    for k, frame in enumerate((hard(spark), empty(spark))):
        frame.write.parquet(f"{tmp_path}/{k}")
        out = dict(corpus_pipeline.STAGES)[name](spark, spark.read.parquet(f"{tmp_path}/{k}"), at)
        rows = out.collect()
        if k:
            assert rows == []
        elif name == "best_fit_packing":
            assert {r.doc_id for r in rows} == {2, 3, 4, 5, 6, 7, 8, 9, 10, 11}
        else:
            assert out.columns == frame.columns
            ids = sorted(r.doc_id for r in rows if r.doc_id is not None)
            want = {
                "quality_classifier": None,
                "exact_dedup": [1, 2, 3, 4, 5, 7, 9, 10, 11],
                "minhash_near_dedup": [1, 2, 3, 4, 5, 7, 8, 9, 10, 11],
                "benchmark_decontamination": [1, 2, 3, 4, 5, 6, 6, 7, 8, 9, 10, 11],
            }[name]
            assert ids == want if want else not {1, 2, 3} & set(ids)
