"""The driver's entry points, with and without the corpus operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry
from recordloom.streaming.ingest import upsert_stream
from recordloom.store import Store

ROOT = Path(__file__).resolve().parent.parent


def test_names_agree():
    names = entry.queries()
    assert len(names) > 80 and set(entry.oracle_sql()) <= set(names)


def test_flagship(spark):
    if Path("/root/testdata/sf0.001").exists():
        assert entry.entry(spark).count() > 0


def test_the_rest_stands_without_the_corpus_operators(tmp_path):
    for part in ("recordloom", "__spark_entry__.py"):
        source = ROOT / part
        shutil.copytree(source, tmp_path / part, ignore=shutil.ignore_patterns("llm", "__pycache__")) if source.is_dir() else shutil.copy(source, tmp_path / part)
    code = "import __spark_entry__ as e, sys; n = e.queries(); assert len(n) > 70 and not [x for x in n if x.startswith('op') or x == 'pipeline']; assert set(e.oracle_sql()) <= set(n)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


def test_nothing_else_imports_the_corpus_operators():
    for p in (ROOT / "recordloom").rglob("*.py"):
        if "llm" not in p.parts:
            assert "recordloom.llm" not in p.read_text(), p


def test_stream_of_upserts(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    with store.transact() as tx:
        tx.write_config("users", {"path": "${{ slug }}"})
    for k in range(2):
        spark.createDataFrame([(f"u{k}", k), ("same", k)], "slug string, n int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("slug string, n int").parquet(str(tmp_path / "in"))
        upsert_stream(store, "users", stream, str(tmp_path / "check")).awaitTermination()
    store.refresh()
    assert {(r.slug, r.n) for r in store.sheet("users").query().collect()} == {("u0", 0), ("u1", 1), ("same", 1)}
    assert sum(bool(c.trailers) for c in store.log()) == 2
