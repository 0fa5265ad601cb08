"""Records of a git repository: one TOML or Markdown file each, at any commit."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.errors import ReferenceError_
from recordloom.sources import markdown, toml


def _git(repo: str, *args: str) -> bytes:
    done = subprocess.run(["git", "-c", "safe.directory=*", "-C", repo, *args], capture_output=True)
    if done.returncode:
        raise ReferenceError_(f"git {' '.join(args[:2])}: {done.stderr.decode(errors='replace').strip()}", "ref_not_found")
    return done.stdout


def resolve(repo: str, ref: str = "HEAD") -> str:
    """Tree of a branch, tag or commit; anything else is ref_not_found."""
    return _git(repo, "rev-parse", "--verify", "--quiet", f"{ref}^{{tree}}").decode().strip()


def blobs(spark: SparkSession, repo: str, ref: str = "HEAD", base: str = "", extension: str = ".toml") -> DataFrame:
    """(_path, _blob) of the files below base: the listing only, no contents. Hidden folders don't count."""
    tree = resolve(repo, ref)
    base = "/".join(p for p in base.split("/") if p not in ("", "."))
    rows = []
    for entry in _git(repo, "ls-tree", "-r", "-z", tree, *([f"{base}/"] if base else [])).decode(errors="surrogateescape").split("\0"):
        if not entry:
            continue
        meta, path = entry.split("\t", 1)
        kind, sha = meta.split()[1:3]
        own = path[len(base) + 1 :] if base else path
        if kind == "blob" and own.endswith(extension) and not any(p.startswith(".") for p in own.split("/")[:-1]):
            rows.append((own[: -len(extension)], sha))
    return spark.createDataFrame(rows, "_path string, _blob string")


def texts(listing: DataFrame, repo: str) -> DataFrame:
    """listing with the text of every blob; each task reads its own through one git process, so all executors must see the repository."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        git = subprocess.Popen(["git", "-c", "safe.directory=*", "-C", repo, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE)
        assert git.stdin and git.stdout
        try:
            for batch in batches:
                out = []
                for sha in batch.column("_blob").to_pylist():
                    git.stdin.write(f"{sha}\n".encode())
                    git.stdin.flush()
                    size = int(git.stdout.readline().split()[2])
                    out.append(git.stdout.read(size).decode("utf-8", "replace"))
                    git.stdout.read(1)
                yield pa.RecordBatch.from_arrays([batch.column("_path"), batch.column("_blob"), pa.array(out, pa.string())], names=["_path", "_blob", "text"])
        finally:
            git.stdin.close()
            git.wait()

    return listing.mapInArrow(run, "_path string, _blob string, text string")


def read(spark: SparkSession, repo: str, ref: str = "HEAD", base: str = "", format: str = "toml", body: str = "body", parallel: int | None = None) -> DataFrame:
    """(_path, _blob, document) of all records at a commit, document being the fields as JSON; Markdown has its body, too."""
    listing = blobs(spark, repo, ref, base, {"toml": ".toml", "markdown": ".md", "mdx": ".mdx"}[format])
    rows = texts(listing.repartition(parallel or spark.sparkContext.defaultParallelism, "_path"), repo)
    if format == "toml":
        return rows.select("_path", "_blob", toml.parse_column(F.col("text")).alias("document"))
    return rows.select("_path", "_blob", toml.parse_column(markdown.front_column(F.col("text"))).alias("document"), markdown.body_column(F.col("text")).alias(body))
