"""Checking one record file, and cancelling work that runs."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from recordloom.errors import SheetError
from recordloom.operators.normalize import normalize_record
from recordloom.operators.validate import document_issues
from recordloom.plans.config import SheetConfig
from recordloom.sources import markdown, toml


@dataclass
class FileReport:
    """exit_code: 0 fine, 1 not canonical, 22 breaks the schema, 64 can't be parsed."""

    exit_code: int
    issues: list[dict] = field(default_factory=list)
    text: str | None = None


def check_file(text: str, config: SheetConfig) -> FileReport:
    """Parse, validate and compare with the canonical form; the report has that form where there is one."""
    try:
        record = toml.parse(text) if config.format == "toml" else markdown.parse(text, config.body or "body", config.title)
        if config.schema and (bad := document_issues(toml.to_plain(record), config.schema)):
            return FileReport(22, bad)
        own = normalize_record(record, config.sort)
        canonical = toml.serialize(own) if config.format == "toml" else markdown.serialize(own, config.body or "body", config.title)
    except SheetError as e:
        return FileReport(64, [{"path": "", "code": e.code, "message": str(e)}])
    return FileReport(0 if canonical == text else 1, [], canonical)


def fix_file(path: str, config: SheetConfig) -> FileReport:
    """check_file() of a local file, rewritten where only its form was off."""
    with open(path, newline="") as f:
        report = check_file(f.read(), config)
    if report.exit_code == 1 and report.text is not None:
        with open(path, "w", newline="") as f:
            f.write(report.text)
        report.exit_code = 0
    return report


class Abort:
    """Cancels the jobs of one block."""

    def __init__(self, spark: SparkSession):
        self._spark, self.tag, self.aborted = spark, f"abort-{uuid.uuid4().hex}", False

    def abort(self) -> None:
        self.aborted = True
        self._spark.interruptTag(self.tag)

    def check(self) -> None:
        if self.aborted:
            raise SheetError("aborted", "aborted")


@contextlib.contextmanager
def abortable(spark: SparkSession) -> Iterator[Abort]:
    """Jobs that start in the block carry a tag; abort(), from any thread, stops them."""
    own = Abort(spark)
    spark.addTag(own.tag)
    try:
        yield own
    finally:
        spark.removeTag(own.tag)
