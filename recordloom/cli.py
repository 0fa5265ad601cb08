"""Command line: python -m recordloom.cli --store DIR COMMAND ...

Exit codes are those of the errors: 22 invalid input, 64 configuration, 65
conflicts, 66 unknown references, 67 missing records, 69 transactions, 70 others.
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.errors import NotFoundError, SheetError, ValidationError
from recordloom.operators import analytics as A
from recordloom.operators import check as C
from recordloom.operators import diff as D
from recordloom.operators import write as W
from recordloom.operators.normalize import documents
from recordloom.plans import config as cfg
from recordloom.plans import contracts
from recordloom.sources import records as R
from recordloom.store import Store


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="recordloom", description=__doc__)
    p.add_argument("--store", required=True)
    p.add_argument("--branch", default="main")
    sub = p.add_subparsers(dest="command", required=True)

    def add(command: str, /, *flags: str, sheet: bool = True, **extra: dict) -> argparse.ArgumentParser:
        c = sub.add_parser(command)
        if sheet:
            c.add_argument("sheet")
        for f in flags:
            c.add_argument(f, action="store_true")
        for f, options in extra.items():
            c.add_argument(f"--{f.replace('_', '-')}", **options)
        return c

    many: dict[str, Any] = {"action": "append", "default": []}
    add("sheets", sheet=False)
    add("view")
    add("init", path={"required": True}, root={"default": "."})
    add("query", "--desc", "--no-body", filter=many, fields={}, sort={}, limit={}, group_by={}, format={"default": "json"}, export={}, ref={})
    add("count", filter=many)
    add("distinct", filter=many).add_argument("field")
    add("read", "--full").add_argument("path")
    for name in ("upsert", "patch"):
        add(name, "--dry-run", "--delete-missing", data={}, file={}, format={}, on_missing={"default": "abort"})
    add("delete", filter=many, path=many)
    c = add("rename")
    c.add_argument("old")
    c.add_argument("new")
    add("diff", "--patches", "--renames", limit={}, to={}).add_argument("ref")
    add("infer", "--write")
    add("normalize")
    add("migrate-config")
    add("check", "--fix").add_argument("files", nargs="+")
    add("log", sheet=False)
    c = add("contracts", sheet=False, sheet_name=many, name={}, document={}, mode={"default": "verify"})
    c.add_argument("action", choices=["adopt", "verify", "test", "sync", "export", "prune", "list"])
    c = add("attachment", file=many, name={}, out={})
    c.add_argument("action", choices=["set", "get", "list", "delete"])
    c.add_argument("path")
    return p


def _emit(rows: DataFrame, limit: int | None = None) -> None:
    for d in documents(rows if limit is None else rows.limit(limit), ()):
        print(json.dumps(d, ensure_ascii=False))


def _batch(spark: SparkSession, a: argparse.Namespace, sheet: Any) -> DataFrame:
    """Records from a file, or from text on the command line or the standard input."""
    if a.file:
        return R.read(spark, a.file, a.format)
    found = R.parse_input(a.data if a.data is not None else sys.stdin.read())
    texts = spark.createDataFrame([(json.dumps(r),) for r in found], "document string")
    rows = R.from_documents(texts)
    known = {f.name: f.dataType for f in sheet.records().schema.fields}
    return rows.select(*[F.col(f"`{c}`").cast(known[c]).alias(c) if c in known and known[c] != rows.schema[c].dataType else F.col(f"`{c}`") for c in rows.columns])


def _document(path: str) -> dict:
    with open(path) as f:
        text = f.read()
    from recordloom.sources import toml

    return json.loads(text) if path.endswith(".json") else toml.parse(text)


def run(spark: SparkSession, argv: Sequence[str]) -> int:
    """Run one command; returns the exit code."""
    a = parser().parse_args(argv)
    try:
        return _run(spark, a)
    except SheetError as e:
        print(json.dumps({"error": e.code, "message": str(e), "issues": getattr(e, "issues", [])}, default=str), file=sys.stderr)
        return e.exit_code


def _run(spark: SparkSession, a: argparse.Namespace) -> int:
    store = Store(spark, a.store, a.branch)
    name = getattr(a, "sheet", None)
    if a.command == "sheets":
        for s in store.summary():
            print(json.dumps(s))
    elif a.command == "log":
        for c in store.log():
            print(json.dumps({"id": c.id, "parent": c.parent, "author": c.author, "message": c.text()}))
    elif a.command == "init":
        with store.transact(f"Declare {name}") as tx:
            tx.write_config(name, cfg.scaffold(a.path, root=a.root))
    elif a.command == "contracts":
        return _contracts(store, a)
    elif a.command == "migrate-config":
        table, warnings = cfg.migrate(store.sheet(name).config.raw)
        with store.transact(f"Migrate {name}") as tx:
            tx.write_config(name, table)
        print(json.dumps({"warnings": warnings}))
    else:
        return _on_sheet(spark, store, a, name)
    return 0


def _on_sheet(spark: SparkSession, store: Store, a: argparse.Namespace, name: str) -> int:
    sheet = store.sheet(name, getattr(a, "ref", None) if a.command == "query" else None)
    rows = sheet.visible(sheet.records())
    if a.command == "view":
        print(json.dumps(sheet.describe()))
    elif a.command == "query":
        if a.no_body and sheet.config.body:
            rows = rows.drop(sheet.config.body)
        if a.group_by:
            _emit(A.facets(rows, a.group_by, a.filter))
            return 0
        if a.export:
            n = R.export(A.query(sheet.where(a.filter), (), a.sort, a.desc), a.export, a.format, a.fields.split(",") if a.fields else None)
            print(json.dumps({"exported": n, "file": a.export}))
            return 0
        found = A.query(sheet.where(a.filter), (), a.sort, a.desc, A.clamp_limit(a.limit), a.fields.split(",") if a.fields else None)
        sys.stdout.write(R.to_text(list(documents(found, () if a.fields else ("_blob",))), a.format, a.fields.split(",") if a.fields else None))
        shown = A.shown_of_total(rows, a.filter, a.limit).first()
        print(f"{shown.shown} of {shown.total} total", file=sys.stderr)
    elif a.command == "count":
        _emit(A.count(rows, a.filter))
    elif a.command == "distinct":
        _emit(A.distinct(rows, a.field, a.filter))
    elif a.command == "read":
        found = list(documents(W.read_paths(rows, spark.createDataFrame([(a.path,)], "_path string")), ("_blob",)))
        if len(found[0]) < 2:
            raise NotFoundError(f"no record at {a.path!r}", "record_not_found")
        body = sheet.config.body
        if body and not a.full and len(found[0].get(body, "")) > 500:
            found[0][body] = f"{found[0][body][:500]}… (truncated, {len(found[0][body])} chars total)"
        print(json.dumps(found[0], ensure_ascii=False))
    elif a.command == "upsert":
        batch = _batch(spark, a, sheet)
        if a.dry_run:
            plan = W.upsert_plan(rows, W.prepare(batch, sheet.config.path, sheet.effective_schema(), sheet.config.sort))
            _emit(W.categories(plan).orderBy("category"))
            _emit(W.invalid_rows(plan))
        else:
            _emit(sheet.upsert(batch, a.delete_missing))
    elif a.command == "patch":
        batch = _batch(spark, a, sheet)
        if a.dry_run:
            _emit(W.patch_plan(rows, batch, sheet.config.path).groupBy("_status").agg(F.count("*").alias("count")))
        else:
            with store.transact(f"{name}: patch") as tx:
                tx.bulk_patch(name, batch, a.on_missing, a.delete_missing)
    elif a.command == "delete":
        if not a.filter and not a.path:
            raise ValidationError("delete needs a filter or a path", "input_invalid")
        with store.transact(f"{name}: delete") as tx:
            n = tx.delete_where(name, a.filter) if a.filter else 0
            for path in a.path:
                tx.delete(name, path)
        print(json.dumps({"deleted": n + len(a.path)}))
    elif a.command == "rename":
        with store.transact(f"{name}: rename {a.old}") as tx:
            tx.rename(name, a.old, a.new)
    elif a.command == "diff":
        old, new = (store.sheet(name, r) for r in (a.ref, a.to))
        before, after = old.visible(old.records()), new.visible(new.records())
        found = D.with_patches(before, after, renames=a.renames) if a.patches else D.changes(before, after, renames=a.renames)
        _emit(D.limited(found, a.limit))
        print(f"{found.count()} changes", file=sys.stderr)
    elif a.command == "infer":
        schema = A.infer(rows.drop("_path", "_blob"))
        if a.write and schema != sheet.config.schema:
            with store.transact(f"{name}: infer schema") as tx:
                tx.write_config(name, {**sheet.config.raw, "schema": schema})
        print(json.dumps(schema))
    elif a.command == "normalize":
        with store.transact(f"{name}: normalize") as tx:
            n = tx.normalize(name)
        print(json.dumps({"changed": n}))
    elif a.command == "check":
        worst = 0
        for path in a.files:
            if a.fix:
                report = C.fix_file(path, sheet.config)
            else:
                with open(path, newline="") as f:
                    report = C.check_file(f.read(), sheet.config)
            print(json.dumps({"file": path, "exit": report.exit_code, "issues": report.issues}))
            worst = max(worst, report.exit_code)
        return worst
    elif a.command == "attachment":
        if a.action == "list":
            _emit(sheet.attachments(a.path).select("name", "hash", F.octet_length("bytes").alias("size")))
        elif a.action == "get":
            data, _ = sheet.attachment(a.path, a.name)
            with open(a.out, "wb") as f:
                f.write(data)
        else:
            with store.transact(f"{name}: attachment of {a.path}") as tx:
                if a.action == "delete":
                    tx.detach(name, a.path, a.name)
                else:
                    files = {}
                    for path in a.file:
                        with open(path, "rb") as f:
                            files[a.name or path.rsplit("/", 1)[-1]] = f.read()
                    tx.attach(name, a.path, files)
    return 0


def _contracts(store: Store, a: argparse.Namespace) -> int:
    if a.action == "list":
        print(json.dumps(contracts.vendored(store)))
    elif a.action == "prune":
        print(json.dumps(contracts.prune(store)))
    elif a.action == "export":
        print(contracts.export(store, a.name))
    elif a.action == "adopt":
        contracts.adopt(store, a.name, _document(a.document), a.sheet_name)
    elif a.action == "sync":
        state = contracts.sync(store, a.name, _document(a.document))
        print(json.dumps({"state": state}))
        return 0 if state == "match" else 1
    else:
        bad = 0
        for s in a.sheet_name:
            document = _document(a.document) if a.document else contracts.load(store._configs(), a.name)
            report = contracts.test(store.sheet(s), document) if a.action == "test" else contracts.verify(store, store.sheet(s), a.name, document, a.mode)
            print(json.dumps({"sheet": s, "rung": report.rung, "conforms": report.conforms, "issues": report.issues}))
            bad += not report.conforms
        return 22 if bad else 0
    return 0


def main() -> int:
    spark = SparkSession.builder.appName("recordloom").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return run(spark, sys.argv[1:])


if __name__ == "__main__":
    sys.exit(main())
