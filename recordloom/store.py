"""The store: sheets, immutable snapshots, a commit log, references and transactions.

Records of a sheet live as Parquet, partitioned by the leading components of the
path template.  A snapshot is a list of directories, each without the partitions
that a later one replaces: a write that touches few partitions writes those only,
and every few writes the whole sheet is written again as one directory.  A commit
is a small JSON file that maps sheets to snapshots; a reference is a file that
holds a commit id and is replaced in one step, so readers always see a whole
commit and a writer that lost a race is told so.
"""

from __future__ import annotations

import contextlib
import hashlib
import json
import os
import re
import threading
import time
import uuid
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.errors import ConfigError, IndexError_, NotFoundError, ReferenceError_, TransactionError
from recordloom.operators import filters as flt
from recordloom.operators import index as idx
from recordloom.operators import validate as val
from recordloom.operators import write as wr
from recordloom.operators.analytics import first as first_row
from recordloom.operators.diff import changes
from recordloom.operators.normalize import join_path, mime_type
from recordloom.operators.patch import merge_columns
from recordloom.plans import config as cfg
from recordloom.plans.template import Template
from recordloom.sources.fs import Files

_TRAILER = re.compile(r"[A-Za-z][A-Za-z0-9-]*")
_ATTACHMENTS = "_path string, name string, bytes binary, hash string"
_EMPTY = hashlib.sha1(b"tree 0\0").hexdigest()
#: Directories of a snapshot, and partitions replaced by one write, beyond which the whole sheet is written.
MAX_BASES, MAX_TOUCHED = 8, 2000
#: Age at which a lock counts as left behind.
LOCK_SECONDS = 600


@dataclass(frozen=True)
class Snapshot:
    """Directories with the partitions that later ones replace, and the number and the sum of hashes of all records."""

    bases: tuple[tuple[str, tuple[str, ...]], ...]
    rows: int
    mix: int

    @property
    def id(self) -> str:
        return f"{self.rows}-{self.mix % 2**64:016x}"

    def text(self) -> str:
        return json.dumps({"bases": self.bases, "rows": self.rows, "mix": self.mix})

    @staticmethod
    def of(text: str) -> Snapshot:
        d = json.loads(text)
        return Snapshot(tuple((b, tuple(w)) for b, w in d["bases"]), d["rows"], d["mix"])


def _mix(blob: str) -> Column:
    return F.sum(F.xxhash64("_path", blob).cast("decimal(38,0)"))


def _both_sums() -> tuple[Column, Column]:
    return F.count("*").alias("n"), _mix("_blob").alias("mix")


def _sums(df: DataFrame) -> tuple[int, int]:
    n, mix = df.agg(*_both_sums()).first()
    return n, int(mix or 0)


def _partition_key(template: Template) -> Column:
    """Partition of a record by its path: the leading components, joined."""
    return F.substring_index("_path", "/", len(template.components) - 1)


@dataclass(frozen=True)
class Commit:
    id: str
    parent: str | None
    sheets: dict[str, str]
    attachments: dict[str, str]
    configs: dict[str, str]
    message: str
    author: str
    time: float
    tree: str
    trailers: tuple[tuple[str, str], ...] = ()

    def text(self) -> str:
        lines = [self.message, *([""] if self.trailers else []), *[f"{k}: {v}" for k, v in self.trailers]]
        return "\n".join(lines)


def check_trailers(trailers: Mapping[str, str] | Sequence[tuple[str, str]]) -> tuple[tuple[str, str], ...]:
    out = tuple(trailers.items() if isinstance(trailers, Mapping) else trailers)
    for k, v in out:
        if not _TRAILER.fullmatch(k):
            raise ConfigError(f"invalid trailer name {k!r}", "config_invalid")
        if "\n" in str(v) or "\r" in str(v):
            raise ConfigError(f"trailer {k!r} can't hold line breaks", "config_invalid")
    return out


class Store:
    """Sheets below one directory, bound to the snapshot of a reference until refresh()."""

    _active: set[str] = set()
    _guard = threading.Lock()

    def __init__(self, spark: SparkSession, root: str, branch: str = "main", prefix: str = "", strict: bool = False, validators: Mapping[str, Callable[[DataFrame], DataFrame]] | None = None, author: str | None = None):
        self.spark, self.branch, self.prefix, self.strict = spark, branch, prefix, strict
        self.files = Files(spark, root)
        self.root = self.files.root
        self.validators, self.author = dict(validators or {}), author
        self.hooks: list[Callable[[Commit], None]] = []
        for d in ("refs", "commits", "data"):
            self.files.mkdirs(d)
        spark.conf.set("spark.sql.sources.partitionColumnTypeInference.enabled", "false")
        self.head = self.read_ref(branch)
        self._indexes: dict[str, list[idx.Index]] = {}
        self._built: dict[tuple[str, str, str], DataFrame] = {}
        self._held = False
        for name in self.validators:
            if name not in self.sheet_names():
                raise ConfigError(f"a validator names the sheet {name!r}, which is not declared", "config_missing")

    # references and commits:

    def data(self, snapshot: str) -> str:
        return self.files.at("data", snapshot)

    def key(self, name: str) -> str:
        """What the records of a sheet are filed under: stores of one place with different prefixes share declarations, not records."""
        return join_path(self.prefix, name)

    def read_base(self, base: str) -> DataFrame:
        """One directory of a snapshot, by the schema that was noted when it was written, so that no file has to be opened for it and none has to be there."""
        known = self.files.read("data", base, "_schema")
        reader = self.spark.read
        return (reader.schema(T.StructType.fromJson(json.loads(known))) if known else reader).parquet(self.data(base))

    def read_snapshot(self, snapshot: Snapshot, template: Template) -> DataFrame:
        """Records of a snapshot; replaced partitions are pruned by partition filters."""
        parts = template.partition_names()
        out: DataFrame | None = None
        for base, without in snapshot.bases:
            df = self.read_base(base)
            if without:
                df = df.where(~F.concat_ws("/", *parts).isin(list(without)))
            out = df if out is None else out.unionByName(df, allowMissingColumns=True)
        assert out is not None
        return out

    def read_ref(self, name: str) -> str | None:
        return (self.files.read("refs", name) or "").strip() or None

    def write_ref(self, name: str, commit: str) -> None:
        self.files.replace(commit, "refs", name)

    def commit(self, ref: str | None) -> Commit | None:
        """The commit of a reference or (the beginning of) a commit id; None for the empty tree."""
        if ref is None or ref == _EMPTY:
            return None
        at = self.read_ref(ref) if "/" not in ref else None
        if at is None:
            found = [f[:-5] for f in self.files.names("commits") if f.startswith(ref) and f.endswith(".json")] if len(ref) >= 4 else []
            if len(found) != 1:
                raise ReferenceError_(f"no commit or reference {ref!r}", "ref_not_found")
            at = found[0]
        d = json.loads(self.files.read("commits", f"{at}.json") or "null")
        if d is None:
            raise ReferenceError_(f"no commit {at!r}", "ref_not_found")
        return Commit(**{**d, "trailers": tuple(map(tuple, d["trailers"]))})

    def log(self, ref: str | None = None) -> Iterator[Commit]:
        """Commits from a reference back to the first."""
        c = self.commit(ref or self.head)
        while c is not None:
            yield c
            c = self.commit(c.parent)

    def refresh(self) -> None:
        """Bind to what the reference points at now."""
        self.head = self.read_ref(self.branch)
        self._drop_built()

    def drift(self) -> dict[str, list[str]]:
        """Sheets with records that break a contract they implement, with the codes of the issues: for a look after refresh()."""
        out = {}
        for name, sheet in self.sheets().items():
            if sheet.config.implements:
                codes = [r.code for r in sheet.issues().select("code").distinct().orderBy("code").collect()]
                if codes:
                    out[name] = codes
        return out

    def _drop_built(self) -> None:
        for df in self._built.values():
            df.unpersist()
        self._built.clear()

    # sheets:

    def _configs(self, ref: str | None = None) -> dict[str, str]:
        c = self.commit(ref or self.head)
        return c.configs if c else {}

    def sheet_names(self, ref: str | None = None) -> list[str]:
        """Declared sheets, sorted; names with a slash are nested and don't count."""
        return sorted(n for n in self._configs(ref) if "/" not in n)

    def sheet(self, name: str, ref: str | None = None) -> Sheet:
        text = self._configs(ref).get(name)
        if text is None:
            raise ConfigError(f"no sheet {name!r} is declared", "config_missing")
        return Sheet(self, cfg.parse(name, text), ref)

    def sheets(self) -> dict[str, Sheet]:
        return {n: self.sheet(n) for n in self.sheet_names()}

    def summary(self) -> list[dict]:
        """Name, format, number of records and root of every sheet."""
        return [{"name": n, "format": s.config.format, "records": s.records().count(), "root": s.config.root} for n, s in self.sheets().items()]

    # transactions:

    @contextlib.contextmanager
    def lock(self) -> Iterator[None]:
        """The only writer of this store; not to be taken twice.

        A lock is held for the moment of a commit only, so one that is older than
        LOCK_SECONDS was left by a writer that is gone, and is broken.
        """
        own = json.dumps({"owner": uuid.uuid4().hex, "time": time.time()})
        if not self.files.create(own, "lock"):
            with contextlib.suppress(ValueError, KeyError, TypeError):
                if time.time() - float(json.loads(self.files.read("lock") or "null")["time"]) > LOCK_SECONDS:
                    self.files.delete("lock")
            if not self.files.create(own, "lock"):
                raise TransactionError("the store is locked", "lock_held")
        try:
            yield
        finally:
            if self.files.read("lock") == own:
                self.files.delete("lock")

    @contextlib.contextmanager
    def transact(self, message: str = "Update records", author: str | None = None, trailers: Mapping[str, str] | Sequence[tuple[str, str]] = (), parent: str | None = None) -> Iterator[Transaction]:
        """One commit for all that the block does; an exception discards it, and so does having changed nothing."""
        checked = check_trailers(trailers)
        with Store._guard:
            if self.root in Store._active:
                raise TransactionError("another transaction is open", "transaction_in_progress")
            Store._active.add(self.root)
        try:
            base = self.commit(parent) if parent else self.commit(self.read_ref(self.branch))
            tx = Transaction(self, base)
            yield tx
            tx.closed = True
            tx.result = self._finish(tx, message, author, checked, moved_ok=parent is not None)
        finally:
            with Store._guard:
                Store._active.discard(self.root)

    def _finish(self, tx: Transaction, message: str, author: str | None, trailers: tuple[tuple[str, str], ...], moved_ok: bool) -> Commit | None:
        base = tx.base
        tree = hashlib.sha256(json.dumps([sorted(tx.hashes.items()), sorted(tx.configs.items()), sorted(tx.attachment_hashes.items())]).encode()).hexdigest()
        if not tx.mutated or base is not None and base.tree == tree:
            return None
        who = author or self.author or os.environ.get("RECORDLOOM_AUTHOR") or "Anonymous"
        body = {"parent": base.id if base else None, "sheets": tx.snapshots, "attachments": tx.attachments, "configs": tx.configs, "message": message, "author": who, "time": time.time(), "tree": tree, "trailers": list(trailers)}
        own = hashlib.sha1(json.dumps(body, sort_keys=True).encode()).hexdigest()
        with self.lock():
            now = self.read_ref(self.branch)
            if now != (base.id if base else None) and not moved_ok:
                raise TransactionError("the reference has moved since the transaction began", "parent_moved")
            self.files.replace(json.dumps({"id": own, **body}), "commits", f"{own}.json")
            self.write_ref(self.branch, own)
        self.refresh()
        done = self.commit(own)
        assert done is not None
        for hook in self.hooks:
            with contextlib.suppress(Exception):
                hook(done)
        return done

    def diff(self, name: str, old: str | None, new: str | None = None, **options: Any) -> DataFrame:
        """Changes of a sheet between two references; no old one means that all is added."""
        after = self.sheet(name, new).records()
        known = old is not None and name in self._configs(old)
        if not known:
            return changes(after.limit(0), after, **options)
        then, now = self.sheet(name, old), self.sheet(name, new)
        if then.snapshot and now.snapshot and then.config.path.source == now.config.path.source:
            before, after = self._unshared(Snapshot.of(then.snapshot), Snapshot.of(now.snapshot), now.config.path)
        else:
            before = then.records()
        return changes(before, after, **options)

    def _unshared(self, old: Snapshot, new: Snapshot, template: Template) -> tuple[DataFrame, DataFrame]:
        """Records of two snapshots but for those that they share: of a directory that both have, only partitions that one of them replaces."""
        parts = template.partition_names()
        theirs, ours = dict(old.bases), dict(new.bases)
        sides = []
        for own, other in ((theirs, ours), (ours, theirs)):
            out: DataFrame | None = None
            for base, without in own.items():
                more = set(other.get(base, ())) - set(without)
                df = self.read_base(base)
                at = F.concat_ws("/", *parts)
                if base in other:
                    df = df.where(at.isin(list(more))) if more and parts else df.where(F.lit(False))
                elif without:
                    df = df.where(~at.isin(list(without)))
                out = df if out is None else out.unionByName(df, allowMissingColumns=True)
            assert out is not None
            sides.append(out)
        return sides[0], sides[1]


class Sheet:
    """A sheet at one commit."""

    def __init__(self, store: Store, config: cfg.SheetConfig, ref: str | None = None):
        self.store, self.config, self.ref = store, config, ref
        self.commit = store.commit(ref or store.head)

    @property
    def snapshot(self) -> str | None:
        return self.commit.sheets.get(self.store.key(self.config.name)) if self.commit else None

    def location(self) -> str:
        """Where the records belong: the store's prefix below the sheet's root."""
        return join_path(self.config.root, self.store.prefix)

    def records(self, with_body: bool = True) -> DataFrame:
        """All records with _path and _blob; a sheet without a snapshot is empty."""
        if self.snapshot is None:
            names = self.config.path.field_names()
            empty = T.StructType([T.StructField(n, T.StringType()) for n in names] + [T.StructField("_path", T.StringType()), T.StructField("_blob", T.StringType())])
            return self.store.spark.createDataFrame([], empty)
        df = self.store.read_snapshot(Snapshot.of(self.snapshot), self.config.path)
        return df.drop(self.config.body) if self.config.body and not with_body else df

    def visible(self, df: DataFrame) -> DataFrame:
        return df.drop(*self.config.path.partition_names())

    def query(self, criteria: Mapping[str, Any] | None = None, with_body: bool = True) -> DataFrame:
        """Records that match a filter mapping, in path order.

        Equalities on the fields of leading path components also become
        equalities on partition columns, so other partitions aren't read; the
        filter itself stays, whatever was pruned.
        """
        criteria = dict(criteria or {})
        df = self.records()
        cond = flt.matching(df, criteria, self.config.body, with_body)
        prune = self.config.path.pruning(criteria, df.columns)
        if prune is not None:
            df = df.where(prune)
        df = df.where(cond) if criteria else df
        if self.config.body and not with_body:
            df = df.drop(self.config.body)
        return self.visible(df).orderBy("_path")

    def query_first(self, criteria: Mapping[str, Any] | None = None) -> dict | None:
        row = first_row(self.query(criteria)).head()
        return row.asDict(recursive=True) if row else None

    def candidate_paths(self, criteria: Mapping[str, Any]) -> DataFrame:
        """Paths in the partitions that a filter leaves, without reading records."""
        df = self.records()
        prune = self.config.path.pruning(criteria, df.columns)
        return (df.where(prune) if prune is not None else df).select("_path").orderBy("_path")

    def where(self, clauses: Iterable[str]) -> DataFrame:
        """Records that satisfy clauses of the filter language; equality clauses prune as in query()."""
        parsed = [flt.parse(c) for c in clauses]
        df = self.records()
        prune = self.config.path.pruning({f: v for f, op, v in parsed if op == "=" and v != "" and isinstance(df.schema[f].dataType if f in df.columns else None, T.StringType)}, df.columns)
        return self.visible(flt.where(df.where(prune) if prune is not None else df, parsed))

    def load_body(self, rows: DataFrame) -> DataFrame:
        """Rows without bodies, with them."""
        return rows if not self.config.body else rows.join(self.records().select("_path", self.config.body), "_path", "left")

    def effective_schema(self) -> dict | None:
        from recordloom.plans.contracts import compose

        return compose(self.store, self.config)

    def issues(self) -> DataFrame:
        schema = self.effective_schema()
        df = self.visible(self.records())
        return val.issues(df, schema if schema else {})

    def path_for(self, record: Mapping[str, Any]) -> str:
        """Path that a record would have."""
        return self.config.path.render_record(record)

    # writes outside of a transaction: one commit each:

    @contextlib.contextmanager
    def _auto(self, what: str) -> Iterator[Transaction]:
        if self.store.strict:
            raise TransactionError("writes need a transaction", "write_outside_transaction")
        with self.store.transact(f"{self.config.name}: {what}") as tx:
            yield tx
        self.commit = self.store.commit(self.store.head)

    def upsert(self, batch: DataFrame, delete_missing: bool = False) -> DataFrame:
        with self._auto("upsert") as tx:
            return tx.upsert(self.config.name, batch, delete_missing)

    def patch(self, criteria: Mapping[str, Any], patch: Mapping[str, Any]) -> str:
        with self._auto("patch") as tx:
            return tx.patch(self.config.name, criteria, patch)

    def delete(self, path: str) -> None:
        with self._auto(f"delete {path}") as tx:
            tx.delete(self.config.name, path)

    def clear(self) -> None:
        with self._auto("clear") as tx:
            tx.clear(self.config.name)

    def will_change(self, batch: DataFrame) -> DataFrame:
        """(_path, _category) that an upsert of the batch would have."""
        return wr.will_change(self.visible(self.records()), batch, self.config.path, self.effective_schema(), self.config.sort)

    # indexes:

    def define_index(self, name: str, key: idx.Key, unique: bool = False, eager: bool = False) -> None:
        own = self.store._indexes.setdefault(self.config.name, [])
        own[:] = [x for x in own if x.name != name] + [idx.define(name, key, unique, eager)]
        if eager:
            self._index(name).count()

    def _index(self, name: str) -> DataFrame:
        """Keys and records of an index, cached for this snapshot; a unique one is checked when it is built."""
        index = idx.by_name(self.store._indexes.get(self.config.name, []), name)
        at = (self.config.name, self.snapshot or "", name)
        if at not in self.store._built:
            rows = self.visible(self.records())
            if index.unique:
                idx.check_unique(rows, index)
            self.store._built[at] = idx.entries(rows, index, self.config.body).cache()
        return self.store._built[at]

    def find_by_index(self, name: str, key: str) -> dict | None | list[dict]:
        index = idx.by_name(self.store._indexes.get(self.config.name, []), name)
        rows = [r.asDict(recursive=True) for r in self._index(name).where(F.col("_key") == key).orderBy("_path").drop("_key").collect()]
        return (rows[0] if rows else None) if index.unique else rows

    def find_many_by_index(self, name: str, keys: DataFrame) -> DataFrame:
        found = self._index(name)
        return keys.join(found, keys["key"] == found["_key"], "left").drop("_key")

    # attachments:

    def attachments(self, path: str | None = None) -> DataFrame:
        """(_path, name, bytes, hash) of all records or of one."""
        at = self.commit.attachments.get(self.store.key(self.config.name)) if self.commit else None
        df = self.store.spark.read.schema(_ATTACHMENTS).parquet(self.store.data(at)) if at else self.store.spark.createDataFrame([], _ATTACHMENTS)
        return df if path is None else df.where(F.col("_path") == path)

    def attachment(self, path: str, name: str) -> tuple[bytes, str]:
        row = self.attachments(path).where(F.col("name") == name).head()
        if row is None:
            raise NotFoundError(f"no attachment {name!r} at {path!r}", "attachment_not_found")
        return bytes(row["bytes"]), mime_type(name)

    def describe(self) -> dict:
        """Configuration, fields, number of records and properties."""
        return {"name": self.config.name, "path": self.config.path.source, "format": self.config.format, "root": self.config.root, "fields": self.config.path.field_names(), "records": self.records().count(), "properties": cfg.property_summary(self.effective_schema())}


@dataclass
class Transaction:
    """Writes that become one commit."""

    store: Store
    base: Commit | None
    mutated: bool = False
    closed: bool = False
    result: Commit | None = None
    snapshots: dict[str, str] = field(default_factory=dict)
    attachments: dict[str, str] = field(default_factory=dict)
    configs: dict[str, str] = field(default_factory=dict)
    hashes: dict[str, str] = field(default_factory=dict)
    attachment_hashes: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.base:
            self.snapshots, self.attachments, self.configs = dict(self.base.sheets), dict(self.base.attachments), dict(self.base.configs)
        self.hashes = {k: Snapshot.of(v).id for k, v in self.snapshots.items()}
        self.attachment_hashes = {k: v.rsplit("-", 1)[-1] for k, v in self.attachments.items()}

    def _open(self) -> None:
        if self.closed:
            raise TransactionError("the transaction is over", "transaction_closed")

    def write_config(self, name: str, table: Mapping[str, Any]) -> None:
        """Declare or change a sheet, or any other document of the configuration if its name has a slash."""
        self._open()
        if "/" not in name:
            cfg.from_table(name, table)
            self.configs[name] = cfg.serialize(table)
        else:
            from recordloom.sources import toml

            self.configs[name] = toml.serialize(table)
        self.mutated = True

    def delete_config(self, name: str) -> None:
        self._open()
        self.configs.pop(name, None)
        self.mutated = True

    def _config(self, name: str) -> cfg.SheetConfig:
        if name not in self.configs:
            raise ConfigError(f"no sheet {name!r} is declared", "config_missing")
        return cfg.parse(name, self.configs[name])

    def _sheet(self, name: str) -> Sheet:
        sheet = Sheet(self.store, self._config(name))
        sheet.commit = Commit("", None, self.snapshots, self.attachments, self.configs, "", "", 0.0, "")
        return sheet

    def records(self, name: str, partitions: Sequence[str] | None = None) -> DataFrame:
        """The sheet as the transaction has it now, or some partitions of it."""
        sheet = self._sheet(name)
        df = sheet.records()
        parts = [p for p in sheet.config.path.partition_names() if p in df.columns]
        if partitions is not None and parts:
            df = df.where(F.concat_ws("/", *parts).isin(list(partitions)))
        return sheet.visible(df)

    def touched(self, name: str, keys: DataFrame) -> list[str] | None:
        """Distinct partitions in the single column of keys, or None where the whole sheet has to be written."""
        now = self.snapshots.get(self.store.key(name))
        if now is None or not self._config(name).path.partition_names() or len(Snapshot.of(now).bases) >= MAX_BASES:
            return None
        found = [r[0] for r in keys.where(keys[keys.columns[0]].isNotNull()).distinct().limit(MAX_TOUCHED + 1).collect()]
        return found if len(found) <= MAX_TOUCHED else None

    def stage(self, name: str, rows: DataFrame, partitions: Sequence[str] | None = None, change: tuple[int, int] | None = None) -> None:
        """Write a sheet, or with partitions only those, of which rows has all records.

        change is by how much the number and the sum of hashes differ from those
        of the sheet as it is, where that is known.
        """
        self._open()
        config = self._config(name)
        parts = config.path.partition_names()
        columns = config.path.component_columns(rows)
        out = wr.with_blob(rows)
        for p, c in zip(parts, columns, strict=False):
            out = out.withColumn(p, c)
        base = f"{name}-{uuid.uuid4().hex}"
        ordered = out.hint("rebalance", *parts).sortWithinPartitions(*parts, "_path")
        seen = Observation()
        if change is None:  # summed up while it is written
            ordered = ordered.observe(seen, *_both_sums())
        ordered.write.partitionBy(*parts).parquet(self.store.data(base))
        self.store.files.replace(out.schema.json(), "data", base, "_schema")
        n, mix = (0, 0) if change else (seen.get["n"], int(seen.get["mix"] or 0))
        bases: list[tuple[str, tuple[str, ...]]] = []
        if partitions is not None:
            old = Snapshot.of(self.snapshots[self.store.key(name)])
            if change is None:
                gone_n, gone_mix = _sums(self.records(name, partitions))
                change = n - gone_n, mix - gone_mix
            bases = [(b, tuple(sorted({*w, *partitions}))) for b, w in old.bases]
        if change is not None:
            now = Snapshot.of(self.snapshots[self.store.key(name)])
            n, mix = now.rows + change[0], now.mix + change[1]
        snapshot = Snapshot((*bases, (base, ())), n, mix)
        self.snapshots[self.store.key(name)], self.hashes[self.store.key(name)] = snapshot.text(), snapshot.id
        self.mutated = True

    def stage_attachments(self, name: str, rows: DataFrame) -> None:
        self._open()
        temp = self.store.data(f"{name}-attachments-{uuid.uuid4().hex}")
        rows.select("_path", "name", "bytes", "hash").write.parquet(temp)
        mixed = self.store.spark.read.parquet(temp).agg(F.sum(F.xxhash64("_path", "name", "hash").cast("decimal(38,0)"))).first()[0]
        own = hashlib.sha1(str(mixed).encode()).hexdigest()[:16]
        self.store.files.rename(temp, f"{temp}-{own}")
        self.attachments[self.store.key(name)], self.attachment_hashes[self.store.key(name)] = f"{temp}-{own}".rsplit("/", 1)[-1], own
        self.mutated = True

    def _checked(self, name: str, batch: DataFrame) -> tuple[cfg.SheetConfig, DataFrame, dict | None]:
        from recordloom.plans.contracts import compose

        config = self._config(name)
        schema = compose(self.store, config, self.configs)
        validator = self.store.validators.get(name)
        return config, validator(batch) if validator else batch, schema

    def upsert(self, name: str, batch: DataFrame, delete_missing: bool = False, previous: str | None = None) -> DataFrame:
        """Upsert a batch; returns the report (category, count). Invalid rows and index conflicts stop it."""
        self._open()
        config, batch, schema = self._checked(name, batch)
        if config.body and config.body not in batch.columns:
            raise ConfigError(f"records of {name!r} need their body field {config.body!r}")
        prepared = wr.prepare(batch, config.path, schema, config.sort, previous).cache()
        key = _partition_key(config.path)
        near = None if delete_missing else self.touched(name, prepared.select(key))
        existing = self.records(name, near)
        plan = wr.upsert_plan(existing, prepared).cache()
        try:
            # one pass tells the report, the partitions that change, and by how much the sums do
            groups = plan.groupBy("_category", *([key.alias("_part")] if near is not None else [])).agg(F.count("*").alias("n"), _mix("_blob").alias("mix"), _mix("_was").alias("was")).collect()
            report: dict[str, int] = {}
            for r in groups:
                report[r["_category"]] = report.get(r["_category"], 0) + r["n"]
            if report.get("invalid"):
                wr.require_valid(plan)
            for index in self.store._indexes.get(name, []):
                whole = self.records(name)
                if index.unique and (bad := wr_conflict(whole if not delete_missing else whole.limit(0), plan, index, previous)):
                    raise IndexError_(f"index {index.name!r}: key {bad['key']!r} of {bad['path']!r} belongs to {bad['owner']!r}", "index_unique_conflict")
            gone = wr.missing(existing, plan).count() if delete_missing else 0
            if report.get("insert") or report.get("changed") or gone or previous:
                parts, change = None, None
                if near is not None and previous:
                    parts = self.touched(name, plan.select(key).union(plan.select(F.substring_index(previous, "/", len(config.path.components) - 1))))
                elif near is not None:
                    new = [r for r in groups if r["_category"] in ("insert", "changed")]
                    parts = sorted({r["_part"] for r in new})
                if not delete_missing and not previous and self.store.key(name) in self.snapshots:
                    new = [r for r in groups if r["_category"] in ("insert", "changed")]
                    change = report.get("insert", 0), int(sum((r["mix"] or 0) for r in new) - sum((r["was"] or 0) for r in new if r["_category"] == "changed"))
                own = plan if parts is None else plan.where(key.isin(parts))
                self.stage(name, wr.apply_upsert(self.records(name, parts), own, delete_missing, previous), parts, change)
        finally:
            plan.unpersist()
            prepared.unpersist()
        rows = [*report.items(), *([("deleted", gone)] if delete_missing else [])]
        return self.store.spark.createDataFrame(rows, "category string, count bigint")

    def patch(self, name: str, criteria: Mapping[str, Any], patch: Mapping[str, Any]) -> str:
        """Merge a patch into the first record that matches, in path order; returns its path."""
        self._open()
        config = self._config(name)
        existing = self.records(name)
        row = first_row(existing.where(flt.matching(existing, criteria))).head()
        if row is None:
            raise NotFoundError(f"no record of {name!r} matches {dict(criteria)!r}", "record_not_found")
        if config.body and config.title:
            from recordloom.sources.markdown import reconcile

            patch = reconcile(row.asDict(), dict(patch), config.body, config.title)
        one = merge_columns(existing.where(F.col("_path") == row["_path"]), patch).withColumn("_prev", F.lit(row["_path"])).drop("_path", "_blob")
        self.upsert(name, one, previous="_prev")
        return row["_path"]

    def bulk_patch(self, name: str, patches: DataFrame, on_missing: str = "abort", delete_missing: bool = False) -> None:
        config, patches, schema = self._checked(name, patches)
        out = wr.bulk_patch(self.records(name), patches, config.path, on_missing, delete_missing)
        if schema:
            wr.require_valid(out.withColumn("_issues", val.issues_column(out, schema)).withColumn("_category", F.expr("if(size(_issues) > 0, 'invalid', 'changed')")))
        self.stage(name, out)

    def delete(self, name: str, path: str) -> None:
        """Delete one record and its attachments."""
        one = self.store.spark.createDataFrame([(path,)], "_path string")
        parts = self.touched(name, one.select(_partition_key(self._config(name).path)))
        self.stage(name, wr.delete_paths(self.records(name, parts), one, strict=True), parts)
        self._cascade(name)

    def delete_where(self, name: str, clauses: Iterable[str]) -> int:
        """Delete the records that satisfy clauses; returns how many there were."""
        hit = flt.where(self.records(name), own := list(clauses))
        n = hit.count()
        if n:
            parts = self.touched(name, hit.select(_partition_key(self._config(name).path)))
            self.stage(name, wr.delete_where(self.records(name, parts), own), parts)
            self._cascade(name)
        return n

    def clear(self, name: str) -> None:
        self.stage(name, wr.clear(self.records(name)))
        self._cascade(name)

    def rename(self, name: str, old: str, new: str) -> None:
        """Give a record another key; its attachments move with it."""
        self.stage(name, wr.rename(self.records(name), self._config(name).path, old, new))
        if self.store.key(name) in self.attachments:
            moved = self.store.spark.createDataFrame([(old, new)], "old string, new string")
            self.stage_attachments(name, wr.move_attachments(self._attachments(name), moved))

    def normalize(self, name: str) -> int:
        """Rewrite the records that normalisation changes; returns how many."""
        from recordloom.operators.normalize import changed_by_normalize

        existing = self.records(name)
        changed = changed_by_normalize(existing, self._config(name).sort)
        n = changed.count()
        if n:
            self.stage(name, wr.align(existing.join(changed.select("_path"), "_path", "left_anti"), changed))
        return n

    def _attachments(self, name: str) -> DataFrame:
        at = self.attachments.get(self.store.key(name))
        return self.store.spark.read.schema(_ATTACHMENTS).parquet(self.store.data(at)) if at else self.store.spark.createDataFrame([], _ATTACHMENTS)

    def _cascade(self, name: str) -> None:
        if self.store.key(name) in self.attachments:
            self.stage_attachments(name, self._attachments(name).join(self.records(name).select("_path"), "_path", "left_semi"))

    def attach(self, name: str, path: str, files: Mapping[str, bytes]) -> None:
        """Set attachments of a record; names that are there are overwritten."""
        if self.records(name).where(F.col("_path") == path).head() is None:
            raise NotFoundError(f"no record at {path!r}", "record_not_found")
        new = self.store.spark.createDataFrame([(path, n, bytearray(b)) for n, b in files.items()], "_path string, name string, bytes binary")
        self.stage_attachments(name, wr.attach(self._attachments(name), new))

    def detach(self, name: str, path: str, attachment: str | None = None) -> bool:
        """Delete one attachment (it must be there), or all of a record (returns whether there were any)."""
        own = self._attachments(name)
        hit = F.col("_path") == path
        if attachment is not None:
            hit = hit & (F.col("name") == attachment)
        found = own.where(hit).head() is not None
        if attachment is not None and not found:
            raise NotFoundError(f"no attachment {attachment!r} at {path!r}", "attachment_not_found")
        if found:
            self.stage_attachments(name, own.where(~hit))
        return found


def wr_conflict(existing: DataFrame, plan: DataFrame, index: idx.Index, previous: str | None = None) -> Any:
    """The first unique-key conflict of the rows that a plan writes, or None; records that move are no owners any more."""
    rows = plan.where("_category in ('insert', 'changed', 'no-op')")
    if previous:
        existing = existing.join(rows.select(F.col(previous).alias("_path")).distinct(), "_path", "left_anti")
    return idx.write_conflicts(existing, rows, index).orderBy("key", "path").head()
