"""Planning of bulk writes: upsert, patch and delete as relations between a batch and a table.

Every plan is a DataFrame of categorised rows; applying it is a join, so dry runs
and writes share one definition.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordloom.errors import NotFoundError, ValidationError
from recordloom.operators.filters import Clause, predicate
from recordloom.operators.normalize import canonical_json, sorted_list
from recordloom.operators.patch import merge_rows
from recordloom.operators.validate import ISSUE, issues_column
from recordloom.plans.template import Template

_META = ("_path", "_sheet", "_blob")


def align(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both tables one after the other; columns that one lacks are null."""
    return a.unionByName(b, allowMissingColumns=True)


def with_blob(df: DataFrame) -> DataFrame:
    """The table with a content hash in _blob, kept where it is there already."""
    return df if "_blob" in df.columns else df.withColumn("_blob", F.sha2(canonical_json(df), 256))


def prepare(batch: DataFrame, template: Template, schema: Mapping | None = None, rules: Mapping | None = None, previous: str | None = None) -> DataFrame:
    """A batch, normalised, with _path, _blob and its issues (of the path and of the schema).

    previous names a column that is no field of the records.

    Of several rows of one path, all are kept, with their place in the batch in
    _order; upsert_plan() takes the last.
    """
    code = template.render_issues(batch)
    path_issue = F.when(code.isNotNull(), F.struct(F.lit("").alias("path"), F.lit("#").alias("schema_path"), code.alias("code"), F.lit("the record has no legal path").alias("message")))
    own = (*_META, *([previous] if previous else []))
    found = issues_column(batch, schema, own) if schema else F.array().cast(f"array<{ISSUE}>")
    issues = F.concat(F.array_compact(F.array(path_issue)).cast(f"array<{ISSUE}>"), found)
    marked = batch.withColumn("_order", F.monotonically_increasing_id()).withColumn("__issues", issues).withColumn("__to", template.render(batch))
    out = marked
    for field, rule in (rules or {}).items():
        if field in out.columns:
            out = out.withColumn(field, sorted_list(out, field, rule))
    blob = F.sha2(canonical_json(out, (*own, "_order", "__issues", "__to")), 256)
    return out.withColumn("_blob", blob).withColumnRenamed("__to", "_path").withColumnRenamed("__issues", "_issues")


def upsert_plan(existing: DataFrame, prepared: DataFrame, order: str = "_order") -> DataFrame:
    """prepared with _category: insert, changed, no-op or invalid; and with _was, the hash of the record that is there.

    One left join over paths and hashes.  Of rows with one path the last by
    `order` counts (as it is by default: in the batch), the others are superseded.
    """
    latest = Window.partitionBy("_path").orderBy(F.desc(order))
    own = prepared.withColumn("__n", F.when(F.col("_path").isNotNull(), F.row_number().over(latest)).otherwise(1))
    known = with_blob(existing).select("_path", F.col("_blob").alias("__old"))
    category = (
        F.when(F.size("_issues") > 0, "invalid").when(F.col("__n") > 1, "superseded").when(F.col("__old").isNull(), "insert").when(F.col("__old") == F.col("_blob"), "no-op").otherwise("changed")
    )
    return own.join(known, "_path", "left").withColumn("_category", category).withColumnRenamed("__old", "_was").drop("__n", "_order")


def categories(plan: DataFrame) -> DataFrame:
    """(category, count) of a plan: the report of a dry run."""
    return plan.groupBy(F.col("_category").alias("category")).agg(F.count("*").alias("count"))


def invalid_rows(plan: DataFrame) -> DataFrame:
    """(path, field, code, message) of the issues of a plan."""
    return plan.where("_category = 'invalid'").select(F.col("_path").alias("record"), F.inline("_issues")).select("record", F.col("path").alias("field"), "code", "message")


def require_valid(plan: DataFrame) -> None:
    """Raise with the first issues if any row of a plan is invalid: nothing is written then."""
    bad = invalid_rows(plan).limit(20).collect()
    if bad:
        raise ValidationError(f"{len(bad)} issues or more; nothing was written", issues=[r.asDict() for r in bad])


def missing(existing: DataFrame, prepared: DataFrame) -> DataFrame:
    """Records of the table that a batch doesn't name."""
    return existing.join(prepared.where("_path is not null").select("_path").distinct(), "_path", "left_anti")


def apply_upsert(existing: DataFrame, plan: DataFrame, delete_missing: bool = False, previous: str | None = None) -> DataFrame:
    """The table after a plan. previous names a column with the path that a record had before, which goes."""
    rows = plan.where("_category in ('insert', 'changed', 'no-op')")
    gone = rows.select("_path")
    if previous and previous in rows.columns:
        gone = gone.union(rows.where(F.col(previous).isNotNull()).select(previous)).distinct()
    new = rows.drop("_category", "_issues", "_was", *([previous] if previous else []))
    if delete_missing:
        return align(with_blob(existing).limit(0), new)
    return align(with_blob(existing).join(gone, "_path", "left_anti"), new)


def upsert(existing: DataFrame, batch: DataFrame, template: Template, schema: Mapping | None = None, rules: Mapping | None = None, delete_missing: bool = False, previous: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(table after the batch, plan). Any invalid row stops it before anything is written."""
    plan = upsert_plan(existing, prepare(batch, template, schema, rules, previous))
    require_valid(plan)
    return apply_upsert(existing, plan, delete_missing, previous), plan


def will_change(existing: DataFrame, batch: DataFrame, template: Template, schema: Mapping | None = None, rules: Mapping | None = None) -> DataFrame:
    """(_path, _category) of a batch without writing."""
    return upsert_plan(existing, prepare(batch, template, schema, rules)).select("_path", "_category")


# patch:


def patch_plan(existing: DataFrame, patches: DataFrame, template: Template) -> DataFrame:
    """patches with _status: found or missing, by the template's fields, which say which record is meant."""
    key = template.field_names()
    known = existing.select(*key).distinct().withColumn("__known", F.lit(True))
    return patches.join(known, key, "left").withColumn("_status", F.when(F.col("__known"), "found").otherwise("missing")).drop("__known")


def bulk_patch(existing: DataFrame, patches: DataFrame, template: Template, on_missing: str = "abort", delete_missing: bool = False) -> DataFrame:
    """The table after patches of many records: values replace, fields in the list column _delete go.

    on_missing: abort, skip or insert.  With delete_missing, records without a patch go.
    """
    if on_missing not in ("abort", "skip", "insert"):
        raise ValidationError(f"on_missing can't be {on_missing!r}", "input_invalid")
    key = template.field_names()
    plan = patch_plan(existing, patches, template)
    if on_missing == "abort" and (gone := plan.where("_status = 'missing'").select(*key).head()):
        raise NotFoundError(f"no record matches {gone.asDict()}", "record_not_found")
    base = existing.join(patches.select(*key).distinct(), key, "left_semi") if delete_missing else existing
    out = merge_rows(base.drop("_blob"), plan.where("_status = 'found'").drop("_status"), key)
    if on_missing == "insert":
        new = plan.where("_status = 'missing'").drop("_status", "_delete")
        out = align(out, new.withColumn("_path", template.render(new)))
    return with_blob(out)


# delete and rename:


def delete_where(existing: DataFrame, filters: Iterable[str | Clause]) -> DataFrame:
    """The table without the records that satisfy all clauses."""
    return existing.where(~predicate(existing, list(filters)))


def delete_paths(existing: DataFrame, paths: DataFrame, strict: bool = False) -> DataFrame:
    """The table without these paths (column _path); with strict, a path that isn't there is an error."""
    if strict and (gone := paths.join(existing.select("_path"), "_path", "left_anti").head()):
        raise NotFoundError(f"no record at {gone['_path']!r}", "record_not_found")
    return existing.join(paths.select("_path").distinct(), "_path", "left_anti")


def existed(existing: DataFrame, paths: DataFrame) -> DataFrame:
    """(_path, existed) of paths."""
    return paths.join(existing.select("_path", F.lit(True).alias("existed")), "_path", "left").fillna({"existed": False})


def read_paths(existing: DataFrame, paths: DataFrame) -> DataFrame:
    """A row for each path, nulls where there is no record."""
    return paths.join(existing, "_path", "left")


def clear(existing: DataFrame) -> DataFrame:
    return existing.limit(0)


def rename(existing: DataFrame, template: Template, old: str, new: str) -> DataFrame:
    """The record at one path with another value of the single field that the template is made of."""
    names = template.field_names()
    if len(template.components) != 1 or len(names) != 1 or template.components[0].parts[0].kind != "field":
        raise ValidationError("only a template of a single field can be renamed by", "input_invalid")
    there = {r["_path"] for r in existing.where(F.col("_path").isin(old, new)).select("_path").collect()}
    if old not in there:
        raise NotFoundError(f"no record at {old!r}", "record_not_found")
    if new in there:
        raise ValidationError(f"there is a record at {new!r}", "input_invalid")
    kind = existing.schema[names[0]].dataType
    hit = F.col("_path") == old
    out = existing.withColumn(names[0], F.when(hit, F.lit(new).cast(kind)).otherwise(F.col(names[0]))).withColumn("_path", F.when(hit, F.lit(new)).otherwise(F.col("_path")))
    return with_blob(out.drop("_blob"))


def move_attachments(attachments: DataFrame, moved: DataFrame) -> DataFrame:
    """Attachments with the paths of renamed records: moved has columns old and new."""
    return attachments.join(moved, attachments["_path"] == moved["old"], "left").withColumn("_path", F.coalesce("new", "_path")).drop("old", "new")


def attach(attachments: DataFrame, new: DataFrame) -> DataFrame:
    """Attachments after setting (_path, name, bytes); the same name at the same path is overwritten."""
    hashed = new.withColumn("hash", F.sha1(F.concat(F.encode(F.concat(F.lit("blob "), F.octet_length("bytes").cast("string")), "UTF-8"), F.unhex(F.lit("00")), F.col("bytes"))))
    return attachments.join(hashed.select("_path", "name"), ["_path", "name"], "left_anti").unionByName(hashed)


def keys(template: Template, rows: Sequence[Mapping]) -> list[str]:
    """Paths of records as mappings."""
    return [template.render_record(r) for r in rows]
