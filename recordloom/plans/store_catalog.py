"""Registered queries over stores, codecs and errors, each with its SQL."""

from __future__ import annotations

import contextlib
import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.errors import SheetError
from recordloom.functions import values as V
from recordloom.operators import analytics as A
from recordloom.operators import diff as D
from recordloom.operators import filters as flt
from recordloom.operators import index as I
from recordloom.operators import normalize as N
from recordloom.operators import write as W
from recordloom.plans import contracts, template
from recordloom.plans.catalog import _query, _scratch, _spread, _t
from recordloom.sources import records as R
from recordloom.sources import toml
from recordloom.store import Store

_NESTED, _FLAT = "${{ s_nationkey }}/${{ s_suppkey }}", "${{ s_suppkey }}"


def _suppliers(spark: SparkSession, sf_dir: str, path: str = _NESTED, **options: Any) -> tuple[Store, DataFrame]:
    """A new store with the suppliers in one commit, and the suppliers."""
    store = Store(spark, _scratch(spark, "store"), **options)
    supplier = _t(spark, sf_dir, "supplier")
    with store.transact("Declare suppliers", author="Ann") as tx:
        tx.write_config("suppliers", {"path": path})
        tx.upsert("suppliers", supplier)
    return store, supplier


def _code(act: Any) -> str:
    """Code of the error that act raises, or none."""
    try:
        act()
    except SheetError as e:
        return e.code
    return "none"


# records and paths:


@_query("SELECT p_partkey AS n, lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS id, '1e5' AS text, 'true' AS flag, p_retailprice AS price FROM part")
def digits_stay_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records through TOML and JSON, whose quoted digits, exponents and booleans stay text."""
    part = _spread(_t(spark, sf_dir, "part"), "p_partkey").select(F.col("p_partkey").alias("n"), F.lpad(F.col("p_partkey").cast("string"), 9, "0").alias("id"), F.lit("1e5").alias("text"), F.lit("true").alias("flag"), F.col("p_retailprice").alias("price"))
    return R.from_documents(part.select(toml.parse_column(toml.serialize_column(N.canonical_json(part))).alias("document"))).select("n", "id", "text", "flag", "price")


@_query("SELECT c_custkey, c_acctbal + 1 AS c_acctbal FROM customer")
def upsert_repeated_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch that has every customer twice: the later row counts."""
    existing = _t(spark, sf_dir, "customer", "c_custkey")
    own = existing.drop("_path")
    batch = own.unionByName(own.withColumn("c_acctbal", F.col("c_acctbal") + 1))
    plan = W.upsert_plan(existing, W.prepare(batch, template.parse("${{ c_custkey }}")))
    return W.apply_upsert(existing, plan).select("c_custkey", "c_acctbal")


@_query("SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'path_render_failed' WHEN 2 THEN 'path_invalid_chars' ELSE 'path_render_failed' END AS code FROM nation")
def template_issue_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.expr("case n_nationkey % 4 when 0 then n_name when 1 then null when 2 then concat(n_name, '/x') else '' end")
    df = _t(spark, sf_dir, "nation").withColumn("n_name", name)
    return df.select("n_nationkey", template.parse("n/${{ n_name }}").render_issues(df).alias("code"))


@_query("SELECT n_nationkey, 'a/' || n_nationkey || '/b' AS path, CASE n_nationkey % 3 WHEN 0 THEN 'image/png' WHEN 1 THEN 'text/markdown' ELSE 'application/octet-stream' END AS type FROM nation")
def joined_paths_and_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(r.n_nationkey, N.join_path("/a/", f"./{r.n_nationkey}", "", "b"), N.mime_type(f"x.{('PNG', 'md', 'odd')[r.n_nationkey % 3]}")) for r in _t(spark, sf_dir, "nation").collect()]
    return spark.createDataFrame(rows, "n_nationkey long, path string, type string")


@_query("SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name, CAST(s_nationkey AS VARCHAR) AS s_nationkey FROM supplier")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _scratch(spark, "csv")
    R.write(_t(spark, sf_dir, "supplier"), at, "csv", ["s_suppkey", "s_name", "s_nationkey"])
    return R.read(spark, at, "csv")


@_query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def json_lines_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _scratch(spark, "json")
    R.write(_t(spark, sf_dir, "supplier"), at, "jsonl")
    return R.read(spark, at, "jsonl").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")


@_query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def toml_records_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file of [[records]], written block by block and read back."""
    at = _scratch(spark, "toml")
    nation = _t(spark, sf_dir, "nation")
    blocks = nation.select("n_nationkey", F.concat(F.lit("[[records]]\n"), toml.serialize_column(N.canonical_json(nation))).alias("value"))
    blocks.orderBy("n_nationkey").select("value").coalesce(1).write.text(at)
    return R.read(spark, at, "toml").select("n_nationkey", "n_name", "n_regionkey")


@_query("SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def default_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The template's fields, then scalar properties of the schema up to three columns, then an extra one."""
    schema = {"properties": {"c_name": {"type": "string"}, "tags": {"type": "array"}, "c_acctbal": {"type": "number"}, "c_nationkey": {"type": "integer"}}}
    fields = A.with_extras(A.default_fields(["c_custkey"], schema, most=3), ["c_mktsegment", "c_name"])
    return A.project(_t(spark, sf_dir, "customer"), fields)


@_query("SELECT doc_id, CASE WHEN length(text) > 40 THEN substr(text, 1, 40) || '… (truncated, ' || length(text) || ' chars total)' ELSE text END AS preview, coalesce(lang, '') AS shown FROM documents")
def previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents")
    return docs.select("doc_id", V.preview(F.col("text"), 40).alias("preview"), V.display(F.col("lang"), docs.schema["lang"].dataType).alias("shown"))


@_query("SELECT s_suppkey, s_nationkey FROM supplier WHERE s_nationkey = 3 AND s_suppkey % 2 = 1")
def filter_mapping_numbers_by_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole number matches an integer field, a float of the same value does not."""
    df = _t(spark, sf_dir, "supplier")
    strict = df.where(~flt.matching(df, {"s_nationkey": 3.0}))
    return strict.where(flt.matching(strict, {"s_nationkey": 3, "s_suppkey": lambda c, _: c % 2 == 1})).select("s_suppkey", "s_nationkey")


@_query("SELECT 'clause' AS act, 'filter_invalid' AS code UNION ALL SELECT 'index', 'index_not_defined' UNION ALL SELECT 'fine', 'none'")
def error_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _t(spark, sf_dir, "nation")
    acts = [("clause", lambda: flt.parse("no clause")), ("index", lambda: I.by_name([], "x")), ("fine", lambda: flt.where(df, ["n_name:present"]))]
    return spark.createDataFrame([(name, _code(act)) for name, act in acts], "act string, code string")


@_query("SELECT n_nationkey AS a, n_nationkey AS b, '[{\"op\":\"replace\",\"path\":\"/n_name\",\"value\":\"' || lower(n_name) || '\"}]' AS patch FROM nation")
def diff_json_patch_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = _t(spark, sf_dir, "nation", "n_nationkey")
    found = D.with_patches(old, old.withColumn("n_name", F.lower("n_name")))
    return found.select(F.col("old_path").cast("long").alias("a"), F.col("path").cast("long").alias("b"), "patch")


# stores:


@_query("SELECT 1 AS n, 'Declare suppliers' AS message, 'Ann' AS author, '' AS trailers UNION ALL SELECT 2, 'Raise', 'Bob', 'Ticket=7'")
def store_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, supplier = _suppliers(spark, sf_dir)
    with store.transact("Raise", author="Bob", trailers={"Ticket": "7"}) as tx:
        tx.upsert("suppliers", supplier.withColumn("s_acctbal", F.col("s_acctbal") + 1))
    with store.transact("Nothing", author="Eve") as tx:  # changes nothing, so makes no commit
        tx.upsert("suppliers", supplier.withColumn("s_acctbal", F.col("s_acctbal") + 1))
    rows = [(k + 1, c.message, c.author, ",".join(f"{a}={b}" for a, b in c.trailers)) for k, c in enumerate(reversed(list(store.log())))]
    return spark.createDataFrame(rows, "n int, message string, author string, trailers string")


@_query("SELECT s_suppkey, s_acctbal AS before, CASE WHEN s_acctbal < 0 THEN NULL ELSE s_acctbal END AS after FROM supplier")
def store_read_at_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, _ = _suppliers(spark, sf_dir)
    first = store.head
    with store.transact("Drop debtors") as tx:
        tx.delete_where("suppliers", ["s_acctbal<0"])
    before = store.sheet("suppliers", first).records().select("s_suppkey", F.col("s_acctbal").alias("before"))
    return before.join(store.sheet("suppliers").records().select("s_suppkey", F.col("s_acctbal").alias("after")), "s_suppkey", "left")


@_query("SELECT s_suppkey, s_acctbal FROM supplier")
def store_discarded_transaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, _ = _suppliers(spark, sf_dir)
    with contextlib.suppress(RuntimeError), store.transact("Lost") as tx:
        tx.clear("suppliers")
        raise RuntimeError("stop")
    return store.sheet("suppliers").records().select("s_suppkey", "s_acctbal")


_FIRST_OF_3 = "(SELECT min(CAST(s_suppkey AS VARCHAR)) FROM supplier WHERE s_nationkey = 3)"


@_query(f"SELECT s_suppkey, CASE WHEN s_nationkey = 3 AND CAST(s_suppkey AS VARCHAR) = {_FIRST_OF_3} THEN 'patched' ELSE s_name END AS s_name FROM supplier")
def store_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first record in path order that matches is patched."""
    store, _ = _suppliers(spark, sf_dir)
    store.sheet("suppliers").patch({"s_nationkey": 3}, {"s_name": "patched"})
    return store.sheet("suppliers").records().select("s_suppkey", "s_name")


@_query("SELECT CASE WHEN s_suppkey = (SELECT min(s_suppkey) FROM supplier) THEN '999999999' ELSE CAST(s_suppkey AS VARCHAR) END AS path, s_name FROM supplier")
def store_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, supplier = _suppliers(spark, sf_dir, _FLAT)
    with store.transact("Rename") as tx:
        tx.rename("suppliers", str(supplier.agg(F.min("s_suppkey")).first()[0]), "999999999")
    return store.sheet("suppliers").records().select(F.col("_path").alias("path"), "s_name")


@_query("SELECT 'deleted' AS status, count(*) AS count FROM supplier")
def store_clear(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, _ = _suppliers(spark, sf_dir)
    first = store.head
    store.sheet("suppliers").clear()
    return D.totals(store.diff("suppliers", first))


@_query("SELECT 'deleted' AS category, (SELECT count(*) FROM supplier WHERE s_suppkey % 2 = 0) AS count UNION ALL SELECT 'no-op', (SELECT count(*) FROM supplier WHERE s_suppkey % 2 = 1)")
def store_delete_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, supplier = _suppliers(spark, sf_dir)
    return store.sheet("suppliers").upsert(supplier.where("s_suppkey % 2 = 1"), delete_missing=True)


@_query("SELECT s_nationkey || '/' || s_suppkey AS path FROM supplier WHERE s_nationkey = 3")
def store_candidate_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, _ = _suppliers(spark, sf_dir)
    return store.sheet("suppliers").candidate_paths({"s_nationkey": 3}).select(F.col("_path").alias("path"))


@_query("SELECT 'nations' AS name, (SELECT count(*) FROM nation) AS records UNION ALL SELECT 'suppliers', (SELECT count(*) FROM supplier)")
def store_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, _ = _suppliers(spark, sf_dir)
    with store.transact("More") as tx:
        tx.write_config("nations", {"path": "${{ n_nationkey }}"})
        tx.write_config("notes/readme", {"text": "nested names are no sheets"})
        tx.upsert("nations", _t(spark, sf_dir, "nation"))
    return spark.createDataFrame([(x["name"], x["records"]) for x in store.summary()], "name string, records long")


@_query("SELECT 'a' AS prefix, count(*) AS records FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL SELECT 'b/c', count(*) FROM supplier WHERE s_suppkey % 3 <> 0 UNION ALL SELECT '', 0")
def store_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores of one place with different prefixes share declarations and have records of their own."""
    at, supplier, rows = _scratch(spark, "store"), _t(spark, sf_dir, "supplier"), []
    with Store(spark, at).transact("Declare") as tx:
        tx.write_config("suppliers", {"path": _NESTED})
    for prefix, cond in (("a", "s_suppkey % 3 = 0"), ("b/c", "s_suppkey % 3 <> 0")):
        with Store(spark, at, prefix=prefix).transact("Fill") as tx:
            tx.upsert("suppliers", supplier.where(cond))
    rows = [(prefix, Store(spark, at, prefix=prefix).sheet("suppliers").records().count()) for prefix in ("a", "b/c", "")]
    return spark.createDataFrame(rows, "prefix string, records long")


@_query("SELECT s_suppkey, s_name || '!' AS s_name FROM supplier WHERE s_nationkey = 3")
def store_index_follows_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, supplier = _suppliers(spark, sf_dir)
    store.sheet("suppliers").define_index("nation", "s_nationkey", eager=True)
    with store.transact("Shout") as tx:
        tx.upsert("suppliers", supplier.withColumn("s_name", F.concat("s_name", F.lit("!"))))
    keys = spark.createDataFrame([("3",)], "key string")
    return store.sheet("suppliers").find_many_by_index("nation", keys).select("s_suppkey", "s_name")


@_query("SELECT 'closed' AS act, 'transaction_closed' AS code UNION ALL SELECT 'moved', 'parent_moved' UNION ALL SELECT 'nested', 'transaction_in_progress' UNION ALL SELECT 'outside', 'write_outside_transaction' UNION ALL SELECT 'reference', 'ref_not_found' UNION ALL SELECT 'sheet', 'config_missing' UNION ALL SELECT 'trailer', 'config_invalid' UNION ALL SELECT 'unique', 'index_unique_conflict'")
def store_error_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, supplier = _suppliers(spark, sf_dir)
    one = supplier.orderBy("s_suppkey").limit(1)
    with store.transact("Once") as old:
        pass

    def moved() -> None:
        with store.transact("Late") as tx:
            tx.write_config("late", {"path": "${{ id }}"})
            store.write_ref("main", "0" * 40)

    def nested() -> None:
        with store.transact("Outer"), store.transact("Inner"):
            pass

    def unique() -> None:
        store.sheet("suppliers").define_index("name", "s_name", unique=True)
        store.sheet("suppliers").upsert(one.withColumn("s_suppkey", F.lit(10**9).cast("long")))

    acts = {
        "closed": lambda: old.upsert("suppliers", one), "nested": nested, "reference": lambda: store.commit("ffffffff"), "sheet": lambda: store.sheet("none"), "trailer": lambda: store.transact("x", trailers={"a b": "c"}).__enter__(),
        "outside": lambda: Store(spark, store.root, strict=True).sheet("suppliers").clear(), "unique": unique, "moved": moved,
    }
    return spark.createDataFrame([(name, _code(act)) for name, act in acts.items()], "act string, code string")


@_query("SELECT s_suppkey AS key, 'note.md' AS name, sha1(encode('blob ' || strlen(s_name) || chr(0) || s_name)) AS hash FROM supplier WHERE s_suppkey <= 3 AND s_suppkey <> 2")
def store_attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attachments of three suppliers, one of which is deleted again, and its attachments with it."""
    store, supplier = _suppliers(spark, sf_dir, _FLAT)
    names = {r.s_suppkey: r.s_name for r in supplier.where("s_suppkey <= 3").collect()}
    with store.transact("Attach") as tx:
        for key, name in names.items():
            tx.attach("suppliers", str(key), {"note.md": b"old"})
            tx.attach("suppliers", str(key), {"note.md": name.encode()})
        tx.delete("suppliers", "2")
    return store.sheet("suppliers").attachments().select(F.col("_path").cast("long").alias("key"), "name", "hash")


_MEANS = {"$id": "https://x.org/solvent", "type": "object", "properties": {"s_acctbal": {"type": "number", "minimum": 0}}}


@_query("SELECT 'debtors' AS act, CASE WHEN count(*) > 0 THEN 'contract_mismatch' ELSE 'none' END AS code FROM supplier WHERE s_acctbal < 0 UNION ALL SELECT 'upsert', 'validation_failed' UNION ALL SELECT 'vendored', 'x.org/solvent' UNION ALL SELECT 'records', CAST(count(*) AS VARCHAR) FROM supplier WHERE s_acctbal >= 0")
def store_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A contract that debtors break is adopted only once they are gone, and then holds for writes."""
    store, supplier = _suppliers(spark, sf_dir)
    rows = [("debtors", _code(lambda: contracts.adopt(store, "x.org/solvent", _MEANS, ["suppliers"])))]
    with store.transact("Drop debtors") as tx:
        tx.delete_where("suppliers", ["s_acctbal<0"])
    contracts.adopt(store, "x.org/solvent", _MEANS, ["suppliers"])
    debtor = supplier.orderBy("s_suppkey").limit(1).withColumn("s_acctbal", F.lit(-1.0))
    rows += [("upsert", _code(lambda: store.sheet("suppliers").upsert(debtor))), ("vendored", ",".join(contracts.vendored(store)))]
    return spark.createDataFrame([*rows, ("records", str(store.sheet("suppliers").records().count()))], "act string, code string")


@_query("SELECT s_nationkey, string_agg(CAST(s_suppkey AS VARCHAR), ',' ORDER BY s_suppkey) AS suppliers FROM supplier GROUP BY 1")
def store_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists that were stored unsorted are put in order when the sheet gets a rule and is normalised."""
    store = Store(spark, _scratch(spark, "store"))
    lists = _t(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.reverse(F.sort_array(F.collect_list("s_suppkey"))).alias("suppliers"))
    with store.transact("Declare") as tx:
        tx.write_config("nations", {"path": "${{ s_nationkey }}"})
        tx.upsert("nations", lists)
    with store.transact("Sort") as tx:
        tx.write_config("nations", {"path": "${{ s_nationkey }}", "fields": {"suppliers": {"sort": True}}})
        tx.normalize("nations")
    return store.sheet("nations").records().select("s_nationkey", F.array_join(F.col("suppliers").cast("array<string>"), ",").alias("suppliers"))


@_query("SELECT s_suppkey, '{\"s_acctbal\":1}' AS record FROM supplier WHERE s_suppkey = (SELECT min(s_suppkey) FROM supplier)")
def merge_patch_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recordloom.operators.patch import merge_patch

    one = _t(spark, sf_dir, "supplier").orderBy("s_suppkey").select("s_suppkey").head()
    merged = merge_patch({"s_name": "x", "s_acctbal": 0}, {"s_name": None, "s_acctbal": 1})
    return spark.createDataFrame([(one.s_suppkey, json.dumps(merged, separators=(",", ":")))], "s_suppkey long, record string")
