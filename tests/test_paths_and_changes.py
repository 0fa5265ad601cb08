import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from recordloom.errors import ConfigError, IndexError_, NotFoundError, PathError, SheetError, ValidationError
from recordloom.operators import diff as D
from recordloom.operators import index as I
from recordloom.operators import patch as P
from recordloom.operators import write as W
from recordloom.plans import template as T


def rendered(df, source):
    return [r[0] for r in df.select(T.parse(source).render(df)).collect()]


def test_rendering(spark):
    df = spark.createDataFrame([(2026, "active", 12345, 1.0, True, "a/b"), (None, "x", 1, 2.5, False, "c:d")], "yr int, state string, num long, x double, ok boolean, p string")
    assert rendered(df, "${{ yr }}/${{ state }}--${{ num }}") == ["2026/active--12345", None]
    assert rendered(df, "/t/${{ x }}-${{ ok }}/") == ["t/1-true", "t/2.5-false"]
    assert rendered(df, "${{ p/** }}") == ["a/b", None] and rendered(df, "${{ p }}") == [None, None]
    assert rendered(df, "${{ upper(state) }}") == ["ACTIVE", "X"]
    assert [r[0] for r in df.select(T.parse("${{ p }}").render_issues(df)).collect()] == ["path_invalid_chars"] * 2
    with pytest.raises(Exception, match="path_render_failed"):
        df.select(T.parse("${{ yr }}").render(df, strict=True)).collect()


def test_date_buckets(spark):
    df = spark.createDataFrame([("2023-06-30T22:15:00-04:00", "x"), ("2027-01-01", "y"), (None, "z"), ("nope", "q")], "at string, slug string")
    assert rendered(df, "${{ at: YYYY/MM/DD }}/${{ slug }}") == ["2023/07/01/x", "2027/01/01/y", None, None]
    assert rendered(df, "${{ at: YYYY/WW }}/${{ slug }}") == ["2023/26/x", "2026/53/y", None, None]
    nested = df.select(F.struct("at").alias("meta"), "slug")
    assert rendered(nested, "${{ meta.at: YYYY }}/${{ slug }}")[0] == "2023/x"
    t = T.parse("${{ at: YYYY/MM/DD }}/${{ slug }}")
    assert t.field_names() == ["at", "slug"]
    assert t.plan({"at": "2023-06-30T22:15:00-04:00"}) == ["2023", "07", "01", None] and t.plan({"slug": "x"}) == [None, None, None, "x"]
    assert t.render_record({"at": "2027-01-01", "slug": "y"}) == "2027/01/01/y"


@pytest.mark.parametrize("bad", ["", "/", "a//b", "${{ x", "${{ }}", "${{ at: YYYY-MM }}/x", "x${{ at: YYYY }}", "${{ p/** }}/x", "a${{ p/** }}"])
def test_bad_templates(bad):
    with pytest.raises(SheetError):
        T.parse(bad)


def test_one_record():
    t = T.parse("${{ host }}/${{ user }}")
    assert t.render_record({"host": "a.org", "user": "x"}) == "a.org/x"
    for record, code in (({"host": "a"}, "path_render_failed"), ({"host": "a/b", "user": "x"}, "path_invalid_chars"), ({"host": "", "user": "x"}, "path_render_failed")):
        with pytest.raises(PathError) as e:
            t.render_record(record)
        assert e.value.code == code
    assert T.parse("${{ concat(a, b) }}").field_names() == ["a", "b"]
    with pytest.raises(ConfigError):
        T.parse("${{ at: WW }}")


def test_pruning_reaches_partitions(spark, tmp_path):
    t = T.parse("${{ domain }}/${{ name }}")
    df = spark.createDataFrame([("a", "x"), ("b", "y"), ("b", "z")], "domain string, name string")
    df.withColumn("_p0", t.component_columns(df)[0]).write.partitionBy("_p0").parquet(f"{tmp_path}/t")
    stored = spark.read.parquet(f"{tmp_path}/t")
    found = stored.where(t.pruning({"domain": "b"}, stored.columns))
    assert found.count() == 2 and "PartitionFilters: [isnotnull(_p0" in found._jdf.queryExecution().executedPlan().toString()
    assert t.pruning({"name": "x"}, stored.columns) is None


def users(spark):
    return spark.createDataFrame([("jane", "jane@x.org", "eng"), ("bob", "bob@x.org", "eng"), ("mia", "mia@x.org", "ops")], "slug string, email string, team string").withColumn("_path", F.col("slug"))


def test_indexes(spark):
    df = users(spark)
    team = I.define("team", "team")
    mail = I.define("email", lambda d: F.lower(d["email"]), unique=True)
    assert [r.slug for r in I.lookup(df, team, "eng").collect()] == ["bob", "jane"]
    I.check_unique(df, mail)
    with pytest.raises(IndexError_) as e:
        I.check_unique(df, I.define("team", "team", unique=True))
    assert e.value.code == "index_unique_conflict" and "bob" in str(e.value) and "jane" in str(e.value)
    assert [tuple(r) for r in I.conflicts(df, team).collect()] == [("eng", 2, ["bob", "jane"])]
    batch = spark.createDataFrame([("new", "JANE@x.org", "a"), ("bob", "bob@x.org", "b"), ("p", "same@x", "c"), ("q", "same@x", "c")], "slug string, email string, team string").withColumn("_path", F.col("slug"))
    got = {(r.path, r.owner) for r in I.write_conflicts(df, batch, mail).collect()}
    assert got == {("new", "jane"), ("p", "q"), ("q", "p")}
    keys = spark.createDataFrame([("ops",), ("none",)], "key string")
    assert {(r.key, r.slug) for r in I.lookup_many(df, team, keys).collect()} == {("ops", "mia"), ("none", None)}
    with pytest.raises(IndexError_):
        I.by_name([team], "nothing")


@pytest.mark.parametrize(
    "a,b,want",
    [
        (None, {"s": 1}, [("replace", "", {"s": 1})]), ({"s": 1}, None, [("replace", "", None)]), ({"e": "a"}, {"e": "b"}, [("replace", "/e", "b")]), ({}, {"e": 1}, [("add", "/e", 1)]),
        ({"e": 1}, {}, [("remove", "/e", "-")]), ({"a": {"c": 1, "z": 1}}, {"a": {"c": 1, "z": 2}}, [("replace", "/a/z", 2)]), ({"t": ["a", "b"]}, {"t": ["a", "b", "c"]}, [("add", "/t/-", "c")]),
        ({"t": ["a", "b", "c"]}, {"t": ["a"]}, [("remove", "/t/1", "-"), ("remove", "/t/1", "-")]), ({"t": ["a", "b"]}, {"t": ["x"]}, [("replace", "/t/0", "x"), ("remove", "/t/1", "-")]),
        ({"n": 1}, {"n": 1.0}, []), ({"n": 1}, {"n": True}, [("replace", "/n", True)]), ({"a/b~": 1}, {}, [("remove", "/a~1b~0", "-")]), ({"x": [1]}, {"x": {"y": 1}}, [("replace", "/x", {"y": 1})]),
    ],
)
def test_json_patch_cases(a, b, want):
    assert [(o["op"], o["path"], o.get("value", "-")) for o in P.json_patch(a, b)] == want


_json = st.recursive(st.integers(0, 3) | st.text("ab", max_size=2) | st.booleans(), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text("xy/~", min_size=1, max_size=2), x, max_size=3), max_leaves=8)


@settings(max_examples=150, deadline=None)
@given(_json, _json)
def test_patches_apply(a, b):
    assert P.apply_patch(a, P.json_patch(a, b)) == b
    assert P.json_patch(a, a) == []


def test_merge_patch():
    assert P.merge_patch({"a": {"zip": 1, "city": "x"}}, {"a": {"zip": None}}) == {"a": {"city": "x"}}
    assert P.merge_patch({}, {"a": {"b": None}}) == {"a": {}}
    assert P.merge_patch({"t": [1, 2]}, {"t": [3]}) == {"t": [3]} and P.merge_patch({"a": 1}, "x") == "x" and P.merge_patch("x", {"a": 1}) == {"a": 1}


def test_merge_columns(spark):
    df = spark.sql("select 1 as id, named_struct('city', 'x', 'zip', 5) as a, 'k' as s union all select 2, null, 'm'")
    out = {r.id: r for r in P.merge_columns(df, {"a": {"zip": None}, "s": None, "note": "n"}, F.col("id") == 1).collect()}
    assert out[1].a.city == "x" and out[1].a.zip is None and out[1].s is None and out[1].note == "n"
    assert out[2].a is None and out[2].s == "m" and out[2].note is None


def test_changes(spark):
    old = users(spark)
    new = old.where("slug <> 'mia'").withColumn("team", F.when(F.col("slug") == "bob", "ops").otherwise(F.col("team"))).unionByName(spark.createDataFrame([("zed", "z@x.org", None, "zed")], "slug string, email string, team string, _path string"))
    got = {(r.path, r.status) for r in D.changes(old, new).collect()}
    assert got == {("mia", "deleted"), ("bob", "modified"), ("zed", "added")}
    assert D.changes(old, old).count() == 0 and D.changes(old, old.withColumn("empty", F.lit(None).cast("string"))).count() == 0
    assert {tuple(r) for r in D.totals(D.changes(old.limit(0), old)).collect()} == {("added", 3)}
    ops = {r.path: r.patch for r in D.with_patches(old, new).collect()}
    first = {k: [(o["op"], o["path"], o["value"]) for o in json.loads(v)] for k, v in ops.items()}
    assert first["bob"] == [("replace", "/team", "ops")] and first["mia"] == [("replace", "", None)]
    assert [tuple(r) for r in D.field_changes(old, new).collect()] == [("bob", "replace", "/team", "ops")]
    assert [r.path for r in D.limited(D.changes(old, new), 2).collect()] == ["bob", "mia"]


def test_renames(spark):
    old = users(spark)
    new = old.withColumn("_path", F.when(F.col("slug") == "bob", "robert").otherwise(F.col("_path")))
    assert [(r.old_path, r.path, r.status) for r in D.changes(old, new, renames=True).collect()] == [("bob", "robert", "renamed")]
    edited = new.withColumn("slug", F.when(F.col("slug") == "bob", "rob").otherwise(F.col("slug")))
    assert {r.status for r in D.changes(old, edited, renames=True).collect()} == {"added", "deleted"}
    assert [(r.old_path, r.path, r.status) for r in D.changes(old, edited, similarity=0.5).collect()] == [("bob", "robert", "renamed")]


SLUG = T.parse("${{ slug }}")
SCHEMA = {"required": ["email", "slug"], "type": "object"}


def test_upsert_categories_and_apply(spark):
    old = users(spark)
    batch = spark.createDataFrame([("jane", "jane@x.org", "eng"), ("bob", "b@x.org", "eng"), ("new", "n@x.org", None), ("bad", None, None), (None, "x", None), ("twice", "1", None), ("twice", "2", None)], "slug string, email string, team string")
    plan = W.upsert_plan(old, W.prepare(batch, SLUG, SCHEMA))
    assert {tuple(r) for r in W.categories(plan).collect()} == {("no-op", 1), ("changed", 1), ("insert", 2), ("invalid", 2), ("superseded", 1)}
    with pytest.raises(ValidationError) as e:
        W.require_valid(plan)
    assert {i["code"] for i in e.value.issues} >= {"required"}
    good = batch.where("email is not null and slug is not null")
    after, _ = W.upsert(old, good, SLUG, SCHEMA)
    assert {r.slug: r.email for r in after.collect()} == {"jane": "jane@x.org", "bob": "b@x.org", "mia": "mia@x.org", "new": "n@x.org", "twice": after.where("slug = 'twice'").first().email}
    again, plan = W.upsert(after, good.where("slug <> 'twice'"), SLUG, SCHEMA)
    assert {tuple(r) for r in W.categories(plan).collect()} == {("no-op", 3)} and D.changes(after, again).count() == 0
    only, _ = W.upsert(old, good.where("slug = 'new'"), SLUG, delete_missing=True)
    assert [r.slug for r in only.collect()] == ["new"]


def test_upsert_moves_records(spark):
    old = users(spark)
    moved = spark.createDataFrame([("robert", "bob@x.org", "eng", "bob")], "slug string, email string, team string, was string")
    plan = W.upsert_plan(old, W.prepare(moved.drop("was"), SLUG)).withColumn("was", F.lit("bob"))
    assert sorted(r.slug for r in W.apply_upsert(old, plan, previous="was").collect()) == ["jane", "mia", "robert"]


def test_bulk_patch(spark):
    old = users(spark)
    patches = spark.createDataFrame([("bob", "ops", ["email"]), ("who", "x", None)], "slug string, team string, _delete array<string>")
    with pytest.raises(NotFoundError):
        W.bulk_patch(old, patches, SLUG)
    skip = {r.slug: r for r in W.bulk_patch(old, patches, SLUG, "skip").collect()}
    assert skip["bob"].team == "ops" and skip["bob"].email is None and skip["jane"].team == "eng" and len(skip) == 3
    put = {r.slug: r for r in W.bulk_patch(old, patches, SLUG, "insert").collect()}
    assert len(put) == 4 and put["who"]._path == "who"
    assert [r.slug for r in W.bulk_patch(old, patches, SLUG, "skip", delete_missing=True).collect()] == ["bob"]


def test_deletes_and_reads(spark):
    old = users(spark)
    paths = spark.createDataFrame([("bob",), ("none",)], "_path string")
    assert sorted(r.slug for r in W.delete_where(old, ["team=eng"]).collect()) == ["mia"]
    assert W.delete_paths(old, paths).count() == 2
    with pytest.raises(NotFoundError):
        W.delete_paths(old, paths, strict=True)
    assert {tuple(r) for r in W.existed(old, paths).collect()} == {("bob", True), ("none", False)}
    assert {(r._path, r.email) for r in W.read_paths(old, paths).collect()} == {("bob", "bob@x.org"), ("none", None)}
    assert W.clear(old).count() == 0
    assert sorted(r._path for r in W.rename(old, SLUG, "bob", "rob").collect()) == ["jane", "mia", "rob"]
    for a, b, kind in (("none", "x", NotFoundError), ("bob", "mia", ValidationError)):
        with pytest.raises(kind):
            W.rename(old, SLUG, a, b)


def test_list_patches_are_shortest():
    rng = random.Random(1)
    for _ in range(100):
        a = [rng.choice("abc") for _ in range(rng.randint(0, 6))]
        b = [rng.choice("abcd") for _ in range(rng.randint(0, 6))]
        last = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = [i]
            for j, y in enumerate(b, 1):
                row.append(last[j - 1] if x == y else 1 + min(last[j], row[-1], last[j - 1]))
            last = row
        assert len(P.json_patch(a, b)) == last[-1]
