import hashlib

import pytest
from pyspark.sql import functions as F

from recordloom.errors import FilterError
from recordloom.functions import values as V
from recordloom.operators import analytics as A
from recordloom.operators import filters as flt

ROWS = [
    ("a", "public", "classified", "slate", "2023-05-01", False),
    ("b", "private", "unclassified", None, "2021-01-01", False),
    ("c", "public", "unclassified", None, "2020-06-01", True),
    ("d", "public", "classified", "sencha", "2024-01-01", False),
    ("e", "private", "classified", "slate", "2019-01-01", True),
]


@pytest.fixture(scope="module")
def repos(spark):
    return spark.createDataFrame(ROWS, "name string, visibility string, status string, target_team string, pushed_at string, archived boolean").withColumn("_path", F.col("name"))


def names(df, *clauses):
    return "".join(sorted(r.name for r in flt.where(df, clauses).collect()))


@pytest.mark.parametrize(
    "clauses,want",
    [
        (["status=unclassified"], "bc"), (["pushed_at<2022-01-01"], "bce"), (["target_team!=slate"], "bcd"), (["target_team="], "bc"), (["target_team!="], "ade"), (["target_team:present"], "ade"),
        (["target_team:empty"], "bc"), (["archived=true"], "ce"), (["archived=yes"], ""), (["archived!=yes"], "abcde"), (["name in (a, e,)"], "ae"), (["name IN (b)"], "b"), (["name in ()"], ""),
        (["name~^[ab]"], "ab"), (["archived~tru"], "ce"), (["archived:present", "visibility=public"], "acd"), ([], "abcde"), (["missing=x"], ""), (["missing="], "abcde"), (["missing>1"], ""),
        (["pushed_at>=2021-01-01", "pushed_at<=2023-05-01"], "ab"), (["target_team>sl"], "ae"),
    ],
)
def test_clauses(repos, clauses, want):
    assert names(repos, *clauses) == want


@pytest.mark.parametrize("bad", ["garbage", "name=a~b", "a=b>=c", "=x", "", "name~["])
def test_malformed_clauses(repos, bad):
    with pytest.raises(FilterError):
        flt.where(repos, [bad])


def test_operator_is_found_by_kind_not_place():
    assert flt.parse("a=b") == ("a", "=", "b")
    assert flt.parse("a!=b") == ("a", "!=", "b")
    assert flt.parse("a>=1") == ("a", ">=", "1")


def test_numbers_dates_and_lists(spark):
    df = spark.sql("select * from values (0, 1.5D, timestamp_ntz'2024-01-02 03:04:05.678', array(1, 2), date'2024-01-02'), (3, double('NaN'), null, array(), null) as t(n, x, t, l, d)").withColumn("name", F.col("n").cast("string"))
    assert names(df, "n=") == "0" and names(df, "n=0x0") == "0" and names(df, "n=zero") == "" and names(df, "n!=zero") == "03"
    assert names(df, "n>") == "3" and names(df, "x>1") == "0" and names(df, "x>=NaN") == "" and names(df, "x~NaN") == "3"
    assert names(df, "t=2024-01-02T03:04:05.678Z") == "0" and names(df, "t>2024-01-02") == "0" and names(df, "t<2024-01-02T04:00:00+01:00") == "" and names(df, "t>nonsense") == ""
    assert names(df, "l:present") == "0" and names(df, "l=1,2") == "0" and names(df, "l:empty") == "3"
    assert names(df, "d=2024-01-02T00:00:00.000Z") == "0" and names(df, "d<2024-01-03") == "0"
    assert names(df, "n in (3, 4)") == "3" and names(df, "n~^[03]$") == "03" and names(df, "n:present") == "03"


def test_filters_reach_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("id", "cast(id as string) s", "cast(id as double) d").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    plan = flt.where(df, ["id>=50", "s=7", "d<3"]).select("id")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(id,50)" in plan and "EqualTo(s,7)" in plan and "LessThan(d,3" in plan


def test_mappings(spark):
    df = spark.sql("select 1 as n, 1.0D as x, 'a' as s, named_struct('city', 'x', 'zip', 5) as address, array(1, 2) as l, cast(null as struct<city: string>) as gone")
    hit = lambda c: df.where(flt.matching(df, c)).count() == 1
    assert hit({}) and hit({"n": 1}) and not hit({"n": 1.0}) and not hit({"n": "1"}) and hit({"x": 1.0}) and not hit({"x": 1})
    assert hit({"address": {"city": "x"}}) and hit({"address": {}}) and not hit({"address": {"city": "y"}}) and not hit({"gone": {}}) and not hit({"address": {"none": 1}})
    assert hit({"l": [1, 2]}) and not hit({"l": [2, 1]}) and not hit({"l": [1]}) and not hit({"missing": 1}) and not hit({"n": None}) and not hit({"n": True})
    assert hit({"n": lambda c, d: c + 1 == 2}) and hit({"n": F.col("n") > 0}) and not hit({"s": {"a": 1}})
    with pytest.raises(TypeError):
        flt.matching(df, {"s": "a"}, body="s", with_body=False)


def test_facets_and_counts(repos):
    assert [tuple(r) for r in A.facets(repos, "target_team").collect()] == [("", 2), ("slate", 2), ("sencha", 1)]
    assert [tuple(r) for r in A.facets(repos, "archived").collect()] == [("false", 3), ("true", 2)]
    assert [tuple(r) for r in A.facets(repos, "nothing").collect()] == [("", 5)]
    assert [tuple(r) for r in A.distinct(repos, "visibility", ["archived=false"]).collect()] == [("private", 1), ("public", 2)]
    assert tuple(A.count(repos, ["status=classified"]).first()) == (3, 5) and tuple(A.count(repos).first()) == (5, 5)
    assert tuple(A.cardinality(repos, "status").first()) == (2, 5)
    assert tuple(A.shown_of_total(repos, [], 3).first()) == (3, 5)
    assert A.facets(repos.where("false"), "nothing").count() == 0


def test_order_and_limits(repos):
    order = lambda **k: "".join(r.name for r in A.query(repos, **k).collect())
    assert order(sort="pushed_at") == "ecbad" and order(sort="pushed_at", desc=True) == "dabce"
    assert order(sort="target_team") == "daebc" and order(sort="target_team", desc=True) == "aedbc"
    assert order(sort="archived") == "abdce" and order(limit=2) == "ab" and order(sort="none") == "abcde"
    assert [A.clamp_limit(x) for x in (None, "x", 0, -5, 7, "12", 10**9)] == [100, 100, 100, 1, 7, 12, 10_000]
    assert A.first(repos, ["archived=true"]).first().name == "c"
    plan = A.query(repos, sort="pushed_at", limit=2)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_projection(repos):
    assert A.project(repos, ["status", "zzz", "name", "status"]).columns == ["status", "name"]
    schema = {"properties": {"a": {"type": "string"}, "b": {"type": "object"}, "c": {"type": "integer"}, "d": {"type": "boolean"}, "e": {"type": "number"}}}
    assert A.default_fields(["slug"], schema) == ["slug", "a", "c", "d"]
    assert A.default_fields(["year", "slug"], None, markdown=True) == ["year", "slug", "title", "body_size"]
    assert A.with_extras(["a"], ["b", "a"]) == ["a", "b"]


def test_text_of_numbers(spark):
    cases = [(1.0, "1"), (1e7, "10000000"), (12345678.9, "12345678.9"), (1e21, "1e+21"), (1.5e-7, "1.5e-7"), (0.000001, "0.000001"), (0.00012, "0.00012"), (float("nan"), "NaN"), (-2.5, "-2.5"), (1e-8, "1e-8"), (-0.0, "0"), (float("-inf"), "-Infinity"), (123456789012345680000.0, "123456789012345680000")]
    df = spark.createDataFrame([(x,) for x, _ in cases], "x double")
    assert [r[0] for r in df.select(V.js_string(F.col("x"), df.schema["x"].dataType)).collect()] == [t for _, t in cases]


@pytest.mark.parametrize("text,want", [("", 0), (" 12 ", 12), ("0x1F", 31), ("1e3", 1000), (".5", 0.5), ("5.", 5), ("-Infinity", float("-inf")), ("0b11", 3)])
def test_number_literals(text, want):
    assert V.js_number(text) == want


@pytest.mark.parametrize("text", ["x", "1_000", "0x", "--1", "inf", "nan", "1 2"])
def test_no_numbers(text):
    assert V.js_number(text) != V.js_number(text)


def test_text_functions(spark):
    df = spark.createDataFrame([("hi", "intro\n# One \n# Two\n"), ("é€", "no heading"), (None, None)], "t string, body string")
    rows = df.select(V.blob_hash(F.col("t")).alias("h"), V.body_size(F.col("t")).alias("n"), V.truncated(F.col("t"), 1).alias("c"), V.first_h1(F.col("body")).alias("h1"), V.rewrite_h1(F.col("body"), F.lit("New")).alias("re")).collect()
    assert rows[0].h == hashlib.sha1(b"blob 2\0hi").hexdigest() and [r.n for r in rows] == [2, 5, 0]
    assert rows[0].c == "…" and [r.h1 for r in rows] == ["One", None, None]
    assert rows[0].re == "intro\n# New\n# Two\n" or rows[0].re.startswith("intro\n# New")
    assert rows[1].re == "# New\n\nno heading" and rows[2].re is None


def test_inference(spark):
    df = spark.sql("select * from values (1, 1.0D, 'a', array('x')), (2, 2.5D, null, array('y')) as t(i, x, s, l)")
    assert A.infer(df) == {"type": "object", "required": ["i", "l", "x"], "properties": {"i": {"type": "integer", "minimum": 1, "maximum": 2}, "x": {"type": ["integer", "number"], "minimum": 1.0, "maximum": 2.5}, "s": {"type": "string"}, "l": {"type": "array", "items": {"type": "string"}}}}
    from recordloom.errors import SheetError

    with pytest.raises(SheetError):
        A.infer(df.where("false"))
