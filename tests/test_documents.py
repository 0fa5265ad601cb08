import json
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from recordloom.errors import ConfigError, SheetError, ValidationError
from recordloom.operators import normalize as N
from recordloom.operators import validate as val
from recordloom.plans import config as cfg
from recordloom.sources import markdown as M
from recordloom.sources import records as R
from recordloom.sources import toml


def test_canonical_form():
    record = {"b": 1, "a": "x\ty", "f": 1.0, "t": {"z": True, "y": {"n": 1}}, "l": [3, 1], "none": None, "rows": [{"k": 1}, {"k": 2}], "odd key": "ü", "m": 'a\r\nb"""c\\'}
    text = toml.serialize(record)
    assert text.startswith('a = "x\\ty"\nb = 1\nf = 1.0\nl = [3, 1]\nm = """\n')
    assert '"odd key" = "ü"' in text and "[t]\nz = true\n\n[t.y]\nn = 1" in text and "[[rows]]\nk = 1\n\n[[rows]]\nk = 2" in text
    back = toml.parse(text)
    assert back == {k: v for k, v in record.items() if v is not None}
    assert toml.serialize(back) == text
    with pytest.raises(ConfigError):
        toml.serialize({"l": [1, None]})
    with pytest.raises(ConfigError):
        toml.parse("a = ")


def test_golden_values():
    source = "clock = 06:15:00\nday = 2001-02-03\nfraction = 2.75\nmoment = 2001-02-03T06:15:00Z\nnumber = 17\nplain = 2001-02-03T06:15:00\nwhole = 5.0\nzoned = 2001-02-03T06:15:00-05:00\n"
    assert toml.serialize(toml.parse(source)) == source
    assert toml.serialize(toml.parse("big = 31_618\nquote = 'it'\n")) == 'big = 31618\nquote = "it"\n'
    ends = 'bio = """\nline\nends in a quote""""\n'
    assert toml.serialize(toml.parse(ends)) == ends


_value = st.recursive(st.text(max_size=12) | st.integers(-(2**62), 2**62) | st.booleans() | st.floats(allow_nan=False), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=4), x, max_size=3), max_leaves=10)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.text(max_size=5), _value, max_size=5))
def test_toml_round_trip_and_idempotence(record):
    text = toml.serialize(record)
    back = toml.parse(text)
    assert back == json.loads(json.dumps(toml.sort_keys(record))) or back == toml.sort_keys(record)
    assert toml.serialize(back) == text


def test_batches_of_toml(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "n int, s string")
    out = [r[0] for r in df.select(toml.serialize_column(N.canonical_json(df))).collect()]
    assert out == ['n = 1\ns = "a"\n', "n = 2\n"]
    back = spark.createDataFrame([(t,) for t in out], "t string").select(toml.parse_column(F.col("t")).alias("d"))
    assert [json.loads(r.d) for r in back.collect()] == [{"n": 1, "s": "a"}, {"n": 2}]


def test_markdown():
    text = '+++\ntitle2 = "x"\n+++\n\n# Head\n\nbody\n+++\nmore\n'
    record = M.parse(text, "body", "title")
    assert record == {"title2": "x", "title": "Head", "body": "# Head\n\nbody\n+++\nmore\n"}
    assert M.serialize(record, "body", "title") == text
    assert M.parse("﻿plain", "body") == {"body": "plain"} and M.parse(text, "body", with_body=False) == {"title2": "x"}
    assert M.parse("+++\n+++\nx", "b") == {"b": "x"}
    with pytest.raises(ConfigError):
        M.parse("+++\na = 1\n", "body")
    with pytest.raises(ValidationError):
        M.serialize({"title": "Other", "body": "# Head"}, "body", "title")
    assert M.serialize({"title": "New", "body": "x"}, "body", "title") == "# New\n\nx"
    assert M.reconcile({"body": "# A\n"}, {"title": "B"}, "body", "title")["body"] == "# B\n"
    assert M.reconcile({"body": "# A\n"}, {"body": "no head"}, "body", "title")["title"] is None


def test_markdown_columns_agree(spark):
    texts = ['+++\na = 1\n+++\n\nbody\n', "plain", "+++\n+++\nx", '+++\na = "+++"\n+++\nb\n+++\nc']
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [tuple(r) for r in df.select(M.front_column(F.col("t")), M.body_column(F.col("t"))).collect()]
    assert got == [M.split(t) for t in texts]


def test_collation_and_list_rules(spark):
    assert N.sort_list(["10", "9", "a", "B", "é", "e", "-b"], True) == ["9", "10", "a", "B", "-b", "é", "e"]
    assert N.sort_list([3, 1], False) == [3, 1] and N.sort_list([3, 1, 2], lambda a, b: b - a) == [3, 2, 1]
    items = [{"p": 1, "q": 2}, {"p": 1, "q": 3}]
    assert N.sort_list(items, {"p": "ASC", "q": "DESC"}) == [items[1], items[0]]
    for bad in ("x", [], [1], {"a": "UP"}):
        with pytest.raises(ConfigError):
            N.sort_list([], bad)
    df = spark.sql("select array('b10', 'b9', 'A') as l, array(named_struct('k', 2), named_struct('k', 1)) as s")
    out = df.select(N.sorted_list(df, "l", True).alias("l"), N.sorted_list(df, "s", ["k"]).alias("s")).first()
    assert out.l == ["A", "b9", "b10"] and [x.k for x in out.s] == [1, 2]
    once = N.normalize(df, {"l": True, "s": ["k"]})
    assert N.changed_by_normalize(df, {"l": True}).count() == 1 and N.changed_by_normalize(once.drop("_blob"), {"l": True, "s": ["k"]}).count() == 0
    assert N.normalize_record({"z": 1, "a": ["b", "A"], "n": None}, {"a": True}) == {"a": ["A", "b"], "z": 1}


def test_small_helpers():
    assert N.mime_type("x.png") == "image/png" and N.mime_type("x.unknown") == "application/octet-stream"
    assert N.join_path(".", "/a/", "", "b/./c") == "a/b/c"
    assert N.label({"slug": "s"}) == "slug=s" and N.label({"id": 3}) == "id=3" and N.label({}) == "no id field"
    assert N.text_of([1.0, True, None, {"a": 1}]) == "1,true,,[object Object]"


SCHEMA = {
    "type": "object",
    "required": ["a", "b"],
    "properties": {
        "a": {"type": "integer", "minimum": 2, "multipleOf": 2},
        "b": {"type": "string", "minLength": 2, "pattern": "^x", "enum": ["x1", "x22"]},
        "c": {"type": "array", "minItems": 1, "uniqueItems": True, "items": {"type": "string", "maxLength": 2}},
        "d": {"type": "object", "required": ["e"], "properties": {"e": {"type": "number", "exclusiveMaximum": 5}}, "additionalProperties": False},
        "f": {"format": "email"},
        "g": {"anyOf": [{"type": "integer", "maximum": 1}, {"type": "integer", "minimum": 5}]},
    },
}


def test_columns_and_documents_find_the_same(spark):
    rows = [
        (2, "x1", ["a", "b"], (1.0, None), "a@b.c", 1), (1, "y", ["a", "a"], (9.0, 1), "nope", 3), (None, None, [], None, None, None), (4, "x22", ["abc", None], (None, 2), "q@r", 7), (3, "x", None, (5.0, None), "", 5),
    ]
    df = spark.createDataFrame(rows, "a int, b string, c array<string>, d struct<e: double, h: int>, f string, g int")
    assert val.compiled(df, SCHEMA) is not None
    found = df.withColumn("i", val.issues_column(df, SCHEMA)).withColumn("j", F.to_json(F.struct("a", "b", "c", "d", "f", "g"))).collect()
    for r in found:
        document = {k: v for k, v in json.loads(r.j).items() if v is not None}
        if "c" in document:
            document["c"] = [x for x in document["c"]]
        want = sorted((i["path"], i["schema_path"], i["code"]) for i in val.document_issues(document, SCHEMA) if not (i["path"].startswith("/c/") and i["code"] == "type"))
        assert sorted((i.path, i.schema_path, i.code) for i in r.i) == want


def test_issues_counts_and_fallback(spark):
    df = spark.createDataFrame([("p", 1, "long enough"), ("q", 2, "x")], "_path string, n int, s string")
    schema = {"if": {"properties": {"n": {"const": 2}}}, "then": {"properties": {"s": {"minLength": 3}}}}
    assert val.compiled(df, schema) is None
    assert [(r._path, r.path, r.code) for r in val.issues(df, schema).collect()] == [("q", "/s", "minLength")]
    assert [r.n for r in val.valid(df, schema).collect()] == [1]
    assert [tuple(r) for r in val.issue_counts(df, {"required": ["zzz"]}).collect()] == [("required", 2)]
    both = {"allOf": [{"required": ["zzz"]}, {"properties": {"n": {"maximum": 1}}}]}
    assert sorted((r.schema_path) for r in val.issues(df, both).collect()) == ["#/allOf/0/required", "#/allOf/0/required", "#/allOf/1/properties/n/maximum"]


@pytest.mark.parametrize("schema,good,bad", [
    ({"oneOf": [{"type": "integer"}, {"minimum": 2}]}, 1, 3), ({"not": {"type": "string"}}, 1, "x"), ({"contains": {"const": 1}}, [2, 1], [2]), ({"propertyNames": {"pattern": "^a"}}, {"ab": 1}, {"b": 1}),
    ({"dependencies": {"a": ["b"]}}, {"a": 1, "b": 1}, {"a": 1}), ({"patternProperties": {"^n": {"type": "integer"}}}, {"n1": 1}, {"n1": "x"}), ({"items": [{"type": "integer"}], "additionalItems": False}, [1], [1, 2]),
    ({"definitions": {"p": {"minimum": 3}}, "properties": {"x": {"$ref": "#/definitions/p"}}}, {"x": 3}, {"x": 2}), ({"type": ["integer", "null"]}, 3, 3.5), ({"type": "integer"}, 3.0, True), ({"enum": [1, "1"]}, "1", "2"),
    ({"format": "date-time"}, "2024-01-02T03:04:05Z", "2024-01-02"), ({"format": "uuid"}, "019e4021-2d09-7e80-a14a-d38e8c039ec4", "x"), ({"format": "made-up"}, "x", None), ({"minProperties": 1}, {"a": 1}, {}), ({"multipleOf": 0.1}, 0.3, 0.35),
])
def test_keywords(schema, good, bad):
    assert val.document_issues(good, schema) == []
    assert bad is None or val.document_issues(bad, schema)


@pytest.mark.parametrize("schema", [{"typ": "string"}, {"properties": {"a": {"minimun": 1}}}, {"type": "text"}, {"pattern": "["}, {"required": "a"}, {"allOf": {}}, {"items": {"unknown": 1}}])
def test_bad_schemas(schema):
    with pytest.raises(ConfigError):
        val.check_schema(schema)


def test_configs():
    c = cfg.parse("people", '[sheet]\npath = "${{ year }}/${{ slug }}"\nroot = "data"\n[sheet.fields.tags]\nsort = true\n[sheet.schema]\ntype = "object"\n')
    assert c.root == "data" and c.sort == {"tags": True} and c.schema == {"type": "object"} and c.extension == ".toml"
    m = cfg.from_table("posts", {"path": "${{ slug }}", "format": {"type": "markdown", "body": "body", "title": "title"}})
    assert (m.format, m.body, m.title, m.extension) == ("markdown", "body", "title", ".md")
    for bad in ({}, {"path": " "}, {"path": "${{ a }}", "format": "pdf"}, {"path": "${{ a }}", "format": "markdown"}, {"path": "${{ body }}", "format": {"type": "mdx", "body": "body"}}, {"path": "x", "schema": {"zzz": 1}}, {"path": "x", "implements": "y"}, {"path": "x", "root": 1}):
        with pytest.raises(SheetError):
            cfg.from_table("bad", bad)
    with pytest.raises(ConfigError):
        cfg.parse("x", "a = 1")
    new, warnings = cfg.migrate({"path": "x", "fields": {"a": {"type": "string", "enum": ["p"], "trueValues": ["y"]}, "b": {"sort": True, "default": 1}}})
    assert new == {"path": "x", "schema": {"type": "object", "properties": {"a": {"type": "string", "enum": ["p"]}, "b": {"default": 1}}}, "fields": {"b": {"sort": True}}} and len(warnings) == 1
    assert cfg.property_summary({"required": ["a"], "properties": {"a": {"type": "string", "format": "email", "enum": ["x", "y"]}}}) == {"a": "string (email) [required] enum: x|y"}
    assert cfg.scaffold("${{ a }}")["root"] == "."


def test_reading_and_writing(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"a": 1, "b": "x"},\n {"a": 2}]')
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n{"a": 2}\n')
    (tmp_path / "a.csv").write_text("a,b\n 1 ,x\n2,\n")
    (tmp_path / "a.tsv").write_text("a\tb\n1\tx\n")
    (tmp_path / "a.toml").write_text('[[records]]\na = 1\ns = "x"\n[[records]]\na = 2\n')
    (tmp_path / "b.toml").write_text("[p]\na = 1\n[q]\na = 2\n")
    (tmp_path / "c.toml").write_text("a = 1\nx = 1.5\nok = true\n")
    rows = lambda name: sorted((r.asDict() for r in R.read(spark, str(tmp_path / name)).collect()), key=str)
    assert rows("a.json") == [{"a": 1, "b": "x"}, {"a": 2, "b": None}] and rows("a.jsonl") == [{"a": 1}, {"a": 2}]
    assert rows("a.csv") == [{"a": "1", "b": "x"}, {"a": "2", "b": None}] and rows("a.tsv") == [{"a": "1", "b": "x"}]
    assert rows("a.toml") == [{"a": 1, "s": "x"}, {"a": 2, "s": None}] and rows("b.toml") == [{"a": 1}, {"a": 2}] and rows("c.toml") == [{"a": 1, "ok": True, "x": 1.5}]
    with pytest.raises(ValidationError):
        R.read(spark, "x.pdf")
    df = spark.createDataFrame([("p", 1, ["x"]), ("q", None, None)], "_path string, a int, l array<string>")
    for kind in ("json", "ndjson", "csv", "toml", "tsv"):
        assert R.export(df, str(tmp_path / f"out.{kind}"), kind) == 2
    assert json.loads((tmp_path / "out.json").read_text()) == [{"a": 1, "l": ["x"]}, {}]
    assert (tmp_path / "out.csv").read_text() == 'a,l\n1,"[""x""]"\n,\n' and (tmp_path / "out.csv").stat().st_mode & 0o777 == 0o600
    R.write(df, str(tmp_path / "many"), "csv")
    assert R.read(spark, str(tmp_path / "many"), "csv").count() == 2
    assert R.to_text([{"a": 1, "b": [2]}, {"a": None}], "csv") == 'a,b\n1,[2]\n,\n' and R.to_text([{"a": 1}], "toml") == "[[records]]\na = 1\n\n"
    assert R.render_table(df.select("a"), "things").startswith("things[2]{a}:") and R.render_table(df.where("false"), "things") == "things: no records"


def test_one_record_a_file(spark, tmp_path):
    (tmp_path / "s" / "x").mkdir(parents=True)
    (tmp_path / "s" / "x" / "one.toml").write_text("a = 1\n")
    (tmp_path / "s" / "two.toml").write_text("a = 2\n")
    (tmp_path / "s" / "post.md").write_text('+++\na = 3\n+++\n\n# T\n')
    rows = {r._path: json.loads(r.document) for r in R.read_files(spark, str(tmp_path / "s")).collect()}
    assert rows == {"x/one": {"a": 1}, "two": {"a": 2}}
    post = R.read_files(spark, str(tmp_path / "s"), "markdown", title="title").first()
    assert (post._path, json.loads(post.document), post.body, post.title) == ("post", {"a": 3}, "# T\n", "T")
    assert "body" not in R.read_files(spark, str(tmp_path / "s"), "markdown", with_body=False).columns


def test_request_input():
    assert R.parse_input('{"a": 1}') == [{"a": 1}] and R.parse_input('[{"a": 1}, {}]') == [{"a": 1}, {}] and R.parse_input('{"a": 1}\n\n{"a": 2}') == [{"a": 1}, {"a": 2}]
    for bad in ("", "[1]", '{"a": 1}\nx', "3"):
        with pytest.raises(ValidationError):
            R.parse_input(bad)
    assert R.decode(b"\xe9", "latin1") == "é" and R.decode("hé".encode("utf-16-le"), "utf16le") == "hé" and R.decode(b"hi", "hex") == "6869" and R.decode(b"hi", "base64") == "aGk="
    with pytest.raises(ValidationError):
        R.decode(b"", "ebcdic")


def test_plain_values():
    assert toml.to_plain({"x": math.inf, "d": toml.parse("d = 1979-05-27T07:32:00Z")["d"]}) == {"x": None, "d": "1979-05-27T07:32:00Z"}
