"""Registered queries against their SQL, over odd tables."""

import itertools
import re
import tomllib

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from recordloom.functions import values as V
from recordloom.sources import records as R
from recordloom.sources import toml


def by_sql(name, folder, *tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    return con.execute(entry.oracle_sql()[name]).fetchall()


def test_titles_of_odd_first_lines(spark, tmp_path):
    blanks = " \t\x0b\x85\xa0    ​   　﻿\r\n\x1f|"
    texts = [None, "", "# a\n# b", "|", "x|", "x" * 100_000, "\t" * 100_000, " " * 100_000 + "\nx", "x\t" * 50_000]
    texts += [f.format(a, b) for a, b in itertools.product(blanks, repeat=2) for f in ("{}{}", "{}x{}", "x{}{}", "{} x\t{}\ny")]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = entry.queries()["markdown_title"](spark, str(tmp_path)).collect()
    assert {tuple(r) for r in found} == set(by_sql("markdown_title", tmp_path, "documents")) and len(found) == len(texts)


def test_headings_of_blanks_take_no_longer(spark):
    lines = ["".join(x) for n in range(6) for x in itertools.product("a \t\r\n", repeat=n)]
    df = spark.createDataFrame([(f"b\n# {x}\n# c",) for x in [*lines, "\t" * 200_000 + "|", "a" + " " * 200_000 + "\rb"]], "t string")
    for text, found in df.select("t", V.first_h1(F.col("t"))).collect():
        if len(text) < 100:
            assert found == re.search(r"^# ([^\n\r]+?)[\t ]*\r?$", text, re.MULTILINE)[1]
        else:
            assert found in ("\t" * 200_000 + "|", "c")


def test_one_file_is_parsed_on_all_cores(spark, tmp_path):
    part = spark.range(5000).select(F.col("id").alias("p_partkey"), (900 + F.col("id") / 10).alias("p_retailprice"))
    part.coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    found = entry.queries()["digits_stay_text"](spark, str(tmp_path))
    sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) >= 2 * spark.sparkContext.defaultParallelism and max(sizes) < 4 * 5000 / len(sizes)
    assert sorted(map(tuple, found.collect())) == sorted(by_sql("digits_stay_text", tmp_path, "part"))


#: Texts and the kinds of a that Spark's own reading finds in them.
_ODD = {
    '{"a": 1}': "bigint", "{'a': 1}": "bigint", '{"a": 1, "a": "x"}': "string", '{"a": 9223372036854775808}': "double", '{"a": -9223372036854775808}': "bigint", '{"a": 1e5}': "double", '{"a": 1.0}': "double",
    '{"a": true}': "boolean", '{"a": [1]}': "array<string>", '{"a": {"a": 1}}': "string", '{"a": null}': "string", '{"a": "1e5"}': "string", '{"a": 1} x': "bigint", '{"a": 1': None, "3": None, "": None, None: None,
    '{"a": 1' + "0" * 1500 + "}": None, '{"a": 1.' + "1" * 1500 + "}": None, '{"a": ' + "[" * 3000 + "]" * 3000 + "}": None, '{"a": "\\ud800"}': "string",
}


@pytest.mark.parametrize("text", _ODD)
def test_kinds_of_odd_texts(spark, text):
    df = spark.createDataFrame([(text,)], "document string")
    by_variant = df.select(F.explode(F.from_json("document", "map<string,variant>")).alias("k", "v")).select("k", R._kind(F.col("v")).alias("kind")).collect()
    found = R.from_documents(df)
    assert {f.name: f.dataType for f in found.schema.fields} == {k: R._merge({r.kind for r in by_variant}) for k in {r.k for r in by_variant}}
    assert [f.dataType.simpleString() for f in found.schema.fields] == [_ODD[text]] * (_ODD[text] is not None)


def test_simple_lines_are_read_as_the_full_parser_does():
    lines = ["a = 1", "b = -0", "c = +1", "d = 01", "e = 1_0", "f = -1.50", "g = 1.", "h = 1e5", "i = true", "j = True", 'k = ""', 'l = "é\x85"', 'm = "\\n"', 'n = "\t"', 'o = "\x7f"', "p= 1", "q = 1 ", "1 = 2", "a.b = 1", "[t]", "", "a = 2", "s = 123456789012345678901", 't = """']
    for text in ["".join(x) for n in range(3) for x in itertools.product([x + end for x in lines for end in ("\n", "", "\r\n")], repeat=n)]:
        try:
            want = repr(tomllib.loads(text))
        except tomllib.TOMLDecodeError:
            want = "None"
        assert repr(toml._parse_flat(text)) in ("None", want), text
    assert toml._parse_flat('a = 1\nb = "x"\nc = -1.5\nd = true\n') == {"a": 1, "b": "x", "c": -1.5, "d": True}
