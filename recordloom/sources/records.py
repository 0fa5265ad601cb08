"""Reading and writing records as JSON, JSON lines, TOML, CSV and TSV."""

from __future__ import annotations

import csv
import io
import json
import os
import re
from collections.abc import Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.errors import ConfigError, ReferenceError_, ValidationError
from recordloom.operators.normalize import documents
from recordloom.sources import markdown, toml

ENCODINGS = {"utf8": "utf-8", "utf-8": "utf-8", "utf16le": "utf-16-le", "utf-16le": "utf-16-le", "ucs2": "utf-16-le", "ascii": "ascii", "latin1": "latin-1", "binary": "latin-1", "base64": "base64", "hex": "hex"}


def decode(data: bytes, encoding: str = "utf8") -> str:
    """Bytes as text in one of the known encodings."""
    name = ENCODINGS.get(encoding.lower())
    if name is None:
        raise ValidationError(f"unknown encoding {encoding!r}", "input_invalid")
    if name == "base64":
        import base64

        return base64.b64encode(data).decode()
    return data.hex() if name == "hex" else data.decode(name, "replace")


def format_of(path: str) -> str:
    ext = os.path.splitext(path)[1].lower()
    known = {".json": "json", ".jsonl": "jsonl", ".ndjson": "jsonl", ".toml": "toml", ".csv": "csv", ".tsv": "tsv", ".md": "markdown", ".mdx": "markdown"}
    if ext not in known:
        raise ValidationError(f"unknown format of {path!r}", "input_invalid")
    return known[ext]


def read(spark: SparkSession, path: str, format: str | None = None, encoding: str = "utf8") -> DataFrame:
    """Records of a file or folder, read by Spark's own sources; CSV and TSV are all text, trimmed."""
    kind = format or format_of(path)
    if kind == "json":
        return spark.read.option("multiLine", True).option("encoding", ENCODINGS[encoding]).json(path)
    if kind == "jsonl":
        return spark.read.json(path)
    if kind in ("csv", "tsv"):
        return spark.read.csv(path, header=True, inferSchema=False, sep="," if kind == "csv" else "\t", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, multiLine=True, encoding=ENCODINGS[encoding])
    if kind == "toml":
        texts = spark.read.text(path, wholetext=True)
        return from_documents(texts.select(_toml_records(F.col("value")).alias("d")).select(F.explode("d").alias("document")))
    if kind == "markdown":
        return read_files(spark, path, "markdown")
    raise ValidationError(f"unknown format {kind!r}", "input_invalid")


def _toml_records(text: Any) -> Any:
    @F.pandas_udf("array<string>")
    def run(p):  # type: ignore[no-untyped-def]
        return p.map(lambda t: [json.dumps(toml.to_plain(r)) for r in split_toml(toml.parse(t))])

    return run(text)


def split_toml(table: dict) -> list[dict]:
    """Records of a TOML document: [[records]], or every table where all entries are tables, or the document itself."""
    if isinstance(table.get("records"), list):
        return table["records"]
    if table and all(isinstance(v, dict) for v in table.values()):
        return list(table.values())
    return [table]


def from_documents(rows: DataFrame, column: str = "document") -> DataFrame:
    """JSON texts of records as typed columns; one pass over them finds the type of every field.

    Types are those of the JSON tokens: digits in quotes are text.  A field that
    is text in some record is text in all.
    """
    scanned = rows.select(column).mapInArrow(_scan, "k string, kind string, rest string")
    own = F.when(F.col("rest").isNull(), F.array(F.struct("k", "kind")))
    read = F.transform(F.map_entries(F.from_json("rest", "map<string,variant>")), lambda e: F.struct(e["key"].alias("k"), _kind(e["value"]).alias("kind")))
    found = scanned.select(F.inline(F.coalesce(own, read))).groupBy("k").agg(F.collect_set("kind").alias("kinds"))
    schema = T.StructType([T.StructField(r.k, _merge(set(r.kinds))) for r in found.orderBy("k").collect()])
    rest = [c for c in rows.columns if c != column]
    return rows.select(*rest, F.from_json(column, schema).alias("__d")).select(*rest, "__d.*")


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(field, kind) once for each of a task; texts that Python doesn't read as Spark may do as they are."""
    seen: set[tuple[str, str | None]] = set()
    for batch in batches:
        out: list[tuple[str | None, str | None, str | None]] = []
        for text in batch.column(0).to_pylist():
            if text is None:
                continue
            try:
                fields = _fields(text)
            except (ValueError, RecursionError):
                out.append((None, None, text))
                continue
            new = fields - seen
            seen |= new
            out += [(k, kind, None) for k, kind in new]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*out, strict=True) if out else ((), (), ()))], ["k", "kind", "rest"])


def _no_number(text: str) -> None:
    raise ValueError(text)


#: Objects become tuples of pairs, so that repeated names show.
_decode = json.JSONDecoder(object_pairs_hook=tuple, parse_constant=_no_number).decode
#: A number that may be too long for Spark.
_LONG = re.compile(r"[0-9.eE+-]{900}")


def _fields(text: str) -> set[tuple[str, str | None]]:
    """Names and kinds of the fields of a JSON object."""
    if len(text) > 900 and (text.count("[") + text.count("{") > 900 or _LONG.search(text)):
        raise ValueError("Spark's own limits tell")
    pairs = _decode(text)
    if type(pairs) is not tuple:
        raise ValueError("no object")
    out = set()
    for k, v in pairs:
        kind = _KINDS[type(v)]
        if kind == "bigint" and not -(2**63) <= v < 2**63:
            kind = "double"
        if kind == "double" and not abs(v) < 1e38:
            raise ValueError("Spark's own reading tells")
        k.encode()
        out.add((k, kind))
    return out


_KINDS = {str: "string", int: "bigint", float: "double", bool: "boolean", list: "list", tuple: "string", type(None): None}


def _kind(v: Any) -> Any:
    """Kind of a JSON value; null for null."""
    c = F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)
    return F.when(c == "BIGINT", "bigint").when(c.isin("DECIMAL", "DOUBLE", "FLOAT"), "double").when(c == "BOOLEAN", "boolean").when(c == "ARRAY", "list").when(c != "VOID", "string")


def _merge(kinds: set[str]) -> T.DataType:
    kinds = {k for k in kinds if k}
    if kinds == {"bigint"}:
        return T.LongType()
    if kinds and kinds <= {"bigint", "double"}:
        return T.DoubleType()
    if kinds == {"boolean"}:
        return T.BooleanType()
    if kinds == {"list"}:
        return T.ArrayType(T.StringType())
    return T.StringType()


def read_files(spark: SparkSession, folder: str, format: str = "toml", body: str = "body", title: str | None = None, with_body: bool = True) -> DataFrame:
    """A folder of one record a file: `_path` is the file's place without extension, `document` its fields as JSON.

    Markdown files also have their body as a column; without it, the body is
    neither parsed nor kept.
    """
    pattern = "*.toml" if format == "toml" else "*.{md,mdx}"
    root = folder.rstrip("/")
    files = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", True).text(root, wholetext=True).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("file"))
    base = root if "://" in root else "file://" + os.path.abspath(root)
    path = F.regexp_replace(F.regexp_replace(F.url_decode(F.regexp_replace("file", r"\+", "%2B")), r"^file:/+", "/"), r"\.[^./]+$", "")
    start = base.replace("file://", "").rstrip("/") + "/"
    own = files.select(F.substring(path, len(start) + 1, 1 << 20).alias("_path"), "text")
    if format == "toml":
        return own.select("_path", toml.parse_column(F.col("text")).alias("document"))
    out = own.select("_path", toml.parse_column(markdown.front_column(F.col("text"))).alias("document"), markdown.body_column(F.col("text")).alias(body))
    if title:
        from recordloom.functions.values import first_h1

        out = out.withColumn(title, first_h1(F.col(body)))
    return out if with_body else out.drop(body)


def parse_input(text: str) -> list[dict]:
    """Records of a request: a JSON object, a list of objects, or one object a line; errors name the line or position."""
    t = text.strip()
    if not t:
        raise ValidationError("no records were given", "input_invalid")
    try:
        whole = json.loads(t)
        found = whole if isinstance(whole, list) else [whole]
    except json.JSONDecodeError:
        found = []
        for k, line in enumerate([x.strip() for x in t.split("\n") if x.strip()]):
            try:
                found.append(json.loads(line))
            except json.JSONDecodeError:
                raise ValidationError(f"line {k + 1} is no JSON", "input_invalid") from None
    for k, r in enumerate(found):
        if not isinstance(r, dict):
            raise ValidationError(f"record {k + 1} is no object", "input_invalid")
    return found


def read_blob(spark: SparkSession, path: str) -> bytes:
    """Bytes of one file."""
    row = spark.read.format("binaryFile").load(path).select("content").head()
    if row is None:
        raise ReferenceError_(f"no file at {path!r}", "ref_not_found")
    return bytes(row["content"])


# writing:


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, for CSV."""
    out = [F.to_json(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)) else F.col(f"`{f.name}`") for f in df.schema.fields]
    return df.select(*out)


def visible(df: DataFrame, fields: Sequence[str] | None = None) -> DataFrame:
    """The fields to export; without a choice, all but the engine's own."""
    return df.select(*fields) if fields else df.drop("_path", "_sheet", "_blob")


def write(df: DataFrame, path: str, format: str, fields: Sequence[str] | None = None) -> None:
    """Write all records in parallel: json and ndjson as lines, csv and tsv with a header."""
    own = visible(df, fields)
    if format in ("json", "ndjson", "jsonl"):
        own.write.mode("overwrite").json(path)
    elif format in ("csv", "tsv"):
        flat(own).write.mode("overwrite").option("sep", "," if format == "csv" else "\t").csv(path, header=True)
    else:
        raise ValidationError(f"unknown format {format!r}", "input_invalid")


def export(df: DataFrame, path: str, format: str, fields: Sequence[str] | None = None) -> int:
    """One local file with all records, readable by its owner only; streams through the driver. Returns how many."""
    own = visible(df, fields)
    n = 0
    with open(os.open(path, os.O_CREAT | os.O_WRONLY | os.O_TRUNC, 0o600), "w", newline="") as f:
        if format == "csv" or format == "tsv":
            out = csv.writer(f, delimiter="," if format == "csv" else "\t", lineterminator="\n")
            out.writerow(own.columns)
            for row in flat(own).toLocalIterator():
                out.writerow(["" if v is None else str(v).lower() if isinstance(v, bool) else v for v in row])
                n += 1
        else:
            if format == "json":
                f.write("[")
            for d in documents(own, ()):
                f.write(("," if n and format == "json" else "") + (toml_block(d) if format == "toml" else json.dumps(d, ensure_ascii=False) + ("" if format == "json" else "\n")))
                n += 1
            if format == "json":
                f.write("]\n")
    return n


def toml_block(record: dict) -> str:
    return "[[records]]\n" + toml.serialize(record) + "\n"


def to_text(records: Sequence[dict], format: str, fields: Sequence[str] | None = None) -> str:
    """A few records as text; the header of CSV and TSV is fields or the keys of the first record."""
    if format in ("json", "ndjson", "jsonl"):
        return "".join(json.dumps({k: r[k] for k in (fields or r) if k in r}, ensure_ascii=False) + "\n" for r in records)
    if format == "toml":
        return "".join(toml_block({k: r[k] for k in (fields or r) if k in r}) for r in records)
    if format in ("csv", "tsv"):
        names = list(fields or (records[0] if records else []))
        f = io.StringIO()
        out = csv.writer(f, delimiter="," if format == "csv" else "\t", lineterminator="\n")
        out.writerow(names)
        out.writerows([["" if r.get(n) is None else json.dumps(r[n]) if isinstance(r[n], (dict, list)) else r[n] for n in names] for r in records])
        return f.getvalue()
    raise ConfigError(f"unknown format {format!r}")


def render_table(df: DataFrame, name: str, limit: int = 20) -> str:
    """A short text view: name[count]{fields} and a line for each record, or a note that there is none."""
    rows = df.limit(limit).collect()
    if not rows:
        return f"{name}: no records"
    lines = [f"{name}[{len(rows)}]{{{','.join(df.columns)}}}:"]
    lines += ["  " + ",".join("" if v is None else str(v) for v in r) for r in rows]
    return "\n".join(lines)
