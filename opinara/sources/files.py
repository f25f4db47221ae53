"""Readers of review files and payloads, and sinks."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = ("text", "rating", "date", "source")


def read_rows(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """CSV (header, all strings, byte order mark removed), JSON (array of objects, columns in the order in
    which keys first appear), Excel (first sheet, header row) or Parquet."""
    if kind == "csv":
        df = spark.read.csv(path, header=True, multiLine=True, escape='"')
        return df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])
    if kind == "json":
        df = spark.read.json(path, multiLine=True)
        if "_corrupt_record" in df.columns:
            raise ValueError("not an array of objects")
        return df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in _key_order(spark, path, df.columns)])
    if kind == "excel":
        return excel_rows(spark, path)
    if kind == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"unknown kind: {kind}")


def _key_order(spark: SparkSession, path: str, columns: list[str]) -> list[str]:
    """``columns`` in the order of first appearance; what reaches the driver is one row a key."""
    text = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", "array<map<string,string>>")).alias("row", "m"))
    first = text.select("row", F.posexplode(F.map_keys("m")).alias("k", "key")).groupBy("key").agg(F.min(F.struct("row", "k")).alias("at"))
    known = [r["key"] for r in first.orderBy("at").collect()]
    return [c for c in known if c in columns] + [c for c in columns if c not in known]


_CELL = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _sheet(content: bytes) -> list[list[str | None]]:
    """Cells of a workbook's first sheet as text, row by row."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = book.namelist()
        shared = ["".join(t.text or "" for t in si.iter(f"{_CELL}t")) for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        sheet = min((n for n in names if re.fullmatch(r"xl/worksheets/sheet[0-9]+\.xml", n)), key=lambda n: int(re.search("[0-9]+", n).group()))
        rows = []
        for row in ElementTree.fromstring(book.read(sheet)).iter(f"{_CELL}row"):
            cells: list[str | None] = []
            for c in row.iter(f"{_CELL}c"):
                at = 0
                for letter in re.match("[A-Z]*", c.get("r", "")).group():
                    at = at * 26 + ord(letter) - 64
                cells += [None] * (at - 1 - len(cells))
                value = c.find(f"{_CELL}v")
                text = value.text if value is not None else "".join(t.text or "" for t in c.iter(f"{_CELL}t"))
                cells.append(shared[int(text)] if c.get("t") == "s" and text else text or None)
            rows.append(cells)
        return rows


def excel_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of workbooks with one header; a file is read in one task, as it is no larger than an upload."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(*(c.to_pylist() for c in batch.columns)):
                rows = _sheet(content)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows)), pa.array(range(len(rows)), pa.int64()), pa.array(rows, pa.list_(pa.string()))], ["path", "row", "cells"])

    cells = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(work, "path string, row bigint, cells array<string>")
    header = cells.where("row = 0").orderBy("path").select("cells").first()
    names = [x for x in (header["cells"] if header else []) if x]
    body = cells.where("row > 0")
    return body.select(*[F.get("cells", F.lit(k)).alias(n) for k, n in enumerate(names)])


def preview(df: DataFrame, n: int = 20) -> list[dict]:
    """The first rows of an upload, for a person to look at."""
    return [r.asDict() for r in df.limit(n).collect()]


def map_columns(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """The mapped fields under their canonical names; ``text`` is required."""
    if "text" not in mapping or set(mapping) - set(FIELDS) or set(mapping.values()) - set(df.columns):
        raise ValueError(f"mapping must name columns of the file for text and any of {FIELDS}")
    return df.select(*[(F.col(f"`{mapping[f]}`") if f in mapping else F.lit(None)).cast("string").alias(f) for f in FIELDS])


def file_registry(spark: SparkSession, path: str, most_bytes: int = 25 << 20, known: DataFrame | None = None, uploads: DataFrame | None = None) -> DataFrame:
    """(path, sha256, status) of uploaded files: too_large, duplicate (the content of an earlier path, or
    in ``known``) or new; and empty for those of ``uploads`` (path) that hold nothing, as Spark's
    readers leave empty files out."""
    files = spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))
    first = files.groupBy("sha256").agg(F.min("path").alias("first"))
    old = (known.select("sha256") if known is not None else spark.createDataFrame([], "sha256 string")).distinct().withColumn("known", F.lit(True))
    state = F.when(F.col("length") > most_bytes, "too_large").when(F.col("known") | (F.col("path") > F.col("first")), "duplicate").otherwise("new")
    found = files.join(first, "sha256").join(old, "sha256", "left").select("path", "sha256", state.alias("status"))
    if uploads is None:
        return found
    return uploads.select("path").join(found, "path", "left").withColumn("status", F.coalesce("status", F.lit("empty")))


def issues(payload: DataFrame, column: str = "payload") -> DataFrame:
    """Reviews of an issue tracker's JSON arrays: pull requests dropped, title and body joined, 20 labels at most."""
    kind = "array<struct<id:bigint,title:string,body:string,created_at:string,labels:array<struct<name:string>>,pull_request:struct<url:string>>>"
    each = payload.select(F.explode(F.from_json(column, kind)).alias("i")).select("i.*").where("pull_request IS NULL")
    return each.select(F.col("id").cast("string").alias("external_review_id"), F.substring(F.concat_ws("\n\n", "title", "body"), 1, 20000).alias("text"), F.to_date("created_at").alias("date"), F.slice(F.transform("labels", lambda x: x["name"]), 1, 20).alias("labels"))


def relevant(records: DataFrame, aliases: list[str]) -> DataFrame:
    """Records of 12 characters or more that name one of the aliases."""
    low = F.lower("text")
    hit = F.lit(False)
    for a in aliases:
        hit = hit | low.contains(a.lower())
    return records.where((F.length("text") >= 12) & hit)


def first_level(records: DataFrame, source: str = "source", level: str = "level") -> DataFrame:
    """Per source, the records of the lowest level that has any."""
    least = records.groupBy(source).agg(F.min(level).alias("_least"))
    return records.join(least, source).where(F.col(level) == F.col("_least")).drop("_least")


def safe_cell(value: Column) -> Column:
    """Text that a spreadsheet would read as a formula gets an apostrophe."""
    return F.when(value.rlike(r"^[ \t\r\n\x{feff}]*[=+\-@]"), F.concat(F.lit("'"), value)).otherwise(value)


def append_reviews(df: DataFrame, path: str) -> None:
    df.write.mode("append").partitionBy("project_id").parquet(path)


def replace_projects(df: DataFrame, path: str) -> None:
    """Rewrites the partitions of the projects in ``df`` and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project_id").parquet(path)


def audit_events(df: DataFrame, action: str, entity_type: str, entity: str, metadata: list[str], actor: str, at: str) -> DataFrame:
    """Rows of an audit log: who did what to which entity when, with a JSON of ``metadata`` columns."""
    return df.select(F.lit(actor).alias("actor"), F.lit(action).alias("action"), F.lit(entity_type).alias("entity_type"), F.col(entity).cast("string").alias("entity_id"), F.to_json(F.struct(*metadata)).alias("metadata"), F.lit(at).cast("timestamp").alias("timestamp"))


def append_audit(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def strict_json(text: str, keys: set[str]) -> dict:
    """One JSON object with exactly ``keys``, none of them twice."""

    def unique(pairs):
        out = dict(pairs)
        if len(out) != len(pairs):
            raise ValueError("a key occurs twice")
        return out

    got = json.loads(text, object_pairs_hook=unique)
    if not isinstance(got, dict) or set(got) != keys:
        raise ValueError(f"expected an object with {sorted(keys)}")
    return got
