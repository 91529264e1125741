"""JSONL, JSON and CSV sources and sinks."""

from __future__ import annotations

import csv
import io
import json
import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import path_exists

QUERIES = T.StructType([
    T.StructField("query_id", T.StringType()), T.StructField("text", T.StringType()), T.StructField("intent", T.StringType()),
    T.StructField("filters", T.StructType([
        T.StructField("max_time_minutes", T.IntegerType()), T.StructField("difficulty", T.StringType()),
        *[T.StructField(n, T.ArrayType(T.StringType())) for n in ("categories", "ingredients", "cooking_methods")],
    ])),
])
QRELS = T.StructType([T.StructField("query_id", T.StringType()), T.StructField("doc_id", T.StringType()), T.StructField("relevance", T.IntegerType())])


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, ord): lines in file order; gzip by suffix. ord rises with the file's blocks and the lines in them."""
    return spark.read.text(path).withColumn("ord", F.monotonically_increasing_id())


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Strict JSON lines, blank ones skipped: a broken line is an error that names its file and line."""
    full = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    parsed = F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    lines = spark.read.text(path).filter("trim(value) <> ''").select(parsed.alias("r"))
    broken = F.col("r").isNull() | F.col("r._bad").isNotNull()
    if lines.filter(broken).limit(1).count():
        file, line = _first_broken(spark, path, parsed)
        raise ValueError(f"{file}:{line}: broken JSON line")
    return lines.select("r.*").drop("_bad")


def _first_broken(spark: SparkSession, path: str, parsed) -> tuple[str, int]:
    """File and line number of a broken line; only for the error, so one task may number the lines of a file."""
    numbered = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    order = Window.partitionBy("file").orderBy("block", "id")
    rows = numbered.withColumn("line", F.row_number().over(order)).filter("trim(value) <> ''").withColumn("r", parsed)
    got = rows.filter(F.col("r").isNull() | F.col("r._bad").isNotNull()).orderBy("file", "line").first()
    return got.file, got.line


def require_unique(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    twice = df.groupBy(*columns).count().filter("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"duplicate {label}: {', '.join(str(twice[0][c]) for c in columns)}")
    return df


def load_queries(spark: SparkSession, path: str) -> DataFrame:
    q = read_jsonl(spark, path, QUERIES)
    if q.filter("coalesce(trim(query_id), '') = '' or coalesce(trim(text), '') = ''").limit(1).count():
        raise ValueError("query_id and text must not be blank")
    return require_unique(q, ["query_id"], "query_id")


def load_judgments(spark: SparkSession, path: str) -> DataFrame:
    """Judgments; a missing file has none."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], QRELS)
    j = read_jsonl(spark, path, QRELS)
    if j.filter("relevance is null or relevance not in (0, 1, 2) or coalesce(trim(query_id), '') = '' or coalesce(trim(doc_id), '') = ''").limit(1).count():
        raise ValueError("judgments need ids and a relevance of 0, 1 or 2")
    return require_unique(j, ["query_id", "doc_id"], "judgment")


def save_judgments(j: DataFrame, path: str) -> None:
    j.select("query_id", "doc_id", "relevance").orderBy("query_id", "doc_id").coalesce(1).write.mode("overwrite").json(path)


def write_judgments(rows: list[tuple[str, str, int]], path: str) -> None:
    """Judgments that a person makes, one file, sorted and replaced whole."""
    lines = [json.dumps({"query_id": q, "doc_id": d, "relevance": r}, ensure_ascii=False, sort_keys=True) for q, d, r in sorted(rows)]
    _replace(path, "".join(f"{x}\n" for x in lines).encode())


def write_jsonl(df: DataFrame, path: str, compression: str = "none") -> None:
    df.write.mode("overwrite").option("compression", compression).json(path)


def _replace(path: str, data: bytes) -> None:
    """Write beside the target, then rename, so that readers never see half a report."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    fd, name = tempfile.mkstemp(dir=target.parent)
    with os.fdopen(fd, "wb") as f:
        f.write(data)
    os.replace(name, target)


def write_json_report(report: dict, path: str) -> None:
    """A driver-side report: indented, sorted keys."""
    _replace(path, (json.dumps(report, ensure_ascii=False, indent=2, sort_keys=True) + "\n").encode())


def write_csv_report(rows: list[dict], columns: list[str], path: str) -> None:
    """A driver-side report with a UTF-8 byte order mark, for spreadsheets."""
    out = io.StringIO(newline="")
    w = csv.DictWriter(out, columns, extrasaction="ignore")
    w.writeheader()
    w.writerows(rows)
    _replace(path, out.getvalue().encode("utf-8-sig"))
