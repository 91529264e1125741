"""Helpers shared by the training-data operators: scratch tables, Arrow limits, word rules."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import scratch, shared_dir, small  # noqa: F401  (for the operators)

#: Rows of one Arrow batch: texts of 100 KB make 25 MB, so a Python worker stays small.
ARROW_ROWS = 256


def tune(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python workers hold."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage, survives lost executors."""
    return scratch(df, name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 bytes of a text column; null becomes empty."""
    return [x or b"" for x in batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()]


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def free() -> None:
    """Give freed memory back to the system: Python workers are reused by later stages, beside which it would still count."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def task(fn: Callable) -> Callable:
    """A mapInArrow function that frees its memory when its task ends."""

    @functools.wraps(fn)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            free()

    return run


def per_text(fn: Callable[[bytes], tuple], fields: list[tuple[str, pa.DataType]], keep: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function: keeps some columns and adds what fn gives for each text."""

    @task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [fn(x) for x in texts(b)]
            arrays = [column(b, k) for k in keep]
            arrays += [pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(fields)]
            yield pa.RecordBatch.from_arrays(arrays, keep + [n for n, _ in fields])

    return run


def held_out(doc_id: Column, remainder: int) -> Column:
    """crc32 of the id as text, modulo 5, equals remainder; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(5)) == remainder
