"""Incremental indexing: new document files are indexed as they arrive, and made an index at any time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators import index as X
from ..operators import ingest as I
from ..storage import path_exists, scratch


def _table(spark: SparkSession, index: str, name: str, before: int | None = None) -> DataFrame | None:
    """A streamed table, of the batches before a number if one is given; None if there is none yet."""
    if not path_exists(spark, f"{index}/{name}"):
        return None
    rows = spark.read.parquet(f"{index}/{name}")
    return rows if before is None else rows.filter(F.col("batch_id") < before)


def append_documents(spark: SparkSession, source: str, schema: T.StructType, index: str, checkpoint: str, segmenter=None) -> StreamingQuery:
    """Start a stream over Parquet files of documents. Documents of earlier batches are left out of a batch.

    Each batch overwrites folders of its own (batch_id=N), so a batch that is tried again, even after a
    crash between its tables, leaves the same rows once.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        docs = batch.dropDuplicates(["doc_id"])
        seen = _table(spark, index, "stream_documents", batch_id)
        if seen is not None:
            docs = docs.join(seen.select("doc_id"), "doc_id", "left_anti")
        docs = scratch(I.with_keys(docs), "stream-docs")
        tokens = scratch(I.streams(docs, segmenter), "stream-tokens")
        made = {"stream_postings": X.postings(tokens), "stream_tokens": tokens, "stream_documents": docs}
        for name, rows in made.items():
            rows.write.mode("overwrite").parquet(f"{index}/{name}/batch_id={batch_id}")

    return spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def to_index(spark: SparkSession, index: str, path: str, segmenter=None) -> X.Index:
    """The streamed batches as a saved index, statistics and norms over all of them."""
    docs, post, tokens = (_table(spark, index, f"stream_{x}").drop("batch_id") for x in ("documents", "postings", "tokens"))
    X.store(docs, tokens, post, path, "custom" if segmenter else "basic", segmenter)
    return X.load(spark, path, segmenter)
