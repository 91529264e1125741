"""Corpus preparation: quality rules, near-dedup, secret redaction, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All stages but
the last return the columns of documents. An empty table passes through every stage.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import common, minhash, mixing, packing, quality, secrets

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects; a null or empty text has no words and goes, repeated rows share a verdict,
    long texts are measured whole."""
    return quality.judge(docs.select(*COLUMNS), COLUMNS, rejected=False).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest id; repeated rows of it go too, all but the
    smallest in the order of the columns. Rows with a null id, and texts without words, are linked with nothing and stay."""
    found = common.materialize(minhash.near_duplicates(docs).filter("not kept").select("doc_id").distinct(), "copies")
    rest = docs.select(*COLUMNS).join(common.small(found, found.count()), "doc_id", "left_anti").select(*COLUMNS)
    ids = rest.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    if not ids.limit(1).count():
        return rest
    ids = common.materialize(ids, "repeated")
    once = rest.join(ids, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*COLUMNS)).alias("d")).select("d.*")
    return rest.join(ids, "doc_id", "left_anti").select(*COLUMNS).unionByName(once)


def _redact(learned: bytes):
    @common.task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = common.column(b, "text").cast(pa.binary()).to_pylist()
            n, out = common.column(b, "n_chars").to_pylist(), []
            for i, x in enumerate(data):
                new = secrets.redact(x, learned=learned) if x else None
                if new is not None:
                    n[i] = len(new)
                out.append(x if new is None else new.encode())
            text = pa.array(out, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([text if k == "text" else pa.array(n, pa.int64()) if k == "n_chars" else common.column(b, k) for k in COLUMNS], COLUMNS)

    return run


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of the secret scan becomes a mark; n_chars follows the changed texts. A null text stays null, long texts
    are scanned whole, overlapping spans become one mark, and repeated rows change alike."""
    common.tune(spark)
    return docs.select(*COLUMNS).mapInArrow(_redact(secrets.learn(docs)), "doc_id long, text string, lang string, source string, n_chars long")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, or one to three times. A null source is a source of its own;
    a text without words is taken not at all; rows equal in id and text are taken alike."""
    mixed = mixing.mix(docs, keep=COLUMNS).filter("copies > 0")
    return mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row a piece of a document, with its sequence and place. A null text is the separator alone, repeated rows are
    documents of their own, and only texts longer than a sequence are cut."""
    return packing.pack(docs.select("doc_id", "text"))


STAGES = [
    ("quality_rules", keep_quality),
    ("minhash_near_dedup", drop_near_copies),
    ("secret_scan", redact_secrets),
    ("mix_sources", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: Tokenising and the mix's iterations have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = common.documents(spark, sf_dir)
    at = f"{common.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{at}/{k}-{name}")
            docs = spark.read.parquet(f"{at}/{k}-{name}")
    return docs
