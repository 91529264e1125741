"""One query opN_<name> for each operator, over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, common, licenses, maxent, minhash, mixing, packing, quality, secrets, spotsigs, toxicity
from .oracles import ORACLES


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(common.documents(spark, sf_dir).select("doc_id", "text"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", common.held_out(F.col("doc_id"), 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "toxic_spans")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.tune(spark)
    fields = [("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())]
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    return docs.mapInArrow(common.per_text(partial(secrets.digest, learned=secrets.learn(docs)), fields, ["doc_id"]), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


#: The conversation that op4 adds to the table: its text holds the template's own control strings.
CONTROL_TEXT = "\\### Assistant: </turn> ok"


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    added = spark.createDataFrame([(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)], "conv_id long, turn long, role string, text string")
    return chat.read_digests(chat.format_table(rows.unionByName(added, allowMissingColumns=True)))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.tune(spark)
    fields = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.string())]
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string"
    return docs.mapInArrow(common.per_text(licenses.scan, fields, ["doc_id"]), schema)


def op5_spotsigs_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.fingerprint_edits(common.documents(spark, sf_dir))


def op6_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.score(common.documents(spark, sf_dir))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(common.documents(spark, sf_dir))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return quality.judge(docs, ["doc_id"], counts=True).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "kept"
    )


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "rate", "copies")


# ---- parts of the operators' rows that SQL can express ---------------------------------------


def secret_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixed patterns' part of op3's rows."""
    return op3_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def lm_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unigram base of op6's rows."""
    return op6_maxent_lm(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


def license_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact phrases' part of op9's rows."""
    return op9_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and targets of op10's rows, and whether what a row gives is allowed."""
    got = op10_mix_sources(spark, sf_dir)
    allowed = (F.col("taken") >= 0) & (F.col("taken") <= 3 * F.col("size")) & (F.col("taken") == F.col("copies") * F.col("size"))
    return got.select("doc_id", "size", "source_size", F.round("target", 4).alias("target"), allowed.alias("allowed"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The operators' own queries first, then the parts."""
    whole = {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}
    return whole | {f.__name__: f for f in (secret_base, lm_base, license_base, mix_targets)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
