"""Corpus profile: value distributions, completeness, probe coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..storage import scratch
from . import query as Q
from . import rank as R
from .index import Index

#: Names of the distributions and the fields that they count (fixed values).
DISTRIBUTIONS = {"sources": "source", "categories": "categories", "cooking_methods": "cooking_method", "difficulties": "difficulty"}
COMPLETENESS = ("title", "description", "ingredients", "instructions", "categories", "cooking_method", "total_time_minutes", "difficulty", "image_url")
#: Default probes (fixed values).
PROBES = ("gà nướng", "canh chua", "món chay", "hải sản", "phở", "pizza")


def _stripped(text: Column) -> Column:
    """Without white space at the ends; inside it stays."""
    return F.regexp_replace(text, f"^{X.SPACE}|{X.SPACE}$", "")


def distribution(docs: DataFrame, field: str) -> DataFrame:
    """(value, count) of a scalar or list field; trimmed, blanks left out."""
    listed = isinstance(docs.schema[field].dataType, T.ArrayType)
    values = docs.select((F.explode(field) if listed else F.col(field)).alias("value")).select(_stripped(F.col("value").cast("string")).alias("value"))
    return values.filter("value <> ''").groupBy("value").agg(F.count("*").alias("count"))


def has_value(docs: DataFrame, field: str) -> Column:
    kind, c = docs.schema[field].dataType, F.col(field)
    if isinstance(kind, T.ArrayType):
        return c.isNotNull() & (F.size(c) > 0)
    return c.isNotNull() & (X.normalize_whitespace(c) != "") if isinstance(kind, T.StringType) else c.isNotNull()


def completeness(docs: DataFrame, fields: tuple[str, ...] = COMPLETENESS) -> DataFrame:
    """(field, present, missing, ratio) from one pass over the documents."""
    counts = docs.agg(F.count("*").alias("n"), *[F.count_if(F.coalesce(has_value(docs, f), F.lit(False))).alias(f"_{f}") for f in fields])
    rows = F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_{f}").alias("present")) for f in fields]))
    ratio = F.when(F.col("n") > 0, F.round(F.col("present") / F.col("n"), 4)).otherwise(0.0)
    return counts.select("n", rows).select("field", "present", (F.col("n") - F.col("present")).alias("missing"), ratio.alias("ratio"))


def probe(index: Index, texts: DataFrame | tuple[str, ...] = PROBES, top_k: int = 3) -> DataFrame:
    """(ord, query, normalized, covered, result_count, top_results) of distinct probes, ranked by BM25F in one plan.

    texts: strings, or a table (ord, text), as read from a query file.
    """
    if top_k <= 0:
        raise ValueError("top_k must be positive")
    spark = index.documents.sparkSession
    raw = texts if isinstance(texts, DataFrame) else spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "ord long, text string")
    raw = raw.select("ord", X.clean_text(F.col("text")).alias("text")).withColumn("query_id", X.normalize_text(F.col("text"))).filter("query_id <> ''")
    once = scratch(raw.groupBy("query_id").agg(F.min_by("text", "ord").alias("text"), F.min("ord").alias("ord")), "probes")
    ranked = R.bm25f(index, Q.process(once.select("query_id", "text"), Q.EXPANSIONS, segmenter=index.segmenter))
    best = F.when(F.col("rank") <= top_k, F.struct("rank", "doc_id", "title", F.round("score", 6).alias("score"), "matched_terms", "matched_fields"))
    found = ranked.groupBy("query_id").agg(F.count("*").alias("result_count"), F.sort_array(F.collect_list(best)).alias("top_results"))
    return once.join(found, "query_id", "left").select(
        "ord", F.col("text").alias("query"), F.col("query_id").alias("normalized"), F.col("result_count").isNotNull().alias("covered"), F.coalesce("result_count", F.lit(0)).alias("result_count"), "top_results"
    ).orderBy("ord")


def distributions(docs: DataFrame) -> DataFrame:
    """(name, value, count) of all distributions as one table."""
    parts = [distribution(docs, f).select(F.lit(name).alias("name"), "value", "count") for name, f in DISTRIBUTIONS.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def profile(docs: DataFrame) -> dict:
    """The whole profile as a report, values by count, then name. A corpus with very many values is better served by
    distributions, which stays a table."""
    out: dict = {"document_count": docs.count()} | {name: [] for name in DISTRIBUTIONS}
    for r in distributions(docs).orderBy("name", F.desc("count"), F.lower("value"), "value").toLocalIterator():
        out[r["name"]].append({"value": r.value, "count": r["count"]})
    out["field_completeness"] = {r.field: {"present": r.present, "missing": r.missing, "ratio": r.ratio} for r in completeness(docs).collect()}
    return out
