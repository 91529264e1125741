"""Validation, first-wins dedup, cleaning and field processing of documents."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..functions import scalars as H
from ..functions import text as X
from ..storage import scratch, short_batches, small

#: Ingredient lines that are page furniture, and openings of promotional descriptions, accent-folded (fixed values).
ARTIFACTS = ("gram", "muong")
PROMOTIONS = ("goi y com nha", "goi y bua an", "goi y thuc don")


def parse_lines(lines: DataFrame) -> DataFrame:
    """Records of JSON lines (value, ord): adds doc and valid. Blank lines are gone.

    Invalid: broken JSON, an unknown key, a required key that is absent, null or blank, a negative time.
    """
    known = F.array(*[F.lit(f.name) for f in S.RECIPE.fields], *[F.lit(x) for x in S.DERIVED])
    keys = F.json_object_keys(F.when(F.try_parse_json("value").isNotNull(), F.col("value")))
    rows = lines.filter(X.normalize_whitespace(F.col("value")) != "").withColumn("_keys", keys).withColumn("doc", F.from_json("value", S.RECIPE, {"mode": "PERMISSIVE"}))
    trimmed = F.struct(*[(X.normalize_whitespace(F.col(f"doc.{f.name}")) if f.name in ("doc_id",) else F.btrim(F.col(f"doc.{f.name}")) if f.name in S.REQUIRED else _default(f)).alias(f.name) for f in S.RECIPE.fields])
    valid = F.col("_keys").isNotNull() & (F.size(F.array_except("_keys", known)) == 0)
    for name in S.REQUIRED:
        valid = valid & (F.coalesce(F.btrim(F.col(f"doc.{name}")), F.lit("")) != "")
    for name in ("prep_time_minutes", "cook_time_minutes"):
        valid = valid & (F.coalesce(F.col(f"doc.{name}"), F.lit(0)) >= 0)
    return rows.select("ord", trimmed.alias("doc"), F.coalesce(valid, F.lit(False)).alias("valid"))


def _default(f: T.StructField) -> Column:
    c = F.col(f"doc.{f.name}")
    if isinstance(f.dataType, T.ArrayType):
        return F.coalesce(c, F.array().cast("array<string>"))
    return F.coalesce(c, F.lit("")) if f.name == "description" else c


def first_wins(rows: DataFrame, keys: list[Column], order: str = "ord") -> DataFrame:
    """Rows kept when a row falls to any earlier kept row that shares a non-empty key with it.

    A dropped row does not block others. Rows that share no key are kept at once; only the others, as
    (row, key) pairs, go through rounds. A round keeps the rows that come first in all their keys'
    groups and drops what shares a key with them; rounds end when no pair is left.
    """
    named = F.array(*[F.struct(F.lit(i).alias("i"), F.nullif(k.cast("string"), F.lit("")).alias("v")) for i, k in enumerate(keys)])
    pairs = rows.select(F.col(order).alias("ord"), F.explode(named).alias("k")).filter("k.v is not null").select("ord", F.xxhash64("k.i", "k.v").alias("h"), "k")
    firsts = pairs.groupBy("h", "k").agg(F.min("ord").alias("first"), F.count("*").alias("n"))
    shared = scratch(firsts.filter("n > 1").select("h", "k"), "dedup-shared")
    n = shared.count()
    if not n:
        return rows
    contested = pairs.join(small(shared, n), ["h", "k"], "left_semi").select("ord").distinct()
    # all keys of a contested row take part: it must be first in each
    open_ = scratch(pairs.join(contested, "ord", "left_semi").select("ord", F.struct("h", "k").alias("k")), "dedup-open")
    lost = None
    while True:
        groups = open_.groupBy("k").agg(F.min("ord").alias("first"))
        leads = groups.groupBy(F.col("first").alias("ord")).agg(F.count("*").alias("led"))
        degree = open_.groupBy("ord").agg(F.count("*").alias("keys"))
        won = scratch(leads.join(degree, "ord").filter("led = keys").select("ord"), "dedup-won")
        taken = scratch(open_.join(won, "ord", "left_semi").select("k"), "dedup-taken")
        beaten = open_.join(small(taken, taken.count()), "k", "left_semi").select("ord").distinct().join(won, "ord", "left_anti")
        beaten = scratch(beaten, "dedup-lost")
        lost = beaten if lost is None else lost.unionByName(beaten)
        open_ = scratch(open_.join(won.unionByName(beaten), "ord", "left_anti"), "dedup-open")
        if not open_.limit(1).count():
            return rows.join(small(lost, lost.count()).withColumnRenamed("ord", order), order, "left_anti")


def sanitize(docs: DataFrame) -> DataFrame:
    """Drops furniture ingredients, clears promotional descriptions; adds removed_ingredients and cleared_description."""
    forms = F.transform(X.composed_items(F.col("ingredients")), lambda v: X.comparison_form(v, compose=False))
    keep = F.transform(F.filter(F.arrays_zip("ingredients", forms), lambda p: ~p["1"].isin(*ARTIFACTS)), lambda p: p["ingredients"])
    promo = F.coalesce(X.comparison_form(F.col("description")), F.lit("")).rlike(f"^({'|'.join(PROMOTIONS)})")
    out = docs.withColumns({"_kept": keep, "_promo": promo})
    return out.withColumns({"removed_ingredients": F.size("ingredients") - F.size("_kept"), "ingredients": F.col("_kept"), "cleared_description": F.col("_promo").cast("int"), "description": F.when(F.col("_promo"), "").otherwise(F.col("description"))}).drop("_kept", "_promo")


def ingest(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cleaned documents and the one-row report of a JSONL table (value, ord)."""
    parsed = scratch(parse_lines(lines), "ingest-parsed")
    good = parsed.filter("valid").select("ord", "doc.*")
    clean = scratch(sanitize(first_wins(good, [F.col("doc_id"), F.col("content_hash")])), "ingest-clean")
    seen = parsed.agg(F.count("*").alias("input_count"), F.count_if(~F.col("valid")).alias("invalid_count"))
    made = clean.agg(
        F.count("*").alias("output_count"), F.count_if((F.col("removed_ingredients") > 0) | (F.col("cleared_description") > 0)).alias("cleaned_count"),
        F.coalesce(F.sum("removed_ingredients"), F.lit(0)).alias("removed_ingredient_artifacts"), F.coalesce(F.sum("cleared_description"), F.lit(0)).alias("cleared_promotional_descriptions"),
    )
    report = seen.withColumn("_one", F.lit(1)).join(made.withColumn("_one", F.lit(1)), "_one").drop("_one").withColumn("duplicate_count", F.col("input_count") - F.col("invalid_count") - F.col("output_count"))
    return clean.drop("removed_ingredients", "cleared_description"), report


def tokenized(docs: DataFrame, compose: bool = True, segmenter=None, texts: bool = False) -> DataFrame:
    """A row a document: doc_id and, for each field, its tokens; with texts, its normalised text as well."""
    kinds = dict(docs.dtypes)
    raw = {f: X.field_text(f, kinds[f]) for f in S.FIELDS}
    norm = docs.select("doc_id", *[X.normalize_text(r, compose=compose).alias(f"{f}_norm") for f, r in raw.items()])
    cut = {f: X.tokenize_with(segmenter, F.col(f"{f}_norm")) if segmenter else X.tokenize_normalized(F.col(f"{f}_norm")) for f in S.FIELDS}
    return norm.select("doc_id", *[c.alias(f) for f, c in cut.items()], *([f"{f}_norm" for f in S.FIELDS] if texts else []))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    normal = unicodedata.normalize
    for b in batches:
        made = []
        for f in S.FIELDS:
            low = pa.array([normal("NFC", x or "").lower() for x in b.column(b.schema.get_field_index(f)).to_pylist()], pa.string())
            made.append(pc.ascii_trim(pc.replace_substring_regex(low, r"[^\p{L}\p{N}]+", " "), " "))
        yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("doc_id")), *made], names=["doc_id", *S.FIELDS])


def streams(docs: DataFrame, segmenter=None) -> DataFrame:
    """As tokenized, with each field's tokens as one text that blanks part: the form in which an index keeps them. The whole
    text is composed, lower-cased and cut where Python holds it; white space needs no care, since no token holds any."""
    kinds = dict(docs.dtypes)
    if segmenter:
        return tokenized(docs, segmenter=segmenter).select("doc_id", *[F.array_join(f, " ").alias(f) for f in S.FIELDS])
    short_batches(docs.sparkSession)
    raw = docs.select("doc_id", *[X.field_text(f, kinds[f]).alias(f) for f in S.FIELDS])
    return raw.mapInArrow(_cut, ", ".join(f"{c} string" for c in ("doc_id", *S.FIELDS)))


def processed(docs: DataFrame, compose: bool = True, segmenter=None) -> DataFrame:
    """(doc_id, field, field_ord, text_norm, tokens, accentless_tokens, ranking_tokens), a row a field."""
    wide = tokenized(docs, compose, segmenter, texts=True)
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(i).alias("field_ord"), F.col(f"{f}_norm").alias("text_norm"), F.col(f).alias("tokens")) for i, f in enumerate(S.FIELDS)])
    rows = wide.select("doc_id", F.inline(each))
    return rows.withColumns({"accentless_tokens": F.transform("tokens", X.strip_accents), "ranking_tokens": X.ranking_terms(F.col("tokens"))})


def _fold_list(name: str) -> Column:
    return F.transform(X.composed_items(F.col(name)), lambda v: X.search_form(v, compose=False))


def with_keys(docs: DataFrame) -> DataFrame:
    """Adds total_time_minutes and the folded columns that filters read."""
    fold = lambda c: X.search_form(c)
    return docs.withColumns({
        "total_time_minutes": H.total_time(F.col("prep_time_minutes"), F.col("cook_time_minutes")),
        "difficulty_fold": fold(F.col("difficulty")), "method_fold": fold(F.col("cooking_method")),
        "categories_fold": _fold_list("categories"), "ingredients_fold": _fold_list("ingredients"),
    })
