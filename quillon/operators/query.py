"""Query processing, expansion and structured filters, for many queries at once."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import text as X

#: Concepts, accent-folded, and the terms they add (fixed values).
EXPANSIONS = {"hai san": ("cá", "tôm", "mực", "nghêu", "ốc")}
BOOST = 0.35


def process(queries: DataFrame, expansions: dict[str, tuple[str, ...]] | None = None, boost: float = BOOST, stopwords: list[str] = X.STOPWORDS, compose: bool = True, segmenter=None) -> DataFrame:
    """queries (query_id, text): adds normalized, channel, tokens, terms, expanded_terms, expansion_boost.

    Stopwords go unless nothing else is left. A query equal to its accent-less form searches the
    accentless channel. expansions=None adds nothing. segmenter: the one that the index was built with.
    """
    if not 0 < boost <= 1:
        raise ValueError("expansion boost must lie in (0, 1]")
    q = queries.withColumn("normalized", X.normalize_text(F.coalesce("text", F.lit("")), compose=compose))
    q = q.withColumn("tokens", X.tokenize_with(segmenter, F.col("normalized")) if segmenter else X.tokenize_normalized(F.col("normalized")))
    q = q.withColumn("_ranked", _without_stopwords(F.col("tokens"), stopwords))
    q = q.withColumn("channel", F.when(F.col("normalized") == X.strip_accents(F.col("normalized")), "accentless").otherwise("normalized"))
    fold = lambda a: F.when(F.col("channel") == "accentless", F.transform(a, X.strip_accents)).otherwise(a)
    q = q.withColumn("terms", fold(F.col("_ranked")))
    padded = F.concat(F.lit(" "), X.strip_accents(F.col("normalized")), F.lit(" "))
    none = F.array().cast("array<string>")
    # the map is part of the engine's configuration: a few concepts
    added = [F.when(F.contains(padded, F.lit(f" {concept} ")), F.flatten(F.array(*[_without_stopwords(_literal_tokens(w, segmenter), stopwords) for w in words]))).otherwise(none) for concept, words in (expansions or {}).items()]
    q = q.withColumn("_extra", F.concat(none, *added))
    q = q.withColumn("expanded_terms", F.array_except(F.array_distinct(fold(F.col("_extra"))), "terms"))
    return q.withColumn("expansion_boost", F.lit(boost)).drop("_ranked", "_extra")


def _without_stopwords(tokens: Column, stopwords: list[str]) -> Column:
    kept = X.ranking_terms(tokens, stopwords)
    return F.when(F.size(kept) > 0, kept).otherwise(tokens)


def _literal_tokens(word: str, segmenter) -> Column:
    if segmenter:
        return F.array(*[F.lit(w) for w in X.segmented(segmenter, " ".join(unicodedata.normalize("NFC", word).split()).lower())]).cast("array<string>")
    return X.tokenize(F.lit(unicodedata.normalize("NFC", word)), compose=False)


def query_terms(processed: DataFrame) -> DataFrame:
    """(query_id, channel, term, qtf, boost, places, n_terms) of distinct terms, originals and expansions.

    places: where the term stands among the original terms (none for an expansion); n_terms: their number.
    """
    n = F.size("terms").alias("n_terms")
    own = processed.select("query_id", "channel", n, F.posexplode("terms").alias("place", "term"), F.lit(1.0).alias("boost"))
    more = processed.select("query_id", "channel", n, F.explode("expanded_terms").alias("term"), F.col("expansion_boost").alias("boost")).withColumn("place", F.lit(None).cast("int"))
    return own.unionByName(more).groupBy("query_id", "channel", "term").agg(F.count("*").alias("qtf"), F.max("boost").alias("boost"), F.sort_array(F.collect_list("place")).alias("places"), F.max("n_terms").alias("n_terms"))


def _form(value: str) -> Column:
    return X.search_form(F.lit(unicodedata.normalize("NFC", value)), compose=False)


def _holds(values: Column, needle: Column) -> Column:
    return (needle != "") & F.exists(values, lambda c: F.contains(c, needle))


def _time() -> Column:
    """What time filters compare: the total, else the cooking time."""
    return F.coalesce("total_time_minutes", "cook_time_minutes")


def predicate(f: S.Filters) -> Column:
    """One predicate over documents with folded columns."""
    ok = F.lit(True)
    if f.max_time_minutes is not None:
        ok = ok & F.coalesce(_time() <= f.max_time_minutes, F.lit(False))
    if f.difficulty:
        ok = ok & (F.col("difficulty_fold") == _form(f.difficulty))
    for column, values in (("categories_fold", f.categories), ("ingredients_fold", f.ingredients)):
        for v in values:
            ok = ok & _holds(F.col(column), _form(v))
    if f.cooking_methods:
        # the document's method must lie within a filter value
        any_ = F.lit(False)
        for v in f.cooking_methods:
            any_ = any_ | F.contains(_form(v), F.col("method_fold"))
        ok = ok & (F.col("method_fold") != "") & any_
    return ok


def filter_documents(documents: DataFrame, f: S.Filters | None) -> DataFrame | None:
    """Ids of the documents that pass, or None if no filter is active."""
    return documents.filter(predicate(f)).select("doc_id") if f is not None and f.active else None


#: Document columns that filters read.
FILTER_COLUMNS = ("total_time_minutes", "cook_time_minutes", "difficulty_fold", "method_fold", "categories_fold", "ingredients_fold")


def query_filters(queries: DataFrame) -> DataFrame:
    """(query_id, f_time, f_difficulty, f_categories, f_ingredients, f_methods): each query's own filters, folded."""
    form = lambda a: F.transform(X.composed_items(a), lambda v: X.search_form(v, compose=False))
    return queries.select(
        "query_id", F.col("filters.max_time_minutes").alias("f_time"), F.when(F.coalesce(F.col("filters.difficulty"), F.lit("")) != "", X.search_form(F.col("filters.difficulty"))).alias("f_difficulty"),
        form(F.col("filters.categories")).alias("f_categories"), form(F.col("filters.ingredients")).alias("f_ingredients"), form(F.col("filters.cooking_methods")).alias("f_methods"),
    )


#: Columns of query_filters.
FILTERS = ("f_time", "f_difficulty", "f_categories", "f_ingredients", "f_methods")


def row_predicate(f: dict[str, Column] | None = None) -> Column:
    """Whether a document passes its query's filters: a row holds the document's FILTER_COLUMNS and, unless f gives them, query_filters."""
    f = f or {k: F.col(k) for k in FILTERS}
    all_in = lambda wanted, held: F.forall(wanted, lambda v: (v != "") & F.exists(held, lambda c: F.contains(c, v)))
    method = F.col("method_fold")
    return (
        (f["f_time"].isNull() | F.coalesce(_time() <= f["f_time"], F.lit(False)))
        & (f["f_difficulty"].isNull() | (F.col("difficulty_fold") == f["f_difficulty"]))
        & all_in(f["f_categories"], F.col("categories_fold"))
        & all_in(f["f_ingredients"], F.col("ingredients_fold"))
        & ((F.size(f["f_methods"]) == 0) | ((method != "") & F.exists(f["f_methods"], lambda v: F.contains(v, method))))
    )
