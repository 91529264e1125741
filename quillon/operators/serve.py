"""Search service: validated requests, pages, facets and snippets."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.snippets import PRIORITY, snippet_column
from . import index as X
from . import rank as R

RANKERS = ("bm25f", "tfidf")
MAX_PAGE_SIZE = 50
API_VERSION = "1.0"


class ServiceError(Exception):
    """A request that cannot be answered, with the code a client sees."""

    def __init__(self, code: str, message: str, status: int = 400, details: dict | None = None):
        super().__init__(message)
        self.code, self.message, self.status, self.details = code, message, status, details

    def to_dict(self) -> dict:
        body = {"code": self.code, "message": self.message}
        return {"error": body | ({"details": self.details} if self.details else {})}


def integer(name: str, value: object, default: int, least: int, most: int | None = None) -> int:
    if value in (None, ""):
        return default
    try:
        n = int(str(value))
    except ValueError:
        raise ServiceError("invalid_parameter", f"{name} must be an integer", details={"parameter": name}) from None
    if n < least or most is not None and n > most:
        raise ServiceError("invalid_parameter", f"{name} is out of range", details={"parameter": name})
    return n


def page(found: DataFrame, number: int, size: int) -> tuple[DataFrame, dict]:
    """One page of a query's unranked results, and where it lies; a page past the end is empty."""
    total = found.count()
    start = (number - 1) * size
    return R.top(found, size, start), {"page": number, "page_size": size, "total_results": total, "total_pages": -(-total // size), "has_previous": number > 1, "has_next": start + size < total}


#: Facets and the document columns that they count.
FACETS = {"categories": "categories", "difficulties": "difficulty", "cooking_methods": "cooking_method"}


def facets(documents: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, facet, value, count) over all rows: categories one by one, difficulties and methods where present."""
    by = by or []
    none = F.array().cast("array<string>")
    values = {name: F.coalesce("categories", none) if c == "categories" else F.when(F.coalesce(F.col(c), F.lit("")) != "", F.array(c)).otherwise(none) for name, c in FACETS.items()}

    def labelled(name: str) -> Column:
        return F.transform(values[name], lambda v: F.struct(F.lit(name).alias("facet"), v.alias("value")))

    every = [labelled(name) for name in FACETS]
    return documents.select(*by, F.inline(F.concat(*every))).groupBy(*by, "facet", "value").agg(F.count("*").alias("count"))


def facet_order() -> list:
    return [F.col("facet"), F.desc("count"), F.lower("value"), F.col("value")]


def serialized(rows: DataFrame, documents: DataFrame, expanded: list[str]) -> DataFrame:
    """The rows of one page as a client sees them: document columns, rounded scores, snippet, explanation."""
    more = F.array(*[F.lit(x) for x in expanded]).cast("array<string>")
    hits = rows.drop("title").join(documents, "doc_id").withColumn("snippet", snippet_column(F.struct(*PRIORITY), F.col("matched_fields"), F.concat("matched_terms", more)))
    explained = F.struct("matched_terms", more.alias("expanded_terms"), "matched_fields", F.transform_values("field_scores", lambda _, v: F.round(v, 6)).alias("field_scores"))
    return hits.select(
        "rank", "doc_id", F.round("score", 6).alias("score"), "title", "url", "source", "image_url", "categories", "difficulty", "cook_time_minutes", "total_time_minutes", "servings", "snippet", explained.alias("explanation"),
    ).orderBy("rank")


class Engine:
    """Answers requests over one index. A small index stays cached for the session."""

    #: Documents up to which the index's tables are cached.
    CACHED_DOCS = 100_000

    def __init__(self, index: X.Index, params: S.Bm25f = S.Bm25f()):
        self.index, self.params = index, params
        if index.n <= self.CACHED_DOCS:
            for t in (index.documents, index.postings, index.forward, index.term_stats):
                t.persist()

    def health(self) -> dict:
        return {"status": "ok", "api_version": API_VERSION, "rankers": sorted(RANKERS), "index": X.statistics(self.index).first().asDict()}

    def search(self, q: str | None, ranker: str | None = "bm25f", page_number: object = 1, page_size: object = 10, **filters: object) -> dict:
        """One page with facets over all results. Checks run in order: q, ranker, page, page_size, filters."""
        q = " ".join((q or "").split())
        if not q:
            raise ServiceError("missing_query", "q must not be empty", details={"parameter": "q"})
        ranker = (ranker or "bm25f").casefold()
        if ranker not in RANKERS:
            raise ServiceError("invalid_ranker", f"unknown ranker {ranker!r}", details={"parameter": "ranker"})
        number = integer("page", page_number, 1, 1)
        size = integer("page_size", page_size, 10, 1, MAX_PAGE_SIZE)
        limit = filters.get("max_time_minutes")
        limit = None if limit in (None, "") else integer("max_time", limit, 0, 0)
        try:
            chosen = S.Filters(limit, filters.get("difficulty") or None, *(tuple(filters.get(k) or ()) for k in ("categories", "ingredients", "cooking_methods")))
        except (TypeError, ValueError) as e:
            raise ServiceError("invalid_filter", str(e)) from e
        began = time.perf_counter()
        processed, found = R.found_by_one(self.index, q, ranker, chosen, self.params)
        asked = processed.select("normalized", "expanded_terms").first()
        found = found.persist()
        try:
            rows, where = page(found, number, size)
            docs = self.index.documents
            shown = [r.asDict(True) for r in serialized(rows, docs, asked.expanded_terms).collect()]
            counts = facets(found.select("doc_id").join(docs.select("doc_id", *FACETS.values()), "doc_id")).orderBy(*facet_order())
            groups: dict[str, list] = {name: [] for name in FACETS}
            for r in counts.toLocalIterator():
                groups[r.facet].append({"value": r.value, "count": r["count"]})
        finally:
            found.unpersist()
        said = {"text": q, "normalized": asked.normalized, "ranker": ranker, "expanded_terms": asked.expanded_terms, "filters": chosen.to_dict()}
        return {"query": said, "pagination": where, "facets": groups, "results": shown, "took_ms": round(1000 * (time.perf_counter() - began), 3)}
