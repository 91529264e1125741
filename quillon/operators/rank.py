"""TF-IDF and BM25F ranking of many queries in one plan.

Statistics (n, df, average lengths, norms) always cover the whole index; filters restrict only
which documents are scored. A few terms are looked up in the postings; a batch of queries is scored
document by document from the forward rows (see scan), without any exchange.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import scalars as H
from ..storage import scratch, short_batches, small
from . import query as Q
from . import scan
from .index import Index, idf_bm25, idf_tfidf, wide
from .scan import BITS

#: Up to so many terms of queries are looked up in the postings, whose pages without them are left out.
PUSHED_TERMS = 50
#: Up to so many are sent to every task, to score batches document by document.
SCANNED_TERMS = 2_000_000


class Asked:
    """The terms of a batch of queries: (query_id, channel, term, qtf, boost, places, n_terms, df, word, bit) and what their number allows."""

    def __init__(self, index: Index, processed: DataFrame):
        terms = Q.query_terms(processed)
        slots = Window.partitionBy("query_id").orderBy("term")
        at = F.row_number().over(slots) - 1
        self.terms = scratch(terms.withColumns({"word": F.floor(at / BITS).cast("int"), "bit": F.call_function("shiftleft", F.lit(1).cast("long"), (at % BITS).cast("int"))}), "query-terms")
        seen = self.terms.agg(F.count("*").alias("n"), F.max("word").alias("words")).first()
        self.n, self.words = seen.n, (seen.words or 0) + 1
        few = self.n <= PUSHED_TERMS
        self.pushed = [r.term for r in self.terms.select("term").distinct().collect()] if few else None
        self.stats = index.term_stats.select("channel", "term", "df").join(small(self.terms, self.n), ["channel", "term"])
        self.scanned = not few and self.n <= SCANNED_TERMS

    def plan(self, n: int, model: str, own: DataFrame | None = None) -> scan.Plan:
        """The queries as every task gets them. own: (query_id, passes), the number of each query's filters."""
        rows = [r.asDict() for r in self.stats.collect()]
        idf = (lambda df: math.log(1 + (n - df + 0.5) / (df + 0.5))) if model == "bm25f" else (lambda df: math.log((n + 1) / (df + 1)) + 1)
        norms: dict[str, float] = {}
        for r in rows:
            r["slot"] = r["word"] * BITS + r["bit"].bit_length() - 1
            r["weight"] = (1 + math.log(r["qtf"])) * r["boost"] * (1 if model == "bm25f" else idf(r["df"]))
            norms[r["query_id"]] = norms.get(r["query_id"], 0.0) + r["weight"] ** 2
        if model == "tfidf":
            for r in rows:
                r["weight"] /= math.sqrt(norms[r["query_id"]])
        every = {r.query_id: r.n for r in self.terms.groupBy("query_id").agg(F.max("n_terms").alias("n")).collect()}
        return scan.plan(rows, every, idf, None if own is None else {r.query_id: r["passes"] for r in own.collect()})

    def hits(self, post: DataFrame, allowed: DataFrame | None, terms: DataFrame | None = None) -> DataFrame:
        """Rows of index.WIDE of the queries' terms, a row a query, term and document."""
        if self.pushed is not None:
            post = post.filter(F.col("term").isin(self.pushed))
        post = post.join(small(self.terms.select("channel", "term").distinct(), self.n), ["channel", "term"], "left_semi")
        found = wide(post).join(small(terms or self.stats, self.n), ["channel", "term"])
        return found if allowed is None else found.join(allowed, "doc_id", "left_semi")

    def marks(self) -> dict[str, Column]:
        """Aggregates that note which terms a document holds."""
        return {f"_w{k}": F.bit_or(F.when(F.col("word") == k, F.col("bit")).otherwise(F.lit(0).cast("long"))) for k in range(self.words)}

    def lists(self) -> DataFrame:
        """(query_id, _terms, _n_terms): each query's distinct terms in order of their bits."""
        return small(self.terms.groupBy("query_id").agg(F.sort_array(F.collect_list("term")).alias("_terms"), F.max("n_terms").alias("_n_terms")), self.n)

    def held(self) -> Column:
        """The marked terms, sorted."""
        words = F.array(*[f"_w{k}" for k in range(self.words)])
        return F.filter("_terms", lambda t, i: F.getbit(F.get(words, F.floor(i / BITS).cast("int")), i % BITS) == 1)


def phrase_count(lists: Column) -> Column:
    """Starts of the first list from which every next list continues."""
    n = F.size(lists)
    return F.size(F.filter(F.get(lists, F.lit(0)), lambda p: F.forall(F.sequence(F.lit(1), n - 1), lambda i: F.array_contains(F.get(lists, i), p + i))))


def minimum_gap(lists: Column) -> Column:
    """Smallest window that holds a position of every list, less the tightest possible one; never below 0."""
    spans = F.transform(F.array_distinct(F.flatten(lists)), lambda p: p - F.array_min(F.transform(lists, lambda t: F.coalesce(F.array_max(F.filter(t, lambda q: q <= p)), F.lit(-1_000_000_000)))))
    return F.greatest(F.lit(0), F.array_min(spans) - (F.size(lists) - 1))


def _parts(index: Index, params: S.Bm25f) -> dict[str, Column]:
    """Each field's weighted, length-normalised frequency of the row's term; null where the field lacks it."""
    avg, out = index.averages(), {}
    for f in S.FIELDS:
        b, w = params.b.get(f, 0.75), params.weights.get(f, 1.0)
        rel = F.col(f"{f}_len") / F.lit(avg[f]) if avg[f] > 0 else F.lit(1.0)
        out[f] = w * F.col(f"{f}_tf") / F.greatest(1 - b + b * rel, F.lit(1e-9))
    return out


def _evidence(asked: Asked, index: Index, pairs: DataFrame, n: int) -> DataFrame:
    """(query_id, doc_id, <field>_exact, <field>_gap) of pairs whose document has a field with all of the query's terms."""
    places = asked.terms.filter(F.size("places") > 0).select("query_id", "channel", "term", "places")
    rows = asked.hits(index.postings, None, places).join(small(pairs, n), ["query_id", "doc_id"])
    placed = F.inline(F.transform("places", lambda p: F.struct(p.alias("place"))))
    got = rows.select("query_id", "doc_id", "_n_terms", *[f"{f}_pos" for f in S.FIELDS], placed).groupBy("query_id", "doc_id", "_n_terms").agg(F.array_sort(F.collect_list(F.struct("place", *[F.col(f"{f}_pos").alias(f) for f in S.FIELDS]))).alias("_rows"))
    for f in S.FIELDS:
        lists = F.filter(F.col(f"_rows.{f}"), lambda x: x.isNotNull())
        got = got.withColumn(f"_l_{f}", F.when(F.size(lists) == F.col("_n_terms"), lists))
    return got.select("query_id", "doc_id", *[x.alias(f"{f}_{name}") for f in S.FIELDS for name, x in (("exact", phrase_count(F.col(f"_l_{f}"))), ("gap", minimum_gap(F.col(f"_l_{f}"))))])


def _forward(index: Index, filters: S.Filters | None = None, own: DataFrame | None = None) -> DataFrame:
    """Forward rows of the documents that pass; with own (query_id, passes, f), passes numbers the filters that each passes."""
    rows = index.forward.filter(Q.predicate(filters)) if filters is not None and filters.active else index.forward
    if own is not None:
        kinds = own.select("passes", "f").distinct().agg(F.collect_list(F.struct("passes", "f.*")).alias("_filters"))
        passed = F.filter("_filters", lambda f: Q.row_predicate({k: f[k] for k in Q.FILTERS}))
        rows = rows.crossJoin(F.broadcast(kinds)).withColumn("passes", F.transform(passed, lambda f: f["passes"])).drop("_filters").filter(F.size("passes") > 0)
    short_batches(rows.sparkSession)
    return rows


def _numbered(filters_by_query: DataFrame | None) -> DataFrame | None:
    """(query_id, passes, f): equal filters under one number."""
    if filters_by_query is None:
        return None
    held = filters_by_query.select("query_id", F.struct(*Q.FILTERS).alias("f"))
    return scratch(held.withColumn("passes", (F.dense_rank().over(Window.orderBy("f")) - 1).cast("int")), "query-filters")  # a row a query


def _scanned(index: Index, asked: Asked, model: str, params: S.Bm25f | None = None, weights: dict[str, float] | None = None, filters: S.Filters | None = None, filters_by_query: DataFrame | None = None, marks: bool = True) -> DataFrame:
    """(query_id, doc_id, ord, <field>, _w0, ...) of a batch of queries, scored where the documents lie."""
    own, handed = _numbered(filters_by_query), ("doc_id", "ord")
    plan = asked.plan(index.n, model, own)
    run = scan.bm25f(plan, params, index.averages(), handed, marks) if model == "bm25f" else scan.tfidf(plan, weights, handed, marks)
    schema = ["query_id string", "doc_id string", "ord long", *[f"{f} double" for f in S.FIELDS], *([f"_w{k} long" for k in range(asked.words)] if marks else [])]
    rows = _forward(index, filters, own)
    keep = ["doc_id", "ord", *[f"norm_{c}" for c in S.CHANNELS], *S.FIELDS, *(["passes"] if own is not None else [])]
    return rows.select(*keep).mapInArrow(run, ", ".join(schema))


def _terms_named(rows: DataFrame, asked: Asked) -> DataFrame:
    """Scanned rows with their matched terms."""
    return rows.join(asked.lists(), "query_id").withColumn("terms", asked.held())


def found(index: Index, processed: DataFrame) -> DataFrame:
    """(query_id, doc_id, doc_categories, doc_difficulty, doc_cooking_method) of all documents that match, without scores."""
    asked = Asked(index, processed)
    columns = {"doc_id": "string", "doc_categories": "array<string>", "doc_difficulty": "string", "doc_cooking_method": "string"}
    if asked.scanned:
        rows = _forward(index).select(*columns, *S.FIELDS)
        return rows.mapInArrow(scan.matches(asked.plan(index.n, "bm25f"), tuple(columns)), ", ".join(["query_id string", *(f"{k} {v}" for k, v in columns.items())]))
    hits = asked.hits(index.postings, None).select("query_id", "doc_id").distinct()
    return hits.join(index.forward.select(*columns), "doc_id").select("query_id", *columns)


def bm25f_scores(index: Index, asked: Asked, params: S.Bm25f = S.Bm25f(), allowed: DataFrame | None = None) -> DataFrame:
    """By lookups in the postings: (query_id, doc_id, terms, <field>, <field>_exact, <field>_gap): each field's score and its evidence, before names and ranks.

    <field> is null where the field holds no term; exact and gap where it does not hold every original term of two or more.
    Postings are summed where they lie and without positions; only documents with a field that holds all of a query's
    terms are looked up again with them.
    """
    hits = asked.hits(index.postings, allowed)
    hits = hits.withColumns({f"_p_{f}": p for f, p in _parts(index, params).items()})
    hits = hits.withColumn("_ctf", reduce(add, [F.coalesce(F.col(f"_p_{f}"), F.lit(0.0)) for f in S.FIELDS]))
    # the term's score is shared out to the fields by their parts of its combined frequency
    hits = hits.withColumn("_unit", idf_bm25(index.n) * (params.k1 + 1) / (params.k1 + F.col("_ctf")) * H.log_term_frequency(F.col("qtf")) * F.col("boost"))
    summed = hits.groupBy("query_id", "doc_id").agg(
        *[F.sum(F.col("_unit") * F.col(f"_p_{f}")).alias(f) for f in S.FIELDS], *[F.sum(F.when(F.col(f"{f}_tf").isNotNull(), F.size("places"))).alias(f"_c_{f}") for f in S.FIELDS], *[c.alias(k) for k, c in asked.marks().items()]
    )
    rows = scratch(summed.join(asked.lists(), "query_id"), "bm25f-sums")
    whole = reduce(or_, [F.coalesce(F.col(f"_c_{f}") == F.col("_n_terms"), F.lit(False)) for f in S.FIELDS])
    pairs = rows.filter(whole & (F.col("_n_terms") >= 2)).select("query_id", "doc_id", "_n_terms")
    n = pairs.count()
    found = rows.select("query_id", "doc_id", asked.held().alias("terms"), *S.FIELDS)
    if not n:
        return found.select("*", *[F.lit(None).cast("int").alias(f"{f}_{x}") for f in S.FIELDS for x in ("exact", "gap")])
    extra = scratch(_evidence(asked, index, pairs, n), "bm25f-evidence")
    return found.join(small(extra, n), ["query_id", "doc_id"], "left")


def bonus(f: str, params: S.Bm25f) -> Column:
    """What the evidence in a field adds to its score."""
    w = params.weights.get(f, 1.0)
    return F.coalesce(params.phrase * F.col(f"{f}_exact") * w + params.proximity * w / (F.col(f"{f}_gap") + 1), F.lit(0.0))


def phrase_evidence(index: Index, processed: DataFrame, params: S.Bm25f = S.Bm25f(), allowed: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, field, exact, gap, bonus) wherever a field holds every original term."""
    asked = Asked(index, processed.filter(F.size("terms") >= 2))
    if asked.scanned:
        rows = _forward(index)
        rows = rows if allowed is None else rows.join(allowed, "doc_id", "left_semi")
        got = rows.select("doc_id", *S.FIELDS).mapInArrow(scan.evidence(asked.plan(index.n, "bm25f")), "query_id string, doc_id string, field string, exact int, gap int")
        weight = F.coalesce(*[F.when(F.col("field") == f, params.weights.get(f, 1.0)) for f in S.FIELDS])
        return got.withColumn("bonus", params.phrase * F.col("exact") * weight + params.proximity * weight / (F.col("gap") + 1))
    rows = bm25f_scores(index, asked, params, allowed)
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}_exact").alias("exact"), F.col(f"{f}_gap").alias("gap"), bonus(f, params).alias("bonus")) for f in S.FIELDS])
    return rows.select("query_id", "doc_id", F.inline(F.filter(each, lambda x: x["exact"].isNotNull())))


def total() -> Column:
    """The score of a row with a score or null by field."""
    return reduce(add, [F.coalesce(F.col(f), F.lit(0.0)) for f in S.FIELDS])


def _explained(rows: DataFrame) -> DataFrame:
    """Rows with a score or null by field: adds score, field_scores, matched_terms and matched_fields."""
    each = F.filter(F.array(*[F.struct(F.lit(f).alias("key"), F.col(f).alias("value")) for f in sorted(S.FIELDS)]), lambda x: x["value"].isNotNull())
    return rows.select("query_id", "doc_id", *[c for c in ("ord", "rank") if c in rows.columns], total().alias("score"), F.map_from_entries(each).alias("field_scores"), F.col("terms").alias("matched_terms"), F.transform(each, lambda x: x["key"]).alias("matched_fields"))


def scored_bm25f(index: Index, processed: DataFrame, params: S.Bm25f = S.Bm25f(), filters: S.Filters | None = None) -> DataFrame:
    """All documents that match, with field scores that add up to the score; not ranked."""
    asked = Asked(index, processed)
    if asked.scanned:
        return _explained(_terms_named(_scanned(index, asked, "bm25f", params, filters=filters), asked)).drop("ord")
    rows = bm25f_scores(index, asked, params, Q.filter_documents(index.documents, filters))
    return _explained(rows.withColumns({f: F.col(f) + bonus(f, params) for f in S.FIELDS}))


def scored_tfidf(index: Index, processed: DataFrame, weights: dict[str, float] = S.TFIDF_WEIGHTS, filters: S.Filters | None = None) -> DataFrame:
    """TF-IDF with field weights on the documents' side and unweighted document norms; not ranked."""
    asked = Asked(index, processed)
    if asked.scanned:
        return _explained(_terms_named(_scanned(index, asked, "tfidf", weights=weights, filters=filters), asked)).drop("ord")
    idf = idf_tfidf(index.n)
    terms = asked.stats.withColumn("idf", idf).withColumn("qw", H.log_term_frequency(F.col("qtf")) * F.col("idf") * F.col("boost"))
    terms = terms.withColumn("qnorm", F.sqrt(F.sum(F.col("qw") * F.col("qw")).over(Window.partitionBy("query_id"))))
    hits = asked.hits(index.postings, Q.filter_documents(index.documents, filters), terms)
    unit = F.col("qw") * F.col("idf") / F.col("qnorm")
    each = {f: F.when(F.col(f"{f}_tf").isNotNull(), weights.get(f, 1.0) * unit * H.log_term_frequency(F.col(f"{f}_tf"))) for f in S.FIELDS}
    summed = hits.groupBy("query_id", "channel", "doc_id").agg(*[F.sum(c).alias(f) for f, c in each.items()], *[c.alias(k) for k, c in asked.marks().items()])
    rows = summed.join(index.doc_norms, ["channel", "doc_id"]).join(asked.lists(), "query_id")
    return _explained(rows.select("query_id", "doc_id", asked.held().alias("terms"), *[(F.col(f) / F.col("norm")).alias(f) for f in S.FIELDS]))


def named(scored: DataFrame, index: Index, filters_by_query: DataFrame | None = None) -> DataFrame:
    """Adds the title, by which ties are ordered; keeps what passes its query's own filters (see Q.query_filters)."""
    docs = index.documents.select("doc_id", "title", *(Q.FILTER_COLUMNS if filters_by_query is not None else ()))
    out = scored.join(docs, "doc_id")
    if filters_by_query is not None:
        out = out.join(small(filters_by_query, filters_by_query.count()), "query_id").filter(Q.row_predicate())
    return out.select("query_id", "doc_id", "title", "score", "field_scores", "matched_terms", "matched_fields")


def order() -> list[Column]:
    return [F.desc(F.round("score", 9)), F.col("title"), F.col("doc_id")]


def ranked(found: DataFrame) -> DataFrame:
    """Adds each query's rank; a filter on it limits every task's rows before they are dealt by query."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order()))
    return found.withColumn("rank", rank).select("query_id", "rank", "doc_id", "title", "score", "field_scores", "matched_terms", "matched_fields")


def _ranked_scan(index: Index, asked: Asked, model: str, filters: S.Filters | None, filters_by_query: DataFrame | None, marks: bool, **how: object) -> DataFrame:
    """Scanned rows with each query's rank; ties are broken by ord, which stands for title and doc_id."""
    rows = _scanned(index, asked, model, filters=filters, filters_by_query=filters_by_query, marks=marks, **how).withColumn("score", total())
    rows = rows if marks else rows.select("query_id", "doc_id", "ord", "score")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "ord")))


def ranks(index: Index, processed: DataFrame, model: str, filters_by_query: DataFrame | None = None) -> DataFrame:
    """(query_id, rank, doc_id, score) of all documents that match: what evaluation and pools need, and no more."""
    asked = Asked(index, processed)
    if asked.scanned:
        how = {"params": S.Bm25f()} if model == "bm25f" else {"weights": S.TFIDF_WEIGHTS}
        return _ranked_scan(index, asked, model, None, filters_by_query, False, **how).select("query_id", "rank", "doc_id", "score")
    return (bm25f if model == "bm25f" else tfidf)(index, processed, filters_by_query=filters_by_query).select("query_id", "rank", "doc_id", "score")


def explained_ranks(index: Index, processed: DataFrame, params: S.Bm25f = S.Bm25f()) -> DataFrame:
    """bm25f without titles: (query_id, rank, doc_id, score, field_scores, matched_terms, matched_fields)."""
    asked = Asked(index, processed)
    if not asked.scanned:
        return bm25f(index, processed, params).drop("title")
    # only rows that are kept get their terms' names
    return _explained(_terms_named(_ranked_scan(index, asked, "bm25f", None, None, True, params=params), asked)).drop("ord")


def bm25f(index: Index, processed: DataFrame, params: S.Bm25f = S.Bm25f(), filters: S.Filters | None = None, filters_by_query: DataFrame | None = None) -> DataFrame:
    """All documents that match, ranked for each query."""
    return ranked(named(scored_bm25f(index, processed, params, filters), index, filters_by_query))


def tfidf(index: Index, processed: DataFrame, weights: dict[str, float] = S.TFIDF_WEIGHTS, filters: S.Filters | None = None, filters_by_query: DataFrame | None = None) -> DataFrame:
    return ranked(named(scored_tfidf(index, processed, weights, filters), index, filters_by_query))


def found_by_one(index: Index, text: str, ranker: str, filters: S.Filters | None = None, params: S.Bm25f = S.Bm25f(), expansions: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """The processed query and all that it finds, unranked. BM25F expands concepts, TF-IDF does not unless told to."""
    if expansions is None:
        expansions = Q.EXPANSIONS if ranker == "bm25f" else {}
    spark = index.documents.sparkSession
    q = Q.process(spark.createDataFrame([("q", text)], "query_id string, text string"), expansions, segmenter=index.segmenter)
    return q, named(scored_bm25f(index, q, params, filters) if ranker == "bm25f" else scored_tfidf(index, q, filters=filters), index)


def top(found: DataFrame, k: int, skip: int = 0) -> DataFrame:
    """Ranks skip + 1 to skip + k of one query's results: each task keeps its best, nothing is sorted whole."""
    best = found.orderBy(*order()).offset(skip).limit(k)
    # at most k rows are numbered
    return best.withColumn("rank", (F.row_number().over(Window.orderBy(*order())) + skip).cast("int"))


def search(index: Index, text: str, ranker: str = "bm25f", top_k: int = 10, filters: S.Filters | None = None, params: S.Bm25f = S.Bm25f(), expansions: dict | None = None) -> DataFrame:
    """The top documents of one query, with the document's own columns."""
    if top_k <= 0:
        raise ValueError("top_k must be positive")
    q, found = found_by_one(index, text, ranker, filters, params, expansions)
    extra = index.documents.select("doc_id", "url", "source", "image_url", "categories", "cook_time_minutes", "difficulty")
    expanded = q.select(F.col("query_id"), "expanded_terms")
    return top(found, top_k).join(extra, "doc_id").join(F.broadcast(expanded), "query_id").orderBy("rank")  # one query, one row
