"""Whole jobs: build an index from raw lines, evaluate rankers, pool and judge, audit coverage."""

from __future__ import annotations

import statistics
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..operators import evaluate as M
from ..operators import index as X
from ..operators import ingest as I
from ..operators import profile as C
from ..operators import query as Q
from ..operators import rank as R
from ..sources import files
from ..storage import scratch

MODELS = ("tfidf", "bm25f")
#: Least depth to which rankings are evaluated.
LEAST_DEPTH = 20
#: Names of the compared means (fixed values), and the metrics behind them.
COMPARED = {"precision_at_10": "precision_at_10", "map": "average_precision", "recall_at_20": "recall_at_20", "mrr_at_10": "reciprocal_rank_at_10", "ndcg_at_10": "ndcg_at_10"}
#: Columns of the report's table (fixed values).
CSV_COLUMNS = ["model", "query_id", "query", *M.METRICS, "latency_ms", "result_count", "relevant_count"]


def build_index(spark: SparkSession, raw: str, processed: str, index: str, report: str | None = None, segmenter=None) -> dict:
    """Raw JSONL to processed documents, index tables and a report."""
    docs, counts = I.ingest(files.read_lines(spark, raw))
    I.with_keys(docs.drop("ord")).write.mode("overwrite").parquet(processed)
    docs = spark.read.parquet(processed)
    tokens = scratch(I.streams(docs, segmenter), "build-tokens")
    X.build(docs, tokens, "custom" if segmenter else "basic", segmenter, index)
    built = X.load(spark, index, segmenter)
    out = {"processing": counts.first().asDict(), "index": X.statistics(built).first().asDict(), "profile": C.profile(docs), "word_segmentation": segmenter is not None}
    if report:
        files.write_json_report(out, report)
    return out


def rank_model(index: X.Index, queries: DataFrame, model: str) -> DataFrame:
    """(query_id, rank, doc_id, score) of all queries, each under its own filters where the table has them."""
    own = Q.query_filters(queries) if "filters" in queries.columns else None
    asked = Q.process(queries.select("query_id", "text"), Q.EXPANSIONS if model == "bm25f" else None, segmenter=index.segmenter)
    return R.ranks(index, asked, model, own)


def rank_all(index: X.Index, queries: DataFrame) -> DataFrame:
    """Both models: (model, query_id, rank, doc_id, score)."""
    first, second = (rank_model(index, queries, m).select(F.lit(m).alias("model"), "*") for m in MODELS)
    return first.unionByName(second)


def evaluate_rows(ranked: DataFrame, queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """(model, query_id, query, the metrics, result_count, relevant_count, top_10_doc_ids), a row a model and query."""
    relevant = qrels.groupBy("query_id").agg(F.count_if(F.col("relevance") > 0).alias("relevant_count"))
    out = None
    for model in MODELS:
        mine = ranked.filter(F.col("model") == model)
        best = F.sort_array(F.collect_list(F.when(F.col("rank") <= 10, F.struct("rank", "doc_id"))))
        found = mine.groupBy("query_id").agg(F.count("*").alias("result_count"), F.transform(best, lambda x: x["doc_id"]).alias("top_10_doc_ids"))
        rows = M.metrics(mine, qrels, queries).join(found, "query_id", "left").join(relevant, "query_id", "left").join(queries.select("query_id", F.col("text").alias("query")), "query_id")
        rows = rows.select(
            F.lit(model).alias("model"), "query_id", "query", *M.METRICS, F.coalesce("result_count", F.lit(0)).alias("result_count"), F.coalesce("relevant_count", F.lit(0)).alias("relevant_count"),
            F.coalesce("top_10_doc_ids", F.array().cast("array<string>")).alias("top_10_doc_ids"),
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def filters_of(row) -> S.Filters:
    """A query row's filters as one object."""
    f = row["filters"] if "filters" in row else None
    return S.Filters(f["max_time_minutes"], f["difficulty"] or None, *(tuple(f[k] or ()) for k in ("categories", "ingredients", "cooking_methods"))) if f else S.Filters()


def _percentile(values: list[float], p: int) -> float:
    if len(values) < 2:
        return (values or [0.0])[0]
    return statistics.quantiles(sorted(values), n=100, method="inclusive")[p - 1]


def evaluate(index: X.Index, queries: DataFrame, qrels: DataFrame, latency_runs: int = 3) -> dict:
    """The report of both models: per query metrics and counts from one plan, latencies query by query, means, differences."""
    if latency_runs <= 0:
        raise ValueError("latency_runs must be positive")
    M.check_ground_truth(queries, qrels)
    ranked = scratch(rank_all(index, queries), "eval-ranked")
    per = scratch(evaluate_rows(ranked, queries, qrels), "eval-metrics")
    means = {r.model: r.asDict() for r in M.mean_metrics(per, ["model"]).collect()}
    depth = max(LEAST_DEPTH, index.n)
    took: dict[tuple[str, str], float] = {}
    for q in queries.orderBy("query_id").toLocalIterator():  # judged queries: a person made each
        chosen = filters_of(q)
        for model in MODELS:
            run = lambda t, m=model, f=chosen: R.found_by_one(index, t, m, f)[1].orderBy(*R.order()).limit(depth).count()
            took[model, q.query_id] = M.latency(run, [q.text], latency_runs)[0]
    models = []
    for model in MODELS:
        rows = [r.asDict(True) for r in per.filter(F.col("model") == model).orderBy("query_id").toLocalIterator()]
        mean = {k: means.get(model, {}).get(k, 0.0) for k in M.METRICS}
        mine = [took[model, r["query_id"]] for r in rows]
        summary = mean | {"map": mean["average_precision"], "mrr_at_10": mean["reciprocal_rank_at_10"], "latency_p50_ms": _percentile(mine, 50), "latency_p95_ms": _percentile(mine, 95)}
        listed = [{k: r[k] for k in ("model", "query_id", "query", "result_count", "relevant_count", "top_10_doc_ids")} | {"metrics": {k: r[k] for k in M.METRICS}, "latency_ms": took[model, r["query_id"]]} for r in rows]
        models.append({"model": model, "query_count": len(rows), "summary": summary, "per_query": listed})
    tf, bm = (m["summary"] for m in models)
    return {"query_count": queries.count(), "judgment_count": qrels.count(), "models": models, "bm25f_minus_tfidf": {k: bm[k] - tf[k] for k in COMPARED}}


def save_evaluation(report: dict, json_path: str, csv_path: str) -> None:
    files.write_json_report(report, json_path)
    files.write_csv_report([q | q["metrics"] for m in report["models"] for q in m["per_query"]], CSV_COLUMNS, csv_path)


def pool(index: X.Index, queries: DataFrame, depth: int) -> DataFrame:
    """Candidates to judge: both rankings' tops fused, under each query's filters; a query that finds nothing asks its fallback."""
    fuse = lambda q: M.fused_pool([rank_model(index, q, m) for m in MODELS], depth)
    return M.with_fallback(scratch(fuse(queries), "judge-pool"), queries, fuse)


def judging_candidates(index: X.Index, queries: DataFrame, qrels: DataFrame, depth: int = 5, query_id: str | None = None, rejudge: bool = False) -> DataFrame:
    """The pool's rows that have no judgment yet (all with rejudge), with what a person needs to judge them."""
    if query_id is not None:
        queries = queries.filter(F.col("query_id") == query_id)
        if not queries.limit(1).count():
            raise ValueError(f"unknown query id {query_id!r}")
    rows = M.to_judge(pool(index, queries, depth), qrels, rejudge)
    shown = index.documents.select("doc_id", "title", "total_time_minutes", "difficulty", "categories", "ingredients", "description", "url")
    return rows.join(queries.select("query_id", "text"), "query_id").join(shown, "doc_id").orderBy("query_id", "pool_rank")


def judge(index: X.Index, queries: DataFrame, path: str, depth: int = 5, query_id: str | None = None, rejudge: bool = False, ask: Callable[[dict], str] | None = None) -> int:
    """Ask for a label of each candidate: 0, 1, 2, s (skip) or q (quit). Judgments are kept after every answer, so a later
    run goes on where this one ended. Gives the number of judgments."""
    spark = index.documents.sparkSession
    known = {(r.query_id, r.doc_id): r.relevance for r in files.load_judgments(spark, path).toLocalIterator()}
    done = spark.createDataFrame([(q, d, r) for (q, d), r in known.items()], files.QRELS)
    answer = ask or (lambda row: input(f"{row['query_id']} {row['text']} | {row['title']} {row['url']} [0/1/2/s/q]: "))
    for row in judging_candidates(index, queries, done, depth, query_id, rejudge).toLocalIterator():
        said = ""
        while said not in ("0", "1", "2", "s", "q"):
            try:
                said = answer(row.asDict(True)).strip().lower()
            except (EOFError, KeyboardInterrupt):
                said = "q"
        if said == "q":
            break
        if said != "s":
            known[row.query_id, row.doc_id] = int(said)
            files.write_judgments([(q, d, r) for (q, d), r in known.items()], path)
    files.write_judgments([(q, d, r) for (q, d), r in known.items()], path)
    return len(known)


def timed_search(index: X.Index, text: str, ranker: str = "bm25f", top_k: int = 10, filters: S.Filters | None = None) -> tuple[list[dict], float]:
    """Results as plain dictionaries, and the milliseconds that they took."""
    began = time.perf_counter()
    rows = [r.asDict(True) for r in R.search(index, text, ranker, top_k, filters).collect()]
    return rows, 1000 * (time.perf_counter() - began)


def audit_coverage(index: X.Index, probes: DataFrame | tuple[str, ...] = C.PROBES, top_k: int = 3) -> dict:
    """Corpus statistics, profile and what the probes find. probes: texts, or a table of them (see C.probe)."""
    found = [{k: v for k, v in r.asDict(True).items() if k != "ord"} for r in C.probe(index, probes, top_k).collect()]
    return {"index": X.statistics(index).first().asDict(), "corpus": C.profile(index.documents), "query_probes": found}


def probes_of(queries: DataFrame) -> DataFrame:
    """(ord, text) of a query table, in order of its ids."""
    return queries.select(F.col("query_id").alias("ord"), "text")
