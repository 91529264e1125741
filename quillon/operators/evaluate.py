"""Offline evaluation: metrics per query, means, deltas, fusion pools, judgments."""

from __future__ import annotations

import statistics
import time

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

METRICS = ("precision_at_10", "average_precision", "recall_at_20", "reciprocal_rank_at_10", "ndcg_at_10")
#: Constant of reciprocal rank fusion.
RRF = 60


def _k(k: int) -> int:
    if k <= 0:
        raise ValueError("k must be positive")
    return k


def _judged(ranked: DataFrame, qrels: DataFrame) -> DataFrame:
    return ranked.select("query_id", "doc_id", "rank").join(qrels.select("query_id", "doc_id", "relevance"), ["query_id", "doc_id"], "left").withColumn("relevance", F.coalesce("relevance", F.lit(0)))


def metrics(ranked: DataFrame, qrels: DataFrame, queries: DataFrame, precision_k: int = 10, recall_k: int = 20, rr_k: int = 10, ndcg_k: int = 10) -> DataFrame:
    """One row a query: precision, average precision, recall, reciprocal rank and nDCG; queries without results get 0."""
    for k in (precision_k, recall_k, rr_k, ndcg_k):
        _k(k)
    j = _judged(ranked, qrels)
    hit = F.col("relevance") > 0
    running = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    j = j.withColumn("hits", F.sum(hit.cast("int")).over(running))
    gain = F.pow(F.lit(2.0), F.col("relevance")) - 1
    got = j.groupBy("query_id").agg(
        F.count_if(hit & (F.col("rank") <= precision_k)).alias("p_hits"), F.count_if(hit & (F.col("rank") <= recall_k)).alias("r_hits"),
        F.sum(F.when(hit, F.col("hits") / F.col("rank")).otherwise(0.0)).alias("ap_sum"), F.min(F.when(hit & (F.col("rank") <= rr_k), F.col("rank"))).alias("first"),
        F.sum(F.when(F.col("rank") <= ndcg_k, gain / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"),
    )
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("relevance"), "doc_id"))
    ideal = qrels.withColumn("place", place).groupBy("query_id").agg(
        F.count_if(F.col("relevance") > 0).alias("relevant"), F.sum(F.when(F.col("place") <= ndcg_k, gain / F.log2(F.col("place") + 1)).otherwise(0.0)).alias("best")
    )
    full = queries.select("query_id").join(got, "query_id", "left").join(ideal, "query_id", "left").na.fill(0, ["p_hits", "r_hits", "relevant"]).na.fill(0.0, ["ap_sum", "dcg", "best"])
    some = F.col("relevant") > 0
    return full.select(
        "query_id", (F.col("p_hits") / precision_k).alias(METRICS[0]), F.when(some, F.col("ap_sum") / F.col("relevant")).otherwise(0.0).alias(METRICS[1]),
        F.when(some, F.col("r_hits") / F.col("relevant")).otherwise(0.0).alias(METRICS[2]), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias(METRICS[3]),
        F.when(F.col("best") > 0, F.col("dcg") / F.col("best")).otherwise(0.0).alias(METRICS[4]),
    )


def mean_metrics(per_query: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Macro means; zeros for an empty input without groups."""
    means = [F.coalesce(F.avg(m), F.lit(0.0)).alias(m) for m in METRICS]
    return per_query.groupBy(*by).agg(*means) if by else per_query.agg(*means)


def percentile(df: DataFrame, column: str, p: float) -> DataFrame:
    """Linearly interpolated percentile, 0 for no rows."""
    if not 0 <= p <= 100:
        raise ValueError("percentile must lie between 0 and 100")
    return df.agg(F.coalesce(F.percentile(column, p / 100), F.lit(0.0)).alias("percentile"))


def compare(per_model: DataFrame, a: str, b: str) -> DataFrame:
    """Differences of the two models' means, a minus b. per_model: query metrics with a model column."""
    means = mean_metrics(per_model, ["model"])
    side = lambda m, x: means.filter(F.col("model") == m).select(*[F.col(k).alias(f"{x}_{k}") for k in METRICS], F.lit(1).alias("_one"))
    both = side(a, "a").join(side(b, "b"), "_one")
    return both.select(*[(F.col(f"a_{k}") - F.col(f"b_{k}")).alias(k) for k in METRICS])


def unjudged(queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """Ids of the queries without a positive judgment."""
    return queries.join(qrels.filter("relevance > 0"), "query_id", "left_anti").select("query_id")


def check_ground_truth(queries: DataFrame, qrels: DataFrame) -> None:
    """Every query needs a positive judgment; the error names up to a hundred that have none."""
    missing = unjudged(queries, qrels).orderBy("query_id").limit(100).collect()
    if missing:
        raise ValueError("queries without a positive judgment: " + ", ".join(r.query_id for r in missing))


def fused_pool(rankings: list[DataFrame], depth: int) -> DataFrame:
    """(query_id, doc_id, score, best_rank, pool_rank): reciprocal rank fusion of the rankings' tops."""
    if depth <= 0:
        raise ValueError("depth must be positive")
    every = rankings[0].select("query_id", "doc_id", "rank")
    for r in rankings[1:]:
        every = every.unionByName(r.select("query_id", "doc_id", "rank"))
    pool = every.filter(F.col("rank") <= depth).groupBy("query_id", "doc_id").agg(F.sum(1 / (RRF + F.col("rank"))).alias("score"), F.min("rank").alias("best_rank"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "best_rank", "doc_id")
    return pool.withColumn("pool_rank", F.row_number().over(order))


#: What a query asks instead if neither ranker finds anything, for the judging pool only (fixed values).
POOL_FALLBACK = {"hải sản": "cá tôm mực nghêu ốc"}


def with_fallback(pool: DataFrame, queries: DataFrame, fallback_pool) -> DataFrame:
    """pool, and for queries without any row in it the pool of their fallback text. fallback_pool(queries) ranks it."""
    key = F.lower(F.trim("text"))
    other = F.coalesce(*[F.when(key == k, v) for k, v in POOL_FALLBACK.items()], F.lit(None).cast("string"))
    again = queries.withColumn("_other", other).filter("_other is not null").join(pool.select("query_id").distinct(), "query_id", "left_anti")
    again = again.withColumn("text", F.col("_other")).drop("_other")
    return pool.unionByName(fallback_pool(again)) if again.limit(1).count() else pool


def to_judge(pool: DataFrame, qrels: DataFrame, rejudge: bool = False) -> DataFrame:
    return pool if rejudge else pool.join(qrels.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")


def merge_judgments(old: DataFrame, new: DataFrame) -> DataFrame:
    """New judgments replace old ones of the same pair."""
    return old.join(new, ["query_id", "doc_id"], "left_anti").unionByName(new.select(*old.columns))


def latency(run, texts: list[str], runs: int = 3) -> list[float]:
    """Median milliseconds of each query over some runs; run executes one query."""
    out = []
    for t in texts:
        took = []
        for _ in range(_k(runs)):
            began = time.perf_counter()
            run(t)
            took.append(1000 * (time.perf_counter() - began))
        out.append(statistics.median(took))
    return out
