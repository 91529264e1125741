"""Command line: build, search, evaluate, judge, coverage, serve."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from .. import schema as S
from .. import storage
from ..functions.text import load_segmenter
from ..operators import index as X
from ..operators import profile as C
from ..sources import files
from . import pipelines


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quillon")
    p.add_argument("--segment", action="store_true", help="cut words with the optional segmenter, if it is installed")
    sub = p.add_subparsers(dest="command", required=True)
    b = sub.add_parser("build")
    for a in ("raw", "processed", "index"):
        b.add_argument(a)
    b.add_argument("--report")
    s = sub.add_parser("search")
    s.add_argument("index")
    s.add_argument("query", nargs="?")
    s.add_argument("--ranker", choices=("bm25f", "tfidf"), default="bm25f")
    s.add_argument("--top-k", type=int, default=10)
    s.add_argument("--max-time", type=int)
    s.add_argument("--difficulty")
    for a in ("category", "ingredient", "method"):
        s.add_argument(f"--{a}", action="append", default=[])
    s.add_argument("--json", action="store_true")
    e = sub.add_parser("evaluate")
    for a in ("index", "queries", "judgments", "json_report", "csv_report"):
        e.add_argument(a)
    e.add_argument("--latency-runs", type=int, default=3)
    j = sub.add_parser("judge")
    for a in ("index", "queries", "judgments"):
        j.add_argument(a)
    j.add_argument("--pool-depth", type=int, default=5)
    j.add_argument("--query-id")
    j.add_argument("--rejudge", action="store_true")
    c = sub.add_parser("coverage")
    c.add_argument("index")
    c.add_argument("report")
    c.add_argument("--queries", help="a JSONL file of queries to probe instead of the built-in ones")
    h = sub.add_parser("serve")
    h.add_argument("index")
    h.add_argument("--port", type=int, default=8000)
    return p


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("quillon").getOrCreate()
    try:
        run(spark, args)
    finally:
        storage.clear(spark)


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    cut = load_segmenter() if args.segment else None
    if args.command == "build":
        print(json.dumps(pipelines.build_index(spark, args.raw, args.processed, args.index, args.report, cut), ensure_ascii=False))
        return
    index = X.load(spark, args.index, cut)
    if args.command == "search":
        chosen = S.Filters(args.max_time, args.difficulty, tuple(args.category), tuple(args.ingredient), tuple(args.method))
        text = args.query or input("query: ")
        while text.strip():
            rows, took = pipelines.timed_search(index, text, args.ranker, args.top_k, chosen)
            for r in rows:
                print(json.dumps(r, ensure_ascii=False) if args.json else f"{r['rank']:>3} {r['score']:9.4f} {r['doc_id']} {r['title']}")
            if not args.json:
                print(f"{len(rows)} results, {took:.1f} ms")
            text = "" if args.query else input("query: ")
    elif args.command == "evaluate":
        report = pipelines.evaluate(index, files.load_queries(spark, args.queries), files.load_judgments(spark, args.judgments), args.latency_runs)
        pipelines.save_evaluation(report, args.json_report, args.csv_report)
    elif args.command == "judge":
        print(pipelines.judge(index, files.load_queries(spark, args.queries), args.judgments, args.pool_depth, args.query_id, args.rejudge))
    elif args.command == "serve":
        from wsgiref.simple_server import make_server

        from ..operators.serve import Engine
        from .http import application

        make_server("", args.port, application(Engine(index))).serve_forever()
    else:
        probes = pipelines.probes_of(files.load_queries(spark, args.queries)) if args.queries else C.PROBES
        files.write_json_report(pipelines.audit_coverage(index, probes), args.report)


if __name__ == "__main__":
    main()
