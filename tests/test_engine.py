"""Scalars, ingest, index, ranking, service and evaluation on small corpora with known answers."""

import itertools
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from quillon import catalog
from quillon import schema as S
from quillon.functions import scalars as H
from quillon.functions import snippets
from quillon.functions import text as X
from quillon.operators import evaluate as M
from quillon.operators import extract as E
from quillon.operators import index as I
from quillon.operators import ingest
from quillon.operators import profile as C
from quillon.operators import query as Q
from quillon.operators import rank as R
from quillon.operators import serve
from quillon.plans import pipelines
from quillon.sources import files

# Corpus of the golden scores (fixed values).
RECIPES = [
    {"doc_id": "chicken-grill", "title": "Gà nướng mật ong", "description": "Thịt gà nướng thơm và mềm.", "ingredients": ["thịt gà", "mật ong"], "instructions": ["Ướp gà", "Nướng chín"],
     "categories": ["Món mặn", "Bữa tối"], "cooking_method": "nướng", "cook_time_minutes": 30, "difficulty": "Dễ"},
    {"doc_id": "chicken-soup", "title": "Súp gà nấm", "description": "Món súp nóng cho bữa sáng.", "ingredients": ["thịt gà", "nấm"], "instructions": ["Nấu súp"],
     "categories": ["Món mặn", "Bữa sáng"], "cooking_method": "súp", "cook_time_minutes": 15, "difficulty": "Dễ"},
    {"doc_id": "seafood", "title": "Mực chiên giòn", "description": "Mực giòn dùng nóng.", "ingredients": ["mực ống"], "instructions": ["Chiên mực"],
     "categories": ["Món mặn"], "cooking_method": "chiên", "cook_time_minutes": 20, "difficulty": "Trung bình"},
]
GOLDEN = [
    ("gà", "bm25f", [0.864924, 0.836828, None]), ("gà", "tfidf", [1.229568, 0.998039, None]),
    ("gà nướng", "bm25f", [17.661694, 0.836828, None]), ("gà nướng", "tfidf", [1.939255, 0.604161, None]),
    ("ga nuong", "bm25f", [17.661694, 0.836828, None]), ("ga nuong", "tfidf", [1.984397, 0.604161, None]),
    ("hải sản", "bm25f", [None, None, 0.657307]), ("hải sản", "tfidf", [None, None, None]),
    ("món sáng", "bm25f", [0.158966, 2.318044, 0.172400]), ("món sáng", "tfidf", [0.104055, 0.762047, 0.128586]),
]


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(expr.alias("x")).first().x


@pytest.fixture(scope="module")
def index(spark):
    rows = [{f.name: r.get(f.name, f"https://example.com/{r['doc_id']}" if f.name == "url" else "example.com" if f.name == "source" else None) for f in S.RECIPE.fields} for r in RECIPES]
    docs = ingest.with_keys(spark.createDataFrame(rows, S.RECIPE)).cache()
    return I.build(docs, ingest.tokenized(docs).cache())


def test_text(spark):
    f = F.lit
    assert one(spark, X.normalize_text(f("  GÀ\n nướng   SẢ  "))) == "gà nướng sả"
    assert one(spark, X.normalize_text(f("gà"))) == "gà"
    assert one(spark, X.strip_accents(f("Đậu hũ chiên đường"))) == "Dau hu chien duong"
    assert one(spark, X.tokenize(f("Gà nướng_30 phút!"))) == ["gà", "nướng", "30", "phút"]
    assert one(spark, X.ranking_terms(F.array(*map(f, ("chó", "chợ", "sáu", "va", "gà", "và"))))) == ["va", "gà"]
    assert one(spark, X.deduplicate_texts(F.array(*map(f, (" Gà ", "sả", "gà", "", "Sả", "- Sả •"))))) == ["Gà", "sả"]
    assert one(spark, X.comparison_form(f(" Muỗng: "))) == "muong"
    with pytest.raises(ValueError):
        X.normalize_unicode(f("x"), "NFX")


def test_long_lists_are_deduplicated_in_linear_time(spark):
    """A list of very many lines: one pass over it, not one for each line."""
    import time

    lines = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(49_999)), lambda i: F.concat(F.lit(" - Line "), (i % 40_000).cast("string"))).alias("l"))
    began = time.time()
    got = lines.select(X.deduplicate_texts(F.col("l")).alias("t")).first().t
    assert len(got) == 40_000 and got[0] == "Line 0" and got[-1] == "Line 39999" and time.time() - began < 20
    assert one(spark, X.deduplicate_texts(F.array(F.lit(None).cast("string"), F.lit("\u00a0a\u2003 b"), F.lit("A b"), F.lit("e\u0301"), F.lit("\u00c9")))) == ["a b", "e\u0301"]
    assert one(spark, X.deduplicate_texts(F.lit(None).cast("array<string>"))) == []


def test_python_gets_few_documents_at_once(spark):
    from quillon.storage import BATCH_DOCS

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    pages = spark.range(2_000).select(F.lit("http://a/").alias("url"), F.lit("<h1>x</h1>").alias("html"))
    for make in (lambda: E.extract_recipes(pages), lambda: E.detail_links(pages, "a"), lambda: X.tokenize_with(str.split, F.lit("a b")), lambda: X.deduplicate_texts(F.array(F.lit("a")))):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
        make()
        assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == BATCH_DOCS


def test_scalars(spark):
    d = {"PT1H15M": 75, "1 giờ 20 phút": 80, "30 Phút": 30, "không rõ": None, "1h30": None, "1h30p": 30, "P": 0, "45": 45, "": None, "P2DT5M": 5}
    for text, want in d.items():
        assert one(spark, H.parse_duration_minutes(F.lit(text))) == want, text
    assert one(spark, H.canonicalize_url(F.lit("HTTPS://Example.com/recipe/?utm_source=test#top"))) == "https://example.com/recipe"
    assert one(spark, H.canonicalize_url(F.lit("http://A.b?x=1"))) == "http://a.b/"
    import hashlib

    want = hashlib.sha256(json.dumps(["Gà \"x\"", ["a", "b\t"], []], ensure_ascii=False).lower().encode()).hexdigest()
    got = one(spark, H.content_hash(F.lit('Gà "x"'), F.array(F.lit("a"), F.lit("b\t")), F.array().cast("array<string>")))
    assert got == want


def test_first_wins_against_sequential(spark):
    import random

    random.seed(5)
    rows = [(i, random.choice("abcdefgh"), random.choice(["", *"uvwxyz"])) for i in range(40)] + [(40, "q1", "h9"), (41, "q1", "h10"), (42, "q3", "h10")]
    seen_a, seen_b, want = set(), set(), []
    for o, a, b in rows:
        if a in seen_a or b and b in seen_b:
            continue
        want.append(o)
        seen_a.add(a)
        seen_b |= {b} - {""}
    got = ingest.first_wins(spark.createDataFrame(rows, "ord long, a string, b string"), [F.col("a"), F.col("b")])
    assert sorted(r.ord for r in got.collect()) == want and {40, 42} <= set(want)


def test_ingest_counts(spark, tmp_path):
    good = {"doc_id": "1", "title": "A", "url": "u", "source": "s", "ingredients": ["Muỗng", "Gram", "gà 3 gram"], "description": "Gợi ý cơm nhà hôm nay", "content_hash": "h", "total_time_minutes": 3}
    lines = [json.dumps(good), json.dumps(good), "{bad", "", json.dumps(good | {"doc_id": "2", "content_hash": "k", "title": None}), json.dumps(good | {"doc_id": "3", "odd": 1}), json.dumps(good | {"doc_id": "4", "content_hash": "z", "cook_time_minutes": -1})]
    (tmp_path / "raw.jsonl").write_text("\n".join(lines) + "\n")
    docs, report = ingest.ingest(files.read_lines(spark, str(tmp_path / "raw.jsonl")))
    r = report.first()
    assert (r.input_count, r.output_count, r.duplicate_count, r.invalid_count) == (6, 1, 1, 4)
    assert (r.cleaned_count, r.removed_ingredient_artifacts, r.cleared_promotional_descriptions) == (1, 2, 1)
    assert docs.first().ingredients == ["gà 3 gram"] and docs.first().description == ""


def test_equal_texts_of_two_languages(spark, tmp_path):
    """The SQL of ingest_documents has a row for each text and language."""
    rows = [(5, "a word", "en", "s", 6), (6, "a word", "fr", "s", 6), (7, "a word", "en", "t", 6), (8, "other", "en", "s", 5)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = catalog.queries()["ingest_documents"](spark, str(tmp_path)).collect()
    assert sorted((r.title, r.ingredients) for r in got) == [("a word", "3 gram|en"), ("a word", "3 gram|fr"), ("other", "3 gram|en")]
    assert all(len(r.content_hash) == 64 for r in got)
    assert catalog.queries()["ingest_report"](spark, str(tmp_path)).first().output_count == 2


def test_build_pipeline(spark, tmp_path):
    rows = [r | {"url": "https://example.com/x", "source": "s"} for r in RECIPES]
    (tmp_path / "raw.jsonl").write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in rows))
    out = pipelines.build_index(spark, *(str(tmp_path / x) for x in ("raw.jsonl", "docs", "index")), str(tmp_path / "report.json"))
    assert out["index"] == {"document_count": 3, "normalized_vocabulary": 25, "accentless_vocabulary": 24, "posting_count": 112, "token_count": 56}
    loaded = I.load(spark, str(tmp_path / "index"))
    assert [r.doc_id for r in R.search(loaded, "gà nướng", top_k=2).collect()] == ["chicken-grill", "chicken-soup"]


def test_statistics_and_lookups(index):
    s = I.statistics(index).first()
    assert (s.document_count, s.normalized_vocabulary, s.accentless_vocabulary, s.posting_count, s.token_count) == (3, 25, 24, 112, 56)
    assert I.document_frequency(index, "gà") == 2 and I.collection_frequency(index, "ga", channel="accentless") == 6
    assert [r.field for r in I.get_postings(index, "gà").collect()][:2] == ["title", "title"]
    with pytest.raises(ValueError):
        I.terms(index, "x")
    with pytest.raises(ValueError):
        I.get_postings(index, "gà", "x")


@pytest.mark.parametrize("text,ranker,want", GOLDEN)
def test_golden_scores(index, text, ranker, want):
    got = {r.doc_id: r for r in R.search(index, text, ranker, 10).collect()}
    for doc, score in zip(("chicken-grill", "chicken-soup", "seafood"), want):
        assert (doc in got) == (score is not None)
        if score is not None:
            assert abs(got[doc].score - score) < 1e-6 and abs(sum(got[doc].field_scores.values()) - got[doc].score) < 1e-9


def test_phrase_and_gap(spark):
    cases = [([[4, 7], [4, 7]], 0, 0), ([[0], [1]], 1, 0), ([[0], [3]], 0, 2), ([[5], [1], [9]], 0, 6), ([[1, 2, 3], [2, 3, 4]], 3, 0)]
    for lists, exact, gap in cases:
        df = spark.createDataFrame([(lists,)], "l array<array<int>>")
        r = df.select(R.phrase_count(F.col("l")).alias("e"), R.minimum_gap(F.col("l")).alias("g")).first()
        assert r.e == exact, lists
        if lists[0] != [4, 7]:
            assert r.g == gap, lists
        else:
            assert r.g == 0


def test_filters_keep_statistics(index):
    free = {r.doc_id: r.score for r in R.search(index, "món", top_k=9).collect()}
    some = {r.doc_id: r.score for r in R.search(index, "món", top_k=9, filters=S.Filters(max_time_minutes=20)).collect()}
    assert set(some) == {"chicken-soup", "seafood"} and all(abs(free[k] - v) < 1e-12 for k, v in some.items())
    ids = lambda **f: {r.doc_id for r in Q.filter_documents(index.documents, S.Filters(**f)).collect()}
    assert ids(difficulty="de") == {"chicken-grill", "chicken-soup"} and ids(categories=("bua sang",)) == {"chicken-soup"}
    assert ids(cooking_methods=("nướng lò",)) == {"chicken-grill"} and ids(categories=("",)) == set() and ids(max_time_minutes=0) == set()
    with pytest.raises(ValueError):
        S.Filters(max_time_minutes=-1)


def test_query_processing(spark):
    q = spark.createDataFrame([("1", "món hải sản"), ("2", "và với"), ("3", ""), ("4", "canh chua"), ("5", "hải sản!")], "query_id string, text string")
    got = {r.query_id: r for r in Q.process(q, Q.EXPANSIONS).collect()}
    assert got["1"].terms == ["món", "hải", "sản"] and got["1"].expanded_terms == ["cá", "tôm", "mực", "nghêu", "ốc"] and got["1"].channel == "normalized"
    assert got["2"].terms == ["và", "với"] and got["3"].terms == [] and got["4"].channel == "accentless" and got["5"].expanded_terms == []
    with pytest.raises(ValueError):
        Q.process(q, boost=0)
    with pytest.raises(ValueError):
        S.Bm25f(k1=0)


def test_service(index):
    e = serve.Engine(index)
    r = e.search("gà", page_size=1)
    assert (r["pagination"]["total_results"], r["pagination"]["total_pages"], r["pagination"]["has_next"]) == (2, 2, True)
    assert r["facets"]["categories"][0] == {"value": "Món mặn", "count": 2} and r["results"][0]["doc_id"] == "chicken-grill"
    s = e.search("ga nuong")["results"][0]["snippet"]
    assert s["field"] == "title" and [s["text"][h["start"]:h["end"]] for h in s["highlights"]] == ["Gà", "nướng"]
    far = e.search("gà", page_number=99)
    assert far["results"] == [] and far["pagination"]["has_previous"] and not far["pagination"]["has_next"]
    assert [x["doc_id"] for x in e.search("gà", categories=["Bữa sáng"], max_time_minutes=15)["results"]] == ["chicken-soup"]
    for args, code in (({"q": " "}, "missing_query"), ({"q": "a", "ranker": "x"}, "invalid_ranker"), ({"q": "a", "page_number": "zero"}, "invalid_parameter"), ({"q": "a", "page_size": 51}, "invalid_parameter")):
        with pytest.raises(serve.ServiceError) as err:
            e.search(**args)
        assert err.value.code == code
    assert e.health()["index"]["document_count"] == 3 and r["query"]["filters"]["categories"] == [] and r["results"][0]["explanation"]["matched_terms"] == ["gà"]


def test_http(index):
    from quillon.plans.http import application

    app, seen = application(serve.Engine(index)), {}

    def get(path, query="", method="GET"):
        body = b"".join(app({"PATH_INFO": path, "QUERY_STRING": query, "REQUEST_METHOD": method}, lambda status, headers: seen.update(status=status, headers=dict(headers))))
        return seen["status"], json.loads(body or b"null")

    status, body = get("/api/v1/search", "q=g%C3%A0&category=B%E1%BB%AFa+s%C3%A1ng&max_time=15&page_size=5")
    assert status == "200 OK" and [x["doc_id"] for x in body["results"]] == ["chicken-soup"] and body["query"]["filters"]["max_time_minutes"] == 15
    assert seen["headers"]["X-API-Version"] == "1.0" and seen["headers"]["X-Content-Type-Options"] == "nosniff"
    for query, code in (("", "missing_query"), ("q=a&ranker=x", "invalid_ranker"), ("q=a&page=0", "invalid_parameter"), ("q=a&max_time=-1", "invalid_parameter")):
        status, body = get("/api/v1/search", query)
        assert status == "400 Bad Request" and body["error"]["code"] == code
    assert get("/api/v1")[1]["endpoints"] == ["/api/v1/health", "/api/v1/search"] and get("/api/v1/health/")[1]["status"] == "ok"
    assert get("/nothing")[0] == "404 Not Found" and get("/api/v1", method="POST")[1]["error"]["code"] == "method_not_allowed"


def test_snippet_window():
    text = "mở đầu " * 60 + "gà nướng thơm " + "phần cuối " * 40
    s = snippets.snippet({"title": "", "description": text}, ["description"], ["ga"])
    h = s["highlights"][0]
    assert s["text"][0] == s["text"][-1] == "…" and s["text"][h["start"]:h["end"]] == "gà" and len(s["text"]) <= 222


def test_snippets_in_the_case_of_the_index():
    """ß and ss are two terms of the index; full folding takes them for one."""
    shown = lambda **how: snippets.snippet({"title": "SS Ä ß a"}, ["title"], ["ß", "a"], **how)
    marked = lambda s: [s["text"][h["start"] : h["end"]] for h in s["highlights"]]
    assert marked(shown(full=False)) == ["Ä", "ß", "a"] and marked(shown()) == ["SS", "Ä", "ß", "a"]


def test_metrics(spark):
    ranked = spark.createDataFrame([("q", "d2", 1), ("q", "d1", 2), ("q", "d3", 3)], "query_id string, doc_id string, rank int")
    qrels = spark.createDataFrame([("q", "d1", 2), ("q", "d3", 1), ("q", "d4", 1), ("r", "x", 1)], "query_id string, doc_id string, relevance int")
    queries = spark.createDataFrame([("q",), ("r",)], "query_id string")
    got = {r.query_id: r for r in M.metrics(ranked, qrels, queries, 2, 2).collect()}
    assert got["q"].precision_at_10 == 0.5 and abs(got["q"].recall_at_20 - 1 / 3) < 1e-12 and got["q"].reciprocal_rank_at_10 == 0.5
    assert abs(got["q"].average_precision - 7 / 18) < 1e-12 and 0 < got["q"].ndcg_at_10 < 1 and got["r"].ndcg_at_10 == 0
    assert M.percentile(spark.createDataFrame([(10.0,), (20.0,)], "v double"), "v", 95).first()[0] == 19.5
    M.check_ground_truth(queries, qrels)
    with pytest.raises(ValueError):
        M.check_ground_truth(queries, qrels.filter("query_id = 'q'"))
    with pytest.raises(ValueError):
        M.metrics(ranked, qrels, queries, 0)
    pool = M.fused_pool([ranked, ranked.filter("rank = 1")], 2).orderBy("pool_rank").collect()
    assert [r.doc_id for r in pool] == ["d2", "d1"] and M.to_judge(M.fused_pool([ranked], 3), qrels).count() == 1


def test_evaluation_report(spark, index, tmp_path):
    queries = spark.createDataFrame([("q", "gà nướng", None), ("r", "gà", (15, None, None, [], []))], "query_id string, text string, filters struct<max_time_minutes int, difficulty string, categories array<string>, ingredients array<string>, cooking_methods array<string>>")
    qrels = spark.createDataFrame([("q", "chicken-grill", 2), ("r", "chicken-grill", 1)], "query_id string, doc_id string, relevance int")
    rep = pipelines.evaluate(index, queries, qrels, 1)
    assert [m["model"] for m in rep["models"]] == ["tfidf", "bm25f"] and (rep["query_count"], rep["judgment_count"]) == (2, 2)
    q, r = rep["models"][1]["per_query"]
    assert q["metrics"]["average_precision"] == 1.0 and q["top_10_doc_ids"] == ["chicken-grill", "chicken-soup"] and (q["result_count"], q["relevant_count"]) == (2, 1)
    assert r["top_10_doc_ids"] == ["chicken-soup"] and r["metrics"]["average_precision"] == 0.0  # its own filter
    assert rep["models"][1]["summary"]["map"] == 0.5 and set(rep["bm25f_minus_tfidf"].values()) == {0.0} and rep["models"][0]["summary"]["latency_p95_ms"] > 0
    pipelines.save_evaluation(rep, str(tmp_path / "r.json"), str(tmp_path / "r.csv"))
    assert (tmp_path / "r.csv").read_bytes().startswith(b"\xef\xbb\xbfmodel,query_id,query,precision_at_10,average_precision,recall_at_20,reciprocal_rank_at_10,ndcg_at_10,latency_ms,result_count,relevant_count\r\n")
    files.save_judgments(qrels, str(tmp_path / "j"))
    assert files.load_judgments(spark, str(tmp_path / "j")).count() == 2 and files.load_judgments(spark, str(tmp_path / "none")).count() == 0


def test_judging(spark, index, tmp_path):
    queries = spark.createDataFrame([("q", "gà"), ("s", "Hải sản ")], "query_id string, text string")
    path = str(tmp_path / "qrels.jsonl")
    answers = iter(["1", "x", "q"])
    assert pipelines.judge(index, queries.limit(1), path, ask=lambda row: next(answers)) == 1
    asked = []
    assert pipelines.judge(index, queries, path, query_id="q", ask=lambda row: asked.append(row["doc_id"]) or "s") == 1 and len(asked) == 1  # goes on after the first
    with pytest.raises(ValueError):
        pipelines.judge(index, queries, path, query_id="none")
    # both rankers find nothing for the concept under TF-IDF alone; the pool of BM25F has its expansion
    pool = {(r.query_id, r.doc_id) for r in pipelines.pool(index, queries, 5).collect()}
    assert ("s", "seafood") in pool and M.with_fallback(M.fused_pool([R.ranked(R.named(R.scored_tfidf(index, Q.process(queries)), index))], 5), queries, lambda q: M.fused_pool([R.tfidf(index, Q.process(q))], 5)).filter("query_id = 's'").count() == 1


def test_broken_lines_are_named(spark, tmp_path):
    path = tmp_path / "q.jsonl"
    path.write_text('{"query_id": "a", "text": "x"}\n\n{"query_id": "b", "text": \n')
    with pytest.raises(ValueError, match=r"q\.jsonl:3"):
        files.load_queries(spark, str(path))
    path.write_text('{"query_id": "a", "text": "x"}\n{"query_id": "a", "text": "y"}\n')
    with pytest.raises(ValueError, match="duplicate query_id: a"):
        files.load_queries(spark, str(path))


def test_segmented_index(spark, tmp_path):
    """Queries are cut as the documents were: words joined by the segmenter match whole."""
    cut = lambda text: text.replace("thịt gà", "thịt~gà").replace(" ", "|").replace("~", " ").split("|")
    rows = [{f.name: r.get(f.name, "u" + r["doc_id"] if f.name in ("url", "source") else None) for f in S.RECIPE.fields} for r in RECIPES]
    docs = ingest.with_keys(spark.createDataFrame(rows, S.RECIPE))
    ix = I.build(docs, ingest.tokenized(docs, segmenter=cut), "custom", cut)
    ix.save(str(tmp_path / "ix"))
    with pytest.raises(ValueError):
        I.load(spark, str(tmp_path / "ix"))
    found = R.search(I.load(spark, str(tmp_path / "ix"), cut), "thịt gà").collect()
    assert {r.doc_id for r in found} == {"chicken-grill", "chicken-soup"} and found[0].matched_terms == ["thịt_gà"]
    assert X.load_segmenter() is None or callable(X.load_segmenter())


def test_profile(spark, index):
    d = {r.value: r["count"] for r in C.distribution(index.documents, "categories").collect()}
    assert d == {"Món mặn": 3, "Bữa tối": 1, "Bữa sáng": 1}
    c = {r.field: r for r in C.completeness(index.documents).collect()}
    assert (c["image_url"].missing, c["description"].ratio, c["total_time_minutes"].present) == (3, 1.0, 3) and list(c) == list(C.COMPLETENESS)
    whole = C.profile(index.documents)
    assert whole["document_count"] == 3 and whole["difficulties"][0] == {"value": "Dễ", "count": 2} and whole["categories"][0]["count"] == 3
    audit = pipelines.audit_coverage(index, pipelines.probes_of(spark.createDataFrame([("1", " gà "), ("2", "phở")], "query_id string, text string")))
    assert [(p["query"], p["covered"]) for p in audit["query_probes"]] == [("gà", True), ("phở", False)] and audit["query_probes"][0]["top_results"][0]["matched_terms"] == ["gà"]
    got = C.probe(index, ("gà", "pizza", " gà ")).collect()
    assert [(r.query, r.covered, r.result_count) for r in got] == [("gà", True, 2), ("pizza", False, 0)]


DOM = """<html><head><meta property="og:image" content="http://x/i.jpg"></head><body><h1>Sườn nướng</h1>
<h4>Nguyên liệu</h4><ul><li>1kg sườn<li>Muối</ul><ul><li>muối</li></ul><h4>Sơ chế:</h4><p>Rửa sạch</p><h4>Thực hiện</h4><p>Ướp <b>kỹ</b></p><p>Nướng chín</p><h4>Cách dùng</h4><p>Dùng nóng</p>
<div><span>Khẩu phần</span><span>4 người</span><span>Thời gian thực hiện</span><span>20 phút</span><span>Độ khó</span><span>Dễ</span><span>Lưu ý</span></div>
<h3>Được phát sóng trên</h3><a href="/c">Món nướng</a><h2>Công thức bạn có thể thích</h2><a href="/d">Khác</a></body></html>"""


def test_extract(spark):
    ld = '<script type="application/ld+json">' + json.dumps({"@graph": [{"@type": ["Thing", "Recipe"], "name": "Canh", "recipeIngredient": ["a"], "recipeInstructions": [{"text": "b"}], "prepTime": "PT15M", "cookTime": "PT30M", "recipeCategory": ["Canh", "Món Việt"]}]}) + "</script>"
    bad = '<script type="application/ld+json">{"@type": "Recipe", "name": "x"}</script>' + DOM
    pages = spark.createDataFrame([("http://A.com/1/", DOM), ("http://a.com/2", ld), ("http://a.com/3", bad), ("http://a.com/4", "<p>hi</p>"), ("http://a.com/5", None)], "url string, html string")
    got = {r.url[-1]: r for r in E.extract_recipes(pages).collect()}
    a = got["1"]
    assert a.ingredients == ["1kg sườn", "Muối"] and a.instructions == ["Rửa sạch", "Ướp kỹ", "Nướng chín", "Dùng nóng"]
    assert (a.cook_time_minutes, a.servings, a.difficulty, a.cooking_method, a.categories, a.image_url) == (20, "4 người", "Dễ", "nướng", ["Món nướng"], "http://x/i.jpg")
    assert (got["2"].prep_time_minutes, got["2"].cook_time_minutes, got["2"].categories) == (15, 30, ["Canh", "Món Việt"]) and got["2"].error is None
    assert all(got[k].error for k in "345")
    listing = spark.createDataFrame([("http://a.com/l", '<a href="/r1"><b>Xem</b> chi tiết</a><a href="http://b.org/x">xem chi tiết</a><a href="/r1">XEM CHI TIẾT</a>')], "url string, html string")
    assert [r.link for r in E.detail_links(listing, "a.com").collect()] == ["http://a.com/r1"]


def test_streaming_append(spark, tmp_path, index):
    from quillon.streaming.incremental import append_documents, to_index

    docs = index.documents.select(*[f.name for f in S.RECIPE.fields])
    docs.filter("doc_id = 'seafood'").write.parquet(str(tmp_path / "in"), mode="append")
    go = lambda: append_documents(spark, str(tmp_path / "in"), S.RECIPE, str(tmp_path / "ix"), str(tmp_path / "cp")).awaitTermination()
    go()
    docs.write.parquet(str(tmp_path / "in"), mode="append")
    go()
    # a batch that failed after some of its tables were written is tried again: the checkpoint forgets that it ended
    import shutil

    shutil.rmtree(tmp_path / "ix/stream_documents/batch_id=1")
    for name in ("1", ".1.crc"):
        (tmp_path / "cp/commits" / name).unlink()
    go()
    built = to_index(spark, str(tmp_path / "ix"), str(tmp_path / "whole"))
    assert I.statistics(built).first() == I.statistics(index).first()
    assert [r.doc_id for r in R.search(built, "gà nướng").collect()] == ["chicken-grill", "chicken-soup"]


@pytest.fixture(scope="module")
def passages(spark, tmp_path_factory):
    """Tables where passages of three and more words meet documents in order, apart, in part and repeated."""
    d, r, words = str(tmp_path_factory.mktemp("catalog")), random.Random(11), ["apple", "birch", "cedar", "delta", "ember"]
    asks = [(1, "apple birch cedar"), (2, "delta apple delta birch"), (3, "ember cedar birch apple delta"), (4, "birch birch birch"), (5, "apple missing cedar")]
    texts = ["apple birch cedar", "x\ny\nz apple q birch cedar apple birch cedar", "apple\nbirch\ncedar delta", "ember cedar birch apple delta\ndelta apple delta birch", "birch", ""]
    texts += ["\n".join(" ".join(r.choices(words, k=r.choice([2, 5, 12]))) for _ in range(4)) for _ in range(14)]
    docs = [(i, t, "en", f"src{i % 3}", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(asks, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, docs, asks


def test_whole_passages(spark, passages):
    d, docs, asks = passages
    fields = {}
    for i, t, lang, source, _ in docs:
        lines = t.split("\n")
        made = {"title": lines[0], "description": lines[1] if len(lines) > 1 else "", "ingredients": "", "instructions": " ".join(lines[2:]), "categories": f"{lang} {source}", "cooking_method": lang}
        fields[str(i)] = {f: x.split() for f, x in made.items()}
    average = {f: sum(len(x[f]) for x in fields.values()) / len(docs) for f in fields["0"]}
    scores, evidence, n = {}, set(), len(docs)
    for q, text in asks:
        terms = text.split()
        for i, x in fields.items():
            s = 0.0
            for w in dict.fromkeys(terms):
                df = sum(any(w in ws for ws in y.values()) for y in fields.values())
                ctf = sum(S.TFIDF_WEIGHTS[f] * ws.count(w) / max(1 - S.BM25F_B[f] + S.BM25F_B[f] * (len(ws) / average[f] if average[f] else 1), 1e-9) for f, ws in x.items())
                s += math.log(1 + (n - df + 0.5) / (df + 0.5)) * 2.2 * ctf / (1.2 + ctf) * (1 + math.log(terms.count(w)))
            for f, ws in x.items():
                if all(w in ws for w in terms):
                    exact = sum(ws[k : k + len(terms)] == terms for k in range(len(ws)))
                    at = [[k for k, w in enumerate(ws) if w == t] for t in terms]
                    gap = max(0, min(max(c) - min(c) for c in itertools.product(*at)) - len(terms) + 1)
                    evidence.add((str(q), i, f, exact, gap))
                    s += 2.0 * exact * S.TFIDF_WEIGHTS[f] + S.TFIDF_WEIGHTS[f] / (gap + 1)
            if s:
                scores[str(q), i] = s
    found = catalog.queries()
    assert {tuple(r) for r in found["phrase_evidence"](spark, d).collect()} == evidence
    assert any(e > 0 for *_, e, _ in evidence) and any(g > 0 for *_, g in evidence)
    got = {(r.query_id, r.doc_id): r.score for r in found["bm25f_rank"](spark, d).collect()}
    assert got.keys() == scores.keys() and all(abs(v - scores[k]) < 1e-5 for k, v in got.items())
    assert {(r.query_id, r.doc_id) for r in found["tfidf_rank"](spark, d).collect()} == scores.keys()


def test_snippets_of_a_whole_page(spark, passages):
    d, _, _ = passages
    made = {(r.query_id, r.doc_id): r for r in catalog.queries()["snippet"](spark, d).collect()}
    hits = {(r.query_id, r.doc_id) for r in catalog.queries()["bm25f_rank"](spark, d).collect()}
    assert made.keys() == hits and max(r["rank"] for r in made.values()) >= 10
    assert all(r.field and r.text and r.n_highlights for r in made.values())


def test_import_without_llm():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_batches_are_scored_where_documents_lie(spark, passages, monkeypatch):
    """A batch gives what single lookups give, and its plan moves no rows."""
    d, _, _ = passages
    ix = catalog.stored(spark, d)
    asked = Q.process(catalog.asked(spark, d))
    rows = R.bm25f_scores(ix, R.Asked(ix, asked))  # few terms are looked up
    monkeypatch.setattr(R, "PUSHED_TERMS", 0)
    batch = R.scored_bm25f(ix, asked)
    scanned = R._scanned(ix, R.Asked(ix, asked), "bm25f", S.Bm25f())
    assert "Exchange" not in scanned._jdf.queryExecution().executedPlan().toString()
    want = {(r.query_id, r.doc_id): [r[f] for f in S.FIELDS] for r in rows.withColumns({f: F.col(f) + R.bonus(f, S.Bm25f()) for f in S.FIELDS}).collect()}
    got = {(r.query_id, r.doc_id): r.field_scores for r in batch.collect()}
    assert got.keys() == want.keys()
    for k, scores in want.items():
        assert all((s is None and f not in got[k]) or abs(got[k][f] - s) < 1e-9 for f, s in zip(S.FIELDS, scores))


def test_norms_of_rare_and_frequent_terms(spark, passages, monkeypatch):
    """Terms on both sides of the bound give the norms that all terms on one side give."""
    d, _, _ = passages
    ix = catalog.stored(spark, d)
    norms = lambda: {(r.channel, r.doc_id): r.norm for r in I.doc_norms(ix.postings, ix.term_stats, ix.n).collect()}
    whole = norms()
    monkeypatch.setattr(I, "FREQUENT_TERMS", 3)
    some = norms()
    assert whole.keys() == some.keys() and all(abs(whole[k] - some[k]) < 1e-9 for k in whole)
