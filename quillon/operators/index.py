"""Field-aware positional inverted index as tables.

Two tables hold what documents say. A row of `forward` is a document: its fields' tokens, their lengths, its
norms and its place in the order that breaks ties; batches of queries are scored from it, a document at a time.
A row of `postings` is a term in a block of documents: its list of occurrences by document and field, with
positions; single queries and lookups read only their terms' lists. Both are made where the document lies, so
occurrences are never shuffled.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.text import accent_map
from ..storage import scratch, shared_dir, short_batches, small

#: A block of documents ends with the batch in which it reaches so many tokens.
BLOCK_TOKENS = 2_000_000
#: Rows of one Arrow batch of posting lists.
BATCH_LISTS = 20_000
#: Terms whose frequencies are sent to every task when norms are made: the most frequent ones, at most so many.
FREQUENT_TERMS = 300_000

#: A term in a block of documents: df documents, cf occurrences, then an entry for each document and field that holds it.
LISTS = "channel string, term string, df int, cf int, doc_id array<string>, field array<int>, tf array<int>, len array<int>, positions array<array<int>>"
#: The same without entries.
COUNTS = "channel string, term string, df int, cf int"
#: A term in a document: occurrences in all fields, then each field's own.
WIDE = ", ".join(["channel string, doc_id string, term string, tf int", *(f"{f}_tf int, {f}_len int, {f}_pos array<int>" for f in S.FIELDS)])
_WIDE_NAMES = [c.split()[0] for c in WIDE.split(", ")]


def field_order(name: Column) -> Column:
    return F.array_position(F.array(*[F.lit(f) for f in S.FIELDS]), name)


def fold_words(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Codes of the accent-less form of each word, and the forms."""
    table, seen = accent_map(), {}
    codes = [seen.setdefault(w if w.isascii() else w.translate(table), len(seen)) for w in words.to_pylist()]
    return np.asarray(codes, np.int64), pa.array(list(seen), pa.string())


def word_streams(batch: pa.RecordBatch) -> tuple[np.ndarray, pa.DictionaryArray]:
    """Lengths of the fields of a batch of forward rows (field, row), and the words of all, by field, then row."""
    lens, flat = [], []
    for f in S.FIELDS:
        lists = pc.split_pattern(pc.fill_null(batch.column(batch.schema.get_field_index(f)), ""), " ")
        n, words = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten()
        kept = pc.not_equal(words, "")  # an empty field splits into one empty word
        blank = ~kept.to_numpy(zero_copy_only=False)
        if blank.any():
            np.subtract.at(n, np.repeat(np.arange(len(n)), n)[blank], 1)
            words = words.filter(kept)
        lens.append(n)
        flat.append(words)
    return np.stack(lens), pa.concat_arrays(flat).dictionary_encode()


def places_of(lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Field, row and position of every word of such a stream."""
    n = lens.ravel()
    fld, row = (np.repeat(x.ravel(), n) for x in np.indices(lens.shape))
    return fld, row, np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


def _list_rows(channel: str, ids: pa.Array, lens: np.ndarray, fld: np.ndarray, row: np.ndarray, pos: np.ndarray, code: np.ndarray, words: pa.Array, full: bool) -> pa.RecordBatch:
    """A channel's posting lists of a block, in order of the terms."""
    place = np.empty(len(words), np.int64)
    by_name = pc.sort_indices(words).to_numpy()
    place[by_name] = np.arange(len(words))
    k = len(S.FIELDS)
    key = (place[code] * lens.shape[1] + row) * k + fld
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))  # of each entry
    tf = np.diff(np.append(first, len(key)))
    held, at = np.divmod(key[first], k)
    term, doc = np.divmod(held, lens.shape[1])
    start = np.flatnonzero(np.diff(term, prepend=-1))  # of each term's entries
    cf = np.add.reduceat(tf, start)
    df = np.add.reduceat((np.diff(held, prepend=-1) != 0).astype(np.int64), start)
    columns = [pa.array([channel]).take(pa.array(np.zeros(len(start), np.int32))), words.take(pa.array(by_name[term[start]])), pa.array(df, pa.int32()), pa.array(cf, pa.int32())]
    if full:
        upto = pa.array(np.append(start, len(first)), pa.int32())
        lists = lambda values: pa.ListArray.from_arrays(upto, values)
        inner = pa.ListArray.from_arrays(pa.array(np.append(first, len(key)), pa.int32()), pa.array(pos[order], pa.int32()))
        columns += [lists(ids.take(pa.array(doc))), *(lists(pa.array(x, pa.int32())) for x in (at, tf, lens[at, doc])), lists(inner)]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in (LISTS if full else COUNTS).split(", ")])


def _lists(full: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def block(parts: list[tuple[pa.Array, np.ndarray, pa.DictionaryArray]]) -> Iterator[pa.RecordBatch]:
        ids = pa.concat_arrays([p[0] for p in parts])
        lens = np.concatenate([p[1] for p in parts], axis=1)
        begin, places, codes = 0, [], []
        merged = pa.chunked_array([p[2] for p in parts]).unify_dictionaries()
        for (own, n, _), chunk in zip(parts, merged.chunks):
            fld, row, pos = places_of(n)
            places.append((fld, row + begin, pos))
            codes.append(chunk.indices.to_numpy(zero_copy_only=False).astype(np.int64))
            begin += len(own)
        fld, row, pos = (np.concatenate(x) for x in zip(*places))
        code, words = np.concatenate(codes), merged.chunk(0).dictionary
        if len(code):
            folded, forms = fold_words(words)
            for channel, c, w in (("normalized", code, words), ("accentless", folded[code], forms)):
                made = _list_rows(channel, ids, lens, fld, row, pos, c, w, full)
                yield from (made.slice(i, BATCH_LISTS) for i in range(0, made.num_rows, BATCH_LISTS))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for b in batches:
            lens, words = word_streams(b)
            parts.append((b.column(b.schema.get_field_index("doc_id")), lens, words))
            size += len(words)
            if size >= BLOCK_TOKENS:
                yield from block(parts)
                parts, size = [], 0
        if parts:
            yield from block(parts)

    return post


def joined_tokens(tokens: DataFrame) -> DataFrame:
    """Token lists as texts parted by blanks, which no token holds; other columns as they are."""
    kinds = dict(tokens.dtypes)
    return tokens.withColumns({f: F.array_join(f, " ") for f in S.FIELDS if kinds[f].startswith("array")})


def postings(tokens: DataFrame) -> DataFrame:
    """Rows of LISTS from a row a document (see ingest.tokenized and ingest.streams), made block by block without a shuffle."""
    short_batches(tokens.sparkSession)
    return joined_tokens(tokens).select("doc_id", *S.FIELDS).mapInArrow(_lists(True), LISTS)


def counts(tokens: DataFrame) -> DataFrame:
    """Rows of COUNTS: what term_stats reads of the postings, for who needs no more."""
    short_batches(tokens.sparkSession)
    return joined_tokens(tokens).select("doc_id", *S.FIELDS).mapInArrow(_lists(False), COUNTS)


def by_field(post: DataFrame) -> DataFrame:
    """(channel, term, field, doc_id, tf, positions, len): a row a document and field that holds the term."""
    rows = post.select("channel", "term", F.inline(F.arrays_zip("doc_id", "field", "tf", "positions", "len")))
    return rows.withColumn("field", F.get(F.array(*[F.lit(f) for f in S.FIELDS]), F.col("field"))).select("channel", "term", "field", "doc_id", "tf", "positions", "len")


def _widen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for start in range(0, whole.num_rows, 64):
            b = whole.slice(start, 64)
            get = lambda name: b.column(b.schema.get_field_index(name))  # noqa: E731, B023
            n = get("doc_id").value_lengths().to_numpy(zero_copy_only=False)
            ids, at, tf, length, positions = (get(x).flatten() for x in ("doc_id", "field", "tf", "len", "positions"))
            ids_code = ids.dictionary_encode()
            of = np.repeat(np.arange(b.num_rows), n)
            held = of * max(1, len(ids_code.dictionary)) + ids_code.indices.to_numpy(zero_copy_only=False)
            new = np.flatnonzero(np.diff(held, prepend=-1))  # a document's entries lie together
            group = np.cumsum(np.diff(held, prepend=-1) != 0) - 1
            fld, many = at.to_numpy(), tf.to_numpy()
            rows = pa.array(of[new])
            columns = [get("channel").take(rows), ids.take(pa.array(new)), get("term").take(rows), pa.array(np.bincount(group, many, len(new)).astype(np.int32))]
            for k in range(len(S.FIELDS)):
                where = np.full(len(new), -1, np.int64)
                where[group[fld == k]] = np.flatnonzero(fld == k)
                take = pa.array(where, mask=where < 0)
                columns += [tf.take(take), length.take(take), positions.take(take)]
            yield pa.RecordBatch.from_arrays(columns, names=_WIDE_NAMES)


def wide(post: DataFrame) -> DataFrame:
    """Rows of WIDE of posting lists that have been chosen before."""
    short_batches(post.sparkSession)
    return post.select("channel", "term", "doc_id", "field", "tf", "len", "positions").mapInArrow(_widen, WIDE)


def _length(tokens: DataFrame, f: str) -> Column:
    """Tokens of a field: of a list, or of a text that blanks part."""
    listed = dict(tokens.dtypes)[f].startswith("array")
    return F.size(f) if listed else F.when(F.col(f) == "", 0).otherwise(F.length(f) - F.length(F.replace(f, F.lit(" "), F.lit(""))) + 1)


def field_lengths(tokens: DataFrame) -> DataFrame:
    """(doc_id, field, len) of the normalised stream; every field of every document."""
    return tokens.select("doc_id", F.inline(F.array(*[F.struct(F.lit(f).alias("field"), (F.col(f"{f}_len") if f"{f}_len" in tokens.columns else _length(tokens, f)).alias("len")) for f in S.FIELDS])))


def term_stats(post: DataFrame) -> DataFrame:
    """(channel, term, df, cf): documents and occurrences, summed by blocks already."""
    return post.groupBy("channel", "term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def idf_tfidf(n: int | Column) -> Column:
    n = F.lit(n) if isinstance(n, int) else n
    return F.log((n + 1) / (F.col("df") + 1)) + 1


def idf_bm25(n: int | Column) -> Column:
    n = F.lit(n) if isinstance(n, int) else n
    return F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))


def _frequent(stats: DataFrame) -> int:
    """The least df of the terms that are sent to every task: FREQUENT_TERMS of them at most."""
    power = F.floor(F.log2("df")).cast("int")
    seen, total = {r.p: r.n for r in stats.groupBy(power.alias("p")).agg(F.count("*").alias("n")).collect()}, 0
    for p in sorted(seen, reverse=True):
        total += seen[p]
        if total > FREQUENT_TERMS:
            return 2 ** (p + 1)
    return 1


def doc_norms(post: DataFrame, stats: DataFrame, n: int) -> DataFrame:
    """(channel, doc_id, norm): length of a document's TF-IDF vector over terms and fields.

    The lists of frequent terms, which are most entries, meet their frequencies where they lie; only those of rare terms are shuffled.
    """
    least = _frequent(stats)
    rows, stats = post.select("channel", "term", "doc_id", "tf"), stats.select("channel", "term", "df")
    often = F.broadcast(stats.filter(F.col("df") >= least))  # FREQUENT_TERMS at most
    found = rows.join(often, ["channel", "term"])
    if least > 1:
        # a list as long as that is a frequent term's
        rare = rows.filter(F.size("doc_id") < least * len(S.FIELDS)).join(often, ["channel", "term"], "left_anti")
        found = found.unionByName(rare.join(stats.filter(F.col("df") < least), ["channel", "term"]))
    entries = found.select("channel", (idf_tfidf(n) * idf_tfidf(n)).alias("_w"), F.inline(F.arrays_zip("doc_id", "tf")))
    log = 1 + F.log("tf")
    return entries.groupBy("channel", "doc_id").agg(F.sqrt(F.sum(F.col("_w") * log * log)).alias("norm"))


def average_lengths(lengths: DataFrame, n: int) -> DataFrame:
    return lengths.groupBy("field").agg((F.sum("len") / F.lit(max(1, n))).alias("avg_len"))


#: Document columns that forward rows keep, under these names: what filters read and facets count.
KEPT = {c: c for c in ("total_time_minutes", "cook_time_minutes", "difficulty_fold", "method_fold", "categories_fold", "ingredients_fold")} | {f"doc_{c}": c for c in ("categories", "difficulty", "cooking_method")}


@dataclass
class Index:
    """The tables of one index. documents keeps the source columns and the folded filter columns; forward has (doc_id, ord,
    the columns of KEPT, the norms by channel, and of every field its tokens and length)."""

    documents: DataFrame
    postings: DataFrame
    forward: DataFrame
    term_stats: DataFrame
    n: int
    tokenizer: str = "basic"
    segmenter: object = None
    _averages: dict[str, float] = field(default_factory=dict)

    @property
    def field_lengths(self) -> DataFrame:
        return field_lengths(self.forward)

    @property
    def doc_norms(self) -> DataFrame:
        """(channel, doc_id, norm) of documents with a term."""
        each = F.array(*[F.struct(F.lit(c).alias("channel"), F.col(f"norm_{c}").alias("norm")) for c in S.CHANNELS])
        return self.forward.select("doc_id", F.inline(each)).filter("norm is not null").select("channel", "doc_id", "norm")

    def averages(self) -> dict[str, float]:
        """Average length by field: one row a field."""
        if not self._averages:
            sums = self.forward.agg(*[F.sum(f"{f}_len").alias(f) for f in S.FIELDS]).first()
            self._averages.update({f: (sums[f] or 0) / max(1, self.n) for f in S.FIELDS})
        return self._averages

    def save(self, path: str) -> None:
        """Parquet tables. Postings stay dealt by document, so that no term, however frequent, fills a file or a task;
        a block's lists are sorted by term, so that a term's pages are found by their statistics."""
        for name in ("documents", "postings", "forward", "term_stats"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")
        _describe(self.documents.sparkSession, path, self.tokenizer, self.n)


def _describe(spark: SparkSession, path: str, tokenizer: str, n: int) -> None:
    meta = spark.createDataFrame([(S.INDEX_VERSION, list(S.FIELDS), tokenizer, n)], "format_version int, indexed_fields array<string>, tokenizer string, n long")
    meta.coalesce(1).write.mode("overwrite").parquet(f"{path}/index_meta")


def store(docs: DataFrame, tokens: DataFrame, post: DataFrame, path: str, tokenizer: str = "basic", segmenter=None) -> Index:
    """The index of stored documents and tokens and of their postings, each table written once and read back from there."""
    spark = docs.sparkSession

    def kept(name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        return spark.read.schema(df.schema).parquet(f"{path}/{name}")

    n = docs.count()
    post = kept("postings", post)
    stats = kept("term_stats", term_stats(post))
    order = docs.orderBy("title", "doc_id").select("doc_id", F.monotonically_increasing_id().alias("ord"), *[F.col(c).alias(k) for k, c in KEPT.items()])
    norms = doc_norms(post, stats, n).groupBy("doc_id").agg(*[F.max(F.when(F.col("channel") == c, F.col("norm"))).alias(f"norm_{c}") for c in S.CHANNELS])
    places = scratch(order.join(norms, "doc_id", "left"), "index-places")
    rows = joined_tokens(tokens)
    forward = rows.withColumns({f"{f}_len": _length(rows, f) for f in S.FIELDS}).join(small(places, 5 * n), "doc_id")
    forward = kept("forward", forward.select("doc_id", "ord", *KEPT, *[f"norm_{c}" for c in S.CHANNELS], *[f"{f}_len" for f in S.FIELDS], *S.FIELDS))
    docs = kept("documents", docs)
    _describe(spark, path, tokenizer, n)
    return Index(docs, post, forward, stats, n, tokenizer, segmenter)


def build(docs: DataFrame, tokens: DataFrame, tokenizer: str = "basic", segmenter=None, path: str | None = None) -> Index:
    """Index tables of documents and their tokens, a row a document, saved at path (else in the session's folder). A repeated
    doc_id is an error."""
    if docs.groupBy("doc_id").count().filter("count > 1").limit(1).count():
        raise ValueError("duplicate document id")
    return store(docs, tokens, postings(tokens), path or f"{shared_dir(docs.sparkSession)}/index-{uuid.uuid4().hex}", tokenizer, segmenter)


def load(spark: SparkSession, path: str, segmenter=None) -> Index:
    """A saved index. One built with a segmenter asks for it again, so that queries are cut as the documents were."""
    meta = spark.read.parquet(f"{path}/index_meta").first()
    if meta.format_version != S.INDEX_VERSION:
        raise ValueError(f"unsupported index version {meta.format_version}")
    if tuple(meta.indexed_fields) != S.FIELDS:
        raise ValueError("indexed fields differ")
    if (meta.tokenizer != "basic") != (segmenter is not None):
        raise ValueError(f"the index was built with the {meta.tokenizer} tokenizer")
    read = lambda t: spark.read.parquet(f"{path}/{t}")
    return Index(read("documents"), read("postings"), read("forward"), read("term_stats"), meta.n, meta.tokenizer, segmenter)


def _channel(channel: str) -> str:
    if channel not in S.CHANNELS:
        raise ValueError(f"unknown channel {channel!r}")
    return channel


def terms(index: Index, channel: str = "normalized") -> DataFrame:
    return index.term_stats.filter(F.col("channel") == _channel(channel)).select("term").orderBy("term")


def get_postings(index: Index, term: str, field: str | None = None, channel: str = "normalized") -> DataFrame:
    if field is not None and field not in S.FIELDS:
        raise ValueError(f"unknown field {field!r}")
    rows = by_field(index.postings.filter((F.col("channel") == _channel(channel)) & (F.col("term") == term)))
    rows = rows if field is None else rows.filter(F.col("field") == field)
    return rows.select("doc_id", "field", "tf", "positions").orderBy(field_order(F.col("field")), "doc_id")


def document_frequency(index: Index, term: str, field: str | None = None, channel: str = "normalized") -> int:
    return get_postings(index, term, field, channel).agg(F.countDistinct("doc_id")).first()[0]


def collection_frequency(index: Index, term: str, field: str | None = None, channel: str = "normalized") -> int:
    return get_postings(index, term, field, channel).agg(F.coalesce(F.sum("tf"), F.lit(0))).first()[0]


def statistics(index: Index) -> DataFrame:
    """One row: documents, vocabularies by channel, postings by field of both channels, tokens of one."""
    of = lambda c: F.count_if(F.col("channel") == c)
    vocab = index.term_stats.agg(of("normalized").alias("normalized_vocabulary"), of("accentless").alias("accentless_vocabulary"))
    posts = index.postings.agg(F.coalesce(F.sum(F.size("tf")), F.lit(0)).alias("posting_count"))
    tokens = index.forward.agg(F.coalesce(F.sum(sum(F.col(f"{f}_len") for f in S.FIELDS)), F.lit(0)).alias("token_count"))
    out = vocab.withColumns({"document_count": F.lit(index.n).cast("long"), "_one": F.lit(1)})
    for t in (posts, tokens):
        out = out.join(t.withColumn("_one", F.lit(1)), "_one")
    return out.select("document_count", "normalized_vocabulary", "accentless_vocabulary", "posting_count", "token_count")
