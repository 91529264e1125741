"""Language-model scoring: a hashed maximum-entropy model and a smoothed unigram base.

Tokens are words (A-Z lowered) and one end token a text. Training tokens are counted in full. The
FREQUENT most frequent are stored; the HEAD most frequent of these are words of the model, in CLASSES
classes of equal size, the others lie in clusters that are the places of one more class, and all words
beyond share its last place. A token's probability is P(class | context) * P(place | class, context),
both softmaxes over hashed features of the context: the last word, the word before it (a skip), and
the pair. In a cluster words follow their smoothed counts, so the model is a proper distribution over
known words plus one unknown. Classes and clusters hold words with like neighbours: profiles of the
words before and after each stored one are split by their principal direction, again and again.

Training takes every training text once, in ROUNDS synchronous rounds over a part of them each: every
shard starts from the same model and makes mini-batch gradient steps, the shards' models are averaged,
weighted by their tokens, by a distributed sum, and the average starts the next round. The number of
shards follows from the number of tokens alone.

Texts are encoded once, after counting: a stored word is its rank, any other a hash, whose count comes
by a join, so the count table, which grows with the corpus, is never gathered anywhere.

Defined results: a null or empty text is the end token alone; repeated rows get equal scores; a null
id hashes as empty text; without training tokens N = V = 0 and the base counts 0.5 / 0.5; extra
columns are not read; an empty table gives an empty result; whole texts are scored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, held_out, materialize, task, tune
from .words import word_hashes

#: Words that the model predicts one by one, and their classes; the last class is that of all other words.
HEAD, CLASSES = 992, 31
SIZE = HEAD // CLASSES
#: Counts that are broadcast, at most; 16 bytes each.
FREQUENT = 150_000
#: The most frequent words, whose places beside a word make its profile: at most 2 * NEIGHBOURS counts a stored word.
NEIGHBOURS = 24
#: Hashed feature rows: contexts of one word, and of the pair.
WORD_ROWS, PAIR_ROWS = 4096, 16_384
ROWS = 2 * WORD_ROWS + PAIR_ROWS
assert ROWS <= 1 << 16 and SIZE == CLASSES + 1
BATCH = 8192
RATE = 0.6
ROUNDS = 2
#: Float sums are dealt out in so many pieces a model (98 KB each).
PIECES = 64
#: Tokens of one shard of a round: at least, and at most once there are FEW_SHARDS.
SHARD_TOKENS, MOST_TOKENS, FEW_SHARDS = 250_000, 4_000_000, 8
#: The end token; a word has this hash by a chance of 2^-63.
END = 1
_MIX = np.uint64(0x9E3779B97F4A7C15)


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """63-bit hashes of all words and ends, and where each text begins (with the end)."""
    hashes, at = word_hashes(texts)
    n = len(at) - 1
    out = np.full(len(hashes) + n, END, np.int64)
    out[np.arange(len(hashes)) + np.repeat(np.arange(n), np.diff(at))] = (hashes >> np.uint64(1)).view(np.int64)
    return out, at + np.arange(n + 1)


def _sum_by(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1))
    return keys[first], np.add.reduceat(values, first) if len(first) else values


@task
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Token counts of the task's rows."""
    parts: list[np.ndarray] = []
    keys, sums, waiting = np.zeros(0, np.int64), np.zeros(0, np.int64), 0

    def fold() -> None:
        nonlocal keys, sums, parts, waiting
        new, n = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        keys, sums = _sum_by(np.concatenate([keys, new]), np.concatenate([sums, n]))
        parts, waiting = [], 0

    for b in batches:
        parts.append(tokens(column(b, "text"))[0])
        waiting += len(parts[-1])
        if waiting > 1_000_000:
            fold()
            if len(keys) > 3_000_000:  # bounded memory: what was counted goes on
                yield from _emit("token", keys, sums)
                keys, sums = keys[:0], sums[:0]
    fold()
    yield from _emit("token", keys, sums)


def _emit(name: str, keys: np.ndarray, sums: np.ndarray) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(keys), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(keys[k : k + 50_000]), pa.array(sums[k : k + 50_000])], [name, "c"])


class Vocabulary:
    """Stored tokens by falling count; the rank is the place in that order."""

    SLOTS = 1 << 19

    def __init__(self, token: np.ndarray, count: np.ndarray, total: int, distinct: int):
        order = np.lexsort((token, -count))[:FREQUENT]
        self.token, self.count = token[order].astype(np.int64), count[order].astype(np.int64)
        self.total, self.distinct = total, distinct
        # one token a slot, the more frequent one first; what finds another there is searched in the sorted rest
        slot = self.token & (self.SLOTS - 1)
        self.slots = np.full(self.SLOTS, -1, np.int32)
        self.slots[slot[::-1]] = np.arange(len(order), dtype=np.int32)[::-1]
        missed = np.flatnonzero(self.slots[slot] != np.arange(len(order)))
        self.rest = missed[np.argsort(self.token[missed])]

    def codes(self, tok: np.ndarray) -> np.ndarray:
        """Rank of a stored token; -1 - (30 bits of its hash) of any other."""
        out = (-1 - (tok & 0x3FFFFFFF)).astype(np.int32)
        if len(self.token):
            rank = self.slots[tok & (self.SLOTS - 1)]
            hit = (rank >= 0) & (self.token[rank] == tok)
            out[hit] = rank[hit]
            if len(self.rest):
                at = np.flatnonzero(~hit)
                keys = self.token[self.rest]
                place = np.minimum(np.searchsorted(keys, tok[at]), len(keys) - 1)
                found = keys[place] == tok[at]
                out[at[found]] = self.rest[place[found]]
        return out


def _encode(v: Vocabulary):
    @task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            tok, at = tokens(column(b, "text"))
            codes = v.codes(tok)
            body = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer((at * 4).astype(np.int32).tobytes()), pa.py_buffer(codes.tobytes())])
            unknown = codes < 0
            upto = np.concatenate([[0], np.cumsum(unknown)])[at]
            rest = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(tok[unknown], pa.int64()))
            yield pa.RecordBatch.from_arrays([column(b, k) for k in ("doc_id", "_row", "learn", "part")] + [body, rest], ["doc_id", "_row", "learn", "part", "codes", "rest"])

    return run


def _streams(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All codes of a batch, and where its texts start (with the end)."""
    each = [np.frombuffer(x, np.int32) for x in column(b, "codes").to_pylist()]
    return np.concatenate(each), np.concatenate([[0], np.cumsum([len(x) for x in each])])


def _profile(size: int):
    """Counts of (stored word, frequent word before it or after it): the key is rank * 2 * NEIGHBOURS + place."""

    @task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size * 2 * NEIGHBOURS, np.int32)
        for b in batches:
            if not b.num_rows:
                continue
            codes, cut = _streams(b)
            inside = np.ones(len(codes), bool)
            inside[cut[:-1]] = False  # a text's first token follows none
            left, right = codes[:-1], codes[1:]
            near = inside[1:]
            for word, other, shift in ((right, left, 0), (left, right, NEIGHBOURS)):
                some = near & (word >= 0) & (other >= 0) & (other < NEIGHBOURS)
                np.add.at(counts, word[some].astype(np.int64) * (2 * NEIGHBOURS) + shift + other[some], 1)
        keys = np.flatnonzero(counts)
        yield from _emit("key", keys, counts[keys].astype(np.int64))

    return run


def _split(profiles: np.ndarray, weight: np.ndarray, at: np.ndarray, parts: int, whole: bool) -> list[np.ndarray]:
    """Word indices in parts of like weight (of equal number, if whole), each split across the principal direction."""
    if parts == 1 or len(at) <= 1:
        return [at] + [at[:0]] * (parts - 1)
    w = weight[at].astype(float)
    dims = profiles.shape[1]
    mean, second = np.zeros(dims), np.zeros((dims, dims))
    for k in range(0, len(at), 10_000):
        x = profiles[at[k : k + 10_000]].astype(float)
        mean += w[k : k + 10_000] @ x
        second += (x * w[k : k + 10_000, None]).T @ x
    axis = np.linalg.eigh(second - np.outer(mean, mean) / w.sum())[1][:, -1]
    axis = axis * (np.sign(axis[np.abs(axis).argmax()]) or 1.0)  # a fixed sign, so that reruns agree
    order = at[np.argsort((profiles @ axis.astype(np.float32))[at], kind="stable")]
    half = parts // 2
    if whole:
        cut = half * (len(at) // parts)
    else:
        cut = int(np.searchsorted(np.cumsum(weight[order]), weight[order].sum() * half / parts))
    return _split(profiles, weight, order[:cut], half, whole) + _split(profiles, weight, order[cut:], parts - half, whole)


class Model:
    """Weights: a row a hashed feature; the columns are the classes, then the places in a class."""

    def __init__(self, v: Vocabulary, profile: np.ndarray | None = None):
        n, k = len(v.token), min(HEAD, len(v.token))
        x = np.zeros((n, 2 * NEIGHBOURS), np.float32) if profile is None else np.sqrt(profile / np.maximum(1, v.count)[:, None]).astype(np.float32)
        self.cls, self.place = np.full(n + 1, CLASSES, np.int8), np.full(n + 1, SIZE - 1, np.int8)  # the last entry: any word not stored
        # head words that there are not hold places of their own
        padded = np.concatenate([x[:k], np.zeros((HEAD - k, 2 * NEIGHBOURS), np.float32)])
        groups = _split(padded, np.ones(HEAD), np.arange(HEAD), CLASSES, True)
        mass = np.zeros((CLASSES + 1, SIZE))
        for c, words in enumerate(groups):
            for p, r in enumerate(words):
                if r < k:
                    self.cls[r], self.place[r] = c, p
                    mass[c, p] = v.count[r]
        clusters = _split(x, v.count, np.arange(k, n), SIZE - 1, False) if n > k else []
        #: log10 of a stored word's share of its cluster; 0 for head words.
        self.own = np.zeros(n + 1)
        for p, words in enumerate(clusters):
            self.place[words] = p
            mass[CLASSES, p] = (v.count[words] + 0.5).sum()
            self.own[words] = np.log10((v.count[words] + 0.5) / max(mass[CLASSES, p], 0.5))
        mass[CLASSES, -1] = (v.total - int(v.count.sum())) + 0.5 * (v.distinct - n + 1)
        self.own[n] = -math.log10(mass[CLASSES, -1])  # its own count may come later
        floor = math.log10(v.total + 0.5 * (v.distinct + 1))
        self.base = np.append(np.log10(v.count + 0.5), 0.0) - floor
        with np.errstate(divide="ignore"):
            cls, place = np.log(mass.sum(1) / mass.sum()), np.log(mass / np.maximum(mass.sum(1), 1e-9)[:, None])
        self.bias = np.maximum(np.concatenate([np.tile(cls, (CLASSES + 1, 1)), place], 1), -50.0).astype(np.float32)
        self.table = np.zeros((ROWS, CLASSES + 1 + SIZE), np.float32)

    def contexts(self, codes: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Three feature rows for each token; start marks a text's first token."""
        half = WORD_ROWS // 2
        spread = (codes.astype(np.int64).view(np.uint64) * _MIX) >> np.uint64(32)
        one = np.where((codes >= 0) & (codes < half), codes, half + (spread % np.uint64(half - 1)).astype(np.int64))
        one = np.roll(one, 1)
        one[start] = WORD_ROWS - 1
        two = np.roll(one, 1)
        two[start] = WORD_ROWS - 1
        pair = ((one.astype(np.uint64) * np.uint64(WORD_ROWS) + two.astype(np.uint64)) * _MIX) >> np.uint64(64 - PAIR_ROWS.bit_length() + 1)
        return np.stack([one, WORD_ROWS + two, 2 * WORD_ROWS + pair.astype(np.int64)])

    def _parts(self, codes: np.ndarray, ctx: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Class and place of each token, and the probabilities (tokens x 64): of the classes, and of the places in its class."""
        at = np.where(codes < 0, len(self.cls) - 1, codes)
        c, p = self.cls[at].astype(np.int64), self.place[at].astype(np.int64)
        x = np.take(self.bias, c, axis=0)
        for k in range(3):
            x += np.take(self.table, ctx[k], axis=0)
        x = x.reshape(-1, SIZE)
        np.minimum(x, 60.0, out=x)  # a sum of 32 such terms is still a float
        np.exp(x, out=x)
        x /= (x @ np.ones(SIZE, np.float32))[:, None]
        return c, p, x.reshape(len(codes), -1)

    def learn(self, codes: np.ndarray, ctx: np.ndarray) -> None:
        c, p, x = self._parts(codes, ctx)
        rows = np.arange(len(codes))
        x[rows, c] -= 1
        x[rows, SIZE + p] -= 1
        for k in range(3):
            self._descend(ctx[k], x)

    def _descend(self, rows: np.ndarray, grad: np.ndarray) -> None:
        """A step on each row by its mean gradient, so that frequent rows move no further than rare ones."""
        order = np.argsort(rows.astype(np.uint16), kind="stable")  # a radix sort
        rows = rows[order]
        first = np.flatnonzero(np.diff(rows, prepend=-1))
        n = np.diff(np.append(first, len(rows)))
        total, many = np.take(grad, order[first], axis=0), n > 1
        if many.any():
            starts = np.cumsum(n[many]) - n[many]
            total[many] = np.add.reduceat(np.take(grad, order[np.repeat(many, n)], axis=0), starts, axis=0)
        total *= (RATE / np.sqrt(n + 8.0) / 3)[:, None].astype(np.float32)
        self.table[rows[first]] -= total

    def log10(self, codes: np.ndarray, ctx: np.ndarray) -> np.ndarray:
        """log10 of each token's probability; of a word not stored without its own count, which may come later."""
        c, p, x = self._parts(codes, ctx)
        rows = np.arange(len(codes))
        at = np.where(codes < 0, len(self.cls) - 1, codes)
        return np.log10(np.maximum(x[rows, c], 1e-30)).astype(np.float64) + np.log10(np.maximum(x[rows, SIZE + p], 1e-30)) + self.own[at]


def _starts(n: int, cut: np.ndarray) -> np.ndarray:
    start = np.zeros(n, bool)
    start[cut[:-1]] = True
    return start


def _train(model: Model):
    @task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, n, shard = model, 0, TaskContext.get().partitionId()
        m.table = m.table.copy()
        for b in batches:
            if not b.num_rows:
                continue
            codes, cut = _streams(b)
            ctx = m.contexts(codes, _starts(len(codes), cut))
            for k in range(0, len(codes), BATCH):
                m.learn(codes[k : k + BATCH], ctx[:, k : k + BATCH])
            n += len(codes)
        if n:
            for k, piece in enumerate(np.array_split(m.table.ravel().astype(np.float64) * n, PIECES)):
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([k], pa.int32()), pa.array([n], pa.int64()), pa.array([piece.astype(np.float32).tobytes()], pa.binary())], ["shard", "piece", "n", "w"])

    return run


def _add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum of one piece over some shards."""
    total, n = None, 0
    for b in batches:
        for w, k in zip(column(b, "w").to_pylist(), column(b, "n").to_pylist()):
            x = np.frombuffer(w, np.float32).astype(np.float64)
            total, n = x if total is None else total + x, n + k
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([n], pa.int64()), pa.array([total.astype(np.float32).tobytes()], pa.binary())], ["piece", "n", "w"])


def train(encoded: DataFrame, model: Model, total: int) -> Model:
    """The rounds: sums by piece go in two levels, each of some square root of the shards."""
    schema = "piece int, n long, w binary"
    for k in range(ROUNDS):
        shards = max(1, min(total // ROUNDS // SHARD_TOKENS, FEW_SHARDS + total // ROUNDS // MOST_TOKENS))
        rows = encoded.filter(F.col("learn") & (F.col("part") == k)).select("codes").coalesce(shards)
        parts = materialize(rows.mapInArrow(_train(model), f"shard int, {schema}"), "lm-models")
        shares = math.isqrt(shards) + 1
        some = parts.withColumn("some", F.pmod("shard", F.lit(shares))).groupBy("piece", "some").applyInArrow(_add, schema)
        got = some.groupBy("piece").applyInArrow(_add, schema).orderBy("piece").collect()
        if got:
            model.table = np.concatenate([np.frombuffer(r.w, np.float32).astype(np.float64) / max(1, r.n) for r in got]).reshape(model.table.shape).astype(np.float32)
    return model


def vocabulary(counts: DataFrame) -> Vocabulary:
    """counts: (token, c), a row a distinct training token."""
    s = counts.agg(F.count("*").alias("v"), F.coalesce(F.sum("c"), F.lit(0)).alias("n")).first()
    top = counts.orderBy(F.desc("c"), "token").limit(FREQUENT).toArrow()
    return Vocabulary(top.column("token").to_numpy(), top.column("c").to_numpy(), s.n, s.v)


def profiles(encoded: DataFrame, v: Vocabulary) -> np.ndarray:
    """Neighbours of each stored word over all training texts: at most FREQUENT * 2 * NEIGHBOURS counts."""
    out = np.zeros(len(v.token) * 2 * NEIGHBOURS, np.float32)
    got = encoded.filter("learn").select("codes").mapInArrow(_profile(len(v.token)), "key long, c long").groupBy("key").agg(F.sum("c").alias("c"))
    for b in got.select(F.col("key").cast("int"), F.col("c").cast("float")).toArrow().to_batches():
        out[b.column(0).to_numpy()] = b.column(1).to_numpy()
    return out.reshape(-1, 2 * NEIGHBOURS)


def _score(model: Model):
    @task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            codes, cut = _streams(b)
            ctx = model.contexts(codes, _starts(len(codes), cut))
            lm = np.concatenate([model.log10(codes[k : k + BATCH], ctx[:, k : k + BATCH]) for k in range(0, len(codes), BATCH)])
            base = model.base[np.where(codes < 0, len(model.base) - 1, codes)]
            sums = [np.add.reduceat(x, cut[:-1]) for x in ((codes >= 0).astype(np.int64), base, lm)]
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), column(b, "_row"), pa.array(np.diff(cut), pa.int64()), *map(pa.array, sums)], ["doc_id", "_row", "n_tokens", "n_stored", "base", "lm"])

    return run


def fit(docs: DataFrame, remainder: int = 1) -> tuple[Model, DataFrame, DataFrame, int]:
    """The model, the encoded texts, the counts and the number of training tokens."""
    tune(docs.sparkSession)
    read = docs.select("doc_id", "text").withColumns({"learn": ~held_out(F.col("doc_id"), remainder), "part": F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(ROUNDS)).cast("int")})
    counts = materialize(read.filter("learn").select("text").mapInArrow(_count, "token long, c long").groupBy("token").agg(F.sum("c").alias("c")), "lm-counts")
    v = vocabulary(counts)
    schema = "doc_id long, _row long, learn boolean, part int, codes binary, rest array<long>"
    encoded = materialize(read.withColumn("_row", F.monotonically_increasing_id()).mapInArrow(_encode(v), schema), "lm-codes")
    model = train(encoded, Model(v, profiles(encoded, v)), v.total)
    return model, encoded, counts, v.total


def score_encoded(model: Model, encoded: DataFrame, counts: DataFrame, total: int, remainder: int = 1) -> DataFrame:
    scored = encoded.select("doc_id", "_row", "codes").mapInArrow(_score(model), "doc_id long, _row long, n_tokens long, n_stored long, base double, lm double")
    # words not stored: their counts come by a join on the hash, and go back summed by row
    rare = encoded.select("_row", F.explode("rest").alias("token"))
    found = rare.join(counts, "token").groupBy("_row").agg(F.sum(F.log10(F.col("c") + 0.5)).alias("gain"), F.count("*").alias("known"))
    unknown = F.col("n_tokens") - F.col("n_stored") - F.coalesce("known", F.lit(0))
    gain = F.coalesce("gain", F.lit(0.0)) + unknown * math.log10(0.5)
    return scored.join(found, "_row", "left").select(
        "doc_id", held_out(F.col("doc_id"), remainder).alias("held_out"), "n_tokens", (F.col("n_stored") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + gain).alias("base_score"), (F.col("lm") + gain).alias("score"),
    )


def score(docs: DataFrame, remainder: int = 1) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    return score_encoded(*fit(docs, remainder), remainder)
