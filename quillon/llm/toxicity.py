"""Toxicity by a linear-chain conditional random field over words.

Every word has a hidden tag, clean or toxic. Its emission sums hashed features: the word, its prefixes
and suffix, its shape, and the words before and after it. Labels are of documents: in a clean one all
words are labelled clean, a toxic one holds at least one toxic word (but for MISLABELLED of them),
which one is for the field to find. Training ascends the likelihood of this: forward-backward marginals give each word's
probability of the toxic tag, in toxic documents given that some word has it, and the two differ by
the labels that the next step learns (expectation and maximisation in one). Gradients are summed over
shards of the sample, all of whose texts take part whole.

A logistic function of the largest marginal, the expected number of toxic words and the text's length,
fitted on a part of the sample that the field was not fitted to, is the document's score. Runs of words with
marginals above one half are the offending spans, in code points.

Forward-backward is exact whatever a text's length: two tags make 2 x 2 matrices, whose products over
blocks of a batch are scanned, so that all blocks go on at once.

Bounds: at most TOXIC_ROWS and CLEAN_ROWS labelled rows (those of smallest crc32). Features are rows of
hashed tables of a fixed size. Every word of every document is tagged.

Defined results: a null or empty text has no words and no span and gets the lowest score; labels
without a document are not used; several labels of one id, or of one text, count as toxic if one is;
without both classes every score is the share of toxic labels; repeated rows get equal scores; a null
id is scored like any other; extra columns are not read; an empty table gives an empty result; a very
long text is tagged whole and takes some 150 bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest as _digest

from .common import column, held_out, materialize, task, tune
from .words import NOT_WORD, Words, mix

TOXIC_ROWS = 2000
CLEAN_ROWS = 4000
#: Texts of the sample are dealt to so many shards.
SHARDS = 8
#: Hashed rows of a word's own features, and of its neighbours'.
OWN, NEAR = 1 << 17, 1 << 14
PREFIXES, SUFFIX = (4, 5, 6), 3
PER_WORD = 3 + len(PREFIXES)
#: Documents of the sample that must hold a feature for it to take part.
LEAST_DOCS = 3
STEPS, RATE, CAUTION, PENALTY = 20, 1.0, 4.0, 0.05
START_BIAS = -8.0
#: Part of the features' log-odds with which they start.
TRUST = 0.5
#: Share of documents without a toxic word that are labelled toxic all the same.
MISLABELLED = 0.02
CACHE_WORDS = 250_000
#: Words tagged at once; a longer text goes alone.
STREAM = 1 << 18


def features(word: bytes) -> tuple[int, ...]:
    """Rows of a word's own features: itself, prefixes, suffix, shape. Each kind has a seed of its own."""
    n = len(word)
    if word.isascii():
        cuts = [word[:k] for k in PREFIXES]
        tail = word[-SUFFIX:]
    else:
        text = word.decode("utf-8", "replace")
        n = len(text)
        cuts = [text[:k].encode() for k in PREFIXES]
        tail = text[-SUFFIX:].encode()
    shape = b"%d%d%d" % (min(n, 12), word.isalpha(), word.isascii())
    # a word shorter than a prefix has one of its own, apart from longer words that begin with it
    heads = [_digest(c, 2 + i if n >= k else 12 + i) % OWN for i, (c, k) in enumerate(zip(cuts, PREFIXES))]
    return _digest(word, 1) % OWN, *heads, _digest(tail, 10) % OWN, _digest(shape, 11) % OWN


class Field:
    """Two-tag chain. Emissions score the toxic tag over the clean one, move[i][j] scores tag i then j."""

    def __init__(self):
        self.own, self.prev, self.next = np.zeros(OWN), np.zeros(NEAR), np.zeros(NEAR)
        self.bias, self.move = START_BIAS, np.zeros((2, 2))
        self.calibration = np.array([0.0, 1.0, 0.0, 0.0])

    def marginals(self, e: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of a stream of chains (starts: where each begins): toxic marginals, expected moves at each word from the one
        before (words x 4: 00, 01, 10, 11; 0 at a start), and each word's log-probability of clean after a clean one."""
        n = len(e)
        length = max(16, int(np.sqrt(n / 2)))
        rows = -(-n // length)
        first = np.zeros(rows * length, bool)
        first[starts] = True
        first[n:] = True
        toxic = np.ones(rows * length)
        toxic[:n] = np.exp(np.clip(e, -30, 30))
        t = np.exp(self.move)
        # the step into each word, as a matrix from the tag before; a chain's start forgets it
        step = [np.ascontiguousarray(np.where(first, 1.0, t[i, j]).reshape(rows, length).T) * (toxic.reshape(rows, length).T if j else 1.0) for i in (0, 1) for j in (0, 1)]
        m = [np.ones(rows), np.zeros(rows), np.zeros(rows), np.ones(rows)]
        for k in range(length):
            a, b, c, d = (s[k] for s in step)
            m = [m[0] * a + m[1] * c, m[0] * b + m[1] * d, m[2] * a + m[3] * c, m[2] * b + m[3] * d]
            scale = 1.0 / (m[0] + m[1] + m[2] + m[3])
            m = [x * scale for x in m]
        into, back = np.zeros((2, rows)), np.zeros((2, rows))
        x, y = 0.5, 0.5
        whole = [v.tolist() for v in m]
        for r in range(rows):
            into[:, r] = x, y
            x, y = x * whole[0][r] + y * whole[2][r], x * whole[1][r] + y * whole[3][r]
            x, y = x / (x + y), y / (x + y)
        x, y = 0.5, 0.5
        for r in range(rows - 1, -1, -1):
            back[:, r] = x, y
            x, y = whole[0][r] * x + whole[1][r] * y, whole[2][r] * x + whole[3][r] * y
            x, y = x / (x + y), y / (x + y)
        alpha, beta = np.empty((2, length, rows)), np.empty((2, length, rows))
        x, y = into
        for k in range(length):
            x, y = x * step[0][k] + y * step[2][k], x * step[1][k] + y * step[3][k]
            scale = 1.0 / (x + y)
            x, y = x * scale, y * scale
            alpha[0, k], alpha[1, k] = x, y
        x, y = back
        for k in range(length - 1, -1, -1):
            beta[0, k], beta[1, k] = x, y
            x, y = step[0][k] * x + step[1][k] * y, step[2][k] * x + step[3][k] * y
            scale = 1.0 / (x + y)
            x, y = x * scale, y * scale
        flat = lambda z: z.T.reshape(-1)[:n]
        a0, a1, b0, b1 = flat(alpha[0]), flat(alpha[1]), flat(beta[0]), flat(beta[1])
        p = a1 * b1 / (a0 * b0 + a1 * b1)
        s00, s01, s10, s11 = map(flat, step)
        clean = np.log(s00 * b0) - np.log(s00 * b0 + s01 * b1)
        before0, before1 = np.concatenate([[0.5], a0[:-1]]), np.concatenate([[0.5], a1[:-1]])
        moves = np.stack([before0 * s00 * b0, before0 * s01 * b1, before1 * s10 * b0, before1 * s11 * b1], 1)
        moves /= moves.sum(1, keepdims=True)
        moves[starts] = 0.0
        return p, moves, clean

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.calibration, -30, 30)))


class Lexicon:
    """The words met by a task, each with an index of its own; their rows are found once."""

    def __init__(self):
        self.index: dict[int, int] = {}

    def codes(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of every word of a batch; own rows and neighbour rows of the words that are new."""
        kinds, where, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
        known = len(self.index)
        index = self.index
        out = np.array([index.setdefault(h, len(index)) for h in kinds.tolist()], np.int64)
        new = np.flatnonzero(out >= known)  # in order of their indices
        own = np.array([features(w.word(i)) for i in where[new].tolist()], np.int64).reshape(-1, PER_WORD)
        return out[inverse], own, (mix(kinds[new]) % np.uint64(NEAR - 1)).astype(np.int64)


#: The neighbour row of a text's edge.
EDGE = NEAR - 1


def around(codes: np.ndarray, starts: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Neighbour rows of the words before and after each."""
    rows = near[codes]
    before, after = np.concatenate([[EDGE], rows[:-1]]), np.concatenate([rows[1:], [EDGE]])
    before[starts] = EDGE
    after[starts[starts > 0] - 1] = EDGE
    return before, after


def _slices(at: np.ndarray) -> Iterator[tuple[int, int]]:
    """Texts i to j whose words go in one stream."""
    i = 0
    while i < len(at) - 1:
        j = max(i + 1, int(np.searchsorted(at, at[i] + STREAM, "right")) - 1)
        yield i, j
        i = j


def _chains(at: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """Of texts i to j: those with words, and where each of them begins in the slice's stream."""
    texts = np.flatnonzero(np.diff(at[i : j + 1])) + i
    return texts, at[texts] - at[i]


class Tagger:
    """Tags batches with a field's weights, looked up once a word."""

    def __init__(self, field: Field):
        self.field = field
        self.forget()

    def forget(self) -> None:
        self.lexicon, self.emission, self.near = Lexicon(), np.zeros(0), np.zeros(0, np.int64)

    def codes(self, w: Words) -> np.ndarray:
        if len(self.emission) > CACHE_WORDS:
            self.forget()
        codes, own, near = self.lexicon.codes(w)
        self.emission = np.concatenate([self.emission, self.field.own[own].sum(1)])
        self.near = np.concatenate([self.near, near])
        return codes

    def tag(self, texts: pa.Array) -> tuple[np.ndarray, list[str]]:
        """(texts x 4: 1, log-odds of the largest marginal, log of 1 + expected toxic words, log of 1 + words), spans."""
        w, f = Words(texts, NOT_WORD), self.field
        codes = self.codes(w)
        top, mass, spans = np.full(len(w.at) - 1, 1e-9), np.zeros(len(w.at) - 1), [""] * (len(w.at) - 1)
        for i, j in _slices(w.at):
            docs, starts = _chains(w.at, i, j)
            if not len(docs):
                continue
            part = codes[w.at[i] : w.at[j]]
            before, after = around(part, starts, self.near)
            p = f.marginals(f.bias + self.emission[part] + f.prev[before] + f.next[after], starts)[0]
            top[docs] = np.clip(np.maximum.reduceat(p, starts), 1e-9, 1 - 1e-9)
            mass[docs] = np.add.reduceat(p, starts)
            for d in docs[np.maximum.reduceat(p, starts) > 0.5]:
                spans[d] = _spans(w, d, p[w.at[d] - w.at[i] : w.at[d + 1] - w.at[i]] > 0.5)
        return np.stack([np.ones(len(top)), np.log(top / (1 - top)), np.log1p(mass), np.log1p(np.diff(w.at))], 1), spans


def _spans(w: Words, d: int, hot: np.ndarray) -> str:
    """Runs of hot words of a text, start:end in code points."""
    edge = np.diff(np.concatenate([[0], hot.astype(np.int8), [0]]))
    first, last = np.flatnonzero(edge == 1) + w.at[d], np.flatnonzero(edge == -1) - 1 + w.at[d]
    begin = w.offsets[d]
    points = np.concatenate([[0], np.cumsum((w.data[begin : w.offsets[d + 1]] & 0xC0) != 0x80)])
    return ",".join(f"{a}:{b}" for a, b in zip(points[w.begin[first] - begin], points[w.end[last] - begin]))


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton's method; labels may be soft."""
    c = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(c))
        step = np.linalg.solve(h, x.T @ (y - p) - 1e-2 * c)
        c += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return c


def calibrate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A logistic regression that allows for toxic labels without cause: those that look clean count by the chance that they are not."""
    soft = y.astype(float)
    for _ in range(20):
        c = _logistic(x, soft)
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        soft = np.where(y == 1, p / (p + MISLABELLED * (1 - p)), 0.0)
    return c


def training_rows(docs: DataFrame, labels: DataFrame, remainder: int = 0) -> DataFrame:
    """(text, toxic) of a bounded sample of labelled rows outside the held-out fold; equal texts once."""
    known = labels.filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.filter(~held_out(F.col("doc_id"), remainder))
    order = [F.crc32(F.concat(F.lit("s"), F.col("doc_id").cast("string"))), F.col("doc_id")]
    some = known.filter("toxic = 1").orderBy(*order).limit(TOXIC_ROWS).unionByName(known.filter("toxic = 0").orderBy(*order).limit(CLEAN_ROWS))
    found = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")  # at most TOXIC_ROWS + CLEAN_ROWS ids
    return found.groupBy("text").agg(F.max("toxic").alias("toxic"))


@task
def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams of the sample's texts: each chain's label and start, each word's kind, each kind's rows and documents, all and toxic."""
    for b in batches:
        w, label = Words(column(b, "text"), NOT_WORD), np.array(column(b, "toxic").to_pylist(), np.int32)
        codes, own, near = Lexicon().codes(w)
        for i, j in _slices(w.at):
            docs, starts = _chains(w.at, i, j)
            if not len(docs):
                continue
            part = codes[w.at[i] : w.at[j]]
            kinds, inverse = np.unique(part, return_inverse=True)
            chain = np.cumsum(np.isin(np.arange(len(part)), starts)) - 1
            pairs = np.unique(chain * np.int64(len(kinds)) + inverse)
            held = np.bincount(pairs % len(kinds), minlength=len(kinds))
            toxic = np.bincount(pairs % len(kinds), label[docs][pairs // len(kinds)], len(kinds))
            blobs = [x.astype(np.int32).tobytes() for x in (label[docs], starts, inverse, own[kinds], near[kinds], held, toxic)]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in blobs], _STREAM)


_STREAM = ["label", "starts", "words", "own", "near", "held", "toxic"]


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    for b in batches:
        for row in zip(*(column(b, k).to_pylist() for k in _STREAM)):
            yield [np.frombuffer(x, np.int32).astype(np.int64) for x in row]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents that hold each feature row, all and toxic ones, and both of all."""
    own, near, bad, n = np.zeros(OWN), np.zeros(NEAR), np.zeros(OWN), np.zeros(2)
    for label, _, _, o, x, held, toxic in _streams(batches):
        own += np.bincount(o, np.repeat(held, PER_WORD), OWN)
        near += np.bincount(x, held, NEAR)
        bad += np.bincount(o, np.repeat(toxic, PER_WORD), OWN)
        n += [len(label), label.sum()]
    yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([own, near, bad, n]).astype(np.float32).tobytes()], pa.binary())], ["sums"])


def _gradient(field: Field):
    """Sums over a shard: own, prev and next rows, bias, moves, log-likelihood."""

    @task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, prev, nxt, rest = np.zeros(OWN), np.zeros(NEAR), np.zeros(NEAR), np.zeros(6)
        for label, starts, words, o, near, _, _ in _streams(batches):
            before, after = around(words, starts, near)
            rows = o.reshape(-1, PER_WORD)
            p, moves, clean = field.marginals(field.bias + field.own[rows].sum(1)[words] + field.prev[before] + field.next[after], starts)
            none = np.add.reduceat(clean, starts)  # log-probability that no word is toxic
            sizes = np.diff(np.append(starts, len(words)))
            said = -np.expm1(none) + MISLABELLED * np.exp(none)  # probability of a toxic label
            toxic = np.repeat(label == 1, sizes)
            more = np.repeat(1 / said - 1, sizes)  # given the label, every event but that all words are clean gains by this factor
            gap = np.where(toxic, p * more, -p)
            seen = np.bincount(words, gap, len(rows))
            own += np.bincount(rows.ravel(), np.repeat(seen, PER_WORD), OWN)
            prev += np.bincount(before, gap, NEAR)
            nxt += np.bincount(after, gap, NEAR)
            inner = np.ones(len(words))
            inner[starts] = 0.0
            d = np.where(toxic[:, None], moves * more[:, None], -moves)
            # the chain of clean words alone gains by MISLABELLED / said instead
            d[:, 0] += inner * np.where(toxic, -np.repeat((1 - MISLABELLED) * np.exp(none) / said, sizes), 1.0)
            rest += [gap.sum(), *d.sum(0), np.where(label == 1, np.log(said), none).sum()]
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([own, prev, nxt, rest]).astype(np.float32).tobytes()], pa.binary())], ["sums"])

    return run


def _sum(df: DataFrame) -> np.ndarray:
    """The shards' sums: one row a shard, of a fixed size."""
    return np.sum([np.frombuffer(r.sums, np.float32).astype(float) for r in df.collect()], axis=0)


def fit(streams: DataFrame) -> Field:
    """Ascent on the likelihood with a step of its own for every weight, smaller the more it has been pulled."""
    field = Field()
    own, near, bad, n = np.split(_sum(streams.mapInArrow(_count, "sums binary")), [OWN, OWN + NEAR, 2 * OWN + NEAR])
    # a start for words: the log-odds of their documents being toxic, less two standard errors
    good = own - bad
    odds = np.log((bad + 0.5) / (n[1] + 1)) - np.log((good + 0.5) / (n[0] - n[1] + 1)) - 2 * np.sqrt(1 / (bad + 0.5) + 1 / (good + 0.5))
    field.own = np.where(own >= LEAST_DOCS, np.maximum(odds, 0.0), 0.0) * TRUST
    mask = np.concatenate([own, near, near, np.full(5, LEAST_DOCS)]) >= LEAST_DOCS
    mask[[OWN + EDGE, OWN + NEAR + EDGE]] = True
    seen = np.full(len(mask), CAUTION)
    weight = np.concatenate([field.own, field.prev, field.next, [field.bias], field.move.ravel()])
    for _ in range(STEPS):
        g = _sum(streams.mapInArrow(_gradient(field), "sums binary"))[:-1] - PENALTY * weight
        g = np.where(mask, g, 0.0)
        seen += g * g
        weight = weight + RATE * g / np.sqrt(seen)
        field.own, field.prev, field.next = weight[:OWN], weight[OWN : OWN + NEAR], weight[OWN + NEAR : OWN + 2 * NEAR]
        field.bias, field.move = float(weight[-5]), weight[-4:].reshape(2, 2)
    return field


def train(docs: DataFrame, labels: DataFrame, remainder: int = 0) -> Field | float:
    """The fitted field, or the share of toxic labels if one class is missing."""
    tune(docs.sparkSession)
    rows = materialize(training_rows(docs, labels, remainder).withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(5)) == 0), "toxic-sample")
    n = {(r.toxic, r.fold): r["count"] for r in rows.groupBy("toxic", "fold").count().collect()}
    if not all(n.get((y, True), 0) + n.get((y, False), 0) for y in (0, 1)):
        return float(any(y for y, _ in n))
    apart = all(n.get((y, f), 0) for y in (0, 1) for f in (True, False))  # a sample too small to be parted serves both ends
    own = rows.filter("not fold") if apart else rows
    streams = materialize(own.repartition(SHARDS, F.xxhash64("text")).mapInArrow(_prepare, ", ".join(f"{k} binary" for k in _STREAM)), "toxic-streams").coalesce(SHARDS)
    field = fit(streams)

    @task
    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(field)
        for b in batches:
            x = tagger.tag(column(b, "text"))[0]
            yield pa.RecordBatch.from_arrays([column(b, "toxic"), *(pa.array(x[:, k]) for k in (1, 2, 3))], ["toxic", "top", "mass", "words"])

    seen = sorted(tuple(r) for r in (rows.filter("fold") if apart else rows).mapInArrow(summarise, "toxic int, top double, mass double, words double").collect())  # a part of the bounded sample
    x = np.array([[1.0, *r[1:]] for r in seen])
    y = np.array([float(r[0]) for r in seen])
    field.calibration = calibrate(x, y)
    return field


def score(docs: DataFrame, model: Field | float) -> DataFrame:
    """doc_id, score and the toxic spans (start:end in code points, comma-joined)."""
    tune(docs.sparkSession)

    @task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = None if isinstance(model, float) else Tagger(model)
        for b in batches:
            if tagger is None:
                s, spans = np.full(b.num_rows, model), [""] * b.num_rows
            else:
                x, spans = tagger.tag(column(b, "text"))
                s = model.scores(x)
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), pa.array(s, pa.float64()), pa.array(spans, pa.string())], ["doc_id", "score", "toxic_spans"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, toxic_spans string")
