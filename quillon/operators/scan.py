"""Scoring of a batch of queries over the forward rows of an index: a document's tokens meet all queries at once.

Nothing is shuffled: what a document adds to every query is known from its own row, the queries' terms with their
frequencies and the average lengths. Queries and their terms are sent to every task, a person made each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .. import schema as S
from .index import fold_words, places_of, word_streams

K = len(S.FIELDS)
#: Sums of so many (document, query, field) are held at once.
CELLS = 3_000_000
#: So many places of terms are compared at once.
EVENTS = 2_000_000
#: Matched terms of a document are bits of long columns, so many in each: sums of them are exact in a double.
BITS = 52
_NEVER = 1_000_000_000


@dataclass
class Terms:
    """The queries' distinct terms of one channel, and for each the queries that hold it (term t: slots from[t] to from[t + 1])."""

    words: pa.Array
    idf: np.ndarray
    start: np.ndarray
    query: np.ndarray
    weight: np.ndarray
    places: np.ndarray
    slot: np.ndarray


@dataclass
class Plan:
    """Queries by number: ids, numbers of original terms, the terms at their places (-1: not in the index), each term once."""

    ids: pa.Array
    n_terms: np.ndarray
    terms: dict[str, Terms]
    seq: np.ndarray
    seq_start: np.ndarray
    once: np.ndarray
    once_start: np.ndarray
    words: int
    group: np.ndarray | None = None


def plan(rows: list, n_terms: dict[str, int], idf: Callable[[int], float], groups: dict[str, int] | None = None) -> Plan:
    """rows: (query_id, channel, term, weight, places, slot, df) of terms that the index holds; n_terms: of every query."""
    ids = sorted(n_terms)
    number = {q: i for i, q in enumerate(ids)}
    sequence = [np.full(n_terms[q], -1, np.int64) for q in ids]
    made = {}
    for c in S.CHANNELS:
        mine = [r for r in rows if r["channel"] == c]
        names = sorted({r["term"] for r in mine})
        if not names:
            continue
        code = {w: i for i, w in enumerate(names)}
        mine.sort(key=lambda r: code[r["term"]])
        at, scale = np.array([code[r["term"]] for r in mine]), np.zeros(len(names))
        for r in mine:
            sequence[number[r["query_id"]]][list(r["places"])] = code[r["term"]]
            scale[code[r["term"]]] = idf(r["df"])
        made[c] = Terms(
            pa.array(names, pa.string()), scale, np.searchsorted(at, np.arange(len(names) + 1)), np.array([number[r["query_id"]] for r in mine]),
            np.array([r["weight"] for r in mine], float), np.array([len(r["places"]) for r in mine]), np.array([r["slot"] for r in mine]),
        )
    words = 1 + max((r["slot"] for r in rows), default=0) // BITS
    once = [np.unique(x) for x in sequence]
    flat = lambda parts: (np.concatenate([*parts, np.zeros(0, np.int64)]), np.cumsum([0, *map(len, parts)]))
    return Plan(pa.array(ids, pa.string()), np.array([n_terms[q] for q in ids], np.int64), made, *flat(sequence), *flat(once), words, np.array([groups[q] for q in ids], np.int64) if groups is not None else None)


def _spread(start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of runs given by their starts and lengths: which run each element is of, and the element."""
    of = np.repeat(np.arange(len(n)), n)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start, n)


@dataclass
class Found:
    """Occurrences of one channel's terms in a few documents: entries of (document, term, field), in order."""

    token: np.ndarray
    base: np.ndarray
    lens: np.ndarray
    key: np.ndarray
    first: np.ndarray
    tf: np.ndarray
    pos: np.ndarray
    row: np.ndarray
    term: np.ndarray
    fld: np.ndarray


def _find(t: Terms, lens: np.ndarray, token: np.ndarray, fld: np.ndarray, row: np.ndarray, pos: np.ndarray) -> Found:
    kept = np.flatnonzero(token >= 0)
    key = (row[kept] * len(t.words) + token[kept]) * K + fld[kept]
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    held, at = np.divmod(key[first], K)
    n = lens.ravel()
    return Found(token, (np.cumsum(n) - n).reshape(lens.shape), lens, key[first], first, np.diff(np.append(first, len(key))), pos[kept][order], held // len(t.words), held % len(t.words), at)


def _evidence(p: Plan, t: Terms, f: Found, row: np.ndarray, query: np.ndarray, fld: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """exact and gap of pairs whose document's field holds all of the query's terms."""
    exact, gap = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
    n = np.diff(p.once_start)[query]
    pair, at = _spread(p.once_start[query], n)
    term, slot = p.once[at], at - p.once_start[query][pair]
    entry = np.searchsorted(f.key, (row[pair] * len(t.words) + term) * K + fld[pair])
    # pairs in runs of a bounded number of places
    size = np.bincount(pair, f.tf[entry], len(row)).astype(np.int64)
    part = (np.cumsum(size) - size) // EVENTS
    for k in np.unique(part):
        lo, hi = np.searchsorted(part, [k, k + 1])
        a, b = np.searchsorted(pair, [lo, hi])
        of, place = _spread(f.first[entry[a:b]], f.tf[entry[a:b]])
        x, which, s, w = f.pos[place], pair[a:b][of], slot[a:b][of], term[a:b][of]
        # exact: the following tokens of the field continue the query
        begins = np.flatnonzero(w == p.seq[p.seq_start[query[which]]])
        at, begun = f.base[fld[which[begins]], row[which[begins]]] + x[begins], which[begins]
        end = f.base[fld[begun], row[begun]] + f.lens[fld[begun], row[begun]]
        m = p.n_terms[query[begun]]
        want = p.seq_start[query[begun]]
        for i in range(1, int(m.max())):
            ok = (i >= m) | ((at + i < end) & (f.token[np.minimum(at + i, len(f.token) - 1)] == p.seq[np.minimum(want + i, len(p.seq) - 1)]))
            at, begun, end, m, want = at[ok], begun[ok], end[ok], m[ok], want[ok]
        exact[lo:hi] = np.bincount(begun - lo, minlength=hi - lo)
        # gap: at every place, how far back the last place of each term lies
        wide = int(x.max()) + 2
        order = np.argsort(which * wide + x)
        here, s, g = which[order], s[order], (which * wide + x)[order]
        least = g.copy()
        for i in range(int(n[lo:hi].max())):
            last = np.maximum.accumulate(np.where(s == i, g, -1))
            last = np.where(last >= here * wide, last, np.where(i < n[here], -_NEVER * wide, g))
            np.minimum(least, last, out=least)
        span = np.minimum.reduceat(g - least, np.flatnonzero(np.diff(here, prepend=-1)))
        gap[lo:hi] = np.maximum(0, span - (p.n_terms[query[lo:hi]] - 1))
    return exact, gap


def _parts(b: pa.RecordBatch, p: Plan) -> Iterator[tuple[pa.RecordBatch, np.ndarray, str, Terms, Found]]:
    """A batch in pieces of bounded size, with what is found of each channel's terms."""
    step = max(1, CELLS // max(1, len(p.ids) * K))
    for start in range(0, b.num_rows, step):
        piece = b.slice(start, step)
        lens, words = word_streams(piece)
        fld, row, pos = places_of(lens)
        code = words.indices.to_numpy(zero_copy_only=False)
        for c, t in p.terms.items():
            known = words.dictionary
            if c == "accentless":
                folded, forms = fold_words(words.dictionary)
                code, known = (folded[code] if len(code) else code), forms
            token = pc.fill_null(pc.index_in(known, value_set=t.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)[code] if len(code) else np.zeros(0, np.int64)
            yield piece, lens, c, t, _find(t, lens, token, fld, row, pos)


def _cells(p: Plan, t: Terms, f: Found, rows: int, unit: np.ndarray | None, places: bool) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None]:
    """Of every (document, query, field): how many terms it holds, the sum of unit times the query's weight, the places of its terms."""
    n = len(p.ids)
    of, at = _spread(t.start[f.term], np.diff(t.start)[f.term])
    cell = (f.row[of] * n + t.query[at]) * K + f.fld[of]
    shape, total = (rows, n, K), rows * n * K
    count = lambda w: np.bincount(cell, w, total).reshape(shape)
    return count(None), count(unit[of] * t.weight[at]) if unit is not None else None, count(t.places[at]) if places else None


def _whole(p: Plan, places: np.ndarray) -> tuple[np.ndarray, ...]:
    """Where a field holds every original term of a query of two or more."""
    n = p.n_terms[None, :, None]
    return np.nonzero((places == n) & (n >= 2))


def _allowed(p: Plan, piece: pa.RecordBatch) -> np.ndarray | None:
    """Which documents pass which queries' filters, from the numbers of the filters that each passes."""
    if p.group is None:
        return None
    lists = piece.column(piece.schema.get_field_index("passes"))
    passed = np.zeros((piece.num_rows, int(p.group.max()) + 1), bool)
    passed[np.repeat(np.arange(piece.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False)), lists.flatten().to_numpy(zero_copy_only=False)] = True
    return passed[:, p.group]


def _emit(p: Plan, piece: pa.RecordBatch, hit: np.ndarray, extra: dict[str, pa.Array], handed: tuple[str, ...]) -> pa.RecordBatch:
    row, query = (pa.array(x) for x in np.nonzero(hit))
    columns = {"query_id": p.ids.take(query)} | {c: piece.column(piece.schema.get_field_index(c)).take(row) for c in handed}
    return pa.RecordBatch.from_pydict(columns | extra)


def _marks(p: Plan, t: Terms, f: Found, rows: int, hit: np.ndarray) -> dict[str, pa.Array]:
    new = np.flatnonzero(np.diff(f.key // K, prepend=-1))  # a document's term
    of, at = _spread(t.start[f.term[new]], np.diff(t.start)[f.term[new]])
    cell = f.row[new][of] * len(p.ids) + t.query[at]
    word, bit = np.divmod(t.slot[at], BITS)
    return {f"_w{k}": pa.array(np.bincount(cell, np.where(word == k, np.exp2(bit), 0.0), rows * len(p.ids)).reshape(rows, -1)[hit].astype(np.int64)) for k in range(p.words)}


def bm25f(p: Plan, params: S.Bm25f, averages: dict[str, float], handed: tuple[str, ...], marks: bool):
    """A function for mapInArrow: (query_id, handed, <field>: score or null with the field's evidence in it, _w0, ...)."""
    weight = np.array([params.weights.get(f, 1.0) for f in S.FIELDS])
    b = np.array([params.b.get(f, 0.75) for f in S.FIELDS])
    avg = np.array([averages[f] for f in S.FIELDS])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for piece, lens, _, t, f in _parts(whole, p):
                if not len(f.key):
                    continue
                rel = np.where(avg[f.fld] > 0, lens[f.fld, f.row] / np.where(avg > 0, avg, 1.0)[f.fld], 1.0)
                part = weight[f.fld] * f.tf / np.maximum(1 - b[f.fld] + b[f.fld] * rel, 1e-9)
                new = np.diff(f.key // K, prepend=-1) != 0
                ctf = np.add.reduceat(part, np.flatnonzero(new))[np.cumsum(new) - 1]
                # the term's score is shared out to the fields by their parts of its combined frequency
                held, sums, places = _cells(p, t, f, piece.num_rows, t.idf[f.term] * (params.k1 + 1) / (params.k1 + ctf) * part, True)
                ok = _allowed(p, piece)
                if ok is not None:
                    held[~ok] = 0
                    places[~ok] = 0
                row, query, fld = _whole(p, places)
                if len(row):
                    exact, gap = _evidence(p, t, f, row, query, fld)
                    sums[row, query, fld] += params.phrase * exact * weight[fld] + params.proximity * weight[fld] / (gap + 1)
                hit = held.any(axis=2)
                held, sums = held[hit], sums[hit]
                extra = {name: pa.array(sums[:, k], mask=held[:, k] == 0) for k, name in enumerate(S.FIELDS)}
                yield _emit(p, piece, hit, extra | (_marks(p, t, f, piece.num_rows, hit) if marks else {}), handed)

    return score


def tfidf(p: Plan, weights: dict[str, float], handed: tuple[str, ...], marks: bool):
    """The same for TF-IDF: a query's weight of a term holds both idf and the query's norm; norms of documents are in their rows."""
    weight = np.array([weights.get(f, 1.0) for f in S.FIELDS])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for piece, _, c, t, f in _parts(whole, p):
                if not len(f.key):
                    continue
                norm = piece.column(piece.schema.get_field_index(f"norm_{c}")).to_numpy(zero_copy_only=False)
                held, sums, _ = _cells(p, t, f, piece.num_rows, t.idf[f.term] * weight[f.fld] * (1 + np.log(f.tf)) / norm[f.row], False)
                ok = _allowed(p, piece)
                if ok is not None:
                    held[~ok] = 0
                hit = held.any(axis=2)
                held, sums = held[hit], sums[hit]
                extra = {name: pa.array(sums[:, k], mask=held[:, k] == 0) for k, name in enumerate(S.FIELDS)}
                yield _emit(p, piece, hit, extra | (_marks(p, t, f, piece.num_rows, hit) if marks else {}), handed)

    return score


def matches(p: Plan, handed: tuple[str, ...]):
    """(query_id, handed) of documents that hold a term of the query."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for piece, _, _, t, f in _parts(whole, p):
                held, _, _ = _cells(p, t, f, piece.num_rows, None, False)
                yield _emit(p, piece, held.any(axis=2), {}, handed)

    return found


def evidence(p: Plan):
    """(query_id, doc_id, field, exact, gap) wherever a field holds every original term of a query of two or more."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for piece, _, _, t, f in _parts(whole, p):
                places = _cells(p, t, f, piece.num_rows, None, True)[2]
                row, query, fld = _whole(p, places)
                if len(row):
                    exact, gap = _evidence(p, t, f, row, query, fld)
                    ids = piece.column(piece.schema.get_field_index("doc_id"))
                    yield pa.RecordBatch.from_pydict({"query_id": p.ids.take(pa.array(query)), "doc_id": ids.take(pa.array(row)), "field": pa.array(S.FIELDS).take(pa.array(fld)), "exact": pa.array(exact.astype(np.int32)), "gap": pa.array(gap.astype(np.int32))})

    return found
