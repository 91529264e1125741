"""MinHash near-dedup on word shingles.

One-permutation hashing splits a shingle set's 64-bit hashes into SIGNATURE bins and keeps each
bin's smallest; empty bins borrow from a bin chosen by a hash of (bin, attempt), the same for every
document (optimal densification). BANDS keys of BAND_ROWS bins go into buckets. Every bucket links
its members to one centre (a star), so candidates grow with memberships, not with their square;
candidates are confirmed on full shingle sets. Buckets whose members still belong to different
components after that may hide links between two non-central members: members outside the largest
component are searched against all, in blocks of bounded size, and give links alone.
Equal sets are collapsed before any of this, and a missed pair at the threshold has a probability of
some 5e-6 (no band in common).

Defined results: a null text, or one without words, has an empty set and is linked with nothing;
fewer than SHINGLE words make one shingle; rows of one doc_id are one node with all their links;
a row with a null doc_id is linked with nothing, has a null component and is kept; extra columns are
not read; an empty table gives an empty result; very long texts are hashed whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, free, materialize, small, task, tune
from .words import mix, word_hashes

SHINGLE = 5
#: Similarity in percent from which documents are linked.
THRESHOLD = 75
SIGNATURE = 128
BAND_ROWS = 4
BANDS = SIGNATURE // BAND_ROWS
#: Bins of the estimate that rules out pairs far below the threshold (over six standard deviations).
FINE = 512
FINE_CUT = 0.62
#: Shingles of one block in the search of mixed buckets: at least, and at most (16 MB of hashes) once a group has many blocks.
LEAST_BLOCK, BLOCK_SHINGLES, MANY_BLOCKS = 100_000, 2_000_000, 64

_WORD = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(column_of_texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit hashes of every text's shingles, one text after another, and where each begins (with the end)."""
    words, at = word_hashes(column_of_texts)
    n = np.diff(at)
    made = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
    begin = np.concatenate([[0], np.cumsum(made)])
    out = np.zeros(begin[-1], np.uint64)
    for width in range(1, SHINGLE + 1):
        mine = n >= SHINGLE if width == SHINGLE else n == width
        if not mine.any():
            continue
        count = made[mine]
        starts = np.repeat(at[:-1][mine] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        h = np.full(len(starts), width, np.uint64)
        for k in range(width):
            h = h * _WORD + words[starts + k]
        places = np.repeat(begin[:-1][mine] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        out[places] = mix(h)
    for a, b in zip(begin[:-1][made > 1], begin[1:][made > 1]):
        out[a:b].sort()
    doc = np.repeat(np.arange(len(n)), made)
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (doc[1:] != doc[:-1])
    return out[new], np.concatenate([[0], np.cumsum(np.bincount(doc[new], minlength=len(n)))])


@lru_cache(2)
def _probes(size: int) -> np.ndarray:
    """For each bin, the bins it may borrow from, in order of attempts."""
    i = np.arange(size, dtype=np.uint64)[:, None] * np.uint64(1 << 20)
    return (mix(i + np.arange(1, 4097, dtype=np.uint64)[None, :]) % np.uint64(size)).astype(np.int16)


def signatures(hashes: np.ndarray, begin: np.ndarray, size: int = SIGNATURE) -> np.ndarray:
    """One-permutation MinHash of sorted sets, densified; a row a set, zeros for an empty one. size: a power of two."""
    n = len(begin) - 1
    doc = np.repeat(np.arange(n), np.diff(begin))
    bins = (hashes >> np.uint64(65 - size.bit_length())).astype(np.int64)
    first = np.flatnonzero(np.diff(doc * size + bins, prepend=-1))
    sig, full = np.zeros((n, size), np.uint64), np.zeros((n, size), bool)
    sig[doc[first], bins[first]] = hashes[first]
    full[doc[first], bins[first]] = True
    row, hole = np.nonzero(~full & (np.diff(begin) > 0)[:, None])
    probes, done = _probes(size), 0
    for upto in (16, 64, 256, 1024, 4096):
        if not len(row):
            break
        left = []
        for k in range(0, len(row), 4096):
            r, h = row[k : k + 4096], hole[k : k + 4096]
            tried = probes[h, done:upto]
            hit = full[r[:, None], tried]
            at = hit.argmax(1)
            found = hit[np.arange(len(r)), at]
            sig[r[found], h[found]] = sig[r[found], tried[found, at[found]]]
            left.append(np.stack([r[~found], h[~found]]))
        (row, hole), done = np.concatenate(left, 1), upto
    sig[row, hole] = hashes[begin[:-1][row]]
    return sig


def band_keys(sig: np.ndarray) -> np.ndarray:
    """BANDS keys of each row of signatures."""
    rows = sig.reshape(len(sig), BANDS, BAND_ROWS)
    h = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93), (len(sig), 1))
    for k in range(BAND_ROWS):
        h = mix(h * _WORD + rows[:, :, k])
    return h.view(np.int64)


def _binary(hashes: np.ndarray, begin: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(begin) - 1, [None, pa.py_buffer((begin * 8).astype(np.int32).tobytes()), pa.py_buffer(hashes.tobytes())])


@task
def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        hashes, begin = shingle_sets(column(b, "text"))
        n = np.diff(begin)
        some = n > 0
        whole = [xxhash.xxh3_128_digest(hashes[i:j].tobytes()) if j > i else None for i, j in zip(begin[:-1], begin[1:])]
        keys = band_keys(signatures(hashes, begin))[some]
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(some * BANDS)]), pa.int32()), pa.array(keys.ravel()), mask=pa.array(~some))
        yield pa.RecordBatch.from_arrays([column(b, "doc_id"), pa.array(n, pa.int64()), pa.array(whole, pa.binary()), lists], ["doc_id", "n_shingles", "whole", "keys"])


@task
def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([column(b, "node"), _binary(*shingle_sets(column(b, "text")))], ["node", "set"])


@task
def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps the pairs whose full sets reach the threshold."""
    for b in batches:
        keep = []
        for x, y in zip(column(b, "set_a").to_pylist(), column(b, "set_b").to_pylist()):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= THRESHOLD * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([column(b, "a"), column(b, "b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def confirm(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of candidate pairs (a, b), those whose full sets are similar enough. docs: (node, text)."""
    ids = materialize(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "near-ids")
    chosen = docs.join(small(ids, ids.count()), "node", "left_semi")
    sets = materialize(chosen.mapInArrow(_sets, "node long, set binary"), "near-sets")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b")
    return materialize(both.select("a", "b", "set_a", "set_b").mapInArrow(_similar, "a long, b long"), "near-links")


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable. Min-label propagation with pointer jumping."""
    label = materialize(links.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node")), "near-cc")
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    while True:
        seen = both.join(label.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        low = label.join(seen, "node", "left").select("node", F.col("component").alias("was"), F.least("component", F.coalesce("near", "component")).alias("component"))
        jump = label.select(F.col("node").alias("component"), F.col("component").alias("next"))
        new = materialize(low.join(jump, "component", "left").select("node", "was", F.least("component", F.coalesce("next", "component")).alias("component")), "near-cc")
        changed = new.filter("component != was").limit(1).count()
        label = new.select("node", "component")
        if not changed:
            return label


def _relabel(ids: DataFrame, label: DataFrame | None) -> DataFrame:
    if label is None:
        return ids.withColumn("component", F.col("node"))
    return ids.join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))


#: Sizes that allow the threshold.
_FITS = f"100 * least(n_a, n_b) >= {THRESHOLD} * greatest(n_a, n_b)"


class _Forest:
    """Union-find over component labels."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def _search_group(node: np.ndarray, comp: np.ndarray, minor: np.ndarray, sets: list[np.ndarray], forest: _Forest, cut: float | None) -> Iterator[tuple[int, int]]:
    """Links of minor documents to any of another component; those that join nothing new are left out."""
    size = np.array([len(x) for x in sets], np.int64)
    order = np.lexsort((node, size))
    node, comp, minor, size, sets = node[order], comp[order], minor[order], size[order], [sets[i] for i in order]
    # estimates on FINE bins rule out pairs far below the threshold; the rest is confirmed on full sets
    fine = signatures(np.concatenate(sets), np.concatenate([[0], np.cumsum(size)]), FINE).astype(np.uint16) if cut is not None else None
    low = np.searchsorted(size, -(-size * THRESHOLD // 100), "left")
    high = np.searchsorted(size, size * 100 // THRESHOLD, "right")
    for i in np.flatnonzero(minor):
        rest = slice(int(low[i]), int(high[i]))
        near = comp[rest] != comp[i]
        if fine is not None:
            near &= np.count_nonzero(fine[rest] == fine[i], axis=1) >= cut * FINE
        for j in np.flatnonzero(near) + low[i]:
            if forest.find(int(comp[i])) != forest.find(int(comp[j])):
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * both >= THRESHOLD * (size[i] + size[j] - both):
                    forest.join(int(comp[i]), int(comp[j]))
                    yield int(node[i]), int(node[j])


def _search(cut: float | None):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        """The groups that one task searches: a pair of blocks of a large one, or many small ones."""
        found = []
        groups = table.column("grp").to_numpy()
        for g in np.unique(groups):
            part = table.filter(pa.array(groups == g))
            node, comp = (part.column(c).to_numpy() for c in ("node", "component"))
            minor = part.column("minor").to_numpy(zero_copy_only=False)
            found += _search_group(node, comp, minor, [np.frombuffer(x, np.uint64) for x in part.column("set").to_pylist()], _Forest(), cut)
        free()
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return run


def _blocks(total: Column) -> Column:
    """Blocks of a group: small ones while they are few, so that tasks are even, then larger ones, so that copies of sets are few."""
    return F.when(total <= MANY_BLOCKS * LEAST_BLOCK, F.ceil(total / LEAST_BLOCK)).when(total <= MANY_BLOCKS * BLOCK_SHINGLES, F.lit(MANY_BLOCKS)).otherwise(F.ceil(total / BLOCK_SHINGLES)).cast("int")


def hidden_links(docs: DataFrame, members: DataFrame, cut: float | None = FINE_CUT) -> DataFrame | None:
    """Links between members of different components that share a bucket; None if there are no such members.

    members: (key, node, n_shingles, component). Buckets with several components are joined into groups.
    In a group, the documents outside its largest component (the minor ones) are searched against all:
    both are dealt to blocks of bounded total size and every pair of a minor block and a block of all is
    one task's, so that no group, however large, meets in one; small groups share tasks.
    """
    mixed = members.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min("node").alias("first")).filter("low != high")
    edges = materialize(members.join(mixed.select("key", "first"), "key").select(F.col("first").alias("a"), F.col("node").alias("b"), "n_shingles", "component"), "near-mixed")
    if not edges.limit(1).count():
        return None
    # a node has BANDS buckets at most: their first members are tied to the smallest of these instead of each to the node
    tied = edges.groupBy("b").agg(F.min("a").alias("a"), F.collect_set("a").alias("firsts"))
    stars = tied.select("a", "b").union(tied.select("a", F.explode("firsts").alias("b"))).distinct()
    group = components(materialize(stars, "near-stars")).withColumnRenamed("component", "grp")
    rows = materialize(edges.select(F.col("b").alias("node"), "n_shingles", "component").distinct().join(group, "node"), "near-grouped")
    parts = rows.groupBy("grp", "component").agg(F.sum("n_shingles").alias("held"))
    shape = parts.groupBy("grp").agg(F.max_by("component", F.struct("held", "component")).alias("main"), F.sum("held").alias("total"), F.max("held").alias("largest"))
    shape = materialize(shape.select("grp", "main", "total", _blocks(F.col("total")).alias("n_all"), F.greatest(F.lit(1), _blocks(F.col("total") - F.col("largest"))).alias("n_minor")), "near-shape")
    light = shape.filter("n_all = 1").agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    shared = -(-light // LEAST_BLOCK) or 1
    dealt = rows.join(small(shape, shape.count()), "grp").withColumn("minor", F.col("component") != F.col("main"))
    place = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["grp", "node", "component", "minor", "n_all"]
    as_all = dealt.select(*columns, every("n_minor").alias("i"), place("n_all").alias("j"), F.lit(False).alias("seeks"))
    as_minor = dealt.filter("minor").select(*columns, place("n_minor").alias("i"), every("n_all").alias("j"), F.lit(True).alias("seeks"))
    # a minor document that meets its own block is one row there
    roles = as_all.unionByName(as_minor).groupBy(*columns, "i", "j").agg(F.max("seeks").alias("seeks"))
    unit = F.when(F.col("n_all") == 1, -1 - F.pmod(F.xxhash64("grp"), F.lit(shared))).otherwise(F.col("grp"))
    roles = materialize(roles.select("grp", "node", "component", F.col("seeks").alias("minor"), unit.alias("unit"), F.when(F.col("n_all") == 1, 0).otherwise(F.col("i")).alias("i"), F.when(F.col("n_all") == 1, 0).otherwise(F.col("j")).alias("j")), "near-roles")
    ids = materialize(rows.select("node").distinct(), "near-ids")
    sets = materialize(docs.join(small(ids, ids.count()), "node", "left_semi").mapInArrow(_sets, "node long, set binary"), "near-sets")
    pairs = roles.join(sets, "node").select("unit", "i", "j", "grp", "node", "component", "minor", "set")
    return materialize(pairs.groupBy("unit", "i", "j").applyInArrow(_search(cut), "a long, b long"), "near-links")


def near_duplicates(docs: DataFrame, cut: float | None = FINE_CUT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text).

    cut: share of FINE bins below which a pair of a mixed bucket is not compared in full; None compares all.
    """
    spark = docs.sparkSession
    tune(spark)
    read = docs.select("doc_id", "text")
    sketch = materialize(read.mapInArrow(_sketches, "doc_id long, n_shingles long, whole binary, keys array<long>"), "near-sketch")
    live = sketch.filter("doc_id is not null and n_shingles > 0")
    same = live.groupBy("whole").agg(F.min("doc_id").alias("node"))
    nodes = materialize(live.groupBy("whole").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n_shingles"), F.first("keys").alias("keys")), "near-nodes")
    bands = nodes.select("node", "n_shingles", F.explode("keys").alias("key"))
    # rows alone in their bucket go at once: all bands are joined and sorted here only, the rest reads what is held
    often = bands.groupBy("key").count().filter("count > 1").select("key")
    held = materialize(bands.join(often, "key", "left_semi").select("key", "node", "n_shingles"), "near-held")
    centre = held.groupBy("key").agg(F.min(F.struct("node", "n_shingles")).alias("c")).select("key", F.col("c.node").alias("a"), F.col("c.n_shingles").alias("n_a"))
    cand = centre.join(held.select("key", F.col("node").alias("b"), F.col("n_shingles").alias("n_b")), "key").filter("a != b")
    pairs = materialize(cand.filter(_FITS).select("a", "b").distinct(), "near-pairs")
    texts_of = read.filter("doc_id is not null").select(F.col("doc_id").alias("node"), "text")
    links = confirm(texts_of, pairs)
    label = components(links)
    members = materialize(_relabel(held, label), "near-members")
    extra = hidden_links(texts_of, members, cut)
    if extra is not None and extra.limit(1).count():
        label = components(links.unionByName(extra))
    # every row: its set's node, that node's component; one doc_id may have several sets
    rows = live.select("doc_id", "whole").distinct().join(same, "whole").join(label, "node", "left").select("doc_id", "node", F.coalesce("component", "node").alias("component"))
    joined = rows.groupBy("doc_id").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    ids = materialize(rows, "near-rows")
    if joined.filter("low != high").limit(1).count():  # ids with several sets tie their components together
        ties = ids.select(F.col("doc_id").alias("a"), F.col("component").alias("b"))
        ids = materialize(ids.select("doc_id").distinct().join(components(ties).withColumnRenamed("node", "doc_id"), "doc_id"), "near-rows")
    final = ids.groupBy("doc_id").agg(F.min("component").alias("component_id"))
    out = sketch.select("doc_id", "n_shingles").join(final, "doc_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
