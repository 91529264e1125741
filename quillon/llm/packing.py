"""Best-fit packing of tokenised documents into fixed-length sequences.

Hierarchical residual packing: each input partition packs its pieces best-fit, largest first. Bins
with no more room than CLOSE_SLACK are finished. Underfull bins go on as single items into a tree of
merges: groups of bounded size are packed best-fit again, with fewer groups each round, until a
round saves no bin, no fewer bins can hold the tokens or a single group has been packed. Only bins
travel, not pieces or texts, and no group exceeds GROUP_BINS, so no task gathers what grows with the
corpus.

Defined results: a null or empty text is the separator alone (one piece of one token); repeated rows
and null ids are separate documents; extra columns are not read; an empty table gives an empty
result; only texts longer than a sequence are cut.
"""

from __future__ import annotations

import itertools
import json
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, materialize, small, task, texts, tune

LENGTH = 2048
SEPARATOR = 0
#: A bin with at most so many free tokens is emitted at once.
CLOSE_SLACK = 4
#: Bins that one merge task takes; partitions merged by one task of the next round.
GROUP_BINS = 100_000
FAN_IN = 8
#: Words whose ids a task remembers; the store is emptied when full.
CACHE_WORDS = 250_000


#: Words spelled with these characters alone are split here; any other goes through the library's own normaliser.
_LETTER = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_PLAIN = re.compile(f"[{_LETTER}0-9!-/:-@\\[-`{{-~]*")
_SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[0-9]|[^{_LETTER}0-9]+")
#: Marks a word's end inside the merger; no UTF-8 text holds this byte.
_END = b"\xff"
_SUFFIX = "</w>"


def _byte_names() -> dict[str, int]:
    """The printable character by which byte-level vocabularies name each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class WordIds(dict):
    """Ids (little-endian 32-bit) of white-space separated words; the tokenizer never joins across these.

    A vocabulary whose ids follow the order of its merges is merged by rank in tiktoken, which is
    many times faster a word; other vocabularies, unusual characters and words that may hold one of
    the tokenizer's own marks (<|...|>, which get their own ids) use the tokenizer itself.
    """

    def __init__(self, path: str):
        self.tokenizer, self.merger = _load(path)
        self.pieces: dict[str, bytes] = {}

    @staticmethod
    def _merger(path: str):
        """A rank merger, or None unless the file is lower-cased byte-level BPE with word ends and ids in merge order."""
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, names = spec["model"], _byte_names()
        vocab = model["vocab"]
        steps = [x["type"] for x in spec["normalizer"].get("normalizers", [])] if spec.get("normalizer") else []
        merged = ["".join(m if isinstance(m, list) else m.split(" ")).replace(_SUFFIX, "", 1) if isinstance(m, str) else m[0] + m[1] for m in model["merges"]]
        ids = [vocab[x] if x in vocab else -1 for x in merged]
        if model.get("end_of_word_suffix") != _SUFFIX or steps != ["NFC", "Replace", "Lowercase"] or ids != sorted(ids) or -1 in ids or len(set(ids)) != len(ids):
            return None
        ranks = {}
        for token, rank in vocab.items():
            body, end = (token[: -len(_SUFFIX)], _END) if token.endswith(_SUFFIX) else (token, b"")
            if all(c in names for c in body) and not token.startswith("<|"):
                ranks[bytes(names[c] for c in body) + end] = rank
        return tiktoken.Encoding("words", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})._core_bpe

    def _piece(self, piece: str) -> bytes:
        got = self.pieces.get(piece)
        if got is None:
            got = self.pieces[piece] = array("I", self.merger.encode_single_piece(piece.encode() + _END)).tobytes()
        return got

    def __missing__(self, word: bytes) -> bytes:
        low = (text := word.decode("utf-8", "replace")).lower()
        if self.merger and "<|" not in low and (low.isprintable() if low.isascii() else _PLAIN.fullmatch(low)):
            if low.isalpha():
                got = self._piece(low)
            elif low[:-1].isalpha() and low[-1] in ".,;:!?":
                got = self._piece(low[:-1]) + self._piece(low[-1])
            else:
                got = b"".join(map(self._piece, _SPLIT.findall(low)))
        else:
            got = np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        self[word] = got
        return got

    def trim(self) -> None:
        if len(self) > CACHE_WORDS:
            self.clear()
        if len(self.pieces) > CACHE_WORDS:
            self.pieces.clear()


@lru_cache(1)
def _load(path: str):
    """The tokenizer and its rank merger: of a fixed size, so a worker keeps them for later tasks."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path), WordIds._merger(path)


def best_fit(lengths: np.ndarray, capacity: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and each bin's fill: largest items first, tightest bin first."""
    bins, offsets, fills = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]  # by free room
    mask = 0  # bit r: a bin with r tokens free
    for i in np.argsort(-lengths, kind="stable"):
        n = int(lengths[i])
        fit = mask >> n
        if fit:
            room = n + ((fit & -fit).bit_length() - 1)
            k = open_[room].pop()
            if not open_[room]:
                mask ^= 1 << room
        else:
            room, k = capacity, len(fills)
            fills.append(0)
        bins[i], offsets[i] = k, fills[k]
        fills[k] += n
        if room > n:
            open_[room - n].append(k)
            mask |= 1 << (room - n)
    return bins, offsets, np.asarray(fills, np.int64)


def _pack_partition(tokenizer_path: str | None, keep: list[str]):
    @task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        known = WordIds(tokenizer_path or public_tokenizers.path("word_bpe_49k.json"))
        end = np.asarray([SEPARATOR], "<u4").tobytes()
        kept, piece, start, length, crc = [], [], [], [], []
        for b in batches:
            docs = [x.split() for x in texts(b)]
            known.trim()
            first = len(piece)
            rows = []
            for k, words in enumerate(docs):
                ids = b"".join(map(known.__getitem__, words)) + end
                for p, at in enumerate(range(0, len(ids), 4 * LENGTH)):
                    part = ids[at : at + 4 * LENGTH]
                    piece.append(p)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    rows.append(k)
            assert len(piece) - first == len(rows)
            kept.append(pa.table([column(b, c) for c in keep], keep).take(pa.array(rows, pa.int64())))
        if not piece:
            return
        lengths = np.asarray(length, np.int64)
        bins, offsets, fills = best_fit(lengths)
        base = TaskContext.get().partitionId() << 36
        out = pa.concat_tables(kept)
        for name, values, kind in (("piece", piece, pa.int32()), ("start", start, pa.int64()), ("length", lengths, pa.int64()), ("ids_crc32", crc, pa.int64()), ("bin", bins + base, pa.int64()), ("offset", offsets, pa.int64()), ("fill", fills[bins], pa.int64())):
            out = out.append_column(name, pa.array(values, kind))
        yield from out.to_batches(max_chunksize=10_000)

    return run


def _merge_group(pdf: pd.DataFrame) -> pd.DataFrame:
    """Underfull bins of one group packed as items; a bin made of several takes its first one's name."""
    pdf = pdf.sort_values(["fill", "bin"], ascending=[False, True], kind="stable").reset_index(drop=True)
    bins, offsets, fills = best_fit(pdf["fill"].to_numpy(np.int64))
    head = pdf["bin"].to_numpy()[np.unique(bins, return_index=True)[1]]
    return pd.DataFrame({"bin": pdf["bin"], "into": head[bins], "shift": offsets, "fill": pdf["fill"], "total": fills[bins]})


def merge_bins(under: DataFrame) -> DataFrame | None:
    """under: (bin, fill). Gives (bin, sequence_id, shift) for the underfull bins, or None if there are none."""
    spark = under.sparkSession
    n, filled = under.agg(F.count("*"), F.sum("fill")).first()
    if not n:
        return None
    fewest, bins = -(-filled // LENGTH), n  # as many bins the tokens need at least; as many hold them now
    placed = under.select("bin", F.col("bin").alias("sequence_id"), F.lit(0).cast("long").alias("shift"))
    groups = max(1, -(-n // GROUP_BINS), under.rdd.getNumPartitions() // FAN_IN)
    items = under
    for k in itertools.count():
        keyed = items.withColumn("_group", F.pmod(F.xxhash64("bin", F.lit(k)), F.lit(groups)))
        moved = materialize(keyed.groupBy("_group").applyInPandas(_merge_group, "bin long, into long, shift long, fill long, total long"), "pack-round")
        step = moved.select(F.col("bin").alias("_b"), F.col("into").alias("_into"), F.col("shift").alias("_shift"))
        placed = materialize(
            placed.join(small(step, n), F.col("sequence_id") == F.col("_b"), "left").select("bin", F.coalesce("_into", "sequence_id").alias("sequence_id"), (F.col("shift") + F.coalesce("_shift", F.lit(0))).alias("shift")), "pack-placed"
        )
        left = moved.filter((F.col("bin") == F.col("into")) & (F.col("total") < LENGTH - CLOSE_SLACK)).select("bin", F.col("total").alias("fill"))
        saved = moved.filter(F.col("bin") != F.col("into")).count()
        n, bins = left.count(), bins - saved
        if groups == 1 or not n or not saved or bins == fewest:
            break
        items, groups = left, max(1, -(-n // GROUP_BINS), groups // FAN_IN)
    return placed


def pack(docs: DataFrame, keep: list[str] | None = None, tokenizer_path: str | None = None) -> DataFrame:
    """A row a piece: the kept columns, piece, start, length, ids_crc32, sequence_id, offset."""
    tune(docs.sparkSession)
    keep = keep or ["doc_id"]
    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "piece int, start long, length long, ids_crc32 long, bin long, offset long, fill long"])
    read = list(dict.fromkeys([*keep, "text"]))
    local = materialize(docs.select(*read).mapInArrow(_pack_partition(tokenizer_path, keep), schema), "pack-local")
    under = local.filter((F.col("offset") == 0) & (F.col("fill") < LENGTH - CLOSE_SLACK)).select("bin", "fill")
    placed = merge_bins(under)
    columns = [*keep, "piece", "start", "length", "ids_crc32"]
    if placed is None:
        return local.select(*columns, F.col("bin").alias("sequence_id"), "offset")
    return local.join(small(placed, placed.count()), "bin", "left").select(
        *columns, F.coalesce("sequence_id", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("shift", F.lit(0))).cast("long").alias("offset")
    )
