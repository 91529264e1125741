"""Secret scans: fixed patterns, plus strings that zstandard cannot explain.

The novelty method looks at candidate strings near a sensitive word, on either side of it. A compressor
primed with a dictionary of identifiers compresses the surrounding text with and without the candidate;
the difference is the candidate's marginal cost in bytes. Literals are left uncoded, so a string that
nothing explains costs its length, however long it is and whatever its alphabet. Candidates that cost
nearly that are reported as `novel`, unless a span of the fixed patterns covers them whole.

The dictionary holds the parts of all names in some standard modules, a few words of code, and what
`learn` finds: the most frequent words of a corpus, counted over all texts without a sensitive word.

Defined results: a null or empty text has no spans; spans are in code points, end exclusive, ordered
by start, then kind as listed in KINDS; rows are scanned one by one, so repeated rows agree; extra
columns are not read; an empty table gives an empty result; very long texts are scanned whole.
"""

from __future__ import annotations

import ast
import hashlib
import importlib
import inspect
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, task, tune
from .words import NOT_WORD, Words

KINDS = ("assign", "access", "hex", "novel")
_WORDS = r"(password|passwd|secret|token|api_?key)"
ASSIGN = re.compile(_WORDS + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LEAST = 12

#: Words that make strings sensitive that start within CONTEXT characters after them or end within as many before.
SENSITIVE = (b"password", b"passwd", b"pwd", b"secret", b"token", b"api_key", b"apikey", b"api-key", b"credential", b"private_key", b"private key", b"bearer", b"authorization", b"access key", b"access_key")
_SENSITIVE = re.compile("|".join(re.escape(x.decode()) for x in SENSITIVE), re.IGNORECASE | re.ASCII)
CONTEXT = 64
CANDIDATE_LEAST = 16
#: Runs that hold candidates: '=' is padding at their end, anywhere else it separates.
_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{14,}(?:={1,2}(?![A-Za-z0-9+/_=-]))?")
#: Marginal compressed bytes a character from which a string is novel: random strings stay literals and cost 1.
NOVELTY = 0.9
#: The same for letters of one case alone, which long words of a text are too.
PLAIN_NOVELTY = 1.0
#: Strings without a digit need so large a share of either case; names in camel case have fewer capitals.
CASE_SHARE = 0.3

#: Words of code that are not secrets.
CODE_WORDS = (
    "import from return function class public private static void const string number boolean undefined null true false self this lambda async await export default require module package "
    "username password hash reset token generator access secret refresh client api key name configuration environment variable example placeholder changeme your here xxxxxxxxxxxxxxxx "
    "authentication authorization credentials connection request response session header content type application json abstract factory builder element listener service manager handler controller "
    "account settings retry database server provider repository validate validator customer user profile singleton proxy internal external"
)
#: Standard modules whose names make the dictionary.
MODULES = ("argparse", "ast", "asyncio", "base64", "collections", "configparser", "datetime", "decimal", "email", "functools", "hashlib", "http.client", "http.server", "inspect", "json", "logging", "os", "pathlib", "pickle", "platform", "re", "shutil", "socket", "sqlite3", "ssl", "string", "subprocess", "tarfile", "threading", "unittest", "urllib.parse", "urllib.request", "uuid", "xml.dom.minidom", "zipfile")
#: Most frequent words of a corpus that the dictionary takes, and their letters.
LEARNED = 4000
LEARNED_LETTERS = (5, 24)
_PART = re.compile("[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def name_parts() -> list[str]:
    """Parts of three letters and more, lowered, of all names in the sources of MODULES."""
    names: set[str] = set()
    for m in MODULES:
        for node in ast.walk(ast.parse(inspect.getsource(importlib.import_module(m)))):
            names |= {getattr(node, k, None) for k in ("name", "id", "attr", "arg")}
    return sorted({p.lower() for n in names if isinstance(n, str) for p in _PART.findall(n) if len(p) >= 3})


@lru_cache(1)
def base_dictionary() -> bytes:
    """Every part as identifiers spell and join it: capital with underscores, capital at the head, small with underscores."""
    parts = sorted(set(name_parts()) | set(CODE_WORDS.split()))
    return " ".join(["_".join(p.upper() for p in parts), "".join(p.capitalize() for p in parts), "_".join(parts)]).encode()


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the words of a task's texts without a sensitive word."""
    known: dict[int, bytes] = {}
    keys, sums = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    least, most = LEARNED_LETTERS

    def rows() -> Iterator[pa.RecordBatch]:
        said = [known.get(h) for h in keys.tolist()]
        kept = [(w.decode(), int(n)) for w, n in zip(said, sums) if w]
        for k in range(0, len(kept), 50_000):
            part = kept[k : k + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in part]), pa.array([n for _, n in part], pa.int64())], ["word", "n"])

    for b in batches:
        texts = column(b, "text").cast(pa.binary())
        plain = [x is not None and not any(w in x.lower() for w in SENSITIVE) for x in texts.to_pylist()]
        w = Words(texts.filter(pa.array(plain, pa.bool_())), NOT_WORD)
        found, where, n = np.unique(w.hash, return_index=True, return_counts=True)
        for h, i in zip(found.tolist(), where.tolist()):
            if h not in known:
                word = w.word(i)
                known[h] = word if least <= len(word) <= most and word.isalpha() and word.isascii() else b""
        both, inverse = np.unique(np.concatenate([keys, found]), return_inverse=True)
        keys, sums = both, np.bincount(inverse, np.concatenate([sums, n]), len(both)).astype(np.int64)
        if len(keys) > 400_000:  # bounded memory: what was counted goes on
            yield from rows()
            keys, sums = keys[:0], sums[:0]
            known.clear()
    yield from rows()


def learn(docs: DataFrame) -> bytes:
    """The dictionary's part from a corpus: its LEARNED most frequent words (some 30 KB)."""
    tune(docs.sparkSession)
    counts = docs.select("text").mapInArrow(task(_word_counts), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return " ".join(r.word for r in counts.orderBy(F.desc("n"), "word").limit(LEARNED).collect()).encode()


@lru_cache(2)
def _compressor(learned: bytes) -> zstandard.ZstdCompressor:
    # the fast strategy with a target length codes no literals; matches under 4 bytes are not sought
    how = zstandard.ZstdCompressionParameters(window_log=20, hash_log=19, chain_log=19, search_log=1, min_match=4, target_length=1, strategy=zstandard.STRATEGY_FAST, write_content_size=False, write_checksum=False)
    primed = zstandard.ZstdCompressionDict(learned + b" " + base_dictionary(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    primed.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(compression_params=how, dict_data=primed)


def novelty(before: str, candidate: str, after: str = "", learned: bytes = b"") -> float:
    """Marginal compressed bytes of the candidate a character, given its surroundings."""
    cost = lambda data: len(_compressor(learned).compress(data))
    around = (before + "\n" + after).encode("utf-8", "replace")
    # the surroundings come twice, so that they cost nothing new beside the candidate; the zeros after it keep
    # both blocks compressible, and the surroundings away from a block's last bytes, where no match is sought
    base, rest = around + b"\n" + around, bytes(64)
    return max(0, cost(base + candidate.encode("utf-8", "replace") + rest) - cost(base + rest)) / max(1, len(candidate))


def mixed(word: str) -> bool:
    """Digits with letters, letters of both cases in some balance, or letters of one case alone."""
    lower, upper = len(re.findall(r"[a-z]", word)), len(re.findall(r"[A-Z]", word))
    return bool(lower or upper) if re.search(r"[0-9]", word) else min(lower, upper) >= CASE_SHARE * len(word) or max(lower, upper) == len(word)


def base_spans(text: str, low: bytes | None = None) -> list[tuple[str, int, int]]:
    low = text.encode("utf-8", "replace").lower() if low is None else low
    out = []
    if any(w in low for w in (b"password", b"passwd", b"secret", b"token", b"api")):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if b"akia" in low:
        out += [("access", *m.span()) for m in ACCESS.finditer(text)]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def candidates(text: str, words: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Spans of the runs, cut at sensitive words joined to them; a run without a long enough part stays whole."""
    k = 0
    for run in _RUN.finditer(text):
        start, end = run.span()
        while k < len(words) and words[k][1] <= start:
            k += 1
        parts, at, j = [], start, k
        while j < len(words) and words[j][0] < end:
            a, b = words[j]
            before, after = a > start and text[a - 1] in "_-", text[b : b + 1] in ("_", "-")
            # letters in a random string may spell a word: it counts at the start or beside a separator
            if a <= start or before or after:
                parts.append((at, a - before))
                at = b + after
            j += 1
        parts = [(a, b) for a, b in [*parts, (at, end)] if b - a >= CANDIDATE_LEAST]
        yield from parts or [(start, end)] * (end - start >= CANDIDATE_LEAST)


def novel_spans(text: str, low: bytes, taken: list[tuple[str, int, int]], learned: bytes = b"") -> list[tuple[str, int, int]]:
    if not any(w in low for w in SENSITIVE):
        return []
    words = [s.span() for s in _SENSITIVE.finditer(text)]
    starts, ends = [a for a, _ in words], [b for _, b in words]
    out = []
    for start, end in candidates(text, words):
        after, before = bisect_right(ends, start), bisect_left(starts, end)
        if not (after and start - ends[after - 1] <= CONTEXT or before < len(starts) and starts[before] - end <= CONTEXT):
            continue
        if any(a <= start and end <= b for _, a, b in taken):
            continue
        word = text[start:end]
        least = PLAIN_NOVELTY if word.isalpha() and (word.islower() or word.isupper()) else NOVELTY
        if mixed(word) and novelty(text[max(0, start - CONTEXT) : start], word, text[end : end + CONTEXT], learned) >= least:
            out.append(("novel", start, end))
    return out


def scan(data: bytes, learned: bytes = b"") -> tuple[str, list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Text, base spans, all spans."""
    text, low = data.decode("utf-8", "replace"), data.lower()
    base = base_spans(text, low)
    every = sorted(base + novel_spans(text, low, base, learned), key=lambda s: (s[1], KINDS.index(s[0])))
    return text, base, every


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def digest(data: bytes, learned: bytes = b"") -> tuple[int, int, int, str, str]:
    _, base, every = scan(data, learned)
    n = {k: sum(s[0] == k for s in base) for k in KINDS}
    return n["assign"], n["access"], n["hex"], hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)


def redact(data: bytes, mark: str = "[REDACTED]", learned: bytes = b"") -> str | None:
    """The text with every span replaced; overlapping spans become one mark. None: nothing was found."""
    text, _, every = scan(data, learned)
    if not every:
        return None
    out, at = [], 0
    for _, a, b in every:
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]])
