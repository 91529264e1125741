"""Quality rules as a short-circuit cascade.

Every rule has a function over a document's lazily computed measures. Each task tries all rules on
a systematic sample of its rows, one in SAMPLE_EVERY, which gives every rule's cost (seconds a
document) and selectivity (share rejected); rules run in order of rejection per cost and the first
that rejects ends the document's work. The order is planned anew whenever the sample has doubled. It
never changes a verdict, so that reruns agree though costs are measured by the clock.

Defined results: a null or empty text has no words, all counts 0, and fails; rows are judged one by
one, so repeated rows and ties get equal verdicts; extra columns are not read; an empty table gives
an empty result; very long texts are measured whole.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import column, task, texts, tune

#: One row of so many is tried on every rule; the order of rules alone depends on it.
SAMPLE_EVERY = 64

SYMBOLS = b"#*$%&|<>"
_SPACE_AND_TAIL = bytes(range(9, 14)) + b" " + bytes(range(0x80, 0xC0))
_UPPER = bytes(range(65, 91))
_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123))


class Measures:
    """Counts of one text, each computed on first use."""

    def __init__(self, text: bytes):
        self.text = text
        self._got: dict[str, int | list] = {}

    def __getattr__(self, name: str):
        if name.startswith("_") or name not in _MEASURES:
            raise AttributeError(name)
        if name not in self._got:
            self._got[name] = _MEASURES[name](self)
        return self._got[name]


def _lines(m: Measures) -> list[bytes]:
    return [x for x in m.text.split(b"\n") if x.strip()]


def _repeat_words(m: Measures) -> int:
    """Words that lie in a 3-word window which the text holds twice or more."""
    w = m.words
    if len(w) < 4:
        return 0
    grams = list(zip(w, w[1:], w[2:]))
    if len(set(grams)) == len(grams):
        return 0
    counts = Counter(grams)
    covered, upto = 0, 0
    for i, g in enumerate(grams):
        if counts[g] > 1:
            covered += i + 3 - max(i, upto)
            upto = i + 3
    return covered


_MEASURES: dict[str, Callable[[Measures], object]] = {
    "words": lambda m: m.text.split(),
    "n_words": lambda m: len(m.words),
    "word_chars": lambda m: len(m.text.translate(None, _SPACE_AND_TAIL)),
    "n_symbols": lambda m: len(m.text) - len(m.text.translate(None, SYMBOLS)),
    "lines": _lines,
    "n_dup_lines": lambda m: len(m.lines) - len(set(m.lines)),
    "n_repeat_words": _repeat_words,
    "n_upper": lambda m: len(m.text) - len(m.text.translate(None, _UPPER)),
    "n_letters": lambda m: len(m.text) - len(m.text.translate(None, _LETTERS)),
    "n_bangs": lambda m: m.text.count(b"!"),
}

#: name -> rejects(measures). Base rules first; the order of evaluation is found on a sample.
RULES: dict[str, Callable[[Measures], bool]] = {
    "too_short": lambda m: m.n_words < 50,
    "repeated_windows": lambda m: 100 * m.n_repeat_words > 50 * m.n_words,
    "symbols": lambda m: 10 * m.n_symbols > 3 * m.n_words,
    "repeated_lines": lambda m: 100 * m.n_dup_lines > 45 * len(m.lines),
    "upper_case": lambda m: 2 * m.n_upper > max(m.n_letters, 1),
    "bangs": lambda m: 4 * m.n_bangs > m.n_words,
    "word_length": lambda m: not 2 * m.n_words <= m.word_chars <= 20 * m.n_words,
}


class Cascade:
    """Rules in order of rejection per cost; both are estimated on a sample of the texts judged."""

    def __init__(self, rules: dict[str, Callable[[Measures], bool]] = RULES):
        self.rules = rules
        self.order = list(rules)
        self.rows = self.sampled = 0
        self.cost, self.hits = dict.fromkeys(rules, 0.0), dict.fromkeys(rules, 0)

    def sample(self, m: Measures) -> bool:
        """Measures every rule on a text by itself; the verdict."""
        kept = True
        for name, rejects in self.rules.items():
            alone = Measures(m.text)
            began = time.perf_counter()
            hit = bool(rejects(alone))
            self.cost[name] += time.perf_counter() - began
            self.hits[name] += hit
            kept = kept and not hit
        self.sampled += 1
        if self.sampled & (self.sampled - 1) == 0:  # plan anew whenever the sample has doubled
            self.order = sorted(self.rules, key=lambda n: (-self.hits[n] / max(self.cost[n], 1e-9), n))
        return kept

    def keeps(self, m: Measures) -> bool:
        """The verdict: the first rule that rejects ends the work on a text, unless it belongs to the sample."""
        self.rows += 1
        if (self.rows - 1) % SAMPLE_EVERY == 0:
            return self.sample(m)
        return not any(self.rules[name](m) for name in self.order)


def judge(docs: DataFrame, columns: list[str], counts: bool = False, rejected: bool = True) -> DataFrame:
    """The columns, the base counts if asked for, and kept; without the rows that a rule rejects if rejected is False."""
    tune(docs.sparkSession)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"] if counts else []
    read = columns if "text" in columns else [*columns, "text"]

    @task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cascade = Cascade()
        for b in batches:
            out: list[list] = [[] for _ in names]
            kept = []
            for x in texts(b):
                m = Measures(x)
                kept.append(cascade.keeps(m))
                for o, n in zip(out, names):
                    o.append(getattr(m, n))
            verdict = pa.array(kept, pa.bool_())
            arrays = [column(b, c) for c in columns] + [pa.array(o, pa.int64()) for o in out] + [verdict]
            made = pa.RecordBatch.from_arrays(arrays, [*columns, *names, "kept"])
            yield made if rejected else made.filter(verdict)

    kinds = dict(docs.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in columns] + [f"{n} bigint" for n in names] + ["kept boolean"])
    return docs.select(*read).mapInArrow(run, schema)
