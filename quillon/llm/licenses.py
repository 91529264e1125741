"""License scans by fuzzy search for short notices.

Base labels are exact word phrases. The method finds more: a notice with at most k errors holds one
of k + 1 pieces of it unchanged (pigeonhole), so an Aho-Corasick automaton over all pieces gives the
places where the regex library's bounded-error matching is tried; it verifies the edits and reports
the span. Both work on the normalised text: words in lower case, one space between.

Defined results: a null or empty text has no words, no place, null first and last word, empty labels
and score 0; repeated rows agree; extra columns are not read; an empty table gives an empty result;
very long texts are searched whole.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

#: Exact phrases and their labels (fixed values).
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Notices searched with errors, and their labels: the usual short statements of well-known licences.
NOTICES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the apache license version 2 0": "apache-2",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "licensed under the gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "redistribution and use in source and binary forms with or without modification": "bsd",
    "released under the bsd license": "bsd",
    "mozilla public license version 2 0": "mpl-2",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution 4 0 international": "cc-by",
    "dedicated to the public domain": "public-domain",
    "all rights reserved": "all-rights-reserved",
}
#: Errors allowed: one for every so many characters of a notice.
CHARS_PER_ERROR = 12

_WORDS = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 97 + b - 65 if 65 <= b <= 90 else 32 for b in range(256))


def normalise(data: bytes) -> tuple[str, int]:
    """Words in lower case with a space around each, and their number."""
    words = data.translate(_WORDS).split(b" ")
    words = [w for w in words if w]
    return f" {b' '.join(words).decode('utf-8', 'replace')} ", len(words)


def _pieces(notice: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces of equal length, with their offsets."""
    cuts = [len(notice) * i // (k + 1) for i in range(k + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


@lru_cache(1)
def _search():
    import ahocorasick
    import regex

    automaton, seeds = ahocorasick.Automaton(), {}
    patterns = []
    for i, (notice, label) in enumerate(NOTICES.items()):
        k = len(notice) // CHARS_PER_ERROR
        patterns.append((regex.compile(f"(?b)(?:{regex.escape(notice, literal_spaces=True)}){{e<={k}}}"), notice, label, k))
        for at, piece in _pieces(notice, k):
            seeds.setdefault(piece, []).append((i, at))
    for piece, places in seeds.items():
        automaton.add_word(piece, (len(piece), places))
    automaton.make_automaton()
    return automaton, patterns


#: A stretch of seeds is searched in blocks of so many lengths of the notice.
BLOCK = 6


def _best_first(text: str, a: int, b: int, pattern, least: int) -> list[tuple[int, int, int]]:
    """(start, end, edits) of the places in a short stretch: the best, then those before and after it."""
    found, spans = [], [(a, b)]
    while spans:
        a, b = spans.pop()
        m = pattern.search(text, a, b) if b - a >= least else None
        if m:
            found.append((m.start(), m.end(), sum(m.fuzzy_counts)))
            spans += [(a, m.start()), (m.end(), b)]
    return sorted(found)


def _places(text: str, a: int, b: int, pattern, notice: str, k: int) -> Iterator[tuple[int, int, int]]:
    """The places in a stretch of any length, in time that grows with it: it is searched block by block. A place near a
    block's end, which what follows could better, is left to the next block."""
    least, most = len(notice) - k, len(notice) + k
    while b - a >= least:
        end = min(b, a + BLOCK * most)
        found = _best_first(text, a, end, pattern, least)
        sure = found if end == b else [f for f in found if f[1] <= end - most]
        yield from sure
        a = b if end == b else max(end - 2 * most, sure[-1][1] if sure else a + most)


def fuzzy(text: str) -> list[tuple[str, int, int, int]]:
    """(label, start, end, edits) in the normalised text, one for each separate place of a notice."""
    automaton, patterns = _search()
    tried: dict[int, list[tuple[int, int]]] = {}
    for end, (length, places) in automaton.iter(text):
        for i, at in places:
            start = end - length + 1 - at
            k, n = patterns[i][3], len(patterns[i][1])
            tried.setdefault(i, []).append((max(0, start - k), min(len(text), start + n + k)))
    found = []
    for i, windows in tried.items():
        pattern, notice, label, k = patterns[i]
        spans: list[list[int]] = []
        for a, b in sorted(windows):
            if spans and a <= spans[-1][1]:
                spans[-1][1] = max(b, spans[-1][1])
            else:
                spans.append([a, b])
        found += [(label, *f) for a, b in spans for f in _places(text, a, b, pattern, notice, k)]
    # of overlapping places, the one with the fewest edits, then the longest, tells the notice
    kept: list[tuple[str, int, int, int]] = []
    for f in sorted(found, key=lambda f: (f[1], f[0])):
        if kept and f[1] < kept[-1][2]:
            if (f[3], kept[-1][2] - kept[-1][1]) < (kept[-1][3], f[2] - f[1]):
                kept[-1] = f
        else:
            kept.append(f)
    return kept


class Numbering:
    """Numbers of the words of a normalised text by their places; the spaces are listed once, if anything asks."""

    def __init__(self, text: str):
        self.text = text
        self.spaces: list[int] | None = None

    def before(self, at: int) -> int:
        """Spaces before a place."""
        if self.spaces is None:
            self.spaces = [m.start() for m in re.finditer(" ", self.text)]
        return bisect_left(self.spaces, at)


def base_places(text: str, number: Numbering) -> list[tuple[str, int]]:
    """(label, word index) of every place where a phrase's words stand consecutively."""
    out = []
    for phrase, label in PHRASES.items():
        needle, at = f" {phrase} ", -1
        while (at := text.find(needle, at + 1)) >= 0:
            out.append((label, number.before(at)))
    return out


def scan(data: bytes) -> tuple[int, int, int | None, int | None, str, str, float, str]:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, spans (label:word:word:edits)."""
    text, n = normalise(data)
    number = Numbering(text)
    base = base_places(text, number)
    more = fuzzy(text)
    at = [w for _, w in base]
    labels = {x for x, _ in base}
    best = max([1.0] * bool(base) + [1 - e / max(1, b - a) for _, a, b, e in more], default=0.0)
    # words that a span touches, in the text's own numbering
    spans = ",".join(f"{x}:{max(0, number.before(a + 1) - 1)}:{number.before(max(a + 1, b - 1))}:{e}" for x, a, b, e in more)
    return n, len(base), min(at, default=None), max(at, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | {x[0] for x in more})), best, spans
