"""Text normalisation and tokens as Column expressions."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..storage import short_batches

#: What counts as white space, the same set as in Python's str.split.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]+"
TOKEN = r"[\p{L}\p{N}]+"
#: Characters that may change under composition: marks, jamo, and singletons found below.
_MARKS = r"[\p{M}ᄀ-ᇿ"

#: Holds every character that composition may change, and of those that it never does the commonest are left out: Latin,
#: Vietnamese, quotation marks and dashes, the euro.
_UNUSUAL = r"[\u0300-\u1E9F\u1EFA-\u200F\u2028-\u20A9\u20AD-\x{10FFFF}]"

#: Stopwords of queries (fixed values).
STOPWORDS = (
    "bị bởi các cho có của cùng đã đang để đến được khi là lại làm một những này nên ra rồi sau sẽ theo thì trên trong từ và vào với"
).split()


@lru_cache(1)
def accent_table() -> tuple[str, str]:
    """Arguments for translate: letters to their base letter, then the marks to delete."""
    source, target, gone = ["đ", "Đ"], ["d", "D"], []
    for code in range(0x80, 0x10000):
        c = chr(code)
        if 0xD800 <= code < 0xE000 or c in "đĐ":
            continue
        if unicodedata.category(c) == "Mn":
            gone.append(c)
            continue
        base = unicodedata.normalize("NFC", "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn"))
        if base != c and len(base) == 1:
            source.append(c)
            target.append(base)
    return "".join(source + gone), "".join(target)


@lru_cache(1)
def accent_map() -> dict[int, str | None]:
    """The same table for str.translate, where Python holds the text already."""
    source, target = accent_table()
    return {ord(c): target[i] if i < len(target) else None for i, c in enumerate(source)}


@lru_cache(1)
def _suspect() -> str:
    """Matches every text that composition (NFC) may change."""
    single = [c for c in map(chr, range(0x80, 0x10000)) if not 0xD800 <= ord(c) < 0xE000 and not unicodedata.category(c).startswith("M") and unicodedata.normalize("NFC", c) != c]
    runs: list[list[int]] = []
    for c in map(ord, single):
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return _MARKS + "".join(f"\\u{a:04X}-\\u{b:04X}" for a, b in runs) + r"\x{10000}-\x{10FFFF}]"


def normalize_unicode(text: Column, form: str = "NFC") -> Column:
    """Unicode normalisation; rows that NFC cannot change never reach Python."""
    if form not in ("NFC", "NFD", "NFKC", "NFKD"):
        raise ValueError(f"unknown normalization form {form!r}")

    @F.pandas_udf("string")
    def normal(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize(form, x))

    if form != "NFC":
        return normal(text)
    # a few ranges tell most texts before the many are tried
    return F.coalesce(normal(F.when(text.rlike(_UNUSUAL) & text.rlike(_suspect()), text)), text)


def composed_items(items: Column) -> Column:
    """Composed texts of a list, null as empty: one call for the whole list, since a lambda cannot call Python."""
    none = F.array().cast("array<string>")
    flat = F.transform(F.coalesce(items, none), lambda x: F.translate(F.coalesce(x, F.lit("")), "\x1e", " "))
    return F.when(F.size(flat) > 0, F.split(normalize_unicode(F.array_join(flat, "\x1e")), "\x1e")).otherwise(none)


def normalize_whitespace(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACE, " "))


def normalize_text(text: Column, lowercase: bool = True, compose: bool = True) -> Column:
    """Composed, single-spaced, lower-case text. compose=False trusts the input to be composed already."""
    spaced = normalize_whitespace(normalize_unicode(text) if compose else text)
    return F.lower(spaced) if lowercase else spaced


def strip_accents(text: Column) -> Column:
    source, target = accent_table()
    return F.translate(text, source, target)


def tokenize_normalized(norm: Column) -> Column:
    return F.regexp_extract_all(norm, F.lit(TOKEN), F.lit(0))


def tokenize(text: Column, compose: bool = True) -> Column:
    return tokenize_normalized(normalize_text(text, compose=compose))


def load_segmenter():
    """The word segmenter of an optional library, or None where it is not installed."""
    try:
        from underthesea import word_tokenize
    except ImportError:
        return None
    return word_tokenize


def segmented(segmenter, text: str | None) -> list[str]:
    """Words of a custom segmenter, which gives a spaced string or a list; spaces inside a word become _."""
    got = segmenter(text) if text else ""
    words = got.split() if isinstance(got, str) else list(got)
    clean = ("_".join(unicodedata.normalize("NFC", w).split()).lower() for w in words)
    return [w for w in clean if w]


def tokenize_with(segmenter, norm: Column) -> Column:
    """Tokens of a custom segmenter (a Python function from normalised text to words)."""
    short_batches(SparkSession.getActiveSession())

    @F.pandas_udf("array<string>")
    def words(s: pd.Series) -> pd.Series:
        return s.map(lambda x: segmented(segmenter, x))

    return words(norm)


def search_forms(text: Column, compose: bool = True) -> Column:
    norm = normalize_text(text, compose=compose)
    return F.struct(norm.alias("normalized"), strip_accents(norm).alias("accentless"))


def ranking_terms(tokens: Column, stopwords: list[str] = STOPWORDS) -> Column:
    """Tokens that are no stopword, neither as they stand nor without accents."""
    stops = F.array(*[F.lit(w) for w in stopwords])
    return F.filter(tokens, lambda t: ~F.array_contains(stops, t) & ~F.array_contains(stops, strip_accents(t)))


def comparison_form(text: Column, compose: bool = True) -> Column:
    return F.btrim(strip_accents(normalize_text(text, compose=compose)), F.lit(" :.-"))


def search_form(text: Column, compose: bool = True) -> Column:
    return strip_accents(normalize_text(F.coalesce(text.cast("string"), F.lit("")), compose=compose))


def clean_text(text: Column) -> Column:
    return normalize_whitespace(F.coalesce(text, F.lit("")))


def deduplicate_texts(values: Column) -> Column:
    """First of each text that differs beyond case and spacing; bullets at the ends go, blanks too. Linear in a list's length."""
    short_batches(SparkSession.getActiveSession())

    @F.pandas_udf("array<string>")
    def once(lists: pd.Series) -> pd.Series:
        def firsts(items) -> list[str]:
            seen: dict[str, str] = {}
            for x in () if items is None else items:
                if x and (clean := " ".join(x.split()).strip(" -–•")):
                    seen.setdefault(unicodedata.normalize("NFC", clean).lower(), clean)
            return list(seen.values())

        return lists.map(firsts)

    return once(values)


def field_text(field: str, kind: str) -> Column:
    """A document field as one text: list items on lines of their own, null as empty."""
    c = F.col(field)
    return F.array_join(c, "\n") if kind.startswith("array") else F.coalesce(c, F.lit(""))


def optional(text: Column) -> Column:
    """Blank text as null."""
    return F.nullif(text, F.lit(""))


def searchable_text(scalars: list[str], lists: list[str]) -> Column:
    parts = [optional(F.col(c)) for c in scalars] + [optional(F.array_join(F.col(c), " ")) for c in lists]
    return F.concat_ws("\n", *parts)
