"""Fields, channels, weights and schemas shared by the engine."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

FIELDS = ("title", "description", "ingredients", "instructions", "categories", "cooking_method")
CHANNELS = ("normalized", "accentless")
LISTS = ("ingredients", "instructions", "categories")
INDEX_VERSION = 3

_S, _I, _A = T.StringType(), T.IntegerType(), T.ArrayType(T.StringType())
RECIPE = T.StructType(
    [T.StructField(n, _S) for n in ("doc_id", "title", "url", "source", "description")]
    + [T.StructField(n, _A) for n in LISTS]
    + [T.StructField("cooking_method", _S), T.StructField("prep_time_minutes", _I), T.StructField("cook_time_minutes", _I)]
    + [T.StructField(n, _S) for n in ("servings", "difficulty", "image_url", "crawled_at", "content_hash")]
)
REQUIRED = ("doc_id", "title", "url", "source")
#: Accepted on input and dropped: they are derived.
DERIVED = ("total_time_minutes",)

TFIDF_WEIGHTS = {"title": 3.0, "ingredients": 2.0, "categories": 1.5, "cooking_method": 1.5, "description": 1.0, "instructions": 1.0}
BM25F_B = {"title": 0.3, "description": 0.75, "ingredients": 0.6, "instructions": 0.75, "categories": 0.3, "cooking_method": 0.2}


@dataclass(frozen=True)
class Bm25f:
    """Parameters of the BM25F ranker."""

    k1: float = 1.2
    phrase: float = 2.0
    proximity: float = 1.0
    weights: dict = field(default_factory=lambda: dict(TFIDF_WEIGHTS))
    b: dict = field(default_factory=lambda: dict(BM25F_B))

    def __post_init__(self):
        if self.k1 <= 0:
            raise ValueError("k1 must be positive")
        if self.phrase < 0 or self.proximity < 0:
            raise ValueError("boosts must not be negative")
        if any(w <= 0 for w in self.weights.values()):
            raise ValueError("field weights must be positive")
        if any(not 0 <= b <= 1 for b in self.b.values()):
            raise ValueError("field b must lie between 0 and 1")


@dataclass(frozen=True)
class Filters:
    """Structured search filters; empty ones do nothing."""

    max_time_minutes: int | None = None
    difficulty: str | None = None
    categories: tuple[str, ...] = ()
    ingredients: tuple[str, ...] = ()
    cooking_methods: tuple[str, ...] = ()

    def __post_init__(self):
        if self.max_time_minutes is not None and self.max_time_minutes < 0:
            raise ValueError("max_time_minutes must not be negative")

    def to_dict(self) -> dict:
        return {"max_time_minutes": self.max_time_minutes, "difficulty": self.difficulty, "categories": list(self.categories), "ingredients": list(self.ingredients), "cooking_methods": list(self.cooking_methods)}

    @property
    def active(self) -> bool:
        return self.max_time_minutes is not None or bool(self.difficulty or self.categories or self.ingredients or self.cooking_methods)
