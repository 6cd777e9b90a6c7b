"""Vector columns: keyless embedders and cosine arithmetic."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from vocara.functions.text import word_set

# Similarities are compared at this many decimals, so that neither the order of
# additions nor the block a row falls in can decide a tie.
SIM_DECIMALS = 9

HASHED_DIM = 256


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, also where ``use`` looks at it in a loop."""
    return F.transform(F.array(value), use)[0]


def presence_vector(text: Column, vocabulary: Sequence[str]) -> Column:
    """Which of the caller's words occur in the text, as a unit vector (zeros when none do)."""
    places = F.array(*[F.lit(w.lower()) for w in vocabulary])
    hit = _let(F.lower(text), lambda low: F.filter(places, lambda w: F.contains(low, w)))
    return _unit(hit, places)


def hashed_vector(text: Column, dim: int = HASHED_DIM) -> Column:
    """The words of the whole text hashed to ``dim`` places, as a unit vector of the places hit."""
    place = lambda w: F.pmod(F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("bigint"), F.lit(dim))
    places = F.sequence(F.lit(0).cast("bigint"), F.lit(dim - 1).cast("bigint"))
    return _unit(F.array_distinct(F.transform(word_set(text), place)), places)


def _unit(hit: Column, places: Column) -> Column:
    """The unit vector over ``places`` that is equal and positive where ``hit`` has the place."""
    weight = lambda h: F.when(F.size(h) > 0, 1 / F.sqrt(F.size(h))).otherwise(F.lit(0.0))
    spread = lambda h, w: F.transform(places, lambda p: F.when(F.array_contains(h, p), w).otherwise(F.lit(0.0)))
    return _let(hit, lambda h: _let(weight(h), lambda w: spread(h, w)))


def dot(left: Column, right: Column) -> Column:
    products = F.zip_with(left, right, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def cosine(left: Column, right: Column) -> Column:
    """Cosine of two vectors; 0 when either is all zeros."""
    norms = F.sqrt(dot(left, left) * dot(right, right))
    return F.round(F.when(norms == 0, F.lit(0.0)).otherwise(dot(left, right) / norms), SIM_DECIMALS)


def checked_vector(vector: Column, dim: int) -> Column:
    """The vector, or an error when its width is not the width of the index."""
    return F.when(F.size(vector) == dim, vector).otherwise(
        F.raise_error(F.concat(F.lit(f"expected a vector of width {dim}, got "), F.size(vector).cast("string")))
    )
