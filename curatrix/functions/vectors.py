"""Vector similarity as a Column. [T14, T15]"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)


def cosine(a: Column, b: Column) -> Column:
    """[T14] Cosine of two equally long vectors; 0 if one has no length."""
    norms = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.coalesce(_dot(a, b) / F.nullif(norms, F.lit(0.0)), F.lit(0.0))


def semantic_or_lexical(a: Column, b: Column, lexical: Column) -> Column:
    """[T15] Cosine where both vectors are there, else the lexical score."""
    return F.when(a.isNotNull() & b.isNotNull(), cosine(a, b)).otherwise(lexical)
