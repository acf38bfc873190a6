"""Vector functions (OP-F14, OP-F15)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a, b) -> Column:
    products = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine(a, b) -> Column:
    """OP-F15. Double precision; null for zero vectors."""
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def cosine_at_least_zero(a, b) -> Column:
    return F.greatest(cosine(a, b), F.lit(0.0))


def vector_literal(values, dims: int) -> Column:
    """OP-F14. [x,y,...] with six significant digits; a vector of another length raises."""
    checked = F.when(F.size(_c(values)) == dims, _c(values)).otherwise(F.raise_error(F.lit(f"a vector needs {dims} numbers")))
    number = lambda x: F.regexp_replace(F.format_string("%.6g", x.cast("double")), r"(\.[0-9]*?)0+(e|$)", "$1$2")
    return F.concat(F.lit("["), F.array_join(F.transform(checked, lambda x: F.regexp_replace(number(x), r"\.(e|$)", "$1")), ","), F.lit("]"))
