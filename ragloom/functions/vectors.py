"""Dense-vector column helpers (Spark 4.1 has no vector/cosine builtin)."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ragloom.functions.text import col_


def as_double(c) -> Column:
    return F.transform(col_(c), lambda x: x.cast("double"))


def dot(a, b) -> Column:
    """Sum of element products, in DOUBLE."""
    prods = F.zip_with(as_double(a), as_double(b), lambda x, y: x * y)
    return F.aggregate(prods, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def l2_norm(c) -> Column:
    v = as_double(c)
    return F.sqrt(F.aggregate(F.transform(v, lambda x: x * x), F.lit(0.0).cast("double"), lambda a, x: a + x))


def l2_normalize(c) -> Column:
    """Unit-length copy; a zero vector stays zero."""
    v = as_double(c)
    n = l2_norm(c)
    return F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v)


def cosine(a, b) -> Column:
    den = l2_norm(a) * l2_norm(b)
    return F.when(den > 0, dot(a, b) / den).otherwise(F.lit(0.0))
