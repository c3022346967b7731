"""Vector expressions over array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(a: Column) -> Column:
    """Of length 1; a vector of zeros is an error."""
    size = norm(a)
    return F.when(size > 0, F.transform(a, lambda x: x.cast("double") / size)).otherwise(F.raise_error(F.lit("a vector of zeros has no direction")))


def same_size(a: Column, b: Column) -> Column:
    """a, or an error where the sizes differ."""
    return F.when(F.size(a) == F.size(b), a).otherwise(F.raise_error(F.concat(F.lit("vectors of "), F.size(a).cast("string"), F.lit(" and "), F.size(b).cast("string"), F.lit(" numbers"))))


def rescaled(x: Column, base: Column) -> Column:
    return (x - base) / (1 - base)


def wilson(successes: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Both ends of the Wilson interval of a share; null for n = 0."""
    n = F.when(n > 0, n.cast("double"))
    p = successes / n
    scale = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / scale
    radius = F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) * z / scale
    # a bare greatest() or least() would take the other bound for a null
    return F.when(n.isNotNull(), F.greatest(F.lit(0.0), centre - radius)), F.when(n.isNotNull(), F.least(F.lit(1.0), centre + radius))
