"""Vector arithmetic on array columns, inside whole-stage code (SCAL-72..74)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_column(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a, b) -> Column:
    """Inner product in double precision."""
    pairs = F.zip_with(as_column(a), as_column(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def unit(a) -> Column:
    """L2-normalised; a zero vector stays as it is."""
    a = as_column(a)
    # Through an array of one, the length is taken once a vector, not once a component.
    of_size = F.transform(F.array(norm(a)), lambda size: F.transform(a, lambda x: x.cast("double") / F.when(size == 0, 1.0).otherwise(size)))
    return F.get(of_size, 0)


def cosine(a, b) -> Column:
    """Cosine, 0 where either vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)


def hours(ts) -> Column:
    """Hours since the epoch as a double."""
    return F.unix_micros(as_column(ts).cast("timestamp")) / F.lit(3.6e9)
