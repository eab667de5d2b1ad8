"""Vector expressions over arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product over the common length; missing components count as 0."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x * y, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)


def normalized(v: Column) -> Column:
    """The unit vector; zero and non-finite vectors become zeros.  The norm is bound once, outside the loop over the components."""
    norm = F.array(F.sqrt(dot(v, v)))

    def unit(n: Column) -> Column:
        fine = ~F.isnan(n) & (n < float("inf"))
        return F.transform(v, lambda x: F.when(fine, F.coalesce(F.try_divide(x, n), F.lit(0.0))).otherwise(0.0))

    return F.get(F.transform(norm, unit), F.lit(0))
