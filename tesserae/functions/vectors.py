"""Vector arithmetic as column expressions. Elements are widened to double before they are multiplied and summed in order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _same_length(a: Column, b: Column, value: Column) -> Column:
    return F.when(F.size(a) == F.size(b), value).when(a.isNull() | b.isNull(), F.lit(None)).otherwise(
        F.raise_error(F.concat(F.lit("vectors differ in length: "), F.size(a), F.lit(" and "), F.size(b)))
    )


def _total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _same_length(a, b, _total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))))


def magnitude(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector has no length."""
    norms = magnitude(a) * magnitude(b)
    return F.when(norms == 0, F.lit(0.0)).otherwise(dot(a, b) / norms)


def euclidean(a: Column, b: Column) -> Column:
    def square(x: Column, y: Column) -> Column:
        d = x.cast("double") - y.cast("double")
        return d * d

    return F.sqrt(_same_length(a, b, _total(F.zip_with(a, b, square))))


def normalized(a: Column) -> Column:
    """Divided by its magnitude where that is above 0."""
    m = magnitude(a)
    return F.when(m > 0, F.transform(a, lambda x: x.cast("double") / m)).otherwise(F.transform(a, lambda x: x.cast("double")))


def rounded(x: Column, digits: int = 6) -> Column:
    """Rounded, half away from zero; a negative number that rounds to nothing stays -0.0, as in IEEE arithmetic (Spark's ``round`` drops the sign)."""
    out = F.round(x, digits)
    return F.when(out == 0, x * F.lit(0.0)).otherwise(out)


def problem(a: Column) -> Column:
    """Why a vector can't be indexed: 'empty', 'not finite', 'all zero', 'too short'; null if it can."""
    finite = F.forall(a, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return (
        F.when(a.isNull() | (F.size(a) == 0), "empty").when(~finite, "not finite")
        .when(F.forall(a, lambda x: x == 0), "all zero").when(magnitude(a) < 1e-6, "too short")
    )


def off_unit(a: Column, tolerance: float = 0.01) -> Column:
    return F.abs(magnitude(a) - 1) > tolerance
