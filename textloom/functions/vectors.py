"""Vectors, logits and rates as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-8


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a: Column | str, b: Column | str) -> Column:
    """In double precision, summed in order."""
    pairs = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def normalized(v: Column | str) -> Column:
    """Divided by its length and a small number, so that a zero vector stays zero."""
    v = _c(v)
    size = F.sqrt(dot(v, v)) + EPSILON
    return F.transform(v, lambda x: x.cast("double") / size)


def cosine(a: Column | str, b: Column | str) -> Column:
    return dot(normalized(a), normalized(b))


def softmax(logits: Column | str) -> Column:
    """Shifted by the maximum, so that no exponential overflows."""
    x = _c(logits)
    grown = F.transform(x, lambda v: F.exp(v - F.array_max(x)))
    return F.transform(grown, lambda v: v / F.aggregate(grown, F.lit(0.0), lambda s, y: s + y))


def argmax(values: Column | str) -> Column:
    """The place (from 0) of the first maximum."""
    v = _c(values)
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def percent(n: Column | str, total: Column | str) -> Column:
    """With one decimal and a percent sign; N/A of nothing."""
    n, total = _c(n), _c(total)
    rate = F.round(n / F.nullif(total, F.lit(0)) * 100, 1)
    return F.when(total == 0, "N/A").otherwise(F.concat(F.format_string("%.1f", rate), F.lit("%")))


def f_beta(precision: Column | str, recall: Column | str, beta: float) -> Column:
    p, r, b = _c(precision), _c(recall), beta * beta
    return F.when(p + r > 0, (1 + b) * p * r / (b * p + r)).otherwise(0.0)
