"""Columns over vectors held as arrays, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(left: Column, right: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(left), doubles(right), lambda a, b: a * b), F.lit(0.0), lambda at, x: at + x)


def norm(vector: Column) -> Column:
    return F.sqrt(dot(vector, vector))


def cosine(left: Column, right: Column) -> Column:
    return dot(left, right) / (norm(left) * norm(right))


def truncated(vector: Column, size: int) -> Column:
    """The first components, brought to unit length again."""
    head = F.slice(doubles(vector), 1, size)
    return F.transform(head, lambda x: x / norm(head))


def finite(vector: Column) -> Column:
    return F.forall(doubles(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
