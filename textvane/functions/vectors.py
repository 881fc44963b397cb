"""Expressions over array<double> vectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def cosine(a: Column, b: Column) -> Column:
    """1 minus the cosine of the angle; 1 when a vector is zero."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return 1 - F.when(size == 0, 0.0).otherwise(dot(a, b) / size)


DISTANCES: dict[str, Callable[[Column, Column], Column]] = {"euclidean": euclidean, "cosine": cosine}


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))
