"""Helpers for expressions over arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once per row.

    The optimizer may put a column's expression in its place inside a lambda, where it would
    be computed again for each element; a lambda variable stays what it is.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def places(start: Column, end: Column) -> Column:
    """Whole numbers from ``start`` up to and without ``end``; none if there are none."""
    return F.when(start < end, F.sequence(start, end - 1)).otherwise(F.array().cast("array<int>"))
