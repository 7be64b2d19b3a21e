"""Naming a value inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once.

    A Python variable that holds a column stands for its whole expression wherever it is used, and the optimizer merges
    projections, so nested uses grow without bound. The parameter of a lambda stands for a value.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
