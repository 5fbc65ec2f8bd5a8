"""Comparisons of a field with a constant."""

from __future__ import annotations

import operator
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The names of the comparisons in plans.
COMPARISONS: dict[str, Callable[[Any, Any], Any]] = {
    "Equal": operator.eq,
    "NotEqual": operator.ne,
    "Greater": operator.gt,
    "GreaterOrEqual": operator.ge,
    "Less": operator.lt,
    "LessOrEqual": operator.le,
}


def comparison(name: str) -> Callable[[Any, Any], Any]:
    if name not in COMPARISONS:
        raise ValueError(f"unknown comparison: {name}")
    return COMPARISONS[name]


def threshold(value: Any, kind: T.DataType) -> Column:
    """The constant as the column's type, so that the comparison reaches the scan. Dates and
    times compare without a zone where the column has none."""
    if isinstance(value, str) and not isinstance(kind, T.StringType):
        return F.lit(value).cast(kind)
    return F.lit(value)


def compares(values: Column, kind: T.DataType, name: str, value: Any) -> Column:
    """The predicate; text is compared with a date or a number as one of those."""
    return comparison(name)(values, threshold(value, kind))
