"""Conditional breakpoints in batch form: rows that meet the condition leave the stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def condition(predicate: Column | str) -> Column:
    """The predicate as a column that is false, not null, where it can't tell."""
    made = F.expr(predicate) if isinstance(predicate, str) else predicate
    return F.coalesce(made, F.lit(False))


def split(df: DataFrame, predicate: Column | str) -> tuple[DataFrame, DataFrame]:
    """The rows that go on, and the rows that the breakpoint reports."""
    bad = condition(predicate)
    return df.filter(~bad), df.filter(bad)
