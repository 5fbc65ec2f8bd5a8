"""The relational operators. Each states a logical plan only; the engine chooses scans,
exchanges and join strategies."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.functions.fields import Field, column, field_name, quoted, unique_names
from loomline.functions.predicates import compares


def keyword_match(df: DataFrame, field: Field, keyword: str) -> DataFrame:
    """Rows whose field holds the keyword, letter for letter; a null field holds nothing."""
    return df.filter(F.contains(column(df, field).cast("string"), F.lit(keyword)))


def where(df: DataFrame, field: Field, how: str, value: Any) -> DataFrame:
    """Rows whose field compares with value as the comparison's name says; nulls never do.
    A text field with a date as value is read as a time."""
    name = field_name(df, field)
    kind, values = df.schema[name].dataType, column(df, field)
    if isinstance(kind, T.StringType) and hasattr(value, "isoformat"):
        kind, values, value = T.TimestampNTZType(), values.cast("timestamp_ntz"), value.isoformat()
    return df.filter(compares(values, kind, how, value))


def project(df: DataFrame, fields: Sequence[Field]) -> DataFrame:
    """The fields in the order listed; one listed again gets a name of its own."""
    names = [field_name(df, f) for f in fields]
    return df.select(*[F.col(quoted(n)).alias(u) for n, u in zip(names, unique_names(names), strict=True)])


def hash_join(inner: DataFrame, outer: DataFrame, inner_field: Field, outer_field: Field) -> DataFrame:
    """Inner equi-join: all columns of outer, then those of inner without its key. Names of
    inner that outer has too get a suffix. Null keys match nothing."""
    renamed = unique_names(inner.columns, outer.columns)
    key = renamed[inner.columns.index(field_name(inner, inner_field))]
    inner = inner.toDF(*renamed)
    joined = outer.join(inner, column(outer, outer_field) == F.col(quoted(key)), "inner")
    return joined.select(*[F.col(quoted(c)) for c in (*outer.columns, *(c for c in renamed if c != key))])


def count_rows(df: DataFrame, name: str = "cnt") -> DataFrame:
    """One row with the number of rows, nulls included; 0 for none."""
    return df.agg(F.count(F.lit(1)).alias(name))


#: The names of the aggregates in plans.
AGGREGATES = ("Sum", "Max", "Min", "Average", "Count")


def group_by(df: DataFrame, key: Field, value: Field, how: str, name: str | None = None, as_text: bool = False, drop_null_groups: bool = False) -> DataFrame:
    """The key and one aggregate of one field. Sums and averages are doubles, counts are of
    values that aren't null, extremes have the field's own type and order: of texts, that of
    their letters, so "9" is after "10".

    as_text: the aggregate as the text of a double; extremes are those of the numbers that the
    values stand for. drop_null_groups: no row for a group without values."""
    if how not in AGGREGATES:
        raise ValueError(f"unknown aggregate: {how}")
    by, over = column(df, key), column(df, value)
    key_name = field_name(df, key)
    name = unique_names([name or f"{how.lower()}_{field_name(df, value)}"], [key_name])[0]
    if drop_null_groups:
        df = df.filter(over.isNotNull())
    numbers = over.cast("double")
    if as_text and how in ("Max", "Min"):
        over = numbers
    made = {"Sum": F.sum(numbers), "Average": F.avg(numbers), "Count": F.count(over), "Max": F.max(over), "Min": F.min(over)}[how]
    if as_text:
        made = made.cast("double").cast("string")
    return df.groupBy(by.alias(key_name)).agg(made.alias(name))


def sort_by(df: DataFrame, field: Field, as_text: bool = False) -> DataFrame:
    """Rows in ascending order of the field's own type, nulls first; as_text: of its text."""
    by = column(df, field)
    return df.orderBy((by.cast("string") if as_text else by).asc())


def identity(df: DataFrame) -> DataFrame:
    return df


def union_all(inputs: Sequence[DataFrame]) -> DataFrame:
    """The rows of all inputs by position; widths must agree."""
    if not inputs:
        raise ValueError("a union needs an input")
    if len({len(df.columns) for df in inputs}) > 1:
        raise ValueError(f"inputs differ in width: {[df.columns for df in inputs]}")
    return reduce(DataFrame.union, inputs)
