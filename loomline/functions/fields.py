"""References to fields, by place or by name, and names that stay unique."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Field = int | str


class FieldError(ValueError):
    """A reference to a field that the input doesn't have."""


def field_name(df: DataFrame, field: Field) -> str:
    """The column's name for a place (from 0) or a name."""
    if isinstance(field, bool) or not isinstance(field, int | str):
        raise FieldError(f"a field is a place or a name: {field!r}")
    if isinstance(field, int):
        if not 0 <= field < len(df.columns):
            raise FieldError(f"field {field} of {len(df.columns)}: {df.columns}")
        return df.columns[field]
    if field not in df.columns:
        raise FieldError(f"no field {field!r} in {df.columns}")
    return field


def column(df: DataFrame, field: Field) -> Column:
    return F.col(quoted(field_name(df, field)))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def unique_names(names: Iterable[str], taken: Iterable[str] = (), suffix: str = "_r") -> list[str]:
    """names, each with suffixes until it differs from those taken and those before it."""
    used, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in used:
            name += suffix
        used.add(name.lower())
        out.append(name)
    return out
