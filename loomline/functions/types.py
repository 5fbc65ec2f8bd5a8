"""Field types by name, and how text becomes values of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The type names that plans and schemas may use.
FIELD_TYPES: dict[str, T.DataType] = {
    "boolean": T.BooleanType(),
    "byte": T.ByteType(),
    "char": T.StringType(),
    "short": T.ShortType(),
    "int": T.IntegerType(),
    "long": T.LongType(),
    "bigint": T.DecimalType(38, 0),
    "bigdecimal": T.DecimalType(38, 18),
    "float": T.FloatType(),
    "double": T.DoubleType(),
    "string": T.StringType(),
    "other": T.StringType(),
    "instant": T.TimestampType(),
    "localdate": T.DateType(),
    "date": T.DateType(),
    "datetime": T.TimestampNTZType(),
    "binary": T.BinaryType(),
}


def field_type(name: str) -> T.DataType:
    """The Spark type of a field type's name; ``bigdecimal(p,s)`` states its precision."""
    key = name.strip().lower()
    if key.startswith("bigdecimal("):
        precision, scale = (int(x) for x in key[11:].rstrip(")").split(","))
        return T.DecimalType(precision, scale)
    if key not in FIELD_TYPES:
        raise ValueError(f"unknown field type: {name}")
    return FIELD_TYPES[key]


def schema_of(fields: list[tuple[str, str]] | list[str] | int) -> T.StructType:
    """A schema from (name, type) pairs, from types alone (names _c0, _c1, ...), or from a
    number of text fields."""
    if isinstance(fields, int):
        fields = ["string"] * fields
    pairs = [f if isinstance(f, tuple | list) else (f"_c{i}", f) for i, f in enumerate(fields)]
    return T.StructType([T.StructField(n, field_type(t)) for n, t in pairs])


def parsed(text: Column, name: str) -> Column:
    """A text column as values of the type: null stays null, a bad value raises."""
    if name.strip().lower() == "char":
        return F.substring(text, 1, 1)
    if name.strip().lower() == "boolean":
        low = F.lower(F.trim(text))
        wrong = F.raise_error(F.concat(F.lit("not a boolean: "), text)).cast("boolean")
        return F.when(low == "true", True).when(low == "false", False).when(text.isNotNull(), wrong)
    return text.cast(field_type(name))
