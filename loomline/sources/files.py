"""Delimited and Parquet scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.functions.fields import Field, column
from loomline.functions.types import parsed, schema_of

#: Upper bound on the fields of a line when neither schema nor a first line tells.
PROBE_LINES = 1


def scan_delimited(spark: SparkSession, path: str, delimiter: str, keep: list[int] | None = None, fields: list | int | None = None, drop_empty: bool = False, host: str = "") -> DataFrame:
    """Lines of one file or folder, cut at a one-character delimiter.

    No header, quotes, escapes or comments; an empty field is null; a blank line is skipped;
    the last line counts without a line end too. fields: types, (name, type) pairs or the
    number of text fields; without it all are text and their number is the first line's.
    keep: places of the fields to read, given in file order. drop_empty: leave out rows whose
    kept fields are all empty.
    """
    if len(delimiter) != 1:
        raise ValueError(f"a delimiter is one character: {delimiter!r}")
    target = f"{host.rstrip('/')}/{path.lstrip('/')}" if host else path
    if fields is None:
        first = spark.read.text(target).filter(F.length("value") > 0).limit(PROBE_LINES).collect()
        fields = first[0].value.rstrip("\r").count(delimiter) + 1 if first else 1
    named = schema_of(fields)
    texts = T.StructType([T.StructField(f.name, T.StringType()) for f in named])
    rows = spark.read.schema(texts).options(sep=delimiter, quote="", escape="", comment="", mode="PERMISSIVE", header=False, lineSep="\n").csv(target)
    if keep is not None:
        if bad := [k for k in keep if not 0 <= k < len(named)]:
            raise ValueError(f"{target} has {len(named)} fields, not {bad}")
    places = sorted(set(keep)) if keep is not None else range(len(named))
    kinds = ["string"] * len(named) if isinstance(fields, int) else [f[1] if isinstance(f, tuple | list) else f for f in fields]
    out = rows.select(*[parsed(column(rows, i), kinds[i]).alias(named[i].name) for i in places])
    return out.dropna("all") if drop_empty else out


def total_bytes(df: DataFrame) -> int:
    """Bytes of the files that df reads."""
    return sum(leaf.relation().location().sizeInBytes() for leaf in file_leaves(df))


def file_leaves(df: DataFrame) -> list:
    """The file relations at the leaves of df's plan."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    found = [leaves.apply(i) for i in range(leaves.size())]
    return [x for x in found if x.getClass().getSimpleName() == "LogicalRelation" and x.relation().getClass().getSimpleName() == "HadoopFsRelation"]


def files_state(df: DataFrame) -> str:
    """Names, sizes and times of the files that df reads, as one text."""
    return "\n".join(leaf.relation().location().allFiles().mkString("\n") for leaf in file_leaves(df))


def scan_parquet(spark: SparkSession, path: str, keep: list[Field] | None = None) -> DataFrame:
    """A Parquet file or folder; keep: the fields to read, in file order."""
    rows = spark.read.parquet(path)
    if keep is None:
        return rows
    names = {rows.columns[k] if isinstance(k, int) else k for k in keep}
    return rows.select(*[column(rows, c) for c in rows.columns if c in names])


def scan_folder(spark: SparkSession, path: str, format: str = "parquet", delimiter: str = "|", fields: list | int | None = None) -> DataFrame:
    """All files below a folder, as a checkpoint leaves them."""
    if format == "parquet":
        return spark.read.option("recursiveFileLookup", True).parquet(path)
    return scan_delimited(spark, path, delimiter, fields=fields)
