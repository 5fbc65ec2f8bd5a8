"""What several training-data operators share: words, scratch tables, table access."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.sources import store

#: The characters that separate words, and the pattern of a run of them.
SPACES = " \t\n\x0b\f\r"
SPACE_RUN = "[\\x20\\x09-\\x0D]+"
_made: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str | Column) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def text_key(text: str | Column) -> Column:
    """16 bytes that stand for the text (of its SHA-256); null is the empty text."""
    return F.unhex(F.substring(F.sha2(text_of(text), 256), 1, 32))


def whole_row(docs: DataFrame) -> Column:
    """All columns as one struct, so that no name of theirs meets one that an operator adds."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns])


def words_of(text: Column) -> Column:
    """Array of the words: maximal runs of characters other than SPACES."""
    return F.array_remove(F.split(text, SPACE_RUN), "")


def crc_fold(id_col: str, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo folds (null ids count as the empty text)."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(folds))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that the cluster shares (spark.checkpoint.dir).

    Only where the session names none and runs on one machine, as in tests, a temporary
    folder is set; on a cluster that would be another one on each machine.
    """
    path = store.scratch(spark, name)
    if (paths := _made.get()) is not None:
        paths.append(path)
    return path


@contextmanager
def scratch_paths() -> Iterator[list[str]]:
    """The scratch paths given out meanwhile, in order, for a caller that knows when to remove them."""
    token = _made.set(made := [])
    try:
        yield made
    finally:
        _made.reset(token)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends there, and every
    later read sees the same rows whichever executors are lost."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with underscores until no column of df is called that."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
