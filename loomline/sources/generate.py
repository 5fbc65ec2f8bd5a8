"""Generated rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def generate(spark: SparkSession, limit: int, workers: int | None = None, name: str = "n", delay: int = 0) -> DataFrame:
    """1 to limit, one number a row. workers: each of so many producers counts from 1 over
    its share of the limit, the first with what is left over. delay: milliseconds that a
    producer waits before each row."""
    if limit < 0 or delay < 0:
        raise ValueError(f"limit and delay aren't negative: {limit}, {delay}")
    if not workers or workers == 1:
        rows = spark.range(1, limit + 1).select(F.col("id").cast("int").alias(name))
    else:
        share, rest = divmod(limit, workers)
        sizes = spark.range(0, workers, 1, workers).select(F.when(F.col("id") == 0, share + rest).otherwise(share).cast("int").alias("size")).filter("size > 0")
        rows = sizes.select(F.explode(F.sequence(F.lit(1), "size")).alias(name))
    if delay:
        # the sleep depends on the row, so that it happens for each
        slept = F.reflect(F.lit("java.lang.Thread"), F.lit("sleep"), F.lit(delay).cast("long") + F.col(name) * 0)
        rows = rows.filter(slept == "null")
    return rows
