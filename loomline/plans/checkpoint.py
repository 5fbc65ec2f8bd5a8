"""Results of operators kept as Parquet, so that a plan that runs again starts from them."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.utils import AnalysisException

from loomline.plans.compiler import Compiler
from loomline.plans.workflow import Workflow
from loomline.sources.files import files_state


def write_stage(df: DataFrame, path: str, keys: list[str] | None = None, buckets: int | None = None) -> None:
    """df as Parquet; with keys, rows of one key in one of so many parts."""
    if keys:
        df = df.repartition(buckets, *keys) if buckets else df.repartition(*keys)
    df.write.mode("overwrite").parquet(path)


def read_stage(spark: SparkSession, path: str) -> DataFrame | None:
    """A finished stage, or None: a folder counts once its writer has committed it."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return None
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


@dataclass
class Checkpoints:
    """Keeps the inputs of joins, as places where rows are dealt anew, below root. A stage's
    folder is named by what it computes, so a changed plan doesn't meet an old stage: by the
    operators and parameters, the query plan that the compiler's options have led to, and the
    names, sizes and times of the files read. salt: anything else the result depends on."""

    spark: SparkSession
    root: str
    salt: str = ""

    def after(self, plan: Workflow, op: str, df: DataFrame) -> DataFrame:
        if not any(plan.ops[d].type == "HashJoin" for d in plan.outputs[op]):
            return df
        # numbers of expressions differ from compilation to compilation
        query = re.sub(r"#\d+L?", "", df._jdf.queryExecution().analyzed().toString())
        path = f"{self.root}/{op}-{plan.fingerprint(op, '|'.join([self.salt, query, files_state(df)]))}"
        if (kept := read_stage(self.spark, path)) is None:
            write_stage(df, path)
            kept = read_stage(self.spark, path)
        return kept

    def compiler(self, **options) -> Compiler:  # noqa: ANN003
        return Compiler(self.spark, after=self.after, **options)
