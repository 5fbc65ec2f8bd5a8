"""The corpus pipeline: documents through quality rules, near-dedup, repeated passages,
secret redaction and packing. Each stage's result is written as Parquet and read again as
the next one's documents; all but the last return the columns of documents.

Defined results: rows that the rules reject go; of each group of near duplicates (a similarity of
0.80 or more) one row stays, whatever its id: rows with null or repeated ids aren't merged by
them, and rows without words all stay; repeated passages are cut out of all texts that hold them, and the texts stay, empty
if nothing else is left; secrets are replaced by a mark; n_chars follows the text. An empty
table gives no pieces. Extra columns of any name come along up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm import near_dedup, packing, quality_rules, secret_scan, suffix_dedup
from loomline.llm.common import scratch_path, scratch_paths, stored, table, text_of, whole_row
from loomline.llm.queries import word_tokenizer
from loomline.sources import store

#: No SQL: components, suffix sorting and tokenizing are beyond it; tests/llm holds run()
#: against a brute-force version.
ORACLE_SQL: str | None = None
#: Percent of the union of two documents' shingles that near duplicates share.
NEAR = 80


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars as the text now is."""
    return docs.withColumn("n_chars", F.length(text_of("text")).cast("long")) if "n_chars" in docs.columns else docs


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = docs.select(whole_row(docs).alias("row_"), "text")
    return quality_rules.kept_rows(quality_rules.ledger(rows, keep=("row_",))).select("row_.*")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_duplicates(docs, least=NEAR)


def passages_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(suffix_dedup.cut_text(docs))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = secret_scan.find_by_ledger(docs, scratch_path(spark, "ledger"), rules=secret_scan.WHOLE_RULES)
    return _counted(found.withColumn("text", secret_scan.redact(F.col("text"), F.col("secret_spans")))).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, word_tokenizer())


STAGES = [
    ("quality_rules", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("suffix_dedup", passages_stage),
    ("secret_scan", secrets_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of sf_dir. What a stage has written on the way
    is removed once its result is."""
    docs, old = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        with scratch_paths() as made:
            docs = stored(stage(spark, docs, sf_dir), name)
        for path in (*old, *made[:-1]):
            store.remove(spark, path)
        old = made[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
