"""The queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm import ann_forest, lattice_lm, near_dedup, packing, piece_codec, quality_classifier, quality_rules, secret_scan, sharding, suffix_dedup
from loomline.llm.common import crc_fold, scratch_path, table
from loomline.llm.sql import ORACLES

Query = Callable[[SparkSession, str], DataFrame]


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_scan.find_by_ledger(docs, scratch_path(spark, "ledger")).select("doc_id", F.col("secret_spans").alias("s"))
    base = F.filter("s", lambda x: x["kind_no"] < secret_scan.BASE_KINDS)
    count = lambda k: F.size(F.filter("s", lambda x: x["kind_no"] == k)).cast("long")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(secret_scan.listed(base), 256).alias("base_sha256"),
        secret_scan.listed(F.col("s")).alias("spans"),
    )


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = piece_codec.round_trip(docs, piece_vocabulary())
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", F.sha2("text", 256).alias("decoded_sha256"))


def op3_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    found = ann_forest.search(vectors, F.col("id") % 100 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    held_out = crc_fold("doc_id") == 0
    return quality_classifier.classify(docs, labels, ~held_out).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def piece_vocabulary() -> str:
    """Where the piece vocabulary of the public tokenizers lies."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = lattice_lm.score_texts(docs, piece_vocabulary(), crc_fold("doc_id") != 1)
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return sharding.assign_shards(docs).select("doc_id", "n_chars", "slot", "shard")


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_dedup.near_duplicates(docs, least=85).select("doc_id", "n_shingles", "component_id", "kept")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.measure_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


def word_tokenizer() -> str:
    """Where the word-level BPE of the public tokenizers lies."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, word_tokenizer())


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quality_rules.ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    judged = quality_rules.apply_policy(book)
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        quality_rules.rejected(quality_rules.BASE).alias("base_failed"), "kept",
        "n_lines", "n_upper", "n_exclaims", "n_stutters", "fail_bits", "policy_version",
    )


def queries() -> dict[str, Query]:
    return {
        "op1_secret_scan": op1_secret_scan,
        "op2_sentencepiece": op2_sentencepiece,
        "op3_ann_search": op3_ann_search,
        "op4_quality_classifier": op4_quality_classifier,
        "op5_lm_scoring": op5_lm_scoring,
        "op6_sharding": op6_sharding,
        "op7_minhash_near_dedup": op7_minhash_near_dedup,
        "op8_suffix_dedup": op8_suffix_dedup,
        "op9_packing": op9_packing,
        "op10_quality_rules": op10_quality_rules,
    }


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
