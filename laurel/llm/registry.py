"""The registered queries of the llm operators: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from laurel.llm import bpe, decontaminate, language_model, near_dup, quality_model, quality_rules, secret_scan, shared, token_counts, url_filter, warc
from laurel.session import table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: Texts of more tokens are over the limit.
TOKEN_LIMIT = 1024


def crc_remainder(id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5: the fold of a row."""
    return F.crc32(F.col(id).cast("string")) % 5


#: Scores from here on predict label 1.
QUALITY_CUT = 0.3


def quality_scores(docs: DataFrame, labels: DataFrame, keep: bool = False) -> DataFrame:
    """doc_id (with `keep`, all columns) and score of all `docs`, learnt from the labelled ones outside fold 0."""
    model = quality_model.fit(docs.where(crc_remainder() != 0), labels.where(crc_remainder() != 0))
    return quality_model.score(docs, model, keep=keep)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", (crc_remainder() == 0).alias("held_out"), "score", (F.col("score") >= QUALITY_CUT).cast("int").alias("predicted"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents"), TOKENIZER)
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode(table(spark, sf_dir, "documents"), TOKENIZER, decoded=True)
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = decontaminate.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return judged.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op5_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_remainder() == 1
    scored = language_model.score(table(spark, sf_dir, "documents"), ~held_out)
    return scored.withColumn("held_out", held_out)


def op6_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.groups(table(spark, sf_dir, "documents"), width=4, percent=80)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_removed", "kept_share")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = shared.new_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), archives)
    pages = warc.read(spark, archives)
    own = F.when(F.col("payload").isNotNull(), F.sha2("payload", 256))
    digest = F.when(F.col("record_type") == "revisit", F.col("declared_digest")).otherwise(own)
    return pages.select("page_id", "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n", "start", "length", F.sha2("secret", 256).alias("secret_sha256"), "score", "is_secret")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


QUERIES = {
    "op1_quality": op1_quality,
    "op2_token_counts": op2_token_counts,
    "op3_bpe": op3_bpe,
    "op4_decontamination": op4_decontamination,
    "op5_lm": op5_lm,
    "op6_near_dup": op6_near_dup,
    "op7_quality_rules": op7_quality_rules,
    "op8_warc": op8_warc,
    "op9_secret_scan": op9_secret_scan,
    "op10_url_filter": op10_url_filter,
}
SQL = {"op4_decontamination": decontaminate.ORACLE, "op6_near_dup": near_dup.ORACLE, "op7_quality_rules": quality_rules.ORACLE, "op8_warc": warc.ORACLE, "op10_url_filter": url_filter.ORACLE}
