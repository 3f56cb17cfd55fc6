"""Registered queries of the text operators: each over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, main_text, merkle, order_minhash, packing, pii, pu_quality, quality_rules, substrings, target_sampling, token_counts, token_files, url_cascade
from .common import table
from .sql import SQL  # noqa: F401

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = decontamination.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return hit.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = token_files.new_root(spark)
    token_files.write_token_files(table(spark, sf_dir, "documents"), root, public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read_token_files(spark, root)


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(table(spark, sf_dir, "pages"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pu_quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_distance", "word_distance")


def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "keep")


def op8_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_cascade.judge_urls(table(spark, sf_dir, "pages"), RULES)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four counts are of base spans, as is ``base_sha256``; ``n_added`` counts the method's."""
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s.base)
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    counts = [F.expr(f"cast(size(filter(spans, s -> s.base and s.kind = '{k}')) as long)").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"),
                        F.size(F.filter("spans", lambda s: ~s.base)).cast("long").alias("n_added"))


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"))


def op11_target_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return target_sampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``folded_root`` starts from a tampered leaf (``n_chars`` plus 1) where 7 divides the id's CRC-32."""
    docs = table(spark, sf_dir, "documents")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    leaves = merkle.leaves_of(docs, tampered={"n_chars": F.col("n_chars") + 1}, where=hit)
    return merkle.verify(leaves).withColumnsRenamed({"id": "doc_id", "proof": "proof_sha256"})


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_token_files, op3_main_text, op4_packing, op5_pu_quality, op6_quality_rules,
                                   op7_order_minhash, op8_url_cascade, op9_pii, op10_substrings, op11_target_sampling, op12_token_counts, op13_merkle_manifest)}
