"""A corpus pipeline of five stages, each written as Parquet and read again as the next one's documents.

1. ``quality_rules`` drops the documents that the rules reject.
2. ``near_duplicates`` keeps one document of each class.
3. ``decontamination`` drops documents that hold a benchmark window.
4. ``pii`` replaces identifiers in the texts by their kind.
5. ``packing`` gives each piece of a document its place in a sequence.

All stages but the last return the columns of ``documents``, whatever further ones it
has. A null text has no words (so the rules reject it); repeated rows are copies, of
which one stays; an empty table passes through every stage as an empty table.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import decontamination, order_minhash, packing, pii, quality_rules
from riskloom.llm.common import table
from riskloom.session import ensure_checkpoint_dir


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return order_minhash.drop_near_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with identifiers replaced; ``n_chars`` follows where the text changed. Null texts, and all other columns, stay as they are."""
    new = "_clean"
    while new in docs.columns:
        new += "_"
    clean = docs.withColumn(new, pii.redact(F.col("text")))
    if "n_chars" in docs.columns:
        changed = ~F.col(new).eqNullSafe(F.col("text"))
        clean = clean.withColumn("n_chars", F.when(changed, F.length(new)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return clean.withColumn("text", F.col(new)).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality_rules", quality_stage), ("near_duplicates", near_duplicate_stage), ("decontamination", decontamination_stage),
          ("pii", pii_stage), ("packing", packing_stage)]
ORACLE_SQL = None  # word shingles, alignment, sub-word ids and packing are beyond SQL; tests/llm hold a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the tables between them lie in the cluster's shared folder."""
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/corpus-pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        at = f"{root}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return docs
