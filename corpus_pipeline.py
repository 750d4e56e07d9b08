"""From raw documents to a training mix: quality, near-dedup, decontamination, personal data, mixing.

Every stage reads what its predecessor kept, written as Parquet in the folder that the cluster shares.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmeld.llm import decontamination, minhash_dedup, mixing, pii, quality
from sparkmeld.llm.common import materialize


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. Null and empty texts are judged as texts without bytes."""
    return quality.good(spark, docs, quality.fit(quality.training_rows(spark, docs, sf_dir)))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the least doc_id, and of several with that id the least text.

    Rows that share a doc_id are documents of their own, unless their texts have the same words; then one row stays.
    """
    return minhash_dedup.deduplicated(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose own text holds no benchmark item."""
    return decontamination.clean(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; n_chars, if there is one, follows the text."""
    out = pii.redacted(docs)
    chars = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else None
    return out.select(*[chars.alias(c) if c == "n_chars" else c for c in docs.columns])


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are sampled into the mix, with their weight and probability in the place of columns of these names."""
    return mixing.mixed(spark, docs).where("sampled").select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("weight", "prob")], "weight", "prob")


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
]

#: SQL cannot express the trained and hashed stages; tests/llm checks them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; an empty table gives no rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
