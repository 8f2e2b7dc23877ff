"""Training-data pipeline: quality rules, near-dedup, decontamination, secret
masking and packing of ``documents``.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows that its
predecessor kept; ``run`` writes each stage's rows to the checkpoint folder and
reads them back for the next.  All stages but the last return the columns of
``docs``, extra ones included.

Nulls and edge cases: a null or empty text fails the quality rules; documents
with a null id are never dropped as copies; repeated rows of a kept id stay;
an empty table stays empty and packs into no sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelake.llm import decontaminate, minhash_dedup, quality_crf, secret_grammar, swap_packing
from hirelake.plans.tables import table
from hirelake.session import materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that fail the rules or are mostly boilerplate (operator 10)."""
    return quality_crf.keep_quality(docs, quality_crf.fit_line_crf(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies, that of the smallest id
    (operator 1)."""
    copies = minhash_dedup.near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents contaminated by the benchmark (operator 3)."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret by a mark (operator 6); no document is dropped.
    ``n_chars``, where there is one, follows the text."""
    masked = secret_grammar.mask_secrets(docs, secret_grammar.learn_formats(docs))
    if "n_chars" not in docs.columns:
        return masked
    kind = docs.schema["n_chars"].dataType
    return masked.withColumn("n_chars", F.coalesce(F.char_length("text").cast(kind), F.col("n_chars")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents' tokens into sequences (operator 8)."""
    return swap_packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_masking", secret_masking),
    ("packing", packing),
]

#: The chain of line labels, learnt formats and the packing aren't SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; returns the packed pieces."""
    rows = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        rows = materialize(stage(spark, rows, sf_dir), f"pipeline-{name}")
    return rows
