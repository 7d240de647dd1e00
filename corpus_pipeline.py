"""The corpus pipeline: documents through five of the library's operators.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages
the table is written as Parquet in the shared folder and read again, so each
stage works on exactly what its predecessor kept and a lost executor costs at
most one stage's tasks. All stages but the last return the columns of documents.

Defined results, stage by stage
* null or empty texts: rejected by the quality rules, as they have under ten words;
  in the later stages alone they stay (no lines, shingles or passages to lose) and
  have one row without a bin in the packing.
* null ids: sort after all others in line dedup and near duplicates, else untouched.
* repeated rows (same id and text) are one document: they stay or go together, and
  are packed each for itself. Ties: the least id keeps a line and stands for a group.
* very long texts: whole in every stage; the packing cuts them into pieces of the
  largest capacity.
* empty table: every stage is empty. Extra columns pass through all but the packing,
  whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickforge.llm import decontaminate, line_dedup, ngram_join, packing, quality_rules
from tickforge.llm.store import scratch, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current rule policy keeps."""
    return quality_rules.keep(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that an earlier document holds; n_chars follows.

    A document that loses every line goes.
    """
    done = line_dedup.dedup_text(docs)
    changed = F.col("_n_dropped") > 0
    own = {"text": F.when(changed, F.col("_kept_text")).otherwise(F.col("text")),
           "n_chars": F.when(changed, F.length("_kept_text").cast("long")).otherwise(F.col("n_chars"))}
    left = done.where(~changed | (F.col("_n_dropped") < F.col("_n_lines")))
    return left.select(*[own.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near duplicates."""
    return ngram_join.first_of_group(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes: bin, capacity, offset."""
    return packing.pack(docs, packing.word_count(F.col("text")))


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_dedup_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("best-fit packing", packing_stage),
]

#: Best-fit packing is sequential; SQL can't express it (brute force: tests/llm/test_pipeline.py).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        path = scratch(spark, f"stage{number}")
        out = stage(spark, docs, sf_dir)
        out.write.option("compression", "zstd").parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
