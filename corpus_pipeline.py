"""A training corpus from raw documents: quality rules, near duplicates, secrets, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; all but
the last return the columns of documents. Between stages rows are written as Parquet and read again;
when a stage has been written, the rows that it read and all that its operators have left go. Columns
besides those of documents are left out, whatever their names. An empty table of documents gives an
empty result.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papertide.llm import jaccard, packing, quality, secrets_index
from papertide.llm.common import drop_folder, drop_since, made, read_table, settle, shared_dir, tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go.

    Null, empty and blank texts have no words and go; repeated rows are judged, and stay, one by one;
    null ids don't matter but that such documents are never trusted.
    """
    return quality.kept_documents(docs.select(COLUMNS), read_table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that of the least doc_id, null ids last.

    Repeated rows are near duplicates; documents with null ids are told apart by their texts; texts
    without words all stay.
    """
    return jaccard.one_of_each(docs).select(COLUMNS)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, its secrets blotted out and its n_chars counted anew where that changed it.

    Null texts stay null; repeated rows and null ids stay as they are.
    """
    clean = secrets_index.redact(docs.withColumn("_pt_before", F.xxhash64("text")))
    changed = F.xxhash64("text") != F.col("_pt_before")
    return clean.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All remaining documents as pieces of token sequences.

    A null or empty text is its end token alone; repeated rows and null ids are packed one by one.
    """
    return packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("byte_bpe_50k.tiktoken")).drop("piece_id")


STAGES = [
    ("quality_rules", quality_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("secret_scan", secret_stage),
    ("packing", packing_stage),
]

#: Hash tables, tokenizers and components are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one behind the other, from the documents of sf_dir. Of what they have written only what the result reads
    stays."""
    earlier = made()
    rows, before = read_table(spark, sf_dir, "documents"), None
    for number, (name, stage) in enumerate(STAGES):
        held = made()
        rows = stage(spark, rows, sf_dir)
        if number < len(STAGES) - 1:
            folder = shared_dir(spark)
            rows = settle(rows, folder, f"{number}_{name}")
            drop_since(spark, held, folder)
            if before:
                drop_folder(spark, before)
            before = folder
    read = rows.inputFiles()
    for folder in made() - earlier:
        if not any(os.path.basename(folder) in file for file in read):
            drop_folder(spark, folder)
    return rows
