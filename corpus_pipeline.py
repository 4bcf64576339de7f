"""A training corpus from raw documents, in five stages.

Each stage takes the documents its predecessor kept, as read back from Parquet, and returns
documents with the same columns; the last returns packed pieces. Stages: toxic documents
go; lines that many documents share stay in one of them; of near duplicates one document
stays; secrets are masked in the text; what is left is packed into sequences.
"""

from __future__ import annotations

import os
import sys

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from logscope.llm import lines, minhash, packing, secrets, toxicity  # noqa: E402
from logscope.llm.support import written  # noqa: E402


def _with_text(rows: DataFrame, columns: list[str], text) -> DataFrame:
    """The columns of ``row`` with a new text, and its length where documents carry one."""
    new = F.when(F.col("row.text").isNotNull(), text)
    changed = {"text": new, "n_chars": F.coalesce(F.length(new).cast("long"), F.col("row.n_chars"))
               } if "n_chars" in columns else {"text": new}
    return rows.select(*[changed.get(c, F.col("row")[c]).alias(c) for c in columns])


def clean_of_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents that score 0.5 or more go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.learnt(docs.select("doc_id", "text"), labels)
    return toxicity.scored(docs, model).where("score < 0.5").select("row.*")


def clean_of_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: lines of 40 characters or more in five documents stay only in one."""
    return _with_text(lines.without_shared_lines(docs), docs.columns, F.col("kept"))


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: shingles of five words, similarity of 0.8 or more."""
    return minhash.first_of_each(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: every span of a secret is masked."""
    masked = secrets.masked(F.col("row.text"), F.col("spans"))
    return _with_text(secrets.scanned(docs), docs.columns, masked)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: sequences of 2048 tokens, with the ids of every piece."""
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True)


STAGES = [
    ("toxicity", clean_of_toxicity),
    ("line dedup", clean_of_shared_lines),
    ("near dedup", one_of_near_duplicates),
    ("secret scans", without_secrets),
    ("packing", packed),
]

#: The learnt model and the packing order are beyond SQL; tests check every stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
