"""From raw documents to tokens, stage by stage; each stage's rows are written and read by the next.

A stage works on all that the one before kept, and its decisions take effect. All stages but the
last return the columns of the documents; the last returns the encoded documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from leasebook.llm.byte_bpe import encode_decode
from leasebook.llm.common import documents, stage, table
from leasebook.llm.decontamination import clean
from leasebook.llm.line_dedup import without_repeated_lines
from leasebook.llm.minhash_dedup import without_copies
from leasebook.llm.quality import accepted

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier, trained on the labels of these rows, accepts."""
    return accepted(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that nearly repeat an earlier line."""
    return without_repeated_lines(docs, counted=False)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates (five-word shingles, similarity 0.8)."""
    return without_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in which no window of a benchmark item occurs."""
    return clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the text decoded from them."""
    return encode_decode(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("line_dedup", lines),
    ("minhash_dedup", near_copies),
    ("decontamination", decontamination),
    ("byte_bpe", tokens),
]

# A trained classifier and a transducer cannot be stated in SQL; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
