"""A training corpus from raw documents: five stages, each a function of (spark, docs, sf_dir).

quality classifier (rejected documents go), near-duplicates (one of each group stays), benchmark
decontamination (documents with a hit go), PII (spans are replaced by their kind), packing (the
pieces of all sequences). Every stage but the last returns the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.llm import decontaminate, near_duplicates, packing, pii, quality
from tarnlake.llm.common import discard, quoted, read, settle
from tarnlake.llm.queries import encoder

QUALITY_THRESHOLD = 0.3


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at least the threshold; the model learns from labels of docs."""
    model = quality.fit(docs, read(spark, sf_dir, "labels"))
    return quality.apply(docs, model, "quality_score_").where(F.col("quality_score_") >= QUALITY_THRESHOLD).select(*quoted(docs.columns))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word-shingle similarity 0.8 or more."""
    return near_duplicates.representatives(docs, k=5, percent=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def pii_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind in brackets."""
    return pii.masked(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens along the Hilbert curve."""
    return packing.digest(packing.pack(docs, encoder()))


STAGES = [
    ("quality classifier", quality_classifier),
    ("near-duplicates", minhash_near_dedup),
    ("decontamination", benchmark_decontamination),
    ("PII", pii_masking),
    ("packing", pack_sequences),
]

#: No SQL expresses learned scores or token ids; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what lies between two stages is written to the shared folder."""
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
