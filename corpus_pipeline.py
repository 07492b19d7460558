"""Documents to training tokens: classify, dedup lines, dedup documents, decontaminate, encode.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; its
result is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import materialize, table
from tessera.llm.decontaminate import decontaminate
from tessera.llm.importance import keep_resampled
from tessera.llm.jaccard import keep_one_each
from tessera.llm.line_dedup import dedup_lines
from tessera.llm.segment import sample_segmentations


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling against the labelled good ones rejects go."""
    return keep_resampled(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand earlier in the corpus, or nearly, go; so do documents that lose their last word with them."""
    left = dedup_lines(docs)
    left = left.where(F.col(left.columns[-1]).isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return left.select(*docs.columns)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents that share 80 % of their five-word shingles, the smallest doc_id stays."""
    return keep_one_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text contains 80 % of a benchmark item's five-word shingles go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of every document, as ids that decode to its text."""
    return sample_segmentations(docs, with_ids=True)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("SentencePiece encoding", sentencepiece_encoding),
]
#: Stages 1, 2 and 5 are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the whole documents table; each stage is written and read again.

    Null texts, empty ones and those without words go in the first stage. Rows with a null
    doc_id are scored, decontaminated and encoded like others, but share no lines or
    shingles with any. Rows that repeat a doc_id and text go or stay together. Further
    columns are handed on as far as the last stage, whatever they are called. An empty
    table gives no rows, and empty labels keep all that has words.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.split()[0].lower())
    return docs
