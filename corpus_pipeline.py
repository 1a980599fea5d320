"""The corpus pipeline: quality, exact copies, near copies, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each as Parquet in the shared folder and
rereads it as the next one's docs. All stages but the last return the columns of documents.

Defined results: as each operator says, so a null text counts as empty; rows without a doc_id, or that share one, are judged
each for itself but by their texts, so that such rows of equal text are one; texts are read whole; columns of any name that don't begin with _lf_ are handed on up to the last stage,
which gives doc_id and tokens; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from landfold.llm import bpe, exact_dedup, mixing, quality_model, simhash
from landfold.llm.common import staged, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality_model.keep_good(docs, table(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one stays. The index lasts, its feeds being the files of documents: running the pipeline again over the
    same files gives the same, and with further files beside them what is new in those. A folder without that table is one
    feed."""
    try:
        files = table(spark, sf_dir, "documents").inputFiles()
    except AnalysisException:
        files = [sf_dir]
    return exact_dedup.keep_new_of(docs, exact_dedup.named_index(spark, "pipeline", sf_dir), files)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one stays."""
    return simhash.keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights ask for."""
    return mixing.mix_documents(docs, mixing.Mixture())


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token ids."""
    return bpe.encode(docs, bpe.vocabulary_path())


STAGES = [("quality classifier", quality), ("exact dedup", exact_copies), ("near dedup", near_copies), ("mixing", mixture), ("bpe", tokens)]
#: The classifier can't be written in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
