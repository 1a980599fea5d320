"""Small helpers that the text operators share: tables, texts, paths."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from landfold.sources.staging import run_dir, shared_dir, staged

__all__ = ["DOCUMENT_COLUMNS", "scratch", "shared_dir", "staged", "table", "text_of"]
#: Columns of the documents table, in order; every pipeline stage but the last returns them.
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, or the empty string where it is null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{run_dir(spark)}/{name}-{uuid.uuid4().hex[:16]}"
