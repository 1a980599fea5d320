"""Tables written to the folder that driver and executors share, to cut lineage between rounds.

All that a session writes lies in one folder of its own, which clean_up() removes once its results are no longer read.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
_RUN = uuid.uuid4().hex[:16]


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a temporary one if all runs on this machine, else an error:
    executors elsewhere couldn't read it."""
    found = spark.conf.get(SETTING, None)
    if not found:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError(f"set {SETTING} to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="landfold-")
        spark.conf.set(SETTING, found)
    return found.rstrip("/")


def run_dir(spark: SparkSession) -> str:
    """This session's part of the shared folder."""
    return f"{shared_dir(spark)}/landfold/run-{_RUN}"


def staged_path(spark: SparkSession, name: str) -> str:
    """A new path in this session's folder."""
    return f"{run_dir(spark)}/{name}-{uuid.uuid4().hex[:16]}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back."""
    path = staged_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clean_up(spark: SparkSession) -> None:
    """Removes what this session has staged; DataFrames over it can't be read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(run_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
