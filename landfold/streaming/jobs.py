"""Structured Streaming: live metrics, gauges, tile completion, progress, audits. Each function takes a streaming DataFrame and
returns one; run() drives a stream over what is there and returns the table that it has written."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landfold.sources.staging import staged_path


def event_files(events: DataFrame, time: str, parts: int, to: str) -> str:
    """A table as files that come one after the other, in the order of a time column: for streams over what is there already."""
    cuts = events.agg(F.percentile_approx(F.unix_micros(F.col(time).cast("timestamp")), F.array(*[F.lit(k / parts) for k in range(1, parts)]), 10_000)).first()[0] or []
    at = F.unix_micros(F.col(time).cast("timestamp"))
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        own = events if low is None else events.where(at >= low)
        (own if high is None else own.where(at < high)).coalesce(1).write.mode("append").parquet(to)
    return to


def file_stream(spark: SparkSession, schema, path: str, files_per_batch: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream, oldest file first."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def json_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Append-only lines of JSON; lines that can't be read are dropped."""
    return spark.readStream.schema(schema).option("mode", "DROPMALFORMED").json(folder)


def run(stream: DataFrame, mode: str, name: str, base: str | None = None, once: tuple[str, ...] = ()) -> DataFrame:
    """Processes all that there is. Complete results replace the table, appended and updated ones are added to it under their
    batch, so that a batch that is run again writes the same rows to the same place. With the same `base` a later call goes on
    where an earlier one has stopped. `once`: rows whose keys are in the table already are not added again."""
    spark = stream.sparkSession
    base = base or staged_path(spark, f"stream-{name}")
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema.fields)
    schema = columns if mode == "complete" else f"{columns}, batch bigint"

    def write(batch: DataFrame, number: int) -> None:
        if once and number:
            earlier = spark.read.schema(schema).parquet(f"{base}/out").where(F.col("batch") < number).select(*once)
            batch = batch.dropDuplicates(list(once)).join(earlier, list(once), "left_anti")
        batch.write.mode("overwrite").parquet(f"{base}/out" if mode == "complete" else f"{base}/out/batch={number}")

    stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{base}/state").foreachBatch(write).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{base}/out")


PROGRESS = "n bigint, summarised boolean, batch bigint"


def refreshed(stream: DataFrame, name: str, summary: Callable[[DataFrame], DataFrame], every: int, base: str | None = None) -> DataFrame:
    """Rows are added to a table; with each batch in which a further `every` of them are complete, and at the end for what is
    left, the summary of the whole table is written anew. How far it has come is a table beside it, a row a batch, so that with
    the same `base` a later call goes on, and one with nothing new returns the last summary."""
    spark = stream.sparkSession
    base = base or staged_path(spark, f"stream-{name}")
    whole = lambda: spark.read.schema(stream.schema).parquet(f"{base}/rows/batch=*")

    def note(number: int, n: int, summarised: bool) -> None:
        spark.createDataFrame([(n, summarised)], "n bigint, summarised boolean").coalesce(1).write.mode("overwrite").parquet(f"{base}/progress/batch={number}")

    def summarise(number: int, n: int) -> None:
        summary(whole()).write.mode("overwrite").parquet(f"{base}/summary-{number}")
        note(number, n, True)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/rows/batch={number}")
        n = spark.read.parquet(f"{base}/rows/batch={number}").count()
        note(number, n, False)
        before = spark.read.schema(PROGRESS).parquet(f"{base}/progress").where(F.col("batch") < number).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        if (before + n) // every > before // every:
            summarise(number, n)

    stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{base}/state").foreachBatch(write).start().awaitTermination()
    try:
        done = spark.read.schema(PROGRESS).parquet(f"{base}/progress")
        last = done.agg(F.max("batch").alias("batch"), F.max_by("n", "batch").alias("n"), F.max(F.when(F.col("summarised"), F.col("batch"))).alias("told")).first()
    except AnalysisException:  # no batch has ever come
        return summary(spark.createDataFrame([], stream.schema))
    if last.told is None or done.where(F.col("batch") > last.told).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]:
        summarise(last.batch, last.n)
        return spark.read.parquet(f"{base}/summary-{last.batch}")
    return spark.read.parquet(f"{base}/summary-{last.told}")


def live_metrics(events: DataFrame) -> DataFrame:
    """By kind, name and label: counters add up, histograms count and add."""
    return events.groupBy("kind", "name", "label").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def windowed_metrics(events: DataFrame, size: str, late: str) -> DataFrame:
    """By window of event time, for append mode: a window comes out, and its state goes, once the watermark has passed its end;
    events that are later still are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "name").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "name", "n", "total")


def last_values(events: DataFrame) -> DataFrame:
    """Gauges: the value with the greatest sequence, whatever the order of arrival."""
    return events.groupBy("name", "label").agg(F.max_by("value", "seq").alias("value"))


def completed_once(tiles: DataFrame, late: str) -> DataFrame:
    """Each tile of a run once within the watermark, so that the state is bounded; what comes again later is kept out by the
    table of completed tiles (run() with `once`)."""
    return tiles.withWatermark("ts", late).dropDuplicatesWithinWatermark(["run_id", "tile"])


def job_states(events: DataFrame) -> DataFrame:
    """The fold of a job's events as a streaming aggregation."""
    done = F.col("status").isin("completed", "failed")
    return events.groupBy("job_id").agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"), F.min(F.when(F.col("status") == "running", F.col("ts"))).alias("started_at"), F.min(F.when(done, F.col("ts"))).alias("completed_at"))


def run_progress(tiles: DataFrame, every: int, seconds: int | None = None) -> DataFrame:
    """tiles: run_id, total (tiles of the run) and ms. Tiles done, milliseconds, rate (per second) and the seconds that are left
    at it, from each run's state: a row each time a further `every` tiles are done, one with what a batch leaves, and one when
    nothing has come for `seconds`, where these are given: a timer keeps a stream going, so that is for streams without end."""
    columns = ["run_id", "done", "spent", "rate", "eta"]

    def told(run_id, total: int, done: np.ndarray, spent: np.ndarray) -> pd.DataFrame:
        rate = np.divide(done * 1000.0, spent, out=np.full(len(done), np.nan), where=spent > 0)
        eta = np.divide(total - done, rate, out=np.full(len(done), np.nan), where=rate > 0)
        return pd.DataFrame({"run_id": run_id, "done": done, "spent": spent, "rate": rate, "eta": eta}, columns=columns)

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        done, spent, total = state.get if state.exists else (0, 0.0, 0)
        if state.hasTimedOut:
            yield told(key[0], total, np.array([done]), np.array([spent]))
            return
        parts = list(batches)
        ms = np.concatenate([b["ms"].to_numpy(float) for b in parts])
        total = max([total, *(int(b["total"].max()) for b in parts)])
        n, sums = done + np.arange(1, len(ms) + 1), spent + np.cumsum(ms)
        shown = n % every == 0
        shown[-1] = True
        state.update((int(n[-1]), float(sums[-1]), total))
        if seconds:
            state.setTimeoutDuration(seconds * 1000)
        yield told(key[0], total, n[shown], sums[shown])

    return tiles.groupBy("run_id").applyInPandasWithState(fold, "run_id bigint, done bigint, spent double, rate double, eta double", "done bigint, spent double, total bigint", "append", "ProcessingTimeTimeout" if seconds else "NoTimeout")


def audit(events: DataFrame, since: str) -> DataFrame:
    """By project, from a time on: events, and whether errors are absent."""
    return events.where(F.col("received_at") >= F.lit(since).cast("timestamp_ntz")).groupBy("project").agg(F.count("*").alias("events"), (F.count_if(F.col("event") == "error.loaded") == 0).alias("accepted"))
