"""Windows over ordered milestones, runs and tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def with_previous(rows: DataFrame, group: str, order: list[str], columns: dict[str, str]) -> DataFrame:
    """Adds columns of the row before, under new names."""
    w = W.partitionBy(group).orderBy(*order)
    return rows.withColumns({new: F.lag(old).over(w) for old, new in columns.items()})


def selected_releases(releases: DataFrame, requests: DataFrame, group: str) -> DataFrame:
    """releases: (group, release, release_date); requests: (group, selector). Selectors are `latest`, `latest_minus_N`, a
    release's identifier, or its date as yyyy-mm-dd, of which the first in time is taken. Returns requests with release,
    release_date and reason, which says why there is none: older_than_first or unknown_selector."""
    newest = F.row_number().over(W.partitionBy(group).orderBy(F.desc("release_date"), F.desc("release")))
    ranked = releases.select(group, "release", "release_date").withColumn("_k", newest)
    text = F.trim("selector")
    back = F.when(text == "latest", F.lit(0)).otherwise(F.regexp_extract(text, r"^latest_minus_([0-9]{1,9})$", 1).try_cast("int"))
    asked = requests.distinct().withColumns({"_back": back, "_text": text})
    by_place = asked.where("_back IS NOT NULL").withColumn("_k", F.col("_back") + 1).join(ranked, [group, "_k"], "left").select(group, "selector", "release", "release_date", F.when(F.col("release").isNull(), "older_than_first").alias("reason"))
    names = ranked.select(group, F.explode(F.array_distinct(F.array(F.col("release").cast("string"), F.col("release_date").cast("string")))).alias("_text"), "release", "release_date", "_k")
    first = names.groupBy(group, "_text").agg(F.max_by(F.struct("release", "release_date"), "_k").alias("r"))
    by_name = asked.where("_back IS NULL").join(first, [group, "_text"], "left").select(group, "selector", "r.release", "r.release_date", F.when(F.col("r").isNull(), "unknown_selector").alias("reason"))
    return by_place.unionByName(by_name)


def stable_id(group: list[str], year: Column, layer: str, order: list[str]) -> Column:
    """yyyy-layer-000001, counted by group, year and layer."""
    n = F.row_number().over(W.partitionBy(*group, year, layer).orderBy(*order))
    return F.concat_ws("-", year.cast("string"), layer, F.lpad(n.cast("string"), 6, "0"))


def last_successful(group: str, order: list[str], good: Column, value: str) -> Column:
    """The value of the last good row before this one."""
    w = W.partitionBy(group).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return F.last(F.when(good, F.col(value)), ignorenulls=True).over(w)


def dirty_prefix(rows: DataFrame, group: str, order: list[str], dirty: Column) -> DataFrame:
    """Adds position and rerun: from the first dirty row on, everything runs again."""
    placed = rows.withColumn("position", F.row_number().over(W.partitionBy(group).orderBy(*order)).cast("bigint"))
    first = F.min(F.when(dirty, F.col("position"))).over(W.partitionBy(group))
    return placed.withColumn("rerun", F.coalesce(F.col("position") >= first, F.lit(False)))


def progress(rows: DataFrame, group: str, order: str, ms: str) -> DataFrame:
    """Adds done, rate (per second) and eta (seconds) after each row."""
    w = W.partitionBy(group)
    run = w.orderBy(order)
    placed = rows.withColumns({"done": F.count("*").over(run), "all": F.count("*").over(w), "elapsed": F.sum(ms).over(run) / 1000})
    return placed.withColumns({"rate": F.when(F.col("elapsed") != 0, F.col("done") / F.col("elapsed")), "eta": (F.col("all") - F.col("done")) * F.col("elapsed") / F.col("done")})


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key, by a combined maximum instead of a sort."""
    whole = rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("r"))
    return whole.select("r.*")


def top_of(rows: DataFrame, group: str, order: list, n: int) -> DataFrame:
    """The first n rows of each group, numbered as `k`; Spark cuts each partition down to n before the exchange."""
    return rows.withColumn("k", F.row_number().over(W.partitionBy(group).orderBy(*order))).where(F.col("k") <= n)
