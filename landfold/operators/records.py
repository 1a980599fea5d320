"""Joins and rules over the relational tables: summaries, references, retention, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landfold.sources.staging import staged


def reasons(rules: dict[str, Column]) -> Column:
    """Names of the rules that hold, in their order."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules.items()]))


def first_reason(rules: dict[str, Column]) -> Column:
    """The name of the first rule that holds, NULL if none does."""
    return F.coalesce(*[F.when(cond, F.lit(name)) for name, cond in rules.items()])


def referenced(rows: DataFrame, references: DataFrame, key: str, target: str) -> tuple[DataFrame, DataFrame]:
    """Rows with a reference, and rows without."""
    keys = references.select(F.col(target).alias(key)).distinct()
    return rows.join(keys, key, "left_semi"), rows.join(keys, key, "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Rows of both, of each key that with the greatest version; of equals the new one."""
    tagged = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    whole = tagged.groupBy(*keys).agg(F.max_by(F.struct(*old.columns), F.struct(version, "_new")).alias("r"))
    return whole.select("r.*")


def replace_children(old: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """A parent's rows in `new` replace all that it had."""
    return old.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new)


def summaries(projects: DataFrame, milestones: DataFrame, runs: DataFrame) -> DataFrame:
    """One row per project: milestones, complete ones, last date, latest run. Each side is reduced before it is joined."""
    m = milestones.groupBy("project").agg(F.count("*").alias("milestones"), F.count_if(F.col("status") == "complete").alias("complete"), F.max("release_date").alias("last_date"))
    r = runs.groupBy("project").agg(F.max_by("run_id", F.struct("created_at", "run_id")).alias("latest_run"))
    joined = projects.join(m, "project", "left").join(r, "project", "left")
    return joined.withColumns({"milestones": F.coalesce("milestones", F.lit(0)), "complete": F.coalesce("complete", F.lit(0))})


def ambiguous_match(rows: DataFrame, candidates: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Adds `match`: none, one or many candidates under the keys, and the value where there is one."""
    found = candidates.groupBy(*keys).agg(F.count("*").alias("_n"), F.first(value).alias("_v"))
    joined = rows.join(found, keys, "left")
    kind = F.when(F.col("_n").isNull(), "none").when(F.col("_n") == 1, "one").otherwise("many")
    return joined.withColumns({"match": kind, "matched": F.when(F.col("_n") == 1, F.col("_v"))}).drop("_n", "_v")


def changed(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Full outer comparison of fingerprints: added, removed, changed or same."""
    o = old.select(key, F.struct(*columns).alias("_o"))
    n = new.select(key, F.struct(*columns).alias("_n"))
    state = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(F.col("_o").eqNullSafe(F.col("_n")), "same").otherwise("changed")
    return o.join(n, key, "full").select(key, state.alias("state"))


def job_states(events: DataFrame) -> DataFrame:
    """Fold of a job's events: the last status, first start, first end, and the greatest progress within 0 and 100."""
    done = F.col("status").isin("completed", "failed")
    return events.groupBy("job_id").agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"), F.min(F.when(F.col("status") == "running", F.col("ts"))).alias("started_at"), F.min(F.when(done, F.col("ts"))).alias("completed_at"), F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.max("progress"))).alias("progress"))


def instability(checks: DataFrame, group: str, order: list[str], size: int, limit: int, start: int, floor: int) -> DataFrame:
    """Windows of `size` checks: errors, whether they reach the limit, and the level, a step down for each such window so far,
    not below the floor."""
    from pyspark.sql import Window as W

    placed = checks.withColumn("w", F.floor((F.row_number().over(W.partitionBy(group).orderBy(*order)) - 1) / size))
    windows = placed.groupBy(group, "w").agg(F.count_if(F.col("status") == "failed").alias("errors"), F.count("*").alias("n"))
    unstable = (F.col("errors") >= limit).cast("int")
    steps = F.sum(unstable).over(W.partitionBy(group).orderBy("w").rowsBetween(W.unboundedPreceding, 0))
    return windows.withColumns({"unstable": unstable == 1, "level": F.greatest(F.lit(floor), F.lit(start) - steps).cast("bigint")})


def first_that_fits(wanted: DataFrame, offers: DataFrame, key: str, need: str, size: str, value: str, width: int) -> DataFrame:
    """wanted (with key and need): adds the least value among the offers (key, size, value) of the same key whose size is at
    least the need, or NULL. Sizes are dealt out to buckets of `width`: what lies in later buckets is a running minimum over
    one row for each bucket, and only the need's own bucket is gone through by rows, so that no task has a whole key."""
    bucket = lambda c: F.floor(F.col(c) / width)
    offered = offers.select(key, F.col(size).alias("_s"), F.col(value).alias("_v"), bucket(size).alias("_b"))
    asked = wanted.withColumn("_b", bucket(need))
    needs = asked.select(key, F.col(need).alias("_s"), "_b").distinct()
    # In the bucket: the least value so far, going down in size; at equal sizes offers come first.
    rows = offered.select(key, "_b", "_s", "_v", F.lit(0).alias("_k")).unionByName(needs.select(key, "_b", "_s", F.lit(None).cast(offers.schema[value].dataType).alias("_v"), F.lit(1).alias("_k")))
    down = Window.partitionBy(key, "_b").orderBy(F.desc("_s"), "_k").rowsBetween(Window.unboundedPreceding, 0)
    near = rows.withColumn("_near", F.min("_v").over(down)).where("_k = 1").select(key, "_b", F.col("_s").alias(need), "_near")
    buckets = rows.groupBy(key, "_b").agg(F.min("_v").alias("_least"))
    later = buckets.select(key, "_b", F.min("_least").over(Window.partitionBy(key).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)).alias("_far"))
    found = asked.join(near, [key, "_b", need], "left").join(later, [key, "_b"], "left")
    return found.withColumn(value, F.least("_near", "_far")).drop("_b", "_near", "_far")


def payload_references(rows: DataFrame, payload: str) -> DataFrame:
    """Rows whose JSON payload is a reference to a side table: storage is external and both key and checksum are there."""
    told = F.from_json(payload, "storage string, key bigint, sha256 string")
    return rows.withColumn("_p", told).where("_p.storage = 'external' AND _p.key IS NOT NULL AND _p.sha256 IS NOT NULL").withColumns({"key": F.col("_p.key"), "sha256": F.col("_p.sha256")}).drop("_p")


def split_payloads(rows: DataFrame, payload: str, limit: int, tag: str) -> tuple[DataFrame, DataFrame]:
    """The rows with bytes, storage, sha256 and the payload where it is inline, and the side table of the payloads above the
    limit: sha256, bytes, schema_tag and payload, each once. Both are written, and read back."""
    told = rows.withColumns({"bytes": F.octet_length(payload).cast("bigint")}).withColumn("_big", F.coalesce(F.col("bytes") > limit, F.lit(False)))
    told = told.withColumns({"storage": F.when(F.col("_big"), "external").otherwise("inline"), "sha256": F.when(F.col("_big"), F.sha2(payload, 256))})
    main = told.withColumn("payload", F.when(~F.col("_big"), F.col(payload))).drop("_big", *([payload] if payload != "payload" else []))
    side = told.where("_big").groupBy("sha256").agg(F.first("bytes").alias("bytes"), F.lit(tag).alias("schema_tag"), F.first(payload).alias("payload"))
    return staged(main, "payload-rows"), staged(side, "payload-side")


def override_layer(candidates: DataFrame, override: DataFrame, key: str, area: tuple[int, int, int, int]) -> DataFrame:
    """Boxes of the override, clipped to the area, in place of their key's candidates; an error if a key's override has nothing
    inside."""
    x, y = [F.greatest("minx", F.lit(area[0])), F.least("maxx", F.lit(area[2]))], [F.greatest("miny", F.lit(area[1])), F.least("maxy", F.lit(area[3]))]
    cut = lambda rows: rows.withColumns({"minx": x[0], "maxx": x[1], "miny": y[0], "maxy": y[1]}).where("minx < maxx AND miny < maxy")
    kept = cut(override)
    lost = override.select(key).distinct().join(kept.select(key), key, "left_anti")
    if not lost.isEmpty():
        raise ValueError("an override has nothing inside the area")
    return cut(candidates.join(override.select(key).distinct(), key, "left_anti")).unionByName(kept)
