"""Aggregations: statistics of probabilities and timings, comparisons, trends, rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from landfold.functions.grid import project_mercator
from landfold.sources.staging import staged


def safe_ratio(top, bottom) -> Column:
    """NULL where the denominator is 0 or below, or NULL."""
    top, bottom = (F.col(c) if isinstance(c, str) else c for c in (top, bottom))
    return F.when(bottom > 0, top / bottom)


def percentiles(rows: DataFrame, group: list[str], v: str, levels: tuple[float, ...], bins: int = 4096) -> DataFrame:
    """(group, q): exact percentiles, between two values by their distance; NULLs and NaNs don't count, groups are without NULLs.

    Values are counted into bins between each group's ends; only the bins that hold a rank that is asked for are gone through by
    value, so that no task or buffer holds a group's values, and equal values count as one row."""
    base = rows.where(F.col(v).isNotNull() & ~F.isnan(F.col(v).cast("double"))).select(*group, F.col(v).cast("double").alias("_v"))
    ends = base.groupBy(*group).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("*").alias("_n"))
    at = F.when(F.col("_hi") > F.col("_lo"), F.least(F.lit(bins - 1), F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins))).otherwise(0)
    binned = (base.join(ends, group) if group else base.crossJoin(F.broadcast(ends))).withColumn("_b", at.cast("int"))
    counted = binned.groupBy(*group, "_b").agg(F.count("*").alias("_c"), F.first("_n").alias("_n"))
    upto = F.sum("_c").over(W.partitionBy(*group).orderBy("_b"))  # at most `bins` rows a group
    rank = F.explode(F.array_distinct(F.flatten(F.array(*[F.array(F.floor((F.col("_n") - 1) * q), F.ceil((F.col("_n") - 1) * q)) for q in levels]))))
    counted = counted.withColumn("_before", upto - F.col("_c")).withColumn("_r", rank).where((F.col("_r") >= F.col("_before")) & (F.col("_r") < F.col("_before") + F.col("_c")))
    wanted = staged(counted.select(*group, "_b", "_before", "_r", "_n"), "percentile-ranks")
    inner = binned.join(wanted.select(*group, "_b", "_before").distinct(), [*group, "_b"]).groupBy(*group, "_b", "_before", "_v").agg(F.count("*").alias("_c"))
    inner = inner.withColumn("_to", F.col("_before") + F.sum("_c").over(W.partitionBy(*group, "_b").orderBy("_v")))
    met = inner.join(wanted.select(*group, "_b", "_r", "_n"), [*group, "_b"]).where((F.col("_r") < F.col("_to")) & (F.col("_r") >= F.col("_to") - F.col("_c")))
    # At most two ranks for each level.
    by_rank = met.groupBy(*group).agg(F.map_from_entries(F.collect_list(F.struct("_r", "_v"))).alias("_m"), F.first("_n").alias("_n"))

    def level(q: float) -> Column:
        at = (F.col("_n") - 1) * q
        low, high = F.col("_m")[F.floor(at)], F.col("_m")[F.ceil(at)]
        return low + (at - F.floor(at)) * (high - low)

    return by_rank.select(*group, F.array(*map(level, levels)).alias("q"))


def probability_stats(pixels: DataFrame, group: list[str], p: str = "p") -> DataFrame:
    """Count, least, greatest, mean, population deviation, five quantiles and shares above four thresholds; of finite values
    only, NULLs for an empty group."""
    finite = pixels.where(~F.isnan(p) & F.col(p).isNotNull())
    found = finite.groupBy(*group).agg(F.count(p).alias("n"), F.min(p).alias("least"), F.max(p).alias("most"), F.avg(p).alias("mean"), F.stddev_pop(p).alias("std"), *[F.avg((F.col(p) >= t).cast("double")).alias(f"share_{int(t * 100)}") for t in (0.5, 0.6, 0.75, 0.9)])
    found = found.join(percentiles(finite, group, p, (0.01, 0.05, 0.5, 0.95, 0.99)), group)
    return found.select(*group, "n", "least", "most", "mean", "std", *[F.col("q")[k].alias(c) for k, c in enumerate(("p01", "p05", "p50", "p95", "p99"))], "share_50", "share_60", "share_75", "share_90")


def partial_stats(values: DataFrame, group: list[str], v: str) -> DataFrame:
    """The mergeable part: count, sum, sum of squares, least, greatest."""
    return values.groupBy(*group).agg(F.count(v).alias("n"), F.sum(v).alias("s"), F.sum(F.col(v) * F.col(v)).alias("ss"), F.min(v).alias("lo"), F.max(v).alias("hi"))


def final_stats(parts: DataFrame, group: list[str]) -> DataFrame:
    """Parts to mean and deviation; a variance below 0 by rounding counts as 0."""
    whole = parts.groupBy(*group).agg(*[F.sum(c).alias(c) for c in ("n", "s", "ss")], F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    mean = safe_ratio("s", "n")
    return whole.select(*group, "n", mean.alias("mean"), F.sqrt(F.greatest(safe_ratio("ss", "n") - mean * mean, F.lit(0.0))).alias("std"), "lo", "hi")


def timing_summary(records: DataFrame, fields: DataFrame, field: str, value: str, group: list[str], digits: int = 3) -> DataFrame:
    """One row per group and field of the dimension `fields` (one column): count, mean, median, p90, p95, most, least, total,
    rounded (by way of three more digits, so that the order of a sum doesn't decide a tie); a field without records has count 0,
    total 0 and NULLs."""
    groups = records.select(*group).distinct()
    found = records.groupBy(*group, field).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.max(value).alias("most"), F.min(value).alias("least"), F.sum(value).alias("total"))
    found = found.join(percentiles(records, [*group, field], value, (0.5, 0.9, 0.95)), [*group, field], "left")
    out = groups.crossJoin(fields).join(found, [*group, field], "left")
    return out.select(*group, field, F.coalesce("n", F.lit(0)).alias("n"), *[F.round(F.round(c, digits + 3), digits).alias(k) for c, k in ((F.col("mean"), "mean"), (F.col("q")[0], "median"), (F.col("q")[1], "p90"), (F.col("q")[2], "p95"), (F.col("most"), "most"), (F.col("least"), "least"), (F.coalesce("total", F.lit(0.0)), "total"))])


def availability(checks: DataFrame, group: list[str]) -> DataFrame:
    """Tiles by outcome: candidate, available, failed, missing, whether complete, and the share available."""
    found = checks.groupBy(*group).agg(F.count("*").alias("candidate"), F.count_if(F.col("status") == "available").alias("available"), F.count_if(F.col("status") == "failed").alias("failed"))
    return found.withColumns({"missing": F.greatest(F.col("candidate") - F.col("available") - F.col("failed"), F.lit(0)), "complete": F.col("failed") == 0, "fraction": safe_ratio("available", "candidate")})


def confusion(pairs: DataFrame, group: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """Two masks over the same pixels, a the baseline: true and false positives, misses, IoU (1 for two empty masks)."""
    both, either = F.count_if(F.col(a) & F.col(b)), F.count_if(F.col(a) | F.col(b))
    return pairs.groupBy(*group).agg(both.alias("tp"), F.count_if(~F.col(a) & F.col(b)).alias("fp"), F.count_if(F.col(a) & ~F.col(b)).alias("fn"), F.when(either > 0, both / either).otherwise(1.0).alias("iou"), safe_ratio(F.count_if(F.col(a) != F.col(b)), F.count("*")).alias("disagreement"))


def raster_difference(a: DataFrame, b: DataFrame, threshold: float) -> DataFrame:
    """Two rasters (row, col, p) on one grid: greatest, mean and 99 % absolute difference, and pixels whose masks differ."""
    both = a.select("row", "col", F.col("p").alias("pa")).join(b.select("row", "col", F.col("p").alias("pb")), ["row", "col"], "full")
    diff = F.abs(F.col("pa") - F.col("pb"))
    whole = both.agg(F.count("*").alias("pixels"), F.max(diff).alias("most"), F.avg(diff).alias("mean"), F.count_if((F.col("pa") >= threshold) != (F.col("pb") >= threshold)).alias("mismatches"))
    q = percentiles(both.select(diff.alias("d")), [], "d", (0.99,))
    return whole.crossJoin(F.broadcast(q.select(F.col("q")[0].alias("p99"))))  # a single row each


def slope_per_100(rows: DataFrame, group: list[str], y: str, x: str) -> DataFrame:
    """Least-squares slope times 100; NULL below two points or without spread in x."""
    n = F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1))
    return rows.groupBy(*group).agg(F.when((n >= 2) & (F.var_pop(x) > 0), F.regr_slope(y, x) * 100).alias("slope"))


def merged_metrics(events: DataFrame) -> DataFrame:
    """Metric events by kind, name and label: counters add up, gauges keep the last by sequence, histograms count and add."""
    found = events.groupBy("kind", "name", "label").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.max_by("value", "seq").alias("last"))
    return found.select("kind", "name", "label", F.when(F.col("kind") == "histogram", F.col("n")).alias("observations"), F.when(F.col("kind") == "gauge", F.col("last")).otherwise(F.col("total")).alias("value"))


def growth_class(share: Column) -> Column:
    return F.when(share.isNull(), "unknown").when(share >= 0.5, "strong").when(share >= 0.2, "moderate").when(share > 0, "slight").otherwise("none")


def memory_growth(samples: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """Whether a series grows: false below 20 samples; the first min(50, max(10, n / 5)) are dropped, false below 10 left;
    true if the end lies over 50 above the start and at least 0.8 of the steps don't fall, or the slope per 100 samples and
    the range are over 50."""
    by = W.partitionBy(group)
    rows = samples.select(group, F.row_number().over(by.orderBy(order)).alias("k"), F.count("*").over(by).alias("n"), F.col(value).alias("v"))
    rows = rows.where((F.col("n") >= 20) & (F.col("k") > F.least(F.lit(50), F.greatest(F.lit(10), F.floor(F.col("n") / 5)))))
    rows = rows.withColumn("step", (F.col("v") >= F.lag("v").over(by.orderBy("k"))).cast("double"))
    found = rows.groupBy(group).agg(F.count("*").alias("left"), (F.max_by("v", "k") - F.min_by("v", "k")).alias("delta"), F.avg("step").alias("rising"), (F.regr_slope("v", "k") * 100).alias("slope"), (F.max("v") - F.min("v")).alias("range"))
    grows = (F.col("left") >= 10) & (((F.col("delta") > 50) & (F.col("rising") >= 0.8)) | ((F.col("slope") > 50) & (F.col("range") > 50)))
    return samples.select(group).distinct().join(found.select(group, grows.alias("grows")), group, "left").select(group, F.coalesce("grows", F.lit(False)).alias("grows"))


def metric_lines(merged: DataFrame) -> DataFrame:
    """merged_metrics() as lines of text: (section, name, label, part, line). Histograms give two, a count and a sum; values are
    written with up to six decimals, and backslashes, quotes and line ends of labels are escaped."""
    text = lambda v: F.regexp_replace(F.regexp_replace(F.format_string("%.6f", v.cast("double")), r"\.?0+$", ""), "^-0$", "0")
    section = F.when(F.col("kind") == "counter", 1).when(F.col("kind") == "gauge", 2).otherwise(3)
    kinds = F.when(F.col("kind") == "histogram", F.array(F.struct(F.lit(1).alias("part"), F.lit("_count").alias("end"), F.col("observations").cast("string").alias("v")), F.struct(F.lit(2).alias("part"), F.lit("_sum").alias("end"), text(F.col("value")).alias("v")))).otherwise(
        F.array(F.struct(F.lit(0).alias("part"), F.lit("").alias("end"), text(F.col("value")).alias("v"))))
    escaped = F.replace(F.replace(F.replace(F.col("label").cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    rows = merged.select(section.alias("section"), "name", "label", F.explode(kinds).alias("k")).select("section", "name", "label", "k.*")
    return rows.select("section", "name", "label", "part", F.concat("name", "end", F.lit('{label="'), escaped, F.lit('"} '), "v").alias("line"))


def summary_metrics(summary: DataFrame) -> DataFrame:
    """A run's summary to a milestone's metrics. New buildings and changes of buildings have their own areas and counts; a count or
    area of 0 or NULL falls back to the estimate, or to the number of features."""
    new = F.col("semantics") == "new_buildings"
    first = lambda own, other: F.coalesce(F.nullif(F.col(own), F.lit(0).cast(summary.schema[own].dataType)), F.col(other), F.lit(0))
    return summary.withColumns({
        "added_area_m2": F.round(F.when(new, first("new_building_area_m2", "estimated_area_m2")).otherwise(first("change_area_m2", "estimated_area_m2")), 2),
        "feature_count": F.when(new, first("new_buildings", "feature_count")).otherwise(first("change_polygons", "feature_count")),
        "building_level": new, "block_count": F.coalesce("building_blocks", F.lit(0)), "block_area_m2": F.round(F.coalesce("building_block_area_m2", F.lit(0.0)), 2)})


def metric_audit(features: DataFrame, unions: DataFrame, keys: list[str], names: tuple[str, ...], tolerance: float) -> DataFrame:
    """features: keys and props, a map of texts; unions: keys and area. The sum of the first property of each feature that can be
    read as a number, against the area of the union: stored, computed, mismatch."""
    told = F.coalesce(*[F.try_element_at("props", F.lit(n)).try_cast("double") for n in names], F.lit(0.0))
    stored = features.groupBy(*keys).agg(F.sum(told).alias("stored"))
    both = stored.join(unions.withColumnRenamed("area", "computed"), keys)
    return both.select(*keys, "stored", "computed", (F.abs(F.col("stored") - F.col("computed")) > tolerance).alias("mismatch"))


def repeat_summary(runs: DataFrame, mode: str, names: list[str]) -> DataFrame:
    """Mean, least and greatest of each metric over the runs of a mode."""
    long = runs.unpivot(mode, names, "metric", "v")
    return long.groupBy(mode, "metric").agg(F.avg("v").alias("mean"), F.min("v").alias("least"), F.max("v").alias("most"))


def feature_count(body) -> Column:
    """Features of a collection's text, -1 where it can't be read."""
    found = F.try_variant_get(F.try_parse_json(body), "$.features", "array<variant>")
    return F.when(found.isNull(), -1).otherwise(F.size(found)).cast("bigint")


def padded_extent(keys_: DataFrame, boxes: DataFrame, key: str, source: str, area: tuple[float, float, float, float], pad: float) -> DataFrame:
    """keys_: all keys; boxes in degrees. Each key's bounds in Web-Mercator metres, `pad` of its span wider on each side; a key
    without boxes has those of the area, and fallback. sources: how many different ones took part."""
    found = boxes.groupBy(key).agg(*[f(f"{e}{v}").alias(f"{e}{v}") for f, e in ((F.min, "min"), (F.max, "max")) for v in "xy"], F.count_distinct(source).alias("sources"))
    joined = keys_.join(found, key, "left").withColumn("fallback", F.col("minx").isNull())
    filled = joined.withColumns({c: F.coalesce(c, F.lit(float(v))) for c, v in zip(("minx", "miny", "maxx", "maxy"), area, strict=True)})
    (x0, y0), (x1, y1) = project_mercator("minx", "miny"), project_mercator("maxx", "maxy")
    metres = filled.select(key, "fallback", F.coalesce("sources", F.lit(0)).alias("sources"), x0.alias("minx"), y0.alias("miny"), x1.alias("maxx"), y1.alias("maxy"))
    wide, high = (F.col("maxx") - F.col("minx")) * pad, (F.col("maxy") - F.col("miny")) * pad
    return metres.select(key, "fallback", "sources", (F.col("minx") - wide).alias("minx"), (F.col("miny") - high).alias("miny"), (F.col("maxx") + wide).alias("maxx"), (F.col("maxy") + high).alias("maxy"))
