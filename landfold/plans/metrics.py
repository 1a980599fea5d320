"""Queries of aggregations."""

from __future__ import annotations

import math

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from landfold.functions.geometry import PLANE_LAT, PLANE_LON, PLANE_SCALE, cell_area_m2, cell_area_sql
from landfold.operators import cells as C
from landfold.operators import metrics as M
from landfold.operators.graph import label_cells
from landfold.plans.base import Registry
from landfold.plans.growth import CELLS, piece_walk_sql

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.oracle


#: Layers and what a milestone's metrics call them.
LAYERS = {"additions": "added", "effective": "total", "blocks": "block"}
#: Metrics of a run: over all of its records and over those of each kind.
REPEAT_METRICS = {f"{f}_{k}": f"{f}(ms) FILTER (WHERE field = '{k}')" for f in ("count", "sum", "avg", "min", "max") for k in ("view", "click", "purchase", "error", "signup")} | {"total": "sum(ms)"}


def rnd(c: str, n: int = 6):
    return F.round(c, n).alias(c)


@R.add("agg01_probability_stats", """SELECT raster, count(*) AS n, round(min(p), 6) AS least, round(max(p), 6) AS most, round(avg(p), 6) AS mean, round(stddev_pop(p), 6) AS std, round(quantile_cont(p, 0.01), 6) AS p01, round(quantile_cont(p, 0.05), 6) AS p05, round(quantile_cont(p, 0.5), 6) AS p50, round(quantile_cont(p, 0.95), 6) AS p95, round(quantile_cont(p, 0.99), 6) AS p99,
    round(avg(CAST(p >= 0.5 AS DOUBLE)), 6) AS share_50, round(avg(CAST(p >= 0.6 AS DOUBLE)), 6) AS share_60, round(avg(CAST(p >= 0.75 AS DOUBLE)), 6) AS share_75, round(avg(CAST(p >= 0.9 AS DOUBLE)), 6) AS share_90 FROM v_pixel GROUP BY raster""")
def agg01(s):
    found = M.probability_stats(s.v_pixel, ["raster"])
    return found.select("raster", "n", *[rnd(c) for c in found.columns[2:]])


@R.add("agg02_mergeable_stats", "SELECT raster, count(*) AS n, round(avg(p), 6) AS mean, round(sqrt(greatest(avg(p * p) - avg(p) * avg(p), 0)), 6) AS std, round(min(p), 6) AS lo, round(max(p), 6) AS hi FROM v_pixel GROUP BY raster")
def agg02(s):
    parts = M.partial_stats(s.v_pixel.withColumn("chunk", F.floor(F.col("row") / 32)), ["raster", "chunk"], "p")
    return M.final_stats(parts, ["raster"]).select("raster", "n", rnd("mean"), rnd("std"), rnd("lo"), rnd("hi"))


_FIELDS = "SELECT DISTINCT event_type AS field FROM events UNION SELECT 'absent'"


@R.add("agg03_timing_summary", f"""SELECT run_id, f.field, count(ms) AS n, round(round(avg(ms), 9), 6) AS mean, round(quantile_cont(ms, 0.5), 6) AS median, round(quantile_cont(ms, 0.9), 6) AS p90, round(quantile_cont(ms, 0.95), 6) AS p95, round(max(ms), 6) AS most, round(min(ms), 6) AS least, round(coalesce(sum(ms), 0), 6) AS total
    FROM (SELECT DISTINCT run_id FROM v_timing) CROSS JOIN ({_FIELDS}) f LEFT JOIN v_timing USING (run_id, field) GROUP BY run_id, f.field""")
def agg03(s):
    fields = s.events.select(F.col("event_type").alias("field")).distinct().union(s.spark.sql("SELECT 'absent'"))
    return M.timing_summary(s.v_timing, fields, "field", "ms", ["run_id"], digits=6)


@R.add("agg04_tile_availability", "SELECT release, z, candidate, available, failed, greatest(candidate - available - failed, 0) AS missing, failed = 0 AS complete, round(available / candidate, 6) AS fraction FROM (SELECT release, z, count(*) AS candidate, count(*) FILTER (WHERE status = 'available') AS available, count(*) FILTER (WHERE status = 'failed') AS failed FROM v_tile_check GROUP BY release, z)")
def agg04(s):
    return M.availability(s.v_tile_check, ["release", "z"]).withColumn("fraction", F.round("fraction", 6))


@R.add("agg05_dominant_metadata", """WITH r AS (SELECT o_custkey % 500 AS release, CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_orderdate AS DATE) END AS day, CAST(o_orderdate AS DATE) + 30 AS captured, o_totalprice AS res FROM orders)
    SELECT release, coalesce(dominant, earliest) AS dominant, dominant IS NULL AS fallback, median_res FROM (SELECT release, min(captured) AS earliest, round(median(res), 4) AS median_res FROM r GROUP BY release) LEFT JOIN (SELECT release, arg_min(day, (-n, day)) AS dominant FROM (SELECT release, day, count(*) AS n FROM r WHERE day IS NOT NULL GROUP BY ALL) GROUP BY release) USING (release)""")
def agg05(s):
    """The most frequent source date, of equally frequent ones the earliest; without any, the earliest capture date; and the median
    resolution."""
    rows = s.orders.selectExpr("o_custkey % 500 AS release", "CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_orderdate AS DATE) END AS day", "date_add(CAST(o_orderdate AS DATE), 30) AS captured", "o_totalprice AS res")
    days = rows.where("day IS NOT NULL").groupBy("release", "day").agg(F.count("*").alias("n"))
    dominant = days.groupBy("release").agg(F.min_by("day", F.struct(-F.col("n"), "day")).alias("dominant"))
    found = rows.groupBy("release").agg(F.min("captured").alias("earliest")).join(dominant, "release", "left").join(M.percentiles(rows, ["release"], "res", (0.5,)), "release")
    return found.select("release", F.coalesce("dominant", "earliest").alias("dominant"), F.col("dominant").isNull().alias("fallback"), F.round(F.col("q")[0], 4).alias("median_res"))


@R.add("agg06_capture_dates", "SELECT release, list_sort(list(DISTINCT day)) AS dates, count(DISTINCT day) AS n_dates, count(DISTINCT day) > 1 AS mixed FROM (SELECT o_custkey AS release, strftime(o_orderdate, '%Y-%m') AS day FROM orders) GROUP BY release")
def agg06(s):
    rows = s.orders.select(F.col("o_custkey").alias("release"), F.date_format("o_orderdate", "yyyy-MM").alias("day"))
    found = rows.groupBy("release").agg(F.array_sort(F.collect_set("day")).alias("dates"))
    return found.withColumns({"n_dates": F.size("dates").cast("bigint"), "mixed": F.size("dates") > 1})


@R.add("agg09_milestone_metrics", f"""WITH RECURSIVE {CELLS}, pieces AS (SELECT DISTINCT project, release, layer, feature_id AS piece, cx, cy FROM cell), {piece_walk_sql('pieces', 'project, release, layer')}, l AS (SELECT project, release, layer, round(sum({cell_area_sql('cy', 10)}), 2) AS area, count(DISTINCT label) AS parts FROM lab GROUP BY ALL)
    SELECT project, release, {', '.join(f"coalesce(max(CASE WHEN layer = '{k}' THEN area END), 0) AS {n}_area_m2, coalesce(max(CASE WHEN layer = '{k}' THEN parts END), 0) AS {n}_parts" for k, n in LAYERS.items())}, 0.0::DOUBLE AS envelope_area_m2 FROM l GROUP BY project, release""")
def agg09(s):
    """Of each milestone and layer the area of the union on the ellipsoid and the number of its parts. The envelope is switched
    off and counts as 0."""
    keys = ["project", "release", "layer"]
    labels = label_cells(C.cells_of_boxes(s.v_feature, keys, 10), keys)
    found = labels.groupBy(*keys, "label").agg(F.sum(cell_area_m2("cy", 10)).alias("a")).groupBy(*keys).agg(F.round(F.sum("a"), 2).alias("area_m2"), F.count("*").alias("parts"))
    wide = [F.coalesce(F.max(F.when(F.col("layer") == k, F.col(c))), F.lit(0)).alias(f"{n}_{c}") for k, n in LAYERS.items() for c in ("area_m2", "parts")]
    return found.groupBy("project", "release").agg(*wide).withColumn("envelope_area_m2", F.lit(0.0))


@R.add("agg10_summary_metrics", """SELECT release, round(CASE WHEN new THEN coalesce(nullif(new_area, 0), estimated, 0) ELSE coalesce(nullif(change_area, 0), estimated, 0) END, 2) AS added_area_m2, CASE WHEN new THEN coalesce(nullif(n_new, 0), n_features) ELSE coalesce(nullif(n_change, 0), n_features) END AS feature_count, new AS building_level, blocks AS block_count, round(coalesce(block_area, 0), 2) AS block_area_m2 FROM (SELECT release, mode LIKE '1%' AS new, n_buffers * 100.5::DOUBLE AS new_area, (n_buffers % 2) * total AS change_area, CASE WHEN release % 7 > 0 THEN total END AS estimated, n_buffers AS n_new, n_buffers % 3 AS n_change, 9 AS n_features, n_buffers % 4 AS blocks, CASE WHEN n_buffers > 2 THEN total / 3 END AS block_area FROM v_milestone)""")
def agg10(s):
    """Metrics of a milestone from its run's summary: what counts as its area and number depends on whether the run found new
    buildings or changes of buildings, and each has something to fall back on."""
    n = F.col("n_buffers")
    summary = s.v_milestone.select("release", F.when(F.col("mode").startswith("1"), "new_buildings").otherwise("building_change").alias("semantics"), (n * 100.5).alias("new_building_area_m2"), ((n % 2) * F.col("total")).alias("change_area_m2"), F.when(F.col("release") % 7 > 0, F.col("total")).alias("estimated_area_m2"),
                                   n.alias("new_buildings"), (n % 3).alias("change_polygons"), F.lit(9).cast("bigint").alias("feature_count"), (n % 4).alias("building_blocks"), F.when(n > 2, F.col("total") / 3).alias("building_block_area_m2"))
    return M.summary_metrics(summary).select("release", "added_area_m2", "feature_count", "building_level", "block_count", "block_area_m2")


@R.add("agg11_layer_bbox", "SELECT project, layer, count(*) AS n, min(minx) AS minx, min(miny) AS miny, max(maxx) AS maxx, max(maxy) AS maxy FROM v_feature GROUP BY project, layer")
def agg11(s):
    return s.v_feature.groupBy("project", "layer").agg(F.count("*").alias("n"), *[F.min(c).alias(c) for c in ("minx", "miny")], *[F.max(c).alias(c) for c in ("maxx", "maxy")])


@R.add("agg12_padded_bounds", """SELECT project, minx - px AS minx, miny - py AS miny, maxx + px AS maxx, maxy + py AS maxy, (minx + maxx) / 2 AS cx, (miny + maxy) / 2 AS cy FROM (SELECT *, CAST(0.075 AS DOUBLE) * greatest(maxx - minx, 1) AS px, CAST(0.075 AS DOUBLE) * greatest(maxy - miny, 1) AS py FROM (SELECT project, min(minx) AS minx, min(miny) AS miny, max(maxx) AS maxx, max(maxy) AS maxy FROM v_feature GROUP BY project))""")
def agg12(s):
    """Bounds of layers, merged to bounds of projects, padded by 7.5 % of a span of at least 1."""
    box = agg11(s).groupBy("project").agg(*[F.min(c).alias(c) for c in ("minx", "miny")], *[F.max(c).alias(c) for c in ("maxx", "maxy")])
    px, py = (0.075 * F.greatest(F.col(b) - F.col(a), F.lit(1)) for a, b in (("minx", "maxx"), ("miny", "maxy")))
    return box.select("project", (F.col("minx") - px).alias("minx"), (F.col("miny") - py).alias("miny"), (F.col("maxx") + px).alias("maxx"), (F.col("maxy") + py).alias("maxy"), ((F.col("minx") + F.col("maxx")) / 2).alias("cx"), ((F.col("miny") + F.col("maxy")) / 2).alias("cy"))


@R.add("agg13_metric_audit", f"""WITH {CELLS}, u AS (SELECT project, release, count(DISTINCT (cx, cy)) * 100.0::DOUBLE AS computed FROM cell WHERE layer = 'additions' GROUP BY ALL), t AS (SELECT project, release, sum(CASE feature_id % 4 WHEN 3 THEN 0 ELSE (maxx - minx) * (maxy - miny) END)::DOUBLE AS stored FROM v_feature WHERE layer = 'additions' GROUP BY ALL)
    SELECT project, release, stored, computed, abs(stored - computed) > 1 AS mismatch FROM u JOIN t USING (project, release)""")
def agg13(s):
    """The areas that features say they have (the first of three properties that can be read) against the area of their union."""
    f = s.v_feature.where("layer = 'additions'")
    text = ((F.col("maxx") - F.col("minx")) * (F.col("maxy") - F.col("miny"))).cast("string")
    k = F.col("feature_id") % 4
    given = f.select("project", "release", F.create_map(F.lit("area_m2"), F.when(k == 0, text).otherwise("n/a"), F.lit("added_area_m2"), F.when(k == 1, text), F.lit("change_area_m2"), F.when(k == 2, text)).alias("props"))
    union = C.area(C.cells_of_boxes(f, ["project", "release"], 10), ["project", "release"], 10).withColumn("area", F.col("area").cast("double"))
    return M.metric_audit(given, union, ["project", "release"], ("area_m2", "added_area_m2", "change_area_m2"), 1.0)


@R.add("agg14_dissolve_attributes", f"""WITH {CELLS}, u AS (SELECT project, release, count(DISTINCT (cx, cy)) * 100 AS union_area FROM cell GROUP BY ALL), a AS (SELECT project, release, sum(CASE WHEN feature_id % 3 = 0 THEN 0 ELSE CAST((maxx - minx) * (maxy - miny) AS DOUBLE) END) AS area, round(avg(score), 9) AS mean_score, count(*) AS n_sources FROM v_feature GROUP BY ALL)
    SELECT project, release, union_area, nullif(area, 0) AS area, mean_score, n_sources FROM a JOIN u USING (project, release)""")
def agg14(s):
    """One geometry for each milestone, here measured, with the sum of the areas that its features tell (left out where that is
    0), their mean score and their number."""
    keys = ["project", "release"]
    told = F.when(F.col("feature_id") % 3 != 0, ((F.col("maxx") - F.col("minx")) * (F.col("maxy") - F.col("miny"))).cast("double")).otherwise(0.0)
    found = s.v_feature.groupBy(*keys).agg(F.nullif(F.sum(told), F.lit(0.0)).alias("area"), F.round(F.avg("score"), 9).alias("mean_score"), F.count("*").alias("n_sources"))
    return C.area(C.cells_of_boxes(s.v_feature, keys, 10), keys, 10).withColumnRenamed("area", "union_area").join(found, keys)


_MASKS = "(SELECT row, col, max(CASE WHEN raster = 't1' THEN p END) >= 0.6 AS a, max(CASE WHEN raster = 't2' THEN p END) >= 0.6 AS b FROM v_pixel GROUP BY row, col)"


@R.add("agg15_mask_confusion", f"""SELECT CAST(floor(row / 32) AS BIGINT) AS band, count(*) FILTER (WHERE a AND b) AS tp, count(*) FILTER (WHERE NOT a AND b) AS fp, count(*) FILTER (WHERE a AND NOT b) AS fn, round(CASE WHEN count(*) FILTER (WHERE a OR b) > 0 THEN count(*) FILTER (WHERE a AND b) / count(*) FILTER (WHERE a OR b) ELSE 1 END, 6) AS iou, round(count(*) FILTER (WHERE a <> b) / count(*), 6) AS disagreement FROM {_MASKS} GROUP BY band""")
def agg15(s):
    both = s.v_pixel.groupBy("row", "col").agg(*[(F.max(F.when(F.col("raster") == r, F.col("p"))) >= 0.6).alias(k) for r, k in (("t1", "a"), ("t2", "b"))])
    found = M.confusion(both.withColumn("band", F.floor(F.col("row") / 32)), ["band"])
    return found.withColumns({"iou": F.round("iou", 6), "disagreement": F.round("disagreement", 6)})


@R.add("agg16_raster_equivalence", "SELECT count(*) AS pixels, round(max(d), 6) AS most, round(avg(d), 6) AS mean, round(quantile_cont(d, 0.99), 6) AS p99, count(*) FILTER (WHERE m) AS mismatches FROM (SELECT abs(a.p - b.p) AS d, (a.p >= 0.6) <> (b.p >= 0.6) AS m FROM (SELECT * FROM v_pixel WHERE raster = 't1') a FULL JOIN (SELECT * FROM v_pixel WHERE raster = 't2') b USING (row, col))")
def agg16(s):
    px = s.v_pixel
    found = M.raster_difference(px.where("raster = 't1'"), px.where("raster = 't2'"), 0.6)
    return found.select("pixels", rnd("most"), rnd("mean"), rnd("p99"), "mismatches")


@R.add("agg17_repeat_summary", "WITH w AS (SELECT run_id, run_id % 2 AS mode, " + ", ".join(f"{sql} AS {n}" for n, sql in REPEAT_METRICS.items()) + " FROM v_timing GROUP BY run_id), l AS (" + " UNION ALL ".join(f"SELECT mode, '{n}' AS metric, CAST({n} AS DOUBLE) AS v FROM w" for n in REPEAT_METRICS) + ") SELECT mode, metric, round(avg(v), 5) AS mean, round(min(v), 5) AS least, round(max(v), 5) AS most FROM l GROUP BY ALL")
def agg17(s):
    """26 metrics of each run; over the repeats of a mode their mean, least and greatest."""
    wide = s.v_timing.groupBy("run_id").agg(*[F.expr(sql).cast("double").alias(n) for n, sql in REPEAT_METRICS.items()])
    return M.repeat_summary(wide.withColumn("mode", F.col("run_id") % 2), "mode", list(REPEAT_METRICS)).select("mode", "metric", *[F.round(c, 5).alias(c) for c in ("mean", "least", "most")])


@R.add("agg18_trend", "SELECT run_id, round(CASE WHEN count(*) >= 2 AND var_pop(tile) > 0 THEN regr_slope(ms, tile) * 100 END, 6) AS slope FROM v_timing GROUP BY run_id")
def agg18(s):
    return M.slope_per_100(s.v_timing, ["run_id"], "ms", "tile").withColumn("slope", F.round("slope", 6))


@R.add("agg19_crop_diagnostics", """SELECT run_id, count(*) AS n, round(sum(ms), 3) AS total, round(avg(ms), 5) AS mean, round(median(ms), 5) AS median, round(quantile_cont(ms, 0.95), 5) AS p95, round(stddev_pop(ms) / avg(ms), 5) AS cv, arg_max(tile, (ms, -tile)) AS slowest, arg_min(tile, (ms, tile)) AS fastest, count(*) FILTER (WHERE ms > 100) AS over_100, stddev_pop(ms) / avg(ms) < 0.1 AS uniform FROM v_timing GROUP BY run_id""")
def agg19(s):
    ms = F.col("ms")
    cv = F.stddev_pop(ms) / F.avg(ms)
    found = s.v_timing.groupBy("run_id").agg(F.count("*").alias("n"), F.round(F.sum(ms), 3).alias("total"), F.round(F.avg(ms), 5).alias("mean"), F.round(cv, 5).alias("cv"), F.max_by("tile", F.struct("ms", -F.col("tile"))).alias("slowest"), F.min_by("tile", F.struct("ms", "tile")).alias("fastest"), F.count_if(ms > 100).alias("over_100"), (cv < 0.1).alias("uniform"))
    return found.join(M.percentiles(s.v_timing, ["run_id"], "ms", (0.5, 0.95)), "run_id").select(*found.columns, F.round(F.col("q")[0], 5).alias("median"), F.round(F.col("q")[1], 5).alias("p95"))


@R.add("agg20_quantisation_frame", "SELECT project, minx, miny, (maxx - minx) / 9999 AS scale_x, (maxy - miny) / 9999 AS scale_y FROM (SELECT project, round(min(minx) / 1000.0, 6) AS minx, round(min(miny) / 1000.0, 6) AS miny, round(max(maxx) / 1000.0, 6) AS maxx, round(max(maxy) / 1000.0, 6) AS maxy FROM v_feature GROUP BY project)")
def agg20(s):
    box = s.v_feature.groupBy("project").agg(*[F.round(f(c) / 1000, 6).alias(c) for f, c in ((F.min, "minx"), (F.min, "miny"), (F.max, "maxx"), (F.max, "maxy"))])
    return box.select("project", "minx", "miny", ((F.col("maxx") - F.col("minx")) / 9999).alias("scale_x"), ((F.col("maxy") - F.col("miny")) / 9999).alias("scale_y"))


@R.add("agg21_metric_merge", "SELECT kind, name, label, CASE WHEN kind = 'histogram' THEN count(*) END AS observations, round(CASE WHEN kind = 'gauge' THEN arg_max(value, seq) ELSE sum(value) END, 4) AS value FROM v_metric_event GROUP BY kind, name, label")
def agg21(s):
    return M.merged_metrics(s.v_metric_event).withColumn("value", F.round("value", 4))


@R.add("agg22_download_rollup", "SELECT release, z, count(*) FILTER (WHERE status = 'available') AS available, count(*) FILTER (WHERE status = 'missing') AS missing_404, count(*) FILTER (WHERE status = 'failed') AS transient, count(*) FILTER (WHERE value < 5) AS cache_hits, sum(CASE WHEN value > 100 THEN 1 ELSE 0 END)::BIGINT AS slow, round(count(*) FILTER (WHERE status = 'missing') / count(*), 6) AS missing_ratio FROM v_tile_check GROUP BY release, z")
def agg22(s):
    is_ = lambda k: F.count_if(F.col("status") == k)
    return s.v_tile_check.groupBy("release", "z").agg(is_("available").alias("available"), is_("missing").alias("missing_404"), is_("failed").alias("transient"), F.count_if(F.col("value") < 5).alias("cache_hits"), F.sum(F.when(F.col("value") > 100, 1).otherwise(0)).alias("slow"), F.round(is_("missing") / F.count("*"), 6).alias("missing_ratio"))


@R.add("agg23_slowest_stage", "SELECT run_id, arg_max(field, (total, field)) AS slowest, round(sum(total), 3) AS runtime FROM (SELECT run_id, field, sum(ms) AS total FROM v_timing GROUP BY ALL) GROUP BY run_id")
def agg23(s):
    stages = s.v_timing.groupBy("run_id", "field").agg(F.sum("ms").alias("total"))
    return stages.groupBy("run_id").agg(F.max_by("field", F.struct("total", "field")).alias("slowest"), F.round(F.sum("total"), 3).alias("runtime"))


@R.add("agg24_folder_sizes", "SELECT source, lang, count(*) AS files, sum(size)::BIGINT AS bytes, max(size) AS largest FROM v_artifact GROUP BY source, lang")
def agg24(s):
    return s.v_artifact.groupBy("source", "lang").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.max("size").alias("largest"))


@R.add("agg25_path_patterns", "SELECT split_part(path, '/', 1) || '/' || split_part(path, '/', 2) AS pattern, count(*) AS n FROM v_artifact GROUP BY 1")
def agg25(s):
    return s.v_artifact.groupBy(F.substring_index("path", "/", 2).alias("pattern")).agg(F.count("*").alias("n"))


@R.add("agg26_reason_histogram", "SELECT reason, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN age_h < 24 THEN 'recent' END, CASE WHEN path LIKE '%.geojson' THEN 'result' END, CASE WHEN size > 5000 THEN 'large' END], lambda r: r IS NOT NULL)) AS reason FROM v_artifact) GROUP BY reason")
def agg26(s):
    reasons = F.array_compact(F.array(F.when(F.col("age_h") < 24, "recent"), F.when(F.col("path").endswith(".geojson"), "result"), F.when(F.col("size") > 5000, "large")))
    return s.v_artifact.select(F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@R.add("agg27_project_rollup", "SELECT project, count(*) AS milestones, count(*) FILTER (WHERE status = 'complete') AS complete, CASE WHEN bool_and(status = 'complete') THEN 'complete' ELSE 'incomplete' END AS status, min(release_date) AS first_date, max(release_date) AS last_date FROM v_milestone GROUP BY project")
def agg27(s):
    done = F.col("status") == "complete"
    return s.v_milestone.groupBy("project").agg(F.count("*").alias("milestones"), F.count_if(done).alias("complete"), F.when(F.bool_and(done), "complete").otherwise("incomplete").alias("status"), F.min("release_date").alias("first_date"), F.max("release_date").alias("last_date"))


@R.add("agg28_feature_counts", "SELECT project, release, CASE WHEN bool_or(feature_id % 50 = 0) THEN -1 ELSE count(*) END AS n FROM v_feature GROUP BY project, release")
def agg28(s):
    """Features in each published file, -1 for one that can't be read. Some files are cut off here."""
    k = F.col("feature_id")
    listed = F.array_join(F.collect_list(F.to_json(F.struct(F.lit("Feature").alias("type"), k.alias("id")))), ",")
    files = s.v_feature.groupBy("project", "release").agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), listed, F.when(F.bool_or(k % 50 == 0), "").otherwise("]}")).alias("body"))
    return files.select("project", "release", M.feature_count("body").alias("n"))


@R.add("agg29_outcome_counters", "SELECT CASE WHEN size IS NULL THEN 'skipped' WHEN size < 500 THEN 'kept' WHEN artifact_id % 50 = 0 THEN 'failed' ELSE 'migrated' END AS outcome, count(*) AS n, sum(size)::BIGINT AS bytes FROM v_artifact GROUP BY 1")
def agg29(s):
    outcome = F.when(F.col("size").isNull(), "skipped").when(F.col("size") < 500, "kept").when(F.col("artifact_id") % 50 == 0, "failed").otherwise("migrated")
    return s.v_artifact.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


_GROW = """SELECT run_id, coalesce(any_value(grows), false) AS grows FROM (SELECT DISTINCT run_id FROM v_timing) LEFT JOIN (SELECT run_id, count(*) >= 10 AND ((arg_max(v, k) - arg_min(v, k) > 50 AND avg(CAST(v >= pv AS DOUBLE)) >= 0.8) OR (regr_slope(v, k) * 100 > 50 AND max(v) - min(v) > 50)) AS grows
    FROM (SELECT *, lag(v) OVER (PARTITION BY run_id ORDER BY k) AS pv FROM (SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY tile) AS k, count(*) OVER (PARTITION BY run_id) AS n, ms + CASE WHEN run_id % 2 = 0 THEN tile ELSE 0 END AS v FROM v_timing) WHERE n >= 20 AND k > least(50, greatest(10, floor(n / 5)))) GROUP BY run_id) USING (run_id) GROUP BY run_id"""


@R.add("win10_memory_growth", _GROW)
def win10(s):
    rows = s.v_timing.withColumn("v", F.col("ms") + F.when(F.col("run_id") % 2 == 0, F.col("tile")).otherwise(0))
    return M.memory_growth(rows, "run_id", "tile", "v")


@R.add("agg30_memory_profile", "SELECT run_id, arg_min(ms, tile) AS first, arg_max(ms, tile) AS last, max(ms) AS peak, min(ms) AS least, round(max(ms) - min(ms), 6) AS range, round(regr_slope(ms, tile) * 100, 6) AS slope FROM v_timing GROUP BY run_id")
def agg30(s):
    return s.v_timing.groupBy("run_id").agg(F.min_by("ms", "tile").alias("first"), F.max_by("ms", "tile").alias("last"), F.max("ms").alias("peak"), F.min("ms").alias("least"), F.round(F.max("ms") - F.min("ms"), 6).alias("range"), F.round(F.regr_slope("ms", "tile") * 100, 6).alias("slope"))


_AB = "(SELECT field, sum(CASE WHEN run_id % 2 = 0 THEN ms END) AS base, sum(CASE WHEN run_id % 2 = 1 THEN ms END) AS variant, count(*) FILTER (WHERE run_id % 2 = 0) AS n_base, count(*) FILTER (WHERE run_id % 2 = 1) AS n_variant FROM v_timing GROUP BY field)"


@R.add("agg31_run_comparison", f"SELECT field, round(base, 3) AS base, round(variant, 3) AS variant, round(CASE WHEN base > 0 THEN (base - variant) / base * 100 END, 5) AS reduction_percent, n_base = n_variant AS same_count FROM {_AB}")
def agg31(s):
    sided = s.v_timing.withColumn("side", F.when(F.col("run_id") % 2 == 0, "base").otherwise("variant"))
    wide = sided.groupBy("field").pivot("side", ["base", "variant"]).agg(F.sum("ms").alias("ms"), F.count("ms").alias("n"))
    return wide.select("field", F.round("base_ms", 3).alias("base"), F.round("variant_ms", 3).alias("variant"), F.round(M.safe_ratio(F.col("base_ms") - F.col("variant_ms"), "base_ms") * 100, 5).alias("reduction_percent"), (F.col("base_n") == F.col("variant_n")).alias("same_count"))


@R.add("agg32_variant_acceptance", f"SELECT field, n_base > 0 AND n_variant > 0 AND abs(base - variant) / base <= 0.2 AND abs(n_base - n_variant) <= 100 AND variant >= 0 AND base >= 0 AND variant / n_variant < 100 AS accepted FROM {_AB}")
def agg32(s):
    even = F.col("run_id") % 2 == 0
    found = s.v_timing.groupBy("field").agg(F.sum(F.when(even, F.col("ms"))).alias("base"), F.sum(F.when(~even, F.col("ms"))).alias("variant"), F.count_if(even).alias("n_base"), F.count_if(~even).alias("n_variant"))
    return found.select("field", F.expr("n_base > 0 AND n_variant > 0 AND abs(base - variant) / base <= 0.2 AND abs(n_base - n_variant) <= 100 AND variant >= 0 AND base >= 0 AND variant / n_variant < 100").alias("accepted"))


@R.add("agg33_geometry_family", "SELECT project, CASE WHEN count(DISTINCT kind) = 1 THEN any_value(kind) ELSE 'mixed' END AS family FROM (SELECT project, CASE WHEN project % 3 = 0 THEN 'polygon' WHEN feature_id % 2 = 0 THEN 'line' ELSE 'point' END AS kind FROM v_feature) GROUP BY project")
def agg33(s):
    kind = F.when(F.col("project") % 3 == 0, "polygon").when(F.col("feature_id") % 2 == 0, "line").otherwise("point")
    found = s.v_feature.groupBy("project").agg(F.collect_set(kind).alias("kinds"))
    return found.select("project", F.when(F.size("kinds") == 1, F.col("kinds")[0]).otherwise("mixed").alias("family"))


@R.add("agg34_change_summary", "SELECT release, count(*) AS polygons, round(sum((maxx - minx) * (maxy - miny)) / 10000.0, 4) AS area_ha FROM v_feature WHERE layer = 'additions' GROUP BY release")
def agg34(s):
    return s.v_feature.where("layer = 'additions'").groupBy("release").agg(F.count("*").alias("polygons"), F.round(F.sum((F.col("maxx") - F.col("minx")) * (F.col("maxy") - F.col("miny"))) / 10000, 4).alias("area_ha"))


@R.add("agg35_pair_summary", "SELECT release, 't1' AS label, count(*) AS tiles, count(*) FILTER (WHERE status = 'available') AS available FROM v_tile_check WHERE z < 12 GROUP BY release UNION ALL SELECT release, 't2', count(*), count(*) FILTER (WHERE status = 'available') FROM v_tile_check WHERE z >= 12 GROUP BY release")
def agg35(s):
    side = lambda cond, k: s.v_tile_check.where(cond).groupBy("release").agg(F.count("*").alias("tiles"), F.count_if(F.col("status") == "available").alias("available")).withColumn("label", F.lit(k))
    return side("z < 12", "t1").unionByName(side("z >= 12", "t2"))


@R.add("agg36_tile_coverage", "SELECT release, round(CASE WHEN count(*) > 0 THEN 100.0 * count(*) FILTER (WHERE status = 'available') / count(*) END, 5) AS percent FROM v_tile_check GROUP BY release")
def agg36(s):
    return s.v_tile_check.groupBy("release").agg(F.round(M.safe_ratio(100.0 * F.count_if(F.col("status") == "available"), F.count("*")), 5).alias("percent"))


@R.add("agg37_layer_stats", "SELECT layer, count(*) AS n, min(minx) AS minx, min(miny) AS miny, max(maxx) AS maxx, max(maxy) AS maxy, sum((maxx - minx) * (maxy - miny))::BIGINT AS geometry_area, round(sum(p * (maxx - minx)), 2) AS property_area FROM v_feature GROUP BY layer")
def agg37(s):
    bbox = [f(f"{e}{v}").alias(f"{e}{v}") for f, e in ((F.min, "min"), (F.max, "max")) for v in "xy"]
    return s.v_feature.groupBy("layer").agg(F.count("*").alias("n"), *bbox, F.sum(F.expr("(maxx - minx) * (maxy - miny)")).alias("geometry_area"), F.round(F.sum(F.expr("p * (maxx - minx)")), 2).alias("property_area"))


@R.add("agg38_growth_kpis", "SELECT release, round(share, 6) AS share, CASE WHEN share IS NULL THEN 'unknown' WHEN share >= 0.5 THEN 'strong' WHEN share >= 0.2 THEN 'moderate' WHEN share > 0 THEN 'slight' ELSE 'none' END AS growth FROM (SELECT release, CASE WHEN total > 0 THEN (n_buffers * 20000) / total END AS share FROM v_milestone)")
def agg38(s):
    share = M.safe_ratio(F.col("n_buffers") * 20000, "total")
    return s.v_milestone.select("release", F.round(share, 6).alias("share"), M.growth_class(share).alias("growth"))


@R.add("agg39_large_results", "SELECT project, CASE WHEN most > 5 THEN most ELSE 0 END AS n FROM (SELECT project, greatest(count(*), coalesce(max(n_buffers), 0)) AS most FROM v_milestone GROUP BY project)")
def agg39(s):
    found = s.v_milestone.groupBy("project").agg(F.greatest(F.count("*"), F.coalesce(F.max("n_buffers"), F.lit(0))).alias("most"))
    return found.select("project", F.when(F.col("most") > 5, F.col("most")).otherwise(0).cast("bigint").alias("n"))


@R.add("agg40_project_extent", f"""WITH e AS (SELECT project, count(minx) = 0 AS fallback, count(DISTINCT layer) FILTER (WHERE minx IS NOT NULL) AS sources, coalesce(min(minx), 0) / {PLANE_SCALE}.0 + {PLANE_LON} AS w, coalesce(min(miny), 0) / {PLANE_SCALE}.0 + {PLANE_LAT} AS s, coalesce(max(maxx), 4000) / {PLANE_SCALE}.0 + {PLANE_LON} AS e, coalesce(max(maxy), 4000) / {PLANE_SCALE}.0 + {PLANE_LAT} AS n FROM v_project LEFT JOIN (SELECT * FROM v_feature WHERE p > 0.05) USING (project) GROUP BY project),
    m AS (SELECT project, fallback, sources, w * {math.pi} / 180 * 6378137 AS x0, ln(tan({math.pi} / 4 + s * {math.pi} / 360)) * 6378137 AS y0, e * {math.pi} / 180 * 6378137 AS x1, ln(tan({math.pi} / 4 + n * {math.pi} / 360)) * 6378137 AS y1 FROM e)
    SELECT project, fallback, sources, round(x0 - 0.1 * (x1 - x0), 2) AS minx, round(y0 - 0.1 * (y1 - y0), 2) AS miny, round(x1 + 0.1 * (x1 - x0), 2) AS maxx, round(y1 + 0.1 * (y1 - y0), 2) AS maxy FROM m""")
def agg40(s):
    """Bounds of each project's valid layers in Web-Mercator metres, a tenth wider on each side; where there are none, those of
    the area."""
    f = s.v_feature.where("p > 0.05")
    degrees = {c: F.col(c) / PLANE_SCALE + (PLANE_LON if c.endswith("x") else PLANE_LAT) for c in ("minx", "miny", "maxx", "maxy")}
    area = (PLANE_LON, PLANE_LAT, 4000 / PLANE_SCALE + PLANE_LON, 4000 / PLANE_SCALE + PLANE_LAT)
    found = M.padded_extent(s.v_project.select("project"), f.withColumns(degrees), "project", "layer", area, 0.1)
    return found.select("project", "fallback", "sources", *[F.round(c, 2).alias(c) for c in degrees])


@R.add("agg41_benchmark_row", "SELECT run_id, count(*) AS tiles, round(count(*) / (sum(ms) / 1000), 5) AS per_second, round(avg(ms) / 1000, 6) AS mean_s, round(quantile_cont(ms, 0.95) / 1000, 6) AS p95_s, round(count(*) FILTER (WHERE field = 'view') / count(*), 6) AS reuse FROM v_timing GROUP BY run_id")
def agg41(s):
    ms = F.col("ms")
    found = s.v_timing.groupBy("run_id").agg(F.count("*").alias("tiles"), F.round(M.safe_ratio(F.count("*"), F.sum(ms) / 1000), 5).alias("per_second"), F.round(F.avg(ms) / 1000, 6).alias("mean_s"), F.round(M.safe_ratio(F.count_if(F.col("field") == "view"), F.count("*")), 6).alias("reuse"))
    return found.join(M.percentiles(s.v_timing, ["run_id"], "ms", (0.95,)), "run_id").select(*found.columns, F.round(F.col("q")[0] / 1000, 6).alias("p95_s"))


@R.add("agg42_backfill_report", "SELECT CASE WHEN path LIKE '%.tmp' THEN 'skip' WHEN size > 4000 THEN 'create' ELSE 'present' END AS status, count(*) AS n, sum(CASE WHEN path NOT LIKE '%.tmp' AND size > 4000 THEN size ELSE 0 END)::BIGINT AS bytes_to_create FROM v_artifact GROUP BY 1")
def agg42(s):
    status = F.when(F.col("path").endswith(".tmp"), "skip").when(F.col("size") > 4000, "create").otherwise("present")
    return s.v_artifact.withColumn("status", status).groupBy("status").agg(F.count("*").alias("n"), F.sum(F.when(F.col("status") == "create", F.col("size")).otherwise(0)).alias("bytes_to_create"))


@R.add("ras17_window_valid_stats", "SELECT raster, count(*) AS total, count(*) FILTER (WHERE p > 0.1) AS valid, count(*) FILTER (WHERE p <= 0.1) AS nodata, round(100.0 * count(*) FILTER (WHERE p > 0.1) / count(*), 5) AS coverage FROM v_pixel GROUP BY raster")
def ras17(s):
    valid = F.count_if(F.col("p") > 0.1)
    return s.v_pixel.groupBy("raster").agg(F.count("*").alias("total"), valid.alias("valid"), (F.count("*") - valid).alias("nodata"), F.round(100.0 * valid / F.count("*"), 5).alias("coverage"))


@R.add("st10_child_timings", "SELECT run_id, field AS stage, round(sum(ms), 3) AS ms FROM v_timing WHERE run_id < 10 GROUP BY ALL UNION ALL SELECT run_id - 10, 'child.' || field, round(sum(ms), 3) FROM v_timing WHERE run_id >= 10 GROUP BY ALL")
def st10(s):
    """A child run's stages under its parent, with a prefix."""
    own = s.v_timing.where("run_id < 10").select("run_id", F.col("field").alias("stage"), "ms")
    child = s.v_timing.where("run_id >= 10").select((F.col("run_id") - 10).alias("run_id"), F.concat(F.lit("child."), "field").alias("stage"), "ms")
    return own.unionByName(child).groupBy("run_id", "stage").agg(F.round(F.sum("ms"), 3).alias("ms"))


@R.add("win18_running_tiles", "SELECT run_id, tile, count(*) OVER w AS tiles, round(ms - lag(ms) OVER w, 6) AS delta FROM v_timing WINDOW w AS (PARTITION BY run_id ORDER BY tile)")
def win18(s):
    w = W.partitionBy("run_id").orderBy("tile")
    return s.v_timing.select("run_id", "tile", F.count("*").over(w).alias("tiles"), F.round(F.col("ms") - F.lag("ms").over(w), 6).alias("delta"))
