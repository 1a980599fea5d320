"""Queries of windows, orders, top lists and set operations."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from landfold.operators import timeline as T
from landfold.operators.metrics import safe_ratio
from landfold.plans.base import Registry

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.oracle
_O = "PARTITION BY project ORDER BY release_date, release"


@R.add("win01_previous_complete", f"SELECT release, lag(release) OVER ({_O}) AS previous FROM v_milestone WHERE status = 'complete'")
def win01(s):
    return T.with_previous(s.v_milestone.where("status = 'complete'"), "project", ["release_date", "release"], {"release": "previous"}).select("release", "previous")


@R.add("win02_growth", f"SELECT release, round(total - lag(total) OVER ({_O}), 4) AS growth FROM v_milestone WHERE status = 'complete'")
def win02(s):
    m = T.with_previous(s.v_milestone.where("status = 'complete'"), "project", ["release_date", "release"], {"total": "before"})
    return m.select("release", F.round(F.col("total") - F.col("before"), 4).alias("growth"))


@R.add("win03_growth_ratio", f"SELECT release, round(CASE WHEN before > 0 THEN (total - before) / before END, 9) AS ratio FROM (SELECT *, lag(total) OVER ({_O}) AS before FROM v_milestone WHERE status = 'complete')")
def win03(s):
    """A ratio, although reports call it a percentage."""
    m = T.with_previous(s.v_milestone.where("status = 'complete'"), "project", ["release_date", "release"], {"total": "before"})
    return m.select("release", F.round(safe_ratio(F.col("total") - F.col("before"), "before"), 9).alias("ratio"))


@R.add("win06_chronology", "SELECT release, row_number() OVER (PARTITION BY project ORDER BY CASE WHEN n_buffers > 0 THEN release_date END NULLS LAST, release) AS position FROM v_milestone")
def win06(s):
    m = s.v_milestone.withColumn("day", F.when(F.col("n_buffers") > 0, F.col("release_date")))
    return m.select("release", F.row_number().over(W.partitionBy("project").orderBy(F.asc_nulls_last("day"), "release")).cast("bigint").alias("position"))


@R.add("win07_stable_ids", "SELECT feature_id, CAST(year(release_date) AS VARCHAR) || '-' || layer || '-' || lpad(CAST(row_number() OVER (PARTITION BY project, year(release_date), layer ORDER BY release, feature_id) AS VARCHAR), 6, '0') AS id FROM v_feature")
def win07(s):
    return s.v_feature.select("feature_id", T.stable_id(["project"], F.year("release_date"), "layer", ["release", "feature_id"]).alias("id"))


@R.add("win08_period_label", f"SELECT release, coalesce(CAST(last_value(y IGNORE NULLS) OVER ({_O} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS VARCHAR), 'baseline') || '-' || CAST(year(release_date) AS VARCHAR) AS period FROM (SELECT *, CASE WHEN n_buffers > 0 THEN year(release_date) END AS y FROM v_milestone)")
def win08(s):
    m = s.v_milestone.withColumn("y", F.when(F.col("n_buffers") > 0, F.year("release_date")))
    before = F.last("y", ignorenulls=True).over(W.partitionBy("project").orderBy("release_date", "release").rowsBetween(W.unboundedPreceding, -1))
    return m.select("release", F.concat(F.coalesce(before.cast("string"), F.lit("baseline")), F.lit("-"), F.year("release_date").cast("string")).alias("period"))


@R.add("win09_pair_source", f"SELECT release, last_value(CASE WHEN status = 'complete' THEN release END IGNORE NULLS) OVER ({_O} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS source FROM v_milestone")
def win09(s):
    return s.v_milestone.select("release", T.last_successful("project", ["release_date", "release"], F.col("status") == "complete", "release").alias("source"))


@R.add("win11_dirty_prefix", f"SELECT release, position, position >= coalesce(dirty, 1000000) AS rerun FROM (SELECT *, min(CASE WHEN status = 'error' THEN position END) OVER (PARTITION BY project) AS dirty FROM (SELECT *, row_number() OVER ({_O}) AS position FROM v_milestone))")
def win11(s):
    return T.dirty_prefix(s.v_milestone, "project", ["release_date", "release"], F.col("status") == "error").select("release", "position", "rerun")


@R.add("win12_progress", "SELECT run_id, tile, done, round(done / nullif(elapsed, 0), 9) AS rate, round((total - done) * elapsed / done, 9) AS eta FROM (SELECT run_id, tile, count(*) OVER w AS done, count(*) OVER (PARTITION BY run_id) AS total, sum(ms) OVER w / 1000 AS elapsed FROM v_timing WINDOW w AS (PARTITION BY run_id ORDER BY tile))")
def win12(s):
    return T.progress(s.v_timing, "run_id", "tile", "ms").select("run_id", "tile", "done", F.round("rate", 9).alias("rate"), F.round("eta", 9).alias("eta"))


@R.add("win13_crop_overlap", "WITH o AS (SELECT *, row_number() OVER w AS k, lag(minx) OVER w AS pminx, lag(maxx) OVER w AS pmaxx, lag(miny) OVER w AS pminy, lag(maxy) OVER w AS pmaxy FROM v_feature WINDOW w AS (PARTITION BY project ORDER BY minx, miny, feature_id)), cells AS (SELECT *, unnest(range(minx // 10, maxx // 10)) AS cx FROM o), cell AS (SELECT *, unnest(range(miny // 10, maxy // 10)) AS cy FROM cells), first AS (SELECT project, cx, cy, min(k) AS first_k FROM cell GROUP BY ALL), r AS (SELECT feature_id, round(count(*) FILTER (WHERE first_k < k) / count(*), 6) AS redundancy FROM cell JOIN first USING (project, cx, cy) GROUP BY feature_id) SELECT feature_id, CASE WHEN pminx IS NULL THEN 0 ELSE greatest(least(maxx, pmaxx) - greatest(minx, pminx), 0) * greatest(least(maxy, pmaxy) - greatest(miny, pminy), 0) END AS overlap, redundancy FROM o JOIN r USING (feature_id)")
def win13(s):
    """Overlap with the crop before, and the share of a crop's pixels that any earlier crop has."""
    from landfold.operators import cells as C

    by = W.partitionBy("project").orderBy("minx", "miny", "feature_id")
    f = T.with_previous(s.v_feature, "project", ["minx", "miny", "feature_id"], {c: f"p{c}" for c in ("minx", "maxx", "miny", "maxy")}).withColumn("k", F.row_number().over(by))
    side = lambda lo, hi: F.greatest(F.least(hi, f"p{hi}") - F.greatest(lo, f"p{lo}"), F.lit(0))
    cells = C.cells_of_boxes(f, ["project", "feature_id", "k"], 10)
    first = C.first_seen(cells, ["project"], "k").withColumnRenamed("k", "first_k")
    seen = cells.join(first, ["project", "cx", "cy"]).groupBy("feature_id").agg(F.round(F.count_if(F.col("first_k") < F.col("k")) / F.count("*"), 6).alias("redundancy"))
    return f.join(seen, "feature_id").select("feature_id", F.when(F.col("pminx").isNull(), 0).otherwise(side("minx", "maxx") * side("miny", "maxy")).cast("bigint").alias("overlap"), "redundancy")


@R.add("win14_cumulative_set", f"SELECT project, release FROM (SELECT *, row_number() OVER ({_O}) AS k FROM v_milestone) WHERE k > 1 AND k <= 4")
def win14(s):
    """Milestones up to the selected one (here the fourth), without the baseline."""
    k = F.row_number().over(W.partitionBy("project").orderBy("release_date", "release"))
    return s.v_milestone.withColumn("k", k).where("k > 1 AND k <= 4").select("project", "release")


@R.add("win16_latest_per_key", "SELECT project, arg_max(run_id, (created_at, run_id)) AS run_id, max(created_at) AS created_at FROM v_run GROUP BY project")
def win16(s):
    return T.latest(s.v_run, ["project"], ["created_at", "run_id"]).select("project", "run_id", "created_at")


@R.add("win17_timeline_labels", f"SELECT release, CASE WHEN k = 1 THEN 'before ' || coalesce(nxt, label) ELSE label END AS label FROM (SELECT *, row_number() OVER ({_O}) AS k, lead(label) OVER ({_O}) AS nxt FROM (SELECT *, strftime(release_date, '%Y-%m') AS label FROM v_milestone))")
def win17(s):
    w = W.partitionBy("project").orderBy("release_date", "release")
    label = F.date_format("release_date", "yyyy-MM")
    m = s.v_milestone.withColumn("label", label).withColumns({"k": F.row_number().over(w), "next": F.lead("label").over(w)})
    return m.select("release", F.when(F.col("k") == 1, F.concat(F.lit("before "), F.coalesce("next", "label"))).otherwise(F.col("label")).alias("label"))


@R.add("top01_largest_files", "SELECT artifact_id, size FROM v_artifact WHERE size >= 1000 ORDER BY size DESC, artifact_id LIMIT 20")
def top01(s):
    return s.v_artifact.where("size >= 1000").orderBy(F.desc("size"), "artifact_id").limit(20).select("artifact_id", "size")


@R.add("top02_newest_jobs", "SELECT event_id, status FROM v_job ORDER BY ts DESC, event_id DESC LIMIT 50")
def top02(s):
    return s.v_job.orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", "status")


@R.add("top03_slowest_crops", "SELECT run_id, ranking, CAST(k AS BIGINT) AS k, tile FROM (SELECT run_id, tile, 'slowest' AS ranking, row_number() OVER (PARTITION BY run_id ORDER BY ms DESC, field, tile) AS k FROM v_timing UNION ALL SELECT run_id, tile, 'padding', row_number() OVER (PARTITION BY run_id ORDER BY tile % 100 DESC, ms DESC, tile) FROM v_timing UNION ALL SELECT run_id, tile, 'contribution', row_number() OVER (PARTITION BY run_id ORDER BY tile % 37, ms DESC, tile) FROM v_timing) SEMI JOIN (SELECT run_id FROM v_timing GROUP BY run_id HAVING count(*) > 100) USING (run_id) WHERE k <= 20")
def top03(s):
    """The 20 slowest, those with most padding and those that contribute least, of each run with over 100 crops."""
    crops = s.v_timing.withColumns({"padding": F.col("tile") % 100, "contribution": F.col("tile") % 37})
    large = crops.groupBy("run_id").agg(F.count("*").alias("n")).where("n > 100").select("run_id")
    orders = {"slowest": [F.desc("ms"), "field", "tile"], "padding": [F.desc("padding"), F.desc("ms"), "tile"], "contribution": ["contribution", F.desc("ms"), "tile"]}
    found = None
    for name, order in orders.items():
        own = T.top_of(crops.join(large, "run_id", "left_semi"), "run_id", order, 20).withColumn("ranking", F.lit(name))
        found = own if found is None else found.unionByName(own)
    return found.select("run_id", "ranking", F.col("k").cast("bigint").alias("k"), "tile")


@R.add("top04_release_selector", "SELECT project, max(CASE WHEN k = 1 THEN release END) AS latest, max(CASE WHEN k = 3 THEN release END) AS latest_minus_2 FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY release_date DESC, release DESC) AS k FROM v_milestone) GROUP BY project")
def top04(s):
    k = F.row_number().over(W.partitionBy("project").orderBy(F.desc("release_date"), F.desc("release")))
    ranked = s.v_milestone.withColumn("k", k).where("k IN (1, 3)")
    every = s.v_milestone.select("project").distinct()
    return every.join(ranked, "project", "left").groupBy("project").agg(F.max(F.when(F.col("k") == 1, F.col("release"))).alias("latest"), F.max(F.when(F.col("k") == 3, F.col("release"))).alias("latest_minus_2"))


@R.add("top04_all_selectors", """WITH m AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY release_date DESC, release DESC) AS k FROM v_milestone),
    r AS (SELECT DISTINCT project, unnest(['latest', ' latest_minus_1', 'latest_minus_9', least_id, day, 'newest']) AS selector FROM (SELECT project, min(release)::VARCHAR AS least_id, max(release_date)::VARCHAR AS day FROM v_milestone GROUP BY project)),
    x AS (SELECT r.project, r.selector, m.release, m.release_date, row_number() OVER (PARTITION BY r.project, r.selector ORDER BY m.k DESC) AS n FROM r LEFT JOIN m ON m.project = r.project AND CASE WHEN r.selector = 'latest' THEN m.k = 1 WHEN r.selector LIKE '%latest_minus%' THEN m.k = right(r.selector, 1)::INT + 1 ELSE m.release::VARCHAR = r.selector OR m.release_date::VARCHAR = r.selector END)
    SELECT project, selector, release, CASE WHEN release IS NULL THEN CASE WHEN selector LIKE '%minus%' THEN 'older_than_first' ELSE 'unknown_selector' END END AS reason FROM x WHERE n = 1""")
def top04_all(s):
    """Every kind of selector for every project: by place, identifier and date, with ones that find nothing."""
    m = s.v_milestone.select("project", "release", "release_date")
    own = m.groupBy("project").agg(F.min("release").cast("string").alias("i"), F.max("release_date").cast("string").alias("d"))
    fixed = [F.lit(x) for x in ("latest", " latest_minus_1", "latest_minus_9", "newest")]
    asked = own.select("project", F.explode(F.array(*fixed, "i", "d")).alias("selector"))
    return T.selected_releases(m, asked, "project").drop("release_date")


@R.add("top05_export_order", "SELECT feature_id, row_number() OVER (PARTITION BY project ORDER BY coalesce(CASE WHEN feature_id % 9 > 0 THEN strftime(release_date, '%Y-%m-%d') END, '9999-99-99'), CASE layer WHEN 'additions' THEN 1 WHEN 'effective' THEN 2 ELSE 3 END, layer, feature_id) AS place FROM v_feature")
def top05(s):
    """By date, empty last; then by the layers' own order."""
    day = F.coalesce(F.when(F.col("feature_id") % 9 > 0, F.date_format("release_date", "yyyy-MM-dd")), F.lit("9999-99-99"))
    rank = F.when(F.col("layer") == "additions", 1).when(F.col("layer") == "effective", 2).otherwise(3)
    return s.v_feature.select("feature_id", F.row_number().over(W.partitionBy("project").orderBy(day, rank, "layer", "feature_id")).cast("bigint").alias("place"))


@R.add("top06_first_tiles", "SELECT run_id, tile FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY tile) AS k FROM v_timing) WHERE k <= 10")
def top06(s):
    return s.v_timing.withColumn("k", F.row_number().over(W.partitionBy("run_id").orderBy("tile"))).where("k <= 10").select("run_id", "tile")


@R.add("top07_widest_buffer", "SELECT project, arg_max(release, (n_buffers, release)) AS release, max(n_buffers) AS n_buffers FROM v_milestone GROUP BY project")
def top07(s):
    return s.v_milestone.groupBy("project").agg(F.max_by("release", F.struct("n_buffers", "release")).alias("release"), F.max("n_buffers").alias("n_buffers"))


@R.add("top08_zoom_fallback", "SELECT release, coalesce(max(CASE WHEN status = 'available' AND z <= 12 THEN z END), 12) AS zoom, max(CASE WHEN status = 'available' AND z <= 12 THEN z END) IS NULL OR max(CASE WHEN status = 'available' AND z <= 12 THEN z END) < 12 AS fallback FROM v_tile_check WHERE release % 2 = 0 OR z < 12 GROUP BY release")
def top08(s):
    """The highest zoom up to the preferred one that has coverage, else the preferred one."""
    best = F.max(F.when((F.col("status") == "available") & (F.col("z") <= 12), F.col("z")))
    found = s.v_tile_check.where("release % 2 = 0 OR z < 12").groupBy("release").agg(best.alias("best"))
    return found.select("release", F.coalesce("best", F.lit(12)).alias("zoom"), (F.col("best").isNull() | (F.col("best") < 12)).alias("fallback"))


@R.add("top09_layer_preference", "SELECT release, arg_min(x % 14, (CASE WHEN x % 14 = greatest(0, least(13, 23 - z)) THEN 0 ELSE 1 END, x % 14)) AS layer FROM v_tile_check WHERE status <> 'failed' GROUP BY release")
def top09(s):
    layer = F.col("x") % 14
    wanted = F.greatest(F.lit(0), F.least(F.lit(13), 23 - F.col("z")))
    return s.v_tile_check.where("status <> 'failed'").groupBy("release").agg(F.min_by(layer, F.struct(F.when(layer == wanted, 0).otherwise(1), layer)).alias("layer"))


@R.add("top10_part_order", "SELECT project, list(feature_id ORDER BY round((minx + maxx) / 2, 8), round((miny + maxy) / 2, 8), -((maxx - minx) * (maxy - miny)), feature_id) AS parts FROM v_feature WHERE layer = 'blocks' GROUP BY project")
def top10(s):
    """Parts by their centroids, then the largest first."""
    key = F.struct(F.round((F.col("minx") + F.col("maxx")) / 2, 8), F.round((F.col("miny") + F.col("maxy")) / 2, 8), F.expr("-((maxx - minx) * (maxy - miny))"), F.col("feature_id").alias("feature_id"))
    found = s.v_feature.where("layer = 'blocks'").groupBy("project").agg(F.array_sort(F.collect_list(key)).alias("p"))
    return found.select("project", F.transform("p", lambda x: x.feature_id).alias("parts"))


@R.add("top11_prefetch_plan", f"SELECT release FROM (SELECT *, row_number() OVER ({_O}) AS n FROM (SELECT *, row_number() OVER ({_O}) AS k FROM v_milestone) WHERE k > 1 AND status <> 'complete') WHERE n <= 2")
def top11(s):
    w = W.partitionBy("project").orderBy("release_date", "release")
    todo = s.v_milestone.withColumn("k", F.row_number().over(w)).where("k > 1 AND status <> 'complete'")
    return todo.withColumn("n", F.row_number().over(w)).where("n <= 2").select("release")


@R.add("set01_union_enriched", "SELECT feature_id, layer, 'source-' || layer AS origin FROM v_feature WHERE layer = 'additions' UNION ALL SELECT feature_id, layer, 'source-' || layer FROM v_feature WHERE layer = 'blocks'")
def set01(s):
    part = lambda k: s.v_feature.where(F.col("layer") == k).select("feature_id", "layer", F.concat(F.lit("source-"), "layer").alias("origin"))
    return part("additions").unionByName(part("blocks"))


@R.add("set02_tile_sets", "WITH a AS (SELECT DISTINCT z, x, y FROM v_tile_check WHERE status = 'available'), r AS (SELECT DISTINCT z, x, y FROM v_tile_check WHERE value > 50) SELECT *, 'requested' AS kind FROM (SELECT * FROM a INTERSECT SELECT * FROM r) UNION ALL SELECT *, 'missing' FROM (SELECT * FROM r EXCEPT SELECT * FROM a)")
def set02(s):
    tiles = s.v_tile_check
    a, r = (tiles.where(c).select("z", "x", "y").distinct() for c in ("status = 'available'", "value > 50"))
    return a.intersect(r).withColumn("kind", F.lit("requested")).unionByName(r.subtract(a).withColumn("kind", F.lit("missing")))


@R.add("set04_dedup_by_priority", "SELECT project, arg_min(run_id, (CASE WHEN kind = 'temporal' THEN 0 ELSE 1 END, -epoch_us(created_at), run_id)) AS run_id FROM v_run GROUP BY project")
def set04(s):
    """One row per key, the better source first, then the newest."""
    order = F.struct(F.when(F.col("kind") == "temporal", 0).otherwise(1), -F.unix_micros(F.col("created_at").cast("timestamp")), "run_id")
    return s.v_run.groupBy("project").agg(F.min_by("run_id", order).alias("run_id"))


_REQ = "(SELECT unnest(['view.loaded', 'click.loaded', 'export.loaded']) AS event)"


@R.add("set05_required_events", f"SELECT project, event, 'missing' AS kind FROM (SELECT DISTINCT project FROM v_client_event) CROSS JOIN {_REQ} WHERE (project, event) NOT IN (SELECT project, event FROM v_client_event) UNION ALL SELECT DISTINCT project, event, 'forbidden' FROM v_client_event WHERE event = 'error.loaded'")
def set05(s):
    """Required events that a project lacks, and forbidden ones that it has; the dimension has three rows."""
    required = s.spark.sql("SELECT explode(array('view.loaded', 'click.loaded', 'export.loaded')) AS event")
    seen = s.v_client_event.select("project", "event").distinct()
    missing = seen.select("project").distinct().crossJoin(F.broadcast(required)).join(seen, ["project", "event"], "left_anti")
    return missing.withColumn("kind", F.lit("missing")).unionByName(seen.where("event = 'error.loaded'").withColumn("kind", F.lit("forbidden")))


@R.add("set06_clean_project_list", "SELECT project, max(created_at) AS created_at FROM v_run WHERE kind <> 'pairwise' GROUP BY project")
def set06(s):
    return s.v_run.where("kind <> 'pairwise'").groupBy("project").agg(F.max("created_at").alias("created_at"))


@R.add("set07_multipolygon", "SELECT project, release, count(*) AS parts, min(feature_id) AS first FROM v_feature WHERE layer = 'effective' GROUP BY project, release")
def set07(s):
    """Parts of a collection under one geometry, nothing dissolved."""
    found = s.v_feature.where("layer = 'effective'").groupBy("project", "release").agg(F.array_sort(F.collect_list(F.struct("feature_id", "minx", "miny", "maxx", "maxy"))).alias("g"))
    return found.select("project", "release", F.size("g").cast("bigint").alias("parts"), F.col("g")[0].feature_id.alias("first"))


@R.add("set08_imagery_sources", "SELECT source, lang, list_filter([CASE WHEN length(path) < 12 THEN 'path' END, CASE WHEN size < 300 THEN 'size' END], lambda x: x IS NOT NULL) AS missing FROM (SELECT * FROM v_artifact WHERE path LIKE '%.tif' UNION ALL SELECT * FROM v_artifact WHERE path LIKE '%.csv')")
def set08(s):
    both = s.v_artifact.where("path LIKE '%.tif'").unionByName(s.v_artifact.where("path LIKE '%.csv'"))
    lacks = F.array_compact(F.array(F.when(F.length("path") < 12, "path"), F.when(F.col("size") < 300, "size")))
    return both.select("source", "lang", lacks.alias("missing"))


@R.add("set09_layer_catalog", "SELECT project, layer, n FROM (SELECT project, layer, count(*) AS n FROM v_feature GROUP BY ALL UNION ALL SELECT project, 'buffers', sum(n_buffers)::BIGINT FROM v_milestone GROUP BY project) WHERE n > 0")
def set09(s):
    vector = s.v_feature.groupBy("project", "layer").agg(F.count("*").alias("n"))
    buffers = s.v_milestone.groupBy("project").agg(F.sum("n_buffers").alias("n")).select("project", F.lit("buffers").alias("layer"), "n")
    return vector.unionByName(buffers).where("n > 0")
