"""Queries of relational joins, filters, retention and publication tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from landfold.operators import records as C
from landfold.operators.graph import BOX
from landfold.plans.base import Registry
from landfold.plans.geometry import feature_tiles

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.oracle


@R.add("join02_available_tiles", "SELECT DISTINCT z, x, y FROM v_tile_check a WHERE value > 20 AND EXISTS (SELECT 1 FROM v_tile_check b WHERE b.status = 'available' AND (b.z, b.x, b.y) = (a.z, a.x, a.y))")
def join02(s):
    t = s.v_tile_check
    return t.where("value > 20").select("z", "x", "y").distinct().join(t.where("status = 'available'"), ["z", "x", "y"], "left_semi")


@R.add("join10_release_dates", "SELECT r.run_id, coalesce(CASE WHEN r.run_id % 4 = 0 THEN CAST(created_at AS DATE) END, m.release_date) AS release_date FROM v_run r LEFT JOIN v_milestone m ON m.release = r.run_id AND m.status = 'complete'")
def join10(s):
    """Only missing dates are filled."""
    dates = s.v_milestone.where("status = 'complete'").select(F.col("release").alias("run_id"), "release_date")
    own = F.when(F.col("run_id") % 4 == 0, F.col("created_at").cast("date"))
    return s.v_run.withColumn("own", own).join(dates, "run_id", "left").select("run_id", F.coalesce("own", "release_date").alias("release_date"))


@R.add("join11_consecutive_pairs", "SELECT project, prev AS t1, release AS t2 FROM (SELECT project, release, lag(release) OVER (PARTITION BY project ORDER BY release_date, release) AS prev FROM v_milestone) WHERE prev IS NOT NULL")
def join11(s):
    prev = F.lag("release").over(W.partitionBy("project").orderBy("release_date", "release"))
    return s.v_milestone.select("project", prev.alias("t1"), F.col("release").alias("t2")).where("t1 IS NOT NULL")


@R.add("join12_run_for_milestone", """WITH m AS (SELECT release, project, CASE WHEN n_buffers > 0 THEN release END AS own, lead(CASE WHEN n_buffers > 0 THEN release END) OVER (PARTITION BY project ORDER BY release_date, release) AS nxt FROM v_milestone), r AS (SELECT run_id FROM v_run WHERE kind = 'temporal')
    SELECT release, coalesce(a.run_id, b.run_id) AS run_id, CASE WHEN a.run_id IS NOT NULL THEN 't2' WHEN b.run_id IS NOT NULL THEN 't1' END AS side FROM m LEFT JOIN r a ON a.run_id = m.own LEFT JOIN r b ON b.run_id = m.nxt""")
def join12(s):
    """A milestone's own pair, in which it is t2, else the next one's, in which it is t1."""
    own = F.when(F.col("n_buffers") > 0, F.col("release"))
    m = s.v_milestone.withColumn("own", own)
    m = m.select("release", "own", F.lead("own").over(W.partitionBy("project").orderBy("release_date", "release")).alias("next"))
    runs = s.v_run.where("kind = 'temporal'").select("run_id")
    a, b = runs.select(F.col("run_id").alias("a"), F.col("run_id").alias("own")), runs.select(F.col("run_id").alias("b"), F.col("run_id").alias("next"))
    j = m.join(a, "own", "left").join(b, "next", "left")
    return j.select("release", F.coalesce("a", "b").alias("run_id"), F.when(F.col("a").isNotNull(), "t2").when(F.col("b").isNotNull(), "t1").alias("side"))


_SUMMARY = "SELECT p.project, coalesce(n, 0) AS milestones, coalesce(done, 0) AS complete, last_date, latest_run FROM v_project p LEFT JOIN (SELECT project, count(*) AS n, count(*) FILTER (WHERE status = 'complete') AS done, max(release_date) AS last_date FROM v_milestone GROUP BY project) USING (project) LEFT JOIN (SELECT project, arg_max(run_id, (created_at, run_id)) AS latest_run FROM v_run GROUP BY project) USING (project)"


@R.add("join13_project_summary", _SUMMARY)
def join13(s):
    return C.summaries(s.v_project, s.v_milestone, s.v_run).select("project", "milestones", "complete", "last_date", "latest_run")


@R.add("join14_summary_view", """SELECT p.project, p.name, coalesce(n, 0) AS milestones, coalesce(done, 0) AS complete, latest_run, job_id, job_status, bundle FROM v_project p LEFT JOIN (SELECT project, count(*) AS n, count(*) FILTER (WHERE status = 'complete') AS done FROM v_milestone GROUP BY project) USING (project) LEFT JOIN (SELECT project, arg_max(run_id, (created_at, run_id)) AS latest_run FROM v_run GROUP BY project) USING (project)
    LEFT JOIN (SELECT project, arg_max(job_id, (ts, event_id)) AS job_id, arg_max(status, (ts, event_id)) AS job_status FROM (SELECT job_id AS project, * FROM v_job UNION ALL SELECT job_id + 50 AS project, * FROM v_job WHERE job_id % 2 = 0) GROUP BY project) USING (project)
    LEFT JOIN (SELECT request AS project, max(artifact_id) AS bundle FROM v_artifact WHERE path LIKE '%.csv' GROUP BY request) USING (project)""")
def join14(s):
    """Milestones and complete ones, the latest run, job and bundle of every project. A job matches by either of two keys: a
    union of two equi-joins in place of an OR."""
    jobs = s.v_job.withColumn("project", F.col("job_id")).unionByName(s.v_job.where("job_id % 2 = 0").withColumn("project", F.col("job_id") + 50))
    last = F.struct("ts", "event_id")
    latest = jobs.groupBy("project").agg(F.max_by("job_id", last).alias("job_id"), F.max_by("status", last).alias("job_status"))
    bundles = s.v_artifact.where("path LIKE '%.csv'").groupBy(F.col("request").alias("project")).agg(F.max("artifact_id").alias("bundle"))
    whole = C.summaries(s.v_project, s.v_milestone, s.v_run).join(latest, "project", "left").join(bundles, "project", "left")
    return whole.select("project", "name", "milestones", "complete", "latest_run", "job_id", "job_status", "bundle")


@R.add("join15_milestone_listing", "SELECT m.release, p.name, m.release_date, r.cost FROM v_milestone m JOIN v_project p USING (project) LEFT JOIN (SELECT * FROM v_run WHERE kind = 'temporal') r ON r.run_id = m.release")
def join15(s):
    runs = s.v_run.where("kind = 'temporal'").select(F.col("run_id").alias("release"), "cost")
    return s.v_milestone.join(s.v_project.select("project", "name"), "project").join(runs, "release", "left").select("release", "name", "release_date", "cost")


@R.add("join16_artifact_listing", "SELECT artifact_id, p.name, m.release FROM v_artifact a JOIN v_project p ON p.project = a.request LEFT JOIN v_milestone m ON m.release = a.artifact_id")
def join16(s):
    names = s.v_project.select(F.col("project").alias("request"), "name")
    return s.v_artifact.join(names, "request").join(s.v_milestone.select(F.col("release").alias("artifact_id"), "release"), "artifact_id", "left").select("artifact_id", "name", "release")


@R.add("join17_latest_temporal_run", "SELECT project, arg_max(run_id, (created_at, run_id)) AS run_id FROM v_run WHERE kind = 'temporal' GROUP BY project")
def join17(s):
    return s.v_run.where("kind = 'temporal'").groupBy("project").agg(F.max_by("run_id", F.struct("created_at", "run_id")).alias("run_id"))


@R.add("join18_request_matches", "SELECT DISTINCT a.artifact_id, m.release FROM v_artifact a JOIN (SELECT release, release AS k FROM v_milestone UNION ALL SELECT release, release * 7 % 5000 FROM v_milestone WHERE n_buffers = 0 UNION ALL SELECT release, release // 3 FROM v_milestone WHERE status = 'complete') m ON m.k = a.artifact_id")
def join18(s):
    """Any of three keys matches: candidate keys are exploded and joined once."""
    r = F.col("release")
    keys = F.array_compact(F.array(r, F.when(F.col("n_buffers") == 0, r * 7 % 5000), F.when(F.col("status") == "complete", F.floor(r / 3))))
    m = s.v_milestone.select("release", F.explode(keys).alias("artifact_id"))
    return s.v_artifact.select("artifact_id").join(m, "artifact_id").distinct()


@R.add("join19_orphans", "SELECT artifact_id, EXISTS (SELECT 1 FROM v_reference r WHERE r.target = a.request) AS protected FROM v_artifact a")
def join19(s):
    kept, orphans = C.referenced(s.v_artifact, s.v_reference, "request", "target")
    return kept.select("artifact_id", F.lit(True).alias("protected")).unionByName(orphans.select("artifact_id", F.lit(False).alias("protected")))


@R.add("join20_missing_references", "SELECT artifact_id, target FROM v_reference WHERE target * 31 NOT IN (SELECT artifact_id FROM v_artifact WHERE path LIKE '%.tif')")
def join20(s):
    there = s.v_artifact.where("path LIKE '%.tif'").select("artifact_id").withColumnRenamed("artifact_id", "wanted")
    return s.v_reference.withColumn("wanted", F.col("target") * 31).join(there, "wanted", "left_anti").select("artifact_id", "target")


@R.add("join21_published_duplicates", "SELECT a.artifact_id, arg_min(b.artifact_id, (m.rank, b.artifact_id)) AS published, CASE WHEN any_value(k.kind) IS NULL THEN 'no_expected_name' WHEN min(b.artifact_id) IS NULL THEN 'not_published' END AS skipped FROM (SELECT *, regexp_extract(path, '([._][a-z.]+)$', 1) AS kind FROM v_artifact WHERE NOT contains(path, '.geojson')) a LEFT JOIN (SELECT DISTINCT kind FROM (VALUES ('.tmp'), ('.tif')) x(kind)) k ON k.kind = a.kind LEFT JOIN (VALUES ('.tmp', '.geojson', 1), ('.tmp', '.csv', 2), ('.tif', '.geojson', 1)) m(kind, expected, rank) ON m.kind = a.kind LEFT JOIN (SELECT artifact_id, source, lang, request, regexp_extract(path, '([._][a-z.]+)$', 1) AS expected FROM v_artifact WHERE size > 500) b ON b.source = a.source AND b.lang = a.lang AND b.request % 7 = a.request % 7 AND b.expected = m.expected GROUP BY a.artifact_id")
def join21(s):
    """A file of a request counts as published if the project has one of the names expected for its stem; the first expected
    name wins. The mapping of stems to names is a dimension of fixed size."""
    kind = F.regexp_extract("path", "([._][a-z.]+)$", 1)
    expected = s.spark.createDataFrame([(".tmp", ".geojson", 1), (".tmp", ".csv", 2), (".tif", ".geojson", 1)], "kind string, expected string, rank int")
    files = s.v_artifact.withColumns({"kind": kind, "key": F.col("request") % 7})
    there = files.where("size > 500").select("source", "lang", "key", F.col("kind").alias("expected"), F.col("artifact_id").alias("found"))
    wanted = files.where(~F.col("path").contains(".geojson")).select("artifact_id", "source", "lang", "key", "kind").join(F.broadcast(expected), "kind", "left")
    met = wanted.join(there, ["source", "lang", "key", "expected"], "left")
    found = met.groupBy("artifact_id").agg(F.min_by("found", F.when(F.col("found").isNotNull(), F.struct("rank", "found"))).alias("published"), F.max("rank").alias("rank"))
    return found.select("artifact_id", "published", F.when(F.col("rank").isNull(), "no_expected_name").when(F.col("published").isNull(), "not_published").alias("skipped"))


@R.add("join22_canonical_links", "SELECT a.artifact_id, CASE WHEN n IS NULL THEN 'none' WHEN n = 1 THEN 'one' ELSE 'many' END AS match FROM (SELECT artifact_id, artifact_id % 300 AS k FROM v_artifact) a LEFT JOIN (SELECT artifact_id % 211 AS k, count(*) AS n FROM v_reference GROUP BY 1) USING (k)")
def join22(s):
    links = s.v_reference.select((F.col("artifact_id") % 211).alias("k"), "target")
    return C.ambiguous_match(s.v_artifact.select("artifact_id", (F.col("artifact_id") % 300).alias("k")), links, ["k"], "target").select("artifact_id", "match")


@R.add("join23_imagery_links", "SELECT m.release, CASE WHEN n IS NULL THEN 'none' WHEN n = 1 THEN 'one' ELSE 'many' END AS match, CASE WHEN n = 1 THEN a END AS matched FROM v_milestone m LEFT JOIN (SELECT source, lang, count(*) AS n, any_value(artifact_id) AS a FROM v_artifact WHERE size > 9000 GROUP BY ALL) c ON c.source = concat('src', CAST(m.release % 25 AS VARCHAR)) AND c.lang = CASE m.n_buffers WHEN 0 THEN 'en' WHEN 1 THEN 'de' WHEN 2 THEN 'fr' ELSE 'es' END")
def join23(s):
    lang = F.when(F.col("n_buffers") == 0, "en").when(F.col("n_buffers") == 1, "de").when(F.col("n_buffers") == 2, "fr").otherwise("es")
    wanted = s.v_milestone.select("release", F.concat(F.lit("src"), (F.col("release") % 25).cast("string")).alias("source"), lang.alias("lang"))
    return C.ambiguous_match(wanted, s.v_artifact.where("size > 9000").select("source", "lang", "artifact_id"), ["source", "lang"], "artifact_id").select("release", "match", "matched")


@R.add("join24_expected_events", "SELECT p.project, e.event FROM (SELECT DISTINCT project FROM v_client_event) p CROSS JOIN (SELECT unnest(['signup.loaded', 'export.loaded']) AS event) e ANTI JOIN v_client_event c ON c.project = p.project AND c.event = e.event")
def join24(s):
    required = s.spark.sql("SELECT explode(array('signup.loaded', 'export.loaded')) AS event")
    return s.v_client_event.select("project").distinct().crossJoin(F.broadcast(required)).join(s.v_client_event.select("project", "event"), ["project", "event"], "left_anti")


@R.add("join25_plan_reuse", "SELECT m.release, r.run_id IS NOT NULL AND a.artifact_id IS NOT NULL AS reusable FROM v_milestone m LEFT JOIN (SELECT run_id FROM v_run WHERE kind = 'temporal') r ON r.run_id = m.release LEFT JOIN v_artifact a ON a.artifact_id = m.release")
def join25(s):
    runs = s.v_run.where("kind = 'temporal'").select(F.col("run_id").alias("release"), F.lit(True).alias("cached"))
    files = s.v_artifact.select(F.col("artifact_id").alias("release"), F.lit(True).alias("there"))
    j = s.v_milestone.select("release").join(runs, "release", "left").join(files, "release", "left")
    return j.select("release", (F.coalesce("cached", F.lit(False)) & F.coalesce("there", F.lit(False))).alias("reusable"))


@R.add("join26_shared_mosaic", "SELECT t.event_id, min(a.artifact_id) AS mosaic FROM (SELECT event_id, x % 97 AS request, y * 10 AS need FROM v_tile_check) t LEFT JOIN v_artifact a ON a.request = t.request AND a.size >= t.need AND a.path LIKE '%.tif' GROUP BY t.event_id")
def join26(s):
    """The first mosaic that fits: of the same key, and at least as large as is needed."""
    wanted = s.v_tile_check.select("event_id", (F.col("x") % 97).alias("request"), (F.col("y") * 10).alias("need"))
    mosaics = s.v_artifact.where("path LIKE '%.tif'").select("request", "artifact_id", "size")
    return C.first_that_fits(wanted, mosaics, "request", "need", "size", "artifact_id", 512).select("event_id", F.col("artifact_id").alias("mosaic"))


@R.add("join27_expected_pairs", "SELECT project, prev, release, CASE WHEN gap > 365 THEN 'long' ELSE 'normal' END AS kind FROM (SELECT project, release, lag(release) OVER w AS prev, date_diff('day', lag(release_date) OVER w, release_date) AS gap FROM v_milestone WINDOW w AS (PARTITION BY project ORDER BY release_date, release)) WHERE prev IS NOT NULL")
def join27(s):
    w = W.partitionBy("project").orderBy("release_date", "release")
    m = s.v_milestone.select("project", "release", F.lag("release").over(w).alias("prev"), F.date_diff("release_date", F.lag("release_date").over(w)).alias("gap"))
    return m.where("prev IS NOT NULL").select("project", "prev", "release", F.when(F.col("gap") > 365, "long").otherwise("normal").alias("kind"))


@R.add("join05_feature_tiles", "SELECT z, tx, ty, count(*) AS n, count(DISTINCT project) AS projects FROM (SELECT *, unnest(range(miny // size, maxy // size + 1)) AS ty FROM (SELECT *, unnest(range(minx // size, maxx // size + 1)) AS tx FROM v_feature, (VALUES (1, 512), (2, 256), (3, 128)) p(z, size))) WHERE ty * size < maxy AND (ty + 1) * size > miny AND (tx + 1) * size > minx AND tx * size < maxx - (maxx - minx) * 0.25 * (greatest(miny, ty * size) - miny) / (maxy - miny) GROUP BY z, tx, ty")
def join05(s):
    """Each feature under the tiles of every level that it shares a part of: candidates by its bounds, then the exact clip.
    Features of one project and box lie under the same tiles, and are clipped as one that counts for all."""
    shapes = s.v_feature.groupBy("project", *BOX).agg(F.count("*").alias("members"))
    return feature_tiles(shapes).groupBy("z", "tx", "ty").agg(F.sum("members").alias("n"), F.count_distinct("project").alias("projects"))


@R.add("flt06_polygon_filter", "SELECT feature_id FROM v_feature WHERE p > 0 AND (maxx - minx) * (maxy - miny) > 0 AND maxx > 500 AND minx < 3000")
def flt06(s):
    return s.v_feature.where("p > 0 AND (maxx - minx) * (maxy - miny) > 0").where("maxx > 500 AND minx < 3000").select("feature_id")


@R.add("flt07_clip", "SELECT feature_id, greatest(minx, 1000) AS minx, greatest(miny, 1000) AS miny, least(maxx, 2000) AS maxx, least(maxy, 2000) AS maxy FROM v_feature WHERE maxx > 1000 AND minx < 2000 AND maxy > 1000 AND miny < 2000")
def flt07(s):
    """Boxes that meet the window, a filter that reaches the scan's statistics, then the exact clip."""
    hit = s.v_feature.where("maxx > 1000 AND minx < 2000 AND maxy > 1000 AND miny < 2000")
    return hit.select("feature_id", *[F.greatest(c, F.lit(1000)).alias(c) for c in ("minx", "miny")], *[F.least(c, F.lit(2000)).alias(c) for c in ("maxx", "maxy")])


@R.add("flt08_exportable", "SELECT artifact_id FROM v_artifact WHERE (path LIKE '%.geojson' OR path LIKE '%.csv') AND path NOT LIKE '%tmp%' AND artifact_id IN (SELECT artifact_id FROM v_reference)")
def flt08(s):
    kept = s.v_artifact.where((F.col("path").endswith(".geojson") | F.col("path").endswith(".csv")) & ~F.col("path").contains("tmp"))
    return kept.join(s.v_reference, "artifact_id", "left_semi").select("artifact_id")


@R.add("flt09_allow_list", "SELECT artifact_id FROM v_artifact WHERE lang IN ('en', 'fr')")
def flt09(s):
    allowed = s.spark.sql("SELECT explode(array('en', 'fr')) AS lang")
    return s.v_artifact.join(F.broadcast(allowed), "lang", "left_semi").select("artifact_id")


@R.add("flt10_classification", "SELECT artifact_id, CASE WHEN path LIKE '%.tmp' THEN 'temporary' WHEN path LIKE '%preview%' THEN 'preview' WHEN path LIKE '%.geojson' THEN 'final' WHEN path LIKE '%.tif' THEN 'raster' ELSE 'table' END AS type, path LIKE '%.geojson' OR path LIKE '%.csv' AS include FROM v_artifact")
def flt10(s):
    """Ordered rules over file names; the first that holds decides."""
    p = F.col("path")
    kind = C.first_reason({"temporary": p.endswith(".tmp"), "preview": p.contains("preview"), "final": p.endswith(".geojson"), "raster": p.endswith(".tif"), "table": F.lit(True)})
    return s.v_artifact.select("artifact_id", kind.alias("type"), (p.endswith(".geojson") | p.endswith(".csv")).alias("include"))


@R.add("flt11_job_listing", "SELECT event_id, status FROM v_job WHERE status IN ('completed', 'progress') ORDER BY ts DESC, event_id LIMIT 100")
def flt11(s):
    """'completed' also stands for its older name."""
    return s.v_job.where(F.col("status").isin("completed", "progress")).orderBy(F.desc("ts"), "event_id").limit(100).select("event_id", "status")


@R.add("flt12_usable_coverage", "SELECT event_id, x % 5 > 0 OR status = 'available' OR value > 300 AS usable FROM v_tile_check")
def flt12(s):
    return s.v_tile_check.select("event_id", ((F.col("x") % 5 > 0) | (F.col("status") == "available") | (F.col("value") > 300)).alias("usable"))


@R.add("flt13_request_validation", "SELECT release, list_filter([CASE WHEN n_buffers / 3.0 > 1 THEN 'threshold' END, CASE WHEN release_date < DATE '1996-01-01' THEN 'too_early' END, CASE WHEN total > 400000 THEN 'area_budget' END], lambda x: x IS NOT NULL) AS errors, len(list_filter([CASE WHEN n_buffers / 3.0 > 1 THEN 'threshold' END, CASE WHEN release_date < DATE '1996-01-01' THEN 'too_early' END, CASE WHEN total > 400000 THEN 'area_budget' END], lambda x: x IS NOT NULL)) = 0 AS valid FROM v_milestone")
def flt13(s):
    errors = C.reasons({"threshold": F.col("n_buffers") / 3 > 1, "too_early": F.col("release_date") < F.lit("1996-01-01").cast("date"), "area_budget": F.col("total") > 400000})
    return s.v_milestone.select("release", errors.alias("errors")).withColumn("valid", F.size("errors") == 0)


@R.add("flt14_timeline_validation", "SELECT release, list_filter([CASE WHEN prev = release_date THEN 'duplicate' END, CASE WHEN r.run_id IS NULL THEN 'unknown_release' END, CASE WHEN prev IS NULL THEN 'baseline' END], lambda x: x IS NOT NULL) AS problems FROM (SELECT *, lag(release_date) OVER (PARTITION BY project ORDER BY release_date, release) AS prev FROM v_milestone) m LEFT JOIN (SELECT run_id FROM v_run WHERE kind = 'temporal') r ON r.run_id = m.release")
def flt14(s):
    known = s.v_run.where("kind = 'temporal'").select(F.col("run_id").alias("release"), F.lit(True).alias("known"))
    m = s.v_milestone.withColumn("prev", F.lag("release_date").over(W.partitionBy("project").orderBy("release_date", "release"))).join(known, "release", "left")
    return m.select("release", C.reasons({"duplicate": F.col("prev") == F.col("release_date"), "unknown_release": F.col("known").isNull(), "baseline": F.col("prev").isNull()}).alias("problems"))


@R.add("flt15_bounds_validity", "SELECT o_orderkey AS id, lon0 < lon1 AND lat0 < lat1 AND lon0 >= -180 AND lon1 <= 180 AND lat0 >= -90 AND lat1 <= 90 AS valid FROM (SELECT o_orderkey, o_orderkey % 400 - 200 AS lon0, o_orderkey % 390 - 190 AS lon1, o_orderkey % 190 - 95 AS lat0, o_orderkey % 190 - 94 AS lat1 FROM orders)")
def flt15(s):
    b = s.orders.selectExpr("o_orderkey AS id", "o_orderkey % 400 - 200 AS lon0", "o_orderkey % 390 - 190 AS lon1", "o_orderkey % 190 - 95 AS lat0", "o_orderkey % 190 - 94 AS lat1")
    finite = ~F.isnan(F.col("lon0").cast("double")) & ~F.isnan(F.col("lon1").cast("double"))
    return b.select("id", (finite & F.expr("lon0 < lon1 AND lat0 < lat1 AND lon0 >= -180 AND lon1 <= 180 AND lat0 >= -90 AND lat1 <= 90")).alias("valid"))


@R.add("flt16_layer_validation", "SELECT project, layer, CASE WHEN count(*) = 0 THEN 'empty' WHEN count(*) FILTER (WHERE p < 0.02) > 0 THEN 'null_geometry' WHEN max(maxx) > 4040 THEN 'bounds' END AS reason FROM v_feature GROUP BY project, layer")
def flt16(s):
    reason = F.when(F.count("*") == 0, "empty").when(F.count_if(F.col("p") < 0.02) > 0, "null_geometry").when(F.max("maxx") > 4040, "bounds")
    return s.v_feature.groupBy("project", "layer").agg(reason.alias("reason"))


@R.add("flt17_payload_violations", "SELECT feature_id FROM (SELECT feature_id, layer, (maxx - minx) * (maxy - miny) AS a, CASE WHEN feature_id % 13 = 0 THEN 0 ELSE round((maxx - minx) * (maxy - miny) / 10000.0, 4) END AS ha FROM v_feature) WHERE NOT (layer IN ('additions', 'effective') AND abs(ha - round(a / 10000.0, 4)) <= 0.0001)")
def flt17(s):
    a = F.expr("(maxx - minx) * (maxy - miny)")
    f = s.v_feature.withColumns({"a": a, "ha": F.when(F.col("feature_id") % 13 == 0, 0.0).otherwise(F.round(a / 10000, 4))})
    return f.where(~(F.col("layer").isin("additions", "effective") & (F.abs(F.col("ha") - F.round(F.col("a") / 10000, 4)) <= 0.0001))).select("feature_id")


@R.add("flt18_mosaic_match", "SELECT t.event_id, CASE WHEN a.artifact_id IS NULL THEN 'release' WHEN a.size % 3 <> t.z % 3 THEN 'zoom' WHEN a.age_h > 300 THEN 'bounds' ELSE 'match' END AS reason FROM v_tile_check t LEFT JOIN v_artifact a ON a.artifact_id = t.x")
def flt18(s):
    j = s.v_tile_check.join(s.v_artifact.select(F.col("artifact_id").alias("x"), "size", "age_h"), "x", "left")
    reason = C.first_reason({"release": F.col("size").isNull(), "zoom": F.col("size") % 3 != F.col("z") % 3, "bounds": F.col("age_h") > 300, "match": F.lit(True)})
    return j.select("event_id", reason.alias("reason"))


@R.add("flt19_cache_reuse", "SELECT a.release, a.tiles = b.tiles AS reusable FROM (SELECT release, list_sort(list(DISTINCT z * 1024 + x % 3)) AS tiles FROM v_tile_check WHERE value > 5 GROUP BY release) a JOIN (SELECT release, list_sort(list(DISTINCT z * 1024 + x % 3)) AS tiles FROM v_tile_check WHERE status = 'available' GROUP BY release) b USING (release)")
def flt19(s):
    """Reusable if both have exactly the same tiles."""
    key = F.col("z") * 1024 + F.col("x") % 3
    a, b = (s.v_tile_check.where(c).groupBy("release").agg(F.array_sort(F.collect_set(key)).alias(n)) for c, n in (("value > 5", "a"), ("status = 'available'", "b")))
    return a.join(b, "release").select("release", F.col("a").eqNullSafe(F.col("b")).alias("reusable"))


@R.add("flt20_ttl", "SELECT artifact_id, age_h <= 168 AND path NOT LIKE '%.tmp' AS fresh FROM v_artifact")
def flt20(s):
    """Valid by kind and age; now is a parameter, here hour 0 of the ages."""
    return s.v_artifact.select("artifact_id", ((F.col("age_h") <= 168) & ~F.col("path").endswith(".tmp")).alias("fresh"))


@R.add("flt21_payload_checksum", "SELECT doc_id, sha256(coalesce(text, '')) = CASE WHEN doc_id % 17 = 0 THEN 'x' ELSE a.sha END AS intact FROM documents JOIN v_artifact a ON a.artifact_id = doc_id WHERE doc_id % 3 <> 0")
def flt21(s):
    """Payloads that are references (by their storage field) are resolved and checked against the checksum that they name; other
    payloads are no references. Here every third document's payload is inline."""
    sha = F.when(F.col("artifact_id") % 17 == 0, "x").otherwise(F.col("sha"))
    payload = F.when(F.col("artifact_id") % 3 == 0, F.to_json(F.struct(F.lit(1).alias("n")))).otherwise(F.to_json(F.struct(F.lit("external").alias("storage"), F.col("artifact_id").alias("key"), sha.alias("sha256"))))
    held = s.v_artifact.select(payload.alias("payload"))
    refs = C.payload_references(held, "payload")
    side = s.documents.select(F.col("doc_id").alias("key"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("own"))
    return refs.join(side, "key").select(F.col("key").alias("doc_id"), (F.col("own") == F.col("sha256")).alias("intact"))


@R.add("flt22_client_events", "SELECT event_id, CASE WHEN length(payload) > 8 THEN substr(payload, 1, 8) ELSE payload END AS payload FROM v_client_event WHERE event LIKE 'view%' OR event LIKE 'click%'")
def flt22(s):
    e = s.v_client_event.where(F.col("event").startswith("view") | F.col("event").startswith("click"))
    return e.select("event_id", F.when(F.length("payload") > 8, F.substring("payload", 1, 8)).otherwise(F.col("payload")).alias("payload"))


@R.add("flt23_canonical_validation", "SELECT artifact_id, CASE WHEN path NOT LIKE '%.tif' THEN 'missing' WHEN size < 500 THEN 'empty' WHEN request % 4 = 0 THEN 'key_mismatch' WHEN size % 7 = 0 THEN 'bands' WHEN size % 11 = 0 THEN 'dtype' END AS reason FROM v_artifact")
def flt23(s):
    reason = C.first_reason({"missing": ~F.col("path").endswith(".tif"), "empty": F.col("size") < 500, "key_mismatch": F.col("request") % 4 == 0, "bands": F.col("size") % 7 == 0, "dtype": F.col("size") % 11 == 0})
    return s.v_artifact.select("artifact_id", reason.alias("reason"))


@R.add("flt24_stale_results", "SELECT request, bool_or(path LIKE '%.png' AND artifact_id IN (SELECT artifact_id FROM v_reference)) AS stale FROM v_artifact GROUP BY request")
def flt24(s):
    there = s.v_reference.select("artifact_id").distinct().withColumn("there", F.lit(True))
    j = s.v_artifact.join(there, "artifact_id", "left")
    return j.groupBy("request").agg(F.bool_or(F.col("path").endswith(".png") & F.coalesce("there", F.lit(False))).alias("stale"))


@R.add("flt25_finalisation", "SELECT project, CASE WHEN ok = 0 THEN 'no_complete_milestone' WHEN files = 0 THEN 'no_artifact' END AS error FROM (SELECT project, count(*) FILTER (WHERE status = 'complete' AND total > 100000) AS ok, count(*) FILTER (WHERE status = 'complete' AND total > 100000 AND n_buffers > 0) AS files FROM v_milestone GROUP BY project)")
def flt25(s):
    good = (F.col("status") == "complete") & (F.col("total") > 100000)
    found = s.v_milestone.groupBy("project").agg(F.count_if(good).alias("ok"), F.count_if(good & (F.col("n_buffers") > 0)).alias("files"))
    return found.select("project", F.when(F.col("ok") == 0, "no_complete_milestone").when(F.col("files") == 0, "no_artifact").alias("error"))


_REFS = "(SELECT target AS request, count(*) FILTER (WHERE reason <> 'pair_hash') AS strong, count(*) AS n FROM v_reference GROUP BY target)"
_CLASS = f"SELECT a.request, list_filter([CASE WHEN strong > 3 THEN 'referenced' END, CASE WHEN youngest < 24 THEN 'recent' END, CASE WHEN n_tmp > 3 THEN 'active' END], lambda x: x IS NOT NULL) AS reasons FROM (SELECT request, min(age_h) AS youngest, count(*) FILTER (WHERE path LIKE '%.tmp') AS n_tmp FROM v_artifact GROUP BY request) a LEFT JOIN {_REFS} USING (request)"


def classified(s):
    refs = s.v_reference.groupBy(F.col("target").alias("request")).agg(F.count_if(F.col("reason") != "pair_hash").alias("strong"))
    a = s.v_artifact.groupBy("request").agg(F.min("age_h").alias("youngest"), F.count_if(F.col("path").endswith(".tmp")).alias("n_tmp"))
    why = C.reasons({"referenced": F.col("strong") > 3, "recent": F.col("youngest") < 24, "active": F.col("n_tmp") > 3})
    return a.join(refs, "request", "left").select("request", why.alias("reasons"))


@R.add("ret01_request_classes", f"SELECT request, reasons, len(reasons) = 0 AS orphan FROM ({_CLASS})")
def ret01(s):
    """References by pair hash alone don't protect."""
    return classified(s).withColumn("orphan", F.size("reasons") == 0)


@R.add("ret02_cleanup_candidates", f"SELECT artifact_id FROM v_artifact WHERE request IN (SELECT request FROM ({_CLASS}) WHERE len(reasons) = 0) AND age_h >= 24 AND (path LIKE '%.tmp' OR path LIKE '%.png')")
def ret02(s):
    orphans = classified(s).where(F.size("reasons") == 0)
    old = s.v_artifact.where("age_h >= 24").where(F.col("path").endswith(".tmp") | F.col("path").endswith(".png"))
    return old.join(orphans, "request", "left_semi").select("artifact_id")


@R.add("ret03_stale_files", "SELECT artifact_id FROM v_artifact WHERE age_h >= 72 AND source IN ('src1', 'src2', 'src3')")
def ret03(s):
    return s.v_artifact.where("age_h >= 72").where(F.col("source").isin("src1", "src2", "src3")).select("artifact_id")


@R.add("ret04_deletion_safety", "SELECT request, list_sort(list(DISTINCT reason)) AS dependencies, bool_or(reason = 'artifact_path') AS blocked, CASE WHEN bool_or(reason = 'artifact_path') THEN 'keep' WHEN count(*) > 5 THEN 'review' ELSE 'delete' END AS policy FROM v_artifact a JOIN v_reference r USING (artifact_id) GROUP BY request")
def ret04(s):
    j = s.v_artifact.join(s.v_reference, "artifact_id")
    hard = F.bool_or(F.col("reason") == "artifact_path")
    return j.groupBy("request").agg(F.array_sort(F.collect_set("reason")).alias("dependencies"), hard.alias("blocked"), F.when(hard, "keep").when(F.count("*") > 5, "review").otherwise("delete").alias("policy"))


@R.add("ret05_request_status", "SELECT request, CASE WHEN n_result = 0 AND n_manifest = 0 THEN 'empty' WHEN n_result = 0 THEN 'incomplete' WHEN n_manifest = 0 THEN 'unlisted' ELSE 'complete' END AS status FROM (SELECT request, count(*) FILTER (WHERE path LIKE '%.geojson' AND size > 2500) AS n_result, count(*) FILTER (WHERE path LIKE '%.csv' AND size > 2500) AS n_manifest FROM v_artifact GROUP BY request)")
def ret05(s):
    has = lambda end: F.count_if(F.col("path").endswith(end) & (F.col("size") > 2500))
    n = s.v_artifact.groupBy("request").agg(has(".geojson").alias("r"), has(".csv").alias("m"))
    return n.select("request", F.when((F.col("r") == 0) & (F.col("m") == 0), "empty").when(F.col("r") == 0, "incomplete").when(F.col("m") == 0, "unlisted").otherwise("complete").alias("status"))


@R.add("ret06_promoted", "SELECT request, count(*) FILTER (WHERE path NOT LIKE 'src1%') > 0 AS promoted FROM v_artifact WHERE path NOT LIKE '%.tmp' GROUP BY request")
def ret06(s):
    return s.v_artifact.where(~F.col("path").endswith(".tmp")).groupBy("request").agg((F.count_if(~F.col("path").startswith("src1")) > 0).alias("promoted"))


@R.add("ret07_mosaic_compaction", "SELECT a.artifact_id, list_filter([CASE WHEN age_h < 48 THEN 'ttl' END, CASE WHEN size < 400 THEN 'missing_fields' END, CASE WHEN n IS NOT NULL THEN 'referenced' END, CASE WHEN c = 1 THEN 'canonical' END, CASE WHEN c > 1 THEN 'ambiguous' END], lambda x: x IS NOT NULL) AS reasons FROM v_artifact a LEFT JOIN (SELECT target AS k, count(*) AS n FROM v_reference WHERE reason = 'metadata' GROUP BY 1) ON k = artifact_id % 100 LEFT JOIN (SELECT source, lang, count(*) AS c FROM v_artifact WHERE path LIKE '%.csv' AND size > 2000 GROUP BY ALL) m ON m.source = a.source AND m.lang = a.lang WHERE path LIKE '%.tif'")
def ret07(s):
    """Why a mosaic stays: young, incomplete, referenced, or linked to canonical imagery, be it once or ambiguously."""
    links = s.v_reference.where("reason = 'metadata'").groupBy(F.col("target").alias("k")).agg(F.count("*").alias("n"))
    canonical = s.v_artifact.where("path LIKE '%.csv' AND size > 2000").select("source", "lang", "sha")
    linked = C.ambiguous_match(s.v_artifact.where("path LIKE '%.tif'"), canonical, ["source", "lang"], "sha")
    j = linked.withColumn("k", F.col("artifact_id") % 100).join(links, "k", "left")
    return j.select("artifact_id", C.reasons({"ttl": F.col("age_h") < 48, "missing_fields": F.col("size") < 400, "referenced": F.col("n").isNotNull(), "canonical": F.col("match") == "one", "ambiguous": F.col("match") == "many"}).alias("reasons"))


@R.add("ret08_active_reference", "SELECT k, count(*) AS uses FROM (SELECT n_name AS k FROM nation) n JOIN (SELECT '{\"used\": [\"NATION_' || CAST(user_id % 40 AS VARCHAR) || '\", 7]}' AS body FROM events) e ON contains(body, '\"' || k || '\"') GROUP BY k")
def ret08(s):
    """Texts that name a cache key: what could be a key is taken out of each text once, and met by equality."""
    bodies = s.events.select("event_id", F.concat(F.lit('{"used": ["NATION_'), (F.col("user_id") % 40).cast("string"), F.lit('", 7]}')).alias("body"))
    named = bodies.select("event_id", F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit('"([A-Za-z0-9_-]+)"'), F.lit(1)))).alias("k"))
    return named.join(s.nation.select(F.col("n_name").alias("k")), "k").groupBy("k").agg(F.count("*").alias("uses"))


@R.add("ret09_fingerprints", "SELECT artifact_id, CASE WHEN o.s IS NULL THEN 'added' WHEN n.s IS NULL THEN 'removed' WHEN o.s = n.s AND o.h = n.h THEN 'same' ELSE 'changed' END AS state FROM (SELECT artifact_id, size AS s, sha AS h FROM v_artifact WHERE artifact_id % 7 <> 0) o FULL JOIN (SELECT artifact_id, CASE WHEN artifact_id % 5 = 0 THEN size + 1 ELSE size END AS s, sha AS h FROM v_artifact WHERE artifact_id % 11 <> 0) n USING (artifact_id)")
def ret09(s):
    old = s.v_artifact.where("artifact_id % 7 <> 0").select("artifact_id", "size", "sha")
    new = s.v_artifact.where("artifact_id % 11 <> 0").select("artifact_id", F.when(F.col("artifact_id") % 5 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("size"), "sha")
    return C.changed(old, new, "artifact_id", ["size", "sha"])


@R.add("ret10_empty_baseline", "SELECT release FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY release_date, release) AS k FROM v_milestone) WHERE NOT (k = 1 AND n_buffers = 0)")
def ret10(s):
    k = F.row_number().over(W.partitionBy("project").orderBy("release_date", "release"))
    return s.v_milestone.withColumn("k", k).where("NOT (k = 1 AND n_buffers = 0)").select("release")


@R.add("ret11_metadata_bloat", "SELECT request, sum(size)::BIGINT AS bytes, sum(size) > 30000 AS bloated FROM v_artifact GROUP BY request")
def ret11(s):
    return s.v_artifact.groupBy("request").agg(F.sum("size").alias("bytes"), (F.sum("size") > 30000).alias("bloated"))


@R.add("ret12_pair_validation", "SELECT project, bool_and(total > 0 AND status <> 'error') AND count(DISTINCT mode) = 1 AS passed, count(*) AS pairs FROM v_milestone GROUP BY project")
def ret12(s):
    return s.v_milestone.groupBy("project").agg((F.bool_and((F.col("total") > 0) & (F.col("status") != "error")) & (F.count_distinct("mode") == 1)).alias("passed"), F.count("*").alias("pairs"))


@R.add("ret13_metrics_repair", "SELECT m.release, coalesce(f.n, m.n_buffers) AS n, f.n IS NOT NULL AND f.n IS DISTINCT FROM m.n_buffers AS changed FROM v_milestone m LEFT JOIN (SELECT artifact_id AS release, size % 5 AS n FROM v_artifact WHERE path LIKE '%.csv') f USING (release)")
def ret13(s):
    """Refreshed values replace stored ones; without a source the old value stays."""
    fresh = s.v_artifact.where("path LIKE '%.csv'").select(F.col("artifact_id").alias("release"), (F.col("size") % 5).alias("fresh"))
    j = s.v_milestone.join(fresh, "release", "left")
    return j.select("release", F.coalesce("fresh", "n_buffers").alias("n"), (F.col("fresh").isNotNull() & ~F.col("fresh").eqNullSafe(F.col("n_buffers"))).alias("changed"))


@R.add("ret14_acceptance", "SELECT criterion, passed FROM (SELECT avg(ms) < 60 AS mean_ok, max(ms) < 400 AS max_ok, count(*) > 100 AS count_ok FROM v_timing) UNPIVOT (passed FOR criterion IN (mean_ok, max_ok, count_ok)) UNION ALL SELECT 'all', avg(ms) < 60 AND max(ms) < 400 AND count(*) > 100 FROM v_timing")
def ret14(s):
    wide = s.v_timing.agg((F.avg("ms") < 60).alias("mean_ok"), (F.max("ms") < 400).alias("max_ok"), (F.count("*") > 100).alias("count_ok"))
    long = wide.selectExpr("stack(3, 'mean_ok', mean_ok, 'max_ok', max_ok, 'count_ok', count_ok) AS (criterion, passed)")
    return long.unionByName(long.agg(F.lit("all").alias("criterion"), F.bool_and("passed").alias("passed")))


@R.add("ret15_override_import", "WITH c AS (SELECT feature_id, project, release, greatest(minx, 100) AS minx, least(maxx, 3900) AS maxx, miny, maxy FROM v_feature WHERE (layer = 'blocks' AND project % 5 = 0 OR layer = 'additions' AND project % 5 <> 0) AND maxx > 100 AND minx < 3900), cells AS (SELECT *, unnest(range(minx // 10, maxx // 10)) AS cx FROM c), cell AS (SELECT *, unnest(range(miny // 10, maxy // 10)) AS cy FROM cells), seen AS (SELECT project, cx, cy, min(release) AS release FROM cell GROUP BY ALL), added AS (SELECT project, release, count(*) * 100 AS added_area FROM seen GROUP BY ALL) SELECT project, release, coalesce(added_area, 0)::BIGINT AS added_area, (sum(coalesce(added_area, 0)) OVER (PARTITION BY project ORDER BY release))::BIGINT AS total_area FROM (SELECT DISTINCT project, release FROM v_feature) LEFT JOIN added USING (project, release)")
def ret15(s):
    """Projects with an override take its rows, clipped to the area, in place of their candidates, and all is worked out anew
    from the first milestone; an override of which nothing lies inside is an error."""
    from landfold.operators import cells as L

    f = s.v_feature
    chosen = C.override_layer(f.where("layer = 'additions'"), f.where("layer = 'blocks' AND project % 5 = 0"), "project", (100, -(1 << 40), 3900, 1 << 40))
    return L.growth(L.cells_of_boxes(chosen, ["project", "release"], 10), f, ["project"], "release", 10)


@R.add("ret16_missing_buffers", "WITH m AS (SELECT project, release, lag(release) OVER (PARTITION BY project ORDER BY release) AS t1 FROM (SELECT DISTINCT project, release FROM v_feature)), has AS (SELECT project, release, CASE WHEN count(*) % 3 >= 1 THEN 10 END AS a, CASE WHEN count(*) % 3 = 2 THEN 15 END AS b FROM v_feature GROUP BY ALL), want AS (SELECT m.*, d FROM m JOIN has USING (project, release), (VALUES (10), (15), (20)) x(d) WHERE d IS DISTINCT FROM a AND d IS DISTINCT FROM b), cells AS (SELECT *, unnest(range(minx // 10, maxx // 10)) AS cx FROM v_feature), cell AS (SELECT *, unnest(range(miny // 10, maxy // 10)) AS cy FROM cells), grown AS (SELECT DISTINCT want.project, want.release, d, cx + dx AS cx, cy + dy AS cy FROM want JOIN cell USING (project, release), range(-2, 3) a(dx), range(-2, 3) b(dy) WHERE layer = 'additions' AND 100 * (dx * dx + dy * dy) <= d * d) SELECT want.project, want.release, d AS buffer_m, t1, coalesce(area, 0) AS area FROM want LEFT JOIN (SELECT project, release, d, count(*) * 100 AS area FROM grown GROUP BY ALL) USING (project, release, d)")
def ret16(s):
    """Milestones that lack a buffer layer get it from their additions, with the milestone before as what they are compared
    with. Which layers are there follows from the number of features here."""
    from landfold.operators import cells as L

    keys = ["project", "release"]
    m = s.v_feature.groupBy(*keys).agg((F.count("*") % 3).alias("n")).withColumn("t1", F.lag("release").over(W.partitionBy("project").orderBy("release")))
    there = m.where("n >= 1").select(*keys, F.lit(10).alias("buffer_m")).unionByName(m.where("n = 2").select(*keys, F.lit(15).alias("buffer_m")))
    wanted = m.select(*keys, "t1", F.explode(F.array(F.lit(10), F.lit(15), F.lit(20))).alias("buffer_m")).join(there, [*keys, "buffer_m"], "left_anti")
    added = L.cells_of_boxes(s.v_feature.where("layer = 'additions'"), keys, 10)
    area = None
    for d in (10, 15, 20):
        own = L.area(L.dilate(added.join(wanted.where(F.col("buffer_m") == d).select(*keys), keys, "left_semi"), keys, d / 10), keys, 10).withColumn("buffer_m", F.lit(d))
        area = own if area is None else area.unionByName(own)
    return wanted.join(area, [*keys, "buffer_m"], "left").select(*keys, "buffer_m", "t1", F.coalesce("area", F.lit(0)).alias("area"))


@R.add("snk10_run_upsert", "SELECT run_id, arg_max(cost, v) AS cost FROM (SELECT run_id, cost, 0 AS v FROM v_run WHERE run_id % 3 <> 0 UNION ALL SELECT run_id, cost + 1, 1 FROM v_run WHERE run_id % 2 = 0) GROUP BY run_id")
def snk10(s):
    old = s.v_run.where("run_id % 3 <> 0").select("run_id", "cost", F.lit(0).alias("v"))
    new = s.v_run.where("run_id % 2 = 0").select("run_id", (F.col("cost") + 1).alias("cost"), F.lit(1).alias("v"))
    return C.upsert(old, new, ["run_id"], "v").select("run_id", "cost")


@R.add("snk10_artifact_replace", "SELECT artifact_id, request FROM v_artifact WHERE request NOT IN (SELECT request FROM v_artifact WHERE request < 20 AND path LIKE '%.tif') OR path LIKE '%.tif' AND request < 20")
def snk10_children(s):
    """A run's artifacts are deleted and inserted together."""
    new = s.v_artifact.where("request < 20 AND path LIKE '%.tif'").select("artifact_id", "request")
    return C.replace_children(s.v_artifact.select("artifact_id", "request"), new, "request")


@R.add("snk11_tile_upsert", "SELECT release, z, x, y, arg_max(status, (ts, event_id)) AS status FROM v_tile_check GROUP BY release, z, x, y")
def snk11(s):
    t = s.v_tile_check.select("release", "z", "x", "y", "status", F.struct("ts", "event_id").alias("version"))
    first, second = t.where(F.col("version.event_id") % 2 == 0), t.where(F.col("version.event_id") % 2 == 1)
    return C.upsert(first, second, ["release", "z", "x", "y"], "version").drop("version")


@R.add("snk09_layer_upsert", "SELECT project, layer, feature_count, area, CASE WHEN feature_count <= 120 THEN ids END AS stored FROM (SELECT project, layer, count(*) AS feature_count, sum((maxx - minx) * (maxy - miny))::BIGINT AS area, list(feature_id ORDER BY feature_id) AS ids FROM v_feature GROUP BY project, layer)")
def snk09(s):
    """Geometry is stored only for layers up to a number of features; layers beyond it are counted and never gathered."""
    f = s.v_feature
    found = f.groupBy("project", "layer").agg(F.count("*").alias("feature_count"), F.sum(F.expr("(maxx - minx) * (maxy - miny)")).alias("area"))
    small = f.join(found.where("feature_count <= 120").select("project", "layer"), ["project", "layer"], "left_semi")
    stored = small.groupBy("project", "layer").agg(F.array_sort(F.collect_list("feature_id")).alias("stored"))
    return found.join(stored, ["project", "layer"], "left").select("project", "layer", "feature_count", "area", "stored")


@R.add("snk12_payload_split", "SELECT conv_id, bytes, CASE WHEN bytes > 1500 THEN 'external' ELSE 'inline' END AS storage, CASE WHEN bytes > 1500 THEN sha END AS sha256, CASE WHEN bytes > 1500 THEN bytes END AS side_bytes, body FROM (SELECT conv_id, strlen(body) AS bytes, sha256(body) AS sha, body FROM (SELECT conv_id, string_agg(coalesce(role, '') || ':' || coalesce(text, ''), chr(10) ORDER BY turn) AS body FROM conversations GROUP BY conv_id))")
def snk12(s):
    """Large payloads go to a side table under their checksum, with their size and a schema tag; a reference stays. Read back
    from both tables."""
    line = F.struct("turn", F.concat_ws(":", F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))).alias("t"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x.t), "\n")
    main, side = C.split_payloads(s.conversations.groupBy("conv_id").agg(body.alias("body")), "body", 1500, "conversation/1")
    held = side.withColumnRenamed("bytes", "side_bytes").drop("schema_tag")
    both = main.join(held.withColumnRenamed("payload", "_side"), "sha256", "left")
    return both.select("conv_id", "bytes", "storage", "sha256", "side_bytes", F.coalesce("_side", "payload").alias("body"))


@R.add("st06_instability", "SELECT release, w, errors, errors >= 3 AS unstable, greatest(1, 6 - (sum(CASE WHEN errors >= 3 THEN 1 ELSE 0 END) OVER (PARTITION BY release ORDER BY w)))::BIGINT AS level FROM (SELECT release, CAST(floor((k - 1) / 10) AS BIGINT) AS w, count(*) FILTER (WHERE status = 'failed') AS errors FROM (SELECT *, row_number() OVER (PARTITION BY release ORDER BY ts, event_id) AS k FROM v_tile_check) GROUP BY ALL)")
def st06(s):
    return C.instability(s.v_tile_check, "release", ["ts", "event_id"], 10, 3, 6, 1).select("release", "w", "errors", "unstable", "level")


@R.add("st07_throttle_signal", "SELECT release, w, round(slow / n, 6) AS ratio, slow / n > 0.02 AS lower FROM (SELECT release, CAST(floor((k - 1) / 25) AS BIGINT) AS w, count(*) AS n, count(*) FILTER (WHERE value > 150) AS slow FROM (SELECT *, row_number() OVER (PARTITION BY release ORDER BY ts, event_id) AS k FROM v_tile_check) GROUP BY ALL)")
def st07(s):
    w = F.floor((F.row_number().over(W.partitionBy("release").orderBy("ts", "event_id")) - 1) / 25)
    ratio = F.count_if(F.col("value") > 150) / F.count("*")
    return s.v_tile_check.withColumn("w", w).groupBy("release", "w").agg(F.round(ratio, 6).alias("ratio"), (ratio > 0.02).alias("lower"))


@R.add("st05_job_fold", "SELECT job_id, arg_max(status, (ts, event_id)) AS status, min(ts) FILTER (WHERE status = 'running') AS started_at, min(ts) FILTER (WHERE status IN ('completed', 'failed')) AS completed_at, greatest(0, least(100, max(progress))) AS progress FROM v_job GROUP BY job_id")
def st05(s):
    return C.job_states(s.v_job)


@R.add("st11_stale_entries", "SELECT event_id FROM v_job WHERE ts <= (SELECT max(ts) FROM v_job) - INTERVAL 10 DAY AND status = 'running'")
def st11(s):
    now = F.broadcast(s.v_job.agg(F.max("ts").alias("now")))
    return s.v_job.where("status = 'running'").join(now, F.col("ts") <= F.col("now") - F.expr("INTERVAL 10 DAY")).select("event_id")
