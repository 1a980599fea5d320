"""Queries of scalar functions, sources and sinks' rows."""

from __future__ import annotations

import math

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from landfold.functions import values as V
from landfold.functions.geometry import PLANE_LAT, PLANE_LON, PLANE_SCALE, RING, signed_area
from landfold.operators import cells as C
from landfold.operators import exports as X
from landfold.operators import metrics as M
from landfold.operators.graph import numbered
from landfold.plans.base import Registry
from landfold.plans.geometry import feature_tiles
from landfold.plans.growth import CELLS
from landfold.sources import files
from landfold.sources.staging import staged_path

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.oracle


@R.add("fn44_source_date", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderdate AS DATE) WHEN o_orderkey % 3 = 1 THEN CAST(o_orderdate AS DATE) END AS day FROM orders")
def fn44(s):
    day = F.col("o_orderdate").cast("timestamp")
    v = F.when(F.col("o_orderkey") % 3 == 0, F.date_format(day, "yyyyMMdd").cast("bigint")).when(F.col("o_orderkey") % 3 == 1, F.unix_millis(day)).otherwise(F.lit(99999999).cast("bigint"))
    return s.orders.select(F.col("o_orderkey").alias("id"), V.source_date(v).alias("day"))


@R.add("fn45_first_date", "SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN CAST(o_orderdate AS DATE) WHEN 1 THEN make_date(2000 + o_orderkey % 90, 1, 1) END AS day FROM orders")
def fn45(s):
    k = F.col("o_orderkey")
    text = F.when(k % 3 == 0, F.concat(F.lit("World ("), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(") v2"))).when(k % 3 == 1, F.concat(F.lit("WB_"), (2000 + k % 90).cast("string"), F.lit("_R01"))).otherwise(F.lit("none"))
    return s.orders.select(k.alias("id"), V.first_date(text).alias("day"))


@R.add("fn46_archive_date", "SELECT release, coalesce(CASE WHEN n_buffers > 2 THEN release_date END, CASE WHEN status = 'complete' THEN release_date + INTERVAL 1 DAY END, make_date(year(release_date), 1, 1))::DATE AS day, CASE WHEN n_buffers > 2 THEN 'source' WHEN status = 'complete' THEN 'release' ELSE 'year' END AS note FROM v_milestone")
def fn46(s):
    """The best date at hand, and where it is from."""
    src, rel = F.col("n_buffers") > 2, F.col("status") == "complete"
    day = F.coalesce(F.when(src, F.col("release_date")), F.when(rel, F.date_add("release_date", 1)), F.make_date(F.year("release_date"), F.lit(1), F.lit(1)))
    return s.v_milestone.select("release", day.alias("day"), F.when(src, "source").when(rel, "release").otherwise("year").alias("note"))


@R.add("fn47_quarter_label", "SELECT release, CAST(year(release_date) AS VARCHAR) || ' Q' || CAST(quarter(release_date) AS VARCHAR) AS label FROM v_milestone")
def fn47(s):
    return s.v_milestone.select("release", V.quarter_label("release_date").alias("label"))


#: Month names of the labels.
MONTHS = {1: "janvier", 2: "février", 3: "mars", 4: "avril", 5: "mai", 6: "juin", 7: "juillet", 8: "août", 9: "septembre", 10: "octobre", 11: "novembre", 12: "décembre"}


@R.add("fn48_month_label", "SELECT release, CASE month(release_date) " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in MONTHS.items()) + " END || ' ' || CAST(year(release_date) AS VARCHAR) AS label FROM v_milestone")
def fn48(s):
    return s.v_milestone.select("release", V.month_label("release_date", MONTHS).alias("label"))


@R.add("fn49_timestamps", "SELECT event_id, CASE WHEN event_id % 10 = 0 THEN NULL ELSE date_trunc('second', ts) END AS at FROM events")
def fn49(s):
    text = F.when(F.col("event_id") % 10 == 0, "yesterday").when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    return s.events.select("event_id", V.timestamp(text).cast("timestamp_ntz").alias("at"))


@R.add("fn50_safe_label", r"SELECT artifact_id, 'A_e_' || regexp_replace(path, '[^A-Za-z0-9]+', '_', 'g') AS label FROM v_artifact")
def fn50(s):
    return s.v_artifact.select("artifact_id", V.safe_label(F.concat(F.lit("  A é-"), "path", F.lit("!")), "layer").alias("label"))


@R.add("fn51_service_name", "SELECT DISTINCT release, 'metadata_' || substr(release, 4, 4) || '_r' || substr(release, 10, 2) AS service FROM v_feature")
def fn51(s):
    return s.v_feature.select("release").distinct().select("release", V.service_name("release").alias("service"))


@R.add("fn52_tile_url", "SELECT event_id, 'https://tiles.example.org/' || release || '/' || z || '/' || y || '/' || x AS url FROM v_tile_check")
def fn52(s):
    url = V.fill_template("https://tiles.example.org/{release}/{z}/{y}/{x}", {k: k for k in ("release", "z", "y", "x")})
    return s.v_tile_check.select("event_id", url.alias("url"))


@R.add("fn53_safe_ratio", "SELECT release, round(greatest(0, least(1, CASE WHEN n_buffers > 0 THEN total / 300000 / n_buffers END)), 9) AS ratio FROM v_milestone WHERE n_buffers > 0 UNION ALL SELECT release, NULL FROM v_milestone WHERE n_buffers <= 0")
def fn53(s):
    r = F.when(F.col("n_buffers") > 0, F.col("total") / 300000 / F.col("n_buffers"))
    return s.v_milestone.select("release", F.round(F.when(r.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), r))), 9).alias("ratio"))


@R.add("fn54_lenient_float", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN value WHEN 1 THEN value END AS v FROM events")
def fn54(s):
    k = F.col("event_id") % 4
    text = F.when(k == 0, F.col("value").cast("string")).when(k == 1, F.concat(F.lit(" "), F.col("value").cast("string"))).when(k == 2, "true").otherwise("n/a")
    return s.events.select("event_id", V.lenient_double(text, F.when(k == 2, "boolean").otherwise("string")).alias("v"))


@R.add("fn56_human_bytes", "SELECT artifact_id, CASE WHEN size < 1024 THEN size || ' B' WHEN size < 1048576 THEN printf('%.1f KB', size / 1024) ELSE printf('%.1f MB', size / 1048576) END AS label FROM v_artifact")
def fn56(s):
    return s.v_artifact.select("artifact_id", V.human_bytes("size").alias("label"))


@R.add("fn57_status_alias", "SELECT event_id, CASE WHEN status = 'progress' THEN 'completed' ELSE status END AS status FROM v_job")
def fn57(s):
    return s.v_job.select("event_id", F.when(F.col("status") == "progress", "completed").otherwise(F.col("status")).alias("status"))


@R.add("fn58_artifact_kind", "SELECT artifact_id, CASE WHEN path LIKE '%.tif' THEN 'raster' WHEN path LIKE '%.geojson' THEN 'vector' WHEN path LIKE '%.csv' THEN 'table' WHEN path LIKE '%.png' THEN 'image' ELSE 'file' END AS kind FROM v_artifact")
def fn58(s):
    end = lambda e: F.col("path").endswith(e)
    return s.v_artifact.select("artifact_id", F.when(end(".tif"), "raster").when(end(".geojson"), "vector").when(end(".csv"), "table").when(end(".png"), "image").otherwise("file").alias("kind"))


@R.add("fn59_payload_digest", "SELECT page_id, strlen(html) AS bytes, sha256(html) AS sha FROM pages")
def fn59(s):
    return s.pages.select("page_id", F.octet_length("html").cast("bigint").alias("bytes"), F.sha2("html", 256).alias("sha"))


@R.add("fn60_hash_from_path", r"SELECT page_id, regexp_extract(url, '//([^/]+)/', 1) AS host, CASE WHEN url LIKE '%page=%' THEN 'paged' WHEN url LIKE '%ref=%' THEN 'referred' ELSE 'plain' END AS reason FROM pages")
def fn60(s):
    u = F.col("url")
    return s.pages.select("page_id", F.regexp_extract(u, "//([^/]+)/", 1).alias("host"), F.when(u.contains("page="), "paged").when(u.contains("ref="), "referred").otherwise("plain").alias("reason"))


@R.add("fn61_range_normaliser", "SELECT event_id, coalesce(CASE WHEN event_id % 2 = 0 THEN k END, CASE WHEN event_id % 3 = 0 THEN k + 1 END) AS x_min FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)")
def fn61(s):
    """Several spellings of one key."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    doc = F.when(F.col("event_id") % 2 == 0, F.to_json(F.struct(k.alias("x_min")))).when(F.col("event_id") % 3 == 0, F.to_json(F.struct((k + 1).alias("xMin")))).otherwise("{}")
    e = s.events.withColumn("doc", doc)
    return e.select("event_id", F.coalesce(F.get_json_object("doc", "$.x_min"), F.get_json_object("doc", "$.xMin")).cast("bigint").alias("x_min"))


@R.add("fn62_flatten_timings", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events")
def fn62(s):
    return s.events.select("event_id", F.from_json("props", "k double").k.alias("k"))


@R.add("fn63_metadata_text", """SELECT event_id, '{"type":"' || event_type || '","user":"' || user_id || '"}' AS doc FROM events""")
def fn63(s):
    return s.events.select("event_id", F.to_json(F.create_map(F.lit("type"), "event_type", F.lit("user"), F.col("user_id").cast("string"))).alias("doc"))


@R.add("fn65_progress_percent", "SELECT event_id, CAST(greatest(0, least(100, floor((job_id % 4 + progress / 100) / 4 * 100))) AS INTEGER) AS percent FROM v_job")
def fn65(s):
    share = (F.col("job_id") % 4 + F.col("progress") / 100) / 4 * 100
    return s.v_job.select("event_id", F.greatest(F.lit(0), F.least(F.lit(100), F.floor(share))).cast("int").alias("percent"))


@R.add("fn66_job_stage", "SELECT event_id, CASE WHEN f < 0.35 THEN 'imagery' WHEN f < 0.65 THEN 'inference' WHEN f < 0.8 THEN 'vector' WHEN f < 0.92 THEN 'export' ELSE 'finalise' END AS stage, CAST(greatest(25, least(92, round_even(f * 100, 0))) AS INTEGER) AS percent FROM (SELECT event_id, progress / 100 AS f FROM v_job)")
def fn66(s):
    """Percent with halves to the even number."""
    j = s.v_job.withColumn("f", F.col("progress") / 100)
    return j.select("event_id", V.job_stage("f").alias("stage"), V.job_percent("f").alias("percent"))


@R.add("src02_snapshot_fallback", "SELECT project, arg_min(origin, (rank, -epoch_us(created_at), run_id)) AS origin FROM (SELECT *, CASE WHEN run_id % 7 = 0 THEN 'live' WHEN run_id % 3 = 0 THEN 'capabilities' WHEN run_id % 2 = 0 THEN 'disk' ELSE 'memory' END AS origin, CASE WHEN run_id % 7 = 0 THEN 0 WHEN run_id % 3 = 0 THEN 1 WHEN run_id % 2 = 0 THEN 2 ELSE 3 END AS rank FROM v_run) GROUP BY project")
def src02(s):
    k = F.col("run_id")
    rank = F.when(k % 7 == 0, 0).when(k % 3 == 0, 1).when(k % 2 == 0, 2).otherwise(3)
    origin = F.element_at(F.array(*[F.lit(x) for x in ("live", "capabilities", "disk", "memory")]), rank + 1)
    return s.v_run.groupBy("project").agg(F.min_by(origin, F.struct(rank, -F.unix_micros(F.col("created_at").cast("timestamp")), "run_id")).alias("origin"))


@R.add("src04_polygon_payloads", "SELECT feature_id FROM v_feature WHERE feature_id % 4 IN (0, 1, 2) AND feature_id % 8 <> 1")
def src04(s):
    """Collections, single features and bare geometries; other types and unreadable text are skipped."""
    return X.polygon_payloads(X.as_payloads(s.v_feature)).select("feature_id")


@R.add("src05_capped_lines", "SELECT feature_id, layer, total, total > 1000 AS capped FROM (SELECT *, count(*) OVER () AS total, row_number() OVER (ORDER BY feature_id) AS k FROM v_feature) WHERE k <= 1000")
def src05(s):
    """Lines of features written and scanned: the first rows up to a cap, with the total and whether it was passed."""
    to = staged_path(s.spark, "feature-lines")
    s.v_feature.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct("feature_id", "layer").alias("properties"))).alias("value")).write.text(to)
    return files.capped_lines(s.spark, to, "properties struct<feature_id: bigint, layer: string>", ["properties.feature_id"], 1000).select("properties.feature_id", "properties.layer", "total", "capped")


@R.add("src06_pair_summary", "SELECT lower(trim(label)) AS label, arg_max(total, release) AS total FROM (SELECT CASE release % 3 WHEN 0 THEN ' T1' WHEN 1 THEN 't2 ' ELSE 'x' END AS label, total, release FROM v_milestone) WHERE lower(trim(label)) IN ('t1', 't2') GROUP BY 1")
def src06(s):
    """A CSV of pairs: rows of the two dates by their label, the last line of each."""
    label = F.when(F.col("release") % 3 == 0, " T1").when(F.col("release") % 3 == 1, "t2 ").otherwise("x")
    to = staged_path(s.spark, "pair-summary")
    files.write_csv(s.v_milestone.select(F.col("release").alias("line"), label.alias("label"), "total"), to)
    rows = s.spark.read.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).schema("line bigint, label string, total double").csv(to)
    known = rows.withColumn("label", F.lower(F.trim("label"))).where(F.col("label").isin("t1", "t2"))
    return known.groupBy("label").agg(F.max_by("total", "line").alias("total"))


@R.add("src09_road_scan", f"SELECT road, round(lon * {math.pi} / 180 * 6378137, 3) AS x, round(ln(tan({math.pi} / 4 + lat * {math.pi} / 360)) * 6378137, 3) AS y FROM (SELECT road, CAST(v_road.at AS DOUBLE) / 1000 - 7 AS lon, CAST(v_road.at AS DOUBLE) / 2000 + 33 AS lat FROM v_road WHERE road % 5 <> 0 AND road % 3 <> 0) UNION ALL SELECT road, round(CAST(v_road.at AS DOUBLE), 3), round(CAST(v_road.at AS DOUBLE) / 2, 3) FROM v_road WHERE road % 5 <> 0 AND road % 3 = 0 AND road % 2 = 0")
def src09(s):
    """Roads as they come: only lines, only with a reference system, reprojected to metres. Here every fifth is a polygon, and of
    every third those with an odd number say no system, the others are in metres already."""
    k, at = F.col("road"), F.col("at").cast("double")
    kind = F.when(k % 5 == 0, "Polygon").when(k % 2 == 0, "MultiLineString").otherwise("LineString")
    crs = F.when(k % 3 != 0, "EPSG:4326").when(k % 2 == 0, "EPSG:3857")
    start = F.struct(F.when(k % 3 != 0, at / 1000 - 7).otherwise(at).alias("x"), F.when(k % 3 != 0, at / 2000 + 33).otherwise(at / 2).alias("y"))
    raw = s.v_road.select("road", kind.alias("type"), crs.alias("crs"), F.array(F.array(start)).alias("lines"))
    read = X.metric_lines(raw)
    return read.select("road", F.round(F.col("lines")[0][0].x, 3).alias("x"), F.round(F.col("lines")[0][0].y, 3).alias("y"))


@R.add("src10_metric_lines", "SELECT name, count(*) AS n, round(sum(value), 4) AS total FROM v_metric_event WHERE seq % 5 <> 0 GROUP BY name")
def src10(s):
    """Lines of JSON; those that can't be read are dropped."""
    line = F.when(F.col("seq") % 5 == 0, "{broken").otherwise(F.to_json(F.struct("name", "value")))
    read = s.v_metric_event.select(F.from_json(line, "name string, value double").alias("e")).select("e.*").where("name IS NOT NULL")
    return read.groupBy("name").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@R.add("src11_event_cutoff", "SELECT event_id FROM v_client_event WHERE received_at >= (SELECT max(received_at) FROM v_client_event) - INTERVAL 5 DAY AND (project = 7 OR contains(payload, '\"k\": 7}'))")
def src11(s):
    last = F.broadcast(s.v_client_event.agg(F.max("received_at").alias("last")))
    e = s.v_client_event.join(last, F.col("received_at") >= F.col("last") - F.expr("INTERVAL 5 DAY"))
    return e.where((F.col("project") == 7) | F.col("payload").contains('"k": 7}')).select("event_id")


@R.add("src12_tree_walk", "SELECT field_path, count(*) AS n, count(DISTINCT value) AS d FROM (SELECT '$.' || key AS field_path, json_extract_string(props, '$.' || key) AS value FROM (SELECT props, unnest(json_keys(props)) AS key FROM events) UNION ALL SELECT '$.user.id', CAST(user_id AS VARCHAR) FROM events UNION ALL SELECT '$.tags[' || i || ']', CAST(user_id % (i + 2) AS VARCHAR) FROM events, range(2) r(i)) GROUP BY field_path")
def src12(s):
    """Every leaf of nested documents with its path."""
    doc = F.to_json(F.struct(F.from_json("props", "k bigint").k.alias("k"), F.struct(F.col("user_id").alias("id")).alias("user"), F.array(F.col("user_id") % 2, F.col("user_id") % 3).alias("tags")))
    leaves = X.walk_json(s.events.select("event_id", doc.alias("doc")), "doc", ["event_id"], depth=3)
    return leaves.groupBy("field_path").agg(F.count("*").alias("n"), F.count_distinct("value").alias("d"))


@R.add("src13_reference_extraction", "WITH a AS (SELECT artifact_id, path, sha FROM v_artifact) SELECT artifact_id, 'pair_request_hash' AS reason, '$.pair_request_hash' AS field_path, substr(sha, 1, 24) AS request_hash FROM a UNION ALL SELECT artifact_id, 'cog_path', '$.imagery[0].cog_path', NULL FROM a WHERE artifact_id % 3 = 0 UNION ALL SELECT artifact_id, 'path', '$.imagery[0].path', substr(sha, 1, 24) FROM a WHERE artifact_id % 3 <> 0 UNION ALL SELECT artifact_id, 'text', '$.notes.free', substr(sha, 1, 24) FROM a WHERE artifact_id % 4 = 0 UNION ALL SELECT artifact_id, 'text', '$.notes.free', substr(sha, 25, 24) FROM a WHERE artifact_id % 4 = 0 AND substr(sha, 25, 24) <> substr(sha, 1, 24)")
def src13(s):
    """Nested metadata: values of keys that are known to hold paths or hashes, and any other text with a request's path; each
    with its place, why it counts, and the request's hash where it tells one."""
    k, sha = F.col("artifact_id"), F.substring("sha", 1, 24)
    path = F.concat(F.lit("/cache/requests/"), sha, F.lit("/a.tif"))
    item = F.when(k % 3 == 0, F.struct(F.concat(F.lit("/store/"), "path").alias("cog_path"), F.lit(None).cast("string").alias("path"))).otherwise(F.struct(F.lit(None).cast("string").alias("cog_path"), path.alias("path")))
    other = F.concat(F.lit("/old/requests/"), F.substring("sha", 25, 24), F.lit("/b.tif"))
    note = F.when(k % 4 == 0, F.concat(F.lit("see "), path, F.lit(" and "), other, F.lit(" or "), path)).otherwise("nothing")
    doc = F.to_json(F.struct(sha.alias("pair_request_hash"), F.array(item).alias("imagery"), F.struct(note.alias("free")).alias("notes")))
    return X.json_references(s.v_artifact.select("artifact_id", doc.alias("doc")), "doc", ["artifact_id"], depth=4)


@R.add("src14_evidence", "SELECT release AS id, 'milestone' AS origin, CAST(release_date AS VARCHAR) AS evidence FROM v_milestone WHERE status = 'complete' UNION ALL SELECT run_id, 'run', CAST(CAST(created_at AS DATE) AS VARCHAR) FROM v_run WHERE kind = 'pairwise' UNION ALL SELECT artifact_id, 'file', path FROM v_artifact WHERE path LIKE '%.csv'")
def src14(s):
    a = s.v_milestone.where("status = 'complete'").select(F.col("release").alias("id"), F.lit("milestone").alias("origin"), F.col("release_date").cast("string").alias("evidence"))
    b = s.v_run.where("kind = 'pairwise'").select(F.col("run_id").alias("id"), F.lit("run").alias("origin"), F.col("created_at").cast("date").cast("string").alias("evidence"))
    c = s.v_artifact.where("path LIKE '%.csv'").select(F.col("artifact_id").alias("id"), F.lit("file").alias("origin"), F.coalesce(F.nullif("path", F.lit("")), "sha").alias("evidence"))
    return a.unionByName(b).unionByName(c)


@R.add("src15_tile_lookup", "SELECT r.event_id, coalesce(p.status, f.status) AS status FROM (SELECT event_id, z, x, y FROM v_tile_check) r LEFT JOIN (SELECT z, x, y, max(status) AS status FROM v_tile_check WHERE event_id % 2 = 0 GROUP BY ALL) p USING (z, x, y) LEFT JOIN (SELECT z, x, y, max(status) AS status FROM v_tile_check WHERE event_id % 3 = 0 GROUP BY ALL) f USING (z, x, y)")
def src15(s):
    """A store first, a fallback second; which entries each of the two holds is the fixture's choice."""
    t = s.v_tile_check
    store = lambda k, n: t.where(F.col("event_id") % k == 0).groupBy("z", "x", "y").agg(F.max("status").alias(n))
    j = t.select("event_id", "z", "x", "y").join(store(2, "p"), ["z", "x", "y"], "left").join(store(3, "f"), ["z", "x", "y"], "left")
    return j.select("event_id", F.coalesce("p", "f").alias("status"))


@R.add("src16_manifest", "SELECT path, arg_min(origin, rank) AS origin FROM (SELECT path, 'registered' AS origin, 0 AS rank FROM v_artifact WHERE artifact_id % 3 = 0 UNION ALL SELECT path, 'found', 1 FROM v_artifact WHERE artifact_id % 2 = 0) GROUP BY path")
def src16(s):
    """Registered entries win over discovered ones."""
    a = s.v_artifact.where("artifact_id % 3 = 0").select("path", F.lit("registered").alias("origin"), F.lit(0).alias("rank"))
    b = s.v_artifact.where("artifact_id % 2 = 0").select("path", F.lit("found").alias("origin"), F.lit(1).alias("rank"))
    return a.unionByName(b).groupBy("path").agg(F.min_by("origin", "rank").alias("origin"))


@R.add("src17_wkt_import", f"SELECT feature_id, CASE WHEN feature_id % 2 = 0 THEN 'EPSG:3857' ELSE 'EPSG:4326' END AS crs, CASE WHEN feature_id % 2 = 0 THEN round(minx * 360.0 / {40075016.685578488}, 7) ELSE round(minx / 20.0 - 70, 7) END AS west, CASE WHEN feature_id % 2 = 0 THEN round(degrees(atan(sinh(maxy / 6378137.0))), 7) ELSE round(maxy / 100.0 + 55, 7) END AS north, feature_id % 2 = 0 OR maxx / 20.0 - 70 <= 180 AND maxy / 100.0 + 55 <= 90 AS valid FROM v_feature")
def src17(s):
    """Areas as WKT in metres or as GeoJSON in degrees: the system is told from the coordinates, metres become degrees, and the
    bounds must lie within those of the earth."""
    corners = lambda f, g: [(f(F.col(a)), g(F.col(b))) for a, b in (("minx", "miny"), ("maxx", "miny"), ("maxx", "maxy"), ("minx", "maxy"), ("minx", "miny"))]
    as_text = lambda v: v.cast("string")
    wkt = F.concat(F.lit("POLYGON (("), F.concat_ws(", ", *[F.concat_ws(" ", a, b) for a, b in corners(as_text, as_text)]), F.lit("))"))
    points = F.array(F.array(*[F.array(a, b) for a, b in corners(lambda v: v / 20.0 - 70, lambda v: v / 100.0 + 55)]))
    geo = F.to_json(F.struct(F.lit("Polygon").alias("type"), points.alias("coordinates")))
    text = F.when(F.col("feature_id") % 2 == 0, wkt).otherwise(geo)
    read = X.imported_areas(s.v_feature.select("feature_id", text.alias("text")), "text", F.when(F.col("feature_id") % 2 == 0, "EPSG:3857"))
    return read.select("feature_id", "crs", F.round("bounds.minx", 7).alias("west"), F.round("bounds.maxy", 7).alias("north"), "valid")


@R.add("src18_cached_runs", "SELECT run_id, 'expansion_only' AS semantics, m.status FROM v_run r LEFT JOIN v_milestone m ON m.release = r.run_id AND m.n_buffers > 1 WHERE kind = 'pairwise'")
def src18(s):
    m = s.v_milestone.where("n_buffers > 1").select(F.col("release").alias("run_id"), "status")
    return s.v_run.where("kind = 'pairwise'").join(m, "run_id", "left").select("run_id", F.lit("expansion_only").alias("semantics"), "status")


@R.add("snk01_feature_lines", """SELECT feature_id, '{"type":"Feature","properties":{"source_id":' || feature_id || ',"project_id":"p' || project || '","run_id":"' || substr(sha256(CAST(feature_id AS VARCHAR)), 1, 24) || '","release_identifier":"' || release || '","date":"' || strftime(release_date, '%Y-%m-%d') || '","layer_type":"' || layer || '","layer_label":"' || CASE layer WHEN 'additions' THEN 'New buildings' ELSE 'All buildings' END || '","feature_index":' || row_number() OVER (PARTITION BY project, release, layer ORDER BY feature_id) || ',"area_m2":' || ((maxx - minx) * (maxy - miny)) || ',"source_backend":"spark"},"geometry":{"type":"Polygon","coordinates":[[['
    || minx || ',' || miny || '],[' || maxx || ',' || miny || '],[' || maxx || ',' || maxy || '],[' || minx || ',' || maxy || '],[' || minx || ',' || miny || ']]]}}' AS line FROM v_feature WHERE layer <> 'blocks'""")
def snk01(s):
    """One feature a line, with its geometry: what it came with, overridden by the properties of the contract. Written by project
    and read back."""
    n = F.row_number().over(W.partitionBy("project", "release", "layer").orderBy("feature_id"))
    label = F.when(F.col("layer") == "additions", "New buildings").otherwise("All buildings")
    f = s.v_feature.where("layer <> 'blocks'")
    props = F.struct(F.col("feature_id").alias("source_id"), F.concat(F.lit("p"), F.col("project").cast("string")).alias("project_id"), F.substring(F.sha2(F.col("feature_id").cast("string"), 256), 1, 24).alias("run_id"), F.col("release").alias("release_identifier"),
                     F.date_format("release_date", "yyyy-MM-dd").alias("date"), F.col("layer").alias("layer_type"), label.alias("layer_label"), n.alias("feature_index"), F.expr("(maxx - minx) * (maxy - miny)").alias("area_m2"), F.lit("spark").alias("source_backend"))
    ring = F.array(*[F.array(a, b) for a, b in (("minx", "miny"), ("maxx", "miny"), ("maxx", "maxy"), ("minx", "maxy"), ("minx", "miny"))])
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))
    line = F.to_json(F.struct(F.lit("Feature").alias("type"), props.alias("properties"), geometry.alias("geometry")))
    to = staged_path(s.spark, "result-lines")
    files.write_feature_lines(f.withColumn("line", line), to, "project", "line", ["release", "layer", "feature_id"])
    back = s.spark.read.schema("value string, project bigint").text(to)
    return back.select(F.get_json_object("value", "$.properties.source_id").cast("bigint").alias("feature_id"), F.col("value").alias("line"))


@R.add("snk03_bi_rows", f"""WITH {CELLS}, u AS (SELECT DISTINCT project, release, release_date, layer, cx, cy FROM cell), g AS (SELECT project, release, min(release_date) AS day, layer, count(DISTINCT (cx, cy)) * 100 AS area FROM u GROUP BY project, release, layer), c AS (SELECT project, release, layer, avg(cx) + 0.5 AS mx, avg(cy) + 0.5 AS my FROM (SELECT DISTINCT project, release, layer, cx, cy FROM u) GROUP BY ALL)
    SELECT project AS project_id, 'Project ' || project AS project_name, strftime(day, '%Y-%m-%d') AS date, layer AS layer_type, area::DOUBLE AS area_m2, round(mx * 10 / {PLANE_SCALE} + {PLANE_LON}, 7) AS centroid_lon, round(my * 10 / {PLANE_SCALE} + {PLANE_LAT}, 7) AS centroid_lat FROM g JOIN c USING (project, release, layer)""")
def snk03(s):
    """The seven columns for business tools, a row for each milestone and layer with anything in it: written as tab-separated
    values in the order of date and layer, and read back."""
    keys = ["project", "release", "layer"]
    cells = C.union(C.cells_of_boxes(s.v_feature, keys, 10), keys)
    degrees = lambda c, zero: F.round((F.avg(c) + 0.5) * 10 / PLANE_SCALE + zero, 7)
    rows = cells.groupBy(*keys).agg((F.count("*") * 100).cast("double").alias("area_m2"), degrees("cx", PLANE_LON).alias("centroid_lon"), degrees("cy", PLANE_LAT).alias("centroid_lat"))
    days = s.v_feature.groupBy(*keys).agg(F.date_format(F.min("release_date"), "yyyy-MM-dd").alias("date"))
    rank = F.when(F.col("layer") == "additions", 1).when(F.col("layer") == "effective", 2).otherwise(3)
    named = rows.join(days, keys).select(F.col("project").alias("project_id"), F.concat(F.lit("Project "), F.col("project").cast("string")).alias("project_name"), "date", F.col("layer").alias("layer_type"), "area_m2", "centroid_lon", "centroid_lat")
    to = staged_path(s.spark, "bi")
    rank = F.when(F.col("layer_type") == "additions", 1).when(F.col("layer_type") == "effective", 2).otherwise(3)
    files.write_csv(named.orderBy(F.coalesce("date", F.lit("9999-99-99")), rank, "layer_type"), to, "\t")
    return s.spark.read.option("header", True).option("sep", "\t").schema(named.schema).csv(to)


@R.add("snk04_nested_results", """WITH c AS (SELECT project, release, count(*) FILTER (WHERE layer = 'additions') AS a, count(*) FILTER (WHERE layer = 'blocks') AS b, count(*) FILTER (WHERE layer = 'effective') AS e, sum((maxx - minx) * (maxy - miny))::BIGINT AS area FROM v_feature GROUP BY ALL)
    SELECT project, '{"project":' || project || ',"milestones":[' || string_agg('{"release":"' || release || '","metrics":{"area_m2":' || area || '},"features":{' || concat_ws(',', CASE WHEN a > 0 THEN '"additions":' || a END, CASE WHEN b > 0 THEN '"blocks":' || b END, CASE WHEN e > 0 THEN '"effective":' || e END) || '}}', ',' ORDER BY release) || ']}' AS doc FROM c GROUP BY project""")
def snk04(s):
    """Projects with their milestones, these with metrics and features by layer, as one document each."""
    layer = s.v_feature.groupBy("project", "release", "layer").agg(F.count("*").alias("n"), F.sum(F.expr("(maxx - minx) * (maxy - miny)")).alias("area"))
    counts = F.map_from_entries(F.array_sort(F.collect_list(F.struct("layer", "n"))))
    m = layer.groupBy("project", "release").agg(counts.alias("features"), F.struct(F.sum("area").alias("area_m2")).alias("metrics"))
    each = F.struct("release", "metrics", "features")
    # maps have no order, so the milestones are sorted by their release alone
    listed = F.array_sort(F.collect_list(F.struct("release", F.to_json(each).alias("j"))))
    body = F.array_join(F.transform(listed, lambda x: x.j), ",")
    return m.groupBy("project").agg(F.concat(F.lit('{"project":'), F.first(F.col("project")).cast("string"), F.lit(',"milestones":['), body, F.lit("]}")).alias("doc"))


@R.add("snk07_layer_groups", """WITH r AS (SELECT *, dense_rank() OVER (PARTITION BY project ORDER BY release) AS k FROM v_feature), x AS (SELECT project, 'cumulative' AS grp, 'all' AS layer, minx, maxx, miny, maxy FROM r WHERE layer = 'effective' AND k > 1 UNION ALL SELECT project, release, layer, minx, maxx, miny, maxy FROM r WHERE layer = 'additions' AND k > 1 UNION ALL SELECT project, 'buffers', d, minx, maxx, miny, maxy FROM r, (VALUES ('10m'), ('15m'), ('merged')) b(d) WHERE layer = 'blocks' AND k > 1)
    SELECT project, grp, layer, n, area, CASE WHEN grp LIKE 'WB%' THEN dense_rank() OVER (PARTITION BY project, grp LIKE 'WB%' ORDER BY grp DESC) ELSE 0 END AS place FROM (SELECT project, grp, layer, count(*) AS n, sum((maxx - minx) * (maxy - miny))::BIGINT AS area FROM x GROUP BY ALL)""")
def snk07(s):
    """The layered result: a cumulative layer, each milestone's additions (newest first), buffer layers by distance and merged;
    without the baseline, and without empty layers. Written by group and layer, and read back."""
    first = s.v_feature.groupBy(F.col("project").alias("_project")).agg(F.min("release").alias("_first"))  # the baselines
    later = F.coalesce(F.col("release") > F.col("_first"), F.col("_first").isNotNull())
    f = s.v_feature.join(first, F.col("project").eqNullSafe(F.col("_project"))).where(later)
    shape = ["project", "grp", "layer", "minx", "miny", "maxx", "maxy"]
    cumulative = f.where("layer = 'effective'").withColumns({"grp": F.lit("cumulative"), "layer": F.lit("all")})
    added = f.where("layer = 'additions'").withColumn("grp", F.col("release"))
    buffers = f.where("layer = 'blocks'").withColumns({"grp": F.lit("buffers"), "layer": F.explode(F.array(*map(F.lit, ("10m", "15m", "merged"))))})
    whole = cumulative.select(*shape).unionByName(added.select(*shape)).unionByName(buffers.select(*shape))
    to = staged_path(s.spark, "layers")
    # By ranges: a layer of any size is dealt out to several tasks, and a task writes few layers.
    whole.repartitionByRange(*["grp", "layer", *shape[:1], *shape[3:]]).write.partitionBy("grp", "layer").parquet(to)
    back = s.spark.read.schema("project bigint, minx bigint, miny bigint, maxx bigint, maxy bigint, grp string, layer string").parquet(to)
    found = back.groupBy("project", "grp", "layer").agg(F.count("*").alias("n"), F.sum(F.expr("(maxx - minx) * (maxy - miny)")).alias("area"))
    dated = F.col("grp").startswith("WB")
    place = F.dense_rank().over(W.partitionBy("project", dated).orderBy(F.desc("grp"))).cast("bigint")
    return found.withColumn("place", F.when(dated, place).otherwise(0))


@R.add("snk08_milestone_sheet", "SELECT release, round(total, 2) AS total, round(total - lag(total) OVER (PARTITION BY project ORDER BY release_date, release), 2) AS growth FROM v_milestone WHERE status = 'complete'")
def snk08(s):
    before = F.lag("total").over(W.partitionBy("project").orderBy("release_date", "release"))
    return s.v_milestone.where("status = 'complete'").select("release", F.round("total", 2).alias("total"), F.round(F.col("total") - before, 2).alias("growth"))


@R.add("snk08_block_sheet", f"SELECT project, release, row_number() OVER (PARTITION BY project, release ORDER BY feature_id) AS block_no, (maxx - minx) * (maxy - miny) AS area_m2, round((minx + maxx) / 2.0 / {PLANE_SCALE} + {PLANE_LON}, 7) AS lon, round((miny + maxy) / 2.0 / {PLANE_SCALE} + {PLANE_LAT}, 7) AS lat, round(p, 4) AS confidence FROM v_feature WHERE layer = 'blocks'")
def snk08_blocks(s):
    """The second sheet: each milestone's blocks, numbered."""
    degrees = lambda a, b, zero: F.round((F.col(a) + F.col(b)) / 2 / PLANE_SCALE + zero, 7)
    n = F.row_number().over(W.partitionBy("project", "release").orderBy("feature_id")).cast("bigint")
    return s.v_feature.where("layer = 'blocks'").select("project", "release", n.alias("block_no"), F.expr("(maxx - minx) * (maxy - miny)").alias("area_m2"), degrees("minx", "maxx", PLANE_LON).alias("lon"), degrees("miny", "maxy", PLANE_LAT).alias("lat"), F.round("p", 4).alias("confidence"))


@R.add("snk13_metric_text", r"""WITH e AS (SELECT kind, name, 'a"' || label || '\' AS label, value, seq FROM v_metric_event), m AS (SELECT kind, name, label, count(*) AS n, sum(value) AS s, arg_max(value, seq) AS v FROM e GROUP BY ALL), x AS (SELECT 1 AS r, name AS shown, name, label, {s} AS whole FROM m WHERE kind = 'counter' UNION ALL SELECT 2, name, name, label, {v} FROM m WHERE kind = 'gauge' UNION ALL SELECT 3, name || '_count', name, label, n::VARCHAR FROM m WHERE kind = 'histogram' UNION ALL SELECT 4, name || '_sum', name, label, {s} FROM m WHERE kind = 'histogram')
    SELECT row_number() OVER (ORDER BY CASE WHEN r < 3 THEN r ELSE 3 END, name, label, r) AS place, shown || '{label="' || replace(replace(label, '\', '\\'), '"', '\"') || '"} ' || whole AS line FROM x""".replace("{s}", r"regexp_replace(printf('%.6f', s::DOUBLE), '\.?0+$', '')").replace("{v}", r"regexp_replace(printf('%.6f', v::DOUBLE), '\.?0+$', '')"))
def snk13(s):
    """Samples as text: counters, gauges and histograms (as count and sum), in this order and then by name and label, whose
    values are escaped."""
    e = s.v_metric_event.withColumn("label", F.concat(F.lit('a"'), F.col("label").cast("string"), F.lit("\\")))
    return numbered(M.metric_lines(M.merged_metrics(e)), ["section", "name", "label", "part"], "place").select("place", "line")


@R.add("snk14_vector_tiles", "SELECT z, tx, ty, count(*) AS n, round(sum(area), 3) AS area FROM (SELECT *, greatest(a, least(b, miny + (maxx - hi) / k)) AS u, greatest(a, least(b, miny + (maxx - lo) / k)) AS v, (hi - lo) * (greatest(a, least(b, miny + (maxx - hi) / k)) - a) + (greatest(a, least(b, miny + (maxx - lo) / k)) - greatest(a, least(b, miny + (maxx - hi) / k))) * ((maxx - k * (greatest(a, least(b, miny + (maxx - hi) / k)) - miny) - lo) + (maxx - k * (greatest(a, least(b, miny + (maxx - lo) / k)) - miny) - lo)) / 2 AS area FROM (SELECT *, greatest(minx, tx * size)::DOUBLE AS lo, ((tx + 1) * size)::DOUBLE AS hi, greatest(miny, ty * size)::DOUBLE AS a, least(maxy, (ty + 1) * size)::DOUBLE AS b, (maxx - minx) * 0.25::DOUBLE / (maxy - miny) AS k FROM (SELECT *, unnest(range(miny // size, maxy // size + 1)) AS ty FROM (SELECT *, unnest(range(minx // size, maxx // size + 1)) AS tx FROM v_feature, (VALUES (1, 512), (2, 256), (3, 128)) p(z, size)))) WHERE b > a AND hi > lo AND lo < maxx - k * (a - miny)) WHERE area > 0 GROUP BY z, tx, ty")
def snk14(s):
    """Features clipped to the tiles of every level: written by level, one row for each feature and tile with its cut ring, and
    read back."""
    to = staged_path(s.spark, "vector-tiles")
    feature_tiles(s.v_feature).select("z", "tx", "ty", "feature_id", "cut").repartition("z", "tx", "ty").sortWithinPartitions("tx", "ty", "feature_id").write.partitionBy("z").parquet(to)
    back = s.spark.read.schema(f"tx bigint, ty bigint, feature_id bigint, cut {RING}, z int").parquet(to)
    return back.groupBy("z", "tx", "ty").agg(F.count("*").alias("n"), F.round(F.sum(F.abs(signed_area("cut"))), 3).alias("area"))


@R.add("snk15_layer_catalog", "SELECT project, layer, count(*) AS feature_count, min(minx) AS minx, min(miny) AS miny, max(maxx) AS maxx, max(maxy) AS maxy, 10 AS minzoom, 18 AS maxzoom FROM v_feature GROUP BY project, layer")
def snk15(s):
    bbox = [f(f"{e}{v}").alias(f"{e}{v}") for f, e in ((F.min, "min"), (F.max, "max")) for v in "xy"]
    return s.v_feature.groupBy("project", "layer").agg(F.count("*").alias("feature_count"), *bbox).withColumns({"minzoom": F.lit(10), "maxzoom": F.lit(18)})


@R.add("snk16_export_manifest", """WITH own AS (SELECT project, release, layer, count(*) AS n, [min(minx), min(miny), max(maxx), max(maxy)] AS bbox FROM v_feature GROUP BY ALL), told AS (SELECT artifact_id % 40 AS project, source AS layer, max(size) AS size, max(age_h) AS age_h, max(sha) AS sha, count(*) * 1000 AS n FROM v_artifact WHERE path LIKE '%.geojson' GROUP BY ALL),
    l AS (SELECT unnest(['additions', 'effective', 'blocks', 'envelope']) AS layer), m AS (SELECT DISTINCT project, release FROM v_feature), e AS (SELECT m.project, m.release, l.layer, own.n IS NOT NULL AS "exists", coalesce(told.n, own.n, 0) AS feature_count, own.bbox, CASE WHEN own.n IS NULL THEN [] ELSE ['Polygon'] END AS types, told.size, told.age_h, told.sha FROM m CROSS JOIN l LEFT JOIN own ON own.project = m.project AND own.release = m.release AND own.layer = l.layer LEFT JOIN told ON told.project = m.project AND told.layer = 'src' || (length(l.layer) - 6))
    SELECT *, sha256(string_agg(release || '|' || layer || '|' || feature_count || '|' || coalesce(sha, ''), ';') OVER (PARTITION BY project ORDER BY release, layer ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS fingerprint FROM e""")
def snk16(s):
    """Every milestone with every result layer: whether it is there, its features, bounds and types, and of its recorded file
    the size, age and checksum, where recorded values win over computed ones; and one fingerprint for each project."""
    bbox = F.array(F.min("minx"), F.min("miny"), F.max("maxx"), F.max("maxy"))
    own = s.v_feature.groupBy("project", "release", "layer").agg(F.count("*").alias("n"), bbox.alias("bbox"))
    told = s.v_artifact.where("path LIKE '%.geojson'").groupBy((F.col("artifact_id") % 40).alias("project"), F.col("source").alias("file")).agg(F.max("size").alias("size"), F.max("age_h").alias("age_h"), F.max("sha").alias("sha"), (F.count("*") * 1000).alias("told"))
    layers = s.v_feature.select("project", "release").distinct().withColumn("layer", F.explode(F.array(*map(F.lit, ("additions", "effective", "blocks", "envelope")))))
    return X.manifest(layers.withColumn("file", F.concat(F.lit("src"), (F.length("layer") - 6).cast("string"))), own, told, ["project", "release", "layer"], ["project", "file"], "project").drop("file")
