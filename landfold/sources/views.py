"""Domain tables derived from the supplied ones: rasters, features, milestones, runs, tile checks, timings, inventories.

Each view is one SELECT over supplied tables, named in braces. `duck` gives the text for the SQL twin where it differs.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

_PIXEL = "SELECT CASE WHEN vec_id % 2 = 0 THEN 't1' ELSE 't2' END AS raster, CAST(floor(vec_id / 2) AS BIGINT) AS row, CAST(pos AS BIGINT) AS col, greatest(0, least(1, 0.5 + CAST(e AS DOUBLE) * 2)) AS p FROM "
_RELEASE = "concat('WB_', CAST(year(o_orderdate) AS {s}), '_R0', CAST(quarter(o_orderdate) AS {s}))"
_FEATURE = """SELECT o_custkey % 40 AS project, {release} AS release, CAST(o_orderdate AS DATE) AS release_date, CASE o_orderstatus WHEN 'F' THEN 'additions' WHEN 'O' THEN 'effective' ELSE 'blocks' END AS layer,
    o_orderkey AS feature_id, (o_orderkey * 7919) % 400 * 10 AS minx, (o_orderkey * 104729) % 400 * 10 AS miny,
    (o_orderkey * 7919) % 400 * 10 + 10 * (1 + o_orderkey % 5) AS maxx, (o_orderkey * 104729) % 400 * 10 + 10 * (1 + o_orderkey % 4) AS maxy,
    CAST(o_orderkey % 101 AS DOUBLE) / 100 AS p, o_totalprice AS score FROM {orders}"""

VIEWS: dict[str, tuple[str, str | None]] = {
    "v_pixel": (_PIXEL + "(SELECT vec_id, posexplode(embedding) AS (pos, e) FROM {embeddings})", _PIXEL + "(SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) - 1 AS pos FROM {embeddings})"),
    "v_feature": (_FEATURE.replace("{release}", _RELEASE.replace("{s}", "STRING")), _FEATURE.replace("{release}", _RELEASE.replace("{s}", "VARCHAR"))),
    "v_milestone": ("SELECT o_custkey AS project, o_orderkey AS release, CAST(o_orderdate AS DATE) AS release_date, CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'O' THEN 'pending' ELSE 'error' END AS status, o_totalprice AS total, o_orderkey % 5 AS n_buffers, o_orderpriority AS mode FROM {orders}", None),
    "v_project": ("SELECT c_custkey AS project, c_name AS name, c_mktsegment AS kind, c_acctbal AS budget FROM {customer}", None),
    "v_run": ("SELECT o_orderkey AS run_id, o_custkey AS project, CASE WHEN o_orderkey % 3 = 0 THEN 'pairwise' ELSE 'temporal' END AS kind, o_orderdate AS created_at, o_totalprice AS cost FROM {orders}", None),
    "v_job": ("SELECT event_id, user_id AS job_id, ts, CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'progress' END AS status, least(100, value) AS progress FROM {events}", None),
    "v_tile_check": ("SELECT event_id, user_id AS release, 10 + event_id % 4 AS z, (event_id * 31) % 1024 AS x, (event_id * 17) % 1024 AS y, CASE event_type WHEN 'view' THEN 'available' WHEN 'click' THEN 'available' WHEN 'error' THEN 'failed' ELSE 'missing' END AS status, value, ts FROM {events}", None),
    "v_timing": ("SELECT event_id AS tile, user_id % 20 AS run_id, event_type AS field, value AS ms, ts FROM {events}", None),
    "v_metric_event": ("SELECT event_id AS seq, ts, CASE event_type WHEN 'view' THEN 'counter' WHEN 'click' THEN 'counter' WHEN 'error' THEN 'gauge' ELSE 'histogram' END AS kind, event_type AS name, user_id % 10 AS label, value FROM {events}", None),
    "v_artifact": ("SELECT doc_id AS artifact_id, doc_id % 97 AS request, concat(source, '/', lang, '/', CAST(doc_id AS {s}), CASE doc_id % 5 WHEN 0 THEN '.geojson' WHEN 1 THEN '.tif' WHEN 2 THEN '.csv' WHEN 3 THEN '_preview.png' ELSE '.tmp' END) AS path, source, lang, n_chars AS size, sha2(text, 256) AS sha, doc_id % 400 AS age_h FROM {documents}",
                   "SELECT doc_id AS artifact_id, doc_id % 97 AS request, concat(source, '/', lang, '/', CAST(doc_id AS {s}), CASE doc_id % 5 WHEN 0 THEN '.geojson' WHEN 1 THEN '.tif' WHEN 2 THEN '.csv' WHEN 3 THEN '_preview.png' ELSE '.tmp' END) AS path, source, lang, n_chars AS size, sha256(text) AS sha, doc_id % 400 AS age_h FROM {documents}"),
    "v_reference": ("SELECT doc_id AS artifact_id, doc_id % 53 AS target, CASE WHEN toxic = 1 THEN 'pair_hash' WHEN quality = 1 THEN 'artifact_path' ELSE 'metadata' END AS reason FROM {labels}", None),
    "v_client_event": ("SELECT event_id, ts AS received_at, concat(event_type, '.loaded') AS event, user_id AS project, props AS payload FROM {events}", None),
    "v_road": ("SELECT n_nationkey AS road, CASE WHEN n_nationkey % 2 = 0 THEN 'h' ELSE 'v' END AS way, n_nationkey * 160 + 5 AS at FROM {nation}", "SELECT n_nationkey AS road, CASE WHEN n_nationkey % 2 = 0 THEN 'h' ELSE 'v' END AS way, n_nationkey * 160 + 5 AS \"at\" FROM {nation}"),
}
VIEWS["v_artifact"] = tuple(x.replace("{s}", k) for x, k in zip(VIEWS["v_artifact"], ("STRING", "VARCHAR"), strict=True))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = VIEWS[name][0]
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in set(re.findall(r"\{(\w+)\}", text))})


def duck(sql: str) -> str:
    """The SQL twin's text with the views that it names put before it."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    ctes = [f"{v} AS ({re.sub(r'[{](\w+)[}]', r'\1', VIEWS[v][1] or VIEWS[v][0])})" for v in used]
    sql = sql.strip()
    if sql.upper().startswith("WITH RECURSIVE"):
        return "WITH RECURSIVE " + ", ".join([*ctes, sql[14:].strip()])
    if sql.upper().startswith("WITH"):
        return "WITH " + ", ".join([*ctes, sql[4:].strip()])
    return f"WITH {', '.join(ctes)} {sql}" if ctes else sql
