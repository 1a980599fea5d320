"""Queries of file sources and sinks: rows go out to the shared folder in a format and are read back."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from landfold.operators import exports as X
from landfold.plans.base import Registry
from landfold.sources import files
from landfold.sources.staging import run_dir

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.oracle


def path(s, name: str) -> str:
    return f"{run_dir(s.spark)}/{name}-{uuid.uuid4().hex[:12]}"


@R.add("src01_release_catalog", "SELECT DISTINCT release AS identifier, make_date(CAST(substr(release, 4, 4) AS BIGINT), CAST(substr(release, 11, 1) AS BIGINT) * 3, 1) AS release_date, CAST(substr(release, 11, 1) AS INTEGER) AS release_num FROM v_feature WHERE substr(release, 11, 1) <> '4'")
def src01(s):
    """Releases written as XML layers; the fourth of a year has a title without the word, and is left out."""
    r = s.v_feature.select("release").distinct()
    n = F.substring("release", 11, 1)
    title = F.concat(F.when(n == "4", "Other").otherwise("Wayback"), F.lit(" "), F.date_format(F.make_date(F.substring("release", 4, 4).cast("int"), n.cast("int") * 3, F.lit(1)), "yyyy-MM-dd"))
    xml = F.concat(F.lit("<Layer><Title>"), title, F.lit("</Title><Identifier>"), "release", F.lit('</Identifier><ResourceURL template="https://tiles.example.org/'), n, F.lit('/{z}"/></Layer>'))
    to = path(s, "catalog")
    # a document has one root; here there is one for each year
    whole = r.groupBy(F.substring("release", 4, 4).alias("year")).agg(F.concat(F.lit("<Contents>"), F.array_join(F.collect_list(xml), ""), F.lit("</Contents>")).alias("value"))
    whole.write.partitionBy("year").text(to)
    return files.release_catalog(s.spark, f"{to}/*/", "Wayback").select("identifier", "release_date", "release_num")


@R.add("src03_geojson_scan", "SELECT layer AS name, feature_id FROM v_feature WHERE feature_id % 10 <> 0 AND layer <> 'blocks'")
def src03(s):
    """Two layers of collections, a line a project; every tenth geometry is null."""
    ring = F.to_json(F.array(F.array(F.array("minx", "miny"), F.array("maxx", "maxy"))))
    geometry = F.when(F.col("feature_id") % 10 != 0, F.struct(F.lit("Polygon").alias("type"), ring.alias("coordinates")))
    feature = F.struct(F.lit("Feature").alias("type"), F.create_map(F.lit("id"), F.col("feature_id").cast("string")).alias("properties"), geometry.alias("geometry"))
    paths = []
    for layer in ("additions", "effective"):
        lines = s.v_feature.where(F.col("layer") == layer).groupBy("project", "release").agg(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.lit(layer).alias("name"), F.collect_list(feature).alias("features"))).alias("value"))
        paths.append(path(s, "geojson"))
        lines.select("value").write.text(paths[-1])
    return files.geojson_features(s.spark, paths).select("name", F.col("properties")["id"].cast("bigint").alias("feature_id"))


@R.add("snk02_feature_line_files", "SELECT project, count(*) AS n FROM v_feature GROUP BY project")
def snk02(s):
    to = path(s, "lines")
    files.write_feature_lines(s.v_feature.withColumn("line", F.to_json(F.struct("feature_id", "layer"))), to, "project", "line", ["release", "feature_id"])
    back = s.spark.read.schema("value string, project bigint").text(to)
    return back.groupBy("project").agg(F.count("*").alias("n"))


@R.add("snk06_metrics_csv", "SELECT project, layer, count(*) AS n, sum((maxx - minx) * (maxy - miny))::BIGINT AS area FROM v_feature GROUP BY project, layer")
def snk06(s):
    rows = s.v_feature.groupBy("project", "layer").agg(F.count("*").alias("n"), F.sum(F.expr("(maxx - minx) * (maxy - miny)")).alias("area"))
    to = path(s, "csv")
    files.write_csv(rows, to)
    return s.spark.read.option("header", True).schema("project bigint, layer string, n bigint, area bigint").csv(to)


@R.add("src16_file_scan", """WITH l AS (SELECT project, layer, strlen('{"feature_id":' || feature_id || ',"layer":"' || layer || '"}') + 1 AS n FROM v_feature) SELECT 'layer=' || layer || '/project=' || project AS folder, sum(n)::BIGINT AS bytes, project % 3 = 0 AS registered FROM l GROUP BY ALL""")
def src16_files(s):
    """All files under a run, by a scan of the folder, with those that are registered: by resolved path, an entry that is
    registered wins. Here by folder, as file names are Spark's."""
    to = path(s, "run")
    rows = s.v_feature.select("project", "layer", F.to_json(F.struct("feature_id", "layer")).alias("value"))
    rows.repartition("project", "layer").write.partitionBy("layer", "project").text(to)
    found = files.file_inventory(s.spark, to)
    registered = found.where(F.regexp_extract("path", "project=([0-9]+)", 1).cast("int") % 3 == 0).withColumn("path", F.concat(F.lit("x/../"), "path"))
    entries = files.merged_entries(registered, found)
    folder = F.regexp_extract("path", "(layer=[^/]+/project=[0-9]+)/", 1)
    return entries.groupBy(folder.alias("folder")).agg(F.sum("size").alias("bytes"), F.bool_and("registered").alias("registered"))


def run_pairs(pairs: DataFrame, runner: Callable[[dict], dict], schema: str) -> DataFrame:
    """A user's function for one pair of milestones, called for each row where its partition is; `runner` takes and gives a row.
    A pair whose runner fails gives its columns NULL, and the error's text as `error`."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for pair in batch.to_dict("records"):
                try:
                    out.append({**runner(pair), "error": None})
                except Exception as failure:  # a runner is another's code; its pair is marked, the others go on
                    out.append({"error": str(failure)})
            yield pd.concat([batch, pd.DataFrame(out, columns=[*names, "error"], index=batch.index)], axis=1)

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields)
    return pairs.mapInPandas(run, f"{own}, {schema}, error string")


def growing(pair: dict) -> dict:
    """The query's runner: it fails where there is nothing to compare."""
    if pair["before"] != pair["before"] or pair["before"] is None:
        raise ValueError("no milestone before")
    return {"changed": pair["total"] - pair["before"]}


@R.add("udf02_pair_runner", "SELECT release, round(total - before, 4) AS changed, CASE WHEN before IS NULL THEN 'no milestone before' END AS error FROM (SELECT release, total, lag(total) OVER (PARTITION BY project ORDER BY release_date, release) AS before FROM v_milestone)")
def udf02(s):
    pairs = s.v_milestone.select("release", "total", F.lag("total").over(W.partitionBy("project").orderBy("release_date", "release")).alias("before"))
    return run_pairs(pairs, growing, "changed double").select("release", F.round("changed", 4).alias("changed"), "error")


@R.add("udf03_payload_getter", "SELECT release, list(feature_id ORDER BY feature_id) AS ids FROM v_feature WHERE layer IN ('additions', 'effective') GROUP BY release")
def udf03(s):
    """Collections of all milestones merged by a getter: an expression over the row that says which payloads take part."""
    layer = s.v_feature.groupBy("release", "layer").agg(F.collect_list("feature_id").alias("ids"))
    payloads = layer.groupBy("release").agg(F.map_from_entries(F.collect_list(F.struct("layer", "ids"))).alias("payloads"))
    return X.merged_payloads(payloads, ["release"], lambda: F.array_compact(F.array(*[F.try_element_at("payloads", F.lit(k)) for k in ("additions", "effective")]))).select("release", F.array_sort("merged").alias("ids"))
