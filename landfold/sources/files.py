"""Readers and writers of the files that come and go: release catalogs in XML, GeoJSON, lines, CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FEATURE = "struct<type: string, properties: map<string, string>, geometry: struct<type: string, coordinates: string>>"


def release_catalog(spark: SparkSession, path: str, word: str) -> DataFrame:
    """One row per Layer element whose title has the word and which has a resource URL: title, date from the title, number
    from the URL (or NULL); layers without a date are dropped. Ordered by date."""
    schema = "Title string, Identifier string, ResourceURL struct<_template: string>, TileMatrixSet array<string>"
    layers = spark.read.format("xml").option("rowTag", "Layer").schema(schema).load(path)
    url = F.col("ResourceURL._template")
    kept = layers.where(F.col("Title").contains(word) & url.isNotNull())
    day = F.try_to_date(F.nullif(F.regexp_extract("Title", r"(\d{4}-\d{2}-\d{2})", 1), F.lit("")), "yyyy-MM-dd")
    number = F.nullif(F.regexp_extract(url, r"/(\d+)/", 1), F.lit("")).cast("int")
    return kept.select(F.col("Identifier").alias("identifier"), day.alias("release_date"), F.col("Title").alias("label"), number.alias("release_num"), F.col("TileMatrixSet").alias("tile_matrix_sets"), url.alias("resource_url_template")).where("release_date IS NOT NULL").orderBy("release_date", "identifier")


def geojson_features(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Features of collections, one collection a line, of several layers under one another; null and empty geometries are
    dropped, properties kept as a map. Coordinates stay text until their type is known."""
    parts = []
    for path in paths:
        lines = spark.read.schema(f"type string, name string, features array<{FEATURE}>").json(path)
        parts.append(lines.select("name", F.explode("features").alias("f")).select("name", "f.properties", "f.geometry"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.where("geometry IS NOT NULL AND length(geometry.coordinates) > 2")


def write_feature_lines(rows: DataFrame, path: str, by: str, line: str, order: list[str]) -> None:
    """Lines of GeoJSON, a folder for each value of `by`, in order."""
    rows.repartition(by).sortWithinPartitions(by, *order).select(by, F.col(line).alias("value")).write.partitionBy(by).text(path)


def write_csv(rows: DataFrame, path: str, sep: str = ",") -> None:
    rows.write.option("header", True).option("sep", sep).csv(path)


def capped_lines(spark: SparkSession, path: str, schema: str, order: list[str], most: int) -> DataFrame:
    """Lines of JSON: the first `most` by `order`, with the total and whether it passes the cap."""
    rows = spark.read.schema(schema).json(path)
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).limit(most).crossJoin(F.broadcast(total)).withColumn("capped", F.col("total") > most)  # a single row


def resolved(path: Column) -> Column:
    """A path without `.` and without `name/..`, however many; what goes above the path's start stays."""
    none = F.array().cast("array<string>")

    def step(done: Column, part: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        up = (part == "..") & (F.size(done) > 0) & ~last.isin("..", "") & ~F.endswith(last, F.lit(":"))
        return F.when(part == ".", done).when(up, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(F.concat(done, F.array(part)))

    return F.array_join(F.aggregate(F.split(path, "/"), none, step), "/")


def file_inventory(spark: SparkSession, folder: str) -> DataFrame:
    """Every file under a folder: path, size, modified. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified")).where("NOT contains(path, '/_') AND NOT contains(path, '/.')")


def merged_entries(registered: DataFrame, found: DataFrame) -> DataFrame:
    """One entry for each resolved path, a registered one before one that was found: path, size, modified, registered."""
    both = registered.withColumn("registered", F.lit(True)).unionByName(found.withColumn("registered", F.lit(False))).withColumn("path", resolved(F.col("path")))
    whole = both.groupBy("path").agg(F.max_by(F.struct("size", "modified", "registered"), F.struct(F.col("registered"), "size")).alias("e"))
    return whole.select("path", "e.*")
