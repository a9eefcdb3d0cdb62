"""GeoJSON feature collections to and from vertex rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLLECTION = "features array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>, expected_features int"


def read_polygons(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """name, polygon, ring, seq, lat, lon of Polygon and MultiPolygon features; any other geometry stops the read.

    Coordinates are kept as text by the reader and parsed by type, as their depth differs.
    """
    files = spark.read.schema(COLLECTION).option("multiLine", multi_line).json(path)
    f = files.select(F.explode("features").alias("f")).select(
        F.coalesce(F.col("f.properties")["NAME"], F.col("f.properties")["name"]).alias("name"), F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("c"))
    parts = (F.when(F.col("kind") == "Polygon", F.array(F.from_json("c", "array<array<array<double>>>")))
             .when(F.col("kind") == "MultiPolygon", F.from_json("c", "array<array<array<array<double>>>>"))
             .otherwise(F.raise_error(F.concat(F.lit("geometry is neither Polygon nor MultiPolygon: "), F.col("kind"))).cast("array<array<array<array<double>>>>")))
    f = f.select("name", F.posexplode(parts).alias("polygon", "rings"))
    f = f.select("name", "polygon", F.posexplode("rings").alias("ring", "points"))
    return f.select("name", "polygon", "ring", F.posexplode("points").alias("seq", "p")).select("name", "polygon", "ring", "seq", F.get("p", F.lit(1)).alias("lat"), F.get("p", F.lit(0)).alias("lon"))


def collections(rings: DataFrame, part) -> DataFrame:
    """One FeatureCollection text a part, from (rid, seq, qlat, qlon); rings are closed, every other one becomes a MultiPolygon."""
    pts = F.transform(F.array_sort(F.collect_list(F.struct("seq", "qlat", "qlon"))), lambda s: F.array(s["qlon"] / 1e7, s["qlat"] / 1e7))
    r = rings.groupBy("rid").agg(pts.alias("p")).withColumn("p", F.concat("p", F.slice("p", 1, 1)))
    single, multi = F.to_json(F.array("p")), F.to_json(F.array(F.array("p")))
    odd = F.col("rid") % 2 == 1
    text = F.concat(F.lit('{"type":"Feature","properties":{"NAME":"ring '), F.col("rid"), F.lit('"},"geometry":{"type":"'), F.when(odd, "MultiPolygon").otherwise("Polygon"),
                    F.lit('","coordinates":'), F.when(odd, multi).otherwise(single), F.lit("}}"))
    whole = r.select(part.alias("part"), text.alias("t")).groupBy("part").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    return whole.select("part", F.concat(F.lit('{"type":"FeatureCollection","expected_features":'), F.size("ts"), F.lit(',"features":['), F.array_join("ts", ","), F.lit("]}")).alias("value"))
