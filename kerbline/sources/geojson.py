"""Readers for GeoJSON, probe records, newline-delimited ways and keyed JSON documents."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LINE = T.ArrayType(T.ArrayType(T.DoubleType()))
# fixed values: names in the two countries' files and in the library
RENAMES = {
    "OBJECTID": "segment_id", "RoadClass": "road_class", "LandUse": "land_use", "UrbanPC": "urban_pc", "SpeedLimit": "speed_limit", "MedianSpeed": "median_speed", "F85thPercentileSpeed": "f85_speed",
    "SampleSize_avg": "sample_size_avg", "SampleSizeTotal": "sample_size_total", "Sample_Size_Total": "sample_size_total", "Shape_Length": "shape_length", "StreetImageLink": "street_image_link",
    "AnalysisStatus": "analysis_status", "ExcludeFromSpeedSPI": "exclude_from_speedspi",
}
NUMBERS = ("urban_pc", "speed_limit", "median_speed", "f85_speed", "sample_size_avg", "sample_size_total", "shape_length", "exclude_from_speedspi")


def read_features(spark: SparkSession, path: str, properties: Mapping[str, str]) -> DataFrame:
    """Features of a GeoJSON file as rows: the named properties (with their Spark types) and `geometry` as [[x, y], ...]."""
    fields = T.StructType([T.StructField(n, T._parse_datatype_string(t)) for n, t in properties.items()])
    schema = T.StructType([T.StructField("features", T.ArrayType(T.StructType([T.StructField("properties", fields), T.StructField("geometry", T.StructType([T.StructField("coordinates", LINE)]))])))])
    features = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("features").alias("f"))
    return features.select("f.properties.*", F.col("f.geometry.coordinates").alias("geometry"))


def read_segments(spark: SparkSession, path: str, country: str) -> DataFrame:
    """A country's segments under the library's names; numbers that come as text are converted, absent columns filled."""
    found = read_features(spark, path, {n: "string" for n in RENAMES})
    names: dict[str, list] = {}
    for theirs, ours in RENAMES.items():
        names.setdefault(ours, []).append(F.col(theirs))
    columns = [(F.coalesce(*cs).cast("double") if ours in NUMBERS else F.coalesce(*cs)).alias(ours) for ours, cs in names.items()]
    df = found.select(*columns, "geometry").withColumn("exclude_from_speedspi", F.coalesce("exclude_from_speedspi", F.lit(0.0)))
    zero = (F.col("speed_limit") == 0) & (F.col("median_speed") == 0) & (F.col("f85_speed") == 0)
    return df.withColumns({"country": F.lit(country), "data_quality_flag": F.when(zero, "invalid_speed")})


def analysed(segments: DataFrame) -> DataFrame:
    return segments.filter((F.col("analysis_status") == "Valid") & ~(F.col("exclude_from_speedspi").eqNullSafe(F.lit(1.0))))


def read_ways(spark: SparkSession, path: str) -> DataFrame:
    """Newline-delimited GeoJSON of ways, with or without record separators: osm_way_id, highway, tags (JSON), geometry."""
    lines = spark.read.text(path).select(F.regexp_replace("value", "\x1e", "").alias("line")).filter(F.trim("line") != "")
    at = lambda key: F.get_json_object("line", key)
    return lines.select(at("$.properties['@id']").cast("long").alias("osm_way_id"), at("$.properties.highway").alias("highway"), at("$.properties").alias("tags"), F.from_json(at("$.geometry.coordinates"), LINE).alias("geometry"))


def flatten_documents(documents: DataFrame, column: str = "json") -> DataFrame:
    """{key: [feature, ...]} documents as rows (segment_id, object_value, feature)."""
    keyed = documents.select(F.explode(F.from_json(column, "map<string,array<struct<id:string,object_value:string>>>")).alias("segment_id", "features"))
    return keyed.select("segment_id", F.explode("features").alias("feature")).select("segment_id", "feature.object_value", "feature.id")
