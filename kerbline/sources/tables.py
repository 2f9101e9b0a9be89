"""The driver's tables as the library's inputs: segments, points, ways, edges and the rest.

Column names follow the data model of the library (see README); the derivations are deterministic and use integer and
decimal arithmetic, so any engine gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Land use by market segment.
URBAN_MARKETS = ("AUTOMOBILE", "HOUSEHOLD", "FURNITURE")


#: HotSpot never compiles a method of more bytecode, so Spark must not fuse more into one.
LARGEST_METHOD = ("spark.sql.codegen.hugeMethodLimit", "8000")


def tuned(spark: SparkSession) -> SparkSession:
    """The session, with generated code held to what the JVM compiles; a limit that is already set stays."""
    name, value = LARGEST_METHOD
    if spark.conf.get(name, "65535") == "65535":
        spark.conf.set(name, value)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark = tuned(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def exprs(df: DataFrame, **columns: str) -> DataFrame:
    """df with columns added from SQL expressions, each seeing those before it."""
    for name, text in columns.items():
        df = df.withColumn(name, F.expr(text))
    return df


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order line number; its parent is the order."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("ok"), F.col("l_linenumber").alias("ln")).agg(
        F.min("l_partkey").alias("pk"), F.min("l_suppkey").alias("sk"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("ext")
    )
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ok"), "o_custkey", "o_totalprice", F.substring("o_orderpriority", 1, 1).alias("priority"))
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey", "c_mktsegment", "c_acctbal")
    df = lines.join(orders.join(customers, "o_custkey"), "ok")
    return df.select(
        F.expr("CASE WHEN c_nationkey % 2 = 0 THEN 'thailand' ELSE 'maharashtra' END").alias("country"),
        F.when(F.col("c_mktsegment").isin(*URBAN_MARKETS), "URBAN").otherwise("RURAL").alias("land_use"),
        F.expr("CASE priority WHEN '1' THEN 'motorway' WHEN '2' THEN 'trunk' WHEN '3' THEN 'primary' WHEN '4' THEN 'secondary' ELSE 'tertiary' END").alias("road_class"),
        F.expr("concat(CASE WHEN c_nationkey % 2 = 0 THEN 'thailand' ELSE 'maharashtra' END, '_', ok, '-', ln)").alias("segment_id"),
        F.col("ok").alias("parent_id"),
        F.col("ln").alias("piece_no"),
        F.expr("CASE WHEN pk % 37 = 0 THEN 'invalid_speed' END").alias("data_quality_flag"),
        F.expr("CAST(CASE WHEN pk % 37 = 0 THEN 0 ELSE 20 + 10 * (sk % 10) END AS DOUBLE)").alias("speed_limit"),
        F.expr("CAST(CASE WHEN pk % 37 = 0 THEN 0 ELSE 25 + (7 * pk) % 90 END AS DOUBLE)").alias("median_speed"),
        F.expr("CAST(CASE WHEN pk % 37 = 0 THEN 0 ELSE 23 + (7 * pk) % 90 + (ok + ln) % 30 END AS DOUBLE)").alias("f85_speed"),
        F.expr("CASE WHEN sk % 5 = 0 THEN CAST(22 + (7 * pk) % 90 AS DOUBLE) END").alias("tomtom_mean_speed"),
        F.expr("CASE WHEN sk % 5 = 0 THEN CAST(4 + pk % 12 AS DOUBLE) END").alias("tomtom_sd_speed"),
        F.expr("CASE WHEN sk % 5 = 0 THEN 'tomtom' ELSE 'overture' END").alias("speed_data_source"),
        F.col("o_totalprice").alias("sample_size_avg"),
        F.expr("CAST(ext / 10 AS DECIMAL(18,3))").alias("length_m"),
        F.expr("greatest(c_acctbal, 0D)").alias("pop_density"),
        F.expr("priority = '1' OR ok % 11 = 0").alias("is_access_controlled"),
        F.expr("ok % 3 <> 0").alias("is_divided"),
        F.expr("ok % 4 = 1").alias("is_grade_separated"),
        F.expr("CASE ok % 4 WHEN 0 THEN 'no' WHEN 1 THEN 'yes' WHEN 2 THEN 'unknown' END").alias("legal_motorcycle"),
        F.expr("pk % 29 = 0").alias("has_vru_barrier"),
        F.expr("pk % 13 = 0").alias("has_motorcycle_separation"),
        F.expr("CAST((pk % 17) * (sk % 3) AS INT)").alias("poi_count"),
        F.expr("CAST(pk % 6 AS INT)").alias("osm_poi_category_count"),
        F.expr("(pk + sk) % 5 = 0").alias("is_mapillary_vru"),
        F.expr("CAST((ok + ln) % 4 AS INT)").alias("crossing_count"),
        F.expr("(ok + ln) % 4 > 0").alias("has_crossing"),
        F.expr("CASE WHEN (ok + 3 * ln) % 9 = 0 THEN 'Insufficient' WHEN (ok + 3 * ln) % 41 = 1 THEN NULL ELSE 'Valid' END").alias("analysis_status"),
        F.expr("CASE WHEN ok % 13 = 0 THEN 1D WHEN ok % 13 > 1 THEN 0D END").alias("exclude_from_speedspi"),
        F.expr("CASE ok % 6 WHEN 0 THEN 'no' WHEN 1 THEN 'yes' WHEN 2 THEN 'restricted' WHEN 3 THEN 'no' WHEN 4 THEN 'unknown' END").alias("legal_foot"),
        F.expr("CASE WHEN ok % 4 IN (0, 3) THEN 'no' ELSE 'yes' END").alias("legal_bicycle"),
        F.expr("CASE ln % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END").alias("legal_foot_confidence"),
        F.expr("CASE WHEN pk % 8 = 0 THEN CAST(30 + 5 * (pk % 11) AS DOUBLE) END").alias("tomtom_speed_limit"),
        F.expr("CASE WHEN pk % 3 = 0 THEN CAST((pk % 12) * 7 AS DOUBLE) END").alias("tomtom_median_speed"),
        F.expr("CASE WHEN pk % 6 = 0 THEN CAST((pk % 12) * 7 + 11 AS DOUBLE) END").alias("tomtom_p85_speed"),
        F.expr("(7919 * ok) % 20011 + CASE WHEN ok % 2 = 0 THEN 60 * (ln - 1) ELSE 0 END").cast("double").alias("x1"),
        F.expr("(104729 * ok) % 20021 + CASE WHEN ok % 2 = 1 THEN 60 * (ln - 1) ELSE 0 END").cast("double").alias("y1"),
        F.expr("(7919 * ok) % 20011 + CASE WHEN ok % 2 = 0 THEN 60 * ln ELSE 0 END").cast("double").alias("x2"),
        F.expr("(104729 * ok) % 20021 + CASE WHEN ok % 2 = 1 THEN 60 * ln ELSE 0 END").cast("double").alias("y2"),
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of interest and junctions: one per event."""
    kind = "CASE event_type WHEN 'view' THEN 'school' WHEN 'click' THEN 'hospital' WHEN 'purchase' THEN 'shop' WHEN 'signup' THEN 'bus_stop' ELSE 'junction' END"
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.expr(kind).alias("category"),
        F.expr("CAST((6007 * event_id + 311) % 20011 AS DOUBLE)").alias("px"),
        F.expr("CAST((31 * event_id * event_id + 7901 * event_id + 97) % 20021 AS DOUBLE)").alias("py"),
        F.expr("value / 500").alias("confidence"),
        "user_id",
        "ts",
        "value",
        "props",
    )


def ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One way per part, with promoted tags and the rest as JSON."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("osm_way_id"),
        F.expr("CASE WHEN p_partkey % 2 = 0 THEN 'thailand' ELSE 'maharashtra' END").alias("country"),
        F.expr("CASE p_partkey % 7 WHEN 0 THEN 'motorway' WHEN 1 THEN 'trunk' WHEN 2 THEN 'primary' WHEN 3 THEN 'residential' WHEN 4 THEN 'footway' WHEN 5 THEN 'cycleway' ELSE 'service' END").alias("highway"),
        F.expr("CASE p_partkey % 5 WHEN 0 THEN 'no' WHEN 1 THEN 'private' WHEN 2 THEN 'yes' END").alias("access"),
        F.expr("CASE p_partkey % 11 WHEN 0 THEN 'no' WHEN 1 THEN 'yes' WHEN 2 THEN 'destination' WHEN 3 THEN 'strange' END").alias("vehicle"),
        F.expr("CASE p_partkey % 13 WHEN 0 THEN 'no' WHEN 1 THEN 'yes' WHEN 2 THEN 'permit' END").alias("motor_vehicle"),
        F.expr("CASE p_partkey % 17 WHEN 0 THEN 'no' WHEN 1 THEN 'designated' WHEN 2 THEN ' yes ' WHEN 3 THEN '' END").alias("motorcycle"),
        F.expr("CASE p_partkey % 19 WHEN 0 THEN 'no' WHEN 1 THEN 'yes' WHEN 2 THEN 'use_sidepath' END").alias("foot"),
        F.expr("CASE p_partkey % 23 WHEN 0 THEN 'no' WHEN 1 THEN 'designated' END").alias("bicycle"),
        F.expr("CASE WHEN p_partkey % 3 = 0 THEN 'yes' WHEN p_partkey % 3 = 1 THEN '-1' END").alias("oneway"),
        F.expr("CASE p_size % 6 WHEN 0 THEN '0' WHEN 1 THEN '1' WHEN 2 THEN '0;1' WHEN 3 THEN 'abc' WHEN 4 THEN '-1' END").alias("layer"),
        F.expr("CASE WHEN p_partkey % 31 = 0 THEN 'yes' WHEN p_partkey % 31 = 1 THEN 'viaduct' WHEN p_partkey % 31 = 2 THEN 'no' END").alias("bridge"),
        F.expr("CASE WHEN p_partkey % 37 = 0 THEN 'yes' END").alias("tunnel"),
        F.expr(
            "concat('{', CASE WHEN p_partkey % 4 = 0 THEN '\"motorroad\":\"yes\",' ELSE '' END, CASE WHEN p_partkey % 6 = 0 THEN '\"sidewalk\":\"both\",' WHEN p_partkey % 6 = 1 THEN '\"sidewalk\":\"no\",' ELSE '' END,"
            " CASE WHEN p_partkey % 9 = 0 THEN '\"dual_carriageway\":\"yes\",' ELSE '' END, CASE WHEN p_partkey % 10 = 0 THEN '\"cycleway\":\"lane\",' ELSE '' END,"
            " CASE WHEN p_partkey % 21 = 0 THEN '\"motorcar\":\"no\",' ELSE '' END, CASE WHEN p_partkey % 12 = 0 THEN '\"motorcar:conditional\":\"no @ (22:00-05:00)\",' ELSE '' END, '\"ref\":\"', p_partkey, '\"}')"
        ).alias("tags"),
        F.col("p_retailprice").alias("length_m"),
        F.col("p_name").alias("name"),
        F.col("p_size").alias("size"),
    )


def row_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of segments attributed to ways: one row per order line."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return table(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(
        table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")
    ).select(
        F.expr("concat(CASE WHEN c_nationkey % 2 = 0 THEN 'thailand' ELSE 'maharashtra' END, '_', l_orderkey, '-', l_linenumber)").alias("segment_id"),
        F.col("l_orderkey").alias("parent_id"),
        F.col("l_partkey").alias("osm_way_id"),
        F.expr("CAST(l_quantity AS DECIMAL(12,2))").alias("matched_len_m"),
        F.expr("CASE WHEN l_linestatus = 'F' THEN 'exact' ELSE 'tolerance' END").alias("match_kind"),
        F.col("l_linenumber").alias("piece_no"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of parents in order: parent_id, k, coordinates of both ends."""
    return segments(spark, sf_dir).select("parent_id", "country", "road_class", F.col("piece_no").alias("k"), "x1", "y1", "x2", "y2")


def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 19-point speed distribution for each vector: its first 19 components in order, scaled to speeds."""
    sorted_first = "array_sort(transform(slice(embedding, 1, 19), x -> round(50 + 100 * CAST(x AS DOUBLE), 6)))"
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("segment_no"), "label", F.expr(sorted_first).alias("speeds"), F.expr("CAST(20 + 10 * (vec_id % 9) AS DOUBLE)").alias("v_safe"))


