"""Readers that check what they read: part files, weights, detections, and the tags of JSON objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_parts(spark: SparkSession, folder: str, pattern: str = "*_part*.parquet", columns: list[str] | None = None) -> DataFrame:
    """All part files of a folder as one table, of which only the given columns are read; an error if there are none."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{pattern}")
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place):
        raise FileNotFoundError(f"{folder} has no {pattern}")
    found = spark.read.parquet(f"{folder}/{pattern}")
    return found.select(*columns) if columns else found


def read_weights(spark: SparkSession, path: str, first: int = 4) -> DataFrame:
    """A catalogue of objects with one weight for each effect, from the column at `first` on; rows without any weight go.

    Objects must occur once and weights be numbers from 0 to 1: rows that break this end the query with an error.
    """
    raw = spark.read.option("header", True).csv(path)
    key, effects = raw.columns[0], raw.columns[first:]
    if not effects:
        raise ValueError("the catalogue has no weights")
    number = lambda c: F.coalesce(F.col(f"`{c}`").try_cast("double"), F.when(F.col(f"`{c}`").isNull(), 0.0))
    sound = lambda c: F.coalesce(number(c).between(0.0, 1.0), F.lit(False))
    checked = [F.when(sound(c), number(c)).otherwise(F.raise_error(F.concat(F.lit(f"{c}: no weight from 0 to 1 for "), F.coalesce(key, F.lit("null")))).cast("double")).alias(c) for c in effects]
    counts = raw.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    once = raw.join(counts, key).filter(F.when(F.col("_n") == 1, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("given twice: "), F.col(key))).cast("boolean")))
    weights = once.select(key, *checked)
    return weights.filter(F.greatest(*[F.col(f"`{c}`") for c in effects], F.lit(0.0)) > 0)


def read_detections(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Detections from one document per segment: (image_id, object_value, segment_id), each image once; and the segments that have a document.

    An image in several documents counts for the first file in order of names.
    """
    feature = "struct<id: string, properties: struct<image_id: string, object_value: string>>"
    docs = spark.read.text(path, wholetext=True).select(F.from_json("value", f"features array<{feature}>")["features"].alias("features"), F.input_file_name().alias("file"))
    docs = docs.withColumn("segment_id", F.regexp_extract("file", r"([^/]+)\.(?:geo)?json$", 1))
    rows = docs.select("file", "segment_id", F.posexplode("features").alias("at", "f")).select("file", "at", "segment_id", "f.properties.image_id", "f.properties.object_value")
    first = rows.groupBy("image_id").agg(F.min_by(F.struct("object_value", "segment_id"), F.struct("file", "at")).alias("_f"))
    return first.select("image_id", "_f.object_value", "_f.segment_id"), docs.select("segment_id").distinct()


def merged_tags(own: Column, patch: Column) -> Column:
    """A map with another's entries laid over it; an entry that the other sets to null goes."""
    kept = F.map_filter(own, lambda k, _: ~F.array_contains(F.map_keys(patch), k))
    return F.map_concat(kept, F.map_filter(patch, lambda _, v: v.isNotNull()))


def iso_stamp(at: Column | None = None) -> Column:
    """A point in time, now if none is given, in UTC to the second."""
    return F.date_format(F.to_utc_timestamp(at if at is not None else F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def logistic(x: Column) -> Column:
    """1 / (1 + exp(-x)) without overflow on either side."""
    small = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + small)).otherwise(small / (1 + small))


def logit(p: Column, margin: float = 1e-9) -> Column:
    held = F.greatest(F.lit(margin), F.least(F.lit(1 - margin), p))
    return F.when(p.isNotNull(), F.ln(held / (1 - held)))
