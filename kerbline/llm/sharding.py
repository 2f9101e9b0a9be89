"""Sharding by proportional stratified interleaving.

Rows are shuffled within each source by a seeded hash and ranked there; the fractional rank (rank - offset) / (rows of
the source) spreads each source evenly over 0 to 1; sorting by it and cutting into runs of equal length gives shards
that all have the sources in the corpus's own proportions.  The offset is a hash of the source between 0 and 1, so that
many small sources do not all fall on the same fraction.

Neither ranking gathers a source in one task.  A row's rank is the number of rows in earlier hash ranges of its source
(a running sum over a small table of counts) plus its place within its own range, and a range holds about
`rows_per_range` rows whatever the share of the source.  The position in the whole order is found in the same way from
ranges of the fractional rank.  The hash covers id and row, so that rows of one id are spread as well.

Defined results: a null source is a source of its own; a null id hashes as an empty one; rows that agree in all columns
stay apart and each takes a place (which of two equal rows comes first cannot be told apart); with no rows there is no
shard; with fewer rows than shards some shards are empty; input columns named `shard` or `slot` are replaced, any other
name is free.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import cut, null_key, salted_hash

HASH_BITS = 60
#: Ranges have at least and at most so many bits.
LEAST_BITS, MOST_BITS = 8, 24


def _running(counts: DataFrame, group: list[str], by: str, coarse: int = 10) -> DataFrame:
    """counts (group, by, _n) with `_before`: the rows in earlier ranges, and `_total`: the rows of the group.

    Sums run over ranges of ranges first, then within each of these, so no task holds more than a few thousand rows of
    a group.
    """
    counts = counts.withColumn("_coarse", F.shiftright(by, coarse))
    earlier = lambda keys, order: Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    wide = counts.groupBy(*group, "_coarse").agg(F.sum("_n").alias("_n"))
    wide = wide.select(*group, "_coarse", F.coalesce(F.sum("_n").over(earlier(group, "_coarse")), F.lit(0)).alias("_offset"), F.sum("_n").over(Window.partitionBy(*group)).alias("_total"))
    inside = counts.withColumn("_inside", F.coalesce(F.sum("_n").over(earlier([*group, "_coarse"], by)), F.lit(0)))
    return inside.join(wide, [*group, "_coarse"]).select(*group, by, (F.col("_offset") + F.col("_inside")).alias("_before"), "_total")


def draw(rows: DataFrame, seed: int, key: str) -> Column:
    """The hash that shuffles rows: of the id and of all columns that can be hashed."""
    hashed = [F.col(f"`{f.name}`") for f in rows.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    return salted_hash(seed, F.col(key), F.xxhash64(*hashed))


def offset(seed: int, source: Column) -> Column:
    return salted_hash(seed + 1, source) / F.lit(float(1 << HASH_BITS))


def interleave(
    rows: DataFrame, *, shards: int, source: str = "source", key: str = "doc_id", seed: int = 17, rows_per_range: int = 20_000
) -> DataFrame:
    """rows with `shard` (0 to shards - 1) and `slot` (gapless from 0 within a shard); sizes differ by one row at most."""
    rows = rows.drop("shard", "slot")
    total = rows.count()
    bits = max(LEAST_BITS, min(MOST_BITS, (total // rows_per_range).bit_length()))
    wide = 1 << bits
    # the input's columns travel as one, so their names cannot clash
    hashed = rows.select(F.struct("*").alias("_row"), F.col(key).cast("string").alias("_key"), null_key(F.col(source)).alias("_source"), draw(rows, seed, key).alias("_hash"))
    hashed = hashed.withColumn("_range", F.shiftright("_hash", HASH_BITS - bits))
    ranges = _running(hashed.groupBy("_source", "_range").agg(F.count(F.lit(1)).alias("_n")), ["_source"], "_range")
    in_range = Window.partitionBy("_source", "_range").orderBy("_hash", "_key")
    ranked = (
        hashed.withColumn("_place", F.row_number().over(in_range))
        .join(ranges, ["_source", "_range"])
        .withColumn("_fraction", (F.col("_before") + F.col("_place") - offset(seed, F.col("_source"))) / F.col("_total"))
        .select("_row", "_key", "_source", "_hash", "_fraction", F.least(F.floor(F.col("_fraction") * wide), F.lit(wide - 1)).cast("int").alias("_slice"))
    )
    ranked = cut(ranked, "ranked")
    slices = _running(ranked.groupBy("_slice").agg(F.count(F.lit(1)).alias("_n")), [], "_slice").select("_slice", "_before")
    in_slice = Window.partitionBy("_slice").orderBy("_fraction", "_hash", "_source", "_key")
    placed = ranked.withColumn("_place", F.row_number().over(in_slice)).join(slices, "_slice").withColumn("_position", F.col("_before") + F.col("_place") - 1)
    n = F.lit(max(total, 1))
    shard = F.floor(F.col("_position") * shards / n) if total * shards < 1 << 52 else F.expr(f"_position * {shards} div {max(total, 1)}")
    placed = placed.select("_row", "_position", shard.cast("int").alias("shard"))
    first = F.expr(f"(shard * {total}L + {shards - 1}) div {shards}")
    return placed.select("_row.*", "shard", (F.col("_position") - first).alias("slot"))


def row_facts(docs: DataFrame, text: str = "text") -> dict[str, Column]:
    """Size and checksum of a text: UTF-8 bytes plus 8, and CRC-32; a null text has no bytes."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return {"size": (F.octet_length(whole) + 8).cast("long"), "text_crc32": F.crc32(whole.cast("binary"))}


def write_shards(docs: DataFrame, path: str, *, shards: int, **options) -> None:
    """Writes docs as one folder of Parquet files for each shard, rows in slot order within a file."""
    placed = interleave(docs, shards=shards, **options)
    placed.repartition("shard", F.floor(F.col("slot") / 100_000)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op10(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    facts = docs.select("doc_id", "source", *(c.alias(n) for n, c in row_facts(docs).items()))
    placed = interleave(facts, shards=24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
