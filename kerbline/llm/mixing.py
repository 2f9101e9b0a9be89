"""Mixing sources to target weights by Poisson replication.

Each source has a mean repetition rate: its share of the wanted rows (or bytes), divided by what it holds.  Each row
draws a uniform number from a seeded hash of its id and inverts the Poisson distribution with its source's rate; it is
repeated that many times, and the copies are put in a global random order by a second hash of id and copy number.  The
draw depends on nothing but seed, id and rate, so a lost task redraws the same numbers.

The inversion compares the draw with the distribution function, which is tabulated once per source.  A rate over
`MOST_MEAN` is split into equal parts whose draws are added: sums of independent Poisson numbers are Poisson, so the
table stays short at any rate and nothing is capped.

Defined results: a null source is a source of its own; a source that the weights do not name has `other_weight`; a
null id hashes as an empty one; repeated rows of one id draw the same number; an empty table stays empty; columns
of the input named like the added ones (`rate`, `copies`, `copy`, `shuffle_key`) are replaced, any other name is free.
Negative weights are an error.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, null_key, salted_hash

#: The largest mean that one table of the distribution serves.
MOST_MEAN = 16.0
#: Terms of that table: with a mean of 16 the rest has a probability under 1e-25.
TERMS = 96
#: A table of rates of at most so many rows is broadcast; a longer one is joined by shuffling.
BROADCAST_SOURCES = 100_000
DRAWS = float(1 << 60)


def source_rates(docs: DataFrame, weights: Mapping[str | None, float] | None, *, other_weight: float = 1.0, epochs: float = 1.0, power: float = 0.0, unit: str = "rows", source: str = "source", text: str = "text") -> DataFrame:
    """One row per source: `_source`, `held`, `weight`, `rate`.

    A source's wanted amount is its weight (times held ** power) over the sum of all, of `epochs` times all that is
    held.  The unit is "rows" or "bytes" of UTF-8 text.
    """
    weights = dict(weights or {})
    if min([other_weight, *weights.values()]) < 0:
        raise ValueError("weights must not be negative")
    amount = F.count(F.lit(1)) if unit == "rows" else F.sum(F.coalesce(F.octet_length(text), F.lit(0)))
    held = docs.groupBy(null_key(F.col(source)).alias("_source")).agg(amount.cast("double").alias("held"))
    weight = F.lit(float(other_weight))
    for name, w in weights.items():
        weight = F.when(F.col("_source") == ("" if name is None else f"={name}"), F.lit(float(w))).otherwise(weight)
    if power:
        weight = weight * F.pow("held", F.lit(float(power)))
    held = cut(held.withColumn("weight", weight), "held")
    all_held, all_weight = held.agg(F.sum("held"), F.sum("weight")).first()
    if not all_weight:
        return held.withColumn("rate", F.lit(0.0))
    rate = F.when(F.col("held") > 0, F.lit(float(epochs * all_held)) * F.col("weight") / F.lit(float(all_weight)) / F.col("held"))
    return held.withColumn("rate", F.coalesce(rate, F.lit(0.0)))


def poisson_table(mean: Column) -> Column:
    """The distribution function at 0, 1, 2, ... as an array."""
    start = F.struct(F.exp(-mean).alias("p"), F.array().cast("array<double>").alias("f"), F.lit(0.0).alias("sum"))

    def step(acc: Column, k: Column) -> Column:
        p = F.when(k == 0, acc["p"]).otherwise(acc["p"] * mean / k)
        total = acc["sum"] + p
        return F.struct(p.alias("p"), F.concat(acc["f"], F.array(total)).alias("f"), total.alias("sum"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(TERMS - 1)), start, step, lambda acc: acc["f"])


def inverted(table: Column, draw: Column) -> Column:
    """The smallest k whose distribution function is over the draw."""
    return F.size(F.filter(table, lambda f: f <= draw))


def uniform(seed: int, *columns: Column) -> Column:
    """A number from 0 up to, not including, 1."""
    return (salted_hash(seed, *columns).cast("double") + 0.5) / F.lit(DRAWS)


def order_key(key: Column, copy: Column, seed: int = 29) -> Column:
    """What the mixture is ordered by: a hash of id and copy number."""
    return salted_hash(seed + 1, key, copy)


def replicate(docs: DataFrame, rates: DataFrame, *, seed: int = 29, source: str = "source", key: str = "doc_id") -> DataFrame:
    """docs with `rate`, `copies`, `copy` (from 0) and `shuffle_key`, one row per copy, not yet in order."""
    docs = docs.drop("rate", "copies", "copy", "shuffle_key")
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / MOST_MEAN)).cast("int")
    tables = rates.select("_source", "rate", parts.alias("_parts")).withColumn("_table", poisson_table(F.col("rate") / F.col("_parts")))
    tables = cut(tables, "tables")
    if tables.count() <= BROADCAST_SOURCES:
        tables = F.broadcast(tables)
    whole = inverted(F.col("_table"), uniform(seed, F.col("_key")))
    pieces = F.aggregate(F.sequence(F.lit(1), F.col("_parts")), F.lit(0), lambda n, i: n + inverted(F.col("_table"), uniform(seed, F.col("_key"), i)))
    # the input's columns travel as one, so their names cannot clash
    drawn = (
        docs.select(F.struct("*").alias("_row"), F.col(key).alias("_key"), null_key(F.col(source)).alias("_source"))
        .join(tables, "_source")
        .select("_row", "_key", "rate", F.when(F.col("_parts") == 1, whole).otherwise(pieces).cast("int").alias("copies"))
        .filter("copies > 0")
    )
    copies = drawn.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    return copies.select("_row.*", "rate", "copies", "copy", order_key(F.col("_key"), F.col("copy"), seed).alias("shuffle_key"))


def mix(docs: DataFrame, weights: Mapping[str | None, float] | None = None, *, seed: int = 29, source: str = "source", key: str = "doc_id", **options) -> DataFrame:
    """docs replicated to the target weights, in a global random order."""
    rates = source_rates(docs, weights, source=source, **options)
    return replicate(docs, rates, seed=seed, source=source, key=key).orderBy("shuffle_key", key, "copy")


def op1(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs, power=0.5).select("doc_id", "text", "lang", "source", "n_chars", "copies", "copy", "shuffle_key")
