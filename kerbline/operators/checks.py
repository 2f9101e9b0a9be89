"""Profiles, reports, coverage checks and sampled verification."""

from __future__ import annotations

import difflib
import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.staging import shared_folder
from . import order


def uncovered(needed: DataFrame, cover: DataFrame, *keys: str) -> DataFrame:
    """The needed keys that a cover lacks."""
    return needed.select(*keys).distinct().join(cover.select(*keys).distinct(), list(keys), "left_anti")


def covered(needed: DataFrame, cover: DataFrame, *keys: str) -> DataFrame:
    """The rows of needed; an error if the cover lacks one of their keys."""
    missing = uncovered(needed, cover, *keys).limit(3).collect()
    if missing:
        raise ValueError(f"not in the cover: {', '.join(str(tuple(r)) for r in missing)}")
    return needed


def medians(df: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """Exact medians by two keys, in long form: row, column, median; a wide table is a pivot of this."""
    return order.quantiles(df, [row, column], value, {"median": 0.5})


def shares(df: DataFrame, by: Sequence[str], **flags: Column) -> DataFrame:
    """The share of true values by group; missing counts as false."""
    return df.groupBy(*by).agg(*[F.avg(F.coalesce(c, F.lit(False)).cast("double")).alias(n) for n, c in flags.items()], F.count(F.lit(1)).alias("n"))


def described(df: DataFrame, value: str, by: str, at: float = 0.25) -> DataFrame:
    """value on both sides of a quantile of another column: side, n, mean, least, most and the share at 0 or 1."""
    cut = order.quantiles(df.select(by), [], by, {"_cut": at}).first()["_cut"]
    side = F.when(F.col(by) < F.lit(cut), "low").otherwise("high")
    v = F.col(value)
    return df.filter(F.col(by).isNotNull()).groupBy(side.alias("side")).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.min(v).alias("least"), F.max(v).alias("most"), F.avg(v.isin(0.0, 1.0).cast("double")).alias("extreme_share")
    )


def extent(df: DataFrame, x: Sequence[str], y: Sequence[str]) -> DataFrame:
    """The box around all coordinates: x_min, y_min, x_max, y_max."""
    every = lambda f, names, g: g(*[f(c) for c in names]) if len(names) > 1 else f(names[0])
    return df.agg(every(F.min, x, F.least).alias("x_min"), every(F.min, y, F.least).alias("y_min"), every(F.max, x, F.greatest).alias("x_max"), every(F.max, y, F.greatest).alias("y_max"))


def narrowed(df: DataFrame) -> DataFrame:
    """df with every long column that fits as an int cast to one; one pass over the data finds which do."""
    longs = [n for n, t in df.dtypes if t == "bigint"]
    if not longs:
        return df
    ends = df.agg(*[f(n).alias(f"{f.__name__}_{n}") for n in longs for f in (F.min, F.max)]).first()
    fits = [n for n in longs if (ends[f"min_{n}"] is None) or (ends[f"min_{n}"] >= -(1 << 31) and ends[f"max_{n}"] < 1 << 31)]
    return df.withColumns({n: F.col(n).cast("int") for n in fits}) if fits else df


def encoded(df: DataFrame, vocabulary: DataFrame, name: str) -> DataFrame:
    """df with `<name>_code`, the place of a value in a shared vocabulary (value, code); -1 where it has none."""
    known = vocabulary.select(F.col("value").alias(name), F.col("code").alias("_code"))
    return df.join(known, name, "left").withColumn(f"{name}_code", F.coalesce("_code", F.lit(-1))).drop("_code")


def basis_report(df: DataFrame, by: str, length: str) -> DataFrame:
    """Rows and kilometres by basis, missing ones named, with their shares: the rows of a report."""
    total = df.agg(F.sum(F.col(length).cast("double")).alias("_all"))
    found = df.groupBy(F.coalesce(by, F.lit("none")).alias(by)).agg(F.count(F.lit(1)).alias("n"), (F.sum(F.col(length).cast("double")) / 1000).alias("km"))
    return found.join(F.broadcast(total)).select(by, "n", "km", (F.col("km") * 1000 / F.col("_all")).alias("share"))  # the broadcast side is one row


def write_report(report: DataFrame, path: str, *, most: int = 10_000) -> None:
    """A report as one JSON document at a local path; one of more than `most` rows is no report and an error."""
    rows = report.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report has at most {most} rows")
    with open(path, "w", encoding="utf-8") as out:
        json.dump([r.asDict(recursive=True) for r in rows], out, indent=1, default=str)


def migrated(df: DataFrame, folder: str, *, share: float = 0.05, seed: int = 42) -> DataFrame:
    """Rewrites JSON lines as Parquet and compares a sample of rows both ways: n_rows, n_compared, n_differ.

    The sample is drawn by a hash of the rows' contents, so both sides draw the same rows.
    """
    spark, root = df.sparkSession, f"{shared_folder(df.sparkSession)}/{folder}"
    df.write.mode("overwrite").json(f"{root}/json")
    old = spark.read.schema(df.schema).json(f"{root}/json")
    old.write.mode("overwrite").parquet(f"{root}/parquet")
    new = spark.read.schema(df.schema).parquet(f"{root}/parquet")
    drawn = F.pmod(F.xxhash64(F.lit(seed), *df.columns), F.lit(1_000_000)) < F.lit(int(share * 1_000_000))
    one, two = old.filter(drawn), new.filter(drawn)
    differ = one.exceptAll(two).unionByName(two.exceptAll(one)).agg(F.count(F.lit(1)).alias("n_differ"))
    counts = new.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(drawn).alias("n_compared"))
    return counts.join(F.broadcast(differ))  # one row each


def similarity(one: Column, others: Column) -> Column:
    """The greatest share of matching characters (sequence matching) between a name and any of several; null without either."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for names, lists in batches:
            yield pd.Series([max((difflib.SequenceMatcher(None, a, b).ratio() for b in bs), default=None) if a and bs is not None and len(bs) else None for a, bs in zip(names, lists, strict=True)], dtype="float64")

    return F.pandas_udf(run, "double")(one, others)
