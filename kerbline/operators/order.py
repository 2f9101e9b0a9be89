"""Order statistics within cells, without gathering a cell in one task.

A window over a few large cells (four, say, for country and land use) would put each of them in a single task.  Here
rows are first dealt out to ranges of the whole order, ties and all, so neither a large cell nor a frequent value makes
a large range; windows run within a range, and a small table of the ranges' sums supplies what lies before it.  The
number of ranges grows with the rows.  Results are exact: only where the ranges begin depends on a sample.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged

ROWS_PER_RANGE = 100_000


def running(df: DataFrame, cells: Sequence[str], order: Sequence[Column], value: str, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """df with `_before`, the sum of value over the rows before in its cell, and `_total`, that over the cell.

    order is the whole order of rows in a cell.  Rows need non-null cells.
    """
    df = staged(df)
    ranges = -(-df.count() // rows_per_range)
    if ranges > 1:
        df = staged(df.repartitionByRange(ranges, *[F.col(c) for c in cells], *order).withColumn("_range", F.spark_partition_id()))
    else:
        df = df.withColumn("_range", F.lit(0))
    keys = [*cells, "_range"]
    whole = Window.partitionBy(*cells)
    earlier = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*keys).agg(F.sum(value).alias("_sum"))
    sums = sums.select(*keys, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"), F.sum("_sum").over(whole).alias("_total"))
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = df.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(sums, keys)
    return out.withColumn("_before", F.col("_offset") + F.col("_inside")).drop("_range", "_offset", "_inside")


def distribution(df: DataFrame, cells: Sequence[str], value: str) -> DataFrame:
    """Per cell and distinct non-null value: how often it occurs (n), how many are less (_before), how many there are (_total)."""
    present = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in [*cells, value]))
    counted = df.filter(present).groupBy(*cells, value).agg(F.count(F.lit(1)).alias("n"))
    return running(counted, cells, [F.col(value)], "n")


def percent_ranks(df: DataFrame, cells: Sequence[str], values: Sequence[str]) -> DataFrame:
    """df with the average rank of each value over the count of its cell, as `_rank_` and the value's name; null stays null.

    Ranks are found once per distinct value; where there are few of these, Spark broadcasts them and moves no rows.
    """
    pairs = F.array(*[F.struct(F.lit(v).alias("of"), F.col(v).cast("double").alias("value")) for v in values])
    long = df.select(*cells, F.explode(pairs).alias("_v")).select(*cells, "_v.of", "_v.value")
    ranks = staged(distribution(long, [*cells, "of"], "value").select(*cells, "of", "value", ((F.col("_before") + (F.col("n") + 1) / 2) / F.col("_total")).alias("_rank")))
    for v in values:
        own = ranks.filter(F.col("of") == v).select(*cells, F.col("value").alias("_value"), F.col("_rank").alias(f"_rank_{v}"))
        df = df.withColumn("_value", F.col(v).cast("double")).join(own, [*cells, "_value"], "left").drop("_value")
    return df


def quantiles(df: DataFrame, cells: Sequence[str], value: str, at: dict[str, float]) -> DataFrame:
    """Per cell, exact quantiles with linear interpolation, one column for each name; nulls are left out."""
    spread = distribution(df, cells, value)
    columns = []
    for name, q in at.items():
        place = (F.col("_total") - 1) * F.lit(float(q))
        holds = lambda i: F.max(F.when((F.col("_before") <= i) & (i < F.col("_before") + F.col("n")), F.col(value)))
        columns += [holds(F.floor(place)).alias(f"{name}_low"), holds(F.ceil(place)).alias(f"{name}_high"), F.max(place - F.floor(place)).alias(f"{name}_part")]
    found = spread.groupBy(*cells).agg(*columns)
    lerp = [(F.col(f"{n}_low") + (F.col(f"{n}_high") - F.col(f"{n}_low")) * F.col(f"{n}_part")).alias(n) for n in at]
    return found.select(*cells, *lerp)


def sums_reaching(df: DataFrame, key: str, value: str, place: Sequence[str], least: float, **others: Column) -> DataFrame:
    """For each key whether the sum of its doubles is at least `least`, as `reached`, and other aggregates by name.

    Doubles are added one by one in the order of place, which should have no ties, so the tasks that read them do not
    matter.  Only keys whose sum is within rounding of `least` are put in order: in any other order the sum of n numbers
    is off by at most about n * 2^-52 of the sum of their sizes.  A sum without numbers is null; rows without a key do not count.
    """
    total = F.sum(value)
    near = (F.abs(total - least) <= F.count(value) * F.sum(F.abs(value)) * 2.0**-51) | F.isnan(total)
    known = df.filter(F.col(key).isNotNull()).groupBy(key).agg((total >= least).alias("reached"), F.coalesce(near, F.lit(False)).alias("_near"), *[c.alias(n) for n, c in others.items()])
    known = staged(known, "sums")
    whole = Window.partitionBy(key).orderBy(*place).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    open_ = known.filter("_near").drop("reached", "_near")
    rows = df.select(key, value, *place).join(open_.select(key), key, "left_semi").withColumn("_sum", F.sum(value).over(whole))
    exact = rows.groupBy(key).agg((F.first("_sum") >= least).alias("reached"))
    return known.filter("NOT _near").drop("_near").unionByName(open_.join(exact, key))
