"""Iterative operators: components, synchronous smoothing to a fixed point, chains, greedy groups.

Loops run in the driver over DataFrames that each round writes to the shared folder; the driver sees counts alone.
Sequential kernels run per group of bounded extent (a chain, a parent, a cell cluster).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import remove_table, staged, written
from . import spatial


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for every node that has an edge to another: the least node that edges lead to.

    In each round every node takes the least name among its neighbours and itself, edges are renamed by that, and edges
    within one name go.  An edge keeps joining the groups at its ends, so when none is left all nodes of a component
    have one name, and that is its least node, which never changes its own.  Rounds grow with the logarithm of the
    longest path; the tables of a round go when the next one is written.
    """
    spark = edges.sparkSession
    one, two = F.col(a), F.col(b)
    left, at = written(edges.filter(one != two).select(F.least(one, two).alias("a"), F.greatest(one, two).alias("b")).distinct(), "edges")
    labels = labels_at = None
    while labels is None or not left.isEmpty():
        both = left.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(left.select(F.col("b").alias("node"), F.col("a").alias("other")))
        names, names_at = written(both.groupBy("node").agg(F.least("node", F.min("other")).alias("name")), "names")
        if labels is None:
            labels, labels_at = names.select("node", F.col("name").alias("label")), names_at
        else:
            old = labels_at
            renamed = labels.join(names.withColumnRenamed("node", "label"), "label", "left").select("node", F.coalesce("name", "label").alias("label"))
            labels, labels_at = written(renamed, "labels")
            remove_table(spark, old)
        old = at
        moved = left.join(names.toDF("a", "na"), "a").join(names.toDF("b", "nb"), "b").filter("na <> nb")
        left, at = written(moved.select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")).distinct(), "edges")
        remove_table(spark, old)
    return labels


def smooth(rows: DataFrame, *, key: str, line: str, place: str, value: str, length: str, most_length: float, excluded: str) -> tuple[DataFrame, int]:
    """Short rows between two higher neighbours take the lesser of those, all at once, until nothing changes.

    A row may change if it is not excluded, is at most most_length long and has neighbours on both sides of its line.
    Returns the rows with `<value>_smoothed` and the number of rounds that changed something.
    """
    now = staged(rows.withColumn(f"{value}_smoothed", F.col(value)))
    order, rounds = Window.partitionBy(line).orderBy(place, key), 0
    while True:
        v = F.col(f"{value}_smoothed")
        before, after = F.lag(v).over(order), F.lead(v).over(order)
        low = F.least(before, after)
        eligible = ~F.col(excluded) & (F.col(length) <= most_length) & before.isNotNull() & after.isNotNull() & (v < low)
        new = staged(now.withColumn("_new", F.when(F.coalesce(eligible, F.lit(False)), low).otherwise(v)))
        changed = new.filter(~F.col("_new").eqNullSafe(F.col(f"{value}_smoothed"))).limit(1).count()
        if not changed:
            return now, rounds
        rounds += 1
        now = new.withColumn(f"{value}_smoothed", F.col("_new")).drop("_new")


def streamed(df: DataFrame, keys: list[str], order: list[str], kernel: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Runs a kernel on each group of keys, rows in the given order, many small groups to a batch.

    Rows are dealt out by key and sorted, so a group is a run of rows; a task holds one batch and one group at a time.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            values = batch[keys].to_numpy()
            edges = [0, *(np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1).tolist(), len(batch)]
            out = []
            for a, b in zip(edges, edges[1:]):
                part = batch.iloc[a:b]
                if held and (held[-1][keys].iloc[-1].to_numpy() != part[keys].iloc[0].to_numpy()).any():
                    out.append(kernel(pd.concat(held) if len(held) > 1 else held[0]))
                    held = []
                held.append(part)
            if out:
                yield pd.concat(out)
        if held:
            yield kernel(pd.concat(held) if len(held) > 1 else held[0])

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def greedy_leaders(points: DataFrame, pairs: DataFrame) -> DataFrame:
    """points with `leader`: in order of (first_seen, id), each ungrouped point claims all ungrouped points it is paired with.

    pairs (a, b) are the ids of points within the radius, in any direction.  A point leads once none of the earlier
    points around it can lead any more, and then all later ones around it cannot; so every round settles many points at
    once, and what remains is the outcome of one walk in order.  In the end a point belongs to the earliest leader
    around it.
    """
    rank = F.struct("first_seen", "id")
    ends = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    one, two = points.select(F.col("id").alias("a"), rank.alias("_ra")), points.select(F.col("id").alias("b"), rank.alias("_rb"))
    # each pair once, from the earlier to the later point
    edges = staged(ends.join(one, "a").join(two, "b").filter("_ra < _rb").select("a", "b", F.col("_ra").alias("rank")), "edges")
    left, leaders = edges, None
    while True:
        new = staged(left.select(F.col("a").alias("id")).distinct().join(left.select(F.col("b").alias("id")).distinct(), "id", "left_anti"), "leaders")
        leaders = new if leaders is None else leaders.unionByName(new)
        if new.isEmpty():
            break
        beaten = staged(left.join(new.withColumnRenamed("id", "a"), "a", "left_semi").select(F.col("b").alias("id")).distinct(), "beaten")
        kept = left.join(new.withColumnRenamed("id", "a"), "a", "left_anti").join(beaten.withColumnRenamed("id", "a"), "a", "left_anti")
        kept = staged(kept.join(beaten.withColumnRenamed("id", "b"), "b", "left_anti").select("a", "b", "rank"), "left")
        # a point all of whose earlier neighbours are beaten, and that has no later ones left, leads as well
        freed = left.select(F.col("b").alias("id")).unionByName(left.select(F.col("a").alias("id"))).distinct()
        for gone in (new, beaten, kept.select(F.col("a").alias("id")), kept.select(F.col("b").alias("id"))):
            freed = freed.join(gone.select("id").distinct(), "id", "left_anti")
        leaders = leaders.unionByName(staged(freed, "leaders"))
        left = kept
    claims = edges.join(leaders.withColumnRenamed("id", "a"), "a", "left_semi").groupBy(F.col("b").alias("id")).agg(F.min_by("a", "rank").alias("leader"))
    return points.join(claims, "id", "left").withColumn("leader", F.coalesce("leader", "id"))


def leaders_within(points: DataFrame, kind: str, radius: float, rows_per_range: int = 100_000, growth: int = 4) -> DataFrame:
    """points (id, px, py, first_seen, kind) with `leader`, as by greedy_leaders() over all pairs of a kind within the radius.

    Points are taken in order, in batches that grow.  Most of a batch is around leaders of earlier ones and makes no
    pairs; the rest is settled by itself.  Leaders are more than a radius apart, so few are around any point, and the
    earliest of those is the one it belongs to.
    """
    order = ("first_seen", "id")
    ranges = max(1, -(-points.count() // rows_per_range))
    points = staged(points.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()), "points")
    around = lambda leaders, some: spatial.points_within(leaders.select(F.col("id").alias("leader"), F.struct(*order).alias("_rank"), F.col(kind).alias("_kind"), F.col("px").alias("ax"), F.col("py").alias("ay")), some, radius).filter(F.col("_kind") == F.col(kind))
    leaders, done, width = None, 0, 1
    while done < ranges:
        batch = points.filter((F.col("_range") >= done) & (F.col("_range") < done + width)).drop("_range")
        if leaders is not None:
            batch = staged(batch.join(around(leaders, batch).select("id").distinct(), "id", "left_anti"), "batch")
        one = batch.select(F.col("id").alias("a"), F.col(kind).alias("_kind"), F.col("px").alias("ax"), F.col("py").alias("ay"))
        two = batch.select(F.col("id").alias("b"), kind, "px", "py")
        pairs = spatial.points_within(one, two, radius).filter((F.col("a") < F.col("b")) & (F.col("_kind") == F.col(kind))).select("a", "b")
        new = staged(greedy_leaders(batch, pairs).filter("leader = id").drop("leader"), "leaders")
        leaders = new if leaders is None else leaders.unionByName(new)
        done, width = done + width, width * growth
    claims = around(leaders, points.select("id", kind, "px", "py")).groupBy("id").agg(F.min_by("leader", "_rank").alias("leader"))
    return points.drop("_range").join(claims, "id", "left").withColumn("leader", F.coalesce("leader", "id"))


def frechet(one: np.ndarray, two: np.ndarray) -> float:
    """Discrete Frechet distance of two vertex lists, by dynamic programming along the rows; many pairs: shapes.Lines."""
    gaps = np.hypot(one[:, None, 0] - two[None, :, 0], one[:, None, 1] - two[None, :, 1])
    row = np.maximum.accumulate(gaps[0])
    for i in range(1, len(one)):
        best = np.minimum(row, np.concatenate([[np.inf], row[:-1]]))
        new = np.empty_like(row)
        reach = np.inf
        for j in range(len(row)):
            reach = max(gaps[i, j], min(best[j], reach))
            new[j] = reach
        row = new
    return float(row[-1])


def midpoint_partition(spans: pd.DataFrame, share: float = 0.5) -> pd.DataFrame:
    """Disjoint ranges from overlapping ones: of a heavy overlap the nearer stays, others meet half way.

    spans: lo, hi, dist and more, of one group, in order of lo and hi.
    """
    lows, highs, dists = spans["lo"].tolist(), spans["hi"].tolist(), spans["dist"].tolist()
    kept: list[int] = []
    for i in range(len(lows)):
        if kept:
            j = kept[-1]
            if min(highs[j], highs[i]) - lows[i] >= share * min(highs[j] - lows[j], highs[i] - lows[i]):
                if dists[i] < dists[j]:
                    kept[-1] = i
                continue
        kept.append(i)
    for j, i in zip(kept, kept[1:]):
        highs[j] = lows[i] = max((highs[j] + lows[i]) / 2, lows[j])
    out = spans.assign(lo=lows, hi=highs).iloc[kept]
    return out[out["hi"] > out["lo"]]


def midpoint_partitions(spans: DataFrame, key: str, order: list[str], share: float = 0.5) -> DataFrame:
    """midpoint_partition() of every group of key, rows in the given order, as one walk over the rows of a task.

    The walk holds two ranges, however large a group is: the last one kept, which a nearer one may still replace, and the
    one before it, which is settled as soon as another follows the last.
    """
    names = spans.columns
    at, lo, hi, dist = (names.index(c) for c in (key, "lo", "hi", "dist"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before = last = None
        low, out = 0.0, []  # low: where the one before begins

        def put(row: tuple, start: float, end: float) -> None:
            if end > start:
                new = list(row)
                new[lo], new[hi] = start, end
                out.append(new)

        for batch in batches:
            for row in zip(*[batch[c].tolist() for c in names], strict=True):
                if last is not None:
                    same = row[at] == last[at]
                    if same and min(last[hi], row[hi]) - row[lo] >= share * min(last[hi] - last[lo], row[hi] - row[lo]):
                        if row[dist] < last[dist]:
                            last = row
                        continue
                    start = last[lo]
                    if before is not None:
                        start = max((before[hi] + start) / 2, low)
                        put(before, low, start)
                    before, low = last, start
                    if not same:
                        put(before, low, before[hi])
                        before = None
                last = row
            if out:
                yield pd.DataFrame(dict(zip(names, zip(*out, strict=True), strict=True)))
                out.clear()
        if last is not None:
            start = last[lo]
            if before is not None:
                start = max((before[hi] + start) / 2, low)
                put(before, low, start)
            put(last, start, last[hi])
        if out:
            yield pd.DataFrame(dict(zip(names, zip(*out, strict=True), strict=True)))

    return spans.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, spans.schema)
