"""Approximate nearest neighbours by cosine, from low-dimensional stable projections in a kd-tree.

Vectors are scaled to length one, where the largest cosine is the least distance, and projected on `DIMENSIONS` Gaussian
directions.  The squared projected distance over the squared true distance of two vectors follows a chi-square
distribution, so a search takes neighbours in order of their projected distance, verifies each by its true distance,
and stops when the next projected distance is so large that a vector nearer than the k-th found so far would hardly be
projected there: when projected^2 > quantile(`CERTAINTY`) * (k-th distance)^2.

The tree has two levels.  Its top is fitted on at most `SAMPLE` projected vectors and cuts space into cells of about
`CELL` vectors; every vector is put in its cell, and a cell with more than that (which no cut can divide if vectors
hardly differ) becomes several blocks.  A block has a tree of its own with buckets of `BUCKET` vectors.  A query first
searches the blocks of its own cell; the k-th distance found there bounds the cells that can still matter, by the same
test on the distance to a cell's box, and these are searched next.  Only queries travel to several blocks, each block's
queries in chunks of at most `CHUNK`; the top of the tree, one box for `CELL` vectors, is all that every task holds.

Equal vectors are one class with its k + 1 least ids, which are all that a query can need of it, so a vector that a
third of all rows share is searched once.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, nor do those whose
length is not the most common one (the shorter on a tie); rows that agree in id and vector count once; an id with two
vectors is two candidates; ties in score go to the smaller id; an empty table, or one without queries, gives an empty
result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut

DIMENSIONS = 8
CERTAINTY = 0.995
SAMPLE = 20_000
CELL = 4096
BUCKET = 64
CHUNK = 4096
SPARE = 3
SEED = 11
SALTS = 32


def chi_square_quantile(certainty: float, dimensions: int) -> float:
    """By bisection of the distribution function, which has a closed form for an even number of dimensions."""
    if dimensions % 2:
        raise ValueError("an even number of dimensions is needed")

    def below(x: float) -> float:
        return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(dimensions // 2))

    low, high = 0.0, 1.0
    while below(high) < certainty:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < certainty else (low, middle)
    return high


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def cosine(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """In double precision, summed alike for every row."""
    return (many * one).sum(axis=1) / (np.sqrt((one * one).sum()) * np.sqrt((many * many).sum(axis=1)))


def directions(length: int) -> np.ndarray:
    return np.random.default_rng(SEED).normal(size=(length, DIMENSIONS))


def split(points: np.ndarray, most: int) -> list[np.ndarray]:
    """Row numbers in kd-tree order: halves at the median of the widest dimension down to `most` rows."""
    leaves, todo = [], [np.arange(len(points))]
    while todo:
        rows = todo.pop()
        width = np.ptp(points[rows], axis=0) if len(rows) else np.zeros(1)
        if len(rows) <= most or width.max() <= 0:
            leaves.append(rows)
            continue
        order = rows[np.argsort(points[rows, int(width.argmax())], kind="stable")]
        todo += [order[: len(order) // 2], order[len(order) // 2 :]]
    return leaves


class Top:
    """The tree's top: nodes with a dimension and a value, leaves numbered from 0."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.nodes: list[tuple[int, float, int, int]] = []  # dimension, value, left, right; leaves are ~number
        self.leaves = 0
        self.root = self._build(sample, max(0, math.ceil(math.log2(max(1, leaves)))))

    def _build(self, points: np.ndarray, depth: int) -> int:
        width = np.ptp(points, axis=0) if len(points) > 1 else np.zeros(1)
        if not depth or width.max() <= 0:
            self.leaves += 1
            return -self.leaves
        dimension = int(width.argmax())
        value = float(np.median(points[:, dimension]))
        low = points[:, dimension] < value
        at = len(self.nodes)
        self.nodes.append((dimension, value, 0, 0))
        left, right = self._build(points[low], depth - 1), self._build(points[~low], depth - 1)
        self.nodes[at] = (dimension, value, left, right)
        return at

    def leaf(self, points: np.ndarray) -> np.ndarray:
        out = np.empty(len(points), np.int64)
        todo = [(self.root, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = -node - 1
                continue
            dimension, value, left, right = self.nodes[node]
            low = points[rows, dimension] < value
            todo += [(left, rows[low]), (right, rows[~low])]
        return out


def box_distances(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of points to boxes."""
    out = np.zeros((len(points), len(low)))
    for d in range(points.shape[1]):
        gap = np.maximum(np.maximum(low[None, :, d] - points[:, None, d], points[:, None, d] - high[None, :, d]), 0)
        out += gap * gap
    return out


def search(vectors: np.ndarray, points: np.ndarray, keys: np.ndarray, queries: np.ndarray, at: np.ndarray, own: np.ndarray, bound: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query the rows of its k nearest in the block and their cosines, rows with its own key left out.

    bound: the squared distance within which k neighbours are known already.
    """
    quantile = chi_square_quantile(CERTAINTY, DIMENSIONS)
    buckets = split(points, BUCKET)
    low, high = np.array([points[b].min(axis=0) for b in buckets]), np.array([points[b].max(axis=0) for b in buckets])
    units, asked = unit(vectors), unit(queries)
    keep = k + SPARE
    for start in range(0, len(queries), 256):
        rows = np.arange(start, min(start + 256, len(queries)))
        gaps = box_distances(at[rows], low, high)
        order = np.argsort(gaps, axis=1, kind="stable")
        best, which = np.full((len(rows), keep), -np.inf), np.full((len(rows), keep), -1)
        for turn in range(len(buckets)):
            bucket = order[:, turn]
            kth = np.minimum(bound[rows], 2 - 2 * best[:, k - 1])
            # neighbours of the same direction are at no distance, give or take the rounding
            active = np.flatnonzero(gaps[np.arange(len(rows)), bucket] <= quantile * np.maximum(kth, 0) * (1 + 1e-9) + 1e-12)
            if not len(active):
                break
            for b in np.unique(bucket[active]):
                mine, members = active[bucket[active] == b], buckets[b]
                close = asked[rows[mine]] @ units[members].T
                close[keys[members][None, :] == own[rows[mine]][:, None]] = -np.inf
                both = np.concatenate([best[mine], close], axis=1)
                names = np.concatenate([which[mine], np.broadcast_to(members, close.shape)], axis=1)
                top = np.argsort(-both, axis=1, kind="stable")[:, :keep]
                best[mine], which[mine] = np.take_along_axis(both, top, axis=1), np.take_along_axis(names, top, axis=1)
        for i, row in enumerate(rows):
            found = which[i][best[i] > -np.inf]
            score = cosine(queries[row], vectors[found])
            ranked = np.lexsort((keys[found], -score))[:keep]
            yield int(row), found[ranked], score[ranked]


def _grouped(work: Callable[[pd.DataFrame], pd.DataFrame]):
    """Runs work on each run of rows with one `block`; rows come sorted by it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            for block, part in batch.groupby("block", sort=False):
                if held and held[0]["block"].iloc[0] != block:
                    yield work(pd.concat(held))
                    held = []
                held.append(part)
        if held:
            yield work(pd.concat(held))

    return run


def _search_block(k: int):
    def work(group: pd.DataFrame) -> pd.DataFrame:
        data, asked = group[~group["asked"]], group[group["asked"]]
        if not len(data) or not len(asked):
            return pd.DataFrame({"query": [], "key": [], "score": []}).astype({"query": "int64", "key": "int64"})
        stack = lambda column: np.stack(column.to_list()).astype(np.float64)
        keys, own = data["key"].to_numpy(), asked["key"].to_numpy()
        found = [
            (np.full(len(rows), own[i]), keys[rows], score)
            for i, rows, score in search(stack(data["vector"]), stack(data["point"]), keys, stack(asked["vector"]), stack(asked["point"]), own, asked["bound"].to_numpy(), k)
        ]
        return pd.DataFrame({name: np.concatenate([x[i] for x in found]) for i, name in enumerate(("query", "key", "score"))})

    return _grouped(work)


def classes_of(rows: DataFrame, *, key: str, vector: str, k: int) -> DataFrame:
    """Distinct usable vectors: key (the least id), ids (the k + 1 least), vector."""
    rows = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = rows.filter(F.col("id").isNotNull() & F.col("vector").isNotNull() & finite & F.exists("vector", lambda x: x != 0))
    size = usable.groupBy(F.size("vector").alias("n")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "n").first()
    usable = usable.filter(F.size("vector") == (size["n"] if size else 0))
    # the least ids of each vector, first among a few parts of its rows, so that none is gathered in one task
    few = lambda df, *by: df.withColumn("_r", F.dense_rank().over(Window.partitionBy(*by).orderBy("id"))).filter(F.col("_r") <= k + 1).drop("_r")
    some = few(usable.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(SALTS))), "vector", "_salt").drop("_salt")
    ids = F.array_sort(F.collect_set("id"))
    return few(some, "vector").groupBy("vector").agg(ids.alias("ids")).select(F.get("ids", F.lit(0)).alias("key"), "ids", "vector")


def _project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        if len(batch):
            vectors = np.stack(batch["vector"].to_list())
            yield batch.assign(point=list(unit(vectors) @ directions(vectors.shape[1])))


def _place(top: Top):
    def run(points: pd.Series) -> pd.Series:
        return pd.Series(top.leaf(np.stack(points.to_list())) if len(points) else [], dtype="int64")

    return F.pandas_udf(run, "long")


def _reach(low: np.ndarray, high: np.ndarray):
    """The cells, besides its own, in which a query's test does not hold yet."""
    quantile = chi_square_quantile(CERTAINTY, DIMENSIONS)

    def run(points: pd.Series, homes: pd.Series, bounds: pd.Series) -> pd.Series:
        out = []
        for at in range(0, len(points), 256):
            gaps = box_distances(np.stack(points.iloc[at : at + 256].to_list()), low, high)
            near = gaps <= quantile * bounds.iloc[at : at + 256].to_numpy()[:, None] * (1 + 1e-9)
            out += [np.flatnonzero(row & (np.arange(len(low)) != home)).tolist() for row, home in zip(near, homes.iloc[at : at + 256], strict=True)]
        return pd.Series(out, dtype=object)

    return F.pandas_udf(run, "array<long>")


def _visit(data: DataFrame, visits: DataFrame, k: int) -> DataFrame:
    """Searches (cell, key, vector, point, bound) in all blocks of the cell: query, key, score."""
    blocks = data.select("cell", "blocks").distinct()
    met = visits.join(blocks, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    chunks = visits.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    met = met.join(chunks, "cell").withColumn("chunk", F.pmod(F.xxhash64("key"), "chunks"))
    held = data.join(chunks, "cell").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    block = F.xxhash64(F.col("cell").cast("long"), F.col("part").cast("long"), F.col("chunk").cast("long")).alias("block")
    rows = held.select(block, F.lit(False).alias("asked"), "key", "vector", "point", F.lit(0.0).alias("bound")).unionByName(met.select(block, F.lit(True).alias("asked"), "key", "vector", "point", "bound"))
    return rows.repartition("block").sortWithinPartitions("block", "asked").mapInPandas(_search_block(k), "query long, key long, score double")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), "key")
    return found.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k).drop("_r")


def nearest(rows: DataFrame, *, k: int, every: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """For each row whose id is divisible by `every`, its k nearest others: query_id, rank, id, score."""
    classes = classes_of(rows, key=key, vector=vector, k=k)
    classes = cut(classes.mapInPandas(_project, "key long, ids array<long>, vector array<double>, point array<double>"), "classes")
    count = classes.count()
    share = min(1.0, SAMPLE / max(1, count))
    sample = classes.filter(F.pmod(F.xxhash64("key", F.lit(SEED)), F.lit(1 << 30)) <= int(share * (1 << 30))).select("point").limit(2 * SAMPLE).toPandas()
    top = Top(np.stack(sample["point"].to_list()) if len(sample) else np.zeros((0, DIMENSIONS)), -(-count // CELL))
    celled = cut(classes.withColumn("cell", _place(top)(F.col("point"))), "cells")
    ends = [F.array(*[f(F.get("point", F.lit(d))) for d in range(DIMENSIONS)]).alias(name) for f, name in ((F.min, "low"), (F.max, "high"))]
    boxes = cut(celled.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("blocks"), *ends), "boxes")
    data = celled.join(boxes.select("cell", "blocks"), "cell").withColumn("part", F.pmod(F.xxhash64("key"), "blocks").cast("int"))
    asking = rows.select(F.col(key).cast("long").alias("query_id"), F.col(vector).cast("array<double>").alias("vector")).filter(F.col("query_id") % every == 0).distinct()
    asking = cut(asking.join(celled.select("vector", "key"), "vector").select("query_id", "key"), "asking")
    queries = celled.join(asking.select("key").distinct(), "key").select("cell", "key", "vector", "point")
    home = cut(_best(_visit(data, queries.withColumn("bound", F.lit(1e9)), k), k), "home")
    kth = home.groupBy("query").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n")).select(F.col("query").alias("key"), F.when(F.col("n") == k, F.greatest(F.lit(0.0), 2 - 2 * F.col("least"))).otherwise(F.lit(1e9)).alias("bound"))
    known = boxes.orderBy("cell").collect()
    low, high = np.full((top.leaves, DIMENSIONS), np.inf), np.full((top.leaves, DIMENSIONS), np.inf)
    for row in known:
        low[row["cell"]], high[row["cell"]] = row["low"], row["high"]
    bounded = queries.join(kth, "key", "left").withColumn("bound", F.coalesce("bound", F.lit(1e9)))
    onward = bounded.withColumn("cell", F.explode(_reach(low, high)("point", "cell", "bound")))
    found = cut(_best(home.unionByName(_visit(data, onward, k)), k), "found")
    ids = celled.select("key", "ids", "vector")
    others = found.join(ids.select("key", "ids"), "key").select(F.col("query").alias("class"), "ids", "score")
    # the score of an equal vector, by the same sums
    own = queries.join(ids.select("key", "ids"), "key").select(F.col("key").alias("class"), "ids", F.pandas_udf(_self_cosine, "double")("vector").alias("score"))
    near = others.unionByName(own).withColumn("id", F.explode("ids")).select("class", "id", "score")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    paired = asking.select("query_id", F.col("key").alias("class")).join(near, "class").filter("id <> query_id")
    return paired.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(key), "score")


def _self_cosine(vectors: pd.Series) -> pd.Series:
    return pd.Series([float(cosine(v, v[None, :])[0]) for v in vectors], dtype="float64")


def op7(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(rows, k=5, every=50)
