"""How many points lie around each edge, counted exactly without making the pairs.

The plane is cut into square tiles.  Points go to every tile whose edges they may be near, edges to one tile, and a task
reads a tile's points before its edges.  There the points are in small cells, row by row.  What is around an edge is
convex, so in each row the cells wholly inside follow one another and two places in the order of the points give their
number; only the points of the cells on the rim are tested by their exact distance.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.staging import staged
from . import spatial

#: Elements of the arrays in one step of a count, few enough for a core's cache.
BLOCK = 60_000
#: A tile's side in radii; longer edges than the radius, and those this far from the origin, are taken by pairs.
TILE, FAR = 6, 1e12


class Rows:
    """Points in small cells, ordered by row and column."""

    def __init__(self, px: np.ndarray, py: np.ndarray, radius: float):
        self.radius, n = radius, len(px)
        self.x0, self.y0 = (float(px.min()), float(py.min())) if n else (0.0, 0.0)
        w, h = (float(px.max()) - self.x0, float(py.max()) - self.y0) if n else (0.0, 0.0)
        # about half a point in a cell costs least, as rows cost about as much as two points on the rim
        self.cell = min(max(math.sqrt(w * h / 2 / max(n, 1)), max(w, h) / (4 * n + 1000), radius / 1000), radius / 4)
        self.ncols, self.nrows = int(w / self.cell) + 1, int(h / self.cell) + 1
        at = ((py - self.y0) / self.cell).astype(np.int64) * self.ncols + ((px - self.x0) / self.cell).astype(np.int64)
        order = np.argsort(at, kind="stable")
        self.px, self.py = px[order], py[order]
        # the row after the last is empty and stands for all rows that are not there
        self.start = np.searchsorted(at[order], np.arange((self.nrows + 1) * self.ncols + 1)).astype(np.int32 if n < 2**31 else np.int64)

    def count(self, x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray) -> np.ndarray:
        """For each edge the number of points at most the radius away; coordinates are finite."""
        out = np.zeros(len(x1), np.int64)
        if not len(self.px) or not len(x1):
            return out
        r, c = self.radius, self.cell
        # from the lower end to the upper one; of ends equally high, from left to right
        turn = (y1 > y2) | ((y1 == y2) & (x1 > x2))
        xl, yl, xu, yu = np.where(turn, x2, x1), np.where(turn, y2, y1), np.where(turn, x1, x2), np.where(turn, y1, y2)
        largest = max(float(np.abs(v).max()) for v in (xl, yl, xu, yu, self.px, self.py)) + r
        # what the places of the rim may be off by rounding, most at the top and bottom of the circles
        off = max(1e-3 * c, 4 * math.sqrt(r * largest * 2.0**-50))
        first = np.clip(np.floor((yl - r - off - self.y0) / c), 0, self.nrows).astype(np.int64)
        rows = np.clip(np.floor((yu + r + off - self.y0) / c) + 1, 0, self.nrows).astype(np.int64) - first
        along = (xl == xu) | (yl == yu)
        for straight in (True, False):
            order = np.flatnonzero((along == straight) & (rows > 0))
            order = order[np.argsort(rows[order], kind="stable")]
            while len(order):
                take = max(1, BLOCK // int(rows[order[: max(1, BLOCK // int(rows[order[0]]))][-1]]))
                some, order = order[:take], order[take:]
                out[some] = self._count(xl[some], yl[some], xu[some], yu[some], first[some], int(rows[some[-1]]), off, turn[some], straight)
        return out

    def _count(self, xl, yl, xu, yu, first, most, off, turn, straight):
        r, c = self.radius, self.cell
        col = lambda v: v[:, None]
        dx, dy = xu - xl, yu - yl
        length = np.hypot(dx, dy)
        with np.errstate(divide="ignore", invalid="ignore"):
            ux, uy = np.where(length > 0, dx / length, 1.0), np.where(length > 0, dy / length, 0.0)
            slope = np.where(dy > 0, dx / dy, 0.0)
        # nearly level edges: the straight part of the rim is too uncertain, so all points in reach are tested
        vague = np.abs(slope) > 1e4
        off = np.where(vague, 8 * (r + length) + off, off)
        at = first[:, None] + np.arange(most + 1)
        y = self.y0 + at * c
        if straight:  # along an axis: a circle's rim but for a shift, with a level top and bottom
            gap = y - np.minimum(np.maximum(y, col(yl)), col(yu))
            reach = np.sqrt(np.maximum(r * r - gap * gap, 0))
            left, right = col(xl) - reach, col(xu) + reach
            full = np.where(reach > col(off), right, col(xl))
        else:
            low = np.sqrt(np.maximum(r * r - (y - col(yl)) ** 2, 0))
            high = np.sqrt(np.maximum(r * r - (y - col(yu)) ** 2, 0))
            a, b = yl + r * ux, yl - r * ux
            left = np.where(y < col(a), col(xl) - low, np.where(y > col(yu + r * ux), col(xu) - high, col(xl - r * uy - a * slope) + y * col(slope)))
            right = np.where(y < col(b), col(xl) + low, np.where(y > col(yu - r * ux), col(xu) + high, col(xl + r * uy - b * slope) + y * col(slope)))
            full = right
        # inside by columns: from the larger left to the smaller right of a row's two borders; touched: the other way round
        ins = [np.maximum(left[:, :-1], left[:, 1:]), np.minimum(full[:, :-1], full[:, 1:])]
        out = [np.minimum(left[:, :-1], left[:, 1:]), np.maximum(right[:, :-1], right[:, 1:])]
        for edge, end, place in ((out[0], np.minimum(xl, xu) - r, np.where(xl <= xu, yl, yu)), (out[1], np.maximum(xl, xu) + r, np.where(xl <= xu, yu, yl))):
            k = np.floor((place - self.y0) / c).astype(np.int64) - first
            on = np.flatnonzero((k >= 0) & (k < most))
            edge[on, k[on]] = end[on]
        n = self.ncols
        less, more = col((-self.x0 - off) / c), col((-self.x0 + off) / c)
        from_ = np.clip(out[0] * (1 / c) + less, 0, n).astype(np.int32)
        to = np.clip(out[1] * (1 / c) + (more + 1), 0, n).astype(np.int32)
        a = np.clip(ins[0] * (1 / c) + (more + 1), from_, to).astype(np.int32)
        b = np.clip(ins[1] * (1 / c) + less, a, to).astype(np.int32)
        base = np.minimum(at[:, :-1], self.nrows) * n
        s0, s1, s2, s3 = (self.start[base + v] for v in (from_, a, b, to))
        total = (s2 - s1).sum(axis=1, dtype=np.int64)
        begin, many = np.stack([s0, s2], 2).reshape(-1), np.stack([s1 - s0, s3 - s2], 2)
        each = many.sum(axis=(1, 2), dtype=np.int64)
        many = many.reshape(-1)
        begin, many = begin[many > 0], many[many > 0]
        if not len(many):
            return total
        ends = np.cumsum(many)
        p = np.arange(ends[-1]) + np.repeat(begin - (ends - many), many)
        # the formulas of spatial.along() and spatial.distance(), from the edge's own first end
        x1, y1, x2, y2 = np.where(turn, xu, xl), np.where(turn, yu, yl), np.where(turn, xl, xu), np.where(turn, yl, yu)
        ex, ey = np.repeat(x2 - x1, each), np.repeat(y2 - y1, each)
        qx, qy = self.px[p] - np.repeat(x1, each), self.py[p] - np.repeat(y1, each)
        with np.errstate(divide="ignore", invalid="ignore"):
            t = np.maximum(0, np.minimum(1, (qx * ex + qy * ey) / np.repeat((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1), each)))
        if (length == 0).any():
            t[np.repeat(length == 0, each)] = 0
        qx, qy = qx - t * ex, qy - t * ey
        hit = np.concatenate([[0], np.cumsum(np.sqrt(qx * qx + qy * qy) <= r)])
        last = np.cumsum(each)
        return total + hit[last] - hit[last - each]


class Tile:
    """The points of a tile by kind; kinds that a cell around an edge's start holds need no count of their own."""

    def __init__(self, x: np.ndarray, y: np.ndarray, code: np.ndarray, kinds: list, radius: float):
        self.x, self.y, self.code, self.kinds, self.radius = x, y, code, kinds, radius
        self.all, self.each = Rows(x, y, radius), {}
        self.present = np.bincount(code, minlength=len(kinds)) > 0
        self.cell = radius / math.sqrt(2) * (1 - 1e-6)
        place = self._places(x, y)
        self.cells, at = np.unique(place, axis=0, return_inverse=True)
        self.held = np.zeros((len(self.cells) + 1, len(kinds)), bool)
        self.held[at.reshape(-1), code] = True
        self.keys = {tuple(v): i for i, v in enumerate(self.cells.tolist())}

    def _places(self, x, y):
        return np.stack([np.floor((x - self.all.x0) / self.cell), np.floor((y - self.all.y0) / self.cell)], 1).astype(np.int64)

    def counts(self, x1, y1, x2, y2) -> tuple[np.ndarray, np.ndarray]:
        """Points around each edge, and which kinds are among them."""
        n, has = np.zeros(len(x1), np.int64), np.zeros((len(x1), len(self.kinds)), bool)
        if not len(self.x):
            return n, has
        places, at = np.unique(self._places(x1, y1), axis=0, return_inverse=True)
        has = self.held[np.array([self.keys.get(tuple(v), -1) for v in places.tolist()])[at.reshape(-1)]]
        known = has[:, self.present].all(axis=1)
        n[known] = self.all.count(*(v[known] for v in (x1, y1, x2, y2)))
        left = np.flatnonzero(~known)
        for k in np.flatnonzero(self.present) if len(left) else ():
            if k not in self.each:
                self.each[k] = Rows(self.x[self.code == k], self.y[self.code == k], self.radius)
            some = self.each[k].count(*(v[left] for v in (x1, y1, x2, y2)))
            n[left] += some
            has[left, k] = some > 0
        return n, has


def _numbers(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in names]


def _walk(kept: list[str], kinds: Sequence[str], flags: list[str]) -> Callable:
    """Rows in order of tiles, in each the points (_edge false) before the edges, to the edges with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, tile = None, [], None
        for batch in batches:
            r, tx, ty, edge = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_r", "_tx", "_ty", "_edge"))
            cuts = np.flatnonzero((np.diff(r) != 0) | (np.diff(tx) != 0) | (np.diff(ty) != 0) | (np.diff(edge.astype(np.int8)) != 0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if hi == lo:
                    continue
                piece, key = batch.slice(lo, hi - lo), (r[lo], tx[lo], ty[lo])
                if key != now:
                    now, parts, tile = key, [], None
                if not edge[lo]:
                    parts.append(piece.select(["_x1", "_y1", "_kind"]))
                    continue
                if tile is None:
                    points = pa.Table.from_batches(parts) if parts else piece.slice(0, 0)
                    values = pc.unique(points["_kind"]).drop_null()
                    names = values.to_pylist()
                    code = pc.fill_null(pc.index_in(points["_kind"], values), len(names)).to_numpy(zero_copy_only=False).astype(np.int64)
                    tile = Tile(*(points[c].to_numpy().astype(float) for c in ("_x1", "_y1")), code, [*names, None], key[0])
                    parts = []
                ends = _numbers(piece, "_x1", "_y1", "_x2", "_y2")
                fit = np.isfinite(ends).all(axis=0)
                n, has = np.zeros(len(fit), np.int64), np.zeros((len(fit), len(tile.kinds)), bool)
                n[fit], has[fit] = tile.counts(*(v[fit] for v in ends))
                found = [pa.array(has[:, tile.kinds.index(k)] if k in tile.kinds else np.zeros(len(fit), bool)) for k in kinds]
                columns = [piece.column(c) for c in kept] + found + [pa.array(n), pa.array(has[:, :-1].sum(axis=1, dtype=np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, *flags, "poi_count", "poi_category_count"])

    return run


def counts_around(edges: DataFrame, points: DataFrame, key: str, kind: str, kinds: Sequence[str], radius: Column, radii: Sequence[float], keep: Sequence[str] | None = None) -> DataFrame:
    """edges (x1, y1, x2, y2) with `is_<kind>` for each of the kinds, and the numbers of points (px, py) and of their kinds.

    Of the edges' columns those in keep are returned, all by default; each costs, as it goes through the tasks.

    A point counts if it is at most the edge's radius away; the radius is one of radii, all above zero, and with another
    or none, as with coordinates that are null or not finite, an edge has no points.  key names an edge.
    """
    flags, kept = [f"is_{k}" for k in kinds], list(edges.columns if keep is None else keep)
    names = [*flags, "poi_count", "poi_category_count"]
    edges = staged(edges.withColumn("_r", radius.cast("double")).select(*dict.fromkeys([*kept, key, "x1", "y1", "x2", "y2", "_r"])), "edges")
    under = lambda most, *cols: F.expr(" AND ".join(f"{c} IS NOT NULL AND abs({c}) < double('{most}')" for c in cols))
    there = under("Infinity", "x1", "y1", "x2", "y2") & F.coalesce(F.col("_r").isin(*map(float, radii)), F.lit(False))
    tiled = there & under(FAR, "x1", "y1", "x2", "y2") & F.expr("greatest(abs(x2 - x1), abs(y2 - y1)) <= _r")
    place = lambda low: F.when(F.col("_r") > 0, F.floor(low / (TILE * F.col("_r")))).otherwise(F.lit(0))
    asked = edges.filter(~there | tiled).withColumn("_r", F.when(tiled, F.col("_r")).otherwise(F.lit(-1.0)))
    inner = [f"_keep_{i}" for i in range(len(kept))]
    asked = asked.select(
        *[F.col(c).alias(i) for c, i in zip(kept, inner, strict=True)], *[F.col(c).cast("double").alias(f"_{c}") for c in ("x1", "y1", "x2", "y2")],
        "_r", place(F.least("x1", "x2")).alias("_tx"), place(F.least("y1", "y2")).alias("_ty"), F.lit(True).alias("_edge"),
    )
    # a little more than needed on both sides, as the places of tiles are rounded
    span = lambda c: F.explode(F.sequence(F.floor(F.col(c) / (TILE * F.col("_r")) - 2.0001 / TILE), F.floor(F.col(c) / (TILE * F.col("_r")) + 1.0001 / TILE)))
    spots = points.filter(under(2 * FAR, "px", "py")).select(F.col("px").cast("double").alias("_x1"), F.col("py").cast("double").alias("_y1"), F.col(kind).alias("_kind"), F.explode(F.array(*[F.lit(float(r)) for r in radii])).alias("_r"))
    spots = spots.withColumn("_tx", span("_x1")).withColumn("_ty", span("_y1")).withColumn("_edge", F.lit(False))
    tasks = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = spots.unionByName(asked, allowMissingColumns=True).repartition(tasks, "_r", "_tx", "_ty").sortWithinPartitions("_r", "_tx", "_ty", "_edge")
    schema = T.StructType([T.StructField(i, edges.schema[c].dataType) for c, i in zip(kept, inner, strict=True)] + [T.StructField(f, T.BooleanType()) for f in flags] + [T.StructField(c, T.LongType()) for c in names[-2:]])
    out = rows.mapInArrow(_walk(inner, list(kinds), flags), schema).toDF(*kept, *names)
    far = edges.filter(there & ~tiled)
    if far.isEmpty():
        return out
    met = reduce(DataFrame.unionByName, [spatial.pairs_within(far.filter(F.col("_r") == float(r)).select(key, "x1", "y1", "x2", "y2"), points.select(kind, "px", "py"), F.lit(float(r)), float(r)) for r in radii])
    found = met.groupBy(key).agg(*[F.bool_or(F.col(kind) == k).alias(f) for k, f in zip(kinds, flags, strict=True)], F.count(F.lit(1)).alias("poi_count"), F.count_distinct(kind).alias("poi_category_count"))
    rest = far.join(found, key, "left").select(*kept, *[F.coalesce(f, F.lit(False)).alias(f) for f in flags], *[F.coalesce(c, F.lit(0)).alias(c) for c in names[-2:]])
    return out.unionByName(rest)
