"""Edges cut by zones, circles around points, without making all pairs.

The plane is cut into square tiles.  Points go to every tile whose edges they may be near, edges to one tile, and a task
reads a tile's points before its edges.  Where points are dense, a few of those near an edge's middle mostly prove that
the zone has the share from which it takes the edge whole; the other points cannot lower that share.  All points in
reach are taken for every edge that this leaves open, so the pieces are exact.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Elements of the arrays in one step, few enough for a core's cache, and points tried to prove that an edge is whole.
BLOCK, TRIED = 60_000, 4
#: A tile's side in radii or longest edges, and how large a coordinate may be.
TILE, FAR = 4, 1e12
#: What the proof must have beyond the share: more than rounding can take from the spans of a few points.
SURE = 1e-6


class Circles:
    """The circles around a tile's points."""

    def __init__(self, px: np.ndarray, py: np.ndarray, radius: float):
        # points in the same place make the same circle
        self.radius, at = radius, np.unique(px + 1j * py)
        self.x0, self.y0 = (at.real.min(), at.imag.min()) if len(at) else (0.0, 0.0)
        col, row = self._cells(at.real, at.imag, radius)
        self.ncols, self.nrows = (int(col.max()) + 1, int(row.max()) + 1) if len(at) else (0, 0)
        order = np.argsort(row * self.ncols + col, kind="stable")
        self.px, self.py = at.real[order], at.imag[order]
        self.start = np.searchsorted((row * self.ncols + col)[order], np.arange(self.nrows * self.ncols + 1))
        # for the proof one point of each small cell is enough
        col, row = self._cells(self.px, self.py, radius / 8)
        self.some = np.unique(row * (col.max(initial=0) + 1) + col, return_index=True)[1]

    def _cells(self, x, y, side):
        return np.floor((x - self.x0) / side).astype(np.int64), np.floor((y - self.y0) / side).astype(np.int64)

    def _spans(self, p, x1, y1, x2, y2):
        """Where the circle around each point p begins and ends on each edge, and whether it is on it, as in spatial.circle_spans()."""
        dx, dy, qx, qy = x2 - x1, y2 - y1, self.px[p] - x1, self.py[p] - y1
        length2 = dx * dx + dy * dy
        b = (qx * dx + qy * dy) / length2
        h2 = b * b - (qx * qx + qy * qy - self.radius * self.radius) / length2
        half = np.sqrt(np.maximum(h2, 0))
        lo, hi = np.maximum(0.0, b - half), np.minimum(1.0, b + half)
        return lo, hi, (h2 > 0) & (hi > lo)

    def proved(self, x1, y1, x2, y2, share: float) -> np.ndarray:
        """Edges of which a few of the circles cover the share for sure; not all such edges are found."""
        out = np.zeros(len(x1), bool)
        # with less than a point in a cell few edges can be proved
        if len(self.px) < self.nrows * self.ncols or not len(self.some) or not len(x1):
            return out
        # the nearest points are looked for once in each cell around the middles of edges
        side, (sx, sy) = self.radius / 3, (self.px[self.some], self.py[self.some])
        col, row = self._cells((x1 + x2) / 2, (y1 + y2) / 2, side)
        wide = int(col.max() - col.min()) + 1
        place = (row - row.min()) * wide + (col - col.min())
        order = np.argsort(place, kind="stable")
        begin = np.flatnonzero(np.diff(place[order], prepend=-1))
        step = max(1, 8 * BLOCK // len(sx))
        for i in range(0, len(begin), step):
            first, end = begin[i : i + step], begin[i + step] if i + step < len(begin) else len(order)
            left, of = order[first[0] : end], np.repeat(np.arange(len(first)), np.diff([*first, end]))
            at = order[first]
            gap = (sx - ((col[at] + 0.5) * side + self.x0)[:, None]) ** 2 + (sy - ((row[at] + 0.5) * side + self.y0)[:, None]) ** 2
            # what is covered at the start and at the end of the edges
            head, tail = np.zeros(len(left)), np.ones(len(left))
            for _ in range(min(TRIED, len(sx))):
                cells, of = np.unique(of, return_inverse=True)
                gap = gap[cells]
                best = gap.argmin(axis=1)
                gap[np.arange(len(gap)), best] = np.inf
                lo, hi, on = self._spans(self.some[best[of]], x1[left], y1[left], x2[left], y2[left])
                head = np.where(on & (lo <= head), np.maximum(head, hi), head)
                tail = np.where(on & (hi >= tail), np.minimum(tail, lo), tail)
                enough = (np.where(on, hi - lo, 0) >= share + SURE) | (head + (1 - tail) >= share + SURE)
                out[left[enough]] = True
                left, of, head, tail = left[~enough], of[~enough], head[~enough], tail[~enough]
                if not len(left):
                    break
        return out

    def met(self, x1, y1, x2, y2) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """In batches of whole edges: the numbers of edges, and where a circle begins and ends on them."""
        r = self.radius
        if not len(self.px) or not len(x1):
            return
        wide = r * (1 + 1e-6)
        c1, r1 = self._cells(np.minimum(x1, x2) - wide, np.minimum(y1, y2) - wide, r)
        c2, r2 = self._cells(np.maximum(x1, x2) + wide, np.maximum(y1, y2) + wide, r)
        c1, c2 = np.clip(c1, 0, self.ncols), np.clip(c2 + 1, 0, self.ncols)
        r1, r2 = np.clip(r1, 0, self.nrows), np.clip(r2 + 1, 0, self.nrows)
        rows = np.where(c2 > c1, np.maximum(r2 - r1, 0), 0)
        e = np.repeat(np.arange(len(x1)), rows)
        row = np.arange(len(e)) - np.repeat(np.cumsum(rows) - rows, rows) + r1[e]
        begin = self.start[row * self.ncols + c1[e]]
        many = self.start[row * self.ncols + c2[e]] - begin
        total = np.concatenate([[0], np.cumsum(many)])
        first = np.concatenate([[0], np.cumsum(rows)])
        each = total[first[1:]]
        i = 0
        while i < len(x1):
            j = max(i + 1, int(np.searchsorted(each, (each[i - 1] if i else 0) + BLOCK, side="right")))
            a, b = first[i], first[j]
            n = many[a:b]
            p = np.arange(total[b] - total[a]) + np.repeat(begin[a:b] - (total[a:b] - total[a]), n)
            q = np.repeat(e[a:b], n)
            i = j
            ex1, ey1, ex2, ey2 = x1[q], y1[q], x2[q], y2[q]
            lo, hi, on = self._spans(p, ex1, ey1, ex2, ey2)
            # the formulas of spatial.along() and spatial.distance() decide what is near
            dx, dy, qx, qy = ex2 - ex1, ey2 - ey1, self.px[p] - ex1, self.py[p] - ey1
            t = np.maximum(0.0, np.minimum(1.0, (qx * dx + qy * dy) / (dx * dx + dy * dy)))
            gx, gy = qx - t * dx, qy - t * dy
            on &= np.sqrt(gx * gx + gy * gy) <= r
            yield q[on], lo[on], hi[on]

    def pieces(self, x1, y1, x2, y2, share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The number of its edge, beginning, end and whether it is in the zone, for each piece of the edges that the zone touches; in order."""
        whole = self.proved(x1, y1, x2, y2, share)
        left = np.flatnonzero(~whole)
        sure = np.flatnonzero(whole)
        found = [(sure, np.zeros(len(sure)), np.ones(len(sure)), np.ones(len(sure), bool))]
        for e, lo, hi in self.met(*(v[left] for v in (x1, y1, x2, y2))):
            if len(e):
                n, *rest = _cut(*merged(e, lo, hi), share)
                found.append((left[n], *rest))
        e, lo, hi, inside = (np.concatenate(v) for v in zip(*found, strict=True))
        order = np.lexsort((lo, e))
        return e[order], lo[order], hi[order], inside[order]


def merged(e: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of the overlapping intervals of each e, in order; there is one at least."""
    order = np.lexsort((hi, lo, e))
    e, lo, hi = e[order], lo[order], hi[order]
    first = np.concatenate([[True], e[1:] != e[:-1]])
    # the largest end so far of each e, by the places of the ends in their order
    ends, place = np.unique(hi, return_inverse=True)
    upto = ends[np.maximum.accumulate((np.cumsum(first) - 1) * len(ends) + place.reshape(-1)) % len(ends)]
    new = np.flatnonzero(first | np.concatenate([[True], lo[1:] > upto[:-1]]))
    return e[new], lo[new], upto[np.concatenate([new[1:] - 1, [len(e) - 1]])]


def _cut(e, lo, hi, share):
    """Whole edges and pieces in and out of the zone from the merged intervals of edges; unordered."""
    first = np.concatenate([[True], e[1:] != e[:-1]])
    at = np.flatnonzero(first)
    last = np.concatenate([at[1:] - 1, [len(e) - 1]])
    total = np.add.reduceat(hi - lo, at)
    enough = total >= share
    cut = np.repeat(~enough, last - at + 1)
    before = np.where(first, 0.0, np.concatenate([[0.0], hi[:-1]]))
    gap, tail = cut & (lo > before), last[~enough & (hi[last] < 1)]
    one = e[at[enough]]
    return (
        np.concatenate([one, e[cut], e[gap], e[tail]]), np.concatenate([np.zeros(len(one)), lo[cut], before[gap], hi[tail]]),
        np.concatenate([np.ones(len(one)), hi[cut], lo[gap], np.ones(len(tail))]), np.repeat([True, False], [len(one) + cut.sum(), gap.sum() + len(tail)]),
    )


def _walk(radius: float, longest: float, share: float, schema: pa.Schema) -> Callable:
    """Rows in order of tiles, in each the points (_edge false) before the edges, to the pieces of the edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, circles, seen = None, [], None, set()
        for batch in batches:
            tx, ty, edge = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_tx", "_ty", "_edge"))
            cuts = np.flatnonzero((np.diff(tx) != 0) | (np.diff(ty) != 0) | (np.diff(edge.astype(np.int8)) != 0)) + 1
            found = []
            for begin, end in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if end == begin:
                    continue
                piece, tile = batch.slice(begin, end - begin), (tx[begin], ty[begin])
                if tile != now:
                    now, parts, circles, seen = tile, [], None, set()
                ends = [piece.column(c).to_numpy(zero_copy_only=False) for c in ("_x1", "_y1", "_x2", "_y2")]
                if not edge[begin]:
                    parts.append(ends[:2])
                    continue
                if circles is None:
                    circles, parts = Circles(*(np.concatenate(v) for v in zip(*parts, strict=True)), radius) if parts else Circles(np.zeros(0), np.zeros(0), radius), []
                if not len(circles.px):
                    continue
                if max(np.abs(ends[2] - ends[0]).max(), np.abs(ends[3] - ends[1]).max()) > longest:
                    raise ValueError(f"an edge is longer than {longest} along an axis")
                keys = piece.column("_key").to_pylist()
                once = None
                if len(set(keys)) < len(keys) or not seen.isdisjoint(keys):
                    once = [i for i, k in enumerate(keys) if not (k in seen or seen.add(k))]
                seen.update(keys)
                use = np.flatnonzero((ends[0] != ends[2]) | (ends[1] != ends[3])) if once is None else np.array([i for i in once if ends[0][i] != ends[2][i] or ends[1][i] != ends[3][i]], np.int64)
                e, lo, hi, inside = circles.pieces(*(v[use] for v in ends), share)
                if len(e):
                    first = np.flatnonzero(np.concatenate([[True], e[1:] != e[:-1]]))
                    number = np.arange(len(e)) - np.repeat(first, np.diff([*first, len(e)])) + 1
                    found.append(pa.RecordBatch.from_arrays([piece.column("_key").take(pa.array(use[e])), pa.array(number.astype(np.int32)), pa.array(lo), pa.array(hi), pa.array(inside)], schema=schema))
            yield from pa.Table.from_batches(found, schema).combine_chunks().to_batches() if found else ()

    return run


def zone_pieces(edges: DataFrame, points: DataFrame, key: str, radius: float, longest: float, share: float) -> DataFrame:
    """key, number, lo, hi, in_zone: the pieces of the edges (x1, y1, x2, y2) that circles around the points (px, py) touch.

    Circles that cover the share of an edge, or more, take it whole; else it is cut where they begin and end.  Pieces are
    numbered along the edge from 1, lo and hi are places on it from 0 to 1.  key, a string, names an edge: rows with the
    same key have the same ends and count once.  Edges without a length and null or not finite coordinates have no part.
    No edge near a point may be longer than `longest` along an axis, and no coordinate 1e12 or more: both are errors.
    """
    side = TILE * max(radius, longest)
    there = lambda *cols: F.expr(" AND ".join(f"{c} IS NOT NULL AND abs({c}) < double('Infinity')" for c in cols))
    size = lambda *cols: F.greatest(*[F.abs(F.col(c)) for c in cols])
    held = lambda c, *cols: F.when(size(*cols) < FAR, c).otherwise(F.raise_error(F.lit("a coordinate is 1e12 or more")))
    ends = ("x1", "y1", "x2", "y2")
    asked = edges.filter(there(*ends)).select(
        F.col(key).alias("_key"), *[F.col(c).cast("double").alias(f"_{c}") for c in ends],
        F.floor(held(F.least("x1", "x2"), *ends) / side).alias("_tx"), F.floor(F.least("y1", "y2") / side).alias("_ty"), F.lit(True).alias("_edge"),
    )
    # a little more than needed on both sides, as the places of tiles are rounded
    off = 1.0001 * radius + 1e-3 * side
    span = lambda c: F.explode(F.sequence(F.floor((c - longest - off) / side), F.floor((c + off) / side)))
    spots = points.filter(there("px", "py")).select(F.col("px").cast("double").alias("_x1"), F.col("py").cast("double").alias("_y1"))
    spots = spots.withColumn("_tx", span(held(F.col("_x1"), "_x1", "_y1"))).withColumn("_ty", span(F.col("_y1"))).withColumn("_edge", F.lit(False))
    tasks = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = spots.unionByName(asked, allowMissingColumns=True).repartition(tasks, "_tx", "_ty").sortWithinPartitions("_tx", "_ty", "_edge")
    schema = T.StructType([T.StructField("_key", T.StringType()), T.StructField("number", T.IntegerType()), T.StructField("lo", T.DoubleType()), T.StructField("hi", T.DoubleType()), T.StructField("in_zone", T.BooleanType())])
    arrow = pa.schema([("_key", pa.string()), ("number", pa.int32()), ("lo", pa.float64()), ("hi", pa.float64()), ("in_zone", pa.bool_())])
    return rows.mapInArrow(_walk(radius, longest, share, arrow), schema).withColumnRenamed("_key", key)
