"""Pairs of lines of like shape: those that start near each other and have a small discrete Frechet distance.

The plane is cut into square tiles; a line is in the tile of its start and a copy of it in each tile within reach, so a
task finds all partners of a tile's lines.  No pair is closer than its two ends are, which rules most pairs out, and a
walk along both lines that takes the shortest gap at each step proves that bound exact for most others.  What is left
is computed for many pairs at once along the diagonals of the table of gaps.  A task holds a tile's lines in memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Pairs tested at once, and elements of the arrays along a diagonal.
PAIRS, BLOCK = 200_000, 100_000
#: A tile's side as a multiple of the distance between starts.
TILE = 10


class Lines:
    """Lines with points at most `step` apart, one after another: x, y, and where each begins and how many it has."""

    def __init__(self, x: np.ndarray, y: np.ndarray, many: np.ndarray, step: float):
        ends = np.cumsum(many)
        begins = ends - many
        opens = np.zeros(len(x), bool)
        opens[begins] = True
        before = np.where(opens, np.arange(len(x)), np.arange(len(x)) - 1)
        dx, dy = x - x[before], y - y[before]
        n = np.maximum(1, np.ceil(np.hypot(dx, dy) / step)).astype(np.int64)
        last = np.cumsum(n)
        k = np.arange(1, last[-1] + 1 if len(last) else 1) - np.repeat(last - n, n)
        share = k / np.repeat(n, n)
        self.x, self.y = (np.repeat(v[before], n) + np.repeat(d, n) * share for v, d in ((x, dx), (y, dy)))
        self.many = last[ends - 1] - last[begins] + n[begins]
        self.begin = last[begins] - n[begins]

    def at(self, line: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = self.begin[line] + place
        return self.x[p], self.y[p]

    def gaps(self, a, i, b, j) -> np.ndarray:
        (ax, ay), (bx, by) = self.at(a, i), self.at(b, j)
        return np.hypot(ax - bx, ay - by)

    def ends(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The larger of the gaps between the starts and between the ends."""
        return np.maximum(self.gaps(a, 0, b, 0), self.gaps(a, self.many[a] - 1, b, self.many[b] - 1))

    def walked(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Whether a walk that takes the shortest gap at each step meets none above `most`."""
        fine, left = np.ones(len(a), bool), np.arange(len(a))
        p, q = self.begin[a], self.begin[b]
        end_p, end_q, bound = p + self.many[a] - 1, q + self.many[b] - 1, most
        while len(left):
            p2, q2 = np.minimum(p + 1, end_p), np.minimum(q + 1, end_q)
            ax, ay, bx, by = self.x[p], self.y[p], self.x[q], self.y[q]
            cx, cy, dx, dy = self.x[p2], self.y[p2], self.x[q2], self.y[q2]
            both = (cx - dx) ** 2 + (cy - dy) ** 2
            one, two = (cx - bx) ** 2 + (cy - by) ** 2, (ax - dx) ** 2 + (ay - dy) ** 2
            first = (one < both) & (one <= two) & (p < end_p)
            second = ~first & (two < both) & (q < end_q)
            p, q = np.where(second, p, p2), np.where(first, q, q2)
            over = np.hypot(self.x[p] - self.x[q], self.y[p] - self.y[q]) > bound
            fine[left[over]] = False
            on = ~over & ((p < end_p) | (q < end_q))
            if not on.all():
                left, p, q, end_p, end_q, bound = left[on], p[on], q[on], end_p[on], end_q[on], bound[on]
        return fine

    def frechet(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The discrete Frechet distance of each pair."""
        out, longest = np.empty(len(a)), np.maximum(self.many[a], self.many[b])
        order = np.argsort(longest, kind="stable")
        while len(order):
            take = max(1, BLOCK // int(longest[order[: max(1, BLOCK // int(longest[order[0]]))][-1]]))
            some, order = order[:take], order[take:]
            out[some] = self._frechet(a[some], b[some], int(longest[some[-1]]))
        return out

    def _frechet(self, a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
        # a repeated last point changes nothing, so all lines get the longest one's number of points
        places = np.arange(size)[:, None]
        ax, ay = self.at(a, np.minimum(places, self.many[a] - 1))
        bx, by = (v[::-1] for v in self.at(b, np.minimum(places, self.many[b] - 1)))
        # row i + 1 of a diagonal is for the i-th point of a; row 0 and rows outside the table are never the least
        before, last = np.full((size + 1, len(a)), np.inf), np.full((size + 1, len(a)), np.inf)
        for d in range(2 * size - 1):
            lo, hi = max(0, d - size + 1), min(d, size - 1) + 1
            back = size - 1 - d
            gap = np.hypot(ax[lo:hi] - bx[back + lo : back + hi], ay[lo:hi] - by[back + lo : back + hi])
            new = np.full_like(last, np.inf)
            if d == 0:
                new[1] = gap[0]
            else:
                least = np.minimum(np.minimum(last[lo + 1 : hi + 1], last[lo:hi]), before[lo:hi])
                np.maximum(gap, least, out=new[lo + 1 : hi + 1])
            before, last = last, new
        return last[size]


def near_starts(x: np.ndarray, y: np.ndarray, asked: np.ndarray, reach: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of the asked places and all others in the nine cells around them, some at a time."""
    cx, cy = np.floor((x - x.min()) / reach).astype(np.int64) + 1, np.floor((y - y.min()) / reach).astype(np.int64)
    width = int(cx.max()) + 2
    key = cy * width + cx
    order = np.argsort(key, kind="stable")
    key = key[order]
    line = np.tile(asked, 3)
    middle = np.concatenate([(cy[asked] + k) * width + cx[asked] for k in (-1, 0, 1)])
    begin, many = np.searchsorted(key, middle - 1), np.searchsorted(key, middle + 1, "right")
    many = many - begin
    total, done = np.cumsum(many), 0
    while done < len(line):
        upto = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + PAIRS, "right")))
        b, m = begin[done:upto], many[done:upto]
        ends = np.cumsum(m)
        yield np.repeat(line[done:upto], m), order[np.arange(ends[-1]) + np.repeat(b - (ends - m), m)]
        done = upto


def _matched(near: float, most: float, step: float) -> Callable:
    """A tile's lines (_key, _line, _home) to the pairs that begin at one of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        keys, home = table["_key"].combine_chunks(), table["_home"].to_numpy()
        line = table["_line"].combine_chunks()
        line = line.chunk(0) if isinstance(line, pa.ChunkedArray) else line
        x, y = (line.flatten().field(c).to_numpy(zero_copy_only=False).astype(float) for c in ("x", "y"))
        many = line.value_lengths().to_numpy().astype(np.int64)
        lines = Lines(x, y, many, step)
        _, rank = np.unique(keys.to_numpy(zero_copy_only=False), return_inverse=True)
        at = np.cumsum(many) - many
        hx, hy = x[at], y[at]
        for a, b in near_starts(hx, hy, np.flatnonzero(home), near):
            fit = (rank[a] < rank[b]) & (np.sqrt((hx[a] - hx[b]) * (hx[a] - hx[b]) + (hy[a] - hy[b]) * (hy[a] - hy[b])) <= near)
            a, b = a[fit], b[fit]
            value = lines.ends(a, b)
            fit = value <= most
            a, b, value = a[fit], b[fit], value[fit]
            left = np.flatnonzero(~lines.walked(a, b, value))
            value[left] = lines.frechet(a[left], b[left])
            fit = value <= most
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(a[fit])), keys.take(pa.array(b[fit])), pa.array(value[fit])], names=["a", "b", "frechet"])

    return run


def frechet_within(lines: DataFrame, key: str, line: str, near: float, most: float, step: float = 5.0) -> DataFrame:
    """(a, b, frechet): keys a < b of lines whose starts are at most `near` apart and whose shapes differ by at most `most`.

    A line is an array of struct(x, y), taken with points at most `step` apart; lines that are null, have no points or
    have one that is not finite match nothing.
    """
    side = TILE * near
    whole = F.forall(line, lambda p: p["x"].isNotNull() & p["y"].isNotNull() & (F.abs(p["x"]) < float("inf")) & (F.abs(p["y"]) < float("inf")))
    start = lambda c: F.get(line, F.lit(0))[c]
    df = lines.filter((F.size(line) > 0) & whole).select(F.col(key).alias("_key"), F.col(line).alias("_line"), (start("x") / side).alias("_x"), (start("y") / side).alias("_y"))
    # a little more than needed on both sides, as the places of tiles are rounded
    span = lambda c: F.explode(F.sequence(F.floor(F.col(c) - 1.0001 / TILE), F.floor(F.col(c) + 1.0001 / TILE)))
    df = df.withColumn("_tx", span("_x")).withColumn("_ty", span("_y")).withColumn("_home", (F.floor("_x") == F.col("_tx")) & (F.floor("_y") == F.col("_ty"))).drop("_x", "_y")
    kind = lines.schema[key].dataType
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind), T.StructField("frechet", T.DoubleType())])
    tasks = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(tasks, "_tx", "_ty").groupBy("_tx", "_ty").applyInArrow(_matched(near, most, step), schema)
