"""A network of edges: ends and directions, who touches and continues whom, short humps lowered and joined, rings unwrapped.

Edges have an id and both ends (x1, y1, x2, y2) in metres.  All meetings are distance joins; loops run over staged
tables and the driver sees counts alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged
from . import iterate, spatial

#: Edges are joined in cells of about their length.
CELL = 60.0


def ends(edges: DataFrame, key: str) -> DataFrame:
    """Both ends of each edge: key, end (0 start, 1 end), px, py, and the unit vector (dx, dy) from there into the edge."""
    length = F.sqrt(F.pow(F.col("x2") - F.col("x1"), 2) + F.pow(F.col("y2") - F.col("y1"), 2))
    dx, dy = F.try_divide(F.col("x2") - F.col("x1"), length), F.try_divide(F.col("y2") - F.col("y1"), length)
    one = edges.select(key, F.coalesce(dx, F.lit(0.0)).alias("_dx"), F.coalesce(dy, F.lit(0.0)).alias("_dy"), "x1", "y1", "x2", "y2")
    start = F.struct(F.lit(0).alias("end"), F.col("x1").alias("px"), F.col("y1").alias("py"), F.col("_dx").alias("dx"), F.col("_dy").alias("dy"))
    stop = F.struct(F.lit(1).alias("end"), F.col("x2").alias("px"), F.col("y2").alias("py"), (-F.col("_dx")).alias("dx"), (-F.col("_dy")).alias("dy"))
    return one.select(key, F.explode(F.array(start, stop)).alias("_e")).select(key, "_e.*")


def touching(edges: DataFrame, key: str, tolerance: float = 1.0) -> DataFrame:
    """(key, end, other): every other edge within the tolerance of an end."""
    points = ends(edges, key).select(F.col(key).alias("_own"), "end", "px", "py")
    met = spatial.pairs_within(edges.select(key, "x1", "y1", "x2", "y2"), points, F.lit(tolerance), CELL)
    return met.filter(F.col(key) != F.col("_own")).select(F.col("_own").alias(key), "end", F.col(key).alias("other"))


def continuing(edges: DataFrame, key: str, tolerance: float = 1.0, among: DataFrame | None = None) -> DataFrame:
    """(key, end, other, other_end, turn): ends of other edges (of `among`, if given) within the tolerance, with the angle (0: straight on)."""
    found, others = ends(edges, key), ends(edges if among is None else among, key)
    one = found.select(key, "end", F.col("px").alias("ax"), F.col("py").alias("ay"), F.col("dx").alias("_ux"), F.col("dy").alias("_uy"))
    two = others.select(F.col(key).alias("other"), F.col("end").alias("other_end"), "px", "py", "dx", "dy")
    met = spatial.points_within(one, two, tolerance).filter(F.col(key) != F.col("other"))
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), -(F.col("_ux") * F.col("dx") + F.col("_uy") * F.col("dy"))))
    return met.select(key, "end", "other", "other_end", F.acos(cosine).alias("turn"))


def possible_humps(edges: DataFrame, key: str, value: str, eligible: Column, tolerance: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """touching() and along(continuing()) of the eligible edges that lower_humps() can ever lower.

    Values never rise.  An edge of the least value of all has none below it, and one that touches an edge of no lower
    value which itself never moves stays for good; neither needs its neighbours.
    """
    least = edges.agg(F.min(value)).first()[0]
    shape = [key, "x1", "y1", "x2", "y2"]
    can = F.coalesce(eligible & (F.col(value) > F.lit(least)), F.lit(False))
    asked = ends(edges.filter(can), key).select(key, "px", "py").join(edges.filter(can).select(key, F.col(value).alias("_v")), key)
    fixed = edges.filter(~can & (F.col(value) > F.lit(least))).select("x1", "y1", "x2", "y2", F.col(value).alias("_w"))
    held = spatial.pairs_within(fixed, asked, F.lit(tolerance), 2 * CELL).filter("_w >= _v").select(key).distinct()
    movable = staged(edges.filter(can).select(*shape).join(held, key, "left_anti"), "movable")
    points = ends(movable, key).select(F.col(key).alias("_own"), "end", "px", "py")
    # a hair wider, as ends within the tolerance must be among these whatever the rounding of the distance
    near = staged(spatial.pairs_within(edges.select(*shape), points, F.lit(tolerance * (1 + 1e-6)), 2 * CELL).filter(F.col(key) != F.col("_own")), "near")
    touched = near.filter(F.col("dist") <= tolerance).select(F.col("_own").alias(key), "end", F.col(key).alias("other"))
    return touched, along(continuing(movable, key, tolerance, near.select(*shape).distinct()), key)


def along(continued: DataFrame, key: str) -> DataFrame:
    """(key, before, after): what turns least from each of the two ends, for edges that continue at both."""
    best = continued.groupBy(key, "end").agg(F.min_by("other", F.struct(F.round("turn", 9), F.col("other"))).alias("_o"))
    both = best.groupBy(key).agg(F.max(F.when(F.col("end") == 0, F.col("_o"))).alias("before"), F.max(F.when(F.col("end") == 1, F.col("_o"))).alias("after"))
    return both.filter("before IS NOT NULL AND after IS NOT NULL")


def lower_humps(rows: DataFrame, touched: DataFrame, neighbours: DataFrame, *, key: str, value: str, eligible: Column) -> tuple[DataFrame, int]:
    """An eligible edge over all that touch it takes the greater value of its two neighbours along the road, all at once, until none is left.

    Returns rows with `<value>_lowered`, `is_hump` and `source` (whose value it took last), and the rounds that changed something.
    """
    pairs = staged(touched.select(key, "other").distinct(), "touching")
    sides = staged(rows.filter(eligible).select(key).join(neighbours, key), "along")
    now = staged(rows.select(key, F.col(value).cast("double").alias("_v"), F.lit(None).cast(rows.schema[key].dataType).alias("source")), "values")
    rounds = 0
    while True:
        values = now.select(F.col(key).alias("other"), F.col("_v").alias("_w"))
        highest = pairs.join(sides.select(key), key, "left_semi").join(values, "other").groupBy(key).agg(F.max("_w").alias("_most"))
        side = lambda name: now.select(F.col(key).alias(name), F.col("_v").alias(f"_{name}"))
        high = sides.join(highest, key).join(now.select(key, "_v"), key).filter("_most < _v").join(side("before"), "before").join(side("after"), "after")
        first = F.col("_before") >= F.col("_after")
        moves = staged(high.select(key, F.greatest("_before", "_after").alias("_new"), F.when(first, F.col("before")).otherwise(F.col("after")).alias("_from")), "moves")
        if moves.isEmpty():
            break
        rounds += 1
        now = staged(now.join(moves, key, "left").select(key, F.coalesce("_new", "_v").alias("_v"), F.coalesce("_from", "source").alias("source")), "values")
    return rows.join(now.select(key, F.col("_v").alias(f"{value}_lowered"), "source", F.col("source").isNotNull().alias("is_hump")), key), rounds


def join_humps(lowered: DataFrame, neighbours: DataFrame, *, key: str, parent: str, value: str, length: str) -> DataFrame:
    """Humps and the neighbours along the road that share value and parent become one row each.

    The longest row that is no hump gives the id (the parent's own, if no other row of that parent is left), lengths add
    up; returns key, parent, value, length, is_hump, n_pieces.
    """
    lowered = staged(lowered.select(key, parent, value, F.col(length).cast("double").alias(length), "is_hump"), "lowered")
    sides = neighbours.select(key, F.explode(F.array("before", "after")).alias("other"))
    facts = lowered.select(F.col(key).alias("other"), F.col(parent).alias("_p"), F.col(value).alias("_v"))
    links = lowered.filter("is_hump").join(sides, key).join(facts, "other").filter((F.col(parent) == F.col("_p")) & (F.col(value) == F.col("_v")))
    groups = iterate.components(links.select(F.col(key).alias("a"), F.col("other").alias("b")))
    named = lowered.join(groups.select(F.col("node").alias(key), "label"), key, "left").withColumn("_group", F.coalesce("label", key))
    best = F.struct(~F.col("is_hump"), F.col(length), F.col(key))
    joined = named.groupBy(parent, value, "_group").agg(
        F.max_by(key, best).alias(key), F.sum(length).alias(length), (F.first("is_hump") & (F.count(F.lit(1)) == 1)).alias("is_hump"), F.count(F.lit(1)).alias("n_pieces")
    )
    alone = F.count(F.lit(1)).over(Window.partitionBy(parent)) == 1
    own = (F.col("n_pieces") > 1) & alone
    return joined.withColumn("_id", F.when(own, F.col(parent).cast("string")).otherwise(F.col(key).cast("string"))).select(F.col("_id").alias(key), parent, value, length, "is_hump", "n_pieces")


def unwrapped(points: DataFrame, ring: str, measure: str, length: str) -> DataFrame:
    """points with `unwrapped`: measures on a ring shifted so that they read as one run, cut at the widest gap (the first, on a tie)."""
    at = F.pmod(F.col(measure), F.col(length))
    valid = points.withColumn("_at", F.when(F.col(length) > 0, at))
    order = Window.partitionBy(ring).orderBy("_at")
    whole = Window.partitionBy(ring)
    after = F.coalesce(F.lead("_at").over(order), F.min("_at").over(whole) + F.col(length))
    gaps = valid.withColumns({"_after": after, "_n": F.count("_at").over(whole)}).withColumn("_gap", F.col("_after") - F.col("_at"))
    cut = F.max_by(F.pmod(F.col("_after"), F.col(length)), F.struct(F.col("_gap"), -F.col("_at"))).over(whole)
    shifted = F.when((F.col("_n") < 2) | F.col("_at").isNull(), F.col(measure)).when(F.col("_at") < F.col("_cut"), F.col("_at") + F.col(length)).otherwise(F.col("_at"))
    return gaps.withColumn("_cut", cut).withColumn("unwrapped", shifted).drop("_at", "_after", "_n", "_gap", "_cut")
