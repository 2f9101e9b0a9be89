"""Queries over ways, their access, and what segments take from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import access
from ..sources import tables
from .views import EDGES, POINTS, ROW_MATCHES, SEGMENTS, WAYS

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def _m(v: str) -> str:
    return f"CASE WHEN {v} IN ('yes', 'designated', 'permissive') THEN 'yes' WHEN {v} IN ('no', 'use_sidepath') THEN 'no' WHEN {v} IN ('private', 'destination', 'permit', 'customers') THEN 'restricted' WHEN {v} IS NOT NULL THEN 'unknown' END"


def _mode(mode: str, keys: str, by_class: str, countries: tuple[tuple[str, str, str], ...] = ()) -> str:
    """keys: from the most specific on; by_class: the value by road class; countries: (country, class, value) that differ."""
    names = keys.split()
    clean = [f"nullif(trim({k}), '')" for k in names]
    own = " ".join(f"WHEN country = '{c}' AND highway = '{h}' THEN '{v}'" for c, h, v in countries)
    own_basis = " ".join(f"WHEN country = '{c}' AND highway = '{h}' THEN 'default:{c}'" for c, h, _ in countries)
    tagged = ", ".join(f"CASE WHEN {c} IS NOT NULL THEN 'tag:{k}' END" for k, c in zip(names, clean, strict=True))
    value = f"coalesce({', '.join(map(_m, clean))}, CASE {own} WHEN {by_class} THEN 'no' ELSE 'yes' END)"
    basis = f"coalesce({tagged}, CASE {own_basis} WHEN true THEN 'default:base' END)"
    return f"{value} AS legal_{mode}, {basis} AS legal_{mode}_basis, CASE WHEN {value} = 'unknown' OR {basis} LIKE 'default:%' THEN 'low' WHEN {basis} = 'tag:{mode}' THEN 'high' ELSE 'medium' END AS legal_{mode}_confidence"


_RESOLVED = (
    _mode("motor_vehicle", "motor_vehicle vehicle access", "highway IN ('footway', 'cycleway')"),
    _mode("motorcycle", "motorcycle motor_vehicle vehicle access", "highway IN ('footway', 'cycleway')", (("thailand", "motorway", "no"), ("thailand", "footway", "restricted"))),
    _mode("bicycle", "bicycle vehicle access", "highway IN ('footway', 'motorway')", (("maharashtra", "service", "restricted"),)),
    _mode("foot", "foot access", "highway = 'motorway'"),
)
ACCESS = f"resolved AS (SELECT *, {', '.join(_RESOLVED)} FROM ways)"
FLAGS = """
way_flags AS (SELECT *, CASE WHEN highway = 'motorway' THEN 'osm_motorway' WHEN t_motorroad THEN 'osm_motorroad' END AS access_basis, t_dual OR (oneway IS NOT NULL AND oneway NOT IN ('no', '0', 'false')) AS is_divided_way,
  t_dual OR (highway IN ('motorway', 'trunk') AND coalesce(oneway = 'yes', false)) AS is_separated_legacy,
  coalesce(bridge IN ('boardwalk', 'construction', 'movable', 'viaduct', 'yes'), false) OR coalesce(tunnel IN ('building_passage', 'covered', 'culvert', 'yes'), false) OR coalesce(try_cast(split_part(layer, ';', 1) AS DOUBLE) <> 0, false) AS is_grade_separated_way,
  coalesce(t_sidewalk IN ('both', 'left', 'right', 'yes'), false) AS has_sidewalk, t_cycleway AS has_cycleway, CASE WHEN t_conditional THEN 'motorcar:conditional' ELSE '' END AS conditional_keys,
  highway IN ('motorway', 'trunk', 'primary', 'secondary', 'tertiary', 'unclassified', 'residential', 'living_street', 'road') AND NOT coalesce(access IN ('private', 'no', 'customers', 'delivery', 'permit', 'agricultural', 'forestry'), false) AND NOT coalesce(motor_vehicle IN ('private', 'no'), false) AND NOT t_no_motorcar AS is_car_way FROM resolved)"""
_LEGAL = [f"legal_{m}{x}" for m in access.HIERARCHY for x in ("", "_basis", "_confidence")]
_FLAGS = ["access_basis", "is_divided_way", "is_separated_legacy", "is_grade_separated_way", "has_sidewalk", "has_cycleway", "conditional_keys", "is_car_way"]


def _ways(spark, d) -> DataFrame:
    return access.add_way_flags(access.add_access(tables.ways(spark, d)))


@query("q18_legal_access", f"WITH {WAYS}, {ACCESS} SELECT osm_way_id, {', '.join(_LEGAL)} FROM resolved")
def q18(spark, d):
    return access.add_access(tables.ways(spark, d)).select("osm_way_id", *_LEGAL)


@query("q67_way_flags", f"WITH {WAYS}, {ACCESS}, {FLAGS} SELECT osm_way_id, {', '.join(_FLAGS)} FROM way_flags")
def q67(spark, d):
    return _ways(spark, d).select("osm_way_id", *_FLAGS)


_ROLLED = ("motor_vehicle", "motorcycle", "bicycle", "foot")
_SUMS = ", ".join(f"coalesce(sum(l) FILTER (legal_{m} = '{v}'), 0) AS {m}_{v}" for m in _ROLLED for v in ("yes", "no", "restricted", "unknown"))
_RUNGS = ", ".join(f"min(CASE legal_{m}_confidence WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END) AS {m}_rung" for m in _ROLLED)


def _rolled(m: str) -> str:
    safe = f"CASE WHEN {m}_yes > 0 THEN 'yes' WHEN {m}_restricted > 0 THEN 'restricted' WHEN {m}_no > 0 THEN 'no' ELSE 'unknown' END"
    most = f"CASE greatest({m}_yes, {m}_no, {m}_restricted, {m}_unknown) WHEN {m}_yes THEN 'yes' WHEN {m}_no THEN 'no' WHEN {m}_restricted THEN 'restricted' ELSE 'unknown' END"
    shares = ", ".join(f"round({m}_{v} / len, 6) AS legal_{m}_{v}_frac" for v in ("yes", "no", "restricted", "unknown"))
    return f"{most if m == 'motor_vehicle' else safe} AS legal_{m}, CASE {m}_rung WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS legal_{m}_confidence, {shares}"


@query(
    "q19_access_rollup",
    f"WITH {WAYS}, {ACCESS}, {FLAGS}, {ROW_MATCHES}, j AS (SELECT m.*, way_flags.* EXCLUDE (osm_way_id), matched_len_m::DOUBLE AS l FROM row_matches m LEFT JOIN way_flags ON m.osm_way_id = way_flags.osm_way_id),"
    f" s AS (SELECT segment_id, sum(l) AS len, {_SUMS}, {_RUNGS}, bool_or(has_sidewalk) AS any_sidewalk, coalesce(sum(l) FILTER (match_kind = 'exact'), 0) AS len_exact, count(DISTINCT osm_way_id) AS n_ways,"
    " coalesce(sum(l) FILTER (access_basis IS NOT NULL), 0) AS len_c, coalesce(sum(l) FILTER (is_divided_way), 0) AS len_d, bool_or(coalesce(access_basis = 'osm_motorroad', false)) AS mr FROM j GROUP BY segment_id)"
    f" SELECT segment_id, {', '.join(map(_rolled, _ROLLED))}, any_sidewalk, round(len_exact / len, 6) AS exact_frac, n_ways, len_c / len >= 1 - 1e-9 AS is_access_controlled, len_d / len >= 0.95 AS is_divided,"
    " CASE WHEN len_c / len >= 1 - 1e-9 THEN CASE WHEN mr THEN 'osm_motorroad' ELSE 'osm_motorway' END END AS access_control_basis FROM s",
)
def q19(spark, d):
    return access.roll_up(tables.row_matches(spark, d), _ways(spark, d))


def _rows_and_spans(spark, d) -> tuple[DataFrame, DataFrame]:
    """Ranges of segments and of ways along the same parent."""
    segments = tables.segments(spark, d).select("parent_id", "segment_id", (F.col("piece_no") * 60 - 60).alias("r0"), (F.col("piece_no") * 60).alias("r1"))
    spans = tables.row_matches(spark, d).select("parent_id", "osm_way_id", "match_kind", (F.col("osm_way_id") % 300).alias("w0"), (F.col("osm_way_id") % 300 + F.col("matched_len_m").cast("double")).alias("w1"))
    return segments, spans


@query(
    "q20_interval_apportion",
    f"WITH {SEGMENTS}, {ROW_MATCHES}, r AS (SELECT parent_id, segment_id, piece_no * 60 - 60 AS r0, piece_no * 60 AS r1 FROM segments), w AS (SELECT parent_id, osm_way_id, match_kind, osm_way_id % 300 AS w0, osm_way_id % 300 + matched_len_m::DOUBLE AS w1 FROM row_matches)"
    " SELECT segment_id, osm_way_id, round(sum(least(r1, w1) - greatest(r0, w0)), 6) AS matched_len_m, min(match_kind) AS match_kind FROM r JOIN w USING (parent_id) WHERE least(r1, w1) > greatest(r0, w0) GROUP BY ALL",
)
def q20(spark, d):
    """Lengths that ranges along one parent have in common, summed for each segment and way."""
    rows, spans = _rows_and_spans(spark, d)
    both = rows.join(spans, "parent_id").withColumn("common", F.least("r1", "w1") - F.greatest("r0", "w0")).filter("common > 0")
    return both.groupBy("segment_id", "osm_way_id").agg(F.round(F.sum("common"), 6).alias("matched_len_m"), F.min("match_kind").alias("match_kind"))


@query(
    "q32_junction_degree",
    f"WITH {SEGMENTS}, {EDGES}, {POINTS}, ends AS (SELECT parent_id, road_class, floor(x1 / 100)::BIGINT AS x, floor(y1 / 100)::BIGINT AS y FROM edges UNION ALL SELECT parent_id, road_class, floor(x2 / 100)::BIGINT, floor(y2 / 100)::BIGINT FROM edges),"
    " d AS (SELECT x, y, count(*) AS degree, list_sort(list(DISTINCT road_class)) AS road_classes FROM ends GROUP BY x, y HAVING count(*) >= 3 AND count(DISTINCT parent_id) >= 2),"
    " c AS (SELECT floor(px / 100)::BIGINT AS x, floor(py / 100)::BIGINT AS y, count(*) AS controls FROM points WHERE category = 'junction' GROUP BY 1, 2), keys AS (SELECT x, y FROM d UNION SELECT x, y FROM c)"
    " SELECT x, y, coalesce(degree, 0) AS degree, coalesce(array_to_string(road_classes, ';'), '') AS road_classes, coalesce(controls, 0) AS controls FROM keys LEFT JOIN d USING (x, y) LEFT JOIN c USING (x, y)",
)
def q32(spark, d):
    """Cells of 100 m where at least three ends of edges of at least two ways meet, or where a control stands, with what each has."""
    e = tables.edges(spark, d)
    ends = e.select("parent_id", "road_class", F.explode(F.array(*[F.struct(F.floor(F.col(f"x{i}") / 100).alias("x"), F.floor(F.col(f"y{i}") / 100).alias("y")) for i in (1, 2)])).alias("v")).select("parent_id", "road_class", "v.x", "v.y")
    nodes = ends.groupBy("x", "y").agg(F.count(F.lit(1)).alias("degree"), F.count_distinct("parent_id").alias("n"), F.array_join(F.array_sort(F.collect_set("road_class")), ";").alias("road_classes"))
    nodes = nodes.filter("degree >= 3 AND n >= 2").drop("n")
    cell = [F.floor(F.col(c) / 100).alias(n) for c, n in (("px", "x"), ("py", "y"))]
    controls = tables.points(spark, d).filter("category = 'junction'").select(*cell).groupBy("x", "y").agg(F.count(F.lit(1)).alias("controls"))
    keys = nodes.select("x", "y").union(controls.select("x", "y")).distinct()
    both = keys.join(nodes, ["x", "y"], "left").join(controls, ["x", "y"], "left")
    return both.select("x", "y", F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("road_classes", F.lit("")).alias("road_classes"), F.coalesce("controls", F.lit(0)).alias("controls"))


@query(
    "q34_arc_positions",
    f"WITH {SEGMENTS}, {EDGES}, l AS (SELECT *, sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) AS len FROM edges) SELECT parent_id, k, round(sum(len) OVER w - len, 6) AS s0, round(sum(len) OVER w, 6) AS s1, row_number() OVER (PARTITION BY parent_id ORDER BY k) - 1 AS j, count(*) OVER (PARTITION BY parent_id) AS n FROM l WINDOW w AS (PARTITION BY parent_id ORDER BY k ROWS UNBOUNDED PRECEDING)",
)
def q34(spark, d):
    """Arc positions of the edges of a line, their number in it, and how many it has."""
    e = tables.edges(spark, d).withColumn("len", F.expr("sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2))"))
    line = Window.partitionBy("parent_id")
    upto = F.sum("len").over(line.orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    return e.select("parent_id", "k", F.round(upto - F.col("len"), 6).alias("s0"), F.round(upto, 6).alias("s1"), (F.row_number().over(line.orderBy("k")) - 1).alias("j"), F.count(F.lit(1)).over(line).alias("n"))


@query(
    "q52_vertex_arms",
    f"WITH {SEGMENTS}, {EDGES}, steps AS (SELECT parent_id, k, x1, y1, x2, y2, lead(x2) OVER w AS nx, lead(y2) OVER w AS ny, lead(x1) OVER w AS sx, lead(y1) OVER w AS sy FROM edges WINDOW w AS (PARTITION BY parent_id ORDER BY k)), turns AS (SELECT *, CASE WHEN nx IS NOT NULL THEN degrees(acos(greatest(-1, least(1, ((x2 - x1) * (nx - sx) + (y2 - y1) * (ny - sy)) / 3600)))) END AS turn FROM steps),"
    " arms AS (SELECT x, y, count(*) AS arms FROM (SELECT x1 AS x, y1 AS y FROM edges UNION ALL SELECT x2, y2 FROM edges) GROUP BY ALL) SELECT parent_id, k, round(turn, 6) AS turn, arms, arms >= 3 AS is_junction FROM turns JOIN arms ON x2 = x AND y2 = y",
)
def q52(spark, d):
    """Arms of the vertex at the end of each edge, and the turn to the next edge."""
    e = tables.edges(spark, d)
    line = Window.partitionBy("parent_id").orderBy("k")
    steps = e.withColumns({n: F.lead(c).over(line) for n, c in (("nx", "x2"), ("ny", "y2"), ("sx", "x1"), ("sy", "y1"))})
    dot = F.expr("((x2 - x1) * (nx - sx) + (y2 - y1) * (ny - sy)) / 3600")
    turn = F.when(dot.isNotNull(), F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot)))))
    arms = e.select(F.explode(F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")))).alias("v")).groupBy(F.col("v.x").alias("x2"), F.col("v.y").alias("y2")).agg(F.count(F.lit(1)).alias("arms"))
    return steps.withColumn("turn", turn).join(arms, ["x2", "y2"]).select("parent_id", "k", F.round("turn", 6).alias("turn"), "arms", (F.col("arms") >= 3).alias("is_junction"))
