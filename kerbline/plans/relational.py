"""Queries of one or two relational steps, in SQL that Spark and DuckDB read alike except where a second text is given."""

from __future__ import annotations

from ..sources import tables
from .views import EDGES, POINTS, ROW_MATCHES, SEGMENTS, WAYS

QUERIES, SQL = {}, {}
_VIEWS = {
    "segments": (tables.segments, [SEGMENTS]), "points": (tables.points, [POINTS]), "ways": (tables.ways, [WAYS]), "row_matches": (tables.row_matches, [ROW_MATCHES]), "edges": (tables.edges, [SEGMENTS, EDGES]),
}
_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings", "documents", "labels")


def both(name: str, views: str, text: str, duck: str | None = None) -> None:
    """A query whose text names its views in braces; duck replaces the text where the dialects differ."""
    names = views.split()

    def run(spark, sf_dir):
        frames = {v: _VIEWS[v][0](spark, sf_dir) if v in _VIEWS else tables.table(spark, sf_dir, v) for v in names}
        return spark.sql(text, **frames)

    run.__name__, run.__doc__ = name, text
    QUERIES[name] = run
    needed = list(dict.fromkeys(cte for v in names if v in _VIEWS for cte in _VIEWS[v][1]))
    body = (duck or text).format(**{v: v for v in names})
    if not needed:
        SQL[name] = body
    elif body.lstrip().startswith("WITH "):
        SQL[name] = f"WITH {', '.join(needed)}, {body.lstrip()[5:]}"
    else:
        SQL[name] = f"WITH {', '.join(needed)} {body}"


both("q02_profile", "lineitem", "SELECT l_returnflag, count(*) AS n, count_if(l_discount IS NULL) AS n_null, min(l_quantity) AS lo, max(l_quantity) AS hi, round(avg(l_extendedprice), 4) AS mean, round(stddev_samp(l_extendedprice), 4) AS sd, count(DISTINCT l_shipdate) AS n_dates FROM {lineitem} GROUP BY l_returnflag",
     "SELECT l_returnflag, count(*) AS n, count(*) FILTER (l_discount IS NULL) AS n_null, min(l_quantity) AS lo, max(l_quantity) AS hi, round(avg(l_extendedprice), 4) AS mean, round(stddev_samp(l_extendedprice), 4) AS sd, count(DISTINCT l_shipdate) AS n_dates FROM {lineitem} GROUP BY l_returnflag")

both("q33_gaps_islands", "events", """WITH marked AS (SELECT user_id, event_id, ts, event_type, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) = event_type THEN 0 ELSE 1 END AS new FROM {events}),
runs AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM marked)
SELECT user_id, run, min(event_type) AS event_type, count(*) AS n, min(event_id) AS least_id FROM runs GROUP BY user_id, run""")

both("q35_direction_pair_select", "lineitem", """WITH sided AS (SELECT l_orderkey AS parent_id, l_linenumber % 2 AS side, count(*) AS sample_size, min(l_partkey % 130) AS raw_limit, max(l_quantity) AS speed FROM {lineitem} GROUP BY l_orderkey, l_linenumber % 2),
paired AS (SELECT parent_id, max(CASE WHEN side = 1 THEN sample_size END) AS n_fwd, max(CASE WHEN side = 0 THEN sample_size END) AS n_bwd, max(CASE WHEN side = 1 THEN speed END) AS v_fwd, max(CASE WHEN side = 0 THEN speed END) AS v_bwd,
  max(CASE WHEN side = 1 AND raw_limit BETWEEN 5 AND 125 AND raw_limit % 5 = 0 THEN raw_limit END) AS lim_fwd, max(CASE WHEN side = 0 AND raw_limit BETWEEN 5 AND 125 AND raw_limit % 5 = 0 THEN raw_limit END) AS lim_bwd FROM sided GROUP BY parent_id),
chosen AS (SELECT *, n_fwd IS NOT NULL AND (n_bwd IS NULL OR coalesce(n_fwd, -1) >= coalesce(n_bwd, -1)) AS use_fwd FROM paired)
SELECT parent_id, CASE WHEN use_fwd THEN 'fwd' WHEN n_bwd IS NOT NULL THEN 'bwd' END AS direction, CASE WHEN use_fwd THEN v_fwd ELSE v_bwd END AS speed, CASE WHEN use_fwd THEN coalesce(lim_fwd, lim_bwd) ELSE coalesce(lim_bwd, lim_fwd) END AS speed_limit,
  coalesce(lim_fwd <> lim_bwd, false) AS limits_differ, CASE WHEN n_fwd IS NULL OR n_bwd IS NULL THEN 'unpaired' WHEN v_fwd = v_bwd THEN 'same' ELSE 'reversed' END AS pair_label FROM chosen""")

both("q36_presence_matrix_scores", "events", """WITH present AS (SELECT DISTINCT user_id AS segment_id, event_type AS value FROM {events} WHERE event_type <> 'error')
SELECT e.segment_id, count(p.value) > 0 AS has_any, max(CASE WHEN value = 'view' THEN 1 ELSE 0 END) = 1 AS has_view, max(CASE WHEN value = 'click' THEN 1 ELSE 0 END) = 1 AS has_click, max(CASE WHEN value = 'purchase' THEN 1 ELSE 0 END) = 1 AS has_purchase, max(CASE WHEN value = 'signup' THEN 1 ELSE 0 END) = 1 AS has_signup,
  round(coalesce(sum(CASE value WHEN 'view' THEN 0.25D WHEN 'click' THEN 0.5D WHEN 'purchase' THEN 1.0D ELSE 0.125D END), 0), 6) AS barrier_score
FROM (SELECT DISTINCT user_id AS segment_id FROM {events}) e LEFT JOIN present p ON e.segment_id = p.segment_id GROUP BY e.segment_id""",
     """WITH present AS (SELECT DISTINCT user_id AS segment_id, event_type AS value FROM events WHERE event_type <> 'error')
SELECT e.segment_id, count(p.value) > 0 AS has_any, max(CASE WHEN value = 'view' THEN 1 ELSE 0 END) = 1 AS has_view, max(CASE WHEN value = 'click' THEN 1 ELSE 0 END) = 1 AS has_click, max(CASE WHEN value = 'purchase' THEN 1 ELSE 0 END) = 1 AS has_purchase, max(CASE WHEN value = 'signup' THEN 1 ELSE 0 END) = 1 AS has_signup,
  round(coalesce(sum(CASE value WHEN 'view' THEN 0.25 WHEN 'click' THEN 0.5 WHEN 'purchase' THEN 1.0 WHEN 'signup' THEN 0.125 END), 0)::DOUBLE, 6) AS barrier_score
FROM (SELECT DISTINCT user_id AS segment_id FROM events) e LEFT JOIN present p ON e.segment_id = p.segment_id GROUP BY e.segment_id""")

both("q37_crosstab_margins", "segments", "SELECT coalesce(road_class, 'All') AS road_class, coalesce(land_use, 'All') AS land_use, count(*) AS n FROM {segments} GROUP BY CUBE (road_class, land_use)")

both("q38_km_split_pct", "segments", "SELECT country, legal_motorcycle, round(CAST(sum(length_m) AS DOUBLE) / 1000, 3) AS km, round(100 * CAST(sum(length_m) AS DOUBLE) / CAST(sum(sum(length_m)) OVER (PARTITION BY country) AS DOUBLE), 6) AS pct, count(*) AS n FROM {segments} GROUP BY country, legal_motorcycle")

both("q39_taxonomy_name_filter", "part", r"""SELECT p_partkey, regexp_like(p_name, '(?i)(spring|lace|green|hospital|part)') AND NOT regexp_like(p_name, '(?i)(dark|parking)') AS name_ok, slice(split(p_type, ' '), 1, 2) = array('PROMO', 'BURNISHED') OR p_type LIKE 'STANDARD%' AS taxonomy_ok, regexp_replace(lower(p_name), '[^a-z0-9]+', '') AS normal FROM {part}""",
     r"""SELECT p_partkey, regexp_matches(p_name, '(?i)(spring|lace|green|hospital|part)') AND NOT regexp_matches(p_name, '(?i)(dark|parking)') AS name_ok, string_split(p_type, ' ')[1:2] = ['PROMO', 'BURNISHED'] OR p_type LIKE 'STANDARD%' AS taxonomy_ok, regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g') AS normal FROM part""")

both("q41_frame_diff", "segments", """WITH a AS (SELECT segment_id, speed_limit, legal_motorcycle FROM {segments} WHERE piece_no <> 7), b AS (SELECT segment_id, CASE WHEN piece_no = 3 THEN speed_limit + 1 ELSE speed_limit END AS speed_limit, CASE WHEN piece_no = 4 THEN NULL ELSE legal_motorcycle END AS legal_motorcycle FROM {segments} WHERE piece_no <> 6)
SELECT coalesce(a.segment_id, b.segment_id) AS segment_id, CASE WHEN a.segment_id IS NULL THEN 'added' WHEN b.segment_id IS NULL THEN 'missing' ELSE 'changed' END AS change, a.speed_limit AS speed_before, b.speed_limit AS speed_after
FROM a FULL JOIN b ON a.segment_id = b.segment_id WHERE a.segment_id IS NULL OR b.segment_id IS NULL OR a.speed_limit IS DISTINCT FROM b.speed_limit OR a.legal_motorcycle IS DISTINCT FROM b.legal_motorcycle""")

both("q42_id_dedupe_median", "points", """WITH m AS (SELECT user_id, percentile(px, 0.5) AS mx, percentile(py, 0.5) AS my FROM {points} GROUP BY user_id),
r AS (SELECT p.user_id, event_id, px, py, row_number() OVER (PARTITION BY p.user_id ORDER BY round(pow(px - mx, 2) + pow(py - my, 2), 3), event_id) AS r FROM {points} p JOIN m ON p.user_id = m.user_id) SELECT user_id, event_id, px, py FROM r WHERE r = 1""",
     """WITH m AS (SELECT user_id, quantile_cont(px, 0.5) AS mx, quantile_cont(py, 0.5) AS my FROM points GROUP BY user_id),
r AS (SELECT p.user_id, event_id, px, py, row_number() OVER (PARTITION BY p.user_id ORDER BY round(pow(px - mx, 2) + pow(py - my, 2), 3), event_id) AS r FROM points p JOIN m ON p.user_id = m.user_id) SELECT user_id, event_id, px, py FROM r WHERE r = 1""")

_TILE = "WITH t AS (SELECT event_id, 100 + px / 20011 AS lon, 13 + py / 20021 AS lat FROM {points}), k AS (SELECT *, CAST(floor((lon + 180) / 360 * 16384) AS BIGINT) AS x, CAST(floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 16384) AS BIGINT) AS y FROM t)"
both("q44_tile_cover_prune", "points", _TILE + " SELECT x, y, shiftleft(14L, 58) | shiftleft(x, 29) | y AS tile, count(*) AS n, min(event_id) AS least_id, CASE WHEN x % 4 = 0 THEN 'inside' WHEN x % 4 = 1 THEN 'edge' ELSE 'outside' END AS place, count_if(x % 4 = 0 OR (x % 4 = 1 AND event_id % 2 = 0)) AS n_kept FROM k GROUP BY x, y",
     _TILE + " SELECT x, y, ((14::BIGINT << 58) | (x << 29) | y) AS tile, count(*) AS n, min(event_id) AS least_id, CASE WHEN x % 4 = 0 THEN 'inside' WHEN x % 4 = 1 THEN 'edge' ELSE 'outside' END AS place, count(*) FILTER (x % 4 = 0 OR (x % 4 = 1 AND event_id % 2 = 0)) AS n_kept FROM k GROUP BY x, y")

both("q45_bbox_split", "customer", """WITH b AS (SELECT c_custkey, concat(c_custkey % 90, ',', c_custkey % 40, ',', c_custkey % 90 + 1 + c_custkey % 3, ',', c_custkey % 40 + 1) AS box FROM {customer}),
p AS (SELECT c_custkey, least(CAST(split_part(box, ',', 1) AS DOUBLE), CAST(split_part(box, ',', 3) AS DOUBLE)) AS west, CAST(split_part(box, ',', 2) AS DOUBLE) AS south, greatest(CAST(split_part(box, ',', 1) AS DOUBLE), CAST(split_part(box, ',', 3) AS DOUBLE)) AS east, CAST(split_part(box, ',', 4) AS DOUBLE) AS north FROM b),
n AS (SELECT *, CAST(ceil(sqrt((east - west) * (north - south) / 0.5)) AS INT) AS parts FROM p), i AS (SELECT *, explode(sequence(0, parts - 1)) AS i FROM n), ij AS (SELECT *, explode(sequence(0, parts - 1)) AS j FROM i)
SELECT c_custkey, i, j, round(west + (east - west) * i / parts, 6) AS west, round(south + (north - south) * j / parts, 6) AS south, round(west + (east - west) * (i + 1) / parts, 6) AS east, round(south + (north - south) * (j + 1) / parts, 6) AS north FROM ij""",
     """WITH b AS (SELECT c_custkey, concat(c_custkey % 90, ',', c_custkey % 40, ',', c_custkey % 90 + 1 + c_custkey % 3, ',', c_custkey % 40 + 1) AS box FROM customer),
p AS (SELECT c_custkey, least(CAST(split_part(box, ',', 1) AS DOUBLE), CAST(split_part(box, ',', 3) AS DOUBLE)) AS west, CAST(split_part(box, ',', 2) AS DOUBLE) AS south, greatest(CAST(split_part(box, ',', 1) AS DOUBLE), CAST(split_part(box, ',', 3) AS DOUBLE)) AS east, CAST(split_part(box, ',', 4) AS DOUBLE) AS north FROM b),
n AS (SELECT *, CAST(ceil(sqrt((east - west) * (north - south) / 0.5)) AS INT) AS parts FROM p), i AS (SELECT *, unnest(range(0, parts))::INT AS i FROM n), ij AS (SELECT *, unnest(range(0, parts))::INT AS j FROM i)
SELECT c_custkey, i, j, round(west + (east - west) * i / parts, 6) AS west, round(south + (north - south) * j / parts, 6) AS south, round(west + (east - west) * (i + 1) / parts, 6) AS east, round(south + (north - south) * (j + 1) / parts, 6) AS north FROM ij""")

both("q47_latest_version", "events", "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM {events}) WHERE r = 1")

both("q48_event_fold", "events", "SELECT user_id, count(*) AS n, max_by(event_type, struct(ts, event_id)) AS status, min_by(event_type, struct(ts, event_id)) AS first_status, count_if(event_type = 'error') AS n_errors, round(sum(value), 4) AS elapsed FROM {events} GROUP BY user_id",
     "SELECT user_id, count(*) AS n, arg_max(event_type, (ts, event_id)) AS status, arg_min(event_type, (ts, event_id)) AS first_status, count(*) FILTER (event_type = 'error') AS n_errors, round(sum(value), 4) AS elapsed FROM events GROUP BY user_id")

both("q49_field_normalise", "events", r"""SELECT event_id, nullif(trim(CASE WHEN event_id % 5 = 0 THEN '  ' ELSE concat(' ', event_type, ' ') END), '') AS clean, CAST(get_json_object(props, '$.k') AS INT) AS k, try_cast(CASE WHEN event_id % 7 = 0 THEN 'abc' ELSE CAST(event_id AS STRING) END AS DOUBLE) AS coerced, regexp_extract(concat('thailand_', event_id, '-3'), '^([a-z]+_[0-9]+)', 1) AS parent_id,
  regexp_replace(concat(event_type, ' /', event_id), '[^A-Za-z0-9._-]', '_') AS token, trim(LEADING '+' FROM date_format(timestamp_millis(1700000000000 + event_id * 86400000), 'yyyy-MM-dd')) AS day, array_join(array_sort(array_distinct(split(concat(event_type, ',b,a,', event_type), ','))), ';') AS sorted_set, round(CAST(event_id AS DOUBLE) / 3, 5) AS rounded FROM {events}""",
     r"""SELECT event_id, nullif(trim(CASE WHEN event_id % 5 = 0 THEN '  ' ELSE ' ' || event_type || ' ' END), '') AS clean, (props->>'$.k')::INT AS k, try_cast(CASE WHEN event_id % 7 = 0 THEN 'abc' ELSE event_id::VARCHAR END AS DOUBLE) AS coerced, regexp_extract('thailand_' || event_id || '-3', '^([a-z]+_[0-9]+)', 1) AS parent_id,
  regexp_replace(event_type || ' /' || event_id, '[^A-Za-z0-9._-]', '_', 'g') AS token, strftime(make_timestamp((1700000000000 + event_id * 86400000) * 1000), '%Y-%m-%d') AS day, array_to_string(list_sort(list_distinct(string_split(event_type || ',b,a,' || event_type, ','))), ';') AS sorted_set, round(event_id::DOUBLE / 3, 5) AS rounded FROM events""")

both("q51_distinct_and_shares", "lineitem orders", "SELECT o_orderstatus, count(DISTINCT l_orderkey) AS n_orders, count(DISTINCT l_partkey) AS n_parts, round(avg(CASE WHEN l_returnflag = 'R' THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS share_returned, round(count(DISTINCT l_suppkey) / CAST(count(*) AS DOUBLE), 6) AS supplier_ratio FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey GROUP BY ROLLUP (o_orderstatus)")

both("q53_calibration_ratio", "customer orders nation region", "SELECT r_name, round(sum(o_totalprice) / sum(greatest(c_acctbal, 1)), 6) AS scale, count(*) AS n FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey GROUP BY r_name")

both("q54_raster_sample_max", "segments points", """WITH grid AS (SELECT CAST(floor(px / 250) AS INT) AS gx, CAST(floor(py / 250) AS INT) AS gy, max(CASE WHEN event_id % 13 = 0 THEN -9999 ELSE value END) AS v FROM {points} GROUP BY 1, 2),
samples AS (SELECT segment_id, x1 AS x, y1 AS y FROM {segments} UNION ALL SELECT segment_id, (x1 + x2) / 2, (y1 + y2) / 2 FROM {segments} UNION ALL SELECT segment_id, x2, y2 FROM {segments}),
hit AS (SELECT segment_id, greatest(coalesce(v, 0), 0) AS v FROM samples LEFT JOIN grid ON gx = CAST(floor(x / 250) AS INT) AND gy = CAST(floor(y / 250) AS INT)) SELECT segment_id, max(v) AS pop_density FROM hit GROUP BY segment_id""")

both("q55_geo_scalar_math", "points", """WITH g AS (SELECT event_id, 72 + 34 * px / 20011 AS lon, 5 + 15 * py / 20021 AS lat FROM {points})
SELECT event_id, CAST(floor((lon + 180) / 6) AS INT) + 1 AS utm_zone, round(111132.954 - 559.822 * cos(2 * radians(lat)) + 1.175 * cos(4 * radians(lat)), 6) AS metres_per_degree, round(6371008.8 * cos(radians(lat)) * cos(radians(lon)), 3) AS ecef_x, round(6371008.8 * cos(radians(lat)) * sin(radians(lon)), 3) AS ecef_y, round(6371008.8 * sin(radians(lat)), 3) AS ecef_z,
  round((lon + 180) / 360 * 4096, 6) AS tile_px, round(degrees(atan(sinh(pi() * (1 - 2 * ((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2))))), 6) AS lat_back, floor(lat * 10) / 10 AS south, ceil(lat * 10) / 10 AS north FROM g""")

both("q56_haversine_length", "segments", """WITH g AS (SELECT segment_id, radians(100 + x1 / 111000) AS lon1, radians(13 + y1 / 111000) AS lat1, radians(100 + x2 / 111000) AS lon2, radians(13 + y2 / 111000) AS lat2 FROM {segments})
SELECT segment_id, round(2 * 6371008.8 * asin(sqrt(pow(sin((lat2 - lat1) / 2), 2) + cos(lat1) * cos(lat2) * pow(sin((lon2 - lon1) / 2), 2))), 4) AS length_m FROM g""")

both("q57_cut_and_substring", "segments", """WITH cuts AS (SELECT segment_id, x1, y1, x2, y2, length_m, 1 + parent_id % 3 AS parts FROM {segments} WHERE piece_no <= 3), p AS (SELECT *, explode(sequence(0, CAST(parts - 1 AS INT))) AS j FROM cuts)
SELECT concat(segment_id, '#', j) AS piece_id, round(x1 + (x2 - x1) * j / parts, 6) AS ax, round(y1 + (y2 - y1) * j / parts, 6) AS ay, round(x1 + (x2 - x1) * (j + 1) / parts, 6) AS bx, round(y1 + (y2 - y1) * (j + 1) / parts, 6) AS by_, round(CAST(length_m AS DOUBLE) / parts, 6) AS length_m FROM p UNION ALL
SELECT segment_id, x1, y1, x2, y2, round(CAST(length_m AS DOUBLE), 6) FROM {segments} WHERE piece_no > 3""",
     """WITH cuts AS (SELECT segment_id, x1, y1, x2, y2, length_m, 1 + parent_id % 3 AS parts FROM segments WHERE piece_no <= 3), p AS (SELECT *, unnest(range(0, parts)) AS j FROM cuts)
SELECT concat(segment_id, '#', j) AS piece_id, round(x1 + (x2 - x1) * j / parts, 6) AS ax, round(y1 + (y2 - y1) * j / parts, 6) AS ay, round(x1 + (x2 - x1) * (j + 1) / parts, 6) AS bx, round(y1 + (y2 - y1) * (j + 1) / parts, 6) AS by_, round(CAST(length_m AS DOUBLE) / parts, 6) AS length_m FROM p UNION ALL
SELECT segment_id, x1, y1, x2, y2, round(CAST(length_m AS DOUBLE), 6) FROM segments WHERE piece_no > 3""")

both("q59_zone_floor_fallback", "points", """WITH zoned AS (SELECT event_id FROM {points} WHERE event_id % 3 <> 0) SELECT p.event_id, u.land_use, CASE WHEN z.event_id IS NULL THEN 200 WHEN u.land_use = 'RURAL' THEN 200 ELSE 0 END AS circle_m, z.event_id IS NULL AS is_fallback FROM {points} p LEFT JOIN zoned z ON p.event_id = z.event_id JOIN (SELECT 'URBAN' AS land_use UNION ALL SELECT 'RURAL') u ON z.event_id IS NULL OR (p.event_id % 2 = 0) = (u.land_use = 'URBAN') WHERE p.category = 'school'""")

_RING = ((1000.0, 1000.0), (9000.0, 500.0), (15000.0, 6000.0), (9000.0, 9000.0), (12000.0, 16000.0), (3000.0, 12000.0))
_CROSS = " + ".join(f"CASE WHEN (py < {y1}) <> (py < {y2}) AND px < {x1} + (py - {y1}) * {x2 - x1} / {y2 - y1} THEN 1 ELSE 0 END" for (x1, y1), (x2, y2) in zip(_RING, (*_RING[1:], _RING[0]), strict=True))
both("q60_polygon_filter", "points", f"SELECT event_id, category, px NOT BETWEEN 0 AND 18000 OR py NOT BETWEEN 0 AND 18000 AS is_outlier FROM {{points}} WHERE px BETWEEN 1000 AND 15000 AND py BETWEEN 500 AND 16000 AND ({_CROSS}) % 2 = 1")

both("q65_equi_join_forms", "orders customer nation", "SELECT n_name, count(*) AS n_customers, count(o.o_custkey) AS n_with_orders, count_if(o.o_custkey IS NULL) AS n_without, max(o.n) AS most FROM {customer} c LEFT JOIN (SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey) o ON c_custkey = o.o_custkey JOIN {nation} ON c_nationkey = n_nationkey GROUP BY n_name",
     "SELECT n_name, count(*) AS n_customers, count(o.o_custkey) AS n_with_orders, count(*) FILTER (o.o_custkey IS NULL) AS n_without, max(o.n) AS most FROM customer c LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) o ON c_custkey = o.o_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")

both("q68_poi_flags", "events", "SELECT event_id, event_type = 'view' AS is_school, event_type = 'click' AS is_hospital, event_type IN ('purchase', 'signup') AS is_shop_or_stop, event_type = 'error' OR value > 450 AS is_junction, CASE WHEN event_type = 'view' THEN 'school' WHEN event_type = 'click' THEN 'hospital' WHEN event_type = 'purchase' THEN 'shop' END AS first_flag FROM {events} WHERE event_type <> 'signup' OR value < 100")

both("q73_conservation", "row_matches ways", "SELECT count(*) AS n_rows, count(DISTINCT m.osm_way_id) AS n_ways, count_if(w.osm_way_id IS NULL) AS n_missing, round(count(DISTINCT m.osm_way_id) * 1.0 / (SELECT count(*) FROM {ways}), 6) AS way_ratio FROM {row_matches} m LEFT JOIN {ways} w ON m.osm_way_id = w.osm_way_id",
     "SELECT count(*) AS n_rows, count(DISTINCT m.osm_way_id) AS n_ways, count(*) FILTER (w.osm_way_id IS NULL) AS n_missing, round(count(DISTINCT m.osm_way_id) * 1.0 / (SELECT count(*) FROM ways), 6) AS way_ratio FROM row_matches m LEFT JOIN ways w ON m.osm_way_id = w.osm_way_id")

both("q74_windows_misc", "orders", "SELECT o_orderkey, o_custkey, round(o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_custkey), 9) AS share, count(*) OVER (PARTITION BY o_custkey) AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
