"""DuckDB's SQL for the views of sources.tables, as common table expressions by name."""

SEGMENTS = """
lines AS (SELECT l_orderkey AS ok, l_linenumber AS ln, min(l_partkey) AS pk, min(l_suppkey) AS sk, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS ext FROM lineitem GROUP BY ALL),
base AS (SELECT lines.*, c_nationkey, c_mktsegment, c_acctbal, o_totalprice, substr(o_orderpriority, 1, 1) AS priority
  FROM lines JOIN orders ON ok = o_orderkey JOIN customer ON o_custkey = c_custkey),
segments AS (SELECT
  CASE WHEN c_nationkey % 2 = 0 THEN 'thailand' ELSE 'maharashtra' END AS country,
  CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'HOUSEHOLD', 'FURNITURE') THEN 'URBAN' ELSE 'RURAL' END AS land_use,
  CASE priority WHEN '1' THEN 'motorway' WHEN '2' THEN 'trunk' WHEN '3' THEN 'primary' WHEN '4' THEN 'secondary' ELSE 'tertiary' END AS road_class,
  CASE WHEN c_nationkey % 2 = 0 THEN 'thailand' ELSE 'maharashtra' END || '_' || ok || '-' || ln AS segment_id,
  ok AS parent_id, ln AS piece_no,
  CASE WHEN pk % 37 = 0 THEN 'invalid_speed' END AS data_quality_flag,
  (CASE WHEN pk % 37 = 0 THEN 0 ELSE 20 + 10 * (sk % 10) END)::DOUBLE AS speed_limit,
  (CASE WHEN pk % 37 = 0 THEN 0 ELSE 25 + (7 * pk) % 90 END)::DOUBLE AS median_speed,
  (CASE WHEN pk % 37 = 0 THEN 0 ELSE 23 + (7 * pk) % 90 + (ok + ln) % 30 END)::DOUBLE AS f85_speed,
  CASE WHEN sk % 5 = 0 THEN (22 + (7 * pk) % 90)::DOUBLE END AS tomtom_mean_speed,
  CASE WHEN sk % 5 = 0 THEN (4 + pk % 12)::DOUBLE END AS tomtom_sd_speed,
  CASE WHEN sk % 5 = 0 THEN 'tomtom' ELSE 'overture' END AS speed_data_source,
  o_totalprice AS sample_size_avg, CAST(CAST(ext AS DECIMAL(18,3)) / 10 AS DECIMAL(18,3)) AS length_m, greatest(c_acctbal, 0) AS pop_density,
  priority = '1' OR ok % 11 = 0 AS is_access_controlled, ok % 3 <> 0 AS is_divided, ok % 4 = 1 AS is_grade_separated,
  CASE ok % 4 WHEN 0 THEN 'no' WHEN 1 THEN 'yes' WHEN 2 THEN 'unknown' END AS legal_motorcycle,
  pk % 29 = 0 AS has_vru_barrier, pk % 13 = 0 AS has_motorcycle_separation,
  ((pk % 17) * (sk % 3))::INT AS poi_count, (pk % 6)::INT AS osm_poi_category_count, (pk + sk) % 5 = 0 AS is_mapillary_vru, ((ok + ln) % 4)::INT AS crossing_count, (ok + ln) % 4 > 0 AS has_crossing,
  CASE WHEN (ok + 3 * ln) % 9 = 0 THEN 'Insufficient' WHEN (ok + 3 * ln) % 41 = 1 THEN NULL ELSE 'Valid' END AS analysis_status, CASE WHEN ok % 13 = 0 THEN 1::DOUBLE WHEN ok % 13 > 1 THEN 0::DOUBLE END AS exclude_from_speedspi,
  CASE ok % 6 WHEN 0 THEN 'no' WHEN 1 THEN 'yes' WHEN 2 THEN 'restricted' WHEN 3 THEN 'no' WHEN 4 THEN 'unknown' END AS legal_foot, CASE WHEN ok % 4 IN (0, 3) THEN 'no' ELSE 'yes' END AS legal_bicycle,
  CASE ln % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS legal_foot_confidence, CASE WHEN pk % 8 = 0 THEN (30 + 5 * (pk % 11))::DOUBLE END AS tomtom_speed_limit,
  CASE WHEN pk % 3 = 0 THEN ((pk % 12) * 7)::DOUBLE END AS tomtom_median_speed, CASE WHEN pk % 6 = 0 THEN ((pk % 12) * 7 + 11)::DOUBLE END AS tomtom_p85_speed,
  ((7919 * ok) % 20011 + CASE WHEN ok % 2 = 0 THEN 60 * (ln - 1) ELSE 0 END)::DOUBLE AS x1,
  ((104729 * ok) % 20021 + CASE WHEN ok % 2 = 1 THEN 60 * (ln - 1) ELSE 0 END)::DOUBLE AS y1,
  ((7919 * ok) % 20011 + CASE WHEN ok % 2 = 0 THEN 60 * ln ELSE 0 END)::DOUBLE AS x2,
  ((104729 * ok) % 20021 + CASE WHEN ok % 2 = 1 THEN 60 * ln ELSE 0 END)::DOUBLE AS y2
  FROM base)"""

POINTS = """
points AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'school' WHEN 'click' THEN 'hospital' WHEN 'purchase' THEN 'shop' WHEN 'signup' THEN 'bus_stop' ELSE 'junction' END AS category,
  ((6007 * event_id + 311) % 20011)::DOUBLE AS px, ((31 * event_id * event_id + 7901 * event_id + 97) % 20021)::DOUBLE AS py, value / 500 AS confidence, user_id, ts, value, props FROM events)"""

WAYS = """
ways AS (SELECT p_partkey AS osm_way_id, CASE WHEN p_partkey % 2 = 0 THEN 'thailand' ELSE 'maharashtra' END AS country, p_partkey % 21 = 0 AS t_no_motorcar,
  CASE p_partkey % 7 WHEN 0 THEN 'motorway' WHEN 1 THEN 'trunk' WHEN 2 THEN 'primary' WHEN 3 THEN 'residential' WHEN 4 THEN 'footway' WHEN 5 THEN 'cycleway' ELSE 'service' END AS highway,
  CASE p_partkey % 5 WHEN 0 THEN 'no' WHEN 1 THEN 'private' WHEN 2 THEN 'yes' END AS access,
  CASE p_partkey % 11 WHEN 0 THEN 'no' WHEN 1 THEN 'yes' WHEN 2 THEN 'destination' WHEN 3 THEN 'strange' END AS vehicle,
  CASE p_partkey % 13 WHEN 0 THEN 'no' WHEN 1 THEN 'yes' WHEN 2 THEN 'permit' END AS motor_vehicle,
  CASE p_partkey % 17 WHEN 0 THEN 'no' WHEN 1 THEN 'designated' WHEN 2 THEN ' yes ' WHEN 3 THEN '' END AS motorcycle,
  CASE p_partkey % 19 WHEN 0 THEN 'no' WHEN 1 THEN 'yes' WHEN 2 THEN 'use_sidepath' END AS foot,
  CASE p_partkey % 23 WHEN 0 THEN 'no' WHEN 1 THEN 'designated' END AS bicycle,
  CASE WHEN p_partkey % 3 = 0 THEN 'yes' WHEN p_partkey % 3 = 1 THEN '-1' END AS oneway,
  CASE p_size % 6 WHEN 0 THEN '0' WHEN 1 THEN '1' WHEN 2 THEN '0;1' WHEN 3 THEN 'abc' WHEN 4 THEN '-1' END AS layer,
  CASE WHEN p_partkey % 31 = 0 THEN 'yes' WHEN p_partkey % 31 = 1 THEN 'viaduct' WHEN p_partkey % 31 = 2 THEN 'no' END AS bridge,
  CASE WHEN p_partkey % 37 = 0 THEN 'yes' END AS tunnel,
  p_partkey % 4 = 0 AS t_motorroad, CASE p_partkey % 6 WHEN 0 THEN 'both' WHEN 1 THEN 'no' END AS t_sidewalk, p_partkey % 9 = 0 AS t_dual, p_partkey % 10 = 0 AS t_cycleway, p_partkey % 12 = 0 AS t_conditional,
  p_retailprice AS length_m, p_name AS name, p_size AS size FROM part)"""

ROW_MATCHES = """
row_matches AS (SELECT CASE WHEN c_nationkey % 2 = 0 THEN 'thailand' ELSE 'maharashtra' END || '_' || l_orderkey || '-' || l_linenumber AS segment_id, l_orderkey AS parent_id, l_partkey AS osm_way_id,
  l_quantity::DECIMAL(12,2) AS matched_len_m, CASE WHEN l_linestatus = 'F' THEN 'exact' ELSE 'tolerance' END AS match_kind, l_linenumber AS piece_no
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""

EDGES = "edges AS (SELECT parent_id, country, road_class, piece_no AS k, x1, y1, x2, y2 FROM segments)"

PERCENTILES = """
percentiles AS (SELECT vec_id AS segment_no, label, list_sort(list_transform(embedding[1:19], lambda x: round(50 + 100 * x::DOUBLE, 6))) AS speeds, (20 + 10 * (vec_id % 9))::DOUBLE AS v_safe FROM embeddings)"""
