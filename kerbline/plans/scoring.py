"""Queries over the scoring chain, each with the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import speeds
from ..operators import order, scoring
from ..sources import geojson, tables
from ..sources.staging import staged
from .views import PERCENTILES, SEGMENTS

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


_MIDS, _SHARES = "[" + ", ".join(map(repr, speeds.interval_mids())) + "]", "[" + ", ".join(map(repr, speeds.interval_shares())) + "]"
_BANDS = "[" + ", ".join(map(repr, speeds.percentile_shares())) + "]"

SAFE = """
opened AS (SELECT * EXCLUDE (is_access_controlled), coalesce(is_access_controlled, false) AS mapped, coalesce(road_class = 'motorway' AND f85_speed >= 50, false) AS fast,
  coalesce(legal_foot = 'no' AND legal_bicycle = 'no' AND legal_foot_confidence IN ('medium', 'high'), false) AS closed FROM segments),
controlled AS (SELECT * EXCLUDE (mapped, fast, closed), mapped OR fast OR closed AS is_access_controlled,
  CASE WHEN mapped THEN CASE WHEN road_class = 'motorway' THEN 'osm_motorway' ELSE 'osm_motorroad' END WHEN fast THEN 'overture_motorway_fallback' WHEN closed THEN 'osm_vru_prohibited' END AS access_control_basis FROM opened),
typed AS (SELECT *,
  CASE WHEN is_access_controlled AND NOT (coalesce(legal_motorcycle = 'no', false) OR has_motorcycle_separation) THEN 'motorcycle' WHEN is_access_controlled AND is_divided THEN 'separated'
    WHEN is_access_controlled THEN 'head_on' WHEN has_vru_barrier THEN 'side_impact' ELSE 'pedestrian' END AS collision_type FROM controlled),
safe AS (SELECT *, (CASE collision_type WHEN 'separated' THEN CASE road_class WHEN 'motorway' THEN 100 WHEN 'trunk' THEN 90 ELSE 80 END WHEN 'head_on' THEN 70 WHEN 'motorcycle' THEN 30 WHEN 'side_impact' THEN 50 ELSE 30 END)::DOUBLE AS v_safe,
  concat_ws(':', collision_type, CASE collision_type WHEN 'side_impact' THEN 'vru_barrier' WHEN 'pedestrian' THEN 'default_vru_possible' ELSE access_control_basis END) AS v_safe_basis FROM typed)"""
GAPS = """
gaps AS (SELECT *, CASE WHEN data_quality_flag IS NULL THEN speed_limit - v_safe END AS misalignment, CASE WHEN data_quality_flag IS NULL THEN f85_speed - v_safe END AS operating_gap,
  CASE WHEN data_quality_flag IS NULL THEN greatest(speed_limit - v_safe, 0) END AS misalignment_magnitude, CASE WHEN data_quality_flag IS NULL THEN greatest(v_safe - speed_limit, 0) END AS excess_caution_magnitude FROM safe)"""
PLAUSIBLE = """
fences AS (SELECT country, road_class, land_use, quantile_cont(speed_limit, 0.25) AS q1, quantile_cont(speed_limit, 0.75) AS q3 FROM gaps WHERE data_quality_flag IS NULL GROUP BY ALL),
judged AS (SELECT gaps.*, q3 > q1 AND (speed_limit < q1 - 1.5 * (q3 - q1) OR speed_limit > q3 + 1.5 * (q3 - q1)) AS outlier, coalesce(abs(f85_speed - speed_limit) > 30, false) AS apart FROM gaps LEFT JOIN fences USING (country, road_class, land_use)),
plausible AS (SELECT * EXCLUDE (outlier, apart), abs(f85_speed - speed_limit) AS speedlimit_f85_divergence, CASE WHEN data_quality_flag IS NULL THEN outlier END AS speedlimit_roadclass_outlier, CASE WHEN data_quality_flag IS NULL THEN apart END AS speedlimit_extreme_divergence,
  CASE WHEN data_quality_flag IS NULL THEN CASE WHEN outlier OR apart THEN 'low' ELSE 'high' END END AS speedlimit_plausibility FROM judged)"""


def _capped(k: float, v: str = "v_safe") -> str:
    return (
        f"(1 - least(1, list_sum([{_SHARES}[i] * exp({k} * (least(sigma * {_MIDS}[i] + mean, {v}) - mean)) FOR i IN range(1, 13)]) / "
        f"list_sum([{_SHARES}[i] * exp({k} * sigma * {_MIDS}[i]) FOR i IN range(1, 13)]))) * 100"
    )


BENEFIT = f"""
spread AS (SELECT *, coalesce(tomtom_mean_speed > 0 AND tomtom_sd_speed > 0, false) AS own FROM plausible),
inputs AS (SELECT *, CASE WHEN own THEN tomtom_mean_speed ELSE median_speed END AS mean, CASE WHEN own THEN tomtom_sd_speed WHEN f85_speed > median_speed THEN (f85_speed - median_speed) / 1.04 END AS sigma FROM spread),
benefit AS (SELECT * EXCLUDE (own, mean, sigma), CASE WHEN data_quality_flag IS NULL THEN mean END AS exp_mean_speed, CASE WHEN data_quality_flag IS NULL THEN sigma END AS exp_sigma_speed, CASE WHEN data_quality_flag IS NULL THEN CASE WHEN own THEN 'tomtom' ELSE 'adb' END END AS exp_speed_source,
  {', '.join(f"CASE WHEN data_quality_flag IS NULL AND sigma IS NOT NULL THEN (1 - exp({k} * (v_safe - mean))) * 100 END AS exp_delta_{n}_percent_uniform, CASE WHEN data_quality_flag IS NULL AND sigma IS NOT NULL THEN {_capped(k)} END AS exp_delta_{n}_percent_tailcap" for n, k in speeds.COEFFICIENTS.items())}
  FROM inputs)"""
_RANKS = ",\n  ".join(
    f"(rank() OVER (PARTITION BY country, land_use ORDER BY {c}) + (count(*) OVER (PARTITION BY country, land_use, {c}) - 1) / 2.0) / count(*) OVER (PARTITION BY country, land_use) AS r{i}"
    for i, c in enumerate(("pop_density", "poi_count", "osm_poi_category_count", "is_mapillary_vru", "crossing_count"), 1)
)
EXPOSURE = f"""
ranked AS (SELECT *, {_RANKS} FROM benefit),
composed AS (SELECT * EXCLUDE (r1, r2, r3, r4, r5), CASE WHEN land_use = 'URBAN' THEN (r1 + r2 + r3 + r4 + r5) / 5 ELSE (r1 + r2 + r3) / 3 END AS exposure_composite FROM ranked),
tertiles AS (SELECT country, land_use, quantile_cont(exposure_composite, 1/3) AS e1, quantile_cont(exposure_composite, 2/3) AS e2 FROM composed GROUP BY ALL),
exposed AS (SELECT composed.*, CASE WHEN exposure_composite <= e1 THEN 'low' WHEN exposure_composite <= e2 THEN 'medium' ELSE 'high' END AS first_level FROM composed JOIN tertiles USING (country, land_use)),
dense AS (SELECT country, quantile_cont(pop_density, 0.75) AS t FROM exposed WHERE land_use = 'RURAL' GROUP BY country),
unsure AS (SELECT exposed.*, coalesce(land_use = 'RURAL' AND pop_density >= t AND NOT has_crossing, false) AS u FROM exposed LEFT JOIN dense USING (country)),
exposure AS (SELECT * EXCLUDE (u, first_level), CASE WHEN u THEN 'low' ELSE 'high' END AS exposure_confidence, CASE WHEN u AND first_level = 'low' THEN 'medium' ELSE first_level END AS exposure_level FROM unsure)"""


def _score(weights: str = "0.5, 0.35, 0.15", name: str = "scored", source: str = "exposure") -> str:
    m, e, c = weights.split(", ")
    return f"""
{name}_low AS (SELECT *, (piece_no % 5 = 0)::INT + coalesce(speedlimit_plausibility = 'low', false)::INT + (exposure_confidence = 'low')::INT AS lows FROM {source}),
{name}_terms AS (SELECT * EXCLUDE (lows), CASE WHEN data_quality_flag IS NULL THEN CASE lows WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END END AS confidence_level,
  CASE WHEN data_quality_flag IS NULL THEN least(misalignment_magnitude, 60) / 60 END AS misalignment_norm,
  CASE WHEN data_quality_flag IS NULL THEN CASE exposure_level WHEN 'low' THEN 0.0::DOUBLE WHEN 'medium' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END END AS exposure_norm,
  CASE WHEN data_quality_flag IS NULL THEN least(CASE lows WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 2/3 ELSE 1/3 END + CASE WHEN speed_data_source = 'tomtom' THEN 1/3 ELSE 0 END, 1) END AS confidence_norm FROM {name}_low),
{name} AS (SELECT *, round(100 * ({m}::DOUBLE * misalignment_norm + {e}::DOUBLE * exposure_norm + {c}::DOUBLE * confidence_norm), 9) AS safety_score FROM {name}_terms)"""


def _classes(name: str = "classed", source: str = "scored") -> str:
    return f"""
{name}_order AS (SELECT *, (sum(length_m) OVER (PARTITION BY country, land_use ORDER BY safety_score DESC, round(exp_delta_fatal_percent_uniform, 6) DESC NULLS LAST, segment_id ROWS UNBOUNDED PRECEDING) - length_m)::DOUBLE / (sum(length_m) OVER (PARTITION BY country, land_use))::DOUBLE AS share
  FROM {source} WHERE data_quality_flag IS NULL),
{name} AS (SELECT * EXCLUDE (share), CASE WHEN share < 0.03 - 1e-9 THEN 'Top Priority' WHEN share < 0.1 - 1e-9 THEN 'Priority' WHEN share < 0.2 - 1e-9 THEN 'Watch' ELSE 'Low Priority' END AS priority_class FROM {name}_order
  UNION ALL BY NAME SELECT *, 'Data Quality Issue (Excluded)' AS priority_class FROM {source} WHERE data_quality_flag IS NOT NULL)"""


UP_TO_EXPOSURE = f"WITH {SEGMENTS}, {SAFE}, {GAPS}, {PLAUSIBLE}, {BENEFIT}, {EXPOSURE}"
CLASSED = f"{UP_TO_EXPOSURE}, {_score()}, {_classes()}"


def _segments(spark, d) -> DataFrame:
    return tables.segments(spark, d)


def _classed(spark, d) -> DataFrame:
    return scoring.add_class(scoring.scored(_segments(spark, d)))


def _rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


@query("q01_load_population", f"WITH {SEGMENTS} SELECT * FROM segments WHERE analysis_status = 'Valid' AND exclude_from_speedspi IS DISTINCT FROM 1")
def q01(spark, d):
    """The analysis population: the valid rows of both countries' tables that are not left out."""
    both = _segments(spark, d)
    countries = [both.filter(F.col("country") == c) for c in ("thailand", "maharashtra")]
    return geojson.analysed(countries[0].unionByName(countries[1]))


@query("q03_safe_speed_decision", f"WITH {SEGMENTS}, {SAFE} SELECT segment_id, access_control_basis, collision_type, v_safe, v_safe_basis FROM safe")
def q03(spark, d):
    return scoring.add_safe_speed(_segments(spark, d)).select("segment_id", "access_control_basis", "collision_type", "v_safe", "v_safe_basis")


@query("q06_misalignment", f"WITH {SEGMENTS}, {SAFE}, {GAPS} SELECT segment_id, misalignment, misalignment_magnitude, excess_caution_magnitude, operating_gap FROM gaps")
def q06(spark, d):
    return scoring.add_misalignment(scoring.add_safe_speed(_segments(spark, d))).select("segment_id", "misalignment", "misalignment_magnitude", "excess_caution_magnitude", "operating_gap")


@query(
    "q07_plausibility_iqr",
    f"WITH {SEGMENTS}, {SAFE}, {GAPS}, {PLAUSIBLE} SELECT segment_id, speedlimit_roadclass_outlier, speedlimit_f85_divergence, speedlimit_extreme_divergence, speedlimit_plausibility FROM plausible",
)
def q07(spark, d):
    df = scoring.add_misalignment(scoring.add_safe_speed(_segments(spark, d)))
    return scoring.add_plausibility(df).select("segment_id", "speedlimit_roadclass_outlier", "speedlimit_f85_divergence", "speedlimit_extreme_divergence", "speedlimit_plausibility")


@query("q08_exposure_tertile", f"{UP_TO_EXPOSURE} SELECT segment_id, round(exposure_composite, 9) AS exposure_composite, exposure_level, exposure_confidence FROM exposure")
def q08(spark, d):
    df = scoring.add_exposure(_segments(spark, d))
    return _rounded(df.select("segment_id", "exposure_composite", "exposure_level", "exposure_confidence"), 9, "exposure_composite")


_BENEFITS = [f"exp_delta_{n}_percent_{s}" for n in speeds.COEFFICIENTS for s in ("uniform", "tailcap")]


@query(
    "q09_benefit_normal",
    f"WITH {SEGMENTS}, {SAFE}, {GAPS}, {PLAUSIBLE}, {BENEFIT} SELECT segment_id, exp_mean_speed, round(exp_sigma_speed, 6) AS exp_sigma_speed, exp_speed_source, {', '.join(f'round({x}, 6) AS {x}' for x in _BENEFITS)},"
    " round(exp_delta_fatal_percent_uniform / 100 * sample_size_avg, 4) AS exp_delta_fatal_abs FROM benefit",
)
def q09(spark, d):
    df = scoring.add_benefit(scoring.add_safe_speed(_segments(spark, d)))
    df = df.select("segment_id", "exp_mean_speed", "exp_sigma_speed", "exp_speed_source", *_BENEFITS, "exp_delta_fatal_abs")
    return _rounded(_rounded(df, 6, "exp_sigma_speed", *_BENEFITS), 4, "exp_delta_fatal_abs")


@query(
    "q09_benefit_measured",
    f"WITH {PERCENTILES}, m AS (SELECT *, list_sum([{_BANDS}[i] * speeds[i] FOR i IN range(1, 20)]) AS mean FROM percentiles WHERE len(speeds) = 19 AND speeds[19] > speeds[1])"
    f" SELECT segment_no, round(mean, 6) AS mean_speed, round((1 - exp(0.08 * (v_safe - mean))) * 100, 6) AS uniform_empirical,"
    f" round((1 - least(1, list_sum([{_BANDS}[i] * exp(0.08 * (least(speeds[i], v_safe) - mean)) FOR i IN range(1, 20)]) / list_sum([{_BANDS}[i] * exp(0.08 * (speeds[i] - mean)) FOR i IN range(1, 20)]))) * 100, 6) AS tailcap_empirical FROM m",
)
def q09_measured(spark, d):
    df = tables.percentiles(spark, d).filter(speeds.usable(F.col("speeds")))
    at, safe, k = F.col("speeds"), F.col("v_safe"), speeds.COEFFICIENTS["fatal"]
    return df.select(
        "segment_no", F.round(speeds.measured_mean(at), 6).alias("mean_speed"), F.round(speeds.uniform_measured(at, safe, k), 6).alias("uniform_empirical"), F.round(speeds.tail_capped_measured(at, safe, k), 6).alias("tailcap_empirical")
    )


_EXPLAIN = """CASE WHEN data_quality_flag IS NOT NULL THEN 'Speed data (SpeedLimit/MedianSpeed/F85) are all zero; excluded from scoring (data quality issue).' ELSE
  CASE WHEN misalignment_magnitude <= 0 THEN 'Posted speed limit does not exceed the safe speed (V_safe)' ELSE 'Posted speed limit is ' || round_even(misalignment_magnitude, 0)::BIGINT || ' km/h above the safe speed (V_safe)' END
  || '. VRU exposure: ' || upper(exposure_level[1]) || exposure_level[2:] || '. Data confidence: ' || upper(confidence_level[1]) || confidence_level[2:] || '.' END
  || ' Speed data source: ' || CASE speed_data_source WHEN 'tomtom' THEN 'Overture/ADB, corroborated by TomTom Traffic Stats' ELSE 'Overture/ADB probe data' END || '.'"""


@query(
    "q10_safety_score",
    f"{UP_TO_EXPOSURE}, {_score()} SELECT segment_id, confidence_level, misalignment_norm, exposure_norm, round(confidence_norm, 9) AS confidence_norm, safety_score, {_EXPLAIN} AS score_explanation,"
    " CASE exposure_level WHEN 'low' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END AS exposure_level_code, CASE confidence_level WHEN 'low' THEN 0 WHEN 'medium' THEN 1 WHEN 'high' THEN 2 END AS confidence_level_code,"
    " CASE speed_data_source WHEN 'overture' THEN 0 ELSE 1 END AS speed_data_source_code FROM scored",
)
def q10(spark, d):
    df = scoring.scored(_segments(spark, d)).select(
        "segment_id", "confidence_level", "misalignment_norm", "exposure_norm", "confidence_norm", "safety_score", "score_explanation", "exposure_level_code", "confidence_level_code", "speed_data_source_code"
    )
    return _rounded(df, 9, "confidence_norm")


@query("q11_priority_class", f"{CLASSED} SELECT segment_id, country, land_use, safety_score, priority_class FROM classed")
def q11(spark, d):
    return _classed(spark, d).select("segment_id", "country", "land_use", "safety_score", "priority_class")


_RANKED = """
listed AS (SELECT *, CASE WHEN data_quality_flag IS NULL THEN CASE WHEN road_class = 'motorway' OR land_use = 'RURAL' THEN 'rural' ELSE 'urban' END END AS road_environment,
  CASE WHEN priority_class IN ('Top Priority', 'Priority', 'Watch') THEN round((0.5 * misalignment_norm + 0.35 * exposure_norm) / 0.85, 9) END AS key FROM classed),
ranked_list AS (SELECT *, CASE WHEN key IS NOT NULL THEN rank() OVER (PARTITION BY country, road_environment, key IS NULL ORDER BY key DESC) END AS rank_within_environment,
  CASE WHEN key IS NOT NULL THEN CASE speedlimit_plausibility WHEN 'high' THEN 'Review Needed' WHEN 'low' THEN 'Field Verification Needed' END END AS review_track,
  CASE WHEN key IS NOT NULL AND confidence_level = 'low' THEN 'Exposure uncertain -- field verification recommended' END AS confidence_note FROM listed)"""


@query("q12_review_track_rank", f"{CLASSED}, {_RANKED} SELECT segment_id, road_environment, rank_within_environment, review_track, confidence_note FROM ranked_list")
def q12(spark, d):
    return scoring.add_environment_rank(scoring.add_track(_classed(spark, d))).select("segment_id", "road_environment", "rank_within_environment", "review_track", "confidence_note")


@query("q13_class_thresholds", f"{CLASSED} SELECT country, land_use, priority_class, min(safety_score) AS min_score, count(*) AS n, round(sum(length_m)::DOUBLE / 1000, 3) AS km FROM classed WHERE data_quality_flag IS NULL GROUP BY ALL")
def q13(spark, d):
    df = _classed(spark, d).filter(scoring.valid())
    return df.groupBy("country", "land_use", "priority_class").agg(F.min("safety_score").alias("min_score"), F.count(F.lit(1)).alias("n"), F.round(F.sum("length_m").cast("double") / 1000, 3).alias("km"))


@query(
    "q14_aadt",
    f"WITH {SEGMENTS} SELECT segment_id, parent_id, greatest(10, least(200000, round_even(sample_size_avg * CASE country WHEN 'thailand' THEN 4.610162705006461e-2 WHEN 'maharashtra' THEN 1.0953284597075048e0 END, 0)))::BIGINT AS aadt FROM segments",
)
def q14(spark, d):
    return scoring.add_aadt(_segments(spark, d)).select("segment_id", "parent_id", "aadt")


def _overlap_sql(base: str, other: str) -> str:
    return (
        f"SELECT count(*) FILTER (b IS NOT NULL) AS n_baseline, count(*) FILTER (o IS NOT NULL) AS n_other, count(*) FILTER (b IS NOT NULL AND o IS NOT NULL) AS n_overlap, round(sum(b)::DOUBLE / 1000, 6) AS km_baseline, round(sum(o)::DOUBLE / 1000, 6) AS km_other,"
        f" round((sum(o) FILTER (b IS NOT NULL))::DOUBLE / 1000, 6) AS km_overlap, round((sum(o) FILTER (b IS NOT NULL))::DOUBLE / sum(b)::DOUBLE, 9) AS recall_of_baseline, round((sum(o) FILTER (b IS NOT NULL))::DOUBLE / sum(coalesce(o, b))::DOUBLE, 9) AS jaccard"
        f" FROM (SELECT x.length_m AS b, y.length_m AS o FROM (SELECT * FROM {base} WHERE priority_class = 'Top Priority') x FULL JOIN (SELECT * FROM {other} WHERE priority_class = 'Top Priority') y USING (segment_id))"
    )


def _top(df: DataFrame) -> DataFrame:
    return df.filter(F.col("priority_class") == "Top Priority").select("segment_id", "length_m")


def _measures(df: DataFrame) -> DataFrame:
    return _rounded(_rounded(df, 6, "km_baseline", "km_other", "km_overlap"), 9, "recall_of_baseline", "jaccard")


_SCENARIOS = list(scoring.WEIGHT_SCENARIOS.items())


@query(
    "q15_sensitivity_weights",
    f"{UP_TO_EXPOSURE}, {_score()}, {_classes('b0')}, "
    + ", ".join(f"{_score(', '.join(map(repr, w)), f's{i}')}, {_classes(f'c{i}', f's{i}')}" for i, (_, w) in enumerate(_SCENARIOS))
    + " ".join(("" if i == 0 else " UNION ALL ") + f" SELECT '{label}' AS scenario, * FROM ({_overlap_sql('b0', f'c{i}')})" for i, (label, _) in enumerate(_SCENARIOS)),
)
def q15_weights(spark, d):
    """All weightings in one pass: the class cut has the scenario as one more cell key."""
    norms, tie = ("misalignment_norm", "exposure_norm", "confidence_norm"), "exp_delta_fatal_percent_uniform"
    df = staged(scoring.scored(_segments(spark, d)).filter(scoring.valid()).select(*scoring.CELL, "segment_id", "length_m", *norms, tie), "scored")
    each = F.array(*[F.struct(F.lit(label).alias("scenario"), *[F.lit(float(x)).alias(n) for x, n in zip(w, ("wm", "we", "wc"), strict=True)]) for label, w in _SCENARIOS])
    score = F.round(100 * (F.col("s.wm") * F.col("misalignment_norm") + F.col("s.we") * F.col("exposure_norm") + F.col("s.wc") * F.col("confidence_norm")), 9)
    spread = df.withColumn("s", F.explode(each)).withColumns({"safety_score": score, "scenario": F.col("s.scenario")})
    top = staged(scoring.first_class(spread, ("scenario", *scoring.CELL)).select("scenario", "segment_id", F.col("length_m").cast("double").alias("length_m")), "top")
    labels = F.array(*[F.lit(label) for label, _ in _SCENARIOS])
    base = top.filter(F.col("scenario") == _SCENARIOS[0][0]).select(F.explode(labels).alias("scenario"), "segment_id", F.col("length_m").alias("b"))
    both = base.join(top.withColumnRenamed("length_m", "o"), ["scenario", "segment_id"], "full")
    b, o, one = F.col("b").isNotNull(), F.col("o").isNotNull(), F.coalesce("o", "b")
    km = lambda when: F.coalesce(F.sum(F.when(when, one)), F.lit(0.0)) / 1000
    return _measures(
        both.groupBy("scenario").agg(
            F.count_if(b).alias("n_baseline"), F.count_if(o).alias("n_other"), F.count_if(b & o).alias("n_overlap"), (F.sum("b") / 1000).alias("km_baseline"), km(o).alias("km_other"), km(b & o).alias("km_overlap"),
            (km(b & o) / (F.sum("b") / 1000)).alias("recall_of_baseline"), (km(b & o) / km(b | o)).alias("jaccard"),
        )
    )


@query(
    "q15_sensitivity_sample",
    f"{UP_TO_EXPOSURE}, {_score()}, {_classes('b0')}, low AS (SELECT quantile_cont(sample_size_avg, 0.25) AS t FROM scored WHERE data_quality_flag IS NULL), kept AS (SELECT scored.* FROM scored, low WHERE data_quality_flag IS NULL AND sample_size_avg >= t), {_classes('other', 'kept')}"
    f" SELECT *, (SELECT round(t, 6) FROM low) AS sample_size_threshold, (SELECT count(*) FROM scored, low WHERE data_quality_flag IS NULL AND sample_size_avg < t) AS n_excluded_low_sample_segments,"
    f" (SELECT count(*) FROM b0, low WHERE priority_class = 'Top Priority' AND sample_size_avg < t) AS n_baseline_top_excluded_as_low_sample FROM ({_overlap_sql('b0', 'other')})",
)
def q15_sample(spark, d):
    df = scoring.scored(_segments(spark, d)).filter(scoring.valid())
    low = order.quantiles(df, [], "sample_size_avg", {"t": scoring.LOW_SAMPLE_QUANTILE})
    marked = df.join(F.broadcast(low))  # one row
    base = _top(scoring.add_class(df))
    other = _top(scoring.add_class(marked.filter("sample_size_avg >= t")))
    gone = marked.filter("sample_size_avg < t").agg(F.count(F.lit(1)).alias("n_excluded_low_sample_segments"))
    lost = marked.filter("sample_size_avg < t").join(base.select("segment_id"), "segment_id", "left_semi").agg(F.count(F.lit(1)).alias("n_baseline_top_excluded_as_low_sample"))
    one = _measures(scoring.overlap(base, other))
    return one.join(F.broadcast(low.select(F.round("t", 6).alias("sample_size_threshold")))).join(F.broadcast(gone)).join(F.broadcast(lost))


@query(
    "q16_benefit_table",
    f"{CLASSED}, {_RANKED} SELECT road_environment, count(*) AS n, round(avg(exp_delta_fatal_percent_uniform), 6) AS mean_uniform, round(avg(exp_delta_fatal_percent_tailcap), 6) AS mean_tailcap, count(*) FILTER (exp_delta_fatal_percent_uniform IS NULL) AS n_missing,"
    " round(avg(exp_delta_fatal_percent_uniform) - avg(exp_delta_fatal_percent_tailcap), 6) AS difference FROM ranked_list WHERE key IS NOT NULL GROUP BY road_environment",
)
def q16(spark, d):
    df = scoring.add_environment_rank(_classed(spark, d)).filter(F.col("priority_class").isin(*scoring.ON_LIST))
    u, t = F.avg("exp_delta_fatal_percent_uniform"), F.avg("exp_delta_fatal_percent_tailcap")
    return df.groupBy("road_environment").agg(
        F.count(F.lit(1)).alias("n"), F.round(u, 6).alias("mean_uniform"), F.round(t, 6).alias("mean_tailcap"), F.count_if(F.col("exp_delta_fatal_percent_uniform").isNull()).alias("n_missing"), F.round(u - t, 6).alias("difference")
    )


@query(
    "q17_reverse_mapping",
    f"{CLASSED} SELECT parent_id, round((sum(safety_score * length_m::DOUBLE) / sum(CASE WHEN safety_score IS NOT NULL THEN length_m::DOUBLE END)), 6) AS safety_score, arg_max(v_safe_basis, (length_m, -piece_no)) AS v_safe_basis,"
    " max(CASE exposure_level WHEN 'low' THEN 0 WHEN 'medium' THEN 1 WHEN 'high' THEN 2 END) AS exposure_level_code, max(CASE priority_class WHEN 'Top Priority' THEN 0 WHEN 'Priority' THEN 1 WHEN 'Watch' THEN 2 WHEN 'Low Priority' THEN 3 ELSE 4 END) AS priority_code FROM classed GROUP BY parent_id",
)
def q17(spark, d):
    """Pieces back to parents: length-weighted mean, the text of the longest piece, the largest code."""
    df, length = _classed(spark, d), F.col("length_m").cast("double")
    codes = F.expr("CASE priority_class WHEN 'Top Priority' THEN 0 WHEN 'Priority' THEN 1 WHEN 'Watch' THEN 2 WHEN 'Low Priority' THEN 3 ELSE 4 END")
    mean = F.sum(F.col("safety_score") * length) / F.sum(F.when(F.col("safety_score").isNotNull(), length))
    return df.groupBy("parent_id").agg(
        F.round(mean, 6).alias("safety_score"), F.max_by("v_safe_basis", F.struct("length_m", -F.col("piece_no"))).alias("v_safe_basis"), F.max("exposure_level_code").alias("exposure_level_code"), F.max(codes).alias("priority_code")
    )


@query(
    "q40_top_decile_overlap",
    f"{CLASSED}, v AS (SELECT segment_id, misalignment_magnitude, operating_gap FROM classed WHERE data_quality_flag IS NULL), k AS (SELECT count(*) // 10 AS k FROM v),"
    " a AS (SELECT segment_id FROM (SELECT segment_id, row_number() OVER (ORDER BY misalignment_magnitude DESC, segment_id) AS r FROM v), k WHERE r <= k), b AS (SELECT segment_id FROM (SELECT segment_id, row_number() OVER (ORDER BY operating_gap DESC, segment_id) AS r FROM v), k WHERE r <= k)"
    " SELECT (SELECT k FROM k) AS k, count(*) AS n_both, round(count(*) / (SELECT k FROM k), 9) AS share FROM a JOIN b USING (segment_id)",
)
def q40(spark, d):
    """The top tenths by two measures: sizes from ranges, not from one sorted task."""
    df = scoring.add_misalignment(scoring.add_safe_speed(_segments(spark, d))).filter(scoring.valid()).select("segment_id", "misalignment_magnitude", "operating_gap", F.lit(1).alias("_one"))

    def top(name: str) -> DataFrame:
        placed = order.running(df, [], [F.desc(name), F.col("segment_id")], "_one")
        return placed.filter(F.col("_before") < F.floor(F.col("_total") / 10)).select("segment_id")

    both = top("misalignment_magnitude").join(top("operating_gap"), "segment_id").agg(F.count(F.lit(1)).alias("n_both"))
    size = df.agg(F.floor(F.count(F.lit(1)) / 10).alias("k"))
    return size.join(F.broadcast(both)).select("k", "n_both", F.round(F.col("n_both") / F.col("k"), 9).alias("share"))


@query(
    "q46_invariants",
    f"{CLASSED} SELECT count(*) FILTER (v_safe NOT IN (30, 50, 70, 80, 90, 100)) AS bad_speed, count(*) FILTER (data_quality_flag IS NOT NULL AND safety_score IS NOT NULL) AS scored_invalid, count(*) FILTER (safety_score < 0 OR safety_score > 100) AS out_of_range,"
    " count(*) FILTER (misalignment_magnitude > 0 AND excess_caution_magnitude > 0) AS both_signs, count(*) - count(DISTINCT segment_id) AS duplicate_ids FROM classed",
)
def q46(spark, d):
    return _classed(spark, d).agg(
        F.count_if(~F.col("v_safe").isin(30, 50, 70, 80, 90, 100)).alias("bad_speed"), F.count_if(~scoring.valid() & F.col("safety_score").isNotNull()).alias("scored_invalid"),
        F.count_if((F.col("safety_score") < 0) | (F.col("safety_score") > 100)).alias("out_of_range"), F.count_if((F.col("misalignment_magnitude") > 0) & (F.col("excess_caution_magnitude") > 0)).alias("both_signs"),
        (F.count(F.lit(1)) - F.count_distinct("segment_id")).alias("duplicate_ids"),
    )


@query(
    "q71_display_class",
    f"{CLASSED} SELECT segment_id, CASE WHEN priority_class = 'Low Priority' AND misalignment <= 0 THEN 'Aligned' ELSE priority_class END AS map_class, coalesce(round(safety_score, 0)::BIGINT::VARCHAR, '(unknown)') AS score_text, NULL::BOOLEAN AS apply_median, NULL::BOOLEAN AS apply_sidewalk, NULL::DOUBLE AS bcr FROM classed",
)
def q71(spark, d):
    df = _classed(spark, d)
    aligned = F.coalesce((F.col("priority_class") == scoring.LOW_PRIORITY) & (F.col("misalignment") <= 0), F.lit(False))
    empty = {"apply_median": "boolean", "apply_sidewalk": "boolean", "bcr": "double"}
    return df.select(
        "segment_id", F.when(aligned, "Aligned").otherwise(F.col("priority_class")).alias("map_class"), F.coalesce(F.round("safety_score", 0).cast("long").cast("string"), F.lit("(unknown)")).alias("score_text"),
        *[F.lit(None).cast(t).alias(n) for n, t in empty.items()],
    )
