"""From segments to scores: safe speed, misalignment, benefit, exposure, score, class, track and rank.

Every step is a function from a DataFrame to a DataFrame with columns added.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import speeds
from ..functions.columns import clip, truth, whole
from ..sources.staging import staged
from . import order
from .enrich import add_access_control

CELL = ("country", "land_use")
# fixed values: safe speeds, thresholds, weights, shares and texts of the method
SEPARATED = {"motorway": 100.0, "trunk": 90.0}
SEPARATED_OTHER, HEAD_ON, MOTORCYCLE, SIDE_IMPACT, PEDESTRIAN = 80.0, 70.0, 30.0, 50.0, 30.0
MISALIGNMENT_CAP = 60.0
WEIGHTS = (0.50, 0.35, 0.15)
WEIGHT_SCENARIOS = {
    "baseline (0.50/0.35/0.15)": (0.50, 0.35, 0.15),
    "equal weights (0.33/0.33/0.34)": (1 / 3, 1 / 3, 1 / 3),
    "misalignment-heavy (0.70/0.20/0.10)": (0.70, 0.20, 0.10),
    "exposure-heavy (0.30/0.55/0.15)": (0.30, 0.55, 0.15),
    "confidence-heavy (0.40/0.30/0.30)": (0.40, 0.30, 0.30),
}
CLASS_SHARES = {"Top Priority": 0.03, "Priority": 0.10, "Watch": 0.20}
SHARE_TOLERANCE = 1e-9
LOW_PRIORITY, EXCLUDED = "Low Priority", "Data Quality Issue (Excluded)"
ON_LIST = tuple(CLASS_SHARES)
DIVERGENCE, IQR_FACTOR = 30.0, 1.5
SIGNALS = {"URBAN": ("pop_density", "poi_count", "osm_poi_category_count", "is_mapillary_vru", "crossing_count"), "RURAL": ("pop_density", "poi_count", "osm_poi_category_count")}
RURAL_QUANTILE = 0.75
LOW_SAMPLE_QUANTILE = 0.25
SOURCES = {"overture": "Overture/ADB probe data", "tomtom": "Overture/ADB, corroborated by TomTom Traffic Stats"}
NO_GAP = "Posted speed limit does not exceed the safe speed (V_safe)"
GAP = ("Posted speed limit is ", " km/h above the safe speed (V_safe)")
NO_SPEED = "Speed data (SpeedLimit/MedianSpeed/F85) are all zero; excluded from scoring (data quality issue)."
UNCERTAIN = "Exposure uncertain -- field verification recommended"


def valid() -> Column:
    return F.col("data_quality_flag").isNull()


def add_safe_speed(df: DataFrame) -> DataFrame:
    """`access_control_basis`, `collision_type`, `v_safe`, `v_safe_basis` by the decision table, after the raises of access control."""
    df = add_access_control(df)
    controlled, barrier = truth(F.col("is_access_controlled")), truth(F.col("has_motorcycle_separation"))
    no_motorcycle = truth(F.col("legal_motorcycle") == "no") | barrier
    kind = (
        F.when(controlled & ~no_motorcycle, "motorcycle")
        .when(controlled & truth(F.col("is_divided")), "separated")
        .when(controlled, "head_on")
        .when(truth(F.col("has_vru_barrier")), "side_impact")
        .otherwise("pedestrian")
    )
    separated = F.lit(SEPARATED_OTHER)
    for road_class, speed in SEPARATED.items():
        separated = F.when(F.col("road_class") == road_class, speed).otherwise(separated)
    speed = F.when(F.col("collision_type") == "separated", separated)
    for name, value in (("head_on", HEAD_ON), ("motorcycle", MOTORCYCLE), ("side_impact", SIDE_IMPACT)):
        speed = speed.when(F.col("collision_type") == name, value)
    reason = F.when(F.col("collision_type") == "side_impact", "vru_barrier").when(F.col("collision_type") == "pedestrian", "default_vru_possible").otherwise(F.col("access_control_basis"))
    return (
        df.withColumn("collision_type", kind)
        .withColumn("v_safe", speed.otherwise(PEDESTRIAN))
        .withColumn("v_safe_basis", F.concat_ws(":", "collision_type", reason))
    )


def add_misalignment(df: DataFrame) -> DataFrame:
    gap = F.when(valid(), F.col("speed_limit") - F.col("v_safe"))
    return df.withColumn("misalignment", gap).withColumns(
        {
            "misalignment_magnitude": clip(F.col("misalignment"), low=0.0),
            "excess_caution_magnitude": clip(-F.col("misalignment"), low=0.0),
            "operating_gap": F.when(valid(), F.col("f85_speed") - F.col("v_safe")),
        }
    )


def add_plausibility(df: DataFrame) -> DataFrame:
    """Outliers among the limits of a country, road class and land use, and limits far from the 85th percentile of speeds."""
    peers = ["country", "road_class", "land_use"]
    bounds = order.quantiles(df.filter(valid()), peers, "speed_limit", {"_q1": 0.25, "_q3": 0.75})
    joined = df.join(bounds, peers, "left").withColumn("speedlimit_f85_divergence", F.abs(F.col("f85_speed") - F.col("speed_limit")))
    spread = F.col("_q3") - F.col("_q1")
    far = (F.col("speed_limit") < F.col("_q1") - IQR_FACTOR * spread) | (F.col("speed_limit") > F.col("_q3") + IQR_FACTOR * spread)
    outlier, apart = truth((spread > 0) & far), truth(F.col("speedlimit_f85_divergence") > DIVERGENCE)
    level = F.when(outlier | apart, "low").otherwise("high")
    return joined.withColumns(
        {
            "speedlimit_roadclass_outlier": F.when(valid(), outlier),
            "speedlimit_extreme_divergence": F.when(valid(), apart),
            "speedlimit_plausibility": F.when(valid(), level),
        }
    ).drop("_q1", "_q3")


def add_benefit(df: DataFrame) -> DataFrame:
    """Percent of injuries saved, from whole speed distributions, by severity and scenario."""
    proxy = (F.col("f85_speed") - F.col("median_speed")) / speeds.P85
    own = truth((F.col("tomtom_mean_speed") > 0) & (F.col("tomtom_sd_speed") > 0))
    df = df.withColumns(
        {
            "exp_mean_speed": F.when(valid(), F.when(own, F.col("tomtom_mean_speed")).otherwise(F.col("median_speed"))),
            "exp_sigma_speed": F.when(valid(), F.when(own, F.col("tomtom_sd_speed")).when(proxy > 0, proxy)),
            "exp_speed_source": F.when(valid(), F.when(own, "tomtom").otherwise("adb")),
        }
    )
    inputs = F.col("exp_mean_speed"), F.col("exp_sigma_speed"), F.col("v_safe")
    df = df.withColumns(
        {f"exp_delta_{name}_percent_{scenario}": f(*inputs, k) for name, k in speeds.COEFFICIENTS.items() for scenario, f in (("uniform", speeds.uniform), ("tailcap", speeds.tail_capped))}
    )
    return df.withColumn("exp_delta_fatal_abs", F.col("exp_delta_fatal_percent_uniform") / 100 * F.col("sample_size_avg"))


def exposure_levels(df: DataFrame, signals: Mapping[str, Sequence[str]] = SIGNALS, id_column: str = "segment_id") -> DataFrame:
    """Per id: `exposure_composite`, the mean percent rank of the cell's signals, and `exposure_level`, its tertile in the cell."""
    names = list(dict.fromkeys(s for names in signals.values() for s in names))
    df = order.percent_ranks(df.select(*CELL, id_column, *names), CELL, names)
    composite = F.lit(None).cast("double")
    for land_use, names in signals.items():
        total = sum((F.coalesce(f"_rank_{n}", F.lit(0.0)) for n in names[1:]), F.coalesce(f"_rank_{names[0]}", F.lit(0.0)))
        known = sum((F.col(f"_rank_{n}").isNotNull().cast("int") for n in names[1:]), F.col(f"_rank_{names[0]}").isNotNull().cast("int"))
        composite = F.when(F.col("land_use") == land_use, total / F.nullif(known, F.lit(0))).otherwise(composite)
    df = staged(df.select(*CELL, id_column, composite.alias("exposure_composite")))
    edges = staged(order.quantiles(df, CELL, "exposure_composite", {"_e0": 0.0, "_e1": 1 / 3, "_e2": 2 / 3, "_e3": 1.0}))
    apart = (F.col("_e0") < F.col("_e1")) & (F.col("_e1") < F.col("_e2")) & (F.col("_e2") < F.col("_e3"))
    by_value = F.when(F.col("exposure_composite") <= F.col("_e1"), "low").when(F.col("exposure_composite") <= F.col("_e2"), "medium").otherwise("high")
    joined = df.join(edges, list(CELL), "left")
    # equal edges: thirds of the row order by composite and id
    if not edges.filter(~apart).isEmpty():
        tied = joined.filter(~apart & F.col("exposure_composite").isNotNull()).select(*CELL, id_column, "exposure_composite", F.lit(1).alias("_one"))
        place = order.running(tied, CELL, [F.col("exposure_composite"), F.col(id_column)], "_one")
        third = F.when(F.col("_before") <= (F.col("_total") - 1) / 3, "low").when(F.col("_before") <= 2 * (F.col("_total") - 1) / 3, "medium").otherwise("high")
        joined = joined.join(place.select(id_column, third.alias("_third")), id_column, "left")
        by_value = F.coalesce("_third", by_value)
    return joined.select(id_column, "exposure_composite", F.when(F.col("exposure_composite").isNotNull(), by_value).alias("exposure_level"))


def add_exposure(df: DataFrame, signals: Mapping[str, Sequence[str]] = SIGNALS, id_column: str = "segment_id") -> DataFrame:
    """`exposure_composite`, `exposure_level` and `exposure_confidence`.

    Rural segments among many people and without a crossing are at least medium, with low confidence.  Only ids and
    signals are staged and ranked; the rest of the row is joined once, at the end.
    """
    names = dict.fromkeys(s for names in signals.values() for s in names)
    slim = staged(df.select(*CELL, id_column, *names, *[c for c in ("pop_density", "has_crossing") if c not in names]))
    limits = order.quantiles(slim.filter(F.col("land_use") == "RURAL"), ["country"], "pop_density", {"_dense": RURAL_QUANTILE})
    found = slim.select("country", "land_use", id_column, "pop_density", "has_crossing").join(exposure_levels(slim, signals, id_column), id_column).join(limits, "country", "left")
    unsure = truth((F.col("land_use") == "RURAL") & (F.col("pop_density") >= F.col("_dense")) & ~F.col("has_crossing"))
    raised = unsure & (F.coalesce("exposure_level", F.lit("low")) == "low")
    level = F.when(raised, "medium").otherwise(F.col("exposure_level"))
    found = found.select(id_column, "exposure_composite", level.alias("exposure_level"), F.when(unsure, "low").otherwise("high").alias("exposure_confidence"))
    return df.join(found, id_column, "left")


def confidence_level() -> Column:
    low = sum((truth(F.col(c) == "low").cast("int") for c in ("road_structure_confidence", "speedlimit_plausibility")), truth(F.col("exposure_confidence") == "low").cast("int"))
    return F.when(low == 0, "high").when(low == 1, "medium").otherwise("low")


def add_score(df: DataFrame, weights: tuple[float, float, float] = WEIGHTS) -> DataFrame:
    """The three terms, the score of 0 to 100 (rounded to 9 places so that ties are ties), codes and the explanation."""
    ladder = F.when(F.col("confidence_level") == "high", 1.0).when(F.col("confidence_level") == "medium", 2 / 3).otherwise(1 / 3)
    bonus = F.when(F.coalesce("speed_data_source", F.lit("overture")) == "tomtom", 1 / 3).otherwise(0.0)
    points = F.when(F.col("exposure_level") == "low", 0.0).when(F.col("exposure_level") == "medium", 0.5).when(F.col("exposure_level") == "high", 1.0)
    df = df.withColumn("confidence_level", F.when(valid(), confidence_level())).withColumns(
        {
            "misalignment_norm": F.when(valid(), clip(F.col("misalignment_magnitude"), high=MISALIGNMENT_CAP) / MISALIGNMENT_CAP),
            "exposure_norm": F.when(valid(), points),
            "confidence_norm": F.when(valid(), F.least(ladder + bonus, F.lit(1.0))),
        }
    )
    m, e, c = weights
    score = 100 * (m * F.col("misalignment_norm") + e * F.col("exposure_norm") + c * F.col("confidence_norm"))
    source = F.lit(SOURCES["overture"])
    for name, label in SOURCES.items():
        source = F.when(F.col("speed_data_source") == name, label).otherwise(source)
    said = F.concat(F.lit(" Speed data source: "), source, F.lit("."))
    gap = F.when(F.col("misalignment_magnitude") <= 0, NO_GAP).otherwise(F.concat(F.lit(GAP[0]), whole(F.col("misalignment_magnitude")), F.lit(GAP[1])))
    text = F.concat(gap, F.lit(". VRU exposure: "), F.initcap("exposure_level"), F.lit(". Data confidence: "), F.initcap("confidence_level"), F.lit("."), said)
    return df.withColumns(
        {
            "safety_score": F.round(score, 9),
            "score_explanation": F.when(valid(), text).otherwise(F.concat(F.lit(NO_SPEED), said)),
            "exposure_level_code": F.expr("CASE exposure_level WHEN 'low' THEN 0 WHEN 'medium' THEN 1 WHEN 'high' THEN 2 END"),
            "confidence_level_code": F.expr("CASE confidence_level WHEN 'low' THEN 0 WHEN 'medium' THEN 1 WHEN 'high' THEN 2 END"),
            "speed_data_source_code": F.expr("CASE coalesce(speed_data_source, 'overture') WHEN 'overture' THEN 0 ELSE 1 END"),
        }
    )


def add_class(df: DataFrame, tie: str = "exp_delta_fatal_percent_uniform", cells: Sequence[str] = CELL) -> DataFrame:
    """`priority_class` by the share of the cell's length before a segment in the order of scores."""
    df = staged(df)
    scored = df.filter(valid() & F.col("safety_score").isNotNull()).select(*cells, "segment_id", "length_m", (-F.col("safety_score")).alias("_first"), F.round(tie, 6).alias("_tie"))
    placed = order.running(scored, cells, [F.col("_first"), F.desc_nulls_last("_tie"), F.col("segment_id")], "length_m")
    share = F.col("_before").cast("double") / F.col("_total").cast("double")
    label = F.lit(LOW_PRIORITY)
    for name, most in sorted(CLASS_SHARES.items(), key=lambda x: -x[1]):
        label = F.when((F.col("_total") > 0) & (share < most - SHARE_TOLERANCE), name).otherwise(label)
    df = df.join(placed.select(*cells, "segment_id", label.alias("_class")), [*cells, "segment_id"], "left")
    return df.withColumn("priority_class", F.when(valid(), F.coalesce("_class", F.lit(LOW_PRIORITY))).otherwise(EXCLUDED)).drop("_class")


def first_class(df: DataFrame, cells: Sequence[str] = CELL, tie: str = "exp_delta_fatal_percent_uniform") -> DataFrame:
    """The rows that add_class() puts first, for valid rows with a score: cells, segment_id, length_m.

    Lengths are summed by score; a score whose rows are all before the cut, or all behind it, needs no order among them,
    so only the rows of the score at the cut are put in order.
    """
    most = F.lit(CLASS_SHARES["Top Priority"] - SHARE_TOLERANCE)
    keys = [*cells, "safety_score"]
    df = df.select(*keys, "segment_id", "length_m", F.round(tie, 6).alias("_tie")).filter(F.col("safety_score").isNotNull())
    placed = order.running(df.groupBy(*keys).agg(F.sum("length_m").alias("_length")), cells, [-F.col("safety_score")], "_length")
    part = lambda before, total: before.cast("double") / total.cast("double") < most
    placed = placed.filter((F.col("_total") > 0) & part(F.col("_before"), F.col("_total")))
    scores = staged(placed.select(*keys, F.col("_before").alias("_first"), F.col("_total").alias("_all"), part(F.col("_before") + F.col("_length"), F.col("_total")).alias("_whole")), "scores")
    whole = df.join(scores.filter("_whole"), keys, "left_semi")
    edge = order.running(df.join(scores.filter("NOT _whole"), keys), keys, [F.desc_nulls_last("_tie"), F.col("segment_id")], "length_m")
    edge = edge.filter(part(F.col("_first") + F.col("_before"), F.col("_all")))
    return whole.select(*cells, "segment_id", "length_m").unionByName(edge.select(*cells, "segment_id", "length_m"))


def add_track(df: DataFrame) -> DataFrame:
    listed = F.col("priority_class").isin(*ON_LIST)
    return df.withColumn("review_track", F.when(listed & (F.col("speedlimit_plausibility") == "high"), "Review Needed").when(listed & (F.col("speedlimit_plausibility") == "low"), "Field Verification Needed"))


def add_environment_rank(df: DataFrame) -> DataFrame:
    """Minimum rank by the two substantive terms among listed segments of a country and environment."""
    environment = F.when(valid(), F.when((F.col("road_class") == "motorway") | (F.col("land_use") == "RURAL"), "rural").otherwise("urban"))
    listed = truth(valid() & F.col("priority_class").isin(*ON_LIST))
    key = F.round((WEIGHTS[0] * F.col("misalignment_norm") + WEIGHTS[1] * F.col("exposure_norm")) / (WEIGHTS[0] + WEIGHTS[1]), 9)
    df = df.withColumns({"road_environment": environment, "_key": F.when(listed, -key)})
    cells = ["country", "road_environment"]
    ranks = order.distribution(df, cells, "_key").select(*cells, "_key", (F.col("_before") + 1).alias("rank_within_environment"))
    note = F.when(listed & (F.col("confidence_level") == "low"), UNCERTAIN)
    return df.join(ranks, [*cells, "_key"], "left").withColumn("confidence_note", note).drop("_key")


def scored(segments: DataFrame) -> DataFrame:
    """All steps up to the score, with the stand-ins that the driver's tables need."""
    df = segments.withColumn("road_structure_confidence", F.when(F.col("piece_no") % 5 == 0, "low").otherwise("high"))
    df = add_misalignment(add_plausibility(add_safe_speed(df)))
    return add_score(add_benefit(add_exposure(df)))


def overlap(base: DataFrame, other: DataFrame) -> DataFrame:
    """How two lists of (segment_id, length_m) agree, by count and by length; the other's length counts where both have one."""
    both = base.select("segment_id", F.col("length_m").alias("_b")).join(other.select("segment_id", F.col("length_m").alias("_o")), "segment_id", "full")
    length, b, o = F.coalesce("_o", "_b").cast("double"), F.col("_b").isNotNull(), F.col("_o").isNotNull()
    km = lambda when: F.coalesce(F.sum(F.when(when, length)), F.lit(0.0)) / 1000
    sums = both.agg(
        F.count_if(b).alias("n_baseline"), F.count_if(o).alias("n_other"), F.count_if(b & o).alias("n_overlap"),
        (F.coalesce(F.sum(F.col("_b").cast("double")), F.lit(0.0)) / 1000).alias("km_baseline"), km(o).alias("km_other"), km(b & o).alias("km_overlap"), km(b | o).alias("_km_union"),
    )
    return sums.select(
        "n_baseline", "n_other", "n_overlap", "km_baseline", "km_other", "km_overlap",
        F.try_divide("km_overlap", "km_baseline").alias("recall_of_baseline"), F.try_divide("km_overlap", "_km_union").alias("jaccard"),
    )


# fixed values: vehicles a day per probe, and the growth that carries them to 2025, by country
AADT_WEIGHTED = {"maharashtra": 1.0953284597075048, "thailand": 0.045002453618601286}
AADT_TO_2025 = {"maharashtra": 1.0, "thailand": 1.0244247444990198}
AADT_LEAST, AADT_MOST = 10, 200_000


def add_aadt(df: DataFrame, scales: Mapping[str, float] | None = None) -> DataFrame:
    """`aadt`, the daily traffic of a parent, the same on all its pieces; pieces that disagree, or an unknown country, are an error."""
    scales = scales or {country: scale * AADT_TO_2025[country] for country, scale in AADT_WEIGHTED.items()}
    scale = F.lit(None).cast("double")
    for country, value in scales.items():
        scale = F.when(F.col("country") == country, F.lit(value)).otherwise(scale)
    parents = df.groupBy("country", "parent_id").agg(F.min("sample_size_avg").alias("_probes"), F.max("sample_size_avg").alias("_most"))
    sound = F.col("_probes").isNotNull() & (F.col("_probes") == F.col("_most")) & scale.isNotNull()
    volume = F.greatest(F.lit(AADT_LEAST), F.least(F.lit(AADT_MOST), F.rint(F.col("_probes") * scale))).cast("long")
    aadt = F.when(sound, volume).otherwise(F.raise_error(F.lit("probes or country of a parent cannot be used")).cast("long"))
    return df.join(parents.select("country", "parent_id", aadt.alias("aadt")), ["country", "parent_id"])
