"""Rules that repair, raise, tag, fill and compare rows: columns in, columns out, no shuffles."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import truth

# fixed values: bases, classes, thresholds and tag values of the method
FALLBACK_BASIS, PROHIBITED_BASIS = "overture_motorway_fallback", "osm_vru_prohibited"
FALLBACK_F85 = 50.0
TAG_EVIDENCED = ("medium", "high")
INVALID = "invalid_speed"
LEGACY_EXCLUDED = ("motorway", "trunk")
LEGACY_SPEEDS = {"head_on": 70.0, "pedestrian": 30.0}
LEGACY_SEPARATED = {"motorway": 100.0, "trunk": 90.0}
LEGACY_SEPARATED_OTHER = 80.0
PEDESTRIAN_WAYS = ("footway", "path", "pedestrian", "steps")
DETECTED = {
    "school": ("warning--school-zone--g2", "regulatory--end-of-school-zone--g1"),
    "hospital": ("information--hospital--g1",),
    "bicycle": (
        "marking--discrete--symbol--bicycle", "object--bike-rack", "regulatory--pedestrians-bicycles-permitted--g1", "regulatory--shared-path-bicycles-and-pedestrians--g1",
        "regulatory--shared-path-pedestrians-and-bicycles--g1", "warning--dual-path-cyclists-and-pedestrians--g1",
    ),
}
DETECTED_BOTH = DETECTED["bicycle"][2:]


def ensure_columns(df: DataFrame, defaults: Mapping[str, tuple[str, object]]) -> DataFrame:
    """df with every named column: a missing one gets its default in its type; a complete frame comes back as it is."""
    missing = {name: F.lit(value).cast(kind) for name, (kind, value) in defaults.items() if name not in df.columns}
    return df.withColumns(missing) if missing else df


def fill_unmatched(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """What a row has that nothing was matched to: the defaults, where the columns are null after a left join."""
    return df.withColumns({name: F.coalesce(F.col(name), F.lit(value)) for name, value in defaults.items()})


ACCESS_DEFAULTS = {
    "f85_speed": ("double", None), "legal_foot": ("string", "unknown"), "legal_bicycle": ("string", "unknown"), "legal_foot_confidence": ("string", "low"), "access_control_basis": ("string", None),
}


def add_access_control(df: DataFrame) -> DataFrame:
    """`is_access_controlled` and `access_control_basis` after the two raises.

    A motorway that is as fast as one counts as controlled where the map does not say so; so does a road that neither
    pedestrians nor cyclists may enter, if the rule for pedestrians rests on a tag.
    """
    df = ensure_columns(df, ACCESS_DEFAULTS)
    mapped = truth(F.col("is_access_controlled"))
    own = F.coalesce("access_control_basis", F.when(F.col("road_class") == "motorway", "osm_motorway").otherwise("osm_motorroad"))
    fast = truth((F.col("road_class") == "motorway") & (F.col("f85_speed") >= FALLBACK_F85))
    closed = truth((F.col("legal_foot") == "no") & (F.col("legal_bicycle") == "no") & F.col("legal_foot_confidence").isin(*TAG_EVIDENCED))
    basis = F.when(mapped, own).when(fast, FALLBACK_BASIS).when(closed, PROHIBITED_BASIS)
    return df.withColumns({"access_control_basis": basis, "is_access_controlled": mapped | fast | closed})


def override_limit(df: DataFrame) -> DataFrame:
    """The second source's limit replaces the first wherever it has one; `speed_limit_adb` keeps the first."""
    has = F.col("tomtom_speed_limit").isNotNull()
    unusable = F.col("speed_limit").isNull() | truth(F.col("data_quality_flag") == INVALID)
    return df.withColumns(
        {
            "speed_limit_adb": F.col("speed_limit"), "speed_limit": F.coalesce("tomtom_speed_limit", "speed_limit"), "speed_limit_source": F.when(has, "tomtom").otherwise("adb"),
            "speed_limit_backfilled": has & unusable,
        }
    )


def backfill_speeds(df: DataFrame) -> DataFrame:
    """Observed speeds of flagged rows alone, where the second source has both, from there."""
    fill = truth((F.col("data_quality_flag") == INVALID) & F.col("tomtom_p85_speed").isNotNull() & (F.col("tomtom_median_speed") > 0))
    return df.withColumns(
        {
            "median_speed": F.when(fill, F.col("tomtom_median_speed")).otherwise(F.col("median_speed")), "f85_speed": F.when(fill, F.col("tomtom_p85_speed")).otherwise(F.col("f85_speed")),
            "observed_speed_backfilled": fill,
        }
    )


def clear_repaired(df: DataFrame) -> DataFrame:
    """A flag goes once all three fields that it was raised over are above 0; a half repaired row keeps it."""
    repaired = truth((F.col("data_quality_flag") == INVALID) & (F.col("speed_limit") > 0) & (F.col("median_speed") > 0) & (F.col("f85_speed") > 0))
    return df.withColumn("data_quality_flag", F.when(~repaired, F.col("data_quality_flag")))


def add_legacy(df: DataFrame, separated: Column, vru: Column) -> DataFrame:
    """`is_vru_legacy`, `collision_type_legacy`, `v_safe_legacy` and `v_safe_basis_legacy`: the rule before the split, for comparison."""
    apart = truth(separated)
    detected = truth(vru) & ~truth(F.col("road_class").isin(*LEGACY_EXCLUDED)) & ~apart
    by_barrier = F.when(apart, "separated").otherwise("head_on")
    sound = truth(F.col("road_class") == "motorway") & ~truth(F.col("f85_speed") < FALLBACK_F85)
    df = df.withColumn("is_vru_legacy", detected).withColumn("collision_type_legacy", F.when(sound, by_barrier).when(F.col("is_vru_legacy"), "pedestrian").otherwise(by_barrier))
    speed = F.when(F.col("collision_type_legacy") == "separated", reduce(lambda a, x: F.when(F.col("road_class") == x[0], x[1]).otherwise(a), LEGACY_SEPARATED.items(), F.lit(LEGACY_SEPARATED_OTHER)))
    for kind, value in LEGACY_SPEEDS.items():
        speed = speed.when(F.col("collision_type_legacy") == kind, value)
    basis = F.when(F.col("collision_type_legacy") == "separated", F.concat(F.lit("separated:"), F.coalesce("road_class", F.lit("None")))).otherwise(F.col("collision_type_legacy"))
    return df.withColumns({"v_safe_legacy": speed, "v_safe_basis_legacy": basis})


def replayed(df: DataFrame, pairs: Mapping[str, tuple[str, str]]) -> DataFrame:
    """How often a stored column and a recomputed one differ, null and value apart: level, n_rows, n_differ."""
    counts = df.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_if(~F.col(a).eqNullSafe(F.col(b))).alias(level) for level, (a, b) in pairs.items()])
    return counts.select("n_rows", F.explode(F.array(*[F.struct(F.lit(x).alias("level"), F.col(x).alias("n_differ")) for x in pairs])).alias("_l")).select("_l.level", "n_rows", "_l.n_differ")


def without_any(df: DataFrame, flags: list[str]) -> DataFrame:
    """The rows on which none of the flags is set; a missing column or value counts as not set."""
    found = [truth(F.col(c)) for c in flags if c in df.columns]
    return df.filter(~reduce(lambda a, b: a | b, found)) if found else df


def tagged_points(features: DataFrame) -> DataFrame:
    """Features with the five category flags of points of interest, those with at least one."""
    flags = {f"is_{x}": truth(F.col("amenity") == x) for x in ("school", "hospital", "marketplace")} | {"is_shop": F.col("shop").isNotNull(), "is_bus_stop": truth(F.col("highway") == "bus_stop")}
    return features.withColumns(flags).filter(reduce(lambda a, b: a | b, map(F.col, flags)))


def taxonomy_flags(hierarchy: Column) -> dict[str, Column]:
    """Category flags from the beginning of a taxonomy path."""
    starts = lambda *names: truth(F.slice(hierarchy, 1, len(names)) == F.array(*map(F.lit, names)))
    market = starts("shopping", "market")
    return {"is_school": starts("education", "place_of_learning", "school"), "is_hospital": starts("health_care", "hospital"), "is_marketplace": market, "is_shop": starts("shopping") & ~market}


def detection_flags(value: Column) -> dict[str, Column]:
    """Category flags of a detected object; one object may have several, and any other known one is a pedestrian's."""
    listed = {kind: truth(value.isin(*values)) for kind, values in DETECTED.items()}
    pedestrian = value.isNotNull() & (truth(value.isin(*DETECTED_BOTH)) | ~reduce(lambda a, b: a | b, listed.values()))
    return {f"map_is_{k}": c for k, c in listed.items()} | {"map_is_pedestrian": pedestrian}


def split_signals(features: DataFrame) -> dict[str, DataFrame]:
    """One raw frame as points of interest, pedestrian ways and crossings, by tags and kind of geometry (`geometry_type`)."""
    highway = F.col("highway")
    return {
        "pois": features.filter(F.col("amenity").isNotNull() | F.col("shop").isNotNull() | truth(highway == "bus_stop")),
        "pedestrian_ways": features.filter(highway.isin(*PEDESTRIAN_WAYS) & (F.col("geometry_type") == "LineString")),
        "crossings": features.filter((truth(highway == "crossing") | truth(F.col("footway") == "crossing")) & (F.col("geometry_type") == "Point")),
    }


def checked(given: Mapping[str, object], limits: Mapping[str, tuple[float, float, bool]]) -> dict[str, float]:
    """Parameters after a check of names, types and ranges: limits give least, most and whether only whole numbers count."""
    unknown = sorted(set(given) - set(limits))
    if unknown:
        raise ValueError(f"unknown parameters: {', '.join(unknown)}")
    out = {}
    for name, value in given.items():
        least, most, whole = limits[name]
        if isinstance(value, bool) or not isinstance(value, (int, float)) or value != value:
            raise ValueError(f"{name} must be a number")
        if whole and value != int(value):
            raise ValueError(f"{name} must be a whole number")
        if not least <= value <= most:
            raise ValueError(f"{name} must be from {least:g} to {most:g}")
        out[name] = int(value) if whole else float(value)
    return out
