"""Legal access of ways by tag hierarchy, and its roll-up from ways to segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import grade_separated, tag, truth

# fixed values: keys from general to specific by mode, what tag values mean, how segments resolve a mix
HIERARCHY = {
    "motor_vehicle": ("access", "vehicle", "motor_vehicle"), "motorcycle": ("access", "vehicle", "motor_vehicle", "motorcycle"), "bicycle": ("access", "vehicle", "bicycle"), "foot": ("access", "foot"),
}
MEANING = {"yes": ("yes", "designated", "permissive"), "no": ("no", "use_sidepath"), "restricted": ("private", "destination", "permit", "customers")}
SAFE_SIDE = ("motorcycle", "bicycle", "foot")  # any length that allows the mode allows it; motor_vehicle goes by most of the length
SAFE_ORDER = ("yes", "restricted", "no", "unknown")
VALUES = ("yes", "no", "restricted", "unknown")
#: Defaults by road class, and what a country changes in them (ours, see README).
DEFAULTS = {
    **{h: {"motor_vehicle": "yes", "motorcycle": "yes", "bicycle": "yes", "foot": "yes"} for h in ("trunk", "primary", "secondary", "tertiary", "unclassified", "residential", "living_street", "service", "road")},
    "motorway": {"motor_vehicle": "yes", "motorcycle": "yes", "bicycle": "no", "foot": "no"},
    "footway": {"motor_vehicle": "no", "motorcycle": "no", "bicycle": "no", "foot": "yes"},
    "cycleway": {"motor_vehicle": "no", "motorcycle": "no", "bicycle": "yes", "foot": "yes"},
    "path": {"motor_vehicle": "no", "motorcycle": "no", "foot": "yes"},
}
COUNTRY_DEFAULTS = {"thailand": {"motorway": {"motorcycle": "no"}, "footway": {"motorcycle": "restricted"}}, "maharashtra": {"service": {"bicycle": "restricted"}}}
CAR_HIGHWAYS = (
    "motorway", "trunk", "primary", "secondary", "tertiary", "motorway_link", "trunk_link", "primary_link", "secondary_link", "tertiary_link", "unclassified", "residential", "living_street", "road",
)
PRIVATE_ACCESS = ("private", "no", "customers", "delivery", "permit", "agricultural", "forestry")
UNANIMOUS = 1 - 1e-9
CERTAIN_SHARE = 0.95


def meaning(value: Column) -> Column:
    """What a tag value allows; null where there is none, `unknown` where it is not understood."""
    low = F.lower(value)
    out = F.when(value.isNotNull(), "unknown")
    for name, values in MEANING.items():
        out = F.when(low.isin(*values), name).otherwise(out)
    return out


def _default(mode: str) -> tuple[Column, Column]:
    """The value and basis of a way without any tag for the mode: by class, and by country where that differs."""
    highway, country = F.col("highway"), F.col("country")
    value, basis = F.lit("unknown"), F.when(highway.isin(*DEFAULTS), "default:incomplete_base").otherwise("default:unknown_highway")
    for name, modes in DEFAULTS.items():
        if mode in modes:
            value, basis = F.when(highway == name, modes[mode]).otherwise(value), F.when(highway == name, "default:base").otherwise(basis)
    for place, classes in COUNTRY_DEFAULTS.items():
        for name, modes in classes.items():
            if mode in modes:
                here = truth((country == place) & (highway == name))
                value, basis = F.when(here, modes[mode]).otherwise(value), F.when(here, f"default:{place}").otherwise(basis)
    return value, basis


def add_access(ways: DataFrame) -> DataFrame:
    """legal_<mode>, its basis and its confidence, for each mode: the most specific tag decides, else class and country."""
    columns = {}
    for mode, keys in HIERARCHY.items():
        default, by = _default(mode)
        specific = list(reversed(keys))
        value = F.coalesce(*[meaning(tag(k)) for k in specific], default)
        basis = F.coalesce(*[F.when(tag(k).isNotNull(), f"tag:{k}") for k in specific], by)
        columns |= {f"legal_{mode}": value, f"legal_{mode}_basis": basis}
        columns[f"legal_{mode}_confidence"] = F.when((value == "unknown") | basis.startswith("default:"), "low").when(basis == f"tag:{mode}", "high").otherwise("medium")
    return ways.withColumns(columns)


def add_way_flags(ways: DataFrame) -> DataFrame:
    """Structure of a way from its tags."""
    tags = F.col("tags")
    sidewalk, motorroad, dual = tag("", "sidewalk"), tag("", "motorroad"), tag("", "dual_carriageway")
    oneway = tag("oneway")
    basis = F.when(F.col("highway") == "motorway", "osm_motorway").when(motorroad == "yes", "osm_motorroad")
    conditional = F.array_join(F.array_sort(F.filter(F.map_keys(F.from_json(tags, "map<string,string>")), lambda k: k.endswith(":conditional"))), ";")
    return ways.withColumns(
        {
            "access_basis": basis,
            "is_divided_way": truth(dual == "yes") | truth(oneway.isNotNull() & ~F.lower(oneway).isin("no", "0", "false")),
            "is_separated_legacy": truth(dual == "yes") | truth(F.col("highway").isin("motorway", "trunk") & (oneway == "yes")),
            "is_grade_separated_way": grade_separated(tag("bridge"), tag("tunnel"), tag("layer")),
            "has_sidewalk": truth(sidewalk.isin("both", "left", "right", "yes")),
            "has_cycleway": truth(tag("", "cycleway").isNotNull()),
            "conditional_keys": conditional,
            "is_car_way": truth(F.col("highway").isin(*CAR_HIGHWAYS)) & ~truth(F.col("access").isin(*PRIVATE_ACCESS)) & ~truth(tag("motor_vehicle").isin("private", "no")) & ~truth(tag("", "motorcar").isin("private", "no")),
        }
    )


def roll_up(matches: DataFrame, ways: DataFrame) -> DataFrame:
    """Access by each mode, and structure, of segments from the lengths of the ways they lie on; one row per matched segment.

    A mode of SAFE_SIDE is allowed if any length allows it, the other goes by the greatest length; the confidence is that
    of the weakest way.  Everything comes from one grouping.
    """
    length = F.col("matched_len_m").cast("double")
    legal = [f"legal_{m}{x}" for m in HIERARCHY for x in ("", "_confidence")]
    joined = matches.join(ways.select("osm_way_id", *legal, "has_sidewalk", "access_basis", "is_divided_way"), "osm_way_id", "left")
    of = lambda when: F.coalesce(F.sum(F.when(when, length)), F.lit(0.0))
    sums = [of(F.col(f"legal_{m}") == v).alias(f"_{m}_{v}") for m in HIERARCHY for v in VALUES]
    rungs = [F.min(F.expr(f"CASE legal_{m}_confidence WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END")).alias(f"_{m}_rung") for m in HIERARCHY]
    by_segment = joined.groupBy("segment_id").agg(
        *sums, *rungs, F.sum(length).alias("len"), F.bool_or(F.coalesce("has_sidewalk", F.lit(False))).alias("any_sidewalk"), of(F.col("match_kind") == "exact").alias("len_exact"), F.count_distinct("osm_way_id").alias("n_ways"),
        of(F.col("access_basis").isNotNull()).alias("len_controlled"), of(F.col("is_divided_way")).alias("len_divided"), F.bool_or(F.coalesce(F.col("access_basis") == "osm_motorroad", F.lit(False))).alias("any_motorroad"),
    )
    share = lambda c: F.coalesce(F.try_divide(F.col(c), F.col("len")), F.lit(0.0))
    out = []
    for mode in HIERARCHY:
        safest = F.coalesce(*[F.when(F.col(f"_{mode}_{v}") > 0, v) for v in SAFE_ORDER], F.lit("unknown"))
        most = F.array_max(F.array(*[F.struct(F.round(f"_{mode}_{v}", 6).alias("l"), F.lit(-i).alias("o"), F.lit(v).alias("v")) for i, v in enumerate(VALUES)]))["v"]
        out += [(safest if mode in SAFE_SIDE else most).alias(f"legal_{mode}"), F.expr(f"CASE _{mode}_rung WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END").alias(f"legal_{mode}_confidence")]
        out += [F.round(share(f"_{mode}_{v}"), 6).alias(f"legal_{mode}_{v}_frac") for v in VALUES]
    controlled = share("len_controlled") >= UNANIMOUS
    return by_segment.select(
        "segment_id", *out, "any_sidewalk", F.round(share("len_exact"), 6).alias("exact_frac"), "n_ways", controlled.alias("is_access_controlled"), (share("len_divided") >= CERTAIN_SHARE).alias("is_divided"),
        F.when(controlled, F.when(F.col("any_motorroad"), "osm_motorroad").otherwise("osm_motorway")).alias("access_control_basis"),
    )
