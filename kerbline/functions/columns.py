"""Column expressions that keep a missing value missing, and small rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: tag values that mean above or below the surroundings
BRIDGES = ("boardwalk", "construction", "movable", "viaduct", "yes")
TUNNELS = ("building_passage", "covered", "culvert", "yes")


def clip(x: Column, low: float | None = None, high: float | None = None) -> Column:
    """x held between bounds; null stays null (greatest and least alone would take the bound)."""
    out = x
    if low is not None:
        out = F.greatest(out, F.lit(low))
    if high is not None:
        out = F.least(out, F.lit(high))
    return F.when(x.isNotNull(), out)


def truth(x: Column) -> Column:
    """A condition in which unknown counts as false."""
    return F.coalesce(x, F.lit(False))


def whole(x: Column) -> Column:
    """x as text without decimals, halves to the even neighbour."""
    return F.rint(x).cast("long").cast("string")


def rounded(x: Column, places: int) -> Column:
    """A double of at least 0 to so many places by scaling, as in most engines (Spark's own goes by the shortest decimal text)."""
    scaled = x * F.lit(10.0**places)
    low = F.floor(scaled)
    return (low + F.when(scaled - low >= 0.5, 1).otherwise(0)) / F.lit(10.0**places)


def tag(column: str, key: str | None = None, tags: str = "tags") -> Column:
    """A tag from its own column, or else from the JSON of the rest; blank counts as missing.

    The JSON is parsed only where the quoted key occurs in it.
    """
    own = F.col(column) if key is None else F.when(F.col(tags).contains(f'"{key}"'), F.get_json_object(tags, f"$['{key}']"))
    text = F.trim(own)
    return F.when(text != "", text)


def grade_separated(bridge: Column, tunnel: Column, layer: Column) -> Column:
    """On a bridge, in a tunnel, or on a layer whose first number is not 0."""
    number = F.split(layer, ";")[0].try_cast("double")
    return truth(bridge.isin(*BRIDGES)) | truth(tunnel.isin(*TUNNELS)) | truth(number != 0)
