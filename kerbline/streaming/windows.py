"""Windows over events, the same for a table and for a stream.

With a stream, give `late` so that state is dropped once events that late can no longer come.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _watermarked(events: DataFrame, late: str | None) -> DataFrame:
    return events.withWatermark("ts", late) if late else events


def counted(events: DataFrame, length: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """Counts and sums per window and type; tumbling, or sliding by `slide`."""
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    return _watermarked(events, late).groupBy(window, "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


def sessions(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    """Runs of a user's events with less than `gap` between them."""
    return _watermarked(events, late).groupBy(F.session_window("ts", gap).alias("session"), "user_id").agg(F.count(F.lit(1)).alias("n"))
