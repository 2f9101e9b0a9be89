"""The state of pipeline steps, folded from their events: as a table and as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "step_id string, status string, seq long, n_events long"


def folded(events: DataFrame) -> DataFrame:
    """The latest status of each step (by seq), and how many events it had."""
    return events.groupBy("step_id").agg(F.max_by("status", "seq").alias("status"), F.max("seq").alias("seq"), F.count(F.lit(1)).alias("n_events"))


def _fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    status, seq, n = state.get if state.exists else (None, -1, 0)
    for batch in batches:
        n += len(batch)
        last = batch.loc[batch["seq"].idxmax()]
        if last["seq"] > seq:
            status, seq = last["status"], int(last["seq"])
    state.update((status, seq, n))
    yield pd.DataFrame({"step_id": [key[0]], "status": [status], "seq": [seq], "n_events": [n]})


def folded_stream(events: DataFrame) -> DataFrame:
    """A stream of step states, one row for each step that a batch touched; replayed events change nothing but the count."""
    return events.groupBy("step_id").applyInPandasWithState(_fold, STATE, "status string, seq long, n_events long", "update", GroupStateTimeout.NoTimeout)


def replayed(events: DataFrame, after: int) -> DataFrame:
    """What a subscriber that has seen everything up to `after` still needs, in order."""
    return events.filter(F.col("seq") > after).orderBy("seq")
