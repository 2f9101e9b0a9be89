"""Sinks: Parquet by class, CSV lists, and frames ready for export."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import shared_folder


def write_by_class(df: DataFrame, *columns: str, path: str | None = None, rows_per_file: int = 1_000_000) -> str:
    """One folder per class; files roll over at rows_per_file; all or nothing, by Spark's commit protocol."""
    path = path or f"{shared_folder(df.sparkSession)}/kerbline-classes-{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", rows_per_file).partitionBy(*columns).parquet(path)
    return path


def write_list(df: DataFrame, path: str, *order) -> None:
    """A sorted list as one CSV file with a header; lists are short by their nature."""
    df.orderBy(*order).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def export_frame(df: DataFrame, drop_suffix: str = "_legacy") -> DataFrame:
    """Without working columns, and with integers narrowed where the type allows it."""
    kept = [c for c in df.columns if not c.endswith(drop_suffix)]
    return df.select(*[F.col(c).cast("int") if t == "smallint" else F.col(c) for c, t in df.dtypes if c in kept])
