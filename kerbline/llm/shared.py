"""What the operators share: tables in the shared work folder, and small column helpers."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.staging import remove_table, staged, written

__all__ = ["cut", "free_name", "null_key", "release_memory", "remove_table", "salted_hash", "written"]

cut = staged


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores before it until no column of df is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def release_memory() -> None:
    """Hands a Python worker's free memory back to the system, as idle workers stay beside the next stages."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def salted_hash(seed: int, *columns: Column) -> Column:
    """60 bits of md5 over the seed and the columns, as a long from 0 up to 2^60 - 1; null counts as empty."""
    parts = [F.lit(str(seed)), *(F.coalesce(c.cast("string"), F.lit("")) for c in columns)]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 15), 16, 10).cast("long")


def null_key(column: Column) -> Column:
    """A string that is never null and that keeps null apart from every other value."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit(""))
