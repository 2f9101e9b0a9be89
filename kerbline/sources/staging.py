"""Tables written between steps, so that a step's rows are computed once and survive lost executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only in local mode, and only where that is unset, a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="kerbline-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def remove_table(spark: SparkSession, path: str) -> None:
    """Deletes a written table through Hadoop's file system, whichever store it is in."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def _remove_quietly(spark: SparkSession, path: str) -> None:
    try:
        remove_table(spark, path)
    except Exception:  # the session may have ended before the interpreter does
        return


def written(df: DataFrame, name: str = "stage") -> tuple[DataFrame, str]:
    """The rows of df from a table written for them in the shared folder, and its path.

    This cuts the lineage: a lost executor costs no recomputation of what was written.  The table goes when the
    interpreter ends, or earlier through remove_table().
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/kerbline-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove_quietly, spark, path)
    return spark.read.schema(df.schema).parquet(path), path


def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    return written(df, name)[0]
