"""Tables that cut a plan's lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where that is unset and Spark local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="tallymark-")
        found = _own[app]
    return found.rstrip("/")


def kept(df: DataFrame) -> DataFrame:
    """df written as Parquet in the shared folder and read again: iterations neither grow their plan nor repeat their work."""
    path = f"{shared_folder(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame) -> DataFrame:
    """df as a side of a join that is shuffled whatever Spark takes its size to be.

    That is the size of the files that it is scanned from, and neither what they hold when they compress a hundredfold, as
    pixels do, nor what is exploded from them; a broadcast chosen by it is gathered in the driver.
    """
    return df.hint("merge")
