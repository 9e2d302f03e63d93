"""Tables that a job writes for itself, in the folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, list[str]] = {}  # folders by application


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a temporary folder stands in on a local master only: elsewhere machines wouldn't see each other's files."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return f"{tempfile.gettempdir()}/strandline-{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table of the shared folder: cuts lineage, holds what was computed once, and survives lost executors."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> int:
    """Deletes the tables this application has written, for when its results are stored; gives their number."""
    mine = _written.pop(spark.sparkContext.applicationId, [])
    for path in mine:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    return len(mine)
