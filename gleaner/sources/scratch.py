"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class _UnderWay(threading.local):
    def __init__(self) -> None:
        self.tables: list[list[DataFrame]] = []


#: Tables that each settled() under way in this thread has seen written, the innermost last.
_UNDER_WAY = _UnderWay()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary folder where that is unset and Spark runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: lineage ends here, and a lost executor loses nothing."""
    path = f"{shared_dir(df.sparkSession)}/gleaner/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._gleaner_path = path
    if _UNDER_WAY.tables:
        _UNDER_WAY.tables[-1].append(out)
    return out


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What make gives, written as a table; all tables of materialize that make has had written go, once its own is there."""
    _UNDER_WAY.tables.append([])
    try:
        made = make()
    finally:
        tables = _UNDER_WAY.tables.pop()
    out = materialize(made, name)
    drop(*tables)
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes tables of materialize that no later job reads."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table._gleaner_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
