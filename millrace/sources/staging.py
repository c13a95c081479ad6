"""Stage boundaries: a table is written once as Parquet and read, column by column, by every later step."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; in local mode without the setting, one of the driver's."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _local:
            folder = tempfile.mkdtemp(prefix="millrace-stage-")
            atexit.register(shutil.rmtree, folder, True)
            _local[app] = "file://" + folder
        named = _local[app]
    return (named if "://" in named else "file://" + named).rstrip("/")


def new_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/millrace-stage/{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back.

    A lost executor costs nothing then, later scans read only their columns, and the optimiser can't push filters on
    parsed fields down into the parsing, where each reference would evaluate the whole expression again.
    """
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
