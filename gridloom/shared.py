"""Where intermediate tables and files go: the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """What the session names in spark.checkpoint.dir; a temporary folder where that is unset and Spark runs in this process alone, as in tests."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="gridloom-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def new_folder(spark: SparkSession, kind: str) -> str:
    """The name of a folder that isn't there yet, in the shared one."""
    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """The same rows, computed once and written to the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
