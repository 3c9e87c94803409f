"""Lineage cuts that survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; one is made and set only where the session has none and runs on one machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not known.isDefined():
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="millrace-"))
            known = spark.sparkContext._jsc.sc().getCheckpointDir()
        shared = known.get()
    return shared.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: computed once, lineage ends here."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
