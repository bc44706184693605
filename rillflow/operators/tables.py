"""Tables that cut lineage: written once to the folder that the cluster shares, so a later job reads what an earlier one saw."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session (``spark.checkpoint.dir``). Where none is set: one of our own if driver and executors are one process, else an error."""
    own = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if own:
        return own
    if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = getattr(spark, "_rillflow_shared", None)
    if made is None:
        made = spark._rillflow_shared = f"file://{tempfile.mkdtemp(prefix='rillflow-')}"
    return made


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: computed once, no lineage behind it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/rillflow/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
