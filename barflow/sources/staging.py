"""Intermediate tables of a plan, written once as Parquet in the shared folder and read by its later parts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def stage_folder(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``. Where that is unset a session of one machine gets a local one; a cluster is refused."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    return f"{base.rstrip('/')}/stages/{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """``df`` as a written table: computed once however often it is used, whole again if an executor is lost."""
    path = stage_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
