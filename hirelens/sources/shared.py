"""Folders that every machine of a cluster can reach."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_folder(spark: SparkSession, name: str = "hirelens") -> str:
    """A new path below the folder in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder all executors can reach")
        shared = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, folder: str) -> DataFrame:
    """Write ``df`` to ``folder`` as Parquet and return its scan: cuts the lineage."""
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
