"""A local Spark session for tests and the benchmark."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def local_session(cpus: str = "8", memory: str = "8g") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("hirelens")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    conf = spark.sparkContext.getConf()
    if conf.get("spark.checkpoint.dir") is None:
        spark.stop()
        folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        spark = builder.config("spark.checkpoint.dir", folder).getOrCreate()
        spark.sparkContext.setLogLevel("ERROR")
    return spark
