"""The session that bench and tests use; on a cluster the caller's own session is taken as it is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def local(cores: int | str = "*", partitions: int = 8) -> SparkSession:
    conf = {
        "spark.sql.shuffle.partitions": partitions, "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false",
        "spark.sql.adaptive.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.ui.showConsoleProgress": "false",
    }
    builder = SparkSession.builder.master(f"local[{cores}]").appName("tessera")
    for k, v in conf.items():
        builder = builder.config(k, str(v))
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
