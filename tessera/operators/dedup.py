"""Exact and fuzzy duplicates, and graph clustering. Fuzzy joins are exact: blocks only prune what cannot match."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.relational import keep_one
from tessera.operators.similar import similar as similar


def copies(df: DataFrame, key: Column, order: list) -> DataFrame:
    """df with _key, _first (the group's first row by order has true) and _n."""
    from pyspark.sql import Window

    df = df.withColumn("_key", key)
    w = Window.partitionBy("_key")
    return df.withColumns({"_n": F.count(F.lit(1)).over(w), "_first": F.row_number().over(w.orderBy(*order)) == 1})


def insert_if_absent(old: DataFrame, new: DataFrame, key: str, order: list) -> DataFrame:
    """The rows of new whose key is neither in old nor on an earlier row of new."""
    return keep_one(new, [key], order).join(old.select(key).distinct(), key, "left_anti")


def components(vertices: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """(key, component): the least key of each connected component. edges has a and b.

    Labels go to the least one among the neighbours, then twice as far by pointer jumping; rounds are checkpointed, so
    an executor's loss costs one round.
    """
    labels = vertices.select(F.col(key).alias("v")).distinct().withColumn("label", F.col("v"))
    both = edges.select("a", "b").union(edges.select("b", "a")).distinct().toDF("v", "o")
    spark = vertices.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not spark.sparkContext.master.startswith(("local[", "local ")) and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tessera-"))
    both, labels = both.checkpoint(), labels.checkpoint()
    while True:
        near = both.join(labels.select(F.col("v").alias("o"), "label"), "o").groupBy("v").agg(F.min("label").alias("least"))
        step = labels.join(near, "v", "left").select("v", F.least("label", F.coalesce("least", "label")).alias("to"), "label")
        jump = labels.select(F.col("v").alias("to"), F.col("label").alias("far"))
        step = step.join(jump, "to", "left").select("v", F.least("to", "far").alias("new"), "label").checkpoint()
        changed = step.filter("new <> label").limit(1).count()
        labels = step.select("v", F.col("new").alias("label"))
        if not changed:
            return labels.select(F.col("v").alias(key), F.col("label").alias("component"))


def stars(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(a, b): each key with the least key that has a value in common. Enough for components, and linear in the rows."""
    rows = rows.select(F.col(key).alias("b"), F.col(value).alias("f")).distinct()
    least = rows.groupBy("f").agg(F.min("b").alias("a"))
    return rows.join(least, "f").filter("a <> b").select("a", "b").distinct()


def shared_files(pulls: DataFrame, key: str = "number", files: str = "files") -> DataFrame:
    """(a, b): pairs that touch a file in common."""
    rows = pulls.select(F.col(key).alias("k"), F.explode(files).alias("f")).distinct()
    return rows.alias("x").join(rows.alias("y"), F.expr("x.f = y.f and x.k < y.k")).select(F.col("x.k").alias("a"), F.col("y.k").alias("b")).distinct()
