"""The corpus pipeline: quality, line dedup, near duplicates, decontamination, packing.

Each stage takes the documents that the one before has kept, as a table, and all but the last return the columns of
documents. Labels are read only to fit the quality classifier; the benchmark is what the corpus must not hold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import decontam, jaccard, lines, packing, quality
from tessera.llm._stage import Workspace, packed, unpacked

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the classifier does not reject."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.classify(docs, model).filter("_predicted = 1").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps all documents, without their hosts' boilerplate lines; n_chars is the new length."""
    out = lines.drop_lines(docs)
    length = F.when(F.col("_n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")
    return out.withColumn("n_chars", length).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of linked documents one row, of the least id; of rows without words all."""
    found = jaccard.near_duplicates(docs, count=False)
    space = Workspace(spark, "copies")
    key = ["doc_id", "text_hash"]
    judged = found.filter("n_shingles > 0").groupBy(*key).agg(F.count(F.lit(1)).alias("rows"), F.min("root").alias("root"), F.min("component_id").alias("component_id"))
    judged = space.keep("keyed", judged.withColumn("gone", ~F.col("doc_id").eqNullSafe(F.col("component_id"))))
    # Only where ids repeat do several texts of a class have its least id; of these the first by hash stays.
    least = judged.filter("not gone")
    several = least.groupBy("root").agg(F.min("text_hash").alias("first"), F.count(F.lit(1)).alias("texts")).filter("texts > 1").drop("texts")
    least = least.join(several, "root", "left").withColumn("gone", F.coalesce(F.col("text_hash") != F.col("first"), F.lit(False)))
    judged = judged.filter("gone").unionByName(least.drop("first")).filter("gone or rows > 1")
    judged = space.keep("judged", judged.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "gone"))
    gone, repeated = judged.filter("gone").drop("gone"), judged.filter("not gone").drop("gone")
    named = packed(docs, doc_id=F.col("doc_id"), text_hash=F.xxhash64(F.coalesce("text", F.lit(""))))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))
    kept = named.join(F.broadcast(gone) if gone.count() <= jaccard.BROADCAST_ROWS else gone, same, "left_anti")
    if not repeated.isEmpty():
        again = kept.join(repeated, same, "left_semi").withColumn("_row", F.row_number().over(Window.partitionBy(*key).orderBy(F.xxhash64("row"))))
        kept = kept.join(repeated, same, "left_anti").unionByName(again.filter("_row = 1").drop("_row"))
    return unpacked(kept, docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents without a hit."""
    space = Workspace(spark, "clean")
    found = decontam.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), rows=False)
    bad = space.keep("bad", found.select(F.col("doc_id").alias("_id"), F.col("_text").alias("_hash")))
    bad = F.broadcast(bad) if bad.count() <= decontam.BROADCAST_ROWS else bad
    named = packed(docs, doc_id=F.col("doc_id"), text_hash=F.xxhash64(F.coalesce("text", F.lit(""))))
    return unpacked(named.join(bad, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left_anti"), docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, piece, begin, length, bin_id, bin_offset) of every document that is left."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: The classifier, the join and the packing are beyond SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    space = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES:
        docs = space.keep(name, stage(spark, docs, sf_dir))
    return docs
