"""Tables kept between the steps of one query, in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: While a table is written: the shuffle files of the write go with it, as what follows reads the table, and small
#: partitions meet up to the advisory size, as each file of a local or shared folder costs several processes and a seek.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}


BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Arrow batches of at most so many bytes from now on, as a task holds several of them outside the heap and in Python."""
    now = str(spark.conf.get(BATCH)).rstrip("b")
    if now.isdigit() and not 0 < int(now) <= most:
        spark.conf.set(BATCH, str(most))


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; unset, a folder of this machine in local mode and an error elsewhere."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = getattr(spark.sparkContext, "_tessera_folder", None) or f"file://{tempfile.mkdtemp(prefix='tessera-')}"
        spark.sparkContext._tessera_folder = base
    return base


class Workspace:
    """Named Parquet tables under the shared folder. Rereading one cuts the lineage, and survives lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        small_batches(spark)
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self._fs(self.root)[0].deleteOnExit(self._fs(self.root)[1])

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        conf = self.spark.conf
        before = {k: conf.get(k, None) for k in WRITING}
        try:
            for k, v in WRITING.items():
                conf.set(k, v)
            df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.root}/{name}")
        finally:
            for k, v in before.items():
                conf.unset(k) if v is None else conf.set(k, v)
        return self.read(name, df.schema)

    def read(self, name: str, schema=None) -> DataFrame:
        reader = self.spark.read.schema(schema) if schema is not None else self.spark.read
        return reader.parquet(f"{self.root}/{name}")

    def drop(self, name: str) -> None:
        fs, p = self._fs(f"{self.root}/{name}")
        fs.delete(p, True)


def packed(df: DataFrame, **fields) -> DataFrame:
    """The whole row as one struct, row, with the named fields beside it: no column of df can clash with theirs."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), *(f.alias(k) for k, f in fields.items()))


def unpacked(df: DataFrame, columns: list[str], **own) -> DataFrame:
    """The row's columns again, some replaced and some added by own; an own column takes the place of an old one."""
    old = [own.pop(c).alias(c) if c in own else F.col(f"row.`{c}`") for c in columns]
    return df.select(*old, *(f.alias(k) for k, f in own.items()))


def crc32_of_id(column: str = "doc_id"):
    """crc32 of the id's decimal text, as a column; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary"))
