"""Token-ID output: documents as token ids in rANS blocks (see rans), in ascending id order, and reading them back.

Texts are range-partitioned by id and encoded once, into a table in the shared folder. The frequency table
counts all of it; then every task codes its rows into independent blocks. Parquet carries the blocks, a directory
for each range, so Spark's commit protocol and any file system that Spark can write apply.

A null text is empty and has the end id only; a null id comes first; rows of equal id are ordered by their text's hash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe, rans
from ._stage import Workspace

END = 2
#: A block closes at so many ids; a longer document has a block of its own.
BLOCK = 1 << 18


def encode(docs: DataFrame, path: str, end: int = END) -> DataFrame:
    """(part, seq, doc_id, ids), range by range and in order within each; ids are little-endian uint16, or uint32."""
    ordered = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_tie", F.xxhash64("text"))
    ordered = ordered.repartitionByRange(F.col("doc_id").asc_nulls_first(), "_tie").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "_tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        cache, part, seq = {}, TaskContext.get().partitionId(), 0
        for batch in batches:
            for row, ids, at in bpe.encode_column(batch.column("text"), path, end, cache):
                n = len(at) - 1
                wide = np.maximum.reduceat(ids, at[:-1]) >= 65536
                raw = [ids[at[i] : at[i + 1]].astype("<u4" if wide[i] else "<u2").tobytes() for i in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), pa.array(np.arange(seq, seq + n)), batch.column("doc_id").slice(row, n), pa.array(np.diff(at).astype(np.int64)), pa.array(raw, pa.binary())], ["part", "seq", "doc_id", "n_tokens", "ids"])
                seq += n

    return ordered.select("doc_id", "text").mapInArrow(run, "part int, seq long, doc_id long, n_tokens long, ids binary")


def _ids(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype(np.uint32)


def frequencies(encoded: DataFrame) -> rans.Table:
    """The table over all ids; each task sends a row for each distinct id at most, the driver gets the vocabulary's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for raw, n in zip(batch.column("ids").to_pylist(), batch.column("n_tokens").to_pylist(), strict=True):
                count = np.bincount(_ids(raw, n))
                if len(count) > len(total):
                    total = np.concatenate([total, np.zeros(len(count) - len(total), np.int64)])
                total[: len(count)] += count
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "count"])

    found = encoded.select("n_tokens", "ids").mapInArrow(run, "id long, count long").groupBy("id").agg(F.sum("count").alias("count")).toArrow()
    return rans.Table(found["id"].to_numpy(), found["count"].to_numpy()) if len(found) else rans.Table(np.array([END]), np.array([1]))


def blocks(encoded: DataFrame, table: rans.Table) -> DataFrame:
    """(part, seq, n_docs, n_tokens, payload): blocks of consecutive documents of one range."""
    shared = encoded.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0

        def close():
            ids = np.concatenate([_ids(raw, n) for *_, n, raw in rows])
            nulls = np.array([d is None for _, _, d, _, _ in rows])
            payload = rans.pack(ids, np.array([d or 0 for _, _, d, _, _ in rows], np.int64), nulls, np.array([n for *_, n, _ in rows]), shared.value)
            return pa.RecordBatch.from_arrays([pa.array([rows[0][0]], pa.int32()), pa.array([rows[0][1]], pa.int64()), pa.array([len(rows)], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([payload], pa.binary())], ["part", "seq", "n_docs", "n_tokens", "payload"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("part", "seq", "doc_id", "n_tokens", "ids")), strict=True):
                if rows and (size + row[3] > BLOCK or row[0] != rows[-1][0] or row[1] != rows[-1][1] + 1):
                    yield close()
                    rows, size = [], 0
                rows.append(row)
                size += row[3]
        if rows:
            yield close()

    return encoded.select("part", "seq", "doc_id", "n_tokens", "ids").mapInArrow(run, "part int, seq long, n_docs long, n_tokens long, payload binary")


def write(docs: DataFrame, path: str, folder: str, space: Workspace, end: int = END) -> rans.Table:
    """Writes the blocks under folder/blocks and the frequency table under folder/table."""
    encoded = space.keep("ids", encode(docs, path, end))
    table = frequencies(encoded)
    spark = docs.sparkSession
    counts = [(int(s), int(f)) for s, f in zip(table.symbols, table.freq, strict=True)]
    spark.createDataFrame(counts, "symbol long, frequency long").coalesce(1).write.mode("overwrite").parquet(f"{folder}/table")
    blocks(encoded, table).write.mode("overwrite").partitionBy("part").option("compression", "uncompressed").parquet(f"{folder}/blocks")
    space.drop("ids")
    return table


def read_table(spark: SparkSession, folder: str) -> rans.Table:
    found = spark.read.parquet(f"{folder}/table").toArrow()
    return rans.Table(found["symbol"].to_numpy(), found["frequency"].to_numpy())


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, all decoded from the files; start counts the ids before it."""
    shared = spark.sparkContext.broadcast(read_table(spark, folder))
    files = spark.read.schema("seq long, n_docs long, n_tokens long, payload binary, part int").parquet(f"{folder}/blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        slots = table.slots()
        for batch in batches:
            for part, seq, raw in zip(batch.column("part").to_pylist(), batch.column("seq").to_pylist(), batch.column("payload"), strict=True):
                block = rans.Block(raw.as_py())
                ids = block.ids(table, slots).astype("<u4")
                ends = np.cumsum(block.sizes.astype(np.int64))
                raw_ids, n = ids.tobytes(), len(ends)
                begin = ends - block.sizes
                crc = [zlib.crc32(raw_ids[4 * a : 4 * b]) for a, b in zip(begin.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, seq)), pa.array(block.doc_ids.astype(np.int64), mask=block.nulls), pa.array(begin), pa.array(block.sizes.astype(np.int64)), pa.array(np.array(crc, np.int64))], ["part", "seq", "doc_id", "begin", "n_tokens", "ids_crc32"])

    rows = files.select("part", "seq", "payload").mapInArrow(run, "part int, seq long, doc_id long, begin long, n_tokens long, ids_crc32 long")
    # A range has as many blocks as fit one task, and there are as many ranges as shuffle partitions.
    inner = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    sizes = files.select("part", "seq", "n_tokens")
    ranges = sizes.groupBy("part").agg(F.sum("n_tokens").alias("_all"))
    outer = F.sum("_all").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    ranges = ranges.select("part", F.coalesce(outer, F.lit(0)).alias("_range"))
    first = sizes.withColumn("_inner", F.coalesce(inner, F.lit(0))).join(F.broadcast(ranges), "part").select("part", "seq", (F.col("_range") + F.col("_inner")).alias("_block"))
    return rows.join(first, ["part", "seq"]).select("doc_id", (F.col("_block") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32")


def op3_token_rans(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    space = Workspace(spark, "tokens")
    write(docs, public_tokenizers.path("byte_bpe_50k.json"), space.root, space)
    return read(spark, space.root)
