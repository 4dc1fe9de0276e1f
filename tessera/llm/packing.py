"""Best-fit packing with conflicts: no bin holds two documents of one source or of one duplicate cluster.

A document's length is its number of words [^\\x20\\x09-\\x0D]+ plus an end mark, so a null or empty text has length 1.
A longer one than a bin fills whole bins with its first pieces, and its last piece, of 1 to CAPACITY, is packed.
Pieces are dealt by hash into shards of about SHARD items, which are packed independently, longest first. A shard
keeps its open bins ordered by residual, each with a bitmap of sources and one of clusters. The search begins at the
first residual that fits and goes on to the next larger ones until the bitmaps allow a bin, so the tightest compatible
bin is found; without one, a new bin opens. The bitmaps are exact: each source and cluster that a shard holds more
than once has a bit of its own there, and the others, which meet nothing, need none.

A cluster is a class of near duplicates where pack() is given classes, and else the documents of equal words, A-Z
lower-cased. A null source is a source of its own. Repeated rows are documents of their own, and copies of each other.
An empty table gives no bins.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text, jaccard
from ._stage import Workspace

CAPACITY, SHARD = 2048, 8192


class Bins:
    """Open bins ordered by residual, and by bin a bitmap of its sources and one of its clusters.

    A source or a cluster is a number under its limit, or -1 if nothing else has it.
    """

    BLOCK = 256

    def __init__(self, capacity: int, sources: int = 256, clusters: int = 256):
        self.capacity, self.open, self.made = capacity, 0, 0
        self.residual, self.order = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.bits = [np.zeros((max(1, -(-n // 64)), 1024), np.uint64) for n in (sources, clusters)]

    def place(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """The bin for an item and its offset there."""
        marks = [(bits[i // 64], np.uint64(1 << (i % 64))) for bits, i in zip(self.bits, (source, cluster), strict=True) if i >= 0]
        found = -1
        at = int(np.searchsorted(self.residual[: self.open], size))
        while at < self.open:
            end = min(at + self.BLOCK, self.open)
            bins = self.order[at:end]
            taken = np.zeros(end - at, bool)
            for word, bit in marks:
                taken |= (word[bins] & bit) != 0
            i = int(taken.argmin())
            if not taken[i]:
                found = at + i
                break
            at = end
        if found >= 0:
            residual, bin_id = int(self.residual[found]), int(self.order[found])
            for x in (self.residual, self.order):
                x[found : self.open - 1] = x[found + 1 : self.open].copy()
            self.open -= 1
        else:
            residual, bin_id = self.capacity, self.made
            self.made += 1
            if bin_id == self.bits[0].shape[1]:
                self.residual, self.order = (np.concatenate([x, np.zeros_like(x)]) for x in (self.residual, self.order))
                self.bits = [np.concatenate([x, np.zeros_like(x)], axis=1) for x in self.bits]
                marks = [(bits[i // 64], np.uint64(1 << (i % 64))) for bits, i in zip(self.bits, (source, cluster), strict=True) if i >= 0]
        for word, bit in marks:
            word[bin_id] |= bit
        if left := residual - size:
            to = int(np.searchsorted(self.residual[: self.open], left))
            for x, v in ((self.residual, left), (self.order, bin_id)):
                x[to + 1 : self.open + 1] = x[to : self.open].copy()
                x[to] = v
            self.open += 1
        return bin_id, self.capacity - residual


def numbered(ids: np.ndarray) -> tuple[list[int], int]:
    """A number for each id that stands more than once, from 0 on, else -1; and how many numbers there are."""
    _, place, count = np.unique(ids, return_inverse=True, return_counts=True)
    number = np.where(count > 1, np.cumsum(count > 1) - 1, -1)
    return number[place].tolist(), int((count > 1).sum())


def near_classes(docs: DataFrame) -> DataFrame:
    """(text_hash, root): the class of near duplicates of each text that is near another."""
    found = jaccard.near_duplicates(docs.select("doc_id", "text"), count=False)
    found = found.filter("root is not null").groupBy("text_hash").agg(F.min("root").alias("root"))
    return found.join(found.groupBy("root").agg(F.count(F.lit(1)).alias("_texts")).filter("_texts > 1").select("root"), "root").select("text_hash", "root")


def items(docs: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """(doc_id, length, source_id, cluster, _spread) of each document; a cluster is its class, or else its words' hash.

    With classes, equal words that are not of a class are those of equal texts.
    """
    text = F.coalesce("text", F.lit(""))
    source = F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull())
    plain = classes is None
    named = docs.select("doc_id", text.alias("text"), source.alias("source_id"), F.xxhash64("doc_id", "text").alias("_spread"), F.xxhash64(text).alias("_hash"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for batch in batches:
            for row, data, starts in _text.pieces(batch.column("text")):
                n = len(starts) - 1
                own = [batch.column(c).slice(row, n) for c in ("doc_id", "source_id", "_spread", "_hash")]
                if plain:
                    rows, words = _text.word_hashes(_text.LOWER[data], starts, cache)
                    count, cluster = np.bincount(rows, minlength=n), _text.sequences(words, rows, n, cache)
                else:
                    space = _text.SPACE[data]
                    first = ~space
                    first[1:] &= space[:-1]
                    # A row's first byte begins a word whatever stands before it.
                    inner = starts[:-1][starts[:-1] < len(data)]
                    first[inner] = ~space[inner]
                    sums = np.concatenate([[0], np.cumsum(first)])
                    count = sums[starts[1:]] - sums[starts[:-1]]
                    cluster = np.where(count > 0, own[3].to_numpy(), 0)
                yield pa.RecordBatch.from_arrays([*own, pa.array(count.astype(np.int64) + 1), pa.array(cluster.astype(np.int64))], ["doc_id", "source_id", "_spread", "_hash", "length", "cluster"])

    cut = named.mapInArrow(run, "doc_id long, source_id long, _spread long, _hash long, length long, cluster long")
    if classes is not None:
        known = classes.select(F.col("text_hash").alias("_hash"), "root")
        known = F.broadcast(known) if known.count() <= jaccard.BROADCAST_ROWS else known
        cut = cut.join(known, "_hash", "left").withColumn("cluster", F.coalesce("root", "cluster")).drop("root")
    return cut.drop("_hash")


def pack(docs: DataFrame, capacity: int = CAPACITY, shard: int = SHARD, classes: DataFrame | None = None) -> DataFrame:
    """(doc_id, piece, begin, length, bin_id, bin_offset): every piece of every document, once.

    begin is the piece's first word in the document. Rows of equal id are packed as documents of their own; two of
    them with equal texts are copies, and so never share a bin. With classes, as near_classes() makes them, no two
    near copies do.
    """
    shards = max(1, math.ceil(docs.count() / shard))
    sized = items(docs, classes).withColumn("full", F.floor((F.col("length") - 1) / capacity).cast("long"))
    last = sized.withColumn("size", F.col("length") - F.col("full") * capacity).withColumn("shard", F.pmod("_spread", F.lit(shards)))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "doc_id", "cluster", "full"], ascending=[False, True, True, True], kind="stable", na_position="first")
        (sources, several), (clusters, copies) = numbered(rows["source_id"].to_numpy()), numbered(rows["cluster"].to_numpy())
        bins = Bins(capacity, several, copies)
        placed = [bins.place(*x) for x in zip(rows["size"].tolist(), sources, clusters, strict=True)]
        base = int(key[0]) << 40
        out, used = [], bins.made
        for doc, full, size, (b, offset) in zip(rows["doc_id"], rows["full"], rows["size"], placed, strict=True):
            out.append((doc, full, full * capacity, size, base + b, offset))
            for k in range(int(full)):
                out.append((doc, k, k * capacity, capacity, base + used, 0))
                used += 1
        return pd.DataFrame(out, columns=["doc_id", "piece", "begin", "length", "bin_id", "bin_offset"]).astype({"doc_id": "Int64"})

    # A shard is bounded by its item count, and hot sources and clusters are spread over all shards.
    parts = last.select("doc_id", "cluster", "full", "size", "source_id", "shard")
    return parts.groupBy("shard").applyInPandas(run, "doc_id long, piece long, begin long, length long, bin_id long, bin_offset long")


def op9_best_fit(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, classes=Workspace(spark, "packing").keep("classes", near_classes(docs)))
