"""The exact Jaccard join of word sets.

Words are 64-bit hashes; equal sets are one node, so copies meet once and are expanded only in the result. Rare words
come first in the order, by levels of the counts of at most COMMON words, the others by hash. Two sets that reach the
threshold meet at the first word that they share, which leaves as many words after it in both as they must share; so an
entry meets only sets that are not too long for its place. Pairs that meet are held against sketches of the whole sets,
bitmaps of odd counts in two to four times as many ranges as a set has words: two bitmaps differ in no more bits than
the sets in words. What passes is verified on the whole sets, which go once to each bucket of pairs.

Sketches of up to SKETCHES bytes go to all tasks; beyond, every pair that meets is verified.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COMMON, LEVEL, HEAD = 1 << 17, 52, 8
CHUNK, HELD, TASK, STEP, SKETCHES, BROADCAST_ROWS = 1 << 20, 1 << 18, 1 << 20, 1 << 20, 1 << 27, 500_000


class Tables:
    """Named Parquet tables in a folder that all executors share."""

    def __init__(self, spark: SparkSession):
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        self.spark, self.root = spark, f"{base or 'file://' + tempfile.mkdtemp(prefix='tessera-')}/similar-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        df.write.parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All hashes of a column of arrays, and where each row's begin; one place more at the end."""
    ends = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False).view(np.uint64), ends


def _nodes(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(mix(h ^ np.uint64(0xD6E8FEB86659FD93)), out=total[1:])
    return mix(total[at[1:]] - total[at[:-1]] + np.diff(at).astype(np.uint64)).view(np.int64)


def _tokens(h: np.ndarray, at: np.ndarray, known: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Each row's words as level and hash, in ascending order."""
    token = h >> np.uint64(64 - LEVEL)
    if len(known):
        place = np.minimum(np.searchsorted(known, h), len(known) - 1)
        token |= np.where(known[place] == h, level[place], np.uint64(0)) << np.uint64(LEVEL)
    ends = at.tolist()
    for a, b in zip(ends, ends[1:], strict=False):
        token[a:b].sort()
    return token


def _size(n: np.ndarray) -> np.ndarray:
    """The 64-bit words of a sketch of n words, a power of two."""
    return 1 << np.maximum(0, np.ceil(np.log2(np.maximum(n, 1) / 32)).astype(np.int64))


def _sketches(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.diff(at)
    size = _size(n)
    first = np.concatenate([[0], np.cumsum(size)])
    bit = (h >> np.uint64(16)) & np.repeat((size * 64 - 1).astype(np.uint64), n)
    out = np.zeros(first[-1], np.uint64)
    np.bitwise_xor.at(out, np.repeat(first[:-1], n) + (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    return out, first


def _binary(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """An array of the bytes of values[first[i]:first[i + 1]]."""
    return pa.Array.from_buffers(pa.binary(), len(first) - 1, [None, pa.py_buffer((first * 8).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _flat(column: pa.Array) -> np.ndarray:
    column = column.cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    return np.frombuffer(column.buffers()[2], np.int64, (ends[-1] - ends[0]) // 8, ends[0]).copy() if len(column) and ends[-1] > ends[0] else np.zeros(0, np.int64)


def _often(sets: DataFrame) -> DataFrame:
    """(word, count) of the words that a run of about CHUNK words holds more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def counted() -> pa.RecordBatch:
            word, count = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(word[count > 1].view(np.int64)), pa.array(count[count > 1].astype(np.int64))], ["word", "count"])

        for batch in batches:
            held.append(_sets(batch.column("s"))[0].copy())
            if sum(map(len, held)) >= CHUNK:
                yield counted()
        if held:
            yield counted()

    return sets.select("s").mapInArrow(run, "word long, count long").groupBy("word").agg(F.sum("count").alias("count"))


class Sketches:
    """Sketches and first common words of all nodes, by level of size."""

    def __init__(self, table: pa.Table):
        node = table["node"].to_numpy()
        order = np.argsort(node)
        self.node, size = node[order], _size(table["n"].to_numpy()[order])
        self.head = np.zeros((len(node), HEAD), np.uint64)
        head, sketch = table["head"].combine_chunks(), table["sketch"].combine_chunks()
        length = np.array([len(x.as_buffer()) // 8 if x.is_valid else 0 for x in head], np.int64)
        self.head[np.repeat(np.arange(len(node)), length), np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)] = _flat(head).view(np.uint64)
        self.head = self.head[order]
        own = _size(table["n"].to_numpy())
        first, values = np.concatenate([[0], np.cumsum(own)])[:-1][order], _flat(sketch).view(np.uint64)
        self.size, self.place, self.rows = size, np.zeros(len(node), np.int64), {}
        for s in np.unique(size).tolist():
            at = np.flatnonzero(size == s)
            self.place[at] = np.arange(len(at))
            self.rows[s] = values[first[at][:, None] + np.arange(s)]

    def near(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Whether the sketches of nodes a and b differ in at most so many bits."""
        keep, x, y = np.zeros(len(a), bool), self.size[a], self.size[b]
        for pair in np.unique(x << 32 | y).tolist():
            p, q = pair >> 32, pair & 0xFFFFFFFF
            at = np.flatnonzero((x == p) & (y == q))
            step = max(1, (1 << 21) // max(p, q))
            for i in range(0, len(at), step):
                k = at[i : i + step]
                u, v = self.rows[p][self.place[a[k]]], self.rows[q][self.place[b[k]]]
                while u.shape[1] > v.shape[1]:
                    u = u[:, : u.shape[1] // 2] ^ u[:, u.shape[1] // 2 :]
                while v.shape[1] > u.shape[1]:
                    v = v[:, : v.shape[1] // 2] ^ v[:, v.shape[1] // 2 :]
                keep[k] = np.bitwise_count(u ^ v).sum(1, dtype=np.int64) <= most[k]
        return keep

    def first(self, a: np.ndarray, b: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Whether no earlier word is among the first common ones of both; at such a word the pair has met already."""
        before, right = np.zeros(len(a), bool), list(self.head[b].T)
        for i in range(self.head.shape[1]):
            x = self.head[a, i]
            same = np.zeros(len(a), bool)
            for y in right:
                same |= x == y
            before |= same & (x > 0) & (x < token)
        return ~before


def similar(df: DataFrame, key: str, words: Column, least: float, same: list[str] | None = None) -> DataFrame:
    """(a, b, similarity), a < b: pairs of rows whose word sets have at least this Jaccard similarity, within equal same."""
    spark, share = df.sparkSession, least / (1 + least)
    tables = Tables(spark)
    within = [x for c in same or [] for x in (F.col(c).isNull(), F.col(c))]
    sets = df.select(F.col(key).alias("k"), F.array_distinct(F.transform(words, lambda w: F.xxhash64(w, *within))).alias("s"))
    sets = tables.keep("sets", sets.filter("k is not null and size(s) > 0"))

    often = tables.keep("often", _often(sets).withColumn("level", F.least(F.greatest(F.floor(F.log2("count") * 64), F.lit(1)), F.lit((1 << 64 - LEVEL) - 1)).cast("long")))
    floor, total = 1 << 30, 0
    for level, count in sorted(often.groupBy("level").count().collect(), reverse=True):  # at most as many rows as levels
        total += count
        if total > COMMON:
            break
        floor = level
    found = often.filter(F.col("level") >= floor).select("word", "level").toArrow()
    word, level = found["word"].to_numpy().view(np.uint64), found["level"].to_numpy().astype(np.uint64)
    order = np.argsort(word)
    common = spark.sparkContext.broadcast((word[order], level[order]))

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, at = _sets(batch.column("s"))
            n, sketch, token = np.diff(at), _sketches(h, at), _tokens(h, at, *common.value)
            often = np.concatenate([[0], np.cumsum(token >> np.uint64(LEVEL) > 0)])  # those with a level are a row's last
            many = often[at[1:]] - often[at[:-1]]
            taken = np.minimum(many, HEAD)
            ends = np.concatenate([[0], np.cumsum(taken)])
            head = token[np.repeat(at[1:] - many, taken) + np.arange(ends[-1]) - np.repeat(ends[:-1], taken)]
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(_nodes(h, at)), pa.array(n), _binary(*sketch), _binary(head, ends)], ["k", "node", "n", "sketch", "head"])

    marks = tables.keep("marks", sets.mapInArrow(marked, f"k {sets.schema['k'].dataType.simpleString()}, node long, n long, sketch binary, head binary"))
    members = marks.select("k", "node").distinct()
    nodes = tables.keep("nodes", marks.groupBy("node").agg(F.min("k").alias("k"), F.max("n").alias("n"), F.max("sketch").alias("sketch"), F.max("head").alias("head")))
    entries, held = nodes.agg(F.sum(F.col("n") * (1 - least) + 1), F.sum(F.length("sketch") + 8 * HEAD + 24)).first()
    known = spark.sparkContext.broadcast(Sketches(nodes.select("node", "n", "sketch", "head").toArrow()) if (held or 0) <= SKETCHES else None)
    deal = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(deal, int((entries or 0) // TASK) + 1)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def rows() -> pa.RecordBatch:
            token, node, spot = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            bucket = (mix(token) % np.uint64(8 * parts)).astype(np.int32)
            order = np.argsort(bucket)
            found, first = np.unique(bucket[order], return_index=True)
            first = np.append(first, len(order))
            return pa.RecordBatch.from_arrays([pa.array(found), *(_binary(x[order], first) for x in (token, node, spot))], ["bucket", "token", "node", "spot"])

        for batch in batches:
            h, at = _sets(batch.column("s"))
            n, node, token = np.diff(at), _nodes(h, at), _tokens(h, at, *common.value)
            row = np.repeat(np.arange(len(n)), n)
            place = np.arange(len(h)) - at[row]
            first = np.flatnonzero(place < (n - np.ceil(least * n - 1e-9).astype(np.int64) + 1)[row])
            held.append((token[first], node[row[first]], n[row[first]] << 32 | place[first]))
            if sum(len(x[0]) for x in held) >= HELD:
                yield rows()
        if held:
            yield rows()

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [tuple(_flat(batch.column(c)) for c in ("token", "node", "spot")) for batch in batches]
        if not held:
            return
        token, node, spot = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        order = np.lexsort((node, spot >> 32, token))
        token, node, spot = token[order].view(np.uint64), node[order], spot[order]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
        token, node, n, at = token[new], node[new], spot[new] >> 32, spot[new] & 0xFFFFFFFF
        group = np.concatenate([[0], np.cumsum(token[1:] != token[:-1])]) << 32
        # From here on: the longest set that may still share enough with the rest of this one.
        top = np.minimum(n / least, (n - at) / share - n) + 1e-6
        count = np.maximum(np.searchsorted(group | n, group | np.maximum(top, 0).astype(np.int64), "right") - np.arange(len(n)) - 1, 0)
        total = np.concatenate([[0], np.cumsum(count)])
        table = known.value
        index = np.searchsorted(table.node, node) if table else None
        i = 0
        while i < len(n):
            j = max(i + 1, int(np.searchsorted(total, total[i] + STEP, "right")) - 1)
            c = count[i:j]
            if total[j] > total[i]:
                a = np.repeat(np.arange(i, j), c)
                b = a + 1 + np.arange(len(a)) - np.repeat(total[i:j] - total[i], c)
                need = np.ceil(share * (n[a] + n[b]) - 1e-9).astype(np.int64)
                ok = (n[a] - at[a] >= need) & (n[b] - at[b] >= need)
                a, b, need = a[ok], b[ok], need[ok]
                if table:
                    ok = table.near(index[a], index[b], n[a] + n[b] - 2 * need)
                    a, b = a[ok], b[ok]
                    ok = table.first(index[a], index[b], token[a])
                    a, b = a[ok], b[ok]
                x, y = np.minimum(node[a], node[b]), np.maximum(node[a], node[b])
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.array(token[a].view(np.int64))], ["x", "y", "token"])
            i = j

    meet = sets.select("s").mapInArrow(dealt, "bucket int, token binary, node binary, spot binary").repartition(parts, "bucket")
    pairs = meet.select("token", "node", "spot").mapInArrow(met, "x long, y long, token long").groupBy("x", "y").agg(F.min("token").alias("token"))
    pairs = tables.keep("pairs", pairs.select(F.pmod(F.xxhash64("token"), F.lit(deal)).cast("int").alias("bucket"), "x", "y"))

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole: dict[int, np.ndarray] = {}
        held = []
        for batch in batches:
            x, y, s = batch.column("x"), batch.column("y"), batch.column("s")
            pair = y.is_valid().to_numpy(zero_copy_only=False)
            held.append((x.drop_null().to_numpy(), y.drop_null().to_numpy()))
            h, at = _sets(s.filter(pa.array(~pair)))
            for i, node in enumerate(_nodes(h, at).tolist()):
                whole[node] = np.sort(h[at[i] : at[i + 1]])
        for x, y in held:
            both, n = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
            for i, (p, q) in enumerate(zip(x.tolist(), y.tolist(), strict=True)):
                u, v = whole[p], whole[q]
                both[i], n[i] = (v[np.minimum(np.searchsorted(v, u), len(v) - 1)] == u).sum(), len(u) + len(v)
            value = both / (n - both)
            ok = value >= least
            yield pa.RecordBatch.from_arrays([pa.array(x[ok]), pa.array(y[ok]), pa.array(value[ok])], ["x", "y", "similarity"])

    wanted = pairs.select("bucket", F.col("x").alias("node")).union(pairs.select("bucket", "y")).distinct()
    wanted = tables.keep("wanted", wanted.join(nodes.select("node", "k"), "node"))
    small = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    none = F.lit(None).cast("long")
    texts = sets.join(small, "k").select("bucket", none.alias("x"), none.alias("y"), "s")
    links = texts.unionByName(pairs.select("bucket", "x", "y", F.lit(None).cast("array<bigint>").alias("s")))
    links = tables.keep("links", links.repartition(deal, "bucket").select("x", "y", "s").mapInArrow(verified, "x long, y long, similarity double"))

    a, b = members.select(F.col("k").alias("p"), F.col("node").alias("x")), members.select(F.col("k").alias("q"), F.col("node").alias("y"))
    between = links.join(a, "x").join(b, "y").filter("p <> q").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "similarity")
    copies = a.join(b, F.expr("x = y and p < q")).select(F.col("p").alias("a"), F.col("q").alias("b"), F.lit(1.0).alias("similarity"))
    return between.unionByName(copies)
