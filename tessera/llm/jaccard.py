"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

A document's set holds the hashes of its distinct GRAM-word shingles; two sets link if their Jaccard similarity is at
least PERCENT. Equal sets are one node, so copies meet once. A first pass over all texts finds, by runs of about CHUNK
shingles, those that a run holds more than once, with their counts; of these at most COMMON, the most frequent, have a
level, which grows with the count. A shingle's token is its level before 52 bits of its hash, and tokens in ascending
order are the shingles' order: rare ones first. Any such order is right; a better one leaves fewer candidates.
Two sets that link share one of the first n - ceil(0.8 n) + 1 shingles, the prefix, so only prefix tokens that two
nodes share give candidates. Candidates pass the length filter, the positional filter (what can still follow the
places of the shared token) and the suffix filter (the hash space is cut into ranges, PARTS or half as many as a set
has shingles, and the sum of the smaller counts of each range bounds the overlap; before that, a node's bitmap of odd counts in SKETCH ranges does: two
bitmaps differ in no more bits than the sets in shingles). The rest are verified once on the whole sets.

Prefix entries are shuffled once, as arrays by bucket of token, to partitions of about TASK entries, which keep those
that share a token; the entries of a token with a level, which may be hot, are dealt by SALTS besides, and all kept.

all_links() verifies every candidate. near_duplicates() needs only the classes: the nodes of a token that stands in at
most GROUP rows meet at once, the nodes of another meet that token's hubs first, the classes found so far are
contracted, and then only candidates between different classes are left; all of those are verified too. No link between
two classes is lost, and a large group of near copies costs a multiple of its size instead of its square.

degrees() adds every document's number of links. All links are inside classes, and where not all pairs of a class are
links that were verified, all its pairs are counted: the sets of two blocks of at most BLOCK nodes meet in one task, as
matrices of nodes by shingles, whose product has all overlaps. No pair becomes a row, and copies count as many times.

A null or empty text, or one without words, has an empty set and links with nothing. A text of fewer than GRAM
words has its whole word sequence as its one shingle. Nodes are told apart by a 64-bit hash of their set. Repeated rows
are rows of one node. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _text
from ._stage import Workspace

GRAM, PERCENT, PARTS, SKETCH = 5, 80, 128, 1024
CHUNK, COMMON, SALTS, TASK, HELD = 1 << 20, 1 << 17, 64, 1 << 20, 1 << 18
BITMAP = [f"b{i}" for i in range(SKETCH // 64)]
#: A token's level stands above so many bits of the hash.
LEVEL = 52
#: Tables of node ids up to so many rows are broadcast; beyond, their joins shuffle.
BROADCAST_ROWS = 500_000
#: Links up to so many are joined to classes in the driver: 4 MB.
LINKS = 1 << 18
#: A pair with a bitmap counts as so many such rows.
WIDE = 8
#: Nodes of a class that are held against as many others at once, and shingles in one product of matrices.
BLOCK, WIDTH = 512, 4096
#: Rows of a token up to which all its pairs are made within one row.
GROUP = 32
#: A round's orders, in each of which a token's least node is a hub; and the hubs that a node is verified with.
SEEDS = (
    (0, 0x7FFFFFFFFFFFFFFF, 0x2545F4914F6CDD1D, 0x5851F42D4C957F2D), (0x14057B7EF767814F, 0x369DEA0F31A53F85, 0x106689D45497FDB5, 0x3C6EF372FE94F82B),
    (0x0F1BBCDCBFA53E0B, 0x5BE0CD19137E2179, 0x1F83D9ABFB41BD6B, 0x510E527FADE682D1), (0x6A09E667F3BCC908, 0x4528E638D01377BE, 0x38D01377BE5466CF, 0x082EFA98EC4E6C89),
)
BEST = 3
#: An entry between classes carries its node's least tokens, so many.
HEAD = 32
#: After the second, hub rounds go on while the candidates between classes outnumber the entries this many times, and
#: SPARE, and a round takes off a fifth of them.
TIMES, SPARE = 4, 100_000


def shingles(data: np.ndarray, starts: np.ndarray, cache: dict) -> tuple[np.ndarray, np.ndarray]:
    """The sets' hashes and the row of each, ordered by row and hash."""
    rows, words = _text.word_hashes(_text.LOWER[data], starts, cache)
    n = np.bincount(rows, minlength=len(starts) - 1)
    h, at = _text.grams(words, rows, GRAM)
    r = rows[at]
    if ((n > 0) & (n < GRAM)).any():
        found, owner = [h], [r]
        for k in range(1, GRAM):
            h, at = _text.grams(words, rows, k)
            whole = n[rows[at]] == k
            found.append(h[whole])
            owner.append(rows[at][whole])
        h, r = np.concatenate(found), np.concatenate(owner)
        order = np.argsort(r, kind="stable")
        h, r = h[order], r[order]
    _sort_rows(h, _text.bounds(r, len(starts) - 1))
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    return h[new], r[new]


def _sort_rows(values: np.ndarray, at: np.ndarray) -> None:
    """Sorts values[at[i]:at[i + 1]] in place, for each i."""
    ends = at.tolist()
    for a, b in zip(ends, ends[1:], strict=False):
        if b - a > 1:
            values[a:b].sort()


def _nodes(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of each row's set: the sum of its mixed hashes, and their number."""
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(_text.mix(h ^ np.uint64(0xD6E8FEB86659FD93)), out=total[1:])
    return _text.mix(total[at[1:]] - total[at[:-1]] + np.diff(at).astype(np.uint64)).view(np.int64)


def _prefix(n: np.ndarray) -> np.ndarray:
    return np.where(n > 0, n - (PERCENT * n + 99) // 100 + 1, 0)


def _parts(h: np.ndarray) -> bytes:
    """How many of a set's hashes stand in each of about half as many ranges, at least PARTS; empty if one has too many.

    The ranges are of the low bits, so that those of a set of another size come from adding halves.
    """
    size = max(PARTS, 1 << max(0, (len(h) - 1).bit_length() - 1))
    count = np.bincount((h & np.uint64(size - 1)).astype(np.int64), minlength=size)
    return count.astype(np.uint16).tobytes() if count.max() < 65536 else b""


def _marks(docs: DataFrame) -> DataFrame:
    """A row (doc_id, text_hash, node, n, bitmap) for each document, and (shingle, count) for each shingle that a run of
    about CHUNK shingles holds more than once."""
    names = ["doc_id", "text_hash", "node", "n", *BITMAP, "shingle", "count"]
    first = len(names) - 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        held: list[np.ndarray] = []

        def often() -> pa.RecordBatch:
            every = np.concatenate(held) if held else np.zeros(0, np.uint64)
            held.clear()
            every.sort()
            new = np.flatnonzero(np.concatenate([np.ones(min(1, len(every)), bool), every[1:] != every[:-1]]))
            count = np.diff(np.append(new, len(every)))
            found, count = every[new[count > 1]], count[count > 1]
            return pa.RecordBatch.from_arrays([*([pa.nulls(len(found), pa.int64())] * first), pa.array(found.view(np.int64)), pa.array(count)], names)

        for batch in batches:
            for row, data, starts in _text.pieces(batch.column("text"), rows=1024):
                rows = len(starts) - 1
                h, r = shingles(data, starts, cache)
                at = _text.bounds(r, rows)
                n = np.diff(at)
                odd = np.bincount(r * SKETCH + ((h >> np.uint64(8)) & np.uint64(SKETCH - 1)).astype(np.int64), minlength=rows * SKETCH).astype(np.uint8) & 1
                bitmap = np.packbits(odd.reshape(rows, SKETCH), axis=1).view(np.int64)
                own = [batch.column("doc_id").slice(row, rows), batch.column("text_hash").slice(row, rows), pa.array(_nodes(h, at), mask=n == 0), pa.array(n.astype(np.int64)), *(pa.array(bitmap[:, i].copy()) for i in range(len(BITMAP)))]
                yield pa.RecordBatch.from_arrays([*own, *([pa.nulls(rows, pa.int64())] * 2)], names)
                held.append(h)
                if sum(map(len, held)) >= CHUNK:
                    yield often()
        yield often()
        _text.release()

    return docs.mapInArrow(run, ", ".join(f"{x} long" for x in names))


def _entries(docs: DataFrame, common: np.ndarray, levels: np.ndarray, buckets: int) -> DataFrame:
    """(bucket, token, node, spot): the prefix entries of all documents, as arrays of 64-bit numbers by bucket.

    An entry is a prefix shingle's token, its node, and n << 32 | at: the set's size and the shingle's place in the
    order. Equal tokens are in one bucket; those with a level in SALTS at most. common has the sorted hashes of
    frequent shingles, levels their levels, of at least 1; all others have level 0.
    """
    maybe = np.zeros(1 << 20, bool)
    maybe[(common >> np.uint64(44)).astype(np.int64)] = True
    shared = docs.sparkSession.sparkContext.broadcast((common, levels.astype(np.uint64), maybe))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, (known, level, maybe) = {}, shared.value
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def dealt() -> pa.RecordBatch:
            token, node, spot = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            salt = np.where(token >> np.uint64(LEVEL) > 0, node.view(np.uint64) % np.uint64(SALTS), np.uint64(0))
            bucket = (_text.mix(token + salt * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket)
            found, first = np.unique(bucket[order], return_index=True)
            offsets = pa.py_buffer((np.append(first, len(order)) * 8).astype(np.int32))
            arrays = [pa.Array.from_buffers(pa.binary(), len(found), [None, offsets, pa.py_buffer(x[order])]) for x in (token, node, spot)]
            return pa.RecordBatch.from_arrays([pa.array(found), *arrays], ["bucket", "token", "node", "spot"])

        for batch in batches:
            for _, data, starts in _text.pieces(batch.column("text")):
                h, r = shingles(data, starts, cache)
                at = _text.bounds(r, len(starts) - 1)
                n, node = np.diff(at), _nodes(h, at)
                token = h >> np.uint64(64 - LEVEL)
                some = np.flatnonzero(maybe[(h >> np.uint64(44)).astype(np.int64)])
                if len(some):
                    place = np.minimum(np.searchsorted(known, h[some]), len(known) - 1)
                    token[some] |= np.where(known[place] == h[some], level[place], np.uint64(0)) << np.uint64(LEVEL)
                _sort_rows(token, at)
                place = np.arange(len(h)) - at[r]
                first = np.flatnonzero(place < _prefix(n)[r])
                owner = r[first]
                held.append((token[first], node[owner], n[owner].astype(np.int64) << 32 | place[first]))
                if sum(len(x[0]) for x in held) >= HELD:
                    yield dealt()
        if held:
            yield dealt()
        _text.release()

    return docs.select("text").mapInArrow(run, "bucket int, token binary, node binary, spot binary")


def _shared(dealt: DataFrame) -> DataFrame:
    """(token, node, n, at): the entries whose token stands more than once in their partition, or has a level.

    A partition holds about TASK entries: no token without a level is frequent, and the others are dealt by salts.
    """

    def flat(column: pa.Array) -> np.ndarray:
        ends = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)
        return np.frombuffer(column.buffers()[2], np.int64, (ends[-1] - ends[0]) // 8, ends[0]) if len(column) else np.zeros(0, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [tuple(flat(batch.column(c)).copy() for c in ("token", "node", "spot")) for batch in batches]
        if not held:
            return
        token, node, spot = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        order = np.argsort(token)
        same = np.flatnonzero(token[order[1:]] == token[order[:-1]])
        keep = token.view(np.uint64) >> np.uint64(LEVEL) > 0
        keep[order[same]] = keep[order[same + 1]] = True
        token, node, spot = token[keep], node[keep], spot[keep]
        del order, same, keep
        yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(node), pa.array((spot >> 32).astype(np.int32)), pa.array((spot & 0xFFFFFFFF).astype(np.int32))], ["token", "node", "n", "at"])
        del token, node, spot
        _text.release()

    return dealt.select("token", "node", "spot").mapInArrow(run, "token long, node long, n int, at int")


def _overlap(a: Column, b: Column) -> Column:
    """The least overlap of two sets of so many shingles that link."""
    return F.ceil(F.lit(PERCENT) * (a + b) / F.lit(100 + PERCENT)).cast("long")


def _close(n: Column, m: Column) -> Column:
    """The length filter."""
    return 100 * F.least(n, m) >= PERCENT * F.greatest(n, m)


def _differ(a: str, b: str) -> Column:
    """Bits in which two bitmaps differ; a and b precede the columns' names."""
    return sum((F.bit_count(F.col(f"{a}{x}").bitwiseXOR(F.col(f"{b}{x}"))) for x in BITMAP), F.lit(0))


def _may_differ(n: Column, m: Column) -> Column:
    """The most shingles that stand in only one of two sets of so many that link."""
    return n + m - 2 * _overlap(n, m)


def _may_link(x: Column, y: Column) -> Column:
    """The length and the positional filter for two entries (node, n, at) of one token.

    The shingle and what follows it in either set may be shared; of those before it, as many as in the shorter run.
    """
    n, m = x["n"], y["n"]
    return _close(n, m) & (F.least(n - x["at"], m - y["at"]) + F.least(x["at"], y["at"]) >= _overlap(n, m))


class Join:
    """One run of the join; its tables are in a workspace of its own."""

    def __init__(self, docs: DataFrame):
        self.docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
        self.space = Workspace(docs.sparkSession, "jaccard")
        marks = self.space.keep("marks", _marks(self.docs))
        common, levels = self._common(marks.filter("shingle is not null"))
        held = marks.filter("shingle is null and node is not null")
        self.marks = marks.filter("shingle is null").select("doc_id", "text_hash", "node", "n")
        # A node stands for one text, that of its least id; the texts of its other rows are not read again.
        nodes = held.groupBy("node").agg(F.min("doc_id").alias("doc"), F.min_by("text_hash", F.coalesce("doc_id", F.lit((1 << 63) - 1))).alias("hash"), F.max("n").alias("n"), *(F.max(b).alias(b) for b in BITMAP))
        self.nodes = self.space.keep("nodes", nodes)
        others = held.select("doc_id", "text_hash", "node").join(self.nodes.select("node", "doc", "hash"), "node").filter(~(F.col("doc_id").eqNullSafe(F.col("doc")) & (F.col("text_hash") == F.col("hash"))))
        others = self.space.keep("others", others.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")))
        self.repeated = held.count() > self.nodes.count() + others.count()
        first = self.docs.join(self._small(others), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left_anti")
        total = held.agg(F.sum(F.col("n") - F.ceil(F.col("n") * F.lit(PERCENT) / 100) + 1)).first()[0] or 0
        parts = max(docs.sparkSession.sparkContext.defaultParallelism, -(-int(total) // TASK))
        shared = _shared(_entries(first, common, levels, 8 * parts).repartition(parts, "bucket"))
        shared = self.space.keep("candidates", shared.distinct() if self.repeated else shared)
        hot = self._small(self.space.keep("hot", shared.groupBy("token").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > GROUP).select("token")))
        # A token of few rows becomes one row, whose pairs are made there.
        few = shared.join(hot, "token", "left_anti").groupBy("token").agg(F.collect_list(F.struct("node", "n", "at")).alias("all")).filter(F.size("all") > 1)
        few = few.select(F.explode("all").alias("x"), "all").select("x", F.explode(F.filter("all", lambda y: (y["node"] > F.col("x.node")) & _may_link(F.col("x"), y))).alias("y"))
        self.few = self.space.keep("few", few.select(F.col("x.node").alias("x"), F.col("y.node").alias("y")).distinct())
        self.shared = self.space.keep("shared", shared.join(hot, "token", "left_semi"))
        self.rounds = 0

    @staticmethod
    def _small(df: DataFrame, rows: int | None = None) -> DataFrame:
        """For a join: broadcast, if it has few rows."""
        return F.broadcast(df) if (df.count() if rows is None else rows) <= BROADCAST_ROWS else df

    def _common(self, often: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Sorted hashes and levels of at most COMMON shingles, the most frequent ones; shingles of one level stay together."""
        level = F.least(F.greatest(F.floor(F.log2("count") * 64), F.lit(1)), F.lit((1 << (64 - LEVEL)) - 1)).cast("int")
        often = self.space.keep("often", often.groupBy("shingle").agg(F.sum("count").alias("count")).select("shingle", level.alias("level")))
        sizes = sorted(often.groupBy("level").count().collect(), reverse=True)  # at most as many rows as levels
        least, total = 1 << 30, 0
        for size, count in sizes:
            total += count
            if total > COMMON:
                break
            least = size
        found = often.filter(F.col("level") >= least).toArrow()
        common = found["shingle"].to_numpy().view(np.uint64)
        order = np.argsort(common)
        return common[order], found["level"].to_numpy()[order]

    def pairs(self, candidates: DataFrame) -> DataFrame:
        """(a, b), a < b, once each."""
        return candidates.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()

    def to_hubs(self, met: DataFrame) -> DataFrame:
        """Candidates of each node among the hubs (node, hub) that it meets: the BEST that share most prefix tokens with it.

        The others are not lost: unless their classes become one, between() comes to them.
        """
        met = met.filter("node <> hub").groupBy("node", "hub").agg(F.count(F.lit(1)).alias("_times"))
        # A node has at most as many rows as its prefix has shingles, times the hubs.
        best = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("_times"), "hub"))
        return met.withColumn("_rank", best).filter(F.col("_rank") <= BEST).select(F.col("node").alias("x"), F.col("hub").alias("y"))

    def between(self, entries: DataFrame, major: DataFrame | None = None) -> DataFrame:
        """All candidates that pass the length and positional filters.

        With major (token, major), entries have a label: only candidates between different labels, and, as all
        entries under a token's major label agree, each is met from one that has another label.

        A pair whose first shared token is among both nodes' HEAD least ones comes once, at that token: what is shared
        before it would be among them too. Another pair comes at each token that it shares.
        """
        heads = entries.groupBy("node").agg(F.slice(F.array_sort(F.collect_list("token")), 1, HEAD).alias("head"))
        entries = entries.join(self.nodes.select("node", *BITMAP), "node").join(heads, "node")
        right = entries.select("token", *(F.col(c).alias(f"_{c}") for c in ("node", "n", "at", "label", "head", *BITMAP) if c in entries.columns))
        left = entries
        rule = F.col("node") < F.col("_node")
        if major is not None:
            left = entries.join(major, "token").filter("label <> major")
            rule = (F.col("label") != F.col("_label")) & ((F.col("_label") == F.col("major")) | (F.col("node") < F.col("_node")))
        x, y = F.struct("n", "at"), F.struct(F.col("_n").alias("n"), F.col("_at").alias("at"))
        fits = _may_link(x, y) & (_differ("", "_") <= _may_differ(F.col("n"), F.col("_n")))
        fits &= F.coalesce(F.array_min(F.array_intersect("head", "_head")), "token") >= F.col("token")
        return left.join(right, "token").filter(rule & fits).select(F.col("node").alias("x"), F.col("_node").alias("y"))

    def verify(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that link, by their whole sets."""
        self.rounds += 1
        k = self.rounds
        side = lambda c: self.nodes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), *(F.col(x).alias(f"{c}_{x}") for x in BITMAP))
        n, m = F.col("n_a"), F.col("n_b")
        rows = pairs.count()
        near = self._small(side("a").join(self._small(pairs, rows), "a"), WIDE * rows).join(side("b"), "b").filter(_close(n, m) & (_differ("a_", "b_") <= _may_differ(n, m)))
        near = self.space.keep(f"near{k}", near.select("a", "b", "n_a", "n_b"))
        wanted = near.select(F.col("a").alias("node")).union(near.select("b")).distinct()
        sets = self.space.keep(f"sets{k}", self._sets(wanted.join(self.nodes.select("node", "doc", "hash"), "node")))

        def fits(x: bytes, y: bytes, need: int) -> bool:
            x, y = sorted((np.frombuffer(v, np.uint16).astype(np.int64) for v in (x, y)), key=len)
            while len(x) and len(y) > len(x):
                y = y.reshape(2, -1).sum(0)
            return not len(x) or int(np.minimum(x, y).sum()) >= need

        def suffix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n, m = batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()
                need = -(-PERCENT * (n + m) // (100 + PERCENT))
                ok = [fits(x.as_py(), y.as_py(), k) for x, y, k in zip(batch.column("p_a"), batch.column("p_b"), need.tolist(), strict=True)]
                yield batch.select(["a", "b", "n_a", "n_b"]).filter(pa.array(ok, pa.bool_()))

        part = lambda c, v, p: sets.select(F.col("node").alias(c), F.col(v).alias(f"{p}_{c}"))
        left = self._small(near).join(part("a", "parts", "p"), "a").join(part("b", "parts", "p"), "b").select("a", "b", "n_a", "n_b", "p_a", "p_b")
        left = self.space.keep(f"left{k}", left.mapInArrow(suffix, "a long, b long, n_a long, n_b long").hint("rebalance"))
        whole = self._small(left).join(part("a", "set", "s"), "a").join(part("b", "set", "s"), "b")
        both = F.size(F.array_intersect("s_a", "s_b"))
        links = self.space.keep(f"links{k}", whole.filter(100 * both >= PERCENT * (F.col("n_a") + F.col("n_b") - both)).select("a", "b").hint("rebalance"))
        for name in ("near", "sets", "left"):
            self.space.drop(f"{name}{k}")
        return links

    def _sets(self, wanted: DataFrame) -> DataFrame:
        """(node, parts, set) of the wanted nodes (node, doc, hash), from one text of each."""
        wanted = self.space.keep(f"wanted{self.rounds}", wanted.withColumnRenamed("node", "wanted"))
        same = F.col("doc_id").eqNullSafe(F.col("doc")) & (F.col("text_hash") == F.col("hash"))
        # Wanted texts may stand close together; dealt out again, the tasks and the files they write are of one size.
        texts = self.docs.join(self._small(wanted), same).select("wanted", "text").hint("rebalance")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cache: dict = {}
            done: set[int] = set()
            for batch in batches:
                for row, data, starts in _text.pieces(batch.column("text")):
                    rows = len(starts) - 1
                    h, r = shingles(data, starts, cache)
                    at = _text.bounds(r, rows)
                    want = batch.column("wanted").slice(row, rows).to_pylist()
                    new = [i for i, w in enumerate(want) if w not in done and not done.add(w)]
                    parts = [_parts(h[at[i] : at[i + 1]]) for i in new]
                    ends = np.concatenate([[0], np.cumsum(np.diff(at)[new])]).astype(np.int32)
                    values = np.concatenate([h[at[i] : at[i + 1]] for i in new]) if new else np.zeros(0, np.uint64)
                    yield pa.RecordBatch.from_arrays([pa.array([want[i] for i in new], pa.int64()), pa.array(parts, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(values.view(np.int64)))], ["node", "parts", "set"])
            _text.release()

        found = texts.mapInArrow(run, "node long, parts binary, set array<long>")
        # Only where whole rows repeat can a text come twice, from each task at most once.
        return found.dropDuplicates(["node"]) if self.repeated else found

    def all_links(self) -> DataFrame:
        """Every link (a, b) between different sets."""
        return self.verify(self.space.keep("pairs", self.pairs(self.between(self.shared).union(self.few))))

    def hubs(self, entries: DataFrame, seeds: tuple) -> DataFrame:
        """(token, hub): a shingle's least node in each order."""
        least = (F.min(F.col("node").bitwiseXOR(F.lit(s).cast("long"))).bitwiseXOR(F.lit(s).cast("long")) for s in seeds)
        return entries.groupBy("token").agg(F.array_distinct(F.array(*least)).alias("h")).select("token", F.explode("h").alias("hub"))

    def classes(self) -> tuple[DataFrame, DataFrame]:
        """(node, root) of the nodes that link with another, and the links that were verified."""
        size, entries, last, before = self.shared.count(), self.shared, False, float("inf")
        met = self.to_hubs(entries.join(self.hubs(entries, SEEDS[0]), "token").select("node", "hub"))
        tried = self.space.keep("tried0", self.pairs(self.few.union(met)))
        links = self.verify(tried)
        while True:
            roots = components(links, self.space, f"roots{self.rounds}")
            roots = F.broadcast(roots) if roots.count() <= BROADCAST_ROWS else roots
            if last or not size:
                return roots, links
            named = entries.join(roots, "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root")
            each = named.groupBy("token", "label").agg(F.count(F.lit(1)).alias("_c"))
            split = each.groupBy("token").agg(F.max(F.struct("_c", "label"))["label"].alias("major"), F.sum("_c").alias("_all"), F.sum(F.col("_c") * F.col("_c")).alias("_own"))
            split = self.space.keep(f"split{self.rounds}", split.select("token", "major", ((F.col("_all") * F.col("_all") - F.col("_own")) / 2).alias("left")).filter("left > 0"))
            left = split.agg(F.sum("left")).first()[0] or 0
            if not left:
                return roots, links
            named = named.join(split.select("token"), "token", "left_semi")
            last = self.rounds >= len(SEEDS) or self.rounds > 1 and (left <= TIMES * size + SPARE or left > 0.8 * before)
            before = left
            if last:
                new = self.between(named, split.select("token", "major"))
            else:
                met = named.join(self.hubs(named, SEEDS[self.rounds]), "token").join(roots.select(F.col("node").alias("hub"), F.col("root").alias("_root")), "hub", "left")
                new = self.to_hubs(met.filter(F.col("label") != F.coalesce("_root", "hub")).select("node", "hub"))
            new = self.pairs(new).join(tried, ["a", "b"], "left_anti")
            new = self.space.keep(f"tried{self.rounds}", new)
            tried = tried.union(new)
            links = links.union(self.verify(new))


def block_links(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Whether each set of a links with each of b."""
    shingle, place = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    n = np.array([len(x) for x in (*a, *b)])
    row = np.repeat(np.arange(len(n)), n)
    order = np.argsort(place, kind="stable")
    place, row = place[order], row[order]
    both = np.zeros((len(a), len(b)), np.int64)
    for first in range(0, len(shingle), WIDTH):
        i, j = np.searchsorted(place, [first, first + WIDTH])
        held = np.zeros((len(n), min(WIDTH, len(shingle) - first)), np.float32)
        held[row[i:j], place[i:j] - first] = 1
        both += (held[: len(a)] @ held[len(a) :].T).astype(np.int64)
    return 100 * both >= PERCENT * (n[: len(a), None] + n[None, len(a) :] - both)


def degrees(join: Join, roots: DataFrame, links: DataFrame) -> DataFrame:
    """(node, n_links): with how many other rows a row of the node links, for nodes that stand for several rows or link."""
    weight = join.space.keep("weight", join.marks.filter("node is not null").groupBy("node").agg(F.count(F.lit(1)).alias("rows")))
    both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).union(links.select("b", "a")).join(roots, "node")
    # A class of which all pairs are links that were verified is counted by them.
    size = roots.groupBy("root").agg(F.count(F.lit(1)).alias("nodes"))
    had = both.groupBy("root").agg(F.count(F.lit(1)).alias("ends"))
    part = join.space.keep("part", size.join(had, "root").withColumn("whole", F.col("ends") == F.col("nodes") * (F.col("nodes") - 1)))
    known = both.join(part.filter("whole").select("root"), "root", "left_semi").select("node", F.col("other")).join(weight.withColumnRenamed("node", "other"), "other").select("node", "rows")

    blocks = F.ceil(F.col("nodes") / F.lit(BLOCK))
    open_ = roots.join(part.filter("not whole").select("root", blocks.alias("blocks")), "root").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    open_ = join.space.keep("open", open_.join(weight, "node"))
    sets = join.space.keep("open_sets", join._sets(open_.select("node").join(join.nodes.select("node", "doc", "hash"), "node")).select("node", "set"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    meet = open_.select("node", "root", "rows", "block", other.alias("other")).join(sets, "node")
    meet = meet.select("root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "rows", "set")

    def count(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        block, node, rows = (table.column(c).to_numpy() for c in ("block", "node", "rows"))
        whole = [x.values.to_numpy().view(np.uint64) for x in table.column("set")]
        x, y = np.flatnonzero(block == i), np.flatnonzero(block == j)
        out = np.zeros(len(node), np.int64)
        if len(x) and len(y):
            for at in range(0, len(x), BLOCK):
                for to in range(0, len(y), BLOCK):
                    p, q = x[at : at + BLOCK], y[to : to + BLOCK]
                    link = block_links([whole[k] for k in p], [whole[k] for k in q])
                    link[p[:, None] == q[None, :]] = False
                    out[p] += link @ rows[q]
                    if i != j:
                        out[q] += rows[p] @ link
        return pa.table({"node": node, "rows": out})

    counted = meet.groupBy("root", "i", "j").applyInArrow(count, "node long, rows long")
    own = weight.filter("rows > 1").select("node", (F.col("rows") - 1).alias("rows"))
    return join.space.keep("degrees", known.union(counted).union(own).groupBy("node").agg(F.sum("rows").alias("n_links")))


def least_reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links (a, b), ascending, and for each the least node that it reaches."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    least = np.arange(len(nodes))
    while len(x):
        # Every greater root of a link goes below the least root that it meets, and all nodes then to their roots.
        np.minimum.at(least, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(far := least[least], least):
            least = far
        x, y = least[x], least[y]
        x, y = x[x != y], y[x != y]
    return nodes, nodes[least]


def components(links: DataFrame, space: Workspace, name: str) -> DataFrame:
    """(node, root) for the nodes of links (a, b), root the least node of each component.

    Up to LINKS links are joined in the driver, as each step below costs it a plan of its own, whatever the rows. Beyond,
    alternating large-star and small-star steps until all edges are stars; each step moves a row for each edge.
    """
    if links.count() <= LINKS:
        held = links.select("a", "b").toArrow()
        node, root = least_reached(held["a"].to_numpy(), held["b"].to_numpy())
        return space.keep(name, space.spark.createDataFrame(pa.table({"node": node, "root": root}), "node long, root long"))
    edges, k = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), 0
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        edges, k = space.keep(f"{name}_{k}", small), k + 1
        # Stars: each node but a root has one edge, to a root, which has none upwards.
        ends = edges.select(F.col("u").alias("w"), F.lit(1).alias("up"), F.lit(0).alias("root")).union(edges.select("v", F.lit(0), F.lit(1)))
        ends = ends.groupBy("w").agg(F.sum("up").alias("up"), F.max("root").alias("root"))
        if ends.filter("up > 1 or up = 1 and root = 1").isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v"), F.col("v")).distinct())


def near_duplicates(docs: DataFrame, count: bool = True) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id (the least doc_id reachable by links), n_links, root; a row for each row.

    root is the class's least node, the same for all rows of a class whatever their ids, and null for an empty set.
    n_links is the number of other rows that the row links with, copies included; without count it is left out.
    """
    join = Join(docs)
    roots, links = join.classes()
    named = join.nodes.select("node", "doc").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("doc").alias("component_id"))
    named = join.space.keep("named", named.join(least, "root").select("node", "root", "component_id"))
    out = join.marks.join(named, "node", "left")
    columns = ["doc_id", "text_hash", F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")]
    if count:
        out = out.join(join._small(degrees(join, roots, links)), "node", "left")
        columns.append(F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return out.select(*columns, "root")


def op10_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("text_hash", "root")
