"""A file format for token ids: static range asymmetric numeral system (rANS) with one shared frequency table.

A block codes whole documents on its own. Its ids are dealt over LANES interleaved 64-bit states, id i to lane i mod
LANES, and all lanes share one stream of 32-bit words, so a step codes LANES ids at once in numpy. Every EVERY steps a
checkpoint holds the states and the place in the stream; decoding can begin at any of them, in parallel. The
block carries the crc32 of its ids and of its own bytes.

Block, little-endian: MAGIC, then uint32 lanes, steps, ids, documents, checkpoints, words, table crc32, ids
crc32; int64 ids of the documents; a byte for each that is 1 for a null id; uint32 tokens of each document; for each
checkpoint uint32 place and uint64 state of each lane; the words; uint32 crc32 of all before.
"""

from __future__ import annotations

import zlib

import numpy as np

MAGIC = b"TRANS001"
SCALE, LANES, EVERY = 20, 512, 128
LOW = np.uint64(1 << 31)


class Damaged(ValueError):
    """A block's bytes or ids do not match their checksum."""


class Table:
    """Symbols, their scaled frequencies and cumulative sums; frequencies sum to 2**SCALE."""

    def __init__(self, symbols: np.ndarray, counts: np.ndarray):
        order = np.argsort(symbols)
        self.symbols, counts = symbols[order].astype(np.uint32), counts[order].astype(np.float64)
        f = np.maximum(1, np.floor(counts / counts.sum() * (1 << SCALE))).astype(np.int64)
        left = (1 << SCALE) - int(f.sum())
        while left < 0:  # rare symbols were rounded up: take from the most frequent ones
            i = int(f.argmax())
            cut = min(-left, int(f[i]) // 2)
            f[i] -= cut
            left += cut
        f[f.argmax()] += left
        self.freq = f.astype(np.uint64)
        self.cum = (np.cumsum(f) - f).astype(np.uint64)
        self.crc = zlib.crc32(self.symbols.tobytes() + f.tobytes())
        size = int(self.symbols.max()) + 1
        self.place = np.full(size, len(f), np.int64)
        self.place[self.symbols] = np.arange(len(f))

    def slots(self) -> np.ndarray:
        """The place of the symbol of each of the 2**SCALE slots."""
        return np.repeat(np.arange(len(self.freq), dtype=np.uint16 if len(self.freq) < 65536 else np.uint32), self.freq.astype(np.int64))


def lanes_for(n: int) -> int:
    """Fewer lanes for short blocks, whose states would outweigh the words."""
    return max(1, min(LANES, 1 << max(0, (n // 64).bit_length() - 1)))


def pack(ids: np.ndarray, doc_ids: np.ndarray, nulls: np.ndarray, sizes: np.ndarray, table: Table) -> bytes:
    lanes = lanes_for(len(ids))
    steps = max(1, -(-len(ids) // lanes))
    at = np.zeros(steps * lanes, np.int64)
    at[: len(ids)] = table.place[ids]
    at[len(ids) :] = at[0]
    f = table.freq[at].reshape(steps, lanes)
    c = table.cum[at].reshape(steps, lanes)
    most = f << np.uint64(63 - SCALE)
    x = np.full(lanes, LOW, np.uint64)
    words, count, points = [], np.zeros(steps, np.int64), []
    for step in range(steps - 1, -1, -1):
        full = x >= most[step]
        out = x[full]
        words.append(out.astype(np.uint32))
        count[step] = len(out)
        x[full] = out >> np.uint64(32)
        q = x // f[step]
        x = (q << np.uint64(SCALE)) + (x - q * f[step]) + c[step]
        if step % EVERY == 0:
            points.append((step, x.copy()))
    stream = np.concatenate(words[::-1])
    before = np.cumsum(count) - count
    head = np.array([lanes, steps, len(ids), len(doc_ids), len(points), len(stream), table.crc, zlib.crc32(ids.astype("<u4").tobytes())], "<u4").tobytes()
    marks = b"".join(np.array([before[s]], "<u4").tobytes() + x.astype("<u8").tobytes() for s, x in points[::-1])
    body = MAGIC + head + doc_ids.astype("<i8").tobytes() + nulls.astype(np.uint8).tobytes() + sizes.astype("<u4").tobytes() + marks + stream.astype("<u4").tobytes()
    return body + np.array([zlib.crc32(body)], "<u4").tobytes()


class Block:
    """A parsed block; its bytes are checked at once, its ids when they are decoded."""

    def __init__(self, raw: bytes):
        if raw[:8] != MAGIC or zlib.crc32(raw[:-4]) != int(np.frombuffer(raw[-4:], "<u4")[0]):
            raise Damaged("block bytes")
        self.lanes, self.steps, self.n, docs, points, words, self.table_crc, self.crc = (int(x) for x in np.frombuffer(raw, "<u4", 8, 8))
        at = 40
        self.doc_ids = np.frombuffer(raw, "<i8", docs, at)
        self.nulls = np.frombuffer(raw, np.uint8, docs, at := at + 8 * docs).astype(bool)
        self.sizes = np.frombuffer(raw, "<u4", docs, at := at + docs)
        at += 4 * docs
        self.points = []
        for _ in range(points):
            self.points.append((int(np.frombuffer(raw, "<u4", 1, at)[0]), np.frombuffer(raw, "<u8", self.lanes, at + 4).astype(np.uint64)))
            at += 4 + 8 * self.lanes
        self.words = np.frombuffer(raw, "<u4", words, at)

    def part(self, k: int, table: Table, slots: np.ndarray) -> np.ndarray:
        """Ids from checkpoint k up to the next."""
        place, x = self.points[k]
        x = x.copy()
        steps = min(EVERY, self.steps - k * EVERY)
        out = np.empty((steps, self.lanes), np.int64)
        mask = np.uint64((1 << SCALE) - 1)
        for step in range(steps):
            low = x & mask
            s = slots[low]
            out[step] = s
            x = table.freq[s] * (x >> np.uint64(SCALE)) + low - table.cum[s]
            need = x < LOW
            n = int(np.count_nonzero(need))
            x[need] = (x[need] << np.uint64(32)) | self.words[place : place + n]
            place += n
        return table.symbols[out.ravel()]

    def ids(self, table: Table, slots: np.ndarray) -> np.ndarray:
        if self.table_crc != table.crc:
            raise Damaged("another frequency table")
        ids = np.concatenate([self.part(k, table, slots) for k in range(len(self.points))])[: self.n]
        if zlib.crc32(ids.astype("<u4").tobytes()) != self.crc:
            raise Damaged("ids")
        return ids
