"""Byte-level BPE of whole Arrow columns: each distinct piece of text is encoded once by the tokenizers library.

A text is cut where the vocabulary's own pre-tokenizer always cuts: before white space after ink, after a lone line break
or tab before ink, and between ASCII letters, digits and punctuation other than the apostrophe. Pieces are found and
compared in numpy, and a bounded cache of their ids stays in the worker process between tasks.
"""

from __future__ import annotations

import re
import sys
import types

import numpy as np
import pyarrow as pa

from . import _text

#: Pieces that a process remembers, in about 40 bytes each; when there are more it begins anew.
CACHE = 2_000_000
#: Byte classes: 1 letter, 2 digit, 3 punctuation, 4 apostrophe, 5 beyond ASCII, 6 space, 7 other white space, 0 the rest.
_CLASS = np.zeros(256, np.uint8)
_CLASS[33:127] = 3
_CLASS[[*range(65, 91), *range(97, 123)]] = 1
_CLASS[48:58] = 2
_CLASS[39] = 4
_CLASS[128:] = 5
_CLASS[32] = 6
_CLASS[9:14] = 7
_i, _j = np.meshgrid(np.arange(8), np.arange(8), indexing="ij")
_INK = lambda c: (c >= 1) & (c <= 5)
#: Whether a cut is safe between a byte of one class and the next.
_CUT = (_INK(_i) & (_j >= 6)) | ((_i == 7) & _INK(_j)) | ((_i != _j) & (_i >= 1) & (_i <= 3) & (_j >= 1) & (_j <= 3))
#: White space beyond ASCII, whose runs join with spaces: such texts are encoded whole.
_WIDE = re.compile("[\x85\xa0  -     　]")
_PLAIN = re.compile(r" ?\S+")


def process_store() -> types.ModuleType:
    """A place that outlives tasks: their code is pickled anew for each, the worker process is not."""
    return sys.modules.setdefault("_tessera_process_store", types.ModuleType("_tessera_process_store"))


class Encoder:
    def __init__(self, path: str, end: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.end = end
        self.newline = self._plain("\n")
        self.clear()

    def _plain(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def clear(self) -> None:
        """Known pieces' hashes, sorted, with their slots; slot 0 of the pool is the end id."""
        self.keys, self.slot, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int32), 1
        self.pool, self.used = np.full(1 << 20, self.end, np.uint32), 1
        self.begin, self.length = np.zeros(1 << 18, np.int64), np.ones(1 << 18, np.int32)

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts, and where each one's begin and how many they are."""
        begin, length, whole, at = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int32), [], 0
        joined = np.array([i for i, t in enumerate(texts) if _PLAIN.fullmatch(t)], np.int64)
        if len(joined) and len(self.newline) == 1:
            # Between pieces without white space inside, a line break is a token of its own.
            ids = np.array(self._plain("\n".join([texts[i] for i in joined])), np.uint32)
            cut = np.append(np.flatnonzero(ids == self.newline[0]), len(ids))
            if len(cut) == len(joined):
                begin[joined] = np.append(0, cut[:-1] + 1)
                length[joined] = cut - begin[joined]
                whole, at = [ids], len(ids)
        rest = np.flatnonzero(length == 0).tolist()
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False), strict=True):
            whole.append(np.array(e.ids, np.uint32))
            begin[i], length[i] = at, len(whole[-1])
            at += len(whole[-1])
        return np.concatenate(whole), begin, length

    def _learn(self, keys: np.ndarray, places: np.ndarray, texts: list[str]) -> None:
        """Adds sorted keys at their places among the known ones."""
        new, begin, length = self._ids(texts)
        while self.used + len(new) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while self.size + len(texts) > len(self.begin):
            self.begin, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.length))
        n = len(texts)
        self.pool[self.used : self.used + len(new)] = new
        self.begin[self.size : self.size + n] = self.used + begin
        self.length[self.size : self.size + n] = length
        self.keys = np.insert(self.keys, places, keys)
        self.slot = np.insert(self.slot, places, np.arange(self.size, self.size + n, dtype=np.int32))
        self.size += n
        self.used += len(new)

    def encode(self, data: np.ndarray, starts: np.ndarray, cache: dict) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows one after another, each with the end id, and where each row begins; one entry more."""
        n = len(starts) - 1
        if len(self.keys) > CACHE:
            self.clear()
        c = _CLASS[data]
        first = np.zeros(len(data), bool)
        first[1:] = _CUT[c[:-1], c[1:]]
        # How a longer run of white space is split depends on what follows, so only a single break is left behind.
        lone = (c[1:-1] != 7) | _INK(c[:-2])
        lone[starts[:-1][(starts[:-1] > 0) & (starts[:-1] < len(data) - 1)] - 1] = True
        first[2:] &= lone
        first[starts[:-1][starts[:-1] < len(data)]] = True
        a = np.flatnonzero(first)
        b = np.append(a[1:], len(data)) if len(a) else a
        keys, at, which = np.unique(_text.span_hashes(data, a, b, cache), return_index=True, return_inverse=True)
        place = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = place < len(self.keys)
        known[inside] = self.keys[place[inside]] == keys[inside]
        if not known.all():
            lost = np.flatnonzero(~known)
            raw = data.tobytes()
            self._learn(keys[lost], place[lost], [raw[x:y].decode() for x, y in zip(a[at[lost]].tolist(), b[at[lost]].tolist(), strict=True)])
            place = np.searchsorted(self.keys, keys)
        index = np.insert(self.slot[place][which] if len(keys) else np.zeros(0, np.int32), np.searchsorted(a, starts[1:]), 0)
        length = self.length[index]
        ends = np.cumsum(length)
        ids = self.pool[np.arange(ends[-1]) + np.repeat(self.begin[index] - (ends - length), length)]
        last = ends[np.searchsorted(a, starts[1:]) + np.arange(n)]
        return ids, np.concatenate([[0], last])


def encoder(path: str, end: int) -> Encoder:
    """This process's encoder of the file."""
    known = process_store().__dict__.setdefault("encoders", {})
    if (path, end) not in known:
        known[path, end] = Encoder(path, end)
    return known[path, end]


def encode_column(column: pa.Array, path: str, end: int, cache: dict):
    """(first row, ids, row starts) for runs of rows of a string column."""
    e = encoder(path, end)
    for row, data, starts in _text.pieces(column, 2 << 20):
        ids, at = e.encode(data, starts, cache)
        if (data >= 0x80).any():
            # A row with wide white space or a very long piece is encoded as a whole instead.
            texts = column.slice(row, len(starts) - 1).to_pylist()
            wide = {i for i, t in enumerate(texts) if t and not t.isascii() and _WIDE.search(t)}
            if wide:
                each = [np.array([*e._plain(t), end], np.uint32) if i in wide else ids[at[i] : at[i + 1]] for i, t in enumerate(texts)]
                ids, at = np.concatenate(each), np.concatenate([[0], np.cumsum([len(x) for x in each])])
        yield row, ids, at
