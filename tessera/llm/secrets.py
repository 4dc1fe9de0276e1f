"""Secret scans: three fixed patterns, then candidates in a sensitive context by zstandard novelty.

A candidate is a run of key characters that begins at most AROUND characters after a sensitive word, on whatever
line and whatever stands between; each one is measured. The text around it is compressed with
and without it, primed with that text's own identifiers and a dictionary of common ones; what the candidate
adds, in bytes for each of its characters, is its novelty. Words and repeated names add little, keys add most of
their entropy. Candidates that overlap a pattern's span are left to that pattern.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

KINDS = ("assign", "access", "hex", "novel")
# Fixed patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
SENSITIVE = re.compile(r"secret|token|passw|api.?key|access.?key|private.?key|credential|bearer|authorization|signature", re.I | re.A)
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
_HINT = re.compile(r"passw|secret|token|api|AKIA|key|credential|bearer|authorization|signature", re.I | re.A)
IDENTIFIERS = (
    "authorization authenticate access_token refresh_token client_secret client_id api_key private_key public_key "
    "password username credential session signature certificate configuration environment connection database "
    "application production development documentation implementation administrator management transaction "
    "http https localhost example.com github.com raw.githubusercontent.com application/json Content-Type charset utf-8 "
    "function return import export default const static public class string integer boolean undefined null true false "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 AAAAAAAAAAAAAAAA xxxxxxxxxxxxxxxx 0000000000000000"
)
#: Reach of the surrounding text on either side, and of a sensitive word, and least added bytes for each character.
AROUND, LEAST = 400, 0.6


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns' matches that are long enough."""
    if not _HINT.search(text):
        found = []
    else:
        found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def novelty(text: str, start: int, end: int, compressor: zstandard.ZstdCompressor) -> float:
    """Bytes that text[start:end] adds to its compressed surroundings, for each of its characters."""
    before, after = text[max(0, start - AROUND) : start], text[end : end + AROUND]
    without = compressor.compress((before + after).encode())
    return (len(compressor.compress((before + after + "\n" + text[start:end]).encode())) - len(without)) / (end - start)


def novel_spans(text: str, base: list[tuple[int, int, int]], compressor: zstandard.ZstdCompressor) -> list[tuple[int, int, int]]:
    if not _HINT.search(text):
        return []
    found, ends = [], [m.end() for m in SENSITIVE.finditer(text)]
    if not ends:
        return []
    for m in CANDIDATE.finditer(text, ends[0]):
        a, b = m.span()
        if a - ends[bisect.bisect_right(ends, a) - 1] > AROUND:
            continue
        if not any(s < b and a < e for s, _, e in base) and novelty(text, a, b, compressor) >= LEAST:
            found.append((a, 3, b))
    return found


def joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(found))


def scan(docs: DataFrame) -> DataFrame:
    """One row for each document, whole text; a null text is empty and has no spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        primed = zstandard.ZstdCompressionDict(IDENTIFIERS.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        compressor = zstandard.ZstdCompressor(level=19, dict_data=primed, write_checksum=False, write_content_size=False)
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                base = base_spans(text := text or "")
                every = base + novel_spans(text, base, compressor)
                rows.append((*(sum(k == kind for _, k, _ in base) for kind in range(3)), len(every) - len(base), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)))
            columns = [list(x) for x in zip(*rows, strict=True)] if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in columns[:4]), *(pa.array(x, pa.string()) for x in columns[4:])], ["doc_id", "n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string")


def op7_secret_scan(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
