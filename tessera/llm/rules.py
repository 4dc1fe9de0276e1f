"""Quality rules: base counts of each text, then a hashed n-gram log-likelihood ratio.

Target multinomial: word and word-pair counts of trusted documents. Raw multinomial: the same counts over all
documents. Both live in a fixed number of hash buckets, so the model's size does not grow with the corpus. A
document's score is the mean over its n-grams of log(target / raw); it is kept if it passes the base rules and
its score is at least the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text

BITS = 16
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
#: Trusted ids up to so many are broadcast; beyond, their join shuffles.
BROADCAST_ROWS = 500_000
BASE = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def _per_row(mask: np.ndarray, starts: np.ndarray) -> np.ndarray:
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[starts[1:]] - total[starts[:-1]]


def _same_as_before(rows: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Size of each entry's group of equal (row, hash), and whether an earlier entry is equal."""
    order = np.lexsort((h, rows))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (rows[order][1:] != rows[order][:-1])
    group = np.cumsum(new) - 1
    size, earlier = np.empty(len(h), np.int64), np.empty(len(h), bool)
    size[order] = np.bincount(group, minlength=1)[group] if len(h) else 0
    earlier[order] = ~new
    return size, earlier


def buckets(words: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash bucket and row of every word and word pair, by row."""
    pair, at = _text.grams(words, rows, 2)
    h = np.concatenate([words, pair]) >> np.uint64(64 - BITS)
    r = np.concatenate([rows, rows[at]])
    order = np.argsort(r, kind="stable")
    return h[order].astype(np.int64), r[order]


def base_counts(data: np.ndarray, starts: np.ndarray, words, rows, a, b, cache: dict) -> list[np.ndarray]:
    n = len(starts) - 1
    ink = ~_text.SPACE[data]
    line_row, la, lb = _text.spans(data != 10, starts)
    inked = np.zeros(len(data) + 1, np.int64)
    np.cumsum(ink, out=inked[1:])
    full = inked[lb] > inked[la]
    line_row, la, lb = line_row[full], la[full], lb[full]
    _, again = _same_as_before(line_row, _text.span_hashes(data, la, lb, cache))
    five, at = _text.grams(words, rows, 5)
    size, _ = _same_as_before(rows[at], five)
    cover = np.zeros(len(words) + 6, np.int64)
    twice = at[size >= 2]
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + 5, -1)
    covered = np.cumsum(cover)[: len(words)] > 0
    return [
        np.bincount(rows, minlength=n),
        _per_row(ink & ((data & 0xC0) != 0x80), starts),
        _per_row(SYMBOLS[data], starts),
        np.bincount(line_row[again], minlength=n),
        np.bincount(rows[covered], minlength=n),
    ]


def _words(data, starts, cache):
    rows, a, b = _text.spans(~_text.SPACE[data], starts)
    return _text.span_hashes(data, a, b, cache), rows, a, b


def counts(docs: DataFrame) -> DataFrame:
    """(bucket, raw, target): n-gram counts over all rows, and over those where the column trusted is true.

    Each task sums its own rows first, so it sends at most one row for each bucket.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, total = {}, np.zeros((2, 1 << BITS), np.int64)
        for batch in batches:
            trusted = np.asarray(batch.column("trusted").fill_null(False).to_numpy(zero_copy_only=False), bool)
            for row, data, starts in _text.pieces(batch.column("text")):
                words, rows, _, _ = _words(data, starts, cache)
                h, r = buckets(words, rows)
                total[0] += np.bincount(h, minlength=1 << BITS)
                total[1] += np.bincount(h[trusted[row + r]], minlength=1 << BITS)
        at = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[0][at]), pa.array(total[1][at])], ["bucket", "raw", "target"])

    sums = docs.select("text", "trusted").mapInArrow(run, "bucket long, raw long, target long")
    return sums.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def ratios(docs: DataFrame, prior: float = 20_000.0) -> np.ndarray:
    """log(target / raw) of each bucket; the target is smoothed by so many n-grams of the raw mixture."""
    table = counts(docs).toArrow()  # at most 2**BITS rows
    at = table["bucket"].to_numpy()
    raw, target = np.zeros(1 << BITS), np.zeros(1 << BITS)
    raw[at], target[at] = table["raw"].to_numpy(), table["target"].to_numpy()
    p = (raw + 0.5) / (raw.sum() + 0.5 * len(raw))
    return np.log((target + prior * p) / (target.sum() + prior)) - np.log(p)


def trusted_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with the column trusted, true for every row whose id is labelled good."""
    good = labels.filter("quality = 1").select("doc_id").distinct().withColumn("trusted", F.lit(True))
    good = F.broadcast(good) if good.count() <= BROADCAST_ROWS else good
    return docs.select("doc_id", "text").join(good, "doc_id", "left")


def judge(docs: DataFrame, llr: np.ndarray, threshold: float) -> DataFrame:
    """One row for each document: base counts, score, base_failed and kept.

    A null or empty text has no words, so it fails the base rules; its score is 0.
    """
    shared = docs.sparkSession.sparkContext.broadcast(llr)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, table = {}, shared.value
        for batch in batches:
            for row, data, starts in _text.pieces(batch.column("text")):
                words, rows, a, b = _words(data, starts, cache)
                base = base_counts(data, starts, words, rows, a, b, cache)
                h, r = buckets(words, rows)
                n = len(starts) - 1
                score = np.bincount(r, weights=table[h], minlength=n) / np.maximum(1, np.bincount(r, minlength=n))
                failed = (base[0] < 10) | (100 * base[4] > 20 * base[0])
                columns = [batch.column("doc_id").slice(row, n), *map(pa.array, base), pa.array(score), pa.array(failed), pa.array(~failed & (score >= threshold))]
                yield pa.RecordBatch.from_arrays(columns, [*(x.split()[0] for x in BASE.split(", ")), "score", "base_failed", "kept"])

    return docs.select("doc_id", "text").mapInArrow(run, f"{BASE}, score double, base_failed boolean, kept boolean")


#: Nats an n-gram, for the query below: text at least this much likelier under the corpus than under trusted text goes.
THRESHOLD = -0.15


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    llr = ratios(trusted_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return judge(docs, llr, THRESHOLD)
