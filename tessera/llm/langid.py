"""Language identification: averaged hashed subword embeddings, a linear softmax, and calibrated rejection.

Subwords are byte n-grams of 2 to 4 bytes inside a word, its boundaries included. They are hashed into BUCKETS
rows of an embedding matrix; a text is the mean of its rows. Embeddings and softmax are trained by stochastic
gradient descent on the whole texts of a bounded number of rows. A temperature, fitted on training rows set aside, calibrates the score,
and the rejection threshold is the lowest score above which those rows reach the wanted precision.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._stage import crc32_of_id

BUCKETS_LOG, DIM, GAIN = 15, 16, 10
#: Bytes of a part that is one training example, about.
PART = 400
LETTER = np.zeros(256, bool)
LETTER[97:123] = True
LETTER[128:] = True
_ASCII_LETTER = re.compile("[A-Za-z]")


def subwords(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of every subword, by n-gram size and then by place."""
    data = _text.LOWER[data]
    letter = LETTER[data]
    data = np.where(letter, data, 32).astype(np.uint32)
    found, rows = [], []
    of_byte = np.repeat(np.arange(len(starts) - 1, dtype=np.int32), np.diff(starts))
    for n in (2, 3, 4):
        m = len(data) - n + 1
        if m <= 0:
            continue
        ok = letter[:m] | letter[n - 1 :] if n == 2 else letter[1 : m + 1].copy()
        for k in range(2, n - 1):
            ok &= letter[k : m + k]
        ok &= of_byte[:m] == of_byte[n - 1 :]
        code = data[:m].copy()
        for k in range(1, n):
            code |= data[k : m + k] << np.uint32(8 * k)
        code = (code[ok] + np.uint32(n)) * np.uint32(0x9E3779B1)
        found.append(((code ^ (code >> np.uint32(15))) * np.uint32(0x85EBCA77)) >> np.uint32(32 - BUCKETS_LOG))
        rows.append(of_byte[:m][ok])
    if not found:
        return np.zeros(0, np.uint32), np.zeros(0, np.int32)
    return np.concatenate(found), np.concatenate(rows)


def logits(data: np.ndarray, starts: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Mean over each row's subwords of its row of embeddings times softmax weights."""
    n = len(starts) - 1
    h, rows = subwords(data, starts)
    size = np.maximum(1, np.bincount(rows, minlength=n))
    return np.stack([np.bincount(rows, weights=table[:, c][h], minlength=n) / size for c in range(table.shape[1])], axis=1)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def parts(text: bytes, size: int = PART) -> list[bytes]:
    """The whole text in runs of about so many bytes, cut after spaces, so never inside a character; one at least."""
    found, at = [], 0
    while len(text) - at > size:
        end = text.find(b" ", at + size)
        if end < 0:
            break
        found.append(text[at : end + 1])
        at = end + 1
    return [*found, text[at:]] if at < len(text) or not found else found


def bags(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The distinct buckets of each text's subwords, and the share of its subwords in each."""
    found = []
    for text in texts:
        h, _ = subwords(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        bucket, count = np.unique(h, return_counts=True)
        found.append((bucket.astype(np.uint16), (count / max(1, len(h))).astype(np.float32)))
    return found


def step(emb: np.ndarray, w: np.ndarray, batch: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, rate: float) -> None:
    """One step of gradient descent on the log loss of a batch, in place; embeddings move GAIN times as far."""
    at = np.repeat(np.arange(len(batch)), [len(b) for b, _ in batch])
    bucket, share = np.concatenate([b for b, _ in batch]).astype(np.int64), np.concatenate([s for _, s in batch])
    mean = np.stack([np.bincount(at, weights=emb[bucket, d] * share, minlength=len(batch)) for d in range(DIM)], axis=1)
    p = softmax(mean @ w)
    p[np.arange(len(batch)), y] -= 1
    back = p @ w.T
    w -= rate * (mean.T @ p)
    rows, place = np.unique(bucket, return_inverse=True)
    for d in range(DIM):
        emb[rows, d] -= rate * GAIN * np.bincount(place, weights=share * back[at, d], minlength=len(rows))


def train(texts: list[bytes], y: np.ndarray, classes: int, epochs: int = 2, batch: int = 16, rate: float = 0.5, seed: int = 5) -> np.ndarray:
    """embeddings @ weights, by stochastic gradient descent in batches over all parts of the texts."""
    rng = np.random.default_rng(seed)
    emb = (rng.standard_normal((1 << BUCKETS_LOG, DIM)) / DIM).astype(np.float32)
    w = np.zeros((DIM, classes))
    cut = [parts(t) for t in texts]
    examples, label = bags([p for x in cut for p in x]), np.repeat(y, [len(x) for x in cut])
    some = np.array([len(b) > 0 for b, _ in examples], bool)
    order = np.flatnonzero(some)
    done, last = 0, epochs * max(1, -(-len(order) // batch))
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(order), max(1, -(-len(order) // batch))):
            if len(part):
                step(emb, w, [examples[i] for i in part], label[part], rate * (1 - done / last))
            done += 1
    return emb @ w


def calibrate(raw: np.ndarray, y: np.ndarray, precision: float = 0.995) -> tuple[float, float]:
    """The temperature of least log loss, and the lowest score above which this share of rows is right."""
    if not len(y):
        return 1.0, 0.0
    temperatures = np.exp(np.linspace(-2, 3, 51))
    at = np.arange(len(y))
    t = min(temperatures, key=lambda t: -np.log(softmax(raw / t)[at, y] + 1e-12).mean())
    p = softmax(raw / t)
    top, right = p.max(1), p.argmax(1) == y
    order = np.argsort(-top)
    good = np.cumsum(right[order]) / np.arange(1, len(y) + 1) >= precision
    return float(t), float(top[order][np.flatnonzero(good)[-1]]) if good.any() else 1.0


def sample(docs: DataFrame, most: int = 3000) -> tuple[list[bytes], list[str]]:
    """Whole texts and languages of at most so many rows: lang not null, crc32 of the id modulo 4 not 2, first by hash.

    Of the rows of one id the least counts, by language and text.
    """
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc32_of_id() % 4 != 2))
    chosen = known.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = known.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min(F.struct("lang", "text")).alias("row")).select("doc_id", "row.text", "row.lang")
    rows = rows.toArrow().sort_by("doc_id")
    return [x.encode() for x in rows["text"].to_pylist()], rows["lang"].to_pylist()


def fit(docs: DataFrame) -> dict:
    texts, langs = sample(docs)
    names = sorted(set(langs))
    y = np.array([names.index(x) for x in langs], np.int64)
    if not names:
        return {"names": [], "table": np.zeros((1 << BUCKETS_LOG, 1)), "least": 0.0}
    aside = np.arange(len(y)) % 5 == 0 if len(y) >= 50 else np.zeros(len(y), bool)
    table = train([t for t, a in zip(texts, aside, strict=True) if not a], y[~aside], len(names))
    # Calibration must hold for short texts too, so each text set aside counts as a whole, in parts and in short parts.
    held = [(x, c) for t, c, a in zip(texts, y, aside, strict=True) if a for x in [t, *parts(t), *parts(t, 40)]]
    data, held_y = [t for t, _ in held], np.array([c for _, c in held], np.int64)
    starts = np.concatenate([[0], np.cumsum([len(t) for t in data])]).astype(np.int64)
    t, least = calibrate(logits(np.frombuffer(b"".join(data), np.uint8), starts, table) if data else np.zeros((0, len(names))), held_y)
    return {"names": names, "table": table / t, "least": least}


def has_letter(text: str | None) -> bool:
    return bool(text) and (_ASCII_LETTER.search(text) is not None or any(map(str.isalpha, text)))


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, lang_pred, score, rejected. A text that is null or has no letter: und, 0, true."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array(m["names"] or ["und"], object)
        for batch in batches:
            for row, data, starts in _text.pieces(batch.column("text")):
                n = len(starts) - 1
                some = np.array([has_letter(x) for x in batch.column("text").slice(row, n).to_pylist()], bool)
                p = softmax(logits(data, starts, m["table"]))
                score = np.where(some & bool(m["names"]), p.max(1), 0.0)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(row, n), pa.array(np.where(some, names[p.argmax(1)], "und"), pa.string()), pa.array(score), pa.array(score < m["least"])], ["doc_id", "lang_pred", "score", "rejected"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    found = predict(docs, fit(docs))
    return found.withColumn("held_out", F.coalesce(crc32_of_id() % 4 == 2, F.lit(False))).select("doc_id", "held_out", "lang_pred", "score", "rejected")
