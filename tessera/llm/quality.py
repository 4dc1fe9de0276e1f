"""Quality classifier: attention-based multiple-instance learning over the passages of a document.

Each run of PASSAGE words is encoded as character-class pairs, hashed words and repetition; a hidden layer and gated
attention (tanh times sigmoid) weigh the passages, and the weighted sum is scored. Only document labels are
learned from. The training sample has a bound of rows, not of their passages; scoring reads every passage of every document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._stage import crc32_of_id, small_batches

PASSAGE, HIDDEN, GATES, HASHED = 64, 32, 16, 256
CLASSES = np.full(256, 14, np.uint16)
CLASSES[128:] = 15
for _i, _group in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\v\f", b"\n", b".", b",", b"|", b"#", b"*", b"$", b"%", b"&", b"!")):
    CLASSES[list(_group)] = _i
WIDTH = 256 + HASHED + 5


def _distinct(group: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each group its number of distinct hashes; for each entry whether an equal one stands before it."""
    order = np.lexsort((h, group))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (group[order][1:] != group[order][:-1])
    again = np.empty(len(h), bool)
    again[order] = ~new
    return np.bincount(group[order][new], minlength=n), again


def encode(data: np.ndarray, starts: np.ndarray, cache: dict) -> tuple[np.ndarray, np.ndarray]:
    """Passages as rows of float32, and the document of each. A document without words has one empty passage."""
    n = len(starts) - 1
    rows, a, b = _text.spans(~_text.SPACE[data], starts)
    words = _text.span_hashes(data, a, b, cache)
    first = _text.bounds(rows, n)
    index = np.arange(len(rows)) - first[rows]
    each = np.maximum(1, -(-(first[1:] - first[:-1]) // PASSAGE))
    base = np.concatenate([[0], np.cumsum(each)])
    total, owner = int(base[-1]), np.repeat(np.arange(n), each)
    of_word = base[rows] + index // PASSAGE
    # A passage's bytes begin at its first word, a document's first passage at the document.
    begin = np.repeat(starts[:-1], each)
    opens = index % PASSAGE == 0
    later = opens & (index > 0)
    begin[of_word[later]] = a[later]
    length = np.diff(np.append(begin, len(data)))
    of_byte = np.repeat(np.arange(total), length)
    x = np.zeros((total, WIDTH), np.float32)
    if len(data) > 1:
        c = CLASSES[data]
        pair = c[:-1] * 16 + c[1:]
        inner = np.ones(len(pair), bool)
        ends = starts[1:-1]
        inner[ends[(ends > 0) & (ends < len(data))] - 1] = False  # no pair of two documents' bytes
        x[:, :256] = np.bincount(of_byte[:-1][inner] * 256 + pair[inner], minlength=total * 256).reshape(total, 256)
    if len(words):
        x[:, 256 : 256 + HASHED] = np.bincount(of_word * HASHED + (words >> np.uint64(56)).astype(np.int64), minlength=total * HASHED).reshape(total, HASHED)
    size = np.maximum(1, np.bincount(of_word, minlength=total))
    x[:, :256] = np.sqrt(x[:, :256] / np.maximum(1, length)[:, None])
    x[:, 256 : 256 + HASHED] = np.sqrt(x[:, 256 : 256 + HASHED] / size[:, None])
    distinct, _ = _distinct(of_word, words, total)
    five, at = _text.grams(words, rows, 5)
    _, again = _distinct(rows[at], five, n)
    x[:, -4] = distinct / size
    x[:, -3] = np.bincount(of_word[at], weights=again, minlength=total) / size
    x[:, -2] = np.bincount(of_word, weights=np.minimum(b - a, 40), minlength=total) / size / 10
    x[:, -1] = size / PASSAGE
    if len(words) > 1:
        same = (words[1:] == words[:-1]) & (rows[1:] == rows[:-1])
        x[:, -5] = np.bincount(of_word[1:], weights=same, minlength=total) / size
    return x, owner


def _attend(x: np.ndarray, owner: np.ndarray, n: int, m: dict) -> tuple:
    h = np.tanh(x @ m["w1"] + m["b1"])
    t, g = np.tanh(h @ m["v"]), 1 / (1 + np.exp(-(h @ m["u"])))
    s = np.clip((t * g) @ m["w"], -30, 30)
    e = np.exp(s)
    weight = e / np.bincount(owner, weights=e, minlength=n)[owner]
    at = _text.bounds(owner, n)[:-1]
    z = np.add.reduceat(h * weight[:, None].astype(h.dtype), at, axis=0)  # each document has a passage
    return h, t, g, weight, z, z @ m["c"] + m["c0"]


def score(x: np.ndarray, owner: np.ndarray, n: int, m: dict) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(_attend(x, owner, n, m)[-1], -35, 35)))


def train(bags: list[np.ndarray], y: np.ndarray, epochs: int = 14, steps: int = 900, batch: int = 64, rate: float = 3e-3, seed: int = 7) -> dict:
    """Adam on the log loss, with a decaying rate, for so many epochs and steps at least.

    Without both labels the score is constant.
    """
    rng = np.random.default_rng(seed)
    m = {k: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32) for k, s in (("w1", (WIDTH, HIDDEN)), ("v", (HIDDEN, GATES)), ("u", (HIDDEN, GATES)), ("w", (GATES,)), ("c", (HIDDEN,)))}
    m |= {"b1": np.zeros(HIDDEN, np.float32), "c0": np.zeros(1, np.float32)}
    if not len(y) or y.min() == y.max():
        m["c"][:] = 0
        m["c0"][:] = 0 if not len(y) else (4 if y[0] else -4)
        return m
    first, second = ({k: np.zeros_like(v) for k, v in m.items()} for _ in range(2))
    epochs = max(epochs, -(-steps * batch // len(bags)))
    step, last = 0, epochs * -(-len(bags) // batch)
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(bags)), -(-len(bags) // batch)):
            x = np.concatenate([bags[i] for i in part]).astype(np.float32)
            owner = np.repeat(np.arange(len(part)), [len(bags[i]) for i in part])
            h, t, g, weight, z, out = _attend(x, owner, len(part), m)
            d = ((1 / (1 + np.exp(-out)) - y[part]) / len(part)).astype(np.float32)
            dz = d[:, None] * m["c"]
            back = (dz[owner] * h).sum(1)
            mean = np.bincount(owner, weights=weight * back, minlength=len(part))[owner]
            ds = (weight * (back - mean)).astype(np.float32)
            dt, dg = ds[:, None] * m["w"] * g * (1 - t * t), ds[:, None] * m["w"] * t * g * (1 - g)
            dh = (dz[owner] * weight[:, None] + dt @ m["v"].T + dg @ m["u"].T) * (1 - h * h)
            grad = {"w1": x.T @ dh, "b1": dh.sum(0), "v": h.T @ dt, "u": h.T @ dg, "w": (t * g).T @ ds, "c": z.T @ d, "c0": d.sum(keepdims=True)}
            step += 1
            now = rate * (1 - step / (last + 1))
            for k, v in grad.items():
                v = v + 1e-4 * m[k]
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.999 * second[k] + 0.001 * v * v
                m[k] = (m[k] - now * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return m


def sample(docs: DataFrame, labels: DataFrame, most: int = 4000) -> tuple[list[np.ndarray], np.ndarray]:
    """All encoded passages and the labels of at most so many labelled rows whose id's crc32 modulo 5 is not 0.

    They are the first by their id's hash; of the rows of one id the least text counts.
    """
    known = labels.filter(F.col("quality").isNotNull() & (crc32_of_id() % 5 != 0)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.first("quality").alias("quality"), F.min(F.coalesce("text", F.lit(""))).alias("text"))
    rows = rows.select("doc_id", "text", "quality")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = {}
        for batch in batches:
            for row, data, starts in _text.pieces(batch.column("text")):
                x, owner = encode(data, starts, cache)
                at, n = _text.bounds(owner, len(starts) - 1), len(starts) - 1
                x = x.astype(np.float16)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(row, n), batch.column("quality").slice(row, n), pa.array([x[at[i] : at[i + 1]].tobytes() for i in range(n)], pa.binary())], ["doc_id", "quality", "x"])

    table = rows.mapInArrow(run, "doc_id long, quality int, x binary").toArrow().sort_by("doc_id")
    bags = [np.frombuffer(x, np.float16).reshape(-1, WIDTH) for x in table["x"].to_pylist()]
    return bags, table["quality"].to_numpy().astype(np.float32)


def classify(docs: DataFrame, model: dict, keep: float = 0.3) -> DataFrame:
    """docs with _score and _predicted, whole texts; a null text counts as empty. Input columns of these names go."""
    docs = docs.drop("_score", "_predicted")
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, m = {}, shared.value
        for batch in batches:
            for row, data, starts in _text.pieces(batch.column("text")):
                n = len(starts) - 1
                s = score(*encode(data, starts, cache), n, m).astype(np.float64)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(row, n) for c in batch.schema.names if c != "text"), batch.column("text").slice(row, n), pa.array(s)], [*(c for c in batch.schema.names if c != "text"), "text", "_score"])
        _text.release()

    columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != "text"]
    scored = docs.select(*(f"`{f.name}`" for f in docs.schema.fields if f.name != "text"), "text").mapInArrow(run, ", ".join([*columns, "text string", "_score double"]))
    return scored.withColumn("_predicted", (F.col("_score") >= keep).cast("int"))


def fit(docs: DataFrame, labels: DataFrame) -> dict:
    return train(*sample(docs, labels))


def op2_quality_mil(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held = F.coalesce(crc32_of_id() % 5 == 0, F.lit(False))
    return classify(docs, model).select("doc_id", held.alias("held_out"), F.col("_score").alias("score"), F.col("_predicted").alias("predicted"))
