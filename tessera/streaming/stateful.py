"""Stateful rules over events: as Structured Streaming, and over batches with the same results."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout


def every_nth(df: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    """The rows at which a counter of each group reaches n and begins again."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_k") % n == 0).drop("_k")


def every_nth_stream(df: DataFrame, by: str, n: int) -> DataFrame:
    """(by, fired): how often the counter reached n, by batch."""

    def run(key, frames: Iterator[pd.DataFrame], state):
        count = (state.get[0] if state.exists else 0) + sum(len(f) for f in frames)
        state.update((count % n,))
        yield pd.DataFrame({by: [key[0]], "fired": [count // n]})

    kind = dict(df.dtypes)[by]
    return df.groupBy(by).applyInPandasWithState(run, f"{by} {kind}, fired long", "count long", "append", GroupStateTimeout.NoTimeout)


def admit(times: list[int], most: int, window: int, accepted: list[int] | None = None) -> list[bool]:
    """Which calls a limiter admits: those after fewer than most accepted ones within the window. Denied ones leave no trace."""
    kept = deque(accepted or [])
    out = []
    for t in times:
        while kept and kept[0] <= t - window:
            kept.popleft()
        out.append(len(kept) < most)
        if out[-1]:
            kept.append(t)
    if accepted is not None:
        accepted[:] = kept
    return out


def limited(df: DataFrame, key: str, seconds: str, tie: str, most: int, window: int) -> DataFrame:
    """df with allowed, by a sequential fold of each key's calls."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([seconds, tie])
        return rows.assign(allowed=admit(rows[seconds].tolist(), most, window))

    return df.groupBy(key).applyInPandas(run, ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields), "allowed boolean"]))


def limited_stream(df: DataFrame, key: str, seconds: str, most: int, window: int) -> DataFrame:
    """(key, seconds, allowed); the state holds at most `most` accepted times of a key."""

    def run(k, frames: Iterator[pd.DataFrame], state):
        kept = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(seconds)
        allowed = admit(rows[seconds].tolist(), most, window, kept)
        state.update((kept,))
        yield pd.DataFrame({key: k[0], seconds: rows[seconds].tolist(), "allowed": allowed})

    kinds = dict(df.dtypes)
    return df.groupBy(key).applyInPandasWithState(run, f"{key} {kinds[key]}, {seconds} long, allowed boolean", "kept array<long>", "append", GroupStateTimeout.NoTimeout)


def unseen(batch: DataFrame, seen: DataFrame | None, key: str, order: str, most: int = 50) -> DataFrame:
    """The keys that fire for a batch: none for the first one, which is the baseline; later at most so many unseen keys."""
    if seen is None:
        return batch.limit(0)
    return batch.dropDuplicates([key]).join(seen.select(key), key, "left_anti").orderBy(order).limit(most)


def counters_stream(df: DataFrame, by: str, hit) -> DataFrame:
    """Totals and hits by key, for update mode."""
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("total"), F.count_if(hit).alias("hits"))


def merge_tags(old: DataFrame, new: DataFrame, key: str, managed: list[str]) -> DataFrame:
    """Managed tags are replaced by the new ones, others stay."""
    both = old.alias("o").join(new.alias("n"), F.expr(f"o.{key} = n.{key}"), "full")
    empty = F.array().cast("array<string>")
    kept = F.filter(F.coalesce("o.tags", empty), lambda t: ~t.isin(*managed))
    return both.select(F.coalesce(f"o.{key}", f"n.{key}").alias(key), F.array_sort(F.array_union(kept, F.coalesce("n.tags", empty))).alias("tags"))


def sync(local: DataFrame, upstream: DataFrame, key: str, pending: str, in_window) -> DataFrame:
    """Upstream rows replace local ones; local rows that upstream lacks go, unless they wait to be sent or lie outside the window."""
    kept = local.join(upstream.select(key), key, "left_anti").filter(F.col(pending) | ~in_window)
    return kept.unionByName(upstream.withColumn(pending, F.lit(False)), allowMissingColumns=True)
