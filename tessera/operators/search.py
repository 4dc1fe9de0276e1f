"""Ranking and retrieval: transcript search, web ranking, memory, skill and vector retrieval."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add, or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T

# Word and domain lists that scores depend on.
NEWS = ("news", "nyheter", "headlines", "breaking", "latest", "today", "idag")
SPORTS = ("sport", "sports", "soccer", "football", "hockey", "nba", "nfl", "mlb", "fifa", "world cup", "championship", "quarterfinal", "eliminates")
LOW_VALUE = ("facebook.com", "www.facebook.com", "sports.yahoo.com", "yahoo.com", "www.yahoo.com", "msn.com", "www.msn.com")
TRUSTED = (
    "apnews.com", "www.apnews.com", "reuters.com", "www.reuters.com", "bbc.com", "www.bbc.com", "cbc.ca", "www.cbc.ca",
    "ctvnews.ca", "www.ctvnews.ca", "globalnews.ca", "www.globalnews.ca", "theguardian.com", "www.theguardian.com",
    "euronews.com", "www.euronews.com", "dw.com", "www.dw.com", "government.se", "www.government.se",
)
NEWS_PHRASES = ("latest news", "breaking news", "daily coverage", "news from")
QUERY_TYPES = {
    "identity": ("name", "who", "i", "am", "called", "identity", "myself", "me", "my"),
    "contact": ("phone", "email", "address", "contact", "number", "where", "located", "reach"),
    "preference": ("like", "prefer", "favorite", "want", "love", "hate", "dislike", "enjoy", "interested"),
    "task": ("todo", "task", "remind", "meeting", "appointment", "schedule", "deadline"),
    "fact": ("what", "when", "where", "how", "why", "explain", "describe", "information", "know"),
}
BOOSTS = {
    "contact": (1.4, ("@gmail.com", "@", ".com", "phone", "number", "address", "http", "www", "tel:")),
    "preference": (1.3, ("like", "love", "hate", "dislike", "prefer", "favorite", "enjoy", "interested")),
    "task": (1.3, ("todo", "task", "remind", "meeting", "appointment", "schedule", "deadline", "need to")),
}
IDENTITY = ("name is", "i'm", "i am", "called", "my name", "named", "call me")
MEMORY_KINDS = (
    ("contacts", ("phone", "email", "address", "lives", "works"), ("contact", "phone", "address", "email")),
    ("preferences", ("likes", "dislikes", "prefers", "favorite"), ("like", "prefer", "favorite", "want")),
    ("tasks", ("todo", "task", "remind", "meeting"), ("todo", "task", "schedule", "remind")),
)


def _any(text: Column, needles: tuple) -> Column:
    return reduce(or_, (F.contains(text, F.lit(n)) for n in needles))


def _share(text: Column, terms: list[str]) -> Column:
    hits = reduce(add, (F.when(T.whole_word(text, t), 1).otherwise(0) for t in terms))
    return hits / F.lit(float(len(terms)))


def term_table(df: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, term, tf, length): an inverted index on words of letters, digits and underscores."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda w: w != "")
    return df.select(key, F.size(words).alias("length"), F.explode(words).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"), F.max("length").alias("length"))


def _times(words: Column, term: str) -> Column:
    return F.size(F.filter(words, lambda w: w == term))


def bm25(df: DataFrame, key: str, text: Column, query: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(key, score) of the rows that have every query term; Robertson's weighting with a floored idf.

    Only the terms of the query are kept before the aggregation, so the shuffle moves hits instead of the corpus.
    """
    terms = sorted(set(query.lower().split()))
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+"), lambda w: w != "")
    sized = df.select(F.col(key), F.size(words).alias("length"), *(_times(words, t).alias(f"tf{i}") for i, t in enumerate(terms)))
    stats = sized.agg(F.count(F.lit(1)).alias("rows"), F.avg("length").alias("mean"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))))
    hits = sized.filter(reduce(lambda x, y: x & y, (F.col(f"tf{i}") > 0 for i in range(len(terms))))).crossJoin(F.broadcast(stats))  # stats is one row
    score = F.lit(0.0)
    for i in range(len(terms)):
        tf, df_ = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.greatest(F.log((F.col("rows") - df_ + 0.5) / (df_ + 0.5)), F.lit(1e-6))
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    return hits.select(key, score.alias("score"))


def recency(age: Column, now: Column) -> Column:
    """1 up to 7 whole days, 0 from 30 on, linear between; a missing or unreadable date 0, a future one 1."""
    days = F.floor((F.unix_micros(now) - F.unix_micros(F.try_to_timestamp(age))) / 86_400_000_000)
    return F.when(days.isNull(), 0.0).when(days <= 7, 1.0).when(days >= 30, 0.0).otherwise((F.lit(30) - days) / F.lit(23.0))


def web_score(query: str, now: Column, title="title", snippet="snippet", url="url", age="age") -> Column:
    terms = [t for t in "".join(c if c.isalnum() or c == "_" else " " for c in query.lower()).split()]
    title, snippet = F.coalesce(F.col(title), F.lit("")), F.coalesce(F.col(snippet), F.lit(""))
    host = T.domain(F.col(url))
    by_title = F.when(title == "", 0.0).otherwise(_share(F.lower(title), terms))
    by_snippet = F.when(snippet == "", 0.0).otherwise((F.least(F.length(snippet), F.lit(200)) / F.lit(200.0) + _share(F.lower(snippet), terms)) / F.lit(2.0))
    by_domain = F.when(host == "", 0.0).when(host.isin(*TRUSTED) | host.endswith(".edu") | host.endswith(".gov"), 1.0).when(host.endswith(".org"), 0.7).otherwise(0.4)
    score = F.lit(2.0) * by_title + by_snippet + F.lit(1.5) * by_domain + recency(F.col(age), now)
    if any(t in NEWS for t in terms):
        both = F.lower(F.concat_ws(" ", title, snippet))
        sporty = lambda c: reduce(or_, (T.whole_word(c, s) for s in SPORTS))
        news = F.when(host.isin(*TRUSTED), 1.2).otherwise(0.0) + F.when(_any(both, NEWS_PHRASES), 0.4).otherwise(0.0) - F.when(host.isin(*LOW_VALUE), 0.8).otherwise(0.0)
        if not any(f" {s} " in f" {' '.join(terms)} " for s in SPORTS):
            news = news - F.when(sporty(both) | sporty(host), 1.5).otherwise(0.0)
        subject = [t for t in terms if t not in NEWS]
        if subject:
            news = news - F.when(reduce(or_, (T.whole_word(c, t) for t in subject for c in (both, host))), 0.0).otherwise(1.0)
        score = score + news
    return score


def query_type(query: str) -> str | None:
    """The first type one of whose words is a substring of the query; "i" and "am" make most queries identity ones."""
    return next((k for k, words in QUERY_TYPES.items() if any(w in query.lower() for w in words)), None)


def memory_relevance(df: DataFrame, query: str, text: str = "text", threshold: float = 0.05) -> DataFrame:
    """df with score, of the rows at or over the threshold. Identity rows score 0.9 for identity queries, else they go."""
    low = F.lower(text)
    identity = F.col(text).rlike(r"\b[A-Z][a-z]+ [A-Z][a-z]+\b") | _any(low, IDENTITY)
    words = F.lit(sorted({w.strip('.,!?";') for w in query.lower().split()}))
    score = T.jaccard(T.relevance_words(F.col(text)), words)
    kind = query_type(query)
    if kind in BOOSTS:
        factor, needles = BOOSTS[kind]
        score = F.when(_any(low, needles), score * F.lit(factor)).otherwise(score)
    score = F.when(F.contains(low, F.lit(query.lower())), F.greatest(score, F.lit(0.8))).otherwise(score)
    score = F.when(identity, F.lit(0.9) if kind == "identity" else F.lit(None).cast("double")).otherwise(score)
    return df.withColumn("score", score).filter(F.col("score") >= threshold)


def memory_kind(query: str, text: str = "text") -> Column:
    """The kind under which a memory is offered for a query; null if it is not."""
    low, q = F.lower(text), query.lower()
    words = F.lit(sorted({w.strip('.,!?";') for w in q.split()}))
    out = None
    for name, of_row, of_query in MEMORY_KINDS:
        value = F.lit(name if any(w in q for w in of_query) else None).cast("string")
        out = F.when(_any(low, of_row), value) if out is None else out.when(_any(low, of_row), value)
    return out.otherwise(F.when(T.jaccard(T.relevance_words(F.col(text)), words) > 0.4, "facts"))


def hybrid_memory(df: DataFrame, query_words: list[str], key: str, text: str, days: Column, vectors: DataFrame | None = None, boost: Column | None = None) -> DataFrame:
    """(key, score): keyword weight of distinct words with optional cosine scores; repeated query words count twice."""
    sets = df.select("*", F.array_distinct(T.memory_words(F.col(text))).alias("_words"))
    terms = sorted(set(query_words))
    stats = sets.agg(F.count(F.lit(1)).alias("_rows"), F.greatest(F.avg(F.size("_words")), F.lit(1.0)).alias("_mean"), *(F.count_if(F.array_contains("_words", t)).alias(f"_df{i}") for i, t in enumerate(terms)))
    out = sets.crossJoin(F.broadcast(stats))  # stats is one row
    raw = F.lit(0.0)
    for i, t in enumerate(terms):
        idf = F.log((F.col("_rows") - F.col(f"_df{i}") + 0.5) / (F.col(f"_df{i}") + 0.5) + 1)
        tf = F.lit(2.5) / (1 + F.lit(1.5) * (F.lit(0.25) + F.lit(0.75) * F.size("_words") / F.col("_mean")))
        raw = raw + F.when(F.array_contains("_words", t), F.lit(float(query_words.count(t))) * idf * tf).otherwise(0.0)
    words = F.least(F.least(raw / 6.0, F.lit(1.0)) * (boost if boost is not None else F.lit(1.0)), F.lit(1.0))
    fresh = F.lit(1.0) / (1 + F.greatest(days, F.lit(0)) * F.lit(0.05))
    if vectors is None:
        out = out.withColumn("_kw", words).filter("_kw >= 0.08D").withColumn("score", F.lit(0.95) * F.col("_kw") + F.lit(0.05) * fresh)
    else:
        out = out.join(vectors, key, "left").withColumn("_kw", words).withColumn("_vs", F.greatest(F.coalesce("similarity", F.lit(0.0)), F.lit(0.0)))
        out = out.filter("_vs >= 0.2D or _kw >= 0.08D").withColumn("score", F.lit(0.55) * F.col("_vs") + F.lit(0.4) * F.col("_kw") + F.lit(0.05) * fresh)
    return out.filter("score > 0.12D").select(key, "score")


def nearest(df: DataFrame, vector: str, probe: list[float], k: int, key: str) -> DataFrame:
    """The k rows of greatest cosine to the probe, ties by key; vectors have unit length."""
    return df.withColumn("similarity", T.cosine(F.col(vector), F.lit(probe))).orderBy(F.desc("similarity"), key).limit(k)


def nearest_of_each(rows: DataFrame, asked: DataFrame, key: str, vector: str, block: int = 8192) -> DataFrame:
    """(key, similarity): the greatest cosine of each asked vector to a row of another key; vectors have unit and one length.

    The questions go to the executors about block at a time, so that what is sent has a bound, and each task answers
    with one row for a question that it has met. Null keys and vectors meet nothing, and a question that meets nothing is left out.
    """
    asked, rows = (x.select(F.col(key).cast("long").alias("k"), F.col(vector).cast("array<double>").alias("v")).dropna() for x in (asked, rows))
    blocks, found = max(1, -(-asked.count() // block)), None
    for i in range(blocks):
        part = asked.filter(F.pmod(F.xxhash64("k"), F.lit(blocks)) == i).toArrow()
        at = part["k"].to_numpy()
        sent = rows.sparkSession.sparkContext.broadcast((at, part["v"].combine_chunks().flatten().to_numpy().reshape(len(at), -1 if len(at) else 0)))
        best = rows.mapInArrow(_greatest(sent), "k long, similarity double")
        found = best if found is None else found.union(best)
    return found.groupBy(F.col("k").alias(key)).agg(F.max("similarity").alias("similarity"))


def _greatest(sent, step: int = 1024):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, questions = sent.value
        best = np.full(len(asked), -np.inf)
        for batch in (b for b in batches if len(asked) and len(b)):
            keys, all_vectors = batch.column("k").to_numpy(), batch.column("v").flatten().to_numpy().reshape(len(batch), -1)
            for a in range(0, len(batch), step):
                near = all_vectors[a : a + step] @ questions.T
                near[keys[a : a + step, None] == asked] = -np.inf
                best = np.maximum(best, near.max(axis=0))
        met = best > -np.inf
        yield pa.RecordBatch.from_arrays([pa.array(asked[met]), pa.array(best[met])], ["k", "similarity"])

    return run


def vector_first(chunks: DataFrame, docs: DataFrame, probe: list[float], words: list[str], k: int, least: float) -> DataFrame:
    """(doc_id, source): the k chunks (vec_id, embedding) nearest to the probe, of at least this cosine.

    Where there is none, the k documents (doc_id, text) that hold most of the words, ties by id.
    """
    near = nearest(chunks, "embedding", probe, k, "vec_id").filter(F.col("similarity") >= least)
    near = near.select(F.col("vec_id").alias("doc_id"), F.lit("vector").alias("source"), F.lit(0).alias("part"))
    held = docs.select("doc_id", F.size(F.array_intersect(T.document_words(F.col("text")), F.lit(words))).alias("score"))
    held = held.filter("score > 0").orderBy(F.desc("score"), "doc_id").limit(k).select("doc_id", F.lit("words").alias("source"), F.lit(1).alias("part"))
    both = near.union(held)
    return both.join(F.broadcast(both.agg(F.min("part").alias("part"))), "part").select("doc_id", "source")  # the minimum is one row


def hybrid_vector(lanes: list[DataFrame], probe: list[float], query: str, k: int, owned: bool = False, vector="embedding", text="document", key="id") -> DataFrame:
    """Two stages: each lane's nearest rows, then 0.7 cosine and 0.3 word share, rounded to 4 places; each key once."""
    words = sorted(set(query.lower().split()))
    found = None
    for i, lane in enumerate(lanes):
        near = nearest(lane, vector, probe, min(k * 6 if owned else k * 3, max(k, 20)), key).withColumn("lane", F.lit(i))
        found = near if found is None else found.unionByName(near)
    share = F.size(F.array_intersect(T.plain_words(F.col(text)), F.lit(words))) / F.lit(float(len(words)))
    found = found.withColumn("score", F.bround(F.lit(0.7) * F.col("similarity") + F.lit(0.3) * share, 4))
    from tessera.operators.relational import keep_one

    return keep_one(found, [key], [F.desc("score"), "lane"]).orderBy(F.desc("score"), key).limit(k)


def keyword_fallback(df: DataFrame, query: str, text: str) -> DataFrame:
    """Rows by how many of the query's words stand in the text, as substrings and with repetitions."""
    score = reduce(add, (F.when(F.contains(F.lower(text), F.lit(w)), 1).otherwise(0) for w in query.lower().split()))
    return df.withColumn("score", score).filter("score > 0")


def skill_relevance(df: DataFrame, query: str, threshold: float = 0.3) -> DataFrame:
    """Published and draft skills at or over the threshold, with score."""
    words = F.lit(sorted({w.strip('.,!?";:()[]') for w in query.lower().split() if len(w) > 1}))
    whole = F.concat_ws(" ", F.coalesce("name", F.lit("")), F.coalesce("description", F.lit("")), F.coalesce("when_to_use", F.lit("")), F.array_join("tags", " "), F.array_join("procedure", " "))
    score = T.jaccard(words, T.skill_words(whole))
    fits = F.filter("tags", lambda t: (F.size(T.skill_words(t)) > 0) & (F.size(F.array_except(T.skill_words(t), words)) == 0))
    score = F.aggregate(fits, score, lambda s, _: F.greatest(s, F.lit(0.3)) * F.lit(1.3))
    score = F.when(F.contains(F.lower(F.coalesce("description", F.lit(""))), F.lit(query.lower())), F.greatest(score, F.lit(0.6))).otherwise(score)
    score = score * (1 + F.coalesce(F.col("confidence").try_cast("double"), F.lit(0.5)) * F.lit(0.1)) * F.when(F.col("uses") > 0, 1.05).otherwise(1.0)
    return df.filter(F.col("status").isin("published", "draft")).withColumn("score", score).filter(F.col("score") >= threshold)


def confident(least: float) -> Column:
    """Published always; machine-made drafts only with a readable confidence; other drafts also without one."""
    c = F.col("confidence").try_cast("double")
    return F.when(F.col("status") == "published", True).when(F.col("source") == "teacher-escalation", F.coalesce(c, F.lit(0.0)) >= least).otherwise(F.coalesce(c, F.lit(1.0)) >= least)
