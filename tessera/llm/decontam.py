"""Benchmark decontamination by winnowing, with DataFrame functions only.

Of each text the hashes of all GRAM-word sequences are taken, and the least one in every run of RUN consecutive
hashes is its fingerprint. Ten shared words hold RUN such sequences, so texts that share ten words share a
fingerprint: none is missed. Documents that share one are extended: the ten-word windows around the places
of its sequence are compared, word by word, with the items' windows. An item of fewer than ten words is one window;
its hash is looked for at every place, for each length that occurs among the items.

A null or empty text has no words and no hits; an item without words has no window. Repeated rows each get
their own result; rows are told apart by id and text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._stage import Workspace

WINDOW, GRAM = 10, 5
RUN = WINDOW - GRAM + 1
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Test-side tables up to so many rows, and hits up to so many fingerprints, are broadcast; beyond, joins shuffle.
BROADCAST_ROWS = 1_000_000


def words(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    # lower() also folds letters outside A-Z, so only text without any takes that faster way.
    low = F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))
    return F.array_remove(F.split(low, NOT_WORD, -1), "")


def _places(n: Column, length: int) -> Column:
    """0, 1, ... for every place where so many words fit."""
    return F.when(n >= length, F.sequence(F.lit(0), n - length)).otherwise(F.array().cast("array<int>"))


def _gram(hashes: str, length: int):
    """The hash of so many words from place i on.

    The first counts twice: a column that a lambda names only once would be computed anew for each place, as the
    optimizer then merges the projection that makes it.
    """
    return lambda i: F.xxhash64(F.lit(length), F.col(hashes)[i], *(F.col(hashes)[i + k] for k in range(length)))


def fingerprinted(df: DataFrame, short: list[int]) -> DataFrame:
    """df with _words, _n, _grams (all GRAM-word hashes) and _prints, from its column text.

    _prints has the winnowed hashes, and those of all sequences of each length in short.
    """
    df = df.withColumn("_words", words(F.col("text")))
    df = df.withColumns({"_n": F.size("_words"), "_hashes": F.transform("_words", lambda w: F.xxhash64(w))})
    df = df.withColumn("_grams", F.transform(_places(F.col("_n"), GRAM), _gram("_hashes", GRAM)))
    least = winnowed()
    every = [F.transform(_places(F.col("_n"), k), _gram("_hashes", k)) for k in short]
    return df.withColumn("_prints", F.array_distinct(F.concat(least, *every)))


def _windows(items: DataFrame) -> DataFrame:
    """(_window, _length, _item): every window of every item, once for each item."""
    items = items.select(F.col("item_id").cast("string").alias("_item"), words(F.col("text")).alias("_words"))
    items = items.withColumn("_length", F.least(F.size("_words"), F.lit(WINDOW))).filter("_length > 0")
    at = F.explode(F.sequence(F.lit(1), F.size("_words") - F.col("_length") + 1)).alias("_at")
    cut = F.array_join(F.slice("_words", F.col("_at"), F.col("_length")), " ")
    return items.select("_item", "_length", "_words", at).select(cut.alias("_window"), "_length", "_item").distinct()


def _short_places(k: int) -> Column:
    """Where a found hash of k words stands. A lambda's second parameter would be the index, so k is bound here."""
    gram = _gram("_hashes", k)
    where = F.filter(_places(F.col("_n"), k), lambda i: F.array_contains("_found", gram(i)))
    return F.transform(where, lambda i: F.struct(i.alias("at"), F.lit(k).alias("length")))


def _hint(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def contaminated(docs: DataFrame, items: DataFrame, rows: bool = True) -> DataFrame:
    """docs (doc_id, text) to doc_id, n_words, n_hit, n_items, items_sha256, contaminated, one row for each row.

    With rows false, only the hit documents' doc_id, _text (their text's hash), _places and _classes.
    """
    space = Workspace(docs.sparkSession, "decontam")
    docs = docs.select("doc_id", "text")
    # Windows with the same set of items are one class; a document carries classes, not items.
    sets = _windows(items).groupBy("_window", "_length").agg(F.array_sort(F.collect_set("_item")).alias("_items"))
    windows = space.keep("windows", sets.withColumn("_class", F.md5(F.to_json("_items").cast("binary"))))
    classes = space.keep("classes", windows.groupBy("_class").agg(F.first("_items").alias("_items")))
    windows = windows.select("_window", "_length", "_class")
    n_windows = windows.count()
    short = sorted(r[0] for r in windows.filter(F.col("_length") < WINDOW).select("_length").distinct().collect())  # nine values at most
    # An item's own short sequences are looked for only where the whole item is that short.
    own = fingerprinted(items.select("text"), short)
    useful = F.when(F.col("_n") >= WINDOW, winnowed()).otherwise(F.transform(F.array("_n"), lambda n: _whole(n, short)))
    prints = space.keep("prints", own.filter("_n > 0").select(F.explode_outer(useful).alias("_print")).filter("_print is not null").distinct())
    n_prints = prints.count()

    key = ["doc_id", "_text"]
    named = docs.withColumn("_text", F.xxhash64(F.coalesce("text", F.lit(""))))
    # explode() would have the optimizer push a filter on the array's size, with all that makes the array, to the scan.
    found = fingerprinted(named, short).select(*key, F.explode_outer("_prints").alias("_print"))
    found = found.join(_hint(prints, n_prints), "_print", "left_semi")
    hits = space.keep("hits", found.groupBy(*key).agg(F.collect_set("_print").alias("_found")))
    n_found = hits.agg(F.coalesce(F.sum(F.size("_found") + 3), F.lit(0))).first()[0]

    again = _hint(hits.withColumnRenamed("doc_id", "_id").withColumnRenamed("_text", "_hit_text"), n_found)
    near = named.join(again, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_hit_text"))).drop("_id", "_hit_text")
    near = fingerprinted(near, []).drop("_prints", "text")
    at = F.array_compact(F.transform("_grams", lambda g, i: F.when(F.array_contains("_found", g), i)))
    around = F.transform(F.when(F.col("_n") >= WINDOW, at).otherwise(F.array().cast("array<int>")), lambda i: F.sequence(F.greatest(i - (RUN - 1), F.lit(0)), F.least(i, F.col("_n") - WINDOW)))
    near = near.withColumn("_ten", F.array_distinct(F.flatten(around)))
    places = [F.transform("_ten", lambda i: F.struct(i.alias("at"), F.lit(WINDOW).alias("length")))]
    places += [_short_places(k) for k in short]
    near = near.select(*key, "_words", F.explode_outer(F.concat(*places)).alias("_place"))
    cut = F.array_join(F.slice("_words", F.col("_place.at") + 1, F.col("_place.length")), " ")
    near = near.select(*key, "_place", F.col("_place.length").alias("_length"), cut.alias("_window"))
    spans = near.join(_hint(windows, n_windows), ["_window", "_length"])
    spans = space.keep("spans", spans.groupBy(*key).agg(F.collect_set("_place").alias("_places"), F.collect_set("_class").alias("_classes")))
    if not rows:
        return spans

    covered = F.flatten(F.transform("_places", lambda x: F.sequence(x["at"], x["at"] + x["length"] - 1)))
    n_hit = spans.select(*key, F.size(F.array_distinct(covered)).alias("_n_hit"))
    listed = spans.select(*key, F.explode("_classes").alias("_class")).join(_hint(classes, n_windows), "_class")
    listed = listed.groupBy(*key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("_items")))).alias("_items"))
    told = n_hit.alias("a").join(listed.alias("b"), F.expr("a.doc_id <=> b.doc_id and a._text = b._text")).select(F.col("a.doc_id").alias("_id"), F.col("a._text").alias("_hit_text"), "_n_hit", "_items")

    size = F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", -1), ""))
    out = named.select(*key, size.cast("long").alias("n_words"))
    out = out.join(told, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_hit_text")), "left")
    some = F.coalesce("_items", F.array().cast("array<string>"))
    return out.select(
        "doc_id", "n_words", F.coalesce("_n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(some).cast("long").alias("n_items"),
        F.sha2(F.array_join(some, ",").cast("binary"), 256).alias("items_sha256"), F.coalesce(F.col("_n_hit") > 0, F.lit(False)).alias("contaminated"),
    )


def winnowed() -> Column:
    """The least hash of every run of RUN, from _grams and _n."""
    return F.transform(_places(F.col("_n"), WINDOW), lambda i: F.least(*(F.col("_grams")[i + k] for k in range(RUN))))


def _whole(n: Column, short: list[int]) -> Column:
    """The hash of a whole short item, at whichever length it has."""
    out = F.lit(None).cast("long")
    for k in short:
        out = F.when(n == k, _gram("_hashes", k)(F.lit(0))).otherwise(out)
    return out


def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
i AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, length, array_to_string(w[s:s + length - 1], ' ') AS win
  FROM (SELECT item_id, w, least(len(w), 10) AS length, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS s FROM i WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT length FROM iw),
dwords AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS s FROM d),
runs AS (SELECT doc_id, s, list(word) OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS ten FROM dwords),
dw AS (SELECT doc_id, s, length, array_to_string(ten[1:length], ' ') AS win FROM runs, lengths WHERE len(ten) >= length),
hits AS (SELECT dw.doc_id, dw.s, dw.length, iw.item_id FROM dw JOIN iw ON dw.win = iw.win AND dw.length = iw.length),
cover AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + length - 1)) AS p FROM (SELECT DISTINCT doc_id, s, length FROM hits)) GROUP BY doc_id),
listed AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(c.n_hit, 0)::BIGINT AS n_hit, coalesce(l.n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(l.items, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover c ON d.doc_id = c.doc_id LEFT JOIN listed l ON d.doc_id = l.doc_id
"""
