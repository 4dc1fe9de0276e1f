"""URL filters: host and path rules, then a blocked Bloom filter of listed canonical URLs and an exact hash join.

The filter is a table with one row for each block of 512 bits, eight longs; a URL sets or tests one bit in each of
the eight words of its block. Pages whose bits are all set go on to the exact join with the list, which removes
false positives; the others are done. Only DataFrame functions are used.

A null url has an empty host and path and is on no list. Repeated rows are judged one by one, an empty table gives none.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._stage import Workspace, packed, unpacked

#: (host, path, verdict). Fixed values.
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
WORDS = 8
#: A filter of more bytes than this is joined by block instead of broadcast.
BROADCAST_BYTES = 64 << 20
#: A list of more URLs than this is joined by a shuffle of the pages that the filter lets through.
BROADCAST_URLS = 100_000


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or no ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, URL, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Without www. or m., without a default port, .html or index page and trailing slashes; null for an empty host."""
    bare = F.regexp_replace(F.regexp_replace(host, r"^(www|m)\.", ""), r":(80|443)$", "")
    return F.when(host != "", F.concat(bare, F.regexp_replace(path, r"(/index)?(\.html?)?/*$", "")))


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; null where none fits."""
    rule = verdict = None
    for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = (F.when(fits, x) if y is None else y.when(fits, x) for x, y in ((h + p, rule), (v, verdict)))
    return rule, verdict


def _bits(url: Column, blocks: int) -> list[Column]:
    """The URL's block, and its bit in each of the block's words."""
    h, g = F.xxhash64(url), F.xxhash64(url, F.lit(1))
    one = F.lit(1).cast("long")
    masks = [F.call_function("shiftleft", one, F.shiftrightunsigned(g, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(WORDS)]
    return [F.pmod(h, F.lit(blocks)).alias("_block"), *(m.alias(f"_w{i}") for i, m in enumerate(masks))]


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """One row for each block that has a bit set; listed has the one column _url."""
    bits = listed.select(*_bits(F.col("_url"), blocks))
    return bits.groupBy("_block").agg(*(F.bit_or(f"_w{i}").alias(f"_f{i}") for i in range(WORDS)))


def blocks_for(n: int, bits: int = 12) -> int:
    """Blocks for n URLs at so many bits each; about one false positive in 200."""
    return max(1, math.ceil(n * bits / 512))


def on_list(pages: DataFrame, listed: DataFrame) -> DataFrame:
    """pages with _maybe, the filter's answer, and _listed, the exact one, by the column _url; null is neither."""
    listed = Workspace(pages.sparkSession, "urls").keep("listed", listed.select("_url").filter(F.col("_url").isNotNull()).distinct())
    n = listed.count()
    blocks = blocks_for(n)
    table = bloom(listed, blocks)
    if blocks * (WORDS + 1) * 8 <= BROADCAST_BYTES:
        table = F.broadcast(table)
    probe = pages.select("*", *_bits(F.col("_url"), blocks)).withColumnRenamed("_block", "_at")
    hit = F.lit(True)
    for i in range(WORDS):
        hit = hit & (F.col(f"_f{i}").bitwiseAND(F.col(f"_w{i}")) == F.col(f"_w{i}"))
    probe = probe.join(table, F.col("_at") == F.col("_block"), "left")
    probe = probe.withColumn("_maybe", F.coalesce(hit & F.col("_url").isNotNull(), F.lit(False)))
    probe = probe.drop("_at", "_block", *(f"_{x}{i}" for x in "wf" for i in range(WORDS)))
    if n <= BROADCAST_URLS:
        key = F.when(F.col("_maybe"), F.col("_url"))
        exact = F.broadcast(listed.select(F.col("_url").alias("_listed_url")))
        return probe.join(exact, key == F.col("_listed_url"), "left").withColumn("_listed", F.col("_listed_url").isNotNull()).drop("_listed_url")
    # Only the pages that the filter lets through are shuffled to a long list.
    some = probe.filter("_maybe").join(listed.select(F.col("_url").alias("_listed_url")), F.col("_url") == F.col("_listed_url"), "left")
    some = some.withColumn("_listed", F.col("_listed_url").isNotNull()).drop("_listed_url")
    return some.unionByName(probe.filter("not _maybe").withColumn("_listed", F.lit(False)))


def spam_titles(pages: DataFrame) -> DataFrame:
    """The list for the query below: canonical URLs of pages whose title has at least three runs of symbols."""
    title = F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1)
    runs = F.size(F.split(title, r"[#*$%]{3}", -1)) - 1
    return pages.filter(runs >= 3).select(canonical(host_of(F.col("url")), path_of(F.col("url"))).alias("_url"))


def judge(pages: DataFrame, listed: DataFrame, url: str = "url") -> DataFrame:
    """pages with host, path, rule, verdict and listed: the longest fitting rule's verdict, else block for a listed URL.

    Input columns of these names are replaced; no other name can clash.
    """
    rows = packed(pages, _host=host_of(F.col(f"`{url}`")), _path=path_of(F.col(f"`{url}`")))
    rule, verdict = ruled(F.col("_host"), F.col("_path"))
    rows = rows.withColumns({"_rule": rule, "_verdict": verdict, "_url": canonical(F.col("_host"), F.col("_path"))})
    out = on_list(rows, listed)
    verdict = F.coalesce("_verdict", F.when(F.col("_listed"), "block").otherwise("allow"))
    return unpacked(out, pages.columns, host=F.col("_host"), path=F.col("_path"), rule=F.col("_rule"), verdict=verdict, listed=F.col("_listed"))


def op5_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    out = judge(pages.select("page_id", "url"), spam_titles(pages.select("url", "html")))
    return out.select("page_id", "host", "path", "rule", "verdict", "listed")


_FITS = " ".join(
    f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN {{}}".replace("{}", f"struct_pack(rule := '{h}{p}', verdict := '{v}')")
    for h, p, v in sorted(RULES, key=lambda r: (-len(r[0] + r[1]), r))
)
ORACLE_SQL = rf"""
WITH parts AS (
  SELECT page_id, html, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
named AS (
  SELECT *, CASE WHEN host <> '' THEN regexp_replace(regexp_replace(host, '^(www|m)\.', ''), ':(80|443)$', '')
      || regexp_replace(path, '(/index)?(\.html?)?/*$', '') END AS canon,
    CASE {_FITS} END AS fit
  FROM parts),
listed AS (
  SELECT DISTINCT canon FROM named
  WHERE len(regexp_split_to_array(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), '[#*$%]{{3}}')) - 1 >= 3 AND canon IS NOT NULL)
SELECT page_id, host, path, fit.rule AS rule, coalesce(fit.verdict, CASE WHEN l.canon IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
  l.canon IS NOT NULL AS listed
FROM named n LEFT JOIN listed l ON n.canon = l.canon
"""
