"""Line dedup by site-relative frequency, with DataFrame functions only.

A line is compared without the spaces, tabs and carriage returns around it; an empty one is never boilerplate.
Of each host the pages that contain a line are divided by all its pages; a line over the ratio, on enough pages,
is dropped wherever it stands on that host. Every row is a page; a null host is a host of its own; a null text stays
null. A page that loses all lines stays, with an empty text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._stage import Workspace, packed, unpacked

#: Share of a host's pages, and number of pages, from which on a line is boilerplate.
RATIO, PAGES = 0.01, 3
#: Up to so many boilerplate lines (16 bytes each) of all hosts are broadcast; more are joined by a shuffle on the host,
#: whose large partitions adaptive execution splits.
BROADCAST_LINES = 200_000


def _key(line: Column) -> Column:
    return F.trim(line, F.lit(" \t\r"))


def boilerplate(pages: DataFrame, ratio: float, least: int) -> DataFrame:
    """(host, line) from (host, text): md5 of each boilerplate line by host.

    Counting moves one row for each line, host and task at most.
    """
    total = pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    lines = F.array_distinct(F.transform(F.filter(F.split("text", "\n", -1), lambda x: _key(x) != ""), lambda x: F.unhex(F.md5(_key(x).cast("binary")))))
    seen = pages.select("host", F.explode(lines).alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    # What is left has one row for a line on at least so many pages, and there is one total for each host.
    both = seen.alias("s").join(total.alias("t"), F.col("s.host").eqNullSafe(F.col("t.host")))
    return both.filter(F.col("n") > F.col("pages") * ratio).select("s.host", "line")


def drop_lines(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, pages: int = PAGES) -> DataFrame:
    """docs with the text cleaned, and _n_lines and _n_dropped added; other columns as they are.

    Input columns named _n_lines or _n_dropped are replaced; no other name can clash.
    """
    rows = packed(docs, host=F.col(f"`{host}`"), text=F.col(f"`{text}`"))
    listed = Workspace(docs.sparkSession, "lines").keep("boilerplate", boilerplate(rows.select("host", "text"), ratio, pages))
    few = listed.count() <= BROADCAST_LINES
    # A host's set has fewer lines than its lines a page divided by the ratio, so one row for each host joins the pages.
    # A page is first met with the set by hash, so that only its own hits are looked for line by line.
    listed = listed.groupBy(F.col("host").alias("of")).agg(F.collect_set("line").alias("drop"))
    listed = F.broadcast(listed) if few else listed
    out = rows.join(listed, F.col("host").eqNullSafe(F.col("of")), "left")
    lines = F.split("text", "\n", -1)
    digest = lambda x: F.unhex(F.md5(_key(x).cast("binary")))
    out = out.withColumn("hit", F.when(F.col("drop").isNotNull(), F.array_intersect(F.transform(lines, digest), F.col("drop"))))
    out = out.withColumn("kept", F.when(F.coalesce(F.size("hit"), F.lit(0)) <= 0, lines).otherwise(F.filter(lines, lambda x: ~F.array_contains("hit", digest(x)))))
    n = F.coalesce(F.size(lines), F.lit(0))
    gone = F.when(F.col("kept").isNull(), 0).otherwise(F.size(lines) - F.size("kept"))
    return unpacked(out, docs.columns, **{text: F.array_join("kept", "\n"), "_n_lines": n.cast("long"), "_n_dropped": gone.cast("long")})


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    out = drop_lines(docs)
    return out.select("doc_id", "source", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


ORACLE_SQL = f"""
WITH lines AS (
  SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents),
pages AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
seen AS (
  SELECT source, key, count(*) AS n
  FROM (SELECT DISTINCT doc_id, source, trim(line, chr(32) || chr(9) || chr(13)) AS key FROM lines) GROUP BY source, key),
bad AS (
  SELECT s.source, s.key FROM seen s JOIN pages p ON s.source IS NOT DISTINCT FROM p.source
  WHERE s.key <> '' AND s.n >= {PAGES} AND s.n > p.pages * {RATIO}::DOUBLE),
marked AS (
  SELECT l.doc_id, l.line, l.pos, b.key IS NULL AS kept FROM lines l
  LEFT JOIN bad b ON l.source IS NOT DISTINCT FROM b.source AND trim(l.line, chr(32) || chr(9) || chr(13)) = b.key),
built AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE NOT kept) AS n_dropped,
    coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE kept), '') AS cleaned
  FROM marked GROUP BY doc_id)
SELECT d.doc_id, d.source, coalesce(b.n_lines, 0)::BIGINT AS n_lines, coalesce(b.n_dropped, 0)::BIGINT AS n_dropped, md5(b.cleaned) AS text_md5
FROM documents d LEFT JOIN built b ON d.doc_id = b.doc_id
"""
