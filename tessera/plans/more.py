"""Sets, fallbacks and parsing that the other families do not hold."""

from __future__ import annotations

from datetime import datetime

import pandas as pd
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import relational as R
from tessera.operators import search as S
from tessera.operators import times
from tessera.plans import fixtures as X
from tessera.plans.registry import query

c = F.col


@query("""WITH w AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS w FROM conversations)
SELECT a.conv_id, a.turn AS a, b.turn AS b, len(list_intersect(a.w, b.w)) AS shared, round(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w)))::DOUBLE, 6) AS jaccard
FROM w a JOIN w b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""")
def e4_set_overlap(t):
    """Word sets of each turn and the next."""
    rows = t.conversations.select("conv_id", "turn", T.plain_words(c("text")).alias("w"))
    a, b = rows.toDF("conv_id", "a", "x"), rows.toDF("conv_id", "b", "y").withColumn("a", c("b") - 1)
    both = a.join(b, ["conv_id", "a"])
    return both.select("conv_id", "a", "b", F.size(F.array_intersect("x", "y")).cast("long").alias("shared"), F.round(T.jaccard(c("x"), c("y")), 6).alias("jaccard"))


@query("SELECT * FROM (VALUES ('book a meeting', 'base,calendar'), ('send the invoice', 'base,mail'), ('hello', 'base')) AS t(q, tools)")
def e7_forced_tools(t):
    """Tools that words of the query force in, less those that are switched off."""
    rows = t.inline(X.rows("q", "('book a meeting')", "('send the invoice')", "('hello')"))
    forced = F.array_compact(F.array(F.lit("base"), F.when(c("q").rlike("meeting|schedule"), "calendar"), F.when(c("q").rlike("invoice|mail|send"), "mail"), F.when(c("q").rlike("hello"), "shell")))
    return rows.select("q", F.array_join(F.array_sort(F.array_except(F.array_distinct(forced), F.array(F.lit("shell")))), ",").alias("tools"))


@query("SELECT * FROM (VALUES ('k2', 0.8), ('k5', 0.3)) AS t(id, similarity)")
def j20_vector_hits_of_owner(t):
    hits = t.inline(X.rows("id, similarity", "('k2', 0.8)", "('k4', 0.9)", "('k5', 0.3)", "('gone', 0.9)"))
    return hits.join(t.inline(X.MEMORIES).filter("owner = 'alice'").select("id"), "id", "left_semi")


@query("SELECT * FROM (VALUES ('k2', 'vector')) AS t(id, source)")
def r11_recall_with_fallback(t):
    """Vector hits, or word relevance where there is none."""
    vector = t.inline(X.rows("id, similarity", "('k2', 0.8)")).select("id", F.lit("vector").alias("source"), F.lit(0).alias("part"))
    words = S.memory_relevance(t.inline(X.MEMORIES), "green tea").select("id", F.lit("words").alias("source"), F.lit(1).alias("part"))
    both = vector.union(words)
    return both.join(F.broadcast(both.agg(F.min("part").alias("part"))), "part").select("id", "source")  # the minimum is one row


@query("SELECT doc_id, 'words' AS source FROM documents WHERE regexp_matches(lower(text), '(^|[^a-z0-9_-])license([^a-z0-9_-]|$)') ORDER BY doc_id LIMIT 5")
def r13_vector_first(t):
    """All chunks against a probe of unit length; none has a cosine of 0.6, so words decide."""
    return S.vector_first(t.embeddings, t.documents, [0.125] * 64, ["license"], 5, 0.6)


@query("SELECT * FROM (VALUES ('foo AND \"bar baz\" (x)', 'foo AND \"bar baz\" x'), ('a.b c_d -', '\"a.b\" \"c_d\"'), ('***', NULL)) AS t(q, safe)")
def f2_search_expression(t):
    """Words and balanced phrases; words with marks inside are quoted."""
    rows = t.inline(X.rows("q", "('foo AND \"bar baz\" (x)')", "('a.b c_d -')", "('***')"))
    parts = F.regexp_extract_all("q", F.lit(r'("[^"]+"|[\p{L}\p{N}_][\p{L}\p{N}_.-]*)'), 1)
    clean = F.transform(parts, lambda p: F.when(p.startswith('"'), F.concat(F.lit('"'), F.trim(F.trim(p, F.lit('"'))), F.lit('"'))).otherwise(F.trim(p, F.lit("._-"))))
    quoted = F.transform(F.filter(clean, lambda p: ~p.isin("", '""')), lambda p: F.when(~p.startswith('"') & p.rlike("[._-]"), F.concat(F.lit('"'), p, F.lit('"'))).otherwise(p))
    return rows.select("q", F.nullif(F.array_join(quoted, " "), F.lit("")).alias("safe"))


@query("SELECT * FROM (VALUES (1, 'green tea'), (2, ''), (3, 'x')) AS t(id, value)")
def f18_memory_value(t):
    rows = t.inline(X.rows("id, text", "(1, ' \"The  green   tea!\" ')", "(2, 'see https://x.org')", "(3, 'x.')"))
    return rows.select("id", T.memory_value(c("text")).alias("value"))


@query("SELECT * FROM (VALUES ('first'), ('second')) AS t(text)")
def f20_bullets(t):
    rows = t.inline("SELECT 'Notes:' || chr(10) || '- first' || chr(10) || '2. second' || chr(10) || '- ' || chr(10) || 'end' AS content, 'assistant' AS role")
    return rows.filter("role = 'assistant'").select(F.explode(T.bullets(c("content"))).alias("text"))


@query("SELECT * FROM (VALUES (1, '2024-02-01 13:00:00'), (2, '2024-01-31 15:00:00'), (3, '2024-05-13 21:00:00'), (4, NULL), (5, '2024-02-02 00:00:00'), (6, '2024-02-01 00:00:00'), (7, '2024-01-31 00:00:00'), (8, '2024-01-31 15:00:00'), (9, '2024-01-31 12:45:00'), (10, NULL)) AS t(id, moment)")
def f31_dates_in_words(t):
    now = datetime(2024, 1, 31, 12)

    @F.pandas_udf("string")
    def read(text: pd.Series) -> pd.Series:
        return pd.Series([m.isoformat(" ") if (m := times.moment(x, now)) else None for x in text], dtype=object)

    rows = t.inline(X.rows("id, text", "(1, 'tomorrow 1pm')", "(2, 'in 3 hours')", "(3, '2024-05-13T21:00:00')", "(4, 'someday')", "(5, 'Friday')", "(6, 'tomorrow')", "(7, 'tonight')", "(8, '3pm today')", "(9, 'in 45min')", "(10, '25:00')"))
    return rows.select("id", read("text").alias("moment"))


@query("SELECT name, round(pb * 0.58 + 0.000008 * pb * ctx + 0.5, 6)::DOUBLE AS gb FROM (VALUES ('a', 7.0, 8192), ('b', 70.0, 4096)) AS t(name, pb, ctx)")
def f35_memory_estimate(t):
    rows = t.inline(X.rows("name, pb, ctx", "('a', 7.0, 8192)", "('b', 70.0, 4096)"))
    pb = c("pb").cast("double")
    return rows.select("name", F.round(pb * 0.58 + 8e-6 * pb * c("ctx") + 0.5, 6).alias("gb"))


@query(f"SELECT id, updated, count(*) OVER () AS total FROM (SELECT id, coalesce(updated_at, created_at) AS updated FROM ({X.SESSIONS}) WHERE NOT coalesce(archived, false) AND name <> 'Incognito') ORDER BY updated DESC, id LIMIT 15")
def q6_unfiled_batch(t):
    rows = t.inline(X.SESSIONS).filter(~F.coalesce("archived", F.lit(False)) & (c("name") != "Incognito")).select("id", F.coalesce("updated_at", "created_at").alias("updated"))
    total = F.broadcast(rows.agg(F.count(F.lit(1)).alias("total")))  # one row
    return rows.orderBy(F.desc("updated"), "id").limit(15).crossJoin(total)


@query("SELECT event_id, (SELECT count(*) FROM events WHERE user_id = 7) AS total FROM events WHERE user_id = 7 ORDER BY ts DESC, event_id LIMIT 10 OFFSET 5")
def q20_run_history(t):
    rows = t.events.filter("user_id = 7")
    total = F.broadcast(rows.agg(F.count(F.lit(1)).alias("total")))  # one row
    return R.page(rows, [F.desc("ts"), "event_id"], 5, 10).select("event_id").crossJoin(total)


@query("SELECT * FROM (VALUES (1, 'Ann <ann@x.org> · Mon, 1 Jan 2024'), (2, 'Ann · Monday'), (3, NULL)) AS t(id, meta)")
def x8_quote_meta(t):
    rows = t.inline("SELECT * FROM (VALUES (1, 'From: Ann <ann@x.org>' || chr(10) || 'Date: Mon, 1 Jan 2024' || chr(10) || 'x'), (2, 'On Monday, Ann wrote:'), (3, 'x')) AS t(id, body)")
    who, when = F.regexp_extract("body", r"(?im)^from:\s*(.+)$", 1), F.regexp_extract("body", r"(?im)^(?:date|sent):\s*(.+)$", 1)
    on = r"(?im)^on\s+(.+?),\s*([^,]+?)\s+wrote:"
    attributed = F.concat(F.regexp_extract("body", on, 2), F.lit(" · "), F.regexp_extract("body", on, 1))
    meta = F.when((who != "") & (when != ""), F.concat(who, F.lit(" · "), when)).when(F.regexp_extract("body", on, 2) != "", attributed).when(who != "", who).when(when != "", when)
    return rows.select("id", meta.alias("meta"))


@query("SELECT * FROM (VALUES ('gpu', 126.72::DOUBLE), ('offload', 29.71)) AS t(mode, tps)")
def r16b_speed_model(t):
    """Bandwidth over model size; an offloaded share reads at main memory's speed, in a harmonic blend; MoE at 0.8."""
    rows = t.inline(X.rows("mode, bw, gb, share, moe", "('gpu', 1008.0, 3.5, 0.0, true)", "('offload', 1008.0, 3.5, 0.25, false)"))
    bw, gb, share = (c(x).cast("double") for x in ("bw", "gb", "share"))
    blend = 1 / (share / 55.0 + (1 - share) / bw)
    return rows.select("mode", F.round(blend / gb * 0.55 * F.when(c("moe"), 0.8).otherwise(1.0), 2).alias("tps"))
