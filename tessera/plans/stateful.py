"""Stateful rules as batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.plans import fixtures as X
from tessera.plans.registry import query
from tessera.streaming import stateful as S

c = F.col


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS k FROM events) WHERE k % 5 = 0")
def w14_every_nth(t):
    return S.every_nth(t.events, ["event_type", "user_id"], ["ts", "event_id"], 5).select("event_id")


@query("SELECT event_type, user_id, floor(count(*) / 5)::BIGINT AS fired FROM events GROUP BY event_type, user_id HAVING count(*) >= 5")
def u1_fire_counts(t):
    rows = t.events.groupBy("event_type", "user_id").agg(F.floor(F.count(F.lit(1)) / 5).alias("fired"))
    return rows.filter("fired > 0")


@query("SELECT event_id AS k FROM events WHERE ts >= TIMESTAMP '2024-01-20' ORDER BY event_id LIMIT 50")
def u2_unseen(t):
    """The second batch overlaps the first; at most 50 keys fire."""
    keys = t.events.select(c("event_id").alias("k"), "ts")
    day = lambda x: F.lit(x).cast("timestamp_ntz")
    return S.unseen(keys.filter(c("ts") >= day("2024-01-15")), keys.filter(c("ts") < day("2024-01-20")), "k", "k").select("k")


@query("SELECT count(*) AS fresh FROM events WHERE ts > (SELECT max(ts) FROM events WHERE ts < TIMESTAMP '2024-01-20')")
def u3_watermark(t):
    last = t.events.filter(c("ts") < F.lit("2024-01-20").cast("timestamp_ntz")).agg(F.max("ts").alias("mark"))
    return t.events.join(F.broadcast(last), c("ts") > c("mark")).agg(F.count(F.lit(1)).alias("fresh"))  # last is one row


@query()
def u4_limiter(t):
    calls = t.events.select("event_id", "user_id", F.unix_seconds(c("ts").cast("timestamp")).alias("s"))
    return S.limited(calls, "user_id", "s", "event_id", 3, 36_000).select("event_id", "allowed")


_LOCAL = X.rows("uid, title, pending, in_window", "('a', 'old', false, true)", "('b', 'mine', true, true)", "('c', 'gone', false, true)", "('d', 'far', false, false)")


@query("SELECT * FROM (VALUES ('a', 'new'), ('b', 'mine'), ('d', 'far'), ('e', 'added')) AS t(uid, title)")
def u5_sync(t):
    up = t.inline(X.rows("uid, title", "('a', 'new')", "('e', 'added')"))
    return S.sync(t.inline(_LOCAL), up, "uid", "pending", c("in_window")).select("uid", "title")


@query("SELECT * FROM (VALUES ('m1', 'mine,urgent'), ('m2', 'spam'), ('m3', 'own')) AS t(id, tags)")
def u6_merge_tags(t):
    split = lambda df: df.withColumn("tags", F.split("tags", ","))
    old, new = split(t.inline(X.rows("id, tags", "('m1', 'mine,spam')", "('m3', 'own')"))), split(t.inline(X.rows("id, tags", "('m1', 'urgent')", "('m2', 'spam')")))
    return S.merge_tags(old, new, "id", ["spam", "urgent"]).select("id", F.array_join("tags", ",").alias("tags"))


@query(f"SELECT id FROM ({X.TASKS}) WHERE status = 'active' AND next_run <= '{X.NOW}' AND id NOT IN (5)")
def u7_due_tasks(t):
    return t.inline(X.TASKS).filter((c("status") == "active") & (c("next_run") <= X.NOW) & ~c("id").isin(5)).select("id")


@query("SELECT event_type, count(*) AS total, count(*) FILTER (WHERE value > 50) AS hits FROM events GROUP BY event_type")
def u10_counters(t):
    return S.counters_stream(t.events, "event_type", c("value") > 50)


@query()
def w10_limiter_denied(t):
    """How many calls each user was denied."""
    calls = t.events.select("event_id", "user_id", F.unix_seconds(c("ts").cast("timestamp")).alias("s"))
    return S.limited(calls, "user_id", "s", "event_id", 2, 86_400).groupBy("user_id").agg(F.count_if(~c("allowed")).alias("denied"))


_ROUNDS = X.rows("run, i, sig, said", "(1, 1, 'a', '')", "(1, 2, 'a', '')", "(1, 3, 'a', '')", "(1, 4, 'a', '')", "(1, 5, 'a', '')", "(2, 1, 'a', 'x')", "(2, 2, 'b', '')", "(2, 3, 'a', '')")


@query("SELECT * FROM (VALUES (1, true), (2, false)) AS t(run, stuck)")
def q8_repeat_guard(t):
    """Four rounds in a row without text that repeat one of the last six signatures, or 15 equal calls."""
    from pyspark.sql import Window

    w = Window.partitionBy("run").orderBy("i")
    rows = t.inline(_ROUNDS).withColumn("again", F.array_contains(F.collect_list("sig").over(w.rowsBetween(-6, -1)), c("sig")) & (c("said") == ""))
    rows = rows.withColumn("island", F.sum(F.when(c("again"), 0).otherwise(1)).over(w))
    runs = rows.filter("again").groupBy("run", "island").agg(F.count(F.lit(1)).alias("n")).groupBy("run").agg(F.max("n").alias("n"))
    often = rows.groupBy("run", "sig").agg(F.count(F.lit(1)).alias("k")).groupBy("run").agg(F.max("k").alias("k"))
    return often.join(runs, "run", "left").select("run", ((F.coalesce("n", F.lit(0)) >= 4) | (c("k") >= 15)).alias("stuck"))


@query("SELECT * FROM (VALUES (1), (4)) AS t(id)")
def q10_due_reminders(t):
    """Due within 90 seconds of now and not pinged in the last 25 minutes."""
    notes = t.inline(X.rows("id, due", "(1, '2024-01-31 00:01:00')", "(2, '2024-01-31 00:02:00')", "(3, '2024-01-30 23:59:00')", "(4, '2024-01-30 23:58:30')"))
    pings = t.inline(X.rows("id, at", "(3, '2024-01-30 23:50:00')", "(4, '2024-01-30 23:00:00')"))
    sec = lambda x: F.unix_seconds(x.cast("timestamp"))
    now = sec(F.lit(X.NOW))
    rows = notes.filter(F.abs(sec(c("due")) - now) <= 90).join(pings, "id", "left")
    return rows.filter(c("at").isNull() | (now - sec(c("at")) > 1500)).select("id")


@query("SELECT * FROM (VALUES (2)) AS t(id)")
def q12_new_urgent(t):
    urgent, told = t.inline(X.rows("id", "(1)", "(2)")), t.inline(X.rows("id", "(1)", "(9)"))
    return urgent.join(told, "id", "left_anti")


@query("SELECT * FROM (VALUES (2, 'b')) AS t(id, url)")
def e6_round_novelty(t):
    seen = t.inline(X.rows("url", "('a')"))
    return t.inline(X.rows("id, url", "(1, 'a')", "(2, 'b')", "(3, 'a')")).join(seen, "url", "left_anti").select("id", "url")
