"""Retention and tidy rules. They differ on purpose, so each is its own function; now is always given."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T

# Fixed values.
THROWAWAY = (
    "test", "testing", "asdf", "asd", "hello", "hi", "hey", "yo", "sup", "hola", "hii", "hiii", "heyo",
    "foo", "bar", "baz", "tmp", "temp", "scratch", "untitled", "new chat", "delete", "remove", "junk", "trash", "xxx",
    "abc", "qwerty", "blah", "stuff", "whatever", "idk", "ok", "lol", "bruh", "hmm", "hm", "meh",
)
JUNK_TITLES = (
    "untitled", "untitled document", "new document", "document", "new email", "new mail", "new message", "reply", "fwd", "re:",
    "test", "testing", "asdf", "asd", "foo", "bar", "baz", "tmp", "temp", "scratch", "scratchpad", "draft", "delete",
    "remove", "junk", "trash", "xxx", "abc", "qwerty",
)
PROTECTED = ("important", "remember", "save this", "keep", "bookmark")
PLACEHOLDERS = ("", "empty", "(empty)", "-", "—", "none", "n/a", "na", "tbd")


def _ago(now: Column, days: float) -> Column:
    return (now.cast("timestamp") - F.make_dt_interval(secs=F.lit(days * 86400).cast("decimal(18,6)"))).cast("timestamp")


def _time(name: str) -> Column:
    return F.col(name).cast("timestamp")


def _short(name: Column) -> Column:
    return F.lower(F.trim(F.coalesce(name, F.lit(""))))


def to_archive(sessions: DataFrame, now: Column) -> DataFrame:
    """Idle for more than 7 days and not archived; a null flag is not false."""
    return sessions.filter((_time("last_accessed") < _ago(now, 7)) & (F.col("archived") == False))  # noqa: E712


def to_delete(sessions: DataFrame, messages: DataFrame, now: Column, recent: int = 10) -> DataFrame:
    """Archived, idle for more than 14 days, not important, under 20 messages, none of the newest, unprotected name."""
    newest = sessions.orderBy(_time("created_at").desc_nulls_last(), "id").limit(recent).select("id")
    name = F.lower(F.coalesce("name", F.lit("")))
    rows = sessions.filter(F.col("archived") & (_time("last_accessed") < _ago(now, 14)) & ~F.col("is_important") & (F.col("message_count") < 20))
    rows = rows.join(F.broadcast(newest), "id", "left_anti").filter(~F.exists(F.lit(list(PROTECTED)), lambda k: F.contains(name, k)))
    count = messages.groupBy(F.col("session_id").alias("id")).agg(F.count(F.lit(1)).alias("_m"))
    return rows.join(count, "id", "left").withColumn("freed", F.coalesce("_m", F.lit(0)) * 512).drop("_m")


def _activity(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    m = messages.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("m"), F.count_if(F.col("role") == "assistant").alias("answers"),
        F.min_by(F.when(F.col("role") == "user", F.col("content")), F.when(F.col("role") == "user", F.col("ts"))).alias("first"),
        F.sum(F.coalesce(F.length("content"), F.lit(0))).alias("chars"),
    )
    out = sessions.join(m, sessions["id"] == m["session_id"], "left").drop("session_id")
    return out.withColumns({"m": F.coalesce("m", F.lit(0)), "answers": F.coalesce("answers", F.lit(0)), "first": _short(F.col("first")), "short": _short(F.col("name"))})


def fresh(now: Column, minutes: int = 10) -> Column:
    last = F.greatest(*(_time(x) for x in ("last_message_at", "last_accessed", "updated_at", "created_at")))
    return F.coalesce(last >= _ago(now, minutes / 1440), F.lit(False))


def throwaway(sessions: DataFrame, messages: DataFrame, now: Column, aggressive: bool = True) -> DataFrame:
    """Sessions to throw away, with a reason.

    aggressive: not archived ones, first texts of up to 8 words, and any of up to 250 characters in all. Else: first
    texts of up to 3 words in at most 2 messages.
    """
    rows = _activity(sessions.filter(~F.coalesce("archived", F.lit(False))) if aggressive else sessions, messages)
    words = F.size(F.filter(F.split("first", r"\s+"), lambda w: w != ""))
    brief = (words <= 8) & (F.length("first") <= 80) if aggressive else (F.col("m") <= 2) & (words <= 3) & (F.length("first") <= 40)
    reason = F.when(F.trim("name") == "Incognito", "incognito").when(fresh(now), None).when(F.col("m") == 0, "empty").when(F.col("m") > 4, None)
    reason = reason.when(F.col("short").isin(*THROWAWAY) | F.col("short").startswith("chat:") | F.col("first").isin(*THROWAWAY), "name")
    reason = reason.when((F.col("m") == 1) & (F.col("answers") == 0), "unanswered").when((F.col("first") != "") & brief, "brief")
    if aggressive:
        reason = reason.when(F.col("chars") <= 250, "trivial")
    return rows.filter(~F.col("is_important")).withColumn("reason", reason).filter("reason is not null")


def empty_or_old(sessions: DataFrame, now: Column) -> DataFrame:
    """action delete: no messages and older than an hour; archive: idle for more than 30 days, with messages."""
    delete = (F.col("message_count") == 0) & F.coalesce(_time("created_at") <= _ago(now, 1 / 24), F.lit(True))
    archive = (F.col("message_count") > 0) & ~F.coalesce("archived", F.lit(False)) & (_time("last_accessed") < _ago(now, 30)) & ~F.col("is_important")
    return sessions.withColumn("action", F.when(delete, "delete").when(archive, "archive")).filter("action is not null")


def junk_documents(docs: DataFrame) -> DataFrame:
    """docs with reason: empty, junk title, throwaway content, or a quoted reply chain without words of its own."""
    content = F.trim(F.coalesce("content", F.lit("")), F.lit(" \t\r\n"))
    lines = F.filter(F.split(content, "\n"), lambda x: F.trim(x) != "")
    is_quote = lambda x: F.ltrim(x).startswith(">")
    is_head = lambda x: F.trim(x).rlike(r"^On .+ wrote:?\s*$")
    own = F.trim(F.array_join(F.filter(lines, lambda x: ~is_quote(x) & ~is_head(x)), "\n"))
    quoted, heads = F.size(F.filter(lines, is_quote)), F.size(F.filter(lines, is_head))
    chain = ((quoted > 0) | (heads > 0)) & (F.length(own) < 50) & (quoted / F.greatest(F.size(lines), F.lit(1)) > 0.4)
    reason = F.when(content.isin("", "# Untitled"), "empty").when(_short(F.col("title")).isin(*JUNK_TITLES), "title")
    return docs.withColumn("reason", reason.when(F.lower(T.bare(content)).isin(*JUNK_TITLES), "content").when(chain, "quotes"))


def strict_documents(docs: DataFrame) -> DataFrame:
    """The stricter tidy: also stubs of mails, under 30 real characters, and single lines under 50."""
    content = F.trim(F.coalesce("content", F.lit("")), F.lit(" \t\r\n"))
    body = F.filter(F.transform(F.split(content, "\n"), lambda x: F.trim(x)), lambda x: ~x.isin("", "---"))
    filler = lambda x: x.rlike(r"(?i)^(to|from|cc|bcc|subject|reply-to):") & F.lower(F.trim(F.regexp_replace(x, r"^[^:]*:", ""))).isin(*PLACEHOLDERS)
    title = _short(F.col("title"))
    stub = (title.isin("new email", "new mail", "new message") | F.coalesce(F.col("language") == "email", F.lit(False))) & (F.size(body) > 0) & F.forall(body, filler)
    real = T.real_length(content)
    reason = F.when(content.isin("", "# Untitled"), "empty").when(stub, "stub").when(title.isin(*JUNK_TITLES), "title").when(real < 30, "short")
    return docs.withColumn("reason", reason.when(~content.contains("\n") & (real < 50), "line"))
