"""Sources and sinks of the workspace: JSON, text, CSV, vCard, iCalendar, directories and logs.

Readers take a path that Spark can read; parsers take a DataFrame of whole texts, so any store will do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.relational import keep_one

MEMORY = "id string, text string, timestamp long, source string, category string, uses long, session_id string, owner string"
TEXTS = ("*.txt", "*.md", "*.py", "*.json", "*.csv", "*.html")
NAMES = ("name", "full name", "fullname", "display name", "displayname", "contact")
MAILS = ("email", "e-mail", "mail", "email address", "e-mail address")


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, value) of each file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def memories(texts: DataFrame) -> DataFrame:
    """Records of JSON lists of objects, defaults for what is missing; other entries are dropped."""
    rows = texts.select(F.explode(F.from_json("value", "array<string>")).alias("x"))
    rows = rows.select(F.from_json("x", MEMORY).alias("m"), "x").filter(F.substring(F.ltrim("x"), 1, 1) == "{")
    fill = {"timestamp": F.lit(0), "source": F.lit("user"), "category": F.lit("fact"), "uses": F.lit(0)}
    out = rows.select("m.*")
    out = out.withColumns({k: F.coalesce(k, v) for k, v in fill.items()})
    return out.withColumn("id", F.coalesce("id", F.substring(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256), 1, 16)))


def memory_lines(texts: DataFrame) -> DataFrame:
    """One record for each line that is not blank, for files that are no JSON."""
    lines = texts.filter(~is_json(F.col("value"))).select(F.explode(F.split("value", r"\r?\n")).alias("text"))
    return lines.select(F.trim("text").alias("text")).filter("text <> ''").select("text", F.lit("fact").alias("category"))


def is_json(text: Column) -> Column:
    return F.try_parse_json(text).isNotNull()


def json_directory(texts: DataFrame, schema: str) -> DataFrame:
    """One row for each file that is JSON; others are skipped."""
    return texts.filter(is_json(F.col("value"))).select("path", F.from_json("value", schema).alias("r")).select("path", "r.*")


def broken(texts: DataFrame) -> DataFrame:
    """Files that are empty or no JSON."""
    return texts.filter((F.trim("value") == "") | ~is_json(F.col("value"))).select("path")


def documents(spark: SparkSession, folder: str, globs: tuple = TEXTS) -> DataFrame:
    """(path, ext, text) of the files below a folder that have one of the endings."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "{" + ",".join(globs) + "}").load(folder)
    return files.select("path", F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).alias("ext"), F.decode("content", "UTF-8").alias("text"))


def index(docs: DataFrame, owner: str | None = None) -> DataFrame:
    """(id, path, pos, chunk): windows of each document, each id once."""
    rows = docs.select("path", F.posexplode(T.windows(F.col("text"))).alias("pos", "chunk"))
    return keep_one(rows.withColumn("id", T.content_id(F.col("chunk"), F.lit(owner) if owner else None)), ["id"], ["path", "pos"])


def contacts_csv(df: DataFrame) -> DataFrame:
    """(name, email) from a table with some header; without a known one the first two columns."""
    low = {c.strip().lower(): c for c in df.columns}
    pick = lambda names, at: low.get(next((n for n in names if n in low), None), df.columns[min(at, len(df.columns) - 1)])
    return df.select(F.trim(pick(NAMES, 0)).alias("name"), F.lower(F.trim(pick(MAILS, 1))).alias("email")).filter(F.col("email").contains("@"))


def contact_rows(df: DataFrame) -> DataFrame:
    """One row for each of the longer of a contact's two lists, and one if both are empty."""
    split = lambda c: F.filter(F.split(c, ";"), lambda x: x != "")
    both = F.arrays_zip(split("emails").alias("email"), split("phones").alias("phone"))
    out = df.select("id", "name", F.explode_outer(both).alias("x"))
    return out.select("id", "name", F.coalesce("x.email", F.lit("")).alias("email"), F.coalesce("x.phone", F.lit("")).alias("phone"))


def vcards(texts: DataFrame) -> DataFrame:
    """(name, emails, phones, address) of each card; group prefixes and parameters are dropped, repeats kept once."""
    unfolded = F.regexp_replace("value", r"\r?\n[ \t]", "")
    cards = texts.select(F.explode(F.regexp_extract_all(unfolded, F.lit(r"(?is)BEGIN:VCARD(.*?)END:VCARD"), 1)).alias("card"))
    lines = F.transform(F.split("card", r"\r?\n"), lambda x: F.regexp_replace(F.trim(x), r"^(?i)item\d+\.", ""))
    cards = cards.withColumn("l", lines)
    of = lambda name: F.array_distinct(F.transform(F.filter("l", lambda x: x.rlike(rf"(?i)^{name}[;:]")), lambda x: F.trim(F.regexp_replace(x, r"^[^:]*:", ""))))
    address = F.transform(of("ADR"), lambda x: F.array_join(F.filter(F.split(x, ";"), lambda p: F.trim(p) != ""), ", "))
    return cards.select(F.get(of("FN"), F.lit(0)).alias("name"), of("EMAIL").alias("emails"), of("TEL").alias("phones"), F.get(address, F.lit(0)).alias("address"))


def new_contacts(known: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming contacts (name, email) whose address is neither known nor on an earlier row."""
    rows = keep_one(incoming.withColumn("k", F.lower(F.trim("email"))), ["k"], ["name", "email"])
    return rows.join(known.select(F.lower(F.trim("email")).alias("k")).distinct(), "k", "left_anti").drop("k")


def calendar(texts: DataFrame) -> DataFrame:
    """(uid, summary, dtstart, dtend, all_day, rrule) of each VEVENT; a missing end is a day or an hour later."""
    unfolded = F.regexp_replace("value", r"\r?\n[ \t]", "")
    events = texts.select(F.explode(F.regexp_extract_all(unfolded, F.lit(r"(?is)BEGIN:VEVENT(.*?)END:VEVENT"), 1)).alias("e"))
    of = lambda name: F.trim(F.regexp_extract("e", rf"(?im)^{name}(?:;[^:\r\n]*)?:([^\r\n]*)", 1))
    time = lambda c: F.coalesce(F.try_to_timestamp(c, F.lit("yyyyMMdd'T'HHmmss")), F.try_to_timestamp(c, F.lit("yyyyMMdd")))
    rows = events.select(of("UID").alias("uid"), F.regexp_replace(of("SUMMARY"), r"\\([,;\\])", "$1").alias("summary"), F.rtrim(of("DTSTART"), F.lit("Z")).alias("s"), F.rtrim(of("DTEND"), F.lit("Z")).alias("f"), of("RRULE").alias("rrule"))
    rows = rows.withColumns({"all_day": F.length("s") == 8, "dtstart": time(F.col("s"))})
    end = F.coalesce(time(F.col("f")), F.when(F.col("all_day"), F.col("dtstart") + F.expr("INTERVAL 1 DAY")).otherwise(F.col("dtstart") + F.expr("INTERVAL 1 HOUR")))
    return rows.filter("dtstart is not null").select("uid", "summary", "dtstart", end.alias("dtend"), "all_day", "rrule")


def new_events(known: DataFrame, incoming: DataFrame) -> DataFrame:
    return keep_one(incoming, ["dtstart", "summary"], ["uid"]).join(known.select("dtstart", "summary").distinct(), ["dtstart", "summary"], "left_anti")


def escaped(text: Column) -> Column:
    out = text
    for a, b in (("\\", "\\\\"), (";", "\\;"), (",", "\\,"), ("\n", "\\n")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def calendar_lines(events: DataFrame) -> DataFrame:
    """One VEVENT text for each event, for write.text."""
    stamp = lambda c: F.date_format(F.col(c).cast("timestamp"), "yyyyMMdd'T'HHmmss")
    parts = [F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:"), "uid"), F.concat(F.lit("SUMMARY:"), escaped(F.col("summary"))), F.concat(F.lit("DTSTART:"), stamp("dtstart")), F.concat(F.lit("DTEND:"), stamp("dtend")), F.lit("END:VEVENT")]
    return events.select("uid", F.concat_ws("\r\n", *parts).alias("value"))


def first_provider(parts: list[DataFrame], key: str) -> DataFrame:
    """The rows of the first provider that has any, for each key."""
    from pyspark.sql import Window

    whole = None
    for k, part in enumerate(parts):
        part = part.withColumn("_part", F.lit(k))
        whole = part if whole is None else whole.unionByName(part)
    return whole.withColumn("_first", F.min("_part").over(Window.partitionBy(key))).filter("_part = _first").drop("_part", "_first")


def cached(df: DataFrame, key: str, at: str, now: Column, seconds: int, newest: int = 1000) -> DataFrame:
    """Entries that have not expired, the newest so many of them, under the hash of their key."""
    alive = df.filter(F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col(at).cast("timestamp")) <= seconds)
    return alive.orderBy(F.desc(at), key).limit(newest).withColumn("name", F.sha2(F.col(key).cast("string").cast("binary"), 256))


def transcript(messages: DataFrame, group: str, order: str, role: str, text: str, kind: str = "md") -> DataFrame:
    """One exported text for each conversation: md, txt, json or html."""
    esc = F.replace(F.replace(F.replace(F.col(text), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    line = {
        "md": F.concat(F.lit("## "), role, F.lit("\n\n"), text), "txt": F.concat(F.upper(role), F.lit(": "), text),
        "json": F.to_json(F.struct(F.col(role).alias("role"), F.col(text).alias("content"))), "html": F.concat(F.lit("<h2>"), role, F.lit("</h2><p>"), esc, F.lit("</p>")),
    }[kind]
    # A conversation is one exported text, so its turns meet in one row.
    rows = F.transform(F.sort_array(F.collect_list(F.struct(order, line.alias("line")))), lambda x: x["line"])
    body = F.array_join(rows, "," if kind == "json" else "\n\n" if kind == "md" else "\n")
    return messages.groupBy(group).agg((F.concat(F.lit("["), body, F.lit("]")) if kind == "json" else body).alias("export"))


def grep(texts: DataFrame, pattern: str, key: str = "path", value: str = "value", most: int = 200) -> DataFrame:
    """(key, line, text) of matching lines, the first so many."""
    lines = texts.select(key, F.posexplode(F.split(value, "\n")).alias("at", "text")).filter(F.col("text").rlike(pattern))
    return lines.select(key, (F.col("at") + 1).alias("line"), "text").orderBy(key, "line").limit(most)


def glob_pattern(glob: str) -> str:
    """** crosses folders, * and ? do not."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(glob[i], glob[i] if glob[i].isalnum() or glob[i] in "_/" else "\\" + glob[i])
            i += 1
    return f"^{out}$"


def tail(text: DataFrame, value: str, n: int) -> DataFrame:
    """(line, text): the last n lines of one whole text."""
    lines = F.split(F.regexp_replace(value, r"\n$", ""), "\n")
    return text.select(F.posexplode(lines).alias("at", "text")).orderBy(F.desc("at")).limit(n).select((F.col("at") + 1).alias("line"), "text")
