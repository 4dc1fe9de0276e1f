"""Scalar functions over text as Column expressions, all inside the JVM."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A character that belongs to a word, in any script; used on both sides of a whole word.
WORD = r"[\p{L}\p{N}_]"
# Stop words and word lists that results depend on.
DOC_STOP_WORDS = tuple(
    "the a an is are was were be been being to of in for on at by with from "
    "and or if then else when while as it this that those these i you he she "
    "we they my your our their me him her us them".split()
)
MEMORY_STOP_WORDS = tuple(
    "a an the is am are was were be been being have has had do does did "
    "will would shall should can could may might must need ought dare "
    "i me my mine we us our ours you your yours he him his she her hers "
    "it its they them their theirs this that these those "
    "and but or nor not no so if then else than too also very "
    "in on at to for of by with from up out about into over after "
    "what when where which who whom how why all each every some any "
    "just very really actually like well also still already even "
    "oh ok okay yes yeah hey hi hello thanks thank please sorry "
    "much more most own other another such only same here there "
    "because while during before until since through between both "
    "few many several some none nothing something anything everything "
    "get got make made go going went been come came take took "
    "know think want let say tell give see look find way thing "
    "don doesn didn won wouldn couldn shouldn wasn weren isn aren haven hasn".split()
)
SKILL_STOP_WORDS = ("the", "and", "with", "for", "from", "using")


def contains(text: Column, needle: str) -> Column:
    """Case-insensitive, with % and _ as ordinary characters."""
    return F.contains(F.lower(text), F.lit(needle.lower()))


def wildcard(text: Column, needle: str) -> Column:
    """Case-insensitive, with % and _ of the needle as wildcards."""
    return text.ilike(f"%{needle}%")


def every_term(query: str, *columns: Column) -> Column:
    """Each blank-separated term must be in one of the columns."""
    return reduce(and_, (reduce(or_, (wildcard(c, t) for c in columns)) for t in query.split()), F.lit(True))


def quoted(term: str) -> str:
    """A term as a regular expression that both Java and RE2 read."""
    return "".join(c if c.isalnum() or c in "_ " else f"\\{c}" for c in term)


def whole_word(text: Column, term: str) -> Column:
    return text.rlike(rf"(^|[^\p{{L}}\p{{N}}_]){quoted(term)}([^\p{{L}}\p{{N}}_]|$)")


def snippet(text: Column, query: str, radius: int = 60) -> Column:
    """The text around the first hit, with ellipses where it is cut; without a hit its beginning."""
    text = F.coalesce(text, F.lit(""))
    at = F.locate(query.lower(), F.lower(text)) - 1
    begin, end = F.greatest(at - radius, F.lit(0)), F.least(at + len(query) + radius, F.length(text))
    cut = F.concat(F.when(begin > 0, "...").otherwise(""), F.substring(text, begin + 1, end - begin), F.when(end < F.length(text), "...").otherwise(""))
    return F.when(at < 0, F.substring(text, 1, 2 * radius)).otherwise(cut) if query else F.substring(text, 1, 2 * radius)


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def title_key(title: Column) -> Column:
    return F.lower(collapsed(F.coalesce(title, F.lit(""))))


def content_key(content: Column) -> Column:
    """A fingerprint that volatile upload and annotation ids do not change."""
    c = F.regexp_replace(F.coalesce(content, F.lit("")), r'upload_id="[^"]*"', "upload_id")
    return F.lower(collapsed(F.regexp_replace(c, r"\bid=ann-[A-Za-z0-9_-]+", "id=ann")))


def bare(content: Column) -> Column:
    """Without heading marks, emphasis, quotes and rules of markdown."""
    c = F.regexp_replace(F.coalesce(content, F.lit("")), r"(?m)^#{1,6}\s+", "")
    return collapsed(F.regexp_replace(c, r"[*_`>\-=]+", ""))


def real_length(content: Column) -> Column:
    return F.length(bare(content))


def content_id(text: Column, owner: Column | None = None) -> Column:
    """doc_ and 16 hex digits over the owner, a NUL and the text; without an owner over the text alone."""
    whole = text if owner is None else F.when(F.coalesce(owner, F.lit("")) == "", text).otherwise(F.concat(owner, F.lit("\x00"), text))
    return F.concat(F.lit("doc_"), F.substring(F.sha2(whole.cast("binary"), 256), 1, 16))


def key_points(text: Column) -> Column:
    """Bulleted or numbered lines without their marks."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x).rlike(r"^([-*•]|\d+[.)])\s+"))
    return F.transform(lines, lambda x: F.regexp_replace(F.trim(x), r"^([-*•]|\d+[.)])\s+", ""))


def sentences(text: Column) -> Column:
    return F.filter(F.split(F.trim(text), r"(?<=[.!?])\s+"), lambda x: x != "")


def tldr(text: Column, n: int = 3) -> Column:
    return F.array_join(F.slice(sentences(text), 1, n), " ")


def quotes(text: Column) -> Column:
    """At least 15 characters between a pair of equal quote marks, without either mark inside, in the order of the text."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"""(["'])([^"']{15,}?)\1"""), 2), lambda x: F.trim(x, F.lit(" \t\r\n")))


def calendar_id(owner: Column, account: Column, url: Column) -> Column:
    """The local id of a remote calendar, by owner and account."""
    key = F.concat_ws("\n", F.coalesce(owner, F.lit("")), F.coalesce(account, F.lit("")), url)
    return F.concat(F.lit("caldav-"), F.substring(F.sha2(key.cast("binary"), 256), 1, 24))


def statistics(text: Column) -> Column:
    """Numbers, with or without thousands marks and a fraction, and the unit or percent sign behind them."""
    number = r"(\b(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?\s*(?:%|percent|‰|per cent|[a-zA-Z]+)?)"
    return F.transform(F.regexp_extract_all(text, F.lit(number), 1), lambda x: F.trim(x))


def memory_command(text: Column) -> Column:
    """What a message asks to remember; null if it does not."""
    return F.nullif(F.trim(F.regexp_extract(F.trim(text), r"(?i)^(?:remember|memorize|save|note|store)[:\-]?\s+(.+)$", 1)), F.lit(""))


def memory_value(text: Column, most: int = 80) -> Column:
    """Collapsed, without marks around it and a leading article; empty if long, a link, an address or markup."""
    v = F.regexp_replace(F.trim(collapsed(F.coalesce(text, F.lit(""))), F.lit(" .,!?:;\"'`“”‘’")), r"(?i)^(?:the|a|an)\s+", "")
    return F.when((F.length(v) > most) | v.rlike(r"https?://|@|[{}<>]"), "").otherwise(v)


def bullets(text: Column) -> Column:
    """The texts of bulleted and numbered lines; empty ones are left out."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    marked = F.filter(lines, lambda x: x.rlike(r"^(?:[-*•]|\d+\.)"))
    return F.filter(F.transform(marked, lambda x: F.trim(F.regexp_replace(x, r"^(?:[-*•]|\d+\.)\s*", ""))), lambda x: x != "")


def estimate_tokens(length: Column) -> Column:
    return F.floor(length * F.lit(0.3)).cast("long")


def middle_out(text: Column, most: int, notice: str = "\n[...]\n") -> Column:
    """70 % from the head and 30 % from the tail of a text that is too long."""
    room = most - len(notice)
    head = int(room * 0.7)
    tail = room - head
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, head), F.lit(notice), F.substring(text, F.length(text) - tail + 1, F.lit(tail))))


def human_size(size: Column) -> Column:
    """One decimal from KB on."""
    out = F.concat(size.cast("long").cast("string"), F.lit(" B"))
    for k, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        out = F.when(size >= 1024**k, F.concat(F.format_string("%.1f", size / F.lit(float(1024**k))), F.lit(f" {unit}"))).otherwise(out)
    return out


def windows(text: Column, size: int = 1000, overlap: int = 200) -> Column:
    """Overlapping windows of the trimmed text; the last ends with the text, and a blank text has none."""
    t = F.trim(text, F.lit(" \t\r\n"))
    n = F.length(t)
    step = size - overlap
    count = F.lit(1) + F.ceil(F.greatest(n - size, F.lit(0)) / F.lit(float(step))).cast("int")
    starts = F.sequence(F.lit(0), count - 1)
    return F.when(n > 0, F.transform(starts, lambda i: F.substring(t, i * step + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def _split(text: Column, pattern: str = r"\s+") -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), pattern), lambda x: x != "")


def relevance_words(text: Column) -> Column:
    """Distinct blank-separated words, lower case, without marks around them."""
    return F.array_distinct(F.transform(_split(F.lower(text)), lambda w: F.trim(w, F.lit('.,!?";'))))


def plain_words(text: Column) -> Column:
    return F.array_distinct(_split(F.lower(text)))


def skill_words(text: Column) -> Column:
    some = F.filter(_split(F.lower(text)), lambda w: F.length(w) > 1)
    return F.array_distinct(F.transform(some, lambda w: F.trim(w, F.lit('.,!?";:()[]'))))


def document_words(text: Column) -> Column:
    found = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9_-]+)"), 1))
    return F.filter(found, lambda w: ~w.isin(*DOC_STOP_WORDS) & (F.length(w) > 1))


def memory_words(text: Column) -> Column:
    """With repetitions; at least three characters."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9]+(?:[-_][a-z0-9]+)*)"), 1)
    return F.filter(found, lambda w: ~w.isin(*MEMORY_STOP_WORDS) & (F.length(w) >= 3))


def guard_words(text: Column) -> Column:
    """Without numeric suffixes, of more than two letters or digits."""
    found = _split(F.regexp_replace(F.lower(text), r"-\d+\b", ""), r"[^a-z0-9]+")
    return F.array_distinct(F.filter(found, lambda w: (F.length(w) > 2) & ~w.isin(*SKILL_STOP_WORDS)))


def jaccard(a: Column, b: Column) -> Column:
    """0 if either set is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / F.size(F.array_union(a, b)))


def display_language(language: Column, content: Column) -> Column:
    return F.when(content.contains("<!-- pdf_source"), "pdf").when(language.isNull(), "text").otherwise(language)


def domain(url: Column) -> Column:
    """The authority of a URL in lower case, its port included; empty without one."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def cosine(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """L2-normalised; a zero vector stays as it is."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: x.cast("double") / F.when(norm == 0, F.lit(1.0)).otherwise(norm))


def sniff_language(text: Column) -> Column:
    """The kind of a document by its first tell-tale; markdown if there is none, or no text."""
    t = F.trim(F.coalesce(text, F.lit("")), F.lit(" \t\r\n"))
    head, first = F.lower(F.substring(t, 1, 600)), F.lower(F.regexp_extract(t, r"^#![^\n]*", 0))
    # The words and marks of each kind.
    rules = (
        ("email", t.rlike(r"(?im)^To:\s*") & t.rlike(r"(?im)^Subject:\s*")), ("svg", head.contains("<svg")), ("xml", head.startswith("<?xml")),
        ("html", head.rlike(r"^<!doctype html|^<html|<(div|body|head|p|span|table|button|h[1-6]|ul|ol|li|img)\b")),
        ("json", t.rlike(r"^[{\[]") & F.try_parse_json(t).isNotNull()), ("python", first.contains("python")), ("bash", first != ""),
        ("python", t.rlike(r"(?m)^\s*(def \w|class \w|import \w|from \w[\w.]* import )")), ("javascript", t.rlike(r"(?m)^\s*(function \w|const \w|let \w|export |import .* from )")),
        ("sql", t.rlike(r"(?mi)^\s*(select .* from |create table |insert into |update \w)")), ("css", t.rlike(r"(?m)^[.#]?[\w-]+\s*\{[^{}]*:[^{}]*;")),
    )
    out = None
    for name, test in rules:
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("markdown")
