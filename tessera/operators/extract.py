"""Structured extraction: HTML, mail threads, sentence chunks, recurrence. Python only where built-ins cannot say it."""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import datetime, timedelta
from html.parser import HTMLParser
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
FRAMEWORKS = ("react", "angular", "vue", "svelte", "next", "nuxt", "ember", "backbone", "jquery", "polymer", "mithril")
NOISE = {"script", "style", "noscript", "template", "nav", "header", "footer", "aside"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_CONTENT = re.compile("content|main|body|article|post|entry|text", re.I)
THIN = 600


class Node:
    __slots__ = ("attrs", "children", "name")

    def __init__(self, name: str, attrs: dict):
        self.name, self.attrs, self.children = name, attrs, []

    def walk(self) -> Iterator[Node]:
        """This element and those below, in document order."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def text(self, skip: set = frozenset()) -> str:
        out, stack = [], [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                out.append(node)
            elif node.name not in skip:
                stack.extend(reversed(node.children))
        return " ".join(" ".join(out).split())


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].name == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def tree(html: str) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


def page(html: str) -> dict:
    """Title, main text, meta fields, image, lists, tables, code blocks and whether a framework renders the page."""
    root = tree(html)
    every = list(root.walk())
    of = lambda *names: [n for n in every if n.name in names]
    meta: dict[str, str] = {}
    for n in of("meta"):
        key = (n.attrs.get("name") or n.attrs.get("property") or "").lower()
        meta.setdefault(key, n.attrs.get("content", "").strip())
    areas = [n for n in of("main", "article", "section", "div") if _CONTENT.search(n.attrs.get("class", ""))][:3]
    main = " ".join(" ".join(n.text() for n in areas).split())
    body = next(iter(of("body")), None)
    if len(main) < THIN and body is not None:
        rest = body.text(NOISE)
        main = rest if len(rest) > len(main) else main
    images = [meta.get(k, "") for k in ("og:image", "og:image:url", "og:image:secure_url", "twitter:image", "thumbnail")]
    image = next((u for u in images if u.startswith(("https://", "http://")) and not u.endswith((".svg", ".ico"))), "")
    scripts = " ".join(n.attrs.get("src", "") + " " + n.text() for n in of("script")).lower()
    rendered = any(f in scripts for f in FRAMEWORKS) or any("data-reactroot" in n.attrs or "ng-app" in n.attrs for n in every)
    inner = lambda n, *names: [m for m in n.walk() if m.name in names and m is not n]
    lists = [x for x in ([li.text() for li in inner(n, "li")] for n in of("ul", "ol")) if x]
    tables = [t for t in ([r for r in ([c.text() for c in inner(tr, "td", "th")] for tr in inner(n, "tr")) if r] for n in of("table")) if t]
    code = [x for x in (n.text() for n in of("pre", "code")) if x]
    return {
        "title": next((n.text() for n in of("title")), ""), "content": main, "description": meta.get("description", ""), "keywords": meta.get("keywords", ""),
        "image": image, "lists": lists, "tables": tables, "code": code, "rendered": rendered,
    }


PAGE = "title string, content string, description string, keywords string, image string, lists array<array<string>>, tables array<array<array<string>>>, code array<string>, rendered boolean"


def pages(df: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame([{"k": k, **page(h)} for k, h in zip(rows["k"], rows["h"], strict=True)], columns=["k", "title", "content", "description", "keywords", "image", "lists", "tables", "code", "rendered"])

    return df.select(F.col(key).alias("k"), F.col(html).alias("h")).mapInPandas(run, f"k long, {PAGE}").withColumnRenamed("k", key)


def plain_title(html: Column) -> Column:
    """What stands between the first <title> and </title> as it is written, but for &amp;, on one line; empty without one."""
    title = F.replace(F.regexp_extract(html, r"(?s)<title>(.*?)</title>", 1), F.lit("&amp;"), F.lit("&"))
    return F.regexp_replace(F.regexp_replace(title, r"[\t\n\f\r ]+", " "), r"^\p{Zs}+|\p{Zs}+\z", "")


def chunk_borders(lengths: list[int], size: int, overlap: int) -> list[tuple[int, int]]:
    """(first, end) of the chunks of sentences of such lengths, one space between two; a longer one than size is alone.

    A chunk opens with as many last sentences of the one before as the overlap holds.
    """
    ends = [0, *accumulate(n + 1 for n in lengths)]
    width = lambda a, b: ends[b] - ends[a] - 1
    found, first = [], 0
    for at, n in enumerate(lengths):
        if at > first and width(first, at + 1) > size:
            found.append((first, at))
            first = at if n > size else next(i for i in range(first, at + 1) if width(i, at) <= overlap)
        if n > size:
            found.append((at, at + 1))
            first = at + 1
    return found if first == len(lengths) else [*found, (first, len(lengths))]


def sentence_chunks(text: str | None, size: int = 1000, overlap: int = 200) -> list[str]:
    """Whole sentences packed up to size, with an overlap; a long sentence is cut every size - overlap characters."""
    if not text or len(text) <= size:
        return [text] if text else []
    units = [s for s in map(str.strip, re.split(r"(?<=[.!?])\s+|\n{2,}", text)) if s]
    joined = [" ".join(units[a:b]) for a, b in chunk_borders([len(u) for u in units], size, overlap)]
    alone = set(u for u in units if len(u) > size)
    return [y for x in joined for y in ([x[i : i + size] for i in range(0, len(x), size - overlap)] if x in alone else [x])] or [text]


def chunked(df: DataFrame, key: str, text: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame([(k, i, c) for k, t in zip(rows["k"], rows["t"], strict=True) for i, c in enumerate(sentence_chunks(t))], columns=["k", "pos", "chunk"])

    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, "k long, pos int, chunk string").withColumnRenamed("k", key)


_ATTRIBUTION = re.compile(r"^(On .+ wrote:|Am .+ schrieb .+:|Le .+ a écrit\s*:|El .+ escribió:|-{2,}\s*Original Message\s*-{2,})\s*$")
_HEADER = re.compile(r"^(From|Von|De|Sent|Gesendet|To|Subject):\s", re.I)


def thread_turns(body: str | None) -> list[tuple[int, str, str]]:
    """(level, meta, text) for each turn of a mail, newest first: quote marks, attributions and header blocks."""
    turns: list[list] = [[0, "", []]]
    base = 0
    lines = (body or "").replace("\r\n", "\n").split("\n")
    i = 0
    while i < len(lines):
        line, depth = lines[i], 0
        while (m := re.match(r"\s?>", line)) is not None:
            line, depth = line[m.end() :], depth + 1
        line = line.removeprefix(" ") if depth else line
        level = base + depth
        heads = [x for x in lines[i : i + 4] if _HEADER.match(x)]
        if _ATTRIBUTION.match(line.strip()):
            meta = line.strip().strip("-").strip()
            if depth == 0 and not (i + 1 < len(lines) and any(x.lstrip().startswith(">") for x in lines[i + 1 : i + 3])):
                base += 1
                turns.append([base, meta, []])
            else:
                turns.append([level + 1, meta, []])
        elif depth == 0 and len(heads) >= 3:
            base += 1
            turns.append([base, " · ".join(h.split(":", 1)[1].strip() for h in heads[:2]), []])
            i += len(heads) - 1
        elif level != turns[-1][0] and line.strip():
            turns.append([level, "", [line]])
        else:
            turns[-1][2].append(line)
        i += 1
    return [(lv, meta, text) for lv, meta, rows in turns if (text := re.sub(r"\n{3,}", "\n\n", "\n".join(r.rstrip() for r in rows)).strip()) or meta]


def threads(df: DataFrame, key: str, body: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame([(k, i, *turn) for k, b in zip(rows["k"], rows["b"], strict=True) for i, turn in enumerate(thread_turns(b))], columns=["k", "turn", "level", "meta", "body"])

    return df.select(F.col(key).alias("k"), F.col(body).alias("b")).mapInPandas(run, "k long, turn int, level int, meta string, body string").withColumnRenamed("k", key)


DAYS = ("MO", "TU", "WE", "TH", "FR", "SA", "SU")
RULE_PARTS = {"FREQ", "INTERVAL", "COUNT", "UNTIL", "WKST", "BYDAY", "BYMONTHDAY", "BYMONTH", "BYSETPOS"}


def _nth(dates: list[datetime], days: list[tuple[int, int]]) -> list[datetime]:
    """Of a period's dates those of a weekday (n, weekday): the n-th one, from the end if negative, or all if 0.

    Where a rule has weekdays of both kinds, a date must be of each kind.
    """
    of = lambda day: [d for d in dates if d.weekday() == day]
    every = {d for n, day in days if n == 0 for d in of(day)}
    some = {d for n, day in days if n != 0 for d in (of(day)[n - 1 : n] if n > 0 else of(day)[::-1][-n - 1 : -n])}
    return sorted(every & some if every and some else every | some if len({n == 0 for n, _ in days}) == 1 else set())


def occurrences(start: datetime, rule: str, before: datetime = datetime.max) -> Iterator[datetime]:
    """Starts of a DAILY, WEEKLY, MONTHLY or YEARLY rule with RULE_PARTS; a bad rule, or another part, raises.

    Each period's dates are all its days that the BY parts leave; without any, the start's own. Periods that begin more
    than a year after before are not looked at.
    """
    parts = dict(p.strip().upper().split("=", 1) for p in rule.strip().removeprefix("RRULE:").split(";") if p.strip())
    freq, every = parts["FREQ"], int(parts.get("INTERVAL", 1))
    if freq not in ("DAILY", "WEEKLY", "MONTHLY", "YEARLY") or every < 1 or parts.keys() - RULE_PARTS:
        raise ValueError(rule)
    numbers = lambda k: [int(x) for x in parts[k].split(",")] if k in parts else []
    left = int(parts["COUNT"]) if "COUNT" in parts else None
    until = datetime.strptime(parts["UNTIL"].rstrip("Z"), "%Y%m%dT%H%M%S" if "T" in parts["UNTIL"] else "%Y%m%d") if "UNTIL" in parts else None
    days = [(int(x[:-2] or 0), DAYS.index(x[-2:])) for x in parts["BYDAY"].split(",")] if "BYDAY" in parts else []
    months, dates, places, first = numbers("BYMONTH"), numbers("BYMONTHDAY"), numbers("BYSETPOS"), DAYS.index(parts.get("WKST", "MO"))
    if freq in ("DAILY", "WEEKLY") and any(n for n, _ in days):
        raise ValueError(rule)

    def month(year: int, m: int) -> list[datetime]:
        length = ((datetime(year, m, 28) + timedelta(days=4)).replace(day=1) - timedelta(days=1)).day
        return [start.replace(year=year, month=m, day=d) for d in range(1, length + 1)]

    def in_month(d: datetime) -> bool:
        length = ((d.replace(day=28) + timedelta(days=4)).replace(day=1) - timedelta(days=1)).day
        return not dates or d.day in dates or d.day - length - 1 in dates

    def period(k: int) -> list[datetime]:
        if freq == "DAILY":
            found = [start + timedelta(days=k)]
        elif freq == "WEEKLY":
            monday = start - timedelta(days=(start.weekday() - first) % 7) + timedelta(weeks=k)
            week = [d for i in range(7) if (d := monday + timedelta(days=i)) >= start]
            found = week if days else [d for d in week if d.weekday() == start.weekday()]
        elif freq == "MONTHLY":
            found = month(start.year + (start.month - 1 + k) // 12, (start.month - 1 + k) % 12 + 1)
            if not days and not dates:
                found = found[start.day - 1 : start.day]
        else:
            # Weekdays count within each named month, and without one within the year.
            named = months or (range(1, 13) if days or dates else [start.month])
            by = [month(start.year + k, m) for m in sorted(named)]
            if not days and not dates:
                by = [x[start.day - 1 : start.day] for x in by]
            found = sorted(d for x in (by if months else [sum(by, [])]) for d in (_nth(x, days) if days else x))
        if days and freq != "YEARLY":
            found = _nth(found, days)
        found = [d for d in found if (not months or d.month in months) and in_month(d)]
        return sorted({found[i] for p in places if -len(found) <= (i := p - 1 if p > 0 else p) < len(found)}) if places else found

    k, least = 0, {"DAILY": 1, "WEEKLY": 7, "MONTHLY": 28, "YEARLY": 365}[freq]
    while start.toordinal() + k * least <= before.toordinal() + 366:
        try:
            group = period(k)
        except (OverflowError, ValueError):  # past the calendar's last year
            return
        for d in group:
            if d < start:
                continue
            if until and d > until or left == 0:
                return
            yield d
            left = left if left is None else left - 1
        k += every


def expand(uid: str, start: datetime, end: datetime, rule: str | None, a: datetime, b: datetime, cap: int = 1000) -> list[tuple[str, datetime, datetime, bool]]:
    """(uid, start, end, truncated) of the occurrences that meet [a, b); a bad rule leaves the single event."""
    length, found = end - start, []
    if rule and rule.strip():
        try:
            for s in occurrences(start, rule, b):
                if s >= b:
                    break
                if s + length > a and s >= a - length:
                    if len(found) >= cap:
                        return [(*x[:3], True) for x in found]
                    found.append((f"{uid}::{s:%Y-%m-%dT%H:%M}", s, s + length, False))
            return found
        except (ValueError, KeyError):
            pass
    return [(uid, start, end, False)] if start < b and end > a else []


def expanded(df: DataFrame, a: str, b: str) -> DataFrame:
    """Events (uid, dtstart, dtend, rrule) with ISO times to their occurrences in a window."""
    low, high = datetime.fromisoformat(a), datetime.fromisoformat(b)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = [x for r in rows.itertuples() for x in expand(r.uid, datetime.fromisoformat(r.dtstart), datetime.fromisoformat(r.dtend), r.rrule, low, high)]
            yield pd.DataFrame([(u, s.isoformat(" "), e.isoformat(" "), t) for u, s, e, t in out], columns=["uid", "dtstart", "dtend", "truncated"])

    return df.select("uid", "dtstart", "dtend", "rrule").mapInPandas(run, "uid string, dtstart string, dtend string, truncated boolean")


def next_run(schedule: str, clock: str | None, day: int | None, after: datetime) -> datetime | None:
    """The next daily, weekly (0 is Monday) or monthly run; a day past a month's end is its last; bad times have none."""
    m = re.fullmatch(r"(\d{1,2}):(\d{1,2})", clock or "")
    if not m or int(m[1]) > 23 or int(m[2]) > 59:
        return None
    at = after.replace(hour=int(m[1]), minute=int(m[2]), second=0, microsecond=0)
    if schedule == "daily":
        return at if at > after else at + timedelta(days=1)
    if schedule == "weekly":
        ahead = (day or 0) - at.weekday()
        return at + timedelta(days=ahead + 7 * (ahead < 0 or ahead == 0 and at <= after))
    if schedule == "monthly":
        def in_month(first: datetime) -> datetime:
            last = ((first + timedelta(days=32)).replace(day=1) - timedelta(days=1)).day
            return first.replace(day=min(day or 1, last))

        first = at.replace(day=1)
        found = in_month(first)
        return found if found > after else in_month((first + timedelta(days=32)).replace(day=1))
    return None


def json_objects(text: str | None) -> list[dict]:
    """Objects of the last JSON array or object in a model's answer: fences go, a cut-off array is closed."""
    import json

    body = re.sub(r"```(?:json)?", "", text or "")
    for a, b in (("[", "]"), ("{", "}")):
        i, j = body.find(a), body.rfind(b)
        if i < 0:
            continue
        tries = [body[i : j + 1]] if j > i else []
        cut = body.rfind("}")
        tries += [body[i : cut + 1] + "]"] if a == "[" and cut > i else []
        for t in tries:
            try:
                found = json.loads(t)
            except ValueError:
                continue
            return [x for x in (found if isinstance(found, list) else [found]) if isinstance(x, dict)]
    return []
