"""Dates in words, against a clock that is given."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
SHIFTS = {"today": 0, "tonight": 0, "tomorrow": 1, "tmrw": 1, "yesterday": -1}
UNITS = {"hour": 3600, "hr": 3600, "minute": 60, "min": 60, "day": 86_400, "week": 604_800}
_DAY = rf"(?:(?P<word>{'|'.join(SHIFTS)})|(?P<next>next\s+)?(?P<weekday>{'|'.join(WEEKDAYS)}))"
_TIME = r"(?P<hour>\d{1,2})(?::(?P<minute>\d{2}))?(?:\s*(?P<half>[ap])\s*\.?\s*m\.?)?"
_FORMS = tuple(re.compile(x, re.I) for x in (rf"{_DAY}(?:(?:\s+at)?\s*{_TIME})?", rf"{_TIME}(?:\s+{_DAY})?"))
_AFTER = re.compile(rf"in\s+(?P<n>\d+|an?)\s*(?P<unit>{'|'.join(UNITS)})s?", re.I)


def _at(day: datetime, found: dict[str, str | None]) -> datetime | None:
    """The day's midnight, or the time of day that was found; null for one that no clock shows."""
    if found["hour"] is None:
        return day
    minutes = int(found["hour"]) * 60 + int(found["minute"] or 0)
    noon = {"a": -720 if 720 <= minutes < 780 else 0, "p": 720 if minutes < 720 else 0}
    minutes += noon.get((found["half"] or "").lower(), 0)
    return day + timedelta(minutes=minutes) if minutes < 1440 and int(found["minute"] or 0) < 60 else None


def moment(text: str | None, now: datetime) -> datetime | None:
    """ISO first, in UTC; then today, tonight, tomorrow, yesterday or a weekday, with a time before or after, or else at midnight;
    "in 3 hours"; or a time of today."""
    said = (text or "").strip()
    try:
        read = datetime.fromisoformat(said)
        return read.astimezone(timezone.utc).replace(tzinfo=None) if read.tzinfo else read
    except ValueError:
        pass
    if m := _AFTER.fullmatch(said):
        return now + timedelta(seconds=(1 if m["n"][0] in "aA" else int(m["n"])) * UNITS[m["unit"].lower()])
    m = next((m for form in _FORMS if (m := form.fullmatch(said))), None)
    if m is None:
        return None
    today = datetime(now.year, now.month, now.day)
    if m["weekday"]:
        ahead = (WEEKDAYS.index(m["weekday"].lower()) - now.weekday() - 1) % 7 + 1
    else:
        ahead = SHIFTS[(m["word"] or "today").lower()]
    return _at(today + timedelta(days=ahead), m.groupdict())
