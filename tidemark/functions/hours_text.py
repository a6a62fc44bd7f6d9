"""Weekly opening hours from prose, by two patterns: days then a range of times, or a range then days.

What is unsure gives nothing at all: one day that isn't plural, bare numbers as times, exceptions, a day in two rules.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of ISO weekdays, their short forms, and words that put a sentence in doubt.
NAMES = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
SHORT = {"mon": 1, "tue": 2, "tues": 2, "wed": 3, "weds": 3, "thu": 4, "thur": 4, "thurs": 4, "fri": 5, "sat": 6, "sun": 7}
DOUBT = re.compile(r"\b(except|excluding|apart|unless|excl)\b")

DAY = rf"\b(?:(?:{'|'.join(NAMES)})s?|{'|'.join(sorted(SHORT, key=len, reverse=True))})\b"
JOIN = r"\s*(?:[-–—‒]|\b(?:to|through|thru|till|until)\b|(?:[,&+/]|\band\b)(?:\s*(?:[,&+/]|\band\b))*)\s*"
DAYS = rf"(?P<days>\bdaily\b|\beveryday\b|\bevery\s+day\b|\bweekdays\b|\bweekends\b|{DAY}(?:{JOIN}{DAY})*)"
TIME = r"(?<![\d:.])(\d{1,2})(?:[:.](\d\d))?(?!\d)\s*(am|pm)?\b"
TIMES = rf"(?P<between>between\s+)?{TIME}\s*(?:[-–—‒]|\b(?:to|until|till|and)\b)\s*{TIME}"
FORMS = [re.compile(rf"(?P<before>\b(?:closed|except)\s+)?{DAYS}(?:\s|[,:]|\b(?:from|open|opening|only)\b)*{TIMES}"), re.compile(rf"{TIMES}(?:\s|,|\bon\b)*(?P<every>\bevery\s+)?{DAYS}")]
RULES = "array<struct<days:array<int>,opens:string,closes:string>>"


def day_number(name: str) -> int:
    return SHORT.get(name) or NAMES.index(name.removesuffix("s")) + 1


def days_of(text: str) -> tuple[list[int], bool]:
    """ISO weekdays, and whether they read as weekly: plural, several, or a word for all."""
    groups = {"daily": range(1, 8), "everyday": range(1, 8), "every day": range(1, 8), "weekdays": range(1, 6), "weekends": range(6, 8)}
    if (named := groups.get(re.sub(r"\s+", " ", text))) is not None:
        return list(named), True
    parts = re.split(rf"({DAY})", text)
    days, weekly = [day_number(parts[1])], parts[1] not in SHORT and parts[1].endswith("s")
    for joint, name in zip(parts[2::2], parts[3::2]):
        to, weekly = day_number(name), True
        if re.search(r"[-–—‒]|to|thr|till|until", joint):
            while days[-1] != to:
                days.append(days[-1] % 7 + 1)
        else:
            days.append(to)
    return sorted({*days}), weekly


def clock(hour: str, minute: str | None, half: str | None) -> str | None:
    h, m = int(hour), int(minute or 0)
    if half:
        h = h % 12 + 12 * (half == "pm") if 1 <= h <= 12 else 99
    elif minute is None:
        return None
    return f"{h:02}:{m:02}" if h < 24 and m < 60 else None


def from_text(text: str | None) -> list[dict] | None:
    """Rules (days, opens, closes) of a text, or none where there are none or they are unsure."""
    text = (text or "").replace("&amp;", "&").replace(" ", " ").lower()
    rules: dict[tuple[str, str], set[int]] = {}
    for sentence in re.split(r"[\n;!?]|\.(?=\s|$)", text):
        hits = [m for form in FORMS for m in form.finditer(sentence)]
        hits = [m for n, m in enumerate(hits) if not any(m.start() < o.end() and o.start() < m.end() for o in hits[:n])]
        for m in hits:
            h1, m1, p1, h2, m2, p2 = m.groups()[-6:] if m.re is FORMS[0] else m.groups()[1:7]
            days, weekly = days_of(m["days"])
            closes = clock(h2, m2, p2)
            opens = clock(h1, m1, p1 or p2)
            if not p1 and p2 and opens and closes and opens >= closes:
                opens = clock(h1, m1, "am")
            if not opens or not closes:
                continue
            surely = weekly or (m.re is FORMS[1] and m["every"])
            if not surely or (m.re is FORMS[0] and m["before"]) or DOUBT.search(sentence) or opens >= closes:
                return None
            rules.setdefault((opens, closes), set()).update(days)
    every = [d for days in rules.values() for d in days]
    if not rules or len(every) != len({*every}):
        return None
    return sorted(({"days": sorted(d), "opens": o, "closes": c} for (o, c), d in rules.items()), key=lambda r: (r["days"][0], r["opens"]))


def parse(text: Column) -> Column:
    """from_text() of a column, in Arrow batches."""

    @F.pandas_udf(RULES)
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(from_text)

    return run(text)
