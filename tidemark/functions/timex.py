"""Instants and London wall-clock time."""

from __future__ import annotations

import re
from datetime import date

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "Europe/London"


def utc(local: Column, later: bool = False) -> Column:
    """The instant of a London wall-clock time: the earlier of two, or the later; an hour later where there is none."""
    first = F.to_utc_timestamp(local, ZONE)
    second = first + F.expr("INTERVAL 1 HOUR")
    return F.when(london(second) == local, second).otherwise(first) if later else first


def london(instant: Column) -> Column:
    """London wall-clock time of an instant."""
    return F.from_utc_timestamp(instant, ZONE)


def london_date(instant: Column) -> Column:
    return london(instant).cast("date")


def midnight(day: Column) -> Column:
    """The instant at which a London day begins."""
    return utc(day.cast("timestamp"))


def iso_weekday(day: Column) -> Column:
    return F.weekday(day) + 1


def clock(instant: Column) -> Column:
    """London time of day as HH:mm, which sorts as text."""
    return F.date_format(london(instant), "HH:mm")


def shown(instant: Column) -> Column:
    return F.date_format(instant, "yyyy-MM-dd HH:mm:ss")


def parse_wall_clock(text: Column, later: bool = False) -> Column:
    """A London time or date as an instant, of two the later if asked for; an offset is ignored. Null where it is neither."""
    bare = F.regexp_replace(F.trim(text), r"(Z|[+-]\d\d:\d\d)$", "")
    formats = ["yyyy-MM-dd'T'HH:mm:ss.SSS", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd"]
    return utc(F.coalesce(*[F.try_to_timestamp(bare, F.lit(f)) for f in formats]), later)


def parse_datetime(text: Column) -> Column:
    """As parse_wall_clock, but an offset is honoured."""
    offset = F.trim(text).rlike(r"T\d\d:\d\d(:\d\d(\.\d+)?)?(Z|[+-]\d\d:\d\d)$")
    return F.when(offset, F.try_to_timestamp(F.trim(text))).otherwise(parse_wall_clock(text))


def year_less_date(day: Column, month: Column, weekday: Column, listed_on: Column) -> Column:
    """The first date of that day and month, and weekday where one is given, from a week before listed_on on; up to two
    calendar years ahead."""
    since = F.date_sub(listed_on, 7)
    dates = F.transform(F.sequence(F.year(since), F.year(since) + 2), lambda y: F.try_to_date(F.format_string("%04d-%02d-%02d", y, month, day)))
    fits = F.filter(dates, lambda d: d.isNotNull() & (d >= since) & (weekday.isNull() | (iso_weekday(d) == weekday)))
    return F.get(fits, F.lit(0))


def weekdays_between(first: Column, last: Column, weekdays: Column) -> Column:
    """The days from first to last that fall on one of the ISO weekdays; null for fewer than two."""
    days = F.when(last >= first, F.filter(F.sequence(first, last), lambda d: F.array_contains(weekdays, iso_weekday(d))))
    return F.when(F.size(days) >= 2, days)


#: Weekdays in full, from Monday on.
WEEKDAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]


def weekly_days(text: Column, first: Column, last: Column) -> Column:
    """"every Saturday": each such day from first to last; null without the phrase or with fewer than two days."""
    lower = F.lower(text)
    number = F.coalesce(*[F.when(F.contains(lower, F.lit(f"every {day}")), n) for n, day in enumerate(WEEKDAYS, 1)])
    return F.when(number.isNotNull(), weekdays_between(first, last, F.array(number)))


def weekday_range_days(text: Column, first: Column, last: Column) -> Column:
    """"Sat 10 Oct - Sat 3 Jul": each such weekday from first to last, where both fall on it and the text names it at least
    twice and no other weekday; else null. A weekday may be written in full or by three letters."""
    words = F.split(F.lower(text), r"\P{L}+")
    named = F.filter(F.transform(words, lambda w: F.coalesce(*[F.when(w.isin(day, day[:3]), n) for n, day in enumerate(WEEKDAYS, 1)])), lambda n: n.isNotNull())
    own = iso_weekday(first)
    fits = (F.size(named) >= 2) & F.forall(named, lambda n: n == own) & (iso_weekday(last) == own)
    return F.when(fits, weekdays_between(first, last, F.array(own)))


def weekend(today: Column) -> tuple[Column, Column]:
    """First and last day of the weekend to come; on a Saturday or Sunday of this one, from today on."""
    to_saturday = F.greatest(6 - iso_weekday(today), F.lit(0))
    to_sunday = 7 - iso_weekday(today)
    return F.date_add(today, to_saturday.cast("int")), F.date_add(today, to_sunday.cast("int"))


def date_presets(today: Column) -> Column:
    """(label, first, last) of the quick ranges; an open end is null."""
    saturday, sunday = weekend(today)
    rows = [("Any date", today, F.lit(None).cast("date")), ("Today", today, today), ("This weekend", saturday, sunday), ("Next 7 days", today, F.date_add(today, 6))]
    return F.array(*[F.struct(F.lit(label).alias("label"), first.alias("first"), last.alias("last")) for label, first, last in rows])


def set_sessions(sessions: Column) -> Column:
    """Sessions by start, one for each start, without ends that aren't after it."""
    tidy = F.transform(sessions, lambda s: F.struct(s["starts_at"].alias("starts_at"), F.when(s["ends_at"] > s["starts_at"], s["ends_at"]).alias("ends_at")))
    ordered = F.array_sort(tidy)
    return F.filter(ordered, lambda s, i: (i == 0) | (F.get(ordered, i - 1)["starts_at"] < s["starts_at"]))


def next_session(sessions: Column, now: Column) -> Column:
    """The first session that hasn't ended; a session without end ends when it starts."""
    return F.get(F.filter(sessions, lambda s: F.coalesce(s["ends_at"], s["starts_at"]) > now), F.lit(0))


#: Names of months.
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]


def month_number(word: str) -> int | None:
    """1 to 12 of a month's name or of its first three or four letters."""
    word = word.lower()
    return next((n for n, m in enumerate(MONTHS, 1) if m == word or (3 <= len(word) <= 4 and m.startswith(word))), None)


def spelled_days(text: str | None, first: date | None, last: date | None) -> list[date] | None:
    """Days that a text lists as "<day> <month>", with a year or the one before's; none unless they rise from first to last."""
    if not text or first is None or last is None:
        return None
    words, days, year, month = re.findall(r"[^\W_]+", text), [], first.year, first.month
    for n, (a, b) in enumerate(zip(words, words[1:])):
        if not (a.isdigit() and 1 <= int(a) <= 31 and (found := month_number(b))):
            continue
        year, month = year + (found < month), found
        if n + 2 < len(words) and re.fullmatch("(19|20|21)[0-9]{2}", words[n + 2]):
            year = int(words[n + 2])
        try:
            days.append(date(year, month, int(a)))
        except ValueError:
            return None
    rising = len(days) >= 2 and all(a < b for a, b in zip(days, days[1:]))
    return days if rising and days[0] == first and days[-1] == last else None


def session_days(text: Column, first: Column, last: Column) -> Column:
    """spelled_days() of columns; a scan with state, so it runs in Arrow batches."""

    @F.pandas_udf("array<date>")
    def run(texts: pd.Series, firsts: pd.Series, lasts: pd.Series) -> pd.Series:
        return pd.Series([spelled_days(*row) for row in zip(texts, firsts, lasts)])

    return run(text, first, last)


def day_sessions(days: Column, opens: Column, closes: Column) -> Column:
    """A session on each day, at London times HH:mm, or all day where opens is null."""

    def session(d: Column) -> Column:
        at = lambda t: utc(F.to_timestamp(F.concat_ws(" ", d.cast("string"), t), "yyyy-MM-dd HH:mm"))
        return F.struct(F.when(opens.isNull(), midnight(d)).otherwise(at(opens)).alias("starts_at"), F.when(opens.isNotNull() & closes.isNotNull(), at(closes)).alias("ends_at"))

    return F.transform(days, session)
