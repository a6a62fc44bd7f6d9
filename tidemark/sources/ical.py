"""iCalendar files: events, and the occurrences of recurring ones."""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import date, datetime, timedelta
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HORIZON_DAYS, MOST_OCCURRENCES = 90, 60
WEEKDAYS = ["MO", "TU", "WE", "TH", "FR", "SA", "SU"]
EVENT = "uid string, summary string, location string, url string, status string, starts_at timestamp, ends_at timestamp, all_day boolean, rrule string, exdates array<string>"


def unfold(data: bytes) -> list[str]:
    """Content lines; folded ones are joined as bytes, as a fold may cut a letter."""
    return re.sub(rb"\r?\n[ \t]", b"", data).decode("utf-8", "replace").splitlines()


def split_line(line: str) -> tuple[str, dict[str, str], str]:
    """Name, parameters and value; a colon in a quoted parameter doesn't end them."""
    match = re.match(r'([A-Za-z0-9-]+)((?:;[^=:;]+=(?:"[^"]*"|[^:;]*))*):(.*)', line, re.DOTALL)
    if not match:
        return "", {}, ""
    params = {k.upper(): v.strip('"') for k, v in re.findall(r';([^=:;]+)=("[^"]*"|[^:;]*)', match[2])}
    return match[1].upper(), params, match[3]


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] in "nN" else m[1], text)


def instant(value: str, params: dict[str, str]) -> tuple[datetime | None, bool]:
    """UTC time, and whether it is a date: Z is UTC, a TZID its zone, else London."""
    try:
        if params.get("VALUE") == "DATE" or re.fullmatch(r"\d{8}", value):
            local, whole = datetime.strptime(value[:8], "%Y%m%d"), True
        else:
            local, whole = datetime.strptime(value.rstrip("Z"), "%Y%m%dT%H%M%S"), False
        zone = ZoneInfo("UTC") if value.endswith("Z") else ZoneInfo(params.get("TZID", "Europe/London"))
    except (ValueError, KeyError, OSError):
        return None, False
    return local.replace(tzinfo=zone).astimezone(ZoneInfo("UTC")).replace(tzinfo=None), whole


def events_of(data: bytes) -> Iterator[tuple]:
    event, exdates = None, []
    for line in unfold(data):
        name, params, value = split_line(line)
        if (name, value.upper()) == ("BEGIN", "VEVENT"):
            event, exdates = {}, []
        elif (name, value.upper()) == ("END", "VEVENT") and event is not None:
            start, whole = event.get("DTSTART", (None, False))
            if start:
                yield event.get("UID"), event.get("SUMMARY"), event.get("LOCATION"), event.get("URL"), event.get("STATUS"), start, event.get("DTEND", (None,))[0], whole, event.get("RRULE"), exdates
            event = None
        elif event is not None and name in ("DTSTART", "DTEND"):
            event[name] = instant(value, params)
        elif event is not None and name == "EXDATE":
            exdates += [v[:8] for v in value.split(",")]
        elif event is not None and name in ("UID", "SUMMARY", "LOCATION"):
            event[name] = unescape(value)
        elif event is not None and name in ("URL", "STATUS", "RRULE"):
            event[name] = value


def read_ical(files: DataFrame, name_col: str = "path", data_col: str = "content") -> DataFrame:
    """(name, event fields) of every VEVENT that has a start; files as spark.read.format("binaryFile") gives them."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(n, *e) for n, d in zip(frame[name_col], frame[data_col]) for e in events_of(bytes(d))]
            yield pd.DataFrame(rows, columns=[name_col, *(f.split()[0] for f in EVENT.split(", "))]).astype({"starts_at": "datetime64[ns]", "ends_at": "datetime64[ns]"})

    return files.select(name_col, data_col).mapInPandas(run, f"{name_col} string, {EVENT}")


def recurrences(df: DataFrame, now: Column) -> DataFrame:
    """(id, day) of events (id, first date, rrule, exdates as yyyyMMdd): DAILY and WEEKLY rules with INTERVAL, COUNT, UNTIL
    and BYDAY, from a day before now to the horizon; other rules give the first date only.

    COUNT counts all occurrences, past and excluded ones too. Built-in functions only.
    """
    part = lambda name: F.regexp_extract(F.coalesce("rrule", F.lit("")), f"(?:^|;){name}=([^;]*)", 1)
    keys = F.transform(F.split(F.coalesce("rrule", F.lit("")), ";"), lambda p: F.split(p, "=")[0])
    known = F.size(F.array_except(keys, F.array(*map(F.lit, ["FREQ", "INTERVAL", "COUNT", "UNTIL", "BYDAY", "WKST"])))) == 0
    weekly, daily = part("FREQ") == "WEEKLY", (part("FREQ") == "DAILY") & (part("BYDAY") == "")
    by = F.split(part("BYDAY"), ",")
    plain = F.forall(by, lambda d: d.isin(*WEEKDAYS, ""))
    simple = known & plain & (weekly | daily)
    step = F.greatest(F.coalesce(F.expr("try_cast(regexp_extract(coalesce(rrule, ''), '(?:^|;)INTERVAL=([^;]*)', 1) AS int)"), F.lit(1)), F.lit(1))
    today = F.to_date(now)
    last = F.greatest(F.date_add(today, HORIZON_DAYS), F.col("first"))
    count = F.expr("try_cast(regexp_extract(coalesce(rrule, ''), '(?:^|;)COUNT=([^;]*)', 1) AS int)")
    # without COUNT past days needn't be walked; with it, no longer than its occurrences can take
    reach = F.date_add("first", F.least(F.datediff(last, "first"), (F.greatest(count, F.lit(1)).cast("long") + 1) * step * F.when(weekly, 7).otherwise(1)).cast("int"))
    start = F.when(count.isNull(), F.greatest("first", F.date_sub(today, 1))).otherwise(F.col("first"))
    stop = F.when(count.isNull(), last).when(reach < F.date_sub(today, 1), F.col("first")).otherwise(reach)
    days = F.sequence(start, stop)
    monday = lambda d: F.date_sub(d, F.weekday(d))
    names = F.array(*map(F.lit, WEEKDAYS))
    on = lambda d: F.when(part("BYDAY") == "", F.weekday(d) == F.weekday("first")).otherwise(F.array_contains(by, F.get(names, F.weekday(d))))
    every = lambda d: F.when(weekly, (F.floor(F.datediff(d, monday(F.col("first"))) / 7) % step == 0) & on(d)).otherwise(F.datediff(d, "first") % step == 0)
    hits = F.filter(days, every)
    hits = F.when(count.isNull(), hits).otherwise(F.slice(hits, F.lit(1), F.greatest(F.coalesce(count, F.lit(1)), F.lit(1))))
    until = F.try_to_date(F.substring(part("UNTIL"), 1, 8), "yyyyMMdd") if hasattr(F, "try_to_date") else F.to_date(F.substring(part("UNTIL"), 1, 8), "yyyyMMdd")
    kept = F.filter(hits, lambda d: (d >= F.date_sub(today, 1)) & (d <= F.date_add(today, HORIZON_DAYS)) & (until.isNull() | (d <= until)) & ~F.array_contains(F.coalesce("exdates", F.array().cast("array<string>")), F.date_format(d, "yyyyMMdd")))
    out = F.when(simple, F.slice(kept, 1, MOST_OCCURRENCES)).otherwise(F.array("first"))
    return df.select("id", F.explode(out).alias("day"))


def occurrences_of(first: date, rule: dict[str, str], excluded: set[date], now: date) -> list[date]:
    """The same by walking day by day; the plain form that recurrences() is checked against."""
    out, counted, day = [], 0, first
    step, days = int(rule.get("INTERVAL", 1)), rule.get("BYDAY", WEEKDAYS[first.weekday()]).split(",")
    anchor = first - timedelta(first.weekday())
    while day <= now + timedelta(HORIZON_DAYS):
        on = (day - first).days % step == 0 if rule["FREQ"] == "DAILY" else ((day - anchor).days // 7) % step == 0 and WEEKDAYS[day.weekday()] in days
        if on:
            counted += 1
            if "COUNT" in rule and counted > int(rule["COUNT"]):
                break
            late = "UNTIL" in rule and day > datetime.strptime(rule["UNTIL"][:8], "%Y%m%d").date()
            if day >= now - timedelta(1) and not late and day not in excluded:
                out.append(day)
        day += timedelta(1)
    return out[:MOST_OCCURRENCES]
