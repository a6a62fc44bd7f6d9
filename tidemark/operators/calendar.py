"""Calendar placement, feeds and live labels."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidemark.functions.hours import today_status
from tidemark.functions.timex import clock, london, london_date

LONG_RUN = 4


def span() -> tuple[Column, Column]:
    first = london_date(F.col("starts_at"))
    last = london_date(F.col("ends_at"))
    return first, F.when(last > first, last).otherwise(first)


def untimed() -> Column:
    return F.col("all_day") | (clock(F.col("starts_at")) == "00:00")


def place(df: DataFrame, first_day: Column, last_day: Column) -> DataFrame:
    """(id, day, mark): ongoing runs without a day, their first and last days, and other listings on their day."""
    first, last = span()
    rows = df.select("id", first.alias("first"), last.alias("last")).filter((F.col("last") >= first_day) & (F.col("first") <= last_day))
    mark = lambda day, name, when: F.when(when, F.struct(day.alias("day"), F.lit(name).alias("mark")))
    long = F.datediff("last", "first") + 1 >= LONG_RUN
    inside = lambda c: F.col(c).between(first_day, last_day)
    marks = F.array(mark(F.lit(None).cast("date"), "ongoing", long), mark(F.col("first"), "opens", long & inside("first")), mark(F.col("last"), "last day", long & inside("last")), mark(F.greatest("first", first_day), "event", ~long))
    return rows.withColumn("m", F.explode(F.filter(marks, lambda m: m.isNotNull()))).select("id", "m.day", "m.mark")


def live_label(now: Column) -> Column:
    """What a card says about when a listing is on."""
    start, end = F.col("starts_at"), F.when(F.col("ends_at") > F.col("starts_at"), F.col("ends_at"))
    today = london_date(now)
    prefix = F.when(london_date(start) == today, "").otherwise(F.concat(F.date_format(london(start), "EEE"), F.lit(" ")))
    on_day = F.when(london_date(start) == today, "today").otherwise(F.date_format(london(start), "EEE"))
    title_day = F.when(london_date(start) == today, "Today").otherwise(F.date_format(london(start), "EEE"))
    ranged = F.coalesce(london_date(end) != london_date(start), F.lit(False))
    check = F.lit(" · check opening hours")
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return (
        F.when(ranged & (start > now) & ~untimed(), text("Opens ", prefix, clock(start))).when(ranged & (start > now), text("Opens ", on_day, check))
        .when(ranged & F.col("hours").isNotNull(), today_status(F.col("hours"), now)).when(ranged, "Open today · check opening hours").when(untimed(), text(title_day, check))
        .when((start > now) & end.isNotNull(), text("Starts ", prefix, clock(start), "–", clock(end))).when(start > now, text("Starts ", prefix, clock(start)))
        .when(end.isNotNull(), text("On now until ", clock(end))).otherwise(text("Started ", clock(start)))
    )


def escape(text: Column) -> Column:
    """A TEXT value of iCalendar."""
    for old, new in (("\\", "\\\\"), (";", "\\;"), (",", "\\,"), ("\r\n", "\n"), ("\r", "\n"), ("\n", "\\n")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return F.regexp_replace(text, r"\p{Cntrl}", "")


def fold(line: str) -> str:
    """A content line in parts of at most 75 octets, with its line end."""
    out, used, limit = [], 0, 75
    for c in line:
        size = len(c.encode())
        if used + size > limit:
            out.append("\r\n ")
            used, limit = 0, 74
        out.append(c)
        used += size
    return "".join(out) + "\r\n"


@F.pandas_udf(StringType())
def fold_lines(text: pd.Series) -> pd.Series:
    return text.map(lambda t: "".join(fold(line) for line in t.split("\n")), na_action="ignore")


def ics_events(df: DataFrame, stamp: str, domain: str = "example.org") -> DataFrame:
    """(id, ics): each listing's VEVENTs, one for each session of several, with folded lines."""
    parts = F.when(F.col("sessions").isNotNull(), F.col("sessions")).otherwise(F.array(F.struct("starts_at", "ends_at")))
    rows = df.withColumn("part", F.explode(parts))
    rows = rows.withColumn("uid", F.when(F.col("sessions").isNotNull(), F.concat_ws("-", F.col("id").cast("string"), F.date_format("part.starts_at", "yyyyMMdd'T'HHmmss'Z'"))).otherwise(F.col("id").cast("string")))
    rows = rows.withColumns({"starts_at": F.col("part.starts_at"), "ends_at": F.col("part.ends_at")})
    first, last = span()
    whole = untimed() | (F.datediff(last, first) + 1 >= LONG_RUN)
    utc = lambda c: F.date_format(c, "yyyyMMdd'T'HHmmss'Z'")
    end = F.when(F.col("ends_at") > F.col("starts_at"), F.concat(F.lit("DTEND:"), utc(F.col("ends_at"))))
    lines = F.array(
        F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:"), "uid", F.lit(f"@{domain}")), F.lit(f"DTSTAMP:{stamp}"),
        F.when(whole, F.concat(F.lit("DTSTART;VALUE=DATE:"), F.date_format(first, "yyyyMMdd"))).otherwise(F.concat(F.lit("DTSTART:"), utc(F.col("starts_at")))),
        F.when(whole, F.concat(F.lit("DTEND;VALUE=DATE:"), F.date_format(F.date_add(last, 1), "yyyyMMdd"))).otherwise(end),
        F.concat(F.lit("SUMMARY:"), escape(F.col("title"))), F.concat(F.lit("LOCATION:"), escape(F.col("venue"))), F.lit("END:VEVENT"),
    )
    event = F.array_join(F.filter(lines, lambda x: x.isNotNull()), "\n")
    return rows.select("id", "starts_at", event.alias("e")).groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("starts_at", "e"))), lambda x: x["e"]), "\n").alias("text")).select("id", fold_lines("text").alias("ics"))


def transit_outcome(km: Column, inside: Column, minutes: Column, walk: Column) -> Column:
    """What a journey lookup answers: short walk, outside, unavailable, not faster or a journey."""
    return F.when(km < 1.5, "short walk").when(~inside, "outside area").when(minutes.isNull(), "unavailable").when(minutes >= walk, "not faster").otherwise("journey")
