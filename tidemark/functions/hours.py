"""Opening hours: arrays of (days, opens, closes) with ISO weekdays and HH:mm."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.timex import clock, iso_weekday, london_date

#: Short names of ISO weekdays.
DAYS = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]


def on_day(hours: Column, weekday: Column) -> Column:
    return F.get(F.filter(hours, lambda r: F.array_contains(r["days"], weekday)), F.lit(0))


def is_open_at(hours: Column, now: Column) -> Column:
    """Open at an instant: opens <= London time < closes."""
    rule = on_day(hours, iso_weekday(london_date(now)))
    return F.coalesce((rule["opens"] <= clock(now)) & (clock(now) < rule["closes"]), F.lit(False))


def display(hours: Column) -> Column:
    names = F.array(*map(F.lit, DAYS))
    days = lambda r: F.when(F.size(r["days"]) == 7, "Daily").otherwise(F.array_join(F.transform(r["days"], lambda d: F.get(names, d - 1)), ", "))
    return F.array_join(F.transform(hours, lambda r: F.concat(days(r), F.lit(" · "), r["opens"], F.lit("–"), r["closes"])), "; ")


def today_status(hours: Column, now: Column) -> Column:
    rule = on_day(hours, iso_weekday(london_date(now)))
    return (
        F.when(rule.isNull(), "Closed today").when(clock(now) < rule["opens"], F.concat(F.lit("Opens today at "), rule["opens"]))
        .when(clock(now) < rule["closes"], F.concat(F.lit("Open now until "), rule["closes"])).otherwise("Closed now")
    )


def valid(hours: Column) -> Column:
    """Some rules, all with days 1 to 7 and opens < closes, no day in two rules."""
    days = F.flatten(F.transform(hours, lambda r: F.array_distinct(r["days"])))
    good = F.forall(hours, lambda r: (F.size(r["days"]) > 0) & (r["opens"] < r["closes"]) & F.forall(r["days"], lambda d: d.between(1, 7)))
    return F.coalesce((F.size(hours) > 0) & good & (F.size(days) == F.size(F.array_distinct(days))), F.lit(False))


def from_schema_org(specs: Column) -> Column:
    """Rules of strings like "Mo-Fr 10:00-17:00" or "Tu,We 11:00-18:00"; null if one can't be read or they don't go together."""
    codes = F.array(*[F.lit(d[:2].lower()) for d in DAYS])
    code = lambda c: F.array_position(codes, F.lower(F.trim(c))).cast("int")
    spec = r"^\s*([A-Za-z,-]+) +([0-9]{2}:[0-9]{2}) *- *([0-9]{2}:[0-9]{2})\s*$"

    def span(part: Column) -> Column:
        ends = F.split(part, "-")
        low, high = code(ends[0]), code(F.try_element_at(ends, F.lit(-1)))
        return F.when((low > 0) & (high > 0), F.transform(F.sequence(F.lit(0), F.pmod(high - low, F.lit(7))), lambda k: (low - 1 + k) % 7 + 1))

    def rule(s: Column) -> Column:
        days = F.flatten(F.transform(F.split(F.regexp_extract(s, spec, 1), ","), span))
        return F.struct(F.array_sort(F.array_distinct(days)).alias("days"), F.regexp_extract(s, spec, 2).alias("opens"), F.regexp_extract(s, spec, 3).alias("closes"))

    rules = F.transform(specs, rule)
    read = F.forall(specs, lambda s: s.rlike(spec))
    return F.when(read & F.forall(rules, lambda r: r["days"].isNotNull()) & valid(rules), rules)


def from_spec_json(json: Column) -> Column:
    """Rules of an openingHoursSpecification, an object or an array of them, days as names, links to them or lists of these;
    null if a part can't be read, seconds aren't zero or the rules don't go together."""
    listed = F.when(F.ltrim(json).startswith("["), json).otherwise(F.concat(F.lit("["), json, F.lit("]")))
    specs = F.from_json(listed, "array<struct<dayOfWeek:string,opens:string,closes:string>>")
    names = F.array(*[F.lit(d[:3].lower()) for d in DAYS])

    def days(x: Column) -> Column:
        every = F.when(x.startswith("["), F.from_json(x, "array<string>")).otherwise(F.array(x))
        return F.transform(every, lambda d: F.array_position(names, F.substring(F.lower(F.element_at(F.split(d, "/"), -1)), 1, 3)).cast("int"))

    clock_of = lambda t: F.nullif(F.regexp_extract(t, r"^([01][0-9]|2[0-3]):([0-5][0-9])(:00)?$", 0), F.lit(""))
    rules = F.transform(specs, lambda r: F.struct(F.array_sort(days(r["dayOfWeek"])).alias("days"), F.substring(clock_of(r["opens"]), 1, 5).alias("opens"), F.substring(clock_of(r["closes"]), 1, 5).alias("closes")))
    read = F.forall(rules, lambda r: r["days"].isNotNull() & r["opens"].isNotNull() & r["closes"].isNotNull() & ~F.array_contains(r["days"], 0))
    return F.when(F.coalesce(read, F.lit(False)) & valid(rules), rules)
