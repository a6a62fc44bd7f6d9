"""Listing filters as Column predicates. `now` and all days are parameters; absent filters are simply left out."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.timex import clock, iso_weekday, london_date, midnight, utc

LOOKBACK_HOURS, GRACE_MINUTES, ENDING_HOURS = 48, 60, 3

#: Title words that mark openings and hands-on sessions.
OPENING_TITLE = r"(?i)\b(private view|opening reception|opening night|preview evening|launch)\b"
OPENING_CAPITALS = r"\bPV\b"
HANDS_ON_TITLE = r"(?i)\b(class|classes|course|drop-in|life drawing|masterclass|workshops?)\b"


def whole_end() -> Column:
    return F.coalesce("ends_at", "starts_at")


def some(array: str, test) -> Column:
    """Some element passes; false for a null array."""
    return F.coalesce(F.exists(F.col(array), test), F.lit(False))


def day_column(day: date | str) -> Column:
    return F.lit(str(day)).cast("date")


def from_day(day: date | str) -> Column:
    return whole_end() >= midnight(day_column(day))


def to_day(day: date | str) -> Column:
    return F.col("starts_at") < midnight(F.date_add(day_column(day), 1))


def in_window(since: Column | None, until: Column | None) -> Column:
    """Overlaps [since, until); of several sessions, one has to."""
    whole, session = F.lit(True), lambda s: F.lit(True)
    if since is not None:
        whole = whole & (whole_end() >= since)
    if until is not None:
        whole = whole & (F.col("starts_at") < until)

    def one(s: Column) -> Column:
        ok = F.lit(True)
        if since is not None:
            ok = ok & (F.coalesce(s["ends_at"], s["starts_at"]) >= since)
        if until is not None:
            ok = ok & (s["starts_at"] < until)
        return ok

    return whole & (F.col("sessions").isNull() | some("sessions", one))


def any_tag(column: str, tags: list[str]) -> Column:
    return F.coalesce(F.arrays_overlap(F.col(column), F.array(*map(F.lit, tags))), F.lit(False))


def price_at_most(pence: int | None, free_only: bool = False) -> Column:
    """Free, or known to cost at most so much in pounds."""
    limit = F.lit(True) if pence is None else F.col("is_free") | F.coalesce((F.col("price_min") <= pence) & (F.coalesce("currency", F.lit("GBP")) == "GBP"), F.lit(False))
    return limit & F.col("is_free") if free_only else limit


def price_unknown() -> Column:
    return ~F.col("is_free") & F.col("price_min").isNull()


def open_rule(test) -> Column:
    return some("hours", test)


def by_hours(with_hours: Column, without: Column) -> Column:
    return F.when(F.col("hours").isNotNull(), with_hours).otherwise(without)


def late() -> Column:
    return (clock(F.col("starts_at")) == "00:00") & F.col("late_opening")


def when_evening() -> Column:
    return by_hours(open_rule(lambda r: r["closes"] > "18:00"), (clock(F.col("starts_at")) >= "18:00") | late())


def when_after_work() -> Column:
    start = clock(F.col("starts_at"))
    weekday = iso_weekday(london_date(F.col("starts_at"))) <= 5
    hours = open_rule(lambda r: (r["closes"] > "17:30") & (r["opens"] <= "20:30") & F.exists(r["days"], lambda d: d <= 5))
    return by_hours(hours, (weekday & start.between("17:30", "20:30")) | late())


def when_daytime() -> Column:
    return by_hours(open_rule(lambda r: r["opens"] < "18:00"), clock(F.col("starts_at")) < "18:00")


def on_weekdays(weekdays: list[int], since: Column | None, until: Column | None) -> Column:
    """Some day of the listing within the window, among the first seven, is such a weekday and open by its hours."""
    first, last = london_date(F.col("starts_at")), london_date(whole_end())
    low = first if since is None else F.greatest(first, london_date(since))
    high = last if until is None else F.least(last, F.date_sub(london_date(until), 1))
    days = F.when(high >= low, F.sequence(low, F.least(high, F.date_add(low, 6))))
    fits = lambda d: iso_weekday(d).isin(weekdays) & (F.col("hours").isNull() | open_rule(lambda r: F.array_contains(r["days"], iso_weekday(d))))

    def session(s: Column) -> Column:
        ok = iso_weekday(london_date(s["starts_at"])).isin(weekdays)
        if since is not None:
            ok = ok & (F.coalesce(s["ends_at"], s["starts_at"]) >= since)
        return ok if until is None else ok & (s["starts_at"] < until)

    return F.when(F.col("sessions").isNotNull(), some("sessions", session)).otherwise(F.coalesce(F.exists(days, fits), F.lit(False)))


def still_on(now: Column, until: Column | None = None) -> Column:
    """Not over at now; of several sessions, one isn't and starts before until."""
    grace = F.make_dt_interval(mins=F.lit(GRACE_MINUTES))

    def session(s: Column) -> Column:
        ok = F.coalesce(s["ends_at"], s["starts_at"] + grace) > now
        return ok if until is None else ok & (s["starts_at"] < until)

    return (
        F.when(F.col("sessions").isNotNull(), some("sessions", session))
        .when(F.col("all_day"), midnight(F.date_add(london_date(whole_end()), 1)) > now)
        .when(F.col("ends_at").isNotNull(), F.col("ends_at") > now)
        .otherwise(F.col("starts_at") + grace > now)
    )


def live(now: Column, until: Column | None) -> Column:
    """On at now or from then on until the end of the window, and open by its hours."""
    since = now - F.make_dt_interval(hours=F.lit(LOOKBACK_HOURS))

    def rule(r: Column) -> Column:
        base = F.array_contains(r["days"], iso_weekday(london_date(now))) & (r["closes"] > clock(now))
        if until is None:
            return base & (r["opens"] <= clock(now))
        return base & ((london_date(until) > london_date(now)) | (r["opens"] < clock(until)))

    return in_window(since, until) & still_on(now, until) & (F.col("hours").isNull() | open_rule(rule))


def open_at(now: Column) -> Column:
    return live(now, now + F.expr("INTERVAL 1 SECOND"))


def effective_end() -> Column:
    day_later = utc(F.from_utc_timestamp(whole_end(), "Europe/London") + F.expr("INTERVAL 1 DAY"))
    return F.when(F.col("all_day"), day_later).when(F.col("ends_at").isNotNull(), F.col("ends_at")).otherwise(F.col("starts_at") + F.make_dt_interval(hours=F.lit(ENDING_HOURS)))


def pick_tonight(today: Column) -> Column:
    first, last = london_date(F.col("starts_at")), london_date(whole_end())
    session = some("sessions", lambda s: (london_date(s["starts_at"]) == today) & (clock(s["starts_at"]) >= "17:00"))
    hours = open_rule(lambda r: F.array_contains(r["days"], iso_weekday(today)) & (r["closes"] > "18:00"))
    plain = ((first == today) & (clock(F.col("starts_at")) >= "17:00")) | late()
    return (first <= today) & (last >= today) & F.when(F.col("sessions").isNotNull(), session).when(F.col("hours").isNotNull(), hours).otherwise(plain)


def pick_openings(today: Column) -> Column:
    title = F.col("title").rlike(OPENING_TITLE) | F.col("title").rlike(OPENING_CAPITALS)
    return london_date(F.col("starts_at")).between(today, F.date_add(today, 6)) & ((F.col("category") == "exhibition") | F.col("opening_tag") | title)


def pick_last_chance(today: Column, now: Column) -> Column:
    first, last = london_date(F.col("starts_at")), london_date(whole_end())
    return (last > first) & last.between(today, F.date_add(today, 6)) & (effective_end() > now)


def pick_hands_on() -> Column:
    return (F.col("category") == "workshop") | F.col("workshop_tag") | F.col("title").rlike(HANDS_ON_TITLE)


def pick_open_now(now: Column) -> Column:
    hours = open_rule(lambda r: F.array_contains(r["days"], iso_weekday(london_date(now))) & (r["opens"] <= clock(now)) & (r["closes"] > clock(now)))
    timed = ~F.col("all_day") & (clock(F.col("starts_at")) != "00:00")
    return (F.col("starts_at") <= now) & still_on(now, now + F.expr("INTERVAL 1 SECOND")) & by_hours(hours, timed)


def listed_by(listings: DataFrame, links: DataFrame, source_ids: list[int]) -> DataFrame:
    """Listings that any of the sources lists."""
    return listings.join(links.filter(F.col("source_id").isin(source_ids)).select("id"), "id", "left_semi")
