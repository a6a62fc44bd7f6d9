"""Listing queries as their URL states them: parsing, validation, cursors, and the plan for a frame of listings."""

from __future__ import annotations

import math
import re
import struct
from dataclasses import dataclass, field
from datetime import date, datetime, timedelta
from urllib.parse import parse_qsl, urlencode
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.catalog import CATEGORIES, GOOD_FOR, MUSIC_TAGS, VENUE_TYPES
from tidemark.functions import geo
from tidemark.operators import predicates as P
from tidemark.operators import ranking

LONDON, UTC = ZoneInfo("Europe/London"), ZoneInfo("UTC")
MOST, USUAL, MOST_IDS, MOST_RADIUS, USUAL_RADIUS, USUAL_HOURS = 100, 50, 100, 100.0, 5.0, 3
SORTS = ["soonest", "nearest", "ending", "added", "surprise", "relevance", "richest", "fullest"]
CLOSED = {"category": CATEGORIES, "good_for": GOOD_FOR, "venue_type": VENUE_TYPES, "music": MUSIC_TAGS, "membership": ["art_pass"]}
WHEN = {"evening": P.when_evening, "after_work": P.when_after_work, "daytime": P.when_daytime}
PICKS = ["tonight", "openings", "last_chance", "hands_on", "open_now"]
#: Each sort's letter in cursors, and the types of its position before the id.
CURSORS = {"soonest": ("s", "t"), "nearest": ("d", "f"), "ending": ("e", "t"), "added": ("a", "t"), "surprise": ("r", "D"), "relevance": ("q", "f"), "richest": ("f", "DDi"), "fullest": ("g", "DDit")}


class QueryError(ValueError):
    """What is wrong with a query, for the one who wrote it."""


def _part(kind: str, value) -> str:
    if kind == "t":
        return str(round((value - datetime(1970, 1, 1)) / timedelta(microseconds=1)))
    return struct.pack(">d", value).hex() if kind == "f" else value.strftime("%Y%m%d") if kind == "D" else str(value)


def _value(kind: str, text: str):
    if kind == "t":
        return datetime(1970, 1, 1) + timedelta(microseconds=int(text))
    return struct.unpack(">d", bytes.fromhex(text))[0] if kind == "f" else datetime.strptime(text, "%Y%m%d").date() if kind == "D" else int(text)


def encode_cursor(sort: str, position: list, row_id: int) -> str:
    letter, kinds = CURSORS[sort]
    return f"{letter}:{'_'.join(map(_part, kinds, position))}:{row_id}".encode().hex()


def decode_cursor(sort: str, text: str) -> tuple[list, int]:
    """Position and id; a cursor of another sort, or none at all, is an error."""
    try:
        letter, position, row_id = bytes.fromhex(text).decode().split(":")
        known = {v[0] for v in CURSORS.values()}
        if letter not in known:
            raise ValueError(letter)
        kinds = CURSORS[sort][1]
        if letter == CURSORS[sort][0]:
            return [_value(k, p) for k, p in zip(kinds, position.split("_"), strict=True)], int(row_id)
    except (ValueError, struct.error) as e:
        raise QueryError("invalid cursor") from e
    raise QueryError("cursor does not match the sort")


@dataclass
class ListingQuery:
    chosen: dict[str, list[str]] = field(default_factory=dict)
    ids: list[int] = field(default_factory=list)
    sources: list[int] = field(default_factory=list)
    since: datetime | None = None
    until: datetime | None = None
    live_at: datetime | None = None
    free: bool = False
    price_max: int | None = None
    when: str | None = None
    pick: str | None = None
    open_on: int | None = None
    near: tuple[float, float, float] | None = None
    text: str | None = None
    sort: str = "fullest"
    fell_back_from: str | None = None
    day: date | None = None
    limit: int = USUAL
    cursor: tuple[list, int] | None = None


def midnight(day: date) -> datetime:
    """The instant (UTC, without zone) at which a London day begins."""
    return datetime(day.year, day.month, day.day, tzinfo=LONDON).astimezone(UTC).replace(tzinfo=None)


def london_day(instant: datetime) -> date:
    return instant.replace(tzinfo=UTC).astimezone(LONDON).date()


def _instant(text: str) -> datetime:
    found = datetime.fromisoformat(text)
    return (found if found.tzinfo else found.replace(tzinfo=LONDON)).astimezone(UTC).replace(tzinfo=None)


def _number(name: str, text: str, low: float, high: float) -> float:
    try:
        value = float(text)
    except ValueError:
        value = math.nan
    if not low <= value <= high:
        raise QueryError(f"{name} must be between {low:g} and {high:g}")
    return value


def _choice(name: str, text: str, values) -> str:
    if text not in values:
        raise QueryError(f"{name} must be one of {', '.join(values)}")
    return text


def parse_query(raw: str, now: datetime) -> ListingQuery:
    """The query of a URL's parameters at an instant (UTC, without zone); unknown or contradictory ones are errors."""
    q, given = ListingQuery(), {}
    for name, value in parse_qsl(raw, keep_blank_values=True):
        if name in CLOSED:
            values = q.chosen.setdefault(name, [])
            if _choice(name, value, CLOSED[name]) not in values:
                values.append(value)
        elif name in ("medium", "format", "borough"):
            q.chosen.setdefault(name, []).append(value)
        elif name in ("ids", "source"):
            numbers = [int(v) if v.isdigit() else -1 for v in value.split(",")]
            if -1 in numbers or len(numbers) > MOST_IDS:
                raise QueryError(f"{name} must be at most {MOST_IDS} numbers")
            (q.ids if name == "ids" else q.sources).extend(numbers)
        elif name in ("from", "to", "free", "price_max", "when", "pick", "open_on", "at", "within_hours", "open_now", "open_at", "near", "radius_km", "within_walk_min", "q", "sort", "limit", "cursor"):
            given[name] = value
        else:
            raise QueryError(f"unknown parameter {name!r}")
    try:
        first, last = (date.fromisoformat(given[n]) if n in given else None for n in ("from", "to"))
        at = _instant(given["open_at"]) if "open_at" in given else now if given.get("open_now") == "true" else None
    except ValueError as e:
        raise QueryError(f"not a date or time: {e}") from e
    if first and last and first > last:
        raise QueryError("from must not be after to")
    q.since, q.until = midnight(first) if first else None, midnight(last + timedelta(1)) if last else None
    q.free = given.get("free") == "true"
    q.price_max = round(100 * _number("price_max", given["price_max"], 0, 1e6)) if "price_max" in given else None
    q.when = _choice("when", given["when"], [*WHEN, "weekend"]) if "when" in given else None
    q.pick = _choice("pick", given["pick"], PICKS) if "pick" in given else None
    q.open_on = int(_number("open_on", given["open_on"], 1, 7)) if "open_on" in given else None
    window = first or last or q.when
    hours = _number("within_hours", given["within_hours"], 0, 24) if "within_hours" in given else None
    if {"open_at", "open_now"} <= {*given}:
        raise QueryError("use open_now or open_at, not both")
    if at is not None:
        if {"at", "within_hours"} & {*given} or window:
            raise QueryError("open_now and open_at cannot be combined with at, within_hours, from, to or when")
        q.live_at, q.until = at, at + timedelta(seconds=1)
    if "at" in given:
        kind = _choice("at", given["at"], ["now", "today"])
        if window or (kind == "today" and hours is not None):
            raise QueryError("at cannot be combined with from, to or when; within_hours requires at=now")
        q.live_at, q.until = now, now + timedelta(hours=USUAL_HOURS if hours is None else hours) if kind == "now" else midnight(london_day(now) + timedelta(1))
    elif hours is not None:
        raise QueryError("within_hours requires at=now")
    if "near" in given:
        if {"radius_km", "within_walk_min"} <= {*given}:
            raise QueryError("use radius_km or within_walk_min, not both")
        lat, _, lng = given["near"].partition(",")
        km = _number("radius_km", given.get("radius_km", str(USUAL_RADIUS)), 1e-6, MOST_RADIUS)
        if "within_walk_min" in given:
            km = geo.walk_radius_km(_number("within_walk_min", given["within_walk_min"], 1, 600))
        q.near = (_number("near", lat, -90, 90), _number("near", lng, -180, 180), km)
    elif {"radius_km", "within_walk_min"} & {*given}:
        raise QueryError("radius_km and within_walk_min require near")
    q.text = given.get("q", "").strip() or None
    if q.text and len(q.text) > 200:
        raise QueryError("q must be at most 200 characters")
    q.limit = int(_number("limit", given["limit"], 1, MOST)) if "limit" in given else USUAL
    wanted = _choice("sort", given["sort"], SORTS) if "sort" in given else "relevance" if q.text else "nearest" if q.near else "fullest"
    q.sort = "soonest" if (wanted == "nearest" and not q.near) or (wanted == "relevance" and not q.text) else wanted
    q.fell_back_from = wanted if wanted != q.sort else None
    q.cursor = decode_cursor(q.sort, given["cursor"]) if "cursor" in given else None
    # a walk over pages keeps the day that it began with
    q.day = q.cursor[0][0] if q.cursor and q.sort in ("surprise", "richest", "fullest") else first or london_day(q.live_at or now)
    return q


COLUMNS = {"category": "category", "borough": "borough", "venue_type": "venue_type"}
ARRAYS = {"medium": "mediums", "format": "formats", "good_for": "good_for", "music": "music", "membership": "memberships"}


def _lit(at: datetime | None) -> Column | None:
    return None if at is None else F.lit(at.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp")


def apply(q: ListingQuery, listings: DataFrame, now: datetime, links: DataFrame | None = None, relevance: DataFrame | None = None) -> DataFrame:
    """The next page of a query and one more row, in order; only active filters are in the plan.

    links (id, source_id) is needed for sources, relevance (id, rank) for a text.
    """
    since, until, today = _lit(q.since), _lit(q.until), P.day_column(q.day)
    tests: list[Column] = [F.col(COLUMNS[n]).isin(v) for n, v in q.chosen.items() if n in COLUMNS] + [P.any_tag(ARRAYS[n], v) for n, v in q.chosen.items() if n in ARRAYS]
    tests.append(P.live(_lit(q.live_at), until) if q.live_at else P.in_window(since, until))
    if q.ids:
        tests.append(F.col("id").isin(q.ids))
    if q.free or q.price_max is not None:
        tests.append(P.price_at_most(q.price_max, q.free))
    if q.when:
        tests.append(P.on_weekdays([6, 7], since, until) if q.when == "weekend" else WHEN[q.when]())
    if q.open_on:
        tests.append(P.on_weekdays([q.open_on], since, until))
    if q.pick:
        tests.append({"tonight": lambda: P.pick_tonight(today), "openings": lambda: P.pick_openings(today), "last_chance": lambda: P.pick_last_chance(today, _lit(now)), "hands_on": P.pick_hands_on, "open_now": lambda: P.pick_open_now(_lit(now))}[q.pick]())
    if q.near:
        tests.append(geo.near(*q.near))
    df = listings
    for test in tests:
        df = df.filter(test)
    if q.sources:
        df = P.listed_by(df, links, q.sources)
    if q.text:
        df = df.join(relevance, "id")
    order: list[tuple[str, bool]] = [("id", False)]
    if q.sort == "soonest":
        order = [("starts_at", False), *order]
    elif q.sort == "nearest":
        df, order = df.withColumn("km", geo.distance(F.lit(q.near[0]), F.lit(q.near[1]), F.col("lat"), F.col("lng"))), [("km", False), *order]
    elif q.sort == "ending":
        df, order = df.withColumn("ends", P.effective_end()).filter(F.col("ends") > _lit(now)), [("ends", False), *order]
    elif q.sort == "added":
        order = [("first_seen", True), ("id", True)]
    elif q.sort == "surprise":
        df, order = df.withColumn("shuffle", ranking.shuffled("id", str(q.day))), [("shuffle", False), *order]
    elif q.sort == "relevance":
        order = [("rank", True), *order]
    elif q.sort == "richest":
        df, order = ranking.with_slots(df, today), [("day", False), ("slot", False), *order]
    else:
        df, order = df.withColumns({"day": ranking.day_in_window(today), "slot": (F.lit(ranking.FULLEST) - ranking.fullness()).cast("long")}), [("day", False), ("slot", False), ("starts_at", False), *order]
    cursor = None
    if q.cursor:
        position, row_id = q.cursor
        position = position[1:] if q.sort in ("richest", "fullest") else [F.md5(F.lit(f"{row_id}{q.day}"))] if q.sort == "surprise" else position
        cursor = [_lit(v) if isinstance(v, datetime) else P.day_column(v) if isinstance(v, date) else v for v in position] + [row_id]
    return ranking.page(df, order, q.limit, cursor)


def next_cursor(q: ListingQuery, rows: list) -> str | None:
    """The cursor behind the page's last row, if the row after the page is there."""
    if len(rows) <= q.limit:
        return None
    r = rows[q.limit - 1]
    naive = lambda t: t.replace(tzinfo=None)
    position = {"soonest": lambda: [naive(r.starts_at)], "nearest": lambda: [r.km], "ending": lambda: [naive(r.ends)], "added": lambda: [naive(r.first_seen)], "surprise": lambda: [q.day], "relevance": lambda: [r["rank"]], "richest": lambda: [q.day, r.day, r.slot], "fullest": lambda: [q.day, r.day, r.slot, naive(r.starts_at)]}
    return encode_cursor(q.sort, position[q.sort](), r.id)


#: Filters that can be dropped to find more, with their labels.
RELAXED = [
    ("Dates", ("from", "to")), ("Type: {category}", ("category",)), ("When: {when}", ("when",)), ("Under £{price_max}", ("price_max",)), ("Free", ("free",)), ("Area: {near}", ("near", "radius_km")),
    ("Within {within_walk_min} min walk", ("here", "within_walk_min")), ("Medium: {medium}", ("medium",)), ("Format: {format}", ("format",)), ("Good for: {good_for}", ("good_for",)), ("Music: {music}", ("music",)),
    ("Membership: {membership}", ("membership",)), ("Venue type: {venue_type}", ("venue_type",)), ("Borough: {borough}", ("borough",)),
]


def relaxations(query: str, today: date) -> list[tuple[str, str]]:
    """For a query that finds nothing: (label, query) of each filter that can go, everything else kept; dates fall back to
    today and open, and count as a filter only if they say more than that."""
    pairs = parse_qsl(query)
    given: dict[str, list[str]] = {}
    for name, value in pairs:
        given.setdefault(name, []).append(value.replace("_", " "))
    out = []
    for label, names in RELAXED:
        used = [n for n in names if n in given]
        if not used or (names[0] == "from" and "to" not in given and given.get("from") == [today.isoformat()]):
            continue
        out.append((label.format_map({n: ", ".join(v) for n, v in given.items()} | {n: "" for n in names if n not in given}), urlencode([p for p in pairs if p[0] not in names])))
    return out
