"""Links that share a listing: calendars, maps, public transport; and what a listing looks like as JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.timex import london_date


def percent(text: Column) -> Column:
    """Percent-encoded: all but letters, digits and -._~."""
    return F.replace(F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def location(venue: Column, address: Column) -> Column:
    """Venue and address without space around them, those that aren't empty; null without either."""
    parts = F.filter(F.transform(F.array(venue, address), lambda x: F.trim(x)), lambda x: F.coalesce(x != "", F.lit(False)))
    return F.when(F.size(parts) > 0, F.array_join(parts, ", "))


def calendar_dates(starts: Column, ends: Column, all_day: Column) -> Column:
    """Dates with the day after the last, or UTC instants; without an end, an instant ends when it starts."""
    first, last = london_date(starts), london_date(F.greatest(starts, F.coalesce(ends, starts)))
    stamp = lambda c: F.date_format(c, "yyyyMMdd'T'HHmmss'Z'")
    day = lambda d: F.date_format(d, "yyyyMMdd")
    return F.when(all_day, F.concat(day(first), F.lit("/"), day(F.date_add(last, 1)))).otherwise(F.concat(stamp(starts), F.lit("/"), stamp(F.coalesce(ends, starts))))


def calendar_url(title: Column, dates: Column, place: Column, details: Column) -> Column:
    """The template link of a web calendar."""
    at = F.coalesce(F.concat(F.lit("&location="), percent(place)), F.lit(""))
    return F.concat(F.lit("https://calendar.google.com/calendar/render?action=TEMPLATE&text="), percent(title), F.lit("&dates="), percent(dates), at, F.lit("&details="), percent(details))


def map_links(lat: Column, lng: Column, name: Column, place: Column) -> dict[str, Column]:
    """Views and transit directions on two map services, by coordinates where both are known, else by the place's text; null
    without a place."""
    point = F.concat(lat.cast("string"), F.lit(","), lng.cast("string"))
    where = percent(F.coalesce(point, place))
    view = F.when(point.isNotNull(), F.concat(F.lit("https://maps.apple.com/?q="), percent(name), F.lit("&ll="), where)).otherwise(F.concat(F.lit("https://maps.apple.com/?q="), where))
    return {
        "google_view": F.concat(F.lit("https://www.google.com/maps/search/?api=1&query="), where),
        "google_directions": F.concat(F.lit("https://www.google.com/maps/dir/?api=1&destination="), where, F.lit("&travelmode=transit")),
        "apple_view": view, "apple_directions": F.concat(F.lit("https://maps.apple.com/?daddr="), where, F.lit("&dirflg=r")),
    }


def event_json(columns: dict[str, Column]) -> Column:
    """The columns as one JSON object, in their order, nulls kept."""
    return F.to_json(F.struct(*[c.alias(name) for name, c in columns.items()]), {"ignoreNullFields": "false"})
