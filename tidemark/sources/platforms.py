"""Listings of event platforms out of their JSON, with what is wrong with those that can't be taken."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.timex import parse_datetime

#: The pages of a WordPress events calendar, as its REST interface gives them.
CALENDAR_PAGE = (
    "struct<total_pages:int,events:array<struct<url:string,title:string,description:string,all_day:boolean,start_date:string,end_date:string,cost:string,"
    "image:struct<url:string>,categories:array<struct<name:string,slug:string>>,venue:struct<venue:string,address:string,city:string,zip:string,geo_lat:double,geo_lng:double>,"
    "is_virtual:boolean,hide_from_listings:boolean>>>"
)
RAW = "source_event_id string, source_url string, reason string"


def calendar_events(pages: DataFrame, json_col: str = "json") -> DataFrame:
    """A row per event of calendar pages: source_event_id (the link's path), source_url, reason (null, or why it is skipped),
    title, description, venue, address, lat, lng, starts_at, ends_at, all_day, cost, image_url, tags.

    A page without events gives one skipped row; so does an event without a usable link, title or start, a hidden or an
    online one. Columns of pages other than the JSON stay.
    """
    kept = [c for c in pages.columns if c != json_col]
    read = pages.select(*kept, F.from_json(json_col, CALENDAR_PAGE).alias("page"))
    rows = read.select(*kept, F.col("page.events").isNull().alias("broken"), F.explode_outer("page.events").alias("e"))
    host = F.regexp_extract("e.url", r"^https?://[^/?#]+", 0)
    path = F.regexp_extract("e.url", r"^https?://[^/?#]+([^?#]*)", 1)
    at = lambda c: parse_datetime(F.replace(F.col(c), F.lit(" "), F.lit("T")))
    reason = (
        F.when(F.col("broken"), "no events array").when(F.coalesce(host, F.lit("")) == "", "no usable link").when(F.coalesce(F.trim("e.title"), F.lit("")) == "", "no title")
        .when(at("e.start_date").isNull(), "no start").when(F.coalesce("e.hide_from_listings", F.lit(False)), "hidden").when(F.coalesce("e.is_virtual", F.lit(False)), "online")
    )
    address = F.nullif(F.concat_ws(", ", *[F.nullif(F.trim(f"e.venue.{c}"), F.lit("")) for c in ("address", "city", "zip")]), F.lit(""))
    return rows.filter(F.col("broken") | F.col("e").isNotNull()).select(
        *kept, F.when(path == "", "/").otherwise(path).alias("source_event_id"), F.col("e.url").alias("source_url"), reason.alias("reason"), F.trim("e.title").alias("title"), F.col("e.description").alias("description"),
        F.col("e.venue.venue").alias("venue"), address.alias("address"), F.col("e.venue.geo_lat").alias("lat"), F.col("e.venue.geo_lng").alias("lng"), at("e.start_date").alias("starts_at"), at("e.end_date").alias("ends_at"),
        F.coalesce("e.all_day", F.lit(False)).alias("all_day"), F.col("e.cost").alias("cost"), F.col("e.image.url").alias("image_url"), F.coalesce(F.transform("e.categories", lambda c: c["name"]), F.array().cast("array<string>")).alias("tags"),
    )


def embedded_json(html: Column, element: str = "__NEXT_DATA__") -> Column:
    """The JSON that a page holds in the script with that id; null without one."""
    return F.nullif(F.trim(F.regexp_extract(html, rf"(?s)<script[^>]*\bid=[\"']{element}[\"'][^>]*>(.*?)</script>", 1)), F.lit(""))


def skipped(rows: DataFrame) -> DataFrame:
    """(reason, n): the skip log of a run."""
    return rows.filter("reason IS NOT NULL").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
