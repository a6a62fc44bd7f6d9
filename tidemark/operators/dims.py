"""Venues and other dimensions kept in step with the listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import slug, venue_key
from tidemark.operators.latest import most_common


def resolve_venue(df: DataFrame, aliases: DataFrame, column: str = "venue") -> DataFrame:
    """Add canonical: the alias's name, null where the alias says it's no venue, the name itself without an alias."""
    known = aliases.select(venue_key(F.col("alias")).alias("_key"), F.col("canonical").alias("_canonical"), F.lit(True).alias("_known"))
    out = df.withColumn("_key", venue_key(F.col(column))).join(known, "_key", "left")
    return out.withColumn("canonical", F.when(F.col("_known"), F.col("_canonical")).otherwise(F.col(column))).drop("_key", "_canonical", "_known")


def sync_venues(listings: DataFrame, venues: DataFrame) -> DataFrame:
    """(key, name, point, created) of every venue with a listing or a row: gaps filled with what its listings say most."""
    keyed = listings.withColumn("key", venue_key(F.col("venue"))).filter("key <> 'unknown'")
    keyed = keyed.withColumn("point", F.concat_ws(" ", F.round("lat", 5).cast("decimal(9,5)").cast("string"), F.round("lng", 5).cast("decimal(9,5)").cast("string")))
    names, points = most_common(keyed, ["key"], "venue"), most_common(keyed, ["key"], "point")
    said = names.join(points, "key", "left").select("key", F.col("venue").alias("said_name"), F.col("point").alias("said_point"))
    out = said.join(venues, "key", "full")
    return out.select("key", F.coalesce("name", "said_name").alias("name"), F.coalesce("point", "said_point").alias("point"), F.col("name").isNull().alias("created"))


def full_venues(listings: DataFrame, venues: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All venues and the listings' links to them.

    listings: id, venue, lat, lng, borough, venue_type; venues (key, name, point, borough, venue_type, slug) as stored. A venue
    without a row is created, gaps of a row are filled with what its listings say most, new rows get a slug that no other has.
    Links are (id, key) of the listings whose venue is known.
    """
    keyed = listings.withColumn("key", venue_key(F.col("venue"))).filter("key <> 'unknown'")
    base = sync_venues(listings.select("venue", "lat", "lng"), venues.select("key", "name", "point"))
    said = most_common(keyed, ["key"], "borough").select("key", F.col("borough").alias("_borough")).join(most_common(keyed, ["key"], "venue_type").select("key", F.col("venue_type").alias("_type")), "key", "full")
    out = base.join(said, "key", "left").join(venues.select("key", "borough", "venue_type", "slug"), "key", "left")
    out = out.withColumns({"borough": F.coalesce("borough", "_borough"), "venue_type": F.coalesce("venue_type", "_type")}).drop("_borough", "_type")
    taken = out.filter("slug IS NOT NULL")
    fresh = numbered_slugs(out.filter("slug IS NULL").drop("slug"), "name", "key")
    clash = taken.select(F.col("slug").alias("_taken")).distinct()
    fresh = fresh.join(clash, fresh["slug"] == clash["_taken"], "left").withColumn("slug", F.when(F.col("_taken").isNotNull(), F.concat_ws("-", "slug", F.col("key"))).otherwise(F.col("slug"))).drop("_taken")
    return taken.unionByName(fresh), keyed.select("id", "key")


def numbered_slugs(df: DataFrame, name: str, id_col: str) -> DataFrame:
    """Add slug: the name's, with -2, -3 and so on for further rows of the same base by id."""
    from pyspark.sql import Window

    base = F.when(slug(F.col(name)) == "", "venue").otherwise(slug(F.col(name)))
    n = F.row_number().over(Window.partitionBy("_base").orderBy(id_col))
    out = df.withColumn("_base", base).withColumn("_n", n)
    return out.withColumn("slug", F.when(F.col("_n") == 1, F.col("_base")).otherwise(F.concat_ws("-", "_base", F.col("_n").cast("string")))).drop("_base", "_n")


def changes(df: DataFrame, key: str, stored: str, derived: Column) -> DataFrame:
    """Rows whose stored value isn't the derived one; nulls equal nulls."""
    return df.withColumn("derived", derived).filter(~F.col(stored).eqNullSafe(F.col("derived"))).select(key, stored, "derived")


def to_geocode(venues: DataFrame, upcoming: DataFrame, now: Column, cap: int = 60) -> DataFrame:
    """Venues without a point but with upcoming listings, not tried in the last seven days, the first `cap` by key."""
    due = F.col("tried_at").isNull() | (F.col("tried_at") <= now - F.expr("INTERVAL 7 DAYS"))
    return venues.filter(F.col("lat").isNull() & due).join(upcoming.select("venue_id"), "venue_id", "left_semi").orderBy("venue_id").limit(cap)


def inherit_hours(own: Column, venue: Column, timed: Column) -> Column:
    """A listing's own hours, else its venue's unless it has times of its own."""
    return F.coalesce(own, F.when(~timed, venue))


def needs_enrichment(current: Column, gave_up: Column, page_missing: Column, has_note: Column, more_text: Column) -> Column:
    """Neither done nor given up for these facts, and not waiting for the page of a listing that has a note."""
    return ~current & ~gave_up & ~(page_missing & has_note & more_text)


def embedding_text(*parts: Column) -> Column:
    """Lines of what is known of a listing; missing parts leave no line."""
    return F.concat_ws("\n", *[F.when(F.trim(p) != "", F.trim(p)) for p in parts])


def forced_targets(listings: DataFrame, overrides: DataFrame, links: DataFrame) -> DataFrame:
    """(source_id, listing, event): events that overrides force listings into, the oldest override first.

    overrides (override, source_a, listing_a, source_b, listing_b) hold both ways: one equi-join on both directions in place
    of a join on OR. links are (source_id, listing, event).
    """
    side = lambda a, b: overrides.select("override", F.col(f"source_{a}").alias("source_id"), F.col(f"listing_{a}").alias("listing"), F.col(f"source_{b}").alias("other_source"), F.col(f"listing_{b}").alias("other_listing"))
    other = links.select(F.col("source_id").alias("other_source"), F.col("listing").alias("other_listing"), "event")
    met = listings.select("source_id", "listing").join(side("a", "b").unionAll(side("b", "a")), ["source_id", "listing"]).join(other, ["other_source", "other_listing"])
    return met.groupBy("source_id", "listing").agg(F.min(F.struct("override", "event")).alias("first")).select("source_id", "listing", "first.event")


def orphans(events: DataFrame, links: DataFrame, id_col: str = "id") -> DataFrame:
    """The events that no source lists any more, to be deleted."""
    return events.join(links.select(id_col), id_col, "left_anti")


def others_listing(links: DataFrame, event: str, source: str) -> DataFrame:
    """links with others: how many other sources list the same event."""
    counts = links.groupBy(event).agg(F.count_distinct(source).alias("_n"))
    return links.join(counts, event).withColumn("others", F.col("_n") - 1).drop("_n")


def venue_points(listings: DataFrame, venues: DataFrame) -> DataFrame:
    """(id, lat, lng): own coordinates, else those of the venue with the listing's name, the lowest venue id first."""
    known = venues.filter(F.col("lat").isNotNull() & F.col("lng").isNotNull())
    first = known.groupBy(F.lower("name").alias("_name")).agg(F.min(F.struct("venue_id", F.col("lat").alias("_lat"), F.col("lng").alias("_lng"))).alias("_v"))
    own = F.col("lat").isNotNull() & F.col("lng").isNotNull()
    at = lambda c: F.when(own, F.col(c)).otherwise(F.col(f"_v._{c}")).alias(c)
    return listings.join(first, F.lower("venue") == F.col("_name"), "left").select("id", at("lat"), at("lng"))


def held_forms(forms: DataFrame) -> DataFrame:
    """One row: how many suggestions and how many messages are held, from (kind, held)."""
    of = lambda kind: F.count_if((F.col("kind") == kind) & F.col("held"))
    return forms.agg(of("suggestion").alias("suggestions"), of("contact").alias("messages"))


REDACTED = '{"redacted":"content policy"}'


def enforce_policy(listings: DataFrame, links: DataFrame, sources: DataFrame, excerpt: Column) -> tuple[DataFrame, DataFrame]:
    """Listings and links as the sources' terms allow.

    listings (id, description, image_url, image_source_id, thumbnail): an image goes if its source may not store it, a
    description if all of its sources forbid storing it, the rest is cut to `excerpt`; a thumbnail goes with its image.
    links (id, source_id, raw): raw goes where a source restricts either. A listing without links keeps its description.
    """
    may = sources.select("source_id", "store_description", "store_image")
    text = links.join(may, "source_id").groupBy("id").agg(F.bool_or("store_description").alias("_text"))
    image = may.select(F.col("source_id").alias("image_source_id"), F.col("store_image").alias("_image"))
    found = listings.join(text, "id", "left").join(image, "image_source_id", "left")
    shown = F.coalesce("_image", F.lit(True))
    kept = found.select(
        "id", F.when(F.coalesce("_text", F.lit(True)), excerpt).alias("description"), F.when(shown, F.col("image_url")).alias("image_url"),
        F.when(shown, F.col("image_source_id")).alias("image_source_id"), (F.col("thumbnail") & shown & F.col("image_url").isNotNull()).alias("thumbnail"),
    )
    free = F.col("store_description") & F.col("store_image")
    return kept, links.join(may, "source_id").select("id", "source_id", F.when(free, F.col("raw")).otherwise(F.lit(REDACTED)).alias("raw"))


def next_image_source(old_url: Column, old_source: Column, new_url: Column, stored_url: Column, source: Column) -> Column:
    """Whose image a listing shows after a source sent new_url and stored_url was kept: the source's if that is new or had no owner."""
    takes = new_url.isNotNull() & (stored_url == new_url) & (~stored_url.eqNullSafe(old_url) | old_source.isNull())
    return F.when(takes, source).otherwise(old_source)


#: Groups of boroughs by the areas that people ask for.
AREAS = {"central": ["westminster", "city-of-london", "lambeth", "southwark"], "east": ["city-of-london", "hackney", "tower-hamlets"], "kings-cross": ["camden", "islington"], "south-kensington": ["kensington-and-chelsea", "westminster"]}


def in_area(borough: Column, area: str) -> Column:
    """Lies in one of the boroughs of an area; an unknown area has none."""
    return F.coalesce(borough.isin(AREAS.get(area, [])), F.lit(False))


GROUNDING, MOST_ARTISTS, MOST_NAME = ["source_text", "general_knowledge", "none"], 10, 120


def answer_fault(answer: Column, facts: Column, allowed: dict[str, list[str]], most: dict[str, int]) -> Column:
    """What is wrong with a model's answer (id, tags by name, artists, grounding, confidence), or null.

    Tags must be allowed, different and no more than `most`; artists must occur in the facts that were sent.
    """
    plain = lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " ")
    held = F.concat(F.lit(" "), plain(facts), F.lit(" "))
    fault = F.when(answer.isNull() | answer["id"].isNull(), "no answer")
    for name, words in allowed.items():
        tags = answer[name]
        fault = fault.when(tags.isNull(), f"{name}: missing").when(F.size(tags) > most[name], f"{name}: too many").when(F.size(F.array_distinct(tags)) < F.size(tags), f"{name}: repeated")
        fault = fault.when(F.size(F.array_except(tags, F.array(*map(F.lit, words)))) > 0, f"{name}: not allowed")
    fault = fault.when(~F.coalesce(answer["grounding"].isin(GROUNDING), F.lit(False)), "grounding: not allowed").when(~F.coalesce(answer["confidence"].between(0, 1), F.lit(False)), "confidence: not between 0 and 1")
    names = F.transform(answer["artists"], lambda a: F.trim(a))
    fault = fault.when(F.size(names) > MOST_ARTISTS, "artists: too many").when(F.exists(names, lambda a: (a == "") | (F.length(a) > MOST_NAME)), "artists: empty or over-long name")
    return fault.when(F.exists(names, lambda a: ~F.contains(held, F.concat(F.lit(" "), F.trim(plain(a)), F.lit(" ")))), "artists: not in the input")
