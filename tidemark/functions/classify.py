"""Categories, venue types, music tags and memberships from keywords, first match first."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import key_words, mentions, padded_words, venue_key

#: Keywords of categories, in order.
CATEGORY_WORDS = {
    "workshop": ["workshop", "workshops", "masterclass", "class", "classes", "course", "hands on"],
    "talk": ["talk", "talks", "lecture", "lectures", "seminar", "symposium", "panel", "in conversation", "conversation", "discussion", "reading", "spoken word", "lecture seminar"],
    "expo": ["expo", "expos", "fair", "fairs", "convention", "trade show", "exposition"],
    "exhibition": ["exhibition", "exhibitions", "fine art", "installation", "display", "retrospective"],
    "community": ["community", "meetup", "meet up", "networking", "creativemornings", "writing group", "social", "club", "civic"],
}

#: Keywords of music tags, in order.
MUSIC_WORDS = {
    "classical": ["classical", "orchestra", "orchestral", "symphony", "symphonic", "philharmonic", "sinfonia", "concerto", "string quartet", "piano trio", "chamber music", "chamber orchestra", "recital", "baroque", "opera", "choral", "choir", "oratorio", "requiem", "sonata", "organ recital", "early music"],
    "contemporary": ["contemporary", "contemporary music", "new music", "contemporary classical", "modern composition", "world premiere", "uk premiere", "london premiere"],
    "experimental": ["experimental", "avant garde", "noise", "drone", "electroacoustic", "musique concrete", "free improvisation", "improvised music", "modular synth"],
    "jazz": ["jazz", "bebop", "big band", "swing", "improv", "free jazz"],
    "sound_art": ["sound art", "sound_art", "sound installation", "sound walk", "soundwalk", "sonic art", "field recording", "field recordings", "deep listening", "listening session"],
}

#: Words in a venue's name, in order, and the names of memberships.
VENUE_WORDS = [("project space", "artist_run"), ("artist-run", "artist_run"), ("artist run", "artist_run"), ("artist-led", "artist_run"), ("studios", "artist_run"), ("museum", "museum"), ("community", "community"), ("library", "community"), ("arts centre", "community")]
MEMBERSHIP_NAMES = {"art_pass": ["national art pass", "art pass"]}


def category(*hints: Column) -> Column:
    """The category of the first hint that names one; null where none does."""
    found = []
    for hint in hints:
        words = F.concat(F.lit(" "), F.array_join(key_words(hint), " "), F.lit(" "))
        found += [F.when(mentions(words, keywords), name) for name, keywords in CATEGORY_WORDS.items()]
    return F.coalesce(*found)


def any_mentions(texts: Column, phrases: list[str]) -> Column:
    return F.exists(texts, lambda t: mentions(t, phrases))


def offer_of(offers: Column, key: str) -> Column:
    return F.get(F.filter(offers, lambda o: o["membership"] == key), F.lit(0))["offer"]


def music_tags(category: Column, tags: Column, title: Column) -> Column:
    """Tags in the vocabulary's order; none but for music."""
    hay = F.transform(F.concat(tags, F.array(title)), padded_words)
    found = F.array(*[F.when(any_mentions(hay, words), name) for name, words in MUSIC_WORDS.items()])
    return F.when(category == "music", F.filter(found, lambda t: t.isNotNull())).otherwise(F.array().cast("array<string>"))


def venue_type_from_name(name: Column) -> Column:
    padded = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}-]+", " ")), F.lit(" "))
    return F.coalesce(*[F.when(F.contains(padded, F.lit(f" {word} ")), kind) for word, kind in VENUE_WORDS])


def venue_type(name: Column, override: Column, source_default: Column) -> Column:
    """Override of the venue, else its sources' default, else what its name says, else other."""
    named = F.trim(F.coalesce(name, F.lit(""))) != ""
    return F.coalesce(F.when(named, override), source_default, F.when(named, venue_type_from_name(name)), F.lit("other"))


def override_key(name: Column) -> Column:
    return venue_key(name)


def memberships(offers: Column, tags: Column, text: Column) -> Column:
    """(membership, offer) for each that the venue offers or the text names; the offer is null if only named."""
    hay = F.transform(F.concat(tags, F.filter(F.array(text), lambda t: t.isNotNull())), padded_words)
    found = []
    for key, names in MEMBERSHIP_NAMES.items():
        offer = offer_of(offers, key)
        named = any_mentions(hay, names)
        found.append(F.when(offer.isNotNull(), F.struct(F.lit(key).alias("membership"), offer.alias("offer"))).when(named, F.struct(F.lit(key).alias("membership"), F.lit(None).cast("string").alias("offer"))))
    return F.filter(F.array(*found), lambda m: m.isNotNull())
