"""Text folding, keys, keywords and excerpts as Column expressions.

Three foldings are kept apart: for keys (`key_words`), for search and slugs (`search_fold`), for keywords (`padded_words`).
"""

from __future__ import annotations

import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The folding of keys; apostrophes go.
KEY_FROM, KEY_TO = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿ’'", "aaaaaaceeeeiiiinoooooouuuuyy"

#: Letters of search folding without an ASCII letter below their mark, and pairs of letters.
FOLD_OTHERS = {"đ": "d", "Đ": "d", "ħ": "h", "Ħ": "h", "ı": "i", "ŀ": "l", "Ŀ": "l", "ł": "l", "Ł": "l", "ð": "d", "Ð": "d", "ø": "o", "Ø": "o", "ʼ": "'", "’": "'", "‘": "'"}
FOLD_PAIRS = {"ß": "ss", "ẞ": "ss", "æ": "ae", "Æ": "ae", "œ": "oe", "Œ": "oe", "þ": "th", "Þ": "th"}

#: Words that keys and title matching leave out.
TITLE_STOP = ["the", "a", "an", "and"]
VENUE_STOP = [*TITLE_STOP, "london", "gallery", "galleries", "centre", "center", "museum", "theatre", "theater", "hall"]

EXCERPT, EXCERPT_SENTENCE = 300, 80


def fold_table() -> tuple[str, str]:
    """Accented Latin letters and the ASCII letters they fold to, by decomposition."""
    letters = {chr(c): unicodedata.normalize("NFD", chr(c))[0].lower() for c in [*range(0xC0, 0x180), *range(0x218, 0x21C)]}
    table = {k: v for k, v in letters.items() if v.isascii() and v.isalpha() and k not in FOLD_PAIRS} | FOLD_OTHERS
    return "".join(table), "".join(table.values())


FOLD_FROM, FOLD_TO = fold_table()


def search_fold(text: Column) -> Column:
    for letter, pair in FOLD_PAIRS.items():
        text = F.replace(text, F.lit(letter), F.lit(pair))
    return F.lower(F.translate(text, FOLD_FROM, FOLD_TO))


def tokens(text: Column, most: int = 12) -> Column:
    """The first words [a-z0-9]+ of the folded text."""
    return F.slice(F.filter(F.split(search_fold(text), "[^a-z0-9]+"), lambda w: w != ""), 1, most)


def key_words(text: Column) -> Column:
    folded = F.translate(F.lower(text), KEY_FROM, KEY_TO)
    return F.filter(F.split(folded, r"[^\p{L}\p{N}]+"), lambda w: w != "")


def key_part(text: Column, stop: list[str]) -> Column:
    return F.array_join(F.filter(key_words(text), lambda w: ~w.isin(stop)), "-")


def title_key(title: Column) -> Column:
    return key_part(title, TITLE_STOP)


def venue_key(venue: Column) -> Column:
    key = F.coalesce(key_part(venue, VENUE_STOP), F.lit(""))
    return F.when(key == "", "unknown").otherwise(key)


def dedupe_key(title: Column, day: Column, venue: Column) -> Column:
    return F.concat_ws("|", title_key(title), F.date_format(day, "yyyy-MM-dd"), venue_key(venue))


def padded_words(text: Column) -> Column:
    """Words between single spaces, with one at either end, so that contains(' word ') finds whole words."""
    plain = F.translate(F.lower(text), "éèê", "eee")
    return F.concat(F.lit(" "), F.ltrim(F.concat(F.trim(F.regexp_replace(plain, r"[^\p{L}\p{N}_]+", " ")), F.lit(" "))))


def mentions(text: Column, phrases: list[str]) -> Column:
    """Some phrase stands in the padded text."""
    out = F.lit(False)
    for phrase in phrases:
        out = out | F.contains(text, F.lit(f" {phrase} "))
    return out


def slug(text: Column) -> Column:
    return F.trim(F.regexp_replace(search_fold(text), "[^a-z0-9]+", "-"), F.lit("-"))


def display_name(key: Column) -> Column:
    words = F.filter(F.split(key, "[-_]"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w)))), " ")


def excerpt(text: Column) -> Column:
    """At most 300 characters: up to the last whole sentence, else the last word, else cut."""
    whole = F.trim(text)
    sentence = F.regexp_extract(whole, r"(?s)^(.{79,297}(?:[.!?…](?=\s)|[。！？]))", 1)
    head = F.substring(whole, 1, EXCERPT - 1)
    words = F.regexp_extract(head, r"(?s)^(.+)\s\S*$", 1)
    head = F.regexp_replace(F.when(words == "", head).otherwise(words), r"[\s,;:\-–—]+$", "")
    return F.when(F.length(whole) <= EXCERPT, whole).when(sentence != "", F.concat(sentence, F.lit(" …"))).otherwise(F.concat(head, F.lit("…")))


def last_postcode(text: Column) -> Column:
    """The last full UK postcode, in capitals."""
    found = F.regexp_extract_all(F.upper(text), F.lit(r"\b([A-Z]{1,2}[0-9][A-Z0-9]? ?[0-9][A-Z]{2})\b"), 1)
    return F.try_element_at(found, F.lit(-1))


def hype_word(text: Column, banned: list[str]) -> Column:
    """The first banned word or phrase, in the list's order, that the text has."""
    plain = padded_words(F.translate(text, "’‘“”–—", "''\"\"--"))
    return F.coalesce(*[F.when(F.contains(plain, F.lit(f" {w} ")), w) for w in banned])


def late_opening(text: Column) -> Column:
    """Says "late opening", or is open until a clock time after 18:00."""
    lower = F.lower(text)
    at = r"opens? until ([0-9]{1,2})(?:[:.]([0-9]{2}))? *(pm|p\.m\.|am|a\.m\.)?"
    part = lambda n: F.regexp_extract_all(lower, F.lit(at), n)
    times = F.arrays_zip(part(1).alias("h"), part(2).alias("m"), part(3).alias("s"))

    def is_late(t: Column) -> Column:
        known = (t["m"] != "") | (t["s"] != "")
        hour = t["h"].cast("int") + F.when(t["s"].startswith("p") & (t["h"].cast("int") < 12), 12).otherwise(0)
        minute = F.when(t["m"] == "", 0).otherwise(t["m"].cast("int"))
        return known & (hour < 24) & (minute < 60) & (hour * 60 + minute > 18 * 60)

    return F.coalesce(F.contains(lower, F.lit("late opening")) | F.exists(times, is_late), F.lit(False))


def outward_postcode(text: Column) -> Column:
    """The outward part, in capitals, of the first UK postcode written in two parts."""
    found = F.regexp_extract(text, r"(?:^|[\s,])([A-Za-z](?=[A-Za-z]{0,3}[0-9])[A-Za-z0-9]{1,3})[\s,]+[0-9][A-Za-z]{2}(?:$|[\s,])", 1)
    return F.when(found != "", F.upper(found))


#: Phrases that name presentations away from a gallery.
OFFSITE = ["art fair", "biennale", "biennial", "frieze", "1-54", "pad london", "armory show", "art basel", "design miami", "lapada", "tefaf", "international art exhibition", "institutional exhibition"]


def is_offsite(text: Column) -> Column:
    """Names a fair or the like, or a booth or stand followed by a word with a digit."""
    lower = F.lower(text)
    stand = lower.rlike(r"(^|[\s,|])(booth|stands?)[\s,|]+[^\s,|]*[0-9]")
    return F.coalesce(lower.rlike("|".join(OFFSITE)) | stand, F.lit(False))


def cut_text(text: str) -> str:
    """excerpt() of a Python string."""
    whole = text.strip(" ")
    if len(whole) <= EXCERPT:
        return whole
    if sentence := re.match(r"(?s)(.{79,297}(?:[.!?…](?=[ \t\n\v\f\r])|[。！？]))", whole):
        return sentence[1] + " …"
    words = re.match(r"(?s)(.+)[ \t\n\v\f\r][^ \t\n\v\f\r]*$", head := whole[: EXCERPT - 1])
    return re.sub(r"[ \t\n\v\f\r,;:\-–—]+$", "", words[1] if words else head) + "…"


def _cut_all(value: object) -> object:
    if isinstance(value, dict):
        return {k: _cut_all(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_cut_all(v) for v in value]
    return cut_text(value) if isinstance(value, str) and len(value) > EXCERPT and re.search(r"\s", value) else value


def excerpt_raw(payload: Column) -> Column:
    """A JSON payload whose long texts, at any depth, are cut by excerpt(); long strings without white space stay.

    Payloads have no known shape, so this walks them in Python, in Arrow batches. Null and broken JSON becomes null.
    """

    @F.pandas_udf("string")
    def run(payloads: pd.Series) -> pd.Series:
        out = []
        for x in payloads:
            try:
                out.append(None if x is None else json.dumps(_cut_all(json.loads(x)), ensure_ascii=False, separators=(",", ":")))
            except ValueError:
                out.append(None)
        return pd.Series(out, dtype=object)

    return run(payload)


#: Public suffixes that are known where no longer list is given.
SUFFIXES = ["com", "org", "net", "edu", "gov", "info", "io", "art", "gallery", "museum", "london", "uk", "co.uk", "org.uk", "ac.uk", "gov.uk", "eu", "de", "fr", "es", "ie", "it"]


def registrable_domain(host: Column, suffixes: list[str] | None = None) -> Column:
    """The label before the longest known public suffix, with it; null for a bare suffix and for hosts without a known one."""
    labels = F.split(F.regexp_replace(F.lower(host), r"\.+$", ""), r"\.")
    known = F.array(*map(F.lit, suffixes or SUFFIXES))
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.array_join(F.slice(labels, n, F.size(labels)), "."))
    first = F.array_position(F.transform(ends, lambda e: F.array_contains(known, e)), True)
    return F.when(first > 1, F.get(ends, (first - 2).cast("int")))
