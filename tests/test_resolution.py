"""Target selection of listings, merged events, and full-text search on small cases."""

import datetime as dt
import math
import random
import time
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import share, text, timex
from tidemark.operators import dims, quality, resolve, search


def row(i, source, key=None, linked=None, tokens="jazz night"):
    return {"id": i, "source": source, "key": key or f"k{i}", "tokens": tokens, "linked": linked}


def steps(rows, near=(), never=(), force=()):
    met = {}
    for a, b in near:
        met.setdefault(a, set()).add(b)
        met.setdefault(b, set()).add(a)
    return [(i, e, step) for i, e, step in resolve.replay_listings(rows, met, {frozenset(p) for p in never}, {frozenset(p) for p in force})]


def test_steps_of_target_selection():
    assert steps([row(1, "a"), row(2, "b")]) == [(1, 1, "created"), (2, 2, "created")]
    assert steps([row(1, "a", "k"), row(2, "b", "k")]) == [(1, 1, "created"), (2, 1, "same key")]
    assert steps([row(1, "a"), row(2, "b")], near=[(1, 2)]) == [(1, 1, "created"), (2, 1, "matched")]
    assert steps([row(1, "a"), row(2, "a")], near=[(1, 2)]) == [(1, 1, "created"), (2, 2, "created")]  # one listing of a source an event
    assert steps([row(1, "a", linked=1)]) == [(1, 1, "refreshed")]
    assert steps([row(1, "a"), row(2, "b")], force=[(1, 2)]) == [(1, 1, "created"), (2, 1, "forced")]
    # a shared link stays only while it matches; else the listing founds its own event
    assert steps([row(1, "a", linked=1), row(2, "b", linked=1)], near=[(1, 2)])[1] == (2, 1, "stays")
    assert steps([row(1, "a", linked=1), row(2, "b", linked=1)])[1] == (2, 2, "created")


def test_forbidden_events_keep_apart():
    found = steps([row(1, "a", "k"), row(2, "b", "k"), row(3, "c", "k")], near=[(1, 2)], never=[(1, 2)])
    assert found[:2] == [(1, 1, "created"), (2, 2, "created")] and found[2] == (3, 1, "same key")
    parted = steps([row(1, "a", linked=1), row(2, "b", linked=1)], never=[(1, 2)])
    assert parted[0][1] != parted[1][1]


def test_best_match_is_by_letter_pairs_then_age():
    rows = [row(1, "a", tokens="jazz night"), row(2, "b", tokens="jazz nights"), row(3, "c", tokens="jazz nights")]
    assert steps(rows, near=[(1, 3), (2, 3)])[2] == (3, 2, "matched")
    rows[1]["tokens"] = rows[0]["tokens"]
    assert steps(rows, near=[(1, 3), (2, 3)])[2] == (3, 1, "matched")


def test_a_large_component_is_replayed_in_time():
    """12,000 listings of three sources in a row, each near the 20 before and after it: no step looks at all events."""
    n = 12_000
    rows = [row(i, "abc"[i * 3 // n]) for i in range(n)]
    near = {i: [j for d in range(1, 21) for j in ((i * 3 % n + i * 3 // n + d) % n,)] for i in range(n)}
    began = time.monotonic()
    found = resolve.replay_listings(rows, near, set(), set())
    assert time.monotonic() - began < 10 and len(found) == n
    assert {step for _, _, step in found} == {"created", "matched"}


def test_components_of_thinned_edges(spark, monkeypatch):
    pairs = [(n, n + 7) for n in range(0, 900)] + [(5000, n) for n in range(5001, 5040)] + [(5001, 5002)]
    edges = spark.createDataFrame(pairs, "a long, b long").repartition(5)
    want = {n: n % 7 for n in range(907)} | {n: 5000 for n in range(5000, 5040)}
    for most in (resolve.ONE_TASK, 10):
        monkeypatch.setattr(resolve, "ONE_TASK", most)
        assert {r.node: r.component for r in resolve.named_components(edges).collect()} == want


LISTED = "listing long, source string, title string, venue string, lat double, lng double, starts_at timestamp, ends_at timestamp"


def by_brute_force(rows):
    """Events by all pairs of listings (listing, source, title, venue, lat, lng, starts_at, ends_at; titles and venues in small letters)."""
    split = lambda t: (t or "").split()
    key_of = lambda words, stop: "-".join(w for w in words if w not in stop)
    read = {}
    for i, source, title, venue, lat, lng, start, end in rows:
        first = start and start.date()
        v = key_of(split(venue), text.VENUE_STOP) or "unknown"
        parts = [None if title is None else key_of(split(title), text.TITLE_STOP), first and str(first), v]
        read[i] = dict(id=i, source=source, title=split(title), venue=split(venue), v=v, at=None if lat is None or lng is None else (math.radians(lat), math.radians(lng)), first=first, last=first and max(first, (end or start).date()), key="|".join(p for p in parts if p is not None), linked=None)
    near = {}

    def metres(p, q):
        h = math.sin((q[0] - p[0]) / 2) ** 2 + math.cos(p[0]) * math.cos(q[0]) * math.sin((q[1] - p[1]) / 2) ** 2
        return 2 * 6_371_000 * math.asin(min(1, math.sqrt(h)))

    for a, b in combinations(read.values(), 2):
        if a["first"] is None or b["first"] is None or not (a["first"] == b["first"] or (a["last"] > a["first"] and b["last"] > b["first"] and a["first"] <= b["last"] and b["first"] <= a["last"])):
            continue
        x, y = {*a["v"].split("-")}, {*b["v"].split("-")}
        venues = "unknown" not in (a["v"], b["v"]) and (a["v"] == b["v"] or (min(len(x), len(y)) >= 2 and (x <= y or y <= x)))
        if (venues or (a["at"] and b["at"] and metres(a["at"], b["at"]) <= 150)) and resolve.titles_match(*[resolve.title_tokens(r["title"], a["venue"], b["venue"]) for r in (a, b)]):
            near.setdefault(a["id"], set()).add(b["id"])
            near.setdefault(b["id"], set()).add(a["id"])
    for r in read.values():
        r["tokens"] = " ".join(resolve.title_tokens(r["title"], r["venue"]))
    return sorted(resolve.replay_listings([*read.values()], near, set(), set()))


def odd_listings(seed, n):
    """Listings of few names, places and days: keys that many share, in other places and with other ends."""
    rng = random.Random(seed)
    titles = ["jazz night", "jazz nights", "jazz night barbican", "barbican", "the jazz night", "old bolt", "cold bolt", "barbican centre", "red house garden party", "garden party", "party", "tickets", "", None, "2020-01-01", "a b c d", "a b c d e", "tate modern red house garden barbican arts", "tate modern red house garden barbican"]
    venues = ["barbican centre", "barbican arts", "barbican arts centre", "tate modern", "tate modern gallery", "red house garden", "red house", "hall", "", None, "jazz cafe"]
    places = [(51.5, -0.1), (51.501, -0.1), (51.502, -0.1), (51.5, -0.098), (51.6, 0.1), (None, 0.1), (51.5, None), (None, None), (0.0, 180.0), (0.0, -179.999)]
    rows = []
    for i in range(n):
        day = dt.datetime(2020, 1, 1, 12) + dt.timedelta(rng.choice([0, 0, 1, 2, 3, 9, 30]))
        start = None if rng.random() < 0.05 else day
        end = rng.choice([None, day, day + dt.timedelta(rng.randrange(12)), day - dt.timedelta(2)])
        rows.append((i * 7 % 1009, rng.choice("abcd" if seed % 2 else "a" * 9 + "b"), rng.choice(titles[: 3 + seed * 3]), rng.choice(venues[: 2 + seed * 2]), *rng.choice(places[: 2 + seed * 2]), start, end))
    return rows


@pytest.mark.parametrize("seed", range(1, 7))
def test_events_by_key_are_those_of_all_pairs(spark, monkeypatch, seed):
    """Without links and overrides no pairs of listings are made, which grow with the square of a key's listings."""
    rows = odd_listings(seed, 400)
    frame = spark.createDataFrame(rows, LISTED)
    found = lambda: sorted((r.listing, r.event, r.step) for r in resolve.resolve_events(frame, steps=True).collect())
    want = by_brute_force(rows)
    with monkeypatch.context() as m:
        m.setattr(resolve, "fuzzy_pairs", None)
        assert found() == want
    assert len({step for _, _, step in want}) == 3
    if seed == 6:  # with many titles by pairs
        monkeypatch.setattr(resolve, "FEW_TITLES", 0)
        assert found() == want


def test_no_listings_and_one(spark):
    assert resolve.resolve_events(spark.createDataFrame([], LISTED)).collect() == []
    one = spark.createDataFrame([(5, "a", None, None, None, None, None, None)], LISTED)
    assert [tuple(r) for r in resolve.resolve_events(one, steps=True).collect()] == [(5, 5, "created")]


def test_copies_of_keys_are_replayed_in_time():
    """300,000 listings of 1,000 keys that all match: each key's founder and the few that look for it are looked at, not all pairs."""
    n, keys = 300_000, 1_000
    match = resolve.Matches([(0, ["jazz"], ["hall"], "x")], [(0, 0)])
    codes, sources = np.arange(n) % keys, np.arange(n) * 3 // n
    began = time.monotonic()
    event, step = resolve.replay_keys(codes, sources, [0] * n, [0] * n, (codes % 50).tolist(), (codes % 50 + 9).tolist(), match)
    assert time.monotonic() - began < 20 and (event >= 0).all() and (step[:keys] == 0).all() and (event % keys == codes).all()


def test_earlier_links_and_orphans(spark):
    schema = "listing long, source string, title string, venue string, lat double, lng double, starts_at timestamp, ends_at timestamp"
    at = lambda x: F.lit(x).cast("timestamp")
    rows = [(1, "a", "Jazz night", "Hall", None, None), (2, "b", "Jazz Night!", "Hall", None, None), (3, "c", "Painting", "Room", None, None)]
    frame = spark.createDataFrame([(*r, None, None) for r in rows], schema).withColumn("starts_at", at("2026-10-02 19:00:00"))
    links = spark.createDataFrame([(1, 1), (3, 3)], "listing long, event long")
    got = {r.listing: (r.event, r.step) for r in resolve.resolve_events(frame, links=links, steps=True).collect()}
    assert got == {1: (1, "refreshed"), 2: (1, "same key"), 3: (3, "refreshed")}
    events = spark.createDataFrame([(1,), (2,)], "id long")
    assert [r.id for r in dims.orphans(events, links.select(F.col("event").alias("id"))).collect()] == [2]


def indexed(spark, titles):
    df = spark.createDataFrame(list(enumerate(titles)), "id int, title string")
    return search.index(df, "id", {"A": F.col("title")}).cache(), df


def test_negation_phrases_and_stop_words(spark):
    rows, ids = indexed(spark, ["Jazz night", "Painting class", "Painting in the class"])
    found = lambda q: {r.id for r in search.websearch(rows, "id", q, ids).collect()}
    assert found("-class") == {0}
    assert found('"painting class"') == {1} and found('"painting in the class"') == {2}
    assert found("jazz or -painting") == {0} and found("painting -night") == {1, 2} and found("") == set() == found("the")


def test_rank_of_words_and_of_any(spark):
    rows, _ = indexed(spark, ["jazz night jazz", "night of jazz", "night"])
    both = {r.id: r["rank"] for r in search.rank(rows, "id", "jazz night").collect()}
    near = lambda d: 1 / (1.005 + 0.05 * math.exp(d / 1.5 - 2))
    assert abs(both[0] - (1 - (1 - math.sqrt(near(1))) ** 2)) < 1e-9 and abs(both[1] - math.sqrt(near(2))) < 1e-9 and both[2] == 1e-20
    either = {r.id: r["rank"] for r in search.rank(rows, "id", "jazz or night").collect()}
    assert abs(either[2] - 1 / 1.64493406685 / 2) < 1e-9 and either[0] > either[1] > either[2]


def test_small_record_functions(spark):
    df = spark.createDataFrame([("WWW.Barbican.org.uk.",), ("app.ticketmaster.com",), ("localhost",), ("co.uk",), (None,)], "h string")
    assert [r[0] for r in df.select(text.registrable_domain(F.col("h"))).collect()] == ["barbican.org.uk", "ticketmaster.com", None, None, None]
    raw = spark.createDataFrame([('{"a":"' + "word " * 200 + '","b":["' + "x" * 500 + '",1,null]}',), ("broken",), (None,)], "p string")
    cut = [r[0] for r in raw.select(text.excerpt_raw(F.col("p"))).collect()]
    assert len(cut[0]) < 900 and "x" * 500 in cut[0] and cut[1:] == [None, None]
    days = spark.range(1).select(*[F.array_join(F.transform(F.array(*timex.weekend(F.lit(d).cast("date"))), lambda x: x.cast("string")), "/") for d in ["2026-09-23", "2026-09-26", "2026-09-27"]]).first()
    assert tuple(days) == ("2026-09-26/2026-09-27", "2026-09-26/2026-09-27", "2026-09-27/2026-09-27")
    links = spark.range(1).select(share.map_links(F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit("A"), share.location(F.lit(" Hall "), F.lit("")))["google_view"]).first()[0]
    assert links == "https://www.google.com/maps/search/?api=1&query=Hall"


def test_same_date_needs_five(spark):
    rows = [(1, "2026-10-02 10:00:00")] * 4 + [(2, "2026-10-02 10:00:00")] * 5 + [(3, "2026-10-02 10:00:00")] * 5 + [(3, "2026-10-03 10:00:00")]
    df = spark.createDataFrame(rows, "k int, s string").select("k", F.col("s").cast("timestamp").alias("starts_at"))
    assert [tuple(r) for r in quality.same_date(df, "k").collect()] == [(2, 5)]
