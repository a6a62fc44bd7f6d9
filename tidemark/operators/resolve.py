"""Entity resolution of listings: keys, match rule, merge and refresh, and the replay of a component."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable
from heapq import heappop, heappush
from itertools import combinations, count, permutations, product

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import geo
from tidemark.functions.text import TITLE_STOP, key_words, venue_key
from tidemark.functions.timex import london_date
from tidemark.operators.components import components, cut

#: Words that sources add to titles.
TITLE_NOISE = ["exhibition", "exhibitions", "ticket", "tickets", "london"]
YEAR = re.compile("(19|20)[0-9]{2}")
DICE, VENUE_METRES = 0.9, 150.0


def bigrams(text: str) -> list[str]:
    plain = text.replace(" ", "")
    return [plain[i : i + 2] for i in range(len(plain) - 1)]


def dice(a: str, b: str) -> float:
    """Share of common letter pairs, spaces apart; equal texts score 1."""
    x, y = bigrams(a), bigrams(b)
    return 1.0 if a == b else 2 * sum(min(x.count(g), y.count(g)) for g in set(x)) / max(1, len(x) + len(y))


def title_tokens(title: list[str], *venues: list[str]) -> list[str]:
    """Title words without stop words, noise, years and the venues' words; with the latter if nothing else is left."""
    kept = [w for w in title if w not in TITLE_STOP and w not in TITLE_NOISE and not YEAR.fullmatch(w)]
    other = [w for w in kept if not any(w in v for v in venues)]
    return other or kept


def titles_match(a: list[str], b: list[str]) -> bool:
    """Of tokens: at least 4/5 of all tokens in common, or letter pairs that alike."""
    common, every = len({*a} & {*b}), len({*a} | {*b})
    return bool(a) and bool(b) and (5 * common >= 4 * every or dice(" ".join(a), " ".join(b)) >= DICE)


def plain_words(title: Column) -> Column:
    """The first step of title_tokens(), for a word array."""
    return F.filter(title, lambda w: ~w.isin(TITLE_STOP + TITLE_NOISE) & ~w.rlike(f"^{YEAR.pattern}$"))


def shown_tokens(plain: Column, *venues: Column) -> Column:
    """title_tokens() of plain_words() and word arrays of venues, with single spaces between."""
    other = F.filter(plain, lambda w: ~F.array_contains(F.concat(*venues), w))
    return F.array_join(F.when(F.size(other) > 0, other).otherwise(plain), " ")


def titles_alike(a: Column, b: Column) -> Column:
    """titles_match() of two columns of shown_tokens(), in Arrow batches: letter pairs are beyond cheap expressions."""

    @F.pandas_udf("boolean")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([titles_match(x.split(), y.split()) for x, y in zip(a, b)], dtype=bool)

    return run(a, b)


def could_match(a: Column, b: Column) -> Column:
    """False for no shown_tokens() that titles_match() accepts: enough words in common, or lengths that allow enough letter pairs."""
    x, y = F.split(a, " "), F.split(b, " ")
    pairs = lambda c: F.greatest(F.length(F.replace(c, F.lit(" "), F.lit(""))) - 1, F.lit(0))
    return (5 * F.size(F.array_intersect(x, y)) >= 4 * F.size(F.array_union(x, y))) | (20 * F.least(pairs(a), pairs(b)) >= 9 * (pairs(a) + pairs(b)))


def dates_match(a_first: Column, a_last: Column, b_first: Column, b_last: Column) -> Column:
    return (a_first == b_first) | ((a_last > a_first) & (b_last > b_first) & (a_first <= b_last) & (b_first <= a_last))


def venues_match(a: Column, b: Column) -> Column:
    """Of venue keys: equal, or the words of one, two at least, within the other's."""
    x, y = F.array_distinct(F.split(a, "-")), F.array_distinct(F.split(b, "-"))
    inside = lambda s, l: (F.size(s) >= 2) & (F.size(F.array_except(s, l)) == 0)
    subset = F.when(F.size(x) <= F.size(y), inside(x, y)).otherwise(inside(y, x))
    return (a != "unknown") & (b != "unknown") & ((a == b) | subset)


def close(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    return F.coalesce(geo.distance(lat1, lng1, lat2, lng2, geo.MATCH_RADIUS_M) <= VENUE_METRES, F.lit(False))


def venue_pairs(venues: DataFrame) -> DataFrame:
    """(va, vb), both ways: venue keys that match, each with itself; two others share two words, on which they are joined."""
    venues = venues.select("v").filter("v <> 'unknown'").distinct()
    words = F.array_sort(F.array_distinct(F.split("v", "-")))
    two = F.flatten(F.transform(words, lambda x: F.transform(F.filter(words, lambda y: y > x), lambda y: F.concat_ws("|", x, y))))
    blocks = venues.select("v", F.explode(two).alias("w"))
    met = blocks.withColumnRenamed("v", "va").join(blocks.withColumnRenamed("v", "vb"), "w").filter("va <> vb").select("va", "vb").distinct()
    return met.filter(venues_match(F.col("va"), F.col("vb"))).unionAll(venues.select(F.col("v").alias("va"), F.col("v").alias("vb")))


#: Tables of at most so many rows are broadcast; venues with at most so many pairs of names are compared without regard to dates.
SMALL, WHOLE = 1 << 17, 1 << 18
#: Edge of the cubes, in metres, that places are sorted into; more than VENUE_METRES.
CUBE = 160.0


def small(df: DataFrame) -> DataFrame:
    """df, which is cheap to read, broadcast if it is small."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def near_places(placed: DataFrame) -> DataFrame:
    """(lat, lng, b_lat, b_lng), both ways: places that are close, each with itself; cubes on the globe hold everywhere."""
    at = placed.select("lat", "lng").distinct()
    lat, lng = F.radians("lat"), F.radians("lng")
    x, y, z = [F.floor(c * geo.MATCH_RADIUS_M / CUBE) for c in (F.cos(lat) * F.cos(lng), F.cos(lat) * F.sin(lng), F.sin(lat))]
    steps = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]
    around = at.select(F.col("lat").alias("b_lat"), F.col("lng").alias("b_lng"), F.explode(F.array(*[F.struct((x + i).alias("x"), (y + j).alias("y"), (z + k).alias("z")) for i, j, k in steps])).alias("cube"))
    met = at.select("lat", "lng", F.struct(x.alias("x"), y.alias("y"), z.alias("z")).alias("cube")).join(around, "cube")
    return met.filter(close(F.col("lat"), F.col("lng"), F.col("b_lat"), F.col("b_lng"))).select("lat", "lng", "b_lat", "b_lng")


def alike_names(pairs: DataFrame, names: DataFrame) -> DataFrame:
    """Those of pairs (sa, sb) of names (s, plain, words) whose titles match; two different lists of tokens are compared once."""
    of = lambda p: names.select(F.col("s").alias("s" + p), F.col("plain").alias("plain_" + p), F.col("words").alias("words_" + p))
    met = pairs.join(of("a"), "sa").join(of("b"), "sb")
    tokens = lambda p: shown_tokens(F.col("plain_" + p), F.col("words_a"), F.col("words_b"))
    met = met.select("sa", "sb", tokens("a").alias("x"), tokens("b").alias("y")).filter("x <> '' AND y <> ''").select("sa", "sb", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    unequal = met.filter("x <> y")
    alike = unequal.select("x", "y").distinct().filter(could_match(F.col("x"), F.col("y"))).filter(titles_alike(F.col("x"), F.col("y")))
    return met.filter("x = y").select("sa", "sb").unionAll(unequal.join(alike, ["x", "y"], "left_semi").select("sa", "sb"))


def fuzzy_pairs(df: DataFrame) -> DataFrame:
    """(a, b) with a < b of listings (id, title, venue, lat, lng, starts_at, ends_at) that match.

    A name is a title at a venue. Names whose venues and titles match are found first, at venues with many names among those
    of one week only, so that listings meet on equal keys: the other's name and a day block, which is the first day, or each
    week of the earlier of two runs and the first of the later. Near places are found first as well; listings meet there by
    place and day block, and their titles are compared once for each two different ones. A pair counts in one block.
    """
    none = F.array().cast("array<string>")
    first, last = london_date(F.col("starts_at")), london_date(F.coalesce("ends_at", "starts_at"))
    week = lambda d: F.floor(F.datediff(d, F.lit("1970-01-05").cast("date")) / 7).cast("int")
    words = lambda c: F.array_join(F.coalesce(key_words(F.col(c)), none), " ")
    shown = F.concat(words("title"), F.lit("|"), words("venue"))
    listed = cut(df.select("id", "lat", "lng", first.alias("first"), F.greatest(first, last).alias("last"), venue_key(F.col("venue")).alias("v"), shown.alias("shown")))
    part = lambda n: F.filter(F.split(F.split("shown", r"\|")[n], " "), lambda w: w != "")
    names = listed.select("shown", "v").distinct().withColumn("s", F.monotonically_increasing_id())
    names = cut(names)
    venues = cut(names.filter("v <> 'unknown'").groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("g")))
    names = small(cut(names.join(venues, "v", "left").select("shown", "v", "s", "n", "g", plain_words(part(0)).alias("plain"), part(1).alias("words"))))
    rows = listed.drop("v").join(names.select("shown", "s", "g"), "shown").drop("shown")

    sized = lambda p: venues.select(F.col("v").alias("v" + p), F.col("n").alias("n" + p), F.col("g").alias("g" + p))
    met = cut(venue_pairs(venues).join(sized("a"), "va").join(sized("b"), "vb").select("ga", "gb", (F.col("na") * F.col("nb") <= WHOLE).alias("whole")))
    named = lambda frame, p, *more: frame.select(F.col("g").alias("g" + p), F.col("s").alias("s" + p), *more)
    shared = named(names, "a").join(met.filter("whole"), "ga").join(named(names, "b"), "gb").filter("sa <= sb").select("sa", "sb")
    many = met.filter("NOT whole")
    if not many.isEmpty():
        starts = named(rows.withColumn("w", week(F.col("first"))), "b", "w").distinct()
        spans = named(rows.withColumn("w", F.explode(F.sequence(week(F.col("first")), week(F.col("last"))))), "a", "w").distinct()
        shared = shared.unionAll(spans.join(many, "ga").join(starts, ["gb", "w"]).select(F.least("sa", "sb").alias("sa"), F.greatest("sa", "sb").alias("sb")).distinct())
    alike = cut(alike_names(cut(shared), names))
    alike = small(cut(alike.unionAll(alike.filter("sa <> sb").select("sb", "sa"))))

    day_block, week_block = 2 * F.datediff("first", F.lit("1970-01-01").cast("date")), (lambda w: 2 * w + 1)
    run = lambda weeks: F.concat(F.array(day_block), F.when(F.col("last") > F.col("first"), weeks).otherwise(F.array().cast("array<int>")))
    early = rows.withColumn("day", F.explode(run(F.transform(F.sequence(week(F.col("first")), week(F.col("last"))), week_block))))
    late = rows.withColumn("day", F.explode(run(F.array(week_block(week(F.col("first")))))))
    side = lambda frame, p, *more: frame.select("day", *[F.col(c).alias(p + c) for c in ("id", "first", "last", "s", "g")], *more)
    fits = F.when(F.col("day") % 2 == 0, F.col("a_id") < F.col("b_id")).otherwise((F.col("a_id") != F.col("b_id")) & (F.col("a_first") < F.col("b_first")) & (F.col("b_first") <= F.col("a_last")))
    pair = (F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b"))
    by_name = side(early, "a_").withColumnRenamed("a_s", "sa").join(alike, "sa").withColumnRenamed("sb", "b_s").join(side(late, "b_"), ["b_s", "day"]).filter(fits).select(*pair)

    placed = "lat IS NOT NULL AND lng IS NOT NULL"
    places = small(cut(near_places(listed.filter(placed))))
    beside = side(early.filter(placed), "a_", "lat", "lng").join(places, ["lat", "lng"]).join(side(late.filter(placed), "b_", F.col("lat").alias("b_lat"), F.col("lng").alias("b_lng")), ["b_lat", "b_lng", "day"])
    beside = cut(beside.filter(fits & F.coalesce(F.col("a_g") != F.col("b_g"), F.lit(True))).select(*pair, F.least("a_s", "b_s").alias("sa"), F.greatest("a_s", "b_s").alias("sb")))
    of = lambda p: names.select(F.col("s").alias("s" + p), F.col("v").alias("v" + p))
    apart = beside.select("sa", "sb").distinct().join(of("a"), "sa").join(of("b"), "sb").filter(~venues_match(F.col("va"), F.col("vb"))).select("sa", "sb")
    by_place = beside.join(small(cut(alike_names(cut(apart), names))), ["sa", "sb"], "left_semi").select("a", "b")
    return by_name.unionAll(by_place)


PRICED = ("is_free", "price_min", "price_max")
FIELDS = ("title", "description", "image_url", "venue", "starts_at", "ends_at", *PRICED, "currency", "url", "tags")
Field = Callable[[str], Column]


def _has_price(of: Field) -> Column:
    return of("is_free") | of("price_min").isNotNull() | of("price_max").isNotNull()


def merge_fields(old: Field, new: Field, site_wins: Column, api_wins: Column) -> dict[str, Column]:
    """Fields of a listing with those of one from another source merged into it; old and new give a field by name."""
    gaps, site = (lambda c: F.coalesce(old(c), new(c))), (lambda c: F.when(site_wins, F.coalesce(new(c), old(c))).otherwise(F.coalesce(old(c), new(c))))
    api = api_wins & _has_price(new)
    end = F.when(site_wins, F.when(new("ends_at").isNotNull(), new("ends_at")).when(old("ends_at") >= new("starts_at"), old("ends_at"))).otherwise(F.coalesce(old("ends_at"), F.when(new("ends_at") >= old("starts_at"), new("ends_at"))))
    return {
        "title": old("title"), "description": site("description"), "image_url": site("image_url"), "venue": gaps("venue"), "starts_at": F.when(site_wins, new("starts_at")).otherwise(old("starts_at")), "ends_at": end,
        **{c: F.when(api | ~_has_price(old), new(c)).otherwise(old(c)) for c in PRICED},
        "currency": F.when(api, F.coalesce(new("currency"), old("currency"))).otherwise(gaps("currency")), "url": F.when(api_wins, F.coalesce(new("url"), old("url"))).otherwise(gaps("url")),
        "tags": F.array_sort(F.array_distinct(F.concat(old("tags"), new("tags")))),
    }


def merged(site_wins: Column, api_wins: Column, x: str = "x_", n: str = "n_") -> dict[str, Column]:
    """Columns of a listing x with one from another source, n, merged into it."""
    return merge_fields(lambda c: F.col(x + c), lambda c: F.col(n + c), site_wins, api_wins)


def merged_events(listings: DataFrame, resolved: DataFrame) -> DataFrame:
    """(event, listings, sources, fields): one row per event of resolved (listing, event), its listings' fields merged one after
    another as replayed, by source and listing.

    listings have listing, source, kind (site, api or other) and FIELDS. An event's listings are few, one a source, so they
    are folded in one row by built-in functions.
    """
    one = F.struct("source", "listing", F.col("kind"), *FIELDS)
    rows = listings.join(resolved.select("listing", "event"), "listing").groupBy("event").agg(F.array_sort(F.collect_list(one)).alias("held"))
    start = F.struct(*[F.get("held", F.lit(0))[c].alias(c) for c in FIELDS])

    def fold(done: Column, new: Column) -> Column:
        fields = merge_fields(lambda c: done[c], lambda c: new[c], new["kind"] == "site", new["kind"] == "api")
        return F.struct(*[fields[c].cast(dict(listings.dtypes)[c]).alias(c) for c in FIELDS])

    rows = rows.withColumn("e", F.aggregate(F.slice("held", 2, F.greatest(F.size("held") - 1, F.lit(1))), start, fold))
    names = lambda c: F.array_sort(F.array_distinct(F.transform("held", lambda x: x[c])))
    return rows.select("event", names("listing").alias("listings"), names("source").alias("sources"), "e.*")


def refreshed(x: str = "x_", n: str = "n_") -> dict[str, Column]:
    """Columns of a listing x that its own source reports anew as n: new values win, nulls keep the old."""
    old, new = (lambda c: F.col(x + c)), (lambda c: F.col(n + c))
    fresh = lambda c: F.coalesce(new(c), old(c))
    return {
        "title": new("title"), **{c: fresh(c) for c in ("description", "image_url", "venue", "currency", "url")}, "starts_at": new("starts_at"),
        "ends_at": F.coalesce(new("ends_at"), F.when(old("ends_at") >= new("starts_at"), old("ends_at"))), **{c: F.when(_has_price(new), new(c)).otherwise(old(c)) for c in PRICED},
        "tags": F.array_sort(F.array_distinct(F.concat(old("tags"), new("tags")))),
    }


def content_policy(description: Column, image: Column, may_describe: Column, may_show: Column, excerpt: Column) -> tuple[Column, Column]:
    """What is stored of a description (an excerpt) and of an image."""
    return F.when(may_describe, excerpt).otherwise(F.lit(None).cast("string")), F.when(may_show, image).otherwise(F.lit(None).cast("string"))


def replay_listings(rows: list[dict], near: dict, never: set[frozenset], force: set[frozenset]) -> list[tuple]:
    """(listing, event, step) of the listings of one component (id, source, key, tokens, linked), taken one after another.

    An event is named by the listing that founded it; linked is the event of an earlier run or None. The steps, in order:
    forced by an override; refreshed, if its own source alone lists it and no other event has its key; the event that has its
    key; the event it is in, if it still matches; the best match among events without another listing of its source (title
    letter pairs, then the oldest); else created. A key that a forbidden event holds is made the listing's own.
    """
    by = {r["id"]: r for r in rows}
    events: dict = {}
    at: dict = {}
    with_key: dict[str, list] = {}
    alike: dict[tuple, float] = {}
    apart, together = partners(never), partners(force)
    numbers = count()

    def found(e, key: str, tokens: str) -> None:
        events[e] = {"key": key, "tokens": tokens, "members": Counter(), "age": len(events), "number": next(numbers)}
        heappush(with_key.setdefault(key, []), (events[e]["number"], e))

    def holder_of(key: str):
        """The oldest event that has the key; entries of events that have lost it or are gone are dropped."""
        held = with_key.get(key, [])
        while held and (held[0][1] not in events or events[held[0][1]]["number"] != held[0][0] or events[held[0][1]]["key"] != key):
            heappop(held)
        return held[0][1] if held else None

    def score(a: str, b: str) -> float:
        if (a, b) not in alike:
            alike[a, b] = dice(a, b)
        return alike[a, b]

    for r in rows:
        if r["linked"] is not None:
            if r["linked"] not in events:
                founder = by.get(r["linked"], r)
                found(r["linked"], founder["key"], founder["tokens"])
            events[r["linked"]]["members"][r["source"]] += 1
            at[r["id"]] = r["linked"]
    out = []
    for r in sorted(rows, key=lambda r: (r["source"], r["id"])):
        i, key, source, old = r["id"], r["key"], r["source"], at.get(r["id"])
        meets = lambda pairs: {at[m] for m in pairs.get(i, ()) if m in at and m != i}
        forbidden = meets(apart)
        forced = sorted(meets(together) - forbidden)
        holder = holder_of(key)
        if holder in forbidden:
            key = f"{key}|{source}:{i}"
            holder = holder_of(key)
        linked = old if old not in forbidden else None
        others = linked is not None and any(n > 0 for s, n in events[linked]["members"].items() if s != source)
        free = lambda e: e in events and e not in forbidden and events[e]["members"][source] == (e == old)
        if forced:
            target, step = forced[0], "forced"
        elif linked is not None and not others and holder in (None, linked):
            target, step = linked, "refreshed"
            events[linked].update(key=key, tokens=r["tokens"])
            heappush(with_key.setdefault(key, []), (events[linked]["number"], linked))
        elif holder is not None:
            target, step = holder, "same key"
        else:
            met = near.get(i, ())
            if linked is not None and (linked == i or linked in met) and free(linked):
                target, step = linked, "stays"
            elif fits := [e for e in {i, *met} if free(e)]:
                target, step = max(fits, key=lambda e: (score(r["tokens"], events[e]["tokens"]), -events[e]["age"], -events[e]["number"])), "matched"
            else:
                target, step = i, "created"
                while target in events:  # an older event that this listing founded and left
                    target = -target - 1
                found(target, key, r["tokens"])
        if old != target:
            events[target]["members"][source] += 1
            if old is not None:
                events[old]["members"][source] -= 1
                if not any(events[old]["members"].values()):
                    del events[old]  # an orphan
        at[i] = target
        out.append((i, target, step))
    return out


def partners(pairs: set[frozenset]) -> dict:
    """The others that each is paired with."""
    out: dict = {}
    for p in pairs:
        for a, b in permutations(p, 2):
            out.setdefault(a, set()).add(b)
    return out


#: So many nodes at most are held while edges are thinned; so many edges at most are left to one task.
THIN_NODES, ONE_TASK = 1 << 20, 1 << 21


def unite(root: dict, edges: pa.RecordBatch) -> tuple[list, list]:
    """Add edges to a forest in which each node points towards the least of its tree; those that did not close a circle."""

    def top(x):
        above = root.setdefault(x, x)
        while above != root[above]:
            root[x] = root[above]
            x, above = above, root[above]
        return above

    kept: tuple[list, list] = ([], [])
    for a, b in zip(edges.column(0).to_pylist(), edges.column(1).to_pylist()):
        x, y = top(a), top(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            kept[0].append(a)
            kept[1].append(b)
    return kept


def thinned(edges: DataFrame) -> DataFrame:
    """Edges (a, b) of the same components: each task leaves out those that close a circle there."""
    most = THIN_NODES

    def run(batches):
        root: dict = {}
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(k, c.type) for k, c in zip(unite(root, batch), batch.columns)], names=["a", "b"])
            if len(root) > most:
                root.clear()

    edges = edges.select("a", "b")
    return edges.mapInArrow(run, edges.schema)


def named_components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of edges (a, b): edges are thinned in fewer and fewer tasks; one names the
    components if few edges are left, else it is done by components()."""
    edges, parts = cut(thinned(edges)), edges.sparkSession.sparkContext.defaultParallelism
    left = edges.count()
    while left > ONE_TASK and parts > 1:
        parts = -(-parts // 4)
        edges, before = cut(thinned(edges.coalesce(parts))), left
        left = edges.count()
        if 2 * left > before:
            break
    if left > ONE_TASK:
        return cut(components(edges.select(F.col("a").alias("node")).unionAll(edges.select("b")), edges))

    def run(batches):
        root: dict = {}
        for batch in batches:
            unite(root, batch)
            kind = batch.column(0).type
        nodes = sorted(root)
        for x in nodes:
            root[x] = root[root[x]]  # the parent is less, so it points to the least already
        for i in range(0, len(nodes), 1 << 16):
            some = nodes[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(some, kind), pa.array([root[x] for x in some], kind)], names=["node", "component"])

    kind = dict(edges.dtypes)["a"]
    return cut(edges.coalesce(1).mapInArrow(run, f"node {kind}, component {kind}"))


class Matches:
    """Which names (title at a venue) and places of a family match: names are (s, plain, words, v), near are pairs of places, both ways."""

    def __init__(self, names: list[tuple], near: list[tuple]):
        self.names = {s: (plain, words, v) for s, plain, words, v in names}
        self.tokens = {s: " ".join(title_tokens(plain, words)) for s, plain, words, _ in names}
        self.places: dict = {}
        for a, b in near:
            self.places.setdefault(a, []).append(b)
        self.with_word: dict[str, list] = {}
        for s, _, _, v in names:
            for w in {*v.split("-")}:
                self.with_word.setdefault(w, []).append(s)
        self._alike: dict[tuple, bool] = {}
        self._score: dict[tuple, float] = {}
        self._beside: dict = {}

    def alike(self, s, t) -> bool:
        """Their titles match."""
        if (s, t) not in self._alike:
            (plain, words, _), (other, others, _) = self.names[s], self.names[t]
            self._alike[s, t] = titles_match(title_tokens(plain, words, others), title_tokens(other, words, others))
        return self._alike[s, t]

    def score(self, s, t) -> float:
        pair = self.tokens[s], self.tokens[t]
        if pair not in self._score:
            self._score[pair] = dice(*pair)
        return self._score[pair]

    def beside(self, s) -> list:
        """The names whose venues and titles match."""
        if s not in self._beside:
            v = self.names[s][2]
            some = {t for w in {*v.split("-")} for t in self.with_word[w]}
            self._beside[s] = [t for t in sorted(some) if same_venue(v, self.names[t][2]) and self.alike(s, t)]
        return self._beside[s]


def same_venue(a: str, b: str) -> bool:
    """venues_match() of two keys."""
    x, y = {*a.split("-")}, {*b.split("-")}
    return "unknown" not in (a, b) and (a == b or (len(min(x, y, key=len)) >= 2 and (x <= y or y <= x)))


STEPS = ("created", "matched", "same key")


def replay_keys(keys: np.ndarray, sources: np.ndarray, names: list, places: list, first: list, last: list, match: Matches) -> tuple[np.ndarray, np.ndarray]:
    """(event, step) of listings in the order of replay, as replay_listings() has them without earlier links and overrides.

    keys and sources are numbered, sources in order; an event is named by the position of its founder, a step by its place in
    STEPS. An event has its founder's key, name, place and days for good, and whoever has a key that an event holds joins
    it. So of a key only the listings up to its founder look for a match, and they look among founders alone.
    """
    event, step, week = np.full(len(keys), -1), np.full(len(keys), STEPS.index("same key"), "int8"), 7
    order, sizes = np.argsort(keys, kind="stable"), np.bincount(keys)
    begins, ends, by_key, keys = (np.cumsum(sizes) - sizes).tolist(), np.cumsum(sizes).tolist(), order.tolist(), keys.tolist()
    starts, sources = np.searchsorted(sources, np.arange(sources[-1] + 1)).tolist(), sources.tolist()
    at, todo = [*begins], sorted(by_key[i] for i in begins)
    taken: set[tuple] = set()
    on_day: dict[tuple, list] = {}
    in_week: dict[tuple, list] = {}

    def is_free(e: int, p: int, source: int) -> bool:
        """No listing of the source is in the event so far: none that matched, none that came by its key."""
        k = keys[e]
        i = bisect_left(by_key, max(e, starts[source]), begins[k], ends[k])
        return (e, source) not in taken and not (i < ends[k] and by_key[i] < p)

    while todo:
        p = heappop(todo)
        k, s, source, began, ended, best, most = keys[p], names[p], sources[p], first[p], last[p], None, -1.0
        if began is not None:
            runs = ended > began
            weeks = range(began // week, ended // week + 1) if runs else ()

            def better(found: list, check: bool) -> None:
                nonlocal best, most
                for e in found:
                    if e >= starts[source]:  # founders are in order; this one and those after it are of the source itself
                        break
                    if first[e] != began and not (first[e] <= ended and began <= last[e]):
                        continue
                    if check and not match.alike(s, names[e]):
                        continue
                    score = match.score(s, names[e])
                    if (score > most or (score == most and e < best)) and is_free(e, p, source):
                        best, most = e, score

            for where, check in [(("n", t), False) for t in match.beside(s)] + [(("p", q), True) for q in match.places.get(places[p], ())]:
                better(on_day.get((*where, began), ()), check)
                for w in weeks:
                    better(in_week.get((*where, w), ()), check)
        if best is not None:
            event[p], step[p] = best, STEPS.index("matched")
            taken.add((best, source))
            at[k] += 1
            if at[k] < ends[k]:
                heappush(todo, by_key[at[k]])
            continue
        event[order[at[k] : ends[k]]] = p
        step[p] = STEPS.index("created")
        if began is not None:
            for where in (("n", s), ("p", places[p])) if places[p] is not None else (("n", s),):
                on_day.setdefault((*where, began), []).append(p)
                for w in weeks:
                    in_week.setdefault((*where, w), []).append(p)
    return event, step


#: Titles are compared each with each up to so many; a title with more words that are also words of venues is taken to meet any.
FEW_TITLES, OPEN_WORDS = 1 << 12, 4


def may_match(a: str, a_open: list[str], b: str, b_open: list[str]) -> bool:
    """False for no two titles that match at some venues; open are their words that some venue has too."""
    if max(len(a_open), len(b_open)) > OPEN_WORDS:
        return True
    forms = lambda t, some: [[w for w in t.split() if w not in out] or t.split() for n in range(len(some) + 1) for out in combinations(some, n)]
    return any(titles_match(x, y) for x, y in product(forms(a, a_open), forms(b, b_open)))


def title_families(names: DataFrame, same: DataFrame) -> DataFrame:
    """(plain, family) of the titles of names (plain, words): titles that match at some venues are one family; same are edges (a, b) besides."""
    titles = names.select("plain", F.filter(F.split("plain", " "), lambda w: w != "").alias("w")).distinct()
    venue_words = names.select(F.explode("words").alias("word")).distinct()
    open_words = titles.select("plain", F.explode("w").alias("word")).join(venue_words, "word", "left_semi").groupBy("plain").agg(F.collect_set("word").alias("open"))
    titles = cut(titles.join(open_words, "plain", "left").select("plain", F.coalesce("open", F.array().cast("array<string>")).alias("open")))
    side = lambda p: titles.filter("plain <> ''").select(F.col("plain").alias(p), F.col("open").alias(p + "_open"))

    @F.pandas_udf("boolean")
    def run(a: pd.Series, a_open: pd.Series, b: pd.Series, b_open: pd.Series) -> pd.Series:
        return pd.Series([may_match(x, [*xs], y, [*ys]) for x, xs, y, ys in zip(a, a_open, b, b_open)], dtype=bool)

    met = side("a").repartition(titles.sparkSession.sparkContext.defaultParallelism).crossJoin(F.broadcast(side("b"))).filter("a < b")
    met = met.filter((F.size("a_open") + F.size("b_open") > 0) | could_match(F.col("a"), F.col("b"))).filter(run("a", "a_open", "b", "b_open"))
    named = named_components(met.select("a", "b").unionAll(same)).withColumnRenamed("node", "plain")
    return titles.join(named, "plain", "left").select("plain", F.coalesce("component", "plain").alias("family"))


def resolved_by_key(listings: DataFrame) -> DataFrame | None:
    """(listing, event, step) without earlier links and overrides, with no pairs of listings made; None if there are many titles.

    Titles that may match at some venues are a family, which is replayed by itself by replay_keys(): what a task looks at
    grows with the keys, and copies of a key only join its event.
    """
    from tidemark.functions.text import TITLE_STOP, key_part

    kind, none = dict(listings.dtypes)["listing"], F.array().cast("array<string>")
    days = lambda c: F.datediff(c, F.lit("1970-01-05").cast("date"))
    first, last = london_date(F.col("starts_at")), london_date(F.coalesce("ends_at", "starts_at"))
    rows = cut(listings.select(F.col("listing").alias("id"), "source", "title", "venue", "lat", "lng", first.alias("first"), F.greatest(first, last).alias("last")))
    words = lambda c: F.coalesce(key_words(F.col(c)), none)
    names = rows.select("title", "venue").distinct().withColumn("s", F.monotonically_increasing_id())
    names = cut(names.select("title", "venue", "s", F.array_join(plain_words(words("title")), " ").alias("plain"), words("venue").alias("words"), venue_key(F.col("venue")).alias("v"), key_part(F.col("title"), TITLE_STOP).alias("t")))
    if names.select("plain").distinct().limit(FEW_TITLES + 1).count() > FEW_TITLES:
        return None
    named = lambda frame: frame.join(small(names), frame["title"].eqNullSafe(names["title"]) & frame["venue"].eqNullSafe(names["venue"])).drop("title", "venue")
    key = F.concat_ws("|", "t", F.date_format("first", "yyyy-MM-dd"), "v")
    odd = named(rows.filter("title IS NULL OR first IS NULL")).select(key.alias("key"), "plain").distinct()  # a key with a part left out can be another's
    least = odd.groupBy("key").agg(F.min("plain").alias("a"))
    families = title_families(names, odd.join(least, "key").filter("a <> plain").select("a", F.col("plain").alias("b")))
    names = cut(names.join(F.broadcast(families), "plain"))

    places = rows.filter("lat IS NOT NULL AND lng IS NOT NULL").select("lat", "lng").distinct()
    places = cut(places.withColumn("place", F.monotonically_increasing_id()))
    at = lambda p, q: places.select(F.col("lat").alias(p + "lat"), F.col("lng").alias(p + "lng"), F.col("place").alias(q))
    near = cut(near_places(places).join(at("", "a"), ["lat", "lng"]).join(at("b_", "b"), ["b_lat", "b_lng"]).select("a", "b"))
    ready = named(rows).join(small(places), ["lat", "lng"], "left")
    ready = cut(ready.select("family", "id", "source", key.alias("key"), "s", "place", days("first").alias("first"), days("last").alias("last")))

    of = lambda p: ready.filter("place IS NOT NULL").select("family", F.col("place").alias(p)).distinct()
    near = small(near).join(of("a"), "a").join(of("b"), ["family", "b"]).select("family", "a", "b", F.lit(None).cast("string").alias("plain"), F.lit(None).cast("array<string>").alias("words"), F.lit(None).cast("string").alias("v"))
    told = near.unionAll(names.select("family", "s", F.lit(None).cast("long"), "plain", "words", "v")).withColumnRenamed("family", "told_family")

    def replay(group: pa.Table, told: pa.Table) -> pa.Table:
        group = group.take(pc.sort_indices(group, [("source", "ascending"), ("id", "ascending")]))
        is_near = told["b"].is_valid()
        near, names = told.filter(is_near), told.filter(pc.invert(is_near))
        match = Matches(
            [(s, p.split(), w, v) for s, p, w, v in zip(names["a"].to_pylist(), names["plain"].to_pylist(), names["words"].to_pylist(), names["v"].to_pylist())], list(zip(near["a"].to_pylist(), near["b"].to_pylist())),
        )
        code = lambda c: group[c].combine_chunks().dictionary_encode("encode").indices.to_numpy()
        held = [group[c].to_pylist() for c in ("s", "place", "first", "last")]
        event, step = replay_keys(code("key"), code("source"), *held, match)
        events = group["id"].take(pa.array(event))
        return pa.table([group["id"], events.cast(group["id"].type), pa.array(STEPS).take(pa.array(step))], names=["listing", "event", "step"])

    return ready.groupBy("family").cogroup(told.groupBy("told_family")).applyInArrow(replay, f"listing {kind}, event {kind}, step string")


def resolve_events(listings: DataFrame, never: list[tuple] = (), force: list[tuple] = (), links: DataFrame | None = None, steps: bool = False) -> DataFrame:
    """(listing, event): the event of each listing (listing, source, title, venue, lat, lng, starts_at, ends_at).

    Listings that could meet are a component, which is replayed alone by replay_listings(). never and force: pairs of
    listings that must not, or must, share an event. links: (listing, event) of an earlier run. With steps, how it was found.
    Listings that share no block with another, most of them, found an event each without leaving the JVM. Without links
    and overrides, unless titles are many, no pairs are made: see resolved_by_key().
    """
    from tidemark.functions.text import dedupe_key

    if links is None and not [*never, *force]:
        found = resolved_by_key(listings)
        if found is not None:
            return found if steps else found.select("listing", "event")
    rows = listings.withColumn("key", dedupe_key(F.col("title"), london_date(F.col("starts_at")), F.col("venue"))).withColumnRenamed("listing", "id")
    kind = dict(rows.dtypes)["id"]
    spark = rows.sparkSession
    earlier = spark.createDataFrame([], f"id {kind}, linked {kind}") if links is None else links.select(F.col("listing").alias("id"), F.col("event").alias("linked"))
    rows = cut(rows.join(earlier, "id", "left").select("id", "source", "title", "venue", "lat", "lng", "starts_at", "ends_at", "key", "linked"))
    pairs = cut(fuzzy_pairs(rows))
    least = lambda c: rows.filter(F.col(c).isNotNull()).groupBy(c).agg(F.min("id").alias("a"))
    edges = pairs
    for c in ("key", "linked"):
        edges = edges.union(rows.join(least(c), c).filter("id <> a").select("a", F.col("id").alias("b")))
    told = [(a, b) for a, b in [*never, *force]]
    if told:
        edges = edges.union(spark.createDataFrame(told, f"a {kind}, b {kind}"))
    words = lambda c: F.coalesce(key_words(F.col(c)), F.array().cast("array<string>"))
    named = named_components(edges)
    met_nodes = named.select(F.col("node").alias("id"))
    several = rows.join(met_nodes, "id", "left_semi")
    alone = rows.join(met_nodes, "id", "left_anti").select(F.col("id").alias("listing"), F.coalesce("linked", "id").alias("event"), F.when(F.col("linked").isNull(), "created").otherwise("refreshed").alias("step"))
    ready = several.join(named, several["id"] == named["node"]).select("component", "id", "source", "key", "linked", shown_tokens(plain_words(words("title")), words("venue")).alias("tokens"))
    of_pair = named.select(F.col("node").alias("pair_node"), F.col("component").alias("pair_component"))
    met = pairs.join(of_pair, F.col("a") == F.col("pair_node")).select("pair_component", "a", "b")
    apart, together = ({frozenset(p) for p in x} for x in (never, force))

    def replay(group: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        rows = [
            {"id": r.id, "source": r.source, "key": r.key, "linked": None if pd.isna(r.linked) else type(r.id)(r.linked), "tokens": r.tokens}
            for r in group.itertuples()
        ]
        near: dict = {}
        for a, b in zip(links["a"].tolist(), links["b"].tolist()):
            near.setdefault(a, []).append(b)
            near.setdefault(b, []).append(a)
        return pd.DataFrame(replay_listings(rows, near, apart, together), columns=["listing", "event", "step"])

    found = ready.groupBy("component").cogroup(met.groupBy("pair_component")).applyInPandas(replay, f"listing {kind}, event {kind}, step string").unionAll(alone)
    return found if steps else found.select("listing", "event")
