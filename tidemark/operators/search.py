"""Full-text search: stemmed weighted lexemes, web-search and prefix queries, correction of typos, rank."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import search_fold, tokens

MOST_CHARS, MOST_TOKENS, LEAST_CORRECTED = 200, 12, 4
WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2}

#: English words without meaning for search.
STOP = set("i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now".split())

#: Words that the published stemmer treats apart, and those it leaves after the plural.
APART = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
LEFT = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}

VOWEL = "aeiouy"
STEP2 = [("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble")]
STEP3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ical", "ic"), ("ness", ""), ("ful", "")]
STEP4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic"]


def regions(word: str) -> tuple[int, int]:
    """Where the published stemmer's regions R1 and R2 begin."""
    found = re.search(f"[{VOWEL}][^{VOWEL}]", word)
    special = re.match("gener|commun|arsen", word)
    r1 = special.end() if special else found.end() if found else len(word)
    found = re.search(f"[{VOWEL}][^{VOWEL}]", word[r1:])
    return r1, r1 + found.end() if found else len(word)


def short(word: str) -> bool:
    return bool(re.search(f"(^|.*[^{VOWEL}])[{VOWEL}][^{VOWEL}wxY]$", word) if len(word) > 2 else re.match(f"^[{VOWEL}][^{VOWEL}]$", word)) and regions(word)[0] >= len(word)


def stem(word: str) -> str:
    """English stem by the published Porter2 rules."""
    if len(word) < 3 or word in APART:
        return APART.get(word, word)
    word = re.sub(f"(^|[{VOWEL}])y", r"\1Y", word.lstrip("'"))
    r1, r2 = regions(word)
    word = re.sub("'(s'?)?$", "", word)
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and re.search(f"[{VOWEL}].+s$", word):
        word = word[:-1]
    if word in LEFT:
        return word
    if word.endswith(("eedly", "eed")):
        cut = 5 if word.endswith("eedly") else 3
        if len(word) - cut >= r1:
            word = word[:-cut] + "ee"
    else:
        end = next((e for e in ("ingly", "edly", "ing", "ed") if word.endswith(e)), None)
        if end and re.search(f"[{VOWEL}]", word[: -len(end)]):
            word = word[: -len(end)]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", word):
                word = word[:-1]
            elif short(word):
                word += "e"
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in VOWEL:
        word = word[:-1] + "i"
    for end, to in STEP2:
        if word.endswith(end):
            word = word[: -len(end)] + to if len(word) - len(end) >= r1 else word
            break
    else:
        if word.endswith("ogi") and len(word) - 3 >= r1 and word[-4:-3] == "l":
            word = word[:-1]
        elif word.endswith("li") and len(word) - 2 >= r1 and word[-3] in "cdeghkmnrt":
            word = word[:-2]
    for end, to in STEP3:
        if word.endswith(end):
            word = word[: -len(end)] + to if len(word) - len(end) >= r1 else word
            break
    else:
        if word.endswith("ative") and len(word) - 5 >= r2:
            word = word[:-5]
    for end in STEP4:
        if word.endswith(end):
            if len(word) - len(end) >= r2 and (end != "ion" or word[-4] in "st"):
                word = word[: -len(end)]
            break
    if word.endswith("e") and (len(word) - 1 >= r2 or (len(word) - 1 >= r1 and not short(word[:-1]))):
        word = word[:-1]
    elif word.endswith("l") and len(word) - 1 >= r2 and word[-2:-1] == "l":
        word = word[:-1]
    return word.replace("Y", "y")


def lexemes(text: str) -> list[tuple[str, int]]:
    """(stem, position) of the words of a folded text; stop words take a position, from 1 on, but are no lexemes."""
    return [(stem(w), n) for n, w in enumerate(re.findall("[a-z0-9]+", text), 1) if w not in STOP]


def index(df: DataFrame, id_col: str, weighted: dict[str, Column]) -> DataFrame:
    """(id, lexeme, weight, position): a row per occurrence in folded texts by weight class, to be stored by lexeme.

    Positions run on from one class to the next, after the last lexeme before. A null text has no words.
    """
    schema = f"{id_col} {dict(df.dtypes)[id_col]}, lexeme string, weight string, position int"
    classes = list(weighted)
    folded = df.select(id_col, *[search_fold(F.coalesce(c, F.lit(""))).alias(w) for w, c in weighted.items()])

    def rows_of(i: object, texts: tuple[str, ...]) -> Iterator[tuple]:
        base = 0
        for w, text in zip(classes, texts):
            found = lexemes(text)
            yield from ((i, x, w, base + n) for x, n in found)
            base += found[-1][1] if found else 0

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [r for i, *texts in frame[[id_col, *classes]].itertuples(index=False) for r in rows_of(i, texts)]
            yield pd.DataFrame(rows, columns=[id_col, "lexeme", "weight", "position"])

    return folded.mapInPandas(run, schema)


Term = tuple[bool, list[tuple[str, int]]]


def parse_websearch(query: str) -> list[list[Term]]:
    """Alternatives of conjunctions of (negated, lexemes with their distances from the first): quotes, `or`, `-word`, else
    all words. Stop words within quotes count as distance."""
    out: list[list[Term]] = [[]]
    for minus, quoted, word in re.findall(r'(-?)"([^"]*)"|(\S+)', query[:MOST_CHARS]):
        if word.lower() == "or":
            out.append([])
            continue
        negated = minus == "-" or (word.startswith("-") and len(word) > 1)
        found = lexemes(quoted.lower() if quoted else word.lstrip("-").lower())
        if found:
            out[-1].append((negated, [(x, n - found[0][1]) for x, n in found]))
    return [a for a in out if a]


def websearch(index_rows: DataFrame, id_col: str, query: str, ids: DataFrame | None = None) -> DataFrame:
    """Ids that the query finds; only the rows of the query's lexemes are read.

    What only negates (`-word`) finds all other rows, so that it needs `ids`, a table with all of them; those of the index
    are taken where it is left out. A query without lexemes finds nothing.
    """
    alternatives = parse_websearch(query)
    wanted = sorted({x for a in alternatives for _, words in a for x, _ in words})
    lists = index_rows.filter(F.col("lexeme").isin(wanted or [""])).groupBy(id_col).agg(F.collect_set(F.struct("lexeme", "position")).alias("hits"))

    def row(words: list[tuple[str, int]]) -> Column:
        starts = F.filter("hits", lambda h: h["lexeme"] == words[0][0])
        at = lambda h: [F.array_contains("hits", F.struct(F.lit(w).alias("lexeme"), (h["position"] + n).alias("position"))) for w, n in words[1:]]
        return F.exists(starts, lambda h: reduce(lambda x, y: x & y, at(h), F.lit(True)))

    test = F.lit(False)
    for alternative in alternatives:
        ok = F.lit(True)
        for negated, words in alternative:
            ok = ok & (~row(words) if negated else row(words))
        test = test | ok
    if any(all(negated for negated, _ in a) for a in alternatives):  # rows without any of the lexemes may pass
        every = (index_rows if ids is None else ids).select(id_col).distinct()
        lists = every.join(lists, id_col, "left").withColumn("hits", F.coalesce("hits", F.array().cast("array<struct<lexeme:string,position:int>>")))
    return lists.filter(test).select(id_col)


def prefix_match(text: Column, query: str) -> Column:
    """All words of the query stand in the text, the last as a prefix."""
    words = re.findall("[a-z0-9]+", query.lower())[:MOST_TOKENS]
    held = F.filter(F.split(search_fold(text), "[^a-z0-9]+"), lambda w: w != "")
    test = F.lit(bool(words))
    for word in words[:-1]:
        test = test & F.array_contains(held, word)
    return test & F.exists(held, lambda w: w.startswith(words[-1])) if words else test


def lexicon(df: DataFrame, text: Column) -> DataFrame:
    """Distinct folded words of three letters or more that aren't numbers."""
    return df.select(F.explode(F.array_distinct(F.split(search_fold(text), "[^a-z0-9]+"))).alias("word")).filter((F.length("word") >= 3) & ~F.col("word").rlike("^[0-9]+$")).distinct()


def unmatched(words: list[str], known: DataFrame) -> DataFrame:
    """The words that no known word begins with; a bounded list of words against one scan."""
    asked = [w for w in words if w not in STOP][:MOST_TOKENS]
    hits = known.agg(*[F.coalesce(F.bool_or(F.col("word").startswith(w)), F.lit(False)).alias(f"w{n}") for n, w in enumerate(asked)])
    pairs = F.array(*[F.struct(F.lit(w).alias("word"), F.col(f"w{n}").alias("found")) for n, w in enumerate(asked)])
    return hits.select(F.explode(pairs).alias("p")).filter("NOT p.found").select("p.word")


def damerau(a: str, b: str) -> int:
    """Edit distance with transpositions, unrestricted."""
    last: dict[str, int] = {}
    far = len(a) + len(b)
    d = [[far] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        d[i + 1][1] = i
    for j in range(len(b) + 1):
        d[1][j + 1] = j
    for i, x in enumerate(a, 1):
        seen = 0
        for j, y in enumerate(b, 1):
            k, l = last.get(y, 0), seen
            cost = x != y
            if not cost:
                seen = j
            d[i + 1][j + 1] = min(d[i][j] + cost, d[i + 1][j] + 1, d[i][j + 1] + 1, d[k][l] + i - k - 1 + 1 + j - l - 1)
        last[x] = i
    return d[-1][-1]


def jaro_winkler(a: str, b: str) -> float:
    reach = max(len(a), len(b)) // 2 - 1
    taken, first = [False] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == x:
                taken[j] = True
                first.append(x)
                break
    if not first:
        return 0.0
    second = [y for y, t in zip(b, taken) if t]
    swaps = sum(x != y for x, y in zip(first, second)) / 2
    m = len(first)
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = next((n for n, (x, y) in enumerate(zip(a[:4], b[:4])) if x != y), min(len(a), len(b), 4))
    return jaro + prefix * 0.1 * (1 - jaro)


def corrections(words: list[str], known: DataFrame) -> DataFrame:
    """(word, correction): the nearest known word, by edits, then likeness, then the alphabet; far ones are no correction.

    Each task keeps its best word for each of the few asked, so the lexicon is scanned once and never gathered.
    """
    asked = [w for w in words if len(w) >= LEAST_CORRECTED and not w.isdigit()][:MOST_TOKENS]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[str, tuple] = {}
        for frame in frames:
            for known_word in frame["word"]:
                for w in asked:
                    limit = 1 if len(w) <= 5 else 2
                    if w != known_word and abs(len(w) - len(known_word)) <= limit and (edits := damerau(w, known_word)) <= limit:
                        key = (edits, -jaro_winkler(w, known_word), known_word)
                        best[w] = min(best.get(w, key), key)
        yield pd.DataFrame([(w, *k) for w, k in best.items()], columns=["word", "edits", "unlike", "correction"])

    found = known.select("word").mapInPandas(run, "word string, edits int, unlike double, correction string")
    return found.groupBy("word").agg(F.min(F.struct("edits", "unlike", "correction")).alias("best")).select("word", F.col("best.correction").alias("correction"))


def rank(index_rows: DataFrame, id_col: str, query: str) -> DataFrame:
    """(id, rank) by the published rules of PostgreSQL's ts_rank, for rows with a lexeme of the query.

    One conjunction or phrase: each two occurrences of different lexemes add the root of their weights' product times a
    factor that falls with their distance, as probabilities are joined. Else each lexeme adds its weights, divided by the
    square of their place, the greatest at full weight, over the number of lexemes.
    """
    alternatives = parse_websearch(query)
    wanted = sorted({x for a in alternatives for _, words in a for x, _ in words})
    joined = len(alternatives) == 1 and (len(alternatives[0]) > 1 or len(alternatives[0][0][1]) > 1) and len(wanted) > 1
    weight = F.create_map(*[F.lit(x) for pair in WEIGHTS.items() for x in pair])
    hits = index_rows.filter(F.col("lexeme").isin(wanted or [""])).groupBy(id_col, "lexeme").agg(F.array_sort(F.collect_set(F.struct("position", weight[F.col("weight")].alias("w")))).alias("at"))
    if not joined:
        shares = F.transform("at", lambda x, i: x["w"] / ((i + 1) * (i + 1)))
        most = F.array_max(F.transform("at", lambda x: x["w"]))
        place = F.array_position(F.transform("at", lambda x: x["w"]), most)
        value = (most + F.aggregate(shares, F.lit(0.0), lambda s, x: s + x) - most / (place * place)) / 1.64493406685
        return hits.groupBy(id_col).agg((F.sum(value) / max(1, len(wanted))).alias("rank"))
    every = hits.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("lexeme", "at"))).alias("of"))
    far = lambda d: F.when(d > 100, F.lit(1e-30)).otherwise(1 / (1.005 + 0.05 * F.exp(d / 1.5 - 2)))
    own = lambda x: F.coalesce(F.element_at("of", F.lit(x)), F.array().cast("array<struct<position:int,w:double>>"))
    meet = lambda p, q: F.sqrt(p["w"] * q["w"] * far(F.abs(p["position"] - q["position"])))
    every_pair = lambda x, y: F.flatten(F.transform(own(x), lambda p: F.transform(own(y), lambda q: meet(p, q))))
    values = F.concat(*[every_pair(x, y) for n, x in enumerate(wanted) for y in wanted[:n]])
    value = F.when(F.size(values) == 0, F.lit(1e-20)).otherwise(1 - F.aggregate(values, F.lit(1.0), lambda s, x: s * (1 - x)))
    return every.select(id_col, value.alias("rank"))
