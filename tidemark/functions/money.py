"""Prices from text and from amounts, and the costs of calls."""

from __future__ import annotations

import re
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SYMBOLS = {"£": "GBP", "€": "EUR", "$": "USD"}
PRICE = "is_free boolean, price_min decimal(10,2), price_max decimal(10,2), currency string"
TOKEN = re.compile(r"(?P<symbol>[£€$])|(?P<code>GBP|EUR|USD)|(?P<number>[0-9](?:[0-9.]|,(?=[0-9]))*)|(?P<dash>[-–—])|(?P<space>\s+)|(?P<other>.)", re.DOTALL)


def price_of(text: str | None) -> tuple[bool, Decimal | None, Decimal | None, str | None]:
    """(free, least, greatest, currency): amounts count behind a currency, or behind a dash that follows such an amount."""
    text, amounts, first, last, pending, dash = text or "", [], None, None, None, False
    for match in TOKEN.finditer(text):
        kind, part = match.lastgroup, match.group()
        if kind in ("symbol", "code"):
            pending = SYMBOLS.get(part, part)
        elif kind == "number":
            currency, pending = pending or (last if dash else None), None
            number = part.replace(",", "").rstrip(".")
            if currency and number.count(".") < 2:
                amounts.append(Decimal(number))
                first, last = first or currency, currency
        elif kind != "space":
            pending = None
        dash = kind == "dash" or (dash and kind == "space")
    positive = any(amounts)
    free = (bool(amounts) and not positive) or ("free" in re.split(r"[\W_]+", text.lower()) and not positive)
    low, high = (min(amounts), max(amounts)) if amounts else ((Decimal(0), Decimal(0)) if free else (None, None))
    return free, low, high, first


def parse_price(text: Column) -> Column:
    """A struct of price_of(); a scan with state, so it runs in Arrow batches."""

    @F.pandas_udf(PRICE)
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([price_of(t) for t in texts], columns=["is_free", "price_min", "price_max", "currency"])

    return run(text)


def price_from_amounts(low: Column, high: Column, currency: Column) -> Column:
    """Two amounts in order, one for both if one is missing; free if the greater is zero; cents half to even."""
    least, most = F.least(F.coalesce(low, high), F.coalesce(high, low)), F.greatest(F.coalesce(low, high), F.coalesce(high, low))
    code = F.upper(F.trim(currency))
    return F.struct(
        F.coalesce(most == 0, F.lit(False)).alias("is_free"), F.bround(least, 2).cast("decimal(10,2)").alias("price_min"), F.bround(most, 2).cast("decimal(10,2)").alias("price_max"), F.when(code != "", code).alias("currency")
    )


def call_cost(input_tokens: Column, output_tokens: Column, input_price: Column, output_price: Column) -> Column:
    """Cost of a call at prices per million tokens."""
    return ((input_tokens * input_price + output_tokens * output_price) / F.lit(1_000_000)).cast("decimal(18,6)")


#: Phrases that say that entry is free.
FREE = ["free entry", "free admission", "free event", "free exhibition", "free installation", "free display", "free talk", "free tour", "free to attend", "free to enter", "free to visit", "entry is free", "admission is free", "free of charge"]


def max_tokens(batch: Column) -> Column:
    """Output tokens that a batch of so many results may use."""
    return batch.cast("long") * 300 + 2000


def estimate_cost(prompt_chars: Column, most_output: Column, input_price: Column, write_price: Column, output_price: Column) -> Column:
    """Upper estimate of a call: a token for each three characters at the dearer input price, and all output used; prices
    are for a million tokens."""
    tokens = F.floor(prompt_chars / 3).cast("long") + 1
    million = F.lit(1_000_000)
    return tokens * F.greatest(input_price, write_price) / million + F.greatest(most_output, F.lit(0)) * output_price / million


def describes_free_entry(text: Column) -> Column:
    """Prose says that entry is free and names no price; hyphens are part of words ("step-free" isn't free)."""
    words = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}-]+", " ")), F.lit(" "))
    said = F.lit(False)
    for phrase in FREE:
        said = said | F.contains(words, F.lit(f" {phrase} "))
    return F.coalesce(said & ~(F.coalesce(parse_price(text)["price_max"], F.lit(0)) > 0), F.lit(False))
