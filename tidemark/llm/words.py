"""Words of texts as 64-bit hashes, worked out for many texts at once in numpy; nothing is remembered between calls."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  as pa.compute

from tidemark.llm.common import once

STEP = 1 << 18  # characters hashed at once; a longer word is hashed as a whole
GROUP = 1 << 20  # bytes of text that a group of rows has, or one row more
MULTIPLIER = 0x9E3779B97F4A7C15
WORD = re.compile(r"\w+")
SPACE = re.compile(r"\s")
ASCII_SPACE = re.compile(rb"[ \t\n\v\f\r]")


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """MULTIPLIER ** n for n below size or more, and their inverses modulo 2**64."""
    make = lambda n: tuple(np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n - 1, m, dtype=np.uint64)))) for m in (MULTIPLIER, pow(MULTIPLIER, -1, 1 << 64)))
    usual = 2 * STEP
    return once(("powers",), lambda: make(usual)) if size <= usual else make(size)


def _letters() -> np.ndarray:
    """By code point: whether it is part of a word (a letter, a digit or _)."""
    return once(("letters",), lambda: np.fromiter((c == 95 or chr(c).isalnum() for c in range(0x110000)), dtype=bool, count=0x110000))


def _bytes() -> tuple[np.ndarray, np.ndarray]:
    """By byte: whether it is part of a word (no ASCII white space), and the byte with A-Z lower-cased."""
    every = np.arange(256)
    return ~np.isin(every, [32, 9, 10, 11, 12, 13]), np.where((every >= 65) & (every <= 90), every + 32, every).astype(np.uint8)


def hash_spans(codes: np.ndarray, start: np.ndarray, *stops: np.ndarray) -> list[np.ndarray]:
    """The hashes of what lies from each start to each stop, for each array of stops."""
    power, inverse = _powers(len(codes) + 1)
    values = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    values ^= values >> np.uint64(32)
    values *= power[: len(codes)]
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)))
    back = inverse[start]
    return [mix((total[stop] - total[start]) * back) for stop in stops]


def spans(codes: np.ndarray, inside: np.ndarray, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, list[np.ndarray]]:
    """Where the runs of `inside` start, and their hashes: of the whole, and of the first n characters for n in prefixes."""
    edge = np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return start, hash_spans(codes, start, end, *(np.minimum(end, start + n) for n in prefixes))


def _hashed(whole: str | bytes, ends: np.ndarray, prefixes: tuple[int, ...]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Words of texts that stand in `whole`, each followed by a newline, at last at `ends`: (words of each, hashes)."""
    space, at, starts, out = (SPACE if isinstance(whole, str) else ASCII_SPACE), 0, [], [[] for _ in range(1 + len(prefixes))]
    while at < len(whole):
        found = space.search(whole, at + STEP) if len(whole) - at > STEP else None
        stop = found.end() if found else len(whole)
        if isinstance(whole, str):
            codes = np.frombuffer(whole[at:stop].encode("utf-32-le", "surrogatepass"), dtype="<u4")
            inside = _letters()[codes]
        else:
            codes = np.frombuffer(whole, dtype=np.uint8, count=stop - at, offset=at)
            inside, lower = _bytes()
            codes, inside = lower[codes], inside[codes]
        start, hashes = spans(codes, inside, prefixes)
        starts.append(start + at)
        for own, new in zip(out, hashes):
            own.append(new)
        at = stop
    if not starts:
        return np.zeros(len(ends), np.int64), [np.zeros(0, np.uint64) for _ in out]
    counts = np.diff(np.searchsorted(np.concatenate(starts), ends), prepend=0)
    return counts, [np.concatenate(x) for x in out]


def folded_hashes(texts: list[str | None], prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, list[np.ndarray]]:
    """(words of each text, hashes of all in a row) of runs of letters, digits and _, lower-cased; a null text has none.

    The hashes of the words' first n letters follow for each n of prefixes.
    """
    low = [(t or "").lower() for t in texts]
    return _hashed("".join(x for t in low for x in (t, "\n")), np.cumsum([len(t) + 1 for t in low], dtype=np.int64), prefixes)


def plain_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(words of each text, hashes of all in a row) of what stands between ASCII white space, A-Z lower-cased."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    counts, (hashes,) = _hashed(b"".join(x for t in raw for x in (t, b"\n")), np.cumsum([len(t) + 1 for t in raw], dtype=np.int64), ())
    return counts, hashes


class Numbers(dict):
    """word -> number, worked out word by word; the plain form of what the functions above do for many texts."""

    def __init__(self, make: Callable[[str], int]):
        super().__init__()
        self.make = make

    def __missing__(self, word: str) -> int:
        self[word] = found = self.make(word)
        return found


def folded(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def hash_word(word: str) -> int:
    """The hash that folded_hashes() gives a word."""
    return int(folded_hashes([word])[1][0][0])


def groups(sizes: list[int], most: int = GROUP) -> Iterator[slice]:
    """Runs of items whose sizes sum to `most` or less; a larger item is a run of its own."""
    low, total = 0, 0
    for n, size in enumerate(sizes):
        if n > low and total + size > most:
            yield slice(low, n)
            low, total = n, 0
        total += size
    if low < len(sizes):
        yield slice(low, len(sizes))


def slices(batches: Iterator[pa.RecordBatch], column: int | str, most: int = GROUP) -> Iterator[pa.RecordBatch]:
    """The batches' rows in order, in slices of about `most` bytes of the column's text and at most `most` / 64 rows."""
    for batch in batches:
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        for own in groups((sizes + 64).tolist(), most):
            yield batch.slice(own.start, own.stop - own.start)
