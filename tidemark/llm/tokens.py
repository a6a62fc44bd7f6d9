"""Token ids of public vocabularies, as little-endian bytes."""

from __future__ import annotations

import base64
import os

import numpy as np
import regex

from tidemark.llm.words import hash_spans

#: A text of these characters is normalised by lower-casing alone: white space, ASCII and precomposed Latin letters.
PLAIN = regex.compile("[\t\n\r -~À-ÖØ-öø-įı-ſ]*")
SPACE = regex.compile("[\t\n\r ]")
STEP = 1 << 18


class WordTable:
    """What words became: ids by 64-bit hash and length of the word, in flat arrays with open addressing.

    It holds half as many words as slots, about 40 MB, and forgets all when it is full. Two words of one length with one
    hash would be taken for one another: for a word that isn't known, the odds are below 1 in 10**13.
    """

    def __init__(self, bits: int = 21, most_ids: int = 1 << 23):
        self.bits, self.most_ids = bits, most_ids
        self.keys = np.zeros(1 << bits, dtype=np.uint64)
        self.sizes, self.first, self.count = (np.zeros(1 << bits, dtype=np.int32) for _ in range(3))
        self.ids, self.end, self.used = np.zeros(1 << 16, dtype=np.uint16), 0, 0

    def make_room(self) -> None:
        if 2 * self.used > len(self.keys) or self.end > self.most_ids:
            self.keys[:] = 0
            self.ids, self.end, self.used = np.zeros(1 << 16, dtype=np.uint16), 0, 0

    def find(self, hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The slot of each word, -1 for one that isn't there."""
        slots, todo = np.full(len(hashes), -1), np.arange(len(hashes))
        at = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(todo):
            held = self.keys[at]
            hit = (held == hashes[todo]) & (self.sizes[at] == sizes[todo])
            slots[todo[hit]] = at[hit]
            on = ~hit & (held != 0)
            todo, at = todo[on], (at[on] + 1) & (len(self.keys) - 1)
        return slots

    def add(self, hashes: np.ndarray, sizes: np.ndarray, codes: list[np.ndarray]) -> None:
        """Take different words that aren't there, with their ids."""
        counts = np.fromiter(map(len, codes), dtype=np.int64, count=len(codes))
        total = int(counts.sum())
        if self.end + total > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros(max(total, len(self.ids)), dtype=np.uint16)))
        self.ids[self.end : self.end + total] = np.concatenate(codes) if codes else 0
        first = self.end + np.cumsum(counts) - counts
        self.end, self.used = self.end + total, self.used + len(codes)
        todo, at = np.arange(len(hashes)), (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(todo):
            free = np.flatnonzero(self.keys[at] == 0)
            _, own = np.unique(at[free], return_index=True)
            won = free[own]
            slot, word = at[won], todo[won]
            self.keys[slot], self.sizes[slot], self.first[slot], self.count[slot] = hashes[word], sizes[word], first[word], counts[word]
            on = np.ones(len(todo), dtype=bool)
            on[won] = False
            todo, at = todo[on], (at[on] + 1) & (len(self.keys) - 1)

    def spell(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of each word, all ids in a row)."""
        counts = self.count[slots].astype(np.int64)
        place = np.repeat(self.first[slots] - np.cumsum(counts) + counts, counts) + np.arange(int(counts.sum()))
        return counts, self.ids[place]


def pieces(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the pieces of lower-cased PLAIN text start and end: a contraction, a run of letters, a digit, a run of others."""
    kind = np.full(0x180, 1, dtype=np.int8)  # 0 white space, 1 letters, 2 digits, 3 others
    kind[:128] = [0 if c <= 32 else 1 if chr(c).isalpha() else 2 if chr(c).isdigit() else 3 for c in range(128)]
    own = kind[codes]
    before = np.concatenate((np.zeros(1, np.int8), own[:-1]))
    start = (own > 0) & ((own != before) | (own == 2))
    at = np.flatnonzero((codes == ord("'")) & (before != 3))
    if len(at):
        after = np.concatenate((codes, np.zeros(3, codes.dtype)))
        one, two = after[at + 1], after[at + 2]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = np.isin(one.astype(np.int64) << 16 | two, [ord(a) << 16 | ord(b) for a, b in ("re", "ve", "ll")])
        start[at[short | long] + 1] = False
        rest = np.concatenate((at[short] + 2, at[long] + 3))
        rest = rest[rest < len(codes)]
        start[rest] |= own[rest] > 0
    last = (own > 0) & np.concatenate((start[1:] | (own[1:] == 0), [True]))
    return np.flatnonzero(start), np.flatnonzero(last) + 1


class WordTokens:
    """Ids of a lower-case word vocabulary of below 2**16 ids; each piece of a text that is met again is encoded once.

    Its tokenizer merges within pieces only and drops white space, so a text's ids are those of its pieces in a row. Texts
    that hold other characters than PLAIN, or the start of a special token, are encoded as a whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer, self.table = Tokenizer.from_file(path), WordTable()
        size = self.tokenizer.get_vocab_size()
        if size > 1 << 16:
            raise ValueError("a vocabulary of below 2**16 ids is needed")
        self.ends = np.array([(self.tokenizer.id_to_token(n) or "").endswith("</w>") for n in range(size)])
        self.bare = Tokenizer.from_file(path)  # for pieces that are normalised and cut already
        self.bare.normalizer = normalizers.Sequence([])
        self.bare.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)

    def ids(self, text: str) -> bytes:
        """uint32 ids of a text."""
        return self.ids_of([text])[0]

    def ids_of(self, texts: list[str]) -> list[bytes]:
        """uint32 ids of each of some texts of about STEP characters; a longer text goes in parts, cut after white space."""
        out: list[list[bytes]] = [[] for _ in texts]
        parts: list[str] = []
        owner: list[int] = []
        for n, text in enumerate(texts):
            if "<|" in text or not PLAIN.fullmatch(text):
                out[n].append(np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes())
                continue
            start = 0
            while start < len(text):
                space = SPACE.search(text, start + STEP) if len(text) - start > STEP else None
                end = space.end() if space else len(text)
                parts.append(text[start:end].lower())
                owner.append(n)
                start = end
                if end < len(text):
                    self._spell(parts, owner, out)
                    parts, owner = [], []
        self._spell(parts, owner, out)
        return [b"".join(x) for x in out]

    def _spell(self, parts: list[str], owner: list[int], out: list[list[bytes]]) -> None:
        if not parts:
            return
        whole = "\n".join(parts)
        codes = np.frombuffer(whole.encode("utf-32-le"), dtype="<u4")
        start, end = pieces(codes)
        hashes = np.maximum(hash_spans(codes, start, end)[0], np.uint64(1))
        sizes = (end - start).astype(np.int32)
        table = self.table
        table.make_room()
        slots = table.find(hashes, sizes)
        while len(unknown := np.flatnonzero(slots < 0)):
            _, first = np.unique(hashes[unknown], return_index=True)
            new = unknown[first]
            table.add(hashes[new], sizes[new], self._learn([whole[a:b] for a, b in zip(start[new].tolist(), end[new].tolist())]))
            slots[unknown] = table.find(hashes[unknown], sizes[unknown])
        counts, ids = table.spell(slots)
        ends = np.cumsum([len(p) + 1 for p in parts])
        cuts = np.concatenate(([0], np.cumsum(counts)))[np.searchsorted(start, ends)].tolist()
        ids = ids.astype("<u4")
        for n, a, b in zip(owner, [0, *cuts], cuts):
            out[n].append(ids[a:b].tobytes())

    def _learn(self, words: list[str]) -> list[np.ndarray]:
        """The ids of different pieces; the last id of each, and no other, ends a word."""
        ids = np.array(self.bare.encode_batch_fast([words], is_pretokenized=True, add_special_tokens=False)[0].ids, dtype=np.uint16)
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(words):
            raise ValueError("the vocabulary doesn't mark where words end")
        return np.split(ids, cuts[:-1])


class ByteTokens:
    """Ids of a byte-level vocabulary of ranks; the strings of special tokens are ordinary text."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.encoding.encode_ordinary(text), dtype="<u2")
