"""Progressive JPEG in numpy: many images at once.

Entropy coding is sequential within a restart interval only. The decoder therefore treats the restart intervals of all
images at hand as lanes and decodes one symbol of every lane in each numpy step; a file without restart intervals is one
lane a scan. Spectral-selection and successive-approximation scans accumulate into coefficient arrays, which are
inverse-transformed by one exact integer-valued matrix product.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np

SAMPLING = ((2, 2), (1, 1), (1, 1))  # of the encoder: 4:2:0
MCU_BLOCKS = 6
INTERVAL = 4
BANDS = ((1, 20), (21, 63))

#: The zigzag order of the 64 frequencies.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))

SCALE = 13


def inverse_matrix() -> np.ndarray:
    """64 zigzag coefficients to 64 samples, times 2**SCALE and rounded, so that sums in float64 are exact."""
    x, u = np.arange(8)[:, None], np.arange(8)[None, :]
    basis = np.cos((2 * x + 1) * u * np.pi / 16) * np.where(u == 0, np.sqrt(0.125), 0.5)
    full = np.einsum("yv,xu->vuyx", basis, basis).reshape(64, 64)
    return np.round(full * (1 << SCALE))[ZIGZAG]


INVERSE = inverse_matrix()


def huffman_lengths(ac: bool) -> list[tuple[int, int]]:
    """(symbol, code length) of the encoder's tables, by rule: what text bytes need is short, all else is possible."""
    if not ac:
        return [(s, 4) for s in range(12)]
    short = [size for size in range(1, 11)]
    return [(s, 4) for s in short] + [(0, 5)] + [(s, 10) for s in range(1, 256) if s not in short]


def canonical(lengths: list[tuple[int, int]]) -> tuple[dict[int, tuple[int, int]], bytes]:
    """Codes by symbol, and the table as its segment holds it."""
    ordered = sorted(lengths, key=lambda x: x[1])
    codes, code, last = {}, 0, ordered[0][1]
    for symbol, length in ordered:
        code <<= length - last
        codes[symbol], last = (code, length), length
        code += 1
    counts = bytes(sum(n == k for _, n in ordered) for k in range(1, 17))
    return codes, counts + bytes(s for s, _ in ordered)


DC_CODES, DC_TABLE = canonical(huffman_lengths(False))
AC_CODES, AC_TABLE = canonical(huffman_lengths(True))


def as_arrays(codes: dict[int, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    code, length = np.zeros(256, dtype=np.int32), np.zeros(256, dtype=np.int32)
    for s, (c, n) in codes.items():
        code[s], length[s] = c, n
    return code, length


DC_CODE, DC_LENGTH = as_arrays(DC_CODES)
AC_CODE, AC_LENGTH = as_arrays(AC_CODES)
BIT_SIZE = np.array([int(n).bit_length() for n in range(1 << 12)], dtype=np.int32)


# ---------------------------------------------------------------- encoder


def magnitude(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sizes, and the bits that follow a symbol of that size."""
    size = BIT_SIZE[np.abs(values)]
    return size, np.where(values < 0, values + (np.int32(1) << size) - np.int32(1), values)


def pack_lanes(codes: np.ndarray, lengths: np.ndarray, lane: np.ndarray, lanes: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all lanes in a row, each filled up with ones, and the number of bytes of each; entries are in order."""
    after = np.cumsum(lengths, dtype=np.int64)
    entries = np.bincount(lane, minlength=lanes)
    total = np.concatenate(([0], after))[np.concatenate(([0], np.cumsum(entries)))]
    bits = np.diff(total)
    sizes = -(-bits // 8)
    ends = np.cumsum(sizes)
    start = after - lengths + np.repeat(8 * (ends - sizes) - total[:-1], entries)
    word, left = start >> 6, (64 - (start & 63)).astype(np.int32) - lengths
    over = np.flatnonzero(left < 0)
    code = codes.astype(np.uint64)
    high = code << (left & 63).astype(np.uint64)
    high[over] = code[over] >> (-left[over]).astype(np.uint64)
    out = np.zeros(int(ends[-1] if lanes else 0) // 8 + 2, dtype=np.uint64)
    if len(word):
        first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        out[word[first]] = np.bitwise_or.reduceat(high, first)
        out[word[over] + 1] |= code[over] << (64 + left[over]).astype(np.uint64)
    data = out.byteswap().view(np.uint8)[: int(ends[-1]) if lanes else 0]
    some = sizes > 0
    data[ends[some] - 1] |= ((1 << (8 * sizes - bits)[some]) - 1).astype(np.uint8)
    return data, sizes


def mark_lanes(data: np.ndarray, sizes: np.ndarray, scans: np.ndarray) -> list[bytes]:
    """Entropy-coded data of each scan: stuffing after 0xFF, restart markers between lanes. scans: lanes of each."""
    first = np.cumsum(scans) - scans
    number = np.arange(len(sizes)) - np.repeat(first, scans)
    markers, ends = np.cumsum(number > 0), np.cumsum(sizes)
    full = np.flatnonzero(data == 0xFF)
    stuffed = np.searchsorted(full, ends)  # zeros put in up to the end of each lane
    out = np.zeros(len(data) + len(full) + 2 * int(markers[-1] if len(markers) else 0), dtype=np.uint8)
    own = np.ones(len(out), dtype=bool)
    own[full + 1 + np.arange(len(full)) + 2 * markers[np.searchsorted(ends, full, side="right")]] = False
    begin = ends - sizes + np.concatenate(([0], stuffed[:-1])) + 2 * markers
    marked = np.flatnonzero(number > 0)
    own[begin[marked] - 2] = own[begin[marked] - 1] = False
    out[own] = data
    out[begin[marked] - 2], out[begin[marked] - 1] = 0xFF, 0xD0 + (number[marked] - 1) % 8
    raw, end = out.tobytes(), ends + stuffed + 2 * markers
    begin = begin - 2 * (number > 0)
    return [raw[begin[f] : end[f + n - 1]] for f, n in zip(first.tolist(), scans.tolist())]


def lanes_of(blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lane of each block, for images of so many blocks each, and the lanes of each image."""
    per = -(-blocks // INTERVAL)
    number = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    return np.repeat(np.cumsum(per) - per, blocks) + number // INTERVAL, per


def encode_first(values: np.ndarray, lane: np.ndarray, lanes: int) -> tuple[np.ndarray, np.ndarray]:
    """First scan of a band; values: blocks x band, point-transformed."""
    block, k = np.nonzero(values)
    value = values[block, k]
    fresh = np.concatenate(([True], block[1:] != block[:-1])) if len(block) else np.zeros(0, bool)
    run = k - np.where(fresh, -1, np.concatenate(([-1], k[:-1]))) - 1
    size, bits = magnitude(value)
    long = run // 16
    each = long + 1
    per_block = np.bincount(block, minlength=len(values)) if not long.any() else np.bincount(block, weights=each, minlength=len(values)).astype(np.int64)
    last = np.full(len(values), -1)
    last[block] = k
    ends = last < values.shape[1] - 1
    total = per_block + ends
    base = np.cumsum(total) - total
    own = base[block] + (np.cumsum(each) - each) - (np.cumsum(per_block) - per_block)[block] + long
    n = int(total.sum())
    codes, lengths = np.full(n, AC_CODE[0xF0]), np.full(n, AC_LENGTH[0xF0])
    symbol = (run % 16 << 4) + size
    codes[own], lengths[own] = AC_CODE[symbol] << size | bits, AC_LENGTH[symbol] + size
    stop = (base + per_block)[ends]
    codes[stop], lengths[stop] = AC_CODE[0], AC_LENGTH[0]
    return pack_lanes(codes, lengths, np.repeat(lane, total), lanes)


def encode_refine(values: np.ndarray, lane: np.ndarray, lanes: int) -> tuple[np.ndarray, np.ndarray]:
    """Refinement of a band from bit 1 to bit 0; values: blocks x band."""
    size = np.abs(values)
    old, new = size > 1, size == 1
    news, count = new.sum(axis=1), old.sum(axis=1)
    last = np.where(news > 0, values.shape[1] - 1 - np.argmax(new[:, ::-1], axis=1), -1)
    total = news + count + (last < values.shape[1] - 1)
    others = {b: refine_block(values[b]) for b in np.flatnonzero(news > 0).tolist()}
    for b, entries in others.items():
        total[b] = len(entries)
    # blocks without new coefficients: the end of the band, then a bit for each old one
    plain = news == 0
    used = np.concatenate((np.ones((int(plain.sum()), 1), bool), old[plain]), axis=1)
    code = np.concatenate((np.full((len(used), 1), AC_CODE[0]), size[plain] & 1), axis=1)[used]
    length = np.concatenate((np.full((len(used), 1), AC_LENGTH[0]), np.ones_like(size[plain])), axis=1)[used]
    if others:
        base, own = np.cumsum(total) - total, total[plain]
        codes, lengths = np.zeros(int(total.sum()), dtype=np.int32), np.zeros(int(total.sum()), dtype=np.int32)
        at = np.repeat(base[plain] - (np.cumsum(own) - own), own) + np.arange(own.sum())
        codes[at], lengths[at] = code, length
        for b, entries in others.items():
            codes[base[b] : base[b] + len(entries)], lengths[base[b] : base[b] + len(entries)] = zip(*entries)
        code, length = codes, lengths
    return pack_lanes(code, length, np.repeat(lane, total), lanes)


def refine_block(values: np.ndarray) -> list[tuple[int, int]]:
    """(code, length) entries of one block, for blocks with new coefficients."""
    out, held, run = [], [], 0
    ones = np.flatnonzero(np.abs(values) == 1)
    last = int(ones[-1]) if len(ones) else -1
    for k, v in enumerate(values.tolist()):
        if v == 0:
            run += 1
            continue
        while run > 15 and k <= last:
            out += [AC_CODES[0xF0], *held]
            held, run = [], run - 16
        if abs(v) > 1:
            held.append((abs(v) & 1, 1))
        else:
            code, length = AC_CODES[(run << 4) + 1]
            out += [(code << 1 | (v > 0), length + 1), *held]
            held, run = [], 0
    return [*out, AC_CODES[0], *held] if run or held else out


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def encode(coefficients: np.ndarray, mcus: np.ndarray, comments: list[bytes]) -> list[bytes]:
    """Images 16 pixels wide of so many MCUs each; coefficients: MCUs x 6 blocks x 64 in zigzag order, within +-1023."""
    values = coefficients.astype(np.int32)
    parts = [values[:, :4].reshape(-1, 64), values[:, 4], values[:, 5]]
    counts = [4 * mcus, mcus, mcus]
    lane_ids = [lanes_of(c) for c in counts]
    scans: list[list[bytes]] = []
    heads: list[bytes] = []

    def scan(components: list[int], low: int, high: int, was: int, now: int, data: np.ndarray, sizes: np.ndarray, per: np.ndarray) -> None:
        heads.append(segment(0xDA, bytes([len(components), *(x for c in components for x in (c + 1, 0)), low, high, was << 4 | now])))
        scans.append(mark_lanes(data, sizes, per))

    lane, per = lanes_of(mcus)
    order = values[:, :, 0] >> 1
    fresh = np.concatenate(([True], lane[1:] != lane[:-1])) if len(lane) else np.zeros(0, bool)
    previous = np.where(fresh[:, None], 0, np.concatenate((np.zeros((1, 6), np.int32), order[:-1])))
    diff = order.copy()
    diff[:, 1:4] -= order[:, :3]
    diff[:, 0] -= previous[:, 3]
    diff[:, 4:] -= previous[:, 4:]
    size, bits = magnitude(diff.ravel())
    data, sizes = pack_lanes(DC_CODE[size] << size | bits, DC_LENGTH[size] + size, np.repeat(lane, 6), int(per.sum()))
    scan([0, 1, 2], 0, 0, 0, 1, data, sizes, per)
    shifted = [np.sign(p) * (np.abs(p) >> 1) for p in parts]
    for low, high in BANDS:
        for c in range(3):
            scan([c], low, high, 0, 1, *encode_first(shifted[c][:, low : high + 1], lane_ids[c][0], int(lane_ids[c][1].sum())), lane_ids[c][1])
    for c in range(3):
        scan([c], 1, 63, 1, 0, *encode_refine(parts[c][:, 1:], lane_ids[c][0], int(lane_ids[c][1].sum())), lane_ids[c][1])
    ones = np.ones(6 * len(values), dtype=np.int32)
    data, sizes = pack_lanes((values[:, :, 0] & 1).ravel(), ones, np.repeat(lane, 6), int(per.sum()))
    scan([0, 1, 2], 0, 0, 1, 0, data, sizes, per)
    tables = segment(0xDB, b"\0" + b"\1" * 64) + segment(0xC4, b"\0" + DC_TABLE + b"\x10" + AC_TABLE) + segment(0xDD, struct.pack(">H", INTERVAL))
    out = []
    for n, (count, comment) in enumerate(zip(mcus.tolist(), comments)):
        frame = struct.pack(">BHHB", 8, 16 * count, 16, 3) + bytes(x for c, (h, v) in enumerate(SAMPLING) for x in (c + 1, h << 4 | v, 0))
        out.append(b"\xff\xd8" + segment(0xFE, comment) + tables + segment(0xC2, frame) + b"".join(h + s[n] for h, s in zip(heads, scans)) + b"\xff\xd9")
    return out


# ---------------------------------------------------------------- decoder


@dataclass
class Scan:
    components: tuple[int, ...]
    low: int
    high: int
    was: int
    now: int
    tables: tuple[bytes, ...]  # the Huffman table of each component: DC tables for low 0, else the AC table
    interval: int
    data: np.ndarray = field(repr=False)

    @property
    def kind(self) -> tuple:
        return self.low, self.high, self.was, self.now, self.tables, self.interval, self.components if len(self.components) > 1 else None


@dataclass
class Image:
    width: int = 0
    height: int = 0
    sampling: tuple[tuple[int, int], ...] = ()
    quantisers: tuple[bytes, ...] = ()
    scans: list[Scan] = field(default_factory=list)
    comment: bytes = b""

    @property
    def grid(self) -> tuple[int, int]:
        """MCUs down and across."""
        h, v = max(s[0] for s in self.sampling), max(s[1] for s in self.sampling)
        return -(-self.height // (8 * v)), -(-self.width // (8 * h))


def parse(data: bytes) -> list[Image]:
    """The images of a stream of progressive JPEG files, one after another."""
    raw = np.frombuffer(data, dtype=np.uint8)
    at = np.flatnonzero(raw[:-1] == 0xFF)
    follows = raw[at + 1]
    markers = at[(follows != 0) & ((follows < 0xD0) | (follows > 0xD7)) & (follows != 0xFF)].tolist()
    images, tables, quantisers, ids, interval, image = [], {}, {}, [], 0, Image()
    place, n = 0, 0
    while n < len(markers):
        m = markers[n]
        n += 1
        if m < place:
            continue
        kind = data[m + 1]
        if kind == 0xD8:
            image, tables, quantisers, interval = Image(), {}, {}, 0
            continue
        if kind == 0xD9:
            images.append(image)
            continue
        size = struct.unpack_from(">H", data, m + 2)[0]
        body, place = data[m + 4 : m + 2 + size], m + 2 + size
        if kind == 0xFE:
            image.comment = body
        elif kind == 0xDB:
            while body:
                wide = body[0] >> 4
                quantisers[body[0] & 15] = body[1 : 65 + 64 * wide] if not wide else bytes(min(255, x) for x in struct.unpack(">64H", body[1:129]))
                body = body[65 + 64 * wide :]
        elif kind == 0xC4:
            while body:
                count = sum(body[1:17])
                tables[body[0]] = bytes(body[1 : 17 + count])
                body = body[17 + count :]
        elif kind == 0xDD:
            interval = struct.unpack(">H", body)[0]
        elif kind == 0xC2:
            image.height, image.width, count = struct.unpack_from(">HHB", body, 1)
            ids = [body[6 + 3 * c] for c in range(count)]
            image.sampling = tuple((body[7 + 3 * c] >> 4, body[7 + 3 * c] & 15) for c in range(count))
            image.quantisers = tuple(bytes(quantisers[body[8 + 3 * c]]) for c in range(count))
        elif kind in (0xC0, 0xC1, 0xC3, 0xC9, 0xCA):
            raise ValueError("not a progressive Huffman-coded JPEG")
        elif kind == 0xDA:
            count = body[0]
            chosen = [(ids.index(body[1 + 2 * c]), body[2 + 2 * c]) for c in range(count)]
            low, high, point = body[-3:]
            while n < len(markers) and markers[n] < place:
                n += 1
            end = markers[n] if n < len(markers) else len(data)
            if point >> 4 and not low:
                own = ()
            elif low:
                own = (tables[0x10 | chosen[0][1] & 15],)
            else:
                own = tuple(tables[t >> 4] for _, t in chosen)
            image.scans.append(Scan(tuple(c for c, _ in chosen), low, high, point >> 4, point & 15, own, interval, raw[place:end]))
            place = end
    return images


_LOOKUPS: dict[bytes, np.ndarray] = {}


def lookup(table: bytes) -> np.ndarray:
    """For each 16 bits: length of the code they begin with << 8 | its symbol."""
    if table not in _LOOKUPS:
        out, code, at = np.zeros(1 << 16, dtype=np.int64), 0, 16
        for length in range(1, 17):
            for _ in range(table[length - 1]):
                out[code << 16 - length : (code + 1) << 16 - length] = length << 8 | table[at]
                code, at = code + 1, at + 1
            code <<= 1
        _LOOKUPS[table] = out
    return _LOOKUPS[table]


class Bits:
    """The bits of many lanes: bytes in a row, and for each lane the next bit."""

    def __init__(self, scans: list[np.ndarray]):
        data = np.concatenate([*scans, np.zeros(1, np.uint8)])
        first = np.cumsum([0, *map(len, scans)])[:-1]
        full = np.flatnonzero(data[:-1] == 0xFF)
        after = data[full + 1]
        drop = np.zeros(len(data), bool)
        drop[full[after == 0] + 1] = True
        restarts = full[(after >= 0xD0) & (after <= 0xD7)]
        drop[restarts] = drop[restarts + 1] = True
        kept = np.cumsum(~drop) - ~drop
        starts = np.sort(np.concatenate((first, restarts + 2)))
        self.lanes = np.diff(np.searchsorted(starts, [*first, len(data)])).tolist()
        self.raw = np.concatenate((data[~drop], np.full(16, 255, np.uint8)))
        self.words = np.ndarray((len(self.raw) - 8,), dtype=">u8", buffer=self.raw, strides=(1,))
        self.at = 8 * kept[np.minimum(starts, len(data) - 1)].astype(np.int64)
        self.end = 8 * (len(self.raw) - 16)

    def peek(self, lanes: np.ndarray) -> np.ndarray:
        at = np.minimum(self.at[lanes], self.end)
        return self.words[at >> 3].astype(np.uint64) << (at & 7).astype(np.uint64)


def take(word: np.ndarray, skip: np.ndarray, size: np.ndarray) -> np.ndarray:
    """`size` bits of word after `skip` bits, as int64."""
    return ((word << skip.astype(np.uint64)) >> np.uint64(1) >> (63 - size).astype(np.uint64)).astype(np.int64)


def extend(bits: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(bits < (1 << size >> 1), bits - (1 << size) + 1, bits)


def first_dc(bits: Bits, lanes: np.ndarray, table: np.ndarray) -> np.ndarray:
    word = bits.peek(lanes)
    entry = table[(word >> np.uint64(48)).astype(np.int64)]
    length, size = entry >> 8, entry & 255
    bits.at[lanes] += length + size
    return extend(take(word, length, size), size)


def first_ac(bits: Bits, lanes: np.ndarray, runs: np.ndarray, flat: np.ndarray, base: np.ndarray, low: int, high: int, now: int, table: np.ndarray) -> None:
    """One block of each lane; flat[base + k] is coefficient k; runs: blocks each lane still has to leave out."""
    idle = runs[lanes] > 0
    runs[lanes[idle]] -= 1
    lanes, base = lanes[~idle], base[~idle]
    k = np.full(len(lanes), low)
    while len(lanes):
        word = bits.peek(lanes)
        entry = table[(word >> np.uint64(48)).astype(np.int64)]
        length, run, size = entry >> 8, entry >> 4 & 15, entry & 15
        none = size == 0
        if none.any():
            stop = none & (run < 15)
            more = np.where(stop, run, size)
            value = take(word, length, more)
            runs[lanes[stop]] = (1 << run[stop]) + value[stop] - 1
            bits.at[lanes] += length + more
            k += run
            found = ~none & (k <= high)
            flat[base[found] + k[found]] = extend(value[found], size[found]) << now
            k += 1
            left = ~stop & (k <= high)
        else:
            bits.at[lanes] += length + size
            k += run
            value = extend(take(word, length, size), size) << now
            if (k <= high).all():
                flat[base + k] = value
            else:
                good = k <= high
                flat[base[good] + k[good]] = value[good]
            k += 1
            left = k <= high
        if not left.all():
            lanes, base, k = lanes[left], base[left], k[left]


def refine_ac(bits: Bits, lanes: np.ndarray, runs: np.ndarray, flat: np.ndarray, base: np.ndarray, low: int, high: int, now: int, table: np.ndarray) -> None:
    """One block of each lane, of a refinement scan."""
    bit = 1 << now
    stopped = np.where(runs[lanes] > 0, low, high + 1)  # from here on only corrections
    live = np.flatnonzero(stopped > high)
    waits, value = np.full(len(lanes), -1), np.zeros(len(lanes), dtype=np.int64)
    for k in range(low, high + 1):
        if not len(live):
            break
        ask = live[waits[live] < 0]
        if len(ask):
            own = lanes[ask]
            word = bits.peek(own)
            entry = table[(word >> np.uint64(48)).astype(np.int64)]
            length, run, size = entry >> 8, entry >> 4 & 15, entry & 15
            stop = (size == 0) & (run < 15)
            more = np.where(stop, run, size)
            got = take(word, length, more)
            bits.at[own] += length + more
            runs[own[stop]] = (1 << run[stop]) + got[stop]
            stopped[ask[stop]] = k
            waits[ask] = run
            value[ask] = np.where(size == 0, 0, np.where(got > 0, bit, -bit))
            if stop.any():
                live = live[stopped[live] > high]
        at = base[live] + k
        held = flat[at]
        old = held != 0
        if old.any():
            own = lanes[live[old]]
            word = bits.peek(own)
            bits.at[own] += 1
            add = ((word >> np.uint64(63)) > 0) & (np.abs(held[old]) & bit == 0)
            flat[at[old]] = held[old] + np.where(add, np.sign(held[old]) * bit, 0).astype(flat.dtype)
        empty = live[~old]
        done = empty[waits[empty] == 0]
        flat[base[done] + k] = value[done]
        waits[empty] -= 1
    ended = np.flatnonzero(stopped <= high)
    if len(ended):
        span = np.arange(low, high + 1)
        at = base[ended][:, None] + span
        held = flat[at]
        old = (held != 0) & (span >= stopped[ended][:, None])
        place = bits.at[lanes[ended]][:, None] + np.cumsum(old, axis=1) - old
        place = np.minimum(place, bits.end)
        one = (bits.raw[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1
        add = old & (one == 1) & (np.abs(held) & bit == 0)
        flat[at] = held + np.where(add, np.sign(held) * bit, 0).astype(flat.dtype)
        bits.at[lanes[ended]] += old.sum(axis=1)
        runs[lanes[ended]] -= 1


def block_order(image: Image, components: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, int]:
    """Component (place in components) and block number, in the order of a scan, and the blocks of one MCU of it."""
    down, across = image.grid
    if len(components) == 1:
        c = components[0]
        h, v = image.sampling[c]
        top_h, top_v = max(s[0] for s in image.sampling), max(s[1] for s in image.sampling)
        rows, columns = -(-(-(-image.height * v // top_v)) // 8), -(-(-(-image.width * h // top_h)) // 8)
        order = (np.arange(rows)[:, None] * (across * h) + np.arange(columns)).ravel()
        return np.zeros(len(order), dtype=np.int64), order, 1
    which, order = [], []
    for place, c in enumerate(components):
        h, v = image.sampling[c]
        y, x = np.arange(down)[:, None, None, None] * v, np.arange(across)[None, :, None, None] * h
        own = ((y + np.arange(v)[None, None, :, None]) * (across * h) + x + np.arange(h)).reshape(down * across, v * h)
        order.append(own)
        which.append(np.full_like(own, place))
    order, which = np.concatenate(order, axis=1), np.concatenate(which, axis=1)
    return which.ravel(), order.ravel(), order.shape[1]


def decode_coefficients(images: list[Image]) -> list[list[np.ndarray]]:
    """For each image and component: blocks x 64 coefficients in zigzag order, accumulated over all scans."""
    sizes = [[i.grid[0] * v * i.grid[1] * h for h, v in i.sampling] for i in images]
    offsets = np.cumsum([0, *(n for s in sizes for n in s)])
    flat = np.zeros(64 * int(offsets[-1]), dtype=np.int32)
    first, n = [], 0
    for s in sizes:
        first.append(offsets[n : n + len(s)])
        n += len(s)
    done, orders = [0] * len(images), {}
    while any(d < len(i.scans) for d, i in zip(done, images)):
        # one kind of scan at a time, of all images that have it next; of one image, scans of different components
        kind = next(i.scans[d].kind for d, i in zip(done, images) if d < len(i.scans))
        batch: list[tuple[int, Scan]] = []
        for n, image in enumerate(images):
            used: set[int] = set()
            while done[n] < len(image.scans) and image.scans[done[n]].kind == kind and not used & {*image.scans[done[n]].components}:
                used |= {*image.scans[done[n]].components}
                batch.append((n, image.scans[done[n]]))
                done[n] += 1
        decode_scans(kind, batch, images, first, flat, orders)
    return [[flat[64 * a : 64 * (a + m)].reshape(m, 64) for a, m in zip(f.tolist(), s)] for f, s in zip(first, sizes)]


def decode_scans(kind: tuple, batch: list[tuple[int, Scan]], images: list[Image], first: list[np.ndarray], flat: np.ndarray, orders: dict) -> None:
    low, high, was, now, tables, interval, _ = kind
    bits = Bits([s.data for _, s in batch])
    blocks, whiches, starts, counts = [], [], [], []
    total = 0
    per = 1
    for (n, scan), lanes in zip(batch, bits.lanes):
        shape = (images[n].grid, images[n].height, images[n].width, images[n].sampling, scan.components)
        if shape not in orders:
            orders[shape] = block_order(images[n], scan.components)
        which, order, per = orders[shape]
        blocks.append(64 * (first[n][list(scan.components)][which] + order))
        whiches.append(which)
        step = interval * per if interval else len(order)
        begin = np.minimum(np.arange(lanes) * step, len(order))
        starts.append(total + begin)
        counts.append(np.minimum(len(order) - begin, step))
        total += len(order)
    block, which, start, count = (np.concatenate(x) for x in (blocks, whiches, starts, counts))
    runs, last = np.zeros(len(start), dtype=np.int64), np.zeros((len(start), max(which, default=0) + 1), dtype=np.int64)
    looked = [lookup(t) for t in tables]
    for step in range(int(count.max(initial=0))):
        lanes = np.flatnonzero(count > step)
        at = start[lanes] + step
        base = block[at]
        if low:
            (refine_ac if was else first_ac)(bits, lanes, runs, flat, base, low, high, now, looked[0])
        elif was:
            word = bits.peek(lanes)
            bits.at[lanes] += 1
            flat[base] |= ((word >> np.uint64(63)).astype(np.int32)) << now
        else:
            place = int(which[at[0]])  # all lanes are at the same block of their MCU
            last[lanes, place] += first_dc(bits, lanes, looked[place])
            flat[base] = last[lanes, place] << now


def to_rgb(images: list[Image], coefficients: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Full-resolution height x width x 3 tensors; images of one width and layout go together."""
    groups: dict[tuple, list[int]] = {}
    for n, i in enumerate(images):
        groups.setdefault((i.width, i.sampling, i.quantisers), []).append(n)
    out: list[np.ndarray] = [None] * len(images)
    for (width, sampling, quantisers), members in groups.items():
        across = images[members[0]].grid[1]
        top_h, top_v = max(s[0] for s in sampling), max(s[1] for s in sampling)
        planes = []
        for c, (h, v) in enumerate(sampling):
            values = np.concatenate([coefficients[n][c] for n in members]) * np.frombuffer(quantisers[c], dtype=np.uint8).astype(np.int32)
            samples = np.floor((values.astype(np.float64) @ INVERSE + (1 << SCALE - 1)) / (1 << SCALE)) + 128
            samples = np.clip(samples, 0, 255).astype(np.uint8).reshape(-1, across * h, 8, 8).transpose(0, 2, 1, 3).reshape(-1, across * h * 8)
            planes.append(samples.repeat(top_v // v, axis=0).repeat(top_h // h, axis=1).astype(np.int32))
        if len(planes) == 1:
            rgb = np.repeat(planes[0].astype(np.uint8)[..., None], 3, axis=2)
        else:
            y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
            red = y + (91881 * cr + 32768 >> 16)
            green = y - (22554 * cb + 46802 * cr + 32768 >> 16)
            blue = y + (116130 * cb + 32768 >> 16)
            rgb = np.clip(np.stack((red, green, blue), axis=-1), 0, 255).astype(np.uint8)
        row = 0
        for n in members:
            out[n] = rgb[row : row + images[n].height, :width]
            row += 8 * top_v * images[n].grid[0]
    return out
