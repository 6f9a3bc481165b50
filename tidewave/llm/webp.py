"""Media columns: the lossless WebP format (VP8L), read in full and written with its main tools.

`decode` reads any VP8L image: canonical prefix codes (simple and normal),
meta prefix codes, LZ77 back-references with the 2-D distance map, the colour
cache, and the inverse predictor, cross-colour, subtract-green and palette
transforms. Where one channel alone takes bits, tokens are read by array
operations: every bit position is looked up in the code's table, and the chain of
positions that tokens start at is followed from the first; all other images are
read symbol by symbol.

`encode` picks the transforms by the entropy that they leave (palette, subtract
green, cross-colour, a predictor), finds back-references by equal runs of pixels,
uses the colour cache where several channels vary, and writes prefix codes built
for the image.

Payloads become grey images of 64 x h pixels, a byte a pixel in the green channel,
at most 1 MB each; more follow as further RIFF files.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WIDTH = 64
MAX_HEIGHT = 16384
OPAQUE = 0xFF000000
# Fixed values of the format: order of code length codes; short distances as (x, y) steps.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
SHORT_DISTANCES = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
HASH_MULTIPLIER = 0x1E35A7BD
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)


class Bits:
    """Least significant bit first."""

    def __init__(self, data: bytes):
        self.data, self.at, self.value, self.have = data, 0, 0, 0

    def read(self, n: int) -> int:
        while self.have < n:
            chunk = self.data[self.at : self.at + 8]
            if not chunk:
                raise ValueError("the bit stream ends early")
            self.value |= int.from_bytes(chunk, "little") << self.have
            self.at += len(chunk)
            self.have += 8 * len(chunk)
        out = self.value & ((1 << n) - 1)
        self.value >>= n
        self.have -= n
        return out

    def peek(self, n: int) -> int:
        """The next n bits; zeros follow the end."""
        if self.have < n:
            chunk = self.data[self.at : self.at + n // 8 + 8]
            self.value |= int.from_bytes(chunk, "little") << self.have
            self.at += len(chunk)
            self.have += 8 * len(chunk)
        return self.value & ((1 << n) - 1)

    @property
    def position(self) -> int:
        return 8 * self.at - self.have

    def seek(self, bit: int) -> None:
        self.at, self.value, self.have = bit // 8, 0, 0
        self.read(bit % 8)


#: Every 16 bits reversed.
_REVERSED = np.packbits(np.unpackbits(np.arange(1 << 16, dtype=">u2").view(np.uint8).reshape(-1, 2), axis=1)[:, ::-1], axis=1).view(">u2").reshape(-1).astype(np.int64)


class Prefix:
    """A canonical prefix code; one used symbol takes no bits."""

    def __init__(self, lengths: list[int]):
        n = np.array(lengths, np.int64)
        used = np.flatnonzero(n)
        if not len(used):
            raise ValueError("a prefix code without symbols")
        self.only = int(used[0]) if len(used) == 1 else None
        self.symbols = used[np.argsort(n[used], kind="stable")]
        self.bits = n[self.symbols]
        self.top = int(self.bits[-1])
        share = 1 << (self.top - self.bits)
        ends = np.cumsum(share)
        self.code = (ends - share) >> (self.top - self.bits)
        if self.only is None and ends[-1] != 1 << self.top:
            raise ValueError("an incomplete prefix code")
        #: The codes as the stream holds them, first bit lowest.
        self.written = _REVERSED[self.code << (16 - self.bits)]

    @functools.cached_property
    def codes(self) -> dict[tuple[int, int], int]:
        """{(length, code): symbol}."""
        return {(n, c): s for n, c, s in zip(self.bits.tolist(), self.code.tolist(), self.symbols.tolist())}

    @functools.cached_property
    def lookup(self) -> np.ndarray:
        """symbol << 4 | bits, by the stream's next `top` bits."""
        # in the order of codes the table is runs; the stream's order is that with its bits reversed
        runs = np.repeat((self.symbols << 4 | self.bits).astype(np.uint16), 1 << (self.top - self.bits))
        return runs[_REVERSED[: 1 << self.top] >> (16 - self.top)]

    @functools.cached_property
    def table(self) -> tuple[list[int], int]:
        """(symbol << 4 | bits by the stream's next bits, the number of bits looked at)."""
        return ([self.only << 4], 0) if self.only is not None else (self.lookup.tolist(), self.top)

    def read(self, bits: Bits) -> int:
        if self.only is not None:
            return self.only
        if bits.have < 15:
            bits.peek(15)
        if bits.have >= 15:
            # one look at the table; the last bits of a stream are read singly
            table, top = self.table
            v = table[bits.value & ((1 << top) - 1)]
            bits.value >>= v & 15
            bits.have -= v & 15
            return v >> 4
        n = code = 0
        while n < 16:
            code = code << 1 | bits.read(1)
            n += 1
            if (n, code) in self.codes:
                return self.codes[n, code]
        raise ValueError("no such prefix code")


@functools.lru_cache(512)
def _prefix(lengths: tuple[int, ...]) -> Prefix:
    return Prefix(list(lengths))


def read_prefix(bits: Bits, size: int) -> Prefix:
    """The code that the stream holds."""
    if bits.read(1):
        count = bits.read(1) + 1
        first = bits.read(8 if bits.read(1) else 1)
        symbols = [first] + ([bits.read(8)] if count == 2 else [])
        lengths = [0] * max(size, max(symbols) + 1)
        for s in symbols:
            lengths[s] = 1
        return _prefix(tuple(lengths))
    of_lengths = [0] * 19
    for i in range(4 + bits.read(4)):
        of_lengths[LENGTH_ORDER[i]] = bits.read(3)
    code = _prefix(tuple(of_lengths))
    most = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    lengths: list[int] = []
    last = 8
    table, top = code.table
    mask = (1 << top) - 1
    while len(lengths) < size and most:
        most -= 1
        if bits.have < 15:
            bits.peek(15)
        if bits.have >= 15:
            v = table[bits.value & mask]
            bits.value >>= v & 15
            bits.have -= v & 15
            s = v >> 4
        else:
            s = code.read(bits)
        if s < 16:
            lengths.append(s)
            last = s or last
        else:
            times, value = (3 + bits.read(2), last) if s == 16 else (3 + bits.read(3), 0) if s == 17 else (11 + bits.read(7), 0)
            lengths += [value] * times
    if len(lengths) > size:
        raise ValueError("too many code lengths")
    return _prefix(tuple(lengths + [0] * (size - len(lengths))))


def _extra(bits: Bits, symbol: int) -> int:
    """The value of a length or distance prefix symbol."""
    if symbol < 4:
        return symbol + 1
    n = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << n) + bits.read(n) + 1


def _block(n: int, bits: int) -> int:
    return (n + (1 << bits) - 1) >> bits


def read_pixels(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """ARGB as uint32, row by row, of an entropy-coded image."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("the colour cache is too large")
    meta, meta_bits = None, 0
    if main and bits.read(1):
        meta_bits = bits.read(3) + 2
        meta = (read_pixels(bits, _block(width, meta_bits), _block(height, meta_bits), False) >> 8) & 0xFFFF
    sizes = (256 + 24 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    groups = [[read_prefix(bits, n) for n in sizes] for _ in range(1 + (int(meta.max()) if meta is not None else 0))]
    total = width * height
    if meta is None and main and not cache_bits and all(g.only is not None for g in groups[0][1:4]):
        return _one_channel(bits, groups[0], width, total)
    out = [0] * total
    cache = [0] * (1 << cache_bits) if cache_bits else None
    shift, columns = 32 - cache_bits, _block(width, meta_bits)
    at = 0
    while at < total:
        group = groups[int(meta[(at // width >> meta_bits) * columns + (at % width >> meta_bits)])] if meta is not None else groups[0]
        s = group[0].read(bits)
        if s < 256:
            red, blue, alpha = (group[i].read(bits) for i in (1, 2, 3))
            new = [alpha << 24 | red << 16 | s << 8 | blue]
        elif s < 280:
            length, code = _extra(bits, s - 256), _extra(bits, group[4].read(bits))
            if code > 120:
                back = code - 120
            else:
                back = _near(width)[code - 1]
            if back > at or at + length > total:
                raise ValueError("a back-reference leaves the image")
            new = [out[at - back + i] if i < back else 0 for i in range(length)]
            for i in range(back, length):
                new[i] = new[i - back]
        else:
            new = [cache[s - 280]]
        out[at : at + len(new)] = new
        at += len(new)
        if cache is not None:
            for p in new:
                cache[(p * HASH_MULTIPLIER & 0xFFFFFFFF) >> shift] = p
    return np.array(out, np.uint32)


@functools.cache
def _near(width: int) -> list[int]:
    """The distances of the short codes in a row of so many pixels."""
    return [max(1, x + y * width) for x, y in SHORT_DISTANCES]


def _words(data: bytes) -> np.ndarray:
    """At each byte the 64 bits that follow, as a view; zeros follow the end."""
    return np.ndarray((len(data) + 16,), "<u8", data + b"\0" * 24, strides=(1,))


def _looked(code: Prefix) -> np.ndarray:
    """The code's lookup; for one symbol, which takes no bits, one of zero bits."""
    return code.lookup if code.only is None else np.full(1 << code.top, code.only << 4, np.uint16)


# Of every length or distance symbol: its extra bits, and its value when they are 0. Masks of so many bits.
_MORE = np.array([0 if s < 4 else (s - 2) >> 1 for s in range(40)])
_LEAST = np.array([s + 1 if s < 4 else ((2 + (s & 1)) << ((s - 2) >> 1)) + 1 for s in range(40)])
_MASK = (np.uint64(1) << np.arange(64, dtype=np.uint64)) - np.uint64(1)


def _bits_at(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    return words[at >> 3] >> (at & 7).view(np.uint64)


def _references(words: np.ndarray, at: np.ndarray, symbol: np.ndarray, distance: Prefix) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(length, distance code, position after) of back-references whose length symbols end at the bit positions."""
    more = _MORE[symbol]
    length = _LEAST[symbol] + (_bits_at(words, at) & _MASK[more]).view(np.int64)
    at = at + more
    seen = _looked(distance)[_bits_at(words, at) & _MASK[distance.top]].astype(np.int64)
    at += seen & 15
    symbol = seen >> 4
    more = _MORE[symbol]
    return length, _LEAST[symbol] + (_bits_at(words, at) & _MASK[more]).view(np.int64), at + more


def _one_channel(bits: Bits, group: list[Prefix], width: int, total: int) -> np.ndarray:
    """An image whose literals differ in green alone: literals and back-references by array operations."""
    green, distance = group[0], group[4]
    rest = group[3].only << 24 | group[1].only << 16 | group[2].only
    if green.only is not None and green.only < 256:
        return np.full(total, rest | green.only << 8, np.uint32)
    start = bits.position
    data, start = bits.data[start // 8 :], start % 8
    n = 8 * len(data)
    words = _words(data)
    near = words[: len(data)].astype(np.uint32)
    seen = _looked(green)[(near[:, None] >> np.arange(8, dtype=np.uint32)) & np.uint32((1 << green.top) - 1)].reshape(-1)
    follow = (seen & np.uint16(15)).astype(np.int32)
    follow += np.arange(n, dtype=np.int32)
    far = np.flatnonzero(seen >= 256 << 4)
    if len(far):
        # codes of the colour cache, which there is none of, are told below
        length, code, follow[far] = _references(words, follow[far].astype(np.int64), np.minimum((seen[far] >> 4).astype(np.int64) - 256, 39), distance)
    # the chain is followed eight tokens at a time, and filled in after
    np.minimum(follow, n, out=follow)
    follow = np.append(follow, np.int32(n))
    two = follow[follow]
    four = two[two]
    jump, chain, at = memoryview(four[four]), [], start
    add = chain.append
    while at < n:
        add(at)
        at = jump[at]
    chain = np.array(chain, np.int32)
    chain = np.stack([chain, follow[chain], two[chain], follow[two[chain]]], 1)
    chain = np.concatenate([chain, four[chain]], 1).reshape(-1).astype(np.int64)
    chain = chain[: int(np.searchsorted(chain, n))]
    symbol = (seen[chain] >> 4).astype(np.int64)
    ref = np.flatnonzero(symbol > 255)
    pixels = np.ones(len(chain), np.int64)
    if len(ref):
        place = np.searchsorted(far, chain[ref])
        pixels[ref], code = length[place], code[place]
    else:
        code = ref
    ends = np.cumsum(pixels)
    last = int(np.searchsorted(ends, total)) + 1
    if last > len(chain) or ends[last - 1] != total:
        raise ValueError("the bit stream ends early or a back-reference leaves the image")
    starts = ends - pixels
    few = int(np.searchsorted(ref, last))
    ref, code = ref[:few], code[:few]
    back = np.where(code > 120, code - 120, np.array(_near(width))[np.minimum(code, 120) - 1])
    if (symbol[:last] > 279).any() or (back > starts[ref]).any():
        raise ValueError("a back-reference leaves the image")
    out = np.zeros(total, np.uint8)
    plain = np.flatnonzero(symbol[:last] < 256)
    out[starts[plain]] = symbol[plain]
    out = bytearray(out.tobytes())
    for o, k, d in zip(starts[ref].tolist(), pixels[ref].tolist(), back.tolist()):
        piece = out[o - d : o - d + k]
        out[o : o + k] = piece if d >= k else (piece[:d] * (k // d + 1))[:k]
    return np.frombuffer(out, np.uint8).astype(np.uint32) << np.uint32(8) | np.uint32(rest)


def _split(p: np.ndarray) -> np.ndarray:
    """uint32 pixels to int32 channels (..., 4): alpha, red, green, blue."""
    return np.stack([(p >> s) & 0xFF for s in (24, 16, 8, 0)], -1).astype(np.int32)


def _join(c: np.ndarray) -> np.ndarray:
    c = c.astype(np.uint32) & 0xFF
    return c[..., 0] << 24 | c[..., 1] << 16 | c[..., 2] << 8 | c[..., 3]


def _select(left, top, corner):
    """The side whose channel sums lie nearer to left + top - corner."""
    to_left = sum(abs(t - c) for t, c in zip(top, corner))
    to_top = sum(abs(x - c) for x, c in zip(left, corner))
    return left if to_left < to_top else top


def _mean(a, b):
    return [(x + y) >> 1 for x, y in zip(a, b)]


def _clamp(values):
    return [min(255, max(0, v)) for v in values]


def predicted(mode: int, left, top, corner, right):
    """The predictor of one pixel from its four neighbours, channel lists."""
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return right
    if mode == 4:
        return corner
    if mode == 5:
        return _mean(_mean(left, right), top)
    if mode == 6:
        return _mean(left, corner)
    if mode == 7:
        return _mean(left, top)
    if mode == 8:
        return _mean(corner, top)
    if mode == 9:
        return _mean(top, right)
    if mode == 10:
        return _mean(_mean(left, corner), _mean(top, right))
    if mode == 11:
        return _select(left, top, corner)
    if mode == 12:
        return _clamp(x + t - c for x, t, c in zip(left, top, corner))
    if mode == 13:
        return _clamp(m + int((m - c) / 2) for m, c in zip(_mean(left, top), corner))
    return [255, 0, 0, 0]


def inverse_predictor(p: np.ndarray, width: int, height: int, modes: np.ndarray, bits: int) -> np.ndarray:
    c = _split(p.reshape(height, width)).tolist()
    columns = _block(width, bits)
    modes = ((modes >> 8) & 0xF).tolist()
    for y in range(height):
        row, above = c[y], c[y - 1] if y else None
        for x in range(width):
            if not y:
                guess = row[x - 1] if x else [255, 0, 0, 0]
            elif not x:
                guess = above[0]
            else:
                # at the right edge the pixel above right is the row's own first
                right = above[x + 1] if x + 1 < width else row[0]
                guess = predicted(modes[(y >> bits) * columns + (x >> bits)], row[x - 1], above[x], above[x - 1], right)
            row[x] = [(v + g) & 0xFF for v, g in zip(row[x], guess)]
    return _join(np.array(c)).reshape(-1)


def _signed(a: np.ndarray) -> np.ndarray:
    return a.astype(np.int8).astype(np.int32)


def inverse_cross_colour(p: np.ndarray, width: int, height: int, factors: np.ndarray, bits: int) -> np.ndarray:
    c = _split(p.reshape(height, width))
    f = _split(factors.reshape(_block(height, bits), _block(width, bits)))
    f = np.repeat(np.repeat(f, 1 << bits, 0), 1 << bits, 1)[:height, :width]
    red_to_blue, green_to_blue, green_to_red = (_signed(f[..., i]) for i in (1, 2, 3))
    green = _signed(c[..., 2])
    red = (c[..., 1] + (green_to_red * green >> 5)) & 0xFF
    blue = c[..., 3] + (green_to_blue * green >> 5) + (red_to_blue * _signed(red) >> 5)
    return _join(np.stack([c[..., 0], red, c[..., 2], blue], -1)).reshape(-1)


def add_green(p: np.ndarray) -> np.ndarray:
    c = _split(p)
    c[:, 1] += c[:, 2]
    c[:, 3] += c[:, 2]
    return _join(c)


def inverse_palette(p: np.ndarray, width: int, height: int, colours: np.ndarray, packed: int) -> np.ndarray:
    index = ((p >> 8) & 0xFF).reshape(height, -1)
    if packed:
        each = 8 >> packed
        index = np.stack([(index >> (each * i)) & ((1 << each) - 1) for i in range(1 << packed)], -1).reshape(height, -1)[:, :width]
    table = np.zeros(256, np.uint32)
    table[: len(colours)] = colours
    return table[index].reshape(-1)


def decode(data: bytes) -> np.ndarray:
    """(height, width) ARGB pixels as uint32 of one RIFF file."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L":
        raise ValueError("not a lossless WebP file")
    size = struct.unpack("<I", data[16:20])[0]
    bits = Bits(data[20 : 20 + size])
    if bits.read(8) != 0x2F:
        raise ValueError("no VP8L signature")
    full, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    width, steps, seen = full, [], set()
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise ValueError("a transform occurs twice")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS_COLOUR):
            n = bits.read(3) + 2
            steps.append((kind, width, read_pixels(bits, _block(width, n), _block(height, n), False), n))
        elif kind == SUBTRACT_GREEN:
            steps.append((kind, width, None, 0))
        else:
            colours = np.cumsum(_split(read_pixels(bits, bits.read(8) + 1, 1, False)), 0)
            packed = 3 if len(colours) <= 2 else 2 if len(colours) <= 4 else 1 if len(colours) <= 16 else 0
            steps.append((kind, width, _join(colours), packed))
            width = _block(width, packed)
    p = read_pixels(bits, width, height, True)
    for kind, wide, data_, n in reversed(steps):
        if kind == PREDICTOR:
            p = inverse_predictor(p, wide, height, data_, n)
        elif kind == CROSS_COLOUR:
            p = inverse_cross_colour(p, wide, height, data_, n)
        elif kind == SUBTRACT_GREEN:
            p = add_green(p)
        else:
            p = inverse_palette(p, wide, height, data_, n)
    return p.reshape(height, full)


class Writer:
    def __init__(self):
        self.value, self.n = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n


def code_lengths(counts: np.ndarray, most: int) -> list[int]:
    """Lengths of a prefix code for the counts, none above `most`; flatter counts shorten the longest."""
    used = np.flatnonzero(counts).tolist()
    out = [0] * len(counts)
    weights = counts[used].tolist()
    while used:
        heap = [(n, i) for i, n in enumerate(weights)]
        heapq.heapify(heap)
        above, new = [0] * (2 * len(used)), len(used)
        while len(heap) > 1:
            (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
            above[i] = above[j] = new
            heapq.heappush(heap, (a + b, new))
            new += 1
        depth = [0] * new
        for i in range(new - 2, -1, -1):
            depth[i] = depth[above[i]] + 1
        if max(depth[: len(used)]) <= most:
            for s, n in zip(used, depth):
                out[s] = max(n, 1)
            break
        weights = [n // 2 + 1 for n in weights]
    return out


def _codes_of(lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(bits as written, how many) of every symbol; one used symbol takes none."""
    code, size = np.zeros(len(lengths), np.uint64), np.zeros(len(lengths), np.uint64)
    prefix = _prefix(tuple(lengths))
    if prefix.only is None:
        code[prefix.symbols], size[prefix.symbols] = prefix.written, prefix.bits
    return code, size


def _write_code(w: Writer, lengths: list[int]) -> None:
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) <= 2 and all(s < 256 for s in used):
        used = used or [0]
        w.put(1, 1), w.put(len(used) - 1, 1), w.put(int(used[0] > 1), 1), w.put(used[0], 8 if used[0] > 1 else 1)
        if len(used) == 2:
            w.put(used[1], 8)
        return
    runs: list[tuple[int, int, int]] = []  # symbol, extra value, extra bits
    edges = np.flatnonzero(np.diff(lengths)) + 1
    for at, end in zip([0, *edges.tolist()], [*edges.tolist(), len(lengths)]):
        n, left = lengths[at], end - at
        if n:
            runs.append((n, 0, 0))
            left -= 1
        while left >= 3:
            k = min(left, 6 if n else 10 if left < 11 else 138)
            runs.append((16, k - 3, 2) if n else (17, k - 3, 3) if k < 11 else (18, k - 11, 7))
            left -= k
        runs += [(n, 0, 0)] * left
    of = code_lengths(np.bincount([s for s, *_ in runs], minlength=19), 7)
    n = max(4, 1 + max(i for i, s in enumerate(LENGTH_ORDER) if of[s]))
    w.put(0, 1), w.put(n - 4, 4)
    for s in LENGTH_ORDER[:n]:
        w.put(of[s], 3)
    w.put(0, 1)
    code, size = _codes_of(of)
    code, size = code.tolist(), size.tolist()
    for s, value, more in runs:
        w.put(code[s] | value << size[s], size[s] + more)


@functools.cache
def _value_symbols() -> tuple[np.ndarray, np.ndarray]:
    """(symbol, extra bits) of every length or distance code that an image here can need, by the value less 1."""
    u = np.arange(1 << 21)
    symbol = np.searchsorted(_LEAST, u + 1, side="right") - 1
    return symbol.astype(np.int64), _MORE[symbol]


def _value_code(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbol, extra value, extra bits) of lengths or distance codes."""
    symbols, bits = _value_symbols()
    symbol, more = symbols[v - 1], bits[v - 1]
    return symbol, v - _LEAST[symbol], more


def back_references(rank: np.ndarray, few: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, distance): from left to right, runs that equal the last place where their first pixels stand.

    few: at most 256 kinds of pixels, of which eight make a beginning; else three of at most 2^21.
    """
    least = 8 if few else 3
    none = (np.zeros(0, np.int64),) * 3
    n = len(rank) - least + 1
    if n < 2:
        return none
    if few:
        key = np.ndarray((n,), "<u8", rank.astype(np.uint8).tobytes(), strides=(1,)).copy()
    else:
        key = rank[:n].astype(np.uint64)
        for i in range(1, least):
            key |= rank[i : i + n].astype(np.uint64) << np.uint64(21 * i)
    # neighbours in the order of a short hash; of those that differ in the key none is taken
    order = np.argsort((key * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)).astype(np.uint16), kind="stable")
    sorted_ = key[order]
    again = np.flatnonzero(sorted_[1:] == sorted_[:-1])
    if not len(again):
        return none
    distance = np.zeros(n, np.int32)
    later = order[again + 1]
    distance[later] = later - order[again]
    some = np.flatnonzero(distance)
    edges = np.flatnonzero(distance[1:] != distance[:-1])
    edges = np.append(edges, n - 1)
    length = memoryview(edges[np.searchsorted(edges, some)] - some + least)
    following = np.zeros(len(rank) + 1, np.int32)
    following[some + 1] = 1
    following = memoryview(np.cumsum(following, dtype=np.int32))
    place, taken, at, many = memoryview(some), [], 0, len(some)
    while (i := following[at]) < many:
        taken.append(i)
        at = place[i] + min(length[i], 4096)
    start = some[taken]
    return start, np.minimum(np.asarray(length)[taken], 4096), distance[start].astype(np.int64)


def cached(p: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(slot in a colour cache of 2^bits, whether the pixel is there already) of every pixel."""
    slot = (p * np.uint32(HASH_MULTIPLIER)) >> np.uint32(32 - bits)
    order = np.argsort(slot, kind="stable")
    hit = np.zeros(len(p), bool)
    hit[order[1:]] = (slot[order[1:]] == slot[order[:-1]]) & (p[order[1:]] == p[order[:-1]])
    return slot.astype(np.int64), hit


def _bits_of(counts: np.ndarray) -> float:
    """Bits that symbols of these counts cost by their own frequencies."""
    n = counts[counts > 0]
    return float((n * np.log2(n.sum() / n)).sum())


def _entropy(p: np.ndarray) -> float:
    return sum(_bits_of(np.bincount((p >> np.uint32(shift)) & np.uint32(255))) for shift in (24, 16, 8, 0))


def _write_image(w: Writer, p: np.ndarray, width: int, main: bool, use: set[str]) -> np.ndarray:
    """Put the codes of an entropy-coded image into w; its tokens' bits."""
    grey = ((p ^ p[0]) & np.uint32(0xFFFF00FF) == 0).all()
    slot, hit, cache_bits = None, None, 0
    if main and not grey:
        slot, hit = cached(p, 8)
        if 10 * hit.sum() >= len(p):
            cache_bits = 8
            use.add("colour cache")
    if grey:
        start, length, back = back_references((p >> np.uint32(8)).astype(np.uint8), True)
    else:
        colours, rank = np.unique(p, return_inverse=True)
        start, length, back = back_references(rank, len(colours) <= 256) if len(colours) < 1 << 21 else (np.zeros(0, np.int64),) * 3
    use.add("prefix codes")
    if len(start):
        use.add("back-references")
    inside = np.zeros(len(p) + 1, np.int8)
    inside[start] += 1
    inside[start + length] -= 1
    inside = np.cumsum(inside[:-1], dtype=np.int8) > 0
    token = ~inside
    token[start] = True
    place = np.flatnonzero(token)
    ref = inside[place]
    there = p[place]
    first = (there >> np.uint32(8) & np.uint32(255)).astype(np.int64)
    literal = ~ref
    if cache_bits:
        hit = hit[place] & literal
        literal &= ~hit
        first[hit] = 280 + slot[place][hit]
    len_symbol, len_extra, len_bits = _value_code(length)
    first[ref] = 256 + len_symbol
    near = _short_codes(width)
    code = np.array([near.get(d, d + 120) for d in back.tolist()], np.int64)
    dist_symbol, dist_extra, dist_bits = _value_code(code)
    w.put(1, 1) if cache_bits else w.put(0, 1)
    if cache_bits:
        w.put(cache_bits, 4)
    if main:
        w.put(0, 1)  # one group of codes
    value, size = np.zeros(len(place), np.uint64), np.zeros(len(place), np.uint64)

    def add(rows, v, n) -> None:
        value[rows] |= v.astype(np.uint64) << size[rows]
        size[rows] += n.astype(np.uint64)

    everything = np.ones(len(place), bool)
    parts = [(everything, first, 280 + (1 << cache_bits if cache_bits else 0)), (literal, 16, 256), (literal, 0, 256), (literal, 24, 256), (ref, dist_symbol, 40)]
    for i, (rows, symbols, alphabet) in enumerate(parts):
        if grey and 0 < i < 4:  # one symbol, no bits
            w.put(0b101, 3), w.put(int(there[0] >> np.uint32((16, 0, 24)[i - 1]) & np.uint32(255)), 8)
            continue
        if 0 < i < 4:
            symbols = (there[rows] >> np.uint32(symbols) & np.uint32(255)).astype(np.int64)
        lengths = code_lengths(np.bincount(symbols, minlength=alphabet), LONGEST)
        _write_code(w, lengths)
        if len(symbols):
            codes, sizes = _codes_of(lengths)
            if i == 4:
                add(ref, len_extra, len_bits)
            add(rows, codes[symbols], sizes[symbols])
    add(ref, dist_extra, dist_bits)
    size = size.astype(np.int64)
    begin = np.cumsum(size) - size
    return ((np.repeat(value, size) >> (np.arange(int(size.sum())) - np.repeat(begin, size)).astype(np.uint64)) & np.uint64(1)).astype(np.uint8)


@functools.cache
def _short_codes(width: int) -> dict[int, int]:
    """The least short code of every distance that has one."""
    return {d: code for code, d in reversed([*enumerate(_near(width), 1)])}


def _put_image(w: Writer, p: np.ndarray, width: int) -> None:
    body = _write_image(w, p, width, False, set())
    w.put(int.from_bytes(np.packbits(body, bitorder="little").tobytes(), "little"), len(body))


def residuals(c: np.ndarray, mode: int) -> np.ndarray:
    """What one predictor mode leaves of channels (height, width, 4): by whole arrays, as every neighbour is known."""
    left, top, corner = np.roll(c, 1, 1), np.roll(c, 1, 0), np.roll(np.roll(c, 1, 0), 1, 1)
    right = np.concatenate([top[:, 1:], c[:, :1]], 1)
    half = lambda a, b: (a + b) // 2
    if mode == 11:
        guess = left + top - corner
        nearer = np.abs(guess - left).sum(-1, keepdims=True) < np.abs(guess - top).sum(-1, keepdims=True)
        guess = np.where(nearer, left, top)
    elif mode == 13:
        m = half(left, top)
        guess = np.clip(m + np.sign(m - corner) * (np.abs(m - corner) // 2), 0, 255)
    else:
        guess = {
            0: np.broadcast_to(np.array([255, 0, 0, 0]), c.shape), 1: left, 2: top, 3: right, 4: corner, 5: half(half(left, right), top), 6: half(left, corner), 7: half(left, top),
            8: half(corner, top), 9: half(top, right), 10: half(half(left, corner), half(top, right)), 12: np.clip(left + top - corner, 0, 255),
        }[mode]
    out = c - guess
    out[0, 1:], out[1:, 0], out[0, 0] = c[0, 1:] - c[0, :-1], c[1:, 0] - c[:-1, 0], c[0, 0] - [255, 0, 0, 0]
    return out & 0xFF


def _rough(c: np.ndarray, mode: int) -> float:
    """Bits that bytes (height, width, channels) cost when predicted by left (1), top (2) or left + top - corner, wrapped (12)."""
    left, top, here = c[1:, :-1], c[:-1, 1:], c[1:, 1:]
    rest = here - (left if mode == 1 else top if mode == 2 else left + top - c[:-1, :-1])
    counts = [np.bincount(rest[..., i].reshape(-1)) for i in range(c.shape[2])]
    return sum(map(_bits_of, counts)) * c.size / rest.size


#: Codes are written with so many bits at most, though 15 can be read.
LONGEST = 12
#: Predictor modes that encode() tries.
MODES = (1, 2, 12)
TILE_BITS = 9


def encode(pixels: np.ndarray, use: set[str] | None = None) -> bytes:
    """(height, width) ARGB pixels to one RIFF file; use: gets the names of the tools used."""
    height, width = pixels.shape
    p, use = np.ascontiguousarray(pixels, np.uint32).reshape(-1), set() if use is None else use
    w = Writer()
    w.put(0x2F, 8), w.put(width - 1, 14), w.put(height - 1, 14), w.put(1, 1), w.put(0, 3)
    wide = width
    grey = ((p ^ p[0]) & np.uint32(0xFFFF00FF) == 0).all()
    if grey:
        byte = (p >> np.uint32(8)).astype(np.uint8)
        counts = np.bincount(byte, minlength=256)
        colours = p[0] & np.uint32(0xFFFF00FF) | np.flatnonzero(counts).astype(np.uint32) << np.uint32(8)
    else:
        colours = np.unique(p)
    if len(colours) <= 16 or len(colours) <= 256 and not grey:
        use.add("palette")
        packed = 3 if len(colours) <= 2 else 2 if len(colours) <= 4 else 1 if len(colours) <= 16 else 0
        w.put(1, 1), w.put(PALETTE, 2), w.put(len(colours) - 1, 8)
        steps = np.diff(_split(colours), axis=0, prepend=0)
        _put_image(w, _join(steps), len(colours))
        index = np.searchsorted(colours, p).reshape(height, width)
        wide = _block(width, packed)
        index = np.pad(index, ((0, 0), (0, (wide << packed) - width))).reshape(height, wide, 1 << packed)
        p = OPAQUE | (index << (np.arange(1 << packed) * (8 >> packed))).sum(-1).astype(np.uint32).reshape(-1) << np.uint32(8)
    else:
        best = _bits_of(counts) if grey else _entropy(p)
        tiles = lambda bits: _block(width, bits) * _block(height, bits)
        c = None if grey else _split(p)
        if not grey:
            less = c.copy()
            less[:, 1] -= c[:, 2]
            less[:, 3] -= c[:, 2]
            # a common slope of red and blue by green
            g = c[:, 2].astype(np.int8).astype(np.int64)
            slope = lambda x: int(np.clip(round(32 * float((g * x).sum()) / max(1.0, float((g * g).sum()))), -128, 127))
            g2r, g2b = (slope(c[:, i].astype(np.int8).astype(np.int64)) for i in (1, 3))
            cross = c.copy()
            cross[:, 1] -= g2r * g >> 5
            cross[:, 3] -= g2b * g >> 5
            green, crossed = _entropy(_join(less)), _entropy(_join(cross)) + 64
            if min(green, crossed) < 0.97 * best:
                best = min(green, crossed)
                if green <= crossed:
                    use.add("subtract green")
                    w.put(1, 1), w.put(SUBTRACT_GREEN, 2)
                    c = less & 0xFF
                else:
                    use.add("cross-colour")
                    w.put(1, 1), w.put(CROSS_COLOUR, 2), w.put(TILE_BITS - 2, 3)
                    _put_image(w, np.full(tiles(TILE_BITS), OPAQUE | (g2b & 255) << 8 | g2r & 255, np.uint32), _block(width, TILE_BITS))
                    c = cross & 0xFF
        # the rough cost of a mode, by whole bytes; edges are left out
        flat = byte.reshape(height, width, 1) if grey else c.astype(np.uint8).reshape(height, width, 4)
        # bytes that rarely equal a neighbour are not tried
        like = grey and max(np.count_nonzero(byte[1:] == byte[:-1]), np.count_nonzero(byte[width:] == byte[:-width])) * 5 >= len(byte)
        tried = [(_rough(flat, mode), mode) for mode in MODES] if min(height, width) > 1 and (like or not grey) else []
        if tried and min(tried)[0] < 0.97 * best:
            use.add("predictor")
            w.put(1, 1), w.put(PREDICTOR, 2), w.put(TILE_BITS - 2, 3)
            _put_image(w, np.full(tiles(TILE_BITS), OPAQUE | min(tried)[1] << 8, np.uint32), _block(width, TILE_BITS))
            c = residuals((_split(p) if grey else c).reshape(height, width, 4), min(tried)[1]).reshape(-1, 4)
        p = p if c is None else _join(c)
    w.put(0, 1)
    body = _write_image(w, p, wide, True, use)
    head = np.unpackbits(np.frombuffer(w.value.to_bytes((w.n + 7) // 8, "little"), np.uint8), bitorder="little")[: w.n]
    stream = np.packbits(np.concatenate([head, body]), bitorder="little").tobytes()
    chunk = stream + b"\0" * (len(stream) % 2)
    return b"RIFF" + struct.pack("<I", 12 + len(chunk)) + b"WEBPVP8L" + struct.pack("<I", len(stream)) + chunk


def padded(data: bytes) -> bytes:
    return data + b"\0" * ((-len(data)) % 64 or (0 if data else 64))


def store(payload: bytes, use: set[str] | None = None) -> bytes:
    """A payload of a positive multiple of 64 bytes as one or more RIFF files."""
    p = OPAQUE | np.frombuffer(payload, np.uint8).reshape(-1, WIDTH).astype(np.uint32) << np.uint32(8)
    return b"".join(encode(p[at : at + MAX_HEIGHT], use) for at in range(0, len(p), MAX_HEIGHT))


def load(media: bytes) -> bytes:
    out, at = [], 0
    while at < len(media):
        size = 8 + struct.unpack("<I", media[at + 4 : at + 8])[0]
        out.append((decode(media[at : at + size]) >> np.uint32(8)).astype(np.uint8).tobytes())
        at += size
    return b"".join(out)


def describe(payload: bytes) -> str:
    """Samples' mean, entropy in bits and share of zeros, and the mean step between neighbours."""
    a = np.frombuffer(payload, np.uint8)
    share = np.bincount(a, minlength=256) / len(a)
    bits = -float((share[share > 0] * np.log2(share[share > 0])).sum())
    step = float(np.abs(np.diff(a.astype(np.int16))).mean())
    return f"{a.mean():.4f};{bits:.4f};{share[0]:.4f};{step:.4f}"


def media_row(text: str | None) -> tuple:
    raw = (text or "").encode("utf-8", "surrogatepass")
    media = store(padded(raw))
    back = load(media)
    tail = back[-64:]
    return len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(tail), len(media), hashlib.sha256(media).hexdigest(), describe(back), media


_OUT = (("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("media", pa.binary()))


def _run(keep: bool):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                b = batch.slice(at, 64)
                rows = list(zip(*(media_row(t)[: 8 if keep else 7] for t in b.column(1).to_pylist())))
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(r, kind) for r, (_, kind) in zip(rows, _OUT))], ["doc_id", *(name for name, _ in _OUT[: len(rows)])])

    return run


def text_media(docs: DataFrame, keep_media: bool = False) -> DataFrame:
    """doc_id, sizes and digests of each text's stored image, features of what is read back; `media` itself if asked.

    Null texts count as empty, and empty ones store 64 zero bytes; repeated rows stay; equal texts give equal values.
    Texts are stored whole, whatever their length; an empty table gives no rows; other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    flat = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return docs.mapInArrow(_run(keep_media), flat + ", media binary" * keep_media)


_PIXELS = (("width", pa.int32()), ("height", pa.int32()), ("pixels", pa.list_(pa.int32())), ("error", pa.string()))


def pixel_row(media: bytes | None) -> tuple:
    """(width, height, ARGB pixels row by row, null) of one lossless WebP file, or nulls and what is wrong with it."""
    if media is None:
        return None, None, None, None
    try:
        p = decode(media)
    except (ValueError, IndexError, struct.error) as e:
        return None, None, None, str(e) or type(e).__name__
    return p.shape[1], p.shape[0], p.reshape(-1).view(np.int32), None


def _read_media(place: int):
    def run(batches):
        for batch in batches:
            # one image at a time, as a file may hold up to 2^28 pixels
            for at in range(batch.num_rows):
                b = batch.slice(at, 1)
                row = pixel_row(b.column(place)[0].as_py())
                yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array([v], kind) for v, (_, kind) in zip(row, _PIXELS))], [*b.schema.names, *(name for name, _ in _PIXELS)])

    return run


def media_pixels(rows: DataFrame, column: str = "media") -> DataFrame:
    """rows with width, height, pixels (ARGB as int, row by row) and error of the lossless WebP file in the binary `column`.

    A row for each input row. Null media give nulls; a file that is no valid
    lossless WebP image gives nulls and its error.
    """
    kinds = (T.IntegerType(), T.IntegerType(), T.ArrayType(T.IntegerType()), T.StringType())
    schema = T.StructType([*rows.schema.fields, *(T.StructField(name, kind) for (name, _), kind in zip(_PIXELS, kinds))])
    return rows.mapInArrow(_read_media(rows.columns.index(column)), schema)
