"""Lossless WebP: a decoder of whole images, an encoder for byte payloads, and the operators on columns of both.

The decoder reads the RIFF container and the VP8L stream: prefix codes (simple and with coded lengths), groups of codes
chosen by an entropy image, back-references with the two-dimensional distance codes, the colour cache, and the
inverses of the predictor, cross-colour, subtract-green and palette transforms. Pixels come out as an array of 32-bit
ARGB values. Images whose pixels vary in green alone (as the encoder below makes) are decoded without a step for each
pixel: code lengths are looked up for all bit positions at once, and one chain of additions finds the positions where
codes begin, from one back-reference to the next.

The encoder writes samples in green. Passages of MIN_MATCH bytes or more that occurred before, from the begin of a word on,
become back-references; a frame of at most 16 different samples gets a palette, which packs two to eight samples into a
pixel. The colour cache, predictor, cross-colour and subtract-green are left to files of others: with one channel in use
a cached colour costs as much as the sample, and neighbouring letters predict nothing.

A payload is stored in frames of at most FRAME bytes, each its own WebP file, 64 samples wide. Files carry their sizes, so
frames are simply joined. That bounds memory for texts of any length.

Defined cases: a null text counts as empty, and an empty text is 64 zero bytes; null or repeated ids are carried as
they are; an empty table gives an empty result; other columns are ignored; broken media raise ValueError.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import named, utf8

FRAME, WIDTH, BLOCK = 1 << 20, 64, 64
MIN_MATCH = 16

# Fixed values of the format.
SIGNATURE, LITERALS, LENGTHS, DISTANCES, LONGEST_COPY = 0x2F, 256, 24, 40, 4096
CODE_LENGTH_ORDER = [17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
BLACK, CACHE_FACTOR = 0xFF000000, 0x1E35A7BD
#: Distance codes 1 to 120 by rule: neighbours within 8 columns and 7 rows, nearest first, then by column, right of left.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), -p[0]))


class Bits:
    """Little-endian bits of a stream; zeros follow its end up to 8 bytes, beyond that it is broken."""

    def __init__(self, data: bytes):
        self.data, self.at, self.limit = data + bytes(8), 0, 8 * len(data) + 64

    def peek(self, n: int) -> int:
        return self.ahead(8) & ((1 << n) - 1)

    def ahead(self, size: int) -> int:
        """At least 8 * size - 7 bits from here on."""
        byte = self.at >> 3
        return int.from_bytes(self.data[byte : byte + size], "little") >> (self.at & 7)

    def read(self, n: int) -> int:
        value = self.peek(n)
        self.at += n
        if self.at > self.limit:
            raise ValueError("the stream ends early")
        return value


class Code:
    """A canonical prefix code as a table over the longest code's bits; a single symbol takes no bits."""

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        self.only = int(used[0]) if len(used) == 1 else None
        self.longest = 0
        self.symbols, self.sizes = np.zeros(1, np.int32), np.zeros(1, np.uint8)
        if len(used) == 0:
            self.only = 0
        if self.only is not None:
            self.symbols[0] = self.only
        else:
            size = lengths[used].astype(np.int64)
            if int((1 << (15 - size)).sum()) != 1 << 15:
                raise ValueError("a prefix code is not complete")
            order = np.lexsort((used, size))
            used, size = used[order], size[order]
            self.longest = int(size[-1])
            # In canonical order each code covers a run of the table whose index has the code's bits first.
            runs = 1 << (self.longest - size)
            straight = np.repeat(np.arange(len(used)), runs)
            which = straight[reversed_bits(self.longest)]
            self.symbols, self.sizes = used[which].astype(np.int32), size[which].astype(np.uint8)

    @cached_property
    def table(self) -> list[tuple[int, int]]:
        return list(zip(self.symbols.tolist(), self.sizes.tolist(), strict=True))

    def read(self, bits: Bits) -> int:
        if self.only is not None:
            return self.only
        symbol, size = self.table[bits.peek(self.longest)]
        bits.read(size)
        return symbol


@lru_cache(maxsize=LITERALS)
def single(symbol: int) -> Code:
    return Code(np.arange(symbol + 1) == symbol)


@lru_cache(maxsize=256)
def short_code(lengths: tuple[int, ...]) -> Code:
    """A code for code lengths; files of one writer often share it."""
    return Code(np.array(lengths))


_reversed: dict[int, np.ndarray] = {}


def reversed_bits(n: int) -> np.ndarray:
    """Each number below 2 ** n with its n bits in reverse."""
    if n not in _reversed:
        out = np.zeros(1, dtype=np.int64)
        for _ in range(n):
            out = np.concatenate([2 * out, 2 * out + 1])
        _reversed[n] = out
    return _reversed[n]


def read_code(bits: Bits, alphabet: int) -> Code:
    lengths = np.zeros(alphabet, dtype=np.int64)
    if bits.read(1):
        count = bits.read(1) + 1
        symbols = [bits.read(8 if bits.read(1) else 1)]
        if count == 2:
            symbols.append(bits.read(8))
        if max(symbols) >= alphabet:
            raise ValueError("a symbol is outside its alphabet")
        if symbols[0] == symbols[-1]:
            return single(symbols[0])
        lengths[symbols] = 1
        return Code(lengths)
    sizes = bits.read(4) + 4
    listed = bits.read(3 * sizes)
    first = [0] * 19
    for k in range(sizes):
        first[CODE_LENGTH_ORDER[k]] = listed >> 3 * k & 7
    code = short_code(tuple(first))
    todo = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    table, mask = code.table, (1 << code.longest) - 1
    ahead, taken = bits.ahead((alphabet * 14 >> 3) + 8), 0
    found: list[int] = []
    last = 8
    while len(found) < alphabet and todo:
        todo -= 1
        symbol, size = table[ahead & mask]
        if symbol < 16:
            found.append(symbol)
            last = symbol or last
        else:
            ahead >>= size
            taken += size
            size = (2, 3, 7)[symbol - 16]
            found += [last if symbol == 16 else 0] * ((11 if symbol == 18 else 3) + (ahead & ((1 << size) - 1)))
        ahead >>= size
        taken += size
    bits.read(taken)
    if len(found) > alphabet:
        raise ValueError("a run of code lengths is too long")
    lengths[: len(found)] = found
    return Code(lengths)


def _amount(bits: Bits, prefix: int) -> int:
    """The number that a length or distance prefix stands for, with its extra bits."""
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


def read_image(bits: Bits, width: int, height: int, main: bool = False) -> np.ndarray:
    """The entropy-coded pixels of one image; only the main image may choose among groups of codes."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("the colour cache is too large")
    groups, tile, chosen = 1, 0, None
    if main and bits.read(1):
        tile = bits.read(3) + 2
        across = -(-width >> tile) if width else 0
        chosen = (read_image(bits, across, -(-height >> tile)) >> 8) & 0xFFFF
        groups = int(chosen.max()) + 1
        chosen = chosen.reshape(-1, across).tolist()
    sizes = (LITERALS + LENGTHS + (1 << cache_bits if cache_bits else 0), LITERALS, LITERALS, LITERALS, DISTANCES)
    codes = [[read_code(bits, n) for n in sizes] for _ in range(groups)]
    green, red, blue, alpha, _ = codes[0]
    total = width * height
    if groups == 1 and not cache_bits and None not in (red.only, blue.only, alpha.only):
        rest = alpha.only << 24 | red.only << 16 | blue.only
        return (_greens(bits, green, codes[0][4], width, total).astype(np.uint32) << np.uint32(8)) | np.uint32(rest)
    return _pixels(bits, width, total, cache_bits, codes, tile, chosen)


def _back(bits: Bits, code: Code, width: int) -> int:
    """The distance of a back-reference, in pixels."""
    back = _amount(bits, code.read(bits))
    if back > len(NEAR):
        return back - len(NEAR)
    x, y = NEAR[back - 1]
    return max(1, x + y * width)


def _greens(bits: Bits, code: Code, distance: Code, width: int, total: int) -> np.ndarray:
    """The green channel of pixels whose other channels take no bits: literals of one code, and back-references."""
    if code.only is not None and code.only < LITERALS:
        return np.full(total, code.only, dtype=np.int32)
    base = bits.at & ~7
    held = len(bits.data) - (base >> 3)
    data = np.frombuffer(bits.data, dtype=np.uint8, offset=base >> 3, count=held).astype(np.uint32)
    ahead = data[:-2] | data[1:-1] << np.uint32(8) | data[2:] << np.uint32(16)
    # For every bit position: the code's bits that would start there, and where the next, 2nd, 4th and 8th code starts. A
    # code that is no literal leads to itself, as does the end.
    windows = (ahead[:, None] >> np.arange(8, dtype=np.uint32) & np.uint32((1 << code.longest) - 1)).astype(np.uint16).reshape(-1)
    end = len(windows) - 1
    sizes = np.where(code.symbols < LITERALS, code.sizes, 0).astype(np.int32)
    one = np.minimum(sizes.take(windows) + np.arange(end + 1, dtype=np.int32), end)
    two = one.take(one)
    four = two.take(two)
    jump, step = memoryview(four.take(four)), memoryview(one)
    starts, copies, at, done, literals = [], [], bits.at - base, 0, 0
    while done < total:
        n = 0
        while done + n < total:
            starts.append(at)
            after = jump[at]
            if step[after] == after:
                while step[at] != at:
                    n, at = n + 1, step[at]
                break
            n, at = n + 8, after
        n = min(n, total - done)
        literals, done = literals + n, done + n
        if done == total:
            break
        bits.at = base + at
        symbol = code.read(bits)
        if symbol < LITERALS or at >= end:
            raise ValueError("the stream ends early")
        length, back = _amount(bits, symbol - LITERALS), _back(bits, distance, width)
        if back > done or done + length > total:
            raise ValueError("a back-reference leaves the image")
        copies.append((done, length, back))
        done, at = done + length, bits.at - base
    at8 = np.empty((len(starts), 8), dtype=np.int32)
    at8[:, 0] = starts
    at8[:, 4] = four.take(at8[:, 0])
    at8[:, 2::4] = two.take(at8[:, ::4])
    at8[:, 1::2] = one.take(at8[:, ::2])
    positions = at8.reshape(-1)
    positions = positions[one.take(positions) != positions][:literals] if copies else positions[:literals]
    if literals and (not copies or copies[-1][0] + copies[-1][1] < total):
        if len(positions) < literals or positions[-1] >= end:
            raise ValueError("the stream ends early")
        bits.at = base + int(one[positions[-1]])
        bits.read(0)
    found = code.symbols.take(windows.take(positions))
    return _copied(found, copies, total) if copies else found


def _copied(literals: np.ndarray, copies: list[tuple[int, int, int]], total: int) -> np.ndarray:
    """All samples, from the literals in order and the copies (where, how many, how far back)."""
    open_ = np.ones(total, dtype=bool)
    for at, length, _ in copies:
        open_[at : at + length] = False
    out = np.empty(total, dtype=np.int32)
    out[open_] = literals
    for at, length, back in copies:
        source = out[at - back : min(at, at - back + length)]
        out[at : at + length] = source if back >= length else np.resize(source, length)
    return out


def _pixels(bits: Bits, width: int, total: int, cache_bits: int, codes: list[list[Code]], tile: int, chosen: list[list[int]] | None) -> np.ndarray:
    out: list[int] = []
    cache = [0] * (1 << cache_bits)
    remembered = 0  # pixels that the colour cache has seen
    shift = 32 - cache_bits

    def remember() -> None:
        nonlocal remembered
        if cache_bits:
            for pixel in out[remembered:]:
                cache[(CACHE_FACTOR * pixel & 0xFFFFFFFF) >> shift] = pixel
        remembered = len(out)

    while len(out) < total:
        at = len(out)
        group = codes[chosen[at // width >> tile][at % width >> tile] if chosen else 0]
        symbol = group[0].read(bits)
        if symbol < LITERALS:
            red = group[1].read(bits)
            blue = group[2].read(bits)
            out.append(group[3].read(bits) << 24 | red << 16 | symbol << 8 | blue)
        elif symbol < LITERALS + LENGTHS:
            length = _amount(bits, symbol - LITERALS)
            back = _back(bits, group[4], width)
            if back > at or at + length > total:
                raise ValueError("a back-reference leaves the image")
            for _ in range(length):
                out.append(out[-back])
        else:
            remember()
            out.append(cache[symbol - LITERALS - LENGTHS])
    remember()
    return np.array(out, dtype=np.uint32)


def _channels(pixels: np.ndarray) -> list[np.ndarray]:
    return [(pixels >> np.uint32(s) & np.uint32(255)).astype(np.int64) for s in (24, 16, 8, 0)]


def _joined(a: np.ndarray, r: np.ndarray, g: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a & 255) << 24 | (r & 255) << 16 | (g & 255) << 8 | (b & 255)).astype(np.uint32)


def predict(mode: int, left: tuple, top: tuple, right: tuple, corner: tuple) -> tuple:
    """The predicted channels of a pixel from those left, above, above to the right and above to the left."""
    half = lambda p, q: tuple((x + y) >> 1 for x, y in zip(p, q, strict=True))
    clamp = lambda x: 0 if x < 0 else 255 if x > 255 else x
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return right
    if mode == 4:
        return corner
    if mode == 5:
        return half(half(left, right), top)
    if mode in (6, 7):
        return half(left, corner if mode == 6 else top)
    if mode in (8, 9):
        return half(top, corner if mode == 8 else right)
    if mode == 10:
        return half(half(left, corner), half(top, right))
    if mode == 11:
        to_left = sum(abs(t - c) for t, c in zip(top, corner, strict=True))
        to_top = sum(abs(x - c) for x, c in zip(left, corner, strict=True))
        return left if to_left < to_top else top
    if mode == 12:
        return tuple(clamp(x + t - c) for x, t, c in zip(left, top, corner, strict=True))
    if mode == 13:
        return tuple(clamp(m + int((m - c) / 2)) for m, c in zip(half(left, top), corner, strict=True))
    return (255, 0, 0, 0)  # opaque black; also for the two unused modes


def _undo_predictor(pixels: np.ndarray, width: int, tile: int, modes: np.ndarray) -> np.ndarray:
    height = len(pixels) // width
    across = -(-width >> tile)
    mode = (modes >> np.uint32(8) & np.uint32(15)).reshape(-1, across).tolist()
    change = list(zip(*(c.tolist() for c in _channels(pixels)), strict=True))
    out: list[tuple] = []
    for y in range(height):
        for x in range(width):
            at = y * width + x
            if y == 0:
                guess = out[-1] if x else (255, 0, 0, 0)
            elif x == 0:
                guess = out[at - width]
            else:
                # Above to the right of the last column is the first pixel of this row.
                guess = predict(mode[y >> tile][x >> tile], out[-1], out[at - width], out[at - width + 1], out[at - width - 1])
            out.append(tuple((p + d) & 255 for p, d in zip(guess, change[at], strict=True)))
    return _joined(*np.array(out, dtype=np.int64).T)


def colour_shift(factor: np.ndarray, channel: np.ndarray) -> np.ndarray:
    """The cross-colour product of two signed bytes, in 1/32."""
    signed = lambda x: (x & 255) - ((x & 128) << 1)
    return signed(factor) * signed(channel) >> 5


def _undo_cross_colour(pixels: np.ndarray, width: int, tile: int, factors: np.ndarray) -> np.ndarray:
    across = -(-width >> tile)
    at = np.arange(len(pixels))
    _, red_to_blue, green_to_blue, green_to_red = (c[(at // width >> tile) * across + (at % width >> tile)] for c in _channels(factors))
    a, r, g, b = _channels(pixels)
    r = (r + colour_shift(green_to_red, g)) & 255
    return _joined(a, r, g, b + colour_shift(green_to_blue, g) + colour_shift(red_to_blue, r))


def _undo_subtract_green(pixels: np.ndarray) -> np.ndarray:
    a, r, g, b = _channels(pixels)
    return _joined(a, r + g, g, b + g)


def _undo_palette(pixels: np.ndarray, width: int, packed_bits: int, colours: np.ndarray) -> np.ndarray:
    index = (pixels >> np.uint32(8) & np.uint32(255)).astype(np.int64)
    if packed_bits:
        each = 8 >> packed_bits
        rows = index.reshape(-1, -(-width >> packed_bits))
        index = (rows[:, :, None] >> (each * np.arange(1 << packed_bits)) & ((1 << each) - 1)).reshape(len(rows), -1)[:, :width].reshape(-1)
    table = np.zeros(256, dtype=np.uint32)
    table[: len(colours)] = colours
    return table[index]


def decode_stream(data: bytes) -> np.ndarray:
    """ARGB pixels (height, width) of a VP8L stream."""
    bits = Bits(data)
    if bits.read(8) != SIGNATURE:
        raise ValueError("not a lossless WebP stream")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)  # whether alpha is used: a hint only
    if bits.read(3):
        raise ValueError("the stream's version is unknown")
    wide, undo, kinds = width, [], set()
    while bits.read(1):
        kind = bits.read(2)
        if kind in kinds:
            raise ValueError("a transform is given twice")
        kinds.add(kind)
        if kind in (PREDICTOR, CROSS_COLOUR):
            tile = bits.read(3) + 2
            side = read_image(bits, -(-wide >> tile), -(-height >> tile))
            undo.append((_undo_predictor if kind == PREDICTOR else _undo_cross_colour, (wide, tile, side)))
        elif kind == SUBTRACT_GREEN:
            undo.append((_undo_subtract_green, ()))
        else:
            count = bits.read(8) + 1
            steps = _channels(read_image(bits, count, 1))
            colours = _joined(*(np.cumsum(c) for c in steps))
            packed = 3 if count <= 2 else 2 if count <= 4 else 1 if count <= 16 else 0
            undo.append((_undo_palette, (wide, packed, colours)))
            wide = -(-wide >> packed)
    pixels = read_image(bits, wide, height, main=True)
    for step, arguments in reversed(undo):
        pixels = step(pixels, *arguments)
    return pixels.reshape(height, width)


def frames(media: bytes) -> Iterator[bytes]:
    """The VP8L streams of joined WebP files."""
    at = 0
    while at < len(media):
        if media[at : at + 4] != b"RIFF" or media[at + 8 : at + 12] != b"WEBP":
            raise ValueError("not a WebP file")
        end = at + 8 + int.from_bytes(media[at + 4 : at + 8], "little")
        part, at = at + 12, end + (end - at) % 2
        while part + 8 <= end:
            size = int.from_bytes(media[part + 4 : part + 8], "little")
            if media[part : part + 4] == b"VP8L":
                yield media[part + 8 : part + 8 + size]
                break
            part += 8 + size + size % 2
        else:
            raise ValueError("the file has no lossless image")


def decode(media: bytes) -> list[np.ndarray]:
    """ARGB pixels of each frame."""
    return [decode_stream(data) for data in frames(media)]


def code_lengths(counts: np.ndarray, longest: int = 15) -> np.ndarray:
    """Lengths of a prefix code for the symbols that occur; at least two, and none over the longest."""
    lengths = np.zeros(len(counts), dtype=np.int64)
    used = np.flatnonzero(counts).tolist()
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    weights = counts[used].tolist()
    while True:
        heap = [(w, i) for i, w in enumerate(weights)]
        heapq.heapify(heap)
        up, following = {}, len(heap)
        while len(heap) > 1:
            w, x = heapq.heappop(heap)
            v, y = heap[0]
            up[x] = up[y] = following
            heapq.heapreplace(heap, (w + v, following))
            following += 1
        depth = {following - 1: 0}
        for node in range(following - 2, -1, -1):
            depth[node] = depth[up[node]] + 1
        found = [depth[i] for i in range(len(used))]
        if max(found) <= longest:
            lengths[used] = found
            return lengths
        weights = [(w + 1) // 2 for w in weights]


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The codes of these lengths with their bits in reverse, as they stand in the stream."""
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    longest = int(lengths[order[-1]])
    begins = np.concatenate([[0], np.cumsum(1 << (longest - lengths[order]))[:-1]])
    codes = np.zeros(len(lengths), dtype=np.int64)
    codes[order] = reversed_bits(longest)[begins]
    return codes


class Writer:
    """Bits put one after the other, the lowest first."""

    def __init__(self) -> None:
        self.value, self.size = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.size
        self.size += n


#: The encoder's fixed code for code lengths: symbols 0 to 12 take four bits, the others five.
_LENGTH_SIZES = np.array([4] * 13 + [5] * 6)
_LENGTH_CODES = canonical(_LENGTH_SIZES).tolist()


def write_code(out: Writer, lengths: np.ndarray) -> None:
    used = np.flatnonzero(lengths).tolist()
    if len(used) <= 1 and (not used or used[0] < 256):
        out.put(1 | (1 << 2), 3)  # simple, one symbol of eight bits
        out.put(used[0] if used else 0, 8)
        return
    out.put(0, 1)
    out.put(15, 4)
    for symbol in CODE_LENGTH_ORDER:
        out.put(int(_LENGTH_SIZES[symbol]), 3)
    out.put(0, 1)
    at, listed = 0, lengths.tolist()
    while at < len(listed):
        zeros = 0
        while at + zeros < len(listed) and zeros < 138 and not listed[at + zeros]:
            zeros += 1
        symbol = listed[at] if zeros < 3 else 17 if zeros < 11 else 18
        out.put(_LENGTH_CODES[symbol], int(_LENGTH_SIZES[symbol]))
        if zeros < 3:
            at += 1
        else:
            out.put(zeros - (3 if zeros < 11 else 11), 3 if zeros < 11 else 7)
            at += zeros


def matches(samples: np.ndarray) -> np.ndarray:
    """Back-references (where, length, distance) that do not overlap, from the begins of words on, each to the last place
    before that begins with the same MIN_MATCH samples."""
    none = np.empty((0, 3), dtype=np.int64)
    n = len(samples)
    if n < 2 * MIN_MATCH:
        return none
    space = (samples == 32) | (samples == 10)
    begins = np.concatenate([[0], np.flatnonzero(space[:-1] & ~space[1:]) + 1])
    begins = begins[begins + MIN_MATCH <= n]
    first = np.lib.stride_tricks.sliding_window_view(samples, MIN_MATCH)[begins].copy().view("<u8")
    key = first[:, 0] * np.uint64(0x9E3779B97F4A7C15) ^ first[:, 1] * np.uint64(0xC2B2AE3D27D4EB4F)
    order = np.argsort(key, kind="stable")
    same = np.flatnonzero(key[order[1:]] == key[order[:-1]]) + 1
    if not len(same):
        return none
    here, there = begins[order[same]], begins[order[same - 1]]
    turn = np.argsort(here)
    data, out, end = samples.tobytes(), [], 0
    for at, source in zip(here[turn].tolist(), there[turn].tolist(), strict=True):
        if at < end or data[at : at + MIN_MATCH] != data[source : source + MIN_MATCH]:
            continue
        length, most = MIN_MATCH, min(LONGEST_COPY, n - at)
        while length < most:
            part = min(256, most - length)
            a, b = samples[at + length : at + length + part], samples[source + length : source + length + part]
            differ = np.flatnonzero(a != b)
            length += int(differ[0]) if len(differ) else part
            if len(differ):
                break
        out.append((at, length, at - source))
        end = at + length
    return np.array(out, dtype=np.int64).reshape(-1, 3)


def prefixed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbol, extra bits, how many) for lengths or distance codes, the inverse of ``_amount``."""
    u = values.astype(np.int64) - 1
    high = np.frexp(np.maximum(u, 1).astype(np.float64))[1] - 1
    extra = np.where(u < 4, 0, high - 1)
    symbol = np.where(u < 4, u, 2 * high + (u >> np.maximum(high - 1, 0) & 1))
    return symbol, u & ((1 << extra) - 1), extra


def put_all(out: Writer, values: np.ndarray, sizes: np.ndarray) -> bytes:
    """The bits of the writer, then the values with these sizes, of at most 24 bits each."""
    head = out.value.to_bytes((out.size + 7) >> 3, "little")
    if not int(sizes.sum()):
        return head
    ends = np.cumsum(sizes) + (out.size & 7)
    begin = ends - sizes
    shifted = values << (begin & 7)
    byte, total = begin >> 3, (int(ends[-1]) + 7 >> 3) + 3
    body = np.bincount(byte, weights=shifted & 255, minlength=total)
    for k in range(1, 4):
        body += np.bincount(byte + k, weights=shifted >> 8 * k & 255, minlength=total)
    packed = bytearray(body[: total - 3].astype(np.uint8).tobytes())
    if out.size & 7:
        packed[0] |= head[-1]
        head = head[:-1]
    return head + bytes(packed)


def _put_single(out: Writer, symbol: int) -> None:
    out.put(1 | (1 << 2), 3)
    out.put(symbol, 8)


def _put_palette(out: Writer, colours: list[int]) -> None:
    """The palette transform: opaque colours that differ in green, each as its difference to the one before."""
    out.put(1, 1)
    out.put(PALETTE, 2)
    out.put(len(colours) - 1, 8)
    out.put(0, 1)  # no colour cache
    steps = [b - a for a, b in zip([0, *colours], colours, strict=False)]
    lengths = code_lengths(np.bincount(steps, minlength=LITERALS + LENGTHS))
    write_code(out, lengths)
    _put_single(out, 0)
    _put_single(out, 0)
    if len(colours) > 1:
        out.put(0b111, 3)  # simple, two symbols, the first of eight bits
        out.put(0, 8)
        out.put(255, 8)
    else:
        _put_single(out, 255)
    _put_single(out, 0)
    codes = canonical(lengths).tolist() if np.count_nonzero(lengths) > 1 else None
    for k, step in enumerate(steps):
        if codes:
            out.put(codes[step], int(lengths[step]))
        if len(colours) > 1:
            out.put(0 if k else 1, 1)  # alpha 255 for the first, no difference for the others


def encode_frame(samples: np.ndarray) -> bytes:
    """A WebP file of rows of 64 samples, in green; red and blue are 0 and alpha is 255."""
    out = Writer()
    for value, n in ((SIGNATURE, 8), (WIDTH - 1, 14), (len(samples) // WIDTH - 1, 14), (0, 1), (0, 3)):
        out.put(value, n)
    colours = np.flatnonzero(np.bincount(samples, minlength=LITERALS))
    if len(colours) <= 16:
        _put_palette(out, colours.tolist())
        packed = 3 if len(colours) <= 2 else 2 if len(colours) <= 4 else 1
        index = np.searchsorted(colours, samples).reshape(-1, 1 << packed)
        samples = (index << (8 >> packed) * np.arange(1 << packed)).sum(axis=1)
        copies = np.empty((0, 3), dtype=np.int64)
    else:
        copies = matches(samples)
    for value, n in ((0, 1), (0, 1), (0, 1)):  # no more transforms, no colour cache, one group of codes
        out.put(value, n)
    at, lengths, back = copies.T
    is_copied = np.zeros(len(samples) + 1, dtype=np.int64)
    is_copied[at] += 1
    np.subtract.at(is_copied, at + lengths, 1)
    literal = np.flatnonzero(np.cumsum(is_copied[:-1]) == 0)
    length_symbol, length_extra, length_bits = prefixed(lengths)
    back_symbol, back_extra, back_bits = prefixed(back + len(NEAR))
    counts = np.bincount(samples[literal], minlength=LITERALS + LENGTHS) + np.bincount(length_symbol + LITERALS, minlength=LITERALS + LENGTHS)
    green, distance = code_lengths(counts), code_lengths(np.bincount(back_symbol, minlength=DISTANCES))
    write_code(out, green)
    for only in (0, 0, 255):
        _put_single(out, only)
    write_code(out, distance)
    # A literal is one item; a back-reference four, in the place of its first sample.
    items = np.zeros(len(samples) + 1, dtype=np.int64)
    items[literal], items[at] = 1, 4
    first = np.concatenate([[0], np.cumsum(items)[:-1]])
    values, sizes = np.zeros(int(items.sum()), dtype=np.int64), np.zeros(int(items.sum()), dtype=np.int64)

    def put(where: np.ndarray, symbols: np.ndarray, code: np.ndarray) -> None:
        if np.count_nonzero(code) > 1:
            values[where], sizes[where] = canonical(code)[symbols], code[symbols]

    put(first[literal], samples[literal], green)
    put(first[at], length_symbol + LITERALS, green)
    put(first[at] + 2, back_symbol, distance)
    values[first[at] + 1], sizes[first[at] + 1] = length_extra, length_bits
    values[first[at] + 3], sizes[first[at] + 3] = back_extra, back_bits
    stream = put_all(out, values, sizes)
    chunk = b"VP8L" + len(stream).to_bytes(4, "little") + stream + bytes(len(stream) % 2)
    return b"RIFF" + (4 + len(chunk)).to_bytes(4, "little") + b"WEBP" + chunk


def payload(text: bytes) -> bytes:
    """The text followed by zero bytes up to a positive multiple of 64."""
    return text + bytes(-len(text) % BLOCK if text else BLOCK)


def encode(data: bytes) -> bytes:
    samples = np.frombuffer(data, dtype=np.uint8)
    return b"".join(encode_frame(samples[at : at + FRAME]) for at in range(0, len(samples), FRAME))


def store(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows (doc_id, n_bytes, media): the texts' payloads as joined WebP files."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch):
                bodies = [b.as_py() for b in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(b) for b in bodies], pa.int64()), pa.array([encode(payload(b)) for b in bodies], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(named(id_column).cast("long").alias("doc_id"), utf8(text_column).alias("body")).mapInArrow(scan, "doc_id long, n_bytes long, media binary")


def _parts(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Slices of a batch, so that results of many rows are not held at once."""
    return (batch.slice(at, rows) for at in range(0, batch.num_rows, rows))


#: Pixel arrays of a file's frames, row by row, as little-endian 32-bit ARGB.
IMAGES = "images array<struct<height: int, width: int, argb: binary>>"
_IMAGES = pa.list_(pa.struct([("height", pa.int32()), ("width", pa.int32()), ("argb", pa.binary())]))


def read(media: DataFrame) -> DataFrame:
    """Rows (doc_id, n_bytes, media_bytes, media_sha256, images) of ``media`` (doc_id, n_bytes, media): the pixel arrays."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch, 64):
                files = [m.as_py() for m in part.column(2)]
                images = [[{"height": i.shape[0], "width": i.shape[1], "argb": i.astype("<u4").tobytes()} for i in decode(m)] for m in files]
                columns = [pa.array([len(m) for m in files], pa.int64()), pa.array([hashlib.sha256(m).hexdigest() for m in files]), pa.array(images, _IMAGES)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], names=["doc_id", "n_bytes", "media_bytes", "media_sha256", "images"])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(scan, f"doc_id long, n_bytes long, media_bytes long, media_sha256 string, {IMAGES}")


def features(images: DataFrame) -> DataFrame:
    """Rows (doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) from the pixel
    arrays of ``read``: the payload is their green channel."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_features(row.as_py()) for row in batch.column(4)]
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns[:3], *batch.columns[2:4], columns[3]], names=names)

    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    return images.mapInArrow(scan, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def _features(images: list[dict]) -> tuple:
    samples = np.concatenate([(np.frombuffer(i["argb"], dtype="<u4") >> np.uint32(8)).astype(np.uint8) for i in images])
    back = samples.tobytes()
    shades = np.bincount(samples >> 5, minlength=8).tolist()
    feature = f"{WIDTH}x{len(samples) // WIDTH} sum={int(samples.sum(dtype=np.int64))} shades={','.join(map(str, shades))}"
    return len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-BLOCK:]), feature
