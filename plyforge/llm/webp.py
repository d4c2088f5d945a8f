"""Lossless WebP (VP8L): an encoder for byte payloads and a decoder of the whole format.

The decoder reads prefix codes (simple, normal, and groups chosen by an entropy
image), literals, back-references and the colour cache, and inverts the
predictor, cross-colour, subtract-green and palette transforms; it gives a pixel
array. Images whose only varying channel is green, as byte payloads are stored,
take a shorter path: the code word at every bit position is looked up at once
and the chain of positions is followed, up to the next back-reference.

A payload is written by prefix codes of its own, with back-references to what
occurred before, or, where it has few colours and a count of the bits says so,
over a packed palette.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import runs, text_column

#: Fixed values of the format: the order in which code length code lengths are stored.
CODE_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
MOST_ROWS = 16_384
#: The longest code word of a payload, of the 15 bits that the format allows: readers make tables of that many bits.
MOST_BITS = 12


LENGTH_CODES = 24
ALPHABETS = (256 + LENGTH_CODES, 256, 256, 256, 40)  # green with lengths, red, blue, alpha, distance


@lru_cache(1)
def neighbours() -> list[tuple[int, int]]:
    """(dx, dy) of the 120 short distance codes: by distance, then |dx|, right before left."""
    spots = [(x, y) for y in range(8) for x in range(-7, 9) if y > 0 or x > 0]
    return sorted(spots, key=lambda p: (p[0] * p[0] + p[1] * p[1], abs(p[0]), p[0] < 0))


# ---- prefix codes


def code_lengths(weights: list[float], most: int = 15) -> list[int]:
    """Huffman code lengths, at most `most`, of the symbols with a weight over 0."""
    used = [i for i, w in enumerate(weights) if w > 0]
    out = [0] * len(weights)
    if len(used) < 2:
        for i in used:
            out[i] = 1
        return out
    floor = 0.0
    while True:
        heap = [(max(weights[i], floor), k) for k, i in enumerate(used)]
        heapq.heapify(heap)
        parent, tie = [0] * (2 * len(used) - 1), len(used)
        while len(heap) > 1:
            a = heapq.heappop(heap)
            b = heap[0]
            parent[a[1]] = parent[b[1]] = tie
            heapq.heapreplace(heap, (a[0] + b[0], tie))
            tie += 1
        depth = [0] * len(parent)
        for k in range(len(parent) - 2, -1, -1):
            depth[k] = depth[parent[k]] + 1
        if max(depth) <= most:
            for k, i in enumerate(used):
                out[i] = depth[k]
            return out
        floor = max(2 * floor, sum(weights) / (1 << (most + 1)))


@lru_cache(1)
def reversed_words() -> np.ndarray:
    """Every number below 2 ** 15 with its 15 bits reversed."""
    n = np.arange(1 << 15)
    return sum(((n >> k) & 1) << (14 - k) for k in range(15))


def canonical(lengths: list[int]) -> list[int]:
    """Code words of the lengths, bits reversed as the stream stores them; a lone symbol has none."""
    n = np.asarray(lengths, np.int64)
    out = np.zeros(len(n), np.int64)
    used = np.flatnonzero(n)
    if len(used) < 2:
        return out.tolist()
    used = used[np.argsort(n[used], kind="stable")]
    size = n[used]
    space = 1 << (15 - size)  # a word of n bits takes 2 ** (15 - n) of the words of 15 bits
    code = (np.cumsum(space) - space) >> (15 - size)
    out[used] = reversed_words()[code] >> (15 - size)
    return out.tolist()


class Code:
    """A prefix code for reading: bits -> (symbol, length) by a table over its longest word."""

    def __init__(self, lengths: list[int]):
        self.lengths = lengths
        used = [s for s, n in enumerate(lengths) if n]
        self.only = used[0] if len(used) == 1 else None
        if not used:
            raise ValueError("a prefix code without symbols")
        self.width = 0 if self.only is not None else max(lengths)
        if self.only is not None:
            self.symbol, self.length = np.array([used[0]]), np.array([0])
            return
        if sum(1 << (15 - n) for n in lengths if n) != 1 << 15:
            raise ValueError("a prefix code that is not complete")
        self.symbol, self.length = np.zeros(1 << self.width, np.int64), np.zeros(1 << self.width, np.int64)
        words = canonical(lengths)
        for s in used:
            n = lengths[s]
            self.symbol[words[s] :: 1 << n] = s
            self.length[words[s] :: 1 << n] = n

    def read(self, bits: Bits) -> int:
        at = bits.peek(self.width)
        bits.at += int(self.length[at])
        return int(self.symbol[at])


class Bits:
    """Reads a stream from the lowest bit of each byte up."""

    def __init__(self, data: bytes):
        self.at, self.end, self.data = 0, 8 * len(data), data

    def peek(self, n: int) -> int:
        i = self.at >> 3
        return (int.from_bytes(self.data[i : i + 6], "little") >> (self.at & 7)) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        if self.at + n > self.end:
            raise ValueError("the stream ends early")
        out = self.peek(n)
        self.at += n
        return out


class Writer:
    def __init__(self):
        self.value, self.at = 0, 0

    def write(self, value: int, n: int) -> None:
        self.value |= value << self.at
        self.at += n

    def bytes(self) -> bytes:
        return self.value.to_bytes(-(-self.at // 8), "little")


@lru_cache(256)
def code_of(lengths: tuple[int, ...]) -> Code:
    return Code(list(lengths))


def read_code(bits: Bits, symbols: int) -> Code:
    lengths = [0] * symbols
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        lengths[bits.read(8 if wide else 1)] = 1
        if two:
            lengths[bits.read(8)] = 1
        return code_of(tuple(lengths))
    first = [0] * 19
    for i in range(4 + bits.read(4)):
        first[CODE_ORDER[i]] = bits.read(3)
    if first == [4] * 16 + [0] * 3 and not bits.read(1):  # four bits each
        raw = np.frombuffer(bits.data[bits.at >> 3 : (bits.at >> 3) + 2 * symbols // 4 + 2], np.uint8)
        at = (bits.at & 7) + np.arange(4 * symbols)
        if at[-1] >= 8 * len(raw):
            raise ValueError("the stream ends early")
        each = (raw[at >> 3] >> (at & 7)) & 1
        bits.at += 4 * symbols
        return Code((each.reshape(-1, 4) @ np.array([8, 4, 2, 1])).tolist())
    inner = code_of(tuple(first))
    left = symbols if first == [4] * 16 + [0] * 3 else 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else symbols
    s, before = 0, 8
    while s < symbols and left:
        left -= 1
        n = inner.read(bits)
        if n < 16:
            lengths[s] = n
            before = n or before
            s += 1
            continue
        value, times = (before, 3 + bits.read(2)) if n == 16 else (0, 3 + bits.read(3)) if n == 17 else (0, 11 + bits.read(7))
        if s + times > symbols:
            raise ValueError("code lengths run over their alphabet")
        lengths[s : s + times] = [value] * times
        s += times
    return code_of(tuple(lengths))


def write_code(out: Writer, lengths: list[int]) -> None:
    """The simple form for up to two symbols under 256, else every length by a code of four bits."""
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) <= 2 and all(s < 256 for s in used) and used:
        out.write(1, 1)
        out.write(len(used) - 1, 1)
        out.write(1, 1)
        for s in used:
            out.write(s, 8)
        return
    out.write(0, 1)
    out.write(15, 4)
    for s in CODE_ORDER:
        out.write(4 if s < 16 else 0, 3)
    out.write(0, 1)
    n = np.asarray(lengths, np.uint8)
    each = np.stack([n >> 3 & 1, n >> 2 & 1, n >> 1 & 1, n & 1], axis=1).reshape(-1)
    out.write(int.from_bytes(np.packbits(each, bitorder="little").tobytes(), "little"), 4 * len(n))


def prefix_value(value: int) -> tuple[int, int, int]:
    """Prefix symbol, extra bits' number and value of a length or distance code from 1 on."""
    if value <= 4:
        return value - 1, 0, 0
    v = value - 1
    extra = v.bit_length() - 2
    return 2 * (extra + 1) + (v >> extra & 1), extra, v & ((1 << extra) - 1)


def read_value(bits: Bits, prefix: int) -> int:
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


# ---- pixels


def div_up(n: int, bits: int) -> int:
    return (n + (1 << bits) - 1) >> bits


def cache_slot(color: int, bits: int) -> int:
    return (0x1E35A7BD * color & 0xFFFFFFFF) >> (32 - bits)


def distance_of(code: int, width: int) -> int:
    if code > 120:
        return code - 120
    dx, dy = neighbours()[code - 1]
    return max(1, dx + dy * width)


def read_image(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image as ARGB numbers, row after row."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("the colour cache is too large")
    group_of, shift = None, 0
    if main and bits.read(1):
        shift = bits.read(3) + 2
        group_of = ((read_image(bits, div_up(width, shift), div_up(height, shift), False) >> 8) & 0xFFFF).tolist()
    across = div_up(width, shift) if shift else 0
    sizes = (ALPHABETS[0] + (1 << cache_bits if cache_bits else 0), *ALPHABETS[1:])
    groups = [[read_code(bits, n) for n in sizes] for _ in range(max(group_of) + 1 if group_of else 1)]
    total = width * height
    if len(groups) == 1 and not cache_bits and all(c.only is not None for c in groups[0][1:4]):
        return green_only(bits, groups[0], width, total)
    out, cache, done = [0] * total, [0] * (1 << cache_bits), 0
    while done < total:
        codes = groups[group_of[(done // width >> shift) * across + (done % width >> shift)]] if group_of else groups[0]
        s = codes[0].read(bits)
        if s < 256:
            red, blue, alpha = (c.read(bits) for c in codes[1:4])
            run = [alpha << 24 | red << 16 | s << 8 | blue]
        elif s < 256 + LENGTH_CODES:
            length = read_value(bits, s - 256)
            back = distance_of(read_value(bits, codes[4].read(bits)), width)
            if back > done or done + length > total:
                raise ValueError("a back-reference leaves the image")
            run = [0] * length
            for i in range(length):
                run[i] = out[done + i] = out[done + i - back]
        else:
            run = [cache[s - 256 - LENGTH_CODES]]
        out[done : done + len(run)] = run
        done += len(run)
        if cache_bits:
            for color in run:
                cache[cache_slot(color, cache_bits)] = color
        if bits.at > bits.end:
            raise ValueError("the stream ends early")
    return np.array(out, np.int64)


class Chain:
    """Literals of a prefix code from a bit position on: code words at all positions of a stretch, then from each word's end to the next."""

    def __init__(self, code: Code, data: bytes, stretch: int = 1 << 17):
        raw = np.frombuffer(data + bytes(8), np.uint8).astype(np.int32)
        self.window = raw[:-2] | raw[1:-1] << 8 | raw[2:] << 16
        self.symbol, self.mask, self.stretch, self.from_, self.lengths = code.symbol, (1 << code.width) - 1, stretch, 0, b""
        self.step = np.where(code.symbol < 256, code.length, 0).astype(np.uint8)  # 0 ends a chain

    def literals(self, at: int, end: int, most: int) -> tuple[bytes, int]:
        """At most so many literals, and the position after them; none where another symbol, or the end, comes next."""
        if not self.from_ <= at < self.from_ + len(self.lengths) - 80:
            p = np.arange(at, max(at, min(at + self.stretch, end)))
            self.words = (self.window[p >> 3] >> (p & 7)) & self.mask
            self.from_, self.lengths = at, self.step[self.words].tobytes() + bytes(16)
        lengths, p, found = self.lengths, at - self.from_, []
        add = found.append
        while n := lengths[p]:
            add(p)
            p += n
        if len(found) > most:
            p, found = found[most], found[:most]
        return self.symbol[self.words[found]].astype(np.uint8).tobytes(), p + self.from_


def green_only(bits: Bits, codes: list[Code], width: int, total: int) -> np.ndarray:
    """An image whose pixels differ in green only, without a cache: many literals a step, back-references one by one."""
    red, blue, alpha = (c.only for c in codes[1:4])
    base = alpha << 24 | red << 16 | blue
    green, distance = codes[0], codes[4]
    if green.only is not None:
        if green.only > 255:
            raise ValueError("a back-reference leaves the image")
        return np.full(total, base | green.only << 8, np.int64)
    out, at, end = bytearray(), bits.at, bits.end
    chain = Chain(green, bits.data)
    while len(out) < total:
        got, after = chain.literals(at, end, total - len(out))
        if got:
            out += got
            at = after
            continue
        bits.at = at
        s = green.read(bits)
        at = bits.at
        if at > end + 16:
            break
        if s < 256:
            out.append(s)
            continue
        length = read_value(bits, s - 256)
        back = distance_of(read_value(bits, distance.read(bits)), width)
        at = bits.at
        if back > len(out) or len(out) + length > total:
            raise ValueError("a back-reference leaves the image")
        tail = bytes(out[-back:]) if back <= length else bytes(out[len(out) - back : len(out) - back + length])
        out += (tail * -(-length // len(tail)))[:length]
    if len(out) < total or at > end + 16:
        raise ValueError("the stream ends early")
    bits.at = at
    return base | np.frombuffer(bytes(out), np.uint8, total).astype(np.int64) << 8


def split(argb: np.ndarray) -> list[np.ndarray]:
    return [(argb >> s) & 255 for s in (24, 16, 8, 0)]


def join(a, r, g, b):
    return (a & 255) << 24 | (r & 255) << 16 | (g & 255) << 8 | (b & 255)


def predict(mode: int, left: list[int], top: list[int], corner: list[int], right: list[int]) -> list[int]:
    """The 14 predictors, by channel; modes 14 and 15 are black."""

    def half(x: list[int], y: list[int]) -> list[int]:
        return [(p + q) // 2 for p, q in zip(x, y, strict=True)]

    def clamp(v: int) -> int:
        return 0 if v < 0 else 255 if v > 255 else v

    if mode in (0, 14, 15):
        return [255, 0, 0, 0]
    if mode < 5:
        return (left, top, right, corner)[mode - 1]
    if mode == 5:
        return half(half(left, right), top)
    if mode < 11:
        x, y = ((left, corner), (left, top), (corner, top), (top, right))[mode - 6] if mode < 10 else (half(left, corner), half(top, right))
        return half(x, y)
    if mode == 11:
        to_left = sum(abs(t - c) for t, c in zip(top, corner, strict=True))
        to_top = sum(abs(x - c) for x, c in zip(left, corner, strict=True))
        return left if to_left < to_top else top
    if mode == 12:
        return [clamp(x + t - c) for x, t, c in zip(left, top, corner, strict=True)]
    mean = half(left, top)
    return [clamp(m + int((m - c) / 2)) for m, c in zip(mean, corner, strict=True)]


def predictor(argb: np.ndarray, width: int, height: int, modes: np.ndarray, size: int, sign: int) -> np.ndarray:
    """Add (sign 1: argb holds residuals) or subtract (sign -1: argb holds pixels) the predictions."""
    used = np.unique(modes >> 8 & 15)
    if sign > 0 and len(used) == 1 and used[0] in (1, 2):  # left or top alone: running sums
        rest = np.stack(split(argb)).reshape(4, height, width)
        rest[0, 0, 0] += 255
        first = np.s_[:, :, 0] if used[0] == 1 else np.s_[:, 0]
        rest[first] = np.cumsum(rest[first], axis=1)
        return join(*np.cumsum(rest, axis=3 - int(used[0])).reshape(4, -1))
    px = np.stack(split(argb), axis=1).tolist()
    out, across = [None] * len(px), div_up(width, size)
    known = out if sign > 0 else px
    for i in range(len(px)):
        x, y = i % width, i // width
        if not i:
            guess = [255, 0, 0, 0]
        elif not y:
            guess = known[i - 1]
        elif not x:
            guess = known[i - width]
        else:
            mode = int(modes[(y >> size) * across + (x >> size)] >> 8) & 15
            guess = predict(mode, known[i - 1], known[i - width], known[i - width - 1], known[i - width + 1])
        out[i] = [(v + sign * g) & 255 for v, g in zip(px[i], guess, strict=True)]
    a, r, g, b = np.array(out, np.int64).reshape(-1, 4).T
    return join(a, r, g, b)


def cross_colour(argb: np.ndarray, width: int, height: int, elements: np.ndarray, size: int, sign: int) -> np.ndarray:
    """Add or subtract the shares that green has in red and blue, and red in blue."""

    def delta(factor: np.ndarray, channel: np.ndarray) -> np.ndarray:
        as_signed = [np.where(v > 127, v - 256, v) for v in (factor, channel)]
        return (as_signed[0] * as_signed[1]) >> 5

    i = np.arange(len(argb))
    _, red_blue, green_blue, green_red = split(elements[(i // width >> size) * div_up(width, size) + (i % width >> size)])
    a, r, g, b = split(argb)
    changed = (r + sign * delta(green_red, g)) & 255
    b = b + sign * (delta(green_blue, g) + delta(red_blue, changed if sign > 0 else r))
    return join(a, changed, g, b)


def subtract_green(argb: np.ndarray, sign: int) -> np.ndarray:
    a, r, g, b = split(argb)
    return join(a, r + sign * g, g, b + sign * g)


def palette_bits(colors: int) -> int:
    return 3 if colors <= 2 else 2 if colors <= 4 else 1 if colors <= 16 else 0


def from_palette(packed: np.ndarray, width: int, height: int, table: np.ndarray) -> np.ndarray:
    """Pixels of colour indices, several to a pixel in small palettes; an index beyond the table is transparent black."""
    bits = palette_bits(len(table))
    across, each = div_up(width, bits), 8 >> bits
    green = ((packed >> 8) & 255).reshape(height, across)
    x = np.arange(width)
    index = (green[:, x >> bits] >> (each * (x & ((1 << bits) - 1)))) & ((1 << each) - 1)
    return np.concatenate([table, np.zeros(256, np.int64)])[index.reshape(-1)]


def delta_table(table: np.ndarray, sign: int) -> np.ndarray:
    """Colour tables are stored as differences by channel."""
    parts = split(table)
    return join(*[np.cumsum(p) if sign > 0 else np.diff(p, prepend=0) for p in parts])


def decode(data: bytes) -> np.ndarray:
    """The pixels (height x width) of one lossless WebP file, as ARGB numbers."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP" or data[12:16] != b"VP8L" or data[20:21] != b"/":
        raise ValueError("not a lossless WebP file")
    size = int.from_bytes(data[16:20], "little")
    if 20 + size > len(data):
        raise ValueError("the file is cut")
    bits = Bits(data[21 : 20 + size])
    width, height = bits.read(14) + 1, bits.read(14) + 1
    opaque = not bits.read(1)
    if bits.read(3):
        raise ValueError("an unknown version")
    undo, across, seen = [], width, set()
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise ValueError("a transform twice")
        seen.add(kind)
        if kind < 2:
            block = bits.read(3) + 2
            grid = read_image(bits, div_up(across, block), div_up(height, block), False)
            undo.append(lambda px, w=across, g=grid, s=block, f=(predictor, cross_colour)[kind]: f(px, w, height, g, s, 1))
        elif kind == 2:
            undo.append(lambda px: subtract_green(px, 1))
        else:
            table = delta_table(read_image(bits, bits.read(8) + 1, 1, False), 1)
            undo.append(lambda px, w=across, t=table: from_palette(px, w, height, t))
            across = div_up(across, palette_bits(len(table)))
    px = read_image(bits, across, height, True)
    for f in reversed(undo):
        px = f(px)
    if opaque:
        px = px | 255 << 24
    return px.reshape(height, width)


# ---- writing


def write_image(out: Writer, argb: np.ndarray, width: int, main: bool, cache_bits: int = 0, runs_from: int = 3, groups: int = 1) -> None:
    """Literals, runs (back-references to the left or above), cached colours; `groups` > 1 gives each block of rows a code group."""
    px, i, symbols = argb.tolist(), 0, []
    cache = [None] * (1 << cache_bits)
    while i < len(px):
        best, back = 0, 0
        for d in (1, width, 2, width + 1):
            n = 0
            while d <= i and i + n < len(px) and n < 4096 and px[i + n] == px[i + n - d]:
                n += 1
            if n > best:
                best, back = n, d
        if best >= runs_from:
            symbols.append((i, "back", best, back))
            taken = px[i : i + best]
        elif cache_bits and cache[cache_slot(px[i], cache_bits)] == px[i]:
            symbols.append((i, "cache", cache_slot(px[i], cache_bits), 0))
            taken = px[i : i + 1]
        else:
            symbols.append((i, "pixel", px[i], 0))
            taken = px[i : i + 1]
        if cache_bits:
            for c in taken:
                cache[cache_slot(c, cache_bits)] = c
        i += len(taken)
    out.write(1 if cache_bits else 0, 1)
    if cache_bits:
        out.write(cache_bits, 4)
    shift, height = 2, len(px) // width
    down = div_up(height, shift)
    groups = min(groups, down)
    group = lambda i: (i // width >> shift) % groups
    if main:
        out.write(int(groups > 1), 1)
        if groups > 1:
            out.write(shift - 2, 3)
            rows = np.repeat(np.arange(down) % groups, div_up(width, shift))
            write_image(out, rows.astype(np.int64) << 8 | 255 << 24, div_up(width, shift), False)
    sizes = (ALPHABETS[0] + (1 << cache_bits if cache_bits else 0), *ALPHABETS[1:])
    counts = [[[0] * n for n in sizes] for _ in range(groups)]
    coded = []
    for i, kind, x, y in symbols:
        if kind == "pixel":
            parts = [(0, x >> 8 & 255, 0, 0), (1, x >> 16 & 255, 0, 0), (2, x & 255, 0, 0), (3, x >> 24 & 255, 0, 0)]
        elif kind == "cache":
            parts = [(0, 256 + LENGTH_CODES + x, 0, 0)]
        else:
            short = {distance_of(k, width): k for k in range(120, 0, -1)}
            length, dist = prefix_value(x), prefix_value(short.get(y, y + 120))
            parts = [(0, 256 + length[0], *length[1:]), (4, dist[0], *dist[1:])]
        coded.append((group(i), parts))
        for c, s, _, _ in parts:
            counts[group(i)][c][s] += 1
    words = []
    for g in range(groups):
        for c in counts[g]:
            if not any(c):
                c[0] = 1
        lengths = [code_lengths(c) for c in counts[g]]
        for n in lengths:
            write_code(out, n)
        words.append([list(zip(canonical(n), n if sum(map(bool, n)) > 1 else [0] * len(n), strict=True)) for n in lengths])
    for g, parts in coded:
        for c, s, extra, value in parts:
            out.write(*words[g][c][s])
            out.write(value, extra)


def riff(stream: bytes) -> bytes:
    body = b"/" + stream
    padded = body + b"\0" * (len(body) % 2)
    return b"RIFF" + (12 + len(padded)).to_bytes(4, "little") + b"WEBPVP8L" + len(body).to_bytes(4, "little") + padded


def encode(argb: np.ndarray, transforms: tuple[str, ...] = (), cache_bits: int = 0, block: int = 2, groups: int = 1) -> bytes:
    """A lossless WebP file of ARGB numbers (height x width) by any of: palette, predictor, cross, green, in the order given."""
    height, width = argb.shape
    out, px, across = Writer(), argb.reshape(-1).astype(np.int64), width
    opaque = bool((px >> 24 == 255).all())
    for value, n in ((width - 1, 14), (height - 1, 14), (int(not opaque), 1), (0, 3)):
        out.write(value, n)
    for name in transforms:
        out.write(1, 1)
        out.write(("predictor", "cross", "green", "palette").index(name), 2)
        if name in ("predictor", "cross"):
            out.write(block - 2, 3)
            n = div_up(across, block) * div_up(height, block)
            # every mode and factor in turn: what is smallest is no concern of this general writer
            grid = (np.arange(n) % 14) << 8 if name == "predictor" else join(0, np.arange(n) * 37, np.arange(n) * 91, np.arange(n) * 53)
            grid = grid | 255 << 24
            write_image(out, grid, div_up(across, block), False)
            px = (predictor if name == "predictor" else cross_colour)(px, across, height, grid, block, -1)
        elif name == "green":
            px = subtract_green(px, -1)
        else:
            table, index = np.unique(px, return_inverse=True)
            if len(table) > 256:
                raise ValueError("too many colours for a palette")
            out.write(len(table) - 1, 8)
            write_image(out, delta_table(table, -1), len(table), False)
            bits = palette_bits(len(table))
            packed = np.zeros((height, div_up(across, bits)), np.int64)
            index, each = index.reshape(height, across), 8 >> bits
            for x in range(across):
                packed[:, x >> bits] |= index[:, x] << (each * (x & ((1 << bits) - 1)))
            px, across = join(255, 0, packed.reshape(-1), 0), packed.shape[1]
    out.write(0, 1)
    write_image(out, px, across, True, cache_bits, groups=groups)
    return riff(out.bytes())


# ---- byte payloads


def repeats(data: np.ndarray, least: int = 16, window: int = 8) -> list[tuple[int, int, int]]:
    """(place, length, distance) of stretches that occurred before, in order and apart: runs of windows whose last occurrence lies equally far back."""
    if len(data) < 2 * window:
        return []
    w = np.lib.stride_tricks.sliding_window_view(data, window).copy().view("<u8").reshape(-1)
    order = np.argsort(w, kind="stable")
    again = np.flatnonzero(w[order[1:]] == w[order[:-1]]) + 1
    if not len(again):
        return []
    back = np.zeros(len(w), np.int64)
    back[order[again]] = order[again] - order[again - 1]
    edge = np.flatnonzero(np.concatenate([[True], back[1:] != back[:-1]]))
    n = np.diff(np.append(edge, len(back)))
    out, done = [], 0
    for a, size in zip(edge[back[edge] > 0].tolist(), n[back[edge] > 0].tolist(), strict=True):
        start, stop = max(a, done), a + size + window - 1
        if stop - start >= least:
            out.append((start, stop - start, int(back[a])))
            done = stop
    return out


@lru_cache(8)
def short_distances(width: int) -> dict[int, int]:
    return {distance_of(k, width): k for k in range(120, 0, -1)}


def references(found: list[tuple[int, int, int]], width: int) -> list[tuple[int, int, tuple, tuple]]:
    """Place, length, and the prefix values of length and distance; lengths over 4096 become several."""
    short, out = short_distances(width), []
    for place, length, back in found:
        distance = prefix_value(short.get(back, back + 120))
        while length:
            n = min(length, 4096)
            out.append((place, n, prefix_value(n), distance))
            place, length = place + n, length - n
    return out


def own_counts(data: np.ndarray, refs: list) -> tuple[np.ndarray, np.ndarray, int]:
    """How often each symbol and each distance prefix occurs, and the references' extra bits."""
    literal = np.ones(len(data), bool)
    counts, distances, extra = np.zeros(256 + LENGTH_CODES, np.int64), np.zeros(40, np.int64), 0
    for place, n, length, distance in refs:
        literal[place : place + n] = False
        counts[256 + length[0]] += 1
        distances[distance[0]] += 1
        extra += length[1] + distance[1]
    counts[:256] += np.bincount(data[literal], minlength=256)
    return counts, distances, extra


def own_bits(counts: np.ndarray, distances: np.ndarray, extra: int) -> float:
    """About how many bits a code of its own takes: the entropy, the extra bits and the code lengths."""
    total = 0.0
    for c in (counts, distances):
        c = c[c > 0].astype(float)
        total += float((c * np.log2(c.sum() / c)).sum()) if len(c) else 0.0
    return total * 1.01 + extra + 4 * (len(counts) + (len(distances) if (distances > 0).sum() > 2 else 4)) + 120


def pack_bits(values: np.ndarray, sizes: np.ndarray, head: int, head_bits: int) -> np.ndarray:
    """A stream's bytes: the head's bits, then each value in its number of bits (25 at most)."""
    start = head_bits + np.cumsum(sizes) - sizes
    total = int(start[-1] + sizes[-1]) if len(sizes) else head_bits
    spread, byte = values.astype(np.int64) << (start & 7), start >> 3
    stream = np.zeros((total >> 3) + 4, np.int64)
    for k in range(4):  # no two words share a bit, so sums are unions
        part = (spread >> (8 * k)) & 255
        stream += np.bincount(byte + k, part, len(stream))[: len(stream)].astype(np.int64)
    raw = np.frombuffer(head.to_bytes(-(-head_bits // 8), "little"), np.uint8)
    stream[: len(raw)] += raw
    return stream[: -(-total // 8)].astype(np.uint8)


def write_own(out: Writer, data: np.ndarray, refs: list, counts: np.ndarray, distances: np.ndarray, alpha: int = 255) -> bytes:
    """The image's data by codes of its own, after what the writer has; all pixels have the one alpha."""
    for _ in range(3):  # no more transforms, no cache, one code group
        out.write(0, 1)
    if not distances.any():
        distances[0] = 1
    used = [code_lengths(c.tolist(), MOST_BITS) for c in (counts, distances)]
    write_code(out, used[0])
    for only in (0, 0, alpha):
        write_code(out, [int(s == only) for s in range(256)])
    write_code(out, used[1])
    (word, size), (far_word, far_size) = ((np.array(canonical(n), np.int64), np.array(n if sum(map(bool, n)) > 1 else [0] * len(n), np.int64)) for n in used)
    values, sizes, done = [], [], 0
    for place, n, length, distance in refs:
        plain = data[done:place]
        values += [word[plain], [word[256 + length[0]], length[2], far_word[distance[0]], distance[2]]]
        sizes += [size[plain], [size[256 + length[0]], length[1], far_size[distance[0]], distance[1]]]
        done = place + n
    values.append(word[data[done:]])
    sizes.append(size[data[done:]])
    return pack_bits(np.concatenate(values).astype(np.int64), np.concatenate(sizes).astype(np.int64), out.value, out.at).tobytes()


def payload(text: bytes, width: int = 576) -> np.ndarray:
    """The text's bytes and bytes 255 up to a positive multiple of the width."""
    n = max(1, -(-len(text) // width)) * width
    out = np.full(n, 255, np.uint8)
    out[: len(text)] = np.frombuffer(text, np.uint8)
    return out


def encode_payload(data: np.ndarray, width: int = 576) -> bytes:
    """Bytes (a multiple of width) as green samples: images of MOST_ROWS rows at most, one file after another."""
    most = width * MOST_ROWS
    return b"".join(_encode_part(data[k : k + most], width) for k in range(0, len(data), most))


def from_left(data: np.ndarray, width: int) -> np.ndarray:
    """Differences to the left sample, and in the first column to the one above."""
    image = data.reshape(-1, width)
    out = image.copy()
    out[:, 1:] -= image[:, :-1]
    out[1:, 0] -= image[:-1, 0]
    return out.reshape(-1)


def _encode_part(data: np.ndarray, width: int) -> bytes:
    """The smallest by estimate of: bytes as they are, differences to the left (the predictor transform), and a packed palette."""
    refs = references(repeats(data), width)
    counts, distances, extra = own_counts(data, refs)
    size, alpha = own_bits(counts, distances, extra), 255
    out = Writer()
    out.write((width - 1) | (len(data) // width - 1) << 14, 32)
    form = data
    if 10 * np.count_nonzero((data[1:] == data[:-1]) & (data[1:] < 255)) > len(data):  # cheap to ask, and true of few texts: differences are often 0
        rest = from_left(data, width)
        rest_refs = references(repeats(rest), width)
        of_rest = own_counts(rest, rest_refs)
        if (bits := own_bits(*of_rest) + 60) < size:
            size, form, refs, (counts, distances, _), alpha = bits, rest, rest_refs, of_rest, 0
    colours = np.flatnonzero(np.bincount(data, minlength=256))
    if len(colours) <= 16:
        bits = palette_bits(len(colours))
        index = np.searchsorted(colours, data).reshape(-1, div_up(width, bits), 1 << bits)
        packed = (index << ((8 >> bits) * np.arange(1 << bits))).sum(axis=2).astype(np.uint8).reshape(-1)
        packed_refs = references(repeats(packed), div_up(width, bits))
        of_packed = own_counts(packed, packed_refs)
        if own_bits(*of_packed) + 16 * len(colours) + 100 < size:
            out.write(1, 1)
            out.write(3, 2)
            out.write(len(colours) - 1, 8)
            write_image(out, delta_table(join(255, 0, colours, 0), -1), len(colours), False)
            form, refs, (counts, distances, _), alpha = packed, packed_refs, of_packed, 255
    if not alpha:
        out.write(1, 1)
        out.write(0, 2)
        out.write(7, 3)  # blocks of 512, all of the left predictor
        across = div_up(width, 9)
        write_image(out, np.full(across * div_up(len(data) // width, 9), 255 << 24 | 1 << 8, np.int64), across, False)
    return riff(write_own(out, form, refs, counts, distances, alpha))


def decode_payload(data: bytes) -> np.ndarray:
    """All files' green samples in a row."""
    parts = []
    while data:
        size = 8 + int.from_bytes(data[4:8], "little")
        parts.append(((decode(data[:size]) >> 8) & 255).astype(np.uint8).reshape(-1))
        data = data[size:]
    return np.concatenate(parts) if parts else np.empty(0, np.uint8)


def store(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 576) -> DataFrame:
    """(key, n_bytes, media): each whole text's payload as lossless WebP.

    A null text is an empty one; equal texts give equal media; rows of null or
    repeated keys give a row each; an empty table gives none. Other columns are
    not carried.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_column(batch, "text")
            for a, b in runs(texts, 8 << 20):
                raw = [t.encode() for t in texts[a:b].to_pylist()]
                media = [encode_payload(payload(r, width), width) for r in raw]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array([len(r) for r in raw], pa.int64()), pa.array(media, pa.binary())], ["key", "n_bytes", "media"])

    kind = docs.schema[key].dataType.simpleString()
    kept = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return kept.mapInArrow(run, f"key {kind}, n_bytes long, media binary").withColumnRenamed("key", key)


def read(media: DataFrame, key: str = "doc_id", with_pixels: bool = False) -> DataFrame:
    """Decode stored media (key, n_bytes, media): payload digests, a feature of the samples and, if wanted, the samples themselves.

    A row each, also of null or repeated keys; an empty table gives none, and a
    file that is no lossless WebP is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = batch.column(2)
            for a, b in runs(files, 4 << 20):
                cols: list[list] = [[] for _ in range(7)]
                for x in files[a:b].to_pylist():
                    px = decode_payload(x)
                    raw = px.tobytes()
                    levels = np.bincount(px >> 5, minlength=8)
                    row = (len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-32:]), len(x), hashlib.sha256(x).hexdigest(), f"{len(raw) // 576}x576:" + ",".join(map(str, levels.tolist())), raw if with_pixels else None)
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
                types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b], *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], NAMES)

    kind = media.schema[key].dataType.simpleString()
    out = media.select(F.col(key).alias("key"), "n_bytes", "media").mapInArrow(run, f"key {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pixels binary")
    return (out if with_pixels else out.drop("pixels")).withColumnRenamed("key", key)


NAMES = ["key", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pixels"]
