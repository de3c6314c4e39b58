"""A decoder of lossless WebP on numpy, after its published bitstream specification.

Prefix codes, copies and the colour cache are read pixel by pixel, as each
depends on those before; the transforms are undone for whole images at once,
predictions along diagonals.  Lossy and animated files are errors.
"""

from __future__ import annotations

import struct

import numpy as np

#: Fixed by the format: the order in which lengths of the code of code lengths are stored.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
#: Short distances name neighbours, the nearest first; equal ones by column, right before left.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if (y or x > 0)), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), -p[0]))
COPIES, CACHE_AT = 24, 256 + 24


class Bits:
    """Bits from the lowest of each byte on; zeros beyond the end, which then is an error."""

    def __init__(self, raw: bytes):
        self.raw, self.at, self.held, self.n = raw, 0, 0, 0

    def fill(self, n: int) -> None:
        while self.n < n:
            part = self.raw[self.at : self.at + 8]
            if not part and self.at > len(self.raw) + 64:
                raise ValueError("image data ends early")
            self.held |= int.from_bytes(part, "little") << self.n
            self.n += 64
            self.at += 8

    def read(self, n: int) -> int:
        if self.n < n:
            self.fill(n)
        out = self.held & ((1 << n) - 1)
        self.held >>= n
        self.n -= n
        return out


class Code:
    """A canonical prefix code: a table by the next bits, and the symbol that needs none."""

    def __init__(self, lengths: list[int]):
        used = [(n, s) for s, n in enumerate(lengths) if n]
        self.only = used[0][1] if len(used) == 1 else None
        if not used:
            self.only = 0
        if self.only is not None:
            return
        if sum(2.0**-n for n, _ in used) != 1:
            raise ValueError("a prefix code that isn't complete")
        self.width = max(n for n, _ in used)
        self.table: list[tuple[int, int]] = [(0, 0)] * (1 << self.width)
        code, before = 0, 0
        for n, s in sorted(used):
            code <<= n - before
            turned = int(f"{code:0{n}b}"[::-1], 2)
            for k in range(turned, 1 << self.width, 1 << n):
                self.table[k] = n, s
            code, before = code + 1, n

    def read(self, bits: Bits) -> int:
        if self.only is not None:
            return self.only
        if bits.n < self.width:
            bits.fill(self.width)
        n, s = self.table[bits.held & ((1 << self.width) - 1)]
        bits.held >>= n
        bits.n -= n
        return s


def _read_code(bits: Bits, size: int) -> Code:
    lengths = [0] * size
    if bits.read(1):
        two = bits.read(1)
        symbols = [bits.read(8 if bits.read(1) else 1)] + ([bits.read(8)] if two else [])
        for s in symbols:
            if s >= size:
                raise ValueError("a symbol beyond the alphabet")
            lengths[s] = 1
        return Code(lengths)
    own = [0] * 19
    for k in range(4 + bits.read(4)):
        own[LENGTH_ORDER[k]] = bits.read(3)
    code = Code(own)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    at, before = 0, 8
    while at < size and left:
        left -= 1
        s = code.read(bits)
        if s < 16:
            lengths[at] = s
            at, before = at + 1, s or before
            continue
        value, n = (before, 3 + bits.read(2)) if s == 16 else (0, 3 + bits.read(3)) if s == 17 else (0, 11 + bits.read(7))
        if at + n > size:
            raise ValueError("code lengths beyond the alphabet")
        lengths[at : at + n] = [value] * n
        at += n
    return Code(lengths)


def _number(bits: Bits, prefix: int) -> int:
    """A length or distance from its prefix."""
    if prefix < 4:
        return prefix + 1
    more = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << more) + bits.read(more) + 1


def _pixels(bits: Bits, w: int, h: int, main: bool) -> np.ndarray:
    """(h, w) of ARGB numbers, before transforms."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("colour cache too large")
    cache = [0] * (1 << cache_bits) if cache_bits else []
    groups, block = None, 0
    if main and bits.read(1):
        block = bits.read(3) + 2
        groups = (_pixels(bits, (w + (1 << block) - 1) >> block, (h + (1 << block) - 1) >> block, False) >> 8) & 0xFFFF
    sizes = (CACHE_AT + len(cache), 256, 256, 256, 40)
    codes = [[_read_code(bits, n) for n in sizes] for _ in range(int(groups.max()) + 1 if groups is not None else 1)]
    out, at, total, shift = [0] * (w * h), 0, w * h, 32 - cache_bits
    green, red, blue, alpha, far = codes[0]
    pending = 0  # pixels before it are in the cache
    while at < total:
        if groups is not None:
            y, x = divmod(at, w)
            green, red, blue, alpha, far = codes[groups[y >> block, x >> block]]
        s = green.read(bits)
        if s < 256:
            r = red.read(bits)
            b = blue.read(bits)
            out[at] = alpha.read(bits) << 24 | r << 16 | s << 8 | b
            at += 1
        elif s < CACHE_AT:
            n = _number(bits, s - 256)
            d = _number(bits, far.read(bits))
            if d > len(NEAR):
                d -= len(NEAR)
            else:
                x, y = NEAR[d - 1]
                d = max(1, x + y * w)
            if d > at or at + n > total:
                raise ValueError("a copy from outside the image")
            for k in range(at, at + n):
                out[k] = out[k - d]
            at += n
        else:
            if not cache:
                raise ValueError("a colour from a cache that isn't there")
            for v in out[pending:at]:
                cache[(v * 0x1E35A7BD & 0xFFFFFFFF) >> shift] = v
            pending = at
            out[at] = cache[s - CACHE_AT]
            at += 1
    return np.array(out, np.int64).reshape(h, w)


def _split(argb: np.ndarray) -> np.ndarray:
    """(..., 4) of r, g, b, a."""
    return np.stack([argb >> 16 & 255, argb >> 8 & 255, argb & 255, argb >> 24 & 255], axis=-1)


def _average(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a + b) >> 1


def predictions(left, top, right, corner) -> list[np.ndarray]:
    """What each of the fourteen modes expects from the pixels left, above, right above and left above."""
    select = np.where((abs(top - corner).sum(axis=-1, keepdims=True) < abs(left - corner).sum(axis=-1, keepdims=True)), left, top)
    mean = _average(left, top)
    half = mean + np.trunc((mean - corner) / 2).astype(np.int64)
    black = np.zeros_like(left) + np.array([0, 0, 0, 255])
    return [
        black, left, top, right, corner, _average(_average(left, right), top), _average(left, corner), mean, _average(corner, top), _average(top, right),
        _average(_average(left, corner), _average(top, right)), select, np.clip(left + top - corner, 0, 255), np.clip(half, 0, 255),
    ]


def _unpredict(px: np.ndarray, modes: np.ndarray) -> np.ndarray:
    """A pixel needs those left and in the row above up to one on the right, so it comes at step x + 2y."""
    h, w = modes.shape
    out = px.copy()
    out[0, 0] = (px[0, 0] + np.array([0, 0, 0, 255])) & 255
    out[0, 1:] = (np.cumsum(px[0], axis=0)[1:] + np.array([0, 0, 0, 255])) & 255
    for t in range(2, w + 2 * h - 2):
        y = np.arange(max(1, (t - w + 2) // 2), min(h - 1, t // 2) + 1)
        if not len(y):
            continue
        x = t - 2 * y
        top = out[y - 1, x]
        last = x == w - 1  # there the first pixel of the own row stands right above
        right = out[np.where(last, y, y - 1), np.where(last, 0, x + 1)]
        edge = x == 0
        left = np.where(edge[:, None], top, out[y, x - 1])
        corner = np.where(edge[:, None], top, out[y - 1, x - 1])
        guess = np.stack(predictions(left, top, right, corner))
        mode = np.where(edge, 2, modes[y, x])
        out[y, x] = (px[y, x] + guess[mode, np.arange(len(y))]) & 255
    return out


def _spread(blocks: np.ndarray, bits: int, w: int, h: int) -> np.ndarray:
    """The block of each pixel."""
    return np.repeat(np.repeat(blocks, 1 << bits, axis=0), 1 << bits, axis=1)[:h, :w]


def _signed(x: np.ndarray) -> np.ndarray:
    return np.where(x > 127, x - 256, x)


def _uncolour(px: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Green is taken out of red and blue, then red out of blue; ``by``: factors as r (red to blue), g (green to blue), b (green to red)."""
    out = px.copy()
    delta = lambda f, c: _signed(f) * _signed(c) >> 5
    out[..., 0] = (px[..., 0] + delta(by[..., 2], px[..., 1])) & 255
    out[..., 2] = (px[..., 2] + delta(by[..., 1], px[..., 1]) + delta(by[..., 0], out[..., 0])) & 255
    return out


def _stream(bits: Bits, w: int, h: int) -> np.ndarray:
    """(h, w, 4): transforms, then the image, then the transforms undone from the last on."""
    undo, seen, full = [], set(), w
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise ValueError("a transform twice")
        seen.add(kind)
        if kind < 2:
            b, wide = bits.read(3) + 2, w
            side = lambda n, b=b: (n + (1 << b) - 1) >> b
            blocks = _split(_pixels(bits, side(w), side(h), False))
            if kind == 0:
                undo.append(lambda px, k=blocks, b=b, v=wide: _unpredict(px, _spread(k[..., 1] & 15, b, v, h).clip(max=13)))
            else:
                undo.append(lambda px, k=blocks, b=b, v=wide: _uncolour(px, _spread(k, b, v, h)))
        elif kind == 2:
            undo.append(lambda px: (px + px[..., 1:2] * np.array([1, 0, 1, 0])) & 255)
        else:
            n = bits.read(8) + 1
            colours = np.cumsum(_split(_pixels(bits, n, 1, False))[0], axis=0) & 255
            table = np.zeros((256, 4), np.int64)
            table[:n] = colours
            b = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            each, wide = 8 >> b, w

            def unpack(px, b=b, each=each, wide=wide, table=table):
                x = np.arange(wide)
                at = px[:, x >> b, 1] >> (each * (x & ((1 << b) - 1))) & ((1 << each) - 1)
                return table[at]

            undo.append(unpack)
            w = (w + (1 << b) - 1) >> b
    px = _split(_pixels(bits, w, h, True))
    for f in reversed(undo):
        px = f(px)
    return px[:, :full].astype(np.uint8)


def decode(raw: bytes) -> np.ndarray:
    """A file to (h, w, 4)."""
    if raw[:4] != b"RIFF" or raw[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    at = 12
    while at + 8 <= len(raw):
        kind, n = struct.unpack_from("<4sI", raw, at)
        if kind in (b"VP8 ", b"ANMF"):
            raise ValueError("lossy WebP" if kind == b"VP8 " else "animated WebP")
        if kind == b"VP8L":
            body = raw[at + 8 : at + 8 + n]
            bits = Bits(body[1:])
            w, h, _, version = bits.read(14) + 1, bits.read(14) + 1, bits.read(1), bits.read(3)
            if body[:1] != b"\x2f" or version or len(body) < n:
                raise ValueError("not a lossless image of version 0, or cut off")
            return _stream(bits, w, h)
        at += 8 + n + (n & 1)
    raise ValueError("no image in the file")
