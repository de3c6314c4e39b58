"""Codecs bit by bit: PNG of every kind, WebP by a small writer of its own."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pytest

from rasterloom.sources import png, webp


def png_of(samples, depth, colour, interlace=0, *extra):
    """(h, w, channels) samples to a file, a filter of each kind in turn, pass by pass."""
    h, w, c = samples.shape
    body = b""
    for x0, y0, dx, dy in png.PASSES if interlace else ((0, 0, 1, 1),):
        part = samples[y0::dy, x0::dx]
        if not part.size:
            continue
        if depth == 16:
            rows = part.astype(">u2").reshape(len(part), -1).view(np.uint8)
        else:
            bits = (part.reshape(len(part), -1)[..., None] >> np.arange(depth - 1, -1, -1)) & 1
            rows = np.packbits(bits.reshape(len(part), -1).astype(np.uint8), axis=1)
        step, above = max(1, c * depth // 8), np.zeros(rows.shape[1], int)
        for y, line in enumerate(rows.astype(int)):
            left, corner = (np.concatenate([np.zeros(step, int), v[:-step] if step < len(v) else v[:0]])[: len(v)] for v in (line, above))
            p = left + above - corner
            d = np.stack([abs(p - left), abs(p - above), abs(p - corner)])
            kind = y % 5
            guess = {0: 0 * line, 1: left, 2: above, 3: (left + above) // 2, 4: np.choose(d.argmin(axis=0), [left, above, corner])}[kind]
            body += bytes([kind]) + ((line - guess) % 256).astype(np.uint8).tobytes()
            above = line
    head = png._chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, interlace))
    half = zlib.compress(body)
    return png.SIGNATURE + head + b"".join(extra) + png._chunk(b"IDAT", half[: len(half) // 2]) + png._chunk(b"tEXt", b"a\0b") + png._chunk(b"IDAT", half[len(half) // 2 :]) + png._chunk(b"IEND", b"")


KINDS = [(c, d) for c, ds in png.DEPTHS.items() for d in ds]


@pytest.mark.parametrize("interlace", [0, 1])
@pytest.mark.parametrize(("colour", "depth"), KINDS)
@pytest.mark.parametrize("size", [(1, 1), (3, 2), (11, 13), (5, 33)])
def test_png_of_every_depth_and_interlace(colour, depth, interlace, size):
    r = np.random.default_rng(colour * 100 + depth)
    s = r.integers(0, 1 << depth, (*size, png.CHANNELS[colour]))
    if size == (11, 13):
        s //= 2
        s[2:5, 3:7] = s[0, 0]
    to8 = lambda v: np.rint(v * 255 / ((1 << depth) - 1)).astype(int)  # noqa: E731  no sample lies halfway
    extra, full = [], np.full((*size, 1), 255)
    if colour == 3:
        pal = r.integers(0, 256, (1 << depth, 3)).astype(np.uint8)
        extra = [png._chunk(b"PLTE", pal.tobytes()), png._chunk(b"tRNS", bytes([0, 100]))]
        alpha = np.full(1 << depth, 255)
        alpha[:2] = 0, 100
        want = np.concatenate([pal[s[..., 0]], alpha[s]], axis=2)
    elif colour in (0, 2):
        key = s[0, 0]
        extra = [png._chunk(b"tRNS", struct.pack(f">{len(key)}H", *key))]
        full = np.where((s == key).all(axis=2, keepdims=True), 0, 255)
        want = np.concatenate([np.broadcast_to(to8(s), (*size, 3)), full], axis=2)
    else:
        want = np.concatenate([np.broadcast_to(to8(s[..., :-1]), (*size, 3)), to8(s[..., -1:])], axis=2)
    assert (png.decode(png_of(s, depth, colour, interlace, *extra)) == want).all()


def test_png_faults():
    good = png.encode(np.zeros((4, 4, 4), np.uint8))
    for bad in (good[:40], good[:-20], good.replace(b"IDAT", b"IDAX"), good[:16] + b"\0" * 8 + good[24:], b"", png_of(np.zeros((2, 2, 1), int) + 3, 2, 3, 0, png._chunk(b"PLTE", b"abc"))):
        with pytest.raises((ValueError, zlib.error, struct.error)):
            png.decode(bad)


class Out:
    def __init__(self):
        self.value, self.n = 0, 0

    def put(self, v, n):
        self.value |= int(v) << self.n
        self.n += n

    def done(self):
        return self.value.to_bytes((self.n + 7) // 8 + 8, "little")


def lengths_of(counts):
    """Complete code lengths for the used symbols: the commonest short, the others even."""
    used = sorted((s for s, n in enumerate(counts) if n), key=lambda s: -counts[s])
    out = [0] * len(counts)
    if len(used) == 1:
        out[used[0]] = 1
        return out
    first, rest = (used[:1], used[1:]) if len(used) > 2 else ([], used)
    deep = (len(rest) - 1).bit_length()
    short = (1 << deep) - len(rest)  # so many are one bit shorter
    for s in first:
        out[s] = 1
    for i, s in enumerate(rest):
        out[s] = deep + len(first) - (1 if i < short else 0)
    return out


def codes_of(lengths):
    code, before, out = 0, 0, {}
    used = sorted((n, s) for s, n in enumerate(lengths) if n)
    for n, s in used:
        code <<= n - before
        out[s] = (int(f"{code:0{n}b}"[::-1], 2), n) if len(used) > 1 else (0, 0)
        code, before = code + 1, n
    return out


def put_code(o, counts):
    used = [s for s, n in enumerate(counts) if n]
    if len(used) <= 2 and all(s < 256 for s in used):  # the simple form
        used = used or [0]
        o.put(1, 1), o.put(len(used) - 1, 1)
        o.put(used[0] > 1, 1), o.put(used[0], 8 if used[0] > 1 else 1)
        if len(used) > 1:
            o.put(used[1], 8)
        return codes_of([1 if s in used else 0 for s in range(len(counts))])
    lengths = lengths_of(counts)
    packed, k = [], 0  # repeats by 16, 17 and 18
    while k < len(lengths):
        n = next((j for j in range(k, len(lengths)) if lengths[j] != lengths[k]), len(lengths)) - k
        if lengths[k] == 0 and n >= 11:
            n = min(n, 138)
            packed.append((18, n - 11, 7))
        elif lengths[k] == 0 and n >= 3:
            packed.append((17, n - 3, 3))
        elif k and lengths[k] and lengths[k] == lengths[k - 1] and n >= 3:
            n = min(n, 6)
            packed.append((16, n - 3, 2))
        else:
            n = 1
            packed.append((lengths[k], 0, 0))
        k += n
    inner = lengths_of([sum(p[0] == s for p in packed) for s in range(19)])
    assert max(inner) < 8
    o.put(0, 1), o.put(15, 4)
    for s in webp.LENGTH_ORDER:
        o.put(inner[s], 3)
    o.put(0, 1)
    own = codes_of(inner)
    for s, v, n in packed:
        o.put(*own[s]), o.put(v, n)
    return codes_of(lengths)


def prefix(v):
    """(prefix, extra value, extra bits) of a length or distance."""
    v -= 1
    if v < 4:
        return v, 0, 0
    n = v.bit_length() - 1
    return 2 * n + (v >> (n - 1) & 1), v & ((1 << (n - 1)) - 1), n - 1


def put_image(o, argb, main=False, cache=0, copies=True, groups=None):
    """(h, w) numbers; ``groups``: (bits, number of each block)."""
    h, w = argb.shape
    flat, at, ops, held = argb.ravel().tolist(), 0, [], [None] * (1 << cache)
    slot = lambda v: (v * 0x1E35A7BD & 0xFFFFFFFF) >> (32 - cache)
    seen = {}
    while at < len(flat):
        n, d = 0, 0
        for back in [w, 1, w + 1, w - 1, *seen.get(flat[at], [])[-3:]] if copies else []:
            back = back if back <= w + 1 or back in (1,) else back
            if 0 < back <= at:
                m = 0
                while at + m < len(flat) and flat[at + m] == flat[at + m - back] and m < 4096:
                    m += 1
                if m > n:
                    n, d = m, back
        if n >= 3:
            ops.append((at, "copy", n, d))
            took = n
        elif cache and held[slot(flat[at])] == flat[at]:
            ops.append((at, "cache", slot(flat[at]), 0))
            took = 1
        else:
            ops.append((at, "pixel", flat[at], 0))
            took = 1
        for v in flat[at : at + took]:
            if cache:
                held[slot(v)] = v
        at += took
    o.put(cache > 0, 1)
    if cache:
        o.put(cache, 4)
    group_of = lambda at: 0
    count = 1
    if main:
        o.put(groups is not None, 1)
        if groups is not None:
            bits, number = groups
            o.put(bits - 2, 3)
            put_image(o, number << 8)
            count = int(number.max()) + 1
            group_of = lambda at: int(number[at // w >> bits, at % w >> bits])
    sizes = (280 + ((1 << cache) if cache else 0), 256, 256, 256, 40)
    counts = [[[0] * n for n in sizes] for _ in range(count)]
    distance = lambda d: next((k + 1 for k, (x, y) in enumerate(webp.NEAR) if max(1, x + y * w) == d), d + 120)
    for at, kind, v, d in ops:
        c = counts[group_of(at)]
        if kind == "pixel":
            for k, sh in enumerate((8, 16, 0, 24)):
                c[k][v >> sh & 255] += 1
        elif kind == "copy":
            c[0][256 + prefix(v)[0]] += 1
            c[4][prefix(distance(d))[0]] += 1
        else:
            c[0][280 + v] += 1
    codes = [[put_code(o, k) for k in c] for c in counts]
    for at, kind, v, d in ops:
        c = codes[group_of(at)]
        if kind == "pixel":
            for k, sh in enumerate((8, 16, 0, 24)):
                o.put(*c[k][v >> sh & 255])
        elif kind == "copy":
            for k, x in ((0, prefix(v)), (4, prefix(distance(d)))):
                o.put(*c[k][x[0] + (256 if k == 0 else 0)]), o.put(x[1], x[2])
        else:
            o.put(*c[0][280 + v])


def joined(px):
    p = px.astype(np.int64)
    return p[..., 3] << 24 | p[..., 0] << 16 | p[..., 1] << 8 | p[..., 2]


def forward_predict(px, modes, bits):
    """Residuals by plain loops."""
    h, w = px.shape[:2]
    out, p = np.zeros_like(px), px.astype(int)
    for y in range(h):
        for x in range(w):
            mode = int(modes[y >> bits, x >> bits])
            if not y:
                mode = 1 if x else 0
            elif not x:
                mode = 2
            left, top = p[y, x - 1] if x else p[y, x], p[y - 1, x] if y else p[y, x]
            corner = p[y - 1, x - 1] if x and y else top
            right = (p[y - 1, x + 1] if x + 1 < w else p[y, 0]) if y else top
            avg = lambda a, b: (a + b) // 2
            if mode == 11:
                near_left = abs(top - corner).sum()
                guess = left if near_left < abs(left - corner).sum() else top
            elif mode == 13:
                m = avg(left, top)
                guess = np.clip(m + ((m - corner) / 2).astype(int), 0, 255)
            else:
                guess = {0: np.array([0, 0, 0, 255]), 1: left, 2: top, 3: right, 4: corner, 5: avg(avg(left, right), top), 6: avg(left, corner), 7: avg(left, top), 8: avg(corner, top), 9: avg(top, right), 10: avg(avg(left, corner), avg(top, right)), 12: np.clip(left + top - corner, 0, 255)}[mode]
            out[y, x] = (p[y, x] - guess) % 256
    return out


def webp_of(px, transforms=(), cache=0, copies=True, groups=None, seed=0):
    r = np.random.default_rng(seed)
    h, w = px.shape[:2]
    o = Out()
    o.put(w - 1, 14), o.put(h - 1, 14), o.put(1, 1), o.put(0, 3)
    px = px.astype(np.int64)
    for kind, b in transforms:
        o.put(1, 1), o.put(kind, 2)
        side = lambda n, b=b: (n + (1 << b) - 1) >> b
        if kind == 0:
            modes = r.integers(0, 14, (side(h), side(w)))
            o.put(b - 2, 3), put_image(o, modes << 8)
            px = forward_predict(px, modes, b)
        elif kind == 1:
            f = r.integers(0, 256, (side(h), side(w), 3))
            o.put(b - 2, 3), put_image(o, f[..., 0] << 16 | f[..., 1] << 8 | f[..., 2])
            each = f[np.arange(h)[:, None] >> b, np.arange(w)[None] >> b]
            s = lambda v: np.where(v > 127, v - 256, v)
            out = px.copy()
            out[..., 2] = (px[..., 2] - (s(each[..., 1]) * s(px[..., 1]) >> 5) - (s(each[..., 0]) * s(px[..., 0]) >> 5)) & 255
            out[..., 0] = (px[..., 0] - (s(each[..., 2]) * s(px[..., 1]) >> 5)) & 255
            px = out
        elif kind == 2:
            px = (px - px[..., 1:2] * np.array([1, 0, 1, 0])) & 255
        else:
            colours, index = np.unique(px.reshape(-1, 4), axis=0, return_inverse=True)
            index = index.reshape(h, w)
            o.put(len(colours) - 1, 8)
            put_image(o, joined((colours - np.concatenate([np.zeros((1, 4), int), colours[:-1]])) & 255)[None])
            bits = 3 if len(colours) <= 2 else 2 if len(colours) <= 4 else 1 if len(colours) <= 16 else 0
            wide = (px.shape[1] + (1 << bits) - 1) >> bits
            pad = np.zeros((h, wide << bits), int)
            pad[:, : px.shape[1]] = index
            green = (pad.reshape(h, wide, -1) << (np.arange(1 << bits) * (8 >> bits))).sum(axis=2)
            px = np.stack([0 * green, green, 0 * green, 0 * green + 255], axis=2)
            w = wide
    o.put(0, 1)
    put_image(o, joined(px), True, cache, copies, groups)
    body = b"\x2f" + o.done()
    body += b"\0" * (len(body) & 1)
    return b"RIFF" + struct.pack("<I", len(body) + 12) + b"WEBPVP8L" + struct.pack("<I", len(body)) + body


def picture(h, w, seed, colours=0):
    r = np.random.default_rng(seed)
    if colours:
        pal = r.integers(0, 256, (colours, 4))
        return pal[r.integers(0, colours, (h, w))].astype(np.uint8)
    g = (np.add.outer(np.arange(h) * 3, np.arange(w) * 5)[..., None] + np.array([0, 40, 90, 200]) + r.integers(0, 6, (h, w, 4))) % 256
    g[h // 3 : h // 2] = g[:1]  # rows to copy
    return g.astype(np.uint8)


PLANS = [(), ((2, 0),), ((0, 2),), ((0, 3), (1, 2), (2, 0)), ((1, 3), (0, 2)), ((2, 0), (0, 4), (1, 4))]


@pytest.mark.parametrize("size", [(1, 1), (1, 9), (9, 1), (17, 23), (40, 31)])
@pytest.mark.parametrize("plan", PLANS)
@pytest.mark.parametrize("cache", [0, 1, 6])
def test_webp_transforms_copies_and_cache(size, plan, cache):
    px = picture(*size, seed=7)
    assert (webp.decode(webp_of(px, plan, cache)) == px).all()
    assert (webp.decode(webp_of(px, plan, cache, copies=False)) == px).all()


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 5, 16, 17, 200])
def test_webp_palettes(colours):
    px = picture(13, 19, colours, colours)
    for plan in (((3, 0),), ((3, 0), (0, 2))):
        assert (webp.decode(webp_of(px, plan, 3)) == px).all()


def test_webp_groups_of_codes():
    px = picture(33, 37, 3)
    number = np.random.default_rng(2).integers(0, 4, ((33 + 7) // 8, (37 + 7) // 8))
    number[0, 0] = 3
    assert (webp.decode(webp_of(px, ((2, 0),), 4, groups=(3, number))) == px).all()


def test_webp_in_an_extended_file_and_faults():
    px = picture(5, 6, 1)
    raw = webp_of(px)
    extended = raw[:12] + b"VP8X" + struct.pack("<I", 10) + bytes(10) + raw[12:]
    assert (webp.decode(extended) == px).all()
    for bad in (b"", raw[:30], b"RIFF\0\0\0\0WEBPVP8 \0\0\0\0", raw[:12], raw.replace(b"\x2f", b"\x2e", 1)):
        with pytest.raises(ValueError):
            webp.decode(bad)


def test_unfiltering_a_large_image_takes_no_loop_over_bytes():
    import time

    g = np.random.default_rng(0).integers(0, 256, (600, 600, 4))
    raw = png_of(g, 8, 6)
    began = time.perf_counter()
    assert (png.decode(raw) == g).all()
    assert time.perf_counter() - began < 2
