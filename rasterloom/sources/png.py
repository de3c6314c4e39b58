"""A PNG codec on zlib and numpy: files of every depth, colour type and interlace are read, 8-bit ones written.

Samples of 16 bits become the nearest of 8 bits, samples under 8 bits are spread
over 0..255; a transparent colour is compared before that.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def _file(w: int, h: int, colour: int, rows: np.ndarray, *extra: bytes) -> bytes:
    raw = np.concatenate([np.zeros((h, 1), np.uint8), rows.reshape(h, -1).astype(np.uint8)], axis=1).tobytes()
    head = _chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0))
    return SIGNATURE + head + b"".join(extra) + _chunk(b"IDAT", zlib.compress(raw, 6)) + _chunk(b"IEND", b"")


def encode(grid: np.ndarray) -> bytes:
    """(h, w, 4) to an RGBA file."""
    h, w = grid.shape[:2]
    return _file(w, h, 6, grid)


def encode_indexed(grid: np.ndarray, palette: list[tuple[int, int, int, int]]) -> bytes:
    """To a palette file; every pixel takes the entry that is nearest over r, g, b, a, the first of equals."""
    if not 1 <= len(palette) <= 256:
        raise ValueError("a palette has 1 to 256 colours")
    h, w = grid.shape[:2]
    pal = np.array(palette, np.int64)
    kinds, back = np.unique(grid.reshape(-1, 4), axis=0, return_inverse=True)
    index = ((kinds[:, None, :].astype(np.int64) - pal[None]) ** 2).sum(axis=2).argmin(axis=1)
    return _file(w, h, 3, index[back.ravel()].reshape(h, w), _chunk(b"PLTE", pal[:, :3].astype(np.uint8).tobytes()), _chunk(b"tRNS", pal[:, 3].astype(np.uint8).tobytes()))


#: Adam7: first column and row, step of columns and rows.
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))
DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}


def _unfilter(raw: np.ndarray, step: int) -> np.ndarray:
    """Rows with a filter byte each, undone.

    A byte needs those left, above and left above, so all rows advance together along
    diagonals; rows that only need one of these are undone at once.
    """
    kinds, body = raw[:, 0], raw[:, 1:]
    if (kinds > 4).any():
        raise ValueError(f"row filter {kinds.max()}")
    if (kinds == 0).all():
        return body
    h, n = body.shape
    w = n // step
    if (kinds <= 1).all():
        left = body.reshape(h, w, step).astype(np.int64).cumsum(axis=1).reshape(h, n).astype(np.uint8)
        return np.where(kinds[:, None] == 1, left, body)
    out = np.zeros((h + 1, w + 1, step), np.int32)  # a border of zeros above and on the left
    body = body.reshape(h, w, step).astype(np.int32)
    for t in range(w + h - 1):
        y = np.arange(max(0, t - w + 1), min(h - 1, t) + 1)
        x = t - y
        left, up, corner = out[y + 1, x], out[y, x + 1], out[y, x]
        toward = left + up - corner
        a, b, c = abs(toward - left), abs(toward - up), abs(toward - corner)
        nearest = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
        guess = np.choose(kinds[y][:, None], [np.zeros_like(left), left, up, (left + up) >> 1, nearest])
        out[y + 1, x + 1] = (body[y, x] + guess) & 255
    return out[1:, 1:].reshape(h, n).astype(np.uint8)


def _samples(data: bytes, at: int, w: int, h: int, depth: int, channels: int) -> tuple[np.ndarray, int]:
    """(h, w, channels) of one pass from ``at`` on, and where it ends."""
    line = (w * channels * depth + 7) // 8
    if len(data) - at < h * (line + 1):
        raise ValueError("image data ends early")
    raw = np.frombuffer(data, np.uint8, h * (line + 1), at).reshape(h, line + 1)
    rows = _unfilter(raw, max(1, channels * depth // 8))
    if depth == 16:
        rows = rows.reshape(h, -1, 2).astype(np.int64)
        rows = rows[..., 0] << 8 | rows[..., 1]
    elif depth < 8:
        bits = np.unpackbits(rows, axis=1).reshape(h, -1, depth).astype(np.int64)
        rows = (bits << np.arange(depth - 1, -1, -1)).sum(axis=2)
    return rows[:, : w * channels].reshape(h, w, channels).astype(np.int64), at + h * (line + 1)


def _chunks(raw: bytes):
    at = 8
    while at + 12 <= len(raw):
        n, kind = struct.unpack_from(">I4s", raw, at)
        body = raw[at + 8 : at + 8 + n]
        if len(body) < n or len(raw) < at + 12 + n:
            raise ValueError("file ends early")
        if struct.unpack_from(">I", raw, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError(f"checksum of {kind!r}")
        yield kind, body
        if kind == b"IEND":
            return
        at += 12 + n


def decode(raw: bytes) -> np.ndarray:
    """A file to (h, w, 4)."""
    if raw[:8] != SIGNATURE:
        raise ValueError("not a PNG file")
    data, pal, alpha, head = [], None, b"", None
    for kind, body in _chunks(raw):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            pal = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            alpha = body
        elif kind == b"IDAT":
            data.append(body)
    if head is None:
        raise ValueError("no header")
    w, h, depth, colour, _, _, interlace = head
    if not w or not h or depth not in DEPTHS.get(colour, ()) or interlace > 1:
        raise ValueError(f"{w}x{h}, depth {depth}, colour type {colour}, interlace {interlace}")
    channels, flat, at = CHANNELS[colour], zlib.decompress(b"".join(data)), 0
    got = np.zeros((h, w, channels), np.int64)
    for x0, y0, dx, dy in PASSES if interlace else ((0, 0, 1, 1),):
        pw, ph = -(-(w - x0) // dx), -(-(h - y0) // dy)
        if pw > 0 and ph > 0:
            got[y0::dy, x0::dx], at = _samples(flat, at, pw, ph, depth, channels)
    opaque = np.full((h, w, 1), 255, np.int64)
    if colour == 3:
        if pal is None or got.max() >= len(pal):
            raise ValueError("an index beyond the palette")
        a = np.full(len(pal), 255, np.uint8)
        a[: len(alpha)] = np.frombuffer(alpha, np.uint8)[: len(pal)]
        return np.concatenate([pal, a[:, None]], axis=1)[got[..., 0]]
    if colour in (0, 2) and len(alpha) == 2 * channels:
        key = np.array(struct.unpack(f">{channels}H", alpha)) & ((1 << depth) - 1)
        opaque = np.where((got == key).all(axis=2, keepdims=True), 0, 255)
    most = (1 << depth) - 1
    got = (got * 255 + most // 2) // most
    shown = np.repeat(got[..., :1], 3, axis=2) if colour in (0, 4) else got[..., :3]
    return np.concatenate([shown, got[..., -1:] if colour in (4, 6) else opaque], axis=2).astype(np.uint8)
