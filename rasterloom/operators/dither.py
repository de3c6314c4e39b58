"""Error diffusion (Floyd-Steinberg) in FLOAT Lab.

A pixel waits for its left neighbour and three above, so all pixels with the same
x + 2y are free at once: they are taken in one numpy step, over all images that a
task holds at the time.  Images needn't fit in memory: pixels reach a task sorted
by row, are taken in bands of whole rows, and a band hands on the errors of its
last row.  The sums are those of the plain loop in raster order, bit for bit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.functions import color
from rasterloom.schema import PX, PX_COLS

#: Pixels of a band, at least one row; distances held at once.
BAND = 1 << 18
CELLS = 1 << 20
#: Sixteenths of the error that come from above left, above, above right and left (fixed values).
ABOVE_LEFT, ABOVE, ABOVE_RIGHT, LEFT = (np.float32(n / 16) for n in (1, 5, 3, 7))


class Band:
    """Rows of one image: places, colours, and the errors of the row above them."""

    def __init__(self, x: np.ndarray, y: np.ndarray, palette: np.ndarray, above: np.ndarray | None):
        self.top, self.height, self.width = int(y[0]), int(y[-1]) - int(y[0]) + 1, int(x.max()) + 1
        self.x, self.y, self.palette = x, y - self.top, palette
        self.above = np.zeros((0, 3), np.float32) if above is None else above[: self.width]
        self.stride = self.width + 1  # a column of zeros: what lies beside the image

    @property
    def cells(self) -> int:
        return (self.height + 1) * self.stride + 1

    def places(self, base: int) -> np.ndarray:
        return base + 1 + (self.y + 1) * self.stride + self.x


def diffuse(bands: list[Band], rgba: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bands' pixels (in order, r g b a) in their palettes' colours, and the errors of the last band's last row."""
    bases = np.concatenate([[0], np.cumsum([b.cells for b in bands])])
    place = np.concatenate([b.places(int(o)) for b, o in zip(bands, bases[:-1], strict=True)])
    error = np.zeros((int(bases[-1]), 3), np.float32)
    for b, o in zip(bands, bases[:-1], strict=True):
        error[o + 1 : o + 1 + len(b.above)] = b.above
    sizes = [len(b.x) for b in bands]
    wave = np.concatenate([b.x + 2 * b.y for b in bands])
    stride = np.repeat([b.stride for b in bands], sizes)
    image = np.repeat(np.arange(len(bands)), sizes)

    shared = all(b.palette is bands[0].palette for b in bands)
    pals = [bands[0].palette] if shared else [b.palette for b in bands]
    k = max(len(p) for p in pals)
    lab = np.full((len(pals), k, 3), np.inf, np.float32)
    rgb = np.zeros((len(pals), k, 3), np.int32)
    for i, p in enumerate(pals):
        rgb[i, : len(p)], lab[i, : len(p)] = p, color.labs_of(p)

    out = np.zeros_like(rgba)
    opaque = np.flatnonzero(rgba[:, 3])
    order = opaque[np.argsort(wave[opaque], kind="stable")]
    code = rgba[order, 0].astype(np.int64) << 16 | rgba[order, 1].astype(np.int64) << 8 | rgba[order, 2]
    kinds, back = np.unique(code, return_inverse=True)
    own = color.labs_of(np.stack([kinds >> 16, kinds >> 8 & 255, kinds & 255], axis=1))[back]
    at, step = place[order], stride[order]
    which = np.zeros(len(order), np.int64) if shared else image[order]
    chosen = np.zeros(len(order), np.int64)
    ends = np.append(np.flatnonzero(np.diff(wave[order])) + 1, len(order)) if len(order) else []
    lo = 0
    for hi in ends:
        for a in range(lo, hi, max(1, CELLS // k)):
            s = slice(a, min(hi, a + max(1, CELLS // k)))
            p, up = at[s], at[s] - step[s]
            v = own[s] + error[up - 1] * ABOVE_LEFT + error[up] * ABOVE + error[up + 1] * ABOVE_RIGHT + error[p - 1] * LEFT
            near = lab[0] if shared else lab[which[s]]
            d = [near[..., c] - v[:, None, c] for c in range(3)]
            j = np.argmin(d[0] * d[0] + d[1] * d[1] + d[2] * d[2], axis=1)
            error[p] = v - lab[which[s], j]
            chosen[s] = j
        lo = hi
    out[order, :3], out[order, 3] = rgb[which, chosen], rgba[order, 3]
    last, base = bands[-1], int(bases[-2])
    tail = base + 1 + last.height * last.stride
    return out, error[tail : tail + last.width]


def _columns(t: pa.Table) -> tuple[np.ndarray, ...]:
    ids = t.column("image_id")
    return (pc.fill_null(ids, 0).to_numpy(), pc.is_null(ids).to_numpy(), *(t.column(c).to_numpy() for c in ("x", "y")))


def _stream(batches: Iterator[pa.RecordBatch], common: np.ndarray | None, band: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows in, sorted rows out.  Rows above the image (y = -1) are its palette, by x."""
    held: list[pa.Table] = []
    image, palette, row, above = None, common, None, None

    def take(t: pa.Table) -> pa.Table:
        nonlocal image, palette, row, above
        ids, null, x, y = _columns(t)
        x, y = x.astype(np.int64), y.astype(np.int64)
        rgba = np.stack([t.column(c).to_numpy() for c in "rgba"], axis=1).astype(np.int32)
        cuts = np.flatnonzero((np.diff(ids) != 0) | (np.diff(null.astype(np.int8)) != 0)) + 1
        bands, spans, keep = [], [], np.ones(len(x), bool)
        for lo, hi in zip([0, *cuts], [*cuts, len(x)], strict=True):
            name = (bool(null[lo]), int(ids[lo]))
            if name != image:
                image, palette, row, above = name, common, None, None
            first = lo + int(np.searchsorted(y[lo:hi], 0))
            if first > lo:
                keep[lo:first], palette = False, rgba[lo:first, :3]
            if first < hi and palette is not None:
                # a missing row above passes nothing on
                bands.append(Band(x[first:hi], y[first:hi], palette, above if row == int(y[first]) - 1 else None))
                spans.append((first, hi))
                row, above = int(y[hi - 1]), None
        if bands:
            inside = np.concatenate([np.arange(lo, hi) for lo, hi in spans])
            rgba[inside], rest = diffuse(bands, rgba[inside])
            if spans[-1][1] == len(x):
                above = rest
        done = pa.table({**{c: t.column(c) for c in ("image_id", "x", "y")}, **{c: rgba[:, i] for i, c in enumerate("rgba")}})
        return done.filter(pa.array(keep))

    for b in batches:
        if not b.num_rows:
            continue
        held.append(pa.Table.from_batches([b]))
        if sum(t.num_rows for t in held) < band:
            continue
        t = pa.concat_tables(held)
        ids, null, _, y = _columns(t)
        # the last row, or the last palette, may go on in the next batch
        ends = np.flatnonzero((np.diff(ids) != 0) | (np.diff(null.astype(np.int8)) != 0) | (np.diff(y) != 0)) + 1
        cut = int(ends[-1]) if len(ends) else 0
        held = [t.slice(cut)]
        if cut:
            yield from take(t.slice(0, cut)).to_batches(max_chunksize=1 << 16)
    if held:
        yield from take(pa.concat_tables(held)).to_batches(max_chunksize=1 << 16)


def dithered(px: DataFrame, palette: list[tuple[int, int, int]] | DataFrame, band: int = BAND) -> DataFrame:
    """Pixels in a palette's colours; transparent ones become (0, 0, 0, 0), and errors into them are lost.

    ``palette`` is a list of colours, or a DataFrame (image_id, idx, r, g, b) of
    a palette an image; an image without one, or an empty list, stays as it is.
    The nearest colour is the first of equals.  Nulls among x, y and the
    channels aren't pixels and fail; a null image_id is an image.
    """
    d = px.select(*PX_COLS)
    if isinstance(palette, DataFrame):
        common = None
        d = d.unionByName(palette.select("image_id", F.col("idx").cast("int").alias("x"), F.lit(-1).alias("y"), "r", "g", "b", F.lit(255).alias("a")))
    elif palette:
        common = np.array(palette, np.int32)
    else:
        return px
    return d.repartition("image_id").sortWithinPartitions("image_id", "y", "x").mapInArrow(lambda batches: _stream(batches, common, band), PX)
