"""Palettes: presets, extraction, mapping, dithering.

Extraction is defined here after the published papers: Wu 1991 (greedy cuts of
the colour box with the largest variance, over a 32x32x32 histogram) and
Gervautz & Purgathofer 1988 (octree whose least used leaves are merged).  The
histogram is summed before the shuffle; what is left per image, at most 32768
rows, is cut in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rasterloom.functions import color
from rasterloom.operators.dither import dithered
from rasterloom.schema import by_groups

#: Colours of the presets (fixed values).
PRESETS = {
    "GameBoyDMG": ("0F380F", "306230", "8BAC0F", "9BBC0F"),
    "Pico8": ("000000", "1D2B53", "7E2553", "008751", "AB5236", "5F574F", "C2C3C7", "FFF1E8", "FF004D", "FFA300", "FFEC27", "00E436", "29ADFF", "83769C", "FF77A8", "FFCCAA"),
    "NES16": ("000000", "7C7C7C", "BCBCBC", "F8F8F8", "841000", "E40058", "F87858", "FCC04C", "007800", "00B800", "B8F818", "00B8B8", "0000FC", "6844FC", "D800CC", "F878F8"),
    "CGA4": ("000000", "55FFFF", "FF55FF", "FFFFFF"),
    "Sweetie16": ("1A1C2C", "5D275D", "B13E53", "EF7D57", "FFCD75", "A7F070", "38B764", "257179", "29366F", "3B5DC9", "41A6F6", "73EFF7", "F4F4F4", "94B0C2", "566C86", "333C57"),
}
PALETTE = "palette_id string, idx int, r int, g int, b int, a int"


def preset_colours(name: str) -> list[tuple[int, int, int]]:
    """Of a preset; none for any other name, which means: use an adaptive palette."""
    return [tuple(bytes.fromhex(c)) for c in PRESETS.get(name, ())]


def presets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, i, *c, 255) for n in PRESETS for i, c in enumerate(preset_colours(n))], PALETTE)


def named(rows: DataFrame, name: str, *keep: str) -> DataFrame:
    """(keep, palette_id, idx, r, g, b, a): the colours of the preset that each row names; none for names of no preset.

    The presets are of fixed size, so they are broadcast.
    """
    return rows.select(*keep, F.col(name).alias("palette_id")).join(F.broadcast(presets(rows.sparkSession)), "palette_id").select(*keep, "palette_id", "idx", *"rgba")


def nearest(palette: list[tuple[int, int, int]], r: Column, g: Column, b: Column) -> Column:
    """Index of the nearest colour of a palette of at most 256, in Lab; the first of equals."""
    own = color.oklab(r, g, b)
    entry = lambda i, c: F.struct(color.lab_distance_sq(own, F.struct(*[F.lit(float(v)).cast("float").alias(n) for v, n in zip(color.lab_of(c), "lab", strict=True)])).alias("d"), F.lit(i).alias("i"))
    return F.array_min(F.array(*[entry(i, c) for i, c in enumerate(palette)]))["i"]


def map_to_palette(px: DataFrame, palette: DataFrame, by: str | None = None) -> DataFrame:
    """Each pixel's colour to the nearest of the palette (idx, r, g, b); alpha, and transparent pixels, stay.

    Distances are taken once for each distinct colour, against the palette as an
    array (of 256 entries at most) that is broadcast, or joined by image if ``by``
    names the palette's image column.  An empty palette changes nothing.
    """
    p = palette.withColumn("lab", color.oklab(F.col("r"), F.col("g"), F.col("b"))).select(*([F.col(by).alias("image_id")] if by else []), F.struct("idx", "lab", "r", "g", "b").alias("p"))
    arr = F.sort_array(F.collect_list("p")).alias("__pal")
    keys = (["image_id"] if by else []) + ["r", "g", "b"]
    colours = px.where("a != 0").select(*keys).distinct().withColumn("__lab", color.oklab(F.col("r"), F.col("g"), F.col("b")))
    pal = p.groupBy("image_id").agg(arr) if by else p.agg(arr)
    d = colours.join(pal, "image_id") if by else colours.withColumn("__pal", pal.scalar())
    best = F.array_min(F.transform("__pal", lambda c: F.struct(color.lab_distance_sq(F.col("__lab"), c["lab"]).alias("d"), c["idx"].alias("i"), c["r"].alias("r"), c["g"].alias("g"), c["b"].alias("b"))))
    d = d.select(*keys, best.alias("__c"))
    joined = px.join(d, keys, "left")
    new = lambda c: F.when((F.col("a") != 0) & F.col("__c").isNotNull(), F.col("__c")[c]).otherwise(F.col(c)).cast("int").alias(c)
    return joined.select(*[new(c) if c in "rgb" else F.col(c) for c in px.columns])


def dither_to_palette(px: DataFrame, palette: list[tuple[int, int, int]]) -> DataFrame:
    """Floyd-Steinberg, see ``dither``."""
    return dithered(px, palette)


# ---- extraction ----------------------------------------------------------------


def _mean(box: np.ndarray) -> np.ndarray:
    return (box[:, :3] * box[:, 3:]).sum(axis=0) / box[:, 3].sum()


def _spread(box: np.ndarray) -> float:
    """The sum of squared deviations from the mean."""
    return float((((box[:, :3] - _mean(box)) ** 2).sum(axis=1) * box[:, 3]).sum()) if len(box) > 1 else 0.0


def wu(hist: np.ndarray, k: int) -> np.ndarray:
    """Rows (r, g, b, n) of distinct colours to at most ``k`` mean colours.

    The box with the largest sum of squared deviations is cut where that falls most.
    """
    boxes, spread = [hist], [_spread(hist)]
    while len(boxes) < k:
        i = int(np.argmax(spread))
        if spread[i] <= 0:
            break
        b, best = boxes[i], (-1.0, 0, 0)
        for axis in range(3):
            s = b[np.argsort(b[:, axis], kind="stable")]
            n, c = np.cumsum(s[:, 3]), np.cumsum(s[:, :3] * s[:, 3:], axis=0)
            gain = ((c**2).sum(axis=1) / n)[:-1] + (((c[-1] - c) ** 2).sum(axis=1)[:-1] / (n[-1] - n[:-1]))
            gain[s[1:, axis] == s[:-1, axis]] = -1.0
            j = int(np.argmax(gain)) if len(gain) else 0
            if len(gain) and gain[j] > best[0]:
                best = (float(gain[j]), axis, j)
        if best[0] < 0:
            break
        s = b[np.argsort(b[:, best[1]], kind="stable")]
        boxes[i : i + 1] = halves = [s[: best[2] + 1], s[best[2] + 1 :]]
        spread[i : i + 1] = map(_spread, halves)  # the other boxes keep theirs
    return np.array([np.rint(_mean(b)) for b in boxes], np.int64)


def octree(hist: np.ndarray, k: int) -> np.ndarray:
    """The same by merging the least used leaves of the deepest level, all children of a node at once."""
    path = np.zeros(len(hist), np.int64)
    rgb = hist[:, :3].astype(np.int64)
    for bit in range(7, -1, -1):
        path = path * 8 + ((rgb[:, 0] >> bit & 1) * 4 + (rgb[:, 1] >> bit & 1) * 2 + (rgb[:, 2] >> bit & 1))
    leaves = {(8, int(p)): (float(n), *(n * c)) for p, n, c in zip(path, hist[:, 3], hist[:, :3], strict=True)}
    while len(leaves) > k:
        deep = max(d for d, _ in leaves)
        groups: dict[int, list] = {}
        for d, p in leaves:
            if d == deep:
                groups.setdefault(p >> 3, []).append((d, p))
        for parent in sorted(groups, key=lambda q: (sum(leaves[x][0] for x in groups[q]), q)):
            if len(leaves) <= k:
                break
            total = np.sum([leaves.pop(x) for x in groups[parent]], axis=0)
            leaves[(deep - 1, parent)] = tuple(total)
    return np.array([np.rint(np.array(v[1:]) / v[0]) for _, v in sorted(leaves.items())], np.int64)


def extract(px: DataFrame, k: int, kind: str = "wu", by: str | None = "image_id") -> DataFrame:
    """(image_id, idx, r, g, b): up to ``k`` (2 to 256) colours of what isn't transparent, the lightest first.

    Of equally light ones that which appears first, row by row; a mean colour
    appears where the first pixel of its nearest bins does.  ``by`` None takes all images
    as one, and equally light ones by value.
    """
    k = min(256, max(2, k))
    if kind.lower() not in ("wu", "octree"):
        raise ValueError(kind)
    cut = octree if kind.lower() == "octree" else wu
    image = F.col(by) if by else F.lit(0)
    bins = [F.shiftright(c, 3) for c in "rgb"]
    # y, x as one number, so that the least is found without sorting
    place = F.shiftleft(F.col("y").cast("long"), 32) + F.col("x") if by else F.lit(0).cast("long")
    exact = px.where("a != 0").groupBy(image.cast("long").alias("image_id"), "r", "g", "b").agg(F.count("*").alias("n"), F.min(place).alias("at"))
    per_bin = exact.groupBy("image_id", *[b.alias(f"q{i}") for i, b in enumerate(bins)]).agg(F.sum("n").alias("n"), F.min("at").alias("at"), *[(F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(c) for c in "rgb"])
    few = exact.groupBy("image_id").agg(F.count("*").alias("kinds"))
    # images of few colours keep them as they are, without Python; others are cut over histogram bins
    kinds = exact.join(few, "image_id").where(F.col("kinds") <= k)
    light = sum(F.col(c) * round(w * 1000) for c, w in zip("rgb", color.LUMA, strict=True))
    order = Window.partitionBy("image_id").orderBy(light.desc(), "at", "r", "g", "b")  # k rows an image at most
    as_they_are = kinds.select("image_id", (F.row_number().over(order) - 1).alias("idx"), *"rgb")
    hist = per_bin.join(few, "image_id").where(F.col("kinds") > k).select("image_id", *"rgb", "n", "at")

    def palette_of(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        order = np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))
        rows, at = rows[order], at[order]
        c = np.unique(cut(rows, k), axis=0)
        first = np.full(len(c), np.iinfo(np.int64).max)
        near = np.concatenate([np.argmin(((part[:, None, :3] - c[None]) ** 2).sum(axis=2), axis=1) for part in np.array_split(rows, 1 + len(rows) * len(c) // (1 << 18))])
        np.minimum.at(first, near, at)
        return c[np.lexsort((first, -np.rint(c @ np.array(color.LUMA) * 1000)))]  # the weights are thousandths

    def run(t: pa.Table, cuts: np.ndarray) -> pa.Table:
        rows = np.stack([t.column(c).to_numpy().astype(float) for c in ("r", "g", "b", "n")], axis=1)
        at = t.column("at").to_numpy()
        each = [palette_of(rows[a:z], at[a:z]) for a, z in zip(cuts, cuts[1:], strict=False)]
        c, n = np.concatenate(each), [len(p) for p in each]
        return pa.table({"image_id": t.column("image_id").take(pa.array(np.repeat(cuts[:-1], n))), "idx": np.concatenate([np.arange(m, dtype=np.int32) for m in n]), **{c_: c[:, i].astype(np.int32) for i, c_ in enumerate("rgb")}})

    return as_they_are.unionByName(by_groups(hist, ["image_id"], run, "image_id long, idx int, r int, g int, b int"))


def union(*palettes: DataFrame) -> DataFrame:
    """The distinct colours of palettes."""
    out = palettes[0].select("r", "g", "b")
    for p in palettes[1:]:
        out = out.union(p.select("r", "g", "b"))
    return out.distinct()


def shared_palette(px: DataFrame, k: int, kind: str = "wu") -> DataFrame:
    """(idx, r, g, b): a palette of the images' palettes, each colour of which counts once."""
    each = union(extract(px, k, kind)).select(F.lit(0).cast("long").alias("image_id"), "r", "g", "b", F.lit(255).alias("a"))
    return extract(each, k, kind, by=None).drop("image_id")


def background_colour(palette: DataFrame, rgb: tuple[int, int, int]) -> DataFrame:
    """(image_id, idx, r, g, b): each palette's colour nearest to a background, in RGB; the first of equals."""
    d = color.rgb_distance_sq((F.col("r"), F.col("g"), F.col("b")), rgb)
    return palette.groupBy("image_id").agg(F.min_by(F.struct("idx", "r", "g", "b"), F.struct(d, "idx")).alias("c")).select("image_id", "c.*")


def reduce(px: DataFrame, k: int = 16, kind: str = "wu", dither: bool = False, preset: str | None = None) -> DataFrame:
    """Map to a preset, or to each image's own palette."""
    colours = preset_colours(preset) if preset else []
    if colours:
        if dither:
            return dither_to_palette(px, colours)
        return map_to_palette(px, px.sparkSession.createDataFrame([(i, *c) for i, c in enumerate(colours)], "idx int, r int, g int, b int"))
    own = extract(px, k, kind)
    if not dither:
        return map_to_palette(px, own, by="image_id")
    return dithered(px, own)


def ranked(palette: DataFrame) -> DataFrame:
    """Palette rows by falling luma, first appearance deciding."""
    order = Window.partitionBy("image_id").orderBy(F.desc(color.luma(F.col("r"), F.col("g"), F.col("b"))), "idx")
    return palette.withColumn("place", F.row_number().over(order) - 1)
