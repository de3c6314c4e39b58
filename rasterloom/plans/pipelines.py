"""Stages chained into whole jobs.  Stages that are off leave no trace in the plan."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.functions.color import normalise_hex, parse_hex
from rasterloom.operators import aggregate, components, palette, pointwise, stencil
from rasterloom.schema import cleared, recolour

RGB = tuple[int, int, int]
GREEN, BLACK = (0, 255, 0), (0, 0, 0, 255)


@dataclass(frozen=True)
class Options:
    """Of the pixel art pipeline (fixed defaults)."""

    background_isolation: bool = True
    background_snap: bool = False
    background: RGB | None = None
    tolerance: float = 0
    quantize: bool = True
    max_colours: int = 16
    quantizer: str = "Wu"
    majority: bool = False
    majority_least: int = 2
    island_area: int | None = None
    outline: bool = False
    outline_colour: tuple[int, int, int, int] | None = None
    alpha: int | None = None
    #: Side of the tiles of large images; by default as many pixels as are counted need.
    tile: int | str | None = components.COUNTED


#: Bundles of options (fixed values).
PRESETS = {
    "Default": Options(background_isolation=False, quantize=False, island_area=2, alpha=128),
    "Safe": Options(tolerance=6, quantize=False, majority=True, island_area=2, alpha=112),
    "Aggressive": Options(background_snap=True, tolerance=18, quantize=False, majority=True, island_area=3, alpha=144),
}


def edge_threshold(tolerance: float) -> float:
    return 48 if tolerance <= 0 else min(255.0, max(8.0, tolerance * 6))


def number(v: float) -> str:
    """At most two decimals, none if they are zero."""
    return f"{v:.2f}".rstrip("0").rstrip(".")


@dataclass
class Run:
    """Pixels after a pipeline, and its steps: texts, or columns over per-image counts."""

    px: DataFrame
    before: DataFrame
    counts: DataFrame | None = None
    steps: tuple[Column | str, ...] = ()
    palette: DataFrame | None = None

    def report(self) -> DataFrame:
        """(image_id, unique_before, unique_after, steps array<string>)."""
        out = aggregate.unique_colours(self.before).select("image_id", F.col("n").cast("int").alias("unique_before"))
        out = out.join(aggregate.unique_colours(self.px).select("image_id", F.col("n").cast("int").alias("unique_after")), "image_id", "left")
        if self.counts is not None:
            out = out.join(self.counts, "image_id", "left")
        if self.palette is not None:
            out = out.join(self.palette.groupBy("image_id").agg(F.count("*").alias("colours")), "image_id", "left")
        steps = F.array(*[s if isinstance(s, Column) else F.lit(s) for s in self.steps]) if self.steps else F.array().cast("array<string>")
        return out.select("image_id", "unique_before", "unique_after", F.filter(steps, lambda s: s.isNotNull()).alias("steps"))


def removed_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """(image_id, removed): pixels that were there and are transparent now, from two sums."""
    seen = lambda d, n: d.groupBy("image_id").agg(F.count_if(F.col("a") != 0).alias(n))
    return seen(before, "x").join(seen(after, "y"), "image_id").select("image_id", (F.col("x") - F.col("y")).alias("removed"))


def run(px: DataFrame, o: Options | None = None) -> Run:
    """Background, palette, majority, islands, outline, alpha, in this order."""
    o = o or Options()
    key, tol = o.background or GREEN, max(0.0, o.tolerance)
    out = Run(px, px)
    steps: list[Column | str] = []
    labels = (o.background_isolation and not o.background_snap) or (o.island_area or 0) > 0
    tile = components.chosen(px, o.tile) if labels else None if o.tile == components.COUNTED else o.tile  # sizes stay, so counted once
    whole = tile is None
    if o.background_isolation:
        if o.background_snap:
            out.px = pointwise.snap_background(out.px, key, tol)
            steps.append(f"background snap (tol {number(tol)})")
        else:
            out.px = components.isolate_background(out.px, key, tol, edge_threshold(tol), tile=tile)
            out.counts = removed_counts(px, out.px)
            steps.append(F.concat(F.lit(f"background isolation (tol {number(tol)}, removed "), F.col("removed").cast("string"), F.lit(")")))
    if o.quantize:
        out.palette = palette.extract(out.px, o.max_colours, o.quantizer)
        out.px = palette.map_to_palette(out.px, out.palette, by="image_id")
        steps.append(F.when(F.col("colours") > 0, F.concat(F.lit(f"quantize {o.quantizer} ("), F.col("colours").cast("string"), F.lit(")"))))
    if o.majority:
        out.px = stencil.majority_denoise(out.px, max(1, o.majority_least), together=whole)
        steps.append("majority denoise")
    if o.island_area is not None and o.island_area > 0:
        out.px = components.denoise_islands(out.px, 1, o.island_area, tile=tile)
        steps.append(f"island denoise (min {o.island_area})")
    if o.outline:
        out.px = stencil.outline(out.px, o.outline_colour or BLACK, together=whole)
        steps.append("outline 1px")
    if o.alpha is not None:
        out.px = pointwise.alpha_threshold(out.px, o.alpha)
        steps.append(f"alpha {o.alpha}")
    out.steps = tuple(steps)
    return out


def summary(report: DataFrame) -> DataFrame:
    return report.select("image_id", F.array_join("steps", " -> ").alias("summary"))


@dataclass(frozen=True)
class Cleanup:
    """Of the cleanup wizard (fixed defaults)."""

    remove_background: bool = True
    key: RGB = GREEN
    tolerance: float = 40
    defringe: bool = True
    opaque: int = 250
    binarize: bool = True
    alpha: int = 128
    spikes: bool = True
    islands: bool = True
    island_size: int = 4
    reduce_palette: bool = False
    colours: int = 16
    dither: bool = False
    tile: int | str | None = components.COUNTED


def clean(px: DataFrame, o: Cleanup | None = None) -> Run:
    """Background, fringe, alpha, median, islands, palette; each relies on those before it."""
    o = o or Cleanup()
    out = Run(px, px)
    steps: list[Column | str] = []
    tile = components.chosen(px, o.tile)
    whole = tile is None
    if o.remove_background:
        out.px = components.isolate_background(out.px, o.key, o.tolerance, edge_threshold(o.tolerance), tile=tile)
        out.counts = removed_counts(px, out.px)
        steps.append(F.concat(F.lit(f"sfondo (tol {number(o.tolerance)}, rimossi "), F.col("removed").cast("string"), F.lit(")")))
    if o.defringe:
        out.px = stencil.defringe(out.px, o.opaque, together=whole)
        steps.append(f"defringe (opaque ≥ {o.opaque})")
    if o.binarize:
        out.px = pointwise.alpha_threshold(out.px, o.alpha)
        steps.append(f"alpha→{o.alpha}")
    if o.spikes:
        out.px = stencil.median(out.px, together=whole)
        steps.append("median 3×3")
    if o.islands:
        out.px = components.denoise_islands(out.px, 1, max(1, o.island_size), tile=tile)
        steps.append(f"isole < {o.island_size}")
    if o.reduce_palette:
        k = min(256, max(2, o.colours))
        out.palette = palette.extract(out.px, k)
        out.px = palette.reduce(out.px, k, dither=o.dither)
        more = " +dither" if o.dither else ""
        steps.append(F.when(F.col("colours") > 0, F.concat(F.lit("palette "), F.col("colours").cast("string"), F.lit(more))))
    out.steps = tuple(steps)
    return out


def remove_background(px: DataFrame, key: RGB, tolerance: float, edge: float, alpha: int | None = None, seeds: DataFrame | None = None, tile: int | str | None = components.COUNTED) -> DataFrame:
    """The interactive tool: each image's key goes to the border colour it is near, then isolation, then alpha for images that lost pixels.

    All images go through one plan, with their keys as a column.  ``alpha`` is kept within 1 to 254.
    """
    tile = components.chosen(px, tile)
    d = components.background(px, aggregate.snap_key(px, key), tolerance, edge, seeds=seeds, tile=tile)
    gone = F.col("__reached") & (F.col("a") != 0)
    if alpha is None:
        return cleared(d, gone).select(*px.columns)
    d = components.of_image(d.withColumn("__gone", gone), F.max("__gone"), "__lost", tile)
    cut = F.when(F.col("a") > min(254, max(1, alpha)), 255).otherwise(0)
    d = recolour(d, F.col("__lost") & ~F.col("__gone"), a=cut)
    return cleared(d, F.col("__gone")).select(*px.columns)


@dataclass(frozen=True)
class Form:
    """Texts and ticks of the pipeline form (fixed defaults)."""

    isolation: bool = False
    snap: bool = False
    background: str = "#00FF00"
    tolerance: str = "0"
    quantize: bool = False
    colours: str = "16"
    quantizer: int = 0
    majority: bool = False
    island: str = "2"
    outline: bool = False
    outline_colour: str = "#000000"
    alpha_on: bool = False
    alpha: str = "128"
    majority_least: str = "1"
    preset: str | None = None


def int_in(text: str | None, fallback: int, lo: int, hi: int = 2**31 - 1) -> int:
    try:
        v = int((text or "").strip())
    except ValueError:
        v = fallback
    return min(hi, max(lo, v))


def hex_of(text: str | None) -> RGB | None:
    t = (text or "").strip().removeprefix("#")
    return tuple(bytes.fromhex(t)) if len(t) == 6 and all(c in "0123456789abcdefABCDEF" for c in t) else None


def options_of(f: Form, with_outline: bool = True) -> Options:
    """Checked and clamped; either background tick turns the background stage on."""
    background, outlined = f.isolation or f.snap, with_outline and f.outline
    if not (background or f.quantize or f.majority or f.alpha_on or outlined or f.preset):
        raise ValueError("no transformation is selected")
    key, line = hex_of(f.background), hex_of(f.outline_colour)
    if background and key is None:
        raise ValueError("the background is not a hex colour")
    if outlined and line is None:
        raise ValueError("the outline is not a hex colour")
    return Options(
        background_isolation=background, background_snap=f.snap, background=key if background else GREEN, tolerance=int_in(f.tolerance, 0, 0),
        quantize=f.quantize, max_colours=int_in(f.colours, 16, 2, 256), quantizer="Octree" if f.quantizer == 1 else "Wu",
        majority=f.majority, majority_least=int_in(f.majority_least, 1, 1), island_area=int_in(f.island, 3 if f.preset == "Aggressive" else 2, 1) if f.majority else None,
        outline=outlined, outline_colour=(*(line or (0, 0, 0)), 255), alpha=int_in(f.alpha, 128, 0, 255) if f.alpha_on else None,
    )


def flag_value(args: list[str], flag: str) -> int | None:
    """The integer after the first occurrence of a flag."""
    low = [a.lower() for a in args[:-1]]
    if flag.lower() not in low:
        return None
    try:
        return int(args[low.index(flag.lower()) + 1])
    except ValueError:
        return None


def batch_options(args: list[str]) -> tuple[Options, int | None, bool]:
    """(options, colours of a shared palette or None, write indexed) of a batch job's arguments."""
    low = [a.lower() for a in args]
    k = flag_value(args, "--palette")
    shared = k if "--shared-palette" in low and k is not None and 2 <= k <= 256 else None
    o = Options(background_isolation=False, quantize=k is not None and shared is None, max_colours=k or 16)
    if "--background-snap" in low[:-1]:
        at = low.index("--background-snap")
        key = hex_of(args[at + 1])
        if key:
            o = replace(o, background_isolation=True, background_snap=True, background=key, tolerance=int_in(args[at + 2] if at + 2 < len(args) else None, 0, 0))
    return o, shared, "--indexed" in low


def batch(px: DataFrame, args: list[str]) -> tuple[Run, bool]:
    """A directory's images: an optional palette over all of them first, then the pipeline, then the map to it."""
    o, shared, indexed = batch_options(args)
    pal = palette.shared_palette(pointwise.snap_background(px, o.background, o.tolerance) if o.background_snap else px, shared) if shared else None
    out = run(px, o)
    if pal is not None:
        out.px = palette.map_to_palette(out.px, pal)
    return out, indexed


__all__ = ["Cleanup", "Form", "Options", "PRESETS", "Run", "batch", "batch_options", "clean", "normalise_hex", "options_of", "parse_hex", "remove_background", "run", "summary"]
