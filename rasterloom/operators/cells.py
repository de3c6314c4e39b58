"""Cells, frames and boxes: packing, centring, snapping, hit tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.functions import scalar
from rasterloom.operators.aggregate import select_size, size_statistics
from rasterloom.operators.compose import on_canvas
from rasterloom.operators.prefix import before
from rasterloom.schema import images_of

BOX = ("min_x", "min_y", "max_x", "max_y")


def in_cells(px: DataFrame, cells: DataFrame, padding: int = 0) -> DataFrame:
    """Pixels with each cell that holds them: (image_id, ord, x, y in the cell, r, g, b, a, the cell's box).

    Cells and pixels meet on tiles of 64 pixels, so that a sheet of many cells
    doesn't pair every pixel with every cell.
    """
    t = 64
    div = lambda c: F.call_function("div", c, F.lit(t)).cast("int")
    c = cells.select("image_id", "ord", *BOX)
    span = lambda lo, hi: F.explode(F.sequence(div(F.greatest(F.col(lo) - padding, F.lit(0))), div(F.greatest(F.col(hi) + padding - 1, F.lit(0)))))
    c = c.withColumn("__tx", span("min_x", "max_x")).withColumn("__ty", span("min_y", "max_y"))
    p = px.withColumns({"__tx": div(F.col("x")), "__ty": div(F.col("y"))})
    hit = (F.col("x") >= F.col("min_x") - padding) & (F.col("x") < F.col("max_x") + padding) & (F.col("y") >= F.col("min_y") - padding) & (F.col("y") < F.col("max_y") + padding)
    d = p.join(c, ["image_id", "__tx", "__ty"]).where(hit)
    return d.select("image_id", "ord", (F.col("x") - F.col("min_x") + padding).alias("x"), (F.col("y") - F.col("min_y") + padding).alias("y"), *"rgba", *BOX)


def cell_boxes(px: DataFrame, cells: DataFrame, alpha: int = 1, padding: int = 0) -> DataFrame:
    """The cells with the opaque box of their content, ``o_*`` in cell coordinates, null without any."""
    o = in_cells(px, cells, padding).where(F.col("a") >= alpha).groupBy("image_id", "ord").agg(F.min("x").alias("o_min_x"), F.min("y").alias("o_min_y"), (F.max("x") + 1).alias("o_max_x"), (F.max("y") + 1).alias("o_max_y"))
    return cells.join(o, ["image_id", "ord"], "left")


def content_size(px: DataFrame, cells: DataFrame, alpha: int = 1) -> DataFrame:
    """(image_id, w, h): the largest opaque width and height over the cells."""
    b = cell_boxes(px, cells, alpha)
    return b.groupBy("image_id").agg(F.coalesce(F.max(F.col("o_max_x") - F.col("o_min_x")), F.lit(0)).alias("w"), F.coalesce(F.max(F.col("o_max_y") - F.col("o_min_y")), F.lit(0)).alias("h"))


def centre_offset(size: Column, lo: Column, hi: Column) -> Column:
    """Where content lo..hi stands centred in a global size; 0 for no content."""
    return F.when(lo.isNull() | (hi <= lo), 0).otherwise(scalar.idiv(size - (hi - lo), 2) - lo).cast("int")


def snap_modulo(ideal: Column, o_min: Column, o_max: Column, c_min: Column, c_max: Column, g: int) -> Column:
    """The place nearest to ``ideal``, in the cell, at which the opaque corner stands on a multiple of ``g``.

    The lower of two equally near; unchanged for g under 2, or a cell without
    that much room.  Closed form: the multiples around the ideal, kept in range.
    """
    if g < 2:
        return ideal
    lo, hi = c_min - o_min, c_max - o_max
    first = lo + F.pmod(-(lo + o_min), F.lit(g))
    last = hi - F.pmod(hi + o_min, F.lit(g))
    below = ideal - F.pmod(ideal + o_min, F.lit(g))
    near = F.when(ideal - below <= below + g - ideal, below).otherwise(below + g)
    return F.when((lo > hi) | (hi - lo < g), ideal).otherwise(F.least(F.greatest(near, first), last)).cast("int")


def centre_in_cells(px: DataFrame, cells: DataFrame, alpha: int = 1, snap: int = 8) -> DataFrame:
    """A new atlas with each cell's content centred; whole cells are drawn, in order; empty ones are left out."""
    b = cell_boxes(px, cells, alpha).where(F.col("o_min_x").isNotNull())
    to = lambda c: snap_modulo(
        F.col(f"min_{c}") + scalar.idiv(F.col(f"max_{c}") - F.col(f"min_{c}"), 2) - (F.col(f"o_min_{c}") + scalar.idiv(F.col(f"o_max_{c}") - F.col(f"o_min_{c}"), 2)),
        F.col(f"o_min_{c}"), F.col(f"o_max_{c}"), F.col(f"min_{c}"), F.col(f"max_{c}"), snap,
    )
    at = b.select("image_id", "ord", to("x").alias("dx"), to("y").alias("dy"))
    d = in_cells(px, cells).join(at, ["image_id", "ord"])
    return on_canvas(d.select("image_id", (F.col("x") + F.col("dx")).alias("x"), (F.col("y") + F.col("dy")).alias("y"), F.col("ord").alias("z"), *"rgba"), images_of(px))


def snap_origin(origin: Column, extent: Column, side: Column, g: int) -> Column:
    at = origin - F.pmod(origin, F.lit(max(1, g)))
    most = F.when((extent < 1) | (extent > side), F.greatest(F.lit(0), side - 1)).otherwise(side - extent)
    return F.least(F.greatest(at, F.lit(0)), most).cast("int")


def snap_to_grid(px: DataFrame, cells: DataFrame, g: int = 16) -> tuple[DataFrame, DataFrame]:
    """Cells moved to multiples of ``g`` inside the atlas, and the atlas redrawn; later cells win."""
    c = cells.where("max_x > min_x and max_y > min_y").join(images_of(px), "image_id")
    w, h = F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y")
    c = c.withColumns({"sx": snap_origin(F.col("min_x"), w, F.col("width"), g), "sy": snap_origin(F.col("min_y"), h, F.col("height"), g)})
    d = in_cells(px, cells).join(c.select("image_id", "ord", "sx", "sy"), ["image_id", "ord"])
    out = on_canvas(d.select("image_id", (F.col("x") + F.col("sx")).alias("x"), (F.col("y") + F.col("sy")).alias("y"), F.col("ord").alias("z"), *"rgba"), images_of(px))
    return out, c.select("image_id", "ord", "id", F.col("sx").alias("min_x"), F.col("sy").alias("min_y"), (F.col("sx") + w).alias("max_x"), (F.col("sy") + h).alias("max_y"))


def align_baseline(px: DataFrame, cells: DataFrame, policy: str = "max", alpha: int = 1) -> tuple[DataFrame, DataFrame]:
    """A row atlas of equal cells with every content's lowest pixel at the bottom, centred sideways."""
    w, h = F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y")
    low = in_cells(px, cells).groupBy("image_id", "ord").agg(F.max(F.when(F.col("a") > alpha, F.col("y"))).alias("low"))
    size = select_size(size_statistics(cells.select("image_id", w.alias("w"), h.alias("h")), "image_id"), policy).select("image_id", "target_w", "target_h")
    n = Window.partitionBy("image_id").orderBy("ord")
    c = cells.withColumn("i", F.row_number().over(n) - 1).join(low, ["image_id", "ord"], "left").join(size, "image_id")
    c = c.withColumns({"dx": F.col("i") * F.col("target_w") + scalar.idiv(F.col("target_w") - w, 2), "dy": F.when(F.col("low").isNull(), 0).otherwise(F.col("target_h") - 1 - F.col("low"))})
    d = in_cells(px, cells).join(c.select("image_id", "ord", "i", "dx", "dy"), ["image_id", "ord"])
    sizes = c.groupBy("image_id").agg((F.count("*") * F.first("target_w")).cast("int").alias("width"), F.first("target_h").alias("height"))
    out = on_canvas(d.select("image_id", (F.col("x") + F.col("dx")).cast("int").alias("x"), (F.col("y") + F.col("dy")).cast("int").alias("y"), F.col("i").alias("z"), *"rgba"), sizes)
    x = F.col("i") * F.col("target_w")
    return out, c.select("image_id", "ord", "id", x.cast("int").alias("min_x"), F.lit(0).alias("min_y"), (x + F.col("target_w")).cast("int").alias("max_x"), F.col("target_h").alias("max_y"))


# ---- frames: content of a cell with a margin, and an offset -------------------


def frame_offsets(px: DataFrame, cells: DataFrame, padding: int = 0, alpha: int = 1, how: str = "centre", snap: int = 8) -> DataFrame:
    """(image_id, ord, off_x, off_y): content centred (and snapped), on the baseline, or not moved; (0, 0) for empty frames."""
    b = cell_boxes(px, cells, alpha, padding)
    none = F.col("o_min_x").isNull()
    mid = lambda c: scalar.idiv(F.col(f"max_{c}") - F.col(f"min_{c}"), 2) - (F.col(f"o_min_{c}") + scalar.idiv(F.col(f"o_max_{c}") - F.col(f"o_min_{c}"), 2)) + padding
    if how == "centre":
        at = lambda c: snap_modulo(F.col(f"min_{c}") + mid(c) - padding, F.col(f"o_min_{c}"), F.col(f"o_max_{c}"), F.col(f"min_{c}"), F.col(f"max_{c}"), snap) - F.col(f"min_{c}") + padding
        x, y = (at("x"), at("y")) if snap >= 2 else (mid("x"), mid("y"))
    elif how == "baseline":
        x, y = mid("x"), F.col("max_y") - F.col("min_y") - 1 - (F.col("o_max_y") - 1) + padding
    else:
        x, y = F.lit(0), F.lit(0)
    return b.select("image_id", "ord", F.when(none, 0).otherwise(x).cast("int").alias("off_x"), F.when(none, 0).otherwise(y).cast("int").alias("off_y"))


def compose_frames(px: DataFrame, cells: DataFrame, offsets: DataFrame, padding: int = 0) -> DataFrame:
    """The atlas from its frames at their offsets, in order."""
    d = in_cells(px, cells, padding).join(offsets, ["image_id", "ord"])
    at = lambda c: (F.col(c) + F.col(f"min_{c}") + F.col(f"off_{c}") - padding).cast("int").alias(c)
    return on_canvas(d.select("image_id", at("x"), at("y"), F.col("ord").alias("z"), *"rgba"), images_of(px))


def commit_boxes(px: DataFrame, cells: DataFrame, offsets: DataFrame, padding: int = 0, alpha: int = 1) -> DataFrame:
    """New boxes of frames that were moved: their opaque box, moved and clamped; frames that are empty or have left the atlas keep their cell."""
    b = cell_boxes(px, cells, alpha, padding).join(offsets, ["image_id", "ord"]).join(images_of(px), "image_id")
    moved = lambda c, end, side: F.least(F.greatest(F.col(f"min_{c}") + F.col(f"off_{c}") - padding + F.col(f"o_{end}_{c}"), F.lit(0)), F.col(side))
    sides = (("x", "width"), ("y", "height"))
    gone = F.col("o_min_x").isNull() | F.lit(False)
    for c, s in sides:
        gone = gone | (moved(c, "min", s) >= moved(c, "max", s))
    new = {f"{end}_{c}": F.when(gone, F.col(f"{end}_{c}")).otherwise(moved(c, end, s)).cast("int") for end in ("min", "max") for c, s in sides}
    return b.select("image_id", "ord", "id", *[v.alias(k) for k, v in new.items()])


def centre_in_atlas(px: DataFrame, cells: DataFrame, padding: int = 0, alpha: int = 1) -> DataFrame:
    """(image_id, ord, off_x, off_y) that puts each frame's content on the middle of the atlas."""
    b = cell_boxes(px, cells, alpha, padding).join(images_of(px), "image_id")
    to = lambda c, s: scalar.idiv(F.col(s), 2) - (F.col(f"o_min_{c}") + scalar.idiv(F.col(f"o_max_{c}") - F.col(f"o_min_{c}"), 2)) - F.col(f"min_{c}") + padding
    return b.select("image_id", "ord", *[F.when(F.col("o_min_x").isNull(), 0).otherwise(to(c, s)).cast("int").alias(f"off_{c}") for c, s in (("x", "width"), ("y", "height"))])


def drag_snap(x: Column, y: Column, centre_x: Column, centre_y: Column, base_y: Column, radius: float) -> Column:
    """struct<x, y>: x to the centre within the radius; y to the nearer of centre and baseline, the centre if equal."""
    dc, db = F.abs(y - centre_y), F.abs(y - base_y)
    sy = F.when((dc <= radius) & (dc <= db), centre_y).when(db <= radius, base_y).otherwise(y)
    return F.struct(F.when(F.abs(x - centre_x) <= radius, centre_x).otherwise(x).alias("x"), sy.alias("y"))


# ---- packing -----------------------------------------------------------------


def pack_row(boxes: DataFrame, sheet: str = "sheet", run: int | None = None) -> DataFrame:
    """(sheet, ord, x, y, w, h, atlas_w, atlas_h): side by side in order, centred upright; equal orders go by size.

    A sheet of more boxes than ``run`` is packed by ranges of its order, see ``prefix``.
    """
    d = before(boxes, sheet, ["ord", "w", "h"], ["w"], ["h"], run)
    return d.select(sheet, "ord", F.col("__before_w").alias("x"), scalar.idiv(F.col("__max_h") - F.col("h"), 2).alias("y"), "w", "h", F.col("__all_w").alias("atlas_w"), F.col("__max_h").cast("int").alias("atlas_h"))


def pack_uniform(boxes: DataFrame, cell_w: Column | int | None = None, cell_h: Column | int | None = None, sheet: str = "sheet", run: int | None = None) -> DataFrame:
    """(sheet, ord, x, y, w, h of the slot, dx, dy of the content): equal slots, by default of the largest size."""
    lit = lambda v, c: F.col(f"__max_{c}") if v is None else v if isinstance(v, Column) else F.lit(v)
    d = before(boxes, sheet, ["ord", "w", "h"], [], ["w", "h"], run).withColumns({"__cw": lit(cell_w, "w"), "__ch": lit(cell_h, "h")})
    return d.select(sheet, "ord", (F.col("__before_n") * F.col("__cw")).cast("long").alias("x"), F.lit(0).alias("y"), F.col("__cw").cast("int").alias("w"), F.col("__ch").cast("int").alias("h"), scalar.idiv(F.col("__cw") - F.col("w"), 2).alias("dx"), scalar.idiv(F.col("__ch") - F.col("h"), 2).alias("dy"))


def export_layout(boxes: DataFrame, uniform: bool = False, custom: tuple[int, int] | None = None, sheet: str = "sheet", run: int | None = None) -> DataFrame:
    """Compact rows, equal cells, or cells of a custom size, which must hold the largest frame."""
    if custom is None:
        return pack_uniform(boxes, sheet=sheet, run=run) if uniform else pack_row(boxes, sheet, run)
    ok = (F.col("w") <= custom[0]) & (F.col("h") <= custom[1])
    text = F.concat(F.lit(f"custom cell {custom[0]}x{custom[1]} is smaller than frame "), F.col("w"), F.lit("x"), F.col("h"))
    checked = boxes.withColumn("w", F.when(ok, F.col("w")).otherwise(F.raise_error(text).cast("int")))
    return pack_uniform(checked, *custom, sheet=sheet, run=run)


def full_cells(images: DataFrame, cells: DataFrame) -> DataFrame:
    """The cells, and a cell "full" for every image without any."""
    bare = images.join(cells.select("image_id").distinct(), "image_id", "left_anti")
    full = bare.select("image_id", F.lit(0).alias("ord"), F.lit("full").alias("id"), F.lit(0).alias("min_x"), F.lit(0).alias("min_y"), F.col("width").alias("max_x"), F.col("height").alias("max_y"))
    return cells.select("image_id", "ord", "id", *BOX).unionByName(full)


# ---- picking -------------------------------------------------------------------


def hit_test(points: DataFrame, cells: DataFrame, tile: int = 64) -> DataFrame:
    """The points (image_id, point_id, wx, wy) with the first cell that holds each, or null; points and cells meet on tiles."""
    div = lambda c: F.floor(c / tile).cast("int")
    c = cells.where("max_x > min_x and max_y > min_y").select("image_id", "ord", "id", *BOX)
    c = c.withColumn("__tx", F.explode(F.sequence(div(F.col("min_x")), div(F.col("max_x") - 1)))).withColumn("__ty", F.explode(F.sequence(div(F.col("min_y")), div(F.col("max_y") - 1))))
    p = points.withColumns({"__tx": div(F.col("wx")), "__ty": div(F.col("wy"))})
    hit = (F.col("wx") >= F.col("min_x")) & (F.col("wx") < F.col("max_x")) & (F.col("wy") >= F.col("min_y")) & (F.col("wy") < F.col("max_y"))
    best = p.join(c, ["image_id", "__tx", "__ty"]).where(hit).groupBy("image_id", "point_id").agg(F.min_by(F.struct("ord", "id"), "ord").alias("c"))
    return points.join(best, ["image_id", "point_id"], "left").select("image_id", "point_id", F.col("c.ord").alias("ord"), F.col("c.id").alias("id"))


def snap_to_lines(values: DataFrame, lines: DataFrame, threshold: float, grid: float) -> DataFrame:
    """Values (image_id, value_id, v) moved to the nearest cell edge of their image within the threshold, the lower of two, else to the grid.

    Values and lines meet in buckets as wide as the threshold, a line in three of them.
    """
    wide = max(threshold, 1e-9)
    key = lambda c: F.floor(c / wide).cast("long")
    l = lines.select("image_id", F.col("v").cast("double").alias("line")).distinct()  # noqa: E741
    l = l.withColumn("__k", F.explode(F.array(*[key(F.col("line")) + d for d in (-1, 0, 1)])))  # noqa: E741
    near = values.withColumn("__k", key(F.col("v"))).join(l, ["image_id", "__k"]).where(F.abs(F.col("v") - F.col("line")) <= threshold)
    best = near.groupBy("image_id", "value_id").agg(F.min(F.struct(F.abs(F.col("v") - F.col("line")).alias("d"), "line")).alias("m"))
    return values.join(best, ["image_id", "value_id"], "left").select("image_id", "value_id", F.coalesce("m.line", F.rint(F.col("v") / grid) * grid).alias("snapped"))


def move_selection(b: Column, dx: Column, dy: Column, w: Column, h: Column) -> Column:
    """A selection moved by a rounded distance, kept inside the image."""
    at = lambda lo, hi, d, n: F.least(F.greatest(lo + F.rint(d).cast("int"), F.lit(0)), n - (hi - lo)).cast("int")
    x, y = at(b["min_x"], b["max_x"], dx, w), at(b["min_y"], b["max_y"], dy, h)
    return scalar.box(x, y, x + scalar.width(b), y + scalar.height(b))


#: Which sides each of the eight grips moves: left, top, right, bottom.
GRIPS = {"nw": "lt", "n": "t", "ne": "rt", "e": "r", "se": "rb", "s": "b", "sw": "lb", "w": "l"}


def resize_selection(b: Column, grip: str, wx: Column, wy: Column, w: Column, h: Column) -> Column:
    """A selection with one grip dragged to a place."""
    on = GRIPS[grip]
    pick = lambda k, at, old: at if k in on else old.cast("double")
    return scalar.from_corners(pick("l", wx, b["min_x"]), pick("t", wy, b["min_y"]), pick("r", wx, b["max_x"]), pick("b", wy, b["max_y"]), w, h)
