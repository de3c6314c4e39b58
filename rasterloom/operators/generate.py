"""Tables made from parameters: cells of grids, templates, digits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.functions.scalar import PIVOTS, blend, idiv
from rasterloom.operators.compose import RGBA_T, folded
from rasterloom.schema import spread

RGBA = tuple[int, int, int, int]


def _cells(images: DataFrame, rows: Column | int, cols: Column | int, w: Column | int, h: Column | int, sx: int = 0, sy: int = 0) -> DataFrame:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    d = images.withColumns({"__rows": lit(rows), "__cols": lit(cols), "__cw": lit(w), "__ch": lit(h)}).where("__rows > 0 and __cols > 0 and __cw > 0 and __ch > 0")
    d = d.withColumn("__r", F.explode(F.sequence(F.lit(0), (F.col("__rows") - 1).cast("int")))).withColumn("__c", F.explode(F.sequence(F.lit(0), (F.col("__cols") - 1).cast("int"))))
    x, y = F.col("__c") * (F.col("__cw") + max(0, sx)), F.col("__r") * (F.col("__ch") + max(0, sy))
    i = lambda c: c.cast("int")
    return d.select("image_id", i(F.col("__r") * F.col("__cols") + F.col("__c")).alias("ord"), F.concat(F.lit("r"), "__r", F.lit("c"), "__c").alias("id"), i(x).alias("min_x"), i(y).alias("min_y"), i(x + F.col("__cw")).alias("max_x"), i(y + F.col("__ch")).alias("max_y"), F.lit(0.5).alias("pivot_x"), F.lit(0.5).alias("pivot_y"))


def slice_grid(images: DataFrame, rows: int, cols: int) -> DataFrame:
    """Cells of the image's share, floored to a multiple of 8; none under 8; the rest stays uncovered."""
    down = lambda c, n: idiv(F.col(c), n).bitwiseAND(~7)
    return _cells(images.where(F.lit(rows > 0 and cols > 0)), rows, cols, down("width", max(1, cols)), down("height", max(1, rows)))


def slice_exact(images: DataFrame, rows: int, cols: int, w: int, h: int, sx: int = 0, sy: int = 0) -> DataFrame:
    """Cells of a given size, spaced; not checked against the image."""
    return _cells(images, rows, cols, w, h, sx, sy)


def slice_aligned(images: DataFrame, w: int, h: int, sx: int = 0, sy: int = 0) -> DataFrame:
    """As many whole cells as fit."""
    fit = lambda c, n, s: idiv(F.col(c) + s, n + s)
    return _cells(images, fit("height", h, max(0, sy)), fit("width", w, max(0, sx)), w, h, sx, sy)


#: Digits 0 to 9, five rows of three pixels each (fixed values).
DIGITS = (
    "111 101 101 101 111",
    "010 110 010 010 111",
    "111 001 111 100 111",
    "111 001 011 001 111",
    "101 101 111 001 001",
    "111 100 111 001 111",
    "111 100 111 101 111",
    "111 001 001 001 001",
    "111 101 111 101 111",
    "111 101 111 001 111",
)


@dataclass(frozen=True)
class Template:
    """A grid template's options (fixed defaults)."""

    rows: int = 4
    cols: int = 4
    cell_w: int = 64
    cell_h: int = 64
    show_border: bool = True
    border: RGBA = (60, 220, 255, 200)
    border_thickness: int = 1
    show_pivot: bool = True
    pivot: str = "Center"
    pivot_x: float = 0.5
    pivot_y: float = 0.5
    pivot_colour: RGBA = (255, 210, 0, 230)
    arm: int = 6
    dot: int = 2
    show_baseline: bool = True
    baseline: RGBA = (255, 210, 0, 80)
    show_index: bool = True
    index_colour: RGBA = (255, 210, 0, 200)
    index_scale: int = 1
    show_tint: bool = False
    tint_even: RGBA = (255, 255, 255, 10)
    tint_odd: RGBA = (100, 80, 255, 10)


def template_rects(o: Template) -> list[tuple[int, int, int, int, int, RGBA]]:
    """(z, x, y, w, h, colour) in one cell, of the parts that are alike in all cells."""
    w, h, t = o.cell_w, o.cell_h, max(1, o.border_thickness)
    nx, ny = PIVOTS.get(o.pivot, (o.pivot_x, o.pivot_y))
    px, py = min(w - 1, max(0, round(nx * (w - 1)))), min(h - 1, max(0, round(ny * (h - 1))))
    out: list[tuple[int, int, int, int, int, RGBA]] = []
    if o.show_border:
        out += [(1, 0, 0, w, t, o.border), (2, 0, h - t, w, t, o.border), (3, 0, 0, t, h, o.border), (4, w - t, 0, t, h, o.border)]
    if o.show_baseline:
        out.append((5, 0, py, w, 1, o.baseline))
    if o.show_pivot:
        out += [(6, px - o.arm, py, 2 * o.arm + 1, 1, o.pivot_colour), (7, px, py - o.arm, 1, 2 * o.arm + 1, o.pivot_colour)]
        for dy in range(-o.dot, o.dot + 1):
            half = max((dx for dx in range(o.dot + 1) if dx * dx + dy * dy <= o.dot * o.dot), default=-1)
            if half >= 0:
                out.append((8, px - half, py + dy, 2 * half + 1, 1, o.pivot_colour))
    return out


def template(spark: SparkSession, o: Template | None = None, image_id: int = 0) -> DataFrame:
    """A template sheet: tint, border, baseline, pivot and index of every cell, blended in that order.

    Parts that overlap blend again: the corners of the border, the middle of the pivot.
    """
    o = o or Template()
    sheet = spark.createDataFrame([(image_id, o.rows, o.cols)], "image_id long, rows int, cols int")
    return templates(sheet, o)


def templates(sheets: DataFrame, o: Template) -> DataFrame:
    """``template`` for each row (image_id, rows, cols); the other options are those of ``o``.

    Rows without rows or columns, or with nulls there, give no sheet.
    """
    if o.rows < 1 or o.cols < 1 or o.cell_w < 4 or o.cell_h < 4:
        raise ValueError("at least one row and column, and cells of 4 by 4")
    sheets = sheets.where("rows > 0 and cols > 0").select(F.col("image_id").cast("long").alias("image_id"), F.col("rows").cast("int").alias("rows"), F.col("cols").cast("int").alias("cols"))
    cells = spread(sheets).withColumn("n", F.explode(F.sequence(F.lit(0), F.col("rows") * F.col("cols") - 1)))
    cells = cells.withColumns({"i": F.col("n") % F.col("cols"), "j": idiv(F.col("n"), F.col("cols")), "digits": F.col("n").cast("string")})
    cells = cells.select("image_id", (F.col("i") * o.cell_w).alias("ox"), (F.col("j") * o.cell_h).alias("oy"), ((F.col("i") + F.col("j")) % 2).alias("odd"), "digits")
    xs, ys, faces = _faces(sheets.sparkSession, o)
    among = lambda c, cuts: sum(((F.col(c) >= v).cast("int") for v in cuts[1:]), F.lit(0))
    d = cells.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(o.cell_h - 1)))).withColumn("at", (F.col("odd") * len(ys) + among("y", ys)) * len(xs))
    d = d.withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(o.cell_w - 1)))).withColumn("c", F.get(faces, F.col("at") + among("x", xs)))
    if o.show_index and o.index_colour[3] > 0:
        s = max(1, o.index_scale)
        u, v = F.col("x") - 2, F.col("y") - 2
        inside = (u >= 0) & (v >= 0) & (v < 5 * s) & (u % (4 * s) < 3 * s) & (idiv(u, 4 * s) < F.length("digits"))
        digit = F.substr(F.col("digits"), idiv(u, 4 * s).cast("int") + 1, F.lit(1)).cast("int")
        dot = F.substr(F.lit("".join(DIGITS).replace(" ", "")), (digit * 15 + idiv(v, s) * 3 + idiv(u % (4 * s), s) + 1).cast("int"), F.lit(1)) == "1"
        top = F.struct(*[F.lit(v).alias(c) for v, c in zip(o.index_colour, "rgba", strict=True)])
        d = d.withColumn("c", F.when(inside & F.when(inside, dot), blend(top, F.col("c")).cast(RGBA_T)).otherwise(F.col("c")))
    return d.select("image_id", (F.col("ox") + F.col("x")).cast("int").alias("x"), (F.col("oy") + F.col("y")).cast("int").alias("y"), "c.*")


def _faces(spark: SparkSession, o: Template) -> tuple[list[int], list[int], Column]:
    """(xs, ys, colours): the parts' edges cut a cell into rectangles of one colour each; those of even cells, then those of odd ones, row by row.

    Their number goes by the parts, not by the size of a cell.
    """
    rects = [r[1:] for r in sorted(template_rects(o), key=lambda r: r[0])]
    cuts = lambda ends, most: sorted({0, *(v for v in ends if 0 < v < most)})
    xs, ys = cuts([v for x, _, w, _, _ in rects for v in (x, x + w)], o.cell_w), cuts([v for _, y, _, h, _ in rects for v in (y, y + h)], o.cell_h)
    lit = lambda x, y, w, h, c: F.struct(*[(v if isinstance(v, Column) else F.lit(v)).cast("int").alias(n) for v, n in zip((x, y, w, h, *c), "xywhrgba", strict=True)])
    tint = [F.when(F.col("odd") == 0, e).otherwise(d) for e, d in zip(o.tint_even, o.tint_odd, strict=True)] if o.show_tint else (0, 0, 0, 0)
    parts = F.array(lit(0, 0, o.cell_w, o.cell_h, tint), *[lit(*r) for r in rects])
    each = F.array(*map(F.lit, xs)), F.array(*map(F.lit, ys))
    d = spark.range(0, 2 * len(xs) * len(ys), 1, 1).withColumns({"x": F.get(each[0], (F.col("id") % len(xs)).cast("int")), "y": F.get(each[1], (idiv(F.col("id"), len(xs)) % len(ys)).cast("int")), "odd": idiv(F.col("id"), len(xs) * len(ys))})
    over = F.filter(parts, lambda p: (p["a"] > 0) & (p["x"] <= F.col("x")) & (F.col("x") < p["x"] + p["w"]) & (p["y"] <= F.col("y")) & (F.col("y") < p["y"] + p["h"]))
    faces = d.select(F.struct("id", folded(over).alias("c")).alias("f")).agg(F.sort_array(F.collect_list("f")).alias("f"))
    return xs, ys, faces.select(F.transform("f", lambda f: f["c"])).scalar()
