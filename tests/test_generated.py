"""Canvases, templates and presets made from the rows of a table."""

from __future__ import annotations

import pytest
from support import DATA

from rasterloom import catalog
from rasterloom.operators import compose, generate, geometry, palette

SIZES = "image_id long, width int, height int, r int, g int, b int, a int"


def test_canvases_of_rows(spark):
    rows = [(1, 3, 2, 9, 8, 7, 6), (2, 0, 5, 0, 0, 0, 0), (3, None, 1, 0, 0, 0, 0), (4, 1, 9000, 0, 0, 0, 0), (5, 1, 1, 1, 2, 3, 4)]
    got = sorted(tuple(r) for r in geometry.blanks(spark.createDataFrame(rows, SIZES)).collect())
    assert got == [(1, x, y, 9, 8, 7, 6) for x in range(3) for y in range(2)] + [(5, 0, 0, 1, 2, 3, 4)]
    assert geometry.blanks(spark.createDataFrame([], SIZES)).collect() == []


def test_one_canvas_and_one_disc_equal_those_of_rows(spark):
    one = spark.createDataFrame([(7, 5, 4, 1, 2, 3, 4)], SIZES)
    assert sorted(geometry.blanks(one).collect()) == sorted(geometry.blank(spark, 7, 5, 4, (1, 2, 3, 4)).collect())
    assert sorted(geometry.discs(one).collect()) == sorted(geometry.disc(spark, 7).collect())


def test_sheets_of_rows_are_the_single_templates(spark):
    o = generate.Template(rows=2, cols=3, cell_w=18, cell_h=16, show_tint=True)
    sheets = spark.createDataFrame([(1, 2, 3), (2, 1, 1), (3, 0, 4), (4, None, 2)], "image_id long, rows int, cols int")
    got = generate.templates(sheets, o)
    assert sorted(got.where("image_id = 1").collect()) == sorted(generate.template(spark, o, 1).collect())
    assert got.where("image_id = 2").count() == 18 * 16
    assert got.where("image_id > 2").count() == 0


def test_presets_by_name(spark):
    rows = spark.createDataFrame([(1, "CGA4"), (2, "cga4"), (3, None), (4, "GameBoyDMG"), (4, "GameBoyDMG")], "k long, name string")
    got = palette.named(rows, "name", "k").collect()
    assert sorted((r["k"], r["idx"]) for r in got) == [(1, i) for i in range(4)] + [(4, i // 2) for i in range(8)]
    assert [(r["r"], r["g"], r["b"]) for r in sorted(got) if r["k"] == 1] == palette.preset_colours("CGA4")


def _layered(spark, o, rows, cols):
    """A sheet's parts as layers, composed place by place."""
    layers = []
    for n in range(rows * cols):
        i, j = n % cols, n // cols
        parts = list(generate.template_rects(o))
        if o.show_tint:
            parts.append((0, 0, 0, o.cell_w, o.cell_h, o.tint_odd if (i + j) % 2 else o.tint_even))
        if o.show_index:
            s = o.index_scale
            parts += [(9, 2 + (k * 4 + c) * s, 2 + r * s, s, s, o.index_colour) for k, d in enumerate(str(n)) for r, row in enumerate(generate.DIGITS[int(d)].split()) for c, on in enumerate(row) if on == "1"]
        for z, x, y, w, h, colour in parts:
            layers += [(7, i * o.cell_w + a, j * o.cell_h + b, z, *colour) for a in range(max(0, x), min(o.cell_w, x + w)) for b in range(max(0, y), min(o.cell_h, y + h))]
    layers = spark.createDataFrame(layers, "image_id long, x int, y int, z int, r int, g int, b int, a int")
    return compose.on_canvas(layers, spark.createDataFrame([(7, cols * o.cell_w, rows * o.cell_h)], "image_id long, width int, height int"))


@pytest.mark.parametrize(
    "o",
    [
        generate.Template(cell_w=18, cell_h=16, show_tint=True),
        generate.Template(cell_w=9, cell_h=8, index_scale=2, border_thickness=3, pivot="TopLeft", arm=12, tint_even=(1, 2, 3, 0), show_tint=True),
        generate.Template(cell_w=5, cell_h=4, show_border=False, show_pivot=False, show_baseline=False, index_colour=(9, 8, 7, 255)),
        generate.Template(cell_w=6, cell_h=7, show_index=False, index_colour=(1, 1, 1, 255), baseline=(5, 5, 5, 0), dot=3),
    ],
)
def test_sheets_are_their_layers(spark, o):
    sheets = spark.createDataFrame([(7, 3, 4)], "image_id long, rows int, cols int")
    assert sorted(generate.templates(sheets, o).collect()) == sorted(_layered(spark, o, 3, 4).collect())


def test_sheets_are_neither_joined_nor_broadcast(spark):
    """Behind an explode Spark takes pixels for as few bytes as the table, and sent them all to the driver."""
    for name in ("r089_grid_template", "r090_digits"):
        plan = catalog.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "BroadcastExchange" not in plan
    sizes = spark.read.parquet(f"{DATA}/supplier.parquet").selectExpr("s_suppkey image_id", "64 width", "64 height")
    plan = geometry.fill(sizes, geometry.blanks(sizes.selectExpr("*", "1 r", "2 g", "3 b", "4 a")))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan


def test_canvases_of_one_small_file_are_many_tasks(spark):
    one = spark.read.parquet(f"{DATA}/supplier.parquet").selectExpr("s_suppkey image_id").coalesce(1)
    assert geometry.discs(one).rdd.getNumPartitions() == 4
    assert geometry.grid(one.selectExpr("image_id", "3 width", "2 height")).rdd.getNumPartitions() == 4
