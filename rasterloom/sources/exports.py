"""JSON descriptions of atlases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHEET = "struct<PaletteId:string,Cells:array<struct<Id:string,X:int,Y:int,Width:int,Height:int,PivotNdcX:double,PivotNdcY:double>>>"


def metadata_json(cells: DataFrame, palette_id: Column | None = None, pretty: bool = True) -> DataFrame:
    """(image_id, json): cells in order; no palette id where it is null."""
    entry = F.struct("ord", F.struct(F.col("id").alias("Id"), F.col("min_x").alias("X"), F.col("min_y").alias("Y"), (F.col("max_x") - F.col("min_x")).alias("Width"), (F.col("max_y") - F.col("min_y")).alias("Height"), F.col("pivot_x").alias("PivotNdcX"), F.col("pivot_y").alias("PivotNdcY")).alias("c"))
    g = cells.groupBy("image_id").agg(F.sort_array(F.collect_list(entry)).alias("c"))
    body = F.struct((palette_id if palette_id is not None else F.lit(None).cast("string")).alias("PaletteId"), F.transform("c", lambda x: x["c"]).alias("Cells"))
    return g.select("image_id", F.to_json(body, {"pretty": "true"} if pretty else {}).alias("json"))


def read_metadata(json: Column) -> Column:
    return F.from_json(json, SHEET)


def tiled_json(cells: DataFrame, map_cols: Column, map_rows: Column, tile_w: Column, tile_h: Column, image: str = "atlas.png", pretty: bool = False) -> DataFrame:
    """(image_id, json): a tile map of a tile layer 1..cols*rows, whatever the cells are, and a tile set with an object a cell.

    The sizes are columns of the cells, alike for all cells of an image.
    """
    obj = F.struct("ord", "min_x", "min_y", (F.col("max_x") - F.col("min_x")).alias("w"), (F.col("max_y") - F.col("min_y")).alias("h"))
    one = lambda c, n: F.first(c).cast("int").alias(n)
    g = cells.groupBy("image_id").agg(F.sort_array(F.collect_list(obj)).alias("c"), one(map_cols, "mc"), one(map_rows, "mr"), one(tile_w, "tw"), one(tile_h, "th"))
    n = F.size("c")
    lit, col = F.lit, F.col
    layer = F.struct(lit(1).alias("id"), lit("Tile Layer 1").alias("name"), lit("tilelayer").alias("type"), col("mc").alias("width"), col("mr").alias("height"), F.when(col("mc") * col("mr") > 0, F.sequence(lit(1), col("mc") * col("mr"))).otherwise(F.array().cast("array<int>")).alias("data"))
    tiles = F.transform("c", lambda x, i: F.struct(i.alias("id"), x["min_x"].alias("x"), x["min_y"].alias("y"), x["w"].alias("width"), x["h"].alias("height")))
    tileset = F.struct(lit(1).alias("firstgid"), lit("atlas").alias("name"), lit(image).alias("image"), (col("tw") * n).alias("imagewidth"), col("th").alias("imageheight"), col("tw").alias("tilewidth"), col("th").alias("tileheight"), n.alias("tilecount"), n.alias("columns"), tiles.alias("tiles"))
    root = F.struct(lit(-1).alias("compressionlevel"), col("mc").alias("width"), col("mr").alias("height"), col("tw").alias("tilewidth"), col("th").alias("tileheight"), lit("map").alias("type"), lit("1.10").alias("version"), lit("1.10.0").alias("tiledversion"), lit("orthogonal").alias("orientation"), F.array(layer).alias("layers"), F.array(tileset).alias("tilesets"))
    return g.select("image_id", F.to_json(root, {"pretty": "true"} if pretty else {}).alias("json"))


def tiled_export(cells: DataFrame, images: DataFrame) -> DataFrame:
    """``tiled_json`` with the tile size of the first cell, and as many map columns and rows as the image holds of it."""
    from rasterloom.functions.scalar import idiv
    from rasterloom.operators.cells import full_cells

    c = full_cells(images, cells)
    first = c.groupBy("image_id").agg(F.min_by(F.struct((F.col("max_x") - F.col("min_x")).alias("w"), (F.col("max_y") - F.col("min_y")).alias("h")), "ord").alias("t"))
    d = c.join(first, "image_id").join(images.select("image_id", "width", "height"), "image_id")
    tw, th = F.greatest(F.lit(1), F.col("t.w")), F.greatest(F.lit(1), F.col("t.h"))
    return tiled_json(d, F.greatest(F.lit(1), idiv(F.col("width"), tw)), F.greatest(F.lit(1), idiv(F.col("height"), th)), F.col("t.w"), F.col("t.h"))


def batch_report(files: DataFrame, elapsed_ms: Column) -> DataFrame:
    """(files, processed, failed, elapsed_ms) of rows with an error column."""
    return files.agg(F.count("*").cast("int").alias("files"), F.count_if(F.col("error").isNull()).cast("int").alias("processed"), F.count_if(F.col("error").isNotNull()).cast("int").alias("failed")).withColumn("elapsed_ms", elapsed_ms)
