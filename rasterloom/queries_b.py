"""Queries of geometry, generated tables, cells, layers, palettes, pipelines, time and exports."""

from __future__ import annotations

import functools
from dataclasses import replace

from pyspark.sql import functions as F

from rasterloom.functions import scalar
from rasterloom.operators import aggregate, cells, components, compose, generate, geometry, palette, pointwise, stencil, validate
from rasterloom.plans import pipelines
from rasterloom.queries_a import _edge, _flood, _gone, _majority, _scan, _sobel
from rasterloom.schema import images_of, recolour, to_raster
from rasterloom.shared import fresh_dir
from rasterloom.sources import exports, images, rasters, video
from rasterloom.sqltext import CELLS, IMG, NB, OUT, PV, PX, calibrated, dist, fold, lab, reach
from rasterloom.streaming import temporal

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def events(f, sql=None, name=None):
    g = lambda spark, sf_dir: f(rasters.px_events(spark, sf_dir))
    g.__name__ = name
    return query(sql)(g)


def vectors(f, sql=None, name=None):
    g = lambda spark, sf_dir: f(rasters.px_vectors(spark, sf_dir))
    g.__name__ = name
    return query(sql)(g)


def with_px(body: str, *more: str, px: str = PX) -> str:
    return "with recursive " + ",\n".join([px, *more]) + "\n" + body


def _spread(w: str, h: str, source: str = "img") -> str:
    """gr(image_id, x, y): the places of canvases."""
    return f"gr as (select image_id, xx x, yy y from (select image_id, w, unnest(range(0, h)) yy from (select image_id, {w} w, {h} h from {source})), unnest(range(0, w)) t(xx))"


_none = ", ".join(f"coalesce({c}, 0) {c}" for c in "rgba")

# ---- sources and counts of frames ------------------------------------------------------


@query("""
select cast(o_orderkey as bigint) k, case when o_orderkey % 3 = 0 then null else (10 + o_orderkey % 50)::double / 4 end duration, case when o_orderkey % 3 = 0 then null else 30000 / 1001.0::double end fps, cast(case when o_orderkey % 3 = 0 then null else 320 end as int) width, cast(case when o_orderkey % 3 = 0 then null else 200 end as int) height from orders
""")
def r004_video_metadata(spark, sf_dir):
    k = F.col("o_orderkey")
    text = F.concat(F.lit('{"format":{"duration":"'), ((10 + k % 50).cast("double") / 4).cast("string"), F.lit('"},"streams":[{"codec_type":"audio"}'), F.when(k % 3 == 0, F.lit("")).otherwise(F.lit(',{"codec_type":"video","width":320,"height":200,"r_frame_rate":"30000/1001"}')), F.lit("]}"))
    return rasters.table(spark, sf_dir, "orders").select(k.cast("long").alias("k"), video.metadata(text).alias("m")).select("k", "m.duration", "m.fps", "m.width", "m.height")


def _frames(spark, sf_dir):
    return rasters.table(spark, sf_dir, "events").select((F.col("event_id") % 10).alias("video_id"), F.call_function("div", F.col("event_id"), F.lit(10)).alias("n")).withColumn("t", F.col("n") / F.lit(24.0))


_FRAMES = "with f as (select event_id % 10 video_id, event_id // 10 n, (event_id // 10) / 24.0::double t from events)\n"


@query(_FRAMES + "select cast(video_id as bigint) video_id, cast(n as bigint) n from f where n % 3 = 0 and t >= 1 and t <= 30.5")
def r005_every_nth_frame(spark, sf_dir):
    return video.every_nth(_frames(spark, sf_dir), 2.6, 1.0, 30.5).select(F.col("video_id").cast("long").alias("video_id"), F.col("n").cast("long").alias("n"))


@query(_FRAMES + "select cast(video_id as bigint) video_id, min(n) n, cast(floor(t * 5) as bigint) slot from f group by video_id, slot")
def r005b_frames_at_rate(spark, sf_dir):
    return video.at_rate(_frames(spark, sf_dir), 5.0).select(F.col("video_id").cast("long").alias("video_id"), F.col("n").cast("long").alias("n"), "slot")


@query("select cast(o_orderkey as bigint) k, cast(ceil(greatest(0.0::double, least(o_custkey % 40 + 0.5::double, 30.0::double) - o_orderkey % 20) * 12.0::double) as int) n from orders")
def r006_frame_estimate(spark, sf_dir):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    return rasters.table(spark, sf_dir, "orders").select(o.cast("long").alias("k"), video.estimate(F.lit(30.0), (o % 20).cast("double"), c % 40 + F.lit(0.5), F.lit(12.0)).alias("n"))


def _grid_frames(spark, sf_dir):
    px = rasters.px_vectors(spark, sf_dir)
    return px.select(F.call_function("div", F.col("image_id"), F.lit(7)).alias("sheet_id"), (F.col("image_id") % 7).cast("int").alias("ord"), "x", "y", *"rgba")


#: Sheets of seven frames; the last one may have fewer, and is then narrower or lower.
_SHEETS = """sheets as (
  select image_id, n, cols, cast(ceil(n / cols) as int) rows, cols * 8 width, cast(ceil(n / cols) as int) * 8 height
  from (select image_id // 7 image_id, max(image_id % 7) + 1 n, cast(ceil(sqrt(max(image_id % 7) + 1)) as int) cols from px group by image_id // 7)
)"""


@query(with_px(f"select {OUT} from (select gr.image_id, gr.x, gr.y, {_none} from gr left join (select s.image_id, x + px.image_id % 7 % cols * 8 x, y + px.image_id % 7 // cols * 8 y, case when a = 0 then 0 else r end r, case when a = 0 then 0 else g end g, case when a = 0 then 0 else b end b, a from px join sheets s on s.image_id = px.image_id // 7) l using (image_id, x, y))", _SHEETS, _spread("width", "height", "sheets"), px=PV))
def r007_frames_to_grid(spark, sf_dir):
    return compose.frames_to_grid(_grid_frames(spark, sf_dir))[0]


@query(with_px("select cast(image_id as bigint) image_id, cast(o as int) ord, printf('frame_%03d', o) id, cast(o % cols * 8 as int) min_x, cast(o // cols * 8 as int) min_y, cast(o % cols * 8 + 8 as int) max_x, cast(o // cols * 8 + 8 as int) max_y from (select *, unnest(range(0, n)) o from sheets)", _SHEETS, px=PV))
def r007b_grid_cells(spark, sf_dir):
    return compose.frames_to_grid(_grid_frames(spark, sf_dir))[1]


@query("""select cast(c_custkey as bigint) image_id, cast(x as int) x, cast(y as int) y, cast(c_custkey % 256 as int) r, cast(c_nationkey * 10 as int) g, 3 b, 255 a
from (select *, unnest(range(0, c_custkey % 13)) x from customer), (select unnest(range(0, 25)) y) where y <= c_nationkey""")
def r009_blank_canvas(spark, sf_dir):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    sizes = rasters.table(spark, sf_dir, "customer").select(k.alias("image_id"), (k % 13).cast("int").alias("width"), (n + 1).cast("int").alias("height"), (k % 256).alias("r"), (n * 10).alias("g"), F.lit(3).alias("b"), F.lit(255).alias("a"))
    return geometry.blanks(sizes)


@query("""select cast(s_suppkey as bigint) image_id, cast(x as int) x, cast(y as int) y, cast(case when i then 200 else 26 end as int) r, cast(case when i then 80 else 26 end as int) g, cast(case when i then 255 else 34 end as int) b, 255 a
from supplier, (select x, y, x between 8 and 55 and y between 8 and 55 and (x - 32) * (x - 32) + (y - 32) * (y - 32) < 400 i from (select unnest(range(0, 64)) x), (select unnest(range(0, 64)) y))""")
def r010_disc(spark, sf_dir):
    return geometry.discs(rasters.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("image_id")))


@query("select cast(s.n_nationkey % 3 as bigint) sheet_id, cast(o as int) ord, 'r' || o // 3 || 'c' || o % 3 id, f.n_name as name from (select distinct n_nationkey % 3 n_nationkey from nation) s, (select unnest(range(0, 12)) o) left join (select n_nationkey % 3 k, n_name, row_number() over (partition by n_nationkey % 3 order by n_name) - 1 i from nation) f on f.k = s.n_nationkey and f.i = o")
def r003_placed_frames(spark, sf_dir):
    d = rasters.table(spark, sf_dir, "nation").select((F.col("n_nationkey") % 3).cast("long").alias("sheet_id"), F.col("n_name").alias("name"))
    return images.placed_frames(d, 4, 3)


def _imported(spark, sf_dir):
    """Sheets of nine frames for eight places; every fifth image is moved out of view, so that it is blank."""
    px = rasters.px_events(spark, sf_dir)
    px = recolour(px, F.col("image_id") % 5 == 3, a=F.lit(0))
    frames = to_raster(px).select(F.call_function("div", F.col("image_id"), F.lit(9)).alias("sheet_id"), F.format_string("f%04d", 9999 - F.col("image_id")).alias("name"), "width", "height", "rgba")
    return images.import_frames(frames, 2, 4, 13, 18, alpha=100)


_IMPORT = """fr as (select image_id, image_id // 9 sheet, row_number() over (partition by image_id // 9 order by printf('f%04d', 9999 - image_id)) - 1 o from (select distinct image_id from px)),
pl as (select px.* replace (case when image_id % 5 = 3 then 0 else a end as a) from px),
bx as (select image_id, min(x) filter (where a >= 100) x0, max(x) filter (where a >= 100) + 1 x1, min(y) filter (where a >= 100) y0, max(y) filter (where a >= 100) + 1 y1 from pl group by image_id),
layers as (
  select sheet image_id, x + coalesce(13 // 2 - (x0 + (x1 - x0) // 2), -1) + o % 4 * 13 x, y + coalesce(18 // 2 - (y0 + (y1 - y0) // 2), 1) + o // 4 * 18 y, o z, r, g, b, a
  from pl join fr using (image_id) join bx using (image_id) where o < 8
),
sheets as (select distinct sheet image_id, 52 width, 36 height from fr)"""


@query(with_px(f"select {OUT} from done", _IMPORT, fold(sizes="sheets")))
def r003b_import_frames(spark, sf_dir):
    return _imported(spark, sf_dir)[0]


@query(with_px("select cast(image_id as bigint) image_id, cast(o as int) ord, 'r' || o // 4 || 'c' || o % 4 id, cast(o % 4 * 13 as int) min_x, cast(o // 4 * 18 as int) min_y, cast(o % 4 * 13 + 13 as int) max_x, cast(o // 4 * 18 + 18 as int) max_y from (select distinct image_id // 9 image_id from px), (select unnest(range(0, 8)) o)"))
def r003c_import_cells(spark, sf_dir):
    return _imported(spark, sf_dir)[1].drop("pivot_x", "pivot_y")


# ---- files -----------------------------------------------------------------------------


def _written(spark, files, name):
    folder = fresh_dir(spark, name)
    images.write_files(files, folder)
    return folder


@query(with_px(f"select {OUT} from px"))
def r011_png_files(spark, sf_dir):
    """Every image written as a PNG file, the folder scanned, and the files read back."""
    files = images.encoded(rasters.px_events(spark, sf_dir)).select(F.format_string("%d.png", "image_id").alias("name"), "png")
    back = images.read_pngs(spark, _written(spark, files, "png")).withColumn("image_id", F.split("name", "[.]")[0].cast("long"))
    return images.to_px(back)


_LOCKED = [(0, 0, 0, 0), (200, 40, 0, 255), (0, 160, 100, 255), (128, 128, 200, 128)]


@query(with_px(f"""select {OUT} from (select image_id, x, y, pal.r r, pal.g g, pal.b b, pal.a a, row_number() over (partition by image_id, x, y order by (px.r - pal.r) ** 2 + (px.g - pal.g) ** 2 + (px.b - pal.b) ** 2 + (px.a - pal.a) ** 2, pal.i) k
from px, (select unnest(range(0, 4)) i, unnest([0, 200, 0, 128]) r, unnest([0, 40, 160, 128]) g, unnest([0, 0, 100, 200]) b, unnest([0, 255, 255, 128]) a) pal) where k = 1"""))
def r012_indexed_png_files(spark, sf_dir):
    """The same with a locked palette: each pixel comes back as its nearest entry."""
    files = images.encoded(rasters.px_events(spark, sf_dir), _LOCKED).select(F.format_string("%d.png", "image_id").alias("name"), "png")
    back = images.read_pngs(spark, _written(spark, files, "indexed")).withColumn("image_id", F.split("name", "[.]")[0].cast("long"))
    return images.to_px(back)


@query(with_px(f"select {OUT} from (select image_id, x, y, case when a = 0 then 0 else r end r, case when a = 0 then 0 else g end g, case when a = 0 then 0 else b end b, case when a = 0 then 0 else 255 end a from px)"))
def r013_automatic_palette_files(spark, sf_dir):
    """Opaque and transparent pixels of under 256 colours an image come back as they were from files with their own palette."""
    px = recolour(rasters.px_events(spark, sf_dir), F.col("a") != 0, a=255)
    back = images.decoded(images.encoded_auto(px, 255).select(F.format_string("%d.png", "image_id").alias("path"), F.col("png").alias("content")))
    return images.to_px(back.withColumn("image_id", F.split("path", "[.]")[0].cast("long")))


@query(with_px("select cast(image_id // 6 as bigint) sheet_id, cast(row_number() over (partition by image_id // 6 order by image_id) - 1 as int) ord, printf('f%d.png', image_id) as name, cast(256 as bigint) pixels from (select distinct image_id from px where image_id % 4 <> 2)"))
def r016_zip_of_frames(spark, sf_dir):
    """An archive a sheet, opened again; names that are blank are skipped, the ending is added where it lacks."""
    files = images.encoded(rasters.px_events(spark, sf_dir)).select(F.call_function("div", F.col("image_id"), F.lit(6)).alias("sheet_id"), F.col("image_id").alias("ord"), F.when(F.col("image_id") % 4 == 2, " ").when(F.col("image_id") % 4 == 1, F.format_string("f%d", "image_id")).otherwise(F.format_string("f%d.png", "image_id")).alias("name"), "png")
    entries = images.unzipped(images.zipped(files))
    shown = images.decoded(entries.select(F.concat_ws("/", "sheet_id", "ord", "name").alias("path"), "content"))
    at = F.split("path", "/")
    return shown.select(at[0].cast("long").alias("sheet_id"), at[1].cast("int").alias("ord"), "name", (F.col("width") * F.col("height")).cast("long").alias("pixels"))


# ---- names and documents ---------------------------------------------------------------


@query("""select cast(p_partkey as bigint) k, printf('%03d', cast(p_partkey as int)) || '_' || case when p_partkey % 5 = 0 then 'cell' else regexp_replace(p_name || '/:' || p_partkey % 5, '[<>:"/\\\\|?*]', '_', 'g') end || '.png' name, p_name || '_3x4.png' one from part""")
def r017_frame_names(spark, sf_dir):
    k = F.col("p_partkey")
    cell = F.when(k % 5 == 0, F.lit("  ")).otherwise(F.concat("p_name", F.lit("/:"), (k % 5).cast("string")))
    return rasters.table(spark, sf_dir, "part").select(k.cast("long").alias("k"), images.frame_name(k, cell).alias("name"), images.single_name(F.col("p_name"), F.lit(3), F.lit(4)).alias("one"))


_cell_json = "'{\"Id\":\"' || id || '\",\"X\":' || min_x || ',\"Y\":' || min_y || ',\"Width\":' || (max_x - min_x) || ',\"Height\":' || (max_y - min_y) || ',\"PivotNdcX\":0.5,\"PivotNdcY\":0.5}'"


@query(with_px(f"select image_id, '{{' || case when image_id % 2 = 0 then '\"PaletteId\":\"p\",' else '' end || '\"Cells\":[' || string_agg({_cell_json}, ',' order by ord) || ']}}' json from cells group by image_id", IMG, CELLS))
def r014_metadata_json(spark, sf_dir):
    c = rasters.cells(images_of(rasters.px_events(spark, sf_dir)))
    return exports.metadata_json(c, F.when(F.col("image_id") % 2 == 0, F.lit("p")), pretty=False)


@query(with_px("""select image_id, '{"compressionlevel":-1,"width":1,"height":1,"tilewidth":12,"tileheight":12,"type":"map","version":"1.10","tiledversion":"1.10.0","orientation":"orthogonal","layers":[{"id":1,"name":"Tile Layer 1","type":"tilelayer","width":1,"height":1,"data":[1]}],"tilesets":[{"firstgid":1,"name":"atlas","image":"atlas.png","imagewidth":48,"imageheight":12,"tilewidth":12,"tileheight":12,"tilecount":4,"columns":4,"tiles":[' || string_agg('{"id":' || ord || ',"x":' || min_x || ',"y":' || min_y || ',"width":12,"height":12}', ',' order by ord) || ']}]}' json from cells group by image_id""", IMG, CELLS))
def r019_tiled_export(spark, sf_dir):
    px = rasters.px_events(spark, sf_dir)
    return exports.tiled_export(rasters.cells(images_of(px)), images_of(px))


@query(with_px("select image_id, '{\"w\":2,\"data\":[1,2,3,4,5,6]}' json from img", IMG))
def r015_tiled_layer(spark, sf_dir):
    px = rasters.px_events(spark, sf_dir)
    j = exports.tiled_json(rasters.cells(images_of(px)), F.lit(2), F.lit(3), F.lit(8), F.lit(8))
    layer = F.from_json("json", "struct<layers:array<struct<width:int,data:array<int>>>>")["layers"][0]
    return j.select("image_id", F.to_json(F.struct(layer["width"].alias("w"), layer["data"].alias("data"))).alias("json"))


@query("select cast(count(*) as int) files, cast(count(*) filter (where o_orderkey % 9 <> 0) as int) processed, cast(count(*) filter (where o_orderkey % 9 = 0) as int) failed, cast(7 as bigint) elapsed_ms from orders")
def r020_batch_report(spark, sf_dir):
    d = rasters.table(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 9 == 0, F.lit("bad")).alias("error"))
    return exports.batch_report(d, F.lit(7).cast("long"))


# ---- geometry ----------------------------------------------------------------------------

events(lambda px: geometry.resize(px, 21, 9), with_px(f"select {OUT} from (select px.image_id, tx x, ty y, r, g, b, a from (select unnest(range(0, 21)) tx), (select unnest(range(0, 9)) ty), px where px.x = least(15, floor(tx * 16.0::double / 21)) and px.y = least(15, floor(ty * 16.0::double / 9)))"), "r077_resize")
events(lambda px: geometry.crop_fixed(px, 3, 2, 11, 15), with_px(f"select {OUT} from (select image_id, x - 3 x, y - 2 y, r, g, b, a from px where x >= 3 and x < 11 and y >= 2 and y < 15)"), "r078_crop")
_p2 = "case when {n} <= 1 then 1 when {n} <= 2 then 2 when {n} <= 4 then 4 when {n} <= 8 then 8 else 16 end"
_trim = "tb as (select image_id, min(x) filter (where a >= 200) x0, min(y) filter (where a >= 200) y0, max(x) filter (where a >= 200) + 1 x1, max(y) filter (where a >= 200) + 1 y1 from px group by image_id),\ntc as (select image_id, x0 is null e, coalesce(greatest(0, x0 - 1), 0) x0, coalesce(greatest(0, y0 - 1), 0) y0, coalesce(least(8, x1 + 1), 1) x1, coalesce(least(8, y1 + 1), 1) y1 from tb),\ntd as (select *, " + _p2.format(n="(x1 - x0)") + " fw, " + _p2.format(n="(y1 - y0)") + " fh from tc)"
vectors(lambda px: geometry.crop_pipeline(px, mode="trim_padded", alpha=200, padding=1, pot="axis")[1].drop("no_op"), with_px("select image_id, x0 min_x, y0 min_y, x1 max_x, y1 max_y, cast(fw as int) final_w, cast(fh as int) final_h, not e and (fw <> x1 - x0 or fh <> y1 - y0) pot_applied, case when e then 'crop no-op (nessun pixel α ≥ 200) → 1×1 trasparente' else 'trim α≥200 +pad 1px · box ' || (x1 - x0) || '×' || (y1 - y0) || case when fw <> x1 - x0 or fh <> y1 - y0 then ' · POT axis→' || fw || '×' || fh else '' end end description from td", _trim, px=PV), "r079_crop_report")
vectors(lambda px: geometry.crop_pipeline(px, mode="trim_padded", alpha=200, padding=1, pot="axis")[0], with_px(f"select {OUT} from (select gr.image_id, gr.x, gr.y, {_none} from gr left join (select px.image_id, x - x0 x, y - y0 y, r, g, b, a from px join td using (image_id) where not e and x >= x0 and x < x1 and y >= y0 and y < y1) l using (image_id, x, y))", _trim, _spread("fw", "fh", "td"), px=PV), "r079b_crop_pixels")
events(lambda px: geometry.pad(px, 1, -3, 2, 4), with_px(f"select {OUT} from (select gr.image_id, gr.x, gr.y, {_none} from gr left join (select image_id, x + 1 x, y, r, g, b, a from px) l using (image_id, x, y))", IMG, _spread("width + 3", "height + 4")), "r080_pad")
events(lambda px: geometry.pad_to_multiple(px, 10), with_px(f"select {OUT} from (select gr.image_id, gr.x, gr.y, {_none} from gr left join px using (image_id, x, y))", IMG, _spread("20", "20")), "r080b_pad_to_multiple")
events(lambda px: geometry.mirror(px), with_px(f"select {OUT} from (select t.image_id, t.x, t.y, s.r, s.g, s.b, s.a from px t join px s on s.image_id = t.image_id and s.y = t.y and s.x = case when t.x >= 8 then 15 - t.x else t.x end)"), "r081_mirror_horizontal")
events(lambda px: geometry.mirror(geometry.pad(px, 0, 0, 1, 1), True, False), with_px(f"select {OUT} from (select t.image_id, t.x, t.y, coalesce(s.r, 0) r, coalesce(s.g, 0) g, coalesce(s.b, 0) b, coalesce(s.a, 0) a from gr t left join px s on s.image_id = t.image_id and s.x = t.x and s.y = case when t.y < 8 then 16 - t.y else t.y end)", IMG, _spread("17", "17")), "r081b_mirror_vertical")
_bayer = "[0, 8, 2, 10, 12, 4, 14, 6, 3, 11, 1, 9, 15, 7, 13, 5]"
events(lambda px: geometry.seamless(px, 4), with_px(f"""select {OUT} from (select t.image_id, t.x, t.y, case when p then t.r else s.r end r, case when p then t.g else s.g end g, case when p then t.b else s.b end b, case when p then t.a else s.a end a
from (select *, greatest(0.0::float, 1.0::float - (abs(x - 8) / 4.0::float)::float, 1.0::float - (abs(y - 8) / 4.0::float)::float) > ({_bayer}[(y & 3) * 4 + (x & 3) + 1] / 16.0::float)::float p from px) t join px s on s.image_id = t.image_id and s.x = (t.x + 8) % 16 and s.y = (t.y + 8) % 16)"""), "r082_seamless")
events(lambda px: geometry.crop_to_grid(px, 4, 5, 1, 0, 1, 2), with_px(f"select {OUT} from (select image_id, x - 1 x, y - 2 y, r, g, b, a from px where x >= 1 and x < 15 and y >= 2 and y < 12)"), "r083_crop_to_grid")
events(lambda px: geometry.crop(px, rasters.cells(images_of(px)).where("ord = 3")), with_px(f"select {OUT} from (select image_id, x - 4 x, y - 4 y, r, g, b, a from px where x >= 4 and y >= 4)"), "r084_crop_selection")
vectors(geometry.tile_preview, with_px(f"select {OUT} from (select image_id, x + 8 * i x, y + 8 * j y, r, g, b, a from px, (select unnest(range(0, 3)) i), (select unnest(range(0, 3)) j))", px=PV), "r085_tile_preview")

# ---- generated tables ----------------------------------------------------------------------


def _sized(spark, sf_dir):
    """Images of various sizes, from the boxes."""
    return rasters.boxes(spark, sf_dir).select(F.col("ord").alias("image_id"), (F.col("w") * 5).alias("width"), (F.col("h") * 7).alias("height"))


_SIZED = "with img as (select cast(o_orderkey as bigint) image_id, cast((1 + o_orderkey % 31) * 5 as int) width, cast((1 + (o_orderkey // 7) % 23) * 7 as int) height from orders), "
_GRID = "g as (select image_id, unnest(range(0, rows)) r, rows, cols, cw, ch from s where rows > 0 and cols > 0 and cw > 0 and ch > 0), h as (select *, unnest(range(0, cols)) c from g)\nselect image_id, cast(r * cols + c as int) ord, 'r' || r || 'c' || c id, cast(c * (cw + {sx}) as int) min_x, cast(r * (ch + {sy}) as int) min_y, cast(c * (cw + {sx}) + cw as int) max_x, cast(r * (ch + {sy}) + ch as int) max_y from h"


@query(_SIZED + "s as (select image_id, 2 rows, 3 cols, width // 3 // 8 * 8 cw, height // 2 // 8 * 8 ch from img), " + _GRID.format(sx=0, sy=0))
def r086_slice_grid(spark, sf_dir):
    return generate.slice_grid(_sized(spark, sf_dir), 2, 3).drop("pivot_x", "pivot_y")


@query(_SIZED + "s as (select image_id, 2 rows, 2 cols, 10 cw, 10 ch from img), " + _GRID.format(sx=4, sy=6))
def r087_slice_exact(spark, sf_dir):
    return generate.slice_exact(_sized(spark, sf_dir), 2, 2, 10, 10, 4, 6).drop("pivot_x", "pivot_y")


@query(_SIZED + "s as (select image_id, (height + 2) // 42 rows, (width + 1) // 33 cols, 32 cw, 40 ch from img), " + _GRID.format(sx=1, sy=2))
def r088_slice_aligned(spark, sf_dir):
    return generate.slice_aligned(_sized(spark, sf_dir), 32, 40, 1, 2).drop("pivot_x", "pivot_y")


_TEMPLATE = generate.Template(rows=2, cols=6, cell_w=20, cell_h=16, pivot="BottomCenter", arm=4, show_tint=True)
_glyph = "['111101101101111', '010110010010111', '111001111100111', '111001011001111', '101101111001001', '111100111001111', '111100111101111', '111001001001001', '111101111101111', '111101111001111']"
_layers = f"""sh as (select cast(s_suppkey as bigint) image_id, 1 + s_suppkey % 3 m, 1 + s_nationkey % 6 cols from supplier), n as (select image_id, cols, unnest(range(0, m * cols)) n from sh), xy as (select image_id, cols, n, x, y from n, (select unnest(range(0, 20)) x), (select unnest(range(0, 16)) y)),
parts as (
  select image_id, cols, n, x, y, 0 z, case when (n % cols + n // cols) % 2 = 0 then {{'r': 255, 'g': 255, 'b': 255, 'a': 10}} else {{'r': 100, 'g': 80, 'b': 255, 'a': 10}} end c from xy
  union all select image_id, cols, n, x, y, z, {{'r': 60, 'g': 220, 'b': 255, 'a': 200}} from xy, (select unnest([1, 2, 3, 4]) z) where (z = 1 and y = 0) or (z = 2 and y = 15) or (z = 3 and x = 0) or (z = 4 and x = 19)
  union all select image_id, cols, n, x, y, 5, {{'r': 255, 'g': 210, 'b': 0, 'a': 80}} from xy where y = 15
  union all select image_id, cols, n, x, y, z, {{'r': 255, 'g': 210, 'b': 0, 'a': 230}} from xy, (select unnest([6, 7, 8]) z) where (z = 6 and y = 15 and abs(x - 10) <= 4) or (z = 7 and x = 10 and abs(y - 15) <= 4) or (z = 8 and (x - 10) * (x - 10) + (y - 15) * (y - 15) <= 4)
  union all select image_id, cols, n, 2 + (k - 1) * 4 + (i - 1) % 3, 2 + (i - 1) // 3, 9, {{'r': 255, 'g': 210, 'b': 0, 'a': 200}} from n, (select unnest(range(1, 3)) k), (select unnest(range(1, 16)) i) where k <= length(n::varchar) and {_glyph}[(n::varchar)[k]::int + 1][i] = '1'
),
layers as (select image_id, x + n % cols * 20 x, y + n // cols * 16 y, z, c.r r, c.g g, c.b b, c.a a from parts), img as (select image_id, cols * 20 width, m * 16 height from sh)"""


@query(f"with {_layers},\n{fold()}\nselect {OUT} from done")
def r089_grid_template(spark, sf_dir):
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    return generate.templates(rasters.table(spark, sf_dir, "supplier").select(k.alias("image_id"), (1 + k % 3).alias("rows"), (1 + n % 6).alias("cols")), _TEMPLATE)


@query(f"with n as (select s_suppkey, unnest(range(0, 3 * (1 + s_suppkey % 37))) n from supplier)\nselect cast(s_suppkey as bigint) image_id, cast(n as int) n, cast(sum(len(list_filter(string_split({_glyph}[(n::varchar)[k]::int + 1], ''), lambda v: v = '1'))) as int) dots from n, (select unnest(range(1, 4)) k) where k <= length(n::varchar) group by s_suppkey, n")
def r090_digits(spark, sf_dir):
    o = generate.Template(cell_w=14, cell_h=8, show_border=False, show_pivot=False, show_baseline=False)
    sheets = rasters.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("image_id"), (1 + F.col("s_suppkey") % 37).alias("rows"), F.lit(3).alias("cols"))
    n = F.call_function("div", F.col("y"), F.lit(8)) * 3 + F.call_function("div", F.col("x"), F.lit(14))
    return generate.templates(sheets, o).where("a > 0").groupBy("image_id", n.cast("int").alias("n")).agg(F.count("*").cast("int").alias("dots"))


# ---- cells ---------------------------------------------------------------------------------

_BX = "with boxes as (select cast(o_custkey % 50 as int) sheet, cast(o_orderkey as bigint) ord, cast(1 + o_orderkey % 31 as int) w, cast(1 + (o_orderkey // 7) % 23 as int) h from orders)\n"


@query(_BX + "select sheet, ord, cast(coalesce(sum(w) over (partition by sheet order by ord rows between unbounded preceding and 1 preceding), 0) as bigint) x, cast((max(h) over (partition by sheet) - h) // 2 as int) y, w, h, cast(sum(w) over (partition by sheet) as bigint) atlas_w, max(h) over (partition by sheet) atlas_h from boxes")
def r091_pack_row(spark, sf_dir):
    return cells.pack_row(rasters.boxes(spark, sf_dir))


_UNI = "select sheet, ord, cast((row_number() over (partition by sheet order by ord) - 1) * {w} as bigint) x, 0 y, cast({w} as int) w, cast({h} as int) h, cast(({w} - w) // 2 as int) dx, cast(({h} - h) // 2 as int) dy from boxes"


@query(_BX + _UNI.format(w="max(w) over (partition by sheet)", h="max(h) over (partition by sheet)"))
def r092_pack_uniform(spark, sf_dir):
    return cells.export_layout(rasters.boxes(spark, sf_dir), uniform=True)


@query(_BX + _UNI.format(w="40", h="33"))
def r093_export_layout(spark, sf_dir):
    return cells.export_layout(rasters.boxes(spark, sf_dir), custom=(40, 33))


def _with_cells(f):
    def g(spark, sf_dir):
        px = rasters.px_vectors(spark, sf_dir)
        return f(px, rasters.cells(images_of(px)))

    return g


def on_cells(f, sql, name):
    g = _with_cells(f)
    g.__name__ = name
    return query(sql)(g)


_IN = "inc as (select c.image_id, ord, id, min_x, min_y, max_x, max_y, width, height, px.x - min_x + {p} x, px.y - min_y + {p} y, r, g, b, a from cells c join px on px.image_id = c.image_id and px.x >= min_x - {p} and px.x < max_x + {p} and px.y >= min_y - {p} and px.y < max_y + {p})"
_OB = "ob as (select c.*, ox0, oy0, ox1, oy1, coalesce(ox0 + (ox1 - ox0) // 2, 0) ocx, coalesce(oy0 + (oy1 - oy0) // 2, 0) ocy from cells c left join (select image_id, ord, min(x) ox0, min(y) oy0, max(x) + 1 ox1, max(y) + 1 oy1 from inc where a >= {t} group by image_id, ord) using (image_id, ord))"


def _snap(ideal: str, lo: str, hi: str, o: str, g: int) -> str:
    """The nearest place of a range on a multiple, by trying all."""
    return f"(case when {lo} > {hi} or {hi} - {lo} < {g} then {ideal} else (select arg_min(d, abs(d - ({ideal})) * 1000 + d) from (select unnest(range({lo}, {hi} + 1)) d) where ((d + {o}) % {g} + {g}) % {g} = 0) end)"


on_cells(lambda px, c: cells.content_size(px, c, 200), with_px("select image_id, coalesce(max(ox1 - ox0), 0) w, coalesce(max(oy1 - oy0), 0) h from ob group by image_id", IMG, CELLS, _IN.format(p=0), _OB.format(t=200), px=PV), "r069_content_size")
on_cells(lambda px, c: cells.cell_boxes(px, c, 200).join(cells.content_size(px, c, 200), "image_id").select("image_id", "ord", cells.centre_offset(F.col("w"), F.col("o_min_x"), F.col("o_max_x")).alias("dx"), cells.centre_offset(F.col("h"), F.col("o_min_y"), F.col("o_max_y")).alias("dy")), with_px("select image_id, ord, cast(coalesce(trunc((max(ox1 - ox0) over w - (ox1 - ox0)) / 2.0) - ox0, 0) as int) dx, cast(coalesce(trunc((max(oy1 - oy0) over w - (oy1 - oy0)) / 2.0) - oy0, 0) as int) dy from ob window w as (partition by image_id)", IMG, CELLS, _IN.format(p=0), _OB.format(t=200), px=PV), "r098_centre_content")
_dest = "dst as (select *, (min_x + (max_x - min_x) // 2 - ocx) ix, (min_y + (max_y - min_y) // 2 - ocy) iy, min_x - ox0 lx, max_x - ox1 hx, min_y - oy0 ly, max_y - oy1 hy from ob where ox0 is not null)"
_lay = "layers as (select i.image_id, i.x + dx x, i.y + dy y, i.ord z, r, g, b, a from inc i join ({0}) d using (image_id, ord))"
on_cells(lambda px, c: cells.centre_in_cells(px, c, 200, 2), with_px(f"select {OUT} from done", IMG, CELLS, _IN.format(p=0), _OB.format(t=200), _dest, _lay.format(f"select image_id, ord, {_snap('ix', 'lx', 'hx', 'ox0', 2)} dx, {_snap('iy', 'ly', 'hy', 'oy0', 2)} dy from dst"), fold(), px=PV), "r094_centre_in_cells")


@query("""with v as (select o_orderkey k, cast(o_orderkey % 40 - 8 as int) ideal, cast(o_custkey % 6 as int) o0, cast(o_custkey % 6 + 1 + o_orderkey % 5 as int) o1, cast(o_custkey % 9 as int) c0, cast(o_custkey % 9 + 6 + o_orderkey % 30 as int) c1 from orders), w as (select *, c0 - o0 lo, c1 - o1 hi from v)
select cast(k as bigint) k, cast(""" + _snap("ideal", "lo", "hi", "o0", 8) + " as int) d from w")
def r095_snap_modulo(spark, sf_dir):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    i = lambda e: e.cast("int")
    return rasters.table(spark, sf_dir, "orders").select(o.cast("long").alias("k"), cells.snap_modulo(i(o % 40 - 8), i(c % 6), i(c % 6 + 1 + o % 5), i(c % 9), i(c % 9 + 6 + o % 30), 8).alias("d"))


_sn = "sn as (select *, least(greatest(min_x // 4 * 4, 0), width - (max_x - min_x)) sx, least(greatest(min_y // 4 * 4, 0), height - (max_y - min_y)) sy from cells)"
on_cells(lambda px, c: cells.snap_to_grid(px, c, 4)[0], with_px(f"select {OUT} from done", IMG, CELLS, _IN.format(p=0), _sn, _lay.format("select image_id, ord, sx dx, sy dy from sn"), fold(), px=PV), "r096b_snap_to_grid")
on_cells(lambda px, c: cells.snap_to_grid(px, c, 4)[1], with_px("select image_id, ord, id, cast(sx as int) min_x, cast(sy as int) min_y, cast(sx + max_x - min_x as int) max_x, cast(sy + max_y - min_y as int) max_y from sn", IMG, CELLS, _sn, px=PV), "r096c_snapped_cells")
_low = "lw as (select c.image_id, c.ord, l.low, ord * 6 + 0 dx, case when low is null then 0 else 5 - low end dy from cells c left join (select image_id, ord, max(y) low from inc where a > 128 group by image_id, ord) l using (image_id, ord))"
on_cells(lambda px, c: cells.align_baseline(px, c, "max", 128)[0], with_px(f"select {OUT} from done", IMG, CELLS, _IN.format(p=0), _low, _lay.format("select image_id, ord, dx, dy from lw"), "rowa as (select image_id, 24 width, 6 height from img)", fold(sizes="rowa"), px=PV), "r097_align_baseline")
on_cells(lambda px, c: cells.align_baseline(px, c, "median", 128)[1], with_px("select image_id, ord, id, cast(ord * 6 as int) min_x, 0 min_y, cast(ord * 6 + 6 as int) max_x, 6 max_y from cells", IMG, CELLS, px=PV), "r097b_baseline_cells")
_off = "off_ as (select image_id, ord, case when ox0 is null then 0 else (max_x - min_x) // 2 - ocx + 1 end off_x, case when oy0 is null then 0 else {y} end off_y from ob)"
_offc = _off.format(y="(max_y - min_y) // 2 - ocy + 1")
_offb = _off.format(y="max_y - min_y - 1 - (oy1 - 1) + 1")
_lay1 = "layers as (select i.image_id, i.x + min_x + off_x - 1 x, i.y + min_y + off_y - 1 y, i.ord z, r, g, b, a from inc i join off_ using (image_id, ord))"
on_cells(lambda px, c: cells.frame_offsets(px, c, 1, 200, "centre", 0), with_px("select image_id, ord, cast(off_x as int) off_x, cast(off_y as int) off_y from off_", IMG, CELLS, _IN.format(p=1), _OB.format(t=200), _offc, px=PV), "r099_frame_centre")
on_cells(lambda px, c: cells.frame_offsets(px, c, 1, 200, "baseline"), with_px("select image_id, ord, cast(off_x as int) off_x, cast(off_y as int) off_y from off_", IMG, CELLS, _IN.format(p=1), _OB.format(t=200), _offb, px=PV), "r099a_frame_baseline")
on_cells(lambda px, c: cells.compose_frames(px, c, cells.frame_offsets(px, c, 1, 200, "centre", 0), 1), with_px(f"select {OUT} from done", IMG, CELLS, _IN.format(p=1), _OB.format(t=200), _offc, _lay1, fold(), px=PV), "r099e_compose_frames")
_cm = "cm as (select o.image_id, o.ord, id, min_x, min_y, max_x, max_y, ox0, greatest(0, least(8, min_x + off_x - 1 + ox0)) a0, greatest(0, least(8, min_y + off_y - 1 + oy0)) b0, greatest(0, least(8, min_x + off_x - 1 + ox1)) a1, greatest(0, least(8, min_y + off_y - 1 + oy1)) b1 from ob o join off_ using (image_id, ord))"
_keep = "ox0 is null or a0 >= a1 or b0 >= b1"
on_cells(lambda px, c: cells.commit_boxes(px, c, cells.frame_offsets(px, c, 1, 200, "centre", 0), 1, 200), with_px(f"select image_id, ord, id, cast(case when {_keep} then min_x else a0 end as int) min_x, cast(case when {_keep} then min_y else b0 end as int) min_y, cast(case when {_keep} then max_x else a1 end as int) max_x, cast(case when {_keep} then max_y else b1 end as int) max_y from cm", IMG, CELLS, _IN.format(p=1), _OB.format(t=200), _offc, _cm, px=PV), "r099b_commit_cells")
on_cells(lambda px, c: cells.centre_in_atlas(px, c, 1, 200), with_px("select image_id, ord, cast(case when ox0 is null then 0 else 4 - (min_x + ocx - 1) end as int) off_x, cast(case when ox0 is null then 0 else 4 - (min_y + ocy - 1) end as int) off_y from ob", IMG, CELLS, _IN.format(p=1), _OB.format(t=200), px=PV), "r099c_centre_in_atlas")


@query("""with v as (select o_orderkey k, cast(o_orderkey % 40 as int) x, cast(o_custkey % 40 as int) y from orders)
select cast(k as bigint) k, case when abs(x - 20) <= 6 then 20 else x end x, case when abs(y - 15) <= 6 and abs(y - 15) <= abs(y - 24) then 15 when abs(y - 24) <= 6 then 24 else y end y from v""")
def r099d_drag_snap(spark, sf_dir):
    o, c = (F.col("o_orderkey") % 40).cast("int"), (F.col("o_custkey") % 40).cast("int")
    return rasters.table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("k"), cells.drag_snap(o, c, F.lit(20), F.lit(15), F.lit(24), 6).alias("s")).select("k", "s.x", "s.y")


def _points(px):
    return px.select("image_id", (F.col("y") * 8 + F.col("x")).cast("long").alias("point_id"), (F.col("x") + 0.5).cast("double").alias("wx"), (F.col("y") * F.lit(1.1)).alias("wy"))


_hit = """pts as (select image_id, cast(y * 8 + x as bigint) point_id, x + 0.5::double wx, y * 1.1::double wy from px)
select p.image_id, point_id, min(ord) ord, 'k' || min(ord) id from pts p left join cells c on c.image_id = p.image_id and wx >= min_x and wx < max_x and wy >= min_y and wy < max_y group by p.image_id, point_id"""
on_cells(lambda px, c: cells.hit_test(_points(px), c), "with " + ",\n".join([PV, IMG, CELLS, _hit]), "r112_hit_test")
_snapl = """vs as (select image_id, cast(y * 8 + x as bigint) value_id, x * 1.3::double v from px), ls as (select distinct image_id, unnest([min_x, max_x]) l from cells),
bs as (select vs.image_id, value_id, v, arg_min(l, abs(v - l) * 1000 + l / 100.0) l from vs left join ls on ls.image_id = vs.image_id and abs(v - l) <= 0.75 group by all)
select image_id, value_id, coalesce(l::double, round_even(v / 3.0::double, 0) * 3.0::double) snapped from bs"""
on_cells(lambda px, c: cells.snap_to_lines(px.select("image_id", (F.col("y") * 8 + F.col("x")).cast("long").alias("value_id"), (F.col("x") * F.lit(1.3)).alias("v")), c.select("image_id", F.col("min_x").alias("v")).union(c.select("image_id", "max_x")), 0.75, 3.0), "with " + ",\n".join([PV, IMG, CELLS, _snapl]), "r113_snap_to_lines")


@query("""with v as (select o_orderkey k, cast(o_orderkey % 20 as int) x0, cast(o_custkey % 12 as int) y0, cast(1 + o_orderkey % 9 as int) w, cast(1 + o_custkey % 7 as int) h, (o_orderkey % 31) - 15.5::double dx, (o_custkey % 23) - 11.25::double dy from orders),
m as (select *, least(greatest(x0 + cast(round_even(dx, 0) as int), 0), 32 - w) mx, least(greatest(y0 + cast(round_even(dy, 0) as int), 0), 24 - h) my from v)
select cast(k as bigint) k, mx, my, cast(mx + w as int) ex, cast(my + h as int) ey from m""")
def r114_move_selection(spark, sf_dir):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    i = lambda e: e.cast("int")
    b = scalar.box(i(o % 20), i(c % 12), i(o % 20) + 1 + i(o % 9), i(c % 12) + 1 + i(c % 7))
    m = cells.move_selection(b, o % 31 - F.lit(15.5), c % 23 - F.lit(11.25), F.lit(32), F.lit(24))
    return rasters.table(spark, sf_dir, "orders").select(o.cast("long").alias("k"), m.alias("m")).select("k", F.col("m.min_x").alias("mx"), F.col("m.min_y").alias("my"), F.col("m.max_x").alias("ex"), F.col("m.max_y").alias("ey"))


@query("""with v as (select o_orderkey k, o_custkey % 40 - 4.5::double wx, o_orderkey % 30 - 3.25::double wy from orders),
c as (select k, cast(greatest(0, floor(least(wx, 12))) as int) x0, cast(greatest(0, floor(least(wy, 9))) as int) y0, cast(least(32, ceil(greatest(wx, 12))) as int) x1, cast(least(24, ceil(greatest(wy, 9))) as int) y1 from v)
select cast(k as bigint) k, case when x1 <= x0 or y1 <= y0 then 0 else x0 end min_x, case when x1 <= x0 or y1 <= y0 then 0 else y0 end min_y, case when x1 <= x0 or y1 <= y0 then 0 else x1 end max_x, case when x1 <= x0 or y1 <= y0 then 0 else y1 end max_y from c""")
def r114b_resize_selection(spark, sf_dir):
    b = scalar.box(*map(F.lit, (4, 3, 12, 9)))
    m = cells.resize_selection(b, "nw", F.col("o_custkey") % 40 - F.lit(4.5), F.col("o_orderkey") % 30 - F.lit(3.25), F.lit(32), F.lit(24))
    return rasters.table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("k"), m.alias("m")).select("k", "m.*")


# ---- layers --------------------------------------------------------------------------------

_two = "layers as (select image_id, x, y, 0 z, r, g, b, a from px union all select image_id, (x + 3) x, (y + 1) y, 1, g, b, r, a // 2 from px union all select image_id, 15 - x, y, 2, b, r, g, a from px)"
events(lambda px: compose.on_canvas(px.select("*", F.lit(0).alias("z")).unionByName(px.select("image_id", (F.col("x") + 3).alias("x"), (F.col("y") + 1).alias("y"), F.col("g").alias("r"), F.col("b").alias("g"), F.col("r").alias("b"), scalar.idiv(F.col("a"), 2).alias("a"), F.lit(1).alias("z"))).unionByName(px.select("image_id", (15 - F.col("x")).alias("x"), "y", F.col("b").alias("r"), F.col("r").alias("g"), F.col("g").alias("b"), "a", F.lit(2).alias("z"))), images_of(px)), with_px(f"select {OUT} from done", IMG, _two, fold()), "r100_compose")
_paste = "layers as (select image_id, x, y, 0 z, r, g, b, a from px union all select image_id, tx + 5, ty + 4, 1, r, g, b, a from (select px.*, tx, ty from (select unnest(range(0, 8)) tx), (select unnest(range(0, 8)) ty), px where px.x = floor(tx * 16.0::double / 8) and px.y = floor(ty * 16.0::double / 8)))"
_base = "{'r': 0, 'g': 0, 'b': 0, 'a': 0}"


def _draw_sql(top: str, base: str = "px") -> str:
    from rasterloom.sqltext import blend_sql

    return f"select {OUT} from (select image_id, x, y, c.r r, c.g g, c.b b, c.a a from (select d.image_id, d.x, d.y, case when t.a is null then {{'r': d.r::int, 'g': d.g::int, 'b': d.b::int, 'a': d.a::int}} else {blend_sql('t', 'd')} end c from {base} d left join ({top}) t using (image_id, x, y)))"


events(lambda px: compose.commit_paste(px, px, 5, 4, 16, 16, 0.5), with_px(_draw_sql("select px.image_id, tx + 5 x, ty + 4 y, r, g, b, a from (select unnest(range(0, 8)) tx), (select unnest(range(0, 8)) ty), px where px.x = tx * 2 and px.y = ty * 2")), "r101_commit_paste")
events(lambda px: compose.paste_into_cell(px, px.where("x < 6 and y < 4"), (3, 2, 13, 9), 6, 4), with_px(_draw_sql("select image_id, x + 5 x, y + 3 y, r, g, b, a from px where x < 6 and y < 4", "(select image_id, x, y, " + ", ".join(f"case when x >= 3 and x < 13 and y >= 2 and y < 9 then 0 else {c} end {c}" for c in "rgba") + " from px)")), "r102_cell_paste")


@query(with_px("select distinct r, g, b from px", px=PV))
def r103_palette_union(spark, sf_dir):
    px = rasters.px_vectors(spark, sf_dir)
    return palette.union(px.where("x < 5"), px.where("x > 2"))


on_cells(lambda px, c: cells.hit_test(_points(px).withColumn("wx", F.col("wx") - 0.5), c), "with " + ",\n".join([PV, IMG, CELLS, _hit.replace("x + 0.5::double wx", "x::double wx")]), "r104_cell_click")

# ---- palettes ------------------------------------------------------------------------------


_NAMES = [*palette.PRESETS, "pico8"]


@query(f"select cast(p_partkey as bigint) p_partkey, palette_id, cast(idx as int) idx, cast(('0x' || c[1:2])::int as int) r, cast(('0x' || c[3:4])::int as int) g, cast(('0x' || c[5:6])::int as int) b, 255 a from (select p_partkey, {_NAMES}[p_partkey % {len(_NAMES)} + 1] palette_id from part) join (values " + ", ".join(f"('{n}', {i}, '{c}')" for n, cs in palette.PRESETS.items() for i, c in enumerate(cs)) + ") t(palette_id, idx, c) using (palette_id)")
def r073_palette_presets(spark, sf_dir):
    names = F.array(*map(F.lit, _NAMES))
    return palette.named(rasters.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("p_partkey"), F.get(names, (F.col("p_partkey") % len(_NAMES)).cast("int")).alias("preset")), "preset", "p_partkey")


_pal = "pal as (select i, r pr, g pg, b pb, {0} l from (values (0, 15, 56, 15), (1, 48, 98, 48), (2, 139, 172, 15), (3, 155, 188, 15)) t(i, r, g, b))".format(lab("r", "g", "b"))
_mapped = f"mp as (select r, g, b, arg_min({{'r': pr, 'g': pg, 'b': pb}}, {dist('c', 'l')}::double * 1e6 + i * 1e-9) m from (select r, g, b, {lab('r', 'g', 'b')} c from (select distinct r, g, b from px)), pal group by r, g, b)"


def _gameboy(spark):
    return spark.createDataFrame([(i, *c) for i, c in enumerate(palette.preset_colours("GameBoyDMG"))], "idx int, r int, g int, b int")


_map_sql = with_px(f"select {OUT} from (select image_id, x, y, case when a = 0 then px.r else m.r end r, case when a = 0 then px.g else m.g end g, case when a = 0 then px.b else m.b end b, a from px join mp using (r, g, b))", _pal, _mapped, px=PV)


@query(_map_sql)
def r071_map_to_palette(spark, sf_dir):
    return palette.map_to_palette(rasters.px_vectors(spark, sf_dir), _gameboy(spark))


@query(_map_sql)
def r076_reduce_to_preset(spark, sf_dir):
    return palette.reduce(rasters.px_vectors(spark, sf_dir), preset="GameBoyDMG")


def _dither_sql() -> str:
    """Pixel by pixel over 8x8 images; ``e`` holds the errors of the last nine pixels, the oldest first."""
    none = "{'l': 0::float, 'a': 0::float, 'b': 0::float}"
    colours = ", ".join(f"({i}, {r}, {g}, {b})" for i, (r, g, b) in enumerate(palette.preset_colours("Pico8")))
    from_ = lambda n, c: f"e[{n}].{c}"
    sum_of = lambda c: f"(o.l.{c} + (case when o.x > 0 then {from_(1, c)} else 0::float end) * 0.0625::float + {from_(2, c)} * 0.3125::float + (case when o.x < 7 then {from_(3, c)} else 0::float end) * 0.1875::float + (case when o.x > 0 then {from_(9, c)} else 0::float end) * 0.4375::float)::float"
    less = lambda c: f"(v.{c} - p.l.{c})::float"
    return f"""with recursive {PV},
pal as (select list({{'i': i, 'r': r, 'g': g, 'b': b, 'l': l}} order by i) ps from (select *, {lab("r", "g", "b")} l from (values {colours}) t(i, r, g, b))),
own as (select image_id, x, y, y * 8 + x k, a, {lab("r", "g", "b")} l from px),
walk as (
  select distinct image_id, -1 k, 0 x, 0 y, 0 r, 0 g, 0 b, 0 a, [{", ".join([none] * 9)}] e from px
  union all
  select image_id, k, x, y, case when a = 0 then 0 else p.r end, case when a = 0 then 0 else p.g end, case when a = 0 then 0 else p.b end, a,
    list_append(e[2:9], case when a = 0 then {none} else {{'l': {less("l")}, 'a': {less("a")}, 'b': {less("b")}}} end)
  from (select *, ps[list_min(list_transform(ps, lambda c: {{'d': {dist("c.l", "v")}, 'i': c.i}})).i + 1] p
        from (select o.image_id, o.k, o.x, o.y, o.a, e, ps, {{'l': {sum_of("l")}, 'a': {sum_of("a")}, 'b': {sum_of("b")}}} v
              from walk join own o on o.image_id = walk.image_id and o.k = walk.k + 1, pal))
)
select {OUT} from walk where k >= 0"""


@query(_dither_sql())
def r072_dither(spark, sf_dir):
    return palette.dither_to_palette(rasters.px_vectors(spark, sf_dir), palette.preset_colours("Pico8"))


@query()
def r059_extract_wu(spark, sf_dir):
    return palette.extract(rasters.px_vectors(spark, sf_dir), 8)


@query()
def r059b_extract_octree(spark, sf_dir):
    return palette.extract(rasters.px_vectors(spark, sf_dir), 8, "octree")


@query()
def r074_shared_palette(spark, sf_dir):
    return palette.shared_palette(rasters.px_events(spark, sf_dir), 16)


@query()
def r075_quantize(spark, sf_dir):
    px = rasters.px_vectors(spark, sf_dir)
    own = components.kept(palette.extract(px, 6))  # read twice
    key = palette.background_colour(own, (0, 255, 0)).select("image_id", F.struct("r", "g", "b").alias("key"))
    return palette.map_to_palette(px, own, by="image_id").join(key, "image_id").select("image_id", "x", "y", *"rgba", F.col("key.r").alias("key_r"), F.col("key.g").alias("key_g"), F.col("key.b").alias("key_b"))


# ---- checks and pipelines ------------------------------------------------------------------

events(lambda px: validate.validate(px, validate.Rules(max_colours=20, power_of_two=True, binary_alpha=True, background=(64, 80, 100), background_tolerance=100, max_mismatch=0.5)).select("image_id", "unique", "valid", F.array_join("issues", ",").alias("issues"), F.array_join("severities", ",").alias("severities")), with_px("""select image_id, cast(u as int) "unique", not (u > 20 or soft or off_ > 0.5) valid, concat_ws(',', case when u > 20 then 'MAX_UNIQUE_COLORS' end, case when soft then 'ALPHA_NOT_BINARY' end, case when off_ > 0.5 then 'BACKGROUND_MISMATCH' end) issues, concat_ws(',', case when u > 20 then 'Warning' end, case when soft then 'Error' end, case when off_ > 0.5 then 'Warning' end) severities
from (select image_id, count(distinct (r, g, b, a)) filter (where a <> 0) u, bool_or(a not in (0, 255)) soft, count(*) filter (where a <> 0 and (r - 64) * (r - 64) + (g - 80) * (g - 80) + (b - 100) * (b - 100) > 10000) / count(*) filter (where a <> 0)::double off_ from px group by image_id)"""), "r111_validate")

_snapped = "s1 as (select image_id, x, y, " + ", ".join(f"case when a <> 0 and (r - 64) * (r - 64) + (g - 80) * (g - 80) + (b - 100) * (b - 100) <= 324 then {k} else {c} end {c}" for c, k in zip("rgb", (64, 80, 100), strict=True)) + ", a from px)"
_maj1 = NB.replace("nb as", "nb1 as").replace("from px p", "from s1 p").replace("px n", "s1 n")
_maj2 = """mj as (select image_id, x, y, arg_max({'r': nr, 'g': ng, 'b': nb, 'a': na}, n * 100 - i) m, max(n8) n8, coalesce(sum(case when nr = r and ng = g and nb = b and na = a then n end), 0) same
from (select *, sum(n) over (partition by image_id, x, y) n8 from (select image_id, x, y, r, g, b, a, nr, ng, nb, na, count(*) n, min(i) i from nb1 group by all)) group by image_id, x, y),
s2 as (select s1.image_id, s1.x, s1.y, """ + ", ".join(f"case when n8 = 8 and same < 2 then m.{c} else {c} end {c}" for c in "rgba") + " from s1 left join mj using (image_id, x, y))"
_isl = reach("a >= 1", True).replace("select px.image_id", "select s2.image_id").replace("from px join img", "from s2 join img")
_fin = "fin as (select s2.image_id, s2.x, s2.y, " + ", ".join(f"case when n < 3 then 0 else {c} end {c}" for c in "rgb") + ", case when n < 3 then 0 when a > 144 then 255 else 0 end a from s2 left join (select *, count(*) over (partition by image_id, root) n from lab) l on l.image_id = s2.image_id and l.x = s2.x and l.y = s2.y)"
_AGGRESSIVE = pipelines.Options(background_snap=True, background=(64, 80, 100), tolerance=18, quantize=False, majority=True, island_area=3, alpha=144)
events(lambda px: pipelines.run(px, _AGGRESSIVE).px, with_px(f"select {OUT} from fin", IMG, _snapped, _maj1, _maj2, _isl, _fin), "r105_pipeline_aggressive")
events(lambda px: pipelines.run(px, _AGGRESSIVE).report().select("image_id", "unique_before", "unique_after", F.array_join("steps", " -> ").alias("steps")), with_px("select image_id, cast(u as int) unique_before, cast(v as int) unique_after, 'background snap (tol 18) -> majority denoise -> island denoise (min 3) -> alpha 144' steps from (select image_id, count(distinct (r, g, b, a)) filter (where a <> 0) u from px group by image_id) join (select image_id, count(distinct (r, g, b, a)) filter (where a <> 0) v from fin group by image_id) using (image_id)", IMG, _snapped, _maj1, _maj2, _isl, _fin), "r107_pipeline_report")


@query()
def r105b_pipeline_default(spark, sf_dir):
    return pipelines.run(rasters.px_events(spark, sf_dir)).report()


class _Stages:
    """SQL of a pipeline over px, a stage after the other, each under names of its own."""

    def __init__(self, name: str):
        self.name, self.ctes, self.last = name, [], "px"

    def then(self, body: str) -> None:
        self.last = f"{self.name}_{len(self.ctes)}"
        self.ctes.append(f"{self.last} as ({body})")

    def _near(self) -> str:
        src = self.last
        self.ctes.append(NB.replace("nb as", f"{src}_nb as", 1).replace("from px p", f"from {src} p").replace("px n", f"{src} n"))
        return f"{src}_nb"

    def isolate(self, steps: int, edge: str) -> None:
        src, nb = self.last, self._near()
        self.ctes.append(_sobel.replace("sob as", f"{src}_sob as", 1).replace("from nb)", f"from {nb})"))
        apart = f"{dist('c', 'k')}::double <= {calibrated('64', '80', '100', steps)}"
        self.ctes.append(f"{src}_pass as (select image_id, x, y, a, (a = 0 or (not edge and {apart})) p from (select {src}.*, {lab('r', 'g', 'b')} c, {lab('64', '80', '100')} k, {_edge.format(t=edge)} edge from {src} left join {src}_sob using (image_id, x, y)))")
        self.ctes.append(_flood.replace("flood", f"{src}_flood").replace("pass", f"{src}_pass"))
        self.then(f"select s.image_id, s.x, s.y, {_gone('f.x is not null and a <> 0')} from {src} s left join {src}_flood f on f.image_id = s.image_id and f.x = s.x and f.y = s.y")

    def snap(self, reach_: int) -> None:
        near = f"a <> 0 and (r - 64) * (r - 64) + (g - 80) * (g - 80) + (b - 100) * (b - 100) <= {reach_}"
        self.then("select image_id, x, y, " + ", ".join(f"case when {near} then {k} else {c} end {c}" for c, k in zip("rgb", (64, 80, 100), strict=True)) + f", a from {self.last}")

    def majority(self) -> None:
        src, nb = self.last, self._near()
        self.ctes.append(_majority.replace("maj as", f"{src}_maj as", 1).replace("from nb group", f"from {nb} group").replace("nb.nb nb", "nb"))
        self.then(f"select {src}.image_id, x, y, " + ", ".join(f"case when n8 = 8 and same < 2 then m.{c} else {c} end {c}" for c in "rgba") + f" from {src} left join {src}_maj using (image_id, x, y)")

    def defringe(self) -> None:
        src, nb = self.last, self._near()
        sums = f"select image_id, x, y, count(*) n, sum(nr) sr, sum(ng) sg, sum(nb) sb from {nb} where na >= 250 group by image_id, x, y"
        self.then(f"select {src}.image_id, x, y, " + ", ".join(f"case when n is not null and a > 0 and a < 250 then s{c} // n else {c} end {c}" for c in "rgb") + f", a from {src} left join ({sums}) using (image_id, x, y)")

    def alpha(self, least: int) -> None:
        self.then(f"select image_id, x, y, r, g, b, case when a > {least} then 255 else 0 end a from {self.last}")

    def median(self) -> None:
        places = "(select unnest([-1, 0, 1, -1, 0, 1, -1, 0, 1]) dx, unnest([-1, -1, -1, 0, 0, 0, 1, 1, 1]) dy) o"
        mid = ", ".join(f"list_sort(list(n.{c}))[5] {c}" for c in "rgba")
        self.then(f"select p.image_id, p.x, p.y, {mid} from {self.last} p, {places}, {self.last} n where n.image_id = p.image_id and n.x = least(greatest(p.x + dx, 0), 15) and n.y = least(greatest(p.y + dy, 0), 15) group by p.image_id, p.x, p.y")

    def islands(self, least: int) -> None:
        src = self.last
        found = reach("a >= 1", True).replace("px", src)
        for cte in ("m", "walk", "lab"):
            found = found.replace(f"{cte} as (", f"{src}_{cte} as (").replace(f"from {cte} ", f"from {src}_{cte} ").replace(f"join {cte} ", f"join {src}_{cte} ").replace(f"from {cte}\n", f"from {src}_{cte}\n")
        self.ctes.append(found)
        self.then(f"select s.image_id, s.x, s.y, {_gone(f'n < {least}')} from {src} s left join (select *, count(*) over (partition by image_id, root) n from {src}_lab) l on l.image_id = s.image_id and l.x = s.x and l.y = s.y")


def _cleanup_sql() -> str:
    s = _Stages("c")
    s.isolate(40, "57600.0")
    s.defringe()
    s.alpha(128)
    s.median()
    s.islands(4)
    return with_px(f"select {OUT} from {s.last}", IMG, *s.ctes)


@query(_cleanup_sql())
def r106_cleanup(spark, sf_dir):
    return pipelines.clean(rasters.px_events(spark, sf_dir), pipelines.Cleanup(key=(64, 80, 100))).px


def _presets_sql() -> str:
    default, safe, aggressive = _Stages("d"), _Stages("s"), _Stages("g")
    default.islands(2)
    default.alpha(128)
    safe.isolate(6, "1296.0")
    safe.majority()
    safe.islands(2)
    safe.alpha(112)
    aggressive.snap(324)
    aggressive.majority()
    aggressive.islands(3)
    aggressive.alpha(144)
    each = " union all ".join(f"select '{n}' preset, {OUT} from {s.last}" for n, s in (("Default", default), ("Safe", safe), ("Aggressive", aggressive)))
    return with_px(each, IMG, *default.ctes, *safe.ctes, *aggressive.ctes)


@query(_presets_sql())
def r108_option_presets(spark, sf_dir):
    px = rasters.px_events(spark, sf_dir)
    parts = [pipelines.run(px, replace(o, background=(64, 80, 100))).px.select(F.lit(n).alias("preset"), "image_id", "x", "y", *"rgba") for n, o in pipelines.PRESETS.items()]
    return functools.reduce(lambda a, b: a.unionByName(b), parts)


def _interactive_sql() -> str:
    """Keys by image, their tolerances, what lets through, what is reached, and alpha where an image lost pixels."""
    moved = lambda c, m: f"greatest(0, least(255, {c} + {m}))"
    key = f"""key as (
  select image_id, case when d <= 3072 then c.r else 70 end kr, case when d <= 3072 then c.g else 90 end kg, case when d <= 3072 then c.b else 90 end kb
  from (select image_id, min(d) d, arg_min({{'r': r, 'g': g, 'b': b}}, d::bigint * 10000000 + s) c from (select *, (r - 70) * (r - 70) + (g - 90) * (g - 90) + (b - 90) * (b - 90) d, {_scan} s from px where a <> 0 and least(x, y, 15 - x, 15 - y) < 3) group by image_id)
  union all
  select image_id, 70, 90, 90 from px group by image_id having count(*) filter (where a <> 0 and least(x, y, 15 - x, 15 - y) < 3) = 0
)"""
    near = f"""near as (
  select kr, kg, kb, any_value(k) k, max({dist('k', 'm')}) reach
  from (select kr, kg, kb, {lab("kr", "kg", "kb")} k, {lab(moved("kr", "mr"), moved("kg", "mg"), moved("kb", "mb"))} m
        from (select distinct kr, kg, kb from key), (select unnest([30, -30, 0, 0, 0, 0, 30, -30]) mr, unnest([0, 0, 30, -30, 0, 0, 30, -30]) mg, unnest([0, 0, 0, 0, 30, -30, 30, -30]) mb))
  group by kr, kg, kb
)"""
    lets = f"pass as (select image_id, x, y, r, g, b, a, (a = 0 or (not edge and {dist('c', 'k')}::double <= reach::double)) p from (select px.*, {lab('r', 'g', 'b')} c, k, reach, {_edge.format(t='57600.0')} edge from px join key using (image_id) join near using (kr, kg, kb) left join sob using (image_id, x, y)))"
    gone = "gone as (select px.image_id, px.x, px.y from px join flood f on f.image_id = px.image_id and f.x = px.x and f.y = px.y where a <> 0)"
    out = ", ".join(f"case when q.x is not null then 0 else {c} end {c}" for c in "rgb") + ", case when q.x is not null then 0 when px.image_id in (select image_id from gone) then (case when a > 128 then 255 else 0 end) else a end a"
    return with_px(f"select {OUT} from (select px.image_id, px.x, px.y, {out} from px left join gone q on q.image_id = px.image_id and q.x = px.x and q.y = px.y)", NB, _sobel, key, near, lets, _flood, gone)


@query(_interactive_sql())
def r110_interactive_background(spark, sf_dir):
    return pipelines.remove_background(rasters.px_events(spark, sf_dir), (70, 90, 90), 30, 240, 128)


# ---- time ------------------------------------------------------------------------------------

_TICKS = """with t as (select cast(user_id as bigint) body_id, cast(event_id as bigint) ord, cast(event_id % 4 as double) / 16 dt, case when event_id % 7 < 4 then 'Walk' else 'run' end clip from events),
u as (select *, case when clip = lag(clip) over (partition by body_id order by ord) then 0 else 1 end nw from t),
v as (select *, sum(nw) over (partition by body_id order by ord) rn from u),
w as (select *, sum(dt) over (partition by body_id, rn order by ord rows unbounded preceding) elapsed from v)
"""


@query(_TICKS + "select body_id, ord, clip, elapsed, cast(case when lower(clip) = 'walk' then cast(floor(elapsed / 0.125::double) as bigint) % 4 else cast(floor(elapsed / 0.125::double) as bigint) % 3 end as int) frame, cast(case when lower(clip) = 'walk' then [0, 1, 2, 3][cast(floor(elapsed / 0.125::double) as bigint) % 4 + 1] else [7, 8, 9][cast(floor(elapsed / 0.125::double) as bigint) % 3 + 1] end as int) frame_id from w")
def r115_animation(spark, sf_dir):
    clips = spark.createDataFrame([("walk", 4.0, [0, 1, 2, 3]), ("Run", 10.0, [7, 8, 9])], "name string, fps double, frames array<int>")
    return temporal.animate(rasters.ticks(spark, sf_dir), clips, 8.0)


@query("select cast(event_id as bigint) t, cast(event_id % 5 as int) lo, cast(case when event_id % 8 < 5 then event_id % 8 else 8 - event_id % 8 end as int) pp, cast(least(event_id, 4) as int) once from events")
def r116_preview_modes(spark, sf_dir):
    t, n = F.col("event_id").cast("long"), F.lit(5)
    return rasters.table(spark, sf_dir, "events").select(t.alias("t"), temporal.loop(t, n).alias("lo"), temporal.ping_pong(t, n).alias("pp"), temporal.once(t, n).alias("once"))


_MOTION = """with recursive t as (
  select cast(user_id as bigint) body_id, row_number() over (partition by user_id order by event_id) k, cast(event_id % 4 as double) / 16 dt,
    case event_type when 'click' then 1.0::double when 'view' then -1.0::double else 0.0::double end ix, case event_type when 'signup' then 1.0::double when 'error' then -1.0::double else 0.0::double end iy from events
), s as (
  select distinct body_id, cast(0 as bigint) k, 0.0::double px, 0.0::double py, 0.0::double vx, 0.0::double vy from t
  union all
  select body_id, k, case when dt <= 0 then px else px + wx * cap * dt end, case when dt <= 0 then py else py + wy * cap * dt end, case when dt <= 0 then vx else wx * cap end, case when dt <= 0 then vy else wy * cap end
  from (select *, case when sqrt(wx * wx + wy * wy) > 280.0::double then 280.0::double / sqrt(wx * wx + wy * wy) else 1.0::double end cap
        from (select s.body_id, t.k, dt, px, py, vx, vy, case when ix <> 0 or iy <> 0 then vx + ix / sqrt(ix * ix + iy * iy) * 1200.0::double * dt else vx * (1.0::double - 0.12::double) end wx, case when ix <> 0 or iy <> 0 then vy + iy / sqrt(ix * ix + iy * iy) * 1200.0::double * dt else vy * (1.0::double - 0.12::double) end wy
              from s join t on t.body_id = s.body_id and t.k = s.k + 1))
)
"""


@query(_MOTION + "select body_id, cast(floor(px * 100 + 0.5) as bigint) px, cast(floor(py * 100 + 0.5) as bigint) py, cast(floor(vx * 100 + 0.5) as bigint) vx, cast(floor(vy * 100 + 0.5) as bigint) vy from s where k = (select max(k) from t where t.body_id = s.body_id)")
def r117_motion(spark, sf_dir):
    d = temporal.integrate(rasters.ticks(spark, sf_dir))
    return d.select("body_id", *[F.floor(F.col(c) * 100 + 0.5).cast("long").alias(c) for c in ("px", "py", "vx", "vy")])


_WORLD = ((20, 360, 80, 400), (-90, 300, -40, 400))


def _world_sql() -> str:
    """The ticks of ``_MOTION``, of 1/60 s each, in a world: moved, boxed, lifted off the ground, pushed by each obstacle in turn."""
    ticks = _MOTION[: _MOTION.index(", s as (")]
    dt = "(1.0::double / 60.0::double)"
    d = f"select body_id, k, px + wx * cap * {dt} px, py + wy * cap * {dt} py, wx * cap vx, wy * cap vy from (select *, case when sqrt(wx * wx + wy * wy) > 280.0::double then 280.0::double / sqrt(wx * wx + wy * wy) else 1.0::double end cap from (select s.body_id, t.k, px, py, " + ", ".join(f"case when ix <> 0 or iy <> 0 then v{c} + i{c} / sqrt(ix * ix + iy * iy) * 1200.0::double * {dt} else v{c} * (1.0::double - 0.12::double) end w{c}" for c in "xy") + " from s join t on t.body_id = s.body_id and t.k = s.k + 1))"
    d = f"select *, floor(px - 16.0::double) x0, floor(py - 48.0::double) y0, floor(px - 16.0::double + 32.0::double) x1, floor(py) y1 from ({d})"
    d = f"select * replace (case when y1 > 400 then py - (y1 - 400) else py end as py) from ({d})"
    for a, b, c, e in _WORLD:
        d = f"select *, least(x1, {c}) - greatest(x0, {a}) wide, least(y1, {e}) - greatest(y0, {b}) tall from ({d})"
        px = f"case when wide > 0 and tall > 0 and wide < tall then (case when px < {(a + c) / 2}::double then px - wide else px + wide end) else px end as px"
        py = f"case when wide > 0 and tall > 0 and wide >= tall then (case when py < {(b + e) / 2}::double then py - tall else py + tall end) else py end as py"
        d = f"select * exclude (wide, tall) replace ({px}, {py}) from ({d})"
    return f"{ticks}, s as (select distinct body_id, cast(0 as bigint) k, 0.0::double px, 0.0::double py, 0.0::double vx, 0.0::double vy from t union all select body_id, k, px, py, vx, vy from ({d}))\nselect body_id, px, py, vx, vy from s where k = (select max(k) from t where t.body_id = s.body_id)"


@query(_world_sql())
def r118_world_ticks(spark, sf_dir):
    return temporal.world_ticks(rasters.ticks(spark, sf_dir), temporal.World(400, _WORLD))


__all__ = ["QUERIES", "SQL", "aggregate", "components", "pointwise", "stencil"]
