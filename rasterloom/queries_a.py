"""Queries of colours, pixels, neighbourhoods, components and aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterloom.functions import color, scalar
from rasterloom.operators import aggregate, components, pointwise, stencil
from rasterloom.schema import images_of, packed
from rasterloom.sources import rasters
from rasterloom.sqltext import IMG, NB, OUT, PV, PX, calibrated, dist, lab, reach

QUERIES, SQL = {}, {}
KEY, TOL = (64, 80, 100), 40


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def events(f, sql=None, name=None):
    """A query over the events raster."""
    g = lambda spark, sf_dir: f(rasters.px_events(spark, sf_dir))
    g.__name__ = name
    return query(sql)(g)


def vectors(f, sql=None, name=None):
    g = lambda spark, sf_dir: f(rasters.px_vectors(spark, sf_dir))
    g.__name__ = name
    return query(sql)(g)


def with_px(body: str, *more: str, px: str = PX) -> str:
    return "with recursive " + ",\n".join([px, *more]) + "\n" + body


# ---- colours -------------------------------------------------------------------

_kinds = "kinds as (select distinct r, g, b from px)"
_rgb = lambda px: px.select("r", "g", "b").distinct()


def _oklab():
    return color.oklab(F.col("r"), F.col("g"), F.col("b"))


vectors(lambda px: _rgb(px).select("r", "g", "b", _oklab().alias("c")).select("r", "g", "b", F.col("c.l").alias("lab_l"), F.col("c.a").alias("lab_a"), F.col("c.b").alias("lab_b")), with_px(f"select r, g, b, c.l lab_l, c.a lab_a, c.b lab_b from (select r, g, b, {lab('r', 'g', 'b')} c from kinds)", _kinds, px=PV), "r023_oklab")
vectors(lambda px: _rgb(px).select("r", "g", "b", color.oklab_to_rgb(_oklab()).alias("c")).select("r", "g", "b", *[F.col(f"c.{k}").alias(f"back_{k}") for k in "rgb"]), with_px("select r, g, b, r back_r, g back_g, b back_b from kinds", _kinds, px=PV), "r024_oklab_round_trip")
vectors(lambda px: _rgb(px).select("r", "g", "b", *[color.linear_to_srgb(color.srgb_to_linear(F.col(c))).alias(f"back_{c}") for c in "rgb"]), with_px("select r, g, b, r back_r, g back_g, b back_b from kinds", _kinds, px=PV), "r021_srgb_round_trip")
vectors(lambda px: _rgb(px).select("r", "g", "b", color.lab_distance_sq(_oklab(), color.oklab(F.lit(KEY[0]), F.lit(KEY[1]), F.lit(KEY[2]))).alias("d2")), with_px(f"select r, g, b, {dist('c', 'k')} d2 from (select r, g, b, {lab('r', 'g', 'b')} c, {lab('64', '80', '100')} k from kinds)", _kinds, px=PV), "r025_lab_distance")
vectors(lambda px: _rgb(px).select("r", "g", "b", F.floor(color.luma(F.col("r"), F.col("g"), F.col("b")) * 100 + 0.5).cast("int").alias("luma100"), color.rgb_distance_sq((F.col("r"), F.col("g"), F.col("b")), KEY).alias("d2")), with_px("select r, g, b, cast(floor((0.299::double * r + 0.587::double * g + 0.114::double * b) * 100 + 0.5) as int) luma100, cast((r - 64) * (r - 64) + (g - 80) * (g - 80) + (b - 100) * (b - 100) as int) d2 from kinds", _kinds, px=PV), "r027_luma_and_rgb_distance")
events(lambda px: _rgb(px).select("r", "g", "b", color.calibrated_column(F.col("r"), F.col("g"), F.col("b"), 20).alias("tol2")), with_px(f"select r, g, b, {calibrated('r', 'g', 'b', 20)} tol2 from kinds", _kinds), "r029_calibrated_tolerance")


@query("""
with t as (select p_partkey, trim(p_name || '') s, case p_partkey % 4 when 0 then '#' || lpad(to_hex(p_partkey * 7919 % 16777216), 6, '0') when 1 then ' ' || lower(lpad(to_hex(p_partkey * 104729 % 16777216), 6, '0')) when 2 then '#12345' else 'not-a-color' end h from part),
u as (select p_partkey, h, regexp_extract(trim(h), '^#?([0-9A-Fa-f]{6})$', 1) d from t)
select cast(p_partkey as bigint) k, case when d <> '' then '#' || upper(d) else '#00FF00' end norm,
  cast(case when d <> '' then ('0x' || d[1:2])::int else 1 end as int) r, cast(case when d <> '' then ('0x' || d[3:4])::int else 2 end as int) g, cast(case when d <> '' then ('0x' || d[5:6])::int else 3 end as int) b
from u
""")
def r030_parse_hex(spark, sf_dir):
    k = F.col("p_partkey")
    hexed = lambda m: F.lpad(F.hex(k * m % 16777216), 6, "0")
    h = F.when(k % 4 == 0, F.concat(F.lit("#"), hexed(7919))).when(k % 4 == 1, F.concat(F.lit(" "), F.lower(hexed(104729)))).when(k % 4 == 2, F.lit("#12345")).otherwise(F.lit("not-a-color"))
    d = rasters.table(spark, sf_dir, "part").select(k.cast("long").alias("k"), h.alias("h"))
    return d.select("k", color.normalise_hex(F.col("h"), "#00FF00").alias("norm"), color.parse_hex(F.col("h"), (1, 2, 3)).alias("c")).select("k", "norm", "c.r", "c.g", "c.b")


@query("""
select cast(o_orderkey as bigint) k, coalesce(try_cast(trim(case o_orderkey % 3 when 0 then ' ' || o_custkey when 1 then '' else 'x' || o_custkey end) as int), -1) v,
  case when o_orderkey % 2 = 0 then cast(o_custkey as int) end flagged
from orders
""")
def r031_option_parsing(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    text = F.when(k % 3 == 0, F.concat(F.lit(" "), c)).when(k % 3 == 1, F.lit("")).otherwise(F.concat(F.lit("x"), c))
    args = F.when(k % 2 == 0, F.array(F.lit("in"), F.lit("--PALETTE"), c)).otherwise(F.array(F.lit("in"), c, F.lit("--palette")))
    return rasters.table(spark, sf_dir, "orders").select(k.cast("long").alias("k"), scalar.parse_int(text, -1).alias("v"), scalar.flag_int(args, "--palette").alias("flagged"))


@query("""
select cast(n as bigint) n, cast(case when n <= 1 then 1 else (select min(p) from (select unnest([1,2,4,8,16,32,64,128,256,512,1024,2048,4096,8192,16384,32768,65536,131072,262144,524288,1048576]) p) where p >= n) end as int) up,
  n in (1,2,4,8,16,32,64,128,256,512,1024,2048,4096,8192,16384,32768,65536,131072) pow2, cast((n + 7) // 8 * 8 as int) by8
from (select o_orderkey % 3000 n, count(*) from orders group by 1)
""")
def r032_sizing(spark, sf_dir):
    n = F.col("n").cast("int")
    d = rasters.table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 3000).cast("long").alias("n")).distinct()
    return d.select("n", scalar.next_pow2(n).alias("up"), scalar.is_pow2(n).alias("pow2"), scalar.ceil_to_multiple(n, 8).alias("by8"))


@query("""
with b as (select o_orderkey k, (o_orderkey % 37) - 5.25::double x0, (o_custkey % 29) - 3.5::double y0, (o_custkey % 41) + 0.75::double x1, (o_orderkey % 23) + 0.25::double y1 from orders),
c as (select k, cast(greatest(0, least(32, floor(least(x0, x1)))) as int) ax, cast(greatest(0, least(32, ceil(greatest(x0, x1)))) as int) bx, cast(greatest(0, least(24, floor(least(y0, y1)))) as int) ay, cast(greatest(0, least(24, ceil(greatest(y0, y1)))) as int) by_ from b)
select cast(k as bigint) k, case when bx <= ax or by_ <= ay then 0 else ax end min_x, case when bx <= ax or by_ <= ay then 0 else ay end min_y, case when bx <= ax or by_ <= ay then 0 else bx end max_x, case when bx <= ax or by_ <= ay then 0 else by_ end max_y,
  not (bx <= ax or by_ <= ay) and ax < 20 and bx > 10 and ay < 20 and by_ > 10 hits from c
""")
def r033_boxes(spark, sf_dir):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    b = scalar.from_corners(o % 37 - F.lit(5.25), c % 29 - F.lit(3.5), c % 41 + F.lit(0.75), o % 23 + F.lit(0.25), F.lit(32), F.lit(24))
    d = rasters.table(spark, sf_dir, "orders").select(o.cast("long").alias("k"), b.alias("b"))
    return d.select("k", "b.*", scalar.intersects(F.col("b"), scalar.box(*map(F.lit, (10, 10, 20, 20)))).alias("hits"))


@query("""
with v as (select o_orderkey k, (o_orderkey % 16 + 1) / 4.0::double zoom, (o_custkey % 100)::double pan, (o_custkey % 64)::double w from orders)
select cast(k as bigint) k, w * zoom + pan s, (w * zoom + pan - pan) / zoom back, least(greatest(zoom * 2, 0.05::double), 64.0::double) zoom2, 10 - (10 - pan) / zoom * least(greatest(zoom * 2, 0.05::double), 64.0::double) pan2 from v
""")
def r034_viewport(spark, sf_dir):
    zoom, pan, w = (F.col("o_orderkey") % 16 + 1) / F.lit(4.0), (F.col("o_custkey") % 100).cast("double"), (F.col("o_custkey") % 64).cast("double")
    s = scalar.world_to_screen(w, zoom, pan)
    z = scalar.zoom_at(F.lit(10), zoom, pan, F.lit(2))
    return rasters.table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("k"), s.alias("s"), scalar.screen_to_world(s, zoom, pan).alias("back"), z["zoom"].alias("zoom2"), z["pan"].alias("pan2"))


@query("""
with b as (select o_orderkey k, cast(1 + o_orderkey % 31 as int) w, cast(1 + (o_orderkey // 7) % 23 as int) h from orders),
s as (select *, case when w > 16 or h > 12 then least(16 / w::double, 12 / h::double) else 1.0::double end sc from b),
t as (select *, cast(greatest(1, floor(w * sc)) as int) sw, cast(greatest(1, floor(h * sc)) as int) sh from s)
select cast(k as bigint) k, sw, sh, cast((16 - sw) // 2 as int) x, cast((12 - sh) // 2 as int) y from t
""")
def r035_paste_geometry(spark, sf_dir):
    d = rasters.boxes(spark, sf_dir)
    s = scalar.fit_scale(F.col("w"), F.col("h"), F.lit(16), F.lit(12))
    d = d.select(F.col("ord").alias("k"), scalar.shown_size(F.col("w"), s).alias("sw"), scalar.shown_size(F.col("h"), s).alias("sh"))
    return d.select("k", "sw", "sh", scalar.centred(F.lit(16), F.col("sw")).alias("x"), scalar.centred(F.lit(12), F.col("sh")).alias("y"))


@query("""
select cast(o_orderkey as bigint) k, case o_orderkey % 4 when 0 then 0.0::double when 1 then 1.0::double else 0.5::double end x, case o_orderkey % 4 when 0 then 0.0::double when 1 then 0.5::double when 2 then 1.0::double else 0.5::double end y from orders
""")
def r036_pivot(spark, sf_dir):
    k = F.col("o_orderkey")
    name = F.when(k % 4 == 0, F.lit("TopLeft")).when(k % 4 == 1, F.lit("MiddleRight")).when(k % 4 == 2, F.lit("BottomCenter")).otherwise(F.lit("Custom"))
    return rasters.table(spark, sf_dir, "orders").select(k.cast("long").alias("k"), scalar.pivot(name).alias("p")).select("k", "p.x", "p.y")


# ---- one pixel at a time ---------------------------------------------------------

_match = f"{dist('c', 'k')}::double <= {calibrated('64', '80', '100', TOL)}"
_near = "(r - 64) * (r - 64) + (g - 80) * (g - 80) + (b - 100) * (b - 100)"
_gone = lambda cond: ", ".join(f"case when {cond} then 0 else {c} end {c}" for c in "rgba")


def _cleared(cond: str, source: str = "px") -> str:
    return f"select {OUT} from (select image_id, x, y, {_gone(cond)} from {source})"


events(lambda px: pointwise.chroma_key(px, KEY, TOL), with_px(_cleared(f"a <> 0 and {_match}", f"(select *, {lab('r', 'g', 'b')} c, {lab('64', '80', '100')} k from px)")), "r038_chroma_key")
events(lambda px: pointwise.snap_background(px, KEY, 60), with_px(f"select {OUT} from (select image_id, x, y, " + ", ".join(f"case when a <> 0 and {_near} <= 3600 then {k} else {c} end {c}" for c, k in zip("rgb", KEY, strict=True)) + ", a from px)"), "r039_snap_background")
events(lambda px: pointwise.alpha_threshold(px, 128), with_px(f"select {OUT} from (select image_id, x, y, r, g, b, case when a > 128 then 255 else 0 end a from px)"), "r040_alpha_threshold")
_undone = lambda c, k: f"case when a > 0 and a < 255 then cast(least(greatest(round_even((({c}::float - (1.0::float - (a / 255.0::float)::float) * {k}.0::float) / (a / 255.0::float)::float)::float::double, 0), 0), 255) as int) else {c} end {c}"
events(lambda px: pointwise.remove_bleed(px, (0, 255, 0)), with_px(f"select {OUT} from (select image_id, x, y, {_undone('r', 0)}, {_undone('g', 255)}, {_undone('b', 0)}, a from px)"), "r041_remove_bleed")
events(lambda px: pointwise.clear_rect(px, 3, -2, 5, 9), with_px(_cleared("x >= 3 and x < 8 and y >= -2 and y < 7")), "r042_clear_rect")
events(lambda px: pointwise.remove_selection(px, 2, 2, 20, 5), with_px(_cleared("x >= 2 and x < 20 and y >= 2 and y < 5")), "r043_remove_selection")


@query(with_px(f"""select {OUT} from (select image_id, x, y, r, g, b, case when exists (select 1 from s where s.image_id = px.image_id and px.x >= s.ox and px.x < s.ox + s.size and px.y >= s.oy and px.y < s.oy + s.size) then 0 else a end a from px)""",
    "s as (select image_id, floor(k * 5.3::double)::int - (size - 1) // 2 ox, floor(k * 3.7::double)::int - (size - 1) // 2 oy, size from (select image_id, unnest([0, 1, 2]) k, unnest([1, 2, 4]) size from (select distinct image_id from px)))"))
def r044_eraser(spark, sf_dir):
    px = rasters.px_events(spark, sf_dir)
    k = F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.lit(s).alias("size")) for i, s in enumerate((1, 2, 4))]))
    strokes = px.select("image_id").distinct().withColumn("s", k).select("image_id", (F.col("s.k") * 5.3).alias("wx"), (F.col("s.k") * 3.7).alias("wy"), "s.size")
    return pointwise.erase_strokes(px, strokes)


events(lambda px: pointwise.restore(px, 4, 4, 6, (9, 8, 7)), with_px(f"select {OUT} from (select image_id, x, y, " + ", ".join(f"case when a = 0 and x >= 4 and x < 10 and y >= 4 and y < 10 then {v} else {c} end {c}" for c, v in zip("rgba", (9, 8, 7, 255), strict=True)) + " from px)"), "r045_restore_pencil")
events(lambda px: pointwise.changed(px, pointwise.restore(px, 4, 4, 6, (9, 8, 7))), with_px("select image_id, count(*) filter (where a = 0 and x >= 4 and x < 10 and y >= 4 and y < 10) changed from px group by image_id"), "r045b_restore_count")

# ---- neighbourhoods ----------------------------------------------------------------

events(lambda px: stencil.defringe(px, 250), with_px(f"select {OUT} from (select px.image_id, x, y, " + ", ".join(f"case when n is not null and a > 0 and a < 250 then s{c} // n else {c} end {c}" for c in "rgb") + ", a from px left join (select image_id, x, y, count(*) n, sum(nr) sr, sum(ng) sg, sum(nb) sb from nb where na >= 250 group by image_id, x, y) m using (image_id, x, y))", NB), "r046_defringe")
_alike = f"select distinct image_id, x, y from (select image_id, x, y, r, g, b, na, {lab('r', 'g', 'b')} c, {lab('nr', 'ng', 'nb')} n from nb where na <> 0) join tol using (r, g, b) where {dist('c', 'n')} <= tol2"
events(lambda px: stencil.remove_outliers(px, 20), with_px(f"select {OUT} from (select px.image_id, px.x, px.y, {_gone('a <> 0 and k.x is null')} from px left join ({_alike}) k on k.image_id = px.image_id and k.x = px.x and k.y = px.y)", NB, _kinds, f"tol as (select r, g, b, {calibrated('r', 'g', 'b', 20)} tol2 from kinds)"), "r047_remove_outliers")
_median = ", ".join(f"list_sort(list(n.{c}))[5] {c}" for c in "rgba")
vectors(lambda px: stencil.median(px), with_px(f"""select {OUT} from (select p.image_id, p.x, p.y, {_median} from px p, (select unnest([-1, 0, 1, -1, 0, 1, -1, 0, 1]) dx, unnest([-1, -1, -1, 0, 0, 0, 1, 1, 1]) dy) o, px n
  where n.image_id = p.image_id and n.x = least(greatest(p.x + dx, 0), 7) and n.y = least(greatest(p.y + dy, 0), 7) group by p.image_id, p.x, p.y)""", px=PV), "r048_median")
_majority = """maj as (
  select image_id, x, y, arg_max({'r': nr, 'g': ng, 'b': nb, 'a': na}, n * 100 - i) m, max(n8) n8, coalesce(sum(case when nr = r and ng = g and nb = b and na = a then n end), 0) same
  from (select *, sum(n) over (partition by image_id, x, y) n8 from (select image_id, x, y, r, g, b, a, nr, ng, nb.nb nb, na, count(*) n, min(i) i from nb group by all)) group by image_id, x, y
)"""
events(lambda px: stencil.majority_denoise(px, 2), with_px(f"select {OUT} from (select px.image_id, px.x, px.y, " + ", ".join(f"case when n8 = 8 and same < 2 then m.{c} else {c} end {c}" for c in "rgba") + " from px left join maj using (image_id, x, y))", NB, _majority), "r049_majority_denoise")
_erode = lambda src: f"select image_id, x, y, {_gone('a <> 0 and z')} from (select {src}.*, exists (select 1 from {src} n where n.image_id = {src}.image_id and abs(n.x - {src}.x) <= 1 and abs(n.y - {src}.y) <= 1 and n.a = 0) z from {src})"


def _dilate(src: str) -> str:
    mode = f"select p.image_id, p.x, p.y, n.r nr, n.g ng, n.b nb, count(*) n, min((n.y - p.y) * 3 + n.x - p.x) i from {src} p join {src} n on n.image_id = p.image_id and abs(n.x - p.x) <= 1 and abs(n.y - p.y) <= 1 and n.a <> 0 where p.a = 0 group by all"
    best = f"select image_id, x, y, arg_max({{'r': nr, 'g': ng, 'b': nb}}, n * 100 - i) m from ({mode}) group by image_id, x, y"
    return f"select {src}.image_id, {src}.x, {src}.y, " + ", ".join(f"coalesce(q.m.{c}, {src}.{c}) {c}" for c in "rgb") + f", case when q.m is null then {src}.a else 255 end a from {src} left join ({best}) q using (image_id, x, y)"


vectors(lambda px: stencil.erode(px), with_px(f"select {OUT} from ({_erode('px')})", px=PV), "r050_erode")
vectors(lambda px: stencil.dilate(px), with_px(f"select {OUT} from ({_dilate('px')})", px=PV), "r051_dilate")
vectors(lambda px: stencil.opened(px), with_px(f"select {OUT} from ({_dilate('e')})", f"e as ({_erode('px')})", px=PV), "r052_open")
vectors(lambda px: stencil.closed(px), with_px(f"select {OUT} from ({_erode('e')})", f"e as ({_dilate('px')})", px=PV), "r052b_close")
events(lambda px: stencil.outline(px, (1, 2, 3, 255)), with_px(f"select {OUT} from (select image_id, x, y, " + ", ".join(f"case when a = 0 and z then {v} else {c} end {c}" for c, v in zip("rgba", (1, 2, 3, 255), strict=True)) + " from (select px.*, exists (select 1 from px n where n.image_id = px.image_id and abs(n.x - px.x) + abs(n.y - px.y) = 1 and n.a > 0) z from px))"), "r053_outline")
_luma = "case when {a} = 0 then 0.0::float else (0.299::double * {r} + 0.587::double * {g} + 0.114::double * {b})::float end"
_sobel = """sob as (
  select image_id, x, y, count(*) n8,
    (-max(l) filter (where i = 0) + max(l) filter (where i = 2) - 2.0::float * max(l) filter (where i = 3) + 2.0::float * max(l) filter (where i = 4) - max(l) filter (where i = 5) + max(l) filter (where i = 7))::float gx,
    (max(l) filter (where i = 0) + 2.0::float * max(l) filter (where i = 1) + max(l) filter (where i = 2) - max(l) filter (where i = 5) - 2.0::float * max(l) filter (where i = 6) - max(l) filter (where i = 7))::float gy
  from (select image_id, x, y, i, """ + _luma.format(r="nr", g="ng", b="nb", a="na") + """ l from nb) group by image_id, x, y
)"""
_edge = "coalesce(n8 = 8 and a <> 0 and (gx * gx + gy * gy)::float >= {t}::float, false)"
events(lambda px: stencil.sobel_edges(px, 300).select("image_id", "x", "y", "edge"), with_px(f"select px.image_id, px.x, px.y, {_edge.format(t='90000.0')} edge from px left join sob using (image_id, x, y)", NB, _sobel), "r054_sobel")

# ---- components ---------------------------------------------------------------------

_pass = f"pass as (select image_id, x, y, r, g, b, a, (a = 0 or (not edge and {dist('c', 'k')}::double <= {calibrated('64', '80', '100', TOL)})) p from (select px.*, {lab('r', 'g', 'b')} c, {lab('64', '80', '100')} k, {_edge.format(t='57600.0')} edge from px left join sob using (image_id, x, y)))"
_flood = """flood as (
  select image_id, x, y from pass where p and (x in (0, 15) or y in (0, 15))
  union
  select n.image_id, n.x, n.y from flood f join pass n on n.image_id = f.image_id and abs(n.x - f.x) <= 1 and abs(n.y - f.y) <= 1 and n.p
)"""
events(lambda px: components.isolate_background(px, KEY, TOL, 240), with_px(f"select {OUT} from (select px.image_id, px.x, px.y, {_gone('f.x is not null and a <> 0')} from px left join flood f on f.image_id = px.image_id and f.x = px.x and f.y = px.y)", NB, _sobel, _pass, _flood), "r055_isolate_background")
_small = "select {out} from (select px.image_id, px.x, px.y, {gone} from px left join (select *, count(*) over (partition by image_id, root) n from lab) l on l.image_id = px.image_id and l.x = px.x and l.y = px.y)"
vectors(lambda px: components.denoise_islands(px, 1, 3, eight=False), with_px(_small.format(out=OUT, gone=_gone("n < 3")), IMG, reach("a >= 1", False), px=PV), "r056_denoise_islands")
vectors(lambda px: components.remove_isolated(px, 4), with_px(_small.format(out=OUT, gone=_gone("n < 4")), IMG, reach("a <> 0", True), px=PV), "r057_remove_isolated")
events(lambda px: components.alpha_hysteresis(px, 100, 200), with_px(f"select {OUT} from (select px.image_id, px.x, px.y, r, g, b, case when s then 255 else 0 end a from px left join (select lab.*, bool_or(px.a >= 200) over (partition by lab.image_id, root) s from lab join px using (image_id, x, y)) l on l.image_id = px.image_id and l.x = px.x and l.y = px.y)", IMG, reach("a > 100", False)), "r058_alpha_hysteresis")
_slice = """select image_id, cast(row_number() over (partition by image_id order by root) - 1 as int) ord, 'c' || (row_number() over (partition by image_id order by root) - 1) id, greatest(0, x0 - 1) min_x, greatest(0, y0 - 1) min_y, least(8, x1 + 1) max_x, least(8, y1 + 1) max_y
from (select image_id, root, min(x) x0, min(y) y0, max(x) + 1 x1, max(y) + 1 y1, count(*) n from lab group by image_id, root) where n >= 4"""
vectors(lambda px: components.slice_components(px, 1, 4, 1, eight=False).drop("pivot_x", "pivot_y"), with_px(_slice, IMG, reach("a >= 1", False), px=PV), "r058b_slice_components")
vectors(lambda px: components.labelled_by_tiles(px, F.col("a") >= 128, True, tile=3).select("image_id", "x", "y", "root"), with_px("select px.image_id, px.x, px.y, cast(root as bigint) root from px left join lab using (image_id, x, y)", IMG, reach("a >= 128", True), px=PV), "r058c_labels_by_tiles")

# ---- aggregates ----------------------------------------------------------------------

vectors(lambda px: aggregate.opaque_box(px, 200), with_px("select image_id, coalesce(min(x) filter (where a >= 200), 0) min_x, coalesce(min(y) filter (where a >= 200), 0) min_y, coalesce(max(x) filter (where a >= 200) + 1, 0) max_x, coalesce(max(y) filter (where a >= 200) + 1, 0) max_y from px group by image_id", px=PV), "r060_opaque_box")
events(lambda px: aggregate.unique_colours(px), with_px("select image_id, count(distinct (r, g, b, a)) filter (where a <> 0) n from px group by image_id"), "r061_unique_colours")
events(lambda px: aggregate.semi_transparent(px, 128), with_px("select image_id, count(*) filter (where a > 0 and a < 128) n from px group by image_id"), "r062_semi_transparent")
events(lambda px: aggregate.background_mismatch(px, KEY, 100).select("image_id", "off", "seen", F.floor(F.col("ratio") * 10000 + 0.5).cast("int").alias("ratio")), with_px(f"select image_id, count(*) filter (where a <> 0 and {_near} > 10000) \"off\", count(*) filter (where a <> 0) seen, cast(floor(coalesce(count(*) filter (where a <> 0 and {_near} > 10000) / nullif(count(*) filter (where a <> 0), 0)::double, 0) * 10000 + 0.5) as int) ratio from px group by image_id"), "r063_background_mismatch")
events(lambda px: aggregate.sample_colour(px, 7, 7, 2), with_px("""select o.image_id, coalesce(m.r, o.r) r, coalesce(m.g, o.g) g, coalesce(m.b, o.b) b, cast(case when m.r is null then o.a else 255 end as int) a from (select * from px where x = 7 and y = 7) o
left join (select * from (select image_id, r, g, b, row_number() over (partition by image_id order by count(*) desc, min(y * 16 + x)) k from px where x between 5 and 9 and y between 5 and 9 and a >= 128 group by image_id, r, g, b) where k = 1) m using (image_id)"""), "r064_sample_colour")
_scan = "(least(x, y, 15 - x, 15 - y) * 100000 + case when y = least(x, y, 15 - x, 15 - y) then x * 10 when 15 - y = least(x, y, 15 - x, 15 - y) then x * 10 + 1 when x = least(x, y, 15 - x, 15 - y) then 10000 + y * 10 else 10000 + y * 10 + 1 end)"
events(lambda px: aggregate.snap_key(px, (70, 90, 90), 32, 3), with_px("""select image_id, cast(case when d <= 3072 then c.r else 70 end as int) r, cast(case when d <= 3072 then c.g else 90 end as int) g, cast(case when d <= 3072 then c.b else 90 end as int) b
from (select image_id, min(d) d, arg_min({'r': r, 'g': g, 'b': b}, d::bigint * 10000000 + s) c from (select *, (r - 70) * (r - 70) + (g - 90) * (g - 90) + (b - 90) * (b - 90) d, """ + _scan + """ s from px where a <> 0 and least(x, y, 15 - x, 15 - y) < 3) group by image_id)"""), "r065_snap_key")
vectors(lambda px: aggregate.bottom_row(px, 200), with_px("select image_id, coalesce(max(y) filter (where a > 200), -1) y from px group by image_id", px=PV), "r066_bottom_row")


def _stats(spark, sf_dir):
    return aggregate.size_statistics(rasters.boxes(spark, sf_dir), "sheet")


_BOXES = "with boxes as (select cast(o_custkey % 50 as int) sheet, cast(o_orderkey as bigint) ord, cast(1 + o_orderkey % 31 as int) w, cast(1 + (o_orderkey // 7) % 23 as int) h from orders), "
_STATS = _BOXES + """l as (select sheet, list_sort(list(w)) ws, list_sort(list(h)) hs, count(*) n from boxes group by sheet),
st as (select sheet, n, ws[n] max_w, ws[n // 2 + 1] median_w, ws[cast(ceil(n * 0.9::double) as int)] p90_w, hs[n] max_h, hs[n // 2 + 1] median_h, hs[cast(ceil(n * 0.9::double) as int)] p90_h,
  len(list_filter(ws, lambda v: v > 2 * ws[n // 2 + 1])) outliers_w, len(list_filter(hs, lambda v: v > 2 * hs[n // 2 + 1])) outliers_h from l)
"""


@query(_STATS + "select sheet, max_w, median_w, p90_w, outliers_w, cast(n as bigint) count, max_h, median_h, p90_h, outliers_h from st")
def r067_size_statistics(spark, sf_dir):
    return _stats(spark, sf_dir)


@query(_STATS + """select sheet, p90_w target_w, p90_h target_h, case when outliers_w > 0 or outliers_h > 0 then '⚠ Max-policy gonfia la cella: ' || concat_ws(', ', case when outliers_w > 0 then outliers_w || ' outlier W (W>2×mediana)' end, case when outliers_h > 0 then outliers_h || ' outlier H (H>2×mediana)' end) || '. Considera Median o Percentile90.' end warning from st""")
def r068_select_size(spark, sf_dir):
    return aggregate.outlier_warning(aggregate.select_size(_stats(spark, sf_dir), "p90")).select("sheet", "target_w", "target_h", "warning")


@query(with_px("select image_id, cast(max(x) + 1 as int) width, cast(max(y) + 1 as int) height, count(distinct (r, g, b)) colours from px group by image_id"))
def r096_images(spark, sf_dir):
    px = rasters.px_events(spark, sf_dir)
    return images_of(px).join(px.groupBy("image_id").agg(F.count_distinct(packed()).alias("colours")), "image_id")


@query(with_px("""select image_id, x, y, cast((m.r * 65536 + m.g * 256 + m.b) as bigint) rgb, cast(n as bigint) n from (select image_id, x, y, arg_max({'r': nr, 'g': ng, 'b': nb}, n * 100 - i) m, max(n) n from (select image_id, x, y, nr, ng, nb, count(*) n, min(i) i from nb where na <> 0 group by all) group by image_id, x, y)""", NB))
def r051b_modal_neighbours(spark, sf_dir):
    return stencil.modal_neighbours(rasters.px_events(spark, sf_dir))
