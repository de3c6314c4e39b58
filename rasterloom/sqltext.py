"""Pieces of SQL text for the oracles, written apart from the DataFrame code."""

from __future__ import annotations

PX = """px as (
  select cast(event_id // 256 as bigint) image_id, cast(event_id % 16 as int) x, cast((event_id // 16) % 16 as int) y,
    cast((user_id % 4) * 64 as int) r, cast((cast(json_extract_string(props, '$.k') as int) % 4) * 80 as int) g, cast(user_id % 3 * 100 as int) b,
    case event_type when 'error' then 0 when 'signup' then 96 when 'click' then 128 else 255 end a
  from events
  union all
  select cast(i // 256 as bigint), cast(i % 16 as int), cast((i // 16) % 16 as int), 0, 0, 0, 0
  from (select unnest(range(0, (max(event_id) // 256 + 1) * 256)) i from events) where i not in (select event_id from events)
)"""
PV = """px as (
  select cast(vec_id as bigint) image_id, cast(pos % 8 as int) x, cast(pos // 8 as int) y, l r, 255 - l g, cast(pos * 37 % 256 as int) b,
    case when v < -0.15 then 0 when v < 0 then 128 else 255 end a
  from (select vec_id, pos, v, cast(least(greatest(floor(cast(v as double) * 256) + 128, 0), 255) as int) l
        from (select vec_id, unnest(embedding) v, unnest(range(0, 64)) pos from embeddings))
)"""
IMG = "img as (select image_id, max(x) + 1 width, max(y) + 1 height from px group by image_id)"
CELLS = """cells as (
  select image_id, cast(ord as int) ord, 'k' || ord id, cast(mx as int) min_x, cast(my as int) min_y, cast(mx + qw as int) max_x, cast(my + qh as int) max_y, width, height
  from (select image_id, width, height, ord, width * 3 // 4 qw, height * 3 // 4 qh, case when ord % 2 = 1 then width - width * 3 // 4 else 0 end mx, case when ord > 1 then height - height * 3 // 4 else 0 end my
        from img, (select unnest(range(0, 4)) ord))
)"""
BOXES = "boxes as (select cast(o_custkey % 50 as int) sheet, cast(o_orderkey as bigint) ord, cast(1 + o_orderkey % 31 as int) w, cast(1 + (o_orderkey // 7) % 23 as int) h from orders)"
OUT = "cast(image_id as bigint) image_id, cast(x as int) x, cast(y as int) y, cast(r as int) r, cast(g as int) g, cast(b as int) b, cast(a as int) a"
#: Pixels with each neighbour that is in the image, numbered row by row.
NB = """nb as (
  select p.image_id, p.x, p.y, p.r, p.g, p.b, p.a, n.r nr, n.g ng, n.b nb, n.a na, o.i
  from px p, (select unnest([-1, 0, 1, -1, 1, -1, 0, 1]) dx, unnest([-1, -1, -1, 0, 0, 1, 1, 1]) dy, unnest(range(0, 8)) i) o, px n
  where n.image_id = p.image_id and n.x = p.x + o.dx and n.y = p.y + o.dy
)"""


def lin(c: str) -> str:
    return f"(case when {c} / 255.0::double <= 0.04045::double then {c} / 255.0::double / 12.92::double else pow(({c} / 255.0::double + 0.055::double) / 1.055::double, 2.4::double) end)"


def lab(r: str, g: str, b: str) -> str:
    """A struct l, a, b of FLOAT."""
    d = lambda a, b, c, x, y, z: f"({a}::double * {x} + {b}::double * {y} + {c}::double * {z})"
    R, G, B = lin(r), lin(g), lin(b)
    p = f"cbrt{d('0.4122214708', '0.5363325363', '0.0514459929', R, G, B)}"
    q = f"cbrt{d('0.2119034982', '0.6806995451', '0.1361706379', R, G, B)}"
    s = f"cbrt{d('0.0883024619', '0.2817188376', '0.6299787005', R, G, B)}"
    return f"{{'l': {d('0.2104542553', '0.7936177850', '-0.0040720468', p, q, s)}::float, 'a': {d('1.9779984951', '-2.4285922050', '0.4505937099', p, q, s)}::float, 'b': {d('0.0259040371', '0.7827717662', '-0.8086757660', p, q, s)}::float}}"


def dist(p: str, q: str) -> str:
    return f"(({p}.l - {q}.l) * ({p}.l - {q}.l) + ({p}.a - {q}.a) * ({p}.a - {q}.a) + ({p}.b - {q}.b) * ({p}.b - {q}.b))"


def calibrated(r: str, g: str, b: str, steps: int) -> str:
    """A scalar query: the largest squared distance of the eight moves of a colour."""
    clamp = lambda c, k: f"greatest(0, least(255, {c} + {k}))"
    moves = f"select unnest([{steps}, -{steps}, 0, 0, 0, 0, {steps}, -{steps}]) mr, unnest([0, 0, {steps}, -{steps}, 0, 0, {steps}, -{steps}]) mg, unnest([0, 0, 0, 0, {steps}, -{steps}, {steps}, -{steps}]) mb"
    return f"(select max({dist('k', 'm')}) from (select {lab(r, g, b)} k, {lab(clamp(r, 'mr'), clamp(g, 'mg'), clamp(b, 'mb'))} m from ({moves})))"


def reach(mask: str, eight: bool, more: str = "") -> str:
    """CTEs for ``lab(image_id, x, y, root)``: the smallest y*width+x of each component of the mask."""
    near = "abs(n.x - c.x) <= 1 and abs(n.y - c.y) <= 1" if eight else "abs(n.x - c.x) + abs(n.y - c.y) = 1"
    return f"""m as (select px.image_id, x, y, y * width + x i from px join img using (image_id) where {mask}{more}),
walk as (
  select image_id, x, y, i root from m
  union
  select n.image_id, n.x, n.y, c.root from walk c join m n on n.image_id = c.image_id and {near} and n.i > c.root
),
lab as (select image_id, x, y, min(root) root from walk group by all)"""


def blend_sql(s: str, d: str) -> str:
    """Source over of two structs r, g, b, a of FLOAT steps."""
    sa, da = f"({s}.a / 255.0::float)::float", f"({d}.a / 255.0::float)::float"
    out = f"({sa} + {da} * (1.0::float - {sa}))"
    mix = lambda c: f"cast(round_even((({s}.{c}::float * {sa} + {d}.{c}::float * {da} * (1.0::float - {sa})) / {out})::float::double, 0) as int)"
    plain = lambda p: f"{{'r': {p}.r::int, 'g': {p}.g::int, 'b': {p}.b::int, 'a': {p}.a::int}}"
    mixed = f"{{'r': {mix('r')}, 'g': {mix('g')}, 'b': {mix('b')}, 'a': cast(round_even(({out} * 255.0::float)::double, 0) as int)}}"
    return f"(case when {s}.a = 0 then {plain(d)} when {s}.a = 255 or {d}.a = 0 then {plain(s)} else {mixed} end)"


def fold(layers: str = "layers", sizes: str = "img", base: str = "{'r': 0, 'g': 0, 'b': 0, 'a': 0}") -> str:
    """CTEs ``done``: layers(image_id, x, y, z, r, g, b, a) blended upwards on canvases."""
    return f"""ly as (select image_id, x, y, list({{'r': r::int, 'g': g::int, 'b': b::int, 'a': a::int}} order by z) l from {layers} where a > 0 group by image_id, x, y),
bl as (select image_id, x, y, list_reduce(list_prepend({base}, l), lambda d, s: {blend_sql('s', 'd')}) c from ly),
gr as (select image_id, xx x, yy y from (select image_id, width, unnest(range(0, height)) yy, width w from {sizes}), unnest(range(0, w)) t(xx)),
done as (select gr.image_id, gr.x, gr.y, coalesce(c.r, 0) r, coalesce(c.g, 0) g, coalesce(c.b, 0) b, coalesce(c.a, 0) a from gr left join bl using (image_id, x, y))"""
