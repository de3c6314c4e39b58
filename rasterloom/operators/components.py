"""Connected pixels.

Images that fit a task are labelled whole.  Larger ones are cut into tiles: each
is labelled alone and becomes one packed row; the labels along the edges of tiles
are joined up image by image, which takes the edge lines alone (some thousandth
of the pixels); then each tile gets its labels' final names back.  Operators count
the pixels of the largest image to choose (``COUNTED``), unless told by ``tile``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.functions import color
from rasterloom.operators.pointwise import matches_key
from rasterloom.operators.stencil import sobel_edges
from rasterloom.schema import by_groups, cleared, images_of, recolour
from rasterloom.shared import shared_dir

#: Images of more pixels go by tiles of this side.
LARGE, TILE = 1 << 22, 1024
#: Operators choose by the pixels they count.
COUNTED = "counted"


def tile_for(px: DataFrame) -> int | None:
    """The side of the tiles that the images need; None where each fits a task."""
    most = px.groupBy("image_id").agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first()["n"]
    return TILE if (most or 0) > LARGE else None


def chosen(px: DataFrame, tile: int | str | None) -> int | None:
    return tile_for(px) if tile == COUNTED else tile


def joined(parent: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For each node the smallest one that the edges (u, v) reach.

    Hooks the roots of an edge's ends to the smaller one, then halves the paths,
    until nothing changes; all edges at once.
    """
    while True:
        pu, pv = parent[u], parent[v]
        if (pu == pv).all():
            return parent
        low = np.minimum(pu, pv)
        np.minimum.at(parent, pu, low)
        np.minimum.at(parent, pv, low)
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up


def label(mask: np.ndarray, eight: bool) -> np.ndarray:
    """For each set pixel the smallest linear index of its component, -1 elsewhere."""
    h, w = mask.shape
    at = np.arange(h * w).reshape(h, w)
    shifts = [(at[:, :-1], at[:, 1:]), (at[:-1], at[1:])]
    if eight:
        shifts += [(at[:-1, :-1], at[1:, 1:]), (at[:-1, 1:], at[1:, :-1])]
    flat = mask.ravel()
    u = np.concatenate([p.ravel() for p, _ in shifts])
    v = np.concatenate([q.ravel() for _, q in shifts])
    both = flat[u] & flat[v]
    parent = joined(np.arange(h * w), u[both], v[both])
    return np.where(flat, parent, -1).reshape(h, w)


def labelled(px: DataFrame, mask: Column, eight: bool, tile: int | None = None) -> DataFrame:
    """``px`` with ``root``: smallest y*width+x of the pixel's component, null where the mask is false.

    Without ``tile`` images go to tasks whole; only place and mask go through Python.
    """
    if tile:
        return labelled_by_tiles(px, mask, eight, tile)
    d = px.select("image_id", "x", "y", mask.alias("m"))

    def run(key, t):
        x, y = t.column("x").to_numpy(), t.column("y").to_numpy()
        m = np.zeros((int(y.max()) + 1, int(x.max()) + 1), bool)
        m[y, x] = t.column("m").to_numpy(zero_copy_only=False)
        root = label(m, eight)[y, x]
        return pa.table({"image_id": t.column("image_id"), "x": t.column("x"), "y": t.column("y"), "root": pa.array(root, pa.int64(), mask=root < 0)})

    roots = d.groupBy("image_id").applyInArrow(run, "image_id long, x int, y int, root long")
    return px.join(roots, ["image_id", "x", "y"])


_TILE = "image_id long, tx int, ty int, w int, h int, roots binary"
_EDGES = "image_id long, tx int, ty int, w int, h int, top binary, bottom binary, left binary, right binary"
_NAMES = "image_id long, tx int, ty int, width long, nodes binary, root_x binary, root_y binary"
#: Pixels that a batch of unpacked labels holds.
_ROWS = 1 << 16


def _tiles(tile: int, eight: bool):
    """Of many tiles' pixels at once: a row a tile, with its labels."""

    def run(t: pa.Table, cuts: np.ndarray) -> pa.Table:
        begin, n = cuts[:-1], np.diff(cuts)
        x, y, tx, ty = (t.column(c).to_numpy().astype(np.int64) for c in ("x", "y", "tx", "ty"))
        x, y = x - tx * tile, y - ty * tile
        w, h = np.maximum.reduceat(x, begin) + 1, np.maximum.reduceat(y, begin) + 1
        ends = np.cumsum(w * h)
        on = t.column("m").fill_null(False).to_numpy().astype(bool)
        x, y, wide, high = x[on], y[on], np.repeat(w, n)[on], np.repeat(h, n)[on]
        at = np.repeat(ends - w * h, n)[on] + y * wide + x
        flat = np.zeros(int(ends[-1]), bool)
        flat[at] = True
        us, vs = [], []
        for dx, dy in ((1, 0), (0, 1), (1, 1), (-1, 1)) if eight else ((1, 0), (0, 1)):
            ok = (x + dx >= 0) & (x + dx < wide) & (y + dy < high)
            u = at[ok]
            v = u + dy * wide[ok] + dx
            both = flat[v]
            us.append(u[both])
            vs.append(v[both])
        parent = joined(np.arange(len(flat)), np.concatenate(us), np.concatenate(vs))
        roots = np.where(flat, parent - np.repeat(ends - w * h, w * h), -1).astype(np.int32)
        packed = [roots[e - m : e].tobytes() for e, m in zip(ends.tolist(), (w * h).tolist(), strict=True)]
        ints = {"tx": tx[begin], "ty": ty[begin], "w": w, "h": h}
        return pa.table({"image_id": t.column("image_id").take(pa.array(begin)), **{c: pa.array(v.astype(np.int32)) for c, v in ints.items()}, "roots": pa.array(packed, pa.binary())})

    return run


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The labels along the four sides of each tile."""
    for b in batches:
        sides = [[], [], [], []]
        for i, (w, h) in enumerate(zip(b.column("w").to_pylist(), b.column("h").to_pylist(), strict=True)):
            g = np.frombuffer(b.column("roots")[i].as_buffer(), np.int32).reshape(h, w)
            for side, line in zip(sides, (g[0], g[-1], g[:, 0], g[:, -1]), strict=True):
                side.append(line.tobytes())
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("image_id", "tx", "ty", "w", "h")), *(pa.array(side, pa.binary()) for side in sides)], [x.split()[0] for x in _EDGES.split(", ")])


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of all spans, one after the other."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(sizes.sum())


def _names(tile: int, eight: bool):
    """Of many images' edge lines: for each tile its labels that have another name in the whole image."""

    def run(t: pa.Table, cuts: np.ndarray) -> pa.Table:
        tx, ty, w, h = (t.column(c).to_numpy().astype(np.int64) for c in ("tx", "ty", "w", "h"))
        image = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
        width = np.maximum.reduceat(tx * tile + w, cuts[:-1])[image]
        side = {c: np.frombuffer(b"".join(t.column(c).to_pylist()), np.int32).astype(np.int64) for c in ("top", "bottom", "left", "right")}
        begin = {"top": np.cumsum(w) - w, "bottom": np.cumsum(w) - w, "left": np.cumsum(h) - h, "right": np.cumsum(h) - h}
        each, across = tile * tile, int(tx.max()) + 3
        code = (image * (int(ty.max()) + 3) + ty + 1) * across + tx + 1  # room on all sides, so that no tile's neighbour is another row's
        sorter = np.argsort(code)
        us, vs = [], []

        def beside(dx: int, dy: int) -> tuple[np.ndarray, np.ndarray]:
            want = code + dy * across + dx
            k = np.searchsorted(code[sorter], want).clip(max=len(code) - 1)
            i = np.flatnonzero(code[sorter[k]] == want)
            return i, sorter[k[i]]

        def meet(i, j, mine, theirs, a, b, n):
            """Lines of tiles i and j from places a and b on."""
            p, q = side[mine][_spans(begin[mine][i] + a, n)], side[theirs][_spans(begin[theirs][j] + b, n)]
            ok = (p >= 0) & (q >= 0)
            us.append((p + np.repeat(i, n) * each)[ok])
            vs.append((q + np.repeat(j, n) * each)[ok])

        for dx, dy, mine, theirs, size in ((1, 0, "right", "left", h), (0, 1, "bottom", "top", w)):
            i, j = beside(dx, dy)
            n = np.minimum(size[i], size[j])
            for a, b in ((0, 0), (0, 1), (1, 0)) if eight else ((0, 0),):
                meet(i, j, mine, theirs, a, b, n - max(a, b))
        if eight:
            i, j = beside(1, 1)
            meet(i, j, "bottom", "top", w[i] - 1, 0, np.ones(len(i), np.int64))
            i, j = beside(-1, 1)
            meet(i, j, "bottom", "top", 0, w[j] - 1, np.ones(len(i), np.int64))
        u, v = np.concatenate(us), np.concatenate(vs)
        node = np.unique(np.concatenate([u, v]))
        of, local = node // each, node % each
        gx, gy = local % w[of] + tx[of] * tile, local // w[of] + ty[of] * tile
        order = np.lexsort((gx, gy, image[of]))  # so that the smallest is the first pixel of its component
        node, of, local, gx, gy = (c[order] for c in (node, of, local, gx, gy))
        by = np.argsort(node)
        place = lambda e: by[np.searchsorted(node[by], e)]
        root = joined(np.arange(len(node)), place(u), place(v))
        moved = np.flatnonzero(root != np.arange(len(node)))
        moved = moved[np.argsort(of[moved], kind="stable")]
        ends = np.searchsorted(of[moved], np.arange(len(w) + 1)).tolist()
        parts = {"nodes": local[moved], "root_x": gx[root[moved]], "root_y": gy[root[moved]]}
        lists = {c: pa.array([x[a:z].tobytes() for a, z in zip(ends, ends[1:], strict=False)], pa.binary()) for c, x in parts.items()}
        return pa.table({**{c: t.column(c) for c in ("image_id", "tx", "ty")}, "width": width, **lists})

    return run


def _unpacked(tile: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            area = np.cumsum(b.column("w").to_numpy().astype(np.int64) * b.column("h").to_numpy())
            cuts = np.flatnonzero(np.diff(area // _ROWS, prepend=0, append=area[-1:] // _ROWS + 1)) if b.num_rows else []
            for a, z in zip([0, *cuts], [*cuts, b.num_rows], strict=True):
                if z > a:
                    yield from rows(b.slice(a, z - a))

    def rows(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Of some small tiles, or a large one."""
        ids = b.column("image_id")
        tx, ty, w, h, width = (b.column(c).to_numpy().astype(np.int64) for c in ("tx", "ty", "w", "h", "width"))
        roots, nodes, root_x, root_y = (np.frombuffer(b"".join(b.column(c).to_pylist()), d) for c, d in (("roots", np.int32), ("nodes", np.int64), ("root_x", np.int64), ("root_y", np.int64)))
        ends = np.cumsum(w * h)
        begin = ends - w * h
        n = np.array([len(x) // 8 for x in b.column("nodes").to_pylist()], np.int64)
        nodes = nodes + np.repeat(begin, n)
        order = np.argsort(nodes)
        nodes, to = nodes[order], (root_y * np.repeat(width, n) + root_x)[order]
        for a in range(0, len(roots), _ROWS):
            part = roots[a : a + _ROWS].astype(np.int64)
            place = np.arange(a, a + len(part))
            of = np.searchsorted(ends, place, "right")
            y, x = np.divmod(place - begin[of], w[of])
            ry, rx = np.divmod(part, w[of])
            root = (ry + ty[of] * tile) * width[of] + rx + tx[of] * tile
            if len(nodes):
                k = np.searchsorted(nodes, part + begin[of]).clip(max=len(nodes) - 1)
                root = np.where((nodes[k] == part + begin[of]) & (part >= 0), to[k], root)
            xy = [pa.array((v + t[of] * tile).astype(np.int32)) for v, t in ((x, tx), (y, ty))]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(of)), *xy, pa.array(root, pa.int64(), mask=part < 0)], ["image_id", "x", "y", "root"])

    return run


def labelled_by_tiles(px: DataFrame, mask: Column, eight: bool, tile: int = TILE) -> DataFrame:
    """``labelled`` for images of any size: no task holds more than a tile, or the edge lines of one image's tiles."""
    tx, ty = (F.call_function("div", F.col(c), F.lit(tile)).cast("int") for c in ("x", "y"))
    d = px.select("image_id", "x", "y", mask.alias("m"), tx.alias("tx"), ty.alias("ty"))

    tiles = kept(by_groups(d, ["image_id", "tx", "ty"], _tiles(tile, eight), _TILE))  # read twice
    names = by_groups(tiles.mapInArrow(_edges, _EDGES), ["image_id"], _names(tile, eight), _NAMES)
    roots = tiles.join(names, ["image_id", "tx", "ty"]).mapInArrow(_unpacked(tile), "image_id long, x int, y int, root long")
    return px.join(roots, ["image_id", "x", "y"])


def kept(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder, so that a lost executor costs a re-read."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def of_component(d: DataFrame, value: Column, name: str, tile: int | None) -> DataFrame:
    """``d`` with an aggregate over each component: by a window where images fit a task, else summed up first and joined."""
    if tile is None:
        return d.withColumn(name, value.over(Window.partitionBy("image_id", "root")))
    return d.join(d.where("root is not null").groupBy("image_id", "root").agg(value.alias(name)), ["image_id", "root"], "left")


def of_image(d: DataFrame, value: Column, name: str, tile: int | None) -> DataFrame:
    """``d`` with an aggregate over each image, in the same two ways."""
    if tile is None:
        return d.withColumn(name, value.over(Window.partitionBy("image_id")))
    return d.join(d.groupBy("image_id").agg(value.alias(name)), "image_id", "left")


def background(px: DataFrame, key: tuple[int, int, int] | DataFrame, tolerance: float = 0, edge_threshold: float = 100, use_lab: bool = True, protect_edges: bool = True, eight: bool = True, seeds: DataFrame | None = None, tile: int | None = None) -> DataFrame:
    """``px`` with ``__reached``: is the pixel reached from the border, or from ``seeds`` (image_id, x, y)?

    A pixel lets through if it is transparent, or no strong edge and of the key's
    colour.  What is reached are the components that hold a seed.  ``key`` is one
    colour, or a DataFrame (image_id, r, g, b) of one an image; its tolerance is
    worked out once an image.
    """
    d = sobel_edges(px, edge_threshold, together=tile is None) if protect_edges else px.withColumn("edge", F.lit(False))
    if isinstance(key, DataFrame):
        rgb = [F.col(c) for c in "rgb"]
        reach = color.calibrated_column(*rgb, tolerance).cast("double") if use_lab else F.lit(float(tolerance) ** 2)
        keys = key.select("image_id", F.struct(color.oklab(*rgb).alias("lab"), *rgb, reach.alias("reach")).alias("__key"))
        d = d.join(keys, "image_id")
        own = [F.col(c) for c in "rgb"]
        apart = color.lab_distance_sq(color.oklab(*own), F.col("__key.lab")).cast("double") if use_lab else color.rgb_distance_sq(tuple(own), tuple(F.col(f"__key.{c}") for c in "rgb"))
        alike = apart <= F.col("__key.reach")
    else:
        alike = matches_key(key, tolerance, use_lab)
    d = labelled(d, (F.col("a") == 0) | (~F.col("edge") & alike), eight, tile)
    if tile is None:
        per_image = Window.partitionBy("image_id")
        right, low = F.max("x").over(per_image), F.max("y").over(per_image)
    else:
        d = d.join(images_of(px).withColumnsRenamed({"width": "__w", "height": "__h"}), "image_id")
        right, low = F.col("__w") - 1, F.col("__h") - 1
    d = d.withColumn("__seed", (F.col("x") == 0) | (F.col("y") == 0) | (F.col("x") == right) | (F.col("y") == low))
    if seeds is not None:
        d = d.join(seeds.select("image_id", "x", "y").distinct().withColumn("__more", F.lit(True)), ["image_id", "x", "y"], "left").withColumn("__seed", F.col("__seed") | F.coalesce("__more", F.lit(False)))
    d = of_component(d, F.max("__seed"), "__met", tile)
    return d.select(*px.columns, (F.col("root").isNotNull() & F.coalesce("__met", F.lit(False))).alias("__reached"))


def isolate_background(px: DataFrame, key: tuple[int, int, int] | DataFrame, tolerance: float = 0, edge_threshold: float = 100, use_lab: bool = True, protect_edges: bool = True, eight: bool = True, seeds: DataFrame | None = None, tile: int | str | None = COUNTED) -> DataFrame:
    """Remove the ``background``."""
    d = background(px, key, tolerance, edge_threshold, use_lab, protect_edges, eight, seeds, chosen(px, tile))
    return cleared(d, F.col("__reached") & (F.col("a") != 0)).select(*px.columns)


def denoise_islands(px: DataFrame, alpha: int = 1, least_area: int = 2, eight: bool = True, tile: int | str | None = COUNTED) -> DataFrame:
    """Remove components of fewer pixels than ``least_area``."""
    tile = chosen(px, tile)
    d = of_component(labelled(px, F.col("a") >= alpha, eight, tile), F.count("*"), "__n", tile)
    return cleared(d, F.col("root").isNotNull() & (F.col("__n") < least_area)).select(*px.columns)


def remove_isolated(px: DataFrame, least_size: int = 4, tile: int | str | None = COUNTED) -> DataFrame:
    return denoise_islands(px, 1, least_size, eight=True, tile=tile)


def alpha_hysteresis(px: DataFrame, low: int, high: int, tile: int | str | None = COUNTED) -> DataFrame:
    """Alpha at ``high`` or above stays; alpha above ``low`` stays if such pixels link it to one that does."""
    low, high = min(low, high), max(low, high)
    tile = chosen(px, tile)
    d = labelled(px, (F.col("a") >= high) | (F.col("a") > low), False, tile)
    d = of_component(d, F.max(F.col("a") >= high), "__strong", tile)
    return recolour(d.withColumn("__s", F.col("root").isNotNull() & F.coalesce("__strong", F.lit(False))), F.lit(True), a=F.when(F.col("__s"), 255).otherwise(0)).select(*px.columns)


def slice_components(px: DataFrame, alpha: int = 1, least_area: int = 4, padding: int = 0, eight: bool = True, tile: int | str | None = COUNTED) -> DataFrame:
    """Cells around components, numbered by their first pixel after small ones are left out."""
    d = labelled(px, F.col("a") >= alpha, eight, chosen(px, tile)).join(px.groupBy("image_id").agg((F.max("x") + 1).alias("__w"), (F.max("y") + 1).alias("__h")), "image_id")
    c = d.where(F.col("root").isNotNull()).groupBy("image_id", "root").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") + 1).alias("x1"), (F.max("y") + 1).alias("y1"), F.count("*").alias("n"), F.first("__w").alias("w"), F.first("__h").alias("h"))
    c = c.where(F.col("n") >= least_area).withColumn("ord", F.row_number().over(Window.partitionBy("image_id").orderBy("root")) - 1)
    return c.select(
        "image_id", "ord", F.concat(F.lit("c"), "ord").alias("id"),
        F.greatest(F.lit(0), F.col("x0") - padding).alias("min_x"), F.greatest(F.lit(0), F.col("y0") - padding).alias("min_y"),
        F.least("w", F.col("x1") + padding).alias("max_x"), F.least("h", F.col("y1") + padding).alias("max_y"),
        F.lit(0.5).alias("pivot_x"), F.lit(0.5).alias("pivot_y"),
    )
