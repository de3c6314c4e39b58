"""Image processors by name, and bounded histories: of plans, and of changed pixels."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.schema import PX, PX_COLS, grid_of, packed, rows_of
from rasterloom.shared import fresh_dir


@dataclass(frozen=True)
class Plugin:
    """``process`` takes and returns (height, width, 4); it runs on the executors, an image at a time."""

    id: str
    name: str
    version: str
    process: Callable[[np.ndarray], np.ndarray]


_known: dict[str, Plugin] = {}


def register(plugin: Plugin) -> None:
    if plugin.id in _known:
        raise ValueError(f"{plugin.id} is registered")
    _known[plugin.id] = plugin


def registered() -> list[Plugin]:
    return sorted(_known.values(), key=lambda p: p.id)


def apply(px: DataFrame, plugin_id: str) -> DataFrame:
    """The pixels after a plugin, with an ``error`` that is null unless it failed on the image, which then stays as it was."""
    process = _known[plugin_id].process

    def run(key, t):
        g, error = grid_of(t), None
        try:
            g = np.clip(process(g.copy()), 0, 255)
        except Exception as e:  # noqa: BLE001  one image's failure is its own
            error = f"{type(e).__name__}: {e}"
        out = rows_of(key[0].as_py(), g)
        return out.append_column("error", pa.array([error] * out.num_rows, pa.string()))

    return px.select(*PX_COLS).groupBy("image_id").applyInArrow(run, "image_id long, x int, y int, r int, g int, b int, a int, error string")


@dataclass
class History:
    """Undo over immutable plans: nothing is copied, the oldest of over ``depth`` is dropped."""

    current: DataFrame
    depth: int = 20
    past: list[DataFrame] = field(default_factory=list)

    def push(self, new: DataFrame) -> DataFrame:
        self.past = [*self.past, self.current][-self.depth :]
        self.current = new
        return new

    def undo(self) -> DataFrame:
        if self.past:
            self.current = self.past.pop()
        return self.current


#: Of a logged pixel: its version above, then whether it is gone, then rgba.
_VERSION, _GONE = 1 << 33, 1 << 32
_LOG = "image_id long, x int, y int, code long"


class Versions:
    """Undo over a log of changed pixels in the shared folder.

    A push writes what differs from the version before, pixels that are gone
    included; a version is the last entry of each place up to it, from one scan
    of one table, so its plan is as long after twenty pushes as after one.  After
    ``2 * depth`` versions the oldest are folded into one.  Frames that were
    handed out stay readable: folders are never written twice.  Channels are
    bytes; a null image_id is an image.
    """

    def __init__(self, px: DataFrame, depth: int = 20):
        if depth < 1:
            raise ValueError("the depth is at least 1")
        self.spark, self.depth, self.version, self.undoable = px.sparkSession, depth, 0, 0
        self.folders = [self._written(px.select(*PX_COLS[:3], packed(a="a").alias("code")))]

    def _written(self, log: DataFrame) -> str:
        path = fresh_dir(self.spark, "versions")
        log.write.parquet(path)
        return path

    def _last(self, folders: list[str]) -> DataFrame:
        d = self.spark.read.schema(_LOG).parquet(*folders)
        return d if len(folders) == 1 else d.groupBy("image_id", "x", "y").agg(F.max("code").alias("code"))

    @property
    def current(self) -> DataFrame:
        d = self._last(self.folders).where(F.col("code").bitwiseAND(F.lit(_GONE)) == 0)
        channel = lambda k: F.shiftright("code", k).bitwiseAND(F.lit(255)).cast("int")
        return d.select(*PX_COLS[:3], *[channel(k).alias(c) for c, k in zip("rgba", (24, 16, 8, 0), strict=True)]).to(self.spark.createDataFrame([], PX).schema)

    def push(self, new: DataFrame) -> DataFrame:
        """Log the differences of ``new``; what had been undone can't be redone."""
        of = lambda d, side: d.select(*PX_COLS[:3], F.lit(side).alias("side"), packed(a="a").alias("c"))
        value: Column = F.max(F.when(F.col("side") == 0, F.col("c")))
        d = of(self.current, 0).unionByName(of(new, 1)).groupBy("image_id", "x", "y").agg(value.alias("old"), F.max(F.when(F.col("side") == 1, F.col("c"))).alias("new"))
        code = F.lit((self.version + 1) * _VERSION) + F.coalesce(F.col("new"), F.lit(_GONE))
        self.folders.append(self._written(d.where(~F.col("old").eqNullSafe(F.col("new"))).select(*PX_COLS[:3], code.alias("code"))))
        self.version, self.undoable = self.version + 1, min(self.depth, self.undoable + 1)
        if len(self.folders) > 2 * self.depth:
            keep = self.depth  # versions that can be gone back from
            self.folders = [self._written(self._last(self.folders[:-keep])), *self.folders[-keep:]]
        return self.current

    def undo(self) -> DataFrame:
        """The version before, or the same where ``depth`` doesn't reach."""
        if self.undoable:
            self.folders.pop()
            self.version, self.undoable = self.version - 1, self.undoable - 1
        return self.current
