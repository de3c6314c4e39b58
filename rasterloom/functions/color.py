"""Colour functions as column expressions, and the few that the driver needs as numbers."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Linear RGB to cone response, and its cube root to Lab (fixed values of the Oklab definition).
M1 = (
    (0.4122214708, 0.5363325363, 0.0514459929),
    (0.2119034982, 0.6806995451, 0.1361706379),
    (0.0883024619, 0.2817188376, 0.6299787005),
)
M2 = (
    (0.2104542553, 0.7936177850, -0.0040720468),
    (1.9779984951, -2.4285922050, 0.4505937099),
    (0.0259040371, 0.7827717662, -0.8086757660),
)
#: Rec. 601 luma weights (fixed values).
LUMA = (0.299, 0.587, 0.114)


def invert(m) -> list[list[float]]:
    """The inverse of a 3x3 matrix by its adjugate; a vanishing determinant is an error."""
    (a, b, c), (d, e, f), (g, h, i) = m
    det = a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)
    if abs(det) < 1e-30:
        raise ValueError("the matrix has no inverse")
    adj = ((e * i - f * h, c * h - b * i, b * f - c * e), (f * g - d * i, a * i - c * g, c * d - a * f), (d * h - e * g, b * g - a * h, a * e - b * d))
    return [[x / det for x in row] for row in adj]


def let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, where it would be copied into the expression many times."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def srgb_to_linear(c: Column) -> Column:
    v = c / F.lit(255.0)
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))


def linear_to_srgb(v: Column) -> Column:
    """A byte; halves go to the even neighbour."""
    s = F.when(v <= 0.0031308, v * 12.92).otherwise(F.lit(1.055) * F.pow(v, F.lit(1.0 / 2.4)) - 0.055)
    return F.when(v <= 0, 0).when(v >= 1, 255).otherwise(F.rint(s * 255.0)).cast("int")


def oklab(r: Column, g: Column, b: Column) -> Column:
    """struct<l, a, b> of FLOAT, computed in double and cast at the end."""
    lin = [srgb_to_linear(c) for c in (r, g, b)]
    dot = lambda m, v: m[0] * v[0] + m[1] * v[1] + m[2] * v[2]
    root = [F.cbrt(dot(m, lin)) for m in M1]
    return F.struct(*[dot(m, root).cast("float").alias(n) for m, n in zip(M2, "lab", strict=True)])


def oklab_to_rgb(lab: Column) -> Column:
    """struct<r, g, b> of INT."""
    dot = lambda m, v: m[0] * v[0] + m[1] * v[1] + m[2] * v[2]
    roots = lambda p: F.struct(*[dot(m, [p[n].cast("double") for n in "lab"]).alias(n) for m, n in zip(invert(M2), "lms", strict=True)])
    cubes = lambda p: F.struct(*[(p[n] * p[n] * p[n]).alias(n) for n in "lms"])
    linear = lambda p: F.struct(*[dot(m, [p[n] for n in "lms"]).alias(n) for m, n in zip(invert(M1), "rgb", strict=True)])
    bytes_of = lambda p: F.struct(*[linear_to_srgb(p[n]).alias(n) for n in "rgb"])
    return let(lab, lambda a: let(roots(a), lambda b: let(cubes(b), lambda c: let(linear(c), bytes_of))))


def lab_distance_sq(p: Column, q: Column) -> Column:
    """FLOAT, as all of its steps are."""
    d = [p[n] - q[n] for n in "lab"]
    return d[0] * d[0] + d[1] * d[1] + d[2] * d[2]


def lab_distance(p: Column, q: Column) -> Column:
    return F.sqrt(lab_distance_sq(p, q).cast("double")).cast("float")


def luma(r: Column, g: Column, b: Column) -> Column:
    return LUMA[0] * r + LUMA[1] * g + LUMA[2] * b


def rgb_distance_sq(p: tuple[Column, Column, Column], q: tuple) -> Column:
    d = [(a - b).cast("int") for a, b in zip(p, q, strict=True)]
    return d[0] * d[0] + d[1] * d[1] + d[2] * d[2]


#: The eight ways in which a tolerance moves a colour: each channel, and all, up and down.
PROBES = ((1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1), (1, 1, 1), (-1, -1, -1))


def lab_of(rgb: tuple[int, int, int]) -> np.ndarray:
    """Float32 Lab of one colour, for constants."""
    lin = [v / 12.92 if (v := c / 255.0) <= 0.04045 else math.pow((v + 0.055) / 1.055, 2.4) for c in rgb]
    root = [math.cbrt(sum(w * x for w, x in zip(m, lin, strict=True))) for m in M1]
    return np.array([sum(w * x for w, x in zip(m, root, strict=True)) for m in M2], np.float32)


def labs_of(rgb: np.ndarray) -> np.ndarray:
    """The same of many, (n, 3)."""
    level = np.array([v / 12.92 if (v := c / 255.0) <= 0.04045 else math.pow((v + 0.055) / 1.055, 2.4) for c in range(256)])
    dot = lambda m, v: m[0] * v[0] + m[1] * v[1] + m[2] * v[2]
    lin = level[np.asarray(rgb).T]
    root = [np.fromiter(map(math.cbrt, dot(m, lin).tolist()), float, lin.shape[1]) for m in M1]  # numpy's own differs by processor
    return np.stack([dot(m, root) for m in M2], axis=1).astype(np.float32)


def calibrated(key: tuple[int, int, int], tolerance: float) -> float:
    """The largest squared Lab distance that ``tolerance`` RGB steps make around a key."""
    steps = round(max(0.0, tolerance))  # halves to even
    if steps == 0:
        return (tolerance / 255.0) ** 2
    k = lab_of(key)
    best = 0.0
    for probe in PROBES:
        d = k - lab_of(tuple(min(255, max(0, c + steps * p)) for c, p in zip(key, probe, strict=True)))
        best = max(best, float(np.float32(np.float32(d[0] * d[0]) + np.float32(d[1] * d[1])) + np.float32(d[2] * d[2])))
    return best


def calibrated_column(r: Column, g: Column, b: Column, tolerance: float) -> Column:
    """The same around the colour of each row, as FLOAT."""
    steps = round(max(0.0, tolerance))
    if steps == 0:
        return F.lit((tolerance / 255.0) ** 2)
    moved = lambda c, p: F.least(F.greatest(c + steps * p, F.lit(0)), F.lit(255))
    probes = F.array(*[oklab(*[moved(c, p) for c, p in zip((r, g, b), probe, strict=True)]) for probe in PROBES])
    return let(oklab(r, g, b), lambda own: F.array_max(F.transform(probes, lambda p: lab_distance_sq(own, p))))


def parse_hex(text: Column, fallback: tuple[int, int, int] | None = None) -> Column:
    """struct<r, g, b, a> of ``#RRGGBB`` or ``RRGGBB``; else the fallback, or null."""
    digits = F.regexp_extract(F.trim(text), r"^#?([0-9A-Fa-f]{6})$", 1)
    part = lambda k: F.conv(F.substring(digits, 1 + 2 * k, 2), 16, 10).cast("int")
    found = F.struct(part(0).alias("r"), part(1).alias("g"), part(2).alias("b"), F.lit(255).alias("a"))
    other = F.struct(*[F.lit(v).alias(n) for v, n in zip((*fallback, 255), "rgba", strict=True)]) if fallback else F.lit(None).cast("struct<r:int,g:int,b:int,a:int>")
    return F.when(F.coalesce(digits, F.lit("")) != "", found).otherwise(other)


def normalise_hex(text: Column, fallback: str) -> Column:
    digits = F.regexp_extract(F.trim(text), r"^#?([0-9A-Fa-f]{6})$", 1)
    return F.when(F.coalesce(digits, F.lit("")) != "", F.concat(F.lit("#"), F.upper(digits))).otherwise(F.lit(fallback))
