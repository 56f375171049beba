"""Scalar expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm(*cols: str) -> Column:
    return F.sqrt(sum((F.col(c) * F.col(c) for c in cols), F.lit(0.0)))


def clip(c: Column, low, high) -> Column:
    return F.greatest(F.least(c, F.lit(high)), F.lit(low))


def dot(a: tuple[str, ...], b: tuple[str, ...]) -> Column:
    return sum((F.col(x) * F.col(y) for x, y in zip(a, b, strict=True)), F.lit(0.0))


def cross(a: tuple[str, str, str], b: tuple[str, str, str]) -> list[Column]:
    (ax, ay, az), (bx, by, bz) = map(F.col, a), map(F.col, b)
    return [ay * bz - az * by, az * bx - ax * bz, ax * by - ay * bx]


def angle(a: tuple[str, ...], b: tuple[str, ...]) -> Column:
    """Angle of two vectors; none if either is zero."""
    size = norm(*a) * norm(*b)
    return F.when(size > 0, F.acos(clip(dot(a, b) / size, -1.0, 1.0)))


def softmax(values: str) -> Column:
    """Of an array column."""
    exps = F.transform(values, lambda v: F.exp(v - F.array_max(values)))
    total = F.aggregate(exps, F.lit(0.0), lambda a, v: a + v)
    return F.transform(exps, lambda v: v / total)


def argmax(values: str) -> Column:
    """0-based place of the first greatest element."""
    return F.array_position(F.col(values), F.array_max(values)) - 1


def sigmoid(c: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-c))


def relu(c: Column) -> Column:
    return F.greatest(c, F.lit(0.0))


def ravel(ijk: tuple[str, str, str], size: tuple[int, int, int]) -> Column:
    i, j, k = map(F.col, ijk)
    return i * (size[1] * size[2]) + j * size[2] + k


def unravel(index: str, size: tuple[int, int, int]) -> list[Column]:
    """Of an index that is not negative."""
    x = F.col(index)
    return [F.floor(x / (size[1] * size[2])), F.pmod(F.floor(x / size[2]), F.lit(size[1])), F.pmod(x, F.lit(size[2]))]


def interp(x: Column, xs: list[float], ys: list[float]) -> Column:
    """Linear interpolation through few fixed knots, flat beyond the ends."""
    out = F.when(x <= xs[0], F.lit(float(ys[0])))
    for a, b, u, v in zip(xs, xs[1:], ys, ys[1:], strict=False):
        out = out.when(x <= b, F.lit(float(u)) + (x - a) * ((v - u) / (b - a)))
    return out.otherwise(F.lit(float(ys[-1])))


def model_resolution_cm(name: Column) -> Column:
    """The number before ``cm`` in a model name's last ``_`` part."""
    return F.split(F.element_at(F.split(name, "_"), -1), "cm").getItem(0).cast("double")


def model_block(name: Column) -> Column:
    """A model name's second-last ``_`` part: voxels on a block's side."""
    return F.element_at(F.split(name, "_"), -2).cast("int")


def model_is_efficient(name: Column) -> Column:
    return F.contains(name, F.lit("esegformer"))


def model_url(base: str, name: Column) -> Column:
    """Download address: ``(`` becomes ``_`` and ``)`` goes."""
    return F.concat(F.lit(base), F.translate(name, "()", "_"))
