"""Grids: dense n-d arrays as DataFrames keyed by coordinates, and the point sets of a grid."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODES = ("clamp", "zero", "copy", "wrap")


class StencilError(ValueError):
    pass


def check_mode(mode: str) -> str:
    """``wrap`` is a legal name that behaves as ``zero``; ``periodic`` is an extension that does wrap around."""
    if mode not in (*MODES, "periodic"):
        raise StencilError(f"boundary handling must be one of {', '.join(MODES)}")
    return "zero" if mode == "wrap" else mode


def check_halo(shape: Sequence[int], halo: Sequence[int]) -> None:
    if len(shape) != len(halo):
        raise StencilError("a halo and a grid must be of the same size")
    for n, h in zip(shape, halo):
        if h < 0 or n < 1:
            raise StencilError("halo and grid sizes can't be negative")
        if n <= 2 * h:
            raise StencilError("the halo can't span the grid")


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def interior(keys: Sequence[str], shape: Sequence[int], halo: Sequence[int], stride: int = 1) -> Column:
    """Whether a point is at least a halo away from every edge, and on the stride's lattice from there."""
    inside = [F.col(k).between(h, n - h - 1) for k, n, h in zip(keys, shape, halo)]
    lattice = [(F.col(k) - h) % stride == 0 for k, h in zip(keys, halo)] if stride != 1 else []
    return all_of(inside + lattice)


def visited(keys: Sequence[str], shape: Sequence[int], halo: Sequence[int], mode: str, stride: int = 1) -> Column:
    """The points a kernel computes: all of them (on the stride's lattice) for clamp, the interior for the others."""
    return interior(keys, shape, [0] * len(keys) if mode in ("clamp", "periodic") else halo, stride)


class Grid:
    """``df`` with integer key columns and one value column; keys are unique and dense from 0, values not null.

    ``shape`` may be given; otherwise it is found by one aggregation.
    """

    def __init__(self, df: DataFrame, keys: Sequence[str], value: str = "v", shape: Sequence[int] | None = None, check: bool = False):
        self.keys, self.value = list(keys), value
        self.df = df.select(*[F.col(k).cast("long").alias(k) for k in keys], F.col(value))
        if shape is None:
            row = self.df.agg(*[F.max(k).alias(k) for k in keys]).first()
            shape = [0 if x is None else x + 1 for x in row]
        self.shape = tuple(int(n) for n in shape)
        if len(self.shape) != len(self.keys):
            raise StencilError("shape and keys must be of the same size")
        if check and self.df.agg(F.countDistinct(*keys)).first()[0] != prod(self.shape):
            raise StencilError("the grid is not dense")

    @property
    def dim(self) -> int:
        return len(self.keys)

    @property
    def dtype(self):
        return self.df.schema[self.value].dataType

    def like(self, df: DataFrame) -> Grid:
        return Grid(df, self.keys, self.value, self.shape)

    def interior_points(self, halo: Sequence[int], stride: int = 1, mode: str = "zero") -> DataFrame:
        return self.df.where(visited(self.keys, self.shape, halo, check_mode(mode), stride))

    def interior_slice(self, halo: Sequence[int], extra: int = 0) -> DataFrame:
        """Points further than ``halo + extra`` from every edge; nothing is cut off for a depth of 0."""
        return self.df.where(interior(self.keys, self.shape, [h + extra for h in halo]))

    def halo_points(self, halo: Sequence[int]) -> DataFrame:
        if len(halo) != self.dim:
            raise StencilError("a halo and a grid must be of the same size")
        return self.df.where(~interior(self.keys, self.shape, halo))

    def halo_slabs(self, halo: Sequence[int]) -> DataFrame:
        """Halo points with the slab that lists each of them once: 2d for the low, 2d + 1 for the high side of the
        first dimension d that is outside its interior."""
        slab = F.lit(None).cast("int")
        for d in reversed(range(self.dim)):
            k, n, h = F.col(self.keys[d]), self.shape[d], halo[d]
            slab = F.when(k < h, 2 * d).when(k >= n - h, 2 * d + 1).otherwise(slab)
        return self.halo_points(halo).withColumn("slab", slab)

    def total(self) -> DataFrame:
        return self.df.agg(F.sum(self.value).alias("total"), F.avg(self.value).alias("mean"))
