"""Neighborhoods: bags of integer offsets, plain data at plan time."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterable, Sequence

Offset = tuple[int, ...]


def origin(dim: int) -> Offset:
    return (0,) * dim


def flatten(nested: Iterable) -> list:
    """Every leaf of nested lists, from left to right; tuples are leaves."""
    return [x for item in nested for x in (flatten(item) if isinstance(item, list) else [item])]


def cube(radius: int, dim: int) -> list[Offset]:
    """All offsets whose coordinates lie within ``radius``, in lexicographic order."""
    return list(itertools.product(range(-radius, radius + 1), repeat=dim))


def moore(radius: int = 1, dim: int = 2, include_origin: bool = True) -> list[Offset]:
    return [o for o in cube(radius, dim) if include_origin or any(o)]


def von_neumann(radius: int = 1, dim: int = 2, include_origin: bool = True) -> list[Offset]:
    """Offsets whose coordinates sum to at most ``radius`` in absolute value."""
    return [o for o in moore(radius, dim, include_origin) if sum(map(abs, o)) <= radius]


def halo_of(offsets: Sequence[Offset]) -> tuple[int, ...]:
    """The largest reach in each dimension."""
    if not offsets:
        raise TypeError("an empty neighborhood has no halo")
    return tuple(max(abs(c) for c in axis) for axis in zip(*offsets))


def halo_pairs(offsets: Sequence[Offset]) -> tuple[tuple[int, int], ...]:
    """The halo as a pair a dimension, equal on both sides."""
    return tuple((h, h) for h in halo_of(offsets))


def from_matrix(matrix, middle: Offset | None = None) -> tuple[list[Offset], list, tuple[tuple[int, int], ...]]:
    """Offsets, coefficients and halo of a matrix's non-zero entries, in row-major order, counted from its middle."""
    shape, level = [], matrix
    while hasattr(level, "__len__"):
        shape.append(len(level))
        level = level[0]
    middle = middle or tuple(n // 2 for n in shape)
    offsets, weights = [], []
    for at in itertools.product(*map(range, shape)):
        value = matrix
        for i in at:
            value = value[i]
        if value:
            offsets.append(tuple(i - m for i, m in zip(at, middle)))
            weights.append(value)
    return offsets, weights, halo_pairs(offsets)


def euclidean(offset: Offset) -> float:
    return math.sqrt(sum(c * c for c in offset))


def manhattan(offset: Offset) -> int:
    return sum(map(abs, offset))


def gaussian(deviation: float, length: int) -> list[float]:
    """The normal density at 0, 1, ... as a lookup table."""
    return [math.exp(-(x * x) / (2 * deviation * deviation)) / (deviation * math.sqrt(2 * math.pi)) for x in range(length)]
