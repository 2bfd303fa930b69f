"""Kernels: written as ordinary loops, traced once into an expression, planned by a strategy.

    class Blur(Stencil):
        neighborhoods = [moore()]
        def kernel(self, image, out):
            for x in self.interior_points(image):
                out[x] = 0
                for y in self.neighbors(x):
                    out[x] += image[y]
"""

from __future__ import annotations

import types
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions.neighborhoods import Offset, euclidean, halo_of, origin
from gridloom.operators.grid import StencilError, check_mode


class Expr:
    def __add__(self, o):
        return Sum.of(self, o, 1)

    def __radd__(self, o):
        return Sum.of(lift(o), self, 1)

    def __sub__(self, o):
        return Sum.of(self, o, -1)

    def __rsub__(self, o):
        return Sum.of(lift(o), self, -1)

    def __mul__(self, o):
        return Call("mul", (self, lift(o)))

    def __rmul__(self, o):
        return Call("mul", (lift(o), self))

    def __truediv__(self, o):
        return Call("div", (self, lift(o)))

    def __rtruediv__(self, o):
        return Call("div", (lift(o), self))

    def __neg__(self):
        return Call("neg", (self,))

    def __pos__(self):
        return self

    def __abs__(self):
        return Call("abs", (self,))


@dataclass(frozen=True)
class Const(Expr):
    value: float


@dataclass(frozen=True)
class Cell(Expr):
    grid: int
    offset: Offset


@dataclass(frozen=True)
class Lookup(Expr):
    table: int
    index: Expr


@dataclass(frozen=True)
class Call(Expr):
    name: str
    args: tuple


@dataclass(frozen=True)
class Sum(Expr):
    """Terms with their signs, in order."""

    terms: tuple

    @staticmethod
    def of(a, b, sign) -> Sum:
        left = a.terms if isinstance(a, Sum) else ((1, lift(a)),)
        return Sum((*left, (sign, lift(b))))


def lift(x) -> Expr:
    if isinstance(x, Expr):
        return x
    if isinstance(x, (int, float, np.number)):
        return Const(x.item() if isinstance(x, np.number) else x)
    raise StencilError(f"{type(x).__name__} can't be part of a kernel")


def truncate(x):
    """``int`` inside a kernel: towards zero."""
    return Call("int", (x,)) if isinstance(x, Expr) and not isinstance(x, Const) else int(x.value if isinstance(x, Const) else x)


def least(a, b):
    return Call("min", (lift(a), lift(b))) if isinstance(a, Expr) or isinstance(b, Expr) else min(a, b)


def clamp(v, lo, hi):
    return Call("clamp", (lift(v), lift(lo), lift(hi)))


@dataclass(frozen=True)
class Point:
    offset: Offset


class _Input:
    def __init__(self, number: int):
        self.number = number

    def __getitem__(self, at):
        if not isinstance(at, Point):
            raise StencilError("a grid is indexed by a point or a neighbor")
        return Cell(self.number, at.offset)


class _Table:
    def __init__(self, number: int):
        self.number = number

    def __getitem__(self, at):
        if isinstance(at, Point):
            raise StencilError("a lookup table is indexed by a number")
        return Lookup(self.number, lift(at))


class _Output:
    def __init__(self, dim: int):
        self.value: Expr = Const(0)
        self.dim = dim

    def __getitem__(self, at):
        if not isinstance(at, Point) or any(at.offset):
            raise StencilError("the output can be read at its own point only")
        return self.value

    def __setitem__(self, at, value):
        if not isinstance(at, Point) or any(at.offset):
            raise StencilError("the output is written at a point")
        self.value = lift(value)


class Stencil:
    """Subclasses declare ``neighborhoods`` (or get them by argument) and a ``kernel`` whose last parameter is the output."""

    neighborhoods: Sequence[Sequence[Offset]] | None = None
    constants: dict[str, float] = {}
    stride = 1

    def __init__(self, boundary: str = "clamp", neighborhoods=None):
        self.boundary = check_mode(boundary)
        self.neighborhoods = neighborhoods if neighborhoods is not None else self.neighborhoods
        if not self.neighborhoods:
            raise StencilError("neighborhoods are missing")
        try:
            dims = {len(tuple(o)) for n in self.neighborhoods for o in n}
            self.neighborhoods = [[tuple(int(c) for c in o) for o in n] for n in self.neighborhoods]
        except TypeError as e:
            raise StencilError("neighborhoods are lists of offset tuples") from e
        if len(dims) != 1:
            raise StencilError("all offsets must be of one size")
        self.dim = dims.pop()
        self.halo = halo_of([o for n in self.neighborhoods for o in n])
        self._trace: tuple | None = None

    def kernel(self, *grids):
        raise StencilError("a stencil needs a kernel")

    def distance(self, offset: Offset) -> float:
        """Of a raw offset, so that weights don't depend on the position."""
        return euclidean(offset)

    # What a kernel may use while it is traced.
    def interior_points(self, grid, stride: int | None = None):
        if stride is not None:
            self.stride = stride
        yield Point(origin(self.dim))

    def neighbors(self, point: Point, which: int = 0):
        if not isinstance(which, int) or not 0 <= which < len(self.neighborhoods):
            raise StencilError(f"undefined neighborhood identifier {which}")
        for o in self.neighborhoods[which]:
            yield Point(o)

    def trace(self, tables: int = 0) -> Expr:
        """The output of one point as an expression of input cells."""
        code = self.kernel.__func__.__code__
        inputs = code.co_argcount - 2 - tables
        if inputs < 1:
            raise StencilError("a kernel takes at least one grid, its tables and the output")
        apart = self.distance
        shadow = {"int": truncate, "min": least, "clamp": clamp, **self.constants}
        run = types.FunctionType(code, {**self.kernel.__func__.__globals__, **shadow}, closure=self.kernel.__func__.__closure__)
        out = _Output(self.dim)
        self.distance = lambda x, y=None: Const(apart(tuple(b - a for a, b in zip(x.offset, y.offset)) if y is not None else x))
        try:
            run(self, *[_Input(i) for i in range(inputs)], *[_Table(i) for i in range(tables)], out)
        finally:
            del self.distance
        return out.value

    def apply(self, grid, *others, tables: Sequence[Sequence[float]] = (), strategy: str = "auto", out_type: str | None = None):
        from gridloom.plans.strategies import apply

        return apply(self, [grid, *others], tables, strategy, out_type)


# ---- reading an expression ---------------------------------------------------------------------------------------


def walk(e: Expr):
    yield e
    for x in e.args if isinstance(e, Call) else [t for _, t in e.terms] if isinstance(e, Sum) else [e.index] if isinstance(e, Lookup) else []:
        yield from walk(x)


def cells(e: Expr) -> set[Cell]:
    return {x for x in walk(e) if isinstance(x, Cell)}


def looked_up(table: Sequence[float], index: Column) -> Column:
    """A table's value; an index beyond it raises, a null one gives null."""
    beyond = F.raise_error(F.lit("a lookup goes beyond its table")).cast("double")
    return F.when(index.between(0, len(table) - 1), F.get(F.array(*[F.lit(float(x)) for x in table]), index)).when(index.isNotNull(), beyond)


def to_column(e: Expr, cell: Callable[[int, Offset], Column], tables: Sequence[Sequence[float]]) -> Column:
    sub = lambda x: to_column(x, cell, tables)
    if isinstance(e, Const):
        return F.lit(e.value)
    if isinstance(e, Cell):
        return cell(e.grid, e.offset)
    if isinstance(e, Lookup):
        index = F.lit(int(e.index.value)) if isinstance(e.index, Const) else sub(e.index).cast("int")
        if isinstance(e.index, Const):
            return F.lit(float(tables[e.table][int(e.index.value)]))
        return looked_up(tables[e.table], index)
    if isinstance(e, Sum):
        out = None
        for sign, t in e.terms:
            c = sub(t)
            out = (c if sign > 0 else -c) if out is None else out + c if sign > 0 else out - c
        return out
    a = [sub(x) for x in e.args]
    return {"mul": lambda: a[0] * a[1], "div": lambda: a[0] / a[1], "neg": lambda: -a[0], "abs": lambda: F.abs(a[0]), "int": lambda: a[0].cast("int"), "min": lambda: F.least(*a), "clamp": lambda: F.greatest(a[1], F.least(a[0], a[2]))}[e.name]()


def to_array(e: Expr, cell: Callable[[int, Offset], np.ndarray], tables: Sequence[np.ndarray], beyond: list):
    """``beyond`` gets, for each lookup, where its index is out of the table."""
    sub = lambda x: to_array(x, cell, tables, beyond)
    if isinstance(e, Const):
        return e.value
    if isinstance(e, Cell):
        return cell(e.grid, e.offset)
    if isinstance(e, Lookup):
        index, last = np.trunc(sub(e.index)).astype(np.int64), len(tables[e.table]) - 1
        beyond.append((index < 0) | (index > last))
        return tables[e.table][np.clip(index, 0, last)]
    if isinstance(e, Sum):
        out = 0
        for sign, t in e.terms:
            out = out + sub(t) if sign > 0 else out - sub(t)
        return out
    a = [sub(x) for x in e.args]
    return {"mul": lambda: a[0] * a[1], "div": lambda: a[0] / a[1], "neg": lambda: -a[0], "abs": lambda: np.abs(a[0]), "int": lambda: np.trunc(a[0]).astype(np.int64), "min": lambda: np.minimum(*a), "clamp": lambda: np.maximum(a[1], np.minimum(a[0], a[2]))}[e.name]()
