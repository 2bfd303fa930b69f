"""How a traced kernel becomes a DataFrame. All strategies give the same value at every point, halo included: floats are
worked on in double precision and cast once, and a lookup beyond its table raises at a computed point.

window  lag and lead over each grid line; offsets along one axis only, no Python. A shuffle for each axis.
box     sums of equal weights over a box of offsets, one axis after the other: sums over rows between. No Python.
join    an offsets table, met with the grid by its coordinates, and a sum; plans that SQL can show.
tile    each cell goes to every tile whose padded extent needs it (one shuffle), numpy runs the kernel in a tile.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.neighborhoods import Offset
from gridloom.operators.grid import Grid, StencilError, check_halo, interior, visited
from gridloom.operators.kernel import Call, Cell, Const, Expr, Lookup, Stencil, Sum, cells, looked_up, to_array, to_column, walk
from gridloom.sources.grids import shared_folder

STRATEGIES = ("auto", "window", "box", "join", "tile")
#: Terms that may stand in one expression; more overflow the planner's stack.
MOST_TERMS = 64
#: A window's line is sorted by one task; longer lines are cut into tiles.
LONGEST_LINE = 1_000_000
#: Edge of a cubic tile, by dimension: about as many cells each.
TILE_EDGE = {1: 65536, 2: 256, 3: 40}


def choose(stencil: Stencil, expr: Expr, shape: Sequence[int]) -> str:
    used = {c.offset for c in cells(expr)}
    one_axis = all(sum(c != 0 for c in o) <= 1 for o in used)
    terms = sum(isinstance(e, Cell) for e in walk(expr))
    if one_axis and stencil.dim > 1 and stencil.boundary != "periodic" and max(stencil.halo, default=0) <= 2 and terms <= MOST_TERMS and max(shape) <= LONGEST_LINE:
        return "window"
    if stencil.dim > 1 and stencil.boundary != "periodic" and max(shape) <= LONGEST_LINE and box_of(expr):
        return "box"
    return "tile"


def box_of(expr: Expr) -> tuple[float, float, list[tuple[int, int]]] | None:
    """(bias, weight, range of offsets by axis) of a sum of equal weights over all offsets of a box of one grid."""
    bias, weights, seen = 0, set(), []
    for sign, term in expr.terms if isinstance(expr, Sum) else ((1, expr),):
        weight = 1
        if isinstance(term, Call) and term.name == "mul" and isinstance(term.args[0], Const):
            weight, term = term.args[0].value, term.args[1]
        if isinstance(term, Const):
            bias += sign * weight * term.value
        elif isinstance(term, Cell) and term.grid == 0:
            weights.add(sign * weight)
            seen.append(term.offset)
        else:
            return None
    if len(weights) != 1 or len(seen) < 2:
        return None
    box = [(min(o), max(o)) for o in zip(*seen)]
    if len(seen) != len(set(seen)) or len(seen) != np.prod([b - a + 1 for a, b in box]):
        return None
    return bias, weights.pop(), box


def check_copy(stencil: Stencil, shape: Sequence[int]) -> None:
    """A halo that is copied must leave an interior."""
    if stencil.boundary == "copy":
        check_halo(shape, stencil.halo)


def apply(stencil: Stencil, grids: list[Grid], tables: Sequence[Sequence[float]], strategy: str, out_type: str | None) -> Grid:
    if strategy not in STRATEGIES:
        raise StencilError(f"strategy must be one of {', '.join(STRATEGIES)}")
    first = grids[0]
    if any(g.dim != stencil.dim for g in grids):
        raise StencilError("grid and neighborhoods must be of the same dimension")
    if any(g.shape != first.shape for g in grids):
        raise StencilError("grids must be of the same shape")
    check_copy(stencil, first.shape)
    expr = stencil.trace(len(tables))
    integral = isinstance(first.dtype, T.IntegralType)
    if integral and out_type is None and (tables or any(isinstance(e, Const) and not float(e.value).is_integer() or isinstance(e, Call) and e.name == "div" for e in walk(expr))):
        raise StencilError("an integer grid and a kernel with fractions need an output type")
    kind = T._parse_datatype_string(out_type) if out_type else first.dtype
    run = {"window": by_window, "box": by_box, "join": by_join, "tile": by_tile}[choose(stencil, expr, first.shape) if strategy == "auto" else strategy]
    return Grid(run(stencil, expr, grids, tables, kind), first.keys, first.value, first.shape)


def combined(grids: list[Grid]) -> DataFrame:
    """The grids joined by their coordinates, with values v0, v1, ...; floats as doubles."""
    keys = grids[0].keys
    out = None
    for n, g in enumerate(grids):
        value = F.col(g.value).cast("double") if isinstance(g.dtype, T.FloatType) else F.col(g.value)
        df = g.df.select(*[F.col(a).alias(b) for a, b in zip(g.keys, keys)], value.alias(f"v{n}"))
        out = df if out is None else out.join(df, keys)
    return out


def finish(stencil: Stencil, grid: Grid, kind: T.DataType, value: Column, seen: DataFrame) -> DataFrame:
    """The kernel's value where it is computed; elsewhere zero, or the first input in a copied halo."""
    at = visited(grid.keys, grid.shape, stencil.halo, stencil.boundary, stencil.stride)
    rest = F.lit(0)
    if stencil.boundary == "copy":
        rest = F.when(interior(grid.keys, grid.shape, stencil.halo), F.lit(0)).otherwise(F.col("v0"))
    return seen.select(*grid.keys, F.when(at, value.cast(kind)).otherwise(rest.cast(kind)).alias(grid.value))


def by_window(stencil: Stencil, expr: Expr, grids: list[Grid], tables, kind: T.DataType) -> DataFrame:
    grid = grids[0]
    if stencil.dim < 2:
        raise StencilError("a grid of one line has nothing to partition by; use tile")
    if any(sum(c != 0 for c in x.offset) > 1 for x in cells(expr)):
        raise StencilError("windows reach along one axis only")
    if stencil.boundary == "periodic":
        raise StencilError("windows end at the edge; use join or tile")
    seen = combined(grids)
    names = {}
    for d, key in enumerate(grid.keys):  # one axis after the other, so that windows of an axis share a sort
        line = Window.partitionBy(*[k for k in grid.keys if k != key]).orderBy(key)
        whole = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        made = {}
        for x in sorted(cells(expr), key=lambda x: (x.grid, x.offset)):
            step = x.offset[d]
            if not step:
                continue
            v = F.col(f"v{x.grid}")
            there = F.lag(v, -step).over(line) if step < 0 else F.lead(v, step).over(line)
            if stencil.boundary == "clamp":  # the end of the line, not the point itself, where the reach is longer
                end = v if abs(step) == 1 else F.first(v).over(whole) if step < 0 else F.last(v).over(whole)
                there = F.coalesce(there, end)
            names[x.grid, x.offset] = f"c{len(names)}"
            made[names[x.grid, x.offset]] = there
        if made:
            seen = seen.withColumns(made)
    value = to_column(expr, lambda g, o: F.col(names[g, o]) if any(o) else F.col(f"v{g}"), tables)
    return finish(stencil, grid, kind, value, seen)


def by_box(stencil: Stencil, expr: Expr, grids: list[Grid], tables, kind: T.DataType) -> DataFrame:
    grid, found = grids[0], box_of(expr)
    if stencil.dim < 2:
        raise StencilError("a grid of one line has nothing to partition by; use tile")
    if stencil.boundary == "periodic" or not found:
        raise StencilError("boxes are sums of equal weights over a box of offsets, not wrapped around")
    bias, weight, box = found
    seen = combined(grids).withColumn("total", F.col("v0"))
    for key, (low, high), n in zip(grid.keys, box, grid.shape):
        line = Window.partitionBy(*[k for k in grid.keys if k != key]).orderBy(key)
        whole = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        k, total = F.col(key), F.col("total")
        near = F.coalesce(F.sum("total").over(line.rowsBetween(low, high)), F.lit(0))
        # What is clamped counts as the line's end, as often as the box reaches beyond it.
        before = F.greatest(F.lit(0), F.least(-(k + low), F.lit(high - low + 1)))
        after = F.greatest(F.lit(0), F.least(k + high - (n - 1), F.lit(high - low + 1)))
        seen = seen.withColumn("total", near + before * F.first(total).over(whole) + after * F.last(total).over(whole))
    return finish(stencil, grid, kind, F.lit(bias) + F.lit(weight) * F.col("total"), seen)


def _template(e: Expr, params: list[float], found: list[Offset]) -> Expr:
    """A term with its constants and its one neighbor made into parameters; terms alike share a template."""
    if isinstance(e, Const):
        params.append(float(e.value))
        return Call(f"param{len(params) - 1}", ())
    if isinstance(e, Cell):
        if any(e.offset):
            found.append(e.offset)
            return Cell(e.grid, ("near",))
        return Cell(e.grid, ("here",))
    if isinstance(e, Lookup):
        return Lookup(e.table, _template(e.index, params, found))
    if isinstance(e, Sum):
        return Sum(tuple((s, _template(t, params, found)) for s, t in e.terms))
    return Call(e.name, tuple(_template(x, params, found) for x in e.args))


def by_join(stencil: Stencil, expr: Expr, grids: list[Grid], tables, kind: T.DataType) -> DataFrame:
    grid, keys = grids[0], grids[0].keys
    terms = expr.terms if isinstance(expr, Sum) else ((1, expr),)
    alike: dict[Expr, list[tuple[Offset, int, list[float]]]] = {}
    for sign, term in terms:
        params, found = [], []
        shape = _template(term, params, found)
        if len(set(found)) > 1:
            raise StencilError("a term of a join reads one neighbor; use tile")
        alike.setdefault(shape, []).append((found[0] if found else (0,) * stencil.dim, sign, params))
    wide = max((len(p) for rows in alike.values() for _, _, p in rows), default=0)
    rows = [(t, *o, s, *p, *[0.0] * (wide - len(p))) for t, group in enumerate(alike.values()) for o, s, p in group]
    names = ["t", *[f"d{d}" for d in range(stencil.dim)], "s", *[f"p{i}" for i in range(wide)]]
    offsets = F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(names, row)]) for row in rows])
    seen = combined(grids)
    near = seen.select(*[F.col(k).alias(f"at_{k}") for k in keys], *[F.col(f"v{g}").alias(f"near{g}") for g in range(len(grids))])
    computed = seen.where(visited(keys, grid.shape, stencil.halo, stencil.boundary, stencil.stride))
    asked = computed.select("*", F.inline(offsets))
    for d, (k, n) in enumerate(zip(keys, grid.shape)):
        to = F.col(k) + F.col(f"d{d}")
        asked = asked.withColumn(f"at_{k}", F.greatest(F.lit(0), F.least(to, F.lit(n - 1))).cast("long") if stencil.boundary == "clamp" else F.pmod(to, F.lit(n)).cast("long") if stencil.boundary == "periodic" else to.cast("long"))
    met = asked.join(near, [f"at_{k}" for k in keys])
    exact = isinstance(grid.dtype, T.IntegralType) and isinstance(kind, T.IntegralType)

    def value(e: Expr) -> Column:
        if isinstance(e, Call) and e.name.startswith("param"):
            p = F.col("p" + e.name[5:])
            return p.cast("long") if exact else p
        if isinstance(e, Cell):
            return F.col(f"near{e.grid}" if e.offset == ("near",) else f"v{e.grid}")
        if isinstance(e, Lookup):
            return looked_up(tables[e.table], value(e.index).cast("int"))
        if isinstance(e, Sum):
            out = F.lit(0)
            for s, t in e.terms:
                out = out + value(t) if s > 0 else out - value(t)
            return out
        a = [value(x) for x in e.args]
        return {"mul": lambda: a[0] * a[1], "div": lambda: a[0] / a[1], "neg": lambda: -a[0], "abs": lambda: F.abs(a[0]), "int": lambda: a[0].cast("int"), "min": lambda: F.least(*a), "clamp": lambda: F.greatest(a[1], F.least(a[0], a[2]))}[e.name]()

    term = F.lit(None)
    for t, shape in reversed(list(enumerate(alike))):
        term = F.when(F.col("t") == t, value(shape)).otherwise(term)
    total = met.groupBy(*keys).agg(F.sum(term * F.col("s")).alias("total"))
    return finish(stencil, grid, kind, F.col("total"), seen.join(total, keys, "left"))


class Tiling:
    """Cuts a grid into tiles; a tile's input reaches ``halo`` cells further."""

    def __init__(self, shape: Sequence[int], halo: Sequence[int], edge: int | None = None, wrap: bool = False):
        self.shape, self.halo, self.wrap = tuple(shape), tuple(halo), wrap
        self.edge = tuple(max(1, min(edge, n)) for n in shape) if edge else self.edges(shape)
        self.tiles = tuple(max(1, -(-n // e)) for n, e in zip(self.shape, self.edge))

    @staticmethod
    def edges(shape: Sequence[int]) -> tuple[int, ...]:
        """Edges of a tile of about as many cells for grids of any form: what a thin axis leaves goes to the longer ones."""
        left = float(TILE_EDGE.get(len(shape), 16) ** len(shape))
        out = [1] * len(shape)
        for i, d in enumerate(sorted(range(len(shape)), key=lambda d: shape[d])):
            out[d] = max(1, min(shape[d], round(left ** (1 / (len(shape) - i)))))
            left /= out[d]
        return tuple(out)

    def deal(self, df: DataFrame, keys: Sequence[str]) -> DataFrame:
        """Each cell once for every tile that needs it, with the tile's numbers t0, t1, ..."""
        for d, k in enumerate(keys):
            h, e, n = self.halo[d], self.edge[d], self.tiles[d]
            if self.wrap:
                near = lambda s, k=k, h=h, e=e: F.sequence(F.floor((F.col(k) + s - h) / e), F.floor((F.col(k) + s + h) / e))
                every = F.array(*[F.filter(near(F.lit(s)), lambda t: (t >= 0) & (t < n)) for s in (-self.shape[d], 0, self.shape[d])])
                df = df.withColumn(f"t{d}", F.explode(F.array_distinct(F.flatten(every)).cast("array<int>")))
            else:
                low = F.greatest(F.floor((F.col(k) - h) / e), F.lit(0))
                high = F.least(F.floor((F.col(k) + h) / e), F.lit(n - 1))
                df = df.withColumn(f"t{d}", F.explode(F.sequence(low, high).cast("array<int>")))
        return df

    def extent(self, tile: Sequence[int]) -> list[tuple[int, int]]:
        return [(t * e, min((t + 1) * e, n)) for t, e, n in zip(tile, self.edge, self.shape)]


def _compute(expr: Expr, tables, arrays, low, want, shape, halo, mode: str, stride: int):
    """The kernel over the box ``want``; ``arrays`` begin at ``low`` (modulo the shape for periodic grids)."""

    def cell(g: int, o: Offset) -> np.ndarray:
        index = []
        for d, (a, b) in enumerate(want):
            to = np.arange(a + o[d], b + o[d])
            to = np.clip(to, 0, shape[d] - 1) if mode != "periodic" else to
            index.append(np.clip(to - low[d], 0, arrays[g].shape[d] - 1))
        return arrays[g][np.ix_(*index)]

    beyond: list[np.ndarray] = []  # where lookups went out of their tables
    value = np.broadcast_to(np.asarray(to_array(expr, cell, tables, beyond)), [b - a for a, b in want])
    edge = [0] * len(shape) if mode in ("clamp", "periodic") else halo
    inside = np.ones([1] * len(shape), bool)
    lattice = np.ones([1] * len(shape), bool)
    for d, (a, b) in enumerate(want):
        at = np.arange(a, b)
        form = [-1 if k == d else 1 for k in range(len(shape))]
        inside = inside & ((at >= edge[d]) & (at < shape[d] - edge[d])).reshape(form)
        lattice = lattice & ((at - edge[d]) % stride == 0).reshape(form)
    for out in beyond:
        if (out & inside & lattice).any():
            raise StencilError("a lookup goes beyond its table")
    here = cell(0, (0,) * len(shape))
    rest = np.where(inside, 0, here) if mode == "copy" else np.zeros_like(here)
    return np.where(inside & lattice, value, rest)


def by_tile(stencil: Stencil, expr: Expr, grids: list[Grid], tables, kind: T.DataType, edge: int | None = None) -> DataFrame:
    return tiled([(stencil, expr)], grids, tables, kind, edge)


def tiled(steps: list[tuple[Stencil, Expr]], grids: list[Grid], tables, kind: T.DataType, edge: int | None = None) -> DataFrame:
    """Kernels one after the other in one pass over padded tiles.

    A step's result is computed as far outside the tile as the steps after it reach, but never outside the grid: at the
    grid's edge they meet the step's own results, clamped, as they do when run one by one.
    """
    grid, keys = grids[0], grids[0].keys
    wrap = any(s.boundary == "periodic" for s, _ in steps)
    if wrap and len(steps) > 1:
        raise StencilError("periodic steps are not fused")
    for s, _ in steps:
        check_copy(s, grid.shape)
    reach = [[sum(s.halo[d] for s, _ in steps[i:]) for d in range(grid.dim)] for i in range(len(steps) + 1)]
    reach[-1] = [0] * grid.dim
    tiling = Tiling(grid.shape, reach[0], edge, wrap)
    dealt = tiling.deal(combined(grids), keys)
    shape, dim, value = grid.shape, grid.dim, grid.value
    luts = [np.asarray(t, float) for t in tables]
    plain = [(e, s.halo, s.boundary, s.stride) for s, e in steps]
    many = len(grids)
    numpy_kinds = {"bigint": "int64", "int": "int32", "float": "float32", "double": "float64"}
    between = numpy_kinds.get(grid.dtype.simpleString(), "float64")

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        box = tiling.extent(key)
        low = [a - r if wrap else max(0, a - r) for (a, _), r in zip(box, reach[0])]
        high = [b + r if wrap else min(n, b + r) for (_, b), r, n in zip(box, reach[0], shape)]
        size = [b - a for a, b in zip(low, high)]
        at = [rows[k].to_numpy() for k in keys]
        arrays = []
        for g in range(many):
            a = np.zeros(size, rows[f"v{g}"].dtype)
            if wrap:  # a small grid may hold one cell in several places
                whole = np.zeros(shape, a.dtype)
                whole[tuple(at)] = rows[f"v{g}"].to_numpy()
                a = whole[np.ix_(*[np.arange(x, y) % n for x, y, n in zip(low, high, shape)])]
            else:
                a[tuple(x - x0 for x, x0 in zip(at, low))] = rows[f"v{g}"].to_numpy()
            arrays.append(a)
        for i, (expr, halo, mode, stride) in enumerate(plain):
            want = [(a, b) if i == len(plain) - 1 else (max(0, a - r), min(n, b + r)) for (a, b), r, n in zip(box, reach[i + 1], shape)]
            out = _compute(expr, luts, arrays, low, want, shape, halo, mode, stride)
            if i < len(plain) - 1:  # as if the step's result had been a grid of its own
                out = out.astype(between)
                out = out.astype("float64") if between == "float32" else out
            arrays, low = [out], [a for a, _ in want]
        index = np.meshgrid(*[np.arange(a, b) for a, b in box], indexing="ij")
        return pd.DataFrame({**{k: i.reshape(-1) for k, i in zip(keys, index)}, value: arrays[0].reshape(-1)})

    schema = T.StructType([*[T.StructField(k, T.LongType()) for k in keys], T.StructField(value, kind)])
    numpy_kind = numpy_kinds[kind.simpleString()]
    return dealt.groupBy(*[f"t{d}" for d in range(dim)]).applyInPandas(lambda key, rows: run(key, rows).astype({value: numpy_kind}), schema)


def fuse(stencils: Sequence[Stencil], grid: Grid, *others: Grid, tables: Sequence[Sequence[float]] = (), out_type: str | None = None, edge: int | None = None) -> Grid:
    """The stencils' composition in one shuffle, equal to running them one by one at every point. The first stencil may
    take more grids, and tables."""
    kind = T._parse_datatype_string(out_type) if out_type else grid.dtype
    steps = [(s, s.trace(0 if i else len(tables))) for i, s in enumerate(stencils)]
    return grid.like(tiled(steps, [grid, *others], tables, kind, edge))


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` from the shared folder that the session names."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def iterate(stencil: Stencil, grid: Grid, steps: int, every: int = 8) -> Grid:
    """Time stepping; the lineage is cut by a checkpoint every few steps."""
    for n in range(1, steps + 1):
        grid = stencil.apply(grid)
        if n % every == 0 and n < steps:
            grid = grid.like(checkpointed(grid.df))
    return grid
