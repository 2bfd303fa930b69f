"""Registered queries of the grid engine, and the SQL each is held against."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.neighborhoods import from_matrix, gaussian, moore, von_neumann
from gridloom.operators import library as lib
from gridloom.plans import strategies
from gridloom.sources import grids

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

MATRIX = [[1, 1, 1, 1, 1], [1, 1, 1, 1, 1], [1, 1, -4, 1, 3], [1, 1, 1, 1, 1], [1, 1, 1, 7, 1]]
#: A bag: two offsets twice.
BAG = [(-1, 1), (-1, 1), (-1, 0), (-1, 0), (0, -1), (0, 0), (0, 1), (1, 0), (1, 1)]
KEYS = {1: ["x"], 2: ["i", "j"], 3: ["i", "j", "k"]}
V = "CAST(round(value * 100) AS BIGINT)"


def register(name: str, sql: str):
    def keep(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return keep


# ---- SQL ---------------------------------------------------------------------------------------------------------


def view(dim: int, value: str = V) -> str:
    keys = {1: "event_id AS x", 2: "event_id // 100 AS i, event_id % 100 AS j", 3: "event_id // 100 AS i, (event_id % 100) // 10 AS j, event_id % 10 AS k"}[dim]
    return f"SELECT {keys}, {value} AS v FROM events"


def size(dim: int) -> str:
    """A row with the extents n0, n1, ..."""
    rest = {1: "", 2: ", 100 AS n1", 3: ", 10 AS n1, 10 AS n2"}[dim]
    return f"SELECT {'count(*)' if dim == 1 else '(count(*) + 99) // 100'} AS n0{rest} FROM events"


def inside(dim: int, halo: Sequence[int], alias: str = "t", stride: int = 1) -> str:
    keys = KEYS[dim]
    out = [f"{alias}.{k} BETWEEN {h} AND s.n{d} - {h + 1}" for d, (k, h) in enumerate(zip(keys, halo))]
    if stride > 1:
        out += [f"({alias}.{k} - {h}) % {stride} = 0" for k, h in zip(keys, halo)]
    return "(" + " AND ".join(out) + ")"


def gather(dim: int, offsets, weights, halo, mode: str = "clamp", *, source: str | None = None, bias: str = "0", term: str = "o.w * g.v", whole: str = "total", kind: str = "BIGINT", stride: int = 1, near: str | None = None) -> str:
    """Target points, the offsets as VALUES, the source at the (clamped) sum, a sum for each point, and the halo."""
    keys = KEYS[dim]
    rows = ", ".join(f"({', '.join(map(str, (*o, w)))})" for o, w in zip(offsets, weights))
    names = ", ".join([*[f"d{d}" for d in range(dim)], "w"])
    computed = inside(dim, [0] * dim if mode == "clamp" else halo, "t", stride)
    rest = "0" if mode in ("clamp", "zero") else f"CASE WHEN {inside(dim, halo)} THEN 0 ELSE t.v END"
    on = " AND ".join(f"a.{k} = t.{k}" for k in keys)
    put = ", ".join(f"greatest(0, least(t.{k} + o.d{d}, s.n{d} - 1)) AS a{d}" if mode == "clamp" else f"t.{k} + o.d{d} AS a{d}" for d, k in enumerate(keys))
    met = " AND ".join(f"g.{k} = t.a{d}" for d, k in enumerate(keys))
    return f"""WITH grid AS MATERIALIZED ({source or view(dim)}), near AS MATERIALIZED ({near or "SELECT * FROM grid"}), s AS MATERIALIZED ({size(dim)}), o({names}) AS (VALUES {rows}),
p AS MATERIALIZED (SELECT t.*, o.w, {put} FROM grid t CROSS JOIN s CROSS JOIN o WHERE {computed}),
a AS (SELECT {", ".join(f"t.{k}" for k in keys)}, sum({term.replace("o.w", "t.w")}) AS total FROM p t JOIN near g ON {met} GROUP BY ALL)
SELECT {", ".join(f"t.{k}" for k in keys)}, CAST(CASE WHEN {computed} THEN {bias} + {whole} ELSE {rest} END AS {kind}) AS v
FROM grid t CROSS JOIN s LEFT JOIN a ON {on}"""


# ---- points ------------------------------------------------------------------------------------------------------

_points = "SELECT t.*{more} FROM ({view}) t, ({size}) s WHERE {where}"


def _points_sql(dim, where, more=""):
    return _points.format(more=more, view=view(dim), size=size(dim), where=where)


SLABS_2D = ", CASE WHEN i < 1 THEN 0 WHEN i >= s.n0 - 1 THEN 1 WHEN j < 2 THEN 2 ELSE 3 END AS slab"
register("interior_points_2d", _points_sql(2, inside(2, (1, 2))))(lambda s, d: grids.events(s, d).interior_points((1, 2)))
register("interior_slice_2d", _points_sql(2, inside(2, (2, 3))))(lambda s, d: grids.events(s, d).interior_slice((1, 2), 1))
register("halo_points_2d", _points_sql(2, "NOT " + inside(2, (1, 2)), SLABS_2D))(lambda s, d: grids.events(s, d).halo_slabs((1, 2)))
register("halo_points_3d", _points_sql(3, "NOT " + inside(3, (1, 1, 2))))(lambda s, d: grids.events(s, d, 3).halo_points((1, 1, 2)))
register("strided_points_2d", _points_sql(2, inside(2, (1, 1), stride=3)))(lambda s, d: grids.events(s, d).interior_points((1, 1), 3))
register("strided_points_clamp", _points_sql(2, inside(2, (0, 0), stride=3)))(lambda s, d: grids.events(s, d).interior_points((1, 1), 3, "clamp"))
register("grid_total", f"SELECT CAST(sum(v) AS BIGINT) AS total, avg(v) AS mean FROM ({view(2)})")(lambda s, d: grids.events(s, d).total())


# ---- sums and library stencils -----------------------------------------------------------------------------------


def _sum(name: str, offsets, mode: str = "clamp", strategy: str = "auto") -> None:
    halo = [max(abs(o[d]) for o in offsets) for d in range(2)]
    register(name, gather(2, offsets, [1] * len(offsets), halo, "zero" if mode == "wrap" else mode))(lambda s, d: lib.NeighborSum(mode, [offsets]).apply(grids.events(s, d), strategy=strategy).df)


_sum("moore_sum_2d", moore())
_sum("moore_sum_2d_join", moore(), strategy="join")
_sum("von_neumann_sum_2d", von_neumann())
_sum("von_neumann_r2_sum_2d", von_neumann(2), strategy="tile")
_sum("moore_r2_sum_2d", moore(2))
_sum("moore_no_origin_sum_2d", moore(1, 2, include_origin=False), "zero")
_sum("bag_sum_2d", BAG)
_sum("long_line_sum_2d", [(-2, 0), (2, 0), (0, -2), (0, 2)], strategy="window")
_sum("wrap_sum_2d", von_neumann(), "wrap")

JACOBI = [(0, -1), (-1, 0), (0, 1), (1, 0)], (2, 4, 8, 16)
DIAGNOSTIC = [(0, -1), (0, 1), (-1, 0), (1, 0)], (2, 4, 8, 16)
for _mode in ("clamp", "zero", "copy"):
    register(f"jacobi_{_mode}", gather(2, *JACOBI, (1, 1), _mode, bias="1"))(lambda s, d, m=_mode: lib.Jacobi(m).apply(grids.events(s, d)).df)
    register(f"diagnostic_{_mode}", gather(2, *DIAGNOSTIC, (1, 1), _mode))(lambda s, d, m=_mode: lib.Diagnostic(m).apply(grids.events(s, d)).df)
register("jacobi_join", gather(2, *JACOBI, (1, 1), "clamp", bias="1"))(lambda s, d: lib.Jacobi().apply(grids.events(s, d), strategy="join").df)
register("jacobi_tile", gather(2, *JACOBI, (1, 1), "clamp", bias="1"))(lambda s, d: lib.Jacobi().apply(grids.events(s, d), strategy="tile").df)
register("stencil1d_copy", gather(1, [(-1,), (0,), (1,)], (2, 2, 2), (1,), "copy"))(lambda s, d: lib.Line("copy").apply(grids.events(s, d, 1)).df)
register("stencil1d_clamp", gather(1, [(-1,), (0,), (1,)], (2, 2, 2), (1,), "clamp"))(lambda s, d: lib.Line().apply(grids.events(s, d, 1)).df)

_LAP = [(0, 0, 0), *von_neumann(1, 3, include_origin=False)], (-4, 1, 1, 1, 1, 1, 1)
for _mode in ("clamp", "copy", "zero"):
    register(f"laplacian7_{_mode}", gather(3, *_LAP, (1, 1, 1), _mode))(lambda s, d, m=_mode: lib.Laplacian(m).apply(grids.events(s, d, 3)).df)
register("laplacian27", gather(3, moore(1, 3), [8 >> sum(map(abs, o)) for o in moore(1, 3)], (1, 1, 1), whole="total / 8.0", kind="DOUBLE"))(lambda s, d: lib.Laplacian27((8, 4, 2, 1), 8).apply(grids.events(s, d, 3), out_type="double").df)
_HEAT = [(0, 0, 0), *lib.HeatFlow.neighborhoods[0], *lib.HeatFlow.neighborhoods[1]], (8, 1, 1, 1, 1, -2, -2)
register("heat2d", gather(3, *_HEAT, (1, 1, 1), whole="total / 8.0", kind="DOUBLE"))(lambda s, d: lib.HeatFlow().apply(grids.events(s, d, 3), out_type="double").df)
_CONV = from_matrix(MATRIX)
_FLIPPED = [tuple(-c for c in o) for o in _CONV[0]]
register("convolution_5x5", gather(2, _FLIPPED, _CONV[1], (2, 2), "copy"))(lambda s, d: lib.Convolution(MATRIX).apply(grids.events(s, d)).df)
register("convolution_5x5_join", gather(2, _FLIPPED, _CONV[1], (2, 2), "copy"))(lambda s, d: lib.Convolution(MATRIX).apply(grids.events(s, d), strategy="join").df)
register("convolution_stride2", gather(2, _FLIPPED, _CONV[1], (2, 2), "copy", stride=2))(lambda s, d: lib.Convolution(MATRIX, 2).apply(grids.events(s, d)).df)
register("weighted_3d", gather(3, *([(0, 0, 0), *von_neumann(1, 3, include_origin=False)], (5, 3, 3, 3, 3, 3, 3)), (1, 1, 1)))(lambda s, d: lib.Weighted3D(5, 3).apply(grids.events(s, d, 3)).df)
register("constants_kernel", gather(2, von_neumann(1, 2, include_origin=False), [1] * 4, (1, 1), term="least(g.v, 5000)", bias="greatest(100, least(t.v, 9000))"))(lambda s, d: lib.Capped().apply(grids.events(s, d)).df)


# ---- tables, several grids, composition --------------------------------------------------------------------------


def _bilateral_sql(radius: int, by_distance, deviation: float) -> str:
    image = view(2, "CAST(least(floor(value), 255) AS DOUBLE)")
    offsets = moore(radius)
    weights = [repr(by_distance[int((a * a + b * b) ** 0.5)]) for a, b in offsets]
    by_value = f"exp(-(trunc(t.v - g.v) ** 2) / {2 * deviation * deviation}) / ({deviation} * sqrt(2 * pi()))"
    return gather(2, offsets, weights, (radius, radius), source=image, term=f"g.v * CAST(o.w AS DOUBLE) * {by_value}", kind="DOUBLE")


_RADIUS3 = gaussian(1.0, 6), gaussian(70, 256)


def _rounded(sql: str) -> str:
    return f"SELECT i, j, round(v, 6) AS v FROM ({sql})"


def _to6(df: DataFrame) -> DataFrame:
    return df.withColumn("v", F.round("v", 6))


register("bilateral", _rounded(_bilateral_sql(3, _RADIUS3[0], 70)))(lambda s, d: _to6(lib.Bilateral(3).apply(grids.image(s, d), tables=_RADIUS3).df))
_BETTER = gaussian(3, 18), gaussian(70, 256)
register("bilateral_gaussian", _rounded(_bilateral_sql(9, _BETTER[0], 70)))(lambda s, d: _to6(lib.GaussianBilateral().apply(grids.image(s, d)).df))


def _renormalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = grids.image(spark, sf_dir)
    after = lib.NeighborSum("clamp", [moore()]).apply(before)
    return grids.renormalise(after, before).df


register("image_renormalised", f"""WITH b AS ({gather(2, moore(), [1] * 9, (1, 1), source=view(2, "CAST(least(floor(value), 255) AS DOUBLE)"), kind="DOUBLE")}),
m AS (SELECT (SELECT avg(CAST(least(floor(value), 255) AS DOUBLE)) FROM events) / (SELECT avg(v) FROM b) AS r)
SELECT i, j, CAST(least(255, greatest(0, trunc(v * r))) AS INT) AS v FROM b, m""")(_renormalised)


def _two(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = grids.events(spark, sf_dir)
    return lib.Blend().apply(first, lib.Diagnostic().apply(first)).df


register("two_grid_blend", gather(2, von_neumann(), [1] * 5, (1, 1), near=gather(2, *DIAGNOSTIC, (1, 1)), bias="3 * t.v"))(_two)
_TWICE = gather(2, *JACOBI, (1, 1), bias="1", source=gather(2, *JACOBI, (1, 1), bias="1"))
register("composed_jacobi", _TWICE)(lambda s, d: lib.Jacobi().apply(lib.Jacobi().apply(grids.events(s, d))).df)
register("fused_jacobi", _TWICE)(lambda s, d: strategies.fuse([lib.Jacobi(), lib.Jacobi()], grids.events(s, d)).df)
register("fused_copy_zero", gather(2, *DIAGNOSTIC, (1, 1), "zero", source=gather(2, *JACOBI, (1, 1), "copy", bias="1")))(lambda s, d: strategies.fuse([lib.Jacobi("copy"), lib.Diagnostic("zero")], grids.events(s, d)).df)
register("emb_laplacian_float", "SELECT i, j, round(v, 5) AS v FROM (WITH g AS (SELECT vec_id AS i, generate_subscripts(embedding, 1) - 1 AS j, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings), n AS (SELECT max(i) AS a, max(j) AS b FROM g) SELECT t.i, t.j, -4 * t.v + l.v + r.v + u.v + d.v AS v FROM g t, n, g l, g r, g u, g d WHERE l.i = t.i AND l.j = greatest(t.j - 1, 0) AND r.i = t.i AND r.j = least(t.j + 1, n.b) AND u.j = t.j AND u.i = greatest(t.i - 1, 0) AND d.j = t.j AND d.i = least(t.i + 1, n.a))")(
    lambda s, d: _float_laplacian(s, d)
)


class _Plane(lib._Weighted):
    neighborhoods = [[(0, 0)], [(0, -1), (0, 1), (-1, 0), (1, 0)]]
    weights = (-4, 1)


def _float_laplacian(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = grids.embeddings(spark, sf_dir)
    wide = grid.like(grid.df.withColumn("v", F.col("v").cast("double")))
    return _Plane().apply(wide).df.withColumn("v", F.round("v", 5))


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An image as the raw sink's lines of bytes."""
    image = grids.image(spark, sf_dir)
    return grids.raw_rows(image).select("row", F.lower(F.hex("pixels")).alias("pixels"))


register("raw_lines", "SELECT event_id // 100 AS row, string_agg(lower(lpad(to_hex(CAST(least(floor(value), 255) AS INT)), 2, '0')), '' ORDER BY event_id) AS pixels FROM events GROUP BY 1")(_raw)


# ---- boxes, floats, several steps, sources -----------------------------------------------------------------------

_sum("box_sum_2d", moore(2), strategy="box")
_sum("box_sum_zero", moore(), "zero", "box")
register("box_sum_3d", gather(3, moore(1, 3), [1] * 27, (1, 1, 1)))(lambda s, d: lib.NeighborSum("clamp", [moore(1, 3)]).apply(grids.events(s, d, 3), strategy="box").df)
_FLOAT = "cast(value as float)"
_AS_FLOAT = "CAST(CAST(value AS FLOAT) AS DOUBLE)"
register("heat2d_float", gather(3, *_HEAT, (1, 1, 1), whole="total / 8.0", kind="FLOAT", source=view(3, _AS_FLOAT)))(lambda s, d: lib.HeatFlow().apply(grids.events(s, d, 3, _FLOAT)).df)
for _strategy in ("window", "join", "tile"):
    register(f"laplacian7_float_{_strategy}", gather(3, *_LAP, (1, 1, 1), kind="FLOAT", source=view(3, _AS_FLOAT)))(lambda s, d, m=_strategy: lib.Laplacian().apply(grids.events(s, d, 3, _FLOAT), strategy=m).df)
_BY_HAND = [8, 4, 2, 1]
register("laplacian27_by_hand", gather(3, moore(1, 3), [_BY_HAND[sum(map(abs, o))] for o in moore(1, 3)], (1, 1, 1), "zero"))(lambda s, d: lib.Laplacian27ByHand(_BY_HAND).apply(grids.events(s, d, 3)).df)
register("fused_blend", gather(2, *JACOBI, (1, 1), bias="1", source=ORACLES["two_grid_blend"]))(lambda s, d: strategies.fuse([lib.Blend(), lib.Jacobi()], grids.events(s, d), lib.Diagnostic().apply(grids.events(s, d))).df)
_STEPS = view(2)
for _ in range(3):
    _STEPS = gather(2, *JACOBI, (1, 1), "zero", bias="1", source=_STEPS)
register("time_steps", _STEPS)(lambda s, d: strategies.iterate(lib.Jacobi("zero"), grids.events(s, d), 3, every=2).df)
register("constant_sum", "SELECT x // 9 AS i, x % 9 AS j, CAST(2.5 * 9 AS FLOAT) AS v FROM range(63) r(x)")(lambda s, d: lib.NeighborSum("clamp", [moore()]).apply(grids.constant(s, (7, 9), 2.5)).df)


def _raw_read(spark: SparkSession, sf_dir: str, transposed: bool) -> DataFrame:
    """An image written as a raw file and read again."""
    image = grids.image(spark, sf_dir)
    path = f"{grids.shared_folder(spark)}/gridloom-image-{uuid.uuid4().hex}.raw"
    grids.write_raw(image, path)
    return grids.read_raw(spark, path, image.shape[1], image.shape[0], transposed).df


register("raw_read", "SELECT event_id // 100 AS i, event_id % 100 AS j, CAST(least(floor(value), 255) AS FLOAT) AS v FROM events")(lambda s, d: _raw_read(s, d, False))
register("raw_read_transposed", "SELECT event_id % 100 AS i, event_id // 100 AS j, CAST(least(floor(value), 255) AS FLOAT) AS v FROM events")(lambda s, d: _raw_read(s, d, True))


def _trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as trials: the type is what was timed, whole seconds how long it took."""
    timings = spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("user_id") % 3).alias("shape"), F.col("event_type").alias("name"), F.floor("value").cast("double").alias("seconds"))
    return grids.trials(timings)


register("trial_averages", "SELECT user_id % 3 AS shape, event_type AS name, avg(floor(value)) AS avg, sum(floor(value)) AS sum FROM events GROUP BY ALL")(_trials)
