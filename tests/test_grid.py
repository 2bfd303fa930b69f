import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions.neighborhoods import moore, von_neumann
from gridloom.operators import library as lib
from gridloom.operators.grid import Grid, StencilError, check_halo
from gridloom.operators.kernel import Stencil
from gridloom.plans import strategies
from gridloom.sources import grids


def run(stencil, array, spark, **kw):
    return grids.to_array(stencil.apply(grids.from_array(spark, array), **kw))


def brute(stencil, arrays, weights, bias=0):
    """The weighted neighbor sum by loops; ``weights``: (offset, weight)."""
    a, out = arrays, np.zeros_like(arrays)
    edge = [0] * a.ndim if stencil.boundary == "clamp" else stencil.halo
    for p in np.ndindex(*a.shape):
        if all(e <= x < n - e for x, e, n in zip(p, edge, a.shape)):
            out[p] = bias + sum(w * a[tuple(min(max(x + c, 0), n - 1) for x, c, n in zip(p, o, a.shape))] for o, w in weights)
        elif stencil.boundary == "copy":
            out[p] = a[p]
    return out


SMALL = np.arange(16).reshape(4, 4)


@pytest.mark.parametrize("strategy", ["window", "join", "tile"])
def test_golden_values(spark, strategy):
    assert run(lib.Diagnostic(), SMALL, spark, strategy=strategy).tolist() == [[68, 96, 126, 152], [156, 184, 214, 240], [276, 304, 334, 360], [332, 360, 390, 416]]
    assert run(lib.Jacobi(), SMALL, spark, strategy=strategy).tolist() == [[73, 101, 131, 153], [177, 205, 235, 257], [297, 325, 355, 377], [353, 381, 411, 433]]
    zero = run(lib.Jacobi("zero"), SMALL, spark, strategy=strategy)
    assert zero[1:3, 1:3].tolist() == [[205, 235], [325, 355]] and zero.sum() == 205 + 235 + 325 + 355
    copy = run(lib.Diagnostic("copy"), SMALL, spark, strategy=strategy)
    assert copy[1:3, 1:3].tolist() == [[184, 214], [304, 334]] and (copy[0] == SMALL[0]).all() and (copy[:, 3] == SMALL[:, 3]).all()


def test_convolution_is_flipped(spark):
    a = np.arange(36).reshape(6, 6)
    from gridloom.plans.catalog import MATRIX

    for strategy in ("join", "tile"):
        out = run(lib.Convolution(MATRIX), a, spark, strategy=strategy)
        assert out[2:4, 2:4].tolist() == [[310, 338], [478, 506]] and (out[0] == a[0]).all()
    ones = run(lib.Convolution(MATRIX, 2), np.ones((8, 8), np.int64), spark)
    assert [ones[p] for p in ((2, 2), (2, 4), (4, 2), (4, 4))] == [28] * 4 and ones[2:6, 2:6].sum() == 28 * 4 and (ones[:2] == 1).all()
    with pytest.raises(KeyError):
        run(lib.Convolution([[0, 0, 0], [0, 1, 1], [0, 0, 0]]), a, spark)


def test_three_dimensions(spark):
    a = (9 * np.arange(3)[:, None, None] + 3 * np.arange(3)[None, :, None] + np.arange(3)).astype(float)
    out = run(lib.HeatFlow(), a, spark)
    assert out[1].round(3).tolist() == [[9.5, 10.375, 11.25], [12.125, 13, 13.875], [14.75, 15.625, 16.5]]
    assert run(lib.HeatFlow("zero"), a, spark, strategy="join")[1, 1, 1] == 13
    ones = np.ones((4, 4, 4), np.float32)
    assert (run(lib.Laplacian(), ones, spark) == 2).all()
    copy = run(lib.Laplacian("copy"), ones, spark)
    assert (copy == 2).sum() == 8 and (copy == 1).sum() == 56
    for strategy in ("join", "tile"):
        assert (run(lib.Laplacian27([1, 0.5, 0.25, 0.125]), ones, spark, strategy=strategy) == 8).all()


def test_line(spark):
    a = np.ones(8, np.float32)
    assert run(lib.Line("copy"), a, spark).tolist() == [1, 6, 6, 6, 6, 6, 6, 1]
    assert run(lib.Line("copy"), a, spark, strategy="join").tolist() == [1, 6, 6, 6, 6, 6, 6, 1]
    with pytest.raises(StencilError):
        run(lib.Line(), a, spark, strategy="window")


@pytest.mark.parametrize("mode", ["clamp", "zero", "copy", "wrap"])
def test_strategies_agree_with_loops(spark, mode):
    a = np.random.default_rng(5).integers(0, 1000, (9, 11))
    offsets = [(-2, 0), (0, 2), (0, 2), (1, 0), (0, 0), (0, -1)]
    sum_ = lib.NeighborSum(mode, [offsets])
    want = brute(sum_, a, [(o, 1) for o in offsets])
    for strategy in ("window", "join", "tile"):
        got = run(sum_, a, spark, strategy=strategy)
        assert (got == want).all(), strategy
        assert got.dtype == a.dtype
    wrong = brute(sum_, a, [(o, 1 + (o == (1, 0))) for o in offsets])
    assert (got != wrong).any()  # the comparison notices a wrong weight


def test_ragged_tiles(spark):
    a = np.random.default_rng(6).integers(0, 1000, (13, 10))
    s = lib.NeighborSum("clamp", [moore(2)])
    grid = grids.from_array(spark, a)
    want = brute(s, a, [(o, 1) for o in moore(2)])
    for edge in (1, 4, 64):
        got = grids.to_array(grid.like(strategies.by_tile(s, s.trace(), [grid], (), grid.dtype, edge)))
        assert (got == want).all(), edge


def test_choice_of_strategy(monkeypatch):
    s = lib.Jacobi()
    assert strategies.choose(s, s.trace(), (1000, 100)) == "window"
    assert strategies.choose(s, s.trace(), (10**7, 100)) == "tile"  # one task would sort a whole line
    wide = lib.NeighborSum("clamp", [moore()])
    assert strategies.choose(wide, wide.trace(), (10, 10)) == "box"


def test_periodic_extension(spark):
    a = np.random.default_rng(7).integers(0, 1000, (5, 6))
    s = lib.NeighborSum("periodic", [von_neumann(2)])
    want = sum(np.roll(a, (-i, -j), (0, 1)) for i, j in von_neumann(2))
    for strategy in ("join", "tile"):
        assert (run(s, a, spark, strategy=strategy) == want).all()


def test_fused_equals_one_by_one(spark):
    a = np.random.default_rng(8).integers(0, 100, (12, 9))
    grid = grids.from_array(spark, a)
    for first, second in ((lib.Jacobi(), lib.Jacobi()), (lib.Jacobi("copy"), lib.Diagnostic("zero")), (lib.NeighborSum("zero", [moore(2)]), lib.Jacobi("copy"))):
        apart = grids.to_array(second.apply(first.apply(grid)))
        assert (grids.to_array(strategies.fuse([first, second], grid, edge=4)) == apart).all()
    assert (grids.to_array(strategies.iterate(lib.Jacobi(), grid, 3, every=2)) == grids.to_array(lib.Jacobi().apply(lib.Jacobi().apply(lib.Jacobi().apply(grid))))).all()
    assert (grids.to_array(strategies.iterate(lib.Jacobi(), grid, 2)) == grids.to_array(lib.Jacobi().apply(lib.Jacobi().apply(grid)))).all()


@pytest.mark.parametrize("dim", [1, 2, 3, 4])
@pytest.mark.parametrize("depth", [1, 2])
def test_halo_and_interior_are_the_grid(spark, dim, depth):
    grid = grids.constant(spark, (5,) * dim)
    halo = [depth] * dim
    inside = {tuple(r)[:dim] for r in grid.interior_points(halo).collect()}
    slabs = grid.halo_slabs(halo).collect()
    outside = {tuple(r)[:dim] for r in slabs}
    assert len(outside) == len(slabs) and not inside & outside
    assert inside | outside == set(itertools.product(range(5), repeat=dim))
    assert inside == set(itertools.product(range(depth, 5 - depth), repeat=dim))


def test_point_sets(spark):
    grid = grids.constant(spark, (6, 7))
    assert grid.interior_slice((0, 0)).count() == 42 and grid.interior_slice((1, 2), 1).count() == 2 * 1
    assert grid.interior_points((1, 1), 2).count() == 2 * 3
    with pytest.raises(StencilError):
        grid.halo_points((1,))


def test_validation(spark):
    for bad in ({"boundary": "edge"}, {"neighborhoods": []}, {"neighborhoods": [3]}, {"neighborhoods": [[(1, 0), (1,)]]}):
        with pytest.raises(StencilError):
            lib.NeighborSum(**{"neighborhoods": [moore()], **bad})
    for shape, halo in (((5, 5), (1,)), ((5,), (-1,)), ((4,), (2,)), ((0,), (0,))):
        with pytest.raises(StencilError):
            check_halo(shape, halo)
    with pytest.raises(StencilError):
        Grid(spark.range(4).selectExpr("id * 2 AS i", "id AS v"), ["i"], check=True)
    with pytest.raises(StencilError):
        lib.HeatFlow().apply(grids.from_array(spark, np.ones((3, 3, 3), np.int64)))
    with pytest.raises(StencilError):
        lib.Jacobi().apply(grids.from_array(spark, SMALL), strategy="gpu")


class Broken(Stencil):
    neighborhoods = [[(0, 1)]]
    what = ""

    def kernel(self, image, out):
        for x in self.interior_points(image):
            for y in self.neighbors(x, 1 if self.what == "id" else 0):
                if self.what == "out":
                    out[x] += out[y]
                elif self.what == "index":
                    out[x] += image[3]
                elif self.what == "text":
                    out[x] += image[y] * "a"


@pytest.mark.parametrize("what", ["id", "out", "index", "text"])
def test_kernels_that_are_refused(what):
    s = Broken()
    s.what = what
    with pytest.raises(StencilError):
        s.trace()


class Curious(Stencil):
    neighborhoods = [moore()]
    constants = {"gain": 3}

    def kernel(self, image, lut, out):
        for x in self.interior_points(image):
            out[x] = -image[x] / 2
            for y in self.neighbors(x):
                out[x] += gain * lut[int(self.distance(x, y))] * abs(int(image[y] - image[x])) - min(image[y], 40)  # noqa: F821


def test_kernel_language(spark):
    a = np.random.default_rng(9).uniform(0, 90, (6, 6))
    lut = [1.0, 0.5]
    want = np.zeros_like(a)
    for p in np.ndindex(6, 6):
        want[p] = -a[p] / 2
        for o in moore():
            q = tuple(min(max(x + c, 0), 5) for x, c in zip(p, o))
            want[p] += 3 * lut[int(np.hypot(*o))] * abs(int(a[q] - a[p])) - min(a[q], 40)
    for strategy in ("join", "tile"):
        assert np.allclose(run(Curious(), a, spark, tables=[lut], strategy=strategy), want)


def test_bilateral_and_two_grids(spark):
    a = np.floor(np.random.default_rng(1).uniform(0, 255, (8, 9)))
    s = lib.GaussianBilateral(1, 70)
    got = run(s, a, spark)
    fd, fs = s.tables
    want = np.zeros_like(a)
    for p in np.ndindex(*a.shape):
        for o in moore(3):
            q = tuple(min(max(x + c, 0), n - 1) for x, c, n in zip(p, o, a.shape))
            want[p] += a[q] * fd[int(np.hypot(*o))] * fs[abs(int(a[p] - a[q]))]
    assert np.allclose(got, want)
    first, second = grids.from_array(spark, SMALL), grids.from_array(spark, SMALL * 10)
    want = 3 * SMALL + brute(lib.NeighborSum("clamp", [von_neumann()]), SMALL * 10, [(o, 1) for o in von_neumann()])
    for strategy in ("window", "join", "tile"):
        assert (grids.to_array(lib.Blend().apply(first, second, strategy=strategy)) == want).all()
    for strategy in ("join", "tile"):  # a difference beyond the table, at a point that is computed
        with pytest.raises(Exception, match="beyond its table"):
            run(lib.Bilateral(1), np.array([[0.0, 300.0], [0.0, 0.0]]), spark, tables=(fd, fs), strategy=strategy)


def test_floats_are_alike_in_all_strategies(spark):
    a = np.random.default_rng(8).random((6, 7, 8)).astype(np.float32) * 1000
    for stencil, among in ((lib.HeatFlow(), ("join", "tile")), (lib.Laplacian("copy"), ("window", "join", "tile"))):
        got = [run(stencil, a, spark, strategy=s) for s in among]
        assert all(g.dtype == np.float32 and (g == got[0]).all() for g in got)
    grid = grids.from_array(spark, a)
    twice = grids.to_array(lib.HeatFlow("copy").apply(lib.HeatFlow().apply(grid)))
    assert (grids.to_array(strategies.fuse([lib.HeatFlow(), lib.HeatFlow("copy")], grid)) == twice).all()


@pytest.mark.parametrize("mode", ["clamp", "zero", "copy"])
def test_boxes(spark, mode):
    a = np.random.default_rng(9).integers(-50, 1000, (7, 9))
    for offsets in (moore(2), moore(1), list(itertools.product((-1, 0, 1, 2), (-3, -2))), list(itertools.product((2, 3), (0,)))):
        stencil = lib.NeighborSum(mode, [offsets])
        assert (run(stencil, a, spark, strategy="box") == brute(stencil, a, [(o, 1) for o in offsets])).all()
    assert strategies.box_of(lib.NeighborSum("clamp", [moore(2)]).trace()) and not strategies.box_of(lib.Jacobi().trace())
    assert strategies.choose(lib.NeighborSum("clamp", [moore(2)]), lib.NeighborSum("clamp", [moore(2)]).trace(), (9, 9)) == "box"
    with pytest.raises(StencilError):
        run(lib.Jacobi(), a, spark, strategy="box")


def test_copied_halos_leave_an_interior(spark):
    with pytest.raises(StencilError):
        run(lib.NeighborSum("copy", [moore(3)]), SMALL, spark)
    with pytest.raises(StencilError):
        strategies.fuse([lib.NeighborSum("copy", [moore(2)])], grids.from_array(spark, SMALL))
    assert run(lib.NeighborSum("zero", [moore(3)]), SMALL, spark).sum() == 0


def test_tiles_fill_up_on_thin_grids():
    for shape in ((10, 10, 100_000), (100, 1000, 3), (2, 1_000_000), (300, 300), (50, 50, 50)):
        edges = strategies.Tiling.edges(shape)
        assert all(e <= n for e, n in zip(edges, shape)) and 40_000 < np.prod(edges) < 90_000, (shape, edges)


def test_27_points_by_hand(spark):
    a = np.random.default_rng(10).integers(0, 100, (4, 5, 6))
    by_hand = run(lib.Laplacian27ByHand([8, 4, 2, 1]), a, spark)
    assert (by_hand == run(lib.Laplacian27([8, 4, 2, 1], boundary="zero"), a, spark)).all()
    p = (1, 2, 3)
    near = a[0:3, 1:4, 2:5]
    weight = np.array([[[8 >> abs(i) + abs(j) + abs(k) for k in (-1, 0, 1)] for j in (-1, 0, 1)] for i in (-1, 0, 1)])
    assert by_hand[p] == (near * weight).sum()


def test_raw_images(spark, tmp_path):
    pixels = np.random.default_rng(2).integers(0, 256, (3, 5))
    path = tmp_path / "image.raw"
    path.write_bytes(bytes(pixels.reshape(-1).tolist()))
    grid = grids.read_raw(spark, str(path), 5, 3)
    assert (grids.to_array(grid) == pixels).all()
    assert (grids.to_array(grids.read_raw(spark, str(path), 5, 3, transposed=True)) == pixels.T).all()
    grids.write_raw(grid, str(tmp_path / "out.raw"))
    assert (tmp_path / "out.raw").read_bytes() == path.read_bytes()
    scaled = grids.to_array(grids.renormalise(grids.from_array(spark, pixels * 2.0), grid))
    assert (abs(scaled - pixels) <= 1).all()


def test_large_raw_images_are_read_in_pieces(spark, tmp_path):
    pixels = np.random.default_rng(3).integers(0, 256, (1500, 1000)).astype(np.uint8)
    path = tmp_path / "large,image.raw"
    path.write_bytes(pixels.tobytes())
    grid = grids.read_raw(spark, str(path), 1000, 1500)
    assert grid.df.rdd.getNumPartitions() > 1  # not all pixels from one task
    grids.write_raw(grid, str(tmp_path / "out.raw"))
    assert (tmp_path / "out.raw").read_bytes() == path.read_bytes()
    turned = grids.read_raw(spark, str(path), 1000, 1500, transposed=True)
    assert turned.df.rdd.getNumPartitions() > 1 and turned.shape == (1000, 1500)
    grids.write_raw(turned, str(tmp_path / "turned.raw"))
    assert (tmp_path / "turned.raw").read_bytes() == pixels.T.tobytes()


@pytest.mark.parametrize("shape", [(1, 300_000), (300_000, 1), (600, 500)])
def test_raw_images_are_put_in_order_in_blocks(spark, tmp_path, monkeypatch, shape):
    pixels = np.random.default_rng(4).integers(0, 256, shape).astype(np.uint8)
    path = tmp_path / "image.raw"
    path.write_bytes(pixels.tobytes())
    grid = grids.read_raw(spark, str(path), shape[1], shape[0])
    grid.df = grid.df.orderBy(F.rand(5)).withColumn("v", F.col("v").cast("int"))
    sizes = grids.raw_blocks(grid).select("block", F.length("pixels")).orderBy("block").collect()
    assert [tuple(r) for r in sizes] == [(b, min(grids.BLOCK, 300_000 - b * grids.BLOCK)) for b in range(5)]  # no line is a row of its own
    monkeypatch.setattr(grids, "PART", 2 * grids.BLOCK)  # three parts
    grids.write_raw(grid, str(tmp_path / "out.raw"))
    assert (tmp_path / "out.raw").read_bytes() == path.read_bytes()


def test_raw_images_of_no_bytes_are_refused(spark, tmp_path):
    for value in ("256", "-1", "null"):
        df = spark.range(6).selectExpr("id div 3 AS i", "id % 3 AS j", f"if(id = 4, {value}, id) AS v")
        with pytest.raises(Exception, match="from 0 to 255"):
            grids.write_raw(Grid(df, ["i", "j"], "v", (2, 3)), str(tmp_path / "out.raw"))


def test_raw_images_of_other_lengths(spark, tmp_path):
    for length in (0, 1, 14, 16, 31):  # of 15
        path = tmp_path / f"{length}.raw"
        path.write_bytes(bytes(range(200, 200 + length)))
        got = {(r["i"], r["j"]): r["v"] for r in grids.read_raw(spark, str(path), 5, 3).df.collect()}
        assert got == {(n // 5, n % 5): 200 + n for n in range(min(length, 15))}
    for length in (1, 100, 6_000_000, 1_000_003, 2 * 1_000_003):
        assert length % grids._piece(length) == 0 and grids._piece(length) <= grids.MOST_BYTES
    assert 10_000 < grids._piece(6_000_000) < 1_000_000


def test_raw_images_whose_length_has_no_divisor(spark, tmp_path):
    width, height = 1009, 1109  # a last line of one pixel; the length is a prime
    length = width * (height - 1) + 1
    assert grids._piece(length) == 1
    pixels = np.random.default_rng(6).integers(0, 256, length).astype(np.uint8)
    path = tmp_path / "image.raw"
    path.write_bytes(pixels.tobytes())
    grid = grids.read_raw(spark, str(path), width, height)
    pieces = grid.df.select(F.spark_partition_id().alias("task"), (F.col("i") * width + F.col("j")).alias("n"), "v").toPandas()
    assert pieces["task"].nunique() > 1 and len(pieces) == length
    assert (pieces.sort_values("n")["v"].to_numpy() == pixels).all() and sorted(pieces["n"]) == list(range(length))
    assert {p.stat().st_size for p in tmp_path.parent.glob("shared*/**/gridloom-padded-*.raw")} == {-(-length // (1 << 16)) << 16}  # read by pieces of the copy


def test_generated_grids(spark):
    a, b = (grids.to_array(grids.random(spark, (4, 5), 1000, seed=3)) for _ in range(2))
    assert (a == b).all() and a.dtype == np.float32 and 0 <= a.min() and a.max() < 1000 and len(np.unique(a)) > 10
    assert (grids.to_array(grids.constant(spark, (2, 3, 4))) == 1).all()
    rows = spark.createDataFrame([("8x8", "a", 1.0), ("8x8", "a", 3.0)], "shape string, name string, seconds double")
    assert grids.trials(rows).collect()[0][2:] == (2.0, 4.0)
    empty = spark.createDataFrame([("8x8", "a", None)], "shape string, name string, seconds double")
    assert grids.trials(empty, ["a"]).collect()[0][2:] == (0.0, 0.0)
    with pytest.raises(StencilError):
        grids.trials(rows, ["a", "b"])
