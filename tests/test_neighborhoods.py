import itertools

import pytest

from gridloom.functions import neighborhoods as N


def test_moore_and_von_neumann():
    assert N.moore() == sorted(itertools.product((-1, 0, 1), repeat=2))
    assert (0, 0) not in N.moore(1, 2, include_origin=False)
    assert N.von_neumann() == [(-1, 0), (0, -1), (0, 0), (0, 1), (1, 0)]
    assert [len(N.moore(r, d)) for r, d in ((1, 1), (2, 2), (1, 4))] == [3, 25, 81]


@pytest.mark.parametrize("dim", [1, 2, 3, 4])
@pytest.mark.parametrize("radius", [1, 2])
def test_von_neumann_is_a_ball(dim, radius):
    assert N.von_neumann(radius, dim) == [o for o in N.cube(radius, dim) if sum(map(abs, o)) <= radius]


def test_from_matrix():
    offsets, weights, halo = N.from_matrix([[1, 1, 4], [1, 4, 8], [2, 8, 16]])
    assert offsets[0] == (-1, -1) and offsets[-1] == (1, 1) and weights == [1, 1, 4, 1, 4, 8, 2, 8, 16] and halo == ((1, 1), (1, 1))
    offsets, weights, _ = N.from_matrix([[0, 1, 0], [1, 4, 8], [0, 8, 0]])
    assert offsets == [(-1, 0), (0, -1), (0, 0), (0, 1), (1, 0)] and weights == [1, 1, 4, 8, 8]
    assert N.from_matrix([[0, 3]], (0, 0))[0] == [(0, 1)]


def test_halo_flatten_origin_gaussian():
    assert N.halo_of([(-2, 1), (0, -3)]) == (2, 3)
    with pytest.raises(TypeError):
        N.halo_of([])
    assert N.flatten([[1, [2]], (3, 4), []]) == [1, 2, (3, 4)]
    assert N.origin(3) == (0, 0, 0)
    assert N.gaussian(3, 18)[:4] == pytest.approx([0.13298076, 0.12579441, 0.10648267, 0.08065691], abs=1e-8)
    assert N.gaussian(70, 256)[:3] == pytest.approx([0.00569918, 0.00569859, 0.00569685], abs=1e-8)
