"""Properties of shapes: signs, distances against polygons, bounds, round trips, gradients, validation."""

import math

import numpy as np
import pytest

from periodica.ir import col, derivative, evaluate, number
from periodica.operators import polygons as P
from periodica.operators import shapes as S

X, Y = col("x"), col("y")
FIGURES = [
    S.Rectangle((0.1, 0), (1, 0.6), 30, 0.1), S.ConvexQuad((0, 0), (0.5, 0.1), (-0.1, 0.4), 0.2, -0.1, 20, 0.05), S.IsoscelesTrapezoid((0, 0), 1.2, 0.6, 0.8, 15, 0.1), S.Ellipse((0, 0), (1.4, 0.8), 25),
    S.Egg((0, 0), 1, 1.2, 0.3, 10), S.Stadium((0, 0), 1.6, 0.6, 40), S.RegularPolygon((0, 0), 5, 0.8, 10, 0.1), S.Triangle((0, 0), 1.5, 60, 50, 5, 0.1), S.Star((0, 0), 5, 1, 0.45, 7, 0.03, 0.05),
    S.Cross((0, 0), 1.6, 0.4, 20, 0.05, 0.1), S.TShape((0, 0), 1.6, 0.4, 20, 0.05, 0.1), S.Bar(0.1, 0.5, "x"),
]
IDS = [type(f).__name__ for f in FIGURES]


def grid(n=120, r=1.3):
    g = np.linspace(-r, r, n)
    return np.meshgrid(g, g)


def dist(shape, x, y):
    return np.broadcast_to(evaluate([shape.sdf(X, Y)], {"x": np.asarray(x, float), "y": np.asarray(y, float)})[0], np.shape(x))


@pytest.mark.parametrize("f", FIGURES, ids=IDS)
def test_mask_agrees_with_polygon(f):
    x, y = grid()
    assert ((dist(f, x, y) <= 0) == P.shape_region(f).contains(x, y)).mean() > 0.999


@pytest.mark.parametrize("f", FIGURES, ids=IDS)
def test_bounds_hold_the_figure(f):
    x, y = grid(200, 2.0)
    x0, y0, x1, y1 = (float(v) for v in evaluate(list(f.bounds()), {}))
    inside = dist(f, x, y) <= 0
    assert ((x[inside] >= x0 - 1e-6) & (x[inside] <= x1 + 1e-6) & (y[inside] >= y0 - 1e-6) & (y[inside] <= y1 + 1e-6)).all()


@pytest.mark.parametrize("f", FIGURES, ids=IDS)
def test_parametric_round_trip(f):
    again = S.from_parametric(f.to_parametric())
    assert again.to_parametric() == f.to_parametric()
    x, y = grid(16, 1.0)
    np.testing.assert_allclose(dist(again, x, y), dist(f, x, y), atol=1e-12)


@pytest.mark.parametrize("f", FIGURES, ids=IDS)
def test_gradient_matches_central_differences(f):
    x, y = grid(60)
    h = 1e-6
    g = evaluate([derivative(f.sdf(X, Y), X)], {"x": x, "y": y})[0]
    near = (dist(f, x + h, y) - dist(f, x - h, y)) / (2 * h)
    assert (np.abs(np.broadcast_to(g, x.shape) - near) < 1e-3).mean() > 0.99


@pytest.mark.parametrize("f", [f for f in FIGURES if not isinstance(f, (S.Star, S.Egg, S.TShape, S.Cross))], ids=lambda f: type(f).__name__)
def test_distance_outside_matches_outline(f):
    rng = np.random.default_rng(3)
    p = rng.uniform(-1.6, 1.6, (200, 2))
    ring = P.shape_ring(f)
    seg = np.concatenate([ring, np.roll(ring, -1, axis=0)], axis=1)
    true = P.segment_distances(np.concatenate([p, p], axis=1), seg).min(axis=1)
    np.testing.assert_allclose(np.abs(dist(f, p[:, 0], p[:, 1])), true, atol=4e-3)


@pytest.mark.parametrize("args", [(5, 0.5, 0.2, 0.0, 0.0), (5, 1.0, 0.45, 0.1, 0.2), (3, 1.0, 0.3, 0.05, 0.0), (8, 1.0, 0.5, 0.0, 0.05), (5, 1.0, 0.9, 0.0, 0.0), (4, 1.2, 1.0, 0.05, 0.0)])
def test_star_is_the_distance(args):
    n, outer, inner, ro, ri = args
    f = S.Star((0, 0), n, outer, inner, 0.0, ro, ri)
    p = np.random.default_rng(1).uniform(-1.5, 1.5, (300, 2))
    hollow = inner < outer * math.cos(math.pi / n)
    sharp = np.array([[float(v) for v in evaluate(list(c), {})] for c in f.frame()])
    ring = P.round_corners(sharp, ro, "both" if hollow else "outer", 500, ri)
    true = P.segment_distances(np.concatenate([p, p], axis=1), np.concatenate([ring, np.roll(ring, -1, axis=0)], axis=1)).min(axis=1)
    got = dist(f, p[:, 0], p[:, 1])
    np.testing.assert_allclose(np.abs(got), true, atol=1e-6)
    np.testing.assert_array_equal(got <= 0, P.inside_rows(ring[None], p[None])[0])


@pytest.mark.parametrize("axes", [(1.7, 0.9), (1, 1), (0.2, 3), (2, 1e-2), (1, 1.0001)])
def test_ellipse_is_the_distance(axes):
    p = np.concatenate([np.random.default_rng(1).uniform(-2, 2, (300, 2)), [[0, 0], [0.3, 0], [0, 0.2], [0.5 * axes[0], 0]]])
    t = np.linspace(0, 2 * np.pi, 20_001)[:-1]
    ring = 0.5 * np.stack([axes[0] * np.cos(t), axes[1] * np.sin(t)], axis=1)
    true = P.segment_distances(np.concatenate([p, p], axis=1), np.concatenate([ring, np.roll(ring, -1, axis=0)], axis=1)).min(axis=1)
    np.testing.assert_allclose(np.abs(dist(S.Ellipse((0, 0), axes), p[:, 0], p[:, 1])), true, atol=1e-7)


@pytest.mark.parametrize(
    "make",
    [
        lambda: S.Rectangle((0, 0), (0, 1)), lambda: S.Rectangle((0, 0), (1, 1), 0, -1), lambda: S.ConvexQuad((0, 0), (1, 0), (2, 0)), lambda: S.ConvexQuad((0, 0), (1, 0), (0, 1), corner_radius=5),
        lambda: S.IsoscelesTrapezoid((0, 0), 1, 1, 1, corner_radius=1), lambda: S.Ellipse((0, 0), (1, 0)), lambda: S.Egg((0, 0), 1, 1, 1.0), lambda: S.Stadium((0, 0), 1, 2), lambda: S.RegularPolygon((0, 0), 2, 1),
        lambda: S.RegularPolygon((0, 0), 4, 1, corner_radius=0.6), lambda: S.Triangle((0, 0), 1, 90, 90), lambda: S.Triangle((0, 0), 1, 60, 60, corner_radius=1), lambda: S.Star((0, 0), 5, 1, 1), lambda: S.Star((0, 0), 5, 1, 0.5, 0, 0.9),
        lambda: S.Cross((0, 0), 1, 2), lambda: S.TShape((0, 0), 1, 0.3, 0, 0.15), lambda: S.Bar(0, 0), lambda: S.Bar(0, 1, "z"), lambda: S.Union(FIGURES[0], FIGURES[1], True, 0.0), lambda: S.Scale(FIGURES[0], 0),
    ],
)
def test_invalid_parameters(make):
    with pytest.raises(ValueError):
        make()


def test_composition_and_transforms():
    a, b = S.Rectangle((0, 0), (2, 2)), S.Rectangle((1, 0), (2, 2))
    x, y = grid(40, 3)
    da, db = dist(a, x, y), dist(b, x, y)
    np.testing.assert_allclose(dist(a | b, x, y), np.minimum(da, db))
    np.testing.assert_allclose(dist(a & b, x, y), np.maximum(da, db))
    np.testing.assert_allclose(dist(a - b, x, y), np.maximum(da, -db))
    assert (dist(a.union(b, smooth=True, k=0.5), x, y) <= np.minimum(da, db) + 1e-12).all()
    assert (a | b).min_feature_size() is None
    np.testing.assert_allclose(dist(a.translate(0.5, 0.2), x, y), dist(a, x - 0.5, y - 0.2))
    np.testing.assert_allclose(dist(a.scale(2.0), x, y), 2 * dist(a, x / 2, y / 2))
    np.testing.assert_allclose(dist(a.rotate(90.0), x, y), da, atol=1e-12)
    assert number(a.scale(3.0).min_feature_size()) == 6.0
    empty = S.Rectangle((0, 0), (1, 1)) & S.Rectangle((5, 0), (1, 1))
    assert S.is_empty(empty.bounds()) and S.is_empty(empty.rotate(30).bounds()) and S.is_empty(empty.scale(2).bounds()) and S.is_empty(empty.translate(1, 1).bounds())


def test_endless_shapes_do_not_rotate():
    bar = S.Bar(0, 0.4)
    with pytest.raises(NotImplementedError):
        bar.rotate(10)
    with pytest.raises(NotImplementedError):
        S.Rotate(bar | S.Rectangle((0, 0), (1, 1)), 10)


def test_registry():
    with pytest.raises(ValueError):
        S.register_shape("Rectangle")(type("Other", (S.Primitive,), {}))
    with pytest.raises(ValueError):
        S.from_parametric({"type": "Nothing"})
    assert len([c for c in S.SHAPES.values() if issubclass(c, S.Primitive)]) == 12


def test_feature_sizes():
    assert math.isclose(number(S.Egg((0, 0), 1, 1).min_feature_size()), 0.5)
    assert math.isclose(number(S.RegularPolygon((0, 0), 4, 0.5).min_feature_size()), 0.5)
    assert math.isclose(number(S.ConvexQuad((0, 0), (0.4, 0), (0, 0.3), corner_radius=0.1).min_feature_size()), 0.4)
