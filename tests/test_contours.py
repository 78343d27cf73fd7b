"""Outlines of masks and GDSII streams."""

import math

import numpy as np
import pytest

from periodica.sources import contours as C


def test_disc_with_hole():
    y, x = np.mgrid[0:80, 0:80]
    d = np.hypot(x - 40, y - 40)
    found = C.polygons_of(((d < 30) & (d > 12)).astype(float))
    assert len(found) == 1 and len(found[0][1]) == 1
    outer, (hole,) = found[0]
    assert abs(abs(C.ring_area(outer)) - math.pi * 900) < 60 and abs(abs(C.ring_area(hole)) - math.pi * 144) < 40
    fine = C.polygons_of(30 - d, level=0.0)[0][0]
    assert abs(abs(C.ring_area(fine)) - math.pi * 900) < 6
    few = C.polygons_of(30 - d, level=0.0, tolerance=0.5)[0][0]
    assert len(few) < len(fine) / 3 and abs(C.ring_area(few) / C.ring_area(fine) - 1) < 0.03


def test_border_islands_and_empty():
    m = np.zeros((20, 20))
    assert C.polygons_of(m) == []
    m[:5, :5] = 1
    m[10:15, 10:15] = 1
    m[15:18, 15:18] = 1
    assert len(C.polygons_of(m)) == 3
    full = C.polygons_of(np.ones((4, 4)))
    assert len(full) == 1 and full[0][1] == []


def test_distances_of_masks():
    rng = np.random.default_rng(3)
    m = rng.random((13, 9)) < 0.15
    y, x = np.nonzero(m)
    gy, gx = np.mgrid[0:13, 0:9]
    want = np.sqrt(((gy[..., None] - y) ** 2 + (gx[..., None] - x) ** 2).min(axis=-1))
    np.testing.assert_allclose(C.nearest_set(m), want)
    d = C.signed_distance(m)
    assert (d[m] >= 1).all() and (d[~m] <= -1).all()
    assert np.isinf(C.nearest_set(np.zeros((3, 2), bool))).all()


def test_smoothing():
    flat = np.full((5, 7), 2.5)
    np.testing.assert_allclose(C.smoothed(flat, 0.6), flat)
    spike = np.zeros((21, 21))
    spike[10, 10] = 1.0
    out = C.smoothed(spike, 1.0)
    assert math.isclose(out.sum(), 1.0) and math.isclose(out[10, 11] / out[10, 10], math.exp(-0.5)) and np.allclose(out, out.T)
    with pytest.raises(ValueError):
        C.smoothed(flat, 0.0)


def test_polygons_of_masks():
    y, x = np.mgrid[0:60, 0:60]
    d = np.hypot(x - 30, y - 30)
    m = (d < 22) & (d > 9)
    for sigma in (None, 0.6):
        ((outer, (hole,)),) = C.mask_polygons(m, sigma=sigma)
        assert abs(abs(C.ring_area(outer)) / (math.pi * 22**2) - 1) < 0.05 and abs(abs(C.ring_area(hole)) / (math.pi * 9**2) - 1) < 0.1
    assert C.mask_polygons(np.zeros((4, 4))) == [] and len(C.mask_polygons(np.ones((4, 4)))) == 1


def test_tables_of_masks_and_layouts(spark):
    df = spark.createDataFrame([(1, [[True, True], [True, False]]), (2, None), (3, []), (4, [[False, False]])], "id int, mask array<array<boolean>>")
    got = C.mask_outlines(df, "id", "mask", distance=False, tolerance=0.0).collect()
    assert [(r.id, r.part, r.hole) for r in got] == [(1, 0, False)]
    assert C.mask_outlines(df.limit(0), "id", "mask").count() == 0
    rings = spark.createDataFrame([("a", [(0.0, 0.0), (1.0, 0.0), (1.0, 2.0)]), ("a", None), ("b", None)], "k string, ring array<struct<x:double,y:double>>")
    back = C.gds_rings(C.gds_streams(rings, "k", "ring", layer=5), "k", "gds").collect()
    assert [(r.k, r.i, r.layer, [tuple(p) for p in r.ring]) for r in back] == [("a", 0, 5, [(0.0, 0.0), (1.0, 0.0), (1.0, 2.0)])]


def test_gds_round_trip():
    rings = [np.array([[0.0, 0.0], [1.5, 0.25], [1.0, 2.0]]), np.array([[-3.0, -1.0], [-2.0, -1.0], [-2.0, 1.125], [-3.0, 1.0]])]
    data = C.dump_gds(rings, layer=7)
    back = C.load_gds(data)
    assert [layer for layer, _ in back] == [7, 7]
    for (_, a), b in zip(back, rings, strict=True):
        np.testing.assert_allclose(a, b, atol=1e-3)
    for v in (1e-3, 1e-9, 1.0, -2.5, 0.0):
        assert math.isclose(C._read_real(C._real(v)), v, rel_tol=1e-14)
    with pytest.raises(ValueError):
        C.load_gds(b"nothing at all")
    with pytest.raises(ValueError):
        C.load_gds(data[:-4])
    with pytest.raises(ValueError):
        C.dump_gds([np.zeros((2, 2))])


def test_masks_that_recur_are_outlined_once(spark, monkeypatch):
    """A task remembers outlines, also where there are more kinds of masks than it keeps; rows are dealt over tasks."""
    monkeypatch.setattr(C, "MOST_KNOWN", 5)
    seen, real = [], C.mask_polygons
    monkeypatch.setattr(C, "mask_polygons", lambda m, *how: seen.append(m.shape) or real(m, *how))
    df = spark.range(60).selectExpr("id", "transform(sequence(0, 3 + CAST(id % 2 AS INT)), y -> transform(sequence(0, 4), x -> x >= 1 AND x <= 1 + (id DIV 20) AND y = 1)) AS mask").coalesce(1)
    assert C.mask_outlines(df, "id", "mask").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    taken = []
    monkeypatch.setattr(type(df), "mapInPandas", lambda self, f, schema: taken.append([(r.id, r.part, r.hole, len(r.ring)) for out in f(iter([self.orderBy("id").toPandas()])) for r in out.itertuples()]) or self)
    C.mask_outlines(df, "id", "mask", distance=False, tolerance=0.0)
    assert [t[0] for t in taken[0]] == list(range(60)) and 6 <= len(seen) <= 8
    assert [t[3] for t in taken[0]] == [(4, 6, 6)[i // 20] for i in range(60)]
