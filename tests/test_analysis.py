"""Polygons, metrics, constraints, duplicates, generation, reports and cell files."""

import json
import math

import numpy as np
import pytest

from periodica.operators import analysis as A
from periodica.operators import generate as G
from periodica.operators import polygons as P
from periodica.operators import shapes as S
from periodica.operators.lattice import Lattice, UnitCell
from periodica.sources import cells as C

SQ = lambda x, w=2.0: S.Rectangle((x, 0), (w, w))


def test_boolean_areas():
    for shape, area in ((SQ(0) | SQ(1), 6), (SQ(0) & SQ(1), 2), (SQ(0) - SQ(1), 2), (SQ(-2, 1.0) | SQ(2, 1.0), 2)):
        assert math.isclose(P.shape_region(shape).area(), area, abs_tol=1e-9)
    assert P.shape_region(SQ(-2, 1.0) & SQ(2, 1.0)).is_empty()
    assert np.allclose(P.shape_region(SQ(0) | SQ(1)).centroid(), (0.5, 0))


def test_random_booleans_against_points():
    rng = np.random.default_rng(0)
    for _ in range(6):
        a, b = (S.Star(tuple(rng.uniform(-0.3, 0.3, 2)), int(rng.integers(3, 7)), 1.0, 0.5, float(rng.uniform(0, 90))) for _ in range(2))
        for s in (a | b, a & b, a - b):
            g = np.linspace(-1.6, 1.6, 500)
            x, y = np.meshgrid(g, g)
            r = P.shape_region(s)
            assert abs(r.contains(x[::9, ::9], y[::9, ::9]).mean() * 3.2**2 - r.area()) < 0.15


def test_holes_and_parts():
    ring = S.Rectangle((0, 0), (4, 4)) - S.Rectangle((0, 0), (2, 2))
    r = P.shape_region(ring)
    assert math.isclose(r.area(), 12) and math.isclose(r.largest_without_holes().area(), 16)
    two = P.shape_region(SQ(-3) | SQ(3, 1.0))
    assert [round(p.area(), 9) for p in two.parts()] == [4.0, 1.0]


def test_distance_and_rounding():
    a, b = P.shape_region(S.Rectangle((0, 0), (1, 1))), P.shape_region(S.Rectangle((3, 1), (1, 1)))
    assert math.isclose(a.distance(b), 2.0) and a.distance(a) == 0.0
    inner = P.shape_region(S.Rectangle((0, 0), (0.2, 0.2)))
    assert a.distance(inner) == 0.0
    sq = np.array([[0, 0], [1, 0], [1, 1], [0, 1]], float)
    assert P.round_corners(sq, 0.0) is not None and len(P.round_corners(sq, 0.0)) == 4
    assert abs(abs(P.ring_area(P.round_corners(sq, 0.2))) - (1 - 0.04 * (4 - math.pi))) < 1e-3
    with pytest.raises(ValueError):
        P.round_corners(sq, -1)
    with pytest.raises(ValueError):
        P.round_corners(sq, 1, "sideways")


def test_min_gap():
    two = S.Rectangle((-0.3, 0), (0.2, 0.2)) | S.Rectangle((0.3, 0), (0.2, 0.2))
    assert math.isclose(A.min_gap(UnitCell(Lattice.rectangular(2, 2), two)), 0.4, abs_tol=1e-9)
    assert math.isclose(A.min_gap(UnitCell(Lattice.rectangular(1, 1), S.Bar(0, 0.3))), 0.7, abs_tol=1e-9)


def test_analyze_and_check(spark):
    cells = [UnitCell(Lattice.rectangular(2, 2), S.Rectangle((1, 1), (0.5, 0.5))), UnitCell(Lattice.rectangular(2, 2), S.Rectangle((1, 1), (1.9, 0.5)))]
    df = spark.createDataFrame([(i, json.dumps(c.to_parametric())) for i, c in enumerate(cells)], "cell_id long, cell string")
    m = A.analyze(df)
    rows = A.check(m, A.Constraints(max_fill=0.1, min_gap=0.2, min_feature_size=0.1)).orderBy("cell_id").collect()
    assert rows[0].failures == [] and rows[0].failure is None
    assert [f.split()[0] for f in rows[1].failures] == ["fill_fraction", "min_gap"] and rows[1].failure.startswith("fill_fraction 0.2")
    assert A.analyze(df.limit(0)).count() == 0


def test_duplicates(spark):
    r1, r2 = UnitCell(Lattice.rectangular(2, 2), S.Rectangle((1, 1), (0.4, 0.4))), UnitCell(Lattice.rectangular(2, 2), S.Rectangle((1, 1), (0.8, 0.4)))
    df = spark.createDataFrame([(i, A.fingerprint(c)) for i, c in enumerate((r1, r2, r1))], "cell_id long, fp array<float>")
    assert [tuple(r) for r in A.duplicate_pairs(df).collect()] == [(0, 2)]
    assert sorted(tuple(r) for r in A.duplicate_groups(df).collect()) == [(0, 0), (0, 2)]
    assert A.duplicate_groups(df.where("cell_id < 2")).count() == 0


def test_duplicate_pairs_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    v = rng.uniform(0, 1, (60, 8)).astype(np.float32)
    v[10:20] = v[:10] + rng.uniform(-0.1, 0.1, (10, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "cell_id long, fp array<float>")
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if np.abs(v[i].astype(float) - v[j]).max() <= 0.2}
    assert {tuple(r) for r in A.duplicate_pairs(df, 0.2).collect()} == want


def test_equal_cells_make_no_pairs(spark):
    """A print that most rows share is one class, however many have it."""
    rows = [(i, [0.5, 0.25]) for i in range(400)] + [(400, [0.5004, 0.25]), (401, [9.0, 0.0]), (402, None), (403, [])]
    df = spark.createDataFrame(rows, "cell_id long, fp array<float>")
    assert sorted(tuple(r) for r in A.duplicate_pairs(df).collect()) == [(0, i) for i in range(1, 401)]
    assert sorted(tuple(r) for r in A.duplicate_groups(df).collect()) == [(0, i) for i in range(401)]
    assert A.duplicate_groups(df.limit(0)).count() == 0


def test_rows_of_one_structure_equal_single_cells(spark):
    rng = np.random.default_rng(3)

    def cell(i):
        u = lambda a, b: float(rng.uniform(a, b))
        scene = S.Rectangle((u(0, 5), u(0, 5)), (u(0.3, 2), u(0.3, 1)), u(0, 360), 0.05 * (i % 2)) | S.Ellipse((u(0, 5), u(0, 5)), (1.2, 0.6), u(0, 90)).translate(u(0, 1), 0.5) | S.Star((u(0, 5), u(0, 5)), 5, 0.8, 0.4).scale(u(0.5, 1))
        scene = scene | S.Bar(u(0, 4), 0.2, "x") if i % 3 else scene | (S.Rectangle((1, 1), (1, 1)) - S.Rectangle((1, 1), (0.5, 2)))
        return UnitCell(Lattice((u(4, 6), 0.2), (0.4, u(4, 6))), scene)

    cells = [cell(i) for i in range(12)]
    df = spark.createDataFrame([(i, json.dumps(c.to_parametric())) for i, c in enumerate(cells)] + [(99, None)], "cell_id long, cell string")
    got = {r.cell_id: r for r in A.analyze(df).collect()}
    assert got[99].fill_fraction is None and got[99].num_shapes is None
    for i, c in enumerate(cells):
        want = A.metrics(c)
        assert (got[i].num_shapes, got[i].fill_fraction) == (want["num_shapes"], want["fill_fraction"])
        np.testing.assert_allclose(got[i].shape_areas, want["shape_areas"], atol=1e-7)
        np.testing.assert_allclose([tuple(x) for x in got[i].shape_bbox_sizes], [tuple(x.values()) for x in want["shape_bbox_sizes"]], atol=1e-9)
        assert math.isclose(got[i].min_feature_size or 0, want["min_feature_size"] or 0) and math.isclose(got[i].min_gap, want["min_gap"], abs_tol=1e-9)


def test_areas_by_row_equal_regions(spark):
    from periodica.ir import col

    rng = np.random.default_rng(0)
    n = 60
    env = {k: rng.uniform(0.2, 2, n) for k in "wh"} | {"ax": rng.uniform(-1, 1, n), "an": rng.uniform(0, 360, n)}
    a, b = S.Rectangle((col("ax"), 0.1), (col("w"), col("h")), col("an"), 0.05), S.Star((0.3, 0.2), 5, 1.0, 0.45, col("an"), 0.02, 0.03)
    for scene in (a | b, a & b, (a - b) | S.Ellipse((0, 0), (0.5, 0.3)).rotate(20.0)):
        rings: list = []
        f = P.scene_rows(scene, env, n, rings)
        np.testing.assert_allclose(P.area_rows(rings, f), [P.compose([r[i] for r in rings], f).area() for i in range(n)], atol=1e-12)


def test_nodes_to_cells(spark):
    rows = [(1, 1, None, "Union", None), (1, 2, 1, "Translate", '{"dx": 1.0, "dy": 0.0}'), (1, 3, 2, "Rectangle", '{"center": [0, 0], "size": [1, 1]}'), (1, 4, 2, "Rectangle", '{"center": [0, 3], "size": [1, 2]}'), (1, 5, 1, "Difference", None), (1, 6, 5, "Ellipse", '{"center": [0, 0], "axes": [1, 1]}'), (1, 7, 5, "Bar", '{"offset": 0.1, "width": 0.1}'), (2, 9, 77, "Bar", '{"width": 0.2}')]
    nodes = spark.createDataFrame(rows, "cell_id long, node_id int, parent_id int, type string, params string")
    cells = A.cells_from_nodes(nodes, Lattice.rectangular(5, 5))
    scene = S.Translate(S.Rectangle((0, 0), (1, 1)) | S.Rectangle((0, 3), (1, 2)), 1.0, 0.0) | (S.Ellipse((0, 0), (1, 1)) - S.Bar(0.1, 0.1))
    got = {r.cell_id: UnitCell.from_parametric(json.loads(r.cell)).scene.to_parametric() for r in cells.collect()}
    assert got == {1: scene.to_parametric(), 2: S.Bar(0.0, 0.2).to_parametric()}
    assert sorted((r.cell_id, r.ord, r.type) for r in A.leaf_rows(cells).collect()) == [(1, 0, "Translate"), (1, 1, "Translate"), (1, 2, "Difference"), (2, 0, "Bar")]


def test_union_of_many_figures(spark):
    from periodica.ir import col, evaluate
    from periodica.operators.nearest import union_distances

    rng = np.random.default_rng(1)
    figs = [(i, float(x), float(y), float(w)) for i, (x, y, w) in enumerate(zip(*rng.uniform(-9, 9, (2, 900)), rng.uniform(0.01, 4, 900), strict=True))]
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-12, 12, (150, 2)))]
    shape = S.Rectangle((col("cx"), col("cy")), (col("w"), 0.3))
    points, figures = spark.createDataFrame(pts, "pt long, x double, y double"), spark.createDataFrame(figs, "f long, cx double, cy double, w double")
    got = {r.pt: r.sdf for r in union_distances(points, figures, shape).collect()}
    env = {k: np.array([f[j] for f in figs]) for j, k in ((1, "cx"), (2, "cy"), (3, "w"))}
    for i, x, y in pts:
        assert abs(got[i] - evaluate([shape.sdf(x, y)], env)[0].min()) < 1e-12
    assert {r.sdf for r in union_distances(points, figures.limit(0), shape).collect()} == {None}


def test_own_attempt(spark):
    """The hook for generators of one's own."""

    def squares(config, lattice, rng):
        side = float(rng.uniform(-0.2, 0.5))
        if side <= 0.1:
            raise RuntimeError("too small")
        return UnitCell(lattice, S.Rectangle((1, 1), (side, side)))

    rows = G.generate(spark, G.Config(seed=3, target_count=8, max_tries_per_cell=50), Lattice.rectangular(3, 3), attempt_one=squares).collect()
    assert all(json.loads(r.cell)["scene"]["type"] == "Rectangle" for r in rows)
    assert sum(r.reasons.get("too small", 0) for r in rows) == sum(r.attempts - 1 for r in rows) > 0


def test_generation_is_reproducible(spark):
    cfg = G.Config(seed=3, target_count=6, allowed_shapes=("Rectangle", "Ellipse"), min_gap=0.05)
    one = G.generate(spark, cfg, Lattice.rectangular(3, 3)).orderBy("cell_id").collect()
    two = G.generate(spark, cfg, Lattice.rectangular(3, 3)).repartition(5).orderBy("cell_id").collect()
    assert one == two
    other = G.generate(spark, G.Config(seed=4, target_count=6, allowed_shapes=("Rectangle", "Ellipse")), Lattice.rectangular(3, 3)).orderBy("cell_id").collect()
    assert [r.cell for r in one] != [r.cell for r in other]
    for r in one:
        if r.cell:
            assert A.min_gap(UnitCell.from_parametric(json.loads(r.cell))) > 0.05
    rep = G.report(spark.createDataFrame(one, G.CELLS_SCHEMA)).first()
    assert rep.generated + rep.failed == rep.requested == 6 and sum(rep.failure_reasons.values()) == rep.total_attempts - rep.generated


@pytest.mark.parametrize("name", sorted(G.SAMPLERS))
def test_every_sampler(name):
    cell, _, _ = G.make_cell(0, G.Config(seed=5, allowed_shapes=(name,), fixed_num_shapes=1), Lattice.rectangular(3, 3))
    assert type(S.leaves(cell.scene)[0]).__name__ == name


def test_generation_failures():
    cell, attempts, why = G.make_cell(0, G.Config(seed=1, fixed_num_shapes=0, max_tries_per_cell=3), Lattice.rectangular(3, 3))
    assert cell is None and attempts == 3 and dict(why) == {"No shapes to combine": 3}
    _, _, why = G.make_cell(0, G.Config(seed=1, allowed_shapes=("Nothing",), max_tries_per_cell=2), Lattice.rectangular(3, 3))
    assert len(why) == 1
    _, _, why = G.make_cell(0, G.Config(seed=1, allowed_shapes=("Rectangle",), min_shape_size=9.0, max_tries_per_cell=2), Lattice.rectangular(3, 3))
    assert next(iter(why)).startswith(("incompatible", "invalid"))
    with pytest.raises(ValueError):
        G.make_cell(0, G.Config(seed=1, allowed_shapes=("Rectangle",), shape_weights={"Rectangle": 0.0}), Lattice.rectangular(3, 3))


@pytest.mark.parametrize(
    "bad",
    [
        dict(target_count=0), dict(max_tries_per_cell=0), dict(max_tries_per_shape=0), dict(fixed_num_shapes=-1), dict(min_num_shapes=-1), dict(max_num_shapes=-1), dict(min_num_shapes=4, max_num_shapes=2), dict(shape_weights={"Bar": -1}),
        dict(min_shape_size=-1), dict(min_feature_size=-1), dict(min_gap=-1), dict(fixed_lattice_L=0), dict(lattice_L_range=(2, 1)), dict(fixed_lattice_Lx=0), dict(fixed_lattice_Ly=-1), dict(lattice_Lx_range=(0, 1)), dict(lattice_Ly_range=(3, 1)),
    ],
)
def test_config_checks(bad):
    with pytest.raises(ValueError):
        G.Config(**bad)


def test_lattice_sampling():
    rng = np.random.default_rng(0)
    from periodica.ir import evaluate

    hexa = G.sample_lattice(G.Config(fixed_lattice_L=2.0, fixed_lattice_Lx=9.0), Lattice.hexagonal(1.0), rng)
    assert np.allclose(evaluate([*hexa.a1, *hexa.a2], {}), [2, 0, 1, math.sqrt(3)])
    rect = G.sample_lattice(G.Config(fixed_lattice_Ly=5.0), Lattice.rectangular(1, 2), rng)
    assert np.allclose(evaluate([*rect.a1, *rect.a2], {}), [1, 0, 0, 5])


def test_ranges():
    assert G.intersect((0, 2), None, (1, 3)) == (1, 2) and G.intersect(None) is None
    for bad in (((0, 1), (2, 3)), ((3, 1),)):
        with pytest.raises(ValueError):
            G.intersect(*bad)


def test_merge_reports(spark):
    rows = [(10, 2, 8, 12, {"gap": 2}, {"fill_fraction": (0.2, 0.8)}, '{"seed": 42}'), (5, 5, 0, 6, {"gap": 1, "empty": 3}, {"fill_fraction": (0.1, 0.5)}, "{}")]
    df = spark.createDataFrame(rows, "requested long, generated long, failed long, total_attempts long, failure_reasons map<string,long>, parameter_ranges map<string,struct<lo:double,hi:double>>, metadata string")
    m = G.merge_reports(df).first()
    assert (m.requested, m.generated, m.failed, m.total_attempts) == (15, 7, 8, 18) and m.failure_reasons == {"gap": 3, "empty": 3}
    assert tuple(m.parameter_ranges["fill_fraction"]) == (0.1, 0.8) and json.loads(m.metadata)["runs"]
    assert G.merge_reports(df.limit(1)).first().requested == 10
    with pytest.raises(ValueError):
        G.merge_reports(df.limit(0))


def test_cell_files(spark, tmp_path):
    cell = UnitCell(Lattice.rectangular(2, 2), S.Rectangle((0, 0), (0.5, 0.3)).translate(0.3, 0) | S.Ellipse((0, 0), (0.6, 0.4)))
    report = {"requested": 10, "generated": 2, "parameter_ranges": {"side_length": (0.2, 0.8)}, "metadata": {"seed": 42}}
    text = C.dump_cells([cell], report)
    cells, rep = C.load_document(text)
    assert cells[0].to_parametric() == cell.to_parametric() and rep["parameter_ranges"] == {"side_length": (0.2, 0.8)}
    with pytest.raises(ValueError):
        C.load_document(text.replace("version: '1'", "version: '2'"))
    (tmp_path / "a.yaml").write_text(text)
    assert C.read_cells(spark, str(tmp_path)).count() == 1
    spark.dataSource.register(C.CellsYaml)
    back = spark.read.format("cells_yaml").load(str(tmp_path))
    assert json.loads(back.first().cell) == cell.to_parametric()
    back.write.format("cells_yaml").mode("append").save(str(tmp_path / "out"))
    assert spark.read.format("cells_yaml").load(str(tmp_path / "out")).count() == 1


def test_printed_figures_round_as_c_does(spark):
    """Ties of the exact binary value go to the even digit, and what only looks like a tie in decimals is none."""
    values = [0.0625, 0.1875, 1.0005, 2.0005, 0.00015, 0.99995, 0.0, 12.34565, 1e16, -0.0625]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (3, 4):
        got = [r.t for r in df.select(A.F.format_string(f"%.{digits}f", A.printable(A.F.col("v"), digits)).alias("t")).collect()]
        assert got == [f"%.{digits}f" % v for v in values]
    m = spark.createDataFrame([(1, 0.0625, 1, 0.5, 0.5, [(0.00015, 1.0)])], "cell_id int, fill_fraction double, num_shapes int, min_feature_size double, min_gap double, shape_bbox_sizes array<struct<w:double,h:double>>")
    r = A.check(m, A.Constraints(min_fill=0.08, min_shape_size=0.7)).first()
    assert r.failures == ["fill_fraction 0.062 < min_fill 0.08", "shape 0 size (%.4f, 1.0000) < min_shape_size 0.7" % 0.00015] and r.failure == r.failures[0]


def test_ring_columns_of_odd_rings(spark):
    """Measures of rings of many lengths equal those of single rings; nulls within a ring or point, empty and flat rings have a defined result."""
    rng = np.random.default_rng(4)
    rings = [rng.uniform(-1, 1, (int(k), 2)) for k in rng.integers(3, 9, 50)]
    rows = [(i, [tuple(p) for p in r.tolist()], 0.1, -0.2) for i, r in enumerate(rings)]
    odd = [(50, None, 0.0, 0.0), (51, [], 0.0, 0.0), (52, [(0.0, 0.0), (1.0, 0.0), None], 0.0, 0.0), (53, [(0.0, 0.0), (1.0, 0.0), (2.0, 0.0)], 0.5, 0.0), (54, [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)], None, 0.0), (55, [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)], 1.0, 0.5)]
    df = spark.createDataFrame(rows + odd, "i int, ring array<struct<x:double,y:double>>, x double, y double").repartition(3)
    F = A.F
    c = F.col("ring")
    got = {r.i: r for r in df.select("i", P.area_column(c).alias("a"), P.centroid_column(c).alias("c"), P.contains_column(c, F.col("x"), F.col("y")).alias("n"), P.covers_column(c, F.col("x"), F.col("y")).alias("v")).collect()}
    for i, r in enumerate(rings):
        n = np.roll(r, -1, axis=0)
        cross = r[:, 0] * n[:, 1] - n[:, 0] * r[:, 1]
        assert math.isclose(got[i].a, abs(P.ring_area(r)), abs_tol=1e-12) and got[i].n == got[i].v == bool(P.inside_rows(r[None], np.array([[[0.1, -0.2]]]))[0, 0])
        np.testing.assert_allclose(tuple(got[i].c), ((r + n) * cross[:, None]).sum(axis=0) / (3 * cross.sum()), rtol=1e-9)
    assert [(got[i].a, tuple(got[i].c), got[i].n, got[i].v) for i in range(50, 56)] == [(None, (None, None), None, None), (0.0, (None, None), False, False), (None, (None, None), None, None), (0.0, (None, None), False, True), (0.5, (2 / 3, 1 / 3), False, None), (0.5, (2 / 3, 1 / 3), False, True)]


def test_outline_areas_measure_equal_rows_once(spark, monkeypatch):
    from periodica.ir import col

    seen = []
    real = P.ring_rows
    monkeypatch.setattr(P, "ring_rows", lambda s, env, n: seen.append(n) or real(s, env, n))
    figures = {"star": S.Star((0.1, 0.2), 5, col("a"), 0.45, 0.0, 0.02, 0.03), "egg": S.Egg((0.0, 0.0), col("a"), 1.5, 0.3)}
    df = spark.range(3000).selectExpr("id", "1D + id % 7 / 10D AS a")
    run = lambda self, f, schema: spark.createDataFrame([r for out in f(iter(self.toArrow().combine_chunks().to_batches())) for r in out.to_pylist()], schema)
    monkeypatch.setattr(type(df), "mapInArrow", run)
    got = {(r.id, r.shape): r.area for r in P.outline_areas(df, figures, "id").collect()}
    assert sum(seen) == 14 and len(got) == 6000
    for (i, name), area in list(got.items())[::97]:
        assert math.isclose(area, abs(P.ring_area(real(figures[name], {"a": np.array([1 + i % 7 / 10])}, 1)[0])), rel_tol=1e-12)


def test_scenes_are_put_together_in_batches(spark):
    """No frame for each cell, and nodes in any order, repeated parents and missing ones as before."""
    rows = [(c, n, p, t, q) for c in range(300) for n, p, t, q in ((3, 2, "Rectangle", '{"center": [0, 1], "size": [1, 1]}'), (2, None, "Translate", '{"dx": 1.0, "dy": 0.0}'), (9, 77, "Bar", '{"width": 0.2}'))]
    cells = A.cells_from_nodes(spark.createDataFrame(rows, "cell_id long, node_id int, parent_id int, type string, params string").repartition(4), Lattice.rectangular(5, 5))
    plan = cells._jdf.queryExecution().toString()
    assert "FlatMapGroups" not in plan and "ArrowEvalPython" in plan
    want = (S.Rectangle((0, 1), (1, 1)).translate(1.0, 0.0) | S.Bar(0.0, 0.2)).to_parametric()
    got = cells.collect()
    assert len(got) == 300 and all(UnitCell.from_parametric(json.loads(r.cell)).scene.to_parametric() == want for r in got)


def test_prints_are_made_twice_at_most(spark):
    made = spark.sparkContext.accumulator(0)

    def rows(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    df = spark.createDataFrame([(i, [i // 4 / 1000.0, 0.5]) for i in range(80)], "cell_id long, fp array<float>").mapInArrow(rows, "cell_id long, fp array<float>")
    pairs = A.duplicate_pairs(df, 1.5e-3)
    assert len(pairs.collect()) == 60 + 19 and made.value == 160
    assert A.duplicate_groups(df, 1.5e-3).count() == 80 and made.value == 320


def test_equal_cells_share_a_raster(spark, monkeypatch):
    from periodica.ir import col
    from periodica.operators import lattice as L

    seen, real = [], L.CopyRows.rasters
    monkeypatch.setattr(L.CopyRows, "rasters", lambda self, cell, env, rows, n, make: seen.append(rows) or real(self, cell, env, rows, n, make))
    df = spark.range(500).selectExpr("id AS cell_id", "0.5D + id % 5 / 10D AS w")
    run = lambda self, f, schema: [r for out in f(iter([b for b in self.toArrow().to_batches(100)])) for r in out.to_pylist()]
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, schema: spark.createDataFrame(run(self, f, schema), schema))
    got = L.raster_prints(df, UnitCell(Lattice.rectangular(3, 2), S.Rectangle((1.5, 1.0), (col("w"), 0.5))), 8).collect()
    assert sum(seen) == 5 and len(got) == 500 and len({(r.cell_id % 5, tuple(r.fp)) for r in got}) == 5


def test_cell_areas_take_copies_that_reach_the_cell(spark, monkeypatch):
    """Areas equal those over all copies, and far figures, wide ones, stripes and differences take only copies that meet the cell."""
    from periodica.ir import col

    rng = np.random.default_rng(6)
    rows = [(i, float(x), float(y), float(w), float(t)) for i, (x, y, w, t) in enumerate(zip(*rng.uniform(-20, 20, (2, 30)), rng.uniform(0.2, 7, 30), rng.uniform(0, 360, 30), strict=True))]
    df = spark.createDataFrame(rows, "id int, x double, y double, w double, t double")
    box = S.Rectangle((col("x"), col("y")), (col("w"), 0.7), col("t"))
    spans, real = [], P.cell_rows
    monkeypatch.setattr(P, "cell_rows", lambda cell, env, n, span: spans.append((n, (span[1] - span[0] + 1) * (span[3] - span[2] + 1))) or real(cell, env, n, span))
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, schema: spark.createDataFrame([r for out in f(iter(self.toArrow().combine_chunks().to_batches())) for r in out.to_pylist()], schema))
    for lat in (Lattice.hexagonal(3.0), Lattice.rectangular(2.0, 5.0), Lattice((-2.0, 0.3), (0.5, 3.0))):
        for scene in (box, box - S.Ellipse((col("x"), col("y")), (0.5, 0.4)), box | S.Bar(0.2, 0.4, "x")):
            if isinstance(scene, S.Union) and lat.a1[1] is not S.lift(0.0):
                continue
            got = {r.id: r.area for r in P.cell_areas(df, UnitCell(lat, scene), "id").collect()}
            for i, x, y, w, t in rows[::6]:
                own = S.Rectangle((x, y), (w, 0.7), t)
                whole = own if scene is box else own - S.Ellipse((x, y), (0.5, 0.4)) if isinstance(scene, S.Difference) else own | S.Bar(0.2, 0.4, "x")
                assert math.isclose(got[i], P.cell_region(UnitCell(lat, whole)).area(), abs_tol=1e-8)
    spans.clear()
    P.cell_areas(df.selectExpr("id", "x", "y", "0.5D AS w", "t"), UnitCell(Lattice.hexagonal(6.0), box), "id").collect()
    assert sum(n for n, _ in spans) == 30 and all(k <= 4 for _, k in spans)


def test_largest_parts_of_nested_rings_are_measured_together(spark, monkeypatch):
    """Rings apart from each other are measured by kind, others composed one by one; all equal the regions' areas."""
    from periodica.ir import col

    rng = np.random.default_rng(8)
    rows = [(i, float(x), float(w), float(t)) for i, (x, w, t) in enumerate(zip(rng.uniform(-2.5, 2.5, 60), rng.uniform(0.2, 2.5, 60), rng.uniform(0, 360, 60), strict=True))]
    df = spark.createDataFrame(rows, "id int, x double, w double, t double")
    calls, real = [], P.compose
    monkeypatch.setattr(P, "compose", lambda rings, inside: calls.append(1) or real(rings, inside))
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, schema: spark.createDataFrame([r for out in f(iter(self.toArrow().combine_chunks().to_batches())) for r in out.to_pylist()], schema))
    x, w, t = map(col, "xwt")
    hole, far = S.Rectangle((x, 0.1), (w, 0.3), t), S.Rectangle((20.0, 0.0), (1.5, 1.6))
    scenes = [(S.Rectangle((0, 0), (2.0, 2.0)) - hole) | far, ((S.Rectangle((0, 0), (9.0, 9.0)) - S.Rectangle((0, 0), (6.0, 6.0))) | S.Ellipse((x, 0), (w, 0.5), t)) - S.Rectangle((0, 0), (0.1, 0.1)), S.Star((x, 0.0), 5, 1.0, 0.4) - hole, S.Rectangle((0, 0), (1, 1)) & far, hole & S.Rectangle((0, 0), (2.0, 2.0))]
    for scene in scenes:
        rings: list = []
        env = {k: np.array([r[j] for r in rows]) for j, k in ((1, "x"), (2, "w"), (3, "t"))}
        inside = P.scene_rows(scene, env, len(rows), rings)
        regions = [real([r[k if len(r) > 1 else 0] for r in rings], inside) for k in range(len(rows))]
        got = {r.id: r.area for r in P.largest_part_areas(df, scene, "id").collect()}
        np.testing.assert_allclose([got[i] for i in range(60)], [0.0 if g.is_empty() else g.largest_without_holes().area() for g in regions], atol=1e-9)
    calls.clear()
    P.largest_part_areas(df.selectExpr("id", "0.1D AS x", "0.4D AS w", "t"), scenes[0], "id").collect()
    assert len(calls) == 1
