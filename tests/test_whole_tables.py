"""Queries over whole tables that are larger than the smallest ones, against their SQL; and that queries run the operators they are named after."""

import duckdb
import pytest

from periodica.operators import analysis, generate, polygons, shapes
from periodica.plans import oracles, queries
from periodica.sources import contours

SF = "/root/testdata/sf0.01"


def both(spark, name):
    """The query's and the SQL's rows, sorted."""
    con = duckdb.connect()
    for t in ("events", "part", "supplier"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    a, b = queries.queries()[name](spark, SF).toPandas(), con.sql(oracles.oracle_sql()[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    return [sorted(map(repr, f[cols].astype(object).where(f[cols].notna(), None).itertuples(index=False, name=None))) for f in (a, b)]


@pytest.mark.parametrize("name", ["cell_polygon_area", "round_corners_area", "poly_distance", "poly_boolean_area", "min_gap", "dup_groups", "validate_shapes", "tf_feature_size", "cell_polygon_area_hex", "remove_holes_area", "contour_area", "gds_roundtrip"])
def test_every_part(spark, name):
    got, want = both(spark, name)
    assert len(got) >= 500 and got == want


def test_union_of_every_supplier(spark):
    got, want = both(spark, "csg_union_many")
    assert len(got) == spark.read.parquet(f"{SF}/events.parquet").count() and got == want


def test_hooks_of_generators(spark):
    got, want = both(spark, "generate_hooks")
    assert len(got) == 72 and got == want


class Called(Exception):
    pass


@pytest.mark.parametrize(
    ("name", "module", "operator"),
    [
        ("poly_distance", polygons, "ring_distance_rows"), ("poly_boolean_area", polygons, "area_rows"), ("poly_centroid", polygons, "centroid_column"), ("leaf_count", shapes, "leaves"), ("leaf_metrics", analysis, "rows_metrics"),
        ("min_gap", analysis, "rows_metrics"), ("cell_metrics", analysis, "rows_metrics"), ("constraint_check", analysis, "rows_metrics"), ("validate_cells", analysis, "rows_metrics"), ("generator_lattice", generate, "resized"),
        ("dup_pairs", queries, "raster_prints"), ("remove_holes_area", polygons, "compose"), ("contour_area", contours, "mask_polygons"), ("cell_polygon_area_hex", polygons, "cell_rows"), ("dup_groups", queries, "raster_prints"), ("csg_union_many", queries, "union_distances"),
    ],
)
def test_queries_run_their_operator(spark, sf_dir, monkeypatch, name, module, operator):
    """A query can't give its rows where its operator is replaced by one that fails; tasks see the driver's module through the call that builds them."""

    def fail(*_, **__):
        raise Called

    monkeypatch.setattr(module, operator, fail)
    # operators that tasks call are looked up where the table's function was made, so that function is run here, on the driver
    from pyspark.sql import DataFrame

    def run_here(self, func, schema, *_, **__):
        pdf = self.limit(5).toPandas()
        import pyarrow as pa

        for out in func(iter([pa.RecordBatch.from_pandas(pdf, preserve_index=False)])):
            pass
        return self

    def run_pandas(self, func, schema, *_, **__):
        for out in func(iter([self.limit(5).toPandas()])):
            pass
        return self

    cls = type(spark.range(1))
    monkeypatch.setattr(cls, "mapInArrow", run_here)
    monkeypatch.setattr(cls, "mapInPandas", run_pandas)
    assert issubclass(cls, DataFrame)
    with pytest.raises(Called):
        queries.queries()[name](spark, sf_dir).collect()


def test_figures_within_others_take_no_part(spark):
    """Nested figures of a few places: only the outermost meet points, and distances equal those over all."""
    import numpy as np

    from periodica.ir import col, evaluate
    from periodica.operators import nearest
    from periodica.operators import shapes as S

    rng = np.random.default_rng(5)
    figs = [(float(i % 3), float(i % 2), float(w), float(h)) for i, (w, h) in enumerate(rng.uniform(0.1, 9, (600, 2)))]
    figures = spark.createDataFrame([*figs, (None, 0.0, 1.0, 1.0)], "cx double, cy double, w double, h double")
    shape = S.Rectangle((0.0, 0.0), (col("w"), col("h"))).translate(col("cx"), col("cy"))
    kept = nearest.outermost(figures.where("cx IS NOT NULL"), shape).collect()
    held = {f for f in figs if not any(g != f and g[:2] == f[:2] and g[2] >= f[2] and g[3] >= f[3] for g in figs)}
    assert {tuple(r) for r in kept} == held and len(kept) == len(held) < 100
    assert nearest.outermost(figures, S.Egg((col("cx"), col("cy")), col("w"), col("h"))) is figures
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-12, 12, (80, 2)))]
    got = {r.pt: r.sdf for r in nearest.union_distances(spark.createDataFrame(pts, "pt long, x double, y double"), figures, shape).collect()}
    env = dict(zip(("cx", "cy", "w", "h"), np.array(figs).T, strict=True))
    assert all(abs(got[i] - evaluate([shape.sdf(x, y)], env)[0].min()) < 1e-12 for i, x, y in pts)
