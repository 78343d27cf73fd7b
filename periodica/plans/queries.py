"""Queries of the geometry engine over the test tables: each callable takes (spark, sf_dir)."""

from __future__ import annotations

import json


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from periodica.ir import Ex, bounded, call, col, derivative, floor_mod, lift, positive, where, with_columns
from periodica.operators import analysis, generate
from periodica.operators import polygons as P
from periodica.operators import shapes as S
from periodica.operators.lattice import Lattice, UnitCell, boundary_points, box_ranges, cartesian_grid, default_softness, fill_fractions, fractional_grid, hard_mask, periodic_sdf, raster_prints, rasterize, soft_mask, spread
from periodica.operators.nearest import union_distances
from periodica.sources.cells import scene_types
from periodica.sources.contours import gds_rings, gds_streams, mask_outlines

K, X, Y, ANG = col("k"), col("x"), col("y"), col("ang")
#: Centre of the figures in the point queries; off the grid of the points, so that no point lies on an outline.
CENTER = (0.1, -0.2)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pt, x, y in about [-2, 2], k (0 to 49) and ang (degrees), from events."""
    return table(spark, sf_dir, "events").selectExpr("event_id AS pt", "value - 4D * floor(value / 4D) - 2D + 0.0137D AS x", "(user_id % 97 + 0.41D) / 97D * 4D - 2D AS y", "CAST(event_id % 50 AS DOUBLE) AS k", "CAST(event_id % 360 AS DOUBLE) AS ang")


def figures() -> dict[str, S.Shape]:
    """The twelve figures of the point queries, with parameters by row."""
    c, a = CENTER, ANG
    return {
        "rectangle": S.Rectangle(c, (0.6 + K / 50.0, 0.4 + K / 80.0), a, 0.05),
        "convex_quad": S.ConvexQuad(c, (0.5 + K / 100.0, 0.1), (-0.1, 0.4 + K / 200.0), 0.2, -0.1, a, 0.05),
        "trapezoid": S.IsoscelesTrapezoid(c, 1.0 + K / 60.0, 0.6, 0.8, a, 0.1),
        "ellipse": S.Ellipse(c, (1.7, 0.9 + K / 200.0), a),
        "egg": S.Egg(c, 1.0, 1.4 + K / 100.0, 0.3, a),
        "stadium": S.Stadium(c, 1.6 + K / 100.0, 0.5, a),
        "regular_polygon": S.RegularPolygon(c, 5, 0.6 + K / 100.0, a, 0.07),
        "triangle": S.Triangle(c, 1.2 + K / 100.0, 60.0, 50.0, a, 0.04),
        "star": S.Star(c, 5, 1.0 + K / 100.0, 0.45, a, 0.02, 0.03),
        "cross": S.Cross(c, 1.5 + K / 100.0, 0.4, a, 0.05, 0.1),
        "tshape": S.TShape(c, 1.5 + K / 100.0, 0.4, a, 0.05, 0.1),
        "bar": S.Bar(0.1 + K / 100.0, 0.4, "x"),
    }


def rounded(e: str, name: str, digits: int = 6) -> str:
    """A double rounded, without a negative zero."""
    return f"round({e}, {digits}) + 0D AS {name}"


def _sdf(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return with_columns(points(spark, sf_dir), {"d": figures()[name].sdf(X, Y)}).selectExpr("pt", rounded("d", "sdf"))

    query.__doc__ = f"Distance of every point to a {name} with parameters by row."
    return query


def bounds_all(spark, sf_dir):
    """Boxes of the twelve figures, for every point's parameters."""
    df = points(spark, sf_dir).drop("x", "y")
    new = {f"{n}_{s}": b for n, f in figures().items() for s, b in zip(("x0", "y0", "x1", "y1"), f.bounds(), strict=True)}
    df = with_columns(df, new)
    out = F.explode(F.array(*(F.struct(F.lit(n).alias("shape"), *(F.col(f"{n}_{s}").alias(s) for s in ("x0", "y0", "x1", "y1"))) for n in figures())))
    return df.select("pt", out.alias("b")).selectExpr("pt", "b.shape", *(rounded(f"b.{s}", s) for s in ("x0", "y0", "x1", "y1")))


def min_feature_size(spark, sf_dir):
    """Narrowest places of the twelve figures, and of a union, for which it is unknown."""
    df = with_columns(points(spark, sf_dir).drop("x", "y"), {n: f.min_feature_size() for n, f in figures().items()})
    pairs = F.array(*(F.struct(F.lit(n).alias("shape"), F.col(n).alias("v")) for n in figures()), F.struct(F.lit("union").alias("shape"), F.lit(None).cast("double").alias("v")))
    return df.select("pt", F.explode(pairs).alias("f")).selectExpr("pt", "f.shape", rounded("f.v", "size"))


def first_failures(df: DataFrame, figures: dict[str, S.Shape], key: str) -> DataFrame:
    """key, shape, error: the first message that each figure's parameters earn, NULL for valid ones. Conditions are numbered, so that they can be staged."""
    codes, messages = {}, {}
    for i, (name, figure) in enumerate(figures.items()):
        checks = [(bad, message) for bad, message in figure.checks() if isinstance(bad, Ex)]
        code = lift(0.0)
        for n in range(len(checks), 0, -1):
            code = where(checks[n - 1][0], float(n), code)
        codes[f"e{i}"], messages[name] = code, [m for _, m in checks]
    found = F.array(*(F.struct(F.lit(n).alias("shape"), F.when(F.col(f"e{i}") > 0, F.get(F.array(*map(F.lit, messages[n])), F.col(f"e{i}").cast("int") - 1)).alias("error")) for i, n in enumerate(figures)))
    return with_columns(df, codes).select(key, F.explode(found).alias("f")).select(key, "f.shape", "f.error")


def checked_figures(wide: bool) -> dict[str, S.Shape]:
    """Figures over columns a, b, r and q; with `wide`, sizes go far enough that most radii must be moved into their range."""
    a, b, r, q = (col(c) for c in "abrq")
    o = (0.0, 0.0)
    return {
        "rectangle": S.Rectangle(o, (a, b), 0.0, r), "convex_quad": S.ConvexQuad(o, (a, 0.1), (-0.1, b), 0.0, 0.0, 0.0, r), "trapezoid": S.IsoscelesTrapezoid(o, a, b, 0.8317, 0.0, r),
        "ellipse": S.Ellipse(o, (a, b)), "egg": S.Egg(o, a, b, q * 1.3), "stadium": S.Stadium(o, a, b), "regular_polygon": S.RegularPolygon(o, 5, b, 0.0, r),
        "triangle": S.Triangle(o, a, 60.0, 50.0, 0.0, r) if wide else S.Triangle(o, a, q * 150.0, r * 200.0, 0.0, r * 0.1), "star": S.Star(o, 5, a + b if wide else a, b, 0.0, r, q),
        "cross": S.Cross(o, a, b, 0.0, r, q), "tshape": S.TShape(o, a, b, 0.0, r, q), "bar": S.Bar(0.0, b),
    }


def validate_shapes(spark, sf_dir):
    """First failure of each of the twelve figures, with parameters from parts, many of them invalid."""
    df = table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "CAST(p_size AS DOUBLE) / 10D - 0.2D AS a", "(p_retailprice - 900D) / 40D - 0.1D AS b", "CAST(p_partkey % 7 AS DOUBLE) / 10D - 0.1D AS r", "CAST(p_partkey % 11 AS DOUBLE) / 10D - 0.1D AS q")
    return first_failures(df, checked_figures(False), "id")


def project_params(spark, sf_dir):
    """Parameters as a distance takes them: moved into their valid ranges."""
    df = table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "CAST(p_size AS DOUBLE) / 10D + 0.1D AS a", "(p_retailprice - 900D) / 40D + 0.2D AS b", "CAST(p_partkey % 7 AS DOUBLE) / 10D - 0.1D AS r", "CAST(p_partkey % 11 AS DOUBLE) / 10D - 0.1D AS q")
    new = {f"{n}.{k}": v for n, f in checked_figures(True).items() for k, v in f.projected().items()}
    flat = F.array(*(F.struct(F.lit(n.split(".")[0]).alias("shape"), F.lit(n.split(".")[1]).alias("param"), F.col(f"v{i}").alias("v")) for i, n in enumerate(new)))
    return with_columns(df, {f"v{i}": v for i, v in enumerate(new.values())}).select("id", F.explode(flat).alias("f")).selectExpr("id", "f.shape", "f.param", rounded("f.v", "value"))


# ---- composition, transforms


def _pair():
    return S.Rectangle((0.0, 0.0), (1.2 + K / 50.0, 1.0), ANG), S.Stadium((0.4, 0.2), 1.4, 0.6, 30.0)


def _csg(kind, smooth: bool):
    def query(spark, sf_dir):
        a, b = _pair()
        return with_columns(points(spark, sf_dir), {"d": kind(a, b, smooth, 0.3).sdf(X, Y)}).selectExpr("pt", rounded("d", "sdf"))

    query.__doc__ = f"{'Smooth ' if smooth else ''}{kind.__name__.lower()} of two figures at every point."
    return query


def csg_union_many(spark, sf_dir):
    """Union of all figures of a table: the least distance of each point, which meets only figures that can be nearest."""
    figures = table(spark, sf_dir, "supplier").selectExpr("CAST(s_suppkey % 5 AS DOUBLE) - 2D + 0.03D AS cx", "CAST(s_suppkey % 4 AS DOUBLE) - 1.5D + 0.01D AS cy", "0.2D + CAST(s_suppkey AS DOUBLE) / 100D AS w")
    return union_distances(points(spark, sf_dir).select("pt", "x", "y"), figures, S.Rectangle((col("cx"), col("cy")), (col("w"), 0.3))).selectExpr("pt", rounded("sdf", "sdf"))


def csg_setop_equivalence(spark, sf_dir):
    """Points inside each composition, by distances and by set operations over point sets; both must count alike."""
    a, b = _pair()
    p = with_columns(points(spark, sf_dir), {"a": a.sdf(X, Y), "b": b.sdf(X, Y), "u": (a | b).sdf(X, Y), "i": (a & b).sdf(X, Y), "m": (a - b).sdf(X, Y)})
    ins = lambda c: p.where(f"{c} <= 0").select("pt")
    sets = {"union": ins("a").union(ins("b")).distinct(), "intersection": ins("a").intersect(ins("b")), "difference": ins("a").exceptAll(ins("b"))}
    out = None
    for name, c in (("union", "u"), ("intersection", "i"), ("difference", "m")):
        row = ins(c).agg(F.count("*").alias("by_distance")).crossJoin(sets[name].agg(F.count("*").alias("by_sets"))).withColumn("op", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out.select("op", "by_distance", "by_sets")


def _tf(make):
    def query(spark, sf_dir):
        return with_columns(points(spark, sf_dir), {"d": make(S.Rectangle((0.2, 0.1), (1.0, 0.5))).sdf(X, Y)}).selectExpr("pt", rounded("d", "sdf"))

    return query


def tf_feature_size(spark, sf_dir):
    """Feature sizes under transforms: kept by moves and turns, multiplied by scalings, unknown for a union."""
    r = S.Rectangle((0, 0), (1.0 + K / 50.0, 0.5 + K / 40.0))
    df = with_columns(points(spark, sf_dir), {"moved": r.translate(1.0, 2.0).min_feature_size(), "turned": r.rotate(ANG).min_feature_size(), "scaled": r.scale(0.5 + K / 100.0).min_feature_size()})
    unite = (r | r.translate(3.0, 0.0)).scale(2.0).min_feature_size()
    df = df.withColumn("unite", F.lit(None).cast("double")) if unite is None else with_columns(df, {"unite": unite})
    return df.selectExpr("pt", rounded("moved", "moved"), rounded("turned", "turned"), rounded("scaled", "scaled"), rounded("unite", "unite"))


def tf_bounds(spark, sf_dir):
    """Boxes through a scaling, a turn and a move, and of an intersection that is empty for some rows."""
    r = S.Rectangle((0.3, 0.1), (1.0, 0.5 + K / 100.0))
    chain = r.scale(1.5, (0.1, 0.2)).rotate(ANG, (0.5, 0.0)).translate(K / 10.0, -1.0)
    cut = S.Rectangle((0, 0), (1.0, 1.0)) & S.Rectangle((K / 25.0, 0.0), (1.0, 1.0))
    moved = cut.translate(1.0, 1.0)
    new = {f"c{i}": b for i, b in enumerate(chain.bounds())} | {f"i{i}": b for i, b in enumerate(moved.bounds())}
    return with_columns(points(spark, sf_dir), new).selectExpr("pt", *(rounded(f"c{i}", f"c{i}") for i in range(4)), *(rounded(f"i{i}", f"i{i}") for i in range(4)))


# ---- lattices and grids


def _row_lattice():
    return Lattice((1.0 + K / 50.0, 0.1), (0.3, 1.2 + K / 100.0))


def lattice_area(spark, sf_dir):
    """Cell areas of lattices by row, of a hexagonal and of a rectangular one."""
    df = with_columns(points(spark, sf_dir), {"a": _row_lattice().area(), "h": Lattice.hexagonal(1.0 + K / 10.0).area(), "f": Lattice.hexagonal(1.0 + K / 10.0, "flat").area(), "r": Lattice.rectangular(1.0 + K, 2.0).area()})
    return df.selectExpr("pt", rounded("a", "oblique"), rounded("h", "pointy"), rounded("f", "flat"), rounded("r", "rect"))


def lattice_roundtrip(spark, sf_dir):
    """Fractional coordinates and back."""
    lat = _row_lattice()
    f1, f2 = lat.to_fractional(X, Y)
    x, y = lat.to_cartesian(f1, f2)
    return with_columns(points(spark, sf_dir), {"f1": f1, "f2": f2, "bx": x, "by": y}).selectExpr("pt", rounded("f1", "f1"), rounded("f2", "f2"), rounded("bx", "x"), rounded("by", "y"))


def lattice_offset(spark, sf_dir):
    """Offsets of cells (k mod 7 - 3, k mod 5 - 2)."""
    ox, oy = _row_lattice().offset(floor_mod(K, 7.0) - 3.0, floor_mod(K, 5.0) - 2.0)
    return with_columns(points(spark, sf_dir), {"ox": ox, "oy": oy}).selectExpr("pt", rounded("ox", "ox"), rounded("oy", "oy"))


def neighbor_offsets(spark, sf_dir):
    """Cells of rings 0 to 3 around the origin."""
    return spark.range(4).selectExpr("CAST(id AS INT) AS ring", "explode(sequence(-CAST(id AS INT), CAST(id AS INT))) AS i").selectExpr("ring", "i", "explode(sequence(-ring, ring)) AS j")


def grid_fractional(spark, sf_dir):
    return fractional_grid(spark, 48, 32).selectExpr("iy", "ix", rounded("f1", "f1"), rounded("f2", "f2"))


def grid_cartesian(spark, sf_dir):
    return cartesian_grid(spark, Lattice.hexagonal(1.5), 48, 32).selectExpr("iy", "ix", rounded("x", "x"), rounded("y", "y"))


def fold_points(spark, sf_dir):
    """Points folded into the cell at the origin."""
    x, y = _row_lattice().fold(X, Y)
    return with_columns(points(spark, sf_dir), {"fx": x, "fy": y}).selectExpr("pt", rounded("fx", "x"), rounded("fy", "y"))


def copy_ranges(spark, sf_dir):
    """Copies that rectangles by row need, over lattices by row; and those of an endless stripe."""
    lat = _row_lattice()
    r = S.Rectangle((K / 5.0, -K / 7.0), (0.5 + K / 30.0, 0.4), ANG)
    (i0, i1), (j0, j1) = box_ranges(lat, r.bounds())
    rect = Lattice.rectangular(1.0 + K / 50.0, 2.0)
    (bi0, bi1), (bj0, bj1) = box_ranges(rect, S.Bar(0.1 + K / 9.0, 0.4, "x").bounds())
    names = dict(i0=i0, i1=i1, j0=j0, j1=j1, bi0=bi0, bi1=bi1, bj0=bj0, bj1=bj1)
    return with_columns(points(spark, sf_dir), names).selectExpr("pt", *(f"CAST({n} AS INT) AS {n}" for n in names))


def piece_ranges(spark, sf_dir):
    """United copy ranges of a union of a stripe and a moved, wide rectangle: pieces are measured apart."""
    cell = UnitCell(Lattice.rectangular(1.0, 1.0), S.Bar(0.0, 0.3, "x") | S.Rectangle((0.0, 0.0), (5.0, 0.2 + K / 50.0)).translate(K / 10.0, 0.5))
    (i0, i1), (j0, j1) = cell.copy_ranges()
    return with_columns(points(spark, sf_dir), {"i0": i0, "i1": i1, "j0": j0, "j1": j1}).selectExpr("pt", *(f"CAST({n} AS INT) AS {n}" for n in ("i0", "i1", "j0", "j1")))


def rect_cell() -> UnitCell:
    return UnitCell(Lattice.rectangular(1.3, 1.1), S.Rectangle((0.35, 0.3), (0.7, 0.4), 30.0) | S.Bar(0.9, 0.1, "x"))


def hex_cell() -> UnitCell:
    return UnitCell(Lattice.hexagonal(1.2), S.Rectangle((0.1, 0.2), (0.6, 0.35), 30.0))


def periodic_sdf_rect(spark, sf_dir):
    """Distance to a periodic scene over a rectangular lattice, a rectangle and a stripe."""
    return periodic_sdf(points(spark, sf_dir), rect_cell(), "x", "y").selectExpr("pt", rounded("sdf", "sdf"))


def periodic_sdf_hex(spark, sf_dir):
    """Distance to turned rectangles over a hexagonal lattice."""
    return periodic_sdf(points(spark, sf_dir), hex_cell(), "x", "y").selectExpr("pt", rounded("sdf", "sdf"))


def periodic_sdf_far(spark, sf_dir):
    """A wide figure far away, which needs more copies than one expression holds."""
    cell = UnitCell(Lattice.rectangular(1.0, 1.0), S.Rectangle((10.0, 10.0), (6.5, 0.3), 20.0))
    return periodic_sdf(points(spark, sf_dir), cell, "x", "y").selectExpr("pt", rounded("sdf", "sdf"))


def raster(spark, sf_dir):
    """A fractional raster, tiled twice by three."""
    return rasterize(spark, hex_cell(), 40, 30, (2, 3)).selectExpr("iy", "ix", rounded("x", "x"), rounded("y", "y"), rounded("sdf", "sdf"))


def raster_cartesian(spark, sf_dir):
    return rasterize(spark, hex_cell(), 40, 30, (2, 1), "cartesian").selectExpr("iy", "ix", rounded("x", "x"), rounded("y", "y"), rounded("sdf", "sdf"))


def mask_hard(spark, sf_dir):
    return hard_mask(rasterize(spark, hex_cell(), 64, 64)).select("iy", "ix", "mask")


def mask_soft(spark, sf_dir):
    cell = hex_cell()
    return soft_mask(rasterize(spark, cell, 64, 64), default_softness(cell, 64, 64)).selectExpr("iy", "ix", rounded("mask", "mask"))


def boundary(spark, sf_dir):
    """Boundary points of a 128 by 128 raster."""
    return boundary_points(spark, hex_cell(), 128).selectExpr(rounded("x", "x"), rounded("y", "y"))


def extent(spark, sf_dir):
    """Extents of repeated cells."""
    a, b = _row_lattice().extent((3, 2)), Lattice.hexagonal(1.0 + K / 10.0).extent((1, 1))
    new = {f"{p}{i}": v for p, e in (("o", a), ("h", b)) for i, v in enumerate(e)}
    return with_columns(points(spark, sf_dir), new).selectExpr("pt", *(rounded(n, n) for n in new))


def center_bbox(spark, sf_dir):
    """Boxes of scenes moved to the middle of their cell."""
    scene = S.Rectangle((K / 10.0, 1.0), (1.0, 0.5), ANG) | S.Stadium((0.0, 0.0), 1.0, 0.4)
    moved = UnitCell(_row_lattice(), scene).center_scene("bbox")
    return with_columns(points(spark, sf_dir), {f"b{i}": b for i, b in enumerate(moved.scene.bounds())}).selectExpr("pt", *(rounded(f"b{i}", f"b{i}") for i in range(4)))


# ---- polygons


def _corners_df(spark, sf_dir, names):
    df = spread(points(spark, sf_dir), "pt")
    new = {f"{n}_{i}_{a}": v for n in names for i, p in enumerate(figures()[n].corners()) for a, v in zip("xy", p, strict=True)}
    return with_columns(df, new)


def _ring(name: str, n: int):
    return F.array(*(F.struct(F.col(f"{name}_{i}_x").alias("x"), F.col(f"{name}_{i}_y").alias("y")) for i in range(n)))


SHARP = {"rectangle": 4, "convex_quad": 4, "trapezoid": 4, "regular_polygon": 5, "triangle": 3, "star": 10, "cross": 12, "tshape": 8}


def poly_vertices(spark, sf_dir):
    """Vertices of the sharp outlines, in order."""
    df = _corners_df(spark, sf_dir, SHARP)
    rings = F.array(*(F.struct(F.lit(n).alias("shape"), _ring(n, k).alias("ring")) for n, k in SHARP.items()))
    flat = df.select("pt", F.explode(rings).alias("s")).select("pt", "s.shape", F.posexplode("s.ring").alias("i", "p"))
    return flat.selectExpr("pt", "shape", "i", rounded("p.x", "x"), rounded("p.y", "y"))


def _rings(spark, sf_dir):
    df = _corners_df(spark, sf_dir, SHARP)
    return df.select("pt", "x", "y", "k", F.explode(F.array(*(F.struct(F.lit(n).alias("shape"), _ring(n, k).alias("ring")) for n, k in SHARP.items()))).alias("s")).select("pt", "x", "y", "k", "s.shape", "s.ring")


def poly_area(spark, sf_dir):
    """Shoelace areas of the outlines."""
    return _rings(spark, sf_dir).select("pt", "shape", P.area_column(F.col("ring")).alias("a")).selectExpr("pt", "shape", rounded("a", "area"))


def poly_centroid(spark, sf_dir):
    """Area centroids of the outlines."""
    return _rings(spark, sf_dir).select("pt", "shape", P.centroid_column(F.col("ring")).alias("c")).selectExpr("pt", "shape", rounded("c.x", "x"), rounded("c.y", "y"))


def poly_outline_area(spark, sf_dir):
    """Areas of the whole outlines: curves and rounded corners as chords."""
    finite = {n: f for n, f in figures().items() if n != "bar"}
    return P.outline_areas(points(spark, sf_dir).select("pt", "k", "ang"), finite, "pt").selectExpr("pt", "shape", rounded("area", "area"))


def poly_transform(spark, sf_dir):
    """Boxes of a star's ring moved, turned about a point, and scaled from one."""
    df = _rings(spark, sf_dir).where("shape = 'star'")
    m = df.withColumns({"m": P.moved_column(F.col("ring"), F.col("x"), F.col("y")), "r": P.rotated_column(F.col("ring"), F.col("k") * 7, 0.3, -0.1), "s": P.scaled_column(F.col("ring"), 0.5 + F.col("k") / 50, 0.1, 0.2)})
    for c in "mrs":
        m = m.withColumn(f"{c}b", P.bounds_column(F.col(c)))
    return m.selectExpr("pt", *(rounded(f"{c}b.{s}", f"{c}_{s}") for c in "mrs" for s in ("x0", "y0", "x1", "y1")))


def poly_raster(spark, sf_dir):
    """Even-odd containment of every point in its own outlines."""
    return _rings(spark, sf_dir).select("pt", "shape", P.contains_column(F.col("ring"), F.col("x"), F.col("y")).alias("inside"))


def poly_covers(spark, sf_dir):
    """Nodes of a grid within boxes by row or on their outline; half of the boxes' sides lie on the grid."""
    b = table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "CAST(p_size % 4 AS DOUBLE) / 4D AS cx", "CAST(p_partkey % 4 AS DOUBLE) / 4D AS cy", "1D + CAST(p_size % 3 AS DOUBLE) / 2D AS w", "0.5D + CAST(p_partkey % 5 AS DOUBLE) / 4D AS h")
    corners = [(F.col("cx") + i * F.col("w") / 2, F.col("cy") + j * F.col("h") / 2) for i, j in ((-1, -1), (1, -1), (1, 1), (-1, 1))]
    b = spread(b, "id").select("id", F.array(*(F.struct(x.alias("x"), y.alias("y")) for x, y in corners)).alias("ring"))
    g = b.selectExpr("id", "ring", "explode(sequence(-4, 4)) AS ix").selectExpr("id", "ring", "ix", "explode(sequence(-4, 4)) AS iy")
    return g.select("id", "ix", "iy", P.covers_column(F.col("ring"), F.col("ix") / 4, F.col("iy") / 4).alias("covered"))


def _box_pairs(spark, sf_dir):
    return table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "CAST(p_partkey % 10 AS DOUBLE) + 0.137D AS ax", "CAST(p_partkey % 7 AS DOUBLE) + 0.291D AS ay", "1D + CAST(p_size AS DOUBLE) / 25D AS w", "1D + (p_retailprice - 900D) / 100D AS h", "CAST(p_size % 9 AS DOUBLE) AS bx", "CAST(p_partkey % 5 AS DOUBLE) AS bY", "CAST(p_partkey % 360 AS DOUBLE) AS ang")


def poly_distance(spark, sf_dir):
    """Distances of two rectangles by row, one turned; 0 where they touch."""
    one, two = S.Rectangle((col("ax"), col("ay")), (col("w"), col("h")), ANG), S.Rectangle((col("bx"), col("bY")), (1.0, 1.0))
    return P.shape_distances(_box_pairs(spark, sf_dir), one, two, "id").selectExpr("id", rounded("distance", "distance"))


def poly_boolean_area(spark, sf_dir):
    """Areas of union, intersection and difference of two boxes by row, through the slab decomposition."""
    one, two = S.Rectangle((col("ax"), col("ay")), (col("w"), col("h"))), S.Rectangle((col("bx"), col("bY")), (1.0, 1.0))
    return P.scene_areas(_box_pairs(spark, sf_dir), {"u": one | two, "i": one & two, "d": one - two}, "id").selectExpr("id", rounded("u", "union_area", 9), rounded("i", "intersection_area", 9), rounded("d", "difference_area", 9))


# ---- cells, metrics, constraints


def part_cells(spark, sf_dir) -> DataFrame:
    """A turned rectangle in a hexagonal cell, for each part; sizes and places are off the raster, so that no sample lies on an outline."""
    return table(spark, sf_dir, "part").selectExpr("p_partkey AS cell_id", "0.5071D + CAST(p_size AS DOUBLE) / 25D AS w", "0.4053D + (p_retailprice - 900D) / 100D AS h", "CAST(p_partkey % 360 AS DOUBLE) AS ang", "0.1037D + CAST(p_partkey % 13 AS DOUBLE) / 10D AS cx", "0.2019D + CAST(p_partkey % 11 AS DOUBLE) / 10D AS cy")


def part_cell() -> UnitCell:
    return UnitCell(Lattice.hexagonal(4.0), S.Rectangle((col("cx"), col("cy")), (col("w"), col("h")), ANG))


def fill_fraction(spark: SparkSession, sf_dir: str, n: int = 64) -> DataFrame:
    """Share of an n by n raster inside the periodic scene, for each cell."""
    return fill_fractions(part_cells(spark, sf_dir), part_cell(), n).selectExpr("cell_id", rounded("fill_fraction", "fill_fraction"))


def figure_nodes(spark, sf_dir) -> DataFrame:
    """Scene nodes of cells of four parts each. All figures are turned rectangles, one plain, the others under a move, a turn or a scaling."""
    f = table(spark, sf_dir, "part").selectExpr(
        "p_partkey DIV 4 AS cell_id", "CAST(p_partkey % 4 AS INT) AS o", "2.5137D + 5D * (p_partkey % 2) + 0.12D * (p_partkey % 10 - 4.5D) AS cx", "2.5091D + 5D * (p_partkey % 4 DIV 2) + 0.15D * (p_partkey % 7 - 3) AS cy",
        "0.5031D + CAST(p_size AS DOUBLE) / 14D AS w", "0.4517D + (p_retailprice - 900D) / 50D AS h", "CAST(p_partkey * 37 % 360 AS DOUBLE) AS ang",
    )
    figure = "struct(2 * o + 1 AS node_id, CASE WHEN o > 0 THEN 2 * o END AS parent_id, 'Rectangle' AS type, to_json(struct(CASE WHEN o = 1 THEN array(0D, 0D) ELSE array(cx, cy) END AS center, CASE WHEN o = 3 THEN array(w / 2, h / 2) ELSE array(w, h) END AS size, CASE WHEN o = 2 THEN 0D ELSE ang END AS angle)) AS params)"
    around = "struct(2 * o AS node_id, CAST(NULL AS INT) AS parent_id, element_at(array('Translate', 'Rotate', 'Scale'), o) AS type, CASE o WHEN 1 THEN to_json(struct(cx AS dx, cy AS dy)) WHEN 2 THEN to_json(struct(ang AS angle, array(cx, cy) AS origin)) ELSE to_json(struct(2D AS scale, array(cx, cy) AS origin)) END AS params)"
    return f.selectExpr("cell_id", f"explode(CASE WHEN o = 0 THEN array({figure}) ELSE array({figure}, {around}) END) AS n").select("cell_id", "n.*")


def figure_cells(spark, sf_dir) -> DataFrame:
    """(cell_id, cell): the scenes of figure_nodes over a lattice of 10 by 10."""
    return analysis.cells_from_nodes(figure_nodes(spark, sf_dir), Lattice.rectangular(10.0, 10.0))


def leaf_metrics(spark, sf_dir):
    """Figures of each cell: number, areas and box sizes in order, narrowest place."""
    m = analysis.analyze(figure_cells(spark, sf_dir), ("num_shapes", "shape_areas", "shape_bbox_sizes", "min_feature_size"))
    text = lambda c, get: F.array_join(F.transform(c, lambda x: F.format_string("%.6f", F.round(get(x), 6))), ",")
    return m.select("cell_id", "num_shapes", F.expr(rounded("min_feature_size", "min_feature_size")), text("shape_areas", lambda x: x).alias("shape_areas"), text("shape_bbox_sizes", lambda x: x["w"]).alias("widths"), text("shape_bbox_sizes", lambda x: x["h"]).alias("heights"))


def scene_nodes(spark, sf_dir) -> DataFrame:
    """Scene trees as rows, ten parts to a cell: node 1 is the root, and the children of node n are 2n and 2n + 1."""
    n = table(spark, sf_dir, "part").selectExpr("p_partkey DIV 10 AS cell_id", "CAST(p_partkey % 10 + 1 AS INT) AS node_id")
    n = n.selectExpr("*", "node_id DIV 2 AS parent_id", "CASE WHEN node_id * 2 > 10 THEN 'Rectangle' WHEN node_id = 5 THEN 'Translate' WHEN (cell_id + node_id) % 5 = 0 THEN 'Difference' WHEN (cell_id + node_id) % 7 = 0 THEN 'Translate' ELSE 'Union' END AS type")
    return n.selectExpr("*", "CASE type WHEN 'Rectangle' THEN to_json(struct(array(node_id, 0D) AS center, array(0.5D, 0.25D) AS size)) WHEN 'Translate' THEN to_json(struct(0.5D AS dx, 0D AS dy)) END AS params")


def leaf_count(spark, sf_dir):
    """Figures of each scene tree, by type: unions and transforms are gone through, differences stay whole."""
    leaves = analysis.leaf_rows(analysis.cells_from_nodes(scene_nodes(spark, sf_dir), Lattice.rectangular(20.0, 20.0)))
    return leaves.groupBy("cell_id").agg(F.count("*").alias("leaves"), F.count(F.when(F.col("leaf").contains('"Difference"'), 1)).alias("differences"))


def min_gap(spark, sf_dir):
    """Least gap between the figures of each cell and their images."""
    return analysis.analyze(figure_cells(spark, sf_dir), ("min_gap",)).selectExpr("cell_id", rounded("min_gap", "min_gap"))


def cell_metrics(spark, sf_dir):
    """Metrics of each cell, bundled."""
    m = analysis.analyze(figure_cells(spark, sf_dir), ("fill_fraction", "num_shapes", "min_feature_size", "min_gap"))
    return m.selectExpr("cell_id", rounded("fill_fraction", "fill_fraction"), "num_shapes", rounded("min_feature_size", "min_feature_size"), rounded("min_gap", "min_gap"))


LIMITS = analysis.Constraints(min_fill=0.08, max_fill=0.14, min_num_shapes=4, max_num_shapes=4, min_feature_size=0.6, min_shape_size=0.7, min_gap=1.0)


def constraint_check(spark, sf_dir):
    """All failures of each cell, in order."""
    return analysis.check(analysis.analyze(figure_cells(spark, sf_dir)), LIMITS).select("cell_id", F.array_join("failures", "; ").alias("failures"))


def validate_cells(spark, sf_dir):
    """The first failure of each cell."""
    return analysis.check(analysis.analyze(figure_cells(spark, sf_dir)), LIMITS).select("cell_id", "failure")


def _prints(spark, sf_dir):
    """Fingerprints of a cell for each part; many are equal, and others differ by less than the tolerance."""
    c = table(spark, sf_dir, "part").selectExpr("p_partkey AS cell_id", "0.8D + CAST(p_size % 5 AS DOUBLE) / 10D + 0.0015D * (p_partkey % 3) AS w", "0.6D + 0.0023D * floor(p_retailprice - 900D) AS h")
    return raster_prints(c, UnitCell(Lattice.rectangular(3.0, 2.0), S.Rectangle((1.5137, 1.0091), (col("w"), col("h")))))


def dup_pairs(spark, sf_dir):
    """Different cells whose fingerprints are within the tolerance, by their least ids, and each copy with the least id of its kind."""
    return analysis.duplicate_pairs(_prints(spark, sf_dir))


def dup_groups(spark, sf_dir):
    """Groups of duplicate cells, equal ones included."""
    return analysis.duplicate_groups(_prints(spark, sf_dir))


# ---- generation, files, gradients


CONFIG = generate.Config(seed=11, target_count=24, min_num_shapes=1, max_num_shapes=2, allowed_shapes=("Rectangle", "Ellipse", "Stadium", "RegularPolygon", "Triangle"), min_gap=0.02, max_tries_per_cell=20)


def generate_cells(spark, sf_dir):
    """A reproducible batch of random cells."""
    return generate.generate(spark, CONFIG, Lattice.rectangular(3.0, 3.0)).selectExpr("cell_id", "cell", "attempts", rounded("fill", "fill"))


def generate_metrics(spark, sf_dir):
    """Metrics of generated cells, by polygons."""
    m = analysis.analyze(generate.generate(spark, CONFIG, Lattice.rectangular(3.0, 3.0)).where("cell IS NOT NULL"))
    return m.selectExpr("cell_id", rounded("fill_fraction", "fill_fraction"), "num_shapes", rounded("min_gap", "min_gap"))


def generate_valid(spark, sf_dir):
    """What holds of every generated cell, from its polygons: number and kinds of figures, the gap, and the fill that the batch tells."""
    cells = generate.generate(spark, CONFIG, Lattice.rectangular(3.0, 3.0))
    kinds = analysis.leaf_rows(cells).groupBy("cell_id").agg(F.collect_set("type").alias("kinds"))
    m = analysis.analyze(cells, ("num_shapes", "min_gap", "shape_areas")).join(cells.select("cell_id", "fill", "attempts"), "cell_id").join(kinds, "cell_id")
    allowed = F.array(*map(F.lit, CONFIG.allowed_shapes))
    return m.select("cell_id", F.col("num_shapes").between(1, 2).alias("number_ok"), (F.col("min_gap") > 0.02).alias("gap_ok"), (F.size(F.array_except("kinds", allowed)) == 0).alias("kinds_ok"), (F.abs(F.aggregate("shape_areas", F.lit(0.0), lambda a, x: a + x) / 9 - F.col("fill")) < 1e-9).alias("fill_ok"), F.col("attempts").between(1, 20).alias("attempts_ok"))


def _plain_attempt(config, lattice, rng):
    """An attempt of one's own: the same rectangle in every cell."""
    return UnitCell(lattice, S.Rectangle((1.5, 1.5), (1.2, 0.5)))


def _no_attempt(config, lattice, rng):
    raise RuntimeError("no_room")


class _Picky(generate.Validator):
    def validate(self, cell):
        return "not_wanted"


def generate_hooks(spark, sf_dir):
    """Batches by generators of one's own: a plain attempt, one that always fails, and a validator that rejects all."""
    lat, hooks = Lattice.rectangular(3.0, 3.0), {"plain": (None, _plain_attempt), "failing": (None, _no_attempt), "rejecting": (_Picky(), _plain_attempt)}
    made = [generate.generate(spark, CONFIG, lat, validator, attempt).withColumn("hook", F.lit(n)) for n, (validator, attempt) in hooks.items()]
    why = F.array_join(F.transform(F.map_entries("reasons"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ";")
    return made[0].unionByName(made[1]).unionByName(made[2]).select("hook", "cell_id", F.col("cell").isNotNull().alias("made"), "attempts", why.alias("reasons"), F.expr(rounded("fill", "fill")))


def generator_lattice(spark, sf_dir):
    """Lattices resized as the generator does it: the whole cell to a length by row, or each vector to its own."""
    lat = _row_lattice()
    whole, apart = generate.resized(lat, 2.0 + K / 25.0), generate.resized(lat, None, 1.5 + K / 20.0, 3.0)
    new = {f"{n}{v}{a}": c for n, r in (("w", whole), ("s", apart)) for v, vec in (("1", r.a1), ("2", r.a2)) for a, c in zip("xy", vec, strict=True)}
    return with_columns(points(spark, sf_dir), new).selectExpr("pt", *(rounded(n, n) for n in new))


def _attempts(spark, sf_dir) -> DataFrame:
    """A log of attempts in the shape of generate's result, from orders."""
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS cell_id", "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'x' END AS cell", "CAST(1 + o_orderkey % 4 AS BIGINT) AS attempts", "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice / 1000000D END AS fill", "o_orderpriority AS why")
    return o.withColumn("reasons", F.when(F.col("attempts") > 1, F.create_map("why", F.col("attempts") - 1)).otherwise(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))))


def _flat_report(r: DataFrame) -> DataFrame:
    text = F.array_join(F.transform(F.array_sort(F.map_entries("failure_reasons")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ";")
    return r.select("requested", "generated", "failed", "total_attempts", text.alias("reasons"), F.round(F.col("parameter_ranges")["fill_fraction"]["lo"], 6).alias("lo"), F.round(F.col("parameter_ranges")["fill_fraction"]["hi"], 6).alias("hi"))


def report_rollup(spark, sf_dir):
    """Report of a log of attempts."""
    return _flat_report(generate.report(_attempts(spark, sf_dir)))


def report_merge(spark, sf_dir):
    """Reports of three parts of the log, merged: the same as that of the whole."""
    a = _attempts(spark, sf_dir)
    parts = [generate.report(a.where(f"cell_id % 3 = {i}"), {"part": i}) for i in range(3)]
    return _flat_report(generate.merge_reports(parts[0].unionByName(parts[1]).unionByName(parts[2])))


def scene_json_scan(spark, sf_dir):
    """Paths into parsed scenes."""
    p = table(spark, sf_dir, "part").selectExpr("p_partkey AS cell_id", """CASE WHEN p_partkey % 17 = 0 THEN 'broken' ELSE concat('{"lattice": {"a1": [', p_size, ', 0.5], "a2": [0, 1]}, "scene": {"type": "', CASE WHEN p_partkey % 2 = 0 THEN 'Cross' ELSE 'Star' END, '"}}') END AS cell""")
    return scene_types(p).selectExpr("cell_id", "type", "a1x")


def yaml_roundtrip(spark, sf_dir):
    """Generated cells written as YAML and parsed again: whether they are the same."""
    from periodica.sources.cells import dump_cells, load_document

    def rows(batches):
        import pandas as pd

        for b in batches:
            back = [load_document(dump_cells([UnitCell.from_parametric(json.loads(c))]))[0][0] for c in b.cell]
            yield pd.DataFrame({"cell_id": b.cell_id, "before": b.cell, "after": [json.dumps(c.to_parametric()) for c in back]})

    cells = generate.generate(spark, CONFIG, Lattice.rectangular(3.0, 3.0)).where("cell IS NOT NULL").select("cell_id", "cell")
    return cells.mapInPandas(rows, "cell_id long, before string, after string").selectExpr("cell_id", "before = after AS same")


def center_centroid(spark, sf_dir):
    """Area centroids of generated scenes moved to the middle of their cells: all in (1.5, 1.5)."""

    def rows(batches):
        import pandas as pd

        for b in batches:
            found = [P.shape_region(UnitCell.from_parametric(json.loads(c)).center_scene("centroid").scene).centroid() for c in b.cell]
            yield pd.DataFrame({"cell_id": b.cell_id, "x": [f[0] for f in found], "y": [f[1] for f in found]})

    cells = generate.generate(spark, CONFIG, Lattice.rectangular(3.0, 3.0)).where("cell IS NOT NULL").select("cell_id", "cell")
    return cells.mapInPandas(rows, "cell_id long, x double, y double").selectExpr("cell_id", rounded("x", "x"), rounded("y", "y"))


def cell_polygon_area(spark, sf_dir):
    """Areas of periodic scenes within their cell: boxes placed anywhere wrap to their own area."""
    cell = UnitCell(Lattice.rectangular(4.0, 3.0), S.Rectangle((col("ax"), col("ay")), (col("w"), col("h"))))
    return P.cell_areas(_box_pairs(spark, sf_dir).select("id", "ax", "ay", "w", "h"), cell, "id").selectExpr("id", rounded("area", "area"))


def cell_polygon_area_hex(spark, sf_dir):
    """Areas of turned boxes within a hexagonal cell: their images don't meet, so each keeps its own area."""
    boxes = _box_pairs(spark, sf_dir).selectExpr("id", "ax", "ay", "w", "1D + CAST(id % 7 AS DOUBLE) / 4D AS h", "ang")
    return P.cell_areas(boxes, UnitCell(Lattice.hexagonal(6.0), S.Rectangle((col("ax"), col("ay")), (col("w"), col("h")), ANG)), "id").selectExpr("id", rounded("area", "area"))


def remove_holes_area(spark, sf_dir):
    """Areas of a box with a hole beside a smaller box: the larger part counts, without its hole."""
    scene = (S.Rectangle((0.0, 0.0), (col("w"), col("h"))) - S.Rectangle((0.1, 0.05), (0.4, 0.3), ANG)) | S.Rectangle((20.0, 0.0), (0.7, 0.6))
    return P.largest_part_areas(_box_pairs(spark, sf_dir).select("id", "w", "h", "ang"), scene, "id").selectExpr("id", rounded("area", "area"))


def contour_area(spark, sf_dir):
    """Outlines of masks: a block of pixels by row, with a hole of one pixel in those of three by three and more; their number and areas."""
    m = table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "1 + p_size % 9 AS w", "CAST(1 + p_partkey % 7 AS INT) AS h")
    m = m.selectExpr("id", "transform(sequence(0, 9), y -> transform(sequence(0, 11), x -> x BETWEEN 2 AND w + 1 AND y BETWEEN 1 AND h AND NOT (x = 3 AND y = 2 AND w > 2 AND h > 2))) AS mask")
    rings = mask_outlines(m, "id", "mask", distance=False, tolerance=0.0).withColumn("a", P.area_column(F.col("ring")))
    return rings.groupBy("id").agg(F.count("*").alias("rings"), F.max("part").alias("last_part"), F.sum(F.when(~F.col("hole"), F.col("a"))).alias("a"), F.sum(F.when(F.col("hole"), F.col("a"))).alias("b")).selectExpr("id", "rings", "last_part", rounded("a", "area"), rounded("b", "hole_area"))


def gds_roundtrip(spark, sf_dir):
    """Boxes by row as boundaries of a layout stream for each fifty parts, read back: corners lie on the stream's steps."""
    b = table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "p_partkey DIV 50 AS layout", "CAST(p_partkey % 1000 AS DOUBLE) + 0.137D AS x0", "0.291D - CAST(p_partkey % 7 AS DOUBLE) AS y0", "1D + CAST(p_size AS DOUBLE) / 30D AS w")
    b = b.selectExpr("layout", "transform(array(array(0D, 0D), array(1D, 0D), array(1D, 0.5D), array(0D, 0.5D)), c -> struct(x0 + c[0] * w AS x, y0 + c[1] * w AS y)) AS ring")
    back = gds_rings(gds_streams(b, "layout", "ring", layer=3), "layout", "gds").withColumn("b", P.bounds_column(F.col("ring")))
    return back.selectExpr("layout", "layer", "size(ring) AS vertices", *(rounded(f"b.{s}", s) for s in ("x0", "y0", "x1", "y1")))


def round_corners_area(spark, sf_dir):
    """Areas of rounded rectangles: the corners lose (4 - pi) r^2, but for the arcs' segments."""
    return P.scene_areas(_box_pairs(spark, sf_dir).select("id", "w", "h"), {"area": S.Rectangle((0, 0), (col("w"), col("h")), 0.0, 0.2)}, "id").selectExpr("id", rounded("area", "area"))


def grad_sdf_rect(spark, sf_dir):
    """Derivatives of a rectangle's distance by its width, centre and angle."""
    cx, w = col("cx"), col("w")
    d = S.Rectangle((cx, -0.2), (w, 0.4 + K / 80.0), ANG, 0.05).sdf(X, Y)
    df = points(spark, sf_dir).selectExpr("*", "0.1D AS cx", "0.6D + k / 50D AS w")
    return with_columns(df, {"dw": derivative(d, w), "dcx": derivative(d, cx)}).selectExpr("pt", rounded("dw", "d_sdf_d_width"), rounded("dcx", "d_sdf_d_cx"))


def grad_softmask_fill(spark, sf_dir):
    """Derivative of the mean soft mask of every part's rectangle by its width, over a 16 by 16 raster."""
    n = 16
    w = col("w")
    g = table(spark, sf_dir, "part").selectExpr("p_partkey AS cell_id", "0.5D + CAST(p_size AS DOUBLE) / 50D AS w").selectExpr("*", f"explode(sequence(0, {n * n - 1})) AS node").selectExpr("*", f"(node % {n} + 0.5D) / {n}D * 2D - 1D AS x", f"(node DIV {n} + 0.5D) / {n}D * 2D - 1D AS y")
    m = 1.0 / (1.0 + call("exp", S.Rectangle((0.013, 0.027), (w, 0.7)).sdf(X, Y) / 0.1))
    return with_columns(g, {"dm": derivative(m, w)}).groupBy("cell_id").agg(F.avg("dm").alias("g")).selectExpr("cell_id", rounded("g", "d_fill_d_width"))


def grad_lattice(spark, sf_dir):
    """Derivative of the distance to a periodic disc by the length of a lattice vector."""
    p = col("p")
    cell = UnitCell(Lattice((p, 0.0), (0.3, 1.1)), S.Stadium((0.31, 0.27), 0.5, 0.5))
    d = cell.sdf(X, Y, [(i, j) for i in range(-2, 3) for j in range(-2, 3)])
    df = points(spark, sf_dir).selectExpr("*", "1.2D + k / 100D AS p")
    return with_columns(df, {"dp": derivative(d, p)}).selectExpr("pt", rounded("dp", "d_sdf_d_length"))


def grad_constrained(spark, sf_dir):
    """Parameters kept in range by smooth maps of raw values, and the derivative of a distance by a raw value through them."""
    raw = col("raw")
    w = bounded(raw, 0.2, 1.4)
    d = S.Bar(0.0, positive(raw)).sdf(X, Y)
    df = points(spark, sf_dir).selectExpr("*", "k / 5D - 5D AS raw")
    new = {"w": w, "p": positive(raw), "dw": derivative(w, raw), "dp": derivative(d, raw)}
    return with_columns(df, new).selectExpr("pt", rounded("w", "bounded"), rounded("p", "positive"), rounded("dw", "d_bounded"), rounded("dp", "d_sdf"))


def queries() -> dict:
    q = {f"sdf_{n}": _sdf(n) for n in figures()}
    q |= {f"csg_{k.__name__.lower()}": _csg(k, False) for k in (S.Union, S.Intersection, S.Difference)}
    q |= {f"csg_smooth_{k.__name__.lower()}": _csg(k, True) for k in (S.Union, S.Intersection, S.Difference)}
    q |= {"tf_translate": _tf(lambda r: r.translate(0.3, -0.4)), "tf_rotate": _tf(lambda r: r.rotate(ANG, (0.2, 0.3))), "tf_scale": _tf(lambda r: r.scale(0.5 + K / 50.0, (0.1, 0.2)))}
    plain = (
        bounds_all, min_feature_size, validate_shapes, project_params, csg_union_many, csg_setop_equivalence, tf_feature_size, tf_bounds, lattice_area, lattice_roundtrip, lattice_offset, neighbor_offsets, grid_fractional, grid_cartesian,
        fold_points, copy_ranges, piece_ranges, periodic_sdf_rect, periodic_sdf_hex, periodic_sdf_far, mask_hard, mask_soft, extent, center_bbox, center_centroid, poly_vertices, poly_area, poly_centroid, poly_outline_area, poly_transform, poly_raster, poly_covers, poly_distance,
        poly_boolean_area, cell_polygon_area, cell_polygon_area_hex, remove_holes_area, contour_area, gds_roundtrip, round_corners_area, fill_fraction, leaf_count, leaf_metrics, min_gap, cell_metrics, constraint_check, validate_cells, dup_pairs, dup_groups, generate_cells, generate_metrics, generate_valid, generate_hooks, generator_lattice, report_rollup, report_merge, scene_json_scan, yaml_roundtrip, grad_sdf_rect, grad_softmask_fill, grad_lattice, grad_constrained,
    )
    q |= {f.__name__: f for f in plain}
    return q | {"rasterize": raster, "rasterize_cartesian": raster_cartesian, "boundary_points": boundary}
