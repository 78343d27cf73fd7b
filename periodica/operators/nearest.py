"""The union of very many figures at a table of points: each point meets only the figures that can be nearest.

Figures are put in tiles of a grid of bounded size by their centres; a tile keeps the box around its figures. No
figure of a tile can be farther from a point than the farthest corner of that box, and none can be nearer than the
box, so a tile whose box is farther than the least of all farthest corners holds no nearest figure. What is left
of the tiles, few for each point, is met by an equi join. The result is exact.

Before that, figures that lie within another one go, as far as their parameters tell (see Shape.growth): a figure's
distance is nowhere less than that of one that holds it, and of any number of nested ones no tile can part.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from periodica.ir import col, number, with_columns
from periodica.operators.shapes import Shape

#: Tiles along a side at most, and figures that a tile should hold on average where they are spread evenly.
MOST_SIDE, TILE_FIGURES = 64, 16
#: Figures that every task may hold at once; more are met by a shuffle.
MOST_HELD = 100_000


def outermost(figures: DataFrame, shape: Shape) -> DataFrame:
    """The rows of `figures` without those whose figure another one's holds, as far as sizes at equal other parameters tell; of equal figures one stays."""
    if (growth := shape.growth()) is None:
        return figures
    sizes, rest = ([e for e in es if number(e) is None] for es in growth)
    s, r = [f"_s{i}" for i in range(len(sizes))], [f"_r{i}" for i in range(len(rest))]
    f = with_columns(figures.select(F.struct(*figures.columns).alias("_row"), *figures.columns), dict(zip(s + r, sizes + rest, strict=True))).select("_row", *s, *r)
    f = f.groupBy(*r, *s[1:]).agg(F.max_by("_row", s[0]).alias("_row"), F.max(s[0]).alias(s[0])) if s else f.groupBy(*r).agg(F.any_value("_row").alias("_row"))
    if len(s) == 2:  # in falling order of one size, those stay whose other size exceeds all before
        before = Window.partitionBy(*r).orderBy(F.desc(s[1])).rowsBetween(Window.unboundedPreceding, -1)
        f = f.withColumn("_most", F.max(s[0]).over(before)).where(f"_most IS NULL OR {s[0]} > _most")
    return f.select("_row.*")


def union_distances(points: DataFrame, figures: DataFrame, shape: Shape, key: str = "pt", x: str = "x", y: str = "y", out: str = "sdf") -> DataFrame:
    """key, out: the least distance of each point to all figures, a figure of `shape` for each row of `figures`.

    shape's parameters are columns of `figures`, whose names must differ from those of key, x and y; figures without
    a box, for want of a parameter, don't count. NULL without figures. What reaches the driver and the tasks is a table of tiles, MOST_SIDE squared rows at most.
    """
    x0, y0, x1, y1 = shape.bounds()
    boxed = lambda df: with_columns(df, {"_x0": x0, "_y0": y0, "_x1": x1, "_y1": y1}).where(" AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in ("_x0", "_y0", "_x1", "_y1")))
    f = boxed(outermost(boxed(figures).select(*figures.columns), shape)).withColumns({"_mx": F.expr("(_x0 + _x1) / 2"), "_my": F.expr("(_y0 + _y1) / 2")})
    lo = f.agg(F.count("*"), F.min("_mx"), F.max("_mx"), F.min("_my"), F.max("_my")).first()
    if not lo[0]:
        return points.select(key, F.lit(None).cast("double").alias(out))
    side = max(1, min(MOST_SIDE, math.isqrt(lo[0] // TILE_FIGURES)))
    place = lambda c, a, b: F.least(F.floor((F.col(c) - a) / ((b - a) / side or 1.0)), F.lit(side - 1))
    f = f.withColumn("_tile", (place("_mx", lo[1], lo[2]) * side + place("_my", lo[3], lo[4])).cast("int"))
    rows = f.groupBy("_tile").agg(F.min("_x0"), F.min("_y0"), F.max("_x1"), F.max("_y1")).collect()  # side * side at most
    tiles, box = np.array([r[0] for r in rows], np.int32), np.array([r[1:] for r in rows], float)

    def candidates(batches):
        import pyarrow as pa

        for b in batches:
            k, px, py = b.column(0), *(b.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            step = max(1, 500_000 // len(tiles))
            for a in range(0, b.num_rows, step):
                u, v = px[a : a + step, None], py[a : a + step, None]
                near = np.hypot(np.maximum(np.maximum(box[:, 0] - u, u - box[:, 2]), 0), np.maximum(np.maximum(box[:, 1] - v, v - box[:, 3]), 0))
                far = np.hypot(np.maximum(u - box[:, 0], box[:, 2] - u), np.maximum(v - box[:, 1], box[:, 3] - v))
                r, t = np.nonzero(near <= far.min(axis=1, keepdims=True))
                at = pa.array(r + a)
                yield pa.RecordBatch.from_arrays([k.take(at), b.column(1).take(at), b.column(2).take(at), pa.array(tiles[t])], names=[key, "_px", "_py", "_tile"])

    kind = dict(points.dtypes)[key]
    met = points.select(key, F.col(x).cast("double").alias("_px"), F.col(y).cast("double").alias("_py")).mapInArrow(candidates, f"{key} {kind}, _px double, _py double, _tile int").join(F.broadcast(f) if lo[0] <= MOST_HELD else f, "_tile")
    return with_columns(met, {"_d": shape.sdf(col("_px"), col("_py"))}).groupBy(key).agg(F.min("_d").alias(out))
