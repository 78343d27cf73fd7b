"""Distances as SQL functions: each is a SQL expression that Catalyst inlines into the calling plan."""

from __future__ import annotations

from pyspark.sql import SparkSession

from periodica.ir import col, sql
from periodica.operators import shapes as S

#: name -> (parameters, figure over them)
FUNCTIONS = {
    "pd_sdf_rectangle": (("cx", "cy", "w", "h", "angle", "r"), lambda p: S.Rectangle((p["cx"], p["cy"]), (p["w"], p["h"]), p["angle"], p["r"])),
    "pd_sdf_stadium": (("cx", "cy", "length", "width", "angle"), lambda p: S.Stadium((p["cx"], p["cy"]), p["length"], p["width"], p["angle"])),
    "pd_sdf_cross": (("cx", "cy", "length", "width", "angle", "ro", "ri"), lambda p: S.Cross((p["cx"], p["cy"]), p["length"], p["width"], p["angle"], p["ro"], p["ri"])),
    "pd_sdf_tshape": (("cx", "cy", "length", "width", "angle", "ro", "ri"), lambda p: S.TShape((p["cx"], p["cy"]), p["length"], p["width"], p["angle"], p["ro"], p["ri"])),
    "pd_sdf_bar_x": (("offs", "width"), lambda p: S.Bar(p["offs"], p["width"], "x")),
    "pd_sdf_bar_y": (("offs", "width"), lambda p: S.Bar(p["offs"], p["width"], "y")),
}


def register(spark: SparkSession) -> list[str]:
    """Registers temporary SQL functions (x, y, parameters...) -> DOUBLE; returns their names.

    Figures whose expressions share many parts (quads, ellipses, stars) have no such form, since a SQL function
    can't stage them; with_columns of the expression graph covers those.
    """
    for name, (params, make) in FUNCTIONS.items():
        body = sql(make({p: col(p) for p in params}).sdf(col("x"), col("y")))
        args = ", ".join(f"{p} DOUBLE" for p in ("x", "y", *params))
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS DOUBLE RETURN {body}")
    return list(FUNCTIONS)
