"""Periodic distances over a stream of points: the same stateless projection as for a table, so no watermark is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame

from periodica.ir import col, with_columns
from periodica.operators.lattice import UnitCell


def stream_periodic_sdf(points: DataFrame, cell: UnitCell, x: str = "x", y: str = "y", out: str = "sdf") -> DataFrame:
    """Adds the distance to each point of a stream (or table). The scene's copies are written out, which holds for any stream."""
    if not points.isStreaming:
        return with_columns(points, {out: cell.sdf(col(x), col(y))})
    copies = cell.copies()
    if len(copies) > 64:
        raise ValueError("the scene spans too many cells for one projection; move or split it")
    return with_columns(points, {out: cell.sdf(col(x), col(y), copies)})
