"""Metrics of cells, design constraints and duplicate cells."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from periodica.ir import col, evaluate, number
from periodica.operators import shapes as S
from periodica.operators.components import connected_components
from periodica.operators.lattice import CopyRows, Lattice, UnitCell, fill_fraction, raster_distances, spread
from periodica.operators.polygons import Region, ring_area_rows, ring_distance_rows, scene_rows, shape_region
from periodica.stages import write_stage

FILL_SAMPLES, FINGERPRINT_SAMPLES = 64, 32

#: name -> Spark type, of the metrics of a cell
METRICS = {"fill_fraction": "double", "num_shapes": "int", "shape_areas": "array<double>", "shape_bbox_sizes": "array<struct<w:double,h:double>>", "min_feature_size": "double", "min_gap": "double"}


def _value(e) -> float | None:
    return None if e is None else float(evaluate([e], {})[0])


def min_gap(cell: UnitCell) -> float | None:
    """Least distance between figures, and between a figure and the eight nearest images of itself and others.

    An endless figure isn't measured against images that lie along its own direction. None if nothing is measured.
    """
    figures = S.leaves(cell.scene)
    regions = [shape_region(f).largest_without_holes() for f in figures]
    shifts = [(i, j, *map(float, evaluate(list(cell.lattice.offset(i, j)), {}))) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    best = math.inf
    for f, r in zip(figures, regions, strict=True):
        x0, y0, x1, y1 = (_value(b) for b in f.bounds())
        along_x, along_y = math.isinf(x0) or math.isinf(x1), math.isinf(y0) or math.isinf(y1)
        for i, j, dx, dy in shifts:
            if (i, j) == (0, 0) or along_x and abs(dx) > 1e-10 or along_y and abs(dy) > 1e-10:
                continue
            if r.box_gap(m := r.moved(dx, dy)) < best:
                best = min(best, r.distance(m))
    for a in range(len(regions)):
        for b in range(a + 1, len(regions)):
            for _, _, dx, dy in shifts:
                if regions[a].box_gap(m := regions[b].moved(dx, dy)) < best:
                    best = min(best, regions[a].distance(m))
    return None if math.isinf(best) else best


def metrics(cell: UnitCell, only: Sequence[str] = tuple(METRICS)) -> dict:
    """The metrics of one cell with constant parameters, or some of them."""
    figures = S.leaves(cell.scene)
    regions: list[Region] = [shape_region(f).largest_without_holes() for f in figures] if {"shape_areas", "shape_bbox_sizes"} & set(only) else []
    boxes = [r.bounds() for r in regions]

    def narrowest():
        found = [v for f in figures if (v := _value(f.min_feature_size())) is not None]
        return min(found) if found else None

    make = {
        "fill_fraction": lambda: fill_fraction(cell, FILL_SAMPLES), "num_shapes": lambda: len(figures), "shape_areas": lambda: [r.area() for r in regions],
        "shape_bbox_sizes": lambda: [{"w": b[2] - b[0], "h": b[3] - b[1]} for b in boxes], "min_feature_size": narrowest, "min_gap": lambda: min_gap(cell),
    }
    return {k: make[k]() for k in only}


def structured(data: dict) -> tuple[str, dict, list[float]]:
    """(structure, template, values) of a cell's JSON form: its numbers become columns p0, p1, ..., but for radii of zero and what isn't a size or place.

    Cells of one structure have one template, so they can be measured together.
    """
    values: list[float] = []

    def go(v, name=""):
        if isinstance(v, dict):
            return {k: go(x, k) for k, x in sorted(v.items())}
        if isinstance(v, list):
            return [go(x, name) for x in v]
        if isinstance(v, bool) or not isinstance(v, (int, float)) or name == "n" or "radius" in name and v == 0:
            return v
        values.append(float(v))
        return col(f"p{len(values) - 1}")

    template = go(data)
    return repr(template), template, values


def rows_metrics(cell: UnitCell, env: dict, n: int, only: Sequence[str] = tuple(METRICS)) -> dict[str, list] | None:
    """The metrics of n cells of one structure, whose parameters are columns; None where a figure is a composition, which each cell needs a region of its own for."""
    figures, rings = S.leaves(cell.scene), []
    for f in figures:
        own: list[np.ndarray] = []
        scene_rows(f, env, n, own)
        if len(own) != 1:
            return None
        rings.append(own[0])
    lo, hi = [r.min(axis=1) for r in rings], [r.max(axis=1) for r in rings]
    spread_ = lambda es: np.stack([np.broadcast_to(v, n) for v in evaluate(list(es), env)], axis=1)

    def gaps():
        best = np.full(n, math.inf)

        def meet(a: int, b: int, shift: np.ndarray, use: np.ndarray) -> None:
            apart = np.maximum(np.maximum(lo[b] + shift - hi[a], lo[a] - hi[b] - shift), 0.0)
            at = np.flatnonzero(use & (np.hypot(apart[:, 0], apart[:, 1]) < best))
            for k in range(0, len(at), 256):
                i = at[k : k + 256]
                best[i] = np.minimum(best[i], ring_distance_rows(rings[a][i], rings[b][i] + shift[i, None]))

        shifts = [(i, j, spread_(cell.lattice.offset(i, j))) for i in (-1, 0, 1) for j in (-1, 0, 1)]
        for a, f in enumerate(figures):
            ends = [number(e) for e in f.bounds()]
            along = [any(v is not None and math.isinf(v) for v in ends[k::2]) for k in (0, 1)]
            for i, j, d in shifts:
                if (i, j) != (0, 0):
                    use = ~((np.abs(d) > 1e-10) & along).any(axis=1)
                    meet(a, a, d, use)
            for b in range(a + 1, len(figures)):
                for _, _, d in shifts:
                    meet(a, b, d, np.ones(n, bool))
        return [None if math.isinf(v) else float(v) for v in best]

    def narrowest():
        found = [spread_([e])[:, 0] for f in figures if (e := f.min_feature_size()) is not None]
        return np.min(found, axis=0).tolist() if found else [None] * n

    make = {
        "fill_fraction": lambda: CopyRows(cell).fills(cell, {c: v[:, None] for c, v in env.items()}, n, FILL_SAMPLES),
        "num_shapes": lambda: [len(figures)] * n, "shape_areas": lambda: np.stack([np.abs(ring_area_rows(r)) for r in rings], axis=1).tolist(),
        "shape_bbox_sizes": lambda: [[{"w": float(h[i, 0] - l[i, 0]), "h": float(h[i, 1] - l[i, 1])} for l, h in zip(lo, hi, strict=True)] for i in range(n)],
        "min_feature_size": narrowest, "min_gap": gaps,
    }
    return {k: make[k]() for k in only}


def analyze(cells: DataFrame, only: Sequence[str] = tuple(METRICS)) -> DataFrame:
    """Metrics, or some of them, of each row of (cell_id, cell), the cell in its JSON form; a NULL cell gives NULLs.

    Cells of an Arrow batch that have one structure (the same tree of figures) are measured together in numpy.
    """
    only = list(only)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found: list = [None] * len(b)
            groups: dict[str, tuple[dict, list, list]] = {}
            for i, s in enumerate(b.cell):
                if isinstance(s, str):
                    key, template, values = structured(json.loads(s))
                    _, at, all_ = groups.setdefault(key, (template, [], []))
                    at.append(i), all_.append(values)
            for template, at, all_ in groups.values():
                env = {f"p{k}": v for k, v in enumerate(np.array(all_, float).reshape(len(at), -1).T)}
                m = rows_metrics(UnitCell.from_parametric(template), env, len(at), only)
                for k, i in enumerate(at):
                    found[i] = [m[name][k] for name in only] if m is not None else list(metrics(UnitCell.from_parametric(json.loads(b.cell.iloc[i])), only).values())
            out = {"cell_id": b.cell_id.tolist(), **{name: [None if f is None else f[k] for f in found] for k, name in enumerate(only)}}
            yield pd.DataFrame({k: pd.Series(v, dtype="Int32" if k == "num_shapes" else None if k == "cell_id" else object) for k, v in out.items()})

    kind = dict(cells.dtypes)["cell_id"]
    return spread(cells.select("cell_id", "cell"), "cell_id").mapInPandas(rows, ", ".join([f"cell_id {kind}", *(f"{k} {METRICS[k]}" for k in only)]))


def cells_from_nodes(nodes: DataFrame, lattice: Lattice) -> DataFrame:
    """(cell_id, cell): scenes put together from rows of nodes, over one lattice with constant vectors.

    nodes: cell_id, node_id, parent_id (of no node of the cell for a root), type, and params, the node's own parameters
    in JSON (NULL for none). Children come in the order of node_id, and any number of them: unions and transforms
    take the union of theirs, an intersection takes all, a difference takes the others from the first. Several roots
    are united. The nodes of a cell are one scene, so a group is as large as a scene.
    """
    whole = UnitCell(lattice, S.Rectangle((0, 0), (1, 1))).to_parametric()["lattice"]

    def fold(name: str, parts: list[dict]) -> dict:
        out = parts[0]
        for p in parts[1:]:
            out = {"type": name, "left": out, "right": p}
        return out

    def build(nodes: list[dict]) -> str:
        rows = {r["node_id"]: r for r in nodes}
        below: dict = {}
        for n in sorted(rows):
            parent = rows[n]["parent_id"]
            below.setdefault(parent if parent in rows and parent != n else None, []).append(n)

        def scene(n) -> dict:
            r, parts = rows[n], [scene(c) for c in below.get(n, ())]
            own = json.loads(r["params"]) if r["params"] is not None else {}
            if r["type"] in ("Union", "Intersection", "Difference"):
                if not parts:
                    raise ValueError(f"node {n} of a cell has no part")
                return fold(r["type"], parts)
            return {"type": r["type"], **own, **({"shape": fold("Union", parts)} if parts else {})}

        return json.dumps({"lattice": whole, "scene": fold("Union", [scene(n) for n in below[None]])})

    def cells(groups: pa.Array) -> pa.Array:
        return pa.array([build(g) for g in groups.to_pylist()], pa.string())

    grouped = nodes.groupBy("cell_id").agg(F.collect_list(F.struct("node_id", "parent_id", "type", "params")).alias("nodes"))
    return grouped.select("cell_id", F.arrow_udf(cells, returnType="string")("nodes").alias("cell"))


def leaf_rows(cells: DataFrame) -> DataFrame:
    """cell_id, ord (from 0), type, leaf (JSON): the figures that each scene joins, each under the transforms above it."""
    kind = dict(cells.dtypes)["cell_id"]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [(i, k, type(f).__name__, json.dumps(f.to_parametric())) for i, s in zip(b.cell_id, b.cell, strict=True) for k, f in enumerate(S.leaves(UnitCell.from_parametric(json.loads(s)).scene))]
            yield pd.DataFrame(found, columns=["cell_id", "ord", "type", "leaf"])

    return cells.select("cell_id", "cell").mapInPandas(rows, f"cell_id {kind}, ord int, type string, leaf string")


def printable(c: Column, digits: int) -> Column:
    """A double rounded to digits by its exact binary value, ties to the even digit, as C's printf does; format_string prints the result without rounding again.

    Java's formatter would round the shortest decimal form, and ties away from zero. The product with the power of
    ten is taken with its rounding error, from the double's two halves (digits up to 7), so the comparison with a half is exact.
    """
    a, s = F.abs(c.cast("double")), F.lit(float(10**digits))
    high = a * 134217729.0 - (a * 134217729.0 - a)
    p = a * s
    err = (high * s - p) + (a - high) * s
    whole = F.floor(p).cast("double")
    over = (p - whole) - F.lit(0.5)
    up = (over > 0) | ((over == 0) & ((err > 0) | ((err == 0) & (whole % 2 == 1))))
    return F.when(p < 1e15, (whole + F.when(up, 1.0).otherwise(0.0)) / s * F.signum(c.cast("double"))).otherwise(c)


@dataclass(frozen=True)
class Constraints:
    """Bounds; None leaves a quantity free."""

    min_fill: float | None = None
    max_fill: float | None = None
    min_num_shapes: int | None = None
    max_num_shapes: int | None = None
    min_feature_size: float | None = None
    min_shape_size: float | None = None
    min_gap: float | None = None

    def failures(self) -> Column:
        """Array of descriptions in a fixed order. Unknown quantities never fail; a gap fails at the bound too, all else beyond it."""
        out = []
        fill, feature, gap = printable(F.col("fill_fraction"), 3), printable(F.col("min_feature_size"), 4), printable(F.col("min_gap"), 4)
        if self.min_fill is not None:
            out.append(F.when(F.col("fill_fraction") < self.min_fill, F.format_string(f"fill_fraction %.3f < min_fill {self.min_fill}", fill)))
        if self.max_fill is not None:
            out.append(F.when(F.col("fill_fraction") > self.max_fill, F.format_string(f"fill_fraction %.3f > max_fill {self.max_fill}", fill)))
        if self.min_num_shapes is not None:
            out.append(F.when(F.col("num_shapes") < self.min_num_shapes, F.format_string(f"num_shapes %d < min_num_shapes {self.min_num_shapes}", "num_shapes")))
        if self.max_num_shapes is not None:
            out.append(F.when(F.col("num_shapes") > self.max_num_shapes, F.format_string(f"num_shapes %d > max_num_shapes {self.max_num_shapes}", "num_shapes")))
        if self.min_feature_size is not None:
            out.append(F.when(F.col("min_feature_size") < self.min_feature_size, F.format_string(f"min_feature_size %.4f < required {self.min_feature_size}", feature)))
        found = F.array(*out) if out else F.array().cast("array<string>")
        if self.min_shape_size is not None:
            m = self.min_shape_size
            sizes = F.transform("shape_bbox_sizes", lambda s, i: F.when((s["w"] < m) | (s["h"] < m), F.format_string(f"shape %d size (%.4f, %.4f) < min_shape_size {m}", i, printable(s["w"], 4), printable(s["h"], 4))))
            found = F.concat(found, sizes)
        if self.min_gap is not None:
            found = F.concat(found, F.array(F.when(F.col("min_gap") <= self.min_gap, F.format_string(f"min_gap %.4f <= required {self.min_gap}", gap))))
        return F.filter(found, lambda x: x.isNotNull())


def check(metrics_df: DataFrame, constraints: Constraints) -> DataFrame:
    """Adds failures (array) and failure (the first one, NULL if the cell passes)."""
    return metrics_df.withColumn("failures", constraints.failures()).withColumn("failure", F.try_element_at("failures", F.lit(1)))


def fingerprint(cell: UnitCell, n: int = FINGERPRINT_SAMPLES) -> list[float]:
    """Distances over an n by n fractional raster, row by row."""
    return raster_distances(cell, n).astype(np.float32).ravel().tolist()


def fingerprints(cells: DataFrame, n: int = FINGERPRINT_SAMPLES) -> DataFrame:
    """cell_id, fp of each row of (cell_id, cell), the cell in its JSON form."""
    kind = dict(cells.dtypes)["cell_id"]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"cell_id": b.cell_id, "fp": [fingerprint(UnitCell.from_parametric(json.loads(s)), n) for s in b.cell]})

    return spread(cells.select("cell_id", "cell"), "cell_id").mapInPandas(rows, f"cell_id {kind}, fp array<float>")


#: Entries that duplicate_pairs puts in buckets, and the width of a bucket in tolerances.
BUCKETED, BUCKET_WIDTH = 6, 16


def duplicate_classes(prints: DataFrame, key: str = "cell_id", fp: str = "fp") -> DataFrame:
    """(member, rep, size): each print's representative, the least key with an equal print, and how many prints are equal.

    Prints are compared by two 64-bit hashes, so only hashes and keys are written down and shuffled, and a print that a
    third of all rows share is counted before the shuffle.
    """
    p = write_stage(prints.where(F.size(fp) > 0).select(F.col(key).alias("member"), F.xxhash64(fp).alias("h1"), F.xxhash64(F.lit(7), F.reverse(fp)).alias("h2")), "print-hashes")
    return p.join(p.groupBy("h1", "h2").agg(F.min("member").alias("rep"), F.count("*").alias("size")), ["h1", "h2"]).select("member", "rep", "size")


def duplicate_pairs(prints: DataFrame, atol: float = 1e-3, key: str = "cell_id", fp: str = "fp") -> DataFrame:
    """(a, b), a < b: representatives of different prints that differ by atol at most in every entry, and each copy of a print with its representative.

    Equal prints are one class (see duplicate_classes), so n copies make n - 1 pairs, and no other pair of theirs is
    written out.
    """
    classes = write_stage(duplicate_classes(prints, key, fp), "print-classes")
    return near_pairs(prints, classes, atol, key, fp).union(classes.where("member <> rep").select("rep", "member"))


def near_pairs(prints: DataFrame, classes: DataFrame, atol: float, key: str = "cell_id", fp: str = "fp") -> DataFrame:
    """(a, b), a < b: representatives whose prints differ by atol at most in every entry.

    The search is exact: some entries, evenly spread, are put in buckets of several tolerances, and a print visits,
    beside its own bucket, those that a print within the tolerance may lie in, which are few. Only keys and bucket
    numbers are shuffled for that; the prints themselves are fetched for the pairs that meet. The prints of
    representatives are written down once, as they may be dear to make.
    """
    width, near = max(atol * BUCKET_WIDTH, 1e-12), atol * (1 + 1e-9)
    p = prints.select(F.col(key).alias("k"), F.col(fp).alias("v")).join(classes.where("member = rep").select(F.col("rep").alias("k")), "k", "left_semi").dropDuplicates(["k"])
    p = write_stage(p, "prints")
    at = [F.get("v", F.floor(F.size("v") * F.lit(i / BUCKETED)).cast("int")).cast("double").alias(f"e{i}") for i in range(BUCKETED)]
    e = p.select("k", F.size("v").alias("n"), *at)
    names = [f"b{i}" for i in range(BUCKETED)]
    home = e.select(F.col("k").alias("a"), "n", *(F.floor(F.col(f"e{i}") / width).alias(n) for i, n in enumerate(names)))
    guest = e.withColumnRenamed("k", "b")
    for i, n in enumerate(names):
        guest = guest.withColumn(n, F.explode(F.array_distinct(F.array(F.floor((F.col(f"e{i}") - near) / width), F.floor((F.col(f"e{i}") + near) / width)))))
    met = home.join(guest.select("b", "n", *names), ["n", *names]).where("a < b").select("a", "b")
    pairs = met.join(p.select(F.col("k").alias("a"), F.col("v").alias("va")), "a").join(p.select(F.col("k").alias("b"), F.col("v").alias("vb")), "b")
    far = F.array_max(F.zip_with("va", "vb", lambda x, y: F.abs(x.cast("double") - y.cast("double"))))
    return pairs.where(far <= atol).select("a", "b")


def duplicate_groups(prints: DataFrame, atol: float = 1e-3, key: str = "cell_id", fp: str = "fp") -> DataFrame:
    """(group_id, member) of the transitive closure over equal and near prints; a group has its least member's id and two members at least."""
    classes = write_stage(duplicate_classes(prints, key, fp), "print-classes")
    c = connected_components(near_pairs(prints, classes, atol, key, fp)).withColumnRenamed("node", "rep")
    placed = classes.join(c, "rep", "left").where("component IS NOT NULL OR size > 1")
    return placed.select(F.coalesce("component", "rep").alias("group_id"), "member")
