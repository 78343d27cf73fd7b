"""Random cells under constraints, reproducible from a seed whatever the partitioning.

Each cell has a random stream of its own, keyed by (seed, cell_id), so cells can be made anywhere in any order.
"""

from __future__ import annotations

import json
import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from periodica.ir import evaluate, lift, sqrt
from periodica.operators import shapes as S
from periodica.operators.lattice import Lattice, UnitCell
from periodica.operators.polygons import Region, cell_region, shape_region

SAMPLERS: dict[str, Callable] = {}


def register_sampler(name: str):
    """Decorator: makes a function (Draw) -> Shape known as the sampler of a shape name."""

    def put(fn):
        if name in SAMPLERS:
            raise ValueError(f"sampler {name!r} is registered already")
        SAMPLERS[name] = fn
        return fn

    return put


@dataclass
class Config:
    seed: int | None = None
    target_count: int = 1
    max_tries_per_shape: int = 100
    max_tries_per_cell: int = 100
    fixed_num_shapes: int | None = None
    min_num_shapes: int = 1
    max_num_shapes: int = 3
    allowed_shapes: tuple[str, ...] = ()
    shape_weights: dict = field(default_factory=dict)
    fixed_shape_params: dict = field(default_factory=dict)
    shape_param_ranges: dict = field(default_factory=dict)
    fixed_lattice_L: float | None = None
    lattice_L_range: tuple[float, float] | None = None
    fixed_lattice_Lx: float | None = None
    fixed_lattice_Ly: float | None = None
    lattice_Lx_range: tuple[float, float] | None = None
    lattice_Ly_range: tuple[float, float] | None = None
    min_shape_size: float | None = None
    min_feature_size: float | None = None
    min_gap: float | None = None
    extra: dict = field(default_factory=dict)

    def __post_init__(self):
        for k in ("target_count", "max_tries_per_cell", "max_tries_per_shape"):
            if getattr(self, k) < 1:
                raise ValueError(f"{k} must be >= 1")
        for k in ("fixed_num_shapes", "min_shape_size", "min_feature_size", "min_gap") + (() if self.fixed_num_shapes is not None else ("min_num_shapes", "max_num_shapes")):
            if (v := getattr(self, k)) is not None and v < 0:
                raise ValueError(f"{k} must be >= 0")
        if self.fixed_num_shapes is None and self.min_num_shapes > self.max_num_shapes:
            raise ValueError("min_num_shapes must be <= max_num_shapes")
        if any(v < 0 for v in self.shape_weights.values()):
            raise ValueError("shape_weights values must be >= 0")
        for k in ("fixed_lattice_L", "fixed_lattice_Lx", "fixed_lattice_Ly"):
            if (v := getattr(self, k)) is not None and v <= 0:
                raise ValueError(f"{k} must be > 0")
        for k in ("lattice_L_range", "lattice_Lx_range", "lattice_Ly_range"):
            if (v := getattr(self, k)) is not None and not 0 < v[0] <= v[1]:
                raise ValueError(f"{k} must be (lo, hi) with 0 < lo <= hi")


def intersect(*ranges):
    """The common part of ranges; None takes no part. ValueError if it is empty."""
    own = [r for r in ranges if r is not None]
    for lo, hi in own:
        if lo > hi:
            raise ValueError(f"invalid range: {(lo, hi)}")
    if not own:
        return None
    lo, hi = max(r[0] for r in own), min(r[1] for r in own)
    if lo > hi:
        raise ValueError(f"incompatible ranges: {tuple(own)}")
    return lo, hi


class Draw:
    """What a sampler draws from: the cell's box, limits, and parameters that are fixed or have ranges."""

    def __init__(self, rng: np.random.Generator, config: Config, lattice: Lattice, name: str):
        self.rng, self.name = rng, name
        self.fixed, self.ranges = config.fixed_shape_params.get(name, {}), config.shape_param_ranges.get(name, {})
        x0, x1, y0, y1 = (float(v) for v in evaluate(list(lattice.extent()), {}))
        self.box = x0, y0, x1, y1
        self.w, self.h = x1 - x0, y1 - y0
        self.min_size, self.min_feature = config.min_shape_size or 0.1, config.min_feature_size or 0.0
        self.tries = config.max_tries_per_shape

    def one(self, name: str, *default):
        """A parameter: fixed, or uniform over the common part of its ranges."""
        if self.fixed.get(name) is not None:
            return self.fixed[name]
        lo, hi = intersect(*default, self.ranges.get(name))
        return float(self.rng.uniform(lo, hi))

    def size(self, name: str, most: float) -> float:
        return self.one(name, (self.min_size, most), (self.min_feature, most))

    def pair(self, name: str, xr, yr):
        if self.fixed.get(name) is not None:
            return self.fixed[name]
        r = self.ranges.get(name)
        rx, ry = (None, None) if r is None else (r, r) if not isinstance(r[0], (list, tuple)) else r
        return tuple(float(self.rng.uniform(*intersect(a, b))) for a, b in ((xr, rx), (yr, ry)))

    def count(self, name: str, lo: int, hi: int) -> int:
        if self.fixed.get(name) is not None:
            return int(self.fixed[name])
        lo, hi = intersect((lo, hi), self.ranges.get(name))
        return int(self.rng.integers(math.ceil(lo), math.floor(hi) + 1))

    def place(self, make: Callable[[], dict]) -> S.Shape:
        """Draws parameters until the figure, turned, fits into the cell; then a centre that keeps it there."""
        kind = S.SHAPES[self.name]
        for _ in range(self.tries):
            p = make()
            x0, y0, x1, y1 = (float(v) for v in evaluate(list(kind(center=(0.0, 0.0), **p).bounds()), {}))
            dx, dy = max(-x0, x1), max(-y0, y1)
            if dx > self.w / 2 or dy > self.h / 2:
                continue
            center = self.fixed.get("center")
            if center is None:
                r = self.ranges.get("center") or (None, None)
                spans = (self.box[0] + dx, self.box[2] - dx), (self.box[1] + dy, self.box[3] - dy)
                center = tuple(float(self.rng.uniform(*intersect(s, q))) for s, q in zip(spans, r, strict=True))
            return kind(center=tuple(center), **p)
        raise RuntimeError(f"{FAILURES[self.name]}_too_large_for_canvas")


#: Names in failure reasons.
FAILURES = {"Rectangle": "rectangle", "IsoscelesTrapezoid": "trapezoid", "ConvexQuad": "convex_quad", "Ellipse": "ellipse", "Egg": "egg", "Stadium": "stadium", "RegularPolygon": "regular_polygon", "Triangle": "triangle", "Star": "star", "Cross": "cross", "TShape": "tshape"}
FULL = (0.0, 360.0)


@register_sampler("Rectangle")
def _rectangle(d: Draw):
    def make():
        w, h = d.pair("size", intersect((d.min_size, d.w), (d.min_feature, d.w)), intersect((d.min_size, d.h), (d.min_feature, d.h)))
        return {"size": (w, h), "angle": d.one("angle", FULL), "corner_radius": d.one("corner_radius", (0.0, min(w, h) / 2))}

    return d.place(make)


@register_sampler("ConvexQuad")
def _quad(d: Draw):
    def make():
        u = d.size("u", d.w) / 2 if d.fixed.get("u") is None else None
        v = d.size("v", d.h) / 2 if d.fixed.get("v") is None else None
        p = {"u": (u, 0.0) if u is not None else d.fixed["u"], "v": (0.0, v) if v is not None else d.fixed["v"], "alpha": d.one("alpha", (-0.4, 0.4)), "beta": d.one("beta", (-0.4, 0.4)), "angle": d.one("angle", FULL)}
        bound = float(evaluate([S.radius_bound(S.ConvexQuad(**p).frame())], {})[0])
        return {**p, "corner_radius": d.one("corner_radius", (0.0, 0.5 * bound))}

    return d.place(make)


@register_sampler("IsoscelesTrapezoid")
def _trapezoid(d: Draw):
    def make():
        b, t, h = d.size("bottom_width", d.w), d.size("top_width", d.w), d.size("height", d.h)
        return {"bottom_width": b, "top_width": t, "height": h, "angle": d.one("angle", FULL), "corner_radius": d.one("corner_radius", (0.0, min(b, t, h) / 2))}

    return d.place(make)


@register_sampler("Ellipse")
def _ellipse(d: Draw):
    return d.place(lambda: {"axes": d.pair("axes", intersect((d.min_size, d.w), (d.min_feature, d.w)), intersect((d.min_size, d.h), (d.min_feature, d.h))), "angle": d.one("angle", FULL)})


@register_sampler("Egg")
def _egg(d: Draw):
    return d.place(lambda: {"width": d.size("width", d.w), "height": d.size("height", d.h), "skew": d.one("skew", (-0.5, 0.5)), "angle": d.one("angle", FULL)})


@register_sampler("Stadium")
def _stadium(d: Draw):
    def make():
        length = d.size("length", max(d.w, d.h))
        return {"length": length, "width": d.size("width", length), "angle": d.one("angle", FULL)}

    return d.place(make)


@register_sampler("RegularPolygon")
def _regular(d: Draw):
    def make():
        n, s = d.count("n", 3, 8), d.size("side_length", min(d.w, d.h))
        return {"n": n, "side_length": s, "angle": d.one("angle", FULL), "corner_radius": d.one("corner_radius", (0.0, 0.5 * s / (2 * math.tan(math.pi / n))))}

    return d.place(make)


@register_sampler("Triangle")
def _triangle(d: Draw):
    def make():
        base, alpha = d.size("base", d.w), d.one("alpha", (20.0, 140.0))
        beta = d.one("beta", (20.0, min(140.0, 160.0 - alpha)))
        inradius = float(evaluate([S.Triangle(base=base, alpha=alpha, beta=beta).inradius()], {})[0])
        return {"base": base, "alpha": alpha, "beta": beta, "angle": d.one("angle", FULL), "corner_radius": d.one("corner_radius", (0.0, 0.5 * inradius))}

    return d.place(make)


@register_sampler("Star")
def _star(d: Draw):
    def make():
        n = d.count("n", 3, 7)
        R = d.one("outer_radius", (d.min_size / 2, min(d.w, d.h) / 2))
        r = d.one("inner_radius", (0.1 * R, 0.85 * R))
        return {"n": n, "outer_radius": R, "inner_radius": r, "angle": d.one("angle", (0.0, 360.0 / n)), "outer_corner_radius": d.one("outer_corner_radius", (0.0, 0.02 * r)), "inner_corner_radius": d.one("inner_corner_radius", (0.0, 0.02 * r))}

    return d.place(make)


def _junction(d: Draw, turn):
    def make():
        l = d.size("length", min(d.w, d.h))
        w = d.one("width", (max(0.1 * l, d.min_feature), 0.6 * l))
        ro = d.one("outer_corner_radius", (0.0, 0.25 * w))
        return {"length": l, "width": w, "angle": d.one("angle", turn), "outer_corner_radius": ro, "inner_corner_radius": d.one("inner_corner_radius", (0.0, max(0.0, 0.25 * (l - w) - 0.5 * ro)))}

    return d.place(make)


@register_sampler("Cross")
def _cross(d: Draw):
    return _junction(d, (0.0, 90.0))


@register_sampler("TShape")
def _tshape(d: Draw):
    return _junction(d, FULL)


@register_sampler("Bar")
def _bar(d: Draw):
    axis = d.fixed.get("axis") or str(d.rng.choice(["x", "y"]))
    lo, hi, span = (d.box[1], d.box[3], d.h) if axis == "x" else (d.box[0], d.box[2], d.w)
    w = d.one("width", (max(d.min_size, d.min_feature), span))
    return S.Bar(offset=d.one("offset", (lo, hi)), width=w, axis=axis)


class Validator:
    """Says why a cell is refused, or None. The default refuses scenes without figures and without area."""

    def validate(self, cell: UnitCell) -> str | None:
        r = cell_region(cell)
        return "empty" if not len(r.t) else "zero_area" if r.area() <= 0 else None


def resized(lattice: Lattice, whole=None, first=None, second=None) -> Lattice:
    """The lattice with its first vector's length `whole`, angles and proportions kept; else each vector with a length of its own, if given.

    Lengths and vectors are numbers or columns.
    """
    size = lambda v: sqrt(v[0] * v[0] + v[1] * v[1])
    if whole is not None:
        f = lift(whole) / size(lattice.a1)
        return Lattice(*(tuple(c * f for c in v) for v in (lattice.a1, lattice.a2)))
    return Lattice(*(v if new is None else tuple(c * (lift(new) / size(v)) for c in v) for v, new in ((lattice.a1, first), (lattice.a2, second))))


def sample_lattice(config: Config, lattice: Lattice, rng: np.random.Generator) -> Lattice:
    """The lattice, resized: as a whole (angles stay), or each vector on its own. The whole goes first where both are set."""
    pick = lambda fixed, span: fixed if fixed is not None else rng.uniform(*span) if span is not None else None
    if (whole := pick(config.fixed_lattice_L, config.lattice_L_range)) is not None:
        return resized(lattice, whole)
    return resized(lattice, None, pick(config.fixed_lattice_Lx, config.lattice_Lx_range), pick(config.fixed_lattice_Ly, config.lattice_Ly_range))


def shape_fits(shape: S.Shape, region: Region, accepted: list[Region], lattice: Lattice, config: Config) -> bool:
    x0, y0, x1, y1 = region.bounds()
    if config.min_shape_size is not None and min(x1 - x0, y1 - y0) < config.min_shape_size:
        return False
    if config.min_feature_size is not None and (e := shape.min_feature_size()) is not None and float(evaluate([e], {})[0]) < config.min_feature_size:
        return False
    gap = config.min_gap or 0.0
    shifts = [tuple(float(v) for v in evaluate(list(lattice.offset(i, j)), {})) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    endless = any(math.isinf(float(v)) for v in evaluate(list(shape.bounds()), {}))

    def near(r: Region, dx: float, dy: float) -> bool:
        return region.box_gap(m := r.moved(dx, dy)) <= gap and region.distance(m) <= gap

    if not endless and any(near(region, dx, dy) for dx, dy in shifts if dx or dy):
        return False
    return not any(near(r, dx, dy) for r in accepted for dx, dy in shifts)


def pick_name(config: Config, rng: np.random.Generator) -> str:
    names = list(config.allowed_shapes) or sorted(SAMPLERS)
    if not config.shape_weights:
        return str(rng.choice(names))
    w = np.array([float(config.shape_weights.get(n, 1.0)) for n in names])
    if w.sum() <= 0:
        raise ValueError("shape weights must not all be zero")
    return str(rng.choice(names, p=w / w.sum()))


def one_cell(config: Config, lattice: Lattice, rng: np.random.Generator) -> UnitCell:
    """One attempt; RuntimeError says why it failed."""
    n = config.fixed_num_shapes if config.fixed_num_shapes is not None else int(rng.integers(config.min_num_shapes, config.max_num_shapes + 1))
    shapes, regions = [], []
    for _ in range(n):
        for _ in range(config.max_tries_per_shape):
            name = pick_name(config, rng)
            if name not in SAMPLERS:
                raise NotImplementedError(f"no sampler for {name!r}")
            try:
                s = SAMPLERS[name](Draw(rng, config, lattice, name))
            except ValueError as e:
                raise RuntimeError(str(e)) from e
            region = shape_region(s).largest_without_holes()
            if shape_fits(s, region, regions, lattice, config):
                shapes.append(s)
                regions.append(region)
                break
        else:
            raise RuntimeError("shape_placement_failed")
    return UnitCell(lattice, S.union_all(shapes))


def make_cell(cell_id: int, config: Config, lattice: Lattice, validator=None, attempt_one=one_cell) -> tuple[UnitCell | None, int, Counter]:
    """(cell or None, attempts, reasons of failed attempts). attempt_one(config, lattice, rng) makes a cell or raises RuntimeError."""
    rng, reasons = np.random.default_rng([config.seed or 0, cell_id]), Counter()
    for attempt in range(1, config.max_tries_per_cell + 1):
        try:
            cell = attempt_one(config, sample_lattice(config, lattice, rng), rng)
        except RuntimeError as e:
            reasons[str(e)] += 1
            continue
        if (why := (validator or Validator()).validate(cell)) is None:
            return cell, attempt, reasons
        reasons[why] += 1
    return None, config.max_tries_per_cell, reasons


CELLS_SCHEMA = "cell_id long, cell string, attempts long, reasons map<string,long>, fill double"


def generate(spark: SparkSession, config: Config, lattice: Lattice, validator=None, attempt_one=one_cell) -> DataFrame:
    """One row for each requested cell; cell is its JSON form, NULL if all attempts failed; fill is its polygon area by the cell's.

    validator and attempt_one (see make_cell) are the hooks for generators of one's own; they travel to the executors.
    """
    a = tuple(tuple(float(v) for v in evaluate(list(x), {})) for x in (lattice.a1, lattice.a2))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i in b.id:
                cell, attempts, reasons = make_cell(int(i), config, Lattice(*a), validator, attempt_one)
                fill = None if cell is None else cell_region(cell).area() / float(evaluate([cell.lattice.area()], {})[0])
                out.append((i, None if cell is None else json.dumps(cell.to_parametric()), attempts, dict(reasons), fill))
            yield pd.DataFrame(out, columns=["cell_id", "cell", "attempts", "reasons", "fill"])

    return spark.range(config.target_count).mapInPandas(rows, CELLS_SCHEMA)


REPORT_COLUMNS = ("requested", "generated", "failed", "total_attempts", "failure_reasons", "parameter_ranges", "metadata")


def report(cells: DataFrame, metadata: dict | None = None) -> DataFrame:
    """One row: counts, reasons summed by key, range of fill, metadata as JSON."""
    counts = cells.agg(F.count("*").alias("requested"), F.count("cell").alias("generated"), F.coalesce(F.sum("attempts"), F.lit(0)).alias("total_attempts"), F.min("fill").alias("lo"), F.max("fill").alias("hi"))
    why = cells.select(F.explode("reasons").alias("k", "n")).groupBy("k").agg(F.sum("n").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias("failure_reasons"))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<struct<lo:double,hi:double>>"))
    ranges = F.when(F.col("lo").isNull(), none).otherwise(F.create_map(F.lit("fill_fraction"), F.struct("lo", "hi")))
    return counts.crossJoin(why).select("requested", "generated", (F.col("requested") - F.col("generated")).alias("failed"), "total_attempts", "failure_reasons", ranges.alias("parameter_ranges"), F.lit(json.dumps(metadata or {})).alias("metadata"))


def merge_reports(reports: DataFrame) -> DataFrame:
    """One row of all reports: counters and reasons summed, ranges widened, metadata gathered under `runs`. ValueError for none."""
    n = reports.limit(2).count()
    if not n:
        raise ValueError("nothing to merge")
    if n == 1:
        return reports.select(*REPORT_COLUMNS)
    total = reports.agg(*(F.sum(c).alias(c) for c in REPORT_COLUMNS[:4]), F.collect_list("metadata").alias("runs"))
    why = reports.select(F.explode("failure_reasons").alias("k", "n")).groupBy("k").agg(F.sum("n").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias("failure_reasons"))
    wide = reports.select(F.explode("parameter_ranges").alias("k", "r")).groupBy("k").agg(F.struct(F.min("r.lo").alias("lo"), F.max("r.hi").alias("hi")).alias("r")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "r")))).alias("parameter_ranges"))
    runs = F.concat(F.lit('{"runs": ['), F.array_join(F.array_sort("runs"), ", "), F.lit("]}"))
    return total.crossJoin(why).crossJoin(wide).select(*REPORT_COLUMNS[:4], "failure_reasons", "parameter_ranges", runs.alias("metadata"))
