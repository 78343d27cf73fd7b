"""Polygons: exact measures of boolean compositions by slabs, distances, corner rounding, rasters.

A region is cut by vertical lines at every vertex and every crossing of edges. Within a slab the edges don't
cross, so any boolean composition is a list of trapezoids between neighbouring edges. Areas, centroids, bounds,
parts, holes and boundaries follow from the trapezoids.

A Region is one composition with constant parameters. Functions and operators named rows take a scene whose
parameters are columns: an Arrow batch of rows is measured together as numpy blocks, never row by row.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from periodica.ir import evaluate, number
from periodica.operators import shapes as S
from periodica.operators.lattice import distinct, spread

#: Half side of the box that stands for an endless stripe, and segments of a quarter circle: for discs and for rounded corners.
FAR, DISC_SEGMENTS, CORNER_SEGMENTS = 1e6, 16, 32


@dataclass
class Region:
    """Trapezoids: x0, x1, lower y at x0 and x1, upper y at x0 and x1; ordered by x0, then y."""

    t: np.ndarray
    #: The outline, where the region is a single ring: then it is one part without holes.
    ring: np.ndarray | None = None

    def area(self) -> float:
        x0, x1, a0, a1, b0, b1 = self.t.T
        return float((0.5 * (x1 - x0) * ((b0 - a0) + (b1 - a1))).sum())

    def is_empty(self) -> bool:
        return self.area() <= 0.0

    def centroid(self) -> tuple[float, float]:
        """Mean point of the area; (nan, nan) without area."""
        x0, x1, a0, a1, b0, b1 = self.t.T
        w = x1 - x0
        h0, h1 = b0 - a0, b1 - a1
        area = 0.5 * w * (h0 + h1)
        total = area.sum()
        if total <= 0:
            return math.nan, math.nan
        mx = w * (x0 * (h0 + h1) / 2 + w * (h0 + 2 * h1) / 6)
        my = w / 6 * ((b0 * b0 + b0 * b1 + b1 * b1) - (a0 * a0 + a0 * a1 + a1 * a1))
        return float(mx.sum() / total), float(my.sum() / total)

    def bounds(self) -> tuple[float, float, float, float]:
        if not len(self.t):
            return math.inf, math.inf, -math.inf, -math.inf
        x0, x1, a0, a1, b0, b1 = self.t.T
        return float(x0.min()), float(min(a0.min(), a1.min())), float(x1.max()), float(max(b0.max(), b1.max()))

    def contains(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        x, y = np.asarray(x, float)[..., None], np.asarray(y, float)[..., None]
        x0, x1, a0, a1, b0, b1 = self.t.T
        u = (x - x0) / np.where(x1 > x0, x1 - x0, 1.0)
        return ((x >= x0) & (x <= x1) & (y >= a0 + u * (a1 - a0)) & (y <= b0 + u * (b1 - b0))).any(axis=-1)

    def moved(self, dx: float, dy: float) -> Region:
        return Region(self.t + np.array([dx, dx, dy, dy, dy, dy]), None if self.ring is None else self.ring + [dx, dy])

    def _touching(self) -> list[tuple[int, int]]:
        """Neighbours across slab borders that share more than a point."""
        if (n := len(self.t)) <= 512:  # all pairs at once
            t = self.t
            return list(zip(*map(np.ndarray.tolist, np.nonzero((t[:, None, 1] == t[:, 0]) & (np.minimum(t[:, None, 5], t[:, 4]) - np.maximum(t[:, None, 3], t[:, 2]) > 1e-12))), strict=True)) if n else []
        out = []
        for line in np.unique(self.t[:, 1]):
            left, right = np.flatnonzero(self.t[:, 1] == line), np.flatnonzero(self.t[:, 0] == line)
            for i in left:
                for j in right:
                    if min(self.t[i, 5], self.t[j, 4]) - max(self.t[i, 3], self.t[j, 2]) > 1e-12:
                        out.append((int(i), int(j)))
        return out

    def parts(self) -> list[Region]:
        """Connected parts, largest first."""
        label = list(range(len(self.t)))

        def find(i):
            while label[i] != i:
                label[i] = label[label[i]]
                i = label[i]
            return i

        for i, j in self._touching():
            label[find(i)] = find(j)
        roots = np.array([find(i) for i in range(len(label))], int)
        return sorted((Region(self.t[roots == r]) for r in np.unique(roots)), key=lambda p: -p.area())

    def largest_without_holes(self) -> Region:
        """The largest part, with its holes filled."""
        if not len(self.t) or self.ring is not None:
            return self
        part = self.parts()[0]
        x0, y0, x1, y1 = part.bounds()
        xs = np.unique(part.t[:, :2])
        slab = np.searchsorted(xs, part.t[:, 0])
        if (xs[np.minimum(slab + 1, len(xs) - 1)] == part.t[:, 1]).all():  # each trapezoid is within one slab: what is outside lies between neighbours
            order = np.lexsort((part.t[:, 2] + part.t[:, 3], slab))
            own, slab = part.t[order], slab[order]
            first = np.append(True, slab[1:] != slab[:-1])
            below = np.where(first[:, None], y0 - 1.0, np.roll(own[:, 4:], 1, axis=0))
            top = own[np.append(first[1:], True)]
            rows = np.concatenate([np.column_stack([own[:, :2], below, own[:, 2:4]]), np.column_stack([top[:, :2], top[:, 4:], np.full((len(top), 2), y1 + 1.0)])])
        else:
            rows = part._outside(xs, y0, y1)
        outside = Region(np.asarray(rows))
        holes = [p.t for p in outside.parts() if p.bounds()[1] > y0 - 0.5 and p.bounds()[3] < y1 + 0.5 and p.bounds()[0] > x0 and p.bounds()[2] < x1]
        return Region(np.concatenate([part.t, *holes])) if holes else part

    def _outside(self, xs: np.ndarray, y0: float, y1: float) -> list[tuple]:
        """Trapezoids of what is outside between xs, from one below y0 to one above y1."""
        rows = []
        for a, b in zip(xs[:-1], xs[1:], strict=True):  # what is outside, within the box
            own = self.t[(self.t[:, 0] <= a) & (self.t[:, 1] >= b)]
            u0, u1 = [(v - own[:, 0]) / (own[:, 1] - own[:, 0]) for v in (a, b)]
            lo = np.stack([own[:, 2] + u0 * (own[:, 3] - own[:, 2]), own[:, 2] + u1 * (own[:, 3] - own[:, 2])], 1)
            hi = np.stack([own[:, 4] + u0 * (own[:, 5] - own[:, 4]), own[:, 4] + u1 * (own[:, 5] - own[:, 4])], 1)
            order = np.argsort(lo.sum(axis=1))
            at = np.array([y0 - 1.0, y0 - 1.0])
            for l_, h_ in zip(lo[order], hi[order], strict=True):
                rows.append((a, b, at[0], at[1], l_[0], l_[1]))
                at = h_
            rows.append((a, b, at[0], at[1], y1 + 1.0, y1 + 1.0))
        return rows

    def boundary(self) -> np.ndarray:
        """Segments (x0, y0, x1, y1) of the outline."""
        if self.ring is not None:
            return np.concatenate([self.ring, np.roll(self.ring, -1, axis=0)], axis=1)
        x0, x1, a0, a1, b0, b1 = self.t.T
        flat = [np.stack([x0, a0, x1, a1], 1), np.stack([x0, b0, x1, b1], 1)]
        steps = []
        for line in np.unique(self.t[:, :2]):
            spans = [(t[3], t[5], 0) for t in self.t[self.t[:, 1] == line]] + [(t[2], t[4], 1) for t in self.t[self.t[:, 0] == line]]
            cuts = sorted({v for s in spans for v in s[:2]})
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                on = [any(s[0] <= lo and s[1] >= hi and s[2] == k for s in spans) for k in (0, 1)]
                if on[0] != on[1] and hi > lo:
                    steps.append((line, lo, line, hi))
        # where trapezoids of a slab touch, their common edge isn't outline
        seg = np.concatenate([*flat, np.array(steps).reshape(-1, 4)])
        key = np.round(seg, 12)
        _, first, count = np.unique(key, axis=0, return_index=True, return_counts=True)
        return seg[first[count == 1]]

    def box_gap(self, other: Region) -> float:
        """A lower bound of the distance: that of the boxes."""
        a, b = self.bounds(), other.bounds()
        return math.hypot(max(b[0] - a[2], a[0] - b[2], 0.0), max(b[1] - a[3], a[1] - b[3], 0.0))

    def distance(self, other: Region) -> float:
        """Least distance; 0 where the regions touch or overlap."""
        if not len(self.t) or not len(other.t):
            return math.inf
        a, b = self.boundary(), other.boundary()
        if self.ring is not None and other.ring is not None:
            return float(ring_distance_rows(self.ring[None], other.ring[None])[0])
        if self.contains(b[:, 0], b[:, 1]).any() or other.contains(a[:, 0], a[:, 1]).any():
            return 0.0
        return float(segment_distances(a, b).min())


def segment_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(..., k, l) distances of each segment of a (..., k, 4) to each of b (..., l, 4); 0 where they cross."""

    def to_points(s, p):
        d = s[..., :, None, 2:] - s[..., :, None, :2]
        w = p[..., None, :, :] - s[..., :, None, :2]
        n = (d * d).sum(-1)
        t = np.clip((w * d).sum(-1) / np.where(n > 0, n, 1.0), 0, 1)
        return np.linalg.norm(w - t[..., None] * d, axis=-1)

    back = lambda m: np.swapaxes(m, -1, -2)
    out = np.minimum(np.minimum(to_points(a, b[..., :2]), to_points(a, b[..., 2:])), back(np.minimum(to_points(b, a[..., :2]), to_points(b, a[..., 2:]))))
    side = lambda p, q, r: (q[..., 0] - p[..., 0]) * (r[..., 1] - p[..., 1]) - (q[..., 1] - p[..., 1]) * (r[..., 0] - p[..., 0])
    a0, a1, b0, b1 = a[..., :, None, :2], a[..., :, None, 2:], b[..., None, :, :2], b[..., None, :, 2:]
    cross = (side(a0, a1, b0) * side(a0, a1, b1) < 0) & (side(b0, b1, a0) * side(b0, b1, a1) < 0)
    return np.where(cross, 0.0, out)


def inside_rows(rings: np.ndarray, points: np.ndarray) -> np.ndarray:
    """(n, l) whether points (n, l, 2) lie within their row's ring (n, k, 2), even-odd."""
    a, b = rings[:, None], np.roll(rings, -1, axis=1)[:, None]
    x, y = points[:, :, None, 0], points[:, :, None, 1]
    over = (a[..., 1] > y) != (b[..., 1] > y)
    rise = np.where(over, b[..., 1] - a[..., 1], 1.0)
    return (over & (x < a[..., 0] + (y - a[..., 1]) / rise * (b[..., 0] - a[..., 0]))).sum(axis=-1) % 2 == 1


def ring_distance_rows(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(n,) least distance of each row's rings (n, k, 2) and (n, l, 2); 0 where they touch, cross or hold each other."""
    sides = lambda r: np.concatenate([r, np.roll(r, -1, axis=1)], axis=2)
    d = segment_distances(sides(a), sides(b)).min(axis=(1, 2))
    return np.where(inside_rows(a, b).any(axis=1) | inside_rows(b, a).any(axis=1), 0.0, d)


def compose(rings: list[np.ndarray], inside: Callable[[list[bool]], bool]) -> Region:
    """The region of a boolean function, by &, | and ~, of "within ring k" (even-odd)."""
    segs = []
    for k, r in enumerate(rings):
        nxt = np.roll(r, -1, axis=0)
        segs.append(np.column_stack([r, nxt, np.full(len(r), k)]))
    e = np.concatenate(segs) if segs else np.empty((0, 5))
    if not len(e):
        return Region(np.empty((0, 6)))
    swap = e[:, 0] > e[:, 2]
    e[swap] = e[swap][:, [2, 3, 0, 1, 4]]
    xs = [e[:, 0], e[:, 2]]
    d = e[:, 2:4] - e[:, :2]
    step = max(1, 1_000_000 // len(e))
    for a in range(0, len(e) - 1, step):  # crossings with later edges, a block of edges at a time
        i = np.arange(a, min(a + step, len(e) - 1))
        i, j = np.nonzero(i[:, None] < np.arange(len(e)))
        i += a
        den = d[i, 0] * d[j, 1] - d[i, 1] * d[j, 0]
        ok = np.abs(den) > 1e-15
        i, j, den = i[ok], j[ok], den[ok]
        w = e[j, :2] - e[i, :2]
        t, u = (w[:, 0] * d[j, 1] - w[:, 1] * d[j, 0]) / den, (w[:, 0] * d[i, 1] - w[:, 1] * d[i, 0]) / den
        hit = (t > 0) & (t < 1) & (u > 0) & (u < 1)
        xs.append(e[i[hit], 0] + t[hit] * d[i[hit], 0])
    x = np.unique(np.concatenate(xs))
    x = x[np.concatenate(([True], np.diff(x) > 1e-13))]
    e = e[e[:, 2] > e[:, 0]]
    found = [np.empty((0, 6))]
    step = max(1, 1_000_000 // max(1, len(e)))
    for k in range(0, len(x) - 1, step) if len(e) else ():  # slabs, a block at a time
        a, b = (v[k : k + step, None] for v in (x[:-1], x[1:]))
        on = (e[:, 0] <= a + 1e-13) & (e[:, 2] >= b - 1e-13)
        slope = (e[:, 3] - e[:, 1]) / (e[:, 2] - e[:, 0])
        ya, yb = e[:, 1] + (a - e[:, 0]) * slope, e[:, 1] + (b - e[:, 0]) * slope
        order = np.argsort(np.where(on, ya + yb, np.inf), axis=1, kind="stable")
        ya, yb, on = (np.take_along_axis(v, order, 1) for v in (ya, yb, on))
        own = np.where(on, e[order, 4], -1)
        now = np.broadcast_to(inside([(np.cumsum(own == r, axis=1) % 2).astype(bool) for r in range(len(rings))]), on.shape)
        was = np.column_stack([np.zeros(len(now), bool), now[:, :-1]])
        opened = now & ~was & on
        opened[np.flatnonzero(now[:, -1]), (opened.shape[1] - 1 - np.argmax(opened[:, ::-1], axis=1))[now[:, -1]]] = False  # never closed
        (r, lo), (_, hi) = np.nonzero(opened), np.nonzero(was & ~now & on)
        got = np.column_stack([a[r, 0], b[r, 0], ya[r, lo], yb[r, lo], ya[r, hi], yb[r, hi]])
        found.append(got[got[:, 4] + got[:, 5] > got[:, 2] + got[:, 3]])
    return Region(np.concatenate(found))


def area_rows(rings: list[np.ndarray], inside: Callable) -> np.ndarray:
    """(n,) areas of one boolean function of many rows of rings (n, k, 2), by slabs of all rows together.

    Between neighbouring cuts edges don't cross, so a slab's area is its width times the heights, at its middle,
    that the function holds for.
    """
    n = len(rings[0])
    if len(rings) == 1 and bool(inside([np.True_])) and not bool(inside([np.False_])):
        return np.abs(ring_area_rows(rings[0]))
    e = np.concatenate([np.concatenate([r, np.roll(r, -1, axis=1)], axis=2) for r in rings], axis=1)
    ring = np.repeat(np.arange(len(rings)), [r.shape[1] for r in rings])
    e = np.where((e[..., :1] > e[..., 2:3]), e[..., [2, 3, 0, 1]], e)
    out = np.empty(n)
    i, j = np.triu_indices(len(ring), 1)
    step = max(1, 4_000_000 // max(1, len(i)))
    for at in range(0, n, step):
        out[at : at + step] = _slab_areas(e[at : at + step], ring, i, j, inside)
    return out


def _slab_areas(e: np.ndarray, ring: np.ndarray, i: np.ndarray, j: np.ndarray, inside: Callable) -> np.ndarray:
    d = e[..., 2:] - e[..., :2]
    with np.errstate(all="ignore"):
        den = d[:, i, 0] * d[:, j, 1] - d[:, i, 1] * d[:, j, 0]
        w = e[:, j, :2] - e[:, i, :2]
        t, u = (w[..., 0] * d[:, j, 1] - w[..., 1] * d[:, j, 0]) / den, (w[..., 0] * d[:, i, 1] - w[..., 1] * d[:, i, 0]) / den
        hit = (np.abs(den) > 1e-15) & (t > 0) & (t < 1) & (u > 0) & (u < 1)
        x = np.sort(np.concatenate([e[..., 0], e[..., 2], np.where(hit, e[:, i, 0] + t * d[:, i, 0], np.inf)], axis=1), axis=1)
        x = x[:, : int(np.isfinite(x).sum(axis=1).max())]
        x = np.where(np.isfinite(x), x, np.max(e[..., 2], axis=1)[:, None])  # empty slabs at the end
        width, mid = np.diff(x, axis=1), 0.5 * (x[:, 1:] + x[:, :-1])
        used = (width > 1e-13).any(axis=0)
        width, mid = width[:, used], mid[:, used]
        slope = np.where(d[..., 0] > 0, d[..., 1] / np.where(d[..., 0] > 0, d[..., 0], 1.0), 0.0)
        total = np.zeros(len(e))
        step = max(1, 2_000_000 // max(1, e.shape[0] * e.shape[1]))
        for a in range(0, mid.shape[1], step):
            m = mid[:, a : a + step, None]
            on = (e[:, None, :, 0] < m) & (e[:, None, :, 2] > m)
            y = np.where(on, e[:, None, :, 1] + (m - e[:, None, :, 0]) * slope[:, None], np.inf)
            order = np.argsort(y, axis=2, kind="stable")
            y, own = np.take_along_axis(y, order, 2), np.where(np.take_along_axis(on, order, 2), ring[order], -1)
            now = inside([(np.cumsum(own == k, axis=2) % 2).astype(bool) for k in range(int(ring.max()) + 1)])
            height = np.diff(y, axis=2)
            total += (width[:, a : a + step] * np.where(now[..., :-1] & np.isfinite(height), height, 0.0).sum(axis=2)).sum(axis=1)
    return total


# ---- rings of shapes ------------------------------------------------------------------------------------------


def ring_area_rows(r: np.ndarray) -> np.ndarray:
    """(n,) signed areas of rings (n, k, 2)."""
    n = np.roll(r, -1, axis=1)
    return 0.5 * (r[..., 0] * n[..., 1] - n[..., 0] * r[..., 1]).sum(axis=1)


def ring_area(r: np.ndarray) -> float:
    """Signed area."""
    return float(ring_area_rows(r[None])[0])


def round_corners_rows(rings: np.ndarray, radius: np.ndarray, mode: str = "outer", quad_segs: int = CORNER_SEGMENTS, inner_radius: np.ndarray | None = None) -> np.ndarray:
    """Corners of rings (n, k, 2) replaced by arcs that touch both sides: convex ones (outer), concave ones (inner), or both.

    Radii are (n,). An arc has quad_segs segments for each right angle that it turns by, begun ones included; where
    rows need different numbers, or none, points are repeated, which changes no measure.
    """
    if mode not in ("outer", "inner", "both"):
        raise ValueError("mode must be 'outer', 'inner' or 'both'")
    inner_radius = radius if inner_radius is None else inner_radius
    if (radius < 0).any() or (inner_radius < 0).any():
        raise ValueError("radius must be non-negative")
    if quad_segs < 1:
        raise ValueError("quad_segs must be positive")
    a, b = np.roll(rings, 1, axis=1) - rings, np.roll(rings, -1, axis=1) - rings
    la, lb = np.linalg.norm(a, axis=2), np.linalg.norm(b, axis=2)
    turn = np.sign(ring_area_rows(rings))[:, None] * (b[..., 0] * a[..., 1] - b[..., 1] * a[..., 0])
    r = np.where(turn > 0, radius[:, None] if mode != "inner" else 0.0, inner_radius[:, None] if mode != "outer" else 0.0) * (turn != 0)
    half = 0.5 * np.arccos(np.clip((a * b).sum(axis=2) / (la * lb), -1, 1))
    sharp = (r <= 0) | (half >= np.pi / 2 - 1e-12)
    tan = np.tan(np.where(sharp, 0.5, half))
    reach = np.minimum(np.where(sharp, 0.0, r) / tan, np.minimum(la, lb))  # from the corner to where the arc touches
    r = reach * tan
    ua, ub = a / la[..., None], b / lb[..., None]
    mid = ua + ub
    size = np.linalg.norm(mid, axis=2)
    c = rings + mid / np.where(size > 0, size, 1.0)[..., None] * (r / np.sin(np.where(sharp, 0.5, half)))[..., None]
    v0, v1 = rings + ua * reach[..., None] - c, rings + ub * reach[..., None] - c
    start = np.arctan2(v0[..., 1], v0[..., 0])
    sweep = np.where(sharp, 0.0, (np.arctan2(v1[..., 1], v1[..., 0]) - start + np.pi) % (2 * np.pi) - np.pi)
    n = np.where(sharp, 0, np.maximum(1, np.ceil(np.abs(sweep) / (np.pi / 2) * quad_segs - 1e-9))).astype(int)
    parts = []
    for k in range(rings.shape[1]):
        i = np.arange(int(n[:, k].max(initial=0)) + 1)
        t = start[:, k, None] + sweep[:, k, None] * np.minimum(i[None], n[:, k, None]) / np.maximum(n[:, k, None], 1)
        arc = c[:, k, None] + r[:, k, None, None] * np.stack([np.cos(t), np.sin(t)], axis=2)
        parts.append(np.where(sharp[:, k, None, None], rings[:, k, None], arc))
    return np.concatenate(parts, axis=1)


def round_corners(ring: np.ndarray, radius: float, mode: str = "outer", quad_segs: int = CORNER_SEGMENTS, inner_radius: float | None = None) -> np.ndarray:
    """One ring with its corners rounded. Radius 0 changes nothing."""
    return round_corners_rows(np.asarray(ring, float)[None], np.array([radius], float), mode, quad_segs, None if inner_radius is None else np.array([inner_radius], float))[0]


def _numbers(es) -> list[float]:
    return [float(v) for v in evaluate(list(es), {})]


def _arc(start: float, stop: float, n: int) -> np.ndarray:
    """n + 1 points of the unit circle."""
    t = np.linspace(start, stop, n + 1)
    return np.stack([np.cos(t), np.sin(t)], axis=1)


def ring_rows(s: S.Shape, env: dict, n: int) -> np.ndarray:
    """(n, k, 2) outline of a primitive whose parameters are numbers or columns of env, which hold n values each."""
    get = lambda es: np.stack([np.broadcast_to(v, n) for v in evaluate(list(es), env)], axis=1)
    if isinstance(s, S.Bar):
        lo, hi = get((s.offset - 0.5 * s.width, s.offset + 0.5 * s.width)).T
        far = np.full(n, FAR)
        box = np.stack([np.stack(p, axis=1) for p in ((-far, lo), (far, lo), (far, hi), (-far, hi))], axis=1)
        return box if s.axis == "x" else box[:, ::-1, ::-1]
    if isinstance(s, S.Ellipse):
        local = _arc(0, 2 * np.pi, 4 * DISC_SEGMENTS)[None, :-1] * (0.5 * get(s.axes))[:, None]
    elif isinstance(s, S.Egg):
        a, up, down = get(s.halves()).T[..., None]
        t = _arc(0, np.pi, 63)[:-1]
        top, low = np.stack([a * t[:, 0], up * t[:, 1]], axis=2), np.stack([-a * t[:, 0], -down * t[:, 1]], axis=2)
        local = np.concatenate([top, low], axis=1)
    elif isinstance(s, S.Stadium):
        l, w = get((s.length, s.width)).T[..., None, None]
        end = 0.5 * w * _arc(-np.pi / 2, np.pi / 2, 2 * DISC_SEGMENTS)[None] + np.concatenate([0.5 * (l - w), 0 * l], axis=2)
        local = np.concatenate([end, -end], axis=1)
    else:
        corners = s.corners()
        ring = get(v for p in corners for v in p).reshape(n, len(corners), 2)
        radii = (s.outer_corner_radius, s.inner_corner_radius) if isinstance(s, (S.Star, S._Junction)) else (s.corner_radius,)
        if all(number(r) == 0 for r in radii):
            return ring
        if len(radii) == 2:
            ro, ri = get(radii).T
            return round_corners_rows(ring, ro, "both", inner_radius=ri)
        return round_corners_rows(ring, get((s.corner_radius,))[:, 0], "outer", DISC_SEGMENTS if isinstance(s, S.Rectangle) else CORNER_SEGMENTS)
    return _turned(local, np.radians(get((s.angle,))[:, 0])) + get(s.center)[:, None]


def _turned(rings: np.ndarray, t: np.ndarray) -> np.ndarray:
    c, q = np.cos(t)[:, None], np.sin(t)[:, None]
    return np.stack([c * rings[..., 0] - q * rings[..., 1], q * rings[..., 0] + c * rings[..., 1]], axis=2)


def shape_ring(s: S.Shape) -> np.ndarray:
    """Outline of a primitive with constant parameters, as vertices; repeated ones are left out."""
    r = ring_rows(s, {}, 1)[0]
    return r[(r != np.roll(r, 1, axis=0)).any(axis=1)]


def scene_rows(s: S.Shape, env: dict, n: int, rings: list[np.ndarray], move: Callable[[np.ndarray], np.ndarray] = lambda r: r) -> Callable:
    """Collects the rings (n, k, 2) of a scene; gives the boolean function, by &, | and ~, of being within them. Smoothing is ignored."""
    get = lambda es: np.stack([np.broadcast_to(v, n) for v in evaluate(list(es), env)], axis=1)
    if isinstance(s, S._Boolean):
        a, b = scene_rows(s.left, env, n, rings, move), scene_rows(s.right, env, n, rings, move)
        if isinstance(s, S.Union):
            return lambda v: a(v) | b(v)
        if isinstance(s, S.Intersection):
            return lambda v: a(v) & b(v)
        return lambda v: a(v) & ~b(v)
    if isinstance(s, S.Translate):
        d = get((s.dx, s.dy))[:, None]
        return scene_rows(s.shape, env, n, rings, lambda r: move(r + d))
    if isinstance(s, S.Rotate):
        t, o = np.radians(get((s.angle,))[:, 0]), get(s.origin)[:, None]
        return scene_rows(s.shape, env, n, rings, lambda r: move(_turned(r - o, t) + o))
    if isinstance(s, S.Scale):
        f, o = get((s.factor,))[:, None], get(s.origin)[:, None]
        return scene_rows(s.shape, env, n, rings, lambda r: move((r - o) * f + o))
    k = len(rings)
    rings.append(move(ring_rows(s, env, n)))
    return lambda v: v[k]


def shape_region(s: S.Shape) -> Region:
    rings: list[np.ndarray] = []
    inside = scene_rows(s, {}, 1, rings)
    out = compose([r[0] for r in rings], inside)
    return Region(out.t, rings[0][0]) if len(rings) == 1 else out


def cell_rows(cell, env: dict, n: int, span) -> tuple[list[np.ndarray], Callable]:
    """Rings and function of all copies in span (i0, i1, j0, j1), within the cell's parallelogram."""
    get = lambda es: np.stack([np.broadcast_to(v, n) for v in evaluate(list(es), env)], axis=1)
    rings: list[np.ndarray] = []
    tests = []
    i0, i1, j0, j1 = map(int, span)
    for i in range(i0, i1 + 1):
        for j in range(j0, j1 + 1):
            o = get(cell.lattice.offset(i, j))[:, None]
            tests.append(scene_rows(cell.scene, env, n, rings, lambda r, o=o: r + o))
    a1, a2 = get(cell.lattice.a1), get(cell.lattice.a2)
    k = len(rings)
    rings.append(np.stack([a1 * 0, a1, a1 + a2, a2], axis=1))
    return rings, lambda v: v[k] & reduce(or_, [t(v) for t in tests])


def cell_region(cell) -> Region:
    """All copies of the scene within the cell's parallelogram."""
    rings, inside = cell_rows(cell, {}, 1, [number(e) for pair in cell.copy_ranges() for e in pair])
    return compose([r[0] for r in rings], inside)


# ---- operators over tables of scenes --------------------------------------------------------------------------


def _over_rows(df: DataFrame, key: str, outs: list[str], run: Callable[[dict, int], list]) -> DataFrame:
    """key and DOUBLE columns outs: run(columns, number of rows) for each Arrow batch. The rows, a few numbers each, are dealt over the configured number of tasks."""
    names = [c for c in df.columns if c != key]

    def rows(batches):
        for b in batches:
            if b.num_rows:
                env = {c: np.asarray(b.column(c).to_numpy(zero_copy_only=False), float) for c in names}
                yield pa.RecordBatch.from_arrays([b.column(key), *(pa.array(v, pa.float64()) for v in run(env, b.num_rows))], names=[key, *outs])

    return spread(df, key).mapInArrow(rows, ", ".join([f"{key} {dict(df.dtypes)[key]}", *(f"{o} double" for o in outs)]))


def scene_areas(df: DataFrame, scenes: dict[str, S.Shape], key: str) -> DataFrame:
    """key and, by name, the exact area of each scene's polygons, with parameters from the columns of each row."""

    def area(scene, env, n):
        rings: list[np.ndarray] = []
        inside = scene_rows(scene, env, n, rings)
        return area_rows(rings, inside)

    return _over_rows(df, key, list(scenes), lambda env, n: [area(s, env, n) for s in scenes.values()])


def largest_part_areas(df: DataFrame, scene: S.Shape, key: str, out: str = "area") -> DataFrame:
    """key, out: area of the largest part of a scene with parameters from the columns, its holes filled; 0 for an empty one.

    Rows whose rings are convex and apart from each other, nested or not, are measured together by what holds what
    (see nested_areas); others are gone through one by one, as parts and holes hang on the topology of their slabs.
    """

    def run(env, n):
        rings: list[np.ndarray] = []
        inside = scene_rows(scene, env, n, rings)
        rings = [np.broadcast_to(r, (n, *r.shape[1:])) for r in rings]

        def single(k: int) -> float:
            g = compose([r[k] for r in rings], inside)
            return 0.0 if g.is_empty() else g.largest_without_holes().area()

        got, plain = np.zeros(n), plain_rows(rings)
        held = np.stack([inside_rows(rings[q], rings[p][:, :1])[:, 0] & (p != q) for p in range(len(rings)) for q in range(len(rings))], axis=1)
        kinds, which = np.unique(held, axis=0, return_inverse=True)
        for k, kind in enumerate(kinds):
            at = np.flatnonzero(plain & (which.ravel() == k))
            if len(at):
                areas = nested_areas([r[at] for r in rings], kind.reshape(len(rings), -1), inside)
                # one row of each kind is composed too: where that differs, none of the kind is taken
                if areas is not None and math.isclose(areas[0], single(int(at[0])), rel_tol=1e-9, abs_tol=1e-12):
                    got[at] = areas
                else:
                    plain[at] = False
        for k in np.flatnonzero(~plain):
            got[k] = single(int(k))
        return [got]

    return _over_rows(df, key, [out], run)


def plain_rows(rings: list[np.ndarray]) -> np.ndarray:
    """(n,) whether all rings (n, k, 2) of a row are convex, go around once, and have outlines that don't meet."""
    plain = np.ones(len(rings[0]), bool)
    for r in rings:
        a = np.roll(r, -1, axis=1) - r
        b = np.roll(a, -1, axis=1)
        cross, dot = a[..., 0] * b[..., 1] - a[..., 1] * b[..., 0], (a * b).sum(axis=2)
        plain &= ((cross > 0).all(axis=1) | (cross < 0).all(axis=1)) & (np.abs(np.arctan2(cross, dot).sum(axis=1)) < 2 * np.pi + 1)
    sides = [np.concatenate([r, np.roll(r, -1, axis=1)], axis=2) for r in rings]
    lo, hi = [r.min(axis=1) for r in rings], [r.max(axis=1) for r in rings]
    for p in range(len(rings)):
        for q in range(p):
            at = np.flatnonzero(plain & ~((lo[p] > hi[q] + 1e-9) | (lo[q] > hi[p] + 1e-9)).any(axis=1))
            step = max(1, 200_000 // (sides[p].shape[1] * sides[q].shape[1]))
            for a in range(0, len(at), step):
                i = at[a : a + step]
                plain[i] = segment_distances(sides[p][i], sides[q][i]).min(axis=(1, 2)) > 1e-9
    return plain


def nested_areas(rings: list[np.ndarray], held: np.ndarray, inside: Callable) -> np.ndarray | None:
    """(n,) areas of the largest parts, holes filled, of plain rows alike: held[p, q] tells whether ring p lies in ring q. None for a function that holds outside of all rings.

    Between the rings lie zones, one just within each ring, which the function holds throughout or not. A part is made
    of neighbouring zones; filled, it is all that lies in the ring of its outermost zone.
    """
    m, depth = len(rings), held.sum(axis=1)
    zone = [bool(inside([np.bool_(held[p, q] or p == q) for q in range(m)])) for p in range(m)]
    if bool(inside([np.False_] * m)):
        return None
    size = [np.abs(ring_area_rows(r)) for r in rings]
    around = [max(np.flatnonzero(held[p]), key=lambda q: depth[q], default=None) for p in range(m)]
    top, own = {}, {}
    for p in sorted(range(m), key=lambda p: depth[p]):
        if zone[p]:
            top[p] = top[around[p]] if around[p] is not None and zone[around[p]] else p
            own[top[p]] = own.get(top[p], 0.0) + size[p] - sum(size[q] for q in range(m) if around[q] == p)
    if not own:
        return np.zeros(len(rings[0]))
    return np.take_along_axis(np.stack([size[p] for p in own]), np.argmax(np.stack(list(own.values())), axis=0)[None], 0)[0]


def cell_areas(df: DataFrame, cell, key: str, out: str = "area") -> DataFrame:
    """key, out: area of the periodic scene within its cell, with parameters from the columns. Rows whose scenes reach the cell by the same copies are measured together."""
    ends = [e for pair in cell.copy_ranges() for e in pair]
    coefficients = [c for pair in cell.lattice.rows() for c in pair]

    def run(env, n):
        got = np.zeros(n)
        spans = np.stack([np.broadcast_to(v, n) for v in evaluate(ends, env)], axis=1)
        # copy ranges take in all that may be nearest to a point; only those that reach into the cell have a part in its area
        rings: list[np.ndarray] = []
        scene_rows(cell.scene, env, n, rings)
        m = np.stack([np.broadcast_to(v, n) for v in evaluate(coefficients, env)], axis=1).reshape(n, 2, 2)
        at = np.concatenate(rings, axis=1) @ m.transpose(0, 2, 1)
        for axis in (0, 1):
            spans[:, 2 * axis] = np.maximum(spans[:, 2 * axis], np.ceil(-at[..., axis].max(axis=1) - 1e-6))
            spans[:, 2 * axis + 1] = np.minimum(spans[:, 2 * axis + 1], np.floor(1 - at[..., axis].min(axis=1) + 1e-6))
        kinds, which = np.unique(spans, axis=0, return_inverse=True)
        for k, span in enumerate(kinds):
            at = np.flatnonzero(which.ravel() == k)
            rings, inside = cell_rows(cell, {c: v[at] for c, v in env.items()}, len(at), span)
            got[at] = area_rows(rings, inside)
        return [got]

    return _over_rows(df, key, [out], run)


def shape_distances(df: DataFrame, a: S.Shape, b: S.Shape, key: str, out: str = "distance") -> DataFrame:
    """key, out: least distance of the outlines of two figures with parameters from the columns; 0 where they touch or overlap."""
    return _over_rows(df, key, [out], lambda env, n: [ring_distance_rows(ring_rows(a, env, n), ring_rows(b, env, n))])


def outline_columns(df: DataFrame, figures: dict[str, S.Shape], key: str) -> DataFrame:
    """key, shape, ring (array of structs x, y): the outlines, curves and rounded corners as chords, of named figures with parameters from the columns."""
    kind = pa.struct([("x", pa.float64()), ("y", pa.float64())])

    def lists(r):
        flat = pa.StructArray.from_arrays([pa.array(r[..., i].ravel()) for i in (0, 1)], fields=list(kind))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(r) + 1) * r.shape[1], pa.int32()), flat)

    return _over_outlines(df, figures, key, lists, "ring array<struct<x:double,y:double>>")


def outline_areas(df: DataFrame, figures: dict[str, S.Shape], key: str) -> DataFrame:
    """key, shape, area: the unsigned areas of the outlines that outline_columns gives, which are long, without writing them out."""
    return _over_outlines(df, figures, key, lambda r: pa.array(np.abs(ring_area_rows(r))), "area double")


def _over_outlines(df: DataFrame, figures: dict[str, S.Shape], key: str, make: Callable, out: str) -> DataFrame:
    """key, shape and make(rings) for blocks of rows of each figure; rows of a batch with equal parameters are measured once, and rows are dealt over the configured number of tasks."""
    names = [c for c in df.columns if c != key]

    def rows(batches):
        for b in batches:
            kinds, which = distinct([np.asarray(b.column(c).to_numpy(zero_copy_only=False), float) for c in names], b.num_rows)
            order = np.argsort(which, kind="stable")
            ends = np.searchsorted(which[order], np.arange(len(kinds) + 1))
            for name, figure in figures.items():
                for at in range(0, len(kinds), 512):
                    part = kinds[at : at + 512]
                    own = order[ends[at] : ends[at + len(part)]]
                    made = make(ring_rows(figure, dict(zip(names, part.T, strict=True)), len(part)))
                    for a in range(0, len(own), 512):  # rings are long
                        rows_ = own[a : a + 512]
                        yield pa.RecordBatch.from_arrays([b.column(key).take(pa.array(rows_)), pa.array([name] * len(rows_)), made.take(pa.array(which[rows_] - at))], names=[key, "shape", out.split()[0]])

    return spread(df, key).mapInArrow(rows, f"{key} {dict(df.dtypes)[key]}, shape string, {out}")


# ---- columns of vertices --------------------------------------------------------------------------------------


def _ragged(rings: pa.Array):
    """Rings of an Arrow array of lists of structs x, y: vertices a and their successors b as (x, y) pairs, the row of each, and which rows hold no null."""
    n = len(rings)
    size = np.asarray(pc.fill_null(pc.list_value_length(rings), 0), np.int64)
    flat, row = rings.flatten(), np.repeat(np.arange(n), size)
    known = np.asarray(pc.is_valid(rings)).copy()
    x, y = (flat.field(i) for i in (0, 1))
    if flat.null_count or x.null_count or y.null_count:
        known[row[np.asarray(pc.is_null(flat)) | np.asarray(pc.is_null(x)) | np.asarray(pc.is_null(y))]] = False
    x, y = (np.asarray(v.to_numpy(zero_copy_only=False), float) for v in (x, y))
    nxt, ends = np.arange(1, len(row) + 1), np.cumsum(size)
    nxt[ends[size > 0] - 1] = (ends - size)[size > 0]
    return (x, y), (x[nxt], y[nxt]), row, known


def _values(v: np.ndarray, known: np.ndarray) -> pa.Array:
    return pa.array(v, mask=~known)


def _ring_areas(rings: pa.Array) -> pa.Array:
    (ax, ay), (bx, by), row, known = _ragged(rings)
    return _values(np.abs(np.bincount(row, ax * by - bx * ay, len(known))) / 2, known)


def _ring_centroids(rings: pa.Array) -> pa.Array:
    (ax, ay), (bx, by), row, known = _ragged(rings)
    cross = ax * by - bx * ay
    three = 3 * np.bincount(row, cross, len(known))
    known = known & (three != 0)
    with np.errstate(all="ignore"):
        x, y = (np.bincount(row, (a + b) * cross, len(known)) / three for a, b in ((ax, bx), (ay, by)))
    return pa.StructArray.from_arrays([_values(x, known), _values(y, known)], names=["x", "y"])


def _crossings(a, b, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which sides pass to the right of the point (x, y) given for each of them."""
    over = (a[1] > y) != (b[1] > y)
    return over & (x < a[0] + (y - a[1]) / np.where(over, b[1] - a[1], 1.0) * (b[0] - a[0]))


def _points(x: pa.Array, y: pa.Array):
    """Coordinates of two Arrow arrays as doubles, and which rows have both."""
    got = [np.asarray(v.cast(pa.float64()).to_numpy(zero_copy_only=False)) for v in (x, y)]
    return *got, np.asarray(pc.is_valid(x)) & np.asarray(pc.is_valid(y))


def _ring_contains(rings: pa.Array, x: pa.Array, y: pa.Array) -> pa.Array:
    a, b, row, known = _ragged(rings)
    px, py, _ = _points(x, y)
    return _values(np.bincount(row, _crossings(a, b, px[row], py[row]), len(known)) % 2 == 1, known)


def _ring_covers(rings: pa.Array, x: pa.Array, y: pa.Array, slack: pa.Array) -> pa.Array:
    a, b, row, known = _ragged(rings)
    px, py, placed = _points(x, y)
    ux, uy, near = px[row], py[row], slack.to_numpy(zero_copy_only=False)[row]
    dx, dy, wx, wy = b[0] - a[0], b[1] - a[1], ux - a[0], uy - a[1]
    n = dx * dx + dy * dy
    t = np.clip((wx * dx + wy * dy) / np.where(n > 0, n, 1.0), 0.0, 1.0)
    on = np.hypot(wx - t * dx, wy - t * dy) <= near
    within = np.bincount(row, _crossings(a, b, ux, uy), len(known)) % 2 == 1
    return _values(within | (np.bincount(row, on, len(known)) > 0), known & placed)


def _by_batch(run: Callable, kind: str) -> Callable:
    """A column function that goes through Arrow batches in numpy; Spark's functions over arrays are interpreted vertex by vertex."""
    return F.arrow_udf(run, returnType=kind)


def area_column(ring: Column) -> Column:
    """Unsigned area of an array of structs x, y, by the shoelace sum; NULL stays NULL."""
    return _by_batch(_ring_areas, "double")(ring)


def bounds_column(ring: Column) -> Column:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def centroid_column(ring: Column) -> Column:
    """Area centroid of a ring, as a struct x, y; NULLs without area."""
    return _by_batch(_ring_centroids, "x double, y double")(ring)


def covers_column(ring: Column, x: Column, y: Column, slack: float = 0.0) -> Column:
    """Whether a point lies in a ring or on its outline, within `slack` of it; NULL without a point or ring."""
    return _by_batch(_ring_covers, "boolean")(ring, x, y, F.lit(float(slack)))


def contains_column(ring: Column, x: Column, y: Column) -> Column:
    """Even-odd test of a point, false without one; which side the outline itself counts to isn't fixed (see covers_column)."""
    return _by_batch(_ring_contains, "boolean")(ring, x, y)


def moved_column(ring: Column, dx: Column, dy: Column) -> Column:
    return F.transform(ring, lambda p: F.struct((p["x"] + dx).alias("x"), (p["y"] + dy).alias("y")))


def rotated_column(ring: Column, degrees: Column, ox, oy) -> Column:
    """The ring turned counter-clockwise about (ox, oy)."""
    c, s, ox, oy = F.cos(F.radians(degrees)), F.sin(F.radians(degrees)), F.lit(ox), F.lit(oy)
    return F.transform(ring, lambda p: F.struct((c * (p["x"] - ox) - s * (p["y"] - oy) + ox).alias("x"), (s * (p["x"] - ox) + c * (p["y"] - oy) + oy).alias("y")))


def scaled_column(ring: Column, factor: Column, ox, oy) -> Column:
    ox, oy = F.lit(ox), F.lit(oy)
    return F.transform(ring, lambda p: F.struct((factor * (p["x"] - ox) + ox).alias("x"), (factor * (p["y"] - oy) + oy).alias("y")))
