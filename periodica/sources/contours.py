"""Outlines from masks, and polygon layouts as GDSII streams."""

from __future__ import annotations

import math
import struct

import numpy as np
from pyspark.sql import DataFrame

from periodica.operators.lattice import spread

#: Masks whose outlines a task remembers.
MOST_KNOWN = 1024


def mask_rings(values: np.ndarray, level: float = 0.5) -> list[np.ndarray]:
    """Closed rings (x, y in pixels) along which a raster crosses `level`; what lies above it is to the left.

    Marching squares with linear interpolation; the raster is surrounded by a border below the level, so that every
    ring closes. In a cell with two opposite corners above the level, the corners are kept apart.
    """
    v = np.pad(np.asarray(values, float), 1, constant_values=min(float(np.min(values, initial=level)), level) - 1.0)
    ny, nx = v.shape
    inside = v > level
    nxt: dict[tuple, tuple] = {}

    def cut(a, b):
        """The crossing between two neighbouring nodes, as (edge, point)."""
        (ay, ax), (by, bx) = sorted((a, b))
        t = (level - v[ay, ax]) / (v[by, bx] - v[ay, ax])
        return ((ay, ax), (by, bx)), (ax + t * (bx - ax) - 1.0, ay + t * (by - ay) - 1.0)

    points = {}
    for y in range(ny - 1):
        for x in range(nx - 1):
            ring = [(y, x), (y, x + 1), (y + 1, x + 1), (y + 1, x)]
            state = [bool(inside[c]) for c in ring]
            if all(state) or not any(state):
                continue
            # a segment runs from where the walk around the cell leaves the inside to where it enters it, corner by corner
            for i in range(4):
                if state[i] and not state[i - 1]:
                    j = i
                    while state[(j + 1) % 4]:
                        j = (j + 1) % 4
                    (a, pa), (b, pb) = cut(ring[j], ring[(j + 1) % 4]), cut(ring[i - 1], ring[i])
                    nxt[b] = a
                    points[a], points[b] = pa, pb
    rings, left = [], set(nxt)
    while left:
        start = at = next(iter(left))
        ring = []
        while at in left:
            left.discard(at)
            ring.append(points[at])
            at = nxt[at]
        if at == start and len(ring) > 2:
            rings.append(np.array(ring))
    return rings


def simplify(ring: np.ndarray, tolerance: float) -> np.ndarray:
    """A ring with fewer vertices, all dropped ones within the tolerance of the new outline (Douglas and Peucker's method on its two halves)."""

    def half(p: np.ndarray) -> list[int]:
        keep, stack = {0, len(p) - 1}, [(0, len(p) - 1)]
        while stack:
            a, b = stack.pop()
            if b - a < 2:
                continue
            d = p[b] - p[a]
            w = p[a + 1 : b] - p[a]
            n = math.hypot(*d)
            far = np.abs(d[0] * w[:, 1] - d[1] * w[:, 0]) / n if n > 0 else np.hypot(w[:, 0], w[:, 1])
            i = int(far.argmax())
            if far[i] > tolerance:
                keep.add(a + 1 + i)
                stack += [(a, a + 1 + i), (a + 1 + i, b)]
        return sorted(keep)

    if len(ring) < 5:
        return ring
    m = int(((ring - ring[0]) ** 2).sum(axis=1).argmax())
    closed = np.concatenate([ring, ring[:1]])
    first, second = half(closed[: m + 1]), half(closed[m:])
    return closed[first + [m + i for i in second[1:-1]]]


def ring_area(r: np.ndarray) -> float:
    n = np.roll(r, -1, axis=0)
    return float(0.5 * (r[:, 0] * n[:, 1] - n[:, 0] * r[:, 1]).sum())


def polygons_of(values: np.ndarray, level: float = 0.5, tolerance: float = 0.0) -> list[tuple[np.ndarray, list[np.ndarray]]]:
    """(outer ring, holes) of a raster: each hole goes to the smallest outer ring around it."""
    rings = [simplify(r, tolerance) for r in mask_rings(values, level)]
    if not rings:
        return []
    areas = [ring_area(r) for r in rings]
    sign = math.copysign(1.0, max(areas, key=abs))
    outer = [(r, []) for r, a in zip(rings, areas, strict=True) if a * sign > 0]
    for hole, a in zip(rings, areas, strict=True):
        if a * sign < 0:
            own = [o for o in outer if abs(ring_area(o[0])) > abs(a) and _holds(o[0], hole[0])]
            if own:
                min(own, key=lambda o: abs(ring_area(o[0])))[1].append(hole)
    return outer


def nearest_set(mask: np.ndarray) -> np.ndarray:
    """Distance, in pixels, of each node of a mask to the nearest one that is set; infinite where none is.

    Exact: distances along columns first, then for each row the least over its columns, so memory is that of a row's square.
    """
    m = np.asarray(mask, bool)
    along = np.where(m, 0.0, np.inf)
    for step in (along, along[::-1]):  # downwards, then upwards; a view writes through
        for y in range(1, len(step)):
            np.minimum(step[y], step[y - 1] + 1.0, out=step[y])
    x = np.arange(m.shape[1], dtype=float)
    apart = (x[:, None] - x[None, :]) ** 2
    return np.stack([np.sqrt((apart + row[None, :] ** 2).min(axis=1)) for row in along]) if m.size else along


def signed_distance(mask: np.ndarray) -> np.ndarray:
    """Distance of set nodes to the nearest unset one, and minus that of unset nodes to the nearest set one; a mask of one kind has infinite ones."""
    m = np.asarray(mask, bool)
    return np.where(m, nearest_set(~m), -nearest_set(m))


def smoothed(values: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian mean of a raster, four deviations wide, with the border's values beyond the border."""
    if not sigma > 0:
        raise ValueError("sigma must be positive")
    r = max(1, round(4 * sigma))
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    w /= w.sum()
    out = np.asarray(values, float)
    for axis in (0, 1):
        wide = np.pad(out, [(r, r) if a == axis else (0, 0) for a in (0, 1)], mode="edge")
        out = sum(k * np.take(wide, np.arange(i, i + out.shape[axis]), axis) for i, k in enumerate(w))
    return out


def mask_polygons(mask: np.ndarray, distance: bool = True, sigma: float | None = None, tolerance: float = 0.5) -> list[tuple[np.ndarray, list[np.ndarray]]]:
    """(outer ring, holes) of a mask, in pixels: by its signed distances, half a pixel outside of the set ones, or as it is; smoothed before, if sigma is given.

    A mask without set nodes has no polygon; one that is set throughout has the border as its outline.
    """
    m = np.asarray(mask, bool)
    if not m.any():
        return []
    values = signed_distance(m) if distance and not m.all() else m.astype(float)
    level = -0.5 if distance and not m.all() else 0.5
    return polygons_of(values if sigma is None else smoothed(values, sigma), level, tolerance)


def _holds(ring: np.ndarray, p: np.ndarray) -> bool:
    n = np.roll(ring, -1, axis=0)
    crossed = (ring[:, 1] > p[1]) != (n[:, 1] > p[1])
    x = ring[:, 0] + (p[1] - ring[:, 1]) / np.where(crossed, n[:, 1] - ring[:, 1], 1.0) * (n[:, 0] - ring[:, 0])
    return bool((crossed & (p[0] < x)).sum() % 2)


def mask_outlines(df: DataFrame, key: str, mask: str, distance: bool = True, sigma: float | None = None, tolerance: float = 0.5) -> DataFrame:
    """key, part, hole, ring (array of structs x, y): the polygons of masks, arrays of rows of booleans; a null or empty mask has none.

    Rows are dealt over the configured number of tasks, since each costs much more than its size, and a task remembers
    some outlines for masks that recur.
    """
    import pandas as pd

    def rows(batches):
        known: dict = {}
        for b in batches:
            out = []
            for k, m in zip(b[key], b[mask], strict=True):
                if m is None or not len(m):
                    continue
                m = np.stack(m)
                if (at := (m.shape, m.dtype.str, m.tobytes() if m.dtype != object else tuple(m.ravel()))) not in known:
                    if len(known) >= MOST_KNOWN:
                        known.clear()
                    known[at] = [(part, i > 0, [{"x": x, "y": y} for x, y in r.tolist()]) for part, (outer, holes) in enumerate(mask_polygons(m, distance, sigma, tolerance)) for i, r in enumerate([outer, *holes])]
                out += [(k, *found) for found in known[at]]
            yield pd.DataFrame(out, columns=[key, "part", "hole", "ring"])

    return spread(df.select(key, mask), key).mapInPandas(rows, f"{key} {dict(df.dtypes)[key]}, part int, hole boolean, ring array<struct<x:double,y:double>>")


# ---- GDSII ----------------------------------------------------------------------------------------------------

#: Record types of the public stream format, with their data types.
HEADER, BGNLIB, LIBNAME, UNITS, ENDLIB = 0x0002, 0x0102, 0x0206, 0x0305, 0x0400
BGNSTR, STRNAME, ENDSTR, BOUNDARY, LAYER, DATATYPE, XY, ENDEL = 0x0502, 0x0606, 0x0700, 0x0800, 0x0D02, 0x0E02, 0x1003, 0x1100
MOST_VERTICES = 8190


def _real(v: float) -> bytes:
    """Eight-byte excess-64 hexadecimal floating point."""
    if v == 0:
        return bytes(8)
    e = math.floor(math.log(abs(v), 16)) + 1
    m = round(abs(v) * 16.0 ** (14 - e))
    if m >> 56:
        e, m = e + 1, m >> 4
    return bytes([(0x80 if v < 0 else 0) | (e + 64)]) + m.to_bytes(7, "big")


def _read_real(b: bytes) -> float:
    return (-1.0 if b[0] & 0x80 else 1.0) * int.from_bytes(b[1:], "big") * 16.0 ** ((b[0] & 0x7F) - 64 - 14)


def _record(kind: int, data: bytes = b"") -> bytes:
    data += b"\0" * (len(data) % 2)
    return struct.pack(">HH", len(data) + 4, kind) + data


def dump_gds(rings: list[np.ndarray], name: str = "CELL", unit: float = 1e-6, precision: float = 1e-9, layer: int = 0) -> bytes:
    """A GDSII stream with one structure of boundaries; coordinates are in `unit` and stored in steps of `precision`."""
    date = struct.pack(">12H", *(2000, 1, 1, 0, 0, 0) * 2)
    out = [_record(HEADER, struct.pack(">H", 600)), _record(BGNLIB, date), _record(LIBNAME, b"LIB"), _record(UNITS, _real(precision / unit) + _real(precision)), _record(BGNSTR, date), _record(STRNAME, name.encode("ascii"))]
    for r in rings:
        if not 3 <= len(r) <= MOST_VERTICES:
            raise ValueError(f"a boundary must have 3 to {MOST_VERTICES} vertices")
        xy = np.rint(np.concatenate([r, r[:1]]) * (unit / precision)).astype(">i4")
        out += [_record(BOUNDARY), _record(LAYER, struct.pack(">h", layer)), _record(DATATYPE, struct.pack(">h", 0)), _record(XY, xy.tobytes()), _record(ENDEL)]
    return b"".join([*out, _record(ENDSTR), _record(ENDLIB)])


def load_gds(data: bytes) -> list[tuple[int, np.ndarray]]:
    """(layer, ring) of the boundaries of a stream, in user units; ValueError for what isn't one."""
    at, scale, layer, out = 0, 1.0, 0, []
    while at + 4 <= len(data):
        size, kind = struct.unpack_from(">HH", data, at)
        if size < 4 or at + size > len(data) or (at == 0 and kind != HEADER):
            raise ValueError("not a GDSII stream")
        body = data[at + 4 : at + size]
        if kind == UNITS:
            scale = _read_real(body[:8])
        elif kind == LAYER:
            (layer,) = struct.unpack(">h", body)
        elif kind == XY:
            out.append((layer, np.frombuffer(body, ">i4").reshape(-1, 2)[:-1] * scale))
        elif kind == ENDLIB:
            return out
        at += size
    raise ValueError("a GDSII stream is cut short")


def gds_streams(df: DataFrame, key: str, ring: str, **how) -> DataFrame:
    """key, gds: a stream for each key with its rings, in their order, as boundaries (see dump_gds); a null ring is left out."""
    import pandas as pd

    def one(t: pd.DataFrame) -> pd.DataFrame:
        rings = [np.array([[p["x"], p["y"]] for p in r]) for r in t[ring] if r is not None]
        return pd.DataFrame({key: [t[key].iloc[0]], "gds": [dump_gds(rings, **how)]})

    return df.groupBy(key).applyInPandas(one, f"{key} {dict(df.dtypes)[key]}, gds binary")


def gds_rings(df: DataFrame, key: str, gds: str) -> DataFrame:
    """key, i, layer, ring (array of structs x, y): the boundaries of streams, numbered from 0."""
    import pandas as pd

    def rows(batches):
        for b in batches:
            out = [(k, i, layer, [{"x": x, "y": y} for x, y in r.tolist()]) for k, g in zip(b[key], b[gds], strict=True) if g is not None for i, (layer, r) in enumerate(load_gds(bytes(g)))]
            yield pd.DataFrame(out, columns=[key, "i", "layer", "ring"])

    return df.select(key, gds).mapInPandas(rows, f"{key} {dict(df.dtypes)[key]}, i int, layer int, ring array<struct<x:double,y:double>>")
