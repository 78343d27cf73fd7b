"""A small expression graph over DOUBLE columns, with three readings: Spark SQL, numpy, and derivatives.

Nodes are interned, so equal subexpressions are one node. For Spark, nodes that are used more than once become
columns of staged projections, so the SQL text stays linear in the graph; Catalyst sees plain arithmetic that
whole-stage code generation covers. Nothing here runs Python for a row.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame

TINY, EPS = 2.2250738585072014e-308, 2.220446049250313e-16

_interned: dict[tuple, Ex] = {}


class Ex:
    """A node: op and arguments (nodes, or a number or a name for leaves)."""

    __slots__ = ("args", "op")

    def __new__(cls, op: str, *args):
        key = (op, *(id(a) if isinstance(a, Ex) else a for a in args))
        if (found := _interned.get(key)) is None:
            found = object.__new__(cls)
            found.op, found.args = op, args
            _interned[key] = found
        return found

    def __reduce__(self): return Ex, (self.op, *self.args)
    def __add__(self, o): return add(self, o)
    def __radd__(self, o): return add(o, self)
    def __sub__(self, o): return sub(self, o)
    def __rsub__(self, o): return sub(o, self)
    def __mul__(self, o): return mul(self, o)
    def __rmul__(self, o): return mul(o, self)
    def __truediv__(self, o): return div(self, o)
    def __rtruediv__(self, o): return div(o, self)
    def __neg__(self): return sub(0.0, self)
    def __abs__(self): return call("abs", self)
    def __lt__(self, o): return call("lt", self, o)
    def __le__(self, o): return call("le", self, o)
    def __gt__(self, o): return call("lt", o, self)
    def __ge__(self, o): return call("le", o, self)
    def __repr__(self): return sql(self)


def lift(v) -> Ex:
    return v if isinstance(v, Ex) else Ex("num", float(v))


def col(name: str) -> Ex:
    """A DOUBLE column."""
    return Ex("col", name)


def number(e: Ex) -> float | None:
    return e.args[0] if e.op == "num" else None


def add(a, b) -> Ex:
    a, b = lift(a), lift(b)
    x, y = number(a), number(b)
    if x is not None and y is not None:
        return lift(x + y)
    return b if x == 0 else a if y == 0 else Ex("+", a, b)


def sub(a, b) -> Ex:
    a, b = lift(a), lift(b)
    x, y = number(a), number(b)
    if x is not None and y is not None:
        return lift(x - y)
    return a if y == 0 else Ex("-", a, b)


def mul(a, b) -> Ex:
    a, b = lift(a), lift(b)
    x, y = number(a), number(b)
    if x is not None and y is not None:
        return lift(x * y)
    return lift(0.0) if x == 0 or y == 0 else b if x == 1 else a if y == 1 else Ex("*", a, b)


def div(a, b) -> Ex:
    a, b = lift(a), lift(b)
    x, y = number(a), number(b)
    if x is not None and y:
        return lift(x / y)
    return a if y == 1 else Ex("/", a, b)


def _floor(v):
    return float(math.floor(v)) if math.isfinite(v) else v


_FOLD = {
    "abs": abs, "sqrt": lambda v: math.sqrt(v) if v >= 0 else math.nan, "sin": math.sin, "cos": math.cos, "floor": _floor, "exp": lambda v: math.exp(v) if v < 709 else math.inf,
    "least": min, "greatest": max, "atan2": math.atan2, "sign": lambda v: float((v > 0) - (v < 0)), "asin": lambda v: math.asin(v) if -1 <= v <= 1 else math.nan,
    "pow": lambda a, b: a**b, "ceil": lambda v: float(math.ceil(v)) if math.isfinite(v) else v, "radians": math.radians, "ln": lambda v: math.log(v) if v > 0 else math.nan,
}


def call(op: str, *args) -> Ex:
    args = tuple(map(lift, args))
    if op in _FOLD and all(a.op == "num" for a in args):
        return lift(_FOLD[op](*(a.args[0] for a in args)))
    return Ex(op, *args)


def sqrt(a): return call("sqrt", a)
def sin(a): return call("sin", a)
def cos(a): return call("cos", a)
def least(*a):
    out = lift(a[0])
    for b in a[1:]:
        out = out if out is lift(b) else call("least", out, b)
    return out
def greatest(*a):
    out = lift(a[0])
    for b in a[1:]:
        out = out if out is lift(b) else call("greatest", out, b)
    return out
def clamp(a, lo, hi): return least(greatest(a, lo), hi)
def where(c: Ex, a, b): return Ex("if", c, lift(a), lift(b)) if lift(a) is not lift(b) else lift(a)
def both(a: Ex, b: Ex): return Ex("and", a, b)
def floor_mod(a, m): return sub(a, mul(m, call("floor", div(a, m))))
def length(a, b): return sqrt(greatest(a * a + b * b, TINY))


def positive(raw) -> Ex:
    """A parameter that stays positive for any raw value: the soft ramp ln(1 + exp(raw))."""
    raw = lift(raw)
    return where(lift(30.0) < raw, raw, call("ln", 1.0 + call("exp", least(raw, 30.0))))


def bounded(raw, lo, hi) -> Ex:
    """A parameter that stays between lo and hi for any raw value: the logistic curve between them."""
    return lo + (lift(hi) - lo) / (1.0 + call("exp", least(-lift(raw), 700.0)))


_SQL = {
    "+": "({0} + {1})", "-": "({0} - {1})", "*": "({0} * {1})", "/": "({0} / {1})", "lt": "({0} < {1})", "le": "({0} <= {1})", "and": "({0} AND {1})", "if": "CASE WHEN {0} THEN {1} ELSE {2} END",
    "sqrt": "sqrt({0})", "abs": "abs({0})", "sin": "sin({0})", "cos": "cos({0})", "floor": "CAST(floor({0}) AS DOUBLE)", "ceil": "CAST(ceil({0}) AS DOUBLE)", "exp": "exp({0})", "least": "least({0}, {1})", "greatest": "greatest({0}, {1})",
    "atan2": "atan2({0}, {1})", "sign": "signum({0})", "asin": "asin({0})", "pow": "power({0}, {1})", "radians": "radians({0})", "ln": "ln({0})",
}


def _literal(v: float) -> str:
    if math.isinf(v) or math.isnan(v):
        return f"DOUBLE('{'NaN' if math.isnan(v) else 'Infinity' if v > 0 else '-Infinity'}')"
    return f"({v!r}D)" if v < 0 else f"{v!r}D"


def sql(e: Ex, names: dict[Ex, str] | None = None) -> str:
    """Spark SQL text; nodes in `names` are referred to by column."""
    if names and e in names:
        return f"`{names[e]}`"
    if e.op == "num":
        return _literal(e.args[0])
    if e.op == "col":
        return f"`{e.args[0]}`"
    return _SQL[e.op].format(*(sql(a, names) for a in e.args))


def _post_order(roots: list[Ex]) -> list[Ex]:
    seen, out, stack = set(), [], [(r, False) for r in reversed(roots)]
    while stack:
        e, done = stack.pop()
        if done:
            out.append(e)
        elif e not in seen:
            seen.add(e)
            stack.append((e, True))
            stack += [(a, False) for a in e.args if isinstance(a, Ex)]
    return out


def with_columns(df: DataFrame, new: dict[str, Ex]) -> DataFrame:
    """Adds columns. Nodes used more than once are computed once, in staged projections, and dropped at the end."""
    order = _post_order(list(new.values()))
    uses = Counter(a for e in order for a in e.args if isinstance(a, Ex))
    level: dict[Ex, int] = {}
    stage: dict[Ex, int] = {}
    boolean = {"lt", "le", "and"}
    for e in order:
        below = max((level[a] for a in e.args if isinstance(a, Ex)), default=0)
        if e.op not in ("num", "col") and e.op not in boolean and uses[e] > 1:
            stage[e] = below
            below += 1
        level[e] = below
    names: dict[Ex, str] = {}
    for n in sorted(set(stage.values())):
        now = [e for e, s in stage.items() if s == n]
        df = df.selectExpr("*", *(f"{sql(e, names)} AS `_t{len(names) + i}`" for i, e in enumerate(now)))
        for e in now:
            names[e] = f"_t{len(names)}"
    out = [c for c in df.columns if c not in new and not (c.startswith("_t") and c[2:].isdigit() and c in names.values())]
    return df.selectExpr(*(f"`{c}`" for c in out), *(f"{sql(e, names)} AS `{c}`" for c, e in new.items()))


_NUMPY = {
    "+": np.add, "-": np.subtract, "*": np.multiply, "/": np.divide, "lt": np.less, "le": np.less_equal, "and": np.logical_and, "if": np.where, "sqrt": np.sqrt, "abs": np.abs, "sin": np.sin, "cos": np.cos,
    "floor": np.floor, "ceil": np.ceil, "exp": np.exp, "least": np.minimum, "greatest": np.maximum, "atan2": np.arctan2, "sign": np.sign, "asin": np.arcsin, "pow": np.power, "radians": np.radians, "ln": np.log,
}


def evaluate(roots: list[Ex], env: dict[str, np.ndarray]) -> list[np.ndarray]:
    """Values of nodes with columns given as arrays (or numbers)."""
    got: dict[Ex, np.ndarray] = {}
    order = _post_order(roots)
    left = Counter(a for e in order for a in e.args if isinstance(a, Ex)) + Counter(roots)
    with np.errstate(all="ignore"):
        for e in order:
            got[e] = np.float64(e.args[0]) if e.op == "num" else np.asarray(env[e.args[0]], np.float64) if e.op == "col" else _NUMPY[e.op](*(got[a] for a in e.args))
            for a in e.args:  # values are dropped after their last use
                if isinstance(a, Ex):
                    left[a] -= 1
                    if not left[a]:
                        del got[a]
    return [got[r] for r in roots]


def hoisted(roots: list[Ex], inner: set[str]) -> tuple[list[Ex], dict[str, Ex]]:
    """(roots, outer): the largest nodes without columns of `inner` become columns _h0, _h1, ..., whose nodes are in outer."""
    new: dict[Ex, Ex] = {}
    within: dict[Ex, bool] = {}
    order = _post_order(roots)
    for e in order:
        within[e] = e.op == "col" and e.args[0] in inner or any(within[a] for a in e.args if isinstance(a, Ex))
    outer: dict[Ex, str] = {}

    def take(e: Ex) -> Ex:
        if within[e] or e.op in ("num", "col"):
            return new.get(e, e)
        return col(outer.setdefault(e, f"_h{len(outer)}"))

    for e in order:
        if within[e] and e.op != "col":
            new[e] = Ex(e.op, *(take(a) if isinstance(a, Ex) else a for a in e.args))
    return [take(r) for r in roots], {n: e for e, n in outer.items()}


def derivative(e: Ex, by: Ex) -> Ex:
    """Derivative of e by a column node. Where two arguments of least or greatest tie, the left one counts; steps have derivative 0."""
    d: dict[Ex, Ex] = {}
    zero = lift(0.0)
    for n in _post_order([e]):
        if n is by:
            d[n] = lift(1.0)
            continue
        if n.op in ("num", "col", "lt", "le", "and", "floor", "ceil", "sign"):
            d[n] = zero
            continue
        a = n.args
        da = [d.get(x, zero) for x in a]
        if all(x is zero for x in da):
            d[n] = zero
        elif n.op == "+":
            d[n] = da[0] + da[1]
        elif n.op == "-":
            d[n] = da[0] - da[1]
        elif n.op == "*":
            d[n] = da[0] * a[1] + a[0] * da[1]
        elif n.op == "/":
            d[n] = (da[0] - n * da[1]) / a[1]
        elif n.op == "sqrt":
            d[n] = da[0] / (2.0 * n)
        elif n.op == "abs":
            d[n] = call("sign", a[0]) * da[0]
        elif n.op == "sin":
            d[n] = cos(a[0]) * da[0]
        elif n.op == "cos":
            d[n] = -(sin(a[0]) * da[0])
        elif n.op == "exp":
            d[n] = n * da[0]
        elif n.op == "ln":
            d[n] = da[0] / a[0]
        elif n.op == "radians":
            d[n] = da[0] * (math.pi / 180)
        elif n.op == "least":
            d[n] = where(a[0] <= a[1], da[0], da[1])
        elif n.op == "greatest":
            d[n] = where(a[1] <= a[0], da[0], da[1])
        elif n.op == "if":
            d[n] = where(a[0], da[1], da[2])
        elif n.op == "asin":
            d[n] = da[0] / sqrt(1.0 - a[0] * a[0])
        elif n.op == "atan2":
            d[n] = (a[1] * da[0] - a[0] * da[1]) / (a[0] * a[0] + a[1] * a[1])
        elif n.op == "pow":
            if number(a[1]) is None:
                raise ValueError("powers must have constant exponents")
            d[n] = a[1] * call("pow", a[0], number(a[1]) - 1) * da[0]
        else:
            raise ValueError(n.op)
    return d[e]
