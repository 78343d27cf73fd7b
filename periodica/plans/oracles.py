"""Hand-written DuckDB SQL for the queries of the geometry engine; nothing here comes from the engine's expressions."""

from __future__ import annotations

#: The points of events, as the queries define them.
PT = "p as (select event_id pt, value - 4*floor(value/4) - 2 + 0.0137 x, (user_id % 97 + 0.41)/97*4 - 2 y, (event_id % 50)::double k, (event_id % 360)::double ang from events)"
#: Points in the frame of a figure at (0.1, -0.2), turned by ang.
LOC = PT + ", l as (select *, cos(radians(ang))*(x-0.1) + sin(radians(ang))*(y+0.2) lx, cos(radians(ang))*(y+0.2) - sin(radians(ang))*(x-0.1) ly from p)"
TINY, EPS = "2.2250738585072014e-308", "2.220446049250313e-16"


def r6(e: str, name: str) -> str:
    return f"round({e}, 6) + 0 as {name}"


def box(x: str, y: str, hx: str, hy: str, r: str) -> str:
    qx, qy = f"(abs({x}) - ({hx} - {r}))", f"(abs({y}) - ({hy} - {r}))"
    return f"(sqrt(greatest(power(greatest({qx}, 0), 2) + power(greatest({qy}, 0), 2), {TINY})) + least(greatest({qx}, {qy}), 0) - {r})"


def fillet(qx: str, qy: str, r: str) -> str:
    return f"greatest({box(f'({qx} - {r}/2)', f'({qy} - {r}/2)', f'{r}/2', f'{r}/2', '0')}, {r} - sqrt(greatest(power({qx} - {r}, 2) + power({qy} - {r}, 2), {TINY})))"


def polygon(verts: str, n: int, r: str) -> str:
    """Distance to a counter-clockwise convex polygon. verts: SQL list of structs x, y over l's columns."""
    return f"""with {LOC}, v as (select pt, lx, ly, {r} r, {verts} vs from l),
e as (select pt, lx, ly, r, i, vs[i+1].x ax, vs[i+1].y ay, vs[(i+1)%{n}+1].x - vs[i+1].x ex, vs[(i+1)%{n}+1].y - vs[i+1].y ey from v, range({n}) t(i)),
o as (select *, ax - r*ey/sqrt(ex*ex+ey*ey) ox, ay + r*ex/sqrt(ex*ex+ey*ey) oy from e),
w as (select b.pt, b.lx, b.ly, b.r, b.i, a.ox + ((b.ox-a.ox)*b.ey - (b.oy-a.oy)*b.ex)/(a.ex*b.ey - a.ey*b.ex)*a.ex wx, a.oy + ((b.ox-a.ox)*b.ey - (b.oy-a.oy)*b.ex)/(a.ex*b.ey - a.ey*b.ex)*a.ey wy
  from o b join o a on a.pt = b.pt and a.i = (b.i + {n} - 1) % {n}),
s as (select a.pt, a.r, a.lx - a.wx px, a.ly - a.wy py, b.wx - a.wx sx, b.wy - a.wy sy from w a join w b on a.pt = b.pt and b.i = (a.i + 1) % {n}),
d as (select pt, r, sx*py - sy*px side, px, py, sx, sy, least(greatest((px*sx+py*sy)/(sx*sx+sy*sy), 0), 1) t from s)
select pt, {r6(f"case when bool_and(side >= 0) then -1 else 1 end * sqrt(greatest(min(power(px-t*sx,2)+power(py-t*sy,2)), {TINY})) - max(r)", 'sdf')} from d group by pt"""


def ellipse_gap(src: str, a: str, b: str, out: str) -> str:
    """CTEs that end in {out}: src's columns with the nearest point (nx, ny) of the ellipse to (px, py), both positive, by bisection over the angle.

    The arc's nearest point to (px, py) is where the outline's normal goes through it: (a cos t, b sin t) with a px sin t - b py cos t = (a a - b b) sin t cos t.
    """
    f = "(ea*px*sin(mid) - eb*py*cos(mid) - (ea*ea - eb*eb)*sin(mid)*cos(mid))"
    return f"""{out}_0 as (select pt, px, py, {a} ea, {b} eb, 0::double lo, pi()/2 hi, pi()/4 mid, 0 n from {src}
 union all select pt, px, py, ea, eb, case when {f} < 0 then mid else lo end, case when {f} < 0 then hi else mid end, case when {f} < 0 then (mid+hi)/2 else (lo+mid)/2 end, n+1 from {out}_0 where n < 52),
{out} as (select s.*, ea*cos(mid) nx, eb*sin(mid) ny from {src} s join {out}_0 e on e.pt = s.pt and n = 52)"""


def _star() -> str:
    """Least distance to the pieces of half a tip's outline: the tip's arc, the edge, the valley's arc. Inside: within the sharp half tip, but for corners cut and filled."""
    far = lambda x, y: f"sqrt(power(px-({x}), 2) + power(py-({y}), 2))"
    return f"""with {LOC},
a as (select *, pi()/5 an, 1.0 + k/100 bigr, 0.45 r, 0.02 ro, 0.03 ri, sqrt(lx*lx+ly*ly) rho, atan2(lx, ly) th from l),
b as (select *, rho*cos(th - 2*an*round(th/(2*an))) px, abs(rho*sin(th - 2*an*round(th/(2*an)))) py, r*cos(an) vx, r*sin(an) vy from a),
c as (select *, atan2(vy, bigr - vx) half_tip, sqrt(power(bigr-vx, 2) + vy*vy) ll from b),
d as (select *, half_tip + an half_valley, bigr - ro/sin(half_tip) tx, ro/tan(half_tip) t0, r + ri/sin(half_tip + an) oc, ll - ri/tan(half_tip + an) t1 from c),
e as (select *, -cos(half_tip) ux, sin(half_tip) uy, oc*cos(an) ox, oc*sin(an) oy from d),
f as (select *, (px-bigr)*ux + py*uy s, (px-bigr)*uy - py*ux h from e),
g as (select *, {far('bigr+least(greatest(s, t0), t1)*ux', 'least(greatest(s, t0), t1)*uy')} d_edge, case when s < t0 then abs({far('tx', '0')} - ro) else 'inf'::double end d_tip, case when s > t1 then abs({far('ox', 'oy')} - ri) else 'inf'::double end d_valley,
 case when s < t0 then {far('tx', '0')} <= ro when s > t1 then {far('ox', 'oy')} >= ri else h <= 0 end inside from f)
select pt, {r6('case when inside then -1 else 1 end * least(d_edge, d_tip, d_valley)', 'sdf')} from g"""


def _rect_frame(px: str, py: str, c: tuple[str, str, str, str, str]) -> tuple[str, str]:
    """|x| and |y| of a point in the frame of a turned rectangle (cx, cy, w, h, degrees)."""
    cx, cy, _, _, deg = c
    return f"abs(cos(radians({deg}))*(({px})-({cx})) + sin(radians({deg}))*(({py})-({cy})))", f"abs(cos(radians({deg}))*(({py})-({cy})) - sin(radians({deg}))*(({px})-({cx})))"


def _rect_gap(one: tuple, two: tuple) -> str:
    """Distance of two turned rectangles: 0 unless one of their four axes separates them, else the least distance of a corner to the other."""
    def reach(c, ux, uy):
        return f"(({c[2]})/2*abs(cos(radians({c[4]}))*{ux}+sin(radians({c[4]}))*{uy}) + ({c[3]})/2*abs(cos(radians({c[4]}))*{uy}-sin(radians({c[4]}))*{ux}))"

    apart = []
    for c in (one, two):
        for ux, uy in ((f"cos(radians({c[4]}))", f"sin(radians({c[4]}))"), (f"(-sin(radians({c[4]})))", f"cos(radians({c[4]}))")):
            apart.append(f"abs((({one[0]})-({two[0]}))*{ux} + (({one[1]})-({two[1]}))*{uy}) > {reach(one, ux, uy)} + {reach(two, ux, uy)}")
    gaps = []
    for c, o in ((one, two), (two, one)):
        for i, j in ((-1, -1), (-1, 1), (1, -1), (1, 1)):
            px = f"({c[0]})+cos(radians({c[4]}))*{i}*({c[2]})/2-sin(radians({c[4]}))*{j}*({c[3]})/2"
            py = f"({c[1]})+sin(radians({c[4]}))*{i}*({c[2]})/2+cos(radians({c[4]}))*{j}*({c[3]})/2"
            x, y = _rect_frame(px, py, o)
            gaps.append(f"sqrt(power(greatest({x}-({o[2]})/2, 0), 2) + power(greatest({y}-({o[3]})/2, 0), 2))")
    return f"case when {' or '.join(apart)} then least({', '.join(gaps)}) else 0 end"


def turn(px: str, py: str) -> tuple[str, str]:
    """World coordinates of a local point of a figure at (0.1, -0.2)."""
    return f"(cos(radians(ang))*({px}) - sin(radians(ang))*({py}) + 0.1)", f"(sin(radians(ang))*({px}) + cos(radians(ang))*({py}) - 0.2)"


TRI = "with_tri as (select *, (1.2+k/100)*sin(radians(50))/sin(radians(110))*cos(radians(60)) tax, (1.2+k/100)*sin(radians(50))/sin(radians(110))*sin(radians(60)) tay from p)"
TRI_L = [("-((1.2+k/100)+tax)/3", "-tay/3"), ("(1.2+k/100)-((1.2+k/100)+tax)/3", "-tay/3"), ("tax-((1.2+k/100)+tax)/3", "tay-tay/3")]


def _regular(radius: str, n: int = 5) -> list[tuple[str, str]]:
    return [(f"({radius})*cos(2*pi()*{i}/{n}+pi()/2)", f"({radius})*sin(2*pi()*{i}/{n}+pi()/2)") for i in range(n)]


#: Local corners of the sharp outlines, as the figures' parameters give them.
CORNERS = {
    "rectangle": [(f"{a}(0.6+k/50)/2", f"{b}(0.4+k/80)/2") for a, b in (("-", "-"), ("", "-"), ("", ""), ("-", ""))],
    "convex_quad": [("-(0.5+k/100)+0.1", "-0.1-(0.4+k/200)"), ("(0.5+k/100)+0.1", "0.1-(0.4+k/200)"), ("1.2*(0.5+k/100)-0.9*0.1", "1.2*0.1+0.9*(0.4+k/200)"), ("-1.2*(0.5+k/100)-0.9*0.1", "-1.2*0.1+0.9*(0.4+k/200)")],
    "trapezoid": [("-(1+k/60)/2", "-0.4"), ("(1+k/60)/2", "-0.4"), ("0.3", "0.4"), ("-0.3", "0.4")],
    "regular_polygon": _regular("(0.6+k/100)/(2*sin(pi()/5))"),
    "triangle": TRI_L,
    "star": [(f"{r}*cos(pi()/2+pi()*{j}/5)", f"{r}*sin(pi()/2+pi()*{j}/5)") for i in range(5) for r, j in (("(1+k/100)", 2 * i), ("0.45", 2 * i + 1))],
    "cross": [(a.replace("h", "(1.5+k/100)/2").replace("w", "0.2"), b.replace("h", "(1.5+k/100)/2").replace("w", "0.2")) for a, b in (("-w", "-h"), ("w", "-h"), ("w", "-w"), ("h", "-w"), ("h", "w"), ("w", "w"), ("w", "h"), ("-w", "h"), ("-w", "w"), ("-h", "w"), ("-h", "-w"), ("-w", "-w"))],
    "tshape": [(a.replace("h", "(1.5+k/100)/2").replace("w", "0.2"), b.replace("c", "((1.5+k/100)/2-0.4)").replace("h", "(1.5+k/100)/2")) for a, b in (("-w", "-h"), ("w", "-h"), ("w", "c"), ("h", "c"), ("h", "h"), ("-h", "h"), ("-h", "c"), ("-w", "c"))],
}


def _vertices() -> str:
    """CTE v: pt, x, y, shape, i, vx, vy."""
    lists = " union all ".join(f"select pt, x, y, '{n}' shape, unnest([{', '.join(f'{{i: {i}, x: {turn(*c)[0]}, y: {turn(*c)[1]}}}' for i, c in enumerate(cs))}]) s from with_tri" for n, cs in CORNERS.items())
    return f"{PT}, {TRI}, u as ({lists}), v as (select pt, x, y, shape, s.i i, s.x vx, s.y vy from u)"


def _bounds_all() -> str:
    boxed = f"select pt, shape, min(vx) x0, min(vy) y0, max(vx) x1, max(vy) y1 from v where shape not in ('cross', 'tshape') group by all"
    half = [(f"{a}(1.5+k/100)/2", f"{b}(1.5+k/100)/2") for a, b in (("-", "-"), ("", "-"), ("", ""), ("-", ""))]
    xs, ys = ", ".join(turn(*c)[0] for c in half), ", ".join(turn(*c)[1] for c in half)
    egg = [("0.5", "(1.4+k/100)/2*1.3"), ("-0.5", "(1.4+k/100)/2*1.3"), ("0.5", "-(1.4+k/100)/2*0.7"), ("-0.5", "-(1.4+k/100)/2*0.7")]
    ex_, ey_ = ", ".join(turn(*c)[0] for c in egg), ", ".join(turn(*c)[1] for c in egg)
    c, s, b = "cos(radians(ang))", "sin(radians(ang))", "(0.9+k/200)/2"
    wide, tall = f"sqrt(power(0.85*{c},2)+power({b}*{s},2))", f"sqrt(power(0.85*{s},2)+power({b}*{c},2))"
    sx, sy = f"(abs((1.1+k/100)/2*{c})+0.25)", f"(abs((1.1+k/100)/2*{s})+0.25)"
    rows = [
        boxed, f"select pt, unnest(['cross', 'tshape']) shape, least({xs}), least({ys}), greatest({xs}), greatest({ys}) from p", f"select pt, 'egg', least({ex_}), least({ey_}), greatest({ex_}), greatest({ey_}) from p",
        f"select pt, 'ellipse', 0.1-{wide}, -0.2-{tall}, 0.1+{wide}, -0.2+{tall} from p", f"select pt, 'stadium', 0.1-{sx}, -0.2-{sy}, 0.1+{sx}, -0.2+{sy} from p",
        "select pt, 'bar', '-inf'::double, 0.1+k/100-0.2, 'inf'::double, 0.1+k/100+0.2 from p",
    ]
    return f"with {_vertices()}, b as ({' union all '.join(rows)}) select pt, shape, {', '.join(r6(c, c) for c in ('x0', 'y0', 'x1', 'y1'))} from b"


def _min_feature() -> str:
    ap = "(0.6+k/100)/(2*tan(pi()/5))"
    quad = """(select pt, 'convex_quad' shape, greatest(min(wd) - 0.1, 0) v from (select e.pt, e.i, max(abs((q.vy-e.ay)*e.ex - (q.vx-e.ax)*e.ey)/sqrt(e.ex*e.ex+e.ey*e.ey)) wd from
      (select a.pt, a.i, a.vx ax, a.vy ay, b.vx-a.vx ex, b.vy-a.vy ey from v a join v b on a.pt=b.pt and a.shape='convex_quad' and b.shape='convex_quad' and b.i=(a.i+1)%4) e join v q on q.pt=e.pt and q.shape='convex_quad' group by 1,2) group by pt)"""
    inr = "(1.2+k/100)*sin(radians(60))*sin(radians(50))/(sin(radians(110))+sin(radians(60))+sin(radians(50)))"
    own = {
        "rectangle": "least(0.6+k/50, 0.4+k/80)", "trapezoid": "least(1+k/60, 0.6)", "ellipse": "least(1.7, 0.9+k/200)", "egg": "least(0.5, (1.4+k/100)/2*0.7)", "stadium": "0.5", "regular_polygon": f"{ap}*(1+cos(pi()/5))",
        "triangle": f"2*{inr}", "star": "0.04", "cross": "0.4", "tshape": "0.4", "bar": "0.4", "union": "null::double",
    }
    rows = " union all ".join(f"select pt, '{n}' shape, ({e})::double v from p" for n, e in own.items())
    return f"with {_vertices()}, f as ({rows} union all select * from {quad}) select pt, shape, {r6('v', 'size')} from f"


#: Parameters of the figures that are checked, and of those that are moved into their ranges.
CHECKED = "c as (select p_partkey id, p_size/10.0::double - 0.2 a, (p_retailprice-900)/40 - 0.1 b, (p_partkey%7)/10.0::double - 0.1 r, (p_partkey%11)/10.0::double - 0.1 q from part)"
MOVED = "c as (select p_partkey id, p_size/10.0::double + 0.1 a, (p_retailprice-900)/40 + 0.2 b, (p_partkey%7)/10.0::double - 0.1 r, (p_partkey%11)/10.0::double - 0.1 q from part)"
#: Greatest insets: half the least height of a parallelogram; the tightest edge of a trapezoid, from its angles; apothem; inradius.
INSET = {
    "convex_quad": "(abs(a*b+0.01)/greatest(sqrt(a*a+0.01), sqrt(b*b+0.01)))",
    "trapezoid": "least(a/2*tan(atan2(0.8317, (a-b)/2)/2), b/2*tan((pi()-atan2(0.8317, (a-b)/2))/2), 0.41585)",
    "regular_polygon": "(b/(2*tan(pi()/5)))",
}


def _inradius(alpha: str, beta: str) -> str:
    return f"(a*sin(radians({alpha}))*sin(radians({beta}))/(sin(radians({alpha})+radians({beta}))+sin(radians({alpha}))+sin(radians({beta}))))"


def _star_edge(outer: str) -> tuple[str, str, str]:
    """Length of a star's edge, and the tangents of its angles with the tip's and the valley's ray (inner radius b, 5 tips)."""
    dx, dy = f"(({outer})-b*cos(pi()/5))", "(b*sin(pi()/5))"
    tip = f"atan2({dy}, {dx})"
    return f"sqrt({dx}*{dx}+{dy}*{dy})", f"tan({tip})", f"abs(tan({tip}+pi()/5))"


def _validated() -> str:
    size, tip, valley = _star_edge("a")
    radii = "when r < 0 then 'outer_corner_radius must be non-negative' when q < 0 then 'inner_corner_radius must be non-negative'"
    junction = f"case when a <= 0 then 'length must be positive' when b <= 0 then 'width must be positive' when b > a then 'width must not be greater than length' {radii} when r >= 0.5*b then 'outer_corner_radius is too large' when q > 0.5*a-0.5*b-r then 'inner_corner_radius is too large' end"
    plain = "when r < 0 then 'corner_radius must be non-negative'"
    own = {
        "rectangle": f"case when least(a, b) <= 0 then 'size components must be positive' {plain} end",
        "convex_quad": f"case {plain} when abs(a*b+0.01) <= 1e-12 then 'u and v must not be collinear' when r > 0 and r >= {INSET['convex_quad']} then 'corner_radius is too large' end",
        "trapezoid": f"case when a <= 0 then 'bottom_width must be positive' when b <= 0 then 'top_width must be positive' {plain} when r >= {INSET['trapezoid']} then 'corner_radius is too large' end",
        "ellipse": "case when least(a, b) <= 0 then 'axes must be positive' end",
        "egg": "case when a <= 0 then 'width must be positive' when b <= 0 then 'height must be positive' when abs(q*1.3) >= 1 then 'skew must be in (-1, 1)' end",
        "stadium": "case when a <= 0 then 'length must be positive' when b <= 0 then 'width must be positive' when a < b then 'length must not be less than width' end",
        "regular_polygon": f"case when b <= 0 then 'side_length must be positive' {plain} when r >= {INSET['regular_polygon']} then 'corner_radius is too large' end",
        "triangle": f"case when a <= 0 then 'base must be positive' when least(q*150, r*200) <= 0 then 'angles must be positive' when q*150 + r*200 >= 180 then 'alpha + beta must be less than 180 degrees' {plain} when r*0.1 > 0 and r*0.1 >= {_inradius('(q*150)', '(r*200)')} then 'corner_radius must be less than the inradius' end",
        "star": f"case when a <= 0 then 'outer_radius must be positive' when b <= 0 or b >= a then 'inner_radius must be in (0, outer_radius)' {radii} when r/({tip}) >= {size} then 'outer_corner_radius is too large' when q/({valley}) >= {size} then 'inner_corner_radius is too large' when r/({tip}) + q/({valley}) >= {size} then 'corner radii are too large together' end",
        "cross": junction, "tshape": junction, "bar": "case when b <= 0 then 'width must be positive' end",
    }
    return f"with {CHECKED} " + " union all ".join(f"select id, '{n}' shape, {e} error from c" for n, e in own.items())


def _projected() -> str:
    size, tip, valley = _star_edge("a+b")
    most = lambda bound: f"least(greatest(r, 0), {bound}*0.9999)"
    width = "least(b, a)"
    star = f"least(greatest(r, 0), {size}*({tip})*0.9999)"
    outer = f"least(greatest(r, 0), 0.5*{width}*0.9999)"
    own = [
        ("rectangle", "width", "a"), ("rectangle", "height", "b"), ("rectangle", "corner_radius", "least(greatest(r, 0), 0.5*least(a, b))"),
        *((n, "corner_radius", most(INSET[n])) for n in INSET), ("triangle", "corner_radius", most(_inradius("60", "50"))),
        ("star", "outer_corner_radius", star), ("star", "inner_corner_radius", f"least(greatest(q, 0), ({size}-{star}/({tip}))*({valley})*0.9999)"),
        *((n, p, e) for n in ("cross", "tshape") for p, e in (("length", "a"), ("width", width), ("outer_corner_radius", outer), ("inner_corner_radius", f"least(greatest(q, 0), greatest(a/2-{width}/2-{outer}, 0))"))),
    ]
    return f"with {MOVED} " + " union all ".join(f"select id, '{n}' shape, '{p}' param, {r6(e, 'value')} from c" for n, p, e in own)



def _csg(combine: str) -> str:
    a = box("(cos(radians(ang))*x + sin(radians(ang))*y)", "(cos(radians(ang))*y - sin(radians(ang))*x)", "(1.2+k/50)/2", "0.5", "0")
    sx = "(cos(radians(30))*(x-0.4) + sin(radians(30))*(y-0.2))"
    sy = "(cos(radians(30))*(y-0.2) - sin(radians(30))*(x-0.4))"
    b = f"(sqrt(power(greatest(abs({sx}) - 0.4, 0), 2) + power({sy}, 2) + {EPS}) - 0.3)"
    return f"with {PT}, d as (select pt, {a} a, {b} b from p) select pt, {r6(combine, 'sdf')} from d"


def _smin(a: str, b: str) -> str:
    h = f"least(greatest(0.5 + 0.5*(({b}) - ({a}))/0.3, 0), 1)"
    return f"(({b}) + {h}*(({a}) - ({b})) - 0.3*{h}*(1-{h}))"


#: Lattice vectors by row: (1 + k/50, 0.1) and (0.3, 1.2 + k/100).
LAT = PT + ", t as (select *, 1 + k/50 ax, 0.1::double ay, 0.3::double bx, 1.2 + k/100 \"by\" from p), q as (select *, ax*\"by\" - ay*bx det from t)"


def _ranges(x0: str, y0: str, x1: str, y1: str) -> str:
    """Ranges of a finite box over q's lattice: i0, i1, j0, j1."""
    def one(c, d):
        lo = f"(least({c}*({x0}), {c}*({x1})) + least({d}*({y0}), {d}*({y1})))"
        hi = f"(greatest({c}*({x0}), {c}*({x1})) + greatest({d}*({y0}), {d}*({y1})))"
        return f"ceil(-1 - {hi})::int", f"floor(2 - {lo})::int"

    i, j = one('("by"/det)', "(-bx/det)"), one("(-ay/det)", "(ax/det)")
    return f"{i[0]} i0, {i[1]} i1, {j[0]} j0, {j[1]} j1"


def _periodic(src: str, keys: str, lat: tuple[str, str, str, str], figures: list[str], out: str, ring: int = 4, center: tuple[int, int] = (0, 0)) -> str:
    """Distance at (x, y) of src over all copies of a wide ring: more than the engine looks at. figures: distances over ux, uy."""
    ax, ay, bx, by = lat
    det = f"(({ax})*({by}) - ({ay})*({bx}))"
    return f"""f as (select *, (({by})*x - ({bx})*y)/{det} f1, (({ax})*y - ({ay})*x)/{det} f2 from {src}),
g as (select *, f1 - floor(f1) g1, f2 - floor(f2) g2 from f),
h as (select *, (g1-i)*({ax}) + (g2-j)*({bx}) ux, (g1-i)*({ay}) + (g2-j)*({by}) uy from g, range({center[0] - ring}, {center[0] + ring + 1}) a(i), range({center[1] - ring}, {center[1] + ring + 1}) b(j)),
{out} as (select {keys}, min(least({', '.join(figures)})) sdf from h group by all)"""


def _turned(cx: str, cy: str, deg: str, w: str, h: str) -> str:
    c, s = f"cos(radians({deg}))", f"sin(radians({deg}))"
    return box(f"({c}*(ux-({cx})) + {s}*(uy-({cy})))", f"({c}*(uy-({cy})) - {s}*(ux-({cx})))", f"({w})/2", f"({h})/2", "0")


HEX = ("1.2", "0", "0.6", "1.2*sqrt(3)/2")
HEX_FIG = [_turned("0.1", "0.2", "30", "0.6", "0.35")]


def _grid(nx: int, ny: int) -> str:
    return f"n as (select iy::int iy, ix::int ix, ix/{nx}.0::double q1, iy/{ny}.0::double q2 from range({ny}) a(iy), range({nx}) b(ix)), xy as (select *, q1*1.2 + q2*0.6 x, q2*1.2*sqrt(3)/2 y from n)"


BOXES = "b as (select p_partkey id, p_partkey%10 + 0.137 ax, p_partkey%7 + 0.291 ay, 1 + p_size/25.0::double w, 1 + (p_retailprice-900)/100 h, (p_size%9)::double bx, (p_partkey%5)::double b_y, (p_partkey%360)::double ang from part)"
#: The cells of four turned rectangles over a lattice of 10 by 10, a row for each figure.
NODES = "n as (select p_partkey//4 cell_id, p_partkey%4 o, 2.5137 + 5*(p_partkey%2) + 0.12*(p_partkey%10 - 4.5) cx, 2.5091 + 5*(p_partkey%4//2) + 0.15*(p_partkey%7 - 3) cy, 0.5031 + p_size/14.0::double w, 0.4517 + (p_retailprice-900)/50 h, (p_partkey*37%360)::double ang from part)"
GAPS = NODES + f""", g as (select a.cell_id, min({_rect_gap(('a.cx', 'a.cy', 'a.w', 'a.h', 'a.ang'), ('b.cx+10*i', 'b.cy+10*j', 'b.w', 'b.h', 'b.ang'))}) g
 from n a join n b on a.cell_id = b.cell_id and a.o <= b.o, range(-1, 2) s(i), range(-1, 2) t(j) where a.o < b.o or i <> 0 or j <> 0 group by 1)"""
_IN = _rect_frame("x", "y", ("cx+10*i", "cy+10*j", "w", "h", "ang"))
FILL = f"""u as (select cell_id, q, bool_or({_IN[0]} <= w/2 and {_IN[1]} <= h/2) hit from (select n.*, q, (q%64)/64.0::double*10 x, (q//64)/64.0::double*10 y, i, j from n, range(4096) r(q), range(-1, 2) s(i), range(-1, 2) t(j)) group by 1, 2),
 v as (select cell_id, avg(hit::int) fill from u group by 1)"""
METRICS = GAPS + f", {FILL}, m as (select n.cell_id, count(*)::int num_shapes, min(least(w, h)) f, any_value(fill) fill, any_value(g.g) gap, list({{'w': w*abs(cos(radians(ang)))+h*abs(sin(radians(ang))), 'h': w*abs(sin(radians(ang)))+h*abs(cos(radians(ang)))}} order by o) l from n join g using (cell_id) join v using (cell_id) group by 1)"
CHECKS = METRICS + """, k as (select cell_id, list_filter(list_concat([
 case when fill < 0.08 then printf('fill_fraction %.3f < min_fill 0.08', fill) end, case when fill > 0.14 then printf('fill_fraction %.3f > max_fill 0.14', fill) end,
 case when num_shapes < 4 then printf('num_shapes %d < min_num_shapes 4', num_shapes) end, case when num_shapes > 4 then printf('num_shapes %d > max_num_shapes 4', num_shapes) end,
 case when f < 0.6 then printf('min_feature_size %.4f < required 0.6', f) end],
 list_transform(range(len(l)), lambda i: case when l[i+1].w < 0.7 or l[i+1].h < 0.7 then printf('shape %d size (%.4f, %.4f) < min_shape_size 0.7', i, l[i+1].w, l[i+1].h) end),
 [case when gap <= 1.0 then printf('min_gap %.4f <= required 1.0', gap) end]), lambda x: x is not null) e from m)"""
#: Cells of one rectangle over a 3 by 2 lattice: fingerprints of the different ones, and pairs within the tolerance.
#: Widths that differ by more than twice the tolerance, or heights, give samples beside the figure that differ by more.
PAIRS = f"""c as (select p_partkey id, 0.8 + (p_size%5)/10.0::double + 0.0015*(p_partkey%3) w, 0.6 + 0.0023*floor(p_retailprice-900) h from part), d as (select w, h, min(id) rep, count(*) n from c group by 1, 2),
 fp as (select rep, w, h, q, min({box('(x-1.5137-3*i)', '(y-1.0091-2*j)', 'w/2', 'h/2', '0')})::float v from (select d.*, q, (q%32)/32.0::double*3 x, (q//32)/32.0::double*2 y, i, j from d, range(1024) r(q), range(-1, 2) s(i), range(-1, 2) t(j)) group by 1, 2, 3, 4),
 pr as (select a.rep a, b.rep b from fp a join fp b on a.q = b.q and a.rep < b.rep and abs(a.w-b.w) < 0.0021 and abs(a.h-b.h) < 0.0021 group by 1, 2 having max(abs(a.v::double-b.v::double)) <= 1e-3)"""
ATTEMPTS = "o as (select o_orderkey id, case when o_orderkey%5 = 0 then null else o_totalprice/1000000 end fill, 1 + o_orderkey%4 att, o_orderpriority why from orders)"
REPORT = f"""with {ATTEMPTS} select count(*)::bigint requested, count(fill)::bigint as generated, (count(*)-count(fill))::bigint failed, sum(att)::bigint total_attempts,
 (select string_agg(why || '=' || n, ';' order by why) from (select why, sum(att-1)::bigint n from o where att > 1 group by 1)) reasons, round(min(fill), 6) lo, round(max(fill), 6) hi from o"""


def _outline_area() -> str:
    """Areas by corner: the sharp outline's, less what an arc of radius r that turns by t takes of a convex corner (r r tan(t/2), but for the chords' triangles), plus the same for hollow corners."""
    radius = {"rectangle": ("0.05", "0.05", 16), "convex_quad": ("0.05", "0.05", 32), "trapezoid": ("0.1", "0.1", 32), "regular_polygon": ("0.07", "0.07", 32), "triangle": ("0.04", "0.04", 32), "star": ("0.02", "0.03", 32), "cross": ("0.05", "0.1", 32), "tshape": ("0.05", "0.1", 32)}
    pick = lambda i: "case v.shape " + " ".join(f"when '{n}' then {r[i]}" for n, r in radius.items()) + " end"
    smooth = {
        "ellipse": "0.85*(0.9+k/200)/2*32*sin(pi()/32)", "stadium": "(1.1+k/100)*0.5 + 0.25*0.25*32*sin(pi()/32)",
        "egg": "0.5*63*sin(pi()/63)*((1.4+k/100)/2*1.3 + (1.4+k/100)/2*0.7)/2",
    }
    return f"""with {_vertices()}, c as (select shape, max(i)+1 n from v group by 1),
t as (select v.pt, v.shape, v.vx*b.vy - b.vx*v.vy cross2, atan2((v.vx-a.vx)*(b.vy-v.vy) - (v.vy-a.vy)*(b.vx-v.vx), (v.vx-a.vx)*(b.vx-v.vx) + (v.vy-a.vy)*(b.vy-v.vy)) turn, {pick(0)} ro, {pick(1)} ri, {pick(2)} segs
 from v join c on c.shape = v.shape join v a on a.pt = v.pt and a.shape = v.shape and a.i = (v.i+c.n-1)%c.n join v b on b.pt = v.pt and b.shape = v.shape and b.i = (v.i+1)%c.n),
w as (select *, case when turn > 0 then ro else ri end r, ceil(abs(turn)/(pi()/2)*segs - 1e-9) m from t),
o as (select pt, shape, sum(cross2)/2 - sum(sign(turn)*(r*r*tan(abs(turn)/2) - r*r*m*sin(abs(turn)/m)/2)) area from w group by 1, 2)
select pt, shape, {r6('area', 'area')} from o union all """ + " union all ".join(f"select pt, '{n}' shape, {r6(e, 'area')} from p" for n, e in smooth.items())


def _grad_lattice() -> str:
    """The nearest copy's direction, times how far that copy moves with the lattice vector (1.2 + k/100, 0)."""
    return f"""with {PT}, a as (select *, 1.2+k/100 len, (1.1*x-0.3*y)/(1.1*(1.2+k/100)) f1, y/1.1 f2 from p),
b as (select pt, x, y, len, (floor(f1)+i) m, x-(floor(f1)+i)*len-(floor(f2)+j)*0.3-0.31 ux, y-(floor(f2)+j)*1.1-0.27 uy from a, range(-2, 3) s(i), range(-2, 3) t(j)),
c as (select pt, arg_min(-m*ux/sqrt(ux*ux+uy*uy), ux*ux+uy*uy) g from b group by 1) select pt, {r6('g', 'd_sdf_d_length')} from c"""


def _grad_constrained() -> str:
    s = "1/(1+exp(-(k/5-5)))"
    return f"with {PT} select pt, {r6(f'0.2+1.2*{s}', 'bounded')}, {r6('ln(1+exp(k/5-5))', 'positive')}, {r6(f'1.2*{s}*(1-{s})', 'd_bounded')}, {r6(f'-0.5*{s}', 'd_sdf')} from p"


def oracle_sql() -> dict[str, str]:
    hl, hw = "((1.5+k/100)/2)", "0.2"
    arms = f"least({box('lx', 'ly', hl, hw, '0.05')}, {box('lx', 'ly', hw, hl, '0.05')}, {fillet(f'(abs(lx)-{hw})', f'(abs(ly)-{hw})', '0.1')})"
    tee = f"least(greatest({box('lx', f'(ly-({hl}-{hw}))', hl, hw, '0.05')}, {hl}-2*{hw}-ly), {box('lx', 'ly', hw, hl, '0.05')}, {fillet(f'(abs(lx)-{hw})', f'({hl}-2*{hw}-ly)', '0.1')})"
    quad = "[{x: -(0.5+k/100)+0.1, y: -0.1-(0.4+k/200)}, {x: (0.5+k/100)+0.1, y: 0.1-(0.4+k/200)}, {x: 1.2*(0.5+k/100)-0.09, y: 0.12+0.9*(0.4+k/200)}, {x: -1.2*(0.5+k/100)-0.09, y: -0.12+0.9*(0.4+k/200)}]"
    trap = "[{x: -(1+k/60)/2, y: -0.4}, {x: (1+k/60)/2, y: -0.4}, {x: 0.3, y: 0.4}, {x: -0.3, y: 0.4}]"
    ell = f"with recursive {LOC}, s as (select pt, k, abs(lx) px, abs(ly) py from l), {ellipse_gap('s', '0.85', '(0.9+k/200)/2', 'z')} select pt, {r6('sign(power(px/0.85, 2) + power(py/((0.9+k/200)/2), 2) - 1)*sqrt(power(px-nx, 2) + power(py-ny, 2))', 'sdf')} from z"
    egg = f"""with recursive {LOC}, s as (select pt, abs(lx) px, abs(ly) py, ly, (1.4+k/100)/2*1.3 up, (1.4+k/100)/2*0.7 dn from l), {ellipse_gap('s', '0.5', 'up', 'z')}, {ellipse_gap('s', '0.5', 'dn', 'w')}
select z.pt, {r6("sign(power(z.px/0.5, 2) + power(z.ly/(case when z.ly >= 0 then z.up else z.dn end), 2) - 1)*least(sqrt(power(z.px-z.nx, 2)+power(z.ly-z.ny, 2)), sqrt(power(z.px-w.nx, 2)+power(z.ly+w.ny, 2)))", 'sdf')} from z join w on z.pt = w.pt"""
    reg = ", ".join(f"{{x: {x}, y: {y}}}" for x, y in _regular("(0.6+k/100)/(2*sin(pi()/5))"))
    tri_l = "(1.2+k/100)*sin(radians(50))/sin(radians(110))"
    tri = ", ".join(f"{{x: {x}, y: {y}}}".replace("tax", f"({tri_l}*cos(radians(60)))").replace("tay", f"({tri_l}*sin(radians(60)))") for x, y in TRI_L)
    ring_edges = f"with {_vertices()}, n as (select shape, max(i)+1 n from v group by 1), e as (select a.pt, a.shape, a.x, a.y, a.vx ax, a.vy ay, b.vx bx, b.vy b_y from v a join n on n.shape = a.shape join v b on b.pt = a.pt and b.shape = a.shape and b.i = (a.i+1)%n.n)"
    far = _periodic("p", "pt", ("1", "0", "0", "1"), [_turned("10", "10", "20", "6.5", "0.3")], "z", 8, (-10, -10))
    rectfig = [_turned("0.35", "0.3", "30", "0.7", "0.4"), "abs(uy-0.9)-0.05"]
    hexd = lambda src, keys: _periodic(src, keys, HEX, HEX_FIG, "z")
    soft = "least(1.2/64, sqrt(0.36+1.08)/64)"
    bnd = f"""with {_grid(128, 128)}, {hexd('xy', 'iy, ix, x, y')}, e as (
 select a.x x0, a.y y0, a.sdf d0, b.sdf d1, b.x + case when a.ix = 127 then 1.2 else 0 end x1, b.y y1 from z a join z b on b.iy = a.iy and b.ix = (a.ix+1)%128
 union all select a.x, a.y, a.sdf, b.sdf, b.x + case when a.iy = 127 then 0.6 else 0 end, b.y + case when a.iy = 127 then 1.2*sqrt(3)/2 else 0 end from z a join z b on b.ix = a.ix and b.iy = (a.iy+1)%128),
c as (select *, case when abs(d0-d1) <= 1e-12 then 0.5 else d0/(d0-d1) end t from e where (d0 <= 0) <> (d1 <= 0)) select {r6('x0+t*(x1-x0)', 'x')}, {r6('y0+t*(y1-y0)', 'y')} from c"""
    rect4 = lambda cx, cy, w, h, deg: [(f"({cx})+cos(radians({deg}))*({a}({w})/2)-sin(radians({deg}))*({b}({h})/2)", f"({cy})+sin(radians({deg}))*({a}({w})/2)+cos(radians({deg}))*({b}({h})/2)") for a, b in (("-", "-"), ("", "-"), ("", ""), ("-", ""))]
    def span(c):
        xs, ys = ", ".join(x for x, _ in c), ", ".join(y for _, y in c)
        return f"least({xs})", f"least({ys})", f"greatest({xs})", f"greatest({ys})"

    rb = span(rect4("k/5", "-k/7", "0.5+k/30", "0.4", "ang"))
    chain_box = [(f"(0.1+1.5*(0.3{a}0.5-0.1))", f"(0.2+1.5*(0.1{b}(0.5+k/100)/2-0.2))") for a, b in (("-", "-"), ("+", "-"), ("+", "+"), ("-", "+"))]
    chain = span([(f"0.5+cos(radians(ang))*({x}-0.5)-sin(radians(ang))*{y}+k/10", f"sin(radians(ang))*({x}-0.5)+cos(radians(ang))*{y}-1") for x, y in chain_box])
    cbox = span(rect4("k/10", "1", "1", "0.5", "ang"))
    union_box = (f"least({cbox[0]}, -0.5)", f"least({cbox[1]}, -0.2)", f"greatest({cbox[2]}, 0.5)", f"greatest({cbox[3]}, 0.2)")
    mid = [("x", "(ax+bx)/2"), ("y", '(ay+"by")/2')]
    centered = [f"{union_box[i]} - ({union_box[i % 2]} + {union_box[i % 2 + 2]})/2 + {mid[i % 2][1]}" for i in range(4)]
    ext = [("0", "0"), ("3*ax", "3*ay"), ("2*bx", '2*"by"'), ("3*ax+2*bx", '3*ay+2*"by"')]
    hexc = [("0", "0"), ("(1+k/10)", "0"), ("(1+k/10)/2", "(1+k/10)*sqrt(3)/2"), ("(1+k/10)*1.5", "(1+k/10)*sqrt(3)/2")]
    e0, h0 = span(ext), span(hexc)
    lx, ly = "(cos(radians(ang))*(x-0.1)+sin(radians(ang))*(y+0.2))", "(cos(radians(ang))*(y+0.2)-sin(radians(ang))*(x-0.1))"
    grad = f"""with {PT}, a as (select *, {lx} lx, {ly} ly, 0.6+k/50 w, 0.4+k/80 h from p), b as (select *, abs(lx)-(w/2-0.05) qx, abs(ly)-(h/2-0.05) qy from a),
c as (select *, case when qx > 0 or qy > 0 then greatest(qx,0)/sqrt(power(greatest(qx,0),2)+power(greatest(qy,0),2)) else 0 end gx, case when qx > 0 or qy > 0 then greatest(qy,0)/sqrt(power(greatest(qx,0),2)+power(greatest(qy,0),2)) else 0 end gy from b),
d as (select *, gx + case when greatest(qx,qy) < 0 and qx >= qy then 1 else 0 end dx, gy + case when greatest(qx,qy) < 0 and qx < qy then 1 else 0 end dy from c)
select pt, {r6('-dx/2', 'd_sdf_d_width')}, {r6('-dx*sign(lx)*cos(radians(ang)) + dy*sign(ly)*sin(radians(ang))', 'd_sdf_d_cx')} from d"""
    gfill = f"""with a as (select p_partkey cell_id, 0.5 + p_size/50.0::double w, (i%16+0.5)/16.0::double*2-1-0.013 x, (i//16+0.5)/16.0::double*2-1-0.027 y from part, range(256) t(i)), b as (select *, abs(x)-w/2 qx, abs(y)-0.35 qy from a),
c as (select *, sqrt(greatest(power(greatest(qx,0),2)+power(greatest(qy,0),2), {TINY})) + least(greatest(qx,qy),0) d, case when qx > 0 then qx/sqrt(qx*qx+power(greatest(qy,0),2)) when qy <= 0 and qx >= qy then 1 else 0 end dx from b),
m as (select cell_id, 1/(1+exp(d/0.1)) s, dx from c) select cell_id, {r6('avg(s*(1-s)/0.1*dx/2)', 'd_fill_d_width')} from m group by 1"""
    fill = f"""with c as (select p_partkey cell_id, 0.5071 + p_size/25.0::double w, 0.4053 + (p_retailprice-900)/100 h, radians((p_partkey%360)::double) t, 0.1037 + (p_partkey%13)/10.0::double cx, 0.2019 + (p_partkey%11)/10.0::double cy from part),
s as (select c.*, (i::double-1)*4 + (j::double-1)*2 ox, (j::double-1)*2*sqrt(3) oy from c, range(4) a(i), range(4) b(j)),
g as (select q, (q%64)/64.0::double*4 + (q//64)/64.0::double*2 x, (q//64)/64.0::double*2*sqrt(3) y from range(4096) t(q)),
d as (select cell_id, q, max((greatest(abs(cos(t)*(x-ox-cx)+sin(t)*(y-oy-cy))-w/2, abs(cos(t)*(y-oy-cy)-sin(t)*(x-ox-cx))-h/2) <= 0)::int) hit from s, g group by 1, 2)
select cell_id, {r6('avg(hit::double)', 'fill_fraction')} from d group by 1"""
    return {
        "sdf_rectangle": f"with {LOC} select pt, {r6(box('lx', 'ly', '(0.6+k/50)/2', '(0.4+k/80)/2', '0.05'), 'sdf')} from l",
        "sdf_convex_quad": polygon(quad, 4, "0.05"), "sdf_trapezoid": polygon(trap, 4, "0.1"), "sdf_ellipse": ell, "sdf_egg": egg,
        "sdf_stadium": f"with {LOC} select pt, {r6(f'sqrt(power(greatest(abs(lx)-(1.1+k/100)/2, 0), 2) + ly*ly + {EPS}) - 0.25', 'sdf')} from l",
        "sdf_regular_polygon": polygon(f"[{reg}]", 5, "0.07"), "sdf_triangle": polygon(f"[{tri}]", 3, "0.04"), "sdf_star": _star(),
        "sdf_cross": f"with {LOC} select pt, {r6(arms, 'sdf')} from l", "sdf_tshape": f"with {LOC} select pt, {r6(tee, 'sdf')} from l", "sdf_bar": f"with {PT} select pt, {r6('abs(y-0.1-k/100)-0.2', 'sdf')} from p",
        "bounds_all": _bounds_all(), "min_feature_size": _min_feature(),
        "validate_shapes": _validated(), "project_params": _projected(),
        "csg_union": _csg("least(a, b)"), "csg_intersection": _csg("greatest(a, b)"), "csg_difference": _csg("greatest(a, -b)"),
        "csg_smooth_union": _csg(_smin("a", "b")), "csg_smooth_intersection": _csg(f"-{_smin('-a', '-b')}"), "csg_smooth_difference": _csg(f"-{_smin('-a', 'b')}"),
        "csg_union_many": f"with {PT}, s as (select s_suppkey%5-2+0.03 cx, s_suppkey%4-1.5+0.01 cy, 0.2+s_suppkey/100.0::double w from supplier) select pt, {r6('min(' + box('(x-cx)', '(y-cy)', 'w/2', '0.15', '0') + ')', 'sdf')} from p, s group by 1",
        "csg_setop_equivalence": _csg("least(a, b)").replace(" select pt, round(least(a, b), 6) + 0 as sdf from d", """, n as (select count(*) filter (where a <= 0 or b <= 0) u, count(*) filter (where a <= 0 and b <= 0) i, count(*) filter (where a <= 0 and not b < 0) m from d)
 select 'union' op, u by_distance, u by_sets from n union all select 'intersection', i, i from n union all select 'difference', m, m from n"""),
        "tf_translate": f"with {PT} select pt, {r6(box('(x-0.5)', '(y+0.3)', '0.5', '0.25', '0'), 'sdf')} from p",
        "tf_rotate": f"with {PT}, q as (select pt, cos(radians(ang))*(x-0.2)+sin(radians(ang))*(y-0.3)+0.2 ux, cos(radians(ang))*(y-0.3)-sin(radians(ang))*(x-0.2)+0.3 uy from p) select pt, {r6(box('(ux-0.2)', '(uy-0.1)', '0.5', '0.25', '0'), 'sdf')} from q",
        "tf_scale": f"with {PT}, q as (select pt, 0.5+k/50 s, (x-0.1)/(0.5+k/50)+0.1 ux, (y-0.2)/(0.5+k/50)+0.2 uy from p) select pt, {r6('s*' + box('(ux-0.2)', '(uy-0.1)', '0.5', '0.25', '0'), 'sdf')} from q",
        "tf_feature_size": f"with {PT}, q as (select *, least(1+k/50, 0.5+k/40) f from p) select pt, {r6('f', 'moved')}, {r6('f', 'turned')}, {r6('f*(0.5+k/100)', 'scaled')}, null::double unite from q",
        "tf_bounds": f"with {PT}, q as (select *, k/25-0.5 > 0.5 gone from p) select pt, {', '.join(r6(c, f'c{i}') for i, c in enumerate(chain))}, " + ", ".join(r6(f"case when gone then '{inf}'::double else {v} end", f"i{i}") for i, (inf, v) in enumerate((("inf", "greatest(-0.5, k/25-0.5)+1"), ("inf", "0.5"), ("-inf", "least(0.5, k/25+0.5)+1"), ("-inf", "1.5")))) + " from q",
        "lattice_area": f"with {LAT} select pt, {r6('abs(det)', 'oblique')}, {r6('power(1+k/10, 2)*sqrt(3)/2', 'pointy')}, {r6('power(1+k/10, 2)*sqrt(3)/2', 'flat')}, {r6('(1+k)*2', 'rect')} from q",
        "lattice_roundtrip": f"with {LAT} select pt, " + r6('("by"*x-bx*y)/det', "f1") + ", " + r6("(ax*y-ay*x)/det", "f2") + f", {r6('x', 'x')}, {r6('y', 'y')} from q",
        "lattice_offset": f"with {LAT} select pt, {r6('(k%7-3)*ax+(k%5-2)*bx', 'ox')}, " + r6('(k%7-3)*ay+(k%5-2)*"by"', "oy") + " from q",
        "neighbor_offsets": "select r::int ring, i::int i, j::int j from range(4) t(r), range(-3, 4) a(i), range(-3, 4) b(j) where abs(i) <= r and abs(j) <= r",
        "grid_fractional": f"select iy::int iy, ix::int ix, {r6('ix/48.0::double', 'f1')}, {r6('iy/32.0::double', 'f2')} from range(32) a(iy), range(48) b(ix)",
        "grid_cartesian": f"select iy::int iy, ix::int ix, {r6('ix/48.0::double*1.5+iy/32.0::double*0.75', 'x')}, {r6('iy/32.0::double*1.5*sqrt(3)/2', 'y')} from range(32) a(iy), range(48) b(ix)",
        "fold_points": f"with {LAT}, f as (select *, (\"by\"*x-bx*y)/det f1, (ax*y-ay*x)/det f2 from q) select pt, {r6('(f1-floor(f1))*ax+(f2-floor(f2))*bx', 'x')}, " + r6('(f1-floor(f1))*ay+(f2-floor(f2))*"by"', "y") + " from f",
        "copy_ranges": f"with {LAT} select pt, {_ranges(*rb)}, -1 bi0, 1 bi1, ceil(-1-(0.1+k/9+0.2)/2)::int bj0, floor(2-(0.1+k/9-0.2)/2)::int bj1 from q",
        "piece_ranges": f"with {PT} select pt, least(-1, ceil(-1-(2.5+k/10))::int) i0, greatest(1, floor(2-(k/10-2.5))::int) i1, least(ceil(-1.15)::int, ceil(-1-(0.5+(0.2+k/50)/2))::int) j0, greatest(floor(2.15)::int, floor(2-(0.5-(0.2+k/50)/2))::int) j1 from p",
        "periodic_sdf_rect": f"with {PT}, {_periodic('p', 'pt', ('1.3', '0', '0', '1.1'), rectfig, 'z')} select pt, {r6('sdf', 'sdf')} from z",
        "periodic_sdf_hex": f"with {PT}, {hexd('p', 'pt')} select pt, {r6('sdf', 'sdf')} from z",
        "periodic_sdf_far": f"with {PT}, {far} select pt, {r6('sdf', 'sdf')} from z",
        "rasterize": f"with {_grid(40, 30)}, {hexd('xy', 'iy, ix, x, y')} select (iy+30*b)::int iy, (ix+40*a)::int ix, {r6('x+a*1.2+b*0.6', 'x')}, {r6('y+b*1.2*sqrt(3)/2', 'y')}, {r6('sdf', 'sdf')} from z, range(2) s(a), range(3) t(b)",
        "rasterize_cartesian": f"with xy as (select iy::int iy, ix::int ix, ix/80.0::double*3.0 x, iy/30.0::double*1.2*sqrt(3)/2 y from range(30) a(iy), range(80) b(ix)), {hexd('xy', 'iy, ix, x, y')} select iy, ix, {r6('x', 'x')}, {r6('y', 'y')}, {r6('sdf', 'sdf')} from z",
        "mask_hard": f"with {_grid(64, 64)}, {hexd('xy', 'iy, ix, x, y')} select iy, ix, (sdf <= 0)::int::double mask from z",
        "mask_soft": f"with {_grid(64, 64)}, {hexd('xy', 'iy, ix, x, y')} select iy, ix, {r6(f'1/(1+exp(sdf/{soft}))', 'mask')} from z",
        "boundary_points": bnd,
        "extent": f"with {LAT} select pt, {r6(e0[0], 'o0')}, {r6(e0[2], 'o1')}, {r6(e0[1], 'o2')}, {r6(e0[3], 'o3')}, {r6(h0[0], 'h0')}, {r6(h0[2], 'h1')}, {r6(h0[1], 'h2')}, {r6(h0[3], 'h3')} from q",
        "center_bbox": f"with {LAT} select pt, {', '.join(r6(c, f'b{i}') for i, c in enumerate(centered))} from q",
        "poly_vertices": f"with {_vertices()} select pt, shape, i::int i, {r6('vx', 'x')}, {r6('vy', 'y')} from v",
        "poly_area": f"{ring_edges} select pt, shape, {r6('abs(sum(ax*b_y-bx*ay))/2', 'area')} from e group by 1, 2",
        "poly_centroid": f"{ring_edges} select pt, shape, {r6('sum((ax+bx)*(ax*b_y-bx*ay))/(3*sum(ax*b_y-bx*ay))', 'x')}, {r6('sum((ay+b_y)*(ax*b_y-bx*ay))/(3*sum(ax*b_y-bx*ay))', 'y')} from e group by 1, 2",
        "poly_outline_area": _outline_area(),
        "poly_transform": f"with {_vertices()}, m as (select v.pt, vx+v.x mx, vy+v.y my, 0.3+cos(radians(k*7))*(vx-0.3)-sin(radians(k*7))*(vy+0.1) rx, -0.1+sin(radians(k*7))*(vx-0.3)+cos(radians(k*7))*(vy+0.1) ry, 0.1+(0.5+k/50)*(vx-0.1) sx, 0.2+(0.5+k/50)*(vy-0.2) sy from v join p using (pt) where shape = 'star') select pt, " + ", ".join(r6(f"{f}({c}{a})", f"{c}_{a}{i}") for c in "mrs" for i, f in ((0, "min"), (1, "max")) for a in "xy") + " from m group by 1",
        "poly_raster": f"{ring_edges} select pt, shape, count(*) filter (where (ay > y) <> (b_y > y) and x < ax + (y-ay)/nullif(b_y-ay, 0)*(bx-ax)) % 2 = 1 inside from e group by 1, 2",
        "poly_covers": "select p_partkey id, ix::int ix, iy::int iy, abs(ix/4.0::double - p_size%4/4.0::double) <= (1 + (p_size%3)/2.0::double)/2 and abs(iy/4.0::double - p_partkey%4/4.0::double) <= (0.5 + (p_partkey%5)/4.0::double)/2 covered from part, range(-4, 5) a(ix), range(-4, 5) b(iy)",
        "poly_distance": f"with {BOXES} select id, {r6(_rect_gap(('ax', 'ay', 'w', 'h', 'ang'), ('bx', 'b_y', '1', '1', '0')), 'distance')} from b",
        "poly_boolean_area": f"with {BOXES}, c as (select *, greatest(least(ax+w/2, bx+0.5)-greatest(ax-w/2, bx-0.5), 0)*greatest(least(ay+h/2, b_y+0.5)-greatest(ay-h/2, b_y-0.5), 0) i from b) select id, round(w*h+1-i, 9) + 0 union_area, round(i, 9) + 0 intersection_area, round(w*h-i, 9) + 0 difference_area from c",
        "cell_polygon_area": f"with {BOXES} select id, {r6('least(w, 4)*least(h, 3)', 'area')} from b",
        "round_corners_area": f"with {BOXES} select id, {r6('w*h - 0.04*(4-64*sin(pi()/32)/2)', 'area')} from b",
        "cell_polygon_area_hex": f"with {BOXES} select id, {r6('w*(1 + (id%7)/4.0::double)', 'area')} from b",
        "remove_holes_area": f"with {BOXES} select id, {r6('w*h', 'area')} from b",
        "contour_area": f"with m as (select p_partkey id, 1+p_size%9 w, 1+p_partkey%7 h from part), n as (select *, w > 2 and h > 2 pierced from m) select id, 1+pierced::int rings, 0 last_part, {r6('w*h-0.5::double', 'area')}, {r6('case when pierced then 0.5::double end', 'hole_area')} from n",
        "gds_roundtrip": "with q as (select p_partkey//50 layout, p_partkey%1000+0.137::double x, 0.291::double-p_partkey%7 y, 1+p_size/30.0::double w from part) select layout, 3 layer, 4 vertices, round(x, 3)+0 x0, round(y, 3)+0 y0, round(x+w, 3)+0 x1, round(y+w/2, 3)+0 y1 from q",
        "generate_hooks": f"select hook, i::bigint cell_id, hook = 'plain' made, case hook when 'plain' then 1 else 20 end::bigint attempts, case hook when 'plain' then '' when 'failing' then 'no_room=20' else 'not_wanted=20' end reasons, round(case hook when 'plain' then 0.6/9::double end, 6) fill from range(24) t(i), (values ('plain'), ('failing'), ('rejecting')) v(hook)",
        "fill_fraction": fill,
        "leaf_count": """with recursive s as (select p_partkey//10 cell_id, p_partkey%10+1 node_id, (p_partkey%10+1)//2 parent_id, case when (p_partkey%10+1)*2 > 10 then 'Rectangle' when p_partkey%10 = 4 then 'Translate' when (p_partkey//10 + p_partkey%10+1)%5 = 0 then 'Difference'
 when (p_partkey//10 + p_partkey%10+1)%7 = 0 then 'Translate' else 'Union' end as type from part), w as (select s.* from s left join s t on t.cell_id = s.cell_id and t.node_id = s.parent_id where t.node_id is null
 union all select s.* from w join s on s.cell_id = w.cell_id and s.parent_id = w.node_id where w.type in ('Union', 'Translate'))
 select cell_id, count(*) leaves, count(*) filter (where type = 'Difference') differences from w where type not in ('Union', 'Translate') group by 1""",
        "leaf_metrics": f"with {NODES}, b as (select *, w*abs(cos(radians(ang)))+h*abs(sin(radians(ang))) bw, w*abs(sin(radians(ang)))+h*abs(cos(radians(ang))) bh from n) select cell_id, count(*)::int num_shapes, {r6('min(least(w, h))', 'min_feature_size')}, string_agg(printf('%.6f', round(w*h, 6)), ',' order by o) shape_areas, string_agg(printf('%.6f', round(bw, 6)), ',' order by o) widths, string_agg(printf('%.6f', round(bh, 6)), ',' order by o) heights from b group by 1",
        "min_gap": f"with {GAPS} select cell_id, {r6('g', 'min_gap')} from g",
        "cell_metrics": f"with {METRICS} select cell_id, {r6('fill', 'fill_fraction')}, num_shapes, {r6('f', 'min_feature_size')}, {r6('gap', 'min_gap')} from m",
        "constraint_check": f"with {CHECKS} select cell_id, coalesce(array_to_string(e, '; '), '') failures from k", "validate_cells": f"with {CHECKS} select cell_id, e[1] failure from k",
        "dup_pairs": f"with {PAIRS} select a, b from pr union all select rep, id from c join d using (w, h) where id <> rep",
        "dup_groups": f"with recursive {PAIRS}, e as (select a, b from pr union all select b, a from pr), r as (select a node, a other from e union select r.node, e.b from r join e on e.a = r.other), t as (select node, min(other) g from r group by 1) select coalesce(g, rep) group_id, id as member from c join d using (w, h) left join t on node = rep where n > 1 or g is not null",
        "generator_lattice": f"with {LAT}, s as (select *, (2+k/25)/sqrt(ax*ax+ay*ay) f, (1.5+k/20)/sqrt(ax*ax+ay*ay) f1, 3/sqrt(bx*bx+\"by\"*\"by\") f2 from q) select pt, " + ", ".join(r6(e, n) for n, e in (("w1x", "ax*f"), ("w1y", "ay*f"), ("w2x", "bx*f"), ("w2y", '"by"*f'), ("s1x", "ax*f1"), ("s1y", "ay*f1"), ("s2x", "bx*f2"), ("s2y", '"by"*f2'))) + " from s",
        "generate_valid": "select i::bigint cell_id, true number_ok, true gap_ok, true kinds_ok, true fill_ok, true attempts_ok from range(24) t(i)", "yaml_roundtrip": "select i::bigint cell_id, true same from range(24) t(i)",
        "center_centroid": "select i::bigint cell_id, 1.5::double x, 1.5::double y from range(24) t(i)", "grad_lattice": _grad_lattice(), "grad_constrained": _grad_constrained(),
        "report_rollup": REPORT, "report_merge": REPORT,
        "scene_json_scan": "select p_partkey cell_id, case when p_partkey%17 = 0 then null when p_partkey%2 = 0 then 'Cross' else 'Star' end as type, case when p_partkey%17 = 0 then null else p_size::double end a1x from part",
        "grad_sdf_rect": grad, "grad_softmask_fill": gfill,
    }
