"""GeoSPARQL functions over WKT literals, planar; points are native, other shapes Arrow-batched Python."""

from __future__ import annotations

import json
import math
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lattica.functions.values import Val, lexical, lit, number
from lattica.terms import LITERAL, term_col

GEOF = "http://www.opengis.net/def/function/geosparql/"
WKT = "http://www.opengis.net/ont/geosparql#wktLiteral"
EPS = 1e-10


# -- shapes: (kind, coordinates); a polygon's coordinates are its rings -------------
def parse_wkt(text: str):
    """(kind, coordinates, has_z) of a WKT text; None if it is not well formed."""
    m = re.fullmatch(r"\s*(?:<[^>]*>\s*|SRID=\d+;\s*)?([A-Za-z]+)\s*(Z|M|ZM)?\s*(EMPTY|\(.*\))\s*", text or "", re.S)
    if not m:
        return None
    kind, body = m[1].upper(), m[3]
    if body == "EMPTY":
        return kind, [], bool(m[2])
    if kind == "GEOMETRYCOLLECTION":
        parts, depth, start = [], 0, 1
        for i, c in enumerate(body):
            depth += (c == "(") - (c == ")")
            if (c == "," and depth == 1) or (c == ")" and depth == 0):
                parts.append(parse_wkt(body[start:i]))
                start = i + 1
        return kind, [p for p in parts if p], any(p and p[2] for p in parts)
    try:
        nested = json.loads(re.sub(r"([-+\d.eE]+(?:\s+[-+\d.eE]+)+)", lambda n: "[" + ",".join(repr(float(x)) for x in n[1].split()) + "]", body).replace("(", "[").replace(")", "]"))
    except ValueError:
        return None
    if kind == "POINT":
        nested = nested[0]
    if kind == "MULTIPOINT":
        nested = [p[0] if isinstance(p[0], list) else p for p in nested]
    return kind, nested, len(next(_points_of(kind, nested), [0, 0])) > 2


def _points_of(kind, c):
    if kind == "POINT":
        if c:
            yield c
    elif kind in ("LINESTRING", "MULTIPOINT"):
        yield from c
    elif kind in ("POLYGON", "MULTILINESTRING", "TRIANGLE"):
        for r in c:
            yield from r
    elif kind in ("MULTIPOLYGON", "TIN", "POLYHEDRALSURFACE"):
        for p in c:
            for r in p:
                yield from r
    elif kind == "GEOMETRYCOLLECTION":
        for g in c:
            yield from _points_of(g[0], g[1])


def points(g):
    return list(_points_of(g[0], g[1]))


def polygons(g):
    if g[0] in ("POLYGON", "TRIANGLE"):
        return [g[1]] if g[1] else []
    if g[0] in ("MULTIPOLYGON", "TIN", "POLYHEDRALSURFACE"):
        return g[1]
    return [p for x in g[1] for p in polygons(x)] if g[0] == "GEOMETRYCOLLECTION" else []


def segments(g):
    """Edges of lines and rings."""
    kind, c = g[0], g[1]
    lines = [c] if kind == "LINESTRING" else c if kind in ("MULTILINESTRING", "POLYGON", "TRIANGLE") else [r for p in c for r in p] if kind in ("MULTIPOLYGON", "TIN", "POLYHEDRALSURFACE") else []
    if kind == "GEOMETRYCOLLECTION":
        return [s for x in c for s in segments(x)]
    return [(a, b) for r in lines for a, b in zip(r, r[1:], strict=False)]


def on_segment(p, a, b) -> bool:
    cross = (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])
    return abs(cross) < 1e-9 and min(a[0], b[0]) - EPS <= p[0] <= max(a[0], b[0]) + EPS and min(a[1], b[1]) - EPS <= p[1] <= max(a[1], b[1]) + EPS


def _in_ring(p, ring) -> bool:
    inside = False
    for a, b in zip(ring, ring[1:], strict=False):
        if (a[1] > p[1]) != (b[1] > p[1]) and p[0] < (b[0] - a[0]) * (p[1] - a[1]) / (b[1] - a[1]) + a[0]:
            inside = not inside
    return inside


def locate(p, g) -> int:
    """1 inside, 0 on the boundary, -1 outside."""
    for rings in polygons(g):
        if any(on_segment(p, a, b) for r in rings for a, b in zip(r, r[1:], strict=False)):
            return 0
        if _in_ring(p, rings[0]) and not any(_in_ring(p, h) for h in rings[1:]):
            return 1
    if g[0] in ("LINESTRING", "MULTILINESTRING"):
        ends = [q for line in ([g[1]] if g[0] == "LINESTRING" else g[1]) for q in (line[0], line[-1]) if line[0] != line[-1]]
        if any(near(p, q) for q in ends):
            return 0
        return 1 if any(on_segment(p, a, b) for a, b in segments(g)) else -1
    if g[0] in ("POINT", "MULTIPOINT"):
        return 1 if any(near(p, q) for q in points(g)) else -1
    if g[0] == "GEOMETRYCOLLECTION":
        return max((locate(p, x) for x in g[1]), default=-1)
    return -1


def near(p, q) -> bool:
    return abs(p[0] - q[0]) < EPS and abs(p[1] - q[1]) < EPS


def crossing(a, b, c, d):
    """Where two segments meet in one point, or None."""
    r, s = (b[0] - a[0], b[1] - a[1]), (d[0] - c[0], d[1] - c[1])
    den = r[0] * s[1] - r[1] * s[0]
    if abs(den) < 1e-15:
        return None
    t = ((c[0] - a[0]) * s[1] - (c[1] - a[1]) * s[0]) / den
    u = ((c[0] - a[0]) * r[1] - (c[1] - a[1]) * r[0]) / den
    return (a[0] + t * r[0], a[1] + t * r[1]) if -EPS <= t <= 1 + EPS and -EPS <= u <= 1 + EPS else None


def sample(g, other):
    """Points of ``g`` that tell how it lies to ``other``: vertices, crossings, and midpoints between them."""
    out = list(points(g))
    for a, b in segments(g):
        cuts = [a, b, *[q for q in points(other) if on_segment(q, a, b)]]
        cuts += [x for c, d in segments(other) if (x := crossing(a, b, c, d))]
        cuts.sort(key=lambda q: (q[0] - a[0]) ** 2 + (q[1] - a[1]) ** 2)
        out += cuts + [((p[0] + q[0]) / 2, (p[1] + q[1]) / 2) for p, q in zip(cuts, cuts[1:], strict=False) if not near(p, q)]
    return out


def interior_points(g, other):
    """Points within the areas of ``g``: beside every piece of either boundary, and centroids."""
    if not polygons(g):
        return [p for p in sample(g, other) if locate(p, g) == 1]
    out = []
    for shape, with_ in ((g, other), (other, g)):
        for a, b in segments(shape):
            cuts = sorted([a, b, *[x for c, d in segments(with_) if (x := crossing(a, b, c, d))]], key=lambda q: (q[0] - a[0]) ** 2 + (q[1] - a[1]) ** 2)
            for p, q in zip(cuts, cuts[1:], strict=False):
                n = math.hypot(q[0] - p[0], q[1] - p[1])
                if n > 1e-9:
                    m, e = ((p[0] + q[0]) / 2, (p[1] + q[1]) / 2), n * 1e-4
                    nx, ny = -(q[1] - p[1]) / n * e, (q[0] - p[0]) / n * e
                    out += [(m[0] + nx, m[1] + ny), (m[0] - nx, m[1] - ny), m]
    out += [centroid(g), *points(other), *sample(other, g)]
    return [p for p in out if p and locate(p, g) == 1]


def dimension(g) -> int:
    if g[0] == "GEOMETRYCOLLECTION":
        return max((dimension(x) for x in g[1]), default=0)
    return 2 if g[0] in ("POLYGON", "MULTIPOLYGON", "TIN", "TRIANGLE", "POLYHEDRALSURFACE") else 1 if "LINE" in g[0] else 0


def boundary_points(g, other):
    return [p for p in sample(g, other) if locate(p, g) == 0]


#: Matrices of a point and areas, by where the point lies; and the other way round.
_POINT_AREA = {1: "0FFFFF212", 0: "F0FFFF212", -1: "FF0FFF212"}
_AREA_POINT = {k: "".join(m[i] for i in (0, 3, 6, 1, 4, 7, 2, 5, 8)) for k, m in _POINT_AREA.items()}


def relate(a, b) -> str:
    """The DE-9IM matrix, from sample points that hold a witness of every cell for simple shapes."""
    if a[0] == "POINT" and a[1] and b[0] != "GEOMETRYCOLLECTION" and area(b) > 0:
        return _POINT_AREA[locate(a[1], b)]
    if b[0] == "POINT" and b[1] and a[0] != "GEOMETRYCOLLECTION" and area(a) > 0:
        return _AREA_POINT[locate(b[1], a)]
    da, db = dimension(a), dimension(b)
    ia, ib = interior_points(a, b), interior_points(b, a)
    ba, bb = boundary_points(a, b), boundary_points(b, a)

    def cell(found, dim):
        return str(dim) if found else "F"

    la, lb = [locate(p, b) for p in ia], [locate(p, a) for p in ib]
    lba, lbb = [locate(p, b) for p in ba], [locate(p, a) for p in bb]
    shared = [p for p in ba if locate(p, b) == 0]
    middle = any(locate(((p[0] + q[0]) / 2, (p[1] + q[1]) / 2), a) == 0 and locate(((p[0] + q[0]) / 2, (p[1] + q[1]) / 2), b) == 0 for p, q in zip(shared, shared[1:], strict=False) if not near(p, q))
    return "".join(
        [
            cell(1 in la or 1 in lb, min(da, db)),
            cell(1 in lbb, max(0, min(da, db - 1))),
            cell(-1 in la, da),
            cell(1 in lba, max(0, min(da - 1, db))),
            cell(bool(shared), 1 if middle and da == db == 2 else 0),
            cell(-1 in lba, max(0, da - 1)),
            cell(-1 in lb, db),
            cell(-1 in lbb, max(0, db - 1)),
            "2",
        ]
    )


def matches(matrix: str, pattern: str) -> bool:
    return all(p == "*" or (p == "T" and m != "F") or p == m for m, p in zip(matrix, pattern, strict=True))


def ring_area(r) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:], strict=False)) / 2


def area(g) -> float:
    return sum(abs(ring_area(p[0])) - sum(abs(ring_area(h)) for h in p[1:]) for p in polygons(g))


def length(g) -> float:
    return sum(math.hypot(b[0] - a[0], b[1] - a[1]) for a, b in segments(g))


def centroid(g):
    if polygons(g):
        sx = sy = total = 0.0
        for p in polygons(g):
            for i, r in enumerate(p):
                k = ring_area(r)
                if not k:
                    continue
                cx = sum((a[0] + b[0]) * (a[0] * b[1] - b[0] * a[1]) for a, b in zip(r, r[1:], strict=False)) / (6 * k)
                cy = sum((a[1] + b[1]) * (a[0] * b[1] - b[0] * a[1]) for a, b in zip(r, r[1:], strict=False)) / (6 * k)
                w = abs(k) * (1 if i == 0 else -1)
                sx, sy, total = sx + cx * w, sy + cy * w, total + w
        if total:
            return sx / total, sy / total
    if segments(g):
        w = length(g)
        if w:
            return tuple(sum((a[i] + b[i]) / 2 * math.hypot(b[0] - a[0], b[1] - a[1]) for a, b in segments(g)) / w for i in (0, 1))
    p = points(g)
    return (sum(q[0] for q in p) / len(p), sum(q[1] for q in p) / len(p)) if p else None


def hull(ps):
    ps = sorted({(p[0], p[1]) for p in ps})
    if len(ps) < 3:
        return ps

    def half(points):
        out = []
        for p in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return half(ps) + half(reversed(ps))


def distance(a, b) -> float:
    if a[0] == b[0] == "POINT":
        return math.hypot(a[1][0] - b[1][0], a[1][1] - b[1][1])
    if b[0] == "POINT":
        a, b = b, a
    if a[0] == "POINT":
        if locate(a[1], b) >= 0:
            return 0.0
        if segments(b):
            return min(_to_segment(a[1], c, d) for c, d in segments(b))
    p, q = centroid(a), centroid(b)
    return math.hypot(p[0] - q[0], p[1] - q[1])


def _to_segment(p, a, b) -> float:
    dx, dy = b[0] - a[0], b[1] - a[1]
    n = dx * dx + dy * dy
    t = max(0.0, min(1.0, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / n)) if n else 0.0
    return math.hypot(p[0] - a[0] - t * dx, p[1] - a[1] - t * dy)


def num(x: float) -> str:
    return str(int(x)) if x == int(x) else repr(x)


def ring_text(ps) -> str:
    return "(" + ", ".join(" ".join(num(x) for x in p) for p in ps) + ")"


def to_wkt(g) -> str:
    kind, c = g[0], g[1]
    if not c:
        return f"{kind} EMPTY"
    if kind == "POINT":
        return f"POINT({' '.join(num(x) for x in c)})"
    if kind in ("LINESTRING", "MULTIPOINT"):
        return f"{kind}{ring_text(c)}"
    if kind in ("POLYGON", "MULTILINESTRING", "TRIANGLE"):
        return f"{kind}(" + ", ".join(map(ring_text, c)) + ")"
    if kind == "GEOMETRYCOLLECTION":
        return f"{kind}(" + ", ".join(map(to_wkt, c)) + ")"
    return f"{kind}(" + ", ".join("(" + ", ".join(map(ring_text, p)) + ")" for p in c) + ")"


def to_geojson(g) -> str:
    names = {"POINT": "Point", "LINESTRING": "LineString", "POLYGON": "Polygon", "MULTIPOINT": "MultiPoint", "MULTILINESTRING": "MultiLineString", "MULTIPOLYGON": "MultiPolygon"}
    if g[0] == "GEOMETRYCOLLECTION":
        return json.dumps({"type": "GeometryCollection", "geometries": [json.loads(to_geojson(x)) for x in g[1]]})
    return json.dumps({"type": names[g[0]], "coordinates": g[1]})


def clip(subject, convex):
    """Part of a ring within a convex ring (counter-clockwise)."""
    out = [tuple(p) for p in subject[:-1]]
    edge = convex if ring_area(convex) > 0 else convex[::-1]
    for a, b in zip(edge, edge[1:], strict=False):
        side = lambda p: (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])  # noqa: E731, B023
        src, out = out, []
        for p, q in zip(src, src[1:] + src[:1], strict=True):
            if side(p) >= 0:
                out.append(p)
            if (side(p) >= 0) != (side(q) >= 0):
                t = side(p) / (side(p) - side(q))
                out.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
    return [*out, out[0]] if out else []


def intersection(a, b):
    if a[0] == "POLYGON" and b[0] == "POLYGON":
        r = clip(a[1][0], b[1][0])
        return ("POLYGON", [r] if r else [], False)
    inside = [p for p in points(a) if locate(p, b) >= 0]
    return ("MULTIPOINT" if len(inside) != 1 else "POINT", inside if len(inside) != 1 else inside[0], False)


def union(a, b):
    if a[0] == b[0] == "POLYGON" and not matches(relate(a, b), "FF*FF****"):
        if matches(relate(a, b), "T*F**F***"):
            return b
        if matches(relate(a, b), "T*****FF*"):
            return a
    if a[0] == b[0] == "POLYGON":
        return ("MULTIPOLYGON", [a[1], b[1]], False)
    return ("GEOMETRYCOLLECTION", [a, b], False)


def difference(a, b):
    if a[0] == b[0] == "POLYGON":
        m = relate(a, b)
        if matches(m, "FF*FF****") or m[0] == "F":
            return a
        if matches(m, "T*F**F***"):
            return ("POLYGON", [], False)
        if matches(m, "T*****FF*"):
            return ("POLYGON", [a[1][0], b[1][0], *a[1][1:]], False)
        cut = intersection(a, b)
        return ("POLYGON", [a[1][0], cut[1][0]], False) if cut[1] else a
    return ("MULTIPOINT", [p for p in points(a) if locate(p, b) < 0], False)


def sym_difference(a, b):
    return ("GEOMETRYCOLLECTION", [difference(a, b), difference(b, a)], False)


def buffer(g, d):
    """Around every vertex a 32-gon, and the hull of them."""
    ring = [(p[0] + d * math.cos(2 * math.pi * i / 32), p[1] + d * math.sin(2 * math.pi * i / 32)) for p in points(g) for i in range(32)]
    h = hull(ring)
    return ("POLYGON", [[*h, h[0]]], False)


def envelope(g):
    xs, ys = [p[0] for p in points(g)], [p[1] for p in points(g)]
    a, b, c, d = min(xs), min(ys), max(xs), max(ys)
    return ("POLYGON", [[(a, b), (c, b), (c, d), (a, d), (a, b)]], False)


def boundary(g):
    if polygons(g):
        rings = [r for p in polygons(g) for r in p]
        return ("LINESTRING", rings[0], False) if len(rings) == 1 else ("MULTILINESTRING", rings, False)
    if g[0] == "LINESTRING":
        return ("MULTIPOINT", [] if g[1][0] == g[1][-1] else [g[1][0], g[1][-1]], False)
    return ("GEOMETRYCOLLECTION", [], False)


def convex_hull(g):
    h = hull(points(g))
    return ("POLYGON", [[*h, h[0]]], False) if len(h) > 2 else ("LINESTRING", h, False) if len(h) == 2 else ("POINT", h[0], False)


def equal(a, b) -> bool:
    p, q = points(a), points(b)
    return a[0] == b[0] and len(p) == len(q) and all(near(x, y) for x, y in zip(p, q, strict=True))


def simple(g) -> bool:
    s = segments(g)
    return not any(crossing(*s[i], *s[j]) and not any(near(x, y) for x in s[i] for y in s[j]) for i in range(len(s)) for j in range(i + 2, len(s)))


def members(g) -> list:
    if g[0] == "GEOMETRYCOLLECTION":
        return g[1]
    if g[0].startswith("MULTI"):
        return [(g[0][5:], c, g[2]) for c in g[1]]
    return [g]


def volume(g) -> float:
    total = 0.0
    for p in polygons(g):
        r = p[0]
        for b, c in zip(r[1:], r[2:], strict=False):
            if len(r[0]) > 2:
                a = r[0]
                total += (a[0] * (b[1] * c[2] - b[2] * c[1]) - a[1] * (b[0] * c[2] - b[2] * c[0]) + a[2] * (b[0] * c[1] - b[1] * c[0])) / 6
    return abs(total)


#: DE-9IM patterns (fixed values of the OGC and RCC8 vocabularies).
RELATIONS = {
    "ehEquals": ["TFFFTFFFT"],
    "ehDisjoint": ["FF*FF****"],
    "ehMeet": ["FT*******", "F**T*****", "F***T****"],
    "ehOverlap": ["T*T***T**"],
    "ehCovers": ["T*TFT*FF*"],
    "ehCoveredBy": ["TFF*TFT**"],
    "ehInside": ["TFF*FFT**"],
    "ehContains": ["T*TFF*FF*"],
    "rcc8eq": ["TFFFTFFFT"],
    "rcc8dc": ["FFTFFTTTT"],
    "rcc8ec": ["FFTFTTTTT"],
    "rcc8po": ["TTTTTTTTT"],
    "rcc8tppi": ["TTTFTTFFT"],
    "rcc8tpp": ["TFFTTFTTT"],
    "rcc8ntpp": ["TFFTFFTTT"],
    "rcc8ntppi": ["TTTFFTFFT"],
    "sfTouches": ["FT*******", "F**T*****", "F***T****"],
    "sfContains": ["T*****FF*"],
    "sfWithin": ["T*F**F***"],
}


def intersects(a, b) -> bool:
    m = relate(a, b)
    return any(m[i] != "F" for i in (0, 1, 3, 4))


def crosses(a, b) -> bool:
    da, db = dimension(a), dimension(b)
    if da == db:
        return da == 1 and relate(a, b)[0] == "0"
    thin, other = (a, b) if da < db else (b, a)
    return {1, -1} <= {locate(p, other) for p in interior_points(thin, other)}


def overlaps(a, b) -> bool:
    m, d = relate(a, b), dimension(a)
    return d == dimension(b) and (matches(m, "1*T***T**") if d == 1 else matches(m, "T*T***T**"))


PREDICATES = {name: (lambda a, b, ps=ps: any(matches(relate(a, b), p) for p in ps)) for name, ps in RELATIONS.items()} | {
    "sfEquals": equal,
    "sfIntersects": intersects,
    "sfDisjoint": lambda a, b: not intersects(a, b),
    "sfCrosses": crosses,
    "sfOverlaps": overlaps,
}
NUMBERS = {
    "area": area,
    "length": length,
    "perimeter": length,
    "volume": volume,
    "surfaceArea": area,
    "minX": lambda g: min(p[0] for p in points(g)),
    "maxX": lambda g: max(p[0] for p in points(g)),
    "minY": lambda g: min(p[1] for p in points(g)),
    "maxY": lambda g: max(p[1] for p in points(g)),
    "minZ": lambda g: min(p[2] for p in points(g)),
    "maxZ": lambda g: max(p[2] for p in points(g)),
}
INTEGERS = {"dimension": dimension, "coordinateDimension": lambda g: 2, "getSRID": lambda g: 0, "numGeometries": lambda g: len(members(g))}
TESTS = {"isEmpty": lambda g: not points(g), "isSimple": simple, "is3D": lambda g: g[2], "isMeasured": lambda g: False}
SHAPES = {"boundary": boundary, "convexHull": convex_hull, "envelope": envelope, "centroid": lambda g: ("POINT", centroid(g), False)}
PAIRS = {"intersection": intersection, "union": union, "difference": difference, "symDifference": sym_difference}


@lru_cache(4096)  # constants stand in every row
def _parsed(text: str):
    return parse_wkt(text)


def _udf(f, kind: str):
    """A batched function of WKT columns; shapes that can't be read, and errors, are nulls.  Equal rows of a batch are worked out once."""

    def one(*args):
        try:
            shapes = [_parsed(a) if isinstance(a, str) else a for a in args]
            return None if any(s is None for s in shapes) else f(*shapes)
        except (ValueError, IndexError, ZeroDivisionError, TypeError):
            return None

    def each(a, b):
        known = {}
        for x, y in zip(a, b, strict=True):
            if (x, y) not in known:
                known[x, y] = one(x) if y == "\0" else one(x, y)
            yield known[x, y]

    if kind == "boolean" or kind == "double" or kind == "bigint" or kind == "string":

        @F.pandas_udf(kind)
        def run(a: pd.Series, b: pd.Series) -> pd.Series:
            return pd.Series(list(each(a, b)), dtype=object)

        return run
    raise ValueError(kind)


def _point(v: Column):
    """Coordinates of a two-dimensional POINT, without Python."""
    rx = r"^(?:<[^>]*> *)?POINT *\( *([-+0-9.eE]+) +([-+0-9.eE]+) *\)$"
    return F.regexp_extract(v, rx, 1).try_cast("double"), F.regexp_extract(v, rx, 2).try_cast("double")


def _wkt(v: Val) -> Column:
    return lexical(v)


def _shape(col: Column) -> Val:
    return Val("any", term_col(LITERAL, col, WKT))


def call(name: str, args: list[Val]) -> Val:
    none = F.lit("\0")
    if not args:
        return lit(F.lit(None).cast("double"), "double")
    a = _wkt(args[0])
    b = _wkt(args[1]) if len(args) > 1 else none
    if name == "distance":
        (x, y), (u, v) = _point(a), _point(b)
        native = F.sqrt(F.pow(x - u, F.lit(2)) + F.pow(y - v, F.lit(2)))
        return lit(F.when(native.isNotNull(), native).otherwise(_udf(distance, "double")(a, b)), "double")
    if name in PREDICATES:
        return lit(_udf(PREDICATES[name], "boolean")(a, b), "boolean")
    if name == "relate":
        m = _udf(relate, "string")(a, b)
        if len(args) > 2:
            pattern = F.replace(F.replace(lexical(args[2]), F.lit("T"), F.lit("[012]")), F.lit("*"), F.lit("."))
            return lit(F.rlike(m, pattern), "boolean")
        return lit(m, "string")
    if name in NUMBERS:
        return lit(_udf(lambda g: float(NUMBERS[name](g)), "double")(a, none), "double")
    if name in INTEGERS:
        return lit(_udf(INTEGERS[name], "bigint")(a, none), "integer")
    if name in TESTS:
        return lit(_udf(TESTS[name], "boolean")(a, none), "boolean")
    if name == "geometryType":
        return lit(_udf(lambda g: "http://www.opengis.net/ont/sf#" + g[0], "string")(a, none), "string")
    if name in SHAPES:
        return _shape(_udf(lambda g: to_wkt(SHAPES[name](g)), "string")(a, none))
    if name in PAIRS:
        return _shape(_udf(lambda g, h: to_wkt(PAIRS[name](g, h)), "string")(a, b))
    if name in ("buffer", "geometryN"):
        n = number(args[1]).cast("string")
        f = (lambda x, d: to_wkt(buffer(x, d))) if name == "buffer" else (lambda x, i: to_wkt(members(x)[int(i) - 1]))

        @F.pandas_udf("string")
        def run(s: pd.Series, k: pd.Series) -> pd.Series:
            return pd.Series([f(g, float(y)) if y is not None and (g := parse_wkt(x)) and (name == "buffer" or 1 <= float(y) <= len(members(g))) else None for x, y in zip(s, k, strict=True)], dtype=object)

        return _shape(run(a, n))
    if name == "asGeoJSON":
        return lit(_udf(to_geojson, "string")(a, none), "string")
    return lit(F.lit(None).cast("double"), "double")
