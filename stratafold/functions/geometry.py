"""Orientation and vector algebra as column expressions (angles in degrees, vectors as three columns)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = tuple[Column, Column, Column]


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def vector(x, y, z) -> Vector:
    return col(x), col(y), col(z)


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vector, b: Vector) -> Vector:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def plus(a: Vector, b: Vector) -> Vector:
    return a[0] + b[0], a[1] + b[1], a[2] + b[2]


def minus(a: Vector, b: Vector) -> Vector:
    return a[0] - b[0], a[1] - b[1], a[2] - b[2]


def scaled(a: Vector, s) -> Vector:
    return a[0] * s, a[1] * s, a[2] * s


def length(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def normalized(a: Vector) -> Vector:
    """NULL for a vector of no length."""
    n = length(a)
    return tuple(F.when(n > 1e-12, x / n) for x in a)


def distance(a: Vector, b: Vector) -> Column:
    return length(minus(a, b))


def midpoint(a: Vector, b: Vector) -> Vector:
    return scaled(plus(a, b), F.lit(0.5))


def acute_angle(a: Vector, b: Vector) -> Column:
    """Acute angle between two lines in degrees."""
    return F.degrees(F.acos(F.least(F.lit(1.0), F.abs(dot(a, b)) / (length(a) * length(b)))))


def is_parallel(a: Vector, b: Vector, tolerance: float = 1e-10) -> Column:
    return F.abs(F.abs(dot(a, b)) / (length(a) * length(b)) - 1) < tolerance


def is_orthogonal(a: Vector, b: Vector, tolerance: float = 1e-10) -> Column:
    return F.abs(dot(a, b)) / (length(a) * length(b)) < tolerance


def onto_line(point: Vector, on_line: Vector, direction: Vector) -> Vector:
    d = normalized(direction)
    return plus(on_line, scaled(d, dot(minus(point, on_line), d)))


def onto_plane(point: Vector, on_plane: Vector, normal: Vector) -> Vector:
    n = normalized(normal)
    return minus(point, scaled(n, dot(minus(point, on_plane), n)))


def plane_through(a: Vector, b: Vector, c: Vector) -> Vector:
    """Unit normal of the plane through three points; NULL if they lie on a line."""
    return normalized(cross(minus(b, a), minus(c, a)))


def polygon_area(points: Column) -> Column:
    """Area of a plane polygon given as an array of structs x, y, z (Newell)."""
    following = F.concat(F.slice(points, 2, F.size(points) - 1), F.slice(points, 1, 1))
    pair = F.arrays_zip(points.alias("a"), following.alias("b"))
    zero = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))

    def add(t, p):
        a, b = vector(p["a"]["x"], p["a"]["y"], p["a"]["z"]), vector(p["b"]["x"], p["b"]["y"], p["b"]["z"])
        c = cross(a, b)
        return F.struct((t["x"] + c[0]).alias("x"), (t["y"] + c[1]).alias("y"), (t["z"] + c[2]).alias("z"))

    return F.aggregate(pair, zero, add, lambda t: F.lit(0.5) * F.sqrt(t["x"] * t["x"] + t["y"] * t["y"] + t["z"] * t["z"]))


def plane_normal(dip_direction, dip) -> Vector:
    """Upper-hemisphere unit normal of a plane; NULL where the dip direction is NULL."""
    a, b = F.radians(col(dip_direction)), F.radians(col(dip))
    return upper((-F.sin(a) * F.sin(b), -F.cos(a) * F.sin(b), F.cos(b)))


def upper(n: Vector) -> Vector:
    down = n[2] < 0
    return tuple(F.when(down, -x).otherwise(x) for x in n)


def pole(n: Vector) -> Vector:
    """The lower-hemisphere end of a normal."""
    up = n[2] > 0
    return tuple(F.when(up, -x).otherwise(x) for x in n)


def orientation(n: Vector) -> tuple[Column, Column]:
    """Dip direction in [0, 360) and dip of a normal; a horizontal plane has direction 0."""
    u = upper(normalized(n))
    z = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), u[2]))
    flat = F.sin(F.acos(z)) <= 1e-12
    direction = F.degrees(F.atan2(-u[0], -u[1]))
    direction = F.when(direction < 0, direction + 360.0).otherwise(direction)
    return F.when(flat, F.lit(0.0)).otherwise(direction), F.when(flat, F.lit(0.0)).otherwise(F.degrees(F.acos(z)))


def hole_direction(azimuth, dip) -> Vector:
    """Unit direction along a hole; a dip of -90 points down."""
    a, d = F.radians(col(azimuth)), F.radians(col(dip))
    return F.sin(a) * F.cos(d), F.cos(a) * F.cos(d), F.sin(d)


def strike(dip_direction, right_hand: bool = True) -> Column:
    return F.pmod(col(dip_direction) + F.lit(-90.0 if right_hand else 90.0), F.lit(360.0))


def normal_of_strike(strike_, dip, right_hand: bool = True) -> Vector:
    return plane_normal(F.pmod(col(strike_) + F.lit(90.0 if right_hand else -90.0), F.lit(360.0)), dip)


def rotated(v: Vector, axis: str, angle) -> Vector:
    """`v` turned by `angle` degrees about an axis, right-handed."""
    c, s = F.cos(F.radians(col(angle))), F.sin(F.radians(col(angle)))
    x, y, z = v
    return {"x": (x, c * y - s * z, s * y + c * z), "y": (c * x + s * z, y, c * z - s * x), "z": (c * x - s * y, s * x + c * y, z)}[axis]


def basis(n: Vector) -> tuple[Vector, Vector]:
    """Two unit vectors in the plane with normal n, from the axis least aligned with it."""
    ax, ay, az = (F.abs(x) for x in n)
    first = (ax <= ay) & (ax <= az)
    second = ~first & (ay <= az)
    axis = tuple(F.when(c, 1.0).otherwise(0.0) for c in (first, second, ~first & ~second))
    u = normalized(cross(axis, n))
    return u, cross(n, u)


def with_basis(frame, n: Vector, prefix: str = "basis_"):
    """`frame` with the basis of a plane as columns, worked out in steps so that no expression is repeated."""
    frame = frame.withColumns({f"{prefix}n{k}": c for k, c in zip("xyz", n, strict=True)})
    n = vector(*[f"{prefix}n{k}" for k in "xyz"])
    ax, ay, az = (F.abs(x) for x in n)
    frame = frame.withColumn(f"{prefix}axis", F.when((ax <= ay) & (ax <= az), 0).when(ay <= az, 1).otherwise(2))
    axis = tuple(F.when(F.col(f"{prefix}axis") == i, 1.0).otherwise(0.0) for i in range(3))
    frame = frame.withColumns({f"{prefix}u{k}": c for k, c in zip("xyz", cross(axis, n), strict=True)})
    u = vector(*[f"{prefix}u{k}" for k in "xyz"])
    frame = frame.withColumn(f"{prefix}size", length(u))
    frame = frame.withColumns({f"{prefix}u{k}": F.col(f"{prefix}u{k}") / F.col(f"{prefix}size") for k in "xyz"})
    return frame.withColumns({f"{prefix}v{k}": c for k, c in zip("xyz", cross(n, u), strict=True)}).drop(f"{prefix}axis", f"{prefix}size")


def disc_polygon(center: Vector, radius, sides: int = 32, prefix: str = "basis_") -> Column:
    """The corners of a regular polygon on a disc's rim, as an array of structs x, y, z; the frame has the columns of `with_basis`."""
    u, v = (vector(*[f"{prefix}{a}{k}" for k in "xyz"]) for a in "uv")

    def corner(k):
        t = k * F.lit(2 * 3.141592653589793 / sides)
        p = plus(center, plus(scaled(u, F.cos(t) * col(radius)), scaled(v, F.sin(t) * col(radius))))
        return F.struct(*(x.alias(name) for x, name in zip(p, "xyz", strict=True)))

    return F.transform(F.sequence(F.lit(0), F.lit(sides - 1)), corner)


def disc_reach(n: Vector, radius) -> Vector:
    """Half extents of a disc's bounding box: r * sqrt(1 - n_i^2)."""
    return tuple(col(radius) * F.sqrt(F.greatest(F.lit(0.0), F.lit(1.0) - x * x)) for x in n)


def spread_angle(kappa) -> Column:
    """Angular standard deviation in degrees of a concentration."""
    k = col(kappa)
    return F.when(k > 5, F.lit(81.0) / F.sqrt(k)).when(k > 0, F.lit(180.0) / F.sqrt(k))


def shear_strength(friction_angle, jrc, jcs, normal_stress) -> Column:
    """Barton-Bandis shear strength."""
    s = col(normal_stress)
    return s * F.tan(F.radians(col(friction_angle) + col(jrc) * F.log10(col(jcs) / s)))


def cell_index(x, origin, spacing, number) -> Column:
    """Index of the cell that holds x, NULL outside; the outer bound belongs to the last cell."""
    i = F.floor((col(x) - origin) / spacing).cast("int")
    last = F.abs(col(x) - (F.lit(float(origin)) + F.lit(float(spacing)) * number)) < 1e-9
    return F.when(last, F.lit(number - 1)).when((i >= 0) & (i < number), i)


def semivariance(h, model: str, nugget: float, sill: float, reach: float) -> Column:
    """Spherical, exponential or gaussian semivariogram; 0 at distance 0. `sill` is the total sill."""
    x = col(h) / F.lit(float(reach))
    shape = {"spherical": F.when(x >= 1, 1.0).otherwise(1.5 * x - 0.5 * x * x * x), "exponential": 1 - F.exp(-3 * x), "gaussian": 1 - F.exp(-3 * x * x)}[model]
    return F.when(col(h) <= 0, 0.0).otherwise(F.lit(float(nugget)) + F.lit(float(sill - nugget)) * shape)


def inside_box(point: Vector, low, high, tolerance: float = 1e-10) -> Column:
    out = F.lit(True)
    for p, a, b in zip(point, low, high, strict=True):
        out = out & (p >= F.lit(float(a)) - tolerance) & (p <= F.lit(float(b)) + tolerance)
    return out


def inside_polygon(x, y, corners: list[tuple[float, float]]) -> Column:
    """Even-odd rule against a fixed polygon."""
    out = F.lit(False)
    for (x1, y1), (x2, y2) in zip(corners, corners[1:] + corners[:1], strict=True):
        if y1 == y2:
            continue
        crosses = ((F.lit(float(y1)) > col(y)) != (F.lit(float(y2)) > col(y))) & (col(x) < F.lit(float(x2 - x1)) * (col(y) - y1) / F.lit(float(y2 - y1)) + x1)
        out = out != crosses
    return out


def uniform(*keys) -> Column:
    """A number in [0, 1) that depends on the keys only, not on partitions."""
    return (F.xxhash64(*[col(k) if not isinstance(k, (int, float)) else F.lit(k) for k in keys]).bitwiseAND(F.lit((1 << 53) - 1))).cast("double") / F.lit(float(1 << 53))
