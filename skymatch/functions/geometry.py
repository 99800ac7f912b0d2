"""Sky, camera and rotation geometry as column expressions.

Angles are radians and rotations are nine columns r00..r22, row by row, unless
said otherwise. Everything stays in whole-stage code generation.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]


def num(x: Column | float | str) -> Column:
    """A column as DOUBLE: plain names are columns, numbers are literals."""
    return (F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))).cast("double")


def vec(prefix: str = "") -> Vec:
    return F.col(f"{prefix}x"), F.col(f"{prefix}y"), F.col(f"{prefix}z")


def unit_vector(ra, dec) -> Vec:
    ra, dec = num(ra), num(dec)
    return F.cos(ra) * F.cos(dec), F.sin(ra) * F.cos(dec), F.sin(dec)


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vec, b: Vec) -> Vec:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def normalize(a: Vec, eps: float = 1e-12) -> Vec:
    """Unit vector; null where the length is below ``eps``, for a table has no place to raise."""
    n = F.when(norm(a) >= eps, norm(a))
    return a[0] / n, a[1] / n, a[2] / n


def hat(a: Vec) -> list[Column]:
    """The skew matrix of the cross product, row by row."""
    zero = F.lit(0.0)
    return [zero, -a[2], a[1], a[2], zero, -a[0], -a[1], a[0], zero]


def unhat(m: list[Column]) -> Vec:
    return (m[7] - m[5]) / 2, (m[2] - m[6]) / 2, (m[3] - m[1]) / 2


def chord(a: Vec, b: Vec) -> Column:
    return norm((a[0] - b[0], a[1] - b[1], a[2] - b[2]))


def chord_angle(c: Column) -> Column:
    """Angle of a chord of the unit sphere; clamped, for rounding can pass 2."""
    return 2 * F.asin(F.least(c / 2, F.lit(1.0)))


def clamp_dot(d: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), d))


def great_circle(ra1, dec1, ra2, dec2) -> Column:
    ra1, dec1, ra2, dec2 = map(num, (ra1, dec1, ra2, dec2))
    a, b = F.sin((dec2 - dec1) / 2), F.sin((ra2 - ra1) / 2)
    h = a * a + F.cos(dec1) * F.cos(dec2) * (b * b)
    return 2 * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def in_range(angle: Column, low: float, high: float) -> Column:
    """Strictly inside (low, high), or around the turn if low >= high."""
    return (angle > low) & (angle < high) if low < high else (angle > low) | (angle < high)


def proper_motion(ra: Column, dec: Column, pm_ra: Column, pm_dec: Column, years) -> tuple[Column, Column]:
    """Position after ``years`` of motion in mas a year (pm_ra times cos dec); none so near the pole that cos dec <= 0.1."""
    moves = F.cos(dec) > 0.1
    scale = math.pi / 180 / 3.6e6
    return ra + F.when(moves, pm_ra / F.cos(dec) * scale * num(years)).otherwise(0.0), dec + F.when(moves, pm_dec * scale * num(years)).otherwise(0.0)


def pixel_vector(x, y, width, height, fov) -> Vec:
    """Solver frame: first component along the boresight, offsets from centre minus pixel."""
    x, y, width, height = map(num, (x, y, width, height))
    s = 2 * F.tan(num(fov) / 2) / width
    v = F.lit(1.0), (width / 2 - x) * s, (height / 2 - y) * s
    n = norm(v)
    return v[0] / n, v[1] / n, v[2] / n


def vector_pixel(v: Vec, width, height, fov) -> tuple[Column, Column]:
    """Pixel (x, y) of a solver-frame vector; null at a right angle to the boresight. Callers keep to the hemisphere ahead."""
    width, height = num(width), num(height)
    s = width / 2 / F.tan(num(fov) / 2)
    ahead = F.when(v[0] != 0, v[0])
    return width / 2 - s * v[1] / ahead, height / 2 - s * v[2] / ahead


def in_frame(x: Column, y: Column, width, height) -> Column:
    return (x > 0) & (x < num(width)) & (y > 0) & (y < num(height))


def undistort(x, y, width, height, k) -> tuple[Column, Column]:
    """Radial correction (1 - k r^2) / (1 - k), r from the centre in half widths. A null k is none."""
    x, y, width, height = map(num, (x, y, width, height))
    k = F.coalesce(num(k), F.lit(0.0))
    dx, dy = x - width / 2, y - height / 2
    r = F.hypot(dx, dy) / (width / 2)
    scale = (1 - k * r * r) / (1 - k)
    return dx * scale + width / 2, dy * scale + height / 2


def distort(x, y, width, height, k, steps: int = 12) -> tuple[Column, Column]:
    """Inverse of `undistort` by Newton steps on the radius, each point on its own; the centre stays."""
    x, y, width, height = map(num, (x, y, width, height))
    k = F.coalesce(num(k), F.lit(0.0))
    dx, dy = x - width / 2, y - height / 2
    goal = F.hypot(dx, dy) / (width / 2)
    state = F.struct(goal.alias("goal"), k.alias("k"), goal.alias("r"))

    def newton(s, _):
        r, kk = s["r"], s["k"]
        error = r * (1 - kk * r * r) / (1 - kk) - s["goal"]
        return F.struct(s["goal"].alias("goal"), kk.alias("k"), (r - error / ((1 - 3 * kk * r * r) / (1 - kk))).alias("r"))

    r = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), state, newton)["r"]
    scale = F.when(goal > 0, r / goal).otherwise(1.0)
    return dx * scale + width / 2, dy * scale + height / 2


def camera_angles(x, y, x_fov, width, height) -> tuple[Column, Column]:
    """(ra, dec) of a pixel relative to the boresight; the vertical field is the horizontal one times height / width."""
    x, y, x_fov, width, height = map(num, (x, y, x_fov, width, height))
    across = F.atan((width / 2 - x) / (width / 2 / F.tan(x_fov / 2)))
    along = F.atan((height / 2 - y) / (height / 2 / F.tan(x_fov * height / width / 2)))
    return across, along


def u_body(x, y, cx=320.0, cy=240.0, f=500.0) -> Vec:
    """Detector frame: third component along the boresight, offsets from pixel minus principal point."""
    v = (num(x) - num(cx)) / num(f), (num(y) - num(cy)) / num(f), F.lit(1.0)
    n = norm(v)
    return v[0] / n, v[1] / n, v[2] / n


def rotation(ra, dec, roll) -> list[Column]:
    """Rotation with rows boresight, horizontal and vertical axis, whose angles `attitude_angles` gives back."""
    ra, dec, roll = map(num, (ra, dec, roll))
    b = unit_vector(ra, dec)
    east = -F.sin(ra), F.cos(ra), F.lit(0.0)
    north = cross(b, east)
    h = [F.sin(roll) * n + F.cos(roll) * e for n, e in zip(north, east, strict=True)]
    v = [F.cos(roll) * n - F.sin(roll) * e for n, e in zip(north, east, strict=True)]
    return [*b, *h, *v]


def attitude_angles(r: list[Column]) -> tuple[Column, Column, Column]:
    """RA, declination and roll in degrees from a rotation; RA and roll in [0, 360)."""
    turn = lambda a: F.pmod(F.degrees(a), F.lit(360.0))
    return turn(F.atan2(r[1], r[0])), F.degrees(F.atan2(r[2], F.hypot(r[5], r[8]))), turn(F.atan2(r[5], r[8]))


def rotate(r: list[Column], v: Vec) -> Vec:
    return tuple(r[3 * i] * v[0] + r[3 * i + 1] * v[1] + r[3 * i + 2] * v[2] for i in range(3))


def rotate_back(r: list[Column], v: Vec) -> Vec:
    return tuple(r[i] * v[0] + r[3 + i] * v[1] + r[6 + i] * v[2] for i in range(3))


def quaternion(r: list[Column]) -> list[Column]:
    """(w, x, y, z) with w >= 0 of a rotation matrix, by its largest diagonal term; identity for a null matrix."""
    trace = r[0] + r[4] + r[8]
    root = lambda t: F.sqrt(F.greatest(t, F.lit(0.0))) * 2
    s0, s1, s2, s3 = root(1 + trace), root(1 + r[0] - r[4] - r[8]), root(1 + r[4] - r[0] - r[8]), root(1 + r[8] - r[0] - r[4])
    first, second, third = trace > 0, (r[0] > r[4]) & (r[0] > r[8]), r[4] > r[8]
    pick = lambda a, b, c, d: F.when(first, a).when(second, b).when(third, c).otherwise(d)
    q = [
        pick(s0 / 4, (r[7] - r[5]) / s1, (r[2] - r[6]) / s2, (r[3] - r[1]) / s3),
        pick((r[7] - r[5]) / s0, s1 / 4, (r[1] + r[3]) / s2, (r[2] + r[6]) / s3),
        pick((r[2] - r[6]) / s0, (r[1] + r[3]) / s1, s2 / 4, (r[5] + r[7]) / s3),
        pick((r[3] - r[1]) / s0, (r[2] + r[6]) / s1, (r[5] + r[7]) / s2, s3 / 4),
    ]
    n = F.sqrt(sum(c * c for c in q))
    sign = F.when(q[0] < 0, -1.0).otherwise(1.0)
    unit = [F.when(n > 1e-12, c / n * sign).otherwise(1.0 if i == 0 else 0.0) for i, c in enumerate(q)]
    return [F.coalesce(c, F.lit(1.0 if i == 0 else 0.0)) for i, c in enumerate(unit)]


def triad(b1: Vec, b2: Vec, n1: Vec, n2: Vec, eps: float = 1e-12) -> list[Column]:
    """Rotation from body to inertial frame from two pairs of directions; null if a pair is collinear."""

    def basis(v1: Vec, v2: Vec) -> tuple[Vec, Vec, Vec]:
        t1 = normalize(v1, eps)
        t2 = normalize(cross(v1, v2), eps)
        return t1, t2, cross(t1, t2)

    body, sky = basis(b1, b2), basis(n1, n2)
    return [sum(sky[k][i] * body[k][j] for k in range(3)) for i in range(3) for j in range(3)]


def edge_angles(vectors: list[Vec]) -> Column:
    """The six angles between four directions, in ascending order, as an array."""
    pairs = [(i, j) for i in range(len(vectors)) for j in range(i + 1, len(vectors))]
    return F.sort_array(F.array(*[chord_angle(chord(vectors[i], vectors[j])) for i, j in pairs]))


def edge_ratios(edges: Column, smaller: int = 5) -> Column:
    """The ``smaller`` edges over the largest, ascending. Written out by place: functions over arrays are not compiled."""
    return F.array(*[F.get(edges, k) / F.get(edges, smaller) for k in range(smaller)])


def pattern_code(ratios: Column, bins: int, digits: int = 5) -> Column:
    return F.array(*[F.floor(F.get(ratios, k) * bins).cast("int") for k in range(digits)])


def digits_key(code: Column, bins: int) -> Column:
    """A code as one number, its first ratio the lowest digit; a ratio of 1 has the digit ``bins``, so that no two codes share a number."""
    return F.aggregate(F.reverse(code), F.lit(0).cast("long"), lambda a, c: a * (bins + 1) + c)


def code_key(code: Column, bins: int) -> Column:
    """The code's digits to the base ``bins``, least first: equal for equal codes, and for unequal ones only where a digit is ``bins`` (a ratio of 1)."""
    return sum((F.get(code, k).cast("long") * bins**k for k in range(1, 5)), F.get(code, 0).cast("long"))


def table_index(key: Column, length: Column) -> Column:
    """Slot of a key in an open-addressed table: times 2654435761, modulo 2^64, modulo the length."""
    product = key.cast("decimal(20,0)") * F.lit(2654435761).cast("decimal(10,0)")
    return (product % F.expr("cast(18446744073709551616 as decimal(20,0))") % length.cast("decimal(20,0)")).cast("long")


def mismatch_probability(m: Column, n: Column, p: Column) -> Column:
    """Chance of at least m - 2 hits among n trials of chance p, summed from its positive terms; null for p > 1."""
    m2 = m - 2
    steps = F.when(n > 0, F.sequence(F.lit(1), n.cast("int"))).otherwise(F.array().cast("array<int>"))
    odds = p / (1 - p)
    start = F.struct(F.pow(1 - p, n).alias("term"), F.when(m2 <= 0, F.pow(1 - p, n)).otherwise(0.0).alias("sum"))

    def step(a, i):
        term = a["term"] * (n - i + 1) / i * odds
        return F.struct(term.alias("term"), (a["sum"] + F.when(i >= m2, term).otherwise(0.0)).alias("sum"))

    return F.when(m2 <= 0, F.lit(1.0)).when(p > 1, F.lit(None).cast("double")).when(p == 1, F.when(n >= m2, 1.0).otherwise(0.0)).otherwise(F.aggregate(steps, start, step)["sum"])


def pattern_fov(fov, cat_edge: Column, img_edge: Column) -> Column:
    """Field of view at which the image's largest edge is as wide as the catalogue's."""
    return cat_edge / img_edge * num(fov)


def diagonal_fov(fov, width, height) -> Column:
    return num(fov) * F.hypot(num(width), num(height)) / num(width)


def gray(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def distance_bin(d: Column, low, high, bins: int) -> Column:
    """Bin of a distance; the upper edge falls into the last bin."""
    return F.least(F.floor((d - num(low)) / ((num(high) - num(low)) / bins)), F.lit(bins - 1)).cast("int")


def fov_ladder(max_fov: float, min_fov: float, step: float = 1.5) -> list[float]:
    """Fields of view for multi-scale patterns, largest first; close limits need the largest alone."""
    ratio = max_fov / min_fov
    if ratio < math.sqrt(step):
        return [max_fov]
    n = math.ceil(math.log(ratio) / math.log(step)) + 1
    return [max_fov * (min_fov / max_fov) ** (i / (n - 1)) for i in range(n)]


def separation(fov: float, stars_per_fov: int) -> float:
    return 0.6 * fov / math.sqrt(stars_per_fov)
