"""Special functions and small fits in NumPy: normal, chi-square with even degrees, size laws, exposure, disc areas."""

from __future__ import annotations

import math

import numpy as np

_erf = np.vectorize(math.erf, otypes=[float])


def normal_cdf(x):
    return 0.5 * (1 + _erf(np.asarray(x, float) / math.sqrt(2)))


def _bisect(f, low: float, high: float, steps: int = 200) -> float:
    """Root of an increasing function."""
    for _ in range(steps):
        middle = 0.5 * (low + high)
        if f(middle) < 0:
            low = middle
        else:
            high = middle
        if high - low <= 1e-15 * max(1.0, abs(high)):
            break
    return 0.5 * (low + high)


def normal_quantile(p: float) -> float:
    return _bisect(lambda x: float(normal_cdf(x)) - p, -40.0, 40.0)


def chi2_quantile_even(p: float, half: int) -> float:
    """Quantile of chi-square with 2 * half degrees of freedom: its tail is a Poisson sum."""
    if half <= 0:
        return 0.0

    def cdf(x: float) -> float:
        y, total = x / 2, -math.inf
        for k in range(half):
            total = np.logaddexp(total, k * math.log(y) - math.lgamma(k + 1)) if y > 0 else (0.0 if k == 0 else total)
        return 1 - math.exp(min(0.0, total - y))

    if half > 400:  # Wilson-Hilferty, good to 1e-6 there
        n, z = 2.0 * half, normal_quantile(p)
        return n * (1 - 2 / (9 * n) + z * math.sqrt(2 / (9 * n))) ** 3
    high = 2.0 * half + 20 * math.sqrt(2.0 * half) + 60
    return _bisect(lambda x: cdf(x) - p, 0.0, high)


def poisson_interval(count: int, exposure: float) -> tuple[float, float]:
    """95 % interval of a Poisson rate."""
    low = 0.5 * chi2_quantile_even(0.025, count) / exposure if count else 0.0
    return low, 0.5 * chi2_quantile_even(0.975, count + 1) / exposure


_nodes, _weights = np.polynomial.legendre.leggauss(400)


def exposure(kappa: float, cosine) -> np.ndarray:
    """E|n . u| for normals n with concentration kappa about a mean at an angle of the given cosine to u.

    By quadrature over the polar angle t about the mean; the mean over the azimuth of |a + b cos f| is closed.
    """
    c = np.clip(np.abs(np.atleast_1d(np.asarray(cosine, float))), 0, 1)
    s = np.sqrt(1 - c * c)
    low = max(-1.0, 1 - 60 / max(kappa, 1e-9))  # beyond, the density is nothing
    w = 0.5 * (1 - low) * _nodes + 0.5 * (1 + low)
    if kappa < 1e-9:
        density = np.full_like(w, 0.5)
    else:
        density = kappa * np.exp(kappa * (w - 1)) / (1 - math.exp(-2 * kappa))
    density = density * _weights * 0.5 * (1 - low)
    density /= density.sum()
    a, b = c[:, None] * w[None, :], s[:, None] * np.sqrt(np.maximum(1 - w * w, 0))[None, :]
    b = np.maximum(b, 1e-300)
    ratio = np.clip(a / b, -1, 1)
    inside = (2 / np.pi) * (a * np.arcsin(ratio) + np.sqrt(np.maximum(b * b - np.minimum(a * a, b * b), 0)))
    return np.where(np.abs(a) >= b, np.abs(a), inside) @ density


def size_moment(law: str, low: float, high: float, order: int, **p: float) -> float:
    """E[R^order] of a size law truncated to [low, high]: constant, uniform, power (density r^-(a+1)), lognormal, exponential."""
    if law == "constant" or high - low < 1e-15:
        return p.get("radius", low) ** order
    if law == "uniform":
        return (high ** (order + 1) - low ** (order + 1)) / ((order + 1) * (high - low))
    if law == "power":
        a = p["exponent"]

        def area(k: float) -> float:
            e = k - a
            return math.log(high / low) if abs(e) < 1e-12 else (high**e - low**e) / e

        return area(order) / area(0)
    if law == "lognormal":
        m, s = p["mu"], p["sigma"]
        span = lambda shift: float(normal_cdf((math.log(high) - m) / s - shift) - normal_cdf((math.log(low) - m) / s - shift))
        return math.exp(order * m + 0.5 * order * order * s * s) * span(order * s) / span(0.0)
    if law == "exponential":
        rate = p["rate"]

        def part(k: int) -> float:
            """Integral of r^k exp(-rate (r - low)) over the range."""
            fall = math.exp(-rate * (high - low))
            value = (1 - fall) / rate
            for j in range(1, k + 1):
                value = (low**j - high**j * fall) / rate + j * value / rate
            return value

        return part(order) / part(0)
    raise ValueError(f"unknown size law {law!r}")


def area_share(law: str, low: float, high: float, radius: float, **p: float) -> float:
    """Share of the total disc area in discs up to `radius`."""
    radius = min(max(radius, low), high)
    if law == "uniform":
        return (radius**3 - low**3) / (high**3 - low**3)
    if law == "power":
        e = 2 - p["exponent"]
        return math.log(radius / low) / math.log(high / low) if abs(e) < 1e-12 else (radius**e - low**e) / (high**e - low**e)
    x, w = np.polynomial.legendre.leggauss(200)

    def integral(a: float, b: float) -> float:
        r = 0.5 * (b - a) * x + 0.5 * (a + b)
        f = np.exp(-p["rate"] * (r - low)) if law == "exponential" else np.exp(-0.5 * ((np.log(r) - p["mu"]) / p["sigma"]) ** 2) / r
        return float((r * r * f * w).sum() * 0.5 * (b - a))

    return integral(low, radius) / integral(low, high)


def class_thresholds(law: str, low: float, high: float, small: float = 0.1, medium: float = 0.7, **p: float) -> tuple[float, float]:
    """Radii below which `small` and `medium` of the area lie."""
    return tuple(_bisect(lambda r, s=s: area_share(law, low, high, r, **p) - s, low, high) for s in (small, medium))


def sample_radius(law: str, low: float, high: float, u: np.ndarray, **p: float) -> np.ndarray:
    """Radii by inverse distribution function of uniforms."""
    u = np.asarray(u, float)
    if law == "constant":
        return np.full_like(u, p.get("radius", low))
    if law == "uniform":
        return low + u * (high - low)
    if law == "power":
        a = p["exponent"]
        return low * (high / low) ** u if abs(a) < 1e-12 else (low**-a - u * (low**-a - high**-a)) ** (-1 / a)
    if law == "exponential":
        return low - np.log1p(-u * (1 - math.exp(-p["rate"] * (high - low)))) / p["rate"]
    if law == "lognormal":
        a, b = (float(normal_cdf((math.log(x) - p["mu"]) / p["sigma"])) for x in (low, high))
        return np.array([math.exp(p["mu"] + p["sigma"] * normal_quantile(a + q * (b - a))) for q in u])
    raise ValueError(f"unknown size law {law!r}")


def fit_sizes(n: int, total: float, logs: float, logs2: float, low: float, high: float) -> list[dict]:
    """Likelihood fits of four laws from sufficient statistics: rows law, parameters, log_likelihood, aic, bic, least AIC first.

    `logs` and `logs2` are the sums of ln r and (ln r)^2.
    """
    out = []

    def add(law: str, k: int, likelihood: float, **p: float) -> None:
        if math.isfinite(likelihood):
            out.append({"law": law, "parameters": p, "log_likelihood": likelihood, "aic": 2 * k - 2 * likelihood, "bic": k * math.log(max(n, 1)) - 2 * likelihood})

    if n < 2 or high <= low:
        return out
    add("uniform", 2, -n * math.log(high - low))
    mu = logs / n
    sigma = math.sqrt(max(logs2 / n - mu * mu, 1e-18))
    z = float(normal_cdf((math.log(high) - mu) / sigma) - normal_cdf((math.log(low) - mu) / sigma))
    if z > 0:
        add("lognormal", 2, -n * math.log(z * sigma * math.sqrt(2 * math.pi)) - logs - 0.5 * n, mu=mu, sigma=sigma)

    def golden(f, a: float, b: float) -> float:
        g = (math.sqrt(5) - 1) / 2
        c, d = b - g * (b - a), a + g * (b - a)
        for _ in range(120):
            if f(c) > f(d):
                b, d = d, c
                c = b - g * (b - a)
            else:
                a, c = c, d
                d = a + g * (b - a)
        return 0.5 * (a + b)

    def power(a: float) -> float:
        area = math.log(high / low) if abs(a) < 1e-9 else (low**-a - high**-a) / a
        return -(a + 1) * logs - n * math.log(area)

    def exponential(x: float) -> float:
        rate = math.exp(x)
        return n * x - rate * (total - n * low) - n * math.log(-math.expm1(-rate * (high - low)))

    a = golden(power, 1e-6, 20.0)
    add("power", 1, power(a), exponent=a)
    x = golden(exponential, -20.0, 10.0)
    add("exponential", 1, exponential(x), rate=math.exp(x))
    return sorted(out, key=lambda r: r["aic"])


def disc_box_areas(center: np.ndarray, normal: np.ndarray, radius: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Exact areas of discs (a row each) inside closed boxes.

    In a disc's plane a box is six half-planes t_k . p <= d_k with unit t_k, p taken from the disc's centre. By Green's
    theorem the area of the disc's part in them is half the sum of d_k times the length of line k's piece in the disc and
    in the other half-planes, and half the squared radius times the angle of the circle's part in all of them. No polygon is made.
    """
    m, r = len(center), np.asarray(radius, float)[:, None]
    w = np.sqrt(np.maximum(0.0, 1 - normal * normal))
    steep = w > 1e-12  # else the disc is parallel to that pair of faces
    tolerance = 1e-12 * np.maximum(1.0, r)
    gap = np.stack([high - center, center - low], 1)  # (m, 2, 3)
    empty = (~steep[:, None] & (gap < -tolerance[:, None])).any((1, 2))
    inverse = np.where(steep, 1 / np.where(steep, w, 1.0), 0.0)
    d = np.where(steep[:, None], gap * inverse[:, None], np.inf).reshape(m, 6)
    idle = d >= r
    empty |= (d <= -r).any(1)
    d = np.where(idle, r, d)
    helper = np.eye(3)[np.argmin(np.abs(normal), 1)]
    u = np.cross(helper, normal)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    v = np.cross(normal, u)
    t = np.stack([u, v], 2) * inverse[..., None]  # (m, 3, 2): unit in-plane directions of the axes
    t = np.concatenate([t, -t], 1)

    # pieces of the lines
    first, last = (sign * np.sqrt(np.maximum(0.0, r * r - d * d)) for sign in (-1.0, 1.0))
    kept = ~idle
    for k in range(6):
        for j in range(6):
            if j == k:
                continue
            along = t[:, j, 1] * t[:, k, 0] - t[:, j, 0] * t[:, k, 1]
            across = (t[:, j] * t[:, k]).sum(1)
            room = d[:, j] - d[:, k] * across
            cuts, crossing = ~idle[:, j], np.abs(along) > 1e-12
            at = room / np.where(crossing, along, 1.0)
            last[:, k] = np.where(cuts & crossing & (along > 0), np.minimum(last[:, k], at), last[:, k])
            first[:, k] = np.where(cuts & crossing & (along < 0), np.maximum(first[:, k], at), first[:, k])
            outside = room < -tolerance[:, 0]
            twice = (j < k) & (across > 0) & (np.abs(room) <= tolerance[:, 0])  # the same line counts once
            kept[:, k] &= ~(cuts & ~crossing & (outside | twice))
    straight = (np.where(kept, np.maximum(0.0, last - first), 0.0) * d).sum(1)

    # the part of the circle: spans between the lines' crossings whose middle lies in all half-planes
    turn, half = np.arctan2(t[..., 1], t[..., 0]), np.arccos(np.clip(d / r, -1.0, 1.0))
    marks = np.sort(np.mod(np.concatenate([turn - half, turn + half], 1), 2 * math.pi), 1)
    spans = np.diff(marks, axis=1, append=marks[:, :1] + 2 * math.pi)
    middle = marks + spans / 2
    inside = np.ones_like(middle, bool)
    for k in range(6):
        inside &= idle[:, k, None] | (r * np.cos(middle - turn[:, k, None]) <= d[:, k, None])
    angle = np.where(inside, spans, 0.0).sum(1)
    area = 0.5 * straight + 0.5 * r[:, 0] ** 2 * angle
    return np.where(empty, 0.0, np.clip(area, 0.0, math.pi * r[:, 0] ** 2))
