"""Features of a mask's main contour: size, polygon, moments, radii, curvature, skeleton, holes, edges, spectrum. Numpy only."""

from __future__ import annotations

import math

import numpy as np

from . import raster

#: The five features that pieces are clustered by.
PIECE = ("circle_area_ratio", "hu_moment_1", "angles_min", "hu_moment_2", "curvature_max")
WHOLE = ("bbox_x", "bbox_y", "bbox_width", "bbox_height", "polygon_vertices", *(f"distance_hist_bin_{i}" for i in range(10)), "skeleton_length", "skeleton_endpoints", "skeleton_branches", "holes_count", "edges_pixel_count", "contour_fft_len", "contour_fft_dom_freq_idx")
ALL = (
    *("area", "perimeter", "bbox_x", "bbox_y", "bbox_width", "bbox_height", "bbox_area", "aspect_ratio", "extent", "solidity", "compactness", "circularity", "convex_area", "convexity", "min_rect_area_ratio"),
    *("circle_radius", "circle_area_ratio", "ellipse_center_x", "ellipse_center_y", "ellipse_major_axis", "ellipse_minor_axis", "ellipse_eccentricity", "ellipse_angle"),
    *("polygon_vertices", "sides_mean", "sides_std", "sides_min", "sides_max", "sides_ratio_max_min", "angles_mean", "angles_std", "angles_min", "angles_max", "angles_range"),
    *(f"hu_moment_{i}" for i in range(1, 8)),
    *("centroid_x", "centroid_y", "distance_mean", "distance_std", "distance_min", "distance_max", "distance_range", "distance_cv"), *(f"distance_hist_bin_{i}" for i in range(10)),
    *("curvature_mean", "curvature_std", "curvature_max", "curvature_sum"),
    *("skeleton_length", "skeleton_endpoints", "skeleton_branches", "skeleton_complexity"),
    *("holes_count", "holes_mean_area", "holes_max_area", "edges_pixel_count", "edges_density"),
    *("contour_fft_len", "contour_fft_dom_freq_idx", "contour_fft_dom_freq_mag", "contour_fft_highfreq_energy", "contour_fft_highfreq_ratio"),
)


def ratio(a: float, b: float) -> float:
    return float(a / b) if b > 0 else 0.0


def main_mask(gray: np.ndarray) -> np.ndarray | None:
    """The largest component of the lighter pixels, or of the others where the lighter ones are more than half."""
    light = gray > 127
    return raster.largest(~light if light.sum() > light.size // 2 else light)


def perimeter(points: np.ndarray) -> float:
    return float(np.hypot(*(np.roll(points, -1, 0) - points).T).sum()) if len(points) > 1 else 0.0


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull, counter-clockwise from the least point."""
    p = np.unique(points, axis=0).tolist()
    if len(p) < 3:
        return np.array(p, float)

    def chain(seq) -> list:
        out: list = []
        for q in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]):
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(chain(p) + chain(p[::-1]), float)


def enclosing_radius(corners: np.ndarray) -> float:
    """Radius of the least circle round the points, grown by the farthest point outside until none is left."""
    c = corners[:, 0] + 1j * corners[:, 1]

    def through(*p: complex) -> tuple[complex, float]:
        if len(p) == 1:
            return p[0], 0.0
        if len(p) == 2:
            return (p[0] + p[1]) / 2, abs(p[0] - p[1]) / 2
        u, v = p[1] - p[0], p[2] - p[0]
        det = 2 * (u.real * v.imag - u.imag * v.real)
        if abs(det) < 1e-12:
            return p[0], math.inf
        centre = p[0] + 1j * (abs(v) ** 2 * u - abs(u) ** 2 * v) / det
        return centre, abs(centre - p[0])

    basis = [c[0]]
    middle, radius = through(*basis)
    for _ in range(4 * len(c) + 8):
        far = np.abs(c - middle)
        k = int(np.argmax(far))
        if far[k] <= radius * (1 + 1e-9) + 1e-9:
            break
        options = [(c[k],)] + [(c[k], b) for b in basis] + [(c[k], a, b) for i, a in enumerate(basis) for b in basis[:i]]
        circles = [(through(*o), o) for o in options]
        fits = [(r, m, o) for (m, r), o in circles if all(abs(b - m) <= r * (1 + 1e-9) + 1e-9 for b in basis)]
        radius, middle, chosen = min(fits, key=lambda t: t[0])
        basis = list(chosen)
    return float(radius)


def least_rectangle(corners: np.ndarray) -> float:
    """Area of the least rectangle of any angle; one of its sides lies on the hull."""
    if len(corners) < 3:
        return 0.0
    side = np.roll(corners, -1, 0) - corners
    side /= np.hypot(*side.T)[:, None]
    along, across = corners @ side.T, corners @ np.stack((-side[:, 1], side[:, 0]))
    return float((np.ptp(along, axis=0) * np.ptp(across, axis=0)).min())


def ellipse(points: np.ndarray) -> tuple[float, ...]:
    """(centre x, y, shorter axis, longer axis, angle in degrees) of the conic of least algebraic error; zeros if it is no ellipse."""
    mean = points.mean(0)
    scale = max(float(np.abs(points - mean).max()), 1e-12)
    x, y = ((points - mean) / scale).T
    a, b, c, d, e = np.linalg.lstsq(np.stack((x * x, x * y, y * y, x, y), 1), np.ones(len(x)), rcond=None)[0]
    form = np.array([[a, b / 2], [b / 2, c]])
    if np.linalg.det(form) <= 1e-15:
        return (0.0,) * 5
    centre = np.linalg.solve(2 * form, [-d, -e])
    values, vectors = np.linalg.eigh(form)
    level = 1 + centre @ form @ centre
    if (level / values <= 0).any():
        return (0.0,) * 5
    axes = 2 * np.sqrt(level / values) * scale
    k = int(np.argmin(axes))
    angle = math.degrees(math.atan2(vectors[1, k], vectors[0, k])) % 180
    return (*(centre * scale + mean).tolist(), float(axes[k]), float(axes[1 - k]), angle)


def polygon(points: np.ndarray, tolerance: float) -> np.ndarray:
    """The closed contour with fewer points, none of those left out farther than the tolerance (Douglas-Peucker)."""
    n = len(points)
    if n < 3:
        return points
    p = points.astype(float)
    a = int(np.argmax(np.hypot(*(p - p[0]).T)))
    a = int(np.argmax(np.hypot(*(p - p[a]).T)))  # two ends that are far from each other
    p = np.roll(p, -a, 0)
    b = int(np.argmax(np.hypot(*(p - p[0]).T)))
    ring = np.concatenate((p, p[:1]))
    keep, todo = {0, b}, [(0, b), (b, n)]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < 2:
            continue
        step, off = ring[hi] - ring[lo], ring[lo + 1 : hi] - ring[lo]
        length = math.hypot(*step)
        d = np.abs(off[:, 0] * step[1] - off[:, 1] * step[0]) / length if length else np.hypot(*off.T)
        k = int(np.argmax(d))
        if d[k] > tolerance:
            keep.add(lo + 1 + k)
            todo += [(lo, lo + 1 + k), (lo + 1 + k, hi)]
    return p[sorted(keep)]


def corner_stats(points: np.ndarray) -> dict[str, float]:
    """Sides and inner angles of a polygon; zeros below three corners."""
    names = ("sides_mean", "sides_std", "sides_min", "sides_max", "sides_ratio_max_min", "angles_mean", "angles_std", "angles_min", "angles_max", "angles_range")
    if len(points) < 3:
        return {"polygon_vertices": len(points)} | dict.fromkeys(names, 0.0)
    back, on = np.roll(points, 1, 0) - points, np.roll(points, -1, 0) - points
    s, size = np.hypot(*on.T), np.hypot(*back.T) * np.hypot(*on.T)
    cosine = np.divide((back * on).sum(1), size, out=np.ones(len(s)), where=size > 0)
    t = np.degrees(np.arccos(cosine.clip(-1, 1)))
    values = (s.mean(), s.std(), s.min(), s.max(), ratio(s.max(), s.min()), t.mean(), t.std(), t.min(), t.max(), np.ptp(t))
    return {"polygon_vertices": len(points)} | {k: float(v) for k, v in zip(names, values, strict=True)}


def moments(points: np.ndarray) -> dict[tuple[int, int], float]:
    """Moments to the third order of a closed polygon's inside, by Green's theorem, about the mean of its points; (0, 0) is not negative."""
    mean = points.mean(0)
    (x, y), (u, v) = (points - mean).T, (np.roll(points, -1, 0) - mean).T
    turn = x * v - u * y
    out = {}
    for p in range(4):
        for q in range(4 - p):
            total = np.zeros(len(x))
            for i in range(p + 1):
                for j in range(q + 1):
                    total += math.comb(i + j, i) * math.comb(p + q - i - j, p - i) * u**i * x ** (p - i) * v**j * y ** (q - j)
            out[p, q] = float((turn * total).sum()) / ((p + q + 2) * (p + q + 1) * math.comb(p + q, p))
    return {k: -m for k, m in out.items()} if out[0, 0] < 0 else out


def hu_invariants(m: dict[tuple[int, int], float]) -> list[float]:
    """Hu's seven invariants from moments; zeros for an empty inside."""
    if m[0, 0] <= 0:
        return [0.0] * 7
    cx, cy = m[1, 0] / m[0, 0], m[0, 1] / m[0, 0]
    eta = {}
    for p, q in m:
        mu = sum(math.comb(p, i) * math.comb(q, j) * (-cx) ** (p - i) * (-cy) ** (q - j) * m[i, j] for i in range(p + 1) for j in range(q + 1))
        eta[p, q] = mu / m[0, 0] ** (1 + (p + q) / 2)
    # complex moments: c20 and c30, c21 turn with the shape by known angles, so these products do not
    c11, c20 = eta[2, 0] + eta[0, 2], complex(eta[2, 0] - eta[0, 2], 2 * eta[1, 1])
    c21, c30 = complex(eta[3, 0] + eta[1, 2], eta[2, 1] + eta[0, 3]), complex(eta[3, 0] - 3 * eta[1, 2], 3 * eta[2, 1] - eta[0, 3])
    cubic, square = c30 * c21.conjugate() ** 3, c20 * c21.conjugate() ** 2
    return [c11, abs(c20) ** 2, abs(c30) ** 2, abs(c21) ** 2, cubic.real, square.real, cubic.imag]


def signed_log(v: float) -> float:
    return 0.0 if v == 0 else -math.copysign(1.0, v) * math.log10(abs(v))


def curvature(points: np.ndarray, k: int = 5) -> np.ndarray:
    """Absolute sine of the turn between the steps of k points to and from each point; empty for fewer than 2k + 1 points."""
    if len(points) < 2 * k + 1:
        return np.empty(0)
    to, on = (points - np.roll(points, k, 0)).astype(float), (np.roll(points, -k, 0) - points).astype(float)
    size = np.hypot(*to.T) * np.hypot(*on.T)
    ok = size > 0
    return np.abs(to[ok, 0] * on[ok, 1] - to[ok, 1] * on[ok, 0]) / size[ok]


def skeleton(mask: np.ndarray) -> np.ndarray:
    """Thinned by Zhang and Suen's two alternating passes until nothing changes."""
    now = np.pad(mask, 1)
    h, w = mask.shape
    north_on = ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))
    while True:
        before = now.copy()
        for first in (True, False):
            p = [now[1 + y : 1 + y + h, 1 + x : 1 + x + w] for y, x in north_on]
            count = sum(a.astype(np.int8) for a in p)
            rises = sum((~a & b).astype(np.int8) for a, b in zip(p, p[1:] + p[:1], strict=True))
            n, e, s, o = p[0], p[2], p[4], p[6]
            safe = ~(n & e & s) & ~(e & s & o) if first else ~(n & e & o) & ~(n & s & o)
            gone = now[1:-1, 1:-1] & (count >= 2) & (count <= 6) & (rises == 1) & safe
            now[1:-1, 1:-1] &= ~gone
        if (before == now).all():
            return now[1:-1, 1:-1]


def edge_pixels(mask: np.ndarray, low: float = 50, high: float = 150) -> int:
    """Pixels on edges: Sobel gradients that no neighbour along their direction exceeds, and that reach strong ones (Canny)."""
    x = mask * 255.0
    gx, gy = raster.filtered(x, (1, 2, 1), (-1, 0, 1), "edge"), raster.filtered(x, (-1, 0, 1), (1, 2, 1), "edge")
    m = np.abs(gx) + np.abs(gy)
    wide, (h, w) = np.pad(m, 1), m.shape
    at = lambda dy, dx: wide[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w]
    flat, steep = np.abs(gy) < math.tan(math.pi / 8) * np.abs(gx), np.abs(gy) > math.tan(3 * math.pi / 8) * np.abs(gx)
    same = gx * gy >= 0
    peak = np.select(
        [flat, steep, same], [(m > at(0, -1)) & (m >= at(0, 1)), (m > at(-1, 0)) & (m >= at(1, 0)), (m > at(-1, -1)) & (m > at(1, 1))],
        (m > at(-1, 1)) & (m > at(1, -1)),
    )
    weak = peak & (m > low)
    labels = raster.components(weak)
    return int(np.isin(labels[weak], np.unique(labels[weak & (m > high)])).sum())


def spectrum(radii: np.ndarray) -> dict[str, float]:
    """The strongest frequency of the radii, and the share of the upper fifth of frequencies."""
    mag = np.abs(np.fft.rfft(radii - radii.mean()))[1:]
    if not len(mag):
        return {}
    top = float(mag[int(0.8 * len(mag)) :].sum())
    k = int(np.argmax(mag))
    return {"contour_fft_len": len(mag), "contour_fft_dom_freq_idx": k + 1, "contour_fft_dom_freq_mag": float(mag[k]), "contour_fft_highfreq_energy": top, "contour_fft_highfreq_ratio": top / (float(mag.sum()) or 1.0)}


def _size(points: np.ndarray) -> dict[str, float]:
    a, p, corners = raster.area(points), perimeter(points), hull(points)
    (x, y), (w, h) = points.min(0).tolist(), (np.ptp(points, axis=0) + 1).tolist()
    r, convex = enclosing_radius(corners), raster.area(corners)
    cx, cy, short, long, angle = ellipse(points) if len(points) >= 5 else (0.0,) * 5
    # the eccentricity is that of the longer over the shorter axis, held to 1: zero but for no ellipse at all
    eccentricity = math.sqrt(1 - min(long / short, 1.0) ** 2) if short > 0 else 0.0
    return {
        "area": a, "perimeter": p, "bbox_x": x, "bbox_y": y, "bbox_width": w, "bbox_height": h, "bbox_area": float(w * h), "aspect_ratio": ratio(w, h), "extent": ratio(a, w * h), "solidity": ratio(a, convex),
        "compactness": ratio(p * p, a), "circularity": ratio(4 * math.pi * a, p * p), "convex_area": convex, "convexity": ratio(convex, a), "min_rect_area_ratio": ratio(a, least_rectangle(corners)),
        "circle_radius": r, "circle_area_ratio": ratio(a, math.pi * r * r), "ellipse_center_x": cx, "ellipse_center_y": cy, "ellipse_major_axis": short, "ellipse_minor_axis": long, "ellipse_eccentricity": eccentricity, "ellipse_angle": angle,
    }


def _radii(points: np.ndarray, m: dict[tuple[int, int], float]) -> dict[str, float]:
    if m[0, 0] == 0:
        return {}
    cx, cy = np.array([m[1, 0], m[0, 1]]) / m[0, 0] + points.mean(0)
    d = np.hypot(points[:, 0] - cx, points[:, 1] - cy)
    out = {"centroid_x": float(cx), "centroid_y": float(cy), "distance_mean": float(d.mean()), "distance_std": float(d.std()), "distance_min": float(d.min()), "distance_max": float(d.max()), "distance_range": float(np.ptp(d)), "distance_cv": ratio(d.std(), d.mean())}
    out |= {f"distance_hist_bin_{i}": int(n) for i, n in enumerate(np.histogram(d, 10, (d.min(), d.max()))[0])}
    return out | spectrum(d)


def _skeleton(mask: np.ndarray) -> dict[str, float]:
    thin = skeleton(mask)
    n = int(thin.sum())
    if not n:
        return {}
    wide, (h, w) = np.pad(thin, 1).astype(np.int8), thin.shape
    around = sum(wide[1 + y : 1 + y + h, 1 + x : 1 + x + w] for y, x in raster.RING)[thin]
    ends, forks = int((around == 1).sum()), int((around > 2).sum())
    return {"skeleton_length": n, "skeleton_endpoints": ends, "skeleton_branches": forks, "skeleton_complexity": (ends + forks) / n}


def _holes(mask: np.ndarray) -> dict[str, float]:
    sizes = np.bincount(raster.components(~mask).ravel())[1:].tolist()
    if sizes:
        sizes.remove(max(sizes))
    return {"holes_count": len(sizes), "holes_mean_area": float(np.mean(sizes)) if sizes else 0.0, "holes_max_area": float(max(sizes, default=0))}


def features(gray: np.ndarray, full: bool = False, tolerance: float = 0.02) -> dict[str, float] | None:
    """PIECE, or ALL if full, of the main object; None without one. A feature that a contour is too short for is 0 in PIECE, absent in ALL."""
    mask = main_mask(gray)
    if mask is None:
        return None
    points = raster.outline(mask)
    m, bent = moments(points), curvature(points)
    out = _size(points) | corner_stats(polygon(points, tolerance * perimeter(points))) | {f"hu_moment_{i}": signed_log(v) for i, v in enumerate(hu_invariants(m), 1)}
    if not full:
        return {k: out.get(k, 0.0) for k in PIECE} | {"curvature_max": float(bent.max(initial=0.0))}
    out |= _radii(points, m) | _skeleton(mask) | _holes(mask)
    if len(bent):
        out |= {"curvature_mean": float(bent.mean()), "curvature_std": float(bent.std()), "curvature_max": float(bent.max()), "curvature_sum": float(bent.sum())}
    edges = edge_pixels(mask)
    return out | {"edges_pixel_count": edges, "edges_density": ratio(edges, int(mask.sum()))}
