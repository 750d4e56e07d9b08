"""Kernels on one grayscale picture in numpy: smoothing, thresholds, components, morphology, contours.

Pixels are uint8 arrays, masks boolean arrays. Nothing here touches Spark; sources of pictures call these per Arrow batch.
"""

from __future__ import annotations

import numpy as np

#: A 5 x 1 smoothing kernel of deviation 1.1, the 3 x 3 elliptic neighbourhood, the Scharr weights.
CROSS = ((0, 0), (-1, 0), (1, 0), (0, -1), (0, 1))
SCHARR = (3.0, 10.0, 3.0)
#: Clockwise steps (row, column) round a pixel, from the east.
RING = ((0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1))


def resized(gray: np.ndarray, width: int) -> np.ndarray:
    """The picture at a width, its aspect kept; every new pixel is the mean of the area that it covers."""

    def along(x: np.ndarray, n: int) -> np.ndarray:
        total = np.concatenate((np.zeros((1, x.shape[1])), np.cumsum(x, 0)))
        edge = np.linspace(0, len(x), n + 1)
        low = np.minimum(edge.astype(int), len(x) - 1)
        at = total[low] + (edge - low)[:, None] * x[low]
        return np.diff(at, axis=0) * n / len(x)

    height = max(1, gray.shape[0] * width // gray.shape[1])
    return np.rint(along(along(gray.astype(float), height).T, width).T).clip(0, 255).astype(np.uint8)


def gaussian(size: int) -> np.ndarray:
    """Weights of a Gaussian of `size` taps; its deviation follows from the size."""
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    w = np.exp(-((np.arange(size) - size // 2) ** 2) / (2 * sigma * sigma))
    return w / w.sum()


def filtered(x: np.ndarray, down: np.ndarray, across: np.ndarray, border: str = "reflect") -> np.ndarray:
    """Separable correlation, the picture mirrored (or its edge repeated) beyond its border."""
    x = x.astype(float)
    for axis, w in ((0, np.asarray(down)), (1, np.asarray(across))):
        half = len(w) // 2
        pad = [(0, 0), (0, 0)]
        pad[axis] = (half, half)
        wide = np.pad(x, pad, mode="edge" if x.shape[axis] <= half else border)
        n = x.shape[axis]
        x = sum(c * (wide[i : i + n] if axis == 0 else wide[:, i : i + n]) for i, c in enumerate(w))
    return x


def blurred(gray: np.ndarray, size: int = 5) -> np.ndarray:
    w = gaussian(size)
    return np.rint(filtered(gray, w, w)).clip(0, 255).astype(np.uint8)


def adaptive(gray: np.ndarray, block: int = 35, offset: float = 5) -> np.ndarray:
    """Pixels brighter than their Gaussian neighbourhood's mean less an offset."""
    w = gaussian(block)
    return gray > np.rint(filtered(gray, w, w, "edge")) - offset


def minority(mask: np.ndarray) -> np.ndarray:
    """The mask, inverted if it holds half of the pixels or more."""
    return mask if mask.sum() < mask.size // 2 else ~mask


def components(mask: np.ndarray, eight: bool = True) -> np.ndarray:
    """Labels 1, 2, ... of connected pixels, 0 elsewhere: runs of each row are joined to touching runs of the row above."""
    h, w = mask.shape
    padded = np.zeros((h, w + 2), np.int8)
    padded[:, 1:-1] = mask
    step = np.diff(padded, axis=1)
    row, start = np.nonzero(step == 1)
    end = np.nonzero(step == -1)[1]
    parent = np.arange(len(row))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    first = np.searchsorted(row, np.arange(h + 1))
    reach = 1 if eight else 0
    for y in range(1, h):
        i, j = first[y - 1], first[y]
        while i < first[y] and j < first[y + 1]:
            if start[i] < end[j] + reach and start[j] < end[i] + reach:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
            if end[i] < end[j]:
                i += 1
            else:
                j += 1
    out = np.zeros((h, w), np.int32)
    if len(row):
        name = np.unique([root(i) for i in range(len(row))], return_inverse=True)[1] + 1
        out[mask] = np.repeat(name, end - start)
    return out


def largest(mask: np.ndarray) -> np.ndarray | None:
    """The largest component, or None where nothing is set."""
    labels = components(mask)
    size = np.bincount(labels.ravel())
    return labels == 1 + int(np.argmax(size[1:])) if len(size) > 1 else None


def without_holes(mask: np.ndarray) -> np.ndarray:
    """The mask with all background that the corner's background does not reach; everything, if the corner is set."""
    if mask[0, 0]:
        return np.ones_like(mask)
    labels = components(~mask, eight=False)
    return labels != labels[0, 0]


def dilated(mask: np.ndarray) -> np.ndarray:
    wide, (h, w) = np.pad(mask, 1), mask.shape
    return np.logical_or.reduce([wide[1 + y : 1 + y + h, 1 + x : 1 + x + w] for y, x in CROSS])


def closed(mask: np.ndarray) -> np.ndarray:
    """Dilated, then eroded; beyond the border nothing is eroded."""
    wide, (h, w) = np.pad(dilated(mask), 1, constant_values=True), mask.shape
    return np.logical_and.reduce([wide[1 + y : 1 + y + h, 1 + x : 1 + x + w] for y, x in CROSS])


def gradient(gray: np.ndarray) -> np.ndarray:
    """Magnitude of the Scharr gradient, stretched to 0-255."""
    slope = (-1.0, 0.0, 1.0)
    m = np.hypot(filtered(gray, SCHARR, slope), filtered(gray, slope, SCHARR))
    span = m.max() - m.min()
    return ((m - m.min()) * (255 / span) if span else np.zeros_like(m)).astype(np.uint8)


def otsu(gray: np.ndarray) -> int:
    """The level that parts the histogram with the greatest variance between both sides."""
    p = np.bincount(gray.ravel(), minlength=256) / gray.size
    below, mean = np.cumsum(p), np.cumsum(p * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (mean[-1] * below - mean) ** 2 / (below * (1 - below))
    return int(np.argmax(np.nan_to_num(between, nan=0.0, posinf=0.0)))


def outline(mask: np.ndarray) -> np.ndarray:
    """Corner points (x, y) of the outer border of the mask's first component in reading order; straight runs keep their ends only."""
    h, w = mask.shape
    wide = np.pad(mask, 1)
    flat = np.flatnonzero(wide)
    if not len(flat):
        return np.empty((0, 2), int)
    y, x = divmod(int(flat[0]), w + 2)
    path, begin, heading = [(x - 1, y - 1)], None, 5
    at = (y, x)
    while True:
        for turn in range(8):  # the first set pixel clockwise from behind the last step
            k = (heading + turn) % 8
            ny, nx = at[0] + RING[k][0], at[1] + RING[k][1]
            if wide[ny, nx]:
                break
        else:
            return np.array(path)
        if begin == (at, k):
            break
        begin = begin or (at, k)
        at, heading = (ny, nx), (k + 6 - (k & 1)) % 8
        path.append((nx - 1, ny - 1))
    points = np.array(path[:-1])
    ahead, behind = np.roll(points, -1, 0) - points, points - np.roll(points, 1, 0)
    return points[(ahead != behind).any(1)]


def area(points: np.ndarray) -> float:
    """Area inside a closed polygon."""
    if len(points) < 3:
        return 0.0
    x, y = points[:, 0].astype(float), points[:, 1].astype(float)
    return abs(float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum())) / 2


def outlines(mask: np.ndarray) -> list[np.ndarray]:
    """The outer border of every component."""
    labels = components(mask)
    order = np.argsort(labels, axis=None, kind="stable")
    edge = np.searchsorted(labels.ravel()[order], np.arange(1, labels.max(initial=0) + 2))
    out = []
    for lo, hi in zip(edge[:-1], edge[1:], strict=True):
        y, x = np.divmod(order[lo:hi], mask.shape[1])
        part = np.zeros((np.ptp(y) + 1, np.ptp(x) + 1), bool)
        part[y - y.min(), x - x.min()] = True
        out.append(outline(part) + (x.min(), y.min()))
    return out


def piece_mask(gray: np.ndarray, width: int = 640) -> np.ndarray:
    """The mask of the main object of a photo: its thresholded component with holes filled, joined with its filled outline.

    Where no edge is found the (empty) edges are the mask.
    """
    smooth = blurred(resized(gray, width))
    found = minority(adaptive(smooth))
    main = largest(found)
    filled = closed(without_holes(found if main is None else main))
    g = gradient(smooth)
    edges = dilated(g > otsu(g))
    shapes = outlines(edges)
    if not shapes:
        return edges
    best = max(shapes, key=area)
    labels = components(edges)
    own = labels == labels[best[0, 1], best[0, 0]]
    solid = np.zeros((own.shape[0] + 2, own.shape[1] + 2), bool)
    solid[1:-1, 1:-1] = own
    return closed(without_holes(solid)[1:-1, 1:-1]) | filled
