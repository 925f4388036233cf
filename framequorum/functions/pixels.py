"""Picture measures and plate preparation on grey arrays, in numpy, for use inside Arrow batches."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Angles that are tried first, in degrees, and values that the matrix of their row sums may have.
COARSE, DENSE = np.arange(-20.0, 20.5, 1.0), 1 << 22


def grey(picture: np.ndarray) -> np.ndarray:
    """Luma of blue-green-red samples; grey pictures stay."""
    if picture.ndim == 2:
        return picture.astype(np.float64)
    return np.rint(picture[..., 0] * 0.114 + picture[..., 1] * 0.587 + picture[..., 2] * 0.299)


def brightness(picture: np.ndarray) -> float:
    return float(grey(picture).mean()) if picture.size else 0.0


def laplacian_variance(picture: np.ndarray) -> float:
    """Population variance of the 4-neighbour Laplacian, borders mirrored without their own row."""
    if not picture.size:
        return 0.0
    g = np.pad(grey(picture), 1, mode="reflect") if min(picture.shape[:2]) > 1 else np.pad(grey(picture), 1, mode="edge")
    return float((g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]).var())


def exposure(picture: np.ndarray, dark: int = 30, bright: int = 225) -> float:
    """Share of very bright and very dark pixels, at most 1."""
    g = grey(picture)
    return float(min(1.0, (g >= bright).mean() + (g <= dark).mean())) if g.size else 0.0


def otsu(g: np.ndarray) -> int:
    """Threshold of greatest variance between the classes."""
    counts = np.bincount(np.clip(g, 0, 255).astype(np.uint8).ravel(), minlength=256).astype(float)
    total = counts.sum()
    if not total:
        return 0
    weight = np.cumsum(counts) / total
    mean = np.cumsum(counts * np.arange(256)) / total
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (mean[-1] * weight - mean) ** 2 / (weight * (1 - weight))
    return int(np.nanargmax(np.where(np.isfinite(between), between, -1.0)))


@lru_cache(maxsize=1024)
def _steps(length: int, to: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each of ``to`` places the two of ``length`` around it and the share of the second."""
    at = np.clip((np.arange(to) + 0.5) * length / to - 0.5, 0, length - 1)
    low = np.floor(at).astype(int)
    return low, np.minimum(low + 1, length - 1), at - low


def resized(g: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear, pixel centres aligned."""
    if not g.size:
        return np.zeros((height, width))
    (y0, y1, fy), (x0, x1, fx) = _steps(g.shape[0], height), _steps(g.shape[1], width)
    wide = g.take(x0, axis=1) * (1 - fx) + g.take(x1, axis=1) * fx
    return wide[y0] * (1 - fy)[:, None] + wide[y1] * fy[:, None]


def by_height(g: np.ndarray, height: int) -> np.ndarray:
    return resized(g, height, max(1, round(g.shape[1] * height / max(1, g.shape[0]))))


def sampled(g: np.ndarray, ys: np.ndarray, xs: np.ndarray, fill: float = 0.0) -> np.ndarray:
    """Bilinear values at float positions; ``fill`` outside."""
    inside = (ys >= 0) & (xs >= 0) & (ys <= g.shape[0] - 1) & (xs <= g.shape[1] - 1)
    y, x = np.clip(ys, 0, g.shape[0] - 1), np.clip(xs, 0, g.shape[1] - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, g.shape[0] - 1), np.minimum(x0 + 1, g.shape[1] - 1)
    fy, fx = y - y0, x - x0
    value = (g[y0, x0] * (1 - fx) + g[y0, x1] * fx) * (1 - fy) + (g[y1, x0] * (1 - fx) + g[y1, x1] * fx) * fy
    return np.where(inside, value, fill)


def rotated(g: np.ndarray, degrees: float, fill: float = 0.0) -> np.ndarray:
    """Turned about the middle, same size; positive turns the content counter-clockwise."""
    a = np.deg2rad(degrees)
    cy, cx = (g.shape[0] - 1) / 2, (g.shape[1] - 1) / 2
    yy, xx = np.mgrid[: g.shape[0], : g.shape[1]].astype(float)
    dy, dx = yy - cy, xx - cx
    return sampled(g, cy + dx * np.sin(a) + dy * np.cos(a), cx + dx * np.cos(a) - dy * np.sin(a), fill)


def skew(g: np.ndarray, most: float = 20.0) -> float:
    """Degrees that make row sums of the ink vary most: steps of 1, then of 0.2, then the top of a parabola; 0 below half a degree."""
    if min(g.shape) < 4:
        return 0.0
    ink = (g <= otsu(g)).astype(float)
    score = lambda d: float(rotated(ink, d).sum(1).var())
    coarse = np.arange(-most, most + 0.5, 1.0)
    best = coarse[int(np.argmax([score(d) for d in coarse]))]
    fine = np.arange(best - 1, best + 1.01, 0.2)
    values = [score(d) for d in fine]
    return _parabola(fine, values, int(np.argmax(values)))


@lru_cache(maxsize=1024)
def _turned(height: int, width: int, degrees: float) -> tuple[np.ndarray, ...]:
    """Where ``rotated`` takes its values: four flat places, two shares and what lies inside."""
    a = np.deg2rad(degrees)
    cy, cx = (height - 1) / 2, (width - 1) / 2
    yy, xx = np.mgrid[:height, :width].astype(float)
    dy, dx = yy - cy, xx - cx
    ys, xs = (cy + dx * np.sin(a) + dy * np.cos(a)).ravel(), (cx + dx * np.cos(a) - dy * np.sin(a)).ravel()
    inside = (ys >= 0) & (xs >= 0) & (ys <= height - 1) & (xs <= width - 1)
    y, x = np.clip(ys, 0, height - 1), np.clip(xs, 0, width - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, height - 1), np.minimum(x0 + 1, width - 1)
    return y0 * width + x0, y0 * width + x1, y1 * width + x0, y1 * width + x1, y - y0, x - x0, inside


def _row_variances(ink: np.ndarray, height: int, width: int, degrees: float) -> np.ndarray:
    """Variance of the row sums of each flat picture, turned: the same operations as ``rotated``."""
    aa, ab, ba, bb, fy, fx, inside = _turned(height, width, degrees)
    aa, ab, ba, bb = (ink.take(places, axis=1) for places in (aa, ab, ba, bb))
    value = (aa * (1 - fx) + ab * fx) * (1 - fy) + (ba * (1 - fx) + bb * fx) * fy
    return np.where(inside, value, 0.0).reshape(len(ink), height, width).sum(2).var(1)


@lru_cache(maxsize=4)
def _row_sums(height: int, width: int) -> np.ndarray:
    """Matrix that takes a flat picture to its row sums at every coarse angle."""
    out = np.zeros((len(COARSE) * height, height * width))
    for k, d in enumerate(COARSE):
        *places, fy, fx, inside = _turned(height, width, float(d))
        row = k * height + np.arange(height * width) // width
        for place, share in zip(places, ((1 - fx) * (1 - fy), fx * (1 - fy), (1 - fx) * fy, fx * fy), strict=True):
            np.add.at(out, (row, place), share * inside)
    return out.T.copy()


def skews(pictures: np.ndarray) -> np.ndarray:
    """``skew`` of equally large pictures (n, height, width), all at once.

    Row sums are linear in the ink, so a matrix gives them for all coarse angles; angles that it
    cannot tell apart, and the fine ones, are measured as ``skew`` does. Large pictures, for which
    that matrix would be too, go one by one.
    """
    n, height, width = pictures.shape
    if min(height, width) < 4 or len(COARSE) * height * height * width > DENSE:
        return np.array([skew(g) for g in pictures])
    out = np.zeros(n)
    for at in range(0, n, 256):
        part = pictures[at : at + 256]
        ink = np.stack([(g <= otsu(g)).astype(float).ravel() for g in part])
        score = (ink @ _row_sums(height, width)).reshape(len(part), len(COARSE), height).var(2)
        best = score.argmax(1)
        near = score >= score.max(1, keepdims=True) - 1e-6
        for i in np.flatnonzero(near.sum(1) > 1):
            likely = np.flatnonzero(near[i])
            best[i] = likely[int(np.argmax([_row_variances(ink[i : i + 1], height, width, float(COARSE[k]))[0] for k in likely]))]
        for k in np.unique(best):
            mine = np.flatnonzero(best == k)
            fine = np.arange(COARSE[k] - 1, COARSE[k] + 1.01, 0.2)
            values = np.stack([_row_variances(ink[mine], height, width, float(d)) for d in fine], axis=1)
            top = values.argmax(1)
            out[at + mine] = [_parabola(fine, v, int(t)) for v, t in zip(values, top, strict=True)]
    return out


def _parabola(fine: np.ndarray, values: np.ndarray, k: int) -> float:
    """The top of the parabola through the best of the fine angles and its neighbours; 0 below half a degree."""
    angle = fine[k]
    if 0 < k < len(fine) - 1 and (bend := values[k - 1] - 2 * values[k] + values[k + 1]):
        angle += 0.2 * 0.5 * (values[k - 1] - values[k + 1]) / bend
    return 0.0 if abs(angle) < 0.5 else float(angle)


def split_row(g: np.ndarray, valley: float = 0.35) -> int | None:
    """Row between two text lines: the emptiest of the middle half, if it holds at most that share of the mean ink; else None."""
    if g.shape[0] < 8:
        return None
    ink = (g <= otsu(g)).sum(1).astype(float)
    low, high = g.shape[0] // 4, 3 * g.shape[0] // 4
    k = low + int(np.argmin(ink[low:high]))
    return k if ink[k] <= valley * ink.mean() else None


def merged_lines(g: np.ndarray, row: int, gap: int = 8) -> np.ndarray:
    """Two lines side by side at the height of the taller, with white between."""
    top, low = g[:row], g[row:]
    h = max(len(top), len(low))
    return np.hstack([by_height(top, h), np.full((h, gap), 255.0), by_height(low, h)])


def equalised(g: np.ndarray, tiles: int = 4, clip: float = 2.0) -> np.ndarray:
    """Contrast-limited equalisation per tile, blended between the four nearest tiles."""
    h, w = g.shape
    g8 = np.clip(g, 0, 255).astype(int)
    (y0, y1, fy), (x0, x1, fx) = _steps(tiles, h), _steps(tiles, w)
    parts = [g8[i * h // tiles : max(i * h // tiles + 1, (i + 1) * h // tiles), j * w // tiles : max(j * w // tiles + 1, (j + 1) * w // tiles)].ravel() for i in range(tiles) for j in range(tiles)]
    sizes = np.array([len(p) for p in parts])
    tile = np.repeat(256 * np.arange(tiles * tiles), sizes)
    counts = np.bincount(tile + np.concatenate(parts), minlength=256 * tiles * tiles).astype(float).reshape(-1, 256)
    limit = np.maximum(1.0, clip * sizes / 256)[:, None]
    extra = np.maximum(counts - limit, 0).sum(1, keepdims=True)
    counts = np.minimum(counts, limit) + extra / 256
    maps = (np.cumsum(counts, axis=1) * 255 / counts.sum(1, keepdims=True)).ravel()
    at = lambda a, b: maps.take(256 * (tiles * a[:, None] + b) + g8)
    fy = fy[:, None]
    return (at(y0, x0) * (1 - fx) + at(y0, x1) * fx) * (1 - fy) + (at(y1, x0) * (1 - fx) + at(y1, x1) * fx) * fy


def padded(g: np.ndarray, height: int = 48, width: int = 320) -> np.ndarray:
    """Scaled into height x width, the rest white on the right."""
    scaled = by_height(g, height)
    scaled = resized(scaled, height, width) if scaled.shape[1] > width else scaled
    out = np.full((height, width), 255.0)
    out[:, : scaled.shape[1]] = scaled
    return out


def homography(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """3 x 3 matrix that takes four points to four points."""
    rows = []
    for (x, y), (u, v) in zip(source, target, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
    return np.r_[np.linalg.solve(np.array(rows, float), np.asarray(target, float).ravel()), 1.0].reshape(3, 3)


def applied(matrix: np.ndarray, points: np.ndarray) -> np.ndarray:
    p = np.c_[points, np.ones(len(points))] @ matrix.T
    return p[:, :2] / p[:, 2:]


def warped(g: np.ndarray, quad: np.ndarray, height: int, width: int) -> np.ndarray:
    """The picture within a quad (TL, TR, BR, BL) as a rectangle."""
    corners = np.array([[0, 0], [width - 1, 0], [width - 1, height - 1], [0, height - 1]], float)
    yy, xx = np.mgrid[:height, :width]
    at = applied(homography(corners, np.asarray(quad, float)), np.c_[xx.ravel(), yy.ravel()].astype(float))
    return sampled(g, at[:, 1].reshape(height, width), at[:, 0].reshape(height, width), 255.0)


def straightened(g: np.ndarray, quad: np.ndarray, gate: float = 15.0) -> np.ndarray:
    """Warped if the upper edge leans more than ``gate`` degrees, else the quad's bounding box."""
    q = np.asarray(quad, float)
    lean = np.degrees(np.arctan2(q[1, 1] - q[0, 1], q[1, 0] - q[0, 0]))
    x1, y1 = np.maximum(np.floor(q.min(0)), 0).astype(int)
    x2, y2 = np.ceil(q.max(0)).astype(int)
    if abs(lean) <= gate:
        return g[y1 : y2 + 1, x1 : x2 + 1]
    side = lambda a, b: max(2, round(float(np.hypot(*(q[a] - q[b])))))
    return warped(g, q, max(side(0, 3), side(1, 2)), max(side(0, 1), side(3, 2)))


def quad_mask(quad: np.ndarray, height: int, width: int) -> np.ndarray:
    """Pixels whose centre lies in the rounded convex quad, borders included."""
    q = np.rint(np.asarray(quad, float))
    yy, xx = np.mgrid[:height, :width]
    sides = [(q[(i + 1) % 4, 0] - q[i, 0]) * (yy - q[i, 1]) - (q[(i + 1) % 4, 1] - q[i, 1]) * (xx - q[i, 0]) for i in range(4)]
    return np.all([s >= 0 for s in sides], axis=0) | np.all([s <= 0 for s in sides], axis=0)


def quad_iou(a: np.ndarray, b: np.ndarray) -> float:
    """Overlap of two quads on the pixel raster."""
    both = np.vstack([a, b]).astype(float)
    low = np.floor(both.min(0)) - 1
    w, h = (np.ceil(both.max(0)) - low + 2).astype(int)
    x, y = quad_mask(np.asarray(a) - low, h, w), quad_mask(np.asarray(b) - low, h, w)
    union = (x | y).sum()
    return float((x & y).sum() / union) if union else 0.0


def prepared(g: np.ndarray, least_width: int = 40, least_height: int = 15, turn: float | None = None) -> dict[str, np.ndarray]:
    """Variants of a plate crop for reading: straight, equalised and padded; two lines also merged, binary and one by one. Too small: none.

    ``turn`` is its skew, if that is known.
    """
    if g.shape[1] < least_width or g.shape[0] < least_height:
        return {}
    turn = skew(g) if turn is None else turn
    straight = rotated(g, turn, 255.0) if turn else g
    out = {"plate": padded(equalised(straight))}
    row = split_row(straight)
    if row is not None:
        one = merged_lines(straight, row)
        out = {"merged": padded(equalised(one)), "merged_binary": padded(np.where(one <= otsu(one), 0.0, 255.0)), "line_0": padded(equalised(straight[:row])), "line_1": padded(equalised(straight[row:]))}
    return out
