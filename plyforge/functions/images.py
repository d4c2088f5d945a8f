"""Numpy kernels of one grey image: smoothing, thresholds, components, borders.

Each takes and gives uint8 arrays (height x width); masks hold 0 and 255.
"""

from __future__ import annotations

import numpy as np


def gray(image: np.ndarray) -> np.ndarray:
    """Luminance of a BGR image (three channels or more); a grey one as it is."""
    if image.ndim == 2:
        return image
    if image.shape[2] < 3:
        return image[:, :, 0]
    b, g, r = (image[:, :, i].astype(float) for i in range(3))
    return np.floor(0.299 * r + 0.587 * g + 0.114 * b + 0.5).astype(np.uint8)


def gaussian(size: int) -> np.ndarray:
    """Weights of an odd window; the deviation follows from its size (0.3 ((n - 1) / 2 - 1) + 0.8)."""
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    w = np.exp(-((np.arange(size) - size // 2) ** 2) / (2 * sigma * sigma))
    return w / w.sum()


def _smooth(image: np.ndarray, size: int, border: str) -> np.ndarray:
    r, w, out = size // 2, gaussian(size), image.astype(float)
    for axis in (0, 1):
        pad = [(r, r) if a == axis else (0, 0) for a in (0, 1)]
        wide = np.pad(out, pad, mode=border if out.shape[axis] > r else "edge")
        n = out.shape[axis]
        out = sum(w[i] * np.take(wide, np.arange(i, i + n), axis=axis) for i in range(size))
    return out


def blur(image: np.ndarray, size: int = 5) -> np.ndarray:
    """Gaussian smoothing, mirrored at the border; an even size grows by one, 0 or less does nothing."""
    if size <= 0:
        return image
    return np.floor(_smooth(image, size | 1, "reflect") + 0.5).astype(np.uint8)


def adaptive(image: np.ndarray, block: int = 11, c: float = 2) -> np.ndarray:
    """255 where a pixel is over its window's Gaussian mean less c; a block that is even or under 3 counts as 11."""
    block = 11 if block < 3 or block % 2 == 0 else block
    mean = np.floor(_smooth(image, block, "edge") + 0.5)
    return np.where(image > mean - c, 255, 0).astype(np.uint8)


def otsu_level(image: np.ndarray) -> int:
    n = np.bincount(image.reshape(-1), minlength=256).astype(float)
    below, weight = np.cumsum(n), np.cumsum(n * np.arange(256))
    above = below[-1] - below
    with np.errstate(divide="ignore", invalid="ignore"):
        apart = weight / below - (weight[-1] - weight) / above
    return int(np.nan_to_num(below * above * apart * apart).argmax())


def otsu(image: np.ndarray) -> np.ndarray:
    return np.where(image > otsu_level(image), 255, 0).astype(np.uint8)


def resized(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear, pixel centres on pixel centres."""
    y, x = (np.clip((np.arange(n) + 0.5) * m / n - 0.5, 0, m - 1) for n, m in ((height, image.shape[0]), (width, image.shape[1])))
    y0, x0 = y.astype(int), x.astype(int)
    y1, x1 = np.minimum(y0 + 1, image.shape[0] - 1), np.minimum(x0 + 1, image.shape[1] - 1)
    fy, fx, v = (y - y0)[:, None], (x - x0)[None, :], image.astype(float)
    out = v[y0][:, x0] * (1 - fy) * (1 - fx) + v[y0][:, x1] * (1 - fy) * fx + v[y1][:, x0] * fy * (1 - fx) + v[y1][:, x1] * fy * fx
    return np.floor(out + 0.5).astype(np.uint8)


def background(image: np.ndarray, empty: np.ndarray, least: int = 30) -> np.ndarray:
    """255 where the image differs from the empty scene by more than `least`."""
    empty = gray(empty)
    if empty.shape != image.shape:
        empty = resized(empty, *image.shape)
    return np.where(np.abs(image.astype(int) - empty) > least, 255, 0).astype(np.uint8)


def _extreme(mask: np.ndarray, element: list[tuple[int, int]], pick, outside: int) -> np.ndarray:
    r = max(max(abs(dy), abs(dx)) for dy, dx in element)
    wide, (h, w) = np.pad(mask, r, constant_values=outside), mask.shape
    return pick.reduce([wide[r + dy : r + dy + h, r + dx : r + dx + w] for dy, dx in element])


def open_close(mask: np.ndarray, element: list[tuple[int, int]]) -> np.ndarray:
    for pick, outside in ((np.minimum, 255), (np.maximum, 0), (np.maximum, 0), (np.minimum, 255)):
        mask = _extreme(mask, element, pick, outside)
    return mask


def labels(mask: np.ndarray, diagonal: bool = True) -> tuple[np.ndarray, int]:
    """Connected components of what is over 0: labels from 1 on in scan order, and their number.

    Runs of a row are joined to the touching runs of the row above.
    """
    on, parent, runs, above = mask > 0, [0], [], []
    reach = int(diagonal)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for y in range(on.shape[0]):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], on[y].astype(np.int8), [0]])))
        here, at = [], 0
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            while at < len(above) and above[at][1] <= a - reach:  # runs of both rows go from left to right
                at += 1
            touching, k = [], at
            while k < len(above) and above[k][0] < b + reach:
                touching.append(above[k][2])
                k += 1
            if touching:
                n = min(root(t) for t in touching)
                for t in touching:
                    parent[root(t)] = n
            else:
                n = len(parent)
                parent.append(n)
            here.append((a, b, n))
        runs += [(y, *h) for h in here]
        above = here
    names, out = {}, np.zeros(mask.shape, np.int32)
    for y, a, b, n in runs:
        out[y, a:b] = names.setdefault(root(n), len(names) + 1)
    return out, len(names)


#: The eight neighbours (dy, dx), clockwise from the left.
AROUND = ((0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1))


def border(part: np.ndarray, start: tuple[int, int]) -> np.ndarray:
    """The (x, y) pixels around a component, from its first pixel in scan order, by Moore tracing until it starts anew."""
    wide = np.pad(part, 1)
    y, x = start[0] + 1, start[1] + 1
    out, came, first = [(x - 1, y - 1)], 0, None
    while True:
        for k in range(8):
            d = (came + k) % 8
            ny, nx = y + AROUND[d][0], x + AROUND[d][1]
            if wide[ny, nx]:
                break
        else:
            break
        if first is None:
            first = (ny, nx)
        elif (y, x) == (start[0] + 1, start[1] + 1) and (ny, nx) == first:
            out.pop()
            break
        y, x = ny, nx
        out.append((x - 1, y - 1))
        came = (d + 5) % 8  # begin next to where we came from
    return np.array(out, float)


def corners(points: np.ndarray) -> np.ndarray:
    """Without the points inside straight runs of a closed border."""
    if len(points) < 3:
        return points
    before, after = points - np.roll(points, 1, axis=0), np.roll(points, -1, axis=0) - points
    return points[(before != after).any(axis=1)]


def closed_area(points: np.ndarray) -> float:
    x, y = points.T
    return abs(float((x * np.roll(y, -1) - y * np.roll(x, -1)).sum())) / 2 if len(points) > 2 else 0.0


def closed_length(points: np.ndarray) -> float:
    return float(np.linalg.norm(np.roll(points, -1, axis=0) - points, axis=1).sum()) if len(points) > 1 else 0.0


def simplified(points: np.ndarray, epsilon: float) -> np.ndarray:
    """Douglas-Peucker of a closed polygon, halved at the point farthest from the first."""
    if len(points) < 4 or epsilon <= 0:
        return points
    far = int(np.linalg.norm(points - points[0], axis=1).argmax())
    ring, keep = np.concatenate([points, points[:1]]), {0, far}
    todo = [(0, far), (far, len(points))]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        base, rest = ring[b] - ring[a], ring[a + 1 : b] - ring[a]
        length = np.linalg.norm(base)
        gap = np.abs(base[0] * rest[:, 1] - base[1] * rest[:, 0]) / length if length else np.linalg.norm(rest, axis=1)
        k = int(gap.argmax())
        if gap[k] > epsilon:
            keep.add(a + 1 + k)
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return points[sorted(keep)]


def boxes(part: np.ndarray, n: int) -> list[tuple[int, int, int, int, int, int]]:
    """(top, bottom, left, right, y, x) of each label 1 ... n: its box, ends excluded, and its first pixel in scan order."""
    if not n:
        return []
    y, x = np.nonzero(part)
    order = np.argsort(part[y, x], kind="stable")
    y, x = y[order], x[order]
    first = np.searchsorted(part[y, x], np.arange(1, n + 1))
    ends = (np.minimum.reduceat(y, first), np.maximum.reduceat(y, first) + 1, np.minimum.reduceat(x, first), np.maximum.reduceat(x, first) + 1, y[first], x[first])
    return list(zip(*(e.tolist() for e in ends), strict=True))


def outlines(mask: np.ndarray) -> list[tuple[np.ndarray, list[np.ndarray]]]:
    """Each component's outer border and its holes' borders.

    A hole is a component of empty pixels (without diagonals) that does not
    reach the image's edge; its border runs over the full pixels around it and
    belongs to the component that surrounds it. Each is looked at in its own
    box, so an image of many specks costs no more than their boxes.
    """
    part, n = labels(mask)
    empty, m = labels(255 * (mask == 0).astype(np.uint8), diagonal=False)
    out = []
    for i, (top, bottom, left, right, y, x) in enumerate(boxes(part, n), 1):
        out.append((border(part[top:bottom, left:right] == i, (y - top, x - left)) + (left, top), []))
    height, width = mask.shape
    for j, (top, bottom, left, right, y, x) in enumerate(boxes(empty, m), 1):
        if not top or not left or bottom == height or right == width:
            continue
        span = np.s_[top - 1 : bottom + 1, left - 1 : right + 1]
        hole, owner = empty[span] == j, int(part[y - 1, x])
        ring = _extreme(hole.astype(np.uint8), [(0, 0), *((dy, dx) for dy, dx in AROUND if not dy or not dx)], np.maximum, 0).astype(bool) & (part[span] == owner)
        first = np.argwhere(ring)[0]
        out[owner - 1][1].append(border(ring, (int(first[0]), int(first[1]))) + (left - 1, top - 1))
    return out


def without_small(mask: np.ndarray, least: float) -> np.ndarray:
    """Components whose outer border encloses `least` or more, filled; the rest goes."""
    out = np.zeros_like(mask)
    part, n = labels(mask)
    for i, (top, bottom, left, right, y, x) in enumerate(boxes(part, n), 1):
        mine = part[top:bottom, left:right] == i
        if closed_area(border(mine, (y - top, x - left))) < least:
            continue
        outside, _ = labels(255 * (np.pad(mine, 1) == 0).astype(np.uint8), diagonal=False)
        out[top:bottom, left:right][(outside != outside[0, 0])[1:-1, 1:-1]] = 255
    return out
