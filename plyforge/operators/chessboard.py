"""Camera calibration from images of a chessboard: corners found, boards' poses and the camera estimated.

An image is looked at in its own task: saddle points of the brightness, refined
below a pixel, grow into a grid. What leaves it are its corners. The camera
comes from all images at once: each image's homography (by direct linear
transformation) gives two rows of linear constraints on the camera, whose sums
have the closed form as their eigenvector (Zhang 2000). Levenberg-Marquardt then
fits camera, lens and poses; a pose is eliminated from its image's normal
equations in the task, so that sums of fixed size reach the driver and the poses
stay in a table, however many images there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plyforge.functions import images

from .segment import as_array
from .tables import written

IMAGES = 256  # looked at together
EXACT = 1e-6  # pixels of root mean square error at which corners count as explained

# ---- corners of one image


def slopes(grey: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    gy, gx = np.gradient(grey)
    return gx, gy


def smoothed(grey: np.ndarray, rounds: int = 3) -> np.ndarray:
    """Binomial smoothing, with the border repeated."""
    out = grey.astype(float)
    for _ in range(rounds):
        for axis in (0, 1):
            p = np.pad(out, [(1, 1) if a == axis else (0, 0) for a in (0, 1)], mode="edge")
            n = out.shape[axis]
            out = (np.take(p, range(n), axis) + 2 * out + np.take(p, range(2, n + 2), axis)) / 4
    return out


def saddles(grey: np.ndarray, share: float = 0.1, reach: int = 4) -> np.ndarray:
    """(n, 2) x, y of the greatest saddle strengths within `reach` pixels, of `share` of the greatest one or more."""
    gx, gy = slopes(smoothed(grey))
    gxy, gyy = np.gradient(gx, axis=0), np.gradient(gy, axis=0)
    strength = gxy * gxy - np.gradient(gx, axis=1) * gyy
    strength[: reach + 2], strength[-reach - 2 :], strength[:, : reach + 2], strength[:, -reach - 2 :] = 0, 0, 0, 0
    best = np.full(strength.shape, -np.inf)
    for dy in range(-reach, reach + 1):
        for dx in range(-reach, reach + 1):
            best = np.maximum(best, np.roll(strength, (dy, dx), (0, 1)))
    y, x = np.nonzero((strength == best) & (strength > share * max(strength.max(), 1e-12)))
    return np.stack([x, y], axis=1).astype(float)


def refined(grey: np.ndarray, points: np.ndarray, reach: int = 5, rounds: int = 20) -> np.ndarray:
    """Points moved to where the slopes around them are at right angles to the way from them, which holds at a corner."""
    gx, gy = slopes(smoothed(grey, 1))
    height, width = grey.shape
    dy, dx = np.mgrid[-reach : reach + 1, -reach : reach + 1]
    weight = np.exp(-(dx * dx + dy * dy) / (reach * reach / 2.0))
    out = points.copy()
    for i, p in enumerate(points):
        q = p.copy()
        for _ in range(rounds):
            x, y = q[0] + dx, q[1] + dy
            if x.min() < 0 or y.min() < 0 or x.max() >= width - 1 or y.max() >= height - 1:
                break
            x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
            fx, fy = x - x0, y - y0
            at = lambda g: (1 - fy) * ((1 - fx) * g[y0, x0] + fx * g[y0, x0 + 1]) + fy * ((1 - fx) * g[y0 + 1, x0] + fx * g[y0 + 1, x0 + 1])  # noqa: B023, E731
            u, v = at(gx), at(gy)
            a, b, c = (weight * u * u).sum(), (weight * u * v).sum(), (weight * v * v).sum()
            m, r = np.array([[a, b], [b, c]]), np.array([(weight * (u * u * x + u * v * y)).sum(), (weight * (u * v * x + v * v * y)).sum()])
            if abs(np.linalg.det(m)) < 1e-9 * max(a, c, 1e-9) ** 2:
                break
            new = np.linalg.solve(m, r)
            if np.abs(new - p).max() > reach:
                break
            done, q = np.abs(new - q).max() < 1e-3, new
            if done:
                break
        out[i] = q
    return out


def crossed(grey: np.ndarray, points: np.ndarray, radius: float = 5.0) -> np.ndarray:
    """Which points have two bright and two dark sectors around them, opposite ones alike."""
    turn = np.linspace(0, 2 * np.pi, 32, endpoint=False)
    x = np.clip(np.rint(points[:, :1] + radius * np.cos(turn)), 0, grey.shape[1] - 1).astype(int)
    y = np.clip(np.rint(points[:, 1:] + radius * np.sin(turn)), 0, grey.shape[0] - 1).astype(int)
    ring = smoothed(grey, 1)[y, x]
    bright = ring > (ring.max(axis=1, keepdims=True) + ring.min(axis=1, keepdims=True)) / 2
    return ((bright != np.roll(bright, 1, axis=1)).sum(axis=1) == 4) & ((bright == np.roll(bright, 16, axis=1)).mean(axis=1) > 0.75)


def grid(points: np.ndarray, across: int, down: int) -> np.ndarray | None:
    """The points in rows of `across`, or None where they form no such grid.

    From the point nearest to the middle, neighbours are sought where the points
    so far say that they lie. Rows run so that the next row is clockwise of the
    way along a row (as image axes are), from the end nearer to the image's origin.
    """
    if len(points) < across * down:
        return None
    seed = int(np.linalg.norm(points - np.median(points, axis=0), axis=1).argmin())
    away = points - points[seed]
    order = np.linalg.norm(away, axis=1).argsort()[1:9]
    u = away[order[0]]
    sine = lambda p: abs(u[0] * p[1] - u[1] * p[0]) / (np.linalg.norm(u) * np.linalg.norm(p) + 1e-12)
    v = next((away[k] for k in order[1:] if sine(away[k]) > 0.5), None)
    if v is None:
        return None
    found, todo, basis = {(0, 0): seed}, [(0, 0)], {(0, 0): (u, v)}
    while todo:
        i, j = todo.pop(0)
        u, v = basis[i, j]
        p = points[found[i, j]]
        for di, dj in ((1, 0), (-1, 0), (0, 1), (0, -1)):
            at, step = (i + di, j + dj), di * u + dj * v
            if at in found:
                continue
            gap = np.linalg.norm(points - (p + step), axis=1)
            k = int(gap.argmin())
            if gap[k] < 0.35 * np.linalg.norm(step) and k not in found.values():
                found[at] = k
                new = points[k] - p
                basis[at] = (new * di if di else u, new * dj if dj else v)
                todo.append(at)
    cells = np.array(list(found))
    low, size = cells.min(axis=0), np.ptp(cells, axis=0) + 1
    if sorted(size.tolist()) != sorted((across, down)) or len(found) != across * down:
        return None
    table = np.empty((size[0], size[1], 2))
    for (i, j), k in found.items():
        table[i - low[0], j - low[1]] = points[k]
    if (size[0], size[1]) == (across, down):  # the first index runs along a row
        table = table.transpose(1, 0, 2)
    along, onward = table[0, -1] - table[0, 0], table[-1, 0] - table[0, 0]
    if along[0] * onward[1] - along[1] * onward[0] < 0:
        table = table[::-1]
    if table[0, 0].sum() > table[-1, -1].sum():
        table = table[::-1, ::-1]
    return table.reshape(-1, 2)


def find_corners(image: np.ndarray, across: int, down: int) -> np.ndarray | None:
    """(across * down, 2) inner corners x, y of a chessboard, row after row; None where no whole board is seen."""
    grey = images.gray(image).astype(float)
    if min(grey.shape) < 16:
        return None
    points = saddles(grey)
    points = points[crossed(grey, points)] if len(points) else points
    return grid(refined(grey, points), across, down) if len(points) else None


def corners(rows: DataFrame, across: int, down: int, key: str = "path") -> DataFrame:
    """(key, idx, x, y, width, height): the corners of each image (Spark's image struct) that shows the whole board; others have no rows."""
    flat = rows.select(F.col(key).alias("key"), "image.height", "image.width", F.col("image.nChannels").alias("n"), "image.data")
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                found = find_corners(as_array(r.data, r.height, r.width, r.n), across, down)
                if found is not None:
                    yield pd.DataFrame({"key": r.key, "idx": range(len(found)), "x": found[:, 0], "y": found[:, 1], "width": r.width, "height": r.height})

    out = flat.mapInPandas(run, f"key {kind}, idx int, x double, y double, width int, height int")
    return out.withColumnRenamed("key", key)


# ---- the camera of all images


def board(across: int, down: int, square_mm: float) -> np.ndarray:
    return np.stack([np.tile(np.arange(across), down), np.repeat(np.arange(down), across)], axis=1) * float(square_mm)


def rotation(r: np.ndarray) -> np.ndarray:
    """Rodrigues' formula, for one rotation vector or an array of them."""
    angle = np.linalg.norm(r, axis=-1)[..., None]
    k = np.where(angle > 1e-12, r / np.where(angle > 1e-12, angle, 1.0), 0.0)
    cross, angle = np.zeros((*k.shape, 3)), angle[..., None]
    cross[..., [2, 0, 1], [1, 2, 0]] = k
    cross[..., [1, 2, 0], [2, 0, 1]] = -k
    return np.eye(3) + np.sin(angle) * cross + (1 - np.cos(angle)) * cross @ cross


def turn_of(m: np.ndarray) -> np.ndarray:
    """The rotation vector of the rotation nearest to m."""
    u, _, vt = np.linalg.svd(m)
    m = u @ np.diag([1, 1, np.linalg.det(u @ vt)]) @ vt
    angle = np.arccos(np.clip((np.trace(m) - 1) / 2, -1, 1))
    if angle < 1e-9:
        return np.zeros(3)
    if np.pi - angle < 1e-6:
        axis = np.sqrt(np.maximum((np.diag(m) + 1) / 2, 0))
        k = int(axis.argmax())
        return angle * np.where(np.arange(3) == k, axis[k], m[k] / (2 * axis[k]))
    return angle / (2 * np.sin(angle)) * np.array([m[2, 1] - m[1, 2], m[0, 2] - m[2, 0], m[1, 0] - m[0, 1]])


def turns_of(m: np.ndarray) -> np.ndarray:
    """turn_of() of an array of matrices."""
    u, _, vt = np.linalg.svd(m)
    u[..., :, 2] *= np.linalg.det(u @ vt)[..., None]
    near = u @ vt
    angle = np.arccos(np.clip((np.trace(near, axis1=-2, axis2=-1) - 1) / 2, -1, 1))
    plain = (angle >= 1e-9) & (np.pi - angle >= 1e-6)
    axis = np.stack([near[:, 2, 1] - near[:, 1, 2], near[:, 0, 2] - near[:, 2, 0], near[:, 1, 0] - near[:, 0, 1]], axis=1)
    out = axis * (angle / np.where(plain, 2 * np.sin(angle), 1.0))[:, None]
    for i in np.flatnonzero(~plain):
        out[i] = turn_of(m[i])
    return out


def homography(plane: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """By direct linear transformation, both sides centred and scaled first. seen: (images, corners, 2); a matrix an image."""

    def norm(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c = p.mean(axis=-2, keepdims=True)
        s = np.sqrt(2) / np.maximum(np.linalg.norm(p - c, axis=-1).mean(axis=-1), 1e-12)
        t = np.zeros((*s.shape, 3, 3))
        t[..., 0, 0], t[..., 1, 1], t[..., 2, 2] = s, s, 1.0
        t[..., :2, 2] = -s[..., None] * c[..., 0, :]
        return (p - c) * s[..., None, None], t

    (p, tp), (q, tq) = norm(plane), norm(seen)
    n = len(p)
    row = np.column_stack([p, np.ones(n)])
    a = np.zeros((len(q), 2 * n, 9))
    a[:, :n, :3], a[:, n:, 3:6] = row, row
    a[:, :n, 6:], a[:, n:, 6:] = -q[..., :1] * row, -q[..., 1:] * row
    h = np.linalg.svd(a, full_matrices=2 * n < 9)[2][:, -1].reshape(-1, 3, 3)
    return np.linalg.inv(tq) @ h @ tp


def constraints(h: np.ndarray) -> np.ndarray:
    """The two rows that each image's homography demands of the camera's conic."""

    def v(i: int, j: int) -> np.ndarray:
        a, b = h[..., i].T, h[..., j].T
        return np.stack([a[0] * b[0], a[0] * b[1] + a[1] * b[0], a[1] * b[1], a[2] * b[0] + a[0] * b[2], a[2] * b[1] + a[1] * b[2], a[2] * b[2]], axis=-1)

    return np.stack([v(0, 1), v(0, 0) - v(1, 1)], axis=-2)


def project(theta: np.ndarray, pose: np.ndarray, plane: np.ndarray) -> np.ndarray:
    """Pixels of board points. theta: fx fy cx cy k1 k2 p1 p2 k3; pose: a rotation vector and a shift, or an array of them."""
    fx, fy, cx, cy, k1, k2, p1, p2, k3 = theta
    p = plane @ np.swapaxes(rotation(pose[..., :3])[..., :2], -1, -2) + pose[..., None, 3:]
    x, y = p[..., 0] / p[..., 2], p[..., 1] / p[..., 2]
    r = x * x + y * y
    radial = 1 + r * (k1 + r * (k2 + r * k3))
    return np.stack([fx * (x * radial + 2 * p1 * x * y + p2 * (r + 2 * x * x)) + cx, fy * (y * radial + p1 * (r + 2 * y * y) + 2 * p2 * x * y) + cy], axis=-1)


def normal_parts(theta: np.ndarray, pose: np.ndarray, plane: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each image's residuals and their derivatives by camera and pose, from central differences. pose: (images, 6)."""
    flat = lambda p: p.reshape(len(pose), -1)
    a, b = np.empty((len(pose), seen[0].size, 9)), np.empty((len(pose), seen[0].size, 6))
    for k in range(9):
        h = 1e-6 * max(abs(theta[k]), 1.0)
        d = np.where(np.arange(9) == k, h, 0.0)
        a[..., k] = flat(project(theta + d, pose, plane) - project(theta - d, pose, plane)) / (2 * h)
    for k in range(6):
        h = 1e-6 * np.maximum(np.abs(pose[:, k : k + 1]), 1.0)
        d = np.where(np.arange(6) == k, h, 0.0)
        b[..., k] = flat(project(theta, pose + d, plane) - project(theta, pose - d, plane)) / (2 * h)
    return flat(project(theta, pose, plane) - seen), a, b


def reduced(theta: np.ndarray, pose: np.ndarray, plane: np.ndarray, seen: np.ndarray, damping: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each image's part of the camera's normal equations with its pose eliminated: matrix, gradient, cost; and how the pose follows a camera step."""
    rest, a, b = normal_parts(theta, pose, plane, seen)
    bt, right = np.swapaxes(b, 1, 2), np.concatenate([rest[..., None], a], axis=2)
    c = bt @ b
    c[:, np.arange(6), np.arange(6)] *= 1 + damping
    solve = np.linalg.pinv(c) @ (bt @ right)
    both = np.swapaxes(a, 1, 2) @ right - np.swapaxes(a, 1, 2) @ b @ solve
    return both[..., 1:], both[..., 0], (rest * rest).sum(axis=1), solve[..., 0], solve[..., 1:]


@dataclass
class Camera:
    """camera_matrix and dist_coeffs as profiles hold them, the root mean square error in pixels, and (image, pose) of the images used."""

    camera_matrix: list[list[float]]
    dist_coeffs: list[float]
    rms: float
    n_images: int
    poses: DataFrame


def summed(parts: DataFrame, size: int) -> np.ndarray:
    """Element by element sums of rows (v array<double>); `size` numbers reach the driver."""
    got = parts.select(F.posexplode("v").alias("k", "x")).groupBy("k").agg(F.sum("x").alias("x")).collect()
    out = np.zeros(size)
    for r in got:
        out[r.k] = r.x
    return out


def numbers(column: pa.Array) -> np.ndarray:
    """Lists of equal length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def stacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray | None]]:
    """Up to IMAGES rows at a time: the rows, their corners (images, corners, 2) and, where there are any, poses (images, 6)."""
    for whole in batches:
        for k in range(0, len(whole), IMAGES):
            b = whole.slice(k, IMAGES)
            column = {name: b.column(i) for i, name in enumerate(b.schema.names)}
            yield b, np.stack([numbers(column["x"]), numbers(column["y"])], axis=2), numbers(column["pose"]) if "pose" in column else None


def lists(m: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(m.ravel()))


def with_pose(b: pa.RecordBatch, pose: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*b.columns[:3], lists(pose)], ["image", "x", "y", "pose"])


def vector(v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([lists(v.reshape(1, -1))], ["v"])


def calibrate(found: DataFrame, across: int, down: int, square_mm: float, image: str = "path", most_rounds: int = 30, tolerance: float = 1e-10) -> Camera:
    """The camera that explains the corners (image, idx, x, y) of three or more images best.

    Images without all corners, or with one that is not finite, are left out; so are rows of a null
    image. Fewer than three images are an error, as are poses that leave the camera open (boards all parallel).
    """
    plane, n = board(across, down, square_mm), across * down
    whole = found.filter(f"`{image}` is not null and abs(x) < double('inf') and abs(y) < double('inf')").groupBy(F.col(image).alias("image"))
    rows = whole.agg(F.array_sort(F.collect_list(F.struct("idx", "x", "y"))).alias("p"), F.countDistinct("idx").alias("d")).filter((F.size("p") == n) & (F.col("d") == n))
    rows = written(rows.select("image", F.col("p.x").alias("x"), F.col("p.y").alias("y")))
    count = rows.count()
    if count < 3:
        raise ValueError(f"{count} images show the whole board; three are needed")
    kind = rows.schema["image"].dataType.simpleString()

    def closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((6, 6))
        for _, seen, _ in stacked(batches):
            h = homography(plane, seen)
            v = constraints(h / np.linalg.norm(h, axis=(1, 2), keepdims=True)).reshape(-1, 6)
            total += v.T @ v
        yield vector(total)

    # pixels in units of the image's spread keep the six sums of like size
    middle, unit = about_pixels(rows)
    scaled = rows.select("image", F.transform("x", lambda p: (p - middle[0]) / unit).alias("x"), F.transform("y", lambda p: (p - middle[1]) / unit).alias("y"))
    total = summed(scaled.mapInArrow(closed, "v array<double>"), 36).reshape(6, 6)
    fx, fy, cx, cy = camera_of(np.linalg.eigh(total)[1][:, 0])
    theta = np.array([fx * unit, fy * unit, cx * unit + middle[0], cy * unit + middle[1], 0, 0, 0, 0, 0])

    def first_pose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = np.linalg.inv(np.array([[theta[0], 0, theta[2]], [0, theta[1], theta[3]], [0, 0, 1]]))
        for b, seen, _ in stacked(batches):
            m = back @ homography(plane, seen)
            m /= ((np.linalg.norm(m[:, :, 0], axis=1) + np.linalg.norm(m[:, :, 1], axis=1)) / 2 * np.where(m[:, 2, 2] < 0, -1.0, 1.0))[:, None, None]
            turns = turns_of(np.stack([m[:, :, 0], m[:, :, 1], np.cross(m[:, :, 0], m[:, :, 1])], axis=2))
            yield with_pose(b, np.concatenate([turns, m[:, :, 2]], axis=1))

    state = written(rows.mapInArrow(first_pose, f"image {kind}, x array<double>, y array<double>, pose array<double>"))

    def equations(table: DataFrame, at: np.ndarray, damping: float) -> tuple[np.ndarray, np.ndarray, float]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(91)
            for _, seen, pose in stacked(batches):
                s, g, cost, _, _ = reduced(at, pose, plane, seen, damping)
                out += np.concatenate([s.sum(axis=0).ravel(), g.sum(axis=0), [cost.sum()]])
            yield vector(out)

        total = summed(table.mapInArrow(run, "v array<double>"), 91)
        return total[:81].reshape(9, 9), total[81:90], total[90]

    def following(table: DataFrame, at: np.ndarray, step: np.ndarray, damping: float) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b, seen, pose in stacked(batches):
                _, _, _, own, by = reduced(at, pose, plane, seen, damping)
                yield with_pose(b, pose - own - by @ step)

        return written(table.mapInArrow(run, table.schema))

    damping = 1e-3
    s, g, cost = equations(state, theta, damping)
    for _ in range(most_rounds):
        size = np.sqrt(np.maximum(np.diag(s), 1e-300))
        step = -np.linalg.lstsq(s / np.outer(size, size) + damping * np.eye(9), g / size, rcond=None)[0] / size
        moved = following(state, theta, step, damping)
        lower = max(damping / 10, 1e-12)
        s_new, g_new, cost_new = equations(moved, theta + step, lower)
        if np.isfinite(cost_new) and cost_new <= cost:
            settled = cost - cost_new <= tolerance * cost or cost_new <= EXACT * EXACT * count * n
            state, theta, s, g, cost, damping = moved, theta + step, s_new, g_new, cost_new, lower
            if settled:
                break
        elif damping > 1e8:
            break
        else:
            damping *= 10
            s, g, _ = equations(state, theta, damping)
    fx, fy, cx, cy, *lens = theta.tolist()
    return Camera([[fx, 0.0, cx], [0.0, fy, cy], [0.0, 0.0, 1.0]], lens, float(np.sqrt(cost / (count * n))), count, state.select(F.col("image").alias(image), "pose"))


def about_pixels(rows: DataFrame) -> tuple[list[float], float]:
    """The corners' middle and half their larger extent."""
    r = rows.agg(*[f(g(c)) for c in "xy" for f, g in ((F.min, F.array_min), (F.max, F.array_max))]).first()
    return [(r[0] + r[1]) / 2, (r[2] + r[3]) / 2], max(r[1] - r[0], r[3] - r[2], 1e-9) / 2


def camera_of(b: np.ndarray) -> tuple[float, float, float, float]:
    """fx, fy, cx, cy of the conic's six numbers (Zhang's closed form; the skew is taken as none)."""
    b11, b12, b22, b13, b23, b33 = b * (np.sign(b[0]) or 1.0)
    d = b11 * b22 - b12 * b12
    if d <= 0 or b11 <= 0:
        raise ValueError("the boards' poses leave the camera open")
    cy = (b12 * b13 - b11 * b23) / d
    scale = b33 - (b13 * b13 + cy * (b12 * b13 - b11 * b23)) / b11
    if scale <= 0:
        raise ValueError("the boards' poses leave the camera open")
    fx, fy = np.sqrt(scale / b11), np.sqrt(scale * b11 / d)
    return float(fx), float(fy), float(-b13 * fx * fx / scale), float(cy)
