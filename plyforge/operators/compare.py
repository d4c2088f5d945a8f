"""Distances between contours, clouds and surfaces, and their statistics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from . import boxes
from .tables import written


def selected(rows: DataFrame, value: str, ranks: list[int], total: int, most: int = 100_000) -> list[float]:
    """The values at ranks (from 0) among `total` rows without nulls, by rounds of counted ranges.

    A sketch proposes a narrow range around each rank, a pass counts the rows below and up to it, and a range that holds
    the rank stands. When a range has `most` rows or fewer, one task sorts these; one of equal values is the answer.
    Proposals that don't narrow are halved by value, so it ends whatever the sketch says.
    """
    v = F.col(value).cast("double")
    low, high = rows.agg(F.min(v), F.max(v)).first()
    state = {r: [low, high, 0, total] for r in ranks}  # the range (ends included), rows below it, rows in it

    def counted(ranges: dict[int, tuple[float, float]]) -> dict[int, tuple[int, int]]:
        got = rows.agg(*[F.count(F.when(test, 1)) for lo, hi in ranges.values() for test in (v < lo, v <= hi)]).first()
        return {r: (got[2 * i], got[2 * i + 1]) for i, r in enumerate(ranges)}

    while wide := [r for r, (lo, hi, _, n) in state.items() if n > most and lo < hi]:
        share = {r: (r - state[r][2]) / state[r][3] for r in wide}
        around = [F.percentile_approx(F.when((v >= state[r][0]) & (v <= state[r][1]), v), F.array(F.lit(max(0.0, share[r] - 0.0005)), F.lit(min(1.0, share[r] + 0.0005))), F.lit(10_000)) for r in wide]
        asked = dict(zip(wide, (tuple(x) for x in rows.agg(*around).first()), strict=True))
        for _ in range(2):
            for r, (below, upto) in counted(asked).items():
                lo, hi = asked[r]
                if below <= r < upto and upto - below < state[r][3]:
                    state[r] = [lo, hi, below, upto - below]
                    asked = {k: x for k, x in asked.items() if k != r}
            asked = {r: (state[r][0], middle) if side else (middle, state[r][1]) for r in asked for middle, side in [(state[r][0] / 2 + state[r][1] / 2, True)]}
            if not asked:
                break
        for r in asked:  # the lower half doesn't hold it or is all of it: the range above it
            lo, hi, _, _ = state[r]
            above = rows.filter(v > lo / 2 + hi / 2).agg(F.min(v)).first()[0]
            below, upto = counted({r: (above, hi)})[r]
            if not (below <= r < upto and above > lo):
                raise RuntimeError(f"no range around rank {r}")
            state[r] = [above, hi, below, upto - below]
    held = {r: x for r, x in state.items() if x[0] < x[1]}
    own = {}
    if held:
        lists = rows.agg(*[F.array_sort(F.collect_list(F.when((v >= lo) & (v <= hi), v)))[r - below].alias(f"r{r}") for r, (lo, hi, below, _) in held.items()]).first()
        own = dict(zip(held, lists, strict=True))
    return [own.get(r, state[r][0]) for r in ranks]


def distance_stats(rows: DataFrame, value: str, *by: str, most: int = 100_000) -> DataFrame:
    """Mean, maximum, population deviation, median, 95th and 99th percentile (interpolated), rounded to 6; zeros without rows.

    With `by`, a group's distinct values meet in one task. Without, no task sorts more than `most` values (selected()).
    """
    names = {"median": 0.5, "p95": 0.95, "p99": 0.99}
    basic = {"mean": F.avg(value), "max": F.max(value), "std": F.stddev_pop(value)}
    if by:
        q = F.percentile(value, F.array(*[F.lit(x) for x in names.values()]))
        out = rows.groupBy(*by).agg(*[c.alias(n) for n, c in basic.items()], q.alias("_q"))
        cols = {n: F.col(n) for n in basic} | {n: F.get("_q", F.lit(i)) for i, n in enumerate(names)}
        return out.select(*by, *[F.round(F.coalesce(c, F.lit(0.0)), 6).alias(n) for n, c in cols.items()])
    told = rows.filter(F.col(value).isNotNull())
    row = told.agg(F.count("*").alias("n"), *[c.alias(n) for n, c in basic.items()]).first()
    found = dict.fromkeys(names, 0.0)
    if row.n:
        places = {n: x * (row.n - 1) for n, x in names.items()}
        ranks = sorted({r for p in places.values() for r in (int(p), min(int(p) + 1, row.n - 1))})
        at = dict(zip(ranks, selected(told, value, ranks, row.n, most), strict=True))
        found = {n: at[int(p)] + (at[min(int(p) + 1, row.n - 1)] - at[int(p)]) * (p - int(p)) for n, p in places.items()}
    values = {n: float(row[n] or 0.0) for n in basic} | found
    return rows.sparkSession.createDataFrame([tuple(values.values())], ", ".join(f"{n} double" for n in values)).select(*[F.round(n, 6).alias(n) for n in values])


def within_tolerance(rows: DataFrame, value: str, tolerance: float = 0.2, *by: str) -> DataFrame:
    """Percentage of values up to the tolerance, rounded to 2; 100 without rows."""
    share = F.avg(F.when(F.col(value) <= tolerance, 1.0).otherwise(0.0)) * 100
    return rows.groupBy(*by).agg(F.round(F.coalesce(share, F.lit(100.0)), 2).alias("within_tolerance_pct"))


def hausdorff(a: DataFrame, b: DataFrame, keys: list[str], points: str = "points") -> DataFrame:
    """Symmetric Hausdorff distance of the contours with equal keys; those of fewer than two points are left out.

    Each pair's two point arrays meet in one row and the distances are folded
    there, so nothing but contours is shuffled.
    """
    enough = lambda df, name: df.filter(F.size(points) >= 2).select(*keys, F.col(points).alias(name))

    def one_way(p: str, q: str):
        near = lambda x: F.array_min(F.transform(q, lambda y: (x["x"] - y["x"]) * (x["x"] - y["x"]) + (x["y"] - y["y"]) * (x["y"] - y["y"])))
        return F.array_max(F.transform(p, near))

    both = enough(a, "_a").join(enough(b, "_b"), keys)
    return both.select(*keys, F.round(F.sqrt(F.greatest(one_way("_a", "_b"), one_way("_b", "_a"))), 6).alias("hausdorff"))


def nearest(points: DataFrame, targets: DataFrame, axes: list[str], point_id: str, target_id: str) -> DataFrame:
    """(point_id, target_id, distance): each point's nearest target; ties go to the smallest target id.

    Points and targets meet in a hierarchy of boxes (see boxes). Targets of one
    place count once, by their smallest id. Rows without finite coordinates take
    no part; without targets there are no rows.
    """
    found = targets.select(F.col(target_id).alias("id"), *[(F.col(a).cast("double") + 0.0).alias(f"c{i}") for i, a in enumerate(axes)])
    names = [f"c{i}" for i in range(len(axes))]
    held = found.filter(boxes.finite([F.col(c) for c in names])).groupBy(*names).agg(F.min("id").alias("id"))
    asked = points.select(F.col(point_id).alias("id"), *[F.col(a).cast("double").alias(f"c{i}") for i, a in enumerate(axes)]).filter(boxes.finite([F.col(c) for c in names]))

    def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return np.sqrt(sum((p[:, None, i] - q[None, :, i]) ** 2 for i in range(len(axes))))

    out = meet(asked, held, [names], apart)
    return out.select(F.col("id").alias(point_id), F.col("target").alias(target_id), "distance")


def meet(points: DataFrame, targets: DataFrame, corners: list[list[str]], pairwise, needed: str = "") -> DataFrame:
    """(id, target, distance) of points (id, c0 ...) and targets (id and each corner's coordinates); needed: the error where there is no target."""
    dims = len(corners[0])
    targets, points = written(targets), written(points)  # each is read three times: for its extent, to sample its order, to be dealt
    leaves = boxes.packed(targets, corners, boxes.LEAF)
    blocks = boxes.packed(points, [[f"c{i}" for i in range(dims)]], boxes.BLOCK)
    if needed and leaves.isEmpty():
        raise ValueError(needed)
    if leaves.isEmpty() or blocks.isEmpty():
        return points.select("id").limit(0).withColumns({"target": F.lit(None).cast(targets.schema["id"].dataType), "distance": F.lit(0.0)})
    return boxes.nearest_of(blocks, leaves, dims, pairwise)


def triangle_distance(p: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Distances of points (..., 3) to triangles (..., 3 each): to the plane where the foot lies inside, else to the nearest edge.

    Points and triangles broadcast; what a triangle alone decides is computed once for all points.
    """
    p, a, b, c = ([x[..., i] for i in range(3)] for x in (p, a, b, c))
    minus = lambda u, v: [x - y for x, y in zip(u, v, strict=True)]
    dot = lambda u, v: u[0] * v[0] + u[1] * v[1] + u[2] * v[2]
    cross = lambda u, v: [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    ab, ac, ap = minus(b, a), minus(c, a), minus(p, a)
    normal = cross(ab, ac)
    squared = dot(normal, normal)
    safe = np.where(squared > 0, squared, 1.0)
    v, w = dot(cross(ap, ac), normal) / safe, dot(cross(ab, ap), normal) / safe
    inside = (squared > 0) & (v >= 0) & (w >= 0) & (v + w <= 1)
    plane = np.abs(dot(ap, normal)) / np.sqrt(safe)

    def edge(s: list[np.ndarray], d: list[np.ndarray], sp: list[np.ndarray]) -> np.ndarray:
        n = dot(d, d)
        t = np.clip(dot(sp, d) / np.where(n > 0, n, 1.0), 0, 1)
        rest = [x - t * y for x, y in zip(sp, d, strict=True)]
        return np.sqrt(dot(rest, rest))

    bc, ca = minus(c, b), minus(a, c)
    return np.where(inside, plane, np.minimum(np.minimum(edge(a, ab, ap), edge(b, bc, minus(p, b))), edge(c, ca, minus(p, c))))


def surface_distance(points: DataFrame, triangles: DataFrame, point_id: str = "vid") -> DataFrame:
    """(point_id, distance) of points (x, y, z) to the nearest of the triangles (ax ... cz).

    Points and triangles meet in a hierarchy of boxes (see boxes), near or far
    alike. Equal triangles count once. Points and triangles without finite
    coordinates take no part; no triangle at all is an error.
    """
    corners = [[f"{v}{x}" for x in "xyz"] for v in "abc"]
    cols = [c for corner in corners for c in corner]
    rows = triangles.select(*[F.col(c).cast("double").alias(c) for c in cols]).filter(boxes.finite([F.col(c) for c in cols])).distinct().withColumn("id", F.xxhash64(*cols))
    asked = points.select(F.col(point_id).alias("id"), *[F.col(x).cast("double").alias(f"c{i}") for i, x in enumerate("xyz")]).filter(boxes.finite([F.col(f"c{i}") for i in range(3)]))
    def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return triangle_distance(p[:, None], q[:, :3], q[:, 3:6], q[:, 6:])

    return meet(asked, rows, corners, apart, "no triangles").select(F.col("id").alias(point_id), "distance")
