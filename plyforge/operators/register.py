"""Rigid registration: Kabsch by sums, and iterative closest points from many starts."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import boxes, meshes
from .tables import written

START_BITS = 48  # of a block's label below the number of its start


def kabsch_2d(pairs: DataFrame, *by: str) -> DataFrame:
    """(by, angle, tx, ty, error): the rotation and shift that bring (sx, sy) nearest to (tx, ty), and the mean squared rest.

    One aggregate of sums: with both centres taken off, the angle is
    atan2(sum of cross products, sum of dot products).
    """
    s = pairs.groupBy(*by).agg(
        F.count("*").cast("double").alias("n"), *[F.sum(c).alias(c) for c in ("sx", "sy", "tx", "ty")],
        F.sum(F.col("sx") * F.col("ty") - F.col("sy") * F.col("tx")).alias("cross"), F.sum(F.col("sx") * F.col("tx") + F.col("sy") * F.col("ty")).alias("dot"),
        F.sum(F.col("sx") * F.col("sx") + F.col("sy") * F.col("sy") + F.col("tx") * F.col("tx") + F.col("ty") * F.col("ty")).alias("sq"),
    )
    n = F.col("n")
    cross = F.col("cross") - (F.col("sx") * F.col("ty") - F.col("sy") * F.col("tx")) / n
    dot = F.col("dot") - (F.col("sx") * F.col("tx") + F.col("sy") * F.col("ty")) / n
    rest = F.col("sq") - (F.col("sx") * F.col("sx") + F.col("sy") * F.col("sy") + F.col("tx") * F.col("tx") + F.col("ty") * F.col("ty")) / n
    a = F.col("angle")
    rows = s.withColumn("angle", F.atan2(cross, dot)).withColumn("error", F.greatest(F.lit(0.0), rest - 2 * F.sqrt(cross * cross + dot * dot)) / n)
    return rows.select(*by, "angle", ((F.col("tx") - (F.cos(a) * F.col("sx") - F.sin(a) * F.col("sy"))) / n).alias("shift_x"), ((F.col("ty") - (F.sin(a) * F.col("sx") + F.cos(a) * F.col("sy"))) / n).alias("shift_y"), "error")


def kabsch(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The 4 x 4 rigid motion (no reflection) that brings paired rows of source nearest to target."""
    d = source.shape[1]
    s, t = source.mean(axis=0), target.mean(axis=0)
    u, _, v = np.linalg.svd((source - s).T @ (target - t))
    flip = np.eye(d)
    flip[-1, -1] = np.sign(np.linalg.det(v.T @ u.T)) or 1.0
    out = np.eye(4)
    out[:d, :d] = v.T @ flip @ u.T
    out[:d, 3] = t - out[:d, :d] @ s
    return out


def kabsch_3d(pairs: DataFrame) -> np.ndarray:
    """The rigid motion of all pairs (sx, sy, sz, tx, ty, tz), from 15 sums that are all the driver gets."""
    axes = "xyz"
    sums = [F.count("*").alias("n"), *[F.sum(f"{k}{a}").alias(f"{k}{a}") for k in "st" for a in axes], *[F.sum(F.col(f"s{a}") * F.col(f"t{b}")).alias(f"{a}{b}") for a in axes for b in axes]]
    r = pairs.agg(*sums).first()
    return motion_of(r["n"], *(np.array([r[f"{k}{a}"] for a in axes]) for k in "st"), np.array([[r[f"{a}{b}"] for b in axes] for a in axes]))


def motion_of(n: int, s: np.ndarray, t: np.ndarray, st: np.ndarray) -> np.ndarray:
    """The 4 x 4 rigid motion of n pairs of d coordinates from sums of sources, of targets and of their products."""
    d = len(s)
    u, _, v = np.linalg.svd(st - np.outer(s, t) / n)
    flip = np.diag([*[1.0] * (d - 1), np.sign(np.linalg.det(v.T @ u.T)) or 1.0])
    out = np.eye(4)
    out[:d, :d] = v.T @ flip @ u.T
    out[:d, 3] = (t - out[:d, :d] @ s) / n
    return out


def moved(points: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    return points @ matrix[:3, :3].T + matrix[:3, 3]


def nearest_rows(points: np.ndarray, targets: np.ndarray, step: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Index and distance of each point's nearest target, in blocks of bounded size."""
    which, squared = np.empty(len(points), np.int64), (targets * targets).sum(axis=1)
    for k in range(0, len(points), step):
        which[k : k + step] = (squared - 2 * points[k : k + step] @ targets.T).argmin(axis=1)
    return which, np.linalg.norm(points - targets[which], axis=1)


def icp(source: np.ndarray, target: np.ndarray, most: int = 50, tolerance: float = 0.001, constrain_z: bool = True, initial: np.ndarray | None = None) -> tuple[np.ndarray, list[float], bool]:
    """Motion, mean errors and whether it settled: centres (or the initial motion) first, then nearest neighbours and Kabsch in turn.

    constrain_z turns about Z and shifts in X and Y alone.
    """
    d = 2 if constrain_z else 3
    total = np.eye(4) if initial is None else np.array(initial, float)
    if initial is None:
        total[:d, 3] = (target.mean(axis=0) - source.mean(axis=0))[:d]
    now, errors = moved(source, total), []
    for _ in range(most):
        which, gap = nearest_rows(now[:, :d], target[:, :d])
        errors.append(float(gap.mean()))
        if len(errors) > 1 and abs(errors[-2] - errors[-1]) < tolerance:
            return total, errors, True
        step = kabsch(now[:, :d], target[which][:, :d])
        now, total = moved(now, step), step @ total
    errors.append(float(nearest_rows(now[:, :d], target[:, :d])[1].mean()))
    return total, errors, False


def sample(points: DataFrame, key: str, n: int | None) -> DataFrame:
    """n points by the order of a hash of their key; all where n is None or there are no more."""
    return points if n is None else points.orderBy(F.xxhash64(key), key).limit(n)


RUN = "angle long, error double, iterations int, converged boolean, matrix array<array<double>>"


def turned(center: np.ndarray, degrees: float) -> np.ndarray:
    """The rotation about the vertical line through the centre."""
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    out = np.eye(4)
    out[:2, :2] = [[c, -s], [s, c]]
    out[:3, 3] = center - out[:3, :3] @ center
    return out


def align_from_starts(source: DataFrame, target: DataFrame, step_degrees: int = 15, most: int = 50, subsample: int | None = 5000, key: str = "vid", tolerance: float = 0.001, constrain_z: bool = False, most_local: int = 100_000) -> DataFrame:
    """(angle, error, iterations, converged, matrix) of a closest-point run from each rotation about the source's centre.

    Source points are a sample of at most subsample rows. Where sample and target
    have no more than most_local points each, a start is a row with both and one
    task runs it; else all starts go on together, each round one nearest-neighbour
    search of all their points by Spark. Both give the same motions.
    """
    center = np.array(source.agg(F.avg("x"), F.avg("y"), F.avg("z")).first(), float)
    starts = [(degrees, turned(center, degrees), None) for degrees in range(0, 360, step_degrees)] if not np.isnan(center).any() else []
    return runs_from(source, target, starts, most, subsample, key, tolerance, constrain_z, most_local)


def align(source: DataFrame, target: DataFrame, initial: np.ndarray | None = None, most: int = 50, subsample: int | None = 5000, key: str = "vid", tolerance: float = 0.001, constrain_z: bool = True, most_local: int = 100_000):
    """The row (angle 0, error, iterations, converged, matrix) of one closest-point run, from an initial 4 x 4 motion or the clouds' centres."""
    return runs_from(source, target, [(0, np.eye(4), initial)], most, subsample, key, tolerance, constrain_z, most_local).first()


def runs_from(source: DataFrame, target: DataFrame, starts: list[tuple], most: int, subsample: int | None, key: str, tolerance: float, constrain_z: bool, most_local: int) -> DataFrame:
    """RUN rows of starts (angle, motion, initial motion or None for the centres)."""
    spark = source.sparkSession
    some = written(sample(source, key, subsample).select(F.col(key).alias("id"), "x", "y", "z"))
    n, m = some.count(), target.count()
    if not n or not m:
        raise ValueError("both clouds need points")
    if max(n, m) > most_local:
        return spark.createDataFrame(together(some, target.select(F.col(key).alias("id"), "x", "y", "z"), starts, most, tolerance, constrain_z), RUN)
    whole = lambda df, name, by: df.agg(F.array_sort(F.collect_list(F.struct(by, "x", "y", "z"))).alias(name))  # noqa: E731  one row of most_local points at most
    rows = spark.createDataFrame([(a, s.tolist(), None if i is None else np.asarray(i, float).tolist()) for a, s, i in starts], "angle long, start array<array<double>>, initial array<array<double>>").repartition(len(starts))
    both = rows.crossJoin(F.broadcast(whole(some, "s", "id"))).crossJoin(F.broadcast(whole(target, "t", key)))  # one row each
    flat = both.select("angle", "start", "initial", *[F.col(p)[x].alias(f"{p}{x}") for p in "st" for x in "xyz"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                src, dst = np.column_stack([r.sx, r.sy, r.sz]).astype(float), np.column_stack([r.tx, r.ty, r.tz]).astype(float)
                start = np.stack(r.start)
                motion, errors, settled = icp(moved(src, start), dst, most, tolerance, constrain_z, None if r.initial is None else np.stack(r.initial))
                out.append((r.angle, errors[-1], len(errors) - 1, settled, (motion @ start).tolist()))
            yield pd.DataFrame(out, columns=["angle", "error", "iterations", "converged", "matrix"])

    return flat.mapInPandas(run, RUN)


def together(some: DataFrame, target: DataFrame, starts: list[tuple], most: int, tolerance: float, constrain_z: bool) -> list[tuple]:
    """Rows of RUN; the driver holds a matrix and the sums of its pairs a start.

    Blocks of source points are cut once, as a motion keeps them together; the
    target's boxes are built once.
    """
    d = 2 if constrain_z else 3
    named = lambda df: df.select("id", *[F.col(x).cast("double").alias(f"c{i}") for i, x in enumerate("xyz")])
    coords = [f"c{i}" for i in range(d)]
    finite = boxes.finite([F.col(f"c{i}") for i in range(3)])
    held = named(target).filter(finite)
    leaves = boxes.packed(written(held.groupBy(*coords).agg(F.min("id").alias("id"))), [coords], boxes.LEAF)
    blocks = boxes.packed(named(some).filter(finite), [["c0", "c1", "c2"]], boxes.BLOCK)
    tree = boxes.levels(leaves, d)
    means = [np.array(df.agg(*[F.avg(f"c{i}") for i in range(3)]).first(), float) for df in (named(some).filter(finite), held)]
    total = []
    for _, start, initial in starts:
        first = np.eye(4) if initial is None else np.asarray(initial, float)
        if initial is None:
            first[:d, 3] = (means[1] - moved(means[0][None], start)[0])[:d]
        total.append(first @ start)
    errors, settled, open_ = [[] for _ in starts], [False] * len(starts), list(range(len(starts)))
    bounds = [f"{side}{i}" for side in ("lo", "hi") for i in range(d)]
    kind = blocks.schema["ids"].dataType.simpleString()

    def placed(motions: dict[int, np.ndarray]) -> DataFrame:
        """The blocks of every open start where its motion puts them."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                label, ids, data = (batch.column(batch.schema.get_field_index(c)) for c in ("label", "ids", "data"))
                out: list[list] = [[], [], [], []]
                for r in range(len(batch)):
                    points = data[r].values.to_numpy(zero_copy_only=False).reshape(-1, 3)
                    for k, motion in motions.items():
                        p = moved(points, motion)[:, :d]
                        for column, v in zip(out, ((k << START_BITS) + label[r].as_py(), np.concatenate([p.min(axis=0), p.max(axis=0)]), ids[r].as_py(), p.ravel()), strict=True):
                            column.append(v)
                box = np.array(out[1]).reshape(len(out[1]), 2 * d)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), *[pa.array(np.ascontiguousarray(box[:, i])) for i in range(2 * d)], pa.array(out[2], ids.type), pa.array(out[3], pa.list_(pa.float64()))], ["label", *bounds, "ids", "data"])

        return written(blocks.mapInArrow(run, f"label long, {', '.join(f'{b} double' for b in bounds)}, ids {kind}, data array<double>"))

    apart = lambda p, q: np.sqrt(sum((p[:, None, i] - q[None, :, i]) ** 2 for i in range(d)))
    p, q = ([F.col(c)[i] for i in range(d)] for c in ("point", "at"))
    sums = [F.count("*"), F.sum("distance"), *[F.sum(x) for x in (*p, *q)], *[F.sum(x * y) for x in p for y in q]]
    for turn in range(most + 1):
        found = boxes.nearest_of(placed({k: total[k] for k in open_}), leaves, d, apart, tree)
        told = {r[0]: r[1:] for r in found.groupBy(F.shiftright("block", START_BITS)).agg(*sums).collect()}  # one row a start
        for k in list(open_):
            n, gap, *rest = told[k]
            errors[k].append(gap / n)
            if turn < most and len(errors[k]) > 1 and abs(errors[k][-2] - errors[k][-1]) < tolerance:
                settled[k] = True
                open_.remove(k)
            elif turn < most:
                total[k] = motion_of(n, np.array(rest[:d]), np.array(rest[d : 2 * d]), np.array(rest[2 * d :]).reshape(d, d)) @ total[k]
        if not open_:
            break
    return [(starts[k][0], errors[k][-1], len(errors[k]) - 1, settled[k], total[k].tolist()) for k in range(len(starts))]


def align_pairs_from_starts(points: DataFrame, step_degrees: int = 15, most: int = 50, tolerance: float = 0.001, constrain_z: bool = False) -> DataFrame:
    """(cloud, angle, error, iterations, converged, matrix): the best closest-point run of each cloud onto the next.

    points: cloud (a whole number), vid, x, y, z. A cloud is a row of arrays, so
    it has to fit a task; the driver gets none. Each (pair, start) is a row of
    its own. Points without finite coordinates or a cloud take no part, and a
    cloud without a next one gives no row.
    """
    finite = points.filter("cloud is not null and abs(x) < double('inf') and abs(y) < double('inf') and abs(z) < double('inf')")
    clouds = finite.groupBy("cloud").agg(F.array_sort(F.collect_list(F.struct("vid", "x", "y", "z"))).alias("p"))
    flat = lambda name: [F.col("p")[a].alias(f"{name}{a}") for a in "xyz"]
    pairs = clouds.select("cloud", *flat("s")).join(clouds.select((F.col("cloud") - 1).alias("cloud"), *flat("t")), "cloud")
    starts = pairs.withColumn("angle", F.explode(F.expr(f"sequence(0L, 359L, {int(step_degrees)}L)"))).repartition("cloud", "angle")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                src, dst = np.column_stack([r.sx, r.sy, r.sz]).astype(float), np.column_stack([r.tx, r.ty, r.tz]).astype(float)
                center, c, s = src.mean(axis=0), math.cos(math.radians(r.angle)), math.sin(math.radians(r.angle))
                start = np.eye(4)
                start[:2, :2] = [[c, -s], [s, c]]
                start[:3, 3] = center - start[:3, :3] @ center
                m, errors, settled = icp(moved(src, start), dst, most, tolerance, constrain_z)
                rows.append((r.cloud, r.angle, errors[-1], len(errors) - 1, settled, (m @ start).tolist()))
            yield pd.DataFrame(rows, columns=["cloud", "angle", "error", "iterations", "converged", "matrix"])

    runs = starts.mapInPandas(run, "cloud long, angle long, error double, iterations int, converged boolean, matrix array<array<double>>")
    best = F.min_by(F.struct("angle", "error", "iterations", "converged", "matrix"), F.struct("error", "angle"))
    return runs.groupBy("cloud").agg(best.alias("best")).select("cloud", "best.*")


def best_alignment(runs: DataFrame) -> DataFrame:
    """The run of the least error, of the lowest angle on ties."""
    return runs.agg(F.min_by(F.struct(*runs.columns), F.struct("error", "angle")).alias("best")).select("best.*")


def prealign(source: DataFrame, target: DataFrame) -> tuple[float, float, list[float]]:
    """(scale of X and Y, scale of Z, shift) of triangles (ax ... cz): extents' ratios, 1 where an extent is 0 or both are within 0.01 of 1, then centres.

    Centres are the surfaces' centroids by area; the scales are about the source's,
    which they leave where it is.
    """

    def extent(df: DataFrame) -> np.ndarray:
        r = df.agg(*[f(*[F.col(f"{v}{x}") for v in "abc"]) for x in "xyz" for f in (lambda *c: F.max(F.greatest(*c)), lambda *c: F.min(F.least(*c)))]).first()
        return np.array(r[::2], float) - np.array(r[1::2], float)

    se, te = extent(source), extent(target)
    ratio = [te[i] / se[i] if se[i] > 0 and te[i] > 0 else None for i in range(3)]
    flat = [r for r in ratio[:2] if r is not None]
    xy, z = float(np.mean(flat)) if flat else 1.0, float(ratio[2]) if ratio[2] is not None else 1.0
    if abs(xy - 1) <= 0.01 and abs(z - 1) <= 0.01:
        xy = z = 1.0
    return xy, z, (np.array(meshes.area_centroid(target)) - np.array(meshes.area_centroid(source))).tolist()
