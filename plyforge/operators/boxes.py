"""Nearest neighbours by a hierarchy of boxes.

Targets (points or triangles) are dealt to tasks along a space-filling curve and
cut into leaves of LEAF at most, halving the longest side of what lies together
and cutting at wide gaps; points are cut into blocks of BLOCK alike. Every sixteen leaves have a parent
box, and so on up to one root. Blocks meet the hierarchy level by
level: a block keeps the children that may hold a nearest target of any of its
points, that is, those no farther from it than the least distance within which
some other child is sure to have one. What is left at the leaves is looked at
nearest first, and a point skips every leaf farther than what it has found.

How far points are from the targets doesn't matter to it: what is kept depends
on the boxes' sizes alone. Tasks hold one block and one leaf at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from .tables import written

LEAF, BLOCK, FAN_BITS = 64, 128, 4
FAR_BITS = 32  # of a leaf's number inside its partition
MOST_BROADCAST = 200_000  # boxes of one level; more are joined by a shuffle
CHUNK = 16_384  # rows halved at a time
BATCH = 256  # leaves handed to Python at a time


def finite(columns: list[Column]) -> Column:
    return reduce(lambda p, q: p & q, [c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) for c in columns])


def spread(x: Column, dims: int) -> Column:
    """The bits of x (20 of them), dims - 1 zeros between each two."""
    if dims == 2:
        steps = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))
    else:
        steps = ((32, 0x001F00000000FFFF), (16, 0x001F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249))
    for by, mask in steps:
        x = x.bitwiseOR(F.shiftleft(x, by)).bitwiseAND(F.lit(mask))
    return x


def curve(middles: list[Column], low: list[float], high: list[float]) -> Column:
    """The place on a Z-order curve; a step is the same length on all axes, 2 ** 20 of them the longest side."""
    out, side = F.lit(0).cast("long"), max(b - a for a, b in zip(low, high, strict=True)) or 1.0
    for i, (m, a) in enumerate(zip(middles, low, strict=True)):
        step = F.floor((m - a) / side * ((1 << 20) - 1)).cast("long")
        out = out.bitwiseOR(F.shiftleft(spread(step, len(middles)), i))
    return out


def halved(low: np.ndarray, high: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of boxes, and where groups of `size` at most begin and end in it.

    The longest side of the boxes' middles is halved until a group is small
    enough, and cut where over a quarter of it is empty, unless few are left.
    """
    middle, todo, order, ends = (low + high) / 2, [np.arange(len(low))], [], [0]
    while todo:
        rows = todo.pop()
        own = middle[rows]
        least, most = own.min(axis=0), own.max(axis=0)
        axis = int((most - least).argmax())
        at, length = own[:, axis], most[axis] - least[axis]
        if len(rows) > size:
            left = at <= least[axis] + length / 2
            if left.all() or not left.any():  # all in one place
                left = np.arange(len(rows)) < len(rows) // 2
        else:
            step = np.sort(at)
            gap = np.diff(step)
            if len(rows) <= max(1, size // 8) or gap.max() <= length / 4:
                order.append(rows)
                ends.append(ends[-1] + len(rows))
                continue
            left = at <= step[gap.argmax()]
        todo += [rows[~left], rows[left]]
    return np.concatenate(order), np.array(ends)


def packed(rows: DataFrame, corners: list[list[str]], size: int) -> DataFrame:
    """(label, lo0 ..., hi0 ..., ids, data): rows (id, coordinates) in groups of `size` neighbours or fewer.

    corners: the names of each corner's coordinates (one corner for points).
    label holds the partition's number above FAR_BITS and the group's in it below.
    """
    dims, names = len(corners[0]), [c for corner in corners for c in corner]
    middle = [sum((F.col(c[i]) for c in corners), F.lit(0.0)) / len(corners) for i in range(dims)]
    about = rows.agg(F.count("*"), *[F.min(m) for m in middle], *[F.max(m) for m in middle]).first()
    parts = int(min(10_000, max(1, -(-about[0] // (size << 8)))))
    low, high = (list(about[1 + k : 1 + k + dims]) for k in (0, dims))
    key = curve(middle, low, high) if about[0] else F.lit(0).cast("long")
    placed = rows.select("id", F.array(*names).alias("data"), key.alias("at")).repartitionByRange(parts, "at", "id").sortWithinPartitions("at", "id").select("id", "data")
    kind = rows.schema["id"].dataType.simpleString()
    bounds = [f"{side}{i}" for side in ("lo", "hi") for i in range(dims)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, held = TaskContext.get().partitionId(), 0, None
        for batch in chain(batches, [None]):
            t = held if batch is None else pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            held = t
            while held is not None and held.num_rows and (batch is None or held.num_rows >= CHUNK):
                t, held = held.slice(0, CHUNK), held.slice(CHUNK)
                points = t["data"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, len(corners), dims)
                order, ends = halved(points.min(axis=1), points.max(axis=1), size)
                points, ids, n = points[order], t["id"].combine_chunks().take(pa.array(order)), len(ends) - 1
                lo, hi = np.minimum.reduceat(points.min(axis=1), ends[:-1], axis=0), np.maximum.reduceat(points.max(axis=1), ends[:-1], axis=0)
                lists = [pa.ListArray.from_arrays(pa.array((ends * by).astype(np.int32)), flat) for flat, by in ((ids, 1), (pa.array(points.ravel()), len(names)))]
                box = [pa.array(np.ascontiguousarray(b[:, i])) for b in (lo, hi) for i in range(dims)]
                yield pa.RecordBatch.from_arrays([pa.array((part << FAR_BITS) + k + np.arange(n)), *box, *lists], ["label", *bounds, "ids", "data"])
                k += n

    schema = f"label long, {', '.join(f'{b} double' for b in bounds)}, ids array<{kind}>, data array<double>"
    return written(placed.mapInArrow(run, schema))


def levels(leaves: DataFrame, dims: int) -> list[DataFrame]:
    """Boxes (label, parent, lo0 ..., hi0 ...) of each level, from the root's children down to the leaves."""
    part, k = F.shiftright("label", FAR_BITS), F.col("label").bitwiseAND(F.lit((1 << FAR_BITS) - 1))
    most_part, most_k = leaves.agg(F.max(part), F.max(k)).first()

    def height(n: int) -> int:
        h = 0
        while n:
            n, h = n >> FAN_BITS, h + 1
        return h

    inner, outer = height(most_k), height(most_part)

    def label(level: int) -> Column:
        """Level 0 are the leaves; the last one is the root."""
        if level <= inner:
            return F.shiftleft(part, FAR_BITS) + F.shiftright(k, FAN_BITS * level)
        return F.shiftleft(F.shiftright(part, FAN_BITS * (level - inner)), FAR_BITS)

    top = max(inner + outer, 1)
    names = [F.struct(F.lit(i).alias("level"), label(i).alias("label"), label(i + 1).alias("parent")) for i in range(top)]
    bounds = [(F.min if side == "lo" else F.max)(f"{side}{i}").alias(f"{side}{i}") for side in ("lo", "hi") for i in range(dims)]
    each = leaves.select(F.explode(F.array(*names)).alias("n"), *[f"{side}{i}" for side in ("lo", "hi") for i in range(dims)])
    boxes = written(each.groupBy(F.col("n.level").alias("level"), F.col("n.label").alias("label"), F.col("n.parent").alias("parent")).agg(*bounds))
    sizes = {r.level: r.n for r in boxes.groupBy("level").agg(F.count("*").alias("n")).collect()}  # one row a level
    out = []
    for i in reversed(range(top)):
        rows = boxes.filter(F.col("level") == i).drop("level")
        out.append(F.broadcast(rows) if sizes[i] <= MOST_BROADCAST else rows)
    return out


def candidates(blocks: DataFrame, tree: list[DataFrame], dims: int) -> DataFrame:
    """(block, label, near): the leaves that may hold a nearest target of a block's points, and their squared distances from it. tree: levels() of the leaves."""
    front = blocks.select(F.col("label").alias("block"), *[F.col(f"{side}{i}").alias(f"q{side}{i}") for side in ("lo", "hi") for i in range(dims)], F.lit(0).cast("long").alias("parent"))
    held = front.columns[:-1]
    zero = F.lit(0.0)
    gap = [F.greatest(F.col(f"lo{i}") - F.col(f"qhi{i}"), F.col(f"qlo{i}") - F.col(f"hi{i}"), zero) for i in range(dims)]
    reach = [F.greatest(F.col(f"hi{i}") - F.col(f"qlo{i}"), F.col(f"qhi{i}") - F.col(f"lo{i}")) for i in range(dims)]
    near, far = (sum((x * x for x in side), zero) for side in (gap, reach))
    sure = F.min("far").over(Window.partitionBy("block"))
    for boxes in tree:
        met = front.join(boxes, "parent").select(*held, "label", near.alias("near"), far.alias("far"))
        met = met.withColumn("sure", sure).filter("near <= sure * (1 + 1e-12)")
        front = met.select(*held, F.col("label").alias("parent"))
    return met.select("block", "label", "near")


def nearest_of(blocks: DataFrame, leaves: DataFrame, dims: int, pairwise: Callable[[np.ndarray, np.ndarray], np.ndarray], tree: list[DataFrame] | None = None) -> DataFrame:
    """(block, id, target, distance, point, at) of each point of the blocks, with its numbers and the target's; of equally near targets the least.

    pairwise: distances (points, targets) of points (n, dims) and targets (m, numbers of one).
    """
    found = written(candidates(blocks, levels(leaves, dims) if tree is None else tree, dims))
    bounds = [f"{side}{i}" for side in ("lo", "hi") for i in range(dims)]
    point, target = (t.schema["ids"].dataType.elementType.simpleString() for t in (blocks, leaves))
    columns = ["block", "near", *bounds, "points", "ids", "data"]
    pairs = found.join(leaves, "label").withColumn("points", F.lit(None).cast(f"array<{point}>"))
    own = blocks.select(F.col("label").alias("block"), F.lit(-1.0).alias("near"), *bounds, F.col("ids").alias("points"), F.lit(None).cast(f"array<{target}>").alias("ids"), "data")
    rows = pairs.select(columns).unionByName(own.select(columns)).repartition("block").sortWithinPartitions("block", "near")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ids = points = best = at_target = block = None

        def lists(x: np.ndarray) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(best), block)), names, pa.array(ids.tolist(), names_of["target"]), pa.array(best), lists(points), lists(at_target)], ["block", "id", "target", "distance", "point", "at"])

        names_of = {}
        for batch in batches:
            names_of["target"] = batch.schema.field("ids").type.value_type
            blocks_of, own_ids, leaf_ids, data = (batch.column(batch.schema.get_field_index(c)) for c in ("block", "points", "ids", "data"))
            box = np.stack([batch.column(batch.schema.get_field_index(b)).to_numpy() for b in bounds], axis=1)
            for r in range(len(batch)):
                values = data[r].values.to_numpy(zero_copy_only=False)
                if own_ids[r].is_valid:  # a block's own row comes before its leaves
                    if names is not None:
                        yield done()
                    names, points = own_ids[r].values, values.reshape(-1, dims)
                    best, ids, block = np.full(len(points), np.inf), np.full(len(points), None, object), blocks_of[r].as_py()
                    at_target = np.zeros((len(points), 1))
                    continue
                gap = np.maximum(np.maximum(box[r, :dims] - points, points - box[r, dims:]), 0)
                at = np.flatnonzero(np.sqrt((gap * gap).sum(axis=1)) <= best * (1 + 1e-12))
                if not len(at):
                    continue
                have = np.array(leaf_ids[r].as_py(), object)
                values = values.reshape(len(have), -1)
                if at_target.shape[1] != values.shape[1]:
                    at_target = np.zeros((len(points), values.shape[1]))
                far = pairwise(points[at], values)
                d = far.min(axis=1)
                same = far == d[:, None]
                which = same.argmax(axis=1)
                for i in np.flatnonzero(same.sum(axis=1) > 1).tolist():
                    tied = np.flatnonzero(same[i])
                    which[i] = tied[np.argmin(have[tied])] if len(tied) > 1 else tied[0]
                better = d < best[at]
                for i in np.flatnonzero(d == best[at]).tolist():
                    better[i] = ids[at[i]] is None or have[which[i]] < ids[at[i]]
                best[at[better]], ids[at[better]], at_target[at[better]] = d[better], have[which[better]], values[which[better]]
        if names is not None:
            yield done()

    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark, before = blocks.sparkSession, blocks.sparkSession.conf.get(conf)
    spark.conf.set(conf, str(BATCH))
    try:
        return written(rows.mapInArrow(run, f"block long, id {point}, target {target}, distance double, point array<double>, at array<double>"))
    finally:
        spark.conf.set(conf, before)
