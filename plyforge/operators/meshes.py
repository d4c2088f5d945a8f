"""Meshes as tables: voxels to vertices, triangles' measures, plane sections."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .tables import dealt, written

CHUNK = 50_000  # segments of whole sections ranked at a time


def sphere_phantom(spark: SparkSession, half: int = 20, radius: float = 15.0) -> DataFrame:
    """(volume, z, y, x, inside) of a sphere in a cube of (2 half) voxels a side."""
    side = 2 * half
    at = lambda n: ((F.col("id") / n).cast("long") % side - half).cast("int")
    rows = spark.range(side**3).select(F.lit(0).alias("volume"), at(side * side).alias("z"), at(side).alias("y"), at(1).alias("x"))
    return rows.withColumn("inside", F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z")) < radius)


def isosurface_vertices(voxels: DataFrame, volume: str = "volume") -> DataFrame:
    """(volume, axis, x, y, z): the middles of lattice edges whose ends differ; outside the given voxels all is empty.

    Each voxel is sent to the edges that it ends, so one group-by pairs them.
    """
    edges = F.array(*[F.struct(F.lit(a).alias("axis"), F.lit(d).alias("d")) for a in "xyz" for d in (0, -1)])
    sent = voxels.filter("inside").withColumn("e", F.explode(edges))
    low = [(F.col(a) + F.when(F.col("e.axis") == a, F.col("e.d")).otherwise(0)).alias(a) for a in "xyz"]
    ends = sent.select(volume, F.col("e.axis").alias("axis"), *low)
    single = ends.groupBy(volume, "axis", "x", "y", "z").agg(F.count("*").alias("n")).filter("n = 1")
    return single.select(volume, "axis", *[(F.col(a) + F.when(F.col("axis") == a, 0.5).otherwise(0.0)).alias(a) for a in "xyz"])


def voxel_faces(voxels: DataFrame, volume: str = "volume") -> DataFrame:
    """(volume, ax ... cz): two triangles, wound outward, for each voxel side that borders emptiness.

    A closed surface of the same voxels; it keeps their volume exactly.
    """
    sides = [(axis, sign) for axis in range(3) for sign in (-1, 1)]
    spec = F.array(*[F.struct(F.lit(a).alias("axis"), F.lit(s).alias("sign")) for a, s in sides])
    sent = voxels.filter("inside").withColumn("e", F.explode(spec))
    plane = [(F.col(a) * 2 + F.when(F.col("e.axis") == i, F.col("e.sign")).otherwise(0)).alias(f"p{a}") for i, a in enumerate("xyz")]
    faces = sent.select(volume, F.col("e.axis").alias("axis"), F.col("e.sign").alias("sign"), *plane).groupBy(volume, "axis", "px", "py", "pz").agg(F.count("*").alias("n"), F.min("sign").alias("sign")).filter("n = 1")

    def corner(u: int, v: int) -> list[Column]:
        """The corner in the face's plane at u, v (-1 or 1) along its two other axes, in cyclic order."""
        out = []
        for i, a in enumerate("xyz"):
            step = F.when(F.col("axis") == i, 0.0).when(F.pmod(F.lit(i) - F.col("axis"), F.lit(3)) == 1, u * 0.5).otherwise(v * 0.5)
            out.append(F.col(f"p{a}") / 2 + step)
        return out

    def triangle(a, b, c) -> Column:
        flat = []
        for name, p, q in (("a", a, a), ("b", b, c), ("c", c, b)):
            for x, up, down in zip("xyz", corner(*p), corner(*q), strict=True):
                flat.append(F.when(F.col("sign") > 0, up).otherwise(down).alias(f"{name}{x}"))
        return F.struct(*flat)

    both = F.array(triangle((-1, -1), (1, -1), (1, 1)), triangle((-1, -1), (1, 1), (-1, 1)))
    return faces.select(volume, F.explode(both).alias("t")).select(volume, "t.*")


def sides_of_cell() -> list[list[int]]:
    """The corners of a cell's six sides in cyclic order, seen alike from outside (corner x + 2 y + 4 z)."""
    out = []
    for axis in range(3):
        u, v = 1 << (axis + 1) % 3, 1 << (axis + 2) % 3
        for far in (0, 1):
            out.append([far << axis, far << axis | u, far << axis | u | v, far << axis | v][:: 1 if far else -1])
    return out


def cell_loops(mask: int, joined: int = 0) -> list[list[tuple[int, int]]]:
    """Where the surface crosses a cell of eight corners (bit x + 2 y + 4 z of the mask is set inside): loops of crossed
    edges, each a pair of corners.

    On each side of the cell, cut off every run of inside corners by a line from the edge that leaves it to the edge that
    enters it; where two opposite corners are inside, each is cut off alone, or, where the side's bit of `joined` is set,
    each of the two outside corners. The neighbouring cell cuts the shared side alike, so the surface is closed. Lines of
    all sides chain into loops.
    """
    onward, edge = {}, lambda p, q: (min(p, q), max(p, q))
    for number, side in enumerate(sides_of_cell()):
        inside = [mask >> c & 1 for c in side]
        across = joined >> number & 1 and inside in ([1, 0, 1, 0], [0, 1, 0, 1])
        for i in range(4):
            if inside[i] and not inside[i - 1]:
                j = i
                while inside[(j + 1) % 4]:
                    j += 1
                leaves = edge(side[j % 4], side[(j + 1) % 4])
                onward[leaves] = edge(side[(i + 1) % 4], side[(i + 2) % 4]) if across else edge(side[i - 1], side[i])
    loops = []
    while onward:
        loop = [next(iter(onward))]
        while onward[loop[-1]] != loop[0]:
            loop.append(onward.pop(loop[-1]))
        onward.pop(loop[-1])
        loops.append(loop)
    return loops


EDGES = [(c, c | 1 << a) for a in range(3) for c in range(8) if not c >> a & 1]


def cell_table() -> list[tuple[int, int, list[list[int]]]]:
    """(mask, joined, triangles): for each mask and each choice at its sides of two opposite inside corners, triangles of places in EDGES."""
    rows, sides = [], sides_of_cell()
    for mask in range(1, 255):
        open_ = [k for k, side in enumerate(sides) if [mask >> c & 1 for c in side] in ([1, 0, 1, 0], [0, 1, 0, 1])]
        for choice in range(1 << len(open_)):
            joined = sum(1 << k for i, k in enumerate(open_) if choice >> i & 1)
            loops = [[EDGES.index(e) for e in loop] for loop in cell_loops(mask, joined)]
            rows.append((mask, joined, [[loop[0], loop[i + 1], loop[i]] for loop in loops for i in range(1, len(loop) - 1)]))
    return rows


def marching_cubes(voxels: DataFrame, volume: str = "volume", step: int = 1, value: str | None = None, level: float = 0.5, flat: bool = False) -> DataFrame:
    """(volume, slice, ax ... cz): the triangles of the surface between voxels over `level` and others, wound outward.

    value names the column of grey levels; without it, voxels that are `inside` count as 1 and others as 0. Vertices lie
    on lattice edges whose ends differ, where the value between both ends is the level, and neighbouring cells compute
    them alike. Each voxel is sent to the eight cells that it is a corner of; a cell's mask, and the saddle values of sides
    with two opposite corners inside (over the level: these are joined), find its triangles in a table made by rule.
    slice is the cell's lower z (in steps). step: only every step-th voxel along each axis is looked at. Voxels that are
    not given, and nulls, are 0, so the level can't be negative. Whether a cell that is open on several sides is open
    inside too is not asked: its loops are filled one by one. flat: triangles with equal corners stay, so that every
    vertex is a corner of some triangle; a voxel at the level itself that is the only one not over it is but one point.
    """
    if level < 0:
        raise ValueError("the level can't be below 0, the value outside")
    table = F.broadcast(voxels.sparkSession.createDataFrame(cell_table(), "mask int, joined int, found array<array<int>>"))
    grey = F.col("inside").cast("double") if value is None else F.col(value).cast("double")
    some = voxels.select(volume, *"xyz", F.coalesce(grey, F.lit(0.0)).alias("v")).filter("v <> 0")
    if step > 1:
        some = some.filter(" and ".join(f"pmod({a}, {step}) = 0" for a in "xyz")).withColumns({a: (F.col(a) / step).cast("int") for a in "xyz"})
    corners = F.array(*[F.struct(*[F.lit(c >> i & 1).alias(a) for i, a in enumerate("xyz")], F.lit(c).alias("k")) for c in range(8)])
    sent = some.withColumn("c", F.explode(corners))
    at = [F.coalesce(F.max(F.when(F.col("c.k") == c, F.col("v"))), F.lit(0.0)).alias(f"v{c}") for c in range(8)]
    cells = sent.groupBy(volume, *[(F.col(a) - F.col(f"c.{a}")).alias(a) for a in "xyz"]).agg(*at)
    v, zero = [F.col(f"v{c}") for c in range(8)], F.lit(0)
    mask = sum((F.when(v[c] > level, 1 << c).otherwise(0) for c in range(8)), zero)

    def across(p: int, q: int, r: int, s: int) -> Column:
        """Whether a side with p and r, or q and s, inside alone is joined at its saddle."""
        opposite = ((v[p] > level) == (v[r] > level)) & ((v[q] > level) == (v[s] > level)) & ((v[p] > level) != (v[q] > level))
        return opposite & (F.try_divide(v[p] * v[r] - v[q] * v[s], v[p] + v[r] - v[q] - v[s]) > level)

    joined = sum((F.when(across(*side), 1 << k).otherwise(0) for k, side in enumerate(sides_of_cell())), zero)
    met = cells.withColumn("mask", mask).filter("mask > 0 and mask < 255").withColumn("joined", joined).join(table, ["mask", "joined"])

    def crossing(p: int, q: int) -> Column:
        along = F.coalesce(F.try_divide(level - v[p], v[q] - v[p]), F.lit(0.0))  # equal ends aren't crossed
        return F.struct(*[F.coalesce((F.col(a) + (p >> i & 1)) + (along if (p ^ q) >> i & 1 else 0.0), F.lit(0.0)).alias(a) for i, a in enumerate("xyz")])

    each = met.select(volume, F.col("z").alias("slice"), F.array(*[crossing(*e) for e in EDGES]).alias("e"), "found").select(volume, "slice", "e", F.explode("found").alias("t"))
    point = [F.get("e", F.col("t")[k]) for k in range(3)]
    if not flat:  # a corner at the level itself is the end of several edges
        each = each.filter((point[0] != point[1]) & (point[1] != point[2]) & (point[2] != point[0]))
    return each.select(volume, "slice", *[(p[a] * step).alias(f"{c}{a}") for c, p in zip("abc", point, strict=True) for a in "xyz"])


def lifted(tris: DataFrame, heights: DataFrame) -> DataFrame:
    """Triangles of marching_cubes (step 1) with z between their slices' heights. heights: (slice, height), slices from 0 on without gaps.

    Below the first slice and above the last one, a slice is as thick as they are on average (0 for a single one).
    """
    h = heights.select(F.col("slice").cast("int").alias("slice"), F.col("height").cast("double").alias("height"))
    ends = h.agg(F.min("height").alias("low"), F.max("height").alias("high"), F.max("slice").alias("last"))  # one row
    ends = ends.withColumn("step", (F.col("high") - F.col("low")) / F.greatest(F.col("last"), F.lit(1)))
    more = ends.select(F.explode(F.array(F.struct(F.lit(-1).alias("slice"), (F.col("low") - F.col("step")).alias("height")), F.struct((F.col("last") + 1).alias("slice"), (F.col("high") + F.col("step")).alias("height")))).alias("e")).select("e.*")
    every = h.unionByName(more)
    pairs = every.join(every.select((F.col("slice") - 1).alias("slice"), F.col("height").alias("above")), "slice")
    z = lambda c: F.col("height") + (F.col(c) - F.col("slice")) * (F.col("above") - F.col("height"))
    return tris.join(pairs, "slice").withColumns({f"{c}z": z(f"{c}z") for c in "abc"}).drop("height", "above", "slice")


def area_centroid(tris: DataFrame) -> list[float]:
    """The mean of the triangles' middles by area, or of the middles where there is no area; one row reaches the driver."""
    a, b, c = ([F.col(f"{v}{x}") for x in "xyz"] for v in "abc")
    n = _cross([q - p for p, q in zip(a, b, strict=True)], [q - p for p, q in zip(a, c, strict=True)])
    area = F.sqrt(sum((x * x for x in n), F.lit(0.0)))
    middle = [(p + q + r) / 3 for p, q, r in zip(a, b, c, strict=True)]
    r = tris.agg(F.sum(area), *[F.sum(area * m) for m in middle], *[F.avg(m) for m in middle]).first()
    return [x / r[0] for x in r[1:4]] if r[0] else list(r[4:7])


def open_edges(tris: DataFrame, mesh: str = "mesh") -> DataFrame:
    """(mesh, open_edges): directed edges that are not met by as many in the opposite direction; 0 for a closed surface. Edges without length are none."""
    point = lambda v: F.struct(*[F.col(f"{v}{x}").alias(x) for x in "xyz"])
    ways = F.array(*[F.struct(F.least(point(p), point(q)).alias("p"), F.greatest(point(p), point(q)).alias("q"), F.when(point(p) < point(q), 1).when(point(p) > point(q), -1).otherwise(0).alias("way")) for p, q in ("ab", "bc", "ca")])
    each = tris.select(mesh, F.explode(ways).alias("e")).groupBy(mesh, "e.p", "e.q").agg(F.sum("e.way").alias("way"))
    return each.groupBy(mesh).agg(F.sum(F.abs("way")).alias("open_edges"))


def triangles(vertices: DataFrame, faces: DataFrame, mesh: str = "mesh") -> DataFrame:
    """(mesh, fid, ax ... cz) of faces (mesh, fid, a, b, c) over vertices (mesh, vid, x, y, z)."""
    out = faces
    for v in "abc":
        out = out.join(vertices.select(mesh, F.col("vid").alias(v), *[F.col(x).alias(f"{v}{x}") for x in "xyz"]), [mesh, v])
    return out.select(mesh, "fid", *[f"{v}{x}" for v in "abc" for x in "xyz"])


def _cross(u: list[Column], v: list[Column]) -> list[Column]:
    return [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]


def mesh_info(tris: DataFrame, mesh: str = "mesh") -> DataFrame:
    """One row a mesh: bounds, area, volume (0 unless closed), centre of mass, counts and whether it is closed.

    A mesh is closed if each undirected edge has two faces. Vertices are told
    by their coordinates.
    """
    a, b, c = ([F.col(f"{v}{x}") for x in "xyz"] for v in "abc")
    n = _cross([q - p for p, q in zip(a, b, strict=True)], [q - p for p, q in zip(a, c, strict=True)])
    area = F.sqrt(sum((x * x for x in n), F.lit(0.0))) / 2
    signed = sum((p * q for p, q in zip(a, _cross(b, c), strict=True)), F.lit(0.0)) / 6
    sums = [F.sum(signed * (p + q + r) / 4).alias(f"m{x}") for x, p, q, r in zip("xyz", a, b, c, strict=True)]
    box = [f(F.least(*[F.col(f"{v}{x}") for v in "abc"]) if n_ == "min" else F.greatest(*[F.col(f"{v}{x}") for v in "abc"])).alias(f"{n_}_{x}") for n_, f in (("min", F.min), ("max", F.max)) for x in "xyz"]
    totals = tris.groupBy(mesh).agg(*box, F.sum(area).alias("area"), F.sum(signed).alias("signed"), *sums, F.count("*").alias("n_faces"))
    point = lambda v: F.struct(*[F.col(f"{v}{x}").alias(x) for x in "xyz"])
    ends = tris.select(mesh, F.explode(F.array(*[F.struct(F.least(point(p), point(q)).alias("p"), F.greatest(point(p), point(q)).alias("q")) for p, q in ("ab", "bc", "ca")])).alias("e"))
    edges = ends.groupBy(mesh, "e").agg(F.count("*").alias("n")).groupBy(mesh).agg(F.bool_and(F.col("n") == 2).alias("watertight"), F.count("*").alias("n_edges"))
    corners = tris.select(mesh, F.explode(F.array(*[point(v) for v in "abc"])).alias("p")).distinct().groupBy(mesh).agg(F.count("*").alias("n_vertices"))
    out = totals.join(edges, mesh).join(corners, mesh)
    solid = F.col("watertight") & (F.col("signed") != 0)
    return out.withColumn("volume", F.when(solid, F.abs("signed")).otherwise(0.0)).withColumns({f"center_{x}": F.when(solid, F.col(f"m{x}") / F.col("signed")) for x in "xyz"}).drop("signed", "mx", "my", "mz")


def plane_sections(tris: DataFrame, heights: DataFrame, mesh: str = "mesh", cell: float = 1.0) -> DataFrame:
    """(mesh, height_idx, x0, y0, x1, y1): where planes z = height cut triangles.

    heights: (height_idx, z). A range join made an equi-join: triangles go to
    the z cells that they span, heights to their own. A corner on the plane
    counts as above it. Segments run with the solid on their left, if the
    triangles are wound outward.
    """
    low, high = F.least("az", "bz", "cz"), F.greatest("az", "bz", "cz")
    cells = tris.withColumn("_c", F.explode(F.sequence(F.floor(low / cell), F.floor(high / cell))))
    cut = cells.join(heights.select("height_idx", F.col("z").alias("_z"), F.floor(F.col("z") / cell).alias("_c")), "_c").filter((F.col("_z") <= high) & (F.col("_z") > low))

    def crossing(p: str, q: str) -> Column:
        t = (F.col("_z") - F.col(f"{p}z")) / (F.col(f"{q}z") - F.col(f"{p}z"))
        crosses = (F.col(f"{p}z") >= F.col("_z")) != (F.col(f"{q}z") >= F.col("_z"))
        return F.when(crosses, F.struct(*[(F.col(f"{p}{x}") + t * (F.col(f"{q}{x}") - F.col(f"{p}{x}"))).alias(x) for x in "xy"]))

    ends = F.array_compact(F.array(crossing("a", "b"), crossing("b", "c"), crossing("c", "a")))
    rows = cut.withColumn("e", ends).filter(F.size("e") == 2)
    n = _cross([F.col(f"b{x}") - F.col(f"a{x}") for x in "xyz"], [F.col(f"c{x}") - F.col(f"a{x}") for x in "xyz"])
    end = [F.get("e", F.lit(i)) for i in (0, 1)]  # get(): filters of later steps may be looked at first
    run = {x: end[1][x] - end[0][x] for x in "xy"}
    rows = rows.withColumn("e", F.when(run["y"] * n[0] - run["x"] * n[1] < 0, F.reverse("e")).otherwise(F.col("e")))
    return rows.select(mesh, "height_idx", *[end[i][x].alias(f"{x}{i}") for i in (0, 1) for x in "xy"])


def section_rings(cuts: DataFrame, mesh: str = "mesh", digits: int = 6, most_local: int = 100_000) -> DataFrame:
    """(mesh, height_idx, ring, n_points, area, perimeter, points): sections' segments chained into rings.

    A section of most_local segments or fewer is chained in one task, a larger one by Spark (linked_rings).
    Chains begin with their least segment and follow the segments' direction where they can. A ring's area is
    negative where it runs clockwise, that is, around a hole of a mesh wound outward. Open chains have area 0.
    """
    small, large = _by_size(cuts, mesh, most_local)
    rings = _chained(small, mesh, digits)
    return rings if large is None else rings.unionByName(_linked(large, mesh, digits))


def _by_size(cuts: DataFrame, mesh: str, most_local: int) -> tuple[DataFrame, DataFrame | None]:
    """The segments of sections of most_local or fewer, and those of larger ones, if there are any."""
    cuts = written(cuts)
    sizes = cuts.groupBy(mesh, "height_idx").agg(F.count("*").alias("n")).filter(F.col("n") > most_local)
    large = written(sizes.select(mesh, "height_idx"))
    if large.isEmpty():
        return cuts, None
    return cuts.join(large, [mesh, "height_idx"], "left_anti"), cuts.join(large, [mesh, "height_idx"], "left_semi")


def doubled(links: DataFrame, carried: dict[str, Column], watched: str, most_rounds: int = 64) -> DataFrame:
    """links (dart, ptr, ...) after pointer doubling: each round a dart takes over what its ptr points at, until no row reaches an end or changes in `watched`.

    carried: the columns carried along, and what becomes of each from its own value and `_name`, that of the ptr's row.
    """
    state = written(links)
    for _ in range(most_rounds):
        ahead = state.select(F.col("dart").alias("ptr"), F.col("ptr").alias("_ptr"), *[F.col(c).alias(f"_{c}") for c in carried])
        both = state.join(ahead, "ptr", "left")
        open_ = F.col("ptr").isNotNull()
        changed = open_ & (F.col("_ptr").isNull() | (carried[watched] != F.col(watched)))
        new = both.select("dart", F.col("_ptr").alias("ptr"), *[F.when(open_, how).otherwise(F.col(c)).alias(c) for c, how in carried.items()], changed.alias("_changed"))
        new = written(new)
        state = new.drop("_changed")
        if new.filter("_changed").isEmpty():
            return state
    raise RuntimeError(f"chains did not settle in {most_rounds} rounds")


def linked_rings(cuts: DataFrame, mesh: str = "mesh", digits: int = 6, most_local: int = 100_000) -> DataFrame:
    """section_rings() of sections of any size, by list ranking.

    Segment ends that meet in a point are paired in the order of their angles, so that chains don't cross there. A
    segment is two darts, one each way, and a dart's next one is fixed by its head's pair. Pointer doubling finds each
    cycle's least dart (or an open chain's last one), the cut there gives every dart's place, in as many rounds as the
    longest chain's length has bits. Of a chain's two ways the one with its least segment's direction stays. Sections of
    most_local segments or fewer are ranked so in the task that they are dealt to, so their darts are shuffled once and
    not in every round; darts of larger ones meet by Spark's joins, and no task holds such a section until a ring's
    points become its row.
    """
    small, large = _by_size(cuts, mesh, most_local)
    rings = _ranked(small, mesh, digits)
    return rings if large is None else rings.unionByName(_linked(large, mesh, digits))


def doubled_here(ptr: np.ndarray, carried: list[np.ndarray], how: list) -> np.ndarray:
    """doubled() of darts 0, 1, ... that a task holds (ptr -1: an end); carried arrays change in place, the first is watched."""
    ptr = ptr.copy()
    while True:
        at = np.flatnonzero(ptr >= 0)
        to = ptr[at]
        onward = ptr[to]
        new = [f(c[at], c[to]) for f, c in zip(how, carried, strict=True)]
        settled = not ((onward < 0) | (new[0] != carried[0][at])).any()
        for c, x in zip(carried, new, strict=True):
            c[at] = x
        ptr[at] = onward
        if settled:
            return ptr


def ring_ranks(section: np.ndarray, ends: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(darts, first places of rings, whether closed) of segments (n, ends, xy) in order of their sections and places; turn: (n, ends)."""
    n = len(section)
    xy, sid = ends.reshape(2 * n, 2), np.arange(2 * n) // 2  # half 2 s + e is where dart 2 s + e leaves and its opposite arrives
    order = np.lexsort((np.arange(2 * n), turn.ravel(), xy[:, 1], xy[:, 0], section[sid]))
    new = np.ones(2 * n, bool)
    new[1:] = (section[sid[order[1:]]] != section[sid[order[:-1]]]) | (xy[order[1:]] != xy[order[:-1]]).any(axis=1)
    first = np.flatnonzero(new)
    even = (np.arange(2 * n) - np.repeat(first, np.diff(np.append(first, 2 * n)))) % 2 == 0
    one = np.flatnonzero(even[:-1] & ~even[1:] & ~new[1:])
    p, q, links = order[one], order[one + 1], np.full(2 * n, -1)
    links[p ^ 1], links[q ^ 1] = q, p
    dart = np.arange(2 * n)
    least, last = dart.copy(), dart.copy()
    closed = doubled_here(links, [least, last], [np.minimum, lambda _, b: b]) >= 0
    chain = np.where(closed, least, last)
    cut = np.where(closed & (links == chain), -1, links)
    after = (cut >= 0).astype(np.int64)
    doubled_here(cut, [after], [np.add])
    lowest = np.full(2 * n, 2 * n)
    np.minimum.at(lowest, chain, dart)
    kept = np.flatnonzero(lowest[chain] % 2 == 0)
    kept = kept[np.lexsort((-after[kept], lowest[chain[kept]]))]
    begins = np.flatnonzero(np.append(True, chain[kept[1:]] != chain[kept[:-1]]))
    return kept, begins, closed[kept[begins]]


def _ranked(cuts: DataFrame, mesh: str, digits: int) -> DataFrame:
    """linked_rings() of sections that a task holds; it ranks CHUNK segments of whole sections at a time."""
    kind, number = (cuts.schema[c].dataType.simpleString() for c in (mesh, "height_idx"))
    place, chunk = ["x0", "y0", "x1", "y1"], CHUNK

    def solve(t: pa.Table, section: np.ndarray) -> pa.RecordBatch:
        ends = np.column_stack([t[c].to_numpy() for c in place]).reshape(-1, 2, 2)
        darts, begins, closed = ring_ranks(section, ends, np.column_stack([t["turn0"].to_numpy(), t["turn1"].to_numpy()]))
        xy = ends.reshape(-1, 2)
        a, b = xy[darts], xy[darts ^ 1]
        twice = np.add.reduceat(a[:, 0] * b[:, 1] - b[:, 0] * a[:, 1], begins)
        length = np.add.reduceat(np.sqrt(((b - a) ** 2).sum(axis=1)), begins)
        stops = np.append(begins[1:], len(darts))
        points = np.insert(a, stops[~closed], b[stops[~closed] - 1], axis=0)  # an open chain has its last end too
        sizes = stops - begins + ~closed
        rows = darts[begins] // 2
        own = section[rows]
        start = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        ring = np.arange(len(own)) - np.repeat(start, np.diff(np.append(start, len(own))))
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.StructArray.from_arrays([pa.array(points[:, i].copy()) for i in (0, 1)], ["x", "y"]))
        keys = [t[c].combine_chunks().take(pa.array(rows)) for c in (mesh, "height_idx")]
        return pa.RecordBatch.from_arrays([*keys, pa.array(ring, pa.int32()), pa.array(sizes, pa.int32()), pa.array(np.where(closed, twice / 2, 0.0)), pa.array(length), lists], [mesh, "height_idx", "ring", "n_points", "area", "perimeter", "points"])

    def sections(t: pa.Table) -> np.ndarray:
        codes = np.column_stack([t[c].combine_chunks().dictionary_encode("encode").indices.to_numpy(zero_copy_only=False) for c in (mesh, "height_idx")])
        return np.append(0, np.cumsum((codes[1:] != codes[:-1]).any(axis=1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, most = [], 0, chunk
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n < most:
                continue
            t = pa.Table.from_batches(held)
            section = sections(t)
            whole = int(np.searchsorted(section, section[-1]))  # the last section may go on
            if whole:
                yield solve(t.slice(0, whole), section[:whole])
            held, n = t.slice(whole).to_batches(), t.num_rows - whole
            most = max(chunk, 2 * n)
        if n:
            t = pa.Table.from_batches(held)
            yield solve(t, sections(t))

    told = dealt(cuts.select(mesh, "height_idx", *place), 200_000, mesh, "height_idx")
    told = told.select(mesh, "height_idx", *[F.round(c, digits).alias(c) for c in place]).filter("x0 <> x1 or y0 <> y1").sortWithinPartitions(mesh, "height_idx", *place)
    turns = [F.atan2(F.col(f"y{1 - e}") - F.col(f"y{e}"), F.col(f"x{1 - e}") - F.col(f"x{e}")).alias(f"turn{e}") for e in (0, 1)]
    return told.select("*", *turns).mapInArrow(run, f"`{mesh}` {kind}, height_idx {number}, ring int, n_points int, area double, perimeter double, points array<struct<x: double, y: double>>")


def _linked(cuts: DataFrame, mesh: str, digits: int) -> DataFrame:
    """linked_rings() of sections of any size."""
    near = {c: F.round(c, digits).alias(c) for c in ("x0", "y0", "x1", "y1")}
    ends = cuts.select(mesh, "height_idx", *near.values()).filter("x0 <> x1 or y0 <> y1").orderBy(mesh, "height_idx", "x0", "y0", "x1", "y1")
    rows = written(ends.withColumn("sid", F.monotonically_increasing_id()))
    half = F.array(*[F.struct(F.lit(e).alias("end"), F.col(f"x{e}").alias("x"), F.col(f"y{e}").alias("y"), F.atan2(F.col(f"y{1 - e}") - F.col(f"y{e}"), F.col(f"x{1 - e}") - F.col(f"x{e}")).alias("turn")) for e in (0, 1)])
    halves = rows.select(mesh, "height_idx", "sid", F.explode(half).alias("h")).select(mesh, "height_idx", "sid", "h.*")
    point = [mesh, "height_idx", "x", "y"]
    place = F.floor((F.row_number().over(Window.partitionBy(*point).orderBy("turn", "sid", "end")) - 1) / 2).alias("pair")
    pairs = halves.select(*point, place, (F.col("sid") * 2 + F.col("end")).alias("leaves"), (F.col("sid") * 2 + 1 - F.col("end")).alias("arrives")).groupBy(*point, "pair").agg(F.collect_list(F.struct("leaves", "arrives")).alias("d"))
    # who arrives at one end goes on from the other; an end without another one is open
    links = written(pairs.select(F.explode(F.transform("d", lambda e, i: F.struct(e["arrives"].alias("dart"), F.get("d", 1 - i)["leaves"].alias("ptr")))).alias("m")).select("m.*"))
    chains = doubled(links.select("dart", "ptr", F.col("dart").alias("least"), F.col("dart").alias("last")), {"least": F.least("least", "_least"), "last": F.col("_last")}, "least")
    closed = chains.select("dart", F.col("ptr").isNotNull().alias("closed"), F.when(F.col("ptr").isNotNull(), F.col("least")).otherwise(F.col("last")).alias("chain"))
    cut = written(links.join(closed, "dart").withColumn("ptr", F.when(F.col("closed") & (F.col("ptr") == F.col("chain")), None).otherwise(F.col("ptr"))))
    ranked = doubled(cut.select("dart", "ptr", F.when(F.col("ptr").isNull(), 0).otherwise(1).cast("long").alias("after")), {"after": F.col("after") + F.col("_after")}, "after")
    placed = ranked.join(cut.select("dart", "closed", "chain"), "dart")
    # a closed chain's least dart tells its way; an open one's ways are told by their least darts too
    ways = placed.groupBy("chain").agg(F.min("dart").alias("least")).filter("least % 2 = 0").select("chain")
    kept = placed.join(ways, "chain").withColumns({"sid": F.expr("dart div 2"), "back": F.col("dart") % 2 == 1})
    each = kept.join(rows, "sid")
    turn = lambda a, b: F.when(F.col("back"), F.col(b)).otherwise(F.col(a))
    each = each.select(mesh, "height_idx", "chain", "closed", "after", "sid", turn("x0", "x1").alias("ax"), turn("y0", "y1").alias("ay"), turn("x1", "x0").alias("bx"), turn("y1", "y0").alias("by"))
    length = F.sqrt((F.col("bx") - F.col("ax")) ** 2 + (F.col("by") - F.col("ay")) ** 2)
    seq = F.array_sort(F.collect_list(F.struct((-F.col("after")).alias("k"), "ax", "ay", "bx", "by"))).alias("seq")
    rings = each.groupBy(mesh, "height_idx", "chain", "closed").agg(F.min("sid").alias("first"), F.sum(F.col("ax") * F.col("by") - F.col("bx") * F.col("ay")).alias("twice"), F.sum(length).alias("perimeter"), seq)
    points = F.transform("seq", lambda p: F.struct(p["ax"].alias("x"), p["ay"].alias("y")))
    tail = F.transform(F.slice("seq", -1, 1), lambda p: F.struct(p["bx"].alias("x"), p["by"].alias("y")))
    number = (F.row_number().over(Window.partitionBy(mesh, "height_idx").orderBy("first")) - 1).alias("ring")
    out = rings.select(mesh, "height_idx", number, F.when(F.col("closed"), F.col("twice") / 2).otherwise(0.0).alias("area"), "perimeter", F.when(F.col("closed"), points).otherwise(F.concat(points, tail)).alias("points"))
    return out.select(mesh, "height_idx", "ring", F.size("points").alias("n_points"), "area", "perimeter", "points")


def nested(rings: DataFrame, mesh: str = "mesh", cells: int = 64) -> DataFrame:
    """rings with areas signed by even-odd nesting, for meshes whose winding tells nothing: a ring in an odd number of others is a hole.

    A ray along x from a ring's first point meets the other rings' segments of its y; they are joined by rows of cells, one
    for each 32 points of a section. A section of one ring has nothing to join.
    """
    section = [mesh, "height_idx"]
    closed = F.transform(F.sequence(F.lit(0), F.size("points") - 1), lambda i: F.struct(F.get("points", i).alias("a"), F.get("points", F.pmod(i + 1, F.size("points"))).alias("b")))
    y = F.transform("points", lambda p: p["y"])
    about = rings.filter("area <> 0").groupBy(*section).agg(F.count("*").alias("_n"), F.sum(F.size("points")).alias("_size"), F.min(F.array_min(y)).alias("low"), F.max(F.array_max(y)).alias("high")).filter("_n > 1")
    count = F.least(F.lit(cells), F.ceil(F.col("_size") / 32))
    about = about.select(*section, "low", ((F.col("high") - F.col("low")) / count).alias("step"))
    base = rings.filter("area <> 0").join(about, section)
    cell = lambda y: F.when(F.col("step") > 0, F.floor((y - F.col("low")) / F.col("step"))).otherwise(0).cast("int")
    each = base.select(*section, F.col("ring").alias("other"), "low", "step", F.explode(closed).alias("s")).select(*section, "other", "low", "step", F.col("s.a.x").alias("ax"), F.col("s.a.y").alias("ay"), F.col("s.b.x").alias("bx"), F.col("s.b.y").alias("by"))
    held = each.filter("ay <> by").withColumn("cell", F.explode(F.sequence(cell(F.least("ay", "by")), cell(F.greatest("ay", "by"))))).drop("low", "step")
    met = base.select(*section, "ring", "low", "step", F.get("points", F.lit(0))["x"].alias("px"), F.get("points", F.lit(0))["y"].alias("py"))
    met = met.withColumn("cell", cell(F.col("py"))).drop("low", "step").join(held, [*section, "cell"])
    above = (F.col("ay") > F.col("py")) != (F.col("by") > F.col("py"))
    crosses = F.col("ax") + F.try_divide(F.col("py") - F.col("ay"), F.col("by") - F.col("ay")) * (F.col("bx") - F.col("ax"))
    depth = met.filter((F.col("other") != F.col("ring")) & above & (crosses > F.col("px"))).groupBy(*section, "ring").agg((F.count("*") % 2).alias("_odd"))
    return rings.join(depth, [*section, "ring"], "left").withColumn("area", F.when(F.col("_odd") == 1, -F.abs("area")).otherwise(F.abs("area"))).drop("_odd").select(rings.columns)


def ring_chains(ends: list[tuple[tuple, tuple]]) -> list[tuple[float, float, bool, np.ndarray]]:
    """(area, perimeter, closed, points) of each chain of one section's segments."""
    at: dict = {}
    for i, (a, b) in enumerate(ends):
        at.setdefault(a, []).append(i)
        at.setdefault(b, []).append(i)
    used, out = [False] * len(ends), []
    for i in sorted(range(len(ends)), key=lambda k: ends[k]):
        if used[i]:
            continue
        used[i] = True
        chain = list(ends[i])
        while chain[-1] != chain[0]:
            free = [k for k in at[chain[-1]] if not used[k]]
            onward = next((k for k in free if ends[k][0] == chain[-1]), free[0] if free else None)
            if onward is None:
                break
            used[onward] = True
            a, b = ends[onward]
            chain.append(b if a == chain[-1] else a)
        closed = chain[-1] == chain[0]
        p = np.array(chain)
        area = float((p[:-1, 0] * p[1:, 1] - p[1:, 0] * p[:-1, 1]).sum()) / 2 if closed else 0.0
        out.append((area, float(np.linalg.norm(np.diff(p, axis=0), axis=1).sum()), closed, p[: len(p) - closed]))
    return out


def _chained(cuts: DataFrame, mesh: str, digits: int) -> DataFrame:
    """Rings of sections that a task holds, one after another."""
    kind, number = (cuts.schema[c].dataType.simpleString() for c in (mesh, "height_idx"))

    def rows(found: list[tuple], types: list[pa.DataType]) -> pa.RecordBatch:
        m, h, ring, area, perimeter, points = zip(*found, strict=True)
        sizes, flat = [len(p) for p in points], np.concatenate(points)
        xy = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["x", "y"])
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), xy)
        columns = [pa.array(m, types[0]), pa.array(h, types[1]), pa.array(ring, pa.int32()), pa.array(sizes, pa.int32()), pa.array(area), pa.array(perimeter), lists]
        return pa.RecordBatch.from_arrays(columns, [mesh, "height_idx", "ring", "n_points", "area", "perimeter", "points"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ends, found, types = None, [], [], []

        def finish() -> None:
            found.extend((*now, i, area, perimeter, p) for i, (area, perimeter, _, p) in enumerate(ring_chains(ends)))

        for b in batches:
            types = [b.schema.field(i).type for i in (0, 1)]
            place = np.round(np.column_stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(2, 6)]), digits).tolist()
            for m, h, (x0, y0, x1, y1) in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), place, strict=True):
                if (m, h) != now:
                    if ends:
                        finish()
                    now, ends = (m, h), []
                if (x0, y0) != (x1, y1):
                    ends.append(((x0, y0), (x1, y1)))
            if found:
                yield rows(found, types)
                found.clear()
        if ends:
            finish()
        if found:
            yield rows(found, types)

    told = dealt(cuts.select(mesh, "height_idx", "x0", "y0", "x1", "y1"), 200_000, mesh, "height_idx").sortWithinPartitions(mesh, "height_idx")
    return told.mapInArrow(run, f"`{mesh}` {kind}, height_idx {number}, ring int, n_points int, area double, perimeter double, points array<struct<x: double, y: double>>")


def section_areas(cuts: DataFrame, mesh: str = "mesh") -> DataFrame:
    """(mesh, height_idx, area): sections' areas without holes, of meshes wound outward and closed; no ring is chained for it."""
    twice = F.col("x0") * F.col("y1") - F.col("x1") * F.col("y0")
    return cuts.groupBy(mesh, "height_idx").agg((F.abs(F.sum(twice)) / 2).alias("area"))


def section_contour(rings: DataFrame, mesh: str = "mesh") -> DataFrame:
    """One row a section: its area without holes, the perimeters' sum and the ring of the most points, the first on ties."""
    best = F.max_by("points", F.struct("n_points", -F.col("ring")))
    return rings.groupBy(mesh, "height_idx").agg(F.round(F.abs(F.sum("area")), 6).alias("area"), F.round(F.sum("perimeter"), 4).alias("perimeter"), best.alias("points"))


def interpolated_z(vertices: DataFrame, heights: DataFrame, index: str = "z") -> DataFrame:
    """Replace a fractional slice index by the height between the two slices' z. heights: (slice, height); beyond the ends, the end's."""
    h = heights.select(F.col("slice").cast("long").alias("_s"), F.col("height").alias("_h"))
    last = F.broadcast(heights.agg(F.max("slice").cast("long").alias("_last")))  # one row
    rows = vertices.crossJoin(last).withColumn("_at", F.least(F.greatest(F.col(index), F.lit(0.0)), F.col("_last").cast("double"))).withColumn("_f", F.floor("_at"))
    rows = rows.join(h.withColumnsRenamed({"_s": "_f", "_h": "_h0"}), "_f").withColumn("_n", F.least(F.col("_f") + 1, F.col("_last")))
    rows = rows.join(h.withColumnsRenamed({"_s": "_n", "_h": "_h1"}), "_n")
    return rows.withColumn(index, F.col("_h0") + (F.col("_at") - F.col("_f")) * (F.col("_h1") - F.col("_h0"))).drop("_last", "_at", "_f", "_n", "_h0", "_h1")
