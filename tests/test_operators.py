"""Hand-computed cases, phantoms and properties of the inspection operators."""

import math
import os
import random
import struct
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from plyforge.functions import geometry, images, names
from plyforge.operators import boxes, compare, layers, meshes, pixels, register, score, segment, toolpath
from plyforge.plans import inspection
from plyforge.sources import files, meshfiles


def test_layer_numbers(spark):
    cases = {"/d/Layer_007.PNG": 7, "img001.jpg": 1, "capa_01.tif": 1, "x_SLICE-05b.bmp": 5, "001.png": 1, "Prefix_012.png": 12, "none.png": None, "a1b.png": None, "layer_99999999999.png": None, "layer.12.png": 12}
    df = spark.createDataFrame([(p,) for p in cases], "p string").withColumn("n", names.layer_number(F.col("p")))
    assert {r.p: r.n for r in df.collect()} == cases


def layer_rows(spark, rows):
    return spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "build_id int, layer_idx int, z double, area double, perimeter double, cx double, cy double, n_points int")


def test_anomalies_by_hand(spark):
    rows = [(0.0, 10.0, 10.0, 0.0, 0.0, 9), (0.2, 10.0, 10.0, 0.0, 2.0, 9), (1.2, 10.0, 16.5, 0.0, 2.0, 2), (1.4, 10.0, 16.5, 9.0, 9.0, 9), (1.4, 1e-9, 16.5, 9.0, 9.6, 9)]
    got = [(r.layer_idx, r.detector_rank, r.severity, r.measured_value) for r in layers.anomalies(layer_rows(spark, rows)).orderBy("detector_rank", "layer_idx").collect()]
    assert got == [(2, 1, "critical", 1.0), (1, 2, "critical", 2.0), (4, 2, "info", 0.6), (2, 3, "critical", 0.65)]
    total = {(r.anomaly_type, r.severity): r.n for r in layers.anomaly_summary(layers.anomalies(layer_rows(spark, rows))).collect()}
    assert total[None, None] == 4 and total["layer_shift", None] == 2 and total[None, "critical"] == 3
    assert layers.anomalies(layer_rows(spark, rows).limit(0)).count() == 0


def test_occlusion_by_hand(spark):
    areas = [10.0, 6.9, 6.9, 3.0, 0.0, 5.0]
    got = [(round(r.confidence, 6), r.flagged) for r in layers.occlusion(layer_rows(spark, [(0.0, a, 1.0, 0.0, 0.0, 9) for a in areas])).orderBy("layer_idx").collect()]
    third = 1 - 2 * (1 - 3 / 6.9 - 0.3)
    assert got == [(1, False), (0.98, False), (1, False), (round(third, 6), True), (0, True), (1, False)]


def test_missing_and_images(spark):
    paths = ["layer_1.png", "b/layer_3.png", "a/layer_3.png", "layer_6.jpg", "layer_4.txt", "cover.png"]
    df = layers.layer_images(spark.createDataFrame([(1, p) for p in paths], "build_id int, path string"))
    assert sorted((r.layer_number, r.path) for r in df.collect()) == [(1, "layer_1.png"), (3, "a/layer_3.png"), (6, "layer_6.jpg")]
    assert sorted(r.layer_number for r in layers.missing_layers(df, number="layer_number").collect()) == [2, 4, 5]


def machine(program):
    """A plain state machine of the toolpath rules."""
    pos, absolute, out = dict.fromkeys("xyz", 0.0), True, []
    for mode, values in program:
        absolute = mode == "absolute" if mode else absolute
        for a, v in values.items():
            pos[a] = v if absolute else pos[a] + v
        out.append(tuple(pos.values()))
    return out


def test_positions_against_a_state_machine(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for file in range(6):
        program = []
        for line in range(40):
            mode = rng.choice([None, None, None, "absolute", "relative"])
            values = {} if mode else {a: round(rng.uniform(-5, 5), 2) for a in "xyz" if rng.random() < 0.5}
            program.append((mode, values))
            text = {"absolute": "G90", "relative": "g91.1"}.get(mode) or "G1 " + " ".join(f"{a.upper()}{v}" for a, v in values.items())
            rows.append((file, line + 1, text + " ; note X9"))
        want[file] = machine(program)
    got = toolpath.parse(spark.createDataFrame(rows, "file int, line_no int, text string")).orderBy("file", "line_no").collect()
    for r in got:
        assert np.allclose((r.pos_x, r.pos_y, r.pos_z), want[r.file][r.line_no - 1])


def test_dead_band_and_parameters(spark):
    text = ["G1 Z0.2", "G1 Z0.204", "G1 Z0.208", "N1 G1 Z9", "G1 X1 Y1", "G1 X2 X3 E1e3", "G28 Z0", "", "; only"]
    df = toolpath.parse(spark.createDataFrame([(1, i, t) for i, t in enumerate(text)], "file int, line_no int, text string"))
    assert [r.z for r in toolpath.layers(df, 0.005).collect()] == [0.2]
    stepped = spark.createDataFrame([(1, 0, "G1 Z0.2"), (1, 1, "G1 Z0.21"), (1, 2, "G1 Z0.2"), (1, 3, "G1 Z0.4")], "file int, line_no int, text string")
    assert [(r.z, r.height) for r in toolpath.layers(toolpath.parse(stepped)).orderBy("layer_idx").collect()] == [(0.2, None), (0.21, 0.01), (0.2, -0.01), (0.4, 0.2)]
    r = df.filter("line_no = 5").first()
    assert (r.x, r.e) == (3.0, 3.0)
    assert [(s.n_points, [tuple(p) for p in s.points]) for s in toolpath.segments(df).collect()] == [(2, [(1.0, 1.0), (3.0, 1.0)])]


def test_statistics_without_rows(spark):
    none = spark.createDataFrame([], "d double")
    assert tuple(compare.distance_stats(none, "d").first()) == (0, 0, 0, 0, 0, 0)
    assert compare.within_tolerance(none, "d").first()[0] == 100.0


@pytest.mark.parametrize("most", [1, 7, 100_000])
def test_percentiles_by_selection(spark, most):
    rng = np.random.default_rng(10)
    for values in (rng.normal(size=900), np.round(rng.normal(size=700)), np.full(300, 2.5), np.exp(40 * rng.normal(size=400)), [3.0], [1.0, 5.0]):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "d double").repartition(3)
        got = compare.distance_stats(df, "d", most=most).first()
        want = [np.mean(values), np.max(values), np.std(values), *np.percentile(values, [50, 95, 99])]
        assert np.allclose(got, want, rtol=1e-9, atol=1e-6)


def test_pairs_by_place_need_equal_numbers(spark):
    masks = spark.createDataFrame([("a", 3, "m3"), ("a", 1, "m1"), ("b", 9, "m9")], "build_id string, layer_number int, mask string")
    heights = spark.createDataFrame([("a", 0.2), ("a", 0.1), ("b", 0.5)], "build_id string, z double")
    assert sorted((r.mask, r.z) for r in layers.paired(masks, heights, "layer_number", "z").collect()) == [("m1", 0.1), ("m3", 0.2), ("m9", 0.5)]
    for left, right in ((masks, heights.filter("z < 0.5")), (masks.filter("layer_number > 1"), heights)):
        with pytest.raises(Exception, match="unequal numbers"):
            layers.paired(left, right, "layer_number", "z").collect()


def test_comparison_with_and_without_layers(spark):
    tris = ball(spark, 3.0)
    vertices = inspection.vertices_of(tris)
    plain = inspection.compare_models(vertices, tris)
    assert sorted(plain) == ["distances", "stats", "within_tolerance"] and plain["stats"].first().max == 0 and plain["within_tolerance"].first()[0] == 100
    z = lambda *rows: spark.createDataFrame(rows, "build_id int, layer_idx int, z double")
    ring = lambda *rows: spark.createDataFrame([(1, i, [(float(x), 0.0), (0.0, 1.0)]) for i, x in rows], "build_id int, layer_idx int, points array<struct<x: double, y: double>>")
    full = inspection.compare_models(vertices, tris, 0.1, z((1, 0, 0.2), (1, 1, 0.4)), z((1, 1, 0.45), (1, 2, 0.6)), ring((0, 1), (1, 2)), ring((1, 4), (5, 1)))
    assert [tuple(r) for r in full["height_errors"].collect()] == [(1, 1, 0.05)] and [tuple(r) for r in full["contour_hausdorff"].collect()] == [(1, 1, 2.0)]


def test_hausdorff_properties(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [(float(x), float(y)) for x, y in rng.normal(size=(7, 2))]) for i in range(4)] + [(9, [(0.0, 0.0)])]
    df = spark.createDataFrame(rows, "k int, points array<struct<x: double, y: double>>")
    assert {r.hausdorff for r in compare.hausdorff(df, df, ["k"]).collect()} == {0.0}
    other = df.withColumn("k", (F.col("k") + 1) % 4)
    assert sorted(compare.hausdorff(df, other, ["k"]).collect()) == sorted(compare.hausdorff(other, df, ["k"]).collect())


def test_nearest_far_and_near(spark):
    rng = np.random.default_rng(2)
    p, t = rng.normal(size=(40, 2)) * 10, rng.normal(size=(15, 2))
    points = spark.createDataFrame([*((i, float(x), float(y)) for i, (x, y) in enumerate(p)), (98, None, 0.0), (99, 0.0, math.nan)], "pid int, x double, y double")
    targets = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(t)], "tid int, x double, y double")
    got = {r.pid: (r.tid, r.distance) for r in compare.nearest(points, targets, ["x", "y"], "pid", "tid").collect()}
    gap = np.linalg.norm(p[:, None] - t[None], axis=2)
    assert {k: v[0] for k, v in got.items()} == dict(enumerate(gap.argmin(axis=1).tolist()))
    assert compare.nearest(points, targets.limit(0), ["x", "y"], "pid", "tid").count() == 0


def ball(spark, radius=8.0):
    return meshes.voxel_faces(meshes.sphere_phantom(spark, 10, radius))


def cloud_of(spark, points, key="vid"):
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], f"{key} long, x double, y double, z double")


@pytest.mark.parametrize("leaf, block, fan", [(64, 128, 4), (3, 5, 1)])
def test_nearest_targets_and_surfaces_by_brute_force(spark, monkeypatch, leaf, block, fan):
    for name, v in (("LEAF", leaf), ("BLOCK", block), ("FAN_BITS", fan)):
        monkeypatch.setattr(boxes, name, v)
    rng = np.random.default_rng(7)
    tris = ball(spark, 4.0)
    held = tris.toPandas()[files.CORNERS].to_numpy(float)
    points = np.concatenate([rng.normal(size=(60, 3)) * 5, rng.normal(size=(20, 3)) + 300, [[0, 0, 0], [0.25, 0.25, 0.25]]])
    df = cloud_of(spark, points).union(spark.createDataFrame([(900, None, 0.0, 0.0), (901, math.inf, 0.0, 0.0)], "vid long, x double, y double, z double"))
    doubled = tris.union(tris).union(tris.selectExpr("volume", *["double('nan')" for _ in files.CORNERS]))
    got = {r.vid: r.distance for r in compare.surface_distance(df, doubled).collect()}
    want = np.stack([compare.triangle_distance(np.repeat(p[None], len(held), 0), held[:, :3], held[:, 3:6], held[:, 6:]).min() for p in points])
    assert sorted(got) == list(range(len(points))) and np.allclose([got[i] for i in range(len(points))], want, atol=1e-12)
    targets = np.round(rng.normal(size=(90, 3)))  # many ties and repeats
    asked = np.concatenate([np.round(rng.normal(size=(50, 3)), 1), rng.normal(size=(10, 3)) * 1e6])
    found = {r.vid: (r.tid, r.distance) for r in compare.nearest(cloud_of(spark, asked), cloud_of(spark, targets, "tid"), ["x", "y", "z"], "vid", "tid").collect()}
    gap = np.sqrt(((asked[:, None] - targets[None]) ** 2).sum(axis=2))
    assert len(found) == 60 and all(np.isclose(found[i][1], gap[i].min(), rtol=1e-12) for i in range(60))
    assert [found[i][0] for i in range(50)] == [min(np.flatnonzero(gap[i] == gap[i].min())) for i in range(50)]
    with pytest.raises(ValueError, match="no triangles"):
        compare.surface_distance(df, tris.limit(0))
    assert compare.surface_distance(df.limit(0), tris).count() == 0


def test_far_points_meet_no_more_leaves_than_near_ones(spark):
    rng = np.random.default_rng(8)
    tris = ball(spark).withColumn("id", F.monotonically_increasing_id())
    leaves = boxes.packed(tris, [[f"{v}{x}" for x in "xyz"] for v in "abc"], 16)
    met = {}
    for name, away in (("near", 8.0), ("far", 130.0)):
        points = cloud_of(spark, rng.normal(size=(3000, 3)) * 0.5 + [away, 0, 0], "id").withColumnsRenamed({"x": "c0", "y": "c1", "z": "c2"})
        blocks = boxes.packed(points, [["c0", "c1", "c2"]], 32)
        met[name] = boxes.candidates(blocks, boxes.levels(leaves, 3), 3).count() / (blocks.count() * leaves.count())
    assert 0 < met["near"] < 0.2 and 0 < met["far"] < 0.35  # of pairs of a block and a leaf, 512 pairs of a point and a triangle each


def test_triangle_distance():
    a, b, c = (np.array([v], float) for v in ([0, 0, 0], [2, 0, 0], [0, 2, 0]))
    for p, want in (([0.5, 0.5, 3], 3), ([-1, -1, 0], math.sqrt(2)), ([2, 2, 0], math.sqrt(2)), ([1, -2, 0], 2), ([5, 0, 4], 5)):
        assert abs(compare.triangle_distance(np.array([p], float), a, b, c)[0] - want) < 1e-12


def test_phantom_surface(spark):
    v = meshes.sphere_phantom(spark, 8, 6.0)
    inside = v.filter("inside").count()
    info = meshes.mesh_info(meshes.voxel_faces(v).withColumnRenamed("volume", "mesh")).first()
    assert info.watertight and abs(info.volume - inside) < 1e-9 and abs(info.center_x) < 1e-9
    assert info.n_vertices - info.n_edges + info.n_faces == 2
    r = meshes.isosurface_vertices(v).select(F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2).alias("r")).agg(F.min("r"), F.max("r")).first()
    assert 5 <= r[0] and r[1] <= 7
    cut = meshes.section_contour(meshes.section_rings(meshes.plane_sections(meshes.voxel_faces(v), spark.createDataFrame([(0, 0.25), (1, 50.0)], "height_idx int, z double"), "volume"), "volume"), "volume").collect()
    assert [(r.height_idx, r.area) for r in cut] == [(0, v.filter("inside and z = 0").count())]


def test_areas_without_holes(spark):
    ring = [(0, z, y, x, not (1 <= x <= 2 and 1 <= y <= 2)) for z in range(2) for y in range(4) for x in range(4)]
    corners = [(1, 0, y, x, x == y) for y in range(3) for x in range(3)]  # touch at corners only
    v = spark.createDataFrame(ring + corners, "volume int, z int, y int, x int, inside boolean")
    cuts = meshes.plane_sections(meshes.voxel_faces(v), spark.createDataFrame([(0, 0.25)], "height_idx int, z double"), "volume")
    assert {r.volume: round(r.area, 9) for r in meshes.section_areas(cuts, "volume").collect()} == {0: 12.0, 1: 3.0}
    rings = meshes.section_rings(cuts, "volume")
    assert {r.volume: r.area for r in meshes.section_contour(rings, "volume").collect()} == {0: 12.0, 1: 3.0}
    assert sorted(r.area for r in rings.filter("volume = 0").collect()) == [-4.0, 16.0]


def test_large_sections_are_chained_by_spark(spark):
    """The same rings from list ranking: random volumes with holes and touching corners, chains left open, repeated and empty segments."""
    rng = np.random.default_rng(12)
    rows = [(k, 0, y, x, bool(rng.random() < 0.6)) for k in range(4) for y in range(7) for x in range(7)]
    v = spark.createDataFrame(rows, "volume int, z int, y int, x int, inside boolean")
    cuts = meshes.plane_sections(meshes.voxel_faces(v), spark.createDataFrame([(0, 0.25)], "height_idx int, z double"), "volume")
    one, two = (meshes.section_contour(r, "volume").orderBy("volume").toPandas() for r in (meshes.section_rings(cuts, "volume"), meshes.section_rings(cuts, "volume", most_local=0)))
    assert np.allclose(one["area"], two["area"]) and np.allclose(one["perimeter"], two["perimeter"]) and len(two) == 4
    inside = v.filter("inside").groupBy("volume").count().orderBy("volume").toPandas()
    rings = meshes.linked_rings(cuts, "volume").toPandas()
    assert np.allclose(rings.groupby("volume")["area"].sum(), inside["count"])
    for r in rings.itertuples():  # every ring is closed, of its stated length, and its area is that of its points
        p = np.array([(q["x"], q["y"]) for q in r.points])
        assert abs((p[:, 0] * np.roll(p[:, 1], -1) - np.roll(p[:, 0], -1) * p[:, 1]).sum() / 2 - r.area) < 1e-9 and r.n_points == len(p)
        assert abs(np.linalg.norm(np.roll(p, -1, axis=0) - p, axis=1).sum() - r.perimeter) < 1e-9
    turned_ = cuts.withColumn("f", F.pmod(F.xxhash64("x0", "y0"), F.lit(2)) == 0).select("volume", "height_idx", *[F.when(F.col("f"), F.col(a)).otherwise(F.col(b)).alias(a) for a, b in (("x0", "x1"), ("y0", "y1"), ("x1", "x0"), ("y1", "y0"))])
    mixed = meshes.nested(meshes.linked_rings(turned_, "volume"), "volume").groupBy("volume").agg(F.sum("area").alias("a")).orderBy("volume").toPandas()
    assert np.allclose(mixed["a"], inside["count"])  # windings of no meaning: even-odd nesting
    open_ = spark.createDataFrame([(0, 0, 0.0, 0.0, 1.0, 0.0), (0, 0, 1.0, 0.0, 1.0, 1.0), (0, 0, 5.0, 5.0, 5.0, 5.0), (1, 0, 2.0, 2.0, 3.0, 2.0)], "volume int, height_idx int, x0 double, y0 double, x1 double, y1 double")
    for most in (0, 100):
        got = {r.volume: r for r in meshes.section_rings(open_, "volume", most_local=most).collect()}
        assert [(q.x, q.y) for q in got[0].points] == [(0, 0), (1, 0), (1, 1)] and got[0].area == 0 and got[1].n_points == 2 and got[0].perimeter == 2


def test_sections_ranked_in_tasks_are_those_ranked_by_joins(spark, monkeypatch):
    rng = np.random.default_rng(5)
    on = rng.random((3, 6, 6)) < 0.55
    rows = [(f"m{k}", 0, y, x, bool(on[k, y, x])) for k in range(3) for y in range(6) for x in range(6)]
    v = spark.createDataFrame(rows, "mesh string, z int, y int, x int, inside boolean")
    cuts = meshes.plane_sections(meshes.voxel_faces(v, "mesh"), spark.createDataFrame([(0, 0.25), (1, 0.75)], "height_idx int, z double"))
    f = F.pmod(F.xxhash64("x0", "y0"), F.lit(3)) == 0
    turned_ = cuts.select("mesh", "height_idx", *[F.when(f, F.col(a)).otherwise(F.col(b)).alias(a) for a, b in (("x0", "x1"), ("y0", "y1"), ("x1", "x0"), ("y1", "y0"))])
    more = [("m9", 0, 0.0, 0.0, 1.0, 0.0), ("m9", 0, 1.0, 0.0, 1.0, 1.0), ("m9", 0, 1.0, 0.0, 2.0, -1.0), ("m9", 0, 5.0, 5.0, 5.0, 5.0), ("m9", 0, 7.0, 7.0, 8.0, 7.0), ("m9", 0, 7.0, 7.0, 8.0, 7.0)]
    every = turned_.unionByName(spark.createDataFrame(more, turned_.schema)).cache()
    told = lambda df: sorted((r.mesh, r.height_idx, r.ring, r.n_points, round(r.area, 9), round(r.perimeter, 9), tuple((p.x, p.y) for p in r.points)) for r in df.collect())
    want = told(meshes.linked_rings(every, most_local=0))
    monkeypatch.setattr(meshes, "doubled", None)  # no rounds of joins where tasks hold the sections
    for chunk in (50_000, 7):
        monkeypatch.setattr(meshes, "CHUNK", chunk)
        assert told(meshes.linked_rings(every)) == want


def test_a_ring_longer_than_a_task_would_hold(spark):
    n = 3000
    turn = 2 * math.pi / n
    at = lambda f, i: F.round(100 * f(i * turn), 6)
    cuts = spark.range(n).select(F.lit(0).alias("mesh"), F.lit(0).alias("height_idx"), at(F.cos, F.col("id")).alias("x0"), at(F.sin, F.col("id")).alias("y0"), at(F.cos, F.pmod(F.col("id") + 1, F.lit(n))).alias("x1"), at(F.sin, F.pmod(F.col("id") + 1, F.lit(n))).alias("y1"))
    (ring,) = meshes.section_rings(cuts, most_local=1000).collect()
    assert ring.n_points == n and abs(ring.area / (math.pi * 100**2) - 1) < 1e-5
    p = np.array([(q.x, q.y) for q in ring.points])
    assert np.allclose(p[0], p[p[:, 0].argmin()]) and np.linalg.norm(np.diff(p, axis=0), axis=1).max() < 0.3


def test_marching_cubes(spark):
    """Every mask gives closed loops over its crossed edges; a sphere phantom gives one closed surface of about its volume."""
    for mask in range(1, 255):
        crossed = {(a, b) for a in range(8) for b in range(a + 1, 8) if (a ^ b).bit_count() == 1 and (mask >> a & 1) != (mask >> b & 1)}
        loops = meshes.cell_loops(mask)
        assert sorted(e for loop in loops for e in loop) == sorted(crossed) and all(len(loop) >= 3 for loop in loops)
    v = meshes.sphere_phantom(spark, 20, 15.0)
    for step, least in ((1, 14_100 * 0.97), (4, 14_100 * 0.8)):
        tris = meshes.marching_cubes(v, step=step).withColumnRenamed("volume", "mesh").cache()
        info = meshes.mesh_info(tris).first()
        assert meshes.open_edges(tris).first().open_edges == 0 and info.watertight
        assert info.n_vertices - info.n_edges + info.n_faces == 2 and least < info.volume < 14_137 * (1.02 if step == 1 else 1.12)
        signed = tris.selectExpr('ax * (by * cz - bz * cy) + ay * (bz * cx - bx * cz) + az * (bx * cy - by * cx) AS v').agg(F.sum('v')).first()[0] / 6
        assert abs(signed - info.volume) < 1e-6  # wound outward
        assert (info.min_x, info.max_z) == ((-14.5, 14.5) if step == 1 else (-14.0, 14.0))
    assert meshes.marching_cubes(v.limit(0)).count() == 0


def test_grey_levels_give_smooth_surfaces(spark):
    v = meshes.sphere_phantom(spark, 20, 15.0).withColumn("v", F.greatest(F.lit(0.0), F.least(F.lit(255.0), 127 + 40 * (15.3 - F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)))))
    tris = meshes.marching_cubes(v, value="v", level=127.0).withColumnRenamed("volume", "mesh").cache()
    info = meshes.mesh_info(tris).first()
    assert info.watertight and meshes.open_edges(tris).first().open_edges == 0 and info.n_vertices - info.n_edges + info.n_faces == 2
    assert abs(info.area / (4 * math.pi * 15.3**2) - 1) < 0.01 and abs(info.volume / (4 / 3 * math.pi * 15.3**3) - 1) < 0.01
    assert np.allclose(meshes.area_centroid(tris), 0, atol=1e-4)
    with pytest.raises(ValueError, match="below 0"):
        meshes.marching_cubes(v, value="v", level=-1.0)


def test_sides_of_two_opposite_corners(spark):
    """Random grey levels have many such sides; every choice closes, and the saddle decides whether corners are joined."""
    assert all(sorted(e for loop in meshes.cell_loops(m, j) for e in loop) == sorted(e for e in meshes.EDGES if (m >> e[0] & 1) != (m >> e[1] & 1)) for m, j, _ in meshes.cell_table())
    rng = np.random.default_rng(4)
    rows = [(k, z, y, x, float(rng.integers(0, 256))) for k in range(3) for z in range(6) for y in range(6) for x in range(6)] + [(0, 9, 9, 9, None)]
    df = spark.createDataFrame(rows, "volume int, z int, y int, x int, v double")
    tris = meshes.marching_cubes(df.withColumn("v", F.when(F.col("x") % 3 == 0, 127.0).otherwise(F.col("v"))), value="v", level=127.0)  # many at the level itself
    assert {r.open_edges for r in meshes.open_edges(tris, "volume").collect()} == {0} and not tris.filter("ax = bx and ay = by and az = bz").count()
    tris = meshes.marching_cubes(df, value="v", level=127.3)
    assert {r.open_edges for r in meshes.open_edges(tris, "volume").collect()} == {0}
    for corner, parts in ((40.0, 2), (120.0, 1)):  # two bright corners of a square: apart, or joined over a bright saddle
        flat = spark.createDataFrame([(0, 0, 0, 0, 200.0), (0, 0, 1, 1, 200.0), (0, 0, 0, 1, corner), (0, 0, 1, 0, corner)], "volume int, z int, y int, x int, v double")
        info = meshes.mesh_info(meshes.marching_cubes(flat, value="v", level=127.0).withColumnRenamed("volume", "mesh")).first()
        assert info.watertight and info.n_vertices - info.n_edges + info.n_faces == 2 * parts


def test_a_hole_of_one_point_is_a_vertex(spark, tmp_path):
    from plyforge.plans import catalog

    hole = [0.5] * 64
    hole[21] = 0.002  # grey level 127, the surface's own, among voxels over it
    line = [0.002 if i % 4 == 1 else 0.5 for i in range(64)]
    spark.createDataFrame([(1, hole), (2, line), (3, [0.5] * 64)], "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.execute(catalog.ORACLES["grey_surface"])
    names = [c[0] for c in want.description]
    got = {r.mesh: r for r in catalog.grey_surface(spark, str(tmp_path)).collect()}
    assert got[1].n_vertices == got[3].n_vertices + 1 and got[1].sum_x == got[3].sum_x + 1 and got[1].open_edges == 0
    assert sorted(tuple(r[c] for c in names) for r in got.values()) == sorted(want.fetchall())


def test_heights_of_surfaces(spark):
    v = spark.createDataFrame([(0, z, y, x, True) for z in range(3) for y in range(2) for x in range(2)], "volume int, z int, y int, x int, inside boolean")
    h = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 5.0)], "slice int, height double")
    tris = meshes.lifted(meshes.marching_cubes(v), h)
    assert sorted({r[0] for c in "abc" for r in tris.select(f"{c}z").collect()}) == [0.0, 1.0, 2.0, 5.0, 6.0]


def test_interpolated_heights(spark):
    v = spark.createDataFrame([(0.5,), (-0.5,), (1.0,), (2.5,)], "z double")
    h = spark.createDataFrame([(0, 0.0), (1, 1.0), (2, 4.0)], "slice int, height double")
    assert sorted(r.z for r in meshes.interpolated_z(v, h).collect()) == [0.0, 0.5, 1.0, 4.0]


def test_registration(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(size=(60, 3)) * [4, 2, 1]
    c, s = math.cos(0.4), math.sin(0.4)
    b = a @ np.array([[c, -s, 0], [s, c, 0], [0, 0, 1]]).T + [1, -2, 0.5]
    pairs = spark.createDataFrame([(*map(float, p), *map(float, q)) for p, q in zip(a, b)], "sx double, sy double, sz double, tx double, ty double, tz double")
    assert np.allclose(register.kabsch_3d(pairs), register.kabsch(a, b)) and np.allclose(register.moved(a, register.kabsch(a, b)), b)
    flat = register.kabsch_2d(pairs).first()
    assert abs(flat.angle - 0.4) < 1e-9 and abs(flat.shift_x - 1) < 1e-9 and flat.error < 1e-9
    cloud = lambda p: spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(p)], "vid long, x double, y double, z double")
    runs = register.align_from_starts(cloud(a), cloud(b))
    best = register.best_alignment(runs).first()
    assert runs.count() == 24 and best.error < 1e-6 and np.allclose(register.moved(a, np.array(best.matrix)), b)
    box = meshes.voxel_faces(spark.createDataFrame([(0, z, y, x, True) for z in range(4) for y in range(3) for x in range(2)], "volume int, z int, y int, x int, inside boolean"))
    wide = box.select("volume", *[(F.col(f"{v}{x}") * (1 if x == "z" else 2) + 5).alias(f"{v}{x}") for v in "abc" for x in "xyz"])
    xy, z, shift = register.prealign(box, wide)
    assert (xy, z) == (2.0, 1.0) and np.allclose(shift, [5 + 0.5, 5 + 1, 5])


def test_every_pair_of_clouds_is_aligned(spark, tmp_path):
    from plyforge.plans import catalog

    rng = np.random.default_rng(6)
    vectors = [(i, [float(v) for v in rng.normal(size=64)]) for i in range(18)]
    vectors[17] = (17, None)
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.cloud: r for r in catalog.QUERIES["icp_multistart"](spark, str(tmp_path)).collect()}
    assert sorted(got) == [0, 1, 2, 3]  # the fifth cloud has one polygon and no next cloud

    def cloud(c):
        return spark.createDataFrame([(32 * i + k, *map(float, np.float32(v[2 * k : 2 * k + 2])), i % 4 * 0.1) for i, v in vectors if v and i // 4 == c for k in range(32)], "vid long, x double, y double, z double")

    for c in (1, 3):
        want = register.best_alignment(register.align_from_starts(cloud(c), cloud(c + 1))).first()
        assert abs(got[c].error - want.error) < 1e-5


def test_score(spark):
    parts = spark.createDataFrame([(90.0, 100.0, 60.0, 8, 10), (0.0, 0.0, 0.0, 1, 0)], "dimensional double, layer double, anomaly double, n_processed int, n_expected int")
    got = [(round(r.score, 6), r.grade) for r in score.quality(parts).orderBy(F.desc("score")).collect()]
    assert got == [(83.5, "B"), (15.0, "F")]
    found = spark.createDataFrame([("critical",)] * 7 + [("info",)], "severity string")
    assert score.anomaly_score(found).first().anomaly == 0.0 and score.anomaly_score(found.limit(0)).first().anomaly == 100.0


def annulus(n=60, outer=25.0, inner=10.0):
    y, x = np.mgrid[:n, :n] - (n - 1) / 2
    r = np.hypot(x, y)
    return np.where((r <= outer) & (r >= inner), 255, 0).astype(np.uint8)


def test_outlines_of_an_annulus():
    ((outer, holes),) = images.outlines(annulus())
    assert len(holes) == 1
    assert abs(images.closed_area(outer) / (math.pi * 25**2) - 1) < 0.06 and abs(images.closed_area(holes[0]) / (math.pi * 10**2) - 1) < 0.12
    slim = images.simplified(images.corners(outer), 0.002 * images.closed_length(outer))
    assert 8 < len(slim) < len(outer) and abs(images.closed_area(slim) / images.closed_area(outer) - 1) < 0.02


def test_borders_of_odd_shapes():
    one = np.zeros((3, 3), np.uint8)
    one[1, 1] = 255
    assert images.outlines(one)[0][0].tolist() == [[1, 1]]
    square = np.zeros((6, 7), np.uint8)
    square[1:4, 2:6] = 255
    assert images.corners(images.outlines(square)[0][0]).tolist() == [[2, 1], [5, 1], [5, 3], [2, 3]] and images.closed_area(images.outlines(square)[0][0]) == 6
    line = np.zeros((3, 6), np.uint8)
    line[1, 1:5] = 255
    assert images.closed_area(images.outlines(line)[0][0]) == 0
    assert images.outlines(np.zeros((4, 4), np.uint8)) == []
    _, n = images.labels(np.array([[255, 0], [0, 255]], np.uint8))
    assert n == 1 and images.labels(np.array([[255, 0], [0, 255]], np.uint8), diagonal=False)[1] == 2


def test_segmentation_kernels():
    flat = np.full((20, 20), 90, np.uint8)
    assert (images.blur(flat, 4) == 90).all() and (images.adaptive(flat) == 255).all()
    half = np.where(np.arange(400).reshape(20, 20) % 20 < 10, 40, 200).astype(np.uint8)
    assert 40 <= images.otsu_level(half) < 200 and (images.otsu(half) == np.where(half > 100, 255, 0)).all()
    small = annulus()
    small[0, 0] = 255
    filled = images.without_small(small, 100)
    assert filled[0, 0] == 0 and filled[30, 30] == 255
    p = segment.SegmentationParams(kernel_size=3, min_area=10, blur_size=0, background=np.full((10, 10), 40, np.uint8), difference=30)
    assert (segment.segment_array(half, "background_subtraction", p)[:, 12:] == 255).all()
    with pytest.raises(ValueError):
        segment.segment_array(half, "background_subtraction")
    color = np.zeros((1, 1, 3), np.uint8)
    color[0, 0] = (255, 0, 0)
    assert images.gray(color)[0, 0] == 29


def test_pixel_tables_agree_with_kernels(spark):
    rng = np.random.default_rng(5)
    image = rng.integers(0, 256, (12, 9)).astype(np.uint8)
    df = spark.createDataFrame([(1, y, x, int(image[y, x])) for y in range(12) for x in range(9)], "image int, y int, x int, v int")
    as_array = lambda d: np.array([[r.v for r in d.filter(f"y = {y}").orderBy("x").collect()] for y in range(12)])
    assert pixels.otsu_levels(df).first().level == images.otsu_level(image)
    mask = np.where(image > 127, 255, 0).astype(np.uint8)
    assert (as_array(pixels.open_close(pixels.threshold(df), 3)) == images.open_close(mask, pixels.ellipse(3))).all()


def png(image):
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    h, w = image.shape
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(b"\0" + r.tobytes() for r in image))) + chunk(b"IEND", b"")


def test_whole_inspection(spark, tmp_path):
    square = np.zeros((24, 24), np.uint8)
    square[4:20, 6:18] = 255
    (tmp_path / "img").mkdir()
    for i in (1, 2, 3, 4, 6):
        (tmp_path / "img" / f"layer_{i:03d}.png").write_bytes(png(square))
    (tmp_path / "img" / "broken_9.png").write_bytes(b"no image")
    (tmp_path / "a.gcode").write_text("G90\r\nG1 Z1.0 ; up\r\nG1 X1 Y1\rG1 X2\nG1 Z2.0\nG1 Z5\n")
    box = meshes.voxel_faces(spark.createDataFrame([(0, z, y, x, True) for z in range(4) for y in range(16) for x in range(12)], "volume int, z int, y int, x int, inside boolean"))
    corners = box.toPandas()[files.CORNERS].to_numpy(float)
    (tmp_path / "box.obj").write_text("".join("v {} {} {}\nv {} {} {}\nv {} {} {}\nf -3 -2 -1\n".format(*r) for r in corners))
    steps = []
    out = inspection.run(spark, inspection.BuildSettings(images_dir=str(tmp_path / "img"), mesh_file=str(tmp_path / "box.obj"), toolpath_file=str(tmp_path / "a.gcode")), lambda p, s: steps.append(p))
    assert out.error is None and steps[-1] == 100
    assert [r.z for r in out.tables["tool_layers"].orderBy("layer_idx").collect()] == [1.0, 2.0, 5.0]
    z = sorted(r.z_height for r in out.tables["masks"].select("z_height").collect())
    assert z == [0.0, 1.25, 2.5, 3.75, 5.0]
    assert out.tables["contours"].count() == 5 and not out.tables["occlusion"].filter("flagged").count()
    q = out.tables["quality"].first()
    assert q.grade in "ABCDF" and 0 <= q.score <= 100
    assert inspection.run(spark, inspection.BuildSettings()).error
    told = []
    kept = inspection.run(spark, inspection.BuildSettings(images_dir=str(tmp_path / "img"), calibration_profile=str(tmp_path / "none.json"), scale_mm_per_px=0.5), lambda p, s: told.append(s))
    assert kept.error is None and kept.scale == 0.5 and any("calibration profile" in s for s in told) and "quality" not in kept.tables


def test_mesh_files(spark, tmp_path):
    t = np.arange(18, dtype=float).reshape(2, 9)
    stl = bytes(80) + struct.pack("<I", 2) + b"".join(struct.pack("<12fH", 0, 0, 0, *r, 0) for r in t)
    (tmp_path / "a.stl").write_bytes(stl)
    (tmp_path / "b.stl").write_text("solid x\n" + "".join("facet normal 0 0 0\nouter loop\n" + "".join(f"vertex {r[i]} {r[i + 1]} {r[i + 2]}\n" for i in (0, 3, 6)) + "endloop\nendfacet\n" for r in t) + "endsolid\n")
    points = t.reshape(-1, 3)
    head = "ply\nformat {}\nelement vertex 6\nproperty float x\nproperty float y\nproperty float z\nelement face 2\nproperty list uchar int vertex_indices\nend_header\n"
    (tmp_path / "c.ply").write_text(head.format("ascii 1.0") + "".join("{} {} {}\n".format(*p) for p in points) + "3 0 1 2\n3 3 4 5\n")
    (tmp_path / "d.ply").write_bytes(head.format("binary_little_endian 1.0").encode() + points.astype("<f4").tobytes() + b"".join(struct.pack("<B3i", 3, *f) for f in ((0, 1, 2), (3, 4, 5))))
    got = files.read_triangles(spark, str(tmp_path)).orderBy("mesh", "fid").toPandas()
    assert len(got) == 8 and (got[files.CORNERS].to_numpy().reshape(4, 18) == t.reshape(-1)).all()
    vertices, faces = files.indexed(files.read_triangles(spark, str(tmp_path)).filter("mesh like '%a.stl'"))
    assert vertices.count() == 6 and meshes.triangles(vertices, faces).count() == 2
    for kind in ("obj", "stl"):
        one = files.read_triangles(spark, str(tmp_path / "a.stl")).withColumn("mesh", F.lit("m")).coalesce(1)
        files.write_meshes(one, str(tmp_path / f"out-{kind}"), kind)
        (part,) = (tmp_path / f"out-{kind}" / "mesh=m").glob("*.txt")
        assert (files.parse_mesh(f"x.{kind}", part.read_bytes()).reshape(-1, 9) == t).all()


def test_layer_images_of_a_folder(spark, tmp_path):
    folder = tmp_path / "a folder"
    folder.mkdir()
    for name, grey in (("layer_2.PNG", 20), ("layer_10.png", 100), ("Layer-2b.txt", 0), ("none.png", 50), ("a+b% img3.jpeg", 30), ("layer_2_copy.png", 21)):
        (folder / name).write_bytes(png(np.full((3, 4), grey, np.uint8)))
    (folder / "layer_5.png").write_bytes(b"no image")
    got = files.read_layer_images(spark, str(folder), 0.5).orderBy("layer_number").collect()
    assert [(r.layer_number, r.z_height, r.image.height, r.image.data[0]) for r in got] == [(2, 1.0, 3, 20), (3, 1.5, 3, 30), (10, 5.0, 3, 100)]
    (tmp_path / "empty").mkdir()
    assert files.read_layer_images(spark, str(tmp_path / "empty")).count() == 0


def test_large_mesh_files(spark, tmp_path):
    rng = np.random.default_rng(3)
    t = rng.normal(size=(1000, 9)).astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(t)] + [(5000, None, *[0.0] * 8)], "fid long, " + ", ".join(f"{c} double" for c in files.CORNERS)).repartition(7)
    for kind, name in (("stl", "a.stl"), ("ply", "b.ply"), ("ply_big", "c.ply")):
        path = str(tmp_path / "out" / name)
        assert meshfiles.write_mesh(df, path, kind) == 1000
        assert (files.parse_mesh(path, open(path, "rb").read()).reshape(-1, 9) == t).all()
    path = str(tmp_path / "out" / "a.stl")
    assert sorted(os.listdir(tmp_path / "out")) == ["a.stl", "b.ply", "c.ply"]
    got = meshfiles.read_stl(spark, path, per_task=130)
    assert got.rdd.getNumPartitions() == 8 and (got.orderBy("fid").toPandas()[files.CORNERS].to_numpy() == t).all()
    assert files.read_triangles(spark, path).count() == 1000
    assert meshfiles.write_mesh(df.limit(0), str(tmp_path / "none.stl")) == 0 and meshfiles.read_stl(spark, str(tmp_path / "none.stl")).count() == 0
    (tmp_path / "text.stl").write_text("solid x\nendsolid x\n" + " " * 100)
    with pytest.raises(Exception, match="no binary STL"):
        meshfiles.read_stl(spark, str(tmp_path / "text.stl")).count()
    with pytest.raises(ValueError, match="written as"):
        meshfiles.write_mesh(df, path, "obj")


def test_settings_and_profiles(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"quality_score": {"weights": {"layer": 0.5}}}')
    s = files.load_settings(str(tmp_path / "s.json"))
    assert files.setting(s, "quality_score.weights.layer") == 0.5 and files.setting(s, "quality_score.weights.anomaly") == 0.25 and files.setting(s, "no.such", 3) == 3
    assert files.DEFAULTS["quality_score"]["weights"]["layer"] == 0.25
    (tmp_path / "s.json").write_text("{broken")
    assert files.load_settings(str(tmp_path / "s.json")) == files.DEFAULTS
    files.save_settings(str(tmp_path / "d" / "t.json"), s)
    assert files.load_settings(str(tmp_path / "d" / "t.json")) == s
    (tmp_path / "p.json").write_text('{\n"name": "cam", "scale_mm_per_pixel": 0.05, "camera_matrix": null, "image_size": [4, 3], "origin_offset_px": [0, 0]}')
    p = files.read_profiles(spark, str(tmp_path / "p.json")).first()
    assert (p.name, p.scale_mm_per_pixel, p.camera_matrix, p.image_size) == ("cam", 0.05, None, [4, 3])


def test_polygon_functions_at_the_edges(spark):
    rows = [(0, []), (1, [(0.0, 0.0)]), (2, [(0.0, 0.0), (3.0, 4.0)]), (3, [(0.0, 0.0), (4.0, 0.0), (4.0, 3.0)]), (4, None)]
    df = spark.createDataFrame(rows, "k int, p array<struct<x: double, y: double>>")
    p = F.col("p")
    got = df.select("k", geometry.shoelace_area(p).alias("a"), geometry.polyline_length(p).alias("l"), geometry.perimeter(p).alias("q"), geometry.vertex_mean(p).alias("m")).orderBy("k").collect()
    assert [(r.a, r.l, r.q) for r in got] == [(0, 0, 0), (0, 0, 0), (0, 5, 10), (6, 7, 12), (0, 0, 0)]
    assert got[0].m is None and tuple(got[3].m) == (8 / 3, 1.0) and got[4].m is None
    with pytest.raises(Exception, match="scale"):
        spark.range(1).select(geometry.scale_from_line(F.lit(0.0), F.lit(3.0))).collect()


def test_display(spark):
    from plyforge.functions import display

    row = spark.range(1).select(
        display.gauge_state(F.lit(80)).alias("a"), display.gauge_state(F.lit(39.9)).alias("b"), display.severity_state(F.lit("CRITICAL")).alias("c"), display.severity_state(F.lit("warning")).alias("d"),
        display.scale_from_ends(F.lit(0.0), F.lit(0.0), F.lit(30.0), F.lit(40.0), F.lit(10.0)).alias("e"), display.scale_from_ends(F.lit(0.0), F.lit(0.0), F.lit(3.0), F.lit(0.0), F.lit(10.0)).alias("f"),
    ).first()
    assert tuple(row) == ("success", "error", "error", "text", 0.2, None)


def test_registered_queries_run_and_have_stable_names(spark):
    from plyforge.plans import catalog

    assert set(catalog.ORACLES) <= set(catalog.QUERIES) and len(catalog.QUERIES) >= 30
    out = catalog.QUERIES["contour_shapes"](spark, "/root/testdata/sf0.001").toPandas()
    assert len(out) == catalog.QUERIES["contours"](spark, "/root/testdata/sf0.001").count()


def kept_points(points, epsilon):
    """Douglas-Peucker of an open line as a plain recursion."""
    (x0, y0), (x1, y1) = points[0], points[-1]
    length = math.hypot(x1 - x0, y1 - y0)
    away = [abs((x1 - x0) * (y - y0) - (y1 - y0) * (x - x0)) / length if length else math.hypot(x - x0, y - y0) for x, y in points[1:-1]]
    if not away or max(away) <= epsilon:
        return [points[0], points[-1]]
    k = away.index(max(away)) + 1
    return kept_points(points[: k + 1], epsilon)[:-1] + kept_points(points[k:], epsilon)


def test_shapes_of_contours_by_brute_force(spark):
    from plyforge.plans import catalog, views

    got = {(r.image, r.contour_idx): r for r in catalog.QUERIES["contour_shapes"](spark, "/root/testdata/sf0.001").collect()}
    pixels_of = views.pixels(spark, "/root/testdata/sf0.001").toPandas().sort_values(["image", "y", "x"])
    n = 0
    for image, p in pixels_of.groupby("image"):
        mask = np.where(p["v"].to_numpy().reshape(8, 8) > 127, 255, 0).astype(np.uint8)
        found = [(o, h) for o, h in images.outlines(mask) if images.closed_area(o) >= 1]
        for k, (outer, holes) in enumerate(found):

            def size(border):
                corners = images.corners(border).tolist()
                far = max(range(len(corners)), key=lambda i: math.dist(corners[i], corners[0]))
                ring, eps = [*corners, corners[0]], 0.002 * images.closed_length(border)
                return len(corners) if len(corners) < 4 else len(kept_points(ring[: far + 1], eps)) + len(kept_points(ring[far:], eps)) - 2

            row = got[image, k]
            round_ = 4 * math.pi * images.closed_area(outer) / images.closed_length(outer) ** 2 * min(1, size(outer) / 10)
            assert (row.n_points, list(row.hole_points)) == (size(outer), [size(h) for h in holes]) and abs(row.confidence - min(1, round_)) < 2e-6
            n += 1
    assert n == len(got) > 50


def test_specks_and_holes_by_brute_force():
    """Boxes change nothing: every component's and hole's border, against whole-image comparisons."""
    rng = np.random.default_rng(9)
    mask = (255 * (rng.random((40, 50)) < 0.55)).astype(np.uint8)
    part, n = images.labels(mask)
    empty, m = images.labels(255 * (mask == 0).astype(np.uint8), diagonal=False)
    found = images.outlines(mask)
    assert len(found) == n
    edge = set(np.concatenate([empty[0], empty[-1], empty[:, 0], empty[:, -1]]).tolist())
    assert sum(len(holes) for _, holes in found) == len(set(range(1, m + 1)) - edge)
    for i, (outer, holes) in enumerate(found, 1):
        y, x = np.argwhere(part == i)[0]
        assert (outer == images.border(part == i, (int(y), int(x)))).all()
        assert all((part[y.astype(int), x.astype(int)] == i).all() for x, y in (h.T for h in holes))
    seen = {}
    for y, x in np.argwhere(mask > 0).tolist():  # flood fill
        if (y, x) in seen:
            continue
        todo, name = [(y, x)], len(set(seen.values()))
        while todo:
            p = todo.pop()
            if p in seen or not (0 <= p[0] < 40 and 0 <= p[1] < 50) or not mask[p]:
                continue
            seen[p] = name
            todo += [(p[0] + a, p[1] + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    assert len(set(seen.values())) == n and len({(seen[p], int(part[p])) for p in seen}) == n


@pytest.mark.parametrize("constrain_z", [True, False])
def test_large_targets_are_searched_by_spark(spark, constrain_z):
    """The same motions as runs that hold the target in a task, with a start given too."""
    rng = np.random.default_rng(5)
    a = rng.normal(size=(150, 3)) * [5, 2, 1]
    c, s = math.cos(0.2), math.sin(0.2)
    b = np.concatenate([a @ np.array([[c, -s, 0], [s, c, 0], [0, 0, 1]]).T + [1, -2, 0.5], rng.normal(size=(20, 3)) * 6])
    options = {"step_degrees": 180, "most": 8, "constrain_z": constrain_z}
    small = {r.angle: r for r in register.align_from_starts(cloud_of(spark, a), cloud_of(spark, b), **options).collect()}
    large = {r.angle: r for r in register.align_from_starts(cloud_of(spark, a), cloud_of(spark, b), most_local=10, **options).collect()}
    assert sorted(small) == sorted(large) == [0, 180]
    for k, r in small.items():
        assert (r.iterations, r.converged) == (large[k].iterations, large[k].converged) and abs(r.error - large[k].error) < 1e-9 and np.allclose(r.matrix, large[k].matrix, atol=1e-9)
    first = np.eye(4)
    first[:3, 3] = [1.2, -2.1, 0.4]
    one, two = (register.align(cloud_of(spark, a), cloud_of(spark, b), initial=first, most=6, most_local=m, constrain_z=constrain_z) for m in (10, 10_000))
    assert np.allclose(one.matrix, two.matrix, atol=1e-9) and one.iterations == two.iterations
    m, errors, settled = register.icp(a, b, 6, 0.001, constrain_z, first)
    assert np.allclose(m, two.matrix, atol=1e-9) and settled == two.converged and abs(errors[-1] - two.error) < 1e-9
    with pytest.raises(ValueError, match="points"):
        register.align(cloud_of(spark, a).limit(0), cloud_of(spark, b))


def test_profiles_projects_and_dotted_names(spark, tmp_path):
    rows = [("a", 0.05, [[1.0, 0.0, 2.0], [0.0, 1.0, 3.0], [0.0, 0.0, 1.0]], [0.1, 0.2], [640, 480], [0.0, 0.0], 0.5, "n"), ("b", 0.1, None, None, None, None, None, None), ("b", 0.1, None, None, None, None, None, None), (None, 1.0, None, None, None, None, None, None)]
    files.write_profiles(spark.createDataFrame(rows, files.PROFILE), str(tmp_path / "profiles"))
    files.write_profiles(spark.createDataFrame([("c d", 0.2, *[None] * 6)], files.PROFILE), str(tmp_path / "profiles"))
    assert sorted((r.name, r.scale_mm_per_pixel, r.image_size) for r in files.read_profiles(spark, str(tmp_path / "profiles")).collect()) == [("a", 0.05, [640, 480]), ("b", 0.1, None), ("c d", 0.2, None)]
    assert [r.name for r in files.list_profiles(spark, str(tmp_path / "profiles")).collect()] == ["a", "b", "c d"]
    files.write_profiles(spark.createDataFrame([("b", 0.7, *[None] * 6), ("", 9.0, *[None] * 6)], files.PROFILE), str(tmp_path / "profiles"))
    assert [(r.name, r.scale_mm_per_pixel) for r in files.list_profiles(spark, str(tmp_path / "profiles")).collect()] == [("a", 0.05), ("b", 0.7), ("c d", 0.2)]
    assert not [x for x in os.listdir(tmp_path / "profiles") if x.startswith(".saving")]
    assert files.merged({"a": {"b": 1, "c": {}}, "d": 1}, {"a": {"b": {"e": 2}}, "d": {"f": {}}}) == {"a": {"c": {}, "b": {"e": 2}}, "d": {"f": {}}}
    assert files.setting({"a": {"b": {"c": 1}}}, "a.b") == {"c": 1} and files.setting({"a": 1}, "a.b", 5) == 5
    assert files.with_setting({"a": {"b": 1}, "x": 2}, "a.c.d", 3) == {"a": {"b": 1, "c": {"d": 3}}, "x": 2} and files.with_setting({"x": 2}, "x.y", 1) == {"x": {"y": 1}}
    folder = str(tmp_path / "part7")
    project = files.load_project(folder)
    assert project["name"] == "part7" and project["layer_height_mm"] == 0.2
    files.save_project(folder, project | {"images_dir": "/i", "tolerance_mm": 0.3})
    settings = inspection.of_project(files.load_project(folder), 0.05)
    assert (settings.images_dir, settings.tolerance_mm, settings.scale_mm_per_px) == ("/i", 0.3, 0.05)


def test_many_small_sections_in_a_task(spark):
    """Sections that share a task, and batches that end inside one, give each section's own rings; ids beyond 2^53 and null ones stay."""
    base = 2**60
    square = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]
    side = lambda m, h, k, n: (m, h, *(n * c for c in square[k]), *(n * c for c in square[(k + 1) % 4]))
    rows = [side(base + m, h, k, m + h + 1) for m in range(40) for h in range(3) for k in range(4)] + [side(None, 0, k, 1) for k in range(4)] + [(base, 9, 1.0, 1.0, 1.0, 1.0)]
    cuts = spark.createDataFrame(rows, "volume long, height_idx int, x0 double, y0 double, x1 double, y1 double").repartition(5)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rings = meshes.section_rings(cuts, "volume")
        got = {(r.volume, r.height_idx): (r.ring, r.n_points, r.area, r.perimeter) for r in rings.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = {(base + m, h): (0, 4, 4.0 * (m + h + 1) ** 2, 8.0 * (m + h + 1)) for m in range(40) for h in range(3)} | {(None, 0): (0, 4, 4.0, 8.0)}
    assert got == want and rings.count() == len(want)
    assert "FlatMapGroupsInPandas" not in rings._jdf.queryExecution().toString()


def test_contours_leave_a_task_in_slices(spark):
    """A batch of many masks never stands as Python's points all at once."""
    from types import SimpleNamespace
    from unittest.mock import MagicMock

    import pandas as pd

    held = MagicMock()
    held.schema = [SimpleNamespace(name="image", dataType=SimpleNamespace(simpleString=lambda: "int"))]
    segment.contours(held)
    run = held.mapInPandas.call_args.args[0]
    mask = np.zeros((8, 8), np.uint8)
    mask[1:6, 2:7] = 255
    found = list(run(iter([pd.DataFrame({"image": range(600), "height": 8, "width": 8, "mask": [mask.tobytes()] * 600})])))
    assert [len(f) for f in found] == [256, 256, 88] and pd.concat(found)["image"].tolist() == list(range(600))


def test_triangle_distance_of_all_points_and_triangles():
    rng = np.random.default_rng(2)
    p, q = rng.normal(size=(5, 3)), rng.normal(size=(4, 9)).round(1)
    q[1] = np.tile(q[1, :3], 3)  # a triangle that is one point
    got = compare.triangle_distance(p[:, None], q[:, :3], q[:, 3:6], q[:, 6:])
    want = [[compare.triangle_distance(x[None], y[None, :3], y[None, 3:6], y[None, 6:])[0] for y in q] for x in p]
    assert got.shape == (5, 4) and (got == np.array(want)).all()
