"""Boards rendered through a known camera give the camera back."""

import math

import numpy as np
import pytest

from plyforge.operators import calibrate, chessboard

ACROSS, DOWN, SQUARE = 7, 5, 20.0
THETA = np.array([620.0, 600.0, 322.0, 235.0, -0.12, 0.05, 0.001, -0.002, 0.0])
POSES = [(0.25, -0.2, 0.05, -70, -50, 330), (-0.35, 0.1, -0.1, -60, -45, 310), (0.1, 0.4, 0.2, -45, -60, 340), (-0.15, -0.4, 0.1, -75, -40, 320), (0.4, 0.25, -0.2, -70, -30, 350), (0.02, 0.03, 0.5, -20, -70, 300)]


def rendered(pose, height=480, width=640, sharp=3):
    """Pixels looked up on the board's plane, by several rays each; the lens is undone by fixed-point steps."""
    fx, fy, cx, cy, k1, k2, p1, p2, k3 = THETA
    n = sharp
    v, u = ((np.mgrid[: height * n, : width * n] + 0.5) / n) - 0.5
    xd, yd = (u - cx) / fx, (v - cy) / fy
    x, y = xd.copy(), yd.copy()
    for _ in range(12):
        r = x * x + y * y
        radial = 1 + r * (k1 + r * (k2 + r * k3))
        x, y = (xd - 2 * p1 * x * y - p2 * (r + 2 * x * x)) / radial, (yd - p1 * (r + 2 * y * y) - 2 * p2 * x * y) / radial
    m = chessboard.rotation(np.array(pose[:3], float))
    h = np.linalg.inv(np.column_stack([m[:, 0], m[:, 1], pose[3:]]))
    p = np.stack([x, y, np.ones_like(x)], axis=-1) @ h.T
    a, b = p[..., 0] / p[..., 2] / SQUARE, p[..., 1] / p[..., 2] / SQUARE
    inside = (a >= -1) & (a < ACROSS) & (b >= -1) & (b < DOWN)
    dark = inside & ((np.floor(a) + np.floor(b)) % 2 == 0)
    grey = np.where(dark, 30.0, 220.0).reshape(height, n, width, n).mean(axis=(1, 3))
    return np.rint(grey).astype(np.uint8)


@pytest.fixture(scope="module")
def boards():
    return [rendered(p) for p in POSES]


def test_corners_lie_where_the_camera_puts_them(boards):
    plane = chessboard.board(ACROSS, DOWN, SQUARE)
    for image, pose in zip(boards, POSES, strict=True):
        got, want = chessboard.find_corners(image, ACROSS, DOWN), chessboard.project(THETA, np.array(pose, float), plane)
        gap = min(np.abs(got - w).max() for w in (want, want[::-1]))
        assert gap < 0.35
    assert chessboard.find_corners(np.full((100, 100), 9, np.uint8), ACROSS, DOWN) is None
    assert chessboard.find_corners(boards[0][:, :300], ACROSS, DOWN) is None and chessboard.find_corners(boards[0], ACROSS + 1, DOWN) is None
    noise = np.random.default_rng(0).integers(0, 256, (120, 120)).astype(np.uint8)
    assert chessboard.find_corners(noise, ACROSS, DOWN) is None and chessboard.find_corners(np.zeros((3, 3), np.uint8), ACROSS, DOWN) is None


def test_rendered_boards_give_the_camera_back(spark, boards):
    row = lambda i, a: (f"p{i}", ("", a.shape[0], a.shape[1], 1, 0, a.tobytes()))
    schema = "path string, image struct<origin: string, height: int, width: int, nChannels: int, mode: int, data: binary>"
    df = spark.createDataFrame([row(i, a) for i, a in enumerate(boards)] + [row(99, np.zeros((50, 60), np.uint8))], schema).repartition(3)
    found = chessboard.corners(df, ACROSS, DOWN).cache()
    assert found.select("path").distinct().count() == len(boards)
    camera = chessboard.calibrate(found, ACROSS, DOWN, SQUARE)
    (fx, _, cx), (_, fy, cy), _ = camera.camera_matrix
    assert camera.n_images == len(boards) and camera.rms < 0.3 and camera.poses.count() == len(boards)
    assert abs(fx / 620 - 1) < 0.01 and abs(fy / 600 - 1) < 0.01 and abs(cx - 322) < 6 and abs(cy - 235) < 6
    scale = calibrate.corner_scale(found, ACROSS, SQUARE, "path").first()[0]
    assert 0.3 < scale < 0.8
    with pytest.raises(ValueError, match="three are needed"):
        chessboard.calibrate(found.filter("path in ('p0', 'p1')"), ACROSS, DOWN, SQUARE)


def seen_through(spark, poses, theta=THETA):
    plane = chessboard.board(ACROSS, DOWN, SQUARE)
    rows = [(i, k, float(x), float(y)) for i, p in enumerate(poses) for k, (x, y) in enumerate(chessboard.project(theta, np.array(p, float), plane))]
    return spark.createDataFrame(rows, "path long, idx int, x double, y double").repartition(4)


def test_exact_corners_give_camera_and_lens_exactly(spark):
    found = seen_through(spark, POSES)
    odd = spark.createDataFrame([(77, 0, 1.0, 1.0), (None, 0, 1.0, 1.0), (78, 0, math.nan, 1.0)], found.schema)
    camera = chessboard.calibrate(found.union(odd), ACROSS, DOWN, SQUARE)
    got = [camera.camera_matrix[0][0], camera.camera_matrix[1][1], camera.camera_matrix[0][2], camera.camera_matrix[1][2], *camera.dist_coeffs]
    assert camera.n_images == 6 and camera.rms < 1e-5 and np.allclose(got[:4], THETA[:4], atol=1e-2) and np.allclose(got[4:8], THETA[4:8], atol=1e-3)


def test_parallel_boards_leave_the_camera_open(spark):
    with pytest.raises(ValueError, match="open"):
        chessboard.calibrate(seen_through(spark, [(0, 0, 0, x, -40, 300) for x in (-70, -60, -50)], np.array([*THETA[:4], 0, 0, 0, 0, 0])), ACROSS, DOWN, SQUARE)


def test_rotation_vectors():
    for r in ([0, 0, 0], [0.3, -0.2, 0.9], [math.pi, 0, 0], [0, -math.pi * 0.9999999, 0], [2.0, 2.0, 0.1]):
        m = chessboard.rotation(np.array(r, float))
        assert np.allclose(chessboard.rotation(chessboard.turn_of(m)), m, atol=1e-6)


def test_images_are_solved_together():
    """Arrays of poses give what each pose gives, whatever the number of images; odd turns included."""
    rng = np.random.default_rng(5)
    poses = np.concatenate([rng.uniform(-0.5, 0.5, (40, 3)), rng.uniform(-20, 20, (40, 2)), rng.uniform(250, 400, (40, 1))], axis=1)
    poses[0, :3] = 0
    plane = chessboard.board(ACROSS, DOWN, 20.0)
    theta = np.array([620.0, 600.0, 322.0, 235.0, -0.12, 0.05, 0.01, -0.01, 0.0])
    seen = chessboard.project(theta, poses, plane)
    assert seen.shape == (40, ACROSS * DOWN, 2) and all(np.allclose(s, chessboard.project(theta, p, plane)) for s, p in zip(seen, poses, strict=True))
    m = chessboard.rotation(np.concatenate([poses[:, :3], [[0, 0, np.pi], [np.pi, 0, 0]]]))
    assert all(np.allclose(chessboard.rotation(t), chessboard.rotation(chessboard.turn_of(x)), atol=1e-6) for t, x in zip(chessboard.turns_of(m), m, strict=True))
    h = chessboard.homography(plane, chessboard.project(np.array([620.0, 600.0, 322.0, 235.0, 0, 0, 0, 0, 0]), poses, plane))
    assert h.shape == (40, 3, 3) and chessboard.constraints(h).shape == (40, 2, 6)
    at = poses + rng.normal(0, 0.01, poses.shape)
    both = chessboard.reduced(theta, at, plane, seen, 1e-3)
    for k in (0, 1, 39):
        assert all(np.allclose(x[k], y[0], rtol=1e-6, atol=1e-6) for x, y in zip(both, chessboard.reduced(theta, at[k : k + 1], plane, seen[k : k + 1], 1e-3), strict=True))
    moved = at - both[3]  # the camera is right already, so a step of the poses alone nears them
    assert chessboard.reduced(theta, moved, plane, seen, 1e-3)[2].sum() < 0.01 * both[2].sum()
