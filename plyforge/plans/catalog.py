"""The registered queries over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from plyforge.functions import geometry, names
from plyforge.operators import calibrate, chessboard, compare, layers, meshes, pixels, register, score, segment, toolpath
from plyforge.operators.tables import written

from . import views
from .views import COMMANDS, GREY, LAYERS, PIXELS, POINTS, POSITIONS, TOOL_LAYERS, VOXELS, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---- layers and anomalies

LAGGED = f"""{LAYERS}, lagged AS (SELECT *, z - lag(z) OVER w AS gap, CASE WHEN n_points >= 3 AND lag(n_points) OVER w >= 3
        THEN sqrt((cx - lag(cx) OVER w) * (cx - lag(cx) OVER w) + (cy - lag(cy) OVER w) * (cy - lag(cy) OVER w)) END AS shift,
        CASE WHEN perimeter >= 1e-6 AND lag(perimeter) OVER w >= 1e-6 THEN abs(perimeter - lag(perimeter) OVER w) / lag(perimeter) OVER w END AS dp,
        CASE WHEN area >= 1e-6 AND lag(area) OVER w >= 1e-6 THEN abs(area - lag(area) OVER w) / lag(area) OVER w END AS da
        FROM layers WINDOW w AS (PARTITION BY build_id ORDER BY layer_idx)),
    counted AS (SELECT *, greatest(0, CAST(round_even(gap / CAST(0.2 AS DOUBLE), 0) AS INTEGER) - 1) AS missing FROM lagged),
    anomalies AS (
        SELECT build_id, layer_idx, 1 AS detector_rank, 'missing_layer' AS anomaly_type, CASE WHEN missing >= 3 THEN 'critical' WHEN missing >= 1 THEN 'warning' ELSE 'info' END AS severity, round(gap, 4) AS measured_value, round(CAST(0.2 AS DOUBLE) * 1.5, 4) AS threshold FROM counted WHERE gap > CAST(0.2 AS DOUBLE) * CAST(1.5 AS DOUBLE)
        UNION ALL SELECT build_id, layer_idx, 2, 'layer_shift', CASE WHEN shift / 0.5 > 3 THEN 'critical' WHEN shift / 0.5 > 1.5 THEN 'warning' ELSE 'info' END, round(shift, 4), 0.5 FROM counted WHERE shift > 0.5
        UNION ALL SELECT build_id, layer_idx, 3, 'width_variation', CASE WHEN dp / CAST(0.2 AS DOUBLE) > 3 THEN 'critical' WHEN dp / CAST(0.2 AS DOUBLE) > 2 THEN 'warning' ELSE 'info' END, round(dp, 4), 0.2 FROM counted WHERE dp > CAST(0.2 AS DOUBLE)
        UNION ALL SELECT build_id, layer_idx, 4, 'width_variation', CASE WHEN da / CAST(0.2 AS DOUBLE) > 3 THEN 'critical' WHEN da / CAST(0.2 AS DOUBLE) > 2 THEN 'warning' ELSE 'info' END, round(da, 4), 0.2 FROM counted WHERE da > CAST(0.2 AS DOUBLE))"""


@query(f"WITH {LAGGED} SELECT build_id, layer_idx, detector_rank, anomaly_type, severity, measured_value, CAST(threshold AS DOUBLE) AS threshold FROM anomalies")
def layer_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.anomalies(views.layers(spark, sf_dir)).drop("description")


@query(f"WITH {LAGGED} SELECT anomaly_type, severity, count(*) AS n FROM anomalies GROUP BY GROUPING SETS ((anomaly_type), (severity), ())")
def anomaly_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.anomaly_summary(layers.anomalies(views.layers(spark, sf_dir)))


OCCLUDED = f"""{LAYERS}, before AS (SELECT *, lag(area) OVER (PARTITION BY build_id ORDER BY layer_idx) AS p FROM layers),
    occluded AS (SELECT build_id, layer_idx, area, greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), CASE WHEN p > 0 AND area / p < CAST(0.7 AS DOUBLE) THEN CAST(1 AS DOUBLE) - CAST(2 AS DOUBLE) * ((CAST(1 AS DOUBLE) - area / p) - CAST(0.3 AS DOUBLE)) ELSE CAST(1 AS DOUBLE) END)) AS confidence FROM before)"""


@query(f"WITH {OCCLUDED} SELECT build_id, layer_idx, round(confidence, 6) AS confidence, confidence < CAST(0.7 AS DOUBLE) AS flagged FROM occluded")
def occlusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.occlusion(views.layers(spark, sf_dir)).select("build_id", "layer_idx", F.round("confidence", 6).alias("confidence"), "flagged")


@query(f"WITH {OCCLUDED} SELECT build_id, count(*) AS n_layers, count(*) FILTER (WHERE confidence < CAST(0.7 AS DOUBLE)) AS n_flagged, coalesce(string_agg(CAST(layer_idx AS VARCHAR), ',' ORDER BY layer_idx) FILTER (WHERE confidence < CAST(0.7 AS DOUBLE)), '') AS flagged_layers FROM occluded GROUP BY build_id")
def occlusion_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = layers.occlusion_report(layers.occlusion(views.layers(spark, sf_dir)))
    return report.withColumn("flagged_layers", F.array_join("flagged_layers", ","))


@query(f"WITH {LAYERS}, span AS (SELECT build_id, min(layer_idx) AS a, max(layer_idx) AS b FROM layers GROUP BY 1), every AS (SELECT build_id, CAST(unnest(range(a, b + 1)) AS BIGINT) AS layer_idx FROM span) SELECT e.build_id, e.layer_idx FROM every e LEFT JOIN layers l ON l.build_id = e.build_id AND l.layer_idx = e.layer_idx WHERE l.build_id IS NULL")
def missing_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.missing_layers(views.layers(spark, sf_dir), number="layer_idx")


@query(f"WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {', '.join(views.ORDER[2:])}) AS n FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM r WHERE n = 1")
def dedupe_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = layers.dedupe(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], views.ORDER[2:])
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


NAME_SQL = "CASE p_partkey % 9 WHEN 0 THEN '/a/layer_' || k || '.PNG' WHEN 1 THEN '/a/Img-' || k || '_v2.jpg' WHEN 2 THEN '/a/capa' || k || '.tif' WHEN 3 THEN '/a/slice_' || k || '.bmp' WHEN 4 THEN '/a/' || k || '.jpeg' WHEN 5 THEN '/a/' || p_brand || '_' || k || '.tiff' WHEN 6 THEN '/a/none.png' WHEN 7 THEN '/a/layer_' || k || '.txt' ELSE '/a/scan' || k || 'b.png' END"
NAMED = f"files AS (SELECT build_id, {NAME_SQL} AS path FROM (SELECT *, p_partkey % 50 AS build_id, CAST(p_size AS VARCHAR) AS k FROM part)), stems AS (SELECT *, regexp_replace(path, '^.*/|\\.[^./]*$', '', 'g') AS s FROM files WHERE regexp_matches(lower(path), '\\.(png|jpg|jpeg|tiff|tif|bmp)$')), numbered AS (SELECT build_id, path, TRY_CAST(coalesce(nullif(regexp_extract(s, '(?i)layer[_-]?(\\d+)', 1), ''), nullif(regexp_extract(s, '(?i)img[_-]?(\\d+)', 1), ''), nullif(regexp_extract(s, '(?i)capa[_-]?(\\d+)', 1), ''), nullif(regexp_extract(s, '(?i)slice[_-]?(\\d+)', 1), ''), nullif(regexp_extract(s, '^(\\d+)$', 1), ''), nullif(regexp_extract(s, '(\\d+)$', 1), '')) AS INTEGER) AS layer_number FROM stems)"


def part_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").withColumns({"build_id": F.col("p_partkey") % 50, "k": F.col("p_size").cast("string")})
    return part.select("build_id", F.expr(NAME_SQL).alias("path"))


@query(f"WITH {NAMED} SELECT build_id, path, layer_number FROM numbered WHERE layer_number IS NOT NULL")
def layer_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = part_files(spark, sf_dir).filter(names.is_image(F.col("path"))).withColumn("layer_number", names.layer_number(F.col("path")))
    return rows.filter("layer_number is not null")


IMAGES = f"{NAMED}, images AS (SELECT build_id, layer_number, min(path) AS path, layer_number * CAST(0.2 AS DOUBLE) AS z_height FROM numbered WHERE layer_number IS NOT NULL GROUP BY 1, 2)"


@query(f"WITH {IMAGES} SELECT build_id, layer_number, path, round(z_height, 6) AS z_height FROM images")
def layer_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.layer_images(part_files(spark, sf_dir)).withColumn("z_height", F.round("z_height", 6))


@query(f"WITH {IMAGES}, t AS (SELECT l_suppkey % 50 AS build_id, CAST(max(l_quantity) AS DOUBLE) AS total FROM lineitem GROUP BY 1), r AS (SELECT images.*, total, count(*) OVER (PARTITION BY images.build_id) AS n, row_number() OVER (PARTITION BY images.build_id ORDER BY layer_number) - 1 AS place FROM images LEFT JOIN t USING (build_id)) SELECT build_id, layer_number, round(CASE WHEN total > 0 AND n > 1 AND abs(total / greatest(n - 1, 1) - CAST(0.2 AS DOUBLE)) > 0.001 THEN place * (total / greatest(n - 1, 1)) ELSE z_height END, 6) AS z_height FROM r")
def respaced_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 50).alias("build_id")).agg(F.max("l_quantity").alias("total_height"))
    rows = layers.respace(layers.layer_images(part_files(spark, sf_dir)), totals, 0.2)
    return rows.select("build_id", "layer_number", F.round("z_height", 6).alias("z_height"))


PLANNED = "planned AS (SELECT user_id AS build_id, CAST(day(ts) - 1 AS INTEGER) AS layer_idx, round(avg(value) / 100, 6) AS z FROM events GROUP BY user_id, day(ts))"


def planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("user_id").alias("build_id"), (F.dayofmonth("ts") - 1).alias("layer_idx")).agg(F.round(F.avg("value") / 100, 6).alias("z"))


@query(f"WITH {LAYERS}, {PLANNED} SELECT l.build_id, l.layer_idx, round(l.z - p.z, 6) AS error FROM layers l JOIN planned p ON p.build_id = l.build_id AND p.layer_idx = l.layer_idx")
def height_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.height_errors(planned(spark, sf_dir), views.layers(spark, sf_dir))


@query(f"WITH {LAYERS}, o AS (SELECT DISTINCT user_id AS build_id, CAST(user_id % 7 + 3 AS INTEGER) AS kernel, user_id % 2 = 0 AS invert FROM events) SELECT l.build_id, l.layer_idx, coalesce(kernel, 5) AS kernel, coalesce(invert, false) AS invert FROM layers l LEFT JOIN o USING (build_id)")
def override_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "events").select(F.col("user_id").alias("build_id"), (F.col("user_id") % 7 + 3).cast("int").alias("kernel"), (F.col("user_id") % 2 == 0).alias("invert")).distinct()
    rows = views.layers(spark, sf_dir).select("build_id", "layer_idx")
    return layers.with_overrides(rows, o, ["build_id"], {"kernel": 5, "invert": False})


# ---- toolpaths


@query(f"WITH {COMMANDS} SELECT file, line_no, text, mode, is_move, x, y, z, e, f FROM commands")
def gcode_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toolpath.commands(views.programs(spark, sf_dir))


@query(f"WITH {POSITIONS} SELECT file, line_no, round(pos_x, 4) AS pos_x, round(pos_y, 4) AS pos_y, round(pos_z, 4) AS pos_z, z_gate FROM gated")
def gcode_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toolpath.parse(views.programs(spark, sf_dir)).select("file", "line_no", *[F.round(f"pos_{a}", 4).alias(f"pos_{a}") for a in "xyz"], "z_gate")


@query(f"WITH {TOOL_LAYERS} SELECT file, layer_idx, z, height FROM tool_layers")
def gcode_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toolpath.layers(toolpath.parse(views.programs(spark, sf_dir)))


@query(f"WITH {TOOL_LAYERS} SELECT file, count(*) AS layer_count, round(max(z), 4) AS total_height, min(height) AS min_height, max(height) AS max_height FROM tool_layers GROUP BY file")
def gcode_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toolpath.summary(toolpath.layers(toolpath.parse(views.programs(spark, sf_dir))))


@query(f"WITH {POSITIONS}, s AS (SELECT *, sum(CAST(z_gate AS INTEGER)) OVER (PARTITION BY file ORDER BY line_no) AS seg FROM gated), p AS (SELECT *, lag(pos_x) OVER w AS px, lag(pos_y) OVER w AS py FROM s WHERE is_move AND (x IS NOT NULL OR y IS NOT NULL) WINDOW w AS (PARTITION BY file, seg ORDER BY line_no)) SELECT file, CAST(seg AS BIGINT) AS segment, CAST(count(*) AS INTEGER) AS n_points, round(coalesce(sum(sqrt((pos_x - px) * (pos_x - px) + (pos_y - py) * (pos_y - py))), 0), 4) AS length FROM p GROUP BY file, seg HAVING count(*) >= 2")
def gcode_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = toolpath.segments(toolpath.parse(views.programs(spark, sf_dir)))
    return s.select("file", "segment", "n_points", F.round(geometry.polyline_length(F.col("points")), 4).alias("length"))


# ---- distances and scores


@query("SELECT event_type, round(avg(d), 6) AS mean, round(max(d), 6) AS max, round(stddev_pop(d), 6) AS std, round(median(d), 6) AS median, round(quantile_cont(d, 0.95), 6) AS p95, round(quantile_cont(d, 0.99), 6) AS p99 FROM (SELECT event_type, abs(value) AS d FROM events) GROUP BY event_type")
def distance_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.distance_stats(table(spark, sf_dir, "events").withColumn("d", F.abs("value")), "d", "event_type")


@query("SELECT round(avg(d), 6) AS mean, round(max(d), 6) AS max, round(stddev_pop(d), 6) AS std, round(median(d), 6) AS median, round(quantile_cont(d, 0.95), 6) AS p95, round(quantile_cont(d, 0.99), 6) AS p99 FROM (SELECT abs(l_extendedprice - 20 * l_quantity) AS d FROM lineitem)")
def distance_stats_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of one list of distances, percentiles by selection."""
    rows = table(spark, sf_dir, "lineitem").select(F.abs(F.col("l_extendedprice") - 20 * F.col("l_quantity")).alias("d"))
    return compare.distance_stats(rows, "d", most=2000)


@query("SELECT l_returnflag, round(avg(CASE WHEN l_discount <= CAST(0.05 AS DOUBLE) THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) * 100, 2) AS within_tolerance_pct FROM lineitem GROUP BY l_returnflag")
def tolerance_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.within_tolerance(table(spark, sf_dir, "lineitem"), "l_discount", 0.05, "l_returnflag")


@query(f"WITH {POINTS}, a AS (SELECT p.vec_id, q.vec_id AS o, p.k AS i, q.k AS j, (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) AS d FROM points p JOIN points q ON q.vec_id = p.vec_id + 1), f AS (SELECT vec_id, max(m) AS h FROM (SELECT vec_id, i, min(d) AS m FROM a GROUP BY 1, 2) GROUP BY 1), g AS (SELECT vec_id, max(m) AS h FROM (SELECT vec_id, j, min(d) AS m FROM a GROUP BY 1, 2) GROUP BY 1) SELECT f.vec_id, round(sqrt(greatest(f.h, g.h)), 6) AS hausdorff FROM f JOIN g USING (vec_id)")
def hausdorff(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.polygons(spark, sf_dir)
    return compare.hausdorff(p, p.withColumn("vec_id", F.col("vec_id") - 1), ["vec_id"])


@query(f"""WITH {POINTS}, p AS MATERIALIZED (SELECT vec_id * 32 + k AS vid, x, y FROM points WHERE vec_id % 2 = 1), t AS MATERIALIZED (SELECT vec_id * 32 + k AS tid, x, y FROM points WHERE vec_id % 2 = 0),
    m AS (SELECT vid, any_value(p.x) AS x, any_value(p.y) AS y, min(sqrt((p.x - t.x) * (p.x - t.x) + (p.y - t.y) * (p.y - t.y))) AS d FROM p CROSS JOIN t GROUP BY vid)
    SELECT vid, min(tid) AS target_id, round(any_value(d), 6) AS distance FROM m CROSS JOIN t WHERE sqrt((m.x - t.x) * (m.x - t.x) + (m.y - t.y) * (m.y - t.y)) = d GROUP BY vid""")
def nearest_neighbor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each corner of the odd polygons, the nearest corner of the even ones."""
    p = views.polygons(spark, sf_dir).select("vec_id", F.posexplode("points").alias("k", "p"))
    p = p.select("vec_id", (F.col("vec_id") * 32 + F.col("k")).alias("vid"), F.col("p.x").alias("x"), F.col("p.y").alias("y"))
    found = compare.nearest(p.filter("vec_id % 2 = 1"), p.filter("vec_id % 2 = 0").withColumnRenamed("vid", "target_id"), ["x", "y"], "vid", "target_id")
    return found.withColumn("distance", F.round("distance", 6))


@query(f"""WITH {POINTS}, {VOXELS}, i AS (SELECT * FROM voxels WHERE inside), e AS (SELECT volume, 0 AS axis, unnest([x - CAST(0.5 AS DOUBLE), x + CAST(0.5 AS DOUBLE)]) AS x, CAST(y AS DOUBLE) AS y, CAST(z AS DOUBLE) AS z FROM i
    UNION ALL SELECT volume, 1, x, unnest([y - CAST(0.5 AS DOUBLE), y + CAST(0.5 AS DOUBLE)]), z FROM i UNION ALL SELECT volume, 2, x, y, unnest([z - CAST(0.5 AS DOUBLE), z + CAST(0.5 AS DOUBLE)]) FROM i),
    s AS (SELECT volume, axis, x, y, z FROM e GROUP BY ALL HAVING count(*) = 1), p AS (SELECT vec_id * 32 + k AS vid, vec_id, x * 6 + CAST(1.5 AS DOUBLE) AS x, y * 6 + CAST(1.5 AS DOUBLE) AS y, k / CAST(8 AS DOUBLE) AS z FROM points),
    d AS (SELECT vid, greatest(abs(p.x - s.x) - CASE axis WHEN 0 THEN 0 ELSE CAST(0.5 AS DOUBLE) END, 0) AS dx, greatest(abs(p.y - s.y) - CASE axis WHEN 1 THEN 0 ELSE CAST(0.5 AS DOUBLE) END, 0) AS dy, greatest(abs(p.z - s.z) - CASE axis WHEN 2 THEN 0 ELSE CAST(0.5 AS DOUBLE) END, 0) AS dz FROM p JOIN s ON s.volume = p.vec_id)
    SELECT vid, round(min(sqrt(dx * dx + dy * dy + dz * dz)), 6) AS distance FROM d GROUP BY vid""")
def surface_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cloud for each polygon and a surface for each volume, both far apart along x, so that a point's own surface is nearest."""
    apart = F.col("vec_id") * 1000
    points = views.polygons(spark, sf_dir).select("vec_id", F.posexplode("points").alias("k", "p"))
    points = points.select((F.col("vec_id") * 32 + F.col("k")).alias("vid"), (F.col("p.x") * 6 + 1.5 + apart).alias("x"), (F.col("p.y") * 6 + 1.5).alias("y"), (F.col("k") / 8).alias("z"))
    tris = meshes.voxel_faces(views.voxels(spark, sf_dir)).withColumns({f"{v}x": F.col(f"{v}x") + F.col("volume") * 1000 for v in "abc"})
    return compare.surface_distance(points, tris).withColumn("distance", F.round("distance", 6))


@query(f"WITH {POINTS}, n AS (SELECT k, x, y, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM points WINDOW w AS (PARTITION BY vec_id ORDER BY k)) SELECT round(2.5 / avg(sqrt((nx - x) ** 2 + (ny - y) ** 2)), 9) AS scale_mm_per_px FROM n WHERE nx IS NOT NULL AND (k + 1) % 8 <> 0")
def corner_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.polygons(spark, sf_dir).select(F.col("vec_id").alias("image"), F.posexplode("points").alias("idx", "p"))
    found = calibrate.corner_scale(p.select("image", "idx", "p.x", "p.y"), 8, 2.5)
    return found.withColumn("scale_mm_per_px", F.round("scale_mm_per_px", 9))


@query("SELECT count(*) AS n_images, CAST(620 AS DOUBLE) AS fx, CAST(600 AS DOUBLE) AS fy, CAST(322 AS DOUBLE) AS cx, CAST(235 AS DOUBLE) AS cy, CAST(-0.12 AS DOUBLE) AS k1, CAST(0.05 AS DOUBLE) AS k2 FROM embeddings")
def camera_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding poses a chessboard before one camera; the corners that it sees give the camera back."""
    found = chessboard.calibrate(views.board_corners(spark, sf_dir), 7, 5, 20.0, "vec_id")
    (fx, _, cx), (_, fy, cy), _ = found.camera_matrix
    row = (found.n_images, *(round(v, 1) for v in (fx, fy, cx, cy)), *(round(v, 3) for v in found.dist_coeffs[:2]))
    return spark.createDataFrame([row], "n_images long, fx double, fy double, cx double, cy double, k1 double, k2 double")


LENS = "{c} * (CAST(1 AS DOUBLE) + r * (CAST(0.2 AS DOUBLE) + r * CAST(-0.05 AS DOUBLE)))"


@query(f"""WITH {PIXELS}, n AS (SELECT *, (x - CAST(3.5 AS DOUBLE)) / 8 AS a, (y - CAST(3.5 AS DOUBLE)) / 8 AS b FROM pixels), l AS (SELECT *, a * a + b * b AS r FROM n),
    d AS (SELECT image, y, x, ({LENS.format(c='a')} + CAST(0.02 AS DOUBLE) * a * b + CAST(-0.03 AS DOUBLE) * (r + 2 * a * a)) * 8 + CAST(3.5 AS DOUBLE) AS px, ({LENS.format(c='b')} + CAST(0.01 AS DOUBLE) * (r + 2 * b * b) + CAST(-0.06 AS DOUBLE) * a * b) * 8 + CAST(3.5 AS DOUBLE) AS py FROM l),
    c AS (SELECT d.*, i, j, CAST(floor(px) AS INTEGER) + i AS sx, CAST(floor(py) AS INTEGER) + j AS sy, (CASE i WHEN 1 THEN px - floor(px) ELSE 1 - (px - floor(px)) END) * (CASE j WHEN 1 THEN py - floor(py) ELSE 1 - (py - floor(py)) END) AS w FROM d CROSS JOIN (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS o(i, j))
    SELECT c.image, c.y, c.x, round(sum(w * coalesce(v, 0)), 4) AS v FROM c LEFT JOIN pixels p ON p.image = c.image AND p.x = sx AND p.y = sy GROUP BY 1, 2, 3""")
def undistort(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = calibrate.undistort(views.pixels(spark, sf_dir), [[8.0, 0.0, 3.5], [0.0, 8.0, 3.5], [0.0, 0.0, 1.0]], [0.2, -0.05, 0.01, -0.03])
    return out.withColumn("v", F.round("v", 4) + 0.0)


@query(f"WITH {LAYERS}, {PLANNED}, e AS (SELECT l.build_id, abs(round(l.z - p.z, 6)) AS e FROM layers l JOIN planned p ON p.build_id = l.build_id AND p.layer_idx = l.layer_idx) SELECT build_id, count(*) AS n, round(avg(e), 6) AS mean_abs, round(max(e), 6) AS max_abs FROM e GROUP BY build_id")
def height_error_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = layers.error_stats(layers.height_errors(planned(spark, sf_dir), views.layers(spark, sf_dir)))
    return stats.select("build_id", "n", F.round("mean_abs", 6).alias("mean_abs"), F.round("max_abs", 6).alias("max_abs"))


@query(f"WITH {LAGGED}, {PLANNED}, e AS (SELECT l.build_id, avg(CASE WHEN abs(round(l.z - p.z, 6)) <= CAST(0.2 AS DOUBLE) THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) * 100 AS layer FROM layers l JOIN planned p ON p.build_id = l.build_id AND p.layer_idx = l.layer_idx GROUP BY 1), a AS (SELECT build_id, greatest(CAST(0 AS DOUBLE), 100 - sum(CASE severity WHEN 'critical' THEN 15 WHEN 'warning' THEN 5 WHEN 'info' THEN 1 ELSE 0 END)) AS anomaly FROM anomalies GROUP BY 1), d AS (SELECT user_id AS build_id, round(avg(CASE WHEN value <= 30 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) * 100, 2) AS dimensional FROM events GROUP BY 1), n AS (SELECT build_id, count(*) AS n FROM layers GROUP BY 1), s AS (SELECT n.build_id, coalesce(dimensional, 100) * CAST(0.35 AS DOUBLE) + coalesce(layer, 100) * CAST(0.25 AS DOUBLE) + coalesce(anomaly, 100) * CAST(0.25 AS DOUBLE) + least(CAST(100 AS DOUBLE), n / CAST(30 AS DOUBLE) * 100) * CAST(0.15 AS DOUBLE) AS score FROM n LEFT JOIN e USING (build_id) LEFT JOIN a USING (build_id) LEFT JOIN d USING (build_id)) SELECT build_id, round(score, 4) AS score, CASE WHEN score >= 85 THEN 'A' WHEN score >= 70 THEN 'B' WHEN score >= 50 THEN 'C' WHEN score >= 30 THEN 'D' ELSE 'F' END AS grade FROM s")
def quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = views.layers(spark, sf_dir)
    parts = built.groupBy("build_id").agg(F.count("*").alias("n_processed")).withColumn("n_expected", F.lit(30))
    for other in (
        compare.within_tolerance(table(spark, sf_dir, "events").withColumnRenamed("user_id", "build_id"), "value", 30, "build_id").withColumnRenamed("within_tolerance_pct", "dimensional"),
        score.layer_accuracy(layers.height_errors(planned(spark, sf_dir), built), 0.2, "build_id"),
        score.anomaly_score(layers.anomalies(built), "build_id"),
    ):
        parts = parts.join(other, "build_id", "left")
    parts = parts.fillna(100.0, ["dimensional", "layer", "anomaly"])
    return score.quality(parts).select("build_id", F.round("score", 4).alias("score"), "grade")


# ---- polygons and registration


@query(f"WITH {POINTS}, n AS (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny, first_value(x) OVER w AS fx, first_value(y) OVER w AS fy FROM points WINDOW w AS (PARTITION BY vec_id ORDER BY k)), s AS (SELECT vec_id, abs(sum(x * coalesce(ny, fy) - coalesce(nx, fx) * y)) * 0.5 AS area, sum(CASE WHEN nx IS NOT NULL THEN sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y)) ELSE 0 END) AS length, sum(sqrt((coalesce(nx, fx) - x) * (coalesce(nx, fx) - x) + (coalesce(ny, fy) - y) * (coalesce(ny, fy) - y))) AS per, avg(x) AS cx, avg(y) AS cy FROM n GROUP BY vec_id) SELECT vec_id, round(area, 6) AS area, round(length, 6) AS length, round(per, 6) AS perimeter, round(cx, 6) AS cx, round(cy, 6) AS cy, round(least(1, greatest(0, 4 * pi() * area / (per * per))), 6) AS circularity FROM s")
def polygon_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("points")
    rows = views.polygons(spark, sf_dir).select("vec_id", geometry.shoelace_area(p).alias("area"), geometry.polyline_length(p).alias("length"), geometry.perimeter(p).alias("perimeter"), geometry.vertex_mean(p).alias("c"), F.size(p).alias("n"))
    rows = rows.withColumn("circularity", geometry.circularity(F.col("area"), F.col("perimeter"), F.col("n")))
    return rows.select("vec_id", *[F.round(c, 6).alias(n) for n, c in (("area", "area"), ("length", "length"), ("perimeter", "perimeter"), ("cx", "c.x"), ("cy", "c.y"), ("circularity", "circularity"))])


PAIRS = f"{POINTS}, pairs AS (SELECT p.vec_id, p.x AS sx, p.y AS sy, q.x AS tx, q.y AS ty FROM points p JOIN points q ON q.vec_id = p.vec_id + 1 AND q.k = p.k)"


def polygon_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.polygons(spark, sf_dir)
    both = p.join(p.select((F.col("vec_id") - 1).alias("vec_id"), F.col("points").alias("other")), "vec_id")
    rows = both.select("vec_id", F.explode(F.arrays_zip("points", "other")).alias("z"))
    return rows.select("vec_id", *[F.col(f"z.{f}.{a}").alias(f"{n}{a}") for n, f in (("s", "points"), ("t", "other")) for a in "xy"])


@query(f"WITH {PAIRS}, c AS (SELECT vec_id, avg(sx) AS ax, avg(sy) AS ay, avg(tx) AS bx, avg(ty) AS by_ FROM pairs GROUP BY 1), k AS (SELECT vec_id, atan2(sum((sx - ax) * (ty - by_) - (sy - ay) * (tx - bx)), sum((sx - ax) * (tx - bx) + (sy - ay) * (ty - by_))) AS angle, any_value(ax) AS ax, any_value(ay) AS ay, any_value(bx) AS bx, any_value(by_) AS by_ FROM pairs JOIN c USING (vec_id) GROUP BY 1), m AS (SELECT vec_id, angle, bx - (cos(angle) * ax - sin(angle) * ay) AS shift_x, by_ - (sin(angle) * ax + cos(angle) * ay) AS shift_y FROM k) SELECT vec_id, round(any_value(angle), 6) AS angle, round(any_value(shift_x), 6) AS shift_x, round(any_value(shift_y), 6) AS shift_y, round(avg((cos(angle) * sx - sin(angle) * sy + shift_x - tx) ** 2 + (sin(angle) * sx + cos(angle) * sy + shift_y - ty) ** 2), 6) AS error FROM pairs JOIN m USING (vec_id) GROUP BY 1")
def kabsch_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = register.kabsch_2d(polygon_pairs(spark, sf_dir), "vec_id")
    return rows.select("vec_id", *[F.round(c, 6).alias(c) for c in ("angle", "shift_x", "shift_y", "error")])


@query(f"WITH {POINTS} SELECT vec_id, CAST(k AS INTEGER) AS k, round(cos(radians(30)) * (x - 0.1) - sin(radians(30)) * (y + 0.2) + 0.1, 6) AS x, round(sin(radians(30)) * (x - 0.1) + cos(radians(30)) * (y + 0.2) - 0.2, 6) AS y FROM points")
def rigid_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.polygons(spark, sf_dir).select("vec_id", F.posexplode("points").alias("k", "p"))
    matrix = geometry.about((0.1, -0.2, 0.0), geometry.rotation_z(30))
    x, y, _ = geometry.affine(F.col("p.x"), F.col("p.y"), F.lit(0.0), matrix)
    return p.select("vec_id", "k", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


@query()
def icp_multistart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every four consecutive polygons stacked as a cloud: the best of 24 closest-point runs of each cloud onto the next."""
    p = views.polygons(spark, sf_dir).select("vec_id", F.posexplode("points").alias("k", "p"))
    points = p.select(F.expr("cast(floor(vec_id / 4) as long)").alias("cloud"), (F.col("vec_id") * 32 + F.col("k")).alias("vid"), F.col("p.x").alias("x"), F.col("p.y").alias("y"), (F.pmod("vec_id", F.lit(4)) * 0.1).alias("z"))
    best = register.align_pairs_from_starts(points)
    return best.select("cloud", "angle", F.round("error", 6).alias("error"), "iterations", "converged")


# ---- pixels and voxels


@query(f"WITH {PIXELS} SELECT image, y, x, CASE WHEN v > 127 THEN 255 ELSE 0 END AS v FROM pixels")
def threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.threshold(views.pixels(spark, sf_dir)).select("image", "y", "x", "v")


@query(f"WITH {PIXELS}, h AS (SELECT image, v, CAST(count(*) AS DOUBLE) AS n FROM pixels GROUP BY 1, 2), c AS (SELECT *, sum(n) OVER r AS n0, sum(n * v) OVER r AS s0, sum(n) OVER w AS nt, sum(n * v) OVER w AS st FROM h WINDOW r AS (PARTITION BY image ORDER BY v ROWS UNBOUNDED PRECEDING), w AS (PARTITION BY image)), b AS (SELECT image, v, round(coalesce(n0 * (nt - n0) * (s0 / n0 - (st - s0) / nullif(nt - n0, 0)) * (s0 / n0 - (st - s0) / nullif(nt - n0, 0)), 0), 3) AS between_ FROM c) SELECT image, v AS level FROM (SELECT *, row_number() OVER (PARTITION BY image ORDER BY between_ DESC, v) AS i FROM b) WHERE i = 1")
def otsu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.otsu_levels(views.pixels(spark, sf_dir))


@query(f"""WITH {PIXELS}, b AS (SELECT vec_id AS image, CAST(i // 8 AS INTEGER) AS y, CAST(i % 8 AS INTEGER) AS x, CAST(floor((least(greatest(CAST(embedding[i + 1] AS DOUBLE), CAST(-0.55 AS DOUBLE)), CAST(0.55 AS DOUBLE)) + CAST(0.55 AS DOUBLE)) * CAST(231.0 AS DOUBLE)) AS INTEGER) AS bv
    FROM (SELECT vec_id, embedding FROM embeddings WHERE vec_id = 0) CROSS JOIN range(64) AS r(i)) SELECT p.image, p.y, p.x, CASE WHEN abs(v - bv) > 30 THEN 255 ELSE 0 END AS v FROM pixels p LEFT JOIN b ON b.y = p.y AND b.x = p.x""")
def bg_subtract(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.pixels(spark, sf_dir)
    return pixels.subtract_background(p, p.filter("image = 0")).select("image", "y", "x", "v")


@query(f"WITH {PIXELS}, m AS (SELECT image, y, x, CASE WHEN v > 200 THEN 255 ELSE 0 END AS v FROM pixels) SELECT image, greatest(min(x) FILTER (WHERE v > 0) - 1, 0) AS x0, least(max(x) FILTER (WHERE v > 0) + 2, max(x) + 1) AS x1, greatest(min(y) FILTER (WHERE v > 0) - 1, 0) AS y0, least(max(y) FILTER (WHERE v > 0) + 2, max(y) + 1) AS y1 FROM m GROUP BY image HAVING max(v) > 0")
def bbox_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    mask = pixels.threshold(views.pixels(spark, sf_dir), 200)
    some = mask.groupBy("image").agg(F.max("v").alias("m")).filter("m > 0").select("image")
    return pixels.bounds(mask, 1, "image").join(some, "image")


CROSS = "el(dy, dx) AS (VALUES (-1, 0), (0, -1), (0, 0), (0, 1), (1, 0))"
SPREAD = "(SELECT p.image, p.y, p.x, {f}(q.v) AS v FROM {s} p CROSS JOIN el JOIN {s} q ON q.image = p.image AND q.y = p.y + dy AND q.x = p.x + dx GROUP BY 1, 2, 3)"


@query(f"WITH {PIXELS}, {CROSS}, m AS (SELECT image, y, x, CASE WHEN v > 127 THEN 255 ELSE 0 END AS v FROM pixels), a AS {SPREAD.format(f='min', s='m')}, b AS {SPREAD.format(f='max', s='a')}, c AS {SPREAD.format(f='max', s='b')}, d AS {SPREAD.format(f='min', s='c')} SELECT image, y, x, v FROM d")
def morph_open_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.open_close(pixels.threshold(views.pixels(spark, sf_dir)), 3).select("image", "y", "x", "v")


@query(f"WITH {VOXELS}, i AS (SELECT * FROM voxels WHERE inside), e AS (SELECT volume, 'x' AS axis, unnest([x, x - 1]) AS x, y, z FROM i UNION ALL SELECT volume, 'y', x, unnest([y, y - 1]), z FROM i UNION ALL SELECT volume, 'z', x, y, unnest([z, z - 1]) FROM i) SELECT volume, axis, x + CASE WHEN axis = 'x' THEN CAST(0.5 AS DOUBLE) ELSE 0 END AS x, y + CASE WHEN axis = 'y' THEN CAST(0.5 AS DOUBLE) ELSE 0 END AS y, z + CASE WHEN axis = 'z' THEN CAST(0.5 AS DOUBLE) ELSE 0 END AS z FROM e GROUP BY ALL HAVING count(*) = 1")
def isosurface_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return meshes.isosurface_vertices(views.voxels(spark, sf_dir))


SIDES = f"{VOXELS}, i AS (SELECT * FROM voxels WHERE inside), e AS (SELECT volume, 0 AS axis, unnest([2 * x - 1, 2 * x + 1]) AS x, 2 * y AS y, 2 * z AS z FROM i UNION ALL SELECT volume, 1, 2 * x, unnest([2 * y - 1, 2 * y + 1]), 2 * z FROM i UNION ALL SELECT volume, 2, 2 * x, 2 * y, unnest([2 * z - 1, 2 * z + 1]) FROM i), sides AS (SELECT volume, axis, x, y, z FROM e GROUP BY ALL HAVING count(*) = 1)"


CORNERS = ", ".join(f"(0, 0, {u}, {v}), (1, {u}, 0, {v}), (2, {u}, {v}, 0)" for u in (-1, 1) for v in (-1, 1))


@query(f"""WITH {SIDES}, nook(axis, dx, dy, dz) AS (VALUES {CORNERS}), corner AS (SELECT DISTINCT volume, x + dx AS x, y + dy AS y, z + dz AS z FROM sides JOIN nook USING (axis)),
    n AS (SELECT volume, count(*) AS n_vertices FROM corner GROUP BY 1), half(axis, ax, ay, az) AS (VALUES {", ".join(f"({a}, {', '.join(str(s if i == b else 0) for i in range(3))})" for a in range(3) for b in range(3) if b != a for s in (-1, 1))}),
    crowd AS (SELECT volume, x + ax AS x, y + ay AS y, z + az AS z, count(*) AS faces FROM sides JOIN half USING (axis) GROUP BY 1, 2, 3, 4), c AS (SELECT volume, bool_and(faces = 2) AS watertight FROM crowd GROUP BY 1),
    solid AS (SELECT volume, CAST(count(*) AS DOUBLE) AS volume_, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM voxels WHERE inside GROUP BY 1),
    b AS (SELECT volume, CAST(count(*) AS DOUBLE) AS area, 2 * count(*) AS n_faces, min(x - CASE WHEN axis = 0 THEN 0 ELSE 1 END) / 2 AS min_x, max(z + CASE WHEN axis = 2 THEN 0 ELSE 1 END) / 2 AS max_z FROM sides GROUP BY 1)
    SELECT volume AS mesh, area, n_faces, n_vertices, watertight, CASE WHEN watertight THEN volume_ ELSE 0 END AS volume, CASE WHEN watertight THEN round(cx, 6) END AS center_x, CASE WHEN watertight THEN round(cz, 6) END AS center_z, min_x, max_z
    FROM b JOIN n USING (volume) JOIN c USING (volume) JOIN solid USING (volume)""")
def mesh_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    info = meshes.mesh_info(meshes.voxel_faces(views.voxels(spark, sf_dir)).withColumnRenamed("volume", "mesh"))
    return info.select("mesh", "area", "n_faces", "n_vertices", "watertight", F.round("volume", 6).alias("volume"), *[(F.round(f"center_{x}", 6) + 0.0).alias(f"center_{x}") for x in "xz"], "min_x", "max_z")


@query(f"WITH {VOXELS} SELECT volume, z AS height_idx, CAST(count(*) AS DOUBLE) AS area FROM voxels WHERE inside GROUP BY 1, 2")
def mesh_section_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    heights = spark.range(4).select(F.col("id").cast("int").alias("height_idx"), (F.col("id") + 0.25).alias("z"))
    cuts = meshes.plane_sections(meshes.voxel_faces(views.voxels(spark, sf_dir)), heights, "volume")
    return meshes.section_areas(cuts, "volume").withColumn("area", F.round("area", 6))


@query(f"WITH {VOXELS} SELECT volume, z AS height_idx, CAST(count(*) AS DOUBLE) AS area FROM voxels WHERE inside GROUP BY 1, 2")
def mesh_section_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same areas from chained rings, holes taken off."""
    heights = spark.range(4).select(F.col("id").cast("int").alias("height_idx"), (F.col("id") + 0.25).alias("z"))
    cuts = meshes.plane_sections(meshes.voxel_faces(views.voxels(spark, sf_dir)), heights, "volume")
    return meshes.section_contour(meshes.section_rings(cuts, "volume"), "volume").select("volume", "height_idx", "area")


@query(f"""WITH {SIDES}, p AS (SELECT volume, CAST(z / 2 AS INTEGER) AS height_idx, CAST(count(*) AS DOUBLE) AS perimeter, 2 * count(*) AS n_points FROM sides WHERE axis <> 2 GROUP BY 1, 2), a AS (SELECT volume, z AS height_idx, CAST(count(*) AS DOUBLE) AS area FROM voxels WHERE inside GROUP BY 1, 2)
    SELECT volume, height_idx, area, perimeter, n_points FROM p JOIN a USING (volume, height_idx)""")
def mesh_linked_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections' areas, lengths and points from rings that list ranking chains, signed by even-odd nesting."""
    heights = spark.range(4).select(F.col("id").cast("int").alias("height_idx"), (F.col("id") + 0.25).alias("z"))
    cuts = meshes.plane_sections(meshes.voxel_faces(views.voxels(spark, sf_dir)), heights, "volume")
    rings = meshes.nested(written(meshes.linked_rings(cuts, "volume")), "volume")
    return rings.groupBy("volume", "height_idx").agg(F.round(F.sum("area"), 6).alias("area"), F.round(F.sum("perimeter"), 6).alias("perimeter"), F.sum("n_points").alias("n_points"))


@query(f"""WITH {VOXELS}, i AS (SELECT * FROM voxels WHERE inside), e AS (SELECT volume, 0 AS axis, unnest([x, x - 1]) AS x, y, z FROM i UNION ALL SELECT volume, 1, x, unnest([y, y - 1]), z FROM i UNION ALL SELECT volume, 2, x, y, unnest([z, z - 1]) FROM i),
    v AS (SELECT volume, axis, x, y, z FROM e GROUP BY ALL HAVING count(*) = 1)
    SELECT volume AS mesh, count(*) AS n_vertices, min(x + CASE axis WHEN 0 THEN CAST(0.5 AS DOUBLE) ELSE 0 END) AS min_x, max(z + CASE axis WHEN 2 THEN CAST(0.5 AS DOUBLE) ELSE 0 END) AS max_z, CAST(0 AS BIGINT) AS open_edges FROM v GROUP BY 1""")
def marching_cubes(spark: SparkSession, sf_dir: str) -> DataFrame:
    tris = meshes.marching_cubes(views.voxels(spark, sf_dir)).withColumnRenamed("volume", "mesh")
    return meshes.mesh_info(tris).select("mesh", "n_vertices", "min_x", "max_z").join(meshes.open_edges(tris), "mesh")


@query(f"""WITH {GREY}, e AS (SELECT volume, 0 AS axis, unnest([x, x - 1]) AS x, y, z, unnest([0, 1]) AS far, v FROM grey UNION ALL SELECT volume, 1, x, unnest([y, y - 1]), z, unnest([0, 1]), v FROM grey UNION ALL SELECT volume, 2, x, y, unnest([z, z - 1]), unnest([0, 1]), v FROM grey),
    p AS (SELECT volume, axis, x, y, z, coalesce(max(v) FILTER (WHERE far = 0), 0) AS a, coalesce(max(v) FILTER (WHERE far = 1), 0) AS b FROM e GROUP BY 1, 2, 3, 4, 5),
    c AS (SELECT *, (CAST(127 AS DOUBLE) - a) / (b - a) AS t FROM p WHERE (a > 127) <> (b > 127)),
    n AS (SELECT DISTINCT volume, x + CASE axis WHEN 0 THEN t ELSE 0 END AS x, y + CASE axis WHEN 1 THEN t ELSE 0 END AS y, z + CASE axis WHEN 2 THEN t ELSE 0 END AS z FROM c)
    SELECT volume AS mesh, count(*) AS n_vertices, round(sum(x), 6) AS sum_x, round(sum(y), 6) AS sum_y, round(sum(z), 6) AS sum_z, round(min(x), 6) AS min_x, round(max(z), 6) AS max_z, CAST(0 AS BIGINT) AS open_edges FROM n GROUP BY 1""")
def grey_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding as a volume of grey levels: the vertices of its surface at level 127, and whether that is closed."""
    grey = views.voxels(spark, sf_dir, level=True)
    tris = written(meshes.marching_cubes(grey, value="v", level=127.0, flat=True).withColumnRenamed("volume", "mesh"))
    point = F.explode(F.array(*[F.struct(*[F.col(f"{v}{x}").alias(x) for x in "xyz"]) for v in "abc"])).alias("p")
    vertices = tris.select("mesh", point).distinct().groupBy("mesh").agg(F.count("*").alias("n_vertices"), *[F.round(F.sum(f"p.{x}"), 6).alias(f"sum_{x}") for x in "xyz"], F.round(F.min("p.x"), 6).alias("min_x"), F.round(F.max("p.z"), 6).alias("max_z"))
    return vertices.join(meshes.open_edges(tris), "mesh")


@query(f"WITH {SIDES} SELECT volume, CAST(z / 2 AS INTEGER) AS height_idx, 2 * count(*) AS n_segments, CAST(count(*) AS DOUBLE) AS length FROM sides WHERE axis <> 2 GROUP BY 1, 2")
def mesh_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    heights = spark.range(4).select(F.col("id").cast("int").alias("height_idx"), (F.col("id") + 0.25).alias("z"))
    cuts = meshes.plane_sections(meshes.voxel_faces(views.voxels(spark, sf_dir)), heights, "volume")
    length = F.sqrt((F.col("x1") - F.col("x0")) * (F.col("x1") - F.col("x0")) + (F.col("y1") - F.col("y0")) * (F.col("y1") - F.col("y0")))
    return cuts.groupBy("volume", "height_idx").agg(F.count("*").alias("n_segments"), F.round(F.sum(length), 6).alias("length"))


@query(f"WITH {LAYERS} SELECT build_id, round((max(z) - min(z)) / greatest(1, count(*) - 1), 6) AS thickness FROM layers GROUP BY build_id")
def mean_thickness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.mean_thickness(views.layers(spark, sf_dir)).withColumn("thickness", F.round("thickness", 6))


# A border through pixel centres encloses a whole unit square where all of its four corners are in the filled set, and half
# of one where three are; it runs along a square's side, over its diagonal, or twice over the diagonal between two corners.
FLOODED = f"""WITH RECURSIVE {PIXELS}, on_ AS (SELECT image, y, x, y * 8 + x AS p FROM pixels WHERE v > 127), off_ AS (SELECT image, y, x, y * 8 + x AS p FROM pixels WHERE v <= 127),
    reach(image, root, p, y, x) AS (SELECT image, p, p, y, x FROM on_ UNION SELECT r.image, r.root, q.p, q.y, q.x FROM reach r JOIN on_ q ON q.image = r.image AND abs(q.y - r.y) <= 1 AND abs(q.x - r.x) <= 1),
    part AS (SELECT image, y, x, min(root) AS part FROM reach GROUP BY 1, 2, 3),
    gap(image, root, p, y, x) AS (SELECT image, p, p, y, x FROM off_ UNION SELECT r.image, r.root, q.p, q.y, q.x FROM gap r JOIN off_ q ON q.image = r.image AND abs(q.y - r.y) + abs(q.x - r.x) = 1),
    hollow AS (SELECT image, y, x, min(root) AS hole FROM gap GROUP BY 1, 2, 3),
    hole AS (SELECT h.image, h.hole, any_value(part) AS owner FROM (SELECT image, hole FROM hollow GROUP BY 1, 2 HAVING min(least(y, x)) > 0 AND max(greatest(y, x)) < 7) h JOIN part q ON q.image = h.image AND q.y = h.hole // 8 - 1 AND q.x = h.hole % 8 GROUP BY 1, 2),
    sets AS (SELECT image, 0 AS kind, part AS id, y, x FROM part UNION SELECT h.image, 1, h.hole, q.y, q.x FROM hole h JOIN hollow e ON e.image = h.image AND e.hole = h.hole JOIN part q ON q.image = h.image AND q.part = h.owner AND abs(q.y - e.y) + abs(q.x - e.x) = 1),
    outside(image, kind, id, y, x) AS (SELECT DISTINCT image, kind, id, -1, -1 FROM sets UNION SELECT o.image, o.kind, o.id, o.y + dy, o.x + dx FROM outside o CROSS JOIN (VALUES (0, 1), (1, 0), (0, -1), (-1, 0)) AS d(dy, dx)
        LEFT JOIN sets q ON q.image = o.image AND q.kind = o.kind AND q.id = o.id AND q.y = o.y + dy AND q.x = o.x + dx WHERE q.id IS NULL AND o.y + dy BETWEEN -1 AND 8 AND o.x + dx BETWEEN -1 AND 8),
    filled AS (SELECT s.image, s.kind, s.id, CAST(c.y AS INTEGER) AS y, CAST(g.x AS INTEGER) AS x FROM (SELECT DISTINCT image, kind, id FROM sets) s CROSS JOIN range(8) AS c(y) CROSS JOIN range(8) AS g(x) LEFT JOIN outside o ON o.image = s.image AND o.kind = s.kind AND o.id = s.id AND o.y = c.y AND o.x = g.x WHERE o.id IS NULL),
    squares AS (SELECT image, kind, id, f.y + dy AS wy, f.x + dx AS wx, count(*) AS n, count(DISTINCT f.y) = 2 AND count(DISTINCT f.x) = 2 AS slant FROM filled f CROSS JOIN (VALUES (0, 0), (0, -1), (-1, 0), (-1, -1)) AS d(dy, dx) GROUP BY 1, 2, 3, 4, 5),
    traced AS (SELECT image, kind, id, sum(CASE n WHEN 4 THEN CAST(1 AS DOUBLE) WHEN 3 THEN CAST(0.5 AS DOUBLE) ELSE 0 END) AS area, sum(CASE WHEN n = 3 THEN sqrt(CAST(2 AS DOUBLE)) WHEN n = 2 AND slant THEN 2 * sqrt(CAST(2 AS DOUBLE)) WHEN n = 2 THEN CAST(1 AS DOUBLE) ELSE 0 END) AS length FROM squares GROUP BY 1, 2, 3),
    holes AS (SELECT h.image, h.owner, count(*) AS n, sum(t.area) AS area FROM hole h JOIN traced t ON t.image = h.image AND t.kind = 1 AND t.id = h.hole GROUP BY 1, 2)"""


@query(f"""{FLOODED} SELECT t.image, CAST(row_number() OVER (PARTITION BY t.image ORDER BY t.id) - 1 AS INTEGER) AS contour_idx, CAST(coalesce(h.n, 0) AS INTEGER) AS n_holes, round(t.area - coalesce(h.area, 0), 6) AS area_mm2, round(length, 6) AS perimeter_mm
    FROM traced t LEFT JOIN holes h ON h.image = t.image AND h.owner = t.id WHERE t.kind = 0 AND t.area >= 1""")
def contours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlines of the 8 x 8 masks, by the numpy border follower."""
    found = mask_contours(spark, sf_dir)
    return found.select("image", "contour_idx", F.size("inners").alias("n_holes"), F.round("area_mm2", 6).alias("area_mm2"), F.round("perimeter_mm", 6).alias("perimeter_mm"))


@query()
def contour_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of the same outlines' points when they are simplified, and how round they are; tested against a plain recursion, as SQL has no Douglas-Peucker."""
    found = mask_contours(spark, sf_dir)
    return found.select("image", "contour_idx", F.size("outer").alias("n_points"), F.transform("inners", lambda h: F.size(h)).alias("hole_points"), F.round("confidence", 6).alias("confidence"))


def mask_contours(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.pixels(spark, sf_dir).groupBy("image").agg(F.array_sort(F.collect_list(F.struct("y", "x", "v"))).alias("p"))
    mask = F.unhex(F.array_join(F.transform("p", lambda q: F.when(q["v"] > 127, "FF").otherwise("00")), ""))
    return segment.contours(p.select("image", F.lit(8).alias("height"), F.lit(8).alias("width"), mask.alias("mask")))
