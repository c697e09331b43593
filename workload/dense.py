"""Queries over scanline volumes: normalisation, crops, resampling, zooms."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxtally.functions import geometry as geo
from voxtally.operators import crops as cr
from voxtally.operators import normalize as nm
from voxtally.operators import resample as rs
from voxtally.operators import sampling as sm
from voxtally.plans import crops as plans
from workload import fixtures as fx
from workload.oracle_parts import PARTS
from workload.registry import query, rounded
from workload.tables import draw_sql


def voxels(lines):
    return rounded(lines.select("case_id", "z", "y", F.posexplode("vals").alias("x", "v")))


# Prompts inside the 4x4x4 volumes.
PARTS["scan_prompts"] = (["scan_meta"], """SELECT *, (case_id % 4)::DOUBLE AS ax, (case_id // 4 % 4)::DOUBLE AS ay, (case_id // 16 % 4)::DOUBLE AS az, (case_id // 3 % 4)::DOUBLE AS bx,
  (case_id // 5 % 4)::DOUBLE AS "by", (case_id // 7 % 4)::DOUBLE AS bz, CAST(case_id // 16 % 4 AS INT) AS slice FROM scan_meta""")


def scan_prompts(spark, d):
    return fx.scan_meta(spark, d).selectExpr(
        "*", "cast(case_id % 4 AS double) AS ax", "cast(case_id div 4 % 4 AS double) AS ay", "cast(case_id div 16 % 4 AS double) AS az",
        "cast(case_id div 3 % 4 AS double) AS bx", "cast(case_id div 5 % 4 AS double) AS by", "cast(case_id div 7 % 4 AS double) AS bz",
        "cast(case_id div 16 % 4 AS int) AS slice")


PARTS["norm_sample"] = (["scan_voxels"], f"""SELECT case_id, v FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY md5(case_id || '|' || z || '|' || y || '|' || x || '|13'), z, y, x) AS rn
  FROM scan_voxels WHERE v <> 0) WHERE rn <= 40""")
PARTS["norm_stats"] = (["scan_voxels"], """SELECT lo AS clip_low, hi AS clip_high, avg(c) AS mean, stddev_pop(c) AS std, count(DISTINCT case_id) AS source_case_count, count(*) AS source_voxel_count FROM (
  SELECT *, greatest(lo, least(v, hi)) AS c FROM scan_voxels, (SELECT quantile_cont(v, 0.005) AS lo, quantile_cont(v, 0.995) AS hi FROM scan_voxels WHERE v <> 0) WHERE v <> 0) GROUP BY 1, 2""")


@query("normalization_stats", ["norm_stats"], """SELECT round(clip_low, 6) AS clip_low, round(clip_high, 6) AS clip_high, round(mean, 6) AS mean, round(std, 6) AS std, source_case_count,
  source_voxel_count, 'dataset_stats' AS mode FROM norm_stats""")
def normalization_stats(spark, d):
    return rounded(nm.normalization_stats(fx.scanlines(spark, d)))


@query("exact_percentiles", [], """SELECT s AS share, round(CASE s WHEN 0.005 THEN quantile_cont(l_extendedprice, 0.005) WHEN 0.5 THEN quantile_cont(l_extendedprice, 0.5)
  ELSE quantile_cont(l_extendedprice, 0.995) END, 6) AS value FROM lineitem, (VALUES (0.005::DOUBLE), (0.5::DOUBLE), (0.995::DOUBLE)) t(s) GROUP BY 1""")
def exact_percentiles(spark, d):
    out = nm.exact_percentiles(fx.table(spark, d, "lineitem"), "l_extendedprice", [0.005, 0.5, 0.995])
    return out.select("share", F.round("value", 6).alias("value"))


@query("sample_per_case", ["norm_sample"], "SELECT case_id, v FROM norm_sample")
def sample_per_case(spark, d):
    return nm.sample_per_case(nm.voxel_values(fx.scanlines(spark, d)), 40).select("case_id", "v")


@query("normalize_dataset_stats", ["scan_voxels", "norm_stats"], "SELECT case_id, z, y, x, round((greatest(clip_low, least(v, clip_high)) - mean) / std, 6) AS v FROM scan_voxels, norm_stats")
def normalize_dataset_stats(spark, d):
    lines = fx.scanlines(spark, d)
    return voxels(nm.normalize_by_mode(lines, "dataset_stats", nm.normalization_stats(lines)))


@query("normalize_fixed_hu", ["scan_voxels"], "SELECT case_id, z, y, x, round(greatest(-1000, least(v * 5000, 1000)) / 500, 6) AS v FROM scan_voxels")
def normalize_fixed_hu(spark, d):
    lines = fx.scanlines(spark, d).withColumn("vals", F.expr("transform(vals, v -> v * 5000)"))
    return voxels(nm.normalize_by_mode(lines, "fixed_hu"))


@query("crop_zscore", ["scan_voxels"], """, q AS (SELECT case_id, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM scan_voxels GROUP BY 1),
  c AS (SELECT s.*, greatest(lo, least(v, hi)) AS c FROM scan_voxels s JOIN q USING (case_id)),
  m AS (SELECT case_id, avg(c) AS mean, stddev_pop(c) AS std FROM c GROUP BY 1) SELECT case_id, z, y, x, round((c - mean) / std, 6) AS v FROM c JOIN m USING (case_id)""")
def crop_zscore(spark, d):
    return voxels(nm.normalize_by_mode(fx.scanlines(spark, d), "dataset_stats"))


@query("masked_values", ["scan_voxels", "scan_mask"], "SELECT v.case_id, z, y, x, round(v, 6) AS v FROM scan_voxels v JOIN scan_mask USING (case_id, z, y, x)")
def masked_values(spark, d):
    return rounded(nm.voxel_values(fx.scanlines(spark, d), fx.scan_mask(spark, d)))


_IJ = f"{draw_sql('case_id', 'factor')}", f"{draw_sql('case_id', 'offset')}"


@query("intensity_jitter", ["scan_voxels"], f"SELECT case_id, z, y, x, round(v * (1 + (2 * {_IJ[0]} - 1) * 0.05) + (2 * {_IJ[1]} - 1) * 0.03, 6) AS v FROM scan_voxels")
def intensity_jitter(spark, d):
    return voxels(sm.intensity_jitter(fx.scanlines(spark, d), 0.05, 0.03, 0.0))


_vkey = "case_id || '|' || z || '|' || y || '|' || x"


def _plus(tag: str) -> str:
    return f"((('0x' || substr(md5({_vkey} || '|{tag}|13'), 1, 12))::BIGINT + 1) / 281474976710657.0::DOUBLE)"


@query("intensity_noise", ["scan_voxels"], f"""SELECT case_id, z, y, x, round(v * (1 + (2 * {_IJ[0]} - 1) * 0.05) + (2 * {_IJ[1]} - 1) * 0.03
  + sqrt(-2 * ln({_plus('radius')})) * cos(2 * pi() * {_plus('angle')}) * 0.01, 6) AS v FROM scan_voxels""")
def intensity_noise(spark, d):
    return voxels(sm.intensity_jitter(fx.scanlines(spark, d), 0.05, 0.03, 0.01))


# ---- crops --------------------------------------------------------------------------------------------------------------

def window_sql(size: tuple[int, int, int], dims: tuple[int, int, int]) -> str:
    parts = []
    for a, s, n in zip("zyx", size, dims):
        w = min(s, n)
        parts.append(f'CAST(greatest(0, least(round_even((a{a} + "b{a}") / 2, 0) - {w // 2}, {n - w})) AS INT) AS w_{a}0')
    return ", ".join(parts)


PARTS["scan_windows"] = (["scan_prompts"], f"SELECT case_id, {window_sql((2, 3, 6), (4, 4, 4))}, ax, ay, az, bx, \"by\", bz FROM scan_prompts")


@query("prompt_crop", ["scan_windows", "scan_voxels"], """SELECT w.case_id, CAST(i AS INT) AS z, CAST(j AS INT) AS y, CAST(k AS INT) AS x, round(coalesce(v, 0), 6) AS v FROM scan_windows w, range(0, 2) a(i), range(0, 3) b(j), range(0, 6) c(k)
  LEFT JOIN scan_voxels s ON s.case_id = w.case_id AND s.z = w_z0 + i AND s.y = w_y0 + j AND s.x = w_x0 + k""")
def prompt_crop(spark, d):
    windows = geo.crop_window(scan_prompts(spark, d), (2, 3, 6))
    return voxels(cr.pad_lines(cr.crop_lines(fx.scanlines(spark, d), windows), cr.crop_endpoints(windows), (2, 3, 6)))


@query("pad_volume", ["scan_meta", "scan_voxels"], """SELECT m.case_id, CAST(i AS INT) AS z, CAST(j AS INT) AS y, CAST(k AS INT) AS x, round(coalesce(v, 0), 6) AS v FROM scan_meta m, range(0, 5) a(i), range(0, 3) b(j), range(0, 6) c(k)
  LEFT JOIN scan_voxels s ON s.case_id = m.case_id AND s.z = i AND s.y = j AND s.x = k""")
def pad_volume(spark, d):
    shapes = fx.scan_meta(spark, d).selectExpr("case_id", "nz AS restore_z", "ny AS restore_y", "nx AS restore_x")
    return voxels(cr.pad_lines(fx.scanlines(spark, d), shapes, (5, 3, 6)))


@query("center_crop", ["scan_mask", "scan_meta"], """, c AS (SELECT case_id, avg(z) AS mz, avg(y) AS my, avg(x) AS mx FROM scan_mask GROUP BY 1), w AS (SELECT case_id,
    CAST(greatest(0, least(round_even(mz, 0) - 1, 2)) AS INT) AS w_z0, CAST(greatest(0, least(round_even(my, 0) - 1, 2)) AS INT) AS w_y0, CAST(greatest(0, least(round_even(mx, 0) - 1, 2)) AS INT) AS w_x0 FROM c)
  SELECT case_id, z - w_z0 AS z, y - w_y0 AS y, x - w_x0 AS x, label FROM scan_mask JOIN w USING (case_id) WHERE z BETWEEN w_z0 AND w_z0 + 1 AND y BETWEEN w_y0 AND w_y0 + 1 AND x BETWEEN w_x0 AND w_x0 + 1""")
def center_crop(spark, d):
    mask = fx.scan_mask(spark, d)
    centers = mask.groupBy("case_id").agg(*[F.avg(a).alias(f"m{a}") for a in "zyx"]).join(fx.scan_meta(spark, d), "case_id")
    return cr.crop_mask(mask, geo.crop_window(centers, (2, 2, 2), {a: F.col(f"m{a}") for a in "zyx"}))


@query("restore_crop", ["case_windows", "gt"], """SELECT g.* FROM gt g JOIN case_windows USING (case_id) WHERE z BETWEEN w_z0 AND w_z0 + 9 AND y BETWEEN w_y0 AND w_y0 + 19 AND x BETWEEN w_x0 AND w_x0 + 23""")
def restore_crop(spark, d):
    windows = geo.crop_window(fx.case_prompts(spark, d), (10, 20, 24))
    return cr.restore_crop(cr.crop_mask(fx.gt(spark, d), windows), windows)


@query("crop_endpoints", ["case_prompts", "case_windows"], """SELECT case_id, ax - w_x0 AS ax, ay - w_y0 AS ay, az - w_z0 AS az, bx - w_x0 AS bx, "by" - w_y0 AS "by", bz - w_z0 AS bz,
  CAST(round_even((az + bz) / 2 - w_z0, 0) AS INT) AS slice, 10 AS restore_z, 20 AS restore_y, 24 AS restore_x FROM case_prompts JOIN case_windows USING (case_id)""")
def crop_endpoints(spark, d):
    moved = cr.crop_endpoints(geo.crop_window(fx.case_prompts(spark, d), (10, 20, 24)))
    return moved.select("case_id", *geo.ENDS, "slice", "restore_z", "restore_y", "restore_x")


@query("flip_volume", ["scan_voxels"], "SELECT case_id, 3 - z AS z, y, 3 - x AS x, round(v, 6) AS v FROM scan_voxels")
def flip_volume(spark, d):
    return voxels(cr.flip_lines(fx.scanlines(spark, d), fx.scan_meta(spark, d), "zx"))


@query("flip_endpoints", ["prompts"], """SELECT case_id, prompt, 49 - ax AS ax, ay, 23 - az AS az, 49 - bx AS bx, "by", 23 - bz AS bz FROM prompts""")
def flip_endpoints(spark, d):
    return geo.flip_endpoints(fx.prompts(spark, d), "zx").select("case_id", "prompt", *geo.ENDS)


@query("endpoints_inside_with_margin", ["prompts", "meta"], """SELECT case_id, prompt, least(az, bz) >= least(15 / sz, 11.5) AND greatest(az, bz) <= 23 - least(15 / sz, 11.5)
  AND least(ay, "by") >= 15 AND greatest(ay, "by") <= 34 AND least(ax, bx) >= 15 AND greatest(ax, bx) <= 34 AS inside FROM prompts JOIN (SELECT case_id, sz FROM meta) USING (case_id)""")
def endpoints_inside_with_margin(spark, d):
    rows = fx.prompts(spark, d).join(fx.meta(spark, d).select("case_id", "sz", "sy", "sx"), "case_id")
    return rows.select("case_id", "prompt", cr.endpoints_inside(15.0).alias("inside"))


def _spaced_prompts(spark, d):
    return fx.case_prompts(spark, d).join(fx.meta(spark, d).select("case_id", "sz", "sy", "sx"), "case_id")


# Voxels of the prompt's own label are the crop's target.
PARTS["label_target"] = (["gt", "case_prompts"], "SELECT g.case_id, z, y, x FROM gt g JOIN case_prompts p ON p.case_id = g.case_id AND p.label = g.label")


def label_target(spark, d):
    wanted = fx.case_prompts(spark, d).select("case_id", "label")
    return fx.gt(spark, d, wanted).select("case_id", "z", "y", "x")


@query("needs_bbox_tail", ["label_target", "case_prompts"], f""", w AS (SELECT *, {window_sql((16, 40, 44), (24, 50, 50))} FROM case_prompts),
  f AS (SELECT w.case_id, count(t.z) AS n, count(*) FILTER (z BETWEEN w_z0 AND w_z0 + 15 AND y BETWEEN w_y0 AND w_y0 + 39 AND x BETWEEN w_x0 AND w_x0 + 43) AS kept,
    max(z) - min(z) + 1 > 16 OR max(y) - min(y) + 1 > 40 OR max(x) - min(x) + 1 > 44 AS big,
    bool_or(z IN (w_z0, w_z0 + 15) OR y IN (w_y0, w_y0 + 39) OR x IN (w_x0, w_x0 + 43)) FILTER (z BETWEEN w_z0 AND w_z0 + 15 AND y BETWEEN w_y0 AND w_y0 + 39 AND x BETWEEN w_x0 AND w_x0 + 43) AS touch
    FROM w LEFT JOIN label_target t ON t.case_id = w.case_id GROUP BY 1)
  SELECT case_id, n > 0 AND (big OR kept / n < 0.95 OR coalesce(touch, false) OR NOT (ax - w_x0 >= 3 AND bx - w_x0 <= 40 AND least(ay, "by") - w_y0 >= 3 AND greatest(ay, "by") - w_y0 <= 36
    AND az - w_z0 >= 3 / (1 + case_id % 3) AND az - w_z0 <= 15 - 3 / (1 + case_id % 3))) AS needs_tail FROM w JOIN f USING (case_id)""")
def needs_bbox_tail(spark, d):
    windows = geo.crop_window(_spaced_prompts(spark, d), (16, 40, 44))
    return cr.needs_bbox_tail(windows, label_target(spark, d), (16, 40, 44), margin_mm=3.0)


# ---- resampling ---------------------------------------------------------------------------------------------------------

def resampled_sql(near_z: str = "false") -> str:
    wz = f"CASE WHEN {near_z} THEN (floor(pz + 0.5) = z)::INT ELSE greatest(0, 1 - abs(pz - z)) END"
    return f"""SELECT case_id, oz AS z, oy AS y, ox AS x, round(sum(v * wz * greatest(0, 1 - abs(py - y)) * greatest(0, 1 - abs(px - x))), 6) AS v FROM (
      SELECT *, {wz} AS wz FROM (SELECT o.*, s.z, s.y, s.x, s.v, oz * 3 / (mz - 1) AS pz, oy * 3 / (my - 1) AS py, ox * 3 / (mx - 1) AS px
      FROM out_grid o JOIN scan_voxels s USING (case_id))) GROUP BY 1, 2, 3, 4"""


PARTS["out_grid"] = (["scan_meta"], """SELECT *, CAST(unnest(range(0, mz)) AS INT) AS oz FROM (SELECT *, CAST(unnest(range(0, my)) AS INT) AS oy FROM (SELECT *, CAST(unnest(range(0, mx)) AS INT) AS ox
  FROM (SELECT case_id, sz, CAST(round_even(4 * sz / 2, 0) AS INT) AS mz, CAST(round_even(4 * (1 / 0.8::FLOAT::DOUBLE), 0) AS INT) AS my, CAST(round_even(4 * (1 / 0.8::FLOAT::DOUBLE), 0) AS INT) AS mx FROM scan_meta)))""")


@query("resample_standard", ["out_grid", "scan_voxels"], resampled_sql())
def resample_standard(spark, d):
    plan = rs.spacing_plan(fx.scan_meta(spark, d), (0.8, 0.8, 2.0))
    return voxels(rs.resample_lines(fx.scanlines(spark, d), plan))


@query("resample_anisotropic", ["out_grid", "scan_voxels"], resampled_sql("sz >= 3"))
def resample_anisotropic(spark, d):
    plan = rs.spacing_plan(fx.scan_meta(spark, d), (0.8, 0.8, 2.0), "anisotropic")
    return voxels(rs.resample_lines(fx.scanlines(spark, d), plan))


_NEAR = "floor(oz * 3 / (mz - 1) + 0.5) = s.z AND floor(oy * 3 / (my - 1) + 0.5) = s.y AND floor(ox * 3 / (mx - 1) + 0.5) = s.x"


@query("resample_mask", ["out_grid", "scan_mask"], f"SELECT case_id, oz AS z, oy AS y, ox AS x, label FROM out_grid JOIN scan_mask s USING (case_id) WHERE {_NEAR}")
def resample_mask(spark, d):
    return rs.resample_mask(fx.scan_mask(spark, d), rs.spacing_plan(fx.scan_meta(spark, d), (0.8, 0.8, 2.0)))


@query("resample_aux", ["scattered_meta", "aux_voxels"], """, o AS (SELECT case_id, CAST(unnest(range(0, m)) AS INT) AS oz, m FROM (SELECT case_id, CAST(round_even(7 * sz, 0) AS INT) AS m FROM scattered_meta))
  SELECT case_id, oz AS z, y, x, class_id FROM o JOIN aux_voxels a USING (case_id) WHERE floor(oz * 6 / (m - 1) + 0.5) = z""")
def resample_aux(spark, d):
    return rs.resample_mask(fx.aux_voxels(spark, d), rs.spacing_plan(fx.scattered_meta(spark, d), (1.0, 1.0, 1.0), "anisotropic"))


@query("resample_prompts", ["prompts", "meta"], """SELECT p.case_id, prompt, ax / 2 AS ax, ay / 2 AS ay, least(az * sz, mz - 1) AS az, bx / 2 AS bx, "by" / 2 AS "by", least(bz * sz, mz - 1) AS bz,
  CAST(least(round_even(slice * sz, 0), mz - 1) AS INT) AS slice, mz AS nz, 25 AS ny, 25 AS nx FROM prompts p JOIN (SELECT case_id, sz, CAST(24 * sz AS INT) AS mz FROM meta) m ON m.case_id = p.case_id""")
def resample_prompts(spark, d):
    moved = rs.resample_prompts(fx.prompts(spark, d), rs.spacing_plan(fx.meta(spark, d), (2.0, 2.0, 1.0)))
    return moved.select("case_id", "prompt", *geo.ENDS, "slice", "nz", "ny", "nx")


PARTS["shape_grid"] = (["scan_meta"], "SELECT case_id, sz, 3 AS mz, 6 AS my, 5 AS mx, CAST(a AS INT) AS oz, CAST(b AS INT) AS oy, CAST(c AS INT) AS ox FROM scan_meta, range(0, 3) a(a), range(0, 6) b(b), range(0, 5) c(c)")


@query("resize_to_shape", ["shape_grid", "scan_voxels"], resampled_sql().replace("out_grid", "shape_grid"))
def resize_to_shape(spark, d):
    return voxels(rs.resample_lines(fx.scanlines(spark, d), rs.shape_plan(fx.scan_meta(spark, d), (3, 6, 5))))


@query("resize_crop_keep_target", ["shape_grid", "scan_mask"], f"""SELECT case_id, oz AS z, oy AS y, ox AS x FROM shape_grid JOIN scan_mask s USING (case_id) WHERE {_NEAR} UNION
  SELECT case_id, CAST(floor((z + 0.5) * 3 / 4) AS INT), CAST(floor((y + 0.5) * 6 / 4) AS INT), CAST(floor((x + 0.5) * 5 / 4) AS INT) FROM scan_mask""")
def resize_crop_keep_target(spark, d):
    return rs.resize_keep_target(fx.scan_mask(spark, d), rs.shape_plan(fx.scan_meta(spark, d), (3, 6, 5)))


# ---- crops that change scale ----------------------------------------------------------------------------------------------

_FOV = ((10, 20, 20), (1.35, 1.8, 1.8))
PARTS["fov"] = (["case_prompts"], """SELECT *, """ + ", ".join(
    f"""CASE WHEN lo_{a} <= hi_{a} THEN greatest(lo_{a}, least(wish_{a}, hi_{a})) ELSE greatest(0, least(wish_{a}, {n} - {w})) END AS w_{a}0""" for a, n, w in (("z", 24, 14), ("y", 50, 36), ("x", 50, 36)))
  + " FROM (SELECT *, " + ", ".join(
    f"""CAST(round_even((a{a} + "b{a}") / 2, 0) - {w // 2} AS INT) AS wish_{a}, CAST(greatest(0, ceil(greatest(a{a}, "b{a}") + {m} - {w - 1})) AS INT) AS lo_{a}, CAST(least({n} - {w}, floor(least(a{a}, "b{a}") - {m})) AS INT) AS hi_{a}"""
    for a, n, w, m in (("z", 24, 14, "5.0 / (1 + case_id % 3)"), ("y", 50, 36, "5.0"), ("x", 50, 36, "5.0"))) + " FROM case_prompts)")


@query("multifov_windows", ["fov"], """SELECT case_id, w_z0, w_z0 + 14 AS w_z1, w_y0, w_y0 + 36 AS w_y1, w_x0, w_x0 + 36 AS w_x1, """ + ", ".join(
    f"""round(CAST(({'"' + e + '"'} - w_{e[1]}0) * CAST({s} / {w} AS FLOAT)::DOUBLE AS FLOAT)::DOUBLE, 5) AS {'"' + e + '"'}""" for e in geo.ENDS for s, w in [((10.0, 14) if e[1] == 'z' else (20.0, 36))])
  + " FROM fov")
def multifov_windows(spark, d):
    windows = plans.multifov_windows(_spaced_prompts(spark, d), *_FOV, keep_inside=True, margin_mm=5.0)
    ends = plans.multifov_endpoints(windows, _FOV[0])
    return rounded(ends.select("case_id", *cr.WINDOW, *geo.ENDS), 5)


@query("multifov_crop", ["fov", "label_target"], """, t AS (SELECT case_id, z - w_z0 AS z, y - w_y0 AS y, x - w_x0 AS x FROM label_target JOIN fov USING (case_id)
    WHERE z BETWEEN w_z0 AND w_z0 + 13 AND y BETWEEN w_y0 AND w_y0 + 35 AND x BETWEEN w_x0 AND w_x0 + 35)
  SELECT case_id, CAST(oz AS INT) AS z, CAST(oy AS INT) AS y, CAST(ox AS INT) AS x FROM t JOIN range(0, 10) a(oz) ON floor(oz * 13 / 9 + 0.5) = z JOIN range(0, 20) b(oy) ON floor(oy * 35 / 19 + 0.5) = y
    JOIN range(0, 20) c(ox) ON floor(ox * 35 / 19 + 0.5) = x UNION
  SELECT case_id, CAST(floor(CAST((z + 0.5) * CAST(10.0 / 14 AS FLOAT)::DOUBLE AS FLOAT)) AS INT), CAST(floor(CAST((y + 0.5) * CAST(20.0 / 36 AS FLOAT)::DOUBLE AS FLOAT)) AS INT),
    CAST(floor(CAST((x + 0.5) * CAST(20.0 / 36 AS FLOAT)::DOUBLE AS FLOAT)) AS INT) FROM t""")
def multifov_crop(spark, d):
    windows = plans.multifov_windows(_spaced_prompts(spark, d), *_FOV, keep_inside=True, margin_mm=5.0)
    return plans.multifov_mask(label_target(spark, d), windows, _FOV[0])


@query("multifov_lines")
def multifov_lines(spark, d):
    windows = plans.multifov_windows(scan_prompts(spark, d), (2, 3, 4), (1.5, 1.4, 1.5))
    return voxels(plans.multifov_lines(fx.scanlines(spark, d), windows, (2, 3, 4), (3, 5, 6)))


_FIT = ((12, 24, 24), (2, 4, 4))


def _fit_window(a: str, n: str, width: str, margin: int, mid: str) -> str:
    low, high = f"greatest(0, least(bb_{a}1 + {margin}, {n}) - {width})", f"least(greatest(bb_{a}0 - {margin}, 0), {n} - {width})"
    wish = f"round_even({mid}, 0) - {width} // 2"
    return f"CASE WHEN {low} <= {high} THEN greatest({low}, least({wish}, {high})) ELSE greatest(0, least({wish}, {n} - {width})) END"


PARTS["fit_plan"] = (["case_prompts", "label_target"], "SELECT *, zoom_z < 0.999 OR zoom_y < 0.999 OR zoom_x < 0.999 AS rescaled, " + ", ".join(
    f"least(greatest(ceil(CAST({s}.0 / zoom_{a} AS FLOAT)), bb_{a}1 - bb_{a}0 + {2 * m}), {n})::INT AS width_{a}" for a, s, m, n in (("z", 12, 2, 24), ("y", 24, 4, 50), ("x", 24, 4, 50)))
  + " FROM (SELECT *, " + ", ".join(f"CAST(least(1.0, {s}.0 / (bb_{a}1 - bb_{a}0 + {2 * m})) AS FLOAT)::DOUBLE AS zoom_{a}" for a, s, m in (("z", 12, 2), ("y", 24, 4), ("x", 24, 4)))
  + " FROM case_prompts JOIN (SELECT case_id, min(z) AS bb_z0, max(z) + 1 AS bb_z1, min(y) AS bb_y0, max(y) + 1 AS bb_y1, min(x) AS bb_x0, max(x) + 1 AS bb_x1 FROM label_target GROUP BY 1) USING (case_id))")
PARTS["fit_source"] = (["fit_plan"], "SELECT *, " + ", ".join(f"CAST(CASE WHEN rescaled THEN s0_{a} ELSE 0 END AS INT) AS s_{a}0, CAST(CASE WHEN rescaled THEN s0_{a} + width_{a} ELSE {n} END AS INT) AS s_{a}1" for a, n in (("z", 24), ("y", 50), ("x", 50)))
  + " FROM (SELECT *, " + ", ".join(_fit_window(a, n, f"width_{a}", m, f'(a{a} + "b{a}") / 2') + f" AS s0_{a}" for a, n, m in (("z", "24", 2), ("y", "50", 4), ("x", "50", 4))) + " FROM fit_plan)")
PARTS["fit_frame"] = (["fit_source"], "SELECT *, " + ", ".join(f"CAST(round_even((s_{a}1 - s_{a}0) * zoom_{a}, 0) AS INT) AS f{a}" for a in "zyx") + " FROM fit_source")
PARTS["fit_mask"] = (["fit_frame", "label_target"], """SELECT case_id, CAST(oz AS INT) AS z, CAST(oy AS INT) AS y, CAST(ox AS INT) AS x FROM (SELECT f.*, t.z - s_z0 AS z, t.y - s_y0 AS y, t.x - s_x0 AS x FROM label_target t JOIN fit_frame f USING (case_id)
    WHERE t.z >= s_z0 AND t.z < s_z1 AND t.y >= s_y0 AND t.y < s_y1 AND t.x >= s_x0 AND t.x < s_x1) q JOIN range(0, 24) a(oz) ON oz < fz AND floor(oz * ((s_z1 - s_z0 - 1) / (fz - 1)) + 0.5) = z
    JOIN range(0, 50) b(oy) ON oy < fy AND floor(oy * ((s_y1 - s_y0 - 1) / (fy - 1)) + 0.5) = y JOIN range(0, 50) c(ox) ON ox < fx AND floor(ox * ((s_x1 - s_x0 - 1) / (fx - 1)) + 0.5) = x UNION
  SELECT case_id, """ + ", ".join(f"CAST(least(floor(CAST((t.{a} - s_{a}0 + 0.5) * zoom_{a} AS FLOAT)), f{a} - 1) AS INT)" for a in "zyx") + """ FROM label_target t JOIN fit_frame f USING (case_id)
    WHERE t.z >= s_z0 AND t.z < s_z1 AND t.y >= s_y0 AND t.y < s_y1 AND t.x >= s_x0 AND t.x < s_x1""")


def _fit(spark, d):
    target = label_target(spark, d)
    plan = plans.bbox_fit_plan(fx.case_prompts(spark, d), target, *_FIT)
    return plan, plans.bbox_fit_mask(target, plan)


@query("bbox_fit_mask", ["fit_mask"], "SELECT * FROM fit_mask")
def bbox_fit_mask(spark, d):
    return _fit(spark, d)[1]


PARTS["fit_crop"] = (["fit_frame", "fit_mask"], "SELECT *, " + ", ".join(f"CAST({_fit_window(a, f'f{a}', f'least({s}, f{a})', m, f'(e_a{a} + e_b{a}) / 2')} AS INT) AS w_{a}0, least({s}, f{a}) AS wide_{a}" for a, s, m in (("z", 12, 2), ("y", 24, 4), ("x", 24, 4)))
  + " FROM (SELECT f.* EXCLUDE (bb_z0, bb_z1, bb_y0, bb_y1, bb_x0, bb_x1), m.* EXCLUDE (case_id), " + ", ".join(
    f"""greatest(0, least(CAST(({'"' + e + '"'} - s_{e[1]}0) * zoom_{e[1]} AS FLOAT)::DOUBLE, f{e[1]} - 1)) AS e_{e}""" for e in geo.ENDS)
  + " FROM fit_frame f JOIN (SELECT case_id, count(*) AS voxels, min(z) AS bb_z0, max(z) + 1 AS bb_z1, min(y) AS bb_y0, max(y) + 1 AS bb_y1, min(x) AS bb_x0, max(x) + 1 AS bb_x1 FROM fit_mask GROUP BY 1) m USING (case_id))")


@query("bbox_fit_crop", ["fit_crop", "fit_mask"], "SELECT c.case_id, rescaled, " + ", ".join(f"s_{a}0, s_{a}1, w_{a}0, w_{a}0 + wide_{a} AS w_{a}1, round(zoom_{a}, 6) AS zoom_{a}" for a in "zyx") + ", " + ", ".join(
    f"round(greatest(0, least(e_{e} - w_{e[1]}0, {11 if e[1] == 'z' else 23})), 5) AS {chr(34) + e + chr(34)}" for e in geo.ENDS)
  + """, voxels, round(coalesce(n, 0) / voxels, 6) AS coverage FROM fit_crop c LEFT JOIN (SELECT c.case_id, count(*) AS n FROM fit_crop c JOIN fit_mask m ON m.case_id = c.case_id AND m.z >= w_z0
    AND m.z < w_z0 + wide_z AND m.y >= w_y0 AND m.y < w_y0 + wide_y AND m.x >= w_x0 AND m.x < w_x0 + wide_x GROUP BY 1) k ON k.case_id = c.case_id""")
def bbox_fit_crop(spark, d):
    plan, mask = _fit(spark, d)
    out = plans.bbox_fit_crop(plan, mask, *_FIT)
    out = out.withColumns({e: F.round(e, 5) for e in geo.ENDS})
    return rounded(out.drop("slice", "nz", "ny", "nx"))


@query("bbox_fit_lines")
def bbox_fit_lines(spark, d):
    target = fx.scan_mask(spark, d)
    plan = plans.bbox_fit_plan(scan_prompts(spark, d), target, (3, 3, 3), (0, 1, 1))
    crop = plans.bbox_fit_crop(plan, plans.bbox_fit_mask(target, plan), (3, 3, 3), (0, 1, 1))
    return voxels(plans.bbox_fit_lines(fx.scanlines(spark, d), plan, crop, (3, 3, 3)))


_KINDS = ["mixed_prompt_base", "mixed_prompt_multifov", "mixed_recist_bbox_fit_tail"]


@query("aux_crop")
def aux_crop(spark, d):
    labels, prompts, target = fx.gt(spark, d), _spaced_prompts(spark, d), label_target(spark, d)
    kinds = prompts.select("case_id", F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("prompt") % 3 + 1).cast("int")).alias("crop_kind"))
    fit = plans.bbox_fit_plan(prompts, target, *_FIT)
    fitted = plans.bbox_fit_crop(fit, plans.bbox_fit_mask(target, fit), *_FIT)
    wide = plans.multifov_windows(prompts, *_FOV)
    return plans.aux_labels_for_crop(labels, kinds, geo.crop_window(prompts, _FIT[0]), wide, fit, fitted, _FIT[0])


# ---- zoom arithmetic ------------------------------------------------------------------------------------------------------

def _zoom_rows(spark, d):
    return fx.lesions(spark, d).selectExpr(
        "case_id", "lesion", "1 + rz / 4 AS zoom", "label > 1 AS triggered", "1 + ry / 8 AS candidate", "rx / 64 AS border", "if(rx = 5, null, 20 + 7 * rz) AS extent")


PARTS["zoom_rows"] = (["lesions"], "SELECT case_id, lesion, 1 + rz / 4 AS zoom, label > 1 AS triggered, 1 + ry / 8 AS candidate, rx / 64 AS border, CASE WHEN rx = 5 THEN NULL ELSE 20 + 7 * rz END AS extent FROM lesions")


@query("next_zoom", ["zoom_rows"], """SELECT case_id, lesion, round(least(CASE WHEN triggered THEN greatest(least(zoom * 1.25, 2), CASE WHEN border >= 0.05 THEN zoom * 1.25 * 1.25 ELSE 0 END, candidate) ELSE zoom END, 2), 6) AS fixed,
  round(least(CASE WHEN triggered THEN greatest(candidate, zoom * (1 + 0.25 * least(border / 0.05, 1))) ELSE zoom END, 2), 6) AS adaptive,
  round(CASE WHEN extent IS NULL THEN zoom ELSE least(greatest(zoom, (extent + 24 / 3) / 24), 2) END, 6) AS direct, CAST(ceil(24 * zoom) AS INT) AS size FROM zoom_rows""")
def next_zoom(spark, d):
    rows = _zoom_rows(spark, d)
    step = (F.col("zoom"), F.col("triggered"), 1.25, 2.0, F.col("candidate"), F.col("border"))
    return rounded(rows.select(
        "case_id", "lesion", geo.next_zoom(*step).alias("fixed"), geo.next_zoom(*step, mode="adaptive").alias("adaptive"),
        geo.candidate_zoom(F.col("zoom"), F.col("extent"), 24, 2.0).alias("direct"), geo.zoomed_size(24, F.col("zoom")).alias("size")))
