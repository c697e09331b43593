"""Queries over masks: overlap, components, surfaces."""

from __future__ import annotations

from voxtally.operators import components as cc
from voxtally.operators import overlap as ov
from voxtally.operators import surface as sf
from workload import fixtures as fx
from workload.registry import query, rounded

# ---- overlap ----------------------------------------------------------------------------------------------------------

@query("labeled_metrics", ["label_scores", "meta"], """
  SELECT m.case_id, round(coalesce(avg(dsc), 1), 6) AS dsc, round(coalesce(avg(nsd), 1), 6) AS nsd, count(label) AS lesion_count
  FROM meta m LEFT JOIN label_scores s ON s.case_id = m.case_id GROUP BY 1""")
def labeled_metrics(spark, d):
    meta = fx.meta(spark, d)
    scores = sf.label_metrics(fx.gt(spark, d), fx.pred(spark, d), meta)
    return rounded(ov.case_means(scores, meta, ["dsc", "nsd"]))


@query("label_metrics", ["label_scores"], "SELECT case_id, label, round(dsc, 6) AS dsc, round(nsd, 6) AS nsd, gt_voxels, pred_voxels FROM label_scores")
def label_metrics(spark, d):
    return rounded(sf.label_metrics(fx.gt(spark, d), fx.pred(spark, d), fx.meta(spark, d)))


@query("cohort_score", ["label_scores"], """
  SELECT round(avg(dsc), 6) AS val_dsc, round(avg(nsd), 6) AS val_nsd, round(0.5 * (avg(dsc) + avg(nsd)), 6) AS val_score
  FROM (SELECT case_id, avg(dsc) AS dsc, avg(nsd) AS nsd FROM label_scores GROUP BY 1)""")
def cohort_score(spark, d):
    meta = fx.meta(spark, d)
    scores = sf.label_metrics(fx.gt(spark, d), fx.pred(spark, d), meta)
    return rounded(ov.cohort_score(ov.case_means(scores, meta, ["dsc", "nsd"])))


@query("overlap_count", ["paired"], "SELECT case_id, count(*) FILTER (g > 0 AND p > 0) AS overlap FROM paired GROUP BY 1")
def overlap_count(spark, d):
    return ov.overlap_count(fx.gt(spark, d), fx.pred(spark, d))


@query("confusion_join", ["paired"], """SELECT case_id, count(*) FILTER (g > 0 AND p > 0) AS tp, count(*) FILTER (g = 0) AS fp,
  count(*) FILTER (p = 0) AS fn FROM paired GROUP BY 1""")
def confusion_join(spark, d):
    return ov.confusion(fx.gt(spark, d), fx.pred(spark, d))


@query("dice", ["paired"], """SELECT case_id, round(2 * count(*) FILTER (g > 0 AND p > 0) / (count(*) FILTER (g > 0) + count(*) FILTER (p > 0)), 6) AS dsc
  FROM paired GROUP BY 1""")
def dice(spark, d):
    return rounded(ov.dice(fx.gt(spark, d), fx.pred(spark, d)))


@query("label_dice", ["label_dice"], "SELECT case_id, label, round(dsc, 6) AS dsc, gt_voxels, pred_voxels FROM label_dice")
def label_dice(spark, d):
    return rounded(ov.label_dice(fx.gt(spark, d), fx.pred(spark, d)))


@query("prompt_label_dice", ["label_dice", "case_prompts"], """SELECT case_id, label, round(coalesce(dsc, 1), 6) AS dsc, coalesce(gt_voxels, 0) AS gt_voxels,
  coalesce(pred_voxels, 0) AS pred_voxels FROM case_prompts LEFT JOIN label_dice USING (case_id, label)""")
def prompt_label_dice(spark, d):
    return rounded(ov.label_dice(fx.gt(spark, d), fx.pred(spark, d), fx.case_prompts(spark, d)))


_BINARY = """CASE WHEN gt + pr = 0 THEN 1 ELSE 2 * tp / (gt + pr) END AS dsc,
  CASE WHEN gt > 0 THEN tp / gt WHEN pr = 0 THEN 1 ELSE 0 END AS recall, CASE WHEN pr > 0 THEN tp / pr WHEN gt = 0 THEN 1 ELSE 0 END AS precision,
  pr / size AS pred_positive_fraction"""


@query("binary_stats", ["paired", "meta"], f"""SELECT case_id, round(dsc, 6) AS dsc, round(recall, 6) AS recall, round(precision, 6) AS precision,
  round(pred_positive_fraction, 6) AS pred_positive_fraction, gt AS gt_positive_voxels, pr AS pred_positive_voxels, tp AS tp_voxels,
  pr - tp AS fp_voxels, gt - tp AS fn_voxels FROM (SELECT *, {_BINARY} FROM (
  SELECT m.case_id, nz * ny * nx AS size, count(*) FILTER (g > 0 AND p > 0) AS tp, count(*) FILTER (g > 0) AS gt, count(*) FILTER (p > 0) AS pr
  FROM meta m LEFT JOIN paired p ON p.case_id = m.case_id GROUP BY 1, 2))""")
def binary_stats(spark, d):
    return rounded(ov.binary_stats(fx.gt(spark, d), fx.pred(spark, d), fx.meta(spark, d)))


for _name, _rule in {
    "mask_union": "", "mask_intersection": "WHERE g > 0 AND p > 0", "mask_difference": "WHERE g > 0 AND p = 0",
    "mask_symmetric_difference": "WHERE (g > 0) <> (p > 0)",
}.items():
    query(_name, ["paired"], f"SELECT case_id, z, y, x FROM paired {_rule}")(
        lambda spark, d, _op=getattr(ov, _name): _op(fx.gt(spark, d), fx.pred(spark, d))
    )


@query("union_bbox", ["paired"], """SELECT case_id, min(z) AS z_min, min(y) AS y_min, min(x) AS x_min, max(z) + 1 AS z_max, max(y) + 1 AS y_max,
  max(x) + 1 AS x_max FROM paired GROUP BY 1""")
def union_bbox(spark, d):
    return ov.union_bbox(fx.gt(spark, d), fx.pred(spark, d))


@query("label_set_union", ["gt", "pred"], "SELECT case_id, label FROM gt UNION SELECT case_id, label FROM pred")
def label_set_union(spark, d):
    return ov.label_set_union(fx.gt(spark, d), fx.pred(spark, d))


@query("binarize", ["prob_voxels"], "SELECT case_id, z, y, x, 1 AS label FROM prob_voxels WHERE prob >= 0.35")
def binarize(spark, d):
    return ov.binarize(fx.prob_voxels(spark, d), 0.35)


# ---- components -------------------------------------------------------------------------------------------------------

@query("connected_components", ["gt_comp"], "SELECT * FROM gt_comp")
def connected_components(spark, d):
    return cc.connected_components(fx.gt(spark, d))


@query("connected_components_slabs", ["scat_comp"], "SELECT * FROM scat_comp")
def connected_components_slabs(spark, d):
    return cc.connected_components(fx.scattered_gt(spark, d), slab_depth=2)


@query("run_adjacency", ["gt"], """, r AS (SELECT case_id, label, z, y, min(x) AS x0, max(x) AS x1 FROM (
    SELECT *, x - row_number() OVER (PARTITION BY case_id, label, z, y ORDER BY x) AS island FROM gt) GROUP BY case_id, label, z, y, island)
  SELECT a.case_id, a.label, a.z, a.y, a.x0, a.x1, b.z AS bz, b.y AS "by", b.x0 AS b0, b.x1 AS b1 FROM r a JOIN r b
  ON a.case_id = b.case_id AND a.label = b.label AND ((b.z = a.z AND b.y = a.y + 1) OR (b.z = a.z + 1 AND b.y = a.y))
  AND a.x0 <= b.x1 AND b.x0 <= a.x1""")
def run_adjacency(spark, d):
    return cc.run_adjacency(cc.mask_runs(fx.gt(spark, d)))


_STATS = "case_id, label, component_id, voxel_count, z_min, y_min, x_min, z_max, y_max, x_max, round(cz, 6) AS cz, round(cy, 6) AS cy, round(cx, 6) AS cx, slice_index, peak_area"


@query("component_stats", ["gt_comp_stats"], f"SELECT {_STATS} FROM gt_comp_stats")
def component_stats(spark, d):
    return rounded(cc.component_stats(cc.component_runs(fx.gt(spark, d))))


@query("component_stats_scattered", ["scat_comp_stats"], f"SELECT {_STATS} FROM scat_comp_stats WHERE voxel_count >= 2")
def component_stats_scattered(spark, d):
    return rounded(cc.component_stats(cc.component_runs(fx.scattered_gt(spark, d), slab_depth=3), min_voxels=2))


@query("slice_area", ["gt"], "SELECT case_id, label, z, count(*) AS area FROM gt GROUP BY 1, 2, 3")
def slice_area(spark, d):
    return cc.slice_areas(fx.gt(spark, d))


@query("peak_slice", ["gt"], """SELECT case_id, label, z, area FROM (SELECT *, row_number() OVER (PARTITION BY case_id, label ORDER BY area DESC, z) AS rn
  FROM (SELECT case_id, label, z, count(*) AS area FROM gt GROUP BY 1, 2, 3)) WHERE rn = 1""")
def peak_slice(spark, d):
    return cc.peak_slice(fx.gt(spark, d))


@query("largest_component", ["gt_comp_stats"], """SELECT case_id, label, component_id, voxel_count, peak_area FROM (SELECT *, row_number() OVER (
  PARTITION BY case_id ORDER BY voxel_count DESC, peak_area DESC, label, component_id) AS rn FROM gt_comp_stats) WHERE rn = 1""")
def largest_component(spark, d):
    return cc.largest_component(cc.component_stats(cc.component_runs(fx.gt(spark, d))))


@query("rank_instances", ["gt_comp_stats"], """SELECT case_id, label, component_id, voxel_count, round(cz, 6) AS cz, round(cy, 6) AS cy, round(cx, 6) AS cx,
  slice_index FROM gt_comp_stats ORDER BY case_id, voxel_count DESC, slice_index, label, component_id""")
def rank_instances(spark, d):
    return rounded(cc.rank_instances(cc.component_stats(cc.component_runs(fx.gt(spark, d)))))


@query("select_manifest_target", ["gt_comp", "case_prompts"], """SELECT g.case_id, g.label, z, y, x, component_id FROM gt_comp g
  JOIN case_prompts p ON p.case_id = g.case_id AND p.label = g.label AND g.component_id = 1 + p.prompt % 4""")
def select_manifest_target(spark, d):
    wanted = fx.case_prompts(spark, d).selectExpr("case_id", "label", "1 + prompt % 4 AS component_id")
    return cc.select_components(cc.component_runs(fx.gt(spark, d)), wanted)


# ---- surfaces ---------------------------------------------------------------------------------------------------------

@query("surface_dice", ["within"], "SELECT case_id, label, round(sum(near_area) / sum(area), 6) AS nsd FROM within GROUP BY 1, 2")
def surface_dice(spark, d):
    return rounded(sf.surface_dice(fx.gt(spark, d), fx.pred(spark, d), fx.meta(spark, d)))


@query("surface_overlap", ["within"], """SELECT case_id, label, round(max(near_area / area) FILTER (side = 0), 6) AS overlap_gt,
  round(max(near_area / area) FILTER (side = 1), 6) AS overlap_pred FROM within GROUP BY 1, 2""")
def surface_overlap(spark, d):
    return rounded(sf.surface_overlap(fx.gt(spark, d), fx.pred(spark, d), fx.meta(spark, d)))


@query("within_tolerance", ["within"], "SELECT case_id, label, side, round(area, 6) AS area, round(near_area, 6) AS near_area FROM within")
def within_tolerance(spark, d):
    return rounded(sf.surface_within(fx.gt(spark, d), fx.pred(spark, d), fx.meta(spark, d)))


@query("area_lookup", ["areas"], "SELECT case_id, code, round(area, 6) AS area FROM areas")
def area_lookup(spark, d):
    codes = fx.meta(spark, d).selectExpr("case_id", "explode(sequence(1, 254)) AS code")
    return rounded(sf._areas(codes, sf._spacing(fx.meta(spark, d))))


@query("nearest_border_distance", ["cells", "meta"], """SELECT case_id, label, side, code, round(d2, 6) AS d2, count(*) AS n FROM (
  SELECT a.case_id, a.label, a.side, a.code, min(pow((a.z - b.z) * sz, 2) + pow((a.y - b.y) * sy, 2) + pow((a.x - b.x) * sx, 2)) AS d2
  FROM cells a JOIN cells b ON a.case_id = b.case_id AND a.label = b.label AND b.side = 1 - a.side JOIN meta m ON m.case_id = a.case_id
  GROUP BY a.case_id, a.label, a.side, a.code, a.z, a.y, a.x) GROUP BY ALL""")
def nearest_border_distance(spark, d):
    return rounded(sf.border_distances(fx.gt(spark, d), fx.pred(spark, d), fx.meta(spark, d)))


_DIST = """, dist AS MATERIALIZED (SELECT case_id, label, side, code, sqrt(d2) AS d, area FROM (
  SELECT a.case_id, a.label, a.side, a.code, min(pow((a.z - b.z) * sz, 2) + pow((a.y - b.y) * sy, 2) + pow((a.x - b.x) * sx, 2)) AS d2
  FROM cells a JOIN cells b ON a.case_id = b.case_id AND a.label = b.label AND b.side = 1 - a.side JOIN meta m ON m.case_id = a.case_id
  GROUP BY a.case_id, a.label, a.side, a.code, a.z, a.y, a.x) JOIN areas USING (case_id, code)) """


@query("average_surface_distance", ["cells", "meta", "areas"], _DIST + """SELECT case_id, label,
  round(sum(d * area) FILTER (side = 0) / sum(area) FILTER (side = 0), 6) AS gt_to_pred,
  round(sum(d * area) FILTER (side = 1) / sum(area) FILTER (side = 1), 6) AS pred_to_gt FROM dist GROUP BY 1, 2""")
def average_surface_distance(spark, d):
    return rounded(sf.average_surface_distance(sf.weighted_distances(fx.gt(spark, d), fx.pred(spark, d), fx.meta(spark, d))))


@query("robust_hausdorff", ["cells", "meta", "areas"], _DIST + """SELECT case_id, label, round(max(h), 6) AS hausdorff FROM (
  SELECT case_id, label, side, min(d) FILTER (share >= 0.95) AS h FROM (
    SELECT *, sum(area) OVER (PARTITION BY case_id, label, side ORDER BY d) / sum(area) OVER (PARTITION BY case_id, label, side) AS share FROM dist)
  GROUP BY 1, 2, 3) GROUP BY 1, 2""")
def robust_hausdorff(spark, d):
    return rounded(sf.robust_hausdorff(sf.weighted_distances(fx.gt(spark, d), fx.pred(spark, d), fx.meta(spark, d))))
