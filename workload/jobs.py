"""Queries over whole jobs: sweep, evaluation, assembly, cache plans, scoring, streams."""

from __future__ import annotations

import os

import numpy as np
from pyspark.sql import functions as F

from voxtally.operators import normalize as nm
from voxtally.operators import runs as rn
from voxtally.operators import scoring as sc
from voxtally.operators.components import mask_runs
from voxtally.plans import assemble as asm
from voxtally.plans import autozoom as az
from voxtally.plans import evaluate as ev
from voxtally.sources import cache as ca
from voxtally.sources import cache_store as cs
from voxtally.sources import files as fl
from voxtally.sources import volumes as vo
from voxtally.session import cut_lineage, shared_folder
from voxtally.streaming import status as st
from workload import fixtures as fx
from workload.dense import scan_prompts
from workload.oracle_parts import PARTS
from workload.registry import query, rounded

_LIST = ", ".join(f"({i}, {t}::DOUBLE)" for i, t in enumerate(fx.THRESHOLDS))
PARTS["sweep"] = ([], f"SELECT * FROM (VALUES {_LIST}) t(ord, threshold)")
PARTS["sweep_rows"] = (["sweep", "prob_voxels", "scattered_gt"], """SELECT case_id, ord, threshold, count(g.label) AS gt_voxels, count(*) FILTER (prob >= threshold AND g.label IS NOT NULL) AS tp, count(*) FILTER (prob >= threshold) AS pred_voxels
  FROM prob_voxels p FULL JOIN scattered_gt g USING (case_id, z, y, x), sweep GROUP BY 1, 2, 3""")


@query("threshold_cross", ["sweep_rows"], "SELECT * FROM sweep_rows")
def threshold_cross(spark, d):
    return ev.threshold_overlap(fx.prob_voxels(spark, d), fx.scattered_gt(spark, d), fx.THRESHOLDS)


# Sweep on the second label's voxels, so that thresholds change the score.
PARTS["sweep_cells"] = (["sweep", "prob_voxels", "scattered_gt"], """SELECT ord, case_id, side, z + dz AS z, y + dy AS y, x + dx AS x, sum(1 << (dz * 4 + dy * 2 + dx)) AS code FROM (
    SELECT ord, case_id, z, y, x, 0 AS side FROM scattered_gt, sweep WHERE label = 2 UNION ALL SELECT ord, case_id, z, y, x, 1 FROM prob_voxels, sweep WHERE prob >= threshold) m,
    range(0, 2) a(dz), range(0, 2) b(dy), range(0, 2) c(dx) GROUP BY ALL HAVING sum(1 << (dz * 4 + dy * 2 + dx)) < 255""")
PARTS["sweep_scores"] = (["sweep", "sweep_cells", "scattered_meta", "facets", "prob_voxels", "scattered_gt"], """
  SELECT ord, threshold, avg(dsc) AS val_dsc, avg(CASE WHEN dsc < 0.2 THEN 0 ELSE nsd END) AS val_nsd FROM (
    SELECT ord, threshold, case_id, 2 * count(*) FILTER (prob >= threshold AND g.label = 2) / (count(*) FILTER (g.label = 2) + count(*) FILTER (prob >= threshold)) AS dsc
    FROM prob_voxels p FULL JOIN scattered_gt g USING (case_id, z, y, x), sweep GROUP BY 1, 2, 3)
  JOIN (SELECT c.ord, c.case_id, sum(CASE WHEN n.z IS NOT NULL THEN area ELSE 0 END) / sum(area) AS nsd FROM sweep_cells c
    JOIN (SELECT case_id, code, sum(sqrt(pow(a / 8 * sy * sx, 2) + pow(b / 8 * sz * sx, 2) + pow(c / 8 * sz * sy, 2))) AS area FROM facets, scattered_meta GROUP BY 1, 2) a USING (case_id, code)
    LEFT JOIN (SELECT DISTINCT c.ord, c.case_id, 1 - c.side AS side, c.z + i AS z, c.y + j AS y, c.x + k AS x FROM sweep_cells c JOIN scattered_meta m USING (case_id), range(-2, 3) a(i), range(-2, 3) b(j), range(-2, 3) d(k)
      WHERE i*i*sz*sz + j*j*sy*sy + k*k*sx*sx <= 4) n USING (ord, case_id, side, z, y, x) GROUP BY 1, 2) USING (ord, case_id) GROUP BY 1, 2""")
_SCORES = "round(val_dsc, 6) AS val_dsc, round(val_nsd, 6) AS val_nsd, round(0.5 * (val_dsc + val_nsd), 6) AS val_score"


def _sweep(spark, d):
    return ev.threshold_sweep(fx.prob_voxels(spark, d), fx.scattered_gt(spark, d).where("label = 2"), fx.scattered_meta(spark, d), fx.THRESHOLDS)


@query("threshold_sweep", ["sweep_scores"], f"SELECT ord, threshold, {_SCORES} FROM sweep_scores")
def threshold_sweep(spark, d):
    return rounded(_sweep(spark, d))


@query("best_threshold", ["sweep_scores"], f"SELECT ord, threshold, {_SCORES} FROM sweep_scores ORDER BY val_dsc + val_nsd DESC, ord LIMIT 1")
def best_threshold(spark, d):
    return rounded(rn.best_threshold(_sweep(spark, d)))


@query("evaluate_cases", ["paired", "meta"], """SELECT case_id, round(2 * count(*) FILTER (g > 0 AND p > 0) / (count(*) FILTER (g > 0) + count(*) FILTER (p > 0)), 6) AS dsc, case_id % 7 / 2 AS seconds
  FROM paired GROUP BY 1""")
def evaluate_cases(spark, d):
    meta = fx.meta(spark, d)
    rows, _ = ev.evaluate_cases(fx.gt(spark, d), fx.pred(spark, d), meta, meta.selectExpr("case_id", "case_id % 7 / 2 AS seconds"))
    return rounded(rows.drop("nsd"))


# ---- assembly and cache ---------------------------------------------------------------------------------------------------

@query("assemble_cases", ["prompts", "gt_comp", "resolved"], """, cached AS (SELECT case_id, prompt FROM prompts WHERE label = 2)
  SELECT case_id, prompt, CASE WHEN c.prompt IS NOT NULL THEN 1 ELSE n END AS voxels, c.prompt IS NOT NULL AS from_cache FROM prompts p LEFT JOIN cached c USING (case_id, prompt)
    JOIN (SELECT r.case_id, r.prompt, count(*) AS n FROM resolved r JOIN gt_comp g ON g.case_id = r.case_id AND g.label = r.label AND (r.component_id IS NULL OR r.component_id = g.component_id) GROUP BY 1, 2) q USING (case_id, prompt)""")
def assemble_cases(spark, d):
    """The spacing is already the target's, so counts are the raw ones; one label is served from a cache of single voxels."""
    from workload.pointing import _records

    prompts = fx.prompts(spark, d)
    meta = fx.meta(spark, d).withColumn("sz", F.lit(1.0))
    held = prompts.where("label = 2")
    voxels = held.selectExpr("case_id", "prompt", "cast(az AS int) AS z", "cast(ay AS int) AS y", "cast(ax AS int) AS x")
    out = asm.assemble_cases(_records(spark, d), prompts, fx.gt(spark, d), meta, voxels, held, (1.0, 1.0, 1.0))
    counts = out.targets.groupBy("case_id", "prompt").agg(F.count(F.lit(1)).alias("voxels"))
    return counts.join(out.origin, ["case_id", "prompt"])


def _cache(spark, d):
    """Sources of judged documents; targets of the judged, good ones; one in eight documents' entries carries an old version."""
    labels = fx.table(spark, d, "labels")
    version = "if(doc_id % 8 = 5, 'old', '{}') AS cache_version"
    sources = labels.selectExpr("concat('s', doc_id) AS source_key", version.format(ca.SOURCE_VERSION))
    targets = labels.where("quality = 1").selectExpr(
        "concat('t', doc_id, if(toxic = 1, 'x', '')) AS target_key", "concat('s', doc_id) AS source_key", version.format(ca.TARGET_VERSION),
        "concat(doc_id, '_', substr(md5(cast(doc_id AS string)), 1, 16), '.npz') AS file_name", "doc_id AS case_id", "cast(1 + doc_id % 3 AS int) AS label", "1 AS component_id", "doc_id % 5 AS voxel_count")
    records = fx.table(spark, d, "documents").selectExpr(
        "doc_id AS ord", "doc_id AS case_id", "concat('t', doc_id) AS target_key", "concat('s', doc_id) AS source_key", "if(n_chars % 2 = 0, cast(1 + n_chars % 3 AS int), null) AS target_label_value",
        "cast(null AS int) AS target_component_id", "n_chars % 9 AS voxel_count")
    return records, sources, targets


PARTS["held"] = ([], "SELECT * FROM labels WHERE quality = 1 AND doc_id % 8 <> 5")


@query("cache_plan", ["held"], """SELECT doc_id AS case_id, CASE WHEN h IS NOT NULL THEN 'exists' WHEN n_chars % 9 <= 0 THEN 'empty_target' ELSE 'written' END AS status
  FROM documents d LEFT JOIN (SELECT doc_id AS h FROM held WHERE toxic = 0) ON h = doc_id""")
def cache_plan(spark, d):
    return ca.cache_plan(*_cache(spark, d)).select("case_id", "status")


@query("missing_sources", ["held"], """SELECT 's' || doc_id AS source_key FROM documents WHERE n_chars % 9 > 0 AND doc_id NOT IN (SELECT doc_id FROM held WHERE toxic = 0)
  AND doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id % 8 <> 5)""")
def missing_sources(spark, d):
    records, sources, targets = _cache(spark, d)
    return ca.missing_sources(ca.cache_plan(records, sources, targets), sources)


@query("cache_lookup", ["held"], """SELECT d.doc_id AS case_id, CASE WHEN h.doc_id IS NULL THEN NULL WHEN toxic = 0 THEN 't' || d.doc_id ELSE 't' || d.doc_id || 'x' END AS entry_key, CASE WHEN h.doc_id IS NOT NULL THEN toxic = 1 END AS used_fallback
  FROM documents d LEFT JOIN held h ON h.doc_id = d.doc_id AND (toxic = 0 OR (d.doc_id % 5 > 0 AND (n_chars % 2 <> 0 OR 1 + n_chars % 3 = 1 + d.doc_id % 3)))""")
def cache_lookup(spark, d):
    return ca.cache_lookup(*_cache(spark, d)).select("case_id", "entry_key", "used_fallback")


@query("cache_store", [], """SELECT sha256('t' || doc_id) AS target_key, sha256('s' || doc_id) AS source_key, doc_id AS case_id, toxic = 1 AS from_first_write, 0 AS again
  FROM labels WHERE quality = 1""")
def cache_store(spark, d):
    """Stores entries twice, part and whole, then once more for nothing, and reads every one back by its key."""
    path = cs.create_store(spark, f"{shared_folder(spark)}/cache-{os.urandom(6).hex()}")
    good = fx.table(spark, d, "labels").where("quality = 1")
    entries = good.selectExpr("sha2(concat('t', doc_id), 256) AS target_key", "sha2(concat('s', doc_id), 256) AS source_key", "doc_id AS case_id")
    first = cs.store_entries(entries.join(good.where("toxic = 1").selectExpr("doc_id AS case_id"), "case_id", "left_semi").select(*entries.columns), path, "target_key")
    second, again = cs.store_entries(entries, path, "target_key"), cs.store_entries(entries, path, "target_key")
    runs = cs.marks(spark, path).where(F.col("entries").isin([n for n in (first, second) if n])).count()
    found = cs.lookup_entries(entries.select("target_key"), path, entries.schema, "target_key")
    toxic = good.selectExpr("doc_id AS case_id", "toxic = 1 AS from_first_write")
    return found.select("entry.*").join(toxic, "case_id").select("target_key", "source_key", "case_id", "from_first_write", F.lit(again if runs == (first > 0) + (second > 0) else -1).alias("again"))


@query("file_fingerprint", ["manifest", "file_listing"], """SELECT DISTINCT image_path AS path, length AS size, seconds * 1000000 AS mtime_us, length IS NULL AS missing FROM manifest m LEFT JOIN file_listing f ON f.path = m.image_path""")
def file_fingerprint(spark, d):
    wanted = fx.manifest(spark, d).select(F.col("image_path").alias("path")).distinct()
    return fl.fingerprints(wanted, fx.file_listing(spark, d))


@query("case_log_roundtrip", ["case_log"], "SELECT status, count(*) AS cases, count(dsc) AS scored, round(sum(total_seconds), 4) AS seconds FROM case_log GROUP BY 1")
def case_log_roundtrip(spark, d):
    return _logged(spark, d)[0].groupBy("status").agg(F.count(F.lit(1)).alias("cases"), F.count("dsc").alias("scored"), F.round(F.sum("total_seconds"), 4).alias("seconds"))


def _logged(spark, d):
    folder = f"{shared_folder(spark)}/log-{os.urandom(6).hex()}"
    log = fx.case_log(spark, d).withColumn("case_id", F.col("case_id").cast("string"))
    fl.write_case_log(spark.range(1).select(F.lit(0.35).alias("threshold")), log, rn.run_summary(log), folder)
    return fl.scan_case_log(spark, folder), folder


@query("stream_run_status", ["case_log"], "SELECT status, count(*) AS cases FROM case_log GROUP BY 1")
def stream_run_status(spark, d):
    folder = _logged(spark, d)[1]
    name = f"run_status_{os.urandom(4).hex()}"
    running = st.start_run_status(spark, folder, name, folder + "-state")
    running.awaitTermination()
    return spark.table(name)


# ---- volumes in files --------------------------------------------------------------------------------------------------------

@query("nifti_roundtrip", ["gt", "meta"], """SELECT case_id, label, voxels, at_z, at_y, at_x, sz, sy, sx FROM (SELECT case_id, label, count(*) AS voxels, sum(z)::BIGINT AS at_z, sum(y)::BIGINT AS at_y, sum(x)::BIGINT AS at_x
  FROM gt GROUP BY 1, 2) JOIN meta USING (case_id)""")
def nifti_roundtrip(spark, d):
    """Label files of all cases, written to the shared folder and scanned back."""
    folder = f"{shared_folder(spark).removeprefix('file://').removeprefix('file:')}/labels-{os.urandom(6).hex()}"
    os.makedirs(folder)
    meta = fx.meta(spark, d).withColumns({"direction": F.lit(None).cast("array<double>"), "origin": F.lit(None).cast("array<double>")})
    vo.export_predictions(mask_runs(fx.gt(spark, d)), meta, folder, "nii").count()
    rows = cut_lineage(vo.scan_nifti(spark, folder, "mask"))
    n = F.expr("cast(x1 - x0 + 1 AS bigint)")
    sums = rows.where("kind = 'mask'").groupBy(F.col("case_id").cast("long").alias("case_id"), "label").agg(
        F.sum(n).alias("voxels"), F.sum(n * F.col("z")).alias("at_z"), F.sum(n * F.col("y")).alias("at_y"), F.sum(F.expr("cast((x0 + x1) * (x1 - x0 + 1) div 2 AS bigint)")).alias("at_x"))
    heads = rows.where("kind = 'meta'").select(F.col("case_id").cast("long").alias("case_id"), *[F.col("spacing_xyz")[k].cast("double").alias(c) for k, c in enumerate(("sx", "sy", "sz"))])
    return sums.join(heads, "case_id")


# ---- scoring ----------------------------------------------------------------------------------------------------------------

def bright_near_prompt(channels: np.ndarray) -> np.ndarray:
    """A stand-in for a user's model: bright voxels near the prompt."""
    return 2.0 * channels[0] + channels[1] + channels[2] - 1.0



@query("score_crops")
def score_crops(spark, d):
    lines, prompts = fx.scanlines(spark, d), scan_prompts(spark, d)
    channels = sc.input_channels(lines, prompts, "dataset_stats", nm.normalization_stats(lines))
    return rounded(sc.score_crops(channels, bright_near_prompt).select("case_id", "z", "y", F.posexplode("vals").alias("x", "prob")))


_ZOOM = az.Settings(crop_zyx=(2, 3, 3), threshold=0.5, max_passes=3, growth_zyx=(1.5, 1.25, 1.25), base_abs=1, base_min=0, ref_patch_zyx=(2, 3, 3), refine=True, refine_margin_zyx=(0, 0, 0))


@query("autozoom")
def autozoom(spark, d):
    lines = fx.scanlines(spark, d)
    return az.autozoom(lines, scan_prompts(spark, d), bright_near_prompt, nm.normalization_stats(lines), _ZOOM)[0]


@query("autozoom_trace")
def autozoom_trace(spark, d):
    lines = fx.scanlines(spark, d)
    settings = az.Settings(crop_zyx=(2, 3, 3), threshold=0.5, max_passes=2, ref_patch_zyx=(2, 3, 3), base_abs=1, base_min=0)
    return rounded(az.autozoom(lines, scan_prompts(spark, d), bright_near_prompt, nm.normalization_stats(lines), settings)[1])
