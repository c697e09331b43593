"""Queries over case tables, run logs, losses and sampling plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxtally.functions import geometry as geo
from voxtally.functions import text as tx
from voxtally.operators import cases as cs
from voxtally.operators import components as cc
from voxtally.operators import losses as ls
from voxtally.operators import runs as rn
from voxtally.operators import sampling as sm
from voxtally.operators import targets as tg
from voxtally.operators import validation as va
from workload import fixtures as fx
from workload.oracle_parts import PARTS
from workload.registry import query, rounded

# ---- case tables --------------------------------------------------------------------------------------------------------


@query("split_records", ["manifest"], "SELECT * FROM manifest WHERE split = 'train'")
def split_records(spark, d):
    return cs.split_records(fx.manifest(spark, d), "train")


@query("limit_records", ["manifest"], "SELECT * FROM manifest ORDER BY ord LIMIT 100")
def limit_records(spark, d):
    return cs.limit_records(fx.manifest(spark, d), 100)


@query("filter_available", ["manifest", "file_listing"], "SELECT * FROM manifest WHERE image_path IN (SELECT path FROM file_listing)")
def filter_available(spark, d):
    return cs.filter_available(fx.manifest(spark, d), fx.file_listing(spark, d))


@query("availability_report", ["manifest", "file_listing"], """SELECT source, count(*) AS input_records, count(f.path) AS available_records, count(*) - count(f.path) AS skipped_missing_records
  FROM manifest m LEFT JOIN file_listing f ON f.path = m.image_path GROUP BY 1""")
def availability_report(spark, d):
    return cs.availability_report(fx.manifest(spark, d), fx.file_listing(spark, d))


_STATUS = """SELECT *, target_voxel_count AS voxels, CASE WHEN target_voxel_count IS NULL THEN 'missing_target_mask' WHEN target_voxel_count = 0 THEN 'empty_target_mask' END AS empty_reason FROM manifest"""


@query("filter_empty_targets", ["manifest"], f"SELECT * FROM ({_STATUS}) WHERE empty_reason IS NULL")
def filter_empty_targets(spark, d):
    return cs.filter_empty_targets(cs.with_target_status(fx.manifest(spark, d)))


@query("empty_target_rows", ["manifest"], f"SELECT case_id, split, coalesce(voxels, 0) AS selected_target_voxels, empty_reason AS reason FROM ({_STATUS}) WHERE empty_reason IS NOT NULL")
def empty_target_rows(spark, d):
    return cs.empty_target_rows(cs.with_target_status(fx.manifest(spark, d)))


@query("empty_target_audit", ["manifest"], f"""SELECT count(*) AS input_train_case_count, count(*) FILTER (empty_reason IS NULL) AS kept_train_case_count,
  count(*) FILTER (empty_reason IS NULL) AS nonempty_target_case_count, count(empty_reason) AS empty_or_missing_target_case_count,
  count(*) FILTER (voxels IS NULL) AS missing_target_case_count FROM ({_STATUS})""")
def empty_target_audit(spark, d):
    return cs.empty_target_audit(cs.with_target_status(fx.manifest(spark, d)))


@query("val_fallback", ["manifest"], """, val AS (SELECT * FROM manifest WHERE split = 'val' AND source = 'none')
  SELECT * FROM val UNION ALL (SELECT * FROM manifest WHERE split = 'train' AND NOT EXISTS (SELECT 1 FROM val) ORDER BY ord LIMIT 2)""")
def val_fallback(spark, d):
    manifest = fx.manifest(spark, d)
    return cs.val_fallback(cs.split_records(manifest, "train"), cs.split_records(manifest, "val").where("source = 'none'"))


@query("train_val_union", ["manifest"], "SELECT * FROM manifest")
def train_val_union(spark, d):
    manifest = fx.manifest(spark, d)
    return cs.split_records(manifest, "train").unionByName(cs.split_records(manifest, "val"))


PARTS["deduped"] = (["manifest"], "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY case_id, image_path, split ORDER BY ord) AS rn FROM manifest) WHERE rn = 1")


@query("dedupe_records", ["deduped"], "SELECT * FROM deduped")
def dedupe_records(spark, d):
    return cs.dedupe_records(fx.manifest(spark, d))


@query("config_drift", [], """SELECT n_name AS field, n_regionkey AS saved_value, n_regionkey + CASE WHEN n_regionkey % 2 = 0 THEN 1 ELSE 0 END AS current_value FROM nation
  WHERE n_regionkey % 2 = 0""")
def config_drift(spark, d):
    nation = fx.table(spark, d, "nation")
    saved = nation.selectExpr("n_name AS field", "n_regionkey AS value")
    return cs.config_drift(saved, nation.selectExpr("n_name AS field", "n_regionkey + if(n_regionkey % 2 = 0, 1, 0) AS value"))


@query("availability_of_organs", [], """, classes AS (SELECT n_nationkey AS class_id, CASE WHEN n_nationkey > 0 THEN lower(n_name) END AS segmentation FROM nation),
  files AS (SELECT DISTINCT 'case' || (l_orderkey // 10) || '/segmentations/' || lower('NATION_' || (l_suppkey % 25)) || CASE WHEN l_returnflag = 'R' THEN '.nii' ELSE '.nii.gz' END AS path FROM lineitem),
  w AS (SELECT o.case_id, segmentation, max(CASE WHEN f.path IS NULL THEN 0 ELSE 1 END) AS found FROM (SELECT DISTINCT o_orderkey // 10 AS case_id FROM orders) o,
    (SELECT * FROM classes WHERE segmentation IS NOT NULL) c, (VALUES ('.nii.gz'), ('.nii')) e(ending)
    LEFT JOIN files f ON f.path = 'case' || o.case_id || '/segmentations/' || segmentation || ending GROUP BY 1, 2)
  SELECT case_id, list_sort(coalesce(list(segmentation) FILTER (found = 1), [])) AS loaded_segmentations, list_sort(coalesce(list(segmentation) FILTER (found = 0), [])) AS missing_segmentations,
    min(found) = 1 AS aux_background_is_valid FROM w GROUP BY 1""")
def availability_of_organs(spark, d):
    cases = fx.lesions(spark, d).select("case_id").distinct().withColumn("label_dir", F.concat(F.lit("case"), "case_id"))
    classes = fx.table(spark, d, "nation").selectExpr("n_nationkey AS class_id", "if(n_nationkey > 0, lower(n_name), null) AS segmentation")
    files = fx.table(spark, d, "lineitem").selectExpr(
        "concat('case', l_orderkey div 10, '/segmentations/', lower(concat('NATION_', l_suppkey % 25)), if(l_returnflag = 'R', '.nii', '.nii.gz')) AS path").distinct()
    return cs.organ_availability(cases, classes, files)


@query("ingest_organ_labels", ["aux_voxels"], """SELECT case_id, z, y, x, 1 AS label, name FROM (SELECT *, CASE WHEN case_id % 2 = 0 THEN 'combined_labels.nii.gz' ELSE 'lesion.nii.gz' END AS name
  FROM aux_voxels) WHERE CASE WHEN name = 'combined_labels.nii.gz' THEN class_id = 28 ELSE class_id > 0 END""")
def ingest_organ_labels(spark, d):
    labels = fx.aux_voxels(spark, d).withColumnRenamed("class_id", "label").withColumn(
        "name", F.when(F.col("case_id") % 2 == 0, "combined_labels.nii.gz").otherwise("lesion.nii.gz"))
    return cs.lesion_label(labels, F.col("name"))


def _summary_sql(source: str, measure: str) -> str:
    return f"""SELECT '{measure}' AS measure, count({measure}) AS count, coalesce(min({measure}), 0)::DOUBLE AS min, coalesce(max({measure}), 0)::DOUBLE AS max,
      round(coalesce(avg({measure}), 0), 6) AS mean, round(coalesce(quantile_cont({measure}::DOUBLE, 0.5), 0), 6) AS median FROM {source}"""


@query("summarize", ["manifest"], _summary_sql("manifest", "target_voxel_count"))
def summarize(spark, d):
    return rounded(cs.summarize(fx.manifest(spark, d), "target_voxel_count"))


# Records of the ellipsoid cases; one in ten named by its manifest, some certified empty.
PARTS["audit_records"] = (["case_prompts"], """SELECT case_id AS ord, case_id, 'images/' || case_id AS image_path, CASE WHEN prompt < 5 THEN 'train' ELSE 'val' END AS split,
  CASE WHEN prompt = 3 THEN 0 WHEN prompt = 4 THEN 40 + case_id % 50 END AS target_voxel_count, CASE WHEN prompt IN (3, 4) THEN label END AS target_label_value FROM case_prompts""")
PARTS["audit"] = (["audit_records", "instances", "gt_comp", "case_prompts"], """SELECT case_id, split, CASE WHEN missing THEN 'missing_mask' WHEN certified THEN 'manifest_target_label' ELSE selection_mode END AS selection_mode,
    CASE WHEN missing OR certified THEN false ELSE selection_mode = 'nearest_component_fallback' END AS used_fallback,
    CASE WHEN missing THEN 0 WHEN certified THEN 1 ELSE components END AS component_count, CASE WHEN missing THEN 0 WHEN certified THEN target_voxel_count ELSE positive END AS all_positive_voxels,
    CASE WHEN missing THEN 0 WHEN certified THEN target_voxel_count ELSE voxel_count END AS selected_target_voxels, CASE WHEN missing THEN NULL WHEN certified THEN target_label_value ELSE label END AS selected_label_value,
    CASE WHEN missing THEN 0.0::DOUBLE WHEN certified THEN 1.0::DOUBLE ELSE voxel_count / positive END AS selected_fraction_of_all_positive
  FROM (SELECT r.*, i.selection_mode, i.label, i.voxel_count, f.components, f.positive, coalesce(target_voxel_count <= 0, false) AS missing, target_voxel_count > 0 AS certified
    FROM audit_records r JOIN case_prompts p USING (case_id) JOIN instances i ON i.case_id = r.case_id AND i.prompt = p.prompt
    JOIN (SELECT case_id, count(DISTINCT (label, component_id)) AS components, count(*) AS positive FROM gt_comp GROUP BY 1) f ON f.case_id = r.case_id)""")


def _audit(spark, d):
    prompts = fx.prompts(spark, d).join(fx.case_prompts(spark, d).select("case_id", "prompt"), ["case_id", "prompt"], "left_semi")
    runs = cc.component_runs(fx.gt(spark, d))
    records = prompts.selectExpr(
        "case_id AS ord", "case_id", "concat('images/', case_id) AS image_path", "if(prompt < 5, 'train', 'val') AS split",
        "case when prompt = 3 then 0L when prompt = 4 then 40 + case_id % 50 end AS target_voxel_count", "if(prompt in (3, 4), label, null) AS target_label_value")
    facts = cc.component_stats(runs).groupBy("case_id").agg(F.count(F.lit(1)).alias("component_count"), F.sum("voxel_count").alias("all_positive_voxels"))
    return cs.audit_rows(records, facts, tg.select_target_instance(prompts, runs))


@query("target_audit", ["audit"], "SELECT * REPLACE (round(selected_fraction_of_all_positive, 6) AS selected_fraction_of_all_positive) FROM audit")
def target_audit(spark, d):
    return rounded(_audit(spark, d))


@query("target_audit_summary", ["audit"], """SELECT count(*) AS case_count, count(*) FILTER (component_count > 1) AS multi_component_case_count,
  round(count(*) FILTER (component_count > 1) / count(*), 6) AS multi_component_case_fraction, count(*) FILTER (selection_mode = 'direct_endpoint_label_hit') AS direct_endpoint_selection_count,
  count(*) FILTER (used_fallback) AS fallback_selection_count FROM audit""")
def target_audit_summary(spark, d):
    return rounded(cs.audit_summary(_audit(spark, d)))


@query("target_audit_counts", ["audit"], """SELECT 'split' AS kind, split AS value, count(*) AS cases FROM audit GROUP BY 2 UNION ALL
  SELECT 'selection_mode', selection_mode, count(*) FROM audit WHERE selection_mode <> 'missing_mask' GROUP BY 2""")
def target_audit_counts(spark, d):
    return cs.audit_counts(_audit(spark, d))


@query("target_audit_measures", ["audit"], " UNION ALL ".join(_summary_sql("(SELECT * FROM audit WHERE selection_mode <> 'missing_mask')", m) for m in cs.AUDIT_MEASURES))
def target_audit_measures(spark, d):
    return rounded(cs.audit_measures(_audit(spark, d)))


# ---- integrity ----------------------------------------------------------------------------------------------------------

def _checked(spark, d):
    """Prompts pushed out of place by their order's price and a spacing that may be broken."""
    rows = fx.prompts(spark, d).selectExpr(
        "case_id * 10 + prompt AS case_id", "label", "ax", "ay", "az", "bx + 6 AS bx", "by", "bz", "slice + if(ax > 20 AND ay > 30, 2, 0) AS slice", "nz", "ny", "nx",
        "array(1D, if(ay > 38, 0D, 1D), 1D + az) AS spacing", "if(label = 3 AND ax < 10, 0, 12) AS target_voxels")
    return va.with_reasons(rows, [va.spacing_reason(F.col("spacing")), va.prompt_reason(), va.target_reason()])


PARTS["checked"] = (["prompts"], """SELECT case_id * 10 + prompt AS case_id, [r FOR r IN [CASE WHEN ay > 38 THEN 'spacing_xyz must be finite and positive' END,
    CASE WHEN bx + 6 > 49 THEN 'RECIST endpoints out of bounds' WHEN slice + s >= 24 THEN 'recist_slice_index out of bounds' WHEN s > 0 THEN 'recist_slice_index is inconsistent with endpoints' END,
    CASE WHEN label = 3 AND ax < 10 THEN 'target mask is missing or empty' END] IF r IS NOT NULL] AS reasons FROM (SELECT *, CASE WHEN ax > 20 AND ay > 30 THEN 2 ELSE 0 END AS s FROM prompts)""")


@query("integrity_failures", ["checked"], "SELECT case_id, reasons[1] AS reason FROM checked WHERE len(reasons) > 0")
def integrity_failures(spark, d):
    return va.integrity_failures(_checked(spark, d))


@query("integrity_reasons", ["checked"], "SELECT case_id, reasons FROM checked")
def integrity_reasons(spark, d):
    return _checked(spark, d).select("case_id", "reasons")


@query("integrity_report", ["checked"], """SELECT count(*) AS checked_case_count, count(*) FILTER (len(reasons) > 0) AS failed_case_count,
  (SELECT string_agg(case_id || ': ' || reasons[1], '; ' ORDER BY case_id) FROM (SELECT * FROM checked WHERE len(reasons) > 0 ORDER BY case_id LIMIT 5))
  || CASE WHEN count(*) FILTER (len(reasons) > 0) > 5 THEN '; ... ' || (count(*) FILTER (len(reasons) > 0) - 5) || ' more' ELSE '' END AS message FROM checked""")
def integrity_report(spark, d):
    return va.integrity_report(_checked(spark, d))


@query("needs_check", ["manifest"], "SELECT * FROM manifest WHERE NOT (coalesce(target_voxel_count, 0) > 0 AND target_label_value IS NOT NULL)")
def needs_check(spark, d):
    return va.needs_check(fx.manifest(spark, d))


@query("validate_label_pair", ["prompts"], """SELECT case_id, prompt, CASE WHEN ax > 40 THEN 'label shape does not match image shape' WHEN ay > 30 THEN 'label spacing does not match image spacing'
  WHEN az > 15 THEN 'label affine does not match image affine' END AS reason FROM prompts""")
def validate_label_pair(spark, d):
    pairs = fx.prompts(spark, d).selectExpr(
        "case_id", "prompt", "array(nz, ny, nx) AS image_shape", "array(nz, ny, nx + if(ax > 40, 1, 0)) AS label_shape",
        "array(1D, 1D, 2D) AS image_spacing", "array(1D, 1.00001D, 2D + if(ay > 30, 0.01D, 0D)) AS label_spacing",
        "array(1D, 0D, 0D, 5D) AS image_affine", "array(1D, 0D, if(az > 15, 1D, 0D), 5D) AS label_affine")
    return pairs.select("case_id", "prompt", va.geometry_pair_reason().alias("reason"))


@query("validate_image", ["scan_voxels"], """SELECT case_id, 4 AS nz, 4 AS ny, 4 AS nx, count(*) FILTER (v > 0.3) AS bad_values,
  CASE WHEN count(*) FILTER (v > 0.3) > 0 THEN 'image contains NaN or Inf' END AS reason FROM scan_voxels GROUP BY 1""")
def validate_image(spark, d):
    lines = fx.scanlines(spark, d).withColumn("vals", F.expr("transform(vals, v -> if(v > 0.3, double('NaN'), v))"))
    return va.image_facts(lines).select("case_id", "nz", "ny", "nx", "bad_values", va.image_reason().alias("reason"))


@query("validate_mask", ["scan_mask", "scan_meta"], """SELECT m.case_id, count(s.z) AS mask_voxels, CASE WHEN count(s.z) = 0 THEN 'mask has no positive voxels'
  WHEN max(s.z) >= 3 THEN 'mask shape does not match image shape' END AS reason FROM scan_meta m LEFT JOIN scan_mask s ON s.case_id = m.case_id GROUP BY 1""")
def validate_mask(spark, d):
    meta = fx.scan_meta(spark, d).withColumn("nz", F.lit(3))
    checked = meta.join(va.mask_facts(fx.scan_mask(spark, d)), "case_id", "left")
    return checked.select("case_id", F.coalesce("mask_voxels", F.lit(0)).alias("mask_voxels"), va.mask_reason(True).alias("reason"))


# ---- run logs -----------------------------------------------------------------------------------------------------------

@query("run_summary", ["case_log"], """SELECT count(*) AS case_count, count(*) FILTER (status <> 'ok') AS failed_case_count, count(*) FILTER (status = 'timeout') AS timeout_case_count,
  round(max(coalesce(total_seconds, 0)), 6) AS max_total_seconds, round(avg(coalesce(total_seconds, 0)), 6) AS mean_total_seconds, round(max(coalesce(rss_mb, 0)), 6) AS max_rss_mb,
  round(sum(coalesce(cpu_memory_time_mb_seconds, 0)), 6) AS total_cpu_memory_time_mb_seconds, round(avg(coalesce(cpu_memory_time_mb_seconds, 0)), 6) AS mean_cpu_memory_time_mb_seconds,
  round(avg(dsc), 6) AS val_dsc, round(avg(nsd), 6) AS val_nsd, round(0.5 * (avg(dsc) + avg(nsd)), 6) AS val_score FROM case_log""")
def run_summary(spark, d):
    return rounded(rn.run_summary(fx.case_log(spark, d)))


@query("memory_time", [], """SELECT user_id, round(coalesce(sum(greatest(t - pt, 0) * 0.5 * (value + pv)), 0), 3) AS memory_time_mb_seconds, max(value) AS sample_peak_rss_mb FROM (
  SELECT user_id, value, epoch(ts) AS t, epoch(lag(ts) OVER w) AS pt, lag(value) OVER w AS pv FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, value)) GROUP BY 1""")
def memory_time(spark, d):
    return rounded(rn.memory_time(fx.table(spark, d, "events").select("user_id", "ts", "value"), "user_id"), 3)


@query("numeric_means", ["case_log"], """SELECT status, round(avg(case_id), 6) AS case_id, round(avg(total_seconds), 6) AS total_seconds, round(avg(rss_mb), 6) AS rss_mb,
  round(avg(cpu_memory_time_mb_seconds), 6) AS cpu_memory_time_mb_seconds, round(avg(dsc), 6) AS dsc, round(avg(nsd), 6) AS nsd FROM case_log GROUP BY 1""")
def numeric_means(spark, d):
    return rounded(rn.numeric_means(fx.case_log(spark, d), ["status"]))


PARTS["history"] = (["train_steps"], "SELECT epoch, avg(loss) AS loss, avg(crop_dice) AS crop_dice, count(*) AS steps FROM train_steps GROUP BY 1")
PARTS["numbered"] = (["train_steps"], "SELECT *, row_number() OVER (PARTITION BY epoch ORDER BY ts, step_key) AS step, count(*) OVER (PARTITION BY epoch) AS last, min(ts) OVER (PARTITION BY epoch) AS started FROM train_steps")


@query("epoch_rollup", ["history"], "SELECT epoch, round(loss, 6) AS loss, round(crop_dice, 6) AS crop_dice, steps FROM history")
def epoch_rollup(spark, d):
    return rounded(rn.epoch_rollup(fx.train_steps(spark, d), ["loss", "crop_dice"]))


@query("running_means", ["numbered"], """SELECT epoch, CAST(step AS INT) AS step, round(l, 9) AS loss_running, round(c, 9) AS crop_dice_running FROM (
  SELECT *, avg(loss) OVER w AS l, avg(crop_dice) OVER w AS c FROM numbered WINDOW w AS (PARTITION BY epoch ORDER BY step)) WHERE step % 10 = 0 OR step = last""")
def running_means(spark, d):
    return rounded(rn.running_means(rn.number_steps(fx.train_steps(spark, d)), ["loss", "crop_dice"], 10), 9)


@query("mean_step_seconds", ["numbered"], """SELECT epoch, CAST(step AS INT) AS step, round(e, 3) AS elapsed_seconds, round(step / greatest(e, 1e-9), 3) AS steps_per_second,
  round((last - step) / greatest(step / greatest(e, 1e-9), 1e-9), 3) AS eta_epoch_seconds FROM (SELECT *, epoch_us(ts) / 1000000 - epoch_us(started) / 1000000 AS e FROM numbered)
  WHERE (step % 10 = 0 OR step = last)""")
def mean_step_seconds(spark, d):
    return rounded(rn.step_pace(rn.number_steps(fx.train_steps(spark, d)), 10), 3)


@query("best_so_far", ["history"], """SELECT epoch, round(crop_dice, 6) AS crop_dice, round(b, 6) AS best_before, b IS NULL OR crop_dice > b AS best_updated FROM (
  SELECT *, max(crop_dice) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM history WHERE epoch % 2 = 0 OR epoch = (SELECT max(epoch) FROM history))""")
def best_so_far(spark, d):
    history = rn.epoch_rollup(fx.train_steps(spark, d), ["crop_dice"]).drop("steps")
    return rounded(rn.best_so_far(history, "crop_dice", every=2))


@query("cache_totals", ["case_log"], "SELECT status, count(*) AS entries, sum(coalesce(CAST(rss_mb AS BIGINT), 0)) AS bytes FROM case_log GROUP BY 1")
def cache_totals(spark, d):
    return rn.cache_totals(fx.case_log(spark, d).selectExpr("status", "cast(rss_mb AS bigint) AS bytes"))


# ---- losses -------------------------------------------------------------------------------------------------------------

@query("hard_dice", ["logits"], """SELECT round(avg(CASE WHEN a + b = 0 THEN 1 ELSE 2 * tp / (a + b) END), 6) AS hard_dice FROM (SELECT sample, count(*) FILTER (logit >= 0 AND target = 1) AS tp,
  count(*) FILTER (logit >= 0) AS a, sum(target) AS b FROM logits GROUP BY 1)""")
def hard_dice(spark, d):
    return rounded(ls.hard_dice(fx.logits(spark, d)))


@query("soft_dice_bce", ["logits"], """SELECT round(dl, 6) AS dice_loss, round(bce, 6) AS bce_loss, round(dl + 2 * bce, 6) AS loss FROM (SELECT avg(1 - (2 * i + 1e-6) / (m + 1e-6)) AS dl, sum(b) / sum(n) AS bce FROM (
  SELECT sample, sum(p * target) AS i, sum(p + target) AS m, sum(-(target * ln(p) + (1 - target) * ln(1 - p))) AS b, count(*) AS n FROM (SELECT *, 1 / (1 + exp(-logit)) AS p FROM logits) GROUP BY 1))""")
def soft_dice_bce(spark, d):
    return rounded(ls.dice_bce(fx.logits(spark, d)))


@query("class_ce_dice", ["class_logits"], """, v AS (SELECT *, exp(scores[1]) + exp(scores[2]) + exp(scores[3]) AS tot FROM class_logits WHERE target >= 0),
  k AS (SELECT sample, c, sum(exp(scores[c + 1]) / tot * (c = target)::INT) AS i, sum(exp(scores[c + 1]) / tot + (c = target)::INT) AS m, sum((c = target)::INT) AS n FROM v, range(0, 3) t(c) GROUP BY 1, 2)
  SELECT round(ce, 6) AS ce_loss, round(dl, 6) AS dice_loss, round(0.5 * ce + 0.5 * dl, 6) AS loss FROM (SELECT (SELECT avg(-ln(exp(scores[target + 1]) / tot)) FROM v) AS ce,
    (SELECT avg(1 - (2 * i + 1e-6) / (m + 1e-6)) FROM k WHERE n > 0) AS dl)""")
def class_ce_dice(spark, d):
    return rounded(ls.class_ce_dice(fx.class_logits(spark, d)))


@query("weighted_level_mean", [], """SELECT l_orderkey AS step, round(sum(w * l_quantity) / sum(w), 6) AS main_loss FROM (SELECT *, [1, 0.5, 0.25, 0.125][least(l_linenumber, 4)]::DOUBLE AS w FROM lineitem) GROUP BY 1""")
def weighted_level_mean(spark, d):
    return rounded(ls.weighted_level_mean(fx.table(spark, d, "lineitem").selectExpr("l_orderkey AS step", "l_linenumber - 1 AS level", "l_quantity AS loss")))


# ---- sampling -----------------------------------------------------------------------------------------------------------

def draw_sql(key: str, tag: str) -> str:
    return f"(('0x' || substr(md5({key} || '|{tag}|13'), 1, 12))::BIGINT / 281474976710656.0::DOUBLE)"


_EPOCH_KEY = "case_id || '|' || epoch"
PARTS["plan_samples"] = (["manifest"], "SELECT case_id, e AS epoch, coalesce(target_voxel_count, 0) > 2000 AS needs_tail FROM manifest, range(0, 3) t(e)")
PARTS["crop_plan"] = (["plan_samples"], f"""SELECT case_id, epoch, needs_tail, kind AS crop_kind, CASE WHEN kind = 'mixed_prompt_multifov' THEN CAST(floor({draw_sql(_EPOCH_KEY, 'scale')} * 4) AS INT) END AS scale_index
  FROM (SELECT *, CASE WHEN needs_tail AND d >= 0.6 + 0.3 AND d < 0.6 + 0.3 + 0.1 THEN 'mixed_recist_bbox_fit_tail' WHEN d >= 0.6 AND d < 0.6 + 0.3 THEN 'mixed_prompt_multifov' ELSE 'mixed_prompt_base' END AS kind
    FROM (SELECT *, {draw_sql(_EPOCH_KEY, 'crop')} AS d FROM plan_samples))""")


def _plan(spark, d):
    samples = fx.manifest(spark, d).selectExpr("case_id", "explode(sequence(0, 2)) AS epoch", "coalesce(target_voxel_count, 0) > 2000 AS needs_tail")
    return sm.plan_training_crops(samples)


@query("plan_training_crops", ["crop_plan"], "SELECT * FROM crop_plan")
def plan_training_crops(spark, d):
    return _plan(spark, d)


@query("hard_negatives", ["crop_plan"], f"""SELECT * EXCLUDE (crop_kind), crop_kind || CASE WHEN hard_negative THEN '_hard_negative' ELSE '' END AS crop_kind,
  CASE WHEN hard_negative THEN 'wrong_prompt' ELSE 'full' END AS prompt_mode, CASE WHEN hard_negative THEN 0.25 ELSE 1 END::DOUBLE AS main_loss_weight
  FROM (SELECT *, {draw_sql(_EPOCH_KEY, 'hard')} < 0.2 AS hard_negative FROM crop_plan)""")
def hard_negatives(spark, d):
    return sm.hard_negatives(_plan(spark, d), 0.2)


_PK = "case_id || '|' || prompt"


def _moved(e: str) -> str:
    a, col = e[1], f'"{e}"'
    if a == "z":
        return f"CASE WHEN hit THEN greatest(0, least({col} + floor({draw_sql(_PK, 'slice')} * 3) - 1, 23)) ELSE {col} END AS {col}"
    mid = f'(("a{a}" + "b{a}") / 2)'
    return f"""round(CASE WHEN hit THEN greatest(0, least({mid} + ({col} - {mid}) * (0.8 + 0.4 * {draw_sql(_PK, 'scale')}) + floor({draw_sql(_PK, 'shift_' + a)} * 7) - 3
      + floor({draw_sql(_PK, 'jitter_' + e)} * 3) - 1, 49)) ELSE {col} END, 6) AS {col}"""


@query("perturb_endpoints", ["prompts"], f"SELECT case_id, prompt, {', '.join(_moved(e) for e in geo.ENDS)} FROM (SELECT *, {draw_sql(_PK, 'hit')} < 0.7 AS hit FROM prompts)")
def perturb_endpoints(spark, d):
    moved = sm.perturb_endpoints(fx.prompts(spark, d), 0.7, shift_xy=3, jitter_xy=1, slice_jitter=1, scale=(0.8, 1.2))
    return rounded(moved.select("case_id", "prompt", *geo.ENDS))


@query("crop_jitter", ["prompts"], f"""SELECT case_id, prompt, CAST(floor({draw_sql(_PK, 'jitter_z')} * 9) - 4 AS INT) AS jz, CAST(floor({draw_sql(_PK, 'jitter_y')} * 17) - 8 AS INT) AS jy,
  CAST(floor({draw_sql(_PK, 'jitter_x')} * 17) - 8 AS INT) AS jx FROM prompts""")
def crop_jitter(spark, d):
    return sm.jitter_center(fx.prompts(spark, d), (4, 8, 8), ["case_id", "prompt"]).select("case_id", "prompt", "jz", "jy", "jx")


@query("epoch_shuffle", ["deduped"], f"SELECT case_id, round({draw_sql('case_id', 'epoch_2')}, 9) AS draw, CAST(floor({draw_sql('case_id', 'epoch_2')} * 4) AS INT) AS shard FROM deduped")
def epoch_shuffle(spark, d):
    return rounded(sm.epoch_shuffle(cs.dedupe_records(fx.manifest(spark, d)), 2, 4).select("case_id", "draw", "shard"), 9)


# ---- text and keys ------------------------------------------------------------------------------------------------------

@query("safe_cache_name", [], """SELECT page_id, regexp_replace(url, '[^a-zA-Z0-9._-]', '_', 'g') AS name FROM pages""")
def safe_cache_name(spark, d):
    return fx.table(spark, d, "pages").select("page_id", tx.safe_name(F.col("url")).alias("name"))


@query("source_cache_key", ["manifest"], """SELECT ord, sha256('{"version":"v1","source":"' || source || '","image":"' || image_path || '","spacing":[1.0,1.0,2.4],"label":' || coalesce(target_label_value::VARCHAR, 'null') || '}') AS key FROM manifest""")
def source_cache_key(spark, d):
    return fx.manifest(spark, d).select("ord", tx.key_of(
        F.lit("v1").alias("version"), "source", F.col("image_path").alias("image"), F.array(F.lit(1.0), F.lit(1.0), F.lit(2.4)).alias("spacing"),
        F.col("target_label_value").alias("label")).alias("key"))


@query("run_ids", [], """SELECT doc_id, CASE WHEN n = 1 THEN base ELSE base || '_' || n END AS run_id FROM (SELECT doc_id, base, row_number() OVER (PARTITION BY base ORDER BY doc_id) AS n FROM (
  SELECT doc_id, '20240101T000000Z_' || source || CASE WHEN s <> '' THEN '_' || s ELSE '' END AS base FROM (
    SELECT *, regexp_replace(regexp_replace(trim('-' || lang || ' / ' || (n_chars // 1000) || '!'), '[^A-Za-z0-9_.-]+', '_', 'g'), '^[._-]+|[._-]+$', '', 'g') AS s FROM documents)))""")
def run_ids(spark, d):
    runs = fx.table(spark, d, "documents").selectExpr(
        "doc_id", "doc_id AS ord", "'20240101T000000Z' AS stamp", "source AS model", "concat('-', lang, ' / ', n_chars div 1000, '!') AS suffix")
    return tx.run_ids(runs).select("doc_id", "run_id")


@query("threshold_label", ["prob_voxels"], """SELECT DISTINCT CAST(round(prob * 50, 0) AS INT) AS step, replace(rtrim(rtrim(printf('%.3f', prob), '0'), '.'), '.', 'p') AS label FROM prob_voxels""")
def threshold_label(spark, d):
    return fx.prob_voxels(spark, d).selectExpr("cast(round(prob * 50) AS int) AS step", "prob").distinct().select("step", tx.threshold_label(F.col("prob")).alias("label"))


@query("tuple_parsing", [], "SELECT o_orderkey, [o_orderkey % 7, o_custkey, 3] AS parsed FROM orders")
def tuple_parsing(spark, d):
    rows = fx.table(spark, d, "orders").withColumn("text", F.concat(F.expr("o_orderkey % 7"), F.lit(" , "), "o_custkey", F.lit(",3,")))
    return rows.select("o_orderkey", tx.number_list(F.col("text"), "bigint").alias("parsed"))
