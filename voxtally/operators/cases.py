"""Case-table operators: splits, limits, availability, emptiness, duplicates, drift, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtally.operators.normalize import exact_percentiles
from voxtally.session import cut_lineage


def split_records(records: DataFrame, split: str) -> DataFrame:
    return records.where(F.col("split") == split)


def limit_records(records: DataFrame, limit: int | None) -> DataFrame:
    """First rows in manifest order; all without a limit."""
    return records if limit is None else records.orderBy("ord").limit(max(int(limit), 0))


def filter_available(records: DataFrame, listing: DataFrame, keep: bool = True) -> DataFrame:
    """Records all of whose files are listed, or with ``keep=False`` the others. Null paths count as present."""
    paths = [c for c in ("image_path", "label_path") if c in records.columns]
    wanted = records.select("ord", F.explode(F.array_compact(F.array(*paths))).alias("path"))
    lacking = wanted.join(listing.select("path"), "path", "left_anti").select("ord").distinct()
    return records.join(lacking, "ord", "left_anti" if keep else "left_semi")


def availability_report(records: DataFrame, listing: DataFrame) -> DataFrame:
    """Input, available and skipped records per source."""
    lacking = filter_available(records, listing, keep=False).select("ord", F.lit(1).alias("skipped"))
    return records.select("ord", "source").join(lacking, "ord", "left").groupBy("source").agg(
        F.count(F.lit(1)).alias("input_records"),
        F.count_if(F.col("skipped").isNull()).alias("available_records"),
        F.count("skipped").alias("skipped_missing_records"),
    )


def with_target_status(records: DataFrame, computed: DataFrame | None = None, verify: bool = False) -> DataFrame:
    """Add ``voxels`` and ``empty_reason``: the manifest's count, or the computed one (always with ``verify``)."""
    voxels: Column = F.col("target_voxel_count")
    if computed is not None:
        records = records.join(computed.select("ord", F.col("voxel_count").alias("computed")), "ord", "left")
        voxels = F.col("computed") if verify else F.coalesce("target_voxel_count", "computed")
    reason = F.when(F.col("voxels").isNull(), "missing_target_mask").when(F.col("voxels") == 0, "empty_target_mask")
    return records.withColumn("voxels", voxels).withColumn("empty_reason", reason).drop("computed")


def filter_empty_targets(status: DataFrame, exclude_empty: bool = True) -> DataFrame:
    return status.where("empty_reason IS NULL") if exclude_empty else status


def empty_target_audit(status: DataFrame, exclude_empty: bool = True) -> DataFrame:
    empty = F.col("empty_reason").isNotNull()
    return status.agg(
        F.count(F.lit(1)).alias("input_train_case_count"),
        (F.count_if(~empty) if exclude_empty else F.count(F.lit(1))).alias("kept_train_case_count"),
        F.count_if(~empty).alias("nonempty_target_case_count"),
        F.count_if(empty).alias("empty_or_missing_target_case_count"),
        F.count_if(F.col("voxels").isNull()).alias("missing_target_case_count"),
    )


def empty_target_rows(status: DataFrame) -> DataFrame:
    return status.where("empty_reason IS NOT NULL").select(
        "case_id", "split", F.coalesce("voxels", F.lit(0)).alias("selected_target_voxels"), F.col("empty_reason").alias("reason")
    )


def val_fallback(train: DataFrame, val: DataFrame, rows: int = 2) -> DataFrame:
    """Validation rows, or the first training rows when there are none."""
    any_val = val.agg((F.count(F.lit(1)) > 0).alias("has_val"))
    spare = limit_records(train, rows).crossJoin(F.broadcast(any_val)).where("NOT has_val").drop("has_val")
    return val.unionByName(spare)


def dedupe_records(records: DataFrame) -> DataFrame:
    """First row per (case, image, split) in manifest order."""
    keys = ["case_id", "image_path", "split"]
    rest = [c for c in records.columns if c not in keys]
    first = records.groupBy(*keys).agg(F.min_by(F.struct(*rest), "ord").alias("r"))
    return first.select(*keys, "r.*").select(*records.columns)


def config_drift(saved: DataFrame, current: DataFrame) -> DataFrame:
    """Fields ``(field, value)`` whose saved and current values differ; a field of one side only differs from null."""
    both = saved.select("field", F.col("value").alias("saved_value")).join(
        current.select("field", F.col("value").alias("current_value")), "field", "full"
    )
    return both.where("NOT (saved_value <=> current_value)")


def organ_availability(cases: DataFrame, class_map: DataFrame, listing: DataFrame) -> DataFrame:
    """Loaded and missing segmentations of each case ``(case_id, label_dir)`` and whether background is known.

    ``class_map(class_id, segmentation)`` is a dimension of a few dozen rows; each case asks for its files under two
    endings. Background (class 0) has no file.
    """
    wanted = cases.select("case_id", "label_dir").crossJoin(F.broadcast(class_map.where("segmentation IS NOT NULL"))).select(
        "case_id", "class_id", "segmentation",
        F.explode(F.array(F.lit(".nii.gz"), F.lit(".nii"))).alias("ending"), "label_dir",
    ).withColumn("path", F.concat("label_dir", F.lit("/segmentations/"), "segmentation", "ending"))
    found = wanted.join(listing.select("path", F.lit(True).alias("found")), "path", "left").groupBy("case_id", "class_id", "segmentation").agg(
        F.coalesce(F.max("found"), F.lit(False)).alias("found")
    )
    name = F.col("segmentation")
    return found.groupBy("case_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("found"), name))).alias("loaded_segmentations"),
        F.array_sort(F.collect_list(F.when(~F.col("found"), name))).alias("missing_segmentations"),
        F.min("found").alias("aux_background_is_valid"),
    )


def lesion_label(labels: DataFrame, file_name: Column, lesion: int = 28) -> DataFrame:
    """Lesion voxels of label volumes: one class of a combined file, anything positive of another."""
    combined = file_name.isin("combined_labels.nii.gz", "combined_labels.nii")
    return labels.where(F.when(combined, F.col("label") == lesion).otherwise(F.col("label") > 0)).withColumn("label", F.lit(1))


def summarize(df: DataFrame, column: str) -> DataFrame:
    """Count, min, max, mean and exact median of a column; zeros when empty. Only values in a narrow bracket are ordered."""
    values = df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    facts = values.agg(F.count("v").alias("count"), zero(F.min("v")).alias("min"), zero(F.max("v")).alias("max"), zero(F.avg("v")).alias("mean"))
    median = exact_percentiles(values, "v", [0.5]).agg(zero(F.max("value")).alias("median"))
    return facts.crossJoin(F.broadcast(median)).select(F.lit(column).alias("measure"), "*")  # one row each


AUDIT_MEASURES = ["all_positive_voxels", "selected_target_voxels", "selected_fraction_of_all_positive", "component_count"]


def audit_rows(records: DataFrame, facts: DataFrame, selection: DataFrame) -> DataFrame:
    """One audit row per distinct record.

    Rows whose manifest names label and voxel count are certified: one component, everything selected, no voxel is
    read. A certified count of zero or a case without a mask reads ``missing_mask``. ``facts(case_id, component_count,
    all_positive_voxels)`` and ``selection(case_id, selection_mode, used_fallback, label, component_id, voxel_count)`` serve the rest.
    """
    records = dedupe_records(records)
    none = F.expr("target_voxel_count <= 0")
    certified = F.expr("target_voxel_count IS NOT NULL AND target_label_value IS NOT NULL")
    joined = records.join(facts, "case_id", "left").join(
        selection.selectExpr("case_id", "selection_mode AS found_mode", "used_fallback", "label", "component_id", "voxel_count"), "case_id", "left"
    )
    missing = F.coalesce(none, F.lit(False)) | (~certified & F.expr("coalesce(all_positive_voxels, 0) = 0 OR voxel_count IS NULL"))
    count = F.col("target_voxel_count")
    rows = joined.select(
        "case_id", "split",
        F.when(missing, "missing_mask").when(certified, "manifest_target_label").otherwise(F.col("found_mode")).alias("selection_mode"),
        F.when(missing | certified, F.lit(False)).otherwise(F.col("used_fallback")).alias("used_fallback"),
        F.when(missing, 0).when(certified, 1).otherwise(F.col("component_count")).cast("bigint").alias("component_count"),
        F.when(missing, 0).when(certified, count).otherwise(F.col("all_positive_voxels")).cast("bigint").alias("all_positive_voxels"),
        F.when(missing, 0).when(certified, count).otherwise(F.col("voxel_count")).cast("bigint").alias("selected_target_voxels"),
        F.when(missing, None).when(certified, F.col("target_label_value")).otherwise(F.col("label")).alias("selected_label_value"),
    )
    share = F.when(F.col("all_positive_voxels") > 0, F.col("selected_target_voxels") / F.col("all_positive_voxels")).otherwise(0.0)
    return rows.withColumn("selected_fraction_of_all_positive", share)


def audit_summary(rows: DataFrame) -> DataFrame:
    total = F.count(F.lit(1))
    return rows.agg(
        total.alias("case_count"),
        F.count_if(F.col("component_count") > 1).alias("multi_component_case_count"),
        (F.count_if(F.col("component_count") > 1) / F.greatest(total, F.lit(1))).alias("multi_component_case_fraction"),
        F.count_if(F.col("selection_mode") == "direct_endpoint_label_hit").alias("direct_endpoint_selection_count"),
        F.count_if("used_fallback").alias("fallback_selection_count"),
    )


def audit_counts(rows: DataFrame) -> DataFrame:
    """Cases per split and per selection mode (missing masks have none)."""
    splits = rows.groupBy(F.lit("split").alias("kind"), F.col("split").alias("value")).agg(F.count(F.lit(1)).alias("cases"))
    modes = rows.where("selection_mode <> 'missing_mask'").groupBy(
        F.lit("selection_mode").alias("kind"), F.col("selection_mode").alias("value")
    ).agg(F.count(F.lit(1)).alias("cases"))
    return splits.unionByName(modes)


def audit_measures(rows: DataFrame) -> DataFrame:
    """The four summaries over cases with a mask."""
    present = cut_lineage(rows.where("selection_mode <> 'missing_mask'").select(*AUDIT_MEASURES))
    out = summarize(present, AUDIT_MEASURES[0])
    for measure in AUDIT_MEASURES[1:]:
        out = out.unionByName(summarize(present, measure))
    return out
