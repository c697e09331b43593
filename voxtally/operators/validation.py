"""Integrity rules as columns: every rule gives a reason or null; reports list and count them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def spacing_reason(spacing: Column) -> Column:
    bad = F.exists(spacing, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")) | (v <= 0))
    return F.when(F.coalesce(F.size(spacing), F.lit(-1)) != 3, "spacing_xyz must have length 3").when(bad, "spacing_xyz must be finite and positive")


def image_facts(lines: DataFrame) -> DataFrame:
    """Shape and non-finite voxels of each scanline volume."""
    bad = F.size(F.filter("vals", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))))
    return lines.groupBy("case_id").agg(
        (F.max("z") + 1).alias("nz"), (F.max("y") + 1).alias("ny"), F.max(F.size("vals")).alias("nx"),
        F.count(F.lit(1)).alias("lines"), F.min(F.size("vals")).alias("shortest"), F.sum(bad).alias("bad_values"),
    )


def image_reason() -> Column:
    shape = F.expr("nz IS NULL OR nz <= 0 OR ny <= 0 OR nx <= 0 OR shortest <> nx OR lines <> nz * ny")
    return F.when(shape, "image must be 3D with positive shape").when(F.col("bad_values") > 0, "image contains NaN or Inf")


def mask_facts(mask: DataFrame) -> DataFrame:
    return mask.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("mask_voxels"), *[F.max(a).alias(f"mask_{a}") for a in "zyx"], *[F.min(a).alias(f"mask_low_{a}") for a in "zyx"]
    )


def mask_reason(required: bool) -> Column:
    outside = F.expr("mask_z >= nz OR mask_y >= ny OR mask_x >= nx OR mask_low_z < 0 OR mask_low_y < 0 OR mask_low_x < 0")
    reason = F.when(outside, "mask shape does not match image shape")
    if required:
        reason = F.when(F.col("mask_voxels").isNull(), "mask has no positive voxels").otherwise(reason)
    return reason


def prompt_reason() -> Column:
    """Endpoints finite, inside the frame, slice in range, and an endpoint within half a voxel of the slice."""
    ends = F.array("ax", "ay", "az", "bx", "by", "bz")
    limits = F.expr("array(nx, ny, nz, nx, ny, nz)")
    outside = F.exists(F.arrays_zip(ends.alias("e"), limits.alias("n")), lambda p: (p["e"] < 0) | (p["e"] > p["n"] - 1))
    return (
        F.when(F.exists(ends, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), "RECIST endpoints contain NaN or Inf")
        .when(outside, "RECIST endpoints out of bounds")
        .when(F.expr("slice < 0 OR slice >= nz"), "recist_slice_index out of bounds")
        .when(F.expr("abs(az - slice) > 0.5001D AND abs(bz - slice) > 0.5001D"), "recist_slice_index is inconsistent with endpoints")
    )


def target_reason() -> Column:
    return F.when(F.expr("coalesce(target_voxels, 0) <= 0"), "target mask is missing or empty")


def geometry_pair_reason(tolerance: float = 1e-4) -> Column:
    """Image against label: shapes ``image_shape, label_shape``, spacings and affines close."""
    def far(a: str, b: str) -> Column:
        return F.exists(F.arrays_zip(F.col(a).alias("a"), F.col(b).alias("b")), lambda p: ~(F.abs(p["a"] - p["b"]) <= tolerance + tolerance * F.abs(p["b"])))

    return (
        F.when(F.col("image_shape") != F.col("label_shape"), "label shape does not match image shape")
        .when(far("image_spacing", "label_spacing"), "label spacing does not match image spacing")
        .when(far("image_affine", "label_affine"), "label affine does not match image affine")
    )


def with_reasons(cases: DataFrame, rules: list[Column]) -> DataFrame:
    """Add ``reasons``, all rules a case breaks, in rule order."""
    return cases.withColumn("reasons", F.array_compact(F.array(*rules)))


def integrity_failures(checked: DataFrame) -> DataFrame:
    """Cases that break a rule, with the first."""
    return checked.where(F.size("reasons") > 0).select("case_id", F.col("reasons")[0].alias("reason"))


def integrity_report(checked: DataFrame, preview: int = 5) -> DataFrame:
    """Checked and failed counts and a message that names the first failures by case and counts the rest."""
    failures = integrity_failures(checked)
    counts = checked.agg(F.count(F.lit(1)).alias("checked_case_count"), F.count_if(F.size("reasons") > 0).alias("failed_case_count"))
    shown = failures.orderBy("case_id").limit(preview).agg(
        F.array_sort(F.collect_list(F.struct("case_id", F.concat_ws(": ", F.col("case_id").cast("string"), "reason").alias("text")))).alias("s")
    )
    more = F.when(F.col("failed_case_count") > preview, F.concat(F.lit("; ... "), (F.col("failed_case_count") - preview).cast("string"), F.lit(" more"))).otherwise("")
    return counts.crossJoin(shown).select(
        "checked_case_count", "failed_case_count",
        F.when(F.col("failed_case_count") > 0, F.concat(F.array_join(F.col("s.text"), "; "), more)).alias("message"),
    )


def needs_check(records: DataFrame) -> DataFrame:
    """Records whose manifest does not already certify a labelled, nonempty target."""
    return records.where("NOT (coalesce(target_voxel_count, 0) > 0 AND target_label_value IS NOT NULL)")
