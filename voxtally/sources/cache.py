"""Two-part case cache as Parquet tables: sources (shared by many targets) and targets, keyed by hash.

Sources: ``source_key, cache_version, ..``. Targets: ``target_key, source_key, cache_version, file_name, case_id, label, component_id,
voxel_count, ..``. Planning compares keys; nothing is read that need not be written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtally.functions.text import cache_file_matches, key_of

SOURCE_VERSION = "source_v1"
TARGET_VERSION = "target_v1"


def with_cache_keys(records: DataFrame, files: DataFrame, target_xyz: tuple[float, float, float], mode: str, aux: Column | None = None) -> DataFrame:
    """Add ``source_key`` and ``target_key``.

    The source key covers source, image and label fingerprints, spacings and mode; the target key adds case, prompt and named target. A changed
    file changes its key. ``files(path, size, mtime_us)`` are fingerprints.
    """
    def stamp(column: str, name: str) -> DataFrame:
        return files.select(F.col("path").alias(column), F.struct("path", "size", "mtime_us").alias(name)).distinct()

    joined = records.join(stamp("image_path", "image_file"), "image_path", "left").join(stamp("label_path", "label_file"), "label_path", "left")
    spacing = F.array(*[F.lit(float(v)) for v in target_xyz]).alias("target_spacing_xyz")
    extra = [] if aux is None else [aux.alias("aux")]
    source = key_of(F.lit(SOURCE_VERSION).alias("version"), "source", F.coalesce("image_file", F.struct(F.col("image_path").alias("path"), F.lit(None).cast("bigint").alias("size"), F.lit(None).cast("bigint").alias("mtime_us"))).alias("image"),
                    F.col("label_file").alias("label"), "spacing_xyz", spacing, F.lit(mode).alias("mode"), *extra)
    target = key_of(F.lit(TARGET_VERSION).alias("version"), "source_key", "case_id", "source", "prompt_source", spacing, F.lit(mode).alias("mode"),
                    "recist_endpoints_xyz", "recist_slice_index", "target_label_value", "target_component_id", *extra)
    return joined.withColumn("source_key", source).withColumn("target_key", target).drop("image_file", "label_file")


def usable_sources(sources: DataFrame, aux_version: str | None = None) -> DataFrame:
    usable = sources.where(F.col("cache_version") == SOURCE_VERSION)
    return usable if aux_version is None else usable.where(F.col("class_map_version") == aux_version)


def usable_targets(targets: DataFrame) -> DataFrame:
    return targets.where(F.col("cache_version") == TARGET_VERSION)


def cache_plan(records: DataFrame, sources: DataFrame, targets: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """Status per record: ``exists`` if both parts are usable, ``empty_target`` if it has no voxel, ``error`` if it failed to load, else ``written`` (to be done)."""
    held = usable_targets(targets).join(usable_sources(sources).select("source_key"), "source_key", "left_semi").select("target_key", "source_key").distinct()
    marked = records.join(held.withColumn("held", F.lit(True)), ["target_key", "source_key"], "left")
    broken = F.lit(False)
    if failed is not None:
        marked = marked.join(failed.select("case_id", F.lit(True).alias("broken")).distinct(), "case_id", "left")
        broken = F.coalesce("broken", F.lit(False))
    status = F.when(F.coalesce("held", F.lit(False)), "exists").when(broken, "error").when(F.coalesce("voxel_count", F.lit(0)) <= 0, "empty_target").otherwise("written")
    return marked.withColumn("status", status).drop("held", "broken")


def missing_sources(plan: DataFrame, sources: DataFrame) -> DataFrame:
    """Source keys that planned targets need and the cache lacks, once each."""
    return plan.where("status = 'written'").select("source_key").distinct().join(usable_sources(sources).select("source_key"), "source_key", "left_anti")


def cache_lookup(records: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Cached target of each record: by exact key, else by case id, first in path order.

    The fallback needs a file named after the case, the current version, voxels, the named label and component where given, and its source
    present. Records without a hit keep null columns. ``used_fallback`` tells which way it was.
    """
    held = usable_targets(targets).join(usable_sources(sources).select("source_key"), "source_key", "left_semi")
    picked = ["entry_key", "entry_source_key", "entry_voxels"]
    entries = held.select(F.col("target_key").alias("entry_key"), F.col("source_key").alias("entry_source_key"), F.col("voxel_count").alias("entry_voxels"),
                          "file_name", F.col("case_id").alias("entry_case"), F.col("label").alias("entry_label"), F.col("component_id").alias("entry_component"))
    exact = records.select("ord", "target_key", "source_key").join(
        entries, (F.col("target_key") == F.col("entry_key")) & (F.col("source_key") == F.col("entry_source_key"))
    ).groupBy("ord").agg(F.min_by(F.struct(*picked), "file_name").alias("e"))
    rest = records.join(exact, "ord", "left_anti").select("ord", F.col("case_id").alias("entry_case"), "target_label_value", "target_component_id")
    near = rest.join(entries, "entry_case").where(
        cache_file_matches(F.col("file_name"), F.col("entry_case").cast("string"))
        & F.expr("entry_voxels > 0 AND (target_label_value IS NULL OR target_label_value = entry_label) AND (target_component_id IS NULL OR entry_component IS NULL OR target_component_id = entry_component)")
    ).groupBy("ord").agg(F.min_by(F.struct(*picked), "file_name").alias("e"))
    found = exact.withColumn("used_fallback", F.lit(False)).unionByName(near.withColumn("used_fallback", F.lit(True)))
    return records.join(found.select("ord", "e.*", "used_fallback"), "ord", "left")
