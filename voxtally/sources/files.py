"""File listings: discovery, fingerprints, class maps, manifests, logs, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fields of one manifest record; numbers may arrive as empty strings, so they are read as text.
RECORD = """case_id STRING, image_path STRING, label_path STRING, spacing_xyz ARRAY<DOUBLE>, recist_endpoints_xyz ARRAY<ARRAY<DOUBLE>>,
  recist_slice_index INT, split STRING, source STRING, prompt_source STRING, target_label_value STRING, target_component_id STRING, target_voxel_count STRING"""
PUBLIC_SUBFOLDER = "validation_public_npz"
CASE_LOG = """event STRING, case_id STRING, input_path STRING, status STRING, error STRING, case_index INT, case_count INT, shape_zyx ARRAY<INT>, spacing_xyz ARRAY<DOUBLE>,
  prompts ARRAY<STRUCT<label_value: INT, marker_voxels: BIGINT, forward_seconds: DOUBLE, prompt_total_seconds: DOUBLE, inference_predicted_voxels: BIGINT, predicted_voxels: BIGINT, assigned_voxels: BIGINT, overlap_voxels: BIGINT>>,
  load_seconds DOUBLE, forward_seconds DOUBLE, postprocess_seconds DOUBLE, save_seconds DOUBLE, total_seconds DOUBLE, time_limit_seconds DOUBLE, rss_mb DOUBLE, sample_peak_rss_mb DOUBLE,
  cpu_memory_time_mb_seconds DOUBLE, predicted_voxels BIGINT, dsc DOUBLE, nsd DOUBLE, lesion_count INT,
  lesion_metrics ARRAY<STRUCT<label_value: INT, dsc: DOUBLE, nsd: DOUBLE, gt_voxels: BIGINT, pred_voxels: BIGINT>>"""


def scan_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Records of one or many manifest documents, in order (``ord`` within its file).

    Relative paths hang on the manifest's folder, or three levels up when that folder is called ``prepared``. Empty
    strings are null. A record without a prompt source has source ``recist`` if it has endpoints, else ``unknown``.
    """
    docs = spark.read.schema(f"records ARRAY<STRUCT<{RECORD}>>").option("multiLine", True).json(path)
    rows = docs.select(F.col("_metadata.file_path").alias("manifest"), F.posexplode("records").alias("ord", "r")).select("manifest", "ord", "r.*")
    folder = F.regexp_replace(F.regexp_replace("manifest", "^file:/*", "/"), "/[^/]*$", "")
    root = F.when(folder.endswith("/prepared"), F.regexp_replace(folder, "/[^/]+/[^/]+$", "")).otherwise(folder)

    def resolved(name: str):
        value = F.nullif(F.col(name), F.lit(""))
        return F.when(value.startswith("/"), value).otherwise(F.concat(F.col("root"), F.lit("/"), value))

    numbers = {c: F.nullif(F.trim(c), F.lit("")).cast(kind) for c, kind in (("target_label_value", "int"), ("target_component_id", "int"), ("target_voxel_count", "bigint"))}
    source = F.coalesce(F.nullif("prompt_source", F.lit("")), F.when(F.col("recist_endpoints_xyz").isNotNull(), "recist").otherwise("unknown"))
    return rows.withColumn("root", root).withColumns({p: resolved(p) for p in ("image_path", "label_path")} | numbers | {"prompt_source": source}).drop("root", "manifest")


def list_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """``path, length, modificationTime`` of files below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return files.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), "length", "modificationTime")


def discover_inputs(spark: SparkSession, folder: str, limit: int | None = None) -> DataFrame:
    """Archives in path order, the first ``limit`` of them; the public validation subfolder's alone when it has any. None at all is an error."""
    files = list_files(spark, folder, "*.npz")
    inside = F.col("path").contains(f"/{PUBLIC_SUBFOLDER}/")
    facts = files.agg(F.coalesce(F.bool_or(inside), F.lit(False)).alias("has_public"), F.count(F.lit(1)).alias("files")).first()
    if facts["files"] == 0:
        raise FileNotFoundError(f"no .npz files under {folder}")
    if facts["has_public"]:
        files = files.where(inside)
    ordered = files.orderBy("path")
    return ordered if limit is None else ordered.limit(int(limit))


def fingerprints(wanted: DataFrame, listing: DataFrame) -> DataFrame:
    """Size and time of every wanted ``path``; ``missing`` where it does not exist."""
    listed = listing.select("path", F.col("length").alias("size"), F.unix_micros(F.col("modificationTime").cast("timestamp")).alias("mtime_us"))
    return wanted.join(listed, "path", "left").withColumn("missing", F.col("size").isNull())


def scan_class_map(spark: SparkSession, path: str) -> DataFrame:
    """Rows ``class_id, name, segmentation`` with the map's ``version`` and ``ignore_index``; raises on a malformed map.

    An entry is a name, or an object with name and segmentation. Ids count from 0 without gaps, names are unique, class 0 is the background.
    """
    doc = spark.read.schema("version STRING, ignore_index INT, classes MAP<STRING, STRING>").option("multiLine", True).json(path)
    entry = F.from_json("value", "name STRING, segmentation STRING")
    rows = doc.select("version", F.coalesce("ignore_index", F.lit(-1)).alias("ignore_index"), F.explode("classes").alias("key", "value")).select(
        "version", "ignore_index", F.expr("cast(key AS int)").alias("class_id"),
        F.when(F.col("value").startswith("{"), entry["name"]).otherwise(F.col("value")).alias("name"),
        F.when(F.col("value").startswith("{"), F.nullif(entry["segmentation"], F.lit("")))
        .when(F.expr("cast(key AS int)") != 0, F.col("value")).alias("segmentation"),
    )
    facts = rows.agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("class_id").alias("ids"), F.min("class_id").alias("low"), F.max("class_id").alias("high"),
        F.count_distinct("name").alias("names"), F.max(F.when(F.col("class_id") == 0, F.col("name"))).alias("zero"), F.max("version").alias("version"),
    ).first()
    if not facts["version"]:
        raise ValueError("class map has no version")
    if facts["n"] == 0 or facts["ids"] != facts["n"] or facts["low"] != 0 or facts["high"] != facts["n"] - 1:
        raise ValueError("class ids must count from 0 without gaps")
    if facts["names"] != facts["n"]:
        raise ValueError("class names must be present and unique")
    if facts["zero"] != "background":
        raise ValueError("class 0 must be background")
    return rows


def class_map_metadata(classes: DataFrame) -> DataFrame:
    return classes.agg(
        F.max("version").alias("class_map_version"), F.max("ignore_index").alias("ignore_index"), F.count(F.lit(1)).alias("num_aux_classes"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("class_id", "name")))).alias("class_names"),
    )


def write_case_log(header: DataFrame, cases: DataFrame, summary: DataFrame, path: str) -> None:
    """JSON lines tagged ``start``, ``case`` and ``summary``."""
    for name, rows in (("start", header), ("case", cases), ("summary", summary)):
        rows.withColumn("event", F.lit(name)).write.mode("append").json(path)


def scan_case_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CASE_LOG).json(path).where("event = 'case'")


def materialize_report(report: DataFrame, path: str) -> DataFrame:
    """The stored report if there is one, else this one, stored."""
    report.write.mode("ignore").parquet(path)
    return report.sparkSession.read.parquet(path)


def write_run_metrics(parts: dict[str, DataFrame], folder: str, run_id: str) -> None:
    """Summary, history, case rows and audit of one run under one key; a rerun replaces its own."""
    for name, rows in parts.items():
        rows.write.mode("overwrite").json(f"{folder}/run_id={run_id}/{name}")
