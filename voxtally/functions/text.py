"""Column expressions for names, keys and formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtally.functions.prefix import with_rank


def safe_name(value: Column) -> Column:
    """Anything but letters, digits, dash, underscore and dot becomes an underscore."""
    return F.regexp_replace(value, r"[^\p{L}\p{N}\-_.]", "_")


def cache_file_matches(file_name: Column, case_id: Column) -> Column:
    """A cache file belongs to a case if its name is the safe id, an underscore and 16 hex digits."""
    prefix = F.concat(safe_name(case_id), F.lit("_"))
    rest = F.substr(file_name, F.length(prefix) + 1)
    return file_name.startswith(prefix) & rest.rlike(r"^[0-9a-f]{16}\.npz$")


def key_of(*payload: Column) -> Column:
    """SHA-256 of the canonical JSON of the given columns."""
    return F.sha2(F.to_json(F.struct(*payload), {"ignoreNullFields": "false"}), 256)


def cache_path(folder: str, key: Column, stem: Column | None = None) -> Column:
    """``folder/<first two digits>/<name>.npz``; targets are named by case and 16 digits of their key."""
    name = key if stem is None else F.concat(safe_name(stem), F.lit("_"), F.substring(key, 1, 16))
    return F.concat(F.lit(f"{folder}/"), F.substring(key, 1, 2), F.lit("/"), name, F.lit(".npz"))


def run_component(value: Column) -> Column:
    """Part of a run id: other characters become one underscore; no dots, dashes or underscores at the ends."""
    return F.regexp_replace(F.regexp_replace(F.trim(value), r"[^A-Za-z0-9_.-]+", "_"), r"^[._-]+|[._-]+$", "")


def run_ids(runs: DataFrame) -> DataFrame:
    """Add ``run_id`` to runs ``(stamp, model, suffix, ord)``: stamp, model and suffix joined; repeats count from 2."""
    part = run_component(F.col("suffix"))
    base = F.concat_ws("_", "stamp", "model", F.when(part != "", part))
    return with_rank(runs.withColumn("base", base), ["base"], ["ord"], "repeat").withColumn(
        "run_id", F.when(F.col("repeat") == 1, F.col("base")).otherwise(F.concat_ws("_", "base", F.col("repeat").cast("string")))
    ).drop("base", "repeat")


def threshold_name(threshold: Column) -> Column:
    """Up to three decimals without trailing zeros."""
    return F.regexp_replace(F.format_string("%.3f", threshold), r"\.?0+$", "")


def threshold_label(threshold: Column) -> Column:
    """The name with ``p`` for the point."""
    return F.replace(threshold_name(threshold), F.lit("."), F.lit("p"))


def number_list(text: Column, kind: str = "int") -> Column:
    """Numbers of a comma-separated text; empty parts are skipped."""
    parts = F.filter(F.transform(F.split(text, ","), lambda p: F.trim(p)), lambda p: p != "")
    return F.transform(parts, lambda p: p.cast(kind))
