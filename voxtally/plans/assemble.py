"""Cases ready for use: cached where the cache has them, else resampled from raw tables with their target chosen."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtally.operators import resample as rs
from voxtally.operators.components import component_runs
from voxtally.operators.targets import resolve_targets, target_voxels


@dataclass(frozen=True)
class Assembled:
    """``targets(case_id, prompt, z, y, x)``, ``prompts`` in the same frame, ``origin(case_id, prompt, from_cache)``."""

    targets: DataFrame
    prompts: DataFrame
    origin: DataFrame


def effective_target(mask: DataFrame, prompts: DataFrame, chosen: DataFrame) -> DataFrame:
    """Chosen target voxels; a prompt without a choice takes its whole case's foreground."""
    keys = ["case_id", "prompt"]
    lacking = prompts.select(*keys).join(chosen.select(*keys).distinct(), keys, "left_anti")
    whole = mask.select("case_id", "z", "y", "x").join(lacking, "case_id").select(*keys, "z", "y", "x")
    return chosen.select(*keys, "z", "y", "x").unionByName(whole)


def aux_or_placeholder(aux: DataFrame, cases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Class labels and, per case, whether it has any; a case without labels is ignored everywhere (no rows)."""
    has = aux.select("case_id").distinct().withColumn("has_aux", F.lit(True))
    return aux, cases.select("case_id").join(has, "case_id", "left").fillna(False, ["has_aux"])


def assemble_cases(
    records: DataFrame, prompts: DataFrame, mask: DataFrame, meta: DataFrame, cached_targets: DataFrame, cached_prompts: DataFrame,
    target_xyz: tuple[float, float, float], mode: str = "anisotropic",
) -> Assembled:
    """Cached targets and prompts pass through; the rest is resampled and resolved. The cache only serves the anisotropic mode.

    ``records(case_id, prompt, target_label, target_component)``; cached tables are already in the target frame.
    """
    keys = ["case_id", "prompt"]
    wanted = records.select(*keys)
    hits = cached_prompts.select(*keys).join(wanted, keys, "left_semi").distinct() if mode == "anisotropic" else wanted.where("false")
    misses = records.join(hits, keys, "left_anti")
    cases = misses.select("case_id").distinct()
    plan = rs.spacing_plan(meta.join(cases, "case_id", "left_semi"), target_xyz, mode)
    open_prompts = rs.resample_prompts(prompts.join(misses.select(*keys), keys, "left_semi"), plan)
    resampled = rs.resample_mask(mask.join(cases, "case_id", "left_semi"), plan)
    runs = component_runs(resampled)
    chosen = target_voxels(resolve_targets(misses, open_prompts, runs), runs).select(*keys, "z", "y", "x")
    targets = effective_target(resampled, open_prompts, chosen)
    from_cache = cached_targets.join(hits, keys, "left_semi").select(*keys, "z", "y", "x")
    kept = cached_prompts.join(hits, keys, "left_semi").select(open_prompts.columns)
    origin = hits.withColumn("from_cache", F.lit(True)).unionByName(misses.select(*keys).withColumn("from_cache", F.lit(False)))
    return Assembled(from_cache.unionByName(targets), kept.unionByName(open_prompts), origin)
