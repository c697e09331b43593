"""Which component a prompt means: overlap with marker components, ranking by line and endpoints, final target."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtally.functions.geometry import ENDS, clip, clip_index, midpoint
from voxtally.operators.components import runs_to_voxels
from voxtally.operators.prompts import rasterize_line
from voxtally.session import cut_lineage, never_sent


def marker_to_target(marker_runs: DataFrame, target_runs: DataFrame) -> DataFrame:
    """For each marker component the target component with most common voxels, then most voxels.

    Every overlapping component competes. Ties go to the lowest label and component.
    """
    sizes = target_runs.groupBy("case_id", "label", "component_id").agg(F.sum(F.expr("cast(x1 - x0 + 1 AS bigint)")).alias("voxel_count"))
    marks = marker_runs.selectExpr("case_id", "suffix", "z", "y", "x0 AS m0", "x1 AS m1")
    hits = marks.join(target_runs, ["case_id", "z", "y"]).where("m0 <= x1 AND x0 <= m1")
    overlap = hits.groupBy("case_id", "suffix", "label", "component_id").agg(
        F.sum(F.expr("cast(least(m1, x1) - greatest(m0, x0) + 1 AS bigint)")).alias("overlap")
    )
    ranked = overlap.join(sizes, ["case_id", "label", "component_id"])
    order = F.struct("overlap", "voxel_count", -F.col("label"), -F.col("component_id"))
    return ranked.groupBy("case_id", "suffix").agg(
        F.max_by(F.struct("label", "component_id", "overlap", "voxel_count"), order).alias("t")
    ).select("case_id", "suffix", "t.*")


def prompt_points(prompts: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Voxels a prompt touches: both endpoint voxels (``kind`` 0) and its one-voxel line within its slice (``kind`` 1)."""
    ends = prompts.select(
        *keys,
        F.inline(F.array(*[
            F.struct(*[clip_index(F.col(f"{e}{axis}"), F.col(f"n{axis}")).alias(axis) for axis in "zyx"]) for e in "ab"
        ])),
    ).withColumn("kind", F.lit(0))
    slices = prompts.select(*keys, clip(F.col("slice"), 0, F.col("nz") - 1).cast("int").alias("slice"))
    line = rasterize_line(prompts, radius=0, keys=keys).join(slices, list(keys)).where("z = slice").drop("slice")
    return ends.unionByName(line.withColumn("kind", F.lit(1)))


def prompt_labels(prompts: DataFrame, runs: DataFrame, keys: tuple[str, ...] = ("case_id", "prompt")) -> DataFrame:
    """Distinct positive labels at the endpoints and on the line, sorted."""
    touched = _touched(prompts, runs, keys)
    return touched.groupBy(*keys).agg(
        F.array_sort(F.collect_set(F.when(F.col("kind") == 0, F.col("label")))).alias("labels_at_endpoints"),
        F.array_sort(F.collect_set(F.when(F.col("kind") == 1, F.col("label")))).alias("labels_on_line"),
    )


def _touched(prompts: DataFrame, runs: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    points = prompt_points(prompts, keys)
    return points.join(runs, ["case_id", "z", "y"]).where("x BETWEEN x0 AND x1")


def _gap2(end: str) -> str:
    """Squared distance of an endpoint to the nearest voxel of a run."""
    nearest = f"least(greatest(rint({end}x), x0), x1)"
    return f"pow(z - {end}z, 2) + pow(y - {end}y, 2) + pow({nearest} - {end}x, 2)"


def _box_distance(end: str, nearest: bool) -> str:
    """Distance of an endpoint to the nearest point, or the farthest corner, of a component's box."""
    gaps = [f"greatest({a}_min - {end}{a}, {end}{a} - {a}_max, 0)" if nearest else f"greatest(abs({end}{a} - {a}_min), abs({end}{a} - {a}_max))" for a in "zyx"]
    return f"sqrt({' + '.join(f'pow({g}, 2)' for g in gaps)})"


def _contenders(placed: DataFrame, hits: DataFrame, boxes: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Components that can still win a prompt, ``(keys.., label, component_id)`` with the evidence of touching.

    Whoever touches voxels wins over all that don't, so of a prompt's hits only the best by evidence remain. A prompt that touches nothing meets
    the components of its case as boxes: those that are farther at least than another is at most are out.
    """
    evidence = F.struct("endpoint_label_hit", "line_label_hit", "line_overlap", "endpoint_hits")
    best = hits.groupBy(*keys).agg(F.max(evidence).alias("best"))
    touching = hits.join(best, list(keys)).where(evidence == F.col("best")).drop("best")
    blind = placed.join(hits.select(*keys).distinct(), list(keys), "left_anti").join(boxes, "case_id")
    mean = lambda nearest: F.expr(f"({_box_distance('a', nearest)} + {_box_distance('b', nearest)}) / 2")
    blind = blind.withColumns({"least": mean(True), "most": mean(False)})
    roof = blind.groupBy(*keys).agg(F.min("most").alias("roof"))
    open_ = blind.join(roof, list(keys)).where("least <= roof + 1e-6").select(*keys, "label", "component_id")
    none = {"line_overlap": F.lit(0).cast("bigint"), "endpoint_hits": F.lit(0).cast("bigint"), "endpoint_label_hit": F.lit(False), "line_label_hit": F.lit(False)}
    return touching.unionByName(open_.withColumns(none))


def select_target_instance(prompts: DataFrame, component_runs: DataFrame, keys: tuple[str, ...] = ("case_id", "prompt")) -> DataFrame:
    """The component each prompt points at, with the evidence.

    Order of evidence: its label is met at an endpoint; its label is met on the line; voxels on the line; endpoints
    inside; small mean endpoint distance (in the prompt's slice when the component reaches it); small slice distance;
    size; then lowest label and component. Prompts of cases without a mask do not appear.

    Runs are read for components that can still win only: those in the prompt's slice where a component reaches it, else all of its runs.
    """
    comp = ["label", "component_id"]
    hits = _touched(prompts, component_runs, keys).groupBy(*keys, *comp).agg(
        F.count_if(F.col("kind") == 1).alias("line_overlap"), F.count_if(F.col("kind") == 0).alias("endpoint_hits")
    )
    hits = cut_lineage(hits)
    label_hits = hits.groupBy(*keys, "label").agg(
        F.max(F.col("endpoint_hits") > 0).alias("endpoint_label_hit"), F.max(F.col("line_overlap") > 0).alias("line_label_hit")
    )
    boxes = cut_lineage(component_runs.groupBy("case_id", *comp).agg(
        F.sum(F.expr("cast(x1 - x0 + 1 AS bigint)")).alias("voxel_count"),
        *[f(c).alias(f"{a}_{n}") for a, low, high in (("z", "z", "z"), ("y", "y", "y"), ("x", "x0", "x1")) for f, c, n in ((F.min, low, "min"), (F.max, high, "max"))],
    ))
    placed = prompts.select(*keys, *ENDS, clip(F.col("slice"), 0, F.col("nz") - 1).cast("int").alias("slice"))
    contenders = cut_lineage(_contenders(placed, hits.join(label_hits, [*keys, "label"]), boxes, keys))
    asked = contenders.join(placed, list(keys))
    gaps = [f"{_gap2('a')} AS da", f"{_gap2('b')} AS db"]
    inside = asked.join(component_runs.withColumnRenamed("z", "slice"), ["case_id", *comp, "slice"]).withColumn("z", F.col("slice"))
    near = cut_lineage(inside.selectExpr(*keys, *comp, *gaps).groupBy(*keys, *comp).agg(F.min("da").alias("da"), F.min("db").alias("db"), F.lit(0).alias("slice_distance")))
    outside = asked.join(near.select(*keys, *comp), [*keys, *comp], "left_anti").join(component_runs, ["case_id", *comp])
    far = outside.selectExpr(*keys, *comp, *gaps, "abs(z - slice) AS off").groupBy(*keys, *comp).agg(F.min("da").alias("da"), F.min("db").alias("db"), F.min("off").alias("slice_distance"))
    scored = contenders.join(near.unionByName(far), [*keys, *comp]).join(boxes.select("case_id", *comp, "voxel_count"), ["case_id", *comp])
    scored = scored.withColumn("endpoint_distance", F.expr("(sqrt(da) + sqrt(db)) / 2"))
    evidence = ["label", "component_id", "voxel_count", "line_overlap", "endpoint_hits", "endpoint_distance", "slice_distance", "endpoint_label_hit", "line_label_hit"]
    order = F.struct(
        "endpoint_label_hit", "line_label_hit", "line_overlap", "endpoint_hits", -F.round("endpoint_distance", 9), -F.col("slice_distance"),
        "voxel_count", -F.col("label"), -F.col("component_id"),
    )
    best = scored.groupBy(*keys).agg(F.max_by(F.struct(*evidence), order).alias("s"))
    labels = boxes.groupBy("case_id", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("case_id").agg(
        F.sum("n").alias("component_candidate_count"), F.count(F.lit(1)).alias("positive_label_count")
    )
    mode = (
        F.when(F.col("endpoint_label_hit"), "direct_endpoint_label_hit")
        .when(F.expr("line_label_hit OR line_overlap > 0 OR endpoint_hits > 0"), "recist_line_match")
        .otherwise("nearest_component_fallback")
    )
    return best.join(placed.select(*keys, "slice"), list(keys)).join(labels, "case_id").select(
        *keys, "slice", "component_candidate_count", "positive_label_count", "s.*"
    ).withColumn("selection_mode", mode).withColumn("used_fallback", F.col("selection_mode") == "nearest_component_fallback")


def resolve_targets(records: DataFrame, prompts: DataFrame, component_runs: DataFrame) -> DataFrame:
    """Target per record ``(case_id, prompt, target_label, target_component)``.

    The named label (and component, when given) wins if it holds voxels, else the prompt's selection. Only records
    without a valid named target are ranked. ``component_id`` is null where a whole label is the target.
    """
    keys = ["case_id", "prompt"]
    sizes = component_runs.groupBy("case_id", "label", "component_id").agg(F.sum(F.expr("cast(x1 - x0 + 1 AS bigint)")).alias("n"))
    named = records.where("target_label IS NOT NULL").join(
        sizes.withColumnRenamed("label", "target_label"), ["case_id", "target_label"]
    ).where("target_component IS NULL OR target_component = component_id").groupBy(
        *keys, F.col("target_label").alias("label"), F.col("target_component").alias("component_id")
    ).agg(F.sum("n").alias("voxel_count")).withColumn("selection_mode", F.lit("manifest_target_label"))
    open_prompts = prompts.join(named, keys, "left_anti").join(records.select(*keys), keys, "left_semi")
    chosen = select_target_instance(open_prompts, component_runs).select(*keys, "label", "component_id", "voxel_count", "selection_mode")
    return named.select(chosen.columns).unionByName(chosen)


def target_voxels(targets: DataFrame, component_runs: DataFrame) -> DataFrame:
    """Voxels of resolved targets."""
    wanted = targets.selectExpr("case_id", "prompt", "label", "component_id AS wanted")
    runs = component_runs.join(wanted, ["case_id", "label"]).where("wanted IS NULL OR wanted = component_id")
    return runs_to_voxels(runs.select("case_id", "prompt", "label", "z", "y", "x0", "x1"))


def component_records(component_runs: DataFrame, endpoints: DataFrame, min_voxels: int = 0) -> DataFrame:
    """One case record per labelled component; the id keeps the plain case name when there is only one."""
    keys = ["case_id", "label", "component_id"]
    sized = endpoints.where(F.col("marker_voxels") >= int(min_voxels))
    counts = never_sent(sized.groupBy("case_id").agg(F.count(F.lit(1)).alias("components")))
    return sized.join(counts, "case_id").select(
        F.when(F.col("components") <= 1, F.col("case_id").cast("string")).otherwise(
            F.concat("case_id", F.lit("__label"), "label", F.lit("_component"), "component_id")
        ).alias("record_id"),
        *keys, *ENDS, "slice", F.lit("derived_from_gt_component").alias("prompt_source"), F.col("marker_voxels").alias("target_voxel_count"),
    )


def marker_records(marker_endpoints: DataFrame, targets: DataFrame) -> DataFrame:
    """One case record per marker component ``(case_id, suffix, component_count, endpoints)`` with the target it marks."""
    joined = marker_endpoints.join(
        targets.selectExpr("case_id", "suffix", "label AS target_label", "component_id AS target_component", "voxel_count AS target_voxel_count"),
        ["case_id", "suffix"], "left",
    )
    single = F.col("component_count") <= 1
    return joined.select(
        F.when(single, F.col("case_id").cast("string")).otherwise(F.concat("case_id", F.lit("__"), "suffix")).alias("record_id"),
        "case_id", *ENDS, "slice", F.when(single, "recist").otherwise("recist_component").alias("prompt_source"),
        "target_label", "target_component", "target_voxel_count",
    )


def endpoint_records(sets: DataFrame) -> DataFrame:
    """One record per endpoint set ``(case_id, sets)``; ids count from 1 when there are several."""
    rows = sets.select("case_id", F.size("sets").alias("n"), F.posexplode("sets").alias("pos", "s"))
    return rows.select(
        F.when(F.col("n") == 1, F.col("case_id").cast("string")).otherwise(
            F.concat("case_id", F.lit("__recist_endpoint"), (F.col("pos") + 1).cast("string"))
        ).alias("record_id"),
        "case_id", *[F.col("s")[i][j].alias(f"{e}{axis}") for i, e in enumerate("ab") for j, axis in enumerate("xyz")],
        F.rint((F.col("s")[0][2] + F.col("s")[1][2]) / 2).cast("int").alias("slice"),
    )


def midpoints(prompts: DataFrame, region: DataFrame | None = None, keys: tuple[str, ...] = ("case_id",)) -> DataFrame:
    """Centre of each prompt: mean of its endpoints, else of its region's voxels, which come as such or as runs."""
    points = prompts.select(*keys, *[midpoint(axis).alias(f"m{axis}") for axis in "zyx"])
    if region is None:
        return points
    n = F.expr("cast(x1 - x0 + 1 AS bigint)" if "x0" in region.columns else "1L")
    at = {"z": F.col("z"), "y": F.col("y"), "x": F.expr("(x0 + x1) / 2" if "x0" in region.columns else "x")}
    means = region.groupBy(*keys).agg(*[(F.sum(at[axis] * n) / F.sum(n)).alias(f"r{axis}") for axis in "zyx"], F.sum(n).alias("region_voxels"))
    return points.join(means, list(keys), "full").select(
        *keys, *[F.coalesce(f"m{axis}", f"r{axis}").alias(f"m{axis}") for axis in "zyx"],
        *[F.col(f"r{axis}") for axis in "zyx"], F.coalesce("region_voxels", F.lit(0)).alias("region_voxels"),
    )
